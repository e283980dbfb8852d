"""Identity-presence analytics as Spark DataFrame plans."""
