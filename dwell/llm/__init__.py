"""Operators of a training-data pipeline: quality, tokens, packing, archives and near-duplicates.

Nothing else in ``dwell`` imports this subpackage.
"""
