"""A bounded cache for tasks: words repeat, so what was made for one is kept while it is in use."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Recent(dict):
    """``self[key]`` is ``make(key)``, kept for up to two generations of ``size`` keys."""

    def __init__(self, make: Callable[[Any], Any], size: int) -> None:
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, key: Any) -> Any:
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value
