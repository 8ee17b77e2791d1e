"""Caches of bounded results on the driver: query embeddings and top-k answers."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from typing import Any


class Cache:
    """The last ``size`` values, each for ``ttl`` seconds at most (None: for ever), the least recently used one leaves first."""

    def __init__(self, size: int, ttl: float | None = None, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self._values: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: Hashable, make: Callable[[], Any]) -> Any:
        """The value of key, made if it isn't there or too old."""
        now = self.clock()
        if key in self._values and (self.ttl is None or now - self._values[key][0] < self.ttl):
            self.hits += 1
            self._values.move_to_end(key)
            return self._values[key][1]
        self.misses += 1
        self._values.pop(key, None)
        value = make()
        self._values[key] = (now, value)
        while len(self._values) > self.size:
            self._values.popitem(last=False)
        return value

    def clear(self) -> None:
        self._values.clear()


def cached_embedder(embedder: Callable[[list[str]], list[list[float]]], size: int = 1024, ttl: float | None = None) -> Callable[[str], list[float]]:
    """Vectors of single queries from an embedder of batches, kept."""
    cache = Cache(size, ttl)
    return lambda text: cache.get(text, lambda: embedder([text])[0])


def cached_top(cache: Cache, key: Hashable, df: Callable[[], Any], k: int) -> list[dict]:
    """The first k rows of a ranked frame as dicts; k rows at most reach the driver, and stay there."""
    return cache.get((key, k), lambda: [r.asDict(recursive=True) for r in df().limit(k).collect()])
