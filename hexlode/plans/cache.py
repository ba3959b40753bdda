"""A small result cache on the driver: the least recently used results go first, and any goes after a time."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame


class QueryCache:
    """Persisted DataFrames by kind and parameters; clear() after tables change."""

    def __init__(self, size: int = 1000, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.seconds, self.clock = size, seconds, clock
        self.held: OrderedDict[str, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(kind: str, parameters: Mapping[str, Any]) -> str:
        return hashlib.md5(json.dumps([kind, parameters], sort_keys=True, default=str).encode()).hexdigest()

    def get(self, kind: str, parameters: Mapping[str, Any], make: Callable[[], DataFrame]) -> DataFrame:
        key, now = self.key(kind, parameters), self.clock()
        if key in self.held and now - self.held[key][0] <= self.seconds:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key][1]
        self.misses += 1
        self._drop(key)
        made = make().persist()
        self.held[key] = (now, made)
        while len(self.held) > self.size:
            self._drop(next(iter(self.held)))
        return made

    def _drop(self, key: str) -> None:
        if (old := self.held.pop(key, None)) is not None:
            old[1].unpersist()

    def expire(self) -> int:
        gone = [k for k, (t, _) in self.held.items() if self.clock() - t > self.seconds]
        for k in gone:
            self._drop(k)
        return len(gone)

    def clear(self) -> None:
        for k in list(self.held):
            self._drop(k)

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"size": len(self.held), "hits": self.hits, "misses": self.misses, "hit_rate": round(self.hits / asked, 4) if asked else 0.0}
