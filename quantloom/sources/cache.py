"""Results kept as Parquet by key, with expiry and invalidation by prefix, safe with several writers.

A key's folder holds generations of data and a numbered marker for each: ``{"made": seconds, "data": folder}`` or
``{"made": seconds, "data": null}`` for an invalidation. The marker with the greatest number counts. A writer fills a folder of its
own and then creates the next marker, which succeeds for one writer alone: another one with the same number drops its
data and reads the winner's. Readers never see a half-written generation.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession

from .shared import delete, exists, names, write_new


class ParquetCache:
    def __init__(self, spark: SparkSession, root: str, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock

    def _folder(self, key: str) -> str:
        return f"{self.root}/{quote(key, safe='')}"

    def _newest(self, key: str) -> tuple[int, dict]:
        """The number of the newest marker (0: none) and what it says."""
        numbers = [int(n.removesuffix(".json")) for n in names(self.spark, self._folder(key)) if n.endswith(".json")]
        if not numbers:
            return 0, {"data": None, "made": 0}
        return max(numbers), json.loads(self.spark.read.text(f"{self._folder(key)}/{max(numbers)}.json").first()[0])

    def get(self, key: str, ttl: float | None = None) -> DataFrame | None:
        """What is kept under the key, unless it is older than ``ttl`` seconds or was invalidated."""
        _, at = self._newest(key)
        if at["data"] is None or (ttl is not None and self.clock() - at["made"] > ttl):
            return None
        return self.spark.read.parquet(f"{self._folder(key)}/{at['data']}")

    def put(self, key: str, df: DataFrame) -> DataFrame:
        number, data = self._newest(key)[0] + 1, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self._folder(key)}/{data}")
        if not write_new(self.spark, f"{self._folder(key)}/{number}.json", json.dumps({"made": self.clock(), "data": data})):
            delete(self.spark, f"{self._folder(key)}/{data}")  # another writer was first
        kept = self.get(key)
        return self.put(key, df) if kept is None else kept

    def get_or_make(self, key: str, make: Callable[[], DataFrame], ttl: float | None = None) -> DataFrame:
        kept = self.get(key, ttl)
        return self.put(key, make()) if kept is None else kept

    def keys(self, prefix: str = "") -> list[str]:
        return [k for k in map(unquote, names(self.spark, self.root)) if k.startswith(prefix)]

    def invalidate(self, prefix: str) -> int:
        """Marks all keys with the prefix as out of date; returns how many were not before."""
        n = 0
        for key in self.keys(prefix):
            number, at = self._newest(key)
            if at["data"] is not None:
                n += write_new(self.spark, f"{self._folder(key)}/{number + 1}.json", json.dumps({"made": self.clock(), "data": None}))
        return n

    def vacuum(self, older: float) -> int:
        """Deletes generations that a newer marker has replaced for more than ``older`` seconds; returns how many."""
        n = 0
        for key in self.keys():
            number, at = self._newest(key)
            if self.clock() - at["made"] <= older:
                continue
            for name in names(self.spark, self._folder(key)):
                old_marker = name.endswith(".json") and int(name.removesuffix(".json")) < number
                if old_marker or (name.startswith("data-") and name != at["data"]):
                    delete(self.spark, f"{self._folder(key)}/{name}")
                    n += name.startswith("data-")
        return n

    def drop(self) -> None:
        if exists(self.spark, self.root):
            delete(self.spark, self.root)
