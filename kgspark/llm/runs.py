"""Levelled immutable runs (a log-structured merge tree of tables), bucketed and sorted by one key.

A run is a Parquet table bucketed by the key, so that a batch is merge-joined with it bucket by bucket and
old runs are never shuffled again. New runs enter at level 0; a level that holds `fanout` runs is merged
into one run of the next level, so a row is rewritten once for each level.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm.common import discard, shared_dir


class Runs:
    """The runs of one index. merge says what a union of runs becomes: one row for each key, or key and more."""

    def __init__(self, spark: SparkSession, key: str, merge: Callable[[DataFrame], DataFrame], path: str | None = None, fanout: int = 4):
        self.spark, self.key, self.merge, self.fanout = spark, key, merge, fanout
        self.path, self.name = path or shared_dir(spark), f"kgspark_run_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.made = self.compactions = 0

    def written(self, rows: DataFrame) -> str:
        """Writes rows as a table of its own, which is not yet a run; gives its name."""
        self.made += 1
        name = f"{self.name}_{self.made}"
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unknown(self, batch: DataFrame) -> DataFrame:
        """Rows of the batch whose key no run has: a merge anti-join with each run."""
        return reduce(lambda rows, n: rows.join(self.table(n).select(self.key).hint("merge"), self.key, "left_anti"), self.names(), batch)

    def known(self, batch: DataFrame) -> DataFrame | None:
        """Rows of the runs whose key the batch has (its keys are distinct), or None before the first run."""
        keys = batch.select(self.key)
        found = [self.table(n).join(keys.hint("merge"), self.key, "left_semi") for n in self.names()]
        return reduce(DataFrame.unionByName, found) if found else None

    def push(self, name: str) -> None:
        """Makes a written table the newest run and compacts the levels that are full."""
        self.levels[0].append(name)
        for i, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if i + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[i + 1].append(self._compact(level))
                self.levels[i] = []

    def _compact(self, names: list[str]) -> str:
        # read as plain files: a union of bucketed scans may pass for co-partitioned when its scans no longer are
        self.compactions += 1
        rows = (self.spark.read.schema(self.table(n).schema).parquet(f"{self.path}/{n}") for n in names)
        out = self.written(self.merge(reduce(DataFrame.unionByName, rows)))
        self.drop(names)
        return out

    def compacted(self) -> DataFrame | None:
        """All runs as one, which takes their place; None if there is none."""
        names = self.names()
        if len(names) > 1:
            self.levels = [*([] for _ in self.levels[1:]), [self._compact(names)]]
        return self.table(self.names()[0]) if names else None

    def drop(self, names: list[str] | None = None) -> None:
        """Deletes tables, by default all runs."""
        if names is None:
            names, self.levels = self.names(), [[]]
        for n in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")
        discard(self.spark, *(f"{self.path}/{n}" for n in names), shuffles=False)
