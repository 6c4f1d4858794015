"""Exact uniqueness that grows shard by shard: sorted runs of 64-bit keys by range, merged level by level.

A run is a folder of files by range (the upper bits of the key), sorted inside.  A new shard's keys are looked up in the ranges that
they touch only, behind a Bloom filter of them, and those that no run holds become a run of level 0; when a level holds ``fanout``
runs they are merged into one of the next level, range by range.  Runs share no key, so a count is a sum of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfile.operators import bloom
from rankfile.operators.lineage import drop_folder

RANGE_BITS = 6


class KeyRuns:
    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        self.levels: list[list[str]] = []
        self.written, self.unique, self.rows = 0, 0, 0

    def _read(self, paths: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, (self.spark.read.schema("key long, range int").parquet(p) for p in paths))

    def _write(self, keys: DataFrame) -> str:
        path = f"{self.folder}/run-{self.written:05d}"
        self.written += 1
        keys.repartition("range").sortWithinPartitions("range", "key").write.partitionBy("range").parquet(path)
        return path

    def add(self, keys: DataFrame) -> int:
        """Takes a shard's keys (the column ``key``, 64 bits); gives how many of them no earlier shard had."""
        counted = keys.groupBy("key").agg(F.count("*").alias("_c")).withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS).cast("int"))
        held = [p for level in self.levels for p in level]
        fresh = counted.select("key", "range")
        if held:
            touched = [r[0] for r in fresh.select("range").distinct().collect()]  # 64 at most
            fresh = bloom.unseen(fresh, self._read(held).where(F.col("range").isin(touched)), "key")
        path = self._write(fresh)
        n = self.spark.read.schema("key long, range int").parquet(path).count()
        self.unique += n
        self.rows += keys.count()
        self._push(0, path)
        return n

    def _push(self, level: int, path: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            some, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._read(some)))
            for p in some:
                drop_folder(self.spark, p)
