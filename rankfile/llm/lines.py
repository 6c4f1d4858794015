"""Operator 12, line deduplication with levelled sorted runs of line hashes.

A run is a table of line keys (128-bit digests) with the documents that hold them and the largest id among these, bucketed and
sorted by key.  A new batch of documents is merge-anti-joined with the runs: keys that no run holds are its own, others are
increments to keys held already; both are written as the batch's run on level 0.  When a level holds ``fanout`` runs they are merged
into one on the next level, increments going into the keys they belong to.  Runs share one bucketing, so merges and joins move no
row of a run over the network, and work for a batch is one pass over its keys and the runs beside them.

``dropped_lines`` then looks the keys up that enough documents hold.  The lines of the input are staged once, as (document, place,
key) in batches by the hash of the id; only keys are shuffled for the counts.  Everything is DataFrame operations: the counts are
combined before the shuffle, and the lookup of a line that a third of all documents hold is a skewed join whose large side Spark
splits, as each key comes once on the other.

Defined results: a null or empty text is one empty line; rows without an id count as one document before all others; rows that share
an id are one document, and each loses the lines that go; a line that comes twice in a document counts once and goes twice; very
long texts and lines stay whole; an empty table gives an empty result; other columns are kept by ``deduplicated`` unless they bear
the name of one that it adds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, drop_folder, shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"
NO_ID = -(2**63)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column, least: int) -> Column:
    """Digest of a line stripped of white space and in lower case (A-Z only), null for one under ``least`` code points."""
    bare = F.btrim(line, F.lit(SPACE))
    # both give the same for ASCII alone, and lower is much the faster
    low = F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))
    return F.when(F.char_length(bare) >= least, F.md5(low.cast("binary")))


class Runs:
    """Levelled sorted runs (key, n, top) in a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int, fanout: int = 2):
        self.spark, self.folder, self.buckets, self.fanout = spark, folder, buckets, fanout
        self.levels: list[list[str]] = []
        self.name = f"rankfile_runs_{uuid.uuid4().hex}"
        self.written = 0

    def _write(self, run: DataFrame) -> str:
        name = f"{self.name}_{self.written}"
        self.written += 1
        # one file a bucket: rows are dealt as the buckets are
        run.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{name}").format("parquet").saveAsTable(name)
        return name

    def _tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key, n, top), one row a key, over documents that no earlier batch held."""
        rows, held = batch.withColumn("known", F.lit(False)), self._tables()
        if held:
            rows = rows.repartition(self.buckets, "key")
        for t in held:
            # a key is a run's own in one run at most; what no run holds is left unmatched (the anti-join)
            own = self.spark.table(t).where(~F.col("known")).select("key", F.lit(True).alias("_found"))
            rows = rows.join(own.hint("merge"), "key", "left").select("key", "n", "top", (F.col("known") | F.col("_found").isNotNull()).alias("known"))
        self._push(0, self._write(rows))

    def _push(self, level: int, table: str) -> None:
        if len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            some, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._write(self._merged(some)))
            self._drop(some)

    def _merged(self, tables: list[str]) -> DataFrame:
        """The runs as one, by merge joins of their buckets.  (A union of bucketed tables is no way: Spark 4.1 takes its partitions
        for buckets although scans in columns are laid one after the other, and keys then come twice.)"""
        rows = self.spark.table(tables[0])
        for t in tables[1:]:
            more = self.spark.table(t).withColumnsRenamed({"n": "_n", "top": "_top", "known": "_known"})
            both = rows.join(more.hint("merge"), "key", "full")
            no, yes = F.lit(0), F.lit(True)
            rows = both.select("key", (F.coalesce("n", no) + F.coalesce("_n", no)).alias("n"), F.greatest("top", "_top").alias("top"), (F.coalesce("known", yes) & F.coalesce("_known", yes)).alias("known"))
        return rows

    def counts(self) -> DataFrame:
        """(key, n, top) over all runs."""
        return self._merged(self._tables()).select("key", "n", "top")

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"drop table if exists {t}")
            drop_folder(self.spark, f"{self.folder}/{t}")

    def close(self) -> None:
        self._drop(self._tables())
        self.levels = []


def staged(docs: DataFrame, *, key: str, text: str, least: int, batches: int) -> DataFrame:
    """(id, t, place, key, counts, batch): the lines that are long enough.  ``t`` tells rows of one id apart by their texts.  A line
    counts once a document: in documents with repeated lines by rows of its own (place -1), elsewhere by the rows of the lines."""
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("t"), lines_of(F.col(text)).alias("_l"))
    d = d.withColumn("_k", F.filter(F.transform("_l", lambda x, i: F.struct(line_key(x, least).alias("key"), i.alias("place"))), lambda s: s["key"].isNotNull())).drop("_l").where(F.size("_k") > 0)
    d = d.withColumn("_u", F.array_distinct("_k.key"))
    row = lambda k, place, counts: F.struct(k.alias("key"), place.alias("place"), F.lit(counts).alias("counts"))
    each = lambda counts: F.transform("_k", lambda s: row(s["key"], s["place"], counts))
    alone = F.transform("_u", lambda k: row(k, F.lit(-1), True))
    rows = d.select("id", "t", F.explode(F.when(F.size("_u") == F.size("_k"), each(True)).otherwise(F.concat(each(False), alone))).alias("_r"))
    return rows.select("id", "t", "_r.place", F.unhex("_r.key").alias("key"), "_r.counts", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))


def dropped_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 40, documents: int = 5, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(id, t, places): for documents that lose lines, the places (from 0) of those."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "lines")
    staged(docs, key=key, text=text, least=least, batches=batches).write.partitionBy("batch").parquet(f"{folder}/lines")
    schema = "id long, t long, place int, key binary, counts boolean, batch int"
    rows = spark.read.schema(schema).parquet(f"{folder}/lines")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // 2_000_000))  # the count comes from the files' footers
    # rows that share an id are one document
    twice = not docs.groupBy(key).count().where("count > 1").isEmpty()
    runs = Runs(spark, folder, buckets, fanout)
    for b in range(batches):
        some = rows.where((F.col("batch") == b) & F.col("counts")).select("key", "id")
        some = some.distinct() if twice else some
        runs.add(some.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("top")))
    often = checkpoint(runs.counts().where(F.col("n") >= documents).select("key", "top"))
    runs.close()
    lost = rows.where("place >= 0").select("id", "t", "place", "key").join(often, "key").where("id <> top")
    lost = checkpoint(lost.groupBy("id", "t").agg(F.collect_list("place").alias("places")))
    drop_folder(spark, folder)
    return lost


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with ``text`` less the dropped lines, n_lines (before) and n_dropped."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    lost = dropped_lines(docs, key=key, text=text, **how).select(F.col("id").alias("_id"), F.col("t").alias("_t"), F.col("places").alias("_places"))
    rows = docs.select(*kept).withColumns({"_id": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), "_t": F.xxhash64(text)}).join(lost, ["_id", "_t"], "left")
    rows = rows.withColumn("_l", lines_of(F.col(text)))
    # places are told apart by a hash set, so a document of any length takes time in proportion to it
    stay = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), F.col("_places"))
    less = F.array_join(F.transform(stay, lambda i: F.get("_l", i)), "\n")
    out = F.when(F.col("_places").isNull(), F.col(text)).otherwise(less)
    return rows.select(*(out.alias(c) if c == text else F.col(c) for c in kept), F.size("_l").cast("long").alias("n_lines"), F.when(F.col("_places").isNull(), 0).otherwise(F.size(F.array_distinct("_places"))).cast("long").alias("n_dropped"))


def op12_lines(docs: DataFrame) -> DataFrame:
    d = deduplicated(docs.select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
