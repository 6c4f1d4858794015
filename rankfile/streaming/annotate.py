"""Streaming form of cross-shard status: one state a key (the first shard that wrote it), kept in the RocksDB state store.

A key enters the state only with a labelled row, so failed keys may come again.  Before the shuffle each task brings the rows of a
key and shard that share their flags together as one with a list of row numbers, so a key that is in every game reaches its task as
a few rows.  The store looks up and writes the batch's keys only: what a batch reads and commits follows the batch, not the state.
A batch is written once and the gate reads what was written; a batch that is run again after a failure starts from the same state
version and overwrites its own output, which makes the result the batch closed form in any case."""

from __future__ import annotations

import json
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfile.operators import dataset
from rankfile.streaming import progress

FLAGS = ["ok", "last", "truncated"]
TOGETHER = "key string, shard long, ok boolean, last boolean, truncated boolean, row_idx array<long>"
DECIDED = f"{TOGETHER}, status string, written boolean"
# Changes alone are committed with a batch; whole snapshots follow in the background.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def rocksdb(spark: SparkSession):
    """A query started inside keeps the store for its life (it runs on a copy of the session, and a restart reads the store's kind
    from the checkpoint); the session's own settings come back."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    try:
        for k, v in STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def together(batches):
    """Rows of a key and shard with equal flags as one, within a task's Arrow batch."""
    for pdf in batches:
        yield pdf.groupby(["key", "shard", *FLAGS], dropna=False, sort=False)["row_idx"].agg(list).reset_index()[["key", "shard", *FLAGS, "row_idx"]]


def decide(key, parts, state):
    """Status of a key's rows: new up to the first shard that wrote the key, in this batch or before."""
    rows = pd.concat(list(parts))
    first = state.get[0] if state.exists else None
    wrote = rows.loc[rows["ok"].astype(bool), "shard"]
    if len(wrote):
        least = int(wrote.min())
        if first is None or least < first:
            first = least
            state.update((first,))
    new = pd.Series(True, rows.index) if first is None else rows["shard"] <= first
    force = rows["last"].astype(bool) & rows["truncated"].astype(bool)
    rows["status"] = new.map({True: "new", False: "dup"}).mask(~new & force, "force")
    rows["written"] = new & rows["ok"].astype(bool)
    yield rows


def classified(rows: DataFrame) -> DataFrame:
    """A stream of rows (key, shard, row_idx, ok, last, truncated) with status and written."""
    some = rows.select("key", "shard", "row_idx", *FLAGS).mapInPandas(together, TOGETHER)
    done = some.groupBy("key").applyInPandasWithState(decide, DECIDED, "first long", "append", "NoTimeout")
    return done.select("key", "shard", F.explode("row_idx").alias("row_idx"), *FLAGS, "status", "written")


def annotate_stream(rows: DataFrame, out: str, *, max_failed_rate: float, checkpoint: str, follow_seconds: int | None = None, name: str | None = None):
    """Starts the query: ``out/rows`` (status of every row) and ``out/failed`` by batch.  A batch over the failure limit writes its
    failures, then stops the query with nothing else written; its keys do not enter the state, as its version is never committed.
    Counts by status are observed, for a listener such as ``progress.StatusFile`` of the query's ``name``."""

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = f"{out}/pending/{number}"
        batch.write.mode("overwrite").parquet(place)  # the state operator runs once
        done = spark.read.schema(batch.schema).parquet(place)
        overwrite = lambda df, name: df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
        overwrite(done.where("not ok and status <> 'dup'"), "failed")
        gate = dataset.failure_gate(done, max_rate=max_failed_rate).first()
        if not gate["accepted"]:
            raise RuntimeError(f"batch {number}: {gate['failed']} of {gate['asked']} failed")
        overwrite(done, "rows")
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    w = progress.observed_status(classified(rows)).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.queryName(name) if name else w
    with rocksdb(rows.sparkSession):
        return (w.trigger(processingTime=f"{follow_seconds} seconds") if follow_seconds else w.trigger(availableNow=True)).start()


def status_json(query) -> str:
    """Progress as JSON; the tokens are those that followers of the protocol expect."""
    state = "errore" if query.exception() else "in_corso" if query.isActive else "completato"
    return json.dumps({"stato": state, "batch": (query.lastProgress or {}).get("batchId"), "rows": (query.lastProgress or {}).get("numInputRows")})
