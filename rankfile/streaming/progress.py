"""Counters beside a result, without another pass: observed metrics, and a listener that keeps a status file."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

METRICS = "status"


def first_failed(rules: dict[str, Column]) -> Column:
    """The name of the first rule that drops a row, null for one that stays (a rule that gives null drops nothing)."""
    cases = [F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]
    return F.coalesce(*cases) if len(cases) > 1 else cases[0]


def kept(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """The rows that no rule drops, and what was dropped by which: ``observation.get`` has n_rows, n_kept and a count for each rule as
    soon as an action on the rows has run.  Rules are tried in order, a row counts for the first."""
    seen = Observation("dropped")
    marked = rows.withColumn("_drop", first_failed(rules))
    counts = [F.count("*").alias("n_rows"), F.count_if(F.col("_drop").isNull()).alias("n_kept"), *(F.count_if(F.col("_drop") == name).alias(name) for name in rules)]
    return marked.observe(seen, *counts).where(F.col("_drop").isNull()).drop("_drop"), seen


def observed_status(rows: DataFrame) -> DataFrame:
    """Classified rows with the counts that the status file holds."""
    return rows.observe(METRICS, F.count("*").alias("n_input"), F.count_if("written").alias("n_written"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "force", "dup")), F.count_if(~F.col("ok") & (F.col("status") != "dup")).alias("n_failed"))


def replace_file(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file whole: readers see the old one or the new one."""
    jvm = spark._jvm
    place, hidden = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    conf = spark._jsc.hadoopConfiguration()
    out = place.getFileSystem(conf).create(hidden, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(hidden, place, over)


class StatusFile(StreamingQueryListener):
    """Keeps a JSON file up to date for queries of one name: state, batches, counts so far, the last batch's rate and the last error.
    The names of state and values are those that followers of the protocol expect."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name, self.run = spark, path, name, None
        self.totals: dict[str, int] = {}
        self.batches = 0

    def put(self, state: str, **more) -> None:
        replace_file(self.spark, self.path, json.dumps({"stato": state, "batch": self.batches, **self.totals, **more, "updated_at": datetime.now(UTC).isoformat()}, indent=2))

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId
            self.put("in_corso", pos_per_sec=0.0, ultimo_errore=None)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.runId != self.run:
            return
        seen = p.observedMetrics.get(METRICS)
        if seen is not None:
            self.batches += 1
            for k, v in seen.asDict().items():
                self.totals[k] = self.totals.get(k, 0) + (v or 0)
        self.put("in_corso", pos_per_sec=round(p.processedRowsPerSecond or 0.0, 1), ultimo_errore=None)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.put("errore" if event.exception else "completato", pos_per_sec=0.0, ultimo_errore={"messaggio": event.exception.splitlines()[0]} if event.exception else None)


def hear_out(spark: SparkSession) -> None:
    """Waits until listeners have heard of all that has happened."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

