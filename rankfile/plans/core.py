"""How queries are declared: a Spark function with independent SQL for DuckDB beside it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Dialect:
    """Functions as DuckDB names them."""

    spark = False

    def quantile(self, x: str, q: float) -> str:
        return f"quantile_cont({x}, {q})"

    def half_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def double(self, x: str) -> str:
        return f"cast({x} as double)"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def capture(self, x: str, pattern: str, n: int) -> str:
        return f"regexp_extract({x}, '{pattern}', {n})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for what a query writes: in spark.checkpoint.dir, which all machines share; a local session without one gets a
    temporary folder, removed at its end, and a cluster without one is refused."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/rankfile-{name}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix=f"rankfile-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def tables_of(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs SQL over the named tables, bound as parameters so that no view outlives the query."""
    names = tables_of(sql)
    text = re.sub(rf"\b({'|'.join(names)})\b(?!\.)", r"{\1}", sql) if names else sql
    return spark.sql(text, **{t: load(spark, sf_dir, t) for t in names})


def oracle(name: str):
    """Registers ``f(dialect) -> sql`` as the SQL of a query that is written with the library's functions elsewhere."""

    def add(f):
        ORACLE[name] = f(Dialect())
        return f

    return add


def query(name: str, oracle: str | None = None):
    """Registers ``f(spark, sf_dir) -> DataFrame``, with independent SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return add
