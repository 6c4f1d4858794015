"""Additive hashes of multisets of rows: two 64-bit lanes of a row's MD5 digest, each summed modulo 2**64.

Sums do not depend on order or on how rows are dealt, and parts are merged by adding, so a table's hash is one partial aggregation;
tables that differ in one element of one row differ in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANE = 2**64


def text_of(*columns: Column) -> Column:
    """Columns as one text that tells null from empty and one column's end from the next one's begin."""
    one = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat_ws("|", *(one(c) for c in columns))


def added(lane: Column) -> Column:
    """Aggregate: the sum of a lane (numbers under 2**64, as decimals); exact up to 10**18 rows."""
    return (F.sum(lane) % F.lit(str(LANE)).cast("decimal(20,0)")).cast("decimal(20,0)")


def hashed(rows: DataFrame, *columns: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, high, low): the hash of the multiset of rows, by key or over the whole table."""
    digest = F.md5(text_of(*columns).cast("binary"))
    lane = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    lanes = rows.select(*by, lane(1).alias("_h"), lane(17).alias("_l"))
    facts = [F.count("*").alias("n"), added(F.col("_h")).alias("high"), added(F.col("_l")).alias("low")]
    return lanes.groupBy(*by).agg(*facts) if by else lanes.agg(*facts)


def merged(hashes: DataFrame, *by: str) -> DataFrame:
    """The hashes of parts added up."""
    facts = [F.sum("n").alias("n"), added(F.col("high")).alias("high"), added(F.col("low")).alias("low")]
    return hashes.groupBy(*by).agg(*facts) if by else hashes.agg(*facts)


def unequal(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Keys whose multisets differ, those of one side alone among them."""
    a = left.select(*by, F.struct("n", "high", "low").alias("_a"))
    return a.join(right.select(*by, F.struct("n", "high", "low").alias("_b")), list(by), "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*by)
