"""Blocked Bloom filters as tables, for membership against a large state.

A filter is a table of blocks (block, w0 to w7) of eight 64-bit words.  A key belongs to one block and sets one bit in each of its
words; blocks are combined by bitwise or, so filters are built by a partial aggregation in each task, and filters of parts (shards,
days) are merged the same way.  Probing is a join with the broadcast blocks, in generated code.  Hashes are taken from the MD5 digest
of the key as text, so a filter that was written down stays valid.

``unseen`` and ``seen`` put a filter of the batch's keys before the exact join, so of the state little more than the rows that match
reaches the shuffle.  A filter is broadcast only up to ``most`` blocks (some 80 bytes each); a batch with more keys than that takes
the exact join alone."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BITS = 8, 64
MOST_BLOCKS = 400_000  # some 32 MB


def expected_rate(load: float) -> float:
    """False positives of blocks that hold ``load`` keys on average."""
    rate, p = 0.0, math.exp(-load)
    for c in range(1, int(load + 12 * math.sqrt(load) + 20)):
        p *= load / c
        rate += p * (1 - (1 - 1 / BITS) ** c) ** WORDS
    return rate


def load_for(rate: float) -> int:
    """The most keys a block may hold on average for a rate of false positives."""
    load = 1
    while expected_rate(load + 1) <= rate:
        load += 1
    return load


def blocks_for(keys: int, rate: float) -> int:
    return max(1, -(-keys // load_for(rate)))


def places(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """(block, bit of each word) of a key: the block from the first 60 bits of its digest, the bits from 48 more."""
    digest = F.md5(key.cast("string").cast("binary"))
    number = lambda at, size: F.conv(F.substring(digest, at, size), 16, 10).cast("long")
    rest = number(16, 12)
    return number(1, 15) % blocks, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(rest, 6 * w).bitwiseAND(F.lit(BITS - 1)).cast("int")) for w in range(WORDS)]


def built(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of a column's values (nulls are in none)."""
    block, bits = places(F.col(key), blocks)
    rows = keys.where(F.col(key).isNotNull()).select(block.alias("block"), *(b.alias(f"w{w}") for w, b in enumerate(bits)))
    return combined(rows)


def combined(rows: DataFrame) -> DataFrame:
    return rows.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of the union of the keys; all must have the same number of blocks."""
    return combined(reduce(DataFrame.unionByName, filters))


def passing(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows whose key may be in the filter; all that are in it are among them."""
    block, bits = places(F.col(key), blocks)
    some = filter_.select(F.col("block").alias("_block"), *(F.col(f"w{w}").alias(f"_w{w}") for w in range(WORDS)))
    near = rows.withColumn("_b", block).join(F.broadcast(some), F.col("_b") == F.col("_block"))
    held = reduce(Column.__and__, (F.col(f"_w{w}").bitwiseAND(b) != 0 for w, b in enumerate(bits)))
    return near.where(held).select(*rows.columns)


def reduced(state: DataFrame, rows: DataFrame, key: str, *, rate: float = 0.01, most: int = MOST_BLOCKS) -> DataFrame:
    """Of the state's keys those that the rows may ask for."""
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct()
    blocks = blocks_for(keys.count(), rate)
    return state.select(key) if blocks > most else passing(state.select(key), key, built(keys, key, blocks), blocks)


def unseen(rows: DataFrame, state: DataFrame, key: str, **how) -> DataFrame:
    """Rows whose key the state does not hold (rows without a key among them): the exact anti-join behind a filter."""
    return rows.join(reduced(state, rows, key, **how), key, "left_anti")


def seen(rows: DataFrame, state: DataFrame, key: str, **how) -> DataFrame:
    return rows.join(reduced(state, rows, key, **how), key, "left_semi")
