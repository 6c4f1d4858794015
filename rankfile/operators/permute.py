"""Seeded permutations by arithmetic: the place of a row, and the row of a place, from its number alone.

Numbers under n are written as (left, right) in a grid of about sqrt(n) by sqrt(n); rounds add a keyed hash of one half to the other,
which can be undone (a Feistel network over remainders).  The grid has fewer than sqrt(n) + 1 cells beyond n; a number that falls
there is sent through again until it is under n (cycle walking).  How often that can happen is found beforehand by following those
few cells.  Nothing is sorted, collected or broadcast, a row's place does not depend on other rows, and a lost task gives it again."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.operators import rank
from rankfile.operators.lineage import checkpoint

ROUNDS = 4
# Fixed values of the keyed hash: two odd multipliers under 2**31, so that products stay under 2**62.
M, ONE, TWO = 2**31, 1597334677, 1181783497


def hashed(x, key: int, size: int, div):
    """A keyed hash of x (under 2**31) under ``size``."""
    return div(div(((x + key) % M) * ONE, 2**16) % M * TWO, 2**13) % size


@dataclass(frozen=True)
class Permutation:
    n: int
    seed: int

    @property
    def rows(self) -> int:
        return max(1, math.isqrt(max(0, self.n - 1)) + 1)

    @property
    def columns(self) -> int:
        return max(1, -(-self.n // self.rows))

    @property
    def keys(self) -> list[int]:
        return [int.from_bytes(hashlib.sha256(f"{self.seed}:{i}".encode()).digest()[:4], "big") % M for i in range(2 * ROUNDS)]

    def once(self, x: np.ndarray) -> np.ndarray:
        left, right = x // self.columns, x % self.columns
        for i in range(ROUNDS):
            left = (left + hashed(right, self.keys[2 * i], self.rows, np.floor_divide)) % self.rows
            right = (right + hashed(left, self.keys[2 * i + 1], self.columns, np.floor_divide)) % self.columns
        return left * self.columns + right

    def walks(self) -> int:
        """How often a number under n is sent through at most.  Cells beyond n that lead round to themselves are never reached."""
        out, start = 1, np.arange(self.n, self.rows * self.columns, dtype=np.int64)
        at = start
        while len(at):
            out += 1
            at = self.once(at)
            on = (at >= self.n) & (at != start)
            at, start = at[on], start[on]
        return out


def sent_through(number: Column, p: Permutation, inverse: bool) -> Column:
    """``number`` sent through until it is under n, as one fold over the half rounds of all passes."""
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    long = lambda v: F.lit(v).cast("long")
    halves = [(key, i % 2 == 0) for i, key in enumerate(p.keys)]
    if inverse:
        halves.reverse()
    # before a later pass a number under n is done
    steps = [F.struct(long(key).alias("key"), long(p.rows if left else p.columns).alias("size"), F.lit(left).alias("left"), F.lit(again > 0 and not i).alias("ask")) for again in range(p.walks()) for i, (key, left) in enumerate(halves)]
    value = lambda s: s["x"] * long(p.columns) + s["y"]

    def step(s, k):
        done = s["done"] | (k["ask"] & (value(s) < long(p.n)))
        h = hashed(F.when(k["left"], s["y"]).otherwise(s["x"]), k["key"], k["size"], div)
        moved = (F.when(k["left"], s["x"]).otherwise(s["y"]) + (k["size"] - h if inverse else h)) % k["size"]
        return F.struct(F.when(~done & k["left"], moved).otherwise(s["x"]).alias("x"), F.when(~done & ~k["left"], moved).otherwise(s["y"]).alias("y"), done.alias("done"))

    return F.aggregate(F.array(*steps), F.struct(div(number, p.columns).alias("x"), (number % long(p.columns)).alias("y"), F.lit(False).alias("done")), step, value)


def permuted(df: DataFrame, number: str, n: int, *, seed: int, out: str = "place", inverse: bool = False) -> DataFrame:
    """Adds ``out``: the place (from 0) of the row numbers (from 0, under n) in ``number``; with ``inverse`` the row of a place."""
    p = Permutation(n, seed)
    if p.rows > M:
        raise ValueError(f"{n} rows are more than 2**62")
    return df.withColumn(out, sent_through(F.col(number).cast("long"), p, inverse))


def shuffled_pool(base: DataFrame, extension: DataFrame, key: str, *, seed: int) -> DataFrame:
    """(key, epoch, place): the base's keys in a seeded order, the extension's new keys behind them in an order of their own, so that
    the base keeps its places.  ``key`` is a number."""
    first = base.select(key).distinct()
    new = extension.select(key).distinct().join(first, key, "left_anti")
    n, m = first.count(), new.count()
    one, two = (permuted(rank.numbered(df, key, key, "_at").withColumn("_at", F.col("_at") - 1), "_at", size, seed=s) for df, size, s in ((first, n, seed), (new, m, seed + 1)))
    return one.select(key, F.lit(0).alias("epoch"), "place").unionByName(two.select(key, F.lit(1).alias("epoch"), (F.col("place") + n).alias("place")))


def permuted_split(rows: DataFrame, key: str, order: str, *, fraction: float, seed: int) -> DataFrame:
    """Adds ``part`` and ``place``: groups, numbered by first appearance, are permuted and the first share of them is val (one at
    least); the train rows, numbered group by group, are permuted again (place is null for val).  ``order`` and ``key`` are numbers,
    and ``order`` tells rows apart.  The same scheme as a seeded shuffle, without one."""
    from rankfile.operators import dataset

    groups = rows.groupBy(key).agg(F.min(order).alias("_first"))
    groups = rank.numbered(groups, "_first", key, "_g").withColumn("_g", F.col("_g") - 1)
    n = groups.count()
    take = max(1, round(n * fraction))
    groups = permuted(groups, "_g", n, seed=seed, out="_p").withColumn("part", F.when(F.col("_p") < take, "val").otherwise("train"))
    dealt = rows.join(groups.select(key, "_first", "part"), key)
    train = dataset.placed(dealt.where("part = 'train'"), [("_first", False), (order, False), (key, False)], "_at").withColumn("_at", F.col("_at") - 1)
    train = permuted(train, "_at", train.count(), seed=seed + 1).drop("_at", "_first")
    return train.unionByName(dealt.where("part = 'val'").drop("_first").withColumn("place", F.lit(None).cast("long")))


def draws(rng: random.Random, high: int, low: int, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): the numbers that ``rng.shuffle`` draws for the places i, i - 1, ... from ``high`` down to ``low`` (1 at least), in pieces.
    A number for place i is the upper bits of a word, drawn again until it is i at most.  No word is drawn too many: a piece
    takes no more words than places are left under one number of bits."""
    while high >= low:
        bits = (high + 1).bit_length()
        left = min(most, high - max(low, (1 << (bits - 1)) - 1) + 1)
        if bits > 32:  # two words a number
            js = np.array([rng.randrange(i + 1) for i in range(high, high - left, -1)], np.int64)
        else:
            r = np.frombuffer(rng.getrandbits(32 * left).to_bytes(4 * left, "little"), "<u4").astype(np.int64) >> (32 - bits)
            taken = r <= high
            while True:  # a number is taken or not by how many were before it; each round settles one more at least
                again = r <= high - (np.cumsum(taken) - taken)
                if (again == taken).all():
                    break
                taken = again
            js = r[taken]
        if len(js):
            yield high, js
        high -= len(js)


def shuffled(spark: SparkSession, n: int, rng: random.Random, block: int = 1 << 20) -> DataFrame:
    """(place, number): ``rng.shuffle`` of the numbers under n; place and number start at 0.  ``rng`` ends where the shuffle leaves it.

    The driver runs through the generator once, in bounded memory, and keeps its state at every ``block`` places (2.5 KB each); tasks
    draw a block's numbers again.  Place i swaps with j_i, from the last place down.  What stands in p when its turn comes is what
    stood in the last place that swapped with p before, the smallest i > p with j_i = p, when that one's turn came, or p itself; so
    sources are found by doubling steps along these links, whose chains are some log n long, and i ends with the source of the next
    larger place that drew the same number."""
    blocks = []
    for high in range(n - 1, 0, -block):
        low = max(1, high - block + 1)
        blocks.append((high, low, np.array(rng.getstate()[1], np.uint32).tobytes()))
        for _ in draws(rng, high, low):
            pass
    if n < 2:
        return spark.range(n).select(F.col("id").alias("place"), F.col("id").alias("number"))

    def run(batches):
        for b in batches:
            for high, low, state in zip(b.column("high").to_pylist(), b.column("low").to_pylist(), b.column("state").to_pylist(), strict=True):
                own = random.Random()
                own.setstate((3, tuple(np.frombuffer(state, np.uint32).tolist()), None))
                for i, js in draws(own, high, low):
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i - len(js), -1)), pa.array(js)], ["i", "j"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (4 * block)))
    drawn = spark.createDataFrame(blocks, "high long, low long, state binary").repartition(min(len(blocks), parts)).mapInArrow(run, "i long, j long")
    drawn = drawn.unionByName(spark.range(1).select(F.col("id").alias("i"), F.col("id").alias("j")))  # the first place draws nothing
    drawn = checkpoint(drawn.withColumn("next", F.lead("i").over(W.partitionBy("j").orderBy("i"))))
    # links of places that have one, each to a larger place
    up = checkpoint(drawn.where("i <> j").groupBy(F.col("j").alias("p")).agg(F.min("i").alias("up")))
    while True:
        further = up.join(up.select(F.col("p").alias("up"), F.col("up").alias("_u")), "up", "left")
        moved = checkpoint(further.select("p", F.coalesce("_u", "up").alias("up"), F.col("_u").isNotNull().alias("_m")))
        up = moved.drop("_m")
        if moved.where("_m").isEmpty():
            break
    out = drawn.join(up.select(F.col("p").alias("next"), "up"), "next", "left")
    return out.select(F.col("i").alias("place"), F.coalesce("up", "next", "j").alias("number"))
