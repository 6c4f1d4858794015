"""Dataset construction: cross-shard status, corrected results, joins, splits, pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.functions import label
from rankfile.operators import permute, rank
from rankfile.operators.lineage import checkpoint


def looked_up(rows: DataFrame, keys: DataFrame, key: str, how: str = "inner", most: int = 200_000) -> DataFrame:
    """``rows`` joined to ``keys`` (one row a key), which is checkpointed and counted: up to ``most`` keys (some 20 MB of positions) are
    broadcast, so that the rows stay where they are; more are joined by shuffle, led by a hash, since positions begin alike."""
    keys = checkpoint(keys)
    if keys.count() <= most:
        return rows.join(F.broadcast(keys), key, how)
    lead = F.xxhash64(key)
    return rows.withColumn("_h", lead).join(keys.withColumn("_h", lead), ["_h", key], how).drop("_h")


def status(rows: DataFrame, *, key: str = "key", shard: str = "shard", ok: str = "ok", last: str = "last", truncated: str = "truncated") -> DataFrame:
    """new / force / dup of every row.  A key enters the state with the first shard that has a labelled row of it, so a row is new
    up to that shard; a seen key on the last row of a cut game is annotated for the correction only (force).  First shards are
    aggregated before the shuffle and joined back, so a key that is in every game is no hot window."""
    labelled = rows.select(key, F.when(F.col(ok), F.col(shard)).alias("_s"))  # no filter: it would keep windows below it alive
    out = looked_up(rows, labelled.groupBy(key).agg(F.min("_s").alias("_first")), key, "left").select(*rows.columns, "_first")
    new = F.col("_first").isNull() | (F.col(shard) <= F.col("_first"))
    out = out.withColumn("status", F.when(new, "new").when(F.col(last) & F.col(truncated), "force").otherwise("dup")).drop("_first")
    return out.withColumn("written", (F.col("status") == "new") & F.col(ok))


def with_last(rows: DataFrame, *game: str, order: str = "row_idx") -> DataFrame:
    return rows.withColumn("last", F.col(order) == F.max(order).over(W.partitionBy(*game)))


def first_seen(rows: DataFrame, key: str, *order: str, out: str = "first") -> DataFrame:
    """Flags the first row of each key in an order; rows alike in it are told apart by a hash of all their columns, and of rows alike
    in everything one is flagged.  First rows are aggregated before the shuffle and joined back, so that a key in every game is no hot
    window.  Nothing depends on how rows are dealt, so stages may run again."""
    columns = rows.columns
    at = F.struct(*order, F.xxhash64(*columns).alias("_x"), F.xxhash64(F.lit(1), *columns).alias("_y"))
    rows = rows.withColumn("_at", at)
    flagged = looked_up(rows, rows.groupBy(key).agg(F.min("_at").alias("_first")), key)
    hit = F.col("_at") == F.col("_first")
    alike = checkpoint(flagged.where(hit).groupBy(key).agg(F.count("*").alias("_c")).where("_c > 1"))  # keys whose first row comes twice
    if alike.isEmpty():
        return flagged.select(*columns, hit.alias(out))
    # one row stands for rows alike in everything, and gives one that is first and the rest that are not
    marked = looked_up(flagged, alike, key, "left")
    many = hit & F.col("_c").isNotNull()
    some = marked.where(many).dropDuplicates([key]).select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), "_c")).alias("_k"))
    return marked.where(~many).select(*columns, hit.alias(out)).unionByName(some.select(*columns, (F.col("_k") == 1).alias(out)))


def corrected(rows: DataFrame, *game: str, order: str = "row_idx") -> DataFrame:
    """``result`` of cut games from the evaluation of the game's last row, if it has one; of several last rows the one with the
    highest evaluation, then white to move, counts."""
    last = rows.groupBy(*game).agg(F.max(F.struct(order, "eval_cp", "white", "truncated")).alias("_l"))
    fixed = last.where(F.col("_l.truncated") & F.col("_l.eval_cp").isNotNull()).select(*game, label.result_of(F.col("_l.eval_cp"), F.col("_l.white")).alias("_r"))
    return rows.join(fixed, list(game), "left").withColumn("result", F.coalesce("_r", "result")).drop("_r")


def game_of(annotated: DataFrame, positions: DataFrame) -> DataFrame:
    """Game ids by (shard, fen); of several positions with one FEN the last wins (then the largest game id); unmatched rows keep null and
    can be counted.  Positions are aggregated and joined by 128 bits of hash, so that whole positions are not shuffled for the build."""
    name = lambda: [F.xxhash64("shard", "fen").alias("_h"), F.xxhash64(F.lit(1), "fen", "shard").alias("_g")]
    build = positions.groupBy(*name()).agg(F.max(F.struct("row_idx", "game_id"))["game_id"].alias("game_id"))
    return annotated.select("*", *name()).join(build, ["_h", "_g"], "left").drop("_h", "_g")


def failure_gate(rows: DataFrame, *, max_rate: float) -> DataFrame:
    """One row: failed, asked, rate, accepted; the limit itself is accepted."""
    out = rows.agg(F.count_if(~F.col("ok") & F.col("status").isin("new", "force")).alias("failed"), F.count_if(F.col("status").isin("new", "force")).alias("asked"))
    return out.withColumn("rate", label.share(F.col("failed"), F.col("asked"))).withColumn("accepted", F.col("rate") <= max_rate)


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def group_split(rows: DataFrame, key: str, *, fraction: float, seed: int) -> DataFrame:
    """Adds ``part``: max(1, round half even of n * fraction) groups, first in hash order, are val.  Only ids are ordered: a
    bucket of hash prefixes is counted, and the one that holds the cut is ranked."""
    ids = rows.select(key).distinct().withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, 3))
    n = ids.count()
    take = max(1, round(n * fraction))
    by = ids.groupBy("_b").count().orderBy("_b").collect()  # 4096 rows at most
    left, cut = take, None
    for r in by:
        if r["count"] >= left:
            cut = r["_b"]
            break
        left -= r["count"]
    inside = ids.where(F.col("_b") == cut).withColumn("_k", F.row_number().over(W.orderBy("_h", key))).where(F.col("_k") <= left).select(key)
    val = ids.where(F.col("_b") < (cut or "")).select(key).unionByName(inside).withColumn("part", F.lit("val"))
    return rows.join(val, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def placed(rows: DataFrame, keys: list[tuple[str, bool]], out: str, parts: int = 64) -> DataFrame:
    """Row numbers from 1 of an order by several keys (name, descending; numbers).  Rows are numbered within equal first keys and
    ranges of the third, or of the first alone where its values are many; places before a range come from counts."""
    order = [F.col(k).desc() if d else F.col(k).asc() for k, d in keys]
    first, second, third = (k for k, _ in keys[:3])
    cuts = sorted(set(rank.ranges_of(rows, third, parts)))
    ranged = rows.withColumn("_c", rank.below(cuts, F.col(third).cast("double")))
    sizes = ranged.groupBy(first, second, "_c").agg(F.count("*").alias("_n"))
    # counts of (first, second) pairs and ranges: few where the first keys are categories; a key of many values is ranged instead
    if sizes.count() > 100_000:
        cuts = sorted(set(rank.ranges_of(rows, first, 256)))  # as many as stay in generated code
        ranged = rows.withColumn("_c", rank.below(cuts, F.col(first).cast("double")))
        by, sizes = ["_c"], ranged.groupBy("_c").agg(F.count("*").alias("_n"))
        ahead = [F.col("_c").desc() if keys[0][1] else F.col("_c").asc()]
    else:
        by, ahead = [first, second, "_c"], [*order[:2], F.col("_c").desc() if keys[2][1] else F.col("_c").asc()]
    before = sizes.withColumn("_o", F.sum("_n").over(W.orderBy(*ahead)) - F.col("_n")).drop("_n")
    inner = ranged.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return inner.join(F.broadcast(before), by).withColumn(out, F.col("_o") + F.col("_k")).drop("_c", "_o", "_k")


def hash_numbered(rows: DataFrame, order: Column, out: str) -> DataFrame:
    """Row numbers from 1 in the order of a hex digest, by ranges of it: no task holds them all.  24 digits (96 bits) tell rows apart."""
    digits = lambda at: F.conv(F.substring("_h", at, 12), 16, 10).cast("long")
    return rank.numbered(rows.withColumn("_h", order).withColumns({"_hi": digits(1), "_lo": digits(13)}), "_hi", "_lo", out).drop("_h", "_hi", "_lo")


def slices_of(pool: DataFrame, order: Column, *, size: int, count: int) -> DataFrame:
    """Slices without replacement along an order (a hex digest, as ``hash_order`` gives); refuses a pool that is too small."""
    if pool.count() < size * count:
        raise ValueError("the pool is exhausted")
    taken = hash_numbered(pool, order, "_place").where(F.col("_place") <= size * count)
    return taken.withColumn("shard", F.floor((F.col("_place") - 1) / size).cast("long")).drop("_place")


def mixed(one: DataFrame, other: DataFrame, key: str, *, total: int, share: float) -> DataFrame:
    """round half even of total * share rows of the first, the rest of the second, each the first in its hash order; ``kind`` tells
    them apart.  Rows are numbered by ranges, so a mix may be as large as a dataset."""
    n = round(total * share)
    digest = lambda mark: F.md5(F.concat(F.lit(mark), F.col(key).cast("string")))
    take = lambda df, mark, k, kind: hash_numbered(df, digest(mark), "_place").where(F.col("_place") <= k).drop("_place").withColumn("kind", F.lit(kind))
    return take(one, "a", n, "endgame").unionByName(take(other, "b", total - n, "normal"))


def complete_shards(rows: DataFrame, results: DataFrame, shard: str, key: str) -> DataFrame:
    """(shard, n, missing, accepted): one row without a result discards its shard, which then counts as pending again."""
    found = rows.join(results.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    missing = F.count_if(F.col("_has").isNull())
    return found.groupBy(shard).agg(F.count("*").alias("n"), missing.alias("missing"), (missing == 0).alias("accepted"))


def exhaustive(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of the three statuses, and whether they are all there is."""
    parts = [F.count_if(F.col("status") == s).alias(s) for s in ("new", "force", "dup")]
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *parts)
    return out.withColumn("exhaustive", F.col("new") + F.col("force") + F.col("dup") == F.col("n"))


def vectors(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both on their common keys; a key that comes twice on either side is refused."""
    for side in (left, right):
        if not side.groupBy(key).count().where("count > 1").isEmpty():
            raise ValueError(f"{key} is not unique")
    return left.join(right, key)


def zipped(left: DataFrame, right: DataFrame, place: str) -> DataFrame:
    """Rows joined by their places; unlike lengths are refused."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} and {b} rows")
    return left.join(right, place)


def merged(parts: list[DataFrame], keys: list[str], out: str) -> DataFrame:
    """The parts of several workers as one, numbered in the order of the keys (numbers)."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return placed(every, [(k, False) for k in keys], out)


def seeded_split(rows: DataFrame, key: str, order: str, *, fraction: float, seed: int) -> DataFrame:
    """The split of the published datasets: Python's seeded shuffle of the ids in order of first appearance, the first share of
    them val; then the same generator shuffles the train rows, which lie id by id.  Adds ``part`` and ``place`` (null for val).
    The generator's numbers are drawn again by blocks in tasks and the swaps followed by joins (``permute.shuffled``), so the
    driver holds no ids or rows."""
    import random

    rng = random.Random(seed)
    groups = checkpoint(rank.numbered(rows.groupBy(key).agg(F.min(order).alias("_first")), "_first", key, "_g"))
    n = groups.count()
    take = max(1, round(n * fraction))
    val = permute.shuffled(rows.sparkSession, n, rng).where(F.col("place") < take).select((F.col("number") + 1).alias("_g"), F.lit("val").alias("part"))
    groups = groups.join(val, "_g", "left").select(key, "_first", F.coalesce("part", F.lit("train")).alias("part"))
    dealt = checkpoint(rows.join(groups, key))
    train = placed(dealt.where("part = 'train'"), [("_first", False), (order, False), (key, False)], "_at")
    places = permute.shuffled(rows.sparkSession, dealt.where("part = 'train'").count(), rng).select((F.col("number") + 1).alias("_at"), "place")
    out = train.join(places, "_at").drop("_at", "_first")
    return out.unionByName(dealt.where("part = 'val'").drop("_first").withColumn("place", F.lit(None).cast("long")))


def extend_pool(base: DataFrame, extension: DataFrame, key: str, *, seed: int) -> DataFrame:
    """The base keeps its places; new keys, each once, follow in hash order."""
    new = extension.dropDuplicates([key]).join(base.select(key), key, "left_anti").withColumn("epoch", F.lit(1))
    return base.withColumn("epoch", F.lit(0)).unionByName(new, allowMissingColumns=True).withColumn("order_key", hash_order(F.col(key), seed))


def bag_difference(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    return left.select(*key).exceptAll(right.select(*key))
