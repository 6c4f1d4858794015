"""Reports, gates and verdicts as aggregations over DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.functions import label
from rankfile.operators import rank


def share(condition: Column) -> Column:
    """Aggregate: the share of rows that meet a condition."""
    return F.avg(condition.cast("double"))


def errors(x: Column, y: Column) -> dict[str, Column]:
    """Aggregates of x against y: bias, mean absolute and root mean square error."""
    d = x - y
    return {"bias": F.avg(d), "mae": F.avg(F.abs(d)), "rmse": F.sqrt(F.avg(d * d))}


def errors_by(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """(by, n, bias, mae, rmse, rho) of x against y, by budget or class: errors and rank correlation from two passes."""
    d = F.col(x) - F.col(y)
    out = rank.profile(rows, (by,), {}, pair=(x, y), sums={"_d": d, "_a": F.abs(d), "_s": d * d})
    return out.select(by, "n", (F.col("_d") / F.col("n")).alias("bias"), (F.col("_a") / F.col("n")).alias("mae"), F.sqrt(F.col("_s") / F.col("n")).alias("rmse"), "rho")


def point_of_view(rows: DataFrame, *, white: str, material: str, cp: str, least: int = 400) -> DataFrame:
    """Whether evaluations are seen by White: with much material ahead they agree with it for White to move and for Black."""
    s = rows.where((F.abs(material) >= least) & (F.col(cp) != 0))
    agree = (F.col(material) > 0) == (F.col(cp) > 0)
    one = s.agg(F.count_if(F.col(white)).alias("n_white"), F.count_if(~F.col(white)).alias("n_black"), F.avg(F.when(F.col(white), agree.cast("double"))).alias("white_agree"), F.avg(F.when(~F.col(white), (~agree).cast("double"))).alias("black_contrast"))
    return one.withColumn("accepted", (F.col("n_white") > 50) & (F.col("n_black") > 50) & (F.col("white_agree") > 0.7) & (F.col("black_contrast") > 0.4))


def stop_unless(gate: DataFrame) -> DataFrame:
    """The gate's row, if it accepts; an error, if not."""
    row = gate.first()
    if not row["accepted"]:
        raise ValueError(f"gate failed: {row.asDict()}")
    return gate


def predictor_losses(rows: DataFrame, target: Column, predictor: Column, *, most: float = 1.5) -> DataFrame:
    """Mean squared error of a constant, of a simple predictor and of an untrained network; the last must be near the first."""
    loss = lambda p: F.avg((p - target) * (p - target))
    out = rows.agg(F.var_pop(target).alias("constant_loss"), loss(predictor).alias("material_loss"), loss(F.lit(0.5)).alias("untrained_loss"))
    return out.withColumn("accepted", F.col("untrained_loss") <= most * F.col("constant_loss"))


def elo(rows: DataFrame, pair: str, *, won: str, lost: str, drawn: str) -> DataFrame:
    """Elo differences with 95 % intervals by pair, their inverse-variance combination, the error of a chain of them, and the upper
    bound of a rate of which no case was seen; the likelihood that the first side is the stronger."""
    n = F.col(won) + F.col(lost) + F.col(drawn)
    p = (F.col(won) + 0.5 * F.col(drawn)) / n
    v = (F.col(won) + 0.25 * F.col(drawn)) / n - p * p
    s = rows.select(pair, n.alias("n"), superiority(F.col(won), F.col(lost)).alias("superiority"), (-400 * F.log10(1 / p - 1)).alias("elo"), (400 / F.log(F.lit(10.0)) * F.sqrt(v / n) / (p * (1 - p))).alias("se"))
    every = s.agg((F.sum(F.col("elo") / F.col("se") ** 2) / F.sum(1 / F.col("se") ** 2)).alias("combined"), F.sqrt(F.sum(F.col("se") ** 2)).alias("chain_se"))
    return s.crossJoin(F.broadcast(every)).withColumns({"low": F.col("elo") - 1.96 * F.col("se"), "high": F.col("elo") + 1.96 * F.col("se"), "zero_event_bound": zero_events(F.col("n"))})


def normal(z: Column) -> Column:
    """The normal distribution function, by a rational approximation that is off by 2e-7 at most (Abramowitz and Stegun 7.1.26)."""
    # Fixed values of the approximation.
    a = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    tail = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4])))) * F.exp(-x * x) / 2
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def superiority(won: Column, lost: Column) -> Column:
    """The likelihood that the side that won the more games is the stronger, drawn games apart; a half where none was decided."""
    return F.coalesce(normal(F.try_divide((won - lost).cast("double"), F.sqrt((won + lost).cast("double")))), F.lit(0.5))


def zero_events(n: Column) -> Column:
    """95 % upper bound of the rate of an event not seen in n cases."""
    return 1 - F.pow(F.lit(0.05), 1 / n)


def inheritance(rows: DataFrame, master: str, students: list[str], others: list[str]) -> DataFrame:
    """Whether students follow their master: each correlates with it more than with any other, by more than the students differ."""
    own = {s: F.corr(s, master) for s in students}
    r = rows.agg(*(c.alias(f"m_{s}") for s, c in own.items()), *(F.corr(s, o).alias(f"o_{s}_{o}") for s in students for o in others))
    floor = F.greatest(*(F.col(f"m_{s}") for s in students)) - F.least(*(F.col(f"m_{s}") for s in students))
    held = F.lit(True)
    for s in students:
        for o in others:
            held = held & (F.col(f"m_{s}") - F.col(f"o_{s}_{o}") > floor)
    return r.select(*(F.col(f"m_{s}") for s in students), floor.alias("floor_"), held.alias("sustained"))


def best_epoch(epochs: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """The epoch of least loss of each run, the first of equal ones."""
    return epochs.groupBy(run).agg(F.min(F.struct(loss, epoch)).alias("_b")).select(run, F.col(f"_b.{epoch}").alias(epoch), F.col(f"_b.{loss}").alias(loss))


def early_stop(epochs: DataFrame, run: str, epoch: str, loss: str, *, patience: int) -> DataFrame:
    """Epochs since the last improvement, and whether patience is at an end.  A run's epochs are few and sit in one window."""
    w = W.partitionBy(run).orderBy(epoch)
    better = F.col("_before").isNull() | (F.col(loss) < F.col("_before"))
    out = epochs.withColumn("_before", F.min(loss).over(w.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("_last", F.max(F.when(better, F.col(epoch))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    since = F.col(epoch) - F.col("_last")
    return out.select(run, epoch, since.alias("since_best"), (since >= patience).alias("stops"))


def failures(given: DataFrame, written: DataFrame, log: DataFrame, shard: str, key: str) -> DataFrame:
    """Failed rows by shard, rebuilt as the bag of given keys less that of written ones, and whether the log counts as many."""
    count = lambda df, out: df.groupBy(shard, key).agg(F.count("*").alias(out))
    both = count(given, "_g").join(count(written, "_w"), [shard, key], "left")
    lost = F.greatest(F.col("_g") - F.coalesce("_w", F.lit(0)), F.lit(0))
    by = both.groupBy(shard).agg(F.sum("_g").alias("n_input"), F.sum(lost).alias("n_failed"))
    return by.join(log, shard, "left").withColumn("matches_log", F.coalesce("n_log", F.lit(0)) == F.col("n_failed")).drop("n_log")


def owners(rows: DataFrame, key: str, shard: str, order: str) -> DataFrame:
    """The shard that wrote each key first, and the order in which shards were worked on, from the first rows they own."""
    first = rows.groupBy(key).agg(F.min(F.struct(order, shard)).alias("_f"))
    by = first.groupBy(F.col(f"_f.{shard}").alias(shard)).agg(F.min(f"_f.{order}").alias("first_pos"), F.count("*").alias("keys"))
    return by.withColumn("processing_rank", (F.dense_rank().over(W.partitionBy().orderBy("first_pos")) - 1).cast("long"))  # a row a shard


def worst_sums(rows: DataFrame, by: str, weight: Column, *, active: int = 32, most: int = 32767) -> DataFrame:
    """The largest sum that ``active`` weights of a column can reach.  Each task keeps the largest of its rows, so that a long column
    is no hot key."""
    part = rows.select(by, weight.cast("double").alias("_w"))
    near = part.withColumn("_t", F.spark_partition_id()).withColumn("_k", F.row_number().over(W.partitionBy(by, "_t").orderBy(F.col("_w").desc()))).where(F.col("_k") <= active)
    last = near.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(F.col("_w").desc()))).where(F.col("_k") <= active)
    return last.groupBy(by).agg(F.sum("_w").alias("worst")).withColumn("overflows", F.col("worst") > most)


def tails(rows: DataFrame, by: str, gap: str, limits: tuple[int, ...]) -> DataFrame:
    """Shares of rows and of squared error above limits (tenths)."""
    g, out = F.col(gap), []
    for t in limits:
        out += [share(g > t / 10).alias(f"over_{t}"), (F.sum(F.when(g > t / 10, g * g).otherwise(0.0)) / F.sum(g * g)).alias(f"error_{t}")]
    return rows.groupBy(by).agg(*out)


def equal_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether both hold the same keys, and how many they share."""
    both = left.select(key).distinct().withColumn("_l", F.lit(1)).join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full")
    return both.agg((F.count_if(F.col("_l").isNull() | F.col("_r").isNull()) == 0).alias("equal_sets"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("common"))


def pair_matrix(values: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Correlation of every pair of series on their common keys."""
    a = values.select(F.col(name).alias("label_a"), key, F.col(value).alias("_x"))
    b = values.select(F.col(name).alias("label_b"), key, F.col(value).alias("_y"))
    return a.join(b, key).where("label_a < label_b").groupBy("label_a", "label_b").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("r"))


def running_index(rows: DataFrame, by: str, order: list[str], counts: Column, out: str) -> DataFrame:
    """Adds the number of counted rows up to each row, from 0, within a group of a bounded size (a game)."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(out, F.sum(counts.cast("int")).over(w) - 1)


def origins(rows: DataFrame, steps: list[tuple[DataFrame, str, str]], name: str) -> DataFrame:
    """Rows followed through a chain of lookups (table, column here, column there); what is not found is ``unmatched``."""
    for table, here, there in steps:
        rows = rows.join(table, F.col(here) == F.col(there), "left")
    return rows.withColumn("origin", F.coalesce(name, F.lit("unmatched")))


def clamped(x: Column, limit: int = 2000) -> Column:
    return label.clamp(x, limit)


def class_filter(share: Column, own: float, held: float) -> Column:
    """The share of squared error that dropping a share of the rows is expected to remove when a class goes first: in proportion up
    to the class's own share, where it has removed what the class holds, and in proportion to the rest beyond."""
    return F.when(share <= own, share / own * held).otherwise(held + (share - own) / (1 - own) * (1 - held))
