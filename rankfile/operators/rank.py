"""Tie-averaged ranks, rank correlation, exact quantiles and bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.operators.lineage import checkpoint


def ranges_of(df: DataFrame, value: str, parts: int) -> list[float]:
    """Cuts of ``value`` (a number) in some ``parts`` ranges of about as many rows; a value that fills ranges is repeated."""
    at = F.array(*(F.lit(i / parts) for i in range(1, parts)))
    found = df.where(F.col(value).isNotNull()).agg(F.percentile_approx(F.col(value).cast("double"), at, F.lit(1_000))).first()[0]
    return sorted(found or [])


def below(cuts: list[float], value: Column) -> Column:
    """How many of the sorted cuts lie below the value: the number of its range.  A tree of comparisons, which stays in generated
    code; too many cuts for that are counted."""
    if len(cuts) > 256:
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < value))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value > cuts[mid], tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def numbered(df: DataFrame, value: str, tie: str, out: str = "k", *, by: tuple[str, ...] = (), descending: bool = False, parts: int = 64) -> DataFrame:
    """Adds the row number from 1 of the order (value, tie) within ``by``; ``tie`` (a number) must tell equal values apart.  Rows are
    numbered within ranges of the value, and within ranges of the tie where one value fills a range, and each range starts where the
    ranges before it end: no task orders all rows, nor all rows of a class.  Nulls come last."""
    cuts = ranges_of(df, value, parts)
    often = sorted({c for c, d in zip(cuts, cuts[1:], strict=False) if c == d})
    ties = ranges_of(df, tie, parts) if often else []
    v = F.col(value).cast("double")
    sign = -1 if descending else 1
    same = F.coalesce(v.isin(often), F.lit(False)) if often else F.lit(False)
    place = F.when(v.isNull(), F.lit(10**6)).otherwise(sign * (2 * below(sorted(set(cuts)), v) + same.cast("int")))
    rows = df.withColumns({"_b": place, "_s": F.when(same, below(sorted(set(ties)), F.col(tie).cast("double"))).otherwise(0)})
    # parts ** 2 rows a class at most
    sizes = rows.groupBy(*by, "_b", "_s").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_o", F.sum("_n").over(W.partitionBy(*by).orderBy("_b", "_s")) - F.col("_n")).drop("_n")
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    keys = [F.col(c) for c in (*by, "_b", "_s")]
    inner = rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(order, tie)))
    # few rows without classes; with them as many as the classes, which Spark judges by their size
    return inner.join(before if by else F.broadcast(before), [*by, "_b", "_s"]).withColumn(out, F.col("_o") + F.col("_k")).drop("_b", "_s", "_k", "_o")


def running(df: DataFrame, order: str, amount: str, out: str = "before", parts: int = 64) -> DataFrame:
    """Adds the sum of ``amount`` over the rows of smaller ``order`` (a number that tells all rows apart), by ranges of it."""
    rows = df.withColumn("_b", below(sorted(set(ranges_of(df, order, parts))), F.col(order).cast("double")))
    totals = rows.groupBy("_b").agg(F.sum(amount).alias("_t"))  # a row a range
    totals = totals.withColumn("_o", F.sum("_t").over(W.partitionBy().orderBy("_b")) - F.col("_t")).drop("_t")
    inner = F.sum(amount).over(W.partitionBy("_b").orderBy(order)) - F.col(amount)
    return rows.withColumn("_i", inner).join(F.broadcast(totals), "_b").withColumn(out, F.col("_o") + F.col("_i")).drop("_b", "_o", "_i")


def counted(df: DataFrame, value: str, by: tuple[str, ...] = (), parts: int = 64) -> DataFrame:
    """(by, value, _n, _before): the distinct values of each class with their rows and the rows of smaller values."""
    some = df.where(F.col(value).isNotNull()).select(*by, value)
    cuts = sorted(set(ranges_of(some, value, parts)))  # a range has at most as many distinct values as rows
    counts = some.groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_b", below(cuts, F.col(value).cast("double")))
    totals = some.groupBy(*by, below(cuts, F.col(value).cast("double")).alias("_b")).agg(F.count("*").alias("_t"))
    totals = totals.withColumn("_o", F.sum("_t").over(W.partitionBy(*by).orderBy("_b")) - F.col("_t")).drop("_t")
    keys = [F.col(c) for c in (*by, "_b")]
    inner = F.sum("_n").over(W.partitionBy(*keys).orderBy(value)) - F.col("_n")
    return counts.join(totals if by else F.broadcast(totals), [*by, "_b"]).withColumn("_before", F.col("_o") + inner).select(*by, value, "_n", "_before")


def average_rank(df: DataFrame, value: str, out: str, parts: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the tie-averaged rank of ``value`` within ``by`` (nulls get null).  Values are counted first, the counts cut in ranges,
    and running sums taken by range, so that no task ranks all rows or all rows of a class."""
    ranks = counted(df, value, by, parts).select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, [*by, value], "left")


def before_each(counts: DataFrame, by: list[str], order: list[str], n: str, most: int = 1_000_000) -> DataFrame:
    """Adds ``_before``: the rows of smaller values in the class, for counted values.  Beyond ``most`` values the last of ``order`` is
    cut in ranges, so that no task holds all values of a class."""
    if counts.count() <= most:
        return counts.withColumn("_before", F.sum(n).over(W.partitionBy(*by).orderBy(*order)) - F.col(n))
    cuts = sorted(set(ranges_of(counts, order[-1], 256)))
    ranged = counts.withColumn("_b", F.coalesce(below(cuts, F.col(order[-1])), F.lit(-1)))
    keys = [*order[:-1], "_b"]
    totals = ranged.groupBy(*by, *keys).agg(F.sum(n).alias("_t"))
    totals = totals.withColumn("_o", F.sum("_t").over(W.partitionBy(*by).orderBy(*keys)) - F.col("_t")).drop("_t")
    inner = F.sum(n).over(W.partitionBy(*by, *keys).orderBy(order[-1])) - F.col(n)
    return ranged.withColumn("_i", inner).join(totals, [*by, *keys]).withColumn("_before", F.col("_o") + F.col("_i")).drop("_o", "_i", "_b")


def profile(df: DataFrame, by: tuple[str, ...], at: dict[str, tuple[str, float]], *, pair: tuple[str, str] | None = None, sums: dict[str, Column] | None = None, degenerate: str = "nan", least: int = 0, k: int = 4000, margin: float = 2.5) -> DataFrame:
    """One row a class: n, exact quantiles by name from ``at`` (column, share; linear between neighbours, null without values), rho of
    ``pair`` (rank correlation with tied ranks averaged, over rows that have both), and ``sums``.  The rows are read twice, whatever
    is asked for:

    1. Each task sketches every column by class (KLL, mergeable, some k numbers each).  The sketches give a bracket of values around
       each quantile, and cuts of the pair in ranges.
    2. Rows are counted below each bracket and by value inside it; for the pair, ranks inside a range of x and of y are summed by
       (class, range of x, range of y), and what lies before a range is added to the sums afterwards.  One value that fills ranges
       has a range of its own, where all ranks are equal, and is not ranked.

    What comes out is small and checkpointed.  A bracket that misses its quantile, which a sketch allows in rare cases, is widened
    and the second step taken again.  Jobs run while the DataFrame is built."""
    by_cols, sums = list(by), sums or {}
    pair_cols = list(pair or ())
    columns = list(dict.fromkeys([*(c for c, _ in at.values()), *pair_cols]))
    number = lambda c: F.col(c).cast("double")
    sketch = df.groupBy(*by_cols).agg(*(F.kll_sketch_agg_double(number(c), k).alias(f"_s{i}") for i, c in enumerate(columns)), *(F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)))
    sketch = checkpoint(sketch)
    off = margin * 2.296 / k**0.9021  # the rank error of a sketch of k
    point = lambda i, q: F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"_s{i}"), F.lit(min(1.0, max(0.0, q)))))
    ends = [point(columns.index(c), q + d * off).alias(f"_{e}{j}") for j, (c, q) in enumerate(at.values()) for d, e in ((-1, "lo"), (1, "hi"))]
    brackets = sketch.select(*by_cols, *ends)
    small = F.broadcast(brackets) if sketch.count() <= 10_000 else brackets
    rows = df.join(small, by_cols) if by_cols else df.crossJoin(small)
    inside = []
    for j, (c, _) in enumerate(at.values()):
        side = lambda x, v=None: F.struct(F.lit(x).alias("side"), (F.lit(None).cast("double") if v is None else v).alias("v"))
        inside.append(F.when(number(c) < F.col(f"_lo{j}"), side(-1)).when(number(c) > F.col(f"_hi{j}"), side(1)).when(F.col(c).isNotNull(), side(0, number(c))).alias(f"_q{j}"))
    keep = [*by_cols, *inside, *(e.cast("double").alias(f"_v{i}") for i, e in enumerate(sums.values())), *(number(c).alias(f"_p{i}") for i, c in enumerate(pair_cols))]
    rows = rows.select(*keep)
    keys = [*by_cols, *(f"_q{j}" for j in range(len(at)))]
    facts = [F.count("*").alias("_n"), *(F.sum(f"_v{i}").alias(f"_v{i}") for i in range(len(sums)))]
    hot: list[list[float]] = []
    if pair:
        n = [x or 0 for x in sketch.agg(*(F.sum(f"_n{columns.index(c)}") for c in pair_cols)).first()]
        parts = min(256, max(8, n[0] // 200_000))  # ranges of some 200,000 rows, as far as that many cuts are quick
        merged = sketch.agg(*(F.kll_merge_agg_double(f"_s{columns.index(c)}").alias(f"s{i}") for i, c in enumerate(pair_cols)))
        for i in range(2):
            found = merged.select(F.kll_sketch_get_quantile_double(f"s{i}", F.array(*(F.lit(j / parts) for j in range(1, parts))))).first()[0] if n[i] else []
            cuts = sorted(found)
            hot.append(sorted({c for c, d in zip(cuts, cuts[1:], strict=False) if c == d}))
            value = F.col(f"_p{i}")
            full = F.coalesce(value.isin(hot[i]), F.lit(False)) if hot[i] else F.lit(False)
            rows = rows.withColumns({f"_b{i}": F.when(value.isNotNull(), 2 * below(sorted(set(cuts)), value) + full.cast("int")), f"_h{i}": full})
        for i in range(2):
            # rows that are not ranked are dealt out, so that they fill no task
            salt = F.when(F.col(f"_h{i}") | F.col(f"_b{i}").isNull(), F.pmod(F.xxhash64(f"_p{1 - i}", *keys), F.lit(64))).otherwise(0)
            rows = rows.withColumn("_salt", salt)
            part = [*by_cols, f"_b{i}", "_salt"]
            place = F.rank().over(W.partitionBy(*part).orderBy(f"_p{i}")) + (F.count("*").over(W.partitionBy(*part, f"_p{i}")) - 1) / 2.0
            rows = rows.withColumn(f"_i{i}", F.when(F.col(f"_h{i}"), 0.0).otherwise(place))
        keys += ["_b0", "_b1"]
        x, y = F.col("_i0"), F.col("_i1")
        facts += [F.sum(e).alias(a) for a, e in (("_x", x), ("_y", y), ("_xx", x * x), ("_yy", y * y), ("_xy", x * y))]
    cells = checkpoint(rows.groupBy(*keys).agg(*facts))
    out = cells.groupBy(*by_cols).agg(F.sum("_n").alias("n"), *(F.sum(f"_v{i}").alias(name) for i, name in enumerate(sums)))
    join = lambda a, b: a.join(b, by_cols, "left") if by_cols else a.crossJoin(b)
    if pair:
        out = join(out, cell_correlation(cells, by_cols, hot, degenerate, least))
    if at:
        each = cells.select(*by_cols, "_n", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"_q{j}").alias("q")) for j in range(len(at))))).alias("_e"))
        counts = each.where(F.col("_e.q").isNotNull()).groupBy(*by_cols, F.col("_e.j").alias("_j"), F.col("_e.q.side").alias("_side"), F.col("_e.q.v").alias("_value")).agg(F.sum("_n").alias("_c"))
        counts = before_each(counts, [*by_cols, "_j"], ["_side", "_value"], "_c")
        sizes = [F.sum(F.when(F.col("_j") == j, F.col("_c"))).alias(f"_all{j}") for j in range(len(at))]
        every = counts.groupBy(*by_cols).agg(*sizes)
        hits = []
        rows = counts.join(every, by_cols) if by_cols else counts.crossJoin(every)
        for j, (name, (_, q)) in enumerate(at.items()):
            pos = F.lit(float(q)) * (F.col(f"_all{j}") - 1)
            hit = lambda i, j=j: F.max(F.when((F.col("_j") == j) & (F.col("_side") == 0) & (F.col("_before") <= i) & (i < F.col("_before") + F.col("_c")), F.col("_value")))
            low, high, share = hit(F.floor(pos)), hit(F.ceil(pos)), F.max(pos - F.floor(pos))
            hits += [(low + (high - low) * share).alias(name), F.max(F.col(f"_all{j}")).alias(f"_all{j}")]
        found = checkpoint(rows.groupBy(*by_cols).agg(*hits) if by_cols else rows.agg(*hits))
        missed = [F.col(name).isNull() & (F.col(f"_all{j}") > 0) for j, name in enumerate(at)]
        if not found.where(F.array_contains(F.array(*missed), True)).isEmpty():
            return profile(df, by, at, pair=pair, sums=sums, degenerate=degenerate, least=least, k=k, margin=8 * margin)
        out = join(out, found.drop(*(f"_all{j}" for j in range(len(at)))))
    return out


def cell_correlation(cells: DataFrame, by: list[str], hot: list[list[float]], degenerate: str, least: int) -> DataFrame:
    """rho by class from sums of ranks inside ranges: the rows before a range are added to each of its ranks; in the range of a single
    value, where ranks were left at 0, also half of its own rows."""
    rows = cells
    for i in range(2):
        sizes = cells.where(F.col(f"_b{i}").isNotNull()).groupBy(*by, f"_b{i}").agg(F.sum("_n").alias("_t"))
        own = (F.col(f"_b{i}") % 2 == 1) if hot[i] else F.lit(False)
        start = F.sum("_t").over(W.partitionBy(*by).orderBy(f"_b{i}")) - F.col("_t")  # 512 rows a class at most
        sizes = sizes.withColumn(f"_a{i}", start + F.when(own, (F.col("_t") + 1) / 2).otherwise(0.0)).drop("_t")
        rows = rows.join(sizes, [*by, f"_b{i}"])  # cells without a value for either fall out
    a, c, n = F.col("_a0"), F.col("_a1"), F.col("_n")
    parts = {"x": n * a + F.col("_x"), "y": n * c + F.col("_y"), "xx": n * a * a + 2 * a * F.col("_x") + F.col("_xx"), "yy": n * c * c + 2 * c * F.col("_y") + F.col("_yy"), "xy": n * a * c + a * F.col("_y") + c * F.col("_x") + F.col("_xy")}
    total = rows.groupBy(*by).agg(F.sum("_n").alias("_m"), *(F.sum(e).alias(f"_{name}") for name, e in parts.items()))
    mean = lambda name: F.col(f"_{name}") / F.col("_m")
    vx, vy, cov = mean("xx") - mean("x") * mean("x"), mean("yy") - mean("y") * mean("y"), mean("xy") - mean("x") * mean("y")
    empty = F.lit(float("nan")) if degenerate == "nan" else F.lit(0.0)
    flat = 1e-9  # ranks that differ at all have a variance of 1/4 over m squared or more, sums round far below it
    return total.select(*by, F.when((F.col("_m") < least) | (vx * F.col("_m") <= flat) | (vy * F.col("_m") <= flat), empty).otherwise(F.try_divide(cov, F.sqrt(vx * vy))).alias("rho"))


def quantiles(df: DataFrame, value: str, at: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """One row a class with exact quantiles of a column by name, linear between neighbours (see ``profile``).  A class without a
    value gives null."""
    return profile(df, by, {name: (value, q) for name, q in at.items()}).drop("n")


def pearson(x: str, y: str, *, degenerate: str, least: int = 0) -> Column:
    """Aggregate; a zero variance (or fewer than ``least`` rows) gives NaN or 0 as ``degenerate`` says."""
    empty = F.lit(float("nan")) if degenerate == "nan" else F.lit(0.0)
    cov, vx, vy = F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)
    return F.when((F.count("*") < least) | (vx <= 0) | (vy <= 0), empty).otherwise(F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))


def spearman(df: DataFrame, x: str, y: str, *, degenerate: str, least: int = 0) -> DataFrame:
    return profile(df, (), {}, pair=(x, y), degenerate=degenerate, least=least).select("rho", "n")


def spearman_by(df: DataFrame, by: str, x: str, y: str, *, degenerate: str, least: int = 0) -> DataFrame:
    return profile(df, (by,), {}, pair=(x, y), degenerate=degenerate, least=least).select(by, "rho", "n")


def codes(v: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct ones."""
    return np.unique(v, return_inverse=True)[1].ravel()


def ranks(v: np.ndarray) -> np.ndarray:
    """Tie-averaged ranks."""
    c = codes(v)
    count = np.bincount(c)
    return (np.cumsum(count) - (count - 1) / 2)[c]


def weighted_rho(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Rank correlation of rows that occur ``w`` times each, from codes: tie-averaged ranks come from counts, without a sort."""

    def ranked(c):
        count = np.bincount(c, w)
        return (np.cumsum(count) - (count - 1) / 2)[c]

    a, b, n = ranked(x), ranked(y), w.sum()
    a, b = a - (w @ a) / n, b - (w @ b) / n
    d = np.sqrt((w @ (a * a)) * (w @ (b * b)))
    return float(w @ (a * b) / d) if d > 0 else float("nan")


def rho(x: np.ndarray, y: np.ndarray) -> float:
    return weighted_rho(codes(x), codes(y), np.ones(len(x)))


def weighted_quantile(ordered: np.ndarray, w: np.ndarray, q: float) -> float:
    """Linear quantile of sorted values that occur ``w`` times each."""
    total = np.cumsum(w)
    if not len(w) or not total[-1]:
        return float("nan")
    pos = q * (total[-1] - 1)
    low, high = (ordered[np.searchsorted(total, i, side="right")] for i in (np.floor(pos), np.ceil(pos)))
    return float(low + (high - low) * (pos - np.floor(pos)))


def bootstrap(df: DataFrame, columns: list[str], statistic, *, n: int, seed: int, within: str | None = None, most: int = 2_000_000) -> DataFrame:
    """(replicate, value): ``statistic(rows)`` gives a function of how often each row was drawn, and that is taken on n resamples,
    drawn within the classes of the column ``within`` if it is given.  The columns are broadcast, which their row count allows (at
    most ``most``, 8 bytes a value; more are refused); replicates are dealt over the cluster and seeded by number, so a lost one
    comes out the same again."""
    rows = df.count()
    if rows > most:
        raise ValueError(f"{rows} rows are more than the {most} that a bootstrap broadcasts")
    spark = df.sparkSession
    every = list(dict.fromkeys([*columns, *([within] if within else [])]))
    values = df.select(*every).toPandas().sort_values(every).to_numpy(float)
    groups = [np.flatnonzero(values[:, every.index(within)] == c) for c in np.unique(values[:, every.index(within)])] if within else [np.arange(len(values))]
    data = spark.sparkContext.broadcast((values, groups))

    def run(batches):
        x, parts = data.value
        f = statistic(x)
        for b in batches:
            out = []
            for r in b["replicate"]:
                rng, w = np.random.default_rng([seed, int(r)]), np.zeros(len(x))
                for at in parts:
                    w[at] = np.bincount(rng.integers(0, len(at), len(at)), minlength=len(at))
                out.append(f(w))
            yield pd.DataFrame({"replicate": b["replicate"], "value": out})

    tasks = max(1, min(n, 2 * spark.sparkContext.defaultParallelism))
    return spark.range(n).withColumnRenamed("id", "replicate").repartition(tasks).mapInPandas(run, "replicate long, value double")


def interval(replicates: DataFrame) -> DataFrame:
    return replicates.agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"), F.stddev_samp("value").alias("sd"), F.avg((F.col("value") <= 0).cast("double")).alias("p_not_positive"))
