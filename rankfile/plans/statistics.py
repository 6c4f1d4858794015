"""Gap reports, rank statistics, tails, verdicts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.operators import rank, report, resample
from rankfile.operators.lineage import checkpoint

from .core import oracle, load, query
from .views import GAPS, gaps

# Poisson resampling: fifty replicates, which SQL can spell out on the same hash weights.
FEW, SEED = 50, 20260919

RANKED = f"""g as ({GAPS}), r as (select *, rank() over (partition by class order by static_cp) + (count(*) over (partition by class, static_cp) - 1) / 2.0 as rx,
 rank() over (partition by class order by search_cp) + (count(*) over (partition by class, search_cp) - 1) / 2.0 as ry from g)"""
RHO = "(avg(rx * ry) - avg(rx) * avg(ry)) / sqrt((avg(rx * rx) - avg(rx) * avg(rx)) * (avg(ry * ry) - avg(ry) * avg(ry)))"
SUMMARY = f"""select class, count(*) as n, quantile_cont(gap, 0.5) as median_gap, quantile_cont(abs(search_cp - static_cp), 0.5) as median_gap_cp,
 {RHO} as rho, count(*) / sum(count(*)) over () as position_share, sum(gap * gap) / sum(sum(gap * gap)) over () as error_share from r group by class"""


def summary(df, by: str):
    """The gap summary by class, from two passes over the rows; a few rows, checkpointed."""
    df = df.withColumn("_off", F.abs(F.col("search_cp") - F.col("static_cp")))
    out = rank.profile(df, (by,), {"median_gap": ("gap", 0.5), "median_gap_cp": ("_off", 0.5)}, pair=("static_cp", "search_cp"), sums={"_sq": F.col("gap") * F.col("gap")}, least=3)
    total = out.agg(F.sum("n").alias("_n"), F.sum("_sq").alias("_s"))  # one row
    return checkpoint(out.crossJoin(F.broadcast(total)).select(by, "n", "median_gap", "median_gap_cp", "rho", (F.col("n") / F.col("_n")).alias("position_share"), (F.col("_sq") / F.col("_s")).alias("error_share")))


@query("gap_by_class", f"with {RANKED} select class, n, round(median_gap, 6) as median_gap, round(median_gap_cp, 4) as median_gap_cp, round(rho, 6) as rho, round(position_share, 6) as position_share, round(error_share, 6) as error_share, n < 100 as underpowered from ({SUMMARY})")
def gap_by_class(spark, sf_dir):
    s = summary(gaps(spark, sf_dir), "class")
    return s.select("class", "n", F.round("median_gap", 6).alias("median_gap"), F.round("median_gap_cp", 4).alias("median_gap_cp"), F.round("rho", 6).alias("rho"), F.round("position_share", 6).alias("position_share"), F.round("error_share", 6).alias("error_share"), (F.col("n") < 100).alias("underpowered"))


DECISION = """select round(a, 6) as median_ratio, round(b, 6) as rho_difference, round(c, 6) as share_ratio, a >= 1.5 as a_met, b >= 0.05 as b_met, c >= 1.5 as c_met,
 a >= 1.5 and b >= 0.05 as supported, a >= 1.5 and b >= 0.05 and c >= 1.5 as actionable from
 (select case when q.median_gap = 0 then cast('Infinity' as double) else k.median_gap / q.median_gap end as a, q.rho - k.rho as b, k.error_share / k.position_share as c
  from s k, s q where k.class = 'R' and q.class = 'N')"""


@query("gap_decision", f"with {RANKED}, s as ({SUMMARY}) {DECISION}")
def gap_decision(spark, sf_dir):
    return spark.sql(DECISION.replace(" s k, s q ", " {s} k, {s} q "), s=summary(gaps(spark, sf_dir), "class"))


CELLS = f"""with g as ({GAPS}), cells as (select class, bucket, grouping(class) as gc, grouping(bucket) as gb, count(*) as n, quantile_cont(gap, 0.5) as m from g group by grouping sets ((class), (bucket), (class, bucket))),
 dom as (select c.class as class, b.bucket as bucket from (select 'A' as class union all select 'N' union all select 'R' union all select 'none') c, (select 'F' as bucket union all select 'O') b)
 select dom.class, dom.bucket, coalesce(n, 0) as n, round(m, 6) as median_gap, coalesce(n, 0) < 100 as underpowered from dom left join cells on dom.class = cells.class and dom.bucket = cells.bucket and gc = 0 and gb = 0
 union all select class, 'all' as bucket, n, round(m, 6) as median_gap, n < 100 as underpowered from cells where gc = 0 and gb = 1
 union all select 'all' as class, bucket, n, round(m, 6) as median_gap, n < 100 as underpowered from cells where gc = 1 and gb = 0"""


@query("gap_grouping_sets", CELLS)
def gap_grouping_sets(spark, sf_dir):
    """Counts and medians by class, by bucket and by both, over the fixed domain of cells, empty ones included."""
    g = gaps(spark, sf_dir).select("class", "bucket", "gap")
    # each row counts in three cells, as grouping sets expand it
    cell = lambda c, b: F.struct(F.coalesce(c, F.lit("none")).alias("class"), b.alias("bucket"))
    sets = g.select("gap", F.explode(F.array(cell(F.col("class"), F.col("bucket")), cell(F.col("class"), F.lit("all")), cell(F.lit("all"), F.col("bucket")))).alias("_c")).select("gap", "_c.class", "_c.bucket")
    cells = rank.profile(sets, ("class", "bucket"), {"m": ("gap", 0.5)})
    domain = spark.createDataFrame([(c, b) for c in ("A", "N", "R", "none") for b in ("F", "O")], "class string, bucket string")
    every = F.broadcast(domain).join(cells, ["class", "bucket"], "left").unionByName(cells.where("class = 'all' or bucket = 'all'").select("class", "bucket", "n", "m"))
    n = F.coalesce("n", F.lit(0))
    return every.select("class", "bucket", n.alias("n"), F.round("m", 6).alias("median_gap"), (n < 100).alias("underpowered"))


@query("rank_avg", "select o_orderkey, rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as rank_price, rank() over (order by o_orderdate) + (count(*) over (partition by o_orderdate) - 1) / 2.0 as rank_date from orders")
def rank_avg(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.unix_date(F.to_date("o_orderdate")).cast("double").alias("day"))
    return rank.average_rank(rank.average_rank(o, "o_totalprice", "rank_price"), "day", "rank_date").select("o_orderkey", "rank_price", "rank_date")


@query("spearman_global", f"with g as ({GAPS}), r as (select rank() over (order by static_cp) + (count(*) over (partition by static_cp) - 1) / 2.0 as rx, rank() over (order by search_cp) + (count(*) over (partition by search_cp) - 1) / 2.0 as ry from g) select count(*) as n, round({RHO}, 6) as rho from r")
def spearman_global(spark, sf_dir):
    return rank.spearman(gaps(spark, sf_dir), "static_cp", "search_cp", degenerate="nan", least=3).select("n", F.round("rho", 6).alias("rho"))


@query("spearman_by_class", f"with {RANKED} select class, count(*) as n, round({RHO}, 6) as rho from r group by class")
def spearman_by_class(spark, sf_dir):
    return rank.spearman_by(gaps(spark, sf_dir), "class", "static_cp", "search_cp", degenerate="nan").select("class", "n", F.round("rho", 6).alias("rho"))


@query("pearson_guarded", "select l_linenumber, case when var_pop(z) <= 0 or var_pop(l_quantity) <= 0 then 0 else round(covar_pop(z, l_quantity) / sqrt(var_pop(z) * var_pop(l_quantity)), 6) end as r from (select l_linenumber, l_quantity, case when l_linenumber < 3 then cast(1 as double) else cast(l_extendedprice as double) end as z from lineitem) group by l_linenumber")
def pearson_guarded(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").withColumn("z", F.when(F.col("l_linenumber") < 3, 1.0).otherwise(F.col("l_extendedprice").cast("double"))).withColumn("q", F.col("l_quantity").cast("double"))
    return li.groupBy("l_linenumber").agg(F.round(rank.pearson("z", "q", degenerate="zero"), 6).alias("r"))


QS = (0.5, 0.75, 0.9, 0.95, 0.99)


@query("percentile_table", f"select class, count(*) as n, round(avg(gap), 6) as mean_gap, {', '.join(f'round(quantile_cont(gap, {q}), 6) as p{round(100 * q)}' for q in QS)}, round(max(gap), 6) as max_gap from ({GAPS}) group by class")
def percentile_table(spark, sf_dir):
    g = gaps(spark, sf_dir).select("class", "gap")
    names = {f"p{round(100 * q)}": q for q in QS}
    out = rank.profile(g, ("class",), {name: ("gap", q) for name, q in names.items()} | {"max_gap": ("gap", 1.0)}, sums={"_sum": F.col("gap")})
    return out.select("class", "n", F.round(F.col("_sum") / F.col("n"), 6).alias("mean_gap"), *(F.round(c, 6).alias(c) for c in names), F.round("max_gap", 6).alias("max_gap"))


@oracle("tail_distribution")
def tail_distribution(d):
    shares = ", ".join(f"round(avg(case when gap > 0.{t} then cast(1 as double) else cast(0 as double) end), 6) as over_{t}, round(sum(case when gap > 0.{t} then gap * gap else 0 end) / sum(gap * gap), 6) as error_{t}" for t in (1, 2, 3))
    return f"select class, {shares} from ({GAPS}) group by class"


@query("top_fraction_lift", f"""with g as ({GAPS}), k as (select *, row_number() over (order by gap desc, id) as rn, count(*) over () as n from g), t as (select class, count(*) as total, sum(case when rn <= round_even(0.1 * n, 0) then 1 else 0 end) as top, max(n) as n from k group by class)
 select class, cast(total as bigint) as total, cast(top as bigint) as top, round((top / sum(top) over ()) / (total / sum(total) over ()), 6) as lift from t""")
def top_fraction_lift(spark, sf_dir):
    """How much more often each class is among the tenth of largest gaps than among all."""
    k = rank.numbered(gaps(spark, sf_dir).select("id", "class", "gap"), "gap", "id", descending=True)
    t = k.groupBy("class").agg(F.count("*").alias("total"), F.count_if(F.col("k") <= F.bround(F.lit(0.1) * k.count())).alias("top"))
    every = t.agg(F.sum("total").alias("_n"), F.sum("top").alias("_k"))  # one row
    return t.crossJoin(F.broadcast(every)).select("class", "total", "top", F.round((F.col("top") / F.col("_k")) / (F.col("total") / F.col("_n")), 6).alias("lift"))


SHARES = (0.05, 0.1, 0.2)


@query("filter_comparison", f"""with g as ({GAPS}), k as (select *, row_number() over (order by gap desc, id) as rn from g), c as (select count(*)::double as n, sum(case when class = 'R' then 1 else 0 end)::double as m, sum(gap * gap) as e, sum(case when class = 'R' then gap * gap else 0 end) as ec from g),
 s as (select 'own' as cut, m / n as share from c union all select s, s::double from (select unnest({list(map(str, SHARES))}) as s)), w as (select cut, share, round_even(share * n, 0) as removed, m / n as own, ec / e as held, e from s, c),
 t as (select cut, sum(case when rn <= removed then gap * gap else 0 end) as gone from w, k group by cut)
 select w.cut, round(share, 6) as share, removed::bigint as removed, round(gone / e, 6) as by_threshold, round(case when share <= own then share / own * held else held + (share - own) / (1 - own) * (1 - held) end, 6) as by_class from w join t on w.cut = t.cut""")
def filter_comparison(spark, sf_dir):
    """Squared error removed by dropping the largest gaps, and what dropping as many rows of the class first (then of the others) is
    expected to remove, at several shares and at the class's own."""
    g = gaps(spark, sf_dir).select("id", "class", "gap").withColumn("e", F.col("gap") * F.col("gap"))
    n, m, held, all_ = g.agg(F.count("*"), F.count_if(F.col("class") == "R"), F.sum(F.when(F.col("class") == "R", F.col("e"))), F.sum("e")).first()
    cuts = [(str(s), float(s)) for s in SHARES] + [("own", m / n)]
    removed = {c: round(s * n) for c, s in cuts}
    gone = rank.numbered(g, "gap", "id", descending=True).agg(*(F.sum(F.when(F.col("k") <= removed[c], F.col("e")).otherwise(0.0)).alias(c) for c, _ in cuts))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("cut"), F.lit(s).alias("share"), F.lit(removed[c]).cast("long").alias("removed"), F.col(f"`{c}`").alias("gone")) for c, s in cuts))).alias("r")
    out = gone.select(rows).select("r.*")
    return out.select("cut", F.round("share", 6).alias("share"), "removed", F.round(F.col("gone") / all_, 6).alias("by_threshold"), F.round(report.class_filter(F.col("share"), m / n, held / all_), 6).alias("by_class"))


@oracle("mae_rmse_clamped")
def mae_rmse_clamped(d):
    return f"""with g as ({GAPS}), c as (select class, greatest(-2000, least(2000, static_cp)) as s, greatest(-2000, least(2000, search_cp)) as t, search_cp, static_cp from g)
 select class, count(*) as n, round(avg(s - t), 4) as bias, round(avg(abs(s - t)), 4) as mae, round(sqrt(avg((s - t) * (s - t))), 4) as rmse, round(stddev_pop(t), 4) as sd, cast(sum(case when abs(search_cp) > 2000 then 1 else 0 end) as bigint) as clamped,
 round(avg(case when (static_cp > 0) = (search_cp > 0) then cast(1 as double) else cast(0 as double) end), 6) as agree from c group by class"""


@oracle("mae_by_budget")
def mae_by_budget(d):
    x, y = "l_quantity * 40", "l_extendedprice / 50"
    ranks = lambda v: f"rank() over (partition by l_linenumber order by {v}) + (count(*) over (partition by l_linenumber, {v}) - 1) / 2.0"
    return f"""with r as (select l_linenumber as budget, cast({x} - {y} as double) as off, {ranks(x)} as rx, {ranks(y)} as ry from lineitem)
 select budget, count(*) as n, round(avg(abs(off)), 4) as mae, round(sqrt(avg(off * off)), 4) as rmse, round({RHO}, 6) as rho from r group by budget"""


@oracle("pov_check")
def pov_check(d):
    return f"""with g as (select l_orderkey % 2 = 0 as white, cast(l_quantity * 40 - 1000 as int) as material, cast(l_extendedprice / 50 - 1000 as double) as cp from lineitem), f as (select * from g where abs(material) >= 400 and cp <> 0),
 s as (select white, count(*) as n, avg(case when (material > 0) = (cp > 0) then cast(1 as double) else cast(0 as double) end) as agree from f group by white)
 select max(case when white then n end) as n_white, max(case when not white then n end) as n_black, round(max(case when white then agree end), 6) as white_agree, round(max(case when not white then 1 - agree end), 6) as black_contrast,
 max(case when white then n end) > 50 and max(case when not white then n end) > 50 and max(case when white then agree end) > 0.7 and max(case when not white then 1 - agree end) > 0.4 as accepted from s"""


@oracle("predictor_losses")
def predictor_losses(d):
    t = "1 / (1 + exp(-0.005756462732485115 * greatest(-2000, least(2000, l_extendedprice / 50 - 1000))))"
    m = "1 / (1 + exp(-0.005756462732485115 * greatest(-2000, least(2000, l_quantity * 40 - 1000))))"
    return f"select round(var_pop(t), 6) as constant_loss, round(avg((m - t) * (m - t)), 6) as material_loss, round(avg((0.5 - t) * (0.5 - t)), 6) as untrained_loss, avg((0.5 - t) * (0.5 - t)) <= 1.5 * var_pop(t) as accepted from (select {t} as t, {m} as m from lineitem)"


@query("scale_fit", f"""with g as ({GAPS}), f as (select sum(static_cp * search_cp) / sum(static_cp * static_cp) as k from g) select round(max(k), 6) as slope, round(1 - sum((search_cp - k * static_cp) * (search_cp - k * static_cp)) / sum(search_cp * search_cp), 6) as r2, round(stddev_pop(search_cp - k * static_cp), 4) as residual_sd,
 round(stddev_pop(search_cp) / stddev_pop(static_cp), 6) as sd_ratio, round(quantile_cont(abs(search_cp), 0.9) / quantile_cont(abs(static_cp), 0.9), 6) as p90_ratio, round(quantile_cont(abs(search_cp), 0.5) / quantile_cont(abs(static_cp), 0.5), 6) as median_ratio from g, f""")
def scale_fit(spark, sf_dir):
    """Slope through the origin, its fit, and ratios of spread and of quantiles."""
    g = gaps(spark, sf_dir).select("static_cp", "search_cp").withColumns({"a": F.abs("static_cp"), "b": F.abs("search_cp")})
    slope = g.agg(F.sum(F.col("static_cp") * F.col("search_cp")) / F.sum(F.col("static_cp") * F.col("static_cp"))).first()[0]
    off = F.col("search_cp") - F.lit(slope) * F.col("static_cp")
    out = g.agg(F.round(F.lit(slope), 6).alias("slope"), F.round(1 - F.sum(off * off) / F.sum(F.col("search_cp") * F.col("search_cp")), 6).alias("r2"), F.round(F.stddev_pop(off), 4).alias("residual_sd"), F.round(F.stddev_pop("search_cp") / F.stddev_pop("static_cp"), 6).alias("sd_ratio"))
    q = rank.profile(g, (), {f"{c}{p}": (c, p / 100) for c in "ab" for p in (50, 90)}).drop("n")  # one row
    return out.crossJoin(F.broadcast(q)).select(*out.columns, F.round(F.col("b90") / F.col("a90"), 6).alias("p90_ratio"), F.round(F.col("b50") / F.col("a50"), 6).alias("median_ratio"))


DIFF = "floor(l_extendedprice / 50 - 1000) - (l_extendedprice / 50 - 1000)"


@query("quantised_gate", f"select round(quantile_cont(abs({DIFF}), 0.5), 6) as median_diff, round(quantile_cont(abs({DIFF}), 0.95), 6) as p95_diff, round(max(abs({DIFF})), 6) as max_diff, round(avg({DIFF}), 6) as bias, max(abs({DIFF})) <= 1 as accepted from lineitem")
def quantised_gate(spark, sf_dir):
    d = load(spark, sf_dir, "lineitem").select(F.expr(DIFF).cast("double").alias("d")).withColumn("m", F.abs("d"))
    q = rank.quantiles(d, "m", {"median_diff": 0.5, "p95_diff": 0.95})
    return q.crossJoin(F.broadcast(d.agg(F.round(F.max("m"), 6).alias("max_diff"), F.round(F.avg("d"), 6).alias("bias"), (F.max("m") <= 1).alias("accepted")))).select(F.round("median_diff", 6).alias("median_diff"), F.round("p95_diff", 6).alias("p95_diff"), "max_diff", "bias", "accepted")


@oracle("elo_intervals")
def elo_intervals(d):
    return f"""with m as (select l_suppkey % 4 as pair, cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as double) as w, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as double) as l, cast(sum(case when l_returnflag = 'N' then 1 else 0 end) as double) as dr from lineitem group by l_suppkey % 4),
 s as (select pair, w + l + dr as n, (w + 0.5 * dr) / (w + l + dr) as p, (w * 1.0 + 0.25 * dr) / (w + l + dr) - ((w + 0.5 * dr) / (w + l + dr)) * ((w + 0.5 * dr) / (w + l + dr)) as v from m),
 e as (select pair, n, {d.double('-400 * log10(1 / p - 1)')} as elo, {d.double('400 / ln(10) * sqrt(v / n) / (p * (1 - p))')} as se from s)
 select pair, cast(n as bigint) as n, round(elo, 3) as elo, round(elo - 1.96 * se, 3) as low, round(elo + 1.96 * se, 3) as high, round(sum(elo / (se * se)) over () / sum(1 / (se * se)) over (), 3) as combined, round(sqrt(sum(se * se) over ()), 3) as chain_se, round(1 - pow(cast(0.05 as double), 1 / n), 8) as zero_event_bound,
 -- the normal distribution function as a series: 1/2 + density * (z + z^3/3 + z^5/15 + ...)
 round(0.5 + exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 60), lambda i: pow(z, 2 * i + 1) / list_product(list_transform(range(0, i + 1), lambda j: (2 * j + 1)::double)))), 5) as superiority
 from (select e.*, greatest(-6, least(6, (m.w - m.l) / sqrt(m.w + m.l))) as z from e join m on e.pair = m.pair)"""


def hard_gaps(spark, sf_dir):
    return gaps(spark, sf_dir).withColumn("hard", (F.col("class") == "R").cast("double"))


@query("bootstrap_rho")
def bootstrap_rho(spark, sf_dir):
    return resample.interval(resample.of_few(gaps(spark, sf_dir), "id", ["static_cp"], "search_cp", n=300, seed=20260925).select(F.col("v0").alias("value")))


@query("bootstrap_one_minus_rho")
def bootstrap_one_minus_rho(spark, sf_dir):
    return resample.interval(resample.of_few(gaps(spark, sf_dir), "id", ["static_cp"], "search_cp", n=1000, seed=20260926).select((1 - F.col("v0")).alias("value")))


@query("bootstrap_median_ratio")
def bootstrap_median_ratio(spark, sf_dir):
    return resample.interval(poisson_ratio(spark, sf_dir, 0.5, 10_000))


@query("bootstrap_p90_ratio")
def bootstrap_p90_ratio(spark, sf_dir):
    return resample.interval(poisson_ratio(spark, sf_dir, 0.9, 10_000))


@query("bootstrap_rho_difference")
def bootstrap_rho_difference(spark, sf_dir):
    """Rank correlation outside of the class less that within, in each replicate."""
    by = resample.of_cells(hard_gaps(spark, sf_dir), "id", ["static_cp"], "search_cp", n=10_000, seed=20260920, by="hard")
    of = lambda c: F.max(F.when(F.col("hard") == c, F.col("v0")))
    return resample.interval(by.groupBy("replicate").agg((of(0) - of(1)).alias("value")))


@query("bootstrap_mean_difference")
def bootstrap_mean_difference(spark, sf_dir):
    return resample.interval(poisson_means(spark, sf_dir, 10_000))


@query("bootstrap_paired")
def bootstrap_paired(spark, sf_dir):
    g = gaps(spark, sf_dir).withColumn("other", F.col("static_cp") + F.col("id") % 17)
    return resample.interval(resample.of_cells(g, "id", ["static_cp", "other"], "search_cp", n=10_000, seed=1).select((F.col("v0") - F.col("v1")).alias("value")))


TAIL_SQL = f"""with recursive g as ({GAPS}), x as ({resample.drawn_sql('g', 'bucket, class, gap', 'id', FEW, SEED)}),
 c as (select bucket, class = 'R' as hard, gap, replicate, sum(w) as w from x group by 1, 2, 3, 4), k as (select *, sum(w) over (partition by bucket, hard, replicate order by gap) as upto, sum(w) over (partition by bucket, hard, replicate) as total from c where w > 0),
 p as (select bucket, hard, replicate, max(total) as total, min(case when upto > floor(0.9 * (total - 1)) then gap end) as low, min(case when upto > ceil(0.9 * (total - 1)) then gap end) as high from k group by 1, 2, 3),
 v as (select bucket, hard, replicate, low + (high - low) * (0.9 * (total - 1) - floor(0.9 * (total - 1))) as v from p), i as (select a.bucket, quantile_cont(a.v / b.v, 0.025) as p90_low from v a join v b on a.bucket = b.bucket and a.replicate = b.replicate and a.hard and not b.hard group by 1),
 r as (select *, row_number() over (partition by bucket order by gap desc, id) as rn, count(*) over (partition by bucket) as n, sum(case when class = 'R' then 1 else 0 end) over (partition by bucket) as m from g),
 t as (select bucket, avg(case when rn <= round_even(0.1 * n, 0) then case when class = 'R' then 1.0 else 0.0 end end) / avg(case when class = 'R' then 1.0 else 0.0 end) as lift, (sum(case when rn <= m then gap * gap else 0 end) - sum(case when class = 'R' then gap * gap else 0 end)) / sum(gap * gap) as margin from r group by 1)
 select t.bucket, round(lift, 6) as lift10, round(p90_low, 6) as p90_low, lift >= 2 as a_met, p90_low > 1.2 as b_met, min(case when lift >= 2 and p90_low > 1.2 then 1 else 0 end) over () = 1 as c_met, round(margin, 6) as margin, margin >= 0.10 as separate from t join i on t.bucket = i.bucket"""


def tail_of(spark, sf_dir, n: int):
    """Tail verdict by bucket: the lift of the class among the top tenth is 2 or more (a), the lower bound of the 95 % interval of
    the ratio of 90 % points is over 1.2 (b), both in every bucket (c); and, on its own, whether dropping as many of the largest gaps
    as the class has rows removes 10 points more of the squared error than dropping the class."""
    g = gaps(spark, sf_dir).select("id", "bucket", "gap", (F.col("class") == "R").alias("hard"))
    reps = resample.quantiles(g, "id", "gap", 0.9, n=n, seed=SEED, by=("bucket", "hard"))
    ratios = reps.groupBy("bucket", "replicate").agg((F.max(F.when(F.col("hard"), F.col("value"))) / F.max(F.when(~F.col("hard"), F.col("value")))).alias("value"))
    low = resample.interval(ratios, "bucket").select("bucket", F.col("low").alias("p90_low"))
    out = tail_shares(g).join(low, "bucket")
    met = out.withColumns({"a_met": F.col("lift10") >= 2, "b_met": F.col("p90_low") > 1.2, "separate": F.col("margin") >= 0.10})
    met = met.withColumn("c_met", F.min((F.col("a_met") & F.col("b_met")).cast("int")).over(W.partitionBy()) == 1)  # a row a bucket
    return met.select("bucket", F.round("lift10", 6).alias("lift10"), F.round("p90_low", 6).alias("p90_low"), "a_met", "b_met", "c_met", F.round("margin", 6).alias("margin"), "separate")


def tail_shares(g):
    """(bucket, lift10, margin): how much more often the class is in the top tenth than overall; the squared error that a threshold
    removes at the class's share, less that of the class."""
    e = F.col("gap") * F.col("gap")
    sizes = g.groupBy("bucket").agg(F.count("*").alias("_n"), F.count_if("hard").alias("_m"), F.sum(e).alias("_e"), F.sum(F.when(F.col("hard"), e).otherwise(0.0)).alias("_c"))
    top = rank.numbered(g, "gap", "id", by=("bucket",), descending=True).join(F.broadcast(sizes), "bucket")
    tenth = F.bround(F.lit(0.1) * F.col("_n"))
    out = top.groupBy("bucket", "_n", "_m", "_e", "_c").agg(F.avg(F.when(F.col("k") <= tenth, F.col("hard").cast("double"))).alias("_t"), F.sum(F.when(F.col("k") <= F.col("_m"), e).otherwise(0.0)).alias("_r"))
    return out.select("bucket", (F.col("_t") / (F.col("_m") / F.col("_n"))).alias("lift10"), ((F.col("_r") - F.col("_c")) / F.col("_e")).alias("margin"))


@query("tail_decision")
def tail_decision(spark, sf_dir):
    return tail_of(spark, sf_dir, 10_000)


@query("tail_decision_few", TAIL_SQL)
def tail_decision_few(spark, sf_dir):
    """The decision on fifty replicates, which SQL spells out."""
    return tail_of(spark, sf_dir, FEW)


@oracle("inheritance_verdict")
def inheritance_verdict(d):
    base = "select o_orderkey as k, o_totalprice as x from orders"
    noise = "sin(k * {0}) * {1}"
    cols = ", ".join(f"x + {noise.format(a, b)} as {n}" for n, a, b in (("student1", 1.1, 8000), ("student2", 1.7, 9000), ("ancestor", 2.3, 90000), ("unrelated", 3.1, 200000)))
    rho = lambda a: f"corr({a}, x)"
    return f"""with e as (select k, x, {cols} from ({base})), r as (select {rho('student1')} as s1, {rho('student2')} as s2, corr(student1, ancestor) as a1, corr(student2, ancestor) as a2, corr(student1, unrelated) as u1, corr(student2, unrelated) as u2 from e), f as (select *, greatest(s1, s2) - least(s1, s2) as fl from r)
 select round(s1, 6) as master1, round(s2, 6) as master2, round(fl, 6) as floor_, s1 - a1 > fl and s2 - a2 > fl and s1 - u1 > fl and s2 - u2 > fl as sustained from f"""


@oracle("epoch_best")
def epoch_best(d):
    return """with e as (select l_orderkey % 5 as run, l_linenumber as epoch, avg(l_discount) as val_loss from lineitem group by l_orderkey % 5, l_linenumber),
 r as (select *, row_number() over (partition by run order by val_loss, epoch) as k from e) select run, epoch, round(val_loss, 8) as val_loss from r where k = 1"""


@oracle("early_stop")
def early_stop(d):
    return """with e as (select l_orderkey % 5 as run, l_linenumber as epoch, avg(l_discount) as v from lineitem group by l_orderkey % 5, l_linenumber), m as (select *, min(v) over (partition by run order by epoch rows between unbounded preceding and 1 preceding) as before from e),
 s as (select *, max(case when before is null or v < before then epoch end) over (partition by run order by epoch rows between unbounded preceding and current row) as last_best from m) select run, epoch, epoch - last_best as since_best, epoch - last_best >= 3 as stops from s"""


@oracle("learning_rate")
def learning_rate(d):
    return "select l_linenumber as epoch, round(1e-5 + 0.5 * (1e-3 - 1e-5) * (1 + cos(3.141592653589793 * l_linenumber / 7)), 10) as lr, count(*) as n from lineitem group by l_linenumber"




DRAWN = f"d as ({resample.drawn_sql(f'({GAPS})', 'class, gap', 'id', FEW, SEED)})"


def ratio_sql(q: float) -> str:
    return f"""with {DRAWN}, c as (select class = 'R' as hard, gap, replicate, sum(w) as w from d group by 1, 2, 3), k as (select *, sum(w) over (partition by hard, replicate order by gap) as upto, sum(w) over (partition by hard, replicate) as total from c where w > 0),
 p as (select hard, replicate, max(total) as total, min(case when upto > floor({q} * (total - 1)) then gap end) as low, min(case when upto > ceil({q} * (total - 1)) then gap end) as high from k group by hard, replicate),
 v as (select hard, replicate, low + (high - low) * ({q} * (total - 1) - floor({q} * (total - 1))) as v from p) select a.replicate, round(a.v / b.v, 6) as value from v a join v b on a.replicate = b.replicate and a.hard and not b.hard"""


@query("poisson_median_ratio", ratio_sql(0.5))
def poisson_median_ratio(spark, sf_dir):
    return poisson_ratio(spark, sf_dir, 0.5, FEW).select("replicate", F.round("value", 6).alias("value"))


@query("poisson_p90_ratio", ratio_sql(0.9))
def poisson_p90_ratio(spark, sf_dir):
    return poisson_ratio(spark, sf_dir, 0.9, FEW).select("replicate", F.round("value", 6).alias("value"))


@query("poisson_mean_difference", f"with {DRAWN}, m as (select class = 'R' as hard, replicate, sum(w * gap) / sum(w) as m from d group by 1, 2) select a.replicate, round(a.m - b.m, 8) as value from m a join m b on a.replicate = b.replicate and a.hard and not b.hard")
def poisson_mean_difference(spark, sf_dir):
    return poisson_means(spark, sf_dir, FEW).select("replicate", F.round("value", 8).alias("value"))


def poisson_means(spark, sf_dir, n: int):
    g = gaps(spark, sf_dir).select("id", "gap", (F.col("class") == "R").alias("hard"))
    return resample.mean_difference(resample.sums(g, "id", ["gap"], n=n, seed=SEED, by=("hard",)), "hard")


def poisson_ratio(spark, sf_dir, q: float, n: int):
    g = gaps(spark, sf_dir).select("id", "gap", (F.col("class") == "R").alias("hard"))
    return resample.ratio(resample.quantiles(g, "id", "gap", q, n=n, seed=SEED, by=("hard",)), "hard")


def rho_sql(source: str, keep: str, n: int, seed: int) -> str:
    """CTEs that end in r(keep, replicate, value): the weighted rank correlation of x and y."""
    drawn = resample.drawn_sql(source, f"{keep}, x0, y0", "id", n, seed)
    ranks = lambda v: f"(select {keep}, replicate, {v}0, sum(w) as t, sum(sum(w)) over (partition by {keep}, replicate order by {v}0) - sum(w) + (sum(w) + 1) / 2.0 as r from d group by {keep}, replicate, {v}0)"
    return f"""d as ({drawn}), r as (select {keep}, replicate, (sum(w * a.r * b.r) / sum(w) - sum(w * a.r) / sum(w) * sum(w * b.r) / sum(w)) / sqrt((sum(w * a.r * a.r) / sum(w) - pow(sum(w * a.r) / sum(w), 2)) * (sum(w * b.r * b.r) / sum(w) - pow(sum(w * b.r) / sum(w), 2))) as value
 from d join {ranks('x')} a using ({keep}, replicate, x0) join {ranks('y')} b using ({keep}, replicate, y0) group by {keep}, replicate)"""


@query("poisson_rho", f"with {rho_sql(f'(select class, id, static_cp as x0, search_cp as y0 from ({GAPS}))', 'class', 10, SEED)} select class, replicate, round(value, 8) as value from r")
def poisson_rho(spark, sf_dir):
    """Rank correlation by class in ten replicates."""
    return resample.rho(gaps(spark, sf_dir), "id", "static_cp", "search_cp", n=10, seed=SEED, by=("class",)).select("class", "replicate", F.round("value", 8).alias("value"))
