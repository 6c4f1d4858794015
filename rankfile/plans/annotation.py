"""Games, labels, gates, worker parts and datasets end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfile.functions import fen, label
from rankfile.operators import dataset, labelling, rank, replay, report, resample
from rankfile.sources import readers

from .core import load, query
from .positions import ID, MATERIAL, STATUS, keyed
from .views import GAPS, POSITIONS, gaps, positions, with_positions

# Four short games -- a mate in four, a stalemate, a repetition to the fifth time, and castling with en passant.
GAMES = (
    "e4 e5 Bc4 Nc6 Qh5 Nf6 Qxf7#",
    "e3 a5 Qh5 Ra6 Qxa5 h5 h4 Rah6 Qxc7 f6 Qxd7+ Kf7 Qxb7 Qd3 Qxb8 Qh7 Qxc8 Kg6 Qe6",
    "Nf3 Nf6 Ng1 Ng8 Nf3 Nf6 Ng1 Ng8 Nf3 Nf6 Ng1 Ng8 Nf3 Nf6 Ng1 Ng8 e4",
    "e4 Nf6 e5 d5 exd6 exd6 Nf3 Be7 Bc4 O-O O-O Nc6 Re1 d5 Bb5 Bd6 Bxc6 bxc6 d4 Bg4",
)


def game_rows(spark, sf_dir):
    """A game for every supplier, by its number."""
    moves = F.element_at(F.array(*(F.split(F.lit(g), " ") for g in GAMES)), (F.col("s_suppkey") % len(GAMES) + 1).cast("int"))
    s = load(spark, sf_dir, "supplier").select(F.concat(F.lit("shard_"), (F.col("s_suppkey") % 7).cast("string")).alias("file"), F.col("s_suppkey").alias("game_idx"), moves.alias("moves"))
    return s.withColumn("headers", F.create_map(F.lit("Result"), F.lit("1-0")))


@query("replayed_games")
def replayed_games(spark, sf_dir):
    return replay.positions(game_rows(spark, sf_dir))


@query("random_openings")
def random_openings(spark, sf_dir):
    """An opening of eight plies for every customer."""
    return replay.openings(spark, load(spark, sf_dir, "customer").count(), plies=8, seed=3)


@query("static_labels", f"with p as ({POSITIONS}) select distinct fen, cast({MATERIAL} as double) as static_cp from p")
def static_labels(spark, sf_dir):
    return labelling.static_scores(positions(spark, sf_dir).select("fen").distinct(), labelling.StandIn, "static_cp")


@query("engine_labels")
def engine_labels(spark, sf_dir):
    return labelling.labelled(positions(spark, sf_dir).select("fen").distinct(), labelling.StandIn)


@query("identity_gate", f"with p as ({POSITIONS}), f as (select distinct fen from p order by fen limit 20) select count(*) as n, count(*) filter (where {MATERIAL} <> 0) as differ, count(*) filter (where {MATERIAL} <> 0) = count(*) as accepted from f")
def identity_gate(spark, sf_dir):
    return labelling.identity_gate(positions(spark, sf_dir).select("fen").distinct(), labelling.StandIn, lambda: labelling.StandIn(1.5), order="fen")


@query("retried_shards", f"with p as ({POSITIONS}), r as (select distinct fen from p where ok) select shard, count(*) as n, sum(case when r.fen is null then 1 else 0 end)::bigint as missing, sum(case when r.fen is null then 1 else 0 end) = 0 as accepted from p left join r on p.fen = r.fen group by shard")
def retried_shards(spark, sf_dir):
    """Shards whose every row has a result go on; one missing result discards the shard, which is then pending again."""
    p = positions(spark, sf_dir)
    return dataset.complete_shards(p, p.where("ok").select("fen").distinct(), "shard", "fen")


@query("complete_rows", f"with p as ({POSITIONS}), r as (select distinct fen from p where ok), bad as (select distinct shard from p where fen not in (select fen from r)) select {ID}, shard from p where shard not in (select shard from bad)")
def complete_rows(spark, sf_dir):
    p = positions(spark, sf_dir)
    gate = dataset.complete_shards(p, p.where("ok").select("fen").distinct(), "shard", "fen")
    return p.join(gate.where("accepted").select("shard"), "shard", "left_semi").select("game_id", "row_idx", "shard")


@query("partition_invariant", f"{STATUS} select shard, count(*) as n, count(*) filter (where status = 'new') as new, count(*) filter (where status = 'force') as force, count(*) filter (where status = 'dup') as dup, true as exhaustive from s group by shard")
def partition_invariant(spark, sf_dir):
    rows = dataset.status(dataset.with_last(keyed(spark, sf_dir), "game_id"))
    return dataset.exhaustive(rows, "shard")


@query("error_vector_join", f"with g as (select id, class, 1 / (1 + exp(-0.005756462732485115 * search_cp)) - 1 / (1 + exp(-0.005756462732485115 * static_cp)) as e, row_number() over (partition by id order by search_cp, static_cp) as k from ({GAPS})) select a.id, round(a.e, 6) as x, round(a.e * 0.5 + (a.id % 7) / 100.0, 6) as y from g a where a.k = 1 and a.class <> 'R'")
def error_vector_join(spark, sf_dir):
    """Two error vectors on their common keys; a key that comes twice in either is refused."""
    g = gaps(spark, sf_dir).withColumn("e", label.signed_error(F.col("static_cp"), F.col("search_cp")))
    one = g.groupBy("id").agg(F.min(F.struct("search_cp", "static_cp", "class", "e")).alias("s")).select("id", "s.class", "s.e")
    left = one.select("id", F.col("e").alias("x"))
    right = one.where("class <> 'R'").select("id", (F.col("e") * 0.5 + (F.col("id") % 7) / 100.0).alias("y"))
    return dataset.vectors(left, right, "id").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("positional_join", "with a as (select row_number() over (order by o_orderkey) as i, o_totalprice as x from orders), b as (select row_number() over (order by o_custkey, o_orderkey) as i, o_totalprice as y from orders) select a.i, x, y from a join b on a.i = b.i")
def positional_join(spark, sf_dir):
    """Two vectors joined by their places; unlike lengths are refused."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    a = rank.numbered(o, "o_orderkey", "o_orderkey", "i").select("i", F.col("o_totalprice").alias("x"))
    b = rank.numbered(o, "o_custkey", "o_orderkey", "i").select("i", F.col("o_totalprice").alias("y"))
    return dataset.zipped(a, b, "i")


@query("signed_errors", f"select class, count(*) as n, round(avg(1 / (1 + exp(-0.005756462732485115 * search_cp)) - 1 / (1 + exp(-0.005756462732485115 * static_cp))), 8) as mean_error from ({GAPS}) group by class")
def signed_errors(spark, sf_dir):
    g = gaps(spark, sf_dir).withColumn("e", label.signed_error(F.col("static_cp"), F.col("search_cp")))
    return g.groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg("e"), 8).alias("mean_error"))


@query("label_paths", "select s_suppkey, split_part(v, '=', 1) as label, substr(v, length(split_part(v, '=', 1)) + 2) as path from (select s_suppkey, 'net' || s_suppkey % 3 || '=/runs/' || s_suppkey || case when s_suppkey % 2 = 0 then '/a=b' else '' end as v from supplier)")
def label_paths(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", F.expr("concat('net', s_suppkey % 3, '=/runs/', s_suppkey, case when s_suppkey % 2 = 0 then '/a=b' else '' end)").alias("v"))
    name, path = readers.label_path(F.col("v"))
    return s.select("s_suppkey", name.alias("label"), path.alias("path"))


@query("merged_worker_parts", "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place, l_orderkey as idx, l_linenumber as budget from lineitem")
def merged_worker_parts(spark, sf_dir):
    """Parts of four workers, merged to one order of (index, budget)."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("budget"), "l_partkey", "l_suppkey", "l_extendedprice")
    parts = [li.where(F.col("idx") % 4 == w) for w in range(4)]
    out = dataset.merged(parts, ["idx", "budget", "l_partkey", "l_suppkey", "l_extendedprice"], "place")
    return out.select("place", "idx", "budget")


@query("dangling_references", r"""with r as (select page_id, unnest(regexp_extract_all(html, 'href="/([^"#?]+)', 1)) as ref from pages), l as (select distinct regexp_extract(url, '([^/]+)$', 1) as ref from pages) select ref, count(*) as n from r where ref not in (select ref from l) group by ref""")
def dangling_references(spark, sf_dir):
    """What pages refer to and no listing holds."""
    p = load(spark, sf_dir, "pages")
    refs = readers.references(p, "html", 'href="/([^"#?]+)', "page_id")
    listing = p.select(F.regexp_extract("url", "([^/]+)$", 1).alias("ref")).distinct()
    return refs.join(listing, "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))


@query("seeded_split")
def seeded_split(spark, sf_dir):
    """The split and order of a seeded shuffle, as the generator of the published datasets draws them."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("game_id"), F.col("o_orderkey").alias("row_idx"))
    return dataset.seeded_split(o, "game_id", "row_idx", fraction=0.025, seed=42)


@query("bucket_expansion", f"select s_suppkey, list_extract({[k % 4 + k // 8 for k in range(32)]}, cast(4 * ((s_suppkey % 64) // 8) + list_extract([0, 1, 2, 3, 3, 2, 1, 0], cast(s_suppkey % 8 + 1 as integer)) + 1 as integer)) as bucket from supplier")
def bucket_expansion(spark, sf_dir):
    """The bucket of a king square from a table of 32."""
    table = fen.bucket_table([k % 4 + k // 8 for k in range(32)], [0, 1, 2, 3, 3, 2, 1, 0])
    return load(spark, sf_dir, "supplier").select("s_suppkey", F.element_at(F.array(*map(F.lit, table)), (F.col("s_suppkey") % 64 + 1).cast("int")).alias("bucket"))


@query("rescaled_weights", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double / 2)), 5) as inner_sum, round(list_sum(list_transform(embedding, lambda x: x::double * 4)), 5) as outer_sum from embeddings")
def rescaled_weights(spark, sf_dir):
    """Weights divided, and output weights multiplied by the square, of a factor of 2."""
    total = lambda f: F.round(F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x), 5)
    inner, outer = label.rescaled(2.0)
    return load(spark, sf_dir, "embeddings").select("vec_id", total(lambda x: inner(x.cast("double"))).alias("inner_sum"), total(lambda x: outer(x.cast("double"))).alias("outer_sum"))


# Fixed values, here and in the verdicts below: the limits of a sweep (three times 0.0070, 0.0103) and the words of its readings.
# Runs of a sweep, from the line items: a factor by line number, a seed by order.
RUNS = "select l_linenumber % 4 as k, l_orderkey % 3 + 101 as seed, corr(l_quantity, l_extendedprice) as rho from lineitem group by 1, 2"
LAMBDAS = "case k when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 else 0.0 end"


def runs(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("k"), (F.col("l_orderkey") % 3 + 101).alias("seed"))
    r = li.agg(F.corr(F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double")).alias("rho"))
    return r.select(F.expr(f"cast({LAMBDAS} as double)").alias("lam"), "seed", "rho")


@query("lambda_means", f"select cast({LAMBDAS} as double) as lam, count(*) as n, round(avg(rho), 6) as rho, round(max(rho) - min(rho), 6) as excursion from ({RUNS}) group by 1")
def lambda_means(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("lam").agg(F.count("*").alias("n"), F.round(F.avg("rho"), 6).alias("rho"), F.round(F.max("rho") - F.min("rho"), 6).alias("excursion"))


MEANS = f"with m as (select cast({LAMBDAS} as double) as lam, avg(rho) as r from ({RUNS}) group by 1)"


@query("lambda_choice", f"""{MEANS}, s as (select max(r) - min(r) as spread, max(r) as best, max(case when lam = 0.7 then r end) as held from m)
 select round(spread, 6) as spread, lam as best_lambda, case when spread <= 0.0103 then 'flat' when lam <> 0.7 and best - held > 0.0103 then 'adopt' else 'stay' end as choice from s join m on m.r = s.best""")
def lambda_choice(spark, sf_dir):
    m = runs(spark, sf_dir).groupBy("lam").agg(F.avg("rho").alias("r"))
    s = m.agg((F.max("r") - F.min("r")).alias("spread"), F.max(F.struct("r", "lam")).alias("b"), F.max(F.when(F.col("lam") == 0.7, F.col("r"))).alias("held"))
    choice = F.when(F.col("spread") <= 0.0103, "flat").when((F.col("b.lam") != 0.7) & (F.col("b.r") - F.col("held") > 0.0103), "adopt").otherwise("stay")
    return s.select(F.round("spread", 6).alias("spread"), F.col("b.lam").alias("best_lambda"), choice.alias("choice"))


@query("sweep_predictions", f"""{MEANS}, w as (select max(case when lam = 1.0 then r end) as r1, max(case when lam = 0.0 then r end) as r0, max(case when lam = 0.4 then r end) as r4 from m),
 o as (select min(case when step > 0 or step is null then 1 else 0 end) as up from (select r - lag(r) over (order by lam) as step from m))
 select r1 - r0 > 3 * 0.0070 as prediction_a, r0 < r4 as prediction_b, case when r1 - r0 > 0.021 and r0 < r4 then 'both' when r1 - r0 > 0.021 then 'a only' when r0 < r4 then 'b only' else 'neither' end as reading, up = 1 as monotone from w, o""")
def sweep_predictions(spark, sf_dir):
    at = lambda lam: F.max(F.when(F.col("lam") == lam, F.col("r")))
    m = runs(spark, sf_dir).groupBy("lam").agg(F.avg("rho").alias("r"))
    w = m.agg(at(1.0).alias("r1"), at(0.0).alias("r0"), at(0.4).alias("r4"), F.array_sort(F.collect_list(F.struct("lam", "r"))).alias("o"))  # four factors
    a, b = F.col("r1") - F.col("r0") > 3 * 0.0070, F.col("r0") < F.col("r4")
    rises = F.forall(F.sequence(F.lit(2), F.size("o")), lambda i: F.element_at("o.r", i) > F.element_at("o.r", i - 1))
    return w.select(a.alias("prediction_a"), b.alias("prediction_b"), F.when(a & b, "both").when(a, "a only").when(b, "b only").otherwise("neither").alias("reading"), rises.alias("monotone"))


# Labels of seven budgets: positions that have all of them as centipawns; the deepest is the reference.
DEPTHS = """with s as (select l_orderkey as i, l_linenumber as budget, min(l_extendedprice / 50 - 1000) as score, max(case when l_returnflag = 'A' and l_linenumber <= 5 then 0 else 1 end) as is_cp from lineitem group by 1, 2),
 c as (select i from s group by i having count(*) = 7 and min(is_cp) = 1), r as (select a.i, a.budget, a.score as sa, b.score as sb from s a join s b on a.i = b.i and b.budget = 7 join c on a.i = c.i)"""


def depths(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    s = li.groupBy(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("budget")).agg(F.min(F.col("l_extendedprice") / 50 - 1000).cast("double").alias("score"), F.max(F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") <= 5), 0).otherwise(1)).alias("is_cp"))
    whole = s.groupBy("i").agg(F.count("*").alias("n"), F.min("is_cp").alias("cp"), F.max(F.when(F.col("budget") == 7, F.col("score"))).alias("sb")).where("n = 7 and cp = 1")
    return s.join(whole.select("i", "sb"), "i").select("i", "budget", F.col("score").alias("sa"), "sb")


DEPTH_RANKS = f"""{DEPTHS}, k as (select *, rank() over (partition by budget order by sa) + (count(*) over (partition by budget, sa) - 1) / 2.0 as ra, rank() over (partition by budget order by sb) + (count(*) over (partition by budget, sb) - 1) / 2.0 as rb from r),
 m as (select budget, count(*) as n, case when count(*) > 1 then corr(ra, rb) end as rho, avg(sa - sb) as bias, avg(abs(sa - sb)) as distortion from k group by budget)"""
DRAWS, DRAW_SEED = 200, 20260926


def depth_curve(spark, sf_dir):
    """(budget, n, rho, bias, distortion): every budget's labels against the deepest ones."""
    out = report.errors_by(depths(spark, sf_dir), "budget", "sa", "sb")
    return out.select("budget", "n", F.when(F.col("n") > 1, F.col("rho")).alias("rho"), "bias", F.col("mae").alias("distortion"))


@query("label_depth_curve", f"{DEPTH_RANKS} select budget, n, round(rho, 6) as rho, round(bias, 4) + 0 as bias, round(distortion, 4) as distortion from m")
def label_depth_curve(spark, sf_dir):
    return depth_curve(spark, sf_dir).select("budget", "n", F.round("rho", 6).alias("rho"), (F.round("bias", 4) + 0).alias("bias"), F.round("distortion", 4).alias("distortion"))


@query("label_depth_verdict", f"""{DEPTH_RANKS}, x as ({resample.drawn_sql('(select i, sa - sb as d from r where budget = 1)', 'd', 'i', DRAWS, DRAW_SEED)}), b as (select quantile_cont(v, 0.025) as low, quantile_cont(v, 0.975) as high from (select sum(w * d) / sum(w) as v from x group by replicate having sum(w) > 0)),
 v as (select max(case when budget = 6 then rho end) as ref, max(case when budget = 1 then rho end) as r20, max(case when budget = 3 then rho end) as r100 from m)
 select round(r20, 6) as r20, round(r100, 6) as r100, round(low, 4) as low, round(high, 4) as high, case when ref <= 0.99 then 'NOT CONVERGED' when 1 - r20 < 0.05 then 'NOT ALIVE' when 1 - r100 <= 0.5 * (1 - r20) then 'JUSTIFIED' else 'ALIVE BUT NOT JUSTIFIED' end as verdict, low > 0 or high < 0 as biased from v, b""")
def label_depth_verdict(spark, sf_dir):
    """The verdict on the curve's own rank correlations: is the reference settled, is there room, does more depth use it; and whether
    the resampled interval of the shallow label's bias leaves zero out."""
    at = lambda budget: F.max(F.when(F.col("budget") == budget, F.col("rho")))
    v = depth_curve(spark, sf_dir).agg(at(6).alias("ref"), at(1).alias("r20"), at(3).alias("r100"))  # seven budgets
    shallow = depths(spark, sf_dir).where("budget = 1").select("i", (F.col("sa") - F.col("sb")).alias("d"))
    means = resample.sums(shallow, "i", ["d"], n=DRAWS, seed=DRAW_SEED).where("weight > 0").select((F.col("s0") / F.col("weight")).alias("value"))
    out = v.crossJoin(F.broadcast(resample.interval(means)))  # one row each
    return out.select(F.round("r20", 6).alias("r20"), F.round("r100", 6).alias("r100"), F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), label.depth_verdict(F.col("ref"), F.col("r20"), F.col("r100")).alias("verdict"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("biased"))


@query("mixed_results_gate", with_positions("select shard, count(*) as n, count(*) filter (where truncated and ok) = 0 as accepted from p group by shard"))
def mixed_results_gate(spark, sf_dir):
    """Shards that still hold provisional results are refused."""
    return positions(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), (F.count_if(F.col("truncated") & F.col("ok")) == 0).alias("accepted"))


@query("mix_30_70", """with e as (select o_orderkey, row_number() over (order by md5('a' || cast(o_orderkey as varchar))) as k from orders where o_orderstatus = 'F'), n as (select o_orderkey, row_number() over (order by md5('b' || cast(o_orderkey as varchar))) as k from orders where o_orderstatus = 'O')
 select kind, count(*) as n, sum(o_orderkey)::bigint as id_sum from (select 'endgame' as kind, o_orderkey from e where k <= round_even(500 * 0.30, 0) union all select 'normal' as kind, o_orderkey from n where k <= 500 - round_even(500 * 0.30, 0)) t group by kind""")
def mix_30_70(spark, sf_dir):
    """A dataset of 500 rows, 30 % of one kind: the first of each in hash order."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    out = dataset.mixed(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "o_orderkey", total=500, share=0.30)
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("id_sum"))


@query("tsv_round_trip", with_positions("select fen, result, game_id, truncated::integer as truncated, count(*) as n from p group by all"))
def tsv_round_trip(spark, sf_dir):
    """Position files written, with lines of a wrong width among them, found as shards and read back."""
    from .core import work_folder

    base = work_folder(spark, "tsv")
    p = positions(spark, sf_dir).select("fen", "result", "game_id", F.col("truncated").cast("int").alias("truncated"))
    readers.write_tsv(p, f"{base}/one", "fen", "result", "game_id", "truncated")
    readers.write_tsv(p.limit(3), f"{base}/bad", "fen", "result")
    return readers.tsv(spark, "positions", f"{base}/one", f"{base}/bad").groupBy("fen", "result", "game_id", "truncated").agg(F.count("*").alias("n"))


