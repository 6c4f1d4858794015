"""Remaining filters, gates, orders and checks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.functions import fen
from rankfile.operators import dataset, rank

from .core import oracle, load, query
from .positions import BOARD
from .statistics import GAPS, gaps, tail_shares
from .views import POSITIONS, positions, with_positions


@oracle("mate_discard")
def mate_discard(d):
    return "select kind, count(*) as n, sum(case when kind = 'cp' and abs(score) <= 48936 then 1 else 0 end) as used, sum(case when move in ('', 'NONE') then 1 else 0 end) as without_move from (select case when l_linenumber = 7 then 'mate' else 'cp' end as kind, l_extendedprice as score, case l_suppkey % 5 when 0 then '' when 1 then 'NONE' else 'e2e4' end as move from lineitem) t group by kind"


@query("clamped_sensitivity", f"select class, count(*) as n_all, sum(case when abs(search_cp) < 800 then 1 else 0 end)::bigint as n_unclamped, round(quantile_cont(gap, 0.5), 6) as median_all, round(quantile_cont(case when abs(search_cp) < 800 then gap end, 0.5), 6) as median_unclamped from ({GAPS}) group by class")
def clamped_sensitivity(spark, sf_dir):
    """Medians with and without clamped evaluations."""
    g = gaps(spark, sf_dir).select("class", "gap", F.when(F.abs("search_cp") < 800, F.col("gap")).alias("free"))
    out = rank.profile(g, ("class",), {"median_all": ("gap", 0.5), "median_unclamped": ("free", 0.5)}, sums={"_free": F.col("free").isNotNull().cast("int")})
    return out.select("class", F.col("n").alias("n_all"), F.col("_free").cast("long").alias("n_unclamped"), F.round("median_all", 6).alias("median_all"), F.round("median_unclamped", 6).alias("median_unclamped"))


@oracle("limit_prefix")
def limit_prefix(d):
    """The first rows in file order: the reader's own --limit."""
    return "select o_orderkey from orders order by o_orderkey limit 500"


@oracle("shard_pairs")
def shard_pairs(d):
    """Shards of a numbered range for which both files exist."""
    pad = "lpad(cast({} as varchar(9)), 5, '0')"
    return f"select 'gen3_shard_' || {pad.format('a.k')} as shard from (select distinct s_suppkey as k from supplier where s_suppkey between 1 and 60) a join (select distinct l_suppkey as k from lineitem where l_returnflag = 'R') b on a.k = b.k"


@oracle("pending_shards")
def pending_shards(d):
    return "select f.k as shard from (select distinct l_suppkey as k from lineitem) f left join (select distinct l_suppkey as k from lineitem where l_shipdate < timestamp '1995-01-01 00:00:00') w on f.k = w.k where w.k is null"


@oracle("mates_by_budget")
def mates_by_budget(d):
    return "select l_linenumber as budget, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as mates, max(case when abs(l_extendedprice) > 50000 then 1 else 0 end) = 1 as any_clamped from lineitem group by l_linenumber"


STRATA = """with x as (select a.l_returnflag as class, a.l_linestatus as bucket, abs(a.l_extendedprice - b.l_extendedprice) / 50 as off from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = 1 and b.l_linenumber = 2),
 c as (select class, bucket, count(*) as n, quantile_cont(off, 0.5) as m from x group by class, bucket), dom as (select k.class as class, b.bucket as bucket from (select 'A' as class union all select 'N' union all select 'R' union all select 'X') k, (select 'F' as bucket union all select 'O') b)
 select dom.class, dom.bucket, coalesce(n, 0) as n, round(m, 4) as median_off, coalesce(n, 0) < 100 as underpowered from dom left join c on dom.class = c.class and dom.bucket = c.bucket"""


@query("label_depth_strata", STRATA)
def label_depth_strata(spark, sf_dir):
    """What a shallow label is off, by class and bucket of the fixed domain."""
    li = load(spark, sf_dir, "lineitem")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.col("l_returnflag").alias("class"), F.col("l_linestatus").alias("bucket"), F.col("l_extendedprice").alias("x"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.col("l_extendedprice").alias("y"))
    off = a.join(b, "l_orderkey").select("class", "bucket", (F.abs(F.col("x") - F.col("y")) / 50).cast("double").alias("off"))
    cells = rank.profile(off, ("class", "bucket"), {"m": ("off", 0.5)})
    domain = spark.createDataFrame([(c, b) for c in "ANRX" for b in "FO"], "class string, bucket string")
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(domain).join(cells, ["class", "bucket"], "left").select("class", "bucket", n.alias("n"), F.round("m", 4).alias("median_off"), (n < 100).alias("underpowered"))


TAIL = f"""with g as ({GAPS}), k as (select *, row_number() over (partition by bucket order by gap desc, id) as rn, count(*) over (partition by bucket) as n, sum(case when class = 'R' then 1 else 0 end) over (partition by bucket) as m from g),
 t as (select bucket, avg(case when rn <= round_even(0.1 * n, 0) and class = 'R' then cast(1 as double) when rn <= round_even(0.1 * n, 0) then cast(0 as double) end) / avg(case when class = 'R' then cast(1 as double) else cast(0 as double) end) as lift, quantile_cont(case when class = 'R' then gap end, 0.9) / quantile_cont(case when class <> 'R' then gap end, 0.9) as p90, (sum(case when rn <= m then gap * gap else 0 end) - sum(case when class = 'R' then gap * gap else 0 end)) / sum(gap * gap) as margin from k group by bucket)
 select bucket, round(lift, 6) as lift10, round(p90, 6) as p90_ratio, lift >= 2 as a_met, p90 > 1.2 as b_met, min(case when lift >= 2 and p90 > 1.2 then 1 else 0 end) over () = 1 as c_met, round(margin, 6) as margin, margin >= 0.10 as separate from t"""


@query("tail_verdict", TAIL)
def tail_verdict(spark, sf_dir):
    """The tail's point estimates by bucket; tail_decision decides on the interval."""
    g = gaps(spark, sf_dir).select("id", "bucket", "gap", (F.col("class") == "R").alias("hard"))
    g = g.withColumns({"in_": F.when(F.col("hard"), F.col("gap")), "out_": F.when(~F.col("hard"), F.col("gap"))})
    t = tail_shares(g).join(rank.profile(g, ("bucket",), {"hi": ("in_", 0.9), "lo": ("out_", 0.9)}), "bucket")
    t = t.select("bucket", F.col("lift10").alias("lift"), (F.col("hi") / F.col("lo")).alias("p90"), "margin")
    met = (F.col("lift") >= 2) & (F.col("p90") > 1.2)
    all_met = F.min(met.cast("int")).over(W.partitionBy()) == 1  # a row for each of a few buckets
    return t.select("bucket", F.round("lift", 6).alias("lift10"), F.round("p90", 6).alias("p90_ratio"), (F.col("lift") >= 2).alias("a_met"), (F.col("p90") > 1.2).alias("b_met"), all_met.alias("c_met"), F.round("margin", 6).alias("margin"), (F.col("margin") >= 0.10).alias("separate"))


@query("multi_key_report", "select row_number() over (order by l_discount desc, l_tax, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place, l_orderkey, l_linenumber from lineitem")
def multi_key_report(spark, sf_dir):
    """Places of a multi-key order: rows are told apart by a digest of the later keys, which sorts like them."""
    li = load(spark, sf_dir, "lineitem").select("l_discount", "l_tax", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return dataset.placed(li, [("l_discount", True), ("l_tax", False), ("l_orderkey", False), ("l_linenumber", False), ("l_partkey", False), ("l_suppkey", False), ("l_extendedprice", False)], "place").select("place", "l_orderkey", "l_linenumber")


@query("chunk_split", "select cast(trunc(floor((k - 1) / ceil(n / 4.0))) as int) as chunk, cast((k - 1) % 4 as int) as worker, count(*) as n_rows from (select row_number() over (order by o_orderkey) as k, count(*) over () as n from orders) t group by 1, 2")
def chunk_split(spark, sf_dir):
    """Contiguous chunks of ceil(n / workers), and round robin."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    k, size = F.col("k") - 1, F.ceil(F.lit(o.count() / 4.0))
    return rank.numbered(o, "o_orderkey", "o_orderkey").groupBy(F.floor(k / size).cast("int").alias("chunk"), (k % 4).cast("int").alias("worker")).agg(F.count("*").alias("n_rows"))


@oracle("top_column_sums")
def top_column_sums(d):
    """Largest possible accumulator: the sum of the 32 largest magnitudes of each group."""
    return "select k, round(sum(w), 6) as worst, sum(w) > 32767 as overflows from (select l_suppkey as k, abs(l_extendedprice) as w, row_number() over (partition by l_suppkey order by abs(l_extendedprice) desc) as rn from lineitem) t where rn <= 32 group by k"


@query("key_digest", with_positions("select game_id, row_idx, substr(sha256(array_to_string(list_slice(string_split(fen, ' '), 1, 4), ' ')), 1, 16) as digest from p"))
def key_digest(spark, sf_dir):
    return positions(spark, sf_dir).select("game_id", "row_idx", F.lower(F.hex(fen.key_hash(F.col("fen")))).alias("digest"))


PLAIN_CHAR = "substr(b, cast((7 - s // 8) * 8 + s % 8 + 1 as integer), 1)"
PLAIN_TURN = "case when ((instr(b, 'K') - 1) % 8) > 3 then 0 else 7 end"


@query("features_plain_sums", with_positions(f"select game_id, row_idx, array_to_string(list_sort([case when {PLAIN_CHAR} = upper({PLAIN_CHAR}) then 0 else 384 end + 64 * (instr('PNBRQK', upper({PLAIN_CHAR})) - 1) + xor(s, {PLAIN_TURN}) for s in range(0, 64) if {PLAIN_CHAR} <> '.']), ',') as features from (select *, {BOARD} as b from p)"))
def features_plain_sums(spark, sf_dir):
    p = positions(spark, sf_dir).select("game_id", "row_idx", fen.features_plain(F.col("fen"), False).alias("w"))
    return p.select("game_id", "row_idx", F.array_join("w", ",").alias("features"))


@query("shard_names", with_positions("select distinct 'gen3_shard_' || lpad(shard::varchar, 5, '0') as shard_id, 'gen3_shard_' || lpad(shard::varchar, 5, '0') || '_' || game_id as game from p"))
def shard_names(spark, sf_dir):
    s = fen.shard_id(3, F.col("shard"))
    return positions(spark, sf_dir).select(s.alias("shard_id"), fen.qualified_game(s, F.col("game_id")).alias("game")).distinct()


@query("manifest_rows", f"with p as ({POSITIONS}) select shard, count(*) as positions_extracted, count(distinct game_id) as games_actual, round(avg(case when truncated then 1.0 else 0.0 end), 4) as truncated_share, count(distinct game_id)::varchar as annotation_games from p group by shard")
def manifest_rows(spark, sf_dir):
    """A manifest row a shard with a patched count, through the JSON map."""
    from rankfile.sources import readers

    m = positions(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("positions_extracted"), F.count_distinct("game_id").alias("games_actual"), F.round(F.avg(F.col("truncated").cast("double")), 4).alias("truncated_share"))
    rows = m.withColumn("every", F.from_json(F.to_json(F.struct("positions_extracted")), "map<string,string>"))
    out = readers.patched(rows, m.select("shard", F.col("games_actual").alias("games")), key="shard")
    return out.select("shard", "positions_extracted", "games_actual", "truncated_share", F.col("every")["annotation_games"].alias("annotation_games"))


@query("stateful_first_ok", f"with p as ({POSITIONS}), k as (select *, array_to_string(list_slice(string_split(fen, ' '), 1, 4), ' ') as key from p) select key, min(case when ok then shard end) as first_ok, count(*) as n from k group by key")
def stateful_first_ok(spark, sf_dir):
    p = positions(spark, sf_dir).withColumn("key", fen.dedup_key(F.col("fen")))
    return p.groupBy("key").agg(F.min(F.when(F.col("ok"), F.col("shard"))).alias("first_ok"), F.count("*").alias("n"))


@query("subset_spread")
def subset_spread(spark, sf_dir):
    """Spread of rho over random subsets without replacement, by size; subsets are ranges of a hash, so no row is collected."""
    g = gaps(spark, sf_dir).select("id", "static_cp", "search_cp")
    out = None
    for share in (2, 4, 8):
        part = g.withColumn("rep", F.pmod(F.xxhash64(F.lit(share), "id"), F.lit(share)).cast("string"))
        one = rank.spearman_by(part, "rep", "static_cp", "search_cp", degenerate="nan").agg(F.avg("n").alias("size"), F.stddev_samp("rho").alias("sd"))
        out = one if out is None else out.unionByName(one)
    return out


@query("exact_multiset_difference", "select l_suppkey as k, count(*) as n from (select l_suppkey from lineitem where l_returnflag = 'R' except all select l_suppkey from lineitem where l_returnflag = 'A') group by 1")
def exact_multiset_difference(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_returnflag")
    return dataset.bag_difference(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "k").groupBy("k").agg(F.count("*").alias("n"))
