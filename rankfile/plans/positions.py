"""F.col("fen") functions, labels, dataset construction and joins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankfile.functions import fen, label
from rankfile.operators import dataset, rank

from .core import oracle, load, query
from .views import POSITIONS, positions, with_positions

BOARD = "replace(replace(replace(replace(replace(replace(replace(replace(replace(split_part(fen, ' ', 1), '/', ''), '8', '........'), '7', '.......'), '6', '......'), '5', '.....'), '4', '....'), '3', '...'), '2', '..'), '1', '.')"
WHITE = "split_part(fen, ' ', 2) = 'w'"
COUNT = "length(regexp_replace(split_part(fen, ' ', 1), '[^A-Za-z]', '', 'g'))"
PHASE = f"case when {COUNT} <= 8 then '<=8' when {COUNT} <= 12 then '9-12' when {COUNT} <= 20 then '13-20' else '21-32' end"
MATERIAL = " + ".join(f"{v} * (length(replace(split_part(fen, ' ', 1), '{p.lower()}', '')) - length(replace(split_part(fen, ' ', 1), '{p}', '')))" for p, v in (("P", 100), ("N", 320), ("B", 330), ("R", 500), ("Q", 900)))
ID = "game_id, row_idx"


@query("fen_dedup_key", with_positions(f"select {ID}, array_to_string(list_slice(string_split(fen, ' '), 1, 4), ' ') as key from p"))
def fen_dedup_key(spark, sf_dir):
    return positions(spark, sf_dir).select("game_id", "row_idx", fen.dedup_key(F.col("fen")).alias("key"))


@query("fen_piece_count", with_positions(f"select {ID}, {COUNT} as pieces, {PHASE} as phase, {WHITE} as white from p"))
def fen_piece_count(spark, sf_dir):
    n = fen.piece_count(F.col("fen"))
    return positions(spark, sf_dir).select("game_id", "row_idx", n.cast("long").alias("pieces"), fen.phase_bucket(n).alias("phase"), fen.white_to_move(F.col("fen")).alias("white"))


@query("fen_material", with_positions(f"select {ID}, cast({MATERIAL} as bigint) as white_lead, cast(case when {WHITE} then 1 else -1 end * ({MATERIAL}) as bigint) as mover_lead from p"))
def fen_material(spark, sf_dir):
    return positions(spark, sf_dir).select("game_id", "row_idx", fen.material_white(F.col("fen")).cast("long").alias("white_lead"), fen.material_mover(F.col("fen")).cast("long").alias("mover_lead"))


@query("fen_phase_histogram", with_positions(f"select phase, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct, sum(case when phase <> '21-32' and phase <> '13-20' then count(*) else 0 end) over () >= 0.2 * sum(count(*)) over () as endgame_enough from (select {PHASE} as phase from p) group by phase"))
def fen_phase_histogram(spark, sf_dir):
    by = positions(spark, sf_dir).groupBy(fen.phase_bucket(fen.piece_count(F.col("fen"))).alias("phase")).agg(F.count("*").alias("n"))
    every = F.sum("n").over(W.partitionBy())
    low = F.sum(F.when(F.col("phase").isin("<=8", "9-12"), F.col("n")).otherwise(0)).over(W.partitionBy())
    return by.select("phase", "n", F.round(100.0 * F.col("n") / every, 6).alias("pct"), (low >= 0.2 * every).alias("endgame_enough"))


def duck_features(black: bool) -> str:
    king = f"((7 - (instr(b, '{'k' if black else 'K'}') - 1) // 8) * 8 + (instr(b, '{'k' if black else 'K'}') - 1) % 8)"
    turn = f"xor(case when {king} % 8 > 3 then 7 else 0 end, {56 if black else 0})"
    bucket = f"list_extract({fen.KING_BUCKETS}, xor({king}, {turn}) + 1)"
    char = "substr(b, cast((7 - s // 8) * 8 + s % 8 + 1 as integer), 1)"
    own = f"({char} = upper({char})) = {'false' if black else 'true'}"
    return f"list_sort([768 * {bucket} + case when {own} then 0 else 384 end + 64 * (instr('PNBRQK', upper({char})) - 1) + xor(s, {turn}) for s in range(0, 64) if {char} <> '.'])"


@query("fen_features", with_positions(f"select {ID}, array_to_string(w, ',') as white_view, array_to_string(k, ',') as black_view, array_to_string(case when {WHITE} then w else k end, ',') as us from (select *, {duck_features(False)} as w, {duck_features(True)} as k from (select *, {BOARD} as b from p))"))
def fen_features(spark, sf_dir):
    views = positions(spark, sf_dir).select("game_id", "row_idx", fen.white_to_move(F.col("fen")).alias("white"), F.array_join(fen.features(F.col("fen"), False), ",").alias("white_view"), F.array_join(fen.features(F.col("fen"), True), ",").alias("black_view"))
    return views.select("game_id", "row_idx", "white_view", "black_view", F.when(F.col("white"), F.col("white_view")).otherwise(F.col("black_view")).alias("us"))


MIRROR = " || ".join(f"reverse(substr(b, {8 * r + 1}, 8))" for r in range(8))


@query("fen_mirror_key", with_positions(f"select {ID}, least(b, {MIRROR}) || ' ' || split_part(fen, ' ', 2) as key from (select *, {BOARD} as b from p)"))
def fen_mirror_key(spark, sf_dir):
    return positions(spark, sf_dir).select("game_id", "row_idx", fen.mirror_key(F.col("fen")).alias("key"))


TARGET = "substr(b, cast((8 - cast(substr(move, 4, 1) as integer)) * 8 + ascii(substr(move, 3, 1)) - 96 as integer), 1)"
MOVER = "substr(b, cast((8 - cast(substr(move, 2, 1) as integer)) * 8 + ascii(substr(move, 1, 1)) - 96 as integer), 1)"
CAPTURE = f"(({TARGET} <> '.' and ({TARGET} = lower({TARGET})) = ({WHITE})) or (upper({MOVER}) = 'P' and substr(move, 3, 2) = split_part(fen, ' ', 4)))"


@query("move_class_both", with_positions(f"select diagnostic, census, count(*) as n from (select case when length(move) = 5 then 'promotion' when {CAPTURE} then 'capture' else 'quiet' end as diagnostic, case when {CAPTURE} then 'capture' when length(move) = 5 then 'promotion' else 'quiet' end as census from (select *, {BOARD} as b from p)) group by diagnostic, census"))
def move_class_both(spark, sf_dir):
    p = positions(spark, sf_dir).select(fen.move_class(F.col("fen"), F.col("move")).alias("diagnostic"), fen.move_class_census(F.col("fen"), F.col("move")).alias("census"))
    return p.groupBy("diagnostic", "census").agg(F.count("*").alias("n"))


@query("label_blend", with_positions(f"select {ID}, round(0.7 / (1 + exp(-0.005756462732485115 * greatest(-2000, least(2000, eval_cp)))) + 0.3 * case when result = '1/2-1/2' then 0.5 when (result = '1-0') = ({WHITE}) then 1 else 0 end, 6) as target from p"))
def label_blend(spark, sf_dir):
    wdl = label.wdl_of(F.col("result"), fen.white_to_move(F.col("fen")))
    return positions(spark, sf_dir).select("game_id", "row_idx", F.round(label.target(F.col("eval_cp"), wdl, lam=0.7), 6).alias("target"))


@query("wdl_from_result", with_positions(f"select result, {WHITE} as white, case when result = '1/2-1/2' then 0.5 when (result = '1-0') = ({WHITE}) then 1.0 else 0.0 end::double as wdl, count(*) as n from p group by 1, 2, 3"))
def wdl_from_result(spark, sf_dir):
    white = fen.white_to_move(F.col("fen"))
    return positions(spark, sf_dir).groupBy("result", white.alias("white"), label.wdl_of(F.col("result"), white).alias("wdl")).agg(F.count("*").alias("n"))


@query("result_from_eval", with_positions(f"select {ID}, case when abs(eval_cp) <= 200 then '1/2-1/2' when (eval_cp > 0) = ({WHITE}) then '1-0' else '0-1' end as result from p"))
def result_from_eval(spark, sf_dir):
    return positions(spark, sf_dir).select("game_id", "row_idx", label.result_of(F.col("eval_cp"), fen.white_to_move(F.col("fen"))).alias("result"))


KEYED = "k as (select *, array_to_string(list_slice(string_split(fen, ' '), 1, 4), ' ') as key from p)"


def keyed(spark, sf_dir):
    return positions(spark, sf_dir).withColumn("key", fen.dedup_key(F.col("fen"))).withColumn("white", fen.white_to_move(F.col("fen")))


@query("shard_uniqueness", f"with p as ({POSITIONS}), {KEYED} select shard, count(*) as n, sum(case when rn = 1 then 1 else 0 end)::bigint as first_seen, round(100.0 * sum(case when rn = 1 then 1 else 0 end) / count(*), 6) as pct, 100.0 * sum(case when rn = 1 then 1 else 0 end) / count(*) >= 95 as enough from (select *, row_number() over (partition by key order by shard, game_id, row_idx) as rn from k) group by shard")
def shard_uniqueness(spark, sf_dir):
    p = dataset.first_seen(keyed(spark, sf_dir), "key", "shard", "game_id", "row_idx")
    pct = 100.0 * F.count_if("first") / F.count("*")
    return p.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("first").alias("first_seen"), F.round(pct, 6).alias("pct"), (pct >= 95).alias("enough"))


@query("mirror_uniqueness", f"with p as ({POSITIONS}), b as (select *, {BOARD} as b from p) select count(*) as n, count(distinct b || ' ' || split_part(fen, ' ', 2)) as raw, count(distinct least(b, {MIRROR}) || ' ' || split_part(fen, ' ', 2)) as canonical from b")
def mirror_uniqueness(spark, sf_dir):
    p = positions(spark, sf_dir)
    return p.agg(F.count("*").alias("n"), F.count_distinct(F.concat(fen.board64(F.col("fen")), F.lit(" "), fen.field(F.col("fen"), 2))).alias("raw"), F.count_distinct(fen.mirror_key(F.col("fen"))).alias("canonical"))


@query("first_seen_flag", f"with p as ({POSITIONS}), {KEYED} select {ID}, row_number() over (partition by key order by shard, game_id, row_idx) = 1 as first from k")
def first_seen_flag(spark, sf_dir):
    return dataset.first_seen(keyed(spark, sf_dir), "key", "shard", "game_id", "row_idx").select("game_id", "row_idx", "first")


STATUS = f"""with p as ({POSITIONS}), {KEYED}, f as (select *, min(case when ok then shard end) over (partition by key) as fo, row_idx = max(row_idx) over (partition by game_id) as last from k),
 s as (select *, case when fo is null or shard <= fo then 'new' when last and truncated then 'force' else 'dup' end as status from f)"""


@query("status_new_force_dup", f"{STATUS} select shard, status, count(*) as n, sum(case when status = 'new' and ok then 1 else 0 end)::bigint as written from s group by shard, status")
def status_new_force_dup(spark, sf_dir):
    rows = dataset.status(dataset.with_last(keyed(spark, sf_dir), "game_id"))
    return rows.groupBy("shard", "status").agg(F.count("*").alias("n"), F.count_if("written").alias("written"))


@query("failure_gate", f"{STATUS} select sum(case when not ok and status <> 'dup' then 1 else 0 end)::bigint as failed, sum(case when status <> 'dup' then 1 else 0 end)::bigint as asked, round(avg(case when status = 'dup' then null when ok then 0.0 else 1.0 end), 8) as rate, avg(case when status = 'dup' then null when ok then 0.0 else 1.0 end) <= 0.001 as accepted from s")
def failure_gate(spark, sf_dir):
    rows = dataset.status(dataset.with_last(keyed(spark, sf_dir), "game_id"))
    return dataset.failure_gate(rows, max_rate=0.001).withColumn("rate", F.round("rate", 8))


@query("failed_quarantine", f"{STATUS} select fen, row_idx, status = 'force' as is_force, count(*) as n from s where not ok and status <> 'dup' group by all")
def failed_quarantine(spark, sf_dir):
    rows = dataset.status(dataset.with_last(keyed(spark, sf_dir), "game_id")).where("not ok and status <> 'dup'")
    return rows.groupBy("fen", "row_idx", (F.col("status") == "force").alias("is_force")).agg(F.count("*").alias("n"))


@query("truncated_fix", with_positions(f"select {ID}, case when max(truncated) over (partition by game_id) and e is not null then case when abs(e) <= 200 then '1/2-1/2' when (e > 0) = w then '1-0' else '0-1' end else result end as result from (select *, last_value(eval_cp) over g as e, last_value({WHITE}) over g as w from p window g as (partition by game_id order by row_idx, eval_cp, {WHITE} rows between unbounded preceding and unbounded following))"))
def truncated_fix(spark, sf_dir):
    return dataset.corrected(keyed(spark, sf_dir), "game_id").select("game_id", "row_idx", "result")


@query("join_game_id_lastwins", f"with p as ({POSITIONS}), b as (select shard, fen, max(game_id * 10 + row_idx) as k from p group by shard, fen) select p.shard, p.game_id as probe, p.row_idx, b.k // 10 as game_id from p join b on p.shard = b.shard and p.fen = b.fen")
def join_game_id_lastwins(spark, sf_dir):
    p = positions(spark, sf_dir)
    build = p.select("shard", "fen", "game_id", (F.col("game_id") * 10 + F.col("row_idx")).alias("row_idx"))
    return dataset.game_of(p.select("shard", "fen", F.col("game_id").alias("probe"), "row_idx"), build).select("shard", "probe", "row_idx", "game_id")


@query("join_missing_count", f"with p as ({POSITIONS}), b as (select distinct shard, fen from p where ok) select p.shard, count(*) as n, sum(case when b.fen is null then 1 else 0 end)::bigint as missing from p left join b on p.shard = b.shard and p.fen = b.fen group by p.shard")
def join_missing_count(spark, sf_dir):
    p = positions(spark, sf_dir)
    return dataset.game_of(p.select("shard", "fen"), p.where("ok")).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("game_id").isNull()).alias("missing"))


@oracle("results_complete_gate")
def results_complete_gate(d):
    return "select o_orderstatus as shard, count(*) as n, sum(case when c_custkey is null then 1 else 0 end) as missing, sum(case when c_custkey is null then 1 else 0 end) = 0 as accepted from orders left join customer on o_custkey = c_custkey and c_acctbal > -900 group by o_orderstatus"


@oracle("origin_3way")
def origin_3way(d):
    return "select coalesce(n_name, 'unmatched') as origin, o_orderpriority as bucket, count(*) as total, sum(case when l_returnflag = 'R' then 1 else 0 end) as captures, round(cast(100 as double) * sum(case when l_returnflag = 'R' then 1 else 0 end) / count(*), 6) as pct from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey and c_acctbal > 0 left join nation on c_nationkey = n_nationkey group by coalesce(n_name, 'unmatched'), o_orderpriority"


@oracle("pair_matrix")
def pair_matrix(d):
    return """with v as (select o_orderpriority as label, o_custkey as k, avg(o_totalprice) as x from orders group by o_orderpriority, o_custkey)
 select a.label as label_a, b.label as label_b, count(*) as n, round(corr(a.x, b.x), 6) as r from v a join v b on a.k = b.k and a.label < b.label group by a.label, b.label"""


@oracle("overlap_train_eval")
def overlap_train_eval(d):
    return "select count(*) as overlap_n from (select distinct l_partkey from lineitem where l_returnflag = 'R') a join (select distinct l_partkey as k from lineitem where l_returnflag = 'N') b on l_partkey = k"


@oracle("never_annotated")
def never_annotated(d):
    return "select c_custkey from customer anti join orders on c_custkey = o_custkey"


@oracle("bag_difference")
def bag_difference(d):
    return "select k, count(*) as n from (select c_nationkey as k from customer except all select s_nationkey as k from supplier) t group by k"


@oracle("set_equality")
def set_equality(d):
    return "select (select count(*) from (select l_orderkey from lineitem except select o_orderkey from orders) x) = 0 and (select count(*) from (select o_orderkey from orders except select l_orderkey from lineitem) y) = 0 as equal_sets, (select count(*) from (select l_suppkey from lineitem intersect select s_suppkey from supplier) z) as common"


@oracle("failure_reconstruction")
def failure_reconstruction(d):
    """Bag decrement: which input rows have no partner among the written ones, by shard, gated against a log."""
    return """with i as (select l_shipdate as s, l_suppkey as f, row_number() over (partition by l_shipdate, l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem), w as (select l_shipdate as s, l_suppkey as f, row_number() over (partition by l_shipdate, l_suppkey order by l_orderkey, l_linenumber) as rn from lineitem where l_orderkey % 11 <> 0),
 log as (select l_shipdate as s, count(*) as n_log from lineitem where l_orderkey % 11 = 0 group by l_shipdate)
 select cast(i.s as date) as shard, count(*) as n_input, sum(case when w.f is null then 1 else 0 end) as n_failed, coalesce(max(n_log), 0) = sum(case when w.f is null then 1 else 0 end) as matches_log from i left join w on i.s = w.s and i.f = w.f and i.rn = w.rn left join log on i.s = log.s group by i.s"""


@oracle("owner_first_writer")
def owner_first_writer(d):
    return "with o as (select l_partkey as k, min(l_orderkey * 100000 + l_linenumber * 10000 + l_suppkey % 10000) as pos from lineitem group by l_partkey), s as (select l.l_suppkey as shard, min(o.pos) as first_pos, count(*) as keys from o join lineitem l on l.l_partkey = o.k and l.l_orderkey * 100000 + l.l_linenumber * 10000 + l.l_suppkey % 10000 = o.pos group by l.l_suppkey) select shard, dense_rank() over (order by first_pos) - 1 as processing_rank, keys from s"


@oracle("candidate_index")
def candidate_index(d):
    return "select l_orderkey, l_linenumber, sum(case when l_returnflag <> 'R' then 1 else 0 end) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag rows between unbounded preceding and current row) - 1 as idx from lineitem"


SPLIT = "with g as (select o_custkey, min(md5('42:' || cast(o_custkey as varchar))) as h from orders group by o_custkey), r as (select *, row_number() over (order by h, o_custkey) as k, count(*) over () as n from g)"


@query("group_split_native", f"{SPLIT} select case when k <= greatest(1, round_even(n * 0.025, 0)) then 'val' else 'train' end as part, count(*) as n_rows, count(distinct o.o_custkey) as n_groups, sum(o_orderkey)::bigint as id_sum from orders o join r on o.o_custkey = r.o_custkey group by 1")
def group_split_native(spark, sf_dir):
    out = dataset.group_split(load(spark, sf_dir, "orders"), "o_custkey", fraction=0.025, seed=42)
    return out.groupBy("part").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_groups"), F.sum("o_orderkey").alias("id_sum"))


@query("pool_slices", "select shard, count(*) as n, sum(o_orderkey)::bigint as id_sum from (select o_orderkey, (row_number() over (order by md5('1:' || cast(o_orderkey as varchar))) - 1) // 100 as shard from orders) where shard < 10 group by shard")
def pool_slices(spark, sf_dir):
    out = dataset.slices_of(load(spark, sf_dir, "orders"), dataset.hash_order(F.col("o_orderkey"), 1), size=100, count=10)
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("id_sum"))


@query("pool_extension", "select k, epoch, md5('9:' || cast(k as varchar)) as order_key from (select l_partkey as k, 0 as epoch from (select distinct l_partkey from lineitem where l_returnflag = 'R') union all select distinct l_partkey, 1 from lineitem where l_returnflag = 'N' and l_partkey not in (select l_partkey from lineitem where l_returnflag = 'R'))")
def pool_extension(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return dataset.extend_pool(li.where("l_returnflag = 'R'").select("k").distinct(), li.where("l_returnflag = 'N'").select("k"), "k", seed=9).select("k", "epoch", "order_key")


@oracle("composition_report")
def composition_report(d):
    return f"select shard, count(*) as n_rows, count(distinct game_id) as n_games, sum(case when truncated then 1 else 0 end) as n_truncated from ({POSITIONS}) p group by shard"


@oracle("sampled_rows")
def sampled_rows(d):
    """A sample of 200 without replacement in hash order: the sampling operator's own limit."""
    return "select o_orderkey from orders order by md5('7:' || cast(o_orderkey as varchar(20))), o_orderkey limit 200"


@query("csr_offsets", "with o as (select l_orderkey, count(*) as n from lineitem group by l_orderkey) select l_orderkey, n, sum(n) over (order by l_orderkey rows unbounded preceding)::bigint - n as start_at from o")
def csr_offsets(spark, sf_dir):
    o = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return rank.running(o, "l_orderkey", "n", "start_at").select("l_orderkey", "n", "start_at")


@query("pad32", with_positions(f"select {ID}, array_to_string(list_slice(list_concat(w, list_resize([]::bigint[], 32, -1)), 1, 32), ',') as padded, len(w) as n from (select *, {duck_features(False)} as w from (select *, {BOARD} as b from p))"))
def pad32(spark, sf_dir):
    p = positions(spark, sf_dir).select("game_id", "row_idx", fen.padded(fen.features(F.col("fen"), False)).alias("f"))
    return p.select("game_id", "row_idx", F.array_join("f", ",").alias("padded"), F.size(fen.unpadded(F.col("f"))).cast("long").alias("n"))


@query("ragged_from_padded", with_positions(f"select sum(len(w))::bigint as n_values, count(*) as n_rows, sum(list_sum(w))::bigint as total from (select *, {duck_features(False)} as w from (select *, {BOARD} as b from p))"))
def ragged_from_padded(spark, sf_dir):
    p = positions(spark, sf_dir).select(fen.unpadded(fen.padded(fen.features(F.col("fen"), False))).alias("f"))
    total = F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.agg(F.sum(F.size("f")).alias("n_values"), F.count("*").alias("n_rows"), F.sum(total).alias("total"))
