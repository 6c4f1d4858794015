"""Multisets, uniqueness by shard, sampling along sequences, record files, counters and shard feeds."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from rankfile.functions import fen
from rankfile.operators import dataset, multiset, sampling, unique
from rankfile.sources import records
from rankfile.streaming import annotate, feed, progress

from .core import load, query, work_folder
from .positions import BOARD, KEYED, MIRROR, STATUS, WHITE, duck_features, keyed
from .views import POSITIONS, positions, with_positions

FEATURED = f"f as (select *, array_to_string(case when {WHITE} then w else k end, ',') as us from (select *, {duck_features(False)} as w, {duck_features(True)} as k from (select *, {BOARD} as b from p)))"
DIGEST = "md5(length(fen)::varchar || ':' || fen || '|' || length(us)::varchar || ':' || us)"
LANES = f"(sum(('0x' || substr({DIGEST}, 1, 16))::ubigint) % 18446744073709551616)::varchar as high, (sum(('0x' || substr({DIGEST}, 17, 16))::ubigint) % 18446744073709551616)::varchar as low"


def layouts(spark, sf_dir):
    """(shard, fen, us, norm, changed): the mover's features by perspective, by normalised board, and with one element of the rows of one
    position off by one."""
    p = positions(spark, sf_dir).select("game_id", "row_idx", "shard", "fen", fen.us_them(F.col("fen"))[0].alias("us"), fen.features(fen.normalised(F.col("fen")), False).alias("norm"))
    one = p.agg(F.min(F.struct("game_id", "row_idx"))).first()[0]  # one row
    off = (F.col("game_id") == one[0]) & (F.col("row_idx") == one[1])
    text = lambda c: F.array_join(c, ",")
    return p.select("shard", "fen", text("us").alias("us"), text("norm").alias("norm"), F.when(off, text(F.transform("norm", lambda x, i: F.when(i == 0, x + 1).otherwise(x)))).otherwise(text("norm")).alias("changed"))


@query("feature_multisets", f"with p as ({POSITIONS}), {FEATURED} select shard, count(*) as n, {LANES} from f group by shard")
def feature_multisets(spark, sf_dir):
    """The multiset hash of every shard's feature rows, from the normalised board."""
    h = multiset.hashed(layouts(spark, sf_dir), F.col("fen"), F.col("norm"), by=("shard",))
    return h.select("shard", "n", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))


@query("feature_layouts_equal", f"with p as ({POSITIONS}), {FEATURED}, h as (select count(*) as n, {LANES} from f), c as (select count(distinct shard) as shards from p where game_id * 10 + row_idx = (select min(game_id * 10 + row_idx) from p)) select n, high, low, true as equal, shards as found from h, c")
def feature_layouts_equal(spark, sf_dir):
    """The hash of the whole table by one layout, whether the other has the same, and the shards in which a layout that is off in one
    element of one row is found out (there is one)."""
    rows = layouts(spark, sf_dir)
    one, other, changed = (multiset.hashed(rows, F.col("fen"), F.col(c), by=("shard",)) for c in ("us", "norm", "changed"))
    found = multiset.unequal(one, changed, "shard").agg(F.count("*").alias("found"))
    wrong = multiset.unequal(one, other, "shard").agg((F.count("*") == 0).alias("equal"))
    whole = multiset.merged(one)
    return whole.crossJoin(wrong).crossJoin(found).select("n", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"), "equal", "found")  # single rows


@query("uniqueness_by_shard", f"""with p as ({POSITIONS}), {KEYED}, b as (select shard % 10 as part, key, least({BOARD}, {MIRROR.replace('b,', f'({BOARD}),')}) || ' ' || split_part(fen, ' ', 2) as canonical from k),
 r as (select key, min(part) as part from b group by key), c as (select canonical, min(part) as part from b group by canonical), n as (select part, count(*) as n from b group by part)
 select n.part, sum(n.n) over (order by n.part)::bigint as n_rows, sum((select count(*) from r where r.part = n.part)) over (order by n.part)::bigint as raw, sum((select count(*) from c where c.part = n.part)) over (order by n.part)::bigint as canonical from n""")
def uniqueness_by_shard(spark, sf_dir):
    """Exact raw and mirror-canonical counts after each of ten shards, each looked up in the runs that its keys touch."""
    base = work_folder(spark, "unique")
    p = keyed(spark, sf_dir).select((F.col("shard") % 10).alias("part"), F.xxhash64("key").alias("raw"), F.xxhash64(fen.mirror_key(F.col("fen"))).alias("canonical"))
    p.write.partitionBy("part").parquet(f"{base}/keys")
    keys, out = spark.read.parquet(f"{base}/keys"), []
    runs = {c: unique.KeyRuns(spark, f"{base}/{c}") for c in ("raw", "canonical")}
    for part in sorted(r[0] for r in keys.select("part").distinct().collect()):  # ten
        shard = keys.where(F.col("part") == part)
        for c, r in runs.items():
            r.add(shard.select(F.col(c).alias("key")))
        out.append((part, runs["raw"].rows, runs["raw"].unique, runs["canonical"].unique))
    return spark.createDataFrame(out, "part long, n_rows long, raw long, canonical long")


GAME = "select l_orderkey as game_id, l_linenumber as ply, (l_partkey % 5)::varchar as key, l_returnflag = 'R' and l_linenumber % 2 = 0 as in_check, l_discount >= 0.1 and l_linenumber > 5 as game_over, l_partkey, l_suppkey, l_extendedprice from lineitem"
STEP, SKIP, CAP, JITTER = 1, 0, 2, 5


def sampled_sql() -> str:
    jump = lambda game, ply: f"(('0x' || substr(md5('{JITTER}|' || {game}::varchar || '|' || ({ply})::varchar), 1, 8))::bigint % 4)"
    return f"""with recursive g as (select game_id, ply, key, in_check, game_over, row_number() over (partition by game_id order by ply, key, in_check, game_over) as k from (select distinct on (game_id, ply) * from ({GAME}) order by game_id, ply, l_partkey, l_suppkey, l_extendedprice)),
 f(game_id, k, nxt, over, kept, ply, key, hit) as (select game_id, 0::bigint, {SKIP} + {STEP} + {jump('game_id', '-1')}, false, []::varchar[], null::integer, null::varchar, false from (select distinct game_id from g)
 union all select f.game_id, g.k, case when not (f.over or g.game_over) and g.ply >= nxt then g.ply + {STEP} + {jump('g.game_id', 'g.ply')} else nxt end, f.over or g.game_over,
 case when not (f.over or g.game_over) and g.ply >= nxt and len(kept) < {CAP} and not g.in_check and not list_contains(kept, g.key) then list_append(kept, g.key) else kept end, g.ply, g.key,
 not (f.over or g.game_over) and g.ply >= nxt and len(kept) < {CAP} and not g.in_check and not list_contains(kept, g.key) from f join g on g.game_id = f.game_id and g.k = f.k + 1),
 h as (select game_id, ply, key, len(kept) - 1 as place from f where hit) select * from h"""


@query("sampled_plies", f"select game_id, ply::bigint as ply, key, place::bigint as place from ({sampled_sql()})")
def sampled_plies(spark, sf_dir):
    """Plies sampled along every order's lines: jittered steps, checks and repeats dropped, two a game, none after its end."""
    return sampling.sampled_plies(lines(spark, sf_dir), step=STEP, skip=SKIP, cap=CAP, seed=JITTER)


@query("sampled_once_a_shard", f"select game_id % 50 as shard, game_id, ply::bigint as ply, key, place::bigint as place from (select *, row_number() over (partition by game_id % 50, key order by game_id, ply) as rn from ({sampled_sql()})) where rn = 1")
def sampled_once_a_shard(spark, sf_dir):
    """Of the sampled plies of fifty shards the first of each key."""
    kept = sampled_plies(spark, sf_dir).withColumn("shard", F.col("game_id") % 50)
    return sampling.once_a_shard(kept, "shard").select("shard", "game_id", "ply", "key", "place")


def lines(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("ply"), (F.col("l_partkey") % 5).cast("string").alias("key"), ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") % 2 == 0)).alias("in_check"), ((F.col("l_discount") >= 0.1) & (F.col("l_linenumber") > 5)).alias("game_over"), "l_partkey", "l_suppkey", "l_extendedprice")
    # an order may have a line number twice: the first counts
    first = rows.groupBy("game_id", "ply").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "key", "in_check", "game_over")).alias("f"))
    return first.select("game_id", "ply", "f.key", "f.in_check", "f.game_over")


RECORD = {"id": ("i8", 0), "us": ("i2", 32), "cp": ("i4", 0)}


@query("record_round_trip", f"with p as ({POSITIONS}), {FEATURED} select game_id * 10 + row_idx as id, eval_cp as cp, us from f where eval_cp >= -1950")
def record_round_trip(spark, sf_dir):
    """Feature arrays written as fixed-width records, two of their columns read back by byte ranges under a condition."""
    base = work_folder(spark, "records")
    p = positions(spark, sf_dir).select((F.col("game_id") * 10 + F.col("row_idx")).alias("id"), fen.us_them(F.col("fen"))[0].alias("us"), F.col("eval_cp").alias("cp"))
    records.write(p, f"{base}/rec", RECORD)
    back = records.read(spark, f"{base}/rec", RECORD, columns=["id", "us", "cp"], where=[("cp", ">=", -1950)], part_bytes=1 << 20)
    return back.select("id", "cp", F.array_join(F.filter("us", lambda x: x >= 0), ",").alias("us"))


@query("dropped_counts", with_positions(f"select count(*) as n_rows, count(*) filter (where rule is null) as n_kept, count(*) filter (where rule = 'unlabelled') as unlabelled, count(*) filter (where rule = 'over_limit') as over_limit, count(*) filter (where rule = 'provisional') as provisional, count(*) filter (where rule is null and {WHITE}) as kept_white from (select *, case when not ok then 'unlabelled' when abs(eval_cp) > 1500 then 'over_limit' when truncated then 'provisional' end as rule from p)"))
def dropped_counts(spark, sf_dir):
    """What each rule drops, observed while the kept rows are written: one scan."""
    base = work_folder(spark, "kept")
    rules = {"unlabelled": ~F.col("ok"), "over_limit": F.abs("eval_cp") > 1500, "provisional": F.col("truncated")}
    rows, seen = progress.kept(positions(spark, sf_dir), rules)
    rows.write.parquet(f"{base}/rows")
    white = spark.read.parquet(f"{base}/rows").agg(F.count_if(fen.white_to_move(F.col("fen"))).alias("kept_white"))
    counts = seen.get
    return white.select(*(F.lit(counts[c]).cast("long").alias(c) for c in ("n_rows", "n_kept", *rules)), "kept_white")


@query("shard_feed", f"{STATUS}, w as (select count(*) filter (where status = 'new') as n_new, count(*) filter (where status = 'new' and ok) as n_written, min(shard) as low, max(shard) as high from s) select (shard - low) * 12 // (high - low + 1) + 1 as part, count(*) as n, max(n_new)::bigint as n_new, max(n_written)::bigint as n_written from s, w group by 1")
def shard_feed(spark, sf_dir):
    """Twelve pairs of shard files, fed to the status query as they become whole, over three runs; counts from its status file."""
    base = work_folder(spark, "feed")
    rows = keyed(spark, sf_dir)
    low, high = rows.agg(F.min("shard"), F.max("shard")).first()
    part = F.floor((F.col("shard") - low) * 12 / (high - low + 1)) + 1
    rows = dataset.with_last(rows, "game_id").withColumn("row", F.col("game_id") * 10 + F.col("row_idx"))
    text = F.concat_ws("\t", "key", F.col("shard").cast("string"), F.col("row").cast("string"), *(F.col(c).cast("string") for c in annotate.FLAGS))
    rows = rows.select(part.alias("part"), "row", text.alias("value"))
    listed = progress.StatusFile(spark, f"{base}/status.json", f"feed-{base[-8:]}")
    spark.streams.addListener(listed)
    first = paired = 0
    try:
        for positions_to, pairs_to in ((5, 3), (9, 9), (12, 12)):
            # files without their second one wait for a later run
            some = rows.where((F.col("part") > first) & (F.col("part") <= positions_to)).select(F.col("part").alias("shard"), "row", "value")
            feed.write_shard_files(some, f"{base}/shards", feed.FIRST).collect()  # a row a shard
            done = spark.range(paired + 1, pairs_to + 1).select(F.col("id").alias("shard"), F.col("id").alias("row"), F.lit("done").alias("value"))
            feed.write_shard_files(done, f"{base}/shards", feed.SECOND).collect()
            first, paired = positions_to, pairs_to
            annotate.annotate_stream(annotated_lines(feed.shard_stream(spark, f"{base}/shards", part_bytes=1 << 20)), f"{base}/out", max_failed_rate=1.0, checkpoint=f"{base}/c", name=listed.name).awaitTermination()
        progress.hear_out(spark)
    finally:
        spark.streams.removeListener(listed)
    status = json.loads("".join(r[0] for r in spark.read.text(f"{base}/status.json").collect()))
    if status["stato"] != "completato":
        raise RuntimeError(f"the feed ended as {status}")
    by = spark.read.parquet(f"{base}/out/rows").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    return by.select("part", "n", F.lit(status["n_new"]).cast("long").alias("n_new"), F.lit(status["n_written"]).cast("long").alias("n_written"))


def annotated_lines(stream):
    """The fields of a feed's lines."""
    at = lambda i: F.element_at(F.split("value", "\t"), i)
    return stream.select(at(1).alias("key"), at(2).cast("long").alias("shard"), at(3).cast("long").alias("row_idx"), *(at(4 + i).cast("boolean").alias(c) for i, c in enumerate(annotate.FLAGS)))
