"""Queries over the library's functions whose SQL stands beside them in the other modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankfile.functions import fen, label
from rankfile.operators import dataset, report
from rankfile.sources import readers

from .core import load, query
from .views import gaps, positions


def rounded(df, digits: int, *names: str):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("mate_discard")
def mate_discard(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 7, "mate").otherwise("cp").alias("kind"), F.col("l_extendedprice").alias("score"), F.expr("case l_suppkey % 5 when 0 then '' when 1 then 'NONE' else 'e2e4' end").alias("move"))
    return li.groupBy("kind").agg(F.count("*").alias("n"), F.count_if((F.col("kind") == "cp") & (F.abs("score") <= 48936)).alias("used"), F.count_if(F.col("move").isin("", "NONE")).alias("without_move"))


@query("limit_prefix")
def limit_prefix(spark, sf_dir):
    """The first rows in file order: the reader's own --limit."""
    return load(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey").limit(500)


@query("shard_pairs")
def shard_pairs(spark, sf_dir):
    """Shards of a numbered range for which both files exist."""
    number = lambda df, c: df.select(fen.shard_id(3, F.col(c)).alias("shard_id")).distinct()
    s = number(load(spark, sf_dir, "supplier"), "s_suppkey")
    both = readers.shard_range(s, 3, 1, 60).join(number(load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_suppkey"), "shard_id", "left_semi")
    return both.select(F.col("shard_id").alias("shard"))


@query("pending_shards")
def pending_shards(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shard_id"), "l_shipdate")
    done = li.where(F.col("l_shipdate") < F.lit("1995-01-01").cast("timestamp")).select("shard_id").distinct()
    return readers.pending(li.select("shard_id").distinct(), done).select(F.col("shard_id").alias("shard"))


@query("mates_by_budget")
def mates_by_budget(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("budget")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("mates"), F.bool_or(F.abs("l_extendedprice") > 50000).alias("any_clamped"))


@query("top_column_sums")
def top_column_sums(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), "l_extendedprice")
    return rounded(report.worst_sums(li, "k", F.abs("l_extendedprice")), 6, "worst")


@query("text_pattern_filter")
def text_pattern_filter(spark, sf_dir):
    return load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike("[0-9]+[.][0-9]+")).alias("with_numbers"), F.sum(F.length("text")).alias("chars"))


@query("missing_references")
def missing_references(spark, sf_dir):
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    known = spark.createDataFrame([("www.example.com",)], "host string")
    return load(spark, sf_dir, "pages").select(host.alias("host")).join(F.broadcast(known), "host", "left_anti").groupBy("host").agg(F.count("*").alias("n"))


@query("document_digests")
def document_digests(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("tail_distribution")
def tail_distribution(spark, sf_dir):
    out = report.tails(gaps(spark, sf_dir), "class", "gap", (1, 2, 3))
    return rounded(out, 6, *out.columns[1:])


@query("mae_rmse_clamped")
def mae_rmse_clamped(spark, sf_dir):
    g = gaps(spark, sf_dir).withColumns({"s": report.clamped(F.col("static_cp")), "t": report.clamped(F.col("search_cp"))})
    e = report.errors(F.col("s"), F.col("t"))
    out = g.groupBy("class").agg(F.count("*").alias("n"), *(c.alias(n) for n, c in e.items()), F.stddev_pop("t").alias("sd"), F.count_if(F.abs("search_cp") > 2000).alias("clamped"), report.share((F.col("static_cp") > 0) == (F.col("search_cp") > 0)).alias("agree"))
    return rounded(rounded(out, 4, "bias", "mae", "rmse", "sd"), 6, "agree")


@query("mae_by_budget")
def mae_by_budget(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("budget"), (F.col("l_quantity") * 40).cast("double").alias("x"), (F.col("l_extendedprice") / 50).cast("double").alias("y"))
    return rounded(rounded(report.errors_by(li, "budget", "x", "y"), 4, "mae", "rmse"), 6, "rho").select("budget", "n", "mae", "rmse", "rho")


@query("pov_check")
def pov_check(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2 == 0).alias("white"), (F.col("l_quantity") * 40 - 1000).cast("int").alias("material"), (F.col("l_extendedprice") / 50 - 1000).cast("double").alias("cp"))
    return rounded(report.point_of_view(li, white="white", material="material", cp="cp"), 6, "white_agree", "black_contrast")


@query("predictor_losses")
def predictor_losses(spark, sf_dir):
    of = lambda x: label.sigmoid(label.K * label.clamp(x.cast("double")))
    out = report.predictor_losses(load(spark, sf_dir, "lineitem"), of(F.col("l_extendedprice") / 50 - 1000), of(F.col("l_quantity") * 40 - 1000))
    return rounded(out, 6, "constant_loss", "material_loss", "untrained_loss")


@query("elo_intervals")
def elo_intervals(spark, sf_dir):
    flags = {"w": "A", "l": "R", "dr": "N"}
    m = load(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("pair")).agg(*(F.count_if(F.col("l_returnflag") == f).cast("double").alias(n) for n, f in flags.items()))
    e = report.elo(m, "pair", won="w", lost="l", drawn="dr").withColumn("n", F.col("n").cast("long"))
    e = rounded(rounded(e, 3, "elo", "low", "high", "combined", "chain_se"), 8, "zero_event_bound")
    return rounded(e, 5, "superiority").select("pair", "n", "elo", "low", "high", "combined", "chain_se", "zero_event_bound", "superiority")


@query("inheritance_verdict")
def inheritance_verdict(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("x"))
    noisy = {n: F.col("x") + F.sin(F.col("k") * a) * b for n, a, b in (("student1", 1.1, 8000), ("student2", 1.7, 9000), ("ancestor", 2.3, 90000), ("unrelated", 3.1, 200000))}
    out = report.inheritance(o.withColumns(noisy), "x", ["student1", "student2"], ["ancestor", "unrelated"])
    return rounded(out.withColumnsRenamed({"m_student1": "master1", "m_student2": "master2"}), 6, "master1", "master2", "floor_")


def epochs(spark, sf_dir, name: str):
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("run"), F.col("l_linenumber").alias("epoch")).agg(F.avg("l_discount").alias(name))


@query("epoch_best")
def epoch_best(spark, sf_dir):
    return rounded(report.best_epoch(epochs(spark, sf_dir, "val_loss"), "run", "epoch", "val_loss"), 8, "val_loss")


@query("early_stop")
def early_stop(spark, sf_dir):
    return report.early_stop(epochs(spark, sf_dir, "v"), "run", "epoch", "v", patience=3)


@query("learning_rate")
def learning_rate(spark, sf_dir):
    by = load(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("epoch")).agg(F.count("*").alias("n"))
    return by.select("epoch", F.round(label.cosine_rate(F.col("epoch"), F.lit(7), 1e-3), 10).alias("lr"), "n")


@query("results_complete_gate")
def results_complete_gate(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("shard"), F.col("o_custkey").alias("k"))
    return dataset.complete_shards(o, load(spark, sf_dir, "customer").where("c_acctbal > -900").select(F.col("c_custkey").alias("k")), "shard", "k")


@query("origin_3way")
def origin_3way(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", "c_nationkey")
    rows = report.origins(li, [(o, "l_orderkey", "o_orderkey"), (c, "o_custkey", "c_custkey"), (load(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey")], "n_name")
    captures = F.count_if(F.col("l_returnflag") == "R")
    return rows.groupBy("origin", F.col("o_orderpriority").alias("bucket")).agg(F.count("*").alias("total"), captures.alias("captures"), F.round(100.0 * captures / F.count("*"), 6).alias("pct"))


@query("pair_matrix")
def pair_matrix(spark, sf_dir):
    v = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").cast("double").alias("x"))
    return rounded(report.pair_matrix(v, "label", "k", "x"), 6, "r")


@query("overlap_train_eval")
def overlap_train_eval(spark, sf_dir):
    part = lambda flag: load(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).select("l_partkey")
    return report.equal_sets(part("R"), part("N"), "l_partkey").select(F.col("common").alias("overlap_n"))


@query("never_annotated")
def never_annotated(spark, sf_dir):
    return load(spark, sf_dir, "customer").select("c_custkey").join(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("bag_difference")
def bag_difference(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return dataset.bag_difference(c, s, "k").groupBy("k").agg(F.count("*").alias("n"))


@query("set_equality")
def set_equality(spark, sf_dir):
    li, o, s = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders"), load(spark, sf_dir, "supplier")
    equal = report.equal_sets(li.select(F.col("l_orderkey").alias("k")), o.select(F.col("o_orderkey").alias("k")), "k").select("equal_sets")
    return equal.crossJoin(F.broadcast(report.equal_sets(li.select(F.col("l_suppkey").alias("k")), s.select(F.col("s_suppkey").alias("k")), "k").select("common")))


@query("failure_reconstruction")
def failure_reconstruction(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("shard"), F.col("l_suppkey").alias("f"), "l_orderkey")
    written = li.where("l_orderkey % 11 <> 0")
    log = li.where("l_orderkey % 11 = 0").groupBy("shard").agg(F.count("*").alias("n_log"))
    return report.failures(li, written, log, "shard", "f")


@query("owner_first_writer")
def owner_first_writer(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("shard"), (F.col("l_orderkey") * 100_000 + F.col("l_linenumber") * 10_000 + F.col("l_suppkey") % 10_000).alias("pos"))
    return report.owners(li, "k", "shard", "pos").select("shard", "processing_rank", "keys")


@query("candidate_index")
def candidate_index(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    return report.running_index(li, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], F.col("l_returnflag") != "R", "idx").select("l_orderkey", "l_linenumber", "idx")


@query("composition_report")
def composition_report(spark, sf_dir):
    return positions(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), F.count_distinct("game_id").alias("n_games"), F.count_if("truncated").alias("n_truncated"))


@query("sampled_rows")
def sampled_rows(spark, sf_dir):
    """A sample of 200 without replacement in hash order: the sampling operator's own limit."""
    o = load(spark, sf_dir, "orders").select("o_orderkey")
    return o.orderBy(dataset.hash_order(F.col("o_orderkey"), 7), "o_orderkey").limit(200)
