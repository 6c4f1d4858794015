import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfile.functions import fen, label
from rankfile.operators import dataset, model, rank, sampling
from rankfile.sources import readers
from rankfile.streaming import annotate

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def test_fen_of_the_start(spark):
    f = F.col("f")
    r = spark.createDataFrame([(START,)], ["f"]).select(fen.piece_count(f).alias("n"), fen.material_white(f).alias("m"), F.size(fen.features(f, False)).alias("k"), fen.dedup_key(f).alias("key"), fen.phase_bucket(fen.piece_count(f)).alias("b"), fen.features(f, False).alias("w"), fen.features(f, True).alias("x")).first()
    assert (r.n, r.m, r.k, r.b) == (32, 0, 32, "21-32")
    assert r.key == START.rsplit(" ", 2)[0]
    assert r.w == r.x  # the start is symmetric


@pytest.mark.parametrize(("cp", "white", "want"), [(200, True, "1/2-1/2"), (-200, True, "1/2-1/2"), (201, True, "1-0"), (201, False, "0-1"), (-201, False, "1-0")])
def test_band_is_inclusive(spark, cp, white, want):
    assert spark.range(1).select(label.result_of(F.lit(cp), F.lit(white))).first()[0] == want


def test_star_counts_as_black(spark):
    assert spark.range(1).select(label.wdl_of(F.lit("*"), F.lit(True)), label.wdl_of(F.lit("*"), F.lit(False))).first()[:] == (0.0, 1.0)


def test_status_by_simulation(spark):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(i), f"k{rng.integers(6)}", bool(rng.random() < 0.7), bool(rng.random() < 0.3), bool(rng.random() < 0.5)) for s in range(8) for i in range(6)]
    df = spark.createDataFrame(rows, "shard long, row_idx long, key string, ok boolean, last boolean, truncated boolean")
    seen, want = set(), {}
    for s in range(8):
        fresh = set()
        for sh, i, k, ok, last, cut in rows:
            if sh == s:
                want[s, i] = "new" if k not in seen else "force" if last and cut else "dup"
                if k not in seen and ok:
                    fresh.add(k)
        seen |= fresh
    assert {(r.shard, r.row_idx): r.status for r in dataset.status(df).collect()} == want


def test_stream_equals_batch_and_gate(spark, tmp_path):
    rows = [(s, i, f"k{(s * i) % 5}", (s + i) % 4 > 0, i == 3, s % 2 == 0) for s in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, "shard long, row_idx long, key string, ok boolean, last boolean, truncated boolean")
    for n in range(3):
        df.where(F.floor(F.col("shard") / 2) == n).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = annotate.annotate_stream(stream(), str(tmp_path / "out"), max_failed_rate=1.0, checkpoint=str(tmp_path / "c"))
    q.awaitTermination()
    got = {(r.shard, r.row_idx): r.status for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert got == {(r.shard, r.row_idx): r.status for r in dataset.status(df).collect()}
    assert json.loads(annotate.status_json(q))["stato"] == "completato"
    q = annotate.annotate_stream(stream(), str(tmp_path / "out2"), max_failed_rate=0.0, checkpoint=str(tmp_path / "c2"))
    with pytest.raises(Exception, match="failed"):
        q.awaitTermination()
    assert not (tmp_path / "out2/rows").exists()


def test_split_is_by_group_and_exact(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 101)
    out = dataset.group_split(df, "g", fraction=0.1, seed=1)
    assert out.count() == 1000
    assert out.where("part = 'val'").select("g").distinct().count() == 10
    assert out.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0


def test_pool_exhaustion(spark):
    with pytest.raises(ValueError):
        dataset.slices_of(spark.range(10), F.col("id"), size=4, count=3)


def test_rank_and_degenerate(spark):
    v = np.random.default_rng(0).integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(i, float(x), 1.0) for i, x in enumerate(v)], "id long, v double, c double")
    got = {r.id: r.r for r in rank.average_rank(df, "v", "r").collect()}
    assert np.allclose([got[i] for i in range(500)], rank.ranks(v))
    assert np.isnan(rank.spearman(df, "v", "c", degenerate="nan").first().rho)
    assert rank.spearman(df, "v", "c", degenerate="zero").first().rho == 0


def test_bootstrap_refuses_more_than_it_can_broadcast(spark):
    with pytest.raises(ValueError):
        rank.bootstrap(spark.range(10).selectExpr("cast(id as double) x"), ["x"], lambda x: 0.0, n=2, seed=1, most=9)


def test_tsv_drops_wrong_width(spark, tmp_path):
    (tmp_path / "gen3_shard_00001_positions.txt").write_text(f"{START}\t1-0\t5\t0\nbad\tline\n{START}\t*\t6\t1\n")
    rows = readers.tsv(spark, "positions", str(tmp_path)).orderBy("row_idx").collect()
    assert [(r.shard_id, r.game_id, r.truncated) for r in rows] == [("gen3_shard_00001", 5, 0), ("gen3_shard_00001", 6, 1)]


def test_games_main_line(spark, tmp_path):
    (tmp_path / "a.pgn").write_text('[Event "x"]\n[Result "1-0"]\n\n1. e4 {c} e5 (1... c5 2. Nf3) 2. Nf3! 1-0\n\n[Event "y"]\n[Result "*"]\n\n1.d4 *\n')
    g = readers.games(spark, str(tmp_path / "a.pgn")).orderBy("game_idx").collect()
    assert [r.moves for r in g] == [["e4", "e5", "Nf3"], ["d4"]]
    assert g[0].headers["Result"] == "1-0"
    assert [r.headers["Event"] for r in g] == ["x", "y"]


def test_games_of_a_split_file(spark, tmp_path):
    text = "".join(f'[Event "{k}"]\n[Result "*"]\n\n1. e4 e5 {"2. Nf3 " * (k % 3 > 0)}*\n\n' for k in range(2000))
    (tmp_path / "b.pgn").write_text(text)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        g = readers.games(spark, str(tmp_path / "b.pgn"))
        assert g.rdd.getNumPartitions() > 3
        rows = g.orderBy("game_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [r.headers["Event"] for r in rows] == [str(k) for k in range(2000)]
    assert all(r.moves == ["e4", "e5"] + ["Nf3"] * (k % 3 > 0) for k, r in enumerate(rows))


def test_games_to_positions(spark, tmp_path):
    from rankfile.operators import replay

    (tmp_path / "a.pgn").write_text('[Event "x"]\n[Result "1-0"]\n\n1. f3 e5 2. g4 {oh} Qh4# 0-1\n\n[Event "y"]\n[FEN "4k3/8/8/8/8/8/8/R3K3 w Q - 0 1"]\n[Result "*"]\n\n1. O-O-O+ *\n')
    rows = replay.positions(readers.games(spark, str(tmp_path / "a.pgn"))).orderBy("game_idx", "ply").collect()
    assert [(r.ply, r.in_check, r.game_over, r.result) for r in rows] == [(1, False, False, "1-0"), (2, False, False, "1-0"), (3, False, False, "1-0"), (4, True, True, "1-0"), (1, False, False, "*")]
    assert rows[-1].fen == "4k3/8/8/8/8/8/8/2KR4 b - - 1 1"


def test_manifest_gate(spark):
    rows = spark.createDataFrame([("a", 1000, 1), ("b", 1000, 1)], "shard_id string, annotation_n_input long, annotation_n_failed long")
    assert readers.manifest_gate(rows, max_rate=0.001).first().accepted
    assert not readers.manifest_gate(rows.unionByName(spark.createDataFrame([("c", None, None)], rows.schema)), max_rate=0.001).first().accepted


def test_model_gates_and_round_trip():
    rng = np.random.default_rng(2)
    w = {"w0": rng.normal(0, 0.02, (100, 8)), "b0": rng.normal(0, 0.1, 8), "w1": rng.normal(0, 0.2, 16), "b1": 0.1}
    assert model.gates(w) == []
    for name, value in (("w0", 200.0), ("b0", -200.0), ("w1", 2.1)):
        bad = {k: np.array(v) for k, v in w.items()}
        bad[name].flat[0] = value
        assert model.gates(bad)
    us, them = [np.arange(10)], [np.arange(20, 30)]
    assert abs(model.floats(us, them, w)[0] - model.integers(us, them, model.quantise(w))[0]) < 12
    assert len(model.to_bytes(model.quantise(w))) == 2 * (800 + 8 + 16 + 1) + 62


def test_sampling_rule(spark):
    rows = spark.createDataFrame([(1, 1, p, f"k{p % 9}", p % 5 == 0, False) for p in range(60)], "shard long, game_id long, ply long, key string, in_check boolean, game_over boolean")
    out = sampling.sample_positions(rows, step=4, skip=11, cap=3, jitter_seed=1).collect()
    assert 0 < len(out) <= 3
    assert len({r["key"] for r in out}) == len(out)
    assert not any(r.in_check for r in out)


def test_corrected_with_tied_last_rows(spark):
    from rankfile.operators import dataset

    rows = [(1, 1, 900, True, True, "*"), (1, 2, 100, True, True, "*"), (1, 2, 500, True, True, "*"), (1, 2, 500, False, True, "*"), (2, 1, -900, True, False, "0-1"), (3, 1, None, True, True, "1-0")]
    df = spark.createDataFrame(rows, "g long, row_idx long, eval_cp int, white boolean, truncated boolean, result string")
    for d in (df, df.orderBy(df.eval_cp.desc()), df.repartition(3)):
        got = {r.g: r.result for r in dataset.corrected(d, "g").collect()}
        assert got == {1: "1-0", 2: "0-1", 3: "1-0"}
