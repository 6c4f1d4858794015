"""Rules of the game, replay, labels, readers and sinks, split, export, ranks by ranges, bootstraps."""

import json
import os
import random
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankfile.functions import label
from rankfile.functions.board import START, Board, random_opening
from rankfile.operators import dataset, labelling, model, rank, replay
from rankfile.plans.annotation import GAMES
from rankfile.sources import readers
from rankfile.streaming import annotate


def perft(fen, depth):
    if not depth:
        return 1
    total = 0
    for move in Board(fen).moves():
        b = Board(fen)
        b.push(move)
        total += perft(b.fen(), depth - 1)
    return total


# Published counts of legal move sequences.
@pytest.mark.parametrize(("fen", "depth", "want"), [
    (START, 3, 8902), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", 2, 2039),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", 3, 2812), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", 2, 1486),
])
def test_legal_moves(fen, depth, want):
    assert perft(fen, depth) == want


def test_games_end():
    mate, stale, again, on = (replay.replayed(g.split()) for g in GAMES)
    assert mate[-1][1:] == ("r1bqkb1r/pppp1Qpp/2n2n2/4p3/2B1P3/8/PPPP1PPP/RNB1K1NR b KQkq - 0 4", True, True)
    assert not stale[-1][2] and stale[-1][3] and not stale[-2][3]
    assert [x[3] for x in again] == [False] * 15 + [True] + [False]
    assert on[-1][1] == "r2q1rk1/p1p2ppp/2pb1n2/3p4/3P2b1/5N2/PPP2PPP/RNBQR1K1 w - - 1 11" and not any(x[3] for x in on)
    assert Board("8/8/4k3/8/8/3BK3/8/8 w - - 0 1").over() and not Board("8/8/4k3/8/8/3RK3/8/8 w - - 0 1").over()
    assert Board("4k3/8/8/8/8/8/8/R3K3 w Q - 150 90").over()
    assert replay.replayed(["e4", "Nf6", "xx", "d4"])[-1][0] == 2


def test_en_passant_field_only_where_it_can_be_taken():
    b = Board()
    for san in ("e4", "a6", "e5", "d5"):
        b.push(b.find(san))
    assert b.fen().split()[3] == "d6"
    b = Board()
    b.push(b.find("e4"))
    assert b.fen() == "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"


def test_openings_are_reproducible(spark):
    got = {r.number: r.fen for r in replay.openings(spark.range(1).sparkSession, 20, plies=6, seed=4).repartition(3).collect()}
    assert got == {k: random_opening(6, 4, k) for k in range(20)}
    assert len(set(got.values())) > 15


ENGINE = """import sys
for line in sys.stdin:
    w = line.split()
    if line.startswith("uci\\n"): print("uciok")
    elif w[:1] == ["isready"]: print("readyok")
    elif w[:1] == ["position"]: fen = line[13:].strip()
    elif w[:1] == ["eval"]: print("Evaluation: %s (white side)" % (len(fen) / 100))
    elif w[:1] == ["go"]:
        if "8/8/8/8/8/8" in fen: sys.exit(1)
        print("info depth 1 score cp 5 nodes 3")
        print("info depth 2 score %s nodes 9" % ("mate -2" if " b " in fen else "cp 41"))
        print("bestmove e2e4")
    elif w[:1] == ["quit"]: break
    sys.stdout.flush()
"""


def test_engine_labels(spark, tmp_path):
    (tmp_path / "engine.py").write_text(ENGINE)
    make = lambda path=str(tmp_path / "engine.py"): labelling.Uci([sys.executable, path], nodes=100)
    fens = [START, "8/8/8/8/8/8/8/8 w - - 0 1", START.replace(" w ", " b "), START]
    df = spark.createDataFrame(list(enumerate(fens)), "i int, fen string").coalesce(1)
    got = {r.i: (r.kind, r.score, r.depth, r.nodes, r.bestmove, r.eval_cp) for r in labelling.labelled(df, make).collect()}
    assert got == {0: ("cp", 41, 2, 9, "e2e4", 41), 1: (None,) * 6, 2: ("mate", -2, 2, 9, "e2e4", -15_000), 3: ("cp", 41, 2, 9, "e2e4", 41)}
    assert [labelling.quick_eval(labelling.Found("mate", -2, 2, 9, "")), labelling.quick_eval(labelling.Found("cp", -7, 2, 9, ""))] == [10_000, -7]
    static = {r.i: r.s for r in labelling.static_scores(df, make, "s").collect()}
    assert static == {i: len(f) / 100 for i, f in enumerate(fens)}
    gate = labelling.identity_gate(df, make, make, order="i")
    assert gate.first().asDict() == {"n": 4, "differ": 0, "accepted": False}
    with pytest.raises(ValueError, match="gate failed"):
        labelling.refuse_unless(gate)
    with pytest.raises(ValueError, match="changes nothing"):
        labelling.probe(labelling.StandIn, labelling.StandIn, START)
    labelling.probe(labelling.StandIn, lambda: labelling.StandIn(2.0), "4k3/8/8/8/8/8/8/R3K3 w Q - 0 1")


def test_stand_in_follows_the_side_to_move(spark):
    a, b = "4k3/8/8/8/8/8/8/R3K3 w Q - 0 1", "4k3/8/8/8/8/8/8/R3K3 b - - 0 1"
    df = spark.createDataFrame([(a,), (b,), ("nonsense",), (None,)], "fen string")
    assert [r.eval_cp for r in labelling.labelled(df.coalesce(1), labelling.StandIn).collect()] == [500, -500, None, None]


def test_numpy_files(spark, tmp_path):
    rows = [(i, list(range(i % 40)), float(i) / 7) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, us array<long>, target double").repartitionByRange(4, "i").sortWithinPartitions("i")
    assert readers.write_npy(df, str(tmp_path / "d"), {"us": ("int32", 32), "target": ("float32", 0)}) == 300
    us, target = np.load(tmp_path / "d.us.npy"), np.load(tmp_path / "d.target.npy", mmap_mode="r")
    assert us.dtype == np.int32 and us.shape == (300, 32)
    assert us[39].tolist() == list(range(32)) and us[3].tolist() == [0, 1, 2] + [-1] * 29
    assert np.allclose(target, [r[2] for r in rows], atol=1e-5)
    assert readers.write_npy(df.limit(0), str(tmp_path / "e"), {"target": ("float32", 0)}) == 0
    assert np.load(tmp_path / "e.target.npy").shape == (0,)


def test_readers(spark, tmp_path):
    (tmp_path / "gen3_shard_00001_positions.txt").write_text("f1 w - -\t1-0\t7\t1\nbad line\nf2 w - -\t*\tx\t0\n")
    (tmp_path / "gen3_shard_00002_positions.txt").write_text("f3 w - -\t0-1\t8\t0\n")
    (tmp_path / "other.txt").write_text("")
    both = [str(tmp_path / f"gen3_shard_0000{k}_positions.txt") for k in (1, 2)]
    got = [(r.shard_id, r.fen, r.game_id, r.truncated) for r in readers.tsv(spark, "positions", *both).orderBy("shard_id", "row_idx").collect()]
    assert got == [("gen3_shard_00001", "f1 w - -", 7, 1), ("gen3_shard_00001", "f2 w - -", None, 0), ("gen3_shard_00002", "f3 w - -", 8, 0)]
    assert sorted(r.shard_id for r in readers.shards(spark, str(tmp_path / "*.txt")).collect()) == ["gen3_shard_00001", "gen3_shard_00002"]
    (tmp_path / "c.csv").write_text("a,b\n1,x\n2,y\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "c.csv"), "a int, b string").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "m.json").write_text(json.dumps({"shard_id": "s", "generation": 3, "games_actual": 5, "annotation_n_input": 9, "annotation_n_failed": 1, "commit": "abc"}, indent=1))
    m = readers.manifests(spark, str(tmp_path / "m*.json"))
    r = m.first()
    assert (r.shard_id, r.games_actual, r.every["commit"]) == ("s", 5, "abc")
    assert readers.manifest_gate(m, max_rate=0.2).first().accepted and not readers.manifest_gate(m, max_rate=0.1).first().accepted
    q = spark.createDataFrame([('game "8/8 w" 1',)], ["v"])
    assert q.select(readers.quoted_fen(F.col("v"))).first()[0] == "8/8 w"
    (tmp_path / "r.bin").write_bytes(bytes(range(70)))
    rec = readers.records(spark, str(tmp_path / "r.bin"), 32).orderBy("idx").collect()
    assert [bytes(x.record) for x in rec] == [bytes(range(32)), bytes(range(32, 64))]
    d = readers.digests(spark, str(tmp_path / "r.bin")).first()
    assert d.bytes == 70 and len(d.sha256) == 64
    t = readers.tensors(struct.pack("<6f", *range(6)), {"a": (2, 2), "b": (2,)})
    assert t["a"].tolist() == [[0, 1], [2, 3]] and t["b"].tolist() == [4, 5]
    readers.write_composition(spark.createDataFrame([("s1", 1), ("s1", 1), ("s2", 3)], "shard_id string, game_id int"), str(tmp_path / "comp"), "shard_id")
    text = "".join(open(tmp_path / "comp" / f).read() for f in sorted(os.listdir(tmp_path / "comp")) if f.startswith("part"))
    assert json.loads(text) == {"rows": 3, "games": 2, "shards": 2, "details": [{"shard_id": "s1", "rows": 2, "games": 1}, {"shard_id": "s2", "rows": 1, "games": 1}]}
    name, path = readers.label_path(F.col("v"))
    assert [tuple(x) for x in spark.createDataFrame([("a=/x=y",), ("b=",), ("c",)], ["v"]).select(name, path).collect()] == [("a", "/x=y"), ("b", ""), ("c", "")]


def test_manifest_patch_notes_unlike_commits(spark):
    rows = spark.createDataFrame([("a", {"engine_commit": "c1"}), ("b", {"engine_commit": "UNKNOWN"}), ("c", {"x": "1"}), ("d", {"engine_commit": "c2"})], "shard_id string, every map<string,string>")
    counts = rows.select("shard_id", F.lit(7).alias("n_failed"))
    got = {r.shard_id: r.every for r in readers.patched(rows, counts, commit="c2", machine="m").collect()}
    assert all(m["annotation_n_failed"] == "7" and m["annotation_engine_commit"] == "c2" for m in got.values())
    assert [k for k, m in sorted(got.items()) if "commit_mismatch_note" in m] == ["a"]
    assert not any("commit_mismatch_note" in r.every for r in readers.patched(rows, counts, commit="UNKNOWN").collect())


def test_counts_of_files_and_key_hashes(spark, tmp_path):
    import hashlib

    from rankfile.functions import fen

    (tmp_path / "a_positions.txt").write_text("f1\t1-0\t7\t1\nbad\nf2\t*\t7\t0\nf3\t*\t8\t0\n")
    r = readers.file_counts(spark, "positions", str(tmp_path / "a_positions.txt")).first()
    assert tuple(r) == ("a", 4, 3, 2)
    got = spark.createDataFrame([(START,), (None,)], "f string").select(fen.key_hash_blake(F.col("f")).alias("h")).collect()
    assert bytes(got[0].h) == hashlib.blake2b(START.rsplit(" ", 2)[0].encode(), digest_size=8).digest() and got[1].h is None


def test_stream_follows_new_shards(spark, tmp_path):
    schema = "shard long, row_idx long, key string, ok boolean, last boolean, truncated boolean"
    df = spark.createDataFrame([(s, i, f"k{(s * i) % 3}", True, i == 1, False) for s in range(4) for i in range(2)], schema)
    df.where("shard < 2").coalesce(1).write.parquet(str(tmp_path / "in/part=0"))
    q = annotate.annotate_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "out"), max_failed_rate=1.0, checkpoint=str(tmp_path / "c"), follow_seconds=1)
    try:
        q.processAllAvailable()
        df.where("shard >= 2").coalesce(1).write.parquet(str(tmp_path / "in/part=1"))
        q.processAllAvailable()
        assert q.isActive and json.loads(annotate.status_json(q))["stato"] == "in_corso"
        got = {(r.shard, r.row_idx): r.status for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    finally:
        q.stop()
    assert got == {(r.shard, r.row_idx): r.status for r in dataset.status(df).collect()}


def test_seeded_split_is_pythons(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), i) for i, g in enumerate(rng.integers(0, 50, 400))]
    by: dict = {}
    for g, i in rows:
        by.setdefault(g, []).append(i)
    ids, r = list(by), random.Random(42)
    r.shuffle(ids)
    val = set(ids[: max(1, round(len(ids) * 0.1))])
    train = [i for g, some in by.items() if g not in val for i in some]
    r.shuffle(train)
    got = dataset.seeded_split(spark.createDataFrame(rows, "g long, i long").repartition(5), "g", "i", fraction=0.1, seed=42).collect()
    assert {x.i for x in got if x.part == "val"} == {i for g in val for i in by[g]}
    assert [x.i for x in sorted((x for x in got if x.part == "train"), key=lambda x: x.place)] == train


def weights(seed=0):
    rng = np.random.default_rng(seed)
    return {"w0": rng.normal(0, 0.02, (12, 4)), "b0": rng.normal(0, 0.1, 4), "w1": rng.normal(0, 0.3, 8), "b1": 0.01}


def test_export_round_trip():
    w = weights()
    content = model.exported(w)
    assert len(content) == 2 * (12 * 4 + 4 + 8 + 1) + model.PAD
    back, q = model.from_bytes(content, 12, 4), model.quantise(w)
    assert all(np.array_equal(back[k], q[k]) for k in ("w0", "b0", "w1")) and back["b1"] == q["b1"]
    assert content[: 2 * 48] == q["w0"].astype("<i2").tobytes()
    with pytest.raises(ValueError, match="bytes"):
        model.from_bytes(content[:-1], 12, 4)


@pytest.mark.parametrize(("name", "value", "match"), [
    ("w0", 200.0, "w0 saturates"), ("w0", -200.0, "w0 saturates"), ("b0", 200.0, "b0 saturates"), ("b0", -200.0, "b0 saturates"), ("w1", 600.0, "w1 saturates"), ("w1", -600.0, "w1 saturates"),
    ("b1", 3.0, "b1 saturates"), ("b1", -3.0, "b1 saturates"), ("b1", 32767 / (255 * 64), "b1 saturates"), ("w1", 2.1, "over 128"), ("w1", -2.1, "over 128"), ("b0", 128.4, "overflow"), ("w0", 127.9, "overflow"),
])
def test_export_is_refused(name, value, match):
    w = weights()
    if name == "b1":
        w["b1"] = value
    else:
        w[name].flat[0] = value
        if match == "overflow":
            w["b0"][0] = 128.4
    with pytest.raises(ValueError, match=match):
        model.exported(w)
    if name == "b1":
        assert -32768 <= model.quantise(w)["b1"] <= 32767


def test_largest_weights_that_pass():
    w = weights()
    w["w1"][0], w["b1"] = 2.0, 32766 / (255 * 64)
    assert model.from_bytes(model.exported(w), 12, 4)["b1"] == 32766


def test_scaling_leaves_the_network_as_it_is():
    w, rng = weights(), np.random.default_rng(2)
    rows = [rng.integers(0, 12, 5) for _ in range(6)]
    small = {**w, "w0": w["w0"] * 0.1, "b0": np.abs(w["b0"]) * 0.1}  # away from the clipping ends
    scaled = model.rescaled(small, 0.5)
    act = lambda v: np.stack([v["w0"][r].sum(axis=0) + v["b0"] for r in rows])
    assert np.allclose(act(scaled), act(small) / 0.5) and np.allclose(scaled["w1"], small["w1"] * 0.25)


def rows_with_hot_values(spark):
    rng = np.random.default_rng(7)
    v = np.where(rng.random(3000) < 0.4, 5.0, rng.normal(0, 10, 3000).round(1))
    rows = [(i, "ab"[i % 2], float(x) if i % 50 else None) for i, x in enumerate(v)]
    return rows, spark.createDataFrame(rows, "id long, c string, v double")


def test_numbered_by_ranges(spark):
    rows, df = rows_with_hot_values(spark)
    for descending in (False, True):
        got = {r.id: r.k for r in rank.numbered(df, "v", "id", by=("c",), descending=descending, parts=8).collect()}
        for c in "ab":
            order = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is None, 0 if r[2] is None else -r[2] if descending else r[2], r[0]))
            assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    assert rank.numbered(df.limit(0), "v", "id").count() == 0


def test_ranks_and_quantiles_by_ranges(spark):
    rows, df = rows_with_hot_values(spark)
    got = {r.id: r.r for r in rank.average_rank(df, "v", "r", by=("c",)).collect() if r.v is not None}
    q = {r.c: (r.a, r.b, r.m) for r in rank.quantiles(df, "v", {"a": 0.0, "b": 0.37, "m": 0.5}, ("c",)).collect()}
    for c in "ab":
        v = {r[0]: r[2] for r in rows if r[1] == c and r[2] is not None}
        x = np.array(list(v.values()))
        want = [(x < y).sum() + ((x == y).sum() + 1) / 2 for y in x]
        assert [got[i] for i in v] == want
        assert np.allclose(q[c], [x.min(), np.quantile(x, 0.37), np.median(x)])


def test_placed_by_several_keys(spark):
    rng = np.random.default_rng(5)
    rows = [tuple(int(x) for x in (rng.integers(3), rng.integers(2), rng.integers(40), i)) for i in range(500)]
    got = {r.d: r.k for r in dataset.placed(spark.createDataFrame(rows, "a int, b int, c int, d int"), [("a", True), ("b", False), ("c", False), ("d", False)], "k").collect()}
    assert [got[r[3]] for r in sorted(rows, key=lambda r: (-r[0], r[1], r[2], r[3]))] == list(range(1, 501))


def test_weighted_statistics_are_those_of_the_repeated_rows():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x, y = rng.integers(0, 8, 30).astype(float), rng.integers(0, 8, 30).astype(float)
        w = np.bincount(rng.integers(0, 30, 30), minlength=30).astype(float)
        rx, ry = np.repeat(x, w.astype(int)), np.repeat(y, w.astype(int))
        place = lambda v: np.array([(v < z).sum() + ((v == z).sum() + 1) / 2 for z in v])
        assert np.isclose(rank.weighted_rho(rank.codes(x), rank.codes(y), w), np.corrcoef(place(rx), place(ry))[0, 1])
        order = np.argsort(x)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert np.isclose(rank.weighted_quantile(x[order], w[order], q), np.quantile(rx, q))


def test_bootstrap_draws(spark):
    rows = [(float(i), float(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(rows, "v double, c double")
    got = sorted((r.replicate, r.value) for r in rank.bootstrap(df, ["v", "c"], lambda x: lambda w: float(w[x[:, 1] == 1].sum()), n=40, seed=5, within="c").collect())
    assert got == [(k, 10.0) for k in range(40)]  # as many of each class as there are
    mean = [r.value for r in rank.bootstrap(df, ["v"], lambda x: lambda w: float(w @ x[:, 0] / w.sum()), n=2000, seed=5).collect()]
    assert abs(np.mean(mean) - 14.5) < 0.2 and abs(np.std(mean) - np.std(range(30)) / np.sqrt(30)) < 0.1
    assert np.random.default_rng([5, 0]).integers(0, 30, 30).mean() == pytest.approx(rank.bootstrap(df, ["v"], lambda x: lambda w: float(w @ x[:, 0] / w.sum()), n=1, seed=5).first().value)
    with pytest.raises(ValueError, match="more than"):
        rank.bootstrap(df, ["v"], None, n=1, seed=1, most=10)


def test_point_of_view_gate_stops(spark):
    from rankfile.operators import report

    rows = [(k % 2 == 0, (500 if k % 3 else -500), float(500 if k % 3 else -500) * (1 if k % 2 == 0 else -1)) for k in range(400)]
    gate = lambda r: report.point_of_view(spark.createDataFrame(r, "w boolean, m int, cp double"), white="w", material="m", cp="cp")
    assert report.stop_unless(gate(rows)).first()["white_agree"] == 1.0
    with pytest.raises(ValueError, match="gate failed"):
        report.stop_unless(gate([(w, m, -cp) for w, m, cp in rows]))
    with pytest.raises(ValueError, match="gate failed"):
        report.stop_unless(gate(rows[:50]))


def test_gates_on_joins(spark):
    a = spark.createDataFrame([(1, 2.0), (2, 3.0)], "k int, x double")
    assert dataset.vectors(a, a.withColumnRenamed("x", "y"), "k").count() == 2
    with pytest.raises(ValueError, match="not unique"):
        dataset.vectors(a.union(a), a.withColumnRenamed("x", "y"), "k")
    with pytest.raises(ValueError, match="rows"):
        dataset.zipped(a, a.limit(1), "k")


@pytest.mark.parametrize(("reference", "shallow", "middle", "want"), [(0.99, 0.9, 0.95, "NOT CONVERGED"), (0.995, 0.951, 0.97, "NOT ALIVE"), (0.995, 0.9, 0.951, "JUSTIFIED"), (0.995, 0.9, 0.94, "ALIVE BUT NOT JUSTIFIED")])
def test_depth_verdicts(spark, reference, shallow, middle, want):
    assert spark.range(1).select(label.depth_verdict(*map(F.lit, (reference, shallow, middle)))).first()[0] == want


def test_stream_starts_again_where_it_stopped(spark, tmp_path):
    schema = "shard long, row_idx long, key string, ok boolean, last boolean, truncated boolean"
    rows = [(s, i, f"k{(s * i) % 5}", (s + i) % 4 > 0, i == 3, s % 2 == 0) for s in range(6) for i in range(4)]
    df = spark.createDataFrame(rows, schema)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        annotate.annotate_stream(stream, str(tmp_path / "out"), max_failed_rate=1.0, checkpoint=str(tmp_path / "c")).awaitTermination()

    for n in range(3):
        df.where(F.floor(F.col("shard") / 2) == n).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
        go()  # each run finds one more file
    go()  # and nothing new
    got = {(r.shard, r.row_idx): r.status for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()}
    assert got == {(r.shard, r.row_idx): r.status for r in dataset.status(df).collect()}


# queries without SQL, against plain versions
SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def run(spark, name):
    from rankfile.plans import registry

    return registry.QUERIES[name](spark, SF).collect()


@needs_tables
def test_replay_and_sampling_queries(spark):
    from rankfile.operators.sampling import jitter

    keys = sorted(r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect())
    want = {(f"shard_{k % 7}", k, *row) for k in keys for row in replay.replayed(GAMES[k % 4].split())}
    assert {(r.file, r.game_idx, r.ply, r.fen, r.in_check, r.game_over) for r in run(spark, "replayed_games")} == want
    kept = set()
    for shard in {f"shard_{k % 7}" for k in keys}:
        seen = set()
        for k in (k for k in keys if f"shard_{k % 7}" == shard):
            after, n = 1 + 2 + jitter(5, shard, k, -1), 0
            for ply, fen, check, over in replay.replayed(GAMES[k % 4].split()):
                if over:
                    break
                if ply < after:
                    continue
                after = ply + 2 + jitter(5, shard, k, ply)
                key = " ".join(fen.split()[:4])
                if n >= 4 or check or key in seen:
                    continue
                seen.add(key)
                n += 1
                kept.add((shard, k, ply))
    assert {(r.shard, r.game_id, r.ply) for r in run(spark, "sampled_positions")} == kept


@needs_tables
def test_label_and_opening_queries(spark):
    got = run(spark, "engine_labels")
    stand_in = labelling.StandIn()
    for r in got[::7]:
        try:
            want = stand_in.search(r.fen)
        except ValueError:
            want = labelling.Found(None, None, None, None, None)
        assert (r.kind, r.score, r.depth, r.nodes, r.bestmove) == tuple(want)
    rows = run(spark, "random_openings")
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert all(r.fen == random_opening(8, 3, r.number) for r in rows[::10])


@needs_tables
def test_bootstrap_queries(spark):
    from rankfile.plans.views import gaps

    rows = gaps(spark, SF).select("id", "bucket", "class", "gap", "static_cp", "search_cp").toPandas()
    hard, easy = rows[rows["class"] == "R"]["gap"], rows[rows["class"] != "R"]["gap"]
    rho = rows["static_cp"].rank().corr(rows["search_cp"].rank())
    by = [g["static_cp"].rank().corr(g["search_cp"].rank()) for g in (rows[rows["class"] != "R"], rows[rows["class"] == "R"])]
    points = {
        "bootstrap_rho": rho, "bootstrap_one_minus_rho": 1 - rho, "bootstrap_median_ratio": hard.median() / easy.median(), "bootstrap_p90_ratio": hard.quantile(0.9) / easy.quantile(0.9),
        "bootstrap_mean_difference": hard.mean() - easy.mean(), "bootstrap_rho_difference": by[0] - by[1],
    }
    for name, point in points.items():
        (r,) = run(spark, name)
        assert r.low < point < r.high and 0 < r.sd
        assert abs((r.high - r.low) / (2 * 1.96 * r.sd) - 1) < 0.15
    (r,) = run(spark, "bootstrap_paired")
    assert r.low <= r.high
    for r in run(spark, "tail_decision"):
        part = rows[rows["bucket"] == r.bucket].sort_values(["gap", "id"], ascending=[False, True])
        top = part.head(round(0.1 * len(part)))
        assert np.isclose(r.lift10, (top["class"] == "R").mean() / (part["class"] == "R").mean())
        p90 = part[part["class"] == "R"]["gap"].quantile(0.9) / part[part["class"] != "R"]["gap"].quantile(0.9)
        assert r.p90_low < p90 and r.a_met == (r.lift10 >= 2) and r.b_met == (r.p90_low > 1.2)


@needs_tables
def test_subset_query(spark):
    got = {round(r["size"]): r.sd for r in run(spark, "subset_spread")}
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert set(got) == {round(n / k) for k in (2, 4, 8)}
    assert all(0 < sd < 0.2 for sd in got.values())
