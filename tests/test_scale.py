"""Filters, permutations, resampling, two-pass statistics, stream state, record files, feeds, counters."""

import json
import os
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankfile.operators import bloom, dataset, multiset, permute, rank, report, resample, sampling, unique
from rankfile.plans import registry
from rankfile.sources import records
from rankfile.streaming import annotate, feed, progress

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


# membership filters
def test_filter_is_exact_and_within_its_rate(spark):
    batch = spark.range(0, 4000, 2).withColumnRenamed("id", "k")
    state = spark.range(1, 60_001, 3).withColumnRenamed("id", "k")
    blocks = bloom.blocks_for(2000, 0.01)
    passed = {r.k for r in bloom.passing(state, "k", bloom.built(batch, "k", blocks), blocks).collect()}
    members = {k for k in range(1, 60_001, 3) if k < 4000 and k % 2 == 0}
    others = 20_000 - len(members)
    assert members <= passed and (len(passed) - len(members)) / others <= 0.02
    assert {r.k for r in bloom.unseen(batch, state, "k").collect()} == set(range(0, 4000, 2)) - members
    assert {r.k for r in bloom.seen(batch, state, "k").collect()} == members
    # more keys than a broadcast may hold: the exact join alone
    assert {r.k for r in bloom.unseen(batch, state, "k", most=0).collect()} == set(range(0, 4000, 2)) - members


def test_filters_merge_and_nulls(spark):
    a, b = spark.createDataFrame([("x",), ("y",), (None,)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    whole = bloom.built(a.unionByName(b), "k", 3)
    parts = bloom.merged(bloom.built(a, "k", 3), bloom.built(b, "k", 3))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    assert sorted(r.k or "" for r in bloom.unseen(a, b, "k").collect()) == ["", "x"]
    assert bloom.unseen(a.limit(0), b, "k").count() == 0 and bloom.unseen(a, b.limit(0), "k").count() == 3


def test_rate_of_load():
    for rate in (0.1, 0.01, 0.001):
        load = bloom.load_for(rate)
        assert bloom.expected_rate(load) <= rate < bloom.expected_rate(load + 1)


# permutations
def test_every_size_is_permuted():
    for n in [*range(1, 130), 1000, 4097, 10_007]:
        p = permute.Permutation(n, 5)
        at = np.arange(n)
        at = p.once(at)
        for _ in range(p.walks() - 1):
            at = np.where(at >= n, p.once(at), at)
        assert sorted(at.tolist()) == list(range(n)), n


@pytest.mark.parametrize("n", [1, 2, 7, 100, 997, 5000])
def test_places_and_back(spark, n):
    df = permute.permuted(spark.range(n), "id", n, seed=3)
    rows = permute.permuted(df, "place", n, seed=3, out="back", inverse=True).collect()
    assert sorted(r.place for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 100:
        other = {r.id: r.place for r in permute.permuted(spark.range(n), "id", n, seed=4).collect()}
        same = sum(other[r.id] == r.place for r in rows)
        assert same < 10 and sum(r.place == r.id for r in rows) < 10  # about one each by chance
        x = np.array([r.place for r in sorted(rows, key=lambda r: r.id)])
        assert abs(np.corrcoef(x, np.arange(n))[0, 1]) < 0.1 and abs(np.corrcoef(x[1:], x[:-1])[0, 1]) < 0.1


def test_split_and_pool(spark):
    df = spark.range(600).select(F.col("id"), (F.col("id") * 7 % 41).alias("g"))
    out = permute.permuted_split(df, "g", "id", fraction=0.1, seed=1).collect()
    val = {r.g for r in out if r.part == "val"}
    assert len(val) == 4 and all((r.g in val) == (r.place is None) for r in out)
    assert sorted(r.place for r in out if r.part == "train") == list(range(sum(r.part == "train" for r in out)))
    base, more = spark.range(50).withColumnRenamed("id", "k"), spark.range(30, 90).withColumnRenamed("id", "k")
    first = {r.k: r.place for r in permute.shuffled_pool(base, base.limit(0), "k", seed=2).collect()}
    both = {r.k: r for r in permute.shuffled_pool(base, more, "k", seed=2).collect()}
    assert all(both[k].place == p and both[k].epoch == 0 for k, p in first.items())
    assert sorted(r.place for r in both.values()) == list(range(90))


# statistics from two passes
def plain_rho(x, y):
    return float(np.corrcoef(rank.ranks(np.array(x)), rank.ranks(np.array(y)))[0, 1])


@pytest.mark.parametrize("ties", [False, True])
def test_profile_against_numpy(spark, ties):
    rng = np.random.default_rng(8)
    x = rng.normal(size=4000)
    x = np.where(rng.random(4000) < 0.4, 0.0, np.round(x, 1)) if ties else x
    y = np.round(x + rng.normal(size=4000), 1 if ties else 6)
    rows = [(i, "ab"[i % 7 == 0], float(a), float(b) if i % 11 else None) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, c string, x double, y double").repartition(5)
    out = {r.c: r for r in rank.profile(df, ("c",), {"m": ("x", 0.5), "p9": ("y", 0.9), "top": ("x", 1.0), "low": ("y", 0.0)}, pair=("x", "y"), sums={"s": F.col("x") * 2}, k=200).collect()}
    for c in "ab":
        some = [r for r in rows if r[1] == c]
        a, b = np.array([r[2] for r in some]), np.array([r[3] for r in some if r[3] is not None])
        both = [r for r in some if r[3] is not None]
        assert out[c].n == len(some) and np.isclose(out[c].s, 2 * a.sum())
        assert np.allclose([out[c].m, out[c].p9, out[c].top, out[c].low], [np.quantile(a, 0.5), np.quantile(b, 0.9), a.max(), b.min()])
        if not ties:
            # ranks are those among all values of a column; with nulls in y, x is ranked with rows that have no pair
            rx = rank.ranks(a)[[i for i, r in enumerate(some) if r[3] is not None]]
            assert np.isclose(out[c].rho, np.corrcoef(rx, rank.ranks(np.array([r[3] for r in both])))[0, 1])


def test_profile_with_hot_values(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 4, 3000).astype(float), rng.integers(0, 3, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    r = rank.profile(df, (), {"m": ("x", 0.5)}, pair=("x", "y")).first()
    assert np.isclose(r.rho, plain_rho(x, y)) and r.m == np.quantile(x, 0.5)


def test_profile_odd_tables(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), (None, 5.0)], "c string, x double")
    out = {r.c: r.m for r in rank.profile(df, ("c",), {"m": ("x", 0.5)}).collect()}
    assert out["a"] is None and out["b"] == 1.0
    assert rank.profile(df.limit(0), ("c",), {"m": ("x", 0.5)}).count() == 0
    assert np.isnan(rank.spearman(df.fillna(1.0), "x", "x", degenerate="nan", least=10).first().rho)


def test_bracket_that_misses_is_widened(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("x"))
    v = np.sort(np.arange(20_000) * 7919 % 20_011)
    assert rank.profile(df, (), {"m": ("x", 0.31)}, k=8, margin=1e-9).first().m == np.quantile(v, 0.31)


def test_ranges_beyond_one_window(spark):
    counts = spark.createDataFrame([("a", s, float(v), n) for s, v, n in [(-1, 0, 7), *((0, i, 1 + i % 3) for i in range(300))]], "c string, side int, v double, n long")
    key = lambda df: {(r.side, r.v): r._before for r in df.collect()}
    assert key(rank.before_each(counts, ["c"], ["side", "v"], "n", most=10)) == key(rank.before_each(counts, ["c"], ["side", "v"], "n"))


@needs_tables
@pytest.mark.parametrize("name", ["gap_by_class", "gap_decision", "gap_grouping_sets", "percentile_table"])
def test_rows_are_read_twice(spark, name, monkeypatch):
    """Scans of the table: jobs write checkpoints, and what is left reads those."""
    sc = spark.sparkContext
    seen = []
    original = rank.checkpoint

    def counted(df):
        seen.append(len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString())))
        return original(df)

    monkeypatch.setattr(rank, "checkpoint", counted)
    df = registry.QUERIES[name](spark, SF)
    left = len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))
    assert sum(seen) + left <= 2 and sc is not None


# resampling
def test_weights_are_poisson_and_follow_the_row():
    w = resample.weights(np.arange(-500, 20_000), 0, 40, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    share = np.bincount(w.ravel(), minlength=5)[:5] / w.size
    assert np.allclose(share, np.exp(-1) / np.array([1, 1, 2, 6, 24]), atol=2e-3)
    assert (resample.weights(np.array([5]), 3, 4, 7) == w[505:506, 3:7]).all()
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03 and (resample.weights(np.array([5]), 0, 40, 8) != w[505]).any()


def plain_quantile(v, w, q):
    big = np.repeat(v, w)
    return np.quantile(big, q) if len(big) else None


@pytest.mark.parametrize("margin", [1.0, 0.01])
def test_resampled_quantiles_and_sums(spark, margin):
    rng = np.random.default_rng(4)
    v, c = np.round(rng.normal(size=3000), 2), rng.integers(0, 2, 3000)
    df = spark.createDataFrame([(i, int(k), float(x)) for i, (k, x) in enumerate(zip(c, v, strict=True))], "id long, c int, v double").repartition(3)
    got = {(r.c, r.replicate): r.value for r in resample.quantiles(df, "id", "v", 0.9, n=30, seed=5, by=("c",), margin=margin).collect()}
    totals = {(r.c, r.replicate): r for r in resample.sums(df, "id", ["v"], n=30, seed=5, by=("c",)).collect()}
    w = resample.weights(np.arange(3000), 0, 30, 5)
    for k in (0, 1):
        order = np.argsort(v[c == k], kind="stable")
        for r in range(30):
            assert np.isclose(got[k, r], plain_quantile(v[c == k][order], w[c == k][order, r], 0.9))
            assert totals[k, r].weight == w[c == k, r].sum() and np.isclose(totals[k, r].s0, v[c == k] @ w[c == k, r])


@pytest.mark.parametrize("parts", [64, 3])
def test_resampled_rho(spark, parts):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 40, 800).astype(float)
    x[:300] = 3.0
    y = x + rng.normal(size=800) * 20
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id long, x double, y double")
    got = {r.replicate: r.value for r in resample.rho(df, "id", "x", "y", n=6, seed=2, parts=parts, held=800 // parts * 4).collect()}
    w = resample.weights(np.arange(800), 0, 6, 2)
    for r in range(6):
        assert np.isclose(got[r], plain_rho(np.repeat(x, w[:, r]), np.repeat(y, w[:, r])))


@pytest.mark.parametrize("n, block", [(0, 8), (1, 8), (2, 8), (1023, 100), (1025, 1), (5000, 777)])
def test_shuffle_in_blocks_is_pythons(spark, n, block):
    one, two = random.Random(7), random.Random(7)
    want = list(range(n))
    one.shuffle(want)
    if block > 1:
        got = permute.shuffled(spark, n, two, block=block)
        assert [r.number for r in got.orderBy("place").collect()] == want
    else:
        assert [j for _, js in permute.draws(two, n - 1, 1, most=5) for j in js.tolist()] == [(r := random.Random(7), [r.randrange(i + 1) for i in range(n - 1, 0, -1)])[1]][0]
    assert one.getstate() == two.getstate()  # the next shuffle goes on from there


def test_seeded_split_holds_nothing_on_the_driver(spark, monkeypatch):
    """It goes by shuffles of blocks, without a bound on ids or rows."""
    calls, f = [], permute.shuffled
    monkeypatch.setattr(permute, "shuffled", lambda s, n, rng: calls.append(n) or f(s, n, rng, block=64))
    rows = spark.range(600).selectExpr("id % 41 as g", "id as i")
    ids, rng = list(range(41)), random.Random(42)
    rng.shuffle(ids)
    train = [i for g in range(41) if g not in ids[:4] for i in range(g, 600, 41)]
    rng.shuffle(train)
    got = dataset.seeded_split(rows, "g", "i", fraction=0.1, seed=42).collect()
    assert [x.i for x in sorted((x for x in got if x.part == "train"), key=lambda x: x.place)] == train
    assert calls == [41, len(train)]


@pytest.mark.parametrize("parts, most, together", [(64, 100, 4), (3, 100, 100), (64, 5, 100)])
def test_resampled_rho_of_few_values(spark, parts, most, together):
    """Several columns on the same weights, by class, with values that fill ranges; beyond ``most`` values the general way."""
    rng = np.random.default_rng(8)
    x, c = rng.integers(0, 12, 3000).astype(float), rng.integers(0, 2, 3000)
    z, y = x * 10 + rng.integers(0, 3, 3000), np.round(x + rng.normal(size=3000) * 5, 1)
    y[:900] = 4.0
    df = spark.createDataFrame([(i, float(a), float(b), float(d), int(e)) for i, (a, b, d, e) in enumerate(zip(x, z, y, c, strict=True))] + [(9000, None, 1.0, 1.0, 1), (9001, 1.0, 1.0, None, 0), (9002, 1.0, 1.0, 1.0, None)], "id long, x double, z double, y double, c int")
    if most == 5:
        df = df.dropna()
    got = {(r.c, r.replicate): (r.v0, r.v1) for r in resample.of_few(df, "id", ["x", "z"], "y", n=10, seed=3, by="c", parts=parts, most=most, together=together).collect()}
    w = resample.weights(np.arange(3000), 0, 10, 3)
    assert set(got) == {(k, r) for k in range(2) for r in range(10)}
    for k, r in got:
        at = np.repeat(np.arange(3000), np.where(c == k, w[:, r], 0))
        assert np.allclose(got[k, r], (plain_rho(x[at], y[at]), plain_rho(z[at], y[at])), atol=1e-9)


@pytest.mark.parametrize("spans, together, copies", [(1, 100, 1), (5, 4, 12)])
def test_resampled_rho_of_cells(spark, spans, together, copies):
    """The correlations of rows that count as often as the cells are drawn, by class, with values that fill spans; copies of the rows
    make no more cells."""
    rng = np.random.default_rng(8)
    x, c = rng.integers(0, 12, 3000).astype(float), rng.integers(0, 2, 3000)
    z, y = x * 10 + rng.integers(0, 3, 3000), np.round(x + rng.normal(size=3000) * 5, 1)
    y[:900] = 4.0
    rows = pd.DataFrame({"id": np.arange(3000), "x": x, "z": z, "y": y, "c": c})
    odd = "(9000L, null, 1D, 1D, 1), (9001L, 1D, 1D, null, 0), (9002L, 1D, 1D, 1D, null), (9003L, 1D, double('nan'), 1D, 1)"
    df = spark.createDataFrame(rows, "id long, x double, z double, y double, c int").crossJoin(spark.range(copies).select()).union(spark.sql(f"select * from values {odd}"))
    got = {(r.c, r.replicate): (r.v0, r.v1) for r in resample.of_cells(df, "id", ["x", "z"], "y", n=10, seed=3, by="c", spans=spans, together=together).collect()}
    assert set(got) == {(k, r) for k in range(2) for r in range(10)}
    cells = rows.groupby(["c", "y", "x", "z"]).size().mul(copies).rename("n").reset_index()
    cuts = sorted(set(rank.ranges_of(spark.createDataFrame(cells), "y", spans)))
    cells["span"] = np.searchsorted(cuts, cells["y"])
    cells["code"] = cells.groupby(["c", "x", "z"]).ngroup()
    cells = cells.sort_values(["span", "c", "y", "code"])
    for first in range(0, 10, together):
        count = min(together, 10 - first)
        w = []
        for span, part in cells.groupby("span"):
            draws = np.random.Generator(np.random.SFC64([3, span, first]))
            ends, n = resample.piece_ends(part["c"].to_numpy(), part["y"].to_numpy()), part["n"].to_numpy()
            w += [resample.cell_weights(resample.by_size(n[a:z]), count, draws) for a, z in zip([0, *ends], ends, strict=False)]
        w = np.concatenate(w)
        for k in range(2):
            for r in range(count):
                at = cells.loc[cells.index.repeat(np.where(cells["c"] == k, w[:, r], 0))]
                assert np.allclose(got[k, first + r], (plain_rho(at["x"].to_numpy(), at["y"].to_numpy()), plain_rho(at["z"].to_numpy(), at["y"].to_numpy())), atol=1e-9)


@pytest.mark.parametrize("size", [1, 3, 60, 100, 250])
def test_cells_count_by_the_poisson_law_of_their_rows(size):
    w = resample.cell_weights(resample.by_size(np.full(40, size)), 20_000, np.random.default_rng(5)).ravel().astype(int)
    assert abs(w.mean() / size - 1) < 5 / np.sqrt(size * len(w)) and abs(w.var() / size - 1) < 0.02
    law = np.exp(np.arange(400) * np.log(size) - size - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 400)))]))
    often = law > 1e-3
    assert np.allclose((np.bincount(w, minlength=400)[:400] / len(w))[often], law[often], atol=2.5e-3)


@needs_tables
@pytest.mark.parametrize("name", ["bootstrap_rho", "bootstrap_one_minus_rho", "bootstrap_rho_difference", "bootstrap_paired"])
def test_rank_bootstraps_take_any_number_of_rows(spark, monkeypatch, name):
    """None of them goes by the broadcast that refuses more than two million rows."""
    monkeypatch.setattr(rank, "bootstrap", lambda *a, **k: pytest.fail("broadcasts its rows"))
    (r,) = registry.QUERIES[name](spark, SF).collect()
    assert r.low <= r.high and r.sd > 0


@needs_tables
@pytest.mark.parametrize("name", ["bootstrap_rho_difference", "bootstrap_paired"])
def test_many_replicates_go_by_cells(spark, monkeypatch, name):
    """Ten thousand replicates hash no row each: equal rows are weighted together."""
    monkeypatch.setattr(resample, "of_few", lambda *a, **k: pytest.fail("weights row by row"))
    (r,) = registry.QUERIES[name](spark, SF).collect()
    assert r.low <= r.high and r.sd > 0


def test_intervals_agree_with_drawn_resamples(spark):
    """At 2,000 replicates the Poisson interval of a ratio of means lies within 2 % of the one by drawing rows."""
    rng = np.random.default_rng(12)
    v = rng.gamma(2.0, size=4000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id long, v double")
    means = resample.sums(df, "id", ["v"], n=2000, seed=1).select((F.col("s0") / F.col("weight")).alias("value"))
    mine = resample.interval(means).first()
    drawn = rank.interval(rank.bootstrap(df, ["v"], lambda x: lambda w: float(w @ x[:, 0] / w.sum()), n=2000, seed=1)).first()
    assert abs(mine.low / drawn.low - 1) < 0.02 and abs(mine.high / drawn.high - 1) < 0.02 and abs(mine.sd / drawn.sd - 1) < 0.1
    half = resample.interval(resample.quantiles(df, "id", "v", 0.5, n=2000, seed=1)).first()
    other = rank.interval(rank.bootstrap(df, ["v"], lambda x: lambda w: rank.weighted_quantile(np.sort(x[:, 0]), w[np.argsort(x[:, 0])], 0.5), n=2000, seed=1)).first()
    assert abs(half.low / other.low - 1) < 0.02 and abs(half.high / other.high - 1) < 0.02


def test_superiority_is_the_normal_law(spark):
    import math

    z = [-5.0, -2.0, -0.3, 0.0, 0.7, 1.96, 4.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(report.normal(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in z], atol=3e-7)
    assert spark.range(1).select(report.superiority(F.lit(0), F.lit(0))).first()[0] == 0.5


# first rows
def test_one_of_rows_alike_is_first(spark):
    rows = [(1, "k", 0), (1, "k", 0), (1, "k", 0), (2, "k", 0), (1, "m", 5), (1, "m", 6), (3, None, 1)]
    df = spark.createDataFrame(rows, "at long, key string, x long").repartition(3)
    got = dataset.first_seen(df, "key", "at").collect()
    assert len(got) == 7 - 1  # a row without a key is no first row of one
    assert Counter(r.key for r in got if r.first) == {"k": 1, "m": 1}
    assert all(r.at == 1 for r in got if r.first)


# streams
ROWS = "key string, shard long, row_idx long, ok boolean, last boolean, truncated boolean"


def stream_of(spark, tmp_path):
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_state_follows_the_batch_and_failed_keys_come_again(spark, tmp_path):
    shards = [[(f"k{i}", s, i, s > 1 or i % 3 > 0, False, False) for i in range(s * 5, s * 5 + 20)] for s in range(6)]
    for s, some in enumerate(shards):
        spark.createDataFrame(some, ROWS).coalesce(1).write.parquet(str(tmp_path / f"in/part={s}"))
    q = annotate.annotate_stream(stream_of(spark, tmp_path), str(tmp_path / "out"), max_failed_rate=1.0, checkpoint=str(tmp_path / "c"))
    q.awaitTermination()
    rows = spark.createDataFrame([r for some in shards for r in some], ROWS)
    want = {(r.shard, r.row_idx): r.status for r in dataset.status(rows).collect()}
    assert {(r.shard, r.row_idx): r.status for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()} == want
    states = [p.stateOperators[0] for p in q.recentProgress if p.stateOperators and p.numInputRows]
    assert len(states) == 6 and all(s.numRowsUpdated <= 20 for s in states)  # keys of the batch, not of the state
    assert states[-1].numRowsTotal == len({r[0] for some in shards for r in some if r[3]})  # keys with a labelled row only
    assert spark.conf.get(next(iter(annotate.STORE)), None) != annotate.STORE[next(iter(annotate.STORE))]  # the session is as it was


def test_hot_keys_reach_the_state_as_few_rows(spark):
    import pandas as pd

    pdf = pd.DataFrame({"key": ["hot"] * 1000 + ["x"], "shard": [1] * 1001, "row_idx": range(1001), "ok": True, "last": False, "truncated": False})
    out = pd.concat(annotate.together([pdf]))
    assert len(out) == 2 and sorted(map(len, out["row_idx"])) == [1, 1000]


def test_status_file_after_success_and_after_a_failed_gate(spark, tmp_path):
    rows = [(f"k{i}", 1, i, i % 4 > 0, False, False) for i in range(40)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "in/part=0"))
    for limit, state in ((1.0, "completato"), (0.1, "errore")):
        heard = progress.StatusFile(spark, str(tmp_path / f"{state}.json"), f"q-{state}")
        spark.streams.addListener(heard)
        q = annotate.annotate_stream(stream_of(spark, tmp_path), str(tmp_path / state), max_failed_rate=limit, checkpoint=str(tmp_path / f"c-{state}"), name=heard.name)
        if state == "errore":
            with pytest.raises(Exception, match="failed"):
                q.awaitTermination()
        else:
            q.awaitTermination()
        progress.hear_out(spark)
        spark.streams.removeListener(heard)
        got = json.loads((tmp_path / f"{state}.json").read_text())
        assert got["stato"] == state
        if state == "completato":
            assert (got["n_input"], got["n_written"], got["n_new"], got["n_failed"], got["ultimo_errore"]) == (40, 30, 40, 10, None)
        else:
            assert got["ultimo_errore"] and not (tmp_path / state / "rows").exists()
    # a run after a failed gate starts from the state before it
    q = annotate.annotate_stream(stream_of(spark, tmp_path), str(tmp_path / "errore"), max_failed_rate=1.0, checkpoint=str(tmp_path / "c-errore"))
    q.awaitTermination()
    assert Counter(r.status for r in spark.read.parquet(str(tmp_path / "errore/rows")).collect()) == {"new": 40}


def test_feed_waits_for_pairs_and_goes_on_where_it_stopped(spark, tmp_path):
    place = tmp_path / "shards"
    place.mkdir()
    lines = {s: [f"{s}-{i}" + "é" * (i % 5) for i in range(10 * s)] for s in range(1, 6)}
    write = lambda s, kind: (place / feed.file_name(s, kind)).write_text("".join(f"{x}\n" for x in (lines[s] if kind == feed.FIRST else ["x"])))

    def run():
        q = feed.shard_stream(spark, str(place), part_bytes=37).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {s: sorted(r.value for r in spark.read.schema("shard long, byte long, value string").parquet(str(tmp_path / "o")).where(F.col("shard") == s).collect()) for s in range(1, 6)} if (tmp_path / "o").exists() else {}

    write(1, feed.FIRST), write(1, feed.SECOND), write(2, feed.FIRST), write(3, feed.FIRST), write(3, feed.SECOND)
    got = run()
    assert got[1] == sorted(lines[1]) and not got[2] and not got[3]  # 2 is not whole, 3 waits behind it
    write(2, feed.SECOND)
    got = run()
    assert all(got[s] == sorted(lines[s]) for s in (1, 2, 3))
    write(4, feed.FIRST), write(4, feed.SECOND)
    run()
    write(5, feed.FIRST), write(5, feed.SECOND)
    got = run()
    assert got == {s: sorted(x) for s, x in lines.items()}  # each row once


def test_lines_are_cut_at_any_byte(tmp_path):
    (tmp_path / feed.file_name(1, feed.FIRST)).write_text("ab\n\ncdé\nlast")
    reader = feed.ShardReader({"path": str(tmp_path)})
    total = os.path.getsize(tmp_path / feed.file_name(1, feed.FIRST))
    for size in range(1, total + 1):
        got = [v for a in range(0, total, size) for b in reader.read(feed.Piece(1, a, min(a + size, total))) for v in b.column("value").to_pylist()]
        assert got == ["ab", "", "cdé", "last"], size


def test_numbers_are_given_once(spark, tmp_path):
    assert [feed.claimed_number(spark, str(tmp_path / "n")) for _ in range(4)] == [1, 2, 3, 4]


# record files
LAYOUT = {"id": ("i8", 0), "f": ("i2", 4), "x": ("f4", 0)}


def test_records_by_ranges_with_a_cut_last_one(spark, tmp_path):
    df = spark.range(5000).select("id", F.transform(F.sequence(F.lit(0), (F.col("id") % 6).cast("int")), lambda v: v.cast("smallint")).alias("f"), (F.col("id") / 2).cast("float").alias("x"))
    records.write(df.repartition(3), str(tmp_path / "r"), LAYOUT)
    back = records.read(spark, str(tmp_path / "r"), LAYOUT, place="at", part_bytes=1000)
    assert back.rdd.getNumPartitions() > 50
    rows = {r.id: r for r in back.collect()}
    assert len(rows) == 5000 and rows[2].f == [0, 1, 2, -1] and rows[5].f == [0, 1, 2, 3] and rows[9].x == 4.5
    assert sorted(r["at"] for r in rows.values()) == list(range(5000))
    some = records.read(spark, str(tmp_path / "r"), LAYOUT, columns=["x"], where=[("id", ">=", 4990), ("x", "<", 2499)])
    assert some.columns == ["x"] and sorted(r.x for r in some.collect()) == [2495 + k / 2 for k in range(8)]
    # a file that ends within a record
    part = next(f for f in os.listdir(tmp_path / "r") if f.endswith(".rec"))
    data = (tmp_path / "r" / part).read_bytes()
    (tmp_path / "one.rec").write_bytes(data + b"abc")
    assert records.read(spark, str(tmp_path / "one.rec"), LAYOUT).count() == len(data) // records.dtype_of(LAYOUT).itemsize
    assert np.fromfile(tmp_path / "r" / part, records.dtype_of(LAYOUT))["f"].shape[1] == 4


def test_failed_write_leaves_nothing_and_keeps_what_was(spark, tmp_path):
    place = tmp_path / "r"
    good = spark.range(10).select("id", F.array(F.lit(1).cast("smallint")).alias("f"), F.lit(1.5).cast("float").alias("x"))
    bad = good.withColumn("id", F.when(F.col("id") != 7, F.col("id")))
    with pytest.raises(Exception, match="nulls"):
        records.write(bad.repartition(3), str(place), LAYOUT)
    assert records.read(spark, str(place), LAYOUT).count() == 0 and not list(place.glob("*"))
    records.write(good, str(place), LAYOUT)
    with pytest.raises(Exception, match="nulls"):
        records.write(bad.repartition(3), str(place), LAYOUT)
    assert records.read(spark, str(place), LAYOUT).count() == 10
    records.write(good, str(place), LAYOUT, mode="append")
    assert records.read(spark, str(place), LAYOUT).count() == 20
    records.write(good.limit(0), str(place), LAYOUT)
    assert records.read(spark, str(place), LAYOUT).count() == 0 and not list(place.glob("*.rec"))


def test_files_are_skipped_by_their_ranges(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select("id", F.array(F.lit(1).cast("smallint")).alias("f"), F.lit(1.5).cast("float").alias("x"))
    records.write(df, str(tmp_path / "r"), LAYOUT)
    reader = records.RecordReader({"path": str(tmp_path / "r"), "layout": json.dumps(LAYOUT), "where": json.dumps([["id", ">", 800]])})
    assert len({p.file for p in reader.partitions()}) == 1


# multisets, uniqueness, sampling, counters
def test_multiset_hash(spark):
    rows = [(1, "a", None), (1, "b", "x"), (1, "a", None), (2, "", "a|b")]
    h = lambda r, **k: [tuple(x) for x in multiset.hashed(spark.createDataFrame(r, "k int, a string, b string"), F.col("a"), F.col("b"), **k).collect()]
    assert h(rows) == h(rows[::-1]) and h(rows) != h(rows[1:]) and h([(1, "a", "")]) != h([(1, "a", None)]) and h([(1, "ab", "c")]) != h([(1, "a", "bc")])
    by = multiset.hashed(spark.createDataFrame(rows, "k int, a string, b string"), F.col("a"), F.col("b"), by=("k",))
    assert [tuple(r) for r in multiset.merged(by).collect()] == h(rows)
    other = multiset.hashed(spark.createDataFrame([*rows[:3], (2, "", "a|c"), (3, "n", "n")], "k int, a string, b string"), F.col("a"), F.col("b"), by=("k",))
    assert sorted(r.k for r in multiset.unequal(by, other, "k").collect()) == [2, 3]


def test_key_runs(spark, tmp_path):
    rng, seen = np.random.default_rng(3), set()
    runs = unique.KeyRuns(spark, str(tmp_path), fanout=2)
    for _ in range(5):
        keys = [int(x) * 2**50 - 2**62 for x in rng.integers(0, 400, 150)]
        assert runs.add(spark.createDataFrame([(k,) for k in keys], "key long")) == len(set(keys) - seen)
        seen |= set(keys)
    assert runs.unique == len(seen) and runs.rows == 750 and [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(os.listdir(tmp_path)) == sorted(p.rpartition("/")[2] for level in runs.levels for p in level)
    assert runs.add(spark.createDataFrame([], "key long")) == 0


def test_sampling_fold_by_simulation(spark):
    rng = np.random.default_rng(7)
    rows = [(g, p, f"k{rng.integers(8)}", bool(rng.random() < 0.2), bool(rng.random() < 0.03)) for g in range(40) for p in range(1, int(rng.integers(2, 60)))]
    df = spark.createDataFrame(rows, "game_id long, ply long, key string, in_check boolean, game_over boolean").repartition(4)
    jump = {(r.g, r.p): r.j for r in spark.createDataFrame([(g, p) for g in range(40) for p in range(-1, 60)], "g long, p long").withColumn("j", sampling.steps(9, F.col("g"), F.col("p"))).collect()}
    want = []
    for g in range(40):
        after, kept = 1 + 2 + jump[g, -1], []
        for _, p, key, check, over in sorted(r for r in rows if r[0] == g):
            if over:
                break
            if p < after:
                continue
            after = p + 2 + jump[g, p]
            if len(kept) >= 4 or check or key in kept:
                continue
            want.append((g, p, key, len(kept)))
            kept.append(key)
    out = sampling.sampled_plies(df, step=2, skip=1, cap=4, seed=9)
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert set(jump.values()) == {0, 1, 2, 3}
    first = {}
    for g, p, key, place in sorted(want):
        first.setdefault((g % 3, key), (g, p, place))
    got = sampling.once_a_shard(out.withColumn("shard", F.col("game_id") % 3), "shard").collect()
    assert {(r.shard, r.key): (r.game_id, r.ply, r.place) for r in got} == first


def test_drops_are_counted_beside_the_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 10 == 0 else i) for i in range(100)], "id long, v long")
    rows, seen = progress.kept(df, {"small": F.col("v") < 20, "odd": F.col("id") % 2 == 1})
    rows.write.parquet(str(tmp_path / "o"))
    assert seen.get == {"n_rows": 100, "n_kept": 50 - 8, "small": 18, "odd": 40}
    assert spark.read.parquet(str(tmp_path / "o")).count() == 42


def test_projection_of_the_eval_layout(spark, tmp_path):
    from rankfile.sources import readers

    (tmp_path / "set.tsv").write_text("f1\t12\te2e4\t0.5\t20\nf2\tx\te7e5\t0.25\t18\nbad\n")
    df = readers.tsv(spark, "eval_set", str(tmp_path / "set.tsv")).select("fen", "eval_cp", "depth")
    assert sorted(map(tuple, df.collect())) == [("f1", 12, 20), ("f2", None, 18)]
    listing = readers.shards(spark, str(tmp_path))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in re.findall(r"ReadSchema.*", plan)[0] if "ReadSchema" in plan else True


def test_labeller_that_gives_nothing_stops_the_job(spark):
    from rankfile.operators import labelling

    class Broken:
        def __init__(self):
            raise OSError("no such engine")

    df = spark.createDataFrame([("x",)] * 100, "fen string").coalesce(1)
    with pytest.raises(Exception, match="gave nothing after 20 starts"):
        labelling.labelled(df, Broken).collect()
    assert labelling.labelled(df.limit(5), Broken).where("eval_cp is null").count() == 5
