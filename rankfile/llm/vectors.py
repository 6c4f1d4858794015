"""Operator 8, near-duplicate vectors through a robust-pruned flat graph.

Vectors that are equal after scaling to length 1 collapse to one point first.  Points are dealt to overlapping shards: centres
are fitted on a bounded sample, every point joins its ``overlap`` nearest ones, and a centre with more than ``shard`` points is
cut by hash into blocks whose points are compared exactly from all blocks of the centre.  Each block gives two kinds of edges: a
spanning forest of its links, so that no part of it hangs on a graph that may not reach it, and every point's nearest neighbours,
robustly pruned (a neighbour that is ``spread`` times nearer to a chosen one is left out).

The adjacency lists of all shards are joined by point, and the search goes over the joined graph.  A point first expands to the
``hop`` centres that most of its list's members are in and it is not.  Then the range expansion over links runs to its end: all
points that links reach from each other are a group, and a group is compared exactly, all of its blocks against all its blocks, so
that hot groups lose nothing however many centres they are cut into.  What can be missed are links between two groups that no
shard and no expansion brings together.

``audit`` measures recall for the rows whose id is divisible by 50 against all rows, in blocks.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing (0 links, themselves as
component); vectors of unlike length do not link; rows that share an id are one vector, the smallest of theirs, and get its result; a null
id keeps a null component; an empty table gives an empty result; columns beside id and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components

LEAST = 0.9


def unit(batch: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length 1 in double precision; None where it links with nothing.  All vectors of one length at once."""
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    n = len(batch)
    size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = batch.flatten()  # null lists hold nothing here
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    out: list[np.ndarray | None] = [None] * n
    for dim in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == dim)
        x = values[start[at, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1)
        top = np.abs(np.where(good[:, None], x, 0.0)).max(axis=1)
        good &= top > 0
        x = x[good] / top[good, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for k, row in zip(at[good].tolist(), x, strict=True):
            out[k] = row
    return out


def points_of(vectors: DataFrame, key: str, col: str) -> DataFrame:
    """(id, dim, p): unit vectors as bytes; p is null for vectors that link with nothing."""

    def run(batches):
        for b in batches:
            units = unit(b.column(col))
            yield pa.RecordBatch.from_arrays([b.column(key).cast(pa.int64()), pa.array([0 if u is None else len(u) for u in units], pa.int32()), pa.array([None if u is None else u.tobytes() for u in units], pa.binary())], ["id", "dim", "p"])

    return vectors.select(key, col).mapInArrow(run, "id long, dim int, p binary")


def matrix(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(-1, dim)


def centres(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Spherical k-means on the sample."""
    c = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near = (sample @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def alike(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y are within the radius; values at the edge are taken again as single products, so that every block
    decides a pair alike."""
    cos = x @ y.T
    hit = cos >= least
    for i, j in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):
        hit[i, j] = float(x[i] @ y[j]) >= least
    return hit


def prune(x: np.ndarray, degree: int, width: int, spread: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of one block: each point's ``width`` nearest, robustly pruned."""
    n = len(x)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width = min(width, n - 1)
    for at in range(0, n if width > 0 else 0, 256):
        cos = x[at : at + 256] @ x.T
        cos[np.arange(len(cos)), at + np.arange(len(cos))] = -2.0
        near = np.argpartition(-cos, width - 1, axis=1)[:, :width]
        value = np.take_along_axis(cos, near, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        # all rows of the chunk at once: in order of nearness, keep a neighbour unless a kept one is ``spread`` times nearer to it
        some = x[near].astype(np.float32)
        away = 1 - some @ some.transpose(0, 2, 1)
        mine = 1 - value
        alive = np.ones_like(mine, bool)
        kept = np.zeros_like(alive)
        count = np.zeros(len(cos), int)
        for j in range(width):
            take = alive[:, j] & (count < degree)
            kept[:, j] = take
            count += take
            alive &= ~(take[:, None] & (spread * away[:, j, :] <= mine)) | (np.arange(width)[None, :] <= j)
        r, k = np.nonzero(kept)
        left.append(at + r)
        right.append(near[r, k])
    return np.concatenate(left), np.concatenate(right)


def search_block(ids: np.ndarray, x: np.ndarray, home: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block that span all its links: points with ``home`` are compared exactly with every point."""
    base = np.flatnonzero(home)
    part = np.arange(len(x))
    left, right = [], []
    for at in range(0, len(x) if len(base) else 0, 1024):
        hit = alike(x[at : at + 1024], x[base], least)
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            to = base[hit[i]]
            labels, first = np.unique(part[to], return_index=True)
            new = labels != part[at + i]
            if new.any():
                left += [at + i] * int(new.sum())
                right += to[first[new]].tolist()
                part[np.isin(part, labels)] = part[at + i]
    return ids[np.array(left, np.int64)], ids[np.array(right, np.int64)]


def block_search(dim: int, least: float, degree: int = 0, width: int = 0, spread: float = 0.0):
    """Edges (a, b, link) of a block; with a ``degree`` also the pruned lists of its own points, whose ``link`` is false."""

    def search(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
        ids = rows.column("rep").to_numpy()[order]
        x = matrix(rows.column("p").to_pylist(), dim)[order]
        home = rows.column("home").to_numpy(zero_copy_only=False)[order]
        a, b = search_block(ids, x, home, least)
        i, j = prune(x[home], degree, width, spread) if degree else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        link = np.concatenate([np.ones(len(a), bool), np.zeros(len(i), bool)])
        return pa.table({"a": pa.array(np.concatenate([a, ids[home][i]])), "b": pa.array(np.concatenate([b, ids[home][j]])), "link": pa.array(link)})

    return search


def group_links(least: float):
    """(rep, others): for the points of a pair of blocks, the copies that each group's points link with there."""

    def count(rows: pa.Table) -> pa.Table:
        group, rep, side, copies = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "rep", "second", "copies"))
        blobs = rows.column("p").to_pylist()
        order = np.argsort(group, kind="stable")
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        out = np.zeros(len(rep), np.int64)
        for some in np.split(order, cuts) if len(order) else []:
            two = some[side[some]]
            one = some[~side[some]]
            same = not rows.column("across")[0].as_py()
            if same:
                two = one
            if not len(one) or not len(two):
                continue
            x = matrix([blobs[k] for k in one], len(blobs[one[0]]) // 8)
            y = x if same else matrix([blobs[k] for k in two], x.shape[1])
            for at in range(0, len(x), 1024):
                hit = alike(x[at : at + 1024], y, least)
                if same:
                    hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
                out[one[at : at + 1024]] += hit @ copies[two]
                if not same:
                    out[two] += copies[one[at : at + 1024]] @ hit
        return pa.table({"rep": pa.array(rep), "others": pa.array(out)})

    return count


def finer(dealt: DataFrame, dim: int, shard: int, sample: int, crowded: int = 4, portion: int = 20_000) -> DataFrame:
    """Deals the points of crowded centres (over ``crowded`` shards) anew to centres of their own, fitted on some ``sample`` of the
    centre's points, each to its two nearest: work grows with the points, not with their square, until only points alike share a
    centre.  Points and fitted centres meet in portions, so no task holds a whole crowd."""
    sizes = dealt.groupBy("centre").agg(F.count("*").alias("n"))
    big = checkpoint(sizes.where(F.col("n") > crowded * shard))
    if big.isEmpty():
        return dealt
    big = F.broadcast(big)  # at most a row for every ``crowded * shard`` points of a sample-bounded number of centres

    def fit(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
        x = matrix(rows.column("p").to_pylist(), dim)[order]
        k = max(2, min(len(x) // 4, 2 * -(-rows.column("n")[0].as_py() // shard)))
        c = centres(x, min(k, len(x)))
        return pa.table({"of": pa.array([rows.column("centre")[0].as_py()] * len(c), pa.int64()), "c": pa.array([v.tobytes() for v in c], pa.binary())})

    crowd = dealt.join(big, "centre")
    fitted = checkpoint(crowd.where(F.pmod(F.xxhash64("rep", F.lit(13)), F.col("n")) < sample).groupBy("centre").applyInArrow(fit, "of long, c binary"))
    parts = F.ceil(F.col("n") / portion).cast("int")
    crowd = crowd.withColumn("part", F.expr(f"cast(pmod(xxhash64(rep, 17), ceil(n / {portion})) as int)")).select("centre", "part", "rep", "p")
    spread = fitted.join(big.withColumnRenamed("centre", "of"), "of").withColumn("in", F.explode(F.sequence(F.lit(0), parts - 1))).select("of", "in", "c")

    def assign(rows: pa.Table, near: pa.Table) -> pa.Table:
        blobs = sorted(near.column("c").to_pylist()) if near.num_rows else []
        if not rows.num_rows or not blobs:
            return pa.table({"centre": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "p": pa.array([], pa.binary())})
        x, wide = matrix(rows.column("p").to_pylist(), dim), min(2, len(blobs))
        cos = x @ matrix(blobs, dim).T
        best = np.argpartition(-cos, wide - 1, axis=1)[:, :wide]
        at = np.repeat(np.arange(len(x)), wide)
        first = rows.column("centre")[0].as_py()
        return pa.table({"centre": pa.array((first + 1) * (1 << 32) + best.ravel()), "rep": rows.column("rep").take(pa.array(at)), "p": rows.column("p").take(pa.array(at))})

    again = crowd.groupBy("centre", "part").cogroup(spread.groupBy("of", "in")).applyInArrow(assign, "centre long, rep long, p binary")
    return checkpoint(dealt.join(big, "centre", "left_anti").unionByName(again))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", col: str = "embedding", least: float = LEAST, shard: int = 1500, overlap: int = 3, degree: int = 24, width: int = 64, spread: float = 1.2, hop: int = 3, group: int = 4096, sample: int = 8192) -> DataFrame:
    """(key, n_links, component_id, kept) of every vector."""
    spark = vectors.sparkSession
    rows = checkpoint(points_of(vectors, key, col))
    full = rows.where("p is not null and id is not null").groupBy("id").agg(F.min(F.struct("dim", "p")).alias("m")).select("id", "m.dim", "m.p")
    # equal points collapse; the digest groups them, its bytes are compared by being the key's own value
    groups = full.groupBy("dim", "p").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    points = checkpoint(groups)
    links = None
    for dim, total in sorted((r["dim"], r["n"]) for r in points.groupBy("dim").agg(F.count("*").alias("n")).collect()):
        some = points.where(F.col("dim") == dim)
        k = max(1, round(total / (shard / 2 / overlap)))
        picked = matrix([bytes(r[0]) for r in some.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("p").collect()], dim)
        k = min(k, max(1, len(picked) // 4))
        shared = spark.sparkContext.broadcast(centres(picked, k))
        wide = min(overlap, k)

        def deal(batches, shared=shared, dim=dim, wide=wide, k=k):
            c = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                cos = matrix(b.column("p").to_pylist(), dim) @ c.T
                near = np.argpartition(-cos, wide - 1, axis=1)[:, :wide] if wide < k else np.tile(np.arange(k), (b.num_rows, 1))
                at = np.repeat(np.arange(b.num_rows), wide)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), b.column("rep").take(pa.array(at)), b.column("p").take(pa.array(at))], ["centre", "rep", "p"])

        dealt = checkpoint(some.select("rep", "p").mapInArrow(deal, "centre long, rep long, p binary"))
        dealt = finer(dealt, dim, shard, sample)
        sizes = dealt.groupBy("centre").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
        # a point is indexed in its own block and asks every block of its centre
        asked = dealt.join(sizes, "centre").select("centre", "rep", "p", F.expr("pmod(xxhash64(rep, 7), blocks)").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asked = asked.select("centre", "block", "rep", "p", (F.col("own") == F.col("block")).alias("home"))

        edges = checkpoint(asked.groupBy("centre", "block").applyInArrow(block_search(dim, least, degree, width, spread), "a long, b long, link boolean"))
        found = edges.where("link").select("a", "b")
        if wide < k and hop:
            # the lists of all shards joined by point, and the centres most of their members are in
            joined = edges.where("not link").select("a", "b").distinct()
            seats = dealt.select(F.col("rep").alias("b"), "centre")
            votes = joined.join(seats, "b").groupBy("a", "centre").agg(F.count("*").alias("n"))
            votes = votes.join(seats.withColumnRenamed("b", "a"), ["a", "centre"], "left_anti")
            most = votes.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "centre"))), 1, hop).alias("most"))
            more = most.select(F.col("a").alias("rep"), F.explode("most.centre").alias("centre")).join(some.select("rep", "p"), "rep").join(sizes, "centre")
            more = more.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "p", F.lit(False).alias("home"))
            again = asked.where("home").unionByName(more).groupBy("centre", "block").applyInArrow(block_search(dim, least), "a long, b long, link boolean")
            found = found.unionByName(checkpoint(again.select("a", "b")))
        links = found if links is None else links.unionByName(found)
    out = rows.select(F.col("id").alias(key))
    if links is None:
        return out.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"), F.col(key).isNotNull().alias("kept"))

    comp = checkpoint(components(links))
    # each group in blocks, all against all; groups of one block share a task
    members = points.join(comp.withColumnRenamed("node", "rep"), "rep").select("rep", "p", "copies", F.col("component_id").alias("grp"))
    cut = members.groupBy("grp").agg(F.ceil(F.count("*") / group).cast("int").alias("blocks"))
    tasks = max(1, points.count() // group)
    placed = members.join(cut, "grp").withColumn("own", F.expr("cast(pmod(xxhash64(rep, 11), blocks) as int)"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("grp", "rep", "p", "copies", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(tasks))).otherwise(-1 - F.col("grp")).alias("task"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), (F.col("own") != F.col("other")).alias("across"))
    direct = placed.groupBy("task", "i", "j").applyInArrow(group_links(least), "rep long, others long").groupBy("rep").agg(F.sum("others").alias("others"))
    reps = points.join(direct, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    reps = reps.select("dim", "p", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    done = full.join(reps, ["dim", "p"]).select(F.col("id").alias(key), "n_links", "component_id")
    out = out.join(done, key, "left").select(key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", key).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, result: DataFrame, key: str = "vec_id", col: str = "embedding", least: float = LEAST, every: int = 50, block: int = 2000) -> DataFrame:
    """(found, true, recall) of links for the rows whose id is divisible by ``every``, against all rows in blocks of queries."""
    spark = vectors.sparkSession
    rows = points_of(vectors, key, col).where("p is not null and id is not null").dropDuplicates(["id"])
    asked = rows.where(F.col("id") % every == 0)
    n = asked.count()
    parts = max(1, -(-n // block))
    total = None
    for p in range(parts):
        q = [(r["id"], r["dim"], bytes(r["p"])) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p).collect()]
        shared = spark.sparkContext.broadcast(q)

        def run(batches, shared=shared):
            by: dict[int, list] = {}
            for i, d, x in shared.value:
                by.setdefault(d, []).append((i, x))
            for b in batches:
                for d, some in by.items():
                    at = np.flatnonzero(b.column("dim").to_numpy() == d)
                    if not len(at):
                        continue
                    ids = b.column("id").to_numpy()[at]
                    x = matrix([b.column("p")[int(k)].as_py() for k in at], d)
                    mine = np.array([i for i, _ in some])
                    hit = (x @ matrix([v for _, v in some], d).T >= least) & (ids[:, None] != mine[None, :])
                    count = hit.sum(axis=0)
                    keep = count > 0
                    yield pa.RecordBatch.from_arrays([pa.array(mine[keep]), pa.array(count[keep])], ["id", "n"])

        one = rows.mapInArrow(run, "id long, n long")
        total = one if total is None else total.unionByName(one)
    true = total.groupBy("id").agg(F.sum("n").alias("n"))
    both = true.join(result.select(F.col(key).alias("id"), "n_links"), "id")
    return both.agg(F.sum(F.least("n_links", "n")).alias("found"), F.sum("n").alias("true")).withColumn("recall", F.coalesce(F.col("found") / F.col("true"), F.lit(1.0)))


def op8_vectors(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
