"""Operator 10, n-gram Jaccard join over parity sketches.

A document's set holds its distinct shingles of five words, as 64-bit hashes.  Equal sets are one class; all that follows is
about classes, so copies cost no pairs.  With Jaccard similarity >= 0.8 two sets of a and b elements differ in at most
(a + b) / 9 of them.

1. Sketch.  Sets are put in size bands (ratio 3; a set also joins the band below if partners of it may be there).  In a band every
   set, however small, is folded into g blocks by XOR -- a parity sketch of 64-bit words, in which two sets that differ in d
   elements differ in d blocks at most.
2. Pigeonhole.  Linked sets therefore share g - d of their (band, block, XOR) keys, and under any one order of all keys the first
   shared one is among the first d + 1 of both.  The order puts keys that are frequent in a sample last, so that a passage which
   many documents hold brings few together; what is found does not depend on it.  Empty blocks are keys too, last of all.
3. Candidates.  A key of two classes gives a pair.  A key of more gives a star around one class, and the list of its members.
   Pairs are pruned by a second parity sketch of 2 to 4 bits an element, whose Hamming distance is a lower bound too, and verified
   on the whole sets, which are sent once for all pairs of a block.
4. Rest.  Lists whose members lie in different components after that are compared exactly: members outside the list's main
   component against all others, in blocks, by the sketches; what passes is verified.  So no pair of a key is left out, and a
   group of near copies gives about as many rows as it has members.

Sets are compared by the 64-bit hashes of their shingles, and equal sets are told by a 64-bit digest.

Defined results: null or blank text has an empty set (0 shingles) and links with nothing; equal rows link; very long texts are one
set like others; rows with the same id and unlike texts are classes of their own that carry the same id; a null id keeps a null
component, links with nothing and stays in ``one_of_each``; an empty table gives an empty result; columns beside id and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, checkpoint, components, few, mix, release, slices, smallest_reachable, split_words, trim, word_hashes

WORDS = 5
TOPS = np.array([64 * 3**k for k in range(24)], np.int64)  # the largest set of each band
BLOCKS = np.array([128, *(6 * t // 10 for t in TOPS[1:].tolist())], np.int64)
SHORT = U((1 << 40) - 1)  # classes are named by 40 bits in keys; the few that share a name are told apart at the sketches
SLOTS = 22  # bits of a key that name its place among the frequencies
NOTHING = U(0x5851F42D4C957F2D)  # the value of an empty block
FLUSH = 1_500_000
PIECE = 1 << 20  # bytes of text whose shingles are held at once
BLOCK = 4096
ROUNDS = ((0, 3), (3, 16), (16, 128), (128, None))  # places of the members that one of a list asks, nearest (itself) first


def shingles(text: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    codes, offsets, distinct = split_words(text, lower=True)
    h = word_hashes(distinct)[codes] if len(distinct) else np.zeros(0, U)
    m = len(h) - words + 1
    powers = [mix(np.array([k + 1], U))[0] | U(1) for k in range(words)]
    grams = np.zeros(max(m, 0), U)
    for k in range(words):
        if m > 0:
            grams += h[k : k + m] * powers[k]
    grams = mix(grams)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(mix(np.array([sum((int(h[a + k]) * int(powers[k]) for k in range(b - a)), b - a) % 2**64], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """The class of each set; 0 for empty ones."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(len(sets), U)
    full = n > 0
    if full.any():
        e = np.concatenate(sets)
        first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
        out[full] = mix(np.add.reduceat(e, first) ^ mix(np.bitwise_xor.reduceat(mix(e + U(77)), first) + n[full].astype(U)))
    return out.view(np.int64)


def folded(sets: list[np.ndarray], band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key of 44 bits) for the blocks of sets, folded as ``band`` says, that hold something."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    if not n.sum():
        return np.zeros(0, np.int64), np.zeros(0, U)
    e, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    block = ((e >> U(32)) * BLOCKS[band].astype(U)[own]) >> U(32)  # rises with the hash, so blocks are runs
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (own[1:] != own[:-1])]))
    own = own[first]
    return own, name(np.bitwise_xor.reduceat(e, first), block[first], band[own])


def name(value: np.ndarray, block: np.ndarray, band: np.ndarray) -> np.ndarray:
    return mix(value ^ mix(block + ((band.astype(U) + U(1)) << U(40)))) >> U(20)


def first_keys(sets: list[np.ndarray], band: np.ndarray, d: np.ndarray, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): of each set (4,096 at most) the first d + 1 keys in the order of (frequency, key)."""
    own, key = folded(sets, band)
    rank = frequency[key >> U(44 - SLOTS)].astype(U)
    found = np.bincount(own, minlength=len(sets))
    more_own, more_key = [own], [key]
    more_rank = [rank]
    for k in np.flatnonzero((found <= d) & (np.fromiter(map(len, sets), np.int64, len(sets)) > 0)).tolist():
        # too few blocks hold something: empty ones are keys as well, after all others
        g = int(BLOCKS[band[k]])
        empty = np.setdiff1d(np.arange(g, dtype=U), ((sets[k] >> U(32)) * U(g)) >> U(32))
        more_key.append(name(np.full(len(empty), NOTHING), empty, np.full(len(empty), band[k])))
        more_own.append(np.full(len(empty), k))
        more_rank.append(np.full(len(empty), 255, U))
    own, key, rank = np.concatenate(more_own), np.concatenate(more_key), np.concatenate(more_rank)
    packed = np.sort((own.astype(U) << U(52)) | (rank << U(44)) | key)
    own = (packed >> U(52)).astype(np.int64)
    place = np.arange(len(own)) - np.searchsorted(own, np.arange(len(sets)))[own]
    keep = place <= d[own]
    return own[keep], packed[keep] & U((1 << 44) - 1)


def signatures(sets: list[np.ndarray], frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): the keys under which each set meets every set it may link with.  Two sets meet in the band of the smaller one."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    band = np.searchsorted(TOPS, n)
    own, key = first_keys(sets, band, (n + np.minimum(5 * n // 4, 5 * TOPS[band] // 4)) // 9, frequency)
    low = TOPS[np.maximum(band - 1, 0)]
    some = np.flatnonzero((band > 0) & (4 * n <= 5 * low))
    if not len(some):
        return own, key
    own2, key2 = first_keys([sets[k] for k in some.tolist()], band[some] - 1, (n[some] + low[some]) // 9, frequency)
    return np.concatenate([own, some[own2]]), np.concatenate([key, key2])


def parity(s: np.ndarray) -> bytes:
    """The parity sketch of a set: bit h mod m is the parity of the elements there, m a power of two of at least 2 n bits."""
    bits = 64
    while bits < 2 * len(s):
        bits *= 2
    count = np.bincount(((s * U(0x9E3779B97F4A7C15)) >> U(24)).astype(np.int64) & (bits - 1), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8)).tobytes()


def fold_to(x: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows of bytes) folded by XOR to ``size`` bytes: a sketch of m bits folds to that of m / 2."""
    while x.shape[1] > size:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def apart(x: bytes, y: bytes) -> int:
    """Hamming distance of two parity sketches; the longer one is folded."""
    size = min(len(x), len(y))
    a, b = (fold_to(np.frombuffer(z, np.uint8)[None, :], size) for z in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def may_link(x, y):
    return 5 * np.minimum(x, y) >= 4 * np.maximum(x, y)


SCHEMA = "kind int, pid long, a long, b long, n long, blob binary"
NAMES = ["kind", "pid", "a", "b", "n", "blob"]
DOC, PAIR, LIST, CLASS, KEYS = range(5)
KEY = np.dtype([("key", np.uint8, 5), ("c", np.uint8, 5), ("size", np.uint8)])


def emit(kind, pid, a, b, n, blob=None) -> pa.RecordBatch:
    count = len(n)
    cols = [pa.array(np.full(count, kind, np.int32)), *(pa.nulls(count, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (pid, a, b, n)), pa.nulls(count, pa.binary()) if blob is None else pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=NAMES)


def five(x: np.ndarray) -> np.ndarray:
    """The lower 40 bits as rows of bytes."""
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5]


def wide(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :5] = x
    return out.view("<u8").ravel()


def describe(key: str, buckets: int, shared):
    """Per document its class and the size of its set (DOC), per class of a task its sketch (CLASS), and keys by bucket (KEYS).
    A task names the last 200,000 classes it met once."""

    def run(batches):
        frequency = shared.value
        held, size, seen = [], 0, set()

        def flush():
            k, at = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            k, at = k[order := np.argsort(at, kind="stable")], at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            ends = np.append(first[1:], len(k))
            return emit(KEYS, at[first], None, None, ends - first, [k[a:b].tobytes() for a, b in zip(first.tolist(), ends.tolist(), strict=True)])

        for big in batches:
            for b in slices(big, "text", PIECE):
                sets = shingles(b.column("text"))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                c = digests(sets)
                doc = b.column(key).cast(pa.int64())
                here = np.zeros(len(sets), bool) | doc.is_valid().to_numpy(zero_copy_only=False)
                spread = (mix(np.arange(len(sets)).astype(U) + U(len(seen) * 4096)) % U(buckets)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sets), DOC, np.int32)), pa.array(spread), doc, pa.array(c), pa.array(n), pa.nulls(len(sets), pa.binary())], names=NAMES)
                _, lead = np.unique(c, return_index=True)
                new = [k for k in np.sort(lead).tolist() if n[k] and here[k] and c[k] not in seen]
                if not new:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.update(c[new].tolist())
                some = [sets[k] for k in new]
                yield emit(CLASS, spread[new], doc.take(pa.array(new)).to_numpy(), c[new], n[new], [parity(s) for s in some])
                own, sig = signatures(some, frequency)
                k = np.empty(len(own), KEY)
                k["key"], k["c"] = five(sig), five(c[new].view(U))[own]
                k["size"] = np.minimum(16 * np.log2(n[new]), 255).astype(np.uint8)[own]
                held.append((k, ((sig * U(buckets)) >> U(44)).astype(np.int64)))
                size += len(k)
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        held.clear()
        trim()

    return run


def meet(batches):
    """From the keys of each bucket: candidate pairs of class names (PAIR, a < b), and the members of keys of three and more
    classes (LIST: ``a`` names the list, ``b`` its part); other rows pass.  Rows come in order of their buckets."""
    blobs: list[bytes] = []
    bucket, pairs, held, known = None, [np.zeros((0, 2), np.int64)], 0, set()

    def flush_pairs(most):
        nonlocal pairs, held
        if held > most:
            pairs = [np.unique(np.concatenate(pairs), axis=0)]
            held = 0

    def close():
        nonlocal held
        k = np.frombuffer(b"".join(blobs), KEY)
        blobs.clear()
        key, c, size = wide(k["key"]), wide(k["c"]).astype(np.int64), k["size"].astype(np.int64)
        order = np.lexsort((c, key))
        key, c, size = key[order], c[order], size[order]
        one = np.ones(len(key), bool)
        one[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
        key, c, size = key[one], c[one], size[one]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        many = count > 1
        first, count = first[many], count[many]
        if not len(first):
            return
        # a star around the first class of each key in one order of all classes, so that keys of one group share their centres
        at = np.concatenate([np.arange(a, a + m) for a, m in zip(first.tolist(), count.tolist(), strict=True)])
        group = np.repeat(np.arange(len(first)), count)
        h = mix(c[at].view(U))
        start = np.concatenate([[0], np.cumsum(count)[:-1]])
        centre = at[np.lexsort((h, group))[start]][group]
        # sizes are known to a sixteenth of a power of two: 1.25 is 5.2 steps
        ok = (c[at] != c[centre]) & ((np.abs(size[at] - size[centre]) <= 6) | (size[at] == 255) | (size[centre] == 255))
        x, y = c[at[ok]], c[centre[ok]]
        pairs.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0))
        held += len(pairs[-1])
        flush_pairs(1_000_000)
        alike = np.bitwise_xor.reduceat(mix(h), start) ^ mix(count.astype(U))
        rows = []
        for g in np.flatnonzero(count > 2).tolist():
            if (id_ := int(alike[g])) not in known:
                if len(known) > 500_000:
                    known.clear()
                known.add(id_)
                rows.append((id_, c[first[g] : first[g] + count[g]]))
        if rows:
            parts = [(i, p, x[p : p + 50_000]) for i, x in rows for p in range(0, len(x), 50_000)]
            yield emit(LIST, None, np.array([i for i, _, _ in parts], U).view(np.int64), [p for _, p, _ in parts], [len(x) for _, _, x in parts], [x.tobytes() for _, _, x in parts])

    for big in batches:
        kind = big.column("kind").to_numpy(zero_copy_only=False)
        yield big.filter(pa.array(kind != KEYS))
        keys = big.filter(pa.array(kind == KEYS))
        for pid, blob in zip(keys.column("pid").to_pylist(), keys.column("blob").to_pylist(), strict=True):
            if pid != bucket and blobs:
                yield from close()
            bucket = pid
            blobs.append(blob)
    if blobs:
        yield from close()
    found = np.unique(np.concatenate(pairs), axis=0)
    for at in range(0, len(found), 100_000):
        part = found[at : at + 100_000]
        yield emit(PAIR, None, part[:, 0], part[:, 1], np.zeros(len(part), np.int64))


def sketch_filter(batches):
    """Keeps pairs that the parity sketches allow: |A xor B| <= (a + b) / 9."""
    for b in batches:
        na, nb = b.column("na").to_pylist(), b.column("nb").to_pylist()
        ka, kb = b.column("ka").to_pylist(), b.column("kb").to_pylist()
        keep = [may_link(x, y) and 9 * apart(u, v) <= x + y for x, y, u, v in zip(na, nb, ka, kb, strict=True)]
        yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "da", "db"])


def set_rows(key: str):
    def run(batches):
        for big in batches:
            for b in slices(big, "text", PIECE):
                sets = shingles(b.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(digests(sets)), pa.array([s.tobytes() for s in sets], pa.binary())], ["c", "items"])

    return run


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    if not may_link(len(x), len(y)):
        return False
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


def exact(edges: pa.Table, sets: pa.Table) -> pa.Table:
    """The edges of a block that truly link, from the sets of the block."""
    of = dict(zip(sets.column("c").to_pylist(), sets.column("items").to_pylist(), strict=True))
    rows = zip(edges.column("a").to_pylist(), edges.column("b").to_pylist(), strict=True)
    keep = [x in of and y in of and linked(np.frombuffer(of[x], U), np.frombuffer(of[y], U)) for x, y in rows]
    return edges.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def to_blocks(batches, most: int = 256):
    """Deals candidate edges into blocks: what hangs together in a partition goes to one block, ``most`` edges at most, so that a
    set is sent to few of them."""
    for b in batches:
        x, y = b.column("a").to_numpy(), b.column("b").to_numpy()
        if not len(x):
            continue
        nodes, root = smallest_reachable(x, y)
        group = root[np.searchsorted(nodes, x)]
        order = np.lexsort((y, x, group))
        part = group[order]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        place = np.arange(len(part)) - np.repeat(start, np.diff(np.append(start, len(part))))
        block = mix(part.view(U) + mix((place // most).astype(U))).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(block), *(c.take(pa.array(order)) for c in b.columns)], ["block", *b.schema.names])


def verify(pairs: DataFrame, meta: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The pairs of class names (a, b) that truly link, as classes."""
    side = lambda x: meta.select(F.col("short").alias(x), F.col("c").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("doc").alias(f"d{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").drop("a", "b").withColumnsRenamed({"ca": "a", "cb": "b"})
    near = near.mapInArrow(sketch_filter, "a long, b long, da long, db long")
    near = checkpoint(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "da", "db").dropDuplicates(["a", "b"]).mapInArrow(to_blocks, "block long, a long, b long, da long, db long"))
    needed = near.select(F.explode(F.array("da", "db")).alias(key)).distinct()
    sets = docs.select(key, "text").join(few(needed), key).mapInArrow(set_rows(key), "c long, items binary")
    asked = near.select("block", F.explode(F.array("a", "b")).alias("c")).distinct()
    sent = asked.join(sets.dropDuplicates(["c"]), "c").select("block", "c", "items")
    return near.select(F.col("block").alias("at"), "a", "b").groupBy("at").cogroup(sent.groupBy("block")).applyInArrow(exact, "a long, b long")


def rest_of(first: int, last: int | None):
    """Pairs of a list's block: members of unlike components whose sizes and sketches allow a link.  The members told to one that asks
    stand in order of the sketches' distance, which no component changes; those at places from ``first`` up to ``last`` are taken,
    and a row without a pair says that later places hold some in unlike components."""

    def run(rows: pa.Table) -> pa.Table:
        c, part, n, asks = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("short", "part", "n", "asks"))
        blobs = rows.column("sketch").to_pylist()
        size = np.fromiter(map(len, blobs), np.int64, len(blobs))
        told = {s: np.flatnonzero(~asks & (size == s)) for s in np.unique(size[~asks]).tolist()}
        joined = {s: np.frombuffer(b"".join(blobs[k] for k in y), np.uint8).reshape(len(y), -1) for s, y in told.items()}
        out, more = [np.zeros((0, 2), np.int64)], False
        for sx in np.unique(size[asks]).tolist():
            folds = {}
            for sy in told:
                to = min(sx, sy)
                folds[sy] = to, fold_to(joined[sy], to).view(U)
            for k in np.flatnonzero(asks & (size == sx)).tolist():
                if (part[~asks] == part[k]).all():
                    continue
                near, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for sy, (to, ky) in folds.items():
                    y = told[sy]
                    live = np.flatnonzero(may_link(n[y], n[k]))
                    d = np.bitwise_count(ky[live] ^ fold_to(np.frombuffer(blobs[k], np.uint8)[None, :], to).view(U)).sum(axis=1, dtype=np.int64)
                    ok = 9 * d <= n[y[live]] + n[k]
                    near.append(y[live[ok]])
                    far.append(d[ok])
                near, far = np.concatenate(near), np.concatenate(far)
                near = near[np.lexsort((c[near], far))]
                unlike = part[near] != part[k]
                to_ = c[near[first:last][unlike[first:last]]]
                out.append(np.stack([np.minimum(to_, c[k]), np.maximum(to_, c[k])], axis=1))
                more |= last is not None and bool(unlike[last:].any())
        found = np.unique(np.concatenate(out), axis=0)
        g, i, j = (rows.column(x)[0].as_py() for x in ("g", "i", "j"))
        cols = {x: pa.array([v] * (len(found) + more), t) for x, v, t in (("g", g, pa.int64()), ("i", i, pa.int32()), ("j", j, pa.int32()))}
        return pa.table({**cols, **{x: pa.array([*found[:, k].tolist(), *[None] * more], pa.int64()) for k, x in enumerate("ab")}})

    return run


def left_over(lists: DataFrame, meta: DataFrame, links: DataFrame, comp: DataFrame, pairs: DataFrame, verified) -> DataFrame:
    """The components once the pairs are verified that lists of three and more members still leave open.  Members outside a list's
    main component ask all others, the nearest first: most find a link there, and then ask no further in what has become their own
    component.  Whatever stays apart is asked to the end, so no link between components is lost."""

    def spread(batches):
        for b in batches:
            for g, blob in zip(b.column("a").to_pylist(), b.column("blob").to_pylist(), strict=True):
                d = np.frombuffer(blob, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), g)), pa.array(d)], ["g", "short"])

    members = lists.dropDuplicates(["a", "b"]).select("a", "blob").mapInArrow(spread, "g long, short long")
    parts = lambda comp: comp.select(F.col("node").alias("c"), F.col("component_id").alias("part"))
    named = meta.join(parts(comp), "c", "left").select("short", "c", "n", F.coalesce("part", "c").alias("part"))
    members = checkpoint(members.join(named, "short").select("g", "short", "c", "n", "part"))
    by = members.groupBy("g", "part").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "part"))["part"].alias("main"), F.sum("k").alias("k"), F.max("k").alias("same"))
    by = by.where("k > same").select("g", "main", F.ceil(F.col("k") / BLOCK).cast("int").alias("all"), F.ceil((F.col("k") - F.col("same")) / BLOCK).cast("int").alias("out"))
    # who asks is settled here, and so is every order; only components change from round to round
    open_ = checkpoint(members.join(by, "g").withColumn("asks", F.col("part") != F.col("main")).drop("part", "main"))
    own = lambda col, seed: F.expr(f"cast(pmod(xxhash64(short, {seed}), {col}) as int)")
    cols = ("short", "c", "n")
    asks = open_.where("asks").withColumn("i", own("out", 1)).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all") - 1))).select("g", "i", "j", F.lit(True).alias("asks"), *cols)
    told = open_.withColumn("j", own("all", 2)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("out") - 1))).select("g", "i", "j", F.lit(False).alias("asks"), *cols)
    dealt, blocks, tested = asks.unionByName(told), None, pairs
    for first, last in ROUNDS:
        rows = dealt if blocks is None else dealt.join(blocks, ["g", "i", "j"], "left_semi")
        rows = rows.join(parts(comp), "c", "left").withColumn("part", F.coalesce("part", "c")).join(meta.select("c", "sketch"), "c")
        found = checkpoint(rows.select("g", "i", "j", "asks", "short", "n", "part", "sketch").groupBy("g", "i", "j").applyInArrow(rest_of(first, last), "g long, i int, j int, a long, b long"))
        more = found.where("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti")
        more = checkpoint(more)
        if not more.isEmpty():
            late = checkpoint(verified(more))
            if not late.isEmpty():
                links = links.unionByName(late)
                comp = checkpoint(components(links))
            tested = tested.unionByName(more)
        blocks = found.where("a is null").select("g", "i", "j").distinct()
        if blocks.isEmpty():
            break
        release(rows.sparkSession)
    return comp


def classes(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(doc, c, n) of every row, and (c, root, component_id) of every class that holds something."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(key).cast("long").alias(key), "text")
    size = plain.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(8 * partitions, (size["bytes"] or 0) >> 22)  # the keys of some 4 MB of text each
    shared = spark.sparkContext.broadcast(frequencies(plain, size["n"], key))
    found = plain.mapInArrow(describe(key, buckets, shared), SCHEMA).repartition(partitions, "pid").sortWithinPartitions("pid").mapInArrow(meet, SCHEMA)
    found = checkpoint(found.select("kind", "a", "b", "n", "blob"))
    rows = found.where(F.col("kind") == DOC).select(F.col("a").alias("doc"), F.col("b").alias("c"), "n")
    meta = found.where(F.col("kind") == CLASS).select(F.col("b").alias("c"), F.col("b").bitwiseAND(int(SHORT)).alias("short"), "n", F.col("a").alias("doc"), F.col("blob").alias("sketch"))
    meta = checkpoint(meta.dropDuplicates(["c"]))
    pairs = checkpoint(found.where(F.col("kind") == PAIR).select("a", "b").distinct())
    links = checkpoint(verify(pairs, meta, plain, key))
    release(spark)
    comp = checkpoint(components(links))
    lists = found.where(F.col("kind") == LIST).select("a", "b", "blob")
    comp = left_over(lists, meta, links, comp, pairs, lambda more: verify(more, meta, plain, key))
    least = rows.where("n > 0 and doc is not null").groupBy("c").agg(F.min("doc").alias("m"))
    least = least.join(comp.select(F.col("node").alias("c"), F.col("component_id").alias("root")), "c", "left").select("c", "m", F.coalesce("root", "c").alias("root"))
    least = checkpoint(least)
    return rows, least.select("c", "root").join(least.groupBy("root").agg(F.min("m").alias("component_id")), "root").select("c", "root", "component_id")


def frequencies(docs: DataFrame, total: int, key: str, n: int = 4000) -> np.ndarray:
    """How frequent keys are among some ``n`` documents, by slot, in sixteenths of a power of two; it only orders keys."""
    some = docs.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) <= (1 << 20) * n // max(total, 1)) if total > n else docs

    def run(batches):
        for big in batches:
            for b in slices(big, "text", PIECE):
                sets = shingles(b.column("text"))
                c, lead = np.unique(digests(sets), return_index=True)
                sets = [sets[k] for k in lead.tolist()]
                band = np.searchsorted(TOPS, np.fromiter(map(len, sets), np.int64, len(sets)))
                own, sig = folded(sets, band)
                yield pa.RecordBatch.from_arrays([pa.array((sig >> U(44 - SLOTS)).astype(np.int64)), pa.array(c[own])], ["slot", "c"])

    counted = some.mapInArrow(run, "slot long, c long").distinct().groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    out = np.zeros(1 << SLOTS, np.uint8)
    out[counted.column("slot").to_numpy()] = np.minimum(16 * np.log2(counted.column("n").to_numpy()), 254).astype(np.uint8)
    return out


def join(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row, by whole texts."""
    rows, of = classes(docs, key)
    out = rows.join(of.select("c", "component_id"), "c", "left")
    return out.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, that are the smallest id of their group; rows without an id stay.  Of rows that share an
    id and a group one stays, that of the smallest digest."""
    rows, of = classes(docs, key)
    rows = checkpoint(rows.join(of, "c", "left").where("doc is not null"))
    again = rows.groupBy("doc").agg(F.count("*").alias("k")).where("k > 1").select("doc")
    gone = rows.where("component_id <> doc").select(F.col("doc").alias(key))
    if again.isEmpty():
        return docs.join(few(gone), key, "left_anti").select(docs.columns)
    again = checkpoint(again)
    # repeated ids: rows are told apart by their class
    stay = rows.join(again, "doc", "left_semi").where("component_id is null or component_id = doc").groupBy("doc", F.coalesce("root", "c").alias("root")).agg(F.min("c").alias("c")).select("doc", "c")
    once = docs.join(few(gone), key, "left_anti").join(few(again.withColumnRenamed("doc", key)), key, "left_anti").select(docs.columns)

    def run(batches):
        for big in batches:
            for b in slices(big, "text", PIECE):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests(shingles(b.column("text"))))], [*b.schema.names, "_class"])

    many = docs.join(few(again.withColumnRenamed("doc", key)), key, "left_semi").select(docs.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    many = many.mapInArrow(run, f"{schema}, _class long").join(stay.select(F.col("doc").alias(key), F.col("c").alias("_class")), [key, "_class"], "left_semi")
    return once.unionByName(many.dropDuplicates([key, "_class"]).select(docs.columns))


def op10_jaccard(docs: DataFrame) -> DataFrame:
    return join(docs)
