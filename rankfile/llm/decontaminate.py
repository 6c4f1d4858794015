"""Operator 5, benchmark decontamination by latent semantic retrieval.

Documents are read in windows of 24 words every 12, benchmark items in passages of at most 36.  TF-IDF weights use document
frequencies over all rows, for the words of the benchmark (others only lengthen a window's vector).  A distributed randomised
SVD of TF-IDF passages -- all windows of all documents and all of the benchmark -- gives the latent space; the documents' windows
enter by exact counts of how often two words stand in one window, taken in the scan that counts documents by word, so the
products of the SVD read those counts and not the corpus, and no sample is drawn.  Windows whose benchmark words carry too little
of their length to reach the cosine ``least`` are left out first, which is exact; the others are compared with every benchmark
passage by latent cosine.  A candidate is verified on the words of the item and of the document around the window: the longest common
subsequence must cover ``cover`` of the item, and most of the item's rarest words (its answer) must occur there, so paraphrases with
changed words are caught.

The benchmark is dealt in blocks of about ``PASSAGES`` passages and at most ``BLOCK`` bytes of text, each with a space of its own that
is widened until every passage keeps a cosine of ``HELD`` with itself.  The corpus is read once for the counts of all blocks' words and
pairs of words, and once for every ``TOGETHER`` blocks (some 100 MB to broadcast), whose results a row carries along.

Words outside of the benchmark only lengthen a window's vector: a paraphrase is found by what it keeps, in whatever order, and
verified by the words it keeps in order.

Defined results: null and empty texts, and an empty benchmark, give no leak; items without words match nothing; very long texts are
searched whole; repeated rows, and rows with the same or no id, give a row each; ties between items list all of them; items that
share an id count as one; an empty table gives an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release, slices, split_words, trim

WINDOW, STRIDE = 24, 12
BLOCK = 2 << 20
PIECE = 2 << 20  # bytes of text whose windows are held at once
# Passages of a block, about, and the least cosine of a passage with itself in the latent space.
PASSAGES, HELD = 512, 0.9
TOGETHER = 16  # blocks that are searched in one pass
SHARE = 0.5  # weight of the whole corpus in the latent space, that of all passages of the benchmark being 1
PAIRS = 500_000  # counts of pairs of words that a task holds, about
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"


def cleaned(tokens: pa.Array) -> pa.Array:
    """Tokens in lower case without the marks around them; marks alone leave nothing."""
    return pc.utf8_trim(pc.utf8_lower(tokens), characters=TRIM)


def clean_words(text: str | None) -> list[str]:
    return [c for c in cleaned(pa.array((text or "").split(), pa.string())).to_pylist() if c]


class Ids:
    """Vocabulary ids of raw tokens (-1: another word, -2: no word)."""

    def __init__(self, vocabulary: dict[str, int]):
        self.words = pa.array(list(vocabulary), pa.string())

    def __call__(self, tokens: pa.Array) -> np.ndarray:
        plain = cleaned(tokens)
        ids = pc.fill_null(pc.index_in(plain, value_set=self.words), -1).to_numpy(zero_copy_only=False)
        return np.where(pc.binary_length(plain).to_numpy(zero_copy_only=False) > 0, ids, -2).astype(np.int32)


def word_ids(text: pa.Array, ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    codes, offsets, words = split_words(text)
    got = ids(words)[codes] if len(words) else np.zeros(0, np.int32)
    keep = got > -2
    return got[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end) of every window; the last ones are cut at the document's end."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = offsets[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return doc, start, np.minimum(start + WINDOW, offsets[1:][doc])


def seats(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last window of each word, windows numbered through all documents."""
    n = np.diff(offsets)
    count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)
    base = np.repeat(np.cumsum(count) - count, n)
    return base + np.maximum(0, (at - WINDOW) // STRIDE + 1), base + np.minimum(at // STRIDE, np.repeat(count - 1, n))


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, n) with each code once, in order."""
    code, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n[order], first)


def packed(code: np.ndarray, n: np.ndarray) -> bytes:
    """Steps between codes and counts, each as numbers of as few bytes as hold them."""
    cols = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in (np.diff(code, prepend=0), n)]
    return bytes(x.itemsize for x in cols) + b"".join(x.tobytes() for x in cols)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    size = (len(blob) - 2) // (blob[0] + blob[1])
    code = np.frombuffer(blob, f"u{blob[0]}", size, 2)
    return np.cumsum(code, dtype=np.int64), np.frombuffer(blob, f"u{blob[1]}", size, 2 + size * blob[0]).astype(np.int64)


def add_up(across: int):
    """The counts of each tile in one row for each of the ranges of words that make it; rows come in order of their tiles."""

    def row(tile: int, held: list) -> pa.RecordBatch:
        ranges = [tile] if tile < 0 else sorted({tile // across, tile % across})
        return pa.RecordBatch.from_arrays([pa.array(ranges), pa.array([tile] * len(ranges)), pa.array([packed(*summed(held))] * len(ranges))], ["range", "tile", "blob"])

    def run(batches):
        tile, held, size = None, [], 0
        for b in batches:
            for t, blob in zip(b.column("tile").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if t != tile and held:
                    yield row(tile, held)
                    held, size = [], 0
                tile = t
                held.append(unpacked(blob))
                size += len(held[-1][0])
                if size > PAIRS:
                    held, size = [summed(held)], 0
        if held:
            yield row(tile, held)
        held.clear()
        trim()

    return run


class Tiles:
    """Pairs of vocabulary words as (tile, place): word ids are cut into ranges of ``side``, and two ranges make a tile."""

    def __init__(self, size: int):
        self.side = max(256, -(-size // 64))
        self.across = max(1, -(-size // self.side))
        k, rest = np.divmod(np.arange(size), self.side)
        self.row, self.col = k * self.across * self.side**2 + rest * self.side, k * self.side**2 + rest

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.row[np.minimum(x, y)] + self.col[np.maximum(x, y)]

    def words(self, tile: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tile // self.across * self.side + place // self.side, tile % self.across * self.side + place % self.side


def pair_codes(got: np.ndarray, first: np.ndarray, last: np.ndarray, tiles: Tiles):
    """The codes of all pairs of vocabulary words in one window, once for each window, in parts."""
    known = np.flatnonzero(got >= 0)
    w, first, last = got[known], first[known], last[known]
    for at in range(0, len(w), 20_000):
        a, codes = np.arange(at, min(at + 20_000, len(w))), []
        for s in range(1, WINDOW):
            a = a[: np.searchsorted(a, len(w) - s)]
            shared = last[a] - first[a + s] + 1
            live = shared > 0  # those too far apart stay so
            a, shared = a[live], shared[live]
            if not len(a):
                break
            code = tiles.codes(w[a], w[a + s])
            codes += [code, *(code[shared > k] for k in range(1, WINDOW // STRIDE))]
        if codes:
            yield np.concatenate(codes)


def frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """Counts over all rows and all their windows, in one scan, checkpointed, by tile (code, n): how often two vocabulary words stand
    in one window; under tile -1 the documents that hold each word, all documents, and the places of each word in windows.  A tile of
    two ranges of words comes under either, and the tiles of a range follow each other in one partition."""
    spark = docs.sparkSession
    shared, size = spark.sparkContext.broadcast(vocabulary), len(vocabulary)
    tiles = Tiles(size)
    area = tiles.side**2

    def run(batches):
        ids, counts, held, many = Ids(shared.value), np.zeros(2 * size + 1, np.int64), [], 0

        def flush():
            code, n = summed(held)
            held.clear()
            cut = np.flatnonzero(np.concatenate([[True], np.diff(code // area) > 0]))
            ends = [*cut[1:].tolist(), len(code)]
            blobs = [packed(code[a:z] % area, n[a:z]) for a, z in zip(cut.tolist(), ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(code[cut] // area), pa.array(blobs)], ["tile", "blob"])

        for big in batches:
            for b in slices(big, "text", PIECE // 2):
                got, offsets = word_ids(b.column("text"), ids)
                doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
                at = got >= 0
                seen = np.unique(doc[at] * size + got[at]) % size
                counts[:size] += np.bincount(seen, minlength=size)
                counts[size] += b.num_rows
                first, last = seats(offsets)
                counts[size + 1 :] += np.bincount(got[at], (last - first + 1)[at], size).astype(np.int64)
                for codes in pair_codes(got, first, last, tiles):
                    held.append(np.unique(codes, return_counts=True))
                    many += len(held[-1][0])
                    if many > PAIRS:
                        held[:] = [summed(held)]
                        many = len(held[0][0])
                        if many > PAIRS // 2:
                            yield flush()
                            many = 0
        if held:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([packed(np.arange(len(counts)), counts)])], ["tile", "blob"])
        trim()

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("text").mapInArrow(run, "tile long, blob binary").repartition(partitions, "tile")
    found = found.sortWithinPartitions("tile").mapInArrow(add_up(tiles.across), "range long, tile long, blob binary")
    return checkpoint(found.repartition(partitions, "range").sortWithinPartitions("range", "tile"))


def passage_rows(counted: DataFrame, size: int) -> dict:
    """What ``frequencies`` counted: documents by word, all documents, places by word, and the pairs, which stay distributed."""
    row = counted.where("tile = -1").first()
    n = unpacked(bytes(row["blob"]))[1] if row else np.zeros(2 * size + 1, np.int64)
    return {"df": n[:size], "total": int(n[size]), "places": n[size + 1 :], "pairs": counted.where("tile >= 0")}


def gram_product(known: dict, idf: np.ndarray, q: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A'(A q) for the TF-IDF rows A of all windows of the corpus, scaled to squares that add up to 1, from the counts of pairs.  The
    tiles of a range of words stand together, so a task gives whole rows of the product and no partial ones are shuffled.  ``own`` has
    the row of q for each word of the corpus' counts, -1 for words of other blocks."""
    spark, width = known["pairs"].sparkSession, q.shape[1]
    y, tiles = idf[:, None] * q, Tiles(len(own))
    shared = spark.sparkContext.broadcast((y, own))

    def run(batches):
        x, mine = shared.value
        at, out = None, np.zeros((0, width))

        def rows():
            # of the range's words those of this block, with their rows of the product
            words = mine[at * tiles.side : (at + 1) * tiles.side]
            live = np.flatnonzero((words >= 0) & out[: len(words)].any(axis=1))
            for k in range(0, len(live), 512):
                some = live[k : k + 512]
                yield pa.RecordBatch.from_arrays([pa.array([words[some].tobytes()]), pa.array([out[some].tobytes()])], ["own", "part"])

        for b in batches:
            for k, tile, blob in zip(*(b.column(c).to_pylist() for c in ("range", "tile", "blob")), strict=True):
                if k != at:
                    if at is not None:
                        yield from rows()
                    at, out = k, np.zeros((tiles.side, width))
                place, n = unpacked(blob)
                i, j = tiles.words(tile, place)
                live = (mine[i] >= 0) & (mine[j] >= 0)
                i, j, n = i[live], j[live], n[live]
                for to, of in ((i, j), (j, i)):  # a tile of a range with itself counts both ways
                    if len(to) and to[0] // tiles.side == k:
                        to, r = np.unique(to - k * tiles.side, return_inverse=True)
                        of, c = np.unique(mine[of], return_inverse=True)
                        t = np.zeros((len(to), len(of)))
                        t[r, c] = n
                        out[to] += t @ x[of]
        if at is not None:
            yield from rows()
        del out
        trim()

    places = known["places"][own >= 0][np.argsort(own[own >= 0])]
    out = places[:, None] * y
    for r in known["pairs"].mapInArrow(run, "own binary, part binary").collect():
        out[np.frombuffer(r["own"], np.int64)] += np.frombuffer(r["part"], np.float64).reshape(-1, width)
    shared.destroy()
    return idf[:, None] * out / max(float((places * idf**2).sum()), 1e-12)


class Sparse:
    """Unit rows of few entries."""

    def __init__(self, own: np.ndarray, col: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        norm = np.sqrt(np.bincount(own, value**2, shape[0]))
        self.own, self.col, self.value, self.shape = own, col, value / norm[own], shape

    def times(self, q: np.ndarray) -> np.ndarray:
        """self @ q"""
        return self.sums(self.own, self.col, q, self.shape[0])

    def back(self, y: np.ndarray) -> np.ndarray:
        """self.T @ y"""
        order = np.argsort(self.col, kind="stable")
        return self.sums(self.col, self.own, y, self.shape[1], order)

    def sums(self, to: np.ndarray, of: np.ndarray, x: np.ndarray, n: int, order=None) -> np.ndarray:
        order = np.arange(len(to)) if order is None else order
        out = np.zeros((n, x.shape[1]))
        first = np.flatnonzero(np.concatenate([[True], to[order][1:] != to[order][:-1]]))
        step = 200_000 // max(1, x.shape[1] // 64)
        ends = np.append(first[1:], len(order))
        at = 0
        while at < len(first):
            last = max(at + 1, int(np.searchsorted(ends, first[at] + step, side="right")))
            some = order[first[at] : ends[min(last, len(first)) - 1]]
            out[to[order[first[at:last]]]] = np.add.reduceat(self.value[some, None] * x[of[some]], first[at:last] - first[at], axis=0)
            at = last
        return out

    def rows(self, some: np.ndarray) -> np.ndarray:
        """Dense rows ``some`` (a mask)."""
        place = np.cumsum(some) - 1
        keep = some[self.own]
        out = np.zeros((int(some.sum()), self.shape[1]))
        out[place[self.own[keep]], self.col[keep]] = self.value[keep]
        return out


def item_passages(words: list[int]) -> list[tuple[int, int]]:
    if len(words) <= WINDOW + STRIDE:
        return [(0, len(words))] if len(words) else []
    return [(a, min(a + WINDOW, len(words))) for a in range(0, len(words) - STRIDE, STRIDE)]


def corpus(docs: DataFrame, texts: Iterable[str]) -> dict:
    """What all blocks take from the corpus: counts of all their words and pairs of words over all rows."""
    words = {w for t in texts for w in clean_words(t)}
    # in an order that spreads the frequent words, so that tiles are alike
    vocabulary = {w: i for i, w in enumerate(sorted(words, key=lambda w: (zlib.crc32(w.encode("utf-8", "surrogatepass")), w)))}
    if not vocabulary:
        return {"vocabulary": {}}
    return {"vocabulary": vocabulary, **passage_rows(frequencies(docs, vocabulary), len(vocabulary))}


def fit(docs: DataFrame, items: list[tuple[int, str]], rank: int = 256, rounds: int = 2, seed: int = 5, known: dict | None = None) -> dict:
    """The latent space and the benchmark's vectors in it; ``known`` is what ``corpus`` gave for these items and others."""
    known = known or corpus(docs, [t for _, t in items])
    words = [clean_words(text) for _, text in items]
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for x in words for w in x))}
    size = len(vocabulary)
    if not size:
        return {"vocabulary": {}, "items": []}
    places = np.array([known["vocabulary"][w] for w in vocabulary], np.int64)
    own = np.full(len(known["vocabulary"]), -1, np.int64)
    own[places] = np.arange(size)
    df, total = known["df"][places], known["total"]
    idf = np.log((total + 2) / (df + 1)) + 0.1
    lists = [np.array([vocabulary[w] for w in x], np.int64) for x in words]
    cuts = [(k, a, b) for k, x in enumerate(lists) for a, b in item_passages(x)]
    entry = np.concatenate([r * size + lists[k][a:b] for r, (k, a, b) in enumerate(cuts)])
    entry, tf = np.unique(entry, return_counts=True)
    rows = Sparse(entry // size, entry % size, tf * idf[entry % size], (len(cuts), size))
    # randomised range finder; the benchmark's rows weigh more than the corpus, since they are what is searched for
    weight = SHARE * len(cuts)
    q = np.random.default_rng(seed).normal(size=(size, min(rank + 8, size)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(weight * gram_product(known, idf, q, own) + rows.back(rows.times(q)))
    small = q.T @ (weight * gram_product(known, idf, q, own) + rows.back(rows.times(q)))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    v = q @ vectors[:, np.argsort(-values)[:rank]]
    latent = rows.times(v)
    # a passage that the space holds poorly brings its own direction along, so that no copy falls under the threshold
    for _ in range(4):  # once is enough but for what rounding leaves
        weak = np.linalg.norm(latent, axis=1) < HELD
        if not weak.any():
            break
        v = np.linalg.qr(np.hstack([v, (rows.rows(weak) - latent[weak] @ v.T).T]))[0]
        latent = rows.times(v)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    answers = [sorted(set(x.tolist()), key=lambda i: (-idf[i], i))[:5] for x in lists]
    return {
        "vocabulary": vocabulary, "idf": idf, "other": float(idf.max()), "v": (v * idf[:, None]).astype(np.float32), "latent": latent.astype(np.float32),
        "owner": np.array([k for k, _, _ in cuts]), "words": [x.tolist() for x in lists], "answers": answers, "items": [i for i, _ in items],
    }


def common_subsequence(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for w in y:
        m = where.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(x) - row.bit_count()


def search(text: pa.Array, m: dict, ids: Ids, least: float, cover: float) -> list[list[tuple[int, float]]]:
    """(item index, covered share) of the items each text holds."""
    got, offsets = word_ids(text, ids)
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(offsets) - 1)]
    doc, start, end = windows(offsets)
    known = got >= 0
    w2 = np.where(known, m["idf"][got], m["other"]) ** 2
    total = np.concatenate([[0.0], np.cumsum(w2)])
    inner = np.concatenate([[0.0], np.cumsum(np.where(known, w2, 0.0))])
    # a word that comes k times counts k * k times its square, not k.  With r words that came before within a window's length no word
    # comes more than r + 1 times, so the true inner square is at most r + 1 times this sum; where even that is too little a share
    # of the length, the cosine cannot reach ``least``
    at = np.flatnonzero(known)
    at = at[np.argsort(got[at], kind="stable")]
    again = np.zeros(len(got), bool)
    again[at[1:]] = (got[at[1:]] == got[at[:-1]]) & (at[1:] - at[:-1] < WINDOW)
    count = np.concatenate([[0], np.cumsum(again)])
    inside = inner[end] - inner[start]
    most = (count[end] - count[start] + 1) * inside
    live = np.flatnonzero((most >= least**2 * (most + total[end] - total[start] - inside)) & (most > 0))
    wanted: dict[tuple[int, int], list[int]] = {}
    for at in range(0, len(live), 4096):
        some = live[at : at + 4096]
        size = end[some] - start[some]
        first = np.cumsum(size) - size
        pos = np.repeat(start[some] - first, size) + np.arange(int(size.sum()))
        row = np.repeat(np.arange(len(some)), size)
        w = got[pos]
        # true TF-IDF length, with repeated words counted together; unknown words count singly
        inside = w >= 0
        pair, tf = np.unique(row[inside] * len(m["idf"]) + w[inside], return_counts=True)
        norm = np.bincount(pair // len(m["idf"]), (tf * m["idf"][pair % len(m["idf"])]) ** 2, len(some))
        norm += np.bincount(row[~inside], minlength=len(some)) * m["other"] ** 2
        held = np.bincount(pair // len(m["idf"]), (tf * m["idf"][pair % len(m["idf"])]) ** 2, len(some))
        stay = np.flatnonzero(held >= least**2 * norm)
        if not len(stay):
            continue
        place = np.full(len(some), -1)
        place[stay] = np.arange(len(stay))
        use = inside & (place[row] >= 0)
        vec = np.zeros((len(stay), m["v"].shape[1]), np.float32)
        r = place[row[use]]
        lead = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
        if len(r):
            vec[r[lead]] = np.add.reduceat(m["v"][w[use]], lead, axis=0)
        cos = (vec @ m["latent"].T) / np.sqrt(norm[stay])[:, None]
        for i, j in zip(*np.nonzero(cos >= least), strict=True):
            wanted.setdefault((int(doc[some[stay[i]]]), int(m["owner"][j])), []).append(int(start[some[stay[i]]]))
    for (d, k), starts in sorted(wanted.items()):
        words = m["words"][k]
        need, best, distinct, answer = cover * len(words), 0, frozenset(words), frozenset(m["answers"][k])
        reach, done = len(words) + STRIDE, -1
        for s in sorted(starts):
            if s < done:
                continue
            a, b = max(int(offsets[d]), s - reach), min(int(offsets[d + 1]), s + WINDOW + reach)
            done = s + STRIDE
            region = got[a:b].tolist()
            # a common subsequence is no longer than the words both have, so most regions need not be aligned
            if len(distinct.intersection(region)) + len(words) - len(distinct) < need or 5 * len(answer.intersection(region)) < 3 * len(answer):
                continue
            n = common_subsequence(words, region)
            if n >= need:
                best = max(best, n)
        if best:
            out[d].append((k, best / len(words)))
    return out


def models(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcast lists of models: one for each block of the benchmark, ``TOGETHER`` in a list."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # as many blocks as keep the passages of each about the rank of its space
    count = F.greatest(F.lit(1), F.ceil(F.size(F.split(F.trim("text"), r"\s+")) / STRIDE) - 1)
    passages = items.agg(F.sum(count)).first()[0] or 0
    parts = max(1, -(-size // BLOCK), -(-passages // PASSAGES))
    place = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    known = corpus(docs, (r[0] for r in items.select("text").toLocalIterator()))  # the driver keeps the words
    out = []
    for a in range(0, parts, TOGETHER):
        blocks = [sorted({(r[0], r[1]) for r in items.where(place == p).collect()}) for p in range(a, min(a + TOGETHER, parts))]
        fitted = [m for block in blocks if (m := fit(docs, block, known=known))["items"]]
        if fitted:
            out.append(spark.sparkContext.broadcast(fitted))
        # what the fits held goes before the next ones: results of products on the JVM's side, matrices on Python's
        del blocks, fitted
        release(spark)
        trim()
    return out


def found_in(text: pa.Array, some: list[dict], ids: list[Ids], least: float, cover: float) -> list[list[tuple[int, float]]]:
    """(item, covered share) of what each text holds, over several models."""
    out: list[list[tuple[int, float]]] = [[] for _ in range(len(text))]
    for m, words in zip(some, ids, strict=True):
        for held, x in zip(out, search(text, m, words, least, cover), strict=True):
            held.extend((m["items"][k], share) for k, share in x)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.36, cover: float = 0.7) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark item."""
    for shared in models(docs, benchmark):

        def run(batches, shared=shared):
            some = shared.value
            ids = [Ids(m["vocabulary"]) for m in some]
            for big in batches:
                for b in slices(big, "text", PIECE):
                    yield b.filter(pa.array([not x for x in found_in(b.column("text"), some, ids, least, cover)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = 0.36, cover: float = 0.7, key: str = "doc_id") -> DataFrame:
    """(key, leaked, item_ids, cover) of every document."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, text string, item_ids array<long>, cover double"
    rows = docs.select(key, "text", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("cover"))
    for shared in models(docs, benchmark):

        def run(batches, shared=shared):
            some = shared.value
            ids = [Ids(m["vocabulary"]) for m in some]
            for big in batches:
                for b in slices(big, "text", PIECE):
                    found = found_in(b.column("text"), some, ids, least, cover)
                    lists = [sorted({*old, *(i for i, _ in x)}) for old, x in zip(b.column("item_ids").to_pylist(), found, strict=True)]
                    most = [max([old, *(c for _, c in x)]) for old, x in zip(b.column("cover").to_pylist(), found, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(key), b.column("text"), pa.array(lists, pa.list_(pa.int64())), pa.array(most, pa.float64())], [key, "text", "item_ids", "cover"])

        rows = rows.mapInArrow(run, schema)
    return rows.select(key, (F.size("item_ids") > 0).alias("leaked"), "item_ids", "cover")


def op5_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return decontaminate(docs, benchmark)
