"""Operator 6, quality by nearest-neighbour voting in a latent-semantic space.

Terms are shapes of tokens (case, digits, marks), short words, repeats of the previous token and buckets of length and of
distinct-token share.  Document frequencies come from all rows; the TF-IDF rows of a bounded labelled sample give a truncated
SVD.  The labelled latent vectors are broadcast (``n`` x ``rank`` doubles), every document's cosines with all of them are
computed in blocks, and the nearest labels vote by similarity, weighted back to the label shares of all labelled rows.

Words of more than four letters count by their length only, so the space is one of token shapes and short words more than of
topics: that is what tells junk from prose in any language.

Defined results: null and empty texts hold the empty-length terms and are scored like other rows; very long texts are scored
whole; repeated rows are scored alike; ties between neighbours go to the lower row of the sample, whose rows are in order of id
and text; an id with both labels counts with label 0; with no usable labels every score is 0; an empty table gives an empty
result; columns beside id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, code_points, held_out, labelled_sample, mix, slices, split_words, trim, word_hashes

SIZE = 4096
BLOCK = 256  # texts whose dense term counts are held at once
MARKS = ".,;:!?"
PRIOR = 0.02  # weight of the share of label 1 among the votes; a neighbour that is alike has 1
LONG, SHOWN = 60, 8  # tokens of more characters have one shape; runs of a token that its shape shows
LOWER, UPPER, OTHER, DIGIT = 1, 2, 3, 4


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % SIZE


REPEAT = bucket("repeat")
LENGTHS = np.array([bucket(f"length:{i}") for i in range(11)])
LONG_TERMS = np.array([bucket("shape:long"), bucket("word:long")])


def kinds() -> np.ndarray:
    """For each code point of the basic plane its kind, 0 for marks; what lies beyond counts as its last entry."""
    global _kinds
    if _kinds is None:
        chars = [chr(c) for c in range(0x10000)]
        _kinds = np.array([DIGIT if c.isdecimal() else (LOWER if c.islower() else UPPER if c.isupper() else OTHER) if c.isalpha() else 0 for c in chars] + [OTHER], np.int64)
    return _kinds


_kinds = None


def shapes(words: list[str]) -> np.ndarray:
    """A hash of each token's shape: runs of letters as all upper, capitalised, lower or mixed, runs of digits, runs of a mark."""
    cps, at = code_points(words)
    if not len(cps):
        return np.zeros(len(words), U)
    kind = kinds()[np.minimum(cps, 0x10000)]
    letter = (kind > 0) & (kind < DIGIT)
    run_of = np.where(letter, 1, np.where(kind == DIGIT, 2, 10 + cps.astype(np.int64)))
    own = np.repeat(np.arange(len(words)), np.diff(at))
    first = np.flatnonzero(np.concatenate([[True], (run_of[1:] != run_of[:-1]) | (own[1:] != own[:-1])]))
    size = np.diff(np.append(first, len(cps)))
    upper, lower = np.add.reduceat(kind == UPPER, first), np.add.reduceat(kind == LOWER, first)
    case = np.where((upper == size) & (size > 1), 3, np.where(kind[first] == UPPER, 4, np.where(lower == size, 5, 6)))
    symbol = np.where(run_of[first] == 1, case, run_of[first])
    token = own[first]
    place = np.arange(len(first)) - np.searchsorted(token, token)
    shown = place < SHOWN
    part = mix(symbol[shown].astype(U) * U(0x9E3779B97F4A7C15) + place[shown].astype(U))
    out = np.zeros(len(words), U)
    tokens, lead = np.unique(token[shown], return_index=True)
    out[tokens] = np.add.reduceat(part, lead)
    return mix(out)


def terms(tokens: pa.Array) -> np.ndarray:
    """(token, 2): the bucket of each token's shape, and that of the word itself if it is short (else of its length)."""
    out = np.empty((len(tokens), 2), np.int64)
    out[:, 0] = (shapes(tokens.to_pylist()) % U(SIZE)).astype(np.int64)
    words = pc.utf8_trim(pc.utf8_lower(tokens), characters=MARKS)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    out[:, 1] = np.where(size <= 4, (word_hashes(words) % U(SIZE)).astype(np.int64), LENGTHS[np.minimum(size // 3, 10)])
    out[pc.utf8_length(tokens).to_numpy(zero_copy_only=False) > LONG] = LONG_TERMS
    return out


def counts(text: pa.Array) -> np.ndarray:
    """Term counts (text, SIZE)."""
    codes, offsets, words = split_words(text)
    n = len(offsets) - 1
    ids = terms(words)[codes] if len(words) else np.zeros((0, 2), np.int64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    out = np.bincount(np.concatenate([doc * SIZE + ids[:, 0], doc * SIZE + ids[:, 1]]), minlength=n * SIZE).astype(np.float32).reshape(n, SIZE)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    out[:, REPEAT] += np.bincount(doc[same], minlength=n)
    sizes = np.diff(offsets)
    distinct = np.bincount(np.unique(doc * (len(words) + 1) + codes) // (len(words) + 1), minlength=n) if len(codes) else np.zeros(n)
    size_terms = np.array([bucket(f"size:{i}") for i in range(40)])
    share_terms = np.array([bucket(f"share:{i}") for i in range(12)])
    rows = np.arange(n)
    out[rows, size_terms[np.minimum(np.ceil(2 * np.log2(sizes + 1)).astype(int), 39)]] += np.maximum(1, sizes // 4)
    out[rows, share_terms[(10 * distinct / np.maximum(sizes, 1)).astype(int)]] += np.maximum(1, sizes // 4)
    return out


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each term occurs, over all rows, and the number of rows."""

    def run(batches):
        df, n = np.zeros(SIZE, np.int64), 0
        for big in batches:
            for b in slices(big, "text", rows=BLOCK):
                c = counts(b.column("text"))
                df += (c > 0).sum(axis=0)
                n += len(c)
        df = np.append(df, n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out[:SIZE], int(out[SIZE])


def randomised_svd(x: np.ndarray, rank: int, rounds: int = 3, seed: int = 11) -> np.ndarray:
    """Right singular vectors (columns) of x by a randomised range finder."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(seed).normal(size=(x.shape[1], min(rank + 10, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T)[:, :rank]


def fit(docs: DataFrame, labels: DataFrame, n: int = 3000, max_bytes: int = 40_000, rank: int = 48, neighbours: int = 15, label: str = "quality") -> dict:
    """Learns from at most ``n`` labelled rows (half of each label, as far as there are rows) of at most ``max_bytes`` each."""
    share = labels.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    rows = labelled_sample(docs, labels, label, n, max_bytes)
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 0.2
    y = np.array([float(r[2]) for r in rows])
    if not rows:
        return {"idf": idf, "v": np.zeros((SIZE, 1), np.float32), "z": np.zeros((0, 1), np.float32), "y": y, "weight": y, "k": neighbours, "share": float(share)}
    x = np.empty((len(rows), SIZE), np.float32)  # 49 MB of the driver, filled in place
    for k in range(0, len(rows), BLOCK):
        x[k : k + BLOCK] = weighted(counts(pa.array([r[1] for r in rows[k : k + BLOCK]], pa.string())), idf)
    del rows
    v = randomised_svd(x, rank)
    z = x @ v
    del x
    trim()
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    p = y.mean()
    weight = np.where(y > 0, share / max(p, 1e-9), (1 - share) / max(1 - p, 1e-9))
    return {"idf": idf, "v": v.astype(np.float32), "z": z.astype(np.float32), "y": y, "weight": weight, "k": neighbours, "share": float(share)}


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` columns of highest cosine in each row, the lower column first among equal ones."""
    bits = cos.astype(np.float32).view(np.int32)
    bits = bits ^ ((bits >> 31) & 0x7FFFFFFF)  # rises with the value
    rank = (bits.astype(np.int64) << 32) - np.arange(cos.shape[1])
    return np.argpartition(rank, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k :]


def votes(texts: pa.Array, m: dict) -> np.ndarray:
    if not len(m["z"]):
        return np.zeros(len(texts))
    out = []
    c = counts(texts)
    for at in range(0, len(c), BLOCK):
        z = weighted(c[at : at + BLOCK], m["idf"]) @ m["v"]
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        cos = z @ m["z"].T
        k = min(m["k"], cos.shape[1])
        near = nearest(cos, k)
        w = np.exp(12 * (np.take_along_axis(cos, near, 1).astype(np.float64) - 1)) * m["weight"][near]
        # far neighbours say little: the share of label 1 has a vote of its own
        out.append(((w * m["y"][near]).sum(axis=1) + PRIOR * m["share"]) / (w.sum(axis=1) + PRIOR))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in batches:
            for b in slices(big, "text", rows=BLOCK):
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(votes(b.column("text"), m).clip(0, 1), pa.float64())], [key, "score"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: dict, least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for big in batches:
            for b in slices(big, "text", rows=BLOCK):
                yield b.filter(pa.array(votes(b.column("text"), m) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract query: learns labels outside the held-out fold, scores every row from its text alone."""
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
