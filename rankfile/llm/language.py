"""Operator 1, language identification of code-switched text with a linear-chain conditional random field.

Each word is an observation.  Its features are the character n-grams (1 to 4) of ``^word$`` -- those that touch a boundary
are its affixes -- and the word itself (lexicon); they are hashed to ``BUCKETS`` rows of learned weights.  Transitions between
labels are learned too.  Forward-backward gives each word's label marginals; a document gets the label with the largest sum.

The chain of a long document is cut in blocks whose transfer matrices are multiplied, so the messages are exact while
numpy works on all blocks of a slice at once.

Defined results: null text or text without a letter gives ``und`` with score 0; ties go to the alphabetically first label;
words without a letter are no part of the chain; repeated rows are scored alike; an id with several labels counts with the
alphabetically first; all label values are learned (up to 1,000, more are refused); an empty table gives an empty result; with
no labelled row at all every document is ``und``; columns beside id, text and label are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, code_points, held_out, labelled_sample, letters, mix, slices, split_words

BUCKETS = 1 << 17
BLOCK = 48


def word_features(words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Rows of feature indices with the word of each, by n-gram order, and the lexicon feature of each word."""
    cps, offsets = code_points([f"^{w.lower()}$" for w in words])
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    h = mix(cps.astype(U) + U(0x51ED27))
    rows, owners = [], []
    gram = h.copy()
    for n in range(1, 5):
        if n > 1:
            m = len(h) - n + 1
            if m <= 0:
                break
            gram = gram[:m] * U(0x9E3779B97F4A7C15) + h[n - 1 :]
            inside = owner[:m] == owner[n - 1 :]
        else:
            inside = (cps != 94) & (cps != 36)
        rows.append((mix(gram[inside] + U(n)) % U(BUCKETS)).astype(np.int64))
        owners.append(owner[: len(inside)][inside])
    at = np.arange(len(cps)) - offsets[owner]
    powers = np.full(int(at.max(initial=0)) + 1, U(0xD1342543DE82EF95))
    powers[0] = U(1)
    np.multiply.accumulate(powers, out=powers)
    whole = np.zeros(len(words), U)
    if len(words):
        whole = np.add.reduceat(h * powers[at], offsets[:-1])
    return rows, owners, (mix(whole) % U(BUCKETS)).astype(np.int64)


def emissions(words: list[str], weights: np.ndarray, features=None) -> np.ndarray:
    """Log potentials (word, label); a word's n-gram weights are averaged by order, so that long words do not dominate."""
    rows, owners, lexicon = features or word_features(words)
    out = weights[lexicon].astype(np.float64)
    for row, own in zip(rows, owners, strict=True):
        if len(row):
            at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums = np.add.reduceat(weights[row], at, axis=0)
            out[own[at]] += sums / np.diff(np.append(at, len(own)))[:, None]
    return out


class Emissions:
    """Potentials of words seen before; emptied when it holds ``most`` words, so that memory stays bounded."""

    def __init__(self, weights: np.ndarray, most: int = 250_000):
        self.weights, self.most = weights, most
        self.rows: dict[str, int] = {}
        self.values = np.zeros((0, weights.shape[1]))

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > self.most:
            self.rows, self.values = {}, self.values[:0]
        new = [w for w in words if w not in self.rows]
        if new:
            at = len(self.rows)
            self.rows.update(zip(new, range(at, at + len(new)), strict=True))
            self.values = np.concatenate([self.values, emissions(new, self.weights)])
        return self.values[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))]


def chain_marginals(e: np.ndarray, offsets: np.ndarray, trans: np.ndarray, want_pairs: bool = False):
    """Label marginals of every word of chains laid one after the other.  ``e`` holds log potentials, ``trans`` log transitions.

    Blocks are ordered by size, so that at each step the blocks that still have a word are a prefix."""
    n, k = e.shape
    lengths = np.diff(offsets)
    blocks = -(-lengths // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    if not nb:
        return (np.zeros((0, k)), np.zeros((k, k))) if want_pairs else np.zeros((0, k))
    doc = np.repeat(np.arange(len(lengths)), blocks)
    start = offsets[:-1][doc] + (np.arange(nb) - first[doc]) * BLOCK
    size = np.minimum(BLOCK, offsets[1:][doc] - start)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(nb, np.int64)
    rank[order] = np.arange(nb)
    start, size = start[order], size[order]
    live = [int(np.searchsorted(-size, -j)) for j in range(BLOCK)]  # blocks with more than j words
    p = np.exp(e - e.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    grid = [p[start[:m] + j] for j, m in enumerate(live)]
    prod = np.broadcast_to(np.eye(k), (nb, k, k)).copy()
    for j, m in enumerate(live):
        if not m:
            break
        step = (prod[:m].reshape(-1, k) @ t).reshape(m, k, k)
        step *= grid[j][:, None, :]
        if j % 6 == 5:
            step /= step.sum(axis=(1, 2), keepdims=True)
        prod[:m] = step
    prod /= prod.sum(axis=(1, 2), keepdims=True)
    head, tail = np.ones((nb, k)), np.ones((nb, k))
    for s in range(1, int(blocks.max())):
        d = np.flatnonzero(blocks > s)
        b, c = rank[first[d] + s], rank[first[d] + s - 1]
        m = np.einsum("bi,bij->bj", head[c], prod[c])
        head[b] = m / m.sum(axis=1, keepdims=True)
        b, c = rank[first[d + 1] - 1 - s], rank[first[d + 1] - s]
        m = np.einsum("bij,bj->bi", prod[c], tail[c])
        tail[b] = m / m.sum(axis=1, keepdims=True)
    alpha, a = [], head
    for j, m in enumerate(live):
        a = (a[:m] @ t) * grid[j]
        a /= a.sum(axis=1, keepdims=True)
        alpha.append(a)
    pairs = np.zeros((k, k))
    out = np.empty((n, k))
    beta = tail
    opens = np.isin(start, offsets[:-1])
    for j in range(BLOCK - 1, -1, -1):
        m = live[j]
        if not m:
            continue
        gamma = alpha[j] * beta[:m]
        out[start[:m] + j] = gamma / gamma.sum(axis=1, keepdims=True)
        seen = grid[j] * beta[:m]
        if want_pairs:
            x = (alpha[j - 1][:m] if j else head[:m])[:, :, None] * t[None] * seen[:, None, :]
            x /= x.sum(axis=(1, 2), keepdims=True)
            pairs += x.sum(axis=0) if j else x[~opens[:m]].sum(axis=0)
        back = seen @ t.T
        beta[:m] = back / back.sum(axis=1, keepdims=True)
    return (out, pairs) if want_pairs else out


def letter_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Like split_words, with the words that hold a letter only."""
    codes, offsets, words = split_words(text)
    words = words.to_pylist()
    if not words:
        return codes, offsets, words
    cps, at = code_points(words)
    has = np.logical_or.reduceat(letters()[cps], at[:-1])
    keep = has[codes]
    place = np.concatenate([[0], np.cumsum(keep)])
    new = np.cumsum(has) - 1
    return new[codes[keep]], place[offsets], [w for w, h in zip(words, has.tolist(), strict=True) if h]


def train(rows: list[tuple], piece: int = 24, pieces: int = 12, rounds: int = 24, rate: float = 0.5, l2: float = 1e-6, seed: int = 7) -> dict:
    """Fits the field on (id, text, lang) rows.  The texts are cut in pieces and the pieces of all languages dealt into mixed
    sequences, so that transitions are learned on code-switched chains; the gradient is that of the exact likelihood."""
    langs = sorted({r[2] for r in rows})
    if not langs:
        return {"langs": [], "w": np.zeros((BUCKETS, 0), np.float32), "t": np.zeros((0, 0))}
    codes, offsets, words = letter_words(pa.array([r[1] for r in rows], pa.string()))
    y = np.array([langs.index(r[2]) for r in rows])
    cuts = [(s, min(s + piece, b), y[d]) for d, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) for s in range(a, b, piece)]
    order = np.random.default_rng(seed).permutation(len(cuts))
    seq, lab, ends, count = [], [], [0], 0
    for i, c in enumerate(order):
        a, b, label = cuts[c]
        seq.append(codes[a:b])
        lab.append(np.full(b - a, label))
        count += b - a
        if (i + 1) % pieces == 0:
            ends.append(count)
    if ends[-1] != count:
        ends.append(count)
    k = len(langs)
    if not count:
        return {"langs": langs, "w": np.zeros((BUCKETS, k), np.float32), "t": np.zeros((k, k))}
    seq, lab, ends = np.concatenate(seq), np.concatenate(lab), np.array(ends)
    features = word_features(words)
    truth = np.zeros((len(words), k))
    np.add.at(truth, (seq, lab), 1.0)
    w, t = np.zeros((BUCKETS, k)), np.zeros((k, k))
    first = np.zeros(count, bool)
    first[ends[:-1]] = True
    seen = np.zeros((k, k))
    np.add.at(seen, (lab[:-1][~first[1:]], lab[1:][~first[1:]]), 1.0)
    gw, gt = np.full_like(w, 1e-8), np.full_like(t, 1e-8)
    for _ in range(rounds):
        e = emissions(words, w, features)
        marginals, pairs = chain_marginals(e[seq], ends, t, want_pairs=True)
        grad_e = truth.copy()
        for j in range(k):
            grad_e[:, j] -= np.bincount(seq, marginals[:, j], len(words))
        grad = np.zeros_like(w)
        rows_, owners, lexicon = features
        for j in range(k):
            grad[:, j] += np.bincount(lexicon, grad_e[:, j], BUCKETS)
            for row, own in zip(rows_, owners, strict=True):
                if len(row):
                    counts = np.bincount(own, minlength=len(words)).clip(1)
                    grad[:, j] += np.bincount(row, (grad_e[:, j] / counts)[own], BUCKETS)
        grad = grad / count - l2 * w
        gw += grad**2
        w += rate * grad / np.sqrt(gw)
        step = (seen - pairs) / count
        gt += step**2
        t += rate * step / np.sqrt(gt)
    return {"langs": langs, "w": w.astype(np.float32), "t": t}


def label_words(text: pa.Array, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Marginals of the letter words of each text: (marginals, offsets, codes, words)."""
    codes, offsets, words = letter_words(text)
    known = model.get("known") or Emissions(model["w"])
    e = known(words) if words else np.zeros((0, model["w"].shape[1]))
    return chain_marginals(e[codes], offsets, model["t"]), offsets, codes, words


def fit(docs: DataFrame, labels: DataFrame, n: int = 600, max_bytes: int = 20_000) -> dict:
    """Learns from at most ``n`` rows of at most ``max_bytes`` each, dealt evenly over the label values (``lang`` in labels)."""
    return train(labelled_sample(docs, labels, "lang", n, max_bytes))


def identify(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, n_words, n_switches): score is the mean marginal of the winning label, n_switches the changes of
    the most probable label along the words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = {**shared.value, "known": Emissions(shared.value["w"])}
        langs = np.array([*m["langs"], "und"], dtype=object)
        k = len(m["langs"])
        for big in batches:
            for b in slices(big, "text"):
                n = b.num_rows
                best, score = np.full(n, k), np.zeros(n)
                size, switches = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if k:
                    marginals, offsets, _, _ = label_words(b.column("text"), m)
                    size = np.diff(offsets)
                    cum = np.concatenate([np.zeros((1, k)), np.cumsum(marginals, axis=0)])
                    total = cum[offsets[1:]] - cum[offsets[:-1]]
                    best = np.where(size > 0, np.round(total, 9).argmax(axis=1), k)
                    score = np.where(size > 0, total.max(axis=1) / size.clip(1), 0.0).clip(0, 1)
                    top = marginals.argmax(axis=1)
                    change = np.concatenate([[0, 0], np.cumsum(top[1:] != top[:-1])])[: len(top) + 1] if len(top) else np.zeros(1, np.int64)
                    switches = np.where(size > 0, change[offsets[1:]] - change[np.minimum(offsets[:-1] + 1, len(top))], 0)
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(langs[best], pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int64()), pa.array(switches.astype(np.int64))], [key, "lang_pred", "score", "n_words", "n_switches"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, lang_pred string, score double, n_words long, n_switches long")


def op1_language(docs: DataFrame) -> DataFrame:
    """Contract query: learns from rows outside the held-out fold, predicts every row from its text alone."""
    train_rows = docs.where(~held_out("doc_id", 4, 2)).where(F.col("lang").isNotNull()).select("doc_id", "lang")
    model = fit(docs, train_rows)
    out = identify(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")
