"""Operator 4, toxicity with a counterfactual-regularised classifier.

A logistic model over the presence of words.  For labelled sentences, counterfactuals swap each identity term for another of
its group (and, where a sentence names none, add a neutral mention); the squared change of the logit between a sentence and
its counterfactual is penalised, so group mentions alone do not raise a score.

All sentences of the labelled rows count.  Near copies among the labelled rows (same label, word sets alike by 0.8) count once.

Defined results: null and empty texts get the score of a text without known words; very long texts are scored whole; repeated
rows are scored alike; an id with both labels counts with label 0; with no usable labels every score is 0; an empty table gives
an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, slices, split_words

# Identity terms by group, swapped within a group.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer"),
    ("disabled", "blind", "deaf", "autistic"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros"),
)
WORD = re.compile(r"[^\W\d_]+")


def plain(token: str) -> list[str]:
    return WORD.findall(token.lower())


class Terms:
    """Vocabulary ids of raw tokens, remembered; emptied when it holds ``most`` tokens."""

    def __init__(self, vocabulary: dict[str, int], most: int = 400_000):
        self.vocabulary, self.most, self.known = vocabulary, most, {}

    def __call__(self, token: str) -> tuple[int, ...]:
        got = self.known.get(token)
        if got is None:
            if len(self.known) > self.most:
                self.known.clear()
            v = self.vocabulary
            got = self.known[token] = tuple(i for w in plain(token) if (i := v.get(w)) is not None)
        return got


def presence(text: pa.Array, terms: Terms, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, vocabulary id) pairs, each once."""
    codes, offsets, words = split_words(text)
    ids = [terms(w) for w in words.to_pylist()]
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.fromiter((i for x in ids for i in x), np.int64, int(counts.sum()))
    start = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    hit = counts[codes] > 0
    codes, doc = codes[hit], doc[hit]
    n = counts[codes]
    at = np.repeat(start[:-1][codes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    pairs = np.unique(np.repeat(doc, n) * size + flat[at])
    return pairs // size, pairs % size


def counterfactuals(sentences: list[list[str]], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse differences (pair, term, +1 or -1) between sentences and their counterfactuals."""
    group = {w: g for g in IDENTITY for w in g}
    pair, term, sign, n = [], [], [], 0
    for k, words in enumerate(sentences):
        present = set(words)
        named = [w for w in words if w in group]
        swaps = [(w, group[w][(group[w].index(w) + 1 + (k + j) % (len(group[w]) - 1)) % len(group[w])]) for j, w in enumerate(dict.fromkeys(named))]
        if not swaps:
            g = IDENTITY[k % len(IDENTITY)]
            swaps = [(None, g[(k // len(IDENTITY)) % len(g)])]
        for old, new in swaps:
            if new in present:
                continue
            for w, s in ((old, -1.0), (new, 1.0)):
                if w is not None:
                    pair.append(n)
                    term.append(vocabulary[w])
                    sign.append(s)
            n += 1
    return np.array(pair, np.int64), np.array(term, np.int64), np.array(sign)


def distinct_rows(rows: list[tuple], alike: float = 0.8) -> list[tuple]:
    """One row of each group of near copies of the same label: copies would pass for evidence.  Rows with the same three smallest
    word hashes are compared, and one goes if its set of words is ``alike`` (Jaccard) or more to that of a row kept before it."""
    kept: dict[tuple, list[set]] = {}
    out = []
    for r in rows:
        words = set(plain(r[1]))
        smallest = tuple(sorted({zlib.crc32(w.encode()) for w in words})[:3])
        others = kept.setdefault((r[2], smallest), [])
        if all(len(words & x) < alike * len(words | x) for x in others):
            others.append(words)
            out.append(r)
    return out


def train(rows: list[tuple], rate: float, size: int = 5_000, least: int = 8, apart: float = 4.0, penalty: float = 5.0, l2: float = 1e-4, rounds: int = 250) -> dict:
    """Fits on (id, text, label) rows; ``rate`` is the share of label 1 among all labelled rows and sets the intercept, since the
    sample is balanced."""
    rows = distinct_rows(rows)
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for _, text, label in rows:
        counts[int(label > 0)].update(set(plain(text)))
    ones = sum(r[2] > 0 for r in rows) / max(len(rows), 1)
    # words whose count among label 1 departs from chance by more than ``apart`` deviations
    apart_by = {}
    for w in counts[0].keys() | counts[1].keys():
        both = counts[0][w] + counts[1][w]
        if both >= least:
            apart_by[w] = abs(counts[1][w] - both * ones) / max(np.sqrt(both * ones * (1 - ones)), 1e-9)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for g in IDENTITY for w in g))}
    for w in sorted((w for w, z in apart_by.items() if z >= apart), key=lambda w: (-apart_by[w], w))[:size]:
        vocabulary.setdefault(w, len(vocabulary))
    y = np.array([float(r[2]) for r in rows])
    n, v = len(rows), len(vocabulary)
    w, b = np.zeros(v), 0.0
    if n and 0 < y.sum() < n:
        doc, term = presence(pa.array([r[1] for r in rows], pa.string()), Terms(vocabulary), v)
        sentences = [plain(s) for r in rows for s in re.split(r"[.!?\n]+", r[1]) if s.strip()]
        pair, pterm, sign = counterfactuals(sentences, vocabulary)
        pairs = int(pair.max(initial=-1)) + 1
        m1, m2, mb, vb = np.zeros(v), np.zeros(v), 0.0, 0.0
        for step in range(1, rounds + 1):
            logit = np.bincount(doc, w[term], n) + b
            error = (1 / (1 + np.exp(-logit.clip(-40, 40))) - y) / n
            grad = np.bincount(term, error[doc], v) + l2 * w
            if pairs:
                change = np.bincount(pair, w[pterm] * sign, pairs)
                grad += penalty * 2 / pairs * np.bincount(pterm, change[pair] * sign, v)
            gb = error.sum()
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            w = w - 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            b -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
        share = y.mean()
        rate = min(max(rate, 1e-4), 1 - 1e-4)
        b += np.log(rate / (1 - rate)) - np.log(share / (1 - share))
    else:
        b = 40.0 if n and y.sum() == n else -40.0
    return {"vocabulary": vocabulary, "w": w, "b": float(b)}


def fit(docs: DataFrame, labels: DataFrame, n: int = 4000, max_bytes: int = 20_000, label: str = "toxic") -> dict:
    """Learns from at most ``n`` labelled rows (half of each label, as far as there are rows) of at most ``max_bytes`` each."""
    rate = labels.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    return train(labelled_sample(docs, labels, label, n, max_bytes), rate)


def score(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, score, n_terms) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        terms, v = Terms(m["vocabulary"]), len(m["vocabulary"])
        for big in batches:
            for b in slices(big, "text"):
                doc, term = presence(b.column("text"), terms, v)
                logit = np.bincount(doc, m["w"][term], b.num_rows) + m["b"]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(1 / (1 + np.exp(-logit.clip(-40, 40)))), pa.array(np.bincount(doc, minlength=b.num_rows).astype(np.int64))], [key, "score", "n_terms"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, score double, n_terms long")


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract query: learns outside the held-out fold, scores every row from its text alone."""
    model = fit(docs, labels.where(~held_out("doc_id", 5, 0)))
    out = score(docs, model)
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")
