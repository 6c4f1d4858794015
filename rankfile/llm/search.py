"""Operator 11, ranked lexical search with dual-sorted wavelet trees.

Documents are scanned once for a block of queries: each gives its length and the frequencies of the queries' terms, and each task
the documents that hold a term.  With the corpus counts known, every task cuts its documents into shards of bounded size.  A shard's
postings stand list after list, each list by falling impact, as the sequence of a wavelet tree over the shard's documents in the
order of their ids.  The tree's nodes are ranges of ids; a list's part in a node is an interval that still falls by impact, so its
first entry bounds what the term adds to any document below, and the intervals of all terms of a query are led down together.
Nodes are taken best bound first (some at a time), those that cannot reach the query's ``k`` best are never opened, and a leaf's
bound is its exact score: the top-k is exact, ties by id included.  The best of a task's earlier shards bound the later ones.  Tasks
hand on at most ``k`` rows a query, which a ranked window brings together.

Nothing is grouped by term or by source, so no term or copy group is a hot key.  Broadcast are the terms and weights of one block of
queries (``BLOCK`` bytes of query text at most); more queries take more blocks, and a scan each.

Defined results: null and empty texts hold no term and count nowhere; every row of the documents is a document, every row of the
queries a query, so rows that share an id have their own ranks; a document without an id comes last among equal scores; queries
without terms, or whose terms no document holds, give no row; very long texts are read whole; empty tables give an empty result;
other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, drop_folder, shared_folder, slices, split_words, trim
from .middle import buffers_of, string_array

BLOCK = 8 << 20  # bytes of query text that are searched together
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 400_000  # of one wavelet tree (some 60 MB)
OPEN = 256  # nodes opened together, at most
NO_ID = 2**63 - 1  # stands for a null id, which comes last
# The bytes of terms (digits, letters and all beyond ASCII), A-Z in lower case; others part terms.
TERM_BYTE = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    TERM_BYTE[_low : _high + 1] = np.arange(_low, _high + 1)
TERM_BYTE[0x41:0x5B] += 0x20

DOC, HELD, TOTAL = range(3)
POSTINGS = "kind int, doc_id long, n long, terms binary, counts binary"
NAMES = ["kind", "doc_id", "n", "terms", "counts"]


def terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each term, offsets of each text's terms, distinct terms)."""
    data, offsets = buffers_of(text)
    return split_words(string_array(TERM_BYTE[data], offsets))


def query_blocks(queries: DataFrame, item: str, text: str) -> Iterator[list]:
    """The rows (item, text) in blocks of bounded size; the driver holds one."""
    held, size = [], 0
    for r in queries.select(item, text).where(F.octet_length(text) > 0).toLocalIterator():
        if held and size + len(r[1]) > BLOCK:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def frequencies(docs: DataFrame, vocabulary, key: str, text: str) -> DataFrame:
    """DOC rows (id, length, terms, their counts) of documents with a term of the vocabulary, HELD rows (term as ``doc_id``, documents
    of the task that hold it as ``n``) and TOTAL rows (documents with a term, their lengths)."""

    def run(batches):
        known = vocabulary.value
        held = np.zeros(len(known), np.int64)
        documents = length = 0
        for big in batches:
            for b in slices(big, text):
                codes, offsets, words = terms_of(b.column(text))
                n = np.diff(offsets)
                documents += int((n > 0).sum())
                length += int(n.sum())
                term = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                pair = np.repeat(np.arange(len(n)), n)[term >= 0] * len(known) + term[term >= 0]
                pair, count = np.unique(pair, return_counts=True)
                doc, term = pair // len(known), pair % len(known)
                held += np.bincount(term, minlength=len(known))
                some, first = np.unique(doc, return_index=True)
                ends = np.append(first[1:], len(doc))
                term, count = term.astype(np.int32), count.astype(np.int32)
                blob = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), DOC, np.int32)), b.column(key).cast(pa.int64()).take(pa.array(some)), pa.array(n[some]), blob(term), blob(count)], names=NAMES)
        some = np.flatnonzero(held)
        kinds = np.append(np.full(len(some), HELD, np.int32), np.int32(TOTAL))
        none = pa.nulls(len(kinds), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.append(some, documents)), pa.array(np.append(held[some], length)), none, none], names=NAMES)
        trim()

    return docs.select(key, text).mapInArrow(run, POSTINGS)


class Tree:
    """A wavelet tree (its levels as whole rows, zeros before ones) over postings that stand list after list by falling impact."""

    def __init__(self, doc: np.ndarray, impact: np.ndarray, documents: int):
        self.levels = max(1, (documents - 1).bit_length())
        n = len(doc)
        self.zeros = np.zeros((self.levels, n + 1), np.int32)  # zeros before each place
        self.impact = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impact[0, :n] = impact
        for level in range(self.levels):
            one = (doc >> (self.levels - 1 - level)) & 1
            np.cumsum(1 - one, out=self.zeros[level, 1:])
            order = np.argsort(one, kind="stable")
            doc, impact = doc[order], impact[order]
            self.impact[level + 1, :n] = impact
        self.ones_at = self.zeros[:, n].astype(np.int64)  # where ones begin


def best_of(tree: Tree, ids: np.ndarray, weight: np.ndarray, begin: np.ndarray, end: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ``k`` first (-score, id) of ``best`` and the shard's documents, for the lists ``begin`` to ``end`` with their weights."""
    some = np.flatnonzero((end > begin) & (weight > 0))
    if not len(some):
        return best
    best = list(best)
    worst = best[-1] if len(best) == k else (0, -1)
    # a node: (-bound, least id below, level, number among its level, its columns (list, begin, end) in ``lists``)
    lists = np.stack([some, begin[some], end[some]])
    heap = [(-int((weight[some] * tree.impact[0, begin[some]]).sum()), int(ids[0]), 0, 0, lists)]
    width = 16
    while heap and heap[0][:2] < worst:
        nodes = []
        while heap and len(nodes) < width and heap[0][:2] < worst:
            nodes.append(heapq.heappop(heap))
        width = min(2 * width, OPEN)
        sizes = np.fromiter((x[4].shape[1] for x in nodes), np.int64, len(nodes))
        which, (term, low, high) = np.repeat(np.arange(len(nodes)), sizes), np.concatenate([x[4] for x in nodes], axis=1)
        level = np.fromiter((x[2] for x in nodes), np.int64, len(nodes))
        number = np.fromiter((x[3] for x in nodes), np.int64, len(nodes))
        at = level[which]
        low0, high0 = tree.zeros[at, low].astype(np.int64), tree.zeros[at, high].astype(np.int64)
        shift = tree.ones_at[at]
        child = np.concatenate([2 * which, 2 * which + 1])
        low, high = np.concatenate([low0, shift + low - low0]), np.concatenate([high0, shift + high - high0])
        full = np.flatnonzero(high > low)
        full = full[np.argsort(child[full], kind="stable")]
        child, low, high, term = child[full], low[full], high[full], np.concatenate([term, term])[full]
        first = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
        bound = np.add.reduceat(weight[term] * tree.impact[level[child // 2] + 1, low], first)
        parent = child[first] // 2
        deep, number = level[parent] + 1, 2 * number[parent] + child[first] % 2
        lowest = ids[number << (tree.levels - deep)]
        leaf = deep == tree.levels
        if leaf.any():
            best = heapq.nsmallest(k, best + list(zip((-bound[leaf]).tolist(), lowest[leaf].tolist(), strict=True)))
            worst = best[-1] if len(best) == k else (0, -1)
        lists = np.stack([term, low, high])
        last = np.append(first[1:], len(child))
        for j in np.flatnonzero(~leaf & (bound >= -worst[0])).tolist():
            heapq.heappush(heap, (-int(bound[j]), int(lowest[j]), int(deep[j]), int(number[j]), lists[:, first[j] : last[j]]))
    return best


def searched(shared, k: int):
    """The best ``k`` of a task's documents for every query: (query, score, id)."""

    def run(batches):
        queries, weights, documents, length = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in queries]
        held, size = [], 0

        def close():
            ids = np.concatenate([h[0] for h in held])
            n, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            doc, term, tf = np.repeat(place, sizes), np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held]).astype(np.int64)
            m = 100 - 75 + (75 * n * documents) // length
            impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, sizes))
            by = np.lexsort((doc, -impact, term))
            starts = np.searchsorted(term[by], np.arange(len(weights) + 1))
            tree = Tree(doc[by], impact[by].astype(np.int32), len(ids))
            ids = ids[order]
            for q, (terms, times) in enumerate(queries):
                best[q] = best_of(tree, ids, weights[terms] * times, starts[terms], starts[terms + 1], k, best[q])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            ids = pc.fill_null(b.column("doc_id"), NO_ID).to_numpy(zero_copy_only=False)
            n = b.column("n").to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(b.column("terms")).to_numpy(zero_copy_only=False).astype(np.int64) // 4
            ints = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32)  # noqa: E731, B023
            term, tf = ints("terms"), ints("counts")
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):  # a part of the batch that the shard has room for, one document at least
                used = ends[at - 1] if at else 0
                stop = min(int(np.searchsorted(ends, used + SHARD_POSTINGS - size, side="right")), at + SHARD_DOCS - sum(len(h[0]) for h in held))
                if stop <= at and held:
                    close()
                    size = 0
                    continue
                stop = max(stop, at + 1)
                part = slice(used, ends[stop - 1])
                held.append((ids[at:stop], n[at:stop], sizes[at:stop], term[part].astype(np.int64), tf[part]))
                size += int(ends[stop - 1] - used)
                at = stop
        if held:
            close()
        rows = [(q, -s, i) for q, found in enumerate(best) for s, i in found]
        for a in range(0, len(rows), 50_000):
            q, s, i = zip(*rows[a : a + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array([None if x == NO_ID else x for x in i], pa.int64())], ["q", "score", "doc_id"])
        trim()

    return run


def search(docs: DataFrame, queries: DataFrame, *, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the ``k`` highest-scoring documents of each query with a score above 0."""
    spark, out = docs.sparkSession, None
    schema = f"item_id {queries.schema[item].dataType.simpleString()}, rank int, doc_id long, score long"
    for block in query_blocks(queries, item, text):
        codes, offsets, words = terms_of(pa.array([t for _, t in block]))
        if not len(words):
            continue
        vocabulary = spark.sparkContext.broadcast(words)
        folder = shared_folder(spark, "postings")
        frequencies(docs, vocabulary, key, text).write.partitionBy("kind").parquet(folder)
        rows = spark.read.schema(POSTINGS).parquet(folder)
        documents, length = rows.where(F.col("kind") == TOTAL).agg(F.sum("doc_id"), F.sum("n")).first() or (0, 0)
        held = {r[0]: r[1] for r in rows.where(F.col("kind") == HELD).groupBy("doc_id").agg(F.sum("n")).collect()}  # a row a term of the block
        weights = np.array([math.floor(1000 * math.log((2 * (documents or 0) + 2) / (2 * held.get(i, 0) + 1))) if i in held else 0 for i in range(len(words))], np.int64)
        counted = [Counter(codes[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        terms = [(np.array(sorted(c), np.int64), np.array([c[t] for t in sorted(c)], np.int64)) for c in counted]
        shared = spark.sparkContext.broadcast((terms, weights, documents, length))
        found = rows.where(F.col("kind") == DOC).select("doc_id", "n", "terms", "counts").mapInArrow(searched(shared, k), "q int, score long, doc_id long")
        place = F.row_number().over(W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"q int, item_id {queries.schema[item].dataType.simpleString()}")
        ranked = found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "q")
        ranked = checkpoint(ranked.select("item_id", "rank", "doc_id", "score"))
        drop_folder(spark, folder)
        vocabulary.destroy()
        shared.destroy()
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], schema) if out is None else out


def op11_search(docs: DataFrame, queries: DataFrame) -> DataFrame:
    return search(docs, queries)
