"""Shared parts: Arrow tokenising in bounded slices, labelled samples, checkpoints, connected components.

Every Arrow stage cuts its batches into slices of at most ``SLICE`` bytes of text and ``ROWS`` rows (one row at least), so a
Python worker holds a few tens of MB however large the Arrow batch is, and gives freed memory back after each batch.  A single
document is always processed whole.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE, ROWS = 3 << 20, 4096
MOST_LABELS = 1000
U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a local session (tests) gets a folder of its own, removed at its end; a cluster is
    refused, since its machines share no temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="rankfile-ckpt-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables that an operator writes, where all machines see it."""
    return f"{shared_dir(spark).rstrip('/')}/rankfile-{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in ``shared_dir``.  The cluster's spark.cleaner.referenceTracking.cleanCheckpoints
    says whether files go with the last reference to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps that are checkpointed and no longer referred to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def few(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``ids``, a column of numbers, marked for broadcast if there are no more than ``most`` (some 16 MB); else as they are, for a
    shuffled join."""
    ids = checkpoint(ids.distinct())
    return F.broadcast(ids) if ids.count() <= most else ids


def held_out(col: str, mod: int, rest: int):
    """The fold rule of the contracts: crc32 of the id as text."""
    return (F.crc32(F.col(col).cast("string").cast("binary")) % mod) == rest


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, max_bytes: int, key: str = "doc_id") -> list:
    """At most ``n`` labelled rows with whole texts of at most ``max_bytes``, chosen by a hash of the id, equally for each label
    value (as far as there are rows).  Only ids are ranked, and only those whose hash is among the first of their label; the texts
    of the chosen ids are then read.  An id with several labels counts with the smallest.  More than ``MOST_LABELS`` label values
    are refused."""
    spark = docs.sparkSession
    ids = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(key, F.col(label).alias("_y"))
    sizes = {r["_y"]: r["n"] for r in ids.groupBy("_y").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}
    if len(sizes) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} values of {label}")
    if not sizes:
        return []
    each = max(1, n // len(sizes))
    # the first 2 * each + 100 of a label by hash, give or take, and of those the first ``each``
    first = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    cut = spark.createDataFrame([(y, min(1 << 30, (1 << 30) * (2 * each + 100) // k)) for y, k in sizes.items()], ids.select("_y", F.lit(0).cast("long").alias("_cut")).schema)
    some = ids.join(F.broadcast(cut), "_y").where(first < F.col("_cut")).groupBy(key).agg(F.min("_y").alias("_y"))
    by: dict = {}
    for k, y, h in sorted(some.select(key, "_y", F.xxhash64(key)).collect(), key=lambda r: (r[2], str(r[0]))):
        by.setdefault(y, []).append((k, y))
    picked = [r for rows in by.values() for r in rows[:each]]
    if not picked:
        return []
    small = F.broadcast(spark.createDataFrame(picked, ids.schema))
    rows = docs.select(key, "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)).join(small, key)
    return sorted(((r[key], r["text"], r["_y"]) for r in rows.collect()), key=lambda r: (r[0], r[1]))


def trim() -> None:
    """Gives freed memory back to the system: workers live on between tasks, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # another C library
    _libc = None


def slices(batch: pa.RecordBatch, col: str, limit: int = SLICE, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    n = batch.num_rows
    if not n:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = size[at - 1] if at else 0
        end = min(max(at + 1, int(np.searchsorted(size, base + limit, side="right"))), at + rows)
        yield batch.slice(at, end - at)
        at = end
    trim()


def split_words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: (code of each word, offsets of each text's words, distinct words)."""
    text = pc.fill_null(text, "")
    if lower:
        text = pc.ascii_lower(text)
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    keep = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = flat.filter(full).dictionary_encode()
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.combine_chunks()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), keep[offsets], flat.dictionary


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' code points in a row, and the offsets of the words."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word's UTF-8 bytes: a polynomial with mixed byte values, finished with its length."""
    words = words.cast(pa.large_binary())
    n = len(words)
    if not n:
        return np.zeros(0, U)
    buffers = words.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], sizes)
    longest = int(sizes.max(initial=0))
    powers = np.full(longest + 1, U(0x9E3779B97F4A7C15))
    powers[0] = U(1)
    np.multiply.accumulate(powers, out=powers)
    terms = BYTE[data] * powers[at]
    total = np.concatenate([np.zeros(1, U), np.cumsum(terms, dtype=U)])
    return mix((total[offsets[1:]] - total[offsets[:-1]]) ^ (sizes.astype(U) << U(48)))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D))


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


_letters = None


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the edges: labels hook onto smaller ones and paths are halved until nothing changes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        p, q = up[x], up[y]
        live = p != q
        x, y, p, q = x[live], y[live], p[live], q[live]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    return nodes, nodes[up]


def contract(batches):
    """A partition's edges as (root, node): each node under the smallest one it reaches here.  Edges are contracted as they come,
    so what is held follows the nodes, not the edges."""
    held, size = [], 0

    def reduced():
        edges = np.concatenate(held)
        nodes, root = smallest_reachable(edges[:, 0], edges[:, 1])
        return np.stack([root, nodes], axis=1)

    for b in batches:
        if b.num_rows:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], axis=1))
            size += b.num_rows
        if size > 4_000_000:
            held = [reduced()]
            size = 0
    out = reduced() if held else np.zeros((0, 2), np.int64)
    for k in range(0, len(out), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(out[k : k + 50_000, 0]), pa.array(out[k : k + 50_000, 1])], ["a", "b"])


def components(edges: DataFrame, most: int = 100, together: int = 500_000) -> DataFrame:
    """(node, component_id) for the nodes of ``edges`` (a, b): the smallest node reachable.

    Every partition's edges are contracted to a star forest.  Forests of up to ``together`` edges in all (8 MB) are contracted in
    one task.  Beyond that rounds tie a node's labels to the smallest one, contract again, and let every label point to its own
    label, which halves the longest chain; they stop when every node has one label and every label is its own.  More than ``most``
    rounds are an error.  Work and memory of a task follow the nodes of one partition; a label's own label is looked up among the
    few labels that are not their own, so no star is a hot key."""
    schema = "a long, b long"
    links = checkpoint(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(contract, schema).distinct())
    if links.count() <= together:
        return checkpoint(links.repartition(1).mapInArrow(contract, schema)).select(F.col("b").alias("node"), F.col("a").alias("component_id"))
    for _ in range(most):
        low = links.groupBy("b").agg(F.min("a").alias("m"))
        ties = links.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        links = checkpoint(low.select(F.col("m").alias("a"), "b").unionByName(ties).mapInArrow(contract, schema).distinct())
        labels = links.where("a <> b").select(F.col("a").alias("b")).distinct()
        moved = checkpoint(links.where("a <> b").join(labels, "b", "left_semi").groupBy(F.col("b").alias("a")).agg(F.min("a").alias("up")))
        if not moved.isEmpty():
            up = F.broadcast(moved) if moved.count() <= 1_000_000 else moved
            jumped = links.join(up, "a", "left").select(F.coalesce("up", "a").alias("a"), "b")
            # a label that moved stays tied to where it went
            links = checkpoint(jumped.unionByName(moved.select(F.col("up").alias("a"), F.col("a").alias("b"))).distinct())
        elif links.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("component_id"))
    raise RuntimeError(f"components did not settle in {most} rounds")
