"""Operator 13, fill-in-middle transformation by one numpy kernel over whole Arrow batches.

A batch's texts lie in one UTF-8 buffer.  A byte-class table marks white space, a mask of adjacent bytes marks where tokens end
(before white space that follows something else, and at the end of a text), its running sum counts the tokens of all texts, and
``searchsorted`` finds the cuts of all rows together.  Parts are put in their new order by one gather over the buffer, with the
sentinels behind it.  ``restored`` finds the sentinels in the output and puts the parts back.

Cut places and form follow from the sha256 of ``seed:doc_id``, so a row's result depends on nothing else and a lost task may run
again.  No row is shuffled; a slice of at most 3 MB (one text at least) is held at once.

Defined results: a null text counts as empty, and gives plain form and empty output; a null id hashes as an empty string; very long
texts are cut whole; texts that hold a sentinel stay plain; repeated rows give repeated results; an empty table gives an empty
result; other columns are kept by ``transformed`` unless they bear the name of one that it adds, and ``op13_middle`` does not read
them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# The sentinels and the white space of the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = PREFIX + SUFFIX + MIDDLE
FORMS = ("plain", "psm", "spm")
PLAIN, PSM, SPM = range(3)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SENTINEL_NAME = np.zeros(256, bool)
SENTINEL_NAME[list(b"PSM")] = True
ADDED = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def buffers_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, from 0; nulls are empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def string_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def running(mask: np.ndarray) -> np.ndarray:
    """How many bytes before each place are marked."""
    return np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the last byte of each token: white space with what follows it, or the white space that ends a text."""
    space = SPACE[data]
    ends = np.zeros(len(data), bool)
    ends[:-1] = ~space[:-1] & space[1:]
    ends[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return ends


def sentinels_at(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where a sentinel begins; none lies over the end of a text."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[:-2] == ord("<")) & SENTINEL_NAME[data[1:-1]] & (data[2:] == ord(">")))
    return at[at + 3 <= offsets[np.searchsorted(offsets, at, side="right")]]


def gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of every row (a row of ``begin`` and ``end``) one after the other: (bytes, offsets of the rows)."""
    size = (end - begin).ravel()
    before = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(before[-1]) + np.repeat(begin.ravel() - before[:-1], size)
    return data[at], before[:: begin.shape[1]]


def split_rows(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, fim_rate: int, spm_rate: int):
    """(tokens, form, first cut, second cut) of every row; ``h`` has four hashes a row."""
    begin, end = offsets[:-1], offsets[1:]
    tokens = running(token_ends(data, offsets))
    n = tokens[end] - tokens[begin]
    first, second = np.sort(h[:, :2] % (n + 1)[:, None], axis=1).T
    # the place after the k-th token of a row is the first one with as many ends before it
    cuts = [np.where(k > 0, np.searchsorted(tokens, tokens[begin] + k), begin) for k in (first, second)]
    held = np.zeros(len(n), bool)
    held[np.searchsorted(offsets, sentinels_at(data, offsets), side="right") - 1] = True
    plain = (end == begin) | held | (h[:, 2] % 100 >= fim_rate)
    return n, np.where(plain, PLAIN, np.where(h[:, 3] % 100 < spm_rate, SPM, PSM)), *cuts


def rearranged(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The output of every row.  Parts of a row are (marker, part) three times; unused ones are empty."""
    begin, end = offsets[:-1], offsets[1:]
    mark = len(data) + 3 * np.arange(3)  # the sentinels lie behind the texts
    low, high = np.repeat(begin[:, None], 6, axis=1), np.repeat(begin[:, None], 6, axis=1)
    high[:, 5] = np.where(form == PLAIN, end, begin)
    parts = {0: (begin, first), 1: (second, end), 2: (first, second)}
    for kind, order in ((PSM, (0, 1, 2)), (SPM, (1, 0, 2))):
        rows = form == kind
        for k, p in enumerate(order):
            low[rows, 2 * k], high[rows, 2 * k] = mark[p], mark[p] + 3
            low[rows, 2 * k + 1], high[rows, 2 * k + 1] = parts[p][0][rows], parts[p][1][rows]
    return gather(np.concatenate([data, np.frombuffer(SENTINELS, np.uint8)]), low, high)


def put_back(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts from outputs and forms: a row that is not plain holds three sentinels, the first at its begin."""
    begin, end = offsets[:-1], offsets[1:]
    low, high = np.repeat(begin[:, None], 3, axis=1), np.repeat(begin[:, None], 3, axis=1)
    high[:, 2] = np.where(form == PLAIN, end, begin)
    at = sentinels_at(data, offsets)
    row = np.searchsorted(offsets, at, side="right") - 1
    at = at[form[row] != PLAIN].reshape(-1, 3)
    for kind, order in ((PSM, (0, 2, 1)), (SPM, (1, 2, 0))):
        rows = form == kind
        place = at[kind == form[form != PLAIN]]
        ends = np.stack([place[:, 1], place[:, 2], end[rows]], axis=1)
        for k, p in enumerate(order):
            low[rows, k], high[rows, k] = place[:, p] + 3, ends[:, p]
    return gather(data, low, high)


def transformed(docs: DataFrame, *, seed: int = 42, key: str = "doc_id", text: str = "text", fim_rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm, spm), prefix_chars and middle_chars (code points; null if plain) and output."""
    names = [f.name for f in ADDED]
    kept = [c for c in docs.columns if c not in names]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(*kept, F.array(*h).alias("_h"))
    schema = T.StructType([*(docs.schema[c] for c in kept), *ADDED])

    def run(batches):
        for big in batches:
            for b in slices(big, text):
                data, offsets = buffers_of(b.column(text))
                hashes = b.column("_h").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                n, form, first, second = split_rows(data, offsets, hashes, fim_rate, spm_rate)
                chars = running((data & 0xC0) != 0x80)  # bytes that begin a code point
                plain = form == PLAIN
                out = string_array(*rearranged(data, offsets, form, first, second))
                more = [pa.array(n), pa.array(np.array(FORMS)[form], pa.string()), pa.array(chars[first] - chars[offsets[:-1]], mask=plain), pa.array(chars[second] - chars[first], mask=plain), out]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, *names])

    return rows.mapInArrow(run, schema)


def restored(rows: DataFrame, *, output: str = "output", form: str = "form", out: str = "text") -> DataFrame:
    """Adds (or replaces) ``out``: the text rebuilt from output and form alone."""
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.StringType())])

    def run(batches):
        for big in batches:
            for b in slices(big, output):
                data, offsets = buffers_of(b.column(output))
                kind = pc.index_in(b.column(form), pa.array(FORMS)).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), string_array(*put_back(data, offsets, kind))], [*kept, out])

    return rows.select(*kept).mapInArrow(run, schema)


def op13_middle(docs: DataFrame) -> DataFrame:
    rows = restored(transformed(docs.select("doc_id", "text")).drop("text"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("text").alias("restored_sha256"))
