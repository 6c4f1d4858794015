"""Operator 9, removal of byte strings of 50 that also start in a document with a smaller id, by a hash-compared suffix sort.

1. Texts are dealt to groups of some 8 MB by their own hash, packed and compressed, and stay dealt that way (a checkpoint that
   keeps its partitioning), so that they cross the network once.  Equal texts meet in one group, where all but those of the
   smallest id are settled; a task sends each text once.
2. Anchors: of every 27 consecutive 24-byte strings the one with the smallest hash (winnowing).  Every 50-byte string holds an
   anchor, at the same place in all its copies, so suffixes need to be sorted at anchors only.  Groups tell their distinct anchors
   to buckets of anchor hashes; those of two groups, or of two documents of one, are answered.
3. Such an anchor goes to its bucket with its context: up to 26 bytes before it and 50 from its start, once for all equal contexts
   of a group, with the smallest document.  An anchor of more than ``HOT`` groups goes by itself and the 13 bytes after it, and by
   itself and the 13 before it (a 50-byte string holds one of the two), so that a common phrase does not fill one bucket.
4. In one anchor's contexts two mergesorts order the suffixes from the anchor on and the reversed texts before it; two suffixes are
   compared through prefix polynomial hashes and a binary search for their common extension, logarithmic in the length.  The
   extensions of neighbours, checked byte by byte, give runs: contexts share the string that begins a bytes before the anchor if
   they are in one run of extensions of at least 50 - a onwards and in one of at least a backwards.  In such a class all documents
   but the smallest are marked.
5. Marks return to their groups, where the covered bytes are removed.

Defined results: null text counts as empty; texts under 50 bytes lose nothing; very long texts are cut in overlapping pieces for
hashing and stay whole otherwise; rows with the same id are one document to each other (neither is smaller) and give one row
each; a null id loses and gives nothing; an empty table gives an empty result; columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, U, checkpoint, mix, release, slices, trim

SPAN, ANCHOR = 50, 24
SIDE = SPAN - ANCHOR  # bytes on either side of an anchor that a string holding it may reach
HALF = SIDE // 2
PLACES = SIDE + 1
WIDTH = SPAN + SIDE
HOT = 256
GROUP, BUFFER, PIECE = 8 << 20, 24 << 20, 1 << 20
A = U(0x9E3779B97F4A7C15)
POWER = np.full(WIDTH + 1, A)
POWER[0] = U(1)
np.multiply.accumulate(POWER, out=POWER)
WHOLE, AFTER, BEFORE = range(3)
CONTEXT = np.dtype([("doc", np.int64), ("place", np.uint32), ("side", np.uint8), ("left", np.uint8), ("right", np.uint8), ("bytes", np.uint8, WIDTH)])
MARK = np.dtype([("place", np.uint32), ("mask", np.uint32)])
TEXTS, GONE = range(2)


# anchors and contexts
def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 24 bytes from each position, by doubling; the last 23 positions are cut off."""
    m = len(data) - ANCHOR + 1
    if m <= 0:
        return np.zeros(0, U)
    h, n = BYTE[data], 1
    eight = None
    while n < 16:
        h = h[:-n] * POWER[n] + h[n:]
        n *= 2
        if n == 8:
            eight = h
    return mix(h[:m] * POWER[8] + eight[16 : 16 + m])


def sliding(x: np.ndarray, op) -> np.ndarray:
    """``op`` over each 27 consecutive values."""
    n = 1
    while n < 16:
        x = op(x[:-n], x[n:])
        n *= 2
    return op(x[: -(PLACES - 16)], x[PLACES - 16 :])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts that lie one after the other, each up to its end; a text too short for a whole
    string has none.  Windows are taken piece by piece; a piece reads on to the end of its last window."""
    at, key = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for a in range(0, len(data), PIECE):
        x = data[a : a + PIECE + SPAN - 1]
        h = gram_hashes(x)
        if len(h) < PLACES:
            continue
        low = sliding(h, np.minimum)
        begin = np.arange(a, a + len(low))
        low[ends[np.searchsorted(ends, begin, side="right")] - begin < SPAN] = 0
        edge = np.zeros(PLACES - 1, U)
        high = sliding(np.concatenate([edge, low, edge]), np.maximum)
        found = np.flatnonzero((high == h) & (high > 0))
        at.append(found + a)
        key.append(h[found])
    at, one = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(key)[one]


def contexts(data: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by anchor, zero where the text ends; bytes there are before the anchor; bytes there are after it)."""
    left, right = np.minimum(at - start, SIDE), np.minimum(end - at - ANCHOR, SIDE)
    out = np.empty((len(at), WIDTH), np.uint8)
    cols = np.arange(WIDTH)
    for k in range(0, len(at), 20_000):
        s = slice(k, k + 20_000)
        place = at[s, None] + (cols - SIDE)
        out[s] = data[place.clip(0, len(data) - 1)]
        out[s][(cols < SIDE - left[s, None]) | (cols >= SPAN + right[s, None])] = 0
    return out, left.astype(np.uint8), right.astype(np.uint8)


def part_hashes(bytes_: np.ndarray, a: int, b: int) -> np.ndarray:
    out = np.zeros(len(bytes_), U)
    for k in range(a, b):
        out = out * A + BYTE[bytes_[:, k]]
    return mix(out)


# groups of texts
def to_ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def from_ipc(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()


def by_number(number: np.ndarray):
    """(number, places) of the equal numbers."""
    if not len(number):
        return
    order = np.argsort(number, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], number[order][1:] != number[order][:-1]]))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
        yield int(number[order[a]]), order[a:b]


def pack(groups: int):
    """Texts (TEXTS) by group of their hash; of a text that the task has sent before with a smaller id only id and length (GONE)."""

    def run(batches):
        held, size, sent = [], 0, {}

        def flush():
            doc = np.array([h[0] for h in held], object)
            number = np.fromiter((h[2] for h in held), np.int64, len(held))
            kind = np.fromiter((h[3] for h in held), np.int64, len(held))
            rows = []
            for code, at in by_number(2 * number + kind):
                some = at.tolist()
                body = pa.array([held[k][1] for k in some], pa.large_binary() if code % 2 == TEXTS else pa.int64())
                rows.append((code // 2, code % 2, to_ipc(pa.table({"doc": pa.array(doc[at].tolist(), pa.int64()), "text": body}))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary()))], ["at", "kind", "blob"])

        for big in batches:
            for b in slices(big, "text"):
                for doc, h, t in zip(b.column("doc").to_pylist(), b.column("h").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                    if doc is not None and len(t) >= SPAN:
                        digest = hashlib.blake2b(t, digest_size=16).digest()
                        least = sent.get(digest)
                        if least is not None and least < doc:
                            held.append((doc, len(t), int(mix(np.array([doc]).view(U))[0] % U(groups)), GONE))
                            size += 64
                            continue
                        if len(sent) > 200_000:
                            sent.clear()
                        sent[digest] = doc
                    held.append((doc, t, h % groups, TEXTS))
                    size += len(t) + 64
                if size >= BUFFER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


class Group:
    """The texts of a group: one row for each distinct (id, text) in order of them; ``data`` holds those that are no later copy."""

    def __init__(self, table: pa.Table):
        rows: list[tuple] = []
        self.gone: list[tuple] = []
        self.times: dict[tuple, int] = {}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            part = from_ipc(blob)
            pairs = zip(part.column("doc").to_pylist(), part.column("text").to_pylist(), strict=True)
            (rows if kind == TEXTS else self.gone).extend(pairs)
        self.nameless = [t for d, t in rows if d is None]
        for r in rows:
            if r[0] is not None:
                self.times[r] = self.times.get(r, 0) + 1
        first: dict[bytes, int] = {}
        for d, t in self.times:
            first[t] = min(d, first.get(t, d))
        self.copies = [r for r in self.times if first[r[1]] < r[0] and len(r[1]) >= SPAN]
        self.rows = sorted(r for r in self.times if first[r[1]] == r[0] or len(r[1]) < SPAN)
        sizes = np.fromiter((len(t) for _, t in self.rows), np.int64, len(self.rows))
        self.doc = np.fromiter((d for d, _ in self.rows), np.int64, len(self.rows))
        self.data = np.frombuffer(b"".join(t for _, t in self.rows), np.uint8)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.at, self.key = anchors(self.data, self.end) if len(self.data) else (np.zeros(0, np.int64), np.zeros(0, U))
        self.row = np.searchsorted(self.end, self.at, side="right")

    def contexts(self, some: np.ndarray):
        return contexts(self.data, self.at[some], self.start[self.row[some]], self.end[self.row[some]])

    def firsts(self) -> np.ndarray:
        """Of each anchor the first one with an equal context (compared byte by byte)."""
        out = np.arange(len(self.at))
        _, inverse, count = np.unique(self.key, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[inverse] > 1)
        if not len(some):
            return out
        bytes_, left, right = self.contexts(some)
        h = part_hashes(bytes_, 0, WIDTH) ^ mix(left.astype(U) * U(64) + right)
        order = np.lexsort((some, h))
        lead = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        head = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]
        same = (bytes_[order] == bytes_[head]).all(axis=1) & (left[order] == left[head]) & (right[order] == right[head])
        out[some[order[same]]] = some[head[same]]
        return out


def code_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of an anchor's hash in one number."""
    return ((((key >> U(32)) * U(buckets)) >> U(32)) << U(32) | (key & U(0xFFFFFFFF))).view(np.int64)


def give_anchors(buckets: int):
    """A group's distinct anchors by bucket: first those of one document, then those of several."""

    def run(rows: pa.Table) -> pa.Table:
        g = Group(rows)
        code = code_of(g.key, buckets)
        doc = g.doc[g.row]
        order = np.lexsort((doc, code))
        code, doc = code[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(code)) - 1
        several = doc[first] != doc[last]
        code = code[first]
        out = []
        for k, at in by_number(code >> 32):
            low = (code[at] & 0xFFFFFFFF).astype(np.uint32)
            out.append((k, int((~several[at]).sum()), np.concatenate([low[~several[at]], low[several[at]]]).tobytes()))
        group = rows.column("at")[0].as_py()
        trim()
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "at": pa.array([group] * len(out), pa.int64()), "single": pa.array([r[1] for r in out], pa.int64()), "blob": pa.array([r[2] for r in out], pa.binary())})

    return run


def buckets_of(batches, column: str = "bucket"):
    """(bucket, rows as lists by column) of batches whose rows come in order of their buckets."""
    now, held = None, None
    for b in batches:
        names = b.schema.names
        cols = [b.column(n).to_pylist() for n in names]
        for row in zip(*cols, strict=True):
            r = dict(zip(names, row, strict=True))
            if r[column] != now:
                if held:
                    yield now, held
                now, held = r[column], []
            held.append(r)
    if held:
        yield now, held


def shared_anchors(batches):
    """Of each bucket the anchors met in two groups, or in two documents of one, told to the groups that hold them; negative
    counts stand for hot ones."""
    for bucket, rows in buckets_of(batches):
        low = np.concatenate([np.frombuffer(r["blob"], np.uint32) for r in rows])
        sizes = [len(r["blob"]) // 4 for r in rows]
        own = np.repeat(np.arange(len(rows)), sizes)
        several = np.concatenate([np.arange(n) >= r["single"] for n, r in zip(sizes, rows, strict=True)])
        _, inverse, count = np.unique(low, return_inverse=True, return_counts=True)
        wide = np.bincount(inverse, several, len(count)) + count
        keep = wide[inverse] > 1
        hot = count[inverse] > HOT
        out = []
        for some, flag in ((keep & ~hot, 0), (keep & hot, 1)):
            for k, at in by_number(own[some]):
                out.append((rows[k]["at"], bucket, flag, low[some][at].tobytes()))
        for k in range(0, len(out), 1000):
            part = out[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([r[3] for r in part], pa.binary())], ["group", "bucket", "hot", "blob"])
    trim()


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def packed(part: np.ndarray) -> bytes:
    """A structured array column by column, compressed; ids and places, which rise, by their steps."""
    cols = [steps(part[n]) if n in ("doc", "place") else part[n] for n in part.dtype.names]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in cols))


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = len(raw) // kind.itemsize, 0
    out = np.empty(n, kind)
    for name in kind.names:
        size = kind[name].itemsize * n
        col = np.frombuffer(raw[at : at + size], kind[name].base).reshape((n, *kind[name].shape))
        out[name] = np.cumsum(col, dtype=col.dtype) if name in ("doc", "place") else col
        at += size
    return out


def give_contexts(buckets: int):
    """For a group and its shared anchors: contexts by bucket, one for all equal ones."""

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        if rows.num_rows and replies.num_rows:
            g = Group(rows)
            code = code_of(g.key, buckets)
            one = np.flatnonzero(g.firsts() == np.arange(len(code)))
            codes = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
            for bucket, hot, blob in zip(*(replies.column(c).to_pylist() for c in ("bucket", "hot", "blob")), strict=True):
                codes[hot].append((bucket << 32) + np.frombuffer(blob, np.uint32).astype(np.int64))
            for hot, want in enumerate(codes):
                some = one[np.isin(code[one], np.concatenate(want))]
                if not len(some):
                    continue
                c = np.empty(len(some), CONTEXT)
                c["bytes"], c["left"], c["right"] = g.contexts(some)
                c["doc"], c["place"], c["side"] = g.doc[g.row[some]], some, WHOLE
                if not hot:
                    out += [(k, packed(c[at])) for k, at in by_number(code[some] >> 32)]
                    continue
                for side, a, b, ok in ((AFTER, SIDE, SPAN + HALF, c["right"] >= HALF), (BEFORE, SIDE - HALF, SPAN, c["left"] >= HALF)):
                    c["side"] = side
                    number = (part_hashes(c["bytes"], a, b) % U(buckets)).astype(np.int64)
                    out += [(k, packed(c[ok][at])) for k, at in by_number(number[ok])]
            group = rows.column("at")[0].as_py()
        trim()
        return pa.table({"bucket": pa.array([r[0] for r in out], pa.int64()), "group": pa.array([group] * len(out) if out else [], pa.int64()), "blob": pa.array([r[1] for r in out], pa.binary())})

    return run


class Suffixes:
    """Rows of bytes, compared through prefix polynomial hashes."""

    def __init__(self, bytes_: np.ndarray):
        self.bytes, self.width = bytes_, bytes_.shape[1]
        prefix = np.zeros((len(bytes_), self.width + 1), U)
        for k in range(self.width):
            prefix[:, k + 1] = prefix[:, k] * A + BYTE[bytes_[:, k]]
        self.prefix = prefix.ravel()

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.width)
        x, y = i * (self.width + 1), j * (self.width + 1)
        for _ in range(self.width.bit_length()):
            mid = (low + high + 1) // 2
            same = self.prefix[x + mid] == self.prefix[y + mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether row i sorts before j; equal ones count as ``ties`` says."""
        n = self.extension(i, j)
        k = np.minimum(n, self.width - 1)
        return np.where(n == self.width, ties, self.bytes[i, k] < self.bytes[j, k])

    def sort(self, size: np.ndarray) -> np.ndarray:
        """Order within each group (groups lie one after the other): a bottom-up mergesort of all groups at once.  An element's
        new place is its place in its own run and its rank, by binary search, in the neighbouring one."""
        n = int(size.sum())
        order = np.arange(n)
        group = np.repeat(np.arange(len(size)), size)
        stop_ = np.cumsum(size)
        begin, end = (stop_ - size)[group], stop_[group]
        width = 1
        while width < int(size.max(initial=0)):
            live = np.flatnonzero(end - begin > width)
            b, e = begin[live], end[live]
            run = (live - b) // width
            left = run % 2 == 0
            mine = b + run * width
            other = np.where(left, mine + width, mine - width)
            low, high = np.minimum(other, e), np.minimum(other + width, e)
            base = low.copy()
            for _ in range(width.bit_length()):
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                # a left element goes before equal right ones, a right element after equal left ones
                less = self.before(order[mid], order[live[open_]], ~left[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            new = order.copy()
            new[np.where(left, mine, other) + (live - mine) + (low - base)] = order[live]
            order = new
            width *= 2
        return order

    def runs(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extension of each with the one before it, -1 where a group begins); extensions are checked byte by byte."""
        order = self.sort(size)
        shared = np.full(len(order), -1)
        inner = np.setdiff1d(np.arange(len(order)), np.cumsum(size) - size)
        x, y = order[inner - 1], order[inner]
        n = self.extension(x, y)
        unlike = (self.bytes[x] != self.bytes[y]) & (np.arange(self.width) < n[:, None])
        shared[inner] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), n)
        return order, shared


def compare(c: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(context, place): whether the string that begins so many bytes before the anchor starts in a smaller document too.  ``size``
    are the groups' sizes; the contexts lie group by group."""
    n = len(c)
    on, onwards = Suffixes(np.ascontiguousarray(c["bytes"][:, SIDE:])).runs(size)
    back, backwards = Suffixes(np.ascontiguousarray(c["bytes"][:, SIDE - 1 :: -1])).runs(size)
    bits = np.zeros((n, PLACES), bool)
    one, two = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(PLACES):
        valid = (c["left"] >= a) & (c["right"] >= SIDE - a) & ((c["side"] == WHOLE) | ((c["side"] == AFTER) == (a <= HALF)))
        one[on] = np.cumsum(onwards < SPAN - a)
        two[back] = np.cumsum(backwards < a)
        some = np.flatnonzero(valid)
        if not len(some):
            continue
        kind = one[some] * (n + 1) + two[some]
        order = np.lexsort((c["doc"][some], kind))
        some, kind = some[order], kind[order]
        lead = np.concatenate([[True], kind[1:] != kind[:-1]])
        least = c["doc"][some[np.flatnonzero(lead)]][np.cumsum(lead) - 1]
        bits[some, a] = c["doc"][some] > least
    return bits


def give_marks(batches):
    """Of each bucket's contexts the places marked, by group of the documents."""
    for _, rows in buckets_of(batches):
        parts = [unpacked(r["blob"], CONTEXT) for r in rows]
        c = np.concatenate(parts)
        group = np.repeat(np.array([r["group"] for r in rows]), [len(p) for p in parts])
        del parts
        # what is compared: the same anchor, or the same anchor and the bytes on one side of it
        kind = part_hashes(c["bytes"], SIDE, SPAN)
        for side, a, b in ((AFTER, SPAN, SPAN + HALF), (BEFORE, SIDE - HALF, SIDE)):
            hot = np.flatnonzero(c["side"] == side)
            kind[hot] = mix(kind[hot] ^ part_hashes(c["bytes"][hot], a, b) ^ U(side))
        order = np.argsort(kind, kind="stable")
        c, group, kind = c[order], group[order], kind[order]
        first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
        size = np.diff(np.append(first, len(kind)))
        many = np.repeat(size > 1, size)
        c, group, size = c[many], group[many], size[size > 1]
        mask = np.zeros(len(c), np.uint32)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            # whole anchors, some tens of thousands of contexts at once
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 20_000)))
            a, b = int(ends[at] - size[at]), int(ends[min(to, len(size)) - 1])
            mask[a:b] = (compare(c[a:b], size[at:to]).astype(np.uint32) << np.arange(PLACES, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
            at = to
        hit = np.flatnonzero(mask)
        out = np.empty(len(hit), MARK)
        out["place"], out["mask"] = c["place"][hit], mask[hit]
        found = [(k, np.sort(out[at], order="place")) for k, at in by_number(group[hit])]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([packed(p) for _, p in found], pa.binary())], ["group", "blob"])
    trim()


def covered(g: Group, masks: np.ndarray) -> np.ndarray:
    """Which bytes of a group's data are covered by a marked string; ``masks`` by anchor."""
    first = g.firsts()
    doc = g.doc[g.row]
    left, right = np.minimum(g.at - g.start[g.row], SIDE), np.minimum(g.end[g.row] - g.at - ANCHOR, SIDE)
    begins = np.zeros(len(g.data) + 1, bool)
    place = np.arange(PLACES)
    later = doc > doc[first]
    some = np.flatnonzero(later | (masks[first] > 0))
    for k in range(0, len(some), 50_000):
        s = some[k : k + 50_000]
        valid = (left[s, None] >= place) & (right[s, None] >= SIDE - place)
        r, a = np.nonzero(valid & (later[s, None] | ((masks[first[s]][:, None] >> place.astype(np.uint32)) & np.uint32(1)).astype(bool)))
        begins[g.at[s[r]] - a] = True
    total = np.cumsum(begins[:-1], dtype=np.int32)
    total[SPAN:] -= total[:-SPAN].copy()
    return total > 0


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def cut(rows: pa.Table, replies: pa.Table) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows:
        g = Group(rows)
        masks = np.zeros(len(g.at), np.uint32)
        for blob in replies.column("blob").to_pylist():
            m = unpacked(blob, MARK)
            np.bitwise_or.at(masks, m["place"], m["mask"])
        gone = covered(g, masks) if len(g.at) else np.zeros(len(g.data), bool)
        for (doc, text), a, b in zip(g.rows, g.start.tolist(), g.end.tolist(), strict=True):
            x = gone[a:b]
            n = int(x.sum())
            spans = int(x[0]) + int((x[1:] & ~x[:-1]).sum()) if n else 0
            kept = g.data[a:b][~x].tobytes() if n else text
            out += [(doc, b - a, n, spans, hashlib.sha256(kept).hexdigest())] * g.times[(doc, text)]
        none = hashlib.sha256(b"").hexdigest()
        out += [(doc, len(text), len(text), 1, none) for doc, text in g.copies for _ in range(g.times[(doc, text)])]
        out += [(doc, n, n, 1, none) for doc, n in g.gone]
        out += [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for t in g.nameless]
    cols = list(zip(*out, strict=True)) if out else [[]] * 5
    trim()
    return pa.table([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 4, pa.string()), strict=True)], names=COLUMNS)


def dealt(df: DataFrame) -> DataFrame:
    """A checkpoint that keeps its partitioning, which a plan still open to adaptive changes would lose."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def remove_repeats(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(partitions, -(-size // GROUP))
    buckets = max(8 * partitions, size >> 22)  # the anchors of some 4 MB of text each, which a task holds at once
    hashed = plain.select("doc", F.xxhash64("text").alias("h"), "text")
    texts = dealt(hashed.mapInArrow(pack(groups), "at long, kind long, blob binary").repartition(partitions, "at"))
    release(spark)

    def by_bucket(df: DataFrame) -> DataFrame:
        return df.repartition(partitions, "bucket").sortWithinPartitions("bucket")

    told = texts.groupBy("at").applyInArrow(give_anchors(buckets), "bucket long, at long, single long, blob binary")
    shared = by_bucket(told).mapInArrow(shared_anchors, "group long, bucket long, hot long, blob binary")
    given = texts.groupBy("at").cogroup(shared.groupBy("group")).applyInArrow(give_contexts(buckets), "bucket long, group long, blob binary")
    marks = checkpoint(by_bucket(given).mapInArrow(give_marks, "group long, blob binary"))
    release(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return texts.groupBy("at").cogroup(marks.groupBy("group")).applyInArrow(cut, schema).withColumnRenamed("doc_id", key)


def op9_repeats(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs)
