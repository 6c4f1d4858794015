"""Operator 3, sampled SentencePiece encoding and lossless decoding.

Every unit of a text (a run of spaces with the characters up to the next one) spans a lattice of vocabulary pieces.  Forward
filtering sums the weights exp(alpha * score) of all segmentations up to each character; backward sampling then draws pieces from
the end.  The random numbers are a hash of (seed, row key, unit number, step), so a row's segmentation does not depend on
partitions, order or retries.  A piece whose spaces all come first cannot reach over a unit's edge, so sampling by unit is sampling
from the whole lattice; pieces with a space after another character, which such models do not learn, are no part of it.

Characters without a piece, and U+2581 in the text itself (it stands for the space in pieces), are spelt in byte pieces, so
decoding gives back the text exactly.

Defined results: null text gives null ids (0 pieces, lossless), empty text no ids; very long texts are encoded whole, in time
linear in their length (texts without a space are one unit and take a numpy step for each character); repeated keys with the same
text give the same ids, with other texts other ids; an empty table gives an empty result; columns beside key and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, mix, slices, trim

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, ODD = 0x2581, 0x7FFFFFFF
SLOTS, SHIFT = 1 << 20, U(44)
PART = 100_000  # characters of new units, about, whose lattices are built at once (some 300 bytes each)


def load(path: str = MODEL) -> dict:
    """Pieces, scores and byte pieces of a model file, read on the driver; a few hundred KB to broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, byte_ids = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        plain = not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
        pieces.append(sp.id_to_piece(i) if plain else "")
        scores.append(sp.get_score(i))
    return model(pieces, scores, byte_ids)


def model(pieces: list[str], scores: list[float], byte_ids: list[int]) -> dict:
    if -1 in byte_ids:
        raise ValueError("the vocabulary lacks byte pieces")
    return {"pieces": pieces, "scores": scores, "bytes": byte_ids}


def char_hash(cps: np.ndarray) -> np.ndarray:
    return mix(cps.astype(U) * U(0x9E3779B97F4A7C15) + U(1))


FACTOR = U(0xC2B2AE3D27D4EB4F)
FACTOR_INT = 0xC2B2AE3D27D4EB4F


def times(n: int) -> np.uint64:
    return U(n * FACTOR_INT % 2**64)


class Grown:
    """An array that takes more values at its end without a copy each time."""

    def __init__(self, kind):
        self.held, self.size = np.empty(1 << 16, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.held):
            more = np.empty(max(need, 5 * len(self.held) // 4), self.held.dtype)
            more[: self.size] = self.held[: self.size]
            self.held = more
        self.held[self.size : need] = values
        self.size = need


class Lattice:
    """Lattices of units seen so far, laid end to end; emptied beyond ``most`` edges (some 30 bytes each with what belongs to
    them)."""

    def __init__(self, vocabulary: dict, alpha: float, most: int = 2_000_000):
        self.most = most
        self.byte_ids = vocabulary["bytes"]
        # no unit has a space after its first other character, so no piece that has one can match
        pieces = [(p, i) for i, p in enumerate(vocabulary["pieces"]) if p and "▁" not in p.lstrip("▁")]
        scores = np.array(vocabulary["scores"], float)
        self.logw = alpha * scores
        low = min((scores[i] for _, i in pieces), default=-1.0)
        self.byte_logw = alpha * (low - 1.0)
        self.longest = max((len(p) for p, _ in pieces), default=1)
        lengths = np.fromiter((len(p) for p, _ in pieces), np.int64, len(pieces))
        start = np.cumsum(lengths) - lengths
        h = char_hash(np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le"), np.uint32))
        keys = np.zeros(len(pieces), U)
        for n in range(self.longest):
            some = np.flatnonzero(lengths > n)
            keys[some] = keys[some] * FACTOR + h[start[some] + n]
        order = np.argsort(keys)
        self.keys, self.piece_ids = keys[order], np.array([i for _, i in pieces], np.int64)[order]
        self.lengths = lengths[order]
        self.slot = np.full(SLOTS, -1, np.int32)
        slots = (self.keys >> SHIFT).astype(np.int64)
        self.slot[slots[::-1]] = np.arange(len(self.keys))[::-1]  # first entry of each slot
        self.deepest = int(np.bincount(slots).max()) if len(slots) else 0
        self.clear()

    def clear(self):
        self.ids: dict[str, int] = {}
        self.nodes = 0
        self.begin, self.last = Grown(np.int32), Grown(np.int32)  # first and last node of each unit
        self.first = Grown(np.int32)  # first edge into each node
        # of each edge: cumulative probability within its node, node it comes from, piece, pieces written
        self.cum, self.prev, self.piece, self.size = Grown(np.float32), Grown(np.int32), Grown(np.int32), Grown(np.int8)
        self.spelt: dict[int, list[int]] = {}

    def find(self, key: np.ndarray, n: int) -> np.ndarray:
        """Piece ids of keys of ``n`` characters, -1 where there is none."""
        out = np.full(len(key), -1, np.int64)
        at = np.flatnonzero((place := self.slot[(key >> SHIFT).astype(np.int64)]) >= 0)
        place, key = place[at], key[at]
        for k in range(self.deepest):
            q = np.minimum(place + k, len(self.keys) - 1)
            hit = (self.keys[q] == key) & (self.lengths[q] == n)
            out[at[hit]] = self.piece_ids[q[hit]]
        return out

    def add(self, units: list[str]) -> None:
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        cps = np.where(raw == 32, SPACE, np.where(raw == SPACE, ODD, raw)).astype(np.uint32)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        unit = np.repeat(np.arange(len(units)), sizes)
        left = (ends[unit] - np.arange(len(cps))).astype(np.int64)  # characters to the unit's end
        h = char_hash(cps)
        key, at = h, np.arange(len(cps))
        begin, length, ids = [], [], []
        for n in range(1, self.longest + 1):
            if n > 1:
                keep = np.flatnonzero(left[at] >= n)
                at = at[keep]
                if not len(at):
                    break
                key = key[keep] * FACTOR + h[at + n - 1]
            found = self.find(key, n)
            got = np.flatnonzero(found >= 0)
            begin.append(at[got])
            length.append(np.full(len(got), n))
            ids.append(found[got])
            if n == 1:
                odd = np.flatnonzero(found < 0)
        spell = [chr(c).encode("utf-8", "surrogatepass") for c in np.where(cps[odd] == ODD, SPACE, cps[odd]).tolist()]
        begin, length = np.concatenate([odd, *begin]), np.concatenate([np.ones(len(odd), np.int64), *length])
        ids = np.concatenate([np.full(len(odd), -1), *ids])
        width = np.ones(len(ids), np.int64)
        width[: len(odd)] = list(map(len, spell))
        logw = np.where(ids >= 0, self.logw[ids], self.byte_logw * width)
        # a unit of n characters has n + 1 nodes, numbered on from those held already; here they are counted from 0
        node0 = starts + np.arange(len(units))
        src = begin + unit[begin]
        dst = src + length
        order = np.argsort(dst, kind="stable")
        src, dst, logw, ids, width = src[order], dst[order], logw[order], ids[order], width[order]
        nodes = len(cps) + len(units)
        first = np.searchsorted(dst, np.arange(nodes + 1))
        counts = np.diff(first)
        depth = np.arange(nodes) - np.repeat(node0, sizes + 1)  # characters before each node
        by_depth = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 32767 else depth, kind="stable")
        levels = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if nodes else [0]
        total = np.zeros(nodes)
        value = np.zeros(len(dst))
        for a, b in zip(levels[1:-1], levels[2:], strict=True):
            d = by_depth[a:b]
            c = counts[d]
            lead = np.cumsum(c) - c
            e = np.repeat(first[d] - lead, c) + np.arange(int(c.sum()))
            value[e] = total[src[e]] + logw[e]
            total[d] = np.logaddexp.reduceat(value[e], lead)
        p = np.exp(value - total[dst])
        order = np.argsort(dst - np.minimum(p, 0.9999))  # likely pieces first
        p, src, ids, width = p[order], src[order], ids[order], width[order]
        run = np.cumsum(p)
        full = counts > 0
        lead = first[:-1][full]
        run -= np.repeat(run[lead] - p[lead], counts[full])
        run[lead + counts[full] - 1] = 2.0  # the last piece takes what rounding leaves
        edge0 = self.cum.size
        wide = np.flatnonzero(ids < 0)
        where = src[wide] - np.searchsorted(node0, src[wide], side="right") + 1
        text = {int(o): s for o, s in zip(odd.tolist(), spell, strict=True)}
        for e, c in zip(wide.tolist(), where.tolist(), strict=True):
            self.spelt[edge0 + e] = [self.byte_ids[x] for x in text[c]]
        self.cum.extend(run)
        self.prev.extend(src + self.nodes)
        self.piece.extend(ids)
        self.size.extend(width)
        self.first.extend(first[:-1] + edge0)
        self.begin.extend(node0 + self.nodes)
        self.last.extend(node0 + sizes + self.nodes)
        self.ids.update(zip(units, range(len(self.ids), len(self.ids) + len(units)), strict=True))
        self.nodes += nodes

    def units(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each occurrence and the number of units by text; a unit is a run of spaces and what follows up to the next."""
        if self.cum.size > self.most or len(self.spelt) > self.most // 20:
            self.clear()
            trim()
        lists = pa.compute.split_pattern(texts, " ")
        full = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False) > 0
        counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        own = np.repeat(np.arange(len(counts)), counts)
        # an empty part that another follows is one more space before that one
        more = pa.compute.binary_length(flat).to_numpy(zero_copy_only=False) == 0
        more[np.cumsum(counts)[counts > 0] - 1] = False
        kept = np.flatnonzero(~more)
        spaces = np.diff(kept, prepend=-1)
        flat, own = flat.take(pa.array(kept)), own[kept]
        coded = flat.dictionary_encode()
        words = [" " + w for w in coded.dictionary.to_pylist()]
        wide = np.flatnonzero(spaces > 1)
        runs = [" " * int(spaces[k]) + flat[k].as_py() for k in wide.tolist()]
        new = [w for w in dict.fromkeys([*words, *runs]) if w not in self.ids]
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        first = np.flatnonzero(np.diff(ends // PART, prepend=-1)).tolist()
        for a, b in zip(first, [*first[1:], len(new)][: len(first)], strict=True):
            self.add(new[a:b])
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        ids[wide] = [self.ids[w] for w in runs]
        return ids[full[own]], np.bincount(own, minlength=len(counts)) * full


_lattices: dict = {}


def lattice_of(vocabulary: dict, alpha: float) -> Lattice:
    """The worker process's lattice, kept over its tasks; one at a time."""
    key = (alpha, zlib.crc32("\0".join(vocabulary["pieces"]).encode("utf-8", "surrogatepass")), tuple(vocabulary["scores"][:100]))
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(vocabulary, alpha)
    return _lattices[key]


def sample(texts: pa.Array, keys: np.ndarray, lattice: Lattice, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts in a row, and the offsets of the texts."""
    units, counts = lattice.units(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts, counts)
    base = mix(mix(keys.astype(U) + times(seed))[doc] + number.astype(U) * U(0x9E3779B97F4A7C15))
    first, cum, prev, piece, width = (x.held for x in (lattice.first, lattice.cum, lattice.prev, lattice.piece, lattice.size))
    node, stop = lattice.last.held[units], lattice.begin.held[units]
    live = np.arange(len(units))
    taken, out_size, step = [], np.zeros(len(units), np.int64), 0
    while len(live):
        r = mix(base[live] + times(step + 1)) >> U(11)
        r = (r.astype(np.float64) * 2.0**-53).astype(np.float32)
        edge = first[node[live]]
        more = np.flatnonzero(cum[edge] <= r)
        while len(more):
            edge[more] += 1
            more = more[cum[edge[more]] <= r[more]]
        size = width[edge].astype(np.int64)
        taken.append((live, edge, out_size[live] + size))
        out_size[live] += size
        at = prev[edge]
        node[live] = at
        live = live[at > stop[live]]
        step += 1
    ends = np.cumsum(out_size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for at, edge, after in taken:
        ids = piece[edge]
        place = ends[at] - after
        out[place] = ids
        wide = np.flatnonzero(ids < 0)
        for e, p in zip(edge[wide].tolist(), place[wide].tolist(), strict=True):
            spelt = lattice.spelt[e]
            out[p : p + len(spelt)] = spelt
    per_doc = np.bincount(doc, out_size, len(counts)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(per_doc)])


def piece_bytes(vocabulary: dict) -> list[bytes]:
    out = [p.replace("▁", " ").encode("utf-8", "surrogatepass") for p in vocabulary["pieces"]]
    for value, i in enumerate(vocabulary["bytes"]):
        out[i] = bytes([value])
    return out


def decode_ids(ids: list[int], spell: list[bytes]) -> str:
    """The text of a row's ids; the first space belongs to the encoding."""
    return b"".join(map(spell.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def encode(docs: DataFrame, vocabulary: dict, alpha: float = 0.001, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, n_pieces, lossless, ids) of every whole text; ``lossless`` says that decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        lattice, spell = lattice_of(shared.value, alpha), piece_bytes(shared.value)
        for big in batches:
            for b in slices(big, "text", 1 << 20):
                given = b.column("text").to_pylist()
                texts = [t or "" for t in given]
                ids, offsets = sample(pa.compute.fill_null(b.column("text"), ""), b.column("_k").to_numpy(zero_copy_only=False), lattice, seed)
                flat = ids.tolist()
                same = [decode_ids(flat[x:y], spell) == t for t, x, y in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                if None in given:
                    lists = pa.compute.if_else(b.column("text").is_valid(), lists, pa.scalar(None, lists.type))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(list(map(len, texts)), pa.int64()), pa.array(np.diff(offsets)), pa.array(same), lists], [key, "n_chars", "n_pieces", "lossless", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text", F.xxhash64(F.col(key).cast("string")).alias("_k")).mapInArrow(run, f"{key} {kind}, n_chars long, n_pieces long, lossless boolean, ids array<int>")


def decode(encoded: DataFrame, vocabulary: dict, key: str = "doc_id") -> DataFrame:
    """(key, text) of encoded rows; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        spell = piece_bytes(shared.value)
        for b in batches:
            texts = [None if x is None else decode_ids(x, spell) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def op3_pieces(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    return encode(docs, load(model_file))
