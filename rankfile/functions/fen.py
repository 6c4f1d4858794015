"""FEN functions as Column expressions.  Scalars are built-in functions, so they stay in generated code and below pushed filters;
lists of features, which built-in functions would work out element by element outside of it, come from one Arrow pass in numpy
over the 64-character board."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# King bucket by oriented king square (only files a to d are reached), piece letters in type order, piece values.
KING_BUCKETS = [
    0, 0, 1, 1, 5, 5, 4, 4,
    2, 2, 2, 2, 6, 6, 6, 6,
    3, 3, 3, 3, 7, 7, 7, 7,
    3, 3, 3, 3, 7, 7, 7, 7,
    3, 3, 3, 3, 7, 7, 7, 7,
    3, 3, 3, 3, 7, 7, 7, 7,
    3, 3, 3, 3, 7, 7, 7, 7,
    3, 3, 3, 3, 7, 7, 7, 7,
]
PIECES = "PNBRQK"
VALUES = {"P": 100, "N": 320, "B": 330, "R": 500, "Q": 900}
MAX_ACTIVE = 32


def field(fen: Column, n: int) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(n))


def dedup_key(fen: Column) -> Column:
    """Identity of a position: the first four fields."""
    return F.substring_index(fen, " ", 4)


def key_hash(fen: Column) -> Column:
    """A 64-bit digest of the key as 8 bytes; only a compact form, never the identity."""
    return F.unhex(F.substring(F.sha2(dedup_key(fen), 256), 1, 16))


def key_hash_blake(fen: Column) -> Column:
    """The 8-byte digest of the key that published state files hold (BLAKE2b, read big-endian); from Python, since no built-in
    function gives it."""

    @F.arrow_udf("binary")
    def digest(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else hashlib.blake2b(k.encode(), digest_size=8).digest() for k in keys.to_pylist()], pa.binary())

    return digest(dedup_key(fen))


def piece_count(fen: Column) -> Column:
    return F.length(F.regexp_replace(field(fen, 1), "[^A-Za-z]", ""))


def phase_bucket(pieces: Column) -> Column:
    return F.when(pieces <= 8, "<=8").when(pieces <= 12, "9-12").when(pieces <= 20, "13-20").otherwise("21-32")


def white_to_move(fen: Column) -> Column:
    return field(fen, 2) == "w"


def occurrences(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def material_white(fen: Column) -> Column:
    """White's material less black's."""
    board, total = field(fen, 1), F.lit(0)
    for p, v in VALUES.items():
        total = total + (occurrences(board, p) - occurrences(board, p.lower())) * v
    return total


def material_mover(fen: Column) -> Column:
    return F.when(white_to_move(fen), material_white(fen)).otherwise(-material_white(fen))


def board64(fen: Column) -> Column:
    """64 characters from a8 to h1; a dot is an empty square."""
    out = F.replace(field(fen, 1), F.lit("/"), F.lit(""))
    for n in range(8, 0, -1):
        out = F.replace(out, F.lit(str(n)), F.lit("." * n))
    return out


def at_square(board: Column, sq: Column) -> Column:
    """The character on square ``sq`` (a1 is 0, h8 is 63)."""
    return F.substring(board, (7 - F.floor(sq / 8).cast("int")) * 8 + sq.cast("int") % 8 + 1, F.lit(1))


def mirror_key(fen: Column) -> Column:
    """The smaller of board and file-mirrored board, with the side to move."""
    mirrored = lambda b: F.concat(*(F.reverse(F.substring(b, 8 * r + 1, 8)) for r in range(8)))
    return F.concat(bound(board64(fen), lambda b: F.least(b, mirrored(b))), F.lit(" "), field(fen, 2))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, where a lambda would compute the expression again for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def on_board(b: Column) -> Column:
    squares = F.transform(F.split(b, ""), lambda c, i: F.struct(c.alias("c"), ((7 - F.floor(i / 8).cast("int")) * 8 + i % 8).alias("sq")))
    return F.transform(F.filter(squares, lambda x: (x["c"] != ".") & (x["c"] != "")), lambda x: F.struct((F.upper(x["c"]) == x["c"]).alias("white"), (F.instr(F.lit(PIECES), F.upper(x["c"])) - 1).alias("type"), x["sq"].alias("sq")))


def pieces(fen: Column) -> Column:
    """Array of (white, type, sq) in the order of the FEN."""
    return bound(board64(fen), on_board)


PIECE_TYPE = np.full(256, -1, np.int64)
for _k, _c in enumerate(PIECES):
    PIECE_TYPE[ord(_c)] = PIECE_TYPE[ord(_c.lower())] = _k
BUCKETS = np.array(KING_BUCKETS, np.int64)


def active(boards: pa.Array, black: bool, bucketed: bool) -> pa.Array:
    """Sorted active features of each board from one side; null without a board of 64 squares that holds that side's king."""
    n = len(boards)
    size = pc.fill_null(pc.binary_length(boards), 0).to_numpy(zero_copy_only=False)
    squares = np.full((n, 64), ord("."), np.uint8)
    whole = np.flatnonzero(size == 64)
    if len(whole):
        squares[whole] = np.frombuffer(b"".join(boards.cast(pa.binary()).take(pa.array(whole)).to_pylist()), np.uint8).reshape(-1, 64)
    is_king = squares == ord("k" if black else "K")
    at = is_king.argmax(axis=1)
    known = is_king[np.arange(n), at]
    king = (7 - at // 8) * 8 + at % 8
    right = king % 8 > 3
    turn = np.where(right if bucketed else ~right, 7, 0) ^ (56 if black else 0)
    base = 768 * BUCKETS[king ^ turn] if bucketed else np.zeros(n, np.int64)
    row, i = np.nonzero((PIECE_TYPE[squares] >= 0) & known[:, None])
    piece = squares[row, i]
    own = (piece >= ord("a")) == black
    value = base[row] + np.where(own, 0, 384) + 64 * PIECE_TYPE[piece] + (((7 - i // 8) * 8 + i % 8) ^ turn[row])
    value = value[np.argsort(row * 8192 + value, kind="stable")]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(value), mask=pa.array(~known))


def _view(black: bool, bucketed: bool):
    @F.arrow_udf("array<long>")
    def view(boards: pa.Array) -> pa.Array:
        return active(boards, black, bucketed)

    return view


def features(fen: Column, black: bool) -> Column:
    """Sorted active features seen from one side: 768 * bucket + (own 0, other 384) + 64 * type + oriented square."""
    return _view(black, True)(board64(fen))


def features_plain(fen: Column, black: bool) -> Column:
    """The layout without king buckets: mirrored when the king is on files a to d."""
    return _view(black, False)(board64(fen))


def normalised(fen: Column) -> Column:
    """The FEN as its mover sees it: with black to move, ranks turned and colours swapped."""
    board = field(fen, 1)
    turned = F.translate(F.array_join(F.reverse(F.split(board, "/")), "/"), "PNBRQKpnbrqk", "pnbrqkPNBRQK")
    return F.concat(F.when(white_to_move(fen), board).otherwise(turned), F.lit(" w - - 0 1"))


def bucket_table(half: list[int], fold: list[int]) -> list[int]:
    """64 buckets from 32 by folding the files."""
    return [half[4 * rank + fold[file]] for rank in range(8) for file in range(8)]


def us_them(fen: Column) -> tuple[Column, Column]:
    w, b = features(fen, False), features(fen, True)
    white = white_to_move(fen)
    return F.when(white, w).otherwise(b), F.when(white, b).otherwise(w)


def padded(a: Column, n: int = MAX_ACTIVE) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(-1), n)), 1, n)


def unpadded(a: Column) -> Column:
    return F.filter(a, lambda x: x >= 0)


def captures(boards: pa.Array, moves: pa.Array, passing: pa.Array, white: pa.Array) -> pa.Array:
    """Whether each move's target holds an enemy piece, or a pawn goes to the en-passant square; null without a whole board and move."""
    n = len(boards)
    size = pc.fill_null(pc.binary_length(boards), 0).to_numpy(zero_copy_only=False)
    length = pc.fill_null(pc.binary_length(moves), 0).to_numpy(zero_copy_only=False)
    out, at = np.zeros(n, bool), np.flatnonzero((size == 64) & (length >= 4))
    if len(at):
        some = pa.array(at)
        board = np.frombuffer(b"".join(boards.cast(pa.binary()).take(some).to_pylist()), np.uint8).reshape(-1, 64)
        move = np.frombuffer(b"".join(m[:4] for m in moves.cast(pa.binary()).take(some).to_pylist()), np.uint8).reshape(-1, 4).astype(int)
        place = lambda f, r: ((56 - r) * 8 + f - 97).clip(0, 63)
        target, mover = (np.take_along_axis(board, place(move[:, k], move[:, k + 1])[:, None], 1)[:, 0] for k in (2, 0))
        mine = pc.fill_null(white, False).to_numpy(zero_copy_only=False)[at]
        enemy = (target != ord(".")) & ((target >= ord("a")) == mine)
        to = pc.fill_null(pc.equal(pc.utf8_slice_codeunits(moves, 2, 4), passing), False).to_numpy(zero_copy_only=False)[at]
        out[at] = enemy | (((mover == ord("P")) | (mover == ord("p"))) & to)
    known = np.zeros(n, bool)
    known[at] = True
    return pa.array(out, mask=~known)


def is_capture(fen: Column, move: Column) -> Column:
    """The target holds an enemy piece, or a pawn goes to the en-passant square."""

    @F.arrow_udf("boolean")
    def taken(boards: pa.Array, moves: pa.Array, passing: pa.Array, white: pa.Array) -> pa.Array:
        return captures(boards, moves, passing, white)

    return taken(board64(fen), move, field(fen, 4), white_to_move(fen))


def move_class(fen: Column, move: Column) -> Column:
    """Diagnostic convention: promotion first."""
    return F.when(F.length(move) == 5, "promotion").when(is_capture(fen, move), "capture").otherwise("quiet")


def move_class_census(fen: Column, move: Column) -> Column:
    """Census convention: capture first."""
    return F.when(is_capture(fen, move), "capture").when(F.length(move) == 5, "promotion").otherwise("quiet")


def shard_id(generation: int, n: Column) -> Column:
    return F.concat(F.lit(f"gen{generation}_shard_"), F.lpad(n.cast("string"), 5, "0"))


def qualified_game(shard: Column, game: Column) -> Column:
    return F.concat_ws("_", shard, game.cast("string"))
