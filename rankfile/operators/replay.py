"""Games to positions, and random openings: the moves are replayed in Arrow batches, a game at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rankfile.functions.board import START, Board, random_opening

MOST_PLIES = 400  # a game of this length was cut by the match runner


def replayed(moves: list[str], start: str = START) -> list[tuple[int, str, bool, bool]]:
    """(ply, fen, in check, game over) after every move; stops at a move that cannot be read."""
    board, out = Board(start), []
    for ply, san in enumerate(moves, 1):
        try:
            board.push(board.find(san))
        except ValueError:
            break
        out.append((ply, board.fen(), board.in_check(), board.over()))
    return out


def positions(games: DataFrame, key: str = "game_idx", most: int = MOST_PLIES) -> DataFrame:
    """Rows of (file, game_idx, headers, moves) as (file, key, ply, fen, key of the position, in_check, game_over, result,
    truncated); a game with a FEN header starts there."""

    def run(batches):
        for b in batches:
            rows = []
            for file, game, headers, moves in zip(*(b.column(c).to_pylist() for c in ("file", key, "headers", "moves")), strict=True):
                headers = dict(headers or [])
                plies = replayed(moves or [], headers.get("FEN", START))
                rows += [(file, game, ply, fen, " ".join(fen.split()[:4]), check, over, headers.get("Result", "*"), len(plies) >= most) for ply, fen, check, over in plies]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_())
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["file", key, "ply", "fen", "key", "in_check", "game_over", "result", "truncated"])

    return games.selectExpr("file", f"cast({key} as bigint) as {key}", "headers", "moves").mapInArrow(run, f"file string, {key} long, ply long, fen string, key string, in_check boolean, game_over boolean, result string, truncated boolean")


def openings(spark: SparkSession, n: int, *, plies: int, seed: int) -> DataFrame:
    """(number, fen) of n random openings, the same for a seed however they are dealt."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([random_opening(plies, seed, k) for k in b.column(0).to_pylist()], pa.string())], ["number", "fen"])

    return spark.range(n).withColumnRenamed("id", "number").mapInArrow(run, "number long, fen string")
