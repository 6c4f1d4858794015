"""Labels of positions by an outside engine, or by a stand-in with the same interface.

A labeller is made once for each partition by ``make()`` on the executor, asked for every row, and closed at the end; a row it fails
on gives no evaluation and no move (``NONE`` in files), and the others go on.  Nothing is shared between tasks, so a lost executor
only has its partitions labelled again."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from contextlib import closing
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankfile.functions.board import Board, named

MATE_CP = 15_000


class Found(NamedTuple):
    kind: str  # cp or mate, seen by the side to move
    score: int
    depth: int
    nodes: int
    move: str


class Uci:
    """An engine that speaks the common text protocol, one process."""

    def __init__(self, command: list[str], *, nodes: int | None = None, depth: int | None = None, options: dict[str, str] | None = None):
        self.limit = f"nodes {nodes}" if nodes else f"depth {depth or 1}"
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1, encoding="utf-8", errors="replace")
        self.say("uci")
        self.until("uciok")
        for name, value in {"Threads": "1", **(options or {})}.items():
            self.say(f"setoption name {name} value {value}")
        self.say("isready")
        self.until("readyok")

    def say(self, text: str) -> None:
        self.process.stdin.write(text + "\n")
        self.process.stdin.flush()

    def until(self, begin: str) -> list[str]:
        out = []
        for line in self.process.stdout:
            out.append(line.strip())
            if out[-1].startswith(begin):
                return out
        raise RuntimeError(f"the engine ended before {begin}")

    def search(self, fen: str) -> Found:
        """The last line of information counts."""
        self.say("ucinewgame")
        self.say(f"position fen {fen}")
        self.say(f"go {self.limit}")
        lines = self.until("bestmove")
        found = Found("", 0, 0, 0, lines[-1].split()[1])
        for words in (x.split() for x in lines if x.startswith("info depth") and " score " in x):
            value = lambda name, words=words: int(words[words.index(name) + 1]) if name in words else 0
            at = words.index("score")
            found = Found(words[at + 1], int(words[at + 2]), value("depth"), value("nodes"), found.move)
        if not found.kind:
            raise ValueError("no score")
        return found

    def static(self, fen: str) -> float:
        self.say(f"position fen {fen}")
        self.say("eval")
        return float(self.until("Evaluation:")[-1].split()[1])

    def close(self) -> None:
        try:
            self.say("quit")
        except OSError:
            pass
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()


MOST_STARTS = 20


class StandIn:
    """A deterministic labeller without a process: material seen by the mover, and the first legal move that wins most of it."""

    VALUES = {"P": 100, "N": 320, "B": 330, "R": 500, "Q": 900}  # noqa: RUF012

    def __init__(self, scale: float = 1.0):
        self.scale = scale

    def worth(self, piece: str) -> int:
        return self.VALUES.get(piece.upper(), 0) * (1 if piece.isupper() else -1)

    def static(self, fen: str) -> float:
        return self.scale * sum(map(self.worth, Board(fen).at))

    def search(self, fen: str) -> Found:
        board = Board(fen)
        moves = board.moves()
        if not moves:
            raise ValueError("the game is over")
        s, t, promotion = max(moves, key=lambda m: (abs(self.worth(board.at[m[1]])), -m[0], -m[1], m[2]))
        mover = 1 if board.white else -1
        return Found("cp", round(self.scale * mover * sum(map(self.worth, board.at))), 1, len(moves), named(s) + named(t) + promotion.lower())

    def close(self) -> None:
        pass


def labelled(rows: DataFrame, make: Callable[[], object], *, fen: str = "fen") -> DataFrame:
    """The rows with kind, score, depth, nodes and bestmove, and eval_cp: the score in centipawns, a mate as +-15,000; all null
    where the labeller fails.  A labeller that does not start, or ends again and again without a label, stops the job after
    ``MOST_STARTS`` starts rather than leave a table of nulls."""
    added = "kind string, score int, depth int, nodes long, bestmove string, eval_cp int"

    def run(batches: Iterator[pa.RecordBatch]):
        labeller, starts = None, 0  # starts since the last label
        try:
            for b in batches:
                out = []
                for f in b.column(fen).to_pylist():
                    if labeller is None and starts >= MOST_STARTS:
                        raise RuntimeError(f"the labeller gave nothing after {starts} starts")
                    try:
                        if labeller is None:
                            starts += 1
                            labeller = make()
                        x = labeller.search(f)
                        starts = 0
                        out.append((*x, x.score if x.kind == "cp" else MATE_CP if x.score > 0 else -MATE_CP))
                    except Exception:  # noqa: BLE001  whatever the engine does, the row has no label and the others go on
                        out.append((None,) * 6)
                        if labeller is not None and getattr(getattr(labeller, "process", None), "poll", lambda: None)() is not None:
                            labeller = None  # the process ended: the next row gets a new one
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32())
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*b.schema.names, *(x.split()[0] for x in added.split(", "))])
        finally:
            if labeller is not None:
                labeller.close()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {added}")


def static_scores(rows: DataFrame, make: Callable[[], object], out: str, *, fen: str = "fen") -> DataFrame:
    """The rows with a static evaluation (null where it fails)."""

    def run(batches):
        with closing(make()) as labeller:

            def one(f):
                try:
                    return float(labeller.static(f))
                except Exception:  # noqa: BLE001
                    return None

            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(f) for f in b.column(fen).to_pylist()], pa.float64())], [*b.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{out}` double")


def quick_eval(found: Found) -> int:
    """The opening filter's value: a mate counts 10,000 whoever gives it."""
    return found.score if found.kind == "cp" else 10_000


def identity_gate(rows: DataFrame, one: Callable[[], object], two: Callable[[], object], *, order: str, first: int = 20) -> DataFrame:
    """One row: the first positions of an order, how many of them the labellers tell apart, and whether that is all of them."""
    some = rows.orderBy(order).limit(first)
    both = static_scores(static_scores(some, one, "_one"), two, "_two")
    out = both.agg(F.count("*").alias("n"), F.count_if(~F.col("_one").eqNullSafe(F.col("_two"))).alias("differ"))
    return out.withColumn("accepted", (F.col("n") > 0) & (F.col("differ") == F.col("n")))


def refuse_unless(gate: DataFrame) -> None:
    row = gate.first()
    if not row["accepted"]:
        raise ValueError(f"gate failed: {row.asDict()}")


def probe(make_on: Callable[[], object], make_off: Callable[[], object], fen: str) -> None:
    """Refuses to start when an option that should matter changes nothing."""
    with closing(make_on()) as on, closing(make_off()) as off:
        if on.search(fen) == off.search(fen):
            raise ValueError("the option changes nothing")
