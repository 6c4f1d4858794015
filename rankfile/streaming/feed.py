"""Shards as a stream: numbered position files, handed out in order, each once both of its files exist.

The source's offset is (shard, byte): everything up to that byte of that shard, and all shards before, has been handed out.  A shard
whose second file is missing holds back those behind it, so that numbers never go back.  A batch's shards are read in byte ranges cut
at line ends.  Files are written once under their names (``write_shard_files`` renames them when they are whole)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from rankfile.sources.records import opened

NAME = "rankfile_shards"
FIRST, SECOND = "positions", "annotated"
SCHEMA = "shard bigint, byte bigint, value string"


def file_name(shard: int, kind: str) -> str:
    return f"{shard:05d}_{kind}.tsv"


@dataclass
class Piece(InputPartition):
    shard: int
    first: int
    last: int


class ShardReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.begin, self.size = options["path"], int(options.get("first", 1)), int(options.get("partbytes", 32 << 20))
        self.known = self.begin - 1

    def bytes_of(self, shard: int, kind: str) -> int | None:
        fs, place = opened(self.path)
        info = fs.get_file_info(f"{place}/{file_name(shard, kind)}")
        return info.size if info.type == pafs.FileType.File else None

    def initialOffset(self) -> dict:
        return {"shard": self.begin - 1, "byte": 0}

    def latestOffset(self) -> dict:
        while self.bytes_of(self.known + 1, FIRST) is not None and self.bytes_of(self.known + 1, SECOND) is not None:
            self.known += 1
        return {"shard": self.known, "byte": self.bytes_of(self.known, FIRST) or 0}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = max(self.known, end["shard"])
        out = []
        for shard in range(start["shard"], end["shard"] + 1):
            low = start["byte"] if shard == start["shard"] else 0
            high = end["byte"] if shard == end["shard"] else self.bytes_of(shard, FIRST) or 0
            out += [Piece(shard, a, min(a + self.size, high)) for a in range(low, high, self.size)]
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the piece."""
        fs, place = opened(self.path)
        with fs.open_input_file(f"{place}/{file_name(piece.shard, FIRST)}") as f:
            at, total = piece.first, f.size()
            if at:  # a line that began before belongs to the piece before
                at = self.line_end(f, at - 1, total)
            while at < piece.last:
                stop = self.line_end(f, min(at + (4 << 20), piece.last) - 1, total)
                data = f.read_at(stop - at, at)
                lines = data.split(b"\n")
                if lines[-1] == b"":
                    lines.pop()
                starts, place_ = [], at
                for x in lines:
                    starts.append(place_)
                    place_ += len(x) + 1
                yield pa.RecordBatch.from_arrays([pa.array([piece.shard] * len(lines), pa.int64()), pa.array(starts, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())], ["shard", "byte", "value"])
                at = stop

    @staticmethod
    def line_end(f, at: int, total: int) -> int:
        """The place after the line that holds the byte ``at``."""
        while at < total:
            data = f.read_at(min(65_536, total - at), at)
            found = data.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(data)
        return total


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ShardReader:
        return ShardReader(dict(self.options))


def shard_stream(spark: SparkSession, path: str, *, first: int = 1, part_bytes: int = 32 << 20) -> DataFrame:
    """A stream (shard, byte, value): the lines of the shards below ``path``, with the byte where each begins."""
    spark.dataSource.register(Shards)
    return spark.readStream.format(NAME).option("first", str(first)).option("partBytes", str(part_bytes)).load(path)


def write_shard_files(rows: DataFrame, path: str, kind: str, shard: str = "shard", value: str = "value", order: str = "row") -> DataFrame:
    """Writes a file for each shard number, lines in order, and gives (shard, n).  A file gets its name when it is whole, so a task that
    runs again replaces what it wrote."""

    def run(batches):
        fs, place = opened(path)
        fs.create_dir(place, recursive=True)
        now, out, n, done = None, None, 0, []

        def close():
            if out is not None:
                out.close()
                fs.move(hidden, f"{place}/{file_name(now, kind)}")
                done.append((now, n))

        hidden = ""
        for pdf in batches:
            for s, some in pdf.groupby(shard, sort=False):
                if s != now:
                    close()
                    now, n, hidden = int(s), 0, f"{place}/.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(hidden)
                out.write("".join(f"{v}\n" for v in some[value]).encode())
                n += len(some)
        close()
        yield pd.DataFrame(done, columns=["shard", "n"])

    return rows.repartition(shard).sortWithinPartitions(shard, order).select(shard, value).mapInPandas(run, "shard long, n long")


def claimed_number(spark: SparkSession, folder: str) -> int:
    """The next shard number: a file of that name is created, which only one process can do, so no number is given twice, over restarts
    too."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    n = 1 + max((int(x) for x in names if x.isdigit()), default=0)
    while not fs.createNewFile(jvm.org.apache.hadoop.fs.Path(place, str(n))):
        n += 1
    return n


def parsed_offset(text: str) -> tuple[int, int]:
    x = json.loads(text)
    return x["shard"], x["byte"]
