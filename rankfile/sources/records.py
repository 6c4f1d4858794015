"""Fixed-width binary records as a data source: byte-range partitions in, two-phase commit out.

A folder holds ``part-*.rec`` files and a manifest.  Readers take byte ranges cut at record ends, so one large file is read by many
tasks; an incomplete last record is dropped.  Columns that are not asked for are not decoded, conditions on plain columns are applied
before rows are made, and files that the manifest's least and largest values rule out are not opened.  Writers put each task's part
under a hidden name; the commit renames the parts and writes the manifest last, so a reader sees all of a job or nothing; an abort
removes the parts.  The driver sees a message a task, never rows.

Paths are local or shared folders, or whatever pyarrow opens by URI."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

NAME = "rankfile_records"
PART_BYTES = 64 << 20
MANIFEST = "manifest.json"
KINDS = {"i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "f4": "float", "f8": "double"}
TESTS = {"=": np.equal, "<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal}
Layout = dict  # name: (kind, width); width 0 is a plain number, else a list padded with -1


def dtype_of(layout: Layout) -> np.dtype:
    return np.dtype([(n, f"<{k}", (w,)) if w else (n, f"<{k}") for n, (k, w) in layout.items()])


def schema_of(layout: Layout) -> str:
    return ", ".join(f"`{n}` {f'array<{KINDS[k]}>' if w else KINDS[k]}" for n, (k, w) in layout.items())


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def manifest_of(fs: pafs.FileSystem, place: str) -> list[dict]:
    """Files with rows and, where a manifest says so, ranges of values.  A folder without a manifest shows nothing; a single file
    stands for itself."""
    info = fs.get_file_info(place)
    if info.type == pafs.FileType.File:
        return [{"file": place, "bytes": info.size, "ranges": {}}]
    if fs.get_file_info(f"{place}/{MANIFEST}").type != pafs.FileType.File:
        return []
    with fs.open_input_stream(f"{place}/{MANIFEST}") as f:
        return [x | {"file": f"{place}/{x['file']}"} for x in json.loads(f.read())["files"]]


@dataclass
class Range(InputPartition):
    file: str
    first: int  # record of the file
    count: int
    place: int  # record of the table


@dataclass
class Message(WriterCommitMessage):
    task: int
    file: str
    rows: int
    bytes: int
    ranges: dict = field(default_factory=dict)


def may_hold(ranges: dict, where: list) -> bool:
    for name, test, value in where:
        if name in ranges:
            low, high = ranges[name]
            if (test in ("=", "<", "<=") and low > value) or (test in ("=", ">", ">=") and high < value) or (test == "<" and low >= value) or (test == ">" and high <= value):
                return False
    return True


def as_arrow(x: np.ndarray, width: int) -> pa.Array:
    if not width:
        return pa.array(np.ascontiguousarray(x))
    flat = np.ascontiguousarray(x).ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(flat))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], {n: tuple(v) for n, v in json.loads(options["layout"]).items()}
        self.columns = json.loads(options.get("columns", "null")) or list(self.layout)
        self.where, self.size = json.loads(options.get("where", "[]")), int(options.get("partbytes", PART_BYTES))
        self.numbered = options.get("place")

    def partitions(self) -> list[Range]:
        fs, place = opened(self.path)
        width, out, before = dtype_of(self.layout).itemsize, [], 0
        step = max(1, self.size // width)
        for x in manifest_of(fs, place):
            records = x["bytes"] // width
            if may_hold(x["ranges"], self.where):
                out += [Range(x["file"], a, min(step, records - a), before + a) for a in range(0, records, step)]
            before += records
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        kind, (fs, _) = dtype_of(self.layout), opened(self.path)
        with fs.open_input_file(part.file) as f:
            for a in range(part.first, part.first + part.count, 65_536):
                n = min(65_536, part.first + part.count - a)
                rows = np.frombuffer(f.read_at(n * kind.itemsize, a * kind.itemsize), kind)
                keep = np.ones(len(rows), bool)
                for name, test, value in self.where:
                    keep &= TESTS[test](rows[name], value)
                at = np.flatnonzero(keep)
                cols = [as_arrow(rows[c][at], self.layout[c][1]) for c in self.columns]
                names = list(self.columns)
                if self.numbered:
                    cols.append(pa.array(part.place + a - part.first + at))
                    names.append(self.numbered)
                yield pa.RecordBatch.from_arrays(cols, names=names)


def packed(batch: pa.RecordBatch, layout: Layout) -> np.ndarray:
    """The rows of a batch as records: lists are cut or filled with -1, a null list is empty, a null float is not a number, a null
    whole number is refused."""
    out = np.zeros(batch.num_rows, dtype_of(layout))
    for name, (kind, width) in layout.items():
        col = batch.column(batch.schema.get_field_index(name))
        if not width:
            if kind[0] == "i" and col.null_count:
                raise ValueError(f"{name} holds nulls")
            out[name] = col.to_numpy(zero_copy_only=False)
            continue
        out[name] = -1
        sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        fits = at < width
        out[name][row[fits], at[fits]] = col.flatten().to_numpy(zero_copy_only=False)[fits]
    return out


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.layout, self.overwrite = options["path"], {n: tuple(v) for n, v in json.loads(options["layout"]).items()}, overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Message:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, place = opened(self.path)
        fs.create_dir(f"{place}/_{self.job}", recursive=True)
        name = f"{task.partitionId():05d}-{task.taskAttemptId()}"
        rows, size, ranges = 0, 0, {}
        with fs.open_output_stream(f"{place}/_{self.job}/{name}") as f:
            for batch in iterator:
                x = packed(batch, self.layout)
                f.write(x.tobytes())
                rows, size = rows + len(x), size + x.nbytes
                for c, (_, width) in self.layout.items():
                    if not width and len(x):
                        low, high = x[c].min().item(), x[c].max().item()
                        old = ranges.get(c, (low, high))
                        ranges[c] = (min(low, old[0]), max(high, old[1]))
        whole = {c: r for c, r in ranges.items() if r[0] == r[0] and r[1] == r[1]}  # a column with not-a-number has no range
        return Message(task.partitionId(), name, rows, size, whole)

    def commit(self, messages: list[Message | None]) -> None:
        fs, place = opened(self.path)
        old = manifest_of(fs, place) if fs.get_file_info(place).type == pafs.FileType.Directory else []
        kept = [] if self.overwrite else [x | {"file": x["file"].rpartition("/")[2]} for x in old]
        files = []
        for m in sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.task):
            name = f"part-{self.job[:8]}-{m.task:05d}.rec"
            fs.move(f"{place}/_{self.job}/{m.file}", f"{place}/{name}")
            files.append({"file": name, "rows": m.rows, "bytes": m.bytes, "ranges": m.ranges})
        with fs.open_output_stream(f"{place}/_{self.job}/{MANIFEST}") as f:
            f.write(json.dumps({"layout": self.layout, "files": kept + files}).encode())
        fs.move(f"{place}/_{self.job}/{MANIFEST}", f"{place}/{MANIFEST}")  # from here on the job is seen
        fs.delete_dir(f"{place}/_{self.job}")
        if self.overwrite:
            for x in old:
                fs.delete_file(x["file"])

    def abort(self, messages: list[Message | None]) -> None:
        fs, place = opened(self.path)
        if fs.get_file_info(f"{place}/_{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{place}/_{self.job}")


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        layout = {n: tuple(v) for n, v in json.loads(self.options["layout"]).items()}
        columns = json.loads(self.options.get("columns", "null")) or list(layout)
        more = f", `{self.options['place']}` bigint" if self.options.get("place") else ""
        return schema_of({c: layout[c] for c in columns}) + more

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def read(spark: SparkSession, path: str, layout: Layout, *, columns: list[str] | None = None, where: list[tuple] = (), place: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """The records below ``path``: ``columns`` are those wanted, ``where`` conditions (column, one of = < <= > >=, number) that all must
    hold, ``place`` the name of a column with the record's number in the table."""
    spark.dataSource.register(Records)
    r = spark.read.format(NAME).option("layout", json.dumps(layout)).option("where", json.dumps(list(where))).option("partBytes", str(part_bytes))
    r = r.option("columns", json.dumps(columns)) if columns else r
    return (r.option("place", place) if place else r).load(path)


def write(df: DataFrame, path: str, layout: Layout, mode: str = "overwrite") -> None:
    """Columns of the layout as records, a file a partition."""
    df.sparkSession.dataSource.register(Records)
    df.select(*layout).write.format(NAME).option("layout", json.dumps(layout)).mode(mode).save(path)
