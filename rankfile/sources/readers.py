"""Readers that keep file order (shard_id, row_idx) and drop rows of the wrong width; sinks with Spark's commit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the tab-separated files.
LAYOUTS = {
    "positions": "fen string, result string, game_id bigint, truncated int",
    "annotated": "fen string, eval_cp int, bestmove string, wdl_mover double, nodes int",
    "legacy_annotated": "fen string, result string, game_id bigint, truncated int, eval_cp int, is_mate int, bestmove string",
    "legacy_resolved": "fen string, result string, game_id bigint, eval_cp int, is_mate int, bestmove string",
    "failed": "fen string, input_index int, is_force int",
    "worker": "fen string, eval_cp string, bestmove string",
    "eval_set": "fen string, eval_cp int, bestmove string, wdl_mover double, depth int",
}
LOG = r"^(\S+): (?:input)=([\d,]+) (?:written|scritte)=([\d,]+) (?:dup_skipped|duplicati_saltati)=([\d,]+) (?:forced_for_correction|forzate_per_correzione)=([\d,]+) (?:failed|fallite)=([\d,]+)"


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines with (shard_id, row_idx).  One file is one partition range, so the index within it is its order; it rises, and is
    dense within a file that is read by one task."""
    rows = spark.read.text(list(paths)).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(_positions|_annotated)?\.[^.]*$", 1).alias("shard_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return rows.withColumn("row_idx", F.col("_block") * 2**20 + F.col("_id") % 2**33).drop("_block", "_id")


def tsv(spark: SparkSession, layout: str, *paths: str) -> DataFrame:
    """Rows of exactly the layout's width; others are dropped, as are values that do not parse (null)."""
    fields = T._parse_datatype_string(LAYOUTS[layout]).fields
    parts = lines(spark, *paths).withColumn("_p", F.split("value", "\t")).where(F.size("_p") == len(fields))
    return parts.select("shard_id", "row_idx", *(F.expr(f"try_cast(_p[{i}] as {f.dataType.simpleString()})").alias(f.name) for i, f in enumerate(fields)))


def shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Position files below the paths, one row a shard; contents are not read."""
    found = spark.read.format("binaryFile").load(list(paths)).select(F.regexp_extract("path", r"([^/]*)_positions\.[^./]*$", 1).alias("shard_id"), "path", "length")
    return found.where("shard_id <> ''")


def label_path(col) -> tuple[F.Column, F.Column]:
    """(label, path) of ``label=path``, split once: the path may hold the sign too."""
    name = F.split_part(col, F.lit("="), F.lit(1))
    return name, F.substring(col, F.length(name) + 2, F.length(col))


def references(df: DataFrame, text: str, pattern: str, *keep: str) -> DataFrame:
    """(keep, ref): everything that the pattern's first group finds in the text."""
    return df.select(*keep, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("ref"))


def file_counts(spark: SparkSession, layout: str, *paths: str) -> DataFrame:
    """Lines, rows of the layout's width and games of every file."""
    width = len(T._parse_datatype_string(LAYOUTS[layout]).fields)
    place = next((i for i, f in enumerate(T._parse_datatype_string(LAYOUTS[layout]).fields) if f.name == "game_id"), None)
    parts = lines(spark, *paths).withColumn("_p", F.split("value", "\t"))
    whole = F.size("_p") == width
    games = F.count_distinct(F.when(whole, F.expr(f"_p[{place}]"))) if place is not None else F.lit(None).cast("long")
    return parts.groupBy("shard_id").agg(F.count("*").alias("n_lines"), F.count_if(whole).alias("n_rows"), games.alias("n_games"))


def shard_range(listing: DataFrame, generation: int, start: int, end: int) -> DataFrame:
    """Shards of a numbered range that exist in a listing (shard_id)."""
    wanted = listing.sparkSession.range(start, end + 1).select(F.format_string(f"gen{generation}_shard_%05d", "id").alias("shard_id"))
    return wanted.join(listing, "shard_id")


def pending(found: DataFrame, done: DataFrame) -> DataFrame:
    return found.join(done.select("shard_id"), "shard_id", "left_anti")


def quoted_fen(col) -> F.Column:
    return F.split_part(col, F.lit('"'), F.lit(2))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row a manifest; the open part stays as a map of strings."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    return whole.select("file", F.from_json("value", "shard_id string, generation int, games_actual long, positions_extracted long, annotation_n_input long, annotation_n_failed long").alias("m"), F.from_json("value", "map<string,string>").alias("every")).select("file", "m.*", "every")


def manifest_gate(rows: DataFrame, *, max_rate: float) -> DataFrame:
    """Refuses (accepted false) when a manifest lacks counts or the failure rate is above the limit."""
    out = rows.agg(F.count_if(F.col("annotation_n_failed").isNull() | F.col("annotation_n_input").isNull()).alias("lacking"), F.sum("annotation_n_failed").alias("failed"), F.sum("annotation_n_input").alias("asked"))
    return out.withColumn("accepted", (F.col("lacking") == 0) & F.coalesce(F.col("failed") <= max_rate * F.col("asked"), F.lit(False)))


def patched(rows: DataFrame, counts: DataFrame, key: str = "shard_id", *, commit: str | None = None, machine: str = "") -> DataFrame:
    """Manifest maps with counts added under the prefix ``annotation_``; with a ``commit``, also who annotated, and a note where the
    games' commit and this one are both known and differ."""
    names = [c for c in counts.columns if c != key]
    more = F.map_from_arrays(F.array(*(F.lit(f"annotation_{n}") for n in names)), F.array(*(F.col(n).cast("string") for n in names)))
    out = rows.join(counts, key).withColumn("every", F.map_concat("every", more)).drop(*names)
    if commit is None:
        return out
    games = F.coalesce(F.col("every")["engine_commit"], F.lit("UNKNOWN"))
    who = F.create_map(F.lit("annotation_engine_commit"), F.lit(commit), F.lit("annotation_machine"), F.lit(machine))
    note = F.create_map(F.lit("commit_mismatch_note"), F.concat(F.lit("games by commit "), games, F.lit(f", labels by commit {commit} on {machine}")))
    differ = (games != "UNKNOWN") & F.lit(commit != "UNKNOWN") & (games != commit)
    return out.withColumn("every", F.when(differ, F.map_concat("every", who, note)).otherwise(F.map_concat("every", who)))


def annotator_log(rows: DataFrame, col: str = "value") -> DataFrame:
    """Counts of log lines in either language; thousands separators are removed."""
    number = lambda i: F.replace(F.regexp_extract(col, LOG, i), F.lit(","), F.lit("")).cast("long")
    return rows.where(F.col(col).rlike(LOG)).select(F.regexp_extract(col, LOG, 1).alias("shard"), *(number(i + 2).alias(n) for i, n in enumerate(("n_input", "n_written", "n_dup", "n_force", "n_failed"))))


def union_eval(col) -> tuple[F.Column, F.Column]:
    """(centipawns, mate) of a value that is a number or M<n> / -M<n>."""
    mate = col.rlike("^-?M")
    return F.when(~mate, col.try_cast("double").cast("int")), F.when(mate, F.replace(col, F.lit("M"), F.lit("")).try_cast("int"))


def games(spark: SparkSession, *paths: str) -> DataFrame:
    """PGN games: (file, game_idx, headers, moves); comments, variations, numbers and results are left out of the main line.  Files
    are split at the event tags, so a task reads a part of a large one; ``game_idx`` rises along a file."""
    begin = "[Event "
    rows = spark.read.option("lineSep", f"\n{begin}").text(list(paths))
    rows = rows.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.when(F.startswith("value", F.lit(begin)), F.col("value")).otherwise(F.concat(F.lit(begin), F.col("value"))).alias("game"))
    whole = rows.where("trim(game) <> '[Event'").select("file", (F.col("_block") * 2**20 + F.col("_id") % 2**33).alias("game_idx"), "game")

    def main_line(text: str) -> list[str]:
        out, depth = [], 0
        for token in re.findall(r"\{[^}]*\}|;[^\n]*|[()]|[^\s(){};]+", text):
            if token[0] in "{;":
                continue
            depth += (token == "(") - (token == ")")
            if depth == 0 and token not in "()" and not re.fullmatch(r"\d+\.*|\$\d+|1-0|0-1|1/2-1/2|\*", token):
                out.append(re.sub(r"^\d+\.+", "", token).rstrip("!?"))
        return [m for m in out if m]

    def run(batches):
        for pdf in batches:
            pdf["headers"] = pdf["game"].map(lambda g: dict(re.findall(r'^\[(\w+) "([^"]*)"\]', g, re.M)))
            pdf["moves"] = pdf["game"].map(lambda g: main_line(re.sub(r"(?m)^\[.*\]\s*$", "", g)))
            yield pdf[["file", "game_idx", "headers", "moves"]]

    return whole.mapInPandas(run, "file string, game_idx long, headers map<string,string>, moves array<string>")


def records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Fixed-length records of binary files; an incomplete last record is dropped."""
    b = spark.read.format("binaryFile").load(path)
    return b.select("path", F.posexplode(F.expr(f"transform(sequence(0, greatest(length(content) div {width}, 1) - 1), i -> substring(content, cast(i * {width} + 1 as int), {width}))")).alias("idx", "record")).where(F.length("record") == width)


def digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_tsv(df: DataFrame, path: str, *columns: str) -> None:
    """Tab-separated text with LF ends; files appear when the job commits."""
    df.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in columns))).write.mode("overwrite").option("lineSep", "\n").text(path)


def tensors(content: bytes, shapes: dict[str, tuple[int, ...]]) -> dict:
    """Named float32 tensors laid one after the other in a file."""
    import numpy as np

    out, at = {}, 0
    for name, shape in shapes.items():
        n = int(np.prod(shape))
        out[name] = np.frombuffer(content, "<f4", n, at).reshape(shape)
        at += 4 * n
    return out


def write_npy(df: DataFrame, path: str, arrays: dict[str, tuple[str, int]]) -> int:
    """Columns as ``path.<name>.npy`` on the driver's disk, row by row in the order of the DataFrame's partitions; gives the rows.
    ``arrays`` has the kind (as numpy names it) and width of each: lists are cut or filled with -1, width 0 is a plain number.
    Partitions are packed on the executors and come one at a time, so the driver holds a block, never the table."""
    import numpy as np
    import pyarrow as pa

    names = list(arrays)

    def run(batches):
        for b in batches:
            packed = []
            for name in names:
                kind, width = arrays[name]
                col = b.column(name)
                if not width:
                    packed.append(col.to_numpy(zero_copy_only=False).astype(kind).tobytes())
                    continue
                out = np.full((len(col), width), -1, kind)
                sizes = np.minimum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), width)
                for k, (n, x) in enumerate(zip(sizes.tolist(), col.to_pylist(), strict=True)):
                    if n:
                        out[k, :n] = x[:n]
                packed.append(out.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)], ["_rows", *names])

    rows, files = 0, {n: open(f"{path}.{n}.npy.tmp", "wb") for n in names}  # noqa: SIM115
    head = 128  # room for the header, which holds the number of rows
    for f in files.values():
        f.write(bytes(head))
    for r in df.select(*names).mapInArrow(run, ", ".join(["_rows long", *(f"`{n}` binary" for n in names)])).toLocalIterator():
        rows += r["_rows"]
        for n, f in files.items():
            f.write(r[n])
    import os

    for n, f in files.items():
        kind, width = arrays[n]
        text = repr({"descr": np.dtype(kind).str, "fortran_order": False, "shape": (rows, width) if width else (rows,)})
        f.seek(0)
        f.write(b"\x93NUMPY\x01\x00" + (head - 10).to_bytes(2, "little") + text.ljust(head - 11).encode() + b"\n")
        f.close()
        os.replace(f.name, f.name.removesuffix(".tmp"))
    return rows


def write_composition(df: DataFrame, path: str, *by: str) -> None:
    """Counts of a dataset as one JSON object: totals and a list by shard."""
    each = df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("game_id").alias("games"))
    one = each.agg(F.sum("rows").alias("rows"), F.sum("games").alias("games"), F.count("*").alias("shards"), F.array_sort(F.collect_list(F.struct(*by, "rows", "games"))).alias("details"))
    one.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
