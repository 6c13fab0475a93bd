"""Transcript files as tables: JSON lines with their line numbers, dialect sniffing, bounded tail reads."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLAUDE, PI, OPENHANDS = "claude_code", "pi", "openhands"
LINE = "file_path string, line_no long, offset long, raw string"
CHUNK = 32 << 20  #: bytes of a file read by one task


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, line_no, raw) of text files, gzip included; line numbers count from 1 within each file.

    A file is one record of the scan, so use ``read_ranges`` for files beyond a few hundred MB.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), "value")
    return files.select("file_path", F.posexplode(F.split("value", "\n")).alias("at", "raw")).select("file_path", (F.col("at") + 1).cast("long").alias("line_no"), "raw")


def read_ranges(spark: SparkSession, paths: list[str], chunk: int = CHUNK) -> DataFrame:
    """(file_path, offset, line_no, raw) of uncompressed files on a shared file system, read by byte ranges.

    A task owns the lines that begin in its range and reads on to the end of the last one; line numbers are
    stitched from the ranges' line counts by prefix sums, so no file is read as a whole.
    """
    import os

    parts = [(p, a) for p in paths for a in range(0, max(os.path.getsize(p), 1), chunk)]
    plan = spark.createDataFrame(parts or [("", 0)], "file_path string, begin long").filter("file_path <> ''").repartition(max(len(parts), 1), "file_path", "begin")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, begin in zip(b["file_path"], b["begin"]):
                rows = []
                with open(path, "rb") as f:
                    if begin:
                        f.seek(begin - 1)
                        f.readline()  # the line that began before
                    while f.tell() < begin + chunk:
                        at = f.tell()
                        line = f.readline()
                        if not line:
                            break
                        rows.append((path, begin, at, len(rows) + 1, line.rstrip(b"\n").decode("utf-8", "replace")))
                yield pd.DataFrame(rows, columns=["file_path", "begin", "offset", "local", "raw"])

    lines = plan.mapInPandas(run, "file_path string, begin long, offset long, local long, raw string")
    counts = lines.groupBy("file_path", "begin").agg(F.max("local").alias("n"))
    before = counts.select("file_path", "begin", F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return lines.join(before, ["file_path", "begin"]).select("file_path", "offset", (F.col("before") + F.col("local")).alias("line_no"), "raw")


def parse(lines: DataFrame) -> DataFrame:
    """Adds ``row`` (variant): the JSON object of a line; other lines are dropped."""
    return lines.withColumn("row", F.try_parse_json(F.ltrim(F.regexp_replace("raw", "^\ufeff", "")))).filter("row is not null and schema_of_variant(row) like 'OBJECT%'")


def dialect(first: str | None) -> str:
    """Dialect of a file by its first non-empty line; unreadable ones count as the first dialect."""
    try:
        row = json.loads(first or "")
    except ValueError:
        return CLAUDE
    if not isinstance(row, dict):
        return CLAUDE
    if row.get("type") == "session" and "version" in row:
        return PI
    if any(k.endswith("_format") and row[k] == OPENHANDS for k in row) or ("role" in row and "type" not in row):
        return OPENHANDS
    return CLAUDE


def sniff(lines: DataFrame) -> DataFrame:
    """(file_path, dialect)."""
    first = lines.filter(F.trim("raw") != "").groupBy("file_path").agg(F.min(F.struct("line_no", "raw")).alias("f"))
    return first.mapInPandas(lambda it: (b[["file_path"]].assign(dialect=[dialect(f["raw"]) for f in b["f"]]) for b in it), "file_path string, dialect string")


def tail(lines: DataFrame, max_bytes: int) -> DataFrame:
    """The last lines of each file that lie whole within its last ``max_bytes`` bytes (line ends counted)."""
    w = Window.partitionBy("file_path").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("behind", F.sum(F.octet_length("raw") + 1).over(w)).filter(F.col("behind") <= max_bytes).drop("behind")


def messages_to_rows(trajectories: DataFrame, key: str = "trajectory_id", column: str = "trajectory") -> DataFrame:
    """An array column of messages as rows with positional ids (m0001 ...)."""
    return trajectories.select(key, F.posexplode(column).alias("at", "m")).select(key, (F.col("at") + 1).cast("long").alias("row_no"), F.format_string("m%04d", F.col("at") + 1).alias("id"), "m.*")
