"""Splitting oversized items at natural boundaries, range by range.

A long text is cut into ranges with halos. The worker of a range finds the boundaries in it, and settles the two
anchors at its ends from the halos alone, so neighbours agree on them without talking; between the anchors it
plans pieces under the limit. The boundary tables of the ranges are stitched by prefix sums of their piece
counts, and every piece is emitted by offset. ``split_files`` does so over byte ranges of files that no worker reads as a
whole; ``split_oversized`` over texts in rows, where the scan has loaded a text already and passes on its ranges only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 1024  #: tokens of a piece, at 4 code points each
OVERLAP = 64  #: tokens that neighbours share
PER_TOKEN = 4
RANGE = 65_536  #: code points planned by one row
HALO = 2_048

# a cut is after the match; stronger kinds first
_PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
_LINE = re.compile(r"\r?\n")
_SENTENCE = re.compile(r"[.!?…]['\")\]]*\s+|[。！？]")
_WORD = re.compile(r"\s+")
KINDS = (("paragraph", _PARAGRAPH), ("line", _LINE), ("sentence", _SENTENCE), ("word", _WORD))

PIECES = "range_no int, start long, stop long, boundary string, text string"


def last_cut(text: str, low: int, high: int) -> tuple[int, str]:
    """Best cut in (low, high]: the last one of the strongest kind; ``high`` itself where there is none."""
    for kind, rx in KINDS:
        at = -1
        for m in rx.finditer(text, low, min(len(text), high + 8)):
            if low < m.end() <= high:
                at = m.end()
        if at > 0:
            return at, kind
    at = high
    while at > low + 1 and at < len(text) and (0xDC00 <= ord(text[at]) <= 0xDFFF or text[at] in "‍️"):
        at -= 1
    return at, "none"


def plan(text: str, first: int, stop: int, floor: int, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """Pieces covering text[first:stop]; each but the outermost begins about ``overlap`` before its neighbour's end.

    ``floor``: no piece may begin before it. Piece lengths are at most ``limit``.
    """
    out = []
    begin, done = first, first
    if first > floor:
        begin = _back(text, max(floor, first - overlap), first)
    while done < stop:
        if stop - begin <= limit:
            out.append((begin, stop, "end"))
            break
        high = begin + limit
        end, kind = last_cut(text, max(done, begin + limit // 2), high)
        out.append((begin, end, kind))
        done = end
        begin = _back(text, end - overlap, end)
    return out


def _back(text: str, low: int, end: int) -> int:
    """Begin of an overlap: the first word begin at or after ``low``."""
    m = _WORD.search(text, max(low - 1, 0), end)
    return m.end() if m and m.end() < end else low


def _plan_ranges(keys: list[str], limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec in b.itertuples(index=False):
                base, total, text = rec.base, rec.total, rec.slice
                low, high = rec.range_no * RANGE, min((rec.range_no + 1) * RANGE, total)
                first = 0 if low == 0 else base + last_cut(text, low - HALO // 2 - base, low - base)[0]
                stop = total if high == total else base + last_cut(text, high - HALO // 2 - base, high - base)[0]
                for s, e, kind in plan(text, first - base, stop - base, 0 if low else first - base, limit, overlap):
                    rows.append((*(getattr(rec, k) for k in keys), rec.range_no, base + s, base + e, kind, text[s:e]))
            yield pd.DataFrame(rows, columns=[*keys, "range_no", "start", "stop", "boundary", "text"])

    return run


def _slices(keys: list[str]):
    """A text's ranges with their halos, each as a row of its own; the text itself goes no further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, (text, total) in enumerate(zip(b.column("text"), b.column("total").to_pylist())):
                text = text.as_py()
                for low in range(0, total, RANGE * 16):
                    nos = range(low // RANGE, min((total - 1) // RANGE + 1, low // RANGE + 16))
                    base = [max(n * RANGE - HALO, 0) for n in nos]
                    cols = [pa.repeat(b.column(k)[at], len(nos)) for k in keys]
                    yield pa.RecordBatch.from_arrays(
                        [*cols, pa.repeat(pa.scalar(total, pa.int64()), len(nos)), pa.array(list(nos), pa.int32()), pa.array(base, pa.int64()), pa.array([text[x:n * RANGE + RANGE + HALO] for n, x in zip(nos, base)])],
                        names=[*keys, "total", "range_no", "base", "slice"],
                    )

    return run


def split_oversized(items: DataFrame, keys: list[str], text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every item above ``limit`` tokens (code points div 4), others are left out.

    Result: keys, piece_no, start, stop (code points), token_cost, boundary, text. Items are merged by key (repeats equal
    the first), of which any column may be null; null and empty texts have no pieces; other columns are ignored. Every code point of an item is
    in a piece; pieces are within the limit. Short texts are left in the scan; only ranges of long ones are spread.
    """
    types = dict(items.dtypes)
    named = items.select(*keys, F.col(text).alias("text"), F.length(text).cast("long").alias("total"))
    long = named.filter(F.col("total") >= (limit + 1) * PER_TOKEN)
    key_schema = ", ".join(f"`{k}` {types[k]}" for k in keys)
    slices = long.mapInArrow(_slices(keys), key_schema + ", total long, range_no int, base long, slice string").dropDuplicates([*keys, "range_no"])
    most = limit * PER_TOKEN + PER_TOKEN - 1
    pieces = slices.mapInPandas(_plan_ranges(keys, most, overlap * PER_TOKEN), key_schema + ", " + PIECES)
    return numbered(_in_range(pieces, keys), keys)


def _in_range(pieces: DataFrame, keys: list[str]) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy("start"))
    return pieces.select(
        *keys, "range_no", (inside - 1).cast("long").alias("piece_in_range"), "start", "stop", F.floor((F.col("stop") - F.col("start")) / PER_TOKEN).cast("int").alias("token_cost"), "boundary", "text",
    )


def _same(a: list[str], left: str, right: str):
    """Null-safe equality of key columns."""
    cond = F.lit(True)
    for k in a:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def numbered(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces with piece_no over the whole item."""
    counts = pieces.groupBy(*keys, "range_no").agg(F.count("*").alias("n"))
    before = counts.select(*keys, "range_no", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = pieces.alias("p").join(before.alias("b"), _same([*keys, "range_no"], "p", "b"))
    return joined.select(*[F.col(f"p.{k}").alias(k) for k in keys], (F.col("before") + F.col("piece_in_range")).alias("piece_no"), "start", "stop", "token_cost", "boundary", "text")


# --- files by byte ranges ----------------------------------------------------------------------------------------
FILE_PIECES = "file_path string, range_no long, byte_start long, byte_stop long, chars long, offset long, boundary string, text string"


_STRAY = re.compile("[\ud800-\udfff]")  #: bytes that are no UTF-8, as decoded by ``_text``


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _text(data: bytes) -> str:
    """Decoded text; a byte that is no UTF-8 counts as one character."""
    return data.decode("utf-8", "surrogateescape")


def _char_begin(data: bytes, at: int) -> int:
    """``at`` moved back to the first byte of the character that it stands in."""
    for back in range(4):
        if at - back <= 0 or at >= len(data) or data[at - back] & 0xC0 != 0x80:
            return max(at - back, 0)
    return at


def _anchor(data: bytes, base: int, at: int) -> int:
    """Byte offset of the cut at or before ``at``, settled from the bytes of the halo around it alone.

    ``data`` holds the file's bytes from ``base`` on, at least ``HALO`` before and 64 behind ``at`` where there are.
    """
    halo = data[max(at - HALO - base, 0):at + 64 - base]
    mid = _char_begin(halo, at - max(at - HALO, base))
    first = next((i for i in range(min(4, mid)) if halo[i] & 0xC0 != 0x80), 0)
    before, ahead = _text(halo[first:mid]), _text(halo[mid:_char_begin(halo, max(len(halo) - 1, mid))])
    cut, _ = last_cut(before + ahead, len(before) // 2, len(before))
    return at - (at - max(at - HALO, base) - mid) - _bytes(before[cut:])


def _open(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _plan_file(most: int, lap: int, span: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, no, size in zip(b["file_path"], b["range_no"], b["size"]):
                low, high = no * span, min((no + 1) * span, size)
                base = max(low - HALO - 4 * lap, 0)
                system, inner = _open(path)
                with system.open_input_file(inner) as f:
                    data = f.read_at(min(high + 64, size) - base, base)
                first = 0 if low == 0 else _anchor(data, base, low)
                stop = size if high == size else _anchor(data, base, high)
                lead = first - base if low == 0 else _char_begin(data, max(first - base - 4 * lap, 0))
                text, begin = _text(data[lead:stop - base]), len(_text(data[lead:first - base]))
                rows, at, byte = [], 0, base + lead
                for s, e, kind in plan(text, begin, len(text), 0, most, lap):
                    byte += _bytes(text[at:s]) if s >= at else -_bytes(text[s:at])
                    rows.append((path, no, byte, byte + _bytes(text[s:e]), len(text) - begin, s - begin, kind, _STRAY.sub("\ufffd", text[s:e])))
                    at = s
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in FILE_PIECES.split(", ")])

    return run


def split_files(spark: SparkSession, paths: list[str], limit: int = LIMIT, overlap: int = OVERLAP, span: int = RANGE * 64) -> DataFrame:
    """Pieces of giant UTF-8 files: (file_path, piece_no, byte_start, byte_stop, start, stop, token_cost, boundary, text).

    Workers read byte ranges of ``span`` bytes (at least twice the halo) with halos through Arrow's file systems (local, HDFS, object stores), so no
    file is ever loaded as a whole. The boundary tables of the ranges are stitched by prefix sums of their piece and
    character counts. An empty file has no pieces; a byte that is no UTF-8 becomes one replacement character.
    """
    sizes = [(p, system.get_file_info(inner).size or 0) for p in paths for system, inner in [_open(p)]]
    plan_rows = [(p, n, size) for p, size in sizes for n in range(-(-size // span))]
    ranges = spark.createDataFrame(plan_rows, "file_path string, range_no long, size long").repartition(max(len(plan_rows), 1), "file_path", "range_no")
    pieces = ranges.mapInPandas(_plan_file(limit * PER_TOKEN + PER_TOKEN - 1, overlap * PER_TOKEN, span), FILE_PIECES)
    counts = pieces.groupBy("file_path", "range_no").agg(F.count("*").alias("n"), F.max("chars").alias("chars"))
    before = Window.partitionBy("file_path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    table = counts.select("file_path", "range_no", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "chars")])
    inside = F.row_number().over(Window.partitionBy("file_path", "range_no").orderBy("byte_start")) - 1
    start = F.col("chars_before") + F.col("offset")
    return pieces.withColumn("inside", inside).join(table, ["file_path", "range_no"]).select(
        "file_path", (F.col("n_before") + F.col("inside")).alias("piece_no"), "byte_start", "byte_stop", start.alias("start"), (start + F.length("text")).alias("stop"),
        F.floor(F.length("text") / PER_TOKEN).cast("int").alias("token_cost"), "boundary", "text",
    )
