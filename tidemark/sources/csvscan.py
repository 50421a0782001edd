"""Strict CSV scan: one header row, short rows padded, long rows an error, row numbers from the file."""

from __future__ import annotations

import codecs
import csv
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 64 * 1024
MAX_ROWS, MAX_COLUMNS, MAX_CELL = 500_000, 2048, 1_000_000
DELIMITERS = ",;\t|"


class ScanError(ValueError):
    """A file outside the scan's contract."""


@dataclass(frozen=True)
class Dialect:
    encoding: str
    delimiter: str
    guessed: bool = False


def sniff_encoding(sample: bytes) -> tuple[str, bool]:
    """UTF-8 (with or without a mark), else Windows-1252, which is a guess."""
    if sample.startswith(codecs.BOM_UTF8):
        return "utf-8-sig", False
    try:
        codecs.getincrementaldecoder("utf-8")().decode(sample, final=False)
        return "utf-8", False
    except UnicodeDecodeError:
        return "cp1252", True


def sniff_delimiter(text: str) -> str:
    """By the csv sniffer, else the commonest candidate in the first line."""
    try:
        return csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
    except csv.Error:
        first = text.splitlines()[0] if text else ""
        return max(DELIMITERS, key=lambda d: (first.count(d), -DELIMITERS.index(d)))


def sniff(spark: SparkSession, path: str) -> Dialect:
    """Dialect from the file's first 64 KiB, read through Spark so that any file system works."""
    row = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, SAMPLE).alias("b")).first()
    sample = bytes(row["b"]) if row else b""
    encoding, guessed = sniff_encoding(sample)
    return Dialect(encoding, sniff_delimiter(sample.decode(encoding, "replace")), guessed)


def header_row(rows: list[list[str]]) -> int:
    """Most header-like of the first 25 rows: 4 for each text cell, 2 for each distinct one, 1 for each filled one; the earliest on ties."""

    def number(x: str) -> bool:
        try:
            float(x.replace(",", "."))
            return True
        except ValueError:
            return False

    best, at = -1, 0
    for i, row in enumerate(rows[:25]):
        filled = [c.strip() for c in row if c and c.strip()]
        score = 4 * sum(not number(c) for c in filled) + 2 * len(set(filled)) + len(filled)
        if score > best:
            best, at = score, i
    return at


def scan_csv(spark: SparkSession, path: str, dialect: Dialect | None = None, max_rows: int | None = MAX_ROWS, header: int | str = 1, columns: Sequence[str] | None = None) -> DataFrame:
    """``src_row`` (physical line where the record starts, the file's first being line 1) and the header's columns as text.

    ``header`` is the number of the record with the headers, or ``detect`` for the most
    header-like of the first 25; what stands before it is skipped.  ``columns`` are the
    only ones taken out of a record, in this order; rows and faults are the same with any.
    An empty cell is empty text, a cell that a short row lacks is null.  Lines without any
    character are skipped.  The parser runs in parallel over files; one file is one task,
    since quoted line breaks make its lines dependent on what comes before; large files
    without these are for ``scan_csv_native``, which splits them.
    """
    d = dialect or sniff(spark, path)
    raw = spark.read.format("binaryFile").load(path).select("content")
    head = raw.select(F.substring("content", 1, SAMPLE).alias("b")).first()
    if head is None:
        raise ScanError("no file")
    start = list(itertools.islice(csv.reader(bytes(head["b"]).decode(d.encoding, "replace").splitlines(True), delimiter=d.delimiter), 25 if header == "detect" else header))
    skipped = header_row(start) if header == "detect" else header - 1
    if len(start) <= skipped:
        raise ScanError("no header row")
    names = [c.strip() for c in start[skipped]]
    if any(not n for n in names) or len({n.casefold() for n in names}) < len(names):
        raise ScanError("headers must be filled and distinct")
    if len(names) > MAX_COLUMNS:
        raise ScanError(f"more than {MAX_COLUMNS} columns")
    taken = list(names if columns is None else columns)
    if not set(taken) <= set(names):
        raise ScanError(f"no column {sorted(set(taken) - set(names))}")
    places = [names.index(c) for c in taken]
    schema = T.StructType([T.StructField("src_row", T.LongType()), *[T.StructField(n, T.StringType()) for n in taken]])

    def parse(batches):
        import io

        import pyarrow as pa

        kinds = pa.schema([("src_row", pa.int64()), *[(n, pa.string()) for n in taken]])
        csv.field_size_limit(MAX_CELL)
        for batch in batches:
            for content in batch.column(0).to_pylist():
                reader = csv.reader(io.StringIO(content.decode(d.encoding), newline=""), delimiter=d.delimiter, strict=True)
                for _ in range(skipped + 1):
                    next(reader, None)
                rows: list[list] = []
                line, n = reader.line_num + 1, 0
                for record in reader:
                    start, line = line, reader.line_num + 1
                    if not record:
                        continue
                    if len(record) > len(names):
                        raise ScanError(f"line {start}: {len(record)} cells under {len(names)} headers")
                    n += 1
                    if max_rows is not None and n > max_rows:
                        raise ScanError(f"more than {max_rows} rows")
                    rows.append([start, *(record[i] if i < len(record) else None for i in places)])
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return raw.mapInArrow(parse, schema)


def scan_csv_native(spark: SparkSession, path: str, names: list[str], dialect: Dialect) -> DataFrame:
    """Splittable scan for files without quoted line breaks and without row numbers: text columns, long rows flagged in ``corrupt``."""
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("corrupt", T.StringType())])
    df = spark.read.schema(schema).option("header", True).option("sep", dialect.delimiter).option("encoding", "UTF-8" if dialect.encoding.startswith("utf-8") else "windows-1252").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").csv(path)
    return df.select(*[F.when(F.col("corrupt").isNull(), F.coalesce(F.col(f"`{n}`"), F.lit(""))).otherwise(F.col(f"`{n}`")).alias(n) for n in names], "corrupt")
