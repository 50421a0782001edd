"""Spreadsheet scan from the container's XML, with a guard against hostile containers."""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.csvscan import ScanError

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
MAX_EXPANDED, MAX_RATIO, MAX_MEMBERS = 512 << 20, 1000, 10_000
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def guard_container(data: bytes) -> zipfile.ZipFile:
    """The opened container, unless it holds paths that leave it, encryption, links, macros, external links or a bomb."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise ScanError(f"no spreadsheet container: {e}") from e
    infos = z.infolist()
    if len(infos) > MAX_MEMBERS or sum(i.file_size for i in infos) > MAX_EXPANDED:
        raise ScanError("container too large")
    for i in infos:
        name = i.filename
        if name.startswith(("/", "\\")) or ".." in name.replace("\\", "/").split("/") or re.match(r"[A-Za-z]:", name):
            raise ScanError(f"path leaves the container: {name}")
        if i.flag_bits & 1:
            raise ScanError("encrypted")
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise ScanError(f"link: {name}")
        if i.file_size > MAX_RATIO * max(1, i.compress_size):
            raise ScanError(f"expands too much: {name}")
        if name.lower().endswith("vbaproject.bin"):
            raise ScanError("macros")
        if name.lower().startswith("xl/externallinks/"):
            raise ScanError("external links")
    return z


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def read_sheet(data: bytes, sheet: str | None = None, header: int = 1) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells as text) from the header row on; formulas and error cells are errors, blank rows are skipped."""
    z = guard_container(data)
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = {s.get("name"): links[s.get(f"{{{NS['r']}}}id")] for s in book.iterfind("m:sheets/m:sheet", NS)}
    name = sheet or next(iter(sheets), None)
    if name not in sheets:
        raise ScanError(f"no sheet {name!r}")
    target = sheets[name]
    path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{NS['m']}}}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)]
    dates = _date_styles(z)
    for row in ElementTree.fromstring(z.read(path)).iterfind("m:sheetData/m:row", NS):
        number = int(row.get("r"))
        if number < header:
            continue
        cells: list[str | None] = []
        for c in row.iterfind("m:c", NS):
            if c.find("m:f", NS) is not None:
                raise ScanError(f"formula in {c.get('r')}")
            at = _column(c.get("r"))
            cells += [None] * (at + 1 - len(cells))
            cells[at] = _cell(c, shared, dates)
        if any(x not in (None, "") for x in cells):
            yield number, cells


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")) for f in root.iterfind("m:numFmts/m:numFmt", NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "").lower()))}
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", NS)) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}


def _cell(c, shared: list[str], dates: set[int]) -> str | None:
    kind, value = c.get("t", "n"), c.find("m:v", NS)
    if kind == "inlineStr":
        return "".join(t.text or "" for t in c.iter(f"{{{NS['m']}}}t"))
    if value is None or value.text is None:
        return None
    if kind == "e":
        raise ScanError(f"error cell {c.get('r')}")
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(c.get("s", 0)) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=float(value.text))
        return moment.date().isoformat() if moment.time() == dt.time() else moment.isoformat()
    return value.text


def scan_xlsx(spark: SparkSession, path: str, sheet: str | None = None, header: int = 1) -> DataFrame:
    """``src_row`` and the header's columns as text; data beyond the headers is an error.  One workbook is one task."""
    raw = spark.read.format("binaryFile").load(path).select("content")
    first = raw.first()
    if first is None:
        raise ScanError("no file")
    head = next(read_sheet(bytes(first["content"]), sheet, header), None)
    names = [(c or "").strip() for c in head[1]] if head else []
    if not names or any(not n for n in names) or len({n.casefold() for n in names}) < len(names):
        raise ScanError("headers must be filled and distinct")
    schema = T.StructType([T.StructField("src_row", T.LongType()), *[T.StructField(n, T.StringType()) for n in names]])

    def parse(batches):
        import pyarrow as pa

        kinds = pa.schema([("src_row", pa.int64()), *[(n, pa.string()) for n in names]])
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for number, cells in read_sheet(content, sheet, header):
                    if number == head[0]:
                        continue
                    if any(x not in (None, "") for x in cells[len(names) :]):
                        raise ScanError(f"row {number}: data beyond the headers")
                    rows.append([number, *cells[: len(names)], *[None] * (len(names) - len(cells))])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    return raw.mapInArrow(parse, schema)
