"""Results as JSON, CSV and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import formula_safe

#: Rows of one CSV file: far below the scan's bound, and small enough to be parsed in memory, one task a file.
FILE_ROWS = 100_000


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, safe: bool = True, file_rows: int = FILE_ROWS) -> None:
    """CSV files with a header and at most ``file_rows`` rows each, as many as all rows need; cells that a spreadsheet would run get an apostrophe."""
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    df.select(*[(formula_safe(x) if safe else x).alias(c) for c, x in zip(df.columns, cells, strict=True)]).write.option("header", True).option("maxRecordsPerFile", file_rows).option("quoteAll", True).option("escape", "\"").csv(path)


def write_results(folder: str, results: dict[str, DataFrame], about: dict | None = None, preview: int = 100) -> dict:
    """A report for people in a folder of the driver: ``manifest.json``, a CSV preview of each result and a workbook of all previews.

    The manifest has each result's columns and its whole number of rows.  Every file is
    written beside its place and then put there at once, the manifest last, so a reader
    never sees half a file or a manifest ahead of its files.  Returns the manifest.
    """
    import csv
    import json
    import os
    import uuid

    os.makedirs(folder, exist_ok=True)
    spare = f".{uuid.uuid4().hex}"

    def put(name: str, write) -> None:
        own = os.path.join(folder, name + spare)
        try:
            write(own)
            os.replace(own, os.path.join(folder, name))
        finally:
            if os.path.exists(own):
                os.remove(own)

    manifest = {"about": about or {}, "results": {}}
    few = {}
    for name, df in results.items():
        few[name] = df.limit(preview)
        shown = few[name].select(*[formula_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]).collect()

        def write_rows(path: str, df=df, shown=shown) -> None:
            with open(path, "w", newline="", encoding="utf-8") as f:
                csv.writer(f, quoting=csv.QUOTE_ALL).writerows([df.columns, *map(tuple, shown)])

        put(f"{name}.csv", write_rows)
        manifest["results"][name] = {"columns": df.columns, "rows": df.count(), "shown": len(shown)}
    put("results.xlsx", lambda path: write_workbook(path, few))

    def write_manifest(path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(manifest, f, indent=1, sort_keys=True)

    put("manifest.json", write_manifest)
    return manifest


def write_workbook(path: str, sheets: dict[str, DataFrame], max_rows: int = 100_000) -> None:
    """One spreadsheet file with a sheet per result, for people: text cells, header first, at most ``max_rows`` rows a sheet.

    A result with more rows is refused, not cut; it belongs in a table or CSV.
    """
    import zipfile
    from xml.sax.saxutils import escape

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    link = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{link}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{link}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{link}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            if df.limit(max_rows + 1).count() > max_rows:
                raise ValueError(f"more than {max_rows} rows")
            shown = df.select(*[formula_safe(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
                for number, row in enumerate([tuple(df.columns), *map(tuple, shown.collect())], 1):
                    cells = "".join("" if v is None else f'<c r="{_letters(k)}{number}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for k, v in enumerate(row))
                    f.write(f'<row r="{number}">{cells}</row>'.encode())
                f.write(b"</sheetData></worksheet>")


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out
