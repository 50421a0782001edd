"""Scans, snapshots, paged reads, record documents, sinks and the capture stream."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.sources import csvscan, paged, records, sinks, snapshot, xlsx
from tidemark.streaming import capture


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_csv_rows_and_numbers(spark, tmp_path):
    p = write(tmp_path / "a.csv", b"\xef\xbb\xbfname;note\r\na;\"two\nlines\"\r\n\r\nb\r\n;\r\n")
    d = csvscan.sniff(spark, p)
    assert (d.encoding, d.delimiter) == ("utf-8-sig", ";")
    rows = [tuple(r) for r in csvscan.scan_csv(spark, p, d).collect()]
    assert rows == [(2, "a", "two\nlines"), (5, "b", None), (6, "", "")]


def test_csv_faults(spark, tmp_path):
    with pytest.raises(Exception, match="3 cells under 2"):
        csvscan.scan_csv(spark, write(tmp_path / "b.csv", b"a,b\n1,2,3\n")).collect()
    for bad in (b"a,\n1,2\n", b"a,A\n1,2\n"):
        with pytest.raises(csvscan.ScanError):
            csvscan.scan_csv(spark, write(tmp_path / "c.csv", bad))
    with pytest.raises(Exception, match="more than 1 rows"):
        csvscan.scan_csv(spark, write(tmp_path / "d.csv", b"a\n1\n2\n"), max_rows=1).collect()


def test_csv_encodings(spark, tmp_path):
    p = write(tmp_path / "e.csv", "name,x\ncafé,1\n".encode("cp1252"))
    assert csvscan.sniff(spark, p) == csvscan.Dialect("cp1252", ",", True)
    assert csvscan.scan_csv(spark, p).first()["name"] == "café"
    assert csvscan.header_row([["", ""], ["report", "2024"], ["Name", "Code"], ["a", "1"]]) == 2
    native = csvscan.scan_csv_native(spark, write(tmp_path / "f.csv", b"a,b\n1,\n2\n3,4,5\n"), ["a", "b"], csvscan.Dialect("utf-8", ",")).collect()
    assert [(r.a, r.b) for r in native][:2] == [("1", ""), ("2", None)] and native[2].corrupt == "3,4,5"


def workbook(sheet: str, extra: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><t>day</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        for name, data in (extra or {}).items():
            z.writestr(name, data)
    return out.getvalue()


HEAD = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'


def test_xlsx(spark, tmp_path):
    body = HEAD + '<row r="2"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2" s="1"><v>45292</v></c></row><row r="3"/><row r="4"><c r="B4" t="b"><v>1</v></c></row>'
    rows = [tuple(r) for r in xlsx.scan_xlsx(spark, write(tmp_path / "a.xlsx", workbook(body))).collect()]
    assert rows == [(2, "x", "2024-01-01"), (4, None, "true")]
    for sheet in (HEAD + '<row r="2"><c r="A2"><f>1+1</f><v>2</v></c></row>', HEAD + '<row r="2"><c r="A2" t="e"><v>#N/A</v></c></row>', HEAD + '<row r="2"><c r="C2"><v>1</v></c></row>'):
        with pytest.raises(Exception, match="formula|error cell|beyond"):
            xlsx.scan_xlsx(spark, write(tmp_path / "b.xlsx", workbook(sheet))).collect()


def test_xlsx_container_guard():
    for extra in ({"../x": b""}, {"xl/vbaProject.bin": b"x"}, {"xl/externalLinks/e.xml": b"x"}, {"bomb": b"\0" * 5_000_000}):
        with pytest.raises(csvscan.ScanError):
            xlsx.guard_container(workbook(HEAD, extra))
    with pytest.raises(csvscan.ScanError):
        xlsx.guard_container(b"no zip")


def test_snapshot_round_trip(spark, tmp_path, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "src_row")
    path = str(tmp_path / "snap")
    facts = snapshot.freeze(df, path)
    back = snapshot.open_snapshot(spark, path, facts)
    assert back.count() == df.count() and back.schema["c_name"].dataType.simpleString() == "struct<v:string,k:tinyint>"
    assert snapshot.untagged(back).filter("src_row = 3").first()["c_name"] == df.filter("src_row = 3").first()["c_name"]
    part = snapshot.rows_between(back, 10, 20)
    assert part.count() == 10 and "PushedFilters: [IsNotNull(src_row), GreaterThanOrEqual(src_row,10)" in part._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(snapshot.SnapshotBroken):
        snapshot.open_snapshot(spark, path, facts | {"hash": "0"})
    snapshot.compact(spark, path, str(tmp_path / "small"), 2)
    assert snapshot.open_snapshot(spark, str(tmp_path / "small"), facts).count() == df.count()


def test_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, snapshot.upsert(base, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(map(tuple, snapshot.upsert(base, new, ["k"], ignore=True).collect())) == [(1, "a"), (2, "b"), (3, "C")]


def pages_of(ids):
    def fetch(after, up_to, limit):
        return [{"id": i, "name": f"n{i}"} for i in ids if after < i <= up_to][:limit]

    return fetch


def test_paged_read(spark):
    ids = [1, 2, 5, 9, 10, 11, 30]
    df = paged.read_paged(spark, pages_of(ids), "id long, name string", high=25, page=2, span=4, name="test_paged")
    assert sorted(tuple(r) for r in df.collect()) == [(i, f"n{i}") for i in ids if i <= 25]
    broken = paged.read_paged(spark, lambda a, b, n: [{"id": a, "name": ""}], "id long, name string", high=3, name="test_broken")
    with pytest.raises(Exception, match="id 0 after 0"):
        broken.collect()


def test_capture_plan_and_values():
    fields = {"name": {"type": "char"}, "lines": {"type": "one2many"}, "calc": {"type": "char", "stored": False}}
    assert paged.plan_capture(fields, ["name"], [("name", "equals", "x")])["fields"] == ("id", "name")
    for wanted, filters in ((["lines"], ()), (["calc"], ()), (["name"], [("name", "like", "x")])):
        with pytest.raises(paged.CaptureError):
            paged.plan_capture(fields, wanted, filters)
    assert paged.decode_value(False, "char") is None and paged.decode_value(False, "boolean") is False
    with pytest.raises(paged.CaptureError):
        paged.decode_value(1, "char")


def test_record_document(spark, tmp_path):
    mark = {"target": "t"}
    doc = {"metadata": {"fingerprint": mark, "models": {}}, "records": {"fingerprint": mark, "models": {"p": {"records": [{"id": 2, "values": {"name": False, "unit": [7, "kg"], "tags": [1, 2], "active": True}}, {"id": 1, "values": {"name": "x", "unit": False, "tags": [], "active": False}}]}}}}
    p = write(tmp_path / "t.json", json.dumps(doc).encode())
    assert records.open_document(spark, p)["fingerprint"] == mark
    rows = [tuple(r) for r in records.records(spark, p, "p", {"name": "text", "unit": "many2one", "tags": "many2many", "active": "boolean"}).collect()]
    assert rows == [(1, "x", None, [], False), (2, None, 7, [1, 2], True)]
    doc["records"]["fingerprint"] = {"target": "u"}
    with pytest.raises(records.FingerprintMismatch):
        records.open_document(spark, write(tmp_path / "u.json", json.dumps(doc).encode()))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=x"), (2, None)], "i int, s string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert "'=x" in "".join(f.read_text() for f in (tmp_path / "c").glob("part*"))
    sinks.write_json(df, str(tmp_path / "j"))
    assert '"s":null' in "".join(f.read_text() for f in (tmp_path / "j").glob("part*"))


def test_key_chunks_are_bounded(spark):
    keys = spark.range(1000).select((F.col("id") % 300).alias("k"), F.lit("x").alias("l"))
    chunks = paged.key_chunks(keys, ["k", "l"], 50)
    sizes = [r["count"] for r in chunks.groupBy("chunk").count().collect()]
    assert sum(sizes) == 300 and max(sizes) <= 50


def test_capture_stream(spark, tmp_path):
    ids = list(range(1, 8))
    high = [5]
    df = capture.capture_stream(spark, pages_of(ids), lambda: high[0], "id long, name string", page=2, name="test_capture")
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    capture.run_available(df, out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]
