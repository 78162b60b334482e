"""File readers, exports, evaluation, and the registered queries against their SQL."""

import io
import os
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echotrace import queries as Q
from echotrace.plans import evaluate, exports
from echotrace.sources import sheets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def xlsx(sheets_xml, shared=(), styles="", states=()):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="S{i}" sheetId="{i}" r:id="r{i}" {"state=" + chr(34) + states[i - 1] + chr(34) if i <= len(states) and states[i - 1] else ""}/>' for i in range(1, len(sheets_xml) + 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{listed}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets_xml) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {ns}>{styles}</styleSheet>")
        for i, x in enumerate(sheets_xml, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{x}</sheetData></worksheet>")
    return out.getvalue()


def test_csv():
    rows = sheets.read_bytes("a.csv", "name,x\n50%,0.5\n\"1,234\",-2e1\n".encode("utf-8-sig"))
    assert [(r["coordinate"], r["canonical_value"], r["column_header"], r["header_row"]) for r in rows] == [("A2", "0.5", "name", 1), ("B2", "0.5", "x", 1), ("A3", "1234", "name", 1), ("B3", "-20", "x", 1)]
    assert sheets.read_bytes("a.csv", "数值\n3\n".encode("gb18030"))[0]["column_header"] == "数值"


def test_xlsx_headers_formulas_dates_and_hidden_sheets():
    body = '<row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="2"><c r="A2"><v>2.50</v></c><c r="B2"><f>A2*2</f><v>5</v></c><c r="C2"><f>A2</f></c><c r="D2" s="1"><v>45000</v></c></row>'
    rows = sheets.read_bytes("b.xlsx", xlsx([body, '<row r="1"><c r="AA1"><v>7</v></c></row>'], ["head  er"], '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>', [None, "hidden"]))
    found = {r["coordinate"]: r for r in rows if r["kind"] == "cell"}
    assert set(found) == {"A2", "B2", "AA1"}
    assert found["A2"]["canonical_value"] == "2.5" and found["A2"]["column_header"] == "head er" and found["B2"]["formula"] == "=A2*2"
    assert found["AA1"]["hidden_sheet"] and found["AA1"]["column"] == 27
    assert [r["severity"] for r in rows if r["kind"] == "issue"] == ["warning"]


def test_unreadable_files_are_issues(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("1\n2\n")
    (tmp_path / "bad.xlsx").write_text("no zip")
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf")
    rows = sheets.scan(spark, str(tmp_path))
    assert sheets.cells(rows).count() == 2
    assert sheets.issues(rows).where("severity = 'error'").count() == 2
    assert [r.display_value for r in sheets.preview(sheets.cells(rows), sheets.cells(rows).first().source_path, "CSV", "A2").collect()] == ["1", "2"]


def test_metrics_and_exports(spark):
    pairs = spark.createDataFrame([("a", "b", True, "x"), ("c", "d", True, "x"), ("e", "f", False, "y")], "first string, second string, positive boolean, split string")
    detected = spark.createDataFrame([("b", "a", 0.5), ("a", "b", 0.9), ("e", "f", 0.2)], "a string, b string, confidence double")
    joined = evaluate.join_detected(pairs, detected)
    whole = evaluate.metrics(joined, F.col("positive"), F.col("detected"), ["split"]).where("grouping = 'overall'").first()
    assert (whole.tp, whole.fp, whole.fn, whole.tn, whole.precision, whole.recall) == (1, 1, 1, 0, 0.5, 0.5)
    assert joined.where("first = 'a'").first().confidence == 0.9
    stages = spark.createDataFrame([("s", 1.0, 1, 2), ("s", 2.0, 1, 2), ("t", 1.0, 1, 1)], "stage_id string, duration_seconds double, calls int, items int")
    assert [(r.stage_id, r.rank, r.share) for r in exports.stage_ranking(stages).orderBy("rank").collect()] == [("s", 1, 0.75), ("t", 2, 0.25)]


def plain(frame: pd.DataFrame) -> list:
    def one(x):
        if x is None or x is pd.NA or isinstance(x, float) and np.isnan(x):
            return None
        return round(float(x), 6) if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, (np.integer, np.bool_, bool)) else x

    return sorted((tuple(map(one, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_queries_match_their_sql(spark, name):
    got = Q.QUERIES[name](spark, SF).toPandas()
    if name in Q.SQL:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.sql(Q.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
