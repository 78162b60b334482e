"""The binary workbook format against its XLSX twin, and the data source's partitions, filters and memory."""

import io
import os
import resource
import struct

import pytest
from pyspark.sql import functions as F

from echotrace.sources import sheets, xls

from .test_sources_and_queries import xlsx


def record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def short(text):
    """A counted string, wide where it must be."""
    wide = any(ord(c) > 255 for c in text)
    return bytes([wide]) + text.encode("utf-16-le" if wide else "latin-1")


def strings_table(strings, split):
    """SST; with `split`, continued in the middle of strings, where the width is told again and may differ."""
    out, part = [], struct.pack("<II", len(strings), len(strings))
    for i, s in enumerate(strings):
        whole = short(s)
        if split and len(s) > 3:
            out.append(part + struct.pack("<HB", len(s), whole[0]) + whole[1 : 1 + 2 * (1 + whole[0])])
            part = bytes([1]) + s[2:].encode("utf-16-le")
        elif i % 3 == 2:  # rich text with one run, and an extension
            part += struct.pack("<HBHI", len(s), whole[0] | 12, 1, 5) + whole[1:] + b"runs" + b"other"
        else:
            part += struct.pack("<H", len(s)) + whole
    return b"".join(record(0x3C if i else 0xFC, x) for i, x in enumerate([*out, part]))


def workbook(sheets_, strings=(), split=False, formats=(), styles=(0, 14), version=0x600, before=b""):
    """The stream of a workbook: sheets_ are name, state, records."""
    bof = record(0x809, struct.pack("<HHHHII", version, 5, 0, 0, 0, 0))
    head = bof + before + b"".join(record(0x41E, struct.pack("<HH", k, len(v)) + short(v)) for k, v in formats) + b"".join(record(0xE0, struct.pack("<HH", 0, f) + bytes(16)) for f in styles)
    table, end = strings_table(strings, split), record(0x0A, b"")
    listed = lambda at: b"".join(record(0x85, struct.pack("<IBBB", at[i], state, 0, len(name)) + short(name)) for i, (name, state, _) in enumerate(sheets_))
    at, places = len(head) + len(listed([0] * len(sheets_))) + len(table) + len(end), []
    bodies = [bof + body + end for _, _, body in sheets_]
    for b in bodies:
        places.append(at)
        at += len(b)
    return head + listed(places) + table + end + b"".join(bodies)


def compound(stream, small=False):
    """A compound file with this workbook in sectors of 512 bytes, dealt backwards; under 4096 bytes in the small sectors if asked for."""
    sectors, fat = [], []

    def put(data, unit=512):
        parts = [data[i : i + unit].ljust(unit, b"\0") for i in range(0, len(data), unit)]
        first = len(sectors)
        order = [first + len(parts) - 1 - i for i in range(len(parts))]  # the first part lies last
        sectors.extend(reversed(parts))
        fat.extend([0] * len(parts))
        for a, b in zip(order, [*order[1:], 0xFFFFFFFE]):
            fat[a] = b
        return order[0]

    entry = lambda name, kind, start, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind)).ljust(116, b"\0") + struct.pack("<IQ", start, size)
    if small:
        n = -(-len(stream) // 64)
        root, table = put(stream.ljust(64 * n, b"\0")), put(struct.pack(f"<{n}I", *range(1, n), 0xFFFFFFFE).ljust(512, b"\xff"))
        folder = put(entry("Root Entry", 5, root, 64 * n) + entry("Workbook", 2, 0, len(stream)))
    else:
        stream = stream.ljust(4096, b"\0")
        root, table = 0xFFFFFFFE, 0xFFFFFFFE
        folder = put(entry("Root Entry", 5, root, 0) + entry("Workbook", 2, put(stream), len(stream)))
    tables = 1
    while 128 * tables < len(sectors) + tables:
        tables += 1
    numbers = fat + [0xFFFFFFFD] * tables + [0xFFFFFFFF] * (128 * tables - len(fat) - tables)
    head = xls.SIGNATURE + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<8I", tables, folder, 0, 4096, table, int(small), 0xFFFFFFFE, 0)
    places = list(range(len(sectors), len(sectors) + tables))
    head += struct.pack("<109I", *places, *[0xFFFFFFFF] * (109 - tables))
    return head.ljust(512, b"\0")[:512] + b"".join(sectors) + struct.pack(f"<{len(numbers)}I", *numbers)


def rk(value, hundredths=False):
    return (int(value * (100 if hundredths else 1)) << 2 | 2 | hundredths) & 0xFFFFFFFF


NUMBER = lambda r, c, v, style=0: record(0x203, struct.pack("<HHHd", r, c, style, v))
TWIN = (
    record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + NUMBER(1, 0, 2.5) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, rk(-1234, False)))
    + record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, rk(12.34, True), 0, struct.unpack("<I", struct.pack("<d", 0.75)[4:])[0] & ~3, 1))
    + NUMBER(3, 0, 45000.0, 1) + record(0x06, struct.pack("<HHHd", 4, 0, 0, 7.0) + bytes(8)) + record(0x205, struct.pack("<HHHBB", 4, 1, 0, 1, 0))
    + record(0x06, struct.pack("<HHH", 5, 0, 0) + b"\x00\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x207, struct.pack("<H", 3) + short("new")) + NUMBER(6, 0, 8.0)
    + record(0x06, struct.pack("<HHH", 7, 0, 0) + b"\x02\x2a\0\0\0\0\xff\xff" + bytes(8)) + record(0x204, struct.pack("<HHH", 8, 0, 0) + struct.pack("<H", 3) + short("own")) + NUMBER(9, 0, 1e-7)
)
XML = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>2.5</v></c><c r="B2"><v>-1234</v></c></row><row r="3"><c r="A3"><v>12.34</v></c><c r="B3"><v>0.75</v></c></row>'
    '<row r="4"><c r="A4" s="1"><v>45000</v></c></row><row r="5"><c r="A5"><v>7</v></c></row><row r="6"><c r="A6" t="inlineStr"><is><t>new</t></is></c></row><row r="7"><c r="A7"><v>8</v></c></row><row r="9"><c r="A9" t="inlineStr"><is><t>own</t></is></c></row><row r="10"><c r="A10"><v>1e-7</v></c></row>'
)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("split", [False, True])
def test_a_binary_workbook_has_the_cells_of_its_twin(small, split):
    strings = ["first  header", "größe 日本語", "rich", "x"]
    body = compound(workbook([("S1", 0, TWIN), ("S2", 1, NUMBER(0, 26, 7.0))], strings, split), small)
    twin = xlsx([XML, '<row r="1"><c r="AA1"><v>7</v></c></row>'], strings, '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>', [None, "hidden"])
    keys = ("sheet", "row", "column", "coordinate", "canonical_value", "hidden_sheet", "column_header", "header_row")
    got, want = ([tuple(r[k] for k in keys) for r in sheets.read_bytes(name, b)] for name, b in (("a.xls", body), ("a.xlsx", twin)))
    assert got == want and len(got) == 8 and got[1][6] == "größe 日本語" and got[6][6] == "own"
    assert sheets.sheet_names("a.xls", io.BytesIO(body)) == ["S1", "S2"] == sheets.sheet_names("a.xlsx", io.BytesIO(twin))
    assert [r["sheet"] for r in sheets.read_file("a.xls", io.BytesIO(body), "S2")] == ["S2"]


def test_rk_numbers_and_date_formats():
    assert [xls._rk(x) for x in (rk(5), rk(-7), rk(1.25, True), struct.unpack("<I", struct.pack("<d", 3.5)[4:])[0])] == [5, -7, 1.25, 3.5]
    assert [xls.shows_date(x) for x in ("yyyy-mm-dd", "0.00", '0 "days"', "[Red]0.0", "h:mm", r"0\d")] == [True, False, False, False, True, False]
    own = compound(workbook([("S", 0, NUMBER(0, 0, 1.0, 0) + NUMBER(0, 1, 2.0, 1))], formats=[(170, "dd/mm")], styles=(170, 0)))
    assert [r["canonical_value"] for r in sheets.read_bytes("o.xls", own)] == ["2"]


def test_broken_binary_workbooks_are_issues():
    whole = compound(workbook([("S1", 0, TWIN * 40)], ["a", "b"]))
    assert len(sheets.read_bytes("w.xls", whole)) == 7 * 40
    for broken in (whole[:700], whole[:-1024], b"", xls.SIGNATURE, whole[:48] + b"\xff\0\0\0" + whole[52:], compound(workbook([("S", 0, b"")], version=0x500)), compound(workbook([("S", 0, b"")], before=record(0x2F, b"\0\0")))):
        rows = sheets.read_bytes("w.xls", broken)
        assert rows[-1]["kind"] == "issue" and rows[-1]["severity"] == "error"
    looped = bytearray(whole)
    at = len(whole) - 512 * -(-(len(whole) // 512) // 128)
    for i in range(at, len(whole), 4):  # every sector is followed by the first
        looped[i : i + 4] = bytes(4)
    assert sheets.read_bytes("w.xls", bytes(looped))[-1]["severity"] == "error"


def test_partitions_and_filters(spark, tmp_path, monkeypatch):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.csv").write_text("n\n1\n2\n")
    (tmp_path / "deep/b b.csv").write_text("3\n")
    (tmp_path / "two.xlsx").write_bytes(xlsx(['<row r="1"><c r="A1"><v>4</v></c></row>', '<row r="1"><c r="A1"><v>5</v></c></row>']))
    (tmp_path / "old.xls").write_bytes(compound(workbook([("S1", 0, NUMBER(0, 0, 6.0)), ("S2", 0, NUMBER(0, 0, 7.0))])))
    (tmp_path / "none.txt").write_text("8\n")
    sheets.register(spark)
    rows = spark.read.format("spreadsheets").load(str(tmp_path))
    assert sorted(r.canonical_value for r in sheets.cells(rows).collect()) == list("1234567") and rows.schema == sheets.scan(spark, str(tmp_path)).schema
    assert sorted(r.canonical_value for r in sheets.cells(sheets.scan(spark, str(tmp_path), str(tmp_path / "a.csv"))).collect()) == list("1234567")
    assert sheets.cells(sheets.scan(spark, f"{tmp_path}/*.csv")).count() == 2  # a pattern goes to Spark's own source
    one = rows.where(F.col("source_path") == f"file:{tmp_path}/deep/b b.csv")
    assert [r.canonical_value for r in one.collect()] == ["3"]
    assert rows.where(F.col("source_path").startswith(f"file:{tmp_path}/deep")).count() == 1 and rows.where(F.col("source_path").isin("x", f"file:{tmp_path}/a.csv")).count() == 2
    assert sorted(r.canonical_value for r in rows.where("sheet = 'S2'").collect()) == ["5", "7"]
    # as the planner asks it
    monkeypatch.setattr(sheets, "SHEET_BYTES", 0)
    reader = sheets.SpreadsheetReader(rows.schema, [str(tmp_path)])
    assert sorted(len(p.pieces) for p in reader.partitions()) == [1, 1, 1, 1, 2]
    left = list(reader.pushFilters([sheets.EqualTo(("sheet",), "S2"), sheets.StringStartsWith(("source_path",), f"file:{tmp_path}/t")]))
    assert [f.attribute for f in left] == [("sheet",)] and [p.pieces for p in reader.partitions()] == [[(f"file:{tmp_path}/two.xlsx", "S2")]]
    monkeypatch.setattr(sheets, "PARTITION_BYTES", 1)
    assert [len(p.pieces) for p in sheets.SpreadsheetReader(rows.schema, [f"{tmp_path}/a.csv", f"{tmp_path}/deep"]).partitions()] == [1, 1]
    with pytest.raises(FileNotFoundError):
        sheets.SpreadsheetReader(rows.schema, [f"{tmp_path}/gone"]).partitions()


def test_no_list_of_a_file(spark, tmp_path):
    """A million rows pass through with little memory more than a few thousand take."""
    path = tmp_path / "long.csv"
    with path.open("w") as out:
        for i in range(0, 1_000_000, 1000):
            out.write("".join(f"{j},x\n" for j in range(i, i + 1000)))
    reader = sheets.SpreadsheetReader(sheets.scan(spark, str(path)).schema, [str(path)])
    (part,) = reader.partitions()
    batches = reader.read(part)
    next(batches)
    before, rows = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, sheets.OUT_ROWS
    for batch in batches:
        rows += batch.num_rows
    assert rows == 1_000_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10  # KB
    assert os.path.getsize(path) > 8_000_000
