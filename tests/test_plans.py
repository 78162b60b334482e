"""Projects, performance, manifests, workbooks and the picture scan."""

import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.model import CELLS, FINDINGS, ISSUES, Settings
from echotrace.plans import evaluate, exports, performance, project, review, scan as project_scan
from echotrace.sources import sheets
from echotrace.vision import pages, scan


def test_project(spark, tmp_path):
    p = project.Project("p").with_sources("b", "a", "b").with_result("r", "1")
    assert p.sources == ("a", "b") and p.with_sources("a") is p and p.with_sources("c").result is None
    assert p.with_settings(Settings(minimum_digit_run=5)).result is None and p.without_source("a").sources == ("b",)
    path = f"file://{tmp_path}/p.json"
    project.save(spark, p, path)
    project.save(spark, p, path)
    assert project.load(spark, path) == p
    old = json.loads(project.dumps(p)) | {"schema": 1}
    assert project.loads(json.dumps(old)).settings == Settings()
    with pytest.raises(ValueError):
        project.loads(json.dumps(old | {"schema": 8}))


def test_recorder(spark):
    now = iter(range(100))
    r = performance.Recorder(lambda: float(next(now)))
    with r.stage("a", 3):
        r.pause()
        r.resume()
    with r.stage("a", 1):
        pass
    assert r.stages(spark).first().asDict() == {"stage_id": "a", "duration_seconds": 3.0, "calls": 2, "items": 4}
    assert performance.environment(spark)["master"] == "local"


def test_manifest(spark, tmp_path):
    images = [{"id": i, "path": i, "split": "test", "source_group": "g", "page": 1} for i in "ab"]
    pair = {"id": "p", "first": "a", "second": "b", "expected": "positive", "split": "test", "first_region": [0, 0, 1, 1]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"images": images, "pairs": [pair]}))
    assert [x.count() for x in evaluate.manifest(spark, str(path))] == [2, 1]
    for bad in ({"images": [images[0] | {"split": "train"}, images[1]], "pairs": []}, {"images": images, "pairs": [pair | {"expected": "x"}]}, {"images": images[:1], "pairs": [pair]}, {"images": images, "pairs": [pair | {"first_region": [1]}]}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            evaluate.manifest(spark, str(path))


def test_workbook_reads_back(spark, tmp_path):
    path = tmp_path / "out.xlsx"
    exports.write_xlsx({"Overview": spark.createDataFrame([(1, "a<b\x01", None)], "n int, t string, x double"), "Two & more": spark.range(3)}, str(path))
    rows = list(sheets.read_bytes("o.xlsx", path.read_bytes()))
    assert [(r["sheet"], r["coordinate"], r["canonical_value"], r["column_header"]) for r in rows] == [("Overview", "A2", "1", "n"), *(("Two & more", f"A{i + 2}", str(i), "id") for i in range(3))]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["out.xlsx"]


def test_cells_without_references_follow_one_another():
    from tests.test_sources_and_queries import xlsx

    body = '<row><c><v>7</v></c><c><v>8</v></c></row><row r="5"><c r="C5"><v>9</v></c><c><v>10</v></c></row><row><c><v>11</v></c></row>'
    assert [(r["coordinate"], r["canonical_value"]) for r in sheets.read_bytes("b.xlsx", xlsx([body]))] == [("A1", "7"), ("B1", "8"), ("C5", "9"), ("D5", "10"), ("A6", "11")]


@pytest.fixture(scope="module")
def found(spark):
    columns = ([2.5, 7, 11, 16.5, 4], [5, 14, 22, 33, 8], [16.5, 4, 2.5, 11, 7], [31, 10, 7.25, 31.25, 812345], [90.1, 6, 10, 7.25, 312345], [7, 11, 16.5, 3, 61])
    rows = [("f", "S", r, c, f"{sheets.letters(c)}{r}", sheets.canonical_text(v), f"{v} g", c == 9, f"h{c}", 1, None) for c, column in enumerate(columns, 1) for r, v in enumerate(column, 2)]
    copy = [("g", *x[1:]) for x in rows if x[3] in (4, 5) and x[2] in (3, 4)]
    return project_scan.scan_cells(spark.createDataFrame(rows + copy, CELLS)).persist()


def test_evidence_shows_both_sides(found):
    by_rule = {}
    for r in found.collect():
        by_rule.setdefault(r.rule_id, []).append(json.loads(r.details))
        assert "paired_values" not in r.description and '"cells"' not in r.description
    scale = next(d for d in by_rule["excel.series.scale"] if d["second_series"]["column"] == "B")
    assert scale["first_series"] == {"source_path": "f", "sheet": "S", "column": "A", "coordinates": ["A2", "A3", "A4", "A5", "A6"], "values": ["2.5", "7", "11", "16.5", "4"]}
    assert [(p["position"], p["second_coordinate"], float(p["relation_result"])) for p in scale["paired_values"]] == [(str(i + 1), f"B{i + 2}", v) for i, v in enumerate((5, 14, 22, 33, 8))]
    (moved,) = by_rule["excel.series.shuffled"]
    assert [(p["first_coordinate"], p["second_coordinate"]) for p in moved["paired_values"]] == [("A2", "C4"), ("A3", "C6"), ("A4", "C5"), ("A5", "C2"), ("A6", "C3")]
    assert all(p["first_value"] == p["second_value"] for p in moved["paired_values"])
    (digits,) = by_rule["excel.digit_fragment"]
    assert [(c["coordinate"], c["display_value"]) for c in digits["cells"]] == [("D6", "812345 g"), ("E6", "312345 g")]
    area = next(d for d in by_rule["excel.region.exact"] if {d["first_series"]["source_path"], d["second_series"]["source_path"]} == {"f", "g"})
    assert area["first_series"]["coordinates"] == ["D3:E4"] and [(p["position"], p["first_coordinate"], p["first_value"]) for p in area["paired_values"]] == [("1,1", "D3", "10"), ("1,2", "E3", "6"), ("2,1", "D4", "7.25"), ("2,2", "E4", "10")]
    assert all(len(d["paired_values"]) == d["matched_count"] for d in by_rule["excel.series.fragment_exact"])
    assert all(len(d["paired_values"]) == 1 for d in by_rule["excel.cell.target_operation"])


def test_report_and_feedback_read_back(spark, found, tmp_path):
    issues = spark.createDataFrame([("x.xls", "no reader", "error")], ISSUES)
    owner = project.Project("p").with_sources("a", "b")
    book = exports.report(found, issues, owner, "v")
    assert list(book) == ["Overview", "Findings", "Image evidence", "Numeric evidence", "Issues", "Sources"] and len(book["Image evidence"].columns) == 39
    wanted = sum(len(json.loads(r.details).get("cells") or []) + len(json.loads(r.details).get("paired_values") or []) for r in found.collect())
    assert book["Numeric evidence"].count() == wanted > 20
    digits = book["Findings"].where("rule_id = 'excel.digit_fragment'").first()
    assert json.loads(digits.details)["cells"].startswith("2 rows") and digits.place_1 == "f S D6"
    exports.write_xlsx(book, str(tmp_path / "r.xlsx"))
    with zipfile.ZipFile(tmp_path / "r.xlsx") as z:
        assert z.read("xl/worksheets/s3.xml").count(b"<row ") == wanted + 1 and z.read("xl/worksheets/s5.xml").count(b"<row ") == 3 and z.testzip() is None
    with pytest.raises(ValueError):
        exports.save_feedback(found, str(tmp_path / "f.json"))
    ids = sorted(r.finding_id for r in found.collect())
    marked = review.mark(review.mark(found, ids[0], "confirmed"), ids[1], "false_positive")
    whole = json.loads(open(exports.save_feedback(marked, str(tmp_path / "f.json"), owner, "v")).read())
    assert whole["summary"] == {"marked": 2, "confirmed": 1, "false_positive": 1, "normal": 0} and {r["finding_id"] for r in whole["feedback"]} == set(ids[:2])
    assert all(isinstance(r["evidence"], dict) and r["locations"] for r in whole["feedback"])
    with zipfile.ZipFile(exports.save_feedback(marked, str(tmp_path / "f"), owner)) as z:
        assert z.read("xl/worksheets/s1.xml").count(b"<row ") == 3


def test_image_evidence_columns(spark):
    rows = spark.createDataFrame([("i1", "image.pathology.local_reuse", [("a_10x.png", None, "page 1", False), ("b_20x.png", None, "page 1", False)], json.dumps({"first_region": "0, 0, 9, 9", "first_score": 0.5, "first_magnification": 10.0})), ("i2", "image.pixel.sha256", [], "{}")], "finding_id string, rule_id string, locations array<struct<source_path: string, sheet: string, coordinate: string, hidden_sheet: boolean>>, details string")
    (r,) = exports.image_evidence(rows).collect()
    assert (r.evidence_kind, r.relationship_class, r.first_source, r.second_page, r.first_region, r.first_tissue_fraction, r.single_band_mode, r.mirrored) == ("pathology", "local_reuse", "a_10x.png", "page 1", "0, 0, 9, 9", "0.5", False, False)


def test_picture_scan_keeps_the_strongest_rule(spark):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=64).tolist() for _ in range(4)]
    turned = np.rot90(np.array(v[0]).reshape(8, 8)).ravel().tolist()
    rows = spark.createDataFrame([(1, v[0]), (2, v[0]), (3, turned), (4, v[1]), (5, v[2])], "id long, v array<double>")
    decoded = scan.pictures_of(rows, "id", "v", scale=16).withColumn("file_sha256", F.concat("file_sha256", "source_path"))
    found = scan.image_findings(decoded, pages.page_features(decoded), Settings(image_analysis_mode="generic")).collect()
    rules = {(r.rule_id, tuple(x.source_path for x in r.locations)) for r in found}
    assert ("image.pixel.sha256", ("00000001.png", "00000002.png")) in rules
    assert ("image.global.perceptual", ("00000001.png", "00000003.png")) in rules and not any(r[0] == "image.file.sha256" for r in rules)
    frame = spark.createDataFrame(found, FINDINGS)
    assert review.only(frame, "data").count() == 0 and review.only(frame, "image", status="pending").count() == len(found)
    with pytest.raises(ValueError):
        review.only(frame, "x")


def test_a_rule_that_its_first_findings_leave_short_is_walked_on(spark, monkeypatch):
    from echotrace.plans import quality

    rows = [(f"f{i:04d}", "r1" if i % 3 else "r2", "high", 1000 - i, 1, 0.5, ["a", "b"] if i < 60 else [f"s{i % 7}"]) for i in range(200)]
    found = spark.createDataFrame(rows, "finding_id string, rule_id string, risk string, matched_count int, distinct_count int, confidence double, sheets array<string>")
    want = sorted(r.finding_id for r in quality.diverse(found, limit=20, per_scope=3).collect())
    monkeypatch.setattr(quality, "WALKED", 2)
    assert sorted(r.finding_id for r in quality.diverse(found, limit=20, per_scope=3).collect()) == want
    plain = []
    for rule in ("r1", "r2"):
        used, n = {}, 0
        for f, _, _, _, _, _, sheets in (r for r in rows if r[1] == rule):
            if n < 20 and any(used.get(s, 0) < 3 for s in sheets):
                plain.append(f)
                n += 1
                for s in sheets:
                    used[s] = used.get(s, 0) + 1
    assert want == sorted(plain)
