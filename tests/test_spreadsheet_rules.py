"""The rules on small sheets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.functions import expr as X
from echotrace.model import Settings
from echotrace.operators import regions, series, values
from echotrace.plans import quality, review, scan
from echotrace.sources import sheets


def cells(spark, *columns, header=True, sheet="S", path="f", formulas=None, headers=None):
    rows = []
    for c, column in enumerate(columns, 1):
        for r, v in enumerate(column, 2 if header else 1):
            text = sheets.canonical_text(v)
            name = (headers or [f"h{c}"] * 99)[c - 1 if headers else 0] if header else None
            formula = formulas(c, r) if formulas else None
            rows.append((path, sheet, r, c, f"{sheets.letters(c)}{r}", text, text, False, name, 1 if header else None, formula))
    from echotrace.model import CELLS

    return spark.createDataFrame(rows, CELLS)


def relation(spark, first, second, settings=Settings(), **kw):
    lines = series.build(cells(spark, first, second, **kw), settings.medium_run_length)
    return {r.rule_id.removeprefix("excel.series."): r for r in series.relations(lines, settings).collect()}


def test_settings_are_checked():
    for bad in ({"minimum_digit_run": 2}, {"custom_relative_tolerance_percent": 101}, {"absolute_tolerance": 0}, {"operation_targets": ()}, {"medium_run_length": 1}, {"high_run_length": 3}, {"scan_mode": "x"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert Settings(operation_targets=(10, 1, 10)).operation_targets == (1.0, 10.0)


@pytest.mark.parametrize(("value", "text"), [("1.500", "1.5"), ("-0.0", "0"), ("1e3", "1000"), ("0.000100", "0.0001"), ("nan", None), (True, None), ("x", None), ("-12.340", "-12.34")])
def test_canonical_text(value, text):
    assert sheets.canonical_text(value) == text


def test_exact_values_leave_out_zero_and_one(spark):
    found = values.exact_values(cells(spark, [2.5, 0, 1, 3.5], [2.5, 0, 1, 3.5])).collect()
    assert {(r.canonical_value, r.cell_count) for r in found} == {("2.5", 2), ("3.5", 2)}


def test_exact_rows(spark):
    both = cells(spark, [2.5, 0], [3.5, 1]).unionByName(cells(spark, [2.5, 0], [3.5, 1], sheet="T"))
    assert [(r.signature, r.row_count) for r in values.exact_rows(both).collect()] == [("1=2.5;2=3.5", 2)]


@pytest.mark.parametrize(("numbers", "fragment"), [([58093, 78093], "8093"), ([3871206, 5871209], "87120"), ([6405917283, 2405917288], "40591728"), ([-7068, 70.68], "7068"), ([50285028, 50285028], None), ([386, 9386], None)])
def test_digit_fragments(spark, numbers, fragment):
    found = values.digit_fragments(cells(spark, numbers, header=False)).collect()
    assert [r.first_fragment for r in found] == ([fragment] if fragment else [])


@pytest.mark.parametrize(("numbers", "band"), [([730, 730.06], "0.01%"), ([730, 730.6], "0.1%"), ([730, 736], "1%"), ([0, 3e-13], "absolute"), ([730, 741], None), ([-52, -52.4], "1%")])
def test_approximate_bands(spark, numbers, band):
    assert [r.band for r in values.approximate_clusters(cells(spark, numbers)).collect()] == ([band] if band else [])


def test_custom_band(spark):
    settings = Settings(custom_relative_tolerance_percent=3)
    assert [r.band for r in values.approximate_clusters(cells(spark, [64, 65.7]), settings).collect()] == ["custom 3%"]


def test_clusters_cross_powers_of_two_and_do_not_overlap(spark):
    numbers = [100 * 1.0009**i for i in range(80)]
    got = sorted((r.anchor, r.last, r.distinct_values) for r in values.approximate_clusters(cells(spark, numbers)).where("band = '0.1%'").collect())
    kept, i = [], 0
    numbers = sorted(float(sheets.canonical_text(x)) for x in numbers)
    while i < len(numbers):
        j = i + 1
        while j < len(numbers) and numbers[j] <= numbers[i] / 0.999:
            j += 1
        if j - i > 1:
            kept.append((numbers[i], numbers[j - 1], j - i))
        i = j
    assert got == kept


@pytest.mark.parametrize(
    ("first", "second", "rule", "parameter"),
    [
        ([3, 7, 8, 13], [10.5, 24.5, 28, 45.5], "scale", 3.5), ([2, 9, 11, 6], [15.25, 22.25, 24.25, 19.25], "offset", 13.25), ([310, 455, 872, 19], [690, 545, 128, 981], "target_sum", 1000),
        ([4, 25, 8, 16], [25, 4, 12.5, 6.25], "target_product", 100), ([31, 56, 77, 90], [21, 46, 67, 80], "target_difference", 10), ([120, 37, 86, 55], [12, 3.7, 8.6, 5.5], "target_quotient", 10), ([5.5, 2, 9, 4], [5.5, 2, 9, 4], "exact", 1),
    ],
)
def test_relations(spark, first, second, rule, parameter):
    found = relation(spark, first, second)[rule]
    assert found.parameter == pytest.approx(parameter) and found.risk == "high" and found.matched_count == 4


def test_short_series(spark):
    assert relation(spark, [4, 9, 5], [28, 63, 35])["scale"].risk == "medium"
    assert relation(spark, [7, 9], [10.5, 13.5], Settings(medium_run_length=2, high_run_length=3))["scale"].risk == "medium"


def test_products_of_zero_do_not_count(spark):
    assert "target_product" not in relation(spark, [6, 0, 0, 8], [0, 9, 2, 0])


def test_many_series_meet_by_shape(spark):
    some = None
    for k in range(260):
        base = [(7 * k + i * i * (k + 3)) % 1009 + 1 for i in range(5)]
        one = cells(spark, base, sheet=f"s{k:03d}")
        some = one if some is None else some.unionByName(one) if k < 2 else some
    rows = [("f", f"s{k:03d}", r + 2, 1, f"A{r + 2}", str(v), str(v), False, "h", 1, None) for k in range(260) for r, v in enumerate([(7 * k + i * i * (k + 3)) % 1009 + 1 for i in range(5)] if k != 259 else [3 * ((i * i * 3) % 1009 + 1) for i in range(5)])]
    from echotrace.model import CELLS

    lines = series.build(spark.createDataFrame(rows, CELLS), 3)
    found = series.relations(lines).where("rule_id = 'excel.series.scale' and second.sheet = 's259'").collect()
    assert any(r.first.sheet == "s000" and r.parameter == pytest.approx(3) for r in found)


def test_shuffled_near_and_linear(spark):
    lines = lambda a, b: series.build(cells(spark, a, b), 3)
    moved = series.shuffled(lines([15, 27, 31, 48], [31, 15, 48, 27])).first()
    assert (moved.matched_count, moved.order_changed_count) == (4, 4)
    near = series.near_duplicates(series.pattern_pairs(lines([14, 63, 25, 87, 31], [14, 63, 25, 87, 40]))).first()
    assert (near.matched_count, near.mismatch_count) == (4, 1)
    loose = Settings(custom_relative_tolerance_percent=0.2)
    near = series.near_duplicates(series.pattern_pairs(lines([250, 130, 710, 480, 365], [250.25, 130.13, 710.71, 480.48, 365.365])), loose).first()
    assert (near.matched_count, near.mismatch_count, near.out_of_tolerance_count) == (5, 5, 0)
    line = series.linear(series.pattern_pairs(lines([2, 5, 7, 8, 11], [9, 21, 29, 33, 90]))).first()
    assert (line.slope, line.intercept, line.matched_count, line.outlier_count) == (4, 1, 4, 1)


def test_statistics(spark):
    lines = lambda a, b: series.build(cells(spark, a, b), 3)
    alike = series.statistics(series.pattern_pairs(lines(list(range(1, 11)), [25, 1, 28, 4, 22, 7, 19, 10, 16, 13]))).first()
    assert alike.correlation > 0.999
    same = series.statistics(series.pattern_pairs(lines([-1] * 4 + [1] * 4, [-2, 0, 0, 0, 0, 0, 0, 2]))).first()
    assert same.summary_match and same.mean_first == 0 and same.sd_first == 1


def test_fragments(spark):
    found = series.fragments(series.build(cells(spark, [52, 18, 47, 63, 29], [71, 18, 47, 63, 36]), 3)).collect()
    assert [(r.matched_count, r.first_begin, r.second_begin, r.risk) for r in found] == [(3, 2, 2, "medium")]
    whole = series.fragments(series.build(cells(spark, [12, 35, 21, 54], [12, 35, 21, 54]), 3)).collect()
    assert whole == []


def test_regions(spark):
    grid = [[14, 27, 35], [41, 58, 62], [73, 89, 96]]
    found = regions.exact_regions(cells(spark, *grid).unionByName(cells(spark, *grid, sheet="T"))).collect()
    assert [(r.height, r.width, r.area) for r in found] == [(3, 3, 9)]


def test_cell_operations(spark):
    found = {(r.operation, r.first, r.second, r.target) for r in values.cell_operations(cells(spark, [3.75, 6.25])).collect()}
    assert ("add", 3.75, 6.25, 10) in found
    found = {(r.operation, r.first, r.second, r.target) for r in values.cell_operations(cells(spark, [5, 5])).collect()}
    assert ("add", 5, 5, 10) in found and not any(x[0] in ("subtract", "divide") for x in found)


def test_derived_column_is_normal(spark):
    raw, derived = [70, 30, 90, 40], [7, 3, 9, 4]
    by_formula = relation(spark, raw, derived, formulas=lambda c, r: f"=A{r}/10" if c == 2 else None)
    assert set(by_formula) == {"normal_derived"} and by_formula["normal_derived"].derived_by == "formula"
    by_header = relation(spark, raw, derived, headers=["raw", "rescaled"])
    assert set(by_header) == {"normal_derived"} and by_header["normal_derived"].derived_side == "second"


@pytest.mark.parametrize(("formula", "hit"), [("=A3/10", True), ("=SUM($A$1:$B$9)", True), ("='My sheet'!A3", True), ('="A3"', False), ("=B3", False), (None, False)])
def test_references(spark, formula, hit):
    row = spark.createDataFrame([(formula,)], "f string").select(X.covers(X.operands(F.col("f")), F.lit(1), F.lit(3)).alias("hit")).first()
    assert row.hit is hit


def test_operands_equal_a_plain_reading(spark):
    import random
    import re

    rng, cell = random.Random(3), lambda r: f"{r.choice(['', '$'])}{r.choice(['A', 'b', 'Z', 'AA', 'xfd', 'BC'])}{r.choice(['', '$'])}{r.randint(1, 40)}"
    formulas = [rng.choice(["=", "=-", "=SUM("]) + rng.choice(["+", ",", "*", '&"A1"&']).join(cell(rng) + rng.choice(["", ":" + cell(rng)]) for _ in range(rng.randint(1, 4))) for _ in range(80)] + ["", "=1+2", "='it s'!A1:B2", None]

    def number(letters):
        n = 0
        for c in letters.upper():
            n = n * 26 + ord(c) - 64
        return n

    want = []
    for f in formulas:
        boxes = []
        for a, b, c, d in re.findall(X.OPERAND, re.sub('"[^"]*"', '""', f or "")):
            x, y = sorted((number(a), number(c or a))), sorted((int(b), int(d or b)))
            boxes.append((x[0], y[0], x[1], y[1]))
        want.append(boxes)
    got = spark.createDataFrame(list(enumerate(formulas)), "i int, f string").select("i", X.operands(F.col("f")).alias("o")).orderBy("i").collect()
    assert [[tuple(b) for b in r.o] for r in got] == want and sum(map(len, want)) > 100


def test_running_numbers_go(spark):
    both = cells(spark, [1, 2, 3, 4], [7, 8, 9, 11], headers=["ID", "No"])
    kept = series.drop_index_columns(both)
    assert {r.column for r in kept.collect()} == {2}


def test_headers_fill_down(spark):
    rows = spark.createDataFrame([("f", "s", 1, 1, "a"), ("f", "s", 1, 2, None), ("f", "s", 1, 3, "b"), ("f", "s", 1, 4, None), ("f", "s", 2, 2, None)], "source_path string, sheet string, column int, row int, header string")
    got = {(r.column, r.row): (r.column_header, r.header_row) for r in series.fill_headers(rows).collect()}
    assert got[1, 2] == ("a", 1) and got[1, 4] == ("b", 3) and got[2, 2] == (None, None)


def test_attention_queue_and_review(spark):
    rows = [(f"f{i:03d}", "excel.row.exact", "exact_duplicate", "high", 2, 2, 1.0, True, [f"b{i}"], [f"b{i}|s"]) for i in range(70)]
    found = spark.createDataFrame(rows, "finding_id string, rule_id string, finding_type string, risk string, matched_count int, distinct_count int, confidence double, relation_group_primary boolean, workbooks array<string>, sheets array<string>")
    tiers = dict(quality.attention(found).groupBy("attention_tier").count().collect())
    assert tiers == {"primary": 16, "secondary": 54}
    one_sheet = found.withColumns({"workbooks": F.array(F.lit("b")), "sheets": F.array(F.lit("b|s"))})
    assert dict(quality.attention(one_sheet).groupBy("attention_tier").count().collect())["primary"] == 3
    assert quality.diverse(one_sheet).count() == 6 and quality.diverse(found).count() == 70
    marks = found.withColumn("review_status", F.lit("pending"))
    done = review.mark(marks, "f003", "confirmed")
    assert [r.finding_id for r in review.marked(done).collect()] == ["f003"]
    assert review.carry_forward(marks, done).where("review_status = 'confirmed'").count() == 1
    assert review.carry_forward(marks, done, same_version=False).where("review_status = 'confirmed'").count() == 0
    with pytest.raises(KeyError):
        review.mark(marks, "none", "confirmed")


def test_whole_scan(spark):
    both = cells(spark, [310, 620.2, 933, 1240, 70617.5], [620, 1240.4, 1866, 2480, 141235], [310.02, 88061755, 933, 9, 13])
    found = scan.scan_cells(both).collect()
    rules = {r.rule_id for r in found}
    assert {"excel.series.scale", "excel.value.exact", "excel.digit_fragment", "excel.value.approximate"} <= rules
    assert all(len(r.finding_id) == 20 for r in found) and len({r.finding_id for r in found}) == len(found)
    near = next(r for r in found if r.rule_id == "excel.value.approximate" and '"310"' in r.details)
    assert {x.coordinate for x in near.locations} == {"A2", "C2"} and '"tolerance_band":"0.01%"' in near.details
    shared = {tuple(sorted(x.coordinate for x in r.locations)): r for r in found if r.rule_id == "excel.digit_fragment"}
    assert shared["A6", "C3"].risk == "medium" and '"fragments":["06175","61755"]' not in shared["A6", "C3"].details and '"maximum_length":6' not in shared["A6", "C3"].details
    assert quality.primary_count(scan.scan_cells(both)) == sum(r.attention_tier == "primary" for r in found)


def test_rules_end_at_their_limit(spark, monkeypatch):
    monkeypatch.setattr(scan, "RULE_LIMIT", 5)
    near = [700 * 2**i + d * 2**i for i in range(10) for d in (0, 0.03 + i / 100)]
    many = cells(spark, [10_000_000 * (i + 3) + 1234 + 7 * i for i in range(40)], near)
    found = scan.scan_cells(many)
    counts = dict(found.groupBy("rule_id").count().collect())
    assert counts["excel.value.approximate"] == 5 and counts["excel.digit_fragment"] == 5
    best = values.digit_fragments(many).orderBy(F.desc("maximum_length"), F.desc("distinct_values"), F.desc("cell_count")).limit(5)
    longest = sorted(F_ for (F_,) in best.select("maximum_length").collect())
    got = sorted(r.n for r in found.where("rule_id = 'excel.digit_fragment'").select(F.get_json_object("details", "$.maximum_length").cast("int").alias("n")).collect())
    assert got == longest


def test_many_values_and_a_target_of_zero(spark):
    """A product of 0 asks every value for the same partner; the nearest values equal a plain search."""
    import bisect


    n = 100_000
    df = spark.range(n).select((F.col("id") * 7 % n / 4 - 9000).alias("v"))
    held = sorted(i * 7 % n / 4 - 9000 for i in range(n))
    asked = [(float(i), w) for i, w in enumerate([-1e9, -9000.0, -0.01, 0.01, 0.125, 3.3, 15999.75, 1e9, *(k * 1.37 - 8000 for k in range(300))])]
    got = {r.a: r.v for r in values._nearest(spark.createDataFrame(asked, "a double, w double"), df).collect()}
    for a, w in asked:
        at = bisect.bisect_left(held, w)
        want = min((abs(x - w), x) for x in held[max(0, at - 1) : at + 1])[1]
        assert got[a] == want
    cells = df.select(F.col("v").cast("string").alias("canonical_value"))
    found = values.cell_operations(cells, Settings(operation_targets=(0.0, 31999.5)))
    rows = {(r.operation, r.first, r.second, r.target) for r in found.where("target = 31999.5 or operation = 'add'").collect()}
    assert ("add", 15999.75, 15999.75, 31999.5) not in rows and ("add", -3.25, 3.25, 0.0) in rows and ("add", -9000.0, 9000.0, 0.0) in rows
    assert found.where("operation = 'multiply' and target = 0").count() == 0  # a factor of 0 is trivial


def test_ranges_by_halving(spark):

    cuts = [float(x) for x in range(0, 3000, 2)]
    df = spark.createDataFrame([(x / 2,) for x in range(-4, 6200, 3)], "v double")
    for some in ([], cuts[:1], cuts[:255], cuts):
        got = df.select("v", values._range_of(F.col("v"), some).alias("r")).collect()
        assert all(r.r == sum(c < r.v for c in some) for r in got)


def test_copies_of_series_are_compared_once(spark, monkeypatch):
    from echotrace.model import CELLS

    kinds = [lambda i: 7 + i * i, lambda i: 2 * (7 + i * i), lambda i: 50 - i * i]
    rows = [("f", f"s{k:03d}", r + 2, 1, f"A{r + 2}", str(kinds[k % 3](r)), str(kinds[k % 3](r)), False, "h", 1, None) for k in range(270) for r in range(5)]
    compared, before = [], series._related
    monkeypatch.setattr(series, "_related", lambda pairs, *rest: compared.append(pairs.count()) or before(pairs, *rest))
    found = series.relations(series.build(spark.createDataFrame(rows, CELLS), 3))
    counts = {r.rule_id.removeprefix("excel.series."): r["count"] for r in found.groupBy("rule_id").count().collect()}
    assert compared == [9]  # three classes in both directions, and each with itself
    assert {k: counts[k] for k in ("exact", "scale")} == {"exact": 3 * 90 * 89 // 2, "scale": 90 * 90}
    assert found.where("first.sheet >= second.sheet").count() == 0


def _plain(spark, values):
    from echotrace.model import CELLS

    rows = [("f", f"s{k:04d}", r, 1, f"A{r}", str(v), str(v), False, "h", 1, None) for k, vs in enumerate(values) for r, v in enumerate(vs, 2)]
    return series.build(spark.createDataFrame(rows, CELLS), 3)


def test_patterns_of_many_series_miss_no_pair(spark, monkeypatch):
    draw = __import__("random").Random(5)
    base = [[draw.randint(1, 50) for _ in range(12)] for _ in range(300)]  # beyond ALL_PAIRS
    base[7], base[250] = base[3], [v + 900 * (i == 0) for i, v in enumerate(base[90])]  # equal; the first value differs, so shapes do
    base[251] = [3 * v + 2 + 700 * (i in (0, 6)) for i, v in enumerate(base[3])]
    base[252] = [v + 60 for v in reversed(base[140])]
    monkeypatch.setattr(series, "BLOCK_SERIES", 64)  # several blocks
    lines = _plain(spark, base)
    named = lambda rule: {(r.first.sheet, r.second.sheet) for r in series.of_all_pairs(lines, rule).collect()}
    assert named(series.near_duplicates) == {("s0090", "s0250")}
    assert named(series.linear) >= {("s0003", "s0251"), ("s0007", "s0251")}
    assert named(series.statistics) >= {("s0140", "s0252")}


@pytest.mark.parametrize("rule", [series.near_duplicates, series.linear, series.statistics])
def test_patterns_of_all_pairs_are_those_of_few(spark, rule):
    settings = Settings(custom_relative_tolerance_percent=3) if rule is series.linear else Settings()
    draw = __import__("random").Random(11)
    base = [[draw.randint(1, 4) * 10 ** draw.randint(0, 2) for _ in range(draw.choice((4, 5, 8, 10)))] for _ in range(60)]
    base += [[3 * v + 5 for v in x] for x in base[:20]] + [[v + (i == 1) for i, v in enumerate(x)] for x in base[:20]] + [[1e9 + v for v in x] for x in base[:10]] + base[:10]
    lines = _plain(spark, base)
    measures = lambda r: sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.asDict().items() if k not in ("first", "second"))
    rows = lambda df: sorted((r.first.sheet, r.second.sheet, measures(r)) for r in df.collect())
    expected = rows(rule(series.pattern_pairs(lines), settings))
    assert expected and rows(series.of_all_pairs(lines, rule, settings)) == expected


def test_copies_of_sheets_are_compared_once(spark, monkeypatch):
    grid = [[14, 27, 35, 14, 27], [41, 58, 62, 41, 58]]  # the first rows come again
    rows, both = [], {}
    for k in range(8):  # six copies, and two that lie two rows lower
        for c, column in enumerate(grid, 1):
            for r, v in enumerate([1, 3][:2 * (k > 5)] + column, 2):
                rows.append(("f", f"s{k}", r, c, f"{sheets.letters(c)}{r}", str(v), str(v), False, "h", 1, None))
                both[f"s{k}", r, c] = v
    from echotrace.model import CELLS

    df, met = spark.createDataFrame(rows, CELLS), []
    before = type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *rest, **more: met.append(self.count()) or before(self, *rest, **more))
    found = regions.exact_regions(df).collect()
    assert met[0] < 60  # 28 pairs of sheets hold 4 to 6 hits each
    for x in found:
        assert (x.a_source_path, x.a_sheet, x.a_row, x.a_column) < (x.b_source_path, x.b_sheet, x.b_row, x.b_column)
        assert all(both[x.a_sheet, x.a_row + i, x.a_column + j] == both[x.b_sheet, x.b_row + i, x.b_column + j] for i in range(x.height) for j in range(x.width))
    whole = {(x.a_sheet, x.b_sheet) for x in found if x.height >= 5}
    assert whole == {(f"s{i}", f"s{j}") for i in range(8) for j in range(i + 1, 8)}
    assert len(found) == len({tuple(x) for x in found}) and sum(x.a_sheet == x.b_sheet for x in found) == 8


def test_relations_read_their_series_from_one_table(spark, monkeypatch):
    from echotrace.model import CELLS

    def sheets_of(headers, formula=None):
        rows = []
        for k in range(6):
            for c, f in ((1, 1), (2, 2)):
                for r in range(5):
                    v = str(f * (7 + r * r))
                    rows.append(("f", f"s{k}", r + 2, c, f"{sheets.letters(c)}{r + 2}", v, v, False, headers(k, c), 1, f"=A{r + 2}*2" if formula == k and c == 2 else None))
        return series.build(spark.createDataFrame(rows, CELLS), 3)

    def named(lines):
        found = series.relations(lines, wanted=("scale",)).select(F.col("first.sheet").alias("a"), F.col("second.sheet").alias("b"), "rule_id", "derived_side")
        text = found._jdf.queryExecution().executedPlan().toString()
        return text, sorted(((r.a, r.b, r.rule_id.removeprefix("excel.series."), r.derived_side) for r in found.collect()), key=lambda x: x[:3])

    every = sorted((f"s{min(i, j)}", f"s{max(i, j)}", "scale", None) for i in range(6) for j in range(6))
    for share in (256, 1):  # one task, or one for each member
        monkeypatch.setattr(series, "SHARE_SERIES", share)
        text, plain = named(sheets_of(lambda k, c: "h"))
        assert plain == every
        assert "collect_list" not in text and "formulas" not in text  # cells are gathered once, and no formulas travel
        for lines, at in ((sheets_of(lambda k, c: "ratio" if (k, c) == (3, 2) else "h"), 3), (sheets_of(lambda k, c: "h", formula=4), 4)):
            text, some = named(lines)
            one = (f"s{at}", f"s{at}", "normal_derived", "second")
            assert some == sorted([one, *(x for x in every if x[:2] != one[:2])], key=lambda x: x[:3])
            assert "collect_list" not in text


@pytest.mark.parametrize("settings", [Settings(), Settings(custom_relative_tolerance_percent=1), Settings(absolute_tolerance=0.5)])
def test_relations_of_many_series_are_those_of_all_pairs(spark, monkeypatch, settings):
    draw = __import__("random").Random(9)
    base = [[draw.randint(1, 900) / 4 for _ in range(4)] for _ in range(300)]  # more than were all compared before
    x, off = base[5], 1 + 8e-10
    base[260:267] = [[2 * v for v in x], [v + 60 for v in x], [1000 - v for v in x], [100 / v for v in x], [v - 10 for v in x], [v / 10 for v in x], [-3 * v for v in x]]
    base[267:270] = [[2 * v * (off if i % 2 else 1) for i, v in enumerate(x)], [100 / v * (off if i == 2 else 1) for i, v in enumerate(x)], [x[0] * off + 60, *(v + 60 for v in x[1:])]]  # within tolerance
    base[270], base[271], base[272] = [0, 3, 0, 5], [0, 6, 0, 10], [1e9 + v for v in x]
    monkeypatch.setattr(series, "BLOCK_SERIES", 64)  # several blocks
    found = series.relations(_plain(spark, base), settings).select(F.col("first.sheet").alias("i"), F.col("second.sheet").alias("j"), "rule_id", "parameter").collect()
    i, j = np.triu_indices(len(base), 1)
    a, b = np.array(base)[i], np.array(base)[j]
    with np.errstate(all="ignore"):
        expected = series._Relations(settings).found(a, b, (a == b).all(1))
    pairs = {(f"s{i[k]:04d}", f"s{j[k]:04d}", f"excel.series.{rule}"): v[k] for rule, v in expected.items() for k in np.flatnonzero(~np.isnan(v))}
    assert {(r.i, r.j, r.rule_id): r.parameter for r in found} == pairs and len(found) == len(pairs)
    assert {r.rule_id for r in found} >= {f"excel.series.{r}" for r in series.RELATIONS if r != "exact"}


def test_a_relation_alone_is_that_of_all(spark):
    base = [[3, 8, 5, 20], [6, 16, 10, 40], [13, 18, 15, 30], [97, 92, 95, 80], [100 / 3, 12.5, 20, 5], [30, 80, 50, 200], [3, 8, 5, 20]]
    lines = _plain(spark, base)
    named = lambda df: sorted((r.first.sheet, r.second.sheet, r.rule_id, r.parameter) for r in df.collect())
    every = named(series.relations(lines))
    assert {r[2].removeprefix("excel.series.") for r in every} == set(series.RELATIONS)
    for rule in series.RELATIONS:
        assert named(series.relations(lines, wanted=(rule,))) == [r for r in every if r[2] == f"excel.series.{rule}"]


def test_statistics_of_classes_leave_their_values_behind(spark):
    draw = __import__("random").Random(4)
    base = [[draw.randint(1, 50) + 1000 * (i % 3 == 0) for i in range(9)] for _ in range(30)]
    base += [[5, 5, 5, 5, 5, 5, 5, 5, 1e9], base[3], base[4][::-1], [0.1 * v for v in base[5]]]
    lines = _plain(spark, base)
    found = series.of_all_pairs(lines, series.statistics, places=6)
    text = found.select("first.sheet", "second.sheet", "correlation")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in text and "BroadcastHashJoin [first_class" not in text  # what was found is as much as pairs of classes
    top = text[: text.index("SortMergeJoin")]
    assert "round(" not in top  # members are far more than what was found
    measures = lambda r: (r.first.sheet, r.second.sheet, r.summary_match, *(round(r[c], 6) for c in ("correlation", "normalized_mae", "mean_first", "mean_second", "sd_first", "sd_second")))
    expected = sorted(measures(r) for r in series.statistics(series.pattern_pairs(lines)).collect())
    assert expected and sorted(measures(r) for r in found.collect()) == expected
