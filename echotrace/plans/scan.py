"""A whole scan: cells and pictures to findings, with issues beside them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import close, digit_risk, finding_id, relative_error, series_location, stable_key
from echotrace.model import BANDS, ISSUES, RULE_LIMIT, Settings
from echotrace.operators import regions, series, values
from echotrace.plans import evidence, quality
from echotrace.sources import sheets
from echotrace.vision import pages, scan as pictures

VERSION = "echotrace-1"
#: Confidences of rules that have one value.
CONFIDENCE = {"excel.value.exact": 1.0, "excel.row.exact": 1.0, "excel.cell.target_operation": 0.55, "excel.series.fragment_exact": 0.96, "excel.series.shuffled": 0.9, "excel.series.linear": 0.78, "excel.region.exact": 0.98, "excel.series.statistics": 0.45}


def _finding(df: DataFrame, rule: Column | str, kind: Column | str, risk: Column | str, title: str, locations: Column, confidence: Column, details: Column, matched: Column, distinct: Column, shown: dict[str, Column] | None = None) -> DataFrame:
    """FINDINGS rows with matched_count, distinct_count, workbooks and sheets for the quotas. shown: evidence, in the details but not in the description."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    out = df.select(lit(rule).alias("rule_id"), lit(kind).alias("finding_type"), lit(risk).alias("risk"), F.lit(title).alias("title"), F.array_sort(locations).alias("locations"), confidence.cast("double").alias("confidence"), F.to_json(details).alias("brief"), F.to_json(F.struct(*(v.alias(k) for k, v in (shown or {}).items()))).alias("shown") if shown else F.lit(None).cast("string").alias("shown"), matched.cast("long").alias("matched_count"), distinct.cast("long").alias("distinct_count"))
    keys = F.transform("locations", stable_key)
    whole = F.concat(F.expr("substring(brief, 1, length(brief) - 1)"), F.when(F.length("brief") > 2, ",").otherwise(""), F.expr("substring(shown, 2)"))
    out = out.withColumn("details", F.coalesce(whole, "brief"))
    return out.select(
        finding_id(F.col("rule_id"), keys).alias("finding_id"), "rule_id", "finding_type", "risk", "title", F.concat_ws(": ", "title", "brief").alias("description"), "locations", "confidence", "details",
        F.lit("pending").alias("review_status"), "matched_count", "distinct_count", F.array_distinct(F.transform("locations", lambda x: x.source_path)).alias("workbooks"),
        F.array_distinct(F.transform("locations", lambda x: F.concat_ws("|", x.source_path, F.coalesce(x.sheet, F.lit(""))))).alias("sheets"),
    )


def _pairs(df: DataFrame, rule: Column | str, kind: Column | str, title: str, confidence: Column, extra: dict[str, Column], distinct: Column, paired: Column, risk: Column | str = "") -> DataFrame:
    locations = F.array(series_location("first"), series_location("second"))
    details = F.struct(*(v.alias(k) for k, v in extra.items()))
    return _finding(df, rule, kind, F.col("risk") if risk == "" else risk, title, locations, confidence, details, extra["matched_count"], distinct, _series(paired))


def _series(paired: Column, *cut: Column) -> dict[str, Column]:
    """Both series, or the runs of them that cut gives (first begin, second begin, length), with their values side by side."""
    first, second = (evidence.side("first", cut[0], cut[2]), evidence.side("second", cut[1], cut[2])) if cut else (evidence.side("first"), evidence.side("second"))
    return {"first_series": first, "second_series": second, "paired_values": paired}


def data_findings(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """All spreadsheet rules. Value, row and digit rules see every cell; series rules leave out running numbers.

    Digit fragments and approximate values are the RULE_LIMIT strongest, patterns the RULE_LIMIT strongest of each rule in turn of their sheets.
    """
    place = F.struct("source_path", "sheet", "coordinate", "hidden_sheet")
    by_value = cells.select("canonical_value", "display_value", place.alias("l"))
    out = []
    found = values.exact_values(cells)
    members = by_value.join(found, "canonical_value").groupBy("canonical_value").agg(F.collect_list("l").alias("ls"), F.max("cell_count").alias("n"))
    out.append(_finding(members, "excel.value.exact", "exact_duplicate", "low", "equal values", F.col("ls"), F.lit(1.0), F.struct(F.col("canonical_value").alias("value"), F.col("n").alias("count")), F.col("n"), F.lit(1)))
    rows = values.row_signatures(cells).join(values.exact_rows(cells).select("signature"), "signature")
    hidden = cells.groupBy("source_path", "sheet").agg(F.max("hidden_sheet").alias("hidden_sheet"))
    rows = rows.join(hidden, ["source_path", "sheet"]).withColumn("l", F.struct("source_path", "sheet", F.concat(F.lit("row "), "row").alias("coordinate"), "hidden_sheet"))
    rows = rows.groupBy("signature").agg(F.collect_list("l").alias("ls"), F.max("cell_count").alias("c"), F.count("*").alias("n"))
    out.append(_finding(rows, "excel.row.exact", "exact_duplicate", "high", "equal rows", F.col("ls"), F.lit(1.0), F.struct(F.col("c").alias("numeric_cell_count"), F.col("n").alias("row_count")), F.col("n"), F.col("c")))
    out += [_digit_findings(cells, by_value, settings), _approximate_findings(cells, by_value, settings)]
    ops = values.cell_operations(cells, settings)
    full = F.struct("source_path", "sheet", "row", "column", "coordinate", "hidden_sheet", "canonical_value")
    first_place = cells.groupBy(F.col("canonical_value").cast("double").alias("v")).agg(F.min(full).alias("a"), F.max(full).alias("z"))
    at = lambda c: F.struct(c.source_path.alias("source_path"), c.sheet.alias("sheet"), c.coordinate.alias("coordinate"), c.hidden_sheet.alias("hidden_sheet"))
    ops = ops.join(first_place.select(F.col("v").alias("first"), F.col("a").alias("p")), "first").join(first_place.select(F.col("v").alias("second"), F.col("a").alias("qa"), F.col("z").alias("qz")), "second")
    ops = ops.withColumn("q", F.when(F.col("first") == F.col("second"), F.col("qz")).otherwise(F.col("qa")))
    patterns = []
    patterns.append(_finding(ops, "excel.cell.target_operation", "suspected_reuse", "low", "operation gives a target", F.array(at(F.col("p")), at(F.col("q"))), F.lit(0.55), F.struct("operation", F.col("target").alias("parameter"), F.col("result").alias("relation_result")), F.lit(1), F.lit(2), evidence.of_operation(F.col("p"), F.col("q"))))
    lines = series.build(series.drop_index_columns(cells), settings.medium_run_length)
    distinct = F.size(F.array_union("first.canon", "second.canon"))
    rel = evidence.relation_results(series.relations(lines, settings))
    normal = F.col("rule_id") == "excel.series.normal_derived"
    out.append(_pairs(rel, F.col("rule_id"), F.when(normal, "normal_relation").when(F.col("rule_id") == "excel.series.exact", "exact_duplicate").otherwise("suspected_reuse"), "related series", F.when(normal & (F.col("derived_by") == "formula"), 0.98).when(normal, 0.9).when(F.col("risk") == "high", 0.92).otherwise(0.82), {"parameter": F.col("parameter"), "matched_count": F.col("matched_count"), "derived_side": F.col("derived_side"), "detected_rule": F.when(normal, F.col("relation"))}, distinct, F.col("paired_values")))
    patterns.append(_pairs(series.shuffled(lines, settings), "excel.series.shuffled", "suspected_reuse", "reordered series", F.lit(0.9), {"matched_count": F.col("matched_count"), "order_changed_count": F.col("order_changed_count")}, distinct, evidence.by_value()))
    pairs = series.pattern_pairs(lines)
    patterns.append(_pairs(series.near_duplicates(pairs, settings), "excel.series.near_duplicate", "suspected_reuse", "nearly equal series", F.col("confidence"), {"matched_count": F.col("matched_count"), "mismatch_count": F.col("mismatch_count"), "similarity": F.col("similarity")}, distinct, evidence.in_order(lambda x, y: F.when(close(x["v"], y["v"], settings), evidence.CLOSE).otherwise(evidence.APART))))
    patterns.append(_pairs(series.linear(pairs, settings), "excel.series.linear", "suspected_reuse", "linear series", F.lit(0.78), {"slope": F.col("slope"), "intercept": F.col("intercept"), "matched_count": F.col("matched_count"), "outlier_count": F.col("outlier_count")}, distinct, evidence.in_order(lambda x, y: F.col("slope") * x["v"] + F.col("intercept"))))
    patterns.append(_pairs(series.statistics(pairs, settings), "excel.series.statistics", "statistical_anomaly", "alike distributions", F.lit(0.45), {"distribution_correlation": F.col("correlation"), "normalized_mae": F.col("normalized_mae"), "summary_match": F.col("summary_match"), "matched_count": F.col("first.n")}, distinct, evidence.by_rank(), "low"))
    whole = lines.select(F.col("series_id"), F.struct(*lines.columns).alias("s"))
    frag = series.fragments(lines, settings).join(whole.select(F.col("series_id").alias("first_id"), F.col("s").alias("first")), "first_id").join(whole.select(F.col("series_id").alias("second_id"), F.col("s").alias("second")), "second_id")
    begins = F.col("first_begin"), F.col("second_begin")
    cut = F.array(series_location("first", F.col("first_begin"), F.col("matched_count")), series_location("second", F.col("second_begin"), F.col("matched_count")))
    patterns.append(_finding(frag, "excel.series.fragment_exact", "exact_duplicate", F.col("risk"), "equal runs", cut, F.lit(0.96), F.struct("matched_count"), F.col("matched_count"), F.col("matched_count"), _series(evidence.in_order(lambda x, y: F.lit(evidence.EQUAL), begins, F.col("matched_count")), *begins, F.col("matched_count"))))
    area = regions.exact_regions(cells, settings)
    for s in "ab":
        area = area.join(hidden.select(F.col("source_path").alias(f"{s}_source_path"), F.col("sheet").alias(f"{s}_sheet"), F.col("hidden_sheet").alias(f"{s}_hidden")), [f"{s}_source_path", f"{s}_sheet"])
    place_of = lambda s: F.struct(F.col(f"{s}_source_path").alias("source_path"), F.col(f"{s}_sheet").alias("sheet"), evidence.area(s).alias("coordinate"), F.col(f"{s}_hidden").alias("hidden_sheet"))
    risk = F.when(F.col("area") >= settings.high_run_length, "high").when(F.col("area") >= settings.medium_run_length, "medium").otherwise("low")
    patterns.append(_finding(area, "excel.region.exact", "exact_duplicate", risk, "equal regions", F.array(place_of("a"), place_of("b")), F.lit(0.98), F.struct(F.col("area").alias("matched_count"), F.col("height").alias("row_count"), F.col("width").alias("column_count")), F.col("area"), F.col("area"), {"first_series": evidence.corner("a"), "second_series": evidence.corner("b")}))
    held = reduce(DataFrame.unionByName, patterns).persist()  # walked rule by rule
    return reduce(DataFrame.unionByName, [*out, evidence.with_region_pairs(quality.diverse(held), cells)])


def _top(found: DataFrame, order: list[Column], ties: Column | None = None) -> DataFrame:
    """The first RULE_LIMIT in this order; all that tie with the last of them, or those whose ties come first."""
    w = Window.orderBy(*order, *([ties] if ties is not None else []))
    place = F.row_number() if ties is not None else F.rank()
    return found.withColumn("_r", place.over(w)).where(F.col("_r") <= RULE_LIMIT).drop("_r")


def _by_cells(members: DataFrame, keys: list[str], numeric: bool, by_value: DataFrame) -> DataFrame:
    """members (keys, and v or canonical_value) to keys, ls: the places of their cells, shown: the cells, vs: their values."""
    value = F.col("canonical_value").cast("double").alias("v") if numeric else F.col("canonical_value")
    placed = members.join(by_value.select(value, F.col("canonical_value").alias("c"), "display_value", "l"), "v" if numeric else "canonical_value")
    cell = F.struct("l.source_path", "l.sheet", "l.coordinate", F.col("c").alias("canonical_value"), "display_value", "l.hidden_sheet")
    found = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(cell)).alias("shown"), F.array_sort(F.collect_set("c")).alias("vs"), F.count("*").alias("cells"))
    return found.withColumn("ls", F.transform("shown", lambda x: F.struct(x.source_path.alias("source_path"), x.sheet.alias("sheet"), x.coordinate.alias("coordinate"), x.hidden_sheet.alias("hidden_sheet"))))


def _digit_findings(cells: DataFrame, by_value: DataFrame, settings: Settings) -> DataFrame:
    sets, members = values.digit_sets(cells, settings)
    order = [F.desc("maximum_length"), F.desc("distinct_values"), F.desc("cell_count")]
    kept = _top(sets, order)
    found = kept.join(_by_cells(members.join(kept.select("set_id"), "set_id"), ["set_id"], False, by_value), "set_id")
    risk = digit_risk(F.col("maximum_length"))
    details = F.struct(F.slice("runs", 1, 100).alias("fragments"), "maximum_length", F.lit(settings.minimum_digit_run).alias("minimum_configured_length"), "cell_count", F.col("distinct_values").alias("distinct_value_count"), F.col("vs").alias("values"))
    confidence = F.when(risk == "high", 0.9).when(risk == "medium", 0.7).otherwise(0.5)
    keyed = found.withColumn("_id", finding_id(F.lit("excel.digit_fragment"), F.transform(F.array_sort("ls"), stable_key)))
    return _finding(_top(keyed, order, F.col("_id")), "excel.digit_fragment", "suspected_reuse", risk, "shared digits", F.col("ls"), confidence, details, F.col("maximum_length"), F.col("distinct_values"), {"cells": F.col("shown")})


def _approximate_findings(cells: DataFrame, by_value: DataFrame, settings: Settings) -> DataFrame:
    clusters = values.approximate_clusters(cells, settings).withColumn("error", relative_error(F.col("anchor"), F.col("last")))
    order = [F.col("error"), F.desc("distinct_values")]
    kept = _top(clusters, order)
    found = _by_cells(values.approximate_members(cells, kept, settings), kept.columns, True, by_value)
    order.append(F.desc("cells"))
    keyed = found.withColumn("_id", finding_id(F.lit("excel.value.approximate"), F.transform(F.array_sort("ls"), stable_key)))
    confidence = F.coalesce(*(F.when(F.col("band") == label, c) for _, label, c in BANDS), F.when(F.col("band") == "absolute", 0.7), F.lit(0.4))
    details = F.struct(F.col("vs").alias("values"), (F.col("last") - F.col("anchor")).alias("absolute_difference"), F.col("error").alias("relative_error"), (F.col("error") * 100).alias("relative_error_percent"), F.col("band").alias("tolerance_band"), F.col("cells").alias("cell_count"), F.col("distinct_values").alias("distinct_value_count"))
    return _finding(_top(keyed, order, F.col("_id")), "excel.value.approximate", "high_similarity", "low", "nearly equal values", F.col("ls"), confidence, details, F.lit(0), F.col("distinct_values"), {"cells": F.col("shown")})


@dataclass
class Result:
    findings: DataFrame
    issues: DataFrame
    settings: Settings
    version: str = VERSION


def scan_cells(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Findings with tiers, in the order of a spreadsheet result."""
    found = data_findings(cells, settings).persist()  # the queue's walk and the result read it
    series_key = F.when(F.col("rule_id").startswith("excel.series."), F.array_join(F.transform("locations", stable_key), "\u0001"))
    return quality.attention(quality.consolidate(found, series_key)).orderBy(*quality.spreadsheet_order())


def scan(spark: SparkSession, *paths: str, settings: Settings = Settings()) -> Result:
    """Spreadsheets and pictures under the paths, as scan_mode asks, in the order of a result."""
    found, issues = [], [spark.createDataFrame([], ISSUES)]
    if settings.scan_mode != "data":
        decoded = pages.images(spark, *paths)
        features = pages.page_features(decoded).persist()  # every rule reads them
        found.append(pictures.image_findings(decoded, features, settings))
        issues.append(pages.issues(features))
    if settings.scan_mode != "image":
        rows = sheets.scan(spark, *paths)
        found.append(scan_cells(sheets.cells(rows), settings))
        issues.append(sheets.issues(rows))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)
    if "matched_count" not in whole.columns:
        whole = whole.withColumn("matched_count", F.lit(None).cast("long"))
    spots = F.get_json_object("details", "$.matched_spots").cast("long")
    whole = whole.withColumn("matched_count", F.coalesce("matched_count", spots, F.lit(0).cast("long")))
    return Result(whole.orderBy(*quality.result_order()), reduce(DataFrame.unionByName, issues), settings)
