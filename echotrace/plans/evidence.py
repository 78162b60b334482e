"""What a finding shows: its cells, its series or regions, and their values side by side, as fields of its details."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.expr import column_letter, coordinate
from echotrace.operators.series import pin

CELL = "source_path string, sheet string, coordinate string, canonical_value string, display_value string, hidden_sheet boolean"
PAIR = "position string, first_coordinate string, first_value string, second_coordinate string, second_value string, relation_result string"
SIDE = "source_path string, sheet string, coordinates array<string>"
#: Of the details, what the evidence table reads.
DETAILS = f"cells array<struct<{CELL}>>, first_series struct<{SIDE}>, second_series struct<{SIDE}>, paired_values array<struct<{PAIR}>>"
#: What a pair of values is said to be where no number says it.
EQUAL, CLOSE, APART, RANKED = "equal", "close", "apart", "same rank"


def side(name: str, begin: Column | None = None, length: Column | None = None) -> Column:
    """A series struct, or a run of it, as its place, coordinates and values."""
    cut = (lambda c: c) if begin is None else (lambda c: F.slice(c, begin.cast("int"), length.cast("int")))
    letter = column_letter(F.col(f"{name}.column"))
    at = F.transform(cut(F.col(f"{name}.rows")), lambda r: F.concat(letter, r.cast("string")))
    return F.struct(F.col(f"{name}.source_path").alias("source_path"), F.col(f"{name}.sheet").alias("sheet"), letter.alias("column"), at.alias("coordinates"), cut(F.col(f"{name}.canon")).alias("values"))


def _cells(name: str, begin: Column | None = None, length: Column | None = None) -> Column:
    """i, canon, v, row of each value: in this order they sort by place."""
    s = F.arrays_zip(F.col(f"{name}.canon").alias("canon"), F.col(f"{name}.vals").alias("v"), F.col(f"{name}.rows").alias("row"))
    some = s if begin is None else F.slice(s, begin.cast("int"), length.cast("int"))
    return F.transform(some, lambda x, i: F.struct(i.alias("i"), x["canon"].alias("canon"), x["v"].alias("v"), x["row"].alias("row")))


def _side_by_side(first: Column, second: Column, result: Callable[[Column, Column], Column]) -> Column:
    a, b = column_letter(F.col("first.column")), column_letter(F.col("second.column"))
    both = F.zip_with(first, second, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.transform(
        both,
        lambda p, i: F.struct(
            (i + 1).cast("string").alias("position"), F.concat(a, p["x"]["row"].cast("string")).alias("first_coordinate"), p["x"]["canon"].alias("first_value"),
            F.concat(b, p["y"]["row"].cast("string")).alias("second_coordinate"), p["y"]["canon"].alias("second_value"), result(p["x"], p["y"]).cast("string").alias("relation_result"),
        ),
    )


def _ordered(cells: Column, *keys: str) -> Column:
    return F.array_sort(F.transform(cells, lambda x: F.struct(*(x[k].alias(k) for k in (*keys, *(f for f in ("i", "canon", "v", "row") if f not in keys))))))


def in_order(result: Callable[[Column, Column], Column], begin: tuple[Column, Column] | None = None, length: Column | None = None) -> Column:
    """paired_values of first and second, place by place; of runs, from where each begins."""
    one, two = begin or (None, None)
    return _side_by_side(_cells("first", one, length), _cells("second", two, length), result)


def by_value() -> Column:
    """paired_values of reordered series: the n-th cell of a value with the n-th one of the same value, in the first one's order."""
    met = F.zip_with(_ordered(_cells("first"), "canon", "i"), _ordered(_cells("second"), "canon", "i"), lambda x, y: F.struct(x["i"].alias("at"), x.alias("x"), y.alias("y")))
    again = F.array_sort(met)
    return _side_by_side(F.transform(again, lambda p: p["x"]), F.transform(again, lambda p: p["y"]), lambda x, y: F.lit(EQUAL))


def by_rank() -> Column:
    return _side_by_side(_ordered(_cells("first"), "v", "i"), _ordered(_cells("second"), "v", "i"), lambda x, y: F.lit(RANKED))


def relation_results(pairs: DataFrame) -> DataFrame:
    """Adds paired_values to rows of series.relations: the value that the row's relation gives at each place."""
    rule, by = F.col("relation"), F.col("relation_parameter")

    def result(x: Column, y: Column) -> Column:
        a, b = x["v"], y["v"]
        is_ = lambda name: rule == f"excel.series.{name}"
        return (
            F.when(is_("scale"), by * a).when(is_("offset"), a + by).when(is_("target_sum"), a + b).when(is_("target_product"), a * b)
            .when(is_("target_difference"), a - b).when(is_("target_quotient"), F.try_divide(a, b)).otherwise(b)
        )

    return pin(pairs, {"paired_values": in_order(result)})


def of_operation(p: Column, q: Column) -> dict[str, Column]:
    """One cell against another: structs with source_path, sheet, column, coordinate and the values as first_text and second_text."""
    one = lambda c, v: F.struct(c.source_path.alias("source_path"), c.sheet.alias("sheet"), column_letter(c.column).alias("column"), F.array(c.coordinate).alias("coordinates"), F.array(v).alias("values"))
    a, b = p.canonical_value, q.canonical_value
    pair = F.struct(F.lit("1").alias("position"), p.coordinate.alias("first_coordinate"), a.alias("first_value"), q.coordinate.alias("second_coordinate"), b.alias("second_value"), F.col("result").cast("string").alias("relation_result"))
    return {"first_series": one(p, a), "second_series": one(q, b), "paired_values": F.array(pair)}


def area(name: str) -> Column:
    """The A1 range of a region's rectangle."""
    at = lambda c, r: coordinate(F.col(f"{name}_column") + c, F.col(f"{name}_row") + r)
    return F.concat(at(F.lit(0), F.lit(0)), F.lit(":"), at(F.col("width") - 1, F.col("height") - 1))


def corner(name: str) -> Column:
    fields = ("source_path", "sheet", "row", "column")
    return F.struct(*(F.col(f"{name}_{f}").alias(f) for f in fields), F.array(area(name)).alias("coordinates"), F.col("height").alias("row_count"), F.col("width").alias("column_count"))


def with_region_pairs(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """paired_values for findings of equal regions: their cells are looked up by place, so only the findings that are kept pay for it."""
    is_region = F.col("rule_id") == "excel.region.exact"
    one = "struct<source_path string, sheet string, row int, column int, row_count int, column_count int>"
    parts = findings.where(is_region).select("finding_id", F.from_json("details", f"first_series {one}, second_series {one}").alias("d"))
    steps = F.sequence(F.lit(0), F.col("d.first_series.row_count") * F.col("d.first_series.column_count") - 1)
    each = parts.select("finding_id", "d", F.explode(steps).alias("k"))
    wide = F.col("d.first_series.column_count")
    each = each.withColumns({"r": F.floor(F.col("k") / wide).cast("int"), "c": (F.col("k") % wide).cast("int")})
    for s in ("first", "second"):
        place = cells.select(F.col("source_path").alias("_p"), F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("column").alias("_c"), F.col("coordinate").alias(f"{s}_coordinate"), F.col("canonical_value").alias(f"{s}_value"))
        at = F.col(f"d.{s}_series")
        each = each.join(place, (at.source_path == F.col("_p")) & (at.sheet == F.col("_s")) & (at.row + F.col("r") == F.col("_r")) & (at.column + F.col("c") == F.col("_c"))).drop("_p", "_s", "_r", "_c")
    pair = F.struct("k", F.struct(F.concat_ws(",", F.col("r") + 1, F.col("c") + 1).alias("position"), "first_coordinate", "first_value", "second_coordinate", "second_value", F.lit(EQUAL).alias("relation_result")).alias("p"))
    met = each.groupBy("finding_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["p"]).alias("_pairs"))  # a region's cells
    both = F.concat(F.expr("substring(details, 1, length(details) - 1)"), F.lit(',"paired_values":'), F.to_json("_pairs"), F.lit("}"))
    return findings.join(met, "finding_id", "left").withColumn("details", F.coalesce(both, "details")).drop("_pairs")


def rows(findings: DataFrame) -> DataFrame:
    """One row for each cell or pair of cells in the findings' details."""
    found = findings.where(F.col("rule_id").startswith("excel.")).select("finding_id", "rule_id", F.from_json("details", DETAILS).alias("d"))
    none = F.lit(None).cast("string")
    single = found.select("finding_id", "rule_id", F.posexplode("d.cells").alias("i", "c"))
    single = single.select("finding_id", "rule_id", (F.col("i") + 1).alias("place"), F.lit(None).cast("string").alias("position"), F.col("c.source_path").alias("first_source"), F.col("c.sheet").alias("first_sheet"), F.col("c.coordinate").alias("first_coordinate"), F.col("c.canonical_value").alias("first_value"), F.col("c.display_value").alias("first_shown"), *(none.alias(f"second_{x}") for x in ("source", "sheet", "coordinate", "value")), none.alias("relation_result"), F.col("c.hidden_sheet").alias("hidden_sheet"))
    pairs = found.select("finding_id", "rule_id", "d.first_series", "d.second_series", F.posexplode("d.paired_values").alias("i", "c"))
    pairs = pairs.select("finding_id", "rule_id", (F.col("i") + 1).alias("place"), "c.position", F.col("first_series.source_path").alias("first_source"), F.col("first_series.sheet").alias("first_sheet"), "c.first_coordinate", "c.first_value", F.col("c.first_value").alias("first_shown"), F.col("second_series.source_path").alias("second_source"), F.col("second_series.sheet").alias("second_sheet"), "c.second_coordinate", "c.second_value", "c.relation_result", F.lit(None).cast("boolean").alias("hidden_sheet"))
    return single.unionByName(pairs)
