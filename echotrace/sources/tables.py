"""Wide tables as numeric cells: the adapter from any DataFrame to the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.expr import canonical, coordinate


def melt(rows: DataFrame, source: str, row: Column, columns: dict[str, Column], sheet: Column | str | None = None, header_row: Column | None = None) -> DataFrame:
    """Cells of a table: one for each row and each named column whose value is not null. row must be unique within sheet and header_row.

    No shuffle: the columns become an array that is exploded in place.
    """
    sheet = F.lit(source) if sheet is None else F.lit(sheet) if isinstance(sheet, str) else sheet
    entries = F.array(*(F.struct(F.lit(i).alias("column"), F.lit(name).alias("column_header"), v.cast("decimal(38,12)").alias("number")) for i, (name, v) in enumerate(columns.items(), 1)))
    wide = rows.select(sheet.alias("sheet"), row.cast("int").alias("row"), (F.lit(None).cast("int") if header_row is None else header_row.cast("int")).alias("header_row"), F.explode(entries).alias("e"))
    text = canonical(F.col("e.number"))
    return wide.where("e.number is not null").select(
        F.lit(source).alias("source_path"), "sheet", "row", F.col("e.column").alias("column"), coordinate(F.col("e.column"), F.col("row")).alias("coordinate"),
        text.alias("canonical_value"), text.alias("display_value"), F.lit(False).alias("hidden_sheet"), F.col("e.column_header").alias("column_header"), "header_row", F.lit(None).cast("string").alias("formula"),
    )
