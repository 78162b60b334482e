"""Rules on single values, rows of values, digits and pairs of cells."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import close, digits
from echotrace.model import BANDS, Settings


def exact_values(cells: DataFrame) -> DataFrame:
    """canonical_value, cell_count, source_count: values of two cells or more, without 0 and 1. Sums only: a value of any frequency costs no task its cells."""
    return cells.where(~F.col("canonical_value").isin("0", "1")).groupBy("canonical_value").agg(F.count("*").alias("cell_count"), F.countDistinct("source_path", "sheet").alias("sheet_count")).where("cell_count >= 2")


def row_signatures(cells: DataFrame) -> DataFrame:
    """source_path, sheet, row, signature (columns with their values), cell_count: rows that may count as repeated."""
    rows = cells.groupBy("source_path", "sheet", "row").agg(F.array_sort(F.collect_list(F.struct("column", "canonical_value"))).alias("pairs"))
    values = F.array_distinct(F.transform("pairs", lambda x: x.canonical_value))
    plain = F.size(F.array_except(values, F.array(F.lit("0"), F.lit("1")))) == 0
    text = F.array_join(F.transform("pairs", lambda x: F.concat(x["column"].cast("string"), F.lit("="), x.canonical_value)), ";")
    return rows.where((F.size("pairs") >= 2) & (F.size(values) >= 2) & ~plain).select("source_path", "sheet", "row", text.alias("signature"), F.size("pairs").alias("cell_count"))


def exact_rows(cells: DataFrame) -> DataFrame:
    """signature, cell_count, row_count, first_row: rows with the same values in the same columns."""
    return row_signatures(cells).groupBy("signature").agg(F.max("cell_count").alias("cell_count"), F.count("*").alias("row_count"), F.min("row").alias("first_row")).where("row_count >= 2")


def grams(values: DataFrame, least: int, most: int = 8, column: str = "canonical_value") -> DataFrame:
    """canonical_value, n, gram: the different runs of n digits of each value, from least to most (or least alone if that is more)."""
    runs = F.flatten(
        F.transform(
            F.sequence(F.lit(least), F.lit(max(least, most))),
            lambda n: F.when(F.length("d") >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("d") - n + 1), lambda i: F.struct(n.alias("n"), F.col("d").substr(i, n).alias("gram"))))).otherwise(F.array().cast("array<struct<n:int,gram:string>>")),
        )
    )
    return values.select(column, digits(column).alias("d")).where(F.length("d") >= least).select(column, F.explode(runs).alias("r")).select(column, "r.n", "r.gram")


def digit_sets(cells: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Sets of different values that share runs of digits, and their members (set_id, canonical_value).

    The sets: set_id, distinct_values, cell_count, maximum_length, runs, least_value, greatest_value.
    A gram's posting list is a set of values; equal sets meet by a sum of value hashes, so no list is gathered to compare them.
    The longest common runs of a set are the longest grams that all of its values have.
    """
    least = settings.minimum_digit_run
    counted = cells.groupBy("canonical_value").agg(F.count("*").alias("cells"))
    posted = grams(counted, least)
    h = F.xxhash64("canonical_value")
    lists = posted.groupBy("n", "gram").agg(F.count("*").alias("k"), F.sum(F.shiftright(h, 12)).alias("s"), F.bit_xor(h).alias("x")).where("k >= 2")
    sets = lists.groupBy("k", "s", "x").agg(F.max_by(F.struct("n", "gram"), F.struct("n", "gram")).alias("by"))
    sets = sets.select(F.xxhash64("k", "s", "x").alias("set_id"), "k", F.col("by.n").alias("n"), F.col("by.gram").alias("gram"))
    members = sets.join(posted, ["n", "gram"]).select("set_id", "k", "n", "canonical_value")
    longest = F.length(digits("canonical_value"))
    runs = F.flatten(F.transform(F.sequence(F.col("n"), F.least(longest, F.lit(128))), lambda m: F.array_distinct(F.transform(F.sequence(F.lit(1), longest - m + 1), lambda i: digits("canonical_value").substr(i, m)))))
    shared = members.select("set_id", "k", F.explode(runs).alias("run")).groupBy("set_id", "run").agg(F.count("*").alias("has"), F.max("k").alias("k")).where("has = k")
    found = shared.groupBy("set_id").agg(F.max(F.length("run")).alias("maximum_length"), F.collect_list("run").alias("runs"))
    found = found.withColumn("runs", F.array_sort(F.filter("runs", lambda r: F.length(r) == F.col("maximum_length"))))
    size = members.join(counted, "canonical_value").groupBy("set_id").agg(F.count("*").alias("distinct_values"), F.sum("cells").alias("cell_count"), F.min("canonical_value").alias("least_value"), F.max("canonical_value").alias("greatest_value"))
    return found.join(size, "set_id"), members.select("set_id", "canonical_value")


def digit_fragments(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """set_id, distinct_values, cell_count, maximum_length, fragment_count, first_fragment, least_value, greatest_value of each set."""
    found, _ = digit_sets(cells, settings)
    return found.select("set_id", "distinct_values", "cell_count", "maximum_length", F.size("runs").alias("fragment_count"), F.try_element_at("runs", F.lit(1)).alias("first_fragment"), "least_value", "greatest_value")


def _bands(settings: Settings) -> list[tuple[float, str]]:
    bands = [(t, label) for t, label, _ in BANDS]
    if settings.custom_relative > 0 and settings.custom_relative not in {t for t, _ in bands}:
        bands.append((settings.custom_relative, f"custom {settings.custom_relative_tolerance_percent:g}%"))
    return bands


def _islands(numbers: DataFrame, settings: Settings) -> DataFrame:
    """sign, band, island, m, tolerance: magnitudes in the order of their islands, without lone ones.

    A cluster reaches from its anchor to anchor / (1 - tolerance), and the next one starts behind it. No cluster crosses a
    gap wider than the tolerance, so the values are first cut at such gaps, and each island is walked by itself.
    """
    signed = numbers.where("v <> 0").select(F.when(F.col("v") > 0, 1).otherwise(-1).alias("sign"), F.abs("v").alias("m"))
    bands = _bands(settings)
    each = signed.select("sign", "m", F.explode(F.array(*(F.struct(F.lit(t).alias("tolerance"), F.lit(x).alias("band")) for t, x in bands))).alias("b")).select("sign", "m", "b.tolerance", "b.band")
    # neighbours: within a range of like size by a window, across ranges by their ends, which are few
    inner = each.withColumn("place", _range_of(F.col("m"), _cuts(signed, "m")))
    ends = inner.groupBy("sign", "band", "place").agg(F.min("m").alias("first"), F.max("m").alias("top"))
    before = ends.withColumn("top_before", F.lag("top").over(Window.partitionBy("sign", "band").orderBy("place"))).select("sign", "band", "place", "top_before")
    w = Window.partitionBy("sign", "band", "place").orderBy("m")
    linked = inner.withColumn("lower", F.lag("m").over(w)).join(F.broadcast(before), ["sign", "band", "place"]).withColumn("lower", F.coalesce("lower", "top_before"))
    new = F.when(F.col("lower").isNull() | (F.col("m") * (1 - F.col("tolerance")) > F.col("lower")), F.col("m"))
    started = linked.withColumn("start", new)
    within = started.withColumn("island", F.last("start", ignorenulls=True).over(w))
    carried = within.groupBy("sign", "band", "place").agg(F.max("start").alias("last_start"))
    carried = carried.withColumn("island_before", F.last("last_start", ignorenulls=True).over(Window.partitionBy("sign", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))).select("sign", "band", "place", "island_before")
    islands = within.join(F.broadcast(carried), ["sign", "band", "place"]).withColumn("island", F.coalesce("island", "island_before"))

    island = Window.partitionBy("sign", "band", "island")
    islands = islands.withColumn("n", F.count("*").over(island)).where("n >= 2")  # a lone value is no cluster
    # the window has put an island's rows into one task
    return islands.select("sign", "band", "island", "m", "tolerance").sortWithinPartitions("sign", "band", "island", "m")


def _strictest(found: DataFrame, settings: Settings) -> DataFrame:
    """A cluster that several bands give, under the first of them."""
    order = F.array_position(F.array(*(F.lit(x) for _, x in _bands(settings))), F.col("band"))
    return found.withColumn("r", F.row_number().over(Window.partitionBy("sign", "anchor", "last", "distinct_values").orderBy(order))).where("r = 1").drop("r")


def approximate_clusters(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """band, sign, anchor, last, distinct_values: greedy clusters of different values, from each sign's smallest magnitude upwards."""
    numbers = cells.select(F.col("canonical_value").cast("double").alias("v")).distinct()
    found = _islands(numbers, settings).mapInArrow(_clusters, "band string, sign int, anchor double, last double, distinct_values long")
    near_zero = numbers.where(F.abs("v") <= settings.absolute_tolerance).agg(F.min("v").alias("anchor"), F.max("v").alias("last"), F.count("*").alias("distinct_values")).where("distinct_values >= 2 and last <= anchor + %r" % settings.absolute_tolerance)
    return _strictest(found, settings).unionByName(near_zero.select(F.lit("absolute").alias("band"), F.lit(0).alias("sign"), "anchor", "last", "distinct_values"))


def approximate_members(cells: DataFrame, clusters: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The clusters (some of approximate_clusters) with v, one row for each of their values."""
    numbers = cells.select(F.col("canonical_value").cast("double").alias("v")).distinct()
    placed = _islands(numbers, settings).mapInArrow(_members, "band string, sign int, anchor double, v double")
    near_zero = numbers.where(F.abs("v") <= settings.absolute_tolerance).select(F.lit("absolute").alias("band"), F.lit(0).alias("sign"), F.lit(None).cast("double").alias("anchor"), "v")
    same = [clusters.band == F.col("p.band"), clusters.sign == F.col("p.sign"), (F.col("p.sign") == 0) | (clusters.anchor == F.col("p.anchor"))]
    return clusters.join(placed.unionByName(near_zero).alias("p"), same).select(*(clusters[c] for c in clusters.columns), F.col("p.v").alias("v"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each value with the anchor that it goes with."""
    key, anchor, end = None, 0.0, 0.0
    for batch in batches:
        out: list[tuple] = []
        for s, b, i, m, t in zip(*(batch.column(c).to_pylist() for c in ("sign", "band", "island", "m", "tolerance"))):
            if (s, b, i) != key or m > end:
                key, anchor, end = (s, b, i), m, m / (1 - t) if t < 1 else float("inf")
            out.append((b, s, anchor, s * m))
        if out:
            types = (pa.string(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names=["band", "sign", "anchor", "v"])


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of sorted islands in one pass; nothing but the open cluster is held."""
    key, band, sign, anchor, end, last, n = None, "", 0, 0.0, 0.0, 0.0, 0
    for batch in batches:
        out: list[tuple] = []
        for s, b, i, m, t in zip(*(batch.column(c).to_pylist() for c in ("sign", "band", "island", "m", "tolerance"))):
            if (s, b, i) == key and m <= end:
                last, n = m, n + 1
                continue
            if n >= 2:
                out.append((band, sign, anchor, last, n))
            key, band, sign, anchor, last, n = (s, b, i), b, s, m, m, 1
            end = m / (1 - t) if t < 1 else float("inf")
        if out:
            yield _cluster_rows(out)
    if n >= 2:
        yield _cluster_rows([(band, sign, anchor, last, n)])


def _cluster_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["band", "sign", "anchor", "last", "distinct_values"])


def _cuts(rows: DataFrame, column: str) -> list[float]:
    """Ascending bounds that deal a column into as many ranges of like size as there are shuffle partitions."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx(column, F.array(*(F.lit(i / n) for i in range(1, n + 1))), 10_000).alias("q")).first().q
    return sorted(set(found or []))


def _range_of(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts are less than the value, by halving."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > cuts[middle], between(middle + 1, high)).otherwise(between(low, middle))

    if len(cuts) <= 256:
        return between(0, len(cuts))
    # more cuts than an expression should hold: the block first, then its own cuts by their place in the list
    edges, step = F.array(*map(F.lit, cuts)), 256
    block = _range_of(value, cuts[step - 1 :: step])
    return block * step + F.size(F.filter(F.slice(edges, block * step + 1, F.lit(step)), lambda e: e < value))


def _nearest(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """Each wanted row (w, other columns) with the value nearest to w: v. Ties go to the smaller value.

    The values are cut into ranges of like size; a wanted number meets the values of its range, and each range knows the
    last value before it and the first behind it. A merge within the range finds both neighbours.
    """
    spark = values.sparkSession
    cuts = _cuts(values, "v")
    part = lambda c: _range_of(c, cuts)
    held = values.select(F.col("v"), part(F.col("v")).alias("part"))
    ends = held.groupBy("part").agg(F.min("v").alias("first"), F.max("v").alias("last"))
    parts = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    w = Window.orderBy("part")  # one row a partition
    around = parts.select("part", F.last("last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("under"), F.first("first", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("over"))
    asked = wanted.withColumn("part", part(F.col("w")))
    both = asked.withColumn("v", F.lit(None).cast("double")).unionByName(held.select("*", F.col("v").alias("w")), allowMissingColumns=True)
    # both neighbours as the last value so far, upwards and downwards: a frame of all rows to come costs the square of a range
    neighbour = lambda *order: F.last("v", True).over(Window.partitionBy("part").orderBy(*order, F.col("v").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("low", neighbour(F.asc("w"))).withColumn("high", neighbour(F.desc("w")))
    found = both.where("v is null").drop("v").join(F.broadcast(around), "part")
    low, high = F.coalesce("low", "under"), F.coalesce("high", "over")
    return found.withColumn("v", F.when(low.isNull() | (F.abs(high - F.col("w")) < F.abs(low - F.col("w"))), high).otherwise(F.coalesce(low, high))).drop("part", "low", "high", "under", "over")


def cell_operations(cells: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """operation, first, second, target, result: pairs of values whose sum, difference, product or quotient is close to a target.

    For each value, operation and target the needed partner is one number; the nearest value to it is tried.
    """
    values = cells.groupBy(F.col("canonical_value").cast("double").alias("v")).agg(F.count("*").alias("cells"))
    targets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("target")) for i, t in enumerate(settings.operation_targets))))
    with_target = values.select(F.col("v").alias("first"), F.col("cells").alias("first_cells"), targets.alias("t")).select("first", "first_cells", "t.i", "t.target")
    first, target = F.col("first"), F.col("target")
    need = {"add": target - first, "subtract": first - target, "multiply": F.try_divide(target, first), "divide": F.try_divide(first, target)}
    asked = with_target.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("operation"), w.alias("w")) for k, w in need.items()))).alias("o")).select("first", "first_cells", "i", "target", "o.operation", "o.w").where("w is not null")
    # a product of 0 needs the partner 0 whatever the first value is: one lookup for all of them
    zero = values.agg(F.min_by("v", F.struct(F.abs("v"), "v")).alias("v"))
    alone = asked.where("w = 0").crossJoin(F.broadcast(zero))  # one row
    tried = _nearest(asked.where("w <> 0"), values.select("v")).select(*asked.columns, "v").unionByName(alone.select(*asked.columns, "v")).withColumnRenamed("v", "second")
    second, op = F.col("second"), F.col("operation")
    result = F.when(op == "add", first + second).when(op == "subtract", first - second).when(op == "multiply", first * second).otherwise(F.try_divide(first, second))
    plain = first.isin(0.0, 1.0) & second.isin(0.0, 1.0)
    trivial: Column = (
        plain | ((first == second) & op.isin("subtract", "divide")) | ((op == "add") & ((first == 0) | (second == 0)))
        | ((op == "multiply") & (first.isin(0.0, 1.0) | second.isin(0.0, 1.0))) | ((op == "divide") & (second == 1)) | ((op == "subtract") & (second == 0) & (first == target))
    )
    hits = tried.withColumn("result", result).where(F.col("result").isNotNull() & close(F.col("result"), target, settings) & ~trivial & ((first != second) | (F.col("first_cells") >= 2)))
    swap = op.isin("add", "multiply")
    a, b = F.when(swap, F.least("first", "second")).otherwise(first), F.when(swap, F.greatest("first", "second")).otherwise(second)
    keyed = hits.select("operation", a.alias("first"), b.alias("second"), "i", "target", "result")
    return keyed.groupBy("operation", "first", "second").agg(F.min_by(F.struct("target", "result"), "i").alias("x")).select("operation", "first", "second", F.col("x.target").alias("target"), F.col("x.result").alias("result"))
