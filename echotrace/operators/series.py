"""Rules on series: the numeric cells of one column under one header, in row order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import DERIVED_HEADER, close, column_letter, covers, informative, operands, risk_for_run
from echotrace.functions.folders import kept
from echotrace.functions.rows import IN_BYTES
from echotrace.model import ALL_PAIRS, BUCKET_LIMIT, Settings

KEY = ("source_path", "sheet", "column", "header_row")
#: Headers that name a running number.
INDEX_HEADERS = ("id", "no", "no.", "index", "number", "sample", "sample id", "time", "day", "序号", "编号", "样本", "样本编号", "时间", "天数")


def fill_headers(texts_and_numbers: DataFrame) -> DataFrame:
    """Adds column_header and header_row: the nearest text above in the same column. Input: source_path, sheet, column, row, header (null for numbers)."""
    above = Window.partitionBy("source_path", "sheet", "column").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.last(F.when(F.col("header").isNotNull(), F.struct("header", "row")), ignorenulls=True).over(above)
    return texts_and_numbers.withColumn("h", at).select("*", F.col("h.header").alias("column_header"), F.col("h.row").alias("header_row")).drop("h")


def pin(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row: a generator keeps the optimizer from repeating them inside lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def drop_index_columns(cells: DataFrame) -> DataFrame:
    """Without the segments whose header names a running number and whose values rise by exactly one."""
    named = cells.where(F.lower(F.trim("column_header")).isin(*INDEX_HEADERS))
    step = F.col("canonical_value").cast("decimal(38,12)") - F.lag(F.col("canonical_value").cast("decimal(38,12)")).over(Window.partitionBy(*KEY).orderBy("row"))
    running = named.withColumn("step", step).groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("step") == 1).alias("ones")).where("n >= 2 and ones = n - 1")
    same = [cells[k].eqNullSafe(running[k]) for k in KEY]
    return cells.join(running, same, "left_anti")


def build(cells: DataFrame, least: int) -> DataFrame:
    """series_id (orders as path, sheet, column, header row), n, canon, vals, rows, formulas, header, and the key. One row a series: its length is a column's."""
    item = F.struct("row", "canonical_value", "formula", "hidden_sheet")
    found = cells.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("items"), F.mode("column_header", True).alias("header")).where(F.size("items") >= least)
    key = F.concat_ws("\u0001", "source_path", "sheet", F.lpad(F.col("column").cast("string"), 10, "0"), F.lpad((F.coalesce("header_row", F.lit(-1)) + 1).cast("string"), 10, "0"))
    return found.select(
        key.alias("series_id"), *KEY, "header", F.size("items").alias("n"), F.transform("items", lambda x: x.canonical_value).alias("canon"),
        F.transform("items", lambda x: x.canonical_value.cast("double")).alias("vals"), F.transform("items", lambda x: x.row).alias("rows"),
        F.transform("items", lambda x: x.formula).alias("formulas"), F.try_element_at("items", F.lit(1)).hidden_sheet.alias("hidden_sheet"),
    )


def series_range(side: str) -> Column:
    letter = column_letter(F.col(f"{side}.column"))
    return F.concat(letter, F.try_element_at(F.col(f"{side}.rows"), F.lit(1)), F.lit(":"), letter, F.try_element_at(F.col(f"{side}.rows"), F.lit(-1)))


def _with_shapes(series: DataFrame, steps: int, first: int | None = None) -> DataFrame:
    """Adds shape: values less their mean over their greatest distance from it, in whole steps; null for a constant."""
    out = pin(series, {"_mean": F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.size("vals")})
    out = pin(out, {"_centred": F.transform("vals", lambda x: x - F.col("_mean"))})
    out = pin(out, {"_scale": F.array_max(F.transform("_centred", F.abs))})
    some = F.col("_centred") if first is None else F.slice("_centred", 1, first)
    out = pin(out, {"shape": F.when(F.col("_scale") > 1e-15, F.transform(some, lambda x: F.bround(x / F.col("_scale") * steps, 0).cast("long")))})
    return out.drop("_mean", "_centred", "_scale")


def _pair_ids(series: DataFrame, shaped: DataFrame, keys: Column, limit: int | None) -> DataFrame:
    """first_id, second_id of equal length: all pairs where a length has few series, else those that share a key of `keys` (an array over shaped)."""
    counts = series.groupBy("n").agg(F.count("*").alias("of_length"))
    few = series.join(F.broadcast(counts.where(F.col("of_length") <= ALL_PAIRS)), "n").select("n", F.col("series_id").alias("first_id"))  # one row a length
    small = few.join(few.withColumnRenamed("first_id", "second_id"), "n").where("first_id < second_id").select("first_id", "second_id")
    many = shaped.join(F.broadcast(counts.where(F.col("of_length") > ALL_PAIRS)), "n").select("n", F.col("series_id").alias("first_id"), F.explode(F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))).alias("key"))
    many = many.withColumn("key", F.md5("key"))  # a key is as long as its series
    if limit:
        many = many.withColumn("r", F.row_number().over(Window.partitionBy("n", "key").orderBy("first_id"))).where(F.col("r") <= limit).drop("r")
    near = many.join(many.withColumnRenamed("first_id", "second_id"), ["n", "key"]).where("first_id < second_id").select("first_id", "second_id")
    return small.unionByName(near.distinct())


def with_series(pairs: DataFrame, series: DataFrame) -> DataFrame:
    """Pairs of ids with first and second, the series themselves."""
    whole = F.struct(*series.columns)
    side = lambda name: series.select(F.col("series_id").alias(f"{name}_id"), whole.alias(name))
    return pairs.join(side("first"), "first_id").join(side("second"), "second_id").drop("first_id", "second_id")


def pattern_pairs(series: DataFrame) -> DataFrame:
    return without_derived(with_series(_pair_ids(series, _with_shapes(series, 100, 16), F.array(F.col("shape").cast("string")), BUCKET_LIMIT), series))


def _covered(formulas: Column, column: Column, rows: Column) -> Column:
    """In how many rows the formula has an operand that covers the cell of that column."""
    return F.size(F.filter(F.arrays_zip(formulas.alias("formula"), rows.alias("row")), lambda x: covers(operands(x["formula"]), column, x["row"])))


def derived(pairs: DataFrame) -> DataFrame:
    """Adds derived_side (first, second or null) and derived_by (formula or header): pairs of one sheet and the same rows, of which one is computed from the other."""
    aligned = (F.col("first.source_path") == F.col("second.source_path")) & (F.col("first.sheet") == F.col("second.sheet")) & (F.col("first.n") == F.col("second.n")) & (F.col("first.n") >= 3) & (F.col("first.rows") == F.col("second.rows"))
    has = lambda side: aligned & F.exists(F.col(f"{side}.formulas"), lambda x: x.isNotNull())
    with_counts = pairs.withColumns(
        {
            "by_second": F.when(has("second"), _covered(F.col("second.formulas"), F.col("first.column"), F.col("first.rows"))).otherwise(0),
            "by_first": F.when(has("first"), _covered(F.col("first.formulas"), F.col("second.column"), F.col("second.rows"))).otherwise(0),
        }
    )
    need = F.greatest(F.lit(3), F.ceil(F.col("first.n") * 0.8))
    named = lambda side: F.coalesce(F.col(f"{side}.header").rlike(DERIVED_HEADER), F.lit(False))
    beside = aligned & (F.abs(F.col("first.column") - F.col("second.column")) == 1) & (named("first") != named("second"))
    side = F.when(aligned & (F.col("by_second") >= need), "second").when(aligned & (F.col("by_first") >= need), "first").when(beside, F.when(named("second"), "second").otherwise("first"))
    how = F.when(aligned & (F.greatest("by_second", "by_first") >= need), "formula").when(beside, "header")
    return with_counts.withColumns({"derived_side": side, "derived_by": how}).drop("by_first", "by_second")


def without_derived(pairs: DataFrame) -> DataFrame:
    return derived(pairs).where("derived_side is null").drop("derived_side", "derived_by")


#: The relations of a pair, the first that holds leading.
RELATIONS = ("exact", "scale", "offset", "target_sum", "target_product", "target_difference", "target_quotient")


class _Relations:
    """The relations of many pairs of series of one length at once: arrays with a row a pair."""

    def __init__(self, settings: Settings) -> None:
        self.least, self.share, self.targets = settings.absolute_tolerance, settings.relative_tolerance, settings.operation_targets

    def close(self, x: np.ndarray, y: np.ndarray | float) -> np.ndarray:
        return np.abs(x - y) <= self.least + self.share * np.maximum(np.abs(x), np.abs(y))

    def narrow(self, values: np.ndarray, size: np.ndarray, least: np.ndarray | float | None = None) -> np.ndarray:
        """False where the values lie too far apart to be close to any one number: cheap, and right for any tolerance up to a half."""
        if self.share > 0.5:
            return np.ones(len(values), bool)
        spread = values.max(1) - values.min(1)
        return ~(spread > 6 * (self.least if least is None else least) + 6 * self.share * size)  # what has no number stays

    def target(self, values: np.ndarray) -> np.ndarray:
        """The first target that all of a row's values are close to: the configured ones in order, then the integer nearest to their median; else no number."""
        out = np.full(len(values), np.nan)
        rows = np.flatnonzero(self.narrow(values, np.abs(values).max(1)))
        some = values[rows]
        for t in (*self.targets, None):
            if not len(rows):
                break
            at = np.rint(np.median(some, axis=1)) if t is None else np.full(len(rows), t)
            hit = self.close(some, at[:, None]).all(1)
            out[rows[hit]] = at[hit]
            rows, some = rows[~hit], some[~hit]
        return out

    def found(self, a: np.ndarray, b: np.ndarray, same: np.ndarray, wanted: tuple[str, ...] = RELATIONS) -> dict[str, np.ndarray]:
        """The parameter of each wanted rule that holds, in the order of RELATIONS; no number where it doesn't."""
        rules = {"exact": lambda: np.where(same, 1.0, np.nan), "scale": lambda: self.scale(a, b, same), "offset": lambda: self.offset(a, b, same), **{f"target_{k}": f for k, f in self.combined(a, b, same).items()}}
        return {name: rules[name]() for name in RELATIONS if name in wanted}

    def scale(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        scale = np.full(len(a), np.nan)
        zeros = (a == 0).any(1)
        ratio = np.divide(b, a, out=np.full(a.shape, np.nan), where=a != 0)
        smallest = np.abs(np.where(a == 0, np.inf, a)).min(1)
        rows = np.flatnonzero(~same & (zeros | self.narrow(ratio, np.abs(ratio).max(1), self.least / smallest)))
        rows = rows[np.isfinite(smallest[rows])]
        if len(rows):
            f = np.where(zeros[rows], np.nanmedian(ratio[rows], axis=1), np.median(ratio[rows], axis=1))
            hit = self.close(b[rows], f[:, None] * a[rows]).all(1) & ~self.close(f, 1.0)
            scale[rows[hit]] = f[hit]
        return scale

    def offset(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> np.ndarray:
        offset, apart, (big_a, big_b) = np.full(len(a), np.nan), b - a, (np.abs(x).max(1) for x in (a, b))
        rows = np.flatnonzero(~same & self.narrow(apart, 2 * (big_a + big_b)))
        if len(rows):
            f = np.median(apart[rows], axis=1)
            hit = self.close(b[rows], a[rows] + f[:, None]).all(1) & ~self.close(f, 0.0)
            offset[rows[hit]] = f[hit]
        return offset

    def combined(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> dict[str, Callable[[], np.ndarray]]:
        """How to look for one target of all sums, products, differences and quotients; equal series have no difference or quotient, and 0 is no product."""

        def of(rows: np.ndarray, combine: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
            out = np.full(len(a), np.nan)
            out[rows] = self.target(combine(a[rows], b[rows]))
            return out

        def product() -> np.ndarray:
            out = of(np.ones(len(a), bool), np.multiply)
            out[out == 0] = np.nan
            return out

        return {"sum": lambda: of(np.ones(len(a), bool), np.add), "product": product, "difference": lambda: of(~same, np.subtract), "quotient": lambda: of(~same & (b != 0).all(1), np.divide)}


def _related(pairs: DataFrame, settings: Settings, wanted: tuple[str, ...]) -> DataFrame:
    """first_id, second_id, a, b (values of one length), same to first_id, second_id, rule_id, parameter, leading: a row for each relation; the first of a pair leads."""
    schema = pa.schema([("first_id", pa.string()), ("second_id", pa.string()), ("rule_id", pa.string()), ("parameter", pa.float64()), ("leading", pa.bool_())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = _Relations(settings)
        for batch in batches:
            lists = [batch.column(c) for c in "ab"]
            sizes, same = lists[0].value_lengths().to_numpy(), batch.column("same").to_numpy(zero_copy_only=False)
            starts, (a, b) = np.cumsum(sizes) - sizes, (x.flatten().to_numpy() for x in lists)
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                for at in range(0, len(rows), max(1, NUMBERS // n)):
                    some = rows[at : at + max(1, NUMBERS // n)]
                    cells = starts[some][:, None] + np.arange(n)
                    with np.errstate(all="ignore"):
                        found = rules.found(a[cells], b[cells], same[some], wanted)
                    met = np.zeros(len(some), bool)
                    for rule, parameter in found.items():
                        hit = np.flatnonzero(~np.isnan(parameter))
                        if len(hit):
                            place = pa.array(some[hit])
                            named = pa.array([f"excel.series.{rule}"] * len(hit))
                            yield pa.RecordBatch.from_arrays([batch.column("first_id").take(place), batch.column("second_id").take(place), named, pa.array(parameter[hit]), pa.array(~met[hit])], schema=schema)
                            met[hit] = True

    return pairs.mapInArrow(of, "first_id string, second_id string, rule_id string, parameter double, leading boolean")


#: Numbers of each side that are held at a time while pairs are compared.
NUMBERS = 1 << 17
#: Series and numbers that a block holds at most, pairs of two blocks that are looked at together, and blocks that a length has at least, of a hundred series or so.
BLOCK_SERIES, BLOCK_NUMBERS, BLOCK_PAIRS, BLOCKS = 4096, 1 << 20, 1 << 18, 8
#: Into how many tasks the pairs of a class of equal series are dealt at most, and members of the largest class that a task should have.
SHARES, SHARE_SERIES = 16, 256


def _classed(series: DataFrame) -> DataFrame:
    """The series whose values say something, from a table, with class: one name for all of equal texts; place: a number for the same rows of one sheet; tells: whether it has a formula or a header that derived() looks for."""
    tells = F.exists("formulas", lambda x: x.isNotNull()) | F.coalesce(F.col("header").rlike(DERIVED_HEADER), F.lit(False))
    sound = series.where(informative(F.col("vals"), F.lit(0.0)))
    return kept(sound.withColumns({"class": F.md5(F.array_join("canon", "\u0001")), "place": F.xxhash64("source_path", "sheet", "rows"), "tells": tells}), "series")


def _members(found: DataFrame, sound: DataFrame, series: DataFrame) -> DataFrame:
    """first, second, derived_side, derived_by and the columns of found, which has first_class and second_class in both directions: each two of their members, in the order of their ids.

    Only pairs at one place of which one tells something can be derived; without any, no formulas travel."""
    out = [c for c in found.columns if c not in ("first_class", "second_class")]
    most = sound.groupBy("class").agg(F.count("*").alias("n"), F.max("tells").alias("tells")).agg(F.max("n").alias("n"), F.max("tells").alias("tells")).first()
    shares = max(1, min(SHARES, -(-(most.n or 0) // SHARE_SERIES)))
    side = lambda name, *columns: sound.select(F.col("class").alias(f"{name}_class"), F.col("tells").alias(f"{name}_tells"), *columns)
    member = lambda name: side(name, F.struct(*series.columns).alias(name), F.col("place").alias(f"{name}_place"))
    first = member("first").withColumn("share", F.pmod(F.xxhash64("first.series_id"), F.lit(shares)))
    second = member("second").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    at = (int(sound.sparkSession.conf.get("spark.sql.shuffle.partitions")), "second_class", "share")  # by number: what goes out is far more than what comes in
    apart = found.join(first.hint("merge"), "first_class").repartition(*at).join(second.repartition(*at).hint("merge"), ["second_class", "share"]).where("first.series_id < second.series_id")
    if most.tells:
        apart = apart.where("first_place <> second_place or not (first_tells or second_tells)")
    apart = apart.select(*out, "first", "second", F.lit(None).cast("string").alias("derived_side"), F.lit(None).cast("string").alias("derived_by"))
    if not most.tells:
        return apart
    ids = lambda name: side(name, F.col("series_id").alias(f"{name}_id"), "place")
    beside = found.join(ids("first"), "first_class").join(ids("second"), ["second_class", "place"]).where("first_id < second_id and (first_tells or second_tells)")
    return apart.unionByName(derived(with_series(beside.select(*out, "first_id", "second_id"), sound.select(*series.columns))))


def _rounded(found: DataFrame, places: int | None) -> DataFrame:
    """With its doubles rounded: members of classes are far more rows than what was found."""
    return found if places is None else found.select(*(F.round(c, places).alias(c) if t == "double" else c for c, t in found.dtypes))


def relations(series: DataFrame, settings: Settings = Settings(), wanted: tuple[str, ...] = RELATIONS, places: int | None = None) -> DataFrame:
    """first, second, rule_id, parameter, matched_count, risk: how one series follows from the other, one row for each relation; relation and relation_parameter are those that were met.

    A derived pair with a relation gives one excel.series.normal_derived row in their place. Series of equal texts are one class: all pairs of
    classes of one length are looked at, those that may be related are compared in both directions, and their members join what was found; the
    members of a class are dealt to SHARES, as it may be a large part of all series. Only pairs with the same rows of one sheet, of which one has a formula or a telling header, can be derived, and only those are brought together with their formulas.
    wanted: the relations that are looked for, of RELATIONS. places: decimals of parameters, all if None.
    """
    sound = _classed(series)
    classes = sound.groupBy(F.col("class").alias("series_id")).agg(F.first("n").alias("n"), F.first("vals").alias("vals"), F.count("*").alias("held"))
    pairs = _met(classes.drop("held"), _Parallel(settings, wanted)).select(*(F.col(f"{side}.{c}").alias(name) for side, names in (("first", ("first_id", "a")), ("second", ("second_id", "b"))) for c, name in zip(("series_id", "vals"), names)))
    sides = lambda i, j, x, y: F.struct(F.col(i).alias("first_id"), F.col(j).alias("second_id"), F.col(x).alias("a"), F.col(y).alias("b"))
    both = pairs.select(F.inline(F.array(sides("first_id", "second_id", "a", "b"), sides("second_id", "first_id", "b", "a"))), F.lit(False).alias("same"))
    own = classes.where("held > 1").select(F.inline(F.array(sides("series_id", "series_id", "vals", "vals"))), F.lit(True).alias("same"))
    found = _rounded(_related(both.unionByName(own), settings, wanted), places).withColumnsRenamed({"first_id": "first_class", "second_id": "second_class"})

    related = _members(found, sound, series).where("derived_side is null or leading")
    normal = F.col("derived_side").isNotNull()
    rule, parameter = F.when(normal, "excel.series.normal_derived").otherwise(F.col("rule_id")), F.when(~normal, F.col("parameter"))
    risk = F.when(normal, "low").otherwise(risk_for_run(F.col("first.n"), settings))
    return related.select("first", "second", rule.alias("rule_id"), parameter.alias("parameter"), F.col("first.n").alias("matched_count"), risk.alias("risk"), "derived_side", "derived_by", F.col("rule_id").alias("relation"), F.col("parameter").alias("relation_parameter"))


def shuffled(series: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """first, second, matched_count, order_changed_count: the same values in another order."""
    keyed = series.where(informative(F.col("vals"), F.lit(0.0))).withColumn("bag", F.array_join(F.array_sort("canon"), "\u0001"))
    capped = keyed.withColumn("r", F.row_number().over(Window.partitionBy("n", "bag").orderBy("series_id"))).where(F.col("r") <= BUCKET_LIMIT).drop("r")
    whole = F.struct(*series.columns)
    left, right = capped.select("n", "bag", whole.alias("first")), capped.select("n", "bag", whole.alias("second"))
    pairs = left.join(right, ["n", "bag"]).where((F.col("first.series_id") < F.col("second.series_id")) & (F.col("first.canon") != F.col("second.canon"))).select("first", "second")
    moved = F.size(F.filter(F.zip_with("first.canon", "second.canon", lambda x, y: x != y), lambda d: d))
    return without_derived(pairs).select("first", "second", F.col("first.n").alias("matched_count"), moved.alias("order_changed_count"), risk_for_run(F.col("first.n"), settings).alias("risk"))


def near_duplicates(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """first, second, matched_count, mismatch_count, out_of_tolerance_count, similarity, confidence: five values or more of which few differ."""
    a, b = F.col("first.vals"), F.col("second.vals")
    count = lambda f: F.size(F.filter(F.zip_with(a, b, f), lambda x: x))
    n = F.col("first.n")
    base = pairs.where((n >= 5) & informative(a, F.lit(0.0)) & informative(b, F.lit(0.0)) & (F.array_sort("first.canon") != F.array_sort("second.canon")))
    out = base.withColumns({"mismatch_count": n - F.size(F.filter(F.zip_with("first.canon", "second.canon", lambda x, y: x == y), lambda x: x)), "out_of_tolerance_count": n - count(lambda x, y: close(x, y, settings))})
    out = out.where((F.col("mismatch_count") >= 1) & (F.col("out_of_tolerance_count") <= F.greatest(F.lit(1), F.floor(n * 0.2))))
    similarity = (n - F.col("out_of_tolerance_count")) / n
    return out.select("first", "second", (n - F.col("out_of_tolerance_count")).alias("matched_count"), "mismatch_count", "out_of_tolerance_count", similarity.alias("similarity"), F.least(F.lit(0.95), 0.7 + 0.25 * similarity).alias("confidence"), risk_for_run(n - F.col("out_of_tolerance_count"), settings).alias("risk"))


def linear(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """first, second, slope, intercept, matched_count, outlier_count: a line by the median of slopes, for four values out of five or more."""
    n, a, b = F.col("first.n"), F.col("first.vals"), F.col("second.vals")
    base = pairs.where((n >= 4) & informative(a, F.lit(0.0)) & informative(b, F.lit(0.0)))
    rel, least = settings.relative_tolerance, settings.absolute_tolerance

    def fit(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(left, right):
            x, y = np.asarray(x, float), np.asarray(y, float)
            at = sorted({round(p * (len(x) - 1) / max(1, min(len(x), 64) - 1)) for p in range(min(len(x), 64))})
            i, j = np.triu_indices(len(at), 1)
            dx, dy = x[at][j] - x[at][i], y[at][j] - y[at][i]
            if not (dx != 0).any():
                rows.append((None, None, None))
                continue
            slope = float(np.median(dy[dx != 0] / dx[dx != 0]))
            intercept = float(np.median(y - slope * x))
            line = slope * x + intercept
            rows.append((slope, intercept, int((np.abs(y - line) <= least + rel * np.maximum(np.abs(y), np.abs(line))).sum())))
        return pd.DataFrame(rows, columns=["slope", "intercept", "matched_count"]).astype({"matched_count": "Int64"})

    fitted = base.withColumn("f", F.pandas_udf(fit, "slope double, intercept double, matched_count long")(a, b)).select("first", "second", "f.*")
    sound = ~close(F.col("slope"), F.lit(1.0), settings) & ~close(F.col("intercept"), F.lit(0.0), settings) & (F.col("matched_count") >= settings.medium_run_length) & (F.col("matched_count") / n >= 0.8)
    return fitted.where(sound).select("first", "second", "slope", "intercept", "matched_count", (n - F.col("matched_count")).alias("outlier_count"), risk_for_run(F.col("matched_count"), settings).alias("risk"))


def statistics(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """first, second, correlation, normalized_mae, means, deviations, summary_match: eight values or more of one distribution, or of one mean and deviation."""
    def total(v: Column, f=None) -> Column:
        return F.aggregate(v if f is None else F.transform(v, f), F.lit(0.0), lambda s, x: s + x)

    n = F.col("first.n")
    base = pairs.where((n >= 8) & informative(F.col("first.vals"), F.lit(0.0)) & informative(F.col("second.vals"), F.lit(0.0)) & (F.array_sort("first.canon") != F.array_sort("second.canon")))
    apart = lambda mean: lambda x: (x - mean) * (x - mean)
    scaled = lambda mean, sd: lambda x: (x - mean) / sd
    out = pin(base, {f"mean_{k}": total(F.col(f"{k}.vals")) / n for k in ("first", "second")})
    out = pin(out, {f"sd_{k}": F.sqrt(total(F.col(f"{k}.vals"), apart(F.col(f"mean_{k}"))) / n) for k in ("first", "second")})
    out = out.where("sd_first * sd_first > 1e-30 and sd_second * sd_second > 1e-30")
    out = pin(out, {f"z_{k}": F.array_sort(F.transform(F.col(f"{k}.vals"), scaled(F.col(f"mean_{k}"), F.col(f"sd_{k}")))) for k in ("first", "second")})
    products = total(F.zip_with("z_first", "z_second", lambda x, y: x * y))
    out = pin(out, {"correlation": F.coalesce(F.try_divide(products, F.sqrt(total(F.col("z_first"), lambda x: x * x) * total(F.col("z_second"), lambda x: x * x))), F.lit(0.0)), "normalized_mae": total(F.zip_with("z_first", "z_second", lambda x, y: F.abs(x - y))) / n})
    out = out.withColumn("summary_match", close(F.col("mean_first"), F.col("mean_second"), settings) & close(F.col("sd_first"), F.col("sd_second"), settings))
    return out.where("summary_match or (correlation >= 0.999 and normalized_mae <= 0.03)").select("first", "second", "correlation", "normalized_mae", "mean_first", "mean_second", "sd_first", "sd_second", "summary_match")


class _Few:
    """Pairs that near_duplicates() may hold for: few values out of tolerance."""

    shortest = 5

    def __init__(self, settings: Settings) -> None:
        self.least, self.share = settings.absolute_tolerance, settings.relative_tolerance

    def ready(self, values: np.ndarray) -> np.ndarray:
        return values

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(x - y) > self.least + self.share * np.maximum(np.abs(x), np.abs(y))

    def met(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = a.shape[1]
        allowed = max(1, int(n * 0.2))
        seen, off = min(n, allowed + 4), np.zeros((len(a), len(b)), np.int32)
        for k in range(seen):  # most pairs have too many apart by then
            off += self.apart(a[:, k, None], b[None, :, k])
        i, j = np.nonzero(off <= allowed)
        off = off[i, j]
        for k in range(seen, n):
            off += self.apart(a[i, k], b[j, k])
            open_ = off <= allowed
            i, j, off = i[open_], j[open_], off[open_]
        return i, j


class _Lines:
    """Pairs that linear() may hold for: of more stretches than a line may miss values, one at least lies on it, so there the values less their mean are parallel."""

    shortest = 4

    def __init__(self, settings: Settings) -> None:
        self.least, self.share = settings.absolute_tolerance, settings.relative_tolerance

    def ready(self, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each stretch the directions, and how far off (squared) the tolerance and rounding can turn them."""
        n, out = values.shape[1], []
        for some in np.array_split(values, n // 5 + 1, axis=1):  # n // 5 values at most are off the line
            centred = some - some.mean(1, keepdims=True)
            length, most = np.sqrt((centred * centred).sum(1)), np.abs(some).max(1)
            turn = (2 * np.sqrt(some.shape[1]) * (self.least + 4 * self.share * most) + 1e-14 * n * most) / length
            unit = np.divide(centred, length[:, None], out=np.zeros(some.shape), where=length[:, None] > 0)
            out.append((unit, np.nan_to_num(2 * turn * turn, nan=np.inf)))
        return out

    def met(self, a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
        hit = np.zeros((len(a[0][0]), len(b[0][0])), bool)
        for (x, off_x), (y, off_y) in zip(a, b):
            # what is not a number stays
            hit |= self.share > 0.5 or ~(np.abs(x @ y.T) + off_x[:, None] + off_y < 1 - 1e-12)
        return np.nonzero(hit)


class _Spreads:
    """Pairs that statistics() may hold for: sorted values in deviations from the mean are nearly parallel and near, or means and deviations are equal within tolerances; with room for rounding."""

    shortest = 8

    def __init__(self, settings: Settings) -> None:
        self.least, self.share = settings.absolute_tolerance, settings.relative_tolerance

    def ready(self, values: np.ndarray) -> tuple[np.ndarray, ...]:
        n = values.shape[1]
        mean, room = _total(values) / n, 1e-15 * n * np.abs(values).max(1)
        sd = np.sqrt(_total((values - mean[:, None]) ** 2) / n)
        scaled = np.sort((values - mean[:, None]) / sd[:, None], axis=1)
        return scaled, 8 * room / sd, mean, sd, room, _total(scaled * scaled)

    def met(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        (x, off_x, mean_x, sd_x, room_x, _), (y, off_y, mean_y, sd_y, room_y, _) = a, b
        room = room_x[:, None] + room_y
        same = ~(np.abs(mean_x[:, None] - mean_y) > self.least + self.share * np.maximum(np.abs(mean_x[:, None]), np.abs(mean_y)) + 8 * room)
        same &= ~(np.abs(sd_x[:, None] - sd_y) > self.least + self.share * np.maximum(sd_x[:, None], sd_y) + 8 * room)
        i, j = np.nonzero(~same & ~(x @ y.T / x.shape[1] + off_x[:, None] + off_y < 0.999 - 1e-9))
        parts = [np.nonzero(same)]
        for at in range(0, len(i), max(1, NUMBERS // x.shape[1])):
            some = slice(at, at + max(1, NUMBERS // x.shape[1]))
            near = ~(np.abs(x[i[some]] - y[j[some]]).mean(1) > 0.03 + 1e-9 + off_x[i[some]] + off_y[j[some]])
            parts.append((i[some][near], j[some][near]))
        return tuple(np.concatenate([p[k] for p in parts]) for k in (0, 1))

    #: What statistics() says of two classes.
    figures = "first_class string, second_class string, correlation double, normalized_mae double, mean_first double, mean_second double, sd_first double, sd_second double, summary_match boolean"

    def measured(self, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray, bag_a: np.ndarray, bag_b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which of the pairs statistics() takes, and their figures after the classes, added up in the same order; a number that is none is the greatest, as Spark compares."""
        (x, _, mean_x, sd_x, _, long_x), (y, _, mean_y, sd_y, _, long_y) = a, b
        n, products, apart = x.shape[1], np.zeros(len(i)), np.zeros(len(i))
        for k in range(n):
            left, right = x[i, k], y[j, k]
            products += left * right
            apart += np.abs(left - right)
        root = np.sqrt(long_x[i] * long_y[j])
        correlation = np.where(root == 0, 0.0, products / root)
        most = lambda x, limit: (x <= limit) | np.isnan(limit)
        close = lambda x, y: most(np.abs(x - y), self.least + self.share * np.maximum(np.abs(x), np.abs(y)))
        mean_x, mean_y, sd_x, sd_y = mean_x[i], mean_y[j], sd_x[i], sd_y[j]
        summary = close(mean_x, mean_y) & close(sd_x, sd_y)
        varied = ~(sd_x * sd_x <= 1e-30) & ~(sd_y * sd_y <= 1e-30)
        keep = (bag_a != bag_b) & varied & (summary | (~(correlation < 0.999) & (apart / n <= 0.03)))
        return keep, [correlation, apart / n, mean_x, mean_y, sd_x, sd_y, summary]


def _total(values: np.ndarray) -> np.ndarray:
    """Sums of rows, one value after the other."""
    return np.cumsum(values, axis=1)[:, -1]


class _Parallel:
    """Pairs that relations() may find something for: their values less the mean are parallel, for products their logarithms', but for what tolerance and rounding can turn; where no factor comes in, they are as long, too."""

    def __init__(self, settings: Settings, wanted: tuple[str, ...] = RELATIONS) -> None:
        self.least, self.share, self.wanted = settings.absolute_tolerance, settings.relative_tolerance, frozenset(wanted)
        smallest = min([1.0, *(abs(t) for t in settings.operation_targets if t)])  # besides these, targets are whole numbers
        self.product_off = 2 * (self.least / smallest + self.share)  # of a product from its target, as a share

    @staticmethod
    def directions(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        centred = values - values.mean(1, keepdims=True)
        length = np.sqrt((centred * centred).sum(1))
        unit = np.divide(centred, length[:, None], out=np.zeros(values.shape), where=length[:, None] > 0)
        return unit, length, np.sqrt(values.shape[1]) * off

    def ready(self, values: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...] | None]:
        n, most = values.shape[1], np.abs(values).max(1)
        lines = self.directions(values, self.least + 2 * (self.least + self.share) * most + 1e-14 * n * most)
        if "target_product" not in self.wanted:
            return lines, None
        logs = np.log(np.abs(values))
        return lines, self.directions(logs, self.product_off + 1e-14 * n * (1 + np.abs(logs).max(1)))

    def met(self, a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        (x, long_x, off_x), (y, long_y, off_y) = a[0], b[0]
        hit = np.zeros((len(x), len(y)), bool)

        def along(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> Callable[[np.ndarray], np.ndarray]:
            """Of cosines: whether the directions may be one. What is not a number stays."""
            turn = (x[2][:, None] + y[2]) / np.minimum(x[1][:, None], y[1])
            limit = 1 - turn * turn - 1e-12 - 1e-15 * x[0].shape[1]
            return lambda cosines: ~(cosines < limit)

        if self.share > 0.5:
            return np.nonzero(~hit)
        if self.wanted - {"exact", "target_product"}:
            cosines, one = x @ y.T, along(a[0], b[0])
            if self.wanted & {"scale", "target_quotient"}:
                hit |= one(np.abs(cosines))
            as_long = ~(np.abs(long_x[:, None] - long_y) > off_x[:, None] + off_y)
            if self.wanted & {"offset", "target_difference"}:
                hit |= as_long & one(cosines)
            if "target_sum" in self.wanted:
                hit |= as_long & one(-cosines)
        if "target_product" in self.wanted:
            hit |= (self.product_off > 0.5) | along(a[1], b[1])(-(a[1][0] @ b[1][0].T))
        return np.nonzero(hit)


def _met(classes: DataFrame, rule: _Few | _Lines | _Spreads | _Parallel) -> DataFrame:
    """first, second: all pairs of classes of one length that the rule may hold for, each once; or its figures of those that it holds for, if it has any (classes with bag).

    A length's classes are dealt into blocks by hash, and each two blocks meet in a cell: a task holds one cell, whatever the length has.
    """
    spark, item, figures = classes.sparkSession, F.struct(*classes.columns), getattr(rule, "figures", None)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(IN_BYTES))
    size = F.greatest(F.lit(1), F.least(F.lit(BLOCK_SERIES), F.floor(F.lit(BLOCK_NUMBERS) / F.col("n"))))
    counts = F.broadcast(classes.groupBy("n").agg(F.count("*").alias("c")).select("n", F.greatest(F.ceil(F.col("c") / size), F.least(F.lit(BLOCKS), F.ceil(F.col("c") / 100))).cast("int").alias("blocks")))  # one row a length
    placed = classes.join(counts, "n").select("n", "blocks", F.pmod(F.xxhash64("series_id"), "blocks").cast("int").alias("block"), item.alias("item"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    rows = placed.withColumn("at", cells).select("n", "at.i", "at.j", "block", "item").repartition("n", "i", "j").sortWithinPartitions("n", "i", "j", "block")
    ids = ("n", "i", "j")

    def cell(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        n, block, items = table.column("n")[0].as_py(), table.column("block").to_numpy(), table.column("item").combine_chunks()
        values = items.field("vals").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        cut = int((block == block[0]).sum())
        crossed = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        if crossed and cut == len(block):
            return
        left, right = (np.arange(cut), np.arange(cut, len(block))) if crossed else (np.arange(cut), np.arange(cut))
        names, bags = items.field("series_id"), items.field("bag").dictionary_encode().indices.to_numpy() if figures else None
        with np.errstate(all="ignore"):
            other = rule.ready(values[right])
            for at in range(0, len(left), step := max(1, BLOCK_PAIRS // max(len(right), n))):
                some = left[at : at + step]
                mine = rule.ready(values[some])
                i, j = rule.met(mine, other)
                if not crossed:
                    i, j = (x[some[i] < right[j]] for x in (i, j))
                for k in range(0, len(i), out := max(1, NUMBERS // n)):
                    x, y = i[k : k + out], j[k : k + out]
                    if figures:
                        keep, found = rule.measured(mine, other, x, y, bags[some[x]], bags[right[y]])
                        yield pa.RecordBatch.from_arrays([*(names.take(pa.array(z[keep])) for z in (some[x], right[y])), *(pa.array(f[keep]) for f in found)], names=[c.split()[0] for c in figures.split(", ")])
                    else:
                        yield pa.RecordBatch.from_arrays([items.take(pa.array(z)) for z in (some[x], right[y])], names=["first", "second"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy() for c in ids])
            starts = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(starts, starts[1:]):
                if held and [held[0].column(c)[0].as_py() for c in ids] != names[:, x].tolist():
                    yield from cell(held)
                    held = []
                held.append(batch.slice(x, y - x))
        if held:
            yield from cell(held)

    text = classes.select(item.alias("item")).schema["item"].dataType.simpleString()
    return rows.mapInArrow(run, figures or f"first {text}, second {text}")


def of_all_pairs(series: DataFrame, rule: Callable[[DataFrame, Settings], DataFrame], settings: Settings = Settings(), places: int | None = None) -> DataFrame:
    """What near_duplicates(), linear() or statistics() finds in all pairs of series of one length, however many there are.

    Series of equal texts are one class, for which none of these rules holds by itself. All pairs of classes are looked at in arrays, those that
    the rule may hold for go on to it, and members join what it finds, in both directions. places: decimals of its figures, all if None.
    """
    wanted = {near_duplicates: _Few, linear: _Lines, statistics: _Spreads}[rule]
    sound = _classed(series).where(F.col("n") >= wanted.shortest)
    classes = sound.groupBy(F.col("class").alias("series_id")).agg(F.first("n").alias("n"), F.first("vals").alias("vals"), F.first("canon").alias("canon"))
    turned = lambda c: c.replace("first", "second") if "first" in c else c.replace("second", "first")
    both = lambda df: df.select(F.inline(F.array(F.struct(*df.columns), F.struct(*(F.col(turned(c)).alias(c) for c in df.columns)))))
    if rule is statistics:
        bagged = classes.select("series_id", "n", "vals", F.md5(F.array_join(F.array_sort("canon"), "\u0001")).alias("bag"))
        found = both(_rounded(_met(bagged, wanted(settings)), places))
    else:
        pairs = _met(classes, wanted(settings))
        found = rule(both(pairs), settings) if rule is linear else both(rule(pairs, settings))  # a line has a direction
        found = _rounded(found.select(F.col("first.series_id").alias("first_class"), F.col("second.series_id").alias("second_class"), *(c for c in found.columns if c not in ("first", "second"))), places)
    return _members(found, sound, series).where("derived_side is null").drop("derived_side", "derived_by")


def fragments(series: DataFrame, settings: Settings = Settings(), limit: int | None = BUCKET_LIMIT) -> DataFrame:
    """first_id, second_id, first_begin, second_begin, matched_count (positions from 1): longest runs of values that two series share.

    Windows of medium_run_length values meet by equality; hits on one diagonal at consecutive places are one run (gaps and islands).
    """
    k = settings.medium_run_length
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - k + 1), lambda i: F.struct(i.alias("p"), F.array_join(F.slice("canon", i, k), "\u0001").alias("w")))
    seeds = series.where(F.col("n") >= k).select("series_id", F.explode(windows).alias("x")).select("series_id", "x.p", "x.w")
    if limit:
        seeds = seeds.withColumn("r", F.row_number().over(Window.partitionBy("w").orderBy("series_id", "p"))).where(F.col("r") <= limit).drop("r")
    other = seeds.select(F.col("series_id").alias("id2"), F.col("p").alias("p2"), "w")
    hits = seeds.join(other, "w").where("series_id < id2 or (series_id = id2 and p2 - p >= %d)" % k)
    place = F.row_number().over(Window.partitionBy("series_id", "id2", F.col("p2") - F.col("p")).orderBy("p"))
    runs = hits.withColumn("g", F.col("p") - place).groupBy("series_id", "id2", (F.col("p2") - F.col("p")).alias("d"), "g").agg(F.min("p").alias("first_begin"), F.count("*").alias("c"))
    runs = runs.select(F.col("series_id").alias("first_id"), F.col("id2").alias("second_id"), "first_begin", (F.col("first_begin") + F.col("d")).alias("second_begin"), (F.col("c") + k - 1).alias("matched_count"))
    whole = F.struct(*series.columns)
    both = runs.join(series.select(F.col("series_id").alias("first_id"), whole.alias("first")), "first_id").join(series.select(F.col("series_id").alias("second_id"), whole.alias("second")), "second_id")
    apart = (F.col("first_id") != F.col("second_id")) | (F.col("second_begin") - F.col("first_begin") >= F.col("matched_count"))
    whole_both = (F.col("matched_count") == F.col("first.n")) & (F.col("matched_count") == F.col("second.n"))
    part = F.slice(F.col("first.canon"), F.col("first_begin"), F.col("matched_count").cast("int"))
    kept = without_derived(both.where(apart & ~whole_both & informative(part, F.lit("0"))))
    return kept.select("first_id", "second_id", "first_begin", "second_begin", "matched_count", risk_for_run(F.col("matched_count"), settings).alias("risk"))
