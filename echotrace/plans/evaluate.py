"""Labelled pairs against detected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def leaking_groups(images: DataFrame) -> DataFrame:
    """source_group, splits: groups of pictures that lie in more than one split."""
    return images.groupBy("source_group").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def join_detected(pairs: DataFrame, detected: DataFrame) -> DataFrame:
    """pairs (first, second, expected, ...) with detected and confidence: the greatest of the detected rows (a, b, confidence), in either order."""
    best = detected.groupBy(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).agg(F.max("confidence").alias("confidence"))
    return pairs.join(best, (F.least("first", "second") == best._a) & (F.greatest("first", "second") == best._b), "left").withColumn("detected", F.col("_a").isNotNull()).drop("_a", "_b")


def outcome(expected: Column, detected: Column) -> Column:
    return F.when(expected & detected, "tp").when(expected, "fn").when(detected, "fp").otherwise("tn")


def metrics(rows: DataFrame, expected: Column, detected: Column, groups: list[str]) -> DataFrame:
    """Confusion counts with precision, recall and specificity: over all, and by each column of groups by itself."""
    base = rows.withColumn("_o", outcome(expected, detected))
    counts = [F.count_if(F.col("_o") == o).alias(o) for o in ("tp", "fp", "fn", "tn")]
    sets = [[], *([g] for g in groups)]
    found = base.groupingSets([[F.col(g) for g in s] for s in sets], *map(F.col, groups)).agg(*counts, *(F.grouping(g).alias(f"_{g}") for g in groups))
    grouping = F.lit("overall")
    for g in groups:
        grouping = F.when(F.col(f"_{g}") == 0, g).otherwise(grouping)
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(a) + F.col(b)), 6)
    value = F.coalesce(*(F.col(g).cast("string") for g in groups))
    return found.select(grouping.alias("grouping"), value.alias("value"), "tp", "fp", "fn", "tn", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"), share("tn", "fp").alias("specificity"))


IMAGES = "id string, path string, split string, source_group string, page int"
PAIRS = "id string, first string, second string, first_region array<int>, second_region array<int>, expected string, split string, modality string, analysis_mode string, western_single_band_enabled boolean, reuse_scope string, label_source string, note string"


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pictures and labelled pairs of a JSON document; ValueError where it contradicts itself."""
    whole = spark.read.schema(f"images array<struct<{_typed(IMAGES)}>>, pairs array<struct<{_typed(PAIRS)}>>").json(path, multiLine=True)
    images, pairs = whole.selectExpr("inline(images)"), whole.selectExpr("inline(pairs)")
    problems = {
        "pictures without id, path, split or group": images.where("id is null or path is null or source_group is null or split not in ('train', 'validation', 'test') or split is null"),
        "pictures with one id": images.groupBy("id").count().where("count > 1"),
        "groups in several splits": leaking_groups(images),
        "pairs with another expectation": pairs.where("expected is null or expected not in ('positive', 'negative')"),
        "pairs of unknown pictures": pairs.join(images.select(F.col("id").alias("first")), "first", "left_anti").unionByName(pairs.join(images.select(F.col("id").alias("second")), "second", "left_anti")),
        "regions without four numbers": pairs.where("size(first_region) <> 4 or size(second_region) <> 4"),
    }
    for name, rows in problems.items():
        if not rows.isEmpty():
            raise ValueError(f"{path}: {name}")
    return images, pairs


def _typed(columns: str) -> str:
    return ", ".join(": ".join(c.strip().split(" ", 1)) for c in columns.split(", "))
