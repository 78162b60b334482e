"""Which findings to look at first: consolidation, quotas, order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import risk_order, strength
from echotrace.model import QUEUE, QUEUE_DIGITS, QUEUE_RULE, QUEUE_SHEET, QUEUE_WORKBOOK, RULE_LIMIT, SCOPE_LIMIT


def consolidate(found: DataFrame, key: Column) -> DataFrame:
    """Adds relation_group_primary, merged_rule_count, related_rules: of the findings with one key (null: alone) the strongest explanation is primary.

    Input: finding_id, rule_id, finding_type, matched_count, confidence.
    """
    keyed = found.withColumn("_key", F.coalesce(key, F.concat(F.lit("alone:"), "finding_id")))
    normal = F.when(F.col("finding_type") == "normal_relation", 0).otherwise(1)
    order = Window.partitionBy("_key").orderBy(normal, F.desc(strength(F.col("rule_id"))), F.desc("matched_count"), F.desc("confidence"), "finding_id")
    every = Window.partitionBy("_key")
    return keyed.withColumns({"_place": F.row_number().over(order), "merged_rule_count": F.count("*").over(every), "related_rules": F.array_join(F.array_sort(F.collect_set("rule_id").over(every)), ",")}).withColumn("relation_group_primary", F.col("_place") == 1).drop("_key", "_place")


def _queue_order() -> list[Column]:
    return [risk_order(F.col("risk")), F.desc(strength(F.col("rule_id"))), F.desc("matched_count"), F.desc("distinct_count"), F.desc("confidence"), F.col("finding_id")]


def _prefixes(found: DataFrame, order: list[Column], most: int, without_sheets: int) -> DataFrame:
    """Of the findings with one rule and the same sheets only the first few can be taken: quotas only fill up, so once one is refused, all after it are."""
    place = F.row_number().over(Window.partitionBy("rule_id", F.array_join(F.array_sort("sheets"), "\u0001")).orderBy(*order))
    return found.withColumn("_s", place).where(F.col("_s") <= F.when(F.size("sheets") > 0, most).otherwise(without_sheets)).drop("_s")


def _ids(spark: SparkSession, taken: list[str]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in taken], "finding_id string")


def attention(found: DataFrame) -> DataFrame:
    """Adds attention_tier: primary for at most QUEUE findings within the quotas of workbooks, sheets and rules, else secondary or normal.

    Input: finding_id, rule_id, finding_type, risk, matched_count, distinct_count, confidence, relation_group_primary, workbooks and sheets (arrays).
    A finding is refused where any of its scopes is full. The choice depends on all earlier ones, so it walks the sorted
    findings in the driver, partition by partition, and stops when the queue is full.
    """
    apt = found.where((F.col("finding_type") != "normal_relation") & F.col("risk").isin("high", "medium") & F.col("relation_group_primary"))
    order = _queue_order()
    taken, books, sheets, rules = [], Counter(), Counter(), Counter()
    for r in _prefixes(apt, order, QUEUE_SHEET, QUEUE_RULE).orderBy(*order).select("finding_id", "rule_id", "workbooks", "sheets").toLocalIterator():
        if len(taken) >= QUEUE:
            break
        if rules[r.rule_id] >= (QUEUE_DIGITS if r.rule_id == "excel.digit_fragment" else QUEUE_RULE):
            continue
        if any(books[x] >= QUEUE_WORKBOOK for x in r.workbooks) or any(sheets[x] >= QUEUE_SHEET for x in r.sheets):
            continue
        taken.append(r.finding_id)
        books.update(set(r.workbooks))
        sheets.update(set(r.sheets))
        rules[r.rule_id] += 1
    primary = _ids(found.sparkSession, taken).withColumn("_primary", F.lit(True))
    out = found.join(F.broadcast(primary), "finding_id", "left")  # QUEUE rows at most
    return out.withColumn("attention_tier", F.when(F.col("finding_type") == "normal_relation", "normal").when(F.col("_primary"), "primary").otherwise("secondary")).drop("_primary")


#: Findings of a rule that are sorted with those of all others.
WALKED = 20_000


def _walk(rows: Iterable[Row], limit: int, per_scope: int) -> tuple[list[str], int]:
    """The ids taken of sorted findings, and how many were looked at."""
    taken, used, seen = [], Counter(), 0
    for r in rows:
        if len(taken) == limit:
            break
        seen += 1
        scopes = set(r.sheets)
        if not scopes or any(used[s] < per_scope for s in scopes):
            taken.append(r.finding_id)
            used.update(scopes)
    return taken, seen


def diverse(found: DataFrame, limit: int = RULE_LIMIT, per_scope: int = SCOPE_LIMIT) -> DataFrame:
    """The strongest findings of each rule, without one scope taking them all: one is refused only if all its scopes are full.

    Each rule's first WALKED findings are sorted together and walked in the driver; a rule that these leave short is walked alone,
    partition by partition, until the limit is reached.
    """
    order = [risk_order(F.col("risk")), F.desc("matched_count"), F.desc("distinct_count"), F.desc("confidence"), F.col("finding_id")]
    apt, taken, short = _prefixes(found, order, per_scope, limit), [], []
    first = apt.withColumn("_place", F.row_number().over(Window.partitionBy("rule_id").orderBy(*order))).where(F.col("_place") <= WALKED)
    for rule, rows in groupby(first.orderBy("rule_id", "_place").select("finding_id", "rule_id", "sheets").toLocalIterator(), key=lambda r: r.rule_id):
        got, seen = _walk(rows, limit, per_scope)
        if len(got) < limit and seen == WALKED:
            short.append(rule)
        else:
            taken += got
    for rule in short:
        taken += _walk(apt.where(F.col("rule_id") == rule).orderBy(*order).select("finding_id", "sheets").toLocalIterator(), limit, per_scope)[0]
    return found.join(F.broadcast(_ids(found.sparkSession, taken)), "finding_id", "left_semi")  # limit rows a rule at most


def primary_count(findings: DataFrame) -> int:
    """How many findings are primary; without tiers, those of high or medium risk that are no normal relation."""
    plain = (F.col("finding_type") != "normal_relation") & F.col("risk").isin("high", "medium")
    tier = F.col("attention_tier") if "attention_tier" in findings.columns else F.lit(None).cast("string")
    return findings.where(F.coalesce(tier == "primary", plain)).count()


def spreadsheet_order() -> list[Column]:
    tier = F.when(F.col("attention_tier") == "primary", 0).when(F.col("attention_tier") == "secondary", 1).otherwise(2)
    return [tier, risk_order(F.col("risk")), F.desc("matched_count"), F.desc("confidence"), F.col("finding_id")]


def result_order() -> list[Column]:
    return [risk_order(F.col("risk")), F.desc("matched_count"), F.col("finding_id")]
