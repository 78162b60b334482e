"""Review marks on findings, and what carries over to the next scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "confirmed", "false_positive", "normal")


def mark(findings: DataFrame, finding_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown review status {status}")
    if findings.where(F.col("finding_id") == finding_id).isEmpty():
        raise KeyError(finding_id)
    return findings.withColumn("review_status", F.when(F.col("finding_id") == finding_id, status).otherwise(F.col("review_status")))


def overlay(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """marks: finding_id, review_status (one row an id)."""
    m = marks.select("finding_id", F.col("review_status").alias("_mark"))
    return findings.join(m, "finding_id", "left").withColumn("review_status", F.coalesce("_mark", "review_status")).drop("_mark")


def carry_forward(now: DataFrame, before: DataFrame, same_version: bool = True) -> DataFrame:
    """Marks other than pending of an earlier scan by the same version of the rules."""
    return overlay(now, before.where("review_status <> 'pending'")) if same_version else now


def marked(findings: DataFrame) -> DataFrame:
    return findings.where("review_status <> 'pending'")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("review_status").agg(F.count("*").alias("n"), F.count_if(F.col("risk") == "high").alias("high"))


def only(findings: DataFrame, mode: str = "all", tier: str | None = None, status: str | None = None) -> DataFrame:
    """Findings of spreadsheets (data), pictures (image) or both (all), of a tier and a review status."""
    if mode not in ("all", "data", "image"):
        raise ValueError(f"unknown mode {mode}")
    out = findings if mode == "all" else findings.where(F.col("rule_id").startswith("excel." if mode == "data" else "image."))
    out = out if tier is None else out.where(F.col("attention_tier") == tier)
    return out if status is None else out.where(F.col("review_status") == status)
