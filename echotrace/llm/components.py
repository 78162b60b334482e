"""Connected components by alternating large and small stars, each round a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import written


def _rows(df: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """a, b: a row for each of these pairs of columns, without a plan for each."""
    return df.select(F.explode(F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs))).alias("row")).select("row.a", "row.b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links a, b (longs) to node, root: root is the smallest node that links reach. Nodes without a link are absent.

    Every step is a minimum by key (combined before the shuffle) and a join that adaptive execution can split,
    so one huge component costs no single task. The number of rounds grows with the logarithm of a component's size.
    A round's plan holds no join for each end of a link, as the plans of many rounds are what the driver holds.
    """
    e = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = _rows(e, ("a", "b"), ("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = _rows(e.join(low, "a"), ("a", "m"), ("b", "m")).where("a <> b").distinct()
        e = written(e, "stars")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
