"""A bounded sample of labelled texts for fitting a classifier."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import id_and_text

#: The sample's bounds: rows of a class, and characters of all its texts. Whole texts only, in the order of a hash of the id.
CLASS_ROWS = 4000
SAMPLE_CHARS = 16_000_000


class Sample(NamedTuple):
    texts: list[str]
    labels: np.ndarray
    weights: np.ndarray  #: rows of the class among all labels over its rows here: restores the labels' shares
    share: float  #: of label 1 among all labels; 0.5 where there are none


def remainder(of: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo `of`."""
    return F.crc32(F.col(column).cast("string")) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, class_rows: int = CLASS_ROWS, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """labels: doc_id and a 0/1 column; a document labelled twice counts with its greater label, other values and nulls are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = dict(known.groupBy("label").count().collect())
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    picked = None
    for c in (0, 1):
        part = known.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows)
        picked = part if picked is None else picked.unionByName(part)
    spark = docs.sparkSession
    ids = picked.collect()  # 2 * class_rows at most
    if not ids:
        return Sample([], np.zeros(0), np.zeros(0), share)
    source = id_and_text(docs, id_col, text_col)

    def wanted(rows: list) -> DataFrame:
        return source.join(F.broadcast(spark.createDataFrame(rows, "doc_id long, label int")), "doc_id")

    sizes = sorted((r.h, r.doc_id, r.label, r.n) for r in wanted([(r.doc_id, r.label) for r in ids]).select("doc_id", "label", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h")).collect())
    rows, used = [], 0
    for _, doc_id, y, n in sizes:
        if used + n <= chars:
            used += n
            rows.append((doc_id, y))
    if not rows:
        return Sample([], np.zeros(0), np.zeros(0), share)
    got = sorted((r.doc_id, r.text, r.label) for r in wanted(sorted(set(rows))).select("doc_id", "text", "label").toLocalIterator())
    order = np.random.default_rng(5).permutation(len(got))
    y = np.array([got[i][2] for i in order], float)
    n = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return Sample([got[i][1] for i in order], y, np.array([counts.get(int(c), 0) / n[int(c)] for c in y]), share)
