"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt into shards of about SHARD_ROWS. In each, every tree is an array of long hash strings (signs of random
projections) in sorted order. A query goes down all trees to its longest matching prefixes, then up through all of
them together, prefix by prefix, until the rows below reach SHARE of the shard, counted with repeats; these candidates are
ranked by their cosine on the original vectors. The best of the shards meet in one ranking per query. Queries are
dealt into blocks of about BLOCK_QUERIES, so a task holds one shard and one block, at any size of either, and a shard's forest is
built once for so many queries.

All vectors of a prefix are candidates together: copies of one vector, however many, are found together. Vectors of different
numbers of components have no cosine: each number has shards of its own. Vectors are scaled by a power of two before they are
multiplied, which changes no digit, so very large and very small ones have their cosine too.

The share of candidates falls with the number of rows, as neighbours come nearer the more rows there are; it is set for vectors without any
structure, the hardest ones: among 10,000 a neighbour agrees with a query in 63 of 100 signs and a stranger in 50, so half the rows
must be looked at. Vectors with close neighbours find them among the first.

Defined cases: a vector that is null, empty or zero, or that holds a null or non-finite component, or whose id
is null, takes no part; repeated rows are candidates each; ties go to the smaller id; fewer than k candidates are all
returned; without queries or other rows there are no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import table

SHARD_ROWS, BLOCK_QUERIES = 4096, 8192
TREES, BITS = 64, 32
#: Queries that go through a forest together.
AT_ONCE = 512
#: Candidates that end the way up, as a share of the shard's rows, counted once for each tree: SHARE, less the more rows there are in all.
SHARE, FALL = 1.0, 0.25


def share_of(rows: int, share: float = SHARE) -> float:
    return share * (1 + rows / SHARD_ROWS) ** -FALL


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 3) -> None:
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(vectors.shape[1], trees * bits)).astype(np.float32)
        strings = self.strings(vectors)
        self.order = np.argsort(strings, axis=0, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=0)

    def strings(self, vectors: np.ndarray) -> np.ndarray:
        """A column of hash strings for each tree, as unsigned integers."""
        signs = (vectors.astype(np.float32) @ self.planes >= 0).reshape(len(vectors), self.trees, self.bits)
        return signs @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the rows below its prefixes, once the trees hold `wanted` of them together."""
        strings, n = self.strings(queries), len(self.order)
        rows = len(queries)
        low, high = np.zeros((rows, self.trees), np.int64), np.zeros((rows, self.trees), np.int64)
        going = np.arange(rows)
        for level in range(self.bits, -1, -1):
            shift = np.uint64(self.bits - level)
            first = (strings[going] >> shift) << shift
            past = first + (np.uint64(1) << shift)
            before = (low[going], high[going])
            now = [np.stack([np.searchsorted(self.sorted[:, t], x[:, t], "left") for t in range(self.trees)], axis=1) for x in (first, past)]
            grown = np.cumsum((now[1] - now[0]) - (before[1] - before[0]), axis=1) + (before[1] - before[0]).sum(1)[:, None]
            # the trees go up together; the last prefix is left tree by tree, as soon as there are enough
            up = np.concatenate([np.ones((len(going), 1), bool), grown[:, :-1] < wanted], axis=1)
            low[going], high[going] = np.where(up, now[0], before[0]), np.where(up, now[1], before[1])
            going = going[grown[:, -1] < wanted]
            if not len(going):
                break
        for q in range(rows):
            found = np.zeros(n, bool)
            for t in range(self.trees):
                found[self.order[low[q, t] : high[q, t], t]] = True
            yield np.flatnonzero(found)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row by the power of two that brings its greatest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float = SHARE) -> list[tuple[int, int, float]]:
    """(query, id, cosine) of each query's k best candidates."""
    vectors, queries = _scaled(vectors), _scaled(queries)
    norms, out, forest = np.sqrt((vectors * vectors).sum(1)), [], Forest(vectors)
    least = forest.trees * (k + 1)  # so many in all trees mean k + 1 different ones in one of them
    wanted = max(least, int(share * len(ids)))
    slices = (forest.candidates(queries[at : at + AT_ONCE], wanted) for at in range(0, len(queries), AT_ONCE))
    for q, found in enumerate(chain.from_iterable(slices)):
        found = found[ids[found] != query_ids[q]]
        if not len(found):
            continue
        scores = (vectors[found] * queries[q]).sum(1) / (norms[found] * np.sqrt((queries[q] * queries[q]).sum()))
        if len(found) > k:
            keep = scores >= np.partition(scores, -k)[-k]
            found, scores = found[keep], scores[keep]
        for i in np.lexsort((ids[found], -scores))[:k]:
            out.append((int(query_ids[q]), int(ids[found[i]]), float(scores[i])))
    return out


def search(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: which rows, by their id column `vec_id`, are queries too."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    sound = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & some)
    sound = sound.withColumns({"d": F.size("v"), "asks": F.coalesce(is_query, F.lit(False))})
    # a row for each number of components
    sizes = sound.groupBy("d").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / SHARD_ROWS).alias("shards"), F.ceil(F.sum(F.col("asks").cast("long")) / BLOCK_QUERIES).alias("blocks")).where("blocks > 0")
    sized = sound.join(sizes, "d")
    of = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = sized.select("vec_id", "v", "d", of("shards", 1).alias("shard"), each("blocks").alias("block"))
    asked = sized.where("asks").select(F.col("d").alias("q_d"), each("shards").alias("q_shard"), of("blocks", 2).alias("q_block"), F.col("vec_id").alias("q_id"), F.col("v").alias("q_v"), F.col("rows").alias("q_rows"))

    def meet(some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(queries):
            some = some.sort_values("vec_id")
            found = nearest(some["vec_id"].to_numpy(), np.stack(some["v"].to_numpy()), queries["q_id"].to_numpy(), np.stack(queries["q_v"].to_numpy()), k, share_of(int(queries["q_rows"].iloc[0]), share))
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = index.groupBy("d", "shard", "block").cogroup(asked.groupBy("q_d", "q_shard", "q_block")).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
