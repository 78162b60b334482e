"""Importance resampling towards a target's distribution of word runs, with word tries local to a partition.

Features are all runs of one to three words. A task reads its texts in blocks of up to BLOCK_WORDS words and makes a trie of
each block's runs: a node is a run, has its count, its parent's node and the CRC-32 state after its bytes, which its children's
bytes continue. The first pass adds the nodes' counts to the totals of their buckets, the second attaches the buckets' gains to
the nodes and adds them up along each document's paths. So no run is hashed twice in a block and a task holds one block.

Defined cases: null and empty texts, and those without words, have no features and weight 0; a text longer than WINDOW bytes is read
in windows that overlap by two words; a row without an id draws its random number from the empty id and comes after all ids at equal
scores; repeated rows are rows each; other columns are not read; without target texts or documents all totals are 0; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import bound_batches, id_and_text, numbered, per_batch, release, table, written

BUCKETS, SEED, SHARE, LEAST_WORDS = 10_000, 42, 5, 20
#: Words of a trie's block, and bytes of a text that are split at a time.
BLOCK_WORDS, WINDOW = 1 << 18, 4 << 20
#: Bytes of words stay, A-Z become small, all others part words.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class Part(NamedTuple):
    doc: int  #: the document's place in the batch
    words: list[bytes]
    starts: int  #: of so many words runs begin here; those of the rest begin in the text's next part


def parts(doc: int, text: str, window: int = WINDOW) -> Iterator[Part]:
    data, at, held = text.encode("utf-8", "surrogatepass").translate(_BYTES), 0, []
    while at < len(data):
        end = data.find(b" ", at + window)
        end = len(data) if end < 0 else end
        words, at = held + data[at:end].split(), end
        last = at >= len(data)
        held = words[-2:]
        if words:
            yield Part(doc, words, len(words) if last else max(0, len(words) - 2))


class Trie:
    """The runs of a block's parts by levels: for every level, each run's node, and each node's CRC-32."""

    def __init__(self, block: list[Part]) -> None:
        sizes = np.array([len(p.words) for p in block])
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(sizes.sum())  # words from here to the part's end
        begins = np.concatenate([np.arange(len(p.words)) < p.starts for p in block])
        self.doc = np.repeat([p.doc for p in block], sizes)
        coded = pa.array([w for p in block for w in p.words], pa.binary()).dictionary_encode()
        word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        spaced = [b" " + w for w in words]
        node, crcs = word, [zlib.crc32(w) for w in words]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.flatnonzero(begins), word[begins], np.array(crcs, np.int64))]
        for depth in (1, 2):
            at = np.flatnonzero(left > depth)  # where a run one word longer fits
            if not len(at):
                break
            keys = pa.array(node[at] * len(words) + word[at + depth]).dictionary_encode()
            edges = keys.dictionary.to_numpy()
            crcs = [zlib.crc32(spaced[w], crcs[p]) for p, w in zip((edges // len(words)).tolist(), (edges % len(words)).tolist())]
            node = np.full(len(word), -1, np.int64)
            node[at] = keys.indices.to_numpy()
            own = at[begins[at]]
            self.levels.append((own, node[own], np.array(crcs, np.int64)))

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for _, nodes, crcs in self.levels:
            out += np.bincount(crcs % buckets, weights=np.bincount(nodes, minlength=len(crcs)), minlength=buckets).astype(np.int64)
        return out

    def weights(self, gains: np.ndarray, docs: int) -> np.ndarray:
        out = np.zeros(docs)
        for at, nodes, crcs in self.levels:
            out += np.bincount(self.doc[at], weights=gains[crcs % len(gains)][nodes], minlength=docs)  # whole numbers, exact in doubles
        return out.astype(np.int64)


def blocks(texts: pa.Array, size: int = BLOCK_WORDS) -> Iterator[list[Part]]:
    held, n = [], 0
    for i, text in enumerate(texts):
        for part in parts(i, text.as_py()):
            held.append(part)
            n += len(part.words)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def bucket_totals(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Runs of all texts by bucket: CRC-32 of a run modulo `buckets`."""
    bound_batches(texts.sparkSession)
    source = texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                out += Trie(block).totals(buckets)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], names=["bucket", "n"])
        release()

    found, total = source.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")), np.zeros(buckets, np.int64)
    for row in found.collect():  # a row a bucket
        total[row.bucket] = row.n
    return total


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A run's gain by bucket: 1000 times the logarithm of the smoothed shares' ratio, rounded down."""
    s_all, t_all, b = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def of(batch: pa.RecordBatch) -> dict:
        words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for block in blocks(batch.column("text")):
            np.add.at(words, [p.doc for p in block], [p.starts for p in block])
            weight += Trie(block).weights(gains, batch.num_rows)
        return {"doc_id": batch.column("doc_id"), "n_words": words, "n_features": words + np.maximum(words - 1, 0) + np.maximum(words - 2, 0), "weight": weight}

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, n_words long, n_features long, weight long", of)


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of each document; a rank, from 1, for the `share` per cent of those with enough words that
    have the highest scores. A score is the weight and 1000 times a Gumbel number from the id, so that ranks draw without replacement
    in proportion to exp(weight / 1000)."""
    gains = gains_of(bucket_totals(docs, text_col), bucket_totals(target, target_col))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = written(weighed(docs, gains, id_col, text_col).withColumn("score", F.col("weight") + noise), "scores")
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * share // 100
    ranked = numbered(eligible, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))).drop("n_words")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
