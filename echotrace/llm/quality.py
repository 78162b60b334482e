"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into windows that are compressed one by one with either dictionary, so that a long text's own
history never hides them; the normalised difference of the two summed sizes, with the share that remains after
compression and the length, goes through a logistic calibration fitted on labelled rows the dictionaries have not seen.

Defined cases: a null or empty text has sizes of one empty window and gets the calibrated score of that; repeated rows are
scored each; equal texts have equal scores; without labels every score is 0.5, with one class alone it is that
class; no rows give no rows. A score depends on the text alone.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import id_and_text, per_batch, scored, table
from echotrace.llm.labelled import Sample, remainder, sample

WINDOW = 2048
DICTIONARY_BYTES = 112_640
LEVEL = 3
#: Windows of a class that train its dictionary at most, and from one text; a longer text gives windows from all over its length.
TRAINED, TRAINED_OF_TEXT = 6000, 12
THRESHOLD = 0.3


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None  #: the score where nothing could be learnt


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _spread(parts: list[bytes], most: int = TRAINED_OF_TEXT) -> list[bytes]:
    """So many of the windows at most, at like distances from the first to the last."""
    return parts if len(parts) <= most else [parts[i * (len(parts) - 1) // (most - 1)] for i in range(most)]


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [x for t in texts for x in _spread(windows(t)) if x][:TRAINED]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):  # too few windows to train from: they are the dictionary themselves
        return b"".join(parts)[-DICTIONARY_BYTES:] or b" " * 8


def _compressor(body: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(body)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(texts: list[str], good: bytes, bad: bytes) -> np.ndarray:
    """Per text: bytes, bytes compressed with the good and with the bad dictionary."""
    tools, out = [_compressor(good), _compressor(bad)], []
    for text in texts:
        body = text.encode("utf-8", "surrogatepass")
        parts = windows(body)
        out.append((len(body), *(sum(len(c.compress(x)) for x in parts) for c in tools)))
    return np.array(out, float).reshape(-1, 3)


def features(found: np.ndarray) -> np.ndarray:
    n, good, bad = found.T
    d, left, length = 10 * (good - bad) / (good + bad), np.log((np.minimum(good, bad) + 1) / (n + 1)), np.log(n + 1) / 5
    return np.stack([d, d * d, left, left * left, d * left, length, np.ones(len(n))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton steps; the last column is the constant and is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(h, x.T @ (weights * (y - p)) - shrink * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(found: Sample) -> Model:
    y, zero = found.labels, np.zeros(0)
    if not len(y) or len(set(y.tolist())) < 2:
        return Model(b"", b"", zero, zero, zero, float(y[0]) if len(y) else 0.5)
    texts = [t.encode("utf-8", "surrogatepass") for t in found.texts]
    cut = len(y) * 2 // 3
    if min(np.bincount(y[cut:].astype(int), minlength=2)) < 10 or min(np.bincount(y[:cut].astype(int), minlength=2)) < 10:
        seen, unseen = np.arange(len(y)), np.arange(len(y))  # too few rows to keep some back
    else:
        seen, unseen = np.arange(cut), np.arange(cut, len(y))
    good, bad = (_dictionary([texts[i] for i in seen if y[i] == c]) for c in (1, 0))
    x = features(sizes([found.texts[i] for i in unseen], good, bad))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[-1], scale[-1] = 0, 1
    weights = found.weights[unseen] / found.weights[unseen].mean()
    return Model(good, bad, logistic((x - mean) / scale, y[unseen], weights), mean, scale, None)


def scores(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = (features(sizes(texts, model.good, model.bad)) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries

    def of(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": scores(batch.column("text").to_pylist(), sent.value)}

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, score double", of)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores the threshold or more."""
    return docs.where(scored(docs, model, scores, text_col) >= threshold)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels.where(remainder(5) != 0), "quality"))
    return score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
