"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its beginnings, so inflected and compounded forms
share what is known of their stem. Filters of several widths run over the word vectors; the greatest response of each
filter over the whole text feeds a logistic layer. Embeddings start from the words' log-odds. The language is
told from function words in the text itself; each language has a threshold, found on rows that were kept back,
and scores are shifted so that it lies at THRESHOLD.

Defined cases: a null or empty text, or one without words, has no response and gets the score of that;
repeated rows are scored each; equal texts have equal scores; without labels every score is 0, with one class alone
it is that class; no rows give no rows. A score depends on the text alone.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import id_and_text, per_batch, scored, table
from echotrace.llm.labelled import Sample, remainder, sample

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 8, (1, 2, 3)
BEGINNINGS = (4, 5, 6, 7)
EPOCHS, RATE, DOCS_A_STEP = 6, 0.02, 64
#: Texts whose words are counted at a time, which bounds the driver's arrays.
COUNTED = 256
THRESHOLD = 0.3
#: Chunks a worker remembers, and characters of whole texts that it scores at a time, which bounds its arrays.
REMEMBERED, SCORED_CHARS = 200_000, 1_000_000
#: Words that tell a language, as fixed values.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine mit von zu auf für den dem sich auch es an werden",
    "en": "the of and to in is that it for was with as be by on not this are at from",
    "es": "el la los las de que y en un una por con no para es del se al lo su",
    "fr": "le la les de des et est un une que qui dans pour pas sur au avec du il en",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "other")

_WORD = re.compile(r"\w+")
_TELLS = {w: sum(1 << i for i, x in enumerate(LANGUAGES[:-1]) if w in FUNCTION_WORDS[x].split()) for lang in FUNCTION_WORDS for w in FUNCTION_WORDS[lang].split()}


class Vocabulary:
    """Chunks between white space, numbered as they come: their word's buckets and the languages they tell."""

    def __init__(self, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.hashed, self.told = array("i"), array("i")

    def _add(self, new: list[str]) -> None:
        hashed, told, top = self.hashed, self.told, BUCKETS - 1
        for number, chunk in enumerate(new, len(told)):
            self.number[chunk] = number
            word = "".join(_WORD.findall(chunk.lower()))
            if word:
                key = word.encode("utf-8", "surrogatepass")
                hashed.append(1 + crc32(key) % top)
                for n in BEGINNINGS:
                    hashed.append(1 + crc32(key[:n], n) % top)
            else:  # bucket 0 is for what has no letters or digits
                hashed.extend((0,) * (1 + len(BEGINNINGS)))
            told.append(_TELLS.get(word, 0))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' chunks in a row (one empty chunk at least for each text), and each text's first place."""
        cut = [x.split() or [""] for x in texts]
        wanted = set().union(*cut)
        if new := wanted.difference(self.number):
            if len(self.number) + len(new) > self.remembered:
                self.clear()
                new = wanted
            self._add(sorted(new))
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
        return flat, np.cumsum([0, *(len(c) for c in cut[:-1])])[: len(cut)]

    def buckets(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.hashed, np.int32).reshape(-1, 1 + len(BEGINNINGS))[numbers]

    def tells(self, numbers: np.ndarray) -> np.ndarray:
        return np.frombuffer(self.told, np.int32)[numbers]


class Model(NamedTuple):
    embeddings: np.ndarray  #: BUCKETS x DIM
    filters: list[np.ndarray]  #: per width: width x DIM x FILTERS
    bias: np.ndarray  #: all filters
    out: np.ndarray  #: all filters, then the constant
    slope: float
    cuts: np.ndarray  #: the logit of each language that lies at THRESHOLD
    constant: float | None


def _language(tells: np.ndarray, starts: np.ndarray) -> np.ndarray:
    counts = np.stack([np.add.reduceat((tells >> i) & 1, starts) for i in range(len(LANGUAGES) - 1)], axis=1)
    return np.where(counts.max(1) > 0, counts.argmax(1), len(LANGUAGES) - 1)


def _responses(flat: np.ndarray, starts: np.ndarray, words: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, places: bool = False):
    """Greatest response per text and filter; words: vectors by chunk number. places: also where it is."""
    n, ends, out, where, at = len(flat), np.append(starts[1:], len(flat)), [], [], 0
    met = (words @ np.concatenate([x for w in filters for x in w], axis=1))[flat]
    for w in filters:
        r = met[:, at : at + FILTERS].copy()
        for j in range(1, len(w)):
            more = np.zeros_like(r)
            more[: max(0, n - j)] = met[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            for back in range(1, j + 1):  # no filter reaches over a text's end
                more[np.maximum(ends - back, starts)[ends - back >= starts]] = 0
            r += more
        at += len(w) * FILTERS
        out.append(np.maximum.reduceat(r, starts, axis=0))
        if places:
            where.append(np.stack([a + r[a:b].argmax(0) for a, b in zip(starts, ends)]))
    top = np.maximum(np.concatenate(out, axis=1) + bias, 0)
    return (top, where) if places else top


def _log_odds(buckets: np.ndarray, flat: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    ends, seen = np.append(starts[1:], len(flat)), [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for a in range(0, len(starts), COUNTED):  # a text is in one block, so each of its words counts once
        b = min(a + COUNTED, len(starts))
        own, labels = flat[starts[a] : ends[b - 1]], y[a:b]
        text = np.repeat(np.arange(b - a), ends[a:b] - starts[a:b])
        for column in buckets.T:
            pairs = np.unique(text * BUCKETS + column[own])
            for c in (0, 1):
                seen[c] += np.bincount(pairs[labels[pairs // BUCKETS] == c] % BUCKETS, minlength=BUCKETS)
    share = [(seen[c] + 1.0 * (seen[0] + seen[1] + 1) / (seen[0] + seen[1]).sum().clip(1)) / (max(1, (y == c).sum()) + 2) for c in (0, 1)]
    strength = (seen[0] + seen[1]) / (seen[0] + seen[1] + 6)  # rare words say little
    return strength * np.clip(np.log((share[1] + 3e-3) / (share[0] + 3e-3)), -4, 4)


def fit(found: Sample, epochs: int = EPOCHS, seed: int = 11) -> Model:
    y, rng = found.labels, np.random.default_rng(seed)
    if not len(y) or len(set(y.tolist())) < 2:
        empty = np.zeros(0)
        return Model(empty, [], empty, empty, 1.0, empty, float(y[0]) if len(y) else 0.0)
    cut = len(y) * 3 // 4
    if min(np.bincount(y[cut:].astype(int), minlength=2)) < 10:
        cut = len(y)  # too few rows to keep some back
    vocabulary = Vocabulary(1 << 62)  # numbers must last
    numbered = [vocabulary.read([t])[0].astype(np.int32) for t in found.texts]
    all_ = np.arange(len(vocabulary.number))
    buckets, tells = vocabulary.buckets(all_), vocabulary.tells(all_)
    every = lambda ids: (np.concatenate([numbered[i] for i in ids]), np.concatenate([[0], np.cumsum([len(numbered[i]) for i in ids[:-1]])]).astype(np.int64))
    e = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    e[:, 0] = _log_odds(buckets, *every(np.arange(cut)), y[:cut])
    e[0] = 0
    filters = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for w in filters:
        w[:, 0, :] = np.abs(rng.normal(0.5, 0.2, w[:, 0].shape)) / len(w)
    bias, out = np.zeros(FILTERS * len(WIDTHS), np.float32), np.append(np.full(FILTERS * len(WIDTHS), 0.1), -2).astype(np.float32)
    params = [*filters, bias, out]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    balance = np.where(y == 1, (y == 0).sum() / max(1, (y == 1).sum()), 1.0) ** 0.5
    step = 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for a in range(0, cut, DOCS_A_STEP):
            ids = order[a : a + DOCS_A_STEP]
            flat, starts = every(ids)
            own, local = np.unique(flat, return_inverse=True)
            words = e[buckets[own]].sum(1)
            top, where = _responses(local, starts, words, filters, bias, places=True)
            z = top @ out[:-1] + out[-1]
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[ids]) * balance[ids] / len(ids)).astype(np.float32)
            back = g[:, None] * out[:-1] * (top > 0)
            grads, into = [], np.zeros_like(words)
            for k, w in enumerate(filters):
                gw, b, hit, ends = np.zeros_like(w), back[:, k * FILTERS : (k + 1) * FILTERS], where[k], np.append(starts[1:], len(local))
                for j in range(len(w)):
                    inside = hit + j < ends[:, None]
                    at = local[np.minimum(hit + j, len(local) - 1)]
                    for f in range(FILTERS):
                        share = (b[:, f] * inside[:, f])[:, None]
                        gw[j, :, f] = (share * words[at[:, f]]).sum(0)
                        np.add.at(into, at[:, f], share * w[j, :, f])
                grads.append(gw)
            grads += [back.sum(0), np.append(g @ top, g.sum())]
            step += 1
            for p, d, m in zip(params, grads, moments):
                m[0] = 0.9 * m[0] + 0.1 * d
                m[1] = 0.99 * m[1] + 0.01 * d * d
                p -= (RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            touched = np.abs(into).sum(1) > 0
            for column in buckets[own[touched]].T:
                np.add.at(e, column, -0.3 * into[touched])
            e[0] = 0
    model = Model(e, filters, bias, out, 1.0, np.zeros(len(LANGUAGES)), None)
    kept = np.arange(cut, len(y)) if cut < len(y) else np.arange(len(y))
    z, lang = np.empty(len(kept)), np.empty(len(kept), np.int64)
    for a in range(0, len(kept), 256):
        flat, starts = every(kept[a : a + 256])
        own, local = np.unique(flat, return_inverse=True)
        z[a : a + 256] = _responses(local, starts, e[buckets[own]].sum(1), filters, bias) @ out[:-1] + out[-1]
        lang[a : a + 256] = _language(tells[flat], starts)
    cuts = np.full(len(LANGUAGES), _cut(z, y[kept], found.weights[kept]))
    for i in range(len(LANGUAGES)):
        mine = lang == i
        if min(np.bincount(y[kept][mine].astype(int), minlength=2)) >= 8:
            cuts[i] = _cut(z[mine], y[kept][mine], found.weights[kept][mine])
    spread = z[y[kept] == 1].mean() - z[y[kept] == 0].mean()
    return model._replace(cuts=cuts, slope=float(np.clip(6 / max(spread, 1e-3), 0.2, 3)))


def _cut(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> float:
    """The logit with the greatest F1, in the middle of the gap that it may move in."""
    order = np.argsort(-z, kind="stable")
    z, y, weights = z[order], y[order], weights[order]
    hit, all_ = np.cumsum(weights * y), np.cumsum(weights)
    f1 = 2 * hit / (all_ + hit[-1])
    f1[:-1][z[:-1] == z[1:]] = -1
    best = int(np.argmax(f1))
    return float((z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 0.5)


_vocabularies: dict[str, Vocabulary] = {}


def scores(texts: list[str], model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    vocabulary, out, held, size = _vocabularies.setdefault("own", Vocabulary()), [], [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size > SCORED_CHARS:
            out.append(_scores(held, model, vocabulary))
            held, size = [], 0
    if held:
        out.append(_scores(held, model, vocabulary))
    return np.concatenate(out) if out else np.zeros(0)


def _scores(texts: list[str], model: Model, vocabulary: Vocabulary) -> np.ndarray:
    flat, starts = vocabulary.read(texts)
    own, local = np.unique(flat, return_inverse=True)
    z = _responses(local, starts, model.embeddings[vocabulary.buckets(own)].sum(1), model.filters, model.bias) @ model.out[:-1] + model.out[-1]
    moved = model.slope * (z - model.cuts[_language(vocabulary.tells(flat), starts)]) + np.log(THRESHOLD / (1 - THRESHOLD))
    return 1 / (1 + np.exp(-np.clip(moved, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers

    def of(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": scores(batch.column("text").to_pylist(), sent.value)}

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, score double", of)


def drop(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores less than the threshold."""
    return docs.where(scored(docs, model, scores, text_col) < threshold)


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels.where(remainder(4) != 2), "toxic"))
    return score(docs, model).select("doc_id", (remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
