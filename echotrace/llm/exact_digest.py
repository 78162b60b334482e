"""Document fingerprints: a canonical exact digest.

The canonical form is NFKC, case folding and single spaces for runs of white space. Its 128-bit XXH3 is the
fingerprint. Documents group by it; where a bucket has two rows or more, the canonical bytes are compared (least against
greatest, combined before the shuffle, so a bucket of any size costs no task its texts), and a bucket that holds
different bytes is split by them. Likeness of two fingerprints is 1 for equal canonical bytes, else 0.

Defined cases: a null text counts as empty, and empty texts are equal; repeated rows keep one output row each;
equal ids are ordered by a hash of the text, then by the text; null ids come last in descending order and group
under the other ids; a single document is its own next one; no rows give no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import dealt, id_and_text, per_batch, ranges, table, written

#: Level of the compression in which texts move between stages; equal texts give equal bytes.
LEVEL = 3


def canonical(text: str) -> str:
    folded = unicodedata.normalize("NFKC", text).casefold()
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded)
    return " ".join(folded.split())


def digest(form: str) -> str:
    return xxhash.xxh3_128_hexdigest(form.encode())


def form_check(form: str) -> int:
    return xxhash.xxh3_64_intdigest(form.encode(), seed=1) >> 1


#: Words of 64 bits that tell in which digests two rows or more may be: 512 KB, sent to all tasks whatever the input. The fuller they
#: are, the more single rows are compared with themselves; no result depends on it.
TOLD = 1 << 16


def _slot(fingerprint: str) -> tuple[int, int]:
    return int(fingerprint[:4], 16), int(fingerprint[4:6], 16) & 63


def _repeated(counts: DataFrame) -> np.ndarray | None:
    """Slots of the digests with two rows or more; None where there are none."""
    word, bit = F.conv(F.substring("fingerprint", 1, 4), 16, 10).cast("int"), (F.conv(F.substring("fingerprint", 5, 2), 16, 10).cast("int") % 64).cast("int")
    slots = counts.where("group_size > 1").select(word.alias("word"), bit.alias("bit"))
    found = slots.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect()  # TOLD rows at most
    if not found:
        return None
    out = np.zeros(TOLD, np.int64)
    out[[x.word for x in found]] = [x.bits for x in found]
    return out.view(np.uint64)


def groups(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: Callable[[str], str] = digest) -> tuple[DataFrame, DataFrame | None]:
    """fingerprint, group_id, group_size of rows' digests; fingerprint, form_check, part_id, part_size of those that hold different bytes, or None.

    rows: doc_id, fingerprint, form_check (a second hash of the canonical form) of each document.
    """
    found = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")), "buckets")
    told = _repeated(found)
    if told is None:
        return found, None
    sent = docs.sparkSession.sparkContext.broadcast(told)

    def of(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "fingerprint", "form")}
        zipped, known = zstandard.ZstdCompressor(level=LEVEL), sent.value
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            form = canonical(text.as_py())
            fingerprint = name(form)
            word, bit = _slot(fingerprint)
            if int(known[word]) >> bit & 1:
                for k, x in zip(out, (doc_id, fingerprint, zipped.compress(form.encode()))):
                    out[k].append(x)
        return out

    forms = per_batch(id_and_text(docs, id_col, text_col), "doc_id long, fingerprint string, form binary", of)
    mixed = written(forms.groupBy("fingerprint").agg((F.min("form") != F.max("form")).alias("mixed")).where("mixed").select("fingerprint"), "mixed")
    if mixed.isEmpty():
        return found, None
    inside = rows.join(mixed, "fingerprint", "left_semi")
    return found, written(inside.groupBy("fingerprint", "form_check").agg(F.min("doc_id").alias("part_id"), F.count("*").alias("part_size")), "collisions")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the following text's first as many, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(name: Callable[[str], str], doc_id: int | None, text: str, form: str, following: str, next_form: str) -> dict:
    new = edited(text, following)
    new_form = canonical(new)
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": name(form), "form_check": form_check(form), "edited_fingerprint": name(new_form),
        "near_edited": float(form == new_form), "near_next": float(form == next_form),
    }


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, form_check long, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: Callable[[str], str] = digest) -> DataFrame:
    """Each document beside the next one in descending id: texts move once, into id ranges; only the ranges' ends meet again."""
    spark = docs.sparkSession
    source = id_and_text(docs, id_col, text_col)
    bounds = ranges(source)
    n = len(bounds) + 1

    def deal(batch: pa.RecordBatch) -> dict:
        ids, texts, zipped = batch.column("doc_id"), batch.column("text").to_pylist(), zstandard.ZstdCompressor(level=LEVEL)
        at, tie = dealt(bounds, ids, texts)
        return {"at": pa.array(n - 1 - at), "doc_id": ids, "tie": pa.array(tie), "body": [zipped.compress(x.encode()) for x in texts]}

    placed = per_batch(source, "at int, doc_id long, tie long, body binary", deal).repartitionById(n, F.col("at"))
    ordered = placed.sortWithinPartitions("at", F.desc_nulls_last("doc_id"), F.desc("tie"), "body").drop("tie")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out = []
            for at, doc_id, body in zip(*(batch.column(c).to_pylist() for c in ("at", "doc_id", "body"))):
                text = unzip.decompress(body).decode()
                form = canonical(text)
                if last is None:
                    out.append({"kind": "head", "at": at, "body": body})
                else:
                    out.append({"kind": "row", "at": at} | _row(name, *last[:3], text, form))
                last = doc_id, text, form, at, body
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"kind": "tail", "at": last[3], "doc_id": last[0], "body": last[4]}], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    want = spark.createDataFrame([], f"kind string, at int, body binary, {ROW}").schema
    schema = to_arrow_schema(want)
    walked = written(ordered.mapInArrow(walk, want), "walked")
    ends = [x["at"] for x in walked.where("kind = 'head'").select("at").orderBy("at").collect()]  # one number a range
    follows = spark.createDataFrame(list(zip(ends, ends[1:] + ends[:1])), "at int, next_at int")
    heads = walked.where("kind = 'head'").select(F.col("at").alias("next_at"), F.col("body").alias("next_body"))
    tails = walked.where("kind = 'tail'").select("at", "doc_id", "body").join(follows, "at").join(heads, "next_at")

    def close(batch: pa.RecordBatch) -> dict:
        unzip, rows = zstandard.ZstdDecompressor(), []
        for doc_id, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "body", "next_body"))):
            text, following = unzip.decompress(a).decode(), unzip.decompress(b).decode()
            rows.append(_row(name, doc_id, text, canonical(text), following, canonical(following)))
        return {k: [x[k] for x in rows] for k in rows[0]}

    return walked.where("kind = 'row'").drop("kind", "at", "body").unionByName(per_batch(tails, ROW, close))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: Callable[[str], str] = digest) -> DataFrame:
    """The rows of with_next() with group_id (smallest id with the same canonical bytes) and group_size. name: from a canonical form to hex digits."""
    rows = written(with_next(docs, id_col, text_col, name), "digests")
    found, parts = groups(rows, docs, id_col, text_col, name)
    rows = rows.join(found, "fingerprint")
    if parts is not None:
        rows = rows.join(parts, ["fingerprint", "form_check"], "left")
        rows = rows.withColumns({"group_id": F.when(F.col("part_size").isNotNull(), F.col("part_id")).otherwise(F.col("group_id")), "group_size": F.coalesce("part_size", "group_size")})
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")


def op4_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
