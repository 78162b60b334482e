"""Best-fit packing by hierarchical residual packing.

Blocks of pieces are packed by best fit, longest first. Bins that are nearly full are done; the others become items
of the next round, in which FAN blocks' bins are packed together by the same best fit, and so on until one block is
left. No round drops or closes a bin early: where a node of the tree has more than BLOCK_ROWS bins, they are dealt into as many
parts as that takes, each of bins of all sizes, which are packed side by side, so no task's rows grow with the input. Pieces move by two numbers (sequence, offset); texts are read once.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; null ids are packed as
others; ties go by the order of the rows; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from echotrace.llm.common import id_and_text, per_batch, table, written
from echotrace.llm.tokens import encoder

CAPACITY = 1024
#: A bin with at most this share of its capacity free is done.
NEARLY = 0.005
FAN = 8
BLOCK_ROWS = 1 << 18


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents as they are, longer ones cut so that only the first piece is shorter."""

    def cut(batch: pa.RecordBatch) -> dict:
        end, out = np.array([end_id], "<u4").tobytes(), []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(vocabulary).encode_each(batch.column("text"))):
            ids += end
            n = len(ids) // 4
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*out))))

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, piece int, start long, length long, ids_crc32 long", cut)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the bin with the least room that holds it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free room
    open_, n = 0, 0  # bit r of open_: a bin with r free
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_ &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - free
        if left := free - size:
            room[left].append(b)
            open_ |= 1 << left
    return bins, offsets


def pack(found: DataFrame, capacity: int = CAPACITY, block_rows: int = BLOCK_ROWS, fan: int = FAN) -> DataFrame:
    """Pieces (any columns, with length from 1 to capacity) with sequence_id and offset."""
    spark, nearly = found.sparkSession, int(capacity * (1 - NEARLY))
    want = found.withColumns({"block": F.lit(0).cast("long"), "sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    schema = to_arrow_schema(want)

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 12

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            bins, offsets = best_fit(rows.column("length").to_numpy(), capacity)
            full = rows.append_column("block", pa.array(np.full(len(bins), block))).append_column("sequence_id", pa.array((block << 20) + bins)).append_column("offset", pa.array(offsets))
            return full.cast(schema).to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= block_rows:
                yield from packed()
                held, n, block = [], 0, block + 1
        if held:
            yield from packed()

    local = written(found.mapInArrow(locally, want), "packed")
    bins = local.groupBy("block", "sequence_id").agg(F.sum("length").alias("fill"))
    # a node of round r has the underfull bins of fan**r blocks; parts: the blocks' bins it is made of, with their offsets
    rank = {b: i for i, b in enumerate(x.block for x in local.select("block").distinct().orderBy("block").collect())}  # one number a block
    if len(rank) < 2:
        return local.drop("block")
    nodes = spark.createDataFrame(list(rank.items()), "block long, node long")
    under = bins.where(F.col("fill") < nearly).join(nodes, "block").select("node", "sequence_id", "fill", F.array("sequence_id").alias("ids"), F.array(F.lit(0).cast("long")).alias("bases"))
    count, done = len(rank), []
    while count > 1:
        count = -(-count // fan)
        last = count == 1

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["fill", "sequence_id"], ascending=[False, True]).reset_index(drop=True)
            b, at = best_fit(rows["fill"].to_numpy(), capacity)
            rows["bin"], rows["at"] = b, at
            out = []
            for _, group in rows.groupby("bin", sort=True):
                ids = [x for g in group["ids"] for x in g]
                bases = [int(x) + int(a) for g, a in zip(group["bases"], group["at"]) for x in g]
                out.append((rows["node"].iloc[0], ids[0], int(group["fill"].sum()), ids, bases, False))
            out = pd.DataFrame(out, columns=["node", "sequence_id", "fill", "ids", "bases", "done"])
            out["done"] = last | (out["fill"] >= nearly)
            return out

        under = under.withColumn("node", F.expr(f"node div {fan}"))
        sizes = under.groupBy("node").agg(F.ceil(F.count("*") / block_rows).alias("parts"))  # a row a node
        dealt = under.join(sizes, "node").withColumn("part", F.pmod(F.xxhash64("sequence_id"), "parts"))
        moved = dealt.groupBy("node", "part").applyInPandas(merge, "node long, sequence_id long, fill long, ids array<long>, bases array<long>, done boolean")
        moved = written(moved, f"merged-{count}")
        done.append(moved.where("done"))
        under = moved.where("not done").drop("done")
    placed = done[0]
    for x in done[1:]:
        placed = placed.unionByName(x)
    placed = placed.select(F.col("sequence_id").alias("into"), F.explode(F.arrays_zip("ids", "bases")).alias("p")).select("into", F.col("p.ids").alias("sequence_id"), F.col("p.bases").alias("base"))
    joined = local.drop("block").join(placed, "sequence_id", "left")
    return joined.withColumns({"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("base", F.lit(0))}).drop("into", "base")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    found = written(pieces(docs, capacity, id_col=id_col, text_col=text_col), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
