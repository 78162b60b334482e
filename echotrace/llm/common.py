"""What the operators share: table reads, the shared folder, written stages, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes an Arrow batch holds at most: bounds a Python worker's memory when texts are very long.
BATCH_ROWS, BATCH_BYTES = 3000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, an own one on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = "file://" + tempfile.mkdtemp(prefix="echotrace-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one; it goes when the driver ends."""
    out = f"{shared_dir(spark)}/echotrace/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, out)
    return out


def _drop(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may have gone first
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table in the shared folder: a lost executor costs a read, not the stage again."""
    spark = df.sparkSession
    folder, clean = new_folder(spark, name), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean)
    spark.conf.set(clean, "true")  # the shuffle files go with the write's end, as only the table is read later
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(folder)


def per_batch(df: DataFrame, schema: str, f: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """mapInArrow with a function from a batch to columns; batches are small enough for very long texts."""
    spark = df.sparkSession
    bound_batches(spark)
    want = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = f(batch)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((got[n.name], n.type) for n in arrow)], schema=arrow)
                got = batch = None
        release()

    return df.mapInArrow(run, want)


def release() -> None:
    """Gives memory that a task has freed back to the system, as a worker waits for the next task with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, under fixed names; a null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def bound_batches(spark: SparkSession) -> None:
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scored(docs: DataFrame, model: object, score: Callable[[list[str], object], object], text_col: str = "text") -> Column:
    """score(texts, model) of each row as a column of docs; the other columns don't pass through Python."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    release()  # the driver's share: the sample and the arrays that the model was fitted with

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts.tolist(), sent.value))
        release()

    return of(F.coalesce(docs[text_col].cast("string"), F.lit("")))


def unused(taken: list[str], name: str) -> str:
    """A name that none of these is, in any case."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their number, from 1, in this order; rows that it leaves equal come in any order, and may lie in several ranges.

    Rows are dealt by range, sorted there and written with their place; a range's first number is the count of rows before it.
    """
    spark, tie = df.sparkSession, unused(df.columns, "tie")
    salted = df.withColumn(tie, F.monotonically_increasing_id())  # equal rows can be parted
    placed = salted.repartitionByRange(partitions(spark), *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    placed = written(placed.withColumn(name, F.monotonically_increasing_id()), "numbered")
    range_, before = unused([*df.columns, name], "range_"), unused([*df.columns, name], "before_")
    of = F.shiftright(name, 33)
    counts = placed.groupBy(of.alias(range_)).agg(F.count("*").alias("n"))  # a row a partition
    counts = counts.select(range_, (F.sum("n").over(Window.orderBy(range_)) - F.col("n")).alias(before))
    return placed.withColumn(range_, of).join(F.broadcast(counts), range_).withColumn(name, F.col(before) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(range_, before)


#: Bytes of input that a range of ids should hold, and the id that stands for none.
RANGE_BYTES, NO_ID = 64 << 20, -(1 << 63)


def ranges(source: DataFrame, least: int | None = None) -> np.ndarray:
    """Ascending bounds that deal doc_id into ranges of like size, more of them the larger the input; an id with many rows is a bound several times."""
    spark = source.sparkSession
    leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # a table of unknown size says more
    n = min(max(least or partitions(spark), -(-size // RANGE_BYTES)), 50_000)  # numbers in the driver
    if n < 2:
        return np.zeros(0, np.int64)
    shares = [i / n for i in range(1, n)]
    key = F.coalesce("doc_id", F.lit(NO_ID))
    found = source.agg(F.percentile_approx(key, F.array(*map(F.lit, shares)) if n < 1000 else F.expr(f"transform(sequence(1, {n - 1}), i -> i / {n}D)"), 10 * n).alias("q")).first()
    return np.array(sorted(found.q or []), np.int64)


def dealt(bounds: np.ndarray, ids: pa.Array, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's range, and a number from its text that orders rows of one id; an id that is a bound m times has its rows in m ranges, by that number."""
    at = ids.fill_null(NO_ID).to_numpy()
    first, past = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
    tie = np.fromiter((xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) for x in texts), np.int64, len(texts))
    return (first + (tie * np.maximum(past - first, 1) >> 32)).astype(np.int32), tie
