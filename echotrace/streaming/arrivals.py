"""Spreadsheets that arrive in a folder. The analysis itself is a batch; a stream only gathers cells and counts values."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from echotrace.functions.rows import map_rows
from echotrace.sources.sheets import ROWS, SUFFIXES, read_file


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """ROWS of each spreadsheet file, as it arrives."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*SUFFIXES)).select("path", "content")
    return map_rows(files, ROWS, lambda r: read_file(r["path"], io.BytesIO(r["content"])))


def gather(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends all rows that have arrived to a Parquet folder, each file once, and ends."""
    return rows.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_counts(rows: DataFrame) -> DataFrame:
    """canonical_value, cell_count over all that has arrived: run in complete or update mode."""
    return rows.where("kind = 'cell'").where(~F.col("canonical_value").isin("0", "1")).groupBy("canonical_value").agg(F.count("*").alias("cell_count"))
