"""Table functions: a Python function from a row to rows, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of an output batch, and numbers, characters or bytes in its lists and texts; bytes of an input batch.
OUT_ROWS, OUT_ITEMS, IN_BYTES = 5_000, 1 << 18, 4 << 20


def map_rows(df: DataFrame, schema: str, f: Callable[[dict], Iterable[dict]]) -> DataFrame:
    """f's rows for every row of df; keys that a row lacks are null. f may be a generator: memory holds OUT_ROWS of its rows, fewer if they are long."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(IN_BYTES))
    want = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(want)
    names = arrow.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                for x in f(row):
                    out.append({n: x.get(n) for n in names})
                    held += sum(len(v) for v in x.values() if isinstance(v, (list, str, bytes)))
                    if len(out) >= OUT_ROWS or held >= OUT_ITEMS:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, want)
