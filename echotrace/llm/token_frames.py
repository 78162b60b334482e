"""Token ids in seekable zstandard files.

A file holds independent zstandard frames of whole documents' ids (little-endian unsigned 32-bit integers, about
FRAME_BYTES a frame; a longer document has a frame of its own), then a skippable frame with the document index
(Arrow IPC: doc_id, n_tokens, frame, at), then the seek table as a trailing skippable frame: per frame its
compressed size, size and the low 32 bits of the content's XXH64, then the number of frames, a descriptor and a
closing magic number. A reader opens the tail, then reads and checks only the frames that hold wanted documents.

The number of files follows the input's size, and a document id that fills more than one file is dealt over several.
Files go to the shared folder under names no other attempt uses; the manifest, a table that Spark commits, lists
those of the attempts that count, so a lost executor leaves at most an unlisted file.

Defined cases: a null or empty text has the end id alone; repeated rows are written each; a null id stands before
all others; equal ids are ordered by a hash of the text, then by their ids' bytes; no rows give an empty manifest and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from echotrace.llm.common import dealt, id_and_text, new_folder, per_batch, ranges, table, written
from echotrace.llm.tokens import encoder

FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the seekable format: magic of the index's and the seek table's skippable frames, closing magic, descriptor with checksums.
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("frame", pa.int32()), ("at", pa.int64())])


def _check(body: bytes) -> int:
    return xxhash.xxh64_intdigest(body) & 0xFFFFFFFF


class FrameWriter:
    """Takes documents in order; memory holds one frame and the index."""

    def __init__(self, out) -> None:
        self.out, self.zip, self.entries, self.held, self.size = out, zstandard.ZstdCompressor(level=LEVEL), [], [], 0
        self.named, self.index = bytearray(), [array("q") for _ in INDEX.names]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > FRAME_BYTES:
            self._flush()
        self.named.append(doc_id is not None)
        for column, x in zip(self.index, (doc_id or 0, len(ids) // 4, len(self.entries), self.size)):
            column.append(x)
        self.held.append(ids)
        self.size += len(ids)

    def _flush(self) -> None:
        body = b"".join(self.held)
        packed = self.zip.compress(body)
        self.out.write(packed)
        self.entries.append((len(packed), len(body), _check(body)))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, INDEX) as stream:
            columns = [np.frombuffer(x, np.int64) for x in self.index]
            unnamed = np.frombuffer(bytes(self.named), np.uint8) == 0
            stream.write_batch(pa.RecordBatch.from_arrays([pa.array(x, t, mask=None if i else unnamed) for i, (x, t) in enumerate(zip(columns, INDEX.types))], schema=INDEX))
        body = sink.getvalue().to_pybytes()
        body += struct.pack("<II", _check(body), len(body))
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        rows = b"".join(struct.pack("<III", *x) for x in self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, END_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(rows)) + rows)


class FrameReader:
    """Random access to one file; raises ValueError where a checksum or magic number is not as written."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != END_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table at the end")
        start = size - 9 - 12 * n
        self.entries = [struct.unpack_from("<III", rows, 12 * i) for rows in [self._at(start, 12 * n)] for i in range(n)]
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.entries], dtype=np.int64)])
        check, length = struct.unpack("<II", self._at(start - 16, 8))
        body = self._at(start - 16 - length, length)
        if _check(body) != check:
            raise ValueError("the index differs from its checksum")
        self.index = pa.ipc.open_stream(body).read_all()

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, i: int) -> bytes:
        packed, size, check = self.entries[i]
        body = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[i]), packed), max_output_size=size)
        if len(body) != size or _check(body) != check:
            raise ValueError(f"frame {i} differs from its checksum")
        return body

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, tokens of the file before it, ids); of `wanted` ids alone, decompressing only their frames."""
        keep, before, held, body = None if wanted is None else set(wanted), 0, -1, b""
        for batch in self.index.to_batches(max_chunksize=4096):
            for doc_id, size, f, a in zip(*(batch.column(c).to_pylist() for c in INDEX.names)):
                if keep is None or doc_id in keep:
                    if f != held:
                        held, body = f, self.frame(f)
                    yield doc_id, before, body[a : a + 4 * size]
                before += size


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(folder)
    return system, path


def write(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files, in ascending id order over all of them; returns the manifest: part, file, n_docs, n_tokens, n_bytes."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "frames")
    source = id_and_text(docs, id_col, text_col)
    bounds = ranges(source)

    def tokenise(batch: pa.RecordBatch) -> dict:
        zipped, end, ids = zstandard.ZstdCompressor(level=1), np.array([end_id], "<u4").tobytes(), batch.column("doc_id")
        part, tie = dealt(bounds, ids, batch.column("text").to_pylist())
        return {"part": pa.array(part), "doc_id": ids, "tie": pa.array(tie), "ids": [zipped.compress(x + end) for x in encoder(vocabulary).encode_each(batch.column("text"))]}

    placed = per_batch(source, "part int, doc_id long, tie long, ids binary", tokenise).repartitionById(len(bounds) + 1, F.col("part"))
    want = spark.createDataFrame([], "part int, file string, n_docs long, n_tokens long, n_bytes long").schema
    schema = to_arrow_schema(want)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        system.create_dir(path, recursive=True)
        unzip, name, out, writer, part, n_docs, n_tokens = zstandard.ZstdDecompressor(), None, None, None, None, 0, 0
        for batch in batches:
            for p, doc_id, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids"))):
                if writer is None:
                    part, name = p, f"part-{p:06d}-{uuid.uuid4().hex}.zst"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                    writer = FrameWriter(out)
                body = unzip.decompress(packed)
                writer.add(doc_id, body)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(body) // 4
        if writer is not None:
            writer.close()
            out.close()
            size = system.get_file_info(f"{path}/{name}").size
            yield pa.RecordBatch.from_pylist([{"part": part, "file": f"{folder}/{name}", "n_docs": n_docs, "n_tokens": n_tokens, "n_bytes": size}], schema=schema)

    manifest = written(placed.sortWithinPartitions("part", "doc_id", "tie", "ids").drop("tie").mapInArrow(store, want), "manifest")
    return manifest


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: every document of the listed files, a task a file."""
    spark, files, before = manifest.sparkSession, [], 0
    for row in manifest.orderBy("part").collect():  # one row a file
        files.append((row.file, before))
        before += row.n_tokens
    want = spark.createDataFrame([], "doc_id long, start long, ids binary").schema
    schema = to_arrow_schema(want)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                system, path = _open(file)
                with system.open_input_file(path) as source:
                    rows, size = [], 0
                    for doc_id, at, ids in FrameReader(source).documents():
                        rows.append({"doc_id": doc_id, "start": base + at, "ids": ids})
                        size += len(ids)
                        if size > 16 * FRAME_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = spark.createDataFrame(files, "file string, base long").repartition(max(1, len(files)))
    return listed.mapInArrow(load, want)


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batch: pa.RecordBatch) -> dict:
        ids = batch.column("ids").to_pylist()
        return {"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids]}

    return per_batch(read(write(table(spark, sf_dir, "documents"))), "doc_id long, start long, n_tokens long, ids_crc32 long", digest)
