"""Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable Parquet shards. Once a tier (shards of like size, by powers of FAN) holds
FAN shards, all of them are merged, in the order of their arrival, into files of up to the target size; a shard that
reaches half the target is left alone. A merge copies row batches file by file, a task an output, so memory holds one batch.

A version is a short list of parts of the list of live shards, PART_SHARDS shards a part; a commit writes the parts that changed under
names of their own, then the list under the next version's name by a rename that fails if the name is taken: readers see the old or
the new version. Of two writers that meet, the later one starts again from the version that it then finds: an append adds its
shards to that, a compaction plans again. An append is done with its commit: what hinders a compaction after it is left to the next
one. Superseded files are deleted once no kept version names them. Data files bear names no other attempt uses; a lost
executor leaves at most an unlisted one.

Defined cases: any columns and nulls are kept as they are, names that read() would use for its own included; repeated rows are stored
each; an empty arrival commits a version without new shards; a store without arrivals has version 0 and no shards.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from echotrace.llm.common import new_folder, table, unused, written

TARGET_BYTES, FAN, SMALLEST_BYTES = 64 << 20, 4, 1 << 20
#: Versions before the present one whose files stay.
KEPT = 1
#: Shards that a part of the manifest lists, and times that a commit starts again after another writer's.
PART_SHARDS, TRIES = 1000, 20
BATCH_ROWS = 2000


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET_BYTES, fan: int = FAN) -> None:
        self.spark, self.folder, self.target, self.fan = spark, folder.rstrip("/"), target, fan
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        self._path = hadoop.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._rename = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename")
        self._fs.mkdirs(self._path(f"{self.folder}/manifest"))

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.folder}/manifest")))
        return sorted(int(x[1:9]) for x in names if x.startswith("v"))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _store(self, name: str, body: dict):
        path = self._path(f"{self.folder}/manifest/{name}")
        out = self._fs.create(path, False)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return path

    def _parts(self, version: int) -> list[str]:
        return self._load(f"v{version:08d}.json")["parts"] if version else []

    def manifest(self, version: int | None = None) -> dict:
        """version, and shards: file, rows, bytes, arrived (the first version that has its rows), of the latest or a given version."""
        version = version if version is not None else max(self.versions(), default=0)
        return {"version": version, "shards": [x for p in self._parts(version) for x in self._load(p)["shards"]]}

    def commit(self, base: int, shards: list[dict]) -> int:
        """The version after `base`; FileExistsError if another writer has made it."""
        kept = {p: self._load(p)["shards"] for p in self._parts(base)}
        live, parts, held = {x["file"]: x for x in shards}, [], set()
        for p, some in kept.items():  # parts that are as they were, and full, are named again
            if len(some) >= PART_SHARDS and all(live.get(x["file"]) == x for x in some):
                parts.append(p)
                held |= {x["file"] for x in some}
        rest = [x for x in shards if x["file"] not in held]
        for i in range(0, len(rest), PART_SHARDS):
            name = f"part-{uuid.uuid4().hex}.json"
            self._store(name, {"shards": rest[i : i + PART_SHARDS]})
            parts.append(name)
        version = base + 1
        draft = self._store(f"draft-{uuid.uuid4().hex}", {"version": version, "parts": parts})
        options = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        options[0] = self._rename.NONE
        try:
            self._context.rename(draft, self._path(f"{self.folder}/manifest/v{version:08d}.json"), options)
        except Exception as e:
            for p in (draft, *(self._path(f"{self.folder}/manifest/{p}") for p in parts if p not in kept)):
                self._fs.delete(p, False)
            raise FileExistsError(f"version {version} of {self.folder} is there already") from e
        return version

    def _vacuum(self, version: int) -> None:
        """Deletes what versions before the kept ones name alone: files of shards, parts, and the versions' own."""
        versions = self.versions()
        old, new = [v for v in versions if v < version - KEPT], [v for v in versions if v >= version - KEPT]
        named = {v: self._parts(v) for v in versions}
        live = {p for v in new for p in named[v]}
        gone = {p for v in old for p in named[v]} - live
        if gone:
            files = {x["file"] for p in gone for x in self._load(p)["shards"]} - {x["file"] for p in live for x in self._load(p)["shards"]}
            for f in files:
                self._fs.delete(self._path(f), False)
        for v in old:  # the list first: a reader that finds it finds its parts
            self._fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}.json"), False)
        for p in gone:
            self._fs.delete(self._path(f"{self.folder}/manifest/{p}"), False)

    def _listed(self, folder: str) -> list[dict]:
        rows = dict(self.spark.read.parquet(folder).groupBy(F.col("_metadata.file_path").alias("f")).count().collect()) if self._fs.exists(self._path(folder)) else {}
        out = []
        for x in self._fs.listStatus(self._path(folder)) if rows else ():
            name = x.getPath().toString()
            n = next((n for f, n in rows.items() if f.rsplit("/", 1)[-1] == name.rsplit("/", 1)[-1]), 0)
            if n:
                out.append({"file": name, "rows": n, "bytes": x.getLen()})
        return sorted(out, key=lambda x: x["file"])

    def append(self, arrivals: DataFrame, by: Column | None = None) -> list[int]:
        """Commits the rows as small shards; with `by`, rows of each value (not null) as an arrival of their own, in the order of its text. All columns are stored."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        if by is None:
            arrivals.write.parquet(folder)
            parts = [folder]
        else:
            name = unused(arrivals.columns, "arrival")
            arrivals.withColumn(name, F.hex(by.cast("string"))).write.partitionBy(name).parquet(folder)  # names that no path has to escape
            parts = sorted(x.getPath().toString() for x in self._fs.listStatus(self._path(folder)) if x.isDirectory() and "=" in x.getPath().getName())
        out = []
        for part in parts:
            out.append(self._add(self._listed(part)))
            try:
                self.compact()
            except FileExistsError:  # other writers were faster each time: the rows are committed, and the next compaction merges them
                pass
        return out

    def _add(self, listed: list[dict]) -> int:
        for _ in range(TRIES):
            base = self.manifest()
            try:
                return self.commit(base["version"], base["shards"] + [x | {"arrived": base["version"] + 1} for x in listed])
            except FileExistsError:
                continue
        raise FileExistsError(f"{TRIES} other writers were faster: nothing is committed")

    def _tier(self, size: int) -> int:
        tier, bound = 0, SMALLEST_BYTES
        while size >= bound:
            tier, bound = tier + 1, bound * self.fan
        return tier

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Runs to merge: tiers of FAN shards or more, cut into files of up to the target size."""
        tiers: dict[int, list[dict]] = {}
        for x in sorted(shards, key=lambda x: (x["arrived"], x["file"])):
            if x["bytes"] < self.target // 2:
                tiers.setdefault(self._tier(x["bytes"]), []).append(x)
        out = []
        for tier in sorted(tiers):
            if len(tiers[tier]) < self.fan:
                continue
            run: list[dict] = []
            for x in tiers[tier]:
                if run and sum(r["bytes"] for r in run) + x["bytes"] > self.target:
                    out.append(run)
                    run = []
                run.append(x)
            out.append(run)
        return [x for x in out if len(x) > 1]

    def compact(self) -> int:
        """Merges until no tier is full; returns the version then. A merge stays good as long as its own shards are live, whatever else arrives."""
        tries = 0
        while runs := self.plan((base := self.manifest())["shards"]):
            folder = f"{self.folder}/data/{uuid.uuid4().hex}"
            merged = _merge(self.spark, [[x["file"] for x in run] for run in runs], folder)
            gone = {x["file"] for run in runs for x in run}
            new = [m | {"arrived": min(x["arrived"] for x in runs[i])} for i, m in merged]
            while gone <= {x["file"] for x in base["shards"]}:
                try:
                    self._vacuum(self.commit(base["version"], [x for x in base["shards"] if x["file"] not in gone] + new))
                    tries = 0
                    break
                except FileExistsError:
                    tries += 1
                    if tries > TRIES:
                        raise
                    base = self.manifest()
        return base["version"]

    def read(self, version: int | None = None, shard: str = "shard", position: str = "position") -> DataFrame | None:
        """The rows with their shard (its place in the manifest) and position in it, under those names; None where there are no shards."""
        found = self.manifest(version)["shards"]
        if not found:
            return None
        files = [x["file"] for x in found]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*files)
        if taken := {shard, position} & set(rows.columns):
            raise ValueError(f"the rows have columns {sorted(taken)}: give other names")
        name = unused([*rows.columns, shard, position], "file_name")
        numbers = self.spark.createDataFrame([(_below_data(f), i) for i, f in enumerate(files)], f"{name} string, {shard} int")
        below = F.substring_index(F.col("_metadata.file_path"), "/data/", -1)
        rows = rows.select("*", below.alias(name), F.col("_metadata.row_index").alias(position))
        return rows.join(F.broadcast(numbers), name).drop(name)  # a row a shard, of the list that the driver holds


def _below_data(file: str) -> str:
    """A data file's path below the store's folder of data, of letters, digits and -=./ alone; files of several arrivals of one write bear the same base name."""
    return file.rsplit("/data/", 1)[-1]


def _merge(spark: SparkSession, runs: list[list[str]], folder: str) -> list[tuple[int, dict]]:
    want = spark.createDataFrame([], "run int, file string, rows long, bytes long").schema
    schema = to_arrow_schema(want)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run, files in zip(batch.column("run").to_pylist(), batch.column("files").to_pylist()):
                system, path = fs.FileSystem.from_uri(folder)
                system.create_dir(path, recursive=True)
                name, rows, out = f"{path}/run-{run:06d}-{uuid.uuid4().hex}.parquet", 0, None
                for f in files:
                    with system.open_input_file(fs.FileSystem.from_uri(f)[1]) as source:
                        for part in pq.ParquetFile(source).iter_batches(batch_size=BATCH_ROWS):
                            out = out or pq.ParquetWriter(name, part.schema, filesystem=system, compression="zstd")
                            out.write_batch(part)
                            rows += part.num_rows
                out.close()
                yield pa.RecordBatch.from_pylist([{"run": run, "file": f"{folder}/{name.rsplit('/', 1)[-1]}", "rows": rows, "bytes": system.get_file_info(name).size}], schema=schema)

    listed = spark.createDataFrame(list(enumerate(runs)), "run int, files array<string>").repartition(len(runs))
    done = written(listed.mapInArrow(copy, want), "merged")
    return sorted((x.run, {"file": x.file, "rows": x.rows, "bytes": x.bytes}) for x in done.collect())  # one row an output


#: Arrivals that the query deals documents into.
ARRIVALS = 8


def op10_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts; the rows as read back from the last version's shards."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, new_folder(spark, "shards"))
    store.append(docs, by=F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    shard, position = (unused(docs.columns, x) for x in ("shard", "position"))
    version, rows = store.manifest()["version"], store.read(shard=shard, position=position)
    if rows is None:
        rows = docs.limit(0).withColumns({shard: F.lit(0), position: F.lit(0).cast("long")})
    return rows.select(
        "doc_id", F.col(shard).alias("shard"), F.col(position).alias("position"), F.lit(version).alias("version"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256")
    )
