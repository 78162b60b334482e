"""SimHash near-duplicates by covering locality-sensitive hashing.

A map from bit positions to the non-zero vectors of three bits gives seven masks; any two fingerprints
that differ in at most two bits agree under at least one mask, so no pair within the radius is missed.
Equal fingerprints collapse before any table is built. Buckets of up to SMALL_BUCKET fingerprints are
compared in place; a larger bucket is linked through the fingerprints one bit away (two fingerprints
are within two bits exactly if they share such a neighbour or are neighbours), which lists no pairs.

Defined cases: a null or empty text has fingerprint zero and links like any other; repeated rows keep
one output row each; a row without an id links as any other, and its component's id is null only where no row of it
has one; rows with one id are rows each, linked by their own texts; extra columns are not read, or kept as they are by
keep_one(), whatever their names; no rows give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import bound_batches, id_and_text, partitions, per_batch, release, table, unused, written
from echotrace.llm.components import components

RADIUS = 2
SMALL_BUCKET = 128
#: Shingles hashed at a time.
BLOCK = 1 << 16


def masks(radius: int = RADIUS, bits: int = 64, seed: int = 7) -> list[int]:
    """2^(radius+1)-1 masks; mask v keeps bit i if the vector of i and v have an odd number of ones in common."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The 64 majority bits of the shingles' XXH64 (unsigned); 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))), len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        digests = b"".join(map(xxhash.xxh64_digest, shingles[at : at + BLOCK], repeat(seed)))
        ones += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def of(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(x, shingle, seed) for x in batch.column("text").to_pylist()], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))}

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, fp long", of)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _within(members: list[dict], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected inside one bucket."""
    fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    root = list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            out.append((members[i]["rep"], members[j]["rep"]))
    return out


def links(reps: DataFrame, radius: int = RADIUS, small: int = SMALL_BUCKET) -> DataFrame:
    """reps (fp, rep: one row a fingerprint) to links a, b between representatives, enough to connect all within the radius."""
    if radius != 2:
        raise ValueError("large buckets are linked by one-bit neighbours, which is exact for radius 2")
    kept = masks(radius)
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(kept)))).alias("at")
    rows = reps.select("fp", "rep", tables).select("at.t", "at.key", "fp", "rep")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    bucketed = rows.join(sizes, ["t", "key"])
    lists = bucketed.where(F.col("n") <= small).groupBy("t", "key").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))

    def compare(batch: pa.RecordBatch) -> dict:
        found = [x for members in batch.column("members").to_pylist() for x in _within(members, radius)]
        return {"a": [x[0] for x in found], "b": [x[1] for x in found]}

    close = per_batch(lists.select("members"), "a long, b long", compare)
    beside = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))).alias("beside")
    stars = (
        bucketed.where(F.col("n") > small).select("fp", "rep").distinct().select("rep", beside)
        .groupBy("beside").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)  # 65 at most
        .select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    )
    return close.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id that links reach)."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    roots = components(links(reps.select("fp", F.col("fp").alias("rep"))))  # a fingerprint is its own node: rows without an id link too
    whole = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = written(whole, "roots")
    whole = whole.join(whole.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(whole, "fp").select("doc_id", hexed, "component_id")


# --- by similarity -------------------------------------------------------------------------------------------------------
# A similarity of 0.8 between sets of five-word shingles moves about an eighth of all fingerprint bits, far more than masks
# for every pair of bits could cover. So the fingerprint is wider, and its masks are the pairs of PARTS equal parts: all pairs
# within PARTS - 2 differing bits collide in some table, and others with a probability that rises with their similarity. What
# collides is checked exactly.

PARTS, PART_BITS = 21, 12
WIDE = PARTS * PART_BITS  # 252 bits of 256
#: Shingles are counted by a byte of their hash, up to 255 each. Shingles of one set alone are at least as many as the counts differ
#: by, so what is over the bound has less than the least similarity for sure and is not read again.
COUNTS = 256
#: Larger buckets are dealt into blocks of about so many members, and each two blocks meet in a cell of their own.
CELL = 512
#: Pairs whose fingerprints are held at a time, and members from which a list's most frequent root is set apart.
PAIRS, LONG_LIST = 1 << 14, 64
#: Heads that a row is checked against first: enough links a row to leave few groups in more than one part. What they leave is compared in full.
HEADS = 4
#: Tasks that a bucket's rows are dealt to where only its sums matter.
SALTS = 4


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingles(words: list[bytes], k: int) -> list[bytes]:
    return list(map(b" ".join, zip(*(words[i:] for i in range(k))))) if len(words) > k else [b" ".join(words)]


def _sketch(words: list[bytes], shingle: int) -> tuple[np.ndarray, int, bytes]:
    """WIDE majority bits of two 128-bit XXH3 of each distinct shingle, in parts of PART_BITS bits; the distinct shingles; their COUNTS."""
    shingles, ones, counts = list(set(_shingles(words, shingle))), np.zeros(256, np.int64), np.zeros(COUNTS, np.int64)
    for at in range(0, len(shingles), BLOCK):
        some = shingles[at : at + BLOCK]
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, some, repeat(1))) + b"".join(map(xxhash.xxh3_128_digest, some, repeat(2))), np.uint8).reshape(2, -1, 16)
        for half, d in enumerate(digests):
            ones[128 * half : 128 * half + 128] += np.unpackbits(d, axis=1).sum(axis=0, dtype=np.int64)
        counts += np.bincount(digests[0, :, 0], minlength=COUNTS)
    bits = (2 * ones > len(shingles))[:WIDE].reshape(PARTS, PART_BITS)
    return bits @ (1 << np.arange(PART_BITS)), len(shingles), np.minimum(counts, 255).astype(np.uint8).tobytes()


def wide_fingerprint(words: list[bytes], shingle: int) -> np.ndarray:
    return _sketch(words, shingle)[0]


def similarity(a: list[bytes], b: list[bytes], shingle: int) -> float:
    """Jaccard similarity of the sets of shingles; 1 for two texts without words."""
    x, y = set(_shingles(a, shingle)), set(_shingles(b, shingle))
    return len(x & y) / len(x | y)


def _meetings(lengths: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """List, and the positions of two of its members, for all pairs of members with different roots in lists of such lengths that lie end to
    end; PAIRS or so at a time. A long list's most frequent root is set against the others, so its own members don't meet."""
    starts = np.cumsum(lengths) - lengths
    for m in np.unique(lengths[lengths > 1]).tolist():
        lists = np.flatnonzero(lengths == m)
        if m > LONG_LIST:
            for i in lists.tolist():
                here = starts[i] + np.arange(m)
                names, counts = np.unique(root[here], return_counts=True)
                most = root[here] == names[counts.argmax()]
                rest, inside = here[~most], here[most]
                for k, x in enumerate(rest.tolist()):
                    y = np.concatenate([inside, rest[k + 1 :]])
                    yield np.full(len(y), i), np.minimum(x, y), np.maximum(x, y)
            continue
        x, y = np.triu_indices(m, 1)
        for some in np.array_split(lists, -(-len(lists) * len(x) // PAIRS)):
            if len(some):
                yield np.repeat(some, len(x)), (starts[some][:, None] + x).ravel(), (starts[some][:, None] + y).ravel()


def _near(shingles_a: np.ndarray, counts_a: np.ndarray, shingles_b: np.ndarray, counts_b: np.ndarray, least: float) -> np.ndarray:
    """Which may be similar: False only where the counts show that they are not."""
    apart = np.maximum(np.abs(counts_a.astype(np.int16) - counts_b).sum(1, dtype=np.int64), np.abs(shingles_a - shingles_b))
    return apart <= (shingles_a + shingles_b) * ((1 - least) / (1 + least)) + 1e-6


def _bytes(column: pa.Array) -> np.ndarray:
    """A column of COUNTS as rows of an array."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTS)


def _unlinked(members: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of cells' members that have different roots and may be similar, each in the first of the buckets that both are in. Rows in order of their cells."""
    key, i, j, rep, root, block, shingles = (members.column(c).to_numpy() for c in ("key", "i", "j", "rep", "root", "block", "shingles"))
    counts = _bytes(members.column("counts"))
    parts = np.frombuffer(b"".join(members.column("bits").to_pylist()), "<u2").reshape(-1, PARTS)
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    table, crossed, out = key[starts] >> 2 * PART_BITS, i[starts] != j[starts], []
    for of, x, y in _meetings(np.diff(np.append(starts, len(key))), root):
        open_ = (root[x] != root[y]) & ~(crossed[of] & (block[x] == block[y]))
        of, x, y = of[open_], x[open_], y[open_]
        equal, each = parts[x] == parts[y], np.arange(len(x))
        k = equal.argmax(1)
        equal[each, k] = False
        first = PARTS * k + equal.argmax(1) == table[of]
        x, y = x[first], y[first]
        kept = _near(shingles[x], counts[x], shingles[y], counts[y], least)
        out.append((rep[x[kept]], rep[y[kept]]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *(o[n] for o in out)]) for n in (0, 1))
    return np.minimum(a, b), np.maximum(a, b)


def _cells(met: DataFrame, sides: DataFrame, size: int) -> DataFrame:
    """Buckets (key, rep, n) to the rows of their cells, one cell's after another: all members of a bucket, or of two of its blocks.

    A row meets its sides once, with all its buckets (a row has one for each table at most), and is dealt to them after that.
    """
    listed = met.groupBy("rep").agg(F.collect_list(F.struct("key", "n")).alias("buckets")).join(sides.hint("merge"), "rep")
    listed = listed.repartition(partitions(met.sparkSession))  # evenly, as each row becomes many
    placed = listed.select("rep", "root", "bits", "shingles", "counts", F.explode("buckets").alias("of")).select("*", "of.key", "of.n").drop("of")
    blocks = F.ceil(F.col("n") / size).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", "key"), "blocks").cast("int"))
    cells = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    rows = placed.withColumn("at", cells).select("key", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "rep", "root", "block", "bits", "shingles", "counts")
    return rows.repartition(partitions(met.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys start, and each row's run."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    return np.flatnonzero(new), np.cumsum(new) - 1


def _by_key(rows: DataFrame, order: str) -> DataFrame:
    bound_batches(rows.sparkSession)
    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", order)


def _buckets(rows: DataFrame) -> DataFrame:
    """key, rep, head (the bucket's smallest rep) of all rows whose key another row has, from rows key, rep. One pass over sorted rows, which holds a row of the open bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, head, waits = None, 0, False  # the open bucket's key and head, and whether the head is still alone
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep = (batch.column(c).to_numpy() for c in ("key", "rep"))
            if waits:
                key, rep = np.concatenate([[open_], key]), np.concatenate([[head], rep])
            starts, of = _runs(key)
            heads, sizes = rep[starts], np.diff(np.append(starts, len(key)))
            kept = sizes > 1
            if not waits and key[0] == open_:
                heads[0], kept[0] = head, True
            open_, head, waits = key[-1], heads[-1], not kept[-1]
            out = kept[of]
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(rep[out]), pa.array(heads[of][out])], names=["key", "rep", "head"])
        release()

    return _by_key(rows, "rep").mapInArrow(run, "key long, rep long, head long")


def _mixed(rows: DataFrame) -> DataFrame:
    """key, rep, n (the bucket's rows) of buckets that hold two roots or more, from rows key, rep, root.

    A bucket's sums travel with its rows and stand before them, so that one pass over sorted rows knows what to keep. A bucket is dealt
    to SALTS tasks, each with its sums."""
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    sums = sums.select(F.explode(F.sequence(F.col("key") * SALTS, F.col("key") * SALTS + (SALTS - 1))).alias("key"), F.lit(-1).cast("long").alias("rep"), "n")
    dealt = rows.select((F.col("key") * SALTS + F.pmod(F.xxhash64("rep"), F.lit(SALTS))).alias("key"), "rep", F.lit(0).cast("long").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, size = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, rep, n = (batch.column(c).to_numpy() for c in ("key", "rep", "n"))
            starts, of = _runs(key)
            sizes = np.where(rep[starts] < 0, n[starts], 0)
            if key[0] == open_:
                sizes[0] = size
            open_, size = key[-1], sizes[-1]
            out = (rep >= 0) & (sizes[of] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[out] // SALTS), pa.array(rep[out]), pa.array(sizes[of][out])], names=["key", "rep", "n"])
        release()

    return _by_key(sums.unionByName(dealt), "rep").mapInArrow(run, "key long, rep long, n long")


def _met(cells: DataFrame, least: float) -> DataFrame:
    """a, b of _unlinked() for all cells; a task holds one batch and the cell that goes on in the next."""
    bound_batches(cells.sparkSession)
    ids = ("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(c)[-1].as_py() for c in ids]
            goes_on = np.logical_and.reduce([batch.column(c).to_numpy() == x for c, x in zip(ids, last)])
            cut = batch.num_rows - int(goes_on.sum())
            if cut:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _unlinked(pa.Table.from_batches([*held, batch.slice(0, cut)]), least))), names=["a", "b"])
                held = [batch.slice(cut)]
            elif held and [held[0].column(c)[-1].as_py() for c in ids] != last:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _unlinked(pa.Table.from_batches(held), least))), names=["a", "b"])
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, _unlinked(pa.Table.from_batches(held), least))), names=["a", "b"])
        release()

    return cells.mapInArrow(run, "a long, b long")


def _checked(near: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs a, b whose texts are at least so similar."""
    met = near.hint("merge").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def check(batch: pa.RecordBatch) -> dict:
        out = []
        for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
            if similarity(_words(x.as_py()), _words(y.as_py()), shingle) >= least:
                out.append((a.as_py(), b.as_py()))
        return {"a": [x[0] for x in out], "b": [x[1] for x in out]}

    return written(per_batch(met.select("a", "b", "text_a", "text_b"), "a long, b long", check), "similar")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, cell: int) -> DataFrame:
    """doc_id, raw (MD5 of the text), root: one number for each group of similar texts.

    Texts of the same words collapse first, under a number of their own. Each row is checked against the HEADS heads (a bucket's
    smallest number) that it shares most buckets with; what that links gets one root. Then, in every bucket that holds two roots or more, all members with different
    roots meet one another, so a group of near copies lists few pairs and yet no two that share a bucket are left uncompared.
    """
    source = id_and_text(docs, id_col, text_col).withColumn("raw", F.md5("text"))

    def of(batch: pa.RecordBatch) -> dict:
        same, parts, shingles, counts = [], [], [], []
        for text in batch.column("text"):  # one text's words at a time
            words = _words(text.as_py())
            same.append(xxhash.xxh3_128_digest(b" ".join(words)))
            for column, x in zip((parts, shingles, counts), _sketch(words, shingle)):
                column.append(x)
        bits = [x.astype("<u2").tobytes() for x in parts]
        return {"doc_id": batch.column("doc_id"), "raw": batch.column("raw"), "same": same, "parts": parts, "bits": bits, "shingles": shingles, "counts": counts}

    fps = written(per_batch(source, "doc_id long, raw string, same binary, parts array<int>, bits binary, shingles long, counts binary", of), "wide")
    one = fps.groupBy("same").agg(F.min(F.struct("raw", "doc_id")).alias("row"), *(F.first(c).alias(c) for c in ("parts", "bits", "shingles", "counts")))
    reps = written(one.select(F.monotonically_increasing_id().alias("rep"), "same", "row.*", "parts", "bits", "shingles", "counts"), "representatives")
    last = F.lit(PARTS - 1)
    key = lambda i, j: F.lit(1 << 2 * PART_BITS).cast("long") * (PARTS * i + j) + F.col("parts")[i].cast("long") * (1 << PART_BITS) + F.col("parts")[j]
    tables = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: key(i, j)))))
    # each row becomes 210: spread over more tasks, so that what a task combines before the shuffle stays small
    rows = reps.repartition(4 * partitions(docs.sparkSession)).select("rep", tables.alias("key"))
    buckets = written(_buckets(rows), "buckets")
    shared = buckets.where("rep <> head").groupBy("rep", "head").agg(F.count("*").alias("n"))
    best = Window.partitionBy("rep").orderBy(F.desc("n"), "head")  # a row has a head for each of its buckets at most
    nearest = shared.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HEADS).select(F.col("head").alias("a"), F.col("rep").alias("b"))
    wanted = reps.select("rep", F.col("raw").alias("raw_"), F.col("doc_id").alias("id_")).hint("merge")
    texts = source.join(wanted, (F.col("raw") == F.col("raw_")) & F.col("doc_id").eqNullSafe(F.col("id_"))).select(F.col("rep").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    linked = _checked(nearest, texts, shingle, least)
    known = components(linked)
    root = written(reps.select("rep").join(known, reps.rep == known.node, "left").select("rep", F.coalesce("root", "rep").alias("root")), "roots")
    listed = buckets.groupBy("rep").agg(F.collect_list("key").alias("keys")).join(root.hint("merge"), "rep")  # 210 keys at most
    met = written(_mixed(written(listed.select(F.explode("keys").alias("key"), "rep", "root"), "rooted")), "mixed")
    sides = reps.join(root, "rep").select("rep", "bits", "shingles", "counts", "root")
    left = written(_met(_cells(met, sides, cell), least), "unlinked")
    roots = components(linked.unionByName(_checked(left, texts, shingle, least)))
    whole = reps.join(roots, reps.rep == roots.node, "left").select("same", F.coalesce("root", "rep").alias("root"))
    return fps.join(whole, "same").select("doc_id", "raw", "root")


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, cell: int = CELL) -> DataFrame:
    """doc_id, component_id (smallest id of the group): documents linked where their sets of shingles are at least so similar, words without regard to A-Z's case."""
    found = _grouped(docs, id_col, text_col, shingle, least, cell)
    return found.join(found.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row, with all its columns, of each group of similar texts: that with the smallest id, or without an id where none has one.

    Rows with one id and unlike texts are in groups of their own; of a group's rows with that id, the text with the smallest MD5 stays,
    and of equal ones any. Null and empty texts, and those of white space, are one group. No rows give no rows.
    """
    found = _grouped(docs, id_col, text_col, shingle, least, CELL)
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "raw")
    rows_of = found.groupBy("root", "doc_id", "raw").agg(F.count("*").alias("n"))
    chosen = rows_of.groupBy("root").agg(F.min_by("n", first).alias("n"), F.min(first).alias("at"))
    kept_id, kept_raw, kept_n = (unused(docs.columns, x) for x in ("kept_id", "kept_raw", "kept_n"))
    kept = written(chosen.select(F.col("at.doc_id").alias(kept_id), F.col("at.raw").alias(kept_raw), F.col("n").alias(kept_n)), "kept")
    same_row = docs[id_col].cast("long").eqNullSafe(kept[kept_id]) & (F.md5(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == kept[kept_raw])
    rows = docs.join(kept.hint("merge"), same_row)  # one plan at every size: the ids grow with the documents
    single, several = rows.where(F.col(kept_n) == 1).drop(kept_id, kept_raw, kept_n), kept.where(F.col(kept_n) > 1)
    if several.isEmpty():
        return single
    numbered = Window.partitionBy(kept_id, kept_raw).orderBy(F.lit(0))
    return single.unionByName(rows.where(F.col(kept_n) > 1).withColumn(kept_n, F.row_number().over(numbered)).where(F.col(kept_n) == 1).drop(kept_id, kept_raw, kept_n))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
