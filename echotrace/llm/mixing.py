"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations alone.

Every source's documents stand in the order of a hash of id and text and make a stream of words, repeated as often as its target
asks. The stream is cut into blocks of equal numbers of words, which are shuffled within a pass over the source. The mix is a row of
N slots, one for each whole block: slot i has the point (i g mod N) / N of a golden-ratio lattice (g is the number next to N / phi
that shares no divisor with N), which the sources' cumulative blocks map to a source. Each source's slots are ranked in the
mix's order, and the r-th takes the source's r-th shuffled block. All N points of the lattice differ, so a source gets exactly
its number of blocks, spread as evenly over the mix as the golden ratio spreads points; what its target leaves over a whole
block is a last, shorter block, marked as tail, after a slot of its own.

Targets share all words by weight; none is above REPEATS times its source's words, and the excess is shared again by weight among the
others until none is above. A source takes its target, rounded to words.

Sums and ranks within a source are taken in sections of about SECTION rows and then over sections, so no task holds a source.

Defined cases: a null text has no words, and documents without words are in no span; null is a source of its own, the last in order; a
null id is hashed as no text; repeated rows are rows each, any of which can stand for the other; other columns are not read;
a source of weight 0 gets nothing; if all words are none, or there are no rows, the mix is empty and targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.llm.common import id_and_text, numbered, partitions, table, written

#: Weights of sources in the order of their names, repeating; the times that a source's words may be taken; seed of the orders.
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 42
#: Words of a block; slots at most, so that products of two slots stay in a long (blocks are larger beyond); rows of a section, about.
BLOCK_WORDS, SLOTS, SECTION = 1024, 1 << 31, 1 << 12
#: What parts words: the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
PHI = (1 + math.sqrt(5)) / 2


def sized(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words), raw (the text's MD5), key (what a source's documents are ordered by)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), F.md5("text").alias("raw"))
    return rows.withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "raw")))


def targets(rows: DataFrame, weights: DataFrame | tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, no (from 1, by code point, null last), weight, source_size, target. weights: of sources in order, or a table source, weight."""
    found = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.asc_nulls_last("source")], "no")
    if isinstance(weights, DataFrame):
        given = weights.groupBy(F.col("source").cast("string").alias("named")).agg(F.max("weight").cast("decimal(20,6)").alias("weight"))
        found = found.join(given, found.source.eqNullSafe(given.named), "left").drop("named").withColumn("weight", F.coalesce("weight", F.lit(0).cast("decimal(20,6)")))
    else:
        found = found.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")).cast("decimal(20,6)"))
    found = written(found, "sources")
    most, share, capped = F.col("source_size") * repeats, 0.0, -1
    while True:  # a round more for sources that the last excess has lifted to their bound
        above = most.cast("double") < F.col("weight").cast("double") * F.lit(share)
        row = found.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, most)).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if row.n == capped or not row.all or not row.open:
            break
        capped, share = row.n, float(row.all - (row.held or 0)) / float(row.open)
    return found.withColumn("target", F.least(most.cast("double"), F.col("weight").cast("double") * F.lit(share)))


def _sections(rows: int) -> int:
    """A power of two: sections that all rows together fill."""
    return 1 << max(0, math.ceil(math.log2(max(1, rows) / SECTION)))


def _top(hash_: Column, sections: int) -> Column:
    """The first bits of a 64-bit hash, as a section's number."""
    return F.shiftrightunsigned(hash_, 64 - sections.bit_length() + 1) if sections > 1 else F.lit(0).cast("long")


def _before(rows: DataFrame, group: str, section: str, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """The sum of value over the rows before each in its group, by section and order."""
    sums = rows.groupBy(group, section).agg(F.sum(value).alias("v"))
    sums = sums.select(group, section, F.coalesce(F.sum("v").over(Window.partitionBy(group).orderBy(section).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(value).over(Window.partitionBy(group, section).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn(name, own).join(sums, [group, section]).withColumn(name, F.col(name) + F.col("base")).drop("base")


def lattice(n: int) -> tuple[int, int]:
    """g next to n / phi that shares no divisor with n, and its inverse modulo n."""
    if n < 2:
        return 0, 0
    g = next(x for d in range(n) for x in (round(n / PHI) + d, round(n / PHI) - d) if 0 < x < n and math.gcd(x, n) == 1)
    return g, pow(g, -1, n)


class Mix:
    """sources: targets() with take (words). placed: doc_id, source, no, size, raw, at (words of the source's stream before it).
    spans: what the mix takes, in the order of position, tail, offset: no, at, doc_id, raw, start (word of the document), words."""

    def __init__(self, docs: DataFrame, weights: DataFrame | tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int = BLOCK_WORDS, seed: int = SEED, **columns: str) -> None:
        rows = written(sized(docs, seed, **columns), "sized")
        counts = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
        self.block = max(block, -(-counts.words // SLOTS))
        self.sources = written(targets(rows, weights, repeats).withColumn("take", F.floor(F.col("target") + 0.5).cast("long")), "targets")
        named = self.sources.select(F.col("source").alias("named"), "no", "source_size", "target", "take")
        placed = rows.join(named, rows.source.eqNullSafe(named.named)).drop("named")
        placed = placed.withColumn("section", _top(F.conv(F.substring("key", 1, 16), 16, -10).cast("long"), _sections(counts.n)))
        self.placed = written(_before(placed, "no", "section", ["key", "doc_id", "size"], F.col("size"), "at").drop("section", "key"), "placed")
        self.spans = written(self._spans(seed), "spans")

    def _slots(self, seed: int) -> DataFrame:
        """position, tail, no, b: the block of its source that each slot takes."""
        b, blocks = F.lit(self.block).cast("long"), F.floor(F.col("take") / self.block).cast("long")
        own = self.sources.where("take > 0").select("no", "source_size", "take", blocks.alias("blocks"))
        end = numbered(own, [F.asc("no")], "place")  # cumulative blocks: sums in ranges of sources, then over ranges
        end = self._cumulative(end)
        n = int(end.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
        g, inverse = lattice(n)
        tails = end.where(F.col("take") > F.col("blocks") * b).select(
            F.floor(F.col("no") / PHI % 1 * max(0, n - 1)).cast("long").alias("position"), F.lit(True).alias("tail"), "no", F.col("blocks").alias("b")
        )
        if not n:
            return tails
        chunk = F.explode(F.sequence(F.floor(F.col("first") / SECTION), F.floor((F.col("first") + F.col("blocks") - 1) / SECTION))).alias("chunk")
        chunks = end.where("blocks > 0").select("no", "source_size", "first", "blocks", chunk).repartition(partitions(end.sparkSession))
        low, high = F.greatest(F.col("first"), F.col("chunk") * SECTION), F.least(F.col("first") + F.col("blocks"), (F.col("chunk") + 1) * SECTION)
        points = chunks.select("no", "source_size", "first", F.explode(F.sequence(low, high - 1)).alias("j")).select("no", "source_size", (F.col("j") - F.col("first")).alias("b"), (F.col("j") * F.lit(inverse).cast("long") % n).alias("position"))
        ranked = _before(points.withColumn("section", F.floor(F.col("position") / SECTION)), "no", "section", ["position"], F.lit(1), "rank")
        hashed, sections = F.xxhash64(F.lit(seed), "no", "b"), _sections(n)
        shuffled = points.withColumn("hash", hashed).withColumn("section", F.floor(F.col("b") * b / F.col("source_size")) * sections + _top(F.col("hash"), sections))
        shuffled = _before(shuffled, "no", "section", ["hash", "b"], F.lit(1), "rank")
        return ranked.select("position", F.lit(False).alias("tail"), "no", "rank").join(shuffled.select("no", "rank", "b"), ["no", "rank"]).drop("rank").unionByName(tails)

    @staticmethod
    def _cumulative(placed: DataFrame) -> DataFrame:
        """first: the blocks of all sources before."""
        return _before(placed.withColumn("one", F.lit(1)).withColumn("section", F.floor(F.col("place") / SECTION)), "one", "section", ["place"], F.col("blocks"), "first").drop("one", "section", "place")

    def _spans(self, seed: int) -> DataFrame:
        begin = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("take") - F.col("at") - 1) / F.col("source_size"))), lambda e: e * F.col("source_size") + F.col("at"))).alias("begin")
        passes = self.placed.where("size > 0 and at < take").select("no", "at", "doc_id", "raw", "size", "take", begin)
        passes = passes.withColumn("end", F.least(F.col("begin") + F.col("size"), "take"))
        block = F.explode(F.sequence(F.floor(F.col("begin") / self.block), F.floor((F.col("end") - 1) / self.block))).alias("b")
        pieces = passes.select("no", "at", "doc_id", "raw", "begin", "end", block)
        low = F.greatest(F.col("begin"), F.col("b") * self.block)
        pieces = pieces.select(
            "no", "b", "at", "doc_id", "raw", (low - F.col("begin")).alias("start"), (F.least(F.col("end"), (F.col("b") + 1) * self.block) - low).alias("words"), (low - F.col("b") * self.block).alias("offset")
        )
        return self._slots(seed).join(pieces, ["no", "b"]).drop("b")

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: the words that the mix takes of each document."""
        words = self.spans.groupBy("no", "at").agg(F.sum("words").alias("taken")).withColumn("some", F.lit(True))
        rows = self.placed.withColumn("some", F.col("size") > 0)  # documents without words stand where the next one stands
        return rows.join(words, ["no", "at", "some"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

    def texts(self, docs: DataFrame, **columns: str) -> DataFrame:
        """position, tail, offset, doc_id, text: the spans' words, with one space between."""
        source = id_and_text(docs, **columns).select(F.col("doc_id").alias("id"), F.md5("text").alias("md5"), "text").dropDuplicates(["id", "md5"])
        met = self.spans.join(source, self.spans.doc_id.eqNullSafe(source.id) & (F.col("raw") == F.col("md5")))
        words = F.slice(F.regexp_extract_all("text", F.lit(WORD), 0), (F.col("start") + 1).cast("int"), F.col("words").cast("int"))
        return met.select("position", "tail", "offset", "doc_id", F.array_join(words, " ").alias("text"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to weights of 5, 2 and 1."""
    return Mix(table(spark, sf_dir, "documents")).taken()


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             md5(concat('42:', doc_id, ':', md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size / w AS bound, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY bound, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(w) OVER (ORDER BY bound, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM r),
g AS (SELECT coalesce(arg_min(share, bound), 0) AS share FROM f WHERE 3 * source_size >= share * w),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, g.share * w) AS target, floor(least(3.0::DOUBLE * source_size, g.share * w) + 0.5)::BIGINT AS take FROM r, g),
p AS (SELECT d.*, source_size, target, take, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE take // source_size * size + least(greatest(take % source_size - ahead, 0), size) END::BIGINT AS taken
FROM p
"""
