"""Byte-level BPE encoding and decoding by DuckDB recursive queries, one connection a Python worker.

Texts are put together from chunks (see chunks.py), which each worker encodes once while it remembers them. The
split pattern's matches inside new chunks become token-position rows; a recursive query joins neighbours with the merge table
and contracts each word's leftmost pair of minimum rank until no pair is left. For short words each round is a new set of
rows; for words of more than SHORT_WORD bytes rounds change their rows in place (USING KEY), so memory grows with the word alone.
A round looks at all of a word's pairs, so time grows with the square of its length (15 s for 5,000 bytes): beyond LONGEST_WORD
bytes the same contraction goes by a heap, which the tests hold against both queries.
Decoding joins each document's ids with the vocabulary and concatenates the bytes by ordered aggregation.

Defined cases: a null or empty text has no ids, and decodes to no bytes; repeated rows keep one output row each;
null ids pass through; no rows give no rows. Every string is ordinary text, special tokens' names included.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import string

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from echotrace.llm.chunks import ChunkCoder
from echotrace.llm.common import id_and_text, per_batch, table

SHORT_WORD = 128  # less than the 1024 places that the query packs beside a rank
LONGEST_WORD = 4096
#: Words a worker remembers as lately met; it keeps as many again that were met before those.
REMEMBERED = 500_000
#: Ids decoded by one query.
DECODED = 1 << 20

MERGES = """
CREATE TABLE merges AS
SELECT a.id AS l, b.id AS r, t.id AS id
FROM (SELECT id, piece, unnest(range(2, length(piece), 2)) AS cut FROM vocabulary) t
JOIN vocabulary a ON a.piece = t.piece[:t.cut] JOIN vocabulary b ON b.piece = t.piece[t.cut + 1:]
"""

#: words(word, piece in hex) to ids in order. A word's last round holds its final tokens; a word that is a token itself is that token.
ENCODE = """
WITH RECURSIVE known AS MATERIALIZED (SELECT w.word, v.id FROM words w JOIN vocabulary v USING (piece)),
state(round, word, pos, id, following, following_pos) AS (
    SELECT 0, word, pos, id, lead(id) OVER w, lead(pos) OVER w
    FROM (
        SELECT b.word, b.pos, v.id
        FROM (SELECT word, piece, unnest(range(0, length(piece) // 2)) AS pos FROM words WHERE word NOT IN (SELECT word FROM known)) b
        JOIN vocabulary v ON v.piece = b.piece[2 * b.pos + 1 : 2 * b.pos + 2]
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION ALL
    (WITH chosen AS (
        SELECT s.word, min(m.id::BIGINT * 1024 + s.pos) AS best, arg_min(s.following_pos, m.id::BIGINT * 1024 + s.pos) AS gone
        FROM state s JOIN merges m ON m.l = s.id AND m.r = s.following GROUP BY s.word
    ), contracted AS (
        SELECT s.round + 1 AS round, s.word, s.pos, CASE WHEN s.pos = c.best % 1024 THEN (c.best // 1024)::INTEGER ELSE s.id END AS id
        FROM state s JOIN chosen c USING (word) WHERE s.pos <> c.gone
    )
    SELECT round, word, pos, id, lead(id) OVER w, lead(pos) OVER w FROM contracted WINDOW w AS (PARTITION BY word ORDER BY pos))
), last AS (SELECT word, max(round) AS round FROM state GROUP BY word)
SELECT word, list(id ORDER BY pos) AS ids FROM state JOIN last USING (word, round) GROUP BY word
UNION ALL SELECT word, [id] FROM known
"""

#: The same for long words: a round writes the token that grows, the one that goes and the one before them.
ENCODE_LONG = """
WITH RECURSIVE state(word, pos, id, following, following_pos) USING KEY (word, pos) AS (
    SELECT word, pos, id, lead(id) OVER w, lead(pos) OVER w
    FROM (
        SELECT b.word, b.pos, v.id
        FROM (SELECT word, piece, unnest(range(0, length(piece) // 2)) AS pos FROM words) b
        JOIN vocabulary v ON v.piece = b.piece[2 * b.pos + 1 : 2 * b.pos + 2]
    ) WINDOW w AS (PARTITION BY word ORDER BY pos)
    UNION
    (WITH pairs AS (
        SELECT s.word, s.pos, s.following_pos, m.id
        FROM recurring.state s JOIN merges m ON m.l = s.id AND m.r = s.following
        WHERE s.word IN (SELECT word FROM state)
    ), chosen AS (
        SELECT word, min(struct_pack(id := id, pos := pos, gone := following_pos)) AS best FROM pairs GROUP BY word
    ), taken AS (
        SELECT c.word, c.best, g.following, g.following_pos FROM chosen c JOIN recurring.state g ON g.word = c.word AND g.pos = c.best.gone
    )
    SELECT word, best.gone, NULL::INTEGER, NULL::INTEGER, NULL::BIGINT FROM taken
    UNION ALL
    SELECT word, best.pos, best.id, following, following_pos FROM taken
    UNION ALL
    SELECT c.word, p.pos, p.id, c.best.id, c.best.pos FROM chosen c JOIN recurring.state p ON p.word = c.word AND p.following_pos = c.best.pos AND p.id IS NOT NULL)
)
SELECT word, list(id ORDER BY pos) AS ids FROM state WHERE id IS NOT NULL GROUP BY word
"""

DECODE = "SELECT t.doc, string_agg(v.piece, '' ORDER BY t.pos) AS bytes FROM tokens t JOIN vocabulary v USING (id) GROUP BY t.doc"


def contract(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as the recursive queries', by a heap over linked neighbours."""
    n = len(word)
    end, after, before = [*range(1, n + 1)], [*range(1, n + 1)], [*range(-1, n - 1)]
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
            k = end[after[i]]
            if (rank := ranks.get(word[i:k])) is not None:
                heapq.heappush(heap, (rank, i, k))
        if (p := before[i]) >= 0 and (rank := ranks.get(word[p : end[i]])) is not None:
            heapq.heappush(heap, (rank, p, end[i]))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("CREATE TABLE vocabulary (id INTEGER, piece VARCHAR)")
        self.db.register("vocabulary_rows", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "piece": [x.hex() for x in self.ranks]}))
        self.db.execute("INSERT INTO vocabulary SELECT id, piece FROM vocabulary_rows")
        self.db.unregister("vocabulary_rows")
        self.db.execute(MERGES)
        self.words: dict[str, bytes] = {}  #: lately met
        self.early: dict[str, bytes] = {}  #: met before those
        self.chunks = ChunkCoder(self._after, lambda x: self._found([self.pattern.findall(c) for c in x]), 300_000)

    def _learn_words(self, new: list[str]) -> None:
        coded = [x.encode() for x in new]
        runs: dict[str, list[int]] = {ENCODE: [], ENCODE_LONG: []}
        for i, (w, b) in enumerate(zip(new, coded)):
            if len(b) <= SHORT_WORD:
                runs[ENCODE].append(i)
            elif b in self.ranks:
                self.words[w] = np.array([self.ranks[b]], "<u4").tobytes()
            elif len(b) <= LONGEST_WORD:
                runs[ENCODE_LONG].append(i)
            else:
                self.words[w] = np.array(contract(b, self.ranks), "<u4").tobytes()
        for query, some in runs.items():
            if some:
                self._contract(query, some, new, coded)

    def _contract(self, query: str, some: list[int], new: list[str], coded: list[bytes]) -> None:
        self.db.register("words", pa.table({"word": pa.array(some, pa.int32()), "piece": [coded[i].hex() for i in some]}))
        for batch in self.db.sql(query).to_arrow_reader(65536):
            lists = batch.column("ids")
            flat, at = lists.flatten().to_numpy().astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
            at -= at[0]
            for i, a, b in zip(batch.column("word").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                self.words[new[i]] = flat[a:b]
        self.db.unregister("words")

    def _found(self, parts: list[list[str]]) -> list[bytes]:
        wanted = {w for p in parts for w in p}
        if (missing := wanted.difference(self.words)) and len(self.words) + len(missing) > REMEMBERED:
            self.early, self.words, missing = self.words, {}, wanted
        if again := missing.intersection(self.early):
            self.words.update((w, self.early[w]) for w in again)
            missing = missing.difference(again)
        if missing:
            self._learn_words(list(missing))
        words = self.words
        return [words[p[0]] if len(p) == 1 else b"".join([words[w] for w in p]) for p in parts]

    def _after(self, chunks: list[str]) -> list[bytes]:
        """Letters and the punctuation after them are separate matches; other chunks are left to the pattern."""
        marks, find = string.punctuation, self.pattern.findall
        stems = [x.rstrip(marks) for x in chunks]
        return self._found([([" " + s, x[len(s) :]] if len(s) < len(x) else [" " + s]) if s.isalpha() else find(" " + x) for s, x in zip(stems, chunks)])

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a text each."""
        return self.chunks.encode_each(texts)

    def decode(self, ids: list[bytes]) -> list[bytes]:
        out, at = [b""] * len(ids), 0
        while at < len(ids):
            stop, size = at, 0
            while stop < len(ids) and (stop == at or size + len(ids[stop]) // 4 <= DECODED):
                size += len(ids[stop]) // 4
                stop += 1
            flat = np.frombuffer(b"".join(ids[at:stop]), "<u4").astype(np.int32)
            docs = np.repeat(np.arange(at, stop, dtype=np.int32), [len(x) // 4 for x in ids[at:stop]])
            self.db.register("tokens", pa.table({"doc": docs, "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
            for doc, piece in self.db.execute(DECODE).fetchall():
                out[doc] = bytes.fromhex(piece)
            self.db.unregister("tokens")
            at = stop
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers)."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "ids": codec(path).encode(batch.column("text"))}

    return per_batch(id_and_text(docs, id_col, text_col), "doc_id long, ids binary", of)


def decode(coded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids to doc_id, bytes; bytes that are no UTF-8 text stay as they are."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "bytes": codec(path).decode([x or b"" for x in batch.column("ids").to_pylist()])}

    return per_batch(coded.select("doc_id", "ids"), "doc_id long, bytes binary", of)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes in one pass over the texts; only digests leave it."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def of(batch: pa.RecordBatch) -> dict:
        c = codec(path)
        ids = c.encode(batch.column("text"))
        return {
            "doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in c.decode(ids)],
        }

    return per_batch(id_and_text(table(spark, sf_dir, "documents")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", of)
