"""Token ids by the tokenizers library, each distinct word of a batch encoded once.

A byte-level pre-tokenizer starts a new piece at a single space between other characters, and keeps letters apart
from the punctuation after them. So a batch is cut at spaces into chunks, a chunk into its letters and its
punctuation; the library encodes what is distinct, many to a string (only a chunk's first token starts with a space,
which tells them apart), and the texts' ids are gathered from those. A text in which white space meets a space is
encoded whole. Nothing is remembered between batches.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks in a string that the library encodes, and strings it encodes at a time: what it returns for them takes far more memory than the ids.
JOINED, AT_ONCE = 100, 1000
#: White space of the pre-tokenizer's pattern, and ASCII punctuation.
SPACES = r"\t\n\x0b\x0c\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = f"^$|^[{SPACES}]|[{SPACES}]$"


class Table:
    """Lists of ids in a row, with where each begins and how many it has."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.sizes = ids, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, at: np.ndarray) -> Table:
        sizes = self.sizes[at]
        total = int(sizes.sum())
        begin = np.repeat((self.starts[at] - np.cumsum(sizes) + sizes).astype(np.int32), sizes)  # a batch has less than 2^31 ids
        begin += np.arange(total, dtype=np.int32)
        return Table(self.ids[begin], sizes)

    def joined(self, other: Table) -> Table:
        return Table(np.concatenate([self.ids, other.ids]), np.concatenate([self.sizes, other.sizes]))

    def merged(self, counts: np.ndarray) -> Table:
        """Consecutive lists put together, counts of them at a time."""
        edges = np.concatenate([[0], np.cumsum(self.sizes)])
        ends = np.cumsum(counts)
        return Table(self.ids, edges[ends] - edges[ends - counts])


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.spaced = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(self.library.get_vocab_size())])

    def _table(self, texts: list[str]) -> Table:
        ids, sizes = [np.zeros(0, np.uint32)], []
        for at in range(0, len(texts), AT_ONCE):
            found = [e.ids for e in self.library.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
            some = list(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), np.uint32, sum(some)))
            sizes += some
        return Table(np.concatenate(ids), np.array(sizes, np.int64))

    def _after_space(self, chunks: list[str]) -> Table:
        whole = self._table([" " + " ".join(chunks[i : i + JOINED]) for i in range(0, len(chunks), JOINED)])
        starts = np.flatnonzero(self.spaced[whole.ids])
        if len(starts) == len(chunks):
            return Table(whole.ids, np.diff(np.append(starts, len(whole.ids))))
        return self._table([" " + x for x in chunks])  # a vocabulary that joins them

    def encode(self, texts: pa.StringArray) -> Table:
        """A list of ids for each text, without special tokens."""
        lists = pc.split_pattern(texts, " ")
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        words = lists.flatten().dictionary_encode()
        at, chunks, starts, counts = words.indices.to_numpy().astype(np.int64), words.dictionary, edges[:-1], np.diff(edges)
        first = chunks.take(pa.array(at[starts]))
        edge = pc.match_substring_regex(chunks, _EDGE).to_numpy(zero_copy_only=False)
        bad = edge[at]
        # a text's first chunk may begin with any white space but must not end with it, or be empty, before a space
        bad[starts] = pc.match_substring_regex(first, f"^$|[{SPACES}]$").to_numpy(zero_copy_only=False) & (counts > 1)
        odd = np.logical_or.reduceat(bad, starts)
        stems = pc.utf8_rtrim(chunks, characters=MARKS)
        parted = pc.and_(pc.utf8_is_alpha(stems), pc.not_equal(stems, chunks))
        stem = pc.if_else(edge, "x", pc.if_else(parted, stems, chunks)).dictionary_encode()
        tail = pc.if_else(parted, pc.replace_substring_regex(chunks, r"^\pL+", ""), "").dictionary_encode()
        parts = self._after_space(stem.dictionary.to_pylist()).joined(self._table(tail.dictionary.to_pylist()))
        pairs = np.stack([stem.indices.to_numpy(), tail.indices.to_numpy() + len(stem.dictionary)], axis=1).ravel()
        table = parts.take(pairs).merged(np.full(len(chunks), 2))
        heads = first.to_pylist()
        for i in np.flatnonzero(odd).tolist():
            heads[i] = texts[i].as_py()
        table = table.joined(self._table(heads)).joined(Table(np.zeros(0, np.uint32), np.zeros(1, np.int64)))
        at[np.repeat(odd, counts)] = len(table.sizes) - 1
        at[starts] = len(chunks) + np.arange(len(starts))
        return table.take(at).merged(counts)

    def encode_each(self, texts: pa.StringArray) -> list[bytes]:
        """Little-endian unsigned 32-bit integers, a text each."""
        found = self.encode(texts)
        body, edges = found.ids.astype("<u4").tobytes(), [*(4 * found.starts).tolist(), 4 * len(found.ids)]
        return [body[a:b] for a, b in zip(edges, edges[1:])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
