"""Token ids of many texts from the ids of their chunks.

A chunk is what stands between single spaces. Byte-level patterns start a new match at a single space between other
characters, so a chunk's ids are the same wherever it stands, and a worker finds them once while it remembers them. A
text in which white space meets a space is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class ChunkCoder:
    """after: ids of chunks that follow a space, with it; whole: ids of texts. Both give little-endian unsigned 32-bit integers.

    `remembered` chunks are kept as lately met, and as many again that were met before those.
    """

    def __init__(self, after: Callable[[list[str]], list[bytes]], whole: Callable[[list[str]], list[bytes]], remembered: int = 400_000) -> None:
        self.after, self.whole, self.remembered = after, whole, remembered
        self.late: dict[str, bytes | None] = {}  #: None: the text must be encoded whole
        self.early: dict[str, bytes | None] = {}

    def _known(self, chunks: list[str]) -> list[bytes | None]:
        new = [x for x in chunks if x not in self.late]
        if new and len(self.late) + len(new) > self.remembered:
            self.early, self.late, new = self.late, {}, chunks
        if new:
            late, early = self.late, self.early
            if early:
                again = {x: early[x] for x in new if x in early}
                late.update(again)
                new = [x for x in new if x not in again]
            fresh = [x for x in new if x.strip() is x]
            if len(fresh) < len(new) or "" in new:
                late.update((x, None) for x in new if not x or x.strip() is not x)
                fresh = [x for x in fresh if x]
            late.update(zip(fresh, self.after(fresh)))
        return list(map(self.late.__getitem__, chunks))

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin, with the end of the last."""
        lists = pc.split_pattern(texts, " ")
        edges = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        starts, coded = edges[:-1], lists.flatten().dictionary_encode()
        at, chunks = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        table = self._known(chunks)
        firsts = [chunks[i] for i in at[starts].tolist()]
        lone = np.diff(edges) == 1
        odd = np.array([x is None for x in table])[at]
        odd[starts] = [(not x or x[-1].isspace()) and not one for x, one in zip(firsts, lone.tolist())]
        odd = np.logical_or.reduceat(odd, starts)
        n, nothing = len(table), len(table) + len(starts)
        heads = self.whole(firsts)
        for i in np.flatnonzero(odd).tolist():
            heads[i] = self.whole([texts[i].as_py()])[0]
            at[starts[i] + 1 : edges[i + 1]] = nothing
        at[starts] = n + np.arange(len(starts))
        table = [x or b"" for x in table] + heads + [b""]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        places, taken = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.cumsum(taken)
        ids = flat[np.repeat(places - ends + taken, taken) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends[edges[1:] - 1]])

    def encode_each(self, texts: pa.StringArray) -> list[bytes]:
        ids, edges = self.encode(texts)
        body, edges = ids.tobytes(), (4 * edges).tolist()
        return [body[a:b] for a, b in zip(edges, edges[1:])]
