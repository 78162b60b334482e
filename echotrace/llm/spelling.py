"""Spelling variants: words one error apart, found with forward and backward minimal automata.

If two words differ by one inserted, deleted or replaced code point, then one half of the first stands in the second unchanged: at its
beginning or at its end. So every word goes, under the key of a half, to the tasks where the words that share this half are.
A task holds minimal acyclic automata of its words, read forwards and backwards, whose states count the words that
they lead to: a path's counts add up to a word's number, by which its frequency is found. From each word the half is followed exactly,
in the direction from its own end, and the other half is completed with one error. What the first half finds is left out
when the last half finds it again.

Keys hold the word's length too. A key with more than HOT words is split: the part that isn't matched yet is halved again, and
either its first half is matched exactly as well, or its last half is. Of one code point left no key has more words than the alphabet
makes, so keys end up small without blocks that all words would have to meet.

Defined cases: null and empty texts have no words; a null id counts as empty text; rows with one id and repeated rows are rows
each; at equal frequency the form is the first word in code-point order; a form has at least RATIO times the word's frequency, so
forms never go round in a circle; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import bound_batches, release, table, written

LEAST_LENGTH, LEAST_COUNT, RATIO, EVERY = 5, 3, 2, 97
#: Different words that a task counts before it passes the counts on; rows of a task's automata, about; words of a key at most.
COUNTED, TASK_ROWS, HOT = 200_000, 60_000, 20_000
#: In Latin-1: letters stay, A-Z become small, all others part words; what Latin-1 lacks has become a question mark.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 192 or 97 <= b <= 122 else 32 for b in range(256))


# --- counting ----------------------------------------------------------------------------------------------------------------


def words_of(doc_id: int | None, text: str, least: int = LEAST_LENGTH, every: int = EVERY) -> Iterator[tuple[bytes, int]]:
    """A text's words, in Latin-1, with their counts: runs of letters, of which the CRC-32 of id and run tells some that lose a code point."""
    runs = Counter(text.encode("latin-1", "replace").translate(_BYTES).split())
    state = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
    for run, n in runs.items():
        if len(run) >= least:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), state)
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < least:
                    continue
            yield run, n


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of enough code points and occurrences in all texts."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def rows(counts: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in words_of(doc_id, text.as_py(), least):
                    counts[word] = counts.get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)
        release()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


# --- automata ----------------------------------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of words in ascending order. edges: a state's code points, each with the next state and how many
    words come before those over it; a word's number is the sum on its path, its place in the order."""

    def __init__(self, words: list[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        open_: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]  # states on the last word's path

        def close(path: str, down_to: int) -> None:
            while len(open_) > down_to + 1:
                (final,), edges = open_.pop()
                open_[-1][1].append((path[len(open_) - 1], self._state(final, edges, known)))

        last = ""
        for word in words:
            same = next((i for i, (a, b) in enumerate(zip(last, word)) if a != b), min(len(last), len(word)))
            close(last, same)
            open_.extend(([False], []) for _ in word[same:])
            open_[-1][0][0] = True
            last = word
        close(last, 0)
        (final,), edges = open_[0]
        self.root = self._state(final, edges, known)

    def _state(self, final: bool, edges: list[tuple[str, int]], known: dict[tuple, int]) -> int:
        key = (final, *edges)
        found = known.get(key)
        if found is None:
            found = known[key] = len(self.edges)
            out, before = {}, int(final)
            for c, to in edges:
                out[c] = (to, before)
                before += self._sizes[to]
            self.edges.append(out)
            self.final.append(final)
            self._sizes.append(before)
        return found

    def follow(self, word: str, state: int | None = None, number: int = 0) -> tuple[int, int] | None:
        """The state that the word leads to, and the sum on the way; None if there is no such path."""
        state = self.root if state is None else state
        edges = self.edges
        for c in word:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` code points and differ from the word by one inserted, deleted or replaced code point."""
        at, out = self.follow(word[:exact]), set()
        if at is None:
            return out
        state, number = at

        def add(rest: str, state: int, number: int) -> None:
            if (end := self.follow(rest, state, number)) and self.final[end[0]]:
                out.add(end[1])

        for i in range(exact, len(word) + 1):
            rest = word[i:]
            for c, (to, n) in self.edges[state].items():
                add(rest, to, number + n)  # c comes in
                if rest and c != rest[0]:
                    add(rest[1:], to, number + n)  # c stands for another
            if not rest:
                break
            add(rest[1:], state, number)  # one is left out
            step = self.edges[state].get(rest[0])
            if step is None:
                break
            state, number = step[0], number + step[1]
        return out


def _matched(rows: list[tuple]) -> Iterator[tuple[str, int, str | None, int | None]]:
    """word, its near words here, and the most frequent of them with its frequency; rows: word, n, length, head, tail, skip."""
    for backward in (False, True):
        some = [r for r in rows if (r[4] > r[3]) == backward]
        counts = {(w[::-1] if backward else w): n for w, n, *_ in some}
        words = sorted(counts)
        found, frequencies = Automaton(words), [counts[w] for w in words]
        for word, _, length, head, tail, skip in some:
            if len(word) != length:
                continue  # it is here to be found
            best_n, best, near = 0, "", 0
            for i in found.near(word[::-1] if backward else word, tail if backward else head):
                other = words[i][::-1] if backward else words[i]
                if skip and other[:skip] == word[:skip]:
                    continue  # found from its beginning
                if backward and other[:head] != word[:head] or not backward and tail and other[-tail:] != word[-tail:]:
                    continue  # found under another key
                near, n = near + 1, frequencies[i]
                if n > best_n or n == best_n and other < best:
                    best_n, best = n, other
            if near:
                yield word, near, best, best_n


# --- keys --------------------------------------------------------------------------------------------------------------------


def _keys(rows: DataFrame) -> DataFrame:
    """key: the length of the words that ask, the numbers of code points matched at both ends, and these."""
    ends = F.expr("substring(word, 1, head)"), F.expr("if(tail > 0, right(word, tail), '')")
    return rows.withColumn("key", F.concat_ws(" ", "length", "head", "tail", *ends))


def _halves(words: DataFrame) -> DataFrame:
    """A row for each half by which a word can be found, and by which it asks (where length is its own): word, n, length, head, tail, skip."""
    lengths = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("length")
    half = F.floor(F.col("length") / 2).cast("int")
    zero = F.lit(0)
    sides = F.explode(F.array(F.struct(half.alias("head"), zero.alias("tail"), zero.alias("skip")), F.struct(zero.alias("head"), (F.col("length") - half).alias("tail"), half.alias("skip")))).alias("side")
    return _keys(words.select("word", "n", lengths).select("word", "n", "length", sides).select("word", "n", "length", "side.*"))


def _split(rows: DataFrame) -> DataFrame:
    """The rows of too large keys under two longer ones: of what isn't matched, the first half is matched as well, or else the last."""
    more = F.floor((F.col("length") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + more).alias("head"), "tail", "skip")
    last = F.struct("head", (F.col("length") - F.col("head") - more).alias("tail"), (F.col("head") + more).alias("skip"))
    return _keys(rows.select("word", "n", "length", F.explode(F.array(first, last)).alias("side")).select("word", "n", "length", "side.*"))


def near_words(words: DataFrame, hot: int = HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near (words one error apart, where there are any), best and best_n (the most frequent of them). words: word, n, each word once."""
    rows, done = _halves(words), None
    total = 6 * words.count()
    while True:
        large = written(rows.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("key"), "hot")
        few = large.count()  # rows / hot at most
        if not few:
            break
        whole = F.col("length") - F.col("head") - F.col("tail") < 2
        kept = rows.join(large, "key", "left_anti").unionByName(rows.where(whole).join(large, "key", "left_semi"))
        done = kept if done is None else done.unionByName(kept)
        rows = written(_split(rows.where(~whole).join(large, "key", "left_semi")), "split")
        total += rows.count()
    rows = rows if done is None else done.unionByName(rows)
    bound_batches(words.sparkSession)
    names = ("word", "n", "length", "head", "tail", "skip")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in names))]  # a task's keys: TASK_ROWS and a key at most, about
        got = list(_matched(held)) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "near", "best", "best_n"])
        release()

    dealt = rows.repartition(max(1, -(-total // task_rows)), "key").select(*names)
    found = dealt.mapInArrow(run, "word string, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("top")).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def variants(words: DataFrame, ratio: int = RATIO, hot: int = HOT, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its most frequent near word if that is frequent enough, its root the end of its forms."""
    words = written(words, "words")
    whole = written(words.join(near_words(words, hot, task_rows), "word", "left"), "near")
    formed = F.col("best_n") >= ratio * F.col("n")
    steps = whole.where(formed).select("word", F.col("best").alias("to"))
    while True:  # each round doubles the steps that a row has gone
        steps = written(steps, "steps")
        beyond = steps.select(F.col("word").alias("mid"), F.col("to").alias("end"))
        further = steps.join(beyond, F.col("to") == F.col("mid"), "left").select("word", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("on"))
        further = written(further, "further")
        steps = further.select("word", "to")
        if not further.where("on").limit(1).count():
            break
    return whole.join(steps, "word", "left").select(
        "word", F.when(formed, F.col("best")).alias("form"), F.coalesce("to", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
