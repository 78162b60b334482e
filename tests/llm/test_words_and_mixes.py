"""Spelling variants, source mixes and importance resampling against plain versions: odd inputs, ties, repeats, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import importance, mixing, spelling

SMALL = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ROWS = "doc_id long, text string, source string, word string, n long, rank string, key string, no int, section string, at string, size string, target string"


def table(spark, rows):
    """doc_id, text, source, and columns with the names that the operators use."""
    return spark.createDataFrame([(*r, "w", 1, "r", "k", 2, "s", "a", "z", "t") for r in rows], ROWS)


# --- spelling --------------------------------------------------------------------------------------------------------------------


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= 3}
    near = {w: [v for v in words if one_error(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        top = min(((-words[v], v) for v in near[w]), default=None)
        form[w] = top[1] if top and -top[0] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def misspelt(seed, words=60, texts=300):
    rng = random.Random(seed)
    letters = "abcé÷ÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(words)] + ["prefix" + "".join(rng.choice("ab") for _ in range(6)) for _ in range(words)]
    out = []
    for i in range(texts):
        some = []
        for _ in range(40):
            w = base[min(int(rng.expovariate(0.05)), len(base) - 1)]
            if rng.random() < 0.4:
                k, kind = rng.randrange(len(w)), rng.random()
                w = w[:k] + ("" if kind < 0.3 else rng.choice(letters) + (w[k] if kind < 0.6 else "")) + w[k + 1 :]
            some.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", "1", ", ", "Ω"]).join(some), "s"))
    return out


@pytest.mark.parametrize("hot", [20_000, 12])
def test_variants_equal_brute_force(spark, hot):
    rows = misspelt(1) + [(None, "Naïve naïve NAÏVE naïves naïves naïves", None), (3, None, "s"), (3, "", "s"), (4, "x" * 5000 + " " + "y" * 9, "s"), (4, "x" * 5000 + " " + "y" * 9, "s"), (5, "x" * 5000 + " " + "y" * 9, "s")]
    got = spelling.variants(spelling.vocabulary(table(spark, rows)), hot=hot, task_rows=700)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(w[1] for w in want) and max(w[4] for w in want) > 3


def test_words_whose_halves_are_alike_are_split(spark):
    """A third of the words and more under one key: every split finds the same words."""
    words = sorted({"commonhead" + "".join(x) for x in ("abcdefgh"[i % 8] + "ab"[j % 2] + "xyz"[k % 3] + "pqrs"[m] for i in range(8) for j in range(2) for k in range(3) for m in range(4))})
    df = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word string, n long")
    want = {w: sum(one_error(w, v) for v in words) for w in words}
    for hot in (10_000, 50, 8, 1):
        assert {r.word: r.n_near for r in spelling.near_words(df, hot=hot, task_rows=64).collect()} == want


def test_long_chains_of_forms_end_at_their_root(spark):
    words = [("a" * 20 + "b" * i, 2 ** (40 - i)) for i in range(30)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 20}


def test_numbers_of_an_automaton():
    words = sorted({"".join(random.Random(i).choices("abc", k=i % 6)) for i in range(400)})
    found = spelling.Automaton(words)
    assert [found.follow(w)[1] for w in words] == list(range(len(words))) and all(found.final[found.follow(w)[0]] for w in words)
    assert len(found.edges) == len({tuple(sorted(v[len(w[:i]) :] for v in words if v.startswith(w[:i]))) for w in words for i in range(len(w) + 1)})  # a state for each set of endings
    assert found.follow("abcabcabcabc") is None
    assert spelling.Automaton([]).near("abcde", 0) == set()


def test_texts_without_words(spark):
    assert spelling.variants(spelling.vocabulary(table(spark, []))).count() == 0
    assert spelling.variants(spelling.vocabulary(table(spark, [(1, None, None), (2, "", "s"), (3, "a b Ж", "s")]))).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights, repeats=3):
    total, held, open_ = sum(sizes), set(), set(range(len(sizes)))
    while True:
        share = (total - sum(repeats * sizes[i] for i in held)) / max(1, sum(weights[i] for i in open_))
        over = {i for i in open_ if weights[i] * share > repeats * sizes[i]}
        if not over:
            return [repeats * sizes[i] if i in held else weights[i] * share for i in range(len(sizes))]
        held, open_ = held | over, open_ - over


SOURCES = [("a", 30), ("b", 400), ("B", 1), ("é", 7), ("z", 0), (None, 90), ("hot", 900), ("zz", 3)]


def mixed_rows(seed=2):
    rng, rows = random.Random(seed), []
    for source, n in SOURCES:
        for _ in range(n):
            words = ["w%d" % rng.randrange(9) for _ in range(rng.choice([0, 1, 2, 30, 31, 32, 200]))]
            rows.append((len(rows), rng.choice([" ", "\n", "\t \v", "\r\n"]).join(words) + rng.choice(["", " "]), source))
    return rows + [(len(rows), "   x \x1c", "a"), (len(rows) + 1, None, "a"), (None, "no id", "a"), (None, "no id", "a"), (7, "some words of one id", "a"), (7, "some words of one id", "a"), (len(rows) + 9, None, "empty")]


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]


@pytest.mark.parametrize("block", [1, 16, 1024])
def test_mix(spark, block):
    rows = mixed_rows()
    df = table(spark, rows)
    mix = mixing.Mix(df, block=block)
    got = mix.taken().collect()
    size = Counter()
    for (_, _, s), n in zip(rows, sizes_of(rows)):
        size[s] += n
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = dict(zip(names, plain_targets([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert any(abs(want[s] - 3 * size[s]) < 1e-9 and size[s] for s in names) and size["empty"] == 0
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, n) for (i, _, _), n in zip(rows, sizes_of(rows)))
    source = {r.source_size: r.target for r in got}
    assert {size[s]: pytest.approx(want[s]) for s in names} == source
    taken, by = Counter(), {(i, n): s for (i, _, s), n in zip(rows, sizes_of(rows))}
    for r in got:
        taken[by[r.doc_id, r.size]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in names)
    assert sorted(map(tuple, mixing.Mix(df.repartition(7), block=block).taken().collect()), key=str) == sorted(map(tuple, got), key=str)
    # the spans: no gap in a block, and each text's words
    spans = mix.spans.orderBy("position", "tail", "no", "offset").collect()
    at = {}
    for r in spans:
        place = (r.position, r.tail, r.no)
        assert at.get(place, 0) == r.offset and r.words > 0
        at[place] = r.offset + r.words
    whole = {p: n for p, n in at.items() if not p[1]}
    assert set(whole.values()) <= {block} and sorted(p[0] for p in whole) == list(range(len(whole)))
    words = {(i, hashlib.md5((t or "").encode()).hexdigest()): re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    texts = Counter((r.position, r.tail, r.offset, r.text) for r in mix.texts(df).collect())
    assert texts == Counter((r.position, r.tail, r.offset, " ".join(words[r.doc_id, r.raw][r.start : r.start + r.words])) for r in spans)
    # any stretch of the mix holds the sources nearly in their shares
    order = [no for (_, _, no), _ in sorted((p, n) for p, n in whole.items())]
    if len(order) > 500:
        for a, b in ((0, 100), (100, 350), (200, 450)):
            for no, n in Counter(order).items():
                assert abs(order[a:b].count(no) - n * (b - a) / len(order)) <= 4


def test_mix_equals_its_sql(spark):
    rows = [r for r in mixed_rows(3) if r[0] is not None]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(map(tuple, mixing.Mix(table(spark, rows)).taken().collect())) == sorted(connection.execute(mixing.OP12_SQL).fetchall())


def test_given_weights_and_sections(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SECTION", 8)
    rows = mixed_rows(4)
    weights = spark.createDataFrame([("hot", 3.5), ("b", 1.0), (None, 0.5), ("none", 9.0)], "source string, weight double")
    mix = mixing.Mix(table(spark, rows), weights=weights, block=8)
    got = {r.source: (r.target, r.source_size) for r in mix.sources.collect()}
    total = sum(sizes_of(rows))
    named = ["hot", "b", None]
    want = dict(zip(named, plain_targets([got[s][1] for s in named], [3.5, 1, 0.5])))
    extra = total - sum(got[s][1] for s in named)  # the words of sources without a weight are shared as well
    assert got["a"][0] == got["z" * 2][0] == 0 and sum(t for t, _ in got.values()) == pytest.approx(min(total, 3 * sum(got[s][1] for s in named))) and extra > 0 and len(want) == 3
    plain = mixing.Mix(table(spark, rows), block=8)
    monkeypatch.setattr(mixing, "SECTION", 1 << 14)
    assert sorted(map(tuple, plain.taken().collect()), key=str) == sorted(map(tuple, mixing.Mix(table(spark, rows), block=8).taken().collect()), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, " ", "b")]])
def test_mix_of_nothing(spark, rows):
    mix = mixing.Mix(table(spark, rows))
    assert sorted(map(tuple, mix.taken().collect())) == sorted((i, 0, 0, 0.0, 0) for i, _, _ in rows)
    assert mix.spans.count() == 0


def test_lattices_are_permutations():
    for n in [*range(2, 200), 1 << 12, 9973]:
        g, inverse = mixing.lattice(n)
        assert g * inverse % n == 1 and abs(g - n / mixing.PHI) <= max(3, n * 0.05)


# --- importance ------------------------------------------------------------------------------------------------------------------


def runs_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(SMALL))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target, share=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t, known = np.zeros(10000), np.zeros(10000), [(i, *runs_of(x)) for i, x, _ in rows]
    for _, _, features in known:
        for f in features:
            s[bucket(f)] += 1
    for x in target:
        for f in runs_of(x)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((a + 1) * (s.sum() + 10000) / ((b + 1) * (t.sum() + 10000)))) for a, b in zip(t.tolist(), s.tolist())]
    out, long = [], []
    for i, n, features in known:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(features), weight, score, None])
        if n >= least:
            long.append(out[-1])
    long.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(long[: share * len(long) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "a b", "ÀB", "x9", "it's"]
    rows = [(i, rng.choice([" ", ", ", "\n", "_"]).join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 19, 20, 40, 90]))), "s") for i in range(600)]
    rows += [(None, "w1 w2 " * 15, None), (7000, None, "s"), (7001, "", "s"), (7002, "word " * 3000, "s"), (5, rows[5][1], "s"), (5, rows[5][1], "s"), (6, "w3 w4 w5 " * 30, "s")]
    target = ["w1 w2 w3 w4", "日本 w2 w1", None, ""]
    benchmark = spark.createDataFrame([(t, 1) for t in target], "text string, n int")
    want = plain_resample(rows, target, share=20)
    for block, window in ((1 << 18, 4 << 20), (64, 37), (1, 1)):
        monkeypatch.setattr(importance, "BLOCK_WORDS", block)
        monkeypatch.setattr(importance.blocks, "__defaults__", (block,))
        monkeypatch.setattr(importance.parts, "__defaults__", (window,))
        for part in rows[::50]:
            got = list(importance.parts(0, part[1] or ""))
            assert sum(p.starts for p in got) == runs_of(part[1])[0]
        texts = [x for _, x, _ in rows if x]
        import pyarrow as pa

        totals = sum((importance.Trie(b).totals(10000) for b in importance.blocks(pa.array(texts))), np.zeros(10000, np.int64))
        assert totals.sum() == sum(len(runs_of(x)[1]) for x in texts)
    monkeypatch.undo()
    got = importance.resample(table(spark, rows), benchmark, share=20)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_windows_and_blocks_change_no_weight():
    import pyarrow as pa

    rng = random.Random(8)
    texts = [" ".join(rng.choices(["ab", "c", "ddd", "é"], k=n)) for n in (0, 1, 2, 3, 5, 60, 200)]
    gains = np.arange(10000, dtype=np.int64) - 5000
    plain = [sum(int(gains[zlib.crc32(f.encode()) % 10000]) for f in runs_of(x)[1]) for x in texts]
    for size, window in ((1 << 18, 1 << 20), (10, 7), (1, 1), (3, 40)):
        out = np.zeros(len(texts), np.int64)
        held, n = [], 0
        for i, x in enumerate(texts):
            for p in importance.parts(i, x, window):
                held.append(p)
                n += len(p.words)
                if n >= size:
                    out += importance.Trie(held).weights(gains, len(texts))
                    held, n = [], 0
        if held:
            out += importance.Trie(held).weights(gains, len(texts))
        assert out.tolist() == plain


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b c", "x"), (2, "", "y")]])
def test_resampling_of_little(spark, rows):
    for target in ([], ["a b"]):
        got = importance.resample(table(spark, rows), spark.createDataFrame([(t,) for t in target], "text string")).collect()
        assert sorted(map(tuple, got), key=str) == plain_resample(rows, target)


def test_ranks_of_equal_rows(spark):
    """Rows of one id and score lie in several ranges and still get all numbers."""
    df = spark.createDataFrame([(1, 5)] * 500 + [(2, 7)] * 3, "doc_id long, score long").repartition(5)
    from echotrace.llm.common import numbered

    got = numbered(df, [F.desc("score"), F.asc_nulls_last("doc_id")], "rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 504)) and {r["rank"] for r in got if r.score == 7} == {1, 2, 3}
