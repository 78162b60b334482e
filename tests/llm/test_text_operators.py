"""Operators on texts against plain versions: odd inputs, ties, repeats, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echotrace.llm import byte_bpe, exact_digest, packing, simhash, token_frames
from echotrace.llm.components import components
from echotrace.llm.tokens import encoder

ODD = ["=" * 700, "x" + "qz" * 300, "", " ", "a", "a  b", " lead", "trail ", "trail\n", "it's I'LL we'll 1234567 ünïcödé 日本語", "<|endoftext|> a", "x y 　z", "ab" * 400, "\n \n\n  x   y", "Tag! 'quoted' (x), y's z?"]
DOCS = "doc_id long, text string, lang string, fp string, rep string, at int"


def docs(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "f", "r", 1) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def random_texts(n, seed=0):
    rng = np.random.default_rng(seed)
    letters = list("ab 'st\n.,1é日 \x1c\x85Ġ!")
    return ["".join(rng.choice(letters, rng.integers(0, 70))) for _ in range(n)]


def test_encoders_equal_the_libraries(library):
    texts = ODD + random_texts(400)
    got = encoder().encode_each(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library(x) for x in texts]
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    ids = codec.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [plain.encode_ordinary(x) for x in texts]
    assert codec.decode(ids) == [x.encode() for x in texts]


def test_the_queries_and_the_heap_contract_alike():
    codec = byte_bpe.Codec(P.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghilmnorstu"), rng.integers(2, 60))) for _ in range(300)]
    words += ["".join(rng.choice(list("abcdefghilmnorstu"), n)) for n in (129, 200, 700)] + ["=" * 333, "é" * 150, "ab" * 90]
    assert sum(len(w) > byte_bpe.SHORT_WORD for w in words) >= 5
    codec._learn_words(words)
    assert [np.frombuffer(codec.words[w], "<u4").tolist() for w in words] == [[codec.ranks[w.encode()]] if w.encode() in codec.ranks else byte_bpe.contract(w.encode(), codec.ranks) for w in words]


def test_coding_of_documents(spark):
    rows = docs(spark, [*ODD, None, "a"], [*range(len(ODD)), None, 0])
    back = byte_bpe.decode(byte_bpe.encode(rows)).collect()
    assert sorted(bytes(r["bytes"]).decode() for r in back) == sorted([*ODD, "", "a"])
    assert byte_bpe.encode(rows.limit(0)).count() == 0


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    import xxhash

    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def test_masks_cover_every_pair():
    kept = simhash.masks()
    assert len(kept) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in kept)


@pytest.mark.parametrize("small", [2, 128])
def test_near_duplicates_equal_brute_force(spark, small):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(vocabulary, 120)) for _ in range(12)]
    texts = base + base[:4] + [b.replace("w7 ", "W7\t", 1) for b in base] + [b + " end" for b in base[:6]] + ["", " \n", None, "one two"]
    fps = np.array([plain_fingerprint(t or "", 3) for t in texts], np.uint64)
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, np.arange(len(texts))
    for _ in texts:
        label = np.where(near, label[None, :], len(texts)).min(1)
    kept, simhash.links.__defaults__ = simhash.links.__defaults__, (2, small)
    try:
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    finally:
        simhash.links.__defaults__ = kept
    assert got == {i: (f"{int(f):016x}", int(c)) for i, (f, c) in enumerate(zip(fps, label))}


def test_large_buckets_are_linked_without_pairs(spark):
    rng = np.random.default_rng(5)
    base = 0x123456789ABCDEF
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 20, (400, 2))})
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    few, many = (components(simhash.links(reps, small=s)).select("node", "root").collect() for s in (4, 1000))
    assert sorted(few) == sorted(many) and {r.root for r in few} == {0}


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    roots = {r.node: r.root for r in components(e).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = docs(spark, [text, text.upper(), "other words here for sure", "other words here for sure", "no id"], [1, 2, 3, 3, None])
    assert sorted((r.doc_id or -1, r.lang) for r in simhash.keep_one(rows).collect()) == [(-1, "en"), (1, "en"), (3, "en")]
    assert simhash.keep_one(rows).columns == rows.columns


def test_clashing_names_and_rows_without_ids(spark):
    names = "doc_id long, text string, __n int, __kept string, kept_id int, KEPT_N string, raw string, root int"
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(i, t, 1, "k", 2, "n", "r", 3) for i, t in [(1, text), (2, text), (2, text), (None, "lone"), (None, "LONE"), (None, None), (9, "")]], names)
    got = simhash.keep_one(rows)
    assert got.columns == rows.columns and got.schema == rows.schema
    assert sorted((r.doc_id or 0, (r.text or "").lower(), r.KEPT_N, r.root) for r in got.collect()) == [(0, "lone", "n", 3), (1, text, "n", 3), (9, "", "n", 3)]
    assert simhash.keep_one(rows.limit(0)).columns == rows.columns and simhash.keep_one(rows.limit(0)).count() == 0
    found = sorted((r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(rows).collect())
    assert len(found) == 7 and [c for f, c in found if f == "0" * 16] == ["9", "9"] and sum(c == "1" for _, c in found) == 3 and sum(c == "None" for _, c in found) == 2


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    rows = docs(spark, [a, b, a.upper(), c, c, c, d, a, a], [1, 1, 2, None, None, 5, None, 1, None])
    assert sorted((r.doc_id or -1, r.text.lower()) for r in simhash.keep_one(rows).collect()) == [(-1, d), (1, a), (1, b), (5, c)]


def test_digests_equal_brute_force(spark):
    texts = ["ﬁne  Text\n", "fine text", "FINE TEXT", "", None, "x", "longer text of words " * 30, "日本"]
    rows = {r.doc_id: r for r in exact_digest.digests(docs(spark, texts)).collect()}
    order = list(range(len(texts)))[::-1]
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == exact_digest.digest(exact_digest.canonical(text)) and r.edited_fingerprint == exact_digest.digest(exact_digest.canonical(new))
        assert r.near_next == float(exact_digest.canonical(text) == exact_digest.canonical(following)) and r.near_edited == float(r.fingerprint == r.edited_fingerprint)
    assert rows[0].group_id == rows[1].group_id == rows[2].group_id == 0 and rows[0].group_size == 3 and rows[3].group_id == rows[4].group_id == 3
    assert exact_digest.digests(docs(spark, ["alone"])).count() == 1
    assert exact_digest.digests(docs(spark, texts).limit(0)).count() == 0


def test_colliding_digests_are_parted(spark):
    texts, ids = ["a", "b", "a", "c", "A", None, "b", "b"], [1, 2, 3, 4, 4, None, None, 2]
    rows = exact_digest.digests(docs(spark, texts, ids), name=lambda form: "00" * 16).collect()
    assert sorted((str(r.group_id), r.group_size) for r in rows) == sorted([("1", 3)] * 3 + [("2", 3)] * 3 + [("4", 1), ("None", 1)])


@pytest.mark.parametrize("ids", [[7] * 40, [None] * 40, [*range(20), *[5] * 20]])
def test_ids_with_many_rows_keep_their_order(spark, ids):
    texts = [f"text {i} {'x' * (i % 7)}" for i in range(40)]
    rows = exact_digest.digests(docs(spark, texts, ids)).collect()
    tie = {t: exact_digest.dealt(np.zeros(0, np.int64), pa.array([1]), [t])[1][0] for t in texts}
    order = sorted(range(40), key=lambda i: (ids[i] is not None, ids[i] or 0, tie[texts[i]]), reverse=True)
    want = []
    for k, i in enumerate(order):
        a, b = texts[i], texts[order[(k + 1) % 40]]
        want.append((ids[i], len(a), hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str)
    start = 0
    got = sorted(token_frames.read(token_frames.write(docs(spark, texts, ids))).collect(), key=lambda r: r.start)
    for r, i in zip(got, sorted(range(40), key=lambda i: (ids[i] is not None, ids[i] or 0, tie[texts[i]]))):
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (ids[i], start, [*encoder().library.encode(texts[i], add_special_tokens=False).ids, 2])
        start += len(r.ids) // 4


def test_frames_read_back(spark, library):
    texts = [*ODD, None, "word " * 5000, "same", "same"]
    ids = [*range(100, 100 + len(ODD)), 5, 7, 9, None]
    rows = docs(spark, texts, ids)
    manifest = token_frames.write(rows)
    got = token_frames.read(manifest).collect()
    want, at = [], 0
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)):
        body = np.array([*library(t or ""), 2], "<u4").tobytes()
        want.append((i, at, body))
        at += len(body) // 4
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in got), key=lambda x: x[1]) == want
    file = manifest.where("n_docs > 0").first().file
    system, path = token_frames._open(file)
    with system.open_input_file(path) as f:
        reader = token_frames.FrameReader(f)
        some = reader.index["doc_id"].to_pylist()[-1]
        assert [x[0] for x in reader.documents([some])] == [some]
        reader.entries[0] = (*reader.entries[0][:2], reader.entries[0][2] ^ 1)
        with pytest.raises(ValueError):
            reader.frame(0)
    assert token_frames.read(token_frames.write(rows.limit(0))).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for some in by.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_of_documents(spark, library):
    texts = [*ODD, None, "word " * 3000, "b " * 1024]
    rows = packing.pack_documents(docs(spark, texts)).collect()
    check_packing(rows, 1024)
    for i, t in enumerate(texts):
        ids = np.array([*library(t or ""), 2], "<u4")
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids) and all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack_documents(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("low", [1, 400, 520])
def test_blocks_are_merged(spark, low):
    sizes = np.random.default_rng(6).integers(low, 700, 3000)
    found = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "doc_id long, length long").repartition(4)
    rows = packing.pack(found, 1024, block_rows=200, fan=2).collect()
    assert len(rows) == 3000
    n = check_packing(rows, 1024)
    best = len(set(packing.best_fit(sizes, 1024)[0].tolist()))
    assert n <= best * 1.02 + 1 and {r.doc_id for r in rows} == set(range(3000))


def test_similar_texts_are_linked(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 200)) for _ in range(40)]
    texts, group = [], []
    for g, b in enumerate(base):
        texts.append(" ".join(b))
        group.append(g)
        for edits in (1, 2, 3):  # an edit changes five shingles of about two hundred
            c = list(b)
            for i in rng.choice(200, edits, replace=False):
                c[i] = "changed"
            texts.append(" ".join(c).upper() if edits == 2 else " ".join(c))
            group.append(g)
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts)).collect()}
    found = sum(got[i] == 4 * g for i, g in enumerate(group))
    assert found >= 0.97 * len(texts)
    assert all(group[c] == group[i] for i, c in got.items())
    assert {r.component_id for r in simhash.similar(docs(spark, ["", None, " "])).collect()} == {0}
    assert simhash.similar(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("cell", [8, 512])
def test_members_of_a_bucket_meet_one_another(spark, cell):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(3000)]
    base, texts = list(rng.choice(words, 300)), []

    def changed(text, n):
        text = list(text)
        for i in rng.choice(300, n, replace=False):
            text[i] = f"new{rng.integers(1 << 40)}"
        return text

    for _ in range(200):  # alike to one another by about 0.7, each with a copy that is alike by about 0.9
        one = changed(base, 5)
        texts += [one, changed(one, 3)]
    texts = [" ".join(t) for t in texts]
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    parts = np.array([simhash.wide_fingerprint(t.encode().split(), 5) for t in texts])
    root, found = list(range(len(texts))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (parts[i] == parts[j]).sum() >= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                found += i == j + 1
    got = {r.doc_id: r.component_id for r in simhash.similar(docs(spark, texts), cell=cell).collect()}
    assert found >= 190 and got == {i: find(i) for i in range(len(texts))}


def test_repeated_lines_count_once(spark):
    rng = np.random.default_rng(12)
    body, line = " ".join(rng.choice([f"w{i}" for i in range(3000)], 300)), " one line of nine words that is repeated here"
    texts = [body + line * n for n in (1, 10, 20, 100)]
    assert {r.component_id for r in simhash.similar(docs(spark, texts)).collect()} == {0}


def test_counts_drop_no_similar_pair():
    rng = np.random.default_rng(13)
    for n in (1, 4, 9, 40, 300, 80_000):
        for share in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3):
            words = [b"%d" % x for x in rng.integers(0, 1 << 40, n + 4)]
            other = words[: len(words) - int(share * n)] + [b"%d" % x for x in rng.integers(0, 1 << 40, int(rng.integers(0, 2)) * int(share * n / 2))]
            (_, m, x), (_, k, y) = (simhash._sketch(w, 5) for w in (words, other))
            near = simhash._near(np.array([m]), np.frombuffer(x, np.uint8)[None], np.array([k]), np.frombuffer(y, np.uint8)[None], 0.8)
            assert near[0] or simhash.similarity(words, other, 5) < 0.8


def test_a_round_of_stars_plans_no_join_for_each_end(spark, monkeypatch):
    from echotrace.llm import components as stars

    plans, kept = [], stars.written

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")))
        return kept(df, name)

    monkeypatch.setattr(stars, "written", written)
    links = [(i, i + 1) for i in range(20, 32)] + [(7, 3), (3, 9), (9, 7), (40, 41), (5, 5)]
    got = {r.node: r.root for r in stars.components(spark.createDataFrame(links, "a long, b long")).collect() if r.node != r.root}
    assert got == {**{i: 20 for i in range(21, 33)}, 7: 3, 9: 3, 41: 40}
    rounds = [joins for name, joins in plans if name == "stars"]
    assert rounds and max(rounds) <= 3, rounds  # there were 6


def test_buckets_and_mixed_buckets_equal_plain_grouping(spark):
    """One pass over sorted rows, whatever the batches: runs that end with a batch, and one bucket of a third of the rows."""
    rng = np.random.default_rng(5)
    rows = [(int(k), i, int(r)) for i, (k, r) in enumerate(zip(np.where(rng.random(3000) < 0.33, 7, rng.integers(0, 2000, 3000)), rng.integers(0, 3, 3000)))]
    df = spark.createDataFrame(rows, "key long, rep long, root long")
    members = {}
    for k, i, r in rows:
        members.setdefault(k, []).append((i, r))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 3, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = sorted(map(tuple, simhash._buckets(df.select("key", "rep")).collect()))
            assert got == sorted((k, i, min(m)[0]) for k, m in members.items() if len(m) > 1 for i, _ in m)
            got = sorted(map(tuple, simhash._mixed(df).collect()))
            assert got == sorted((k, i, len(m)) for k, m in members.items() if len({r for _, r in m}) > 1 for i, _ in m)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert simhash._buckets(df.limit(0).select("key", "rep")).count() == simhash._mixed(df.limit(0)).count() == 0
