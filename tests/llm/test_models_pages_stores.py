"""Classifiers on held-out rows, page layouts, neighbours against brute force, the shard store, the pipeline."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import page_templates, prefix_forest, quality, shards, toxicity
from echotrace.llm.labelled import Sample, sample

rng = np.random.default_rng(8)
WORDS = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(800)]


def good(n=80):
    return " ".join(rng.choice(WORDS, n)) + "."


def bad(n=80):
    kind = rng.integers(0, 3)
    words = rng.choice(WORDS, n)
    return " | ".join(words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join([words[0]] * n)


def test_quality_on_unseen_rows():
    y = rng.random(900) < 0.8
    texts = [good() if v else bad() for v in y]
    model = quality.fit(Sample(texts[:600], y[:600].astype(float), np.ones(600), 0.8))
    p = quality.scores(texts[600:], model)
    assert ((p >= 0.3) == y[600:]).mean() > 0.97
    assert len(quality.scores(["", "x", "y" * 500_000], model)) == 3 and quality.scores(["a b"], model)[0] == quality.scores(["z", "a b"], model)[1]
    assert quality.scores(["a"], quality.fit(Sample([], np.zeros(0), np.zeros(0), 0.5)))[0] == 0.5


def test_quality_is_learnt_from_all_of_a_long_text():
    mark = " ".join(WORDS[:150]).upper()
    texts = [f"{' '.join(str(x) for x in rng.integers(0, 1 << 30, 3000))} {" ".join([mark] * 6)}" for _ in range(40)]
    assert all(len(t) > quality.WINDOW * quality.TRAINED_OF_TEXT + 6 * len(mark) for t in texts)
    held = quality._dictionary([t.encode() for t in texts])
    assert sum(w.encode() in held for w in mark.split()) > 100
    assert quality._spread([b"%d" % i for i in range(100)], 12)[::11] == [b"0", b"99"]


def test_toxicity_on_unseen_rows():
    rude = ["scumble", "idiota", "scumling", "trashy"]
    y = rng.random(1200) < 0.25
    texts = [" ".join(rng.permutation([*rng.choice(WORDS, 60), *(rng.choice(rude, 2) if v else [])])) for v in y]
    model = toxicity.fit(Sample(texts[:900], y[:900].astype(float), np.ones(900), 0.25))
    p = toxicity.scores(texts[900:], model)
    assert ((p >= 0.3) == y[900:]).mean() > 0.97
    assert toxicity.scores(["", "?!"], model).max() < 0.3
    assert toxicity.scores(["a"], toxicity.fit(Sample([], np.zeros(0), np.zeros(0), 0.5)))[0] == 0


def test_responses_stay_inside_texts():
    words = rng.normal(size=(9, toxicity.DIM)).astype(np.float32)
    filters = [rng.normal(size=(k, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for k in toxicity.WIDTHS]
    flat, starts = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8]), np.array([0, 1, 3, 7])
    bias = np.zeros(toxicity.FILTERS * 3, np.float32)
    whole = toxicity._responses(flat, starts, words, filters, bias)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], 9])):
        alone = toxicity._responses(flat[a:b], np.array([0]), words, filters, bias)
        assert np.allclose(whole[i], alone[0], atol=1e-5)


def test_sample_is_bounded_and_takes_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(200)] + [(None, "n", "x"), (5, None, "x")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (None, 1), (4, None), (9, 7)], "doc_id long, quality int")
    found = sample(docs, labels, "quality", class_rows=30, chars=300)
    assert 0 < len(found.texts) <= 60 and sum(map(len, found.texts)) <= 300 and set(found.labels) <= {0.0, 1.0}
    assert len(sample(docs, labels.limit(0), "quality").texts) == 0 and len(sample(docs.limit(0), labels, "quality").texts) == 0


def test_filters_keep_columns(spark):
    docs = spark.createDataFrame([(1, good(), "en", "s"), (2, bad(), "en", "s"), (3, None, None, None)], "doc_id long, text string, lang string, __n string")
    y = np.array([1.0, 0.0] * 150)
    model = quality.fit(Sample([good() if v else bad() for v in y], y, np.ones(300), 0.5))
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and {1} <= {r.doc_id for r in kept.collect()} and 2 not in {r.doc_id for r in kept.collect()}


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies</div>{}<aside>More</aside><section id='comments'><article><p>First!</p></article></section><form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"


LAYOUTS = [
    ("<article><h1>A &amp; B</h1><p>One<br>two  <b>three</b>.<p>Four<script>x('</p>')</script></article>", "A & B\nOne two three.\nFour"),
    ("<main><div class='post'><p>One&nbsp;x</p><div class='ad'>Buy</div><ul><li>a<li>b</ul></div></main>", "One x\na\nb"),
    ("<article><p>Text<!-- no --> on</p><div class='comments'><p>reader</p></div><footer>tags</footer></article>", "Text on"),
    ("<article></article>", ""),
    ("<article><p>&lt;b&gt; stays &#65;</p></article>", "<b> stays A"),
    ("<article><p>One</p><div class='response'><p>kept as it stands once</p></div></article>", "One\nkept as it stands once"),
]


def test_layouts(spark):
    rows = []
    for i, (body, _) in enumerate(LAYOUTS):
        name = "main" if "<main" in body else "article"
        rows.append((i, f"http://h{i}.example/x", PAGE.format(body)))
        rows += [(100 * (i + 1) + k, f"http://h{i}.example/{k}", PAGE.format(f"<{name}><h1>{good(4)}</h1><p>{good(40)}</p></{name}>")) for k in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"site": F.lit("x"), "host": F.lit(1), "text": F.lit("y"), "rows": F.lit(2)})
    got = {r.page_id: r.text for r in page_templates.main_text(pages).collect()}
    assert [got[i] for i in range(len(LAYOUTS))] == [text for _, text in LAYOUTS]
    assert all(page_templates.extract(h) != got[i] for i, _, h in rows)  # it is the template that tells them


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<article><p>cut he", "<article><p>cut</p><p", "<<<>>>", "<article><p>x &am", "</p></article>x", "<script>", "<p class='a", "plain text"])
def test_broken_pages(page):
    some = page_templates.Template(5, frozenset([1]), frozenset(), frozenset())
    assert "<p" not in page_templates.extract(page) and "<p" not in page_templates.extract(page, some)
    page_templates.tokens(page)


def plain_deduction(bodies):
    """Classes by whole vectors, order and nesting checked token by token, the region by sums over all pages: without hashes of vectors or sums."""
    P = page_templates
    streams = []
    for body in bodies:
        one = []
        for kind, stack, what in P.walk(body):
            if kind == "open":
                one.append((P._hash("e", stack[-1].path), None))
            elif kind == "text" and P._spaced(what):
                one.append((P._hash("t", stack[-1].path if stack else "", P._spaced(what)), (P._spaced(what), stack)))
        streams.append(one)
    names = {t for one in streams for t, _ in one}
    vectors = {t: tuple(sum(x == t for x, _ in one) for one in streams) for t in names}
    frequent = [t for t in names if sum(v > 0 for v in vectors[t]) >= max(P.PAGES, P.SHARE * len(bodies))]
    classes = {}
    for t in frequent:
        classes.setdefault(vectors[t], set()).add(t)
    once = {v for v in classes if max(v) == 1}
    valid = {}
    for v, c in classes.items():
        if v in once or len(c) > 1:
            orders = [[t for t, _ in one if t in c] for one in streams]
            first = next(o for o in orders if o)[: len(c)]
            good = [o == first * (len(o) // len(c)) for o in orders if o]
            if all(good):
                valid[v] = c
    frame = {t for v, c in valid.items() if v in once for t in c}
    texts = {t for one in streams for t, x in one if x and t in frame}
    inside = {}
    for one in streams:
        for t, x in one:
            if x and t not in texts and not any(n.junk in ("element", "named") or n.name == "a" for n in x[1]):
                for n in x[1]:
                    if P._hash("e", n.path) in frame and n.name in P.BLOCKS:
                        inside[n.path] = inside.get(n.path, 0) + len(x[0])
    holding = [p for p in inside if 2 * inside[p] >= max(inside.values())]
    return texts, max(holding, key=lambda p: p.count("/"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_equal_a_plain_deduction(spark, seed):
    r = np.random.default_rng(seed)
    few = WORDS[:60]
    says = lambda n: " ".join(r.choice(WORDS, n))
    menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in few[:5])
    bodies = []
    for k in range(9):
        story = "".join(f"<p>{says(30)}</p>" for _ in range(1 + int(r.integers(1, 5)))) + ("<div class='quote'><b>x</b></div>" if k % 2 else "")
        side = f"<div class='box'><p>{says(6)}</p></div>" * (k % 3)
        bodies.append(f"<html><body><div class='top'><ul>{menu}</ul></div><div class='wrap'><div class='story'>{story}</div><div class='tail'><p>Kept by us.</p><p>{says(3)}</p></div></div>{side}</body></html>")
    texts, region = plain_deduction(bodies)
    pages = spark.createDataFrame([("h", b) for b in bodies], "site string, html string")
    found = page_templates.templates(pages).collect()
    got_region, got_texts, *_ = json.loads(found[0].template)
    assert len(found) == 1 and got_region == page_templates._hash("e", region) and region.endswith("/div.story")
    assert set(got_texts) == texts
    known = page_templates.Template(got_region, frozenset(got_texts), frozenset(), frozenset())
    for b in bodies:
        want = [x.split("</p>")[0] for x in b.split("<div class='story'>")[1].split("<div class='tail'>")[0].split("<p>")[1:]] + (["x"] if "quote" in b else [])
        assert page_templates.extract(b, known) == "\n".join(want)


def test_templates_without_an_article(spark):
    rows = [(i, f"http://h.example/{i}", f"<html><body><div><p>Read this first.</p></div><div><p>{good(20)}</p><p>{good(20)}</p></div><div><p>All rights kept.</p></div></body></html>") for i in range(12)]
    rows += [(100, None, None), (101, "odd", "<p>alone</p>"), (102, "odd", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_templates.main_text(pages).collect()}
    for i, _, body in rows[:12]:
        parts = [x.split("</p>")[0] for x in body.split("<p>")[1:]]
        assert got[i] == "\n".join(parts[1:3])
    assert got[100] == "" and got[101] == "alone" and got[102] == "alone"
    assert page_templates.main_text(pages).count() == 15 and page_templates.main_text(pages.limit(0)).count() == 0


def vectors(n, d=64, seed=9):
    return np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)


def exact(ids, x, k):
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (norm * norm[q])
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


@pytest.mark.parametrize(("n", "shard"), [(700, 4096), (1500, 400)])
def test_recall(spark, monkeypatch, n, shard):
    monkeypatch.setattr(prefix_forest, "SHARD_ROWS", shard)
    ids, x = np.arange(n), vectors(n)
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    found = prefix_forest.search(rows, F.col("vec_id") % 50 == 0).collect()
    want, hits = exact(ids, x, 5), 0
    for q, best in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in mine} & set(best))
    assert hits >= 0.9 * 5 * len(want)


def test_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0]), (50, [0.0, 1.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in prefix_forest.search(frame, F.col("vec_id") % 50 == 0).collect()}
    assert found == {(0, 1): (1, 1.0), (0, 2): (2, 1.0), (0, 3): (50, 0.0), (50, 1): (0, 0.0), (50, 2): (1, 0.0), (50, 3): (2, 0.0)}
    far = [(0, [2.0**700, 2.0**700]), (1, [2.0**-700, 2.0**-700]), (2, [2.0**1020, 0.0]), (3, [5e-324, 0.0]), (50, [0.0, 2.0**-1030]), (100, [1.0]), (101, [-2.0]), (102, [3e300])]
    extremes = spark.createDataFrame(far, "vec_id long, embedding array<double>").withColumns({"d": F.lit(9), "shard": F.lit(1), "v": F.lit(1), "asks": F.lit(0)})
    found = {(r.query_id, r.rank): (r.vec_id, round(r.score, 6)) for r in prefix_forest.search(extremes, F.col("vec_id") % 50 == 0).collect()}
    half = round(0.5**0.5, 6)
    assert found == {(0, 1): (1, 1.0), (0, 2): (2, half), (0, 3): (3, half), (0, 4): (50, half), (50, 1): (0, half), (50, 2): (1, half), (50, 3): (2, 0.0), (50, 4): (3, 0.0), (100, 1): (102, 1.0), (100, 2): (101, -1.0)}
    assert prefix_forest.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert prefix_forest.search(frame, F.lit(False)).count() == 0


def test_many_copies_are_found_together(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i < 900 else [float(i), 1.0, -float(i)]) for i in range(1000)]
    found = prefix_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 500).collect()
    assert sorted((r.rank, r.vec_id) for r in found) == [(i + 1, i) for i in range(5)]


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=40_000, fan=3)
    assert store.read() is None and store.manifest()["version"] == 0
    rows = spark.createDataFrame([(i, good(60), None if i % 3 else "x", 1) for i in range(300)], "doc_id long, text string, lang string, shard_no int")
    for k in range(6):
        store.append(rows.where(F.col("doc_id") % 6 == k).coalesce(2))
    store.append(rows.limit(0))
    last = store.manifest()
    got = store.read()
    assert sorted(r.doc_id for r in got.collect()) == list(range(300)) and got.where("lang is null").count() == 200
    assert sum(x["rows"] for x in last["shards"]) == 300 and all(x["bytes"] <= 1.2 * 40_000 for x in last["shards"] if x["bytes"] > 20_000) and not store.plan(last["shards"])
    with pytest.raises(FileExistsError):
        store.commit(last["version"] - 1, [])
    assert store.manifest()["version"] == last["version"] and store.read(last["version"]).count() == 300
    kept = json.loads((tmp_path / "s/manifest" / f"v{last['version']:08d}.json").read_text())
    assert kept["version"] == last["version"] and [x for p in kept["parts"] for x in json.loads((tmp_path / "s/manifest" / p).read_text())["shards"]] == last["shards"]
    assert {x["file"].rsplit("/", 1)[-1] for x in last["shards"]} <= {f.name for f in (tmp_path / "s/data").rglob("*.parquet")}


def test_columns_of_any_name_and_two_writers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "PART_SHARDS", 2)
    store, other = (shards.ShardStore(spark, f"file://{tmp_path}/n", target=1 << 20, fan=3) for _ in range(2))
    rows = spark.createDataFrame([(i, "n", 7, i % 2, None, "f") for i in range(60)], "doc_id long, name string, shard int, position int, arrival int, file_name string")
    merge, met = shards._merge, []

    def late(*args):  # another writer commits while this one merges
        out = merge(*args)
        if not met:
            met.append(other._add(other._listed(extra)))
        return out

    extra = f"file://{tmp_path}/n/data/extra"
    rows.where("doc_id >= 50").coalesce(1).write.parquet(extra)
    monkeypatch.setattr(shards, "_merge", late)
    for k in range(4):
        store.append(rows.where((F.col("doc_id") < 40) & (F.col("doc_id") % 4 == k)).coalesce(1))
    store.append(rows.where((F.col("doc_id") >= 40) & (F.col("doc_id") < 50)), by=F.col("doc_id") % 2)
    with pytest.raises(ValueError):
        store.read()
    got = store.read(shard="s", position="p")
    assert met and got.drop("s", "p").schema == rows.schema and sorted(map(tuple, got.drop("s", "p").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert got.select("s", "p").distinct().count() == 60 and len(store._parts(store.manifest()["version"])) >= 1
    stale = other.manifest()["version"] - 1
    with pytest.raises(FileExistsError):
        other.commit(stale, [])


def test_arrivals_of_one_write_are_read_once(spark, tmp_path):
    """Files of a write by value bear one base name for several values; few arrivals stay unmerged."""
    store = shards.ShardStore(spark, f"file://{tmp_path}/by", fan=8)
    rows = spark.createDataFrame([(i, f"a b%{i % 2}/é") for i in range(68)], "doc_id long, v string").coalesce(1)
    store.append(rows, by=F.col("doc_id") % 2)
    store.append(rows.withColumn("doc_id", F.col("doc_id") + 100), by=F.when(F.col("doc_id") > 3, F.col("v")).otherwise("%25"))
    listed = store.manifest()["shards"]
    assert len({x["file"].rsplit("/", 1)[-1] for x in listed}) < len(listed)
    got = store.read().collect()
    assert len(got) == 136 == sum(x["rows"] for x in listed) and sorted(r.doc_id for r in got) == [*range(68), *range(100, 168)]
    assert len({(r.shard, r.position) for r in got}) == 136 and {r.shard for r in got} == set(range(len(listed)))


def test_sizes_make_tiers(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/t", target=1 << 30, fan=4)
    some = [{"file": str(i), "rows": 1, "bytes": 2 << 20, "arrived": i} for i in range(4)] + [{"file": "big", "rows": 1, "bytes": 600 << 20, "arrived": 0}, {"file": "mid", "rows": 1, "bytes": 90 << 20, "arrived": 0}]
    assert [[x["file"] for x in run] for run in store.plan(some)] == [["0", "1", "2", "3"]]


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "toxicity", "SimHash near-dedup", "best-fit packing"]
    for name, stage in C.STAGES[:3]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    packed = C.STAGES[3][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_words_are_counted_in_blocks():
    rng, texts, each = np.random.default_rng(3), 2048, 500
    flat, starts = rng.integers(0, 3000, texts * each).astype(np.int32), np.arange(texts) * each
    buckets, y = rng.integers(1, toxicity.BUCKETS, (3000, 2)).astype(np.int32), (np.arange(texts) % 3 == 0).astype(float)
    tracemalloc.start()
    got = toxicity._log_odds(buckets, flat, starts, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # a number for each word of all texts takes 8 MB, and there were several
    seen = np.zeros((2, toxicity.BUCKETS))
    for i, a in enumerate(starts):
        for column in buckets.T:
            seen[int(y[i]), np.unique(column[flat[a : a + each]])] += 1
    every = seen.sum(0)
    share = [(seen[c] + (every + 1) / every.sum()) / ((y == c).sum() + 2) for c in (0, 1)]
    assert np.allclose(got, every / (every + 6) * np.clip(np.log((share[1] + 3e-3) / (share[0] + 3e-3)), -4, 4))
