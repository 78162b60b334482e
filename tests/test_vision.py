"""Pixel kernels and the rules on pictures, on generated pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.vision import kernels as K, pages, specialists as S


def texture(h, w, seed=1, n=60):
    rng, yx = np.random.default_rng(seed), np.mgrid[:h, :w]
    a = np.full((h, w), 40.0)
    for _ in range(n):
        y, x, r, v = rng.integers(0, h), rng.integers(0, w), rng.integers(4, max(6, min(h, w) // 8)), rng.integers(60, 255)
        a[(yx[0] - y) ** 2 + (yx[1] - x) ** 2 < r * r] = v
    return np.clip(a, 0, 255).astype(np.uint8)


def decoded(spark, images):
    rows = [(name, 1, a.shape[1], a.shape[0], 3, bytearray(K.to_bgr(a).tobytes()), name) for name, a in images.items()]
    return spark.createDataFrame(rows, "source_path string, page int, width int, height int, channels int, data binary, file_sha256 string")


def test_kernels():
    a = texture(64, 80)
    assert K.phash(a) == K.phash(np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8)) or (K.phash(a) ^ K.phash(a)).bit_count() == 0
    assert np.allclose(K.resize(np.ones((7, 9)), 3, 4), 1) and np.allclose(K.resize(np.ones((3, 3)), 7, 8), 1)
    assert np.allclose(K.dct(8) @ K.dct(8).T, np.eye(8))
    assert K.pixel_digest(a) == K.pixel_digest(K.to_bgr(a)) != K.pixel_digest(a[::-1])
    assert K.components(np.array([[1, 1, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 0, 0, 0]], bool)) == [(0, 0, 2, 2, 3), (0, 3, 1, 1, 1), (3, 0, 1, 2, 2)]
    assert K.shift_between(np.roll(a, (3, -2), (0, 1)), a)[:2] == (3, -2)
    assert K.mutual_information(a, a) == pytest.approx(1) and K.correlation(a, 255 - a) == pytest.approx(-1)
    for t, f in K.TRANSFORMS.items():
        assert f(a).size == a.size, t


def test_local_model():
    p = np.random.default_rng(2).uniform(0, 300, (30, 2))
    turn = np.array([[0.0, -1.2], [1.2, 0.0]])
    q = p @ turn.T + [20, 5]
    q[:5] += 60
    model, fit, error = K.similarity_model(p, q)
    assert fit.sum() == 25 and error < 1e-6 and np.allclose(model[:, :2], turn)


def test_pages_pair_under_a_transform_and_issues_stay_apart(spark):
    a, b = texture(120, 160), texture(120, 160, seed=9)
    some = decoded(spark, {"a.png": a, "turned.png": np.ascontiguousarray(np.rot90(a, -1)), "other.png": b})
    broken = some.limit(1).withColumns({"source_path": F.lit("bad.png"), "data": F.lit(None).cast("binary")})
    found = pages.page_features(some.unionByName(broken)).cache()
    assert [r.source_path for r in pages.issues(found).collect()] == ["bad.png"]
    pairs = pages.perceptual_pairs(found).collect()
    assert [(r.first, r.second) for r in pairs] == [("a.png#1", "turned.png#1")] and pairs[0].transform in ("rotate_90", "rotate_270")


def test_overlapping_crops_match_locally(spark):
    whole = texture(420, 520, seed=4, n=300)
    found = pages.page_features(decoded(spark, {"l.png": whole[:, :360], "r.png": whole[:, 140:]})).cache()
    pairs = pages.local_pairs(found, pages.descriptor_votes(found)).collect()
    assert len(pairs) == 1 and pairs[0].inliers >= 8 and pairs[0].scale == pytest.approx(1, abs=0.05)


def blot(seed=3, shift=0):
    rng, (y, x) = np.random.default_rng(seed), np.mgrid[:220, :420]
    a = 205 + rng.normal(0, 3, (220, 420)) + 6 * np.sin(x / 40)
    for i, (c, w) in enumerate(((60, 34), (155, 26), (250, 38), (350, 22))):
        a -= (110 - 14 * i) * np.exp(-(((x - c - shift) / w) ** 4) - ((y - 110 - 3 * i) / 12) ** 4)
    return np.clip(a, 0, 255).astype(np.uint8)


def test_blots(spark):
    a = blot()
    found = S.western(decoded(spark, {"a.png": a, "b.png": np.clip(a[:, ::-1].astype(float) * 0.9 + 10, 0, 255).astype(np.uint8), "c.png": texture(220, 420, seed=8)})).collect()
    pairs = {(r.first_page, r.second_page) for r in found if r.kind == "multi"}
    assert pairs == {("a.png#1", "b.png#1")} and {r.transform for r in found} == {"flip_horizontal"}


def test_dots(spark):
    rng, (y, x) = np.random.default_rng(6), np.mgrid[:180, :900]
    a = np.full((180, 900), 220.0)
    for i in range(8):
        c = 60 + i * 100 + (i % 3) * 9
        a -= (90 + 10 * (i % 4)) * (((x - c) / 26) ** 2 + ((y - 90) / 24) ** 2 < 1) * (0.8 + 0.2 * np.sin((x - c) / (2 + i) + i))
    a = np.clip(a + rng.normal(0, 2, a.shape), 0, 255).astype(np.uint8)
    found = S.dot_blots(decoded(spark, {"whole.png": a, "part.png": a[:, 100:520]})).collect()
    assert len(found) == 1 and found[0].matched_spots >= 3 and found[0].appearance >= 0.68


def test_fluorescence(spark):
    rng = np.random.default_rng(5)
    plane = lambda seed: np.where(texture(240, 280, seed=seed, n=25) > 100, 200, 5) + rng.integers(0, 5, (240, 280))
    blue, green = plane(1), plane(2)
    image = lambda b=None, g=None: np.stack([b if b is not None else np.full((240, 280), 3), g if g is not None else np.full((240, 280), 3), np.full((240, 280), 3)], axis=2).astype(np.uint8)
    found = S.fluorescence(decoded(spark, {"cell_DAPI.png": image(b=blue), "cell_merge.png": image(blue, green), "other_FITC.png": image(g=green)})).collect()
    rules = {(r.first_page, r.second_page): r.rule_id for r in found}
    assert rules[("cell_DAPI.png#1", "cell_merge.png#1")] == "image.fluorescence.merge_component"
    assert rules[("cell_merge.png#1", "other_FITC.png#1")] == "image.fluorescence.same_channel_reuse"


def test_tissue(spark):
    def tissue(seed):
        a, dots = np.full((240, 240, 3), 245.0), texture(240, 240, seed=seed, n=90)
        a[dots > 60] = [170, 90, 190]
        a[dots > 170] = [120, 40, 110]
        return a.astype(np.uint8)

    found = S.pathology(decoded(spark, {"x_20x.png": tissue(1), "y_20x.png": np.ascontiguousarray(tissue(1)[:, ::-1]), "z_20x.png": tissue(7)})).collect()
    assert [(r.first_page, r.second_page, r.rule_id) for r in found] == [("x_20x.png#1", "y_20x.png#1", "image.pathology.local_reuse")]


def test_thumbnails_decode(spark, tmp_path):
    a = K.to_bgr(texture(200, 300))
    (tmp_path / "a.png").write_bytes(K.png(a))
    (tmp_path / "t.png").write_bytes(K.thumbnail(a, (50, 40, 100, 80), (64, 64)))
    (tmp_path / "bad.png").write_text("no picture")
    found = {r.source_path.rsplit("/", 1)[-1]: r for r in pages.images(spark, str(tmp_path)).collect()}
    assert bytes(found["a.png"].data) == a.tobytes() and found["bad.png"].data is None
    assert max(found["t.png"].width, found["t.png"].height) == 64


def test_long_rows_go_out_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    from echotrace.functions import rows

    seen, whole = [], pa.RecordBatch.from_pylist

    class Batches:
        @staticmethod
        def from_pylist(out, schema):
            seen.append(len(out))
            return whole(out, schema=schema)

    class Frame:
        sparkSession = spark

        def mapInArrow(self, f, schema):
            batch = pa.RecordBatch.from_pylist([{"id": i} for i in range(300)])
            monkeypatch.setattr(rows.pa, "RecordBatch", Batches)
            return list(f(iter([batch])))

    out = rows.map_rows(Frame(), "id int, v array<float>", lambda r: [{"id": r["id"], "v": [0.0] * 4096}])
    assert sum(b.num_rows for b in out) == 300 and max(seen) <= 64


def test_features_that_are_not_wanted_are_left_out(spark):
    some = decoded(spark, {"a.png": texture(90, 70, seed=3, n=40), "b.png": texture(64, 64, seed=4, n=40)}).cache()
    whole = {r.source_path: r for r in pages.page_features(some).collect()}
    for wanted in ((), ("fingerprints", "standard_deviation"), ("thumbnail",)):
        for r in pages.page_features(some, wanted).collect():
            for c in r.asDict():
                left_out = c in pages.PARTS and c not in wanted or c == "descriptors"
                assert r[c] == (None if left_out else whole[r.source_path][c])


def test_resized_pictures_do_not_change_with_what_is_kept():
    a = np.random.default_rng(2).integers(0, 256, (64, 48)).astype(np.uint8)
    assert (K.resize(a, 32, 32) == K._side(64, 32) @ a.astype(float) @ K._side(48, 32).T).all()
    for n, m in ((640, 480), (20, 64), (64, 9)):
        assert np.allclose(K.resize(np.full((n, n), 7, np.uint8), m, m), 7)
