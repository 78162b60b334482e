"""Spot arrays at all angles, with gaps, mirrored, and their index against all pairs."""

from itertools import combinations

import numpy as np
import pytest

from echotrace.vision import dots, kernels as K, specialists as S

from .test_vision import decoded


def page(kinds, angle=0.0, size=(420, 420), step=46.0, mirror=False, seed=0, at=None):
    """Spots in a line; kinds: a seed for the looks of each, None leaves one out."""
    h, w = size
    y, x = np.mgrid[:h, :w]
    a = np.full(size, 215.0)
    t = np.radians(angle)
    cx, cy = at or (w / 2, h / 2)
    for i, kind in enumerate(kinds):
        if kind is None:
            continue
        rng = np.random.default_rng(kind)
        along = (i - (len(kinds) - 1) / 2) * step + rng.uniform(-7, 7)
        u, v = x - cx - along * np.cos(t), y - cy - along * np.sin(t)
        p, q = u * np.cos(t) + v * np.sin(t), -u * np.sin(t) + v * np.cos(t)
        if mirror:
            q = -q
        (rx, ry), dark = ((7, 8), (17, 14), (9, 16), (16, 8), (12, 12), (8, 7))[kind * 7 % 6], (150, 70, 120, 90, 140, 60)[kind * 5 % 6]
        inside = (p / rx) ** 2 + (q / ry) ** 2 < 1
        shade = 1 - 0.8 * (((p - rng.uniform(-6, 6)) / 5) ** 2 + ((q - rng.uniform(-6, 6)) / 4) ** 2 < 1)
        a -= dark * inside * shade
    return np.clip(a + np.random.default_rng(seed).normal(0, 1.5, size), 0, 255).astype(np.uint8)


LOOKS = [11, 12, 13, 14, 15, 16]


def described(pixels):
    return [(r["structure"], np.array(r["extra"]), r) for r in dots.regions(K.to_bgr(pixels))]


@pytest.mark.parametrize("angle", [0, 12, 30, 45, 60, 75, 90, -30])
def test_turned_arrays_are_found(angle):
    found = described(page(LOOKS, angle))
    best = max(found, key=lambda r: len(r[2]["boxes"]))
    assert len(best[2]["boxes"]) == 6
    turn = abs(dots._degrees(tuple(best[1][:2])) - angle) % 180
    assert min(turn, 180 - turn) < 4
    got = [dots.compare(*x[:2], *y[:2]) for x in described(page(LOOKS, 0, seed=5)) for y in found]
    top = max((g for g in got if g), key=lambda g: (g["matched_spots"], g["confidence"]))
    assert top["matched_spots"] >= 5 and top["appearance"] > 0.8


def test_a_missing_spot_still_matches():
    whole, part = described(page(LOOKS)), described(page([11, 12, None, 14, 15, 16], 20, seed=3))
    top = max((g for x in whole for y in part if (g := dots.compare(*x[:2], *y[:2]))), key=lambda g: g["matched_spots"])
    assert top["matched_spots"] == 5 and top["layout_error"] < 0.03 and top["appearance"] > 0.8


def test_other_spots_do_not_match():
    for seed in range(4):
        a, b = described(page(range(100 + 10 * seed, 106 + 10 * seed))), described(page([500 + 6 * seed + i for i in (5, 1, 3, 0, 4, 2)], 25))
        got = [g for x in a for y in b if (g := dots.compare(*x[:2], *y[:2]))]
        assert all(g["matched_spots"] < 5 or g["appearance"] < 0.75 for g in got)  # fewer are alike by chance
    alike = described(page([7] * 6))  # six equal spots say nothing
    assert all(dots.compare(*x[:2], *x[:2]) is None for x in alike)


def test_mirrored_arrays():
    got = [g for x in described(page(LOOKS)) for y in described(page(LOOKS, 0, mirror=True, seed=9)) if (g := dots.compare(*x[:2], *y[:2]))]
    assert max(g["matched_spots"] for g in got) >= 4


def test_runs_with_one_missing_equal_all_choices():
    for n in range(3, 10):
        for count in range(3, n + 1):
            want = {c for c in combinations(range(n), count) if c[-1] - c[0] + 1 <= count + 1}
            got = [tuple(r) for r in dots.runs_of(n, count).tolist()]
            assert set(got) == want and len(got) == len(want)


def test_lines_equal_brute_force():
    rng = np.random.default_rng(4)
    c = np.concatenate([np.c_[np.arange(6) * 40.0, np.arange(6) * 15.0], rng.uniform(0, 240, (6, 2))])
    got = {frozenset(x.tolist()) for x in dots._lines(c, 6.0, 10.0)}
    want = set()
    for i, j in combinations(range(len(c)), 2):
        d = c[j] - c[i]
        if np.hypot(*d) >= 10:
            inside = frozenset(k for k in range(len(c)) if abs((c[k] - c[i]) @ np.array([-d[1], d[0]])) / np.hypot(*d) <= 6.0 + 1e-9)
            if len(inside) >= 3:
                want.add(inside)
    assert got == want and frozenset(range(6)) <= max(got, key=len)


def test_kernels_of_spots():
    p = np.zeros((32, 32))
    p[5:15, 10:20] = 1
    assert np.allclose(dots.turned(p, 90), np.rot90(p, 1)) and np.allclose(dots.turned(p, 180), p[::-1, ::-1]) and dots.turned(p, 0.2) is p
    same, shifted, other = dots.patch_similarities(p[None], np.stack([p, np.roll(p, (2, -1), (0, 1)), p.T[::-1]]))[0]
    assert min(same, shifted) > 0.99 > 0.5 > other and dots.patch_similarities(np.zeros((2, 32, 32)), p[None]).tolist() == [[0.0], [0.0]]
    disc = np.hypot(*(np.mgrid[:60, :60] - 30)) < 9
    (spot,) = dots.spots(np.where(disc, 60, 200).astype(np.uint8), disc)
    assert spot["circularity"] > 0.8 and spot["solidity"] > 0.85 and spot["contrast"] == pytest.approx(140) and (spot["x"], spot["y"]) == pytest.approx((30.5, 30.5))
    assert list(dots.regions(np.zeros((10, 10, 3), np.uint8))) == [] and list(dots.regions(np.full((100, 100, 3), 128, np.uint8))) == []


def random_array(rng, n):
    along = np.cumsum(rng.uniform(20, 60, n))
    t = rng.uniform(-1.5, 1.5)
    table = np.c_[along * np.cos(t), along * np.sin(t), rng.lognormal(3, 1.3, n), rng.lognormal(5, 1.3, n), rng.uniform(0.5, 1, n), rng.uniform(0.6, 1, n)]
    return rng.random((n, 8 * 8)), np.r_[np.cos(t), np.sin(t), table.ravel()]


def test_the_index_equals_all_pairs_of_arrays(spark, monkeypatch):
    """Arrays of which a fifth are copies: smaller, without a spot, slightly moved."""
    monkeypatch.setattr(dots, "PATCH", 8)  # small pictures, as all pairs are compared
    rng = np.random.default_rng(12)
    some = [random_array(rng, int(n)) for n in rng.integers(4, 9, 48)]
    for k in range(12):
        s, e = some[k]
        table = e[2:].reshape(-1, 6).copy()
        table[:, :2] = table[:, :2] * 0.7 + rng.normal(0, 0.4, (len(table), 2))
        table[:, 3] *= 0.49
        keep = np.delete(np.arange(len(table)), 1 + k % (len(table) - 2)) if k % 2 and len(table) > 5 else np.arange(len(table))
        some.append((s[keep], np.r_[e[:2], table[keep].ravel()]))
    rows = [(f"p{i:04d}#1#0000", s.astype(float).ravel().tolist(), e.tolist(), len(s)) for i, (s, e) in enumerate(some)]
    df = spark.createDataFrame([(a, c) for a, _, c, _ in rows], "id string, extra array<double>")
    every = {tuple(r) for r in S.dot_candidates(df, bucket=None, all_pairs=0).collect()}
    want = {(i, j) for i, j in combinations(range(60), 2) if dots.compare(*some[i], *some[j])}
    assert {(48 + k) for k in range(12)} <= {j for _, j in want}
    named = lambda i: rows[i][0]
    assert {(named(i), named(j)) for i, j in want} <= every
    rolling = {tuple(r) for r in S.dot_candidates(df, bucket=200, all_pairs=0).collect()}
    assert rolling == every
    few = {tuple(r) for r in S.dot_candidates(df, bucket=3, all_pairs=0).collect()}
    assert few < every
    assert len(list(S.dot_candidates(df.limit(10)).collect())) == 45


def test_arrays_of_pages_meet(spark):
    found = S.dot_blots(decoded(spark, {"a.png": page(LOOKS), "b.png": page([11, 12, 13, None, 15, 16], 40, seed=8), "c.png": page(range(200, 206), 10)})).collect()
    best = max(found, key=lambda r: r.confidence)
    assert (best.first_page, best.second_page) == ("a.png#1", "b.png#1") and best.matched_spots == 5 and best.appearance > 0.8
    assert abs(abs(best.spot_rotation) - 40) < 5 and best.spot_scale == pytest.approx(1, abs=0.1)
