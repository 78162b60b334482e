"""Arrays of spots at any angle: found under several binarisations, described spot by spot, compared with one spot missing or more.

A page gives at most REGIONS arrays of 3 to LONGEST spots in a line. Two arrays are compared over runs of equally many spots, in
either order, each of which may leave out one spot of its own: the places along the line must agree, then the spots' pictures, turned by
the angle between both lines, then their contrast, area and shape. Pairs meet by rounded places of runs of three and four spots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from echotrace.vision import kernels as K

# Fixed values of the rule.
QUANTILES, PEAK_SHARES, RESPONSE_QUANTILES = (2, 5, 8, 10, 12, 15, 20, 25, 30), (0.06, 0.10, 0.16), (10, 25, 40, 55, 70, 82)
SPOTS, REGIONS, ARRAYS, LONGEST, PATCH = 32, 8, 32, 12, 32
LAYOUT_ERROR, APPEARANCE, LEAST_SPOT, PROFILE, PROFILE_OF_THREE, DISTINCT = {3: 0.048}, 0.58, 0.34, 0.60, 0.42, 0.30
#: What makes an array a good one: number of spots, even gaps, straightness, shapes, contrast, length, each with its weight.
WEIGHTS = np.array([1.35, 3.0, 2.0, 1.6, 1.0, 1.0])
#: Numbers that describe a spot in a region's `extra`, after the axis.
FIELDS = ("x", "y", "contrast", "area", "circularity", "solidity")


def binarisations(gray: np.ndarray) -> Iterator[np.ndarray]:
    """Masks of dark spots: the darkest shares of all pixels, and what is darker than its surroundings by several bounds."""
    for q in np.percentile(gray, QUANTILES):
        yield gray <= q
    radius = max(4, round(min(gray.shape) * 0.09))
    ground = gray.astype(float)
    for _ in range(3):  # three means are nearly a Gaussian
        ground = K.blur(ground, radius)
    response = ground - gray
    strong = response[response >= 3]
    if strong.size:
        bounds = [share * np.percentile(strong, 99.5) for share in PEAK_SHARES] + list(np.percentile(strong, RESPONSE_QUANTILES))
        for bound in bounds:
            yield response >= max(4.0, bound)


def opened(mask: np.ndarray) -> np.ndarray:
    """Without what a cross of five pixels doesn't fit into, and without the margins."""

    def cross(m: np.ndarray, both: bool) -> np.ndarray:
        p = np.pad(m, 1, constant_values=both)
        parts = p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]
        return np.logical_and.reduce(parts) if both else np.logical_or.reduce(parts)

    margin, out = max(3, round(min(mask.shape) * 0.02)), mask.copy()
    out[:margin] = out[-margin:] = False
    out[:, :margin] = out[:, -margin:] = False
    return cross(cross(out, True), False)


def _hull_area(x: np.ndarray, y: np.ndarray) -> float:
    """The area of the least convex shape around pixels."""
    corners = sorted({(int(a) + i, int(b) + j) for a, b in zip(x, y) for i in (0, 1) for j in (0, 1)})

    def half(points: list) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = np.array(half(corners) + half(corners[::-1]), float)
    return abs(float(ring[:, 0] @ np.roll(ring[:, 1], -1) - ring[:, 1] @ np.roll(ring[:, 0], -1))) / 2


def _patch(gray: np.ndarray, cx: float, cy: float, size: int) -> np.ndarray:
    """The spot as PATCH x PATCH shares of its own darkness."""
    side = max(12, round(1.7 * size))
    xs, ys = (np.clip(np.rint(c - (side - 1) / 2 + np.arange(side)).astype(int), 0, n - 1) for c, n in ((cx, gray.shape[1]), (cy, gray.shape[0])))
    a = K.resize(gray[np.ix_(ys, xs)], PATCH, PATCH)
    signal = np.percentile(np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]]), 75) - a
    high = np.percentile(signal, 98)
    return K.blur(np.clip(signal / high, 0, 1), 1) if high > 2 else np.zeros((PATCH, PATCH))


def spots(gray: np.ndarray, mask: np.ndarray) -> list[dict]:
    """The mask's parts that may be spots, from left to right."""
    h, w = gray.shape
    out = []
    for x, y, bw, bh, area in K.components(mask):
        if not (area >= max(10, round(h * w * 0.00025)) and 4 <= bw <= 0.42 * w and 4 <= bh <= 0.7 * h and 0.3 <= bw / bh <= 3.2 and area >= 0.17 * bw * bh):
            continue
        own = mask[y : y + bh, x : x + bw]
        inside = own if own.sum() == area else _part_of(own, area)
        edge = np.pad(inside, 1)
        around = np.pi / 4 * (np.abs(np.diff(edge.astype(np.int8), axis=0)).sum() + np.abs(np.diff(edge.astype(np.int8), axis=1)).sum())
        ys, xs = np.nonzero(inside)
        ends = np.concatenate([np.flatnonzero(np.r_[True, ys[1:] != ys[:-1]]), np.flatnonzero(np.r_[ys[1:] != ys[:-1], True])])  # a row's first and last pixel
        round_, solid = min(1.0, 4 * np.pi * area / around**2), min(1.0, area / max(_hull_area(xs[ends], ys[ends]), 1e-6))
        if round_ < 0.13 or solid < 0.32:
            continue
        pad = max(3, round(max(bw, bh) * 0.35))
        top, left = max(0, y - pad), max(0, x - pad)
        window = gray[top : y + bh + pad, left : x + bw + pad].astype(float)
        ring = window.copy()
        ring[y - top : y - top + bh, x - left : x - left + bw] = np.nan
        ground = np.nanpercentile(ring, 70) if np.isfinite(ring).any() else np.percentile(window, 70)
        contrast = float(ground - gray[y : y + bh, x : x + bw][inside].mean())
        if contrast >= 4:
            out.append({"box": (x, y, bw, bh), "x": x + float(xs.mean()) + 0.5, "y": y + float(ys.mean()) + 0.5, "contrast": contrast, "area": float(area), "circularity": float(round_), "solidity": float(solid)})
    return sorted(out, key=lambda s: (s["x"], s["y"]))[:SPOTS]


def _part_of(mask: np.ndarray, area: int) -> np.ndarray:
    """Of several parts in one box, that with this area whose box is the whole."""
    seen = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        part, stack = np.zeros_like(mask), [(y, x)]
        part[y, x] = True
        while stack:
            i, j = stack.pop()
            for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)):
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not part[a, b]:
                    part[a, b] = True
                    stack.append((a, b))
        seen |= part
        if part.sum() == area and part.any(0).all() and part.any(1).all():
            return part
    return mask


def _lines(centres: np.ndarray, tolerance: float, least: float) -> list[np.ndarray]:
    """Every set of three spots or more that one line through two of them meets, in its order; sets that lie in a larger one are there for their own neighbours."""
    n = len(centres)
    i, j = np.triu_indices(n, 1)
    d = centres[j] - centres[i]
    length = np.hypot(d[:, 0], d[:, 1])
    i, d, length = i[length >= least], d[length >= least], length[length >= least]
    axis = d / length[:, None]
    axis *= np.where((axis[:, 0] < -1e-6) | ((np.abs(axis[:, 0]) <= 1e-6) & (axis[:, 1] < 0)), -1, 1)[:, None]
    off = centres[None] - centres[i][:, None]
    near = np.abs(off[..., 0] * -axis[:, None, 1] + off[..., 1] * axis[:, None, 0]) <= tolerance
    found = {}
    for row, a in zip(near, axis):
        if row.sum() >= 3:
            at = np.flatnonzero(row)
            order = at[np.argsort(centres[at] @ a, kind="stable")]
            found.setdefault(order.tobytes(), order)
    return list(found.values())


def arrays(some: list[dict], width: int, height: int) -> list[tuple[float, tuple[int, ...], tuple[float, float]]]:
    """The best ARRAYS runs of spots in a line: score, spots in the line's order, its direction."""
    centres = np.array([(s["x"], s["y"]) for s in some])
    size, diagonal = float(np.median([max(s["box"][2:]) for s in some])), float(np.hypot(width, height))
    runs: dict[int, set[tuple[int, ...]]] = {}
    for line in _lines(centres, max(6.0, 0.72 * size, 0.012 * diagonal), max(10.0, 0.65 * size)):
        for n in range(3, min(LONGEST, len(line)) + 1):
            runs.setdefault(n, set()).update(tuple(line[k : k + n].tolist()) for k in range(len(line) - n + 1))
    shape = np.array([0.55 * min(1.0, s["circularity"] / 0.72) + 0.45 * min(1.0, s["solidity"] / 0.9) for s in some])
    contrast = np.array([s["contrast"] for s in some])
    best: dict[tuple[int, ...], tuple[float, tuple[int, ...], tuple[float, float]]] = {}
    for n, found in runs.items():
        at = np.array(sorted(found))
        c = centres[at] - centres[at].mean(1, keepdims=True)
        xx, yy, xy = (c[..., 0] ** 2).sum(1), (c[..., 1] ** 2).sum(1), (c[..., 0] * c[..., 1]).sum(1)
        turn = 0.5 * np.arctan2(2 * xy, xx - yy)  # the axis of the spots' greatest spread
        axis = np.stack([np.cos(turn), np.sin(turn)], 1)
        axis *= np.where((axis[:, 0] < -1e-6) | ((np.abs(axis[:, 0]) <= 1e-6) & (axis[:, 1] < 0)), -1, 1)[:, None]
        along = (c * axis[:, None]).sum(2)
        order = np.argsort(along, axis=1, kind="stable")
        at, along = np.take_along_axis(at, order, 1), np.take_along_axis(along, order, 1)
        gaps, span = np.diff(along, axis=1), along[:, -1] - along[:, 0]
        uneven = gaps.std(1) / np.maximum(gaps.mean(1), 1e-6)
        spread = (c[..., 0] * -axis[:, None, 1] + c[..., 1] * axis[:, None, 0]).std(1) / max(size, 1.0)
        good = (span >= max(2 * size, 0.08 * diagonal)) & (gaps.min(1) >= max(2.0, 0.22 * size)) & (uneven <= 0.62) & (spread <= 0.72)
        rated = np.stack([np.full(len(at), float(min(n, 8))), np.maximum(0, 1 - uneven), np.maximum(0, 1 - spread), shape[at].mean(1), np.minimum(1, np.median(contrast[at], axis=1) / 45), np.minimum(1, span / max(0.38 * diagonal, 1))], 1) @ WEIGHTS
        for k in np.flatnonzero(good):
            key = tuple(sorted(at[k].tolist()))
            if key not in best or rated[k] > best[key][0]:
                best[key] = float(rated[k]), tuple(at[k].tolist()), (float(axis[k, 0]), float(axis[k, 1]))
    return sorted(best.values(), key=lambda r: (-r[0], r[1]))[:ARRAYS]


def _degrees(axis: tuple[float, float]) -> float:
    return float(np.degrees(np.arctan2(axis[1], axis[0])))


def _same_array(a: dict, b: dict) -> bool:
    """Whether two arrays are the same spots, seen under two masks."""
    turn = abs(_degrees(a["axis"]) - _degrees(b["axis"])) % 180
    if min(turn, 180 - turn) > 12:
        return False
    (ax, ay, aw, ah), (bx, by, bw, bh) = a["region"], b["region"]
    both = max(0, min(ax + aw, bx + bw) - max(ax, bx)) * max(0, min(ay + ah, by + bh) - max(ay, by))
    if both >= 0.42 * (aw * ah + bw * bh - both):
        return True
    apart = np.hypot(ax + aw / 2 - bx - bw / 2, ay + ah / 2 - by - bh / 2)
    return apart <= max(10.0, 0.12 * min(aw, bw)) and 0.68 <= aw / max(bw, 1) <= 1.47


def regions(pixels: np.ndarray) -> Iterator[dict]:
    """At most REGIONS arrays of a page, the best first; structure: a spot's picture a row; extra: the axis, then FIELDS of each spot."""
    gray = K.to_gray(pixels)
    h, w = gray.shape
    if h < 24 or w < 48 or gray.std() < 4 or (np.median(gray) < 72 and (gray >= 160).mean() < 0.3):
        return
    found = []
    for mask in binarisations(gray):
        some = spots(gray, opened(mask))
        if len(some) < 3:
            continue
        for score, at, axis in arrays(some, w, h):
            own = [some[i] for i in at]
            left, top = min(s["box"][0] for s in own), min(s["box"][1] for s in own)
            right, bottom = max(s["box"][0] + s["box"][2] for s in own), max(s["box"][1] + s["box"][3] for s in own)
            px, py = max(2, round(0.03 * (right - left))), max(2, round(0.15 * (bottom - top)))
            left, top, right, bottom = max(0, left - px), max(0, top - py), min(w, right + px), min(h, bottom + py)
            found.append({"score": score, "axis": axis, "spots": own, "region": (left, top, right - left, bottom - top)})
    kept: list[dict] = []
    for r in sorted(found, key=lambda r: -r["score"]):
        if len(kept) == REGIONS:
            break
        if not any(_same_array(r, k) for k in kept):
            kept.append(r)
    for r in kept:
        x, y, bw, bh = r["region"]
        patches = np.stack([_patch(gray, s["x"], s["y"], max(s["box"][2:])) for s in r["spots"]])
        extra = [*r["axis"], *(s[f] for s in r["spots"] for f in FIELDS)]
        yield {"kind": "dots", "x": x, "y": y, "width": bw, "height": bh, "score": r["score"], "structure": patches.reshape(len(patches), -1), "hashes": [0], "boxes": [list(map(int, s["box"])) for s in r["spots"]], "extra": list(map(float, extra))}


# --- comparing ---------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=512)
def runs_of(n: int, count: int) -> np.ndarray:
    """Places of `count` of n spots that follow one another, one missing at most."""
    whole = [tuple(range(i, i + count)) for i in range(n - count + 1)]
    gapped = [tuple(range(i, i + k)) + tuple(range(i + k + 1, i + count + 1)) for i in range(n - count) for k in range(1, count)]
    return np.array(whole + gapped, int).reshape(-1, count)


def _described(extra: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Axis, the spots' places along it, and their FIELDS."""
    table = extra[2:].reshape(-1, len(FIELDS))
    return extra[:2], table[:, :2] @ extra[:2], {f: table[:, i] for i, f in enumerate(FIELDS)}


def layouts(along: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The places of runs as shares of their length."""
    at = along[runs]
    return (at - at[:, :1]) / np.maximum(at[:, -1:] - at[:, :1], 1.0)


def signatures(extra: np.ndarray) -> list[int]:
    """Numbers that arrays with a like run of three or four spots share, read in either direction: rounded inner places on two grids, each shifted by half a step too."""
    _, along, _ = _described(np.asarray(extra, float))
    out = set()
    for count in (3, 4):
        if len(along) >= count:
            inner = layouts(along, runs_of(len(along), count))[:, 1:-1]
            for places in (inner, 1 - inner[:, ::-1]):
                for bins in (8, 12):
                    for half in (0, 1):
                        cells = np.floor(places * bins + half / 2).astype(int)
                        out |= {((count * 16 + bins) * 2 + half) * 4096 + int(c[0]) * 64 + int(c[-1]) for c in cells}
    return sorted(out)


def turned(patch: np.ndarray, degrees: float) -> np.ndarray:
    """A square picture turned around its middle, linear between pixels, empty outside."""
    if abs((degrees + 180) % 360 - 180) < 0.5:
        return patch
    n, t = patch.shape[0], np.radians(degrees)
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    sx, sy = x * np.cos(t) - y * np.sin(t) + (n - 1) / 2, x * np.sin(t) + y * np.cos(t) + (n - 1) / 2
    p = np.pad(patch, 1)
    i, j = np.floor(sy).astype(int), np.floor(sx).astype(int)
    fy, fx = sy - i, sx - j
    ok = (i >= -1) & (i < n) & (j >= -1) & (j < n)
    i, j = np.where(ok, i + 1, 0), np.where(ok, j + 1, 0)
    i2, j2 = np.minimum(i + 1, n + 1), np.minimum(j + 1, n + 1)
    return np.where(ok, (p[i, j] * (1 - fx) + p[i, j2] * fx) * (1 - fy) + (p[i2, j] * (1 - fx) + p[i2, j2] * fx) * fy, 0.0)


def _laplacian(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)], mode="reflect")
    return p[..., :-2, 1:-1] + p[..., 2:, 1:-1] + p[..., 1:-1, :-2] + p[..., 1:-1, 2:] - 4 * a


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows without their mean, of length 1; those without a spread become 0."""
    x = rows - rows.mean(-1, keepdims=True)
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.where(size > 1e-9, x / np.maximum(size, 1e-9), 0.0)


def patch_similarities(a: np.ndarray, b: np.ndarray, reach: int = 2) -> np.ndarray:
    """Of each picture of a with each of b: correlation at the best shift, overlap of what is dark, and correlation of edges there."""
    k, n = len(b), a.shape[1]
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(b, ((0, 0), (reach, reach), (reach, reach))), (n, n), axis=(1, 2)).reshape(k, -1, n * n)
    correlations = np.einsum("ip,jwp->ijw", _unit(a.reshape(len(a), -1)), _unit(windows), optimize=True)
    best = correlations.argmax(2)
    moved = windows[np.arange(k)[None, :], best].reshape(len(a), k, n, n)
    dark, other = (a >= 0.28)[:, None], moved >= 0.28
    both, either = (dark & other).sum((2, 3)), (dark | other).sum((2, 3))
    edges = (_unit(_laplacian(a).reshape(len(a), 1, -1)) * _unit(_laplacian(moved).reshape(len(a), k, -1))).sum(2)
    top = np.take_along_axis(correlations, best[..., None], 2)[..., 0]
    return np.clip(0.58 * np.maximum(0, top) + 0.27 * both / np.maximum(either, 1) + 0.15 * np.maximum(0, edges), 0, 1)


def distinctness(f: dict[str, np.ndarray], at: np.ndarray, patches: np.ndarray) -> float:
    """How unlike a run's spots are: by contrast, area and picture."""
    vary = lambda v: float(v.std() / max(v.mean(), 1e-6))
    own = _unit(patches[at].reshape(len(at), -1))
    unlike = 1 - np.maximum(0, (own @ own.T)[np.triu_indices(len(at), 1)])
    return float(np.clip(0.3 * vary(f["contrast"][at]) + 0.35 * vary(f["area"][at]) + 0.35 * unlike.mean(), 0, 1))


def profile(f: dict[str, np.ndarray], at: np.ndarray, g: dict[str, np.ndarray], bt: np.ndarray) -> np.ndarray:
    """How alike the spots of two runs are in relative contrast, relative area and shape; a row of at and bt for each two runs."""

    def relative(name: str) -> np.ndarray:
        a, b = (np.log(np.maximum(v / np.maximum(np.median(v, axis=1, keepdims=True), 1e-6), 1e-4)) for v in (f[name][at], g[name][bt]))
        return np.exp(-np.abs(a - b).mean(1))

    shape = sum(share * np.maximum(0, 1 - np.abs(f[n][at] - g[n][bt])) for n, share in (("circularity", 0.55), ("solidity", 0.45))).mean(1)
    return 0.42 * relative("contrast") + 0.33 * relative("area") + 0.25 * shape


def compare(structure_a: np.ndarray, extra_a: np.ndarray, structure_b: np.ndarray, extra_b: np.ndarray) -> dict | None:
    """What two arrays have in common over the longest run that is alike, the best of these; None if there is none."""
    (axis_a, along_a, f), (axis_b, along_b, g) = _described(extra_a), _described(extra_b)
    a, b = (s.reshape(-1, PATCH, PATCH) for s in (structure_a, structure_b))
    between: dict[tuple[float, bool], np.ndarray] = {}

    def alike(degrees: float, mirrored: bool) -> np.ndarray:
        """All spots of one with all of the other."""
        if (degrees, mirrored) not in between:
            other = np.stack([turned(x, -degrees) for x in b])  # rows count downwards
            between[degrees, mirrored] = patch_similarities(a, other[:, :, ::-1] if mirrored else other)
        return between[degrees, mirrored]

    for n in range(min(8, len(a), len(b)), 2, -1):
        if n == 3 == len(a) == len(b):
            break
        runs_a, runs_b, bound, found = runs_of(len(a), n), runs_of(len(b), n), LAYOUT_ERROR.get(n, 0.065), []
        places_a, places_b = layouts(along_a, runs_a), layouts(along_b, runs_b)
        for backwards in (False, True):
            other = 1 - places_b[:, ::-1] if backwards else places_b
            errors = np.sqrt(((places_a[:, None] - other[None]) ** 2).mean(2))
            degrees = (_degrees(axis_a) - _degrees(axis_b) - 180 * backwards + 180) % 360 - 180
            i, j = np.nonzero(errors <= bound)
            if not len(i):
                continue
            near, ats, bts = errors[i, j], runs_a[i], runs_b[j][:, ::-1] if backwards else runs_b[j]
            sames = profile(f, ats, g, bts)
            kept = sames >= (PROFILE_OF_THREE if n == 3 else PROFILE)
            if not kept.any():
                continue
            near, ats, bts, sames = near[kept], ats[kept], bts[kept], sames[kept]
            direct, flipped = (alike(degrees, m)[ats, bts] for m in (False, True))
            turn = flipped.mean(1) > direct.mean(1) + 0.025
            each = np.where(turn[:, None], flipped, direct)
            kept = (each.mean(1) >= (0.68 if n == 3 else APPEARANCE)) & (each.min(1) >= (0.40 if n == 3 else LEAST_SPOT))
            for k in np.flatnonzero(kept):
                at, bt, same, error, mirrored = ats[k], bts[k], float(sames[k]), float(near[k]), bool(turn[k])
                mean, least = float(each[k].mean()), float(each[k].min())
                own = distinctness(f, at, a), distinctness(g, bt, b)
                if max(own) < DISTINCT or (n == 3 and min(own) < 0.14 and mean < 0.8):
                    continue
                layout = max(0.0, 1 - error / bound)
                score = min(0.97, 0.36 + 0.16 * layout + 0.28 * mean + 0.10 * same + 0.07 * min(n, 6) / 6)
                length = lambda h, r: float(np.hypot(h["x"][r[-1]] - h["x"][r[0]], h["y"][r[-1]] - h["y"][r[0]]))
                found.append({
                    "matched_spots": n, "layout_error": error, "layout": layout, "appearance": mean, "least_spot": least, "profile": same, "spot_scale": length(f, at) / max(length(g, bt), 1e-6), "spot_rotation": float(degrees),
                    "mirrored": mirrored, "confidence": float(score), "risk": "medium" if n >= 4 and error <= 0.04 and mean >= 0.68 else "low",
                })
        if found:
            return max(found, key=lambda r: (r["confidence"], -r["layout_error"]))
    return None
