"""Four kinds of pictures: blots, dot arrays, fluorescence and tissue. Each has regions of a page, candidate pairs by votes, and a check of a pair.

Regions come from NumPy in mapInPandas, a page at a time; pairs meet by bytes of hashes in joins; a pair is checked in
NumPy again, and classed by column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.functions.expr import channel_role, field_key, magnification
from echotrace.functions.rows import map_rows
from echotrace.operators.similarity import banded, best_of, byte_keys, with_both
from echotrace.vision import dots, kernels as K
from echotrace.vision.pages import array_of

REGION = "id string, source_path string, page int, kind string, name string, x int, y int, width int, height int, score double, hashes array<bigint>, rows int, columns int, structure array<float>, extra array<float>, boxes array<array<int>>"
_COLUMNS = [x.split()[0] for x in REGION.split(", ")]


def regions(decoded: DataFrame, find: Callable[[np.ndarray], Iterator[dict]]) -> DataFrame:
    """REGION rows of every page; find: BGR pixels to regions. A page that can't be read has none."""

    def of(r: dict) -> Iterator[dict]:
        if r["data"] is not None:
            pixels = K.to_bgr(array_of(r["data"], r["height"], r["width"], r["channels"]))
            for k, found in enumerate(find(pixels)):
                s = found.pop("structure")
                yield {"id": f"{r['source_path']}#{r['page']}#{k:04d}", "source_path": r["source_path"], "page": r["page"], "rows": s.shape[0], "columns": s.shape[1], "structure": s.ravel().tolist(), "extra": [], "boxes": [], "name": "", **found}

    return map_rows(decoded, REGION, of)


def _overlap(a: str = "_1", b: str = "_2") -> Column:
    c = lambda n, s: F.col(f"{n}{s}")
    span = lambda p, s: F.greatest(F.lit(0), F.least(c(p, a) + c(s, a), c(p, b) + c(s, b)) - F.greatest(c(p, a), c(p, b)))
    both = span("x", "width") * span("y", "height")
    return both / (c("width", a) * c("height", a) + c("width", b) * c("height", b) - both)


def candidates(found: DataFrame, votes: int = 2, cap: int = 128, same_page: float | None = None, more: DataFrame | None = None) -> DataFrame:
    """Pairs of regions with so many common hash bytes (or votes of `more`: id, id2, votes), with both sides' columns.

    same_page: the overlap that two regions of one page may have at most; None: regions of one page never pair.
    """
    keys = F.transform(byte_keys(F.col("hashes")), lambda k: F.struct(k.i.alias("i"), k.byte.alias("byte")))
    met = banded(found, keys, cap=cap)
    if more is not None:
        met = met.unionByName(more).groupBy("id", "id2").agg(F.sum("votes").alias("votes"))
    both = with_both(met.where(F.col("votes") >= votes), found, [c for c in _COLUMNS if c != "id"])
    own = (F.col("source_path_1") == F.col("source_path_2")) & (F.col("page_1") == F.col("page_2"))
    return both.where(~own if same_page is None else ~own | (_overlap() <= same_page))


def checked(pairs: DataFrame, check: Callable[[dict], dict | None], schema: str) -> DataFrame:
    """id, id2, page_1, page_2 ... and what check() finds in a pair; it gets the row as a dict with arrays as NumPy."""
    def of(r: dict) -> Iterator[dict]:
        for s in ("_1", "_2"):
            r["structure" + s] = np.asarray(r["structure" + s], float).reshape(r["rows" + s], r["columns" + s])
            r["extra" + s] = np.asarray(r["extra" + s], float)
        if (got := check(r)) is not None:
            plain = {k: v.item() if isinstance(v, np.generic) else v for k, v in got.items()}
            yield {"first": r["id"], "second": r["id2"], "first_page": f"{r['source_path_1']}#{r['page_1']}", "second_page": f"{r['source_path_2']}#{r['page_2']}", **_sides(r), **plain}

    return map_rows(pairs, f"first string, second string, first_page string, second_page string, {SIDES}, {schema}", of)


SIDES = "first_region string, second_region string, first_parts int, second_parts int, first_score double, second_score double"


def _sides(r: dict) -> dict:
    """Where each region lies, how many bands or spots it has, and its score."""
    out: dict = {}
    for name, s in (("first", "_1"), ("second", "_2")):
        out |= {f"{name}_region": ", ".join(str(r[k + s]) for k in ("x", "y", "width", "height")), f"{name}_parts": len(r["boxes" + s]), f"{name}_score": r["score" + s]}
    return out


def _best_flip(r: dict, most: int, size: tuple[int, int]) -> tuple[str, float, np.ndarray] | None:
    """The flip of the second structure that is most like the first, if its hash is near enough."""
    first = K.phash(_scaled(r["structure_1"]))
    found = []
    for t in K.FLIPS:
        b = K.TRANSFORMS[t](r["structure_2"])
        distance = int((first ^ K.phash(_scaled(b))) & (1 << 64) - 1).bit_count()
        if distance <= most:
            found.append((K.correlation(r["structure_1"], b), t, b, distance))
    return max(found, key=lambda x: x[0]) if found else None


def _scaled(a: np.ndarray) -> np.ndarray:
    low, high = a.min(), a.max()
    return (a - low) * (255 / (high - low)) if high > low else np.zeros_like(a)


# --- blots -------------------------------------------------------------------------------------------------------------


def western_regions(pixels: np.ndarray) -> Iterator[dict]:
    """Rows of dark or bright bands: groups of two or more, single ones, and the page as a strip where it is narrow."""
    gray = K.to_gray(pixels).astype(float)
    ground = K.blur(gray, max(8, min(gray.shape) // 8))
    best: tuple[float, str, np.ndarray] | None = None
    for polarity, response in (("dark", ground - gray), ("bright", gray - ground)):
        response = np.clip(response, 0, None)
        level = max(12.0, K.otsu(response) if response.max() > 1 else 255)
        mask = response > level
        score = float(response[mask].sum()) if mask.any() else 0.0
        if best is None or score > best[0]:
            best = score, polarity, mask
    score, polarity, mask = best
    bands = [b for b in K.components(mask) if b[2] >= 6 and b[3] >= 3 and b[2] >= 0.8 * b[3] and b[4] >= 24 and b[2] < 0.9 * gray.shape[1]]
    if len(bands) > 256:
        return
    rows: list[list] = []
    for b in sorted(bands, key=lambda b: b[1] + b[3] / 2):
        if rows and abs(b[1] + b[3] / 2 - np.mean([o[1] + o[3] / 2 for o in rows[-1]])) <= 0.8 * max(b[3], np.mean([o[3] for o in rows[-1]])):
            rows[-1].append(b)
        else:
            rows.append([b])
    groups = sorted((sorted(r) for r in rows if len(r) >= 2), key=lambda r: -len(r))[:24]
    for kind, some in (("multi", groups), ("single", [[b] for b in sorted(bands, key=lambda b: -b[4])[:24]])):
        for group in some:
            x, y = min(b[0] for b in group), min(b[1] for b in group)
            x2, y2 = max(b[0] + b[2] for b in group), max(b[1] + b[3] for b in group)
            m = max(2, (y2 - y) // 3)
            x, y, x2, y2 = max(0, x - m), max(0, y - m), min(gray.shape[1], x2 + m), min(gray.shape[0], y2 + m)
            part = K.resize(gray[y:y2, x:x2], 32, 96)
            if polarity == "bright":
                part = 255 - part
            outline = K.resize(mask[y:y2, x:x2], 32, 96) > 0.5
            boxes = [[round((b[0] - x) * 1000 / (x2 - x)), round((b[1] - y) * 1000 / (y2 - y)), round(b[2] * 1000 / (x2 - x)), round(b[3] * 1000 / (y2 - y))] for b in group]
            yield {"kind": kind, "name": polarity, "x": x, "y": y, "width": x2 - x, "height": y2 - y, "score": score, "structure": K.standardise(part), "extra": outline.ravel().astype(np.float32).tolist(), "hashes": [K.phash(K.TRANSFORMS[t](part)) for t in K.FLIPS], "boxes": boxes}
    if max(gray.shape) >= 3 * min(gray.shape):
        tall = gray if gray.shape[0] > gray.shape[1] else gray.T
        profile = K.resize(tall, 96, 1)[:, 0]
        yield {"kind": "strip", "name": polarity, "x": 0, "y": 0, "width": gray.shape[1], "height": gray.shape[0], "score": score, "structure": K.standardise(K.resize(tall, 96, 32)), "extra": profile.tolist(), "hashes": [K.profile_hash(profile), K.profile_hash(profile[::-1])], "boxes": []}


def _geometry(a: list, b: list, flip: str) -> tuple[int, float]:
    """Bands that lie at like places, and how well they do."""
    move = lambda r: [1000 - r[0] - r[2] if flip in ("flip_horizontal", "rotate_180") else r[0], 1000 - r[1] - r[3] if flip in ("flip_vertical", "rotate_180") else r[1], r[2], r[3]]
    left, right = sorted(list(x) for x in a), sorted(move(list(x)) for x in b)
    n, near = 0, []
    for p, q in zip(left, right):
        gap = abs(p[0] + p[2] / 2 - q[0] - q[2] / 2) / 1000 + 0.5 * abs(p[2] - q[2]) / 1000
        near.append(max(0.0, 1 - 5 * gap))
        n += near[-1] >= 0.4
    return n, float(np.mean(near)) if near else 0.0


def western_check(r: dict) -> dict | None:
    if r["kind_1"] != r["kind_2"]:
        return None
    if r["kind_1"] == "strip":
        turned = [(K.correlation(r["extra_1"], e), K.correlation(r["structure_1"], s), f) for f, e, s in (("identity", r["extra_2"], r["structure_2"]), ("flip_vertical", r["extra_2"][::-1], r["structure_2"][::-1]))]
        profile, structure, flip = max(turned)
        scale = max(r["height_1"] / r["height_2"], r["height_2"] / r["height_1"])
        if not (flip != "identity" and structure >= 0.78 and profile >= 0.9 or flip == "identity" and scale >= 1.3 and structure >= 0.88 and profile >= 0.97):
            return None
        return {"kind": "strip", "transform": flip, "matched_bands": 0, "structure": structure, "background": profile, "geometry": 1.0, "mask_iou": 1.0, "confidence": 0.58 * structure + 0.42 * profile, "risk": "low"}
    found = _best_flip(r, 20, (32, 96))
    if found is None:
        return None
    structure, flip, other, _ = found
    one, two = r["extra_1"].reshape(32, 96) > 0.5, K.TRANSFORMS[flip](r["extra_2"].reshape(32, 96)) > 0.5
    iou, free = K.mask_iou(one, two), ~(one | two)
    background = K.correlation(r["structure_1"][free], other[free]) if free.sum() > 16 else 0.0
    n, geometry = _geometry(r["boxes_1"], r["boxes_2"], flip)
    counts = len(r["boxes_1"]), len(r["boxes_2"])
    if r["kind_1"] == "multi":
        if abs(counts[0] - counts[1]) > max(1, min(counts) // 2) or n < 2 or geometry < 0.58 or iou < 0.35 or structure < 0.86 or not (structure >= 0.93 or background >= 0.7):
            return None
    elif structure < 0.9 or iou < 0.38 or background < 0.55 or geometry < 0.72:
        return None
    other_page = (r["source_path_1"], r["page_1"]) != (r["source_path_2"], r["page_2"])
    if r["kind_1"] == "single":
        risk = "low"
    elif other_page and n >= 3 and structure >= 0.94 and background >= 0.82 and geometry >= 0.82:
        risk = "high"
    else:
        risk = "medium" if structure >= 0.88 and background >= 0.55 and geometry >= 0.7 or n >= 3 and structure >= 0.92 and geometry >= 0.85 else "low"
    score = 0.48 * structure + 0.24 * max(0.0, background) + 0.16 * geometry + 0.12 * iou
    return {"kind": r["kind_1"], "transform": flip, "matched_bands": n, "structure": structure, "background": background, "geometry": geometry, "mask_iou": iou, "confidence": float(np.clip(score, 0, 1)), "risk": risk}


WESTERN = "kind string, transform string, matched_bands int, structure double, background double, geometry double, mask_iou double, confidence double, risk string"


def western(decoded: DataFrame, single_bands: bool = False) -> DataFrame:
    """Pairs of blot panels (rule_id image.western_blot.panel_reuse), and strips of one row and, if wanted, single bands at low risk (image.western_blot.single_band); the best of each pair of pages."""
    found = regions(decoded, western_regions)
    found = found if single_bands else found.where("kind <> 'single'")
    parts = None
    for kind in ("multi", "single", "strip"):
        own = checked(candidates(found.where(F.col("kind") == kind), votes=2, cap=129, same_page=0.2), western_check, WESTERN)
        parts = own if parts is None else parts.unionByName(own)
    lone = F.col("kind").isin("single", "strip")
    rule = F.when(lone, "image.western_blot.single_band").otherwise("image.western_blot.panel_reuse")
    return best_of(parts.withColumns({"rule_id": rule, "risk": F.when(lone, "low").otherwise(F.col("risk"))}), ["first", "second"], [F.desc("confidence")])


# --- dot arrays ----------------------------------------------------------------------------------------------------------

DOTS = "matched_spots int, layout_error double, appearance double, profile double, least_spot double, layout double, spot_scale double, spot_rotation double, mirrored boolean, confidence double, risk string"
#: Up to so many arrays all pairs are compared; beyond, a bucket's array meets so many that came before it.
DOT_PAIRS, DOT_BUCKET = 64, 32


def dot_candidates(found: DataFrame, bucket: int | None = DOT_BUCKET, all_pairs: int = DOT_PAIRS) -> DataFrame:
    """id, id2: all pairs of few arrays; of more, those that share a signature, each with the last `bucket` arrays before it in a signature's order of ids (None: with all)."""
    ids = found.select("id")
    if found.count() <= all_pairs:
        other = ids.select(F.col("id").alias("id2"))  # a few thousand pairs at most
        return ids.join(F.broadcast(other), F.col("id") < F.col("id2"))
    keys = F.pandas_udf(lambda s: pd.Series([dots.signatures(x) for x in s]), "array<int>")("extra")
    if bucket is None:
        return banded(found.withColumn("keys", keys), F.col("keys")).select("id", "id2")
    placed = found.select("id", F.explode(keys).alias("key")).withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    later = placed.withColumn("block", F.floor(F.col("place") / bucket))
    earlier = placed.select(F.col("id").alias("earlier"), "key", F.col("place").alias("before"), F.explode(F.array(F.floor(F.col("place") / bucket), F.floor(F.col("place") / bucket) + 1)).alias("block"))
    met = later.join(earlier, ["key", "block"]).where((F.col("before") < F.col("place")) & (F.col("place") - F.col("before") <= bucket))
    return met.select(F.col("earlier").alias("id"), F.col("id").alias("id2")).distinct()


def dot_blots(decoded: DataFrame, bucket: int | None = DOT_BUCKET) -> DataFrame:
    """The best pair of spot arrays of each pair of pages."""
    found = regions(decoded, dots.regions)
    pairs = with_both(dot_candidates(found, bucket), found, [c for c in _COLUMNS if c != "id"])
    pairs = pairs.where("source_path_1 <> source_path_2 or page_1 <> page_2")
    check = lambda r: dots.compare(r["structure_1"], r["extra_1"], r["structure_2"], r["extra_2"])
    return best_of(checked(pairs, check, DOTS), ["first_page", "second_page"], [F.desc("matched_spots"), F.desc("confidence")]).withColumn("rule_id", F.lit("image.dot_blot.spot_array_reuse"))


# --- fluorescence ----------------------------------------------------------------------------------------------------------


def channel_regions(pixels: np.ndarray) -> Iterator[dict]:
    """The colour planes that carry a signal on a dark ground."""
    a = pixels.astype(float)
    if a.max() - a.min() < 24 or np.median(a) > 110:
        return
    for i, name in enumerate(("blue", "green", "red")):
        plane = a[:, :, i]
        if np.percentile(plane, 99.5) - np.median(plane) < 24 or plane.std() < 4:
            continue
        small = K.resize(plane, 96, 96)
        mask = small > max(12.0, K.otsu(small))
        if 0.002 <= mask.mean() <= 0.7:
            yield {"kind": "channel", "name": name, "x": 0, "y": 0, "width": a.shape[1], "height": a.shape[0], "score": float(plane.std()), "structure": K.standardise(small), "extra": mask.ravel().astype(np.float32).tolist(), "hashes": [K.phash(K.TRANSFORMS[t](small)) for t in K.FLIPS]}


def fluorescence_check(r: dict) -> dict | None:
    found = None
    for t in K.FLIPS:
        b, m = K.TRANSFORMS[t](r["structure_2"]), K.TRANSFORMS[t](r["extra_2"].reshape(96, 96)) > 0.5
        distance = int((K.phash(_scaled(r["structure_1"])) ^ K.phash(_scaled(b))) & (1 << 64) - 1).bit_count()
        if distance > 18 and not r["related"]:
            continue
        dy, dx, peak = K.shift_between(r["structure_1"], b)
        if max(abs(dy), abs(dx)) <= 12 and peak >= 0.05:
            b, m = np.roll(b, (dy, dx), (0, 1)), np.roll(m, (dy, dx), (0, 1))
        corr, iou, nmi = max(0.0, K.correlation(r["structure_1"], b)), K.mask_iou(r["extra_1"].reshape(96, 96) > 0.5, m), K.mutual_information(r["structure_1"], b)
        score = float(np.clip(0.58 * corr + 0.24 * iou + 0.18 * nmi, 0, 1))
        if found is None or score > found["confidence"]:
            found = {"transform": t, "first_channel": r["name_1"], "second_channel": r["name_2"], "correlation": corr, "mask_iou": iou, "mutual_information": nmi, "confidence": score}
    return found


FLUORESCENCE = "transform string, first_channel string, second_channel string, correlation double, mask_iou double, mutual_information double, confidence double"


def fluorescence(decoded: DataFrame) -> DataFrame:
    """The best pair of channels of each pair of pages, classed: a merge and its component, channels of one field, or a channel used twice."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1)
    found = regions(decoded, channel_regions).withColumn("field", field_key(stem(F.col("source_path"))))
    named = found.select("id", "field", "source_path").where("field <> ''")
    same = named.join(named.select(F.col("id").alias("id2"), "field", F.col("source_path").alias("p2")), "field").where("id < id2 and source_path <> p2").select("id", "id2", F.lit(2).cast("long").alias("votes"))
    pairs = candidates(found.drop("field"), votes=2, cap=97, more=same).join(same.select("id", "id2", F.lit(True).alias("rel")), ["id", "id2"], "left").withColumn("related", F.coalesce("rel", F.lit(False))).drop("rel")
    met = best_of(checked(pairs, fluorescence_check, FLUORESCENCE), ["first_page", "second_page"], [F.desc("confidence")])
    name = lambda c: stem(F.regexp_replace(c, r"#\d+$", ""))
    met = met.withColumns({"r1": channel_role(name(F.col("first_page"))), "r2": channel_role(name(F.col("second_page"))), "k1": field_key(name(F.col("first_page"))), "k2": field_key(name(F.col("second_page")))})
    one_field = (F.col("k1") == F.col("k2")) & F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("r1") != F.col("r2"))
    merge = (F.col("r1") == "merge") | (F.col("r2") == "merge")
    c, m, s = F.col("correlation"), F.col("mask_iou"), F.col("confidence")
    rule = (
        F.when(one_field & merge & (c >= 0.78) & (m >= 0.32) & (s >= 0.68), "image.fluorescence.merge_component")
        .when(one_field & ~merge & ((c >= 0.58) | (F.col("mutual_information") >= 0.22) | (s >= 0.5)), "image.fluorescence.same_field_channels")
        .when(~one_field & (c >= 0.88) & (m >= 0.48) & (s >= 0.78), "image.fluorescence.same_channel_reuse")
    )
    risk = F.when((rule == "image.fluorescence.same_channel_reuse") & (s >= 0.9), "medium").otherwise("low")
    return met.withColumns({"rule_id": rule, "risk": risk}).where("rule_id is not null").drop("k1", "k2").withColumnsRenamed({"r1": "first_role", "r2": "second_role"})


# --- tissue ----------------------------------------------------------------------------------------------------------------


def tissue_regions(pixels: np.ndarray) -> Iterator[dict]:
    """Windows of stained tissue on a bright ground: the whole page and three scales, those with most tissue first."""
    a = pixels.astype(float)
    spread = a.max(2) - a.min(2)
    if a.mean() < 90 or spread.mean() < 8:
        return
    tissue, gray = (spread > 22) & (a.mean(2) < 235), K.to_gray(pixels).astype(float)
    if tissue.mean() < 0.1:
        return
    h, w = gray.shape
    boxes = [(0, 0, w, h, 1.0)]
    for scale in (0.66, 0.5, 0.34):
        ww, hh = int(w * scale), int(h * scale)
        steps = lambda n, s: sorted({round(i * (n - s) / 3) for i in range(4)})
        some = [(x, y, ww, hh, scale) for y in steps(h, hh) for x in steps(w, ww)]
        boxes += sorted(some, key=lambda b: -tissue[b[1] : b[1] + b[3], b[0] : b[0] + b[2]].mean())[:12]
    for x, y, ww, hh, scale in boxes[:40]:
        share = float(tissue[y : y + hh, x : x + ww].mean())
        if share < 0.18 or min(ww, hh) < 24:
            continue
        small = K.resize(gray[y : y + hh, x : x + ww], 96, 96)
        yield {"kind": "window", "name": f"{scale:g}", "x": x, "y": y, "width": ww, "height": hh, "score": share, "structure": K.standardise(small), "extra": (K.resize(tissue[y : y + hh, x : x + ww], 96, 96) > 0.5).ravel().astype(np.float32).tolist(), "hashes": [K.phash(K.TRANSFORMS[t](small)) for t in K.FLIPS]}


def tissue_check(r: dict) -> dict | None:
    found = _best_flip(r, 20, (96, 96))
    if found is None or found[0] < 0.86:
        return None
    corr, flip, _, distance = found
    iou = K.mask_iou(r["extra_1"].reshape(96, 96) > 0.5, K.TRANSFORMS[flip](r["extra_2"].reshape(96, 96)) > 0.5)
    if iou < 0.5:
        return None
    ratio = np.sqrt(max(float(r["name_1"]), float(r["name_2"])) / min(float(r["name_1"]), float(r["name_2"])))
    return {"transform": flip, "correlation": corr, "mask_iou": iou, "hamming": distance, "window_ratio": float(ratio**2), "confidence": float(np.clip(0.66 * corr + 0.22 * iou + 0.12 * (1 - distance / 64), 0, 1))}


def pathology(decoded: DataFrame) -> DataFrame:
    """The best pair of windows of each pair of pages, classed by the magnifications in the names, else by the windows' sizes."""
    met = checked(candidates(regions(decoded, tissue_regions), votes=2, cap=129, same_page=0.1), tissue_check, "transform string, correlation double, mask_iou double, hamming int, window_ratio double, confidence double")
    best = best_of(met, ["first_page", "second_page"], [F.desc("confidence"), F.col("first"), F.col("second")])
    a, b = magnification("first_page"), magnification("second_page")
    ratio = F.coalesce(F.greatest(a, b) / F.least(a, b), F.col("window_ratio"))
    other = (ratio >= 1.45) & (F.col("first_page") != F.col("second_page"))
    rule = F.when(other, "image.pathology.same_region_different_magnification").otherwise("image.pathology.local_reuse")
    return best.withColumns({"rule_id": rule, "magnification_ratio": ratio, "first_magnification": a, "second_magnification": b, "risk": F.when(~other & (F.col("confidence") >= 0.92), "medium").otherwise("low")})


def hint(path: str) -> str | None:
    """What kind of picture a name speaks of."""
    stem = re.sub(r"[_\-.]+", " ", path.rsplit("/", 1)[-1].lower())
    for kind, pattern in (("western_blot", r"\b(wb|western|blot|actin|gapdh|tubulin)\b"), ("pathology", r"\b(he|h&e|ihc|masson|[0-9]+x)\b"), ("fluorescence", r"\b(dapi|fitc|gfp|if|merge)\b")):
        if re.search(pattern, stem):
            return kind
    return None
