"""TIFF pages, geometric models and multi-scale corners on generated pixels."""

import struct
import zlib

import numpy as np
import pytest

from echotrace.vision import kernels as K, pages, scan, tiff

from .test_vision import decoded, texture


def pack_lzw(data):
    """The encoder: codes of growing width, the table cleared when it is full."""
    bits, out = 0, []

    def put(code, width):
        nonlocal bits
        out.append(format(code, f"0{width}b"))

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    n = 258
    put(256, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = n
        n += 1
        if n == 4094:
            put(256, width)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        elif n >= 1 << width:
            width += 1
        word = c
    put(table[word], width)
    put(257, width + (n + 1 >= 1 << width and width < 12))
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def pack_bits(data):
    out, i = b"", 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n]) + data[i : i + 1]
        else:
            while n < 128 and i + n < len(data) and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return out


PACK = {1: bytes, 5: pack_lzw, 8: zlib.compress, 32946: zlib.compress, 32773: pack_bits}


def write_tiff(images, order="<", packing=1, predictor=1, tile=None, strip=16, apart=False, bits=None, meaning=None, table=None):
    """A TIFF file of pages (height x width x RGB or gray)."""
    body, links = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 0)), 4
    for a in images:
        a = a[:, :, None] if a.ndim == 2 else a
        h, w, s = a.shape
        depth = bits or 8 * a.dtype.itemsize

        def raw(part):
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            if depth < 8:
                rows = np.unpackbits(part.astype(np.uint8)[..., None], axis=3)[..., 8 - depth :].reshape(part.shape[0], -1)
                return np.packbits(rows, axis=1).tobytes()
            return part.astype(part.dtype.newbyteorder(order)).tobytes()

        pieces = []
        for plane in [a[:, :, i : i + 1] for i in range(s)] if apart else [a]:
            if tile:
                full = np.pad(plane, ((0, -h % tile), (0, -w % tile), (0, 0)))
                pieces += [full[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
            else:
                pieces += [plane[y : y + strip] for y in range(0, h, strip)]
        places, sizes = [], []
        for p in pieces:
            data = PACK[packing](raw(p))
            places.append(len(body))
            sizes.append(len(data))
            body += data
        fields = {256: [w], 257: [h], 258: [depth] * s, 259: [packing], 262: [(2 if s >= 3 else 1) if meaning is None else meaning], 277: [s], 284: [2 if apart else 1], 317: [predictor]}
        fields |= {322: [tile], 323: [tile], 324: places, 325: sizes} if tile else {273: places, 278: [strip], 279: sizes}
        if table is not None:
            fields[320] = table
        rows = b""
        for tag, values in sorted(fields.items()):
            kind = 3 if tag in (258, 259, 262, 277, 284, 317, 320) else 4
            data = struct.pack(f"{order}{len(values)}{'HI'[kind - 3]}", *values)
            if len(data) > 4:
                body += data
                data = struct.pack(f"{order}I", len(body) - len(data))
            rows += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        body[links : links + 4] = struct.pack(f"{order}I", len(body))
        body += struct.pack(f"{order}H", len(fields)) + rows
        links = len(body)
        body += bytes(4)
    return bytes(body)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("packing", PACK)
@pytest.mark.parametrize("form", [{}, {"tile": 16}, {"predictor": 2}, {"apart": True}, {"tile": 32, "predictor": 2, "apart": True}])
def test_tiff_pages(order, packing, form):
    rng = np.random.default_rng(packing)
    gray = texture(37, 53)
    colour = np.stack([gray, gray[::-1], rng.integers(0, 256, gray.shape, np.uint8)], axis=2)
    deep = (gray.astype(np.uint16) * 257 + rng.integers(0, 50, gray.shape)).clip(0, 65535).astype(np.uint16)
    alpha = np.concatenate([colour, np.full((37, 53, 1), 9, np.uint8)], axis=2)
    got = list(tiff.pages(write_tiff([gray, colour, deep, alpha], order, packing, **form)))
    assert [(a.dtype, a.shape[2]) for a in got] == [(np.uint8, 1), (np.uint8, 3), (np.uint16, 1), (np.uint8, 4)]
    assert (got[0][:, :, 0] == gray).all() and (got[1] == colour[:, :, ::-1]).all() and (got[2][:, :, 0] == deep).all() and (got[3] == alpha[:, :, [2, 1, 0, 3]]).all()


def test_small_samples_and_colour_tables():
    bits = (texture(20, 30) > 60).astype(np.uint8)
    assert (next(tiff.pages(write_tiff([bits], bits=1)))[:, :, 0] == 255 * bits).all()
    assert (next(tiff.pages(write_tiff([bits], bits=1, meaning=0, packing=32773)))[:, :, 0] == 255 * (1 - bits)).all()
    few = (texture(20, 30) // 16).astype(np.uint8)
    table = np.random.default_rng(1).integers(0, 65536, (3, 16))
    got = next(tiff.pages(write_tiff([few], bits=4, meaning=3, table=table.ravel().tolist())))
    assert (got == (table >> 8)[::-1, few].transpose(1, 2, 0)).all()


def test_long_lzw_strips_clear_their_table():
    a = np.random.default_rng(3).integers(0, 256, (120, 200), np.uint8)
    assert (next(tiff.pages(write_tiff([a], packing=5, strip=120)))[:, :, 0] == a).all()


def test_broken_tiffs(spark, tmp_path):
    whole = write_tiff([texture(40, 40), texture(40, 40, seed=2)], packing=8)
    looped = bytearray(whole)
    looped[-4:] = whole[4:8]
    for broken in (b"", b"II", whole[:-100], bytes(looped), whole[:8] + b"\xff" * 20 + whole[28:], write_tiff([texture(8, 8)])[:60]):
        with pytest.raises(ValueError):
            list(tiff.pages(broken))
    (tmp_path / "two.tif").write_bytes(whole)
    (tmp_path / "loop.tiff").write_bytes(bytes(looped))
    (tmp_path / "deep.TIF").write_bytes(write_tiff([texture(40, 40).astype(np.uint16) * 200]))
    (tmp_path / "second.png").write_bytes(K.png(K.to_bgr(texture(40, 40, seed=2))))
    found, errors = scan.scan(spark, str(tmp_path))
    assert {r.source_path.rsplit("/", 1)[-1] for r in errors.collect()} == {"loop.tiff"}
    equal = found.where("rule_id = 'image.pixel.sha256'").collect()
    named = [sorted((x.source_path.rsplit("/", 1)[-1], x.coordinate) for x in r.locations) for r in equal]
    assert sorted(named) == [[("loop.tiff", "page 1"), ("two.tif", "page 1")], [("loop.tiff", "page 2"), ("second.png", "page 1"), ("two.tif", "page 2")]]
    deep = [r for r in pages.images(spark, str(tmp_path)).collect() if r.source_path.endswith("TIF")][0]
    a = pages.array_of(deep.data, deep.height, deep.width, deep.channels)
    assert a.dtype == np.uint16 and K.to_gray(a).max() == 255 and K.thumbnail(a)[:4] == b"\x89PNG"


# --- geometric models -------------------------------------------------------------------------------------------------------


def view(h, p):
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


TILT = np.array([[0.9, 0.12, 15], [-0.08, 1.1, 22], [4e-4, 3e-4, 1]])


@pytest.mark.parametrize("seed", range(4))
def test_homographies_are_found_among_strays(seed):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 400, (60, 2))
    q = view(TILT, p) + rng.normal(0, 0.2, p.shape)
    stray = rng.random(60) < 0.35
    q[stray] = rng.uniform(0, 500, (stray.sum(), 2))
    model, fit = K.homography_model(p, q, 3.0)
    assert (fit[~stray]).all() and fit[stray].sum() <= 2
    assert np.abs(K.project(model, p[~stray]) - view(TILT, p[~stray])).max() < 1
    name, _, inside, error = K.local_model(p, q, 3.0)
    assert name == "homography" and inside.sum() >= (~stray).sum() and error < 1


def test_exact_correspondences_equal_a_plain_solution():
    """Against the eight equations of four points, solved as they stand, over all samples of four."""
    rng = np.random.default_rng(9)
    p = rng.uniform(0, 200, (9, 2))
    q = view(TILT, p)
    q[7] += 40
    best = 0
    from itertools import combinations

    for four in combinations(range(9), 4):
        x, u = p[list(four)], q[list(four)]
        a = np.array([r for (s, t), (m, n) in zip(x, u) for r in ([s, t, 1, 0, 0, 0, -m * s, -m * t], [0, 0, 0, s, t, 1, -n * s, -n * t])])
        h = np.append(np.linalg.solve(a, u.ravel()), 1).reshape(3, 3)
        best = max(best, int((np.linalg.norm(view(h, p) - q, axis=1) < 1).sum()))
    model, fit = K.homography_model(p, q, 1.0)
    assert fit.sum() == best == 8 and np.allclose(model, TILT, atol=1e-6)


def test_a_similarity_is_kept_where_it_explains_as_much():
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 300, (40, 2))
    turn = 0.8 * np.array([[np.cos(0.4), -np.sin(0.4)], [np.sin(0.4), np.cos(0.4)]])
    name, model, fit, _ = K.local_model(p, p @ turn.T + [3, 9], 3.0)
    assert name == "similarity" and fit.all() and np.allclose(K.scales(model, 50, 60), (0.8, 0.8, np.degrees(0.4)))
    mirrored = p * [-1, 1] + [300, 0]
    assert K.local_model(p, mirrored, 3.0)[0] == "similarity"


def test_samples_that_settle_nothing():
    line = np.c_[np.arange(30.0), 2 * np.arange(30.0)]
    model, fit = K.homography_model(line, line * 1.5, 2.0)
    assert model is None and not fit.any()
    assert K.homography_model(line[:3], line[:3])[0] is None and K.fitted_homography(line, line) is None
    assert K.local_model(np.zeros((0, 2)), np.zeros((0, 2)), 3.0) is None
    folded = np.random.default_rng(1).uniform(0, 100, (12, 2))
    other = folded.copy()
    other[::2, 0] *= -1  # half of the plane turned over: no view of it
    assert K.homography_model(folded, other, 0.5)[1].sum() < 12


def test_scales_of_a_tilted_plane():
    x, y, step = 120.0, 80.0, 1e-4
    at = view(TILT, np.array([[x + step, y], [x - step, y], [x, y + step], [x, y - step]]))
    want = np.hypot(*(at[0] - at[1])) / (2 * step), np.hypot(*(at[2] - at[3])) / (2 * step)
    assert np.allclose(K.scales(TILT, x, y)[:2], want, rtol=1e-4)
    assert K.box_of(np.array([[3.2, 4.9], [10.1, 6.0]]), 12, 20) == (3, 4, 9, 3) and K.box_of(np.array([[50.0, -4.0]]), 12, 20) == (11, 0, 1, 1)


def warp(a, h):
    """The picture as seen under h, sampled linearly."""
    back = np.linalg.inv(h)
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    p = view(back, np.c_[x.ravel(), y.ravel()].astype(float))
    p = np.clip(p, 0, [a.shape[1] - 1.001, a.shape[0] - 1.001])
    i, f = np.floor(p).astype(int), p - np.floor(p)
    at = lambda dy, dx: a[i[:, 1] + dy, i[:, 0] + dx].astype(float)
    top, low = (at(d, 0) * (1 - f[:, 0]) + at(d, 1) * f[:, 0] for d in (0, 1))
    return (top * (1 - f[:, 1]) + low * f[:, 1]).reshape(a.shape).astype(np.uint8)


def test_a_tilted_copy_is_found(spark):
    """Strong perspective, over which no similarity holds."""
    whole = texture(420, 520, seed=4, n=350)
    tilt = np.array([[0.95, 0.05, 10], [-0.03, 1.0, 12], [5e-4, 2e-4, 1]])
    found = pages.page_features(decoded(spark, {"a.png": whole, "b.png": warp(whole, tilt), "c.png": texture(420, 520, seed=77, n=350)})).cache()
    got = pages.local_pairs(found, pages.descriptor_votes(found)).collect()
    assert [(r.first, r.second, r.model) for r in got] == [("a.png#1", "b.png#1", "homography")]
    assert got[0].inliers >= 12 and got[0].first_region.width > 150 and got[0].coverage_first > 0.2


# --- corners ----------------------------------------------------------------------------------------------------------------


def test_corners_equal_a_plain_segment_test():
    a = texture(40, 44, seed=6)
    got = K.fast(a, 10)
    for y in range(40):
        for x in range(44):
            want = False
            if 3 <= y < 37 and 3 <= x < 41:
                ring = [int(a[y + dy, x + dx]) - int(a[y, x]) for dx, dy in K._CIRCLE]
                want = any(all(sign * ring[(i + k) % 16] > 10 for k in range(9)) for i in range(16) for sign in (1, -1))
            assert got[y, x] == want
    assert not K.fast(a[:5]).any()


def test_equalising_by_tiles():
    rng = np.random.default_rng(2)
    dim = (100 + 10 * rng.random((160, 200)) + np.linspace(0, 60, 200)).astype(np.uint8)
    out = K.clahe(dim)
    assert out.shape == dim.shape and out.std() > 1.3 * (dim - np.linspace(0, 60, 200)).std()
    flat = np.full((64, 64), 77, np.uint8)
    assert np.ptp(K.clahe(flat)) == 0 and K.clahe(np.zeros((3, 5), np.uint8)).shape == (3, 5)
    one = K.clahe(dim[:64, :64], tiles=1, clip=1e9)  # a single tile without a limit is plain equalising
    counts = np.cumsum(np.bincount(dim[:64, :64].ravel(), minlength=256)) * 255 / 64**2
    assert np.abs(one - counts[dim[:64, :64]]).max() <= 1


@pytest.mark.parametrize("scale", [0.5, 0.7, 1.0, 1.4, 2.0])
def test_halves_match_at_other_scales(spark, scale):
    whole = texture(600, 800, seed=11, n=500)
    left, right = whole[:, :560], whole[:, 240:]
    size = round(right.shape[0] * scale), round(right.shape[1] * scale)
    other = np.clip(np.rint(K.resize(right, *size)), 0, 255).astype(np.uint8)
    found = pages.page_features(decoded(spark, {"a.png": left, "b.png": other})).cache()
    assert {p[2] for p in found.where("source_path = 'a.png'").first().points} == set(range(K.LEVELS))
    got = pages.local_pairs(found, pages.descriptor_votes(found)).collect()
    assert len(got) == 1 and got[0].scale == pytest.approx(1 / scale, rel=0.05) and abs(got[0].rotation) < 3


def test_thumbnails_join_only_pairs_with_near_hashes(spark):
    from echotrace.vision import pages

    thumb = [float(i % 7) for i in range(4096)]
    name = ("identity", "rotate_90", "rotate_180", "rotate_270", "flip_horizontal", "flip_vertical", "transpose", "transverse")
    prints = lambda p, d: [(t, p if i == 0 else ~p, d if i == 0 else ~d) for i, t in enumerate(name)]
    rows = [(f"p{k}", 1, 64, 64, thumb, 9.0, prints((k // 2) * 0x0F0F0F0F0F0F0F00, 5), None) for k in range(4)]  # p0, p1 are alike, p2, p3 are; all share bytes
    kinds = "source_path string, page int, width int, height int, thumbnail array<float>, standard_deviation double, fingerprints array<struct<transform: string, phash: bigint, dhash: bigint>>, error string"
    found = pages.perceptual_pairs(spark.createDataFrame(rows, kinds))
    assert sorted((r.first, r.second, r.transform, r.phash_distance) for r in found.collect()) == [("p0#1", "p1#1", "identity", 0), ("p2#1", "p3#1", "identity", 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    meeting = [x for x in plan.splitlines() if "Join Inner" in x and "key" in x]
    assert len(meeting) == 1 and "bit_count" in meeting[0]
