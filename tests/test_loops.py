"""Kernels against loops that visit pixel by pixel, and the errors of strict operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chromagrid.operators import kernels, matching, metrics
from chromagrid.sources import catalogs

SHARES = {
    "floyd": [(1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)],
    "atkinson": [(1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)],
}


def clip(v, lo, hi):
    return min(hi, max(lo, v))


def oklab(rgb):
    lin = [c / 255 / 12.92 if c / 255 <= 0.04045 else ((c / 255 + 0.055) / 1.055) ** 2.4 for c in rgb]
    m = [[0.4122214708, 0.5363325363, 0.0514459929], [0.2119034982, 0.6806995451, 0.1073969566], [0.0883024619, 0.2817188376, 0.6299787005]]
    o = [[0.2104542553, 0.7936177850, -0.0040720468], [1.9779984951, -2.4285922050, 0.4505937099], [0.0259040371, 0.7827717662, -0.8086757660]]
    roots = [max(0.0, sum(a * b for a, b in zip(row, lin, strict=True))) ** (1 / 3) for row in m]
    return [sum(a * b for a, b in zip(row, roots, strict=True)) for row in o]


def diffused(plane, palette, method, cap=1e9, edge=None, strength=1.0, bounds=None, serpentine=False, read=None, without=()):
    """Index of each pixel, visited one by one; left to right in every row unless serpentine."""
    h, w = len(plane), len(plane[0])
    v = [[list(p) for p in row] for row in plane]
    out = [[0] * w for _ in range(h)]
    for y in range(h):
        right = not serpentine or y % 2 == 0
        for i in range(w):
            x = i if right else w - 1 - i
            own = [clip(c, *read) for c in v[y][x]] if read else v[y][x]
            ds = [sum((a - b) ** 2 for a, b in zip(own, p, strict=True)) for p in palette]
            k = out[y][x] = ds.index(min(ds))
            half = 0.5 if edge is not None and edge[y][x] else 1.0
            for c in range(3):
                e = clip(own[c] - palette[k][c], -cap, cap) * strength * half
                for dx, dy, share in SHARES[method]:
                    a, b = x + (dx if right else -dx), y + dy
                    if (dx, dy) not in without and 0 <= a < w and b < h:
                        v[b][a][c] += e * share
                        if bounds:
                            v[b][a][c] = clip(v[b][a][c], *bounds)
    return out


PLANES = st.integers(1, 6).flatmap(lambda h: st.integers(1, 6).flatmap(lambda w: st.lists(st.integers(0, 255), min_size=h * w * 3, max_size=h * w * 3).map(lambda v: np.array(v).reshape(h, w, 3))))
PALETTE = [(0, 0, 0), (250, 240, 230), (200, 40, 30), (20, 90, 180)]


@given(PLANES, st.sampled_from(["floyd", "atkinson"]), st.sampled_from([1e9, 0.1]), st.booleans(), st.sampled_from([1.0, 0.6]), st.booleans())
@settings(max_examples=120, deadline=None)
def test_serpentine_diffusion_pixel_by_pixel(rgb, method, cap, edges, strength, bounded):
    edge = rgb[..., 0] % 2 == 0 if edges else None
    bounds = (0.0, 1.0) if bounded else None
    taps = kernels.FLOYD if method == "floyd" else kernels.ATKINSON
    got = kernels.diffused(rgb / 255.0, np.array(PALETTE) / 255.0, taps, cap, edge, strength, bounds)
    want = diffused((rgb / 255.0).tolist(), (np.array(PALETTE) / 255.0).tolist(), method, cap, edge, strength, bounds, serpentine=True)
    assert got.tolist() == want


@given(PLANES, st.sampled_from(["floyd", "atkinson"]), st.sampled_from([1.0, 0.6]), st.booleans(), st.booleans())
@settings(max_examples=200, deadline=None)
def test_fronts_equal_rows_from_left_to_right(rgb, method, strength, bounded, below):
    taps = tuple(t for t in (kernels.FLOYD if method == "floyd" else kernels.ATKINSON) if below or t[:2] != (0, 1))
    read = (0.0, 255.0) if bounded else None
    got = kernels.diffused_in_rows(rgb.astype(float), np.array(PALETTE, float), taps, strength, read)
    assert got.tolist() == diffused(rgb.tolist(), PALETTE, method, strength=strength, read=read, without=() if below else [(0, 1)])


def pixels(spark, seed=3, h=9, w=11, images=2, step=40):
    rng = np.random.default_rng(seed)
    rgb = rng.integers(0, 256, (images, h, w, 3)) // step * step
    rows = [(i, y, x, *map(int, rgb[i, y, x])) for i in range(images) for y in range(h) for x in range(w)]
    return rgb, spark.createDataFrame(rows, "img int, y int, x int, r int, g int, b int")


def indices(df, shape):
    out = np.full(shape, -1)
    for r in df.collect():
        out[r.img, r.y, r.x] = r.idx
    return out.tolist()


@pytest.mark.parametrize("method", ["floyd", "atkinson"])
def test_dithering_in_oklab_pixel_by_pixel(spark, method):
    rgb, px = pixels(spark)
    want = [diffused([[oklab(p) for p in row] for row in plane.tolist()], [oklab(p) for p in PALETTE], method) for plane in rgb]
    assert indices(kernels.dithered(px.withColumn("edge", px.x > 3), PALETTE, method, "oklab"), rgb.shape[:3]) == want
    back = {(r.img, r.y, r.x): (r.r, r.g, r.b) for r in kernels.dither(px, PALETTE, method).collect()}
    assert all(back[i, y, x] == PALETTE[want[i][y][x]] for i, y, x in np.ndindex(rgb.shape[:3]))


def test_dithering_with_strength_pixel_by_pixel(spark):
    rgb, px = pixels(spark)
    for strength, drop in ((0.4, False), (1.0, True)):
        want = [diffused(plane.tolist(), PALETTE, "floyd", strength=strength, read=(0, 255), without=[(0, 1)] * drop) for plane in rgb]
        assert indices(kernels.dithered(px, PALETTE, strength=strength, drop_below=drop), rgb.shape[:3]) == want
    assert indices(kernels.dithered(px, PALETTE, strength=0.0), rgb.shape[:3]) == indices(kernels.dithered(px, PALETTE, "none"), rgb.shape[:3])


def test_dithering_by_a_callable_of_the_palette(spark):
    rgb, px = pixels(spark)
    px = px.withColumn("edge", px.y % 3 == 0)
    nearest = lambda *v: min(PALETTE, key=lambda p: sum((a - b / 255.0) ** 2 for a, b in zip(v, p, strict=True)))
    got = {(r.img, r.y, r.x): (r.r, r.g, r.b) for r in kernels.dithered_by(px, nearest).collect()}
    edge = [[y % 3 == 0] * rgb.shape[2] for y in range(rgb.shape[1])]
    for i, plane in enumerate(rgb):
        want = diffused((plane / 255.0).tolist(), (np.array(PALETTE) / 255.0).tolist(), "floyd", 0.67, edge, bounds=(0.0, 1.0), serpentine=True)
        assert all(got[i, y, x] == PALETTE[want[y][x]] for y in range(len(want)) for x in range(len(want[0])))


def test_no_dither_gives_the_image_back(spark):
    _, px = pixels(spark)
    assert sorted(kernels.dither(px, PALETTE).collect()) == sorted(px.collect())
    with pytest.raises(ValueError, match="no method"):
        kernels.dither(px, PALETTE, "bayer")


def test_ordered_dither_pixel_by_pixel(spark):
    seed, tile = 1234567, []
    for _ in range(4096):
        seed = (seed * 1664525 + 1013904223) % 2**32
        tile.append((seed // 256 % 65536) / 65535)
    for _ in range(2):
        for y in range(64):
            for x in range(64):
                near = [tile[(y + a) % 64 * 64 + (x + b) % 64] for a in range(-2, 3) for b in range(-2, 3) if a or b]
                tile[y * 64 + x] = clip(0.7 * tile[y * 64 + x] + 0.3 * (1 - sum(near) / 24), 0.0, 1.0)
    assert np.allclose(kernels.ordered_tile(), np.array(tile).reshape(64, 64))
    _, px = pixels(spark, h=5, w=70, images=1, step=1)
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in kernels.ordered(px).collect()}
    for r in px.collect():
        rgb = [r.r / 255, r.g / 255, r.b / 255]
        lum = 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]
        to = clip(lum + (tile[(r.y & 63) * 64 + (r.x & 63)] - 0.5) * 0.28 * 0.1, 0.0, 1.0)
        assert got[r.y, r.x] == tuple(int(clip(c * to / lum if lum > 1e-6 else c, 0, 1) * 255 + 0.5) for c in rgb)


def test_singles_cell_by_cell():
    rng = np.random.default_rng(5)
    for _ in range(200):
        idx = rng.integers(0, 5, (int(rng.integers(1, 9)), int(rng.integers(1, 9))))
        v = idx.tolist()
        for _ in range(2):
            for y in range(1, len(v) - 1):
                for x in range(1, len(v[0]) - 1):
                    near = [v[b][a] for b in (y - 1, y, y + 1) for a in (x - 1, x, x + 1) if (a, b) != (x, y)]
                    counts = sorted((-near.count(c), c) for c in set(near))
                    if v[y][x] not in near and counts and counts[0][0] <= -2:
                        v[y][x] = counts[0][1]
        assert kernels.singles_cleaned(idx).tolist() == v


def test_k_means_pixel_by_pixel(spark):
    rgb, px = pixels(spark)
    labs, first = [], {}
    for i, y, x in np.ndindex(rgb.shape[:3]):
        c = tuple(int(v) for v in rgb[i, y, x])
        labs.append(oklab(c))
        first.setdefault(c, [oklab(c), 0])[1] += 1
    rng, centers = np.random.default_rng(1), []
    for i in range(4):
        mass = [n * (min(sum((a - b) ** 2 for a, b in zip(lab, c, strict=True)) for c in centers) if centers else 1.0) for lab, n in first.values()]
        share, run = 0.5 if i == 0 else float(rng.random()), 0.0
        for (lab, _), m in zip(first.values(), mass, strict=True):
            run += m
            if run >= share * sum(mass):
                centers.append(lab)
                break
    assert np.allclose(kernels.spread_start(kernels.counted_colors(px), 4), centers)
    for _ in range(6):
        groups = [[] for _ in centers]
        for lab in labs:
            ds = [sum((a - b) ** 2 for a, b in zip(lab, c, strict=True)) for c in centers]
            groups[ds.index(min(ds))].append(lab)
        centers = [[sum(v) / len(g) for v in zip(*g, strict=True)] if g else c for g, c in zip(groups, centers, strict=True)]
    assert np.allclose(kernels.k_means(px, 4), centers, atol=1e-9)


def grown(labs, imp, centers, most, rounds, least_gain, apart):
    """Growth cell by cell: labs (n, 3), imp (n)."""
    nearest = lambda cs: ((labs[:, None] - cs[None]) ** 2).sum(axis=2).argmin(axis=1)
    assign, before, gains = nearest(centers), None, []
    for _ in range(rounds):
        if len(centers) >= most:
            break
        cost = [(imp[assign == c] * ((labs[assign == c] - centers[c]) ** 2).sum(axis=1)).sum() / max(1, (assign == c).sum()) for c in range(len(centers))]
        worst = int(np.argmax(cost))
        mine = assign == worst
        centers = np.vstack([centers, (labs[mine] * imp[mine, None]).sum(axis=0) / imp[mine].sum()])
        pair = [worst, len(centers) - 1]
        side = ((labs[:, None] - centers[pair][None]) ** 2).sum(axis=2).argmin(axis=1)
        for i, c in enumerate(pair):
            if (side == i).any():
                centers[c] = (labs[side == i] * imp[side == i, None]).sum(axis=0) / imp[side == i].sum()
        assign = nearest(centers)
        error = (imp * ((labs - centers[assign]) ** 2).sum(axis=1)).sum()
        centers = kernels.pushed_apart(centers, apart)
        gains.append(1.0 if before is None else before - error)
        before = error
        if np.mean(gains[-5:]) < least_gain:
            break
    return centers


@pytest.mark.parametrize(("weighted", "least_gain", "apart"), [(False, -1.0, 0.0), (True, -1.0, 0.2), (True, 0.5, 0.05)])
def test_a_grown_palette_cell_by_cell(spark, weighted, least_gain, apart):
    rgb, px = pixels(spark)
    labs = np.array([oklab(p) for p in rgb.reshape(-1, 3).tolist()])
    imp = np.where((np.arange(len(labs)) % rgb.shape[2]) % 3 == 0, 1.6, 0.9) if weighted else np.ones(len(labs))
    weight = F.when(F.col("x") % 3 == 0, 1.6).otherwise(0.9) if weighted else None
    start = np.array([oklab(p) for p in PALETTE[:2]])
    got = kernels.grown_palette(px, most=6, least_gain=least_gain, apart=apart, weight=weight, centers=start)
    assert np.allclose(got, grown(labs, imp, start, 6, 64, least_gain, apart), atol=1e-9)
    assert len(got) == 6 or least_gain > 0


def test_a_start_by_oversampling_takes_as_many_jobs_for_any_number_of_centers(spark):
    rgb, px = pixels(spark, h=20, w=30, step=9)
    labs = np.array([oklab(p) for p in rgb.reshape(-1, 3).tolist()])
    error = lambda cs: ((labs[:, None] - cs[None]) ** 2).sum(axis=2).min(axis=1).sum()
    colors = kernels.counted_colors(px).cache()
    colors.count()
    jobs, errors = [], []
    for k in (4, 24):
        spark.sparkContext.setJobGroup(f"start-{k}", "")
        centers = kernels.oversampled_start(colors, k)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"start-{k}")))
        errors.append(error(centers))
        assert len(centers) == k and (centers == kernels.oversampled_start(colors, k)).all()
    spark.sparkContext.setJobGroup("", "")
    assert jobs[1] <= jobs[0] + 4  # adaptive plans take a job more or less
    assert errors[1] < errors[0] and errors[1] < 2 * error(kernels.k_means(px, 24))
    assert error(kernels.k_means(px, 24, oversample=True)) < errors[1]


def test_merged_colors_one_by_one():
    rng = np.random.default_rng(2)
    palette = [tuple(int(v) for v in c) for c in rng.integers(100, 140, (60, 3))]
    heads, members = [], []
    for c in palette:
        near = [i for i, h in enumerate(heads) if sum((a - b) ** 2 for a, b in zip(oklab(c), oklab(h), strict=True)) ** 0.5 < 0.02]
        if near:
            members[near[0]].append(c)
        else:
            heads.append(c)
            members.append([c])
    assert kernels.merged_colors(palette, 0.02) == [tuple(sum(v) // len(m) for v in zip(*m, strict=True)) for m in members]
    assert 1 < len(heads) < 60


def test_remap_errors(spark):
    px = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 1, 1)], "img int, y int, x int, idx int")
    lut = lambda *to: spark.createDataFrame(list(enumerate(to)), "idx int, to int")
    assert sorted(r.idx for r in matching.remapped(px, lut(1, 0), 2, 2).collect()) == [0, 1]
    with pytest.raises(ValueError, match="legend of 3"):
        matching.remapped(px, lut(0, 1), 2, 3)
    with pytest.raises(Exception, match="out of range: 1"):
        matching.remapped(px, lut(0), 1, 1).collect()
    with pytest.raises(Exception, match="collapse in image 1"):
        matching.remapped(px, lut(5, 5), 2, 2).collect()


def test_catalog_errors(spark):
    docs = spark.createDataFrame([("p/Abc.json", '{"id":"x","colors":[]}'), ("p/abc.json", '{"id":"y","colors":[{"code":"1","rgb":"000000"}]}')], "path string, json string")
    with pytest.raises(Exception, match="empty palette of brand X"):
        catalogs.strict_colors(catalogs.catalogs(docs)).collect()
    found = lambda brand: catalogs.resolved_path(docs, brand, strict=True).first().path
    assert (found("ABC"), found("aBC"), found("X")) == ("p/abc.json", "p/abc.json", "p/Abc.json")
    with pytest.raises(Exception, match="no file of brand dmc; tried dmc, DMC, Dmc; at hand: p/Abc.json, p/abc.json"):
        found("dmc")


def test_element_at_a_place_of_the_sorted_list(spark):
    rng = np.random.default_rng(4)
    lists = {1: rng.random(400), 2: np.zeros(50), 3: np.array([0.25]), 4: np.round(rng.random(300) * 1e-4, 6), 5: np.repeat([0.1, 0.2], [19, 1])}
    px = spark.createDataFrame([(i, float(v)) for i, vs in lists.items() for v in vs], "img int, v double")
    got = {r.img: r["at"] for r in metrics.at_place(px, "v", 0.95).collect()}
    assert got == {i: sorted(vs)[min(int(len(vs) * 0.95), len(vs) - 1)] for i, vs in lists.items()}
    assert metrics.at_place(px.where("false"), "v", 0.95).count() == 0
