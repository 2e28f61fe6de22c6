"""Sequential kernels and index maps against plain loops."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromagrid.operators import kernels, topology
from chromagrid.sources import catalogs, sinks


def planes(most=4, size=7):
    return st.integers(2, size).flatmap(lambda h: st.integers(2, size).flatmap(lambda w: st.lists(st.integers(0, most - 1), min_size=h * w, max_size=h * w).map(lambda v: np.array(v).reshape(h, w))))


def flood(idx):
    h, w = idx.shape
    out, n = -np.ones((h, w), int), 0
    for y in range(h):
        for x in range(w):
            if out[y, x] < 0:
                stack = [(y, x)]
                out[y, x] = y * w + x
                while stack:
                    a, b = stack.pop()
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < h and 0 <= d < w and out[c, d] < 0 and idx[c, d] == idx[a, b]:
                            out[c, d] = y * w + x
                            stack.append((c, d))
                n += 1
    return out


@given(planes())
@settings(max_examples=150, deadline=None)
def test_labels_equal_flood_fill(idx):
    assert (topology.labels(idx) == flood(idx)).all()


def cleaned(idx, below, full):
    lab = flood(idx)
    h, w = idx.shape
    want = idx.copy()
    for k in np.unique(lab):
        cells = np.argwhere(lab == k)
        if len(cells) < below:
            votes = {}
            for y, x in cells:
                for c, d in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= c < h and 0 <= d < w and idx[c, d] != idx[y, x] and (full or lab[c, d] > k):
                        votes[idx[c, d]] = votes.get(idx[c, d], 0) + 1
            if votes:
                want[lab == k] = min(votes, key=lambda c: (-votes[c], c & 7, c))
    return want


def spiral(n):
    """A winding corridor of ones: one area through all tiles."""
    out, y, x, dy, dx = np.zeros((n, n), int), 0, 0, 0, 1
    out[0, 0] = 1
    free = lambda y, x: 0 <= y < n and 0 <= x < n and not out[y, x]
    while True:
        ahead = free(y + dy, x + dx) and (not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n) or not out[y + 2 * dy, x + 2 * dx])
        if not ahead:
            dy, dx = dx, -dy
            if not (free(y + dy, x + dx) and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and out[y + 2 * dy, x + 2 * dx])):
                return out
        y, x = y + dy, x + dx
        out[y, x] = 1


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(6)
    return [spiral(17), np.zeros((9, 12), int), np.arange(6).reshape(2, 3), np.indices((8, 9)).sum(axis=0) % 2] + [rng.integers(0, int(rng.integers(2, 5)), tuple(rng.integers(1, 14, 2))) for _ in range(25)]


def frame(spark, images):
    return spark.createDataFrame([(i, y, x, int(m[y, x])) for i, m in enumerate(images) for y, x in np.ndindex(m.shape)], "img int, y int, x int, idx int")


@pytest.mark.parametrize("tile", [4, 1024])
def test_areas_over_tiles_equal_flood_fill(spark, images, tile):
    assert (spiral(17) == 1).sum() > 100 and len(np.unique(flood(spiral(17))[spiral(17) == 1])) == 1
    got = [np.full(m.shape, -1) for m in images]
    for r in topology.components(frame(spark, images), tile).collect():
        got[r.img][r.y, r.x] = (r.label >> 32) * images[r.img].shape[1] + (r.label & 0xFFFFFFFF)
    assert all((g == flood(m)).all() for g, m in zip(got, images, strict=True))


@pytest.mark.parametrize(("tile", "below", "full"), [(4, 3, False), (5, 4, True), (1024, 2, False)])
def test_islands_follow_reading_order(spark, images, tile, below, full):
    got = [np.full(m.shape, -1) for m in images]
    for r in topology.islands(frame(spark, images), below, full, tile).collect():
        got[r.img][r.y, r.x] = r.idx
    assert all((g == cleaned(m, below, full)).all() for g, m in zip(got, images, strict=True))


def test_no_cells_no_areas(spark, images):
    assert topology.islands(frame(spark, images).where("false"), 3).count() == 0


def test_error_diffusion_keeps_the_mean_and_visits_all_rows():
    plane = np.full((16, 16, 3), 0.25)
    out = kernels.diffused(plane, np.array([[0.0] * 3, [1.0] * 3]))
    assert abs(out.mean() - 0.25) < 0.05
    bright = kernels.diffused(plane + 0.5, np.array([[0.0] * 3, [1.0] * 3]))
    assert (bright.sum(axis=1) > 0).all()
    skipped = kernels.diffused(plane + 0.5, np.array([[0.0] * 3, [1.0] * 3]), mirror_rows=True)
    assert (skipped[1::2] == 0).all()


def test_singles_are_cleaned_in_place():
    idx = np.zeros((5, 5), int)
    idx[2, 2] = idx[0, 0] = 3
    got = kernels.singles_cleaned(idx)
    assert got[2, 2] == 0 and got[0, 0] == 3  # a cell of the border stays


def test_centers_are_pushed_apart():
    c = kernels.pushed_apart(np.array([[0.5, 0.0, 0.0], [0.51, 0.0, 0.0]]), 0.05)
    assert np.linalg.norm(c[0] - c[1]) > 0.01


def test_symbols():
    assert kernels.unique_symbols(["a", "a", "b"], "abcd") == ["a", "c", "b"]
    assert kernels.set_symbol({"x": "a", "y": "b"}, "x", "b", "abc") == {"x": "b", "y": "c"}
    assert kernels.smart_symbols([("p", 0.9, 1), ("q", 0.1, 9)], "D", "O", "X", "z") == {"q": "O", "p": "D"}


def test_ordered_tile_is_fixed():
    t = kernels.ordered_tile()
    assert t.shape == (64, 64) and 0 <= t.min() and t.max() <= 1
    assert (t == kernels.ordered_tile()).all()


def index_files(spark, content, w=2, h=2):
    return spark.createDataFrame([(1, w, h, bytearray(content))], "img bigint, w int, h int, content binary")


@pytest.mark.parametrize(("content", "want"), [(b"\1\2\3\4", [1, 2, 3, 4]), (b"\1\0\2\0\3\0\0\1", [1, 2, 3, 256]), (b"\1\0\0\0" * 4, [1] * 4)])
def test_index_maps_of_one_two_and_four_bytes(spark, content, want):
    rows = catalogs.index_map(index_files(spark, content)).orderBy("y", "x").collect()
    assert [r.idx for r in rows] == want


def test_index_map_of_another_length_is_an_error(spark):
    with pytest.raises(Exception, match="index map"):
        catalogs.index_map(index_files(spark, b"\1\2\3")).collect()
    assert catalogs.index_map(index_files(spark, b"\1\2\3\4\5"), lenient=True).count() == 4


def test_index_bytes_are_clamped(spark):
    px = spark.createDataFrame([(1, 0, 0, 5), (1, 0, 1, -1)], "img int, y int, x int, idx int")
    assert bytes(sinks.index_bytes(px, 3).first().content) == b"\2\0"


def test_callable_and_plain_nearest_agree(spark):
    px = spark.createDataFrame([(1, y, x, 40 * y, 30 * x, 90) for y in range(4) for x in range(5)], "img int, y int, x int, r int, g int, b int")
    pal = [(0, 0, 90), (120, 120, 90)]
    a = kernels.dithered(px, pal, "none").orderBy("y", "x").collect()
    b = kernels.dithered(px, pal, "none", nearest=lambda r, g, _: (((r - 120) ** 2 + (g - 120) ** 2) < (r**2 + g**2)).astype(int)).orderBy("y", "x").collect()
    assert [r.idx for r in a] == [r.idx for r in b]


def test_symbols_of_every_image(spark, sf_dir):
    from chromagrid.operators import matching
    from chromagrid.plans import palettes, planes
    from chromagrid.sources import rasters

    got = palettes.QUERIES["q17_q18_q20_symbols"](spark, sf_dir).collect()
    want = matching.thread_statistics(planes.f1(spark, sf_dir), rasters.swatches(spark, sf_dir), limit=10**6).collect()
    assert sorted((r.img, r.code) for r in got) == sorted((r.img, r.code) for r in want)
    assert len({r.img for r in got}) > 1 and len({(r.img, r.unique) for r in got}) == len(got)


def test_edge_energy_equals_a_plain_loop(spark):
    """The loop as described: the cell before is remembered at the end of each step."""
    import random

    from pyspark.sql import functions as F

    from chromagrid.operators import metrics, stencils

    rng, w, h = random.Random(8), 9, 7
    luma = [[rng.randrange(256) / 255 for _ in range(w)] for _ in range(h)]
    energy = ring = extremes = 0.0
    for y in range(1, h - 1):
        before = luma[y][0]
        for x in range(1, w - 1):
            now = luma[y][x]
            energy += abs(now - before)
            if x > 1 and (luma[y][x - 1] - now) * (before - luma[y][x - 1]) > 0:
                ring += 0.5
            if x > 1 and (luma[y][x - 1] - now) * (luma[y][x - 1] - luma[y][x - 2]) > 0:
                extremes += 0.5
            before = now
    px = spark.createDataFrame([(0, y, x, luma[y][x]) for y in range(h) for x in range(w)], "img int, y int, x int, luma double")
    px = px.withColumns({c: F.lit(0) for c in "rgb"})
    assert abs(metrics.edge_energy(stencils.with_size(px)).first().energy - (energy - 0.2 * ring)) < 1e-9 and ring == 0
    assert abs(metrics.edge_energy(stencils.with_size(px), ringing=True).first().energy - (energy - 0.2 * extremes)) < 1e-9


def test_presets_add_up_on_a_canvas(spark):
    from chromagrid.operators import rules

    rows = {r.reason: r for r in rules.preset_table(spark, "MAX").collect()}
    assert len(rows) == 21
    r = rows["ARCHITECTURE_EDGES+LARGE_CANVAS"]
    assert (r.preset, r.micro_phase, r.edge_scale, r.k_sigma, r.dither_mask) == ("FOTO/LargeCanvasHiDetail", 8, 0.65, 0.45, "Flat|Sky|Skin")
    assert abs(r.luma_eps - 0.0018) < 1e-12 and rows["OLD_SCAN"].wb_strength == 0.7 and rows["AUTO_BALANCED+SMALL_CANVAS"].skin_tone_smooth == 0.35


def test_merging_in_rounds_equals_one_by_one(spark):
    rng = np.random.default_rng(2)
    palette = [tuple(int(v) for v in c) for c in rng.integers(100, 150, (80, 3))]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(palette)], "idx int, r int, g int, b int")
    got = kernels.merged_palette(df, 0.03).orderBy("home").collect()
    assert [(r.r, r.g, r.b) for r in got] == kernels.merged_colors(palette, 0.03)
    assert sum(r["size"] for r in got) == 80 and 1 < len(got) < 80
    assert kernels.merged_palette(df.where("false")).count() == 0


@pytest.mark.parametrize("metric", ["rgb", "oklab"])
def test_nearest_colors_by_the_cube_equal_a_full_scan(spark, monkeypatch, metric):
    from chromagrid.operators import matching

    rng = np.random.default_rng(3)
    own, pal = rng.integers(0, 256, (700, 3)), rng.integers(0, 256, (400, 3))
    pal[200:260] = pal[:60]  # equal entries: the first counts
    own[:100] = pal[100:200]
    px = spark.createDataFrame([tuple(map(int, c)) for c in own], "r int, g int, b int")
    palette = spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(pal)], "idx int, r int, g int, b int")
    with monkeypatch.context() as m:
        m.setattr(matching, "CUBE_FROM", 1000)
        whole = sorted(matching.nearest(px, palette, metric).collect())
    assert sorted(matching.nearest(px, palette, metric).collect()) == whole
    monkeypatch.setattr(matching, "CUBE_ENTRIES", 150)
    assert sorted(matching.nearest(px, palette, metric).collect()) == whole
    a, b = (v.astype(float) if metric == "rgb" else kernels.to_oklab(v.astype(float)) for v in (own, pal))
    d = ((a[:, None] - b[None]) ** 2).sum(axis=2).round(12)
    want = {tuple(c): int(k) for c, k in zip(own.tolist(), d.argmin(axis=1), strict=True)}
    assert {(r.r, r.g, r.b): r.idx for r in whole} == want


def test_a_palette_entry_that_can_be_nearest_is_never_left_out():
    from chromagrid.operators import matching

    rng = np.random.default_rng(8)
    pal = kernels.to_oklab(rng.integers(0, 256, (3000, 3)).astype(float))
    for cell in rng.integers(0, 1 << 15, 20).tolist():
        kept = set(matching.possible(pal, *matching.cell_box(cell, 5, "oklab")).tolist())
        corner = np.array([cell >> 10 & 31, cell >> 5 & 31, cell & 31]) * 8
        own = kernels.to_oklab((corner + rng.integers(0, 8, (200, 3))).astype(float))
        assert set(((own[:, None] - pal[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()) <= kept and len(kept) < 600
