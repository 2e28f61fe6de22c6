"""Stencils by tiles: whole images, any cut, one exchange, time without the radius."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromagrid.operators import tiles

RGB = dict.fromkeys("rgb", "double")


@given(st.integers(1, 40), st.integers(1, 5), st.integers(0, 12), st.integers(0, 2**31), st.booleans())
@settings(max_examples=200, deadline=None)
def test_boxes_equal_plain_loops(n, m, r, seed, flip):
    v = np.random.default_rng(seed).integers(0, 99, (n, m)).astype(float)
    v, axis = (v.T, 1) if flip else (v, 0)
    one = lambda f: np.stack([f(np.take(v, range(max(0, i - r), min(n, i + r + 1)), axis)) for i in range(n)], axis)
    assert (tiles.box_extreme(v, r, axis, True) == one(lambda x: x.min(axis=axis))).all()
    assert (tiles.box_extreme(v, r, axis, False) == one(lambda x: x.max(axis=axis))).all()
    assert np.allclose(tiles.box_sum(v, r, axis, False), one(lambda x: x.sum(axis=axis)))
    repeated = np.stack([sum(np.take(v, min(n - 1, max(0, j)), axis) for j in range(i - r, i + r + 1)) for i in range(n)], axis)
    assert np.allclose(tiles.box_sum(v, r, axis, True), repeated)


@pytest.fixture(scope="module")
def px(spark):
    rng = np.random.default_rng(9)
    rows = [(i, y, x, *map(float, rng.random(3)), bool(x % 3 == 0), bool(y % 2), bool((x + y) % 5 == 0)) for i, (h, w) in enumerate([(41, 53), (5, 60), (16, 16), (1, 1)]) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "img int, y int, x int, r double, g double, b double, edge boolean, flat boolean, hi boolean").cache()


STEPS = [tiles.luma_noise_reduced(), tiles.mixed_with_blur(2, 1.3), tiles.deringed(), tiles.deblocked(), tiles.unsharp(), tiles.antialiased(0.5, 1.0), tiles.local_contrast(), tiles.mixed_with_blur(1, tiles.texture_gain())]


@pytest.mark.parametrize("tile", [4, 16])
def test_a_chain_does_not_depend_on_the_cut(px, tile):
    whole, cut = ({(r.img, r.y, r.x): (r.r, r.g, r.b) for r in tiles.chain(px, STEPS, RGB, t).collect()} for t in (4096, tile))
    assert len(whole) == px.count() == len(cut)
    assert all(np.allclose(whole[k], cut[k], atol=1e-12) for k in whole)


def test_a_chain_of_any_length_has_one_exchange(px):
    plan = tiles.chain(px, STEPS, RGB)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_masks_are_opened_and_closed_over_tiles(px):
    p = px.select("img", "y", "x", px.hi.cast("int").alias("m"))
    whole, cut = (sorted(tiles.chain(p, tiles.open_close("m"), {"m": "int"}, t).collect()) for t in (4096, 5))
    assert whole == cut


def test_no_cells(px):
    assert tiles.chain(px.where("false"), STEPS, RGB).count() == 0


def test_time_does_not_grow_with_the_radius():
    v = np.random.default_rng(1).random((574, 574))

    def least_time(f):
        f()
        times = []
        for _ in range(5):
            t = time.process_time()
            f()
            times.append(time.process_time() - t)
        return min(times)

    for f in (lambda r: tiles.blurred(v, r), lambda r: tiles.box_extreme(tiles.box_extreme(v, r, 1, True), r, 0, True)):
        assert least_time(lambda f=f: f(31)) < 1.6 * least_time(lambda f=f: f(3))  # near 1.0 on an idle machine
