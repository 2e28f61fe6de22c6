"""Plans and memory of queries on large tables, told from small ones."""

import __spark_entry__ as entry
import numpy as np
import pytest
from chromagrid.operators import kernels, topology
from chromagrid.plans import diffusion
from chromagrid.sources import rasters


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocky_images_join_no_cells(spark, sf_dir):
    assert "Join" not in plan(rasters.blocky_images(spark, sf_dir))


@pytest.mark.parametrize("name", ["a10_a12_a15_colors_checker", "n23_potts", "q01_min_runs"])
def test_no_cells_are_sent_to_the_driver(name, spark, sf_dir):
    """Joins by block were broadcast: Spark took a cell's share of its vector for its size."""
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "sy#" not in p


def test_blocky_images_without_label_have_no_cells(spark, tmp_path):
    rows = [(i, [i / 100] * 64, 1 if i < 8 else None) for i in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = rasters.blocky_images(spark, str(tmp_path)).collect()
    assert len(got) == 8 * 64 and {r.img for r in got} == {1}
    first = {r.y: r.r for r in got if r.x == 0}
    assert first[0] == first[5] != first[6] == first[7]


def test_areas_and_islands_broadcast_no_cells(spark, sf_dir, monkeypatch):
    """Stored cells are small files, so all their joins were broadcast."""
    plans, keep = [], topology.stored
    monkeypatch.setattr(topology, "stored", lambda df, name: (plans.append(plan(df)), keep(df, name))[1])
    plans.append(plan(topology.islands(diffusion.noisy(spark, sf_dir).select("img", "y", "x", "idx"), 3, tile=16)))
    joins = [p for p in plans[1:] if "Join" in p]  # the first plan makes the cells
    assert len(joins) >= 4
    assert not any("BroadcastHashJoin" in p for p in joins)


def _cells(spark):
    """Two images of a gap of two rows, missing cells and rows cut by batches, and one without a name."""
    rows = [(img, y, x, (x * 37 + y * 11) % 256, (x * 5 + y * 71) % 256, (x * y) % 256, x % 5 == 0) for img in (3, 4, None) for y in range(23) for x in range(17 + (img or 0)) if y not in (5, 6) and (x * y) % 13 != 12]
    return spark.createDataFrame(rows, "img int, y int, x int, r int, g int, b int, edge boolean")


def test_diffusion_by_rows_equals_that_of_the_plane(spark):
    px = _cells(spark)
    want = {}
    for img in (3, 4, None):
        cells = [r for r in px.collect() if r.img == img]
        plane, edge = np.zeros((23, 17 + (img or 0), 3)), np.zeros((23, 17 + (img or 0)), bool)
        for r in cells:
            plane[r.y, r.x], edge[r.y, r.x] = (r.r, r.g, r.b), r.edge
        for method, taps in (("floyd", kernels.FLOYD), ("atkinson", kernels.ATKINSON)):
            got = kernels.diffused(plane / 255.0, np.array(diffusion.PALETTE) / 255.0, taps, 0.67, edge, bounds=(0.0, 1.0))
            want |= {(method, img, r.y, r.x): int(got[r.y, r.x]) for r in cells}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {(m, r.img, r.y, r.x): r.idx for m in ("floyd", "atkinson") for r in kernels.dithered(px, diffusion.PALETTE, m).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


@pytest.mark.parametrize("name", ["q03_q07_floyd_steinberg", "q04_diffusion_by_callable"])
def test_serpentine_diffusion_takes_no_whole_image(name, spark, sf_dir):
    p = plan(entry.queries()[name](spark, sf_dir))
    assert "MapInArrow" in p and "FlatMapGroups" not in p


def test_diffusion_holds_a_few_rows():
    read = 0

    def rows():
        nonlocal read
        for y in range(1000):
            read += 1
            yield {c: np.full(8, y % 256) for c in "rgb"}

    for done, _ in enumerate(kernels.diffused_by_row(rows(), kernels.nearest_of(np.array([[0, 0, 0], [1, 1, 1]])), kernels.ATKINSON, 0.67)):
        assert read <= done + 3
    assert done == 999


def test_equal_colors_are_merged_as_one(spark, monkeypatch):
    near, keep = {}, kernels.stored
    monkeypatch.setattr(kernels, "stored", lambda df, name: near.setdefault(name, keep(df, name)) if name == "merge-near" else keep(df, name))
    colors = [((k % 7) * 9, (k % 5) * 11, (k % 3) * 40) for k in range(900)]
    px = spark.createDataFrame([(k, *c) for k, c in enumerate(colors)], "idx long, r int, g int, b int")
    got = {r.home: (r.size, r.r, r.g, r.b) for r in kernels.merged_palette(px, 0.05).collect()}
    assert near["merge-near"].count() < 105 * 105  # 105 different colors, not 900
    labs = [kernels.to_oklab(np.array(c, float)) for c in colors]
    heads, groups = [], {}
    for k, lab in enumerate(labs):
        home = next((h for h in heads if ((labs[h] - lab) ** 2).sum() ** 0.5 < 0.05), None)
        if home is None:
            heads.append(home := k)
        groups.setdefault(home, []).append(colors[k])
    assert got == {h: (len(g), *(sum(v) // len(g) for v in zip(*g, strict=True))) for h, g in groups.items()}
