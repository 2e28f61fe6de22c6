"""Operators on index maps px(img, y, x, idx): runs, islands, Potts smoothing."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.stored import stored
from .stencils import along_col, along_row


def _smoothed(px: DataFrame, w: WindowSpec, part: list[str], at: str, min_flat: int, min_edge: int) -> DataFrame:
    """A run shorter than allowed takes the color of the last long run before it; runs before
    the first long one take the second run's color."""
    p = px.withColumn("ms_new", F.coalesce((F.col("idx") != F.lag("idx").over(w)).cast("int"), F.lit(1))).withColumn("ms_run", F.sum("ms_new").over(w))
    run = Window.partitionBy(*part, "ms_run")
    least = F.when(F.max(F.col("edge").cast("int")).over(run) == 1, min_edge).otherwise(min_flat)
    p = p.withColumn("ms_long", F.when(F.count(F.lit(1)).over(run) >= least, F.col("idx")))
    line = Window.partitionBy(*part)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    second = F.max(F.when(F.col("ms_run") == 2, F.col("idx"))).over(line)
    first_long = F.last("ms_long", ignorenulls=True).over(upto)
    return p.withColumn("idx", F.coalesce(first_long, second, F.col("idx"))).drop("ms_new", "ms_run", "ms_long")


def min_runs(px: DataFrame, min_flat: int = 3, min_edge: int = 2) -> DataFrame:
    """Removes short runs in rows, then in columns; px needs a boolean edge."""
    rows = _smoothed(px, along_row(), ["img", "y"], "x", min_flat, min_edge)
    return _smoothed(rows, along_col(), ["img", "x"], "y", min_flat, min_edge)


def potts(px: DataFrame, strength: float = 1.0) -> DataFrame:
    """One pass: the color, of the cell's own and its four neighbours', of least energy;
    the own color unless another is strictly better, then the least of (energy, color & 7, color)."""
    n = {"w": F.lag("idx").over(along_row()), "e": F.lead("idx").over(along_row()), "n": F.lag("idx").over(along_col()), "s": F.lead("idx").over(along_col())}
    g = {"w": F.lag("edge").over(along_row()), "e": F.lead("edge").over(along_row()), "n": F.lag("edge").over(along_col()), "s": F.lead("edge").over(along_col())}
    p = px.withColumns({f"po_{k}": v for k, v in n.items()} | {f"pe_{k}": v for k, v in g.items()})

    def energy(c: Column) -> Column:
        terms = [F.when(F.col(f"po_{k}").isNotNull() & (F.col(f"po_{k}") != c), F.when(F.col(f"pe_{k}") | F.col("edge"), 1.5).otherwise(1.0)).otherwise(0.0) for k in "wens"]
        return (terms[0] + terms[1] + terms[2] + terms[3]) * strength

    every = F.array_compact(F.array(*(F.col(f"po_{k}") for k in "wens")))
    best = F.array_min(F.transform(every, lambda c: F.struct(energy(c).alias("e"), c.bitwiseAND(F.lit(7)).alias("h"), c.alias("c"))))
    p = p.withColumn("po_best", best)
    return p.withColumn("idx", F.when(F.col("po_best.e") < energy(F.col("idx")), F.col("po_best.c")).otherwise(F.col("idx"))).select(*px.columns)


def by_image(px: DataFrame, kernel: Callable[[np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], ins: list[str], outs: dict[str, str]) -> DataFrame:
    """Applies a sequential kernel to each image: planes (h, w) in, planes out.

    Parallel over images; within one the order of pixels matters, so an image must fit in a
    task's memory (16 million pixels by the decoder's cap)."""

    def run(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        h, w = int(y.max()) + 1, int(x.max()) + 1
        planes = {}
        for c in ins:
            v = t.column(c).to_numpy(zero_copy_only=False)
            planes[c] = np.zeros((h, w), v.dtype)
            planes[c][y, x] = v
        got = kernel(np.array([h, w]), planes)
        cols = [t.column("img"), t.column("y"), t.column("x"), *(pa.array(got[c][y, x]) for c in outs)]
        return pa.table(cols, names=["img", "y", "x", *outs])

    kinds = dict(px.dtypes)
    schema = ", ".join([f"img {kinds['img']}", "y int", "x int", *(f"{c} {k}" for c, k in outs.items())])
    return px.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *ins).groupBy("img").applyInArrow(run, schema)


#: Cells that a kernel by rows gives back at a time.
CELLS = 1 << 14


def _rows_of(batches: Iterator[pa.RecordBatch], ins: list[str]) -> Iterator[tuple[int, pa.Scalar, int, int, np.ndarray, dict[str, np.ndarray]]]:
    """(number of the image, img, w, y, x, columns) of each row of batches in the order of img, y, x."""
    nth, last, row, parts = -1, None, None, []

    def whole() -> tuple:
        return *row, np.concatenate([x for x, _ in parts]), {c: np.concatenate([p[c] for _, p in parts]) for c in ins}

    for b in batches:
        if not b.num_rows:
            continue
        runs = pc.run_end_encode(b.column(0))
        ends = runs.run_ends.to_numpy()
        w, y, x = (b.column(i).to_numpy() for i in (1, 2, 3))
        cols = {c: b.column(4 + i).to_numpy(zero_copy_only=False) for i, c in enumerate(ins)}
        cuts = np.union1d(np.flatnonzero(y[1:] != y[:-1]) + 1, ends)
        for lo, hi in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            img = runs.values[int(np.searchsorted(ends, lo, side="right"))]
            new = nth < 0 or img.as_py() != last
            nth, last = nth + new, img.as_py()
            now = (nth, img, int(w[lo]), int(y[lo]))
            if row is not None and (now[0], now[3]) != (row[0], row[3]):
                yield whole()
                parts = []
            row = now
            parts.append((x[lo:hi], {c: v[lo:hi] for c, v in cols.items()}))
    if row is not None:
        yield whole()


def by_row(px: DataFrame, kernel: Callable[[Iterator[dict[str, np.ndarray]]], Iterator[dict[str, np.ndarray]]], ins: list[str], outs: dict[str, str]) -> DataFrame:
    """``by_image`` for kernels that go from row to row: rows (w) in, as many rows out in their order.

    An image is one task, in which Spark sorts its cells; of it Python holds the rows that the kernel keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, image in groupby(_rows_of(batches, ins), lambda r: r[0]):
            places, out, n, img = deque(), [], 0, None

            def rows(image: Iterator = image, places: deque = places) -> Iterator[dict[str, np.ndarray]]:
                at = 0
                for _, img, w, y, x, cols in image:
                    for there in (*(False,) * (y - at), True):  # rows without a cell are zeros
                        places.append((img, y, x) if there else None)
                        planes = {c: np.zeros(w, v.dtype) for c, v in cols.items()}
                        if there:
                            for c, v in cols.items():
                                planes[c][x] = v
                        yield planes
                    at = y + 1

            def batch(img: pa.Scalar, out: list, n: int) -> pa.RecordBatch:
                return pa.record_batch([pa.repeat(img, n), *(pa.array(np.concatenate(v), pa.int32()) for v in zip(*out, strict=True))], names=["img", "y", "x", *outs])

            for got in kernel(rows()):
                if place := places.popleft():
                    img, y, x = place
                    out.append((np.full(len(x), y, np.int32), x, *(got[c][x] for c in outs)))
                    n += len(x)
                    if n >= CELLS:
                        yield batch(img, out, n)
                        out, n = [], 0
            if n:
                yield batch(img, out, n)

    kinds = dict(px.dtypes)
    schema = ", ".join([f"img {kinds['img']}", "y int", "x int", *(f"{c} {k}" for c, k in outs.items())])
    cells = px.select("img", (F.max("x").over(Window.partitionBy("img")) + 1).cast("int").alias("w"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *ins)
    return cells.sortWithinPartitions("img", "y", "x").mapInArrow(run, schema)


def merged(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of nodes 0 .. n - 1 with edges (u, v): the least node of each one's component."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        if (a == b).all():
            return top
        # a component hangs itself under its least neighbour, then all paths are shortened
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]


def labels(idx: np.ndarray) -> np.ndarray:
    """4-connected areas, each named by its least cell number: runs are nodes, cells of equal color that lie one above
    the other are edges."""
    h, w = idx.shape
    begins = np.ones((h, w), bool)
    begins[:, 1:] = idx[:, 1:] != idx[:, :-1]
    run = np.cumsum(begins.ravel()).reshape(h, w) - 1
    same = idx[1:] == idx[:-1]
    top = merged(int(run[-1, -1]) + 1 if run.size else 0, run[1:][same], run[:-1][same])
    return np.flatnonzero(begins.ravel())[top[run]] if run.size else run


#: Side of the tiles in which areas are found first; a tile is one group.
TILE = 1024


def _tile_labels(t: pa.Table) -> pa.Table:
    """Cells of a tile with the place of the first cell of their area within it, row << 32 | column."""
    y, x, idx = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x", "idx"))
    top, left = y.min(), x.min()
    plane = np.full((y.max() - top + 1, x.max() - left + 1), np.iinfo(np.int64).min)
    plane[y - top, x - left] = idx
    first = labels(plane)[y - top, x - left]
    label = (first // plane.shape[1] + top << 32) + first % plane.shape[1] + left
    return t.select(["img", "y", "x", "idx"]).append_column("label", pa.array(label))


def roots(edges: DataFrame) -> DataFrame:
    """(img, u, v) with u > v -> (img, u, v): v is the least node of u's component.

    Rounds of stars: each node's larger neighbours are tied to its least one, then each node's smaller
    neighbours to the least of them, until no edge changes; the number of rounds grows with the logarithm of the nodes.  Groups are
    only aggregated, the joins are ones that Spark can split at a node of many edges.  Here and in what follows they are asked for by a hint:
    stored cells take so few bytes a row that Spark would send millions of them to the driver for a broadcast."""
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("img", "u", "v"))).first())
    e = stored(edges.distinct(), "area-edges")
    before = None
    while (now := sign(e)) != before:
        before = now
        both = e.unionByName(e.select("img", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("img", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = stored(both.where("v > u").join(least.hint("merge"), ["img", "u"]).select("img", F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "area-edges")
        least = large.groupBy("img", "u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), ["img", "u"]).where("v <> m").select("img", F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "area-edges")
    return e


def components(px: DataFrame, tile: int = TILE) -> DataFrame:
    """px(img, y, x, idx) -> also label: the place (row << 32 | column) of the first cell, in reading order, of
    the 4-connected area of equal idx.  Stored.

    Areas are found within tiles, and where two tiles meet, equal cells tie theirs together.  An image of any size is spread
    over tasks; of its areas only those that reach a tile's border take part in the joins."""
    kinds = dict(px.dtypes)
    cells = px.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("idx").cast("int").alias("idx"))
    dealt = cells.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    local = stored(dealt.groupBy("img", "ty", "tx").applyInArrow(_tile_labels, f"img {kinds['img']}, y int, x int, idx int, label bigint"), "area-tiles")

    def ties(at: str) -> DataFrame:
        here = local.where(F.col(at) % tile == 0)
        there = local.where(F.col(at) % tile == tile - 1).withColumn(at, F.col(at) + 1).withColumnRenamed("label", "other")
        met = here.join(there.hint("merge"), ["img", "y", "x", "idx"]).where("label <> other")
        return met.select("img", F.greatest("label", "other").alias("u"), F.least("label", "other").alias("v"))

    up = roots(ties("y").unionByName(ties("x"))).withColumnRenamed("u", "label")
    return stored(local.join(up.hint("merge"), ["img", "label"], "left").select("img", "y", "x", "idx", F.coalesce("v", "label").alias("label")), "area-cells")


def islands(px: DataFrame, below: int = 2, full_border: bool = False, tile: int = TILE) -> DataFrame:
    """Areas of fewer than ``below`` cells take the commonest color among bordering cells of areas
    that come later in reading order (``full_border``: of all areas); ties: least color & 7, then least color."""
    cells = components(px, tile)
    few = cells.groupBy("img", "label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < below).select("img", "label")
    small = stored(cells.join(few.hint("merge"), ["img", "label"]), "area-islands")
    around = F.explode(F.array(*(F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))))).alias("at")
    asked = small.select("img", F.col("label").alias("island"), F.col("idx").alias("own"), around).select("img", "island", "own", "at.y", "at.x")
    votes = asked.join(cells.hint("merge"), ["img", "y", "x"]).where((F.col("idx") != F.col("own")) & (F.lit(full_border) | (F.col("label") > F.col("island"))))
    votes = votes.groupBy("img", "island", "idx").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("idx").bitwiseAND(F.lit(7)).alias("low"), F.col("idx").alias("idx")))
    to = votes.groupBy("img", "island").agg(best.alias("best")).select("img", F.col("island").alias("label"), F.col("best.idx").alias("to"))
    moved = small.join(to.hint("merge"), ["img", "label"]).select("img", "y", "x", "to")
    return cells.join(moved.hint("merge"), ["img", "y", "x"], "left").select("img", "y", "x", F.coalesce("to", "idx").alias("idx"))
