"""Resampling of planes: target cells times taps, joined to source pixels.

Kernels aren't widened when shrinking; weights are normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from .metrics import edge_energy
from .stencils import with_size

PI = 3.141592653589793
#: Offsets tried for each number of trials (fixed values).
PHASES = {1: ((0.0, 0.0),), 2: ((0.0, 0.0), (0.5, 0.5)), 3: ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5)), 4: ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5))}
MORE_PHASES = ((0.0, 0.0), (0.25, 0.25), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5), (0.75, 0.25))


def mitchell(x: Column) -> Column:
    """B = C = 1/3."""
    a = F.abs(x)
    return F.when(a < 1, (7 * a * a * a - 12 * a * a + 16.0 / 3) / 6).when(a < 2, (-7.0 / 3 * a * a * a + 12 * a * a - 20 * a + 32.0 / 3) / 6).otherwise(0.0)


def lanczos(x: Column, n: int = 3) -> Column:
    sinc = lambda v: F.when(F.abs(v) < 1e-8, 1.0).otherwise(F.sin(PI * v) / (PI * v))
    return F.when(F.abs(x) < n, sinc(x) * sinc(x / n)).otherwise(0.0)


def resized(px: DataFrame, new_w: int, new_h: int, filter_: str = "mitchell", ox: float = 0.0, oy: float = 0.0, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(img, y, x, cols): each axis on its own, columns first; a weighted mean over taps."""
    weight, reach = (mitchell, 2) if filter_ == "mitchell" else (lanczos, 3)

    def axis(p: DataFrame, at: str, size: str, n: int, off: float, other: str) -> DataFrame:
        dims = p.groupBy("img").agg((F.max(at) + 1).alias("n_src"))
        pos = (F.col("to") + off) * (F.col("n_src") / float(n))
        taps = dims.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", pos).withColumn("tap", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
        taps = taps.withColumn("cell", F.floor("u") + F.col("tap"))
        taps = taps.select("img", "to", weight(F.col("u") - F.col("cell")).alias("wgt"), F.greatest(F.lit(0), F.least(F.col("n_src") - 1, F.col("cell"))).cast("int").alias(at))
        taps = taps.groupBy("img", "to", at).agg(F.sum("wgt").alias("wgt"))
        out = p.join(taps, ["img", at]).groupBy("img", other, "to").agg(*((F.sum(F.col(c) * F.col("wgt")) / F.sum("wgt")).alias(c) for c in cols))
        return out.withColumnRenamed("to", at)

    got = axis(px.select("img", "y", "x", *cols), "x", "w", new_w, ox, "y")
    return axis(got, "y", "h", new_h, oy, "x").select("img", "y", "x", *cols)


def best_phase(px: DataFrame, new_w: int, new_h: int, trials: int = 4, filter_: str = "mitchell") -> DataFrame:
    """(img, phase, ox, oy, energy): the offset of most edge energy less ringing; the first of equals."""
    tried = None
    for i, (ox, oy) in enumerate(PHASES.get(trials, MORE_PHASES)):
        p = resized(px, new_w, new_h, filter_, ox, oy).withColumn("luma", C.luma709(F.col("r"), F.col("g"), F.col("b")))
        e = edge_energy(with_size(p)).select("img", F.lit(i).alias("phase"), F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), F.round("energy", 6).alias("energy"))
        tried = e if tried is None else tried.unionByName(e)
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("energy"), "phase"))
    return tried.withColumn("k", rank).where("k = 1").drop("k")


def upscaled_mask(mask: DataFrame, new_w: int, new_h: int) -> DataFrame:
    """mask(img, y, x, m boolean) -> (img, y, x, m): bilinear sample above one half."""
    dims = mask.groupBy("img").agg((F.max("x") + 1).alias("mw"), (F.max("y") + 1).alias("mh"))
    to = dims.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(new_w - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(new_h - 1))))
    u = F.greatest(F.lit(0.0), F.least(F.col("x") * (F.col("mw") / float(new_w)), F.col("mw") - 1.00001))
    v = F.greatest(F.lit(0.0), F.least(F.col("y") * (F.col("mh") / float(new_h)), F.col("mh") - 1.00001))
    to = to.withColumns({"u": u, "v": v}).withColumns({"x0": F.floor("u").cast("int"), "y0": F.floor("v").cast("int")})
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    to = to.withColumn("c", corner)
    wx = F.when(F.col("c.i") == 0, 1 - (F.col("u") - F.col("x0"))).otherwise(F.col("u") - F.col("x0"))
    wy = F.when(F.col("c.j") == 0, 1 - (F.col("v") - F.col("y0"))).otherwise(F.col("v") - F.col("y0"))
    to = to.select("img", "y", "x", (wx * wy).alias("wgt"), F.least(F.col("mw") - 1, F.col("x0") + F.col("c.i")).alias("sx"), F.least(F.col("mh") - 1, F.col("y0") + F.col("c.j")).alias("sy"))
    src = mask.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("m").cast("int").alias("a"))
    return to.join(src, ["img", "sy", "sx"]).groupBy("img", "y", "x").agg((F.sum(F.col("a") * F.col("wgt")) > 0.5).alias("m"))


def nearest_mask(mask: DataFrame, new_w: int, new_h: int) -> DataFrame:
    """The source cell under each target cell's middle."""
    dims = mask.groupBy("img").agg((F.max("x") + 1).alias("mw"), (F.max("y") + 1).alias("mh"))
    to = dims.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(new_w - 1)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(new_h - 1))))
    to = to.select("img", "y", "x", F.floor((F.col("x") + 0.5) * F.col("mw") / new_w).cast("int").alias("sx"), F.floor((F.col("y") + 0.5) * F.col("mh") / new_h).cast("int").alias("sy"))
    return to.join(mask.select("img", F.col("y").alias("sy"), F.col("x").alias("sx"), "m"), ["img", "sy", "sx"]).select("img", "y", "x", "m")


def area_scaled(px: DataFrame, factor: int) -> DataFrame:
    """Mean of factor x factor cells."""
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return px.select("img", cell("y"), cell("x"), "r", "g", "b").groupBy("img", "y", "x").agg(*(F.avg(c).alias(c) for c in "rgb"))


def oriented(px: DataFrame, orientation: int) -> DataFrame:
    """EXIF orientation 1..8 by moving coordinates; other values leave the image as it is.  Needs w, h."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    moves = {2: (w - 1 - x, y), 3: (w - 1 - x, h - 1 - y), 4: (x, h - 1 - y), 5: (y, x), 6: (h - 1 - y, x), 7: (h - 1 - y, w - 1 - x), 8: (y, w - 1 - x)}
    nx, ny = moves.get(orientation, (x, y))
    return px.withColumns({"x": nx, "y": ny})
