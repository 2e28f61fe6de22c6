"""Neighbourhood operators on pixel tables px(img, y, x, ...).

Horizontal windows are partitioned by (img, y) and ordered by x, vertical ones by
(img, x) and ordered by y: two exchanges for a separable filter, whatever its
radius.  Image sizes come from a table with one row per image.  Radii are literals.
Values outside an image repeat its edge unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import color as C
from ..sources.rasters import sizes

def along_row() -> WindowSpec:
    return Window.partitionBy("img", "y").orderBy("x")


def along_col() -> WindowSpec:
    return Window.partitionBy("img", "x").orderBy("y")


def with_size(px: DataFrame) -> DataFrame:
    """``px`` with w and h of its image."""
    return px.join(sizes(px), "img")


def around(px: DataFrame, col: str) -> DataFrame:
    """``px`` with the eight neighbours of ``col`` (null outside): nw n ne w_ e_ sw s se, prefixed n_."""
    rows = px.withColumns({"n_w": F.lag(col).over(along_row()), "n_e": F.lead(col).over(along_row())})
    out = {"n_n": F.lag(col).over(along_col()), "n_s": F.lead(col).over(along_col())}
    for a, f in (("n", F.lag), ("s", F.lead)):
        out |= {f"n_{a}w": f("n_w").over(along_col()), f"n_{a}e": f("n_e").over(along_col())}
    return rows.withColumns(out)


def inside() -> Column:
    """True where all eight neighbours exist."""
    return F.col("n_nw").isNotNull() & F.col("n_se").isNotNull() & F.col("n_ne").isNotNull() & F.col("n_sw").isNotNull()


def sobel(px: DataFrame, col: str, out: str = "mag") -> DataFrame:
    """Gradient size; 0 at the border."""
    n = lambda k: F.col(f"n_{k}")
    gx = (n("ne") - n("nw")) + 2 * (n("e") - n("w")) + (n("se") - n("sw"))
    gy = (n("nw") + 2 * n("n") + n("ne")) - (n("sw") + 2 * n("s") + n("se"))
    return around(px, col).withColumn(out, F.when(inside(), F.sqrt(gx * gx + gy * gy)).otherwise(0.0)).select(*px.columns, out)


def laplacian(px: DataFrame, col: str, out: str = "lap") -> DataFrame:
    """Four-neighbour Laplacian; 0 at the border."""
    v = F.lag(col).over(along_row()) + F.lead(col).over(along_row()) + F.lag(col).over(along_col()) + F.lead(col).over(along_col()) - 4 * F.col(col)
    return px.withColumn(out, F.coalesce(v, F.lit(0.0)))


def _frame(w: WindowSpec, r: int) -> WindowSpec:
    return w.rowsBetween(-r, r)


def local_variance(px: DataFrame, col: str, radii: tuple[int, ...] = (1, 3, 4)) -> DataFrame:
    """Adds var3, var7, var9 (2 r + 1): population variance of the box clipped at the border."""
    first = {}
    for r in radii:
        w = _frame(along_row(), r)
        first |= {f"s_{r}": F.sum(col).over(w), f"q_{r}": F.sum(F.col(col) * F.col(col)).over(w), f"c_{r}": F.count(col).over(w)}
    rows = px.withColumns(first)
    second = {}
    for r in radii:
        w = _frame(along_col(), r)
        n = F.sum(f"c_{r}").over(w)
        mean = F.sum(f"s_{r}").over(w) / n
        second[f"var{2 * r + 1}"] = F.greatest(F.lit(0.0), F.sum(f"q_{r}").over(w) / n - mean * mean)
    return rows.withColumns(second).drop(*first)


def extreme(px: DataFrame, col: str, r: int, least: bool, out: str) -> DataFrame:
    """Minimum or maximum of the square of radius r (of what lies inside)."""
    f = F.min if least else F.max
    tmp = f"{out}_row"
    return px.withColumn(tmp, f(col).over(_frame(along_row(), r))).withColumn(out, f(tmp).over(_frame(along_col(), r))).drop(tmp)


def open_close(px: DataFrame, mask: str, r: int = 1) -> DataFrame:
    """Erosion, dilation, dilation, erosion of a 0/1 column, in place."""
    out = px
    for least in (True, False, False, True):
        out = extreme(out, mask, r, least, "oc_tmp").drop(mask).withColumnRenamed("oc_tmp", mask)
    return out


def _box_pass(px: DataFrame, cols: list[str], r: int, w: WindowSpec, at: str, size: str, whole: bool) -> DataFrame:
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in cols:
        low = F.greatest(F.lit(0), r - F.col(at)) * F.first(c).over(every)
        high = F.greatest(F.lit(0), F.col(at) + r - F.col(size) + 1) * F.last(c).over(every)
        mean = (F.sum(c).over(_frame(w, r)) + low + high) / (2 * r + 1)
        out[c] = F.floor(mean) if whole else mean
    return px.withColumns(out)


def box_blur(px: DataFrame, cols: list[str], r: int, whole: bool = False) -> DataFrame:
    """Mean of the square of radius r, edges repeated; ``whole``: integer division in each
    direction.  Replaces ``cols``; px needs w and h."""
    return _box_pass(_box_pass(px, cols, r, along_row(), "x", "w", whole), cols, r, along_col(), "y", "h", whole)


def variance_field(px: DataFrame, col: str, r: int, out: str = "field", mean: str = "mean") -> DataFrame:
    """Mean and max(0, mean of squares - square of mean) of the square of radius r."""
    both = box_blur(px.withColumns({mean: F.col(col).cast("double"), out: (F.col(col) * F.col(col)).cast("double")}), [mean, out], r)
    return both.withColumn(out, F.greatest(F.lit(0.0), F.col(out) - F.col(mean) * F.col(mean)))


def kernel(sigma: float, r: int) -> list[float]:
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    return [v / sum(k) for v in k]


def _convolved(px: DataFrame, cols: list[str], k: list[float], w: WindowSpec) -> DataFrame:
    r, every = len(k) // 2, w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    for c in cols:
        acc = F.col(c) * k[r]
        for i in range(1, r + 1):
            acc = acc + F.coalesce(F.lag(c, i).over(w), F.first(c).over(every)) * k[r - i] + F.coalesce(F.lead(c, i).over(w), F.last(c).over(every)) * k[r + i]
        out[c] = acc
    return px.withColumns(out)


def gaussian(px: DataFrame, cols: list[str], sigma: float, r: int | None = None) -> DataFrame:
    """Separable Gaussian of radius max(1, round(2 sigma)), edges repeated; replaces ``cols``."""
    r = r or max(1, math.floor(2 * sigma + 0.5))
    k = kernel(sigma, r)
    return _convolved(_convolved(px, cols, k, along_row()), cols, k, along_col())


def gaussian_bytes(px: DataFrame, sigma: float, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Gaussian of 8-bit channels with 8-bit results."""
    out = gaussian(px.withColumns({c: F.col(c).cast("double") for c in cols}), list(cols), sigma)
    return out.withColumns({c: C.clamp(C.half_up(F.col(c)).cast("double"), 0, 255).cast("int") for c in cols})


def luma_noise_reduced(px: DataFrame, r: int = 3, eps: float = 0.003) -> DataFrame:
    """Guided smoothing of luma; px: r, g, b in 0..1 with edge, flat, w, h."""
    p = variance_field(px.withColumn("lum", C.luma709(F.col("r"), F.col("g"), F.col("b"))), "lum", r)
    a = F.col("field") / (F.col("field") + eps)
    k = F.when(F.col("edge"), 0.2).when(F.col("flat"), 1.0).otherwise(0.5)
    new = a * F.col("lum") + F.col("mean") * (1 - a)
    scale = F.when(F.col("lum") > 1e-6, new / F.col("lum") * k + 1 - k).otherwise(1.0)
    return p.withColumns({c: C.clamp(F.col(c) * scale, 0, 1) for c in "rgb"}).select(*px.columns)


def mixed_with_blur(px: DataFrame, r: int, gain: Column, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """c (1 - gain) + blur(c) gain, clamped to 0..1: chroma noise reduction (one gain, up to
    2) and texture smoothing (gain by mask)."""
    b = box_blur(px.withColumns({f"mb_{c}": F.col(c).cast("double") for c in cols}), [f"mb_{c}" for c in cols], r)
    return b.withColumns({c: C.clamp(F.col(c) * (1 - gain) + F.col(f"mb_{c}") * gain, 0, 1) for c in cols}).select(*px.columns)


def texture_gain(flat: Column, texture: Column, smooth_flat: float = 0.25, smooth_other: float = 0.10) -> Column:
    return F.when(flat & ~texture, smooth_flat).when(texture, smooth_other * 0.5).otherwise(smooth_other)


def unsharp(px: DataFrame, sigma: float = 1.0, amount: float = 0.28, threshold: int = 3) -> DataFrame:
    """Sharpens 0..1 channels at edges where the detail exceeds threshold / 255."""
    b = gaussian(px.withColumns({f"us_{c}": F.col(c) for c in "rgb"}), [f"us_{c}" for c in "rgb"], sigma)
    mag = sum((F.abs(F.col(c) - F.col(f"us_{c}")) for c in "gb"), F.abs(F.col("r") - F.col("us_r")))
    k = F.when(F.col("edge") & (mag > threshold / 255.0), amount).otherwise(0.0)
    return b.withColumn("us_k", k).withColumns({c: C.clamp(F.col(c) + (F.col(c) - F.col(f"us_{c}")) * F.col("us_k"), 0, 1) for c in "rgb"}).select(*px.columns)


def antialiased(px: DataFrame, sigma_edge: float, sigma_flat: float) -> DataFrame:
    """Mixture of two blurs by the masks edge and flat."""
    p = px.withColumns({f"{k}_{c}": F.col(c) for k in ("ae", "af") for c in "rgb"})
    p = gaussian(p, [f"ae_{c}" for c in "rgb"], sigma_edge) if sigma_edge > 1e-6 else p
    p = gaussian(p, [f"af_{c}" for c in "rgb"], sigma_flat) if sigma_flat > 1e-6 else p
    return p.withColumns({c: C.mix3(F.col(c), F.col(f"ae_{c}"), F.col(f"af_{c}"), F.col("edge"), F.col("flat")) for c in "rgb"}).select(*px.columns)


def local_contrast(px: DataFrame) -> DataFrame:
    b = gaussian(px.withColumns({f"lc_{c}": F.col(c) for c in "rgb"}), [f"lc_{c}" for c in "rgb"], 0.8)
    return b.withColumns({c: C.clamp(F.col(c) * 1.06 - F.col(f"lc_{c}") * 0.06, 0, 1) for c in "rgb"}).select(*px.columns)


def difference_of_gaussians(px: DataFrame, r: int = 2) -> DataFrame:
    """Adds lum and dog: blur of radius r less blur of radius round(1.6 r)."""
    big = max(1, math.floor(1.6 * r + 0.5))
    p = px.withColumn("lum", C.luma709(F.col("r"), F.col("g"), F.col("b"))).withColumns({"dg_a": F.col("lum"), "dg_b": F.col("lum")})
    p = gaussian(gaussian(p, ["dg_a"], max(1.0, r / 2), r), ["dg_b"], max(1.0, big / 2), big)
    return p.withColumn("dog", F.col("dg_a") - F.col("dg_b")).drop("dg_a", "dg_b")


def halo_removed(px: DataFrame, amount: float = 0.25, r: int = 2) -> DataFrame:
    """Dampens bright halos; px: r, g, b in 0..1.  The amount follows the mean
    difference of Gaussians of the image (one row per image)."""
    p = difference_of_gaussians(px, r)
    score = p.groupBy("img").agg(F.avg(F.abs("dog")).alias("score"))
    p = p.join(score, "img")
    eff = C.clamp(amount * (1 + F.col("score") * 20), 0.1, 0.6)
    new = C.clamp(F.col("lum") - F.when(F.col("dog") > 0, eff).otherwise(eff * 0.05) * F.col("dog"), 0, 1)
    scale = F.when(F.col("lum") > 1e-6, new / F.col("lum")).otherwise(1.0)
    return p.withColumns({c: C.clamp(F.col(c) * scale, 0, 1) for c in "rgb"}).select(*px.columns)


def deringed(px: DataFrame) -> DataFrame:
    """3 x 3 bilateral smoothing of 0..1 channels, edges repeated."""
    p = px
    left = {f"dr_{c}_{k}": F.coalesce(f(c).over(along_row()), F.col(c)) for c in "rgb" for k, f in (("w", F.lag), ("e", F.lead))} | {f"dr_{c}_c": F.col(c) for c in "rgb"}
    p = p.withColumns(left)
    near = {f"dr_{c}_{k}{m}": F.coalesce(f(f"dr_{c}_{k}").over(along_col()), F.col(f"dr_{c}_{k}")) for c in "rgb" for k in "wce" for m, f in (("n", F.lag), ("s", F.lead))}
    p = p.withColumns(near)
    lum = lambda s: C.luma709(*(F.col(f"dr_{c}_{s}") for c in "rgb"))
    names = [k + m for k in "wce" for m in ("", "n", "s")]
    weight = {s: F.exp(-(lum(s) - lum("c")) * (lum(s) - lum("c")) * 50.0) * (1.0 if s == "c" else 0.6) for s in names}
    p = p.withColumns({f"dw_{s}": w for s, w in weight.items()})
    total = sum((F.col(f"dw_{s}") for s in names[1:]), F.col(f"dw_{names[0]}"))
    return p.withColumns({c: sum((F.col(f"dr_{c}_{s}") * F.col(f"dw_{s}") for s in names[1:]), F.col(f"dr_{c}_{names[0]}") * F.col(f"dw_{names[0]}")) / total for c in "rgb"}).select(*px.columns)


def deblocked(px: DataFrame, strength: float = 0.5, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Draws pixel pairs across 8-pixel boundaries together, first in rows, then in columns."""
    p = px
    for w, at in ((along_row(), "x"), (along_col(), "y")):
        right = (F.col(at) % 8 == 7) & F.lead(at).over(w).isNotNull()
        left = (F.col(at) % 8 == 0) & (F.col(at) > 0)

        def mixed(c: str, w: WindowSpec = w, left: Column = left, right: Column = right) -> Column:
            other = F.when(right, F.lead(c).over(w)).when(left, F.lag(c).over(w))
            return F.when(other.isNull(), F.col(c)).otherwise(C.clamp(F.col(c) + ((F.col(c) + other) * 0.5 - F.col(c)) * strength, 0, 1))

        p = p.withColumns({c: mixed(c) for c in cols})
    return p


def unsharp_bytes(px: DataFrame, amount: float = 0.5) -> DataFrame:
    """3 x 3 mean (integer division of the sum of nine) and sharpening of 8-bit channels."""
    total = box_sums(px)
    new = {c: C.clamp((F.col(c) + ((F.col(c) - F.floor(F.col(f"bs_{c}") / 9)) * amount).cast("int")).cast("double"), 0, 255).cast("int") for c in "rgb"}
    return total.withColumns(new).select(*px.columns)


def box_sums(px: DataFrame, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Sum of the 3 x 3 square, edges repeated, as bs_*."""
    p = px.withColumns({f"bs_{c}": F.coalesce(F.lag(c).over(along_row()), F.col(c)) + F.col(c) + F.coalesce(F.lead(c).over(along_row()), F.col(c)) for c in cols})
    return p.withColumns({f"bs_{c}": F.coalesce(F.lag(f"bs_{c}").over(along_col()), F.col(f"bs_{c}")) + F.col(f"bs_{c}") + F.coalesce(F.lead(f"bs_{c}").over(along_col()), F.col(f"bs_{c}")) for c in cols})
