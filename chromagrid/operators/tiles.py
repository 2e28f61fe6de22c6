"""Stencils by tiles with halos: a chain of filters costs one exchange, whatever its number and radii.

An image is cut into tiles; each gets copies of the cells up to ``radius`` beyond its sides, where ``radius`` is the sum of the
chain's radii.  A step treats the sides of what it has as the sides of the image.  Where they aren't, its
values are wrong up to its radius from there, so after the whole chain what is wrong lies within the halo, which is cut off.
A tile, not an image, is the unit of memory: with TILE = 512 some 30 MB for three channels.

Box sums are differences of running sums and extremes of a box come from running extremes of blocks, so their
time doesn't depend on the radius.

Every step takes planes (name -> array) and the place of their first cell in the image, and changes the planes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stencils import kernel

TILE = 512
Planes = dict[str, np.ndarray]


class Step(NamedTuple):
    radius: int
    run: Callable[[Planes, tuple[int, int]], None]


def chain(px: DataFrame, steps: list[Step], outs: dict[str, str], tile: int = TILE) -> DataFrame:
    """px(img, y, x, columns) -> (img, y, x, ``outs``) after all ``steps``; outs: column -> type.

    All columns of ``px`` but img, y and x are planes of numbers or booleans."""
    radius = sum(s.radius for s in steps)
    ins = [c for c in px.columns if c not in ("img", "y", "x")]
    kinds = dict(px.dtypes)

    def run(t: pa.Table) -> pa.Table:
        ty, tx = (t.column(c)[0].as_py() for c in ("ty", "tx"))
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        own = (y // tile == ty) & (x // tile == tx)
        top, left = (int(v.min()) for v in (y, x))
        planes = {}
        for c in ins:
            v = t.column(c).to_numpy(zero_copy_only=False)
            planes[c] = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1), v.dtype)
            planes[c][y - top, x - left] = v
        at = np.flatnonzero(own)
        if not len(at):  # a tile beyond the image has a halo only
            return pa.table([*(t.column(c).slice(0, 0) for c in ("img", "y", "x")), *(pa.array([], ARROW[k]) for k in outs.values())], names=["img", "y", "x", *outs])
        for s in steps:
            s.run(planes, (top, left))
        got = [pa.array(planes[c][y[at] - top, x[at] - left]).cast(ARROW[k]) for c, k in outs.items()]
        return pa.table([*(t.column(c).take(pa.array(at)) for c in ("img", "y", "x")), *got], names=["img", "y", "x", *outs])

    def tiles_of(at: str):
        return F.sequence(F.floor(F.greatest(F.col(at) - radius, F.lit(0)) / tile).cast("int"), F.floor((F.col(at) + radius) / tile).cast("int"))

    cells = px.select("img", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *ins)
    dealt = cells.withColumn("ty", F.explode(tiles_of("y"))).withColumn("tx", F.explode(tiles_of("x")))
    schema = ", ".join([f"img {kinds['img']}", "y int", "x int", *(f"{c} {k}" for c, k in outs.items())])
    return dealt.groupBy("img", "ty", "tx").applyInArrow(run, schema)


ARROW = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}


# of whole planes, along one axis


def moved(v: np.ndarray, by: int, axis: int) -> np.ndarray:
    """Entry i is v[i + by], the side repeated."""
    return np.take(v, np.clip(np.arange(v.shape[axis]) + by, 0, v.shape[axis] - 1), axis)


def box_sum(v: np.ndarray, r: int, axis: int, repeat: bool) -> np.ndarray:
    """Sum of the entries i - r to i + r that there are; ``repeat``: with the side in place of those that there are not."""
    n = v.shape[axis]
    run = np.concatenate([np.zeros_like(np.take(v, [0], axis)), np.cumsum(v, axis)], axis)
    i = np.arange(n)
    out = np.take(run, np.minimum(i + r + 1, n), axis) - np.take(run, np.maximum(i - r, 0), axis)
    if repeat:
        shape = [1, 1]
        shape[axis] = n
        out = out + np.maximum(0, r - i).reshape(shape) * np.take(v, [0], axis) + np.maximum(0, i + r - n + 1).reshape(shape) * np.take(v, [n - 1], axis)
    return out


def box_extreme(v: np.ndarray, r: int, axis: int, least: bool) -> np.ndarray:
    """Extreme of the entries i - r to i + r that there are, from running extremes of blocks of 2 r + 1."""
    f, k, n = (np.minimum if least else np.maximum), 2 * r + 1, v.shape[axis]
    m = np.moveaxis(v, axis, 0).astype(np.float64)
    fill = np.inf if least else -np.inf
    long = -(-(n + 2 * r) // k) * k
    padded = np.full((long, m.shape[1]), fill)
    padded[r : r + n] = m
    blocks = padded.reshape(-1, k, m.shape[1])
    ahead = f.accumulate(blocks, axis=1).reshape(long, -1)
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(long, -1)
    out = f(back[:n], ahead[k - 1 : k - 1 + n])
    return np.moveaxis(out, 0, axis).astype(v.dtype)


def blurred(v: np.ndarray, r: int, whole: bool = False) -> np.ndarray:
    for axis in (1, 0):
        v = box_sum(v, r, axis, True) / (2 * r + 1)
        v = np.floor(v) if whole else v
    return v


def convolved(v: np.ndarray, k: list[float]) -> np.ndarray:
    r = len(k) // 2
    for axis in (1, 0):
        out = v * k[r]
        for i in range(1, r + 1):
            out = out + moved(v, -i, axis) * k[r - i] + moved(v, i, axis) * k[r + i]
        v = out
    return v


def gaussian_radius(sigma: float) -> int:
    return max(1, math.floor(2 * sigma + 0.5))


def luma(p: Planes) -> np.ndarray:
    return 0.2126 * p["r"] + 0.7152 * p["g"] + 0.0722 * p["b"]


def unit(v: np.ndarray) -> np.ndarray:
    return np.clip(v, 0.0, 1.0)


def _inner(v: np.ndarray) -> np.ndarray:
    out = np.zeros(v.shape)
    out[1:-1, 1:-1] = v[1:-1, 1:-1]
    return out


# steps


def sobel(col: str, out: str = "mag") -> Step:
    """Gradient size; 0 at the border."""

    def run(p: Planes, _: tuple[int, int]) -> None:
        at = lambda dy, dx: moved(moved(p[col], dy, 0), dx, 1)
        gx = (at(-1, 1) - at(-1, -1)) + 2 * (at(0, 1) - at(0, -1)) + (at(1, 1) - at(1, -1))
        gy = (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1)) - (at(1, -1) + 2 * at(1, 0) + at(1, 1))
        p[out] = _inner(np.sqrt(gx * gx + gy * gy))

    return Step(1, run)


def laplacian(col: str, out: str = "lap") -> Step:
    def run(p: Planes, _: tuple[int, int]) -> None:
        v = p[col]
        p[out] = _inner(moved(v, -1, 1) + moved(v, 1, 1) + moved(v, -1, 0) + moved(v, 1, 0) - 4 * v)

    return Step(1, run)


def local_variance(col: str, radii: tuple[int, ...] = (1, 3, 4)) -> Step:
    """var3, var7, var9 (2 r + 1): population variance of the box clipped at the border."""

    def run(p: Planes, _: tuple[int, int]) -> None:
        v = p[col].astype(np.float64)
        for r in radii:
            n, s, q = (box_sum(box_sum(a, r, 1, False), r, 0, False) for a in (np.ones(v.shape), v, v * v))
            p[f"var{2 * r + 1}"] = np.maximum(0.0, q / n - (s / n) * (s / n))

    return Step(max(radii), run)


def extreme(col: str, r: int, least: bool, out: str) -> Step:
    def run(p: Planes, _: tuple[int, int]) -> None:
        p[out] = box_extreme(box_extreme(p[col], r, 1, least), r, 0, least)

    return Step(r, run)


def open_close(mask: str, r: int = 1) -> list[Step]:
    return [extreme(mask, r, least, mask) for least in (True, False, False, True)]


def box_blur(cols: list[str], r: int, whole: bool = False) -> Step:
    def run(p: Planes, _: tuple[int, int]) -> None:
        p.update({c: blurred(p[c], r, whole) for c in cols})

    return Step(r, run)


def variance_field(col: str, r: int, out: str = "field", mean: str = "mean") -> Step:
    def run(p: Planes, _: tuple[int, int]) -> None:
        v = p[col].astype(np.float64)
        p[mean], squares = blurred(v, r), blurred(v * v, r)
        p[out] = np.maximum(0.0, squares - p[mean] * p[mean])

    return Step(r, run)


def gaussian(cols: list[str], sigma: float, r: int | None = None) -> Step:
    r = r or gaussian_radius(sigma)
    k = kernel(sigma, r)

    def run(p: Planes, _: tuple[int, int]) -> None:
        p.update({c: convolved(p[c].astype(np.float64), k) for c in cols})

    return Step(r, run)


def gaussian_bytes(sigma: float, cols: tuple[str, ...] = ("r", "g", "b")) -> Step:
    """Gaussian of 8-bit channels with 8-bit results."""
    blur = gaussian(list(cols), sigma)

    def run(p: Planes, at: tuple[int, int]) -> None:
        blur.run(p, at)
        p.update({c: np.clip(np.floor(p[c] + 0.5), 0, 255) for c in cols})

    return Step(blur.radius, run)


def luma_noise_reduced(r: int = 3, eps: float = 0.003) -> Step:
    """Guided smoothing of luma of channels in 0..1, by the masks edge and flat."""
    field = variance_field("_lum", r, "_field", "_mean")

    def run(p: Planes, at: tuple[int, int]) -> None:
        p["_lum"] = lum = luma(p)
        field.run(p, at)
        a = p["_field"] / (p["_field"] + eps)
        k = np.where(p["edge"], 0.2, np.where(p["flat"], 1.0, 0.5))
        new = a * lum + p["_mean"] * (1 - a)
        scale = np.where(lum > 1e-6, new / np.maximum(lum, 1e-300) * k + 1 - k, 1.0)
        p.update({c: unit(p[c] * scale) for c in "rgb"})

    return Step(r, run)


def mixed_with_blur(r: int, gain: Callable[[Planes], np.ndarray] | float) -> Step:
    """c (1 - gain) + blur(c) gain: chroma noise reduction (one gain, up to 2) and texture smoothing (a gain by masks)."""

    def run(p: Planes, _: tuple[int, int]) -> None:
        g = gain(p) if callable(gain) else gain
        p.update({c: unit(p[c] * (1 - g) + blurred(p[c], r) * g) for c in "rgb"})

    return Step(r, run)


def texture_gain(flat: str = "flat", texture: str = "hi", smooth_flat: float = 0.25, smooth_other: float = 0.10) -> Callable[[Planes], np.ndarray]:
    return lambda p: np.where(p[flat] & ~p[texture], smooth_flat, np.where(p[texture], smooth_other * 0.5, smooth_other))


def unsharp(sigma: float = 1.0, amount: float = 0.28, threshold: int = 3) -> Step:
    """Sharpens 0..1 channels at edges where the detail exceeds threshold / 255."""
    r = gaussian_radius(sigma)
    k = kernel(sigma, r)

    def run(p: Planes, _: tuple[int, int]) -> None:
        soft = {c: convolved(p[c], k) for c in "rgb"}
        mag = sum(np.abs(p[c] - soft[c]) for c in "rgb")
        gain = np.where(p["edge"] & (mag > threshold / 255.0), amount, 0.0)
        p.update({c: unit(p[c] + (p[c] - soft[c]) * gain) for c in "rgb"})

    return Step(r, run)


def antialiased(sigma_edge: float, sigma_flat: float) -> Step:
    """Mixture of two blurs by the masks edge and flat."""
    soft = lambda v, s: convolved(v, kernel(s, gaussian_radius(s))) if s > 1e-6 else v

    def run(p: Planes, _: tuple[int, int]) -> None:
        for c in "rgb":
            e, f = soft(p[c], sigma_edge), soft(p[c], sigma_flat)
            p[c] = unit(np.where(p["flat"], f, np.where(p["edge"], 0.5 * p[c] + 0.5 * e, 0.5 * p[c] + 0.25 * f + 0.25 * e)))

    return Step(max(gaussian_radius(s) if s > 1e-6 else 0 for s in (sigma_edge, sigma_flat)), run)


def local_contrast() -> Step:
    k = kernel(0.8, gaussian_radius(0.8))

    def run(p: Planes, _: tuple[int, int]) -> None:
        p.update({c: unit(p[c] * 1.06 - convolved(p[c], k) * 0.06) for c in "rgb"})

    return Step(gaussian_radius(0.8), run)


def difference_of_gaussians(r: int = 2) -> Step:
    """lum and dog: blur of radius r less blur of radius round(1.6 r)."""
    big = max(1, math.floor(1.6 * r + 0.5))
    near, far = kernel(max(1.0, r / 2), r), kernel(max(1.0, big / 2), big)

    def run(p: Planes, _: tuple[int, int]) -> None:
        p["lum"] = luma(p)
        p["dog"] = convolved(p["lum"], near) - convolved(p["lum"], far)

    return Step(big, run)


def deringed() -> Step:
    """3 x 3 bilateral smoothing of 0..1 channels."""

    def run(p: Planes, _: tuple[int, int]) -> None:
        lum, total, sums = luma(p), 0.0, dict.fromkeys("rgb", 0.0)
        for dx in (-1, 0, 1):
            for dy in (0, -1, 1):
                at = lambda v, dx=dx, dy=dy: moved(moved(v, dx, 1), dy, 0)
                far = at(lum) - lum
                weight = np.exp(-far * far * 50.0) * (0.6 if dx or dy else 1.0)
                total = total + weight
                sums = {c: sums[c] + at(p[c]) * weight for c in "rgb"}
        p.update({c: sums[c] / total for c in "rgb"})

    return Step(1, run)


def deblocked(strength: float = 0.5, cols: tuple[str, ...] = ("r", "g", "b")) -> Step:
    """Draws pixel pairs across 8-pixel boundaries together, first in rows, then in columns."""

    def run(p: Planes, at: tuple[int, int]) -> None:
        for axis in (1, 0):
            for c in cols:
                v = p[c]
                n = v.shape[axis]
                place = np.arange(n) + at[axis]
                right, left = (place % 8 == 7) & (np.arange(n) < n - 1), (place % 8 == 0) & (np.arange(n) > 0)
                by = (right.astype(int) - left).reshape((-1, 1) if axis == 0 else (1, -1))
                other = np.where(by > 0, moved(v, 1, axis), moved(v, -1, axis))
                p[c] = np.where(by != 0, unit(v + ((v + other) * 0.5 - v) * strength), v)

    return Step(1, run)


def unsharp_bytes(amount: float = 0.5) -> Step:
    """3 x 3 mean (integer division of the sum of nine) and sharpening of 8-bit channels."""

    def run(p: Planes, _: tuple[int, int]) -> None:
        for c in "rgb":
            v = p[c].astype(np.int64)
            mean = box_sum(box_sum(v, 1, 1, True), 1, 0, True) // 9
            p[c] = np.clip(v + np.trunc((v - mean) * amount).astype(np.int64), 0, 255)

    return Step(1, run)


def halo_removed(px: DataFrame, amount: float = 0.25, r: int = 2, tile: int = TILE) -> DataFrame:
    """Dampens bright halos of px(img, y, x, r, g, b in 0..1); also score, the mean size of the difference of Gaussians of
    the image, which sets the amount."""
    rgb = dict.fromkeys("rgb", "double")
    p = chain(px, [difference_of_gaussians(r)], {**rgb, "lum": "double", "dog": "double"}, tile)
    score = p.groupBy("img").agg(F.avg(F.abs("dog")).alias("score"))
    p = p.join(score, "img")
    eff = F.greatest(F.lit(0.1), F.least(F.lit(0.6), amount * (1 + F.col("score") * 20)))
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("lum") - F.when(F.col("dog") > 0, eff).otherwise(eff * 0.05) * F.col("dog")))
    scale = F.when(F.col("lum") > 1e-6, new / F.col("lum")).otherwise(1.0)
    return p.select("img", "y", "x", "score", *(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) * scale)).alias(c) for c in "rgb"))
