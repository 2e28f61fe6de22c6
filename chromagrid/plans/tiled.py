"""The stencil queries once more by tiles with halos (operators/tiles.py), against the same SQL.

Tiles are 24 cells wide here, so that every image is cut; operators/tiles.py takes 512."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import masks, tiles
from . import filters, planes
from . import sql as S
from .planes import f1, linear_luma, units
from .scalars import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
CUT = 24
RGB = dict.fromkeys("rgb", "double")


def query(sql: str):
    """``sql``: text, or the name of the query that has it."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = filters.SQL.get(sql) or planes.SQL.get(sql) or S.exact(sql)
        return f

    return add


def masked(spark: SparkSession, d: str) -> DataFrame:
    p = units(spark, d).select("img", "y", "x", "r", "g", "b")
    return p.withColumns({"edge": F.col("x") % 3 == 0, "flat": F.col("y") % 2 == 0, "hi": F.col("x") % 4 == 1})


def lumas(spark: SparkSession, d: str) -> DataFrame:
    return linear_luma(f1(spark, d)).select("img", "y", "x", "luma")


def doubles(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).select("img", "y", "x", "r", "g", "b")


@query("n01_n02_gradients")
def n01_n02_gradients_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.chain(lumas(spark, d), [tiles.sobel("luma"), tiles.laplacian("luma")], {"mag": "double", "lap": "double"}, CUT))


@query("n03_local_variance")
def n03_local_variance_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.chain(lumas(spark, d), [tiles.local_variance("luma")], {f"var{n}": "double" for n in (3, 7, 9)}, CUT), 8)


@query("f01_f02_f03_a01_masks")
def f01_f02_f03_a01_masks_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = tiles.chain(lumas(spark, d), [tiles.sobel("luma"), tiles.local_variance("luma")], {"mag": "double"} | {f"var{n}": "double" for n in (3, 7, 9)}, CUT)
    p = p.withColumns({c: F.round(c, 9) for c in ("var3", "var7", "var9")})
    return masks.surfaces(p).select("img", "y", "x", "edge", "flat", "hitex_fine", "hitex_coarse")


_SMALL = "SELECT img, y, x, round(min(low) OVER c, 9) AS low, round(max(high) OVER c, 9) AS high FROM (SELECT *, min(luma) OVER h AS low, max(luma) OVER h AS high FROM lum WINDOW h AS (PARTITION BY img, y ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) WINDOW c AS (PARTITION BY img, x ORDER BY y ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)"


@query(f"{planes.BASE} {_SMALL}")
def n04_n05_extremes_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    got = tiles.chain(lumas(spark, d), [tiles.extreme("luma", 7, True, "low"), tiles.extreme("luma", 7, False, "high")], {"low": "double", "high": "double"}, CUT)
    return rounded(got, 9)


@query("n06_n07_n15_box_blur")
def n06_n07_n15_box_blur_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Blurs of luma in 0..1 and of channels in 0..255, in one chain."""
    p = units(spark, d).select("img", "y", "x", "luma", *(F.floor(F.col(c) * 255 + 0.5).cast("double").alias(c) for c in "rgb"))
    steps = [tiles.variance_field("luma", 3), tiles.box_blur(list("rgb"), 2, whole=True)]
    return rounded(tiles.chain(p, steps, {"mean": "double", "field": "double"} | dict.fromkeys("rgb", "bigint"), CUT))


@query("n08_gaussian")
def n08_gaussian_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = tiles.chain(doubles(spark, d), [tiles.gaussian(list("rgb"), 1.2)], RGB, CUT)
    return rounded(p.select("img", "y", "x", "r", "g", "b", *(C.byte(F.col(c)).alias(f"{c}8") for c in "rgb")))


@query("n09_luma_noise")
def n09_luma_noise_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.chain(masked(spark, d), [tiles.luma_noise_reduced()], RGB, CUT))


@query("n10_chroma_texture")
def n10_chroma_texture_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = masked(spark, d)
    a = tiles.chain(p, [tiles.mixed_with_blur(2, 1.4)], RGB, CUT)
    b = tiles.chain(p, [tiles.mixed_with_blur(1, tiles.texture_gain())], RGB, CUT)
    return rounded(a.join(b.withColumnsRenamed({c: f"s{c}" for c in "rgb"}), ["img", "y", "x"]))


@query("n11_sharpen_antialias_contrast")
def n11_sharpen_antialias_contrast_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    p = masked(spark, d)
    a, b, c = (tiles.chain(p, [s], RGB, CUT) for s in (tiles.unsharp(), tiles.antialiased(0.5, 1.0), tiles.local_contrast()))
    return rounded(a.join(b.withColumnsRenamed({k: f"a{k}" for k in "rgb"}), ["img", "y", "x"]).join(c.withColumnsRenamed({k: f"l{k}" for k in "rgb"}), ["img", "y", "x"]))


@query("n12_a31_halo")
def n12_a31_halo_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.halo_removed(doubles(spark, d), tile=CUT))


@query("n13_dering")
def n13_dering_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.chain(doubles(spark, d), [tiles.deringed()], RGB, CUT))


@query("n14_deblock")
def n14_deblock_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tiles.chain(doubles(spark, d), [tiles.deblocked()], RGB, CUT))


@query("n16_unsharp_bytes")
def n16_unsharp_bytes_by_tiles(spark: SparkSession, d: str) -> DataFrame:
    return tiles.chain(f1(spark, d).select("img", "y", "x", "r", "g", "b"), [tiles.unsharp_bytes()], dict.fromkeys("rgb", "int"), CUT)
