"""Rasters as pixel tables px(img, y, x, r, g, b).

The images here are derived from relational tables, so that every operator can be
checked on data that another engine derives too.  Real images come in through
``read_images``."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def area_fitted(px: DataFrame, cap: int = 16_000_000, key: str = "img") -> DataFrame:
    """px(key, w, h, y, x, r, g, b) of images above ``cap`` cells scaled down to it: width and height times sqrt(cap / cells), rounded
    down, each target cell the mean of what it covers by area.  Weights are whole numbers, so no order of sums matters."""
    w, h = F.col("w").cast("bigint"), F.col("h").cast("bigint")
    scale = F.sqrt(F.lit(float(cap)) / (w * h))
    to = lambda v: F.when(w * h > cap, F.greatest(F.lit(1), F.floor(v * scale))).otherwise(v).cast("bigint")
    p = px.withColumns({"tw": to(w), "th": to(h)})
    for at, n, m in (("x", "w", "tw"), ("y", "h", "th")):
        n_, m_ = F.col(n).cast("bigint"), F.col(m)
        p = p.withColumn(f"t{at}", F.explode(F.sequence(F.floor(F.col(at) * m_ / n_), F.floor(((F.col(at) + 1) * m_ - 1) / n_))))
        p = p.withColumn(f"c{at}", F.least((F.col(f"t{at}") + 1) * n_, (F.col(at) + 1) * m_) - F.greatest(F.col(f"t{at}") * n_, F.col(at) * m_))
    share = F.col("cx") * F.col("cy")
    sums = p.groupBy(key, "tw", "th", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x")).agg(*(F.sum(F.col(c) * share).alias(c) for c in "rgb"), F.sum(share).alias("all"))
    return sums.select(key, F.col("tw").cast("int").alias("w"), F.col("th").cast("int").alias("h"), "y", "x", *(F.floor(F.col(c) / F.col("all") + 0.5).cast("int").alias(c) for c in "rgb"))


def read_images(spark: SparkSession, path: str, cap: int = 16_000_000) -> DataFrame:
    """px of all images under ``path`` that Spark's decoder knows (JPEG and others; files.scan_png reads PNG by bands); images above ``cap`` cells
    are scaled down to it (area_fitted).  The decoder gives rows of BGR bytes."""
    raw = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    sized = raw.select(F.xxhash64("origin").alias("img"), F.col("width").alias("w"), F.col("height").alias("h"), "nChannels", "data")
    px = sized.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    at = lambda c: F.conv(F.hex(F.expr(f"substring(data, (y * w + x) * nChannels + {c}, 1)")), 16, 10).cast("int")
    gray = F.col("nChannels") == 1
    px = px.select("img", "w", "h", "y", "x", F.when(gray, at(1)).otherwise(at(3)).alias("r"), F.when(gray, at(1)).otherwise(at(2)).alias("g"), at(1).alias("b"))
    return area_fitted(px, cap).select("img", "y", "x", "r", "g", "b")


def png_plane(data: bytes) -> np.ndarray:
    """(h, w, 3) of a PNG of 8-bit gray, RGB or either with alpha (dropped), without interlace or palette."""
    w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", data[16:29])
    wide = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind, 0)
    if depth != 8 or interlace or not wide:
        raise ValueError(f"PNG of depth {depth}, kind {kind}, interlace {interlace}")
    body, at = b"", 8
    while at < len(data):
        (size,), tag = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body += data[at + 8 : at + 8 + size] if tag == b"IDAT" else b""
        at += size + 12
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * wide)
    out = np.zeros((h, w, wide), np.uint8)
    up = np.zeros((w, wide), np.int64)
    for y in range(h):
        how, row = int(raw[y, 0]), raw[y, 1:].reshape(w, wide).astype(np.int64)
        if how == 1:
            row = row.cumsum(axis=0)
        elif how == 2:
            row = row + up
        elif how >= 3:
            left, corner = np.zeros(wide, np.int64), np.zeros(wide, np.int64)
            for x in range(w):
                if how == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    near = np.abs(np.stack([p - left, p - up[x], p - corner]))
                    guess = np.choose(near.argmin(axis=0), [left, up[x], corner])
                left, corner = (row[x] + guess) & 255, up[x]
                row[x] = left
        up = row & 255
        out[y] = up
    return out[..., :3] if wide > 2 else np.repeat(out[..., :1], 3, axis=2)


def png_pixels(files: DataFrame) -> DataFrame:
    """files: (img, content binary) of PNG -> px, a batch per image; a null content has no pixels."""

    def run(batches):
        for b in batches:
            for img, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data is not None:
                    p = png_plane(data)
                    y, x = (v.ravel().astype(np.int32) for v in np.indices(p.shape[:2]))
                    yield pa.record_batch([pa.array(np.full(len(y), img, np.int64)), pa.array(y), pa.array(x), *(pa.array(p[..., c].ravel().astype(np.int32)) for c in range(3))], names=["img", "y", "x", "r", "g", "b"])

    return files.select(F.col("img").cast("bigint"), "content").mapInArrow(run, "img bigint, y int, x int, r int, g int, b int")


def _ch(v: Column) -> Column:
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((v.cast("double") + 0.6) * 212.5))).cast("int")


def _embedding_rows(spark: SparkSession, d: str) -> DataFrame:
    """(img, y, embedding): an image per label, a row per vector."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("label").alias("img"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "embedding")


def _row_cells(rows: DataFrame, side: int = 1) -> DataFrame:
    """The 64 cells of each row (img, y, embedding); ``side`` cells beside each other show the value of one."""
    px = rows.select("img", "y", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    at = lambda k: _ch(F.col("embedding")[F.pmod(F.floor(F.col("x") / side).cast("int") + k, F.lit(64))])
    return px.select("img", "y", "x", at(0).alias("r"), at(21).alias("g"), at(42).alias("b"))


def embedding_images(spark: SparkSession, d: str) -> DataFrame:
    """One image per label, a row per vector."""
    return _row_cells(_embedding_rows(spark, d))


def blocky_images(spark: SparkSession, d: str) -> DataFrame:
    """The embedding images in blocks of 6 x 6, without images of no label.

    A block's rows repeat one vector, so vectors are repeated and no cells are joined: Spark takes the size of cells for
    that of their vectors, and would send a whole image to the driver for such a join."""
    rows = _embedding_rows(spark, d).where("img IS NOT NULL").withColumn("h", F.count(F.lit(1)).over(Window.partitionBy("img")))
    first = F.col("y") * 6
    rows = rows.where(first < F.col("h"))
    return _row_cells(rows.select("img", F.explode(F.sequence(first, F.least(first + 5, F.col("h") - 1).cast("int"))).alias("y"), "embedding"), 6)


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """The embedding images with sky above, a patch of skin and texture below; their own channels are its noise."""
    p = embedding_images(spark, d)
    x, y = F.col("x"), F.col("y")
    sky, skin = y < 20, x.between(16, 47) & y.between(24, 44)
    r = F.when(sky, 80 + F.floor(x / 2) + F.col("r") % 3).when(skin, 200 + F.col("r") % 8).otherwise(40 + F.col("r") % 40)
    g = F.when(sky, 140 + y + F.col("g") % 3).when(skin, 140 + F.col("g") % 8).otherwise(90 + F.col("g") % 50)
    b = F.when(sky, 230 + F.col("b") % 3).when(skin, 110 + F.col("b") % 4).otherwise(50)
    return p.select("img", "y", "x", *(v.cast("int").alias(c) for v, c in ((r, "r"), (g, "g"), (b, "b"))))


def checkerboard(spark: SparkSession, w: int = 240, h: int = 136, cell: int = 6) -> DataFrame:
    p = spark.range(w * h).select((F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    v = F.when((F.floor(F.col("x") / cell) + F.floor(F.col("y") / cell)) % 2 == 0, 0).otherwise(255)
    return p.select(F.lit(0).alias("img"), "y", "x", *(v.alias(c) for c in "rgb"))


def swatches(spark: SparkSession, d: str) -> DataFrame:
    """A palette (brand, code, idx, r, g, b) of 25 colors."""
    brands = spark.read.parquet(f"{d}/part.parquet").select("p_brand").distinct()
    i = F.dense_rank().over(Window.orderBy("p_brand")) - 1
    return brands.select(F.lit("TST").alias("brand"), F.col("p_brand").alias("code"), i.cast("int").alias("idx")).select("brand", "code", "idx", *((F.col("idx") * k % 256).alias(c) for c, k in (("r", 53), ("g", 97), ("b", 193))))


def sizes(px: DataFrame) -> DataFrame:
    """(img, w, h), one row per image."""
    return px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
