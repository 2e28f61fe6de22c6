"""Boolean masks and their predicates on pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from .stencils import along_col, along_row, open_close


def above_quantile(px: DataFrame, col: str, p: float, out: str, floor: float | None = None, share: float = 1.0, below: bool = False) -> DataFrame:
    """out: col > max(floor, share * quantile) or col < quantile, per image.
    The quantile is interpolated; there is one row per image to join back."""
    q = px.groupBy("img").agg(F.percentile(col, F.lit(p)).alias("mq"))
    limit = F.col("mq") * share if floor is None else F.greatest(F.lit(floor), F.col("mq") * share)
    return px.join(q, "img").withColumn(out, F.col(col) < limit if below else F.col(col) > limit).drop("mq")


def edges(px: DataFrame, mag: str = "mag") -> DataFrame:
    return above_quantile(px, mag, 0.85, "edge", floor=0.02, share=0.5)


def flats(px: DataFrame) -> DataFrame:
    return above_quantile(px, "var7", 0.35, "flat", below=True)


def textures(px: DataFrame) -> DataFrame:
    return above_quantile(above_quantile(px, "var3", 0.7, "hitex_fine"), "var9", 0.7, "hitex_coarse")


def surfaces(px: DataFrame, mag: str = "mag") -> DataFrame:
    """edge, flat, hitex_fine and hitex_coarse at once: all quantiles in one aggregate, one row per image to join back."""
    q = px.groupBy("img").agg(F.percentile(mag, F.lit(0.85)).alias("q_edge"), F.percentile("var7", F.lit(0.35)).alias("q_flat"), F.percentile("var3", F.lit(0.7)).alias("q_fine"), F.percentile("var9", F.lit(0.7)).alias("q_coarse"))
    edge = F.col(mag) > F.greatest(F.lit(0.02), F.col("q_edge") * 0.5)
    masks = {"edge": edge, "flat": F.col("var7") < F.col("q_flat"), "hitex_fine": F.col("var3") > F.col("q_fine"), "hitex_coarse": F.col("var9") > F.col("q_coarse")}
    return px.join(q, "img").withColumns(masks).drop("q_edge", "q_flat", "q_fine", "q_coarse")


def skin(px: DataFrame) -> DataFrame:
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    _, cb, cr = C.ycbcr(r, g, b)
    rule = (r > 95) & (g > 40) & (b > 20) & (F.greatest(r, g, b) - F.least(r, g, b) > 15) & (F.abs(r - g) > 15) & (r > g) & (r > b) & cr.between(133, 173) & cb.between(77, 127)
    return open_close(px.withColumn("skin", rule.cast("int")), "skin").withColumn("skin", F.col("skin") == 1)


def sky(px: DataFrame) -> DataFrame:
    """Needs var7."""
    h, s, v = C.hsv(*(F.col(c) / 255.0 for c in "rgb"), least=1e-5)
    q = px.groupBy("img").agg(F.percentile("var7", F.lit(0.5)).alias("mq"))
    rule = (h * 360).between(190, 250) & s.between(0.1, 0.8) & (v >= 0.55) & (F.col("var7") <= F.col("mq"))
    return open_close(px.join(q, "img").withColumn("sky", rule.cast("int")).drop("mq"), "sky").withColumn("sky", F.col("sky") == 1)


def step_edges(px: DataFrame, lum: str, least: float = 0.04) -> DataFrame:
    """Difference to the left neighbour; interior only.  Needs w and h."""
    inner = F.col("x").between(1, F.col("w") - 2) & F.col("y").between(1, F.col("h") - 2)
    return px.withColumn("edge", inner & (F.abs(F.col(lum) - F.lag(lum).over(along_row())) > least))


def ranked_edges(px: DataFrame, lum: str = "l") -> DataFrame:
    """Integer gradients at least as large as the element at 85 % of their sorted list (the
    least positive one if that is 0); interior only.  Needs w and h.

    The element is found from counts per gradient size: a bounded number of rows
    per image (at most 511), never a sort of all pixels."""
    grad = F.abs(F.col(lum) - F.lag(lum).over(along_row())) + F.abs(F.col(lum) - F.lag(lum).over(along_col()))
    p = px.withColumn("grad", grad)
    hist = p.where("grad IS NOT NULL").groupBy("img", "grad").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("img").orderBy("grad")
    every = Window.partitionBy("img")
    hist = hist.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(every)})
    pos = F.least(F.floor(F.col("all") * 0.85), F.col("all") - 1)
    limit = hist.groupBy("img").agg(F.min(F.when((F.col("upto") > pos) & (F.col("grad") > 0), F.col("grad"))).alias("thr"))
    inner = F.col("x").between(1, F.col("w") - 2) & F.col("y").between(1, F.col("h") - 2)
    return p.join(limit, "img", "left").withColumn("edge", F.coalesce(inner & (F.col("grad") >= F.col("thr")), F.lit(False))).drop("grad", "thr")


#: Levels by rising weight (fixed values).
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR")


def level_passes(level: str, least: str):
    at = F.array(*map(F.lit, LEVELS))
    return F.array_position(at, F.col(level)) >= LEVELS.index(least) + 1
