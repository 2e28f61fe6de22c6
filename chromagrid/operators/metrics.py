"""Aggregates of pixel tables: one row per image unless stated otherwise.

Empty inputs: a percentile of nothing is 0, a share of nothing is 0, an edge-keep ratio
without reference edges is 1, a banding index without gradients is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from .stencils import along_col, along_row, extreme


def share(c: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0.0))


def luma_statistics(px: DataFrame) -> DataFrame:
    """Median, p99 - p1, shares clipped low and high; needs luma in 0..1."""
    q = F.percentile("luma", F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    got = px.groupBy("img").agg(q.alias("q"), share(F.col("luma") <= 0.01).alias("clip_low"), share(F.col("luma") >= 0.99).alias("clip_high"))
    return got.select("img", F.coalesce(F.col("q")[1], F.lit(0.0)).alias("median"), F.coalesce(F.col("q")[2] - F.col("q")[0], F.lit(0.0)).alias("dynamic_range"), "clip_low", "clip_high")


def color_cast(px: DataFrame) -> DataFrame:
    return px.groupBy("img").agg(F.sqrt(F.avg(F.col("ok_a") * F.col("ok_a")) + F.avg(F.col("ok_b") * F.col("ok_b"))).alias("color_cast"))


def median_deviation(px: DataFrame, cols: list[str]) -> DataFrame:
    """Median of |v - median| for each column: two passes, one row per image between."""
    mid = px.groupBy("img").agg(*(F.percentile(c, F.lit(0.5)).alias(f"md_{c}") for c in cols))
    return px.join(mid, "img").groupBy("img").agg(*(F.percentile(F.abs(F.col(c) - F.col(f"md_{c}")), F.lit(0.5)).alias(f"mad_{c}") for c in cols))


def masked_percentile(px: DataFrame, col: str, mask: str, p: float, out: str) -> DataFrame:
    return px.groupBy("img").agg(F.coalesce(F.percentile(F.when(F.col(mask), F.col(col)), F.lit(p)), F.lit(0.0)).alias(out))


def color_coverage(px: DataFrame, key: Column, top: int = 8) -> DataFrame:
    """Number of different colors and the share of the ``top`` most frequent.

    Counts per color come first, so a window sees one row per color, not per pixel."""
    hist = px.groupBy("img", key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("img").orderBy(F.desc("n"), "key"))
    return hist.withColumn("rank", rank).groupBy("img").agg(F.count(F.lit(1)).alias("colors"), (F.sum(F.when(F.col("rank") <= top, F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))


def haze(px: DataFrame, r: int = 7) -> DataFrame:
    """1 - mean of the smallest channel's minimum over 15 x 15."""
    dark = extreme(px.withColumn("dark", F.least("r", "g", "b") / 255.0), "dark", r, True, "dark_min")
    return dark.groupBy("img").agg((1 - F.avg("dark_min")).alias("haze"))


def checker_share(px: DataFrame) -> DataFrame:
    """Share of 2 x 2 blocks of two colors at most."""
    p = px.withColumn("c", C.pack_argb(F.col("r"), F.col("g"), F.col("b")))
    p = p.withColumn("e", F.lead("c").over(along_row())).withColumns({"s": F.lead("c").over(along_col()), "se": F.lead("e").over(along_col())})
    few = F.size(F.array_distinct(F.array("c", "e", "s", "se"))) <= 2
    return p.where("e IS NOT NULL AND s IS NOT NULL").groupBy("img").agg(share(few).alias("checker"))


def index_statistics(px: DataFrame, col: str = "idx", cap: int = 4096) -> DataFrame:
    return px.groupBy("img").agg(F.min(col).alias("least"), F.max(col).alias("most"), F.least(F.lit(cap), F.count_distinct(col)).alias("distinct"))


def cluster_means(px: DataFrame, palette: DataFrame) -> DataFrame:
    """Mean color per index by integer division; indices without pixels keep the palette's."""
    k = palette.select("idx", *(F.col(c).alias(f"p_{c}") for c in "rgb"))
    sums = px.groupBy("idx").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s_{c}") for c in "rgb"))
    return k.join(sums, "idx", "left").select("idx", *(F.coalesce(F.floor(F.col(f"s_{c}") / F.col("n")).cast("int"), F.col(f"p_{c}")).alias(c) for c in "rgb"))


def worst_cluster(px: DataFrame) -> DataFrame:
    """The cluster of the largest mean weighted error; needs idx and err."""
    per = px.groupBy("img", "idx").agg((F.sum("err") / F.count(F.lit(1))).alias("m"))
    return per.groupBy("img").agg(F.min(F.struct((-F.round("m", 9)).alias("k"), F.col("idx"))).alias("w")).select("img", F.col("w.idx").alias("idx"))


def palette_separation(palette: DataFrame) -> DataFrame:
    """Least and upper-median OKLab distance of a palette (idx, r, g, b); at most a few hundred rows."""
    lab = palette.select("idx", *(v.alias(n) for n, v in zip(("l", "a", "b2"), C.oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    p, q = lab.select(*(F.col(c).alias(f"{c}1") for c in lab.columns)), lab.select(*(F.col(c).alias(f"{c}2") for c in lab.columns))
    d = C.distance(tuple(F.col(f"{c}1") for c in ("l", "a", "b2")), tuple(F.col(f"{c}2") for c in ("l", "a", "b2")))
    pairs = p.join(q, F.col("idx1") < F.col("idx2")).select(d.alias("d"))
    ranked = pairs.withColumns({"k": F.row_number().over(Window.orderBy("d")), "n": F.count(F.lit(1)).over(Window.partitionBy())})
    return ranked.agg(F.min("d").alias("de_min"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("d"))).alias("de_med"))


def similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Single-window SSIM of luma in 0..1 of two planes with equal keys, within 0..1."""
    both = a.select("img", "y", "x", F.col("luma").alias("p")).join(b.select("img", "y", "x", F.col("luma").alias("q")), ["img", "y", "x"])
    m = both.groupBy("img").agg(F.avg("p").alias("mp"), F.avg("q").alias("mq"), F.var_samp("p").alias("vp"), F.var_samp("q").alias("vq"), F.covar_samp("p", "q").alias("cv"))
    c1, c2 = 0.0001, 0.0009
    s = (2 * F.col("mp") * F.col("mq") + c1) * (2 * F.col("cv") + c2) / ((F.col("mp") * F.col("mp") + F.col("mq") * F.col("mq") + c1) * (F.col("vp") + F.col("vq") + c2))
    return m.select("img", C.clamp(s, 0, 1).alias("ssim"))


def edge_rate(px: DataFrame, out: str) -> DataFrame:
    d = F.abs(F.col("luma") - F.lag("luma").over(along_row()))
    return px.withColumn("er", d).where("er IS NOT NULL").groupBy("img").agg(share(F.col("er") > 0.03).alias(out))


def edge_keep(ref: DataFrame, out: DataFrame) -> DataFrame:
    both = edge_rate(ref, "e_ref").join(edge_rate(out, "e_out"), "img")
    return both.select("img", F.when(F.col("e_ref") <= 1e-8, 1.0).otherwise(C.clamp(F.col("e_out") / F.col("e_ref"), 0, 1.5)).alias("edge_keep"))


def banding(ref: DataFrame, out: DataFrame) -> DataFrame:
    step = lambda df, n: df.select("img", "y", "x", F.abs(F.lead("luma").over(along_row()) - F.lag("luma").over(along_row())).alias(n))
    both = step(ref, "gr").join(step(out, "go"), ["img", "y", "x"])
    n = F.count_if(F.col("gr") > 0.01)
    return both.groupBy("img").agg(F.when(n == 0, 0.0).otherwise(F.count_if((F.col("gr") > 0.01) & (F.col("go") < 0.003)) / n).alias("banding"))


def delta_e95(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element at place floor(0.95 n) of the sorted OKLab distances (channels in 0..1)."""
    lab = lambda df, s: df.select("img", "y", "x", *(v.alias(f"{n}{s}") for n, v in zip("lmn", C.oklab_of_linear((F.col("r"), F.col("g"), F.col("b")), True), strict=True)))
    d = lab(a, "1").join(lab(b, "2"), ["img", "y", "x"]).withColumn("d", C.distance(tuple(F.col(f"{n}1") for n in "lmn"), tuple(F.col(f"{n}2") for n in "lmn")))
    return at_place(d, "d", 0.95).withColumnRenamed("at", "de95")


def at_place(px: DataFrame, col: str, share: float) -> DataFrame:
    """(img, at): the element of ``col`` (0 or more) at place floor(share n) of its sorted list, the last at most.

    Found from counts: first per 1/65536 of a unit, then per value within the one bin that holds the
    place, so no image is collected or sorted as a whole."""
    values = px.groupBy("img", F.floor(F.col(col) * 65536).alias("bin"), F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    bins = values.groupBy("img", "bin").agg(F.sum("n").alias("m"))
    bins = bins.withColumns({"upto": F.sum("m").over(Window.partitionBy("img").orderBy("bin")), "all": F.sum("m").over(Window.partitionBy("img"))})
    place = F.least(F.floor(F.col("all") * share), F.col("all") - 1)
    hit = bins.where((F.col("upto") > place) & (F.col("upto") - F.col("m") <= place)).select("img", "bin", (place - F.col("upto") + F.col("m")).alias("rest"))
    near = values.join(hit, ["img", "bin"]).withColumn("run", F.sum("n").over(Window.partitionBy("img").orderBy("v")))
    return near.where("run > rest").groupBy("img").agg(F.min("v").alias("at"))


def edge_energy(px: DataFrame, ringing: bool = False) -> DataFrame:
    """Sum of horizontal luma steps, interior only; needs h, w.

    The described ringing term compares a step with one of zero and so is never counted.
    ``ringing=True`` takes off a tenth for each local extremum of three cells in a row."""
    step = F.abs(F.col("luma") - F.col("l1"))
    p = px.withColumns({"l1": F.lag("luma").over(along_row()), "l2": F.lag("luma", 2).over(along_row())})
    inner = F.col("y").between(1, F.col("h") - 2) & F.col("x").between(1, F.col("w") - 2)
    rings = F.count_if((F.col("x") > 1) & ((F.col("l1") - F.col("luma")) * (F.col("l1") - F.col("l2")) > 0)) if ringing else F.lit(0)
    return p.where(inner).groupBy("img").agg((F.sum(step) - 0.2 * 0.5 * rings).alias("energy"))


def blockiness(px: DataFrame) -> DataFrame:
    """Mean luma step across 8-pixel boundaries: columns, rows, both."""
    p = px.withColumns({"bv": F.when((F.col("x") % 8 == 0) & (F.col("x") > 0), F.abs(F.col("luma") - F.lag("luma").over(along_row()))), "bh": F.when((F.col("y") % 8 == 0) & (F.col("y") > 0), F.abs(F.col("luma") - F.lag("luma").over(along_col())))})
    v, h = F.coalesce(F.avg("bv"), F.lit(0.0)), F.coalesce(F.avg("bh"), F.lit(0.0))
    return p.groupBy("img").agg(v.alias("vertical"), h.alias("horizontal"), ((v + h) * 0.5).alias("both"))


def thread_changes(px: DataFrame, col: str = "idx") -> DataFrame:
    p = px.withColumn("before", F.lag(col).over(along_row()))
    return p.groupBy("img").agg((F.count_if(F.col(col) != F.col("before")) * 100.0 / F.count(F.lit(1))).alias("changes_per_100"))


def small_islands(px: DataFrame, col: str = "idx") -> DataFrame:
    """4-connected areas of one or two cells per 1000: cells without an equal neighbour, and pairs
    of cells that have each other alone.  No components are needed."""
    eq = {k: F.coalesce((f(col).over(w) == F.col(col)).cast("int"), F.lit(0)) for k, f, w in (("e", F.lead, along_row()), ("w", F.lag, along_row()), ("s", F.lead, along_col()), ("n", F.lag, along_col()))}
    p = px.withColumns({f"q_{k}": v for k, v in eq.items()}).withColumn("deg", F.col("q_e") + F.col("q_w") + F.col("q_s") + F.col("q_n"))
    mate = F.when(F.col("q_e") == 1, F.lead("deg").over(along_row())).when(F.col("q_w") == 1, F.lag("deg").over(along_row())).when(F.col("q_s") == 1, F.lead("deg").over(along_col())).otherwise(F.lag("deg").over(along_col()))
    p = p.withColumn("mate", F.when(F.col("deg") == 1, mate))
    return p.groupBy("img").agg(((F.count_if(F.col("deg") == 0) + F.count_if(F.col("mate") == 1) / 2) * 1000.0 / F.count(F.lit(1))).alias("islands_per_1000"))


def runs(px: DataFrame, col: str = "idx") -> DataFrame:
    """Horizontal runs: (img, y, run, start, length, value)."""
    p = px.withColumn("new", F.coalesce((F.col(col) != F.lag(col).over(along_row())).cast("int"), F.lit(1)))
    p = p.withColumn("run", F.sum("new").over(along_row()))
    return p.groupBy("img", "y", "run").agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("length"), F.min(col).alias("value"))


def run_median(px: DataFrame, col: str = "idx") -> DataFrame:
    return runs(px, col).groupBy("img").agg(F.percentile("length", F.lit(0.5)).alias("run_median"))


def planes_equal(a: DataFrame, b: DataFrame, cols: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """Per image of either side: same pixels with the same values."""
    q = b.select("img", "y", "x", *(F.col(c).alias(f"q_{c}") for c in cols), F.lit(1).alias("there"))
    both = a.withColumn("here", F.lit(1)).join(q, ["img", "y", "x"], "full")
    same = F.col("here").isNotNull() & F.col("there").isNotNull()
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"q_{c}"))
    return both.groupBy("img").agg((F.count_if(~same) == 0).alias("equal"))


def two_center_means(px: DataFrame, a: tuple, b: tuple) -> DataFrame:
    """One weighted Lloyd step between two OKLab centers over all pixels: mean by weight and by count."""
    cols = ("ok_l", "ok_a", "ok_b")
    d = lambda q: F.round(C.squared(tuple(F.col(c) for c in cols), tuple(F.lit(float(v)) for v in q)), 12)
    p = px.withColumn("pick", F.when(d(a) <= d(b), 0).otherwise(1))
    out = [x for c in cols for x in ((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c[3:]), (F.sum(F.col(c) * F.col("w")) / F.count(F.lit(1))).alias(f"by_count_{c[3:]}"))]
    return p.groupBy("img", "pick").agg(*out)
