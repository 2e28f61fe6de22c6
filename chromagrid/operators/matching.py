"""Nearest-color and catalog matching.

Pixels are many and colors few: colors are made distinct first, matched against the
palette, and joined back.  Large palettes get an index of the color cube.  Catalogs of at most a few thousand rows (checked by
``small``) are broadcast; anything larger is joined without a hint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C

#: Rows up to which a palette or catalog counts as small.
SMALL = 4096
RGB = ("r", "g", "b")


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has at most SMALL rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def with_oklab(df: DataFrame, prefix: str = "ok", clamped: bool = True) -> DataFrame:
    lab = C.oklab(*(F.col(c) for c in RGB), clamped=clamped)
    return df.withColumns({f"{prefix}_{n}": v for n, v in zip("lab", lab, strict=True)})


#: Entries from which a palette gets an index of the color cube, and entries of a part of it.
CUBE_FROM, CUBE_ENTRIES = 128, 1 << 20


def cell_box(cell: int, bits: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest keys of the colors in a cell of the cube, ``bits`` bits a channel."""
    side = 256 >> bits
    low = np.array([cell >> k * bits & (1 << bits) - 1 for k in (2, 1, 0)], np.float64) * side
    if metric == "rgb":
        return low, low + side - 1
    unit = (low[:, None] + np.arange(side)) / 255.0
    linear = np.where(unit <= 0.04045, unit / 12.92, ((unit + 0.055) / 1.055) ** 2.4)
    every = np.stack(np.meshgrid(*linear, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = np.cbrt(every @ np.array(C.LMS).T) @ np.array(C.OK).T
    return keys.min(axis=0), keys.max(axis=0)


def possible(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places of the entries that can be nearest to something in a box: no farther from it, at best, than some entry is
    at worst.  Distances are rounded to 12 digits before ties are looked at, hence the margin."""
    worst = (np.maximum(np.abs(keys - low), np.abs(keys - high)) ** 2).sum(axis=1).min()
    return np.flatnonzero((np.maximum(np.maximum(low - keys, keys - high), 0) ** 2).sum(axis=1) <= worst + 1e-9)


def cube_index(own: DataFrame, pal: DataFrame, names: list[str], metric: str) -> DataFrame:
    """(cell, pal): for each of the 32,768 cells of the color cube that ``own`` has a color in, the palette entries that can be
    nearest there, found within those of the 512 larger cells around them.

    The entries go to the tasks as one array, CUBE_ENTRIES at most (32 MB); ``pal`` is such a part of a palette."""
    rows = pal.select("idx", *names).collect()
    sent = own.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1:] for r in rows], np.float64).reshape(len(rows), 3)))
    entry = pa.struct([("idx", pa.int64()), *((n, pa.float64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idx, keys = sent.value
        around: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        for batch in batches:
            cells, lists = [], []
            for coarse, cell in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if coarse != around[0]:
                    around = coarse, possible(keys, *cell_box(coarse, 3, metric))
                at = around[1][possible(keys[around[1]], *cell_box(cell, 5, metric))]
                cells.append(cell)
                lists.append(at)
            sizes = np.cumsum([0, *map(len, lists)])
            at = np.concatenate(lists) if lists else np.zeros(0, np.int64)
            flat = pa.StructArray.from_arrays([pa.array(idx[at]), *(pa.array(keys[at, k]) for k in range(3))], fields=list(entry))
            yield pa.record_batch([pa.array(cells, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)], names=["cell", "pal"])

    cells = own.select(_coarse().alias("coarse"), _cell().alias("cell")).distinct()
    dealt = cells.repartition("coarse").sortWithinPartitions("coarse", "cell")
    return dealt.mapInArrow(run, f"cell int, pal array<struct<idx: bigint, {', '.join(f'{n}: double' for n in names)}>>")


def _cell() -> Column:
    return (F.shiftleft(F.shiftright("r", 3), 10) + F.shiftleft(F.shiftright("g", 3), 5) + F.shiftright("b", 3)).cast("int")


def _coarse() -> Column:
    return (F.shiftleft(F.shiftright("r", 5), 6) + F.shiftleft(F.shiftright("g", 5), 3) + F.shiftright("b", 5)).cast("int")


def nearest(colors: DataFrame, palette: DataFrame, metric: str = "rgb") -> DataFrame:
    """(r, g, b, idx, d): for each distinct color the palette row of least squared distance,
    the first of equals.  metric: rgb (8-bit) or oklab.

    A palette of up to CUBE_FROM entries is one array that each color looks through; of a larger one a color
    looks at the entries only that can be nearest in its cell of the color cube.  No row is made for a pair."""
    own = colors.select(*RGB).distinct()
    keys, pal = RGB, palette.select("idx", *RGB)
    if metric == "oklab":
        own, pal, keys = with_oklab(own), with_oklab(pal), ("ok_l", "ok_a", "ok_b")
    pal = pal.select("idx", *(F.col(c).alias(f"p_{c}") for c in keys))
    exact = (lambda d: F.round(d, 12)) if metric == "oklab" else (lambda d: d)
    mine = tuple(F.col(c) for c in keys)
    near = F.array_min(F.transform("pal", lambda p: F.struct(exact(C.squared(mine, tuple(p[f"p_{c}"] for c in keys))).alias("d"), p["idx"].alias("idx"))))
    n = palette.count()
    if n <= CUBE_FROM:
        best = own.join(F.broadcast(pal.agg(F.collect_list(F.struct(*pal.columns)).alias("pal"))), F.lit(True)).select(*RGB, near.alias("m"))
    else:
        names, parts = [f"p_{c}" for c in keys], -(-n // CUBE_ENTRIES)
        found = []
        for i in range(parts):  # a palette has 2 ** 24 colors at most
            index = cube_index(own, pal.where(F.pmod(F.xxhash64("idx"), F.lit(parts)) == i), names, metric)
            found.append(own.withColumn("cell", _cell()).join(index, "cell").select(*RGB, near.alias("m")))
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        best = best.groupBy(*RGB).agg(F.min("m").alias("m")) if parts > 1 else best
    kind = palette.schema["idx"].dataType
    whole = "long" if metric == "rgb" else "double"
    return best.where("m IS NOT NULL").select(*RGB, F.col("m.idx").cast(kind).alias("idx"), F.col("m.d").cast(whole).alias("d"))


def indexed(px: DataFrame, palette: DataFrame, metric: str = "rgb") -> DataFrame:
    """``px`` with idx of the nearest palette color and its squared distance d."""
    return px.join(nearest(px, palette, metric), list(RGB))


def recolored(px: DataFrame, centers: DataFrame, allowed: DataFrame) -> DataFrame:
    """Each pixel gets the allowed color (OKLab) of its nearest center (OKLab)."""
    to = nearest(centers, allowed, "oklab").select(*(F.col(c).alias(f"c_{c}") for c in RGB), F.col("idx").alias("to"))
    to = centers.select("idx", *(F.col(c).alias(f"c_{c}") for c in RGB)).join(to, [f"c_{c}" for c in RGB]).select("idx", "to")
    new = allowed.select(F.col("idx").alias("to"), *(F.col(c).alias(f"n_{c}") for c in RGB))
    return indexed(px, centers, "oklab").join(small(to), "idx").join(small(new), "to").select("img", "y", "x", *(F.col(f"n_{c}").alias(c) for c in RGB))


def assigned_error(px: DataFrame, palette: DataFrame, weight: Column) -> DataFrame:
    """Sum of squared OKLab distance times weight per image."""
    return indexed(px, palette, "oklab").groupBy("img").agg(F.sum(F.col("d") * weight).alias("error"))


def thread_statistics(px: DataFrame, swatches: DataFrame, limit: int = 50, fabric: int = 14, strands: int = 2, waste: int = 10, described: bool = False) -> DataFrame:
    """Per image the swatches used: count, whole percent, metres of thread; the ``limit`` most used.  ``described``: also the
    swatch's name, hex code and color."""
    counts = px.groupBy("img", *RGB).agg(F.count(F.lit(1)).alias("n"))
    per = counts.join(nearest(counts, swatches, "oklab").select(*RGB, "idx"), list(RGB)).groupBy("img", "idx").agg(F.sum("n").alias("count"))
    every = Window.partitionBy("img")
    rank = F.row_number().over(every.orderBy(F.desc("count"), "idx"))
    per = per.withColumns({"percent": F.floor(F.col("count") * 100 / F.sum("count").over(every)), "rank": rank}).where(F.col("rank") <= limit)
    metres = C.thread_metres(F.col("count"), F.lit(float(fabric)), F.lit(float(strands)), F.lit(float(waste)))
    more = ["name", C.hex_of(*(F.col(c) for c in RGB)).alias("hex"), *RGB] if described else []
    return per.join(small(swatches.select("idx", "code", *(["name", *RGB] if described else []))), "idx").select("img", "rank", "code", *more, "count", "percent", F.round(metres, 4).alias("metres"))


def hex_statistics(px: DataFrame, limit: int = 50) -> DataFrame:
    """Thread statistics without a palette: per image its ``limit`` commonest colors by their hex code
    (of equal counts the least), which is also the name; whole percent."""
    per = px.groupBy("img", *RGB).agg(F.count(F.lit(1)).alias("count"))
    every = Window.partitionBy("img")
    code = C.hex_of(*(F.col(c) for c in RGB))
    rank = F.row_number().over(every.orderBy(F.desc("count"), "r", "g", "b"))
    per = per.withColumns({"percent": F.floor(F.col("count") * 100 / F.sum("count").over(every)), "rank": rank}).where(F.col("rank") <= max(1, limit))
    return per.select("img", "rank", code.alias("code"), code.alias("name"), *RGB, "count", "percent")


def remapped(px: DataFrame, lut: DataFrame, quant_size: int, legend_size: int) -> DataFrame:
    """px(img, y, x, idx) with idx through lut(idx, to).

    Errors: sizes that differ (at once); an index that the table lacks; an image of several indexes
    that would be left with one (when the result is read)."""
    if not quant_size or quant_size != legend_size:
        raise ValueError(f"legend of {legend_size} colors for {quant_size}")
    p = px.join(small(lut.select("idx", "to")), "idx", "left")
    ends = p.groupBy(F.col("img").alias("of")).agg((F.min("idx") < F.max("idx")).alias("many"), (F.min("to") == F.max("to")).alias("one"))
    p = p.join(ends, F.col("img") == F.col("of"))
    out = F.raise_error(F.concat(F.lit("index out of range: "), F.col("idx").cast("string"))).cast("int")
    same = F.raise_error(F.concat(F.lit("indexes collapse in image "), F.col("img").cast("string"))).cast("int")
    return p.select("img", "y", "x", F.when(F.col("to").isNull(), out).when(F.col("many") & F.col("one"), same).otherwise(F.col("to")).alias("idx"))


def candidates(palette: DataFrame, catalog: DataFrame, space: str, top: int) -> DataFrame:
    """(idx, rank, code, d): the ``top`` catalog colors nearest to each palette color."""
    fn = C.cielab if space == "lab" else lambda *c: C.oklab(*c, clamped=True)
    p = palette.select("idx", *(v.alias(f"p{n}") for n, v in zip("lab", fn(*(F.col(c) for c in RGB)), strict=True)))
    q = catalog.select("code", *(v.alias(f"q{n}") for n, v in zip("lab", fn(*(F.col(c) for c in RGB)), strict=True)))
    d = F.round(C.distance(tuple(F.col(f"p{n}") for n in "lab"), tuple(F.col(f"q{n}") for n in "lab")), 9)
    rank = F.row_number().over(Window.partitionBy("idx").orderBy("d", "code"))
    return p.join(small(q), F.lit(True)).withColumn("d", d).withColumn("rank", rank).where(F.col("rank") <= top).select("idx", "rank", "code", "d")


def matched(palette: DataFrame, catalog: DataFrame, space: str = "lab", max_blends: int = 4, penalty: float = 0.1, top: int = 6) -> DataFrame:
    """(idx, type, code_a, code_b, de): best single color, or a 1:1 blend of two of the nearest.

    space "lab": 8-bit mean, two different colors, accepted if de (1 + penalty) + 1e-9 < single.
    space "ok": OKLab mean, accepted if de < 0.8 single.  The first ``max_blends`` acceptable
    blends by idx are used."""
    near = candidates(palette, catalog, space, top)
    rgb = catalog.select("code", *RGB)
    a = near.join(small(rgb), "code").select("idx", *(F.col(c).alias(f"{c}_a") for c in ("rank", "code", "d", *RGB)))
    b = near.join(small(rgb), "code").select("idx", *(F.col(c).alias(f"{c}_b") for c in ("rank", "code", *RGB)))
    own = palette.select("idx", *(F.col(c) for c in RGB))
    first = F.col("rank_a") < F.col("rank_b") if space == "lab" else F.col("rank_a") <= F.col("rank_b")
    pairs = a.join(b, "idx").where(first).join(own, "idx")
    if space == "lab":
        mix = C.cielab(*(C.mean_byte(F.col(f"{c}_a"), F.col(f"{c}_b")) for c in RGB))
        target = C.cielab(*(F.col(c) for c in RGB))
    else:
        labs = [C.oklab(*(F.col(f"{c}_{s}") for c in RGB), clamped=True) for s in "ab"]
        mix = tuple((p + q) / 2 for p, q in zip(*labs, strict=True))
        target = C.oklab(*(F.col(c) for c in RGB), clamped=True)
    de = F.round(C.distance(target, mix), 9)
    best = pairs.groupBy("idx").agg(F.min(F.struct(de.alias("de"), "rank_a", "rank_b", "code_a", "code_b")).alias("m"))
    single = near.where("rank = 1").select("idx", F.col("code").alias("one"), F.col("d").alias("single"))
    both = single.join(best, "idx", "left")
    ok = F.col("m.de") * (1 + penalty) + 1e-9 < F.col("single") if space == "lab" else F.col("m.de") < F.col("single") * 0.8
    both = both.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # the palette has few rows: a running count over idx
    used = F.sum(F.col("ok").cast("int")).over(Window.orderBy("idx"))
    blend = F.col("ok") & (used <= max_blends)
    return both.withColumn("blend", blend).select("idx", F.when(F.col("blend"), "blend").otherwise("single").alias("type"), F.when(F.col("blend"), F.col("m.code_a")).otherwise(F.col("one")).alias("code_a"), F.when(F.col("blend"), F.col("m.code_b")).alias("code_b"), F.when(F.col("blend"), F.col("m.de")).otherwise(F.col("single")).alias("de"))


def match_summary(entries: DataFrame) -> DataFrame:
    return entries.agg(C.round2(F.avg("de")).alias("avg_de"), C.round2(F.max("de")).alias("max_de"), F.count_if(F.col("type") == "blend").alias("blends"))


def resolved(palette_size: int, entries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(idx, r, g, b) of each entry by its codes; any idx without entry, entry out of
    range or unknown code raises an error when the result is read."""
    q = catalog.select("code", *RGB)
    one = entries.join(small(q.select(F.col("code").alias("code_a"), *(F.col(c).alias(f"{c}_a") for c in RGB))), "code_a", "left")
    two = one.join(small(q.select(F.col("code").alias("code_b"), *(F.col(c).alias(f"{c}_b") for c in RGB))), "code_b", "left")
    known = F.col("r_a").isNotNull() & (F.col("code_b").isNull() | F.col("r_b").isNotNull()) & F.col("idx").between(0, palette_size - 1)
    every = entries.sparkSession.range(palette_size).select(F.col("id").cast("int").alias("idx"))
    full = every.join(two.withColumn("known", known), "idx", "full")
    value = lambda c: F.when(F.col("code_b").isNull(), F.col(f"{c}_a")).otherwise(C.mean_byte(F.col(f"{c}_a"), F.col(f"{c}_b")))
    strict = lambda v: F.when(F.coalesce(F.col("known"), F.lit(False)), v).otherwise(F.raise_error(F.concat(F.lit("unresolved entry "), F.col("idx").cast("string"))).cast("int"))
    return full.select("idx", *(strict(value(c)).alias(c) for c in RGB))


def legend(palette: DataFrame, entries: DataFrame, symbols: DataFrame, brand: str) -> DataFrame:
    """Palette rows with their catalog match (null if unmapped) and symbol."""
    e = entries.select("idx", "type", "code_a", "code_b")
    return palette.select("idx", C.hex_of(*(F.col(c) for c in RGB)).alias("rgb")).join(e, "idx", "left").join(symbols, "idx", "left").select("idx", "rgb", F.coalesce("symbol", F.lit("?")).alias("symbol"), F.when(F.col("type").isNotNull(), F.lit(brand)).alias("brand"), "type", F.col("code_a").alias("code"), "code_b")


def pages_of_cells(px: DataFrame, page_w: int, page_h: int, overlap: int) -> DataFrame:
    """(img, page_y, page_x, y, x, ...): every cell on each page that shows it.

    px needs w and h.  Pages repeat ``overlap`` cells of the page before.  The pages of a cell follow from
    arithmetic, so the range join is an explode of at most a few numbers per axis."""

    def axis(at: str, size: int, whole: str) -> Column:
        step = max(1, size - overlap)
        pages = F.greatest(F.lit(1), F.ceil((F.col(whole) - overlap) / step))
        last = F.least(F.floor(F.col(at) / step), pages - 1)
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / step))
        return F.sequence(first.cast("int"), last.cast("int"))

    p = px.withColumn("page_x", F.explode(axis("x", page_w, "w")))
    return p.withColumn("page_y", F.explode(axis("y", page_h, "h")))


def auto_levels(px: DataFrame) -> DataFrame:
    """Each channel stretched to 0..255 per image."""
    ends = px.groupBy("img").agg(*(f(c).alias(f"{n}_{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))))
    scale = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), 255.0 / (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).otherwise(1.0)
    return px.join(ends, "img").select("img", "y", "x", *(C.clamp(C.half_up((F.col(c) - F.col(f"lo_{c}")) * scale(c)).cast("double"), 0, 255).cast("int").alias(c) for c in RGB))
