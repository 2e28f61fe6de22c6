"""What is written: index maps, palettes, legends, presets, logs, page and render plans.

Writers of pictures are split: the plan (cells, colors, symbols, pages) is relational, the
bytes of a picture format are left to an external rasteriser."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import hex_of, luma709, pale
from ..operators import matching

#: Symbols in the order of assignment (fixed values): shapes, then letters and digits.
SHAPES = "●○■□▲△▼▽◆◇★☆✚✖✦✧◐◑◒◓◔◕◼◻◈◉◍◎⬟⬢⬣⬤"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def index_bytes(px: DataFrame, k: int = 256) -> DataFrame:
    """(img, cells, content): one byte per cell in row order, clamped to 0..k-1."""
    one = F.struct("x", F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(min(k, 256) - 1), F.col("idx")))), 2, "0").alias("h"))
    # a row of the image first, so that an image's group holds a string per row and no struct per cell
    rows = px.groupBy("img", "y").agg(F.sort_array(F.collect_list(one)).alias("a"))
    rows = rows.select("img", F.struct("y", F.array_join(F.transform("a", lambda s: s["h"]), "").alias("h")).alias("row"))
    whole = rows.groupBy("img").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda s: s["h"]), "")).alias("content"))
    return whole.select("img", F.octet_length("content").alias("cells"), "content")


def recolored(px: DataFrame, palette: DataFrame, k: int) -> DataFrame:
    """Cells with their palette color; indices are clamped to the palette."""
    p = px.select("img", "y", "x", F.greatest(F.lit(0), F.least(F.lit(k - 1), F.col("idx"))).alias("idx"))
    return p.join(palette.select("idx", "r", "g", "b"), "idx").select("img", "y", "x", "r", "g", "b")


def palette_json(palette: DataFrame) -> DataFrame:
    c = F.sort_array(F.collect_list(F.struct("idx", hex_of(F.col("r"), F.col("g"), F.col("b")).alias("c"))))
    return palette.agg(F.to_json(F.struct(F.count(F.lit(1)).alias("k"), F.transform(c, lambda s: s["c"]).alias("colors"))).alias("json"))


def matches_json(entries: DataFrame, brand: str) -> DataFrame:
    e = F.struct("idx", "type", F.when(F.col("type") == "single", F.col("code_a")).alias("code"), F.when(F.col("type") == "blend", F.col("code_a")).alias("codeA"), F.when(F.col("type") == "blend", F.col("code_b")).alias("codeB"))
    return entries.agg(F.to_json(F.struct(F.lit(brand).alias("brand"), F.sort_array(F.collect_list(e)).alias("entries"))).alias("json"))


def legend_json(rows: DataFrame) -> DataFrame:
    """rows: idx, rgb, symbol, brand, type, code, code_b; nulls are left out."""
    e = F.struct("idx", "rgb", "symbol", "brand", "type", "code", F.col("code_b").alias("codeB"))
    return rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(e)).alias("entries"))).alias("json"))


def overrides(rows: DataFrame) -> DataFrame:
    """rows: idx, symbol, shown -> a map of the symbols that differ from their base."""
    changed = F.when(F.col("symbol") != F.col("shown"), F.struct(F.col("idx").cast("string"), F.col("shown")))
    return rows.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(changed)))).alias("json"))


def legend_document(rows: DataFrame) -> DataFrame:
    """rows: idx, code, name, rgb, symbol, shown -> (json): entries by idx, null codes and names left
    out, and the overrides: symbols shown in place of their own."""
    changed = F.when(F.col("symbol") != F.col("shown"), F.struct(F.col("idx").cast("string"), F.col("shown")))
    entries = F.sort_array(F.collect_list(F.struct("idx", "code", "name", "rgb", "symbol")))
    return rows.agg(F.to_json(F.struct(entries.alias("entries"), F.map_from_entries(F.sort_array(F.collect_list(changed))).alias("overrides"))).alias("json"))


# fixed values: names of the parameters in the JSON, in order
PRESET_NAMES = {
    "wb_strength": "wb_strength", "gamma_target": "gamma_target", "rolloff": "rolloff", "nr_luma_r": "luma_radius", "nr_luma_eps": "luma_eps", "nr_chroma_gain": "chroma_gain",
    "tex_flat": "smooth_flat", "tex_nonflat": "smooth_other", "skin_sat_delta": "skin_sat_delta", "skin_tone_smooth": "skin_tone_smooth", "sky_hue_mode": "sky_hue_shift", "sky_v_delta": "sky_v_delta", "sky_grad_smooth": "sky_grad_smooth",
    "edge_protect": "edge_protect", "usm_amount": "sharpen", "usm_radius": "sharpen_radius", "usm_thr": "sharpen_threshold", "k_sigma": "k_sigma", "edge_scale": "edge_scale", "flat_scale": "flat_scale",
    "filter": "filter", "micro_phase": "micro_phase", "verify_ssim": "ssim_min", "verify_edge": "edge_keep_min", "verify_banding": "banding_max", "verify_de95": "de95_max",
    "post_dering": "dering", "post_clahe_clip": "clahe_clip", "dither_amp_L": "dither", "dither_mask": "dither_mask", "palette_bias": "palette_bias", "quality": "quality",
}


def preset_json(m: DataFrame) -> DataFrame:
    """m: img and the columns of rules.gated, with edge_pct, flat_pct, skin_pct, sky_pct, hitex_fine_pct, hitex_coarse_pct."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    f = lambda c, d: F.format_string(f"%.{d}f", F.col(c).cast("double"))
    fields = lambda pairs: F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(pairs) for x in (F.lit(("," if i else "") + f'"{k}":'), v)), F.lit("}"))
    filter_ = F.when(F.col("filter") == "mitchell", "EWA_Mitchell").otherwise("EWA_L3")
    text = {"filter": quoted(filter_), "dither_mask": quoted(F.col("dither_mask")), "palette_bias": quoted(F.col("palette_bias")), "quality": quoted(F.col("quality"))}
    params = fields([(k, text.get(c, F.col(c).cast("string"))) for k, c in PRESET_NAMES.items()])
    covers = fields([(n, f(f"{n}_pct", 3)) for n in ("edge", "flat", "skin", "sky", "hitex_fine", "hitex_coarse")])
    sigma = fields([(n, f(f"sigma_{n}", 4)) for n in ("base", "edge", "flat")])
    names = F.concat(F.lit("["), F.array_join(F.transform("addons", quoted), ","), F.lit("]"))
    return m.select("img", fields([("preset", quoted(F.col("preset"))), ("addons", names), ("r", f("r", 4)), ("sigma", sigma), ("covers", covers), ("reason", quoted(F.col("reason"))), ("params", params)]).alias("json"))


def log_json(events: DataFrame) -> DataFrame:
    """events: ts timestamp, level, category, message, session, data map -> one JSON object per row."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return events.select(F.to_json(F.struct(iso.alias("ts"), "level", "category", "message", "session", "data")).alias("line"))


def session_json(sessions: DataFrame) -> DataFrame:
    """sessions: started timestamp (session time zone UTC), maker, model, sdk -> (id, json) of a session's metadata."""
    id_ = F.date_format("started", "yyyyMMdd-HHmmss")
    fields = F.struct(id_.alias("id"), F.date_format("started", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at_utc"), F.concat_ws("/", "maker", "model").alias("device"), F.col("sdk"))
    return sessions.select(id_.alias("id"), F.to_json(fields).alias("json"))


def symbols(at: Column) -> Column:
    """Symbol at place ``at`` (from 0): shapes, then letters and digits, then all again with primes."""
    pool = F.array(*map(F.lit, SHAPES + LETTERS))
    size = len(SHAPES + LETTERS)
    return F.concat(F.element_at(pool, (at % size + 1).cast("int")), F.repeat(F.lit("'"), F.floor(at / size).cast("int")))


def render_plan(px: DataFrame, palette: DataFrame, max_side: int = 1024) -> DataFrame:
    """Cells as rectangles with pale color and symbol; px needs idx, w, h; palette: idx, r, g, b, symbol."""
    scale = F.greatest(F.lit(1), F.least(F.floor(max_side / F.greatest("w", "h")), F.lit(16))).cast("int")
    p = px.join(palette.select("idx", "r", "g", "b", "symbol"), "idx").withColumn("scale", scale)
    return p.select("img", "y", "x", (F.col("x") * F.col("scale")).alias("left"), (F.col("y") * F.col("scale")).alias("top"), F.col("scale").alias("side"), *(pale(F.col(c)).alias(c) for c in "rgb"), "symbol", (F.col("scale") >= 6).alias("grid"))


def preview_size(w: Column, h: Column, cell: int = 6, most: int = 2800) -> tuple[Column, Column]:
    s = F.least(F.lit(1.0), F.least(most / (w * cell), most / (h * cell)))
    return F.greatest(F.lit(1), F.floor(w * cell * s)).cast("int"), F.greatest(F.lit(1), F.floor(h * cell * s)).cast("int")


def preview_cells(px: DataFrame, cell: int = 6, most: int = 2800) -> DataFrame:
    """Each cell's rectangle, ends excluded, in the preview; px needs w and h.

    Nearest neighbour: a preview pixel shows the cell under its middle, so the ends follow from
    arithmetic.  Cells that no middle meets have no row."""
    width, height = preview_size(F.col("w"), F.col("h"), cell, most)
    p = px.withColumns({"pw": width.cast("bigint"), "ph": height.cast("bigint")})
    start = lambda at, size, whole: F.ceil((2 * at * size - whole) / (2 * whole)).cast("int")
    axis = lambda c, size, whole: (start(F.col(c), F.col(size), F.col(whole)), start(F.col(c) + 1, F.col(size), F.col(whole)))
    (left, right), (top, bottom) = axis("x", "pw", "w"), axis("y", "ph", "h")
    p = p.select("img", "y", "x", left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), "r", "g", "b")
    return p.where("left < right and top < bottom")


def preview_pixels(cells: DataFrame) -> DataFrame:
    """(img, y, x, r, g, b) of the preview from its rectangles."""
    rows = cells.withColumn("py", F.explode(F.sequence(F.col("top"), F.col("bottom") - 1)))
    return rows.withColumn("px", F.explode(F.sequence(F.col("left"), F.col("right") - 1))).select("img", F.col("py").alias("y"), F.col("px").alias("x"), "r", "g", "b")


def preview_lines(dims: DataFrame, cell: int = 6, most: int = 2800, bold: int = 10) -> DataFrame:
    """(img, axis, line, at, bold, stroke): the lines of the scaled grid that lie within the preview."""
    width, height = preview_size(F.col("w"), F.col("h"), cell, most)
    scale = F.least(F.lit(1.0), F.least(most / (F.col("w") * cell), most / (F.col("h") * cell)))
    p = dims.select("img", scale.alias("scale"), F.explode(F.array(F.struct(F.lit("x").alias("axis"), width.alias("size")), F.struct(F.lit("y").alias("axis"), height.alias("size")))).alias("a"))
    last = F.floor(F.col("a.size") / (cell * F.col("scale"))).cast("int")
    p = p.select("img", "scale", "a.axis", F.explode(F.sequence(F.lit(0), last)).alias("line"))
    thick = F.col("line") % bold == 0
    return p.select("img", "axis", "line", (F.col("line") * cell * F.col("scale")).alias("at"), thick.alias("bold"), F.when(thick, F.greatest(F.lit(1.0), 1.5 * F.col("scale"))).otherwise(F.lit(1.0)).alias("stroke"))


def grid_lines(dims: DataFrame, bold: int = 10) -> DataFrame:
    """(img, axis, at, bold) of all grid lines of images (img, w, h)."""
    v = dims.select("img", F.lit("x").alias("axis"), F.explode(F.sequence(F.lit(0), F.col("w"))).alias("at"))
    h = dims.select("img", F.lit("y").alias("axis"), F.explode(F.sequence(F.lit(0), F.col("h"))).alias("at"))
    return v.unionByName(h).withColumn("bold", F.col("at") % bold == 0)


def cells_on_page(side_mm: Column, margin_mm: float, cell_mm: float) -> Column:
    """Whole cells along a side of a page, at 72 points an inch."""
    pt = 72 / 25.4
    usable = F.round(side_mm * pt) - 2 * margin_mm * pt
    return F.greatest(F.lit(1), F.floor(usable / max(1.0, cell_mm * pt))).cast("int")


def page_plan(dims: DataFrame, page_w: int, page_h: int, overlap: int, legend: bool = False) -> DataFrame:
    """(img, page, sx, sy, ex, ey): pages in row order; ``legend`` adds a last page without cells."""
    step_x, step_y = max(1, page_w - overlap), max(1, page_h - overlap)
    n = lambda c, s: F.greatest(F.lit(1), F.ceil((F.col(c) - overlap) / s)).cast("int")
    p = dims.withColumns({"nx": n("w", step_x), "ny": n("h", step_y)})
    p = p.withColumn("py", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("px", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    sx, sy = F.col("px") * step_x, F.col("py") * step_y
    pages = p.select("img", (F.col("py") * F.col("nx") + F.col("px") + 1).alias("page"), sx.alias("sx"), sy.alias("sy"), F.least(F.col("w"), sx + page_w).alias("ex"), F.least(F.col("h"), sy + page_h).alias("ey"))
    if not legend:
        return pages
    last = dims.select("img", (n("w", step_x) * n("h", step_y) + 1).alias("page"))
    return pages.unionByName(last, allowMissingColumns=True)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``changes`` replace those of equal key."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def copied(table: DataFrame, key: str, of: Column, new_key: Column) -> DataFrame:
    """``table`` and again its rows that meet ``of``, under ``new_key``."""
    return table.unionByName(table.where(of).withColumn(key, new_key))


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def touched(table: DataFrame, keys: DataFrame, key: str, stamp: str, at: Column) -> DataFrame:
    """Rows of the keys get ``at`` as their stamp."""
    hit = keys.select(F.col(key).alias("_hit")).distinct()
    return table.join(hit, F.col(key) == F.col("_hit"), "left").withColumn(stamp, F.when(F.col("_hit").isNotNull(), at).otherwise(F.col(stamp))).drop("_hit")


def symbol_pool(base: DataFrame, more: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Distinct symbols of two tables (symbol), less those of a third."""
    pool = base.select("symbol").union(more.select("symbol")).distinct()
    return pool if without is None else pool.exceptAll(without.select("symbol").distinct())


def export_cells(px: DataFrame, palette: DataFrame, cell: int = 16) -> DataFrame:
    """Each cell's symbol where it is drawn: by the nearest palette color (8-bit), dark on light and light
    on dark with an outline of the other.  palette: idx, r, g, b, symbol; a null symbol isn't drawn."""
    near = matching.nearest(px, palette).join(matching.small(palette.select("idx", "symbol")), "idx").where("symbol IS NOT NULL")
    p = px.join(near.select("r", "g", "b", "symbol"), ["r", "g", "b"])
    dark = luma709(*(F.col(c) for c in "rgb")) > 140
    return p.select("img", "y", "x", "symbol", ((F.col("x") + 0.5) * cell).alias("left"), ((F.col("y") + 0.7) * cell).alias("base"), F.when(dark, "black").otherwise("white").alias("ink"), F.when(dark, "white").otherwise("black").alias("outline"))


def legend_flow(items: DataFrame, width: float, cell: int = 16) -> DataFrame:
    """items: pos, parts (widths of symbol, code, name and percent) -> (pos, left, top) below the picture.

    Items follow each other with gaps and wrap at the margin.  A legend has one row per thread, so it
    is folded in one array."""
    margin, gap = max(12.0, cell * 0.75), max(8.0, cell * 0.75)
    swatch, text = max(16.0, cell * 1.2), max(16.0, cell * 1.2)
    row = float(int(max(swatch, text) + max(6.0, cell * 0.5)))
    size = F.lit(swatch) + F.aggregate("parts", F.lit(0.0), lambda s, w: s + gap + w)
    every = items.select("pos", size.alias("size")).agg(F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("items"))
    start = F.struct(F.lit(margin).alias("at"), F.lit(margin).alias("top"), F.expr("cast(array() as array<struct<pos:int,left:double,top:double>>)").alias("out"))

    def step(s: Column, i: Column) -> Column:
        wrap = s["at"] + i["size"] > width - margin
        left, top = F.when(wrap, F.lit(margin)).otherwise(s["at"]), F.when(wrap, s["top"] + row).otherwise(s["top"])
        return F.struct((left + i["size"] + gap).alias("at"), top.alias("top"), F.concat(s["out"], F.array(F.struct(i["pos"].cast("int").alias("pos"), left.alias("left"), top.alias("top")))).alias("out"))

    return every.select(F.explode(F.aggregate("items", start, step)["out"]).alias("o")).select("o.*")


def flow_rows(items: DataFrame, width: int) -> DataFrame:
    """items: pos, size -> also row and left: items are set side by side and wrap at ``width``.

    Sequential over a legend (a few hundred rows at most), so it runs in one task."""
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        row = left = 0
        rows, lefts = [], []
        for s in t.column("size").to_pylist():
            if left and left + s > width:
                row, left = row + 1, 0
            rows.append(row)
            lefts.append(left)
            left += s
        return t.append_column("row", pa.array(rows, pa.int32())).append_column("left", pa.array(lefts, pa.int32()))

    return items.groupBy(F.lit(0).alias("_one")).applyInArrow(lambda t: run(t.select(["pos", "size"])), "pos int, size int, row int, left int")



def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG of a (h, w, 3) plane."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, 3 * w)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def png_files(px: DataFrame) -> DataFrame:
    """(img, name, content) of each image's color plane; an image must fit in a task's memory."""

    def run(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        rgb = np.zeros((int(y.max()) + 1, int(x.max()) + 1, 3), np.uint8)
        rgb[y, x] = np.stack([t.column(c).to_numpy() for c in "rgb"], axis=1)
        img = t.column("img")[0].as_py()
        return pa.table({"img": pa.array([img], pa.int64()), "name": [f"prescale_{rgb.shape[1]}x{rgb.shape[0]}_{img}.png"], "content": pa.array([png(rgb)], pa.binary())})

    return px.select(F.col("img").cast("bigint").alias("img"), "y", "x", "r", "g", "b").groupBy("img").applyInArrow(run, "img bigint, name string, content binary")
