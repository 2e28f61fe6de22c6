"""Rule evaluation: scene classes, presets, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C


def scene_class(m: DataFrame) -> DataFrame:
    """kind, subtype, confidence from colors, coverage, checker, edge_rate, var_lap, flat_pct, grad_skin, grad_sky."""
    c = F.col
    vote = lambda x: F.when(x, 1).otherwise(0)
    photo = (c("flat_pct") <= 0.55) & (c("colors") >= 128)
    votes = vote((c("colors") <= 64) & (c("coverage") >= 0.70)) + vote((c("checker") >= 0.06) & (c("edge_rate") >= 0.10)) + vote((c("edge_rate") >= 0.06) & (c("colors") <= 128) & (c("var_lap") >= 0.002)) + vote(~photo)
    p = m.withColumn("votes", votes).withColumn("kind", F.when(F.col("votes") > 2, "DISCRETE").otherwise("PHOTO"))
    sub = F.when((c("kind") == "DISCRETE") & (c("checker") >= 0.06), "PIXEL_ART").when((c("kind") == "DISCRETE") & (c("coverage") >= 0.70), "LOGO/FLAG").when((c("kind") == "PHOTO") & (c("grad_skin") > c("grad_sky")) & (c("flat_pct") < 0.5), "PORTRAIT/LIVING")
    return p.withColumns({"subtype": sub, "confidence": F.abs(2 * F.col("votes") - 4) / 4.0})


def preset_choice() -> Column:
    """Reason of the first rule that holds; needs the metrics and covers."""
    c = F.col
    return (
        F.when((c("noise_y") >= 2) | (c("noise_c") >= 2), "LOWLIGHT_STRONGNR")
        .when((c("skin_pct") >= 0.12) & c("edge_rate").between(0.12, 0.30), "PORTRAIT_SOFT")
        .when((c("sky_pct") >= 0.15) | (c("grad_sky") >= 0.7), "SKY_GRADIENT_SAFE")
        .when((c("edge_rate") >= 0.28) & (c("var_lap") >= 0.06) & (c("sky_pct") < 0.25), "ARCHITECTURE_EDGES")
        .when((c("hitex_pct") >= 0.25) & (c("noise_y") < 2), "TEXTURE_KEEPER")
        .otherwise("AUTO_BALANCED")
    )


def canvas_modifier(grid_w: Column) -> Column:
    return F.when(grid_w < 180, "+SMALL_CANVAS").when(grid_w >= 300, "+LARGE_CANVAS").otherwise("")


# fixed values: parameters of the base preset, and what each preset sets, adds ("+", x) or multiplies ("*", x)
BASE = {
    "preset": "FOTO/AutoBalanced",
    "wb_strength": 0.5, "gamma_target": 0.48, "rolloff": 0.08,
    "luma_radius": 3, "luma_eps": 0.003, "chroma_gain": 1.0, "noise_flat_only": True,
    "smooth_flat": 0.25, "smooth_other": 0.10,
    "skin_sat_delta": -0.07, "skin_tone_smooth": 0.20, "sky_hue_shift": 0.07, "sky_v_delta": -0.04, "sky_grad_smooth": 0.0,
    "edge_protect": 0.8, "sharpen": 0.28, "sharpen_radius": 1.0, "sharpen_threshold": 3,
    "k_sigma": 0.50, "edge_scale": 0.5, "flat_scale": 1.0,
    "filter": "mitchell", "micro_phase": 0,
    "ssim_min": 0.985, "edge_keep_min": 0.98, "banding_max": 0.003, "de95_max": 3.0,
    "dering": True, "local_contrast": True, "clahe_clip": 1.8,
    "dither": 0.40, "dither_mask": "Flat|Sky|Skin", "palette_bias": "neutral",
    "bit_depth": "16F",
}
PHASES_OF_TIER = {"FAST": 1, "BALANCED": 2, "MAX": 4}
SETS = {
    "AUTO_BALANCED": {},
    "PORTRAIT_SOFT": {"preset": "FOTO/PortraitSoftSkin", "chroma_gain": 1.4, "smooth_flat": ("+", 0.10), "smooth_other": ("+", 0.05), "skin_sat_delta": -0.10, "skin_tone_smooth": 0.30, "sky_hue_shift": 0.0, "sky_v_delta": 0.0, "sharpen": 0.22, "sharpen_radius": 0.9, "sharpen_threshold": 4, "filter": "mitchell", "dither": 0.35, "palette_bias": "skin-neutral"},
    "SKY_GRADIENT_SAFE": {"preset": "FOTO/LandscapeGradients", "rolloff": ("+", 0.02), "smooth_flat": ("+", 0.05), "sky_hue_shift": 0.10, "sky_v_delta": -0.06, "sky_grad_smooth": 0.10, "k_sigma": 0.55, "filter": "mitchell", "micro_phase": ("+", 1), "dither": 0.55, "dither_mask": "Flat|Sky", "palette_bias": "neutral"},
    "ARCHITECTURE_EDGES": {"preset": "FOTO/ArchitectureEdges", "luma_eps": ("*", 0.8), "chroma_gain": 0.9, "smooth_flat": ("+", -0.05), "edge_protect": 0.9, "sharpen": 0.33, "sharpen_radius": 1.1, "sharpen_threshold": 2, "k_sigma": 0.45, "edge_scale": 0.65, "filter": "lanczos3", "micro_phase": ("+", 2), "dither": 0.30, "palette_bias": "cool-neutral"},
    "TEXTURE_KEEPER": {"preset": "FOTO/AnimalsFurFeather", "luma_radius": ("+", 1), "chroma_gain": 1.1, "smooth_other": ("+", -0.05), "sharpen": 0.30, "sharpen_radius": 1.0, "sharpen_threshold": 3, "filter": "lanczos3", "dither": 0.45, "palette_bias": "warm-natural"},
    "LOWLIGHT_STRONGNR": {"preset": "FOTO/LowLightISO", "gamma_target": 0.50, "rolloff": ("+", 0.02), "luma_radius": 5, "luma_eps": 0.008, "chroma_gain": 1.8, "smooth_flat": ("+", 0.10), "sharpen": 0.24, "sharpen_radius": 1.1, "sharpen_threshold": 4, "k_sigma": 0.55, "dither": 0.50},
    "OLD_SCAN": {"preset": "FOTO/OldScanRestore", "wb_strength": 0.7, "rolloff": 0.10, "luma_radius": 4, "luma_eps": 0.006, "chroma_gain": 1.6, "smooth_flat": ("+", 0.05), "skin_sat_delta": -0.08, "sky_hue_shift": 0.08, "sharpen": 0.26, "sharpen_radius": 1.0, "sharpen_threshold": 4, "dither": 0.45},
}
CANVAS = {
    "": {},
    "+SMALL_CANVAS": {"preset": "FOTO/SmallCanvasMinColors", "rolloff": ("+", 0.03), "chroma_gain": 1.2, "smooth_flat": ("+", 0.10), "smooth_other": ("+", 0.05), "skin_sat_delta": -0.12, "skin_tone_smooth": 0.35, "sky_hue_shift": 0.12, "sky_v_delta": -0.07, "sharpen": 0.20, "sharpen_radius": 0.9, "sharpen_threshold": 3, "k_sigma": 0.60, "dither": 0.60, "palette_bias": "low-count"},
    "+LARGE_CANVAS": {"preset": "FOTO/LargeCanvasHiDetail", "luma_eps": ("*", 0.75), "chroma_gain": 0.9, "sharpen": 0.34, "sharpen_radius": 1.2, "sharpen_threshold": 2, "k_sigma": 0.45, "filter": "lanczos3", "micro_phase": ("+", 2), "dither": 0.35, "palette_bias": "hi-detail"},
}


def changed(spec: dict, ops: dict) -> dict:
    """``spec`` after a preset's settings, additions and factors; nothing falls below 0 by an addition."""
    out = dict(spec)
    for k, v in ops.items():
        if isinstance(v, tuple):
            v = max(0.0, spec[k] + v[1]) if v[0] == "+" and isinstance(spec[k], float) else spec[k] + v[1] if v[0] == "+" else spec[k] * v[1]
        out[k] = v
    return out


def preset_table(spark, tier: str = "BALANCED") -> DataFrame:
    """(reason, parameters...): every preset on every canvas, a few rows, joined by the whole reason."""
    base = BASE | {"micro_phase": PHASES_OF_TIER[tier]}
    rows = [{"reason": k + size} | changed(changed(base, v), w) | {"quality": tier} for k, v in SETS.items() for size, w in CANVAS.items()]
    cols = list(rows[0])
    kinds = {int: "int", float: "double", str: "string", bool: "boolean"}
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], ", ".join(f"{c} {kinds[type(rows[0][c])]}" for c in cols))


def addon_rules() -> dict[str, Column]:
    c = F.col
    return {"ADD_SKIN_PROTECT": c("skin_pct") >= 0.12, "ADD_SKY_BANDING_SHIELD": (c("sky_pct") >= 0.15) & (c("grad_sky") >= 0.7), "ADD_EDGE_GUARD+": (c("edge_rate") >= 0.28) & c("var_lap").between(0.06, 0.12)}


def addons() -> Column:
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in addon_rules().items())))


def with_addons(specs: DataFrame) -> DataFrame:
    """Specs with what their add-ons change."""
    skin, sky, edge = addon_rules().values()
    return specs.withColumns({
        "skin_tone_smooth": F.when(skin, F.col("skin_tone_smooth") + 0.10).otherwise(F.col("skin_tone_smooth")),
        "dither_mask": F.when(skin, F.concat("dither_mask", F.lit("|Skin"))).otherwise(F.col("dither_mask")),
        "sky_grad_smooth": F.when(sky, F.greatest(F.lit(0.10), "sky_grad_smooth")).otherwise(F.col("sky_grad_smooth")),
        "dither": F.when(sky, F.greatest(F.lit(0.55), "dither")).otherwise(F.col("dither")),
        "sharpen_threshold": F.when(edge, F.greatest(F.lit(1), F.col("sharpen_threshold") - 1)).otherwise(F.col("sharpen_threshold")),
        "addons": addons(),
    })


def gated(m: DataFrame, tier: str = "BALANCED") -> DataFrame:
    """m: metrics, covers, grid_w (may be null) and r -> also reason, parameters, add-ons and the three sigmas."""
    canvas = F.coalesce(canvas_modifier(F.col("grid_w")), F.lit(""))
    specs = m.withColumn("reason", F.concat(preset_choice(), canvas)).join(F.broadcast(preset_table(m.sparkSession, tier)), "reason")
    base = F.col("k_sigma") * F.greatest(F.lit(0.0), F.col("r") - 1.0)
    return with_addons(specs).withColumns({"sigma_base": base, "sigma_edge": base * F.col("edge_scale"), "sigma_flat": base * F.col("flat_scale")})


def verified(ssim: Column, keep: Column, banding: Column, de95: Column) -> Column:
    return (ssim >= 0.985) & (keep >= 0.98) & (banding <= 0.003) & (de95 <= 3.0)


def deblock_strength(mean: Column) -> Column:
    """Null where nothing is to be done."""
    return F.when(mean >= 0.008, F.least(F.lit(0.7), 12 * mean))


def consistent(px: DataFrame, k: int) -> DataFrame:
    """Per image: cells, whether the grid is full, whether all indices lie in 0..k-1."""
    return px.groupBy("img").agg(F.count(F.lit(1)).alias("cells"), (F.count(F.lit(1)) == (F.max("x") + 1) * (F.max("y") + 1)).alias("full"), (F.count_if(~F.col("idx").between(0, k - 1) | F.col("idx").isNull()) == 0).alias("in_range"))


def unified(px: DataFrame, skin_sat: float = -0.07, skin_smooth: float = 0.20, sky_hue: float = 0.07, sky_v: float = -0.04) -> DataFrame:
    """Moves saturation of skin and hue and value of sky; deltas of saturation and value are in
    percent.  px: r, g, b in 0..1 with skin and sky."""
    p = px.withColumns(dict(zip(("un_h", "un_s", "un_v"), C.hsv(F.col("r"), F.col("g"), F.col("b")), strict=True)))
    s = C.clamp(C.clamp(F.col("un_s") + skin_sat / 100.0, 0, 1) * (1 - min(0.6, max(0.0, skin_smooth))), 0, 1)
    h = C.lerp(F.col("un_h"), F.lit(210 / 360.0), F.lit(min(0.2, max(0.0, sky_hue))))
    v = C.clamp(F.col("un_v") + sky_v / 100.0, 0, 1)
    p = p.withColumns({"un_s": F.when(F.col("skin"), s).otherwise(F.col("un_s")), "un_h": F.when(F.col("sky"), h).otherwise(F.col("un_h")), "un_v": F.when(F.col("sky"), v).otherwise(F.col("un_v"))})
    return p.withColumns(dict(zip("rgb", C.rgb_of_hsv(F.col("un_h"), F.col("un_s"), F.col("un_v")), strict=True))).drop("un_h", "un_s", "un_v")
