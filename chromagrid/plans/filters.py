"""Queries on blurs, resampling, index-map smoothing and rules, and those without SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import kernels, matching, metrics, resample, rules, stencils, topology
from ..sources import catalogs, rasters, sinks
from . import sql as S
from .planes import BASE, MAG, NB, f1, index, rgb, trio, units
from .scalars import _HSV, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}
R, K = S.ROW, S.COL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = S.exact(sql)
        return f

    return add


def _near(src: str, cols: list[str], weights: list[float], at: str, end: str, extra: str = "", whole: bool = False) -> str:
    """One pass of a kernel by joining each cell with its clamped neighbours."""
    r = len(weights) // 2
    taps = "(VALUES " + ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(weights)) + ") k(dt, wt)"
    other = "y" if at == "x" else "x"
    agg = ", ".join((f"floor(sum(q.{c} * wt) / {len(weights)})" if whole else f"sum(q.{c} * wt)") + f" AS {c}" for c in cols)
    return f"(SELECT p.img, p.y, p.x, {agg} FROM (SELECT p.img, p.y, p.x, greatest(0, least({end} - 1, p.{at} + dt)) AS _a, wt FROM {src} p JOIN dim USING (img), {taps}) p JOIN {src} q ON q.img = p.img AND q.{other} = p.{other} AND q.{at} = _a GROUP BY p.img, p.y, p.x)"


def blur_sql(src: str, cols: list[str], weights: list[float], whole: bool = False) -> str:
    return _near(_near(src, cols, weights, "x", "w", whole=whole), cols, weights, "y", "h", whole=whole)


def gauss_sql(src: str, cols: list[str], sigma: float, r: int | None = None) -> str:
    r = r or max(1, int(2 * sigma + 0.5))
    return blur_sql(src, cols, stencils.kernel(sigma, r))


DIM = "dim AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM f1 GROUP BY img)"
UM = f"um AS (SELECT *, x % 3 = 0 AS edge, y % 2 = 0 AS flat, x % 4 = 1 AS hi FROM u)"
HEAD = f"WITH {S.F1}, {DIM}, {S.UNIT}, {UM}"


def masked(spark: SparkSession, d: str) -> DataFrame:
    p = units(spark, d).withColumns({"edge": F.col("x") % 3 == 0, "flat": F.col("y") % 2 == 0, "hi": F.col("x") % 4 == 1})
    return stencils.with_size(p)


def _rgb(expr: str, n: int = 6) -> str:
    return ", ".join(f"round({expr.replace('@', c)}, {n}) AS {c}" for c in "rgb")


def _clamp(e: str) -> str:
    return f"greatest(0.0, least(1.0, {e}))"


@query(f"{HEAD}, sq AS (SELECT img, y, x, luma AS m, luma * luma AS q FROM u), b AS (SELECT * FROM {blur_sql('sq', ['m', 'q'], [1 / 7] * 7)}), b5 AS (SELECT * FROM {blur_sql('f1', ['r', 'g', 'b'], [1.0] * 5, whole=True)}) SELECT img, y, x, round(m, 6) AS mean, round(greatest(0.0, q - m * m), 6) AS field, b5.r::BIGINT AS r, b5.g::BIGINT AS g, b5.b::BIGINT AS b FROM b JOIN b5 USING (img, y, x)")
def n06_n07_n15_box_blur(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.variance_field(masked(spark, d), "luma", 3)
    q = stencils.box_blur(stencils.with_size(f1(spark, d)), ["r", "g", "b"], 2, whole=True)
    return rounded(p.select("img", "y", "x", "mean", "field").join(q.select("img", "y", "x", *(F.col(c).cast("bigint").alias(c) for c in "rgb")), ["img", "y", "x"]))


@query(f"{HEAD}, g AS (SELECT * FROM {gauss_sql('u', ['r', 'g', 'b'], 1.2)}) SELECT img, y, x, {_rgb('g.@')}, {', '.join(f'floor({_clamp(f'g.{c}')} * 255 + 0.5)::INT AS {c}8' for c in 'rgb')} FROM g")
def n08_gaussian(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.gaussian(units(spark, d), ["r", "g", "b"], 1.2)
    return rounded(p.select("img", "y", "x", "r", "g", "b", *(C.byte(F.col(c)).alias(f"{c}8") for c in "rgb")))


@query(f"""{HEAD}, sq AS (SELECT img, y, x, luma AS m, luma * luma AS q FROM u), b AS (SELECT img, y, x, m, greatest(0.0, q - m * m) AS v FROM {blur_sql('sq', ['m', 'q'], [1 / 7] * 7)}),
 s AS (SELECT um.*, CASE WHEN luma > 1e-6 THEN (v/(v+0.003)*luma + m*(1-v/(v+0.003)))/luma*k + 1 - k ELSE 1.0 END AS f FROM (SELECT *, CASE WHEN edge THEN 0.2 WHEN flat THEN 1.0 ELSE 0.5 END AS k FROM um) um JOIN b USING (img, y, x))
SELECT img, y, x, {_rgb(_clamp('@ * f'))} FROM s""")
def n09_luma_noise(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencils.luma_noise_reduced(masked(spark, d)).select("img", "y", "x", "r", "g", "b"))


@query(f"{HEAD}, b2 AS (SELECT * FROM {blur_sql('u', ['r', 'g', 'b'], [0.2] * 5)}), b1 AS (SELECT * FROM {blur_sql('u', ['r', 'g', 'b'], [1 / 3] * 3)}), k AS (SELECT *, CASE WHEN flat AND NOT hi THEN 0.25 WHEN hi THEN 0.05 ELSE 0.10 END AS k FROM um) SELECT img, y, x, {_rgb(_clamp('k.@ * (1 - 1.4) + b2.@ * 1.4'))}, {', '.join(f'round({_clamp(f'k.{c} * (1 - k) + b1.{c} * k')}, 6) AS s{c}' for c in 'rgb')} FROM k JOIN b2 USING (img, y, x) JOIN b1 USING (img, y, x)")
def n10_chroma_texture(spark: SparkSession, d: str) -> DataFrame:
    p = masked(spark, d)
    a = stencils.mixed_with_blur(p, 2, F.lit(1.4)).select("img", "y", "x", "r", "g", "b")
    b = stencils.mixed_with_blur(p, 1, stencils.texture_gain(F.col("flat"), F.col("hi"))).select("img", "y", "x", *(F.col(c).alias(f"s{c}") for c in "rgb"))
    return rounded(a.join(b, ["img", "y", "x"]))


@query(f"""{HEAD}, g1 AS (SELECT * FROM {gauss_sql('u', ['r', 'g', 'b'], 1.0)}), g2 AS (SELECT * FROM {gauss_sql('u', ['r', 'g', 'b'], 0.5)}), g3 AS (SELECT * FROM {gauss_sql('u', ['r', 'g', 'b'], 0.8)}),
 m AS (SELECT um.img, um.y, um.x, edge, flat, {', '.join(f'um.{c} AS {c}, g1.{c} AS {c}1, g2.{c} AS {c}2, g3.{c} AS {c}3' for c in 'rgb')} FROM um JOIN g1 USING (img, y, x) JOIN g2 USING (img, y, x) JOIN g3 USING (img, y, x)),
 n AS (SELECT *, CASE WHEN edge AND round(abs(r-r1)+abs(g-g1)+abs(b-b1), 9) > 3/255.0 THEN 0.28 ELSE 0.0 END AS k FROM m)
SELECT img, y, x, {_rgb(_clamp('@ + (@ - @1) * k'))}, {', '.join(f'round({_clamp(f'CASE WHEN flat THEN {c}1 WHEN edge THEN 0.5*{c} + 0.5*{c}2 ELSE 0.5*{c} + 0.25*{c}1 + 0.25*{c}2 END')}, 6) AS a{c}, round({_clamp(f'{c} * 1.06 - {c}3 * 0.06')}, 6) AS l{c}' for c in 'rgb')} FROM n""")
def n11_sharpen_antialias_contrast(spark: SparkSession, d: str) -> DataFrame:
    p = masked(spark, d)
    a = stencils.unsharp(p).select("img", "y", "x", "r", "g", "b")
    b = stencils.antialiased(p, 0.5, 1.0).select("img", "y", "x", *(F.col(c).alias(f"a{c}") for c in "rgb"))
    c = stencils.local_contrast(p).select("img", "y", "x", *(F.col(c).alias(f"l{c}") for c in "rgb"))
    return rounded(a.join(b, ["img", "y", "x"]).join(c, ["img", "y", "x"]))


@query(f"""{HEAD}, l AS (SELECT img, y, x, luma AS v FROM u), g1 AS (SELECT * FROM {gauss_sql('l', ['v'], 1.0, 2)}), g2 AS (SELECT * FROM {gauss_sql('l', ['v'], 1.5, 3)}), dg AS (SELECT u.*, g1.v - g2.v AS dog FROM u JOIN g1 USING (img, y, x) JOIN g2 USING (img, y, x)),
 s AS (SELECT img, avg(abs(dog)) AS score FROM dg GROUP BY img), e AS (SELECT *, greatest(0.1, least(0.6, 0.25 * (1 + score * 20))) AS eff FROM dg JOIN s USING (img)),
 n AS (SELECT *, CASE WHEN luma > 1e-6 THEN {_clamp('luma - CASE WHEN dog > 0 THEN eff ELSE eff * 0.05 END * dog')} / luma ELSE 1.0 END AS f FROM e)
SELECT img, y, x, round(score, 6) AS score, {_rgb(_clamp('@ * f'))} FROM n""")
def n12_a31_halo(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    score = stencils.difference_of_gaussians(u).groupBy("img").agg(F.avg(F.abs("dog")).alias("score"))
    return rounded(stencils.halo_removed(u).join(score, "img").select("img", "y", "x", "score", "r", "g", "b"))


@query(f"""{HEAD}, t AS (SELECT p.img, p.y, p.x, greatest(0, least(h - 1, p.y + dy)) AS sy, greatest(0, least(w - 1, p.x + dx)) AS sx, p.luma AS l0, CASE WHEN dx = 0 AND dy = 0 THEN 1.0 ELSE 0.6 END AS ws FROM u p JOIN dim USING (img), (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy)),
 k AS (SELECT t.img, t.y, t.x, q.r, q.g, q.b, exp(-((q.luma - l0) * (q.luma - l0)) * 50.0) * ws AS w FROM t JOIN u q ON q.img = t.img AND q.y = sy AND q.x = sx)
SELECT img, y, x, {_rgb('sum(@ * w) / sum(w)')} FROM k GROUP BY img, y, x""")
def n13_dering(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencils.deringed(units(spark, d).drop("luma")))


def _deblock(src: str, at: str, win: str) -> str:
    mate = lambda c: f"CASE WHEN {at} % 8 = 7 THEN lead({c}) OVER ({win}) WHEN {at} % 8 = 0 AND {at} > 0 THEN lag({c}) OVER ({win}) END"
    return f"(SELECT img, y, x, {', '.join(f'coalesce({_clamp(f"{c} + (({c} + {mate(c)}) * 0.5 - {c}) * 0.5")}, {c}) AS {c}' for c in 'rgb')} FROM {src})"


@query(f"{HEAD} SELECT img, y, x, {_rgb('@')} FROM {_deblock(_deblock('u', 'x', R), 'y', K)}".replace("coalesce(greatest(0.0, least(1.0, ", "coalesce((0.0 + 1.0 * (").replace(", r) AS r", ", r) AS r"))
def n14_deblock(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencils.deblocked(units(spark, d).drop("luma")))


@query(f"""{HEAD}, b3 AS (SELECT p.img, p.y, p.x, sum(q.r) AS r, sum(q.g) AS g, sum(q.b) AS b FROM (SELECT p.img, p.y, p.x, greatest(0, least(h - 1, p.y + dy)) AS sy, greatest(0, least(w - 1, p.x + dx)) AS sx FROM f1 p JOIN dim USING (img), (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) c(dy)) p JOIN f1 q ON q.img = p.img AND q.y = sy AND q.x = sx GROUP BY ALL)
SELECT img, y, x, {', '.join(f'greatest(0, least(255, f1.{c} + trunc((f1.{c} - b3.{c} // 9) * 0.5)))::INT AS {c}' for c in 'rgb')} FROM f1 JOIN b3 USING (img, y, x)""")
def n16_unsharp_bytes(spark: SparkSession, d: str) -> DataFrame:
    return stencils.unsharp_bytes(f1(spark, d))


def _kernel_sql(kind: str, x: str) -> str:
    a = f"abs({x})"
    if kind == "mitchell":
        return f"CASE WHEN {a} < 1 THEN (7*power({a},3) - 12*power({a},2) + 16/3.0)/6 WHEN {a} < 2 THEN (-7/3.0*power({a},3) + 12*power({a},2) - 20*{a} + 32/3.0)/6 ELSE 0.0 END"
    sinc = lambda v: f"CASE WHEN abs({v}) < 1e-8 THEN 1.0 ELSE sin(pi()*{v})/(pi()*{v}) END"
    return f"CASE WHEN {a} < 3 THEN ({sinc(x)}) * ({sinc(f'({x}/3)')}) ELSE 0.0 END"


def _resize_sql(kind: str, w: int, h: int, ox: float, oy: float) -> str:
    n = 2 if kind == "mitchell" else 3
    axis = lambda size, to, off, at: f"(SELECT img, i AS {at}o, greatest(0, least({size} - 1, c))::INT AS {at}s, {_kernel_sql(kind, '(u - c)')} AS w{at} FROM (SELECT img, i, {size}, (i + {off}) * ({size} / {to}.0) AS u, floor((i + {off}) * ({size} / {to}.0)) + t AS c FROM dim, range({to}) r(i), range(-{n}, {n + 1}) k(t)))"
    return f"(SELECT a.img, b.yo::INT AS y, a.xo::INT AS x, {', '.join(f'sum(u.{c} * wx * wy) / sum(wx * wy) AS {c}' for c in 'rgb')} FROM {axis('w', w, ox, 'x')} a JOIN {axis('h', h, oy, 'y')} b ON a.img = b.img JOIN u ON u.img = a.img AND u.x = xs AND u.y = ys GROUP BY ALL)"


@query(f"{HEAD} SELECT img, y, x, {_rgb('m.@')}, {', '.join(f'round(l.{c}, 6) AS l{c}' for c in 'rgb')} FROM {_resize_sql('mitchell', 20, 15, 0.5, 0.0)} m JOIN {_resize_sql('lanczos', 20, 15, 0.5, 0.0)} l USING (img, y, x)")
def n17_n18_resample(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    m = resample.resized(u, 20, 15, "mitchell", 0.5, 0.0)
    n = resample.resized(u, 20, 15, "lanczos3", 0.5, 0.0).select("img", "y", "x", *(F.col(c).alias(f"l{c}") for c in "rgb"))
    return rounded(m.join(n, ["img", "y", "x"]))


def _phase_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT {i} AS phase, {ox} AS ox, {oy} AS oy, img, y, x, {S.luma()} AS luma FROM {_resize_sql('mitchell', 20, 15, ox, oy)}" for i, (ox, oy) in enumerate(resample.PHASES[4]))
    return f"""{HEAD}, ph AS ({parts}), l AS (SELECT *, lag(luma) OVER (PARTITION BY phase, img, y ORDER BY x) AS p FROM ph), e AS (SELECT img, phase, ox, oy, round(sum(abs(luma - p)), 6) AS energy FROM l WHERE y BETWEEN 1 AND 13 AND x BETWEEN 1 AND 18 GROUP BY ALL)
 SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY img ORDER BY energy DESC, phase) = 1"""


@query(_phase_sql())
def n19_micro_phase(spark: SparkSession, d: str) -> DataFrame:
    return resample.best_phase(units(spark, d), 20, 15, 4)


@query(f"""WITH {S.F1}, {DIM}, mk AS (SELECT img, y, x, r > 120 AS m FROM f1), t AS (SELECT img, w, h, i AS x, j AS y, greatest(0.0, least(i * (w / 90.0), w - 1.00001)) AS u, greatest(0.0, least(j * (h / 70.0), h - 1.00001)) AS v FROM dim, range(90) a(i), range(70) c(j)),
 s AS (SELECT t.*, floor(u)::INT AS x0, floor(v)::INT AS y0 FROM t), up AS (SELECT s.img, s.y, s.x, sum(q.m::INT * CASE WHEN cx = 0 THEN 1 - (u - x0) ELSE u - x0 END * CASE WHEN cy = 0 THEN 1 - (v - y0) ELSE v - y0 END) > 0.5 AS m FROM s, (VALUES (0), (1)) a(cx), (VALUES (0), (1)) c(cy), mk q WHERE q.img = s.img AND q.x = least(w - 1, x0 + cx) AND q.y = least(h - 1, y0 + cy) GROUP BY s.img, s.y, s.x)
SELECT up.img, up.y::INT AS y, up.x::INT AS x, up.m, q.m AS nearest FROM up JOIN dim USING (img) JOIN mk q ON q.img = up.img AND q.x = floor((up.x + 0.5) * w / 90)::INT AND q.y = floor((up.y + 0.5) * h / 70)::INT""")
def j12_j13_mask_resample(spark: SparkSession, d: str) -> DataFrame:
    m = f1(spark, d).select("img", "y", "x", (F.col("r") > 120).alias("m"))
    a, b = resample.upscaled_mask(m, 90, 70), resample.nearest_mask(m, 90, 70).withColumnRenamed("m", "nearest")
    return a.join(b, ["img", "y", "x"])


_IXE = f"WITH {S.F3}, {S.TRIO}, {S.IDX}, ie AS (SELECT img, y, x, idx, x % 5 = 0 AS edge FROM ix)"


def _edged(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("img", "y", "x", "idx", (F.col("x") % 5 == 0).alias("edge"))


def _runs_sql(src: str, line: str, at: str) -> str:
    w = f"PARTITION BY img, {line} ORDER BY {at}"
    return f"""(SELECT img, y, x, edge, coalesce(last_value(lg IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), second, idx) AS idx FROM
 (SELECT *, CASE WHEN count(*) OVER (PARTITION BY img, {line}, run) >= CASE WHEN bool_or(edge) OVER (PARTITION BY img, {line}, run) THEN 4 ELSE 8 END THEN idx END AS lg, max(idx) FILTER (run = 2) OVER (PARTITION BY img, {line}) AS second FROM
 (SELECT *, sum(f) OVER ({w}) AS run FROM (SELECT *, (idx IS DISTINCT FROM lag(idx) OVER ({w}))::INT AS f FROM {src}))))"""


@query(f"{_IXE} SELECT img, y, x, idx FROM {_runs_sql(_runs_sql('ie', 'y', 'x'), 'x', 'y')}")
def q01_min_runs(spark: SparkSession, d: str) -> DataFrame:
    return topology.min_runs(_edged(spark, d), 8, 4).select("img", "y", "x", "idx")


@query(f"""{_IXE}, nb AS (SELECT p.img, p.y, p.x, p.idx AS own, q.idx AS nc, CASE WHEN p.edge OR q.edge THEN 1.5 ELSE 1.0 END AS w FROM ie p JOIN ie q ON q.img = p.img AND abs(q.x - p.x) + abs(q.y - p.y) = 1 AND q.x BETWEEN p.x - 1 AND p.x + 1),
 cd AS (SELECT DISTINCT img, y, x, own, nc AS c FROM nb UNION SELECT DISTINCT img, y, x, own, own FROM nb), en AS (SELECT cd.img, cd.y, cd.x, cd.own, c, sum(CASE WHEN nb.nc <> c THEN nb.w ELSE 0.0 END) AS e FROM cd JOIN nb USING (img, y, x) GROUP BY ALL)
SELECT img, y, x, c AS idx FROM en QUALIFY row_number() OVER (PARTITION BY img, y, x ORDER BY e, (c <> own)::INT, c & 7, c) = 1""")
def n23_potts(spark: SparkSession, d: str) -> DataFrame:
    return topology.potts(_edged(spark, d)).select("img", "y", "x", "idx")


@query(f"""WITH {S.F1}, o AS (SELECT * FROM {S.ok('f1')}), k AS (SELECT img, CASE WHEN round(power(ok_l-0.3,2)+ok_a*ok_a+ok_b*ok_b, 12) <= round(power(ok_l-0.7,2)+ok_a*ok_a+ok_b*ok_b, 12) THEN 0 ELSE 1 END AS pick, CASE WHEN x % 2 = 0 THEN 1.3 ELSE 1.0 END AS w, ok_l, ok_a, ok_b FROM o)
SELECT img, pick, {', '.join(f'round(sum(w * ok_{c}) / sum(w), 6) AS {c}, round(sum(w * ok_{c}) / count(*), 6) AS by_count_{c}' for c in 'lab')} FROM k GROUP BY img, pick""")
def q13_q15_two_centers(spark: SparkSession, d: str) -> DataFrame:
    p = matching.with_oklab(f1(spark, d)).withColumn("w", F.when(F.col("x") % 2 == 0, 1.3).otherwise(1.0))
    return rounded(metrics.two_center_means(p, (0.3, 0.0, 0.0), (0.7, 0.0, 0.0)))


@query(f"""WITH {S.F1}, {S.UNIT}, hs AS (SELECT * FROM {_HSV}), q AS (SELECT img, y, x, x % 3 = 0 AS skin, x % 4 = 0 AS sky, h, CASE WHEN x % 3 = 0 THEN {_clamp(f'{_clamp("s - 0.0007")} * 0.8')} ELSE s END AS s, v FROM hs),
 k AS (SELECT img, y, x, CASE WHEN sky THEN h + (210/360.0 - h) * 0.07 ELSE h END * 6 AS h6, s, CASE WHEN sky THEN {_clamp('v - 0.0004')} ELSE v END AS v FROM q), f AS (SELECT *, (floor(h6)::INT % 6) AS i, h6 - floor(h6) AS f FROM k), e AS (SELECT *, v*(1-s) AS p, v*(1-s*f) AS qq, v*(1-s*(1-f)) AS t FROM f)
SELECT img, y, x, round([v, qq, p, p, t, v][i + 1], 6) AS r, round([t, v, v, qq, p, p][i + 1], 6) AS g, round([p, p, t, v, v, qq][i + 1], 6) AS b FROM e""")
def r08_skin_sky_unify(spark: SparkSession, d: str) -> DataFrame:
    p = units(spark, d).withColumns({"skin": F.col("x") % 3 == 0, "sky": F.col("x") % 4 == 0})
    return rounded(rules.unified(p).select("img", "y", "x", "r", "g", "b"))


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    frac = lambda m: ((k * m) % 97) / 97.0
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("img"), (k * 7 % 300).alias("colors"), frac(11).alias("coverage"), (frac(13) * 0.15).alias("checker"), (frac(17) * 0.4).alias("edge_rate"), (frac(19) * 0.15).alias("var_lap"), frac(23).alias("flat_pct"), frac(29).alias("grad_skin"), frac(31).alias("grad_sky"), (frac(37) * 2.1).alias("noise_y"), (frac(41) * 2.05).alias("noise_c"), (frac(43) * 0.3).alias("skin_pct"), (frac(47) * 0.4).alias("sky_pct"), (frac(53) * 0.5).alias("hitex_pct"), (k % 400).alias("grid_w"), frac(59).alias("edge_pct"))


_M = "m AS (SELECT p_partkey AS img, p_partkey * 7 % 300 AS colors, {0} FROM part)".format(", ".join(f"((p_partkey * {m}) % 97) / 97.0 * {f} AS {n}" for n, m, f in (("coverage", 11, 1), ("checker", 13, 0.15), ("edge_rate", 17, 0.4), ("var_lap", 19, 0.15), ("flat_pct", 23, 1), ("grad_skin", 29, 1), ("grad_sky", 31, 1), ("noise_y", 37, 2.1), ("noise_c", 41, 2.05), ("skin_pct", 43, 0.3), ("sky_pct", 47, 0.4), ("hitex_pct", 53, 0.5), ("edge_pct", 59, 1))) + ", p_partkey % 400 AS grid_w")
_REASON = "CASE WHEN noise_y >= 2 OR noise_c >= 2 THEN 'LOWLIGHT_STRONGNR' WHEN skin_pct >= 0.12 AND edge_rate BETWEEN 0.12 AND 0.30 THEN 'PORTRAIT_SOFT' WHEN sky_pct >= 0.15 OR grad_sky >= 0.7 THEN 'SKY_GRADIENT_SAFE' WHEN edge_rate >= 0.28 AND var_lap >= 0.06 AND sky_pct < 0.25 THEN 'ARCHITECTURE_EDGES' WHEN hitex_pct >= 0.25 AND noise_y < 2 THEN 'TEXTURE_KEEPER' ELSE 'AUTO_BALANCED' END"
_ADD = "list_filter([CASE WHEN skin_pct >= 0.12 THEN 'ADD_SKIN_PROTECT' END, CASE WHEN sky_pct >= 0.15 AND grad_sky >= 0.7 THEN 'ADD_SKY_BANDING_SHIELD' END, CASE WHEN edge_rate >= 0.28 AND var_lap BETWEEN 0.06 AND 0.12 THEN 'ADD_EDGE_GUARD+' END], lambda v: v IS NOT NULL)"


@query(f"""WITH {_M}, v AS (SELECT *, (colors <= 64 AND coverage >= 0.70)::INT + (checker >= 0.06 AND edge_rate >= 0.10)::INT + (edge_rate >= 0.06 AND colors <= 128 AND var_lap >= 0.002)::INT + (NOT (flat_pct <= 0.55 AND colors >= 128))::INT AS votes FROM m)
SELECT img, votes, CASE WHEN votes > 2 THEN 'DISCRETE' ELSE 'PHOTO' END AS kind, CASE WHEN votes > 2 AND checker >= 0.06 THEN 'PIXEL_ART' WHEN votes > 2 AND coverage >= 0.70 THEN 'LOGO/FLAG' WHEN votes <= 2 AND grad_skin > grad_sky AND flat_pct < 0.5 THEN 'PORTRAIT/LIVING' END AS subtype, abs(2 * votes - 4) / 4.0 AS confidence FROM v""")
def r01_scene(spark: SparkSession, d: str) -> DataFrame:
    return rules.scene_class(_metric_rows(spark, d)).select("img", "votes", "kind", "subtype", "confidence")


def _by_reason(otherwise: str, low: str = "", portrait: str = "", sky: str = "", edges: str = "", texture: str = "") -> str:
    given = {"LOWLIGHT_STRONGNR": low, "PORTRAIT_SOFT": portrait, "SKY_GRADIENT_SAFE": sky, "ARCHITECTURE_EDGES": edges, "TEXTURE_KEEPER": texture}
    return "CASE reason " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in given.items() if v) + f" ELSE {otherwise} END"


# The presets as SQL, with values of its own: choice of the preset, then the canvas, then add-ons.
_SPEC = f"""{_M}, c AS (SELECT *, {_REASON} AS reason, {_ADD} AS addons, (grid_w % 3 + 1)::DOUBLE AS r FROM m),
 s0 AS (SELECT *, {_by_reason("'FOTO/AutoBalanced'", "'FOTO/LowLightISO'", "'FOTO/PortraitSoftSkin'", "'FOTO/LandscapeGradients'", "'FOTO/ArchitectureEdges'", "'FOTO/AnimalsFurFeather'")} AS preset,
  0.5 AS wb_strength, {_by_reason("0.48", low="0.50")} AS gamma_target, {_by_reason("0.08", low="0.08 + 0.02", sky="0.08 + 0.02")} AS rolloff,
  {_by_reason("3", low="5", texture="4")} AS luma_radius, {_by_reason("0.003", low="0.008", edges="0.003 * 0.8")} AS luma_eps, {_by_reason("1.0", low="1.8", portrait="1.4", edges="0.9", texture="1.1")} AS chroma_gain, true AS noise_flat_only,
  {_by_reason("0.25", low="0.25 + 0.10", portrait="0.25 + 0.10", sky="0.25 + 0.05", edges="0.25 - 0.05")} AS smooth_flat, {_by_reason("0.10", portrait="0.10 + 0.05", texture="0.10 - 0.05")} AS smooth_other,
  {_by_reason("-0.07", portrait="-0.10")} AS skin_sat_delta, {_by_reason("0.20", portrait="0.30")} AS skin_tone_smooth, {_by_reason("0.07", portrait="0.0", sky="0.10")} AS sky_hue_shift, {_by_reason("-0.04", portrait="0.0", sky="-0.06")} AS sky_v_delta, {_by_reason("0.0", sky="0.10")} AS sky_grad_smooth,
  {_by_reason("0.8", edges="0.9")} AS edge_protect, {_by_reason("0.28", low="0.24", portrait="0.22", edges="0.33", texture="0.30")} AS sharpen, {_by_reason("1.0", low="1.1", portrait="0.9", edges="1.1")} AS sharpen_radius, {_by_reason("3", low="4", portrait="4", edges="2")} AS sharpen_threshold,
  {_by_reason("0.50", low="0.55", sky="0.55", edges="0.45")} AS k_sigma, {_by_reason("0.5", edges="0.65")} AS edge_scale, 1.0 AS flat_scale, {_by_reason("'mitchell'", edges="'lanczos3'", texture="'lanczos3'")} AS "filter", {_by_reason("2", sky="3", edges="4")} AS micro_phase,
  0.985 AS ssim_min, 0.98 AS edge_keep_min, 0.003 AS banding_max, 3.0 AS de95_max, true AS dering, true AS local_contrast, 1.8 AS clahe_clip,
  {_by_reason("0.40", low="0.50", portrait="0.35", sky="0.55", edges="0.30", texture="0.45")} AS dither, {_by_reason("'Flat|Sky|Skin'", sky="'Flat|Sky'")} AS dither_mask, {_by_reason("'neutral'", portrait="'skin-neutral'", edges="'cool-neutral'", texture="'warm-natural'")} AS palette_bias, '16F' AS bit_depth, 'BALANCED' AS quality FROM c),
 s1 AS (SELECT * REPLACE (reason || '+SMALL_CANVAS' AS reason, 'FOTO/SmallCanvasMinColors' AS preset, rolloff + 0.03 AS rolloff, 1.2 AS chroma_gain, smooth_flat + 0.10 AS smooth_flat, smooth_other + 0.05 AS smooth_other, -0.12 AS skin_sat_delta, 0.35 AS skin_tone_smooth, 0.12 AS sky_hue_shift, -0.07 AS sky_v_delta, 0.20 AS sharpen, 0.9 AS sharpen_radius, 3 AS sharpen_threshold, 0.60 AS k_sigma, 0.60 AS dither, 'low-count' AS palette_bias) FROM s0 WHERE grid_w < 180
  UNION ALL SELECT * REPLACE (reason || '+LARGE_CANVAS' AS reason, 'FOTO/LargeCanvasHiDetail' AS preset, luma_eps * 0.75 AS luma_eps, 0.9 AS chroma_gain, 0.34 AS sharpen, 1.2 AS sharpen_radius, 2 AS sharpen_threshold, 0.45 AS k_sigma, 'lanczos3' AS "filter", micro_phase + 2 AS micro_phase, 0.35 AS dither, 'hi-detail' AS palette_bias) FROM s0 WHERE grid_w >= 300
  UNION ALL SELECT * FROM s0 WHERE grid_w BETWEEN 180 AND 299),
 sp AS (SELECT * REPLACE (CASE WHEN skin_pct >= 0.12 THEN skin_tone_smooth + 0.10 ELSE skin_tone_smooth END AS skin_tone_smooth, CASE WHEN skin_pct >= 0.12 THEN dither_mask || '|Skin' ELSE dither_mask END AS dither_mask,
  CASE WHEN sky_pct >= 0.15 AND grad_sky >= 0.7 THEN greatest(0.10, sky_grad_smooth) ELSE sky_grad_smooth END AS sky_grad_smooth, CASE WHEN sky_pct >= 0.15 AND grad_sky >= 0.7 THEN greatest(dither, 0.55) ELSE dither END AS dither,
  CASE WHEN edge_rate >= 0.28 AND var_lap BETWEEN 0.06 AND 0.12 THEN greatest(1, sharpen_threshold - 1) ELSE sharpen_threshold END AS sharpen_threshold), k_sigma * greatest(0.0, r - 1.0) AS sigma FROM s1)"""
_SPEC_COLS = "preset wb_strength gamma_target rolloff luma_radius luma_eps chroma_gain noise_flat_only smooth_flat smooth_other skin_sat_delta skin_tone_smooth sky_hue_shift sky_v_delta sky_grad_smooth edge_protect sharpen sharpen_radius sharpen_threshold k_sigma edge_scale flat_scale filter micro_phase ssim_min edge_keep_min banding_max de95_max dering local_contrast clahe_clip dither dither_mask palette_bias bit_depth quality".split()


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return rules.gated(_metric_rows(spark, d).withColumn("r", (F.col("grid_w") % 3 + 1).cast("double")))


@query(f"""WITH {_SPEC} SELECT img, reason, array_to_string(addons, ',') AS addons, {', '.join(f'"{c}"' for c in _SPEC_COLS)}, round(sigma, 9) AS sigma_base, round(sigma * edge_scale, 9) AS sigma_edge, round(sigma * flat_scale, 9) AS sigma_flat FROM sp""")
def r02_r03_r04_r05_presets(spark: SparkSession, d: str) -> DataFrame:
    sigmas = [F.round(c, 9).alias(c) for c in ("sigma_base", "sigma_edge", "sigma_flat")]
    return _gated(spark, d).select("img", "reason", F.array_join("addons", ",").alias("addons"), *_SPEC_COLS, *sigmas)


_PARAM_SQL = [
    "'\"wb_strength\":' || wb_strength", "'\"gamma_target\":' || gamma_target", "'\"rolloff\":' || rolloff", "'\"nr_luma_r\":' || luma_radius", "'\"nr_luma_eps\":' || luma_eps", "'\"nr_chroma_gain\":' || chroma_gain", "'\"tex_flat\":' || smooth_flat", "'\"tex_nonflat\":' || smooth_other",
    "'\"skin_sat_delta\":' || skin_sat_delta", "'\"skin_tone_smooth\":' || skin_tone_smooth", "'\"sky_hue_mode\":' || sky_hue_shift", "'\"sky_v_delta\":' || sky_v_delta", "'\"sky_grad_smooth\":' || sky_grad_smooth", "'\"edge_protect\":' || edge_protect", "'\"usm_amount\":' || sharpen", "'\"usm_radius\":' || sharpen_radius", "'\"usm_thr\":' || sharpen_threshold",
    "'\"k_sigma\":' || k_sigma", "'\"edge_scale\":' || edge_scale", "'\"flat_scale\":' || flat_scale", "'\"filter\":\"' || CASE \"filter\" WHEN 'mitchell' THEN 'EWA_Mitchell' ELSE 'EWA_L3' END || '\"'", "'\"micro_phase\":' || micro_phase", "'\"verify_ssim\":' || ssim_min", "'\"verify_edge\":' || edge_keep_min", "'\"verify_banding\":' || banding_max", "'\"verify_de95\":' || de95_max",
    "'\"post_dering\":true'", "'\"post_clahe_clip\":' || clahe_clip", "'\"dither_amp_L\":' || dither", "'\"dither_mask\":\"' || dither_mask || '\"'", "'\"palette_bias\":\"' || palette_bias || '\"'", "'\"quality\":\"BALANCED\"'",
]


@query(f"""WITH {_SPEC} SELECT img, '{{"preset":"' || preset || '","addons":[' || array_to_string(list_transform(addons, lambda v: '"' || v || '"'), ',') || '],"r":' || printf('%.4f', r) || ',"sigma":{{"base":' || printf('%.4f', sigma) || ',"edge":' || printf('%.4f', sigma * edge_scale) || ',"flat":' || printf('%.4f', sigma * flat_scale)
 || '}},"covers":{{"edge":' || printf('%.3f', ((grid_w % 8) / 8.0)::DOUBLE) || ',"flat":' || printf('%.3f', ((grid_w % 4) / 4.0)::DOUBLE) || ',"skin":' || printf('%.3f', skin_pct::DOUBLE) || ',"sky":' || printf('%.3f', sky_pct::DOUBLE) || ',"hitex_fine":' || printf('%.3f', hitex_pct::DOUBLE) || ',"hitex_coarse":' || printf('%.3f', (hitex_pct / 2)::DOUBLE)
 || '}},"reason":"' || reason || '","params":{{' || {" || ',' || ".join(_PARAM_SQL)} || '}}}}' AS json FROM sp""")
def k10_preset_json(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("grid_w")
    covers = {"edge_pct": g % 8 / 8.0, "flat_pct": g % 4 / 4.0, "hitex_fine_pct": F.col("hitex_pct"), "hitex_coarse_pct": F.col("hitex_pct") / 2}
    return sinks.preset_json(_gated(spark, d).withColumns(covers))


@query(f"WITH {S.F1}, {DIM} SELECT img, 'x' AS axis, i::INT AS \"at\", i % 10 = 0 AS bold FROM dim, range(65) t(i) WHERE i <= w UNION ALL SELECT img, 'y', i::INT, i % 10 = 0 FROM dim, range(5000) t(i) WHERE i <= h")
def k13_grid_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.grid_lines(rasters.sizes(f1(spark, d)))


@query(f"WITH {S.F1} SELECT img, y // 4 AS y, x // 4 AS x, {', '.join(f'round(avg({c}), 6) AS {c}' for c in 'rgb')} FROM f1 GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY img, y // 4, x // 4"))
def n20_s16_area_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(resample.area_scaled(f1(spark, d), 4))


_PAL = [(40, 60, 90), (120, 130, 110), (220, 180, 160), (10, 10, 10), (250, 250, 250)]


@query(f"WITH {S.F1} SELECT img, y, x, CASE WHEN r + g + b > 384 THEN 1 ELSE 0 END AS idx FROM f1")
def q04_q08_mapped_colors(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d), _PAL, "none", nearest=lambda r, g, b: (r + g + b > 384).astype(np.int32))


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX} SELECT img, y, x, idx FROM ix")
def k03_k06_s04_s05_index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    p = index(spark, d)
    files = sinks.index_bytes(p, 3).join(rasters.sizes(p), "img")
    return catalogs.index_map(files.select("img", "w", "h", "content"))


@query()
def k17_flow_legend(spark: SparkSession, d: str) -> DataFrame:
    return sinks.flow_rows(rasters.swatches(spark, d).select(F.col("idx").alias("pos"), (F.length("code") * 3 + F.col("idx") % 5).cast("int").alias("size")), 120)


@query(f"WITH {S.F1} SELECT img, y, x, r, g, b, CASE WHEN r > 120 THEN 255 ELSE 0 END AS alpha FROM f1")
def k01_k11_planes(spark: SparkSession, d: str) -> DataFrame:
    """Hand-off of a plane and a mask as columns of a table by image."""
    return f1(spark, d).select("img", "y", "x", *(C.byte(C.encoded(C.linear(C.unit(F.col(c))))).alias(c) for c in "rgb"), F.when(F.col("r") > 120, 255).otherwise(0).alias("alpha"))


@query(f"WITH {S.F1} SELECT img, y, x, r, g, b FROM f1")
def s01_s16_k01_k02_png_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Each image as a PNG file's bytes and decoded again."""
    return rasters.png_pixels(sinks.png_files(f1(spark, d)))


@query()
def k01_k02_png_files(spark: SparkSession, d: str) -> DataFrame:
    return sinks.png_files(f1(spark, d)).select("img", "name", F.length("content").alias("bytes"))
