"""Queries on planes: stencils, masks, metrics, matching, topology, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import kernels, masks, matching, metrics, resample, rules, stencils, topology
from ..sources import rasters, sinks
from . import sql as S
from .scalars import rounded

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


def rgb() -> tuple:
    return tuple(F.col(c) for c in "rgb")


def linear_luma(px: DataFrame) -> DataFrame:
    return px.withColumn("luma", C.luma709(*(C.linear(C.unit(c)) for c in rgb())))


def f1(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embedding_images(spark, d)


def units(spark: SparkSession, d: str) -> DataFrame:
    p = f1(spark, d).select("img", "y", "x", *(C.unit(F.col(c)).alias(c) for c in "rgb"))
    return p.withColumn("luma", C.luma709(*rgb()))


def trio(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, 40, 60, 90), (1, 120, 130, 110), (2, 220, 180, 160)], "idx int, r int, g int, b int")


def index(spark: SparkSession, d: str) -> DataFrame:
    return matching.indexed(rasters.blocky_images(spark, d), trio(spark))


BASE = f"WITH {S.F1}, {S.LUMA}"
NB = f"""nb AS (SELECT *, lag(w) OVER v AS nw, lead(w) OVER v AS sw, lag(e) OVER v AS ne, lead(e) OVER v AS se, lag(luma) OVER v AS n, lead(luma) OVER v AS s FROM
 (SELECT *, lag(luma) OVER h AS w, lead(luma) OVER h AS e FROM lum WINDOW h AS ({R})) WINDOW v AS ({K}))"""
MAG = "mg AS (SELECT *, CASE WHEN nw IS NULL OR se IS NULL OR ne IS NULL OR sw IS NULL THEN 0.0 ELSE sqrt(power((ne-nw)+2*(e-w)+(se-sw), 2) + power((nw+2*n+ne)-(sw+2*s+se), 2)) END AS mag, coalesce(w+e+n+s-4*luma, 0.0) AS lap FROM nb)"""


def _box(r: int, src: str, c: str = "luma") -> str:
    return f"""(SELECT p.img, p.y, p.x, greatest(0.0, avg(q.{c} * q.{c}) - avg(q.{c}) * avg(q.{c})) AS v FROM {src} p JOIN {src} q ON q.img = p.img AND q.y BETWEEN p.y - {r} AND p.y + {r} AND q.x BETWEEN p.x - {r} AND p.x + {r} GROUP BY ALL)"""


def _var_sql(src: str) -> str:
    """var3, var7, var9 by integral sums of clipped boxes."""
    a = ", ".join(f"sum(luma) OVER (h ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s{r}, sum(luma*luma) OVER (h ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS q{r}, count(*) OVER (h ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS c{r}" for r in (1, 3, 4))
    b = ", ".join(f"greatest(0.0, sum(q{r}) OVER w{r} / sum(c{r}) OVER w{r} - power(sum(s{r}) OVER w{r} / sum(c{r}) OVER w{r}, 2)) AS var{2 * r + 1}" for r in (1, 3, 4))
    ws = ", ".join(f"w{r} AS ({K} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)" for r in (1, 3, 4))
    return f"(SELECT img, y, x, r, g, b, luma, {b} FROM (SELECT *, {a} FROM {src} WINDOW h AS ({R})) WINDOW {ws})"


@query(f"{BASE}, {NB}, {MAG} SELECT img, y, x, round(mag, 6) AS mag, round(lap, 6) AS lap FROM mg")
def n01_n02_gradients(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.laplacian(stencils.sobel(linear_luma(f1(spark, d)), "luma"), "luma")
    return rounded(p.select("img", "y", "x", "mag", "lap"))


@query(f"{BASE} SELECT img, y, x, round(var3, 8) AS var3, round(var7, 8) AS var7, round(var9, 8) AS var9 FROM {_var_sql('lum')}")
def n03_local_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stencils.local_variance(linear_luma(f1(spark, d)), "luma").select("img", "y", "x", "var3", "var7", "var9"), 8)


def _rank(c: str, mask: str) -> str:
    return f"round({c}, 9)"


@query(f"""{BASE}, {NB}, {MAG}, vr AS (SELECT * FROM {_var_sql('lum')}), q AS (SELECT img, greatest(0.02, quantile_cont(mag, 0.85) * 0.5) AS t FROM mg GROUP BY img),
 f AS (SELECT img, quantile_cont(round(var7, 9), 0.35) AS t7, quantile_cont(round(var3, 9), 0.7) AS t3, quantile_cont(round(var9, 9), 0.7) AS t9 FROM vr GROUP BY img)
SELECT img, y, x, mag > q.t AS edge, round(var7, 9) < t7 AS flat, round(var3, 9) > t3 AS hitex_fine, round(var9, 9) > t9 AS hitex_coarse FROM mg JOIN vr USING (img, y, x) JOIN q USING (img) JOIN f USING (img)""")
def f01_f02_f03_a01_masks(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.local_variance(stencils.sobel(linear_luma(f1(spark, d)), "luma"), "luma")
    p = p.withColumns({c: F.round(c, 9) for c in ("var3", "var7", "var9")})
    return masks.surfaces(p).select("img", "y", "x", "edge", "flat", "hitex_fine", "hitex_coarse")


def _morph(src: str, c: str) -> str:
    out = src
    for f in ("min", "max", "max", "min"):
        out = f"(SELECT * EXCLUDE (_t) REPLACE ({f}(_t) OVER ({K} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS {c}) FROM (SELECT *, {f}({c}) OVER ({R} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS _t FROM {out}))"
    return out


_CB, _CR = S.fit("(-0.168736*r-0.331264*g+0.5*b+128)"), S.fit("(0.5*r-0.418688*g-0.081312*b+128)")


@query(f"""WITH {S.F6}, {S.LUMA6}, vr AS (SELECT * FROM {_var_sql('lum')}), q AS (SELECT img, quantile_cont(round(var7, 9), 0.5) AS qt FROM vr GROUP BY img), k AS (SELECT img, y, x, (r > 95 AND g > 40 AND b > 20 AND greatest(r,g,b)-least(r,g,b) > 15 AND abs(r-g) > 15 AND r > g AND r > b AND {_CR} BETWEEN 133 AND 173 AND {_CB} BETWEEN 77 AND 127)::INT AS skin,
 (hue BETWEEN 190 AND 250 AND (t - n)/greatest(t, 1e-9) BETWEEN 0.1 AND 0.8 AND t >= 0.55 AND round(var7, 9) <= qt)::INT AS sky FROM (SELECT *, greatest(r,g,b)/255.0 AS t, least(r,g,b)/255.0 AS n,
 CASE WHEN greatest(r,g,b) = least(r,g,b) THEN 0.0 WHEN r >= g AND r >= b THEN (g-b)/(greatest(r,g,b)-least(r,g,b))::DOUBLE + CASE WHEN g < b THEN 6 ELSE 0 END WHEN g >= b THEN (b-r)/(greatest(r,g,b)-least(r,g,b))::DOUBLE + 2 ELSE (r-g)/(greatest(r,g,b)-least(r,g,b))::DOUBLE + 4 END * 60 AS hue FROM vr) JOIN q USING (img))
SELECT img, y, x, skin = 1 AS skin, sky = 1 AS sky FROM {_morph(_morph('k', 'skin'), 'sky')}""".replace("CASE WHEN greatest(r,g,b) = least(r,g,b)", "60 * (CASE WHEN greatest(r,g,b) = least(r,g,b)").replace("+ 4 END * 60 AS hue", "+ 4 END) AS hue"))
def f04_f05_n04_skin_sky(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.local_variance(linear_luma(rasters.scenes(spark, d)), "luma").withColumn("var7", F.round("var7", 9))
    return masks.sky(masks.skin(p)).select("img", "y", "x", "skin", "sky")


@query(f"""WITH {S.F1}, {S.UNIT}, s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM u GROUP BY img), li AS (SELECT f1.*, floor({S.luma()})::INT AS l FROM f1),
 g AS (SELECT *, abs(l - lag(l) OVER ({R})) + abs(l - lag(l) OVER ({K})) AS grad FROM li), o AS (SELECT img, list(grad ORDER BY grad) AS a FROM g WHERE grad IS NOT NULL GROUP BY img),
 t AS (SELECT img, CASE WHEN a[floor(len(a) * 0.85)::INT + 1] = 0 THEN list_filter(a, lambda v: v > 0)[1] ELSE a[floor(len(a) * 0.85)::INT + 1] END AS thr FROM o),
 e AS (SELECT img, y, x, abs(luma - lag(luma) OVER ({R})) AS st FROM u)
SELECT img, g.y, g.x, coalesce(g.x BETWEEN 1 AND w - 2 AND g.y BETWEEN 1 AND h - 2 AND grad >= thr, false) AS ranked, coalesce(e.x BETWEEN 1 AND w - 2 AND e.y BETWEEN 1 AND h - 2 AND round(st, 9) > 0.04, false) AS stepped, grad % 3 = 0 OR grad % 5 = 0 AS either, l <> 0 AS solid
FROM g JOIN e USING (img, y, x) JOIN s USING (img) JOIN t USING (img) WHERE grad IS NOT NULL""")
def f06_f07_f08_f09_edges(spark: SparkSession, d: str) -> DataFrame:
    p = stencils.with_size(f1(spark, d).withColumn("l", C.luma709_int(*rgb())))
    a = masks.ranked_edges(p).select("img", "y", "x", F.col("edge").alias("ranked"))
    b = masks.step_edges(stencils.with_size(units(spark, d)), "luma")
    b = b.withColumn("edge", F.col("x").between(1, F.col("w") - 2) & F.col("y").between(1, F.col("h") - 2) & (F.round(F.abs(F.col("luma") - F.lag("luma").over(stencils.along_row())), 9) > 0.04)).select("img", "y", "x", F.coalesce("edge", F.lit(False)).alias("stepped"))
    g = p.withColumn("grad", F.abs(F.col("l") - F.lag("l").over(stencils.along_row())) + F.abs(F.col("l") - F.lag("l").over(stencils.along_col()))).where("grad IS NOT NULL")
    g = g.select("img", "y", "x", ((F.col("grad") % 3 == 0) | (F.col("grad") % 5 == 0)).alias("either"), (F.col("l") != 0).alias("solid"))
    return a.join(b, ["img", "y", "x"]).join(g, ["img", "y", "x"])


@query(f"""{BASE}, o AS (SELECT * FROM {S.ok('f1')}), m AS (SELECT img, quantile_cont(luma, 0.5) AS med, quantile_cont(luma, 0.99) - quantile_cont(luma, 0.01) AS dr, avg((luma <= 0.01)::INT) AS lo, avg((luma >= 0.99)::INT) AS hi FROM lum GROUP BY img),
 c AS (SELECT img, sqrt(avg(ok_a*ok_a) + avg(ok_b*ok_b)) AS cc, quantile_cont(ok_a, 0.5) AS ma, quantile_cont(ok_b, 0.5) AS mb FROM o GROUP BY img), n AS (SELECT img, quantile_cont(abs(ok_a - ma), 0.5) AS da, quantile_cont(abs(ok_b - mb), 0.5) AS db FROM o JOIN c USING (img) GROUP BY img)
SELECT img, round(med, 6) AS median, round(dr, 6) AS dynamic_range, round(lo, 6) AS clip_low, round(hi, 6) AS clip_high, round(cc, 6) AS color_cast, round(0.5 * (da + db), 6) AS noise_c FROM m JOIN c USING (img) JOIN n USING (img)""")
def a02_a03_a04_a05_luma_chroma(spark: SparkSession, d: str) -> DataFrame:
    p = matching.with_oklab(f1(spark, d))
    mad = metrics.median_deviation(p, ["ok_a", "ok_b"]).select("img", (0.5 * (F.col("mad_ok_a") + F.col("mad_ok_b"))).alias("noise_c"))
    return rounded(metrics.luma_statistics(linear_luma(p)).join(metrics.color_cast(p), "img").join(mad, "img"))


@query(f"""{BASE}, {NB}, {MAG}, c5 AS (SELECT img, (r >> 3 << 10) | (g >> 3 << 5) | (b >> 3) AS k, count(*) AS n FROM f1 GROUP BY ALL), t5 AS (SELECT img, count(*) AS colors, sum(n) FILTER (rk <= 8) / sum(n) AS cov FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, k) AS rk FROM c5) GROUP BY img),
 dk AS (SELECT img, min(v) OVER ({K} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM (SELECT img, y, x, min(least(r, g, b) / 255.0) OVER ({R} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS v FROM f1)), hz AS (SELECT img, 1 - avg(v) AS haze FROM dk GROUP BY img)
SELECT img, round(var_pop(lap), 6) AS var_lap, round(coalesce(quantile_cont(mag, 0.95) FILTER (r > 150), 0.0), 6) AS grad_p95, round(avg((mag > 0.1)::INT), 6) AS covered, any_value(colors) AS colors, round(any_value(cov), 6) AS coverage, round(any_value(haze), 6) AS haze FROM mg JOIN t5 USING (img) JOIN hz USING (img) GROUP BY img""")
def a06_a07_a08_a09_a11_n05_t01_statistics(spark: SparkSession, d: str) -> DataFrame:
    px = f1(spark, d)
    p = stencils.laplacian(stencils.sobel(linear_luma(px), "luma"), "luma").withColumn("m", F.col("r") > 150)
    v = p.groupBy("img").agg(F.var_pop("lap").alias("var_lap"), metrics.share(F.col("mag") > 0.1).alias("covered"))
    cov = metrics.color_coverage(px, C.code15(*rgb()))
    return rounded(v.join(metrics.masked_percentile(p, "mag", "m", 0.95, "grad_p95"), "img").join(cov, "img").join(metrics.haze(px), "img"))


@query(f"""WITH {S.F3}, c AS (SELECT img, r * 65536 + g * 256 + b AS k, y, x FROM f3), n AS (SELECT img, k, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT img, count(*) AS colors, sum(n) FILTER (rk <= 8) / sum(n) AS cov FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, k) AS rk FROM n) GROUP BY img),
 b AS (SELECT a.img, avg((len(list_distinct([a.k, e.k, s.k, z.k])) <= 2)::INT) AS chk FROM c a JOIN c e ON e.img = a.img AND e.y = a.y AND e.x = a.x + 1 JOIN c s ON s.img = a.img AND s.y = a.y + 1 AND s.x = a.x JOIN c z ON z.img = a.img AND z.y = a.y + 1 AND z.x = a.x + 1 GROUP BY a.img)
SELECT img, colors, round(cov, 6) AS coverage, round(chk, 6) AS checker FROM t JOIN b USING (img)""")
def a10_a12_a15_colors_checker(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.blocky_images(spark, d)
    return rounded(metrics.color_coverage(p, C.pack_argb(*rgb())).join(metrics.checker_share(p), "img"))


@query(f"""WITH {S.F3}, {S.TRIO}, {S.IDX}, st AS (SELECT img, min(idx) AS least, max(idx) AS most, count(DISTINCT idx) AS "distinct", count(*) AS cells FROM ix GROUP BY img),
 ch AS (SELECT img, sum((idx <> p)::INT) * 100.0 / count(*) AS c FROM (SELECT img, idx, lag(idx) OVER ({R}) AS p FROM ix) GROUP BY img),
 rn AS (SELECT img, y, run, count(*) AS n FROM (SELECT img, y, sum(f) OVER ({R}) AS run FROM (SELECT img, y, x, (idx IS DISTINCT FROM lag(idx) OVER ({R}))::INT AS f FROM ix)) GROUP BY ALL), rm AS (SELECT img, quantile_cont(n, 0.5) AS m FROM rn GROUP BY img),
 nb AS (SELECT a.img, a.y, a.x, b.y AS ny, b.x AS nx FROM ix a JOIN ix b ON a.img = b.img AND a.idx = b.idx AND abs(a.x - b.x) + abs(a.y - b.y) = 1 AND b.x BETWEEN a.x - 1 AND a.x + 1),
 dg AS (SELECT ix.img, ix.y, ix.x, count(nb.ny) AS deg, any_value(nb.ny) AS ny, any_value(nb.nx) AS nx FROM ix LEFT JOIN nb USING (img, y, x) GROUP BY ALL),
 si AS (SELECT a.img, (count(*) FILTER (a.deg = 0) + count(*) FILTER (a.deg = 1 AND m.deg = 1) / 2.0) * 1000.0 / count(*) AS i FROM dg a LEFT JOIN dg m ON a.deg = 1 AND m.img = a.img AND m.y = a.ny AND m.x = a.nx GROUP BY a.img)
SELECT img, least, most, "distinct", cells, true AS "full", true AS in_range, round(c, 6) AS changes_per_100, round(m, 6) AS run_median, round(i, 6) AS islands_per_1000 FROM st JOIN ch USING (img) JOIN rm USING (img) JOIN si USING (img)""")
def a13_a26_a27_a28_a30_r09_index_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = index(spark, d)
    out = metrics.index_statistics(p).join(rules.consistent(p, 3), "img").join(metrics.thread_changes(p), "img")
    return rounded(out.join(metrics.run_median(p), "img").join(metrics.small_islands(p), "img"))


def _near_ok(src: str, pal: str) -> str:
    """(r, g, b, idx, d) of distinct colors: nearest of ``pal`` in OKLab."""
    return f"(SELECT r, g, b, m.idx AS idx, m.d AS d FROM (SELECT c.r, c.g, c.b, min({{'d': round({S.d2('c.ok_', 't.ok_')}, 12), 'idx': t.idx}}) AS m FROM {S.ok(f'(SELECT DISTINCT r, g, b FROM {src})')} c, {S.ok(pal)} t GROUP BY ALL))"


@query(f"""WITH {S.F1}, {S.F5}, n AS (SELECT img, r, g, b, count(*) AS n FROM f1 GROUP BY ALL), k AS (SELECT * FROM {_near_ok('f1', 'sw')}), c AS (SELECT img, idx, sum(n)::BIGINT AS count FROM n JOIN k USING (r, g, b) GROUP BY ALL),
 t AS (SELECT *, floor(count * 100 / sum(count) OVER (PARTITION BY img))::BIGINT AS percent, row_number() OVER (PARTITION BY img ORDER BY count DESC, idx) AS rank FROM c) SELECT img, rank, code, count, percent, round(count * 2.8 * (25.4 / 14) * 2 * 1.1 / 1000, 4) AS metres FROM t JOIN sw USING (idx) WHERE rank <= 50""")
def a14_j02_j06_thread_stats(spark: SparkSession, d: str) -> DataFrame:
    return matching.thread_statistics(f1(spark, d), rasters.swatches(spark, d))


@query(f"""WITH {S.F3}, {S.TRIO}, {S.IDX}, k AS (SELECT * FROM {_near_ok('f3', 'trio')}), s AS (SELECT img, y, x, k.idx AS i2, k.d AS d2 FROM f3 JOIN k USING (r, g, b)),
 er AS (SELECT img, idx, avg(d2 * CASE WHEN x % 2 = 0 THEN 1.3 ELSE 1.0 END) AS m, sum(d2 * CASE WHEN x % 2 = 0 THEN 1.3 ELSE 1.0 END) AS e FROM (SELECT img, x, i2 AS idx, d2 FROM s) GROUP BY ALL)
SELECT img, round(sum(e), 6) AS error, arg_min(idx, (-round(m, 9), idx)) AS worst FROM er GROUP BY img""".replace("arg_min(idx, (-round(m, 9), idx))", "min({'k': -round(m, 9), 'i': idx}).i"))
def j05_a18_assigned_error(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.blocky_images(spark, d)
    w = F.when(F.col("x") % 2 == 0, 1.3).otherwise(1.0)
    own = matching.indexed(p, trio(spark), "oklab").withColumn("err", F.col("d") * w)
    return rounded(matching.assigned_error(p, trio(spark), w).join(metrics.worst_cluster(own).withColumnRenamed("idx", "worst"), "img"))


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX} SELECT img, y, x, idx, d FROM ix")
def j03_j04_j15_nearest_rgb(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).select("img", "y", "x", "idx", "d")


@query(f"""WITH {S.F3}, {S.F5}, {S.TRIO}, a AS (SELECT * FROM {_near_ok('f3', 'trio')}), m AS (SELECT trio.idx AS idx, z.idx AS "to" FROM trio JOIN {_near_ok('trio', 'sw')} z USING (r, g, b)) SELECT img, y, x, sw.r, sw.g, sw.b FROM f3 JOIN a USING (r, g, b) JOIN m ON m.idx = a.idx JOIN sw ON sw.idx = m."to" """)
def j01_recolored(spark: SparkSession, d: str) -> DataFrame:
    return matching.recolored(rasters.blocky_images(spark, d), trio(spark), rasters.swatches(spark, d))


def _match_sql(space: str) -> str:
    fn = S.lab if space == "lab" else S.ok
    p = "lab" if space == "lab" else "ok"
    first = "<" if space == "lab" else "<="
    mixed = f"(SELECT i.idx, i.lab_l, i.lab_a, i.lab_b, i.ra, i.rb, i.ca, i.cb, (i.r1 + i.r2) // 2 AS r, (i.g1 + i.g2) // 2 AS g, (i.b1 + i.b2) // 2 AS b FROM pr i)"
    de = f"round(sqrt({S.d2('lab_', 'mix_')}), 9)" if space == "lab" else "round(sqrt(power(ok_l - (l1+l2)/2, 2) + power(ok_a - (a1+a2)/2, 2) + power(ok_b - (k1+k2)/2, 2)), 9)"
    src = S.lab(mixed, "mix") if space == "lab" else "pr"
    ok = "de * 1.1 + 1e-9 < single" if space == "lab" else "de < single * 0.8"
    return f"""pal AS (SELECT idx, r, g, b, {p}_l, {p}_a, {p}_b FROM {fn('(SELECT idx, (r * 3 + 20) % 256 AS r, (g * 5 + 7) % 256 AS g, b FROM sw)')}), cat AS (SELECT code, r, g, b, {p}_l, {p}_a, {p}_b FROM {fn('sw')}),
 nr AS (SELECT * FROM (SELECT p.idx, c.code, round(sqrt({S.d2(f'p.{p}_', f'c.{p}_')}), 9) AS d, row_number() OVER (PARTITION BY p.idx ORDER BY round(sqrt({S.d2(f'p.{p}_', f'c.{p}_')}), 9), c.code) AS rk FROM pal p, cat c) WHERE rk <= 6),
 pr AS (SELECT pal.*, a.rk AS ra, b.rk AS rb, a.code AS ca, b.code AS cb, x.r AS r1, x.g AS g1, x.b AS b1, y.r AS r2, y.g AS g2, y.b AS b2, x.{p}_l AS l1, x.{p}_a AS a1, x.{p}_b AS k1, y.{p}_l AS l2, y.{p}_a AS a2, y.{p}_b AS k2 FROM nr a JOIN nr b ON a.idx = b.idx AND a.rk {first} b.rk JOIN cat x ON x.code = a.code JOIN cat y ON y.code = b.code JOIN pal ON pal.idx = a.idx),
 bs AS (SELECT idx, min({{'de': {de}, 'ra': ra, 'rb': rb, 'ca': ca, 'cb': cb}}) AS m FROM {src} GROUP BY idx),
 bo AS (SELECT n.idx, n.code AS one, n.d AS single, m.de AS de, m.ca AS ca, m.cb AS cb, {ok} AS good FROM nr n JOIN bs USING (idx) WHERE n.rk = 1),
 mt AS (SELECT *, good AND sum(good::INT) OVER (ORDER BY idx) <= 4 AS bl FROM bo), en AS (SELECT idx, CASE WHEN bl THEN 'blend' ELSE 'single' END AS type, CASE WHEN bl THEN ca ELSE one END AS code_a, CASE WHEN bl THEN cb END AS code_b, CASE WHEN bl THEN de ELSE single END AS de FROM mt)"""


def _palette(spark: SparkSession, d: str) -> DataFrame:
    s = rasters.swatches(spark, d)
    return s.select("idx", ((F.col("r") * 3 + 20) % 256).alias("r"), ((F.col("g") * 5 + 7) % 256).alias("g"), "b")


@query(f"WITH {S.F5}, {_match_sql('lab')} SELECT idx, type, code_a, code_b, round(de, 6) AS de FROM en")
def j10_t03_matched(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.matched(_palette(spark, d), rasters.swatches(spark, d)))


@query(f"WITH {S.F5}, {_match_sql('ok')} SELECT idx, type, code_a, code_b, round(de, 6) AS de FROM en")
def j11_t02_matched_oklab(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matching.matched(_palette(spark, d), rasters.swatches(spark, d), "ok"))


@query(f"WITH {S.F5}, {_match_sql('lab')} SELECT floor(avg(de) * 100 + 0.5) / 100 AS avg_de, floor(max(de) * 100 + 0.5) / 100 AS max_de, count(*) FILTER (type = 'blend') AS blends FROM en")
def a29_match_summary(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_summary(matching.matched(_palette(spark, d), rasters.swatches(spark, d)))


@query(f"WITH {S.F5}, {_match_sql('lab')} SELECT idx, CASE WHEN code_b IS NULL THEN x.r ELSE (x.r + y.r) // 2 END AS r, CASE WHEN code_b IS NULL THEN x.g ELSE (x.g + y.g) // 2 END AS g, CASE WHEN code_b IS NULL THEN x.b ELSE (x.b + y.b) // 2 END AS b FROM en JOIN sw x ON x.code = code_a LEFT JOIN sw y ON y.code = code_b".replace("SELECT idx, CASE WHEN code_b", "SELECT en.idx, CASE WHEN code_b"))
def j08_j14_resolved(spark: SparkSession, d: str) -> DataFrame:
    s = rasters.swatches(spark, d)
    p = _palette(spark, d)
    return matching.resolved(p.count(), matching.matched(p, s), s)


@query(f"WITH {S.F5}, {_match_sql('lab')} SELECT pal.idx, printf('#%02X%02X%02X', pal.r, pal.g, pal.b) AS rgb, CASE WHEN pal.idx < 8 THEN chr(65 + pal.idx) ELSE '?' END AS symbol, CASE WHEN type IS NOT NULL THEN 'TST' END AS brand, type, code_a AS code, code_b FROM pal LEFT JOIN en ON en.idx = pal.idx + 3")
def j09_k07_legend(spark: SparkSession, d: str) -> DataFrame:
    p = _palette(spark, d)
    # matches of shifted indexes: the last three colors have none
    e = matching.matched(p, rasters.swatches(spark, d)).withColumn("idx", F.col("idx") - 3)
    sym = spark.range(8).select(F.col("id").cast("int").alias("idx"), F.char(F.col("id") + 65).alias("symbol"))
    return matching.legend(p, e, sym, "TST")


@query(f"""WITH {S.F1}, n AS (SELECT img, w, h, greatest(1, ceil((w - 4) / 16.0))::INT AS nx, greatest(1, ceil((h - 4) / 11.0))::INT AS ny FROM (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM f1 GROUP BY img)),
p AS (SELECT img, i AS px, j AS py, i * 16 AS sx, j * 11 AS sy, least(w, i * 16 + 20) AS ex, least(h, j * 11 + 15) AS ey FROM n, (SELECT unnest(range(5000)) AS j) u, (SELECT unnest(range(6)) AS i) t WHERE i < nx AND j < ny)
SELECT p.img, px AS page_x, py AS page_y, count(*) AS cells, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(r)::BIGINT AS sum_r FROM p JOIN f1 ON f1.img = p.img AND x >= sx AND x < ex AND y >= sy AND y < ey GROUP BY p.img, px, py""")
def j07_page_cells(spark: SparkSession, d: str) -> DataFrame:
    p = matching.pages_of_cells(stencils.with_size(f1(spark, d)), 20, 15, 4)
    return p.groupBy("img", "page_x", "page_y").agg(F.count(F.lit(1)).alias("cells"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.sum("r").alias("sum_r"))


@query(f"WITH {S.F1}, s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM f1 GROUP BY img), n AS (SELECT *, greatest(1, ceil((w - 2) / 18.0))::INT AS nx, greatest(1, ceil((h - 2) / 13.0))::INT AS ny FROM s) SELECT img, (j * nx + i + 1)::INT AS page, i * 18 AS sx, j * 13 AS sy, least(w, i * 18 + 20) AS ex, least(h, j * 13 + 15) AS ey FROM n, range(9) t(i), range(30) u(j) WHERE i < nx AND j < ny")
def k14_k15_page_plan(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_plan(rasters.sizes(f1(spark, d)), 20, 15, 2)


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX}, s AS (SELECT img, greatest(1, least(1024 // greatest(max(x) + 1, max(y) + 1), 16))::INT AS k FROM ix GROUP BY img) SELECT img, y, x, x * k AS \"left\", y * k AS top, k AS side, (t.r + 255) // 2 AS r, (t.g + 255) // 2 AS g, (t.b + 255) // 2 AS b, chr(65 + t.idx) AS symbol, k >= 6 AS grid FROM ix JOIN s USING (img) JOIN trio t ON t.idx = ix.idx")
def k12_render_plan(spark: SparkSession, d: str) -> DataFrame:
    pal = trio(spark).withColumn("symbol", F.char(F.col("idx") + 65))
    return sinks.render_plan(stencils.with_size(index(spark, d).select("img", "y", "x", "idx")), pal)


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX} SELECT img, y, x, t.r, t.g, t.b FROM ix JOIN trio t ON t.idx = ix.idx".replace("SELECT img, y, x, t.r", "SELECT ix.img, ix.y, ix.x, t.r"))
def k02_recolored(spark: SparkSession, d: str) -> DataFrame:
    return sinks.recolored(index(spark, d), trio(spark), 3)


@query(f"WITH {S.F5}, {_match_sql('lab')} SELECT '{{\"k\":' || count(*)::VARCHAR || ',\"colors\":[' || string_agg(printf('\"#%02X%02X%02X\"', r, g, b), ',' ORDER BY idx) || ']}}' AS palette, (SELECT '{{\"brand\":\"TST\",\"entries\":[' || string_agg('{{\"idx\":' || idx::VARCHAR || ',\"type\":\"' || type || '\"' || CASE type WHEN 'single' THEN ',\"code\":\"' || code_a || '\"' ELSE ',\"codeA\":\"' || code_a || '\",\"codeB\":\"' || code_b || '\"' END || '}}', ',' ORDER BY idx) || ']}}' FROM en) AS matches FROM pal")
def k04_k05_json(spark: SparkSession, d: str) -> DataFrame:
    p = _palette(spark, d)
    e = matching.matched(p, rasters.swatches(spark, d))
    return sinks.palette_json(p).select(F.col("json").alias("palette")).join(sinks.matches_json(e, "TST").select(F.col("json").alias("matches")), F.lit(True))


@query(f"WITH {S.F5} SELECT '{{' || string_agg('\"' || idx::VARCHAR || '\":\"Z\"', ',' ORDER BY idx::VARCHAR) || '}}' AS json FROM sw WHERE idx % 3 = 0")
def k08_k09_overrides(spark: SparkSession, d: str) -> DataFrame:
    s = rasters.swatches(spark, d).select("idx", F.lit("A").alias("symbol"), F.when(F.col("idx") % 3 == 0, "Z").otherwise("A").alias("shown"))
    return sinks.overrides(s)


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX}, m AS (SELECT idx, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM ix WHERE idx <> 1 GROUP BY idx) SELECT t.idx, coalesce(m.r, t.r)::INT AS r, coalesce(m.g, t.g)::INT AS g, coalesce(m.b, t.b)::INT AS b FROM trio t LEFT JOIN m ON m.idx = t.idx")
def a16_a17_cluster_means(spark: SparkSession, d: str) -> DataFrame:
    return metrics.cluster_means(index(spark, d).where("idx <> 1"), trio(spark))


@query(f"WITH {S.F5}, p AS (SELECT sqrt({S.d2('a.ok_', 'b.ok_')}) AS d FROM {S.ok('sw')} a JOIN {S.ok('sw')} b ON a.idx < b.idx) SELECT round(min(d), 6) AS de_min, round((list(d ORDER BY d))[len(list(d)) // 2 + 1], 6) AS de_med FROM p")
def a19_palette_separation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.palette_separation(rasters.swatches(spark, d)))


_OUT = "o AS (SELECT img, y, x, power(r, 1.1) AS r, power(g, 0.9) AS g, b * 0.97 AS b FROM u), ol AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma FROM o)"


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u = units(spark, d)
    o = u.select("img", "y", "x", F.pow("r", F.lit(1.1)).alias("r"), F.pow("g", F.lit(0.9)).alias("g"), (F.col("b") * 0.97).alias("b"))
    return u, o.withColumn("luma", C.luma709(*rgb()))


@query(f"""WITH {S.F1}, {S.UNIT}, {_OUT}, ss AS (SELECT u.img, (2*avg(u.luma)*avg(ol.luma)+0.0001)*(2*covar_samp(u.luma, ol.luma)+0.0009)/((avg(u.luma)*avg(u.luma)+avg(ol.luma)*avg(ol.luma)+0.0001)*(var_samp(u.luma)+var_samp(ol.luma)+0.0009)) AS ssim FROM u JOIN ol USING (img, y, x) GROUP BY u.img),
 e1 AS (SELECT img, avg((d > 0.03)::INT) AS e FROM (SELECT img, abs(luma - lag(luma) OVER ({R})) AS d FROM u) WHERE d IS NOT NULL GROUP BY img), e2 AS (SELECT img, avg((d > 0.03)::INT) AS e FROM (SELECT img, abs(luma - lag(luma) OVER ({R})) AS d FROM ol) WHERE d IS NOT NULL GROUP BY img),
 bd AS (SELECT img, CASE WHEN count(*) FILTER (gr > 0.01) = 0 THEN 0.0 ELSE count(*) FILTER (gr > 0.01 AND go < 0.003) / (count(*) FILTER (gr > 0.01))::DOUBLE END AS b FROM (SELECT img, abs(lead(u.luma) OVER w - lag(u.luma) OVER w) AS gr, abs(lead(ol.luma) OVER w - lag(ol.luma) OVER w) AS go FROM u JOIN ol USING (img, y, x) WINDOW w AS (PARTITION BY img, y ORDER BY x)) GROUP BY img),
 dd AS (SELECT img, list(d ORDER BY d) AS a FROM (SELECT a.img, sqrt({S.d2('a.ok_', 'b.ok_')}) AS d FROM {S.ok('u', linear=True)} a JOIN {S.ok('o', linear=True)} b USING (img, y, x)) GROUP BY img), de AS (SELECT img, a[floor(len(a) * 0.95)::INT + 1] AS de95 FROM dd)
SELECT img, round(greatest(0.0, least(1.0, ssim)), 6) AS ssim, round(CASE WHEN e1.e <= 1e-8 THEN 1.0 ELSE greatest(0.0, least(1.5, e2.e / e1.e)) END, 6) AS edge_keep, round(b, 6) AS banding, round(de95, 6) AS de95, ssim >= 0.985 AND e2.e / e1.e >= 0.98 AND b <= 0.003 AND de95 <= 3.0 AS pass FROM ss JOIN e1 USING (img) JOIN e2 USING (img) JOIN bd USING (img) JOIN de USING (img)""")
def a20_a21_a22_a23_r06_checks(spark: SparkSession, d: str) -> DataFrame:
    u, o = _pair(spark, d)
    m = metrics.similarity(u, o).join(metrics.edge_keep(u, o), "img").join(metrics.banding(u, o), "img").join(metrics.delta_e95(u, o), "img")
    return rounded(m.withColumn("pass", rules.verified(F.col("ssim"), F.col("edge_keep"), F.col("banding"), F.col("de95"))))


@query(f"""WITH {S.F1}, {S.UNIT}, s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM u GROUP BY img), l AS (SELECT *, lag(luma) OVER ({R}) AS lx, lag(luma) OVER ({K}) AS ly FROM u),
 e AS (SELECT img, sum(abs(luma - lx)) AS e FROM l JOIN s USING (img) WHERE y BETWEEN 1 AND h - 2 AND x BETWEEN 1 AND w - 2 GROUP BY img),
 b AS (SELECT img, avg(abs(luma - lx)) FILTER (x % 8 = 0 AND x > 0) AS v, avg(abs(luma - ly)) FILTER (y % 8 = 0 AND y > 0) AS h FROM l GROUP BY img)
SELECT img, round(e, 5) AS energy, round(v, 6) AS vertical, round(h, 6) AS horizontal, round((v + h) * 0.5, 6) AS "both", round(CASE WHEN (v + h) * 0.5 >= 0.008 THEN least(0.7, 12 * (v + h) * 0.5) END, 6) AS strength FROM e JOIN b USING (img)""")
def a24_a25_r07_energy_blockiness(spark: SparkSession, d: str) -> DataFrame:
    u = units(spark, d)
    e = metrics.edge_energy(stencils.with_size(u)).select("img", F.round("energy", 5).alias("energy"))
    b = metrics.blockiness(u)
    return rounded(e.join(b.withColumn("strength", rules.deblock_strength(F.col("both"))), "img"))


@query(f"WITH {S.F3} SELECT img, bool_and(p.r = q.r AND p.g = q.g AND p.b = q.b) AS equal FROM f1 p JOIN f3 q USING (img, y, x) GROUP BY img UNION ALL SELECT 100 + img, true FROM f3 GROUP BY img")
def a32_plane_equality(spark: SparkSession, d: str) -> DataFrame:
    p, q = f1(spark, d), rasters.blocky_images(spark, d)
    again = q.withColumn("img", F.col("img") + 100)
    return metrics.planes_equal(p, q).unionByName(metrics.planes_equal(again, again))
