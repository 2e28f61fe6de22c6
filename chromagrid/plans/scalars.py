"""Queries on scalar functions, sources and sinks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import masks, matching, resample
from ..sources import catalogs, rasters, sinks
from . import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = S.exact(sql)
        return f

    return add


def rgb(p: str = "") -> tuple:
    return tuple(F.col(p + c) for c in "rgb")


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.round(c, n).alias(c) if k == "double" else c for c, k in df.dtypes))


@query(f"WITH {S.F1} SELECT img, y, x, c::INT AS argb, 255 AS ua, r AS ur, g AS ug, b AS ub, (r >> 3 << 10) | (g >> 3 << 5) | (b >> 3) AS code15, printf('#%02X%02X%02X', r, g, b) AS hex, r AS hr, g AS hg, b AS hb FROM (SELECT *, -16777216 + r * 65536 + g * 256 + b AS c FROM f1)")
def p01_p24_p27_packing(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d).withColumn("argb", C.pack_argb(*rgb())).withColumn("hex", C.hex_of(*rgb()))
    a, r, g, b = C.unpack_argb(F.col("argb"))
    hr, hg, hb = C.rgb_of_hex(F.col("hex"))
    return p.select("img", "y", "x", "argb", a.alias("ua"), r.alias("ur"), g.alias("ug"), b.alias("ub"), C.code15(*rgb()).alias("code15"), "hex", hr.alias("hr"), hg.alias("hg"), hb.alias("hb"))


@query(f"WITH {S.F1}, l AS (SELECT img, y, x, {', '.join(S.lin(f'({c} / 255.0)') + f' AS {c}' for c in 'rgb')} FROM f1) SELECT img, y, x, {', '.join(f'round({c}, 6) AS lin_{c}, round({S.enc(c)}, 6) AS back_{c}, {S.byte(S.enc(c))} AS byte_{c}' for c in 'rgb')} FROM l")
def p02_p03_p14_p15_transfer(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d).select("img", "y", "x", *(C.linear(C.unit(F.col(c))).alias(c) for c in "rgb"))
    return p.select("img", "y", "x", *(x for c in "rgb" for x in (F.round(c, 6).alias(f"lin_{c}"), F.round(C.encoded(F.col(c)), 6).alias(f"back_{c}"), C.byte(C.encoded(F.col(c))).alias(f"byte_{c}"))))


@query(f"WITH {S.F1} SELECT img, y, x, round(ok_l, 6) AS l, round(ok_a, 6) AS a, round(ok_b, 6) AS b, f.r AS r8, f.g AS g8, f.b AS b8 FROM {S.ok('f1')} f")
def p04_p05_p06_p07_oklab(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d)
    p = p.select("img", "y", "x", *(v.alias(k) for k, v in zip("lab", C.oklab(*rgb()), strict=True)))
    back = C.rgb_of_oklab(tuple(F.col(k) for k in "lab"))
    return p.select("img", "y", "x", *(F.round(k, 6).alias(k) for k in "lab"), *(v.alias(f"{k}8") for k, v in zip("rgb", back, strict=True)))


@query(f"WITH {S.F1} SELECT img, y, x, round(lab_l, 6) AS l, round(lab_a, 6) AS a, round(lab_b, 6) AS b FROM {S.lab('f1')}")
def p08_cielab(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d)
    return p.select("img", "y", "x", *(F.round(v, 6).alias(k) for k, v in zip("lab", C.cielab(*rgb()), strict=True)))


def _ciede_sql() -> str:
    pi = "pi()"
    c7 = lambda c: f"(power({c}, 7) / (power({c}, 7) + power(25.0, 7)))"
    return f"""WITH {S.F5}, a AS (SELECT idx AS i, lab_l AS l1, lab_a AS a1, lab_b AS b1 FROM {S.lab('sw')}), b AS (SELECT idx AS j, lab_l AS l2, lab_a AS a2, lab_b AS b2 FROM {S.lab('sw')}),
p AS (SELECT *, 1.5 - 0.5 * sqrt({c7('((sqrt(a1*a1+b1*b1)+sqrt(a2*a2+b2*b2))/2)')}) AS gg FROM a JOIN b ON i < j),
q AS (SELECT i, j, l1, l2, sqrt(a1*gg*a1*gg+b1*b1) AS c1, sqrt(a2*gg*a2*gg+b2*b2) AS c2, atan2(b1, a1*gg) AS t1, atan2(b2, a2*gg) AS t2, sqrt((l1-l2)*(l1-l2)+(a1-a2)*(a1-a2)+(b1-b2)*(b1-b2)) AS de76 FROM p),
h AS (SELECT *, CASE WHEN t1 < 0 THEN t1 + 2*{pi} ELSE t1 END AS h1, CASE WHEN t2 < 0 THEN t2 + 2*{pi} ELSE t2 END AS h2 FROM q),
k AS (SELECT *, CASE WHEN c1*c2 = 0 THEN 0.0 WHEN abs(h2-h1) <= {pi} THEN h2-h1 WHEN h2-h1 > {pi} THEN h2-h1-2*{pi} ELSE h2-h1+2*{pi} END AS dh,
 CASE WHEN c1*c2 = 0 THEN h1+h2 WHEN abs(h2-h1) <= {pi} THEN (h1+h2)/2 WHEN h1+h2 < 2*{pi} THEN (h1+h2+2*{pi})/2 ELSE (h1+h2-2*{pi})/2 END AS hb, (l1+l2)/2-50 AS lm, (c1+c2)/2 AS cm FROM h),
t AS (SELECT *, 1 - 0.17*cos(hb-radians(30)) + 0.24*cos(2*hb) + 0.32*cos(3*hb+radians(6)) - 0.20*cos(4*hb-radians(63)) AS tt FROM k),
s AS (SELECT i, j, de76, (l2-l1)/(1+0.015*lm*lm/sqrt(20+lm*lm)) AS sl, (c2-c1)/(1+0.045*cm) AS sc, 2*sqrt(c1*c2)*sin(dh/2)/(1+0.015*cm*tt) AS sh,
 -sin(2*radians(30)*exp(-((degrees(hb)-275)/25)*((degrees(hb)-275)/25)))*2*sqrt({c7('cm')}) AS rt FROM t)
SELECT i, j, round(de76, 5) AS de76, round(sqrt(greatest(0.0, sl*sl+sc*sc+sh*sh+rt*sc*sh)), 5) AS de2000 FROM s"""


@query(_ciede_sql())
def p09_p10_distances(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.swatches(spark, d).select("idx", *(v.alias(k) for k, v in zip("lab", C.cielab(*rgb()), strict=True)))
    a, b = p.select(F.col("idx").alias("i"), *(F.col(k).alias(f"{k}1") for k in "lab")), p.select(F.col("idx").alias("j"), *(F.col(k).alias(f"{k}2") for k in "lab"))
    one, two = tuple(F.col(f"{k}1") for k in "lab"), tuple(F.col(f"{k}2") for k in "lab")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", F.round(C.distance(one, two), 5).alias("de76"), F.round(C.ciede2000(one, two), 5).alias("de2000"))


_HSV = """(SELECT *, CASE WHEN t - n <= 1e-6 THEN 0.0 WHEN t = r THEN ((g-b)/(t-n) + CASE WHEN g < b THEN 6 ELSE 0 END)/6 WHEN t = g THEN ((b-r)/(t-n)+2)/6 ELSE ((r-g)/(t-n)+4)/6 END AS h,
 CASE WHEN t <= 1e-6 THEN 0.0 ELSE (t-n)/t END AS s, t AS v FROM (SELECT *, greatest(r,g,b) AS t, least(r,g,b) AS n FROM u))"""


@query(f"WITH {S.F1}, {S.UNIT} SELECT img, y, x, round(h, 6) AS h, round(s, 6) AS s, round(v, 6) AS v, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM {_HSV}")
def p11_hsv(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d).select("img", "y", "x", *(C.unit(F.col(c)).alias(c) for c in "rgb"))
    p = p.select("img", "y", "x", *(v.alias(k) for k, v in zip("hsv", C.hsv(*rgb()), strict=True)))
    return rounded(p.select("*", *(v.alias(k) for k, v in zip("rgb", C.rgb_of_hsv(F.col("h"), F.col("s"), F.col("v")), strict=True))))


@query(f"WITH {S.F1} SELECT img, y, x, round({S.luma()}, 6) AS l709, floor({S.luma()})::INT AS li, round(0.299*r+0.587*g+0.114*b, 6) AS l601, {S.fit('(-0.168736*r-0.331264*g+0.5*b+128)')} AS cb, {S.fit('(0.5*r-0.418688*g-0.081312*b+128)')} AS cr, CASE WHEN 0.299*r+0.587*g+0.114*b > 140 THEN 'black' ELSE 'white' END AS ink FROM f1")
def p12_p13_p34_luma_ycbcr(spark: SparkSession, d: str) -> DataFrame:
    _, cb, cr = C.ycbcr(*rgb())
    return rasters.embedding_images(spark, d).select("img", "y", "x", F.round(C.luma709(*rgb()), 6).alias("l709"), C.luma709_int(*rgb()).alias("li"), F.round(C.luma601(*rgb()), 6).alias("l601"), cb.alias("cb"), cr.alias("cr"), C.symbol_ink(*rgb()).alias("ink"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, i, i / 100.0 AS v, ['SRGB','BT2020_PQ','BT2020_HLG','DISPLAY_P3'][l_suppkey % 4 + 1] AS space FROM (SELECT *, l_partkey % 301 AS i FROM lineitem)),
w AS (SELECT *, power(greatest(v, 0.0), 1 / (2523.0/32)) AS p, 0.17883277 AS a FROM v),
k AS (SELECT *, CASE WHEN v <= 1 THEN v ELSE 1 + (v-1)/(1+(v-1)/3) END AS knee FROM w)
SELECT l_orderkey, l_linenumber, i, round(power(greatest(p - 3424.0/4096, 0.0)/(2413.0/128 - 2392.0/128*p), 1/(2610.0/16384)) * (10000.0/203), 4) AS pq,
 round(CASE WHEN v <= 0.5 THEN v*v/3 ELSE (exp((v - (0.5 - a*ln(4*a)))/a) + (1-4*a))/12 END, 6) AS hlg, round(knee, 6) AS knee, round(CASE WHEN space LIKE 'BT2020%' THEN greatest(0.0, least(1.0, knee)) ELSE v END, 6) AS toned, space LIKE 'BT2020%' AS applied,
 NOT (space = 'SRGB') AS icc FROM k WHERE i <= 100 OR i > 100""".replace("round(power(greatest(p -", "round(CASE WHEN i > 100 THEN 0 ELSE power(greatest(p -").replace("* (10000.0/203), 4)", "* (10000.0/203) END, 4)"))
def p16_p17_p18_p19_s03_hdr(spark: SparkSession, d: str) -> DataFrame:
    v = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("i", F.col("l_partkey") % 301)
    v = v.select("l_orderkey", "l_linenumber", "i", (F.col("i") / 100.0).alias("v"), F.element_at(F.array(*map(F.lit, ("SRGB", "BT2020_PQ", "BT2020_HLG", "DISPLAY_P3"))), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("space"))
    toned, applied = C.tonemapped(F.col("v"), F.col("space"))
    return v.select("l_orderkey", "l_linenumber", "i", F.round(F.when(F.col("i") > 100, 0.0).otherwise(C.pq_to_linear(F.col("v"))), 4).alias("pq"), F.round(C.hlg_to_linear(F.col("v")), 6).alias("hlg"), F.round(C.soft_knee(F.col("v")), 6).alias("knee"), F.round(toned, 6).alias("toned"), applied.alias("applied"), C.icc_confident(F.col("space")).alias("icc"))


@query(f"""WITH {S.F1}, bc AS (SELECT img, y, x, {', '.join(S.fit(f'(({c} - 128.0) * (259.0 * 275.0 / (255.0 * 239.0)) + 128.0 + 25.5)') + f' AS {c}1, {S.fit(f"(power({c} / 255.0, 1 / 1.8) * 255.0)")} AS {c}2, {S.fit(f"({c} + (128.0 - {c}) * 0.3)")} AS {c}3, floor(({c} + 255) / 2)::INT AS {c}4, ({c} + g) // 2 AS {c}5' for c in 'rgb')} FROM f1) SELECT * FROM bc""")
def p20_p21_p22_p25_p35_tones(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embedding_images(spark, d).select("img", "y", "x", *(v.alias(f"{c}{i}") for c in "rgb" for i, v in enumerate((C.brightness_contrast(F.col(c), 10, 20), C.gamma_corrected(F.col(c), 1.8), C.compressed(F.col(c), 0.3), C.pale(F.col(c)), C.mean_byte(F.col(c), F.col("g"))), 1)))


@query(f"WITH {S.F1}, m AS (SELECT img, {', '.join(f'min({c}) AS n{c}, max({c}) AS m{c}' for c in 'rgb')} FROM f1 GROUP BY img) SELECT img, y, x, {', '.join(S.fit(f'(({c} - n{c}) * CASE WHEN m{c} > n{c} THEN 255.0 / (m{c} - n{c}) ELSE 1.0 END)') + f' AS {c}' for c in 'rgb')} FROM f1 JOIN m USING (img)")
def p23_auto_levels(spark: SparkSession, d: str) -> DataFrame:
    return matching.auto_levels(rasters.embedding_images(spark, d))


@query(f"""WITH {S.F5}, o AS (SELECT idx, ok_l AS l, ok_a AS a, ok_b AS k, r, g, b FROM {S.ok('sw')})
SELECT p.idx AS i, q.idx AS j, round((p.l+q.l)/2, 6) AS l, round((p.a+q.a)/2, 6) AS a, round((p.k+q.k)/2, 6) AS k, greatest(0.0, least(255.0, p.r + floor((q.r - p.r) * 100 / 255.0 * 0.8 + 0.5)))::INT AS blended,
 round(greatest(0.0, least(1.0, CASE WHEN q.idx % 3 = 0 THEN q.g/255.0 WHEN q.idx % 2 = 0 THEN 0.5*p.r/255.0 + 0.5*p.g/255.0 ELSE 0.5*p.r/255.0 + 0.25*q.g/255.0 + 0.25*p.g/255.0 END)), 6) AS mix, round(p.r + (q.r - p.r) * 0.25, 6) AS lerped,
 floor((p.r / 7.0) * 100 + 0.5) / 100 AS two, (CASE WHEN p.idx % 2 = 0 THEN 1.3 ELSE 1.0 END) * (CASE WHEN p.idx % 3 = 0 THEN 1.6 ELSE 1.0 END) * (CASE WHEN q.idx % 2 = 0 THEN 1.2 ELSE 1.0 END) * (CASE WHEN q.idx % 3 = 0 THEN 1.2 ELSE 1.0 END) * (CASE WHEN q.idx % 5 = 0 THEN 0.9 ELSE 1.0 END) AS weight
FROM o p JOIN o q ON p.idx < q.idx""".replace(" AS weight", "AS weight_").replace("(CASE WHEN p.idx % 2 = 0 THEN 1.3", "round((CASE WHEN p.idx % 2 = 0 THEN 1.3").replace("ELSE 1.0 END)AS weight_", "ELSE 1.0 END), 9) AS weight"))
def p26_p28_p33_p36_p37_p38_blends(spark: SparkSession, d: str) -> DataFrame:
    s = rasters.swatches(spark, d).select("idx", *"rgb", *(v.alias(f"o{k}") for k, v in zip("lak", C.oklab(*rgb(), clamped=True), strict=True)))
    p, q = s.select(*(F.col(c).alias(f"p_{c}") for c in s.columns)), s.select(*(F.col(c).alias(f"q_{c}") for c in s.columns))
    c, third, half = F.col, F.col("q_idx") % 3 == 0, F.col("q_idx") % 2 == 0
    both = p.join(q, c("p_idx") < c("q_idx"))
    return both.select(c("p_idx").alias("i"), c("q_idx").alias("j"), *(F.round((c(f"p_o{k}") + c(f"q_o{k}")) / 2, 6).alias(k) for k in "lak"), C.blended(c("p_r"), c("q_r"), F.lit(100), 0.8).alias("blended"), F.round(C.mix3(c("p_r") / 255.0, c("p_g") / 255.0, c("q_g") / 255.0, half, third), 6).alias("mix"), F.round(C.lerp(c("p_r"), c("q_r"), F.lit(0.25)), 6).alias("lerped"), C.round2(c("p_r") / 7.0).alias("two"), F.round(C.importance(c("p_idx") % 2 == 0, c("p_idx") % 3 == 0, half, third, c("q_idx") % 5 == 0), 9).alias("weight"))


@query("""WITH s AS (SELECT p_partkey AS k, p_size AS w, p_size + 7 AS h, 0.5 + (p_partkey % 7) / 4.0 AS aspect, ['BY_WIDTH','BY_HEIGHT','BY_DPI'][p_partkey % 3 + 1] AS mode, p_partkey % 2 = 0 AS keep FROM part)
SELECT k, CASE WHEN keep AND mode = 'BY_HEIGHT' THEN greatest(1, floor(h * aspect + 0.5)::INT) ELSE w END AS gw, CASE WHEN keep AND mode <> 'BY_HEIGHT' THEN greatest(1, floor(w / aspect + 0.5)::INT) ELSE h END AS gh,
 round(w / greatest(1.0, (k % 20)::DOUBLE) * 2.54, 6) AS cm, round(w * 2.8 * (25.4 / 14) * 2.0 * 1.1 / 1000, 6) AS metres, CASE WHEN k % 5 = 0 THEN 1.25 ELSE 1000.0 / w END AS ratio, round(0.5 * greatest(0.0, CASE WHEN k % 5 = 0 THEN 0.25 ELSE 1000.0 / w - 1 END), 6) AS sigma,
 greatest(1, floor(w * 6 * least(1.0, least(120.0 / (w * 6), 120.0 / (h * 6)))))::INT AS pw, greatest(1, floor(h * 6 * least(1.0, least(120.0 / (w * 6), 120.0 / (h * 6)))))::INT AS ph FROM s""".replace("ELSE 1000.0 / w END AS ratio", "ELSE round(1000.0 / w, 6) END AS ratio"))
def p29_p30_p31_p32_k13_sizes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = spark.read.parquet(f"{d}/part.parquet").select(c("p_partkey").alias("k"), c("p_size").alias("w"), (c("p_size") + 7).alias("h"), (0.5 + (c("p_partkey") % 7) / 4.0).alias("aspect"), F.element_at(F.array(*map(F.lit, ("BY_WIDTH", "BY_HEIGHT", "BY_DPI"))), (c("p_partkey") % 3 + 1).cast("int")).alias("mode"), (c("p_partkey") % 2 == 0).alias("keep"))
    gw, gh = C.grid_size(c("w"), c("h"), c("aspect"), c("mode"), c("keep"))
    ratio, sigma = C.downscale(F.lit(1000.0), F.when(c("k") % 5 != 0, c("w")), 0.5)
    pw, ph = sinks.preview_size(c("w"), c("h"), 6, 120)
    return s.select("k", gw.alias("gw"), gh.alias("gh"), F.round(C.physical_cm(c("w"), c("k") % 20), 6).alias("cm"), F.round(C.thread_metres(c("w"), F.lit(14.0), F.lit(2.0), F.lit(10.0)), 6).alias("metres"), F.round(ratio, 6).alias("ratio"), F.round(sigma, 6).alias("sigma"), pw.alias("pw"), ph.alias("ph"))


@query(f"""WITH {S.F1}, dim AS (SELECT img, max(x) AS mx, max(y) AS my FROM f1 GROUP BY img), o AS (SELECT unnest(range(1, 10))::INT AS o) SELECT img, o, y AS sy, x AS sx, CASE o WHEN 2 THEN mx - x WHEN 3 THEN mx - x WHEN 5 THEN y WHEN 6 THEN my - y WHEN 7 THEN my - y WHEN 8 THEN y ELSE x END AS nx,
 CASE o WHEN 3 THEN my - y WHEN 4 THEN my - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN mx - x WHEN 8 THEN mx - x ELSE y END AS ny FROM f1 JOIN dim USING (img), o""")
def s02_exif_orientation(spark: SparkSession, d: str) -> DataFrame:
    p = resample.with_size(rasters.embedding_images(spark, d)).withColumns({"sy": F.col("y"), "sx": F.col("x")})
    parts = [resample.oriented(p, o).select("img", F.lit(o).alias("o"), "sy", "sx", F.col("x").alias("nx"), F.col("y").alias("ny")) for o in range(1, 10)]
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def _catalog_docs(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    k = F.col("n_nationkey")
    one = lambda i, m, name: F.format_string('{"code":"%d","name":"%s","rgb":"%s%02X%02X%02X"}', (k + i) % 7, F.lit(name), F.when((k + i) % 2 == 0, "#").otherwise(""), k * m % 256, k * (m + 2) % 256, k * (m + 4) % 256)
    ident = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("id"), (k % 9).cast("string")))
    good = F.concat(F.lit('{"id":"'), ident, F.lit('","name":"'), "n_name", F.lit('","type":"cotton","colors":['), one(0, 11, "a"), F.lit(","), one(3, 17, "b"), F.lit(","), one(7, 29, "c"), F.lit("]}"))
    return n.select(F.concat(F.lit("palettes/"), F.lower("n_name"), F.lit(".json")).alias("path"), F.when(k % 11 == 10, "{broken").otherwise(good).alias("json"))


_CAT = """n AS (SELECT n_nationkey AS k, n_name, 'palettes/' || lower(n_name) || '.json' AS path, CASE WHEN n_nationkey % 5 = 0 THEN upper(lower(n_name)) ELSE 'ID' || (n_nationkey % 9)::VARCHAR END AS brand FROM nation WHERE n_nationkey % 11 <> 10),
e AS (SELECT brand, path, ((k + i) % 7)::VARCHAR AS code, name, (k * m % 256)::INT AS r, (k * (m + 2) % 256)::INT AS g, (k * (m + 4) % 256)::INT AS b, pos FROM n, (VALUES (0, 0, 11, 'a'), (1, 3, 17, 'b'), (2, 7, 29, 'c')) t(pos, i, m, name))"""


@query(f"WITH {_CAT} SELECT path, brand, code, name, r, g, b FROM e QUALIFY row_number() OVER (PARTITION BY path, brand, code ORDER BY pos DESC) = 1")
def s07_s08_s09_brand_colors(spark: SparkSession, d: str) -> DataFrame:
    c = catalogs.catalogs(_catalog_docs(spark, d))
    # brands of several files keep their files apart here
    return catalogs.colors(c.withColumn("brand", F.concat("path", F.lit("|"), "brand"))).select(F.split("brand", r"\|")[0].alias("path"), F.split("brand", r"\|")[1].alias("brand"), "code", "name", "r", "g", "b")


@query(f"WITH {_CAT} SELECT DISTINCT brand FROM n")
def s10_brands(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.brands(catalogs.catalogs(_catalog_docs(spark, d)))


@query("SELECT 'palettes/' || lower(n_name) || '.json' AS path FROM nation WHERE n_nationkey = 7")
def s11_brand_path(spark: SparkSession, d: str) -> DataFrame:
    name = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey = 7").first().n_name
    return catalogs.resolved_path(_catalog_docs(spark, d), name)


def _match_docs(spark: SparkSession, d: str) -> DataFrame:
    n, k = spark.read.parquet(f"{d}/nation.parquet"), F.col("n_nationkey")
    single = F.format_string('{"idx":%d,"type":"single","code":"%s","rgb":"#010203","symbol":"%s"}', k, F.col("n_name"), F.substring("n_name", 1, 2))
    blend = F.format_string('{"idx":%d,"type":"blend","codeA":"%s","codeB":"B%d","symbol":""}', k + 100, F.col("n_name"), k)
    good = F.concat(F.lit('{"brand":"DMC","entries":['), single, F.lit(","), blend, F.lit('],"overrides":{"'), k.cast("string"), F.lit('":"@"}}'))
    return n.select(F.col("n_name").alias("path"), F.when(k % 11 == 10, "oops").otherwise(good).alias("json"))


@query("SELECT n_name AS path, 'DMC' AS brand, n_nationkey + o AS idx, CASE o WHEN 0 THEN 'single' ELSE 'blend' END AS type, n_name AS code_a, CASE o WHEN 0 THEN NULL ELSE 'B' || n_nationkey::VARCHAR END AS code_b FROM nation, (VALUES (0), (100)) t(o) WHERE n_nationkey % 11 <> 10")
def s12_catalog_matches(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.matches(_match_docs(spark, d))


@query("SELECT n_name AS path, n_nationkey + o AS idx, CASE o WHEN 0 THEN '#010203' END AS rgb, CASE o WHEN 0 THEN substr(n_name, 1, 2) ELSE '' END AS symbol, CASE o WHEN 0 THEN '@' ELSE '?' END AS shown, CASE o WHEN 0 THEN 'single' ELSE 'blend' END AS type, n_name AS code, CASE o WHEN 0 THEN NULL ELSE 'B' || n_nationkey::VARCHAR END AS code_b FROM nation, (VALUES (0), (100)) t(o) WHERE n_nationkey % 11 <> 10")
def s13_s14_s15_j16_legends(spark: SparkSession, d: str) -> DataFrame:
    return catalogs.legends(_match_docs(spark, d)).drop("brand")


@query("SELECT n_name AS id, 'a/quant_color_' || n_name || '.png' AS color, CASE WHEN n_nationkey % 2 = 0 THEN 'a/index_' || n_name || '.bin' END AS index FROM nation")
def s06_index_pairing(spark: SparkSession, d: str) -> DataFrame:
    n = spark.read.parquet(f"{d}/nation.parquet")
    one = n.select(F.concat(F.lit("a/quant_color_"), "n_name", F.lit(".png")).alias("path"))
    return catalogs.paired_index(one.unionByName(n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("a/index_"), "n_name", F.lit(".bin")).alias("path"))))


@query("SELECT event_id, ['DEBUG','INFO','WARN','ERROR'][event_id % 4 + 1] AS level FROM events WHERE event_id % 4 >= 2")
def f10_level_filter(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.element_at(F.array(*map(F.lit, masks.LEVELS)), (F.col("event_id") % 4 + 1).cast("int")).alias("level"))
    return e.where(masks.level_passes("level", "WARN"))


@query("""SELECT '{"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract('ms' FROM ts)::INT % 1000)::VARCHAR, 3, '0') || 'Z","level":"INFO","category":"' || event_type || '","message":"m' || event_id::VARCHAR || '"' || CASE WHEN user_id % 2 = 0 THEN ',"session":"s' || user_id::VARCHAR || '"' ELSE '' END || ',"data":{"k":"' || event_type || '"}}' AS line FROM events""")
def k18_k19_k21_log_lines(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return sinks.log_json(e.select("ts", F.lit("INFO").alias("level"), F.col("event_type").alias("category"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("s"), F.col("user_id").cast("string"))).alias("session"), F.create_map(F.lit("k"), F.col("event_type")).alias("data")))


@query("""SELECT strftime(ts, '%Y%m%d-%H%M%S') AS id, '{"id":"' || strftime(ts, '%Y%m%d-%H%M%S') || '","started_at_utc":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","device":"m' || user_id || '/' || event_type || '","sdk":' || (event_id % 40)::INT || '}' AS json FROM events""")
def k21_session_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return sinks.session_json(e.select(F.col("ts").alias("started"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("maker"), F.col("event_type").alias("model"), (F.col("event_id") % 40).cast("int").alias("sdk")))


@query('SELECT * FROM (SELECT user_id, what, "at", row_number() OVER (PARTITION BY user_id ORDER BY "at" DESC, what) AS rank FROM (SELECT user_id, event_type AS what, max(event_id) AS "at" FROM events GROUP BY user_id, event_type)) WHERE rank <= 2')
def k20_t04_recent(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumnRenamed("event_type", "what")
    return catalogs.newest(e, "what", F.col("event_id"), 2, ["user_id"]).select("user_id", "what", "at", "rank")


@query("SELECT p_partkey, i::INT AS at, (regexp_extract_all('●○■□▲△▼▽◆◇★☆✚✖✦✧◐◑◒◓◔◕◼◻◈◉◍◎⬟⬢⬣⬤ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', '.'))[i % 94 + 1] || repeat('''', (i // 94)::INT) AS symbol FROM (SELECT p_partkey, p_partkey % 250 AS i FROM part)")
def q19_t05_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").withColumn("i", F.col("p_partkey") % 250)
    return p.select("p_partkey", F.col("i").cast("int").alias("at"), sinks.symbols(F.col("i")).alias("symbol"))


@query("WITH h AS (SELECT max(c_custkey) // 2 AS half FROM customer), n AS (SELECT c_custkey + half AS c_custkey, 'new' AS c_name, 0.0 AS c_acctbal FROM customer, h) SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n")
def t06_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every customer is an old row; the new rows are all customers again, with keys moved up by half of the range."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    half = F.broadcast(c.agg(F.floor(F.max("c_custkey") / 2).alias("half")))
    new = c.crossJoin(half).select((F.col("c_custkey") + F.col("half")).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return sinks.upserted(c, new, "c_custkey")
