"""Queries on legends, previews, exported pages, strict catalogs and projects, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import matching, stencils
from ..sources import catalogs, files, projects, rasters, sinks
from ..sources.stored import shared_folder
from ..streaming import logs
from . import sql as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: fixed values: linear Display P3 to linear sRGB.
P3 = ((1.2249401763, -0.2249401763, 0.0), (-0.0420569547, 1.0420569547, 0.0), (-0.0196375546, -0.0786360456, 1.0982736002))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = S.exact(sql)
        return f

    return add


def images(spark: SparkSession, d: str) -> DataFrame:
    return stencils.with_size(rasters.embedding_images(spark, d))


def rgb() -> tuple:
    return tuple(F.col(c) for c in "rgb")


_SIZES = "s AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM f1 GROUP BY img)"


@query(f"""WITH {S.F5}, e AS (SELECT idx, CASE WHEN idx < 20 THEN code END AS code, CASE WHEN idx > 4 THEN 'n' || idx END AS name, printf('#%02X%02X%02X', r, g, b) AS rgb, chr(65 + idx) AS symbol, CASE WHEN r > 128 THEN '@' ELSE chr(65 + idx) END AS shown FROM sw)
SELECT '{{"entries":[' || string_agg('{{"idx":' || idx || coalesce(',"code":"' || code || '"', '') || coalesce(',"name":"' || name || '"', '') || ',"rgb":"' || rgb || '","symbol":"' || symbol || '"}}', ',' ORDER BY idx)
 || '],"overrides":{{' || coalesce(string_agg('"' || idx || '":"' || shown || '"', ',' ORDER BY idx::VARCHAR) FILTER (symbol <> shown), '') || '}}}}' AS json FROM e""")
def k08_typed_legend(spark: SparkSession, d: str) -> DataFrame:
    s = rasters.swatches(spark, d)
    symbol = F.char(F.col("idx") + 65)
    return sinks.legend_document(s.select("idx", F.when(F.col("idx") < 20, F.col("code")).alias("code"), F.when(F.col("idx") > 4, F.concat(F.lit("n"), F.col("idx").cast("string"))).alias("name"), C.hex_of(*rgb()).alias("rgb"), symbol.alias("symbol"), F.when(F.col("r") > 128, "@").otherwise(symbol).alias("shown")))


_PREVIEW = f"{S.F1}, {_SIZES}, z AS (SELECT *, least(1.0, least(300.0 / (w * 6), 300.0 / (h * 6))) AS scale FROM s), p AS (SELECT *, greatest(1, floor(w * 6 * scale))::INT AS pw, greatest(1, floor(h * 6 * scale))::INT AS ph FROM z)"


@query(f"""WITH {_PREVIEW}, a AS (SELECT img, ((2 * i + 1) * w // (2 * pw))::INT AS x, min(i)::INT AS "left", (max(i) + 1)::INT AS "right" FROM p, range(300) t(i) WHERE i < pw GROUP BY ALL), b AS (SELECT img, ((2 * i + 1) * h // (2 * ph))::INT AS y, min(i)::INT AS top, (max(i) + 1)::INT AS bottom FROM p, range(300) t(i) WHERE i < ph GROUP BY ALL)
SELECT f1.img, f1.y, f1.x, "left", top, "right", bottom, r, g, b.b FROM f1 JOIN a ON a.img = f1.img AND a.x = f1.x JOIN b ON b.img = f1.img AND b.y = f1.y""".replace("r, g, b.b FROM", "r, g, f1.b FROM"))
def k13_preview_cells(spark: SparkSession, d: str) -> DataFrame:
    return sinks.preview_cells(images(spark, d), 6, 300)


@query(f"""WITH {_PREVIEW}, a AS (SELECT img, 'x' AS axis, pw AS size, scale FROM p UNION ALL SELECT img, 'y', ph, scale FROM p)
SELECT img, axis, i::INT AS line, round(i * 6 * scale, 6) AS "at", i % 10 = 0 AS bold, round(CASE WHEN i % 10 = 0 THEN greatest(1.0, 1.5 * scale) ELSE 1.0 END, 6) AS stroke FROM a, range(2000) t(i) WHERE i <= floor(size / (6 * scale))""")
def k13_preview_lines(spark: SparkSession, d: str) -> DataFrame:
    dims = rasters.sizes(rasters.embedding_images(spark, d))
    return sinks.preview_lines(dims, 6, 300).select("img", "axis", "line", F.round("at", 6).alias("at"), "bold", F.round("stroke", 6).alias("stroke"))


@query(f"""WITH {S.F1}, {_SIZES}, n AS (SELECT *, greatest(1, ceil((w - 2) / 18.0))::INT AS nx, greatest(1, ceil((h - 2) / 13.0))::INT AS ny FROM s)
SELECT img, (j * nx + i + 1)::INT AS page, (i * 18)::INT AS sx, (j * 13)::INT AS sy, least(w, i * 18 + 20)::INT AS ex, least(h, j * 13 + 15)::INT AS ey FROM n, range(9) t(i), range(200) u(j) WHERE i < nx AND j < ny UNION ALL SELECT img, nx * ny + 1, NULL, NULL, NULL, NULL FROM n""")
def k14_k15_legend_page(spark: SparkSession, d: str) -> DataFrame:
    return sinks.page_plan(rasters.sizes(rasters.embedding_images(spark, d)), 20, 15, 2, legend=True)


@query("SELECT p_partkey, greatest(1, floor((round((200 + p_size) * (72 / 25.4)) - 2 * 10 * (72 / 25.4)) / greatest(1.0, 3.0 * (72 / 25.4))))::INT AS cells FROM part")
def k14_cells_on_page(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", sinks.cells_on_page(F.col("p_size") + 200, 10.0, 3.0).alias("cells"))


@query(f"""WITH {S.F1}, {S.F5}, k AS (SELECT DISTINCT r, g, b FROM f1), m AS (SELECT k.r, k.g, k.b, arg_min(sw.idx, ((k.r - sw.r) * (k.r - sw.r) + (k.g - sw.g) * (k.g - sw.g) + (k.b - sw.b) * (k.b - sw.b), sw.idx)) AS idx FROM k, sw GROUP BY ALL)
SELECT img, y, x, chr(65 + idx) AS symbol, (x + 0.5) * 16 AS "left", round((y + 0.7) * 16, 6) AS base, CASE WHEN {S.luma()} > 140 THEN 'black' ELSE 'white' END AS ink, CASE WHEN {S.luma()} > 140 THEN 'white' ELSE 'black' END AS outline FROM f1 JOIN m USING (r, g, b) WHERE idx <> 3""")
def k17_export_cells(spark: SparkSession, d: str) -> DataFrame:
    pal = rasters.swatches(spark, d).withColumn("symbol", F.when(F.col("idx") != 3, F.char(F.col("idx") + 65)))
    return sinks.export_cells(rasters.embedding_images(spark, d), pal).withColumn("base", F.round("base", 6))


@query("""WITH RECURSIVE i AS (SELECT n_nationkey::INT AS pos, 19.2 + 4 * 12 + 10.0 + 6 * length(n_name) + 4 * length(n_name) + 20.0 AS size FROM nation),
f AS (SELECT pos, 12.0::DOUBLE AS "left", 12.0::DOUBLE AS top, size::DOUBLE AS size FROM i WHERE pos = 0 UNION ALL
 SELECT i.pos, CASE WHEN f."left" + f.size + 12 + i.size > 640 - 12 THEN 12.0 ELSE f."left" + f.size + 12 END, CASE WHEN f."left" + f.size + 12 + i.size > 640 - 12 THEN f.top + 27 ELSE f.top END, i.size FROM f JOIN i ON i.pos = f.pos + 1)
SELECT pos, round("left", 6) AS "left", top FROM f""")
def k17_legend_flow(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("n_name")
    items = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("pos"), F.array(F.lit(10.0), n * 6.0, n * 4.0, F.lit(20.0)).alias("parts"))
    return sinks.legend_flow(items, 640.0).withColumn("left", F.round("left", 6))


@query(f"""WITH {S.F1}, l AS (SELECT img, y, x, {', '.join(S.lin(f'({c} / 255.0)') + f' AS {c}' for c in 'rgb')} FROM f1)
SELECT img, y, x, round(1.2249401763 * r - 0.2249401763 * g, 6) AS r, round(1.0420569547 * g - 0.0420569547 * r, 6) AS g, round(1.0982736002 * b - 0.0786360456 * g - 0.0196375546 * r, 6) AS b FROM l""")
def p14_wide_gamut(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d)
    return p.select("img", "y", "x", *(F.round(v, 6).alias(c) for c, v in zip("rgb", C.linear_plane(tuple(C.unit(c) for c in rgb()), P3), strict=True)))


@query(f"""WITH {S.F1}, v AS (SELECT img, y, x, (x % 5) / 4.0 AS a, ['SRGB','BT2020_PQ','BT2020_HLG'][y % 3 + 1] AS space, {', '.join(f'{c} / 64.0 AS {c}' for c in 'rgb')} FROM f1),
u AS (SELECT *, {', '.join(f'CASE WHEN a > 1e-6 THEN {c} / a ELSE {c} END AS f{c}' for c in 'rgb')} FROM v)
SELECT img, y, x, space <> 'SRGB' AS applied, {', '.join(f"round(CASE WHEN space = 'SRGB' THEN {c} ELSE least(1.0, greatest(0.0, a * CASE WHEN f{c} <= 1 THEN f{c} ELSE 1 + (f{c} - 1) / (1 + (f{c} - 1) / 3) END)) END, 6) AS {c}" for c in 'rgb')} FROM u""")
def p19_premultiplied_tonemap(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d).withColumns({"a": (F.col("x") % 5) / 4.0, "space": F.element_at(F.array(F.lit("SRGB"), F.lit("BT2020_PQ"), F.lit("BT2020_HLG")), (F.col("y") % 3 + 1).cast("int"))})
    toned, applied = C.tonemapped_plane(tuple(c / 64.0 for c in rgb()), F.col("a"), F.col("space"))
    return p.select("img", "y", "x", applied.alias("applied"), *(F.round(v, 6).alias(c) for c, v in zip("rgb", toned, strict=True)))


@query(f"WITH {S.F1} SELECT img, y, x, (6 - (x + y) % 7)::INT AS idx FROM f1")
def j14_remapped(spark: SparkSession, d: str) -> DataFrame:
    px = rasters.embedding_images(spark, d).withColumn("idx", ((F.col("x") + F.col("y")) % 7).cast("int"))
    lut = spark.range(7).select(F.col("id").cast("int").alias("idx"), (6 - F.col("id")).cast("int").alias("to"))
    return matching.remapped(px, lut, 7, 7)


@query(f"""WITH {S.F3}, c AS (SELECT img, r, g, b, count(*) AS n FROM f3 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY n DESC, r, g, b) AS rank, sum(n) OVER (PARTITION BY img) AS total FROM c)
SELECT img, rank, printf('#%02X%02X%02X', r, g, b) AS code, printf('#%02X%02X%02X', r, g, b) AS name, r, g, b, n AS count, (n * 100 // total)::BIGINT AS percent FROM k WHERE rank <= 12""")
def a14_hex_statistics(spark: SparkSession, d: str) -> DataFrame:
    return matching.hex_statistics(rasters.blocky_images(spark, d), 12)


@query("""WITH p AS (SELECT upper(replace(p_brand, '#', '-')) AS brand, p_partkey AS k FROM part), c AS (SELECT brand, (k % 12)::VARCHAR AS code, k, (k * 7 % 256)::INT AS r, (k * 13 % 256)::INT AS g, (k * 29 % 256)::INT AS b FROM p)
SELECT brand, code, 'n' || k AS name, r, g, b FROM c QUALIFY row_number() OVER (PARTITION BY brand, code ORDER BY k DESC) = 1""")
def s07_strict_colors(spark: SparkSession, d: str) -> DataFrame:
    """A catalog per brand, its colors from its parts; of equal codes the last wins."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.regexp_replace("p_brand", "#", "-").alias("brand"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    color = F.format_string('{"code":"%d","name":"n%d","rgb":"%s%02X%02X%02X"}', k % 12, k, F.when(k % 2 == 0, "#").otherwise(""), k * 7 % 256, k * 13 % 256, k * 29 % 256)
    each = p.groupBy("brand").agg(F.array_sort(F.collect_list(F.struct(k, color.alias("c")))).alias("cs"))
    docs = each.select(F.concat(F.lit("p/"), "brand", F.lit(".json")).alias("path"), F.concat(F.lit('{"colors":['), F.array_join(F.col("cs.c"), ","), F.lit("]}")).alias("json"))
    return catalogs.strict_colors(catalogs.catalogs(docs))


@query("WITH a AS (SELECT DISTINCT substr(p_brand, -1) AS symbol FROM part), b AS (SELECT DISTINCT substr(n_name, 1, 1) AS symbol FROM nation), c AS (SELECT DISTINCT substr(r_name, 1, 1) AS symbol FROM region) SELECT symbol FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE symbol NOT IN (SELECT symbol FROM c)")
def t05_symbol_pool(spark: SparkSession, d: str) -> DataFrame:
    first = lambda name, c: spark.read.parquet(f"{d}/{name}.parquet").select(F.substring(c, 1, 1).alias("symbol"))
    digits = spark.read.parquet(f"{d}/part.parquet").select(F.substring("p_brand", -1, 1).alias("symbol"))
    return sinks.symbol_pool(digits, first("nation", "n_name"), first("region", "r_name"))


@query("""WITH m AS (SELECT max(c_custkey) AS top FROM customer), a AS (SELECT c_custkey, c_acctbal, 0 AS stamp FROM customer UNION ALL SELECT c_custkey + top, c_acctbal, 0 FROM customer, m WHERE c_acctbal > 5000)
SELECT c_custkey, c_acctbal, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 8000) THEN 7 ELSE stamp END AS stamp FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def t06_projects(spark: SparkSession, d: str) -> DataFrame:
    """Copies of the rich, none of those in debt, a new stamp for the richest."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    top = c.agg(F.max("c_custkey")).first()[0] or 0
    every = sinks.copied(c.withColumn("stamp", F.lit(0)), "c_custkey", F.col("c_acctbal") > 5000, F.col("c_custkey") + top)
    every = sinks.deleted(every, c.where("c_acctbal < 0"), "c_custkey")
    return sinks.touched(every, c.where("c_acctbal > 8000"), "c_custkey", "stamp", F.lit(7))


@query(f"""WITH {S.F1}, dim AS (SELECT img, w, h, CASE WHEN w * h > 2000 THEN greatest(1, floor(w * sqrt(2000.0 / (w * h))))::BIGINT ELSE w END AS tw, CASE WHEN w * h > 2000 THEN greatest(1, floor(h * sqrt(2000.0 / (w * h))))::BIGINT ELSE h END AS th FROM (SELECT img, (max(x) + 1)::BIGINT AS w, (max(y) + 1)::BIGINT AS h FROM f1 GROUP BY img)),
tx AS (SELECT img, x, t AS tx, least((t + 1) * w, (x + 1) * tw) - greatest(t * w, x * tw) AS cx FROM (SELECT DISTINCT img, x FROM f1) JOIN dim USING (img), range(64) r(t) WHERE t >= x * tw // w AND t <= ((x + 1) * tw - 1) // w),
ty AS (SELECT img, y, t AS ty, least((t + 1) * h, (y + 1) * th) - greatest(t * h, y * th) AS cy FROM (SELECT DISTINCT img, y FROM f1) JOIN dim USING (img), range(5000) r(t) WHERE t >= y * th // h AND t <= ((y + 1) * th - 1) // h)
SELECT 'scan-' || f1.img || '.png' AS file, any_value(tw)::INT AS w, any_value(th)::INT AS h, ty::INT AS y, tx::INT AS x, {', '.join(f'floor(sum({c} * cx * cy) / sum(cx * cy)::DOUBLE + 0.5)::INT AS {c}' for c in 'rgb')}
FROM f1 JOIN tx ON tx.img = f1.img AND tx.x = f1.x JOIN ty ON ty.img = f1.img AND ty.y = f1.y JOIN dim ON dim.img = f1.img GROUP BY f1.img, tx, ty""")
def s01_k01_k02_capped_scan(spark: SparkSession, d: str) -> DataFrame:
    """Images written as PNG files by the committing sink, scanned by bands and scaled down to 2000 cells."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    files.write_files(rasters.embedding_images(spark, d), folder, prefix="scan-")
    return rasters.area_fitted(files.scan_png(spark, folder), 2000, "file")


@query(f"WITH {S.F1} SELECT 'index-' || img || '.bin' AS file, (max(x) + 1)::INT * (max(y) + 1)::INT AS bytes, md5(string_agg(chr(65 + (x + y) % 7), '' ORDER BY y, x)) AS letters FROM f1 GROUP BY img")
def k03_k06_index_files(spark: SparkSession, d: str) -> DataFrame:
    """Index files by the committing sink, read back as whole files."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    px = rasters.embedding_images(spark, d).select("img", "y", "x", ((F.col("x") + F.col("y")) % 7).alias("idx"))
    files.write_files(px, folder, "index", "index-", 7)
    got = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    letters = F.translate(F.decode("content", "ISO-8859-1"), "".join(map(chr, range(7))), "ABCDEFG")
    return got.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.length("content").alias("bytes"), F.md5(letters).alias("letters"))


_NAMED = """near AS (SELECT c.r, c.g, c.b, m.idx AS idx FROM (SELECT c.r, c.g, c.b, min({'d': round(DIST, 12), 'idx': s.idx}) AS m FROM OWN c, SWATCH s GROUP BY c.r, c.g, c.b) c)"""
_NAMED = _NAMED.replace("DIST", S.d2("c.ok_", "s.ok_")).replace("OWN", S.ok("(SELECT DISTINCT r, g, b FROM f3)")).replace("SWATCH", f"(SELECT * FROM {S.ok('sw')})")


@query(f"""WITH {S.F3}, {S.F5}, {_NAMED}, k AS (SELECT img, idx, count(*) AS n FROM f3 JOIN near USING (r, g, b) GROUP BY img, idx),
t AS (SELECT *, (n * 100 // sum(n) OVER (PARTITION BY img))::BIGINT AS percent, row_number() OVER (PARTITION BY img ORDER BY n DESC, idx) AS rank FROM k)
SELECT img, rank, code, 'thread ' || code AS name, printf('#%02X%02X%02X', r, g, b) AS hex, r, g, b, n AS count, percent FROM t JOIN sw USING (idx) WHERE rank <= 9""")
def a14_named_statistics(spark: SparkSession, d: str) -> DataFrame:
    sw = rasters.swatches(spark, d).withColumn("name", F.concat(F.lit("thread "), "code"))
    return matching.thread_statistics(rasters.blocky_images(spark, d), sw, 9, described=True).drop("metres")


_DEC = {"srgb": S.lin("u"), "gamma": "power(u, 2.2)", "bt2020": "(CASE WHEN u < 0.0181053951 * 4.5 THEN u / 4.5 ELSE power((u + 0.09929682680944) / 1.09929682680944, 1 / 0.45) END)"}


@query(f"WITH {S.F1} SELECT img, y, x, {', '.join(f'round({e.replace(chr(117), f"({c} / 255.0)") if n == "gamma" else e.replace("(u ", f"({c} / 255.0 ").replace(" u ", f" {c} / 255.0 ")}, 6) AS {c}_{n}' for n, e in _DEC.items() for c in 'rgb')} FROM f1")
def p14_transfer_curves(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.embedding_images(spark, d)
    out = {f"{c}_{n}": F.round(v, 6) for n, curve in (("srgb", "srgb"), ("gamma", 2.2), ("bt2020", "bt2020")) for c, v in zip("rgb", C.linear_plane(tuple(C.unit(F.col(c)) for c in "rgb"), curve=curve), strict=True)}
    return p.select("img", "y", "x", *(v.alias(k) for k, v in out.items()))


@query(SQL["t06_projects"])
def t06_repository(spark: SparkSession, d: str) -> DataFrame:
    """As t06_projects, by the versioned table on disk: five versions."""
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_acctbal")
    top = c.agg(F.max("c_custkey")).first()[0] or 0
    p = projects.Projects(spark, f"{shared_folder(spark)}/projects-{uuid.uuid4().hex}", "c_custkey bigint, c_acctbal double, stamp int", "c_custkey")
    p.save(c.withColumn("stamp", F.lit(0)))
    p.copy(c.where("c_acctbal > 5000").withColumn("as", F.col("c_custkey") + top), "as")
    p.delete(c.where("c_acctbal < 0"))
    p.touch(c.where("c_acctbal > 8000"), "stamp", F.lit(7))
    return p.rows()


@query("""SELECT * FROM (SELECT user_id % 50 AS device, session, "at", events, row_number() OVER (PARTITION BY user_id % 50 ORDER BY "at" DESC, session)::INT AS rank
FROM (SELECT user_id % 50 AS user_id, event_type || (event_id % 11)::VARCHAR AS session, max(event_id) AS "at", count(*) AS events FROM events GROUP BY ALL)) WHERE rank <= 5""")
def k18_k20_session_state(spark: SparkSession, d: str) -> DataFrame:
    """The newest five sessions of each device by a stream with state, which reads the events once."""
    at, key = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}", "spark.sql.streaming.stateStore.providerClass"
    # a stream reads folders: the table's own, or of a single file the one it lies in
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    single = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
    events = source.option("pathGlobFilter", "events.parquet").parquet(d) if single else source.parquet(f"{d}/events.parquet")
    e = events.select((F.col("user_id") % 50).alias("device"), F.concat("event_type", (F.col("event_id") % 11).cast("string")).alias("session"), F.col("event_id").alias("at"))
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kept = logs.newest_sessions(e, 5)
        write = kept.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{at}/batch-{n}"))
        write.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(kept.schema).parquet(f"{at}/batch-0")
