"""Queries on palettes, symbols and dithering tiles, the stepwise ones with recursive DuckDB queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import kernels, matching
from ..sources import catalogs, rasters, sinks
from . import sql as S
from .diffusion import PAL, PALETTE
from .planes import f1, index
from .scalars import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = S.exact(sql)
        return f

    return add


def _centers(spark: SparkSession, c: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(c)], "idx int, l double, a double, b double")


#: Distinct colors of the blocky images with counts and first place, in OKLab.
_COLORS = f"col AS MATERIALIZED (SELECT r, g, b, n, img, y, x, ok_l AS l, ok_a AS a, ok_b AS o FROM {S.ok('(SELECT r, g, b, count(*) AS n, min({img: img, y: y, x: x}) AS pos, min({img: img, y: y, x: x}).img AS img, min({img: img, y: y, x: x}).y AS y, min({img: img, y: y, x: x}).x AS x FROM f3 GROUP BY r, g, b)')})"
_FAR = "(c.l - k.l) * (c.l - k.l) + (c.a - k.a) * (c.a - k.a) + (c.o - k.b) * (c.o - k.b)"


def _lloyd(before: str, after: str) -> str:
    return f"""{after} AS (SELECT k.idx, coalesce(s.l, k.l) AS l, coalesce(s.a, k.a) AS a, coalesce(s.b, k.b) AS b FROM {before} k LEFT JOIN (SELECT m.idx AS idx, sum(l * n) / sum(n) AS l, sum(a * n) / sum(n) AS a, sum(o * n) / sum(n) AS b
 FROM (SELECT c.l, c.a, c.o, c.n, min({{'d': {_FAR}, 'idx': k.idx}}) AS m FROM col c, {before} k GROUP BY c.r, c.g, c.b, c.l, c.a, c.o, c.n) GROUP BY m.idx) s USING (idx))"""


@query(f"WITH {S.F3}, {_COLORS}, {PAL}, k0 AS (SELECT k AS idx, ok_l AS l, ok_a AS a, ok_b AS b FROM {S.ok('pal')}), {_lloyd('k0', 'k1')}, {_lloyd('k1', 'k2')}, {_lloyd('k2', 'k3')} SELECT idx, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM k3")
def q10_k_means(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds from five given centers."""
    return rounded(_centers(spark, kernels.k_means(rasters.blocky_images(spark, d), 5, 3, start=kernels.to_oklab(np.array(PALETTE, float)))))


#: What the seeded start draws, for the SQL.
_DRAWS = [0.5, *np.random.default_rng(1).random(4).tolist()]


def _drawn(i: int) -> str:
    """The i-th center: the color at which the running mass passes the drawn share."""
    far = [f"((c.l - k{j}.l) * (c.l - k{j}.l) + (c.a - k{j}.a) * (c.a - k{j}.a) + (c.o - k{j}.b) * (c.o - k{j}.b))" for j in range(i)]
    mass = "n" if not i else f"least({', '.join(far)}) * n" if i > 1 else f"{far[0]} * n"
    return f"k{i} AS (SELECT {i} AS idx, l, a, o AS b FROM (SELECT c.*, sum({mass}) OVER (ORDER BY img, y, x) AS run, sum({mass}) OVER () AS total FROM col c{''.join(f', k{j}' for j in range(i))}) WHERE run >= {_DRAWS[i]!r} * total ORDER BY img, y, x LIMIT 1)"


@query(f"WITH {S.F3}, {_COLORS}, {', '.join(_drawn(i) for i in range(5))} SELECT idx, round(l, 6) AS l, round(a, 6) AS a, round(b, 6) AS b FROM ({' UNION ALL '.join(f'SELECT * FROM k{i}' for i in range(5))})")
def q12_spread_start(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_centers(spark, kernels.spread_start(kernels.counted_colors(rasters.blocky_images(spark, d)), 5)))


@query()
def q11_q12_q14_grown_palette(spark: SparkSession, d: str) -> DataFrame:
    return _centers(spark, kernels.grown_palette(rasters.blocky_images(spark, d), 3, 6, 3))


@query()
def q11_weighted_palette(spark: SparkSession, d: str) -> DataFrame:
    """Growth from given centers with cells of every third column 1.6 times as important."""
    w = F.when(F.col("x") % 3 == 0, 1.6).otherwise(1.0)
    return _centers(spark, kernels.grown_palette(rasters.blocky_images(spark, d), most=6, rounds=3, weight=w, centers=kernels.to_oklab(np.array(PALETTE[:3], float))))


@query()
def q12_oversampled_start(spark: SparkSession, d: str) -> DataFrame:
    return _centers(spark, kernels.oversampled_start(kernels.counted_colors(f1(spark, d)), 12))


_PARTS = "prt AS (SELECT p_partkey AS idx, (100 + p_partkey * 37 % 60)::INT AS r, (90 + p_partkey * 53 % 50)::INT AS g, (80 + p_partkey * 71 % 70)::INT AS b FROM part WHERE p_size <= 10)"


@query(f"""WITH RECURSIVE {_PARTS}, lab AS (SELECT *, row_number() OVER (ORDER BY idx) AS n FROM (SELECT idx, r, g, b, ok_l, ok_a, ok_b FROM {S.ok('prt')})),
walk AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS idx, NULL::BIGINT AS home, []::STRUCT(l DOUBLE, a DOUBLE, b DOUBLE, idx BIGINT)[] AS heads
 UNION ALL SELECT n, idx, coalesce(hit, idx), CASE WHEN hit IS NULL THEN list_append(heads, {{'l': ok_l, 'a': ok_a, 'b': ok_b, 'idx': idx}}) ELSE heads END
 FROM (SELECT lab.*, heads, list_filter(heads, lambda h: sqrt((h.l - ok_l) * (h.l - ok_l) + (h.a - ok_a) * (h.a - ok_a) + (h.b - ok_b) * (h.b - ok_b)) < 0.04)[1].idx AS hit FROM walk JOIN lab ON lab.n = walk.n + 1))
SELECT home, count(*) AS size, sum(r)::BIGINT // count(*) AS r, sum(g)::BIGINT // count(*) AS g, sum(b)::BIGINT // count(*) AS b FROM walk JOIN prt USING (idx) GROUP BY home""")
def q16_merged_colors(spark: SparkSession, d: str) -> DataFrame:
    """Colors made of the parts of up to size ten, merged in the order of their keys."""
    k = F.col("p_partkey")
    p = spark.read.parquet(f"{d}/part.parquet").where("p_size <= 10")
    p = p.select(k.alias("idx"), *((base + k * f % m).cast("int").alias(c) for c, base, f, m in (("r", 100, 37, 60), ("g", 90, 53, 50), ("b", 80, 71, 70))))
    return kernels.merged_palette(p, 0.04)


_DENSE, _OPEN, _CROSS = "■▲●", "□△○", "✚✖☆"
_LISTS = "{'dense': '■▲●', 'open': '□△○', 'cross': '✚✖☆'}"
_CHARS = lambda e: f"regexp_extract_all({e}, '.')"


@query(f"""WITH RECURSIVE {S.F1}, {S.F5}, near AS (SELECT c.r, c.g, c.b, m.idx AS idx FROM (SELECT c.r, c.g, c.b, min({{'d': round({S.d2('c.ok_', 's.ok_')}, 12), 'idx': s.idx}}) AS m FROM {S.ok('(SELECT DISTINCT r, g, b FROM f1)')} c, (SELECT * FROM {S.ok('sw')}) s GROUP BY c.r, c.g, c.b) c),
cnt AS (SELECT img, idx, count(*) AS n FROM f1 JOIN near USING (r, g, b) GROUP BY img, idx),
thread AS (SELECT img, code, row_number() OVER (PARTITION BY img ORDER BY n DESC, cnt.idx) AS rank FROM cnt JOIN sw ON sw.idx = cnt.idx),
pref AS (SELECT *, {_CHARS("CASE WHEN luma >= 0.70 THEN '" + _DENSE + _CROSS + _OPEN + "' WHEN luma <= 0.35 THEN '" + _OPEN + _CROSS + _DENSE + "' ELSE '" + _CROSS + _DENSE + _OPEN + "' END || 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789'")} AS likes FROM (SELECT *, ((rank - 1) * 37 % 100) / 100.0::DOUBLE AS luma FROM thread)),
given AS (SELECT img, 0::BIGINT AS rank, NULL::VARCHAR AS code, NULL::VARCHAR AS symbol, []::VARCHAR[] AS used FROM (SELECT DISTINCT img FROM thread)
 UNION ALL SELECT img, rank, code, pick, list_append(used, pick) FROM (SELECT p.img, p.rank, p.code, used, list_filter(likes, lambda s: NOT list_contains(used, s))[1] AS pick FROM given g JOIN pref p ON p.img = g.img AND p.rank = g.rank + 1)),
swapped AS (SELECT img, rank, code, CASE WHEN rank = 1 THEN '@' ELSE symbol END AS symbol FROM given WHERE rank > 0)
SELECT img, code, symbol, symbol AS "unique" FROM swapped""")
def q17_q18_q20_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of all colors that an image uses, for each image."""
    sw = rasters.swatches(spark, d)
    used = matching.thread_statistics(f1(spark, d), sw, limit=sw.count()).select("img", "rank", "code", "count")

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("rank").to_pylist()
        smart = kernels.smart_symbols([(r["code"], (i * 37 % 100) / 100, r["count"]) for i, r in enumerate(rows)], _DENSE, _OPEN, _CROSS, sinks.LETTERS)
        smart = kernels.set_symbol(smart, rows[0]["code"], "@", sinks.LETTERS)
        unique = kernels.unique_symbols(list(smart.values()), sinks.LETTERS)
        out = {"code": pa.array(smart.keys(), pa.string()), "symbol": pa.array(smart.values(), pa.string()), "unique": pa.array(unique, pa.string())}
        return pa.table({"img": group.column("img"), **out})

    return used.groupBy("img").applyInArrow(run, f"img {used.schema['img'].dataType.simpleString()}, code string, symbol string, unique string")


_AROUND = " + ".join(f"m[1 + (i // 64 + {dy + 64}) % 64 * 64 + (i % 64 + {dx + 64}) % 64]" for dy in range(-2, 3) for dx in range(-2, 3) if dy or dx)


@query(f"""WITH RECURSIVE {S.F1}, lcg AS (SELECT 0 AS i, (1234567::BIGINT * 1664525 + 1013904223) % 4294967296 AS s UNION ALL SELECT i + 1, (s * 1664525 + 1013904223) % 4294967296 FROM lcg WHERE i < 4095),
relax AS (SELECT 0 AS n, (SELECT list(((s >> 8) & 65535) / 65535.0 ORDER BY i) FROM lcg) AS m
 UNION ALL SELECT n + 1, m[:i] || [least(1.0, greatest(0.0, 0.7 * m[i + 1] + 0.3 * (1 - ({_AROUND}) / 24.0)))] || m[i + 2:] FROM (SELECT n, m, n % 4096 AS i FROM relax WHERE n < 8192)),
tile AS MATERIALIZED (SELECT unnest(range(64 * 64)) AS cell, unnest(m) AS t FROM relax WHERE n = 8192),
lum AS (SELECT img, y, x, r, g, b, {S.luma('(r / 255.0)', '(g / 255.0)', '(b / 255.0)')} AS l, t FROM f1 JOIN tile ON cell = (y & 63) * 64 + (x & 63)),
fac AS (SELECT *, CASE WHEN l > 1e-6 THEN greatest(0.0, least(1.0, l + (t - 0.5) * 0.28 * 0.1)) / l ELSE 1.0 END AS f FROM lum)
SELECT img, y, x, {', '.join(f'{S.byte(f"{c} / 255.0 * f")} AS {c}' for c in 'rgb')} FROM fac""")
def n21_n22_ordered_dither(spark: SparkSession, d: str) -> DataFrame:
    return kernels.ordered(f1(spark, d))


@query(f"WITH {S.F3}, {S.TRIO}, {S.IDX} SELECT img, y, x, idx FROM ix")
def s05_lenient_index_files(spark: SparkSession, d: str) -> DataFrame:
    """Index files of one byte a cell with a tail that isn't read."""
    p = index(spark, d)
    files = sinks.index_bytes(p, 3).join(rasters.sizes(p), "img").withColumn("content", F.concat("content", F.unhex(F.lit("FFEEDD"))))
    return catalogs.index_map(files.select("img", "w", "h", "content"), lenient=True)
