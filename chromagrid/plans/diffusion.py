"""Queries on the order-dependent kernels, each with a recursive DuckDB query that visits the pixels in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kernels, topology
from . import sql as S
from .planes import f1, index

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = S.exact(sql)
        return f

    return add


PALETTE = [(40, 60, 90), (120, 130, 110), (220, 180, 160), (10, 10, 10), (250, 250, 250)]
PAL = "pal AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(PALETTE)) + ") t(k, r, g, b))"
#: Shares of the error as (dx, dy, share), for the SQL.
FLOYD = [(1, 0, "7/16"), (-1, 1, "3/16"), (0, 1, "5/16"), (1, 1, "1/16")]
ATKINSON = [(1, 0, "1/8"), (2, 0, "1/8"), (-1, 1, "1/8"), (0, 1, "1/8"), (1, 1, "1/8"), (0, 2, "1/8")]


def _share(text: str) -> str:
    a, b = text.split("/")
    return repr(int(a) / int(b))


def rows_sql(src: str, pal: str, keys: list[str], taps: list, strength: str = "1.0", low: str = "", high: str = "") -> str:
    """``done``: rows with t = c hold index k of each pixel, left to right in every row.  A step takes the pixels of
    one x + 2y, and carries those of the last steps along."""
    order = sorted(taps, key=lambda t: (-t[1], -t[0]))
    back = max(dx + 2 * dy for dx, dy, _ in taps)
    value = {k: f"p.{k}" + "".join(f" + coalesce(s{i}.e_{k}, 0.0) * {_share(s)}" for i, (_, _, s) in enumerate(order)) for k in keys}
    if low:
        value = {k: f"greatest({low}, least({high}, {v}))" for k, v in value.items()}
    joins = " ".join(f"LEFT JOIN done s{i} ON s{i}.img = p.img AND s{i}.y = p.y - {dy} AND s{i}.x = p.x - {dx}" for i, (dx, dy, _) in enumerate(order))
    vs, es = ", ".join(f"v_{k}" for k in keys), ", ".join(f"e_{k}" for k in keys)
    far = " + ".join(f"(q.{k} - v_{k}) * (q.{k} - v_{k})" for k in keys)
    best = ", ".join(f"'{k}': q.{k}" for k in keys)
    return f"""cells AS MATERIALIZED (SELECT img, y, x, x + 2 * y AS c, {', '.join(keys)} FROM {src}),
done AS (SELECT -1 AS t, -1 AS c, -1::BIGINT AS img, -1 AS y, -1 AS x, 0 AS k, {', '.join(f'0.0::DOUBLE AS e_{k}' for k in keys)}
 UNION ALL SELECT n.t, u.* FROM (SELECT max(t) + 1 AS t FROM done) n, LATERAL (
  SELECT c, img, y, x, best.k AS k, {', '.join(f'(v_{k} - best.{k}) * {strength} AS e_{k}' for k in keys)} FROM (
   SELECT v.c, v.img, v.y, v.x, {vs}, min({{'d': {far}, 'k': q.k, {best}}}) AS best
   FROM (SELECT p.c, p.img, p.y, p.x, {', '.join(f'{v} AS v_{k}' for k, v in value.items())} FROM cells p {joins} WHERE p.c = n.t) v, {pal} q GROUP BY v.c, v.img, v.y, v.x, {vs})
  UNION ALL SELECT c, img, y, x, k, {es} FROM done WHERE done.c > n.t - {back} AND c >= 0) u)"""


def serpentine_sql(best: str, cap: str = "0.67") -> str:
    """``done``: k and color of each step of a serpentine walk over f1; a row holds the errors of the last two rows of its image.
    ``best``: the struct (k, r, g, b) chosen for ARRAY v."""
    order = [("2 * i + 2", "i + 1 < w AND p.y > 0", "1/16"), ("2 * i + 1", "p.y > 0", "5/16"), ("2 * i", "i > 0 AND p.y > 0", "3/16"), ("1", "i > 0", "7/16")]
    value = {}
    for n, c in enumerate("rgb", 1):
        v = f"p.{c} / 255.0"
        for at, there, s in order:
            v = f"greatest(0.0, least(1.0, {v} + CASE WHEN {there} THEN past[{at}][{n}] ELSE 0.0 END * {_share(s)}))"
        value[c] = v
    walk = "walk AS MATERIALIZED (SELECT f1.img, f1.y, x, r, g, b, w, CASE WHEN f1.y % 2 = 0 THEN x ELSE w - 1 - x END AS i, f1.y * w + CASE WHEN f1.y % 2 = 0 THEN x ELSE w - 1 - x END AS s FROM f1 JOIN dim USING (img))"
    error = ", ".join(f"greatest(-{cap}, least({cap}, v[{n}] - best.{c})) * (CASE WHEN x % 5 = 0 THEN 0.5 ELSE 1.0 END)" for n, c in enumerate("rgb", 1))
    return f"""dim AS (SELECT img, max(x) + 1 AS w FROM f1 GROUP BY img), {walk},
done AS (SELECT img, -1 AS s, 0 AS y, 0 AS x, 0 AS k, []::DOUBLE[][] AS past FROM dim
 UNION ALL SELECT img, s, y, x, best.k, list_prepend([{error}], past[:2 * w])
  FROM (SELECT *, {best} AS best FROM (SELECT p.img, p.s, p.y, p.x, p.w, past, [{', '.join(value.values())}] AS v FROM done d JOIN walk p ON p.img = d.img AND p.s = d.s + 1)))"""


_UNIT_PAL = ", ".join(f"{{'d': {' + '.join(f'(v[{n}] - {c} / 255.0) * (v[{n}] - {c} / 255.0)' for n, c in enumerate(p, 1))}, 'k': {k}, 'r': {p[0]} / 255.0, 'g': {p[1]} / 255.0, 'b': {p[2]} / 255.0}}" for k, p in enumerate(PALETTE))
_OK = f"WITH RECURSIVE {S.F1}, {PAL}, src AS (SELECT img, y, x, ok_l, ok_a, ok_b FROM {S.ok('f1')}), pl AS (SELECT k, ok_l, ok_a, ok_b FROM {S.ok('pal')})"
_KEYS = ["ok_l", "ok_a", "ok_b"]
_INDEX = "SELECT img, y, x, k AS idx FROM done WHERE t = c AND t >= 0"


@query(f"WITH RECURSIVE {S.F1}, {serpentine_sql(f'list_min([{_UNIT_PAL}])')} SELECT img, y, x, k AS idx FROM done WHERE s >= 0")
def q03_q07_floyd_steinberg(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d).withColumn("edge", F.col("x") % 5 == 0), PALETTE)


_STEPS = "{'k': 0, " + ", ".join(f"'{c}': floor(v[{n}] * 3 + 0.5) * 85 / 255.0" for n, c in enumerate("rgb", 1)) + "}"


def four_levels(r: float, g: float, b: float) -> tuple[int, int, int]:
    """Each channel to the nearest of four levels."""
    return int(r * 3 + 0.5) * 85, int(g * 3 + 0.5) * 85, int(b * 3 + 0.5) * 85


_PACK = _STEPS.replace("'k': 0", "'k': ((floor(v[1] * 3 + 0.5) * 85)::INT * 256 + (floor(v[2] * 3 + 0.5) * 85)::INT) * 256 + (floor(v[3] * 3 + 0.5) * 85)::INT")


@query(f"WITH RECURSIVE {S.F1}, {serpentine_sql(_PACK)} SELECT img, y, x, k >> 16 AS r, (k >> 8) & 255 AS g, k & 255 AS b FROM done WHERE s >= 0")
def q04_diffusion_by_callable(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered_by(f1(spark, d).withColumn("edge", F.col("x") % 5 == 0), four_levels)


@query(f"{_OK}, {rows_sql('src', 'pl', _KEYS, FLOYD)} {_INDEX}")
def q05_floyd_oklab(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d), PALETTE, "floyd", "oklab")


@query(f"{_OK}, {rows_sql('src', 'pl', _KEYS, ATKINSON)} {_INDEX}")
def q06_atkinson_oklab(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d), PALETTE, "atkinson", "oklab")


@query(f"WITH RECURSIVE {S.F1}, {PAL}, {rows_sql('f1', 'pal', list('rgb'), FLOYD, '0.7', '0.0', '255.0')} {_INDEX}")
def q07_floyd_strength(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d), PALETTE, strength=0.7)


@query(f"WITH RECURSIVE {S.F1}, {PAL}, {rows_sql('f1', 'pal', list('rgb'), [t for t in FLOYD if t[:2] != (0, 1)], '1.0', '0.0', '255.0')} {_INDEX}")
def q07_floyd_strength_without_below(spark: SparkSession, d: str) -> DataFrame:
    return kernels.dithered(f1(spark, d), PALETTE, strength=1.0, drop_below=True)


@query(f"""{_OK}, {rows_sql('src', 'pl', _KEYS, ATKINSON)} SELECT 'atkinson' AS method, img, y, x, r, g, b FROM ({_INDEX}) JOIN pal ON k = idx
 UNION ALL SELECT 'none', img, y, x, r, g, b FROM f1""")
def q08_dispatch(spark: SparkSession, d: str) -> DataFrame:
    p = f1(spark, d)
    both = [kernels.dither(p, PALETTE, m).withColumn("method", F.lit(m)) for m in ("atkinson", "none")]
    return both[0].unionByName(both[1])


def _cleaned_sql(src: str, out: str) -> str:
    """``src`` with lonely inner cells recolored in reading order: a step takes the cells of one x + 2y."""
    new = [(-1, 0), (-1, -1), (0, -1), (1, -1)]
    joins = " ".join(f"JOIN {out}_done n{i} ON n{i}.img = p.img AND n{i}.x = p.x + ({dx}) AND n{i}.y = p.y + ({dy})" for i, (dx, dy) in enumerate(new))
    vote = "list_min(list_transform(around, lambda v: {'n': -len(list_filter(around, lambda u: u = v)), 'v': v}))"
    return f"""{out}_dim AS (SELECT img, max(x) + 1 AS w, max(y) + 1 AS h FROM {src} GROUP BY img),
{out}_below AS (SELECT *, lead(idx) OVER (PARTITION BY img, x ORDER BY y) AS s, lead(idx) OVER (PARTITION BY img, y ORDER BY x) AS e FROM {src}),
{out}_cells AS MATERIALIZED (SELECT b.*, x + 2 * y AS c, x IN (0, w - 1) OR y IN (0, h - 1) AS border, [e, s, lag(s) OVER (PARTITION BY img, y ORDER BY x), lead(s) OVER (PARTITION BY img, y ORDER BY x)] AS later FROM {out}_below b JOIN {out}_dim USING (img)),
{out}_done AS (SELECT -1 AS t, -1 AS c, -1::BIGINT AS img, -1 AS y, -1 AS x, 0 AS idx
 UNION ALL SELECT n.t, u.* FROM (SELECT max(t) + 1 AS t FROM {out}_done) n, LATERAL (
  SELECT c, img, y, x, idx FROM {out}_cells WHERE c = n.t AND border
  UNION ALL SELECT c, img, y, x, CASE WHEN NOT list_contains(around, idx) AND best.n <= -2 THEN best.v ELSE idx END FROM (
   SELECT *, {vote} AS best FROM (SELECT p.c, p.img, p.y, p.x, p.idx, later || [n0.idx, n1.idx, n2.idx, n3.idx] AS around FROM {out}_cells p {joins} WHERE p.c = n.t AND NOT border))
  UNION ALL SELECT c, img, y, x, idx FROM {out}_done d WHERE d.c > n.t - 3 AND c >= 0) u),
{out} AS MATERIALIZED (SELECT img, y, x, idx FROM {out}_done WHERE t = c AND t >= 0)"""


_NOISY = f"{S.F3}, {S.TRIO}, {S.IDX}, noisy AS (SELECT img, y, x, CASE WHEN (x * 7 + y * 3) % 11 = 0 THEN (idx + 1 + x % 4) % 5 ELSE idx END AS idx FROM ix)"


def noisy(spark: SparkSession, d: str) -> DataFrame:
    """The index map with cells scattered over it."""
    odd = F.when((F.col("x") * 7 + F.col("y") * 3) % 11 == 0, (F.col("idx") + 1 + F.col("x") % 4) % 5).otherwise(F.col("idx"))
    return index(spark, d).withColumn("idx", odd.cast("int"))


@query(f"WITH RECURSIVE {_NOISY}, {_cleaned_sql('noisy', 'once')}, {_cleaned_sql('once', 'twice')} SELECT * FROM twice")
def q09_clean_singles(spark: SparkSession, d: str) -> DataFrame:
    return kernels.clean_singles(noisy(spark, d))


#: Areas by a closure over runs: part(img, y, x, idx, label), label in reading order.
_AREAS = """run AS (SELECT *, max(CASE WHEN new THEN x END) OVER (PARTITION BY img, y ORDER BY x) AS x0 FROM (SELECT *, idx IS DISTINCT FROM lag(idx) OVER (PARTITION BY img, y ORDER BY x) AS new FROM noisy)),
tie AS MATERIALIZED (SELECT DISTINCT a.img, a.y::BIGINT * 65536 + a.x0 AS u, b.y::BIGINT * 65536 + b.x0 AS v FROM run a JOIN run b ON b.img = a.img AND b.x = a.x AND b.y IN (a.y - 1, a.y + 1) AND b.idx = a.idx),
reach(img, u, v) AS (SELECT DISTINCT img, y::BIGINT * 65536 + x0, y::BIGINT * 65536 + x0 FROM run UNION SELECT r.img, r.u, t.v FROM reach r JOIN tie t ON t.img = r.img AND t.u = r.v),
part AS (SELECT r.img, y, x, idx, label FROM run r JOIN (SELECT img, u, min(v) AS label FROM reach GROUP BY img, u) l ON l.img = r.img AND l.u = r.y::BIGINT * 65536 + r.x0)"""
_ISLANDS = """small AS (SELECT img, label FROM part GROUP BY img, label HAVING count(*) < 3),
vote AS (SELECT a.img, a.label, b.idx, count(*) AS n FROM part a JOIN small USING (img, label) JOIN part b ON b.img = a.img AND abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.idx <> a.idx AND b.label > a.label GROUP BY a.img, a.label, b.idx),
best AS (SELECT img, label, min({'n': -n, 'low': idx & 7, 'idx': idx}) AS best FROM vote GROUP BY img, label)"""


@query(f"WITH RECURSIVE {_NOISY}, {_AREAS}, {_ISLANDS} SELECT img, y, x, coalesce(best.idx, part.idx) AS idx FROM part LEFT JOIN best USING (img, label)")
def q02_islands(spark: SparkSession, d: str) -> DataFrame:
    """In tiles of 16 x 16, so that areas cross many of them."""
    return topology.islands(noisy(spark, d), 3, tile=16)


@query(f"WITH RECURSIVE {_NOISY}, {_AREAS} SELECT img, label // 65536 AS y, label % 65536 AS x, count(*) AS cells FROM part GROUP BY img, label")
def q02_areas(spark: SparkSession, d: str) -> DataFrame:
    """First cell and size of each area of equal color."""
    got = topology.components(noisy(spark, d), tile=16).groupBy("img", "label").agg(F.count(F.lit(1)).alias("cells"))
    return got.select("img", F.shiftright("label", 32).alias("y"), F.col("label").bitwiseAND(F.lit(0xFFFFFFFF)).alias("x"), "cells")
