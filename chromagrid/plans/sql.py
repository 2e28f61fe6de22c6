"""The same fixtures and color formulas as DuckDB SQL text, for the oracles."""

from __future__ import annotations

import re


def exact(sql: str) -> str:
    """Decimal literals as doubles."""
    return re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\d.e'])", r"\1e0", sql)


def _ch(k: int) -> str:
    return f"least(255.0, greatest(0.0, floor((e[(x + {k}) % 64 + 1]::DOUBLE + 0.6) * 212.5)))::INT"


F1 = f"""f1 AS (SELECT img, y::INT AS y, x::INT AS x, {_ch(0)} AS r, {_ch(21)} AS g, {_ch(42)} AS b FROM
 (SELECT label AS img, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding AS e, unnest(range(64)) AS x FROM embeddings))"""
F3 = f"""{F1}, f3 AS (SELECT a.img, a.y, a.x, s.r, s.g, s.b FROM f1 a JOIN f1 s ON s.img = a.img AND s.y = a.y // 6 AND s.x = a.x // 6)"""
F6 = f"""{F1}, f6 AS (SELECT img, y, x, CASE WHEN y < 20 THEN 80 + x // 2 + r % 3 WHEN x BETWEEN 16 AND 47 AND y BETWEEN 24 AND 44 THEN 200 + r % 8 ELSE 40 + r % 40 END AS r,
 CASE WHEN y < 20 THEN 140 + y + g % 3 WHEN x BETWEEN 16 AND 47 AND y BETWEEN 24 AND 44 THEN 140 + g % 8 ELSE 90 + g % 50 END AS g,
 CASE WHEN y < 20 THEN 230 + b % 3 WHEN x BETWEEN 16 AND 47 AND y BETWEEN 24 AND 44 THEN 110 + b % 4 ELSE 50 END AS b FROM f1)"""
F4 = """f4 AS (SELECT 0 AS img, y, x, v AS r, v AS g, v AS b FROM (SELECT x, y, CASE WHEN (x // 6 + y // 6) % 2 = 0 THEN 0 ELSE 255 END AS v FROM
 (SELECT (i % 240)::INT AS x, (i // 240)::INT AS y FROM range(32640) t(i))))"""
F5 = """sw AS (SELECT 'TST' AS brand, p_brand AS code, i::INT AS idx, (i * 53 % 256)::INT AS r, (i * 97 % 256)::INT AS g, (i * 193 % 256)::INT AS b FROM
 (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS i FROM (SELECT DISTINCT p_brand FROM part)))"""
#: Three centers that the quantiser queries use.
TRIO = "trio AS (SELECT * FROM (VALUES (0, 40, 60, 90), (1, 120, 130, 110), (2, 220, 180, 160)) t(idx, r, g, b))"

ROW, COL = "PARTITION BY img, y ORDER BY x", "PARTITION BY img, x ORDER BY y"
ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def lin(u: str) -> str:
    return f"(CASE WHEN {u} <= 0.04045 THEN {u} / 12.92 ELSE power(({u} + 0.055) / 1.055, 2.4) END)"


def enc(v: str) -> str:
    return f"(CASE WHEN {v} <= 0.0031308 THEN {v} * 12.92 ELSE 1.055 * power({v}, 1 / 2.4) - 0.055 END)"


def byte(u: str) -> str:
    return f"floor(greatest(0.0, least(1.0, {u})) * 255 + 0.5)::INT"


def fit(v: str) -> str:
    return f"greatest(0.0, least(255.0, floor({v} + 0.5)))::INT"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    return f"(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"


def ok(src: str, p: str = "ok", rgb: tuple[str, str, str] = ("r", "g", "b"), linear: bool = False) -> str:
    """``src`` with OKLab columns p_l, p_a, p_b."""
    chan = ", ".join(f"{c if linear else lin(f'({c} / 255.0)')} AS _{k}" for c, k in zip(rgb, "rgb", strict=True))
    root = lambda a, b, c: f"cbrt(greatest(0.0, {a} * _r + {b} * _g + {c} * _b))"
    lms = f"{root(0.4122214708, 0.5363325363, 0.0514459929)} AS _l, {root(0.2119034982, 0.6806995451, 0.1073969566)} AS _m, {root(0.0883024619, 0.2817188376, 0.6299787005)} AS _s"
    return f"""(SELECT * EXCLUDE (_l, _m, _s), 0.2104542553 * _l + 0.7936177850 * _m - 0.0040720468 * _s AS {p}_l,
 1.9779984951 * _l - 2.4285922050 * _m + 0.4505937099 * _s AS {p}_a, 0.0259040371 * _l + 0.7827717662 * _m - 0.8086757660 * _s AS {p}_b
 FROM (SELECT * EXCLUDE (_r, _g, _b), {lms} FROM (SELECT *, {chan} FROM {src})))"""


def lab(src: str, p: str = "lab", rgb: tuple[str, str, str] = ("r", "g", "b")) -> str:
    """``src`` with CIE L*a*b* columns."""
    chan = ", ".join(f"{lin(f'({c} / 255.0)')} AS _{k}" for c, k in zip(rgb, "rgb", strict=True))
    f = lambda t: f"(CASE WHEN {t} > power(6.0 / 29.0, 3) THEN power({t}, 1 / 3.0) ELSE {t} / (3 * (6.0 / 29.0) * (6.0 / 29.0)) + 4.0 / 29.0 END)"
    return f"""(SELECT * EXCLUDE (_x, _y, _z), 116.0 * _y - 16.0 AS {p}_l, 500.0 * (_x - _y) AS {p}_a, 200.0 * (_y - _z) AS {p}_b FROM
 (SELECT * EXCLUDE (_x, _y, _z), {f('_x')} AS _x, {f('_y')} AS _y, {f('_z')} AS _z FROM
 (SELECT * EXCLUDE (_r, _g, _b), (0.4124564 * _r + 0.3575761 * _g + 0.1804375 * _b) / 0.95047 AS _x, 0.2126729 * _r + 0.7151522 * _g + 0.0721750 * _b AS _y,
 (0.0193339 * _r + 0.1191920 * _g + 0.9503041 * _b) / 1.08883 AS _z FROM (SELECT *, {chan} FROM {src}))))"""


def d2(p: str, q: str, keys: str = "lab") -> str:
    return " + ".join(f"({p}{k} - {q}{k}) * ({p}{k} - {q}{k})" for k in keys)


#: f1 with luma of linear channels in 0..1.
LUMA = f"lum AS (SELECT *, {luma(*(lin(f'({c} / 255.0)') for c in 'rgb'))} AS luma FROM f1)"
#: f6 likewise.
LUMA6 = LUMA.replace("FROM f1)", "FROM f6)")
#: f1 with channels and luma in 0..1, encoded.
UNIT = f"u AS (SELECT img, y, x, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b, {luma()} / 255.0 AS luma FROM f1)"


def near8(src: str) -> str:
    """``src`` (with rgb) and the nearest of trio: idx, d."""
    return f"""(SELECT p.*, n.idx, n.d FROM {src} p JOIN (SELECT r, g, b, m.idx AS idx, m.d AS d FROM (SELECT c.r, c.g, c.b, min({{'d': (c.r - t.r) * (c.r - t.r) + (c.g - t.g) * (c.g - t.g) + (c.b - t.b) * (c.b - t.b), 'idx': t.idx}}) AS m
 FROM (SELECT DISTINCT r, g, b FROM {src}) c, trio t GROUP BY ALL)) n USING (r, g, b))"""


#: f3 with idx of the nearest of three centers.
IDX = f"ix AS {near8('f3')}"


def around(c: str) -> str:
    """Window columns of the eight neighbours of ``c``; src gives px."""
    return f"lag({c}) OVER (PARTITION BY img, y ORDER BY x) AS w_, lead({c}) OVER (PARTITION BY img, y ORDER BY x) AS e_"
