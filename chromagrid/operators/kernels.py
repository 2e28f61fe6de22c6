"""Order-dependent kernels: error diffusion, cleaning in place, palettes built step by step.

Error diffusion and cleaning are parallel over images; within one, left-to-right orders go a front of pixels at
a time, serpentine ones a pixel at a time, of which a task holds a few rows only.  Palette loops run on
distinct colors with counts; only the few centers are on the driver."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..sources.stored import stored
from .topology import by_image, by_row

# fixed values: (dx, dy, share) of the error
FLOYD = ((1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16))
ATKINSON = ((1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8))


def to_oklab(rgb: np.ndarray) -> np.ndarray:
    """0..255 channels (..., 3) to OKLab."""
    u = rgb / 255.0
    lin = np.where(u <= 0.04045, u / 12.92, ((u + 0.055) / 1.055) ** 2.4)
    return np.cbrt(np.maximum(lin @ np.array(C.LMS).T, 0)) @ np.array(C.OK).T


Choice = Callable[[float, float, float], tuple[int, tuple[float, float, float]]]


def nearest_of(palette: np.ndarray) -> Choice:
    """Maps channels to the index and color of the nearest palette color, the first of equals."""
    colors = [tuple(map(float, c)) for c in palette]

    def choose(a: float, b: float, c: float) -> tuple[int, tuple[float, float, float]]:
        k = min(range(len(colors)), key=[(a - p) * (a - p) + (b - q) * (b - q) + (c - r) * (c - r) for p, q, r in colors].__getitem__)
        return k, colors[k]

    return choose


def _spread(v: list[list[list[float]]], halved: list | None, forward: bool, choose: Choice, taps: tuple, cap: float, strength: float, bounds: tuple[float, float] | None) -> list[int]:
    """Values of the row v[0]; its errors go to itself and to the rows below it, v[1], v[2] and so on, as far as they are there."""
    w = len(v[0])
    out = [0] * w
    for x in range(w) if forward else range(w - 1, -1, -1):
        k, color = choose(*v[0][x])
        out[x] = k
        share_of = strength * (0.5 if halved is not None and halved[x] else 1.0)
        e = [min(cap, max(-cap, a - b)) * share_of for a, b in zip(v[0][x], color, strict=True)]
        for dx, dy, share in taps:
            nx = x + (dx if forward else -dx)
            if 0 <= nx < w and dy < len(v):
                got = [a + b * share for a, b in zip(v[dy][nx], e, strict=True)]
                v[dy][nx] = [min(bounds[1], max(bounds[0], a)) for a in got] if bounds else got
    return out


def diffused(plane: np.ndarray, palette: np.ndarray | None = None, taps: tuple = FLOYD, cap: float = 1e9, edge: np.ndarray | None = None, strength: float = 1.0, bounds: tuple[float, float] | None = None, mirror_rows: bool = False, choose: Callable | None = None) -> np.ndarray:
    """Serpentine error diffusion: index of the nearest palette color of each pixel with its error spread on.
    Odd rows go from right to left.

    A row starts where the one before has ended, so no two pixels can be taken at a time; the
    loop runs on plain floats.  ``bounds`` hold after each addition.  ``choose`` maps the three channels of a pixel to a value and its
    color, in place of the palette; values are given back.
    ``mirror_rows``: odd passes take row h - 1 - y, which leaves rows of an even height
    untouched (kept for comparison only)."""
    h, w, _ = plane.shape
    v, out = plane.astype(np.float64).tolist(), np.zeros((h, w), np.int32)
    halved = edge.tolist() if edge is not None else [None] * h
    choose, reach = choose or nearest_of(palette), max(dy for _, dy, _ in taps) + 1
    for yy in range(h):
        y = h - 1 - yy if mirror_rows and yy % 2 else yy
        out[y] = _spread(v[y : y + reach], halved[y], yy % 2 == 0, choose, taps, cap, strength, bounds)
    return out


def diffused_by_row(rows: Iterator[dict[str, np.ndarray]], choose: Choice, taps: tuple, cap: float) -> Iterator[np.ndarray]:
    """``diffused`` of channels 0..255 taken to 0..1 and bounded, halved where ``edge``: each row's values as soon as the rows that
    its errors go to are there, so that only those are held."""
    reach, passed = max(dy for _, dy, _ in taps) + 1, 0
    held: deque = deque()

    def first() -> np.ndarray:
        nonlocal passed
        got = _spread([v for v, _ in held], held[0][1], passed % 2 == 0, choose, taps, cap, 1.0, (0.0, 1.0))
        held.popleft()
        passed += 1
        return np.array(got, np.int32)

    for p in rows:
        held.append(((_planes(p) / 255.0).tolist(), p["edge"].tolist() if "edge" in p else None))
        if len(held) == reach:
            yield first()
    while held:
        yield first()


def diffused_in_rows(plane: np.ndarray, palette: np.ndarray, taps: tuple = FLOYD, strength: float = 1.0, read_bounds: tuple[float, float] | None = None) -> np.ndarray:
    """Error diffusion from left to right in every row, a front of pixels at a time.

    A pixel's error goes to its right and to rows below, one column back at most, so pixels of equal x + 2y don't
    depend on each other: each front is one numpy step.  A pixel adds up what it gets in the order in which a
    loop over rows would have brought it, so the result equals that loop's to the bit.  ``read_bounds`` hold
    when a pixel is read, not when it is added to."""
    h, w, _ = plane.shape
    up, left = max(dy for _, dy, _ in taps), max(dx for dx, _, _ in taps)
    # errors with a margin of zeros around them
    e = np.zeros((h + up, w + left + 1, 3))
    out = np.zeros((h, w), np.int32)
    arriving = sorted(taps, key=lambda t: (-t[1], -t[0]))
    for front in range(w + 2 * (h - 1)):
        ys = np.arange(max(0, (front - w + 2) // 2), min(h - 1, front // 2) + 1)
        xs = front - 2 * ys
        v = plane[ys, xs].astype(np.float64)
        for dx, dy, share in arriving:
            v = v + e[ys - dy + up, xs - dx + left] * share
        if read_bounds:
            v = np.clip(v, *read_bounds)
        k = ((palette[None] - v[:, None]) ** 2).sum(axis=2).argmin(axis=1)
        out[ys, xs] = k
        e[ys + up, xs + left] = (v - palette[k]) * strength
    return out


def _planes(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([p["r"], p["g"], p["b"]], axis=-1).astype(np.float64)


def dithered(px: DataFrame, palette: list[tuple[int, int, int]], method: str = "floyd", space: str = "rgb", cap: float = 0.67, strength: float | None = None, nearest: Callable | None = None, drop_below: bool = False) -> DataFrame:
    """px(img, y, x, r, g, b[, edge]) -> (img, y, x, idx).  method: none, floyd, atkinson.

    The order of pixels follows from what is asked for.  ``space="oklab"``: left to right in every row, errors
    whole (no cap, no bounds, ``edge`` is not read).  ``strength`` given: left to right on channels 0..255 that are bounded when
    read, the error times the strength (0 to 1); ``drop_below`` leaves out the 5/16 that
    go to the pixel below.  Else serpentine on channels 0..1: errors within ``cap``, halved where ``edge``, bounded
    after each addition.
    Method none takes each pixel's nearest color; ``nearest`` may be a Python callable for it that maps (r, g, b)
    arrays to palette indices."""
    pal = np.array(palette, np.float64)
    edge = "edge" in px.columns
    taps = FLOYD if method == "floyd" else ATKINSON
    ins = ["r", "g", "b"] + ["edge"] * edge

    def kernel(_: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        rgb = _planes(p)
        if nearest is not None and method == "none":
            return {"idx": np.asarray(nearest(rgb[..., 0], rgb[..., 1], rgb[..., 2]), np.int32)}
        v, q = (to_oklab(rgb), to_oklab(pal)) if space == "oklab" else (rgb / 255.0, pal / 255.0)
        if method == "none":
            d = ((v[:, :, None, :] - q[None, None]) ** 2).sum(axis=3)
            return {"idx": d.argmin(axis=2).astype(np.int32)}
        if space == "oklab":
            return {"idx": diffused_in_rows(v, q, taps)}
        used = tuple(t for t in taps if not (drop_below and t[:2] == (0, 1)))
        return {"idx": diffused_in_rows(rgb, pal, used, min(1.0, max(0.0, strength)), (0.0, 255.0))}

    def serpentine(rows: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        return ({"idx": k} for k in diffused_by_row(rows, nearest_of(pal / 255.0), taps, cap))

    if method != "none" and space != "oklab" and strength is None:
        return by_row(px, serpentine, ins, {"idx": "int"})
    return by_image(px, kernel, ins, {"idx": "int"})


def dithered_by(px: DataFrame, color: Callable[[float, float, float], tuple[int, int, int]], cap: float = 0.67) -> DataFrame:
    """Serpentine diffusion with a callable: px(img, y, x, r, g, b[, edge]) -> its colors (img, y, x, r, g, b).

    ``color`` maps the channels 0..1 of a pixel, error included, to a color of channels 0..255; its error is spread
    like that of a palette."""
    edge = "edge" in px.columns

    def choose(r: float, g: float, b: float) -> tuple[int, tuple[float, float, float]]:
        got = color(r, g, b)
        return got[0] << 16 | got[1] << 8 | got[2], (got[0] / 255.0, got[1] / 255.0, got[2] / 255.0)

    def serpentine(rows: Iterator[dict[str, np.ndarray]]) -> Iterator[dict[str, np.ndarray]]:
        return ({"r": k >> 16, "g": k >> 8 & 255, "b": k & 255} for k in diffused_by_row(rows, choose, FLOYD, cap))

    return by_row(px, serpentine, ["r", "g", "b"] + ["edge"] * edge, {"r": "int", "g": "int", "b": "int"})


def dither(px: DataFrame, palette: list[tuple[int, int, int]], method: str = "none") -> DataFrame:
    """Colors (img, y, x, r, g, b) by method: none gives the image back, floyd and atkinson the palette's
    colors by diffusion in OKLab."""
    if method == "none":
        return px.select("img", "y", "x", "r", "g", "b")
    if method not in ("floyd", "atkinson"):
        raise ValueError(f"no method {method!r}: none, floyd, atkinson")
    pal = F.array(*(F.struct(*(F.lit(int(v)).alias(c) for c, v in zip("rgb", p, strict=True))) for p in palette))
    got = dithered(px, palette, method, "oklab").withColumn("c", F.element_at(pal, F.col("idx") + 1))
    return got.select("img", "y", "x", *(F.col(f"c.{c}").alias(c) for c in "rgb"))


def ordered_tile(size: int = 64, seed: int = 1234567) -> np.ndarray:
    """Threshold tile from a linear congruential sequence, relaxed twice in place."""
    out = np.empty(size * size)
    for i in range(size * size):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = (seed >> 8 & 0xFFFF) / 65535.0
    m = out.reshape(size, size)
    for _ in range(2):
        for y in range(size):
            rows = [(y + d) % size for d in range(-2, 3)]
            for x in range(size):
                cols = [(x + d) % size for d in range(-2, 3)]
                near = (m[np.ix_(rows, cols)].sum() - m[y, x]) / 24
                m[y, x] = min(1.0, max(0.0, 0.7 * m[y, x] + 0.3 * (1 - near)))
    return m


def ordered(px: DataFrame, amp: float = 0.28) -> DataFrame:
    """Ordered dither of luma by the 64 x 64 tile (4096 rows, broadcast)."""
    m = ordered_tile()
    tile = px.sparkSession.createDataFrame([(y, x, float(m[y, x])) for y in range(64) for x in range(64)], "ty int, tx int, t double")
    p = px.withColumns({"ty": F.col("y").bitwiseAND(F.lit(63)), "tx": F.col("x").bitwiseAND(F.lit(63))}).join(F.broadcast(tile), ["ty", "tx"])
    lum = C.luma709(*(F.col(c) / 255.0 for c in "rgb"))
    p = p.withColumn("lum", lum)
    fac = F.when(F.col("lum") > 1e-6, C.clamp(F.col("lum") + (F.col("t") - 0.5) * amp * 0.1, 0, 1) / F.col("lum")).otherwise(1.0)
    return p.withColumns({c: C.byte(F.col(c) / 255.0 * fac) for c in "rgb"}).select("img", "y", "x", "r", "g", "b")


def singles_cleaned(idx: np.ndarray, passes: int = 2) -> np.ndarray:
    """In place, in reading order: an inner cell without an equal among its eight neighbours takes their
    commonest color if that occurs twice or more (least color of equals).  Cells of the border stay.

    A cell reads the new values of its left neighbour and of the row above, so cells of equal x + 2y are one numpy step."""
    v = idx.copy()
    h, w = v.shape
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    for _ in range(passes if h > 2 and w > 2 else 0):
        for front in range(3, w - 2 + 2 * (h - 2) + 1):
            ys = np.arange(max(1, (front - w + 3) // 2), min(h - 2, (front - 1) // 2) + 1)
            xs = front - 2 * ys
            near = np.stack([v[ys + dy, xs + dx] for dy, dx in around], axis=1)
            votes = (near[:, :, None] == near[:, None, :]).sum(axis=2)
            most = votes.max(axis=1)
            best = np.where(votes == most[:, None], near, np.iinfo(near.dtype).max).min(axis=1)
            alone = ~(near == v[ys, xs][:, None]).any(axis=1) & (most >= 2)
            v[ys, xs] = np.where(alone, best, v[ys, xs])
    return v


def clean_singles(px: DataFrame) -> DataFrame:
    return by_image(px, lambda _, p: {"idx": singles_cleaned(p["idx"]).astype(np.int32)}, ["idx"], {"idx": "int"})


def counted_colors(px: DataFrame, weight: Column | None = None) -> DataFrame:
    """(l, a, b, n, w) of distinct colors: what palette loops work on.  n: cells; w: their importance, or n."""
    w = F.sum(weight) if weight is not None else F.count(F.lit(1)).cast("double")
    one = px.groupBy("r", "g", "b").agg(F.count(F.lit(1)).alias("n"), w.alias("w"), F.min(F.struct("img", "y", "x")).alias("pos"))
    return one.select("n", "w", "pos", *(v.alias(k) for k, v in zip("lab", C.oklab(F.col("r"), F.col("g"), F.col("b"), True), strict=True)))


def _distances(centers: np.ndarray) -> Column:
    return F.array(*[sum(((F.col(k) - float(v)) * (F.col(k) - float(v)) for k, v in zip("lab", c, strict=True)), F.lit(0.0)) for c in centers])


def _step(colors: DataFrame, centers: np.ndarray, moved: np.ndarray | None = None) -> list:
    """Per center: sums of l, a, b by importance (l, a, b), importance w, cells n and error by importance, of the colors nearest
    to it.  ``moved``: where the error is measured to, if not to ``centers``."""
    near = colors.withColumn("d", _distances(centers)).withColumn("m", F.array_min("d")).withColumn("c", F.array_position("d", F.col("m")) - 1)
    if moved is not None:
        near = near.withColumn("m", F.element_at(_distances(moved), (F.col("c") + 1).cast("int")))
    return near.groupBy("c").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), *(F.sum(F.col(k) * F.col("w")).alias(k) for k in "lab"), F.sum(F.col("m") * F.col("w")).alias("err")).collect()


def spread_start(colors: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """Seeded k-means++ start: each next center falls on the color at which the running sum of
    squared distance times importance passes a drawn share.

    The running sum is taken over one total per range of positions, then within the range that
    holds the share."""
    rng = np.random.default_rng(seed)
    colors = colors.repartitionByRange("pos").withColumn("pid", F.spark_partition_id()).cache()
    w = Window.partitionBy("pid").orderBy("pos")
    centers: list[list[float]] = []
    for i in range(k):
        if not centers:
            weight = F.col("w")
        else:
            ds = [sum(((F.col(a) - v) * (F.col(a) - v) for a, v in zip("lab", c, strict=True)), F.lit(0.0)) for c in centers]
            weight = (F.least(*ds) if len(ds) > 1 else ds[0]) * F.col("w")
        mass = colors.withColumn("wt", weight)
        parts = sorted(mass.groupBy("pid").agg(F.sum("wt").alias("wt")).collect())
        upto = np.cumsum([r.wt for r in parts])
        if not len(parts) or not upto[-1]:
            break
        share = 0.5 if i == 0 else float(rng.random())
        at = int(np.searchsorted(upto, share * upto[-1]))
        before = float(upto[at - 1]) if at else 0.0
        inside = mass.where(F.col("pid") == parts[at].pid).withColumn("run", F.sum("wt").over(w) + before)
        # rounding may leave the last sum of a range just below the share
        last = F.coalesce(F.min_by(F.struct("l", "a", "b"), F.when(F.col("run") >= share * upto[-1], F.col("pos"))), F.max_by(F.struct("l", "a", "b"), F.col("pos")))
        hit = inside.agg(last.alias("c")).first().c
        centers.append([hit.l, hit.a, hit.b])
    colors.unpersist()
    return np.array(centers)


def oversampled_start(colors: DataFrame, k: int, seed: int = 1, rounds: int = 4) -> np.ndarray:
    """Seeded start by oversampling: a fixed number of passes, whatever ``k``.

    Each round draws every color with the probability 2 k w d2 / (sum of w d2), d2 being its squared distance to
    what is drawn already, by a hash of seed, round and place; then the drawn colors, weighted by the importance of the colors
    nearest to them (some 2 k a round, on the driver), are thinned to k by the same rule one at a time."""
    colors = colors.cache()
    first = colors.orderBy("pos").first()
    centers = np.array([[first.l, first.a, first.b]])
    for r in range(rounds):
        d = colors.withColumn("d", F.array_min(_distances(centers)) * F.col("w"))
        total = d.agg(F.sum("d")).first()[0]
        if not total:
            break
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(r), "pos"), 11) / float(1 << 53)
        got = d.where(u < F.col("d") * (2.0 * k / total)).orderBy("pos").select("l", "a", "b").collect()
        centers = np.vstack([centers, *([[x.l, x.a, x.b]] for x in got)])
    weight = np.zeros(len(centers))
    for row in _step(colors, centers):
        weight[row.c] = row.w
    colors.unpersist()
    rng, d = np.random.default_rng(seed), np.ones(len(centers))
    chosen: list[int] = []
    while len(chosen) < min(k, len(centers)):
        mass = np.cumsum(weight * d)
        if not mass[-1]:
            break
        at = int(np.searchsorted(mass, (0.5 if not chosen else rng.random()) * mass[-1]))
        chosen.append(min(at, len(centers) - 1))
        far = ((centers - centers[chosen[-1]]) ** 2).sum(axis=1)
        d = np.minimum(d, far) if len(chosen) > 1 else far
    return centers[chosen]


def k_means(px: DataFrame, k: int, rounds: int = 6, seed: int = 1, weight: Column | None = None, start: np.ndarray | None = None, oversample: bool = False) -> np.ndarray:
    """Centers (k, 3) in OKLab by Lloyd's rounds on distinct colors; an empty cluster stays put.  ``start``: centers to begin
    with; else spread_start, or oversampled_start with ``oversample``."""
    colors = counted_colors(px, weight).cache()
    centers = np.array(start, np.float64) if start is not None else (oversampled_start if oversample else spread_start)(colors, k, seed)
    for _ in range(rounds):
        for row in _step(colors, centers):
            centers[row.c] = [row.l / row.w, row.a / row.w, row.b / row.w]
    colors.unpersist()
    return centers


def grown_palette(px: DataFrame, start: int = 4, most: int = 8, rounds: int = 64, least_gain: float = 0.01, apart: float = 0.03, seed: int = 1, weight: Column | None = None, centers: np.ndarray | None = None) -> np.ndarray:
    """Greedy growth: the cluster of the worst error per cell gives a new center at its weighted mean, both are refined on all
    colors, the error is taken, and close centers are pushed apart; ends when the mean gain of the last five steps falls below
    ``least_gain``.

    ``weight``: importance of a cell.  The worst cluster is looked for with the colors still dealt to the centers as they were before
    the push, and errors measured to where they are after it.  ``centers``: to begin with, in place of a drawn start."""
    colors = counted_colors(px, weight).cache()
    centers = spread_start(colors, start, seed) if centers is None else np.array(centers, np.float64)
    dealt, before, gains = centers, None, []
    for _ in range(rounds):
        if len(centers) >= most:
            break
        rows = _step(colors, dealt, centers)
        worst = max(rows, key=lambda r: (r.err / r.n, -r.c))
        centers = np.vstack([centers, [worst.l / worst.w, worst.a / worst.w, worst.b / worst.w]])
        two = centers[[worst.c, len(centers) - 1]]
        for row in _step(colors, two):
            centers[[worst.c, len(centers) - 1][row.c]] = [row.l / row.w, row.a / row.w, row.b / row.w]
        dealt = centers.copy()
        error = sum(r.err for r in _step(colors, dealt))
        centers = pushed_apart(centers, apart)
        gains.append(1.0 if before is None else before - error)
        before = error
        if np.mean(gains[-5:]) < least_gain:
            break
    colors.unpersist()
    return centers


def pushed_apart(centers: np.ndarray, least: float, sweeps: int = 5) -> np.ndarray:
    """Pairs nearer than ``least`` (OKLab units) move apart along their line."""
    c = centers.copy()
    for _ in range(sweeps):
        moved = False
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                d = float(np.linalg.norm(c[i] - c[j]))
                if 1e-6 < d < least:
                    step = (c[i] - c[j]) * min(0.5, (least - d) / least) * 0.5
                    c[i], c[j], moved = c[i] + step, c[j] - step, True
        if not moved:
            break
    return c


def merged_colors(palette: list[tuple[int, int, int]], least: float = 0.02) -> list[tuple[int, int, int]]:
    """First-come representatives in OKLab; each becomes the mean of those that joined it."""
    groups: list[list[tuple[int, int, int]]] = []
    for c in palette:
        lab = to_oklab(np.array(c, float))
        home = next((g for g in groups if np.linalg.norm(to_oklab(np.array(g[0], float)) - lab) < least), None)
        if home is None:
            groups.append([c])
        else:
            home.append(c)
    return [tuple(int(sum(v) / len(g)) for v in zip(*g, strict=True)) for g in groups]


def merged_palette(palette: DataFrame, least: float = 0.02) -> DataFrame:
    """``merged_colors`` of palette(idx, r, g, b) in rounds of joins: (home, size, r, g, b), home being the idx of the
    representative that came first.

    A color is a representative if none before it within ``least`` (OKLab) is one.  Each round decides all colors whose nearer
    ones before are decided; the rounds are as many as the longest chain of such colors.  Pairs within ``least`` come
    from an equi-join on cells of that size.

    Equal colors are one, of the first's idx, counted: what comes later of them joins the representative that the first joined, or is."""
    lab = C.oklab(F.col("r"), F.col("g"), F.col("b"), True)
    colors = stored(palette.groupBy("r", "g", "b").agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n")), "merge-colors")
    p = colors.select("idx", "r", "g", "b").withColumns(dict(zip(("l", "a", "o"), lab, strict=True)))
    cells = [F.floor(F.col(k) / least).cast("bigint") for k in ("l", "a", "o")]
    own = p.select("idx", "l", "a", "o", *(c.alias(f"c{i}") for i, c in enumerate(cells)))
    for i in range(3):
        own = own.withColumn(f"c{i}", F.explode(F.sequence(F.col(f"c{i}") - 1, F.col(f"c{i}") + 1)))
    before = p.select(F.col("idx").alias("j"), F.col("l").alias("pl"), F.col("a").alias("pa"), F.col("o").alias("po"), *(c.alias(f"c{i}") for i, c in enumerate(cells)))
    far = F.sqrt((F.col("l") - F.col("pl")) ** 2 + (F.col("a") - F.col("pa")) ** 2 + (F.col("o") - F.col("po")) ** 2)
    near = stored(own.join(before, ["c0", "c1", "c2"]).where((F.col("j") < F.col("idx")) & (far < least)).select(F.col("idx").alias("i"), "j"), "merge-near")
    open_, heads = p.select("idx"), None
    while open_.limit(1).count():
        # colors with an open one or a representative before them can't be representatives now
        new = stored(open_.join(near.join(open_.withColumnRenamed("idx", "j"), "j", "left_semi"), F.col("idx") == F.col("i"), "left_anti"), "merge-heads")
        heads = new if heads is None else heads.unionByName(new)
        joined = near.join(new.withColumnRenamed("idx", "j"), "j", "left_semi").select(F.col("i").alias("idx"))
        open_ = stored(open_.join(new, "idx", "left_anti").join(joined, "idx", "left_anti"), "merge-open")
    if heads is None:
        heads = open_
    homes = near.join(heads.withColumnRenamed("idx", "j"), "j", "left_semi").groupBy(F.col("i").alias("idx")).agg(F.min("j").alias("home"))
    homes = homes.join(heads, "idx", "left_anti").unionByName(heads.withColumn("home", F.col("idx")))
    whole = [F.floor(F.sum(F.col(c) * F.col("n")) / F.sum("n")).cast("int").alias(c) for c in ("r", "g", "b")]
    return colors.join(homes, "idx").groupBy("home").agg(F.sum("n").alias("size"), *whole)


def smart_symbols(threads: list[tuple[str, float, int]], dense: str, open_: str, cross: str, rest: str) -> dict[str, str]:
    """threads: (code, luma 0..1, count).  By falling count, light cells get dense glyphs first, dark
    cells open ones, others crossed ones; the first unused is taken."""
    used: set[str] = set()
    out = {}
    for code, luma, _ in sorted(threads, key=lambda t: -t[2]):
        order = dense + cross + open_ if luma >= 0.70 else open_ + cross + dense if luma <= 0.35 else cross + dense + open_
        out[code] = next((s for s in order + rest if s not in used), "?")
        used.add(out[code])
    return out


def unique_symbols(symbols: list[str], pool: str) -> list[str]:
    """First occurrences keep their symbol, later ones take the first free of ``pool``."""
    seen: set[str] = set()
    out = []
    for s in symbols:
        new = s if s not in seen else next((p for p in pool if p not in seen and p not in symbols), s)
        seen.add(new)
        out.append(new)
    return out


def set_symbol(symbols: dict[str, str], code: str, symbol: str, pool: str) -> dict[str, str]:
    """``code`` gets ``symbol``; whoever had it gets a free one."""
    out = dict(symbols)
    for other, s in symbols.items():
        if other != code and s == symbol:
            out[other] = next((p for p in pool if p != symbol and p not in out.values()), "?")
    out[code] = symbol
    return out
