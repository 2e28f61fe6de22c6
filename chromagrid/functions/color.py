"""Color and numeric scalar functions as Columns.

Channels are integers 0..255 unless a name says ``unit`` (0..1).  Everything stays
in built-in expressions, so that whole-stage code generation covers it.  Matrices and
constants of color spaces are fixed values.  Nulls give nulls.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: linear sRGB -> LMS and LMS' -> OKLab, and their inverses
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OK = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OK_BACK = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_BACK = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
# fixed values: linear sRGB -> XYZ (D65) and its white point
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)

Triple = tuple[Column, Column, Column]


def _lit(x: float) -> Column:
    return F.lit(float(x))


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(_lit(lo), F.least(_lit(hi), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def half_up(x: Column) -> Column:
    """Nearest integer, halves upwards (also below zero)."""
    return F.floor(x + 0.5)


def byte(unit: Column) -> Column:
    """0..1 to 0..255."""
    return F.floor(clamp(unit, 0, 1) * 255 + 0.5).cast("int")


def times(m: tuple, v: Triple) -> Triple:
    return tuple(reduce(lambda a, b: a + b, (_lit(k) * x for k, x in zip(row, v, strict=True))) for row in m)


def pack_argb(r: Column, g: Column, b: Column, a: Column | None = None) -> Column:
    """Signed 32-bit ARGB."""
    top = F.shiftleft((a if a is not None else F.lit(255)).cast("int"), 24)
    return top.bitwiseOR(F.shiftleft(r.cast("int"), 16)).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpack_argb(c: Column) -> tuple[Column, Column, Column, Column]:
    """a, r, g, b of a signed 32-bit ARGB."""
    return tuple(F.shiftrightunsigned(c.cast("int"), s).bitwiseAND(F.lit(255)) for s in (24, 16, 8, 0))


def linear(unit: Column) -> Column:
    return F.when(unit <= 0.04045, unit / 12.92).otherwise(F.pow((unit + 0.055) / 1.055, _lit(2.4)))


def encoded(lin: Column) -> Column:
    return F.when(lin <= 0.0031308, lin * 12.92).otherwise(1.055 * F.pow(lin, _lit(1 / 2.4)) - 0.055)


def unit(c: Column) -> Column:
    return c / 255.0


def oklab_of_linear(rgb: Triple, clamped: bool = False) -> Triple:
    root = lambda x: F.cbrt(F.greatest(x, _lit(0)) if clamped else x)
    return times(OK, tuple(root(x) for x in times(LMS, rgb)))


def oklab(r: Column, g: Column, b: Column, clamped: bool = False) -> Triple:
    return oklab_of_linear(tuple(linear(unit(c)) for c in (r, g, b)), clamped)


def linear_of_oklab(lab: Triple) -> Triple:
    return times(LMS_BACK, tuple(x * x * x for x in times(OK_BACK, lab)))


def rgb_of_oklab(lab: Triple) -> Triple:
    return tuple(byte(encoded(clamp(x, 0, 1))) for x in linear_of_oklab(lab))


def cielab(r: Column, g: Column, b: Column) -> Triple:
    edge = 6.0 / 29.0

    def f(t: Column) -> Column:
        return F.when(t > edge**3, F.pow(t, _lit(1 / 3))).otherwise(t / (3 * edge * edge) + 4.0 / 29.0)

    x, y, z = (f(v / w) for v, w in zip(times(XYZ, tuple(linear(unit(c)) for c in (r, g, b))), WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def squared(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return reduce(lambda a, b: a + b, ((x - y) * (x - y) for x, y in zip(p, q, strict=True)))


def distance(p: tuple[Column, ...], q: tuple[Column, ...]) -> Column:
    return F.sqrt(squared(p, q))


def ciede2000(p: Triple, q: Triple) -> Column:
    (l1, a1, b1), (l2, a2, b2) = p, q
    pi = 3.141592653589793
    c7 = lambda c: F.pow(c, _lit(7)) / (F.pow(c, _lit(7)) + 25.0**7)
    mean = (F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2.0
    g = 1.5 - 0.5 * F.sqrt(c7(mean))
    a1, a2 = a1 * g, a2 * g
    c1, c2 = F.sqrt(a1 * a1 + b1 * b1), F.sqrt(a2 * a2 + b2 * b2)
    turn = lambda h: F.when(h < 0, h + 2 * pi).otherwise(h)
    h1, h2 = turn(F.atan2(b1, a1)), turn(F.atan2(b2, a2))
    gray, d = c1 * c2 == 0, h2 - h1
    dh = F.when(gray, 0.0).when(F.abs(d) <= pi, d).when(d > pi, d - 2 * pi).otherwise(d + 2 * pi)
    big = 2.0 * F.sqrt(c1 * c2) * F.sin(dh / 2.0)
    s = h1 + h2
    bar = F.when(gray, s).when(F.abs(d) <= pi, s / 2).when(s < 2 * pi, (s + 2 * pi) / 2).otherwise((s - 2 * pi) / 2)
    rad = pi / 180
    t = 1 - 0.17 * F.cos(bar - 30 * rad) + 0.24 * F.cos(2 * bar) + 0.32 * F.cos(3 * bar + 6 * rad) - 0.20 * F.cos(4 * bar - 63 * rad)
    lm, cm = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    x = (bar / rad - 275) / 25
    sl = (l2 - l1) / (1 + 0.015 * lm * lm / F.sqrt(20 + lm * lm))
    sc = (c2 - c1) / (1 + 0.045 * cm)
    sh = big / (1 + 0.015 * cm * t)
    return F.sqrt(F.greatest(_lit(0), sl * sl + sc * sc + sh * sh - F.sin(60 * rad * F.exp(-x * x)) * 2 * F.sqrt(c7(cm)) * sc * sh))


def hsv(r: Column, g: Column, b: Column, least: float = 1e-6) -> Triple:
    """Of 0..1 channels; hue 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d = top - low
    hue = F.when(d <= least, 0.0).when(top == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return hue / 6.0, F.when(top <= 1e-6, 0.0).otherwise(d / top), top


def rgb_of_hsv(h: Column, s: Column, v: Column) -> Triple:
    i = F.floor(h * 6)
    f, six = h * 6 - i, F.pmod(i, F.lit(6))
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))

    def pick(*six_values: Column) -> Column:
        out = F.when(six == 0, six_values[0])
        for k in range(1, 5):
            out = out.when(six == k, six_values[k])
        return out.otherwise(six_values[5])

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def luma709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def luma709_int(r: Column, g: Column, b: Column) -> Column:
    return F.floor(luma709(r, g, b)).cast("int")


def luma601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def ycbcr(r: Column, g: Column, b: Column) -> Triple:
    fit = lambda x: clamp(half_up(x).cast("double"), 0, 255).cast("int")
    return luma601(r, g, b), fit(-0.168736 * r - 0.331264 * g + 0.5 * b + 128), fit(0.5 * r - 0.418688 * g - 0.081312 * b + 128)


def pq_to_linear(v: Column, nits: float = 203.0) -> Column:
    m1, m2, c1, c2, c3 = 2610 / 16384, 2523 / 32, 3424 / 4096, 2413 / 128, 2392 / 128
    p = F.pow(F.greatest(v, _lit(0)), _lit(1 / m2))
    return F.pow(F.greatest(p - c1, _lit(0)) / (c2 - c3 * p), _lit(1 / m1)) * (10000.0 / nits)


def hlg_to_linear(v: Column) -> Column:
    import math

    a = 0.17883277
    b, c = 1 - 4 * a, 0.5 - a * math.log(4 * a)
    return F.when(v <= 0.5, v * v / 3.0).otherwise((F.exp((v - c) / a) + b) / 12.0)


def soft_knee(v: Column, headroom: float = 3.0) -> Column:
    return F.when(v <= 1, v).otherwise(1 + (v - 1) / (1 + (v - 1) / headroom))


def tonemapped(v: Column, space: Column, headroom: float = 3.0) -> tuple[Column, Column]:
    """(value, applied): only HDR color spaces are touched."""
    hdr = space.isin("BT2020_PQ", "BT2020_HLG")
    return F.when(hdr, clamp(soft_knee(v, headroom), 0, 1)).otherwise(v), hdr


#: fixed values of the curve of BT.2020 (and, rounded, BT.709): factor, slope and exponent.
BT2020 = (1.09929682680944, 4.5, 0.45, 0.0181053951)


def decoded_by(curve: str | float, c: Column) -> Column:
    """A unit channel as linear light.  ``curve``: srgb, bt2020, linear, or the exponent of a power curve."""
    if curve == "srgb":
        return linear(c)
    if curve == "linear":
        return c
    if curve == "bt2020":
        a, slope, power, knee = BT2020
        return F.when(c < knee * slope, c / slope).otherwise(F.pow((c + (a - 1)) / a, F.lit(1 / power)))
    return F.pow(F.greatest(c, _lit(0)), F.lit(float(curve)))


def linear_plane(rgb: Triple, gamut: tuple | None = None, decoded: bool = False, curve: str | float = "srgb") -> Triple:
    """Unit channels as linear sRGB: the transfer curve is undone unless ``decoded``, then ``gamut``, a
    3 x 3 matrix from the primaries of the source, is applied."""
    lin = rgb if decoded else tuple(decoded_by(curve, c) for c in rgb)
    return lin if gamut is None else times(gamut, lin)


def tonemapped_plane(rgb: Triple, alpha: Column, space: Column, premultiplied: bool = True, headroom: float = 3.0) -> tuple[Triple, Column]:
    """(channels, applied) of linear channels: in HDR color spaces the knee works on values freed from
    alpha, which is put on again."""
    a, hdr = clamp(alpha, 0, 1), F.coalesce(space.isin("BT2020_PQ", "BT2020_HLG"), F.lit(False))
    free = lambda c: F.when(a > 1e-6, c / a).otherwise(c) if premultiplied else c
    toned = lambda c: F.greatest(_lit(0), soft_knee(free(c), headroom))
    back = lambda c: clamp(toned(c) * a if premultiplied else toned(c), 0, 1)
    return tuple(F.when(hdr, back(c)).otherwise(c) for c in rgb), hdr


def brightness_contrast(c: Column, brightness: float, contrast: float) -> Column:
    """Both in percent, -100 to 100."""
    k = 259.0 * (contrast + 255.0) / (255.0 * (259.0 - contrast))
    return clamp(half_up((c - 128.0) * k + 128.0 + brightness / 100.0 * 255.0).cast("double"), 0, 255).cast("int")


def gamma_corrected(c: Column, gamma: float) -> Column:
    g = min(3.0, max(0.1, gamma))
    return clamp(half_up(F.pow(c / 255.0, _lit(1 / g)) * 255.0).cast("double"), 0, 255).cast("int")


def compressed(c: Column, strength: float) -> Column:
    """Towards the middle gray."""
    return clamp(half_up(c + (128.0 - c) * strength).cast("double"), 0, 255).cast("int")


def code15(r: Column, g: Column, b: Column) -> Column:
    five = lambda c: F.shiftright(c.cast("int"), 3)
    return F.shiftleft(five(r), 10).bitwiseOR(F.shiftleft(five(g), 5)).bitwiseOR(five(b))


def mean_byte(a: Column, b: Column) -> Column:
    return F.floor((a + b) / 2).cast("int")


def hex_of(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def rgb_of_hex(h: Column) -> Triple:
    s = F.regexp_replace(F.trim(h), "^#", "")
    part = lambda i: F.conv(F.substring(s, i, 2), 16, 10).cast("int")
    ok = s.rlike("^[0-9A-Fa-f]{6}$")
    return tuple(F.when(ok, part(i)) for i in (1, 3, 5))


def round2(x: Column) -> Column:
    return half_up(x * 100.0) / 100.0


def grid_size(w: Column, h: Column, aspect: Column, mode: Column, keep: Column) -> tuple[Column, Column]:
    """Target grid from wanted sizes: BY_HEIGHT keeps h, BY_WIDTH and BY_DPI keep w; the other follows
    the aspect if ``keep``."""
    tall = mode == "BY_HEIGHT"
    w, h = F.greatest(F.lit(1), w), F.greatest(F.lit(1), h)
    new_w, new_h = F.greatest(F.lit(1), half_up(h * aspect).cast("int")), F.greatest(F.lit(1), half_up(w / aspect).cast("int"))
    return F.when(keep & tall, new_w).otherwise(w), F.when(keep & ~tall, new_h).otherwise(h)


def physical_cm(stitches: Column, density: Column) -> Column:
    return stitches / F.greatest(F.lit(1.0), density.cast("double")) * 2.54


def thread_metres(count: Column, fabric: Column, strands: Column, waste: Column) -> Column:
    return count * 2.8 * (25.4 / fabric) * strands * (1 + waste / 100.0) / 1000.0


def downscale(src_w: Column, grid_w: Column, k_sigma: float) -> tuple[Column, Column]:
    r = F.when(grid_w.isNull(), 1.25).otherwise(src_w / F.greatest(F.lit(1), grid_w))
    return r, k_sigma * F.greatest(_lit(0), r - 1)


def importance(edge: Column, skin: Column, sky: Column, texture: Column, flat: Column) -> Column:
    w = lambda c, k: F.when(c, k).otherwise(1.0)
    return w(edge, 1.3) * w(skin, 1.6) * w(sky, 1.2) * w(texture, 1.2) * w(flat, 0.9)


def symbol_ink(r: Column, g: Column, b: Column) -> Column:
    return F.when(luma601(r, g, b) > 140, "black").otherwise("white")


def pale(c: Column) -> Column:
    return F.floor((c + 255) / 2).cast("int")


def blended(base: Column, over: Column, alpha: Column, strength: float) -> Column:
    return clamp(base + half_up((over - base) * alpha / 255.0 * strength), 0, 255).cast("int")


def mix3(orig: Column, at_edge: Column, at_flat: Column, edge: Column, flat: Column) -> Column:
    return clamp(F.when(flat, at_flat).when(edge, 0.5 * orig + 0.5 * at_edge).otherwise(0.5 * orig + 0.25 * at_flat + 0.25 * at_edge), 0, 1)


def icc_confident(space: Column) -> Column:
    """False where the color space is unknown, sRGB or linear sRGB."""
    return ~F.coalesce(space, F.lit("SRGB")).isin("SRGB", "LINEAR_SRGB")
