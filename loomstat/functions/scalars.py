"""Scalar expressions: keys, formats, ratios, colours, vectors. All are Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = r"^(.+)_s(\d*)_seed(\d+)$"


def key_parts(name: Column) -> dict[str, Column]:
    """content, style (null where empty) and seed of ``<content>_s<style>_seed<seed>``; all null without a match."""
    part = lambda i: F.nullif(F.regexp_extract(name, KEY, i), F.lit(""))
    return {"content": part(1), "style": part(2).cast("int"), "seed": part(3).cast("int")}


def content_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(_s\d*)?_seed\d+(\.\w+)?$", "")


def from_end(path: Column, back: int, sep: str = "/") -> Column:
    return F.try_element_at(F.split(path, sep), F.lit(-back))


def spaced_lower(camel: Column) -> Column:
    return F.lower(F.regexp_replace(camel, r"(?<!^)(?=[A-Z])", " "))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The name given for a value, or the value itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[value], value)


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts], F.lit(False))


def template(text: str, **values: Column) -> Column:
    """``text`` with each ``{name}`` replaced by a value; null if one of them is."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts)])


def before_dot(path: Column, parts: int) -> Column:
    """The first ``parts`` parts of a dotted path."""
    return F.substring_index(path, ".", parts)


def bits_over_median(v: Column) -> Column:
    """64 bits of 64 numbers: which are over their median (the mean of the middle two)."""
    s = F.array_sort(v)
    middle = (F.get(s, F.lit(31)) + F.get(s, F.lit(32))) / 2
    held = F.struct(v.alias("v"), middle.alias("m"))
    bit = lambda h: F.aggregate(h["v"], F.struct(F.lit(0).cast("long").alias("b")), lambda acc, x: F.struct(F.shiftleft(acc["b"], 1).bitwiseOR((x > h["m"]).cast("long")).alias("b")))["b"]
    return F.get(F.transform(F.array(held), bit), F.lit(0))


def safe_ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def p_text(p: Column) -> Column:
    return F.when(p.isNull(), "--").when(p < 0.001, "$<$0.001").otherwise(F.format_string("%.3f", F.bround(p, 3)))


def number_text(x: Column, places: int, signed: bool = False) -> Column:
    """``x`` to ``places``, half to even, ``--`` where it is missing."""
    return F.when(x.isNull(), "--").otherwise(F.format_string(f"%{'+' if signed else ''}.{places}f", F.bround(x, places)))


def hex_rgb(code: Column) -> list[Column]:
    return [F.conv(F.substring(code, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c), 2, "0")) for c in (r, g, b)])


def rgb_hsv(r: Column, g: Column, b: Column) -> list[Column]:
    """Hue, saturation and value in 0 to 1, of channels in 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(r == top, (g - b) / span).when(g == top, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    hue = F.when(span == 0, 0.0).otherwise(sector / 6.0 - F.floor(sector / 6.0))
    return [hue, F.when(top == 0, 0.0).otherwise(span / top), top]


# The sRGB to XYZ (D65) matrix and the D65 white point.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.95047, 1.0, 1.08883)


def rgb_lab(r: Column, g: Column, b: Column) -> list[Column]:
    """CIELAB of sRGB channels in 0 to 1."""
    linear = [F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, 2.4)).otherwise(c / 12.92) for c in (r, g, b)]
    ratios = [sum((c * k for c, k in zip(linear, row, strict=True)), F.lit(0.0)) / w for row, w in zip(XYZ, WHITE, strict=True)]
    x, y, z = (F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0) for t in ratios)
    return [116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)]


#: The inverse of ``XYZ``, as published.
RGB = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875992, 0.041556), (0.055648, -0.204043, 1.057311))


def lab_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """sRGB channels of CIELAB as whole numbers from 0 to 255, the nearest that there are."""
    y = (l + 16.0) / 116.0
    ratios = [a / 500.0 + y, y, y - b / 200.0]
    x, y, z = (F.when(t > 0.2068966, t * t * t).otherwise((t - 16.0 / 116.0) / 7.787) * w for t, w in zip(ratios, WHITE, strict=True))
    linear = [x * row[0] + y * row[1] + z * row[2] for row in RGB]
    coded = [F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055).otherwise(12.92 * c) for c in linear]
    return [F.round(255 * F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))).cast("int") for c in coded]


def with_ciede2000(df: DataFrame, one: tuple[Column, Column, Column], two: tuple[Column, Column, Column], name: str) -> DataFrame:
    """Add ``name``, the CIEDE2000 difference of two Lab colours, by its published formula with unit weights.

    Made in steps of columns: as one expression, what is used several times would be repeated in the plan.
    """
    c = lambda x: F.col(f"_e_{x}")
    seventh = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + 25.0**7))
    angle = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))
    wave = lambda k, off: F.cos(F.radians(k * c("mh") + off))
    steps = [
        {k: x for k, x in zip(("l1", "a1", "b1", "l2", "a2", "b2"), (*one, *two), strict=True)},
        {"mc": (F.hypot(c("a1"), c("b1")) + F.hypot(c("a2"), c("b2"))) / 2},
        {"s": 1 + 0.5 * (1 - seventh(c("mc")))},
        {"a1": c("a1") * c("s"), "a2": c("a2") * c("s")},
        {"c1": F.hypot(c("a1"), c("b1")), "c2": F.hypot(c("a2"), c("b2")), "h1": angle(c("a1"), c("b1")), "h2": angle(c("a2"), c("b2"))},
        {"gap": c("h2") - c("h1"), "sum": c("h1") + c("h2"), "grey": c("c1") * c("c2") == 0, "ml": (c("l1") + c("l2")) / 2, "mc": (c("c1") + c("c2")) / 2},
        {
            "turn": F.when(c("grey"), 0.0).when(F.abs(c("gap")) <= 180, c("gap")).when(c("gap") > 180, c("gap") - 360).otherwise(c("gap") + 360),
            "mh": F.when(c("grey"), c("sum")).when(F.abs(c("gap")) <= 180, c("sum") / 2).when(c("sum") < 360, (c("sum") + 360) / 2).otherwise((c("sum") - 360) / 2),
        },
        {"t": 1 - 0.17 * wave(1, -30) + 0.24 * wave(2, 0) + 0.32 * wave(3, 6) - 0.20 * wave(4, -63)},
        {
            "dl": (c("l2") - c("l1")) / (1 + 0.015 * F.pow(c("ml") - 50, F.lit(2.0)) / F.sqrt(20 + F.pow(c("ml") - 50, F.lit(2.0)))),
            "dc": (c("c2") - c("c1")) / (1 + 0.045 * c("mc")),
            "dh": 2 * F.sqrt(c("c1") * c("c2")) * F.sin(F.radians(c("turn")) / 2) / (1 + 0.015 * c("mc") * c("t")),
            "rt": -F.sin(F.radians(60 * F.exp(-F.pow((c("mh") - 275) / 25, F.lit(2.0))))) * 2 * seventh(c("mc")),
        },
    ]
    names = list(df.columns)
    for step in steps:
        df = df.withColumns({f"_e_{k}": x for k, x in step.items()})
    total = F.sqrt(F.pow(c("dl"), F.lit(2.0)) + F.pow(c("dc"), F.lit(2.0)) + F.pow(c("dh"), F.lit(2.0)) + c("rt") * c("dc") * c("dh"))
    return df.select(*[n for n in names if n != name], total.alias(name))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` by its length, which is an outer lambda's variable: inside of the inner one it would be taken once for each place."""
    return F.transform(F.array(norm(a)), lambda length: F.transform(a, lambda x: x.cast("double") / length))[0]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2.0)), F.lit(0.0), lambda s, x: s + x))


def bits_of_difference(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mixed_int(*keys: Column, modulus: int = 2147483647) -> Column:
    """A deterministic hash of integers in 0..modulus-1 by integer arithmetic only, the same in any SQL engine."""
    h = F.lit(12345).cast("long")
    for k in keys:
        h = F.pmod((h + F.pmod(k.cast("long"), F.lit(modulus)) + 1) * 48271, F.lit(modulus).cast("long"))
        h = F.pmod(h * 69621 + 7, F.lit(modulus).cast("long"))
    return h


def under_root(path: Column) -> Column:
    """Whether a relative path stays under its root: not absolute, no drive, no step up that leaves it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, p: F.struct((s.d + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("d"), (s.ok & ((p != "..") | (s.d > 0))).alias("ok")))
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & depth.ok & (F.length(path) > 0)


