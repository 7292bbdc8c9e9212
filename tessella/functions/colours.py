"""Colour algebra as column expressions: CSS colours to hex, hue, distance; and logo quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names taken for brand colours.
NAMED = {
    "black": "#000000", "white": "#ffffff", "red": "#ff0000", "green": "#008000", "blue": "#0000ff", "yellow": "#ffff00", "orange": "#ffa500", "purple": "#800080", "pink": "#ffc0cb", "gray": "#808080",
    "grey": "#808080", "cyan": "#00ffff", "magenta": "#ff00ff", "teal": "#008080", "navy": "#000080", "maroon": "#800000", "silver": "#c0c0c0", "gold": "#ffd700", "indigo": "#4b0082", "violet": "#ee82ee",
}
_NUM = r"([+-]?(?:\d+\.?\d*|\.\d+))"
_SEP = r"\s*[,\s]\s*"
RGB = rf"^rgba?\(\s*{_NUM}(%?){_SEP}{_NUM}(%?){_SEP}{_NUM}(%?)\s*(?:[,/]\s*{_NUM}(%?)\s*)?\)$"
HSL = rf"^hsla?\(\s*{_NUM}(?:deg)?{_SEP}{_NUM}%{_SEP}{_NUM}%\s*(?:[,/]\s*{_NUM}(%?)\s*)?\)$"


def let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with the value worked out once, and its expression written once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"), a.cast("double").alias("a"))


def hex_rgba(c: Column) -> Column:
    """CO1: #rgb, #rgba, #rrggbb or #rrggbbaa; null otherwise."""

    def full(h: Column) -> Column:
        part = lambda i: F.conv(F.substring(h, i, 2), 16, 10).cast("int")
        ok = h.rlike("^([0-9a-f]{6}|[0-9a-f]{8})$")
        return F.when(ok, _rgba(part(1), part(3), part(5), F.when(F.length(h) == 8, part(7) / 255).otherwise(1.0)))

    short = lambda h: F.when(F.length(h).isin(3, 4), F.regexp_replace(h, "(.)", "$1$1")).otherwise(h)
    return let(let(F.lower(F.regexp_replace(F.trim(c), "^#", "")), short), full)


def _alpha(s: Column, pattern: str, at: int) -> Column:
    n = F.regexp_extract(s, pattern, at).try_cast("double")
    return _clamp(F.coalesce(F.when(F.regexp_extract(s, pattern, at + 1) == "%", n / 100).otherwise(n), F.lit(1.0)), 0.0, 1.0)


def rgb_rgba(c: Column) -> Column:
    """CO2: rgb() and rgba(), with commas or blanks, percent channels, and alpha after a comma or slash."""

    def read(s: Column) -> Column:
        def channel(i: int) -> Column:
            n = F.regexp_extract(s, RGB, i).try_cast("double")
            return F.round(_clamp(F.when(F.regexp_extract(s, RGB, i + 1) == "%", n * 255 / 100).otherwise(n), 0.0, 255.0))

        return F.when(s.rlike(RGB), _rgba(channel(1), channel(3), channel(5), _alpha(s, RGB, 7)))

    return let(F.lower(F.trim(c)), read)


def hsl_rgba(c: Column) -> Column:
    """CO3: hsl() and hsla()."""

    def read(s: Column) -> Column:
        def mixed(x: Column) -> Column:
            def channel(n: int) -> Column:
                return let(F.pmod(n + x.h / 30, F.lit(12.0)), lambda k: F.round(255 * (x.l - x.reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))))))

            return _rgba(channel(0), channel(8), channel(4), x.a)

        part = lambda i: _clamp(F.regexp_extract(s, HSL, i).try_cast("double") / 100, 0.0, 1.0)
        h = F.pmod(F.regexp_extract(s, HSL, 1).try_cast("double"), F.lit(360.0))
        return F.when(s.rlike(HSL), let(F.struct(h.alias("h"), part(3).alias("l"), (part(2) * F.least(part(3), 1 - part(3))).alias("reach"), _alpha(s, HSL, 4).alias("a")), mixed))

    return let(F.lower(F.trim(c)), read)


def parse_colour(c: Column) -> Column:
    """CO4: struct(r, g, b, a) of a CSS colour; keywords, var(), gradients and url() give null."""

    def read(s: Column) -> Column:
        named = F.try_element_at(F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv)), s)
        return F.coalesce(hex_rgba(F.when(s.startswith("#"), s).otherwise(named)), rgb_rgba(s), hsl_rgba(s))

    return let(F.lower(F.trim(c)), read)


def to_hex(rgba: Column) -> Column:
    two = lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")
    return F.concat(F.lit("#"), two(rgba.r), two(rgba.g), two(rgba.b))


def normalise(c: Column) -> Column:
    """CO5: six-digit lower-case hex; null for what is no colour or nearly transparent."""
    rgba = parse_colour(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\s*!important\s*$", ""))
    return let(rgba, lambda x: F.when(x.a >= 0.1, to_hex(x)))


def hsl(rgba: Column) -> Column:
    """CO6: struct(h in degrees, s, l)."""

    def ranged(x: Column) -> Column:
        return F.struct(x.r.alias("r"), x.g.alias("g"), x.b.alias("b"), F.greatest(x.r, x.g, x.b).alias("top"), F.least(x.r, x.g, x.b).alias("low"))

    def read(x: Column) -> Column:
        d, light = x.top - x.low, (x.top + x.low) / 2
        sat = F.when(d == 0, 0.0).otherwise(d / F.when(light > 0.5, 2 - x.top - x.low).otherwise(x.top + x.low))
        hue = F.when(d == 0, 0.0).when(x.top == x.r, (x.g - x.b) / d + F.when(x.g < x.b, 6).otherwise(0)).when(x.top == x.g, (x.b - x.r) / d + 2).otherwise((x.r - x.g) / d + 4) * 60
        return F.struct(hue.alias("h"), sat.alias("s"), light.alias("l"))

    scaled = lambda c: F.struct(*((c[n] / 255.0).alias(n) for n in "rgb"))
    return let(let(let(rgba, scaled), ranged), read)


def distance(a: Column, b: Column) -> Column:
    """CO7: between two rgba structs."""
    return F.sqrt(sum(((a[x] - b[x]) * (a[x] - b[x]) for x in "gb"), (a.r - b.r) * (a.r - b.r)).cast("double"))


def hue_distance(a: Column, b: Column) -> Column:
    """CO8: degrees between the hues of two hex colours, 180 at most."""
    return let(F.pmod(F.abs(hsl(hex_rgba(a)).h - hsl(hex_rgba(b)).h), F.lit(360.0)), lambda d: F.when(d > 180, 360 - d).otherwise(d))


def neutral(c: Column) -> Column:
    """PR11: of an hsl struct."""
    return let(c, lambda x: (x.l > 0.93) | (x.l < 0.07) | (x.s < 0.12))


def logo_quality(url: Column, kind: Column, ok: Column, size: Column, content_type: Column) -> Column:
    """CO9: what a probe of a logo's address says about it, as a factor."""
    live = F.coalesce(ok, F.lit(False))
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    band = F.when(size.isNull(), 1.0).when(size < 300, 0.3).when(size < 1000, 0.7).when(size <= 500_000, 1.25).when(size <= 2_000_000, 0.9).otherwise(0.5)
    form = F.when(ct.contains("svg"), 1.3).when(ct.contains("png") | ct.contains("webp"), 1.15).when(ct.contains("x-icon") | ct.contains("vnd.microsoft.icon"), 0.6).otherwise(1.0)
    return (
        F.when(url.startswith("data:"), 1.3).when(F.coalesce(kind == "svg", F.lit(False)), F.when(live, 1.3).otherwise(0.85)).when(~live, 0.85)
        .when((ct != "") & ~ct.startswith("image/"), 0.2).otherwise(band * form)
    )
