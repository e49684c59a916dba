"""Column functions: days, codes, harmonic terms, angles."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotile.schema import CLEAR, CLOUD, FILL, LAUNCH, NO_DATA, ORDINAL, SHADOW, SNOW, WATER

W = 2 * pi / 365.25


def ordinal(day: Column) -> Column:
    return F.unix_date(day.cast("date")) + ORDINAL


def from_ordinal(n: Column) -> Column:
    return F.date_from_unix_date((n - ORDINAL).cast("int"))


def since_launch(n: Column) -> Column:
    return (n - LAUNCH).cast("smallint")


def scene_name(prefix: str, n: Column) -> Column:
    """prefix_ordinal_yeardoy"""
    day = from_ordinal(n)
    return F.concat(F.lit(prefix + "_"), n.cast("string"), F.lit("_"), F.year(day).cast("string"), F.lpad(F.dayofyear(day).cast("string"), 3, "0"))


def _bit(word: Column, k: int) -> Column:
    return F.shiftright(word.cast("int"), k).bitwiseAND(F.lit(1)) == 1


def _decoded(word: Column, rules: list[tuple[int, int]], default: int) -> Column:
    """The code of the last rule (bit, code) that holds."""
    out = None
    for k, code in reversed(rules):
        out = F.when(_bit(word, k), code) if out is None else out.when(_bit(word, k), code)
    return out.otherwise(default)


def qa_c1(word: Column) -> Column:
    """Collection 1 pixel quality: later rules win (cloud over shadow over snow over water over clear)."""
    return _decoded(word, [(1, CLEAR), (2, WATER), (4, SNOW), (3, SHADOW), (5, CLOUD)], FILL)


def qa_c2(word: Column) -> Column:
    return _decoded(word, [(6, CLEAR), (7, WATER), (5, SNOW), (4, SHADOW), (3, CLOUD), (1, CLOUD)], FILL)


def qa_hls(word: Column) -> Column:
    """Harmonised scenes: no bit is clear, 255 fill; an adjacent pixel counts as cloud."""
    return F.when(word == 255, FILL).otherwise(_decoded(word, [(5, WATER), (4, SNOW), (3, SHADOW), (2, CLOUD), (1, CLOUD)], CLEAR))


def scale_reflectance(v: Column) -> Column:
    """Collection 2 surface reflectance to ten-thousandths, towards zero."""
    return (10000 * (v * 2.75e-5 - 0.2)).cast("smallint")


def scale_temperature(v: Column) -> Column:
    return (10 * (v * 0.00341802 + 149)).cast("smallint")


def thermal_centi(raw: Column, collection2: bool = False) -> Column:
    return F.lit(0) if collection2 else F.when(raw == 0, 0).otherwise(raw * 10 - 27320)


def valid_range(collection2: bool = False) -> Column:
    t = thermal_centi(F.col("thermal"), collection2)
    ok = (F.col("blue") > -200) & (F.col("blue") < 10000) & (t > -9320) & (t < 7070) & (F.col("qa") < 255)
    for b in ("green", "red", "nir", "swir1", "swir2"):
        ok &= (F.col(b) > 0) & (F.col(b) < 10000)
    return ok


def harmonic(coefs: Column, day: Column) -> Column:
    """The prediction of a model of eight coefficients (slope times 10000) for an ordinal day."""
    out = coefs[0] + coefs[1] / 10000.0 * day
    for k in (1, 2, 3):
        out = out + coefs[2 * k] * F.cos(day * (k * W)) + coefs[2 * k + 1] * F.sin(day * (k * W))
    return out


def angle_decay(angle: Column, low: float = 45.0, high: float = 90.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(high) - angle) / (high - low)))


def normalize_clip(x: Column, low: float, high: float) -> Column:
    """To 0..1; no-data stays."""
    if high == low:
        return F.when(x == NO_DATA, F.lit(float(NO_DATA))).otherwise(0.0)
    return F.when(x == NO_DATA, F.lit(float(NO_DATA))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low))))


def angle_between(a: Column, b: Column) -> Column:
    """Degrees between two arrays of numbers."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (na * nb)))))


#: Groups of land-cover codes: developed, crops, forest, grass and shrub, wetland, water, barren.
LAND_COVER = {0: (21, 22, 23, 24), 1: (81, 82), 2: (41, 42, 43), 3: (52, 71), 4: (90, 95), 5: (11,), 6: (31,)}


def land_cover_group(code: Column) -> Column:
    """The group of a land-cover code; NO_DATA for other codes."""
    out = F
    for group, codes in LAND_COVER.items():
        out = out.when(code.isin(*codes), group)
    return out.otherwise(NO_DATA)
