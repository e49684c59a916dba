"""Segments (schema.SEGMENTS): which holds at a day, features, break categories, yearly maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronotile.functions import columns as C
from chronotile.schema import NO_DATA



def order():
    return Window.partitionBy("pos").orderBy("t_start", "seg")


def at_day(segments: DataFrame, days: DataFrame, to_year_end: bool = False) -> DataFrame:
    """Segments joined with the days (day) they hold at: from their start up to the next one's; the last up to its end,
    or to the end of that year. A pixel without a segment at a day has no row."""
    end = F.col("t_end") + 1
    if to_year_end:
        end = C.ordinal(F.make_date(F.year(C.from_ordinal(F.col("t_end"))), F.lit(12), F.lit(31))) + 1
    span = segments.withColumn("t_until", F.coalesce(F.lead("t_start").over(order()), end))
    near = F.broadcast(days)  # a day a year
    return span.join(near, (F.col("day") >= F.col("t_start")) & (F.col("day") < F.col("t_until"))).drop("t_until")


def features(segments: DataFrame, pixels: DataFrame, days: DataFrame, band: int, to_year_end: bool = False) -> DataFrame:
    """A row for each pixel and day: level at the day, slope, six harmonic coefficients, error of a band; NO_DATA where none holds."""
    c = F.col("coefs")[band]
    held = at_day(segments, days, to_year_end).select(
        "pos", "day", (c[0] + c[1] * F.col("day") / 10000.0).alias("a0"), (c[1] / 10000.0).alias("c1"), *[c[k].cast("double").alias(n) for k, n in enumerate(("a1", "b1", "a2", "b2", "a3", "b3"), 2)], F.col("rmse")[band].cast("double").alias("error")
    )
    names = held.columns[2:]
    return pixels.select("pos").crossJoin(F.broadcast(days)).join(held, ["pos", "day"], "left").select("pos", "day", *[F.coalesce(F.nanvl(n, F.lit(0.0)), F.lit(float(NO_DATA))).alias(n) for n in names])


def _greening(bound: int) -> Column:
    m = F.col("magnitude")
    return (m[3] > -bound) & (m[2] < bound) & (m[4] < bound)


def _growing() -> Column:
    """The next segment of the pixel grows: nir slopes up, red and swir1 down, by more than this one's slopes."""
    here, after = F.col("coefs"), F.lead("coefs").over(order())
    return F.coalesce((after[3][1] > F.abs(here[3][1])) & (after[2][1] < -F.abs(here[2][1])) & (after[4][1] < -F.abs(here[4][1])), F.lit(False))


def category(segments: DataFrame, flavour: str = "cold") -> DataFrame:
    """Segments that end in a break, with its kind: 1 disturbance, 2 regrowth, 3 afforestation; for "sccd" 1 and 2 alone."""
    kind = F.when(_greening(200) & _growing(), 3).when(_greening(200), 2).otherwise(1) if flavour == "cold" else F.when(_greening(200), 2).otherwise(1)
    return segments.withColumn("kind", kind).filter("t_break > 0 AND change_prob = 100")


def category_obcold(segments: DataFrame) -> DataFrame:
    """(pos, seg, t_break, kind) as category, where a break within five years of the segment before, after a disturbance,
    that turns four of five bands back is a 4 (transition). The kind depends on that of the pixel's
    break before, so a pixel's segments are folded in order."""
    plain = F.when(_greening(250) & _growing(), 3).when(_greening(250), 2).otherwise(1)
    rows = segments.withColumns({"plain": plain, "before": F.lag("t_break").over(order()), "was": F.lag("magnitude").over(order())}).filter("t_break > 0 AND change_prob = 100")
    flips = F.size(F.filter(F.sequence(F.lit(1), F.lit(5)), lambda b: F.element_at("magnitude", b + 1) * F.element_at("was", b + 1) < 0))
    back = F.coalesce((F.col("t_break") - F.col("before") <= 365.25 * 5) & (flips >= 4), F.lit(False))
    lists = rows.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("t_start", "seg", "t_break", "plain", back.alias("back")))).alias("list"))  # a pixel has a few dozen segments
    fold = """aggregate(list, cast(array() as array<int>), (s, x) -> array_append(s,
        CASE WHEN x.plain = 1 AND x.back AND size(s) > 0 AND get(s, size(s) - 1) = 1 THEN 4 ELSE x.plain END))"""
    return lists.select("pos", F.explode(F.arrays_zip("list", F.expr(fold).alias("kind"))).alias("b")).select("pos", "b.list.seg", "b.list.t_break", "b.kind")


def break_map(kinds: DataFrame) -> DataFrame:
    """By pixel and year kind * 1000 + day of year; of several breaks in a year the last."""
    day = C.from_ordinal(F.col("t_break"))
    rows = kinds.select("pos", "t_break", F.year(day).alias("year"), (F.col("kind") * 1000 + F.dayofyear(day)).alias("value"))
    return rows.groupBy("pos", "year").agg(F.max_by("value", "t_break").alias("value"))


def first_recent(breaks: DataFrame, pixels: DataFrame) -> DataFrame:
    """By pixel the first and the most recent year with a disturbance (kind 1); 0 for none."""
    year = F.when(F.floor(F.col("value") / 1000) == 1, F.col("year"))
    found = breaks.groupBy("pos").agg(F.min(year).alias("first"), F.max(year).alias("recent"))
    return pixels.select("pos").join(found, "pos", "left").select("pos", F.coalesce("first", F.lit(0)).alias("first_year"), F.coalesce("recent", F.lit(0)).alias("recent_year"))


def first_shift(segments: DataFrame, band: int, up: bool) -> DataFrame:
    """By pixel the year of its first break whose magnitude in a band goes up (or down)."""
    m = F.col("magnitude")[band]
    return segments.filter((F.col("t_break") > 0) & ((m > 0) if up else (m < 0))).groupBy("pos").agg(F.year(C.from_ordinal(F.min("t_break"))).alias("year"))


def angles(vectors: DataFrame, vector: str = "magnitude", by: str = "seg") -> DataFrame:
    """By pixel the mean and the median angle in degrees between successive vectors (in the order of `by`; none for a single one
    or beside a zero vector), and the mean angle to the vector of the elements' medians."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select("pos", F.col(by).alias("__by"), v.alias("v")).withColumn("was", F.lag("v").over(Window.partitionBy("pos").orderBy("__by")))
    n = 7
    middle = F.array(*[F.median(F.col("v")[k]).over(Window.partitionBy("pos")) for k in range(n)])
    rows = rows.withColumn("middle", middle)

    def angle(a, b):
        some = F.exists(a, lambda x: x != 0) & F.exists(b, lambda x: x != 0)
        return F.when(some, C.angle_between(a, b))

    step, off = angle(F.col("v"), F.col("was")), angle(F.col("v"), F.col("middle"))
    return rows.groupBy("pos").agg(F.avg(step).alias("mean"), F.median(step).alias("median"), F.avg(off).alias("mean_to_median"))


def count_ids(ids) -> Column:
    """How many numbers of an array aren't 0."""
    return F.size(F.filter(ids, lambda x: x != 0))
