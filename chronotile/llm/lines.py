"""Line dedup by winnowing, in DataFrame functions alone.

A text is its lines between line feeds; lines without a word are left as they are and don't count.
Of each WINDOW successive line hashes the least (of equals the last) is a fingerprint, and so is each
line of half LONG words or more; therefore a run of WINDOW lines, or of LONG words in fewer lines,
always holds one. A fingerprint's first place in the corpus is joined with its other places. Each
pair of texts and distance so found is extended both ways, line by line, and a run
of equal lines is deleted from the later text if it has LONG words, or WINDOW lines and SHORT
words. Texts come in the order of their ids (null last; then of a hash), places in that of lines.

A fingerprint or run is held against its first place only, never against all others, so that rows grow with
the lines. Lines are compared by 64-bit hashes. Rows that repeat both id and text are one text,
which isn't deleted for its own sake. A null or empty text has no lines and stays as it is; a very long one
is cut like any other, as its lines are one array. Other columns stay; one named like a result or a working column gives way. An empty table gives
an empty result.

A fingerprint of three places or more may have its first one in other context than two later ones share.
With all_runs (as the query has it) the shortest runs around these that count, from each line on and up to each line, are held
against their own first places too. Every line of a repeated run lies in one of them, so each is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, LONG, SHORT = 3, 50, 20
_LAST = (1 << 63) - 1
_OWN = ["__did", "__th", "__runs", "n_lines", "n_removed", "cleaned"]
#: What makes a line count.
_WORD = r"rlike '[^ \\t-\\r]'"


def _arrays(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, h, w, idx): of each different text the hashes, words and places of its lines that count."""
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    lines = named.select(F.expr(f"coalesce(doc_id, {_LAST}L) as did"), F.expr("xxhash64(text) as th"), F.expr(r"split(text, '\n') as parts"))
    lines = lines.select("did", "th", "parts", F.expr(f"filter(sequence(0, size(parts) - 1), i -> parts[i] {_WORD}) as idx")).filter("size(idx) > 0")
    lines = lines.select("did", "th", "idx", F.expr("transform(idx, i -> xxhash64(parts[i])) as h"), F.expr(r"transform(idx, i -> size(filter(split(parts[i], '[ \\t-\\r]+'), y -> y <> ''))) as w"))
    return common.materialize(lines.dropDuplicates(["did", "th"]), "lines")


def _prints(arrays: DataFrame, window: int, long_: int) -> DataFrame:
    """(did, th, at, h, before, after, words): the fingerprints' places, with the hashes of the lines around them."""
    minima = f"transform(sequence(0, size(h) - {window}), s -> -array_min(transform(sequence(s, s + {window - 1}), j -> struct(h[j] as v, -j as j))).j)"
    least = f"CASE WHEN size(h) >= {window} THEN {minima} ELSE array() END"
    wide = f"filter(sequence(0, size(h) - 1), j -> 2 * w[j] >= {long_})"
    places = arrays.select("did", "th", "h", "w", F.explode(F.expr(f"array_union(cast({least} as array<int>), {wide})")).alias("at"))
    return places.select("did", "th", "at", F.expr("h[at] as h"), F.expr("get(h, at - 1) as before"), F.expr("get(h, at + 1) as after"), F.expr("w[at] as words"))


def _shortest(arrays: DataFrame, often: DataFrame, window: int, long_: int, short: int) -> DataFrame:
    """(did, th, at, key): the shortest runs that count near the places of `often` (did, th, at); equal runs have equal keys."""
    most = max(window, short)  # a line that counts has a word
    near = often.groupBy("did", "th").agg(F.collect_set("at").alias("often")).join(arrays, ["did", "th"])
    size = f"(s, x) -> CASE WHEN s.done THEN s ELSE struct(s.n + 1 as n, s.words + x as words, s.words + x >= {long_} OR (s.n + 1 >= {window} AND s.words + x >= {short}) as done) END, s -> IF(s.done, s.n, 0)"
    lines = f"array_distinct(flatten(transform(often, a -> sequence(greatest(0, a - {most - 1}), least(size(w) - 1, a + {most - 1})))))"
    on = f"aggregate(slice(w, i + 1, {most}), struct(0 as n, 0 as words, false as done), {size})"
    back = f"aggregate(reverse(slice(w, greatest(0, i - {most - 1}) + 1, i - greatest(0, i - {most - 1}) + 1)), struct(0 as n, 0 as words, false as done), {size})"
    near = near.select("did", "th", "h", "w", F.expr(lines).alias("places"))
    near = near.select("did", "th", "h", F.expr(f"transform(places, i -> struct(i as at, {on} as n))").alias("ahead"), F.expr(f"transform(places, i -> struct(i as at, {back} as n))").alias("behind"))
    codes = f"array_union(transform(filter(ahead, x -> x.n > 0), x -> x.at * {most + 1}L + x.n), transform(filter(behind, x -> x.n > 0), x -> (x.at - x.n + 1) * {most + 1}L + x.n))"
    near = near.select("did", "th", "h", F.expr(codes).alias("codes"))
    each = f"transform(codes, c -> struct(cast(c div {most + 1} as int) as at, xxhash64(slice(h, cast(c div {most + 1} as int) + 1, cast(c % {most + 1} as int))) as key))"
    return near.select("did", "th", F.explode(F.expr(each)).alias("run")).select("did", "th", "run.at", "run.key")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_: int = LONG, short: int = SHORT, all_runs: bool = False) -> DataFrame:
    """(did, th, runs): of each text with something to delete the runs (places of the first and last line)."""
    arrays = _arrays(docs, id_col, text_col)
    prints = common.materialize(_prints(arrays, window, long_), "prints")
    first = prints.groupBy("h").agg(F.min(F.struct("did", "th", "at", "before", "after")).alias("first"), F.count("*").alias("k")).filter("k > 1").select("h", "first", "k")
    again = prints.join(first, "h").filter("NOT (did = first.did AND th = first.th AND at = first.at)")
    # A line that is alone in a match is a run only if it is long itself.
    more = again.filter(f"words >= {long_} OR before = first.before OR after = first.after")
    pairs = more.select("did", "th", F.col("first.did").alias("adid"), F.col("first.th").alias("ath"), F.expr("at - first.at as away"))
    if all_runs:
        often = prints.join(first.filter("k > 2").select("h"), "h").select("did", "th", "at")
        shortest = common.materialize(_shortest(arrays, often, window, long_, short), "shortest")
        begun = shortest.groupBy("key").agg(F.min(F.struct("did", "th", "at")).alias("first"), F.count("*").alias("k")).filter("k > 1").select("key", "first")
        rest = shortest.join(begun, "key").filter("NOT (did = first.did AND th = first.th AND at = first.at)")
        pairs = pairs.unionByName(rest.select("did", "th", F.col("first.did").alias("adid"), F.col("first.th").alias("ath"), F.expr("at - first.at as away")))
    pairs = pairs.distinct()
    early = arrays.select(F.col("did").alias("adid"), F.col("th").alias("ath"), F.col("h").alias("ah"))
    both = pairs.join(early, ["adid", "ath"]).join(arrays, ["did", "th"])
    both = both.select("did", "th", "w", "idx", "h", "ah", "away", F.expr("greatest(0, away) as lo"), F.expr("least(size(h), size(ah) + away) as hi"))
    both = both.select("did", "th", "w", "idx", "lo", F.expr("zip_with(slice(h, lo + 1, hi - lo), slice(ah, lo - away + 1, hi - lo), (x, y) -> x = y) as eq"))
    begin = "filter(sequence(0, size(eq) - 1), i -> eq[i] AND (i = 0 OR NOT eq[i - 1]))"
    end = "filter(sequence(0, size(eq) - 1), i -> eq[i] AND (i = size(eq) - 1 OR NOT eq[i + 1]))"
    found = both.select("did", "th", "w", "idx", F.expr(f"zip_with({begin}, {end}, (a, b) -> struct(lo + a as a, lo + b as b)) as found"))
    words = "aggregate(slice(w, r.a + 1, r.b - r.a + 1), 0, (s, x) -> s + x)"
    good = f"filter(found, r -> {words} >= {long_} OR (r.b - r.a + 1 >= {window} AND {words} >= {short}))"
    each = found.select("did", "th", F.explode(F.expr(f"transform({good}, r -> struct(idx[r.a] as a, idx[r.b] as b))")).alias("run"))
    return each.groupBy("did", "th").agg(F.collect_set("run").alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """docs with n_lines (those that count), n_removed and the cleaned text in `cleaned`."""
    base = common.without(docs, _OWN)
    found = runs(docs, id_col, text_col, **limits).select(F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    keyed = base.withColumns({"__did": F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), "__th": F.xxhash64(F.coalesce(text_col, F.lit("")))})
    joined = keyed.join(found, ["__did", "__th"], "left")
    split = f"split(`{text_col}`, '\\\\n')"
    joined = joined.withColumn("__counted", F.expr(f"filter({split}, x -> x {_WORD})"))
    gone = f"x {_WORD} AND exists(__runs, r -> i BETWEEN r.a AND r.b)"
    kept = f"array_join(filter({split}, (x, i) -> NOT ({gone})), '\\n')"
    removed = f"size(filter({split}, (x, i) -> {gone}))"
    out = joined.withColumns({"n_lines": F.greatest(F.size("__counted"), F.lit(0)).cast("long"), "n_removed": F.expr(f"CASE WHEN __runs IS NULL THEN 0 ELSE {removed} END").cast("long"), "cleaned": F.expr(f"CASE WHEN __runs IS NULL THEN `{text_col}` ELSE {kept} END")})
    return out.select([F.col(f"`{c}`") for c in base.columns] + ["n_lines", "n_removed", "cleaned"])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"), all_runs=True)
    return rows.select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("cleaned", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("cleaned", F.lit("")).cast("binary"), 256).alias("text_sha256"))
