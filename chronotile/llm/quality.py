"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text. Its measurements and one bit a failed rule are kept;
a policy is a mask over those bits, so that a new policy, or the question what a rule alone
rejects, needs no second look at the texts.

Words are runs of other characters than ASCII white space. A null or empty text has no words,
fails the rule on their number and is rejected by every policy that holds this rule. Rows that
repeat are judged each on its own; a very long text is measured as a whole; an empty table gives an empty ledger and
ablations of zeros. An input column named like a column of the ledger gives way.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SCHEMA = T.StructType([T.StructField(n, T.LongType(), False) for n in MEASURES])

#: Rule -> what fails it, over the measurements; the place in this dict is the bit.
RULES = {
    "few_words": lambda c: c("n_words") < 10,
    "repeats": lambda c: 100 * c("n_repeat_words") > 20 * c("n_words"),
    "short_words": lambda c: c("word_chars") < 3 * c("n_words"),
    "long_words": lambda c: c("word_chars") > 12 * c("n_words"),
    "symbols": lambda c: 10 * c("n_symbols") > c("n_words"),
    "dup_lines": lambda c: 2 * c("n_dup_lines") > c("n_lines"),
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}
BASE = ("few_words", "repeats")
#: Version -> the rules that reject.
POLICIES = {"base": BASE, "v1": tuple(RULES)}


def mask(policy: str | tuple[str, ...]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words in n-word windows that stand twice or more in the list."""
    if len(words) <= n:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        w *= np.uint64(0x9E3779B97F4A7C15)
        w += h[k : len(h) - n + 1 + k]
    s = np.sort(w)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice)).tolist()
    said = [tuple(words[i : i + n]) for i in at]  # equal hashes alone prove nothing
    count = Counter(said)
    edge = np.zeros(len(words) + 1, np.int64)
    for i, x in zip(at, said, strict=True):
        if count[x] > 1:
            edge[i] += 1
            edge[i + n] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    letters = text.decode("utf-8")
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(letters) - sum(map(letters.count, common.SPACES)),
        sum(map(letters.count, "#*$%&|<>")),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _work(batch: list[bytes]) -> dict:
    rows = [measure(t) for t in batch]
    return dict(zip(MEASURES, map(list, zip(*rows, strict=True)), strict=True))


def fail_bits(of=F.col) -> Column:
    bits = F.lit(0).cast("long")
    for name, failed in RULES.items():
        bits = bits.bitwiseOR(F.when(failed(of), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the measurements and fail_bits."""
    return common.map_texts(common.without(docs, ["fail_bits"]), _work, SCHEMA, text_col).withColumn("fail_bits", fail_bits())


def kept(policy: str | tuple[str, ...]) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def ablations(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A row for each rule of the policy: rows that fail it, and rows that it alone rejects."""
    m = mask(policy)
    held = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    counts = rows.groupBy(held.alias("bits")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = rows.sparkSession.createDataFrame([(r, BIT[r]) for r in POLICIES[policy]], "rule string, bit long")
    hit = F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0))
    alone = F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0))
    each = counts.select("n", "bits", F.explode(F.array(*[F.lit(BIT[r]).cast("long") for r in POLICIES[policy]])).alias("bit"))
    sums = each.groupBy("bit").agg(hit.alias("n_failed"), alone.alias("n_alone"))
    return rules.join(F.broadcast(sums), "bit", "left").select("rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_alone", F.lit(0)).alias("n_alone"))


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns: those of the ledger stand beside them until it has judged
    (under names of its own; an input column named like one, as "__fail_bits", gives way)."""
    schema = T.StructType([T.StructField(f"__{n}", T.LongType(), False) for n in MEASURES])

    def work(batch: list[bytes]) -> dict:
        return {f"__{n}": c for n, c in _work(batch).items()}

    base = common.without(docs, [*schema.fieldNames(), "__fail_bits"])
    rows = common.map_texts(base, work, schema, text_col, keep="all").withColumn("__fail_bits", fail_bits(lambda n: F.col(f"__{n}")))
    return rows.filter(F.col("__fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0).select([F.col(f"`{c}`") for c in base.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~kept("base")).alias("base_failed"), kept("v1").alias("kept"), "n_lines", "fail_bits")


def op9_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, and alone rejects, from one ledger."""
    return ablations(ledger(common.table(spark, sf_dir, "documents").select("text")))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, list_slice(words, i, i + 4) AS gram FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 6)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS k FROM t) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN word_chars < 3 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 12 * n_words THEN 8 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END AS bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  bits & 3 <> 0 AS base_failed, bits = 0 AS kept, CAST(n_lines AS BIGINT) AS n_lines, CAST(bits AS BIGINT) AS fail_bits
FROM b
"""

OP9_ABLATIONS_SQL = f"WITH l AS ({OP9_SQL}) " + " UNION ALL ".join(
    f"SELECT '{r}' AS rule, count(*) FILTER (fail_bits & {BIT[r]} <> 0) AS n_failed, count(*) FILTER (fail_bits = {BIT[r]}) AS n_alone FROM l" for r in POLICIES["v1"]
)
