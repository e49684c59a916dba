"""Exact dedup with a heavy-hitter split.

Texts are equal when their UTF-8 bytes are, as told by SHA-256; null counts as empty. Each partition
keeps a Misra-Gries summary of its digests. A digest of more than a PHI-th of all rows is
certain to be among those whose summed counts pass a bound, and no more than HEAVY can be: these few
are counted exactly, and their winners go to all executors, which settle the losers' rows where they
lie. The rest, in which no group is large any more, is shuffled by digest.

Of equal texts the row with the largest doc_id stays; a null id loses to any other. Of rows that
repeat both text and id one stays, of a heavy digest's too, as those are cut to one in each task before they meet. A
very long text is as good as any: only digests move. An empty table gives an empty result; other columns stay as
they are in dedup(), and one named like a working column ("__digest", "__row") gives way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Counters of a summary, and the share of all rows from which a digest may be called heavy.
COUNTERS, PHI = 1024, 1 / 256
#: No more digests than this can pass the bound: each needs PHI - 1 / (COUNTERS + 1) of all rows.
HEAVY = int(1 / (PHI - 1 / (COUNTERS + 1))) + 1


def merge(into: dict, counts: dict, k: int = COUNTERS) -> dict:
    """Misra-Gries: add counts to a summary and cut it back to k counters. What all cuts take
    from a counter is at most the rows seen / (k + 1)."""
    for key, n in counts.items():
        into[key] = into.get(key, 0) + n
    if len(into) <= k:
        return into
    cut = sorted(into.values(), reverse=True)[k]
    return {key: n - cut for key, n in into.items() if n > cut}


def heavy_hitters(df: DataFrame, key: str) -> DataFrame:
    """(key, n_rows of the whole table) of every value that at least PHI of the rows have; HEAVY rows at most."""

    def summary(batches):
        from collections import Counter

        import pyarrow as pa

        kept, rows = {}, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows += len(keys)
            kept = merge(kept, Counter(keys))
        yield pa.RecordBatch.from_pydict({"key": pa.array([*kept, None], pa.string()), "n": pa.array([*kept.values(), rows], pa.int64())})

    found = df.select(F.col(key).cast("string")).mapInArrow(summary, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = common.materialize(found, "summaries")
    rows = found.filter("key is null").agg(F.sum("n")).first()[0] or 0
    return found.filter(F.col("key").isNotNull() & (F.col("n") > rows * (PHI - 1 / (COUNTERS + 1))))


def winners(ids: DataFrame, id_col: str) -> DataFrame:
    """(__digest, __keep, __size) of the heavy digests of ids (id_col, __digest), counted exactly."""
    hot = [r[0] for r in heavy_hitters(ids, "__digest").collect()]
    exact = ids.filter(F.col("__digest").isin(hot)).groupBy("__digest").agg(F.max(id_col).alias("__keep"), F.count("*").alias("__size"))
    return ids.sparkSession.createDataFrame(exact.filter("__size > 1").collect(), exact.schema)


def digest(text_col: str = "text"):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each of docs: the id, keep_id (of the row that stays), group_size, kept, text_sha256."""
    ids = docs.select(F.col(id_col).alias("doc_id"), digest(text_col).alias("__digest"))
    ids = common.materialize(ids.withColumn("__row", F.monotonically_increasing_id()), "digests")  # rows that repeat are told apart by __row
    hot = winners(ids, "doc_id")
    known = ids.join(F.broadcast(hot), "__digest", "left")
    heavy = F.col("__size").isNotNull()
    # Of a heavy group's rows with the winning id the first stays: one row for each heavy digest, found by a partial aggregation.
    first = known.filter(heavy & F.col("doc_id").eqNullSafe(F.col("__keep"))).groupBy("__digest").agg(F.min("__row").alias("__first"))
    settled = known.filter(heavy).join(F.broadcast(first), "__digest").select("doc_id", F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__row") == F.col("__first")).alias("kept"), F.col("__digest").alias("text_sha256"))
    same = Window.partitionBy("__digest")
    rest = known.filter(~heavy).select(
        "doc_id",
        F.max("doc_id").over(same).alias("keep_id"),
        F.count("*").over(same).alias("group_size"),
        (F.row_number().over(same.orderBy(F.col("doc_id").desc_nulls_last(), "__row")) == 1).alias("kept"),
        F.col("__digest").alias("text_sha256"),
    )
    return settled.unionByName(rest)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    rows = common.without(docs, ["__digest", "__keep", "__size", "__nth", "__all"]).withColumn("__digest", digest(text_col))
    ids = common.materialize(rows.select(F.col(id_col).alias("__id"), "__digest"), "digests")
    known = rows.join(F.broadcast(winners(ids, "__id")), "__digest", "left")
    heavy = F.col("__size").isNotNull()
    own = [F.col(f"`{c}`") for c in docs.columns if c in rows.columns]
    nth = F.row_number().over(Window.partitionBy("__digest").orderBy(F.col(id_col).desc_nulls_last()))
    rest = known.filter(~heavy).withColumn("__nth", nth).filter("__nth = 1").select(own)
    # A heavy group's rows with the winning id (one, unless rows repeat) are cut to one where they lie, before any meet.
    settled = known.filter(heavy & F.col(id_col).eqNullSafe(F.col("__keep"))).groupBy("__digest").agg(F.first(F.struct(own)).alias("__all")).select("__all.*")
    return rest.unionByName(settled)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
