"""What workers hold at a time stays small, however large the table is."""

import os
import random

import numpy as np
import pytest

pytest.importorskip("xxhash")
from chronotile.llm import common, near  # noqa: E402


def test_what_meets_in_a_task_is_small(spark, monkeypatch):
    """No group of buckets or of shingles gets the postings of more than a few thousand texts."""
    seen = []
    several = near._several

    def spy(given, posted, parts, label):
        seen.append((label, parts))
        return several(given, posted, parts, label)

    monkeypatch.setattr(near, "_several", spy)
    r = np.random.default_rng(1)
    texts = spark.createDataFrame([(k, 1, r.integers(0, 2**32, near.HASHES, dtype=np.uint64).astype("<u4").tobytes()) for k in range(17000)], "tid long, n long, sig binary")
    assert near.shared_buckets(texts).filter("tid < 0").count() == 0
    docs = spark.createDataFrame([(k, " ".join(random.Random(k % 3).choices("abcdefgh", k=400_000))) for k in range(4)], "doc_id long, text string")
    rows, own = near.texts_of(docs, "doc_id", "text")
    big = own.withColumn("n", near.F.lit(8_000_000).cast("long"))  # as if the texts were so long
    near.holders(docs, big, own.select("tid", near.F.col("tid").alias("label")), "text", near.T, True)
    parts = dict(seen)
    assert 17000 / parts["buckets"] <= 4096 and 3 * 8_000_000 / parts["shingles"] <= 1 << 20


def test_batches_of_long_rows_are_short(spark):
    def sizes(batches):
        for b in batches:
            yield near.pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    usual = spark.conf.get(common._BATCH)
    got = common.materialize(spark.range(100).mapInArrow(sizes, "n long"), "test", batch=7)
    assert max(x["n"] for x in got.collect()) <= 7 and spark.conf.get(common._BATCH) == usual


def test_shuffle_files_go_once_written(spark):
    """What materialize() shuffled takes no disk when it is written; the rows are there, and the setting is as before."""

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    usual, before = spark.conf.get(common._CLEANUP), shuffled()
    rows = spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count()
    made = common.materialize(rows.join(rows.withColumnRenamed("count", "again"), "k"), "test")
    assert shuffled() <= before and made.count() == 7 and spark.conf.get(common._CLEANUP) == usual


def test_tokenizer_keeps_few_ids():
    """What a worker keeps of a corpus of ever new words is bounded well below 100 MB, and words that are encoded together have the ids they have alone."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from chronotile.llm import packing

    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(4)
    for _ in range(4):
        ids([" ".join("".join(r.choices("abcdefghij", k=9)) for _ in range(50_000)).encode()])
    assert len(ids.known) <= 150_000 and len(ids.pieces) <= 150_000
    odd = ["Stra\u00dfe", "\u0130stanbul", "\u0958\u0959", "don't", "ab12", "<|endoftext|>", "\u00e9t\u00e9", "x\u0301y", "\u4e2d\u6587", "\U00010428", "A", "na\u00efve,", ""]
    for text in (" ".join(odd), " ".join(reversed(odd)), " ".join(w for w in odd if w.isalpha())):
        fresh = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
        assert fresh([text.encode()])[0].tolist() == [*fresh.t.encode(text, add_special_tokens=False).ids, packing.END]


def test_tokens_after_one_word_take_little(monkeypatch):
    """What scoring holds beside the tokens after one word is bounded, and slices give what all tokens at a time give."""
    import tracemalloc

    from chronotile.llm import suffixtree

    def given(n, words):
        r = np.random.default_rng(6)
        x, *before = ((r.zipf(1.3, n) % words + 3).astype(np.uint32) for _ in range(suffixtree.DEPTH + 1))
        before[0][: n // 2] = before[1][: n // 3] = 5
        before[1][n // 2 :][::7] = 0
        x[::11] = 0
        return before, x, r.random(n) < 0.9, np.full(n, 1e-3)

    whole = suffixtree.predicted(*given(40_000, 50), 0.5, 2, 2.0)
    monkeypatch.setattr(suffixtree, "SLICE", 500, raising=False)
    assert np.allclose(suffixtree.predicted(*given(40_000, 50), 0.5, 2, 2.0), whole, rtol=1e-12) and len(set(whole.tolist())) > 1000
    monkeypatch.undo()
    before, x, learn, root = given(3_000_000, 100_000)
    before[0][:] = 5
    tracemalloc.start()
    suffixtree.predicted(before, x, learn, root, 0.5, 2, 2.0)
    assert tracemalloc.get_traced_memory()[1] < 48 * len(x)
    tracemalloc.stop()
