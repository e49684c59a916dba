"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

import public_tokenizers  # noqa: E402

from chronotile.llm import bpe, common, exact, licenses, lines, near, packing, quality, suffixtree, toxicity, urls  # noqa: E402

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PROSE = " ".join(f"word{i}" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a", 1),
    (2, PROSE, "en", None, None),
    (2, PROSE, "en", None, None),
    (3, None, None, None, None),
    (None, "", "en", "a", 0),
    (None, None, None, None, None),
    (4, LONG, "en", "a", 1),
    (5, "   \n\t \n", "en", "a", 1),
    (6, "one", "en", "a", 1),
    (7, "All rights reserved.\n" + "x" * 100_000, "en", "a", 1),
]
DDL = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "lines": lambda d: lines.dedup_lines(d),
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "near": lambda d: near.groups(d),
    "near_dedup": lambda d: near.dedup(d),
    "suffixtree": lambda d: suffixtree.score(d, common.bucket("doc_id", 10) == 0),
    "exact": lambda d: exact.groups(d),
    "exact_dedup": lambda d: exact.dedup(d),
    "bpe": lambda d: bpe.encode_decode(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "licenses": lambda d: licenses.scan_licenses(d),
    "quality": lambda d: quality.ledger(d),
    "keep_good": lambda d: quality.keep_good(d),
}
#: What the odd rows give: ids and values that each docstring states.
VALUES = {
    "lines": lambda rows: {(r["doc_id"], r["n_lines"], r["n_removed"]) for r in rows} == {(1, 1, 0), (2, 1, 1), (3, 0, 0), (None, 0, 0), (4, 1, 0), (5, 0, 0), (6, 1, 0), (7, 2, 0)},
    "packing": lambda rows: sorted((r["doc_id"] or 0) for r in rows if r["doc_tokens"] == 1) == [0, 0, 3, 5] and sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 2),
    "near": lambda rows: sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"]) for r in rows) == [(0, 3, 3), (0, 3, 3), (1, 2, 3), (2, 2, 3), (2, 2, 3), (3, 3, 3), (4, 4, 1), (5, 5, 1), (6, 6, 1), (7, 7, 1)],
    "near_dedup": lambda rows: sorted(r["doc_id"] for r in rows) == [2, 2, 3, 4, 5, 6, 7],
    "suffixtree": lambda rows: all((r["n_tokens"] == 1) == (r["doc_id"] in (3, 5, None)) and r["score"] <= 0 for r in rows),
    "exact": lambda rows: sum(r["kept"] for r in rows) == 6 and {r["keep_id"] for r in rows} == {2, 3, 4, 5, 6, 7},
    "exact_dedup": lambda rows: sorted(r["doc_id"] for r in rows) == [2, 3, 4, 5, 6, 7],
    "bpe": lambda rows: {r["doc_id"] for r in rows if r["n_tokens"] == 0} == {3, None} and all(r["ids_sha256"].startswith("e3b0c442") == (r["n_tokens"] == 0) for r in rows),
    "licenses": lambda rows: [(r["first_word"], r["base_labels"]) for r in rows if r["n_base"]] == [(0, "reserved")],
    "quality": lambda rows: {r["doc_id"] for r in rows if r["n_words"] == 0} == {3, 5, None} and all(r["fail_bits"] & 1 for r in rows if r["n_words"] < 10),
    "keep_good": lambda rows: sorted(r["doc_id"] for r in rows) == [1, 2, 2, 4],
}
ONE_EACH = {"lines", "near", "suffixtree", "exact", "bpe", "licenses", "quality"}
CLASHING = ["n_words", "kept", "score", "digest", "__digest", "__id", "text_sha256", "n_lines", "cleaned", "fail_bits", "bucket", "tid", "N_Tokens", "toxic", "__did"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL)


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ONE_EACH:
        assert len(rows) == len(ROWS)
        assert sorted((r["doc_id"] or 0) for r in rows) == sorted((r[0] or 0) for r in ROWS)
    assert VALUES[name](rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DDL)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(docs, name):
    plain = OPERATORS[name](docs)
    more = OPERATORS[name](docs.withColumns({c: F.lit("clash") for c in CLASHING}))
    assert len({c.lower() for c in more.columns}) == len(more.columns)
    mine = [c for c in plain.columns if c not in ("lang", "source", "n_chars", "sequence_id", "path_id")]
    assert set(mine) <= set(more.columns)
    assert sorted(map(str, plain.select(mine).collect())) == sorted(map(str, more.select(mine).collect()))


def test_exact_ties(docs):
    rows = exact.groups(docs).collect()
    prose = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in prose} == {2} and {r["group_size"] for r in prose} == {3}
    assert [r["doc_id"] for r in prose if r["kept"]] == [2]  # one of the repeated rows
    empty = [r for r in rows if r["text_sha256"].startswith("e3b0c442")]
    assert len(empty) == 3 and {r["keep_id"] for r in empty} == {3} and sum(r["kept"] for r in empty) == 1


def test_exact_hot_group_of_one_id(spark):
    """Half of the rows are one text with one id, or with none: one row of each stays."""
    rows = [(7, "hot", k) for k in range(300)] + [(None, "none", k) for k in range(300)] + [(100 + k, f"t{k % 250}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(6)
    got = exact.groups(df).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == 252
    hot = [r for r in got if r["doc_id"] == 7]
    assert sum(r["kept"] for r in hot) == 1 and {(r["keep_id"], r["group_size"]) for r in hot} == {(7, 300)}
    none = [r for r in got if r["doc_id"] is None]
    assert sum(r["kept"] for r in none) == 1 and {(r["keep_id"], r["group_size"]) for r in none} == {(None, 300)}
    left = exact.dedup(df)
    assert left.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(7, "hot"), (0, "none")] + [(350 + k, f"t{k}") for k in range(250)])


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == len(ROWS) and all(r["score"] == 0 and r["predicted"] == 0 for r in rows)
    odd = spark.createDataFrame([(None, None, 1), (1, 1, None), (2, 0, 5)], none.schema)
    assert toxicity.score(docs, odd).count() == len(ROWS)
    assert toxicity.keep_clean(docs, odd).count() == len(ROWS)


def test_toxicity_empty_table_and_clashes(spark, docs):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 30)] * 2, "doc_id long, quality int, toxic int")
    assert toxicity.score(spark.createDataFrame([], DDL), labels).collect() == []
    more = docs.withColumns({c: F.lit("clash") for c in CLASHING})
    assert sorted(r["score"] for r in toxicity.score(more, labels).collect()) == sorted(r["score"] for r in toxicity.score(docs, labels).collect())


def test_urls(spark):
    cases = {
        None: (None, "allow"),
        "": (None, "allow"),
        "no scheme example.net/en/": (None, "allow"),
        "http://EXAMPLE.net/en/1": ("example.net/en/", "allow"),
        "http://a.example.net/de/1": ("net/", "block"),
        "http://a.net": (None, "allow"),
        "http://a.net?x=/": (None, "allow"),
        "http://www.example.com/de/?q#f": ("example.com/de/", "block"),
        "http://example.com/den": (None, "allow"),
        "http://a.org/fr/x/../y": ("org/fr/", "allow"),
        "http://xexample.net/en/": ("net/", "block"),
        "http://" + "a." * 5000 + "net/" + "p/" * 5000: ("net/", "block"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)] * 2, "page_id long, url string, HOST string")
    for most in (10, 0):
        got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.filter_urls(df, max_trie=most).collect()}
        assert got == cases
        assert urls.filter_urls(df.limit(0), max_trie=most).collect() == []


def test_urls_ties_and_many_rules(spark):
    """Equal lengths: the longer host. Many entries in one segment, against all entries one by one, by trie and by join."""
    r = random.Random(2)
    rules = [("block", "b.c", "/xy"), ("allow", "c", "/xyzw"), ("allow", "b.c", "/")]
    rules += [(r.choice(("allow", "block")), r.choice(("c", "b.c", "a.b.c")), "/" + "".join(r.choice("ab") for _ in range(r.randint(0, 6))) + r.choice(("", "/", "/q"))) for _ in range(150)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    page_urls = ["http://b.c/xyzw", "http://x.b.c/xyzwv"] + [f"http://{r.choice(('c', 'b.c', 'z.a.b.c', 'd'))}/" + "".join(r.choice("ab/q") for _ in range(r.randint(0, 9))) for _ in range(200)]

    def brute(url):
        host, path = urls.split_url(url)
        fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else (None, "allow")

    df = spark.createDataFrame([(i, u) for i, u in enumerate(page_urls)], "page_id long, url string")
    assert brute("http://b.c/xyzw") == ("b.c/xy", "block")
    for most in (1000, 0):
        assert {x["url"]: (x["rule"], x["verdict"]) for x in urls.filter_urls(df, rules, max_trie=most).collect()} == {u: brute(u) for u in page_urls}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage, tmp_path):
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    more = docs.withColumns({c: F.lit("clash") for c in CLASHING if c != "n_chars"})
    for given in (docs, more, docs.limit(0)):
        out = stage(spark, given, str(tmp_path))
        n = out.count()
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
            assert n <= len(ROWS)
