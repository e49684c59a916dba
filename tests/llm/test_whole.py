"""Planted cases that a search which stops early would miss."""

import random
from collections import defaultdict

import pytest

pytest.importorskip("chronotile.llm")

from chronotile.llm import lines, near  # noqa: E402


def said(shingles, name):
    """A text of that many shingles (five words each), all different from those of other names."""
    return [f"{name}w{k}" for k in range(shingles + 4)]


def true_classes(rows):
    sets = {i: set(near.shingles(t.encode()).tolist()) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * max(len(sets[a]), len(sets[b])):
                parent[root(a)] = root(b)
    out = defaultdict(set)
    for i in sets:
        out[root(i)].add(i)
    return sorted(map(sorted, out.values()))


def classes(spark, rows):
    got = defaultdict(set)
    for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r["class_id"]].add(r["doc_id"])
    return sorted(map(sorted, got.values()))


@pytest.mark.parametrize("n", (80, 300))
def test_near_template_family(spark, n):
    """P1 to Pn hold a template of 250 shingles and 70 of their own each, so they are linked to none; Q and R hold
    it and 50 of their own, so they are linked, but their buckets are those of the template and thus of many P."""
    template = said(250, "c")
    rows = [(k, " ".join([*template, *said(66, f"p{k}x")])) for k in range(n)]
    rows += [(n + k, " ".join([*template, *said(46, f"q{k}x")])) for k in range(2)]
    random.Random(n).shuffle(rows)
    true = true_classes(rows)
    assert len(true) == n + 1 and [n, n + 1] in true
    assert classes(spark, rows) == true


def test_prefix_pairs_leave_no_link(spark):
    """Sets of many sizes and overlaps: every link is among the pairs."""
    import numpy as np

    r = random.Random(1)
    sets = []
    for k in range(60):
        base = sets[r.randrange(k)] if k and r.random() < 0.7 else r.sample(range(300), r.randint(1, 60))
        sets.append(sorted({x if r.random() < 0.93 else r.randrange(300) for x in base}))
    df = spark.createDataFrame([(k, bytearray(np.array(x, np.uint64).tobytes())) for k, x in enumerate(sets)], "tid long, set binary")
    labels = spark.createDataFrame([(k, k - k % 2) for k in range(60)], "tid long, label long")
    got = {(x["a"], x["b"]) for x in near.prefix_pairs(df, labels, 0.8).collect()}
    links = {(a, b) for a in range(60) for b in range(a + 1, 60) if a // 2 != b // 2 and len(set(sets[a]) & set(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) - 1e-9}
    assert len(links) > 20 and links <= got and all(a // 2 != b // 2 for a, b in got)


def repeated(texts):
    """The places of lines that lie in a run which an earlier place repeats, of all runs that count."""
    out, seen = [], set()
    for text in texts:
        ls, gone, own = text.split("\n"), set(), []
        for i in range(len(ls)):
            for j in range(i, len(ls)):
                n = sum(len(x.split()) for x in ls[i : j + 1])
                if n >= lines.LONG or (j - i + 1 >= lines.WINDOW and n >= lines.SHORT):
                    own.append((i, j, tuple(ls[i : j + 1])))
        for i, j, run in own:
            if run in seen:
                gone |= set(range(i, j + 1))
            seen.add(run)
        out.append(gone)
    return out


def test_lines_frequent_in_other_context(spark):
    """Passages whose lines all occur earlier, alone: against all runs that count."""
    r = random.Random(5)
    usual = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 14))) for _ in range(14)]
    texts = ["\n".join(f"only {k} {j}" if j % 2 else x for j, x in enumerate(y for u in r.sample(usual, 14) for y in (u, ""))) for k in range(4)]
    passages = [r.sample(usual, r.randint(2, 7)) for _ in range(6)]
    for k in range(40):
        texts.append("\n".join([f"p {k}", *r.choice(passages), f"q {k}", *r.sample(usual, 2), *r.choice(passages)[r.randint(0, 2) :], f"r {k}"]))
    true = repeated(texts)
    assert sum(map(len, true)) > 100
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), all_runs=True).collect()
    for row in got:
        want = [x for k, x in enumerate(texts[row["doc_id"]].split("\n")) if k not in true[row["doc_id"]]]
        assert row["cleaned"].split("\n") == want if want else row["cleaned"] == ""


def test_lines_all_runs_of_corpus(spark):
    from test_results import CORPUS

    rows = sorted((i, t or "") for i, t in CORPUS)
    true = {i: gone for (i, _), gone in zip(rows, repeated([t for _, t in rows]), strict=True)}
    got = lines.dedup_lines(spark.createDataFrame(CORPUS, "doc_id long, text string").repartition(5), all_runs=True).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: len(gone) for i, gone in true.items()}


def test_near_excerpts(spark):
    """Excerpts of half to three quarters of longer texts, each with a text that shares six or nine tenths of its words."""
    r = random.Random(3)
    rows, inside = [], {}
    for k in range(60):
        words = [f"t{k}w{j}" for j in range(r.choice((60, 300, 900)))]
        rows.append((k, " ".join(words)))
        n = int(len(words) * r.choice((0.5, 0.6, 0.75)))
        at = r.randrange(len(words) - n)
        rows.append((100 + k, " ".join(words[at : at + n])))
        inside[100 + k] = k
        other = words[at : at + n]
        cut = int(len(other) * (0.9 if k % 2 else 0.6))
        rows.append((200 + k, " ".join([*other[:cut], *(f"o{k}w{j}" for j in range(n - cut))])))
    sets = {i: set(near.shingles(t.encode()).tolist()) for i, t in rows}
    got = {x["doc_id"]: x for x in near.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, x in got.items():
        if (b := x["within_id"]) is not None:
            assert got[b]["class_id"] != x["class_id"] and len(sets[i] & sets[b]) >= 0.8 * len(sets[i])
    assert all(got[i]["class_id"] != got[k]["class_id"] for i, k in inside.items())
    assert sum(got[i]["within_id"] is not None for i in inside) >= 0.95 * len(inside)


def test_near_bands_differ_by_partition():
    k = near.partition(100)
    found = near.searches(k)
    assert found == {k: (37, 3), k + 1: (30, 2), k + 2: (47, 2), k + 3: (20, 1), k + 4: (25, 1)}
    for m, (bands, rows) in found.items():
        least = near.jaccard(near.sizes(k)[0], near.sizes(m)[1])
        assert bands * rows <= near.HASHES and (1 - least**rows) ** bands <= near.MISS * 1.001
    for n in range(1, 400):
        low, high = near.sizes(near.partition(n))
        assert low <= n <= high and near.partition(low) == near.partition(high) == near.partition(n)


def test_near_excerpts_all_holders(spark):
    """Against brute force: texts held by one that is no bucket's lead, short excerpts of long texts, excerpts in several texts."""
    r = random.Random(11)
    rows = []
    for k in range(12):
        words = [f"e{k}w{j}" for j in range(r.choice((30, 80, 200)))]
        rows.append((1000 + k, " ".join(words)))
        for i in range(4):  # each holds another part of it; two hold less than 0.8
            n = int(len(words) * (0.9, 0.95, 0.7, 0.5)[i])
            rows.append((100 * i + k + (400 if k % 2 else 0), " ".join([*words[:n], *said(r.randint(1, 8) * len(words), f"h{k}i{i}x")])))
    rows = list({i: (i, x) for i, x in rows}.values())
    sets = {i: set(near.shingles(t.encode()).tolist()) for i, t in rows}
    got = {x["doc_id"]: x for x in near.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    of = {i: x["class_id"] for i, x in got.items()}
    held = {(i, j) for i in sets for j in sets if of[i] != of[j] and len(sets[i]) <= len(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i]) - 1e-9}
    assert len(held) >= 24
    assert {i: x["within_id"] for i, x in got.items()} == {i: max((b for a, b in held if a == i), default=None) for i in sets}


def test_packing_meets_related_texts_of_all_tasks(spark, monkeypatch):
    """Pairs of related texts, dealt over many tasks, lie in one path; paths in rounds and in one task are the same."""
    import public_tokenizers
    from chronotile.llm import packing

    monkeypatch.setattr(packing, "PART", 2000)
    r = random.Random(13)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(3000)]
    rows = []
    for k in range(60):
        base = r.sample(words, 60)
        rows += [(k, " ".join(base)), (100 + k, " ".join([*r.sample(words, 20), *base[20:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = defaultdict(set)
    for x in packing.pack(df, tokenizer).collect():
        path[x["doc_id"]].add(x["path_id"])
    assert all(len(x) == 1 for x in path.values()) and len(path) == 120
    assert sum(path[k] == path[100 + k] for k in range(60)) >= 57
    made = packing.common.materialize(packing.tokenized(df, tokenizer).withColumn("tid", packing.F.monotonically_increasing_id()), "ids")
    order = []
    for greedy in (0, 10**6):
        got = defaultdict(list)
        for x in packing.path_places(made, 5, greedy).collect():
            got[x["path"]].append((x["pos"], x["tid"], x["n"]))
        assert all(sorted(p for p, _, _ in each) == list(range(len(each))) and {n for _, _, n in each} == {len(each)} for each in got.values())
        chains = [[t for _, t, _ in sorted(each)] for each in got.values()]
        order.append(sorted(min(c, c[::-1]) for c in chains))
    assert order[0] == order[1]


def test_pipeline_packs_related_texts_of_all_tasks(spark, monkeypatch):
    """The pipeline's last stage leaves related texts in one path, however many tasks there are."""
    import corpus_pipeline
    from chronotile.llm import packing

    monkeypatch.setattr(packing, "PART", 1000)
    r = random.Random(17)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(3000)]
    rows = []
    for k in range(40):
        base = r.sample(words, 60)
        rows += [(i, " ".join(x), "en", "s", 1) for i, x in ((k, base), (100 + k, [*r.sample(words, 20), *base[20:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    path = {x["doc_id"]: x["path_id"] for x in corpus_pipeline.pack(spark, df, "").collect()}
    assert len(path) == 80 and sum(path[k] == path[100 + k] for k in range(40)) >= 38


def test_packing_leaves_no_ends_of_like_texts_apart(spark):
    """No two paths are left of which ends agree in a slot of their sketches: what a chain's neighbours leave is joined too."""
    import numpy as np
    import public_tokenizers
    from chronotile.llm import packing

    r = random.Random(19)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(400)]
    bases = [r.sample(words, 40) for _ in range(6)]
    rows = [(k, " ".join([*r.sample(bases[k % 6], 25), *r.sample(words, 10)])) for k in range(120)]
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = packing.common.materialize(packing.tokenized(df, tokenizer).withColumn("tid", packing.F.monotonically_increasing_id()), "ids")
    sketch = {x["tid"]: np.frombuffer(x["sketch"], np.uint64).tolist() for x in made.collect()}
    for greedy in (30, 10**6):
        got = packing.path_places(made, 3, greedy).collect()
        assert len(got) == len({x["tid"] for x in got}) == 120
        at = defaultdict(set)
        for x in got:
            if x["pos"] in (0, x["n"] - 1):
                for slot, value in enumerate(sketch[x["tid"]]):
                    at[slot, value].add(x["path"])
        assert max(map(len, at.values())) == 1


def test_packing_moves_ids_once(spark, monkeypatch):
    """Ids are shuffled once, and paths and their texts' order are those that a join gives."""
    import public_tokenizers
    from chronotile.llm import packing

    monkeypatch.setattr(packing, "PART", 4000)
    r = random.Random(23)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(300)]
    rows = [(k, " ".join(r.sample(words, 40))) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = []
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for ranked in (10**6, 0):
            monkeypatch.setattr(packing, "RANKED", ranked, raising=False)
            made = packing.pack(df, public_tokenizers.path("word_bpe_49k.json"))
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            paths = defaultdict(list)
            for x in sorted(made.collect(), key=lambda x: (x["sequence_id"], x["offset"])):
                paths[x["path_id"]].append((x["doc_id"], x["start"] == 0, x["doc_tokens"]))
            assert {d for each in paths.values() for d, *_ in each} == set(range(150))
            got.append((plan.count("Join"), sorted(sorted({d for d, *_ in each}) for each in paths.values())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert got[0][0] == 0 and got[1][0] == 1 and got[0][1] == got[1][1]
