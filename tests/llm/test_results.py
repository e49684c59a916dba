"""Results against brute force, exact round trips and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

pytest.importorskip("chronotile.llm")

import public_tokenizers  # noqa: E402
import xxhash  # noqa: E402

from chronotile.llm import bpe, common, exact, licenses, lines, near, packing, quality, suffixtree, toxicity  # noqa: E402

rnd = random.Random(4)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


def corpus():
    """Prose with exact copies, near copies of every closeness, shared passages and repeated lines."""
    r = random.Random(9)
    texts = []
    shared = [" ".join(prose(60, 1000 + k)) for k in range(3)]
    for k in range(120):
        words = prose(r.randint(6, 220), k)
        sections = [" ".join(words[i : i + 15]) for i in range(0, len(words), 15)]
        if k % 5 == 0:
            sections.insert(r.randint(0, len(sections)), shared[k % 3])
        texts.append("\n".join(sections))
    for k in range(80):
        words = texts[r.randrange(120)].split(" ")
        for _ in range(r.randint(0, max(1, len(words) // 15))):
            words[r.randrange(len(words))] = r.choice(VOCABULARY)
        texts.append(" ".join(words))
    texts += [texts[0]] * 20 + ["", None, "a", "A"]
    ids = list(range(1, len(texts) + 1))
    r.shuffle(ids)
    return list(zip(ids, texts, strict=True))


CORPUS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string").repartition(5)


def test_near_classes(docs):
    sets = {i: set(near.shingles((t or "").encode()).tolist()) for i, t in CORPUS}
    text = {i: t or "" for i, t in CORPUS}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (text[a] == text[b] or x and y and len(x & y) >= 0.8 * max(len(x), len(y))):
                parent[root(a)] = root(b)
    true = defaultdict(set)
    for i in ids:
        true[root(i)].add(i)
    rows = near.groups(docs).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["class_id"]].add(r["doc_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, true.values()))
    assert all(c == max(m) for c, m in got.items())
    assert all(r["class_size"] == len(got[r["class_id"]]) and r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    assert sorted(r["doc_id"] for r in near.dedup(docs).collect()) == sorted(got)


def test_near_tuning():
    """Every search meets what it searches in: each of its postings is one that the sets of that partition post too."""
    for n in (1, 4, 5, 9, 100, 12345):
        k = near.partition(n)
        for m, (bands, rows) in near.searches(k).items():
            own = [(a, b) for part, r, a, b, flags in near.tables(m) if part == m and r == rows and flags & near.HELD]
            assert set(range(bands)) <= {i for a, b in own for i in range(a, b)}
    assert near.jaccard(100, 100) == pytest.approx(2 / 3)
    bands, rows = near.banding(2 / 3)
    assert (1 - (2 / 3) ** rows) ** bands <= near.MISS


def test_packing(docs, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in CORPUS}
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        of_doc[r["doc_id"]].append(r)
        of_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(part) > 0 and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(b"".join(n.to_bytes(4, "little") for n in part))
    for i, each in of_doc.items():
        each.sort(key=lambda r: r["start"])
        assert [r["start"] for r in each] == [sum(x["length"] for x in each[:k]) for k in range(len(each))]
        assert sum(r["length"] for r in each) == len(ids[i])
    assert set(of_doc) == set(ids)
    for each in of_sequence.values():
        each.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in each] == [sum(x["length"] for x in each[:k]) for k in range(len(each))]
        n = sum(r["length"] for r in each)
        assert n <= 2048 and n & (n - 1) == 0  # full, or a power of two: no padding at all


def test_packing_parts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    r = random.Random(3)
    some = ["a", "B", "É", "J̌", "ß", "Σ", "'s", "'", "don't", " ", "\n", "\t", " ", "1", "23", "!!", "漢", "😀", "İ", "<|endoftext|>", "ff", "́", "x.", "Y,", "-"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 40))) for _ in range(400)]
    for x, ids in zip(texts, packing.Ids(path)([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_sketches_equal_single_texts():
    import numpy as np

    r = np.random.default_rng(3)
    texts = [r.integers(0, 50_000, n).astype("<u4") for n in (1, 2, 3, 700, 1, 4, 90)]
    odd, n = packing._ODD, packing.TRIPLES
    for x, got in zip(texts, packing.sketches(texts), strict=True):
        x = x.astype(np.uint64) + np.uint64(1)
        t = np.array([x[k] * odd[-1] + x[k + 1] * odd[-2] + x[k + 2] * odd[-3] for k in range(len(x) - 2)] or [x[0]], np.uint64)
        t, one = t ^ (t >> np.uint64(31)), x * odd[-1]
        one ^= one >> np.uint64(29)
        assert got.tolist() == [int((t * m).min()) for m in odd[:n]] + [int((one * m).min()) for m in odd[n:-3]]


def test_paths_prefer_low_degrees_and_similar():
    graph = [{1: 3, 2: 1}, {0: 3, 2: 5}, {0: 1, 1: 5, 3: 2}, {2: 2}]
    assert packing.paths(graph) == [[3, 2, 1, 0]]
    assert packing.paths([{}, {}]) == [[0], [1]]


def test_bpe_equals_tiktoken(docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    codec = bpe.Codec(path, public_tokenizers.PATTERN)
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.v.ranks, special_tokens={})
    r = random.Random(1)
    some = ["a", "aa", "b", "\n", " ", "  ", "\t", "é", "ab", "the", "ing", "0", "漢", "😀", "'ll", " ", "."]
    for _ in range(300):
        x = "".join(r.choice(some) for _ in range(r.randint(0, 60)))
        ids = e.encode_ordinary(x)
        assert codec.encode(x) == ids
        assert codec.digests([x])[0] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(x.encode()).hexdigest())
    words = [x.encode() for x in VOCABULARY] + [b"a" * 3000, b"ab" * 500, b""]
    assert bpe.replay(words, codec.v) == [codec.v.plain(w) if w else [] for w in words]
    text = dict(CORPUS)
    for row in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect():
        x = text[row["doc_id"]] or ""
        assert row["n_tokens"] == len(e.encode_ordinary(x)) and row["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest()


def _line_hash(x):
    v = xxhash.xxh64_intdigest(x.encode(), 42)
    return v - (1 << 64) if v >> 63 else v


def test_lines(docs):
    word = re.compile(r"[^ \t-\r]+")
    each = [(i, [x for x in (t or "").split("\n") if word.search(x)]) for i, t in sorted(CORPUS)]
    hashes = {i: [_line_hash(x) for x in ls] for i, ls in each}
    counts = {i: [len(word.findall(x)) for x in ls] for i, ls in each}
    first, prints, gone = {}, {}, defaultdict(set)
    for i, ls in each:
        h, w = hashes[i], lines.WINDOW
        prints[i] = {max(j for j in range(q, q + w) if h[j] == min(h[q : q + w])) for q in range(len(h) - w + 1)} | {j for j in range(len(h)) if 2 * counts[i][j] >= lines.LONG}
        for j in sorted(prints[i]):
            first.setdefault(h[j], (i, j))
    text = dict(each)
    for i, ls in each:
        h = hashes[i]
        found = set()
        for j in prints[i]:
            a, k = first[h[j]]
            if (a, k) == (i, j):
                continue
            g = hashes[a]
            beside = (j and k and h[j - 1] == g[k - 1]) or (j + 1 < len(h) and k + 1 < len(g) and h[j + 1] == g[k + 1])
            if beside or counts[i][j] >= lines.LONG:
                found.add((a, j - k))
        for a, away in found:
            p, end = max(0, away), min(len(ls), len(text[a]) + away)
            while p < end:
                q = p
                while q < end and ls[q] == text[a][q - away]:
                    q += 1
                n = sum(counts[i][p:q])
                if n >= lines.LONG or (q - p >= lines.WINDOW and n >= lines.SHORT):
                    gone[i] |= set(range(p, q))
                p = max(q, p + 1)
    assert sum(map(len, gone.values())) > 50
    for r in lines.dedup_lines(docs).collect():
        k, keep = -1, []
        for x in (r["text"] or "").split("\n"):
            k += (counted := bool(word.search(x)))
            if not (counted and k in gone[r["doc_id"]]):
                keep.append(x)
        assert r["n_removed"] == len(gone[r["doc_id"]]) and r["n_lines"] == len(text[r["doc_id"]])
        assert (r["cleaned"] or "") == "\n".join(keep)


def test_suffix_tree(docs):
    held = {i for i, _ in CORPUS if zlib.crc32(str(i).encode()) % 10 == 0}
    tokens = {i: [*(t or "").lower().split(), None] for i, t in CORPUS}
    c = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    rows = suffixtree.score(docs, common.bucket("doc_id", 10) == 0).collect()
    for r in rows:
        ws = tokens[r["doc_id"]]
        assert r["held_out"] == (r["doc_id"] in held) and r["train_tokens"] == n
        assert r["n_tokens"] == len(ws) and r["n_known"] == sum(w in c for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["score"] <= 0
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_suffix_tree_equals_plain(spark):
    """Scores of 200 texts in several stretches against counts of all runs and the definitions, one token at a time."""
    r = random.Random(21)
    texts = [(i, " ".join(r.choice(("a b c", "a b d", "x a b c d", "c d e", "e")) if r.random() < 0.6 else r.choice(VOCABULARY) for _ in range(r.randint(0, 60)))) for i in range(200)]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    said = {i: [None, *t.split(), ""] for i, t in texts}  # None: the begin
    depth, runs = suffixtree.DEPTH, Counter()
    for i, ws in said.items():
        if i not in held:
            runs.update(tuple(ws[k : k + n]) for n in range(1, depth + 2) for k in range(len(ws) - n + 1))
    words = {w[0]: n for w, n in runs.items() if len(w) == 1 and w[0] is not None}
    tokens, kinds = sum(words.values()), len(words)
    once, twice = (sum(n == k for n in words.values()) for k in (1, 2))
    d = min(0.95, max(0.05, once / (once + 2 * twice)))
    runs = {w: n for w, n in runs.items() if n >= suffixtree.P_MIN * tokens}
    follow = defaultdict(dict)
    for w, n in runs.items():
        if len(w) > 1:
            follow[w[:-1]][w[-1]] = n
    states = {}

    def p(context, x):
        if not context:
            return max(words[x] - d, 0) / tokens if words.get(x) else d * kinds / tokens
        q = p(context[1:], x)
        if context not in states:
            return q
        n, each = states[context]
        return max(each.get(x, 0) - d, 0) / n + (1 - sum(k - d for k in each.values()) / n) * q

    for context in sorted(follow, key=len):
        each, n = follow[context], runs.get(context, 0)
        told = {x: max(p(context[1:], x), 0) for x in each}
        rest, left = n - sum(each.values()), max(1e-12, 1 - sum(told.values()))
        if n >= sum(each.values()) and sum(k * math.log(k / n / told[x]) for x, k in each.items()) + (rest * math.log(rest / n / left) if rest else 0) >= suffixtree.GAIN * len(each):
            states[context] = (n, each)
    assert {len(c) for c in states} == {1, 2, 3, 4} and len(states) < len(follow)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    for row in suffixtree.score(df, common.bucket("doc_id", 10) == 0).collect():
        ws = said[row["doc_id"]]
        want = sum(math.log10(p(tuple(ws[max(0, k - depth) : k]), ws[k])) for k in range(1, len(ws)))
        assert row["score"] == pytest.approx(want, abs=1e-6)


def test_suffix_tree_keeps_what_occurs_twice(spark, monkeypatch):
    """In a corpus in which two occurrences are less than P_MIN, scores are those of the tree of all runs seen twice or more, and of texts that occur twice by far higher."""
    r = random.Random(22)
    texts = [(i, " ".join(f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 700)))) for i in range(600)]
    texts += [(1000 + i, texts[i][1]) for i in range(60)] + [(2000 + i, f"never{i} w1 w2 nor{i} w1") for i in range(40)]
    held = {i for i, _ in texts if zlib.crc32(str(i).encode()) % 10 == 0}
    depth, runs = suffixtree.DEPTH, Counter()
    said = {i: [suffixtree.BEGIN, *t.split(), suffixtree.END] for i, t in texts}
    for i, ws in said.items():
        if i not in held:
            runs.update(suffixtree.JOIN.join(ws[k : k + n]) for n in range(1, depth + 2) for k in range(len(ws) - n + 1))
    words = {w: n for w, n in runs.items() if suffixtree.JOIN not in w and w != suffixtree.BEGIN}
    tokens, once, twice = sum(words.values()), *(sum(n == k for n in words.values()) for k in (1, 2))
    assert suffixtree.P_MIN * tokens > 3
    tree = suffixtree.Tree(runs, tokens, len(words), d := once / (once + 2 * twice), 2)
    assert 0.05 < d < 0.95 and {c.count(suffixtree.JOIN) for c in tree.states} == set(range(depth))

    def p(ws, k):
        root = (words[ws[k]] - d) / tokens if ws[k] in words else d * len(words) / tokens
        for n in range(1, min(depth, k) + 1):
            if (state := tree.states.get(suffixtree.JOIN.join(ws[k - n : k]))) is not None:
                root = max(state[1].get(ws[k], 0) - d, 0) / state[0] + state[2] * root
        return root

    monkeypatch.setattr(suffixtree, "BLOCK", 64, raising=False)
    monkeypatch.setattr(suffixtree, "DEAL", 20_000, raising=False)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x for x in suffixtree.score(df, common.bucket("doc_id", 10) == 0).collect()}
    assert got.keys() == said.keys()
    for i, ws in said.items():
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(ws, k)) for k in range(1, len(ws))), abs=1e-6)


def test_suffix_tree_candidates_are_bounded_and_whole(spark, monkeypatch):
    """Every run with the share in all is a candidate, and there are no more of them than the bound says."""
    monkeypatch.setattr(suffixtree, "P_MIN", 0.02)
    r = random.Random(2)
    stretches = [Counter(r.choice("aaaabbbccd" + "efghijklmnop"[k : k + 6]) for _ in range(400)) for k in range(7)]
    rows = [(None, n, w, k) for c in stretches for w, k in c.items() if (n := sum(c.values())) and k >= 0.01 * n]
    got = {x[0] for x in suffixtree.candidates(spark.createDataFrame(rows, "chunk long, n_tokens long, word string, n long"), 2800).collect()}
    total = sum(stretches, Counter())
    assert {w for w, n in total.items() if n >= 0.02 * 2800} <= got and len(got) <= 2 / 0.02


def test_suffix_tree_distributions():
    """The listed symbols' and the others' probabilities sum to 1 in every state, and arrays agree with the tree."""
    import numpy as np

    runs = {"a": 50, "b": 30, " ": 10, "": 10, " \na": 10, "a\nb": 25, "a\n": 8, "b\na": 15, " \na\nb": 9, "a\nb\na": 12}
    tree = suffixtree.Tree(runs, tokens=100, kinds=5, discount=0.5, least=1, gain=0.0)
    predict = suffixtree.Predictor(tree)
    for context, (n, each, left) in tree.states.items():
        assert left + sum(k - 0.5 for k in each.values()) / n == pytest.approx(1)
        for x in each:
            s = [*context.split("\n"), x]
            symbols = np.array([predict.runs.symbols.get(w, 0) for w in s])
            if context.startswith(" "):
                root = np.array([tree.p("", w) for w in s[1:]])
                want = sum(math.log10(tree.p("\n".join(s[:k]), s[k])) for k in range(1, len(s)))
                assert predict(symbols, root) == pytest.approx(want)


def test_frequent_runs():
    import numpy as np

    r = random.Random(2)
    sequence = [r.choice([0, 0, 0, 1, 2, -1]) for _ in range(400)]
    for n, (at, counts) in enumerate(suffixtree.frequent_runs(np.array(sequence), 5), 1):
        true = Counter(tuple(sequence[i : i + n]) for i in range(len(sequence) - n + 1) if -1 not in sequence[i : i + n])
        assert {tuple(sequence[i : i + n]): k for i, k in zip(at.tolist(), counts.tolist(), strict=True)} == {g: k for g, k in true.items() if k >= 5}


def test_exact(docs):
    groups = defaultdict(list)
    for i, t in CORPUS:
        groups[t or ""].append(i)
    for r in exact.groups(docs).collect():
        mine = groups[dict(CORPUS)[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(mine), len(mine), r["doc_id"] == max(mine))
    assert sorted(r["doc_id"] for r in exact.dedup(docs).collect()) == sorted(map(max, groups.values()))


def test_misra_gries_bound(spark):
    r = random.Random(6)
    values = [f"hot{r.randrange(3)}" if r.random() < 0.5 else f"v{r.randrange(4000)}" for _ in range(9000)]
    summary = {}
    for at in range(0, len(values), 500):
        summary = exact.merge(summary, Counter(values[at : at + 500]), 50)
    true = Counter(values)
    assert len(summary) <= 50 and all(0 <= true[k] - n <= len(values) / 51 for k, n in summary.items())
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    assert {"hot0", "hot1", "hot2"} <= {x[0] for x in exact.heavy_hitters(df, "v").collect()}


def test_licenses():
    scan = licenses.Scanner().scan
    assert scan(b"Licensed under the Apache License, Version 2.0.")[5:] == ("apache-2.0", 0.75)
    assert scan(b"Licensed under the Apache License, Version 3.0.")[5:] == ("", 0.0)
    assert scan("© 2019 Jane Doe and others. All rights reserved".encode())[1:] == (1, 6, 6, "reserved", "copyright,reserved", 0.75)
    assert scan(b"the GNU General Public License and general  public-license, cc BY")[1:4] == (3, 2, 9)
    assert scan(b"general public license x cc by")[:7] == (6, 2, 0, 4, "cc-by,gpl", "cc-by,gpl", 0.5)
    assert scan(b"Licensed under CC BY-NC 4.0.")[4:] == ("cc-by", "cc-by,cc-by-nc-4.0", 0.75)
    mit = licenses.TEXTS["mit"][0].replace("[ including the next paragraph ] ", "").split()
    said = lambda *changes: " ".join(changes[1] if changes and k == changes[0] else w for k, w in enumerate(mit)).encode()
    assert scan(b"MIT License\n\nCopyright (c) 2020 Someone\n\n" + said())[5:] == ("mit", 1.0)
    assert all(scan(said(k, "altered"))[5:] == ("", 0.0) for k in (0, 5, 60, len(mit) - 1))
    assert scan(said()[: len(said()) // 2])[5:] == ("", 0.0)  # its beginning alone is no license
    assert scan(" ".join(licenses.TEXTS["0bsd"][0].replace("[ or ]", "/or").replace("{5}", "the author").split()).encode())[5:] == ("0bsd", 1.0)
    bsd = licenses.TEXTS["bsd-3-clause"][0].replace("{12}", "the copyright holder").replace("{8}", "the copyright holders and contributors").replace("{1}", "1")
    assert scan(bsd.encode())[5:] == ("bsd-3-clause", 1.0)
    assert scan(b"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.")[4:] == ("gpl", "gpl,gpl-3.0", 0.75)
    a = licenses.Automaton("licensed under [ the ] {2} license [ version {1} ]")
    assert a.end([b"licensed", b"under", b"any", b"good", b"license", b"version", b"2"], 0) == 7
    assert a.end([b"licensed", b"under", b"a", b"b", b"c", b"license"], 0) == -1
    # Automata and regular expressions accept the same.
    r = random.Random(8)
    words = sorted({w for each in licenses._ALL.values() for t in each for w in t.split() if w.isalnum()})[:60]
    for label, each in licenses._ALL.items():
        for t in each:
            a, p = licenses.Automaton(t), re.compile(licenses._pattern(t))
            for _ in range(30):
                said = [w for w in t.split() if w not in "[]," and "{" not in w and r.random() < 0.97]
                said = [w.lower().encode() for w in said]
                if r.random() < 0.5:
                    said.insert(r.randrange(len(said)), r.choice(words).encode())
                assert any(a.end(said, i) >= 0 for i in range(len(said))) == bool(p.search(f" {b' '.join(said).decode()} "))


def test_quality(docs, spark):
    r = random.Random(5)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c", b"dd"]) for _ in range(r.randint(0, 40))]
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        covered = {k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
        assert quality.repeated_words(words) == len(covered)
    assert quality.measure("é # *\n\né x #\né # *".encode()) == (8, 10, 5, 3, 1, 0)
    rows = quality.ledger(docs)
    table = {r["rule"]: r for r in quality.ablations(rows, "v1").collect()}
    bits = [r["fail_bits"] for r in rows.collect()]
    for rule, bit in quality.BIT.items():
        assert table[rule]["n_failed"] == sum(b & bit != 0 for b in bits) and table[rule]["n_alone"] == sum(b == bit for b in bits)
    kept = {r["doc_id"] for r in rows.filter(quality.kept("v1")).collect()}
    assert kept == {r["doc_id"] for r in quality.keep_good(docs).collect()}


def test_toxicity_equals_plain_kneser_ney():
    """The models over arrays against the recursion over byte strings; grams seen once count."""
    import numpy as np

    r = random.Random(7)
    texts = [([w.encode() for w in prose(30, 700 + k)], int(r.random() < 0.4)) for k in range(12)]
    top = [Counter(), Counter()]
    order = toxicity.ORDER
    spelled = lambda w: b"\xfe" + w + b"\xff"
    cut = lambda w: [spelled(w)[max(0, i + 1 - order) : i + 1] for i in range(1, len(w) + 2)]
    for ws, c in texts:
        for w in set(ws):
            top[c].update(cut(w))
    grams = {g for c in top for g in c}
    low, level = Counter(), grams
    for k in range(order, 1, -1):
        level = {g for g in (level | grams) if len(g) == k}
        low.update(g[1:] for g in level)
        level = {g[1:] for g in level}
    d, alphabet = toxicity.DISCOUNT, len({g[-1] for g in grams}) + 1

    def after(counts, h):
        return [n for g, n in counts.items() if g[:-1] == h]

    def shared(g):
        lower = shared(g[1:]) if len(g) > 1 else 1 / alphabet
        ns = after(low, g[:-1])
        return max(low[g] - d, 0) / sum(ns) + d * len(ns) / sum(ns) * lower if ns else lower

    def p(c, g):
        lower, ns = shared(g[1:]), after(top[c], g[:-1])
        return max(top[c][g] - d, 0) / sum(ns) + d * len(ns) / sum(ns) * lower if ns else lower

    number = lambda g: int.from_bytes(g, "big")
    keys = sorted(grams)
    model = toxicity.Model(*(np.array(x) for x in ([number(g) for g in keys], [top[0][g] for g in keys], [top[1][g] for g in keys])))
    words = [b"", b"zzz", *texts[0][0][:6], *(w + b"ab" for w in texts[1][0][:4]), b"qa\xc3\xa9"]
    want = [sum(math.log(p(1, g) / p(0, g)) for g in cut(w)) for w in words]
    assert model.differences(words).tolist() == pytest.approx(want, abs=1e-9)
    total = {c: sum(p(c, b"\xfe" + words[2][:2] + bytes([x])) for x in {g[-1] for g in grams}) for c in (0, 1)}
    assert all(0.9 < x <= 1 + 1e-9 for x in total.values())


def test_toxicity_held_out(spark):
    """Toxic texts hold a few words with one of two stems; held-out texts are told apart."""
    r = random.Random(12)
    rows, labels = [], []
    for i in range(600):
        words = prose(r.randint(30, 120), 5000 + i)
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["zorq", "vexu"]) + r.choice(VOCABULARY)[:3])
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    df, named = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(df, named).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80 and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(df, named)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] == 0 for r in got)
