"""Language-model scoring by a probabilistic suffix tree.

A text is a sequence of tokens: its words (A-Z lower-cased, between ASCII white space) and an end. The
alphabet is that of the training texts' tokens and one symbol for all others. The root
predicts a token by its share of the training tokens, less a discount that goes to the other
symbol. A context is the tokens before one (as far as the begin of the text), up to DEPTH. The
tree keeps those that at least `least` tokens follow and whose next-symbol distribution
diverges from that of the longest kept suffix, by GAIN nats for each symbol it lists, over all
its occurrences. It lists symbols that follow it `least` times, discounts them and leaves the
rest to the suffix's distribution. A token is predicted from the longest suffix that is a state. `least` is LEAST, in any
corpus; only in a small one, of fewer than LEAST / P_MIN tokens, runs seen once may count too: there it is P_MIN of the tokens.

Everything is counted over all training texts. A stretch of texts becomes a dictionary of its words and, for
each text, places in it; dictionaries meet by word, so that a word is counted once for the
corpus and its figures, with its rank by frequency, go back to the stretches. Then each token, held out or not, goes with the DEPTH
ones before it to the task of the word right before it. All contexts that end in a word, and so all their suffixes, meet in that task:
runs are counted there, states chosen from short to long, and tokens predicted; sums by text go back. So the tree is nowhere as a
whole and grows with the corpus. A task gets about MEET tokens, but those after one word are never parted.
A small corpus' tree is made in the driver, of (DEPTH + 1) / P_MIN runs at most: each stretch names and counts the runs with half
of P_MIN in it, and what these counts leave possible is counted everywhere.

A null or empty text is its end alone. Rows that repeat count and are scored each on its own; a null id
counts as a training row. An empty table gives no rows. Without training texts all scores are
0. A very long text is a stretch of its own and is scored as a whole. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from math import log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

DEPTH, P_MIN, GAIN = 4, 3e-5, 2.0
#: The fewest occurrences of a run that counts.
LEAST = 2
STRETCH = 8 << 20
#: Tokens that meet in a task, about, and those of texts that are dealt out at a time; texts whose sums go back together.
MEET, DEAL, BLOCK = 1_200_000, 1 << 20, 4096
#: Tokens, about, that a task holds against each other at a time.
SLICE = 1 << 18
#: Symbols: 0 is a word that isn't in training texts, FIRST the begin of a text, FIRST + c a word seen c < LEAST times, and more than LEAST + FIRST - 1 the others by rank.
FIRST = 1
#: The end of a text, and the mark before its first word; no word is empty or holds white space.
END, BEGIN, JOIN = "", " ", "\n"
_K = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def frequent_runs(sequence: np.ndarray, least: float, depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each length from 1 to depth + 1: first positions and counts of the different runs that occur `least` times
    or more. Negative numbers separate texts. A run is looked at where both runs one shorter are frequent."""
    values, inverse, counts = np.unique(sequence, return_inverse=True, return_counts=True)
    ok = (values >= 0) & (counts >= least)
    rank = np.where(ok, np.cumsum(ok) - 1, -1)[inverse]
    out = []
    for _ in range(depth + 1):
        at = np.flatnonzero(rank >= 0)
        if not len(at):
            break
        _, first, counts = np.unique(rank[at], return_index=True, return_counts=True)
        out.append((at[first], counts))
        both = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
        if not len(both):
            break
        keys, inverse, counts = np.unique(rank[both] * (len(first) + 1) + rank[both + 1], return_inverse=True, return_counts=True)
        ok = counts >= least
        rank = np.full(len(rank) - 1, -1)
        rank[both] = np.where(ok, np.cumsum(ok) - 1, -1)[inverse]
    return out


class Runs:
    """Runs of symbols, looked up by a hash of 64 bits."""

    def __init__(self, runs: list[str]) -> None:
        self.runs = runs
        split = [r.split(JOIN) for r in runs]
        self.symbols = {w: k for k, w in enumerate(sorted({w for r in split for w in r}), 1)}
        hashes = np.array([self.hash([self.symbols[w] for w in r]) for r in split], np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    @staticmethod
    def hash(numbers: list[int]) -> int:
        h = 0
        for n in numbers:
            h = ((h + n) * int(_K)) % (1 << 64)
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of the runs; -1 where there is none."""
        if not len(self.sorted):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


class Tree:
    """What of counted runs become states, and the figures to predict from them."""

    def __init__(self, counts: dict[str, int], tokens: int, kinds: int, discount: float, least: float, gain: float = GAIN) -> None:
        """counts: of runs of symbols; tokens, kinds: all and different training tokens."""
        self.tokens, self.kinds, self.discount = tokens, kinds, discount
        counts = {r: n for r, n in counts.items() if n >= least}
        follow: dict[str, dict[str, int]] = {}
        for r, n in counts.items():
            context, _, x = r.rpartition(JOIN)
            if JOIN in r and x != BEGIN:
                follow.setdefault(context, {})[x] = n
        self.counts = {r: n for r, n in counts.items() if JOIN not in r}
        self.states: dict[str, tuple[int, dict[str, int], float]] = {}  # context -> occurrences, of each listed symbol, share left
        for context in sorted(follow, key=lambda c: c.count(JOIN)):
            n, each = counts.get(context, 0), follow[context]
            if n < sum(each.values()):
                continue
            told = {x: self.p(context.partition(JOIN)[2], x) for x in each}
            rest, left = n - sum(each.values()), max(1e-12, 1 - sum(told.values()))
            gained = sum(k * log(k / n / told[x]) for x, k in each.items()) + (rest * log(rest / n / left) if rest else 0.0)
            if gained >= gain * len(each):
                self.states[context] = (n, each, 1 - sum(k - discount for k in each.values()) / n)

    def p(self, context: str, x: str) -> float:
        """The probability of a listed symbol after a context (of any length; empty: none)."""
        if not context:
            return max(self.counts.get(x, 0) - self.discount, self.discount) / self.tokens
        shorter = self.p(context.partition(JOIN)[2], x)
        if (state := self.states.get(context)) is None:
            return shorter
        return max(state[1].get(x, 0) - self.discount, 0) / state[0] + state[2] * shorter


class Predictor:
    """A tree's figures as arrays: log10 probabilities of whole sequences."""

    def __init__(self, tree: Tree, depth: int = DEPTH) -> None:
        self.depth = depth
        pairs = [(c, x, k / state[0], state[0]) for c, state in tree.states.items() for x, k in state[1].items()]
        self.runs = Runs([f"{c}{JOIN}{x}" for c, x, _, _ in pairs])
        self.share = np.array([max(k - tree.discount / n, 0) for _, _, k, n in pairs])
        self.contexts = Runs(list(tree.states))
        self.contexts.symbols = self.runs.symbols
        again = np.array([Runs.hash([self.runs.symbols[w] for w in c.split(JOIN)]) for c in tree.states], np.uint64)
        self.contexts.order = np.argsort(again)
        self.contexts.sorted = again[self.contexts.order]
        self.left = np.array([s[2] for s in tree.states.values()])

    def __call__(self, symbols: np.ndarray, root: np.ndarray) -> float:
        """symbols: of the begin, the words and the end (0: in no run); root: the tokens' probabilities without context."""
        p = root.copy()
        x = symbols.astype(np.uint64)
        h = np.zeros(len(x), np.uint64)
        ok = np.ones(len(x), bool)
        for d in range(1, self.depth + 1):
            # h[i]: hash of the d symbols before token i + d; built from the front, so begin anew for each d.
            if len(x) <= d:
                break
            h, ok = np.zeros(len(x) - d, np.uint64), np.ones(len(x) - d, bool)
            for k in range(d):
                h = (h + x[k : len(x) - d + k]) * _K
                ok &= symbols[k : len(x) - d + k] > 0
            at = np.flatnonzero(ok)
            state = self.contexts.find(h[at])
            at, state = at[state >= 0], state[state >= 0]
            if not len(at):
                continue
            listed = self.runs.find((h[at] + x[at + d]) * _K)
            q = np.where(listed >= 0, self.share[listed] if len(self.share) else 0.0, 0.0)
            p[at + d - 1] = q + self.left[state] * p[at + d - 1]
        return float(np.log10(p).sum())


def planes(at: np.ndarray) -> bytes:
    """Places as bytes, all lowest ones first, then the next: most of the upper ones are 0 and pack to nothing."""
    return at.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


_READ = T.StructType(
    [T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("word", T.StringType()), T.StructField("n", T.LongType())]
)


def _read(batches, named=False):
    """Of each stretch: a row for each text (the places of its words in the dictionary), one for each word
    (its place in `n_tokens`, its count in training texts in `n`), and, if named, one for each run that has half of P_MIN here (no chunk; its
    count here in `n`, the stretch's training tokens in `n_tokens`)."""
    base, number = TaskContext.get().partitionId() << 24, 0
    names, kinds = _READ.fieldNames(), [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.string(), pa.int64()]

    def close(rows):
        chunk = base + number
        place: dict[bytes, int] = {b"": 0}
        out = []
        for doc, held, text in rows:
            words = text.translate(_UPPER).split()
            for w in words:
                if w not in place:
                    place[w] = len(place)
            at = np.fromiter(map(place.__getitem__, words), np.uint32, len(words))
            out.append((chunk, doc, held, len(words) + 1, at))
        count = np.zeros(len(place), np.int64)
        for _, _, held, _, at in out:
            if not held:
                np.add.at(count, at, 1) if len(at) < 64 else count.__iadd__(np.bincount(at, minlength=len(count)))
                count[0] += 1
        names_ = [w.decode() for w in place]
        learned = [r[4] for r in out if not r[2]]
        runs, seen = [], []
        if learned and named:
            begin, between = len(place), np.array([-1], np.int64)
            sequence = np.concatenate([part for at in learned for part in (np.array([begin]), at.astype(np.int64), np.array([0]), between)])
            said = [*names_, BEGIN]
            for n, (first, counts) in enumerate(frequent_runs(sequence, P_MIN / 2 * count.sum()), 1):
                runs += [JOIN.join([said[w] for w in sequence[i : i + n]]) for i in first.tolist()]
                seen += counts.tolist()
        k, m, r = len(out), len(place), len(runs)
        columns = [
            [chunk] * (k + m) + [None] * r,
            [x[1] for x in out] + [None] * (m + r),
            [x[2] for x in out] + [None] * (m + r),
            [x[3] for x in out] + list(range(m)) + [int(count.sum())] * r,
            [planes(x[4]) for x in out] + [None] * (m + r),
            [None] * k + names_ + runs,
            [None] * k + count.tolist() + seen,
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows, size = [], 0
    for batch in common.pieces(batches):
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.texts(batch, "__text"), strict=True):
            rows.append(row)
            size += len(row[2]) + 200
            if size >= STRETCH:
                yield close(rows)
                rows, size, number = [], 0, number + 1
    if rows:
        yield close(rows)


def count_runs(docs: DataFrame, runs: Runs, depth: int = DEPTH) -> dict[str, int]:
    """How often each of the runs stands in the training texts of docs (held_out, __text)."""
    sent = docs.sparkSession.sparkContext.broadcast(runs)

    def count(batches):
        own = sent.value
        total = np.zeros(len(own.runs), np.int64)
        number = {w.encode(): k for w, k in own.symbols.items()}.get
        begin, end = own.symbols.get(BEGIN, 0), own.symbols.get(END, 0)
        for batch in common.pieces(batches, STRETCH // 2):
            numbers: list[int] = []
            for text in common.texts(batch, "__text"):
                numbers.append(begin)
                numbers += [number(w, 0) for w in text.translate(_UPPER).split()]
                numbers += (end, 0)
            x = np.array(numbers, np.uint64)
            h, ok = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
            for d in range(depth + 1):
                if len(x) <= d:
                    break
                h = (h[: len(x) - d] + x[d:]) * _K
                ok = ok[: len(x) - d] & (x[d:] > 0)
                found = own.find(h[ok])
                total += np.bincount(found[found >= 0], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["run", "n"])

    rows = docs.filter("not held_out").select("__text").mapInArrow(count, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).collect()
    return {runs.runs[r["run"]]: r["n"] for r in rows}


def candidates(read: DataFrame, tokens: int) -> DataFrame:
    """(word) of the runs that may have a share of P_MIN of all tokens. Where a stretch doesn't name a run, the run has less than half
    of P_MIN there; so one with P_MIN in all has half of P_MIN * tokens in the stretches that name it, at least, and no
    more than 2 * (DEPTH + 1) / P_MIN runs can, whatever the corpus."""
    named = read.filter("chunk is null").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_tokens").alias("there"))
    return named.filter(F.col("n") + P_MIN / 2 * (F.lit(tokens) - F.col("there")) >= P_MIN * tokens).select("word")


def _numbered(totals: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(word, c, symbol) of all words (word, n); and, of words in their order, where each count ends and which it is."""
    ranked = common.materialize(totals.orderBy(F.desc("n"), F.xxhash64("word")).select("word", F.col("n").alias("c"), F.monotonically_increasing_id().alias("id")), "ranked")
    part = F.shiftright("id", 33)
    sizes = dict(ranked.groupBy(part.cast("int")).count().collect())
    offsets = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    rank = F.array(*[F.lit(x).cast("long") for x in offsets])[part.cast("int")] + F.col("id").bitwiseAND((1 << 33) - 1)
    symbol = F.when(F.col("c") == 0, 0).when(F.col("c") < LEAST, FIRST + F.col("c")).otherwise(rank + FIRST + LEAST)
    steps = sorted(ranked.filter(F.col("c") >= LEAST).groupBy("c").count().collect(), reverse=True)
    return ranked.select("word", "c", symbol.cast("long").alias("symbol")), np.cumsum([k for _, k in steps], dtype=np.int64), np.array([c for c, _ in steps], np.int64)


def _known(x: np.ndarray) -> np.ndarray:
    """Whether symbols may be in runs."""
    return (x == FIRST) | (x >= FIRST + LEAST)


def _dealt(parts: int, most: int):
    """Of texts (tid, held_out, symbols) the tokens after a symbol that may be in runs, by the task of this symbol: packed arrays of
    the DEPTH symbols before, the nearest first, of the tokens, and of their texts' numbers from `first` on, twice and 1 more if held out."""

    def deal(rows):
        first = min(r[0] for r in rows)
        texts = [unplanes(r[2]) for r in rows]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat, at = np.zeros(int(size.sum()) + DEPTH * len(texts), np.uint32), 0
        token = np.zeros(len(flat), bool)
        for x in texts:
            flat[at + DEPTH - 1] = FIRST
            flat[at + DEPTH : at + DEPTH + len(x)] = x
            token[at + DEPTH : at + DEPTH + len(x)] = True
            at += DEPTH + len(x)
        token = np.flatnonzero(token)
        text = np.repeat(np.array([(r[0] - first) * 2 + bool(r[1]) for r in rows], np.uint32), size)
        said = np.where(_known(flat), flat, 0)
        here = said[token - 1] > 0
        token, text = token[here], text[here]
        part = ((said[token - 1].astype(np.uint64) * _K) >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort((part << np.uint64(32)) | said[token - 1], kind="stable")
        token, text, part = token[order], text[order], part[order]
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
        rows = [
            (int(part[a]), first, b - a, pa.compress(b"".join(planes(x) for x in (*(said[token[a:b] - k] for k in range(1, DEPTH + 1)), flat[token[a:b]], text[a:b])), codec="zstd", asbytes=True))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True)
        ]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "first", "n", "data"])

    @common.trimmed
    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if rows and (size >= most or not 0 <= row[0] - rows[0][0] < 1 << 30):
                    yield deal(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2]) // 4
        if rows:
            yield deal(rows)

    return run


def predicted(before: list[np.ndarray], x: np.ndarray, learn: np.ndarray, p: np.ndarray, discount: float, least: float, gain: float) -> np.ndarray:
    """The probability of each token x after symbols before it (the nearest first; 0: in no run), by the tree of those to learn from. Of each
    first symbol before, all tokens are given. p: the probabilities without context, which are changed. About SLICE tokens are held against each other at a
    time: all those of some contexts, or, where a context has more, first its own counts and then its longer contexts by themselves."""
    todo = [(np.arange(len(x), dtype=np.uint32), 0)]
    while todo:
        at, depth = todo.pop()
        at = at[before[depth][at] > 0]
        at = at[np.argsort(before[depth][at])]
        w = before[depth][at]
        begins = np.append(0, np.flatnonzero(w[1:] != w[:-1]) + 1)[: len(w)]
        sizes = np.diff(begins, append=len(at))
        cut = np.flatnonzero((np.diff(begins // SLICE, prepend=-1) > 0) | (sizes > SLICE) | np.append(False, sizes[:-1] > SLICE))
        for a, b, size in zip(begins[cut].tolist(), [*begins[cut[1:]].tolist(), len(at)], sizes[cut].tolist(), strict=False):
            own = at[a:b]
            if size <= SLICE:
                p[own] = _deeper([w[own] for w in before[depth:]], x[own], learn[own], p[own], discount, least, gain)
                continue
            if _alone(own, x, learn, p, discount, least, gain) and depth + 1 < len(before):
                todo.append((own.copy(), depth + 1))
    return p


def _states(of: np.ndarray, k: np.ndarray, told: np.ndarray, n: np.ndarray, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts of n occurrences are states, and their listed symbols' number and occurrences. of, k, told: of each listed symbol its
    context, its occurrences there and its probability after the shorter one."""
    total = lambda v: np.bincount(of, v, len(n))
    kinds, seen = np.bincount(of, minlength=len(n)), total(k)
    rest, left = n - seen, np.maximum(1e-12, 1 - total(told))
    gained = total(k * np.log(k / n[of] / told)) + np.where(rest > 0, rest * np.log(np.where(rest > 0, rest, 1) / np.maximum(n, 1) / left), 0)
    return (kinds > 0) & (gained >= gain * kinds), kinds, seen


def _alone(at: np.ndarray, x: np.ndarray, learn: np.ndarray, p: np.ndarray, discount: float, least: float, gain: float) -> bool:
    """The probabilities p of the tokens at these places become those after their context, which is one for all. Whether it is seen as often as counts."""
    each = np.unique(x[at])
    k, told = np.zeros(len(each), np.int64), np.zeros(len(each))
    for a in range(0, len(at), SLICE):
        own = at[a : a + SLICE]
        run = np.searchsorted(each, x[own])
        np.add.at(k, run[learn[own]], 1)
        told[run] = p[own]
    n = np.array([k.sum()])
    if n[0] < least:
        return False
    listed = (k >= least) & _known(each)
    state, kinds, seen = _states(np.zeros(int(listed.sum()), np.int64), k[listed], told[listed], n, gain)
    if state[0]:
        share = np.where(listed, np.maximum(k - discount, 0), 0.0) / n[0]
        left = 1 - (seen[0] - discount * kinds[0]) / n[0]
        for a in range(0, len(at), SLICE):
            own = at[a : a + SLICE]
            p[own] = share[np.searchsorted(each, x[own])] + left * p[own]
    return True


def _deeper(before: list[np.ndarray], x: np.ndarray, learn: np.ndarray, p: np.ndarray, discount: float, least: float, gain: float) -> np.ndarray:
    """predicted() of tokens that agree in the symbols nearer than those before; p: the probabilities after these, which are changed."""
    at, context = np.arange(len(x)), np.zeros(len(x), np.int64)
    for w in before:
        # A context that is seen fewer times than counts has no longer one either.
        at, context = at[w[at] > 0], context[w[at] > 0]
        _, context = np.unique((context << 32) | w[at], return_inverse=True)
        n = np.bincount(context[learn[at]], minlength=int(context.max(initial=-1)) + 1)
        often = n[context] >= least
        at, context = at[often], context[often]
        if not len(at):
            break
        each, run = np.unique((context << 32) | x[at], return_inverse=True)
        first = np.zeros(len(each), np.int64)
        first[run] = np.arange(len(run))  # any token of a run tells its context, symbol and probability so far
        k = np.bincount(run[learn[at]], minlength=len(each))
        listed = (k >= least) & _known(x[at[first]])
        state, kinds, seen = _states(context[first[listed]], k[listed], p[at[first[listed]]], n, gain)
        share = np.where(listed, np.maximum(k - discount, 0), 0.0)
        inside = state[context]
        i, c = at[inside], context[inside]
        p[i] = share[run[inside]] / n[c] + (1 - (seen[c] - discount * kinds[c]) / n[c]) * p[i]
    return p


def _spread(read: DataFrame, words: DataFrame, totals: DataFrame, tokens: int, kinds: int, discount: float, gain: float) -> DataFrame:
    """score() by tables: tokens meet by the word before them."""
    spark, block = read.sparkSession, BLOCK
    numbered, ends, counts = _numbered(totals)
    figures = words.select("chunk", "place", "word").join(numbered, "word").select("chunk", "place", "c", "symbol")
    texts = read.filter("word is null").select(F.col("chunk").alias("stretch"), "doc_id", "held_out", "n_tokens", "at")
    kept = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("alone", T.DoubleType()), T.StructField("symbols", T.BinaryType())])

    def roots(c):
        return np.where(c > 0, (c - discount) / tokens, discount * kinds / tokens)

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("place").to_numpy()
        c, symbol = np.zeros(len(at), np.int64), np.zeros(len(at), np.uint32)
        c[at], symbol[at] = right.column("c").to_numpy(), right.column("symbol").to_numpy()
        base, root, known = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1))), np.log10(roots(c)), _known(symbol)
        rows = []
        for raw in left.column("at").to_pylist():
            x = np.append(unplanes(raw), np.uint32(0))
            rows.append((int((c[x] > 0).sum()), float(base[x].sum()), float(root[x[1:]][~known[x[:-1]]].sum()), planes(symbol[x])))
        made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.float64(), pa.float64(), pa.binary()), strict=True)]
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), *made], names=kept.fieldNames())

    rows = common.materialize(texts.groupBy("stretch").cogroup(figures.groupBy("chunk")).applyInArrow(number, kept).withColumn("tid", F.monotonically_increasing_id()), "symbols", "zstd")
    for done in (read, totals, numbered):
        common.release(done)
    sent = spark.sparkContext.broadcast((ends, counts))

    @common.trimmed
    def meet(table: pa.Table):
        yield from _summed(table, *sent.value, roots, discount, gain, block)

    parts = max(spark.sparkContext.defaultParallelism, tokens // MEET)
    met = rows.select("tid", "held_out", "symbols").mapInArrow(_dealt(parts, DEAL), "part int, first long, n long, data binary").groupBy("part")
    sums = common.materialize(met.applyInArrow(lambda table: pa.Table.from_batches(list(meet(table)), _SUMS), "block long, data binary"), "sums")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        total = np.zeros(block)
        for raw in right.column("data").to_pylist():
            n = len(raw) // 10
            total[np.frombuffer(raw, "<u2", n)] += np.frombuffer(raw, "<f8", n, 2 * n)
        score = total[left.column("tid").to_numpy() % block] + left.column("alone").to_numpy()
        return pa.table([*(left.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array([tokens] * left.num_rows, pa.int64()), left.column("base_score"), pa.array(score)], names=_OUT.fieldNames())

    return rows.drop("symbols").withColumn("block", F.col("tid") - F.pmod("tid", F.lit(block))).groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(finish, _OUT)


_SUMS = pa.schema([("block", pa.int64()), ("data", pa.binary())])
_OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType())] + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")])


def _summed(table: pa.Table, ends: np.ndarray, counts: np.ndarray, roots, discount: float, gain: float, block: int):
    """The tokens' log10 probabilities, summed by text: of each block of texts their numbers there and the sums."""
    firsts, sizes = table.column("first").to_pylist(), table.column("n").to_pylist()
    columns, at = [np.empty(sum(sizes), np.uint32) for _ in range(DEPTH + 2)], 0
    for n, raw in zip(sizes, table.column("data"), strict=True):
        data = pa.decompress(raw.as_buffer(), 4 * n * (DEPTH + 2), codec="zstd", asbytes=True)
        for k, column in enumerate(columns):
            column[at : at + n] = unplanes(data[4 * n * k : 4 * n * (k + 1)])
        at += n
    *before, x, text = columns
    p = np.empty(len(x))
    for a in range(0, len(x), SLICE):
        own = x[a : a + SLICE].astype(np.int64)
        p[a : a + SLICE] = roots(np.where(own >= FIRST + LEAST, counts[np.minimum(np.searchsorted(ends, own - FIRST - LEAST, "right"), len(counts) - 1)] if len(counts) else 0, np.where(own > FIRST, own - FIRST, 0)))
    p = predicted(before, x, text % 2 == 0, p, discount, LEAST, gain)
    np.log10(p, out=p)
    text >>= 1
    blocks: list[int] = []
    data: list[bytes] = []
    for first, a, b in zip(firsts, np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        own = np.bincount(text[a:b], p[a:b])
        tid = np.flatnonzero(np.bincount(text[a:b]))
        own, tid = own[tid], tid + first
        cuts = [0, *(np.flatnonzero(np.diff(tid // block)) + 1).tolist(), len(tid)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            blocks.append(int(tid[i] // block * block))
            data.append((tid[i:j] % block).astype("<u2").tobytes() + own[i:j].astype("<f8").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], schema=_SUMS)


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", gain: float = GAIN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each of docs.
    held_out: a boolean column, true for texts that nothing is learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("__text"))
    read = common.materialize(docs.mapInArrow(common.trimmed(_read), _READ), "stretches", "zstd")
    words = read.filter("word is not null and chunk is not null").select("chunk", F.col("n_tokens").alias("place"), "word", "n")
    totals = common.materialize(words.groupBy("word").agg(F.sum("n").alias("n")), "words")
    stats = totals.agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("kinds"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).first()
    tokens, kinds = stats["tokens"] or 0, stats["kinds"]
    discount = min(0.95, max(0.05, stats["once"] / max(1, stats["once"] + 2 * stats["twice"]))) if stats["once"] else 0.5
    if P_MIN * tokens >= LEAST:
        return _spread(read, words, totals, tokens, kinds, discount, gain)
    named = docs.mapInArrow(lambda batches: _read(batches, True), _READ)
    runs = Runs(sorted(r[0] for r in candidates(named, tokens).collect()))
    tree = Tree(count_runs(docs, runs), max(1, tokens), kinds, discount, P_MIN * tokens, gain)
    sent = spark.sparkContext.broadcast(Predictor(tree))

    def number(batches):
        symbols = sent.value.runs.symbols
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([symbols.get(w, 0) for w in batch.column(0).to_pylist()], pa.int64())], names=["word", "c", "symbol"])

    figures = words.select("chunk", "place", "word").join(totals.mapInArrow(number, "word string, c long, symbol long"), "word").select("chunk", "place", "c", "symbol")
    texts = read.filter("word is null").select(F.col("chunk").alias("stretch"), "doc_id", "held_out", "n_tokens", "at")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("place").to_numpy()
        c, symbol = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        c[at], symbol[at] = right.column("c").to_numpy(), right.column("symbol").to_numpy()
        base = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
        root = np.where(c > 0, (c - discount) / max(1, tokens), discount * kinds / tokens if tokens else 1.0)
        predict = sent.value
        begin = predict.runs.symbols.get(BEGIN, 0)
        rows = []
        for raw in left.column("at").to_pylist():
            x = np.append(unplanes(raw), np.uint32(0))
            rows.append((int((c[x] > 0).sum()), tokens, float(base[x].sum()), predict(np.concatenate([[begin], symbol[x]]), root[x])))
        made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)]
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), *made], names=_OUT.fieldNames())

    return texts.groupBy("stretch").cogroup(figures.groupBy("chunk")).applyInArrow(finish, _OUT)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, common.bucket("doc_id", 10) == 0)
