"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelled, one learned from toxic and one from ordinary texts, predict
each byte of a word from those before it (up to ORDER - 1, with the word's begin and end).
The highest order is a class's own; below it stand continuation counts that both classes share,
so that rare expressions are smoothed alike by both and tell little unless a class has
shown them; what was seen once counts as all else. A word's difference of log-likelihoods is a sum over its
bytes; a text's is that of its words, divided by their number. Beside this mean over the text, the
highest mean over a window of words, the means of its three and six most telling words and the
log of its length enter a logistic function, as a few toxic words tell little in the mean of a long text. It is fitted on
all labelled texts of the sample, each measured by models of the folds that it isn't in, and each class weighted by its share
of all labels.

Learning takes at most PER_CLASS labelled texts of each class (those of the smallest hash of the id):
a bounded sample, whatever the size of the corpus. Rows whose crc32(id as text) modulo 5
is 0 are never learned from. A null or empty text scores as the share of toxic texts in
the sample suggests; where nothing can be learned (no labels of either class) every
score is 0. Of several labels of one id a toxic one counts; null labels and ids don't.
A very long text counts as a whole. Rows that repeat are scored each on its own; an empty table gives no rows; an input column named like a result gives way.
"""

from __future__ import annotations

from collections import Counter
from heapq import nlargest
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ORDER, DISCOUNT, FOLDS = 6, 0.75, 4
FEATURES = ["mean", "window", "top3", "top6", "length"]
#: Labelled texts of each class that the models learn from, at most.
PER_CLASS = 4000
WINDOW = 32
#: Words whose difference a worker keeps.
MAX_KEPT = 300_000
#: No byte of UTF-8 text.
_BEGIN, _END = b"\xfe", b"\xff"
_STRIP = b".,;:!?\"'()[]{}#*$%&|<>-_=+/\\"

SCHEMA = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def words_of(text: bytes) -> list[bytes]:
    return [w.strip(_STRIP) for w in text.lower().split()]


def grams(words: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of each word and its end: the bytes before it (order - 1 at most, with the word's begin) and it, as one
    number; and where each word's begin. A gram's last byte is its lowest; zeros stand above shorter ones."""
    raw = np.frombuffer(b"".join([_BEGIN + w.replace(b"\0", b"\1") + _END for w in words]), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    since = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
    out = raw.copy()
    for k in range(1, order):
        out[k:] += np.where(since[k:] >= k, raw[:-k] << (8 * k), 0)
    return out[since > 0], np.concatenate([[0], np.cumsum(size - 1)])


def _width(gram: np.ndarray) -> np.ndarray:
    """The number of bytes of each gram."""
    return np.sum([gram >= 1 << (8 * k) for k in range(ORDER)], axis=0)


class Table:
    """Figures by key, in sorted arrays; 0 for other keys."""

    def __init__(self, keys: np.ndarray, *figures: np.ndarray) -> None:
        """Figures of equal keys are added up; beside them `kinds`, the rows of each key."""
        self.keys, first, self.kinds = np.unique(keys, return_index=True, return_counts=True)
        order = np.argsort(keys, kind="stable")
        at = np.concatenate([[0], np.cumsum(self.kinds)[:-1]]) if len(self.keys) else first
        self.figures = [np.add.reduceat(f[order], at) if len(f) else f for f in figures]

    def at(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; the number of keys where there is none."""
        place = np.searchsorted(self.keys, keys)
        there = place < len(self.keys)
        there[there] = self.keys[place[there]] == keys[there]
        return np.where(there, place, len(self.keys))

    @staticmethod
    def take(figures: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.append(figures, 0)[place]


class Model:
    """Two class models over shared lower orders, from grams and their ordinary and toxic counts."""

    def __init__(self, gram: np.ndarray, ordinary: np.ndarray, toxic: np.ndarray) -> None:
        self.top = Table(gram, ordinary, toxic)
        self.after = [Table(gram[n > 0] >> 8, n[n > 0]) for n in (ordinary, toxic)]  # by history: all that followed it, how many different
        # Shared: how many different bytes stand before a gram, from the highest order down.
        shorter, low = np.empty(0, np.int64), []
        for k in range(ORDER, 1, -1):
            level = np.unique(np.concatenate([gram[_width(gram) == k], shorter]))
            shorter = level & ((1 << (8 * (k - 1))) - 1)
            low.append(shorter)
        low = np.concatenate(low)
        self.low = Table(low, np.ones(len(low), np.int64))
        self.below = Table(self.low.keys >> 8, self.low.figures[0])
        self.alphabet = max(1, len(np.unique(gram & 255))) + 1

    def shared(self, gram: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The probability of each gram's last byte after the others, by continuation counts alone of `width` bytes at most."""
        p = np.full(len(gram), 1 / self.alphabet)
        for k in range(1, ORDER):
            g = gram & ((1 << (8 * k)) - 1)
            place = self.below.at(g >> 8)
            total = Table.take(self.below.figures[0], place)
            use = (k <= width) & (total > 0)
            seen = Table.take(self.low.figures[0], self.low.at(g))
            n = np.where(use, total, 1)
            p = np.where(use, np.maximum(seen - DISCOUNT, 0) / n + DISCOUNT * Table.take(self.below.kinds, place) / n * p, p)
        return p

    def ratios(self, gram: np.ndarray) -> np.ndarray:
        """log P(last byte | toxic) - log P(it | ordinary), after the others of each gram."""
        lower = self.shared(gram, _width(gram) - 1)
        top = self.top.at(gram)
        logs = []
        for c in (0, 1):
            place = self.after[c].at(gram >> 8)
            total = Table.take(self.after[c].figures[0], place)
            n = np.where(total > 0, total, 1)
            p = (np.maximum(Table.take(self.top.figures[c], top) - DISCOUNT, 0) + DISCOUNT * Table.take(self.after[c].kinds, place) * lower) / n
            logs.append(np.log(np.where(total > 0, p, lower)))  # both back off to the same
        return logs[1] - logs[0]

    def differences(self, words: list[bytes]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary)."""
        if not words:
            return np.empty(0)
        gram, at = grams(words)
        each, inverse = np.unique(gram, return_inverse=True)
        return np.add.reduceat(self.ratios(each)[inverse], at[:-1])


class Scorer:
    def __init__(self, model: Model, weights: list[float]) -> None:
        self.model, self.weights = model, weights
        self.known: dict[bytes, float] = {}

    def features(self, texts: list[bytes]) -> list[tuple[float, ...]]:
        """Of each text FEATURES: the mean difference of its words, the highest mean over WINDOW words, the means of the
        three and six highest of its different words, and the log of their number."""
        known, out = self.known, []
        if len(known) > MAX_KEPT:
            known.clear()
        split = [words_of(t) for t in texts]
        new = list({w for words in split for w in words if w not in known})
        for at in range(0, len(new), 20_000):
            known.update(zip(new[at : at + 20_000], self.model.differences(new[at : at + 20_000]).tolist(), strict=True))
        for words in split:
            if not words:
                out.append((0.0,) * len(FEATURES))
                continue
            d = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            total = np.concatenate([[0.0], np.cumsum(d)])
            w = min(WINDOW, len(d))
            most = float((total[w:] - total[:-w]).max()) / WINDOW
            top = nlargest(6, map(known.__getitem__, set(words)))
            out.append((float(d.mean()), most, sum(max(x, 0.0) for x in top[:3]) / 3, sum(max(x, 0.0) for x in top) / 6, log(len(d))))
        return out

    def scores(self, texts: list[bytes]) -> list[float]:
        z = self.weights[0] + np.array(self.features(texts)) @ np.array(self.weights[1:])
        return (1 / (1 + np.exp(-np.clip(z, -50, 50)))).tolist()


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> list[float]:
    """Coefficients (intercept first) of weighted rows by Newton's method, with a ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([0.0] + [ridge] * (x.shape[1] - 1)) * len(x) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[float]]:
    """(text, toxic, fold) of the labelled texts to learn from, and for each class how many labels one drawn stands for."""
    labels = labels.select(F.col("doc_id").alias("__id"), "toxic").filter("toxic in (0, 1) and __id is not null").filter(common.bucket("__id", 5) != 0)
    labels = common.materialize(labels.groupBy("__id").agg(F.max("toxic").alias("toxic")), "labels")
    drawn = [labels.filter(F.col("toxic") == c).orderBy(F.xxhash64("__id"), "__id").limit(PER_CLASS).collect() for c in (0, 1)]
    all_ = dict(labels.groupBy("toxic").count().collect())
    ids = docs.sparkSession.createDataFrame([tuple(r) for x in drawn for r in x], labels.schema)  # 2 * PER_CLASS rows at most
    common.release(labels)
    fold = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(ids), "__id").select("text", "toxic", fold.alias("fold"))
    return rows, [all_.get(c, 0) / max(1, len(drawn[c])) for c in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer | None:
    sample, stands_for = _sample(docs, labels, id_col, text_col)
    sample = common.materialize(sample.repartition(16, F.xxhash64("text")), "labelled")

    def count(batches):
        for batch in common.pieces(batches):
            seen: Counter = Counter()
            for text, toxic, fold in zip(common.texts(batch), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen.update((w, 2 * fold + toxic) for w in set(words_of(text)))  # a word counts once a text, however often it is repeated there
            words = list({w for w, _ in seen})
            gram, at = grams(words)
            keys, inverse = np.unique(gram, return_inverse=True)
            row = {w: k for k, w in enumerate(words)}
            counts = np.zeros((len(words), 2 * FOLDS), np.int64)
            for (w, k), n in seen.items():
                counts[row[w], k] = n
            sums = np.zeros((len(keys), 2 * FOLDS), np.int64)
            np.add.at(sums, inverse, np.repeat(counts, np.diff(at), axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(c) for c in sums.T)], names=["gram", *(f"c{k}" for k in range(2 * FOLDS))])

    columns = [f"c{k}" for k in range(2 * FOLDS)]
    rows = sample.mapInArrow(count, "gram long, " + ", ".join(f"{c} long" for c in columns)).groupBy("gram").agg(*[F.sum(c).cast("int").alias(c) for c in columns]).toArrow()  # bounded by the sample
    gram = rows.column("gram").to_numpy()
    order = np.argsort(gram)
    gram, counts = gram[order], np.column_stack([rows.column(c).to_numpy() for c in columns])[order].reshape(-1, FOLDS, 2)
    if not (counts.sum((0, 1)) > 0).all():
        return None
    sent = docs.sparkSession.sparkContext.broadcast((gram, counts))

    def measure(batches):
        common.enter("toxicity", _held.clear)
        own: tuple = (-1, None)
        for batch in common.pieces(batches):
            folds = batch.column(2).to_numpy()
            for k in np.unique(folds).tolist():
                if k != own[0]:
                    gram, counts = sent.value
                    kept = counts.sum(1) - counts[:, k]
                    some = kept.sum(1) > 0
                    own = (k, Scorer(Model(gram[some], kept[some, 0], kept[some, 1]), []))
                mine = batch.filter(pa.array(folds == k))
                made = own[1].features(common.texts(mine))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in zip(*made, strict=True)), mine.column(1)], names=[*FEATURES, "toxic"])

    measured = sample.repartition(FOLDS, "fold").sortWithinPartitions("fold").select("text", "toxic", "fold").mapInArrow(measure, ", ".join(f"{n} double" for n in FEATURES) + ", toxic int").collect()
    common.release(sample)
    fitted = np.array(sorted(tuple(r) for r in measured), float)
    if not len(fitted) or len(set(fitted[:, -1])) < 2:
        return None
    y = fitted[:, -1]
    weight = np.where(y > 0, stands_for[1], stands_for[0])
    total = counts.sum(1)
    scorer = Scorer(Model(gram, total[:, 0], total[:, 1]), logistic(fitted[:, :-1], y, weight / weight.mean()))
    scorer.counts = (gram, total[:, 0].astype(np.int32), total[:, 1].astype(np.int32))
    return scorer


def _scoring(docs: DataFrame, scorer: Scorer | None):
    if scorer is None:
        return lambda batch: {"score": [0.0] * len(batch)}
    sent = docs.sparkSession.sparkContext.broadcast((scorer.counts, scorer.weights))

    def work(batch: list[bytes]) -> dict:
        return {"score": _scorer(sent).scores(batch)}

    return work


_held: dict = {}


def _scorer(sent) -> Scorer:
    """The scorer of a broadcast, built once a worker."""
    common.enter("toxicity", _held.clear)
    if sent.value[1] != _held.get("weights"):
        _held.update(weights=sent.value[1], scorer=Scorer(Model(*sent.value[0]), sent.value[1]))
    return _held["scorer"]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without its text, with score (0 to 1) and predicted (1 from 0.5 on)."""
    scoring = _scoring(docs, fit(docs, labels, id_col, text_col))

    def work(batch: list[bytes]) -> dict:
        s = scoring(batch)["score"]
        return {"score": s, "predicted": [int(x >= 0.5) for x in s]}

    return common.map_texts(docs, work, SCHEMA, text_col)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under 0.5, with their own columns."""
    scoring = _scoring(docs, fit(docs, labels, id_col, text_col))
    return common.map_texts(docs, lambda batch: {"kept": [x < 0.5 for x in scoring(batch)["score"]]}, SCHEMA, text_col, keep="kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, common.table(spark, sf_dir, "labels"))
    return rows.select("doc_id", (common.bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
