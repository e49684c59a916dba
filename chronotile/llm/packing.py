"""Related-document packing.

Every text becomes token ids and an end id, with a sketch of its tokens and token triples. The ids are written to the shared
folder, so that they are made once. Of all texts those of the same value in a slot of their sketches are linked, each with
the next in order of a locality key, so that a slot adds one edge a text; an edge weighs by the slots that it has. From the
heaviest on, edges whose texts are ends of two different paths join these (of equals by a hash), until none is left that can.
Then the ends of paths are linked and joined in the same way, as a text's neighbours in a slot may lie inside paths by now while others of
its value are ends still, again and again until no two paths have ends of the same value in a slot.
Edges that are the heaviest of both their paths can be taken all at once, as no other comes before them: rounds of joins take them until
GREEDY edges are left at most, which one task goes through. Texts are dealt out by ranges of their paths' keys, and along the paths
sequences of SIZE tokens are filled, texts being cut where a sequence ends; the paths of a stretch are walked over by the sketches of
their first texts, from the one of the lowest degree on, each time to the most similar unvisited one. What is left at a task's end is cut
into powers of two, which need no padding.

A null or empty text is its end id alone. A text's own markers of special tokens become these tokens, as the library has it. A
very long text runs through as many sequences as it needs. Texts of equal keys come in the order of their ids. Every row
counts, rows that repeat too. An empty table gives no pieces. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZE, END = 2048, 1
TRIPLES, SINGLES = 8, 4
#: Bytes of ids that a task holds at a time, and that a partition has about.
STRETCH, PART = 8 << 20, 12 << 20
#: Of a large corpus partitions get longer, not more; what a task holds is a stretch all the same.
MOST_PARTS = 8192
#: Edges that one task goes through; while there are more, rounds of joins take all that can be taken at once.
GREEDY = 1_000_000
#: Texts of which the ranks along paths are broadcast (8 bytes each at most); of more, ids meet them in a join.
RANKED = 20_000_000
#: Rows of texts that a worker gets at a time; parts and pieces of which a worker keeps the ids, and their longest.
TEXT_ROWS = 2000
MAX_KEPT, MAX_WORD = 120_000, 64
#: None of these is a letter, a digit, an apostrophe or white space, or joins with a letter before it.
SIGNS = ".,;:!?()[]{}#*$%&|<>-_=+/@"

_ODD = np.random.default_rng(11).integers(1, 2**63, TRIPLES + SINGLES + 3, dtype=np.uint64) | np.uint64(1)
PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "path_id")]
)


class Ids:
    """Texts to ids (little-endian unsigned 32-bit), keeping what the parts between spaces and line ends became.

    The tokenizer lower-cases and never joins letters with signs, so a part of letters and signs after
    them is its word (in lower case, if ASCII) and its signs, each encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        vocabulary = self.t.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for w, n in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _pieces(self, part: str) -> tuple[str, ...]:
        word = part.rstrip(SIGNS)
        if not word.isalpha() or "\u0130" in word:  # in lower case it ends in a mark, which joins with signs
            return (part,)
        if word.isascii():
            word = word.lower()
        return (word, part[len(word) :]) if len(word) < len(part) else (word,)

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """Each part's ids. The normalizer and the pre-tokenizer leave an ASCII word in lower case as it is, so the model gets it at once. Other
        words are encoded as one text and parted at the ids that end a word, if there are as many as words; else one by one."""
        model = self.t.model.tokenize
        made = {x: struct.pack(f"<{len(ids)}I", *[k.id for k in ids]) for x in parts if x.isascii() and x.isalpha() and x.islower() for ids in (model(x),)}
        words = [x for x in parts if x not in made and x.isalpha() and "\u0130" not in x]
        if words:
            ids = np.array(self.t.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(cuts) == len(words) and cuts[-1] == ids.nbytes:
                raw = ids.tobytes()
                made |= {x: raw[a:b] for x, a, b in zip(words, [0, *cuts[:-1]], cuts, strict=True)}
        others = [x for x in parts if x not in made] if len(made) < len(parts) else []
        each = self.t.encode_batch_fast(others, add_special_tokens=False) if others else []
        return made | {x: np.array(e.ids, "<u4").tobytes() for x, e in zip(others, each, strict=True)}

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        known, pieces = self.known, self.pieces
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_binary()).cast(pa.large_string()), "\n", " "), " ")
        coded = cut.values.dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = {p: self._pieces(p) for p in parts if p not in known}
        unseen = list({x for each in new.values() for x in each if x not in pieces})
        pieces |= self._encoded(unseen)
        known |= {p: b"".join([pieces[x] for x in each]) for p, each in new.items()}
        # Each text's parts and its end, as places among the different parts' ids.
        each = [*map(known.__getitem__, parts), END.to_bytes(4, "little")]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat = np.frombuffer(b"".join(each), "<u4")
        last = cut.offsets.to_numpy()[1:]
        at = np.insert(coded.indices.to_numpy().astype(np.int64), last, len(parts))
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        out = np.split(ids, ends[last + np.arange(len(last))])[:-1]
        for kept, fresh in ((known, list(new)), (pieces, unseen)):
            room = max(0, MAX_KEPT - (len(kept) - len(fresh)))  # the frequent ones come early
            for k, x in enumerate(fresh):
                if k >= room or len(x) > MAX_WORD:
                    del kept[x]
        return out


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


def sketches(texts: list[np.ndarray]) -> np.ndarray:
    """Of each text (one id at least) minima of hashes: TRIPLES of the token triples (of fewer tokens, of the first), SINGLES of the tokens."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.concatenate(texts).astype(np.uint64) + np.uint64(1)
    begins = np.cumsum(size) - size
    one = x * _ODD[-1]
    one ^= one >> np.uint64(29)
    t = x.copy()
    t[:-2] = x[:-2] * _ODD[-1] + x[1:-1] * _ODD[-2] + x[2:] * _ODD[-3]
    keep = np.arange(len(x)) - np.repeat(begins, size) < np.repeat(np.maximum(size - 2, 1), size)
    short = np.flatnonzero(size < 3)
    t[begins[short]] = x[begins[short]]
    t = t[keep]
    t ^= t >> np.uint64(31)
    firsts = np.concatenate([[0], np.cumsum(np.maximum(size - 2, 1))[:-1]])
    return np.column_stack([np.minimum.reduceat(t * m, firsts) for m in _ODD[:TRIPLES]] + [np.minimum.reduceat(one * m, begins) for m in _ODD[TRIPLES:-3]])


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, sketch, key). key sorts related texts together: by their rarest-hashing tokens, then a triple."""

    @common.trimmed
    def run(batches):
        common.enter("packing", _ids.cache_clear)
        for batch in common.pieces(batches, 2 << 20):
            ids = _ids(tokenizer)(common.texts(batch, "__text"))
            s = sketches(ids)
            keys = (s[:, TRIPLES] >> np.uint64(52) << np.uint64(51)) | (s[:, TRIPLES + 1] >> np.uint64(52) << np.uint64(39)) | (s[:, 0] >> np.uint64(25))
            wide = [4 if int(x.max()) > 65535 else 2 for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() if n == 4 else x.astype("<u2").tobytes() for x, n in zip(ids, wide, strict=True)], pa.binary()), pa.array(wide, pa.int32()), pa.array([x.tobytes() for x in s], pa.binary()), pa.array(keys.astype(np.int64), pa.int64())],
                names=["doc_id", "ids", "wide", "sketch", "key"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text")).mapInArrow(run, "doc_id long, ids binary, wide int, sketch binary, key long")


def neighbours(s: np.ndarray) -> list[dict[int, int]]:
    """For each row of sketches its neighbours and in how many slots they agree."""
    edges: list[np.ndarray] = []
    for c in range(s.shape[1]):
        order = np.argsort(s[:, c], kind="stable")
        same = s[order[1:], c] == s[order[:-1], c]
        edges.append(np.column_stack([order[:-1][same], order[1:][same]]))
    pairs = np.concatenate(edges) if edges else np.empty((0, 2), int)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    # Agreeing triples tell more than agreeing tokens.
    agree = (s[pairs[:, 0]] == s[pairs[:, 1]]) @ np.array([SINGLES + 1] * TRIPLES + [1] * SINGLES)
    out: list[dict[int, int]] = [{} for _ in range(len(s))]
    for (a, b), n in zip(pairs.tolist(), agree.tolist(), strict=True):
        out[a][b] = out[b][a] = n
    return out


def paths(graph: list[dict[int, int]]) -> list[list[int]]:
    """Greedy paths: each begins at the unvisited node of the lowest degree and goes on to the most
    similar unvisited neighbour (of equals the one of lower degree, then the first)."""
    seen = [False] * len(graph)
    begin = sorted(range(len(graph)), key=lambda i: (len(graph[i]), i))
    out = []
    for at in begin:
        if seen[at]:
            continue
        path = []
        while at is not None:
            seen[at] = True
            path.append(at)
            at = min((j for j in graph[at] if not seen[j]), key=lambda j: (-graph[at][j], len(graph[j]), j), default=None)
        out.append(path)
    return out


def fill(stream, size: int = SIZE, first: int = 0):
    """(doc, start, length, sequence, offset) of texts (doc, ids) put one after another into sequences of
    `size`; the last, partial one as sequences of powers of two."""
    sequence, offset, open_ = first, 0, []
    for doc, n, tag in stream:
        start = 0
        while start < n:
            take = min(n - start, size - offset)
            open_.append((doc, start, take, tag))
            start, offset = start + take, offset + take
            if offset == size:
                yield from _closed(open_, sequence)
                sequence, offset, open_ = sequence + 1, 0, []
    while open_:
        whole = 1 << (sum(x[2] for x in open_).bit_length() - 1)
        now, room = [], whole
        while room:
            doc, start, n, tag = open_.pop(0)
            take = min(n, room)
            now.append((doc, start, take, tag))
            if take < n:
                open_.insert(0, (doc, start + take, n - take, tag))
            room -= take
        yield from _closed(now, sequence)
        sequence += 1


def _closed(open_: list, sequence: int):
    at = 0
    for doc, start, n, tag in open_:
        yield doc, start, n, sequence, at, tag
        at += n


def _slots(batches):
    """A row for each slot of each text (tid, sketch, key)."""
    for batch in common.pieces(batches, 1 << 20):
        s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(batch.num_rows, -1)
        n = s.shape[1]
        again = [np.repeat(batch.column(c).to_numpy(), n) for c in (0, 2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(n, dtype=np.int32), len(s))), pa.array(s.ravel()), pa.array(again[1]), pa.array(again[0])], names=["slot", "value", "key", "tid"])


def _next(batches):
    """Of rows (slot, value, key, tid) in order each one and the next with its value, and what the slot adds to the edge; the first and the last row (end 0 and 1) for the neighbouring partitions."""
    part, names = TaskContext.get().partitionId(), ["a", "b", "w", "slot", "value", "part", "end"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    last = None
    border = lambda x, end: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((x[2], None, None, x[0], x[1], part, end), kinds, strict=True)], names=names)
    for batch in batches:
        if not batch.num_rows:
            continue
        slot, value, tid = (batch.column(c).to_numpy() for c in (0, 1, 3))
        if last is None:
            yield border((slot[0], value[0], tid[0]), 0)
        else:
            slot, value, tid = (np.concatenate([[x], y]).astype(y.dtype) for x, y in zip(last, (slot, value, tid), strict=True))
        same = np.flatnonzero((slot[1:] == slot[:-1]) & (value[1:] == value[:-1]))
        w = np.where(slot[same] < TRIPLES, SINGLES + 1, 1).astype(np.int32)
        n = len(same)
        yield pa.RecordBatch.from_arrays([pa.array(tid[same]), pa.array(tid[same + 1]), pa.array(w), *(pa.nulls(n, t) for t in kinds[3:])], names=names)
        last = slot[-1], value[-1], tid[-1]
    if last is not None:
        yield border(last, 1)


def edges(made: DataFrame, parts: int) -> DataFrame:
    """(a, b, w) of all texts (tid, sketch, key), a < b: those next to each other in slots, and by how much."""
    slots = made.select("tid", "sketch", "key").mapInArrow(_slots, "slot int, value long, key long, tid long")
    near = slots.repartitionByRange(parts, "slot", "value", "key", "tid").sortWithinPartitions("slot", "value", "key", "tid")
    found = common.materialize(near.mapInArrow(_next, "a long, b long, w int, slot int, value long, part int, end int"), "slots")
    # Two rows a partition: what the last of one and the first of the next have in common.
    rows = sorted(found.filter("part is not null").select("part", "end", "slot", "value", "a").collect())
    over = [(x.a, y.a, SINGLES + 1 if x.slot < TRIPLES else 1) for x, y in zip(rows[:-1], rows[1:], strict=True) if (x.end, y.end) == (1, 0) and (x.slot, x.value) == (y.slot, y.value)]
    each = found.filter("part is null").select("a", "b", "w").unionByName(made.sparkSession.createDataFrame(over, "a long, b long, w int"))
    out = common.materialize(each.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").cast("int").alias("w")), "edges")
    common.release(found)
    return out


_MOVED = "path long, to long, flip boolean, add long, size long, to_key long"


def joined(rows: list[np.ndarray]) -> list[tuple]:
    """What becomes of paths when edges are taken in their order: (path, to, flip, add, size, key of to). rows: of each edge
    both paths, its texts' places in these, the paths' sizes and keys."""
    pa_, pb_, ia, ib, na, nb, ka, kb = (x.tolist() for x in rows)
    root: dict[int, int] = {}
    size, key = {}, {}
    taken: dict[int, list[tuple[int, int, int]]] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for p, q, i, j, n, m, k, l in zip(pa_, pb_, ia, ib, na, nb, ka, kb, strict=True):
        own, other = taken.get(p, ()), taken.get(q, ())
        if (own and (len(own) == 2 or (n > 1 and own[0][0] == i))) or (other and (len(other) == 2 or (m > 1 and other[0][0] == j))):
            continue
        x, y = find(p), find(q)
        if x == y:
            continue
        root[x] = y
        size[p], size[q], key[p], key[q] = n, m, k, l
        taken.setdefault(p, []).append((i, q, j))
        taken.setdefault(q, []).append((j, p, i))
    out, done = [], set()
    for start in taken:
        if len(taken[start]) == 2 or start in done:
            continue
        at, chain, add, before, entry = start, [], 0, None, None
        while at is not None:
            done.add(at)
            on = next((x for x in taken[at] if x[1] != before), None)
            flip = entry != 0 if entry is not None else on[0] != size[at] - 1
            chain.append((at, flip, add))
            add += size[at]
            before, at, entry = (at, on[1], on[2]) if on else (at, None, None)
        out += [(p, start, flip, plus, add, key[start]) for p, flip, plus in chain]
    return out


def _greedy(batches):
    """joined() of all rows (pa, pb, ia, ib, na, nb, ka, kb, w, h, a, b) of a task, the heaviest first."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    column = lambda c: table.column(c).to_numpy()
    order = np.lexsort([column(c) for c in ("b", "a", "h", "w")])[::-1]
    moved = joined([column(c)[order] for c in ("pa", "pb", "ia", "ib", "na", "nb", "ka", "kb")])
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    columns = zip(*moved, strict=True) if moved else [[]] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["path", "to", "flip", "add", "size", "to_key"])


def path_places(made: DataFrame, parts: int, greedy: int | None = None) -> DataFrame:
    """(tid, path, pos, n, pkey) of all texts (tid, sketch, key): each one's path, its place there, the path's size and key. No two
    paths are left of which ends have a slot's value in common."""
    places = made.select("tid", F.col("tid").alias("path"), F.lit(0).cast("long").alias("pos"), F.lit(1).cast("long").alias("n"), F.col("key").alias("pkey"))
    total, todo, several = made.count(), made, parts
    first = True
    while (new := _taken(places, edges(todo, several), greedy)) is not None:
        if not first:
            common.release(places)
        places, first = new, False
        # In a slot a text has edges to its neighbours alone, and these may lie inside a path by now. So the ends of paths are chained anew. Where
        # those of several paths share a value, two of different paths are next to each other, so each pass joins some, until none are left.
        todo = made.join(places.filter("pos = 0 or pos = n - 1").select("tid"), "tid")
        several = max(1, min(parts, parts * todo.count() // max(1, total) + 1))
    return places


def _taken(places: DataFrame, open_: DataFrame, greedy: int | None) -> DataFrame | None:
    """places after the edges (a, b, w) that can be taken, the heaviest first; None if none can. It reads places only."""
    greedy = GREEDY if greedy is None else greedy
    held = False
    while True:
        ends = places.filter("pos = 0 or pos = n - 1")
        side = [ends.select(F.col("tid").alias(c), F.col("path").alias(f"p{c}"), F.col("pos").alias(f"i{c}"), F.col("n").alias(f"n{c}"), F.col("pkey").alias(f"k{c}")) for c in "ab"]
        live = common.materialize(open_.select("a", "b", "w").join(side[0], "a").join(side[1], "b").filter("pa <> pb").withColumn("h", F.xxhash64("a", "b")), "live")
        common.release(open_)
        open_ = live
        left = live.count()
        if not left:
            common.release(live)
            return places if held else None
        if left <= greedy:
            moved = live.repartition(1).mapInArrow(_greedy, _MOVED)
        else:
            each = F.struct("w", "h", "a", "b", "pa", "pb", "ia", "ib", "na", "nb", "ka", "kb")
            best = live.select(F.col("pa").alias("p"), each.alias("e")).unionByName(live.select(F.col("pb").alias("p"), each.alias("e"))).groupBy("p").agg(F.max("e").alias("e"))
            both = best.groupBy("e.a", "e.b").agg(F.count("*").alias("c"), F.first("e").alias("e")).filter("c = 2").select("e.*")
            moved = both.select(F.explode(F.array(
                F.struct(F.col("pa").alias("path"), F.col("pa").alias("to"), F.expr("ia <> na - 1").alias("flip"), F.lit(0).cast("long").alias("add"), F.expr("na + nb").alias("size"), F.col("ka").alias("to_key")),
                F.struct(F.col("pb").alias("path"), F.col("pa").alias("to"), F.expr("ib <> 0").alias("flip"), F.col("na").alias("add"), F.expr("na + nb").alias("size"), F.col("ka").alias("to_key")),
            )).alias("m")).select("m.*")
        new = places.join(common.materialize(moved, "moved"), "path", "left")
        new = new.select("tid", F.coalesce("to", "path").alias("path"), F.when(F.col("to").isNull(), F.col("pos")).when(F.col("flip"), F.expr("add + n - 1 - pos")).otherwise(F.expr("add + pos")).alias("pos"), F.coalesce("size", "n").alias("n"), F.coalesce("to_key", "pkey").alias("pkey"))
        before, places = places, common.materialize(new, "places")
        if held:
            common.release(before)
        held = True
        if left <= greedy:
            common.release(live)
            return places


@common.trimmed
def _pack(batches):
    base = TaskContext.get().partitionId() << 32
    held: dict[int, tuple] = {}
    number = 0
    done: list[tuple] = []

    def stretch(rows):
        nonlocal number
        firsts = [k for k in range(len(rows)) if not k or rows[k][4] != rows[k - 1][4]]
        graph = neighbours(np.array([np.frombuffer(rows[k][3], np.uint64) for k in firsts]))
        for walk in paths(graph):
            for i in walk:
                for doc, raw, wide, _, path in rows[firsts[i] : firsts[i + 1] if i + 1 < len(firsts) else len(rows)]:
                    ids = np.frombuffer(raw, "<u2" if wide == 2 else "<u4")
                    held[number] = (doc, ids)
                    number += 1
                    yield number - 1, len(ids), path

    def stream():
        rows, size = [], 0
        for batch in common.pieces(batches, STRETCH):
            for r in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                rows.append(r)
                size += len(r[1]) + 100
                if size >= STRETCH:
                    yield from stretch(rows)
                    rows, size = [], 0
        if rows:
            yield from stretch(rows)

    def out():
        columns = [list(c) for c in zip(*done, strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=PIECES.fieldNames())

    for k, start, n, sequence, offset, path in fill(stream()):
        doc, ids = held[k]
        done.append((doc, start, n, zlib.crc32(ids[start : start + n].astype("<u4").tobytes()), len(ids), base + sequence, offset, path))
        if start + n == len(ids):
            del held[k]
        if len(done) >= 10_000:
            yield out()
    if done:
        yield out()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all texts of docs in sequences. tokenizer: a file that each machine has at this path."""
    made = common.materialize(tokenized(docs, tokenizer, id_col, text_col).withColumn("tid", F.monotonically_increasing_id()), "ids", batch=TEXT_ROWS)
    size = made.agg(F.sum(F.length("ids"))).first()[0] or 0
    parts = max(1, min(size // PART, MOST_PARTS))
    places = path_places(made, parts)
    if (total := places.count()) <= RANKED:
        return _ranked(made, places, total, parts).mapInArrow(_pack, PIECES)
    placed = made.drop("key").join(places.select("tid", "path", "pos", "pkey"), "tid")
    near = placed.repartitionByRange(parts, "pkey", "path", "pos").sortWithinPartitions("pkey", "path", "pos")
    return near.select("doc_id", "ids", "wide", "sketch", "path").mapInArrow(_pack, PIECES)


def _ranked(made: DataFrame, places: DataFrame, total: int, parts: int) -> DataFrame:
    """(doc_id, ids, wide, sketch, path) of made's texts along their paths, dealt over the parts. A text's rank and place in its path are broadcast,
    packed, so that its ids move once."""
    spark = made.sparkSession
    order = common.materialize(places.orderBy("pkey", "path", "pos").select("tid", "pos", F.monotonically_increasing_id().alias("id")), "order")
    sizes = dict(order.groupBy(F.shiftright("id", 33).cast("int")).count().collect())
    begins = np.array([sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)], np.int64)

    def packed(table: pa.Table) -> pa.Table:
        tid, pos, id_ = (table.column(c).to_numpy() for c in ("tid", "pos", "id"))
        by = np.argsort(tid)
        rank = begins[id_ >> 33] + (id_ & ((1 << 33) - 1))
        data = pa.compress(rank[by].astype("<u4").tobytes() + pos[by].astype("<u4").tobytes(), codec="zstd", asbytes=True)
        return pa.table({"source": tid[:1] >> 33, "n": [len(tid)], "data": pa.array([data], pa.binary())})

    found = order.groupBy(F.shiftright("tid", 33)).applyInArrow(packed, "source long, n long, data binary").collect()
    sent = spark.sparkContext.broadcast({x["source"]: (x["n"], bytes(x["data"])) for x in found})
    common.release(order)

    def attach(batches):
        at, rank, pos = -1, None, None
        for batch in common.pieces(batches):
            tid = batch.column(4).to_numpy()
            own, first = np.empty(len(tid), np.int64), np.empty(len(tid), np.int64)
            for source in np.unique(tid >> 33).tolist():
                if source != at:
                    n, raw = sent.value[source]
                    rank, pos = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), "<u4").reshape(2, -1).astype(np.int64)
                    at = source
                here = tid >> 33 == source
                own[here] = rank[tid[here] & ((1 << 33) - 1)]
                first[here] = own[here] - pos[tid[here] & ((1 << 33) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(first), pa.array(own), pa.array((own * parts // total).astype(np.int32))], names=["doc_id", "ids", "wide", "sketch", "path", "rank", "part"])

    rows = made.select("doc_id", "ids", "wide", "sketch", "tid").mapInArrow(attach, "doc_id long, ids binary, wide int, sketch binary, path long, rank long, part int")
    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("rank").select("doc_id", "ids", "wide", "sketch", "path")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
