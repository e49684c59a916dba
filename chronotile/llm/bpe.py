"""Byte-level BPE by merge replay.

Texts are split by the vocabulary's pattern. Of a stretch of the corpus (a batch of texts), each
distinct word that is not known yet is laid out once as a chain of tokens; an inverted index leads
from a merge to the places of its token pair, and the merges are applied to all words in the order
of their ranks, each touching only its places and their neighbours. What a word became is kept
(up to a bound) for later stretches of the same worker. Ids equal those of the tiktoken library.

A null or empty text has no ids; both digests are then those of the empty string. A very long text is encoded as a
whole, in a batch of its own; long words are encoded but not kept. Pairs of one rank merge from the left. Rows that
repeat are encoded each on its own; an empty table gives no rows; an input column named like a result gives way.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common

#: Words whose encoding a worker keeps; beyond, it starts afresh.
MAX_KEPT = 500_000
#: Bytes of longer words are encoded but not kept.
MAX_WORD = 64

SCHEMA = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


#: Places of one merge from which it is applied to all of them by array operations.
MANY = 12


class Vocabulary:
    """Ranks by bytes, bytes by rank, and the rank that each pair of tokens merges to."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.wide = max(ranks.values()) + 1
        self.pair = {ranks[t[:k]] * self.wide + ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.keys = np.array(sorted(self.pair), np.int64)
        self.to = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks that pairs merge to; -1 for none."""
        want = a * self.wide + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.to[at], -1)

    def plain(self, word: bytes) -> list[int]:
        """One word's ids: again and again the leftmost of its pairs of lowest rank."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        while len(ids) > 1:
            rank, at = min((self.pair.get(x * self.wide + y, self.wide), k) for k, (x, y) in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == self.wide:
                break
            ids[at : at + 2] = [rank]
        return ids


def replay(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """The ids of each word: merges in the order of rank, over all words at once."""
    raw = b"".join(words)
    n = len(raw)
    if not n:
        return [[] for _ in words]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    # By position, over all words: the token (-1 once merged into its left neighbour) and its neighbours (-1: none).
    tok = v.byte[np.frombuffer(raw, np.uint8)]
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    prv[begins[sizes > 0]] = -1
    nxt[ends[sizes > 0] - 1] = -1
    token, right, left = memoryview(tok), memoryview(nxt), memoryview(prv)
    merged, wide = v.pair.get, v.wide
    index: dict[int, list[int]] = {}  # merge -> positions of the left token of its pair
    todo: list[int] = []
    redo: list[int] = []  # positions in words where a merge of lower rank came up among places merged at once

    def note(at: np.ndarray, ranks: np.ndarray) -> None:
        """Put positions into the index, by the merges of their pairs."""
        if len(at) < 2 * MANY:
            for r, i in zip(ranks.tolist(), at.tolist(), strict=True):
                add(r, i)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, x in zip(ranks[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
            if r not in index:
                heapq.heappush(todo, r)
            index.setdefault(r, []).extend(x.tolist())

    def add(r: int, i: int) -> None:
        if r in index:
            index[r].append(i)
        else:
            index[r] = [i]
            heapq.heappush(todo, r)

    at = np.flatnonzero(nxt >= 0)
    ranks = v.lookup(tok[at], tok[nxt[at]])
    note(at[ranks >= 0], ranks[ranks >= 0])
    while todo:
        rank = heapq.heappop(todo)
        if (places := index.pop(rank, None)) is None:
            continue
        if len(places) >= MANY:
            i = np.sort(np.array(places))
            i = i[np.diff(i, prepend=-1) > 0]
            i = i[(tok[i] >= 0) & (nxt[i] >= 0)]
            i = i[v.lookup(tok[i], tok[nxt[i]]) == rank]
            if not len(i):
                continue
            j = nxt[i]
            if tok[i[0]] != tok[j[0]] or not (i[np.minimum(np.searchsorted(i, j), len(i) - 1)] == j).any():  # else pairs overlap, as in aaa, and go from the left
                k = nxt[j]
                tok[i], tok[j], nxt[i] = rank, -1, k
                after = k >= 0
                prv[k[after]] = i[after]
                h = prv[i]  # of pairs side by side (abab), the merged ones
                pairs = np.sort(np.concatenate([i[after], h[h >= 0]]))
                pairs = pairs[np.diff(pairs, prepend=-1) > 0]
                new = v.lookup(tok[pairs], tok[nxt[pairs]])
                pairs, new = pairs[new >= 0], new[new >= 0]
                redo += pairs[new < rank].tolist()
                note(pairs, new)
                continue
            places = i.tolist()
        else:
            places.sort()
        for nth, i in enumerate(places):
            a, j = token[i], right[i]
            if a < 0 or j < 0 or merged(a * wide + token[j]) != rank:
                continue  # a neighbour was merged meanwhile
            token[i], token[j] = rank, -1
            k = right[i] = right[j]
            lowest = rank
            if k >= 0:
                left[k] = i
                if (r := merged(rank * wide + token[k])) is not None:
                    add(r, i)
                    lowest = min(r, lowest)
            if (h := left[i]) >= 0 and (r := merged(token[h] * wide + rank)) is not None:
                add(r, h)
                lowest = min(r, lowest)
            if lowest < rank:  # a merge of lower rank has come up: it goes before the places that are left
                index[rank] = places[nth + 1 :]
                heapq.heappush(todo, rank)
                break
    alive = tok >= 0
    ids = tok[alive].tolist()
    upto = np.concatenate([[0], np.cumsum(alive)])
    out = [ids[a:b] for a, b in zip(upto[begins].tolist(), upto[ends].tolist(), strict=True)]
    for w in set(np.searchsorted(ends, redo, side="right").tolist()):
        out[w] = v.plain(words[w])
    return out


class Codec:
    """A vocabulary with what it has encoded so far.

    A space followed by another character than white space begins a match of the pattern, so a text
    can be cut before each such space and its parts encoded apart; `known` has the parts
    (without that space): their ids as text, the number of ids and the bytes they stand for.
    Where a part begins with white space, or is empty, the text is split by the pattern as a whole.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        with open(ranks_path, "rb") as f:
            self.v = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, bytes]] = {}

    def words(self, words: set[str]) -> dict[str, list[int]]:
        raw = {w: w.encode() for w in words}
        out = {w: [self.v.ranks[b]] for w, b in raw.items() if b in self.v.ranks}
        rest = [w for w in words if w not in out]
        return out | dict(zip(rest, replay([raw[w] for w in rest], self.v), strict=True))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.v.token[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        made = self.words(set(words := self.find(text)))
        return [i for w in words for i in made[w]]

    def split(self, part: str) -> list[str]:
        """The pattern's matches in a space and a part; letters alone, or before one sign, need no search."""
        if part.isascii():
            if part.isalpha():
                return [f" {part}"]
            if part[-1] in ".,;:!?" and part[:-1].isalpha():
                return [f" {part[:-1]}", part[-1]]
        return self.find(f" {part}")

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        cut = [t.split(" ") for t in texts]
        known = self.known
        new = {p for parts in cut for p in parts[1:] if p not in known}
        odd = {p for p in new if not p or p[0].isspace()}
        split = {p: self.split(p) for p in new - odd}
        first = {p: self.find(p) for p in {parts[0] for parts in cut}}
        whole = {k: self.find(texts[k]) for k, parts in enumerate(cut) if not odd.isdisjoint(parts[1:])} if odd else {}
        made = self.words({w for group in (split, first, whole) for words in group.values() for w in words})
        said = {w: (" ".join(map(str, ids)), self.decode(ids)) for w, ids in made.items()}

        def of(words: list[str]) -> tuple[str, bytes]:
            if len(words) == 1:
                return said[words[0]]
            return " ".join([said[w][0] for w in words]), b"".join([said[w][1] for w in words])

        known |= {p: of(words) for p, words in split.items()}
        out = []
        for k, parts in enumerate(cut):
            if k in whole:
                got = [of(whole[k])]
            else:
                got = [of(first[parts[0]]), *map(known.__getitem__, parts[1:])]
            ids, raw = zip(*got, strict=True)
            ids = " ".join(ids if ids[0] else ids[1:])  # an empty text has no ids
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()))
        room = MAX_KEPT - (len(known) - len(split))  # the frequent ones come early
        for p in list(split)[max(0, room) :]:
            del known[p]
        for p in list(split)[: max(0, room)]:
            if len(p) > MAX_WORD:
                del known[p]
        return out


@lru_cache(2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """docs without its text, with the columns of SCHEMA. ranks_path: a vocabulary file that each machine has at this path."""

    def work(batch: list[bytes]) -> dict:
        common.enter("bpe", _codec.cache_clear)
        rows = _codec(ranks_path, pattern).digests([t.decode() for t in batch])
        return dict(zip(SCHEMA.fieldNames(), map(list, zip(*rows, strict=True)), strict=True))

    return common.map_texts(docs, work, SCHEMA, text_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
