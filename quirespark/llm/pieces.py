"""Operator 4: SentencePiece encoding and decoding by suffix-array matching.

The words of a batch of texts (a word is cut where no piece goes on) are written one after the
other, all of them in their order, and indexed by a suffix array, sorted as deep as the longest
piece. Every piece of the vocabulary is searched in it by bisection, all pieces at once;
the range found holds its occurrences. Each occurrence is an edge between two positions.

A unigram model takes the best path: the edges are sorted by their position in the text
and relaxed, all texts of the batch at the same position together (its texts are not cut to
words, since the sums of 32-bit scores are those of whole texts); of equal paths the one whose
last edge begins first is kept, and an edge of one unknown character stands where no piece
of one character does. A byte-pair model is no best path but merges in order of rank: its
edges are sorted by word, rank and position, and in each round the best edge of every word that
spans two neighbouring symbols joins them, until none is left. Its words of more than LONG
characters keep their edges in a heap instead of taking rounds, in arrays of about 250 bytes
for each character of such a word. Both give the ids of the sentencepiece library.

The model (a fixed size) is read once by the driver from a path given by the caller, and
sent to the tasks. Only models without a normalization table are taken; others raise ValueError.

Defined cases: null and empty texts have no ids and decode to the empty text; characters
outside the vocabulary become bytes, or the unknown id if the model has no bytes, one for
each run; ids that are out of range raise IndexError in decoding; repeated rows are rows of
their own; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import steps, table, text_steps

#: A public model; the path is a parameter of every function here.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
LONG = 200
#: Characters that are indexed together, besides a longer word.
INDEX = 125_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Fixed values of the library: kinds of models, and how far below the least score an unknown character is.
UNIGRAM, BPE = 1, 2
PENALTY = 10.0


@dataclass
class Model:
    pieces: list[str]
    rank: np.ndarray  # by id: 0 is merged first; -1: never
    kinds: list[int]
    unknown: int
    dummy_prefix: bool
    score: np.ndarray | None = None  # by id, of unigram models

    def __post_init__(self) -> None:
        own = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        chars = sorted({c for i in own for c in self.pieces[i]})
        self.code = {c: n + 2 for n, c in enumerate(chars)}  # 0: between words, 1: in no piece
        self.single = np.full(len(chars) + 2, -1, np.int64)
        for i in own:
            if len(self.pieces[i]) == 1:
                self.single[self.code[self.pieces[i]]] = i
        self.longer = np.array([i for i in own if len(self.pieces[i]) > 1], np.int64)
        self.width = np.array([len(self.pieces[i]) for i in self.longer], np.int64)
        self.deep = -(-int(self.width.max(initial=1)) // 4)
        low = np.zeros((len(self.longer), 4 * self.deep), np.uint64)
        for n, i in enumerate(self.longer):
            low[n, : self.width[n]] = [self.code[c] for c in self.pieces[i]]
        high = np.where(np.arange(4 * self.deep) < self.width[:, None], low, np.uint64(0xFFFF))
        self.low, self.high = pack(low), pack(high)
        self.bytes = np.full(256, self.unknown, np.int64)
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes[int(self.pieces[i][1:-1], 16)] = i
        self.has_bytes = BYTE in self.kinds
        joined = {c for i in self.longer for c in self.pieces[i]}
        alone = "".join(re.escape(chr(i)) for i in range(128) if chr(i) not in joined)
        free = all(SPACE not in self.pieces[i].lstrip(SPACE) for i in self.longer)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+") if free and self.score is None else re.compile("(?s).+")
        table = np.zeros(0x110000, np.uint16)
        table[:] = 1
        for c, n in self.code.items():
            table[ord(c)] = n
        self.table = table
        self.text = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]


def load(path: str = MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.trainer_spec.model_type not in (UNIGRAM, BPE) or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and byte-pair models without normalization are taken")
    if any(p.type not in (1, 2, 3, 6) for p in m.pieces):
        raise ValueError("models with user-defined or unused pieces are not taken")
    score = np.array([p.score for p in m.pieces])
    normal = np.array([p.type == NORMAL for p in m.pieces])
    rank = np.full(len(score), -1, np.int64)
    _, dense = np.unique(-score[normal], return_inverse=True)  # equal scores are equal ranks
    rank[normal] = dense
    return Model([p.piece for p in m.pieces], rank, [p.type for p in m.pieces], m.trainer_spec.unk_id, m.normalizer_spec.add_dummy_prefix, score.astype(np.float32) if m.trainer_spec.model_type == UNIGRAM else None)


def pack(codes: np.ndarray) -> np.ndarray:
    """Rows of codes, 16 bits each, as rows of 64-bit words that sort alike."""
    c = codes.reshape(len(codes), -1, 4).astype(np.uint64)
    return c[..., 0] << np.uint64(48) | c[..., 1] << np.uint64(32) | c[..., 2] << np.uint64(16) | c[..., 3]


def suffixes(code: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the 4 * deep or more codes from there on, and the packed four codes at every position."""
    n = len(code)
    c = np.r_[code, np.zeros(4 * deep + 4, np.uint16)].astype(np.uint64)
    four = c[: n + 4 * deep] << np.uint64(48) | c[1 : n + 4 * deep + 1] << np.uint64(32) | c[2 : n + 4 * deep + 2] << np.uint64(16) | c[3 : n + 4 * deep + 3]
    order, have = np.argsort(four[:n]), 4
    key = four[:n]
    while have < 4 * deep:
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - have)] = rank[have:] + 1
        key = rank * (n + 1) + nxt
        order = np.argsort(key)
        have *= 2
    return order, four


def ranges(order: np.ndarray, four: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every pair of keys the number of suffixes below the low one, and of those not above the high one: by the first four codes, then by the rest."""
    firsts = four[order]
    lo, hi = np.searchsorted(firsts, low[:, 0]), np.searchsorted(firsts, high[:, 0], side="right")
    deep = np.nonzero((lo < hi) & (low[:, 1:] > 0).any(axis=1))[0]
    start, stop = lo[deep], hi[deep]
    lo[deep], hi[deep] = bisect(order, four, low[deep], start, stop, False), bisect(order, four, high[deep], start, stop, True)
    return lo, hi


def bisect(order: np.ndarray, four: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
    """For every key the number of suffixes below it (after: not above it), which lies between lo and hi."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.nonzero(lo < hi)[0]
    while open_.size:
        mid = (lo[open_] + hi[open_]) >> 1
        at, own = order[mid], keys[open_]
        less, same = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for d in range(1, keys.shape[1]):
            x = four[at + 4 * d]
            less |= same & (x < own[:, d])
            same &= x == own[:, d]
        if after:
            less |= same
        lo[open_], hi[open_] = np.where(less, mid + 1, lo[open_]), np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def edges(m: Model, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, number in m.longer) of every occurrence of every piece of two characters or more."""
    order, four = suffixes(code, m.deep)
    lo, hi = ranges(order, four, m.low, m.high)
    count = hi - lo
    piece = np.repeat(np.arange(len(lo)), count)
    return order[np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())], piece


def relax(m: Model, token: np.ndarray, nxt: np.ndarray, start: np.ndarray, piece: np.ndarray, word: np.ndarray) -> None:
    """Joins symbols by the edges, changing token (by position, -2 within a symbol) and nxt (position after a symbol)."""
    by = np.argsort((word * len(m.rank) + m.rank[m.longer[piece]]) * len(token) + start) if len(token) ** 2 * len(m.rank) < 1 << 63 else np.lexsort((start, m.rank[m.longer[piece]], word))
    start, piece, word = start[by], piece[by], word[by]
    end = start + m.width[piece]
    while start.size:
        mid = nxt[start]
        fits = np.nonzero(nxt[mid] == end)[0]
        if not fits.size:
            break
        w = word[fits]
        best = fits[np.r_[True, w[1:] != w[:-1]]]
        token[mid[best]] = -2
        token[start[best]] = m.longer[piece[best]]
        nxt[start[best]] = end[best]
        on = np.zeros(int(word[-1]) + 1, bool)
        on[word[best]] = True
        keep = np.nonzero(on[word] & (token[start] != -2) & (token[end] != -2) & (nxt[start] < end))[0]
        start, end, piece, word = start[keep], end[keep], piece[keep], word[keep]


def relax_long(m: Model, token: np.ndarray, nxt: np.ndarray, first: int, last: int, start: np.ndarray, piece: np.ndarray) -> None:
    """relax() for one long word, from first to last, by a heap of (rank, position); everything else is in arrays."""
    key = (start - first) << 32 | start - first + m.width[piece]
    by = np.argsort(key)
    keys, pieces = array("q", key[by].tobytes()), array("q", piece[by].tobytes())
    rank, n = m.rank[m.longer], last - first
    after, before = array("q", range(1, n + 2)), array("q", range(-1, n + 1))

    def at(a: int) -> int:
        """Number of the edge that spans the symbol at a and the next one; -1 if there is none."""
        b = after[a]
        if b >= n:
            return -1
        k = a << 32 | after[b]
        i = bisect_left(keys, k)
        return i if i < len(keys) and keys[i] == k else -1

    starts = np.nonzero(m.width[piece[by]] == 2)[0]
    heap = ((rank[piece[by][starts]] << 32) | (start[by][starts] - first)).tolist()
    heapq.heapify(heap)
    while heap:
        top = heapq.heappop(heap)
        a = top & 0xFFFFFFFF
        i = at(a) if after[a] >= 0 else -1
        if i < 0 or int(rank[pieces[i]]) != top >> 32:
            continue
        b, c = after[a], after[after[a]]
        token[first + b], token[first + a], nxt[first + a] = -2, m.longer[pieces[i]], first + c
        after[a], after[b] = c, -1
        before[c] = a
        for x in (a, before[a]):
            if x >= 0 and (i := at(x)) >= 0:
                heapq.heappush(heap, int(rank[pieces[i]]) << 32 | x)


def best_paths(m: Model, token: np.ndarray, ends: np.ndarray, size: np.ndarray, start: np.ndarray, piece: np.ndarray, word: np.ndarray) -> None:
    """Sets token (by position, -2 within a symbol) to the best path of every word of a unigram model."""
    single = np.nonzero(token >= -1)[0]  # an edge for every character
    single = single[np.isin(single, ends, invert=True)]
    of = np.searchsorted(ends, single)
    score = np.where(token[single] >= 0, m.score[token[single]], np.float32(m.score[m.rank >= 0].min() - np.float32(PENALTY)))
    start, width, ids = np.r_[start, single], np.r_[m.width[piece], np.ones(len(single), np.int64)], np.r_[m.longer[piece], token[single]]
    score, offset = np.r_[m.score[m.longer[piece]], score].astype(np.float32), start - (ends - size)[np.r_[word, of]]
    order = np.lexsort((start, offset))
    start, width, ids, score, offset = start[order], width[order], ids[order], score[order], offset[order]
    best, edge = np.full(len(token) + 1, -np.inf, np.float32), np.full(len(token) + 1, -1, np.int64)
    best[ends - size] = 0
    for a, b in pairwise(np.r_[np.nonzero(np.r_[True, np.diff(offset) != 0])[0], len(offset)].tolist() if len(offset) else []):
        end = start[a:b] + width[a:b]  # no two edges of one offset have the same start and end
        way = best[start[a:b]] + score[a:b]
        better = np.nonzero(way > best[end])[0]
        best[end[better]], edge[end[better]] = way[better], better + a
    token[np.isin(np.arange(len(token)), ends, invert=True)] = -2
    here = ends[size > 0]
    while here.size:
        e = edge[here]
        token[start[e]] = ids[e]
        here = start[e]
        here = here[offset[e] > 0]


def encode_words(m: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words, one after the other, and how many each word has."""
    joined = "\0".join(words) + "\0"
    code = m.table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1  # where the separators are
    owner = np.repeat(np.arange(len(words)), size + 1)
    code[ends] = 0
    token = m.single[code]
    start, piece = edges(m, code)
    word = owner[start]
    if m.score is not None:
        best_paths(m, token, ends, size, start, piece, word)
    else:
        nxt = np.arange(1, len(code) + 1)
        long = size[word] > LONG
        relax(m, token, nxt, start[~long], piece[~long], word[~long])
        if long.any():
            s, p, w = start[long], piece[long], word[long]
            by = np.argsort(w, kind="stable")
            s, p, w = s[by], p[by], w[by]
            for part in np.split(np.arange(len(w)), np.nonzero(np.diff(w))[0] + 1):
                k = w[part[0]]
                relax_long(m, token, nxt, int(ends[k] - size[k]), int(ends[k]), s[part], p[part])
    token[ends] = -3
    at = np.nonzero(token >= -1)[0]
    got = token[at]
    count = np.ones(len(at), np.int64)
    missing = np.nonzero(got == -1)[0]
    spelt = {}
    for i in missing.tolist():
        spelt[i] = m.bytes[list(joined[at[i]].encode("utf-8", "surrogatepass"))].tolist() if m.has_bytes else [m.unknown]
        count[i] = len(spelt[i])
    flat = np.repeat(got, count)
    offset = np.cumsum(count) - count
    for i, ids in spelt.items():
        flat[offset[i] : offset[i] + len(ids)] = ids
    return flat.astype("<i4"), np.bincount(owner[at], weights=count, minlength=len(words)).astype(np.int64)


class Encoder:
    """Encodes and decodes batches of texts."""

    def __init__(self, model: Model):
        self.model = model

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        m = self.model
        split = [m.words.findall((SPACE if m.dummy_prefix else "") + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = [w for s in split for w in s]
        parts = [encode_words(m, words[s]) for s in steps([len(w) + 1 for w in words], INDEX)]
        flat = np.concatenate([*(ids for ids, _ in parts), np.zeros(0, "<i4")])
        at = np.r_[0, np.cumsum(np.concatenate([*(n for _, n in parts), np.zeros(0, np.int64)]))]
        edge = at[np.r_[0, np.cumsum([len(s) for s in split])].astype(np.int64)]
        out = [flat[a:b] for a, b in pairwise(edge.tolist())]
        return out if m.has_bytes else [x[np.r_[True, (x[1:] != m.unknown) | (x[:-1] != m.unknown)]] if len(x) else x for x in out]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        m, out = self.model, []
        for x in ids:
            if len(x) and not 0 <= int(x.min()) <= int(x.max()) < len(m.text):
                raise IndexError("an id is out of range")
            raw = b"".join(map(m.text.__getitem__, x.tolist()))
            out.append((raw.removeprefix(b" ") if m.dummy_prefix else raw).decode("utf-8", "replace"))
        return out


def lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids).astype(np.int32)))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids array<int>) for docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(sent.value)
        for b in (s for batch in batches for s in text_steps(batch)):
            got = e.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(got)], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) for encoded (doc_id, ids)."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(sent.value)
        for b in batches:
            texts = e.decode([np.array(x or [], np.int64) for x in b.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, ids_sha256 of the ids as little-endian int32, round_trip: whether they decode to the text).

    One step does what encode() and decode() do, since a join of theirs would mix up rows that share an id.
    """
    sent = docs.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(sent.value)
        for b in (s for batch in batches for s in text_steps(batch)):
            texts = [t or "" for t in b.column("text").to_pylist()]
            got = e.encode(texts)
            same = [a == t.replace(SPACE, " ") for a, t in zip(e.decode(got), texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in got], pa.int64()), lists(got), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in got]), pa.array(same)], names=["doc_id", "n_tokens", "ids", "ids_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, round_trip boolean")


def op4_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
