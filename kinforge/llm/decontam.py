"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Texts are compared as lower-case letters and digits with one space between words. An item of m
characters leaks into a document if some region of it aligns with the whole item in at most
``floor(m * RATE)`` edits. Such a region shares at least m + 1 - q (e + 1) q-grams with the item, all on
diagonals at most e apart; shared q-grams are counted in diagonal bands of width 2 (e + 1) that overlap
by half, and bands that reach the bound are aligned, with no cell looked at beyond the band and e
diagonals on either side. An item counts as a whole only: a document that holds less of it than the edit
budget allows is no leak of it. q is the largest of ``GRAMS`` for which the bound
asks for ``MIN_SHARED`` q-grams. Items are read in blocks of at most ``BLOCK_CHARS`` characters, and each
block is sent to all tasks (its size is checked): documents are read once for each block.

Defined results: null or empty texts and items match nothing; repeated rows give repeated results; an
item that matches a document at several places gives one row for each separate place; items or documents
without an id keep a null id; empty tables give an empty one; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, mix, powers, prefix, text_slices
from kinforge.llm._rows import rows_kept
from kinforge.llm._store import bounded_batches
from kinforge.llm.bpe import texts_of

RATE = 0.1
GRAMS = (8, 6, 4, 2, 1)
MIN_SHARED = 4
BLOCK_CHARS = 4 << 20
_BITS = 22
_RESULT = "doc_id long, item_id long, start long, `end` long, edits int"


@lru_cache(maxsize=1)
def folds() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of each code point, and whether it belongs to a word."""
    low = np.arange(0x110000, dtype=np.uint32)
    word = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            word[c] = True
            t = s.lower()
            if len(t) == 1:
                low[c] = ord(t)
    return low, word


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of all texts (each ends in a 0), the place of each in its text, each one's text, and where texts begin."""
    low, word = folds()
    code = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le"), dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    begin = np.cumsum(size) - size
    inside = word[code]
    ends = begin + size - 1
    gap = np.zeros(len(code), dtype=bool)
    gap[1:] = ~inside[1:] & inside[:-1]
    keep = inside | gap
    keep[ends] = True
    out = np.where(inside, low[code], 32)
    out[ends] = 0
    at = np.flatnonzero(keep)
    doc = np.repeat(np.arange(len(texts)), size)[at]
    first = np.searchsorted(at, np.append(begin, len(code)))
    return out[at], at - begin[doc], doc, first


def gram_size(m: int, rate: float = RATE) -> tuple[int, int, int]:
    """Edits allowed for an item of m characters, its q, and the q-grams that a match shares at least."""
    e = int(m * rate)
    for q in GRAMS:
        if m + 1 - q * (e + 1) >= min(MIN_SHARED, m):
            return e, q, m + 1 - q * (e + 1)
    return e, 1, max(1, m - e)


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.ids = [i for i, _ in items]
        code, _, _, first = folded([t for _, t in items]) if items else (np.zeros(0, np.uint32), None, None, np.zeros(1, np.int64))
        self.texts = []
        for a, b in zip(first[:-1], first[1:]):
            t = code[a : b - 1]
            t = t[: len(t) - 1] if len(t) and t[-1] == 32 else t
            self.texts.append(t)
        self.limits = [gram_size(len(t), rate) for t in self.texts]
        self.by_q = {}
        for q in {q for (_, q, _), t in zip(self.limits, self.texts) if len(t) >= q}:
            keys, item, pos = [], [], []
            for k, t in enumerate(self.texts):
                if self.limits[k][1] == q and len(t) >= q:
                    keys.append(grams(t, q))
                    item.append(np.full(len(t) - q + 1, k))
                    pos.append(np.arange(len(t) - q + 1))
            keys, item, pos = map(np.concatenate, (keys, item, pos))
            order = np.argsort(keys, kind="stable")
            distinct, start = np.unique(keys[order], return_index=True)
            seen = np.zeros(1 << _BITS, dtype=bool)
            seen[(distinct >> U(64 - _BITS)).astype(np.int64)] = True
            self.by_q[q] = (seen, distinct, np.append(start, len(keys)), item[order], pos[order])


def grams(code: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams of code points."""
    sums = prefix(mix(code.astype(U) + U(3)))
    _, ipw = powers(len(code) + 1)
    n = len(code) - q + 1
    return mix((sums[q:] - sums[:-q]) * ipw[:n])


def whole(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int] | None:
    """The first place where ``item`` stands unchanged, as :func:`align` gives it."""
    raw, mark, at = text.tobytes(), item.tobytes(), -1
    while (at := raw.find(mark, at + 1)) >= 0:
        if at % 4 == 0:
            return 0, at // 4, at // 4 + len(item)
    return None


def align(item: np.ndarray, text: np.ndarray, most: int, low: int = 0, wide: int | None = None) -> tuple[int, int, int] | None:
    """Fewest edits that turn ``item`` into a part of ``text``, if at most ``most``; that part's start and end.

    Only alignments on the ``wide`` diagonals (place in the text less place in the item) from ``low`` on are
    looked at; without ``wide``, on all. Row by row, cell k holds diagonal low + k.
    """
    n, m = len(text), len(item)
    if wide is None:
        low, wide = -m, n + m + 1
    pad = np.full(wide + m, 0xFFFFFFFF, dtype=np.uint32)
    far = 1 << 30
    row = np.concatenate((pad[: max(0, -low)], text, pad))[max(0, low) :]  # row[k + i]: the character at diagonal low + k of row i
    k = np.arange(wide)
    at = low + k
    cost = np.where((at >= 0) & (at <= n), 0, far)
    origin = at.copy()
    for i, c in enumerate(item.tolist()):
        at = low + i + 1 + k  # columns of the new row
        best = cost + (row[i : i + wide] != c)
        best[(at < 1) | (at > n)] = far
        from_ = origin
        drop = np.append(cost[1:] + 1, far)
        less = drop < best
        best, from_ = np.where(less, drop, best), np.where(less, np.append(origin[1:], 0), from_)
        run = np.minimum.accumulate(best - k)
        less = (run + k < best) & (at >= 1) & (at <= n)
        if less.any():
            source = np.maximum.accumulate(np.where(best - k == run, k, 0))
            from_, best = np.where(less, from_[source], from_), np.where(less, run + k, best)
        best[(at < 0) | (at > n)] = far
        cost, origin = best, from_
        if cost.min() > most:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(origin[end]), low + m + end) if cost[end] <= most else None


def matches(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every separate place where an item stands in a text."""
    code, place, doc, first = folded(texts)
    found: list[tuple[int, int, int, int, int]] = []
    for q, (seen, distinct, start, items, pos) in index.by_q.items():
        if len(code) < q:
            continue
        h = grams(code, q)
        hit = np.flatnonzero(seen[(h >> U(64 - _BITS)).astype(np.int64)])
        if not len(hit):
            continue
        at = np.minimum(np.searchsorted(distinct, h[hit]), len(distinct) - 1)
        same = distinct[at] == h[hit]
        hit, at = hit[same], at[same]
        n = start[at + 1] - start[at]
        row = np.repeat(np.arange(len(hit)), n)
        entry = start[at[row]] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        item = items[entry]
        width = np.array([e + 1 for e, _, _ in index.limits])
        least = np.array([t for _, _, t in index.limits])
        d = doc[hit[row]]
        diagonal = hit[row] - first[d] - pos[entry]
        band = (diagonal - diagonal.min(initial=0)) // width[item]
        top = int(band.max(initial=0)) + 2
        key = (d * len(index.ids) + item) * top + band
        both = np.concatenate((key, key + 1))  # band k holds strips k - 1 and k
        keys, counts = np.unique(both, return_counts=True)
        lowest = diagonal.min(initial=0)
        keys = keys[counts >= least[keys // top % len(index.ids)]]
        if not len(keys):
            continue
        # a q-gram that the text repeats counts once for each place in the item
        at = np.minimum(np.searchsorted(keys, both), len(keys) - 1)
        mine = np.flatnonzero(keys[at] == both)
        size = int(pos.max(initial=0)) + 1
        shared = np.unique(at[mine] * size + np.concatenate((pos[entry], pos[entry]))[mine])
        keys = keys[np.bincount(shared // size, minlength=len(keys)) >= least[keys // top % len(index.ids)]]
        owner = keys // top % len(index.ids)
        for k in range(len(keys)):
            i, b, t = int(owner[k]), int(keys[k] % top), int(keys[k] // top // len(index.ids))
            e, w, m = index.limits[i][0], int(width[i]), len(index.texts[i])
            a0 = first[t] + max(0, lowest + (b - 1) * w - e)
            a1 = min(first[t + 1] - 1, first[t] + lowest + (b + 1) * w + m + e)
            diagonal = first[t] + lowest + (b - 1) * w - e - a0  # the band's diagonals and e on either side, counted from a0
            got = whole(index.texts[i], code[a0:a1]) or align(index.texts[i], code[a0:a1], e, int(diagonal), 2 * w + 2 * e)
            if got:
                edits, s, z = got
                found.append((t, i, int(place[a0 + s]), int(place[a0 + max(s, z - 1)]) + 1, edits))
    out: list[tuple[int, int, int, int, int]] = []
    for x in sorted(found, key=lambda x: (x[0], x[1], x[2], x[4])):
        if out and out[-1][:2] == x[:2] and x[2] < out[-1][3]:
            if x[4] < out[-1][4]:
                out[-1] = x
        else:
            out.append(x)
    return out


def _blocks(spark, benchmark: DataFrame):
    """Broadcasts of the items' blocks, one after the other."""
    bounded_batches(spark)
    items = benchmark.select("item_id", "text").filter("length(text) > 0")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about BLOCK_CHARS characters
        yield spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part])


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, start, end (in characters of the document's text) and edits of each leaked passage."""
    out = None
    for items in _blocks(docs.sparkSession, benchmark):
        found = docs.select("doc_id", "text").mapInArrow(_finder(items, rate), _RESULT)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of ``docs`` (text and others) into which no item leaks."""
    for items in _blocks(docs.sparkSession, benchmark):
        docs = rows_kept(docs, _without(items, rate))
    return docs


def _without(items, rate: float):
    def mask():
        index = Index(items.value, rate)

        def keep(batch: pa.RecordBatch) -> np.ndarray:
            out = np.ones(batch.num_rows, dtype=bool)
            out[[r[0] for r in matches(index, texts_of(batch["text"]))]] = False
            return out

        return keep

    return mask


def _finder(items, rate: float):
    def run(batches):
        index = Index(items.value, rate)
        for big in batches:
            for batch in text_slices(big, "text"):
                rows = matches(index, texts_of(batch["text"]))
                where = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()).take(where), pa.array([index.ids[r[1]] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)), pa.array([r[4] for r in rows], pa.int32())],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

    return run
