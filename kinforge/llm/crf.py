"""Document quality by a linear-chain conditional random field over lines.

Each line gets a label, good or bad, from features of its own and of the lines before and after it:
shares of character classes, lengths, repeated words and lines, each in bins. Forward-backward gives
each line's chance to be good, and a document's quality is their mean, weighted by the lines' lengths.

The field is fitted in numpy on whole documents: at most ``SAMPLE_DOCS`` labelled training rows, those
with the least hashes of their ids; a line's label is its document's. Labels, lang, source and doc_id are
no features.

Defined results: null and empty texts, and all texts if nothing was learned, get the share of good rows
in the sample (0.5 without one); labels without a doc_id or quality are ignored, of several for one
doc_id the largest counts; rows without a doc_id are never training rows; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._arrays import Words, byte_values, prefix, segment_hash, text_slices
from kinforge.llm._store import bounded_batches

SAMPLE_DOCS = 4000
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.1, 1e-4
EDGES = np.array([1e-9, 0.01, 0.03, 0.06, 0.1, 0.15, 0.22, 0.3, 0.4, 0.5, 0.65, 0.8, 0.95, 0.9999])
BINS = len(EDGES) + 2  # the last: no such line
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:?'\"-", b"!", b"|", b"#$%&*@^~", b"<>{}[]()/\\_=+`", bytes(range(0xC0, 0x100))]
FEATURES = len(_CLASSES) + 9


class Lines:
    """The lines of texts that are not blank: bins [lines, FEATURES], bytes of each, and each text's first (one longer)."""

    def __init__(self, column: pa.Array):
        words = Words(column, lower=False)
        data, n = words.raw, len(words.count)
        # a line is the stretch from its first to its last word
        if not len(words.start):
            self.bins, self.size, self.first = np.zeros((0, FEATURES), dtype=np.int64), np.zeros(0), np.zeros(n + 1, dtype=np.int64)
            return
        breaks = np.concatenate(([0], np.cumsum((data == 10) | (data == 13))))
        new = np.ones(len(words.start), dtype=bool)
        new[1:] = (breaks[words.start[1:]] > breaks[words.start[:-1]]) | (words.doc[1:] != words.doc[:-1])
        w0 = np.flatnonzero(new)
        w1 = np.append(w0[1:], len(words.start))
        a, b = words.start[w0], words.end[w1 - 1]
        doc = words.doc[w0]
        self.size = (b - a).astype(np.float64)
        self.first = np.searchsorted(doc, np.arange(n + 1))
        f = np.empty((len(a), FEATURES))
        share = {}
        for k, chars in enumerate(_CLASSES):
            table = np.zeros(256, dtype=np.int64)
            table[list(chars)] = 1
            sums = np.concatenate(([0], np.cumsum(table[data])))
            share[k] = sums[b] - sums[a]
            f[:, k] = share[k] / self.size
        letters = np.maximum(share[0] + share[1] + share[9], 1)
        k = len(_CLASSES)
        f[:, k] = share[0] / letters
        f[:, k + 1] = np.log2(1 + self.size) / 16
        f[:, k + 2] = np.minimum(self.size / (w1 - w0) / 32, 1)
        f[:, k + 3] = np.isin(data[b - 1], list(b".!?"))
        f[:, k + 4] = (data[a] >= 65) & (data[a] <= 90)
        line_of = np.repeat(np.arange(len(a)), w1 - w0)
        order = np.lexsort((words.hash, line_of))
        h, at = words.hash[order], line_of[order]
        fresh = np.ones(len(h))
        fresh[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
        f[:, k + 5] = np.bincount(at, weights=fresh) / (w1 - w0)
        whole = segment_hash(prefix(byte_values()[data]), a, b)
        order = np.lexsort((whole, doc))
        h, at = whole[order], doc[order]
        twin = np.zeros(len(h), dtype=bool)
        same = (h[1:] == h[:-1]) & (at[1:] == at[:-1])
        twin[1:] |= same
        twin[:-1] |= same
        f[order, k + 6] = twin
        # the share of words that end in a sign other than plain punctuation
        last = data[words.end - 1]
        odd = np.isin(last, list(b"#$%&*@^~!|<>{}[]\\_=+`"))
        f[:, k + 7] = np.add.reduceat(odd.astype(np.float64), w0) / (w1 - w0)
        again = np.zeros(len(words.start))
        again[1:] = (words.hash[1:] == words.hash[:-1]) & ~new[1:]
        f[:, k + 8] = np.add.reduceat(again, w0) / (w1 - w0)
        self.bins = np.searchsorted(EDGES, f, side="right")


def columns(lines: Lines) -> np.ndarray:
    """[lines, 3 * FEATURES] weight places: of the line, of the one before, of the one after."""
    n, base = len(lines.bins), np.arange(FEATURES) * BINS
    own = lines.bins
    before, after = np.full_like(own, BINS - 1), np.full_like(own, BINS - 1)
    inner = np.ones(n, dtype=bool)
    inner[lines.first[:-1][lines.first[:-1] < n]] = False
    k = np.flatnonzero(inner)
    before[k] = own[k - 1]
    after[k - 1] = own[k]
    size = FEATURES * BINS
    return np.concatenate((own + base, before + base + size, after + base + 2 * size), axis=1)


def marginals(score: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once: each line's chance to be good, chances [2, 2] of each
    line's label and the next one's (0 at a document's last line), and each document's log normaliser.

    ``score``: what label good gains over bad on each line; ``trans``: [2, 2] scores of neighbouring labels.
    """
    n = len(score)
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.stack((np.zeros(n), score), axis=1)
    steps = int(count[0]) if len(count) else 0
    alive = [int(np.searchsorted(-count, -t, side="left")) for t in range(steps + 1)]  # documents of more than t lines
    for t in range(steps):
        at = begin[: alive[t]] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            alpha[at] = np.logaddexp(alpha[at - 1, 0, None] + trans[0], alpha[at - 1, 1, None] + trans[1]) + emit[at]
    for t in range(steps - 2, -1, -1):
        at = begin[: alive[t + 1]] + t
        ahead = beta[at + 1] + emit[at + 1]
        beta[at] = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
    log_z = np.zeros(len(count))
    some = count > 0
    ends = begin[some] + count[some] - 1
    log_z[some] = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
    per_line = np.empty(n)
    z = np.zeros(len(count))
    z[order] = log_z
    per_line = np.repeat(z, np.diff(first))
    good = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - per_line, -700, 0))
    both = np.zeros((n, 2, 2))
    if n > 1:
        inner = np.ones(n, dtype=bool)
        inner[first[1:][first[1:] > 0] - 1] = False
        k = np.flatnonzero(inner)
        both[k] = np.exp(np.clip(alpha[k, :, None] + trans + (emit[k + 1] + beta[k + 1])[:, None, :] - per_line[k, None, None], -700, 0))
    return good, both, z


@dataclass
class Model:
    weights: np.ndarray
    trans: np.ndarray
    prior: float

    def scores(self, lines: Lines) -> np.ndarray:
        """Each document's quality."""
        count = np.diff(lines.first)
        out = np.full(len(count), self.prior)
        if len(lines.size):
            good, _, _ = marginals(self.weights[columns(lines)].sum(axis=1) + self.weights[-1], lines.first, self.trans)
            some = np.flatnonzero(count)
            begin = lines.first[some]
            out[some] = np.add.reduceat(good * lines.size, begin) / np.add.reduceat(lines.size, begin)
        return np.clip(out, 0, 1)


def fit(lines: Lines, quality: np.ndarray, seed: int = 3) -> Model:
    """Stochastic gradient ascent (Adagrad) on the documents' label likelihood."""
    rng = np.random.default_rng(seed)
    size = 3 * FEATURES * BINS + 1
    w, past = np.zeros(size), np.full(size, 1e-6)
    trans, past_t = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    prior = float(quality.mean()) if len(quality) else 0.5
    where = columns(lines) if len(lines.size) else np.zeros((0, 3 * FEATURES), dtype=np.int64)
    docs = np.flatnonzero(np.diff(lines.first))
    for _ in range(EPOCHS if len(docs) else 0):
        rng.shuffle(docs)
        for k in range(0, len(docs), BATCH):
            part = np.sort(docs[k : k + BATCH])
            count = lines.first[part + 1] - lines.first[part]
            first = np.concatenate(([0], np.cumsum(count)))
            row = np.repeat(lines.first[part] - first[:-1], count) + np.arange(first[-1])
            y = np.repeat(quality[part], count)
            good, both, _ = marginals(w[where[row]].sum(axis=1) + w[-1], first, trans)
            weight = 1 / np.repeat(count, count)  # each document counts the same
            g = (y - good) * weight
            grad = np.bincount(where[row].ravel(), weights=np.repeat(g, where.shape[1]), minlength=size)
            grad[-1] = g.sum()
            gt = np.zeros((2, 2))
            inner = np.ones(len(row), dtype=bool)
            inner[first[1:] - 1] = False
            for label in (0, 1):
                gt[label, label] = (weight * inner * (y == label)).sum()
            gt -= (both * weight[:, None, None]).sum(axis=0)
            grad = grad / len(part) - DECAY * w
            gt = gt / len(part) - DECAY * trans
            past += grad * grad
            past_t += gt * gt
            w += RATE * grad / np.sqrt(past)
            trans += RATE * gt / np.sqrt(past_t)
    return Model(w, trans, prior)


def held_out(folds: int = 5):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The field of a bounded sample of labelled rows that are not held out; one task reads and fits it."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.filter(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")  # sample_docs rows at most

    def run(batches):
        # the rows come from many tasks in any order; sorted by id, the fit is the same each time
        t = pa.Table.from_batches(list(batches), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("quality", pa.int32())]))
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        text = t["text"].combine_chunks() if t.num_rows else pa.array([], pa.string())
        m = fit(Lines(text), (t["quality"].to_numpy() > 0).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()], pa.binary()), pa.array([m.trans.tobytes()], pa.binary()), pa.array([m.prior])], ["weights", "trans", "prior"])

    r = rows.withColumn("quality", F.col("quality").cast("int")).repartition(1).mapInArrow(run, "weights binary, trans binary, prior double").first()
    if r is None:
        return Model(np.zeros(3 * FEATURES * BINS + 1), np.zeros((2, 2)), 0.5)
    return Model(np.frombuffer(r["weights"]), np.frombuffer(r["trans"]).reshape(2, 2), r["prior"])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))

    def run(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                score = model.value.scores(Lines(batch["text"]))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return docs.select("doc_id", "text").withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
