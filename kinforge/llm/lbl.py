"""Scores by a log-bilinear language model, trained with noise-contrastive estimation in numpy.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and one end token behind each text. Token counts
cover all training documents: each block of input (``BLOCK_ROWS`` rows of a file, by the rows' own numbers,
so that a block is the same in every read, however files are split) gives its words with their counts
once, these meet by word, and the totals go back to the blocks as side files in the shared folder, so
that neither the texts nor the vocabulary move as a whole.

The neural model knows the ``SHORTLIST`` most frequent tokens and ``CLASSES`` classes of all others, by
their hashes; what bounds both is the table of normalisers, which has a place for each two symbols. Two
context symbols u, v give the scores A[u] + B[v] + b, so the sums that normalise them are one matrix
product, exp(A) exp(B + b)', for all contexts at once. A token outside the shortlist has the probability
of its class, times its smoothed share in the class. The model's weights are learned from every token of
every training document: they start from ``STEPS`` steps on at most ``SAMPLE_DOCS`` texts (those with the
least hashes of their ids), then each task follows all the training texts of its splits once, in steps of
``BATCH`` tokens, and the tasks' weights meet in means, each row weighted by how often the task moved it.
So steps grow with the corpus, and what a task holds and hands on does not. All counts, and so the
shortlist, biases, noise and shares, come from every training document. Weights depend on how the input
is split, within the noise of training.

Defined results: a null text is empty (one token, the end); rows without a doc_id are training
documents; without any training document N and V are 0; repeated rows count each; an empty table gives
an empty one; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, Words, text_slices
from kinforge.llm._store import bounded_batches, free_shuffles, fresh_path, written

#: Tokens with a symbol of their own, and classes of the others (a power of two, 256 at most).
SHORTLIST, CLASSES = 2048, 256
#: Rows of a block of input, and pairs of a block and a word in one side file, about.
BLOCK_ROWS, SHARD_PAIRS = 8192, 500_000
DIMENSIONS, NOISE, BATCH, STEPS, RATE = 24, 96, 1024, 2500, 0.15
SAMPLE_DOCS = 3000
#: Tasks that add up the weights of all others, before one adds up theirs for the driver.
MERGERS = 16
ALPHA = 0.1
END = np.uint64(0x5EED0E2D00000001)
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 1_000_000
_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(folds: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == 0, F.lit(False))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, ends included, and where each text's begin (one longer)."""
    words = Words(column, lower=True)
    n = len(words.count)
    first = words.first + np.arange(n + 1)
    out = np.empty(len(words.start) + n, dtype=U)
    last = np.zeros(len(out), dtype=bool)
    last[first[1:] - 1] = True
    out[last] = END
    out[~last] = words.hash
    return out, first


def _merged(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(h)).astype(np.int64)


def block_counts(docs: DataFrame) -> DataFrame:
    """(block, w, n): each block's words with their number in its training documents, 0 included; a pair may repeat."""

    def run(batches):
        held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, (h, c) in held.items():
                w, n = _merged(h, c)
                for at in range(0, len(w), 100_000):
                    part = w[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part.view(np.int64)), pa.array(n[at : at + 100_000])], ["block", "w", "n"])
            held.clear()

        for big in batches:
            for batch in text_slices(big, "text", 1 << 22):
                t, first = tokens(batch["text"])
                train = np.repeat(~batch["held_out"].to_numpy(zero_copy_only=False), np.diff(first)).astype(np.float64)
                owner = np.repeat(batch["block"].to_numpy(), np.diff(first))
                for block in np.unique(owner).tolist():
                    mine = owner == block
                    w, inverse = np.unique(t[mine], return_inverse=True)
                    h, c = held.setdefault(block, ([], []))
                    h.append(w)
                    c.append(np.bincount(inverse, weights=train[mine], minlength=len(w)))
                    size += len(w)
                if size > 2 * HELD_WORDS:
                    for block, (h, c) in held.items():
                        w, n = _merged(h, c)
                        held[block] = ([w], [n.astype(np.float64)])
                    size = sum(len(h[0]) for h, _ in held.values())
                    if size > HELD_WORDS:
                        yield from out()
                        size = 0
        yield from out()

    return docs.mapInArrow(run, "block long, w long, n long")


@dataclass
class Model:
    """Shortlist (hashes, sorted), biases and weights; symbols are shortlist places, then others, then the text's begin."""

    words: np.ndarray
    total: int
    distinct: int
    other_mass: np.ndarray
    target: np.ndarray
    far: np.ndarray
    near: np.ndarray
    bias: np.ndarray

    def normalisers(self) -> np.ndarray:
        """[symbol before the last, last symbol], log; made some rows at a time."""
        b = self.near @ self.target.T + self.bias
        mb = b.max(axis=1, keepdims=True)
        b = np.exp(b - mb).T
        out = np.empty((len(self.far), len(self.near)), dtype=np.float32)
        for k in range(0, len(out), 256):
            a = self.far[k : k + 256] @ self.target.T
            ma = a.max(axis=1, keepdims=True)
            out[k : k + 256] = np.log(np.exp(a - ma) @ b) + ma + mb.T
        return out

    def log_probabilities(self, z: np.ndarray, far: np.ndarray, near: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of symbols ``ids`` after the symbols ``far`` and ``near``."""
        h = self.far.take(far, 0) + self.near.take(near, 0)
        return np.einsum("ij,ij->i", h, self.target.take(ids, 0)).astype(np.float64) + self.bias[ids] - z[far, near]


def contexts(ids: np.ndarray, first: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before the last and the last one, for each token."""
    near = np.empty_like(ids)
    near[1:] = ids[:-1]
    near[first[:-1]] = begin
    far = np.empty_like(ids)
    far[2:] = ids[:-2]
    far[first[:-1]] = begin
    second = first[:-1] + 1
    far[second[second < first[1:]]] = begin
    return far, near


@dataclass
class Weights:
    """Targets, words before the last, last words and biases; the squares that Adagrad has summed for each, and how often each row has moved."""

    values: list[np.ndarray]
    squares: list[np.ndarray]
    moves: list[np.ndarray]

    @staticmethod
    def start(unigram: np.ndarray, rng: np.random.Generator) -> Weights:
        v = len(unigram)
        values = [rng.normal(0, 0.1, (k, DIMENSIONS)).astype(np.float32) for k in (v, v + 1, v + 1)] + [np.log(unigram).astype(np.float32)]
        return Weights(values, [np.full(x.shape, 1e-3, dtype=np.float32) for x in values], [np.zeros(len(x), dtype=np.int64) for x in values])

    def step(self, y: np.ndarray, f: np.ndarray, n: np.ndarray, noise: tuple[np.ndarray, np.ndarray], log_noise: np.ndarray) -> None:
        """One step of noise-contrastive estimation: tokens y after f, n against shared draws (tokens, how often each), by Adagrad."""
        target, far, near, bias = self.values
        drawn, times = noise
        ty, td = target.take(y, 0), target.take(drawn, 0)
        h = far.take(f, 0) + near.take(n, 0)
        s = np.einsum("ij,ij->i", h, ty) + (bias - log_noise).take(y)
        gs = 0.5 - 0.5 * np.tanh(0.5 * s)
        gt = h @ td.T
        gt += (bias - log_noise).take(drawn)
        gt *= 0.5
        np.tanh(gt, out=gt)
        gt += 1
        gt *= -0.5 * times.astype(np.float32)
        gh = gs[:, None] * ty + gt @ td
        of_y = np.concatenate((gs[:, None] * h, gs[:, None]), axis=1)
        of_drawn = np.concatenate((gt.T @ h, gt.sum(axis=0)[:, None]), axis=1)
        rows, total, moved = _by_row(np.concatenate((y, drawn)), np.concatenate((of_y, of_drawn)), np.concatenate((np.ones(len(y), dtype=np.int64), times)))
        self._move(0, rows, total[:, :-1], moved)
        self._move(3, rows, total[:, -1], moved)
        for k, where in ((1, f), (2, n)):
            self._move(k, *_by_row(where, gh, np.ones(len(y), dtype=np.int64)))

    def _move(self, k: int, rows: np.ndarray, total: np.ndarray, moved: np.ndarray) -> None:
        total = total / BATCH
        squares = self.squares[k].take(rows, 0) + total * total
        self.squares[k][rows] = squares
        self.values[k][rows] += RATE * total / np.sqrt(squares)
        self.moves[k][rows] += moved


def _by_row(where: np.ndarray, g: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows in ``where``, each once, with the sums of their ``g`` and ``times``."""
    order = np.argsort(where, kind="stable")
    rows = where[order]
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[at], np.add.reduceat(g.take(order, 0), at, axis=0), np.add.reduceat(times[order], at)


class Noise:
    """Draws from the unigram distribution."""

    def __init__(self, unigram: np.ndarray, rng: np.random.Generator):
        self.rng, self.log = rng, np.log(unigram * NOISE).astype(np.float32)
        self.bounds = np.cumsum(unigram)
        self.bounds[-1] = 1

    def draw(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of ``NOISE`` draws and how often each was drawn."""
        times = np.bincount(np.searchsorted(self.bounds, self.rng.random(NOISE)), minlength=len(self.bounds))
        drawn = np.flatnonzero(times)
        return drawn.astype(np.uint16), times[drawn]


def train(ids: np.ndarray, first: np.ndarray, unigram: np.ndarray, steps: int = STEPS, seed: int = 5) -> Weights:
    """The weights that all tasks start from: ``steps`` steps on tokens drawn from these texts."""
    rng = np.random.default_rng(seed)
    out = Weights.start(unigram, rng)
    if not len(ids):
        for x in out.values[:3]:
            x *= 0
        return out
    ids = ids.astype(np.uint16)  # symbols are few, and 16 bits sort fast
    u, w = contexts(ids, first, len(unigram))
    noise = Noise(unigram, rng)
    for _ in range(steps):
        at = rng.integers(0, len(ids), BATCH)
        out.step(ids[at], u[at], w[at], noise.draw(), noise.log)
    return out


def follow(start: Weights, texts: Iterable[tuple[np.ndarray, np.ndarray]], unigram: np.ndarray, seed: int) -> Weights:
    """``start`` after one pass over every token of ``texts`` (ids, where each text begins), shuffled within an item."""
    out = Weights([x.copy() for x in start.values], [x.copy() for x in start.squares], [np.zeros_like(x) for x in start.moves])
    rng = np.random.default_rng(seed)
    noise = Noise(unigram, rng)
    left = np.zeros((3, 0), dtype=np.uint16)
    for ids, first in texts:
        ids = ids.astype(np.uint16)
        left = np.concatenate((left, (ids, *contexts(ids, first, len(unigram)))), axis=1)
        left = left[:, rng.permutation(left.shape[1])]
        whole = left.shape[1] // BATCH * BATCH
        for at in range(0, whole, BATCH):
            out.step(*left[:, at : at + BATCH], noise.draw(), noise.log)
        left = left[:, whole:]
    if left.shape[1]:
        out.step(*left, noise.draw(), noise.log)
    return out


_PART = "values array<binary>, moves array<binary>"


def _part(values: list[np.ndarray], moves: list[np.ndarray]) -> pa.RecordBatch:
    kind = pa.list_(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([[x.tobytes() for x in part]], kind) for part in (values, moves)], ["values", "moves"])


def _added(parts: Iterable[tuple[list[bytes], list[bytes]]]) -> tuple[list[np.ndarray], list[np.ndarray]] | None:
    """Sums over tasks: values (float64, each row times its moves) and moves."""
    out = None
    for values, moves in parts:
        part = [np.frombuffer(x) for x in values], [np.frombuffer(x, dtype=np.int64) for x in moves]
        out = part if out is None else tuple([a + b for a, b in zip(x, y)] for x, y in zip(out, part))
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _added((v, m) for b in batches for v, m in zip(b["values"].to_pylist(), b["moves"].to_pylist()))
    if total:
        yield _part(*total)


def mean(start: Weights, parts: list[tuple[list[bytes], list[bytes]]]) -> list[np.ndarray]:
    """Each row's mean over the tasks by moves; a row that none moved stays as it was."""
    total = _added(parts)
    if total is None:
        return start.values
    out = []
    for was, value, moves in zip(start.values, *total):
        n = moves.reshape(-1, *[1] * (was.ndim - 1))
        out.append(np.where(n > 0, value.reshape(was.shape) / np.maximum(n, 1), was).astype(np.float32))
    return out


def _symbols(t: np.ndarray, words: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Each token's place in the shortlist, or behind it that of its class."""
    other = len(words) + (t >> U(56)).astype(np.int64) % classes
    if not len(words):
        return other
    at = np.minimum(np.searchsorted(words, t), len(words) - 1)
    return np.where(words[at] == t, at, other)


def fit(docs: DataFrame, totals: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of the training documents in ``docs`` (doc_id, text, held_out), whose token counts are ``totals`` (w, c)."""
    known = totals.filter("c > 0")
    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES, dtype=np.int64)
    of_class = F.shiftrightunsigned("w", 56).cast("int") % CLASSES
    for r in known.groupBy(of_class.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows at most
        mass[r["k"]], kinds[r["k"]] = r["c"], r["n"]
    n, v = int(mass.sum()), int(kinds.sum())
    end = int(END.view(np.int64))
    top = known.filter(F.col("w") != end).orderBy(F.desc("c"), "w").limit(SHORTLIST - 1).union(known.filter(F.col("w") == end)).collect()
    count = {np.int64(r["w"]).view(U): r["c"] for r in top}
    words = np.array(sorted(count), dtype=U)
    for w, c in count.items():
        mass[int(w >> U(56)) % CLASSES] -= c
        kinds[int(w >> U(56)) % CLASSES] -= 1
    # each class has its words and one that was never seen
    other = mass + ALPHA * (kinds + 1)
    unigram = np.concatenate((np.array([count[w] for w in words], dtype=np.float64) + ALPHA, other))
    unigram /= unigram.sum()

    def learn(batches):
        parts = []
        for big in batches:
            for batch in text_slices(big, "text"):
                t, first = tokens(batch["text"])
                ids = _symbols(t, words).astype(np.uint16)
                parts += [ids[i:j] for i, j in zip(first[:-1], first[1:])]
        parts.sort(key=bytes)  # the rows come in any order
        first = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        ids = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        weights = train(ids, first, unigram)
        yield _part(weights.values, weights.squares)

    # one task reads the bounded sample and makes the start, with one thread, away from the driver
    training = docs.filter(~F.col("held_out"))
    keyed = training.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    chosen = keyed.select("doc_id", "key").orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(sample_docs).select("key").distinct()
    sample = keyed.join(F.broadcast(chosen), "key")  # sample_docs keys at most
    rows = sample.select("text").repartition(1).mapInArrow(learn, _PART).collect()
    start = train(np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64), unigram)
    if rows:
        start.values, start.squares = ([np.frombuffer(x, dtype=np.float32).reshape(y.shape) for x, y in zip(r, start.values)] for r in rows[0])
    begun = docs.sparkSession.sparkContext.broadcast(start)

    def pass_over(batches):
        def texts():
            for big in batches:
                for batch in text_slices(big, "text"):
                    t, first = tokens(batch["text"])
                    yield _symbols(t, words), first

        w = follow(begun.value, texts(), unigram, TaskContext.get().partitionId())
        if w.moves[0].any():
            yield _part([x.astype(np.float64) * n.reshape(-1, *[1] * (x.ndim - 1)) for x, n in zip(w.values, w.moves)], w.moves)

    parts = training.select("text").mapInArrow(pass_over, _PART).repartition(MERGERS).mapInArrow(_merge, _PART).repartition(1).mapInArrow(_merge, _PART).collect()
    target, far, near, bias = mean(start, [(r["values"], r["moves"]) for r in parts])
    return Model(words, n, v, other, target, far, near, bias)


def _vocabulary(fs: pafs.FileSystem, folder: str, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's words, sorted, and their counts in all training documents."""
    table = pq.read_table(folder, filesystem=fs, columns=["w", "c"], filters=[("block", "=", block)], partitioning=None)
    words, first = np.unique(table["w"].to_numpy().view(U), return_index=True)  # parts of a block may repeat a word
    return words, table["c"].to_numpy()[first]


def scores(docs: DataFrame, folds: int = 10, copy: bool = True) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text).

    ``copy=False`` is for a plain scan of Parquet files, whose rows have numbers; anything else is written to such files first.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    source = written(docs.select("doc_id", "text"), "texts") if copy else docs
    place = F.col("_metadata")
    source = source.select("doc_id", "text", held_out(folds).alias("held_out"), F.xxhash64(place["file_path"], F.floor(place["row_index"] / BLOCK_ROWS)).alias("block"))

    counts = written(block_counts(source), "block-counts")
    totals = written(counts.groupBy("w").agg(F.sum("n").alias("c")), "totals")
    model = spark.sparkContext.broadcast(fit(source, totals))
    side = fresh_path(spark, "vocabulary")
    shards = -(-counts.count() // SHARD_PAIRS) or 1
    shard = F.pmod(F.hash("block"), F.lit(shards)).alias("shard")  # as rows are dealt by block, so that each task writes one shard
    pairs = counts.join(totals, "w").select("block", "w", "c", shard)
    # rows of a block lie together in small row groups, which readers find by their statistics
    pairs.repartition(shards, "block").sortWithinPartitions("shard", "block", "w").write.option("parquet.block.size", 2 << 20).partitionBy("shard").parquet(side)
    source = source.withColumn("shard", shard)
    free_shuffles(spark)

    def run(batches):
        m: Model = model.value
        z = m.normalisers()
        fs, base = pafs.FileSystem.from_uri(side)
        log10 = np.log(10)
        share = np.concatenate((np.zeros(len(m.words)), np.log(m.other_mass)))
        smooth = m.total + ALPHA * (m.distinct + 1)
        at_block, words, count, symbol = None, None, None, None
        for big in batches:
            for part in text_slices(big, "text"):
                blocks = part["block"].to_numpy()
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]))
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    batch = part.slice(s, e - s)
                    if blocks[s] != at_block:
                        at_block = blocks[s]
                        words, count = _vocabulary(fs, f"{base}/shard={part['shard'][s]}", at_block)
                        symbol = _symbols(words, m.words)
                    t, first = tokens(batch["text"])
                    at = np.minimum(np.searchsorted(words, t), len(words) - 1)
                    if (words[at] != t).any():
                        raise RuntimeError("the input changed between two reads")
                    c, ids = count[at], symbol[at]
                    lp = m.log_probabilities(z, *contexts(ids, first, len(share)), ids)
                    lp = np.where(ids >= len(m.words), lp + np.log(c + ALPHA) - share[ids], lp)
                    base_lp = np.log((c + ALPHA) / smooth)
                    size = np.diff(first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["doc_id"].cast(pa.int64()),
                            batch["held_out"],
                            pa.array(size, pa.int64()),
                            pa.array(np.add.reduceat((c > 0).astype(np.int64), first[:-1])),
                            pa.array(np.full(len(size), m.total), pa.int64()),
                            pa.array(np.add.reduceat(base_lp, first[:-1]) / log10),
                            pa.array(np.add.reduceat(lp, first[:-1]) / log10),
                        ],
                        ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                    )

    return source.mapInArrow(run, _RESULT)
