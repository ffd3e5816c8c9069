"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

Texts with the same word sequence form one class, and only its smallest doc_id goes on. Band buckets
give candidates; one byte of each signature value is compared batch by batch, and a pair is dropped as
soon as the posterior chance that its similarity reaches the threshold is under ``MISS`` (uniform
prior). What survives connects candidates; inside each connected group, surviving pairs that are not
connected yet are confirmed on full shingle sets. Buckets and groups alike are dealt over blocks of
about ``BLOCK`` rows and ``LOAD`` shingles that share some pivots; only what is then not connected with
the largest part of its group meets the whole group, block by block. So a group of copies costs rows in
proportion to its size, and no pair that could connect two parts is left out.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer words than a
shingle is one shingle; null and wordless texts have none and link with nothing; rows that share a
doc_id are one document, linked when any of them is; rows without a doc_id link with nothing (their
component is null, they are kept); an empty table gives an empty one; other columns are ignored.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, Words, mix, text_slices
from kinforge.llm._store import bounded_batches, drop, free_shuffles, written
from kinforge.llm.components import Forest, components, whole_groups

HASHES, BANDS, BATCH = 128, 32, 32
#: Chance, for a pair of the threshold's similarity, to be dropped at one comparison.
MISS = 1e-6
#: Rows and shingles of a block, and rows that all blocks of a group share.
BLOCK, LOAD, PIVOTS = 256, 1 << 19, 16
_ROWS = HASHES // BANDS
_SKETCH = "doc_id long, n_shingles long, digest binary, bands binary, sig binary"


@lru_cache(maxsize=1)
def _family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_000_003)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every document's shingles in order, and where each document's begin (one longer)."""
    h, count = words.hash, words.count
    full = np.maximum(count - k + 1, 0)
    size = np.where(count == 0, 0, np.maximum(full, 1))
    first = np.concatenate(([0], np.cumsum(size)))
    start = np.repeat(words.first[:-1] - first[:-1], size) + np.arange(first[-1])
    length = np.minimum(np.repeat(count, size), k)
    out = np.zeros(len(start), dtype=U)
    at = np.minimum(start, max(len(h) - 1, 0))
    for i in range(k):
        inside = length > i
        out = np.where(inside, mix(out * U(0xC2B2AE3D27D4EB4F) + h[np.minimum(at + i, max(len(h) - 1, 0))] + U(i + 1)), out) if not inside.all() else mix(out * U(0xC2B2AE3D27D4EB4F) + h[at + i] + U(i + 1))
    return out, first


def signatures(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """[documents, HASHES] least hash values; documents without shingles get the largest value."""
    a, b = _family()
    x = (x >> U(32)).astype(np.uint32)
    n = len(first) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(first))
    k = 0
    while k < len(some):
        to = k
        begin = first[some[k]]
        while to < len(some) and (to == k or first[some[to] + 1] - begin <= 1 << 14):
            to += 1
        part = x[begin : first[some[to - 1] + 1]]
        starts = first[some[k:to]] - begin
        buf = np.empty_like(part)
        for p in range(HASHES):
            np.multiply(part, a[p], out=buf)
            np.add(buf, b[p], out=buf)
            out[some[k:to], p] = np.minimum.reduceat(buf, starts)
        k = to
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U) << U(40), (len(sig), BANDS)).copy()
    rows = sig.reshape(len(sig), BANDS, _ROWS).astype(U)
    for i in range(_ROWS):
        out = mix(out * U(0x9E3779B97F4A7C15) + rows[:, :, i])
    return out


def _digest(words: Words, d: int) -> bytes:
    return hashlib.blake2b(words.hash[words.first[d] : words.first[d + 1]].astype("<u8").tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the word sequence, band keys and signature bytes of each row."""

    def run(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                words = Words(batch["text"], lower=True)
                x, first = shingles(words, k)
                sig = signatures(x, first)
                keys = band_keys(sig)
                low = (sig & 0xFF).astype(np.uint8)
                counts, digests = [], []
                for d in range(batch.num_rows):
                    counts.append(len(np.unique(x[first[d] : first[d + 1]])))
                    digests.append(_digest(words, d))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array([r.tobytes() for r in low], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, _SKETCH)


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """For each number of compared batches: matches under which a pair is dropped.

    With a uniform prior, P(J >= t | m of n agree) = P(Bin(n + 1, t) <= m).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that no batch of signature values drops, and how many of their values agree."""
    matches = np.zeros(len(a), dtype=np.int32)
    for k, least in enumerate(least_matches(threshold)):
        part = sig[:, k * BATCH : (k + 1) * BATCH]
        matches = matches + (part[a] == part[b]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        if not keep.all():
            a, b, matches = a[keep], b[keep], matches[keep]
    return a, b, matches


def pairs_of(sizes: np.ndarray, starts: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs inside groups: groups of one size together, about ``most`` pairs at a time."""
    for size in np.unique(sizes[sizes > 1]).tolist():
        where = starts[sizes == size]
        if size <= 256:
            i, j = np.triu_indices(size, 1)
            step = max(1, most // len(i))
            for k in range(0, len(where), step):
                base = where[k : k + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            step = max(1, most // size)
            for base in where.tolist():
                for k in range(0, size - 1, step):
                    i = np.arange(k, min(size - 1, k + step))
                    n = size - 1 - i
                    row = np.repeat(i, n)
                    off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                    yield base + row, base + row + 1 + off


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, HASHES)


def _blocks(n: str, load: str) -> Column:
    """Blocks of a group of ``n`` rows with ``load`` shingles in all."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK), F.ceil(F.col(load) / LOAD)).cast("int")


def _block(g: Column) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), g).cast("int")


class Linker:
    """Joins rows of a block that ``test`` links, without comparing those that are joined already."""

    def __init__(self, ids: np.ndarray, test: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]):
        self.ids, self.test, self.forest = ids, test, Forest()

    def _join(self, label: np.ndarray, a: np.ndarray, b: np.ndarray, s: int) -> None:
        for p, q in zip(a.tolist(), b.tolist()):
            self.forest.join(int(self.ids[p]), int(self.ids[q]))
            x, y = label[p - s], label[q - s]
            if x != y:
                label[label == y] = x

    def within(self, s: int, e: int) -> None:
        """Rows s to e: some pivots meet all rows first, then rows that are still apart meet each other."""
        label = np.arange(e - s)
        tried: set[int] = set()
        for p in range(e - s):
            if label[p] in tried:
                continue
            if len(tried) == PIVOTS:
                break
            tried.add(int(label[p]))
            far = np.flatnonzero(label != label[p])
            if not len(far):
                return
            for a, b in self.test(np.full(len(far), s + p), s + far):
                self._join(label, a, b, s)
        for k in range(0, e - s - 1):
            far = k + 1 + np.flatnonzero(label[k + 1 :] != label[k])
            if len(far):
                for a, b in self.test(np.full(len(far), s + k), s + far):
                    self._join(label, a, b, s)

    def across(self, s: int, e: int, side: np.ndarray, part: np.ndarray) -> None:
        """Rows of the two sides that belong to different parts."""
        one, two = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
        label = np.unique(part[s:e], return_inverse=True)[1]
        for q in two.tolist():
            far = one[label[one - s] != label[q - s]]
            if len(far):
                for a, b in self.test(np.full(len(far), q), far):
                    self._join(label, a, b, s)


def _signature_test(sig: np.ndarray, threshold: float):
    def test(a: np.ndarray, b: np.ndarray):
        a, b, _ = surviving(sig, a, b, threshold)
        yield a, b

    return test


def _exact_test(sig: np.ndarray, sets: list[np.ndarray], threshold: float, root: Callable[[int], int]):
    """Pairs whose signatures survive, confirmed on full sets; of rows that a pair before has joined only one is read."""
    percent, size = round(threshold * 100), np.array([len(x) for x in sets])

    def test(a: np.ndarray, b: np.ndarray):
        keep = percent * np.maximum(size[a], size[b]) <= 100 * np.minimum(size[a], size[b])
        a, b, matches = surviving(sig, a[keep], b[keep], threshold)
        for k in np.argsort(-matches, kind="stable").tolist():
            p, q = int(a[k]), int(b[k])
            if root(p) == root(q):
                continue
            at = np.searchsorted(sets[p], sets[q])
            at[at == len(sets[p])] = 0
            both = int((sets[p][at] == sets[q]).sum())
            if 100 * both >= percent * (size[p] + size[q] - both):
                yield a[k : k + 1], b[k : k + 1]

    return test


def _linker(t: pa.Table, threshold: float) -> Linker:
    ids, sig = t["id"].to_numpy(), _sigs(t["sig"])
    out = Linker(ids, _signature_test(sig, threshold))
    if "set" in t.column_names:
        out.test = _exact_test(sig, [np.frombuffer(x, dtype="<u8") for x in t["set"].to_pylist()], threshold, lambda p: out.forest.root(int(ids[p])))
    return out


def _inside(threshold: float):
    """Links inside blocks (grp, i, id, sig and perhaps set): small blocks of one size together, larger ones by pivots."""

    def run(batches):
        forest = Forest()
        for t, starts in whole_groups(batches, ["grp", "i"], rows=512):
            linker = _linker(t, threshold)
            linker.forest = forest
            sizes = np.diff(starts)
            small = sizes <= 16
            for a, b in pairs_of(sizes[small], starts[:-1][small]):
                for x, y in linker.test(a, b):
                    for p, q in zip(linker.ids[x].tolist(), linker.ids[y].tolist()):
                        forest.join(p, q)
            for k in np.flatnonzero(~small).tolist():
                linker.within(int(starts[k]), int(starts[k + 1]))
        yield forest.edges()

    return run


def _between(threshold: float):
    """Links between the parts of large groups (grp, i, j, id, side, part, sig and perhaps set)."""

    def run(batches):
        forest = Forest()
        for t, starts in whole_groups(batches, ["grp", "i", "j"], rows=512):
            linker = _linker(t, threshold)
            linker.forest = forest
            side, part = t["side"].to_numpy(), t["part"].to_numpy()
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                linker.across(s, e, side, part)
        yield forest.edges()

    return run


def connected(groups: DataFrame, load: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """(id, component) of the rows of ``groups`` (grp, id, n, load) that links inside groups reach.

    ``load`` has ``columns`` of each id; these are taken from ``groups`` where it has them. A group of more than one block shares some pivots among all its
    blocks. What is not connected with the largest part of its group after that, meets the whole group.
    """
    g = _blocks("n", "load")
    pivot = (g > 1) & (F.pmod(F.xxhash64("id", F.lit(11)), F.col("n")) < PIVOTS)
    i = F.explode(F.when(pivot, F.sequence(F.lit(0), g - 1)).otherwise(F.array(_block(g)))).alias("i")
    first = groups.select("grp", *columns, i) if set(columns) <= set(groups.columns) else groups.select("grp", "id", i).join(load, "id")
    first = first.select("grp", "i", *columns).repartition("grp", "i").sortWithinPartitions("grp", "i")
    sure = written(first.mapInArrow(_inside(threshold), "a long, b long"), "sure")
    result = components(sure)
    large = groups.filter(g > 1)
    if not large.limit(1).count():
        drop(sure)
        return result
    parts = written(large.join(result, "id", "left").select("grp", "id", "load", F.coalesce("component", "id").alias("part")), "parts")
    per = parts.groupBy("grp", "part").agg(F.count("*").alias("m"), F.max("load").alias("load"))
    main = per.groupBy("grp").agg(F.max(F.struct("m", "part")).alias("top"), F.sum("m").alias("n"), F.max("load").alias("load"), F.count("*").alias("parts")).filter("parts > 1")
    main = written(main.select("grp", "n", "load", F.col("top.part").alias("top"), (F.col("n") - F.col("top.m")).alias("rest")), "main")
    if not main.limit(1).count():
        drop(sure, parts, main)
        return result
    both = parts.drop("load").join(main, "grp")
    gn, gr = _blocks("n", "load"), F.greatest(F.lit(1), F.least(_blocks("n", "load"), F.ceil(F.col("rest") / BLOCK).cast("int")))
    whole = both.select("grp", "id", "part", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), gr - 1)).alias("i"), _block(gn).alias("j"))
    rest = both.filter("part <> top").select("grp", "id", "part", F.lit(1).alias("side"), _block(gr).alias("i"), F.explode(F.sequence(F.lit(0), gn - 1)).alias("j"))
    placed = whole.union(rest).join(load.select(*columns), "id").select("grp", "i", "j", "side", "part", *columns).repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    more = written(placed.mapInArrow(_between(threshold), "a long, b long"), "more")
    again = components(result.select(F.col("component").alias("a"), F.col("id").alias("b")).union(more))
    drop(sure, more, parts, main, result)
    return again


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(id, component): what is connected by signatures that survive in some bucket."""

    def explode(batches):
        for b in batches:
            keys = np.frombuffer(b"".join(b["bands"].to_pylist()), dtype="<u8")
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(b["id"].to_numpy(), BANDS))], ["grp", "id"])

    rows = reps.select("id", "bands").mapInArrow(explode, "grp long, id long")
    counts = rows.groupBy("grp").agg(F.count("*").alias("n")).filter("n > 1")
    groups = written(rows.join(counts, "grp").select("grp", "id", "n", F.lit(0).cast("long").alias("load")), "members")
    out = connected(groups, reps.select("id", "sig"), ["id", "sig"], threshold)
    drop(groups)
    return out


def _sets(k: int):
    """The sorted shingle sets of texts that have the wanted digest."""

    def run(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                words = Words(batch["text"], lower=True)
                x, first = shingles(words, k)
                want = batch["digest"].to_pylist()
                mine = [d for d in range(batch.num_rows) if _digest(words, d) == want[d]]
                sets = [np.unique(x[first[d] : first[d + 1]]).astype("<u8").tobytes() for d in mine]
                at = pa.array(mine, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch[c].take(at) for c in ("grp", "id", "n", "load", "sig")), pa.array(sets, pa.binary())], ["grp", "id", "n", "load", "sig", "set"])

    return run


def links(docs: DataFrame, reps: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, component) of the class representatives that are linked with others."""
    labels = candidates(reps, threshold)
    free_shuffles(docs.sparkSession)
    known = reps.select("id", "sig", "digest", "n_shingles").join(labels.withColumnRenamed("component", "grp"), "id")
    sizes = written(known.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load")), "sizes")
    wanted = known.select("id", "sig", "digest", "grp").join(sizes, "grp")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select("text", "grp", "id", "n", "load", "digest", "sig")
    sets = written(texts.mapInArrow(_sets(k), "grp long, id long, n long, load long, sig binary, set binary"), "sets")
    free_shuffles(docs.sparkSession)
    # rows that repeat a doc_id and a text come twice, which changes nothing; a doc_id with several texts stands for several classes
    out = connected(sets, sets, ["id", "sig", "set"], threshold)
    drop(sets, sizes, labels)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    sketches = written(sketch(docs, k), "sketch")
    some = sketches.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # one row per class: of rows that repeat a doc_id and a text, any
    reps = written(some.select(F.col("doc_id").alias("id"), "digest", "bands", "sig", "n_shingles").join(classes.select("id", "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "reps")
    linked = links(docs, reps, k, threshold)
    labelled = classes.join(linked, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    ids = some.select("doc_id", "digest").join(written(labelled, "class-labels"), "digest").select("doc_id", "component")
    return _result(sketches, ids, classes, linked)


def _result(sketches: DataFrame, ids: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    ids = ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sketches.select("doc_id", "n_shingles").join(ids, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """Rows of ``docs`` (doc_id, text and others) that stay: of each component the one with the smallest doc_id.

    Of rows that share a doc_id one stays; rows without a doc_id stay all.
    """
    gone = written(near_duplicates(docs, k, threshold).filter("NOT kept").select("doc_id").distinct(), "gone")
    stay = docs.join(gone, "doc_id", "left_anti")
    again = written(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "ids-again")
    if not again.limit(1).count():
        return stay
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = stay.join(again, "doc_id", "left_semi").withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    return stay.join(again, "doc_id", "left_anti").unionByName(one)
