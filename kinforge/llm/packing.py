"""Best-fit packing of token sequences by bin completion.

Documents become ids (a word-level vocabulary, one end id behind each); only longer ones are cut into
pieces of ``capacity``. What decides a packing is how many pieces there are of each length, and that
table has ``capacity`` rows at most whatever the corpus holds, so the driver searches for a packing on
it. The best-fit solution is the first incumbent, kept at once where it meets the lower bound. Otherwise
bins are completed around the largest piece that is left, by all its undominated fillings, least waste
first; branches are pruned by the waste they may still have and by the lower bound of what they leave.
A search that ends by itself has found the fewest bins; one that ``NODES`` or ``STEPS`` end has not
proved it, and a warning gives the bound. Pieces then find their place by their rank among those of
equal length, which is counted in salted groups.

Defined results: a null text counts as empty (its only id is the end id); repeated rows and null ids are
packed row by row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm._arrays import text_slices
from kinforge.llm._store import bounded_batches, written
from kinforge.llm.bpe import VOCABULARY, crc, encoder, texts_of, vocabulary_path

CAPACITY = 4096
END_ID = 1
#: Nodes of the search, and steps of its fillings, after which the best packing so far is taken.
NODES, STEPS = 20_000, 20_000_000

#: Pieces of a salted group of one length, about.
SALTED = 20_000

Pattern = tuple[tuple[int, int], ...]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's second bound."""
    n, v = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    half = capacity // 2
    a = np.arange(half + 1)
    large, middle = n[-1] - n[capacity - a], n[capacity - a] - n[half]
    small = v[half] - np.where(a > 0, v[np.maximum(a - 1, 0)], 0)
    extra = small - (middle * capacity - (v[capacity - a] - v[half]))
    return int(max(-(-int(v[-1]) // capacity), (large + middle + np.maximum(0, -(-extra // capacity))).max()))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over the table of lengths; bins with equal fillings stay together."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    closed: list[tuple[Pattern, int]] = []
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:
            room = next((r for r in range(length, capacity) if groups.get(r)), capacity)
            pattern, bins = groups[room].pop() if room < capacity else ((), -(-n // (capacity // length)))
            each = room // length
            used = min(bins, n // each)
            if used:
                put, k = used, each
            else:
                put, k = 1, n
            if bins > put and room < capacity:
                groups[room].append((pattern, bins - put))
            n -= put * k
            left, made = room - k * length, ((*pattern, (length, k)), put)
            (groups.setdefault(left, []) if left else closed).append(made)
    return closed + [x for g in groups.values() for x in g]


class Fillings:
    """Ways to fill a bin's room with pieces of a table of lengths that only shrinks."""

    def __init__(self, counts: np.ndarray, room: int, steps: int):
        self.room, self.steps = room, steps
        self.sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
        # sums that the lengths from each place on can make, as bits; too many once pieces are gone, never too few
        self.reach = [1]
        mask = (1 << (room + 1)) - 1
        for x in reversed(self.sizes):
            bits, left, k = self.reach[-1], min(int(counts[x]), room // x), 1
            while left:
                k = min(k, left)
                bits |= bits << (x * k) & mask
                left -= k
                k *= 2
            self.reach.append(bits)
        self.reach.reverse()

    def _sums(self, counts: np.ndarray, left: int, at: int) -> Iterator[list[int]]:
        """Multisets of available pieces from place ``at`` on that make ``left`` exactly, larger pieces first."""
        if not left:
            yield []
            return
        for j in range(at, len(self.sizes)):
            self.steps -= 1
            if self.steps < 0 or not self.reach[j] >> left & 1:
                return
            x = self.sizes[j]
            if x <= left and counts[x] > 0 and self.reach[j] >> (left - x) & 1:
                counts[x] -= 1
                rest = self._sums(counts, left - x, j)
                while True:
                    found = next(rest, None)
                    counts[x] += 1  # as the caller knows them while it holds the result
                    if found is None:
                        break
                    yield [x, *found]
                    counts[x] -= 1

    def undominated(self, counts: np.ndarray, room: int) -> Iterator[tuple[int, Pattern]]:
        """(waste, filling) of ``room``, least waste first, one at a time; ``counts`` is changed meanwhile.

        A filling is dominated if an available piece fits beside it, or fits in place of several of its
        pieces or of one smaller piece: whatever bins follow, the other filling leaves them no less room.
        """
        for waste in range(room + 1):
            if not self.reach[0] >> (room - waste) & 1:
                continue
            for items in self._sums(counts, room - waste, 0):
                if not dominated(items, waste, counts, room):
                    pattern: dict[int, int] = {}
                    for x in items:
                        pattern[x] = pattern.get(x, 0) + 1
                    yield waste, tuple(pattern.items())
            least = np.flatnonzero(counts)
            if not len(least) or waste >= least[0] and waste >= room - int((least * counts[least]).sum()):
                return  # from here on a piece always fits beside, or none is left over


def dominated(items: list[int], waste: int, counts: np.ndarray, room: int) -> bool:
    left = counts[: room + 1].copy()
    sums = np.zeros(room + 1, dtype=bool)
    sums[0] = True
    for x in items:
        left[x] -= 1
        sums[x:] |= sums[:-x].copy()
    x = np.flatnonzero(left > 0)
    if not len(x):
        return False
    if x[0] <= waste:
        return True
    made = np.concatenate(([0], np.cumsum(sums)))  # made[k]: sums below k; 0 is one of them
    top = np.where(np.isin(x, items), x, x + 1)  # another piece of a length in the filling is no gain
    return bool((made[top] - made[np.maximum(x - waste, 1)] > 0).any())


@dataclass
class Packing:
    """(filling, bins) pairs, the lower bound, and whether the search went through all it had to."""

    fillings: list[tuple[Pattern, int]]
    bins: int
    bound: int
    complete: bool


def bin_completion(counts: np.ndarray, capacity: int, nodes: int = NODES, steps: int = STEPS) -> Packing:
    """A packing of all pieces: the best-fit one where it meets the lower bound, else the best that the search finds.

    A node completes a bin around the largest piece that is left. Its branches are all undominated fillings,
    each for as many bins as there are pieces, then for fewer. Branches end where what they waste, or the
    lower bound of what they leave, excludes a better packing. The search stops after ``nodes`` nodes or
    ``steps`` steps of the fillings, numbers that don't depend on the machine.
    """
    counts = counts.astype(np.int64).copy()
    size = np.arange(capacity + 1)
    best = best_fit(counts, capacity)
    bins, bound = sum(m for _, m in best), lower_bound(counts, capacity)
    total = int((counts * size).sum())
    if bins == bound:
        return Packing(best, bins, bound, True)
    ways = Fillings(counts, capacity, steps)

    def branches(banned: tuple[int, Pattern] | None) -> Iterator[tuple[int, Pattern, int]]:
        largest = int(np.flatnonzero(counts)[-1])
        left = counts.copy()
        left[largest] -= 1
        for waste, filling in ways.undominated(left, capacity - largest):
            pattern = dict(filling)
            pattern[largest] = pattern.get(largest, 0) + 1
            full = tuple(sorted(pattern.items(), reverse=True))
            if banned == (largest, full):
                continue
            for m in range(min(int(counts[x]) // k for x, k in full), 0, -1):
                yield waste, full, m

    path: list[tuple[int, Pattern, int]] = []
    frames = [branches(None)]
    wasted = used = 0
    while frames and nodes > 0 and ways.steps >= 0:
        if len(path) == len(frames):
            waste, full, m = path.pop()
            for x, k in full:
                counts[x] += k * m
            wasted, used = wasted - waste * m, used - m
        step = next(frames[-1], None)
        allowed = (bins - 1) * capacity - total - wasted
        if step is None or step[0] > allowed:  # fillings come by waste
            frames.pop()
            continue
        waste, full, m = step
        if waste * m > allowed:
            continue
        nodes -= 1
        for x, k in full:
            counts[x] -= k * m
        path.append(step)
        wasted, used = wasted + waste * m, used + m
        if not counts.any():
            if used < bins:
                best, bins = [(p, m) for _, p, m in path], used
                if bins == bound:
                    return Packing(best, bins, bound, True)
            frames.append(iter(()))
        elif used + lower_bound(counts, capacity) >= bins:
            frames.append(iter(()))
        else:
            again = min(int(counts[x]) // k for x, k in full) > 0
            frames.append(branches((full[0][0], full) if again else None))
    return Packing(best, bins, bound, not frames)


class Slots:
    """Where the pieces of each length go, by their rank among them."""

    def __init__(self, packing: list[tuple[Pattern, int]]):
        rows = []
        base = 0
        taken: dict[int, int] = {}
        for pattern, bins in packing:
            at = 0
            for length, k in pattern:
                first = taken.get(length, 0)
                rows.append((length, first, k, base, at))
                taken[length] = first + k * bins
                at += k * length
            base += bins
        rows.sort()
        self.length, self.first, self.k, self.base, self.at = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (np.zeros(0, dtype=np.int64),) * 5
        self.key = (self.length << 48) + self.first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        k, nth = self.k[row], rank - self.first[row]
        return self.base[row] + nth // k, self.at[row] + nth % k * length


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches):
        enc = encoder(vocabulary_path(vocabulary))
        for big in batches:
            for batch in text_slices(big, "text"):
                cols: list[list[int]] = [[], [], [], [], []]
                row = []
                for n, ids in enumerate(enc.encode(texts_of(batch["text"]))):
                    raw = memoryview(np.append(ids, np.uint32(END_ID)).astype("<u4").tobytes())
                    size = len(raw) // 4
                    for p, start in enumerate(range(0, size, capacity)):
                        to = min(size, start + capacity)
                        row.append(n)
                        for c, v in zip(cols, (p, start, to - start, crc(raw[4 * start : 4 * to]))):
                            c.append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()).take(pa.array(row, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of ``docs`` (doc_id, text) with its sequence_id and the offset there."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, vocabulary, capacity), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    found = bin_completion(counts, capacity)
    if not found.complete:
        warnings.warn(f"{found.bins} sequences; {found.bound} are needed at least, and the search ended before it had tried all", stacklevel=2)
    slots = spark.sparkContext.broadcast(Slots(found.fillings))  # at most capacity fillings of few lengths each

    # the most frequent length in groups of some thousands
    salts = max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, int(counts.max()) // SALTED))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1).join(base, ["length", "salt"]).select(*pieces.columns, (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches):
        for b in batches:
            seq, at = slots.value.place(b["length"].to_numpy(), b["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(at)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECES + ", sequence_id long, offset long")
