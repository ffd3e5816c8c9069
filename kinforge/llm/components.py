"""Connected components of links in a DataFrame, and grouped batches for block-wise work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._store import drop, written


class Forest:
    """Disjoint sets over arbitrary ids; each set's root is its smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while x != r:
            parent[x], x = r, parent.get(x, x)
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True

    def edges(self) -> pa.RecordBatch:
        """One link from each member to its set's smallest id."""
        members = [x for x in self.parent if self.root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([self.root(x) for x in members], pa.int64()), pa.array(members, pa.int64())], ["a", "b"])


def _forest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            forest.join(a, b)
    yield forest.edges()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b): the smallest id that links reach.

    Each task first reduces its links to a forest. Then labels go along links and labels of labels are
    followed, until nothing changes; each round is a written table. Joins are plain, so that Spark can
    split an id with very many links.
    """
    links = written(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(_forest_of, "a long, b long"), "links")
    both = written(links.union(links.select("b", "a")).distinct(), "links-both")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    for _ in range(rounds):
        sent = both.join(labels, both["a"] == labels["id"]).select(F.col("b").alias("id"), "component")
        near = written(sent.union(labels).groupBy("id").agg(F.min("component").alias("component")), "labels")
        far = near.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = written(near.join(far, "component", "left").select("id", F.coalesce("next", "component").alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        drop(near, labels)
        labels = new
        if not changed:
            drop(links, both)
            return labels
    raise RuntimeError("components did not settle")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where their groups begin, from batches sorted by ``keys``; the last
    group of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(t: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        new = np.zeros(t.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            v = t[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        if last:
            return t, np.append(starts, t.num_rows), t.slice(0, 0)
        return t.slice(0, starts[-1]), starts, t.slice(starts[-1])

    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            n += held[-1].num_rows
            if n >= rows:
                done, starts, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
                held, n = (rest.combine_chunks().to_batches() if rest.num_rows else []), rest.num_rows
                if done.num_rows:
                    yield done, starts
    if n:
        done, starts, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
        yield done, starts
