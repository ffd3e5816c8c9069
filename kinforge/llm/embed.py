"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Equal vectors of one label form one class. Each class is hashed in ``TABLES`` tables by ``HASHES``
pseudo-random rotations (three rounds of random signs and a Hadamard transform): a hash is the signed axis
that lies nearest. A vector stands in its own bucket and also looks into those where one hash is replaced
by one of its ``PROBES`` next nearest axes. In buckets, cosines of all candidates are computed in double
precision; a pair that meets in several buckets counts in the first of them only, which both vectors'
hashes tell, so pairs are never gathered. Buckets of more than ``BLOCK`` rows are compared block by block,
with no candidate left out: each vector's number of links counts every pair, so that the work in a dense
region grows with the square of its different vectors, in matrix products, while the rows that move grow
with that square over ``BLOCK``. Tasks hand on each vector's number of links and a forest of their links.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without a
label or vec_id, link with nothing (n_links 0; kept); vectors of different length don't link; rows that
repeat a vec_id count as vectors of their own; an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, mix
from kinforge.llm._store import drop, written
from kinforge.llm.components import Forest, components, whole_groups

COSINE = 0.93
TABLES, HASHES, PROBES = 10, 2, 2
#: Rows of a bucket that are compared with another block at once, at most, and components that they hold.
BLOCK, BLOCK_CELLS = 4096, 1 << 18
ROWS_AT_ONCE = 256


@lru_cache(maxsize=8)
def _signs(d: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 + d).choice(np.array([-1.0, 1.0]), (3, TABLES * HASHES, d))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the last axis, whose size is a power of two."""
    d, h = x.shape[-1], 1
    while h < d:
        y = x.reshape(*x.shape[:-1], d // (2 * h), 2, h)
        x = np.stack((y[..., 0, :] + y[..., 1, :], y[..., 0, :] - y[..., 1, :]), axis=-2).reshape(x.shape)
        h *= 2
    return x


def buckets(v: np.ndarray) -> np.ndarray:
    """[vectors, TABLES, 1 + HASHES * PROBES] bucket keys of non-zero vectors: the own one, then those looked into."""
    n, size = v.shape
    d = 1 << max(1, (size - 1).bit_length())
    out = np.empty((n, TABLES, 1 + HASHES * PROBES), dtype=U)
    signs = _signs(d)
    near = min(PROBES + 1, d)
    for at in range(0, n, 1024):
        x = np.zeros((min(1024, n - at), 1, d))
        x[:, 0, :size] = v[at : at + 1024]
        x /= np.linalg.norm(x, axis=2, keepdims=True)
        for r in range(3):
            x = hadamard(x * signs[r]) / np.sqrt(d)
        top = np.argpartition(-np.abs(x), near - 1, axis=2)[:, :, :near]
        value = np.take_along_axis(x, top, axis=2)
        order = np.argsort(-np.abs(value), axis=2, kind="stable")
        axis = np.take_along_axis(2 * top + (value < 0), order, axis=2).astype(U).reshape(len(x), TABLES, HASHES, near)
        if near <= PROBES:
            axis = np.concatenate((axis, np.repeat(axis[..., -1:], PROBES + 1 - near, axis=3)), axis=3)
        base = np.arange(1, TABLES + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(size)
        k = 0
        for h, p in [(0, 0), *((h, p) for h in range(HASHES) for p in range(1, PROBES + 1))]:
            key = np.broadcast_to(base, (len(x), TABLES))
            for i in range(HASHES):
                key = mix(key * U(0xC2B2AE3D27D4EB4F) + axis[:, :, i, p if i == h else 0])
            out[at : at + 1024, :, k] = key
            k += 1
    return out


def owners(mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of [pairs, TABLES, keys] bucket keys: the first table where one looks into the other's own
    bucket, and the lesser such bucket there."""
    first = np.full(len(mine), TABLES)
    key = np.zeros(len(mine), dtype=U)
    most = U(0xFFFFFFFFFFFFFFFF)
    for t in range(TABLES - 1, -1, -1):
        a, b = mine[:, t], theirs[:, t]
        in_b, in_a = (b == a[:, :1]).any(axis=1), (a == b[:, :1]).any(axis=1)
        k = np.minimum(np.where(in_b, a[:, 0], most), np.where(in_a, b[:, 0], most))
        hit = in_a | in_b
        first[hit], key[hit] = t, k[hit]
    return first, key


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _block_rows(size: int) -> int:
    """Rows of a block of vectors with ``size`` components."""
    return max(min(256, BLOCK), min(BLOCK, BLOCK_CELLS // size))


def _label_key(keys: np.ndarray, label: np.ndarray) -> np.ndarray:
    return mix(keys + label.astype(np.int64).view(U)[:, None, None] * U(0xD6E8FEB86659FD93))


def near_duplicates(vectors: DataFrame, threshold: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("v", finite) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)
    made = good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # the numbers become fixed as the table is written
    classes = written(made.withColumn("size", F.size("v")).withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    block = _block_rows(classes.agg(F.max("size")).first()[0] or 1)

    def hashed(batches):
        for b in batches:
            sizes = b["size"].to_numpy()
            for d in np.unique(sizes).tolist():
                part = b.filter(pa.array(sizes == d))
                keys = _label_key(buckets(_matrix(part["v"])), part["label"].to_numpy())
                each = keys.shape[1] * keys.shape[2]
                own = np.zeros(keys.shape, dtype=bool)
                own[:, :, 0] = True
                table = np.broadcast_to(np.arange(TABLES, dtype=np.int32)[None, :, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(table.ravel()), pa.array(own.ravel()), pa.array(np.repeat(part["id"].to_numpy(), each))], ["bucket", "t", "own", "id"])

    spread = classes.select("id", "label", "v", "size").mapInArrow(hashed, "bucket long, t int, own boolean, id long")
    spread = written(spread.distinct(), "vector-buckets")
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("own").alias("owned")).filter("n > 1 AND owned > 0").select("bucket", "n")
    g = F.ceil(F.col("n") / block).cast("int")
    members = spread.join(counts, "bucket").withColumn("blk", F.pmod(F.xxhash64("id", F.lit(7)), g).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    members = members.select("bucket", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "own", "t", "id")
    placed = members.join(classes, "id").select("bucket", "i", "j", "blk", "own", "t", "id", "v", "copies", "label", "size")
    placed = placed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "size")

    def compare(batches):
        forest = Forest()
        links: dict[int, int] = {}
        for t, starts in whole_groups(batches, ["bucket", "i", "j", "size"], rows=2048):
            ids, copies, label = t["id"].to_numpy(), t["copies"].to_numpy(), t["label"].to_numpy()
            own, blk = t["own"].to_numpy(), t["blk"].to_numpy()
            cross, table, bucket = t["i"].to_numpy() != t["j"].to_numpy(), t["t"].to_numpy(), t["bucket"].to_numpy().view(U)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if e - s < 2:
                    continue
                x = _matrix(t["v"].slice(s, e - s))
                norm = np.sqrt((x * x).sum(axis=1))
                lead = np.flatnonzero(own[s:e])
                for k in range(0, len(lead), ROWS_AT_ONCE):
                    part = lead[k : k + ROWS_AT_ONCE]
                    a, b = np.nonzero((x[part] @ x.T) / (norm[part][:, None] * norm) >= threshold)
                    a = part[a]
                    # a pair of two owners once; the same vector never
                    keep = (a < b) | ~own[s:e][b]
                    keep &= ids[s:e][a] != ids[s:e][b]
                    if cross[s]:
                        keep &= blk[s:e][a] != blk[s:e][b]
                    keep &= label[s:e][a] == label[s:e][b]
                    a, b = a[keep], b[keep]
                    if not len(a):
                        continue
                    used, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
                    keys = _label_key(buckets(x[used]), label[s:e][used])
                    p, q = inverse[: len(a)], inverse[len(a) :]
                    here = np.zeros(len(p), dtype=bool)
                    for c in range(0, len(p), 1 << 14):
                        first, key = owners(keys[p[c : c + (1 << 14)]], keys[q[c : c + (1 << 14)]])
                        here[c : c + (1 << 14)] = (first == table[s]) & (key == bucket[s])
                    p, q = p[here], q[here]
                    mine = ids[s:e][used]
                    gained = np.bincount(p, weights=copies[s:e][used][q], minlength=len(used)) + np.bincount(q, weights=copies[s:e][used][p], minlength=len(used))
                    for u, n in zip(mine.tolist(), gained.astype(np.int64).tolist()):
                        if n:
                            links[u] = links.get(u, 0) + n
                    for u, v in zip(mine[p].tolist(), mine[q].tolist()):
                        forest.join(u, v)
        f = forest.edges()
        n = len(links)
        a = pa.concat_arrays([pa.array(list(links), pa.int64()), f["a"]])
        b = pa.concat_arrays([pa.nulls(n, pa.int64()), f["b"]])
        yield pa.RecordBatch.from_arrays([a, b, pa.concat_arrays([pa.array(list(links.values()), pa.int64()), pa.nulls(f.num_rows, pa.int64())])], ["a", "b", "links"])

    found = written(placed.mapInArrow(compare, "a long, b long, links long"), "vector-links")
    labels = components(found.filter("b IS NOT NULL").select("a", "b"))
    least = labels.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("first"))
    labels = labels.join(least, "component").select("id", "first")
    per = found.filter("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    known = classes.join(per, "id", "left").join(labels, "id", "left")
    known = written(known.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component")), "vector-results")
    out = good.join(known, ["label", "v"]).select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
    drop(spread, found)
    rest = rows.filter(~(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.union(rest)
