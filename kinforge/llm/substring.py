"""Repeated passages by relative Lempel-Ziv parsing over a reference that is kept in indexed blocks.

The corpus is parsed relative to a reference made of it. Texts are cut into phrases by their content: of
the word k-grams in each window of ``WINDOW`` words the one with the least hash is its anchor, and
consecutive windows with one anchor are a phrase, so equal windows lie in phrases of equal anchors. The
reference has each different phrase once, where it stands first; it is indexed by anchor and span and
dealt over as many blocks as there are partitions. Each document's phrases look up their blocks together,
and are then parsed greedily from the left: as every phrase stands in the reference only once, the
longest factor is found by going on for as long as the next phrase follows in the reference as well.
Factors have a window's length or more by construction; they become duplicate spans as a whole if their
phrases stand elsewhere. At factor boundaries, where a phrase's anchor stands elsewhere with other words
around it, the factor may reach on by part of a phrase: these windows are checked one by one. So no
repeated window is missed. Every word under a repeated window goes.

Defined results: words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null texts have none; documents of fewer
words than a window keep all; rows that repeat a doc_id and a text count as occurrences of their own and
get the same result; an empty table gives an empty one; other columns are ignored. Windows are compared
by 64-bit hashes, together with their anchors'.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, Words, mix, prefix, segment_hash, text_slices
from kinforge.llm._store import bounded_batches, drop, free_shuffles, written

WINDOW = 35
ANCHOR = 10


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of the next ``width`` values is; the leftmost of equal ones."""
    n = len(h)
    at, have = np.arange(n), 1
    while have < width:
        step = min(have, width - have)
        other = at[np.minimum(np.arange(n) + step, n - 1)]
        at = np.where(h[other] < h[at], other, at)
        have += step
    return at


class Phrases:
    """The phrases of a batch: anchor hash, document, first window (from the document's start), windows, span hash."""

    def __init__(self, words: Words, window: int, anchor: int):
        n = len(words.start)
        self.sums = prefix(words.hash)
        ok = np.zeros(n, dtype=bool)
        if n >= window:
            ok[: n - window + 1] = words.doc[: n - window + 1] == words.doc[window - 1 :]
        grams = segment_hash(self.sums, np.arange(n - anchor + 1), np.arange(anchor, n + 1)) if n >= anchor else np.zeros(0, dtype=U)
        grams = np.concatenate((grams, np.full(n - len(grams), 0xFFFFFFFFFFFFFFFF, dtype=U)))
        least = _least(grams, window - anchor + 1) if n else np.zeros(0, dtype=np.int64)
        start = np.flatnonzero(ok)
        m = least[start]
        new = np.ones(len(start), dtype=bool)
        new[1:] = m[1:] != m[:-1]
        first = np.flatnonzero(new)
        self.start = start[first]
        self.windows = np.diff(np.append(first, len(start)))
        self.anchor = grams[m[first]]
        self.doc = words.doc[self.start]
        self.at = self.start - words.first[self.doc]
        span = segment_hash(self.sums, self.start, self.start + self.windows + window - 1)
        self.span = mix(span + (m[first] - self.start).astype(U) * U(0x9E3779B97F4A7C15))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both: rows are told apart by doc_id and key."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_doc"]) & (a["_key"] == b["_k"])


def reference(phrases: DataFrame) -> DataFrame:
    """Each different phrase (h, span) of ``phrases``: how often it stands, and where first (_doc, _k, s, n)."""
    first = F.min(F.struct("_doc", "_k", "s", "n")).alias("r")
    return phrases.groupBy("h", "span").agg(F.count("*").alias("times"), first).select("h", "span", "times", "r.*")


def factors(phrases: DataFrame, ref: DataFrame) -> DataFrame:
    """The greedy parse of the phrases that stand elsewhere too: _doc, _k, s (first window), n (windows) and the
    reference's place ref_doc, ref_k, ref_s.

    A factor ends where the next phrase stands elsewhere in the reference than behind the last one. Phrases
    of rows that repeat a document and its text are parsed once.
    """
    place = ref.filter("times > 1").select("h", "span", F.col("_doc").alias("ref_doc"), F.col("_k").alias("ref_k"), F.col("s").alias("ref_s"))
    found = phrases.join(place, ["h", "span"]).select("_doc", "_k", "s", "n", "ref_doc", "ref_k", "ref_s")
    found = found.repartition("_doc", "_k").dropDuplicates(["_doc", "_k", "s"])
    w = Window.partitionBy("_doc", "_k").orderBy("s")
    before = lambda c: F.lag(c).over(w)
    follows = (before("s") + before("n") == F.col("s")) & before("ref_doc").eqNullSafe(F.col("ref_doc")) & (before("ref_k") == F.col("ref_k")) & (F.col("ref_s") - before("ref_s") == F.col("s") - before("s"))
    found = found.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("factor", F.sum("new").over(w))
    parts = found.groupBy("_doc", "_k", "factor").agg(F.min("s").alias("s"), F.sum("n").cast("int").alias("n"), F.min(F.struct("s", "ref_doc", "ref_k", "ref_s")).alias("at"))
    return parts.select("_doc", "_k", "s", "n", "at.ref_doc", "at.ref_k", "at.ref_s")


def repeated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(_doc, _k, runs): for rows of ``docs`` with repeated windows, arrays of (first window, windows)."""

    def phrases(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                p = Phrases(Words(batch["text"], lower=False), window, anchor)
                where = pa.array(p.doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.anchor.view(np.int64)), pa.array(p.span.view(np.int64)), batch["doc_id"].cast(pa.int64()).take(where), batch["_key"].take(where), pa.array(p.at, pa.int32()), pa.array(p.windows, pa.int32())],
                    ["h", "span", "_doc", "_k", "s", "n"],
                )

    source = _keyed(docs.select("doc_id", "text"))
    all_ = written(source.mapInArrow(phrases, "h long, span long, _doc long, _k long, s int, n int"), "phrases")
    again = written(all_.groupBy("h").agg(F.count("*").alias("times")).filter("times > 1").select("h"), "anchors")
    some = written(all_.join(again, "h"), "phrases-again")
    drop(all_)
    free_shuffles(docs.sparkSession)

    spans = written(reference(some), "spans")
    several = written(spans.groupBy("h").agg(F.count("*").alias("spans")).filter("spans > 1").select("h"), "anchors-several")
    whole = factors(some, spans).select("_doc", "_k", "s", "n")

    asked = spans.join(several, "h").groupBy("_doc", "_k").agg(F.collect_list(F.struct("s", "n", "times")).alias("asked"))

    def windows(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                words = Words(batch["text"], lower=False)
                sums = prefix(words.hash)
                lists = batch["asked"]
                flat = lists.flatten()
                count = np.diff(lists.offsets.to_numpy())
                s, n, times = (flat.field(c).to_numpy().astype(np.int64) for c in range(3))
                doc = np.repeat(np.arange(batch.num_rows), count)
                row = np.repeat(np.arange(len(s)), n)
                pos = s[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = words.first[doc[row]] + pos
                h = segment_hash(sums, at, at + window)
                where = pa.array(doc[row])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times[row]), batch["_doc"].take(where), batch["_k"].take(where), pa.array(pos, pa.int32())], ["w", "times", "_doc", "_k", "s"])

    # rows that repeat a document are read each, which changes nothing: their spans stand twice already
    joined = source.join(asked, _same(source, asked))
    checked = written(joined.select("text", "_doc", "_k", "asked").mapInArrow(windows, "w long, times long, _doc long, _k long, s int"), "windows")
    twice = written(checked.groupBy("w").agg(F.sum("times").alias("all")).filter("all > 1").select("w"), "windows-again")
    edges = checked.filter("times = 1").join(twice, "w").select("_doc", "_k", "s", F.lit(1).alias("n"))
    runs = written(whole.union(edges).groupBy("_doc", "_k").agg(F.collect_list(F.struct("s", "n")).alias("runs")), "runs")
    drop(some, again, spans, several, checked, twice)
    free_shuffles(docs.sparkSession)
    return runs


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs``, n_words, n_removed, kept_sha256 and kept_text of every row.

    kept_text has the kept words joined by one space; a text that loses nothing stays as it is.
    """
    bounded_batches(docs.sparkSession)
    runs = repeated(docs, window, anchor)
    source = _keyed(docs.select(*dict.fromkeys(("doc_id", "text", *columns))))
    joined = source.join(runs, _same(source, runs), "left").select(*dict.fromkeys(("text", *columns)), "runs")
    own = [f for f in joined.schema.fields if f.name in columns]
    order = [f.name for f in own]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own) + ", n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches):
        for big in batches:
            for batch in text_slices(big, "text"):
                words = Words(batch["text"], lower=False)
                removed, digest, kept = [], [], []
                runs, texts = batch["runs"], batch["text"]
                data = words.data.tobytes()
                for d in range(batch.num_rows):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    gone = np.zeros(b - a + 1, dtype=np.int64)
                    if runs[d].is_valid:
                        flat = runs[d].values
                        s, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
                        np.add.at(gone, s, 1)
                        np.add.at(gone, s + n + window - 1, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                    text = b" ".join([data[i:j] for i, j in zip(words.start[stay].tolist(), words.end[stay].tolist())])
                    removed.append(b - a - len(stay))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text.decode("utf-8") if removed[-1] else texts[d].as_py())
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c] for c in order), pa.array(words.count, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                    [*order, "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return joined.mapInArrow(run, schema)
