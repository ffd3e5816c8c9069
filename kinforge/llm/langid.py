"""Languages of texts: scripts narrow the candidates, Viterbi over word scores labels spans.

Learning counts letter trigrams and words of each language, in hashed buckets, over every training
document, and the share of each script among a language's letters. A word can only belong to languages
that use its script. Its score for a language is the mean log-probability of its trigrams and of itself,
times ``WEIGHT``; the best path through a text's words pays ``SWITCH`` for each change of language. A text
for which no stretch of words gains more than that over its best language has one span, which a running
sum shows for all texts at once; only the others need the full search.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and if nothing was learned;
a text whose scripts no learned language uses gets the most frequent language with score 0; rows without
a doc_id are training rows when they have a lang; repeated rows count each; an empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm._arrays import U, mix, prefix, segment_hash, text_slices
from kinforge.llm._rows import rows_kept
from kinforge.llm._store import bounded_batches
from kinforge.llm.bpe import _LETTER, char_classes, texts_of
from kinforge.llm.decontam import folds

BUCKETS = 1 << 16
WEIGHT, SWITCH = 2.0, 8.0
#: A language uses a script that has this share of its letters at least.
SCRIPT_SHARE = 0.01
UNDEFINED = "und"

_RANGES = [
    ("Latin", [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)]),
    ("Greek", [(0x370, 0x3FF), (0x1F00, 0x1FFF)]), ("Cyrillic", [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("Armenian", [(0x530, 0x58F)]), ("Hebrew", [(0x590, 0x5FF)]), ("Arabic", [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)]),
    ("Devanagari", [(0x900, 0x97F)]), ("Bengali", [(0x980, 0x9FF)]), ("Gurmukhi", [(0xA00, 0xA7F)]), ("Gujarati", [(0xA80, 0xAFF)]), ("Tamil", [(0xB80, 0xBFF)]),
    ("Telugu", [(0xC00, 0xC7F)]), ("Kannada", [(0xC80, 0xCFF)]), ("Malayalam", [(0xD00, 0xD7F)]), ("Sinhala", [(0xD80, 0xDFF)]), ("Thai", [(0xE00, 0xE7F)]), ("Lao", [(0xE80, 0xEFF)]),
    ("Tibetan", [(0xF00, 0xFFF)]), ("Myanmar", [(0x1000, 0x109F)]), ("Georgian", [(0x10A0, 0x10FF)]), ("Hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("Ethiopic", [(0x1200, 0x137F)]), ("Khmer", [(0x1780, 0x17FF)]), ("Kana", [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]), ("Han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]),
]
SCRIPTS = ["Other", *(name for name, _ in _RANGES)]
_table: list[np.ndarray] = []


def script_table() -> np.ndarray:
    if not _table:
        out = np.zeros(0x110000, dtype=np.uint8)
        for k, (_, ranges) in enumerate(_RANGES, 1):
            for a, b in ranges:
                out[a : b + 1] = k
        _table.append(out)
    return _table[0]


class Letters:
    """Words of letters in texts, lowered, with their features.

    first: each text's first word, one longer; size: letters of each word; letter: each word's first letter
    among all letters; trigram, word: feature buckets of each letter and of each word; script: of each word.
    """

    def __init__(self, texts: list[str]):
        low, _ = folds()
        code = np.frombuffer((" " + "\0".join(texts) + "\0").encode("utf-32-le"), dtype=np.uint32)
        is_letter = char_classes()[code] == _LETTER
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        keep[0] = keep[-1] = True
        at = np.flatnonzero(keep)
        inside = is_letter[at]
        c = np.where(inside, low[code[at]], 32).astype(U)
        mid = np.flatnonzero(inside)
        self.trigram = (mix(c[mid - 1] << U(42) ^ c[mid] << U(21) ^ c[mid + 1]) >> U(48)).astype(np.int64) if len(mid) else np.zeros(0, dtype=np.int64)
        begin = mid[~inside[mid - 1]] if len(mid) else mid
        end = mid[~inside[mid + 1]] + 1 if len(mid) else mid
        self.size = end - begin
        self.letter = np.searchsorted(mid, begin)
        self.word = BUCKETS + (segment_hash(prefix(mix(c)), begin, end) >> U(48)).astype(np.int64)
        self.script = script_table()[code[at[begin]]]
        edge = 1 + np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)))
        self.first = np.searchsorted(at[begin], edge)


def held_out(folds_: int = 3, rest: int = 1):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds_)) == rest, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # [2 * BUCKETS, languages]
    uses: np.ndarray  # [scripts, languages]
    prior: np.ndarray


def learn(docs: DataFrame) -> Model:
    """Counts over every row of ``docs`` (doc_id, text, lang) that is not held out and has a lang."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for big in batches:
            for batch in text_slices(big, "text", 1 << 19):
                f = Letters(texts_of(batch["text"]))
                langs = pc.dictionary_encode(batch["lang"])
                per_doc = np.diff(f.first)
                of_word = np.repeat(langs.indices.to_numpy(), per_doc)
                of_letter = np.repeat(of_word, f.size)
                for k, name in enumerate(langs.dictionary.to_pylist()):
                    mine, w = of_letter == k, of_word == k
                    c = counts.setdefault(name, np.zeros(2 * BUCKETS + 256, dtype=np.int64))
                    c[:BUCKETS] += np.bincount(f.trigram[mine], minlength=BUCKETS)
                    c[BUCKETS : 2 * BUCKETS] += np.bincount(f.word[w] - BUCKETS, minlength=BUCKETS)
                    c[2 * BUCKETS :] += np.bincount(f.script[w], weights=f.size[w], minlength=256).astype(np.int64)
        for name, c in counts.items():
            key = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key, pa.int32()), pa.array(c[key])], ["lang", "key", "n"])

    train = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("text", "lang")
    # at most 2 * BUCKETS + 256 rows for each language
    t = train.mapInArrow(run, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(t["lang"].unique().to_pylist()))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((2 * BUCKETS + 256, len(languages)))
    if languages:
        d = t["lang"].combine_chunks().dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        col = np.array([place[x] for x in d.dictionary.to_pylist()])[d.indices.to_numpy()]
        counts[t["key"].to_numpy(), col] = t["n"].to_numpy()
    logp = np.empty((2 * BUCKETS, len(languages)))
    for a, b in ((0, BUCKETS), (BUCKETS, 2 * BUCKETS)):
        part = counts[a:b]
        # smoothed towards the mean of the languages, so that what one of them has not seen costs a bounded amount
        mean = (part / np.maximum(part.sum(axis=0), 1)).mean(axis=1, keepdims=True) if languages else part
        strength = 0.01 * np.maximum(part.sum(axis=0), 1) ** 0.75
        logp[a:b] = np.log((part + strength * (mean * 0.5 + 0.5 / BUCKETS)) / (part.sum(axis=0) + strength))
    scripts = counts[2 * BUCKETS :]
    letters = np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, logp.astype(np.float32), scripts[: len(SCRIPTS)] / letters >= SCRIPT_SHARE, letters / letters.sum() if languages else letters)


def word_scores(m: Model, f: Letters) -> np.ndarray:
    """[words, languages]; -inf where the language doesn't use the word's script, all 0 where none does."""
    if not len(f.size):
        return np.zeros((0, len(m.languages)))
    s = np.add.reduceat(m.logp[f.trigram], f.letter, axis=0).astype(np.float64) + m.logp[f.word]
    s *= (WEIGHT / (f.size + 1))[:, None]
    uses = m.uses[f.script]
    none = ~uses.any(axis=1)
    s[~uses] = -1e3
    s[none] = 0
    return s


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word, where each change of language costs ``switch``."""
    n, k = s.shape
    back = np.empty((n, k), dtype=np.int32)
    best = s[0].copy()
    own = np.arange(k)
    for i in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[i] = np.where(stay, own, top)
        best = np.where(stay, best, best[top] - switch) + s[i]
    path = np.empty(n, dtype=np.int32)
    path[-1] = best.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def label(m: Model, f: Letters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each word's language, and each text's language (-1: no letter) and score."""
    s = word_scores(m, f)
    count = np.diff(f.first)
    some = np.flatnonzero(count)
    lang, score = np.full(len(count), -1), np.zeros(len(count))
    if not len(some) or not m.languages:
        return np.full(len(s), -1), np.full(len(count), -1), score
    begin = f.first[some]
    total = np.add.reduceat(s, begin, axis=0)
    best = total.argmax(axis=1)
    word_best = np.repeat(best, count[some])
    path = word_best.copy()
    if len(m.languages) > 1:
        own = s[np.arange(len(s)), word_best]
        others = s.copy()
        others[np.arange(len(s)), word_best] = -np.inf
        gain = np.clip(others.max(axis=1) - own, -1e4, 1e4)
        # largest gain of a stretch: running sum less its least value so far, texts kept apart by large steps
        sums = np.cumsum(gain)
        doc = np.repeat(np.arange(len(some)), count[some])
        gap = (sums.max() - sums.min() + 1.0) * doc
        before = np.concatenate(([0.0], sums[:-1]))
        least = np.minimum.accumulate(before - gap) + gap
        rise = np.maximum.reduceat(sums - least, begin)
        for k in np.flatnonzero(rise > SWITCH).tolist():
            a, b = int(begin[k]), int(begin[k] + count[some[k]])
            path[a:b] = viterbi(s[a:b])
    doc = np.repeat(np.arange(len(some)), count[some])
    weight = np.bincount(doc * len(m.languages) + path, weights=f.size, minlength=len(some) * len(m.languages)).reshape(len(some), -1)
    known = np.bincount(doc, weights=f.size * m.uses[f.script].any(axis=1), minlength=len(some))
    letters = weight.sum(axis=1)
    top = np.where(known > 0, (weight - (known[:, None] == 0) * weight + 0).argmax(axis=1), int(m.prior.argmax()))
    e = total / np.sqrt(count[some])[:, None]
    e -= e.max(axis=1, keepdims=True)
    p = np.exp(e)
    chance = p[np.arange(len(some)), best] / p.sum(axis=1)
    lang[some] = top
    score[some] = np.clip(chance * weight[np.arange(len(some)), top] / letters * (known / letters), 0, 1)
    return path, lang, score


def languages(docs: DataFrame, model: Model | None = None, with_spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if wanted, spans (first word, words, language) of every row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(docs))
    names = ["doc_id", "held_out", "lang_pred", "score", "spans"]

    def run(batches):
        m = shared.value
        for big in batches:
            for batch in text_slices(big, "text", 1 << 19):
                f = Letters(texts_of(batch["text"]))
                path, lang, score = label(m, f)
                columns = [
                    batch["doc_id"].cast(pa.int64()),
                    batch["held_out"],
                    pa.array([m.languages[k] if k >= 0 else UNDEFINED for k in lang.tolist()], pa.string()),
                    pa.array(score),
                ]
                if not with_spans:
                    yield pa.RecordBatch.from_arrays(columns, names[:4])
                    continue
                spans = []
                for d, (a, b) in enumerate(zip(f.first[:-1].tolist(), f.first[1:].tolist())):
                    part = path[a:b]
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1)) if b > a else []
                    spans.append([{"first": int(x), "words": int(y - x), "lang": m.languages[part[x]]} for x, y in zip(cut, [*cut[1:], b - a])] if lang[d] >= 0 else [])
                columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    schema += ", spans array<struct<first: int, words: int, lang: string>>" if with_spans else ""
    return docs.select("doc_id", "text").withColumn("held_out", held_out()).mapInArrow(run, schema)


def recognised(docs: DataFrame, least: float) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, lang and others) with a language of score ``least`` or more.

    If nothing could be learned, those with a letter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def mask():
        m = shared.value

        def keep(batch: pa.RecordBatch) -> np.ndarray:
            f = Letters(texts_of(batch["text"]))
            if not m.languages:
                return np.diff(f.first) > 0
            _, lang, score = label(m, f)
            return (lang >= 0) & (score >= least)

        return keep

    return rows_kept(docs, mask)
