"""Learned operators: held-out accuracy and the parts of each model against plain formulas."""

import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from kinforge.llm import crf, langid, lbl, queries

SF = "/root/testdata/sf0.01"


def frame(spark, name):
    return queries.queries()[name](spark, SF).toPandas()


def test_quality_ranks_held_out_documents(spark):
    r = frame(spark, "op2_crf_quality")
    assert len(r) == len(pd.read_parquet(f"{SF}/documents.parquet")) and r.score.between(0, 1).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    assert (r.predicted == (r.score >= 0.3)).all()
    h = r.merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id").query("held_out")
    good, bad = h.score[h.quality == 1].to_numpy(), h.score[h.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (h.predicted == h.quality).mean() > 0.93


def test_marginals_equal_those_of_all_labellings():
    rng = np.random.default_rng(1)
    score, trans, first = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([0, 4, 4, 7])
    good, both, log_z = crf.marginals(score, first, trans)
    for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
        paths = list(itertools.product((0, 1), repeat=int(b - a))) if b > a else []
        weight = np.array([math.exp(sum(y * score[a + k] for k, y in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))) for p in paths])
        if not len(paths):
            continue
        assert log_z[d] == pytest.approx(math.log(weight.sum()))
        for k in range(b - a):
            assert good[a + k] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[k]) / weight.sum())
            if k + 1 < b - a:
                assert both[a + k, 1, 0] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[k] == 1 and p[k + 1] == 0) / weight.sum())


def test_languages_of_held_out_documents(spark):
    r = frame(spark, "op4_language_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    assert len(r) == len(docs) and r.score.between(0, 1).all()
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in r.doc_id]).all()
    h = r.merge(docs, on="doc_id").query("held_out and lang.notna() and lang_pred != 'und'")
    assert (h.lang == h.lang_pred).mean() > 0.98


def test_viterbi_finds_the_best_path():
    s = np.random.default_rng(4).normal(size=(6, 3)) * 5
    value = lambda p: sum(s[i, x] for i, x in enumerate(p)) - 3.0 * sum(x != y for x, y in zip(p, p[1:]))
    best = max(itertools.product(range(3), repeat=6), key=value)
    assert value(langid.viterbi(s, 3.0)) == pytest.approx(value(best))


def test_mixed_text_gets_two_spans(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    long = lambda lang: next(t for t, x in zip(docs.text, docs.lang) if x == lang and t and len(t) > 800)[:700]
    train = spark.createDataFrame(docs[["doc_id", "text", "lang"]])
    mixed = spark.createDataFrame([(3, long("en") + " " + long("de"), None), (1, None, None), (2, "12 34 !", None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in langid.languages(mixed, langid.learn(train)).collect()}
    assert {s["lang"] for s in rows[3]["spans"]} >= {"en", "de"}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == "und" and rows[1]["score"] == 0


def test_base_scores_and_counts_equal_plain_ones(spark):
    r = frame(spark, "op7_lbl_scores").set_index("doc_id")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    low = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for i, t in zip(docs.doc_id, docs.text)}
    counts: dict = {}
    for i, ts in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, ts in toks.items():
        assert r.n_tokens[i] == len(ts) and r.n_known[i] == sum(t in counts for t in ts) and r.train_tokens[i] == n
        assert r.base_score[i] == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in ts), abs=1e-6)
    h = r[r.held_out]
    assert h.score.sum() > h.base_score.sum()


def test_sequences_outside_the_first_sample_are_learned(spark):
    """Texts that the starting weights don't see teach what follows what."""
    ids = spark.range(3600).selectExpr("id AS doc_id", "xxhash64(id) AS h").orderBy("h", "doc_id").collect()
    order = [r["doc_id"] for r in ids if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    assert len(order) > lbl.SAMPLE_DOCS + 100
    chain = [f"z{k}" for k in range(10)]
    rows = [(i, "plain words here") for i in order[: lbl.SAMPLE_DOCS]] + [(i, " ".join(chain * 40)) for i in order[lbl.SAMPLE_DOCS :]]
    held = [r["doc_id"] for r in ids if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0][:2]
    rows += [(held[0], " ".join(chain * 3)), (held[1], " ".join(chain[::-1] * 3))]
    r = {x["doc_id"]: x for x in lbl.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["held_out"]}
    assert r[held[0]].base_score == pytest.approx(r[held[1]].base_score)
    assert r[held[0]].score > r[held[1]].score + 0.2 * 31
    assert r[held[0]].score > r[held[0]].base_score + 0.2 * 31


def test_means_of_tasks_weigh_rows_by_moves():
    unigram = np.full(4, 0.25)
    start = lbl.Weights.start(unigram, np.random.default_rng(0))
    w = [lbl.follow(start, [(np.array(ids), np.array([0, len(ids)]))], unigram, k) for k, ids in enumerate(([0, 1, 2], [0, 0], [3] * 2500))]
    assert all(x.moves[1].sum() == n for x, n in zip(w, (3, 2, 2500)))  # each token counts once, in whole steps or not
    parts = [lbl._part([v.astype(float) * m.reshape(-1, *[1] * (v.ndim - 1)) for v, m in zip(x.values, x.moves)], x.moves).to_pylist()[0] for x in w]
    out = lbl.mean(start, [(p["values"], p["moves"]) for p in parts])
    for k in range(4):
        for row in range(len(out[k])):
            m = [x.moves[k][row] for x in w]
            expected = np.average([x.values[k][row] for x in w], axis=0, weights=m) if sum(m) else start.values[k][row]
            assert out[k][row] == pytest.approx(expected, abs=1e-5)


def test_token_probabilities_are_normalised():
    rng = np.random.default_rng(2)
    m = lbl.Model(np.arange(1, 6, dtype=np.uint64), 100, 9, np.array([4.0]), *(rng.normal(size=(k, lbl.DIMENSIONS)) for k in (6, 7, 7)), rng.normal(size=6))
    z = m.normalisers()
    far, near, ids = (x.ravel() for x in np.meshgrid(np.arange(7), np.arange(7), np.arange(6), indexing="ij"))
    p = np.exp(m.log_probabilities(z, far, near, ids)).reshape(7, 7, 6)
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)
    score = lambda u, w, y: (m.far[u] + m.near[w]) @ m.target[y] + m.bias[y]
    for u, w, y in ((0, 1, 2), (6, 6, 5), (3, 6, 0)):
        plain = math.exp(score(u, w, y)) / sum(math.exp(score(u, w, x)) for x in range(6))
        assert p[u, w, y] == pytest.approx(plain, abs=1e-4)


def test_scores_equal_plain_ones_for_given_weights(spark, monkeypatch):
    """Every token's probability from the model's own numbers: the symbol's, and in a class the word's share."""
    kept = []
    fit = lbl.fit
    monkeypatch.setattr(lbl, "SHORTLIST", 40)
    monkeypatch.setattr(lbl, "BLOCK_ROWS", 16)
    monkeypatch.setattr(lbl, "SHARD_PAIRS", 500)
    monkeypatch.setattr(lbl, "fit", lambda *a: kept.append(fit(*a)) or kept[-1])
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")[["doc_id", "text"]].head(60)
    got = {r["doc_id"]: r for r in lbl.scores(spark.createDataFrame(docs)).collect()}
    m = kept[0]
    low = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    toks = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for i, t in zip(docs.doc_id, docs.text)}
    hashes = {None: lbl.END}
    for ts in toks.values():
        for t in ts[:-1]:
            if t not in hashes:
                hashes[t] = lbl.tokens(pa.array([t]))[0][0]
    counts: dict = {}
    for i, ts in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            for t in ts:
                counts[t] = counts.get(t, 0) + 1
    place = {h: k for k, h in enumerate(m.words.tolist())}
    symbol = lambda t: place.get(int(hashes[t]), len(place) + int(hashes[t] >> np.uint64(56)) % lbl.CLASSES)
    mass = np.zeros(lbl.CLASSES) + lbl.ALPHA
    for t, c in counts.items():
        if symbol(t) >= len(place):
            mass[symbol(t) - len(place)] += c + lbl.ALPHA
    assert np.allclose(mass, m.other_mass) and len(place) == 40
    begin = len(place) + lbl.CLASSES
    for i, ts in toks.items():
        ids, total = [begin, begin, *map(symbol, ts)], 0.0
        for k, t in enumerate(ts):
            s = (m.far[ids[k]] + m.near[ids[k + 1]]) @ m.target.T + m.bias
            total += s[ids[k + 2]] - np.log(np.exp(s.astype(float)).sum())
            if ids[k + 2] >= len(place):
                total += math.log((counts.get(t, 0) + lbl.ALPHA) / mass[ids[k + 2] - len(place)])
        assert got[i]["score"] == pytest.approx(total / math.log(10), abs=1e-3, rel=1e-4)


def test_contexts_stay_inside_texts():
    far, near = lbl.contexts(np.array([5, 6, 7, 8]), np.array([0, 3, 4]), 9)
    assert near.tolist() == [9, 5, 6, 9] and far.tolist() == [9, 9, 5, 9]


def test_lines_of_texts():
    lines = crf.Lines(pa.array(["One line.\n\n  two!\r\nthree", None, "", "x"]))
    assert np.diff(lines.first).tolist() == [3, 0, 0, 1]
