"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, extra columns; the pipeline."""

import pandas as pd
import pytest

import corpus_pipeline
from kinforge.llm import bpe, crf, decontam, embed, langid, lbl, minhash, packing, substring, warc
from kinforge.llm._store import table

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, digest string, h int, held_out string, n int, block int, component string, runs int, score int"
ROWS = [
    (1, "The quick brown fox. " * 30, "en", "s", 5),
    (1, "The quick brown fox. " * 30, "en", "s", 5),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \n\t ", "de", None, 3),
    (None, "no id here at all", "en", "s", 4),
    (None, None, None, None, None),
    (5, "word " * 60_000, None, "s", 300_000),
    (6, "x" * 500_000, "fr", "s", 500_000),
    (7, "ÄÖÜ ß 漢字 🙂 \x00 end", "de", "s", 9),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "d", 2, "no", 3, 4, "c", 5, 6) for r in rows], COLUMNS)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


BENCH = [(1, "quick brown fox the quick brown fox", "en"), (None, None, None), (2, "", "e")]
OPERATORS = {
    "bpe": lambda s, d: bpe.token_counts(d),
    "crf": lambda s, d: crf.quality(d, labels_of(s, [(1, 1, 0, "t"), (1, 0, 0, None), (None, 1, 1, "t"), (3, None, None, None), (7, 0, 0, "x"), (2, 1, 0, "x")])),
    "langid": lambda s, d: langid.languages(d),
    "substring": lambda s, d: substring.dedup(d),
    "lbl": lambda s, d: lbl.scores(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_result_for_every_row(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, ROWS)).count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_an_empty_one(spark, name):
    assert OPERATORS[name](spark, docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_packing_and_leaks(spark, rows):
    d = docs_of(spark, rows)
    bench = spark.createDataFrame(BENCH, "item_id long, text string, lang string")
    packed = packing.pack(d).collect()
    assert sum(r["length"] for r in packed) >= len(rows) and sum(r["start"] == 0 for r in packed) == len(rows)
    assert {r["doc_id"] for r in decontam.leaks(d, bench).collect()} == ({1} if rows else set())
    assert decontam.leaks(d, bench.limit(0)).count() == 0
    assert decontam.clean(d, bench.limit(0)).count() == len(rows)


def test_empty_tables_of_other_kinds(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string, digest string")).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, id int")).count() == 0
    assert crf.quality(docs_of(spark, ROWS), labels_of(spark, [])).filter("score <> 0.5").count() == 0


def test_repeated_vectors_are_links_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0, 9), (1, [1.0, 0.0], 0, 9), (2, [1.0, 0.0], 0, 9), (3, [1.0, 0.0], None, 9), (None, [1.0, 0.0], 0, 9)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in got) == [(0, 0, 0), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_different_vectors_of_one_id_are_told_apart(spark):
    rows = [(1, [1.0, 0.0], 0, 9), (1, [1.0, 0.1], 0, 9), (2, [1.0, 0.2], 0, 9), (3, [0.9, 0.1], 0, 9), (2, [0.0, 1.0], 0, 9)]
    got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 3, 1), (1, 3, 1), (2, 0, 2), (2, 3, 1), (3, 3, 1)]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages_take_odd_rows_and_keep_the_columns(spark, rows):
    docs = docs_of(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert out.count() <= len(rows)
    assert sum(r["start"] == 0 for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == len(rows)


def test_pipeline_equals_its_parts_by_brute_force(spark):
    """Each decision of the stages on the smallest tables, made again by plain code."""
    from tests.llm.test_exact import brute_components

    docs = table(spark, SF, "documents")
    one = corpus_pipeline.language_id(spark, docs, SF).toPandas()
    letters = {i for i, t in zip(*(docs.toPandas()[c] for c in ("doc_id", "text"))) if t and any(c.isalpha() for c in t)}
    assert set(one.doc_id) <= letters and len(one) > 0.97 * len(letters)
    two = corpus_pipeline.near_dedup(spark, spark.createDataFrame(one), SF).toPandas()
    ordered = one.sort_values("doc_id").reset_index(drop=True)
    _, roots = brute_components(ordered.text.tolist(), 5)
    assert set(two.doc_id) == {ordered.doc_id[k] for k, r in enumerate(roots) if r == k}
    three = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(two), SF).toPandas().set_index("doc_id")
    lists = {i: t.split() for i, t in zip(two.doc_id, two.text)}
    seen: dict = {}
    for ws in lists.values():
        for k in range(len(ws) - 34):
            seen[tuple(ws[k : k + 35])] = seen.get(tuple(ws[k : k + 35]), 0) + 1
    for i, ws in lists.items():
        gone = {j for k in range(len(ws) - 34) if seen[tuple(ws[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = [w for j, w in enumerate(ws) if j not in gone]
        assert (i in three.index) == bool(kept) and (not kept or three.text[i].split() == kept)
    four = corpus_pipeline.decontaminate(spark, spark.createDataFrame(three.reset_index()[list(corpus_pipeline.COLUMNS)]), SF).toPandas()
    bench = [b.lower() for b in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    assert set(four.doc_id) <= set(three.index) and not any(b in t.lower() for t in four.text for b in bench)
    gone = [t.lower() for t in three.text[~three.index.isin(four.doc_id)]]
    assert all(any(b[k : k + 30] in t for b in bench for k in range(0, max(1, len(b) - 30), 5)) for t in gone)
    last = corpus_pipeline.run(spark, SF).toPandas()
    assert set(last.doc_id) == set(four.doc_id) and last.groupby("sequence_id").length.sum().max() <= 4096
