"""Steps that have to grow with their input: plans without what grows faster, and small cases of what went wrong on large tables."""

import contextlib

import duckdb
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.operators import graph, languages, linkage
from kinforge.plans import catalog, catalog_files  # noqa: F401
from kinforge.sources import gedcom


@contextlib.contextmanager
def conf(spark, **values):
    keys = {k: str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_languages_go_through_each_text_once(spark):
    rows = [("The man who was in the house, and his wife.",), ("Der Mann ist nicht mit der Frau und dem Kind.",), ("Ο άνθρωπος ήταν στο σπίτι του",), ("これは日本の家です",), ("12 345 678 901 234",), ("in",), (None,), ("x² the of and ² the of and was",)]
    found = languages.detected(spark.createDataFrame(rows, "text string"))
    assert {r["text"][:3]: r["lang"] for r in found.collect()} == {"The": "en", "Der": "de", "Ο ά": "el", "これは": None, "12 ": "unknown", "in": None, "x² ": "en"}
    assert "Join" not in plan(found) and plan(found).count("_by_words") <= 2


def test_each_file_is_written_by_one_task(spark):
    # on this table a join turns into a broadcast while it runs, and its shuffle is then read where it lies
    with conf(spark, **{"spark.sql.shuffle.partitions": 64}):
        made = catalog.QUERIES["file_convert_unicode"](spark, "/root/testdata/check_s").collect()
    assert len(made) == 16 and sum(r["names"] for r in made) == 51_282 and sum(r["lines"] for r in made) == 102_628


def test_names_are_as_near_as_in_sql(spark):
    pairs = [("thea,", "tiea"), ("tiea", "thea,"), ("martha", "marhta"), ("a", "a"), ("anna", "bob"), ("x" * 50 + "a", "x" * 50 + "b"), (None, "a")]
    got = spark.createDataFrame(pairs, "x string, y string").select(text.similarity("x", "y").alias("s"), text.best_similarity(F.array_compact(F.array("x")), F.array(F.lit("zz"), "y")).alias("m")).collect()
    sql = [duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", p).fetchone()[0] for p in pairs]
    assert [r["s"] for r in got] == sql
    assert [r["m"] for r in got] == sql
    assert [r["r"] for r in spark.createDataFrame([(0.69625,), (1.005,), (0.5,)], "x double").select(linkage.rounded(F.col("x"), 2).alias("r")).collect()] == [0.7, 1.0, 0.5]


PEOPLE = "id long, given string, surname string, sex string, birth_year int, death_year int, birth_place string"


def test_pairs_are_not_gathered_to_be_told_apart(spark):
    rows = [(i, ("Anna", "Hanna", "Jan")[i % 3], ("Smith", "Schmidt")[i % 2], "F", 1850 + i % 7, 1900 + i % 5, "") for i in range(60)]
    p = linkage.prepared(spark.createDataFrame(rows, PEOPLE), "metaphone")
    keys = linkage.block_keys(p, "metaphone")
    pairs = linkage.candidates(keys, keys, cap=20, same=True, left_rows=p, right_rows=p)
    found = [(r["a"], r["b"], r["surname_a"], r["surname_b"]) for r in pairs.collect()]
    small = {(r["pass"], r["key"]) for r in linkage.block_sizes(keys).filter("n <= 20").collect()}
    own = {}
    for r in keys.collect():
        own.setdefault(r["id"], set()).add((r["pass"], r["key"]))
    assert sorted(found) == sorted((a, b, rows[a][2].lower(), rows[b][2].lower()) for a in range(60) for b in range(a + 1, 60) if own[a] & own[b] & small)
    above = plan(linkage.scores(pairs)).split("SortMergeJoin")[0]
    assert "Exchange" not in above and "Aggregate" not in above


def test_greedy_goes_through_long_chains_in_few_rounds(spark, monkeypatch):
    cuts = []
    real = linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df: cuts.append(1) or real(df))
    clique = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40)]
    others = [(a, 100 + (a * 7 + k) % 50, round(0.65 + (a * 13 + k * 5) % 30 / 100, 4)) for a in range(60) for k in range(5)]
    for same, rows in ((True, clique), (False, clique), (True, clique + others), (False, clique + others)):
        one, expected = set(), set()
        two = one if same else set()
        for t, a, b in sorted((-t, a, b) for a, b, t in rows):
            if a not in one and b not in two:
                one.add(a), two.add(b), expected.add((a, b, -t))
        for slab in (100, 1_000_000):
            cuts.clear()
            got = linkage.greedy(spark.createDataFrame(rows, "a long, b long, total double"), same, slab)
            assert {tuple(r) for r in got.collect()} == expected
            assert slab == 100 or len(cuts) <= 3


def test_rounds_of_graphs_send_no_tables_to_the_driver(spark, monkeypatch):
    plans = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(plan(df)) or real(df))
    parents = spark.createDataFrame([(i, i // 2) for i in range(1, 40)] + [(101, 102), (102, 101), (103, 101)], "child long, parent long")
    people = parents.select(F.col("child").alias("id")).union(parents.select("parent")).distinct()
    depths = {r["id"]: r["depth"] for r in graph.generation_depth(people, parents).collect()}
    assert depths == {i: i.bit_length() for i in range(40)} | {101: 0, 102: 0, 103: 1}
    reach = graph.ancestors(people.filter("id = 39").withColumnRenamed("id", "root"), parents).collect()
    assert {(r["id"], r["depth"]) for r in reach} == {(39 >> k, k) for k in range(7)}
    assert {r["component"] for r in graph.components(people, parents.selectExpr("child as a", "parent as b")).collect()} == {0, 101}
    assert plans and not any("Broadcast" in p for p in plans)


def test_records_of_one_large_file_are_found_in_parts(spark):
    lines = spark.range(5000).select(F.lit("one").alias("file"), (F.col("id") * 7 + 1).alias("line_no"), F.when((F.col("id") > 3) & (F.col("id") < 2000) & (F.col("id") % 9 == 4), F.concat(F.lit("0 @I"), F.col("id"), F.lit("@ INDI"))).otherwise("1 NOTE x").alias("raw"))
    found = gedcom.records(gedcom.parse_lines(lines))
    assert found.columns[:3] == ["file", "line_no", "raw"] and found.columns[-3:] == ["record_id", "record_tag", "record_xref"]
    head = None
    for r in found.orderBy("line_no").collect():
        k = (r["line_no"] - 1) // 7
        head = k if 3 < k < 2000 and k % 9 == 4 else head
        expected = (r["line_no"], "", None) if head is None else (head * 7 + 1, "INDI", f"@I{head}@")
        assert (r["record_id"], r["record_tag"], r["record_xref"]) == expected
    sizes = [r["count"] for r in gedcom.in_parts(lines).groupBy("part").count().collect()]
    assert len(sizes) == gedcom.PARTS and max(sizes) < 100
