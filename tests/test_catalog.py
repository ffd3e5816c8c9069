"""Every query of the catalog against the same question in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from kinforge.plans import catalog, catalog_files  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, str)):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "isoformat"):
        return x.isoformat()
    return float(f"{float(x):.9g}")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_rows_equal_those_of_sql(name, spark, duck):
    frame = catalog.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    cursor = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert mine == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_queries_without_sql_run(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_greedy_matching_takes_the_best_pairs_first(spark):
    scored = catalog._scored(catalog.World(spark, SF)).filter("class <> 'non_match'")
    rows = sorted((-round(r["total"], 4), r["a"], r["b"]) for r in scored.collect())
    used, expected = set(), set()
    for _, a, b in rows:
        if a not in used and b not in used:
            used |= {a, b}
            expected.add((a, b))
    got = catalog.QUERIES["duplicates_greedy"](spark, SF).collect()
    assert {(r["a"], r["b"]) for r in got} == expected
