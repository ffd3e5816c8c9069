"""Dates, names, similarity, the search language and file encodings on small cases."""

import pytest
from pyspark.sql import functions as F

from kinforge.functions import text
from kinforge.functions.dates import parse, read_date, year_closeness
from kinforge.operators import search
from kinforge.sources import gedcom

DATES = [
    ("12 MAR 1850", ("SIMPLE", 1850, 1850, 1850, 3, "full", True)),
    ("MAR 1850", ("SIMPLE", 1850, 1850, 1850, 3, "partial", True)),
    ("abt 1850", ("ABT", 1850, 1850, 1850, None, "approximate", True)),
    ("BEF 1850", ("BEF", 1850, None, 1850, None, "approximate", True)),
    ("AFT 1850", ("AFT", 1850, 1850, None, None, "approximate", True)),
    ("BET 1840 AND 1850", ("BETWEEN", 1840, 1840, 1850, None, "approximate", True)),
    ("FROM 1840 TO 1850", ("PERIOD", 1840, 1840, 1850, None, "approximate", True)),
    ("11 FEB 1723/24", ("SIMPLE", 1723, 1724, 1724, 2, "full", True)),
    ("44 B.C.", ("SIMPLE", -44, -44, -44, None, "partial", True)),
    ("@#DHEBREW@ 5 TSH 5700", ("SIMPLE", 5700, 1939, 1939, None, "partial", True)),
    ("@#DFRENCH R@ VEND 12", ("SIMPLE", 12, 1803, 1803, None, "partial", True)),
    ("(about 1850 or 1860)", ("PHRASE", 1850, 1850, 1860, None, "approximate", False)),
    ("FOO 1850", ("PHRASE", 1850, 1850, 1850, None, "approximate", False)),
    ("", ("PHRASE", None, None, None, None, "missing", False)),
    (None, ("SIMPLE", None, None, None, None, "missing", False)),
]


@pytest.mark.parametrize("value,expected", DATES)
def test_dates(value, expected):
    assert read_date(value, 2026) == expected


def test_dates_as_a_column(spark):
    frame = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(DATES)], "k int, v string")
    rows = frame.select("k", parse(F.col("v")).alias("d")).orderBy("k").collect()
    assert [tuple(r["d"]) for r in rows] == [e for _, e in DATES]


def test_similarity_known_values():
    assert round(text.jaro_winkler("springfield", "illinois"), 4) == 0.4381
    assert round(text.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert text.jaro_winkler("smith", "jones") == 0
    assert text.jaro_winkler("", "") == 1 and text.jaro_winkler("", "a") == 0
    assert text._aligned("springfield, springfield", "springfield, illinois") == pytest.approx(0.7190, abs=1e-3)


def test_soundex_and_folding(spark):
    names = ["Robert", "Rupert", "Ashcraft", "Tymczak", "Müller", "", None]
    frame = spark.createDataFrame([(n,) for n in names], "n string").select(text.soundex(text.fold("n")).alias("c"))
    assert [r["c"] for r in frame.collect()] == ["R163", "R163", "A261", "T522", "M460", "", None]


def test_year_closeness(spark):
    row = spark.range(1).select(*(year_closeness(F.lit(1850), F.lit(1850 + d)).alias(f"d{d}") for d in (0, 1, 2, 3, 5, 7, 10, 11)))
    assert list(row.first()) == [1.0, 0.85, 0.7, 0.5, 0.25, 0.1, 0.05, 0.0]


@pytest.mark.parametrize("bad", ["", "born:x", "born:1900-1800", "born=1800-1900", "color:red", "place~x", "sex:mf", "surname:a*", "ancestor:5", 'name:"open'])
def test_queries_that_cannot_run(bad):
    with pytest.raises(search.QueryError):
        search.parse(bad)


@pytest.mark.parametrize("bad", ["(a+)+", "((((a))))", "a" * 257, "(", "(a|b)*"])
def test_patterns_that_could_blow_up(bad):
    with pytest.raises(search.QueryError):
        search.check_regex(bad)


def test_encodings(tmp_path, spark):
    assert gedcom.detect("﻿0 HEAD\n".encode()) == ("utf-8", True)
    assert gedcom.detect("0 HEAD\n".encode("utf-16")) == ("utf-16-le", True)
    assert gedcom.detect(b"0 HEAD\n1 CHAR ANSEL\n") == ("ansel", False)
    assert gedcom.decode_ansel(b"\xe8uber") == "über"
    (tmp_path / "a.ged").write_bytes("﻿0 HEAD\r\n1 CHAR UTF-8\r0 @I1@ INDI\n1 NAME A /B\u0085C/\njunk\n0 TRLR\n".encode())
    rows = gedcom.records(gedcom.parse_lines(gedcom.read_lines(spark, f"file://{tmp_path}"))).orderBy("line_no").collect()
    assert [r["tag"] for r in rows] == ["HEAD", "CHAR", "INDI", "NAME", "", "TRLR"]
    assert rows[3]["value"] == "A /B\u0085C/" and rows[3]["record_xref"] == "@I1@" and rows[4]["raw"] == "junk"


def test_files_over_the_limit_are_named(tmp_path, spark, monkeypatch):
    (tmp_path / "small.ged").write_text("0 HEAD\n0 TRLR\n")
    assert gedcom.read_lines(spark, f"file://{tmp_path}").count() == 2
    (tmp_path / "large.ged").write_text("0 HEAD\n1 NOTE long\n0 TRLR\n")
    monkeypatch.setattr(gedcom, "MAX_FILE_BYTES", 16)
    for run in (lambda f: f.collect(), lambda f: f.count()):
        with pytest.raises(Exception, match="large.ged has 26 bytes, more than 16"):
            run(gedcom.read_lines(spark, f"file://{tmp_path}"))
