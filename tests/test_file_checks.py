"""Issues of a small file that breaks many rules."""

from kinforge.operators import file_checks
from kinforge.sources import gedcom

LINES = [
    "0 HEAD", "1 GEDC", "1 CHAR ANSEL", "0 @I1@ INDI", "1 SEX M", "1 SEX Q", "1 BIRT", "2 DATE sometime", "1 DEAT", "2 DATE (long ago)", "1 NOTE @N1@", "1 _TAG a", "1 _TAG b",
    "0 @N1@ NOTE used", "0 @N2@ NOTE unused", "0 @S1@ SOUR", "0 @O1@ OBJE", "1 FILE a.jpg", "2 FORM jpg", "1 FILE b.jpg", "0 @O2@ OBJE", "1 TITL " + "x" * 260, "0 _OWN", "0 TRLR", "0 @I2@ INDI", "0 TRLR",
]


def found(spark, strict=None):
    lines = spark.createDataFrame([("f", k, raw) for k, raw in enumerate(LINES, 1)], "file string, line_no long, raw string")
    nodes = gedcom.paths(gedcom.records(gedcom.parse_lines(lines)))
    return sorted((r["code"], r["line_no"]) for r in file_checks.all_checks(nodes, strict).collect())


def test_every_issue_once(spark):
    assert found(spark) == [("E007", 25), ("E007", 26), ("W003", 22), ("W004", 12), ("W004", 23), ("W005", 1), ("W010", 15), ("W011", 17), ("W011", 21), ("W012", 16), ("W027", 4), ("W028", 6), ("W033", 21), ("W034", 20), ("W035", 8)]


def test_strict_checks_of_the_header(spark):
    codes = {c for c, _ in found(spark, "5.5.5")}
    assert {"E014", "E015", "W030", "W032"} <= codes and not {"E013", "E016", "W003"} & codes
