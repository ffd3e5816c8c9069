"""Checks of family-tree files line by line and record by record: (file, code, line_no, xref) of each issue.

The input is what ``gedcom.paths`` gives. Codes beginning with E are errors, with W warnings; the strict
ones (E013 to E016, W030 to W032) are asked for by a version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.dates import parse
from kinforge.operators._lineage import cut
from kinforge.sources.gedcom import MAX_LINE_BYTES, long_chains, structure

SEXES, CAP = ("M", "F", "U", "X"), 10
#: Codes of which a report shows the first few only.
CAPPED = ("W002", "W003", "W032", "W035")
#: Records that something has to refer to, and the code of those that nothing does.
REFERRED = {"NOTE": "W010", "OBJE": "W011", "SOUR": "W012", "REPO": "W013"}
DATED = [f"INDI/{t}/DATE" for t in ("BIRT", "CHR", "BAPM", "DEAT", "BURI")] + ["FAM/MARR/DATE"]


def _issue(df: DataFrame, code: str | Column, line: str = "line_no", xref: str = "record_xref") -> DataFrame:
    return df.select("file", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.col(line).cast("long").alias("line_no"), F.col(xref).alias("xref"))


def after_end(nodes: DataFrame) -> DataFrame:
    """E007: records that begin behind a TRLR, a second TRLR among them."""
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    tops = nodes.filter("level = 0 AND tag <> ''")
    return _issue(tops.withColumn("over", F.max((F.col("tag") == "TRLR").cast("int")).over(w)).filter("over = 1"), "E007")


def header(nodes: DataFrame, strict: str | None = None) -> DataFrame:
    """W005 without SUBM; asked for ``strict``, a version: E013 GEDC, E014 GEDC/VERS, E015 SOUR, E016 CHAR, W031 another version, W030 ANSEL in 5.5.5."""
    has = lambda path: F.bool_or(F.col("path") == path)
    value = lambda path: F.min_by("value", F.when(F.col("path") == path, F.col("line_no")))
    h = nodes.filter("record_tag = 'HEAD'").groupBy("file").agg(F.min("line_no").alias("line_no"), has("HEAD/SUBM").alias("subm"), has("HEAD/GEDC").alias("gedc"), has("HEAD/GEDC/VERS").alias("vers"), has("HEAD/SOUR").alias("sour"), has("HEAD/CHAR").alias("char"), value("HEAD/GEDC/VERS").alias("version"), value("HEAD/CHAR").alias("encoding"))
    codes = [F.when(~F.col("subm"), "W005")]
    if strict:
        codes += [F.when(~F.col("gedc"), "E013"), F.when(F.col("gedc") & ~F.col("vers"), "E014"), F.when(~F.col("sour"), "E015"), F.when(~F.col("char"), "E016"), F.when(F.trim("version") != strict, "W031")]
        codes += [F.when(F.upper(F.trim("encoding")) == "ANSEL", "W030")] if strict == "5.5.5" else []
    out = h.withColumn("code", F.explode(F.filter(F.array(*codes), lambda c: c.isNotNull())))
    return out.select("file", "code", "line_no", F.lit(None).cast("string").alias("xref"))


def long_lines(nodes: DataFrame, strict: bool = False) -> DataFrame:
    """W003, or W032 where a version is asked for: lines of more than 255 bytes."""
    return _issue(nodes.filter(F.octet_length("raw") > MAX_LINE_BYTES), "W032" if strict else "W003")


def custom_tags(nodes: DataFrame, most: int = CAP) -> DataFrame:
    """W004: each custom record, and the first use of each of the first ``most`` custom tags inside records; one more
    issue, where the next one stands, says that there are others."""
    own = nodes.filter(F.col("tag").startswith("_"))
    first = own.filter("level > 0").groupBy("file", "tag").agg(F.min_by(F.struct("line_no", "record_xref"), "line_no").alias("f"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("f.line_no", "tag"))
    first = first.withColumn("nth", nth).filter(F.col("nth") <= most + 1).select("file", "f.line_no", F.when(F.col("nth") <= most, F.col("f.record_xref")).alias("record_xref"))
    return _issue(own.filter("level = 0"), "W004").union(_issue(first, "W004"))


def orphans(nodes: DataFrame) -> DataFrame:
    """W010 to W013: notes, media, sources and repositories that no record with an id points to."""
    used = nodes.filter("is_pointer AND record_xref IS NOT NULL").select("file", F.trim("value").alias("xref"))
    code = reduce(lambda c, kv: c.when(F.col("tag") == kv[0], kv[1]), list(REFERRED.items())[1:], F.when(F.col("tag") == "NOTE", REFERRED["NOTE"]))
    defined = nodes.filter(F.col("tag").isin(*REFERRED) & (F.col("level") == 0) & F.col("xref").isNotNull())
    return _issue(defined.join(used, ["file", "xref"], "left_anti"), code)


def sexes(nodes: DataFrame) -> DataFrame:
    """W027: more than one SEX; W028: each SEX that is none of M, F, U and X."""
    lines = nodes.filter("path = 'INDI/SEX'")
    several = lines.groupBy("file", "record_id", "record_xref").agg(F.count("*").alias("n")).filter("n > 1")
    bad = ~F.upper(F.trim(F.coalesce("value", F.lit("")))).isin(*SEXES)
    return _issue(several, "W027", "record_id").union(_issue(lines.filter(bad), "W028"))


def media(nodes: DataFrame) -> DataFrame:
    """W033: media records without FILE; W034: each FILE of theirs without FORM."""
    rows = nodes.filter("record_tag = 'OBJE' AND record_xref IS NOT NULL")
    part = F.last(F.when(F.col("level") == 1, F.col("line_no")), ignorenulls=True).over(Window.partitionBy("file", "record_id").orderBy("line_no"))
    has = lambda path: F.bool_or(F.col("path") == path)
    parts = rows.withColumn("part", part).groupBy("file", "record_id", "record_xref", "part").agg(has("OBJE/FILE").alias("is_file"), has("OBJE/FILE/FORM").alias("form"))
    none = parts.groupBy("file", "record_id", "record_xref").agg(F.bool_or("is_file").alias("any")).filter("NOT any")
    return _issue(none, "W033", "record_id").union(_issue(parts.filter("is_file AND NOT form"), "W034", "part"))


def odd_dates(nodes: DataFrame) -> DataFrame:
    """W035: dates of events that can't be read, those in parentheses aside."""
    lines = nodes.filter(F.col("path").isin(DATED) & (F.trim(F.coalesce("value", F.lit(""))) != "") & ~F.trim("value").rlike(r"^\(.*\)$"))
    return _issue(lines.withColumn("d", parse(F.col("value"))).filter("NOT d.ok"), "W035")


def all_checks(nodes: DataFrame, strict: str | None = None) -> DataFrame:
    nodes = cut(nodes)  # written once, read by each check
    none = F.lit(None).cast("string")
    formal = structure(nodes).select("file", "code", "line_no", none.alias("xref"))
    parts = [formal, after_end(nodes), header(nodes, strict), long_lines(nodes, bool(strict)), custom_tags(nodes), orphans(nodes), sexes(nodes), media(nodes), odd_dates(nodes)]
    return reduce(DataFrame.unionByName, parts)


def too_long(nodes: DataFrame) -> DataFrame:
    """(file, line_no, run) of values that are continued over more lines than may be: such a file is to be split first."""
    return long_chains(nodes)


def reported(issues: DataFrame, most: int = CAP) -> DataFrame:
    """Issues as a report shows them: of the codes in ``CAPPED`` the first ``most`` of each file and one row without a
    line that has the number of the others in ``suppressed``."""
    capped = F.col("code").isin(*CAPPED)
    # first places are sought in small salted groups before each code's
    salted = issues.filter(capped).withColumn("salt", F.pmod(F.xxhash64("line_no"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("file", "code", "salt").orderBy("line_no"))).filter(F.col("r") <= most)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("file", "code").orderBy("line_no"))).filter(F.col("r") <= most)
    none = F.lit(0).cast("long").alias("suppressed")
    rest = issues.filter(capped).groupBy("file", "code").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    rest = rest.select("file", "code", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("xref"), (F.col("n") - most).alias("suppressed"))
    columns = ["file", "code", "line_no", "xref"]
    return issues.filter(~capped).select(*columns, none).unionByName(few.select(*columns, none)).unionByName(rest)


def tallies(shown: DataFrame) -> DataFrame:
    """(file, errors, warnings, ok) of :func:`reported` issues, those that it suppressed counted."""
    weight = F.when(F.col("suppressed") > 0, F.col("suppressed")).otherwise(1)
    error = F.col("code").startswith("E")
    out = shown.groupBy("file").agg(F.sum(F.when(error, weight).otherwise(0)).alias("errors"), F.sum(F.when(error, 0).otherwise(weight)).alias("warnings"))
    return out.withColumn("ok", F.col("errors") == 0)
