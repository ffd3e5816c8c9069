"""Integrity and chronology checks. Each gives issues: code, id, other.

Chronology compares bounds: an issue is a definite contradiction, and a missing bound gives none. Tables
without separate bounds use one year for both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIFESPAN, PARENT_MIN, PARENT_MAX, SPACING_MONTHS, ISSUE_CAP = 120, 12, 80, 9, 10


def _issue(df: DataFrame, code: str, id_: str | Column = "id", other: str | Column | None = None) -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(code).alias("code"), col(id_).cast("long").alias("id"), (F.lit(None) if other is None else col(other)).cast("long").alias("other"))


def unresolved(usages: DataFrame, definitions: DataFrame) -> DataFrame:
    """E001: targets of links (id, target) that nothing defines, each at its first use."""
    lost = usages.join(definitions.select(F.col("id").alias("target")), "target", "left_anti")
    return _issue(lost.groupBy("target").agg(F.min("id").alias("id")), "E001", "id", "target")


def duplicate_ids(records: DataFrame) -> DataFrame:
    """E002: further definitions of an id; (id, line)."""
    n = F.row_number().over(Window.partitionBy("id").orderBy("line"))
    return _issue(records.withColumn("n", n).filter("n > 1"), "E002", "id", "line")


def orphans(records: DataFrame, usages: DataFrame, code: str) -> DataFrame:
    return _issue(records.join(usages.select(F.col("target").alias("id")), "id", "left_anti"), code)


def unlinked_people(people: DataFrame, child_links: DataFrame, spouse_links: DataFrame) -> DataFrame:
    """W014: people who are nobody's child or spouse by their own links (id, fam)."""
    return _issue(people.join(child_links.select("id").union(spouse_links.select("id")), "id", "left_anti"), "W014")


def empty_families(families: DataFrame, children: DataFrame) -> DataFrame:
    """W015: families without members."""
    return _issue(families.filter("husb IS NULL AND wife IS NULL").join(children.select(F.col("fam").alias("id")), "id", "left_anti"), "W015")


def asymmetric(code: str, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """W016 and W017: links (id, fam) on one side that the other lacks, both ways."""
    keys = ["id", "fam"]
    one = ours.select(*keys).distinct().join(theirs.select(*keys).distinct(), keys, "left_anti")
    two = theirs.select(*keys).distinct().join(ours.select(*keys).distinct(), keys, "left_anti")
    return _issue(one.union(two), code, "id", "fam")


def death_before_birth(people: DataFrame) -> DataFrame:
    return _issue(people.filter("death_hi < birth_lo"), "E011")


def burial_order(people: DataFrame) -> DataFrame:
    return _issue(people.filter("burial_hi < death_lo OR burial_hi < birth_lo"), "W036")


def long_lives(people: DataFrame) -> DataFrame:
    return _issue(people.filter(F.col("death_lo") - F.col("birth_hi") > LIFESPAN), "W023")


def _child_and_parent(people: DataFrame, parents: DataFrame) -> DataFrame:
    c = people.select(F.col("id").alias("child"), F.col("birth_lo").alias("c_lo"), F.col("birth_hi").alias("c_hi"))
    p = people.select(F.col("id").alias("parent"), F.col("birth_lo").alias("p_lo"), F.col("birth_hi").alias("p_hi"))
    return parents.join(c, "child").join(p, "parent")


def birth_before_parent(people: DataFrame, parents: DataFrame) -> DataFrame:
    return _issue(_child_and_parent(people, parents).filter("c_hi < p_lo"), "E012", "child", "parent")


def parent_age(people: DataFrame, parents: DataFrame) -> DataFrame:
    """W020 too young; W021 mother, W022 father too old."""
    young = (F.col("c_hi") - F.col("p_lo")).between(0, PARENT_MIN - 1)
    old = F.col("c_lo") - F.col("p_hi") > PARENT_MAX
    code = F.when(young, "W020").when(old, F.when(F.col("role") == "W", "W021").otherwise("W022"))
    return _child_and_parent(people, parents).withColumn("code", code).filter("code IS NOT NULL").select("code", F.col("child").alias("id"), F.col("parent").alias("other"))


def marriage_before_birth(people: DataFrame, families: DataFrame) -> DataFrame:
    sides = families.select(F.col("id").alias("fam"), "marriage_year", F.expr("stack(2, husb, wife) as id"))
    return _issue(sides.join(people.select("id", "birth_lo"), "id").filter("marriage_year < birth_lo"), "W024", "id", "fam")


def child_before_marriage(people: DataFrame, families: DataFrame, children: DataFrame) -> DataFrame:
    j = children.join(families.select(F.col("id").alias("fam"), "marriage_year"), "fam").join(people.select(F.col("id").alias("child"), "birth_hi"), "child")
    return _issue(j.filter("birth_hi < marriage_year"), "W025", "child", "fam")


def sibling_spacing(people: DataFrame, children: DataFrame) -> DataFrame:
    """W026: exact births of one family, 1 to 8 months apart; twins share a month."""
    born = people.filter("birth_lo = birth_hi AND birth_month IS NOT NULL AND NOT birth_approximate").select(F.col("id").alias("child"), (F.col("birth_lo") * 12 + F.col("birth_month")).alias("m"))
    w = Window.partitionBy("fam").orderBy("m", "child")
    j = children.join(born, "child").withColumn("before", F.lag("m").over(w)).withColumn("sibling", F.lag("child").over(w))
    return _issue(j.filter((F.col("m") - F.col("before") > 0) & (F.col("m") - F.col("before") < SPACING_MONTHS)), "W026", "child", "sibling")


def sex_roles(people: DataFrame, families: DataFrame) -> DataFrame:
    sides = families.select(F.col("id").alias("fam"), F.expr("stack(2, 'F', husb, 'M', wife) as (wrong, id)"))
    return _issue(sides.join(people.select("id", "sex"), "id").filter("sex = wrong"), "W029", "id", "fam")


def capped(issues: DataFrame, cap: int = ISSUE_CAP) -> DataFrame:
    """The first ``cap`` issues of each code, with how many it has. The first places are sought in small
    salted groups before each code's, so that a very common code meets nowhere as a whole."""
    salted = issues.withColumn("salt", F.pmod(F.xxhash64("id", "other"), F.lit(64)))
    few = salted.withColumn("r", F.row_number().over(Window.partitionBy("code", "salt").orderBy("id", "other"))).filter(F.col("r") <= cap)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id", "other"))).filter(F.col("rank") <= cap)
    return few.join(F.broadcast(issues.groupBy("code").agg(F.count("*").alias("total"))), "code").select("code", "id", "other", "rank", "total")  # one row a code
