"""Descriptive statistics over individuals and families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinforge.functions.dates import century

SUMMARY = ("average", "minimum", "maximum", "n")


def _count(name: str = "n") -> Column:
    return F.count("*").alias(name)


def summary(value: Column) -> list[Column]:
    """Average, least, greatest and number of a value; null averages where there is none."""
    return [F.avg(value).alias("average"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.count(value).alias("n")]


def gender_counts(people: DataFrame) -> DataFrame:
    return people.agg(F.count_if(F.col("sex") == "M").alias("male"), F.count_if(F.col("sex") == "F").alias("female"), F.count_if(~F.col("sex").isin("M", "F")).alias("unknown"))


def ranked(items: DataFrame, total: DataFrame, top: int, within: list[str] | None = None) -> DataFrame:
    """The most frequent of (name, first): count, percent of ``total`` (n) and rank; ties by first place."""
    keys = within or []
    counts = items.groupBy(*keys, "name").agg(_count("count"), F.min("first").alias("first"))
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), "first", "name")
    if not keys:
        picked = counts.orderBy(F.desc("count"), "first", "name").limit(max(1, top)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "first", "name")))
    else:
        picked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(1, top))
    joined = picked.join(F.broadcast(total), keys) if keys else picked.crossJoin(F.broadcast(total))  # one row, or one a key
    return joined.select(*keys, "rank", "name", "count", F.round(100.0 * F.col("count") / F.col("n"), 1).alias("percent"))


def top_surnames(people: DataFrame, top: int) -> DataFrame:
    parts = people.select(F.explode(F.split(F.trim("surname"), r"\s+")).alias("name"), F.col("id").alias("first")).filter("name <> ''")
    return ranked(parts, people.agg(_count()), top)


def top_lineages(people: DataFrame, top: int) -> DataFrame:
    names = people.select(F.coalesce(F.nullif(F.col("surname"), F.lit("")), F.lit("Unknown")).alias("name"), F.col("id").alias("first"))
    return ranked(names, people.agg(_count()), top)


def top_given_by_sex(people: DataFrame, top: int) -> DataFrame:
    named = people.filter(F.col("sex").isin("M", "F"))
    names = named.filter("given <> ''").select("sex", F.col("given").alias("name"), F.col("id").alias("first"))
    return ranked(names, named.groupBy("sex").agg(_count()), top, ["sex"])


def top_places(people: DataFrame, top: int) -> DataFrame:
    places = people.filter("birth_place <> ''").select(F.col("birth_place").alias("name"), F.col("id").alias("first"))
    return ranked(places, places.agg(_count()), top)


def timeline(people: DataFrame) -> DataFrame:
    """The first in file of the earliest and of the latest births, and the years between."""
    born = people.filter("birth_year IS NOT NULL")
    return born.agg(
        F.min("birth_year").alias("earliest_year"), F.min_by("id", F.struct("birth_year", "id")).alias("earliest_id"),
        F.max("birth_year").alias("latest_year"), F.max_by("id", F.struct(F.col("birth_year"), -F.col("id"))).alias("latest_id"),
        (F.max("birth_year") - F.min("birth_year")).alias("span"),
    )


def by_century(people: DataFrame, year: str = "birth_year") -> DataFrame:
    return people.filter(F.col(year).isNotNull()).groupBy(century(F.col(year)).alias("century")).agg(_count())


def _lifespans(people: DataFrame) -> DataFrame:
    return people.withColumn("span", F.col("death_year") - F.col("birth_year")).filter("span BETWEEN 0 AND 120")


def lifespan(people: DataFrame) -> DataFrame:
    return _lifespans(people).agg(*summary(F.col("span")))


def lifespan_by_century(people: DataFrame) -> DataFrame:
    return _lifespans(people).groupBy(century(F.col("birth_year")).alias("century")).agg(*summary(F.col("span")))


def child_counts(families: DataFrame, children: DataFrame) -> DataFrame:
    n = children.groupBy(F.col("fam").alias("id")).agg(_count("children"))
    return families.join(n, "id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def marriages(families: DataFrame, children: DataFrame) -> DataFrame:
    return child_counts(families, children).agg(_count("families"), F.count("marriage_year").alias("dated"), F.count_if(F.col("marriage_year").isNull()).alias("undated"), F.avg("children").alias("average_children"))


def largest_families(families: DataFrame, children: DataFrame, top: int = 3) -> DataFrame:
    return child_counts(families, children).filter("children > 0").orderBy(F.desc("children"), "id").limit(top).select("id", "children")


def family_sizes(families: DataFrame, children: DataFrame) -> DataFrame:
    """Families with children in five size classes, all of them present."""
    n = F.col("children")
    bucket = F.when(n == 1, "1").when(n <= 3, "2-3").when(n <= 6, "4-6").when(n <= 9, "7-9").otherwise("10+")
    counts = child_counts(families, children).filter("children > 0").groupBy(bucket.alias("size")).agg(_count())
    classes = families.sparkSession.createDataFrame([(x,) for x in ("1", "2-3", "4-6", "7-9", "10+")], "size string")
    return classes.join(counts, "size", "left").select("size", F.coalesce("n", F.lit(0)).alias("n"))


def first_marriages(people: DataFrame, families: DataFrame) -> DataFrame:
    """id, sex, birth_year, age of everyone whose first dated marriage is at 12 to 80."""
    sides = families.filter("marriage_year IS NOT NULL").select(F.expr("stack(2, husb, wife) as id"), "marriage_year").filter("id IS NOT NULL")
    first = sides.groupBy("id").agg(F.min("marriage_year").alias("married"))
    return people.filter(F.col("sex").isin("M", "F")).join(first, "id").withColumn("age", F.col("married") - F.col("birth_year")).filter("age BETWEEN 12 AND 80")


def first_marriage_age(people: DataFrame, families: DataFrame) -> DataFrame:
    return first_marriages(people, families).groupBy("sex").agg(*summary(F.col("age")))


def first_marriage_by_century(people: DataFrame, families: DataFrame) -> DataFrame:
    ages = first_marriages(people, families).withColumn("century", century(F.col("birth_year")))
    return ages.groupingSets([["sex"], ["sex", "century"]], "sex", "century").agg(*summary(F.col("age"))).withColumn("century", F.coalesce("century", F.lit("all")))


def first_child_age(people: DataFrame, parents: DataFrame) -> DataFrame:
    born = people.select(F.col("id").alias("child"), F.col("birth_year").alias("born"))
    first = parents.join(born, "child").groupBy(F.col("parent").alias("id")).agg(F.min("born").alias("born"))
    ages = people.filter(F.col("sex").isin("M", "F")).join(first, "id").withColumn("age", F.col("born") - F.col("birth_year")).filter("age BETWEEN 12 AND 70")
    return ages.groupBy("sex").agg(*summary(F.col("age")))


def spouse_gap(people: DataFrame, families: DataFrame) -> DataFrame:
    h = people.select(F.col("id").alias("husb"), F.col("birth_year").alias("h"))
    w = people.select(F.col("id").alias("wife"), F.col("birth_year").alias("w"))
    return families.join(h, "husb").join(w, "wife").withColumn("gap", F.abs(F.col("h") - F.col("w"))).filter("gap <= 50").agg(*summary(F.col("gap")))


def coverage(people: DataFrame, today: int) -> DataFrame:
    """With, without and percent for each of several facts."""
    facts = {"birth": F.col("birth_year").isNotNull(), "death": F.col("death_year").isNotNull(), "source": F.col("source_count") > 0, "note": F.col("note_length") > 0, "occupation": F.trim("occupation") != "", "living": (F.col("birth_year") > today - 110) & F.col("death_year").isNull()}
    row = people.agg(_count("total"), *(F.count_if(v).alias(k) for k, v in facts.items()))
    stacked = F.expr(f"stack({len(facts)}, {', '.join(f'{k!r}, `{k}`' for k in facts)}) as (fact, with_it)")
    return row.select(stacked, "total").select("fact", "with_it", (F.col("total") - F.col("with_it")).alias("without_it"), F.round(100.0 * F.col("with_it") / F.col("total"), 1).alias("percent"))


def birth_months(people: DataFrame) -> DataFrame:
    return people.filter("NOT birth_approximate").groupBy("birth_month").agg(_count())


def precision_counts(people: DataFrame) -> DataFrame:
    kind = F.when(F.col("birth_year").isNull(), "missing").when(F.col("birth_approximate"), "approximate").when(F.col("birth_month").isNotNull(), "full").otherwise("partial")
    return people.groupBy(kind.alias("precision")).agg(_count())


def source_depth(people: DataFrame) -> DataFrame:
    return people.agg(F.avg("source_count").alias("average"), F.min("source_count").alias("minimum"), F.max("source_count").alias("maximum"))


def record_counts(people: DataFrame, families: DataFrame) -> DataFrame:
    return people.select(F.lit("INDI").alias("tag")).union(families.select(F.lit("FAM"))).groupBy("tag").agg(_count())
