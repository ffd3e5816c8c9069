"""Individuals, families and links projected from the analytic tables.

Every ``documents`` row is a person; every fourth id from 18 on opens a family with up to four children.
All formulas are integer arithmetic and ASCII patterns, so that any SQL engine gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"([^\s]+)\s+([^\s]+)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a person, with the columns that the operators read."""
    d = read(spark, sf_dir, "documents")
    n, i = F.col("n_chars"), F.col("doc_id")
    birth = (F.lit(1700) + n % 250).cast("int")
    death = F.when(i % 5 != 0, (birth + 20 + (n * 7) % 80).cast("int"))
    return d.select(
        i.alias("id"),
        F.concat(F.lit("@I"), i, F.lit("@")).alias("xref"),
        F.regexp_extract("text", _NAME, 1).alias("given"),
        F.regexp_extract("text", _NAME, 2).alias("surname"),
        F.when(n % 7 == 0, "").when(n % 2 == 0, "M").otherwise("F").alias("sex"),
        birth.alias("birth_year"),
        death.alias("death_year"),
        (n % 12 + 1).cast("int").alias("birth_month"),
        (n % 5 == 0).alias("birth_approximate"),
        F.concat_ws(", ", "source", "lang").alias("birth_place"),
        F.when(death.isNotNull(), F.concat_ws(", ", "lang", "source")).otherwise("").alias("death_place"),
        (n % 4).cast("int").alias("source_count"),
        F.when(n % 3 != 0, F.concat(F.lit("trade "), (n % 3).cast("string"))).otherwise("").alias("occupation"),
        F.when(i >= 18, F.floor((i - 18) / 4)).cast("long").alias("famc"),
        F.col("lang"),
        n.alias("note_length"),
    )


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, husb, wife, marriage_year."""
    first = read(spark, sf_dir, "documents").select("doc_id").filter((F.col("doc_id") >= 18) & ((F.col("doc_id") - 18) % 4 == 0))
    f = F.col("id")
    return first.select(((F.col("doc_id") - 18) / 4).cast("long").alias("id")).select(
        "id",
        (2 * (f - F.when(f % 6 == 5, 1).otherwise(0))).cast("long").alias("husb"),
        F.when(f % 5 != 0, 2 * f + 7).cast("long").alias("wife"),
        F.when(f % 4 != 3, (1720 + (f * 13) % 220)).cast("int").alias("marriage_year"),
    )


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, child."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").filter(i >= 18).select(F.floor((i - 18) / 4).cast("long").alias("fam"), i.alias("child"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent, fam, role."""
    return parent_edges(families(spark, sf_dir), children(spark, sf_dir))


def parent_edges(fams: DataFrame, kids: DataFrame) -> DataFrame:
    both = F.expr("stack(2, 'H', husb, 'W', wife) as (role, parent)")
    sides = fams.select(F.col("id").alias("fam"), both).filter("parent IS NOT NULL")
    return kids.join(sides, "fam").select("child", "parent", "fam", "role").distinct()


#: The same projection for a SQL engine.
SQL = r"""
people AS (
  SELECT doc_id AS id, '@I' || doc_id || '@' AS xref, regexp_extract(text, '([^\s]+)\s+([^\s]+)', 1) AS given,
    regexp_extract(text, '([^\s]+)\s+([^\s]+)', 2) AS surname,
    CASE WHEN n_chars % 7 = 0 THEN '' WHEN n_chars % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
    CAST(1700 + n_chars % 250 AS INTEGER) AS birth_year,
    CASE WHEN doc_id % 5 <> 0 THEN CAST(1720 + n_chars % 250 + (n_chars * 7) % 80 AS INTEGER) END AS death_year,
    CAST(n_chars % 12 + 1 AS INTEGER) AS birth_month, n_chars % 5 = 0 AS birth_approximate,
    source || ', ' || lang AS birth_place, CASE WHEN doc_id % 5 <> 0 THEN lang || ', ' || source ELSE '' END AS death_place, CAST(n_chars % 4 AS INTEGER) AS source_count,
    CASE WHEN n_chars % 3 <> 0 THEN 'trade ' || (n_chars % 3) ELSE '' END AS occupation,
    CASE WHEN doc_id >= 18 THEN (doc_id - 18) // 4 END AS famc, lang, n_chars AS note_length
  FROM documents
), families AS (
  SELECT id, 2 * (id - CASE WHEN id % 6 = 5 THEN 1 ELSE 0 END) AS husb, CASE WHEN id % 5 <> 0 THEN 2 * id + 7 END AS wife,
    CASE WHEN id % 4 <> 3 THEN CAST(1720 + (id * 13) % 220 AS INTEGER) END AS marriage_year
  FROM (SELECT (doc_id - 18) // 4 AS id FROM documents WHERE doc_id >= 18 AND (doc_id - 18) % 4 = 0)
), children AS (
  SELECT (doc_id - 18) // 4 AS fam, doc_id AS child FROM documents WHERE doc_id >= 18
), parents AS (
  SELECT DISTINCT child, parent, fam, role FROM (
    SELECT child, husb AS parent, fam, 'H' AS role FROM children JOIN families ON fam = families.id
    UNION ALL SELECT child, wife, fam, 'W' FROM children JOIN families ON fam = families.id) WHERE parent IS NOT NULL
)"""
