"""A family-tree file as the tables that the operators read: people, families, children, parents."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators._lineage import cut
from kinforge.sources import gedcom
from kinforge.sources.tables import parent_edges


class Tree:
    """The files under ``path``. Ids are the line numbers of records, so that they follow the file's order;
    with several files the tables are those of all, told apart by ``file``, and ids may repeat. Files are
    read once: each table is kept in the shared folder from its first use on."""

    def __init__(self, spark: SparkSession, path: str, encoding: str | None = None):
        self.spark, self.path = spark, path
        self.lines = gedcom.read_lines(spark, path, encoding)

    @cached_property
    def nodes(self) -> DataFrame:
        return cut(gedcom.paths(gedcom.records(gedcom.parse_lines(self.lines))))

    @cached_property
    def people(self) -> DataFrame:
        i = gedcom.individuals(gedcom.folded(self.nodes)).withColumnRenamed("record_id", "id")
        others = gedcom.alternate_names(self.nodes).groupBy("file", "xref").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "given", "surname"))), lambda x: F.struct(x["given"].alias("given"), x["surname"].alias("surname"))).alias("alternates"))
        jobs = self.nodes.filter("path = 'INDI/OCCU'").groupBy("file", F.col("record_xref").alias("xref")).agg(F.min_by("value", "line_no").alias("occupation"))
        notes = self.nodes.filter("path = 'INDI/NOTE'").groupBy("file", F.col("record_xref").alias("xref")).agg(F.sum(F.length(F.coalesce("value", F.lit("")))).alias("note_length"))
        j = i.join(others, ["file", "xref"], "left").join(jobs, ["file", "xref"], "left").join(notes, ["file", "xref"], "left")
        fams = self._families.select("file", F.col("xref").alias("famc"), F.col("id").alias("famc_id"))
        j = j.withColumn("famc", F.trim("famc")).join(fams, ["file", "famc"], "left")
        none = F.array().cast("array<struct<given:string,surname:string>>")
        return cut(j.select(
            "file", "id", "xref", "given", "surname", F.trim("sex").alias("sex"), "birth_year", "death_year", F.col("birth.month").alias("birth_month"), (F.col("birth.precision") == "approximate").alias("birth_approximate"),
            "birth_place", "death_place", "source_count", F.coalesce("occupation", F.lit("")).alias("occupation"), F.col("famc_id").alias("famc"), F.coalesce("note_length", F.lit(0)).alias("note_length"), F.coalesce("alternates", none).alias("alternates"),
        ))

    @cached_property
    def _families(self) -> DataFrame:
        return gedcom.family_rows(self.nodes).withColumnRenamed("record_id", "id")

    @cached_property
    def _ids(self) -> DataFrame:
        return self.nodes.filter("level = 0 AND tag = 'INDI' AND xref IS NOT NULL").groupBy("file", "xref").agg(F.min("line_no").alias("who"))

    @cached_property
    def families(self) -> DataFrame:
        f = self._families
        for side in ("husb", "wife"):
            ids = self._ids.select("file", F.col("xref").alias(side), F.col("who").alias(f"{side}_id"))
            f = f.withColumn(side, F.trim(side)).join(ids, ["file", side], "left")
        return cut(f.select("file", "id", "xref", F.col("husb_id").alias("husb"), F.col("wife_id").alias("wife"), "marriage_year"))

    @cached_property
    def children(self) -> DataFrame:
        c = self._families.select("file", F.col("id").alias("fam"), F.explode("children").alias("xref")).withColumn("xref", F.trim("xref"))
        return cut(c.join(self._ids, ["file", "xref"]).select("fam", F.col("who").alias("child")))

    @cached_property
    def parents(self) -> DataFrame:
        return cut(parent_edges(self.families, self.children))

    def id_of(self, xref: str) -> int:
        row = self._ids.filter(F.col("xref") == xref).first()
        if row is None:
            raise ValueError(f"no such person: {xref}")
        return row["who"]
