"""Rows for export: individuals and families with names resolved, privacy, text for spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.dates import canonical
from kinforge.functions.text import formula_guard
from kinforge.sources import gedcom

MAX_AGE = 110
LIVING = "Living"


def living(birth: Column, death: Column, burial: Column | None, marker: Column | None, this_year: int, max_age: int = MAX_AGE) -> Column:
    """Whether someone is taken to live: a marker that says so; else not, where the birth lies more than ``max_age``
    years back or there is a death or burial; unknown counts as living."""
    dead = death.isNotNull() | (burial.isNotNull() if burial is not None else F.lit(False))
    marked = F.coalesce(marker, F.lit(False)) if marker is not None else F.lit(False)
    return F.when(marked, True).when(F.coalesce(this_year - birth > max_age, F.lit(False)) | dead, False).otherwise(True)


def living_people(nodes: DataFrame, this_year: int, max_age: int = MAX_AGE) -> DataFrame:
    """(file, xref, living, restricted) of the people of :func:`gedcom.paths` lines, by markers and all their dates."""
    if max_age < 1:
        raise ValueError("an age of one year at least")
    facts = gedcom.life_evidence(nodes, this_year).join(gedcom.markers(nodes).withColumnRenamed("living", "marked"), ["file", "xref"], "left")
    return facts.select("file", "xref", living(F.col("birth"), F.col("death"), F.col("burial"), F.col("marked"), this_year, max_age).alias("living"), F.coalesce("restricted", F.lit(False)).alias("restricted"))


def withheld_families(nodes: DataFrame) -> DataFrame:
    """(file, xref) of families whose record is to be withheld, whoever lives."""
    return gedcom.markers(nodes.filter("record_tag = 'FAM'")).filter("restricted").select("file", "xref")


def family_labels(fams: DataFrame, people: DataFrame) -> DataFrame:
    """(id, label): the spouses' surnames, ``?`` for one that is missing."""
    side = lambda x: people.select(F.col("id").alias(x), F.nullif(F.trim("surname"), F.lit("")).alias(f"{x}_surname"))
    j = fams.join(side("husb"), "husb", "left").join(side("wife"), "wife", "left")
    return j.select("id", F.concat(F.coalesce("husb_surname", F.lit("?")), F.lit("/"), F.coalesce("wife_surname", F.lit("?"))).alias("label"))


def individuals(people: DataFrame, families: DataFrame, this_year: int, max_age: int = MAX_AGE) -> DataFrame:
    """id, name, sex, years, place, families as spouse, living."""
    sides = families.select(F.col("id").alias("fam"), F.expr("stack(2, husb, wife) as id")).filter("id IS NOT NULL")
    fams = sides.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("fam")), lambda f: F.concat(F.lit("@F"), f, F.lit("@"))), ";").alias("fams"))
    return people.join(fams, "id", "left").select(
        "id", "given", "surname", "sex", "birth_year", "death_year", "birth_place", "occupation", "source_count", "famc",
        F.coalesce("fams", F.lit("")).alias("fams"), living(F.col("birth_year"), F.col("death_year"), None, None, this_year, max_age).alias("living"),
    )


def redacted(rows: DataFrame) -> DataFrame:
    """Living people keep id, sex and source count; the given name becomes a label."""
    blank = lambda c, kind: F.when(F.col("living"), F.lit(None).cast(kind)).otherwise(F.col(c)).alias(c)
    text = lambda c: F.when(F.col("living"), "").otherwise(F.col(c)).alias(c)
    return rows.select("id", F.when(F.col("living"), LIVING).otherwise(F.col("given")).alias("given"), text("surname"), "sex", blank("birth_year", "int"), blank("death_year", "int"), text("birth_place"), text("occupation"), "source_count", blank("famc", "long"), text("fams"), "living")


def families(fams: DataFrame, children: DataFrame, people: DataFrame) -> DataFrame:
    """id, spouses' names, marriage year, number of children and their ids."""
    name = F.trim(F.concat_ws(" ", "given", "surname"))
    h = people.select(F.col("id").alias("husb"), name.alias("husband"))
    w = people.select(F.col("id").alias("wife"), name.alias("wife_name"))
    kids = children.groupBy(F.col("fam").alias("id")).agg(F.count("*").alias("child_count"), F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat(F.lit("@I"), c, F.lit("@"))), ";").alias("children"))
    j = fams.join(h, "husb", "left").join(w, "wife", "left").join(kids, "id", "left")
    return j.select("id", F.coalesce("husband", F.lit("")).alias("husband"), F.coalesce("wife_name", F.lit("")).alias("wife_name"), "marriage_year", F.coalesce("child_count", F.lit(0)).alias("child_count"), F.coalesce("children", F.lit("")).alias("children"))


def redacted_families(rows: DataFrame, fams: DataFrame, living_people: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    """Without living spouses' names; a family with a living spouse, or a ``restricted`` one (id), has no marriage year.

    Children's number stays; restricted families are withheld whether or not anybody lives.
    """
    alive = living_people.filter("living").select("id")
    sides = fams.select(F.col("id").alias("fam"), F.expr("stack(2, 'h', husb, 'w', wife) as (role, id)")).join(alive, "id", "left_semi")
    flags = sides.groupBy(F.col("fam").alias("id")).agg(F.bool_or(F.col("role") == "h").alias("h"), F.bool_or(F.col("role") == "w").alias("w"))
    j = rows.join(flags, "id", "left").withColumn("h", F.coalesce("h", F.lit(False))).withColumn("w", F.coalesce("w", F.lit(False)))
    if restricted is not None:
        j = j.join(restricted.select("id", F.lit(True).alias("r")).distinct(), "id", "left").withColumn("h", F.col("h") | F.coalesce("r", F.lit(False))).withColumn("w", F.col("w") | F.coalesce("r", F.lit(False)))
    return j.select("id", F.when(F.col("h"), "").otherwise(F.col("husband")).alias("husband"), F.when(F.col("w"), "").otherwise(F.col("wife_name")).alias("wife_name"), F.when(~F.col("h") & ~F.col("w"), F.col("marriage_year")).alias("marriage_year"), "child_count")


def shown_children(children: DataFrame, living_people: DataFrame) -> DataFrame:
    """(fam, child) without living children."""
    return children.join(living_people.filter("living").select(F.col("id").alias("child")), "child", "left_anti")


def _joined(nodes: DataFrame, path: str, sep: str, name: str, where: Column | None = None) -> Column:
    """All values of a path in a record, in their order, joined."""
    hit = (F.col("path") == path) if where is None else (F.col("path") == path) & where
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(hit, F.struct("line_no", F.trim("value").alias("value"))))), lambda x: x["value"]), sep).alias(name)


def individual_rows(nodes: DataFrame) -> DataFrame:
    """The 17 columns of a person for export, and file, from :func:`gedcom.paths` lines: dates as they stand in the
    file, years and places with their fallbacks, occupations and families joined, the suffix of the first name."""
    n = gedcom.folded(nodes.filter("record_tag = 'INDI'"))
    first = lambda path: F.min_by("value", F.when(F.col("path") == f"INDI/{path}", F.col("line_no")))
    g = n.groupBy("file", F.col("record_xref").alias("xref")).agg(
        *(first(f"{t}/DATE").alias(f"{t}_date") for t in ("BIRT", "CHR", "BAPM", "DEAT", "BURI")), *(first(f"{t}/PLAC").alias(f"{t}_place") for t in ("BIRT", "CHR", "BAPM", "DEAT", "BURI")),
        _joined(n, "INDI/OCCU", "; ", "occupations", F.trim(F.coalesce("value", F.lit(""))) != ""), first("FAMC").alias("famc"), _joined(n, "INDI/FAMS", ";", "fams_xrefs"),
    )
    own = gedcom.individuals(nodes).select("file", "xref", "given", "surname", "suffix", "sex", "birth_year", "death_year", "source_count")
    text = lambda c: F.coalesce(c, F.lit(""))
    born = F.coalesce("BIRT_date", "CHR_date", "BAPM_date")
    return own.join(g, ["file", "xref"]).select(
        "file", "xref", "given", "surname", text(F.col("suffix")).alias("suffix"), F.trim("sex").alias("sex"), text(canonical(born)).alias("birth_date"), "birth_year", text(F.coalesce("BIRT_place", "CHR_place", "BAPM_place")).alias("birth_place"),
        text(canonical(F.col("DEAT_date"))).alias("death_date"), "death_year", text(F.col("DEAT_place")).alias("death_place"), text(canonical(F.col("BURI_date"))).alias("burial_date"), text(F.col("BURI_place")).alias("burial_place"),
        "occupations", "source_count", text(F.trim("famc")).alias("famc_xref"), "fams_xrefs",
    )


def family_rows(nodes: DataFrame) -> DataFrame:
    """The 10 columns of a family for export, and file: spouses with their names, the wedding, children in their order."""
    f = gedcom.family_rows(nodes)
    m = nodes.filter("record_tag = 'FAM'").groupBy("file", F.col("record_xref").alias("xref")).agg(*(F.min_by("value", F.when(F.col("path") == f"FAM/MARR/{t}", F.col("line_no"))).alias(t) for t in ("DATE", "PLAC")))
    names = gedcom.individuals(nodes).select("file", F.col("xref").alias("who"), F.trim(F.concat_ws(" ", "given", "surname")).alias("name"))
    for side, kind in (("husb", "husband"), ("wife", "wife")):
        who = names.withColumnRenamed("who", side).withColumnRenamed("name", f"{kind}_name")
        f = f.withColumn(side, F.trim(side)).join(who, ["file", side], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return f.join(m, ["file", "xref"], "left").select(
        "file", "xref", text(F.col("husb")).alias("husband_xref"), text(F.col("husband_name")).alias("husband_name"), text(F.col("wife")).alias("wife_xref"), text(F.col("wife_name")).alias("wife_name"), text(canonical(F.col("DATE"))).alias("marriage_date"), "marriage_year",
        text(F.col("PLAC")).alias("marriage_place"), F.size("children").alias("child_count"), F.array_join(F.transform("children", F.trim), ";").alias("children_xrefs"),
    )


def redacted_rows(rows: DataFrame, alive: DataFrame) -> DataFrame:
    """:func:`individual_rows` in which the living of ``alive`` (file, xref, living) keep id, sex and number of sources."""
    j = rows.join(alive.select("file", "xref", "living"), ["file", "xref"], "left").withColumn("living", F.coalesce("living", F.lit(True)))
    keep = ("file", "xref", "sex", "source_count")
    blank = lambda c, t: F.when(F.col("living"), F.lit(LIVING) if c == "given" else F.lit("") if t == "string" else F.lit(None).cast(t)).otherwise(F.col(c)).alias(c)
    return j.select(*(F.col(c) if c in keep else blank(c, t) for c, t in rows.dtypes))


def redacted_family_rows(rows: DataFrame, alive: DataFrame, restricted: DataFrame) -> DataFrame:
    """:func:`family_rows` without living spouses, their wedding and living children; families of ``restricted``
    (file, xref) show neither spouses nor wedding, whether or not anybody lives. The number of children stays."""
    living = alive.filter("living").select("file", F.col("xref").alias("who"))
    j = rows
    for kind in ("husband", "wife"):
        j = j.join(living.select("file", F.col("who").alias(f"{kind}_xref"), F.lit(True).alias(f"{kind}_lives")), ["file", f"{kind}_xref"], "left")
    kids = rows.select("file", "xref", F.posexplode(F.split("children_xrefs", ";")).alias("k", "who")).join(living, ["file", "who"], "left_anti")
    kids = kids.groupBy("file", "xref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "who"))), lambda x: x["who"]), ";").alias("shown"))
    j = j.join(kids, ["file", "xref"], "left").join(restricted.select("file", "xref", F.lit(True).alias("held")).distinct(), ["file", "xref"], "left")
    held, h, w = (F.coalesce(c, F.lit(False)) for c in ("held", "husband_lives", "wife_lives"))
    hide = lambda flag, c, other="": F.when(flag, other).otherwise(F.col(c)).alias(c)
    any_ = held | h | w
    return j.select(
        "file", "xref", hide(held | h, "husband_xref"), hide(held | h, "husband_name", LIVING), hide(held | w, "wife_xref"), hide(held | w, "wife_name", LIVING), hide(any_, "marriage_date"), F.when(~any_, F.col("marriage_year")).alias("marriage_year"),
        hide(any_, "marriage_place"), "child_count", F.coalesce("shown", F.lit("")).alias("children_xrefs"),
    )


def guarded(rows: DataFrame) -> DataFrame:
    """Text columns made safe for spreadsheets; columns of ids stay as they are, their @ begins no formula that could do harm."""
    ids = lambda c: c.endswith(("xref", "xrefs"))
    return rows.select(*(formula_guard(F.col(c)).alias(c) if t == "string" and not ids(c) else F.col(c) for c, t in rows.dtypes))


def write_csv(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    guarded(rows).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)
