"""File to file transforms over parsed lines: stripping, subtrees, dangling pointers, empty families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators import graph
from kinforge.operators._lineage import cut
from kinforge.sources import gedcom


def strip_records(nodes: DataFrame, tags: list[str]) -> DataFrame:
    return nodes.filter(~F.col("record_tag").isin(tags))


def strip_lines(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """Without lines under level 0 of these tags, and without what stands below them."""
    below = F.slice(F.split("path", "/"), 2, 99)
    return nodes.filter(~F.arrays_overlap(below, F.array(*map(F.lit, tags))))


def strip_custom(nodes: DataFrame) -> DataFrame:
    """Without lines whose tag, or one above it under level 0, begins with an underscore."""
    return nodes.filter(~F.exists(F.slice(F.split("path", "/"), 2, 99), lambda t: t.startswith("_")))


def strip_dangling(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Without pointers to records in ``removed`` (file, xref), and without what stands below them."""
    bad = nodes.filter("is_pointer AND level > 0").join(removed.select("file", F.col("xref").alias("target")), [nodes["file"] == removed["file"], F.trim(nodes["value"]) == F.col("target")], "left_semi")
    roots = bad.select("file", "record_id", F.col("line_no").alias("from_line"), F.col("level").alias("from_level"))
    # the lines below one are those up to the next line of no greater level
    stops = nodes.select("file", "record_id", F.col("line_no").alias("stop"), F.col("level").alias("stop_level"))
    spans = roots.join(stops, ["file", "record_id"], "left").withColumn("stop", F.when((F.col("stop") > F.col("from_line")) & (F.col("stop_level") <= F.col("from_level")), F.col("stop")))
    spans = spans.groupBy("file", "record_id", "from_line").agg(F.coalesce(F.min("stop"), F.lit(1 << 62)).alias("stop"))
    return nodes.join(spans, (nodes["file"] == spans["file"]) & (nodes["record_id"] == spans["record_id"]) & (nodes["line_no"] >= spans["from_line"]) & (nodes["line_no"] < spans["stop"]), "left_anti")


def strip_empty_families(nodes: DataFrame) -> DataFrame:
    """Without FAM records that have no member line, in one pass."""
    full = nodes.filter(F.col("tag").isin("HUSB", "WIFE", "CHIL")).select("file", "record_id").distinct()
    return nodes.filter("record_tag <> 'FAM'").unionByName(nodes.filter("record_tag = 'FAM'").join(full, ["file", "record_id"], "left_semi"))


def subtree(root: DataFrame, parents: DataFrame, families: DataFrame, up: int, down: int, spouses: bool = True) -> DataFrame:
    """(id) of the people kept around ``root`` (root): ancestors, descendants, and these people's spouses."""
    core = root.select(F.col("root").alias("id"))
    if up > 0:
        core = core.union(graph.ancestors(root, parents, up).select("id"))
    if down > 0:
        core = core.union(graph.descendants(root, parents, down).select("id"))
    core = core.distinct()
    if not spouses:
        return core
    sides = families.filter("husb IS NOT NULL AND wife IS NOT NULL")
    partners = sides.join(core, sides["husb"] == core["id"]).select(F.col("wife").alias("id")).union(sides.join(core, sides["wife"] == core["id"]).select(F.col("husb").alias("id")))
    return core.union(partners).distinct()


def subtree_records(nodes: DataFrame, people: DataFrame, rounds: int = 100) -> DataFrame:
    """(file, xref) of the records that go with ``people`` (file, xref): families with one of them, then sources,
    notes, media and repositories that any kept record points to, and those that these point to."""
    members = nodes.filter("record_tag = 'FAM' AND tag IN ('HUSB', 'WIFE', 'CHIL') AND record_xref IS NOT NULL")
    fams = members.join(people.withColumnRenamed("xref", "who"), (members["file"] == people["file"]) & (F.trim("value") == F.col("who")), "left_semi").select("file", F.col("record_xref").alias("xref"))
    kept = cut(people.select("file", "xref").union(fams).distinct())
    defined = nodes.filter("level = 0 AND record_xref IS NOT NULL AND record_tag IN ('SOUR', 'NOTE', 'OBJE', 'REPO')").select("file", F.col("record_xref").alias("target"))
    uses = nodes.filter("is_pointer AND level > 0 AND record_xref IS NOT NULL").select("file", F.col("record_xref").alias("xref"), F.trim("value").alias("target"))
    uses = cut(uses.join(defined, ["file", "target"], "left_semi").distinct())
    front = kept
    for _ in range(rounds):
        step = uses.join(front, ["file", "xref"], "left_semi").select("file", F.col("target").alias("xref")).distinct()
        front = cut(step.join(kept, ["file", "xref"], "left_anti"))
        if not front.limit(1).count():
            return kept
        kept = cut(kept.union(front))
    raise RuntimeError("records that point to each other did not settle")


def keep_records(nodes: DataFrame, kept: DataFrame) -> DataFrame:
    """Lines of ``kept`` records (file, xref), and of all records without an id or of HEAD, TRLR and SUBM."""
    always = F.col("record_xref").isNull() | F.col("record_tag").isin("HEAD", "TRLR", "SUBM")
    rest = nodes.filter(~always)
    return nodes.filter(always).unionByName(rest.join(kept.withColumnRenamed("xref", "record_xref"), ["file", "record_xref"], "left_semi").select(*nodes.columns))


def user_tags(tags: list[str]) -> tuple[list[str], list[str]]:
    """Tags to strip, in upper case, and those that may not be: a file needs HEAD and TRLR."""
    wanted = {t.upper() for t in tags}
    return sorted(wanted - {"HEAD", "TRLR"}), sorted(wanted & {"HEAD", "TRLR"})


def filtered(nodes: DataFrame, strip: list[str] = (), custom: bool = False, tags: list[str] = (), kept: DataFrame | None = None) -> DataFrame:
    """:func:`gedcom.paths` lines after all transforms, in their order: the subtree of ``kept`` records, records
    of ``strip`` (NOTE, SOUR, OBJE), custom lines, lines of ``strip``, the user's ``tags``, dangling pointers,
    empty families, and pointers that these leave dangling. A file that loses HEAD or TRLR is an error."""
    ids = lambda n: n.filter("level = 0 AND record_xref IS NOT NULL").select("file", F.col("record_xref").alias("xref"))
    out = keep_records(nodes, kept) if kept is not None else nodes
    strip, (own, _) = [t.upper() for t in strip], user_tags(list(tags))
    if strip:
        out = strip_records(out, strip)
    if custom:
        out = strip_custom(out)
    if strip:
        out = strip_lines(out, strip)
    if own:
        out = strip_lines(strip_records(out, own), own)
    out = cut(strip_dangling(out, ids(nodes).join(ids(out), ["file", "xref"], "left_anti")))
    full = cut(strip_empty_families(out))
    full = strip_dangling(full, ids(out).join(ids(full), ["file", "xref"], "left_anti"))
    broken = gedcom.complete(full).filter("NOT ok").join(gedcom.complete(nodes).filter("ok"), "file", "left_semi").first()
    if broken:
        raise ValueError(f"{broken['file']} would lose HEAD or TRLR")
    return full


def record_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, tag, source, output, removed): records of each kind before and after."""
    kinds = ("INDI", "FAM", "NOTE", "SOUR", "OBJE", "REPO", "SUBM")
    count = lambda n, c: n.filter("level = 0 AND tag <> ''").groupBy("file", F.when(F.col("record_tag").isin(*kinds), F.col("record_tag")).otherwise("other").alias("tag")).agg(F.count("*").alias(c))
    j = count(before, "source").join(count(after, "output"), ["file", "tag"], "left").withColumn("output", F.coalesce("output", F.lit(0)))
    return j.withColumn("removed", F.col("source") - F.col("output"))
