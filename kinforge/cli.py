"""Commands over family-tree files: validate, stats, isolated, languages, search, compare, duplicates, relationship, export, convert, filter.

``python -m kinforge.cli COMMAND FILE ...``; exit codes are 0, 1 (an error) and 2 (a wrong call).
"""

from __future__ import annotations

import argparse
import sys
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions.text import xref_order
from kinforge.operators import codes, export, file_checks, graph, languages, linkage, search, stats, transform, validate
from kinforge.reports import TEXT_LIMIT, Report
from kinforge.sources import gedcom, writer
from kinforge.sources.trees import Tree

VERSION = "0.2"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinforge")
    top.add_argument("--version", action="version", version=VERSION)
    loud = top.add_mutually_exclusive_group()
    loud.add_argument("-v", "--verbose", action="store_true")
    loud.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("--format", choices=("text", "json"), default="text")
    top.add_argument("--ascii", action="store_true")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        for f in files or ("file",):
            p.add_argument(f)
        return p

    p = command("validate")
    p.add_argument("--quick", action="store_true")
    p.add_argument("--full", action="store_true")
    p.add_argument("--strict", choices=("5.5.1", "5.5.5"))
    command("stats").add_argument("--top", type=int, default=10)
    command("isolated")
    p = command("languages")
    p.add_argument("--min-length", type=int, default=languages.LEAST_LENGTH)
    p.add_argument("--language")
    p.add_argument("--show-text", action="store_true")
    p = command("search", "file", "query")
    p.add_argument("--regex", action="store_true")
    p.add_argument("--fuzzy-dates", type=int, default=0)
    p.add_argument("--limit", type=int)
    p.add_argument("--count", action="store_true")
    p.add_argument("--phonetic", choices=("soundex", "metaphone"), default="soundex")
    for name, files in (("compare", ("file", "other")), ("duplicates", ("file",))):
        p = command(name, *files)
        p.add_argument("--certain", type=float, default=linkage.CERTAIN)
        p.add_argument("--probable", type=float, default=linkage.PROBABLE)
        p.add_argument("--show-matches", choices=("certain", "probable", "all"), default="all")
        p.add_argument("--limit", type=int)
        p.add_argument("--reject-sex-mismatch", action="store_true")
        p.add_argument("--phonetic", choices=("soundex", "metaphone"), default="soundex")
        p.add_argument("--max-block-size", type=int, default=linkage.BLOCK_CAP)
        if name == "compare":
            p.add_argument("--list-unique", action="store_true")
    p = command("relationship", "file", "primary", "target")
    p.add_argument("--type", choices=("blood", "all"), default="blood")
    p.add_argument("--paths", type=int, default=1)
    p.add_argument("--generations", type=int, default=30)
    p = command("export")
    p.add_argument("--to", choices=("csv", "json"), default="csv")
    p.add_argument("--table", choices=("individuals", "families"), default="individuals")
    p.add_argument("-o", "--output")
    p.add_argument("--force", action="store_true")
    p.add_argument("--redact-living", action="store_true")
    p.add_argument("--max-age", type=int, default=export.MAX_AGE)
    p = command("convert")
    p.add_argument("--to", default="UTF-8")
    p.add_argument("--from", dest="source")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--bom", action="store_true")
    p.add_argument("--no-normalize", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p = command("filter")
    for name in ("notes", "sources", "multimedia", "custom-tags"):
        p.add_argument(f"--strip-{name}", action="store_true")
    p.add_argument("--strip-tag", action="append", default=[])
    p.add_argument("--subtree")
    p.add_argument("--ancestors", type=int)
    p.add_argument("--descendants", type=int, default=0)
    p.add_argument("--no-spouses", action="store_true")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--from", dest="source")
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    return top


def _limit(a: argparse.Namespace) -> int | None:
    own = getattr(a, "limit", None)
    return own if own is not None else None if a.format == "json" else TEXT_LIMIT


def _validate(t: Tree, a: argparse.Namespace, r: Report) -> None:
    n = t.nodes
    bad = gedcom.input_issues(t.spark, t.path)
    issues = bad.select("file", "code", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("xref")).unionByName(file_checks.all_checks(n, a.strict))
    if not a.quick:
        issues = issues.unionByName(semantic(t))
    shown = file_checks.reported(issues)
    r.add("issues", shown.withColumn("meaning", codes.meaning(F.col("code"))).orderBy("file", F.col("line_no").asc_nulls_last(), "code"), _limit(a))
    r.add("tallies", file_checks.tallies(shown))
    r.add("continued too far", file_checks.too_long(n))
    r.code = 1 if r.sections[1].rows and any(x["errors"] for x in r.sections[1].rows) else 0


def semantic(t: Tree) -> DataFrame:
    """(file, code, line_no, xref) of links and dates that contradict each other."""
    from kinforge.functions.dates import bounds

    first = lambda p: F.min_by("value", F.when(F.col("path") == f"INDI/{p}/DATE", F.col("line_no")))
    d = t.nodes.filter("record_tag = 'INDI'").groupBy("file", F.col("record_xref").alias("xref")).agg(first("BIRT").alias("b"), first("DEAT").alias("d"), first("BURI").alias("u"))
    wide = t.people.join(d.select("file", "xref", bounds(F.col("b")).alias("b"), bounds(F.col("d")).alias("d"), bounds(F.col("u")).alias("u")), ["file", "xref"])
    b = wide.select("id", "sex", "birth_month", "birth_approximate", F.col("b.lo").alias("birth_lo"), F.col("b.hi").alias("birth_hi"), F.col("d.lo").alias("death_lo"), F.col("d.hi").alias("death_hi"), F.col("u.hi").alias("burial_hi"))
    famc = t.people.filter("famc IS NOT NULL").select("id", F.col("famc").alias("fam"))
    fams_of = t.nodes.filter("path = 'INDI/FAMS'").select("file", F.col("record_id").alias("id"), F.trim("value").alias("xref")).join(t.families.select("file", "xref", F.col("id").alias("fam")), ["file", "xref"]).select("id", "fam")
    sides = t.families.select(F.expr("stack(2, husb, wife) as id"), F.col("id").alias("fam")).filter("id IS NOT NULL")
    born = t.children.select(F.col("child").alias("id"), "fam")
    parts = [
        validate.unlinked_people(t.people, famc, fams_of), validate.empty_families(t.families, t.children), validate.asymmetric("W016", famc, born), validate.asymmetric("W017", fams_of, sides),
        validate.death_before_birth(b), validate.burial_order(b), validate.long_lives(b), validate.birth_before_parent(b, t.parents), validate.parent_age(b, t.parents), validate.marriage_before_birth(b, t.families),
        validate.child_before_marriage(b, t.families, t.children), validate.sibling_spacing(b, t.children), validate.sex_roles(b, t.families), graph.cycle_members(t.parents.select("child", "parent")).select(F.lit("E010").alias("code"), "id", F.lit(None).cast("long").alias("other")),
    ]
    defined = t.nodes.filter("level = 0 AND xref IS NOT NULL")
    again = defined.select("file", "xref", "line_no").groupBy("file", "xref").agg(F.sort_array(F.collect_list("line_no")).alias("at")).filter("size(at) > 1")
    again = again.select("file", F.lit("E002").alias("code"), F.explode(F.slice("at", 2, 1 << 30)).alias("line_no"), "xref")
    lost = gedcom.usages(t.nodes).join(defined.select("file", F.col("xref").alias("target")), ["file", "target"], "left_anti").groupBy("file", "target").agg(F.min("line_no").alias("line_no"))
    lost = lost.select("file", F.lit("E001").alias("code"), "line_no", F.col("target").alias("xref"))
    where = defined.select("file", F.col("line_no").alias("id"), "xref")
    return reduce(DataFrame.unionByName, parts).join(where, "id").select("file", "code", F.col("id").alias("line_no"), "xref").unionByName(again).unionByName(lost)


def _stats(t: Tree, a: argparse.Namespace, r: Report) -> None:
    p, f, c, year = t.people, t.families, t.children, date.today().year
    for title, rows in (
        ("records", stats.record_counts(p, f)), ("sexes", stats.gender_counts(p)), ("surnames", stats.top_surnames(p, a.top)), ("lineages", stats.top_lineages(p, a.top)), ("given names", stats.top_given_by_sex(p, a.top)), ("places", stats.top_places(p, a.top)),
        ("timeline", stats.timeline(p)), ("births by century", stats.by_century(p).orderBy("century")), ("lifespans", stats.lifespan(p)), ("lifespans by century", stats.lifespan_by_century(p).orderBy("century")), ("marriages", stats.marriages(f, c)), ("largest families", stats.largest_families(f, c)),
        ("family sizes", stats.family_sizes(f, c)), ("family names", export.family_labels(f, p).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max(1, a.top))), ("coverage", stats.coverage(p, year)), ("age at first marriage", stats.first_marriage_age(p, f)), ("age at first child", stats.first_child_age(p, t.parents)),
        ("spouses' ages apart", stats.spouse_gap(p, f)), ("births by month", stats.birth_months(p)), ("sources", stats.source_depth(p)),
    ):
        r.add(title, rows)


def _isolated(t: Tree, a: argparse.Namespace, r: Report) -> None:
    labels = graph.components(t.people, graph.family_links(t.families, t.children))
    alone = graph.isolated(labels)
    shown = labels.join(alone.select("component", "size"), "component").join(t.people, "id")
    r.add("isolated", shown.orderBy("size", "component", *xref_order(F.col("xref"))).select("size", "xref", F.trim(F.concat_ws(" ", "given", "surname")).alias("name"), "sex", "birth_year"), _limit(a))


def _languages(t: Tree, a: argparse.Namespace, r: Report) -> None:
    found = languages.detected(languages.note_rows(t.nodes), a.min_length)
    if a.language:
        rows = languages.matches(found, a.language, a.show_text)
        key = F.coalesce("owner", "source")
        r.add(languages.NAMES[languages.resolve(a.language)], rows.orderBy("category", *xref_order(key), F.coalesce("event", F.lit(""))), _limit(a))
        return
    wide = languages.matrix(found.select("lang", "category", F.when(F.col("lang").isNull(), 0).otherwise(1).alias("note_length")), 1)
    r.add("languages", wide.withColumn("name", F.when(F.col("language") == "all", "all").otherwise(languages.name_of(F.col("language")))).orderBy(F.col("language") == "all", F.desc("total"), "language"))


def _search(t: Tree, a: argparse.Namespace, r: Report) -> None:
    found = search.run(a.query, t.people, t.parents, a.regex, a.fuzzy_dates, None, a.phonetic, matches=True)
    if a.count:
        r.notices.append(str(found.count()))
        return
    rows, more = search.page(found, a.limit)
    r.add("people", rows.select("xref", F.trim(F.concat_ws(" ", "given", "surname")).alias("name"), "sex", "birth_year", "birth_place", "death_year", "death_place", "matches"))
    if more:
        r.notices.append("there are more")


def _linkage(t: Tree, other: Tree | None, a: argparse.Namespace, r: Report) -> None:
    linkage.checked(a.certain, a.probable, a.max_block_size)
    one = linkage.prepared(t.people, a.phonetic)
    two = linkage.prepared(other.people, a.phonetic) if other else one
    k1, k2 = linkage.block_keys(one, a.phonetic), linkage.block_keys(two, a.phonetic)
    pairs = linkage.candidates(k1, k2, a.max_block_size, same=other is None)
    scored = linkage.classified(linkage.scores(pairs, one, two, a.reject_sex_mismatch), a.certain, a.probable).filter("class <> 'non_match'")
    taken = linkage.greedy(scored, same=other is None)
    kinds = taken.join(scored.select("a", "b", "class", "insufficient_data"), ["a", "b"])
    name = lambda p, x: p.select(F.col("id").alias(x), F.col("xref").alias(f"xref_{x}"), F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "given", "surname")), F.lit("")), F.lit("Unknown")).alias(f"name_{x}"))
    shown = kinds.join(name(t.people, "a"), "a").join(name((other or t).people, "b"), "b")
    if a.show_matches != "all":
        shown = shown.filter(F.col("class") == a.show_matches)
    r.add("matches", shown.orderBy(F.desc("total"), "a", "b").select("class", "total", "xref_a", "name_a", "xref_b", "name_b", F.col("insufficient_data").alias("low_confidence")), _limit(a))
    r.add("classes", kinds.groupBy("class").agg(F.count("*").alias("n")).orderBy("class"))
    r.add("differences", linkage.field_differences(taken, t.people, (other or t).people).orderBy("a", "b", "field"), _limit(a))
    skipped = linkage.skipped_keys(k1, k2, a.max_block_size).count()
    if skipped:
        r.notices.append(f"{skipped:,} groups of more than {a.max_block_size:,} people were not compared")
    if other and a.list_unique:
        r.add("only in the first", linkage.unmatched(t.people, taken, "a").join(t.people, "id").select("xref").orderBy(*xref_order(F.col("xref"))), _limit(a))
        r.add("only in the second", linkage.unmatched(other.people, taken, "b").join(other.people, "id").select("xref").orderBy(*xref_order(F.col("xref"))), _limit(a))


def _relationship(t: Tree, a: argparse.Namespace, r: Report) -> None:
    root, target = t.id_of(a.primary), t.id_of(a.target)
    one = t.people.filter(F.col("id") == root).select(F.col("id").alias("root"))
    paths = graph.relation_paths(one, t.people, t.parents, t.families, a.generations).filter(F.col("target") == target)
    name = {x["id"]: x["name"] for x in t.people.filter(F.col("id").isin(root, target)).select("id", "xref", F.coalesce(F.nullif(F.trim(F.concat_ws(" ", "given", "surname")), F.lit("")), F.concat(F.lit("[Unknown] ("), "xref", F.lit(")"))).alias("name")).collect()}
    text = graph.sentence(F.lit(name[target]), F.lit(name[root]), F.col("relation"), F.col("is_half"), a.type == "all")
    found = r.add("relationship", paths.filter(F.col("rank") <= max(1, a.paths)).orderBy("rank").select("relation", "gp", "gt", "is_half", text.alias("sentence")))
    if not found.total:
        r.notices.append("not related within the generations that were looked at")
    if graph.truncated(graph.ancestors(one, t.parents, a.generations), t.parents, a.generations).limit(1).count():
        r.notices.append("there are earlier generations")


def _export(t: Tree, a: argparse.Namespace, r: Report) -> None:
    rows = (export.individual_rows if a.table == "individuals" else export.family_rows)(t.nodes)
    if a.redact_living:
        alive = export.living_people(t.nodes, date.today().year, a.max_age)
        rows = export.redacted_rows(rows, alive) if a.table == "individuals" else export.redacted_family_rows(rows, alive, export.withheld_families(t.nodes))
    rows = rows.drop("file").orderBy(*xref_order(F.col("xref")))
    if a.output:
        (export.write_csv if a.to == "csv" else export.write_json)(rows, a.output, a.force)
        r.notices.append(f"{rows.count():,} rows in {a.output}")
    else:
        r.add(a.table, export.guarded(rows) if a.to == "csv" else rows, _limit(a))


def _convert(spark: SparkSession, a: argparse.Namespace, r: Report) -> None:
    r.add("files", writer.convert(spark, a.file, a.output, a.to, a.source, a.bom, not a.no_normalize, a.dry_run, a.force))


def _filter(t: Tree, a: argparse.Namespace, r: Report) -> None:
    strip = [tag for tag, on in (("NOTE", a.strip_notes), ("SOUR", a.strip_sources), ("OBJE", a.strip_multimedia)) if on]
    _, kept_tags = transform.user_tags(a.strip_tag)
    if not (strip or a.strip_custom_tags or a.strip_tag or a.subtree):
        raise ValueError("nothing to filter")
    if kept_tags:
        r.notices.append(f"a file needs {', '.join(kept_tags)}")
    kept = None
    if a.subtree:
        t.id_of(a.subtree)
        root = t.people.filter(F.col("xref") == a.subtree).select(F.col("id").alias("root"))
        who = transform.subtree(root, t.parents, t.families, 10_000 if a.ancestors is None else a.ancestors, a.descendants, not a.no_spouses)
        kept = transform.subtree_records(t.nodes, t.people.join(who, "id", "left_semi").select("file", "xref"))
    after = transform.filtered(t.nodes, strip, a.strip_custom_tags, a.strip_tag, kept)
    r.add("records", transform.record_changes(t.nodes, after).orderBy("file", "tag"))
    if not a.dry_run:
        written = writer.write(after, a.output, overwrite=a.force, ends=writer.line_ends(t.spark, t.path))
        r.add("files", written)


def run(argv: list[str], spark: SparkSession | None = None, out=None) -> int:
    """Runs a command and prints its report; the exit code."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    spark = spark or SparkSession.builder.appName("kinforge").getOrCreate()
    out = out or sys.stdout
    r = Report(a.command)
    try:
        if a.command == "convert":
            _convert(spark, a, r)
        else:
            t = Tree(spark, a.file, getattr(a, "source", None))
            if a.command == "compare":
                if a.file.rstrip("/") == a.other.rstrip("/"):
                    raise ValueError("a file is compared with another one")
                _linkage(t, Tree(spark, a.other), a, r)
            elif a.command == "duplicates":
                _linkage(t, None, a, r)
            else:
                globals()[f"_{a.command}"](t, a, r)
    except (ValueError, FileExistsError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    print(r.as_json(a.ascii) if a.format == "json" else r.as_text(a.quiet), file=out)
    return r.code


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
