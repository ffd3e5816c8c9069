"""Further named queries: files and their faults, dates, names, graphs and linkage as a whole, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions import dates, metaphone, text
from kinforge.operators import export, file_checks, graph, languages, linkage, search, transform
from kinforge.operators._lineage import shared_folder
from kinforge.plans.catalog import _BOUNDS, _DOWN, _FOLD, _LINK, _UP, TODAY, World, _one, _pairs, _scored, _soundex, _two, query
from kinforge.sources import gedcom, writer

_TREE = "'tree' || id % 16"


def _lines(w: World, rows: Column, where: str = "true", ends: bool = False) -> DataFrame:
    """(file, line_no, raw): an array of lines for each person, in 16 files, and perhaps their heads and ends."""
    tree = F.concat(F.lit("tree"), F.pmod("id", F.lit(16)))
    own = w.people.filter(where).select(tree.alias("file"), F.col("id"), F.posexplode(rows).alias("k", "raw")).select("file", ((F.col("id") + 1) * 100 + F.col("k")).cast("long").alias("line_no"), "raw")
    if not ends:
        return own
    frame = w.people.select(tree.alias("file")).distinct().select("file", F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("line_no"), F.lit(raw).alias("raw")) for n, raw in ((1, "0 HEAD"), (2, "1 SUBM @U1@"), (1 << 50, "0 TRLR"))))).alias("x")).select("file", "x.*")
    return frame.unionByName(own)


def _nodes(lines: DataFrame) -> DataFrame:
    return gedcom.paths(gedcom.records(gedcom.parse_lines(lines)))


def _say(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


_id = lambda: F.col("id").cast("string")

# --- lines and values
_CONT = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NOTE ", F.col("given")), _say("2 CONC ", F.col("surname")), _say("2 CONT ", _id()), F.lit("2 CONT"), F.lit("2 SOUR @S1@"), F.lit("3 PAGE 4"), F.lit("4 CONC 2"))
query("gedcom_folded_values", "SELECT '@I' || id || '@' AS xref, path, value FROM (SELECT id, unnest(['INDI/NOTE', 'INDI/NOTE/SOUR/PAGE']) AS path, unnest([given || surname || chr(10) || id || chr(10), '42']) AS value FROM people WHERE given <> '' AND surname <> '')")(
    lambda w: gedcom.folded(_nodes(_lines(w, _CONT(), "given <> '' AND surname <> ''"))).filter("path IN ('INDI/NOTE', 'INDI/NOTE/SOUR/PAGE')").select(F.col("record_xref").alias("xref"), "path", "value")
)
query("gedcom_chains", f"SELECT {_TREE} AS file, (id + 1) * 100 + 2 AS line_no, 3 AS run FROM people WHERE given <> '' AND surname <> '' UNION ALL SELECT {_TREE}, (id + 1) * 100 + 7, 1 FROM people WHERE given <> '' AND surname <> ''")(lambda w: gedcom.chains(gedcom.parse_lines(_lines(w, _CONT(), "given <> '' AND surname <> ''"))))
_MARKED = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NAME A\u0085", _id(), " /B C /"))
query("gedcom_line_marks", "SELECT '@I' || id || '@' AS xref, 'A' || chr(133) || id AS given, 'B' || chr(8232) || 'C' || chr(8233) AS surname FROM people")(lambda w: gedcom.individuals(_nodes(_lines(w, _MARKED()))).select("xref", "given", "surname"))
_POINTED = lambda: F.array(_say("0 @N", _id(), "@ NOTE text ", _id()), F.lit("1 CONT more"), _say("0 @I", _id(), "@ INDI"), _say("1 NOTE @N", (F.col("id") + F.when(F.col("id") % 3 == 0, 1000000).otherwise(0)).cast("string"), "@"), F.lit("1 NOTE own"))
query("gedcom_dereferenced", "SELECT '@I' || id || '@' AS xref, CASE WHEN k = 1 THEN '@N' || (id + CASE WHEN id % 3 = 0 THEN 1000000 ELSE 0 END) || '@' END AS source, CASE WHEN k = 0 THEN 'own' WHEN id % 3 <> 0 THEN 'text ' || id || chr(10) || 'more' END AS text FROM people, (SELECT unnest([0, 1]) AS k)")(
    lambda w: gedcom.dereferenced(gedcom.folded(_nodes(_lines(w, _POINTED()))), "NOTE").select(F.col("record_xref").alias("xref"), "source", "text")
)
_OFFSETS = "(SELECT file, line_no, coalesce(sum(octet_length(encode(raw)) + 1) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT " + _TREE + " AS file, (id + 1) * 100 AS line_no, '0 @I' || id || '@ INDI' AS raw FROM people UNION ALL SELECT " + _TREE + ", (id + 1) * 100 + 1, '1 NAME ' || given || ' /' || surname || '/' FROM people))"
_NAMED = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NAME ", F.col("given"), " /", F.col("surname"), "/"))
query("gedcom_offsets", f"SELECT file, line_no, CAST(o AS BIGINT) AS place FROM {_OFFSETS}")(lambda w: gedcom.offsets(_lines(w, _NAMED())).select("file", "line_no", F.col("offset").alias("place")))
query("gedcom_line_at", f"SELECT file, CAST(o + 3 AS BIGINT) AS place, line_no FROM {_OFFSETS}")(lambda w: (lambda at: gedcom.line_at(at, at.select("file", (F.col("offset") + 3).alias("place"))))(gedcom.offsets(_lines(w, _NAMED()))))
query("gedcom_raw_values", f"SELECT {_TREE} AS file, (id + 1) * 100 + 1 AS line_no, given || ' /' || surname || '/' AS value FROM people WHERE id % 7 = 0")(lambda w: (lambda n: gedcom.raw_values(n, n.filter("tag = 'NAME'").filter((F.col("line_no") - 101) / 100 % 7 == 0)))(gedcom.parse_lines(_lines(w, _NAMED()))))
query("gedcom_places", "SELECT record_xref, place FROM (SELECT '@I' || id || '@' AS record_xref, unnest([birth_place, CASE WHEN death_year IS NOT NULL THEN 'Ort' END]) AS place FROM people) WHERE place IS NOT NULL")(
    lambda w: gedcom.places(_nodes(_lines(w, F.filter(F.array(_say("0 @I", _id(), "@ INDI"), F.lit("1 BIRT"), _say("2 PLAC ", F.col("birth_place")), F.when(F.col("death_year").isNotNull(), "1 DEAT"), F.when(F.col("death_year").isNotNull(), "2 PLAC Ort")), lambda x: x.isNotNull())))).select("record_xref", "place")
)
query("gedcom_alternate_names", "SELECT '@I' || id || '@' AS xref, CAST(k AS INTEGER) AS position, CASE k WHEN 1 THEN given ELSE 'Third' END AS given, CASE k WHEN 1 THEN 'Alias' ELSE surname END AS surname FROM people, (SELECT unnest([1, 2]) AS k) WHERE given <> '' AND surname <> ''")(
    lambda w: gedcom.alternate_names(_nodes(_lines(w, F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NAME ", F.col("given"), " /", F.col("surname"), "/"), _say("1 NAME ", F.col("given"), " /Alias/"), _say("1 NAME Third /", F.col("surname"), "/")), "given <> '' AND surname <> ''"))).select("xref", "position", "given", "surname")
)

# --- faults of files: ten kinds of records, one for each person by the id's last digit
_KIND = lambda: F.col("id") % 10
_X = "x" * 300
_FAULTS = lambda: (
    F.when(_KIND() == 0, F.array(_say("0 @O", _id(), "@ OBJE"), F.lit("1 TITL none"))).when(_KIND() == 1, F.array(_say("0 @O", _id(), "@ OBJE"), F.lit("1 FILE a.jpg"), F.lit("1 FILE b.jpg"), F.lit("2 FORM jpg"))).when(_KIND() == 2, F.array(_say("0 @N", _id(), "@ NOTE nobody's")))
    .when(_KIND() == 3, F.array(_say("0 @S", _id(), "@ SOUR"))).when(_KIND() == 4, F.array(_say("0 @R", _id(), "@ REPO"))).when(_KIND() == 5, F.array(_say("0 @P", _id(), "@ INDI"), F.lit("1 SEX M"), F.lit("1 SEX F"))).when(_KIND() == 6, F.array(_say("0 @P", _id(), "@ INDI"), F.lit("1 SEX Q")))
    .when(_KIND() == 7, F.array(_say("0 @P", _id(), "@ INDI"), F.lit("1 BIRT"), F.lit("2 DATE Reg 1823"), F.lit("1 DEAT"), F.lit("2 DATE (unknown)"))).when(_KIND() == 8, F.array(_say("0 @P", _id(), "@ INDI"), F.lit(f"1 NOTE {_X}"), F.lit("1 NOTE end "))).otherwise(F.array(_say("0 _REC", _id())))
)
_FAULT_SQL = f"""(SELECT {_TREE} AS file, unnest(CASE id % 10 WHEN 0 THEN ['W033', 'W011'] WHEN 1 THEN ['W034', 'W011'] WHEN 2 THEN ['W010'] WHEN 3 THEN ['W012'] WHEN 4 THEN ['W013'] WHEN 5 THEN ['W027'] WHEN 6 THEN ['W028'] WHEN 7 THEN ['W035'] WHEN 8 THEN ['W003', 'W002'] ELSE ['W004'] END) AS code,
  (id + 1) * 100 + unnest(CASE id % 10 WHEN 0 THEN [0, 0] WHEN 1 THEN [1, 0] WHEN 6 THEN [1] WHEN 7 THEN [2] WHEN 8 THEN [1, 2] ELSE [0] END) AS line_no FROM people)"""
query("gedcom_all_checks", f"SELECT * FROM {_FAULT_SQL}")(lambda w: file_checks.all_checks(_nodes(_lines(w, _FAULTS(), ends=True))).select("file", "code", "line_no"))
query("gedcom_reported_checks", f"""SELECT file, code, line_no, suppressed FROM (SELECT file, code, line_no, 0 AS suppressed, row_number() OVER (PARTITION BY file, code ORDER BY line_no) AS r FROM {_FAULT_SQL}) WHERE code NOT IN ('W002', 'W003', 'W035') OR r <= 2
  UNION ALL SELECT file, code, NULL, count(*) - 2 FROM {_FAULT_SQL} WHERE code IN ('W002', 'W003', 'W035') GROUP BY ALL HAVING count(*) > 2""")(lambda w: file_checks.reported(file_checks.all_checks(_nodes(_lines(w, _FAULTS(), ends=True))), 2).select("file", "code", "line_no", "suppressed"))
query("gedcom_tallies", f"SELECT file, CAST(0 AS BIGINT) AS errors, count(*) AS warnings, true AS ok FROM {_FAULT_SQL} GROUP BY file")(lambda w: file_checks.tallies(file_checks.reported(file_checks.all_checks(_nodes(_lines(w, _FAULTS(), ends=True))), 2)))
_JUMPS = lambda: F.array(_say("0 @I", _id(), "@ INDI"), F.when(F.col("id") % 2 == 0, "2 DATE 1900").otherwise("1 SEX M"), F.when(F.col("id") % 3 == 0, "?junk").otherwise("1 SEX M"))
query("gedcom_jumps_and_junk", f"SELECT {_TREE} AS file, 'E003' AS code, min((id + 1) * 100 + 1) AS line_no FROM people WHERE id % 2 = 0 GROUP BY ALL UNION ALL SELECT {_TREE}, 'E004', min((id + 1) * 100 + 2) FROM people WHERE id % 3 = 0 GROUP BY ALL")(lambda w: gedcom.structure(_nodes(_lines(w, _JUMPS(), ends=True))))
_LOOSE = lambda: F.array(_say("0 @I", _id(), "@ INDI"), *(F.when(F.col("id") % (k + 2) == 0, f"1 _T{k} x").otherwise("1 SEX M") for k in range(14)))
query("gedcom_custom_tags", f"""SELECT file, line_no FROM (SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) AS r FROM (SELECT {_TREE} AS file, k, min((id + 1) * 100 + 1 + k) AS line_no FROM people, (SELECT unnest(range(14)) AS k) WHERE id % (k + 2) = 0 GROUP BY ALL)) WHERE r <= 11""")(lambda w: file_checks.custom_tags(_nodes(_lines(w, _LOOSE()))).select("file", "line_no"))

# --- files written
_SAVED = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NAME ", F.col("given"), " /", F.col("surname"), "/"))
_SAVED_SQL = f"SELECT file || '.ged' AS file, count(*) + 3 AS lines FROM (SELECT {_TREE} AS file, unnest([1, 2]) FROM people) GROUP BY 1"


def _saved(w: World, name: str) -> str:
    folder = shared_folder(w.spark, name)
    lines = _lines(w, _SAVED(), ends=True).withColumn("file", F.concat("file", F.lit(".ged")))
    writer.write(lines, folder)
    return folder


_name_of = lambda: F.element_at(F.split("file", "/"), -1).alias("file")
query("file_write_round_trip", _SAVED_SQL)(lambda w: gedcom.read_lines(w.spark, _saved(w, "written")).groupBy(_name_of()).agg(F.count("*").alias("lines")))


def _converted(w: World, target: str, **kw) -> DataFrame:
    source, folder = _saved(w, "to-convert"), shared_folder(w.spark, "converted")
    done = writer.convert(w.spark, source, folder, target, **kw)
    if kw.get("dry_run"):
        return done.select(_name_of(), "lines", "written")
    n = gedcom.parse_lines(gedcom.read_lines(w.spark, folder))
    return n.groupBy(_name_of()).agg(F.count("*").alias("lines"), F.max(F.when(F.col("tag") == "CHAR", F.col("value"))).alias("encoding"), F.count_if(F.col("tag") == "NAME").alias("names"))


query("file_convert_unicode", f"SELECT s.file, lines + 1 AS lines, 'UNICODE' AS encoding, (lines - 3) // 2 AS names FROM ({_SAVED_SQL}) s")(lambda w: _converted(w, "UNICODE", mark=True))
query("file_convert_dry_run", f"SELECT file, lines + 1 AS lines, false AS written FROM ({_SAVED_SQL})")(lambda w: _converted(w, "UTF-8", dry_run=True))

# --- transforms of whole files
_TOLD = lambda: F.filter(F.array(_say("0 @I", _id(), "@ INDI"), F.lit("1 SEX M"), _say("1 FAMS @F", _id(), "@"), F.lit("1 _MINE x"), F.lit("2 NOTE inner"), _say("1 NOTE @N", _id(), "@"), F.lit("2 CONC more"), _say("0 @N", _id(), "@ NOTE n"), _say("0 @F", _id(), "@ FAM"), F.when(F.col("id") % 2 == 0, _say("1 HUSB @I", _id(), "@")), F.lit("1 MARR")), lambda x: x.isNotNull())
query("transform_filtered", f"SELECT file, record_tag, count(*) AS n FROM (SELECT {_TREE} AS file, unnest(CASE WHEN id % 2 = 0 THEN ['INDI', 'INDI', 'INDI', 'FAM', 'FAM', 'FAM'] ELSE ['INDI', 'INDI'] END) AS record_tag FROM people UNION ALL SELECT DISTINCT {_TREE}, unnest(['HEAD', 'HEAD', 'TRLR']) FROM people) GROUP BY ALL".replace("SELECT DISTINCT 'tree' || id % 16, unnest(['HEAD', 'HEAD', 'TRLR']) FROM people", "SELECT file, unnest(['HEAD', 'HEAD', 'TRLR']) FROM (SELECT DISTINCT 'tree' || id % 16 AS file FROM people)"))(
    lambda w: transform.filtered(_nodes(_lines(w, _TOLD(), ends=True)), strip=["NOTE"], custom=True).groupBy("file", "record_tag").agg(F.count("*").alias("n"))
)
query("transform_record_changes", f"SELECT file, unnest(['INDI', 'FAM', 'NOTE']) AS tag, unnest([n, n, n]) AS source, unnest([n, even, 0]) AS output, unnest([0, n - even, n]) AS removed FROM (SELECT {_TREE} AS file, count(*) AS n, count(*) FILTER (id % 2 = 0) AS even FROM people GROUP BY 1)")(
    lambda w: (lambda n: transform.record_changes(n, transform.filtered(n, strip=["NOTE"], custom=True)).filter("tag <> 'other'"))(_nodes(_lines(w, _TOLD(), ends=True)))
)
_CHAINED = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 SOUR @S", _id(), "@"), _say("0 @S", _id(), "@ SOUR"), _say("1 REPO @R", _id(), "@"), _say("0 @R", _id(), "@ REPO"), _say("1 NOTE @N", _id(), "@"), _say("0 @N", _id(), "@ NOTE x"), _say("0 @F", _id(), "@ FAM"), _say("1 CHIL @I", _id(), "@"))
query("transform_subtree_records", "SELECT unnest(['@I' || id || '@', '@S' || id || '@', '@R' || id || '@', '@N' || id || '@', '@F' || id || '@']) AS xref FROM people WHERE id % 5 = 0")(
    lambda w: (lambda n: transform.subtree_records(n, n.filter("level = 0 AND tag = 'INDI'").filter(F.regexp_extract("record_xref", r"(\d+)", 1).cast("long") % 5 == 0).select("file", F.col("record_xref").alias("xref"))).select("xref"))(_nodes(_lines(w, _CHAINED())))
)
query("transform_empty_families_removed", f"SELECT {_TREE} AS file, count(*) FILTER (id % 2 = 0) AS n FROM people GROUP BY 1 HAVING count(*) FILTER (id % 2 = 0) > 0")(lambda w: transform.strip_empty_families(_nodes(_lines(w, _TOLD()))).filter("level = 0 AND record_tag = 'FAM'").groupBy("file").agg(F.count("*").alias("n")))

# --- privacy
_LIFE = lambda: F.filter(F.array(_say("0 @I", _id(), "@ INDI"), F.lit("1 BIRT"), _say("2 DATE ", F.when(F.col("id") % 4 == 0, "BEF ").otherwise(""), F.col("birth_year").cast("string")), F.when(F.col("id") % 3 == 0, "1 BAPM"), F.when(F.col("id") % 3 == 0, "2 DATE 1980"), F.when(F.col("death_year").isNotNull(), "1 BURI"), F.when(F.col("death_year").isNotNull(), _say("2 DATE AFT ", F.col("death_year").cast("string"))), F.when(F.col("id") % 11 == 0, "1 RESN Privacy"), F.when(F.col("id") % 13 == 0, "1 RESN none"), F.when(F.col("id") % 17 == 0, "1 _lvg Y")), lambda x: x.isNotNull())
query("export_living_people", f"""SELECT '@I' || id || '@' AS xref, CASE WHEN id % 11 = 0 OR id % 17 = 0 THEN true WHEN {TODAY} - CASE WHEN id % 3 = 0 THEN 1980 ELSE birth_year END > 110 OR death_year <= {TODAY} + 1 THEN false ELSE true END AS living, id % 11 = 0 AS restricted FROM people""")(
    lambda w: export.living_people(_nodes(_lines(w, _LIFE())), TODAY).select("xref", "living", "restricted")
)
query("export_family_labels", "SELECT f.id, coalesce(nullif(trim(h.surname), ''), '?') || '/' || coalesce(nullif(trim(w.surname), ''), '?') AS label FROM families f LEFT JOIN people h ON h.id = husb LEFT JOIN people w ON w.id = wife")(lambda w: export.family_labels(w.families, w.people))
query("export_families_restricted", "SELECT id, marriage_year FROM (SELECT f.id, CASE WHEN f.id % 3 = 0 OR h.id IS NOT NULL OR w.id IS NOT NULL THEN NULL ELSE marriage_year END AS marriage_year FROM families f LEFT JOIN (SELECT id FROM people WHERE death_year IS NULL AND birth_year >= 1890) h ON h.id = husb LEFT JOIN (SELECT id FROM people WHERE death_year IS NULL AND birth_year >= 1890) w ON w.id = wife)")(
    lambda w: export.redacted_families(export.families(w.families, w.children, w.people), w.families, export.individuals(w.people, w.families, TODAY).select("id", "living"), w.families.filter("id % 3 = 0").select("id")).select("id", "marriage_year")
)
query("export_shown_children", "SELECT fam, child FROM children JOIN people ON id = child WHERE death_year IS NOT NULL OR 2000 - birth_year > 110")(lambda w: export.shown_children(w.children, export.individuals(w.people, w.families, TODAY).select("id", "living")))
query("sort_xref_order", """SELECT xref, row_number() OVER (ORDER BY regexp_extract(xref, '^@([A-Za-z]*)([0-9]+)@', 1), CASE WHEN regexp_matches(xref, '^@([A-Za-z]*)([0-9]+)@') THEN CAST(regexp_extract(xref, '^@([A-Za-z]*)([0-9]+)@', 2) AS BIGINT) ELSE 0 END, CASE WHEN regexp_matches(xref, '^@([A-Za-z]*)([0-9]+)@') THEN '' ELSE xref END) AS place
  FROM (SELECT CASE id % 4 WHEN 0 THEN '@F' || id || '@' WHEN 1 THEN '@I' || id || '@' WHEN 2 THEN '@' || id || '@' ELSE '@x-' || id || '@' END AS xref FROM people)""")(
    lambda w: (lambda x: x.withColumn("place", F.row_number().over(_by(text.xref_order(F.col("xref"))))))(w.people.select(F.when(F.col("id") % 4 == 0, _say("@F", _id(), "@")).when(F.col("id") % 4 == 1, _say("@I", _id(), "@")).when(F.col("id") % 4 == 2, _say("@", _id(), "@")).otherwise(_say("@x-", _id(), "@")).alias("xref")))
)


def _by(order: list[Column]):
    from pyspark.sql import Window

    return Window.orderBy(*order)


_TOLD_LIFE = lambda: F.filter(F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NAME ", F.col("given"), " /", F.col("surname"), "/ Jr"), _say("1 SEX ", F.col("sex")), F.lit("1 BIRT"), F.when(F.col("id") % 4 != 0, _say("2 DATE ABT ", F.col("birth_year").cast("string"))), F.lit("1 CHR"), _say("2 DATE ", (F.col("birth_year") + 1).cast("string")), _say("2 PLAC ", F.col("birth_place")), F.lit("1 OCCU first"), F.when(F.col("id") % 2 == 0, "1 OCCU second"), F.when(F.col("death_year").isNotNull(), "1 BURI"), F.when(F.col("death_year").isNotNull(), _say("2 DATE ", F.col("death_year").cast("string"))), F.lit("1 FAMS @F1@"), F.lit("1 FAMS @F2@"), F.lit("1 FAMC @F3@"), F.when(F.col("id") % 2 == 0, "1 SOUR @S1@")), lambda x: x.isNotNull())
_ROWS = """SELECT '@I' || id || '@' AS xref, given, surname, 'Jr' AS suffix, sex, CASE WHEN id % 4 <> 0 THEN 'ABT ' || birth_year ELSE CAST(birth_year + 1 AS VARCHAR) END AS birth_date, CASE WHEN id % 4 <> 0 THEN birth_year ELSE birth_year + 1 END AS birth_year, birth_place, '' AS death_date, death_year, '' AS death_place,
  coalesce(CAST(death_year AS VARCHAR), '') AS burial_date, '' AS burial_place, CASE WHEN id % 2 = 0 THEN 'first; second' ELSE 'first' END AS occupations, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS source_count, '@F3@' AS famc_xref, '@F1@;@F2@' AS fams_xrefs FROM people WHERE given <> '' AND surname <> ''"""
query("export_individual_rows", _ROWS)(lambda w: export.individual_rows(_nodes(_lines(w, _TOLD_LIFE(), "given <> '' AND surname <> ''"))).drop("file"))
_HIDDEN = "(death_year IS NULL OR death_year > 2001) AND 2000 - birth_year - 1 <= 110"
query("export_redacted_rows", f"SELECT xref, CASE WHEN living THEN 'Living' ELSE given END AS given, CASE WHEN NOT living THEN birth_year END AS birth_year, CASE WHEN living THEN '' ELSE occupations END AS occupations, source_count FROM (SELECT r.*, {_HIDDEN.replace('birth_year', 'p.birth_year').replace('death_year', 'p.death_year')} AS living FROM ({_ROWS}) r JOIN people p ON p.xref = r.xref)")(
    lambda w: (lambda n: export.redacted_rows(export.individual_rows(n), export.living_people(n, TODAY)).select("xref", "given", "birth_year", "occupations", "source_count"))(_nodes(_lines(w, _TOLD_LIFE(), "given <> '' AND surname <> ''")))
)
query("export_family_rows", "SELECT '@F' || f.id || '@' AS xref, '@I' || husb || '@' AS husband_xref, h.given || ' ' || h.surname AS husband_name, coalesce('@I' || wife || '@', '') AS wife_xref, coalesce(w.given || ' ' || w.surname, '') AS wife_name, coalesce(CAST(marriage_year AS VARCHAR), '') AS marriage_date, marriage_year, '' AS marriage_place, CAST(n AS INTEGER) AS child_count, kids AS children_xrefs FROM families f JOIN people h ON h.id = husb LEFT JOIN people w ON w.id = wife JOIN (SELECT fam, count(*) AS n, string_agg('@I' || child || '@', ';' ORDER BY child) AS kids FROM children GROUP BY 1) ON fam = f.id WHERE h.given <> '' AND h.surname <> '' AND coalesce(w.given, 'x') <> '' AND coalesce(w.surname, 'x') <> ''")(
    lambda w: export.family_rows(_nodes(gedcom.tree_lines(w.people, w.families, w.children, F.lit("one")))).drop("file").join(w.people.filter("given = '' OR surname = ''").select(F.col("xref").alias("husband_xref")), "husband_xref", "left_anti").join(w.people.filter("given = '' OR surname = ''").select(F.col("xref").alias("wife_xref")), "wife_xref", "left_anti")
)
query("text_display_names", "SELECT id, CASE WHEN id % 5 = 0 THEN '[Unknown] (' || xref || ')' ELSE trim(given || ' ' || surname) END AS name, CASE WHEN sex IN ('M', 'F') THEN sex ELSE '' END AS sex FROM people WHERE given <> '' AND surname <> ''")(
    lambda w: w.people.filter("given <> '' AND surname <> ''").select("id", text.display_name(F.when(F.col("id") % 5 == 0, "").otherwise(F.col("given")), F.when(F.col("id") % 5 == 0, " ").otherwise(F.col("surname")), F.lit(""), F.col("xref")).alias("name"), text.sex_of(F.concat(F.lit(" "), F.lower("sex")), "binary").alias("sex"))
)

# --- dates
_K = lambda: F.col("id") % 8
_y = lambda: F.col("birth_year").cast("string")
_y5 = lambda: (F.col("birth_year") + 5).cast("string")
_DATES = lambda: F.when(_K() == 0, _say("ABT ", _y())).when(_K() == 1, _say("BEF ", _y())).when(_K() == 2, _say("AFT ", _y())).when(_K() == 3, _say("BET ", _y5(), " AND ", _y())).when(_K() == 4, _say("FROM ", _y(), " TO ", _y5())).when(_K() == 5, _say("1 MAR ", _y(), "/", F.lpad(((F.col("birth_year") + 1) % 100).cast("string"), 2, "0"))).when(_K() == 6, _say("Reg ", _y())).otherwise(_say("12/2/", _y()))
_LO = "CASE id % 8 WHEN 1 THEN NULL WHEN 5 THEN birth_year + 1 WHEN 6 THEN NULL ELSE birth_year END"
_HI = "CASE id % 8 WHEN 2 THEN NULL WHEN 3 THEN birth_year + 5 WHEN 4 THEN birth_year + 5 WHEN 5 THEN birth_year + 1 WHEN 6 THEN NULL ELSE birth_year END"
query("date_bounds", f"SELECT id, {_LO} AS lo, {_HI} AS hi FROM people")(lambda w: w.people.select("id", dates.bounds(_DATES()).alias("b")).select("id", "b.lo", "b.hi"))
query("date_bounds_liveness", f"SELECT id, CASE WHEN id % 8 <> 7 THEN {_LO} END AS lo, CASE WHEN id % 8 <> 7 THEN {_HI} END AS hi FROM people")(lambda w: w.people.select("id", dates.bounds(_DATES(), liveness=True).alias("b")).select("id", "b.lo", "b.hi"))
query("date_reported_year", "SELECT id, CASE id % 8 WHEN 3 THEN birth_year + 5 ELSE birth_year END AS year, CASE id % 8 WHEN 5 THEN 3 END AS month FROM people")(lambda w: w.people.select("id", dates.parse(_DATES()).alias("d")).select("id", "d.year", "d.month"))
query("date_calendars", "SELECT id, birth_year - 1 AS hebrew_lo, birth_year AS hebrew_hi, birth_year AS french_lo, birth_year + 1 AS french_hi FROM people WHERE birth_year > 1800")(
    lambda w: w.people.filter("birth_year > 1800").select("id", dates.parse(_say("@#DHEBREW@ ", (F.col("birth_year") + 3760).cast("string"))).alias("h"), dates.parse(_say("@#DFRENCH R@ ", (F.col("birth_year") - 1791).cast("string"))).alias("f")).select("id", F.col("h.lo").alias("hebrew_lo"), F.col("h.hi").alias("hebrew_hi"), F.col("f.lo").alias("french_lo"), F.col("f.hi").alias("french_hi"))
)
query("date_long_months", "SELECT id, birth_year AS year, CASE id % 3 WHEN 0 THEN 6 WHEN 1 THEN 7 ELSE 9 END AS month, 'full' AS precision FROM people")(lambda w: w.people.select("id", dates.parse(_say("12 ", F.when(F.col("id") % 3 == 0, "JUNE").when(F.col("id") % 3 == 1, "July").otherwise("SEPT"), " ", _y())).alias("d")).select("id", "d.year", "d.month", "d.precision"))
query("text_collapsed", "SELECT id, trim(regexp_replace(given || '   ' || chr(9) || surname || ' ', '\\s+', ' ', 'g')) AS value FROM people WHERE given <> '' AND surname <> ''")(lambda w: w.people.filter("given <> '' AND surname <> ''").select("id", text.collapsed(_say(F.col("given"), "   \t", F.col("surname"), " ")).alias("value")))
query("functions_metaphone")(lambda w: w.people.select("surname", metaphone.metaphone(F.col("surname")).alias("m")).select("surname", "m.first", "m.second"))

# --- search
_ALTS = lambda: F.when(F.col("id") % 9 == 0, F.array(F.struct(F.lit("Zoltan").alias("given"), F.col("given").alias("surname")))).otherwise(F.array().cast("array<struct<given:string,surname:string>>"))
_ALT_SQL = "id % 9 = 0 AND "
_search = lambda name, where, f: query(name, f"SELECT id, given, surname FROM searched WHERE {where}", _FOLD)(lambda w: f(w).select("id", "given", "surname"))
_more = lambda w: w.people.withColumn("alternates", _ALTS())
_search("search_alternate_surname", "surname_f = 'and' OR (id % 9 = 0 AND given_f = 'and')", lambda w: search.run("surname=and", _more(w), w.parents))
_search("search_alternate_given", "contains(given_f, 'zolt') OR id % 9 = 0", lambda w: search.run("given:zolt", _more(w), w.parents))
_search("search_marks_wildcard", "surname_f LIKE 'lale%elle'", lambda w: search.run("surname:lalé*elle", w.people, w.parents))
_search("search_marks_regex", "regexp_matches(surname_f, '^lale+n')", lambda w: search.run("surname:^lalé+n", w.people, w.parents, regex=True))
_stars = lambda w: w.people.withColumn("surname", F.when(F.col("id") % 40 == 0, "*").otherwise(F.col("surname")))
query("search_exact_star", "SELECT id, given FROM searched WHERE id % 40 = 0 OR surname_f = '*'", _FOLD)(lambda w: search.run("surname=*", _stars(w), w.parents).select("id", "given"))
_search("search_death_place", "contains(lower(death_place), 'de, src')", lambda w: search.run('place:"de, src"', w.people, w.parents))
_search("search_sex", "sex = 'F'", lambda w: search.run("sex:F", w.people, w.parents))
query("search_matches", "SELECT id, given || ' ' || surname AS text, 'contains' AS type FROM searched WHERE contains(name_f, 'ther') AND given <> '' AND surname <> ''", _FOLD)(lambda w: search.run("ther", w.people, w.parents, matches=True).filter("given <> '' AND surname <> ''").select("id", F.col("matches")[0]["text"].alias("text"), F.col("matches")[0]["type"].alias("type")))
query("search_first_page", "SELECT id, true AS more FROM (SELECT id FROM people WHERE sex = 'M' ORDER BY id LIMIT 25)")(lambda w: (lambda t: t[0].select("id", F.lit(t[1]).alias("more")))(search.page(search.run("sex:M", w.people, w.parents), 25)))
query("search_by_metaphone")(lambda w: search.run("surname~tharan", w.people, w.parents, phonetic="metaphone").select("id", "surname"))

# --- linkage as a whole
_JW = lambda x, y: f"jaro_winkler_similarity({_one(x)}, {_one(y)})"
_part = lambda t, c, k: f"split_part(lower(strip_accents({t}.{c})), ', ', {k})"


def _place(c: str) -> str:
    jw = lambda i, j: _JW(_part("x", c, i), _part("y", c, j))
    return f"CASE WHEN x.{c} <> '' AND y.{c} <> '' THEN (CASE WHEN {jw(1, 1)} >= {jw(1, 2)} THEN {jw(1, 1)} + {jw(2, 2)} ELSE {jw(1, 2)} + {jw(2, 1)} END) / 2 END"


_yearly = lambda c: f"CASE WHEN abs(x.{c} - y.{c}) = 0 THEN 1e0 WHEN abs(x.{c} - y.{c}) <= 1 THEN 0.85e0 WHEN abs(x.{c} - y.{c}) <= 2 THEN 0.7e0 WHEN abs(x.{c} - y.{c}) <= 3 THEN 0.5e0 WHEN abs(x.{c} - y.{c}) <= 5 THEN 0.25e0 WHEN abs(x.{c} - y.{c}) <= 7 THEN 0.1e0 WHEN abs(x.{c} - y.{c}) <= 10 THEN 0.05e0 WHEN abs(x.{c} - y.{c}) IS NOT NULL THEN 0e0 END"
_W = linkage.WEIGHTS
_SCORED = f""", fields AS (
  SELECT a, b, CASE WHEN x.surname_f <> '' AND y.surname_f <> '' THEN {_JW('x.surname_f', 'y.surname_f')} END AS surname, CASE WHEN x.given_f <> '' AND y.given_f <> '' THEN {_JW('x.given_f', 'y.given_f')} END AS given, {_yearly('birth_year')} AS birth_year, {_yearly('death_year')} AS death_year,
    {_place('birth_place')} AS birth_place, {_place('death_place')} AS death_place, CASE WHEN x.sex <> '' AND x.sex = y.sex THEN 1e0 END AS sex, x.sex <> '' AND y.sex <> '' AND x.sex <> y.sex AS mismatch, x.surname_code = y.surname_code AND x.surname_code <> '' AS same_code
  FROM pairs JOIN coded x ON x.id = a JOIN coded y ON y.id = b
), sums AS (
  SELECT *, {' + '.join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _W)} AS n, {' + '.join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in linkage.CORROBORATING)} AS facts,
    (0e0 + {' + '.join(f"coalesce({c} * {v}e0, 0e0)" for c, v in _W.items())}) / nullif(0e0 + {' + '.join(f"CASE WHEN {c} IS NOT NULL THEN {v}e0 ELSE 0e0 END" for c, v in _W.items())}, 0e0) AS mean FROM fields
), totals AS (
  SELECT *, coalesce(CASE WHEN mismatch THEN 0.7e0 ELSE 1e0 END * CASE WHEN same_code AND surname BETWEEN 0.5e0 AND 0.85e0 THEN least(mean + 0.05e0, 1e0) ELSE mean END, 0e0) AS total FROM sums
), judged AS (
  SELECT *, CASE WHEN n < 3 THEN 'non_match' WHEN facts = 0 OR n = 3 THEN CASE WHEN total >= 0.65e0 THEN 'probable' ELSE 'non_match' END WHEN total >= 0.85e0 THEN 'certain' WHEN total >= 0.65e0 THEN 'probable' ELSE 'non_match' END AS class FROM totals
)"""
_ALL = _FOLD + _LINK.rstrip() + _SCORED
query("linkage_totals", "SELECT a, b, round(total, 6) AS total, n AS fields, n > 0 AND facts = 0 AS name_only, n < 3 OR facts = 0 AS insufficient_data, class FROM judged", _ALL)(lambda w: _scored(w).select("a", "b", linkage.rounded(F.col("total"), 6).alias("total"), "fields", "name_only", "insufficient_data", "class"))
query("linkage_classified", "SELECT class, count(*) AS n FROM judged GROUP BY class", _ALL)(lambda w: _scored(w).groupBy("class").agg(F.count("*").alias("n")))
query("linkage_matches_by_id", "SELECT a, b, round(total, 4) AS total, class FROM judged WHERE class <> 'non_match'", _ALL)(lambda w: _scored(w).filter("class <> 'non_match'").select("a", "b", linkage.rounded(F.col("total"), 4).alias("total"), "class"))
_TAKEN = """, ranked AS MATERIALIZED (SELECT a, b, round(total, 4) AS total, row_number() OVER (ORDER BY round(total, 4) DESC, a, b) AS r FROM judged WHERE class <> 'non_match'{where}
), walk(r, used, a, b, total, took) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), false
  UNION ALL SELECT k.r, CASE WHEN list_contains(used, k.a) OR list_contains(used, k.b) THEN used ELSE list_append(list_append(used, k.a), k.b) END, k.a, k.b, k.total, NOT (list_contains(used, k.a) OR list_contains(used, k.b)) FROM walk JOIN ranked k ON k.r = walk.r + 1)"""
query("duplicates_greedy", "SELECT a, b, total FROM walk WHERE took", _ALL + _TAKEN.format(where=""))(lambda w: linkage.greedy(_scored(w).filter("class <> 'non_match'"), same=True))
# two files: even ids against odd ones, whose blocks count
_PAIRS_OF_TWO = _LINK.replace("JOIN (SELECT pass, key FROM keys GROUP BY ALL HAVING count(*) <= 500) USING (pass, key) WHERE l.id < r.id", "JOIN (SELECT pass, key FROM keys WHERE id % 2 = 1 GROUP BY ALL HAVING count(*) <= 500) USING (pass, key) WHERE l.id % 2 = 0 AND r.id % 2 = 1")
_OF_TWO = _FOLD + _PAIRS_OF_TWO.rstrip() + _SCORED + _TAKEN.format(where="")
query("linkage_greedy_matches", "SELECT a, b, total FROM walk WHERE took", _OF_TWO)(lambda w: linkage.greedy(_two(w)[2], same=False))
query("linkage_unmatched", "SELECT id FROM people WHERE id % 2 = 0 AND id NOT IN (SELECT a FROM walk WHERE took)", _OF_TWO)(lambda w: (lambda t: linkage.unmatched(t[0], linkage.greedy(t[2], same=False), "a"))(_two(w)))


def _by_sound(w: World) -> DataFrame:
    return linkage.classified(linkage.scores(_pairs(w, phonetic="metaphone", people=_more(w))))


query("linkage_by_metaphone")(lambda w: _by_sound(w).filter("class <> 'non_match'").select("a", "b", linkage.rounded(F.col("total"), 4).alias("total"), "class"))
query("linkage_skipped_blocks", "SELECT DISTINCT key FROM keys GROUP BY pass, key HAVING count(*) > 5", _FOLD + _LINK)(lambda w: (lambda k: linkage.skipped_keys(k, k, cap=5))(linkage.block_keys(linkage.prepared(w.people))))

# --- graphs
query("graph_generations_with_a_ring", "SELECT id, max(depth) AS depth FROM g GROUP BY 1", ", ringed AS (SELECT DISTINCT child, parent FROM parents UNION SELECT parent, child FROM parents WHERE child % 50 = 20), ups(s, t) AS (SELECT child, parent FROM ringed UNION SELECT s, parent FROM ups JOIN ringed ON child = t), rings AS (SELECT DISTINCT s FROM ups WHERE s = t), straight AS (SELECT * FROM ringed WHERE NOT (child IN (SELECT s FROM rings) AND parent IN (SELECT s FROM rings))), g(id, depth) AS (SELECT id, 0 FROM people WHERE id NOT IN (SELECT child FROM straight) UNION SELECT child, depth + 1 FROM g JOIN straight ON parent = g.id)")(
    lambda w: graph.generation_depth(w.people, (lambda p: p.union(p.filter("child % 50 = 20").select("parent", "child")))(w.parents.select("child", "parent").distinct()))
)
_PATHS = ", " + _UP.format(root=150) + """, ups AS (SELECT id AS ancestor, min(depth) AS gp FROM up GROUP BY 1), d(ancestor, target, gt) AS (SELECT ancestor, ancestor, 0 FROM ups UNION SELECT ancestor, child, gt + 1 FROM d JOIN parents ON parent = target WHERE gt < 30),
  shared AS (SELECT ancestor, target, gp, min(gt) AS gt FROM d JOIN ups USING (ancestor) GROUP BY ALL), couples AS (SELECT husb AS x, wife AS y FROM families WHERE wife IS NOT NULL UNION SELECT wife, husb FROM families WHERE wife IS NOT NULL),
  paired AS (SELECT DISTINCT s.target, s.gp, s.gt FROM shared s JOIN couples ON x = s.ancestor JOIN shared t ON t.target = s.target AND t.ancestor = y),
  halves AS (SELECT s.target, s.gp, s.gt, count(*) AS n, CASE WHEN s.gp = 0 OR s.gt = 0 THEN false WHEN s.gp = 1 AND s.gt = 1 THEN count(*) < 2 ELSE NOT EXISTS (SELECT 1 FROM paired p WHERE p.target = s.target AND p.gp = s.gp AND p.gt = s.gt) END AS is_half FROM shared s GROUP BY s.target, s.gp, s.gt)"""
query("graph_half_relations", "SELECT target, min(gp + gt) AS gens, bool_or(is_half) AS any_half, bool_and(is_half) AS all_half FROM halves GROUP BY target", _PATHS)(lambda w: graph.relation_paths(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents, w.families).groupBy("target").agg(F.min(F.col("gp") + F.col("gt")).alias("gens"), F.bool_or("is_half").alias("any_half"), F.bool_and("is_half").alias("all_half")))
query("graph_relation_paths")(lambda w: graph.relation_paths(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents, w.families).select("target", "rank", "relation", "gp", "gt", F.size("ancestors").alias("n"), "is_half"))
query("graph_sentences", "SELECT child, CASE WHEN sex = 'M' THEN 'P is the father of C.' WHEN sex = 'F' THEN 'P is the mother of C.' ELSE 'P is the parent of C.' END AS sentence FROM (SELECT DISTINCT child, parent FROM parents) JOIN people ON id = parent")(
    lambda w: w.parents.select("child", "parent").distinct().join(w.people.select(F.col("id").alias("parent"), "sex"), "parent").select("child", graph.sentence(F.lit("P"), F.lit("C"), graph.kinship(F.lit(1), F.lit(0), F.col("sex")), F.lit(False), False).alias("sentence"))
)
query("graph_truncated", "SELECT DISTINCT root FROM (SELECT root, id, min(depth) AS depth FROM t GROUP BY ALL) JOIN parents ON child = id WHERE depth = 2", ", t(root, id, depth) AS (SELECT id, id, 0 FROM people UNION SELECT root, parent, depth + 1 FROM t JOIN parents ON child = t.id WHERE depth < 2)")(
    lambda w: graph.truncated(graph.ancestors(w.people.select(F.col("id").alias("root")), w.parents, 2), w.parents, 2)
)
query("graph_descendants_of_many", "SELECT id, min(depth) AS depth FROM down GROUP BY 1", ", " + _DOWN.format(root=2))(lambda w: graph.descendants(w.people.filter("id = 2").select(F.col("id").alias("root")), w.parents).select("id", "depth"))

# --- notes
_NOTED = lambda: F.array(_say("0 @I", _id(), "@ INDI"), _say("1 NOTE story ", _id()), F.lit("1 BIRT"), _say("2 NOTE @N", _id(), "@"), F.lit("1 SOUR @S1@"), F.lit("2 NOTE of a source"), _say("0 @F", _id(), "@ FAM"), F.lit("1 NOTE of a family"), F.lit("1 MARR"), F.lit("2 NOTE of a wedding"), _say("0 @N", _id(), "@ NOTE shared ", _id()), _say("0 @X", _id(), "@ NOTE alone ", _id()))
query("languages_note_rows", "SELECT category, owner, event, source FROM (SELECT unnest(['stories', 'events', 'events', 'events', 'notes']) AS category, unnest(['@I' || id || '@', '@I' || id || '@', '@F' || id || '@', '@F' || id || '@', NULL]) AS owner, unnest([NULL, 'BIRT', NULL, 'MARR', NULL]) AS event, unnest([NULL, '@N' || id || '@', NULL, NULL, '@X' || id || '@']) AS source FROM people)")(lambda w: languages.note_rows(_nodes(_lines(w, _NOTED()))).select("category", "owner", "event", "source"))
_SPOKEN = lambda w: languages.detected(w.people.select("id", F.col("lang").alias("real"), F.concat_ws(" ", "given", "surname").alias("name")).join(_texts(w), "id"))


def _texts(w: World) -> DataFrame:
    from kinforge.sources import tables

    return tables.read(w.spark, w.dir, "documents").select(F.col("doc_id").alias("id"), "text")


query("languages_detected")(lambda w: _SPOKEN(w).groupBy("real", "lang").agg(F.count("*").alias("n")))
query("languages_names", "SELECT DISTINCT lang AS code, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE upper(left(lang, 1)) || substr(lang, 2) END AS name FROM people")(lambda w: w.people.select(F.col("lang").alias("code")).distinct().withColumn("name", languages.name_of(F.col("code"))))
