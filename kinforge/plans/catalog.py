"""Named queries over the analytic tables: one for each operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.functions import dates, text
from kinforge.operators import export, file_checks, graph, languages, linkage, search, stats, transform, validate
from kinforge.operators._lineage import cut
from kinforge.sources import gedcom, tables
from kinforge.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TODAY = 2000
LOST = 999_999


class World:
    """The tables that the queries read."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.people, self.families, self.children = (f(spark, sf_dir) for f in (tables.people, tables.families, tables.children))
        self.parents = tables.parent_edges(self.families, self.children)

    @property
    def bounds(self) -> DataFrame:
        """People with bounds of birth, death and burial; approximate births are two years wide on each side."""
        wide = F.when(F.col("birth_approximate"), 2).otherwise(0)
        return self.people.select("id", "sex", "birth_month", "birth_approximate", (F.col("birth_year") - wide).alias("birth_lo"), (F.col("birth_year") + wide).alias("birth_hi"), F.col("death_year").alias("death_lo"), (F.col("death_year") - F.when(F.col("id") % 13 == 0, 130).otherwise(0)).alias("death_hi"), (F.col("death_year") - F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("burial_hi"))

    @property
    def famc(self) -> DataFrame:
        """(id, fam): people's own links to their parents' family, some of them missing."""
        return self.people.filter("famc IS NOT NULL AND id % 17 <> 0").select("id", F.col("famc").alias("fam"))

    @property
    def fams(self) -> DataFrame:
        sides = self.families.select(F.expr("stack(2, husb, wife) as id"), F.col("id").alias("fam"))
        return sides.filter("id IS NOT NULL AND id % 19 <> 0")

    @property
    def usages(self) -> DataFrame:
        """(id, target): links to people, some to one that nobody defines."""
        sides = self.parents.select(F.col("fam").alias("id"), F.col("parent").alias("target"))
        lost = self.people.filter("id % 101 = 0").select("id", F.lit(LOST).cast("long").alias("target"))
        return sides.union(lost)

    @property
    def nodes(self) -> DataFrame:
        lines = gedcom.tree_lines(self.people, self.families, self.children, F.concat(F.lit("tree"), F.pmod(F.col("id"), F.lit(16))))
        return gedcom.paths(gedcom.records(gedcom.parse_lines(lines)))


_BOUNDS = """, bounds AS (
  SELECT id, sex, birth_month, birth_approximate, birth_year - w AS birth_lo, birth_year + w AS birth_hi, death_year AS death_lo,
    death_year - CASE WHEN id % 13 = 0 THEN 130 ELSE 0 END AS death_hi, death_year - CASE WHEN id % 11 = 0 THEN 1 ELSE 0 END AS burial_hi
  FROM (SELECT *, CASE WHEN birth_approximate THEN 2 ELSE 0 END AS w FROM people)
), famc AS (SELECT id, famc AS fam FROM people WHERE famc IS NOT NULL AND id % 17 <> 0
), sides AS (SELECT husb AS id, id AS fam FROM families UNION ALL SELECT wife, id FROM families WHERE wife IS NOT NULL
), fams AS (SELECT id, fam FROM sides WHERE id % 19 <> 0
), usages AS (SELECT fam AS id, parent AS target FROM parents UNION ALL SELECT id, 999999 FROM people WHERE id % 101 = 0)
"""
_FOLD = """, folded AS (
  SELECT *, lower(strip_accents(nfc_normalize(given))) AS given_f, lower(strip_accents(nfc_normalize(surname))) AS surname_f,
    lower(strip_accents(nfc_normalize(birth_place))) AS place_f FROM people
), searched AS (SELECT *, trim(CASE WHEN given_f = '' THEN surname_f ELSE given_f || ' ' || surname_f END) AS name_f FROM folded)
"""


def _soundex(x: str) -> str:
    letters = f"upper(regexp_replace(replace({x}, 'ß', 'ss'), '[^\\p{{L}}]', '', 'g'))"
    d = f"translate({letters}, 'BFPVCGJKQSXZDTLMNRAEIOUHWY', '11112222222233455600000')"
    d = f"regexp_replace({d}, '[^0-9]', '0', 'g')"
    for k in "0123456":
        d = f"regexp_replace({d}, '{k}+', '{k}', 'g')"
    tail = f"replace(CASE WHEN left({letters}, 1) IN ('H', 'W', 'Y') THEN {d} ELSE substr({d}, 2) END, '0', '')"
    return f"CASE WHEN {letters} = '' THEN '' ELSE left({letters}, 1) || rpad(left({tail}, 3), 3, '0') END"


_LINK = f""", coded AS (SELECT *, {_soundex('given_f')} AS given_code, {_soundex('surname_f')} AS surname_code FROM folded
), keys AS (
  SELECT id, pass, key FROM (
    SELECT id, 0 AS pass, nullif(surname_code, '') || '|' || (birth_year // 10 * 10) || 's' AS key FROM coded
    UNION ALL SELECT id, 1, nullif(surname_code, '') || '|' || (death_year // 10 * 10) || 's' FROM coded
    UNION ALL SELECT id, 2, nullif(given_code, '') || '|' || (birth_year // 10 * 10) || 's' FROM coded
    UNION ALL SELECT id, 3, birth_year || '|' || death_year FROM coded
    UNION ALL SELECT id, 4, nullif(surname_code, '') || '|' || nullif(given_code, '') FROM coded) WHERE key IS NOT NULL
), pairs AS (
  SELECT DISTINCT l.id AS a, r.id AS b FROM keys l JOIN keys r USING (pass, key)
  JOIN (SELECT pass, key FROM keys GROUP BY ALL HAVING count(*) <= 500) USING (pass, key) WHERE l.id < r.id)
"""
_BAND = "CASE WHEN {d} = 0 THEN 1.0 WHEN {d} <= 1 THEN 0.85 WHEN {d} <= 2 THEN 0.7 WHEN {d} <= 3 THEN 0.5 WHEN {d} <= 5 THEN 0.25 WHEN {d} <= 7 THEN 0.1 WHEN {d} <= 10 THEN 0.05 WHEN {d} IS NULL THEN NULL ELSE 0.0 END"


def query(name: str, sql: str | None = None, extra: str = "") -> Callable[[Callable[[World], DataFrame]], Callable]:
    def add(f: Callable[[World], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH RECURSIVE {tables.SQL.strip()}{extra} {sql}"
        return f

    return add


def _summary(x: str) -> str:
    return f"avg({x}) AS average, min({x}) AS minimum, max({x}) AS maximum, count({x}) AS n"


def _ranked(items: str, total: str, top: int) -> str:
    return f"""SELECT rank, name, count, round(100.0 * count / total.n, 1) AS percent FROM (
      SELECT name, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, min(first), name) AS rank FROM ({items}) GROUP BY name), (SELECT count(*) AS n FROM ({total})) total WHERE rank <= {top}"""


# --- descriptive statistics
query("scan_record_counts", "SELECT 'INDI' AS tag, count(*) AS n FROM people UNION ALL SELECT 'FAM', count(*) FROM families")(lambda w: stats.record_counts(w.people, w.families))
query("stats_gender", "SELECT count(*) FILTER (sex = 'M') AS male, count(*) FILTER (sex = 'F') AS female, count(*) FILTER (sex = '') AS unknown FROM people")(lambda w: stats.gender_counts(w.people))
query("stats_top_surnames", _ranked("SELECT surname AS name, id AS first FROM people WHERE surname <> ''", "FROM people", 10))(lambda w: stats.top_surnames(w.people, 10))
query("stats_top_lineages", _ranked("SELECT CASE WHEN surname = '' THEN 'Unknown' ELSE surname END AS name, id AS first FROM people", "FROM people", 10))(lambda w: stats.top_lineages(w.people, 10))
query("stats_top_places", _ranked("SELECT birth_place AS name, id AS first FROM people", "FROM people", 10))(lambda w: stats.top_places(w.people, 10))
query("stats_top_given_by_sex", """SELECT sex, rank, name, count, round(100.0 * count / n, 1) AS percent FROM (
  SELECT sex, given AS name, count(*) AS count, row_number() OVER (PARTITION BY sex ORDER BY count(*) DESC, min(id), given) AS rank FROM people WHERE sex <> '' AND given <> '' GROUP BY sex, given)
  JOIN (SELECT sex, count(*) AS n FROM people WHERE sex <> '' GROUP BY sex) USING (sex) WHERE rank <= 10""")(lambda w: stats.top_given_by_sex(w.people, 10))
query("stats_timeline", """SELECT min(birth_year) AS earliest_year, arg_min(id, birth_year * 10000000000 + id) AS earliest_id, max(birth_year) AS latest_year,
  arg_max(id, birth_year * 10000000000 - id) AS latest_id, max(birth_year) - min(birth_year) AS span FROM people""")(lambda w: stats.timeline(w.people))
query("stats_by_century", "SELECT CAST(birth_year // 100 * 100 AS VARCHAR) AS century, count(*) AS n FROM people GROUP BY 1")(lambda w: stats.by_century(w.people))
_SPANS = "(SELECT *, death_year - birth_year AS span FROM people WHERE death_year - birth_year BETWEEN 0 AND 120)"
query("stats_lifespan", f"SELECT {_summary('span')} FROM {_SPANS}")(lambda w: stats.lifespan(w.people))
query("stats_lifespan_by_century", f"SELECT CAST(birth_year // 100 * 100 AS VARCHAR) AS century, {_summary('span')} FROM {_SPANS} GROUP BY 1")(lambda w: stats.lifespan_by_century(w.people))
_KIDS = "(SELECT f.*, coalesce(n, 0) AS children FROM families f LEFT JOIN (SELECT fam, count(*) AS n FROM children GROUP BY 1) ON fam = id)"
query("stats_marriage", f"SELECT count(*) AS families, count(marriage_year) AS dated, count(*) - count(marriage_year) AS undated, avg(children) AS average_children FROM {_KIDS}")(lambda w: stats.marriages(w.families, w.children))
query("stats_largest_families", f"SELECT id, children FROM {_KIDS} WHERE children > 0 ORDER BY children DESC, id LIMIT 3")(lambda w: stats.largest_families(w.families, w.children))
query("stats_family_size_dist", f"""SELECT size, coalesce(n, 0) AS n FROM (SELECT unnest(['1', '2-3', '4-6', '7-9', '10+']) AS size) LEFT JOIN (
  SELECT CASE WHEN children = 1 THEN '1' WHEN children <= 3 THEN '2-3' WHEN children <= 6 THEN '4-6' WHEN children <= 9 THEN '7-9' ELSE '10+' END AS size, count(*) AS n FROM {_KIDS} WHERE children > 0 GROUP BY 1) USING (size)""")(lambda w: stats.family_sizes(w.families, w.children))
_FIRST = """(SELECT p.*, m.married - birth_year AS age FROM people p JOIN (SELECT s.id, min(marriage_year) AS married FROM sides s JOIN families f ON f.id = s.fam WHERE marriage_year IS NOT NULL GROUP BY 1) m ON m.id = p.id
  WHERE sex <> '' AND m.married - birth_year BETWEEN 12 AND 80)"""
query("stats_first_marriage_age", f"SELECT sex, {_summary('age')} FROM {_FIRST} GROUP BY sex", _BOUNDS)(lambda w: stats.first_marriage_age(w.people, w.families))
query("stats_first_marriage_by_century", f"SELECT sex, coalesce(century, 'all') AS century, {_summary('age')} FROM (SELECT *, CAST(birth_year // 100 * 100 AS VARCHAR) AS century FROM {_FIRST}) GROUP BY GROUPING SETS ((sex), (sex, century))", _BOUNDS)(lambda w: stats.first_marriage_by_century(w.people, w.families))
query("stats_first_child_age", f"""SELECT sex, {_summary('age')} FROM (SELECT p.sex, born - p.birth_year AS age FROM people p JOIN (
  SELECT parent, min(c.birth_year) AS born FROM parents JOIN people c ON c.id = child GROUP BY 1) ON parent = p.id WHERE p.sex <> '') WHERE age BETWEEN 12 AND 70 GROUP BY sex""")(lambda w: stats.first_child_age(w.people, w.parents))
query("stats_spouse_gap", f"SELECT {_summary('gap')} FROM (SELECT abs(h.birth_year - w.birth_year) AS gap FROM families f JOIN people h ON h.id = husb JOIN people w ON w.id = wife) WHERE gap <= 50")(lambda w: stats.spouse_gap(w.people, w.families))
query("stats_coverage", """SELECT fact, with_it, total - with_it AS without_it, round(100.0 * with_it / total, 1) AS percent FROM (
  SELECT count(*) AS total, unnest(['birth', 'death', 'source', 'note', 'occupation', 'living']) AS fact, unnest([count(birth_year), count(death_year), count(*) FILTER (source_count > 0), count(*) FILTER (note_length > 0),
  count(*) FILTER (occupation <> ''), count(*) FILTER (birth_year > 1890 AND death_year IS NULL)]) AS with_it FROM people)""")(lambda w: stats.coverage(w.people, TODAY))
query("stats_birth_month", "SELECT birth_month, count(*) AS n FROM people WHERE NOT birth_approximate GROUP BY 1")(lambda w: stats.birth_months(w.people))
query("stats_precision", "SELECT CASE WHEN birth_approximate THEN 'approximate' ELSE 'full' END AS precision, count(*) AS n FROM people GROUP BY 1")(lambda w: stats.precision_counts(w.people))
query("stats_source_depth", "SELECT avg(source_count) AS average, min(source_count) AS minimum, max(source_count) AS maximum FROM people")(lambda w: stats.source_depth(w.people))


# --- search
def _search(name: str, text_: str, where: str, **kw) -> None:
    query(name, f"SELECT id, given, surname, birth_year FROM searched WHERE {where}", _FOLD)(lambda w: search.run(text_, w.people, w.parents, **kw).select("id", "given", "surname", "birth_year"))


_search("search_contains", "surname:tion", "contains(surname_f, 'tion')")
_search("search_exact", "given=the", "given_f = 'the'")
_search("search_wildcard", "surname:th*er", "surname_f LIKE 'th%er'")
_search("search_regex", "surname:^(an|en).*d$", "regexp_matches(surname_f, '^(an|en).*d$')", regex=True)
_search("search_year_range", "born:1750-1800", "birth_year BETWEEN 1750 AND 1800")
_search("search_fuzzy_year", "born:1820", "birth_year BETWEEN 1820 - CASE WHEN birth_approximate THEN 5 ELSE 0 END AND 1820 + CASE WHEN birth_approximate THEN 5 ELSE 0 END", fuzzy=5)
_search("search_phonetic", "surname~tharan", f"{_soundex('surname_f')} = {_soundex(chr(39) + 'tharan' + chr(39))}")
_search("search_place", "place:src1", "contains(place_f, 'src1')")
_search("search_and", "name:an born:1700-1850 sex:f", "(contains(name_f, 'an')) AND birth_year BETWEEN 1700 AND 1850 AND sex = 'F'")
_UP = "up(id, depth) AS (SELECT CAST({root} AS BIGINT), 0 UNION SELECT parent, depth + 1 FROM up JOIN parents ON child = up.id WHERE depth < 50)"
_DOWN = "down(id, depth) AS (SELECT CAST({root} AS BIGINT), 0 UNION SELECT child, depth + 1 FROM down JOIN parents ON parent = down.id WHERE depth < 50)"
query("search_ancestor_set", "SELECT id, given, surname FROM people WHERE id IN (SELECT id FROM down WHERE depth > 0)", ", " + _DOWN.format(root=2))(lambda w: search.run("ancestor:@I2@", w.people, w.parents).select("id", "given", "surname"))
query("search_descendant_set", "SELECT id, given, surname FROM people WHERE id IN (SELECT id FROM up WHERE depth > 0)", ", " + _UP.format(root=180))(lambda w: search.run("descendant:@I180@", w.people, w.parents).select("id", "given", "surname"))
query("functions_soundex", f"SELECT id, surname_f AS folded, {_soundex('surname_f')} AS code FROM folded", _FOLD)(lambda w: w.people.select("id", text.fold("surname").alias("folded")).withColumn("code", text.soundex(F.col("folded"))))


# --- validation
def _check(name: str, sql: str, f: Callable[[World], DataFrame]) -> None:
    query(name, sql, _BOUNDS)(f)


_N = "CAST(NULL AS BIGINT) AS other"
_check("validate_unresolved", "SELECT 'E001' AS code, min(u.id) AS id, target AS other FROM usages u WHERE target NOT IN (SELECT id FROM people) GROUP BY target", lambda w: validate.unresolved(w.usages, w.people))
_check("validate_orphans", f"SELECT 'W012' AS code, id, {_N} FROM people WHERE id NOT IN (SELECT target FROM usages)", lambda w: validate.orphans(w.people, w.usages, "W012"))
_check("validate_unlinked", f"SELECT 'W014' AS code, id, {_N} FROM people WHERE id NOT IN (SELECT id FROM famc UNION ALL SELECT id FROM fams)", lambda w: validate.unlinked_people(w.people, w.famc, w.fams))
_check("validate_empty_family", f"SELECT 'W015' AS code, id, {_N} FROM (SELECT CASE WHEN id % 29 = 0 THEN id + 1000000 ELSE id END AS id, CASE WHEN id % 29 <> 0 THEN husb END AS husb, CASE WHEN id % 29 <> 0 THEN wife END AS wife FROM families) WHERE husb IS NULL AND wife IS NULL AND id NOT IN (SELECT fam FROM children)", lambda w: validate.empty_families(w.families.select(F.when(F.col("id") % 29 == 0, F.col("id") + 1_000_000).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 29 != 0, F.col("husb")).alias("husb"), F.when(F.col("id") % 29 != 0, F.col("wife")).alias("wife")), w.children))
_check("validate_asym_child", "SELECT 'W016' AS code, child AS id, fam AS other FROM (SELECT child, fam FROM children EXCEPT SELECT id, fam FROM famc)", lambda w: validate.asymmetric("W016", w.famc, w.children.select(F.col("child").alias("id"), "fam")))
_check("validate_asym_spouse", "SELECT 'W017' AS code, id, fam AS other FROM (SELECT id, fam FROM sides EXCEPT SELECT id, fam FROM fams)", lambda w: validate.asymmetric("W017", w.fams, w.families.select(F.expr("stack(2, husb, wife) as id"), F.col("id").alias("fam")).filter("id IS NOT NULL")))
_check("validate_duplicate_xref", "SELECT 'E002' AS code, id, line AS other FROM (SELECT id, line, row_number() OVER (PARTITION BY id ORDER BY line) AS n FROM (SELECT id - id % 50 % 2 AS id, id AS line FROM people)) WHERE n > 1", lambda w: validate.duplicate_ids(w.people.select((F.col("id") - F.col("id") % 50 % 2).alias("id"), F.col("id").alias("line"))))
_check("validate_death_before_birth", f"SELECT 'E011' AS code, id, {_N} FROM bounds WHERE death_hi < birth_lo", lambda w: validate.death_before_birth(w.bounds))
_check("validate_burial", f"SELECT 'W036' AS code, id, {_N} FROM bounds WHERE burial_hi < death_lo OR burial_hi < birth_lo", lambda w: validate.burial_order(w.bounds))
_check("validate_lifespan", f"SELECT 'W023' AS code, id, {_N} FROM bounds WHERE death_lo + CASE WHEN id % 7 = 0 THEN 60 ELSE 0 END - birth_hi > 120", lambda w: validate.long_lives(w.bounds.withColumn("death_lo", F.col("death_lo") + F.when(F.col("id") % 7 == 0, 60).otherwise(0))))
_check("validate_birth_before_parent", "SELECT 'E012' AS code, child AS id, parent AS other FROM parents JOIN bounds c ON c.id = child JOIN bounds p ON p.id = parent WHERE c.birth_hi < p.birth_lo", lambda w: validate.birth_before_parent(w.bounds, w.parents))
_check("validate_parent_age", """SELECT code, id, other FROM (SELECT CASE WHEN c.birth_hi - p.birth_lo BETWEEN 0 AND 11 THEN 'W020' WHEN c.birth_lo - p.birth_hi > 80 THEN CASE WHEN role = 'W' THEN 'W021' ELSE 'W022' END END AS code, child AS id, parent AS other
  FROM parents JOIN bounds c ON c.id = child JOIN bounds p ON p.id = parent) WHERE code IS NOT NULL""", lambda w: validate.parent_age(w.bounds, w.parents))
_check("validate_marriage_birth", "SELECT 'W024' AS code, s.id, fam AS other FROM sides s JOIN families f ON f.id = fam JOIN bounds b ON b.id = s.id WHERE marriage_year < birth_lo", lambda w: validate.marriage_before_birth(w.bounds, w.families))
_check("validate_child_before_marriage", "SELECT 'W025' AS code, child AS id, fam AS other FROM children JOIN families f ON f.id = fam JOIN bounds b ON b.id = child WHERE birth_hi < marriage_year", lambda w: validate.child_before_marriage(w.bounds, w.families, w.children))
_check("validate_sibling_spacing", """SELECT 'W026' AS code, child AS id, sibling AS other FROM (SELECT child, m, lag(m) OVER o AS b, lag(child) OVER o AS sibling FROM (SELECT fam, child, birth_lo * 12 + birth_month AS m FROM children JOIN bounds ON id = child WHERE birth_lo = birth_hi AND NOT birth_approximate)
  WINDOW o AS (PARTITION BY fam ORDER BY m, child)) WHERE m - b BETWEEN 1 AND 8""", lambda w: validate.sibling_spacing(w.bounds, w.children))
_check("validate_sex_role", "SELECT 'W029' AS code, p.id, fam AS other FROM (SELECT husb AS id, id AS fam, 'F' AS wrong FROM families UNION ALL SELECT wife, id, 'M' FROM families) s JOIN people p ON p.id = s.id WHERE sex = wrong", lambda w: validate.sex_roles(w.people, w.families))
_ALL_ISSUES = lambda w: validate.marriage_before_birth(w.bounds, w.families).union(validate.child_before_marriage(w.bounds, w.families, w.children)).union(validate.birth_before_parent(w.bounds, w.parents))
_check("validate_issue_cap", """SELECT code, id, other, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY id, other) AS rank, count(*) OVER (PARTITION BY code) AS total FROM (
  SELECT 'W024' AS code, s.id, fam AS other FROM sides s JOIN families f ON f.id = fam JOIN bounds b ON b.id = s.id WHERE marriage_year < birth_lo
  UNION ALL SELECT 'W025', child, fam FROM children JOIN families f ON f.id = fam JOIN bounds b ON b.id = child WHERE birth_hi < marriage_year
  UNION ALL SELECT 'E012', child, parent FROM parents JOIN bounds c ON c.id = child JOIN bounds p ON p.id = parent WHERE c.birth_hi < p.birth_lo)) WHERE rank <= 10""", lambda w: validate.capped(_ALL_ISSUES(w)))
query("validate_cycle_members", "SELECT DISTINCT s AS id FROM reach WHERE s = t", ", ring AS (SELECT child, parent FROM parents UNION SELECT 0, 20), reach(s, t) AS (SELECT child, parent FROM ring UNION SELECT s, parent FROM reach JOIN ring ON child = t)")(lambda w: graph.cycle_members(w.parents.select("child", "parent").union(w.spark.createDataFrame([(0, 20)], "child long, parent long"))))

# --- graph
_LINKS = ", members AS (SELECT id AS fam, husb AS m FROM families UNION ALL SELECT id, wife FROM families WHERE wife IS NOT NULL UNION ALL SELECT fam, child FROM children)"
_REACH = _LINKS + ", near AS (SELECT DISTINCT x.m AS a, y.m AS b FROM members x JOIN members y USING (fam)), reach(s, t) AS (SELECT a, b FROM near UNION SELECT s, b FROM reach JOIN near ON t = a)"
_COMPONENTS = "SELECT s AS id, least(s, min(t)) AS component FROM reach GROUP BY s UNION ALL SELECT id, id FROM people WHERE id NOT IN (SELECT s FROM reach)"
query("graph_components", _COMPONENTS, _REACH)(lambda w: graph.components(w.people, graph.family_links(w.families, w.children)))
query("graph_isolated", f"SELECT component, count(*) AS size, min(id) AS first, max(id) AS last FROM ({_COMPONENTS}) GROUP BY 1 HAVING count(*) <= 2", _REACH)(lambda w: graph.isolated(graph.components(w.people, graph.family_links(w.families, w.children))))
query("graph_ancestors_depth", "SELECT root, id, min(depth) AS depth FROM a GROUP BY 1, 2", ", a(root, id, depth) AS (SELECT id, id, 0 FROM people UNION SELECT root, parent, depth + 1 FROM a JOIN parents ON child = a.id WHERE depth < 50)")(lambda w: graph.ancestors(w.people.select(F.col("id").alias("root")), w.parents))
query("graph_descendants_depth", "SELECT id, min(depth) AS depth FROM down GROUP BY 1", ", " + _DOWN.format(root=1))(lambda w: graph.descendants(w.people.filter("id = 1").select(F.col("id").alias("root")), w.parents).select("id", "depth"))
query("graph_generation_depth", "SELECT id, max(depth) AS depth FROM g GROUP BY 1", ", g(id, depth) AS (SELECT id, 0 FROM people WHERE id NOT IN (SELECT child FROM parents) UNION SELECT child, depth + 1 FROM g JOIN parents ON parent = g.id)")(lambda w: graph.generation_depth(w.people, w.parents))
_REL = ", " + _UP.format(root=150) + ", ups AS (SELECT id AS ancestor, min(depth) AS gp FROM up GROUP BY 1), d(ancestor, target, gt) AS (SELECT ancestor, ancestor, 0 FROM ups UNION SELECT ancestor, child, gt + 1 FROM d JOIN parents ON parent = target WHERE gt < 30), shared AS (SELECT ancestor, target, gp, min(gt) AS gt FROM d JOIN ups USING (ancestor) GROUP BY ALL), best AS (SELECT *, rank() OVER (PARTITION BY target ORDER BY gp + gt, gp) AS r FROM shared)"
query("graph_common_ancestors", "SELECT target, gp, gt, count(DISTINCT ancestor) AS n FROM best WHERE r = 1 GROUP BY ALL", _REL)(lambda w: graph.relationships(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents).select("target", "gp", "gt", F.size("ancestors").cast("long").alias("n")))
query("graph_relationship_type", """SELECT target, CASE WHEN gp = 0 AND gt = 0 THEN 'same individual' WHEN gt = 0 AND gp = 1 THEN x1 WHEN gt = 0 THEN CASE WHEN gp - 2 > 1 THEN (gp - 2) || 'x great-' WHEN gp = 3 THEN 'great-' ELSE '' END || 'grand' || x1
  WHEN gp = 0 AND gt = 1 THEN x2 WHEN gp = 0 THEN CASE WHEN gt - 2 > 1 THEN (gt - 2) || 'x great-' WHEN gt = 3 THEN 'great-' ELSE '' END || 'grand' || x2 WHEN gp = 1 AND gt = 1 THEN x3
  WHEN gt = 1 THEN CASE WHEN gp - 2 > 1 THEN (gp - 2) || 'x great-' WHEN gp = 3 THEN 'great-' ELSE '' END || x4 WHEN gp = 1 THEN CASE WHEN gt - 2 > 1 THEN (gt - 2) || 'x great-' WHEN gt = 3 THEN 'great-' ELSE '' END || x5
  ELSE k || CASE WHEN k = 1 THEN 'st' WHEN k = 2 THEN 'nd' WHEN k = 3 THEN 'rd' ELSE 'th' END || ' cousin' || CASE abs(gp - gt) WHEN 0 THEN '' WHEN 1 THEN ' once removed' WHEN 2 THEN ' twice removed' ELSE ' ' || abs(gp - gt) || ' times removed' END END AS relation FROM (
  SELECT DISTINCT target, gp, gt, least(gp, gt) - 1 AS k, CASE sex WHEN 'M' THEN 'father' WHEN 'F' THEN 'mother' ELSE 'parent' END AS x1, CASE sex WHEN 'M' THEN 'son' WHEN 'F' THEN 'daughter' ELSE 'child' END AS x2, CASE sex WHEN 'M' THEN 'brother' WHEN 'F' THEN 'sister' ELSE 'sibling' END AS x3,
  CASE sex WHEN 'M' THEN 'uncle' WHEN 'F' THEN 'aunt' ELSE 'uncle/aunt' END AS x4, CASE sex WHEN 'M' THEN 'nephew' WHEN 'F' THEN 'niece' ELSE 'nephew/niece' END AS x5 FROM best JOIN people p ON p.id = target WHERE r = 1)""", _REL)(lambda w: graph.relationships(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents).select("target", "relation"))
query("graph_half_flag", "SELECT target, gp > 0 AND gt > 0 AND count(DISTINCT ancestor) < 2 AS is_half FROM best WHERE r = 1 GROUP BY target, gp, gt", _REL)(lambda w: graph.relationships(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents).select("target", "is_half"))

# --- linkage
_keys = lambda w: linkage.block_keys(linkage.prepared(w.people))
query("linkage_block_sizes", "SELECT pass, key, count(*) AS n FROM keys GROUP BY ALL", _FOLD + _LINK)(lambda w: linkage.block_sizes(_keys(w)))


def _pairs(w: World, more: list[str] | None = None, phonetic: str = "soundex", people: DataFrame | None = None) -> DataFrame:
    """Pairs of people with what :func:`linkage.prepared` says of both, or with the columns ``more`` as they stand."""
    people = w.people if people is None else people
    own = cut(people.select("id", "given", "surname", "sex", "birth_year", "death_year", "birth_place", "death_place")) if more else None
    p = cut(linkage.prepared(people if own is None else own, phonetic))
    keys, rows = linkage.block_keys(p, phonetic), p if own is None else own.select("id", *more)
    return linkage.candidates(keys, keys, same=True, left_rows=rows, right_rows=rows)


query("linkage_candidates", "SELECT a, b FROM pairs", _FOLD + _LINK)(lambda w: _pairs(w).select("a", "b"))
query("linkage_skipped_keys", "SELECT DISTINCT key FROM keys GROUP BY pass, key HAVING count(*) > 10", _FOLD + _LINK)(lambda w: linkage.skipped_keys(_keys(w), _keys(w), cap=10))
query("linkage_year_bands", f"SELECT a, b, {_BAND.format(d='abs(x.birth_year - y.birth_year)')} AS score FROM pairs JOIN people x ON x.id = a JOIN people y ON y.id = b", _FOLD + _LINK)(lambda w: _pairs(w).select("a", "b", dates.year_closeness(F.col("birth_year_a"), F.col("birth_year_b")).alias("score")))


def _scored(w: World) -> DataFrame:
    return linkage.classified(linkage.scores(_pairs(w)))


#: DuckDB compares bytes, the library code points: letters beyond ASCII that folding leaves become one byte each.
_one = lambda x: f"translate({x}, 'ßœæø', '\x01\x02\x03\x04')"
_NAMES = f"""SELECT a, b, round(CASE WHEN x.surname_f <> '' AND y.surname_f <> '' THEN jaro_winkler_similarity({_one('x.surname_f')}, {_one('y.surname_f')}) END, 4) AS surname, round(CASE WHEN x.given_f <> '' AND y.given_f <> '' THEN jaro_winkler_similarity({_one('x.given_f')}, {_one('y.given_f')}) END, 4) AS given,
  {_BAND.format(d='abs(x.death_year - y.death_year)')} AS death_year FROM pairs JOIN folded x ON x.id = a JOIN folded y ON y.id = b"""
query("linkage_scores", _NAMES, _FOLD + _LINK)(lambda w: _scored(w).select("a", "b", linkage.rounded(F.col("surname"), 4).alias("surname"), linkage.rounded(F.col("given"), 4).alias("given"), "death_year"))


def _two(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = cut(linkage.prepared(w.people))
    one, two = p.filter("id % 2 = 0"), p.filter("id % 2 = 1")
    pairs = linkage.candidates(linkage.block_keys(one), linkage.block_keys(two), left_rows=one, right_rows=two)
    return one, two, linkage.classified(linkage.scores(pairs)).filter("class <> 'non_match'")


query("linkage_diffs", """SELECT a, b, field, value_a, value_b FROM (SELECT a, b, unnest(['given', 'surname', 'sex', 'birth_year', 'death_year', 'birth_place', 'death_place']) AS field,
  unnest([x.given, x.surname, x.sex, coalesce(CAST(x.birth_year AS VARCHAR), '?'), coalesce(CAST(x.death_year AS VARCHAR), '?'), x.birth_place, x.death_place]) AS value_a, unnest([y.given, y.surname, y.sex, coalesce(CAST(y.birth_year AS VARCHAR), '?'), coalesce(CAST(y.death_year AS VARCHAR), '?'), y.birth_place, y.death_place]) AS value_b
  FROM pairs JOIN people x ON x.id = a JOIN people y ON y.id = b) WHERE value_a <> value_b""", _FOLD + _LINK)(lambda w: linkage.field_differences(_pairs(w, ["given", "surname", "sex", "birth_year", "death_year", "birth_place", "death_place"])))

# --- export
_LIVING = "CASE WHEN death_year IS NOT NULL THEN false ELSE 2000 - birth_year <= 110 END"
_IND = f"""SELECT p.id, given, surname, sex, birth_year, death_year, birth_place, occupation, source_count, famc, coalesce(s.fams, '') AS fams, {_LIVING} AS living FROM people p LEFT JOIN (SELECT id, string_agg('@F' || fam || '@', ';' ORDER BY fam) AS fams FROM sides GROUP BY 1) s ON s.id = p.id"""
query("export_individuals", _IND, _BOUNDS)(lambda w: export.individuals(w.people, w.families, TODAY))
query("export_living_flag", f"SELECT id, {_LIVING} AS living FROM people")(lambda w: export.individuals(w.people, w.families, TODAY).select("id", "living"))
_V = lambda c, other: f"CASE WHEN living THEN {other} ELSE {c} END AS {c}"
query("export_redacted", f"SELECT id, CASE WHEN living THEN 'Living' ELSE given END AS given, {_V('surname', chr(39) * 2)}, sex, {_V('birth_year', 'NULL')}, {_V('death_year', 'NULL')}, {_V('birth_place', chr(39) * 2)}, {_V('occupation', chr(39) * 2)}, source_count, {_V('famc', 'NULL')}, {_V('fams', chr(39) * 2)}, living FROM ({_IND})", _BOUNDS)(lambda w: export.redacted(export.individuals(w.people, w.families, TODAY)))
_NAME = "trim({x}.given || ' ' || {x}.surname)"
query("export_families", f"""SELECT f.id, coalesce({_NAME.format(x='h')}, '') AS husband, coalesce({_NAME.format(x='w')}, '') AS wife_name, marriage_year, coalesce(n, 0) AS child_count, coalesce(kids, '') AS children FROM families f LEFT JOIN people h ON h.id = husb LEFT JOIN people w ON w.id = wife
  LEFT JOIN (SELECT fam, count(*) AS n, string_agg('@I' || child || '@', ';' ORDER BY child) AS kids FROM children GROUP BY 1) ON fam = f.id""")(lambda w: export.families(w.families, w.children, w.people))
query("export_families_redacted", f"""SELECT f.id, CASE WHEN hl THEN '' ELSE coalesce({_NAME.format(x='h')}, '') END AS husband, CASE WHEN wl THEN '' ELSE coalesce({_NAME.format(x='w')}, '') END AS wife_name, CASE WHEN NOT hl AND NOT wl THEN marriage_year END AS marriage_year, coalesce(n, 0) AS child_count
  FROM (SELECT f.*, coalesce(a.living, false) AS hl, coalesce(b.living, false) AS wl FROM families f LEFT JOIN ({f'SELECT id, {_LIVING} AS living FROM people'}) a ON a.id = husb LEFT JOIN ({f'SELECT id, {_LIVING} AS living FROM people'}) b ON b.id = wife) f LEFT JOIN people h ON h.id = husb LEFT JOIN people w ON w.id = wife LEFT JOIN (SELECT fam, count(*) AS n FROM children GROUP BY 1) ON fam = f.id""")(lambda w: export.redacted_families(export.families(w.families, w.children, w.people), w.families, export.individuals(w.people, w.families, TODAY)))
query("export_csv_guard", "SELECT id, CASE WHEN regexp_matches(v, '^\\s*[=+@-]') THEN '''' || v ELSE v END AS value FROM (SELECT id, CASE id % 5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' ELSE '' END || given AS v FROM people)")(lambda w: w.people.select("id", F.concat(F.when(F.col("id") % 5 == 0, "=").when(F.col("id") % 5 == 1, " +").when(F.col("id") % 5 == 2, "@").otherwise(""), "given").alias("v")).select("id", text.formula_guard(F.col("v")).alias("value")))

# --- files
query("gedcom_record_counts", "SELECT file, tag, count(*) AS n FROM (SELECT 'tree' || id % 16 AS file, 'INDI' AS tag FROM people UNION ALL SELECT 'tree' || id % 16, 'FAM' FROM families) GROUP BY ALL")(lambda w: w.nodes.filter("level = 0").groupBy("file", F.col("record_tag").alias("tag")).agg(F.count("*").alias("n")))
_LINES = ", counted AS (SELECT id, 5 + CASE WHEN sex <> '' THEN 1 ELSE 0 END + CASE WHEN death_year IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN famc IS NOT NULL THEN 1 ELSE 0 END + source_count + (SELECT count(*) FROM (SELECT husb AS x FROM families UNION ALL SELECT wife FROM families) WHERE x = people.id) AS n FROM people)"
query("gedcom_parse_lines", "SELECT xref, count(*) AS n, CAST(max(level) AS INTEGER) AS deepest FROM (SELECT '@I' || id || '@' AS xref, 2 AS level, unnest(range(n)) FROM counted) GROUP BY 1", _LINES)(lambda w: w.nodes.filter("record_tag = 'INDI'").groupBy(F.col("record_xref").alias("xref")).agg(F.count("*").alias("n"), F.max("level").alias("deepest")))
query("gedcom_anc_tags", "SELECT 'INDI/BIRT/PLAC' AS path, count(*) AS n FROM people UNION ALL SELECT 'INDI/DEAT/DATE', count(death_year) FROM people UNION ALL SELECT 'FAM/CHIL', count(*) FROM children UNION ALL SELECT 'FAM/MARR/DATE', count(marriage_year) FROM families")(lambda w: w.nodes.filter(F.col("path").isin("INDI/BIRT/PLAC", "INDI/DEAT/DATE", "FAM/CHIL", "FAM/MARR/DATE")).groupBy("path").agg(F.count("*").alias("n")))
query("gedcom_people_roundtrip", "SELECT xref, given, surname, sex, birth_year, death_year, birth_place, '@F' || famc || '@' AS famc, CAST(source_count AS BIGINT) AS source_count FROM people")(lambda w: gedcom.individuals(w.nodes).select("xref", "given", "surname", "sex", "birth_year", "death_year", "birth_place", "famc", "source_count"))
query("gedcom_families_roundtrip", "SELECT '@F' || f.id || '@' AS xref, '@I' || husb || '@' AS husb, '@I' || wife || '@' AS wife, n AS children, marriage_year FROM families f JOIN (SELECT fam, count(*) AS n FROM children GROUP BY 1) ON fam = f.id")(lambda w: gedcom.family_rows(w.nodes).select("xref", "husb", "wife", F.size("children").cast("long").alias("children"), "marriage_year"))
query("gedcom_usages", "SELECT target, count(*) AS n FROM (SELECT '@F' || famc || '@' AS target FROM people WHERE famc IS NOT NULL UNION ALL SELECT '@I' || husb || '@' FROM families UNION ALL SELECT '@I' || wife || '@' FROM families WHERE wife IS NOT NULL UNION ALL SELECT '@I' || child || '@' FROM children UNION ALL SELECT '@F' || fam || '@' FROM sides UNION ALL SELECT '@S' || unnest(range(1, source_count + 1)) || '@' FROM people) GROUP BY 1", _BOUNDS)(lambda w: gedcom.usages(w.nodes).groupBy("target").agg(F.count("*").alias("n")))
query("gedcom_longlines")(lambda w: gedcom.long_lines(w.nodes, 40).select("file", "lines", "long_lines"))
# every third SEX line made one that no file may have
query("gedcom_file_checks", "SELECT 'tree' || (id % 16) AS file, 'W028' AS code, id * 1048576 + 3 AS line_no, xref FROM people WHERE sex <> '' AND id % 3 = 0 UNION ALL SELECT 'tree' || x, unnest(['E005', 'E006']), NULL, NULL FROM (SELECT unnest(range(16)) AS x)")(lambda w: file_checks.all_checks(w.nodes.withColumn("value", F.when((F.col("path") == "INDI/SEX") & (F.floor(F.col("line_no") / (1 << 20)) % 3 == 0), "Q").otherwise(F.col("value")))))
query("gedcom_structure", "SELECT 'tree' || x AS file, code FROM (SELECT unnest(range(16)) AS x), (SELECT unnest(['E005', 'E006']) AS code)")(lambda w: gedcom.structure(w.nodes).select("file", "code"))
query("transform_strip_sources", "SELECT count(*) AS n FROM (SELECT unnest(range(n - source_count)) FROM counted JOIN people USING (id))", _LINES)(lambda w: transform.strip_lines(transform.strip_records(w.nodes, ["FAM"]), ["SOUR"]).agg(F.count("*").alias("n")))
query("transform_subtree", "SELECT DISTINCT id FROM (SELECT id FROM core UNION SELECT wife FROM families JOIN core ON husb = core.id WHERE wife IS NOT NULL UNION SELECT husb FROM families JOIN core ON wife = core.id)", ", " + _UP.format(root=100) + ", " + _DOWN.format(root=100) + ", core AS (SELECT id FROM up WHERE depth <= 3 UNION SELECT id FROM down WHERE depth <= 2)")(lambda w: transform.subtree(w.people.filter("id = 100").select(F.col("id").alias("root")), w.parents, w.families, 3, 2))
query("transform_dangling", "SELECT 'tree' || fam % 16 AS file, count(*) AS n FROM children WHERE child % 2 = 0 AND child % 16 = fam % 16 GROUP BY 1")(lambda w: (lambda n: n.filter("tag = 'CHIL'").join(transform.strip_dangling(n, n.filter("record_tag = 'INDI' AND level = 0").select("file", F.col("record_xref").alias("xref")).filter(F.regexp_extract("xref", r"(\d+)", 1).cast("long") % 2 == 0)).filter("tag = 'CHIL'").select("file", "line_no"), ["file", "line_no"], "left_anti").groupBy("file").agg(F.count("*").alias("n")))(w.nodes))
query("transform_empty_families", "SELECT count(*) AS n FROM families")(lambda w: transform.strip_empty_families(w.nodes).filter("level = 0 AND record_tag = 'FAM'").agg(F.count("*").alias("n")))
_NOTES = "(SELECT lang, note_length, CASE id % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'stories' ELSE 'events' END AS category FROM people)"
query("languages_matrix", f"SELECT coalesce(lang, 'all') AS language, count(*) FILTER (category = 'notes') AS notes, count(*) FILTER (category = 'stories') AS stories, count(*) FILTER (category = 'events') AS events, CASE WHEN lang IS NULL THEN (SELECT count(*) FROM {_NOTES} WHERE note_length < 40) END AS short, count(*) AS total FROM {_NOTES} WHERE note_length >= 40 GROUP BY GROUPING SETS ((lang), ())")(lambda w: languages.matrix(w.people.select("lang", "note_length", F.when(F.col("id") % 3 == 0, "notes").when(F.col("id") % 3 == 1, "stories").otherwise("events").alias("category")), 40))

# --- sets and streams
query("setops_union_distinct", "SELECT id FROM famc UNION SELECT id FROM fams", _BOUNDS)(lambda w: w.famc.select("id").union(w.fams.select("id")).distinct())
query("setops_intersect", "SELECT id FROM famc INTERSECT SELECT id FROM fams", _BOUNDS)(lambda w: w.famc.select("id").intersect(w.fams.select("id")))
query("setops_except", "SELECT id FROM famc EXCEPT SELECT id FROM fams", _BOUNDS)(lambda w: w.famc.select("id").subtract(w.fams.select("id")))
query("stream_tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda w: streams.tumbling_counts(tables.read(w.spark, w.dir, "events")).withColumn("total", F.round("total", 4)))
query("window_session_events", """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
  SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")(lambda w: streams.sessions(tables.read(w.spark, w.dir, "events")))
