"""Commands over a small file, and the parts behind them that no query with SQL covers."""

import io
import itertools
import json

import pytest
from pyspark.sql import functions as F

from kinforge import cli
from kinforge.functions import dates
from kinforge.functions.metaphone import double_metaphone
from kinforge.operators import graph, linkage, search, transform
from kinforge.plans import catalog
from kinforge.sources import gedcom, tables, writer

FILE = """0 HEAD
1 SUBM @U1@
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Jöhn /Smith/
1 NAME Johnny /Schmidt/
1 SEX M
1 BIRT
2 DATE 12 JUNE 1850
2 PLAC Berlin, Prussia
1 FAMS @F1@
1 NOTE The house was built by his father and it is from the time of the
2 CONC  king
2 CONT and that was all
0 @I2@ INDI
1 NAME Mary /Jones/
1 SEX F
1 BIRT
2 DATE ABT 1855
1 DEAT
2 DATE 1920
1 FAMS @F1@
0 @I3@ INDI
1 NAME Anna /Smith/
1 SEX F
1 BIRT
2 DATE 3 MAR 1880
1 FAMC @F1@
1 _LIVING Y
0 @I4@ INDI
1 NAME Ann /Smith/
1 SEX F
1 BIRT
2 DATE 1880
1 FAMC @F1@
1 RESN locked
0 @I5@ INDI
1 NAME Lone /Wolf/
1 SEX M
0 @F1@ FAM
1 HUSB @I1@
1 WIFE @I2@
1 CHIL @I3@
1 CHIL @I4@
1 MARR
2 DATE 1875
1 RESN privacy
0 @N1@ NOTE Das Haus wurde von der Familie gebaut und ist nicht auf dem Land
0 TRLR
"""


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "t.ged").write_text(FILE)
    return f"file://{tmp_path}/t.ged"


def call(spark, *argv):
    out = io.StringIO()
    code = cli.run(["--format", "json", *argv], spark, out)
    return code, json.loads(out.getvalue())["sections"] if out.getvalue() else None


def test_validate(spark, tree):
    code, s = call(spark, "validate", tree)
    found = {(r["code"], r["line_no"]) for r in s["issues"]["rows"]}
    assert code == 0 and found == {("W004", 29), ("W010", 48), ("W014", 37)}  # the head's pointer is no usage
    broken = FILE.replace("1 CHIL @I4@", "1 CHIL @I9@").replace("2 DATE 1920", "2 DATE 1820").replace("0 @I5@", "0 @I3@")
    path = tree.removeprefix("file://").replace("t.ged", "broken.ged")
    open(path, "w").write(broken)
    code, s = call(spark, "validate", f"file://{path}")
    assert code == 1 and {r["code"] for r in s["issues"]["rows"]} >= {"E001", "E002", "E011", "W016"}


def test_stats_and_isolated(spark, tree):
    _, s = call(spark, "stats", tree, "--top", "2")
    assert s["surnames"]["rows"][0]["name"] == "Smith" and s["sexes"]["rows"][0] == {"male": 2, "female": 3, "unknown": 0}
    _, s = call(spark, "isolated", tree)
    assert [r["xref"] for r in s["isolated"]["rows"]] == ["@I5@"]


def test_search(spark, tree):
    names = lambda *q: [r["xref"] for r in call(spark, "search", tree, *q)[1]["people"]["rows"]]
    assert names("surname:schmidt") == ["@I1@"] and names("given=john") == ["@I1@"] and names("jö*n smith") == ["@I1@"] and names("jö*x") == []
    assert names("surname~Smyth") == ["@I1@", "@I3@", "@I4@"] and names("born:1855", "--fuzzy-dates", "2") == ["@I2@"]
    assert names("ancestor:@I1@") == ["@I3@", "@I4@"] and names("place:berlin") == ["@I1@"]
    assert names("surname~Smyth", "--phonetic", "metaphone") == ["@I1@", "@I3@", "@I4@"]
    assert cli.run(["search", tree, "nofield:x"], spark, io.StringIO()) == 1


def test_languages(spark, tree):
    _, s = call(spark, "languages", tree)
    assert {(r["language"], r["stories"], r["notes"]) for r in s["languages"]["rows"]} == {("en", 1, 0), ("de", 0, 1), ("all", 1, 1)}
    _, s = call(spark, "languages", tree, "--language", "english", "--show-text")
    assert s["English"]["rows"][0]["texts"] == ["The house was built by his father and it is from the time of the king and that was all"]


def test_linkage_commands(spark, tree, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "u.ged").write_text(FILE.replace("Anna /Smith/", "Anna /Smyth/"))
    _, s = call(spark, "compare", tree, f"file://{tmp_path}/b/u.ged", "--list-unique")
    pairs = {(r["xref_a"], r["xref_b"]) for r in s["matches"]["rows"]}
    assert {("@I1@", "@I1@"), ("@I2@", "@I2@")} <= pairs and s["only in the first"]["total"] == 5 - len(pairs)
    _, s = call(spark, "duplicates", tree, "--phonetic", "metaphone")
    assert {(r["xref_a"], r["xref_b"]) for r in s["matches"]["rows"]} == {("@I3@", "@I4@")}
    assert cli.run(["compare", tree, tree], spark, io.StringIO()) == 1 and cli.run(["duplicates", tree, "--certain", "0.1"], spark, io.StringIO()) == 1


def test_relationship(spark, tree):
    _, s = call(spark, "relationship", tree, "@I3@", "@I4@", "--type", "all")
    assert s["relationship"]["rows"][0]["sentence"] == "Ann Smith is a sister of Anna Smith."
    _, s = call(spark, "relationship", tree, "@I3@", "@I1@")
    assert s["relationship"]["rows"][0]["sentence"] == "Jöhn Smith is the father of Anna Smith."


def test_export(spark, tree, tmp_path):
    _, s = call(spark, "export", tree)
    assert s["individuals"]["rows"][0] == {"xref": "@I1@", "given": "Jöhn", "surname": "Smith", "suffix": "", "sex": "M", "birth_date": "12 JUNE 1850", "birth_year": 1850, "birth_place": "Berlin, Prussia", "death_date": "", "death_year": None, "death_place": "", "burial_date": "", "burial_place": "", "occupations": "", "source_count": 0, "famc_xref": "", "fams_xrefs": "@F1@"}
    _, s = call(spark, "export", tree, "--redact-living")
    assert [r["given"] for r in s["individuals"]["rows"]] == ["Jöhn", "Mary", "Living", "Living", "Living"]
    _, s = call(spark, "export", tree, "--table", "families")
    assert s["families"]["rows"] == [{"xref": "@F1@", "husband_xref": "@I1@", "husband_name": "Jöhn Smith", "wife_xref": "@I2@", "wife_name": "Mary Jones", "marriage_date": "1875", "marriage_year": 1875, "marriage_place": "", "child_count": 2, "children_xrefs": "@I3@;@I4@"}]
    _, s = call(spark, "export", tree, "--table", "families", "--redact-living")
    f = s["families"]["rows"][0]
    assert (f["husband_xref"], f["husband_name"], f["marriage_year"], f["child_count"], f["children_xrefs"]) == ("", "Living", None, 2, "")
    assert cli.run(["export", tree, "-o", f"file://{tmp_path}/out"], spark, io.StringIO()) == 0


def test_convert_and_back(spark, tree, tmp_path):
    for k, (target, source) in enumerate((("ANSEL", tree), ("UNICODE", f"file://{tmp_path}/c0"), ("UTF-8", f"file://{tmp_path}/c1"))):
        code, s = call(spark, "convert", source, "--to", target, "-o", f"file://{tmp_path}/c{k}", *(["--bom"] if target == "UNICODE" else []))
        assert code == 0 and s["files"]["rows"][0]["lines"] == FILE.count("\n")
    assert (tmp_path / "c2" / "t.ged").read_text() == FILE
    assert b"J\xe8ohn" in (tmp_path / "c0" / "t.ged").read_bytes()
    assert call(spark, "convert", tree, "--to", "ASCII", "-o", f"file://{tmp_path}/c3", "--dry-run")[0] == 0
    with pytest.raises(Exception, match="line 5"):
        cli.run(["convert", tree, "--to", "ASCII", "-o", f"file://{tmp_path}/c4"], spark, io.StringIO())
    with pytest.raises(Exception, match="FileExists|t.ged"):
        cli.run(["convert", tree, "-o", f"file://{tmp_path}/c2"], spark, io.StringIO())


def test_filter(spark, tree, tmp_path):
    code, _ = call(spark, "filter", tree, "--strip-notes", "--strip-custom-tags", "--strip-tag", "resn", "--strip-tag", "HEAD", "-o", f"file://{tmp_path}/f")
    kept = (tmp_path / "f" / "t.ged").read_text()
    gone = ("1 NOTE", "2 CONC", "2 CONT", "1 _LIVING", "1 RESN", "0 @N1@")
    assert code == 0 and kept == "".join(line for line in FILE.splitlines(True) if not line.startswith(gone))
    call(spark, "filter", tree, "--subtree", "@I3@", "--ancestors", "0", "--no-spouses", "-o", f"file://{tmp_path}/g")
    assert [x for x in (tmp_path / "g" / "t.ged").read_text().splitlines() if x.startswith("0")] == ["0 HEAD", "0 @I3@ INDI", "0 @F1@ FAM", "0 TRLR"]
    assert cli.run(["filter", tree, "-o", "x"], spark, io.StringIO()) == 1


def test_no_transform_gives_the_same_bytes(spark, tree, tmp_path):
    windows = tmp_path / "w" / "w.ged"
    windows.parent.mkdir()
    windows.write_bytes(FILE.replace("\n", "\r\n").encode())
    t = gedcom.read_lines(spark, f"file://{windows}")
    writer.write(t, f"file://{tmp_path}/same", ends=writer.line_ends(spark, f"file://{windows}")).collect()
    assert (tmp_path / "same" / "w.ged").read_bytes() == windows.read_bytes()


def test_bytes_that_do_not_decode(spark, tmp_path):
    (tmp_path / "bad.ged").write_bytes(b"0 HEAD\n1 NAME \xff\xfe\n0 TRLR\n")
    (tmp_path / "odd.ged").write_bytes(b"0 HEAD\n1 CHAR EBCDIC\n0 TRLR\n")
    (tmp_path / "none.ged").write_bytes(b"")
    got = {r["file"].rsplit("/", 1)[1]: r["code"] for r in gedcom.input_issues(spark, f"file://{tmp_path}").collect()}
    assert got == {"bad.ged": "E008", "odd.ged": "E008", "none.ged": "EMPTY"}


def test_encoding_names():
    assert [gedcom.codec_of(x) for x in ("ansel", "UTF8", "Windows-1252", "MACINTOSH", "ISO8859-1", "cp037", "base64", "nonsense")] == ["ansel", "utf-8", "cp1252", "mac-roman", "iso8859-1", None, None, None]
    assert gedcom.codec_of("cp037", declared=False) == "cp037"
    for word in ("über", "Łódź", "naïve Ærø", "plain"):
        assert gedcom.decode_ansel(gedcom.encode_ansel(word)) == __import__("unicodedata").normalize("NFD", word)


def test_double_metaphone_of_known_names():
    known = {"Smith": ("SM0", "XMT"), "Schmidt": ("XMT", "SMT"), "Thompson": ("TMPS", "TMPS"), "Catherine": ("K0RN", "KTRN"), "Knight": ("NT", "NT"), "Xavier": ("SF", "SFR"), "Jose": ("HS", "HS"), "Wagner": ("AKNR", "FKNR"), "Garcia": ("KRS", "KRX"), "Filipowicz": ("FLPT", "FLPF"), "Gerard": ("KRRT", "JRRT"), "McLaughlin": ("MKLF", "MKLF"), "Schenker": ("XNKR", "SKNK"), "Müller": ("MLR", "MLR"), "": ("", "")}
    assert {k: double_metaphone(k) for k in known} == known


def test_second_codes_give_more_blocks(spark):
    p = linkage.prepared(spark.createDataFrame([(1, "Anna", "Smith", "F", 1850, None, ""), (2, "Anna", "Schmidt", "F", 1852, None, "")], "id long, given string, surname string, sex string, birth_year int, death_year int, birth_place string"), "metaphone")
    keys = linkage.block_keys(p, "metaphone")
    assert {(r["a"], r["b"]) for r in linkage.candidates(keys.filter("pass > 4"), keys.filter("pass > 4"), same=True).collect()} == {(1, 2)}


def test_clean_phrases():
    good = ["30 November 1989", "12/2/1882", "1801-1875", "Sept. 1900"]
    bad = ["Census 1900 record", "1 1 1 1 1850", "1800 1801 1802", "0950", "", "1850 " * 60]
    assert all(dates.clean_phrase(x, 2026) for x in good) and not any(dates.clean_phrase(x, 2026) for x in bad)


def test_best_paths_equal_brute_force(spark):
    w = catalog.World(spark, "/root/testdata/sf0.001")
    up: dict = {}
    for r in w.parents.select("child", "parent").distinct().collect():
        up.setdefault(r["child"], set()).add(r["parent"])

    def depths(x):
        seen, front, d = {x: 0}, {x}, 0
        while front and d < 30:
            d += 1
            front = {p for y in front for p in up.get(y, ()) if p not in seen}
            seen |= dict.fromkeys(front, d)
        return seen

    couples = {(r["husb"], r["wife"]) for r in w.families.collect() if r["wife"] is not None}
    couples |= {(b, a) for a, b in couples}
    mine = depths(150)
    got: dict = {}
    for r in graph.relation_paths(w.people.filter("id = 150").select(F.col("id").alias("root")), w.people, w.parents, w.families).collect():
        got.setdefault(r["target"], {})[r["gp"], r["gt"]] = (sorted(r["ancestors"]), r["is_half"])
    for target in [x["id"] for x in w.people.collect()]:
        theirs = depths(target)
        common = set(mine) & set(theirs)
        assert bool(common) == (target in got)
        groups: dict = {}
        for x in common:
            groups.setdefault((mine[x], theirs[x]), set()).add(x)
        for key, (ancestors, half) in got.get(target, {}).items():
            assert groups[key] <= set(ancestors)
            gp, gt = key
            plain = False if 0 in key else len(groups[key]) < 2 if key == (1, 1) else not any((x, y) in couples for x, y in itertools.product(groups[key], common))
            assert half == plain


def test_search_parser_rules():
    assert search.parse("surname=A*")[0].wildcard is False and search.parse("surname:a.*", regex=True)
    with pytest.raises(search.QueryError):
        search.parse("surname:A*")


def test_tree_lines_of_large_families_do_not_collide(spark):
    people = tables.people(spark, "/root/testdata/sf0.001")
    kids = people.select(F.lit(3).cast("long").alias("fam"), F.col("id").alias("child"))
    fams = tables.families(spark, "/root/testdata/sf0.001")
    lines = gedcom.tree_lines(people, fams, kids, F.lit("one"))
    assert lines.count() == lines.select("line_no").distinct().count() and lines.filter("raw LIKE '1 CHIL%'").count() == people.count()


def test_tags_that_stay():
    assert transform.user_tags(["note", "head", "TRLR", "_X"]) == (["NOTE", "_X"], ["HEAD", "TRLR"])
