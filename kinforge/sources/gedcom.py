"""Family-tree text files as tables: lines, records, paths, individuals and families.

A line is ``level [@id@] tag [value]``; fields are separated by spaces. Lines that don't fit keep their
text and have level 0 and tag ``''``. Lines of one file are ordered by ``line_no``; a file is bounded
(``MAX_FILE_BYTES``), and so is a group of its lines.
"""

from __future__ import annotations

import codecs
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from kinforge.functions.dates import bounds, parse

MAX_FILE_BYTES, MAX_LINE_BYTES, MAX_DEPTH = 500 << 20, 255, 99
LINE = r"(?s)\A[ \t\x0b\f]*(\d{1,18}) +(?:(@[A-Za-z0-9][^@]*@) +)?([A-Za-z0-9_]+)(?: (.*))?\z"
POINTER = r"^@[^@#]+@$"
MAX_CHAIN = 4096
SPACING = 1 << 20
#: Names of the standard, then codecs that a file may name for itself (fixed values).
_CODECS = {"UTF-8": "utf-8", "ANSEL": "ansel", "ASCII": "ascii", "UNICODE": "utf-16-le", "UTF-16-LE": "utf-16-le", "UTF-16-BE": "utf-16-be"}
_DECLARED = {
    "utf-8", "ascii", "utf-16", "utf-16-le", "utf-16-be", "iso8859-1", "iso8859-2", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-7", "iso8859-8", "iso8859-9", "iso8859-10",
    "iso8859-11", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "cp1250", "cp1251", "cp1252", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "mac-roman", "koi8-r", "koi8-u",
}
#: ANSEL: marks stand before their letter; spacing signs map one to one.
_MARKS = dict(zip(range(0xE0, 0xFF), "̧̨̣̤̥̳̲̦̜̮̉̀́̂̃̄̆̇̈̌̊︠︡̋̐︢︣̕\u0000\u0000̓"))
_SIGNS = {0xA1: "Ł", 0xA2: "Ø", 0xA3: "Đ", 0xA4: "Þ", 0xA5: "Æ", 0xA6: "Œ", 0xA7: "ʹ", 0xA8: "·", 0xA9: "♭", 0xAA: "®", 0xAB: "±", 0xAC: "Ơ", 0xAD: "Ư", 0xAE: "ʼ", 0xB0: "ʻ", 0xB1: "ł", 0xB2: "ø", 0xB3: "đ", 0xB4: "þ", 0xB5: "æ", 0xB6: "œ", 0xB7: "ʺ", 0xB8: "ı", 0xB9: "£", 0xBA: "ð", 0xBC: "ơ", 0xBD: "ư", 0xC0: "°", 0xC1: "ℓ", 0xC2: "℗", 0xC3: "©", 0xC4: "♯", 0xC5: "¿", 0xC6: "¡", 0xCF: "ß"}


def decode_ansel(data: bytes) -> str:
    out, marks = [], ""
    for b in data:
        if b in _MARKS:
            marks += _MARKS[b].strip("\0")
            continue
        out.append((chr(b) if b < 0x80 else _SIGNS.get(b, "�")) + marks)
        marks = ""
    return "".join(out) + marks


def encode_ansel(text: str) -> bytes:
    """Marks before their letter; raises where a character has no sign."""
    signs, marks = {v: k for k, v in _SIGNS.items()}, {v: k for k, v in _MARKS.items() if v != "\0"}
    out = bytearray()
    letter = 0
    for k, c in enumerate(unicodedata.normalize("NFD", text)):
        if c in marks:
            out[letter:letter] = bytes([marks[c]])
            letter += 1
            continue
        letter = len(out)
        if ord(c) < 0x80:
            out.append(ord(c))
        elif c in signs:
            out.append(signs[c])
        else:
            raise UnicodeEncodeError("ansel", text, min(k, len(text) - 1), min(k, len(text) - 1) + 1, "no such sign")
    return bytes(out)


def codec_of(name: str, declared: bool = True) -> str | None:
    """The codec that an encoding's name means; none where it is unknown, or a file must not name it for itself."""
    known = _CODECS.get(name.strip().upper())
    if known:
        return known
    try:
        found = codecs.lookup(name.strip())
    except (LookupError, ValueError):
        return None
    if not found._is_text_encoding:
        return None
    canonical = found.name.replace("_", "-")
    return canonical if not declared or canonical in _DECLARED else None


def detect(head: bytes) -> tuple[str, bool]:
    """Encoding and whether there is a byte order mark: the mark, then the header's CHAR, then UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if head.startswith(mark):
            return name, True
    for line in head[: 1 << 16].replace(b"\r", b"\n").split(b"\n")[:-1] or [head]:
        f = line.strip().split(b" ", 2)
        if len(f) > 1 and f[0] == b"0" and f[1] != b"HEAD":
            break
        if len(f) > 2 and f[0] == b"1" and f[1] == b"CHAR":
            name = f[2].strip().decode("ascii", "replace").upper()
            return codec_of(name) or f"unknown:{name}", False
    return "utf-8", False


def decoded(content: bytes, name: str | None = None) -> tuple[str, str, str | None]:
    """(text, codec, code) of a file's bytes: code is E008 where they don't decode, and the text then has marks for what is lost.

    ``name``: the encoding to read by, whatever the file says.
    """
    found, marked = detect(content)
    codec = codec_of(name, declared=False) if name else found
    bad = codec is None or codec.startswith("unknown:")
    codec = "utf-8" if bad else codec
    if codec == "ansel":
        text = decode_ansel(content)
    else:
        try:
            text = bytes(content).decode(codec)
        except UnicodeDecodeError:
            text, bad = bytes(content).decode(codec, "replace"), True
    return text[1:] if marked and text.startswith("\ufeff") else text, codec, "E008" if bad or "\ufffd" in text and codec == "ansel" else None


def _sizes(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and bytes of the files that ``path`` means; readers leave out empty ones."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jpath)
    if not found:
        raise ValueError(f"no such file: {path}")
    files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    return [(f.getPath().toString(), f.getLen()) for f in files if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def input_issues(spark: SparkSession, path: str) -> DataFrame:
    """(file, code, detail) of files that can't be read as they are: too large, empty, or E008 where they don't decode."""
    every = spark.read.format("binaryFile").load(path)

    @F.pandas_udf(StringType())
    def code(content: pd.Series) -> pd.Series:
        return content.map(lambda b: decoded(b)[2])

    wrong = [(f, "EMPTY" if n == 0 else "TOO_LARGE", f"{n} bytes") for f, n in _sizes(spark, path) if n == 0 or n > MAX_FILE_BYTES]
    sizes = spark.createDataFrame(wrong, "file string, code string, detail string")
    rest = every.filter((F.col("length") <= MAX_FILE_BYTES) & (F.col("length") > 0)).withColumn("code", code("content")).filter("code IS NOT NULL")
    return sizes.union(rest.select(F.col("path").alias("file"), "code", F.lit("bytes that the encoding doesn't have").alias("detail")))


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(file, line_no, raw) of every file under ``path``; only CR, LF and CR LF end a line.

    ``encoding``: read by it, whatever a file says of itself. A file of more than ``MAX_FILE_BYTES`` is an error that names it, raised when the lines are read.
    """
    every = spark.read.format("binaryFile").load(path)
    files = every.filter(F.col("length") <= MAX_FILE_BYTES)
    says = F.concat(F.col("path"), F.lit(" has "), F.col("length"), F.lit(f" bytes, more than {MAX_FILE_BYTES}"))
    # a branch of its own, so that the content of such a file is never loaded
    refused = every.filter(F.col("length") > MAX_FILE_BYTES).filter(F.raise_error(says).cast("boolean"))

    @F.pandas_udf(StringType())
    def text(content: pd.Series) -> pd.Series:
        return content.map(lambda b: decoded(b, encoding)[0])

    lines = F.split(F.regexp_replace(text("content"), r"(\r\n|\r|\n)$", ""), r"\r\n|\r|\n")
    out = files.select(F.col("path").alias("file"), F.posexplode(lines).alias("k", "raw")).select("file", (F.col("k") + 1).cast("long").alias("line_no"), "raw")
    return out.union(refused.select(F.col("path").alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit("").alias("raw")))


def parse_lines(lines: DataFrame) -> DataFrame:
    """file, line_no, raw, level, xref, tag, value, is_pointer."""
    fits = F.col("raw").rlike(LINE)
    g = lambda k: F.nullif(F.regexp_extract("raw", LINE, k), F.lit(""))
    out = lines.withColumn("level", F.when(fits, F.regexp_extract("raw", LINE, 1).cast("long")).otherwise(0).cast("int"))
    out = out.withColumn("xref", g(2)).withColumn("tag", F.when(fits, F.regexp_extract("raw", LINE, 3)).otherwise("")).withColumn("value", g(4))
    return out.withColumn("is_pointer", F.coalesce(F.trim("value").rlike(POINTER), F.lit(False)))


#: Parts of a file that are gone through apart from each other.
PARTS = 64


def in_parts(lines: DataFrame) -> DataFrame:
    """With part: a number that grows with ``line_no``; a file's lines are dealt over ``PARTS`` parts of about the same size."""
    bounds = lines.groupBy("file").agg(F.percentile_approx("line_no", [k / PARTS for k in range(1, PARTS)], 10_000).alias("bounds"))
    return lines.join(F.broadcast(bounds), "file").select(*lines.columns, F.size(F.filter("bounds", lambda x: x < F.col("line_no"))).alias("part"))


def records(nodes: DataFrame) -> DataFrame:
    """With record_id (the line of the record's level-0 line), record_tag and record_xref.

    A file may be one task's work no more than its memory: each part looks for its own level-0 lines, and takes those
    before its first from the parts before it.
    """
    n = in_parts(nodes)
    start = (F.col("level") == 0) & (F.col("tag") != "")
    head = F.when(start, F.struct("line_no", "tag", "xref"))
    ends = n.groupBy("file", "part").agg(F.max_by(head, F.when(start, F.col("line_no"))).alias("end"))
    past = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select("file", "part", F.last("end", ignorenulls=True).over(past).alias("earlier"))
    own = F.last(head, ignorenulls=True).over(Window.partitionBy("file", "part").orderBy("line_no"))
    h = n.withColumn("h", own).join(F.broadcast(earlier), ["file", "part"], "left").withColumn("h", F.coalesce("h", "earlier"))
    return h.select(*nodes.columns, F.coalesce("h.line_no", "line_no").alias("record_id"), F.coalesce("h.tag", F.lit("")).alias("record_tag"), F.col("h.xref").alias("record_xref"))


@F.pandas_udf(ArrayType(StringType()))
def _chains(levels: pd.Series, tags: pd.Series) -> pd.Series:
    """For each record's lines: the tags above each and its own, joined by slashes."""
    out = []
    for ls, ts in zip(levels, tags):
        stack: list[tuple[int, str]] = []
        paths = []
        for level, tag in zip(ls, ts):
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, tag))
            paths.append("/".join(t for _, t in stack))
        out.append(paths)
    return pd.Series(out)


def paths(nodes: DataFrame) -> DataFrame:
    """With path: each line's tags from its record down, by the nearest earlier line of a lesser level."""
    row = F.struct("line_no", "level", "tag", "xref", "value", "is_pointer", "raw")
    r = nodes.groupBy("file", "record_id", "record_tag", "record_xref").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    r = r.withColumn("paths", _chains(F.transform("rows", lambda x: x["level"]), F.transform("rows", lambda x: x["tag"])))
    z = F.explode(F.arrays_zip("rows", "paths")).alias("z")
    return r.select("file", "record_id", "record_tag", "record_xref", z).select("file", "record_id", "record_tag", "record_xref", "z.rows.*", F.col("z.paths").alias("path"))


def _first(path: str, c: str = "value") -> Column:
    return F.min_by(c, F.when(F.col("path") == path, F.col("line_no")))


def individuals(nodes: DataFrame) -> DataFrame:
    """One row for each INDI record of :func:`paths` lines: names, sex, years, places, family links."""
    i = nodes.filter("record_tag = 'INDI'")
    g = i.groupBy("file", F.col("record_xref").alias("xref"), "record_id").agg(
        _first("INDI/NAME").alias("name"), F.max_by("value", F.when(F.col("path") == "INDI/NAME/GIVN", F.col("line_no"))).alias("givn"), F.max_by("value", F.when(F.col("path") == "INDI/NAME/SURN", F.col("line_no"))).alias("surn"),
        _first("INDI/SEX").alias("sex"), _first("INDI/BIRT/DATE").alias("birth_date"), _first("INDI/CHR/DATE").alias("chr_date"), _first("INDI/BIRT/PLAC").alias("birth_place"),
        _first("INDI/BAPM/DATE").alias("bapm_date"), _first("INDI/DEAT/DATE").alias("death_date"), _first("INDI/DEAT/PLAC").alias("death_place"), _first("INDI/BURI/DATE").alias("burial_date"), _first("INDI/FAMC").alias("famc"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("path") == "INDI/FAMS", F.struct("line_no", "value")))), lambda x: x["value"]).alias("fams"),
        F.count_if((F.col("tag") == "SOUR") & (F.col("level") > 0)).alias("source_count"), F.bool_or(F.col("path") == "INDI/NOTE").alias("has_note"),
    )
    part = lambda k: F.trim(F.regexp_extract(F.coalesce("name", F.lit("")), r"^([^/]*)(?:/([^/]*)/(.*))?$", k))
    birth, death, burial = parse(F.col("birth_date")), parse(F.col("death_date")), parse(F.col("burial_date"))
    return g.select("file", "xref", "record_id", F.coalesce("givn", part(1)).alias("given"), F.coalesce("surn", part(2)).alias("surname"), part(3).alias("suffix"), F.upper(F.coalesce("sex", F.lit(""))).alias("sex"), birth.alias("birth"), F.coalesce(birth["year"], parse(F.col("chr_date"))["year"], parse(F.col("bapm_date"))["year"]).alias("birth_year"), F.coalesce(death["year"], burial["year"]).alias("death_year"), burial.alias("burial"), F.coalesce("birth_place", F.lit("")).alias("birth_place"), F.coalesce("death_place", F.lit("")).alias("death_place"), "famc", "fams", "source_count", "has_note")


def family_rows(nodes: DataFrame) -> DataFrame:
    """One row for each FAM record: file, xref, husb, wife (the last of each), children, marriage_year."""
    f = nodes.filter("record_tag = 'FAM'")
    last = lambda p: F.max_by("value", F.when(F.col("path") == p, F.col("line_no")))
    kids = F.transform(F.array_sort(F.collect_list(F.when(F.col("path") == "FAM/CHIL", F.struct("line_no", "value")))), lambda x: x["value"])
    return f.groupBy("file", F.col("record_xref").alias("xref")).agg(F.min("record_id").alias("record_id"), last("FAM/HUSB").alias("husb"), last("FAM/WIFE").alias("wife"), kids.alias("children"), parse(_first("FAM/MARR/DATE"))["year"].alias("marriage_year"))


def usages(nodes: DataFrame) -> DataFrame:
    """(file, record_xref, target, line_no, path) of every pointer inside a record with an id."""
    return nodes.filter("is_pointer AND record_xref IS NOT NULL").select("file", "record_xref", F.trim("value").alias("target"), "line_no", "path")


def long_lines(lines: DataFrame, most: int = MAX_LINE_BYTES) -> DataFrame:
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if(F.octet_length("raw") > most).alias("long_lines"))


def structure(nodes: DataFrame) -> DataFrame:
    """(file, code, line_no): no HEAD (E005) or TRLR (E006), the first level jump (E003) and junk line (E004) of each file, every line that ends in white space (W002)."""
    w = Window.partitionBy("file").orderBy("line_no")
    n = nodes.withColumn("before", F.lag("level", 1, -1).over(w))
    first = lambda code, where: n.filter(where).groupBy("file").agg(F.min("line_no").alias("line_no")).select("file", F.lit(code).alias("code"), "line_no")
    lacks = n.groupBy("file").agg(F.bool_or(F.col("tag") == "HEAD").alias("head"), F.bool_or(F.col("tag") == "TRLR").alias("end"))
    none = lacks.select("file", F.explode(F.filter(F.array(F.when(~F.col("head"), "E005"), F.when(~F.col("end"), "E006")), lambda x: x.isNotNull())).alias("code"), F.lit(None).cast("long").alias("line_no"))
    spaces = n.filter(F.col("raw").rlike(r"\s\z")).select("file", F.lit("W002").alias("code"), "line_no")
    return none.unionByName(first("E003", "level > before + 1 AND tag <> ''")).unionByName(first("E004", "tag = '' AND trim(raw) <> ''")).unionByName(spaces)


def complete(nodes: DataFrame) -> DataFrame:
    """(file, ok): whether a file has both HEAD and TRLR, so that it may be written."""
    has = lambda tag: F.bool_or((F.col("tag") == tag) & (F.col("level") == 0))
    return nodes.groupBy("file").agg((has("HEAD") & has("TRLR")).alias("ok"))


def offsets(lines: DataFrame, end_bytes: int = 1) -> DataFrame:
    """Lines with ``offset``, the UTF-8 bytes of the file before each; ``end_bytes`` for each line's end.

    Each file's lines are summed in chunks first, so that no window holds more than a chunk's lines.
    """
    size = F.octet_length("raw") + end_bytes
    chunked = lines.withColumn("chunk", F.floor(F.col("line_no") / 10_000))
    per = chunked.groupBy("file", "chunk").agg(F.sum(size).alias("bytes"))
    before = F.sum("bytes").over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    base = per.select("file", "chunk", F.coalesce(before, F.lit(0)).alias("base"))
    within = F.sum(size).over(Window.partitionBy("file", "chunk").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    return chunked.withColumn("within", F.coalesce(within, F.lit(0))).join(base, ["file", "chunk"]).withColumn("offset", F.col("base") + F.col("within")).drop("chunk", "within", "base")


def line_at(located: DataFrame, places: DataFrame) -> DataFrame:
    """(file, place, line_no): the line of :func:`offsets` rows in which each byte of ``places`` (file, place) lies."""
    both = located.select("file", "offset", "line_no").unionByName(places.select("file", F.col("place").alias("offset"), F.lit(None).cast("long").alias("line_no")))
    last = F.last("line_no", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset", F.col("line_no").asc_nulls_last()))
    return both.withColumn("at", last).filter("line_no IS NULL").select("file", F.col("offset").alias("place"), F.col("at").alias("line_no"))


def chains(nodes: DataFrame) -> DataFrame:
    """(file, line_no, run): runs of CONC and CONT lines, by their first line and their number of lines."""
    w = Window.partitionBy("file").orderBy("line_no")
    more = F.col("tag").isin("CONC", "CONT")
    n = nodes.withColumn("more", more).withColumn("other", F.sum(F.when(F.col("more"), 0).otherwise(1)).over(w))
    return n.filter("more").groupBy("file", "other").agg(F.min("line_no").alias("line_no"), F.count("*").alias("run")).select("file", "line_no", "run")


def long_chains(nodes: DataFrame, most: int = MAX_CHAIN) -> DataFrame:
    """Chains that are longer than a value may be continued."""
    return chains(nodes).filter(F.col("run") > most)


def folded(nodes: DataFrame) -> DataFrame:
    """Lines with their whole ``value``: CONT lines below one go on in a new line, CONC lines at once; these lines go.

    A continuation belongs to the nearest line above it that is none; its record is that line's.
    """
    w = Window.partitionBy("file", "record_id").orderBy("line_no")
    more = F.col("tag").isin("CONC", "CONT") & (F.col("level") > 0)
    owner = F.last(F.when(~more, F.col("line_no")), ignorenulls=True).over(w)
    rows = nodes.withColumn("owner", F.coalesce(owner, F.col("line_no")))
    part = F.concat(F.when(F.col("tag") == "CONT", "\n").otherwise(""), F.coalesce("value", F.lit("")))
    parts = rows.filter(more).groupBy("file", "record_id", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", part.alias("part")))), lambda x: x["part"]), "").alias("rest"))
    whole = rows.filter(~more).join(parts, ["file", "record_id", "owner"], "left")
    return whole.withColumn("value", F.when(F.col("rest").isNotNull(), F.concat(F.coalesce("value", F.lit("")), F.col("rest"))).otherwise(F.col("value"))).select(*nodes.columns)


def dereferenced(nodes: DataFrame, tag: str) -> DataFrame:
    """Lines of ``tag`` below level 0 of :func:`folded` lines with ``text`` and ``source``: a pointer's target record is its text.

    source is null for text that stands in the line itself; a pointer to nothing has no text.
    """
    uses = nodes.filter((F.col("tag") == tag) & (F.col("level") > 0)).withColumn("source", F.when(F.col("is_pointer"), F.trim("value")))
    defined = nodes.filter((F.col("tag") == tag) & (F.col("level") == 0) & F.col("xref").isNotNull()).groupBy("file", F.col("xref").alias("source")).agg(F.min_by("value", "line_no").alias("text"))
    return uses.join(defined, ["file", "source"], "left").withColumn("text", F.when(F.col("source").isNotNull(), F.col("text")).otherwise(F.col("value")))


def raw_values(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """The value as written, of the lines (file, line_no) asked for."""
    return nodes.join(lines.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi").select("file", "line_no", F.regexp_extract("raw", LINE, 4).alias("value"))


def places(nodes: DataFrame) -> DataFrame:
    """(file, record_xref, place) of every place of people and families, at any depth down to 10."""
    return nodes.filter(F.col("record_tag").isin("INDI", "FAM") & (F.col("tag") == "PLAC") & (F.col("level") <= 10) & (F.trim(F.coalesce("value", F.lit(""))) != "")).select("file", "record_xref", F.col("value").alias("place"))


def alternate_names(nodes: DataFrame) -> DataFrame:
    """(file, xref, position, given, surname) of every NAME of a person behind the first."""
    names = nodes.filter("path = 'INDI/NAME'").withColumn("position", F.row_number().over(Window.partitionBy("file", "record_id").orderBy("line_no")) - 1).filter("position > 0")
    part = lambda k: F.trim(F.regexp_extract(F.coalesce("value", F.lit("")), r"^([^/]*)(?:/([^/]*)/(.*))?$", k))
    return names.select("file", F.col("record_xref").alias("xref"), "position", part(1).alias("given"), part(2).alias("surname"))


def markers(nodes: DataFrame) -> DataFrame:
    """(file, xref, living, restricted): whether a person's record says that they live, and whether a record is to be withheld.

    A RESN counts only with a value that withholds; tags of programs count by name, in any case of letters.
    """
    one = nodes.filter(F.col("record_tag").isin("INDI", "FAM") & (F.col("level") == 1) & F.col("record_xref").isNotNull())
    private = (F.upper("tag") == "RESN") & F.upper(F.trim(F.coalesce("value", F.lit("")))).isin("PRIVACY", "CONFIDENTIAL", "LOCKED")
    living = F.upper("tag").isin("_LVG", "_LIVING", "_LVNG", "_CONF_FLAG") | private
    return one.groupBy("file", F.col("record_xref").alias("xref")).agg(F.bool_or(living & (F.col("record_tag") == "INDI")).alias("living"), F.bool_or(private).alias("restricted"))


def life_evidence(nodes: DataFrame, this_year: int) -> DataFrame:
    """(file, xref, birth, death, burial): the years that tell who is living.

    birth is the greatest latest year of all births, christenings and baptisms; death and burial are
    evidence by either bound.
    """
    rows = nodes.filter(F.col("path").isin("INDI/BIRT/DATE", "INDI/CHR/DATE", "INDI/BAPM/DATE", "INDI/DEAT/DATE", "INDI/BURI/DATE")).withColumn("b", bounds(F.col("value"), this_year, liveness=True))
    year = lambda tags, c: F.max(F.when(F.col("path").isin(*(f"INDI/{t}/DATE" for t in tags)), c))
    either = F.coalesce("b.hi", "b.lo")
    found = rows.groupBy("file", F.col("record_xref").alias("xref")).agg(year(("BIRT", "CHR", "BAPM"), F.col("b.hi")).alias("birth"), year(("DEAT",), either).alias("death"), year(("BURI",), either).alias("burial"))
    everyone = nodes.filter("record_tag = 'INDI' AND level = 0").select("file", F.col("record_xref").alias("xref"))
    return everyone.join(found, ["file", "xref"], "left")


def tree_lines(people: DataFrame, families: DataFrame, children: DataFrame, file: Column) -> DataFrame:
    """(file, line_no, raw): people and families of tables written as such files, ``file`` chosen for each row.

    Line numbers grow within a file; they are spaced, ``SPACING`` to a record, more than a record may have lines.
    """
    i = lambda c: F.concat(F.lit("@I"), c, F.lit("@"))
    fam = lambda c: F.concat(F.lit("@F"), c, F.lit("@"))
    sides = families.select(F.col("id").alias("fam"), F.expr("stack(2, husb, wife) as id")).filter("id IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list("fam")).alias("spouse_of"))
    p = people.join(sides, "id", "left").withColumn("file", file)
    say = lambda text, *c: F.concat(F.lit(text), *c)
    rows = F.flatten(F.array(
        F.array(F.concat(F.lit("0 "), F.col("xref"), F.lit(" INDI")), say("1 NAME ", F.col("given"), F.lit(" /"), F.col("surname"), F.lit("/")), F.when(F.col("sex") != "", say("1 SEX ", F.col("sex"))), F.lit("1 BIRT"), F.concat(F.when(F.col("birth_approximate"), "2 DATE ABT ").otherwise("2 DATE "), F.col("birth_year")), say("2 PLAC ", F.col("birth_place")), F.when(F.col("death_year").isNotNull(), F.lit("1 DEAT")), say("2 DATE ", F.col("death_year")), say("1 FAMC ", fam(F.col("famc")))),
        F.coalesce(F.transform("spouse_of", lambda x: F.concat(F.lit("1 FAMS @F"), x, F.lit("@"))), F.array().cast("array<string>")),
        F.transform(F.when(F.col("source_count") > 0, F.sequence(F.lit(1), F.col("source_count"))).otherwise(F.array().cast("array<int>")), lambda k: F.concat(F.lit("1 SOUR @S"), k, F.lit("@"))),
    ))
    one = p.select("file", F.col("id").alias("n"), F.posexplode(F.filter(rows, lambda x: x.isNotNull())).alias("k", "raw"))
    kids = children.groupBy(F.col("fam").alias("id")).agg(F.array_sort(F.collect_list("child")).alias("kids"))
    f = families.join(kids, "id", "left").withColumn("file", file)
    rows = F.flatten(F.array(F.array(F.concat(F.lit("0 "), fam(F.col("id")), F.lit(" FAM")), say("1 HUSB ", i(F.col("husb"))), say("1 WIFE ", i(F.col("wife"))), F.when(F.col("marriage_year").isNotNull(), F.lit("1 MARR")), say("2 DATE ", F.col("marriage_year"))), F.coalesce(F.transform("kids", lambda x: F.concat(F.lit("1 CHIL @I"), x, F.lit("@"))), F.array().cast("array<string>"))))
    two = f.select("file", (F.col("id") + (1 << 38)).alias("n"), F.posexplode(F.filter(rows, lambda x: x.isNotNull())).alias("k", "raw"))
    return one.union(two).select("file", (F.col("n") * SPACING + F.col("k") + 1).cast("long").alias("line_no"), "raw")
