"""A small search language, compiled to one predicate over individuals.

``field:value`` is a substring, ``field=value`` equality, ``field~value`` a phonetic match; words without
a field look at names. ``*`` and ``?`` are wildcards; ``born`` and ``died`` take a year or a range;
``ancestor`` and ``descendant`` take an id. All terms must hold.
"""

from __future__ import annotations

import re
import shlex
import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.functions.metaphone import codes_match, double_metaphone, metaphone
from kinforge.functions.text import fold, soundex
from kinforge.operators import graph

FIELDS = {"name", "given", "surname", "born", "died", "place", "sex", "ancestor", "descendant"}
NAMES = {"name", "given", "surname"}
YEARS = {"born": "birth_year", "died": "death_year"}
RELATIVES = {"ancestor", "descendant"}
LEAST_LITERALS, MOST_REGEX, MOST_NESTING = 3, 256, 3


class QueryError(ValueError):
    """A query that can't be run."""


@dataclass(frozen=True)
class Term:
    field: str
    operator: str
    value: str
    years: tuple[int, int] | None = None

    @property
    def wildcard(self) -> bool:
        """Marks stand for other characters only where a part of a text is sought; patterns don't ask."""
        return self.operator == ":" and ("*" in self.value or "?" in self.value)


def _years(value: str) -> tuple[int, int]:
    m = re.fullmatch(r"(\d{1,4})(?:-(\d{1,4}))?", value)
    if not m:
        raise QueryError(f"not a year or a range of years: {value}")
    lo = int(m[1])
    hi = int(m[2] or m[1])
    if hi < lo:
        raise QueryError(f"a range that runs backwards: {value}")
    return lo, hi


def parse(query: str, regex: bool = False) -> list[Term]:
    lexer = shlex.shlex(query, posix=True)
    lexer.whitespace_split, lexer.quotes, lexer.escape, lexer.commenters = True, '"', "", ""
    try:
        tokens = list(lexer)
    except ValueError as e:
        raise QueryError(str(e)) from None
    if not tokens:
        raise QueryError("an empty query")
    terms = []
    for token in tokens:
        at = next((k for k, c in enumerate(token) if c in ":=~"), -1)
        field, op, value = (token[:at].lower() or "name", token[at], token[at + 1 :]) if at >= 0 else ("name", ":", token)
        if field not in FIELDS:
            raise QueryError(f"no such field: {field}")
        if not value:
            raise QueryError(f"no value for {field}")
        if op == "~" and field not in NAMES:
            raise QueryError("only names can be matched by sound")
        if field == "sex" and len(value) != 1:
            raise QueryError("sex takes one letter")
        if field in RELATIVES and not re.fullmatch(r"@[A-Za-z0-9_]+@", value):
            raise QueryError(f"not an id: {value}")
        years = _years(value) if field in YEARS else None
        if years and op == "=" and years[0] != years[1]:
            raise QueryError("= takes a single year")
        term = Term(field, op, value, years)
        if field not in YEARS and field not in RELATIVES and term.wildcard and not regex and len(value.replace("*", "").replace("?", "")) < LEAST_LITERALS:
            raise QueryError(f"a wildcard needs {LEAST_LITERALS} other characters: {value}")
        terms.append(term)
    return terms


def check_regex(pattern: str) -> str:
    """Refuses patterns whose matching could blow up."""
    if len(pattern) > MOST_REGEX:
        raise QueryError("the pattern is too long")
    depth = deepest = 0
    for c in re.sub(r"\\.", "", pattern):
        depth += (c == "(") - (c == ")")
        deepest = max(deepest, depth)
    if deepest > MOST_NESTING:
        raise QueryError("the pattern is nested too deeply")
    if re.search(r"\([^()]*[+*}][^()]*\)[+*{]|\([^()]*\|[^()]*\)[+*{]", pattern):
        raise QueryError("the pattern repeats a repetition")
    try:
        re.compile(pattern)
    except re.error as e:
        raise QueryError(str(e)) from None
    return pattern


def _unmarked(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", text)) if unicodedata.category(c) != "Mn")


def prepared(people: DataFrame, phonetic: str = "soundex") -> DataFrame:
    """With folded names and places and phonetic codes, computed once for all terms.

    ``alternates`` (array of given, surname), where there is one, has further names of a person.
    """
    code = soundex if phonetic == "soundex" else lambda c: F.struct(metaphone(c)["first"].alias("first"), metaphone(c)["second"].alias("second"))
    out = people.withColumn("given_f", fold("given")).withColumn("surname_f", fold("surname")).withColumn("place_f", fold("birth_place"))
    out = out.withColumn("death_place_f", fold("death_place") if "death_place" in people.columns else F.lit(""))
    out = out.withColumn("name_f", F.trim(F.concat_ws(" ", "given_f", "surname_f")))
    out = out.withColumn("given_s", code(F.col("given_f"))).withColumn("surname_s", code(F.col("surname_f")))
    if "alternates" not in people.columns:
        return out.withColumn("others", F.array().cast(OTHERS))
    # one folded text for each further name, taken apart again: pandas functions don't go inside arrays
    mark = "\x1f"
    texts = F.array_join(F.transform("alternates", lambda x: F.concat(F.coalesce(x["given"], F.lit("")), F.lit("\x1e"), F.coalesce(x["surname"], F.lit("")))), mark)
    out = out.withColumn("others_f", F.when(F.size("alternates") > 0, F.split(fold(texts), mark)).otherwise(F.array().cast("array<string>")))
    split = lambda x: F.split(x, "\x1e")
    made = F.transform("others_f", lambda x: F.struct(split(x)[0].alias("given"), split(x)[1].alias("surname"), F.trim(F.concat_ws(" ", split(x)[0], split(x)[1])).alias("name")))
    return out.withColumn("others", F.coalesce(made, F.array().cast(OTHERS))).drop("others_f")


OTHERS = "array<struct<given:string,surname:string,name:string>>"


def _text(column: Column, term: Term, regex: bool) -> Column:
    """Whether a folded text fits a term, whose marks are dropped as the text's were."""
    needle = _unmarked(term.value).lower()
    if regex:
        check_regex(term.value)
        try:
            pattern = check_regex(_unmarked(term.value))
        except QueryError:
            pattern = term.value
        return column.rlike("(?iu)" + pattern)
    if term.wildcard:
        return column.like(re.sub(r"([\\%_])", r"\\\1", needle).replace("*", "%").replace("?", "_"))
    return column == F.lit(needle) if term.operator == "=" else F.contains(column, F.lit(needle))


def _codes(value: str, phonetic: str) -> Column:
    folded = F.lit(_unmarked(value).lower())
    if phonetic == "soundex":
        return soundex(folded)
    first, second = double_metaphone(value)
    return F.struct(F.lit(first).alias("first"), F.lit("" if second == first else second).alias("second"))


def found(term: Term, regex: bool = False, fuzzy: int = 0, phonetic: str = "soundex") -> Column:
    """What a term finds in a row of :func:`prepared`: the text that fits first, null if none does."""
    if term.field in YEARS:
        year = F.col(YEARS[term.field])
        wide = F.when(F.col("birth_approximate"), fuzzy).otherwise(0) if term.field == "born" else F.lit(0)
        return F.when(year.between(F.lit(term.years[0]) - wide, F.lit(term.years[1]) + wide), year.cast("string"))
    if term.field == "sex":
        return F.when(F.lower("sex") == term.value.lower(), F.col("sex"))
    full = F.trim(F.concat_ws(" ", "given", "surname"))
    own = {"name": full, "given": F.col("given"), "surname": F.col("surname")}
    if term.operator == "~":
        code = _codes(term.value, phonetic)
        same = (lambda c: (c == code) & (c != "")) if phonetic == "soundex" else (lambda c: codes_match(c, code))
        first = ["surname", "given"] if term.field == "name" else [term.field]
        if phonetic == "soundex":
            others = lambda x: reduce(lambda a, b: a | b, [same(soundex(x[f])) for f in first])
            rest = F.filter("others", others)
            shown = F.when(same(soundex(rest[0][first[0]])), rest[0][first[0]]).otherwise(rest[0][first[-1]])
            return F.coalesce(*(F.when(same(F.col(f"{f}_s")), own[f]) for f in first), F.when(F.size(rest) > 0, shown))
        return F.coalesce(*(F.when(same(F.col(f"{f}_s")), own[f]) for f in first))
    if term.field == "place":
        place = lambda c, f: F.when((F.col(f) != "") & _text(F.col(f), term, regex), F.col(c))
        return F.coalesce(place("birth_place", "place_f"), *([place("death_place", "death_place_f")]))
    fields = ["name", "given", "surname"] if term.field == "name" else [term.field]
    fits = lambda x: reduce(lambda a, b: a | b, [_text(x[f], term, regex) for f in fields])
    rest = F.filter("others", fits)
    shown = F.coalesce(*(F.when(_text(rest[0][f], term, regex), rest[0][f]) for f in fields))
    return F.coalesce(*(F.when(_text(F.col(f"{f}_f"), term, regex), own[f]) for f in fields), F.when(F.size(rest) > 0, shown))


def match_type(term: Term, regex: bool) -> str:
    if term.years and term.years[0] != term.years[1]:
        return "range"
    if term.operator == "=":
        return "exactly"
    if term.operator == "~":
        return "sounds_like"
    if term.field in YEARS or term.field == "sex":
        return "exactly"
    return "regex" if regex else "pattern" if term.wildcard else "contains"


def predicate(term: Term, regex: bool = False, fuzzy: int = 0, phonetic: str = "soundex") -> Column:
    """The condition of one term over :func:`prepared` rows."""
    return found(term, regex, fuzzy, phonetic).isNotNull()


def run(query: str, people: DataFrame, parents: DataFrame, regex: bool = False, fuzzy: int = 0, limit: int | None = None, phonetic: str = "soundex", matches: bool = False) -> DataFrame:
    """People for whom all terms hold, in file order; ``ancestor:x`` means those below x, ``descendant:x`` those above.

    ``matches`` adds what each term found: an array of field, operator, value, type and text.
    """
    terms = parse(query, regex)
    plain = [t for t in terms if t.field not in RELATIVES]
    if "death_place" not in people.columns and any(t.field == "place" for t in plain):
        people = people.withColumn("death_place", F.lit(""))
    out = prepared(people, phonetic)
    for t in plain:
        out = out.filter(predicate(t, regex, fuzzy, phonetic))
    for t in terms:
        if t.field in RELATIVES:
            root = people.filter(F.col("xref") == t.value).select(F.col("id").alias("root"))
            if not root.limit(1).count():
                raise QueryError(f"no such person: {t.value}")
            reach = graph.descendants(root, parents) if t.field == "ancestor" else graph.ancestors(root, parents)
            out = out.join(reach.filter("depth > 0").select("id"), "id", "left_semi")
    what = [F.struct(F.lit(t.field).alias("field"), F.lit(t.operator).alias("operator"), F.lit(t.value).alias("value"), F.lit(match_type(t, regex)).alias("type"), found(t, regex, fuzzy, phonetic).alias("text")) for t in plain]
    out = out.select(*people.columns, *([(F.array(*what) if what else F.array()).alias("matches")] if matches else []))
    return out.orderBy("id").limit(limit) if limit and limit > 0 else out


def page(results: DataFrame, limit: int | None) -> tuple[DataFrame, bool]:
    """The first ``limit`` results in file order, and whether there are more; all where it is 0, negative or none."""
    if not limit or limit < 0:
        return results.orderBy("id"), False
    more = results.orderBy("id").limit(limit + 1)
    return results.orderBy("id").limit(limit), more.count() > limit
