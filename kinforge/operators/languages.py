"""Languages of notes: where a note stands, what language it is in, and counts by both.

A note of a person is a story; one below an event of a person or family, or of a family itself, belongs to
an event; a note record that none of these points to stands for itself. Languages are told by script, and
in Latin and Cyrillic script by words that are frequent in one language; it is a rule of thumb, which
leaves short and mixed texts, and those of languages with much the same words, unknown.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinforge.functions.text import collapsed, display_form
from kinforge.sources import gedcom

CATEGORIES = ("notes", "stories", "events")
LEAST_LENGTH, FLOOR, MARGIN = 10, 0.4, 0.15
#: Tags below people and families that are no events (fixed values).
NO_EVENTS = {
    "INDI": ["NAME", "SEX", "NOTE", "FAMC", "FAMS", "SOUR", "OBJE", "CHAN", "RFN", "AFN", "REFN", "RIN", "ALIA", "ANCI", "DESI", "SUBM", "ASSO", "RESN"],
    "FAM": ["HUSB", "WIFE", "CHIL", "NCHI", "NOTE", "SOUR", "OBJE", "CHAN", "REFN", "RIN", "SUBM"],
}
NAMES = {
    "en": "English", "el": "Greek", "de": "German", "fr": "French", "it": "Italian", "es": "Spanish", "pt": "Portuguese", "nl": "Dutch", "pl": "Polish", "sv": "Swedish", "nb": "Norwegian Bokmal", "nn": "Norwegian Nynorsk", "da": "Danish",
    "fi": "Finnish", "hu": "Hungarian", "cs": "Czech", "ro": "Romanian", "ru": "Russian", "uk": "Ukrainian", "ar": "Arabic", "he": "Hebrew", "tr": "Turkish", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "la": "Latin",
}
#: Words that are frequent in a language (fixed values).
WORDS = {
    "en": "the of and to in is was for with that his her he she from at by were had",
    "de": "der die das und ist nicht ein eine mit von zu den dem im war wurde auf für sich",
    "fr": "le la les et est une des du dans que qui pour avec sur au il elle était fut",
    "it": "il di che è una per con non del della nel sono alla dei gli lo fu",
    "es": "el los las y que en una por con del su para se fue como al era",
    "pt": "o os as e que em uma por com do da no na para foi não ao",
    "nl": "de het een en van is dat niet op te zijn met voor werd was aan bij",
    "pl": "i w na z się nie do jest że był była od przez oraz po",
    "sv": "och att det som en är på av för med han hon den var i till",
    "nb": "og det som er på av for med han hun den ikke var ble fra",
    "nn": "og det som er på av for med han ho den ikkje var vart frå",
    "da": "og det som er på af for med han hun den ikke var blev fra",
    "fi": "ja on ei että se hän oli mutta kun myös sekä joka ovat",
    "hu": "a az és hogy nem egy is volt meg ez csak mint van",
    "cs": "a v na se je že by s z do byl byla ale jako",
    "ro": "și în de la cu nu este pe care un o din a fost",
    "ru": "и в не на он что с как это его она был была по",
    "uk": "і в не на він що з як це його вона був була по та",
    "tr": "ve bir bu da de için ile olarak çok daha olan gibi",
    "la": "et in est non ad cum ex qui sunt ut filius anno de natus",
}
#: Runs of letters, and of the few digits that Python takes for parts of words.
_RUNS = re.compile(r"[^\W\d_]+")
_SCRIPTS = {"el": r"\p{IsGreek}", "ar": r"\p{IsArabic}", "he": r"\p{IsHebrew}", "ko": r"\p{IsHangul}", "ja": r"[\p{IsHiragana}\p{IsKatakana}]", "zh": r"\p{IsHan}"}


def note_rows(nodes: DataFrame) -> DataFrame:
    """(file, category, owner, event, source, text) of every note of :func:`gedcom.paths` lines: owner is the person
    or family, event the tag above it, source the note record that a pointer means."""
    text = gedcom.dereferenced(gedcom.folded(nodes), "NOTE")
    parts = F.split("path", "/")
    below = F.when(F.size(parts) == 3, parts[1])
    is_event = below.isNotNull() & F.when(F.col("record_tag") == "INDI", ~below.isin(NO_EVENTS["INDI"])).otherwise(~below.isin(NO_EVENTS["FAM"]))
    direct = F.size(parts) == 2
    category = F.when((F.col("record_tag") == "INDI") & direct, "stories").when((F.col("record_tag") == "FAM") & direct, "events").when(F.col("record_tag").isin("INDI", "FAM") & is_event, "events")
    used = text.select("file", category.alias("category"), F.col("record_xref").alias("owner"), F.when(is_event, below).alias("event"), "source", "text").filter("category IS NOT NULL")
    defined = gedcom.folded(nodes).filter("tag = 'NOTE' AND level = 0 AND xref IS NOT NULL")
    alone = defined.join(used.select("file", F.col("source").alias("xref")), ["file", "xref"], "left_anti")
    none = F.lit(None).cast("string")
    alone = alone.select("file", F.lit("notes").alias("category"), none.alias("owner"), none.alias("event"), F.col("xref").alias("source"), F.col("value").alias("text"))
    return used.unionByName(alone).filter(F.trim(F.coalesce("text", F.lit(""))) != "")


@F.pandas_udf(StringType())
def _by_words(texts: pd.Series) -> pd.Series:
    """The language whose frequent words have a share of ``FLOOR`` of all such words and ``MARGIN`` more than the next; null if none has."""
    owners: dict[str, list[str]] = {}
    for code, words in WORDS.items():
        for w in set(words.split()):
            owners.setdefault(w, []).append(code)

    def one(text: str) -> str | None:
        found = _RUNS.findall(text)
        if not "".join(found).isalpha():  # digits that are no decimals count as parts of words there
            found = "".join(c if c.isalpha() else " " for c in text).split()
        claimed, own = 0, dict.fromkeys(WORDS, 0)
        for w, n in Counter(" ".join(found).lower().split(" ")).items():
            if w in owners:
                claimed += n
                for code in owners[w]:
                    own[code] += n
        (first, code), (second, _) = sorted(((n / max(claimed, 1), code) for code, n in own.items()), reverse=True)[:2]
        return code if first >= FLOOR and first - second >= MARGIN else None

    return texts.map(one, na_action="ignore")


def language_of(text: Column) -> Column:
    """The language of a composed text with letters: ``unknown`` where none owns a share of ``FLOOR`` of
    the words that any language owns, and ``MARGIN`` more than the next one. Each text is gone through once,
    and for scripts only if it has signs beyond Latin ones."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    share = lambda p: F.regexp_count(text, F.lit(f"[\\p{{L}}&&{p}]")) / letters
    scripts = [F.when(share(p) > 0.5 if code != "ja" else share(p) > 0.1, code) for code, p in [("ja", _SCRIPTS["ja"]), *((c, p) for c, p in _SCRIPTS.items() if c != "ja")]]
    return F.coalesce(F.when(text.rlike(r"[^\x{0}-\x{36F}]"), F.coalesce(*scripts)), _by_words(text), F.lit("unknown"))


def detected(notes: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """Rows of ``notes`` that have a text with ``lang``, null where it is shorter than ``least``."""
    plain = F.trim(display_form("text"))
    lang = F.when(F.length("plain") < least, F.lit(None).cast("string")).when(~F.col("plain").rlike(r"\p{L}"), "unknown").otherwise(language_of(F.col("plain")))
    return notes.filter("text IS NOT NULL").withColumn("plain", plain).withColumn("lang", lang).drop("plain")


def name_of(code: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    return F.coalesce(known[code], F.when(code == "unknown", "Unknown").otherwise(F.initcap(code)))


def resolve(language: str) -> str:
    """The code that a language's code or name means."""
    wanted = language.strip().lower()
    for code, name in NAMES.items():
        if wanted in (code, name.lower()):
            return code
    raise ValueError(f"no such language: {language}")


def matches(found: DataFrame, language: str, show_text: bool = False) -> DataFrame:
    """(category, owner, event, source) of the notes in a language, each once, with the texts if wanted."""
    rows = found.filter(F.col("lang") == resolve(language))
    keys = ["file", "category", "owner", "event", "source"]
    keys_of = F.when(F.col("category") == "notes", F.col("source"))
    rows = rows.withColumn("source", keys_of)
    texts = [F.array_sort(F.collect_list(collapsed(F.col("text")))).alias("texts")] if show_text else []
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *texts)


def distinct_languages(found: DataFrame) -> DataFrame:
    return found.filter("lang IS NOT NULL AND lang <> 'unknown'").agg(F.array_sort(F.collect_set("lang")).alias("languages"))


def matrix(notes: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """language, one count for each category, short, total; a row for all.

    ``short`` counts texts of fewer than ``least`` characters, which have no language; it is null but in the row for all.
    """
    short = F.col("note_length") < least
    counted = notes.filter(~short).groupBy("lang").pivot("category", list(CATEGORIES)).agg(F.count(F.lit(1)))
    rows = counted.select(F.col("lang").alias("language"), *(F.coalesce(c, F.lit(0)).alias(c) for c in CATEGORIES), F.lit(None).cast("long").alias("short"))
    total = notes.agg(*(F.count_if(~short & (F.col("category") == c)).alias(c) for c in CATEGORIES), F.count_if(short).alias("short")).select(F.lit("all").alias("language"), *CATEGORIES, "short")
    return rows.union(total).withColumn("total", sum((F.coalesce(F.col(c), F.lit(0)) for c in CATEGORIES), F.lit(0)))
