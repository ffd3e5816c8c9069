"""What each validation code means, and how a contradiction between uncertain years is put into words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEANING = {
    "E001": "points to a record that does not exist", "E002": "the id is defined again", "E003": "a level too deep", "E004": "not a line of such a file", "E005": "no HEAD", "E006": "no TRLR", "E007": "a record behind TRLR", "E008": "bytes that the encoding does not have",
    "E010": "someone is their own ancestor", "E011": "death before birth", "E012": "born before a parent", "E013": "the header lacks GEDC", "E014": "the header lacks GEDC/VERS", "E015": "the header lacks SOUR", "E016": "the header lacks CHAR",
    "W002": "white space at the end of a line", "W003": "a line of more than 255 bytes", "W004": "a custom tag", "W005": "the header lacks SUBM", "W010": "a note that nothing points to", "W011": "media that nothing points to", "W012": "a source that nothing points to", "W013": "a repository that nothing points to",
    "W014": "a person without family", "W015": "a family without members", "W016": "a child's link that the other side lacks", "W017": "a spouse's link that the other side lacks", "W020": "a parent under 12 years", "W021": "a mother over 80 years", "W022": "a father over 80 years", "W023": "a life of more than 120 years",
    "W024": "married before birth", "W025": "a child before the marriage", "W026": "siblings less than 9 months apart", "W027": "more than one SEX", "W028": "a SEX that is none of M, F, U and X", "W029": "a husband who is F or a wife who is M", "W030": "ANSEL, which 5.5.5 does not allow", "W031": "another version than the one asked for",
    "W032": "a line of more than 255 bytes, which the version does not allow", "W033": "media without a file", "W034": "a media file without a form", "W035": "not a date of such a file", "W036": "burial before death or birth",
}


def meaning(code: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in MEANING.items() for x in pair))[code]


def bound(lo: Column, hi: Column, latest: bool) -> Column:
    """A year that a check used: as it is where it is sure, else as a bound."""
    words = "no later than " if latest else "no earlier than "
    year = hi if latest else lo
    return F.when(F.coalesce(lo == hi, F.lit(False)), year.cast("string")).otherwise(F.concat(F.lit(words), year.cast("string")))
