"""Date values of family-tree files: kind, bounds, month and precision, read in Arrow batches, and column functions of years.

A value is a qualifier and one or two dates. Each date has an optional calendar escape, day, month and
year; a dual year (1723/24) means its second number, B.C. years are negative, Hebrew and French
Republican years are turned into the Gregorian years in which they can lie.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_HEBREW = ["TSH", "CSH", "KSL", "TVT", "SHV", "ADR", "ADS", "NSN", "IYR", "SVN", "TMZ", "AAV", "ELL"]
_FRENCH = ["VEND", "BRUM", "FRIM", "NIVO", "PLUV", "VENT", "GERM", "FLOR", "PRAI", "MESS", "THER", "FRUC", "COMP"]
_DATE = r"(?:@#D([A-Z ]+)@\s*)?(?:(?:(\d{1,2})\s+)?([A-Z]{3,4})\s+)?(\d{1,4})(?:/(\d{1,4}))?(\s*B\.?C\.?)?"
FLOOR_YEAR, MAX_TEXT = 1000, 255
#: Full month names that stand for a month without further ado; others make a value a phrase.
LONG_MONTHS = {"JUNE": "JUN", "JULY": "JUL", "SEPT": "SEP"}
_MONTH_WORD = r"(?:JAN(?:UARY)?|FEB(?:RUARY)?|MAR(?:CH)?|APR(?:IL)?|MAY|JUNE?|JULY?|AUG(?:UST)?|SEPT?(?:EMBER)?|OCT(?:OBER)?|NOV(?:EMBER)?|DEC(?:EMBER)?)"


def _hebrew_new_year(year: int) -> int:
    """Days from the calendar's first day to 1 Tishri of ``year``: the mean new moon, put off by the four rules."""

    def elapsed(y: int) -> int:
        months = (235 * y - 234) // 19
        days = 29 * months + (12084 + 13753 * months) // 25920
        return days + (3 * (days + 1) % 7 < 3)

    before, here, after = elapsed(year - 1), elapsed(year), elapsed(year + 1)
    return here + (2 if after - here == 356 else 1 if here - before == 382 else 0)


def _hebrew_months(year: int) -> dict[str, int]:
    """Each month's length, from Tishri on; the second Adar only in leap years."""
    size = _hebrew_new_year(year + 1) - _hebrew_new_year(year)
    leap = (7 * year + 1) % 19 < 7
    lengths = [30, 30 if size % 10 == 5 else 29, 29 if size % 10 == 3 else 30, 29, 30, 30 if leap else 29, 29 if leap else 0, 30, 29, 30, 29, 30, 29]
    return {m: n for m, n in zip(_HEBREW, lengths) if n}


def _gregorian_year_of(day: int) -> int:
    """Year of a day counted from 1 January of the year 1, which is day 1."""
    n400, d = divmod(day - 1, 146097)
    n100 = min(d // 36524, 3)
    d -= n100 * 36524
    n4, d = divmod(d, 1461)
    return 400 * n400 + 100 * n100 + 4 * n4 + min(d // 365, 3) + 1


def hebrew_year(year: int, month: str | None, day: int | None, latest: bool) -> int | None:
    """Gregorian year of a Hebrew date, at the end that is asked for where month or day are missing."""
    months = _hebrew_months(year) if year > 0 else {}
    month = month or ("ELL" if latest else "TSH")
    if month not in months:
        return None
    day = day or (months[month] if latest else 1)
    if day > months[month]:
        return None
    names = list(months)
    return _gregorian_year_of(_hebrew_new_year(year) - 1373427 + sum(months[m] for m in names[: names.index(month)]) + day - 1)


def french_year(year: int, month: str | None, day: int | None, latest: bool) -> int | None:
    """Gregorian year of a French Republican date; leap years are 3, 7, 11, 15, then those of a rule by centuries."""
    leap = year in (3, 7, 11) or year >= 15 and (year + 1) % 4 == 0 and ((year + 1) % 100 != 0 or (year + 1) % 400 == 0)
    month = month or ("COMP" if latest else "VEND")
    if year < 1 or month not in _FRENCH:
        return None
    size = 30 if month != "COMP" else 6 if leap else 5
    day = day or (size if latest else 1)
    if day > size:
        return None
    past = year - 1
    leaps = sum(y <= past for y in (3, 7, 11)) + (past + 1) // 4 - (past + 1) // 100 + (past + 1) // 400 - 3 if past >= 15 else sum(y <= past for y in (3, 7, 11))
    return _gregorian_year_of(654415 + 365 * past + leaps + 30 * _FRENCH.index(month) + day - 1)


def _half(text: str) -> dict:
    m = re.fullmatch(_DATE, text, re.ASCII)
    if not m:
        return {"ok": False, "year": None, "lo": None, "hi": None, "month": None, "day": None}
    calendar, day, month, digits, dual, bc = m[1] or "GREGORIAN", m[2], m[3], m[4], m[5], bool(m[6])
    year = last = int(digits)
    if dual:
        whole = 10 ** len(dual)
        last = year // whole * whole + int(dual) if len(dual) < len(digits) else int(dual)
        last += whole if last < year and len(dual) < len(digits) else 0
    names = {"HEBREW": _HEBREW, "FRENCH R": _FRENCH}.get(calendar, MONTHS)
    month = LONG_MONTHS.get(month, month) if names is MONTHS else month
    out = {"ok": (month is None or month in names) and (not dual or last - year == 1), "year": -year if bc else year, "lo": None, "hi": None, "month": None, "day": day}
    if not out["ok"]:
        return out
    last = -last if bc else last
    if calendar in ("HEBREW", "FRENCH R"):
        convert = hebrew_year if calendar == "HEBREW" else french_year
        out["lo"], out["hi"] = (convert(last, month, int(day) if day else None, x) for x in (False, True))
    else:
        out["lo"] = out["hi"] = last
        out["month"] = MONTHS.index(month) + 1 if month else None
    return out


def plausible_years(text: str, current_year: int) -> list[int]:
    """Four-digit runs of free text that can be years, in their order."""
    return [y for y in map(int, re.findall(r"\b(\d{4})\b", text, re.ASCII)) if FLOOR_YEAR <= y <= current_year + 1]


def clean_phrase(text: str | None, current_year: int) -> bool:
    """Whether free text is made of a date's parts only, with one or two years that can be meant."""
    if not text or len(text) > MAX_TEXT:
        return False
    tokens = re.findall(r"[^\s/\-.,]+", text)
    years = [t for t in tokens if re.fullmatch(r"\d{4}", t, re.ASCII)]
    small = [t for t in tokens if re.fullmatch(r"\d{1,2}", t, re.ASCII)]
    others = [t for t in tokens if t not in years and t not in small]
    plausible = all(FLOOR_YEAR <= int(y) <= current_year + 1 for y in years)
    return plausible and 1 <= len(years) <= 2 and len(small) <= 2 * len(years) and all(re.fullmatch(_MONTH_WORD, t, re.IGNORECASE) for t in others)


@lru_cache(maxsize=100_000)
def read_date(value: str | None, current_year: int) -> tuple:
    """(kind, year, lo, hi, month, precision, ok) of one value, as :func:`parse` gives it."""
    if value is None:
        return "SIMPLE", None, None, None, None, "missing", False
    v = value.strip(" ").upper()
    kind, first, last = "SIMPLE", v, v
    if m := re.fullmatch(r"BET\s+(.+)\s+AND\s+(.+)", v):
        kind, first, last = "BETWEEN", m[1], m[2]
    elif m := re.fullmatch(r"FROM\s+(.+)\s+TO\s+(.+)", v):
        kind, first, last = "PERIOD", m[1], m[2]
    elif m := re.fullmatch(r"(ABT|CAL|EST|BEF|AFT|FROM|TO|INT)\s+([^(]+?)\s*(?:\(.*\))?", v):
        kind, first, last = m[1], m[2], m[2]
    a, b = _half(first), _half(last)
    if not (a["ok"] and b["ok"]):
        runs = plausible_years(v, current_year)
        month = re.search(rf"\b{_MONTH_WORD}\b", v)
        named = MONTHS.index(month[0][:3]) + 1 if month else None
        if not runs:
            return "PHRASE", None, None, None, named, "missing", False
        return "PHRASE", runs[0], min(runs), max(runs), named, "approximate", False
    both = a["lo"] is not None and b["lo"] is not None and a["hi"] is not None and b["hi"] is not None
    lo = None if kind in ("BEF", "TO") or not both else min(a["lo"], b["lo"])
    hi = None if kind in ("AFT", "FROM") or not both else max(a["hi"], b["hi"])
    precision = "approximate" if kind != "SIMPLE" else "full" if a["day"] and a["month"] else "partial"
    return kind, a["year"], lo, hi, a["month"], precision, True


def trusted(value: str | None, current_year: int, phrases: bool, floor: int) -> tuple[int | None, int | None]:
    """(earliest, latest) year that a decision may rest on; null where the value states none or isn't to be trusted.

    Every half has to be readable and within ``floor`` and the next year. ``phrases``: free text made of a
    date's parts counts as well; otherwise it never does.
    """
    kind, _, lo, hi, _, _, ok = read_date(value, current_year)
    if not ok:
        return (lo, hi) if phrases and clean_phrase(value, current_year) else (None, None)
    v = value.strip(" ").upper()
    m = re.fullmatch(r"(?:BET\s+(.+)\s+AND|FROM\s+(.+)\s+TO)\s+(.+)", v)
    halves = [x for x in m.groups() if x] if m else [re.fullmatch(r"(?:(?:ABT|CAL|EST|BEF|AFT|FROM|TO|INT)\s+)?([^(]+?)\s*(?:\(.*\))?", v)[1]]
    for h in map(_half, halves):
        if h["lo"] is None or h["hi"] is None or h["lo"] < floor or h["hi"] > current_year + 1:
            return None, None
    return lo, hi


_PARSED = "kind string, year int, lo int, hi int, month int, precision string, ok boolean"


def parse(value: Column, current_year: int = 2026) -> Column:
    """struct(kind, year, lo, hi, month, precision, ok): the year as written, and what bounds it allows.

    AFT and FROM have no upper bound, BEF and TO no lower one; a phrase has the least and greatest of its
    plausible four-digit years; what can't be read has none. As one expression this outgrows what Spark
    compiles, so values go to Python in Arrow batches; repeated ones are read once.
    """

    @F.pandas_udf(_PARSED)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = [read_date(None if v is None or v != v else v, current_year) for v in values]
        out = pd.DataFrame(rows, columns=["kind", "year", "lo", "hi", "month", "precision", "ok"])
        return out.astype({c: "Int32" for c in ("year", "lo", "hi", "month")})

    return read(value)


def bounds(value: Column, current_year: int = 2026, liveness: bool = False) -> Column:
    """struct(lo, hi): the years that chronology checks may use, or with ``liveness`` those that tell who is living.

    Checks accept clean free text and any year from 1 on; liveness refuses free text and years before 1000.
    """

    @F.pandas_udf("lo int, hi int")
    def read(values: pd.Series) -> pd.DataFrame:
        known: dict = {}
        rows = []
        for v in values:
            v = None if v is None or v != v else v
            if v not in known:
                known[v] = trusted(v, current_year, not liveness, FLOOR_YEAR if liveness else 1)
            rows.append(known[v])
        return pd.DataFrame(rows, columns=["lo", "hi"]).astype("Int32")

    return read(value)


def canonical(value: Column) -> Column:
    """A date's text for export: one space between parts, marks and names in upper case; phrases as they are."""
    plain = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(parse(value)["ok"], F.upper(plain)).otherwise(plain)


def century(year: Column) -> Column:
    """``1850`` is of ``1800``; floors for years before Christ as well."""
    return (F.floor(year / 100) * 100).cast("string")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def year_closeness(a: Column, b: Column) -> Column:
    """A step function of the distance of two years."""
    d = F.abs(a - b)
    out = F.when(d == 0, 1.0)
    for most, score in ((1, 0.85), (2, 0.70), (3, 0.50), (5, 0.25), (7, 0.10), (10, 0.05)):
        out = out.when(d <= most, score)
    return F.when(d.isNotNull(), out.otherwise(0.0))
