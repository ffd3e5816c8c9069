"""String functions: folding, phonetic codes, similarity, guards for output."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from math import fma

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Composed, decomposed, marks dropped, lowered: for comparing names."""
    def one(x: str) -> str:
        if x.isascii():
            return x.lower()
        return "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFC", x)) if unicodedata.category(c) != "Mn").lower()

    return s.map(one, na_action="ignore")


@F.pandas_udf(StringType())
def display_form(s: pd.Series) -> pd.Series:
    """Composed form, for showing."""
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def soundex(folded: Column) -> Column:
    """American Soundex of a folded name: other signs dropped first; H, W and Y are transparent, vowels separate."""
    letters = F.upper(F.regexp_replace(folded, r"[^\p{L}]", ""))
    digits = F.translate(letters, "BFPVCGJKQSXZDTLMNRAEIOUHWY", "11112222222233455600000")
    digits = F.regexp_replace(digits, "[^0-9]", "0")
    for d in "0123456":
        digits = F.regexp_replace(digits, f"{d}+", d)
    first = F.substring(letters, 1, 1)
    tail = F.when(first.isin("H", "W", "Y"), digits).otherwise(F.regexp_replace(digits, "^.", ""))
    tail = F.regexp_replace(tail, "0", "")
    return F.when(F.length(letters) == 0, "").otherwise(F.concat(first, F.rpad(F.substring(tail, 1, 3), 3, "0")))


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    if a == b:
        return 1.0
    span = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - span), min(len(b), i + span + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@lru_cache(maxsize=1 << 16)
def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return fma(same * 0.1, 1 - s, s)  # rounded once, as DuckDB's build does it: a last bit may decide how a total rounds


def _many(xs: list[str], ys: list[str]) -> np.ndarray:
    """:func:`jaro_winkler` of texts side by side, the same to the last bit; short ones all at once."""
    la, lb = (np.fromiter(map(len, t), np.int64, len(t)) for t in (xs, ys))
    least, most = np.minimum(la, lb), np.maximum(la, lb)
    out = np.empty(len(xs))
    for lo, hi in ((0, 12), (12, 40)):
        at = np.flatnonzero((least > 0) & (most > lo) & (most <= hi))
        if len(at):
            out[at] = _matched([xs[k] for k in at], [ys[k] for k in at], la[at], lb[at])
    for k in np.flatnonzero((least == 0) | (most > 40)):
        out[k] = jaro_winkler(xs[k], ys[k])
    return out


def _matched(xs: list[str], ys: list[str], la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, rows = len(xs), np.arange(len(xs))
    a, b = (np.array(t, dtype=f"U{w}").view(np.uint32).reshape(n, w) for t, w in ((xs, int(la.max())), (ys, int(lb.max()))))
    span, j = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None], np.arange(b.shape[1])
    free, found = j < lb[:, None], np.zeros(a.shape, bool)
    for i in range(a.shape[1]):
        fits = (b == a[:, i : i + 1]) & free & (j >= i - span) & (j <= i + span) & (i < la)[:, None]
        first = fits.argmax(1)
        hit = fits[rows, first]
        free[rows[hit], first[hit]] = False
        found[:, i] = hit
    taken = ~free & (j < lb[:, None])
    m = found.sum(1)
    in_order = []
    for signs, mask in ((a, found), (b, taken)):
        kept = np.zeros((n, max(int(m.max()), 1)), np.uint32)
        r, c = np.nonzero(mask)
        kept[r, (mask.cumsum(1) - 1)[r, c]] = signs[r, c]
        in_order.append(kept)
    swaps = (in_order[0] != in_order[1]).sum(1) // 2
    some = np.maximum(m, 1)
    s = np.where(m > 0, (m / la + m / lb + (m - swaps) / some) / 3, 0.0)
    w = min(4, a.shape[1], b.shape[1])
    same = np.cumprod((a[:, :w] == b[:, :w]) & (np.arange(w) < np.minimum(la, lb)[:, None]), axis=1).sum(1)
    more = np.flatnonzero((s > 0.7) & (same > 0))
    s[more] = list(map(fma, (same[more] * 0.1).tolist(), (1 - s[more]).tolist(), s[more].tolist()))
    return s


def _each(a: pa.Array, b: pa.Array, f: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """``f`` of texts without nulls side by side, taken once for each two different ones."""
    p, q = a.dictionary_encode(), b.dictionary_encode()
    wide = max(len(q.dictionary), 1)
    both, place = np.unique(p.indices.to_numpy().astype(np.int64) * wide + q.indices.to_numpy(), return_inverse=True)
    xs, ys = p.dictionary.to_pylist(), q.dictionary.to_pylist()
    return f([xs[k] for k in both // wide], [ys[k] for k in both % wide])[place]


def _filled(a: pa.Array, b: pa.Array, f: Callable[[list[str], list[str]], np.ndarray]) -> pa.Array:
    known = pc.and_(a.is_valid(), b.is_valid())
    out = np.zeros(len(a))
    at = known.to_numpy(zero_copy_only=False)
    if at.any():
        out[at] = _each(a.filter(known), b.filter(known), f)
    return pa.array(out, mask=~at)


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaro-Winkler of two folded strings; null if either is."""
    return _filled(a, b, _many)


@lru_cache(maxsize=1 << 16)
def _aligned(a: str, b: str) -> float:
    """Mean over the shorter list of place parts, in order, of each one's best part left in the other."""
    p, q = ([x.strip() for x in s.split(",") if x.strip()] for s in (a, b))
    if len(p) > len(q):
        p, q = q, p
    if not p:
        return 0.0
    total = 0.0
    for x in p:
        scores = [jaro_winkler(x, y) for y in q]
        k = max(range(len(q)), key=scores.__getitem__)
        total += scores[k]
        q.pop(k)
    return total / len(p)


@F.arrow_udf(DoubleType())
def place_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """How well the parts of the shorter of two folded places agree with the other's."""
    return _filled(a, b, lambda xs, ys: np.fromiter(map(_aligned, xs, ys), np.float64, len(xs)))


@F.arrow_udf(DoubleType())
def best_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Greatest Jaro-Winkler of a name in one list with a name in the other; null if either list is empty."""
    n, m = (pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in (a, b))
    u, v = a.flatten(), b.flatten()
    first, second, size = np.cumsum(n) - n, np.cumsum(m) - m, n * m
    row = np.repeat(np.arange(len(a)), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full(len(a), -1.0)
    if len(row):
        every = _each(u.take(pa.array(first[row] + nth // m[row])), v.take(pa.array(second[row] + nth % m[row])), _many)
        np.maximum.at(out, row, every)
    return pa.array(out, mask=size == 0)


def collapsed(value: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def xref_order(xref: Column) -> list[Column]:
    """Sort keys of ids: by letters, then by number; ids of another form first, by their text."""
    form = r"\A@([A-Za-z]*)(\d+)@"
    fits = xref.rlike(form)
    return [F.when(fits, F.regexp_extract(xref, form, 1)).otherwise(""), F.when(fits, F.regexp_extract(xref, form, 2).cast("decimal(38,0)")).otherwise(0), F.when(fits, "").otherwise(xref)]


def display_name(given: Column, surname: Column, suffix: Column | None = None, xref: Column | None = None) -> Column:
    """Given name and surname, the suffix where there is one; with ``xref``, someone without a name by their id."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (given, surname, suffix) if c is not None]
    name = F.concat_ws(" ", *parts)
    return name if xref is None else F.when(name == "", F.concat(F.lit("[Unknown] ("), xref, F.lit(")"))).otherwise(name)


def sex_of(value: Column, style: str) -> Column:
    """A SEX line's value as a command takes it: ``upper``, ``trimmed`` or both (``plain``); ``binary``: M, F or nothing."""
    value = F.coalesce(value, F.lit(""))
    if style == "upper":
        return F.upper(value)
    if style == "trimmed":
        return F.trim(value)
    plain = F.upper(F.trim(value))
    return plain if style == "plain" else F.when(plain.isin("M", "F"), plain).otherwise("")


def formula_guard(value: Column) -> Column:
    """An apostrophe before what a spreadsheet would take for a formula, white space and control signs skipped."""
    return F.when(value.rlike(r"^[\s\p{Cc}\p{Cf}&&[^\t\r]]*[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def scrub(value: Column) -> Column:
    """Without terminal escapes, control signs and marks of direction."""
    value = F.regexp_replace(value, "\u001b\\[[0-?]*[ -/]*[@-~]", "")
    return F.regexp_replace(value, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f\\u200e\\u200f\\u202a-\\u202e\\u2066-\\u2069]", "")


def one_line(value: Column) -> Column:
    return F.trim(F.regexp_replace(scrub(value), r"\s+", " "))


def bounded(value: Column, most: int) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 3), F.lit("..."))).otherwise(value)


def place_parts(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda x: x != "")


def ordinal(n: Column) -> Column:
    suffix = F.when((F.pmod(n, F.lit(100)) >= 11) & (F.pmod(n, F.lit(100)) <= 13), "th").when(F.pmod(n, F.lit(10)) == 1, "st").when(F.pmod(n, F.lit(10)) == 2, "nd").when(F.pmod(n, F.lit(10)) == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)
