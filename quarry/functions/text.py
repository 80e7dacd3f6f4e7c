"""Normal forms and typed values of text, as expressions that stay in the JVM.

Each rule has a Python twin for the few strings that the driver handles, such as a query.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = "[̀-ͯ]+"


@cache
def _accents() -> tuple[str, str]:
    """Characters that decompose into one character and marks of U+0300-036F, and these characters."""
    pairs = []
    for code in range(0xC0, 0x1FFFF):
        c = chr(code)
        flat = re.sub(_MARKS, "", unicodedata.normalize("NFD", c)) if not 0xD800 <= code <= 0xDFFF else c
        if len(flat) == 1 and flat != c:
            pairs.append((c, flat))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), _MARKS, "")


def normalise(c: Column) -> Column:
    """Lower case, no accents, runs of other than letters and digits as one space, a space at both ends; '' if nothing is left."""
    flat = F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c.cast("string"), F.lit("")))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", "").otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def normal(s: object) -> str:
    """normalise of one string on the driver."""
    a, b = _accents()
    flat = re.sub(_MARKS, "", ("" if s is None else str(s)).translate(str.maketrans(a, b)))
    flat = regex.sub(r"[^\p{L}\p{N}]+", " ", flat.lower()).strip(" ")
    return f" {flat} " if flat else ""


def tokens(c: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def words(s: str) -> list[str]:
    return [t for t in s.split(" ") if t]


def level(c: Column, word: str) -> Column:
    """3 for a whole word, 2 for a word's start, 1 for inside, 0 for none. Literal needles, so nothing to escape."""
    return F.when(c.contains(f" {word} "), 3).when(c.contains(f" {word}"), 2).when(c.contains(word), 1).otherwise(0)


def padded(values: Column) -> Column:
    """Distinct values joined by spaces, a space at both ends; '' for none."""
    return F.when(F.size(values) > 0, F.concat(F.lit(" "), F.array_join(F.array_distinct(values), " "), F.lit(" "))).otherwise("")


def iso_day(c: Column) -> Column:
    """The date that a string begins with, as yyyy-mm-dd, if nothing or a time follows; else null."""
    day = F.regexp_extract(c.cast("string"), r"^(\d{4}-\d{2}-\d{2})(?:[T ]|$)", 1)
    return F.when(day != "", F.try_to_date(day, "yyyy-MM-dd"))


def number_text(c: Column) -> Column:
    """A number as people write it: 45, not 45.0."""
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(c.cast("string"))


_NUMBER = r"^(?:[-+]?[$€£]?\s?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|[-+]?[$€£]?\s?\.\d+)$"


def parse_number(c: Column) -> Column:
    """The number that a string is: sign, currency, thousands commas and decimals; else null."""
    t = F.trim(c)
    return F.when(t.rlike(_NUMBER), F.regexp_replace(t, r"[$€£,\s]", "").try_cast("double"))


EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE = r"^[+(]?\d[\d\s().\-]{5,}$"


def email_of(c: Column) -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(EMAIL), F.lower(t))


def phone_of(c: Column) -> Column:
    """The digits of a value that looks like a phone number of at least 7 digits and isn't a date."""
    t = F.trim(c.cast("string"))
    digits = F.regexp_replace(t, r"\D", "")
    return F.when(t.rlike(PHONE) & ~t.rlike(EMAIL) & (F.length(digits) >= 7) & ~t.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]|$)"), digits)


def humanise(raw: str) -> str:
    """A raw table name as a label."""
    flat = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", re.sub(r"[_\W]+", " ", raw)).strip()
    return " ".join(w[:1].upper() + w[1:] for w in flat.split())


def slug(name: str) -> str:
    return regex.sub(r"[^\p{L}\p{N}]+", "-", normal(name).strip()).strip("-")


def slugs(names: list[tuple[str, str | None]]) -> dict[str, str]:
    """A unique slug for each (raw name, saved or proposed name): saved, else raw, numbered when taken."""
    out: dict[str, str] = {}
    for raw, wish in names:
        base = slug(wish or "") or slug(raw) or "table"
        found, n = base, 2
        while found in out.values():
            found, n = f"{base}-{n}", n + 1
        out[raw] = found
    return out
