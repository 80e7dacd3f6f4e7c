"""From a search string to a plan. The whole input is read as one kind of thing."""

from __future__ import annotations

import calendar
import datetime as dt
import math
import re
from dataclasses import dataclass, field
from urllib.parse import unquote

from quarry.functions.text import _NUMBER, normal, words
from quarry.plans.names import alternates

MONTHS = [m.lower() for m in calendar.month_name[1:]]


@dataclass(frozen=True)
class Term:
    word: str
    mode: str = "start"  # start, whole, contains or phrase
    also: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    """kind: empty, number, range, date, daterange, month, email, phone or text; the fields that kind uses are set."""

    kind: str
    value: float | str | None = None
    low: float | dt.date | None = None
    high: float | dt.date | None = None
    month: int | None = None
    digits: str | None = None
    year: int | None = None
    terms: tuple[Term, ...] = ()
    words: tuple[str, ...] = ()
    label: str = ""


@dataclass(frozen=True)
class Options:
    """What a request may set, within bounds."""

    limit: int = 5
    tables: tuple[str, ...] = ()
    off: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def of(limit=5, tables=(), off=()) -> Options:
        try:
            limit = int(limit)
        except (TypeError, ValueError):
            limit = 5
        return Options(min(max(limit, 1), 20), tuple(t for t in tables if t), frozenset(off))


def undouble(q: str) -> str:
    """Decode once more what was encoded twice."""
    if not re.search(r"%[0-9A-Fa-f]{2}", q):
        return q
    try:
        return unquote(q, errors="strict")
    except UnicodeDecodeError:
        return q


def parse_number(s: str) -> float | int | None:
    t = s.strip()
    if not re.match(_NUMBER, t, re.ASCII):
        return None
    flat = re.sub(r"[$€£,\s]", "", t)
    n = float(flat)
    if not math.isfinite(n):
        return None
    return int(n) if n == int(n) and abs(n) < 2**53 else n


_ISO = re.compile(r"(\d{4})[-/.](\d{1,2})(?:[-/.](\d{1,2}))?", re.ASCII)
_PARTS = re.compile(r"(\d{1,2})[/.](\d{1,2})(?:[/.](\d{2,4}))?", re.ASCII)
_MONTH = re.compile(r"(\d{1,2})[/.](\d{4})", re.ASCII)


def parse_date(s: str, day_first: bool = False, today: dt.date | None = None) -> tuple[dt.date, dt.date, str] | None:
    """(first day, last day, label) of a day or a month. Two-digit years are 20xx; a part over 12 decides the order."""
    t = s.strip()
    if m := _ISO.fullmatch(t):
        year, month, day = int(m[1]), int(m[2]), int(m[3]) if m[3] else None
    elif m := _PARTS.fullmatch(t):
        a, b = int(m[1]), int(m[2])
        year = int(m[3]) if m[3] else (today or dt.date.today()).year
        if m[3] and len(m[3]) == 2:
            year += 2000
        if a > 12 >= b:
            day_first = True
        elif b > 12 >= a:
            day_first = False
        month, day = (b, a) if day_first else (a, b)
    elif m := _MONTH.fullmatch(t):
        year, month, day = int(m[2]), int(m[1]), None
    else:
        return None
    if not (1 <= month <= 12 and 1 <= year <= 9999):
        return None
    last = calendar.monthrange(year, month)[1]
    if day is None:
        return dt.date(year, month, 1), dt.date(year, month, last), f"{year:04d}-{month:02d}"
    if year < 1000 or not 1 <= day <= last:
        return None
    d = dt.date(year, month, day)
    return d, d, d.isoformat()


def _bound(symbol: str, text: str, day_first: bool, today) -> Plan | None:
    """An open range; the strict forms step over the value by the smallest unit that was typed."""
    n = parse_number(text)
    if n is not None:
        decimals = re.search(r"\.(\d+)$", text.strip())
        step = 10 ** -len(decimals[1]) if decimals else 1
        if symbol in (">", ">="):
            return Plan("range", low=n if symbol == ">=" else n + step, label=f"{n} or more" if symbol == ">=" else f"over {n}")
        return Plan("range", high=n if symbol == "<=" else n - step, label=f"{n} or less" if symbol == "<=" else f"under {n}")
    d = parse_date(text, day_first, today)
    if d is None:
        return None
    day = dt.timedelta(days=1)
    return {
        ">=": Plan("daterange", low=d[0], label=f"{d[2]} or later"), "<=": Plan("daterange", high=d[1], label=f"{d[2]} or earlier"),
        ">": Plan("daterange", low=d[1] + day, label=f"after {d[2]}"), "<": Plan("daterange", high=d[0] - day, label=f"before {d[2]}"),
    }[symbol]


def _text(q: str, also: dict[str, list[str]]) -> Plan:
    terms = []
    for quoted, token in re.findall(r'"([^"]+)"|(\S+)', q):
        if quoted:
            if found := words(normal(quoted)):
                terms.append(Term(" ".join(found), "phrase"))
            continue
        mode = {"=": "whole", "*": "contains"}.get(token[0], "start")
        terms += [Term(w, mode, tuple(also.get(w, ()))) for w in words(normal(token if mode == "start" else token[1:]))]
    return Plan("text", terms=tuple(terms)) if terms else Plan("empty")


def parse(raw: str | None, day_first: bool = False, today: dt.date | None = None, groups: list[list[str]] | None = None) -> Plan:
    """The plan of a search string. Tried in order: range, operator, month, date, number, email, phone, text."""
    q = " ".join((raw or "").split())
    if not q:
        return Plan("empty")
    if m := re.fullmatch(r"(.+?)\s*(?:\.\.\.|\.\.|…)\s*(.+)", q):
        ends = [parse_number(x) for x in m.groups()]
        if None not in ends:
            low, high = sorted(ends)
            return Plan("range", low=low, high=high, label=f"{low} to {high}")
        days = [parse_date(x, day_first, today) for x in m.groups()]
        if None not in days:
            a, b = sorted(days, key=lambda d: d[0])
            return Plan("daterange", low=a[0], high=b[1], label=f"{a[2]} to {b[2]}")
    if m := re.fullmatch(r"(>=|<=|≥|≤|>|<)\s*(.+)", q):
        plan = _bound(m[1].replace("≥", ">=").replace("≤", "<="), m[2], day_first, today)
        if plan:
            return plan
    if m := re.fullmatch(r"month:\s*([a-z]+|\d{1,2})", q, re.IGNORECASE | re.ASCII):
        v = m[1].lower()
        month = int(v) if v.isdigit() else next((i for i, name in enumerate(MONTHS, 1) if name.startswith(v[:3])), 0)
        if 1 <= month <= 12:
            return Plan("month", month=month, label=MONTHS[month - 1].capitalize())
    if d := parse_date(q, day_first, today):
        return Plan("date", low=d[0], high=d[1], label=d[2])
    n = parse_number(q)
    if n is not None:
        year = n if isinstance(n, int) and 1900 <= n <= 2100 and re.fullmatch(r"\d{4}", q, re.ASCII) else None
        digits = q if re.fullmatch(r"\d{7,}", q, re.ASCII) else None
        return Plan("number", value=n, words=tuple(words(normal(q))), year=year, digits=digits)
    if re.fullmatch(r"\S+@\S*", q):
        return Plan("email", value=q.lower())
    if re.fullmatch(r"[+\d][\d\s().\-]*", q, re.ASCII):
        digits = re.sub(r"\D", "", q)
        if len(digits) >= 6:
            return Plan("phone", digits=digits)
    return _text(q, alternates(groups))


def describe(p: Plan) -> str:
    """The plan in words."""
    if p.kind == "number":
        return f"number {p.value}" + (f", or a date in {p.year}" if p.year else ", or a phone number" if p.digits else "")
    if p.kind == "date":
        return f"{'date' if p.low == p.high else 'month'} {p.label}"
    simple = {"range": f"number range: {p.label}", "daterange": f"date range: {p.label}", "month": f"{p.label}, any year", "email": "email address", "phone": "phone number"}
    if p.kind != "text":
        return simple.get(p.kind, "")
    shown = []
    for t in p.terms:
        w = {"phrase": f'"{t.word}"', "whole": f"={t.word}", "contains": f"*{t.word}"}.get(t.mode, t.word)
        shown.append(w + (f" (also {', '.join(t.also[:4])}{', ...' if len(t.also) > 4 else ''})" if t.also else ""))
    return f"words: {', '.join(shown)}"
