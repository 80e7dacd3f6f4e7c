"""The typed search: a plan becomes a filter, a score, the values that hit, and an order."""

from __future__ import annotations

from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.text import level
from quarry.operators import bm25
from quarry.plans.query import Plan, Term

SHOWN = ("src_table", "record_id", "display", "title_text")


def _notes(tables) -> Column | None:
    """Notes of the tables whose stage is on; others' stay stored and never match."""
    return F.when(F.col("src_table").isin(*tables), F.coalesce("enrich_norm", F.lit(""))).otherwise("") if tables else None


def _needle(mode: str, word: str) -> str:
    return {"whole": f" {word} ", "contains": word}.get(mode, f" {word}")


def _term(t: Term, notes: Column | None) -> tuple[Column, Column]:
    """Filter and score of a term: any of its spellings, the best of them."""
    text, title = F.col("search_text"), F.col("title_text")
    found, scores = [], []
    for w in (t.word, *t.also):
        hit = text.contains(_needle(t.mode, w))
        score = level(text, w) + 2 * level(title, w)
        if notes is not None:
            hit = hit | notes.contains(_needle(t.mode, w))
            score = score + F.when(notes.contains(f" {w}"), 1).otherwise(0)
        found.append(hit)
        scores.append(score)
    return reduce(or_, found), F.greatest(*scores) if len(scores) > 1 else scores[0]


def _within(values: str, low, high, kind: str) -> Column:
    def keep(x):
        conds = [x >= F.lit(low).cast(kind)] * (low is not None) + [x <= F.lit(high).cast(kind)] * (high is not None)
        return reduce(and_, conds, F.lit(True))

    return F.filter(values, keep)


def compile_plan(p: Plan, notes: Column | None = None) -> tuple[Column, Column, Column, Column | None]:
    """(filter, score, hits as strings, order before the title's length) of a plan."""
    none = F.lit(None).cast("array<string>")
    strings = lambda c: F.transform(c, lambda x: x.cast("string"))
    if p.kind == "text":
        terms = [_term(t, notes) for t in p.terms]
        phrase = " ".join(t.word for t in p.terms)
        bonus = F.when(F.col("title_text").startswith(f" {phrase}"), 4).otherwise(0)
        return reduce(and_, (t[0] for t in terms)), reduce(add, (t[1] for t in terms)) + bonus, none, None
    if p.kind == "number":
        value, whole = F.lit(float(p.value)), F.col("search_text").contains(f" {' '.join(p.words)} ")
        same = F.array_contains("nums", value)
        where, score, hits = same | whole, F.when(same, 3).when(whole, 2).otherwise(0), strings(F.filter("nums", lambda x: x == value))
        if p.year:
            days = _within("dates", f"{p.year}-01-01", f"{p.year}-12-31", "date")
            where, score, hits = where | (F.size(days) > 0), score + F.when(F.size(days) > 0, 1).otherwise(0), F.concat(hits, strings(days))
        if p.digits:
            where, score = where | F.col("digits").contains(p.digits), score + level(F.col("digits"), p.digits)
        return where, score, hits, None
    if p.kind in ("range", "date", "daterange"):
        f = _within("nums", p.low, p.high, "double") if p.kind == "range" else _within("dates", p.low, p.high, "date")
        return F.size(f) > 0, F.lit(3), strings(f), F.get(f, F.lit(0))
    if p.kind == "month":
        f = F.filter("dates", lambda x: F.month(x) == p.month)
        return F.size(f) > 0, F.lit(3), strings(f), F.day(F.get(f, F.lit(0)))
    if p.kind == "email":
        return F.col("emails").contains(p.value), level(F.col("emails"), p.value), none, None
    if p.kind == "phone":
        c = F.col("digits")
        return c.contains(p.digits), F.when(c.contains(f" {p.digits} "), 3).when(c.contains(f"{p.digits} "), 2).otherwise(1), none, None
    return F.lit(False), F.lit(0), none, None


def top_per_table(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each table (column rank); planned as a group limit, partial before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("src_table").orderBy(*order))).where(F.col("rank") <= k)


def text_search(index: DataFrame, plan: Plan, per_table: int = 5, tables=(), notes_of=(), text_index: bm25.TextIndex | None = None) -> DataFrame:
    """The best rows of each table for a plan: SHOWN, hits, score, rank. Exact: nothing that fails the filter is returned.

    With a text index, twice the BM25 score of the typed words is added to a text plan's score.
    """
    if tables:
        index = index.where(F.col("src_table").isin(*tables))  # prunes folders
    where, score, hits, first = compile_plan(plan, _notes(notes_of))
    found = index.where(where).withColumn("score", score.cast("double")).withColumn("hits", hits)
    if text_index is not None and plan.kind == "text":
        weights = text_index.scores([t.word for t in plan.terms])
        found = found.join(weights, "doc_key", "left").withColumn("score", F.col("score") + 2 * F.coalesce("bm25", F.lit(0.0)))
    order = [F.col("score").desc(), *([first.asc()] if first is not None else []), F.length("title_text"), F.col("record_id")]
    return top_per_table(found, order, per_table).select(*SHOWN, "hits", "score", "rank")
