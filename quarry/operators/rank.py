"""The other rankings, and what makes one list of them: fuzzy, vectors, fusion, balance, reasons."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.similarity import similarity_to
from quarry.functions.vectors import cosine
from quarry.operators.search import SHOWN, top_per_table
from quarry.plans.query import Plan, describe

#: Fusion by reciprocal rank: an exact hit outranks any other for ranks up to 20.
RRF_K, WEIGHTS = 60, {"exact": 3.0, "fuzzy": 1.0, "semantic": 1.0}


def fuzzy_search(index: DataFrame, words: list[list[str]], per_table: int = 5, floor: float = 0.90, tables=()) -> DataFrame:
    """Titles that are close to the words (each a list of spellings, the typed one first; four count).

    A cheap gate first: for every word some title word starts like one of its spellings, or the
    whole title starts like the whole query. Titles of over two characters only.
    """
    words = [[w for w in spellings if w][:4] for spellings in words]
    words = [s for s in words if s]
    if tables:
        index = index.where(F.col("src_table").isin(*tables))
    if not words:
        return index.where(F.lit(False)).select(*SHOWN, F.lit(0.0).alias("sim"), F.lit(0).alias("rank"))
    title = F.col("title_text")
    gate = reduce(and_, (reduce(or_, (title.contains(f" {c}") for c in sorted({w[0] for w in s}))) for s in words))
    packed = F.replace(title, F.lit(" "), F.lit("")).startswith("".join(s[0] for s in words)[:2])
    near = index.where((F.length(title) > 2) & (gate | packed)).select(*SHOWN)
    near = near.withColumn("sim", similarity_to(words)("title_text")).where(F.col("sim") >= floor)
    return top_per_table(near, [F.col("sim").desc(), F.length("title_text"), F.col("record_id")], per_table)


def spellings(plan: Plan) -> list[list[str]]:
    """The words of a text plan for the fuzzy search."""
    return [[t.word, *t.also] for t in plan.terms]


def vector_search(vectors: DataFrame, index: DataFrame, query: list[float], key: str, per_table: int = 5, floor: float = 0.3, tables=()) -> DataFrame:
    """The nearest records by cosine among vectors of the current key; first the best rows, then their display.

    A vector whose record has left the index is dropped.
    """
    v = vectors.where(F.col("vec_key") == key)
    if tables:
        v = v.where(F.col("src_table").isin(*tables))
    v = v.select("src_table", "record_id", cosine(F.col("vec"), F.lit([round(float(x), 6) for x in query])).alias("sim"))
    top = top_per_table(v.where("sim is not null"), [F.col("sim").desc(), F.col("record_id")], per_table).where(F.col("sim") >= floor)
    # per_table rows of each table at most: small beside the index.
    return index.select(*SHOWN).join(F.broadcast(top), ["src_table", "record_id"]).select(*SHOWN, "sim", "rank")


def fuse(**lists: DataFrame) -> DataFrame:
    """One list from those named exact, fuzzy and semantic, by weighted reciprocal rank within each table.

    Columns: SHOWN, fused, kinds (which lists a row is in, the strongest first), rank in its table.
    """
    parts = [df.select(*SHOWN, F.lit(kind).alias("kind"), (F.lit(WEIGHTS[kind]) / (RRF_K + F.col("rank"))).alias("w")) for kind, df in lists.items()]
    together = reduce(lambda a, b: a.unionByName(b), parts)
    fused = together.groupBy("src_table", "record_id").agg(
        F.first("display").alias("display"), F.first("title_text").alias("title_text"), F.sum("w").alias("fused"),
        F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("w", "kind")))), lambda x: x["kind"]), ",").alias("kinds"),
    )
    return top_per_table(fused, [F.col("fused").desc(), F.length("title_text"), F.col("record_id")], 1 << 30)


def balance(ranked: DataFrame, per_table: int = 5, score: str = "fused") -> DataFrame:
    """Round by round, one row of each table: tables in a round by score, then by name. Column position, from 1.

    ranked holds a few rows of each table, so the last numbering is of a small list.
    """
    order = Window.orderBy("rank", F.col(score).desc(), "src_table")
    return ranked.where(F.col("rank") <= per_table).withColumn("position", F.row_number().over(order))


def best(exact: DataFrame, plan: Plan) -> DataFrame:
    """The one exact row that has every typed word in its title; none if several have."""
    if plan.kind != "text":
        return exact.limit(0)
    every = reduce(and_, (F.col("title_text").contains(f" {t.word}") for t in plan.terms))
    full = exact.where(every)
    return full.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy())).where("_n = 1").drop("_n")


def why(df: DataFrame, plan: Plan) -> DataFrame:
    """df with a reason: the plan in words, and the values that hit."""
    said = F.lit(describe(plan))
    if "hits" not in df.columns:
        return df.withColumn("why", said)
    return df.withColumn("why", F.when(F.size("hits") > 0, F.concat(said, F.lit(": "), F.array_join("hits", ", "))).otherwise(said))
