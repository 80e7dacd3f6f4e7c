"""How good a search is: hits, percentiles, groups, and queries made from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.functions.text import tokens


def document_frequency(index: DataFrame, col: str = "search_text") -> DataFrame:
    """(word, df): rows that hold each word."""
    return index.select(F.explode(F.array_distinct(tokens(F.col(col)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


#: Words that are common, by a bound on their number and so on what is broadcast.
COMMON = 20_000


def distinctive_words(index: DataFrame, key: list[str], n: int = 3, col: str = "search_text") -> DataFrame:
    """The rarest words of each row, then the longest, then in order: (key, rank, word).

    The COMMON most frequent words are met by a broadcast, so that only rows of rare words are shuffled to
    their counts; of a row's words at most n leave the task that reads it.
    """
    words = index.select(*key, F.explode(F.array_distinct(tokens(F.col(col)))).alias("word"))
    counts = document_frequency(index, col)
    common = F.broadcast(counts.orderBy(F.desc("df"), "word").limit(COMMON))
    ranked = words.join(common, "word").unionByName(words.join(common.select("word"), "word", "left_anti").join(counts, "word"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("df", F.length("word").desc(), "word"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= n).select(*key, "rank", "word")


def scores(results: DataFrame, by: list[str] = ()) -> DataFrame:
    """Runs, shares of hit at one and at five, misses and errors, all or by group. results: rank (null: miss), error;
    where there is a column best (the id named as the one record) and record_id, also the share of those named rightly."""
    ok = F.col("error").isNull()
    share = lambda c: F.round(F.avg(F.when(ok, F.when(c, 1.0).otherwise(0.0))), 6)
    aggs = [
        F.count(F.lit(1)).alias("runs"), share(F.coalesce(F.col("rank") == 1, F.lit(False))).alias("hit1"), share(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("hit5"),
        F.count(F.when(ok & F.col("rank").isNull(), 1)).alias("misses"), F.count("error").alias("errors"),
    ]
    if "best" in results.columns:
        named = ok & F.col("best").isNotNull()
        aggs.append(F.round(F.avg(F.when(named, F.when(F.col("best") == F.col("record_id"), 1.0).otherwise(0.0))), 6).alias("best_ok"))
    return results.groupBy(*by).agg(*aggs)


def run_summary(tables: DataFrame) -> DataFrame:
    """One row over the tables of a run: how many, and the sums of every number they give."""
    sums = [F.coalesce(F.sum(f.name), F.lit(0)).alias(f.name) for f in tables.schema.fields if isinstance(f.dataType, T.NumericType)]
    return tables.agg(F.count(F.lit(1)).cast("long").alias("tables"), *sums)


def distinct_queries(queries: DataFrame, keys: tuple[str, ...] = ("table", "id", "type", "query")) -> DataFrame:
    """Generated queries, one of each table, record, kind and text (without regard to case and spaces at its ends); of equal ones the first by text."""
    text = F.lower(F.trim(F.col(keys[-1])))
    same = Window.partitionBy(*keys[:-1], text).orderBy(keys[-1])
    return queries.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")


#: Ranges of values in which a percentile is looked for.
RANGES = 256


def percentile(df: DataFrame, col: str, p: float, by: list[str] = ()) -> DataFrame:
    """The value at floor(p (n - 1) + 1/2) of the sorted ones, exact.

    Distinct values are counted, and dealt over RANGES ranges of values; the counts of the ranges tell in which
    one the place lies, and only its values are put in order. So no task sorts a whole group.
    """
    g = "_g"
    counts = df.where(F.col(col).isNotNull()).groupBy(F.struct(F.lit(0).alias("_"), *by).alias(g), col).agg(F.count(F.lit(1)).alias("_n"))
    cuts = counts.groupBy(g).agg(F.percentile_approx(col, [i / RANGES for i in range(1, RANGES)], 1000).alias("_cuts"), F.sum("_n").alias("_all"))
    dealt = counts.join(cuts, g).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(col)))).drop("_cuts")
    ranges = dealt.groupBy(g, "_range", "_all").agg(F.sum("_n").alias("_n"))
    ranges = ranges.withColumn("_to", F.sum("_n").over(Window.partitionBy(g).orderBy("_range")))
    place = F.floor(F.lit(p) * (F.col("_all") - 1) + 0.5)
    hit = ranges.where((F.col("_to") > place) & (F.col("_to") - F.col("_n") <= place)).select(g, "_range", place.alias("_place"), (F.col("_to") - F.col("_n")).alias("_before"))
    near = dealt.join(hit, [g, "_range"]).withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(g, "_range").orderBy(col)))
    return near.where(F.col("_to") > F.col("_place")).groupBy(g).agg(F.min(col).alias("value")).select(*(F.col(f"{g}.{c}") for c in by), "value")


def compare(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two runs by group: points that hit1 and hit5 gain from a to b."""
    x, y = (scores(r, by).select(*by, F.col("hit1").alias(f"hit1_{n}"), F.col("hit5").alias(f"hit5_{n}")) for r, n in ((a, "a"), (b, "b")))
    points = lambda c: F.round(100 * (F.col(f"{c}_b") - F.col(f"{c}_a")), 1).alias(f"{c}_points")
    return x.join(y, by).select(*by, points("hit1"), points("hit5"))


def spread(df: DataFrame, kind: str, n: int, seed: int = 1, key: str = "query") -> DataFrame:
    """n rows taken in turn from the shuffled lists of each kind."""
    shuffled = F.row_number().over(Window.partitionBy(kind).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key))
    return df.withColumn("_turn", shuffled).where(F.col("_turn") <= n).orderBy("_turn", kind, key).limit(n).drop("_turn")  # a group limit: no list is numbered further


def worst(results: DataFrame, n: int = 40) -> DataFrame:
    """The worst results: those that rules alone should find first, then by rank, misses last of all ranks first."""
    return results.where("error is null and (rank is null or rank > 1)").orderBy((F.col("expect") != "deterministic").cast("int"), F.col("rank").desc_nulls_first(), "query").limit(n)


def prefix_found(record_words: Column, query_words: Column, alternates: Column) -> Column:
    """Whether every query word starts a record word or is an alternate of one: what rules alone must find."""
    return F.forall(query_words, lambda w: F.exists(record_words, lambda x: x.startswith(w)) | F.exists(F.coalesce(F.element_at(alternates, w), F.array().cast("array<string>")), lambda o: F.array_contains(record_words, o)))


def typos(word: Column) -> dict[str, Column]:
    """A word typed wrong in six ways."""
    n, mid = F.length(word), F.floor(F.length(word) / 2).cast("int")
    part = lambda a, k: F.substring(word, a, k)
    return {
        "swap": F.concat(part(F.lit(1), mid - 1), part(mid + 1, F.lit(1)), part(mid, F.lit(1)), part(mid + 2, n)), "drop": F.concat(part(F.lit(1), mid - 1), part(mid + 1, n)),
        "double": F.concat(part(F.lit(1), mid), part(mid, n)), "vowel": F.translate(word, "aeiou", "eioua"), "split": F.concat(part(F.lit(1), mid), F.lit(" "), part(mid + 1, n)),
        "join": F.replace(word, F.lit(" "), F.lit("")),
    }


def field_role(share_numbers: Column, share_dates: Column, share_emails: Column, share_phones: Column, avg_words: Column) -> Column:
    """What a field holds, by shares of its values."""
    return (
        F.when(share_emails > 0.6, "email").when(share_dates > 0.6, "date").when(share_phones > 0.6, "phone").when(share_numbers > 0.6, "number")
        .when(avg_words > 12, "prose").when(avg_words <= 4, "name").otherwise("text")
    )


def table_kind(roles: Column) -> Column:
    """What a table is about, by the roles of its fields."""
    has = lambda r: F.array_contains(roles, r)
    return F.when(has("email") | has("phone"), "people").when(has("number") & has("date"), "transactions").when(has("number"), "catalogue").when(has("prose"), "documents").otherwise("other")


def pair_clicks(searches: DataFrame, clicks: DataFrame, within_seconds: int = 600) -> DataFrame:
    """Each search (search_id, query, ts) with its newest click (query, ts, record_id) less than within_seconds away; null for none.

    They meet on the query and a span of time: a click enters its own span and both beside it, so that a frequent
    query's searches and clicks don't all meet.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = lambda c: F.floor(micros(c) / (within_seconds * 1_000_000))
    c = clicks.select("query", F.col("ts").alias("click_ts"), "record_id")
    c = c.withColumn("_span", F.explode(F.array(*(span("click_ts") + i for i in (-1, 0, 1)))))
    near = searches.withColumn("_span", span("ts")).join(c, ["query", "_span"]).where(F.abs(micros("ts") - micros("click_ts")) < within_seconds * 1_000_000)
    newest = near.groupBy("search_id").agg(F.max(F.struct("click_ts", "record_id")).alias("c")).select("search_id", "c.click_ts", "c.record_id")
    return searches.join(newest, "search_id", "left")


def hit_rank(results: DataFrame, cases: DataFrame) -> DataFrame:
    """The rank at which each case (case_id, table, expect array) is met by results (case_id, src_table, rank, display); null for none."""
    r = results.join(cases.select("case_id", "table", "expect"), "case_id")
    r = r.where((F.col("src_table") == F.col("table")) & F.exists("expect", lambda e: F.col("display").contains(e)))
    return cases.join(r.groupBy("case_id").agg(F.min("rank").alias("rank")), "case_id", "left")
