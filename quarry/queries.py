"""A query for each operator over the driver's tables, and the SQL that must agree with it."""

from __future__ import annotations

import datetime as dt
import inspect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Stages, TableConfig, TextJoin
from quarry.functions import text as X
from quarry.functions import vectors as V
from quarry.operators import bm25, changes, evaluate, index, profile, rank, search, stages
from quarry.plans.query import Plan, parse
from quarry.sources import tables

CONFIGS = {
    "customer": TableConfig("c_custkey", ("c_name", "c_mktsegment", "c_acctbal"), ("c_name", "c_mktsegment")),
    "orders": TableConfig("o_orderkey", ("o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"), ("o_orderpriority", "o_orderdate")),
    "part": TableConfig("p_partkey", ("p_name", "p_brand", "p_type", "p_retailprice", "p_size"), ("p_name", "p_brand")),
    "supplier": TableConfig("s_suppkey", ("s_name", "s_acctbal"), ("s_name",)),
}
TODAY = dt.date(2024, 6, 1)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_index(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    names = names or tuple(CONFIGS)
    return index.build_all({n: read(spark, sf_dir, n) for n in names}, {n: CONFIGS[n] for n in names})


_stored: dict[tuple, object] = {}


def _kept(spark: SparkSession, sf_dir: str, what: str, make):
    """What make(path) stores and gives back, made once in a session for each folder of tables."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _stored:
        _stored[key] = make(tables.scratch_path(spark, what))
    return _stored[key]


def the_index(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The stored index over the driver's tables, built when it is first asked for."""

    def make(path: str) -> DataFrame:
        index.write(build_index(spark, sf_dir), path)
        return index.read(spark, path)

    found = _kept(spark, sf_dir, "index", make)
    return found.where(F.col("src_table").isin(*names)) if names else found


def the_text_index(spark: SparkSession, sf_dir: str, what: str, rows) -> bm25.TextIndex:
    def make(path: str) -> bm25.TextIndex:
        bm25.build(rows()).save(path)
        return bm25.TextIndex.load(spark, path)

    return _kept(spark, sf_dir, f"words-{what}", make)


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = inspect.cleandoc(sql)
        return f

    return add


# --- SQL twins ---------------------------------------------------------------------------

def _n(x: str) -> str:
    flat = rf"trim(regexp_replace(lower(strip_accents(coalesce({x}, ''))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"(CASE WHEN {flat} = '' THEN '' ELSE ' ' || {flat} || ' ' END)"


def _d(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


_FIELDS = {
    "customer": [("c_name", "t"), ("c_mktsegment", "t"), ("c_acctbal", "d")],
    "orders": [("o_orderstatus", "t"), ("o_orderpriority", "t"), ("o_orderdate", "s"), ("o_totalprice", "d")],
    "part": [("p_name", "t"), ("p_brand", "t"), ("p_type", "t"), ("p_retailprice", "d"), ("p_size", "i")],
    "supplier": [("s_name", "t"), ("s_acctbal", "d")],
}
_TITLE = {"customer": "c_name", "orders": "o_orderpriority", "part": "p_name", "supplier": "s_name"}


def _idx(*names: str) -> str:
    """The index as a common table expression."""
    parts = []
    for name in names or CONFIGS:
        text = [(_d(f) if k == "d" else f"CAST({f} AS VARCHAR)") for f, k in _FIELDS[name]]
        lines = ", ".join(f"'{f}: ' || {t}" for (f, _), t in zip(_FIELDS[name], text, strict=True))
        nums = ", ".join(f"CAST({f} AS DOUBLE)" for f, k in _FIELDS[name] if k in "di")
        dates = ", ".join(f"CAST({f} AS DATE)" for f, k in _FIELDS[name] if k == "s")
        parts.append(
            f"SELECT '{name}' AS src_table, CAST({CONFIGS[name].pk} AS VARCHAR) AS record_id, concat_ws(chr(10), {lines}) AS source_text, {_n('concat_ws(' + repr(' ') + ', ' + ', '.join(text) + ')')} AS search_text,"
            f" {_n(_TITLE[name])} AS title_text, CAST(list_distinct([{nums}]) AS DOUBLE[]) AS nums_, CAST([{nums}] AS DOUBLE[]) AS nums, CAST([{dates}] AS DATE[]) AS dates FROM {name}"
        )
    return "idx AS (" + " UNION ALL ".join(parts) + ")"


def _lvl(c: str, w: str) -> str:
    return f"(CASE WHEN contains({c}, ' {w} ') THEN 3 WHEN contains({c}, ' {w}') THEN 2 WHEN contains({c}, '{w}') THEN 1 ELSE 0 END)"


def _score(w: str) -> str:
    return f"({_lvl('search_text', w)} + 2 * {_lvl('title_text', w)})"


def _top(where: str, score: str, order: str = "", k: int = 5, names=(), extra: str = "") -> str:
    return (
        f"WITH {_idx(*names)}, r AS (SELECT *, CAST({score} AS DOUBLE) AS score, row_number() OVER (PARTITION BY src_table ORDER BY {score} DESC, {order} length(title_text), record_id) AS rank"
        f" FROM idx WHERE {where}) SELECT src_table, record_id, score, CAST(rank AS INTEGER) AS rank{extra} FROM r WHERE rank <= {k}"
    )


def _found(spark, sf_dir, q, per_table=5, names=(), tables=(), hit=None):
    found = search.text_search(the_index(spark, sf_dir, *names), parse(q, today=TODAY, groups=[]), per_table, tables)
    shown = [F.get("hits", F.lit(0)).cast(hit).alias("hit")] if hit else []
    return found.select("src_table", "record_id", "score", "rank", *shown)


def _search(name: str, q: str, sql: str, **how):
    def f(spark, sf_dir):
        return _found(spark, sf_dir, q, **how)

    f.__name__ = name
    f.__doc__ = f"The best records of each table for {q!r}."
    query(sql)(f)


# --- Text and typed values ---------------------------------------------------------------

@query(f"SELECT doc_id, {_n('text')} AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("normal"))


@query(f"SELECT word, CAST(count(DISTINCT doc_id) AS BIGINT) AS df FROM (SELECT doc_id, unnest(string_split(trim({_n('text')}), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def tokenize_df(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("search_text"))
    return evaluate.document_frequency(docs)


@query(f"""
    WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim({_n('text')}), ' ')) AS word FROM documents),
    d AS (SELECT word, count(*) AS df FROM w WHERE word <> '' GROUP BY word),
    r AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY df, length(word) DESC, word) AS rank FROM w JOIN d USING (word))
    SELECT doc_id, CAST(rank AS INTEGER) AS rank, word FROM r WHERE rank <= 3
""")
def distinctive_words(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", X.normalise(F.col("text")).alias("search_text"))
    return evaluate.distinctive_words(docs, ["doc_id"], 3)


_TOKENS = "SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+')) AS t FROM documents) WHERE t <> ''"


def _tokens(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("t"))
    return docs.where("t <> ''").distinct()


@query(f"""
    WITH k AS ({_TOKENS}), e AS (
        SELECT doc_id, t, CASE WHEN regexp_full_match(t, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(t) END AS email,
            CASE WHEN regexp_matches(t, '^[+(]?[0-9][0-9\\s().\\-]{{5,}}$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7
                AND NOT regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]|$)') THEN regexp_replace(t, '[^0-9]', '', 'g') END AS phone
        FROM k)
    SELECT doc_id, t, email, phone FROM e WHERE email IS NOT NULL OR phone IS NOT NULL
""")
def typed_extract(spark, sf_dir):
    t = F.col("t")
    return _tokens(spark, sf_dir).select("doc_id", "t", X.email_of(t).alias("email"), X.phone_of(t).alias("phone")).where("email is not null or phone is not null")


def _typed_index(spark, sf_dir):
    """Documents with their email and phone tokens as typed lists."""
    t = F.col("t")
    lists = _tokens(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_set(X.email_of(t))).alias("e"), F.sort_array(F.collect_set(X.phone_of(t))).alias("d"))
    return lists.select(F.lit("documents").alias("src_table"), F.col("doc_id").cast("string").alias("record_id"), F.lit("").alias("display"), F.lit(" x ").alias("title_text"), F.lit("").alias("search_text"), X.padded(F.col("e")).alias("emails"), X.padded(F.col("d")).alias("digits"))


def _typed_sql(column: str, where: str, score: str) -> str:
    value = "CASE WHEN regexp_full_match(t, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN lower(t) END" if column == "emails" else (
        "CASE WHEN regexp_matches(t, '^[+(]?[0-9][0-9\\s().\\-]{5,}$') AND length(regexp_replace(t, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(t, '[^0-9]', '', 'g') END")
    return (
        f"WITH k AS ({_TOKENS}), idx AS (SELECT doc_id, ' ' || string_agg(DISTINCT {value}, ' ') || ' ' AS {column} FROM k GROUP BY doc_id),"
        f" r AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, CAST({score} AS DOUBLE) AS score FROM idx WHERE {where})"
        " SELECT record_id, score, CAST(row_number() OVER (ORDER BY score DESC, record_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 20"
    )


@query(_typed_sql("emails", "contains(emails, '@mail3.example.com')", _lvl("emails", "@mail3.example.com")))
def email_match(spark, sf_dir):
    return search.text_search(_typed_index(spark, sf_dir), Plan("email", value="@mail3.example.com"), 20).select("record_id", "score", "rank")


@query(_typed_sql("digits", "contains(digits, '123456')", "CASE WHEN contains(digits, ' 123456 ') THEN 3 WHEN contains(digits, '123456 ') THEN 2 ELSE 1 END"))
def phone_match(spark, sf_dir):
    return search.text_search(_typed_index(spark, sf_dir), parse("123-456"), 20).select("record_id", "score", "rank")


# --- The index ----------------------------------------------------------------------------

@query(f"WITH {_idx()} SELECT src_table, record_id, source_text, search_text, title_text, array_to_string(nums, ',') IS NOT NULL AS has_nums, CAST(len(nums_) AS INTEGER) AS n_nums, CAST(len(dates) AS INTEGER) AS n_dates FROM idx")
def index_build(spark, sf_dir):
    n = F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").isNotNull()
    return build_index(spark, sf_dir).select("src_table", "record_id", "source_text", "search_text", "title_text", n.alias("has_nums"), F.size("nums").alias("n_nums"), F.size("dates").alias("n_dates"))


@query(f"WITH {_idx()} SELECT src_table, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (len(nums) > 0) AS BIGINT) AS with_numbers, CAST(count(*) FILTER (len(dates) > 0) AS BIGINT) AS with_dates FROM idx GROUP BY src_table")
def index_stats(spark, sf_dir):
    return index.stats(the_index(spark, sf_dir)).drop("last_indexed")


@query(f"""WITH {_idx('part')} SELECT record_id, md5(source_text || '|' || '{{"p_name":"' || p_name || '","p_brand":"' || p_brand || '"}}' || '|v1') AS content_hash FROM idx JOIN part ON record_id = CAST(p_partkey AS VARCHAR)""")
def content_hash(spark, sf_dir):
    return the_index(spark, sf_dir, "part").select("record_id", "content_hash")


@query("SELECT n_name, string_agg(s_name, ', ' ORDER BY s_name) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def text_join(spark, sf_dir):
    how = TextJoin("supplier", "n_nationkey", "s_nationkey", "s_name", "suppliers")
    return index.text_join(read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier"), how).select("n_name", F.col("_joined").alias("suppliers"))


@query("""
    SELECT CAST(event_id AS VARCHAR) AS record_id, 'k: ' || json_extract_string(props, '$.k') AS source_text, ' ' || json_extract_string(props, '$.k') || ' ' AS search_text,
        CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value
    FROM events WHERE json_type(try_cast(props AS JSON)) = 'OBJECT'
""")
def record_json(spark, sf_dir):
    rows, _ = index.build_json(read(spark, sf_dir, "events"), "events", TableConfig("event_id", json_field="props"))
    return rows.select("record_id", "source_text", "search_text", F.get("nums", F.lit(0)).alias("value"))


@query("SELECT CAST(count(*) FILTER (json_type(try_cast(props AS JSON)) IS DISTINCT FROM 'OBJECT') AS BIGINT) AS skipped FROM events")
def record_json_skipped(spark, sf_dir):
    return index.build_json(read(spark, sf_dir, "events"), "events", TableConfig("event_id", json_field="props"))[1]


# --- The typed search ---------------------------------------------------------------------

_search("text_word_start", "red wid", _top("contains(search_text, ' red') AND contains(search_text, ' wid')", f"{_score('red')} + {_score('wid')} + CASE WHEN starts_with(title_text, ' red wid') THEN 4 ELSE 0 END"))
_search("text_whole", "=red", _top("contains(search_text, ' red ')", f"{_score('red')} + CASE WHEN starts_with(title_text, ' red') THEN 4 ELSE 0 END"))
_search("text_contains", "*idge", _top("contains(search_text, 'idge')", f"{_score('idge')} + CASE WHEN starts_with(title_text, ' idge') THEN 4 ELSE 0 END"))
_search("text_phrase", '"red widg"', _top("contains(search_text, ' red widg')", f"{_score('red widg')} + CASE WHEN starts_with(title_text, ' red widg') THEN 4 ELSE 0 END"))
_search("table_filter", "customer 1", _top("src_table IN ('customer') AND contains(search_text, ' customer') AND contains(search_text, ' 1')", f"{_score('customer')} + {_score('1')} + CASE WHEN starts_with(title_text, ' customer 1') THEN 4 ELSE 0 END"), tables=("customer",))
_search("number_exact", "25", _top("list_contains(nums, 25) OR contains(search_text, ' 25 ')", "(CASE WHEN list_contains(nums, 25) THEN 3 WHEN contains(search_text, ' 25 ') THEN 2 ELSE 0 END)"))
_YEAR = "len(list_filter(dates, lambda x: x BETWEEN DATE '1995-01-01' AND DATE '1995-12-31')) > 0"
_search("number_year_overlay", "1995", _top(f"list_contains(nums, 1995) OR contains(search_text, ' 1995 ') OR {_YEAR}", f"(CASE WHEN list_contains(nums, 1995) THEN 3 WHEN contains(search_text, ' 1995 ') THEN 2 ELSE 0 END) + CASE WHEN {_YEAR} THEN 1 ELSE 0 END"))


def _first(column: str, cond: str) -> str:
    return f"list_filter({column}, lambda x: {cond})"


for _name, _q, _col, _cond, _order in [
    ("number_range", "940...945.5", "nums", "x >= 940 AND x <= 945.5", "{f}[1],"), ("number_gt", ">48", "nums", "x >= 49", "{f}[1],"), ("number_lt", "<=900.5", "nums", "x <= 900.5", "{f}[1],"),
    ("date_exact", "1995-03-04", "dates", "x BETWEEN DATE '1995-03-04' AND DATE '1995-03-04'", "{f}[1],"), ("date_range", "1/1/1996...2/15/1996", "dates", "x BETWEEN DATE '1996-01-01' AND DATE '1996-02-15'", "{f}[1],"),
    ("date_month", "3/1997", "dates", "x BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'", "{f}[1],"), ("date_after", ">1998-06-01", "dates", "x >= DATE '1998-06-02'", "{f}[1],"),
    ("month_any_year", "month:march", "dates", "month(x) = 3", "day({f}[1]),"),
]:
    _f = _first(_col, _cond)
    _search(_name, _q, _top(f"len({_f}) > 0", "3", _order.format(f=_f), k=10, extra=", " + (f"CAST({_f}[1] AS VARCHAR) AS hit" if _col == "dates" else f"{_f}[1] AS hit")), per_table=10,
            hit="string" if _col == "dates" else "double")


@query(_top("(contains(search_text, ' red') OR contains(search_text, ' crimson') OR contains(search_text, ' blue'))", f"greatest({_score('red')}, {_score('blue')}, {_score('crimson')}) + CASE WHEN starts_with(title_text, ' red') THEN 4 ELSE 0 END", names=("part",)))
def text_alternates(spark, sf_dir):
    plan = parse("red", groups=[["red", "crimson"], ["blue", "red"]])
    return search.text_search(the_index(spark, sf_dir, "part"), plan).select("src_table", "record_id", "score", "rank")


@query(_top("(contains(search_text, ' red') OR contains(notes, ' red'))", f"{_score('red')} + (CASE WHEN contains(notes, ' red') THEN 1 ELSE 0 END) + CASE WHEN starts_with(title_text, ' red') THEN 4 ELSE 0 END", names=("part",)).replace(
    " FROM idx WHERE", " FROM (SELECT *, CASE WHEN CAST(record_id AS BIGINT) % 7 = 0 THEN ' red note ' ELSE '' END AS notes FROM idx) WHERE"))
def text_notes(spark, sf_dir):
    idx = the_index(spark, sf_dir, "part").withColumn("enrich_norm", F.when(F.col("record_id").cast("long") % 7 == 0, " red note "))
    return search.text_search(idx, parse("red", groups=[]), notes_of=["part"]).select("src_table", "record_id", "score", "rank")


_BM25 = f"""
    idx AS (SELECT doc_id, string_split(trim({_n('text')}), ' ') AS ws FROM documents),
    p AS (SELECT doc_id, len(ws) AS len, unnest(ws) AS word FROM idx), tf AS (SELECT doc_id, len, word, count(*) AS tf FROM p GROUP BY ALL),
    df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), st AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM idx),
    b AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS s FROM tf JOIN df USING (word), st WHERE word IN ('the', 'ering', 'erst') GROUP BY doc_id)
"""


@query(f"WITH {_BM25} SELECT doc_id, round(s, 6) AS bm25 FROM b QUALIFY row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) <= 50")
def bm25_topk(spark, sf_dir):
    docs = lambda: read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc_key"), F.lit("").alias("title_text"), X.normalise(F.col("text")).alias("search_text"), F.lit(None).cast("string").alias("enrich_norm"))
    return the_text_index(spark, sf_dir, "documents", docs).scores(["the", "ering", "erst"]).select(F.col("doc_key").alias("doc_id"), F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(50)


@query(f"""
    WITH {_idx('part')}, p AS (SELECT record_id, len(ws) AS len, unnest(ws) AS word FROM (SELECT record_id, string_split(trim(title_text || ' ' || search_text), ' ') AS ws FROM idx)),
    tf AS (SELECT record_id, word, (SELECT 0) AS z, count(*) AS tf FROM p WHERE word <> '' GROUP BY record_id, word),
    ln_ AS (SELECT record_id, sum(tf) AS len FROM tf GROUP BY record_id), df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), st AS (SELECT count(*) AS n, avg(len) AS a FROM ln_),
    b AS (SELECT record_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS s FROM tf JOIN ln_ USING (record_id) JOIN df USING (word), st WHERE word IN ('red', 'widget') GROUP BY record_id),
    r AS (SELECT record_id, round({_score('red')} + {_score('widget')} + CASE WHEN starts_with(title_text, ' red widget') THEN 4 ELSE 0 END + 2 * coalesce(s, 0), 6) AS score, title_text
          FROM idx LEFT JOIN b USING (record_id) WHERE contains(search_text, ' red') AND contains(search_text, ' widget'))
    SELECT record_id, score, CAST(row_number() OVER (ORDER BY score DESC, length(title_text), record_id) AS INTEGER) AS rank FROM r QUALIFY rank <= 10
""")
def text_with_bm25(spark, sf_dir):
    idx = the_index(spark, sf_dir, "part")
    plan = parse("red widget", groups=[])
    found = search.text_search(idx, plan, 1 << 30, text_index=the_text_index(spark, sf_dir, "part", lambda: idx)).select("src_table", "record_id", "title_text", F.round("score", 6).alias("score"))
    order = [F.col("score").desc(), F.length("title_text"), F.col("record_id")]
    return search.top_per_table(found, order, 10).select("record_id", "score", "rank")


def _jw(word: str) -> str:
    return f"list_max(list_transform(string_split(trim(title_text), ' '), lambda t: jaro_winkler_similarity(t, '{word}')))"


@query(f"""
    WITH {_idx('part', 'customer')}, s AS (SELECT src_table, record_id, title_text, round(greatest(jaro_winkler_similarity(trim(title_text), 'rde widgte'), jaro_winkler_similarity(replace(title_text, ' ', ''), 'rdewidgte'),
        least(CASE WHEN list_contains(string_split(trim(title_text), ' '), 'rde') THEN 1.0 ELSE 0.0 END, {_jw('widgte')})), 9) AS sim FROM idx
        WHERE length(title_text) > 2 AND ((contains(title_text, ' r') AND contains(title_text, ' w')) OR starts_with(replace(title_text, ' ', ''), 'rd')))
    SELECT src_table, record_id, sim, CAST(row_number() OVER (PARTITION BY src_table ORDER BY sim DESC, length(title_text), record_id) AS INTEGER) AS rank FROM s WHERE sim >= 0.8 QUALIFY rank <= 5
""")
def fuzzy_names(spark, sf_dir):
    return rank.fuzzy_search(the_index(spark, sf_dir, "part", "customer"), [["rde"], ["widgte"]], floor=0.8).select("src_table", "record_id", F.round("sim", 9).alias("sim"), "rank")


@query("""
    SELECT p_name, round(jaro_winkler_similarity(p_name, 'green gadget'), 9) AS sim FROM (SELECT DISTINCT p_name FROM part)
""")
def jaro_winkler(spark, sf_dir):
    score = _jw_to("green gadget")
    return read(spark, sf_dir, "part").select("p_name").distinct().select("p_name", F.round(score("p_name"), 9).alias("sim"))


def _jw_to(word):
    import pandas as pd

    from quarry.functions.similarity import jaro_winkler_all

    def score(s: pd.Series) -> pd.Series:
        return pd.Series(jaro_winkler_all(list(s), word))

    score.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(score, "double")


# --- Vectors ------------------------------------------------------------------------------

def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    key = F.when(F.col("vec_id") % 5 == 0, "old").otherwise("now")
    return e.select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("src_table"), F.col("vec_id").cast("string").alias("record_id"), key.alias("vec_key"), F.col("embedding").alias("vec"))


_VEC = "v AS (SELECT 't' || label AS src_table, CAST(vec_id AS VARCHAR) AS record_id, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE 'now' END AS vec_key, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_PROBE = [round(((i * 37) % 64 - 32) / 50, 6) for i in range(64)]


@query(f"""
    WITH {_VEC}, s AS (SELECT src_table, record_id, round(list_cosine_similarity(vec, CAST({_PROBE} AS DOUBLE[])), 9) AS sim FROM v WHERE vec_key = 'now'),
    r AS (SELECT *, row_number() OVER (PARTITION BY src_table ORDER BY sim DESC, record_id) AS rank FROM s)
    SELECT src_table, record_id, sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5 AND sim >= 0.05 AND CAST(record_id AS BIGINT) % 11 <> 0
""")
def vector_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    idx = v.select("src_table", "record_id", F.lit("{}").alias("display"), F.lit(" x ").alias("title_text")).where(F.col("record_id").cast("long") % 11 != 0)
    return rank.vector_search(v, idx, _PROBE, "now", 5, 0.05).select("src_table", "record_id", F.round("sim", 9).alias("sim"), "rank")


@query("""
    WITH u AS (SELECT vec_id, CAST(embedding[1:48] AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM u)
    SELECT vec_id, round(v[1] / n, 9) AS first, round(v[48] / n, 9) AS last, CAST(len(v) AS INTEGER) AS dims FROM n
""")
def vector_normalize(spark, sf_dir):
    u = read(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding"), 48).alias("u"))
    return u.select("vec_id", F.round(F.get("u", F.lit(0)), 9).alias("first"), F.round(F.get("u", F.lit(47)), 9).alias("last"), F.size("u").alias("dims"))


def _vector_index(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    schema = index.SCHEMA
    rows = e.select(F.concat(F.lit("t"), F.col("label").cast("string")).alias("src_table"), F.col("vec_id").cast("string").alias("record_id"), F.concat(F.lit("id: "), F.col("vec_id").cast("string")).alias("source_text"),
                    F.when(F.col("vec_id") % 3 == 0, "k").alias("enrich_key"), F.when(F.col("vec_id") % 3 == 0, "a note").alias("enrich_text"))
    return changes.add_missing(rows, schema)


_VIDX = f"{_VEC}, idx AS (SELECT src_table, record_id, 'id: ' || record_id AS source_text, CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN 'a note' END AS enrich_text FROM v), w AS (SELECT * FROM v WHERE CAST(record_id AS BIGINT) % 4 <> 0)"


@query(f"WITH {_VIDX} SELECT i.src_table, i.record_id FROM idx i LEFT JOIN w USING (src_table, record_id) WHERE w.vec_key IS DISTINCT FROM 'now'")
def vector_stale(spark, sf_dir):
    w = _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0)
    return changes.needing_vectors(_vector_index(spark, sf_dir), w, "now").select("src_table", "record_id")


@query(f"WITH {_VIDX} SELECT v.src_table, v.record_id FROM v WHERE EXISTS (SELECT 1 FROM idx i WHERE i.src_table = v.src_table AND i.record_id = v.record_id AND CAST(i.record_id AS BIGINT) % 2 = 0)")
def orphan_prune(spark, sf_dir):
    live = _vector_index(spark, sf_dir).where(F.col("record_id").cast("long") % 2 == 0)
    return changes.prune_vectors(_vectors(spark, sf_dir), live).select("src_table", "record_id")


@query(f"WITH {_VIDX} SELECT i.src_table, CAST(count(*) AS BIGINT) AS rows, round(avg(length(source_text) + coalesce(length(enrich_text), 0)), 6) AS chars, round((count(*) * (avg(length(source_text) + coalesce(length(enrich_text), 0)) / 4 + 8) * 19999.0) / 1e6, 2) AS cost FROM idx i LEFT JOIN w USING (src_table, record_id) WHERE w.vec_key IS DISTINCT FROM 'now' GROUP BY i.src_table")
def pass_estimate(spark, sf_dir):
    w = _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0)
    est = stages.pass_estimate(_vector_index(spark, sf_dir), w, "now")
    return est.select("src_table", "rows", F.round("chars", 6).alias("chars"), stages.cost(F.col("rows"), F.col("chars"), 19999.0, 8).alias("cost"))


@query(f"WITH {_VIDX}, e AS (SELECT src_table, count(*) AS n FROM w WHERE vec_key = 'now' GROUP BY src_table) SELECT src_table, CAST(count(*) AS BIGINT) AS rows, CAST(count(enrich_text) AS BIGINT) AS enriched, CAST(least(count(*), coalesce(any_value(n), 0)) AS BIGINT) AS embedded FROM idx LEFT JOIN e USING (src_table) GROUP BY src_table")
def coverage(spark, sf_dir):
    w = _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0)
    return stages.coverage(_vector_index(spark, sf_dir), w, "now")


@query("SELECT 'now' AS vec_key, CAST(count(*) AS BIGINT) AS rows FROM embeddings")
def embed_stage(spark, sf_dir):
    """Stale records embedded by the offline embedder."""
    idx = _vector_index(spark, sf_dir)
    out = stages.embed(idx, _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0), stages.hashing_embedder(64), "now", cap=0)
    return out.groupBy("vec_key").agg(F.count(F.lit(1)).alias("rows"))


# --- Fusion -------------------------------------------------------------------------------

@query(f"""
    WITH {_idx('part', 'supplier')}, x AS (SELECT src_table, record_id, title_text, row_number() OVER (PARTITION BY src_table ORDER BY {_score('red')} + {_score('widget')} + CASE WHEN starts_with(title_text, ' red widget') THEN 4 ELSE 0 END DESC, length(title_text), record_id) AS rank
        FROM idx WHERE contains(search_text, ' red') AND contains(search_text, ' widget')),
    s AS (SELECT src_table, record_id, title_text, greatest(jaro_winkler_similarity(trim(title_text), 'red widget'), jaro_winkler_similarity(replace(title_text, ' ', ''), 'redwidget'),
        least(CASE WHEN list_contains(string_split(trim(title_text), ' '), 'red') THEN 1.0 ELSE 0.0 END, {_jw('widget')})) AS sim FROM idx
        WHERE length(title_text) > 2 AND ((contains(title_text, ' r') AND contains(title_text, ' w')) OR starts_with(replace(title_text, ' ', ''), 're'))),
    z AS (SELECT *, row_number() OVER (PARTITION BY src_table ORDER BY sim DESC, length(title_text), record_id) AS rank FROM s WHERE sim >= 0.8),
    u AS (SELECT src_table, record_id, title_text, 3.0 / (60 + rank) AS w FROM x WHERE rank <= 8 UNION ALL SELECT src_table, record_id, title_text, 1.0 / (60 + rank) FROM z WHERE rank <= 8),
    f AS (SELECT src_table, record_id, any_value(title_text) AS title_text, sum(w) AS fused FROM u GROUP BY src_table, record_id)
    SELECT src_table, record_id, round(fused, 9) AS fused, CAST(row_number() OVER (PARTITION BY src_table ORDER BY round(fused, 9) DESC, length(title_text), record_id) AS INTEGER) AS rank FROM f
""")
def rrf_fusion(spark, sf_dir):
    idx, plan = the_index(spark, sf_dir, "part", "supplier"), parse("red widget", groups=[])
    fused = rank.fuse(exact=search.text_search(idx, plan, 8), fuzzy=rank.fuzzy_search(idx, rank.spellings(plan), 8, 0.8))
    fused = fused.withColumn("fused", F.round("fused", 9)).drop("rank")
    return search.top_per_table(fused, [F.desc("fused"), F.length("title_text"), F.col("record_id")], 1 << 30).select("src_table", "record_id", "fused", "rank")


@query(f"""
    WITH {_idx()}, r AS (SELECT src_table, record_id, CASE WHEN list_contains(nums, 25) THEN 3 ELSE 2 END AS score, row_number() OVER (PARTITION BY src_table ORDER BY CASE WHEN list_contains(nums, 25) THEN 3 ELSE 2 END DESC, length(title_text), record_id) AS rank
        FROM idx WHERE list_contains(nums, 25) OR contains(search_text, ' 25 '))
    SELECT src_table, record_id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (ORDER BY rank, score DESC, src_table) AS INTEGER) AS position FROM r WHERE rank <= 5
""")
def balanced_topk(spark, sf_dir):
    found = search.text_search(the_index(spark, sf_dir), parse("25"), 5)
    return rank.balance(found, 5, "score").select("src_table", "record_id", "score", "rank", "position")


@query()
def engine_search(spark, sf_dir):
    """The whole front door: exact, fuzzy, fused, balanced, with reasons."""
    from quarry.engine import Engine

    e = Engine(the_index(spark, sf_dir, "part", "customer", "supplier"), stages=Stages(fuzzy_floor=0.8))
    return e.search("red widgte", limit=5).select("position", "src_table", "record_id", "kinds", "rank", "why")


# --- Changes ------------------------------------------------------------------------------

def _halves(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    h = lambda d: d.withColumn("content_hash", F.md5(F.concat_ws("|", "o_orderkey", "o_orderstatus")))
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return h(old), h(new)


_HALVES = "old AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0)"


@query(f"WITH {_HALVES} SELECT o_orderkey, CASE WHEN old.o_orderstatus IS NULL THEN 'insert' WHEN new.o_orderstatus IS NULL THEN 'delete' WHEN old.o_orderstatus = new.o_orderstatus THEN 'unchanged' ELSE 'update' END AS change FROM old FULL JOIN new USING (o_orderkey)")
def diff_changes(spark, sf_dir):
    return changes.diff(*_halves(spark, sf_dir), ["o_orderkey"])


@query(f"WITH {_HALVES} SELECT o_orderkey, o_orderstatus FROM new UNION ALL SELECT o_orderkey, o_orderstatus FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.o_orderkey = old.o_orderkey)")
def upsert_changed(spark, sf_dir):
    old, new = _halves(spark, sf_dir)
    return changes.upsert(old, new, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(f"WITH {_HALVES} SELECT o_orderkey FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.o_orderkey = old.o_orderkey)")
def gone_rows(spark, sf_dir):
    return changes.gone(*_halves(spark, sf_dir), ["o_orderkey"]).select("o_orderkey")


@query(f"WITH {_HALVES} SELECT new.o_orderkey FROM new LEFT JOIN old USING (o_orderkey) WHERE old.o_orderstatus IS DISTINCT FROM new.o_orderstatus")
def changed_rows(spark, sf_dir):
    return changes.changed(*_halves(spark, sf_dir), ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01'")
def watermark_incremental(spark, sf_dir):
    return changes.since(read(spark, sf_dir, "orders"), "o_orderdate", dt.datetime(1997, 1, 1), now=dt.datetime(2024, 1, 1)).select("o_orderkey")


@query("SELECT max(o_orderdate) AS mark FROM orders")
def watermark_mark(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("mark"))


@query("SELECT p_partkey, p_partkey IN (SELECT p_partkey FROM part) AND p_partkey % 2 = 0 AS live FROM (SELECT p_partkey FROM part UNION ALL SELECT -1)")
def key_lookup(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    asked = part.select("p_partkey").unionByName(spark.createDataFrame([(-1,)], "p_partkey long"))
    found, missing = changes.lookup(part.where("p_partkey % 2 = 0"), asked, "p_partkey")
    return found.select("p_partkey", F.lit(True).alias("live")).unionByName(missing.select("p_partkey", F.lit(False).alias("live")))


@query(f"WITH {_VIDX} SELECT src_table, record_id, CASE WHEN CAST(record_id AS BIGINT) % 10 = 1 THEN 'new' ELSE enrich_text END AS enrich_text, CASE WHEN CAST(record_id AS BIGINT) % 10 = 1 THEN 'key' WHEN enrich_text IS NOT NULL THEN 'k' END AS enrich_key FROM idx")
def write_notes(spark, sf_dir):
    idx = _vector_index(spark, sf_dir)
    notes = idx.where(F.col("record_id").cast("long") % 10 == 1).select("src_table", "record_id", F.lit("new").alias("enrich_text"), F.lit(" new ").alias("enrich_norm"))
    return changes.write_notes(idx, notes, "key").select("src_table", "record_id", "enrich_text", "enrich_key")


@query(f"WITH {_VIDX} SELECT src_table, record_id, CASE WHEN src_table <> 't1' THEN enrich_text END AS enrich_text FROM idx")
def clear_notes(spark, sf_dir):
    return changes.clear_notes(_vector_index(spark, sf_dir), _vectors(spark, sf_dir), "t1")[0].select("src_table", "record_id", "enrich_text")


@query(f"WITH {_VIDX} SELECT src_table, record_id FROM idx ORDER BY src_table, record_id LIMIT 100")
def work_queue(spark, sf_dir):
    return changes.work_queue(_vector_index(spark, sf_dir), 100).select("src_table", "record_id")


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_partkey % 4 = 0 THEN 'delete' WHEN p_partkey % 6 = 1 THEN 'update' ELSE 'unchanged' END AS change FROM part")
def sync_table(spark, sf_dir):
    from quarry.engine import Engine

    part = read(spark, sf_dir, "part")
    engine = Engine(the_index(spark, sf_dir, "part", "supplier"))
    live = part.where("p_partkey % 4 <> 0").withColumn("p_name", F.when(F.col("p_partkey") % 6 == 1, "renamed").otherwise(F.col("p_name")))
    return engine.sync("part", live, CONFIGS["part"])[1].select("record_id", "change")


# --- Profiles, logs, evaluation -------------------------------------------------------------

def _profile_sql(table: str, cols: list[str]) -> str:
    one = lambda c: (
        f"SELECT '{c}' AS field, round(coalesce(avg(length(s)) FILTER (f), 0), 6) AS avg_chars, round(coalesce(avg(CASE WHEN regexp_matches(s, '^\\s*[\\[{{]') THEN 1.0 ELSE 0.0 END) FILTER (f), 0), 6) AS json,"
        f" round(avg(CASE WHEN f THEN 0.0 ELSE 1.0 END), 6) AS empty FROM (SELECT CAST({c} AS VARCHAR) AS s, {c} IS NOT NULL AND trim(CAST({c} AS VARCHAR)) <> '' AS f FROM {table})"
    )
    return " UNION ALL ".join(map(one, cols))


@query(_profile_sql("events", ["event_type", "props", "user_id"]))
def profile_columns(spark, sf_dir):
    p = profile.profile(read(spark, sf_dir, "events"), ["event_type", "props", "user_id"])
    return p.select("field", *(F.round(c, 6).alias(c) for c in ("avg_chars", "json", "empty")))


@query("SELECT * FROM (VALUES ('event_type', NULL), ('props', 'JSON')) t(field, why)")
def profile_decisions(spark, sf_dir):
    return profile.decide(profile.profile(read(spark, sf_dir, "events"), ["event_type", "props"])).select("field", "why")


@query("SELECT * FROM (VALUES ('p_name', 1), ('name', 0), ('title', 2), ('description', 8), ('first', 3), ('city', 9), ('email', 4), ('x', 9)) t(field, title_rank)")
def title_ranks(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in ("p_name", "name", "title", "description", "first", "city", "email", "x")], "field string").select("field", profile.title_rank(F.col("field")).alias("title_rank"))


@query("SELECT * FROM (VALUES ('live1', 'f1', 'customer', 4), ('live2', 'f2', 'part', 3)) t(name, file, \"table\", shared)")
def schema_match(spark, sf_dir):
    names = {n: read(spark, sf_dir, n).columns for n in ("customer", "part", "orders", "nation")}
    known = spark.createDataFrame([(f, n, names[n]) for f in ("f1", "f2") for n in names], "file string, table string, fields array<string>")
    live = spark.createDataFrame([("live1", ["C_CUSTKEY", "c_name", "c_acctbal", "c_nationkey", "other"], None), ("live2", ["p_partkey", "P_NAME", "p_size"], "F2"), ("live3", ["n_name", "a", "b"], None)], "name string, fields array<string>, prefer string")
    return profile.match_schema(live, known).withColumn("shared", F.col("shared").cast("int"))


_SEARCHES = "s AS (SELECT event_id AS search_id, CAST(user_id AS VARCHAR) AS query, ts FROM events WHERE event_type = 'view'), c AS (SELECT CAST(user_id AS VARCHAR) AS query, ts AS click_ts, CAST(event_id AS VARCHAR) AS record_id FROM events WHERE event_type = 'click')"


@query(f"WITH {_SEARCHES}, p AS (SELECT search_id, click_ts, record_id, row_number() OVER (PARTITION BY search_id ORDER BY click_ts DESC, record_id DESC) AS rn FROM s JOIN c USING (query) WHERE abs(epoch_us(s.ts) - epoch_us(c.click_ts)) < 600000000) SELECT s.search_id, p.record_id FROM s LEFT JOIN p ON p.search_id = s.search_id AND rn = 1")
def search_click_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("query", F.col("user_id").cast("string"))
    s = e.where("event_type = 'view'").select(F.col("event_id").alias("search_id"), "query", "ts")
    c = e.where("event_type = 'click'").select("query", "ts", F.col("event_id").cast("string").alias("record_id"))
    return evaluate.pair_clicks(s, c).select("search_id", "record_id")


def _results(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("type"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 9 + 1).cast("int")).alias("rank"), F.when(F.col("event_id") % 50 == 0, "timeout").alias("error"), F.col("event_id").cast("string").alias("query"), F.col("value"), F.lit("ai").alias("expect"))


_RESULTS = "r AS (SELECT event_type AS type, CASE WHEN event_id % 4 <> 0 THEN event_id % 9 + 1 END AS rank, CASE WHEN event_id % 50 = 0 THEN 'timeout' END AS error, event_id, value FROM events)"


@query(f"WITH {_RESULTS} SELECT type, CAST(count(*) AS BIGINT) AS runs, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) FILTER (error IS NULL), 6) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) FILTER (error IS NULL), 6) AS hit5, CAST(count(*) FILTER (error IS NULL AND rank IS NULL) AS BIGINT) AS misses, CAST(count(error) AS BIGINT) AS errors FROM r GROUP BY type")
def eval_scores(spark, sf_dir):
    return evaluate.scores(_results(spark, sf_dir), ["type"])


@query("SELECT event_type AS type, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS value FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_rank(spark, sf_dir):
    return evaluate.percentile(_results(spark, sf_dir), "value", 0.9, ["type"])


@query(f"WITH {_RESULTS} SELECT event_type AS type, CAST(event_id AS VARCHAR) AS query FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('1|' || event_id), CAST(event_id AS VARCHAR)) AS turn FROM events) ORDER BY turn, event_type, query LIMIT 23")
def spread_sample(spark, sf_dir):
    return evaluate.spread(_results(spark, sf_dir), "type", 23).select("type", "query")


@query(f"WITH {_RESULTS} SELECT CAST(event_id AS VARCHAR) AS query, rank::INTEGER AS rank FROM r WHERE error IS NULL AND (rank IS NULL OR rank > 1) ORDER BY rank DESC NULLS FIRST, query LIMIT 40")
def worst_misses(spark, sf_dir):
    return evaluate.worst(_results(spark, sf_dir)).select("query", "rank")


@query("SELECT p_partkey, p_brand FROM part ORDER BY md5('3|' || p_partkey || '|' || p_brand), p_partkey, p_brand LIMIT 20")
def random_sample(spark, sf_dir):
    return tables.sample(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), 20, seed=3)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Search the catalogue for a word: the five best records of each table, balanced."""
    found = search.text_search(the_index(spark, sf_dir, "part", "customer", "orders"), parse("red"), 5)
    return rank.balance(rank.why(found, parse("red")), 5, "score").select("position", "src_table", "record_id", "display", "score", "why")
