"""More queries: rules that work on a few strings, files, catalogs, logs, passes and streams, and their SQL."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import Stages, TableConfig
from quarry.functions import text as X
from quarry.operators import changes, evaluate, index, profile, rank, search, stages
from quarry.plans.names import alternates
from quarry.plans.query import Options, describe, parse, undouble
from quarry.queries import _RESULTS, _VIDX, CONFIGS, TODAY, _idx, _results, _vector_index, _vectors, read, the_index
from quarry.sources import tables
from quarry.streaming import flows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = inspect.cleandoc(sql)
        return f

    return add


def told(name: str, schema: str, inputs: list, rule, wanted: list[tuple]) -> None:
    """Register a rule over some inputs: its SQL is the rows that it must give."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def f(spark, sf_dir):
        return spark.createDataFrame([tuple(rule(x)) for x in inputs], schema)

    f.__name__, f.__doc__ = name, f"{name}: the rule over {len(inputs)} inputs."
    lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    kind = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    casts = ", ".join(f"CAST({c} AS {kind[c_.split()[1]]}) AS {c}" for c, c_ in zip(columns, schema.split(", "), strict=True))
    query(f"SELECT {casts} FROM (VALUES {', '.join('(' + ', '.join(map(lit, row)) + ')' for row in wanted)}) t({', '.join(columns)})")(f)


# --- Plans and options ---------------------------------------------------------------------

_ASKED = ["Ann@Example.com", "25", "1995", "5551234567", "+1 (555) 123-4567", "940...945.5", ">48", "<=900.5", "3/1997", "1995-03-04", "month:march", '"red widg" =x *y z', "", "12..3", "@mail3.example.com", ">2020-02"]
told("plans_described", "q string, kind string, said string", _ASKED, lambda q: (q, (p := parse(q, today=TODAY)).kind, describe(p)), [
    ("Ann@Example.com", "email", "email address"), ("25", "number", "number 25"), ("1995", "number", "number 1995, or a date in 1995"), ("5551234567", "number", "number 5551234567, or a phone number"),
    ("+1 (555) 123-4567", "phone", "phone number"), ("940...945.5", "range", "number range: 940 to 945.5"), (">48", "range", "number range: over 48"), ("<=900.5", "range", "number range: 900.5 or less"),
    ("3/1997", "date", "month 1997-03"), ("1995-03-04", "date", "date 1995-03-04"), ("month:march", "month", "March, any year"), ('"red widg" =x *y z', "text", 'words: "red widg", =x, *y, z'), ("", "empty", ""),
    ("12..3", "range", "number range: 3 to 12"), ("@mail3.example.com", "text", "words: mail3, example, com"), (">2020-02", "daterange", "date range: after 2020-02"),
])


def _address(q):
    p = parse(q)
    return q, p.value if p.kind == "email" else None, p.digits


told("plans_of_addresses", "q string, value string, digits string", ["Ann@Example.com", "a@", "+1 (555) 123-4567", "555-01", "555-0100 22"], _address, [
    ("Ann@Example.com", "ann@example.com", None), ("a@", "a@", None), ("+1 (555) 123-4567", None, "15551234567"), ("555-01", None, None), ("555-0100 22", None, "555010022"),
])
told("queries_undoubled", "q string, once string", ["a%2520b", "100%", "%41nn", "%ff", "plain"], lambda q: (q, undouble(q)), [("a%2520b", "a%20b"), ("100%", "100%"), ("%41nn", "Ann"), ("%ff", "%ff"), ("plain", "plain")])
told("options_clamped", "asked string, max_rows int", [0, 99, "x", None, "7", -3], lambda x: (str(x), Options.of(x).limit), [("0", 1), ("99", 20), ("x", 5), ("None", 5), ("7", 7), ("-3", 1)])
told("stages_clamped", "stage string, why string, dims int", ["fuzzy", "semantic", "rerank", "enrich"], lambda s: (s, (o := Stages(semantic=True, rerank=True, dims=9, models={"rerank": "m"}).clamped()).ready(s), o.dims), [("fuzzy", "", 64), ("semantic", "no model", 64), ("rerank", "", 64), ("enrich", "off", 64)])
told("groups_expanded", "name string, also string", ["ann", "anna", "rob", "x"], lambda n: (n, ",".join(alternates([["Ann", "Anna"], ["Rob", "Robert", "Ann"]]).get(n, []))), [("ann", "anna,rob,robert"), ("anna", "ann"), ("rob", "robert,ann"), ("x", "")])

# --- Rules on strings ------------------------------------------------------------------------

@query("SELECT * FROM (VALUES (1, 'one' || chr(10) || 'two'), (2, 'plain'), (3, '')) t(i, note)")
def notes_cleaned(spark, sf_dir):
    rows = spark.createDataFrame([(1, "- one\n\n\n* two"), (2, " plain "), (3, "")], "i int, raw string")
    return rows.select("i", stages.clean_note(F.col("raw")).alias("note"))


@query("SELECT * FROM (VALUES ('429 quota', 'quota'), ('bad api key', 'auth'), ('ETIMEDOUT timeout', 'network'), ('HTTP 503', 'network'), ('boom', 'other')) t(message, kind)")
def error_kinds(spark, sf_dir):
    rows = spark.createDataFrame([(m,) for m in ("429 quota", "bad api key", "ETIMEDOUT timeout", "HTTP 503", "boom")], "message string")
    return rows.select("message", stages.error_kind(F.col("message")).alias("kind"))


told("names_readable", "raw string, label string", ["T_orderLines", "part", "my-table name"], lambda n: (n, X.humanise(n)), [("T_orderLines", "T Order Lines"), ("part", "Part"), ("my-table name", "My Table Name")])
told("slugs_unique", "raw string, slug string", ["A b", "a-b", "Ünder", "--"], lambda n: (n, X.slugs([(x, "Orders" if x == "a-b" else None) for x in ("A b", "a-b", "Ünder", "--")])[n]), [("A b", "a-b"), ("a-b", "orders"), ("Ünder", "under"), ("--", "table")])
told("keys_chosen", "fields string, key string", ["ROWID name cust_id", "a b", "x hinted", "id row_uuid", "ROWID"], lambda s: (s, profile.choose_key(s.split(), declared="b", hint="hinted")), [("ROWID name cust_id", "cust_id"), ("a b", "b"), ("x hinted", "hinted"), ("id row_uuid", "row_uuid"), ("ROWID", None)])
told("json_found", "answer string, keys int", ['```json\n{"a": 1}\n```', "so: [1, 2] ok", "no", ""], lambda s: (s, -1 if (v := stages.parse_json(s)) is None else len(v)), [('```json\n{"a": 1}\n```', 1), ("so: [1, 2] ok", 2), ("no", -1), ("", -1)])
told("orders_checked", "given string, ids string, sure double", ["b,x,b", "", "c,a"], lambda s: (s, ",".join((o := stages.checked_order(s.split(",") if s else None, ["a", "b", "c"], len(s)))[0]), o[1]), [("b,x,b", "b,a,c", 1.0), ("", "a,b,c", 0.0), ("c,a", "c,a,b", 1.0)])
told("readings_checked", "answer string, query string, tables string", ["ok", "none", "blank"], lambda a: (a, (r := stages.checked_understanding({"ok": {"query": " red ", "tables": ["part", "nowhere"]}, "none": None, "blank": {"query": " "}}[a], ["part"])) and r["query"], r and ",".join(r["tables"])), [("ok", "red", "part"), ("none", None, None), ("blank", None, None)])
told("passes_stopped", "failed int, calls int, stop boolean", [(5, 9), (5, 10), (4, 4), (50, 99)], lambda x: (*x, stages.should_stop(*x)), [(5, 9, True), (5, 10, False), (4, 4, False), (50, 99, True)])
told("increments_allowed", "pk string, mod string, same boolean, increment boolean", [("k", "m", True), ("k", None, True), ("k", "m", False)], lambda x: (*x, changes.can_increment(x[0], x[1], ["a"], ["a"] if x[2] else ["b"])), [("k", "m", True, True), ("k", None, True, False), ("k", "m", False, False)])
told("tables_named", "name string, label string", ["T_people", "T_b"], lambda t: (t, stages.name_tables({"T_people": ["a"], "T_b": ["b"]}, {}, lambda todo: {"T_people": "People"})[t][1]), [("T_people", "People"), ("T_b", "T B")])

@query("SELECT * FROM (VALUES ('p_name', NULL), ('photoUrl', 'media'), ('row_uuid', 'machine keys'), ('CreatedAt', 'bookkeeping'), ('api_secret', 'secrets'), ('description', NULL), ('bodyHTML', 'markup'), ('updated', 'bookkeeping')) t(name, why)")
def columns_left_out(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("p_name", "photoUrl", "row_uuid", "CreatedAt", "api_secret", "description", "bodyHTML", "updated")], "name string")
    return names.select("name", profile.unsearched(F.col("name")).alias("why"))


@query("SELECT 'm' AS model, md5('m|say') AS key")
def enrichment_key(spark, sf_dir):
    return spark.createDataFrame([("m", stages.enrich_key("m", "say"))], "model string, key string")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS none FROM events")
def iso_days(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("event_id", X.iso_day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).cast("string").alias("day"), X.iso_day(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("x"))).cast("string").alias("none"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def tokens_estimated(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", stages.tokens_of(F.col("text")).cast("long").alias("tokens"))


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS record_id, 'Parts. ' || concat_ws('. ', p_name, p_brand, p_type, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END, CAST(p_size AS VARCHAR)) AS embedded
    FROM part
""")
def texts_to_embed(spark, sf_dir):
    return the_index(spark, sf_dir, "part").select("record_id", stages.embed_text("Parts", F.col("source_text")).alias("embedded"))


_MID = "CAST(floor(length(w) / 2) AS INTEGER)"


@query(f"""
    WITH t AS (SELECT DISTINCT p_name AS w FROM part), m AS (SELECT w, {_MID} AS mid, length(w) AS n FROM t)
    SELECT w, substr(w, 1, mid - 1) || substr(w, mid + 1, 1) || substr(w, mid, 1) || substr(w, mid + 2, n) AS swap, substr(w, 1, mid - 1) || substr(w, mid + 1, n) AS "drop",
        substr(w, 1, mid) || substr(w, mid, n) AS double, translate(w, 'aeiou', 'eioua') AS vowel, substr(w, 1, mid) || ' ' || substr(w, mid + 1, n) AS split, replace(w, ' ', '') AS "join" FROM m
""")
def words_mistyped(spark, sf_dir):
    w = read(spark, sf_dir, "part").select(F.col("p_name").alias("w")).distinct()
    return w.select("w", *(c.alias(k) for k, c in evaluate.typos(F.col("w")).items()))


@query("SELECT * FROM (VALUES (1, 'number'), (2, 'email'), (3, 'prose'), (4, 'date'), (5, 'phone'), (6, 'name'), (7, 'text')) t(i, role)")
def field_roles(spark, sf_dir):
    rows = spark.createDataFrame([(1, 0.9, 0.0, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 0.9, 0.0, 1.0), (3, 0.0, 0.0, 0.0, 0.0, 30.0), (4, 0.9, 0.8, 0.0, 0.0, 1.0), (5, 0.9, 0.0, 0.0, 0.7, 1.0), (6, 0.1, 0.0, 0.0, 0.0, 2.0), (7, 0.0, 0.0, 0.0, 0.0, 8.0)], "i int, n double, d double, e double, p double, w double")
    return rows.select("i", evaluate.field_role(*(F.col(c) for c in "ndepw")).alias("role"))


@query("SELECT * FROM (VALUES ('phone', 'people'), ('number,date', 'transactions'), ('number,name', 'catalogue'), ('prose', 'documents'), ('name', 'other')) t(roles, kind)")
def table_kinds(spark, sf_dir):
    rows = spark.createDataFrame([(r,) for r in ("phone", "number,date", "number,name", "prose", "name")], "roles string")
    return rows.select("roles", evaluate.table_kind(F.split("roles", ",")).alias("kind"))


@query("SELECT p_partkey, starts_with(p_name, 're') OR contains(p_name, ' re') AS found FROM part")
def prefixes_found(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    return part.select("p_partkey", evaluate.prefix_found(F.split("p_name", " "), F.array(F.lit("re")), F.create_map().cast("map<string,array<string>>")).alias("found"))


@query("SELECT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS k, CAST(NULL AS VARCHAR) AS email, CASE WHEN l_orderkey % 2 = 0 THEN CAST(5550000000 + l_orderkey AS VARCHAR) END AS phone FROM lineitem WHERE l_linenumber = 1")
def phones_typed(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    t = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("+"), (F.col("l_orderkey") + 5550000000).cast("string"))).otherwise("12-3")
    return rows.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("k"), X.email_of(t).alias("email"), X.phone_of(t).alias("phone"))


# --- The typed search, what hits -------------------------------------------------------------

_YEAR_HITS = "list_filter(dates, lambda x: x BETWEEN DATE '1995-01-01' AND DATE '1995-12-31')"


@query(f"""
    WITH {_idx('orders')}, r AS (SELECT record_id, array_to_string(list_transform({_YEAR_HITS}, lambda x: CAST(x AS VARCHAR)), ',') AS hits, CASE WHEN contains(search_text, ' 1995 ') THEN 2 ELSE 0 END + CASE WHEN len({_YEAR_HITS}) > 0 THEN 1 ELSE 0 END AS score, length(title_text) AS n
        FROM idx WHERE (len({_YEAR_HITS}) > 0 OR contains(search_text, ' 1995 ')) AND NOT list_contains(nums, 1995))
    SELECT record_id, hits FROM r ORDER BY score DESC, n, record_id LIMIT 15
""")
def hits_listed(spark, sf_dir):
    found = search.text_search(the_index(spark, sf_dir, "orders").where(~F.array_contains("nums", 1995.0)), parse("1995"), 15)
    return found.select("record_id", F.array_join("hits", ",").alias("hits"))


@query("""
    WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS record_id, CAST(5550000000 + o_orderkey AS VARCHAR) AS d, ' ' || CAST(5550000000 + o_orderkey AS VARCHAR) || ' ' AS t FROM orders)
    SELECT record_id, CAST((CASE WHEN d = '5550000012' THEN 2 + 3 ELSE 1 END) AS DOUBLE) AS score FROM r WHERE contains(t, '5550000012') ORDER BY score DESC, record_id LIMIT 5
""")
def number_digit_overlay(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("+"), (F.col("o_orderkey") + 5550000000).cast("string")).alias("phone"))
    idx = index.build(orders, "orders", TableConfig("o_orderkey", ("phone",), ("phone",)))
    return search.text_search(idx, parse("5550000012"), 5).select("record_id", "score")


@query(f"""
    WITH {_idx('supplier')}, h AS (SELECT src_table, record_id FROM idx WHERE contains(search_text, ' supplier') AND contains(search_text, ' 000000007') AND contains(title_text, ' supplier') AND contains(title_text, ' 000000007'))
    SELECT * FROM h WHERE (SELECT count(*) FROM h) = 1
""")
def best_record(spark, sf_dir):
    plan = parse("supplier 000000007")
    return rank.best(search.text_search(the_index(spark, sf_dir, "supplier"), plan), plan).select("src_table", "record_id")


@query("SELECT * FROM (VALUES ('it''s 100% _x', TRUE), ('other', FALSE)) t(text, found)")
def literals_matched(spark, sf_dir):
    rows = spark.createDataFrame([("it's 100% _x",), ("other",)], "text string")
    return rows.select("text", (X.level(F.col("text"), "100% _x") > 0).alias("found"))


# --- Files, catalogs, logs ---------------------------------------------------------------------

told("columns_typed", "name string, type string", [0, 1, 2], lambda i: ((f := tables.schema_of([("id", "String"), ("price", "Decimal"), ("on", "Date"), ("pic", "Binary"), ("mod", "DateTimeOffset")], ["price", "pic"], always=("id", "mod")).fields[i]).name, f.dataType.simpleString()), [("id", "string"), ("price", "double"), ("mod", "timestamp_ntz")])


@query("SELECT n_nationkey, n_name FROM nation")
def json_loaded(spark, sf_dir):
    path = tables.scratch_path(spark, "json")
    read(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value")).coalesce(1).write.text(path)
    return tables.read_json(spark, path, T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())]))


@query("SELECT n_nationkey, n_name || ' \"x\",' AS n_name, n_regionkey FROM nation")
def csv_loaded(spark, sf_dir):
    path = tables.scratch_path(spark, "csv")
    nation = read(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit(' "x",')))
    nation.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_csv(spark, path)


@query("SELECT r_regionkey, r_name FROM region WHERE FALSE")
def table_emptied(spark, sf_dir):
    return tables.empty(spark, read(spark, sf_dir, "region").schema)


def _catalog(spark, sf_dir, name: str) -> tables.Catalog:
    cat = tables.Catalog(spark, tables.scratch_path(spark, name))
    cat.replace("nation", read(spark, sf_dir, "region"))  # replaced below: nothing of it stays
    for t in ("nation", "region", "supplier"):
        cat.replace(t, read(spark, sf_dir, t))
    cat.keep(["nation", "region"])
    return cat


@query("SELECT * FROM (VALUES ('nation', 'n_nationkey', 1, 'int'), ('nation', 'n_name', 2, 'string'), ('nation', 'n_regionkey', 3, 'int'), ('region', 'r_regionkey', 1, 'int'), ('region', 'r_name', 2, 'string')) t(\"table\", \"column\", place, type)")
def catalog_columns(spark, sf_dir):
    return spark.createDataFrame(_catalog(spark, sf_dir, "catalog").columns(), "table string, column string, place int, type string")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalogs_joined(spark, sf_dir):
    one, other = _catalog(spark, sf_dir, "one"), _catalog(spark, sf_dir, "other")
    return one.table("nation").join(other.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT * FROM (SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region)")
def tables_counted(spark, sf_dir):
    cat = _catalog(spark, sf_dir, "counts")
    return spark.createDataFrame(sorted(tables.counts({n: cat.table(n) for n in cat.names()}).items()), "name string, rows long")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 9")
def log_tail(spark, sf_dir):
    path = tables.scratch_path(spark, "log")
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    tables.append_log(e.where("event_id % 2 = 0"), path)
    tables.append_log(e.where("event_id % 2 = 1"), path)
    return tables.tail(spark, path, e.schema, 9, "event_id")


@query("SELECT 'f' AS file, 'T' AS \"table\", 'a & b' AS name, 'Text' AS type, 'c' AS comment UNION ALL SELECT 'f', 'T', 'z', 'Number', NULL")
def catalogue_read(spark, sf_dir):
    path = tables.scratch_path(spark, "xml")
    xml = '<Files><Field file="f" table="T" name="a &amp; b" type="Text" comment="c"/><Field file="f" table="T" name="z" type="Number"/></Files>'
    spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(path)
    return tables.read_catalogue(spark, path)


@query(
    """SELECT 'f' AS file, 'orders' AS "table", 'sold' AS comment, 'order_id' AS key, 'serial' AS key_kind, 'changed' AS modified, NULL AS created, 'order_id,total,changed' AS fields
    UNION ALL SELECT 'f', 'lines', NULL, 'line', 'unique', NULL, NULL, 'note,line'"""
)
def schema_exports(spark, sf_dir):
    from quarry.sources import schema_export

    path = tables.scratch_path(spark, "export")
    xml = (
        '<FMSaveAsXML File="f"><BaseTable name="orders" comment="sold"/><C><BaseTableReference name="orders"/><ObjectList><Field name="order_id" datatype="Number"><AutoEnter type="SerialNumber"/></Field>'
        '<Field name="total" datatype="Number"/><Field name="changed" datatype="Timestamp"><AutoEnter type="ModificationTimestamp"/></Field></ObjectList></C>'
        '<C><BaseTableReference name="lines"/><ObjectList><Field name="note"/><Field name="line"><Validation unique="True" notEmpty="True"/></Field></ObjectList></C></FMSaveAsXML>'
    )
    spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(path)
    return schema_export.read_exports(spark, f"{path}/part-*").withColumn("fields", F.array_join("fields.name", ","))


@query("SELECT * FROM (VALUES ('c', 'alpha'), ('T_orderLines', 'T Order Lines'), ('b', 'Zed')) t(name, label)")
def names_displayed(spark, sf_dir):
    return profile.display_names(spark.createDataFrame([("T_orderLines", None, " "), ("b", "Zed", None), ("c", None, "alpha")], "name string, saved string, proposed string"))


# --- Changes --------------------------------------------------------------------------------

@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0")
def deletes_detected(spark, sf_dir):
    held = read(spark, sf_dir, "orders")
    live = held.where("o_orderkey % 5 <> 0")
    return changes.detect_deletes(held, live.select("o_orderkey"), live.count(), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE FALSE")
def deletes_not_looked_for(spark, sf_dir):
    held = read(spark, sf_dir, "orders")
    return changes.detect_deletes(held, held.where("o_orderkey % 5 <> 0").select("o_orderkey"), held.count(), "o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'saved' WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS n_name, n_regionkey FROM nation")
def saved_wins(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    saved = nation.where("n_nationkey % 2 = 0 or n_nationkey % 3 = 0").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, "saved").alias("n_name"))
    return profile.merge_saved(nation, saved, "n_nationkey")


@query("SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, coalesce(b.n_name, a.n_name) AS n_name FROM (SELECT * FROM nation WHERE n_nationkey % 2 = 0) a FULL JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'new' END AS n_name FROM nation WHERE n_nationkey % 3 = 0) b USING (n_nationkey)")
def manifests_merged(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    new = nation.where("n_nationkey % 3 = 0").withColumn("n_name", F.when(F.col("n_nationkey") % 4 == 0, "new"))
    return changes.manifest_merge(nation.where("n_nationkey % 2 = 0"), new, "n_nationkey")


@query("SELECT s_suppkey, CAST(NULL AS VARCHAR) AS note FROM supplier")
def columns_added(spark, sf_dir):
    return changes.add_missing(read(spark, sf_dir, "supplier"), T.StructType([T.StructField("s_suppkey", T.LongType()), T.StructField("note", T.StringType())]))


@query(f"WITH {_idx()} SELECT src_table, record_id FROM idx WHERE src_table IN ('part', 'supplier')")
def tables_kept(spark, sf_dir):
    return changes.keep_configured(the_index(spark, sf_dir), ["part", "supplier"]).select("src_table", "record_id")


@query(f"WITH {_VIDX} SELECT record_id, src_table || '|' || record_id AS doc_key FROM idx")
def keys_filled(spark, sf_dir):
    return changes.fill_keys(_vector_index(spark, sf_dir)).select("record_id", "doc_key")


@query("SELECT CAST(64 AS INTEGER) AS dims, CAST(count(*) AS BIGINT) AS rows FROM embeddings UNION ALL SELECT 32, 0")
def vectors_refitted(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return changes.fit_vectors(v, 64).agg(F.lit(64).alias("dims"), F.count(F.lit(1)).alias("rows")).unionByName(changes.fit_vectors(v, 32).agg(F.lit(32).alias("dims"), F.count(F.lit(1)).alias("rows")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id, CASE WHEN p_partkey % 2 = 0 THEN 'delete' ELSE 'update' END AS change FROM part WHERE p_partkey <= 900")
def many_records_changed(spark, sf_dir):
    from quarry.engine import Engine

    part = read(spark, sf_dir, "part")
    keys = [r[0] for r in part.where("p_partkey <= 900").select(F.col("p_partkey").cast("string")).collect()]
    live = part.where("p_partkey % 2 = 1").withColumn("p_name", F.lit("renamed"))
    return Engine(the_index(spark, sf_dir, "part")).records_changed("part", live, CONFIGS["part"], keys)[1].select("record_id", "change")


@query("SELECT src_table FROM (VALUES ('customer'), ('orders'), ('part'), ('supplier')) t(src_table)")
def tables_indexed(spark, sf_dir):
    return the_index(spark, sf_dir).select("src_table").distinct()


# --- Passes, estimates, evaluation -----------------------------------------------------------

@query(f"""
    WITH {_VIDX}, e AS (SELECT src_table, count(*) AS n FROM w WHERE vec_key = 'now' GROUP BY src_table),
    c AS (SELECT src_table, CAST(count(*) AS BIGINT) AS rows, CAST(count(enrich_text) AS BIGINT) AS enriched, CAST(least(count(*), coalesce(any_value(n), 0)) AS BIGINT) AS embedded FROM idx LEFT JOIN e USING (src_table) GROUP BY src_table)
    SELECT * FROM c UNION ALL SELECT NULL, CAST(sum(rows) AS BIGINT), CAST(sum(enriched) AS BIGINT), CAST(sum(embedded) AS BIGINT) FROM c
""")
def coverage_totals(spark, sf_dir):
    return stages.coverage(_vector_index(spark, sf_dir), _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0), "now", totals=True)


@query(f"""
    WITH {_VIDX}, n AS (SELECT i.src_table, count(*) AS rows, avg(length(source_text) + coalesce(length(enrich_text), 0)) AS chars FROM idx i LEFT JOIN w USING (src_table, record_id) WHERE w.vec_key IS DISTINCT FROM 'now' GROUP BY i.src_table),
    e AS (SELECT src_table, count(*) AS held FROM w WHERE vec_key = 'now' GROUP BY src_table), t AS (SELECT DISTINCT src_table FROM idx)
    SELECT src_table, CAST(coalesce(held, 0) AS BIGINT) AS held, CAST(coalesce(rows, 0) AS BIGINT) AS rows, round(coalesce(rows, 0) * (coalesce(chars, 0) / 4 + 8) * 19999.0 / 1e6, 2) AS cost FROM t LEFT JOIN n USING (src_table) LEFT JOIN e USING (src_table)
""")
def estimates_priced(spark, sf_dir):
    from quarry.engine import Engine

    v = _vectors(spark, sf_dir).where(F.col("record_id").cast("long") % 4 != 0)
    return Engine(_vector_index(spark, sf_dir), v).estimate("now", {"small": 19999.0}, "small").drop("chars")


@query(f"WITH {_VIDX} SELECT src_table, record_id, 'say' || chr(10) || substr('id: ' || record_id, 1, 2) AS enrich_text, md5('m|say') AS enrich_key FROM idx WHERE src_table IN ('t1', 't2')")
def enrich_stage(spark, sf_dir):
    client = lambda prompt, texts: [f"- {prompt}\n\n* {t[:2]}" for t in texts]
    return stages.enrich(_vector_index(spark, sf_dir), client, "m", {"t1": "say", "t2": "say"}, cap=0).select("src_table", "record_id", "enrich_text", "enrich_key")


@query(f"WITH {_VIDX} SELECT src_table, record_id, 'say' AS enrich_text FROM idx WHERE src_table = 't1' ORDER BY src_table, record_id LIMIT 30")
def enrich_pass(spark, sf_dir):
    saved = []
    done = stages.enrich_pass(_vector_index(spark, sf_dir), lambda prompt, texts: [prompt] * len(texts), "m", {"t1": "say"}, saved.append, cap=30)
    out = saved[0]
    for more in saved[1:]:
        out = out.unionByName(more)
    return out.where(F.lit(not done.stopped)).select("src_table", "record_id", "enrich_text")


@query("SELECT CAST(count(*) AS BIGINT) AS tables, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM (SELECT n_regionkey, count(*) AS n, sum(n_nationkey) AS k FROM nation GROUP BY n_regionkey)")
def run_summary(spark, sf_dir):
    per = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("t")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("k"))
    return evaluate.run_summary(per)


@query(f"WITH {_RESULTS} SELECT type, round(avg(CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END) FILTER (error IS NULL AND event_id % 2 = 0), 6) AS best_ok FROM r GROUP BY type")
def best_scores(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("record_id", F.col("query"))
    r = r.withColumn("best", F.when(F.col("query").cast("long") % 2 == 0, F.when(F.col("query").cast("long") % 3 == 0, F.col("record_id")).otherwise("x")))
    return evaluate.scores(r, ["type"]).select("type", "best_ok")


@query(f"WITH {_RESULTS}, a AS (SELECT type, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS h1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS h5 FROM r WHERE error IS NULL GROUP BY type), b AS (SELECT type, avg(CASE WHEN rank <= 2 THEN 1.0 ELSE 0.0 END) AS h1, avg(CASE WHEN rank <= 6 THEN 1.0 ELSE 0.0 END) AS h5 FROM r WHERE error IS NULL GROUP BY type) SELECT type, round(100 * (round(b.h1, 6) - round(a.h1, 6)), 1) AS hit1_points, round(100 * (round(b.h5, 6) - round(a.h5, 6)), 1) AS hit5_points FROM a JOIN b USING (type)")
def runs_compared(spark, sf_dir):
    r = _results(spark, sf_dir)
    return evaluate.compare(r, r.withColumn("rank", F.when(F.col("rank") > 1, F.col("rank") - 1).otherwise(F.col("rank"))), ["type"])


@query("SELECT n_regionkey AS case_id, CAST(min(CASE WHEN contains(n_name, '1') THEN n_nationkey END) AS INTEGER) AS rank FROM nation GROUP BY n_regionkey")
def cases_hit(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    cases = nation.select(F.col("n_regionkey").alias("case_id")).distinct().select("case_id", F.lit("t").alias("table"), F.array(F.lit("1")).alias("expect"))
    found = nation.select(F.col("n_regionkey").alias("case_id"), F.lit("t").alias("src_table"), F.col("n_nationkey").alias("rank"), F.col("n_name").alias("display"))
    return evaluate.hit_rank(found, cases).select("case_id", "rank")


@query("SELECT DISTINCT event_type AS \"table\", CAST(user_id % 7 AS VARCHAR) AS id, 'k' AS type, 'q' || (user_id % 3) AS query FROM events")
def queries_distinct(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    typed = F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string"))
    return evaluate.distinct_queries(e.select(F.col("event_type").alias("table"), (F.col("user_id") % 7).cast("string").alias("id"), F.lit("k").alias("type"), typed.alias("query")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS record_id FROM part ORDER BY md5('5|part|' || p_partkey), p_partkey::VARCHAR LIMIT 12")
def engine_sample(spark, sf_dir):
    idx = the_index(spark, sf_dir, "part").select("src_table", "record_id")
    return tables.sample(idx, 12, 5).select("record_id")


# --- Streams --------------------------------------------------------------------------------

@query("SELECT user_id, CAST(count(*) AS BIGINT) AS events, max(event_id) AS last FROM events GROUP BY user_id")
def stream_maintained(spark, sf_dir):
    """Change events in micro-batches, each upserted by key into a table that is kept whole; a repeated run adds nothing."""
    cat, checkpoint = tables.Catalog(spark, tables.scratch_path(spark, "live")), tables.scratch_path(spark, "checkpoint")
    held = read(spark, sf_dir, "events").select("event_id", "user_id")
    cat.replace("live", held.limit(0))
    for _ in range(2):
        changed = spark.readStream.schema(held.schema).parquet(f"{sf_dir}/events.parque*")
        q = flows.maintain(changed, lambda df, n: cat.replace("live", changes.upsert(cat.table("live"), df, ["event_id"])), checkpoint)
        q.awaitTermination()
    return cat.table("live").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last"))


@query("""
    WITH s AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click')
    SELECT CAST(s.user_id AS VARCHAR) AS query, CAST(c.event_id AS VARCHAR) AS record_id, CAST(count(*) AS BIGINT) AS pairs FROM s JOIN c USING (user_id) WHERE abs(epoch_us(s.ts) - epoch_us(c.ts)) < 600000000 GROUP BY ALL
""")
def stream_clicks(spark, sf_dir):
    """The search-click join over streams, its state bounded by watermarks."""
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque*").select("event_type", F.col("user_id").cast("string").alias("query"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("record_id"))
    pairs = flows.pair_clicks(e.where("event_type = 'view'").select("query", "ts"), e.where("event_type = 'click'").select("query", "ts", "record_id"))
    out, checkpoint = tables.scratch_path(spark, "pairs"), tables.scratch_path(spark, "checkpoint")
    pairs.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("query string, record_id string").parquet(out).groupBy("query", "record_id").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT * FROM (VALUES ('a', '1', FALSE), ('a', '2', FALSE), ('a', '3', TRUE), ('b', '9', FALSE)) t(\"table\", id, deleted)")
def change_messages(spark, sf_dir):
    raw = spark.createDataFrame([('{"tables": {"a": {"changed": ["1", "2"], "deleted": ["3"]}}}',), ('{"table": "b", "ids": ["9"]}',), ("noise",)], "value string")
    return flows.events(raw)


@query("SELECT n_nationkey, n_name FROM nation")
def paged_pull(spark, sf_dir):
    """A paged service, here one that serves the nations in the order of their key, seven a page."""
    from quarry.sources import paged

    held = [r.asDict() for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows, the service's own data
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])
    kind = paged.source("served", lambda table, columns, skip, top, since: held[skip : skip + top], lambda table, since: len(held), schema)
    return paged.pull(spark, kind, "nation", schema, page=7)


@query("SELECT n_nationkey, n_name FROM nation")
def paged_pull_resumed(spark, sf_dir):
    """A pull whose load failed: the next one finds all spans fetched, and loads them."""
    from quarry.sources import paged

    held = [r.asDict() for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()]  # 25 rows, the service's own data
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType())])

    def refuse(rows):
        raise InterruptedError("before the load")

    cat = tables.Catalog(spark, tables.scratch_path(spark, "pulled"))
    kind = paged.source("served_once", lambda table, columns, skip, top, since: held[skip : skip + top], lambda table, since: len(held), schema)
    try:
        paged.staged_pull(cat, kind, "nation", schema, page=4, span=12, load=refuse)
    except InterruptedError:
        pass
    kind = paged.source("served_once", lambda table, columns, skip, top, since: 1 / 0, lambda table, since: len(held), schema)  # asked for a page, it would fail
    paged.staged_pull(cat, kind, "nation", schema, page=4, span=12)
    return cat.table("nation")
