"""Golden cases over small tables of people, products and organisations."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quarry.config import Stages, TableConfig, TextJoin
from quarry.engine import Engine
from quarry.functions.similarity import jaro, jaro_winkler, title_similarity
from quarry.operators import bm25, index, rank, search
from quarry.plans.query import parse

PEOPLE = [
    ("P1", "Matt Navarre", "matt.navarre@example.com", "+11 629 773 9565", "O1", dt.date(2019, 3, 4)), ("P2", "Ματίας Ναβάρ", "user@example.com", "+34 409 785 6147", "O2", dt.date(2026, 5, 5)),
    ("P3", "Astrid Navarré", "astrid@example.com", "+34 605 234 5915", "O2", dt.date(2019, 4, 3)), ("P4", "Robert Whitfield", None, None, "O3", dt.date(2020, 1, 1)),
    ("P5", "Siobhan Murphy", "s@example.org", "555-1234", "O3", dt.date(2018, 3, 19)), ("P6", "Darren Umbridge", "", "", None, None),
]
PRODUCTS = [("R1", "Canvas Sneakers", 45), ("R2", "Vans Old Skool", 65), ("R3", "Creator Laptop", 2400), ("R4", "House Blend 250g", 12), ("R5", "45 Caliber Trainers", 95)]
ORGS = [("O1", "Bluewater Group", "Maritime"), ("O2", "Phoenix Cardiac Clinic", "Healthcare"), ("O3", "Hank's Parts", "Energy")]
CONFIGS = {
    "people": TableConfig("id", ("name", "email", "phone", "since"), ("name", "email")), "products": TableConfig("id", ("name", "price"), ("name", "price")),
    "organizations": TableConfig("id", ("name", "industry"), ("name",), TextJoin("people", "id", "org", "name", "people")),
}


@pytest.fixture(scope="module")
def engine(spark):
    tables = {
        "people": spark.createDataFrame(PEOPLE, "id string, name string, email string, phone string, org string, since date"), "products": spark.createDataFrame(PRODUCTS, "id string, name string, price long"),
        "organizations": spark.createDataFrame(ORGS, "id string, name string, industry string"),
    }
    e = Engine(index.build_all(tables, CONFIGS).cache(), groups=[["robert", "bob"]], stages=Stages(fuzzy_floor=0.85))
    e.tables = tables
    return e


CASES = [
    ("Murphy", "people", "P5", []), ("mat nav", "people", "P1", []), ("Navarré", "people", "P1", []), ("cardiac", "organizations", "O2", ["people"]), ('"Cardiac Clinic"', "organizations", "O2", []),
    ("Ματίας", "people", "P2", []), ("Matt Navarre", "organizations", "O1", []), ("Bob Whitfield", "people", "P4", []), ("Daren Umbridge", "people", "P6", []), ("45", "products", "R1", []),
    ("$65", "products", "R2", []), ("40...70", "products", "R1", ["people", "organizations"]), (">2000", "products", "R3", ["people", "organizations"]), ("<=45", "products", "R4", []),
    ("3/4/2019", "people", "P1", ["products", "organizations"]), ("4.3.2019", "people", "P3", []), ("19.3.2018", "people", "P5", []), ("3/2019", "people", "P1", []), (">=2026-05-01", "people", "P2", []),
    ("2019", "people", "P1", []), ("month:march", "people", "P1", ["products"]), ("matt.navarre@", "people", "P1", ["products", "organizations"]), ("773-9565", "people", "P1", ["products", "organizations"]),
    ("6297739565", "people", "P1", []),
]


@pytest.mark.parametrize(("q", "table", "first", "never"), CASES)
def test_golden(engine, q, table, first, never):
    rows = engine.search(q).collect()
    by = {}
    for r in rows:
        by.setdefault(r.src_table, []).append(r.record_id)
    assert by[table][0] == first
    assert not set(never) & set(by)
    assert [r.position for r in rows] == list(range(1, len(rows) + 1))
    assert all(r.why for r in rows)


def test_exact_rows_stay_and_come_first(engine):
    plan = engine.plan("navarre")
    exact = {(r.src_table, r.record_id) for r in search.text_search(engine.index, plan).collect()}
    rows = engine.search("navarre").collect()
    assert exact <= {(r.src_table, r.record_id) for r in rows}
    assert rows == engine.search("navarre").collect()
    for table in {t for t, _ in exact}:
        kinds = ["exact" in r.kinds for r in rows if r.src_table == table]
        assert kinds == sorted(kinds, reverse=True)
    assert engine.search("").collect() == [] and engine.search("navarre", tables=["products"]).collect() == []


def test_index_rows(engine):
    r = engine.index.where("record_id = 'P1'").first()
    assert r.search_text == " matt navarre matt navarre example com 11 629 773 9565 2019 03 04 " and r.title_text == " matt navarre "
    assert r.emails == " matt.navarre@example.com " and r.digits == " 116297739565 " and r.dates == [dt.date(2019, 3, 4)] and r.nums == []
    assert engine.index.where("record_id = 'O2'").first().source_text.endswith("people: Astrid Navarré, Ματίας Ναβάρ")
    assert engine.index.schema.names == index.SCHEMA.names


def test_best(engine):
    plan = engine.plan("matt navarre")
    assert [r.record_id for r in rank.best(search.text_search(engine.index, plan), plan).collect()] == ["P1"]
    plan = engine.plan("nav")
    assert rank.best(search.text_search(engine.index, plan), plan).collect() == []


def test_sync_is_idempotent_and_finds_changes(engine, spark):
    people = engine.tables["people"]
    again, same = engine.sync("people", people, CONFIGS["people"])
    assert {r.change for r in same.collect()} == {"unchanged"} and again.index.count() == engine.index.count()
    new = people.where("id <> 'P6'").withColumn("name", F.when(F.col("id") == "P5", "Sian Murphy").otherwise(F.col("name")))
    vectors = spark.createDataFrame([("people", "P5", "k", [1.0]), ("people", "P6", "k", [1.0]), ("people", "P1", "k", [1.0])], "src_table string, record_id string, vec_key string, vec array<float>")
    engine.vectors = vectors
    after, done = engine.sync("people", new, CONFIGS["people"])
    engine.vectors = None
    assert {r.record_id: r.change for r in done.where("change <> 'unchanged'").collect()} == {"P5": "update", "P6": "delete"}
    assert [r.record_id for r in after.vectors.collect()] == ["P1"]
    partial, done = engine.sync("people", new.where("id = 'P5'"), CONFIGS["people"], only=spark.createDataFrame([("P5",), ("P6",)], "record_id string"))
    assert {r.record_id: r.change for r in done.collect()} == {"P5": "update", "P6": "delete"} and partial.index.count() == engine.index.count() - 1


def test_json_records(spark):
    rows = [("1", '{"name": "Ann", "price": 45, "on": "2026-01-15", "cost": "$5", "mail": "A@b.co", "n": null, "x": {"y": 1}}'), ("2", ""), ("3", "[1]"), ("4", "{bad"), ("5", '{"_id": "own", "_display": {"t": "Title"}, "w": "v"}'), ("6", None), ("7", "?")]
    out, skipped = index.build_json(spark.createDataFrame(rows, "k string, j string"), "t", TableConfig("k", json_field="j"))
    got = {r.record_id: r for r in out.collect()}
    assert set(got) == {"1", "own"} and skipped.first().skipped == 5
    assert got["1"].nums == [45.0] and got["1"].dates == [dt.date(2026, 1, 15)] and got["1"].emails == " a@b.co " and got["own"].title_text == " title "


def test_jaro_winkler():
    assert round(jaro_winkler("martha", "marhta"), 4) == 0.9611 and round(jaro_winkler("abcdefgh", "abcdxyzw"), 4) == 0.6667 and jaro("", "") == 0.0
    assert title_similarity(" john smith ", [["smith"], ["jon", "john"]]) == 1.0
    assert title_similarity(" in ", [["inn"]]) > 0.9 and title_similarity(" in the way ", [["inn"]]) < 0.9


def test_text_index(engine):
    t = bm25.build(engine.index)
    assert {r.doc_key for r in t.scores(["navarre"]).collect()} == {"people|P1", "people|P3", "organizations|O1", "organizations|O2"}
    assert t.scores(["nothing"]).collect() == []
    rows = search.text_search(engine.index, parse("navarre"), text_index=t).collect()
    assert all(r.score > 2 for r in rows)


def test_table_filter_prunes_and_filters_push_down(engine, tmp_path, spark):
    index.write(engine.index, str(tmp_path / "idx"))
    stored = spark.read.parquet(str(tmp_path / "idx"))
    df = search.text_search(stored, parse("*canvas"), tables=["products"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*src_table", plan) and "StringContains(search_text,canvas)" in plan.replace(", ", ",")
    assert "WindowGroupLimit" in plan and "source_text" not in plan
    assert [r.record_id for r in df.collect()] == ["R1"]


def test_reported_changes(engine):
    people = engine.tables["people"].withColumn("name", F.when(F.col("id") == "P1", "Matthew Navarre").otherwise(F.col("name")))
    after, done = engine.records_changed("people", people, CONFIGS["people"], ["P1", "nowhere"], ["P2"])
    assert {r.record_id: r.change for r in done.collect()} == {"P1": "update", "P2": "delete"}
    assert after.status().where("src_table = 'people'").first().rows == len(PEOPLE) - 1
