import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import Stages
from quarry.operators import changes, evaluate, index, profile, stages
from quarry.sources import paged, schema_export, tables
from quarry.streaming import flows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sources(spark, tmp_path):
    fields = [("id", "String"), ("price", "Decimal"), ("on", "Date"), ("ok", "Boolean"), ("pic", "Binary"), ("mod", "DateTimeOffset")]
    schema = tables.schema_of(fields, ["price", "pic"], always=("id", "mod"))
    assert schema.names == ["id", "price", "mod"]
    (tmp_path / "a.json").write_text(json.dumps([{"id": "1", "price": 2, "on": "x"}, {"id": "2"}]))
    assert [(r.id, r.price) for r in tables.read_json(spark, str(tmp_path / "a.json"), schema).orderBy("id").collect()] == [("1", 2.0), ("2", None)]
    (tmp_path / "a.csv").write_text('n,t\n1,"a ""b"""\n2,c\n')
    assert rows(tables.read_csv(spark, str(tmp_path / "a.csv"))) == [(1, 'a "b"'), (2, "c")]
    assert tables.empty(spark, schema).count() == 0
    tables.replace(spark.range(3), str(tmp_path / "r"))
    tables.replace(spark.range(2), str(tmp_path / "r"))
    assert tables.counts({"r": spark.read.parquet(str(tmp_path / "r"))}) == {"r": 2}
    assert tables.sample(spark.range(900), 0, 1).count() == 1 and tables.sample(spark.range(900), 900, 1).count() == 500


def test_logs_and_manifest(spark, tmp_path):
    log, schema = str(tmp_path / "log"), T.StructType([T.StructField("ts", T.LongType()), T.StructField("q", T.StringType())])
    tables.append_log(spark.createDataFrame([(1, "a"), (2, "b")], schema), log)
    tables.append_log(spark.createDataFrame([(3, "c")], schema), log)
    (tmp_path / "log" / "part-bad.json").write_text("{broken\n")
    assert [r.q for r in tables.tail(spark, log, schema, 2).collect()] == ["c", "b"]
    path = str(tmp_path / "m.json")
    assert tables.read_manifest(path) == {}
    tables.merge_manifest(path, {"a": 1, "b": 2})
    assert tables.merge_manifest(path, {"b": 3}) == tables.read_manifest(path) == {"a": 1, "b": 3}


def test_catalogue(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<Files><Field file="f" table="T" name="a &amp; b" type="Text" comment="c"/><Field file="f" table="T" name="z" type="Number"/></Files>')
    assert rows(tables.read_catalogue(spark, str(tmp_path / "s.xml"))) == [("f", "T", "a & b", "Text", "c"), ("f", "T", "z", "Number", None)]


EXPORT = """<FMSaveAsXML File="{file}"><BaseTableCatalog><BaseTable name="A &amp; B" comment=" both "/><BaseTable name="C" comment=""/></BaseTableCatalog>
<FieldsForTables><FieldCatalog><BaseTableReference name="A &amp; B"/><ObjectList>
<Field name="n" datatype="Text" fieldtype="Normal" comment="c"><Validation unique="True" notEmpty="True"/></Field>
<Field name="no" datatype="Number" fieldtype="Normal"><AutoEnter type="SerialNumber"/></Field>
<Field name="row_id" datatype="Number" fieldtype="Normal"><AutoEnter type="SerialNumber"/></Field>
<Field name="day" datatype="Date" fieldtype="Normal"><AutoEnter type="ModificationTimestamp"/></Field>
<Field name="mod" datatype="Timestamp" fieldtype="Normal"><AutoEnter type="ModificationTimestamp"/></Field>
<Field name="made" datatype="Timestamp" fieldtype="Normal"><AutoEnter type="CreationTimestamp"/></Field>
<Field name="sum" datatype="Number" fieldtype="Calculated"><Storage global="True" storeCalculationResults="True"/></Field>
</ObjectList></FieldCatalog><FieldCatalog><BaseTableReference name="C"></BaseTableReference><ObjectList>
<Field name="code" datatype="Text" fieldtype="Normal"><Validation unique="True"/></Field>
<Field name="pk" datatype="Text" fieldtype="Normal"><AutoEnter type="Calculated"><Calculation><Text>Get ( UUID )</Text></Calculation></AutoEnter></Field>
</ObjectList></FieldCatalog><FieldCatalog><BaseTableReference name="C"/><ObjectList><Field name="again"/></ObjectList></FieldCatalog>
<FieldCatalog><BaseTableReference name="D"/><ObjectList></ObjectList></FieldCatalog></FieldsForTables></FMSaveAsXML>"""


def test_schema_exports(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<?xml version="1.0" encoding="UTF-16"?>' + EXPORT.format(file="a"), encoding="utf-16")
    (tmp_path / "b.xml").write_text(EXPORT.format(file="b"))
    df = schema_export.read_exports(spark, str(tmp_path))
    got = {(r.file, r.table): r for r in df.collect()}
    assert sorted(got) == [("a", "A & B"), ("a", "C"), ("b", "A & B"), ("b", "C")]
    one, two = got["a", "A & B"], got["b", "C"]
    assert (one.comment, one.key, one.key_kind, one.modified, one.created) == ("both", "row_id", "serial", "mod", "made")
    assert [f.name for f in one.fields] == ["n", "no", "row_id", "day", "mod", "made", "sum"]
    assert tuple(one.fields[0]) == ("n", "Text", "Normal", "c", False, False) and tuple(one.fields[-1]) == ("sum", "Number", "Calculated", None, True, True)
    assert (two.comment, two.key, two.key_kind, two.modified, two.created) == (None, "pk", "uuid", None, None)
    merged = schema_export.merge_exports(df, df.where("file = 'a' AND table = 'C'"))
    assert sorted((r.file, r.table) for r in merged.collect()) == [("a", "C"), ("b", "A & B"), ("b", "C")]
    with pytest.raises(ValueError):
        schema_export.parse(b"<Other/>")


def test_staged_pull(spark, tmp_path):
    cat, asked = tables.Catalog(spark, str(tmp_path / "cat")), tmp_path / "asked"
    cat.replace("t", spark.range(2))
    asked.mkdir()
    schema = T.StructType([T.StructField("id", T.LongType())])

    def kind(n, broken=None):
        def fetch(table, columns, skip, top, since):
            if skip == broken:
                raise OSError("the service is down")
            (asked / f"{skip}-{skip + top}").touch()
            return [{"id": i} for i in range(skip, skip + top)]

        return paged.source("staged", fetch, lambda table, since: n, schema)

    def seen():
        out = {p.name for p in asked.iterdir()}
        for p in asked.iterdir():
            p.unlink()
        return out

    ids = lambda: sorted(r.id for r in cat.table("t").collect())
    with pytest.raises(Exception, match="the service is down"):
        paged.staged_pull(cat, kind(25, broken=20), "t", schema, page=5, span=10)
    assert ids() == [0, 1] and cat.names() == ["t"] and seen() >= {"0-5", "5-10", "10-15", "15-20"}
    paged.staged_pull(cat, kind(27), "t", schema, page=5, span=10)  # it has grown meanwhile
    assert ids() == list(range(27)) and seen() == {"20-25", "25-27"} and not cat.fs.exists(cat._path(paged.PULLS, "t"))

    def refused(rows):
        raise RuntimeError("not loaded")

    with pytest.raises(RuntimeError):
        paged.staged_pull(cat, kind(12), "t", schema, page=5, span=10, load=refused)
    assert len(seen()) == 3
    assert paged.staged_pull(cat, kind(12), "t", schema, page=5, span=10, load=lambda rows: rows.count()) == 12 and seen() == set()
    stops = iter([False, True])
    with pytest.raises(paged.Cancelled):
        paged.staged_pull(cat, kind(30), "t", schema, page=5, span=10, should_stop=lambda: next(stops))
    assert ids() == list(range(27)) and not cat.fs.exists(cat._path(paged.PULLS, "t"))
    paged.staged_pull(cat, kind(0), "t", schema, page=5, span=10)
    assert ids() == []


def test_paged_source(spark):
    held = [{"id": i, "mod": f"2024-01-{i + 1:02d}", "x": "drop"} for i in range(25)]

    def fetch(table, columns, skip, top, since):
        assert "x" not in columns
        return [r for r in held if not since or r["mod"] > since][skip : skip + top]

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("mod", T.StringType())])
    kind = paged.source("records", fetch, lambda table, since: sum(not since or r["mod"] > since for r in held), schema)
    df = paged.pull(spark, kind, "t", schema, page=7)
    assert df.rdd.getNumPartitions() == 4 and sorted(r.id for r in df.collect()) == list(range(25))
    assert sorted(r.id for r in paged.pull(spark, kind, "t", schema, since="2024-01-20", page=7).collect()) == [20, 21, 22, 23, 24]
    assert paged.pull(spark, kind, "t", schema, since="2025").collect() == []


def test_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, content_hash string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, content_hash string")
    assert rows(changes.diff(old, new, ["k"])) == [(1, "delete"), (2, "update"), (3, "unchanged"), (4, "insert")]
    assert rows(changes.upsert(old, new, ["k"])) == rows(changes.upsert(changes.upsert(old, new, ["k"]), new, ["k"])) == [(1, "a"), (2, "c"), (3, None), (4, "d")]
    assert rows(changes.changed(old, new, ["k"]).select("k")) == [(2,), (4,)] and rows(changes.gone(old, new, ["k"]).select("k")) == [(1,)]
    assert rows(changes.delete(old, new, ["k"])) == [(1, "a")] and changes.high_water(old, "k") == 3
    now = dt.datetime(2024, 1, 1, 12)
    stamped = spark.createDataFrame([(now,), (now - dt.timedelta(hours=1),)], "m timestamp_ntz")
    assert changes.since(stamped, "m", now, now=now).count() == 1 and changes.since(stamped, "m", now, now=now + dt.timedelta(hours=1)).count() == 0 and changes.since(stamped, "m", None).count() == 2
    assert changes.can_increment("k", "m", ["a"], ["a"]) and not changes.can_increment("k", None, ["a"], ["a"]) and not changes.can_increment("k", "m", ["a"], ["b"])
    assert changes.add_missing(old, index.SCHEMA).columns == index.SCHEMA.names
    plan = changes.gone(old, new, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_profile(spark):
    df = spark.createDataFrame([("{}", None, "x" * 2000, "11111111-1111-1111-1111-111111111111", "ok"), ("[1]", " ", "y" * 2000, "22222222222222222222", "")], "j string, e string, l string, u string, g string")
    got = {r.field: r.why for r in profile.decide(profile.profile(df, df.columns)).collect()}
    assert got == {"j": "JSON", "e": "empty", "l": "long", "u": "UUID", "g": None}
    assert profile.choose_key(["ROWID", "name", "cust_id"]) == "cust_id" and profile.choose_key(["a", "b"], declared="b") == "b" and profile.choose_key(["x", "b"], hint="x") == "x" and profile.choose_key(["ROWID"]) is None
    saved = spark.createDataFrame([("a", "mine")], "k string, label string")
    assert rows(profile.merge_saved(spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, label string, n int"), saved, "k")) == [("a", "mine", 1), ("b", "y", 2)]
    t = spark.createDataFrame([("T_orderLines", None, " "), ("b", "Zed", None), ("c", None, "alpha")], "name string, saved string, proposed string")
    assert [(r.name, r.label) for r in profile.display_names(t).collect()] == [("c", "alpha"), ("T_orderLines", "T Order Lines"), ("b", "Zed")]


def test_stages(spark):
    base = spark.createDataFrame([("t", str(i), f"name: item {i}\nnote: blue", None) for i in range(25)], "src_table string, record_id string, source_text string, enrich_key string")
    idx = changes.add_missing(base, index.SCHEMA)
    none = spark.createDataFrame([("t", "gone", "old", [1.0]), ("t", "3", "old", [1.0])], "src_table string, record_id string, vec_key string, vec array<float>")
    out = stages.embed(idx, none, stages.hashing_embedder(16), "now", cap=10)
    assert out.where("vec_key = 'now'").count() == 10 and out.where("record_id = 'gone'").count() == 0
    v = np.array(out.where("vec_key = 'now'").first().vec)
    assert abs(v @ v - 1) < 1e-6
    assert stages.embed(idx, out, stages.hashing_embedder(16), "now", cap=0).where("vec_key = 'now'").count() == 25
    notes = stages.enrich(idx, lambda prompt, texts: [f"- {prompt}\n\n\n* {t[-4:]}" for t in texts[:-1]], "m", {"t": "say"}, cap=0)
    got = notes.collect()
    assert len(got) == 25 and {r.enrich_text for r in got} == {"say\nblue", ""}
    after = changes.write_notes(idx, notes.select("src_table", "record_id", "enrich_text", "enrich_norm"), stages.enrich_key("m", "say"))
    assert stages.enrich(after, lambda p, t: t, "m", {"t": "say"}).count() == 0
    assert idx.select(stages.embed_text("T", F.col("source_text")).alias("x")).first().x == "T. item 0. blue"
    kinds = spark.createDataFrame([("429 quota",), ("bad api key",), ("ETIMEDOUT timeout",), ("boom",)], "m string").select(stages.error_kind(F.col("m")))
    assert [r[0] for r in kinds.collect()] == ["quota", "auth", "network", "other"]
    assert stages.parse_json('```json\n{"a": 1}\n```') == {"a": 1} and stages.parse_json("so: [1, 2] ok") == [1, 2] and stages.parse_json("no") is None
    assert stages.checked_order(["b", "x", "b"], ["a", "b", "c"], 7) == (["b", "a", "c"], 1.0) and stages.checked_order(None, ["a"], float("nan")) == (["a"], 0.0)
    assert stages.checked_understanding({"query": " q ", "tables": ["t", "u"], "reading": "x" * 200}, ["t"]) == {"query": "q", "tables": ["t"], "names": [], "reading": "x" * 120}
    assert stages.checked_understanding([], []) is None and stages.should_stop(5, 9) and not stages.should_stop(5, 10)
    calls = []
    c = stages.Cached(lambda k: calls.append(k) or k, 2)
    assert [c(k) for k in "abacab"] == list("abacab") and calls == ["a", "b", "c", "b"]
    assert Stages(dims=9, fuzzy_floor=2).clamped().dims == 64 and Stages().ready("fuzzy") == "" and Stages(rerank=True).ready("rerank") == "no model" and Stages().ready("rerank") == "off"


def test_evaluate(spark):
    assert evaluate.percentile(spark.createDataFrame([(x,) for x in [5, 1, 1, 9, None]], "v int"), "v", 0.5).first().value == 5
    w = spark.createDataFrame([("carpet",)], "w string")
    got = w.select(*(c.alias(k) for k, c in evaluate.typos(F.col("w")).items())).first().asDict()
    assert got == {"swap": "capret", "drop": "capet", "double": "carrpet", "vowel": "cerpit", "split": "car pet", "join": "carpet"}
    q = spark.createDataFrame([(["robert", "smith"], ["bob", "smi"], {"bob": ["robert"]}), (["robert"], ["x"], {})], "r array<string>, q array<string>, a map<string,array<string>>")
    assert [r[0] for r in q.select(evaluate.prefix_found(F.col("r"), F.col("q"), F.col("a"))).collect()] == [True, False]
    cases = spark.createDataFrame([(1, "t", ["Ann"]), (2, "t", ["Bo"])], "case_id int, table string, expect array<string>")
    res = spark.createDataFrame([(1, "t", 2, "Ann X"), (1, "u", 1, "Ann")], "case_id int, src_table string, rank int, display string")
    assert {r.case_id: r["rank"] for r in evaluate.hit_rank(res, cases).collect()} == {1: 2, 2: None}
    runs = [spark.createDataFrame([("x", r, None) for r in ranks], "kind string, rank int, error string") for ranks in ([1, 7], [1, 1])]
    assert evaluate.compare(*runs, ["kind"]).first().asDict() == {"kind": "x", "hit1_points": 50.0, "hit5_points": 50.0}
    roles = spark.createDataFrame([(0.9, 0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.9, 0.0, 1.0), (0.0, 0.0, 0.0, 0.0, 30.0)], "n double, d double, e double, p double, w double")
    named = roles.select(evaluate.field_role(*(F.col(c) for c in "ndepw")).alias("r"))
    assert [r.r for r in named.collect()] == ["number", "email", "prose"]
    assert named.agg(F.collect_list("r").alias("rs")).select(evaluate.table_kind(F.col("rs"))).first()[0] == "people"


def test_change_stream(spark, tmp_path):
    src, ck = tmp_path / "in", str(tmp_path / "ck")
    src.mkdir()
    (src / "1.txt").write_text('{"tables": {"a": {"changed": ["1", "2"], "deleted": ["3"]}}}\n{"table": "b", "ids": ["9"]}\nnoise\n')
    seen = []
    for _ in range(2):  # the second run finds nothing new
        ev = flows.events(spark.readStream.text(str(src)))
        q = flows.maintain(ev, lambda df, n: seen.extend(tuple(r) for r in df.collect()), ck)
        assert q.awaitTermination(60)
    assert sorted(seen) == [("a", "1", False), ("a", "2", False), ("a", "3", True), ("b", "9", False)]


def test_click_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    for name, data in (("s", [("q", t), ("q", t + dt.timedelta(hours=2)), ("z", t)]), ("c", [("q", t + dt.timedelta(minutes=9), "r1"), ("q", t + dt.timedelta(minutes=11), "r2"), ("q", t + dt.timedelta(hours=5), "late")])):
        spark.createDataFrame(data, "query string, ts timestamp" + (", record_id string" if name == "c" else "")).coalesce(1).write.parquet(str(tmp_path / name))
    read = lambda n, extra: spark.readStream.schema(f"query string, ts timestamp{extra}").parquet(str(tmp_path / n))
    q = flows.pair_clicks(read("s", ""), read("c", ", record_id string")).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [(r.query, r.record_id) for r in spark.sql("select * from pairs").collect()] == [("q", "r1")]


def test_progress_replay():
    p = flows.Progress(keep=2)
    for i in range(3):
        p._note("k", str(i))
    assert p.since(1) == [(2, "k", "1"), (3, "k", "2")] and p.since(2) == [(3, "k", "2")]


@pytest.mark.parametrize("name", ["nothing imports the training operators"])
def test_layers(name):
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quarry"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "quarry.llm" not in path.read_text()


def test_entry_without_the_training_operators(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).parent.parent
    shutil.copytree(root, tmp_path / "bare", ignore=lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")])
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert 'text_phrase' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "bare", check=True, timeout=120)


def test_deletes_manifests_and_names(spark):
    held = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(changes.detect_deletes(held, spark.createDataFrame([(1,), (3,)], "k int"), 2, "k")) == [(2,)]
    assert rows(changes.detect_deletes(held, held.limit(0), 3, "k")) == []
    old, new = (spark.createDataFrame(r, "t string, n int, m string") for r in ([("a", 1, "x"), ("b", 2, "y")], [("b", 5, None), ("c", 6, "z")]))
    assert rows(changes.manifest_merge(old, new, "t")) == [("a", 1, "x"), ("b", 5, "y"), ("c", 6, "z")]
    first = stages.name_tables({"T_people": ["a"], "T_b": ["b"]}, {}, lambda todo: {"T_people": "People", "x": "y"})
    assert {t: label for t, (_, label) in first.items()} == {"T_people": "People", "T_b": "T B"}
    assert stages.name_tables({"T_people": ["A"]}, first, lambda todo: 1 / 0) == {"T_people": first["T_people"]}
    assert stages.name_tables({"T_people": ["c"]}, first, lambda todo: 1 / 0)["T_people"][1] == "T People"


def test_passes_stop_and_keep_progress():
    rows = [{"i": i} for i in range(100)]
    saved = []
    done = stages.run_calls(iter(rows), lambda g: [r["i"] for r in g], saved.extend, per_call=7, workers=3, flush=20)
    assert (done.calls, done.failed, done.answered, done.stopped) == (15, 0, 100, "") and [a for _, a in saved] == list(range(100))
    calls = []

    def dead(group):
        calls.append(group)
        raise OSError("connect timeout")

    done = stages.run_calls(iter(rows), dead, saved.extend, per_call=1, workers=4, tries=2)
    assert done.stopped == "failures" and done.calls == 8 and len(calls) == 16  # not a call for each row
    calls.clear()

    def refused(group):
        calls.append(group)
        raise OSError("quota exceeded")

    assert stages.run_calls(iter(rows), refused, saved.extend, per_call=1, workers=4).stopped == "failures" and len(calls) == 8  # never tried again
    kept = []
    done = stages.run_calls(iter(rows), lambda g: [1] * (len(g) - 1), kept.extend, per_call=5, workers=2, flush=1, cancelled=lambda: len(kept) >= 20)
    assert done.stopped == "cancelled" and len(kept) == 20 and sum(a is None for _, a in kept) == 4


def test_catalog_keeps_tables_whole(spark, tmp_path):
    cat = tables.Catalog(spark, str(tmp_path / "cat"))
    assert cat.names() == []
    cat.replace("t", spark.range(3))
    with pytest.raises(Exception, match="boom"):
        cat.replace("t", spark.range(5).select(F.raise_error(F.lit("boom")).alias("id")))
    assert cat.names() == ["t"] and cat.table("t").count() == 3  # a failed load leaves the table as it was
    assert cat.replace("t", cat.table("t").where("id > 0")).count() == 2 and cat.columns() == [("t", "id", 1, "bigint")]
    with pytest.raises(KeyError):
        cat.table("u")


def test_model_stages_of_the_engine(spark, tmp_path):
    from quarry.engine import Engine

    base = spark.createDataFrame([("t", str(i), f'{{"n": "red {w}"}}', f"n: red {w}", f" red {w} ", f" red {w} ") for i, w in enumerate(("ball", "car", "hat"))] + [("u", "9", "{}", "n: blue", " blue ", " blue ")],
                                 "src_table string, record_id string, display string, source_text string, search_text string, title_text string")
    idx = changes.add_missing(base, index.SCHEMA)
    plain = Engine(idx, stages=Stages(fuzzy=False))
    ids = lambda df: [r.record_id for r in df.collect()]
    assert ids(plain.search("red")) == ["0", "2", "1"] or len(ids(plain.search("red"))) == 3
    assert [r.best for r in plain.search("red car").collect()] == [True] and not any(r.best for r in plain.search("red").collect())
    asked = []

    def understander(q, names):
        asked.append((q, names))
        return {"query": "red hat", "tables": ["t", "nowhere"], "reading": "a hat"}

    smart = Engine(idx, stages=Stages(fuzzy=False, understand=True, rerank=True), understander=understander, reranker=lambda q, shown: (["t|1", "t|7"], 0.9))
    assert ids(smart.search("the hat that is red")) == ["2"] and ids(smart.search("the hat that is red")) == ["2"] and asked == [("the hat that is red", ["t", "u"])]
    order = ids(Engine(idx, stages=Stages(fuzzy=False, rerank=True), reranker=lambda q, shown: (["t|1", "t|7"], 0.9)).search("red"))
    assert order[0] == "1" and len(order) == 3
    broken = Engine(idx, stages=Stages(fuzzy=False, understand=True, rerank=True), understander=lambda q, n: 1 / 0, reranker=lambda q, s: 1 / 0)
    assert len(ids(broken.search("red"))) == 3
    plain.log(str(tmp_path / "log"), "red", plain.search("red"))
    assert spark.read.json(str(tmp_path / "log")).first().results == 3
