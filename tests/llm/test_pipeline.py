import hashlib

import corpus_pipeline
import tiktoken
from quarry.llm import queries as q
from quarry.llm._common import table
from test_jaccard import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    documents = table(spark, SF, "documents")
    machine = q.quality_machine(spark, SF)
    from quarry.llm.pii import find, normal, replace
    from quarry.llm.quality import score

    raw = {r.doc_id: r for r in documents.collect()}
    good = {r.doc_id for r in score(documents, machine).collect() if r.score >= 0.7}
    after = corpus_pipeline.quality(spark, documents, SF)
    assert after.columns == documents.columns and {r.doc_id for r in after.collect()} == good
    roots = components([(i, raw[i].text) for i in sorted(good)])
    kept = {i for i in good if roots[i][1] == i}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, after, SF).collect()} == kept

    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept and len(out) == len(kept)
    # Texts: the surrogates differ from every entity, all else stands.
    masked = {r.doc_id: r.text for r in replace(documents.where(documents.doc_id.isin(list(kept))), q.PII_KEY).collect()}
    entities = {(k, normal(k, raw[i].text[s:e], c)) for i in kept for s, e, k, c in find(raw[i].text)}
    ranks, pattern = q.tokenizer()
    true = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for r in out:
        assert not entities & {(k, normal(k, masked[r.doc_id][s:e], c)) for s, e, k, c in find(masked[r.doc_id])}
        ids = true.encode_ordinary(masked[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(masked[r.doc_id].encode()).hexdigest()


def test_mixing_orders_rows(spark):
    documents = table(spark, SF, "documents")
    mixed = corpus_pipeline.mixing(spark, documents, SF)
    assert mixed.columns == documents.columns
    from quarry.llm.mixing import mixed_ids

    want = {r.doc_id: r.position for r in mixed_ids(documents, q.MIX_WEIGHTS).collect()}
    got = [want[r.doc_id] for r in mixed.collect()]
    assert got == sorted(got) and len(got) == documents.count()


def test_place_outlasts_files(spark):
    # Files of a few rows, read by size: the mixing stage's order of rows is lost between the stages.
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        out = corpus_pipeline.run(spark, SF).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    from quarry.llm.mixing import mixed_ids

    documents = table(spark, SF, "documents")
    kept = documents.where(documents.doc_id.isin([r.doc_id for r in out]))
    want = {r.doc_id: (r.block, r.slot, r.position) for r in mixed_ids(kept, q.MIX_WEIGHTS).collect()}
    assert {r.doc_id: (r.block, r.slot, r.position) for r in out} == want
    assert [r.position for r in out] == list(range(len(want)))


def test_columns_named_as_the_operators_own(spark):
    # Nulls in every column, repeated rows and ids, empty and long texts too.
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, "en", "src0", 9), (1, text, "en", "src0", 9), (2, text, "en", None, None), (None, None, None, None, None), (5, "", "de", "src1", 0), (6, "mail a.b@example.com " * 20000, "en", "src2", 9)]
    extra = ["predicted", "score", "block", "slot", "position", "_in", "_key", "part", "key", "ids", "_text", "_own"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *(f"{c} {i}" for c in extra)) for i, r in enumerate(rows)], schema)
    own = lambda df: sorted((tuple(r) for r in df.select("doc_id", *extra).collect()), key=str)
    good, mixed = corpus_pipeline.quality(spark, docs, SF), corpus_pipeline.mixing(spark, docs, SF)
    assert good.columns == mixed.columns == docs.columns
    assert set(own(good)) <= set(own(docs)) and own(mixed) == own(docs)


def test_stages_give_heap_back(spark):
    # An executor's heap grows from stage to stage, as only full collections shrink it.
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Young" not in b.getName())
    documents = table(spark, SF, "documents").limit(10)
    before = full()
    corpus_pipeline.mixing(spark, documents, SF)
    assert full() > before


def test_plans_start_no_python_workers(spark):
    # Rows of Python lists are read by workers of their own, beside those of the stages.
    from quarry.llm.mixing import _borders, _plan

    cuts = [{"source": s, "_part": p, "key": k, "_n": n} for s, p, k, n in [("a", 0, "1f", 0), ("a", 1, "80", 5), (None, 0, "00", 0)]]
    digits, borders = _borders(spark, cuts, {0: (0, 0), 1: (9, 2)})
    plan = _plan(table(spark, SF, "documents"), q.MIX_WEIGHTS, 1)
    for df in (borders, plan):
        assert "RDD" not in df._jdf.queryExecution().executedPlan().toString()
    assert borders.schema.simpleString() == "struct<_from:string,_digits:string,_cuts:array<struct<key:string,part:int,n:bigint,position:bigint,slot:bigint>>>"
    rows = {(r["_from"], r["_digits"]): [tuple(c) for c in r["_cuts"]] for r in borders.collect()}
    assert digits == 3 and len(rows) == 2 * 4096
    assert rows["a", "7ff"] == [("", 0, 0, 0, 0)] and rows["a", "800"] == [("80", 1, 5, 9, 2)] and rows[None, "fff"] == [("", 0, 0, 0, 0)]
    assert plan.schema.simpleString() == "struct<_of:string,_weight:int,_slots:array<int>,_cycle:bigint>"
