import random
from collections import Counter
from fractions import Fraction

import pytest

from quarry.llm import _ranks, mixing
from quarry.llm.mixing import mix, mixed_ids, schedule


def frame(spark, rows, schema="doc_id long, source string, slot string"):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("weights", [[1], [1, 1], [3, 2, 1], [7, 1, 1, 1], [5, 3, 11, 1, 2, 2], [1, 29], [7001, 3000, 1] + [1] * 40, [1] * 2500])
def test_schedule_is_pfair(weights):
    q = sum(weights)
    order = [i for _, i in sorted((t, i) for i, slots in enumerate(schedule(weights)) for t in slots)]
    assert len(order) == q
    assert Counter(order) == {i: w for i, w in enumerate(weights)}
    done = [0] * len(weights)
    for t, i in enumerate(order):
        assert done[i] * q // weights[i] <= t < -(-(done[i] + 1) * q // weights[i])
        done[i] += 1
        assert q > 100 or all(abs(d - Fraction((t + 1) * w, q)) < 1 for d, w in zip(done, weights, strict=True))


@pytest.mark.parametrize(("bucket", "slots", "part", "cuts", "twice"), [(4096, 64, 20_000, 10**6, True), (5, 2, 10, 10**6, False), (5, 2, 10, 0, True), (64, 3, 50, 10**6, False)])
def test_mixture(spark, monkeypatch, bucket, slots, part, cuts, twice):
    monkeypatch.setattr(_ranks, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(mixing, "SLOTS", slots)
    monkeypatch.setattr(mixing, "BUCKETS", slots)
    monkeypatch.setattr(mixing, "PART_ROWS", part)
    monkeypatch.setattr(mixing, "MAX_CUTS", cuts)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "x") for i in range(400)] + [(7, "a", "x" * twice or str(i)) for i in range(30)] + [(None, "b", "y" * twice or str(i)) for i in range(5)]
    weights, size = {"a": 2, "b": 3}, 4
    got = mix(frame(spark, rows), weights, block_rows=size).collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert Counter((r.doc_id, r.source) for r in got) == Counter((i, s) for i, s, _ in rows)
    total, q = Counter(r.source for r in got), 7
    blocks, slots = Counter(), {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source, r.block))
    assert sorted(slots) == list(range(len(slots))) and all(len(s) == 1 for s in slots.values())
    for t in range(len(slots)):
        ((source, block),) = slots[t]
        assert block == blocks[source]
        blocks[source] += 1
        if all(blocks[s] < -(-total[s] // size) for s in total):
            assert all(abs(blocks[s] - Fraction((t + 1) * weights.get(s, 1), q)) < 1 for s in total)


def test_empty_and_single(spark):
    assert mix(frame(spark, []), {}).collect() == []
    assert [r.position for r in mix(frame(spark, [(1, None, "x")]), {"a": 5}).collect()] == [0]
    assert mixed_ids(frame(spark, []), {}).collect() == []


def test_ids_and_rows_have_the_same_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    of = lambda df: {r.doc_id: (r.block, r.slot, r.position) for r in df.collect()}
    assert of(mix(docs, {"src0": 3, "src1": 2})) == of(mixed_ids(docs, {"src0": 3, "src1": 2}))


def test_columns_that_clash(spark):
    names = ["_key", "_weight", "_n", "_slot", "_source", "_bucket", "_in", "_part", "part", "n", "key", "position", "a.b", "doc_id", "source"]
    docs = spark.createDataFrame([(*[f"{c}{i}" for c in names[:-2]], i, "s") for i in range(9)], ", ".join(f"`{c}` string" for c in names[:-2]) + ", doc_id long, source string")
    out = mix(docs, {}, block_rows=2)
    assert out.columns == [c for c in names if c != "position"] + ["block", "slot", "position"]
    assert all(r._key == f"_key{r.doc_id}" and r.n == f"n{r.doc_id}" and r["a.b"] == f"a.b{r.doc_id}" for r in out.collect())


def test_many_sources_and_fine_weights(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2500}") for i in range(3000)], "doc_id long, source string")
    got = mixed_ids(docs, {"s0": 10_001}, block_rows=1).collect()
    assert sorted(r.position for r in got) == list(range(3000))
    with pytest.raises(ValueError, match="add up to over"):
        mixed_ids(docs, {"s0": mixing.MAX_CYCLE})


def test_texts_move_once(spark):
    plan = mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), {})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("BroadcastExchange ") == 1


@pytest.mark.parametrize("cuts", [10**6, 0])
def test_through(spark, monkeypatch, cuts):
    monkeypatch.setattr(mixing, "MAX_CUTS", cuts)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mix(docs, {}, through=lambda df, keep: df.select(*keep, "doc_id", (df.n_chars * 2).alias("n"))).collect()
    want = {r.doc_id: (2 * r.n_chars, r.position) for r in mix(docs, {}).collect()}
    assert {r.doc_id: (r.n, r.position) for r in got} == want and [r.position for r in got] == list(range(len(want)))
