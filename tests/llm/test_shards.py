import random
import zlib
from collections import defaultdict
from hashlib import md5

import pytest

from quarry.llm import _ranks, shards
from quarry.llm.shards import shard


def brute(rows, n):
    key = lambda r: md5((r[1] or "").encode()).hexdigest() + md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()
    size = lambda r: len((r[1] or "").encode()) + 16
    total, by, text = sum(map(size, rows)), defaultdict(int), defaultdict(int)
    for r in rows:
        by[key(r)] += size(r)
        text[key(r)[:32]] += size(r)
    # What may not be cut: a text of few bytes, or else a key.
    whole = lambda k: k[:32] if text[k[:32]] <= shards.TOLERANCE * total / n else k
    units = defaultdict(int)
    for k in by:
        units[whole(k)] += by[k]
    ends, end = [], 0
    for u in sorted(units):
        ends.append((end, end + units[u], u))
        end += units[u]
    shard_of = dict.fromkeys(units, 0)
    for s in range(1, n):
        target = -(-s * total // n)
        a, b, u = next(x for x in ends if x[1] >= target)
        for v in units:
            shard_of[v] += v > u or v == u and b - target >= target - a
    return [(r[0], size(r), zlib.crc32((r[1] or "").encode()), "bytes", shard_of[whole(key(r))]) for r in rows]


@pytest.mark.parametrize(("n", "step", "bucket"), [(40, 3, 4096), (7, 1, 3), (1, 3, 4096), (300, 2, 10)])
def test_matches_brute_force(spark, monkeypatch, n, step, bucket):
    monkeypatch.setattr(shards, "STEP", step)
    monkeypatch.setattr(_ranks, "BUCKET_ROWS", bucket)
    rng = random.Random(n)
    rows = [(i, "é" * rng.randrange(50)) for i in range(150)] + [(i, "hot") for i in range(1000, 1100)] + [(5000, "x" * 9000), (5001, None), (None, "a"), (None, None)] + [(6000, "same")] * 20
    rng.shuffle(rows)
    got = shard(spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, size string, shard int"), n).collect()
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r)[:4] + (r.shard,) for r in got), key=order) == sorted(brute(rows, n), key=order)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_stay_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = shard(docs, 40)
    assert got.groupBy("shard").sum("size").toPandas()["sum(size)"].agg(lambda x: x.max() / x.mean()) < 1.06
    texts = got.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg({"size": "sum", "shard": "min", "doc_id": "count"}).toPandas()
    cut = got.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg({"shard": "max"}).toPandas()
    both = texts.merge(cut, on="text")
    share = texts["sum(size)"].sum() / 40
    assert (both[both["sum(size)"] <= shards.TOLERANCE * share].eval("`min(shard)` == `max(shard)`")).all()
