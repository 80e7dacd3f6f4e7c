import math

import numpy as np
import pytest

from quarry.llm.topk import top_k


def brute(rows, k=20):
    """{query id: [(rank, vec_id, score)]} over rows (id, vector)."""
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(q, c, strict=True)), j) for j, c in ok if j != i and len(c) == len(q)))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {i: sorted(v) for i, v in out.items()}


@pytest.mark.parametrize(("tile", "shard", "fan"), [(512, 8192, 16), (3, 16, 2), (1, 7, 3)])
def test_matches_brute_force(spark, tile, shard, fan):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.choice([-0.3, 0.0, 0.1, 0.5, 0.999], 6)]) for i in range(200)]
    rows += [(1000, None), (1020, [0.1] * 5 + [float("nan")]), (1040, [0.1] * 6), (1041, [1e6] * 6), (1060, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = found(top_k(df.where("vec_id % 20 = 0"), df, 20, tile_rows=tile, shard_rows=shard, fan=fan))
    assert got == brute(rows)


def test_few_candidates_and_odd_rows(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (4, [1.0], 1), (20, [1.0], 1), (40, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df.where("vec_id % 20 = 0"), df).collect())
    assert got == [(0, 1, 3, 2048), (0, 1, 3, 2048), (0, 2, 3, 2048), (0, 2, 3, 2048), (20, 1, 4, 4096)]
    assert top_k(df.limit(0), df).collect() == [] and top_k(df.where("vec_id = 0"), df.limit(0)).collect() == []


def test_exact_beyond_doubles(spark):
    rows = [(0, [2.0**40, 1.0]), (1, [2.0**10, 1.0]), (2, [2.0**10, 2.0]), (3, [2.0**60, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[1:4] for r in sorted(top_k(df.where("vec_id = 0"), df).collect(), key=lambda r: r.rank)]
    assert got == [(1, 3, 2**63 - 1), (2, 2, 2**62 + 8192), (3, 1, 2**62 + 4096)]
