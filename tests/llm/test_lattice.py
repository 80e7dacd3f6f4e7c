import math

import numpy as np
import pytest

from quarry.llm import lattice
from quarry.llm.lattice import Hasher, nearest_e8, near_duplicates


def brute(rows, floor=0.98):
    """(links by id, component by id) over rows (id, vector, label)."""
    def usable(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, dtype=np.float64), lab) for i, v, lab in rows if usable(v, lab)]
    links, root = {i: set() for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, u, a) in enumerate(good):
        for j, v, b in good[x + 1 :]:
            if a == b and len(u) == len(v) and (np.array_equal(u, v) or u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= floor):
                links[i].add(j)
                links[j].add(i)
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: len(s) for i, s in links.items()}, {i: find(i) for i in links}


def clouds(rng, dim, n):
    out = []
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.choice([1, 1, 2, 4])):
            out.append(base / np.linalg.norm(base) + rng.normal(size=dim) * rng.choice([0, 0.05, 0.15, 0.18]) / math.sqrt(dim))
    return out


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (300, 8))
    p = nearest_e8(x)
    doubled = np.rint(2 * p)
    assert np.allclose(doubled, 2 * p) and (np.ptp(doubled % 2, axis=1) == 0).all() and np.allclose(p.sum(axis=1) % 2, 0)
    near = p[:, None] + lattice._minimal()[None]
    assert (((x[:, None] - near) ** 2).sum(axis=2).min(axis=1) >= ((x - p) ** 2).sum(axis=1) - 1e-9).all()
    assert len({tuple(v) for v in lattice._minimal()}) == 240


@pytest.mark.parametrize("block", [2048, 16])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "BLOCK", block)
    monkeypatch.setattr(lattice, "BUCKET_ROWS", 500)
    rng = np.random.default_rng(4)
    vecs = clouds(rng, 64, 70)
    hot = rng.normal(size=64)
    hot /= np.linalg.norm(hot)
    vecs += [hot + rng.normal(size=64) * 0.1 / 8 for _ in range(120)] + [vecs[0]] * 30
    rows = [(i, [float(x) for x in np.float32(v)], int(rng.integers(0, 2)) if i < 100 else 1) for i, v in enumerate(vecs)]
    # Vectors next to the threshold would hang on the last bit.
    links, root = brute(rows)
    got = {r.vec_id: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == root
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_inputs(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1e300, 0.0], 1), (5, [-1.0, 0.0], 1), (6, [0.0, 0.0], 1), (7, None, 1), (8, [], 1), (10, [1.0, None], 1),
        (11, [nan, 1.0], 1), (12, [inf, 1.0], 1), (13, [1.0, 0.0], None), (14, [1.0, 0.0], 2), (15, [1.0, 0.0, 0.0], 1),
    ]
    schema = "vec_id long, embedding array<double>, label int, n long, cells string, vec string"
    df = spark.createDataFrame([(*r, 1, "", "") for r in [*rows, (None, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [0.0, 1.0], 2)]], schema)
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    want = [(-1, 0, None, True)] + [(9, 2, 3, False)] * 3 + [(3, 2, 3, True), (4, 2, 3, False)] + [(i, 0, i, True) for i in (5, 6, 7, 8, 10, 11, 12, 13, 14, 15)]
    assert got == sorted(want, key=str)
    assert near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [2, 4])
def test_recall_at_the_threshold(parts):
    rng = np.random.default_rng(8)
    a = lattice._units(rng.normal(size=(3000, 64)))
    side = rng.normal(size=a.shape)
    side = lattice._units(side - (side * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.98, 0.983, (3000, 1))
    b = cos * a + np.sqrt(1 - cos**2) * side
    hasher = Hasher(64, parts)
    x, y = (np.concatenate((o[:, :, None], v), axis=2) for o, v in (hasher.cells(a), hasher.cells(b)))
    recall = (lattice._first_way(x, y) < 3 * lattice.TABLES).mean()
    print("recall of pairs at cosine 0.980 to 0.983:", recall)
    assert recall >= (0.99 if parts == 2 else 0.9)


@pytest.mark.parametrize("parts", [2, 3, 4, 5, 6])
def test_recall_does_not_fall_with_parts(parts):
    rng = np.random.default_rng(1)
    a = lattice._units(rng.normal(size=(4000, 64)))
    side = rng.normal(size=a.shape)
    side = lattice._units(side - (side * a).sum(axis=1, keepdims=True) * a)
    hasher = Hasher(64, parts)
    x, y = (np.concatenate((o[:, :, None], v), axis=2) for o, v in (hasher.cells(a), hasher.cells(0.98 * a + math.sqrt(1 - 0.98**2) * side)))
    assert (lattice._first_way(x, y) < 3 * x.shape[1]).mean() >= 0.999


def test_parts_follow_the_count():
    assert [lattice.parts_for(n) for n in (2, 2**17 - 1, 2**17, 2**25 - 1, 2**25)] == [2, 2, 3, 3, 4]


def test_three_parts_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lattice, "parts_for", lambda n: 3)
    rows = [(i, [float(x) for x in np.float32(v)], 1) for i, v in enumerate(clouds(np.random.default_rng(5), 64, 80))]
    links, root = brute(rows)
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == links and {r.vec_id: r.component_id for r in got} == root
