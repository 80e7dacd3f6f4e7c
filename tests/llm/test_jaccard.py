import random
import re

import numpy as np
import pytest

from quarry.llm import jaccard
from quarry.llm._components import components
from quarry.llm.jaccard import jaccard_components


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, percent=75):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"w{rng.randrange(10**6)}"], [out[at], "x"]])
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 6, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 5])):
            rows.append(" ".join(near(rng, base, rng.randrange(6)) if len(base) > 6 else base))
    hot = [word() for _ in range(150)]
    rows += [" ".join(near(rng, hot, rng.randrange(9))) for _ in range(150)]
    rows += [" ".join([word() for _ in range(30)] + hot[:100]) for _ in range(90)]
    rows += [rows[0]] * 40 + ["", None, " \n\t ", "one", "ONE", "one two", "a b c d e", "A B\nC d  e", "x " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [20_000, 30])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET_ENTRIES", 3000)
    rows = corpus()
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert len(got) == len(rows)


def test_odd_inputs(spark):
    schema = "n int, text string, set long, doc_id long, h string"
    empty = spark.createDataFrame([], schema)
    assert jaccard_components(empty).collect() == []
    rows = [(1, "a b c d e f", 0, 7, "x"), (1, "a b c d e f", 0, 7, "x"), (2, "g h", 0, 7, None), (3, "g h", 0, 9, ""), (4, "g h", 0, None, ""), (5, None, None, 3, "")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(7, 2, 7), (7, 2, 7), (7, 1, 7), (9, 1, 7), (None, 1, None), (3, 0, 3)], key=str)


def test_forest_keeps_every_pair():
    rng = np.random.default_rng(0)
    n = rng.integers(5, 400, 900)
    vec = rng.multinomial(1, [1 / jaccard.GROUPS] * jaccard.GROUPS, 900) * n[:, None] // 3
    vec = (vec + rng.integers(0, 9, vec.shape)).astype(np.int32)
    child = np.concatenate((np.zeros(500, int), rng.integers(1, 60, 400))).astype(np.uint64)
    comp = rng.integers(0, 3, 900)
    x, y = np.triu_indices(900, 1)
    ok = jaccard._passes(n[x], n[y], vec[x], vec[y], 75) & (child[x] == child[y])
    for own in (None, comp, n // 40):
        forest = jaccard.Forest(child, n, vec, own)
        assert sorted(forest.order) == list(range(900)) and len(forest.levels) > 3
        found = [tuple(sorted(p)) for a, b in forest.pairs(75) for p in zip(a.tolist(), b.tolist(), strict=True)]
        seen = set(found)
        assert len(seen) == len(found) and all(child[a] == child[b] for a, b in seen)
        apart = ok if own is None else ok & (own[x] != own[y])
        assert set(zip(x[apart].tolist(), y[apart].tolist(), strict=True)) <= seen
        assert forest.parted > 0 and len(seen) < (child[x] == child[y]).sum()
    assert list(jaccard.Forest(child[:0], n[:0], vec[:0]).pairs(75)) == []


def test_fine_bound():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**64, m, dtype=np.uint64)) for m in (1, 3, 40, 200, 900, 5000)]
    sets += [np.unique(np.concatenate((s[::2], rng.integers(0, 2**64, 50, dtype=np.uint64)))) for s in sets]
    x, y = np.triu_indices(len(sets))
    bound = jaccard._Fine([jaccard._fine(s) for s in sets], np.array([len(s) for s in sets])).bound(x, y)
    assert all(b >= len(np.intersect1d(sets[i], sets[j])) for b, i, j in zip(bound, x, y, strict=True))
    x, y = (np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(2))
    for more, most in ((0, 220), (1, 160)):  # unrelated sets: a link takes 258
        assert jaccard._Fine([jaccard._fine(x, more), jaccard._fine(y, more)], np.array([300, 300])).bound(np.array([0]), np.array([1])) < most


@pytest.mark.parametrize("large", [2, 64])
def test_groups_that_a_passage_joins(spark, monkeypatch, large):
    # Two groups of near copies around one passage, linked through a few documents only.
    monkeypatch.setattr(jaccard, "LARGE", large)
    monkeypatch.setattr(jaccard, "OPEN_ENTRIES", 400)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(90)]
    rows = []
    for _ in range(3):
        base = passage + [word() for _ in range(20)]
        rows += [" ".join(near(rng, base, rng.randrange(4))) for _ in range(80)]
    rows += [" ".join(passage + [word() for _ in range(rng.randrange(30))]) for _ in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_trees_decide_on_ordinary_tables(spark, monkeypatch):
    # Every candidate pair of sf0.1 comes out of a tree, and boxes part some of the nodes.
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").toArrow().column("text").combine_chunks()
    made = []

    class Counted(jaccard.Forest):
        def __init__(self, child, *more):
            super().__init__(child, *more)
            self.entries = len(child)
            made.append(self)

    monkeypatch.setattr(jaccard, "Forest", Counted)
    prefixes = jaccard._Prefixes(75, 1, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    blobs = jaccard.pa.Table.from_batches(list(jaccard._entries([jaccard.pa.record_batch([documents], names=["text"])], 5, prefixes)))
    met = jaccard._meet(blobs, 75)
    assert met.num_rows and sum(f.entries for f in made) > 1000 and sum(f.tested for f in made) >= met.num_rows
    assert sum(f.parted for f in made) > 0 and max(len(f.levels) for f in made) > 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(70)] + [(-5, 3), (7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in root} == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_id_with_several_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1, 13):  # each id holds one to four texts, and other ids near copies of them
        for j in range(i % 4 + 1):
            words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
            rows += [(i, " ".join(words)), (100 * i + j, " ".join([*words, "end"])), (100 * i + 10 + j, " ".join(words))]
    rows += [(1, None), (2, "")]
    rng.shuffle(rows)
    for parts in (1, 3):
        got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == len(rows)
        assert all(r.component_id == (r.doc_id if r.doc_id < 100 else r.doc_id // 100) for r in got)
