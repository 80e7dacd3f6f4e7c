import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import substrings
from quarry.llm.fm_index import Bits, FMIndex, WaveletMatrix, suffix_order
from quarry.llm.substrings import remove_repeats


def brute(rows, window=20):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(docs, key=lambda d: d[0]):
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (i, s))
    out = {}
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(60))
    passages = [[word() for _ in range(rng.choice([15, 20, 21, 40, 90]))] for _ in range(8)]
    rows = []
    for _ in range(120):
        text = []
        for _ in range(rng.randrange(4)):
            text += [word() for _ in range(rng.randrange(40))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                cut = rng.randrange(len(p))
                text += p if rng.random() < 0.6 else p[cut:] if rng.random() < 0.5 else p[: cut + 1]
        rows.append(" ".join(text))
    rows += [rows[3]] * 5 + ["The " * 70, "x " + "The " * 30, "", None, "one two", " ".join(passages[3]), "é è\n" * 25, "a b " * 200]
    rng.shuffle(rows)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True)])
def test_matches_brute_force(spark, monkeypatch, seed, small):
    if small:
        for name, value in {"BUCKET_ENTRIES": 50, "SHARD_WORDS": 500, "FLUSH": 120, "HOT": 6}.items():
            monkeypatch.setattr(substrings, name, value)
    rows = corpus(seed)
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute(rows)
    for r in got:
        if r.kept is not None:
            assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256
    assert any(r.n_removed for r in got) and any(r.kept for r in got)


def test_odd_inputs(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(5, passage, 1), (5, passage, 1), (None, passage, 1), (7, f"x {passage}", 1), (5, "other", 1)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 30, 0), (5, 1, 0), (5, 30, 0), (5, 30, 0), (7, 31, 30)]
    assert [r.kept for r in got if r.doc_id == 7] == ["x"]


def test_rank_and_search():
    rng = np.random.default_rng(0)
    bits = rng.random(1000) < 0.3
    at = np.arange(1001)
    assert (Bits(bits).rank(at) == np.concatenate(([0], np.cumsum(bits)))).all()
    text = rng.integers(0, 11, 3000)
    tree = WaveletMatrix(text, 11)
    for s in range(11):
        assert (tree.rank(np.full(3001, s), np.arange(3001)) == np.concatenate(([0], np.cumsum(text == s)))).all()
    text = np.append(rng.integers(1, 4, 600), 0)
    index = FMIndex(text, 4)
    assert (index.locate(np.arange(601)) == suffix_order(text)).all() and len(index.places) < 601 // 2
    symbol, before = WaveletMatrix(text, 4).at(np.arange(601))
    assert (symbol == text).all() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in range(601)]
    at = np.arange(600 - 5)
    matched, (found, lo, hi) = index.statistics(text, at, 6)
    twice = lambda w: sum(tuple(text[i : i + len(w)]) == w for i in range(601)) > 1
    assert matched.tolist() == [max((m for m in range(1, 7) if twice(tuple(text[a + 6 - m : a + 6]))), default=0) for a in at]
    words = [tuple(text[a : a + 6]) for a in at]
    where = {}
    for a, w in enumerate(words):
        where.setdefault(w, []).append(a)
    assert sorted(found) == sorted(a for v in where.values() if len(v) > 1 for a in v)
    assert (hi - lo == [len(where[words[a]]) for a in found]).all()
    assert (index.earliest(lo, hi) == [where[words[a]][0] for a in found]).all()
