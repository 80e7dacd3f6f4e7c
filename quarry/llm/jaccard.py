"""Exact Jaccard join of documents on word shingles, over count-vector R-trees.

A document's set holds the hashes of its distinct shingles. The hashes fall into
GROUPS groups, and the counts of the groups make the document a point. Two points
bound the overlap of their sets by the sum of the smaller coordinates, and so do two
boxes by the sum of their upper corners' minima: trees of boxes are joined with
themselves, and only pairs whose bound reaches the threshold are verified on the sets.

In so many dimensions boxes of unrelated documents overlap, so one tree over all
points would compare nearly every pair. The root therefore has a child for each
shingle, and a document enters the children of its prefix shingles only: two sets of
similarity t must share one of the first n - ceil(t n) + 1 in any common order (cold
shingles first here, so that common passages rarely route). No linked pair is lost.
The children of a bucket are one forest, joined level by level for all of them at once.

Only connectivity is asked for, so groups of near copies are never expanded into
pairs. A child of over LARGE points gives star and neighbour pairs first, of the points
that have it among the first of their prefix. When those
have been verified, the points' components are known; children whose points all lie in
one are closed, and in the others a few points of different components meet, and then, once
more, all that are still in different ones, in trees again. Which children are large, and
which are open, is told by bitmaps of bounded size.

Pairs that pass the tree's bound meet a finer one of the same kind, over n / 2 to n
groups, before their texts are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import U64, ceil_div, materialise, mix64, release
from quarry.llm._components import components
from quarry.llm._filter import bitmap, holds, likely
from quarry.llm._text import Splitter, distinct_shingles, grams

GROUPS = 16
#: Points of a leaf of a tree, and nodes below a node.
LEAF, FAN = 8, 4
#: Points of a child up to which its tree is joined at once.
LARGE = 16
#: Points of one child that a task takes at most; a larger child is dealt in blocks.
BLOCK = 20_000
#: Entries for a task, by which the number of buckets is set; of open children, whose points carry more.
BUCKET_ENTRIES, OPEN_ENTRIES = 2_000_000, 100_000
#: Entries that a task holds before it sends them on.
FLUSH = 500_000
#: Shingles whose order is put last, at most; any choice of them gives the same links.
HOT = 262_144
#: Shingles that a task counts at a time to find common ones.
PROFILE_SHINGLES = 2_000_000
#: Pairs of nodes that a join holds at a time.
STEP = 1 << 14
#: A group's count saturates here: two counts to a byte.
_FULL = 15
_DOC = np.dtype([("set", "<u8"), ("n", "<u4"), ("entries", "<u2"), ("vec", "u1", GROUPS // 2)])
#: A child's name within its bucket is 32 bits of its shingle: two that share it are one child, which only adds
#: candidates. place is that in the point's prefix, in 63rds, rounded down, with the bits below.
_ENTRY = np.dtype([("h", "<u4"), ("place", "u1")])
#: The entry's child is dealt over several buckets; it is one of the point's LEADS.
_SALTED, _LEAD = 1 << 7, 1 << 6
_PLACES = _LEAD - 1
#: Entries of a point in one bucket, and so the size of a piece in which a longer one is sent.
_MOST = (1 << 16) - 1
#: Children of a point, the first of its prefix, in which it takes part in the pairs that large children give first.
LEADS = 8


def _fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s ^ U64(0x5851F42D4C957F2D)).sum() + U64(len(s))], dtype=np.uint64))[0])


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _counts(s: np.ndarray) -> np.ndarray:
    c = np.minimum(np.bincount((s >> U64(60)).astype(np.int64), minlength=GROUPS), _FULL).astype(np.uint8)
    return c[::2] << 4 | c[1::2]


def _fine(s: np.ndarray, more: int = 0) -> bytes:
    """Counts of a power of two of groups, one for each one or two shingles, or 2 ** more times as many; four counts to a byte."""
    bits = min(max(4, len(s).bit_length() - 1 + more), 18)
    c = np.minimum(np.bincount((s >> U64(64 - bits)).astype(np.int64), minlength=1 << bits), 3).astype(np.uint8).reshape(-1, 4)
    return (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes()


class _Fine:
    """Fine counts of some sets of n members, for bounds on pairs of them.

    What saturated counts leave out of n, a set's excess, is added to the sum of minima: the smaller
    excess where groups are the same, both where one set's groups are joined to fit the other's.
    """

    def __init__(self, rows: list[bytes], n: np.ndarray):
        self.size = np.array([4 * len(r) for r in rows], dtype=np.int64)
        self.excess = n.astype(np.int64)
        self.place = np.zeros(len(rows), dtype=np.int64)
        self.by_size = {}
        for g in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == g)
            self.place[own] = np.arange(len(own))
            self.by_size[g] = np.frombuffer(b"".join([rows[i] for i in own]), np.uint8).reshape(len(own), g // 4)
            for some in np.array_split(own, max(1, len(own) * g >> 20)):
                self.excess[some] -= self._rows(some, g, 1)[:, 0]

    def _rows(self, i: np.ndarray, g: int, to: int) -> np.ndarray:
        v = self.by_size[g][self.place[i]]
        v = np.stack((v >> 6, v >> 4 & 3, v >> 2 & 3, v & 3), axis=2).reshape(len(i), g)
        return v.reshape(len(i), to, g // to).sum(axis=2, dtype=np.int32) if g > to else v

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        kind = self.size[x] * (1 << 20) + self.size[y]
        for k in np.unique(kind).tolist():
            ga, gb = k >> 20, k & ((1 << 20) - 1)
            at = np.flatnonzero(kind == k)
            step = max(1, (1 << 20) // max(ga, gb))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                out[some] = _least(self._rows(x[some], ga, min(ga, gb)), self._rows(y[some], gb, min(ga, gb)))
            both = np.stack((self.excess[x[at]], self.excess[y[at]]))
            out[at] += both.min(axis=0) if ga == gb else both.sum(axis=0)
        return out


def _common(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in four sets or more, and in how many."""
    both = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, int)
    count = np.diff(np.append(at, len(both)))
    return both[at[count >= 4]], count[count >= 4]


_PROFILE = "doc_id long, n long, set long, fine binary, common boolean"


def _profile(batches, k: int):
    """A row for each text (doc_id, n, set, fine); rows (null, count, shingle) of those common among many texts."""
    split = Splitter(fold=True)
    names = ["doc_id", "n", "set", "fine", "common"]
    waiting, held = [], 0

    def common():
        h, count = _common(waiting)
        return pa.record_batch([pa.nulls(len(h), pa.int64()), pa.array(count), pa.array(_signed(h)), pa.nulls(len(h), pa.binary()), pa.array(np.ones(len(h), bool))], names=names)

    for batch in batches:
        ids = batch.column(0)
        for words in split.chunks(batch.column(1)):
            found = grams(words.hashes, k)
            sets = [distinct_shingles(words, i, found, k) for i in range(len(words))]
            marks = _signed([_fingerprint(s) if len(s) else 0 for s in sets])
            yield pa.record_batch([
                ids.slice(words.first, len(words)).cast(pa.int64()), pa.array(np.array([len(s) for s in sets], dtype=np.int64)), pa.array(marks),
                pa.array([_fine(s) for s in sets], pa.binary()), pa.array(np.zeros(len(sets), bool)),
            ], names=names)
            waiting.append(np.concatenate(sets))
            held += len(waiting[-1])
            if held >= PROFILE_SHINGLES:
                yield common()
                waiting, held = [], 0
    if waiting:
        yield common()
    release()


def _prefix_length(n, percent: int):
    return n + (-percent * n) // 100 + 1


def _places(n: int) -> np.ndarray:
    """The places in a prefix, in 63rds."""
    return (np.arange(n) * _PLACES // max(1, n - 1)).astype(np.uint8)


def _rest(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's shingles can be shared at most, if none before that place of its prefix is."""
    return n + (-place.astype(np.int64) * (_prefix_length(n, percent) - 1)) // _PLACES


class _Prefixes:
    """Which children a set enters: its prefix shingles, cold ones first."""

    def __init__(self, percent: int, buckets: int, hot_h: np.ndarray, hot_n: np.ndarray):
        self.made_of = percent, buckets, hot_h, hot_n
        by_value = np.argsort(hot_h)
        self.percent, self.buckets, self.hot = percent, buckets, hot_h[by_value]
        self.rank = np.argsort(np.argsort(hot_n[by_value], kind="stable"))
        self.salts = np.maximum(1, -(-hot_n[by_value] // BLOCK))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hot & U64((1 << 20) - 1)).astype(np.int64)] = True

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(prefix shingles, over how many buckets each child is dealt; None: one)."""
        n = len(s)
        probe = _prefix_length(n, self.percent)
        maybe = np.flatnonzero(self.seen[(s & U64((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe):
            return s[:probe], None
        at = np.minimum(np.searchsorted(self.hot, s[maybe]), len(self.hot) - 1)
        same = self.hot[at] == s[maybe]
        if not same.any():
            return s[:probe], None
        maybe, at = maybe[same], at[same]
        by = np.argsort(self.rank[at], kind="stable")
        first = np.concatenate((np.delete(s, maybe), s[maybe[by]]))[:probe]
        salts = np.concatenate((np.ones(n - len(maybe), np.int64), self.salts[at[by]]))[:probe]
        return first, salts if salts.max() > 1 else None

    def keys(self, first: np.ndarray) -> np.ndarray:
        """Children's names: bucket, and name within it."""
        return ((first >> U64(32)) % U64(self.buckets)) << U64(32) | first & U64(0xFFFFFFFF)

    def dealt(self) -> np.ndarray:
        """Names of the children that are dealt over several buckets, sorted."""
        return np.sort(self.keys(self.hot[self.salts > 1]))

    def __reduce__(self):
        return _Prefixes, self.made_of


def _entries(batches, k: int, prefixes: _Prefixes):
    """Blobs of points and of prefix entries, by bucket. A set that repeats within a blob is sent once."""
    split = Splitter(fold=True)
    docs, parts, marks, held = [], [], set(), 0

    def out():
        points = np.array(docs, dtype=_DOC)
        h, place, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((doc, bucket))
        h, doc, place, bucket = h[order], doc[order], place[order], bucket[order]
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            own, count = np.unique(doc[a:b], return_counts=True)
            pieces = -(-count // _MOST)
            some = points[np.repeat(own, pieces)]
            last = np.cumsum(pieces) - 1
            some["entries"] = _MOST
            some["entries"][last] = count - (pieces - 1) * _MOST
            e = np.empty(b - a, dtype=_ENTRY)
            e["h"], e["place"] = h[a:b], place[a:b]
            rows.append((int(bucket[a]), some.tobytes(), e.tobytes()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "points", "entries"])

    for batch in batches:
        for words in split.chunks(batch.column(0)):
            found = grams(words.hashes, k)
            for i in range(len(words)):
                s = distinct_shingles(words, i, found, k)
                mark = _fingerprint(s) if len(s) else 0
                if not len(s) or mark in marks:
                    continue
                first, salts = prefixes.of(s)
                key = prefixes.keys(first)
                bucket = (key >> U64(32)).astype(np.int64)
                place = _places(len(first))
                place[:LEADS] |= _LEAD
                if salts is not None:
                    bucket = (bucket + (mark >> 1) % salts) % prefixes.buckets
                    place[salts > 1] |= _SALTED
                marks.add(mark)
                docs.append((mark, len(s), 0, _counts(s)))
                parts.append((key & U64(0xFFFFFFFF), place, bucket))
                held += len(first)
                if held >= FLUSH:
                    yield out()
                    docs, parts, marks, held = [], [], set(), 0
    if docs:
        yield out()
    release()


def _least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=-1, dtype=np.int64)


def _wide(vec: np.ndarray) -> np.ndarray:
    """The counts of packed vectors; a saturated one bounds nothing."""
    vec = np.stack((vec >> 4, vec & 15), axis=2).reshape(len(vec), GROUPS).astype(np.int32)
    vec[vec == _FULL] = 1 << 24
    return vec


def _passes(na, nb, vec_a, vec_b, percent: int) -> np.ndarray:
    """Whether sizes and the sum of minima leave room for the threshold."""
    lo, hi = np.minimum(na, nb), np.maximum(na, nb)
    bound = np.minimum(_least(vec_a, vec_b), lo)
    return (100 * lo >= percent * hi) & ((100 + percent) * bound >= percent * (na + nb))


class Forest:
    """Packed R-trees over the points (n, counts) of many children at once, joined level by level.

    Leaves hold LEAF points, nodes FAN nodes. A node bounds its points' sizes from both sides,
    their counts from above, and their components, where these are given, from both sides.
    """

    def __init__(self, child: np.ndarray, n: np.ndarray, vec: np.ndarray, comp: np.ndarray | None = None):
        self.order = order = np.lexsort((*vec.T[3::-1], n, child))
        self.tested = self.parted = 0
        child = child[order]
        first = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1]))) if len(child) else np.zeros(0, np.int64)
        count, size = np.diff(np.append(first, len(child))), LEAF
        comp = np.zeros(len(n), np.int64) if comp is None else comp
        self.bounded = bool(len(comp)) and comp.min() != comp.max()
        lo, hi, top, least, most = n[order], n[order], vec[order], comp[order], comp[order]
        self.levels, self.roots = [], []
        while len(first):
            nodes = -(-count // size)
            base = np.cumsum(nodes) - nodes
            begin = np.repeat(first - base * size, nodes) + np.arange(int(nodes.sum())) * size
            end = np.minimum(begin + size, np.repeat(first + count, nodes))
            # Items between two trees' runs belong to trees that are done: cut them off.
            cuts = np.stack((begin, end), axis=1).ravel()
            fold = lambda f, x: f.reduceat(np.concatenate((x, x[-1:])), cuts, axis=0)[::2]  # noqa: B023, E731
            lo, hi, top = fold(np.minimum, lo), fold(np.maximum, hi), fold(np.maximum, top)
            least, most = fold(np.minimum, least), fold(np.maximum, most)
            self.levels.append((begin, end, lo, hi, top, least, most))
            self.roots.append(base[nodes == 1])
            go = nodes > 1
            first, count, size = base[go], nodes[go], FAN

    def _near(self, d: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether two nodes' boxes leave room for a link of two components."""
        _, _, lo, hi, top, least, most = self.levels[d]
        small, large = np.minimum(hi[i], hi[j]), np.maximum(lo[i], lo[j])
        ok = 100 * small >= percent * large
        if self.bounded:
            ok &= (least[i] != most[i]) | (least[j] != most[j]) | (least[i] != least[j])
        apart = np.flatnonzero(ok & (i != j))
        some, other = i[apart], j[apart]
        room = np.minimum(_least(top[some], top[other]), small[apart])
        ok[apart] = (100 + percent) * room >= percent * (lo[some] + lo[other])
        self.tested += len(i)
        self.parted += len(i) - int(ok.sum())
        return ok

    def pairs(self, percent: int):
        """Arrays (x, y) of points of one child that no two boxes part."""
        stack = [(d, roots, roots) for d, roots in enumerate(self.roots) if len(roots)]
        while stack:
            d, i, j = stack.pop()
            if len(i) > STEP:
                stack += [(d, i[STEP:], j[STEP:])]
                i, j = i[:STEP], j[:STEP]
            ok = self._near(d, i, j, percent)
            i, j = i[ok], j[ok]
            begin, end = self.levels[d][:2]
            wide, deep = end[i] - begin[i], end[j] - begin[j]
            cells = wide * deep
            own = np.repeat(np.arange(len(i)), cells)
            at = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
            x, y = begin[i][own] + at // deep[own], begin[j][own] + at % deep[own]
            keep = (i != j)[own] | (x < y if d == 0 else x <= y)
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            if d == 0:
                yield self.order[x], self.order[y]
            else:
                stack.append((d - 1, x, y))


_MET = "a long, b long, key long, m long"
_MET_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("m", pa.int64())])


def _meet(blobs: pa.Table, percent: int) -> pa.Table:
    """Candidate pairs (a, b) of a bucket's children; its large children as (null, null, key, points)."""
    bucket = blobs.column("bucket")[0].as_py()
    points = np.concatenate([np.frombuffer(p, _DOC) for p in blobs.column("points").to_pylist()])
    e = np.concatenate([np.frombuffer(e, _ENTRY) for e in blobs.column("entries").to_pylist()])
    order = np.argsort(e["h"])
    h = e["h"][order]
    twin = h[1:] == h[:-1]
    keep = np.concatenate(([False], twin)) | np.concatenate((twin, [False])) | (e["place"][order] >= _SALTED)
    order, h = order[keep], h[keep]
    doc = np.repeat(np.arange(len(points), dtype=np.int32), points["entries"])[order]
    place = e["place"][order]
    salted, lead, place = place >> 7, (place & _LEAD) > 0, place & _PLACES
    _, one, uid = np.unique(points["set"], return_index=True, return_inverse=True)
    points, uid = points[one], uid[doc]
    order = np.lexsort((place, uid, h))
    h, uid, place, salted, lead = h[order], uid[order], place[order], salted[order], lead[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (uid[1:] != uid[:-1]))) if len(h) else np.zeros(0, bool)
    h, uid, place, salted, lead = h[new], uid[new], place[new], salted[new], lead[new]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    length = np.diff(np.append(start, len(h)))
    n, vec, mark = points["n"].astype(np.int64), _wide(points["vec"]), _signed(points["set"])
    spread = np.maximum.reduceat(salted, start) > 0 if len(h) else np.zeros(0, bool)
    pairs = [np.zeros(0, np.int64)]
    u = len(points)

    def note(x, y):
        ok = _passes(n[x], n[y], vec[x], vec[y], percent)
        x, y = x[ok], y[ok]
        pairs.append(np.unique(np.minimum(x, y) * u + np.maximum(x, y)))

    size = n[uid]
    rest = _rest(size, place, percent)
    small = np.flatnonzero((length > 1) & (length <= LARGE) & ~spread)
    # Trees of some 100 000 points at a time.
    for part in np.split(small, np.flatnonzero(np.diff(np.cumsum(length[small]) // 100_000)) + 1) if len(small) else ():
        own = np.repeat(start[part], length[part]) + np.arange(int(length[part].sum())) - np.repeat(np.cumsum(length[part]) - length[part], length[part])
        who = uid[own]
        for i, j in Forest(np.repeat(part, length[part]), n[who], vec[who]).pairs(percent):
            x, y = own[i], own[j]
            # What stands before the first shingle that two sets share isn't shared.
            ok = (100 + percent) * np.minimum(rest[x], rest[y]) >= percent * (n[uid[x]] + n[uid[y]])
            note(uid[x[ok]], uid[y[ok]])
    large = np.flatnonzero((length > LARGE) | spread & (length > 1))
    for a, m in zip(start[large], length[large], strict=True):
        members = uid[a : a + m][lead[a : a + m]]
        if len(members) < 2:
            continue
        line = members[np.argsort(n[members], kind="stable")]
        pivot = np.full(len(line), line[len(line) // 2])
        note(line[line != pivot], pivot[line != pivot])
        note(line[1:], line[:-1])
    pairs = np.unique(np.concatenate(pairs))
    wait = np.flatnonzero((length > LARGE) & ~spread)
    none = lambda k: pa.nulls(k, pa.int64())
    release()
    met = [mark[pairs // max(u, 1)], mark[pairs % max(u, 1)], none(len(pairs)), none(len(pairs))]
    open_ = [none(len(wait)), none(len(wait)), bucket << 32 | h[start[wait]].astype(np.int64), length[wait]]
    return pa.concat_tables([pa.table(met, schema=_MET_ARROW), pa.table(open_, schema=_MET_ARROW)])


_KEYED = np.dtype([("key", "<u8"), ("place", "u1")])
_ROUTED = "set long, n long, vec binary, fine binary, keys binary"


def _routed(batches, k: int, prefixes: _Prefixes, bits: bytes):
    """(set, n, vec, fine, keys) of the sets that enter children of the bitmap; keys in the order of the prefix."""
    split = Splitter(fold=True)
    for batch in batches:
        marks, rows = set(), []
        for words in split.chunks(batch.column(0)):
            found = grams(words.hashes, k)
            for i in range(len(words)):
                s = distinct_shingles(words, i, found, k)
                if not len(s):
                    continue
                key = prefixes.keys(prefixes.of(s)[0])
                at = np.flatnonzero(holds(bits, key))
                if not len(at):
                    continue
                mark = int(_signed([_fingerprint(s)])[0])
                if mark not in marks:
                    marks.add(mark)
                    own = np.empty(len(at), dtype=_KEYED)
                    own["key"], own["place"] = key[at], _places(len(key))[at]
                    rows.append((mark, len(s), _counts(s).tobytes(), _fine(s, 1), own.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.binary()] * 3, strict=True)], names=["set", "n", "vec", "fine", "keys"])
    release()


_SPAN = np.dtype([("key", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("m", "<i8")])


def _folded(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, m: np.ndarray) -> np.ndarray:
    """One span for each key."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    out = np.zeros(len(at), dtype=_SPAN)
    if len(at):
        out["key"], out["lo"], out["hi"], out["m"] = key[at], np.minimum.reduceat(lo[order], at), np.maximum.reduceat(hi[order], at), np.add.reduceat(m[order], at)
    return out


def _spans(batches, buckets: int):
    """Blobs of children's spans (least and greatest component, points), by bucket, from (keys, comp)."""
    key, comp, held = [], [], 0

    def out():
        keys = np.concatenate(key)
        c = np.repeat(np.array(comp, dtype=np.int64), [len(x) for x in key])
        found = _folded(keys, c, c, np.ones(len(keys), np.int64))
        bucket = (mix64(found["key"]) % U64(buckets)).astype(np.int64)
        found = found[np.argsort(bucket, kind="stable")]
        own, first = np.unique(np.sort(bucket), return_index=True)
        return pa.record_batch([pa.array(own, pa.int32()), pa.array([x.tobytes() for x in np.split(found, first[1:])], pa.binary())], names=["bucket", "spans"])

    for batch in batches:
        for x, c in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            key.append(np.frombuffer(x, _KEYED)["key"])
            comp.append(c)
            held += len(key[-1])
            if held >= FLUSH:
                yield out()
                key, comp, held = [], [], 0
    if key:
        yield out()


def _opened(blobs: pa.Table, always: np.ndarray) -> pa.Table:
    """Large children, and those of always (sorted), whose points lie in several components: (key, points)."""
    x = np.concatenate([np.frombuffer(s, _SPAN) for s in blobs.column("spans").to_pylist()])
    x = _folded(x["key"], x["lo"], x["hi"], x["m"])
    x = x[(x["lo"] != x["hi"]) & ((x["m"] > LARGE) | np.isin(x["key"], always))]
    return pa.table({"key": x["key"].view(np.int64), "m": x["m"]})


_POINT = np.dtype([("set", "<i8"), ("doc", "<i8"), ("comp", "<i8"), ("top", "<u8"), ("n", "<i8"), ("vec", "u1", GROUPS // 2)])
_SIDED = np.dtype([("child", "<u8"), ("key", "<u8"), ("point", "<u4"), ("side", "u1"), ("place", "u1")])


def _points(batches, buckets: int, bits: bytes, split_keys: np.ndarray, split_into: np.ndarray):
    """Blobs of points and entries of open children, by bucket, from (set, doc_id, comp, n, vec, fine, keys).

    A point's top is the first open child of its prefix. A child of split_keys is dealt in pairs of blocks; side tells
    in which of the two a point is (2: both)."""
    points, fine, parts, held = [], [], [], 0

    def out():
        own = np.concatenate(parts)
        own["point"] = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        bucket = (mix64(own["child"]) % U64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        own, bucket = own[order], bucket[order]
        all_points = np.array(points, dtype=_POINT)
        rows = []
        cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            some, back = np.unique(own["point"][a:b], return_inverse=True)
            piece = own[a:b].copy()
            piece["point"] = back
            rows.append((int(bucket[a]), all_points[some].tobytes(), [fine[i] for i in some], piece.tobytes()))
        types = (pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.binary())
        return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["bucket", "points", "fine", "entries"])

    for batch in batches:
        for mark, doc, comp, n, vec, f, keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own_keys = np.frombuffer(keys, _KEYED)
            own_keys = own_keys[holds(bits, own_keys["key"])]
            key = own_keys["key"]
            if not len(key):
                continue
            e = np.zeros(len(key), dtype=_SIDED)
            e["child"], e["key"], e["side"], e["place"] = key, key, 2, own_keys["place"]
            many = np.isin(key, split_keys)
            if many.any():
                dealt = [e[~many]]
                for x, place in zip(key[many], own_keys["place"][many], strict=True):
                    into = int(split_into[np.searchsorted(split_keys, x)])
                    own, other = mark % into, np.arange(into)
                    piece = np.zeros(into, dtype=_SIDED)
                    with np.errstate(over="ignore"):
                        block = np.minimum(own, other).astype(np.uint64) * U64(into) + np.maximum(own, other).astype(np.uint64) + U64(1)
                        piece["child"] = mix64(x ^ mix64(block))
                    piece["key"], piece["place"], piece["side"] = x, place, np.where(other == own, 2, np.where(own < other, 0, 1))
                    dealt.append(piece)
                e = np.concatenate(dealt)
            points.append((mark, doc, comp, key[0], n, np.frombuffer(vec, np.uint8)))
            fine.append(f)
            parts.append(e)
            held += len(e)
            if held >= FLUSH:
                yield out()
                points, fine, parts, held = [], [], [], 0
    if points:
        yield out()


_PAIR = "a long, b long, doc_a long, doc_b long"


def _sparse(e: np.ndarray, n: np.ndarray, vec: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries next to each other in the order of their child's points, and one of each component with a middle one."""
    who = e["point"]
    order = np.lexsort((*vec[who].T[3::-1], n[who], e["child"]))
    child, c = e["child"][order], comp[who][order]
    next_ = np.flatnonzero(child[1:] == child[:-1])
    start = np.flatnonzero(np.concatenate(([True], child[1:] != child[:-1])))
    size = np.diff(np.append(start, len(child)))
    middle = np.repeat(start + size // 2, size)
    by = np.lexsort((c, child))
    first = by[np.concatenate(([True], (child[by][1:] != child[by][:-1]) | (c[by][1:] != c[by][:-1])))]
    return order[np.concatenate((next_, first))], order[np.concatenate((next_ + 1, middle[first]))]


def _across(blobs: pa.Table, percent: int, sparse: bool) -> pa.Table:
    """Pairs of points of open children that lie in different components and pass the bounds, by a join of their trees.

    Two points that share another child as their top meet there. A pair whose first shared shingle has a child that isn't
    open is linked already or not similar, so that what stands before this child in a prefix counts as not shared. sparse: only a few pairs of each child, to join
    components before all others meet."""
    points, entries, base = [], [], 0
    for p, e in zip(blobs.column("points").to_pylist(), blobs.column("entries").to_pylist(), strict=True):
        points.append(np.frombuffer(p, _POINT))
        entries.append(np.frombuffer(e, _SIDED).copy())
        entries[-1]["point"] += base
        base += len(points[-1])
    p, e = np.concatenate(points), np.concatenate(entries)
    fine = _Fine([f for row in blobs.column("fine").to_pylist() for f in row], p["n"])
    n, vec, comp, top = p["n"], _wide(p["vec"]), p["comp"], p["top"]
    who, key, side = e["point"].astype(np.int64), e["key"], e["side"]
    found = [np.zeros((0, 2), np.int64)]
    rest = _rest(n[who], e["place"], percent)
    for i, j in [_sparse(e, n, vec, comp)] if sparse else Forest(e["child"], n[who], vec[who], comp[who]).pairs(percent):
        x, y = who[i], who[j]
        ok = comp[x] != comp[y]
        if not sparse:
            ok &= ((top[x] != top[y]) | (top[x] == key[i])) & ((side[i] == 2) | (side[i] != side[j]))
            ok &= (100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (n[x] + n[y])
        x, y = x[ok], y[ok]
        ok = _passes(n[x], n[y], vec[x], vec[y], percent)
        x, y = x[ok], y[ok]
        ok = (100 + percent) * fine.bound(x, y) >= percent * (n[x] + n[y])
        x, y = x[ok], y[ok]
        swap = p["set"][x] > p["set"][y]
        found.append(np.unique(np.stack((np.where(swap, y, x), np.where(swap, x, y)), axis=1), axis=0))
    x, y = np.unique(np.concatenate(found), axis=0).T
    release()
    return pa.table({"a": p["set"][x], "b": p["set"][y], "doc_a": p["doc"][x], "doc_b": p["doc"][y]})


def _finer(batches, percent: int):
    """The pairs (a, b, doc_a, doc_b) that the finer bound leaves, from those and (n_a, n_b, fine_a, fine_b)."""
    for batch in batches:
        n_a, n_b = (batch.column(c).to_numpy() for c in (4, 5))
        m = batch.num_rows
        bound = _Fine(batch.column(6).to_pylist() + batch.column(7).to_pylist(), np.concatenate((n_a, n_b))).bound(np.arange(m), np.arange(m, 2 * m))
        yield batch.select([0, 1, 2, 3]).filter(pa.array((100 + percent) * bound >= percent * (n_a + n_b)))


def _similar(batches, k: int, percent: int):
    """(doc_a, doc_b) of the rows (a, b, doc_a, doc_b, text_a, text_b) whose sets are similar enough. A row may hold another text of the same id."""
    split = Splitter(fold=True)
    for batch in batches:
        marks = np.concatenate([batch.column(c).to_numpy() for c in (0, 1)])
        texts = pa.concat_arrays([batch.column(4), batch.column(5)])
        which = texts.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        one, at = np.unique(np.stack((marks, which.astype(np.int64))), axis=1, return_index=True)
        sets = []
        for words in split.chunks(texts.take(pa.array(at))):
            found = grams(words.hashes, k)
            sets += [distinct_shingles(words, i, found, k) for i in range(len(words))]
        own = {(m, w): s for m, w, s in zip(*one.tolist(), sets, strict=True) if _signed([_fingerprint(s)])[0] == m}  # not another text of the id
        links = []
        half = batch.num_rows
        for i in range(half):
            x, y = (own.get((int(marks[j]), int(which[j]))) for j in (i, half + i))
            both = len(np.intersect1d(x, y, assume_unique=True)) if x is not None and y is not None else -1
            links.append(both >= 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield pa.record_batch(batch.select([2, 3]).filter(pa.array(links, pa.bool_())).columns, names=["a", "b"])


def _bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs that the finer bound leaves, with their documents."""
    side = lambda c: sets.select(F.col("set").alias(c), F.col("doc_id").alias(f"doc_{c}"), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return materialise(both.select("a", "b", "doc_a", "doc_b", "n_a", "n_b", "fine_a", "fine_b").mapInArrow(lambda it: _finer(it, percent), _PAIR))


def _verified(pairs: DataFrame, docs: DataFrame, repeated: bool, k: int, percent: int) -> DataFrame:
    """Links (a, b) between the documents of the pairs whose sets are similar."""
    ids = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("doc_id")).distinct()
    texts = likely(docs, ids)
    if repeated:
        texts = texts.dropDuplicates(["doc_id", "text"])
    side = lambda c: texts.select(F.col("doc_id").alias(f"doc_{c}"), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "doc_a").join(side("b"), "doc_b").select("a", "b", "doc_a", "doc_b", "text_a", "text_b")
    return materialise(both.mapInArrow(lambda it: _similar(it, k, percent), "a long, b long").distinct())


def _route(docs: DataFrame, sets: DataFrame, large: DataFrame, prefixes: _Prefixes, k: int) -> DataFrame:
    """(set, doc_id, n, vec, fine, keys) of the sets that enter large children."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(large, F.col("key"), prefixes.dealt()))
    routed = docs.select("text").mapInArrow(lambda it: _routed(it, k, prefixes, bits.value), _ROUTED).dropDuplicates(["set"])
    return materialise(routed.join(sets.select("set", "doc_id"), "set").select("set", "doc_id", "n", "vec", "fine", "keys"))


def _open_pairs(routed: DataFrame, entries: int, roots: DataFrame, always: np.ndarray, percent: int, sparse: bool) -> DataFrame:
    """Pairs that meet in large children whose points lie in several components."""
    routed = routed.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("set", "doc_id", F.coalesce("root", "doc_id").alias("comp"), "n", "vec", "fine", "keys")
    buckets = max(1, ceil_div(entries, BUCKET_ENTRIES))
    spans = routed.select("keys", "comp").mapInArrow(lambda it: _spans(it, buckets), "bucket int, spans binary")
    open_ = materialise(spans.groupBy("bucket").applyInArrow(lambda t: _opened(t, always), "key long, m long"))
    held = open_.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    # A child beyond this is dealt in blocks: of a million such, at most, names come to the driver.
    most = max(BLOCK, entries // 1_000_000)
    many = open_.where(F.col("m") > most).collect()
    keys = np.array([r["key"] for r in many], dtype=np.int64).view(np.uint64)
    into = np.array([ceil_div(r["m"], BLOCK) for r in many], dtype=np.int64)[np.argsort(keys)]
    keys = np.sort(keys)
    bits = routed.sparkSession.sparkContext.broadcast(bitmap(open_, F.col("key"), np.zeros(0, np.uint64)))
    buckets_open = max(1, ceil_div(held, OPEN_ENTRIES))
    dealt = routed.mapInArrow(lambda it: _points(it, buckets_open, bits.value, keys, into), "bucket int, points binary, fine array<binary>, entries binary")
    return materialise(dealt.groupBy("bucket").applyInArrow(lambda t: _across(t, percent, sparse), _PAIR).distinct())


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shingle count and component under links of Jaccard similarity >= percent / 100.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are k consecutive
    words; fewer words make one shingle. Null, empty and blank texts have no shingle,
    link with nothing and are their own component. Documents with equal sets always link.
    Rows that repeat an id keep a row each and count as one vertex; rows without an id
    keep a row with a null component. Whole texts of any length are used; other columns
    are ignored. Shingles are compared by 64-bit hashes.

    Columns: doc_id, n_shingles long, component_id (smallest id reachable by links).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = materialise(docs.mapInArrow(lambda it: _profile(it, k), _PROFILE))
    common = profile.where("common").groupBy("set").agg(F.sum("n").alias("n")).where("n >= 16")
    common = common.orderBy(F.desc("n"), "set").limit(HOT).collect()
    hot_h = np.array([r["set"] for r in common], dtype=np.int64).view(np.uint64)
    hot_n = np.array([r["n"] for r in common], dtype=np.int64)
    each = profile.where("not common").drop("common")
    total = each.agg(F.coalesce(F.sum(F.col("n") * (100 - percent) / 100 + 1), F.lit(0))).first()[0]
    prefixes = _Prefixes(percent, max(1, ceil_div(int(total), BUCKET_ENTRIES)), hot_h, hot_n)

    blobs = docs.select("text").mapInArrow(lambda it: _entries(it, k, prefixes), "bucket int, points binary, entries binary")
    met = materialise(blobs.groupBy("bucket").applyInArrow(lambda t: _meet(t, percent), _MET))
    # The vertices are documents: of each set the one of smallest id, so that a component's smallest vertex is its name.
    known = each.where("n > 0 and doc_id is not null")
    # A set whose rows all lack an id links with nothing; the sets of an id that repeats hang together by it.
    sets = materialise(known.groupBy("set").agg(F.min(F.struct("doc_id", "n", "fine")).alias("one")).select("set", "one.*"))
    twice = materialise(known.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    repeated = not twice.isEmpty()
    pairs = _bounded(met.where("b is not null").select("a", "b"), sets, percent)
    links = _verified(pairs, docs, repeated, k, percent)
    large = met.where("key is not null").select("key")
    if len(prefixes.dealt()) or not large.isEmpty():
        routed = _route(docs, sets, large, prefixes, k)
        entries = routed.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0] // _KEYED.itemsize
        for sparse in (True, False):
            again = _open_pairs(routed, entries, components(links), prefixes.dealt(), percent, sparse)
            links = links.unionByName(_verified(again, docs, repeated, k, percent))
    if repeated:
        several = known.join(twice.where("a <> b").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), "set").distinct()
        links = links.unionByName(several.join(sets.select("set", F.col("doc_id").alias("b")), "set").select("a", "b"))
    roots = components(links)

    named = sets.select("set", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = materialise(named.select("set", F.coalesce("root", "doc_id").alias("component_id")))
    linked = known.select("doc_id", "n", "set").join(named, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = each.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
