"""Removal of repeated word sequences, found by FM-indexes.

A window is so many consecutive words. Windows are sent to shards by their minimiser, the
smallest hash of a five-word sequence in them, so that equal windows meet; neighbouring
windows of one minimiser travel as one segment. Minimisers that occur once in the corpus
are found first, from their hashes alone, and their windows are done. Each shard builds an
compressed FM-index of its segments; backward search over its wavelet matrix gives matching
statistics: it extends every window's match from the right until it is unique, and reports the
intervals that reach the window's length. The earliest position of an interval tells which windows start earlier elsewhere.

Equal texts, and equal segments, are collapsed before they are sent: the later ones are
repeated by that alone. A minimiser that is very common by itself sends its windows by
their own hash instead, so no shard holds more than a bounded share of it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import U64, ceil_div, materialise, mix64
from quarry.llm._filter import likely
from quarry.llm._text import Splitter, grams
from quarry.llm.fm_index import FMIndex

GRAM = 5
#: Entries of minimisers for a bucket, and words for a shard, by which their numbers are set.
BUCKET_ENTRIES, SHARD_WORDS = 1_000_000, 400_000
#: Entries or words that a task gathers before it sends them on.
FLUSH = 500_000
#: A minimiser with more segments than this, or than a millionth of all, sends its windows alone.
HOT = 20_000
_WORDS = U64((1 << 40) - 1)  # words are told apart by 40 bits, windows thus by length times as many

_NAME = np.dtype([("doc", "<i8"), ("mark", "<u8")])
_ENTRY = np.dtype([("low", "<u8"), ("name", "<u2"), ("start", "<u4"), ("n", "<u4"), ("kind", "u1")])
_SPAN = np.dtype([("start", "<u4"), ("n", "<u4")])
_SEGMENT = np.dtype([("doc", "<i8"), ("mark", "<u8"), ("start", "<u4"), ("n", "<u4"), ("kind", "u1")])
#: Entries: one to be matched; one whose minimiser is known to be repeated; a result that only passes through.
_OPEN, _KNOWN, _DONE = 0, 1, 2
_NAMES = (1 << 16) - 1


def _mark(hashes: np.ndarray) -> int:
    """A hash of a word sequence."""
    with np.errstate(over="ignore"):
        place = mix64(np.arange(1, len(hashes) + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
        return int(mix64(np.array([(hashes * (place | U64(1))).sum(dtype=np.uint64) + U64(len(hashes))], dtype=np.uint64))[0])


def _lows(hashes: np.ndarray, window: int) -> np.ndarray:
    """The minimiser of every window; for windows shorter than GRAM, the hash of the window."""
    g = grams(hashes, min(GRAM, window))
    size = window - min(GRAM, window) + 1
    done = 1
    while done < size:  # minima over 2, 4, ... then over size
        step = min(done, size - done)
        g = np.minimum(g[: len(g) - step], g[step:])
        done += step
    return g


def _cuts(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: where they start, and how many windows they have."""
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    return start, np.diff(np.append(start, len(low)))


def _echoes(hashes: np.ndarray, window: int) -> np.ndarray:
    """Running count of short word sequences that come again within a window: where one does, windows of
    one run can be equal."""
    g = grams(hashes, min(GRAM, window))
    near = np.zeros(len(hashes) + 1, dtype=bool)
    for d in range(1, window + 1):
        near[: max(0, len(g) - d)] |= g[d:] == g[: max(0, len(g) - d)]
    return np.concatenate(([0], np.cumsum(near)))


def _base(batches):
    """(doc_id, mark, n_words, sha256 of the words) of each text."""
    split = Splitter()
    for batch in batches:
        for words in split.chunks(batch.column(1)):
            n = np.diff(words.off)
            marks = [_mark(words.hashes[a:b]) for a, b in zip(words.off[:-1], words.off[1:], strict=True)]
            shas = [hashlib.sha256(b" ".join(words.raw(i))).hexdigest() for i in range(len(words))]
            yield pa.record_batch([batch.column(0).slice(words.first, len(words)), pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(n.astype(np.int64)), pa.array(shas)], names=["doc_id", "mark", "n_words", "sha"])


def _pieces(bucket: np.ndarray):
    """Slices of equal values of a sorted array."""
    cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    return zip(cut[:-1], cut[1:], strict=True)


def _anchors(batches, window: int, buckets: int):
    """Blobs of minimiser entries by bucket.

    What repeats within a flush is known to be repeated: it passes through, and of each such
    minimiser one entry goes on, with the number it stands for.
    """
    split = Splitter()
    names, parts, held = [], [], 0

    def out():
        name = np.array(names, dtype=_NAME)
        e = np.zeros(held, dtype=_ENTRY)
        e["low"], e["start"], e["n"], e["kind"] = (np.concatenate([p[i] for p in parts]) for i in range(4))
        e["name"] = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.lexsort((name["doc"][e["name"]], e["start"], name["mark"][e["name"]], e["low"]))
        e = e[order]
        mark = name["mark"][e["name"]]
        new = np.concatenate(([True], (e["low"][1:] != e["low"][:-1]) | (mark[1:] != mark[:-1]) | (e["start"][1:] != e["start"][:-1])))
        e = e[new]
        start = np.flatnonzero(np.concatenate(([True], e["low"][1:] != e["low"][:-1])))
        count = np.diff(np.append(start, len(e)))
        more = (count > 1) | (np.maximum.reduceat(e["kind"], start) > 0)
        several = np.repeat(more, count)
        e["kind"] = np.where(several, _DONE, _OPEN)
        known = e[start[more]]
        known["kind"], known["n"] = _KNOWN, np.maximum(count[more], 2)
        bucket = np.concatenate([np.where(several, e["name"].astype(np.int64), ((e["low"] >> U64(20)) % U64(buckets)).astype(np.int64)) % buckets, ((known["low"] >> U64(20)) % U64(buckets)).astype(np.int64)])
        e = np.concatenate((e, known))
        order = np.lexsort((e["name"], bucket))
        e, bucket = e[order], bucket[order]
        rows = []
        for a, b in _pieces(bucket):
            own, back = np.unique(e["name"][a:b], return_inverse=True)
            piece = e[a:b].copy()
            piece["name"] = back
            rows.append((int(bucket[a]), name[own].tobytes(), piece.tobytes()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "names", "entries"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for words in split.chunks(batch.column(1)):
            near = _echoes(words.hashes, window)
            for i in range(len(words)):
                h = words.hashes[words.off[i] : words.off[i + 1]]
                if len(h) < window:
                    continue
                low = _lows(h, window)
                start, n = _cuts(low)
                names.append((ids[words.first + i], _mark(h)))
                at = words.off[i] + start
                parts.append((low[start], start, n, near[at + n + window - 1] > near[at]))
                held += len(start)
                if held >= FLUSH or len(names) == _NAMES:
                    yield out()
                    names, parts, held = [], [], 0
    if names:
        yield out()


_ASKED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary()), ("words", pa.int64()), ("low", pa.int64()), ("m", pa.int64())])


def _by_document(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, n: np.ndarray):
    """(doc, mark, spans) for each document of some spans."""
    order = np.lexsort((start, mark, doc))
    doc, mark = doc[order], mark[order]
    spans = np.empty(len(order), dtype=_SPAN)
    spans["start"], spans["n"] = start[order], n[order]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]), [True]))) if len(doc) else np.zeros(1, int)
    return [(int(doc[a]), int(mark[a].astype(np.uint64).view(np.int64)), spans[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _repeated(blobs: pa.Table, window: int, hot: int) -> pa.Table:
    """The spans of windows whose minimiser stands elsewhere too, by document; minimisers of many segments (low, m)."""
    doc, mark, e = [], [], []
    for names, entries in zip(blobs.column("names").to_pylist(), blobs.column("entries").to_pylist(), strict=True):
        name, x = np.frombuffer(names, _NAME), np.frombuffer(entries, _ENTRY)
        doc.append(name["doc"][x["name"]])
        mark.append(name["mark"][x["name"]])
        e.append(x)
    doc, mark, e = np.concatenate(doc), np.concatenate(mark), np.concatenate(e)
    done = e["kind"] == _DONE
    ask = [(doc[done], mark[done], e["start"][done], e["n"][done])]
    doc, mark, e = doc[~done], mark[~done], e[~done]
    order = np.lexsort((doc, e["start"], mark, e["low"]))
    doc, mark, e = doc[order], mark[order], e[order]
    low = e["low"]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (mark[1:] != mark[:-1]) | (e["start"][1:] != e["start"][:-1]))) if len(e) else np.zeros(0, bool)
    new |= e["kind"] == _KNOWN
    doc, mark, e, low = doc[new], mark[new], e[new], low[new]
    start = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1]))) if len(e) else np.zeros(0, int)
    count = np.diff(np.append(start, len(e)))
    stands = np.where(e["kind"] == _KNOWN, e["n"], 1).astype(np.int64)
    m = np.add.reduceat(stands, start) if len(e) else stands
    asked = np.repeat(m > 1, count) & (e["kind"] == _OPEN)
    ask.append((doc[asked], mark[asked], e["start"][asked], e["n"][asked]))
    rows = _by_document(*(np.concatenate(c) for c in zip(*ask, strict=True)))
    words = [int((np.frombuffer(s, _SPAN)["n"].astype(np.int64) + window - 1).sum()) for _, _, s in rows]
    many = m > hot
    none = [None] * int(many.sum())
    return pa.table({
        "doc_id": [r[0] for r in rows] + none, "mark": [r[1] for r in rows] + none, "spans": [r[2] for r in rows] + none, "words": words + none,
        "low": [None] * len(rows) + low[start[many]].view(np.int64).tolist(), "m": [None] * len(rows) + m[many].tolist(),
    }, schema=_ASKED)


def _same_place(seg: np.ndarray) -> np.ndarray:
    """Whether each segment but the first is the one before it, read again."""
    return (seg["doc"][1:] == seg["doc"][:-1]) & (seg["mark"][1:] == seg["mark"][:-1]) & (seg["start"][1:] == seg["start"][:-1])


_PRIME = 0x9E3779B97F4A7C15


def _runs_marked(hashes: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each run of words, wherever it stands, from running sums of words by powers."""
    with np.errstate(over="ignore"):
        up, down = np.full(len(hashes), _PRIME, np.uint64), np.full(len(hashes), pow(_PRIME, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(hashes) * np.cumprod(up))))
        return mix64((total[start + size] - total[start]) * np.cumprod(down)[start] + size.astype(np.uint64))


def _segments(batches, window: int, shards: int, hot: np.ndarray):
    """Blobs of segments and their words, by shard, from (doc_id, text, asked [mark, spans])."""
    split = Splitter()
    parts, held = [], 0

    def out():
        seg, word, shard_key, whole = (np.concatenate(c) for c in zip(*parts, strict=True))
        size = seg["n"].astype(np.int64) + window - 1
        begin = np.cumsum(size) - size
        # Equal segments: the first stays, the later ones are repeated throughout.
        order = np.lexsort((seg["start"], seg["mark"], seg["doc"], whole))
        later, again = np.zeros(len(seg), dtype=bool), np.zeros(len(seg), dtype=bool)
        later[order[1:]] = whole[order[1:]] == whole[order[:-1]]
        again[order[1:]] = _same_place(seg[order]) & later[order[1:]]  # a row that repeats
        first = np.maximum.accumulate(np.where(again[order], 0, np.arange(len(order))))
        later[order] = later[order[first]]
        seg["kind"] = np.where(later, _DONE, _OPEN)
        shard = np.where(later, np.arange(len(seg)), (shard_key % U64(shards)).astype(np.int64)) % shards
        order = np.argsort(shard, kind="stable")
        order = order[~again[order]]
        rows = []
        for a, b in _pieces(shard[order]):
            own = order[a:b]
            sent = own[~later[own]]
            words = word[np.repeat(begin[sent], size[sent]) + _runs(size[sent])]
            rows.append((int(shard[order[a]]), seg[own].tobytes(), (words & U64(0xFFFFFFFF)).astype("<u4").tobytes(), (words >> U64(32)).astype("u1").tobytes()))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], names=["shard", "segments", "words", "high"])

    for batch in batches:
        ids, asked = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for words in split.chunks(batch.column(1)):
            for i in range(len(words)):
                h = words.hashes[words.off[i] : words.off[i + 1]]
                if len(h) < window:
                    continue
                mark = _mark(h)
                signed = int(np.uint64(mark).astype(np.int64))
                spans = [np.frombuffer(x["spans"], _SPAN) for x in asked[words.first + i] if x["mark"] == signed]
                if not spans:
                    continue
                spans = np.concatenate(spans)
                start, n = spans["start"].astype(np.int64), spans["n"].astype(np.int64)
                low = _lows(h, window)
                alone = np.isin(low[start], hot) if len(hot) else np.zeros(len(start), dtype=bool)
                key = low[start]
                if alone.any():  # each window of these by itself
                    lone = np.repeat(start[alone], n[alone]) + _runs(n[alone])
                    key = np.concatenate((key[~alone], grams(h, window)[lone]))
                    start, n = np.concatenate((start[~alone], lone)), np.concatenate((n[~alone], np.ones(len(lone), np.int64)))
                size = n + window - 1
                seg = np.zeros(len(start), dtype=_SEGMENT)
                seg["doc"], seg["mark"], seg["start"], seg["n"] = ids[words.first + i], mark, start, n
                parts.append((seg, (h & _WORDS)[np.repeat(start, size) + _runs(size)], key, _runs_marked(h, start, size)))
                held += int(size.sum())
                if held >= FLUSH:
                    yield out()
                    parts, held = [], 0
    if parts:
        yield out()


_HIT = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary())])


def _search(blobs: pa.Table, window: int) -> pa.Table:
    """The spans of windows that start earlier elsewhere, by document, from an FM-index of the shard."""
    seg, word, size = [], [], []
    for s, w, high in zip(*(blobs.column(c).to_pylist() for c in ("segments", "words", "high")), strict=True):
        seg.append(np.frombuffer(s, _SEGMENT))
        word.append(np.frombuffer(w, "<u4").astype(np.uint64) | np.frombuffer(high, "u1").astype(np.uint64) << U64(32))
    seg, word = np.concatenate(seg), np.concatenate(word)
    done = seg["kind"] == _DONE
    hits = [(seg["doc"][done], seg["mark"][done], seg["start"][done], seg["n"][done])]
    seg = seg[~done]
    size = seg["n"].astype(np.int64) + window - 1
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    if len(seg):
        # Segments in the order of documents, each followed by a symbol of its own that is no word.
        order = np.lexsort((seg["start"], seg["mark"], seg["doc"]))
        order = order[np.concatenate(([True], ~_same_place(seg[order])))]
        symbol = np.unique(word, return_inverse=True)[1] + 1
        sigma = int(symbol.max()) + 1
        n, size, begin, seg = seg["n"][order].astype(np.int64), size[order], begin[order], seg[order]
        place = np.cumsum(size + 1) - size - 1
        text = np.zeros(int((size + 1).sum()), dtype=np.int64)
        text[np.repeat(place, size) + _runs(size)] = symbol[np.repeat(begin, size) + _runs(size)]
        index = FMIndex(text, sigma)
        # What all windows of a segment share comes first: where that is unique, so are they.
        core = window - n + 1
        tried = np.ones(len(n), dtype=bool)
        some = np.flatnonzero((core > 0) & (n > 1))
        tried[some] = False
        tried[some[index.statistics(text, (place + n - 1)[some], core[some])[0] == core[some]]] = True
        own = np.repeat(np.arange(len(n)), np.where(tried, n, 0))
        at = place[own] + _runs(np.where(tried, n, 0))
        found, lo, hi = index.statistics(text, at, window)[1]
        later = found[index.earliest(lo, hi) < at[found]]
        s = own[later]
        hits.append((seg["doc"][s], seg["mark"][s], (seg["start"][s] + at[later] - place[s]).astype(np.uint32), np.ones(len(later), np.uint32)))
    rows = _by_document(*(np.concatenate(c) for c in zip(*hits, strict=True)))
    return pa.table({"doc_id": [r[0] for r in rows], "mark": [r[1] for r in rows], "spans": [r[2] for r in rows]}, schema=_HIT)


def _runs(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _removed(batches, window: int):
    """(doc_id, mark, n_removed, sha, kept text) from (doc_id, text, hits [mark, spans])."""
    split = Splitter()
    for batch in batches:
        hits = batch.column(2).to_pylist()
        rows = []
        for words in split.chunks(batch.column(1)):
            for i in range(len(words)):
                h = words.hashes[words.off[i] : words.off[i + 1]]
                signed = int(np.uint64(_mark(h)).astype(np.int64))
                spans = [np.frombuffer(x["spans"], _SPAN) for x in hits[words.first + i] if x["mark"] == signed]
                if not spans:
                    continue
                spans = np.concatenate(spans)
                edge = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(edge, spans["start"], 1)
                np.add.at(edge, spans["start"].astype(np.int64) + spans["n"] + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                raw = words.raw(i)
                kept = b" ".join([raw[j] for j in np.flatnonzero(~gone)])
                rows.append((batch.column(0)[words.first + i].as_py(), signed, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
        yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "mark", "n_removed", "kept_sha256", "kept"])


def _gathered(spans: DataFrame) -> DataFrame:
    """A row for each document: its marks and spans. As long as its text at most."""
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("mark", "spans")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document without the words of windows that also start earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A window counts as repeated when its words
    also start earlier: in a document of smaller id, or earlier in the same one. Windows are
    judged on the input. Null and empty texts have no words. Rows of one id and the same words
    are one document, and each keeps a row; rows of one id and different words stand in the
    order of a hash of their words. Rows without an id are left alone. Words are compared by
    hashes of 40 bits, texts and segments by 64. Other columns are ignored.

    Columns: doc_id, n_words long, n_removed long, kept_sha256 string (of the kept words joined
    by one space), kept string (these words; null where no word is removed, empty where all are).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialise(docs.mapInArrow(_base, "doc_id long, mark long, n_words long, sha string"))
    long_ = base.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    total = long_.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    entries = total * 2 // max(2, window - min(GRAM, window) + 2)
    buckets, hot = max(1, ceil_div(entries, BUCKET_ENTRIES)), max(HOT, entries // 1_000_000)
    known = docs.where("doc_id is not null")
    blobs = known.mapInArrow(lambda it: _anchors(it, window, buckets), "bucket int, names binary, entries binary")
    asked = materialise(blobs.groupBy("bucket").applyInArrow(lambda t: _repeated(t, window, hot), "doc_id long, mark long, spans binary, words long, low long, m long"))
    common = asked.where("low is not null").orderBy(F.desc("m")).limit(1_000_000).select("low").collect()  # m over a millionth of all
    common = np.sort(np.array([r["low"] for r in common], dtype=np.int64).view(np.uint64))

    firsts = long_.groupBy("mark").agg(F.min("doc_id").alias("first"))
    spans = asked.where("low is null").join(firsts, "mark").where("doc_id = first").select("doc_id", "mark", "spans", "words")
    spans = materialise(spans)
    shards = max(1, ceil_div(spans.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0], SHARD_WORDS))
    wanted = _gathered(spans)
    texts = likely(known, spans.select("doc_id").distinct()).join(wanted, "doc_id").select("doc_id", "text", "spans")
    sent = texts.mapInArrow(lambda it: _segments(it, window, shards, common), "shard int, segments binary, words binary, high binary")
    hits = materialise(sent.groupBy("shard").applyInArrow(lambda t: _search(t, window), "doc_id long, mark long, spans binary"))

    texts = likely(known, hits.select("doc_id").distinct()).join(_gathered(hits), "doc_id").select("doc_id", "text", "spans")
    done = materialise(texts.mapInArrow(lambda it: _removed(it, window), "doc_id long, mark long, n_removed long, kept_sha256 string, kept string"))
    done = done.dropDuplicates(["doc_id", "mark"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    placed = materialise(long_.join(firsts, "mark"))
    copies = placed.where("doc_id <> first").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), nothing.alias("kept_sha256"), F.lit("").alias("kept"))
    rest = placed.where("doc_id = first").join(done, ["doc_id", "mark"], "left")
    rest = rest.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")
    short = base.where(F.col("doc_id").isNull() | (F.col("n_words") < window))
    short = short.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast("string").alias("kept"))
    return rest.unionByName(copies).unionByName(short)
