"""Quality classifier: a factorisation machine over hashed words and structure statistics.

The score of a text with features x is sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).
The pairwise sum takes linear time: half of |sum v_i x_i|^2 - sum |v_i|^2 x_i^2. Features are
the shares of hashed words in the text, statistics of its structure in bins, and its length.

The model is fitted on the driver on a bounded sample of labelled rows; all rows are
scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import U64, release
from quarry.llm._text import Splitter

#: Words fall into so many features.
WORD_BITS = 12
#: Cut points of the binned statistics; a bin is a feature.
_BINS = {
    "log_words": (1.0, 2.5, 3.5, 4.2, 4.8, 5.4, 6.0, 7.0, 8.5),
    "word_length": (3.0, 4.2, 5.0, 5.6, 6.4, 7.2, 8.5, 10.0),
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3),
    "capitals": (0.005, 0.02, 0.04, 0.08, 0.2, 0.5, 0.8),
    "digits": (0.001, 0.01, 0.05, 0.2),
    "lines": (0.0005, 0.002, 0.004, 0.008, 0.02),
    "stops": (0.002, 0.01, 0.02, 0.03, 0.05, 0.1),
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.55, 0.65, 0.75, 0.9),
    "repeats": (0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "bare": (0.005, 0.02, 0.05, 0.1, 0.2, 0.35),
    "not_ascii": (0.001, 0.01, 0.05, 0.1, 0.3),
}
_SIZES = [len(c) + 1 for c in _BINS.values()]
_STARTS = np.concatenate(([0], np.cumsum(_SIZES)))[:-1] + (1 << WORD_BITS)
N_STATS = len(_BINS)
N_FEATURES = int((1 << WORD_BITS) + sum(_SIZES))
#: Statistics count so much against a text's words, which together weigh 1.
STAT_VALUE = 0.6


def _class_table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL = _class_table("#$%&*+/<=>@[\\]^_`{|}~")
_CAPITAL = _class_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class_table("0123456789")
_STOP = _class_table(".!?")
_LINE = _class_table("\n")
_HIGH = np.arange(256) >= 0xC0
_LETTER = _class_table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 0x80)


def _features(words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts of a chunk: features of every word, where each text's words begin, binned statistics."""
    n = len(words)
    off = words.off.astype(np.int64)
    count = np.diff(off)
    many = np.maximum(count, 1)
    size = np.maximum(np.diff(words.text_off), 1)

    def share(member: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(member[words.data], dtype=np.int64)))
        return (total[words.text_off[1:]] - total[words.text_off[:-1]]) / size

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[off[1:]] - total[off[:-1]]

    letters = np.concatenate(([0], np.cumsum(_LETTER[words.data], dtype=np.int64)))
    bare = letters[words.ends] == letters[words.starts]
    same = np.zeros(len(words.hashes), dtype=bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[off[:-1][count > 0]] = False
    distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(off[:-1], off[1:], strict=True)])
    stats = (
        np.log1p(count), (np.diff(words.text_off) - share(_LINE) * size) / many, share(_SYMBOL), share(_CAPITAL), share(_DIGIT),
        share(_LINE), share(_STOP), distinct / many ** 0.92, per_text(same) / many, per_text(bare) / many, share(_HIGH),
    )
    binned = np.empty((n, N_STATS), dtype=np.int64)
    for j, (value, cuts) in enumerate(zip(stats, _BINS.values(), strict=True)):
        binned[:, j] = _STARTS[j] + np.searchsorted(cuts, value, "right")
    return (words.hashes >> U64(64 - WORD_BITS)).astype(np.int64), off, binned


@dataclass
class Machine:
    """bias, linear weights and factors of a factorisation machine."""

    bias: float
    w: np.ndarray  # by feature
    v: np.ndarray  # by feature, factors

    def score(self, words) -> np.ndarray:
        """The probability of label 1 of each text of a chunk, in time linear in its words."""
        feature, off, binned = _features(words)
        n, k = len(words), self.v.shape[1]
        x = 1.0 / np.maximum(np.diff(off), 1)
        per_word = np.column_stack((self.w, self.v, (self.v**2).sum(axis=1))).astype(np.float32)
        total = np.zeros((n, k + 2))
        square = np.zeros(n)
        for i in range(n):
            a, b = off[i], off[i + 1]
            if b > a:
                bag = np.bincount(feature[a:b], minlength=1 << WORD_BITS) if b - a > 2048 else None
                if bag is None:
                    own, times = np.unique(feature[a:b], return_counts=True)
                else:
                    own = np.flatnonzero(bag)
                    times = bag[own]
                share = times * x[i]
                part = per_word[own]
                total[i] = share @ part
                square[i] = share**2 @ part[:, -1]
        stats = per_word[binned].sum(axis=1)
        linear = self.bias + total[:, 0] + STAT_VALUE * stats[:, 0]
        summed = total[:, 1:-1] + STAT_VALUE * stats[:, 1:-1]
        pairs = 0.5 * ((summed**2).sum(axis=1) - square - STAT_VALUE**2 * stats[:, -1])
        return 1.0 / (1.0 + np.exp(-np.clip(linear + pairs, -35, 35)))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, factors: int = 8, epochs: int = 30, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """A machine fitted by AdaGrad on (features, values) bags, in batches of 64."""
    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, factors)), 0.0
    if len(labels) == 0:
        return Machine(0.0, w, np.zeros_like(v))
    share = float(np.clip(labels.mean(), 0.01, 0.99))
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            sizes = [len(bags[i][0]) for i in some]
            feature = np.concatenate([bags[i][0] for i in some])
            value = np.concatenate([bags[i][1] for i in some])
            cut = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            own = np.repeat(np.arange(len(some)), sizes)
            vx = v[feature] * value[:, None]
            summed = np.add.reduceat(vx, cut, axis=0)
            pairs = 0.5 * ((summed**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), cut))
            z = bias + np.add.reduceat(w[feature] * value, cut) + pairs
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[some]) / len(some)
            e = error[own]
            dw = np.bincount(feature, e * value, N_FEATURES)
            at = np.unique(feature)
            dw = dw[at] + decay * w[at]
            dv = np.zeros((N_FEATURES, factors))
            np.add.at(dv, feature, (e * value)[:, None] * (summed[own] - vx))
            dv = dv[at] + decay * v[at]
            db = error.sum()
            gw[at] += dw**2
            gv[at] += dv**2
            gb += db**2
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= rate * dv / np.sqrt(gv[at])
            bias -= rate * db / np.sqrt(gb)
    return Machine(bias, w, v)


def _bags(batches):
    """(id, label, features, values) of each (id, label, text)."""
    split = Splitter(fold=True)
    for batch in batches:
        for words in split.chunks(batch.column(2)):
            feature, off, binned = _features(words)
            features, values = [], []
            for i in range(len(words)):
                own, times = np.unique(feature[off[i] : off[i + 1]], return_counts=True)
                features.append(np.concatenate((own, binned[i])))
                values.append(np.concatenate((times / max(1, times.sum()), np.full(N_STATS, STAT_VALUE))))
            own = batch.slice(words.first, len(words))
            yield pa.record_batch([own.column(0), own.column(1), pa.array(features, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["id", "label", "features", "values"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 6000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", **how) -> Machine:
    """A machine fitted on at most max_train labelled rows, those of the smallest md5(id).

    max_train is the documented bound of the sample; the rows are joined to their texts by
    a broadcast of it. Labels that are null or neither 0 nor 1, and rows without an id, are
    left out; an id with several labels takes the larger, and one with several texts the least
    of them. No labelled rows give the machine that scores 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(max_train)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows = texts.join(F.broadcast(known), "_id").groupBy("_id", "_label").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    found = rows.mapInArrow(_bags, "id long, label int, features array<int>, values array<float>").toArrow()
    found = found.sort_by("id")  # so that the model doesn't depend on the order in which tasks end
    bags = [(np.array(f.as_py(), dtype=np.int64), np.array(v.as_py(), dtype=np.float64)) for f, v in zip(found.column("features"), found.column("values"), strict=True)]
    return fit(bags, found.column("label").to_numpy().astype(np.float64), **how)


def _scores(batches, machine: Machine, threshold: float, text_at: int):
    split = Splitter(fold=True)
    for batch in batches:
        score = np.concatenate([machine.score(words) for words in split.chunks(batch.column(text_at))]) if batch.num_rows else np.zeros(0)
        yield batch.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= threshold).astype(np.int32)))
    release()


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score double (0 to 1; higher: label 1 likelier) and predicted int (1 from threshold on).

    Only the whole text decides; null texts are scored as empty ones. Columns of docs named
    score or predicted are replaced; every other column is kept.
    """
    # N_FEATURES * (factors + 1) numbers, as plain arrays: a class would need the package on the executors.
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: _scores(it, Machine(*sent.value), threshold, at), f"{schema}, score double, predicted int")
