"""Byte-level BPE: encoding by corpus-level merge replay, and decoding.

A task gathers the distinct pieces of its texts into one array of tokens, with links
to the left and right neighbour, and an inverted index from mergeable pair to the
positions where it stands. It then replays the merges in rank order over all pieces
at once: every position of a rank is merged in one vectorised step, and only the two
neighbours of a merged pair are looked up and entered in the index again. Texts are
put together from the pieces afterwards.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import release

#: Bytes of text, and distinct pieces, after which a task replays and lets go of its texts.
FLUSH_BYTES, FLUSH_PIECES = 12 << 20, 200_000
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ids; read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Merges:
    """Every pair of tokens that together are a token, by binary search."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, made = [], []
        early = set()  # tokens in whose pairs a lower rank can appear
        get = ranks.get
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = get(word[:cut]), get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
                    if rank < a:
                        early.add(a)
                    if rank < b:
                        early.add(b)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.int64(2**62))
        self.made = np.append(np.array(made, dtype=np.int32)[order], _NONE)
        self.early = early
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.nothing = np.int32(max(ranks.values()) + 1)
        self.ranks = ranks

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens of the pieces, and where each piece's tokens begin (one more than pieces)."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        off = np.concatenate(([0], np.cumsum(size)))
        n = int(off[-1])
        token = np.append(self.single[np.frombuffer(b"".join(pieces), np.uint8)], self.nothing).astype(np.int32)
        right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        full = off[:-1][size > 0]
        left[full] = n  # place n stands for no neighbour
        right[off[1:][size > 0] - 1] = n
        right[n] = n
        rank = np.full(n + 1, _NONE, dtype=np.int32)
        rank[:n] = self.look(token[:n], token[right[:n]])
        alive = np.ones(n + 1, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray, r: np.ndarray) -> None:
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for some, which in zip(np.split(at, cut), r[np.concatenate(([0], cut))].tolist(), strict=True):
                if which in index:
                    index[which].append(some)
                else:
                    index[which] = [some]
                    heapq.heappush(queue, which)

        first = np.flatnonzero(rank < _NONE).astype(np.int32)
        if len(first):
            enter(first, rank[first])
        while queue:
            r = heapq.heappop(queue)
            at = index.pop(r)
            at = np.unique(np.concatenate(at))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1 and r in self.early:  # a lower rank may come up: the leftmost of each piece only
                piece = np.searchsorted(off, at, "right")
                lead = np.concatenate(([True], piece[1:] != piece[:-1]))
                if not lead.all():
                    enter(at[~lead], np.full(int((~lead).sum()), r))
                    at = at[lead]
            elif len(at) > 1:
                touching = right[at[:-1]] == at[1:]
                if touching.any():  # as in aaa: of a run, every other one from the left
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), place, 0))
                    at = at[(place - begin) % 2 == 0]
            gone = right[at]
            after = right[gone]
            token[at] = r
            right[at] = after
            left[after] = at
            alive[gone] = False
            rank[gone] = _NONE
            before = left[at]
            rank[at] = self.look(token[at], token[after])
            rank[before] = self.look(token[before], token[at])
            rank[n] = _NONE
            touched = np.concatenate((at, before))
            touched = touched[rank[touched] < _NONE]
            if len(touched):
                enter(touched, rank[touched])
        alive[n] = False
        kept = np.concatenate(([0], np.cumsum(alive[:n])))
        return token[:n][alive[:n]], kept[off]


class _Numbered(dict):
    """Numbers what is looked up, in the order of first sight."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    def __init__(self, merges: Merges, pattern: str):
        self.merges, self.pattern = merges, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbered()
        self.tokens, self.begin, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, text: str) -> np.ndarray:
        """The numbers of the text's pieces."""
        return np.fromiter(map(self.numbers.__getitem__, self.pattern.findall(text)), np.int32)

    def learn(self) -> None:
        """Replay the merges over the pieces that are new."""
        new = [p.encode() for p in list(self.numbers)[len(self.begin) :]]
        known = [self.merges.ranks.get(p) for p in new]
        made, off = self.merges.replay([b"" if k is not None else p for p, k in zip(new, known, strict=True)])
        whole = np.array([-1 if k is None else k for k in known], dtype=np.int64)
        base = len(self.tokens)
        begin, count = off[:-1] + base, np.diff(off)
        asis = whole >= 0
        begin[asis], count[asis] = base + len(made) + np.arange(asis.sum()), 1
        self.tokens = np.concatenate((self.tokens, made, whole[asis].astype(np.int32)))
        self.begin, self.count = np.concatenate((self.begin, begin)), np.concatenate((self.count, count))

    def ids(self, pieces: np.ndarray) -> np.ndarray:
        count = self.count[pieces]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.tokens[np.repeat(self.begin[pieces] - ends + count, count) + np.arange(total)]


def _joined(words: dict[int, bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(words.__getitem__, ids.tolist()))


def _encode(batches, ranks: dict[bytes, int], pattern: str, text_at: int, decoded: bool = False):
    encoder = Encoder(Merges(ranks), pattern)
    words = {rank: token for token, rank in ranks.items()}
    waiting: list[tuple[pa.RecordBatch, list]] = []
    held = 0

    def out():
        encoder.learn()
        for batch, cut in waiting:
            ids = [encoder.ids(x) for x in cut]
            packed = [x.astype("<u4").tobytes() for x in ids]
            more = [pa.array([_joined(words, np.frombuffer(x, "<u4")) for x in packed], pa.binary())] if decoded else []
            yield pa.record_batch(
                [*batch.columns, pa.array([len(x) for x in ids], pa.int64()), pa.array(packed, pa.binary()), *more], names=[*batch.schema.names, "n_tokens", "ids", *["decoded"] * decoded]
            )
        waiting.clear()
        if len(encoder.numbers) > FLUSH_PIECES:
            encoder.forget()

    for whole in batches:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            texts = batch.column(text_at).to_pylist()
            waiting.append((batch.drop_columns([batch.schema.names[text_at]]), [encoder.cut(t or "") for t in texts]))
            held += sum(len(t) for t in texts if t)
            if held >= FLUSH_BYTES or len(encoder.numbers) - len(encoder.begin) >= FLUSH_PIECES:
                yield from out()
                held = 0
    yield from out()
    encoder.forget()
    release()


def _decode(batches, ranks: dict[bytes, int], ids_at: int):
    words = {rank: token for token, rank in ranks.items()}
    for batch in batches:
        texts = [_joined(words, np.frombuffer(x, "<u4")) if x is not None else None for x in batch.column(ids_at).to_pylist()]
        yield batch.append_column("decoded", pa.array(texts, pa.binary()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """Each row's token ids: what the tiktoken library's encode_ordinary returns.

    Columns: those in keep, as they come, n_tokens long, ids binary (little-endian
    unsigned 32-bit integers; ``unpacked`` gives an array); with decoded, also what these
    bytes decode to, as ``decode`` gives it, without another pass. Null texts count as empty and
    give no id. Rows are handled one by one, so repeated ids and ties need no rule; texts
    of any length are encoded whole. ranks must hold all 256 single bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size doesn't grow with the data
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda it: _encode(it, sent.value, pattern, len(keep), decoded), f"{schema}, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids") -> DataFrame:
    """The rows with a column decoded binary: the bytes of their ids. Null ids stay null; an unknown id is an error."""
    sent = encoded.sparkSession.sparkContext.broadcast(ranks)
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(lambda it: _decode(it, sent.value, at), f"{schema}, decoded binary")


def unpacked(ids) -> list[int]:
    """The ids of one packed value."""
    return np.frombuffer(ids, "<u4").tolist()
