"""Bitmaps of keys, of a size bounded whatever the input, that spare rows without a match the shuffle of a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import U64, mix64

#: Bits of a bitmap, by its number: 4 MiB at least, 32 MiB at most; when it fills up, more rows pass in vain.
LEAST, MOST = 25, 28
_CHUNK = 18


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(keys) >> U64(64 - bits)).astype(np.int64)


def _column(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _places(batches, bits: int):
    for batch in batches:
        yield pa.record_batch([pa.array(np.unique(_place(_column(batch.column(0)), bits)))], names=["place"])


def _chunk(rows: pa.Table) -> pa.Table:
    place = rows.column("place").to_numpy()
    bits = np.zeros(1 << _CHUNK, dtype=bool)
    bits[place & ((1 << _CHUNK) - 1)] = True
    return pa.table({"chunk": pa.array([int(place[0]) >> _CHUNK], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def bitmap(df: DataFrame, key: Column, more: np.ndarray) -> bytes:
    """The keys (longs) of df, and those in more, as a bitmap."""
    keys = df.select(key.cast("long").alias("key"))
    size = min(MOST, max(LEAST, (64 * keys.count()).bit_length()))
    places = keys.mapInArrow(lambda it: _places(it, size), "place long").distinct()
    rows = places.groupBy(F.shiftright("place", _CHUNK)).applyInArrow(_chunk, "chunk int, bits binary").collect()
    chunks = {r["chunk"]: bytes(r["bits"]) for r in rows}
    bits = np.frombuffer(b"".join(chunks.get(i, bytes(1 << (_CHUNK - 3))) for i in range(1 << (size - _CHUNK))), np.uint8)
    if len(more):
        bits = bits.copy()
        at = _place(more, size)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits.tobytes()


def holds(bits: bytes, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) a bitmap holds, perhaps with some others."""
    at = _place(keys, (8 * len(bits)).bit_length() - 1)
    return (np.frombuffer(bits, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _passing(batches, bits: bytes, at: int):
    for batch in batches:
        yield batch.filter(pa.array(holds(bits, _column(batch.column(at)))))


def likely(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df whose id is in ids (one column of longs), and perhaps some others: for a join that follows."""
    sent = df.sparkSession.sparkContext.broadcast(bitmap(ids, F.col(ids.columns[0]), np.zeros(0, np.uint64)))
    at = df.columns.index(id_col)
    return df.mapInArrow(lambda it: _passing(it, sent.value, at), df.schema)
