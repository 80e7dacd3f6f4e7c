"""Exact top-k inner-product search by tiled matrix products.

Rows are packed into blocks of bounded size. Every block of queries meets every
shard block of candidates in one cell (tile, shard); a cell holds a bounded number
of vectors, multiplies tile by tile and keeps k rows for each query. The per-cell
lists then meet in a tree: each level merges ``fan`` shards, so no task ever sees
more than fan * k rows of one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._common import ceil_div, materialise

_BLOCK = "block long, dim int, n int, bound double, ids binary, kind string, data binary"
#: Queries of a tile that are multiplied with a shard at a time.
STEP = 256
_HITS = "query_key string, query_id long, shard int, vec_id long, score long"
_HITS_ARROW = pa.schema([("query_key", pa.string()), ("query_id", pa.int64()), ("shard", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
_LONG = (-(2**63), 2**63 - 1)


def _quantised(col, scale: float):
    """(row numbers, matrices by dimension) of the usable vectors of an Arrow list column."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    valid = np.asarray(col.is_valid())
    flat = col.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = np.asarray(col.value_lengths().fill_null(0), dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for dim in np.unique(sizes[valid]):
        rows = np.flatnonzero(valid & (sizes == dim))
        m = values[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
        ok = np.isfinite(m).all(axis=1)
        out[int(dim)] = rows[ok], np.floor(scale * m[ok])
    return out


def _pack(batches, id_col: str, vec_col: str, scale: float, rows: int):
    """Blocks of at most ``rows`` quantised vectors of one dimension."""
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def block(dim, ids, m):
        nonlocal made
        made += 1
        bound = float(np.abs(m).max(initial=0))
        kind = "<i2" if bound < 2**15 else "<i4" if bound < 2**31 else "<f8"
        return {"block": (part << 32) + made, "dim": dim, "n": len(ids), "bound": bound, "ids": ids.astype("<i8").tobytes(), "kind": kind, "data": m.astype(kind).tobytes()}

    def out(found):
        return pa.RecordBatch.from_pylist(found, schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("bound", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), ("data", pa.binary())]))

    for batch in batches:
        ids = batch.column(id_col)
        known = np.asarray(ids.is_valid())
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for dim, (at, m) in _quantised(batch.column(vec_col), scale).items():
            keep = known[at]
            held.setdefault(dim, []).append((ids[at[keep]], m[keep]))
            while sum(len(i) for i, _ in held[dim]) >= rows:
                i, x = (np.concatenate(c) for c in zip(*held[dim], strict=True))
                yield out([block(dim, i[:rows], x[:rows])])
                held[dim] = [(i[rows:], x[rows:])]
    for dim, parts in held.items():
        i, x = (np.concatenate(c) for c in zip(*parts, strict=True))
        if len(i):
            yield out([block(dim, i, x)])


def _exact(m: np.ndarray, bound: float) -> np.ndarray:
    """A matrix in the narrowest type whose products are exact when no partial sum is over bound."""
    return m.astype(np.float32 if bound < 2**24 else np.float64) if bound < 2**53 else np.vectorize(int, otypes=[object])(m)


def _vectors(block: dict) -> np.ndarray:
    return np.frombuffer(block["data"], block["kind"]).reshape(block["n"], block["dim"])


def _best(scores: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int):
    """(query row, candidate column) of each row's k best, ties to the smaller id; ids ascend."""
    n = scores.shape[1]
    if scores.dtype != object and np.abs(scores).max(initial=0) < 2**62 // max(n, 1):
        key = scores * n + np.arange(n - 1, -1, -1)
        key[own] = np.iinfo(np.int64).min
        take = np.argpartition(key, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(key), 1))
        row = np.repeat(np.arange(len(key)), take.shape[1])
        take = take.ravel()
        keep = ~own[row, take]
        return row[keep], take[keep]
    rows, cols = [], []
    for r in range(len(scores)):
        free = [j for j in range(n) if not own[r, j]]
        best = sorted(free, key=lambda j: (-scores[r, j], ids[j]))[:k]
        rows += [r] * len(best)
        cols += best
    return np.array(rows, dtype=int), np.array(cols, dtype=int)


def _cell(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The k best rows of this shard for each query of this tile."""
    found = []
    number = shard.column("shard")[0].as_py() if shard.num_rows else 0
    blocks = shard.to_pylist()
    for q in queries.to_pylist():
        same = [b for b in blocks if b["dim"] == q["dim"]]
        if not same:
            continue
        dim = q["dim"]
        ids = np.concatenate([np.frombuffer(b["ids"], "<i8") for b in same])
        bound = q["bound"] * max(b["bound"] for b in same) * max(dim, 1)
        order = np.argsort(ids, kind="stable")
        ids, c = ids[order], _exact(np.concatenate([_vectors(b) for b in same])[order], bound).T
        qids = np.frombuffer(q["ids"], "<i8")
        m = _exact(_vectors(q), bound)
        for lo in range(0, len(qids), STEP):
            part = qids[lo : lo + STEP]
            scores = m[lo : lo + STEP] @ c
            scores = scores if scores.dtype == object else scores.astype(np.int64)
            rows, cols = _best(scores, part[:, None] == ids[None, :], ids, k)
            got = scores[rows, cols]
            if got.dtype == object:
                got = np.array([min(max(x, _LONG[0]), _LONG[1]) for x in got], dtype=np.int64)
            found.append(pa.table({
                "query_key": pa.array([f"{q['block']}:{r}" for r in rows + lo], pa.string()), "query_id": part[rows],
                "shard": np.full(len(rows), number, np.int32), "vec_id": ids[cols], "score": got,
            }, schema=_HITS_ARROW))
    return pa.concat_tables(found) if found else _HITS_ARROW.empty_table()


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    scale: float = 64.0, tile_rows: int = 8192, shard_rows: int = 8192, fan: int = 16,
) -> DataFrame:
    """Each query row's k candidates of highest integer inner product, without its own id.

    Components are floor(scale * x), x as double; scores are exact. Ties go to the
    smaller id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; vectors of different lengths aren't compared; two empty
    vectors score 0. A query row that repeats has a list for each repetition; repeated
    candidate rows count one by one; every row that bears the query's id counts as its
    own. Scores beyond the range of a long are ordered exactly, and returned as the
    nearest long. Columns: query_id, rank (from 1), vec_id, score, query_key (tells
    repeated query rows apart). Other columns of the inputs are ignored.
    """
    pack = lambda df, rows: materialise(df.select(F.col(id_col).cast("long").alias(id_col), F.col(vec_col).alias(vec_col)).mapInArrow(lambda it: _pack(it, id_col, vec_col, scale, rows), _BLOCK))
    q, c = pack(queries, tile_rows), pack(candidates, shard_rows // 4)
    tiles, shards = (max(1, ceil_div(df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], rows)) for df, rows in ((q, tile_rows), (c, shard_rows)))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    q = q.withColumn("tile", deal(tiles)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    c = c.withColumn("shard", deal(shards)).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    hits = q.groupBy("tile", "shard").cogroup(c.groupBy("tile", "shard")).applyInArrow(lambda a, b: _cell(a, b, k), _HITS)
    order = [F.col("score").desc(), F.col("vec_id")]
    while shards > fan:
        hits = hits.withColumn("shard", F.expr(f"shard div {fan}").cast("int"))
        within = Window.partitionBy("query_key", "shard").orderBy(*order)
        hits = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k).drop("rank")
        shards = ceil_div(shards, fan)
    rank = F.row_number().over(Window.partitionBy("query_key").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
