"""Near-duplicate vectors by lattice hashing, verified by cosine.

Unit vectors are projected to eight dimensions by random orthonormal rows, shifted, and
decoded to the nearest point of the E8 lattice; several such decodings side by side make
the cell of a table, and there are several tables. A vector stands in its own cell of each
table and also visits the neighbouring cells that it is nearest to. Two vectors meet where
one's visit falls on the other's cell; they link when their cosine reaches the threshold.

Equal vectors of one label are one class beforehand. Cells in which nothing can meet are
dropped by an aggregation of names alone; the others are dealt in blocks of bounded size.
Pairs never leave a task: it returns counts of links and the edges of a spanning forest,
and a pair that meets in several cells counts in the first of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import U64, ceil_div, materialise, mix64
from quarry.llm._components import components

#: Tables, at least, and cells that a vector visits in each besides its own.
TABLES, VISITS = 4, 6
#: Rows of a cell that a block holds, about; a larger cell is dealt in several.
BLOCK = 2048
#: Rows for a task, by which cells are dealt.
BUCKET_ROWS = 30_000
#: Lattice units for a unit of distance: close pairs stay within one cell or its neighbours.
SCALE = 3.0


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        signs = np.array([1.0 if m >> i & 1 else -1.0 for i in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer vectors of even sum."""
    f = np.rint(x)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    worst = np.abs(x[odd] - f[odd]).argmax(axis=1)
    f[odd, worst] += np.where(x[odd, worst] >= f[odd, worst], 1.0, -1.0)
    return f


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def parts_for(n: int) -> int:
    """E8 decodings side by side for n distinct vectors: 2 below 2^17, 3 from there, 4 from 2^25, and so on, so that cells stay small."""
    return max(2, ceil_div(n.bit_length() - 1, 8))


def tables_for(parts: int) -> int:
    """Tables that keep the recall flat while more parts make cells finer."""
    return max(TABLES, parts * (parts + 1) // 2)


class Hasher:
    """Cells of unit vectors in each table, own and visited."""

    def __init__(self, dim: int, parts: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.parts, self.tables = parts, tables_for(parts)
        self.maps, self.shifts = [], []
        for _ in range(self.tables):
            width = 8 * parts
            m = rng.normal(size=(dim, width))
            if dim >= width:
                m, _ = np.linalg.qr(m)
            else:
                m /= np.linalg.norm(m, axis=0)
            self.maps.append(m * SCALE)
            self.shifts.append(rng.uniform(0, 2, width))
        self.minimal = _minimal()
        self.salt = rng.integers(1, 2**63, (self.tables, width), dtype=np.uint64) | U64(1)

    def _key(self, t: int, points: np.ndarray) -> np.ndarray:
        """64-bit names of lattice points (rows), whose doubled coordinates are integers."""
        with np.errstate(over="ignore"):
            return mix64(((2 * points).astype(np.int64).view(np.uint64) * self.salt[t]).sum(axis=-1, dtype=np.uint64) + U64(t))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, tables) own cells and (rows, tables, VISITS) visited ones."""
        n = len(unit)
        own = np.empty((n, self.tables), dtype=np.uint64)
        visited = np.empty((n, self.tables, VISITS), dtype=np.uint64)
        for t in range(self.tables):
            x = unit @ self.maps[t] + self.shifts[t]
            p = np.concatenate([nearest_e8(x[:, 8 * i : 8 * i + 8]) for i in range(self.parts)], axis=1)
            own[:, t] = self._key(t, p)
            # Distances to the neighbours of each part's point: |r - m|^2 = |r|^2 - 2 r.m + 2.
            gain = np.concatenate([(x - p)[:, 8 * i : 8 * i + 8] @ self.minimal.T for i in range(self.parts)], axis=1)
            best = np.argpartition(-gain, VISITS - 1, axis=1)[:, :VISITS]
            for v in range(VISITS):
                q = p.copy()
                part, which = np.divmod(best[:, v], len(self.minimal))
                for i in range(self.parts):
                    at = np.flatnonzero(part == i)
                    q[at, 8 * i : 8 * i + 8] += self.minimal[which[at]]
                visited[:, t, v] = self._key(t, q)
        return own, visited


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _packed(batches, kind: str):
    """(vec_id, label, vector as bytes) of the rows that can link."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        col = batch.column(2)
        flat = col.flatten().cast(pa.from_numpy_dtype(np.dtype(kind))).fill_null(np.nan).to_numpy(zero_copy_only=False)
        size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        usable = np.zeros(len(size), dtype=bool)
        full = np.flatnonzero(size > 0)
        if len(full):
            starts = (ends - size)[full]
            top = np.maximum.reduceat(np.abs(flat), starts)  # nan where a component is
            usable[full] = np.isfinite(top) & (top > 0)
        rows = np.flatnonzero(usable)
        data = flat.astype(kind).tobytes()
        packed = [data[(ends[i] - size[i]) * width : ends[i] * width] for i in rows]
        take = pa.array(rows)
        yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), pa.array(packed, pa.binary())], names=["vec_id", "label", "vec"])


def _stacked(packed: list[bytes], kind: str):
    """(rows, unit vectors) for each length of vector."""
    size = np.array([len(v) for v in packed], dtype=np.int64)
    for s in np.unique(size).tolist():
        rows = np.flatnonzero(size == s)
        yield rows, _units(np.frombuffer(b"".join([packed[i] for i in rows]), kind).reshape(len(rows), -1))


def _named(batches, parts: int, kind: str):
    """Each class with the names of its cells: by table, its own and the visited ones."""
    hashers: dict[int, Hasher] = {}
    for batch in batches:
        packed = batch.column(2).to_pylist()
        names: list = [None] * len(packed)
        for rows, unit in _stacked(packed, kind):
            dim = unit.shape[1]
            if dim not in hashers:
                hashers[dim] = Hasher(dim, parts)
            own, visited = hashers[dim].cells(unit)
            cells = mix64(np.concatenate((own[:, :, None], visited), axis=2) ^ U64(dim)).reshape(len(rows), -1)
            for i, c in zip(rows, cells.view(np.int64).tolist(), strict=True):
                names[i] = c
        yield batch.append_column("cells", pa.array(names, pa.list_(pa.int64())))


_COUNTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _first_way(cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """In how many ways rows of cx and cy could meet before they do: 3 t with equal own cells of table t,
    3 t + 1 if x visits y's, 3 t + 2 if y visits x's."""
    out = np.full(len(cx), 3 * cx.shape[1], dtype=np.int64)
    for t in range(cx.shape[1] - 1, -1, -1):
        out[(cy[:, t, 1:] == cx[:, t, :1]).any(axis=1)] = 3 * t + 2
        out[(cx[:, t, 1:] == cy[:, t, :1]).any(axis=1)] = 3 * t + 1
        out[cx[:, t, 0] == cy[:, t, 0]] = 3 * t
    return out


def _compare(rows: pa.Table, floor: float, kind: str, tables: int) -> pa.Table:
    """Link counts (a, null, n) and forest edges (a, b, 0) of the pairs that meet first in these blocks."""
    node, weight = (rows.column(c).to_numpy() for c in ("node", "weight"))
    way = rows.column("way").to_numpy().astype(np.int64)  # table of an own cell, or tables + that of a visited one
    side = rows.column("side").to_numpy()
    cells = rows.column("cells").combine_chunks().flatten().to_numpy().reshape(len(node), tables, VISITS + 1)
    block = np.stack([rows.column(c).to_numpy() for c in ("cell", "i", "j")])
    order = np.lexsort((*block, *[rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()]))
    sorted_ = block[:, order]
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()[order]
    cut = np.flatnonzero(np.concatenate(([True], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0) | (label[1:] != label[:-1]), [True])))
    packed = rows.column("vec").to_pylist()
    place, units = np.zeros(len(node), dtype=np.int64), {}
    length = np.array([len(v) for v in packed])
    for own, unit in _stacked(packed, kind):
        place[own] = np.arange(len(own))
        units[int(length[own[0]])] = unit
    total: dict[int, int] = {}
    up: dict[int, int] = {}
    edges: list[tuple[int, int]] = []

    def find(x):
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def meet(i: np.ndarray, j: np.ndarray, unit: np.ndarray) -> None:
        """Pairs of a row that stands in the cell and one that stands in it or visits it."""
        home = way[j] < tables
        keep = (node[i] != node[j]) & (~home | (node[i] < node[j]))
        i, j = i[keep], j[keep]
        keep = np.einsum("ij,ij->i", unit[place[i]], unit[place[j]]) >= floor
        i, j = i[keep], j[keep]
        swap = node[i] > node[j]
        x, y = np.where(swap, j, i), np.where(swap, i, j)
        now = np.where(way[j] < tables, 3 * way[j], 3 * (way[j] - tables) + np.where(x == j, 1, 2))
        first = now == _first_way(cells[x], cells[y])
        x, y = x[first], y[first]
        for a, b in ((x, y), (y, x)):
            one, at = np.unique(node[a], return_inverse=True)
            for v, n in zip(one.tolist(), np.bincount(at, weight[b]).tolist(), strict=True):
                total[v] = total.get(v, 0) + int(n)
        for p, q in zip(node[x].tolist(), node[y].tolist(), strict=True):
            a, b = find(p), find(q)
            if a != b:
                up[max(a, b)] = min(a, b)
                edges.append((p, q))

    waiting, held = [], 0
    for lo, hi in zip(cut[:-1], cut[1:], strict=True):
        own = order[lo:hi]
        left, right = own[side[own] != 1], own[side[own] != 0]
        left = left[way[left] < tables]
        step = max(1, (1 << 18) // max(1, len(right)))
        for k in range(0, len(left), step):
            i, j = np.repeat(left[k : k + step], len(right)), np.tile(right, len(left[k : k + step]))
            if len(i):
                waiting.append((i, j))
                held += len(i)
            if held >= 1 << 18:
                _by_length(waiting, length, units, meet)
                waiting, held = [], 0
    _by_length(waiting, length, units, meet)
    return pa.table({
        "a": [*total, *(p for p, _ in edges)], "b": [None] * len(total) + [q for _, q in edges], "n": [*total.values(), *[0] * len(edges)],
    }, schema=_COUNTED)


def _by_length(waiting, length, units, meet) -> None:
    if not waiting:
        return
    i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
    for s, unit in units.items():
        own = np.flatnonzero((length[i] == s) & (length[j] == s))
        if len(own):
            meet(i[own], j[own], unit)


def near_duplicates(vectors: DataFrame, floor: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links, components and survivors among vectors of equal label by cosine >= floor.

    Vectors that are null, empty, zero or hold null or non-finite components, and those
    without a label or an id, link with nothing; vectors of different lengths aren't
    compared. Equal vectors of a label always link (also below the precision of a cosine).
    Rows that repeat an id are one vector, that of the smallest (label, vector); each keeps a
    row. Cosines are computed in double precision. Pairs are found by hashing, so a few may be
    missed (the tests measure the recall); none below floor is linked. The number of distinct
    vectors sets the E8 parts of a cell (parts_for), and these the number of tables
    (tables_for), so that the recall doesn't fall as the input grows. Other columns are ignored.

    Columns: vec_id, n_links long (vectors linked directly), component_id (smallest vec_id
    reachable), kept boolean (vec_id = component_id; true for rows without an id).
    """
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"))
    usable = rows.where("vec_id is not null and label is not null and vec is not null").mapInArrow(lambda it: _packed(it, kind), "vec_id long, label string, vec binary")
    usable = usable.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("one")).select("vec_id", "one.label", "one.vec")
    usable = materialise(usable.withColumn("mark", F.xxhash64("label", "vec")))
    classes = usable.groupBy("mark", "label", "vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"))
    n = max(2, classes.count())
    named = classes.select("node", "weight", "vec", "label").select("node", "label", "vec", "weight")
    parts = parts_for(n)
    tables = tables_for(parts)
    named = materialise(named.mapInArrow(lambda it: _named(it, parts, kind), "node long, label string, vec binary, weight long, cells array<long>"))

    width = VISITS + 1
    entries = named.select("node", "label", F.posexplode("cells").alias("pos", "cell"))
    table, home = F.floor(F.col("pos") / width).cast("int"), F.col("pos") % width == 0
    entries = entries.select("node", "label", "cell", F.when(home, table).otherwise(table + tables).alias("way"))
    busy = entries.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("way") < tables, 1)).alias("homes")).where("homes > 0 and m > 1")
    entries = entries.join(busy, ["label", "cell"]).withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = entries.select("node", "label", "cell", "way", F.col("other").alias("i"), F.col("own").alias("j"), F.when((F.col("other") == F.col("own")) & (F.col("way") < tables), 2).otherwise(1).alias("side"))
    left = entries.where((F.col("way") < tables) & (F.col("other") != F.col("own"))).select("node", "label", "cell", "way", F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"))
    dealt = materialise(right.unionByName(left))
    buckets = max(1, ceil_div(dealt.count(), BUCKET_ROWS))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("label", "cell", "i", "j"), F.lit(buckets)))
    full = dealt.join(named.select("node", "vec", "weight", "cells"), "node")
    counted = materialise(full.groupBy("bucket").applyInArrow(lambda t: _compare(t, floor, kind, tables), "a long, b long, n long"))

    roots = components(counted.where("b is not null").select("a", "b"))
    links = counted.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    found = classes.select("mark", "label", "vec", "node", "weight").join(links, "node", "left").join(roots, "node", "left")
    found = found.select("mark", "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    # node is the smallest id of its class and root the smallest node: so root is the smallest id.
    of_id = usable.join(found, ["mark", "label", "vec"]).select("vec_id", "n_links", F.col("root").alias("component_id"))
    ids = rows.select("vec_id")
    out = ids.where("vec_id is not null").join(of_id, "vec_id", "left").unionByName(ids.where("vec_id is null").withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")}))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
