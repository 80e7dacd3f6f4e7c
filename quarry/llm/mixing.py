"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source's documents, in a hashed order, form blocks. With integer weights w of sum Q,
block j of a source has the window [floor(j Q / w), ceil((j + 1) Q / w)): its release and
its deadline. Earliest deadline first over these windows gives one block to each slot, so
that after any number of slots every source is within one block of its share. The
schedule repeats after Q slots, so one cycle is worked out, from the weights alone, and a
block's slot in an endless schedule follows from its number. When a source has no block
left, its later slots are closed up: the others go on in the proportion of their weights.
Closing up is a count of the blocks that exist before a slot, by buckets of slots.

Places are worked out on ids and sources; whole rows move once, to the part of the order
in which they stand.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._common import ceil_div, materialise
from quarry.llm._ranks import numbered

#: The sum of all sources' weights, at most, and so the number of sources: the slots of a cycle are worked out on the
#: driver and broadcast.
MAX_CYCLE = 1 << 20
#: Slots of a bucket, and buckets of a larger one, in which blocks are counted.
SLOTS, BUCKETS = 64, 4096
#: Rows of a part of the mixture, about, up to so many parts; rows of larger parts, of which there are more.
PART_ROWS, PARTS, LARGE_ROWS = 4096, 4096, 50_000
#: Borders of parts in sources up to which they are broadcast; with more of them, rows are joined to their places.
MAX_CUTS = 200_000


#: Plans and borders go to Spark by Arrow: rows of Python would start other Python workers on the executors, which stay.
_PLAN = pa.schema([("_of", pa.string()), ("_weight", pa.int32()), ("_slots", pa.list_(pa.int32())), ("_cycle", pa.int64())])
_CUT = pa.struct([("key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("position", pa.int64()), ("slot", pa.int64())])
_BORDERS = pa.schema([("_from", pa.string()), ("_digits", pa.string()), ("_cuts", pa.list_(_CUT))])


def schedule(weights: list[int]) -> list[list[int]]:
    """The slots of each source's turns in one cycle: of the released blocks that of the earliest deadline has
    a slot, and of equal ones that of the first source."""
    cycle = sum(weights)
    slots: list[list[int]] = [[] for _ in weights]
    waiting = [(0, i) for i in range(len(weights))]
    ready: list[tuple[int, int]] = []
    for slot in range(cycle):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (ceil_div((len(slots[i]) + 1) * cycle, weights[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(slot)
        if len(slots[i]) < weights[i]:
            heapq.heappush(waiting, (len(slots[i]) * cycle // weights[i], i))
    return slots


def _plan(rows: DataFrame, weights: dict[str, int], default_weight: int) -> DataFrame:
    """(_of, _weight, _slots, _cycle) of each source."""
    sources = [r["source"] for r in rows.select("source").distinct().orderBy(F.asc_nulls_first("source")).limit(MAX_CYCLE + 1).collect()]
    w = [weights.get(s, default_weight) for s in sources]
    if min(w, default=1) < 1:
        raise ValueError("weights are positive integers")
    if sum(w) > MAX_CYCLE:
        raise ValueError(f"the weights of all sources add up to over {MAX_CYCLE}")
    plan = pa.table([sources, w, schedule(w), [sum(w)] * len(w)], schema=_PLAN)
    return rows.sparkSession.createDataFrame(plan)


def _slotted(rows: DataFrame, plan: DataFrame, block_rows: int) -> DataFrame:
    """rows (source, _n) with block and _endless: its slot in a schedule in which no source ends."""
    rows = rows.withColumn("block", F.expr(f"_n div {block_rows}")).join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("_of")))
    turn = F.get("_slots", (F.col("block") % F.col("_weight")).cast("int"))
    return rows.withColumn("_endless", F.expr("block div _weight") * F.col("_cycle") + turn).drop("_of", "_weight", "_slots", "_cycle")


def _placed(rows: DataFrame, plan: DataFrame, block_rows: int) -> DataFrame:
    """rows (key, source and others), a written table, with _n, block, slot and position."""
    rows = numbered(rows, "source", "key", ["doc_id"], "number").withColumnRenamed("number", "_n")
    rows = materialise(_slotted(rows, plan, block_rows).withColumn("_bucket", F.expr(f"_endless div {SLOTS}")))
    first = (F.col("_n") % block_rows == 0).cast("long")
    counts = materialise(rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.sum(first).alias("_blocks")).withColumn("_large", F.expr(f"_bucket div {BUCKETS}")))

    def before(df: DataFrame, window, names: dict[str, str]) -> DataFrame:
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({to: F.coalesce(F.sum(c).over(window), F.lit(0)) for c, to in names.items()})

    large = counts.groupBy("_large").agg(F.sum("_rows").alias("_rows"), F.sum("_blocks").alias("_blocks"))
    large = before(large, Window.orderBy("_large"), {"_rows": "_rows0", "_blocks": "_blocks0"}).drop("_rows", "_blocks")
    counts = before(counts, Window.partitionBy("_large").orderBy("_bucket"), {"_rows": "_rows1", "_blocks": "_blocks1"}).join(large, "_large")
    counts = counts.select("_bucket", (F.col("_rows0") + F.col("_rows1")).alias("_rows"), (F.col("_blocks0") + F.col("_blocks1")).alias("_blocks"))
    inside = Window.partitionBy("_bucket").orderBy("_endless", "_n")
    rows = rows.withColumns({"_at": F.row_number().over(inside), "_seen": F.sum(first).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))}).join(counts, "_bucket")
    rows = rows.withColumns({"slot": (F.col("_blocks") + F.col("_seen") - 1).cast("long"), "position": (F.col("_rows") + F.col("_at") - 1).cast("long")})
    return rows.drop("_bucket", "_rows", "_blocks", "_at", "_seen", "_endless")


def _md5(col):
    return F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def mix(
    docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_rows: int = 64, source_col: str = "source", id_col: str = "doc_id",
    through: Callable[[DataFrame, list[str]], DataFrame] | None = None,
) -> DataFrame:
    """docs, all columns kept, with each row's block in its source, slot and position in the mixture, in its order.

    weights are positive integers; sources that aren't named, and the null source, have
    default_weight; the weights of all sources add up to MAX_CYCLE at most. Every row has a
    place: position runs from 0 without gaps, and in every prefix of whole blocks each source
    that still has blocks is less than one block away from its weight's share. Within a source,
    rows are ordered by md5 of their id, then by a hash of the whole row; rows alike in all
    columns follow one another in any order. docs is read twice, so it should be a table, or
    cheap. Partitions are consecutive parts of the mixture, each sorted. An empty table stays empty.

    through, if given, is applied to each row before it moves: it gets the rows and the names of some
    columns of theirs that it must keep, and its other columns are returned in place of those of docs.

    More columns: block long, slot long, position long (an input column of that name is replaced).
    """
    docs = docs.drop("block", "slot", "position")
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_in"))
    key = F.concat(_md5(F.col(f"_in.`{id_col}`")), F.lower(F.lpad(F.hex(F.xxhash64("_in")), 16, "0")))
    keyed = whole.select("_in", key.alias("_key"), F.col(f"_in.`{source_col}`").cast("string").alias("source"))
    out = ("_in.*", "block", "slot", "position")

    def passed(moved: DataFrame) -> DataFrame:
        if through is None:
            return moved
        own = [c for c in moved.columns if c != "_in"]
        made = through(moved.select(F.struct(*own).alias("_own"), "_in.*"), ["_own"])
        return made.select("_own.*", F.struct(*(made[f"`{c}`"] for c in made.columns if c != "_own")).alias("_in"))

    rows = materialise(keyed.select("source", F.col("_key").alias("key"), F.lit(None).cast("long").alias("doc_id")))
    plan = materialise(_plan(rows, weights, default_weight))
    placed = materialise(_placed(rows, plan, block_rows))
    total, sources = placed.count(), plan.count()
    parts = max(1, min(PARTS, ceil_div(total, PART_ROWS)), ceil_div(total, LARGE_ROWS))
    placed = placed.withColumn("_part", F.expr(f"cast(position * {parts} div {max(total, 1)} as int)"))
    if parts * sources > MAX_CUTS or _repeats(placed):
        # The rows of one key are numbered on both sides, and matched by these numbers.
        same = lambda df, c: df.withColumn("_same", F.row_number().over(Window.partitionBy("source", c).orderBy(F.lit(0))))
        where = same(placed, "key").select(F.col("source").alias("_of"), F.col("key").alias("_of_key"), F.col("_same").alias("_of_same"), "block", "slot", "position", "_part")
        moved = same(keyed, "_key").join(where, F.col("source").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_of_key")) & (F.col("_same") == F.col("_of_same")))
        return passed(moved.select("_in", "block", "slot", "position", "_part")).repartitionById(parts, F.col("_part")).sortWithinPartitions("position").select(*out)
    cuts = placed.groupBy("source", "_part").agg(F.min("key").alias("key"), F.min("_n").alias("_n")).collect()  # MAX_CUTS at most
    starts = {r["_part"]: (r["position"], r["slot"]) for r in placed.groupBy("_part").agg(F.min("position").alias("position"), F.min("slot").alias("slot")).collect()}
    digits, borders = _borders(docs.sparkSession, cuts, starts)
    moved = keyed.join(F.broadcast(borders), F.col("source").eqNullSafe(F.col("_from")) & (F.substring("_key", 1, digits) == F.col("_digits")))
    last = F.element_at(F.filter("_cuts", lambda c: c["key"] <= F.col("_key")), -1)
    moved = passed(moved.withColumn("_cut", last).select("_in", "_key", "source", "_cut.part", "_cut.n", "_cut.position", "_cut.slot")).repartitionById(parts, F.col("part"))
    within = F.row_number().over(Window.partitionBy("part", "source").orderBy("_key"))
    moved = _slotted(moved.withColumn("_n", F.col("n") + within - 1), plan, block_rows)
    inside = Window.partitionBy("part").orderBy("_endless", "_n")
    fresh = F.coalesce((F.col("_endless") != F.lag("_endless").over(inside)).cast("long"), F.lit(0))
    moved = moved.withColumns({"position": F.col("position") + F.row_number().over(inside) - 1, "_fresh": fresh})
    moved = moved.withColumn("slot", F.col("slot") + F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return moved.sortWithinPartitions("part", "_endless", "_n").select(*out)  # as the last window has left them, if places are asked for


def _repeats(placed: DataFrame) -> bool:
    """Whether two rows of a source share a key. Rows of one key follow one another in _n."""
    return not placed.groupBy("source", "key").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1").isEmpty()


def _borders(spark, cuts: list, starts: dict) -> tuple[int, DataFrame]:
    """By source and first digits of a key: the parts in which such keys lie, with the number of the first row and
    the part's first place. Beside it, how many digits: few enough for 65536 rows, or one for each source."""
    by_source: dict = {}
    for r in cuts:
        by_source.setdefault(r["source"], []).append((r["key"], r["_part"], r["_n"], *starts[r["_part"]]))
    digits = next((d for d in (3, 2, 1) if len(by_source) << 4 * d <= 65536), 0)
    rows = []
    for source, own in by_source.items():
        own.sort()
        own[0] = ("", *own[0][1:])
        keys = [c[0] for c in own]
        for lead in (f"{i:0{digits}x}" if digits else "" for i in range(16**digits)):
            rows.append((source, lead, own[max(0, bisect_right(keys, lead) - 1) : bisect_right(keys, lead + "~")]))
    names, leads, cuts_of = zip(*rows, strict=True) if rows else ((), (), ())
    cuts_of = [[dict(zip(_CUT.names, c, strict=True)) for c in some] for some in cuts_of]
    return digits, spark.createDataFrame(pa.table([names, leads, cuts_of], schema=_BORDERS))


def mixed_ids(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block_rows: int = 64) -> DataFrame:
    """doc_id, source, block, slot and position of every row, as mix gives them; texts stay where they are.

    Rows that repeat an id, or have none, follow one another in any order. Other columns are ignored.
    """
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _md5(F.col("doc_id")).alias("key")))
    return _placed(rows, _plan(rows, weights, default_weight), block_rows).select("doc_id", "source", "block", "slot", "position")
