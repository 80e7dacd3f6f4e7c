"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key that is spread evenly and keeps equal texts side by side.
The splitters between shards are found by counting exact bytes below candidate
boundaries: every round cuts each splitter's bracket into the prefixes of the keys in
it, counts the bytes of each in one distributed pass, and keeps the one prefix in which
the target byte lies, until one text is left. A text whose rows are few bytes stays whole,
and the nearer of its ends is the splitter; within others the search goes on, by ids.
Then the rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import materialise
from quarry.llm._ranks import numbered

#: A text whose rows hold at most this part of a shard's share isn't cut.
TOLERANCE = 0.1
#: Hexadecimal digits of a text's key; those of an id follow.
TEXT_DIGITS = 32
#: Hexadecimal digits by which a round refines a bracket: a bracket gives at most 16 ** STEP counts.
STEP = 3


def _common_prefix(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[str]:
    """The shards - 1 splitting keys of keys (key, size): a shard's keys are above the one before it, and not above its own.

    The rows of a text that holds tolerance of a shard's share, at most, are on one side. Only counts
    come to the driver: at most 16 ** STEP a round for each splitter.
    """
    low, high, total = keys.agg(F.min("key"), F.max("key"), F.sum("size")).first()
    if low is None:
        return []
    targets = [-(-s * total // shards) for s in range(1, shards)]  # the bytes before shard s
    # A bracket (prefix, below) holds the key in which the byte before a target lies.
    open_ = {t: ("", 0) for t in targets}
    found: dict[int, str | None] = {}
    skip = {"": _common_prefix(low, high)}
    while open_:
        prefixes = sorted({p for p, _ in open_.values()})
        hit = [(p, skip[p] + STEP) for p in prefixes]
        cut = reduce(lambda rest, x: F.when(F.col("key").startswith(x[0]), F.substring("key", 1, x[1])).otherwise(rest), hit, F.lit(None))
        counts = keys.select(cut.alias("cut"), "key", "size").where("cut is not null").groupBy("cut")
        counts = counts.agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("cut").collect()
        ends = list(accumulate(r["bytes"] for r in counts))
        first = {p: bisect_left([r["cut"] for r in counts], p) for p in prefixes}
        again = {}
        for t, (p, below) in open_.items():
            before = ends[first[p]] - counts[first[p]]["bytes"]
            i = bisect_left(ends, t - below + before)
            r, at = counts[i], ends[i] - counts[i]["bytes"] - before + below
            one_text = r["low"][:TEXT_DIGITS] == r["high"][:TEXT_DIGITS]
            if r["low"] == r["high"] or one_text and len(r["cut"]) <= TEXT_DIGITS and r["bytes"] <= tolerance * total / shards:
                found[t] = r["high"] if at + r["bytes"] - t < t - at else r["low"][: len(r["low"]) - 1]  # after it, or before
            else:
                again[t] = (r["cut"], at)
                skip[r["cut"]] = _common_prefix(r["low"], r["high"])
        open_ = again
    return [found[t] for t in targets]


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard under the law 'bytes': contiguous ranges of the key order with nearly equal bytes.

    A row's size is the UTF-8 bytes of its text (null: none) plus overhead. Keys are md5(text) and
    md5(id), so rows with equal texts stand together, and are in one shard unless they hold over
    TOLERANCE of a shard's share; such a group is cut between ids. A shard therefore misses its share
    by less than TOLERANCE of it, or by a single row's size if that is more. Rows alike in id and
    text share a key and a shard; null texts, and null ids, count as empty strings in the key. No row
    is left out. slot numbers a shard's rows without gaps, in the order of md5(key). grown_shard is
    null under this law. Other columns are ignored.

    Columns: doc_id, size long, text_crc32 long, law string, shard int, slot long,
    grown_shard int.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.md5(text.cast("binary")), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")))
    rows = materialise(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), key.alias("key"),
    ))
    cuts = splitters(rows, shards)
    number = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<string>"), lambda c: c < F.col("key")))
    placed = materialise(rows.withColumn("shard", number.cast("int")).withColumn("key", F.md5(F.col("key").cast("binary"))))
    out = numbered(placed, "shard", "key", ["doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
