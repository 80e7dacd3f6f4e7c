"""Change detection and keyed maintenance of tables, as joins that give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of delta in place of those of the same keys; of rows of delta with one key, the greatest by a hash of the row."""
    same = Window.partitionBy(*keys).orderBy(F.xxhash64(F.struct(*delta.columns)).desc())
    delta = delta.withColumn("_turn", F.row_number().over(same)).where("_turn = 1").drop("_turn")
    return old.join(delta.select(*keys), keys, "left_anti").unionByName(delta, allowMissingColumns=True)


def diff(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """(keys, change): insert, update, unchanged or delete, by null-safe comparison of hashes."""
    a = old.select(*keys, F.col(hash_col).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(*keys, F.col(hash_col).alias("_new"), F.lit(True).alias("_is"))
    change = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("update")
    return a.join(b, keys, "full").select(*keys, change.alias("change"))


def changed(old: DataFrame, new: DataFrame, keys: list[str], hash_col: str = "content_hash") -> DataFrame:
    """The rows of new that aren't in old with the same hash."""
    return new.join(old.select(*keys, F.col(hash_col).alias("_old")), keys, "left").where(~F.col(hash_col).eqNullSafe(F.col("_old"))).drop("_old")


def gone(old: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(live.select(*keys), keys, "left_anti")


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys), keys, "left_anti")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the asked ids, and the ids that aren't there: these count as deleted."""
    return df.join(ids.select(key), key, "left_semi"), ids.select(key).join(df.select(key), key, "left_anti")


def keep_configured(index: DataFrame, tables) -> DataFrame:
    return index.where(F.col("src_table").isin(*tables))


def add_missing(df: DataFrame, schema) -> DataFrame:
    """df with every column of a schema, missing ones null, in its order."""
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def fill_keys(index: DataFrame) -> DataFrame:
    """index with a document key where it has none."""
    return index.withColumn("doc_key", F.coalesce("doc_key", F.concat_ws("|", "src_table", "record_id")))


def fit_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """The vectors, if they have so many dimensions (8 to 4096): a table of other ones is made anew, empty."""
    dims = min(max(dims, 8), 4096)
    one = vectors.where(F.col("vec").isNotNull()).select(F.size("vec")).first()
    return vectors if one is None or one[0] == dims else vectors.limit(0)


def stale(c: Column, current: str) -> Column:
    return ~c.eqNullSafe(F.lit(current))


def high_water(df: DataFrame, col: str):
    """The largest stamp of a table, or None."""
    return df.agg(F.max(col)).first()[0]


def since(df: DataFrame, col: str, mark, now=None, settle_seconds: int = 300) -> DataFrame:
    """Rows after the mark; those of the mark's own instant too while it is younger than settle_seconds."""
    if mark is None:
        return df
    young = now is not None and (now - mark).total_seconds() <= settle_seconds
    return df.where(F.col(col) >= F.lit(mark) if young else F.col(col) > F.lit(mark))


def can_increment(pk: str | None, mod: str | None, held: list[str], wanted: list[str]) -> bool:
    """Whether only new rows need to be read: key and stamp are known, and the columns are the same."""
    return bool(pk and mod) and list(held) == list(wanted)


def write_notes(index: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """index with enrichment notes (src_table, record_id, enrich_text, enrich_norm) set under key."""
    n = notes.select("src_table", "record_id", F.col("enrich_text").alias("_text"), F.col("enrich_norm").alias("_norm"), F.lit(True).alias("_hit"))
    out = index.join(n, ["src_table", "record_id"], "left")
    for col, value in (("enrich_text", F.col("_text")), ("enrich_norm", F.col("_norm")), ("enrich_key", F.lit(key))):
        out = out.withColumn(col, F.when(F.col("_hit"), value).otherwise(F.col(col)))
    return out.drop("_text", "_norm", "_hit").select(*index.columns)


def clear_notes(index: DataFrame, vectors: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """Notes of a table gone, and its vectors with them."""
    mine = F.col("src_table") == table
    for col in ("enrich_text", "enrich_norm", "enrich_key"):
        index = index.withColumn(col, F.when(~mine, F.col(col)))
    return index, vectors.where(~mine)


def prune_vectors(vectors: DataFrame, index: DataFrame) -> DataFrame:
    """Vectors whose record is still indexed."""
    return vectors.join(index.select("src_table", "record_id"), ["src_table", "record_id"], "left_semi")


def needing_vectors(index: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Index rows without a vector of the current key."""
    v = vectors.select("src_table", "record_id", "vec_key")
    return index.join(v, ["src_table", "record_id"], "left").where(stale(F.col("vec_key"), key)).drop("vec_key")


def work_queue(df: DataFrame, limit: int) -> DataFrame:
    """The first rows of the work to do, in a fixed order; 0: all."""
    return df.orderBy("src_table", "record_id").limit(limit) if limit else df


def apply_changes(index: DataFrame, vectors: DataFrame, rows: DataFrame, table: str, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, vectors, changes) after a sync of a table: changed rows replaced, gone ones deleted.

    A replaced row loses its notes and its vector. only: the ids that were read, for a partial
    sync; then an id that was read and isn't in rows is gone.
    """
    mine = index.where(F.col("src_table") == table)
    if only is not None:
        mine = mine.join(only.select("record_id"), "record_id", "left_semi")
    keys = ["src_table", "record_id"]
    changes = diff(mine, rows, keys)
    touched = changes.where("change <> 'unchanged'").select(*keys)
    fresh = rows.join(changes.where("change in ('insert', 'update')").select(*keys), keys, "left_semi")
    return delete(index, touched, keys).unionByName(fresh), delete(vectors, touched, keys), changes


def detect_deletes(held: DataFrame, remote_keys: DataFrame, remote_count: int, key: str) -> DataFrame:
    """Keys that are held and no longer in the source. The narrow pull of keys is only read if the source has fewer rows."""
    if remote_count >= held.count():
        return held.select(key).limit(0)
    return held.select(key).join(remote_keys.select(key), key, "left_anti")


def manifest_merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Entries of both, those of new in place of old ones of the same key, column by column where new has a value."""
    cols = [c for c in old.columns if c != key]
    fresh = new.select(key, *(F.col(c).alias(f"_{c}") for c in cols))
    return old.join(fresh, key, "full").select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in cols))
