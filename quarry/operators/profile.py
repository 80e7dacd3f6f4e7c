"""What a table's columns hold, which to index, and which known table a schema belongs to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and limits by which columns are judged and titles ranked.
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^\d{20,}$"
MAX_AVG_CHARS = 1500
#: Words of a column's name by what such columns hold that no one searches for.
UNSEARCHED = {
    "markup": "css html markdown markup rtf svg xml yaml json".split(),
    "media": "audio avatar icon image img logo photo picture thumbnail video".split(),
    "bytes": "base64 binary blob bytes raw".split(),
    "secrets": "apikey credential credentials password passwd pin pwd salt secret".split(),
    "machine keys": "checksum crc etag fingerprint guid hash md5 sha sha1 sha256 signature uuid".split(),
    "bookkeeping": "audit created history inserted log modified revision synced timestamp updated version".split(),
    "model data": "completion embedding embeddings logits prompt tokens vector".split(),
}


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: average length of filled values, shares of JSON and UUIDs among them, share of empty ones. One aggregation."""
    aggs = []
    for c in columns:
        s = F.col(c).cast("string")
        filled = s.isNotNull() & (F.trim(s) != "")
        share = lambda cond, f=filled: F.coalesce(F.avg(F.when(f, F.when(cond, 1.0).otherwise(0.0))), F.lit(0.0))
        aggs.append(F.struct(
            F.lit(c).alias("field"), F.coalesce(F.avg(F.when(filled, F.length(s))), F.lit(0.0)).alias("avg_chars"), share(s.rlike(r"^\s*[\[{]")).alias("json"),
            share(F.trim(s).rlike(UUID)).alias("uuid"), F.coalesce(F.avg(F.when(filled, 0.0).otherwise(1.0)), F.lit(1.0)).alias("empty"),
        ).alias(f"p{len(aggs)}"))
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*(F.col(f"p{i}") for i in range(len(columns))))))


def decide(profiled: DataFrame) -> DataFrame:
    """profiled with why a column is left out; null for those that stay."""
    why = F.when(F.col("empty") >= 0.999, "empty").when(F.col("avg_chars") > MAX_AVG_CHARS, "long").when(F.col("json") > 0.5, "JSON").when(F.col("uuid") > 0.5, "UUID")
    return profiled.withColumn("why", F.coalesce(why, unsearched(F.col("field"))))


def unsearched(name: Column) -> Column:
    """What a column named so holds that no one searches for; null for any other name. Words are read at _, blanks and changes of case."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\W]+", " ")), " ")
    return F.coalesce(*(F.when(F.arrays_overlap(words, F.array(*map(F.lit, own))), kind) for kind, own in UNSEARCHED.items()))


def title_rank(name: Column) -> Column:
    """Which column names a record: lower is better. (Fixed values: the patterns and their ranks.)"""
    n = F.regexp_replace(F.lower(name), "^c_?", "")
    return (
        F.when(n.rlike(r"^(full ?name|name|company|organi[sz]ation|business)$"), 0).when(n.contains("name"), 1)
        .when(n.rlike(r"^(title|subject|headline|model|brand|product|item|sku)$"), 2).when(n.rlike(r"description|notes?$|text$|body|summary|comment"), 8)
        .when(n.rlike(r"^(first|last|given|surname|family)"), 3).when(n.rlike("email|city"), 4).otherwise(9)
    )


def choose_key(fields: list[str], declared: str | None = None, hint: str | None = None) -> str | None:
    """The primary key of a schema: declared, or by name, or else hinted; never a row number."""
    usable = [f for f in fields if f.upper() != "ROWID"]
    for pattern in (r"uuid|guid", None, r"^(pk|id)$|^pk_|_pk$", r"^id_|_id$|id$"):
        if pattern is None:
            if declared in usable:
                return declared
            continue
        found = next((f for f in usable if re.search(pattern, f, re.IGNORECASE)), None)
        if found:
            return found
    return hint if hint in usable else None


def match_schema(live: DataFrame, known: DataFrame) -> DataFrame:
    """The known table of each live one, by names of fields.

    live: (name, fields array), optionally prefer (a file); known: (file, table, fields array).
    The candidate that covers most of the live fields wins, at least half of them and at least
    three (or all); then the closest in size; one in the preferred file comes first. Candidates
    meet on shared names, so no pair without a common field is looked at.
    """
    names = lambda c: F.array_distinct(F.transform(c, F.lower))
    a = live.select("name", names(F.col("fields")).alias("mine"), (F.col("prefer") if "prefer" in live.columns else F.lit(None).cast("string")).alias("prefer"))
    b = known.select("file", "table", names(F.col("fields")).alias("theirs"))
    shared = a.select("name", "prefer", F.size("mine").alias("n"), F.explode("mine").alias("f")).join(b.select("file", "table", F.size("theirs").alias("m"), F.explode("theirs").alias("f")), "f")
    shared = shared.groupBy("name", "prefer", "n", "file", "table", "m").agg(F.count(F.lit(1)).alias("shared"))
    good = shared.where("shared / n >= 0.5 and (shared >= 3 or shared = n)")
    order = F.struct(
        F.when(F.lower("file").eqNullSafe(F.lower("prefer")), 0).otherwise(1).alias("far"), (-F.col("shared") / F.col("n")).alias("less"), F.abs(F.col("m") - F.col("n")).alias("gap"),
        "file", "table", "shared",
    )
    return good.groupBy("name").agg(F.min(order).alias("o")).select("name", "o.file", "o.table", "o.shared")


def merge_saved(scanned: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """scanned with every value that was saved in place of its own, a saved null too."""
    cols = [c for c in scanned.columns if c != key]
    s = saved.select(key, F.lit(True).alias("_saved"), *(F.col(c).alias(f"_{c}") for c in cols if c in saved.columns))
    out = scanned.join(s, key, "left")
    return out.select(key, *(F.when(F.col("_saved"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in saved.columns else F.col(c) for c in cols))


def display_names(tables: DataFrame) -> DataFrame:
    """(name, label) by trust: saved, proposed, hinted, the raw name made readable; sorted by label without case."""
    plain = F.initcap(F.trim(F.regexp_replace(F.regexp_replace("name", r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\W]+", " ")))
    label = F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in ("saved", "proposed", "hinted") if c in tables.columns), plain)
    return tables.select("name", label.alias("label")).orderBy(F.lower("label"), "name")
