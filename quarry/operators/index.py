"""The search index: one row for each source record, built by one projection of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.config import TableConfig, TextJoin
from quarry.functions import text as X

_LISTS = {"nums": T.ArrayType(T.DoubleType()), "dates": T.ArrayType(T.DateType()), "indexed_at": T.TimestampType()}
SCHEMA = T.StructType([
    T.StructField(c, _LISTS.get(c, T.StringType()))
    for c in "src_table record_id display source_text search_text title_text nums dates emails digits content_hash indexed_at enrich_text enrich_norm enrich_key doc_key".split()
])
VERSION = "v1"


def kind_of(t: T.DataType) -> str:
    """How a column's values are indexed."""
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "skip" if isinstance(t, T.BooleanType) else "text"


def _written(c: Column, t: T.DataType) -> Column:
    """A value as text; null for an empty one."""
    s = X.number_text(c) if isinstance(t, (T.DoubleType, T.FloatType)) else c.cast("string")
    return F.when(s != "", s)


def _compact(*cs: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull())) if cs else F.array()


def text_join(left: DataFrame, remote: DataFrame, how: TextJoin) -> DataFrame:
    """left with the values of remote_field whose remote_key is its local_key, in order, joined by ', ' (column _joined)."""
    joined = remote.where(F.col(how.remote_key).isNotNull() & F.col(how.remote_field).isNotNull())
    joined = joined.groupBy(F.col(how.remote_key).alias("_key")).agg(F.array_join(F.sort_array(F.collect_list(F.col(how.remote_field).cast("string"))), ", ").alias("_joined"))
    return left.join(joined, F.col(how.local_key) == F.col("_key"), "left").drop("_key")


def _finish(df: DataFrame, name: str) -> DataFrame:
    """The index row from _id, _values (array of label and value), _display (JSON), _title and the typed lists."""
    lines = F.transform("_values", lambda v: F.concat(v["label"], F.lit(": "), v["value"]))
    df = df.withColumn("source_text", F.array_join(lines, "\n")).where(F.col("_id").isNotNull() & (F.col("_id") != ""))
    return df.select(
        F.lit(name).alias("src_table"), F.col("_id").alias("record_id"), F.col("_display").alias("display"), "source_text",
        X.normalise(F.array_join(F.transform("_values", lambda v: v["value"]), " ")).alias("search_text"), X.normalise(F.col("_title")).alias("title_text"),
        F.col("_nums").alias("nums"), F.col("_dates").alias("dates"), X.padded(F.col("_emails")).alias("emails"), X.padded(F.col("_digits")).alias("digits"),
        F.md5(F.concat_ws("|", "source_text", "_display", F.lit(VERSION)).cast("binary")).alias("content_hash"), F.current_timestamp().alias("indexed_at"),
        *(F.lit(None).cast("string").alias(c) for c in ("enrich_text", "enrich_norm", "enrich_key")),
        F.concat(F.lit(f"{name}|"), F.col("_id")).alias("doc_key"),
    )


def build(source: DataFrame, name: str, config: TableConfig, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The index rows of a table: no shuffle but for a text join."""
    if config.json_field:
        return build_json(source, name, config)[0]
    schema = {f.name: f.dataType for f in source.schema}
    joined = config.text_join
    if joined:
        source = text_join(source, tables[joined.table], joined)
    kinds = {f: kind_of(schema[f]) for f in config.text_fields}
    values = [F.struct(F.lit(f).alias("label"), _written(F.col(f), schema[f]).alias("value")) for f in config.text_fields]
    if joined:
        values.append(F.struct(F.lit(joined.label).alias("label"), F.when(F.col("_joined") != "", F.col("_joined")).alias("value")))
    text = [F.col(f) for f, k in kinds.items() if k == "text"]
    numbers = [F.col(f).cast("double") for f, k in kinds.items() if k == "number"]
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    shown = F.to_json(F.struct(*(F.coalesce(_written(F.col(f), schema[f]), F.lit("")).alias(f) for f in config.display_fields)))
    df = source.select(
        F.col(config.pk).cast("string").alias("_id"), F.filter(F.array(*values), lambda v: v["value"].isNotNull()).alias("_values"), shown.alias("_display"),
        (_written(F.col(config.display_fields[0]), schema[config.display_fields[0]]) if config.display_fields else F.lit("")).alias("_title"),
        _compact(*map(finite, numbers)).cast("array<double>").alias("_nums"), _compact(*(F.col(f).cast("date") for f, k in kinds.items() if k == "date")).cast("array<date>").alias("_dates"),
        _compact(*map(X.email_of, text)).cast("array<string>").alias("_emails"), _compact(*map(X.phone_of, text)).cast("array<string>").alias("_digits"),
    )
    return _finish(df, name)


def build_json(source: DataFrame, name: str, config: TableConfig) -> tuple[DataFrame, DataFrame]:
    """Index rows of records given as JSON objects, and a one-row table with the count of those that are none.

    Keys that start with _ are reserved: _id replaces the key, _display is shown; every other
    value is searched, its type read from the value.
    """
    body = F.trim(F.col(config.json_field))
    is_object = F.coalesce(body.startswith("{") & F.try_parse_json(body).isNotNull(), F.lit(False))
    df = source.withColumn("_map", F.when(is_object, F.from_json(body, "map<string,string>")))
    skipped = df.select(F.count(F.when(F.col("_map").isNull(), 1)).alias("skipped"))
    df = df.where(F.col("_map").isNotNull())
    entries = F.filter(F.map_entries("_map"), lambda e: ~e["key"].startswith("_") & e["value"].isNotNull() & (e["value"] != ""))
    df = df.withColumn("_values", F.transform(entries, lambda e: F.struct(e["key"].alias("label"), e["value"].alias("value"))))
    plain = F.transform("_values", lambda v: F.trim(v["value"]))
    number = lambda s: F.when(s.rlike(r"^[-+]?\d"), X.parse_number(s))
    date = lambda s: F.when(number(s).isNull(), X.iso_day(s))
    rest = F.filter(plain, lambda s: number(s).isNull() & date(s).isNull())
    some = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
    first = F.when(F.size("_values") > 0, F.get("_values", F.lit(0))["value"])
    shown = F.to_json(F.map_from_entries(F.transform(F.slice("_values", 1, 4), lambda v: F.struct(v["label"], v["value"]))))
    own = F.when(F.get_json_object(body, "$._display").startswith("{"), F.get_json_object(body, "$._display"))
    title = F.when(own.isNotNull(), F.get(F.map_values(F.from_json(own, "map<string,string>")), F.lit(0))).otherwise(first)
    df = df.select(
        F.coalesce(F.col("_map")["_id"], F.col(config.pk).cast("string")).alias("_id"), "_values", F.coalesce(own, shown).alias("_display"), title.alias("_title"),
        some(F.transform(plain, number)).alias("_nums"), some(F.transform(plain, date)).alias("_dates"), some(F.transform(rest, X.email_of)).alias("_emails"),
        some(F.transform(rest, X.phone_of)).alias("_digits"),
    )
    return _finish(df, name), skipped


def build_all(tables: dict[str, DataFrame], configs: dict[str, TableConfig]) -> DataFrame:
    """The index over all configured tables."""
    parts = [build(tables[name], name, config, tables) for name, config in configs.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stats(index: DataFrame) -> DataFrame:
    """Rows, last indexed, rows with numbers and with dates of each table."""
    return index.groupBy("src_table").agg(
        F.count(F.lit(1)).alias("rows"), F.max("indexed_at").alias("last_indexed"),
        F.count(F.when(F.size("nums") > 0, 1)).alias("with_numbers"), F.count(F.when(F.size("dates") > 0, 1)).alias("with_dates"),
    )


def write(index: DataFrame, path: str) -> None:
    """Replace an index: Parquet by source table, so that a table filter prunes folders."""
    index.write.mode("overwrite").partitionBy("src_table").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A stored index. Filters on words reach its files, and only the columns that a search needs are read."""
    return spark.read.schema(SCHEMA).parquet(path).select(*SCHEMA.names)
