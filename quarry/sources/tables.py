"""Files as typed tables, and logs, manifests and catalogues as files."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir), deleted when the driver ends.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = tempfile.mkdtemp(prefix="quarry-")
    path = f"{folder.rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: its folder goes with it
            return

    atexit.register(drop)
    return path


#: The source's types, by name; anything else is read as text, and Binary is dropped.
TYPES = {"Decimal": T.DoubleType(), "String": T.StringType(), "Date": T.DateType(), "DateTimeOffset": T.TimestampNTZType(), "Boolean": T.BooleanType()}


def schema_of(fields: list[tuple[str, str]], wanted: list[str] | None = None, always: tuple[str, ...] = ()) -> T.StructType:
    """The columns to read: the wanted ones, and always the key and the stamp."""
    keep = lambda n: wanted is None or n in wanted or n in always
    return T.StructType([T.StructField(n, TYPES.get(t, T.StringType())) for n, t in fields if t != "Binary" and keep(n)])


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON arrays or lines under declared types."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header; types are inferred only where none are given."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def sample(df: DataFrame, n: int = 50, seed: int | str = 0) -> DataFrame:
    """n random rows, 1 to 500: those of the least md5 of seed and row, the same for the same seed. Each task keeps n."""
    row = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(f"`{c}`").cast("string") for c in df.columns)).cast("binary"))
    return df.orderBy(row, *df.columns).limit(min(max(n, 1), 500))


def columns_of(tables: dict[str, DataFrame]) -> list[tuple[str, str, int, str]]:
    """The catalog of some tables: (table, column, place from 1, type)."""
    return [(name, f.name, i, f.dataType.simpleString()) for name, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]


class Catalog:
    """Tables kept as Parquet in one folder, each whole or not at all, and readable from any other session.

    A table is written to a folder of its own and then named in its pointer, a small file that is replaced
    at once: a reader, or a writer that is stopped in between, finds the table as it was before or after.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _current(self, name: str) -> str | None:
        at = self._path(name, "CURRENT")
        return self.spark.read.text(at.toString()).first()[0] if self.fs.exists(at) else None

    def names(self) -> list[str]:
        if not self.fs.exists(self._path()):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._path())) if self._current(n))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        """The table, replaced by df; what it held before goes when the new one is named."""
        before, version = self._current(name), uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/{version}")
        new = self._path(name, f"CURRENT.{version}")
        out = self.fs.create(new, True)
        out.write(version.encode())
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, self._path(name, "CURRENT"), options)
        if before:
            self.fs.delete(self._path(name, before), True)
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def drop(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def keep(self, names) -> None:
        """Only these tables stay."""
        for name in set(self.names()) - set(names):
            self.drop(name)

    def columns(self) -> list[tuple[str, str, int, str]]:
        return columns_of({n: self.table(n) for n in self.names()})


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def tail(spark: SparkSession, path: str, schema: T.StructType, n: int, ts: str = "ts") -> DataFrame:
    """The last n entries, newest first; lines that don't parse are skipped."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path).where(F.col("_bad").isNull()).drop("_bad").orderBy(F.col(ts).desc()).limit(n)


def counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    return {name: df.count() for name, df in tables.items()}


def read_manifest(path: str) -> dict:
    """A JSON document of the driver; empty if it isn't there or doesn't parse."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return {}


def merge_manifest(path: str, changes: dict) -> dict:
    """The manifest with the keys of changes overwritten; written whole, then moved in place."""
    out = read_manifest(path) | changes
    with open(f"{path}.new", "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, sort_keys=True, default=str)
    os.replace(f"{path}.new", path)
    return out


def read_catalogue(spark: SparkSession, path: str, row_tag: str = "Field") -> DataFrame:
    """(file, table, name, type, comment) of the fields of an XML schema export: elements with those attributes."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").load(path)
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    return df.select(has("_file").alias("file"), has("_table").alias("table"), has("_name").alias("name"), has("_type").alias("type"), has("_comment").alias("comment"))
