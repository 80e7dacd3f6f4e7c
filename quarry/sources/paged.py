"""A paged record service as a Spark data source: a partition for each range of rows.

The client that fetches a page is given by the caller. A page is fetched by the task that
reads it, and again if that task is lost. ``staged_pull`` keeps what it has fetched, span by
span, so that a pull that was broken off goes on where it stood.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.sources.tables import Catalog

#: fetch(table, columns, skip, top, since) gives rows as dicts; count(table, since) their number.
Fetch = Callable[[str, list[str], int, int, str | None], list[dict]]
Count = Callable[[str, str | None], int]
#: The folder of a catalog in which pulls are staged; no table has its name.
PULLS = "_pulls"


class Page(InputPartition):
    def __init__(self, skip: int, top: int):
        super().__init__((skip, top))
        self.skip, self.top = skip, top


def source(name: str, fetch: Fetch, count: Count, schema: T.StructType) -> type[DataSource]:
    """A data source named ``name`` over a client; options: table, page (rows), since (a stamp), first and until
    (the rows to read, by their places; all, if until isn't given)."""

    class Reader(DataSourceReader):
        def __init__(self, options, columns: T.StructType):
            self.table, self.page = options.get("table", ""), int(options.get("page", 1000))
            self.since, self.columns = options.get("since"), columns
            self.first, self.until = int(options.get("first", 0)), options.get("until")

        def partitions(self):
            n = count(self.table, self.since) if self.until is None else int(self.until)
            return [Page(i, min(self.page, n - i)) for i in range(self.first, n, self.page)] or [Page(0, 0)]

        def read(self, partition):
            names = self.columns.fieldNames()
            if partition.top:
                for row in fetch(self.table, names, partition.skip, partition.top, self.since):
                    yield tuple(row.get(c) for c in names)

    class Paged(DataSource):
        total = staticmethod(count)

        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader(self.options, schema)

    return Paged


def pull(
    spark: SparkSession, kind: type[DataSource], table: str, columns: T.StructType, since: str | None = None, page: int = 1000, span: tuple[int, int] | None = None,
) -> DataFrame:
    """The rows of a table, only the given columns, only those since a stamp; with span, those from one place to before another."""
    spark.dataSource.register(kind)
    options = {"table": table, "page": page, "since": since or None} | (dict(zip(("first", "until"), span, strict=True)) if span else {})
    return spark.read.format(kind.name()).schema(columns).options(**{k: v for k, v in options.items() if v is not None}).load()


class Cancelled(Exception):
    """A pull that was told to stop."""


def staged_pull(
    catalog: Catalog, kind: type[DataSource], table: str, columns: T.StructType, since: str | None = None, page: int = 1000, span: int = 100_000,
    load: Callable[[DataFrame], object] | None = None, should_stop: Callable[[], bool] = lambda: False,
) -> object:
    """Pull a table by spans of rows, each written beside the catalog's tables, then load what was pulled, all at once.

    A span is one Spark job over its pages, and counts as fetched once its folder is committed, so a
    failure costs the span under way at most. The next call with the same columns, stamp and sizes fetches
    what is missing; any other pull of the table starts anew. load gets all rows, and by default replaces the
    table; if it fails, the next call only loads. With should_stop, asked before each span, the spans
    are dropped and Cancelled is raised. Until load is done the table stays as it was.
    Services that don't sort their pages may repeat or skip rows that move meanwhile.
    """
    spark, fs = catalog.spark, catalog.fs
    asked = hashlib.md5(json.dumps([columns.jsonValue(), since, page, span]).encode(), usedforsecurity=False).hexdigest()
    own = catalog._path(PULLS, table)
    for other in fs.listStatus(own) if fs.exists(own) else []:
        if other.getPath().getName() != asked:
            fs.delete(other.getPath(), True)
    total = kind.total(table, since)
    spans = [(i, min(i + span, total)) for i in range(0, total, span)]
    folders = [catalog._path(PULLS, table, asked, f"{first}-{until}") for first, until in spans]
    for at, folder in zip(spans, folders, strict=True):
        if should_stop():
            fs.delete(own, True)
            raise Cancelled(table)
        if not fs.exists(catalog._path(PULLS, table, asked, folder.getName(), "_SUCCESS")):
            pull(spark, kind, table, columns, since, page, at).write.mode("overwrite").parquet(folder.toString())
    rows = spark.read.schema(columns).parquet(*(f.toString() for f in folders)) if folders else spark.createDataFrame([], columns)
    out = load(rows) if load else catalog.replace(table, rows)
    fs.delete(own, True)
    return out
