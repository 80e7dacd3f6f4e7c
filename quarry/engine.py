"""The library's front: an index over tables, searched by strings."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.config import Stages, TableConfig
from quarry.operators import bm25, changes, index, rank, search
from quarry.operators import stages as stages_
from quarry.plans.query import Options, Plan, parse, undouble
from quarry.sources import tables as sources


def _in_time(call: Callable, ms: int, *args):
    """What call gives within so many milliseconds; None if it fails or is late."""
    pool = ThreadPoolExecutor(max_workers=1)
    try:
        return pool.submit(call, *args).result(timeout=ms / 1000)
    except Exception:  # a model stage must not fail a search
        return None
    finally:
        pool.shutdown(wait=False)


@dataclass
class Engine:
    """An index, and vectors beside it; ``sync`` gives a new one and leaves the old as it is."""

    index: DataFrame
    vectors: DataFrame | None = None
    stages: Stages = field(default_factory=Stages)
    groups: list[list[str]] | None = None
    day_first: bool = False
    text_index: bm25.TextIndex | None = None
    #: Clients of the model stages: understander(query, tables) gives a reading, reranker(query, [(id, display)]) an order of ids
    #: and how sure it is, query_embedder(query) a vector. A client that fails or is late is as good as none.
    understander: Callable | None = None
    reranker: Callable | None = None
    query_embedder: Callable | None = None
    _readings: stages_.Cached | None = None
    _embeddings: stages_.Cached | None = None

    @staticmethod
    def over(tables: dict[str, DataFrame], configs: dict[str, TableConfig], **how) -> Engine:
        return Engine(index.build_all(tables, configs), **how)

    def with_text_index(self) -> Engine:
        self.text_index = bm25.build(self.index)
        return self

    def plan(self, q: str, today: dt.date | None = None) -> Plan:
        return parse(undouble(q), self.day_first, today, self.groups)

    def search(self, q: str | Plan, limit: int = 5, tables=(), off=(), query_vector: list[float] | None = None, vector_key: str | None = None) -> DataFrame:
        """One balanced list: position, src_table, record_id, display, kinds, fused, rank, why, best (the one record that the query names).

        Exact rows are never removed by another stage, and stand before any other of their table, until a reranker
        that is asked orders the first rows.
        """
        o = Options.of(limit, tables, off)
        stages = self.stages.clamped()
        if isinstance(q, str) and stages.understand and self.understander and "understand" not in o.off and self.plan(q).kind == "text":
            reading = self._reading(undouble(q), stages)
            if reading:
                q = reading["query"]
                o = Options.of(limit, o.tables or tuple(reading["tables"]), off)
        plan = q if isinstance(q, Plan) else self.plan(q)
        if query_vector is None and isinstance(q, str) and stages.semantic and self.query_embedder and self.vectors is not None:
            if self._embeddings is None:
                self._embeddings = stages_.Cached(self.query_embedder, 500)
            query_vector = _in_time(self._embeddings, 5000, q)
        exact = search.text_search(self.index, plan, o.limit, o.tables, text_index=self.text_index)
        lists = {"exact": exact}
        if plan.kind == "text" and stages.fuzzy and "fuzzy" not in o.off:
            lists["fuzzy"] = rank.fuzzy_search(self.index, rank.spellings(plan), o.limit, stages.fuzzy_floor, o.tables)
        if query_vector is not None and self.vectors is not None and "semantic" not in o.off:
            lists["semantic"] = rank.vector_search(self.vectors, self.index, query_vector, vector_key, o.limit, tables=o.tables)
        fused = rank.fuse(**lists)
        hits = exact.select("src_table", "record_id", "hits")
        one = rank.best(exact, plan).select("src_table", "record_id", F.lit(True).alias("best"))
        out = rank.why(fused.join(hits, ["src_table", "record_id"], "left").join(one, ["src_table", "record_id"], "left"), plan)
        out = rank.balance(out.withColumn("best", F.coalesce("best", F.lit(False))), o.limit)
        if isinstance(q, str) and stages.rerank and self.reranker and "rerank" not in o.off:
            out = self._reranked(q, out, stages)
        return out.orderBy("position")

    def _reading(self, q: str, stages: Stages) -> dict | None:
        """The model's reading of a query, checked; remembered by query, tables and date format."""
        names = [r[0] for r in self.index.select("src_table").distinct().orderBy("src_table").collect()]
        if self._readings is None:
            self._readings = stages_.Cached(lambda key: stages_.checked_understanding(self.understander(key[0], list(key[1])), list(key[1])), 2000)
        return _in_time(self._readings, stages.understand_ms, (q, tuple(names), self.day_first, dt.date.today()))

    def _reranked(self, q: str, out: DataFrame, stages: Stages) -> DataFrame:
        """The first rows in the order that the reranker gives, the others after them as they were."""
        top = out.orderBy("position").limit(stages.rerank_candidates).select("src_table", "record_id", "display").collect()
        ids = [f"{r.src_table}|{r.record_id}" for r in top]
        answer = _in_time(lambda shown: self.reranker(q, shown), stages.rerank_ms, [(i, r.display) for i, r in zip(ids, top, strict=True)])
        if not answer:
            return out
        order, _ = stages_.checked_order(answer[0], ids, answer[1] if len(answer) > 1 else None)
        places = self.index.sparkSession.createDataFrame([(*i.split("|", 1), n) for n, i in enumerate(order, 1)], "src_table string, record_id string, _place int")
        return out.join(F.broadcast(places), ["src_table", "record_id"], "left").withColumn("position", F.coalesce("_place", "position")).drop("_place")

    def sample(self, n: int = 50, seed: int = 0) -> DataFrame:
        """Some records of all tables, the same for the same seed."""
        return sources.sample(self.index.select("src_table", "record_id", "display"), n, seed)

    def estimate(self, key: str, prices: dict[str, float], model: str) -> DataFrame:
        """What embedding the records without a current vector would take, beside what is held: src_table, held, rows, chars, cost."""
        held = stages_.coverage(self.index, self._vectors(), key).select("src_table", "embedded")
        return stages_.priced(stages_.pass_estimate(self.index, self._vectors(), key), held, prices, model)

    def log(self, path: str, q: str, found: DataFrame) -> None:
        """Append a search to a log: when, what was asked, its kind, how many rows, and the first ones."""
        top = [f"{r.src_table}|{r.record_id}" for r in found.orderBy("position").limit(20).collect()]
        row = (dt.datetime.now(dt.UTC).isoformat(), q, self.plan(q).kind, len(top), top)
        sources.append_log(self.index.sparkSession.createDataFrame([row], "ts string, query string, kind string, results int, shown array<string>").coalesce(1), path)

    def _vectors(self) -> DataFrame:
        if self.vectors is not None:
            return self.vectors
        return self.index.sparkSession.createDataFrame([], "src_table string, record_id string, vec_key string, vec array<float>")

    def sync(self, name: str, source: DataFrame, config: TableConfig, tables: dict[str, DataFrame] | None = None, only: DataFrame | None = None) -> tuple[Engine, DataFrame]:
        """The engine after a table's records were read again, and what changed."""
        rows = index.build(source, name, config, tables)
        new, vectors, done = changes.apply_changes(self.index, self._vectors(), rows, name, only)
        return dataclasses.replace(self, index=new, vectors=vectors, text_index=None, _readings=None), done

    def records_changed(self, name: str, source: DataFrame, config: TableConfig, ids: list[str], deleted: list[str] = (), tables: dict[str, DataFrame] | None = None) -> tuple[Engine, DataFrame]:
        """The engine after some records were reported as changed or deleted; an id that the source no longer has is deleted too."""
        spark = self.index.sparkSession
        ids_of = lambda some: spark.createDataFrame([(str(i),) for i in dict.fromkeys(map(str, some))], "record_id string")
        wanted, gone = ids_of(ids), ids_of(deleted)
        live = source.join(wanted.join(gone, "record_id", "left_anti"), F.col(config.pk).cast("string") == F.col("record_id"), "left_semi")
        return self.sync(name, live, config, tables, only=wanted.union(gone).distinct())

    def status(self) -> DataFrame:
        """Rows, numbers and dates of each table, and when it was indexed."""
        return index.stats(self.index)
