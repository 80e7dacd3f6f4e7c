"""Structured Streaming forms: changed records into the index, and searches with their clicks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

def events(raw: DataFrame) -> DataFrame:
    """(table, id, deleted) of change messages: {"tables": {t: {changed, deleted}}} or {"table", "ids", "deleted"}; every id of them."""
    shape = "tables map<string,struct<changed:array<string>,deleted:array<string>>>, table string, ids array<string>, deleted array<string>"
    m = raw.select(F.from_json("value", shape).alias("m"))
    flat = F.array(F.struct(F.col("m.table").alias("key"), F.struct(F.col("m.ids").alias("changed"), F.col("m.deleted").alias("deleted")).alias("value")))
    t = m.select(F.explode(F.coalesce(F.when(F.col("m.tables").isNotNull(), F.map_entries("m.tables")), flat)).alias("t"))
    ids = lambda c, gone: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda i: F.struct(i.alias("id"), F.lit(gone).alias("deleted")))
    both = F.concat(ids(F.col("t.value.changed"), False), ids(F.col("t.value.deleted"), True))
    return t.select(F.col("t.key").alias("table"), F.explode(both).alias("e")).where("table is not null").select("table", "e.id", "e.deleted")


def maintain(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run apply(batch, number) for each batch of changes; without every, over what there is, then stop.

    A batch that fails is given again: apply must give the same result when repeated, as keyed
    upserts and deletes do. Progress is in the checkpoint.
    """
    w = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def pair_clicks(searches: DataFrame, clicks: DataFrame, minutes: int = 10) -> DataFrame:
    """Searches (query, ts) joined with clicks (query, ts, record_id) less than so many minutes apart; state is bounded by watermarks."""
    s = searches.withWatermark("ts", f"{minutes} minutes").alias("s")
    c = clicks.select(F.col("query").alias("click_query"), F.col("ts").alias("click_ts"), "record_id").withWatermark("click_ts", f"{minutes} minutes").alias("c")
    near = F.expr(f"query = click_query and click_ts > ts - interval {minutes} minutes and click_ts < ts + interval {minutes} minutes")
    return s.join(c, near).drop("click_query")


class Progress(StreamingQueryListener):
    """Numbered events of queries, with replay from a number, and the last failure."""

    def __init__(self, keep: int = 1000):
        self.events: list[tuple[int, str, str]] = []
        self.keep, self.number, self.failure = keep, 0, None

    def _note(self, kind: str, text: str) -> None:
        self.number += 1
        self.events = [*self.events, (self.number, kind, text)][-self.keep :]

    def onQueryStarted(self, event):
        self._note("started", str(event.id))

    def onQueryProgress(self, event):
        self._note("progress", f"{event.progress.batchId}: {event.progress.numInputRows}")

    def onQueryIdle(self, event):
        self._note("idle", str(event.id))

    def onQueryTerminated(self, event):
        self.failure = event.exception
        self._note("failed" if event.exception else "ended", event.exception or str(event.id))

    def since(self, number: int) -> list[tuple[int, str, str]]:
        return [e for e in self.events if e[0] > number]
