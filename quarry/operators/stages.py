"""Model stages over the index, with clients that the caller injects; their estimates and coverage."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normalise
from quarry.operators import changes


def embed_text(label: str | Column, source_text: Column) -> Column:
    """What is embedded of a record: its values without their labels, after the table's label."""
    lines = F.transform(F.split(source_text, "\n"), lambda x: F.regexp_replace(x, r"^[^:\n]{1,40}:\s*", ""))
    return F.concat(F.lit(label) if isinstance(label, str) else label, F.lit(". "), F.array_join(F.filter(lines, lambda x: F.trim(x) != ""), ". "))


def tokens_of(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def enrich_key(model: str, prompt: str) -> str:
    return hashlib.md5(f"{model}|{prompt}".encode()).hexdigest()


def clean_note(c: Column) -> Column:
    """A note without bullets and blank lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?m)^[ \t]*[-*•][ \t]*", ""), r"\n\s*\n+", "\n"))


def error_kind(message: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(m.rlike(r"quota|rate.?limit|429|billing|insufficient"), "quota").when(m.rlike(r"401|403|api.?key|unauthor|forbidden|permission"), "auth")
        .when(m.rlike(r"timeout|timed out|network|econn|enotfound|fetch failed|socket|5\d\d"), "network").otherwise("other")
    )


def error_class(message: str) -> str:
    """error_kind of one message on the driver."""
    m = message.lower()
    if re.search(r"quota|rate.?limit|429|billing|insufficient", m):
        return "quota"
    if re.search(r"401|403|api.?key|unauthor|forbidden|permission", m):
        return "auth"
    return "network" if re.search(r"timeout|timed out|network|econn|enotfound|fetch failed|socket|5\d\d", m) else "other"


def parse_json(text: str):
    """The JSON value in a model's answer, fenced or surrounded by words; None if there is none."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "")
    for lo, hi in ((0, len(text)), (text.find("{"), text.rfind("}") + 1), (text.find("["), text.rfind("]") + 1)):
        if 0 <= lo < hi:
            try:
                return json.loads(text[lo:hi])
            except ValueError:
                continue
    return None


def hashing_embedder(dims: int) -> Callable[[list[str]], list[list[float]]]:
    """An offline embedder: words hashed to signed places."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dims)
            for w in re.findall(r"\w+", (t or "").lower()):
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "big")
                v[h % dims] += 1 if h >> 63 else -1
            n = np.sqrt(v @ v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return embed


def embed(index: DataFrame, vectors: DataFrame, embedder: Callable[[list[str]], list[list[float]]], key: str, label: str = "", cap: int = 5000, batch: int = 200) -> DataFrame:
    """The vector table with up to cap stale records embedded; orphans and replaced vectors are gone.

    embedder is called with batches of texts on the executors; it gives vectors of one length.
    """
    todo = changes.work_queue(changes.needing_vectors(index, vectors, key), cap)
    todo = todo.select("src_table", "record_id", embed_text(label or F.col("src_table"), F.concat_ws("\n", "source_text", "enrich_text")).alias("text"))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(embedder(b.column(2).to_pylist()), pa.list_(pa.float32()))], names=["src_table", "record_id", "vec"])

    made = todo.mapInArrow(run, "src_table string, record_id string, vec array<float>").withColumn("vec_key", F.lit(key))
    return changes.upsert(changes.prune_vectors(vectors, index), made.select("src_table", "record_id", "vec_key", "vec"), ["src_table", "record_id"])


def enrich(index: DataFrame, client: Callable[[str, list[str]], list[str | None]], model: str, prompts: dict[str, str], cap: int = 1000, per_call: int = 10) -> DataFrame:
    """Notes (src_table, record_id, enrich_text, enrich_norm, enrich_key) for stale rows of the tables with a prompt.

    client(prompt, texts) answers for each text; a text without an answer gets an empty note,
    so that it isn't asked again.
    """
    todo = _enrichable(index, model, prompts, cap)

    def run(batches):
        for whole in batches:
            rows = whole.to_pylist()
            for lo in range(0, len(rows), per_call):
                part = rows[lo : lo + per_call]
                answers: dict[int, str | None] = {}
                for table in sorted({r["src_table"] for r in part}):
                    own = [i for i, r in enumerate(part) if r["src_table"] == table]
                    answers |= dict(zip(own, client(prompts[table], [part[i]["source_text"] for i in own]), strict=False))
                yield pa.record_batch([
                    pa.array([r["src_table"] for r in part]), pa.array([r["record_id"] for r in part]), pa.array([answers.get(i) or "" for i in range(len(part))]),
                    pa.array([r["_key"] for r in part]),
                ], names=["src_table", "record_id", "note", "enrich_key"])

    return _noted(todo.mapInArrow(run, "src_table string, record_id string, note string, enrich_key string"))


def _enrichable(index: DataFrame, model: str, prompts: dict[str, str], cap: int) -> DataFrame:
    """(src_table, record_id, source_text, _key) of stale rows of the tables with a prompt."""
    key = F.lit(None).cast("string")
    for table, prompt in prompts.items():
        key = F.when(F.col("src_table") == table, enrich_key(model, prompt)).otherwise(key)
    todo = index.withColumn("_key", key).where(F.col("_key").isNotNull() & ~F.col("enrich_key").eqNullSafe(F.col("_key")))
    return changes.work_queue(todo, cap).select("src_table", "record_id", "source_text", "_key")


def _noted(notes: DataFrame) -> DataFrame:
    return notes.select("src_table", "record_id", clean_note(F.col("note")).alias("enrich_text"), normalise(F.col("note")).alias("enrich_norm"), "enrich_key")


def should_stop(failed: int, calls: int) -> bool:
    """Whether a pass gives up: five failures, and over half of all calls."""
    return failed >= 5 and failed * 2 > calls


@dataclass
class Pass:
    """What a pass over rows did: calls, of which failed; rows answered; why it ended before its rows did, if it did."""

    calls: int = 0
    failed: int = 0
    answered: int = 0
    stopped: str = ""


def run_calls(
    rows: Iterable[dict], call: Callable[[list[dict]], list], save: Callable[[list[tuple[dict, object]]], None],
    per_call: int = 10, workers: int = 4, flush: int = 50, tries: int = 2, cancelled: Callable[[], bool] = lambda: False,
) -> Pass:
    """Ask call for groups of rows, several at once, and save what is answered as it comes.

    This runs on the driver, over a bounded queue: a paid call is made once, whatever becomes of an executor,
    and what was saved isn't asked again when the pass is repeated. save gets (row, answer) pairs, at least
    flush of them but for the last time; a group that is answered in part has None for the rest. A call that
    fails for the network is tried again; quota and keys are not. The pass ends early by should_stop, or when
    cancelled() says so, and keeps its progress.
    """
    done, ready = Pass(), []
    rows = iter(rows)

    def ask(group: list[dict]) -> list | None:
        for left in range(tries - 1, -1, -1):
            try:
                answers = list(call(group))[: len(group)]
                return [*answers, *[None] * (len(group) - len(answers))]
            except Exception as e:  # whatever a client raises is its failure, not the pass's
                if not left or error_class(str(e)) in ("quota", "auth"):
                    return None
        return None

    with ThreadPoolExecutor(max_workers=min(max(workers, 1), 16)) as pool:
        while not done.stopped:
            groups = [g for g in (list(islice(rows, per_call)) for _ in range(workers)) if g]
            if not groups:
                break
            for group, answers in zip(groups, pool.map(ask, groups), strict=True):
                done.calls += 1
                if answers is None:
                    done.failed += 1
                    continue
                ready += zip(group, answers, strict=True)
                done.answered += len(group)
            if len(ready) >= flush:
                save(ready)
                ready = []
            done.stopped = "failures" if should_stop(done.failed, done.calls) else "cancelled" if cancelled() else ""
    if ready:
        save(ready)
    return done


def enrich_pass(index: DataFrame, client: Callable[[str, list[str]], list[str | None]], model: str, prompts: dict[str, str], save: Callable[[DataFrame], None], cap: int = 1000, **how) -> Pass:
    """As enrich, row by row under run_calls: save gets tables of notes as they are answered, to be kept by write_notes."""
    todo, spark = _enrichable(index, model, prompts, cap), index.sparkSession

    def call(group: list[dict]) -> list[str | None]:
        out: dict[int, str | None] = {}
        for table in sorted({r["src_table"] for r in group}):
            own = [i for i, r in enumerate(group) if r["src_table"] == table]
            out |= dict(zip(own, client(prompts[table], [group[i]["source_text"] for i in own]), strict=False))
        return [out.get(i) for i in range(len(group))]

    def keep(pairs) -> None:
        notes = spark.createDataFrame([(r["src_table"], r["record_id"], a or "", r["_key"]) for r, a in pairs], "src_table string, record_id string, note string, enrich_key string")
        save(_noted(notes))

    return run_calls((r.asDict() for r in todo.toLocalIterator()), call, keep, **how)


def pass_estimate(index: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Rows without a current vector, and their average text size, by table."""
    need = changes.needing_vectors(index, vectors, key)
    chars = F.length("source_text") + F.coalesce(F.length("enrich_text"), F.lit(0))
    return need.groupBy("src_table").agg(F.count(F.lit(1)).alias("rows"), F.avg(chars).alias("chars"))


def cost(rows: Column, chars: Column, price_in: float, overhead: int, tokens_out: int = 0, price_out: float = 0.0) -> Column:
    """Price of a pass: (characters / 4 + overhead) tokens in and tokens_out out for each row, prices by the million."""
    return F.round((rows * (chars / 4 + overhead) * price_in + rows * tokens_out * price_out) / 1e6, 2)


def coverage(index: DataFrame, vectors: DataFrame, key: str, totals: bool = False) -> DataFrame:
    """Rows, enriched and embedded of each table; embedded is no more than rows. totals adds a row of sums, its table null."""
    rows = index.groupBy("src_table").agg(F.count(F.lit(1)).alias("rows"), F.count("enrich_key").alias("enriched"))
    vec = vectors.where(F.col("vec_key") == key).groupBy("src_table").agg(F.count(F.lit(1)).alias("n"))
    out = rows.join(vec, "src_table", "left").select("src_table", "rows", "enriched", F.least("rows", F.coalesce("n", F.lit(0))).alias("embedded"))
    if not totals:
        return out
    sums = out.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "enriched", "embedded")))
    return out.unionByName(sums.select(F.lit(None).cast("string").alias("src_table"), "*"))


def priced(estimate: DataFrame, held: DataFrame, models: dict[str, float], model: str, overhead: int = 8) -> DataFrame:
    """The estimate of a pass (src_table, rows, chars) beside what each table already holds (src_table, embedded), with
    its price by the model's price for a million tokens; null where the model has none."""
    price = models.get(model)
    money = cost(F.col("rows"), F.col("chars"), float(price), overhead) if price is not None else F.lit(None).cast("double")
    both = held.join(estimate, "src_table", "full")
    both = both.select("src_table", F.coalesce("embedded", F.lit(0)).alias("held"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("chars", F.lit(0.0)).alias("chars"))
    return both.withColumn("cost", money)


class Cached:
    """A call with a bounded memory of its latest answers; failures aren't kept."""

    def __init__(self, call: Callable, size: int):
        self.call, self.size, self.held = call, size, OrderedDict()

    def __call__(self, key):
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        value = self.held[key] = self.call(key)
        if len(self.held) > self.size:
            self.held.popitem(last=False)
        return value


def checked_understanding(answer, tables: list[str]) -> dict | None:
    """A model's reading of a query: query text, known tables only, at most 6 names, 120 characters of reading."""
    if not isinstance(answer, dict) or not isinstance(answer.get("query"), str) or not answer["query"].strip():
        return None
    return {
        "query": answer["query"].strip(), "tables": [t for t in answer.get("tables") or [] if t in tables],
        "names": [str(n) for n in answer.get("names") or []][:6], "reading": str(answer.get("reading") or "")[:120],
    }


def checked_order(order, ids: list[str], confidence=None) -> tuple[list[str], float]:
    """A reranker's order made whole: invented and repeated ids go, omitted ones follow in their own order; confidence within 0..1."""
    known = set(ids)
    kept = list(dict.fromkeys(str(x) for x in (order if isinstance(order, list) else []) if str(x) in known))
    try:
        sure = min(max(float(confidence), 0.0), 1.0)
    except (TypeError, ValueError):
        sure = 0.0
    return kept + [i for i in ids if i not in set(kept)], 0.0 if sure != sure else sure


def name_tables(schemas: dict[str, list[str]], held: dict[str, tuple[str, str]], client: Callable[[dict[str, list[str]]], dict[str, str]] | None = None) -> dict[str, tuple[str, str]]:
    """(signature of the schema, label) for each table. A table whose schema is as it was keeps its label; for the
    others the client proposes labels, and the raw name, made readable, stands in for what it leaves out or fails at."""
    from quarry.functions.text import humanise

    sign = {t: hashlib.md5("|".join(sorted(f.lower() for f in fields)).encode()).hexdigest() for t, fields in schemas.items()}
    todo = {t: fields for t, fields in schemas.items() if held.get(t, ("",))[0] != sign[t]}
    proposed = {}
    if todo and client is not None:
        try:
            proposed = {t: str(n).strip() for t, n in (client(todo) or {}).items() if t in todo}
        except Exception:  # a model that fails must not stop a scan
            proposed = {}
    return {t: held[t] if t not in todo else (sign[t], proposed.get(t) or humanise(t)) for t in schemas}
