"""From raw documents to token ids: quality, near duplicates, personal data, mixture, tokens.

Every stage takes what its predecessor kept, and its decisions take effect: documents that
the classifier rejects and all but one of each group of near duplicates go; entities are
replaced in the text; the order of rows becomes that of the mixture; the last stage returns
the token ids. All stages but the last return the columns of documents. A table that is
written and read again keeps no order of rows (Spark reads files by size), so the last stage
finds each row's place in the mixture again and returns it beside the ids.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import queries as q
from quarry.llm._common import materialise, settled, table, trim


#: Rows of an Arrow batch: texts are long, and a task holds several batches at a time, in the JVM and in Python.
BATCH_ROWS = 1000


#: The columns of documents. Others go through the stages as one, so that none can have the name of an operator's own.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OTHERS = "_others"


def _bounded(stage):
    """The stage, with small Arrow batches, begun with trimmed executors, and apart from columns that documents haven't."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        trim(spark)  # the heap of the stage before would stand beside this one's Python workers
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(others)))
        out = stage(spark, docs.select(*(c for c in docs.columns if c in COLUMNS), packed.alias(OTHERS)), sf_dir)
        if OTHERS not in out.columns:
            return out
        at = {c: F.col(f"{OTHERS}.c{i}").alias(c) for i, c in enumerate(others)}
        return out.select(*(at.get(c, c) for c in docs.columns))

    return run_stage


@_bounded
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is fitted on the labelled rows of the corpus, as in op6.

    Null and empty texts are scored as any other; rows that repeat an id, or have none, are judged one by one."""
    from quarry.llm.quality import score

    return score(docs, q.quality_machine(spark, sf_dir), threshold=0.7).where("predicted = 1").select(*docs.columns)


@_bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component; of rows that repeat an id, all whose id stays. Rows without an id stay."""
    from quarry.llm.jaccard import jaccard_components

    found = jaccard_components(docs, k=5, percent=75)
    gone = materialise(found.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


@_bounded
def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced by surrogates; n_chars follows the text."""
    from quarry.llm.pii import replace

    out = replace(docs, q.PII_KEY)
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


@_bounded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mixture. Sources and ids may be null; rows alike in all columns follow one another."""
    from quarry.llm.mixing import mix

    return mix(docs, q.MIX_WEIGHTS, default_weight=1, block_rows=64).select(*docs.columns)


@_bounded
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, a digest of them and of what they decode to, and the row's place in the mixture, in its order.

    The places are those of mixing: they follow from rows, sources and counts, not from the order in which rows
    are read. Texts are encoded where they are read; only ids move."""
    from quarry.llm.bpe import encode
    from quarry.llm.mixing import mix

    ranks, pattern = q.tokenizer()

    def encoded(rows: DataFrame, keep: list[str]) -> DataFrame:
        out = encode(rows, ranks, pattern, keep=(*keep, "doc_id", "lang", "source"), decoded=True)
        return out.withColumns({"ids_sha256": F.sha2("ids", 256), "decoded_sha256": F.sha2("decoded", 256)}).drop("decoded")

    out = mix(docs, q.MIX_WEIGHTS, default_weight=1, block_rows=64, through=encoded)
    return out.select("doc_id", "lang", "source", "block", "slot", "position", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("bpe", tokens)]

#: Models, set joins and a vocabulary's merges have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents; between them, each result is written and read again, and what else a stage wrote is deleted."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
