"""A full-text index as tables, kept as files, and BM25 scores from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normal, tokens, words

K1, B = 1.2, 0.75
#: Folders over which stored postings are dealt by their word.
BUCKETS = 64


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


@dataclass
class TextIndex:
    """postings (word, doc_key, tf, len; stored ones also bucket) and stats (n, avg_len)."""

    postings: DataFrame
    stats: DataFrame

    def scores(self, typed: list[str]) -> DataFrame:
        """(doc_key, bm25) over the distinct typed words; rows with none of them are left out.

        Only the postings of these words are read: of a stored index, their folders alone.
        """
        spark = self.postings.sparkSession
        terms = sorted({w for t in typed for w in words(normal(t))})
        hits = self.postings.where(F.col("word").isin(terms))
        if "bucket" in self.postings.columns and terms:
            own = spark.range(1).select(F.array_distinct(F.array(*(_bucket(F.lit(t)) for t in terms)))).first()[0]
            hits = hits.where(F.col("bucket").isin(own))
        df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))  # a row for each typed word
        near = hits.join(F.broadcast(df), "word").crossJoin(F.broadcast(self.stats))  # stats is one row
        idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        one = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        return near.groupBy("doc_key").agg(F.sum(one).alias("bm25"))

    def save(self, path: str) -> None:
        """Postings by bucket of their word, sorted by it, and stats, as Parquet."""
        rows = self.postings.withColumn("bucket", _bucket(F.col("word")))
        rows.repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "word").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextIndex:
        return TextIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"))


def build(index: DataFrame, fields=("title_text", "search_text", "enrich_norm")) -> TextIndex:
    """Postings over the words of all fields together."""
    ts = tokens(F.concat_ws(" ", *fields))
    docs = index.select("doc_key", ts.alias("ts")).withColumn("len", F.size("ts"))
    postings = docs.select("doc_key", "len", F.explode("ts").alias("word")).groupBy("word", "doc_key", "len").agg(F.count(F.lit(1)).alias("tf"))
    return TextIndex(postings, docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len")))
