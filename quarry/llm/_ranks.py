"""Numbering rows without gathering a group in one task. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm._common import materialise

#: Rows of a bucket, about; a bucket is what one task sorts.
BUCKET_ROWS = 4096


def numbered(df: DataFrame, group: str, key: str, then: list[Column | str], name: str = "number") -> DataFrame:
    """df with each row's number from 0 in its group, in the order of key and then.

    key is a lower-case hexadecimal string, evenly spread but for repeated values: its
    leading digits, as many as the group's size asks for, cut the order into buckets of about
    BUCKET_ROWS rows, which are sorted alone and offset by the counts of the buckets before
    them. df is read three times: it should be a written table of few columns, none of whose
    names begins with an underscore. Null groups are a group. There is a broadcast of the
    groups, so their number must be bounded.
    """
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(F.lit(1)).alias("_rows"))
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_rows") / BUCKET_ROWS) / 4)).cast("int")
    sizes = F.broadcast(materialise(sizes.select("_group", digits.alias("_digits"))))
    df = df.join(sizes, F.col(group).eqNullSafe(F.col("_group"))).withColumn("_bucket", F.substr(F.col(key), F.lit(1), F.col("_digits"))).drop("_group", "_digits")
    counts = df.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialise(counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(key, *then)) - 1
    counts = counts.withColumnsRenamed({group: "_group", "_bucket": "_of"})
    out = df.withColumn("_within", within).join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of")))
    return out.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_before", "_group", "_of")
