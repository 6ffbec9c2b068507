"""What the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from veritab.config import scratch_root

# Fixed: blanks are the space and the characters 9 to 13; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the cluster's shared folder and read back, so that a lost executor costs one read.

    The folder goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of the text; an empty array for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def content_key(*columns: str) -> Column:
    """128 bits that name a row by its content: equal rows share them, so results joined on them reach every repeat."""
    cols = [F.col(c) for c in columns]
    # xxhash64 passes nulls over, so the second hash also takes which of them are null
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(77), *[c.isNull() for c in cols], *cols).alias("b"))


def running_before(df: DataFrame, group: str, order: list[str], value: str, out: str, label: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the group's earlier rows, without gathering a group in one task.

    Rows are cut into ranges of (group, order), each range sums its own part of a group, and one row per group and range
    carries the sum on. Equal rows stay in one range.
    """
    ranged = materialise(df.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), label)
    inside = W.partitionBy("_range", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.sum(value).alias("_sum"))
    ahead = W.partitionBy("_group").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("_group", "_at", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_carried"))
    local = ranged.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = local.join(carried, (F.col("_range") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(out, F.col(out) + F.col("_carried")).drop("_range", "_at", "_group", "_carried")
