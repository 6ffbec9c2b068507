"""Counters that many writers add to, without locks.

A writer appends a batch of deltas under an id of its own. A total is the newest compacted version plus the batches that it
has not taken in. A batch or version counts once its folder is complete, so a lost executor or a retried job changes
nothing: a batch that is written again has the same id, and one that a version has taken in is never added again.

    deltas/batch=ID/   key, n         one folder per batch
    totals/version=N/  key, n         sums of all batches up to then
    taken/version=N/   batch          their ids, written before the totals
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DELTA, TOTAL = "key string, n long", "key string, n long"


def _complete(spark: SparkSession, root: str, kind: str) -> list[str]:
    """What finished writing: the values after ``=`` in the names of the folders that hold a _SUCCESS file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{kind}/*=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return [f.getPath().getParent().getName().split("=", 1)[1] for f in found or []]


def add(deltas: DataFrame, root: str, batch: str, key: str = "key", n: str | None = None) -> None:
    """Add each key's sum of ``n`` (rows, without it) as batch ``batch``; a batch that is complete is left as it is.

    From a stream, ``foreachBatch(lambda df, i: add(df, root, f"{query}-{i}"))`` counts each row once. Null keys count as
    one key, null amounts as none.
    """
    if "=" in batch or "/" in batch:
        raise ValueError(f"no id for a folder: {batch}")
    spark = deltas.sparkSession
    if batch in _complete(spark, root, "deltas"):
        return
    amount = F.count(F.lit(1)) if n is None else F.coalesce(F.sum(n), F.lit(0))
    summed = deltas.groupBy(F.col(key).cast("string").alias("key")).agg(amount.cast("long").alias("n"))
    summed.write.mode("overwrite").parquet(f"{root.rstrip('/')}/deltas/batch={batch}")


def _state(spark: SparkSession, root: str) -> tuple[int, DataFrame, DataFrame, list[str]]:
    """Newest version, its totals, its ids, and the ids of the batches that it lacks."""
    root = root.rstrip("/")
    version = max(map(int, _complete(spark, root, "totals")), default=0)
    batches = _complete(spark, root, "deltas")
    given = spark.createDataFrame([(b,) for b in batches], "batch string")
    if not version:
        return 0, spark.createDataFrame([], TOTAL), spark.createDataFrame([], "batch string"), batches
    totals = spark.read.schema(TOTAL).parquet(f"{root}/totals/version={version}")
    taken = spark.read.schema("batch string").parquet(f"{root}/taken/version={version}")
    return version, totals, taken, [r.batch for r in given.join(taken, "batch", "left_anti").collect()]


def _with_new(spark: SparkSession, root: str, totals: DataFrame, new: list[str]) -> DataFrame:
    if new:
        totals = totals.unionByName(spark.read.schema(DELTA).parquet(*[f"{root.rstrip('/')}/deltas/batch={b}" for b in new]))
    return totals.groupBy("key").agg(F.sum("n").alias("n"))


def counts(spark: SparkSession, root: str) -> DataFrame:
    """key, n: every complete batch once."""
    _, totals, _, new = _state(spark, root)
    return _with_new(spark, root, totals, new)


def compact(spark: SparkSession, root: str) -> int:
    """Take all complete batches into a new version and return its number; readers and writers may go on meanwhile.

    Of two compactions at a time one fails, as its folder exists; a version whose totals were never completed is written over.
    """
    root = root.rstrip("/")
    version, totals, taken, new = _state(spark, root)
    if not new:
        return version
    ids = taken.unionByName(spark.createDataFrame([(b,) for b in new], "batch string"))
    ids.write.mode("overwrite").parquet(f"{root}/taken/version={version + 1}")
    _with_new(spark, root, totals, new).write.mode("errorifexists").parquet(f"{root}/totals/version={version + 1}")
    return version + 1
