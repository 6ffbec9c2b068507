"""Settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CleanConfig:
    """Cleaning choices.

    identifier_missing: flag_issue, leave_untouched or remove_rows.
    outliers: cap, remove or flag.
    max_input_bytes: size from which input files are called too large; no limit by default.
    outlier_method: iqr, zscore, or auto (iqr for skewed columns, else zscore).
    """

    identifier_missing: str = "flag_issue"
    outliers: str = "cap"
    outlier_method: str = "auto"
    session_minutes: int = 30
    max_input_bytes: int | None = None

    def __post_init__(self):
        if self.identifier_missing not in ("flag_issue", "leave_untouched", "remove_rows"):
            raise ValueError(f"unknown identifier_missing: {self.identifier_missing}")
        if self.outliers not in ("cap", "remove", "flag"):
            raise ValueError(f"unknown outliers: {self.outliers}")
        if self.outlier_method not in ("auto", "iqr", "zscore"):
            raise ValueError(f"unknown outlier_method: {self.outlier_method}")


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir).

    Only a local master may run without it: there one temporary folder is made per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="veritab-")
    spark.conf.set("spark.checkpoint.dir", root)
    _goes_with_session(spark, root)
    return root


def _goes_with_session(spark: SparkSession, path: str) -> None:
    """The folder goes when the session's JVM ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared area, for as long as the session lasts."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _goes_with_session(spark, path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: lineage ends at files every executor can re-read.

    A columnar table beats a row checkpoint here because later passes read a few columns each.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
