"""Run folders: raw data, cleaned data and log of each run."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions import exprs as E


# whole microseconds, which the default format cuts
AS_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def write_run(df: DataFrame, root: str, run_id: str, part: str = "cleaned", kind: str = "parquet") -> str:
    """Write ``raw`` or ``cleaned`` data of a run, as parquet, or as CSV or JSON arrays for download."""
    path = f"{root.rstrip('/')}/{part}/run_id={run_id}"
    writer = df.write.mode("errorifexists")
    if kind == "csv":
        # Quotes inside a cell are doubled, empty text is quoted and NULL is left empty, so that all three come back.
        writer.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            emptyValue='""',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            timestampFormat="yyyy-MM-dd HH:mm:ss",
        )
    elif kind == "json":
        arrays = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(_as_array, "value string")
        arrays.write.mode("errorifexists").text(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return path


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of a task as one JSON array."""
    before = "["
    for batch in batches:
        if batch.num_rows:
            lines = batch.column("value").to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [before + lines[0], *("," + x for x in lines[1:])]})
            before = ","
    yield pa.RecordBatch.from_pydict({"value": ["]" if before == "," else "[]"]})


def read_run(spark: SparkSession, root: str, run_id: str, part: str = "cleaned") -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{part}/run_id={run_id}")


def append_log(log: DataFrame, root: str, run_id: str) -> None:
    log.write.mode("append").json(f"{root.rstrip('/')}/log/run_id={run_id}")


def read_log(spark: SparkSession, root: str, run_id: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(f"{root.rstrip('/')}/log/run_id={run_id}")


def write_tables(tables: dict[str, DataFrame], root: str, run_id: str) -> str:
    """All tables of a run's report in one partitioned write: a row is JSON, its table a folder.

    Each table also has one row with its schema, so that an empty one comes back too. Meant for results, whose rows are
    counted in columns of the judged table; whole data goes through ``write_run``.
    """
    spark = next(iter(tables.values())).sparkSession
    heads = spark.createDataFrame([(n, t.schema.json(), None) for n, t in tables.items()], "table string, schema string, row string")
    rows = [
        t.select(F.lit(n).alias("table"), F.lit(None).cast("string").alias("schema"), F.to_json(F.struct(*map(E.quoted, t.columns)), AS_JSON).alias("row"))
        for n, t in tables.items()
    ]
    path = f"{root.rstrip('/')}/report/run_id={run_id}"
    # few rows each: one file a table
    reduce(DataFrame.unionByName, rows, heads).repartition("table").write.mode("errorifexists").partitionBy("table").parquet(path)
    return path


def read_table(spark: SparkSession, root: str, run_id: str, name: str) -> DataFrame:
    kept = spark.read.parquet(f"{root.rstrip('/')}/report/run_id={run_id}").where(F.col("table") == name)
    schema = StructType.fromJson(json.loads(kept.where("schema IS NOT NULL").first().schema))
    return kept.where("schema IS NULL").select(F.from_json("row", schema, AS_JSON).alias("r")).select("r.*")
