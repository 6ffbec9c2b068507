"""Reading files the way the profile expects them: text first, then one inference pass."""

from __future__ import annotations

import csv
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..config import CleanConfig, scratch_path
from ..functions import exprs as E
from ..operators.facts import long_cells
from .spanning import pieces, records

# --- fixed values -----------------------------------------------------------
ALLOWED = ("csv", "json")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
INTEGER = r"^\s*[+-]?\d+\s*$"
BOOLEAN = ("True", "TRUE", "true", "False", "FALSE", "false")
# ----------------------------------------------------------------------------


def check_inputs(spark: SparkSession, path: str, config: CleanConfig = CleanConfig()) -> DataFrame:
    """(path, bytes, verdict) per file; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    verdict = (
        F.when(~extension.isin(*ALLOWED), "type not allowed")
        .when(F.lit(False) if config.max_input_bytes is None else F.col("bytes") > config.max_input_bytes, "too large")
        .when(F.contains(name, F.lit("..")) | F.contains(name, F.lit("\\")), "invalid name")
        .otherwise("ok")
    )
    return files.withColumn("verdict", verdict)


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, bool], list[str]]:
    """Files by (encoding, has line breaks inside quotes), from one pass over their lines.

    A file is UTF-8 unless some line of it is not valid; then it is ISO-8859-1, in which every byte has a meaning. A line
    with an odd number of quotes opens or closes a cell that goes on in another line.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    files = lines.groupBy("file").agg(
        F.count_if(~F.is_valid_utf8("value")).alias("invalid"), F.count_if(quotes % 2 != 0).alias("open")
    )
    out: dict[tuple[str, bool], list[str]] = {}
    for r in sorted(files.collect(), key=lambda r: r.file):  # one row per file
        out.setdefault(("ISO-8859-1" if r.invalid else "UTF-8", r.open > 0), []).append(unquote(r.file))
    return out


def read_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """CSV with header. Cells that stand for nothing become NULL; types are inferred over all rows."""
    layouts = csv_layouts(spark, path) or {("UTF-8", False): [path]}
    parts = []
    for (encoding, spanning), files in layouts.items():
        files = path if len(layouts) == 1 else files
        if spanning:
            parts += _spanning_csv(spark, files, encoding)
            continue
        part = spark.read.csv(files, header=True, encoding=encoding, quote='"', escape='"')
        parts.append(part.toDF(*[c.removeprefix("\ufeff").removeprefix("\xef\xbb\xbf") for c in part.columns]))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    texts = raw.select(*[F.when(~E.quoted(c).isin(*NA_TOKENS), E.quoted(c)).alias(c) for c in raw.columns])
    return infer_types(texts) if infer else texts


def _spanning_csv(spark: SparkSession, path, encoding: str) -> list[DataFrame]:
    """Files with line breaks inside quotes, one table per distinct header. Every range of a file is read by itself."""
    rows = records(spark, path, "csv", encoding)
    rows = rows.select("file", "first", F.regexp_replace("text", r"\r?\n\z", "").alias("text"))
    headers: dict[tuple, list[str]] = {}
    for r in rows.filter("first").select("file", "text").collect():  # one row per file
        head = next(csv.reader([r.text.removeprefix("\ufeff").removeprefix("\xef\xbb\xbf")], strict=False), [])
        headers.setdefault(tuple(head), []).append(r.file)
    parts = []
    for head, files in headers.items():
        names = [n if n and head.count(n) == 1 else f"{n or '_c'}{i}" for i, n in enumerate(head)]
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        mine = rows.filter(~F.col("first") & (F.col("text") != ""))
        mine = mine if len(headers) == 1 else mine.filter(F.col("file").isin(files))
        parts.append(mine.select(F.from_csv("text", schema, {"quote": '"', "escape": '"'}).alias("row")).select("row.*"))
    return parts


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns to long, double or boolean where every value allows it.

    As a long or boolean cannot hold a gap in the source's type system, whole numbers with gaps become double and flags
    with gaps stay text. Dates stay text: typing them is the job of the semantic types.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    v = F.col("v")
    counted = (
        long_cells(df, [(i, E.quoted(c)) for i, c in enumerate(texts)], "v")
        .groupBy("field")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(v).alias("n"),
            F.count_if(v.rlike(INTEGER) & v.try_cast("long").isNotNull()).alias("whole"),
            F.count(E.to_number(v)).alias("number"),
            F.count_if(v.isin(*BOOLEAN)).alias("flag"),
        )
        .collect()
    )
    new: dict[str, Column] = {}
    for r in counted:
        c = E.quoted(texts[r.field])
        if not r.n:
            new[texts[r.field]] = c.try_cast("double")
        elif r.whole == r.rows:
            new[texts[r.field]] = c.try_cast("long")
        elif r.number == r.n:
            new[texts[r.field]] = E.to_number(c)
        elif r.flag == r.rows:
            new[texts[r.field]] = F.lower(c).try_cast("boolean")
    return df.select(*[new[c].alias(c) if c in new else E.quoted(c) for c in df.columns])


def one_record_per_line(spark: SparkSession, path: str) -> bool:
    """Does every filled line hold an object of its own?

    A file that begins with a bracket does not, and is not looked at line by line: an array may be one very long line.
    """
    begins = pieces(spark, path, "json").filter("start = 0").withColumn("at", F.monotonically_increasing_id())
    begins = begins.groupBy("file").agg(F.min_by(F.regexp_extract("value", r"^[\s\x{FEFF}]*(.)", 1), "at").alias("first"))
    if not begins.filter("first = '['").isEmpty():
        return False
    line = E.strip(F.col("value"))
    alone = F.startswith(line, F.lit("{")) & F.endswith(line, F.lit("}"))
    return spark.read.text(path).agg(F.count_if((line != "") & ~alone)).first()[0] == 0


def _as_json_lines(spark: SparkSession, path: str) -> str:
    """Arrays and objects over several lines, written again as one object per line."""
    text = F.regexp_replace("text", r"^[\s,\[\]\x{FEFF}]+", "")
    rows = records(spark, path, "json").select(F.translate(text, "\r\n", "  ").alias("value")).filter(F.startswith("value", F.lit("{")))
    out = scratch_path(spark, "json-lines")
    rows.write.text(out)
    return out


def read_json(spark: SparkSession, path: str, lines: bool | None = None, keep_mixed: bool = True) -> DataFrame:
    """JSON records: one record per line (``lines``; looked up if None), or arrays and objects over any lines, which are cut
    into records first, every range of a file by itself.

    A field that holds both text and other values would be inferred as text. With ``keep_mixed`` such fields are read
    as VARIANT when their values really differ in kind.
    """
    lines = one_record_per_line(spark, path) if lines is None else lines
    path = path if lines else _as_json_lines(spark, path)
    plain = spark.read.json(path)
    texts = [f.name for f in plain.schema if isinstance(f.dataType, T.StringType)]
    if not (keep_mixed and texts):
        return plain
    schema = T.StructType(
        [T.StructField(f.name, T.VariantType() if f.name in texts else f.dataType) for f in plain.schema]
    )
    variants = spark.read.schema(schema).json(path)
    cells = [(i, F.schema_of_variant(E.quoted(c))) for i, c in enumerate(texts)]
    kinds: dict[str, set] = {}
    for field, kind in long_cells(variants, cells, "kind").where("kind not in ('VOID')").distinct().collect():
        kinds.setdefault(texts[field], set()).add(kind)
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    return variants.select(
        *[
            E.quoted(c) if c not in texts
            else F.when(~F.is_variant_null(E.quoted(c)), E.quoted(c)).alias(c) if c in mixed
            else E.quoted(c).cast("string").alias(c)
            for c in variants.columns
        ]
    )


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """CSV or JSON by file ending."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        return read_csv(spark, path)
    if low.endswith(".json"):
        return read_json(spark, path)
    raise ValueError("unsupported file kind: csv and json are read; convert workbooks to one of them first")
