"""How often each text occurs, and the most frequent ones, without texts as shuffle keys.

Texts are counted by 16-byte hashes. Only the leaders, the few values with most occurrences and those that tie with the last
of them, are then looked up in the table; where values tie at a single occurrence, the smallest are taken as they pass by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as E


def long_cells(df: DataFrame, columns: list[tuple[int, Column]], value: str) -> DataFrame:
    """(field, value) per cell. One grouping then serves every column, and the plan does not grow with their number."""
    cells = F.array(*[F.struct(F.lit(i).alias("field"), c.alias(value)) for i, c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.field", f"cell.{value}")


def hashes(*values: Column) -> tuple[Column, Column]:
    return F.xxhash64(*values), F.xxhash64(F.lit(1), *values)


def hashed_cells(df: DataFrame, columns: list[tuple[int, Column]]) -> DataFrame:
    """(field, value, a, b) of every text that is there."""
    a, b = hashes(F.col("value"))
    return long_cells(df, columns, "value").where("value is not null").withColumns({"a": a, "b": b})


def text_counts(df: DataFrame, columns: list[tuple[int, Column]]) -> DataFrame:
    """(field, a, b, fold_a, fold_b, n) per distinct text; the folded hashes leave case and outer blanks aside."""
    fold_a, fold_b = hashes(F.lower(E.strip(F.col("value"))))
    cells = hashed_cells(df, columns).select("field", "a", "b", fold_a.alias("fold_a"), fold_b.alias("fold_b"))
    return cells.groupBy("field", "a", "b", "fold_a", "fold_b").agg(F.count(F.lit(1)).alias("n"))


def text_summary(counts: DataFrame) -> DataFrame:
    """One row per field: distinct, top and bottom counts, and how many values differ when folded."""
    folded = counts.groupBy("field", "fold_a", "fold_b").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("top"), F.min("n").alias("bottom"))
    return folded.groupBy("field").agg(F.sum("m").alias("distinct_n"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.count(F.lit(1)).alias("normalised"))


def leading_values(df: DataFrame, columns: list[tuple[int, Column]], counts: DataFrame, limit: int) -> dict[int, list[tuple[str, int]]]:
    """The ``limit`` most frequent texts of each field with their counts; ties go to the smaller text."""
    c = F.col
    line = Window.partitionBy("field").orderBy(c("n").desc(), "a", "b")
    ranked: dict[int, list] = {}
    for r in counts.withColumn("rank", F.row_number().over(line)).where(c("rank") <= limit).collect():
        ranked.setdefault(r.field, []).append(r)
    if not ranked:
        return {}
    wanted, singles = F.lit(False), []
    for field, rows in ranked.items():
        least = min(r.n for r in rows)
        if len(rows) == limit and least == 1:  # the last of them are some of those that occur once
            wanted = wanted | ((c("field") == field) & (c("n") > 1))
            singles.append((field, [r for r in rows if r.n > 1]))
        else:
            wanted = wanted | ((c("field") == field) & (c("n") >= least))
    sought = [(i, x) for i, x in columns if i in ranked]
    leaders = counts.where(wanted).select("field", "a", "b", "n")
    found = hashed_cells(df, sought).join(leaders, ["field", "a", "b"]).select("field", "value", "n").distinct()
    parts = [found.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(c("n").desc(), "value"))).where(c("rank") <= limit).drop("rank")]
    for field, above in singles:
        rows = hashed_cells(df, [x for x in columns if x[0] == field])
        others = [~((c("a") == r.a) & (c("b") == r.b)) for r in above]
        rows = rows.where(reduce(lambda x, y: x & y, others)) if others else rows
        parts.append(rows.orderBy("value").limit(limit - len(above)).select("field", "value", F.lit(1).cast("long").alias("n")))
    out: dict[int, list] = {}
    for r in reduce(DataFrame.unionAll, parts).collect():  # at most limit rows per column
        out.setdefault(r.field, []).append((r.value, r.n))
    return {field: sorted(v, key=lambda x: (-x[1], x[0].encode("utf-8", "surrogatepass"))) for field, v in out.items()}
