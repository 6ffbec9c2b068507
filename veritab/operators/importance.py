"""Feature importance from a shallow decision tree with exact splits.

The tree grows level by level over the whole table. A level is one count of (node, feature, value, class); running counts in
the order of the values give what every possible split would gain, and the best one of each node is kept. Counts are per
distinct value, so rows are read once a level and nothing is sampled or binned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import materialise
from ..functions import exprs as E
from .facts import TableFacts
from .ordered import BLOCK_ROWS, per_key, running_before
from .values import hashes, long_cells

DEPTH = 4
LEAST_GAIN = 1e-9


def ordinals(facts: TableFacts, columns: list[str]) -> DataFrame:
    """(column, a, b, code) of the texts of the columns, by hashes: numbered from 0 in the order of their first appearance.

    The table's ``order_by`` decides what is first (ties, and tables without one: the hash); no column of it is one task.
    """
    place = F.lit(0) if facts.order_by is None else E.quoted(facts.order_by)
    cells = F.array(*[F.struct(F.lit(i).alias("column"), E.quoted(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    rows = facts.df.select(place.alias("place"), F.explode(cells).alias("cell")).where("cell.value is not null")
    a, b = hashes(F.col("cell.value"))
    first = rows.groupBy(F.col("cell.column").alias("column"), a.alias("a"), b.alias("b")).agg(F.min("place").alias("place"))
    first = first.withColumn("one", F.lit(1))
    return per_key(first, ["column"], ["place", "a", "b"], lambda df, block: running_before(df, ["column"], ["place", "a", "b"], "one", "code", block)).select("column", "a", "b", "code")


def encoded(facts: TableFacts, inputs: list[str], label: Column) -> DataFrame:
    """One row per row: label, and x0, x1, ... as numbers; gaps are the median of numbers and -1 of anything else."""
    numbers, texts = {}, []
    for i, c in enumerate(inputs):
        kind = facts.kinds[c]
        if kind == "number":
            fallback = facts.quartiles[c][0.5] if facts.base[c].n_numeric else -1.0
            numbers[i] = F.coalesce(facts.number(c), F.lit(float(fallback)))
        elif kind == "temporal":
            numbers[i] = F.coalesce(F.unix_micros(E.quoted(c).cast("timestamp")).cast("double"), F.lit(-1.0))
        else:
            texts.append((i, c))
    rows = facts.df.select(
        label.alias("label"),
        *[x.alias(f"x{i}") for i, x in numbers.items()],
        *[F.when(E.quoted(c).isNotNull(), h).alias(f"{n}{i}") for i, c in texts for n, h in zip("ab", hashes(E.quoted(c).cast("string")))],
    )
    if texts:
        codes = materialise(ordinals(facts, [c for _, c in texts]), "codes")
        for k, (i, _) in enumerate(texts):
            mine = codes.where(F.col("column") == k).select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("code").alias("kc"))
            rows = rows.join(mine, (F.col(f"a{i}") == F.col("ka")) & (F.col(f"b{i}") == F.col("kb")), "left")
            rows = rows.withColumn(f"x{i}", F.coalesce(F.col("kc").cast("double"), F.lit(-1.0))).drop("ka", "kb", "kc", f"a{i}", f"b{i}")
    return materialise(rows.select("label", *[f"x{i}" for i in range(len(inputs))]), "encoded")


def best_splits(cells: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(node, field, cut, gain) per node from (node, field, x, label, n), by Gini impurity times rows.

    A split sends values up to ``cut`` to the left. With the rows of class c in order, the sum of squared counts left of a
    value grows by cum^2 - (cum - n)^2 with every (value, class); right of it (total - cum)^2 follows from two running sums.
    Ties go to the earlier feature, then to the smaller cut.
    """
    c = F.col
    key, order = ["node", "field", "label"], ["x"]
    large = cells.count() > block_rows  # else no key can be large

    def by_key(df: DataFrame, keys: list[str], work) -> DataFrame:
        return per_key(df, keys, order, work, block_rows) if large else work(df, None)

    cells = by_key(cells, key, lambda df, block: running_before(df, key, order, "n", "cum", block))
    # squares as doubles: whole and exact up to 2^53, and no overflow beyond
    cells = cells.withColumn("cum", (c("cum") + c("n")).cast("double"))
    totals = cells.where("field = 0").groupBy(c("node").alias("tn"), c("label").alias("tl")).agg(F.sum("n").alias("total"))
    whole = totals.groupBy(c("tn").alias("wn")).agg(F.sum("total").alias("rows"), F.sum(c("total").cast("double") * c("total")).alias("squares"))
    cells = cells.join(totals, (c("node") == c("tn")) & (c("label") == c("tl")))
    steps = cells.groupBy("node", "field", "x").agg(
        F.sum("n").alias("n"), F.sum(c("cum") * c("cum") - (c("cum") - c("n")) * (c("cum") - c("n"))).alias("grow"), F.sum(c("total").cast("double") * c("n")).alias("cross")
    )

    def summed(df: DataFrame, block: str | None) -> DataFrame:
        for value in ("n", "grow", "cross"):
            df = running_before(df, ["node", "field"], ["x"], value, f"{value}_before", block)
        return df

    steps = by_key(steps, ["node", "field"], summed)
    left, grown, cross = (c(v) + c(f"{v}_before") for v in ("n", "grow", "cross"))
    at = steps.select("node", "field", "x", left.alias("left"), grown.alias("left_squares"), cross.alias("cross")).join(whole, c("node") == c("wn"))
    right = c("rows") - c("left")
    right_squares = c("squares") - 2 * c("cross") + c("left_squares")
    at = at.where(right > 0)
    gain = c("left_squares") / c("left") + right_squares / right - c("squares") / c("rows")
    at = at.select("node", "field", "x", gain.alias("gain")).where(c("gain") > LEAST_GAIN)
    best = at.groupBy("node").agg(F.min(F.struct((-c("gain")).alias("less"), "field", "x")).alias("b"))
    return best.select("node", c("b.field").alias("field"), c("b.x").alias("cut"), (-c("b.less")).alias("gain"))


def class_importances(rows: DataFrame, features: int, depth: int = DEPTH) -> dict[int, float]:
    """Shares of the gain of a tree of ``depth`` levels over (label, x0, x1, ...), by feature number."""
    c = F.col
    rows = rows.withColumn("node", F.lit(1))
    gains: dict[int, float] = {}
    for _ in range(depth):
        cells = F.array(*[F.struct(F.lit(i).alias("field"), c(f"x{i}").alias("x")) for i in range(features)])
        counted = rows.where("node > 0").select("node", "label", F.explode(cells).alias("cell"))
        counted = counted.groupBy("node", c("cell.field").alias("field"), c("cell.x").alias("x"), "label").agg(F.count(F.lit(1)).alias("n"))
        splits = best_splits(materialise(counted, "split-counts")).collect()  # one row per node, 2 ** depth at most
        if not splits:
            break
        to = F.lit(0)  # a node without a split is finished
        for s in splits:
            gains[s.field] = gains.get(s.field, 0.0) + s.gain
            to = F.when(c("node") == s.node, s.node * 2 + (c(f"x{s.field}") > s.cut).cast("int")).otherwise(to)
        rows = rows.withColumn("node", to)
    total = sum(gains.values())
    return {f: g / total for f, g in gains.items()}
