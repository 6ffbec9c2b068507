"""Ordered work without a single-task window.

A window over the whole table, or over one very large key, would sort everything in one task. Here rows are dealt to blocks
by ranges of their order, whatever its type; windows run per block, and one small row per key and block carries the state
across. Keys of ordinary size need no blocks: only large ones are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import materialise
from ..functions import exprs as E

BLOCK_ROWS = 1_000_000
BLOCK = "__block"


def in_blocks(df: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """``df`` with a block number that grows with ``order``; rows of equal order share a block.

    Written once: range bounds are drawn from a sample, so the blocks must not be dealt anew for every reading.
    """
    return materialise(df.repartitionByRange(blocks, *[E.quoted(c) for c in order]).withColumn(BLOCK, F.spark_partition_id()), "blocks")


def same(keys: list[str], others: list[str]) -> Column:
    """Keys agree, nulls with each other."""
    out = F.lit(True)
    for k, o in zip(keys, others):
        out = out & E.quoted(k).eqNullSafe(F.col(o))
    return out


def per_key(
    df: DataFrame, keys: list[str], order: list[str], work: Callable[[DataFrame, str | None], DataFrame], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``work`` over the rows of ordinary keys, and over those of large keys in blocks of about ``block_rows`` rows.

    ``work`` takes the rows and the name of the block column, None where each key is one block. There are at most as many
    large keys as the table has blocks, which bounds what is broadcast.
    """
    names = [f"__key{i}" for i in range(len(keys))]
    counts = df.groupBy(*[E.quoted(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias("__rows"))
    large = materialise(counts.filter(F.col("__rows") > block_rows), "large-keys")
    rows = large.agg(F.sum("__rows")).first()[0]
    if not rows:
        return work(df, None)
    large = F.broadcast(large.select(*names))
    ordinary = df.join(large, same(keys, names), "left_anti")
    cut = in_blocks(df.join(large, same(keys, names), "left_semi"), [*keys, *order], -(-rows // block_rows))
    return work(ordinary, None).unionByName(work(cut, BLOCK).drop(BLOCK))


def fill_in_order(df: DataFrame, columns: list[str], order_by: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Forward fill in ``order_by`` order, leading gaps taking the first value (backward fill). Nulls of the order go first."""
    order = E.quoted(order_by)
    rows = df.count()
    blocked = df.withColumn(BLOCK, F.lit(0)) if rows <= block_rows else in_blocks(df, [order_by], -(-rows // block_rows))
    ends = []
    for i, c in enumerate(columns):
        key = F.when(E.quoted(c).isNotNull(), F.struct(order))
        ends += [F.max_by(E.quoted(c), key).alias(f"last{i}"), F.min_by(E.quoted(c), key).alias(f"first{i}")]
    summary = blocked.groupBy(BLOCK).agg(*ends)
    # One row per block, so this window is over as many rows as there are blocks.
    earlier = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = summary.select(
        BLOCK,
        *[
            F.coalesce(
                F.last(f"last{i}", ignorenulls=True).over(earlier), F.first(f"first{i}", ignorenulls=True).over(whole)
            ).alias(f"__carry{i}")
            for i in range(len(columns))
        ],
    )
    running = Window.partitionBy(BLOCK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {
        c: F.coalesce(F.last(E.quoted(c), ignorenulls=True).over(running), F.col(f"__carry{i}"))
        for i, c in enumerate(columns)
    }
    joined = blocked.join(F.broadcast(carried), BLOCK)
    return joined.select(*[filled[c].alias(c) if c in filled else E.quoted(c) for c in df.columns])


def _carried(summary: DataFrame, keys: list[str], block: str, columns: list[str]) -> DataFrame:
    """The columns of a summary by (key, block) under names that a join with the rows cannot mix up."""
    return summary.select(*[E.quoted(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(block).alias("__b"), *columns)


def _with_carried(df: DataFrame, carried: DataFrame, keys: list[str], block: str) -> DataFrame:
    names = [f"__k{i}" for i in range(len(keys))]
    return df.join(carried, same([*keys, block], [*names, "__b"]), "left").drop(*names, "__b")


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, block: str | None = None) -> DataFrame:
    """Adds the sum of ``value`` over the key's earlier rows; one total per (key, block) carries it on."""
    part = [E.quoted(k) for k in keys] + ([] if block is None else [F.col(block)])
    before = Window.partitionBy(*part).orderBy(*[E.quoted(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    if block is None:
        return out
    totals = df.groupBy(*part).agg(F.sum(value).alias("__total"))
    ahead = Window.partitionBy(*part[:-1]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__ahead", F.coalesce(F.sum("__total").over(ahead), F.lit(0)))
    out = _with_carried(out, _carried(totals, keys, block, ["__ahead"]), keys, block)
    return out.withColumn(name, F.col(name) + F.col("__ahead")).drop("__ahead")


def running_minima(df: DataFrame, keys: list[str], order_by: str, values: dict[str, Column], block: str | None = None) -> DataFrame:
    """Adds under each name the minimum of its column over the key's rows up to this one; one row per (key, block) carries all."""
    part = [E.quoted(k) for k in keys] + ([] if block is None else [F.col(block)])
    upto = Window.partitionBy(*part).orderBy(E.quoted(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({name: F.min(value).over(upto) for name, value in values.items()})
    if block is None:
        return out
    least = {name: f"__least{i}" for i, name in enumerate(values)}
    ends = df.groupBy(*part).agg(*[F.min(value).alias(least[name]) for name, value in values.items()])
    ahead = Window.partitionBy(*part[:-1]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({c: F.min(c).over(ahead) for c in least.values()})
    out = _with_carried(out, _carried(ends, keys, block, list(least.values())), keys, block)
    return out.withColumns({name: F.least(name, c) for name, c in least.items()}).drop(*least.values())


def segmented_min(
    df: DataFrame, keys: list[str], order_by: str, value: Column, reset: Column, name: str, block: str | None = None
) -> DataFrame:
    """Running minimum per key that starts afresh at rows where ``reset`` holds.

    Adds ``<name>`` (this row included) and ``<name>_before`` (up to the row before). The operation is associative, so
    with ``block`` given each (key, block) is scanned by itself and one row per (key, block) carries the state over.
    """
    order = E.quoted(order_by)
    part = [E.quoted(k) for k in keys] + ([] if block is None else [F.col(block)])
    base = df.withColumns({"__value": value, "__reset": F.coalesce(reset, F.lit(False)).cast("int")})
    upto = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("__segment", F.sum("__reset").over(upto))
    within = Window.partitionBy(*part, "__segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn(name, F.min("__value").over(within))
    line = Window.partitionBy(*part).orderBy(order)
    if block is None:
        base = base.withColumn(f"{name}_before", F.lag(name).over(line))
        return base.drop("__value", "__reset", "__segment")

    summary = base.groupBy(*part).agg(
        (F.max("__segment") > 0).alias("__restarted"), F.max_by(F.col(name), F.struct(order)).alias("__tail")
    )
    summary = segmented_min(summary, keys, block, F.col("__tail"), F.col("__restarted"), "__carry")
    base = _with_carried(base, _carried(summary, keys, block, ["__carry_before"]), keys, block)
    base = base.withColumn(name, F.when(F.col("__segment") > 0, F.col(name)).otherwise(F.least(F.col(name), F.col("__carry_before"))))
    first = F.row_number().over(line) == 1
    base = base.withColumn(f"{name}_before", F.when(first, F.col("__carry_before")).otherwise(F.lag(name).over(line)))
    return base.drop("__value", "__reset", "__segment", "__carry_before")
