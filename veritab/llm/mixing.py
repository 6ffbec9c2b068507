"""Mixing sources to target weights.

Every row gets a random key from a hash. Rows of a source are ranked by that key; running sums of their word counts, first
by range of keys and then inside the one range where the budget ends, give the key at which the source is cut. What the
budget holds beyond whole passes over the source decides the cut; whole passes repeat the source. Only word counts by
source and range travel, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from .common import WORD, materialise, quoted

ADDED = ("size", "source_size", "target", "taken")


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(seed: str) -> Column:
    """16 hex digits, the same in every run. Only rows with equal id and text tie."""
    parts = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    return F.substring(F.md5(parts), 1, 16)


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """One row per source with its target, from (source, source_size).

    Sources in code point order, null last, take the weights in turn. A source's target stops at ``most`` times its size
    and the excess goes to the others by weight, again and again; that settles at target = min(cap, level * weight). Caps
    sorted by cap / weight are reached in that order, so running sums tell for each source whether the level, with all
    sources before it capped, still reaches it. The windows hold one row per source.
    """
    each = F.array(*[F.lit(w) for w in weights])
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(each, (turn % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("cap", F.col("source_size") * most)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("goal"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
    )
    s = s.withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("weight_left"))
    s = s.withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    # the level of the first source that is not capped holds for all that follow
    s = s.withColumn("final", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "cap_before", "level"))).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("final.level") * F.col("weight"))
    return s.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", digits: int = 3) -> DataFrame:
    """One row per source: target, whole passes, and the key at which the last pass is cut.

    ``digits`` hex digits of the key name a range, 4,096 per source by default; only the range that holds the cut is
    looked at row by row. Its rows are a 4,096th of the source. ``copies`` rows tie at the cut (equal rows); they share
    ``rest`` words evenly.
    """
    sized = materialise(docs.select("source", size_of(F.col("text")).alias("size"), hash_key(seed).alias("key")), "mix")
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("passes", passes)
    targets = targets.withColumn("left_over", budget - F.col("passes") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")

    def where_cut(rows: DataFrame, by: str, left: str) -> DataFrame:
        """The row of each source whose words pass ``left``, and what is left there."""
        upto = F.sum("words").over(W.partitionBy("source").orderBy(by))
        rows = rows.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
        rows = rows.filter((F.col("before") <= F.col(left)) & (F.col("upto") > F.col(left)))
        return rows.withColumn("rest", F.col(left) - F.col("before"))

    t = targets.select(F.col("source").alias("s"), "left_over")
    same = F.col("source").eqNullSafe(F.col("s"))
    cut_range = where_cut(ranges.join(t, same), "range", "left_over").select("s", F.col("range").alias("r"), F.col("rest").alias("left"))
    inside = sized.join(cut_range, same & (F.col("range") == F.col("r")))
    keys = inside.groupBy("source", "key", "left").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
    cuts = where_cut(keys, "key", "left").select(F.col("source").alias("s"), F.col("key").alias("cut"), "rest", "copies")
    return targets.join(cuts, same, "left").drop("s")


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and taken: the words that the mix takes from each row, repeats counted.

    ``docs`` needs doc_id, text and source; further columns stay, but columns of the four names are replaced. A null text
    has no words. A null source is a source of its own, the last one. Equal rows (same id and text) tie; where the cut
    falls on them they share what is left evenly, so a source may get fewer words than its budget by their number at
    most. A source without words takes nothing. An empty table gives an empty result. Reruns give the same rows.
    """
    names = [x for x in docs.columns if x not in ADDED]
    p = materialise(plan(docs, weights, share, most, seed), "mix-plan")
    rows = docs.select(F.struct(*[quoted(x) for x in names]).alias("kept"), F.col("source").alias("of"), size_of(F.col("text")).alias("size"), hash_key(seed).alias("key"))
    rows = rows.join(p, F.col("of").eqNullSafe(F.col("source")))
    last = (
        F.when(F.col("cut").isNull(), F.lit(0))
        .when(F.col("key") < F.col("cut"), F.col("size"))
        .when(F.col("key") == F.col("cut"), F.expr("rest div copies"))
        .otherwise(F.lit(0))
    )
    return rows.select(
        "kept.*",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("passes") * F.col("size") + last).cast("long").alias("taken"),
    )


def expand(mixed: DataFrame) -> DataFrame:
    """One row per pass over a row: ``epoch`` from 0, ``words`` to use (fewer than size only at a source's cut)."""
    passes = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mixed.filter(F.col("taken") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1)))
    return rows.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("epoch") * F.col("size")))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(text, ''))), 1, 16) AS key FROM documents),
s0 AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
s2 AS (SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size::DOUBLE / weight, source NULLS LAST) AS rk FROM s1),
s3 AS (SELECT *, CAST((CAST((SELECT sum(source_size) FROM s2) AS DOUBLE) * 1.5::DOUBLE
   - CAST(coalesce((SELECT sum(b.cap) FROM s2 b WHERE b.rk < a.rk), 0) AS DOUBLE)) AS DOUBLE)
   / CAST((SELECT sum(b.weight) FROM s2 b WHERE b.rk >= a.rk) AS DOUBLE) AS lev FROM s2 a),
s4 AS (SELECT source, source_size, weight, CASE WHEN lev * weight >= cap THEN CAST(cap AS DOUBLE)
   ELSE (SELECT b.lev FROM s3 b WHERE b.lev * b.weight < b.cap ORDER BY b.rk LIMIT 1) * weight END AS target FROM s3),
s5 AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, target,
   CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // CAST(source_size AS BIGINT) ELSE 0 END AS passes FROM s4),
r AS (SELECT d.doc_id, d.size, s5.source_size, s5.target, s5.passes,
   CAST(floor(s5.target) AS BIGINT) - s5.passes * s5.source_size AS left_over,
   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS upto,
   sum(d.size) OVER (PARTITION BY d.source, d.key) AS here, count(*) OVER (PARTITION BY d.source, d.key) AS copies
   FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(passes * size + CASE WHEN upto <= left_over THEN size WHEN upto - here <= left_over THEN (left_over - (upto - here)) // copies
    ELSE 0 END AS BIGINT) AS taken FROM r
"""
