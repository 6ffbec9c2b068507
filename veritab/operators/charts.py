"""Chart-ready aggregates. Drawing is left to the client; every figure covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import exprs as E
from .facts import TableFacts, half_even
from .features import correlations
from .profile import CATEGORY_LIMIT, TARGET_WORDS, frame, named
from .quantiles import exact_quantiles

# --- fixed values -----------------------------------------------------------
HISTOGRAM_BINS = 30
# ----------------------------------------------------------------------------


def correlation_matrix(facts: TableFacts) -> DataFrame:
    """Full matrix of the numeric columns, undefined as 0, two decimals."""
    names = facts.numeric
    rows = []
    if len(names) >= 2:
        found = correlations(facts, loose=True)
        flat = {c: facts.measured[c].std in (None, 0.0) for c in names}
        for a in names:
            for b in names:
                r = (0.0 if flat[a] else 1.0) if a == b else found.get((a, b), found.get((b, a)))
                rows.append((a, b, half_even(r or 0.0, 2) + 0.0))
    else:
        only = names[0] if names else "No Numeric Columns"
        rows.append((only, only, 1.0))
    return frame(facts, "x string, y string, r double", rows)


def missing_bars(facts: TableFacts, bars: int | None = None) -> DataFrame:
    """Columns by their number of gaps; ``bars`` keeps the first of them."""
    rows = sorted(facts.missing.items(), key=lambda r: -r[1])[:bars]
    return frame(facts, "position int, column string, missing long", [(i, *r) for i, r in enumerate(rows)])


def first_numeric(facts: TableFacts) -> str | None:
    return next(iter(facts.numeric), None)


def _loose(facts: TableFacts, c: str):
    """(values, count, min, max) of a column with symbols dropped."""
    f = facts.column(c)
    if f.kind == "text":
        return E.to_number_loose(E.quoted(c)), f.loose["n"], f.loose["min"], f.loose["max"]
    return facts.number(c), f.n_numeric, f.min, f.max


def histogram(facts: TableFacts, column: str | None = None, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Counts per equal-width bin of a numeric column (the first one by default), empty bins included."""
    c = column or first_numeric(facts)
    if c is None:
        raise ValueError("no numeric column; use distribution()")
    x, _, low, high = _loose(facts, c)
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    slot = F.when(x.isNotNull(), F.least(F.lit(bins - 1), F.floor((x - low) / F.lit(step)).cast("int")))  # least passes nulls over
    counted = facts.df.select(slot.alias("bin")).where("bin is not null").groupBy("bin").count()
    every = facts.spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select(  # at most `bins` rows on either side
        F.lit(c).alias("column"),
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(step)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(step)).alias("upper"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def box_summary(facts: TableFacts, column: str | None = None) -> DataFrame:
    """Five-number summary, whisker ends and outlier count of a numeric column (the first one by default)."""
    c = column or first_numeric(facts)
    if c is None:
        raise ValueError("no numeric column; use distribution()")
    x, n, low, high = _loose(facts, c)
    q = exact_quantiles(facts.df, {c: x}, {c: (n, low, high)})[c]
    spread = q[0.75] - q[0.25]
    fence_low, fence_high = q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread
    inside = x.between(fence_low, fence_high)
    row = facts.df.agg(F.min(F.when(inside, x)), F.max(F.when(inside, x)), F.count_if(~inside)).first()
    return frame(
        facts,
        "column string, min double, q1 double, median double, q3 double, max double, whisker_low double, "
        "whisker_high double, outliers long",
        [(c, low, q[0.25], q[0.5], q[0.75], high, *row)],
    )


def distribution_column(facts: TableFacts) -> str:
    """Target-like name first, then a categorical, a boolean, a column with few values, the first."""
    aimed = [c for c in facts.names if named(c, TARGET_WORDS)]
    if aimed:
        return aimed[0]  # the name decides: nothing is measured
    texts = [c for c in facts.names if facts.kinds[c] == "text"]
    distinct = facts.distinct_counts(texts)
    categorical = [c for c in texts if distinct[c] <= CATEGORY_LIMIT]
    boolean = [c for c in facts.names if facts.kinds[c] == "boolean"]
    if categorical + boolean:
        return (categorical + boolean)[0]
    distinct = facts.distinct_counts(facts.names)
    return next(iter([c for c in facts.names if distinct[c] <= CATEGORY_LIMIT] + facts.names))


def distribution(facts: TableFacts, column: str | None = None, bars: int | None = None) -> DataFrame:
    """Values by how often they occur; ``bars`` keeps the first of them."""
    c = column or distribution_column(facts)
    value = E.quoted(c)
    counted = facts.df.where(value.isNotNull()).groupBy(value.cast("string").alias("value")).count()
    if bars is not None:
        counted = counted.orderBy(F.desc("count"), "value").limit(bars)
    return counted.select(F.lit(c).alias("column"), "value", "count")


def totals(facts: TableFacts) -> DataFrame:
    missing = sum(f.missing for f in facts.base.values())
    outliers = sum(o["iqr"] for o in facts.outliers.values())
    return frame(facts, "total_missing long, total_outliers long", [(missing, outliers)])
