"""Cleaning on request: recommendations, plans, and the jobs that carry them out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import materialise
from ..functions import dates, exprs as E
from ..operators import audit
from ..operators.facts import TableFacts, distinct_rows
from ..operators.profile import DATE_WORDS, frame, named, share

# --- fixed values -----------------------------------------------------------
ACTIONS = ("remove_duplicates", "fill_missing", "fix_formatting", "handle_outliers", "convert_dtypes")
ALL_ROWS = "__rows__"
# ----------------------------------------------------------------------------


def recommendations(facts: TableFacts) -> list[tuple[str, str, float, str]]:
    """(column, action, confidence, explanation); the duplicate rule uses the column name ``__rows__``."""
    out = []
    for c in facts.names:
        f = facts.base[c]
        if not f.missing:
            continue
        if f.is_numeric:
            skewed = abs(facts.measured[c].skewness or 0.0) > 1
            if facts.outliers[c]["iqr"] > 0 or skewed:
                out.append((c, "median_imputation", 0.92, "Outliers or skew are present; the median is robust."))
            else:
                out.append((c, "mean_imputation", 0.84, "The distribution is stable; the mean keeps its centre."))
        else:
            out.append((c, "mode_imputation", 0.86, "The most frequent category preserves the distribution."))
    if facts.duplicate_rows:
        out.append((ALL_ROWS, "remove_duplicates", 0.97, "Exact copies bias statistics and learning."))
    return out


def cleaning_recommendations(facts: TableFacts) -> DataFrame:
    return frame(
        facts, "column string, recommended_action string, confidence double, explanation string", recommendations(facts)
    )


def structured_plan(facts: TableFacts) -> DataFrame:
    """Ordered actions: deduplicate, fill, clip, strip, parse."""
    facts.gather("outliers", "text_spread", "duplicate_rows")  # no modes are needed
    rows = []
    if facts.duplicate_rows:
        why = f"Dataset contains {facts.duplicate_rows} exact duplicate rows."
        rows.append(("remove_duplicates", None, "drop_exact_duplicates", why))
    for c in facts.names:
        f = facts.base[c]
        if f.missing:
            skewed = abs(facts.measured[c].skewness or 0.0) > 1.5
            method = ("median" if skewed else "mean") if f.is_numeric else "mode"
            pct = 100.0 * share(f.missing, facts.rows)
            rows.append(("fill_missing", c, method, f"Column '{c}' has {f.missing} missing cells ({pct:.1f}% missing)."))
    for c, o in facts.outliers.items():
        if o["iqr"]:
            rows.append(("handle_outliers", c, "clip_iqr_bounds", f"Column '{c}' has {o['iqr']} IQR outliers."))
    for c, _, _ in audit.format_differences(facts):
        rows.append(("fix_formatting", c, "strip_whitespace", f"Column '{c}' mixes case or surrounding blanks."))
    for c in facts.names:
        if facts.kinds[c] == "text" and named(c, DATE_WORDS):
            rows.append(("convert_dtypes", c, "datetime_parse", f"Column '{c}' holds dates as text."))
    return frame(
        facts, "position int, action string, column string, method string, reason string",
        [(i, *r) for i, r in enumerate(rows)],
    )


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else E.quoted(c) for c in df.columns]) if new else df


def apply_actions(df: DataFrame, actions: list[str], order_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run the chosen actions in their fixed order; returns the table and a log (action, cells, columns)."""
    spark, log = df.sparkSession, []
    facts = TableFacts(df, order_by)
    df = facts.df
    if "remove_duplicates" in actions:
        log.append(("remove_duplicates", facts.duplicate_rows, []))
        if facts.duplicate_rows:
            df = materialise(distinct_rows(df), "deduplicated")
            facts = TableFacts(df, order_by)
    if "fill_missing" in actions:
        new, filled = {}, 0
        for c in facts.names:
            f = facts.base[c]
            if f.missing:
                filled += f.missing
                if f.is_numeric:
                    new[c] = F.coalesce(facts.number(c), F.lit(facts.quartiles[c][0.5]))
                elif f.kind in ("text", "boolean"):
                    mode = facts.values[c].mode
                    fill = F.lit("Unknown" if mode is None else mode)
                    new[c] = F.coalesce(E.quoted(c), fill if f.kind == "text" else F.lit(mode == "1"))
        log.append(("fill_missing", filled, list(new)))
        df = _replace(df, new)
    if "fix_formatting" in actions:
        texts = [c for c in df.columns if E.kind_of(df.schema[c].dataType) == "text"]
        changed = 0
        if texts:
            counts = [F.count_if(E.strip(E.quoted(c)) != E.quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)]
            changed = sum(df.agg(*counts).first())
        log.append(("fix_formatting", changed, texts))
        df = _replace(df, {c: E.strip(E.quoted(c)) for c in texts})
    if "handle_outliers" in actions:
        facts = TableFacts(df, order_by)
        new, updated = {}, 0
        for c in facts.numeric:
            q = facts.quartiles[c]
            spread = q[0.75] - q[0.25]
            if spread:
                x = facts.number(c)
                low, high = q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread
                new[c] = F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))
                updated += facts.outliers[c]["iqr"]
        log.append(("handle_outliers", updated, list(new)))
        df = _replace(df, new)
    if "convert_dtypes" in actions:
        facts = TableFacts(df, order_by)
        new = {}
        tried = [c for c in facts.names if facts.kinds[c] == "text" and named(c, DATE_WORDS)]
        for c, formats in dates.formats_of(df, tried).items():
            if formats:
                new[c] = dates.parse_date(E.quoted(c), formats)
        log.append(("convert_dtypes", len(new), list(new)))
        df = _replace(df, new)
    return df, spark.createDataFrame(log, "action string, cells long, columns array<string>")


def apply_plan(facts: TableFacts, date_columns: list[str] = ()) -> DataFrame:
    """Carry out the recommendations, then add ``<column>_month`` and ``<column>_weekday`` (Monday = 0)."""
    df, new = facts.df, {}
    for c, action, _, _ in recommendations(facts):
        if action == "median_imputation":
            new[c] = F.coalesce(facts.number(c), F.lit(facts.quartiles[c][0.5]))
        elif action == "mean_imputation":
            new[c] = F.coalesce(facts.number(c), F.lit(facts.base[c].mean))
        elif action == "mode_imputation" and facts.kinds[c] in ("text", "boolean"):
            mode = facts.values[c].mode
            value = F.lit("Unknown" if mode is None else mode)
            new[c] = F.coalesce(E.quoted(c), value if facts.kinds[c] == "text" else F.lit(mode == "1"))
    if facts.duplicate_rows:
        df = distinct_rows(df)
    df = _replace(df, new)
    formats = dates.formats_of(facts.df, [c for c in date_columns if facts.kinds[c] == "text"])
    for c in date_columns:
        at = dates.parse_date(E.quoted(c), formats[c]) if c in formats else E.quoted(c)
        df = df.withColumns({f"{c}_month": F.month(at), f"{c}_weekday": F.weekday(at)})
    return df
