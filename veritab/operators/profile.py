"""Column profile, role lists and dataset summary."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .facts import TableFacts, half_even

# --- fixed values -----------------------------------------------------------
DATE_WORDS = ("date", "time")
ID_NAMES = ("id", "uuid", "customer_id", "user_id")
TARGET_WORDS = ("target", "label", "class", "outcome", "y")
LONG_TEXT = 35
CATEGORY_LIMIT = 50
ROLES = ("numerical", "categorical", "date", "boolean", "text")
# ----------------------------------------------------------------------------


def frame(facts: TableFacts, schema: str, rows: list[tuple]) -> DataFrame:
    """Column-level rows (their number is bounded by the width of the table) as a DataFrame."""
    return facts.spark.createDataFrame(rows, schema)


def named(name: str, words) -> bool:
    return any(w in name.lower() for w in words)


def share(part: float, whole: float) -> float:
    return part / max(whole, 1)


def profile_summary(facts: TableFacts) -> DataFrame:
    """Rows, columns and data bytes: UTF-8 length of text plus 8 or 1 bytes per fixed-width cell."""
    size = sum(f.bytes for f in facts.base.values())
    return frame(facts, "rows long, columns long, data_bytes long", [(facts.rows, len(facts.names), size)])


def profile_columns(facts: TableFacts) -> DataFrame:
    facts.gather("quartiles", "values")
    rows = []
    for i, c in enumerate(facts.names):
        f, v = facts.measured[c], facts.values[c]
        number = f.is_numeric
        rows.append(
            (
                i,
                c,
                f.dtype,
                f.missing,
                half_even(100.0 * share(f.missing, facts.rows), 4),
                v.distinct,
                half_even(share(v.distinct, facts.rows), 4),
                f.min if number else None,
                f.max if number else None,
                f.mean if number else None,
                facts.quartiles[c][0.5] if number else None,
                float(v.mode) if number and v.mode is not None else None,
                None if number else v.mode,
                f.std if number else None,
                f.skewness if number else None,
            )
        )
    return frame(
        facts,
        "ordinal int, column string, dtype string, missing_count long, missing_pct double, unique_values long, "
        "cardinality double, min double, max double, mean double, median double, mode_number double, "
        "mode_text string, std double, skewness double",
        rows,
    )


def role_lists(facts: TableFacts) -> dict[str, list[str]]:
    roles: dict[str, list[str]] = {r: [] for r in ROLES}
    for c in facts.names:
        f = facts.base[c]
        if f.is_numeric:
            roles["numerical"].append(c)
        if named(c, DATE_WORDS):
            roles["date"].append(c)
        if f.kind == "boolean":
            roles["boolean"].append(c)
        if f.kind == "text":
            if facts.values[c].distinct <= CATEGORY_LIMIT:
                roles["categorical"].append(c)
            if mean_text_length(facts, c) > LONG_TEXT:
                roles["text"].append(c)
    return roles


def mean_text_length(facts: TableFacts, c: str) -> float:
    """Mean characters per row, a missing cell counting as 3."""
    f = facts.base[c]
    return ((f.length or 0.0) * f.count + 3.0 * f.missing) / max(facts.rows, 1)


def profile_roles(facts: TableFacts) -> DataFrame:
    rows = [(r, c) for r, columns in role_lists(facts).items() for c in columns]
    return frame(facts, "role string, column string", rows)


def role_counts(facts: TableFacts) -> DataFrame:
    rows = [(r, len(columns)) for r, columns in role_lists(facts).items() if columns]
    return frame(facts, "role string, columns long", rows)


def _role_by_name(facts: TableFacts, c: str) -> tuple[str, float, str] | None:
    name = c.lower()
    if name.endswith("_id") or name in ID_NAMES:
        return "identifier", 0.95, "The name is that of an identifier."
    if named(c, TARGET_WORDS):
        return "target_candidate", 0.83, "The name suggests something to predict."
    if facts.kinds[c] == "temporal" or named(c, DATE_WORDS):
        return "time_feature", 0.88, "The type or the name is temporal."
    return None


def column_role(facts: TableFacts, c: str, distinct: int) -> tuple[str, float, str]:
    """First matching rule over name, uniqueness and text length."""
    if found := _role_by_name(facts, c):
        return found
    if share(distinct, facts.rows) > 0.95 and distinct > 100:
        return "likely_leakage_or_identifier", 0.72, "Almost every row has its own value."
    if facts.kinds[c] == "text" and mean_text_length(facts, c) > LONG_TEXT:
        return "text_feature", 0.78, "The values are long free text."
    return "ml_feature_candidate", 0.7, "Nothing speaks against using it as a feature."


def column_roles(facts: TableFacts) -> DataFrame:
    """Only columns whose name leaves their role open are measured."""
    undecided = [c for c in facts.names if _role_by_name(facts, c) is None]
    part = facts.only(undecided) if undecided else facts
    distinct = part.distinct_counts(undecided)
    rows = [(c, *(_role_by_name(facts, c) or column_role(part, c, distinct[c]))) for c in facts.names]
    return frame(facts, "column string, role string, confidence double, reason string", rows)
