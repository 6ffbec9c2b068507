"""Semantic type per column: first matching rule wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, exprs as E
from .facts import TableFacts, long_cells
from .profile import LONG_TEXT, frame, named, share

# --- fixed values -----------------------------------------------------------
ID_SUFFIXES = (
    "id", "customer_id", "invoice_no", "invoiceno", "order_id", "orderid", "uuid", "key", "employee_id", "employeeno",
)
TEMPORAL_WORDS = ("date", "time", "year", "joined", "dob", "created", "updated", "month", "day", "hour")
CONTINUOUS_WORDS = (
    "revenue", "income", "salary", "price", "cost", "amount", "spent", "temperature", "rate", "pct", "percent",
)
NUMERIC_TYPES = ("Continuous Numeric", "Discrete Numeric")
TEXT_TYPES = ("Categorical", "Free Text", "High Cardinality Categorical")
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Semantic:
    column: str
    type: str
    confidence: float
    reason: str
    coerced: bool = False  # text read as numbers once symbols are dropped
    date_formats: tuple[str, ...] = ()  # the formats that text dates are parsed with, in this order

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES


def unknown(c: str) -> Semantic:
    return Semantic(c, "Unknown", 0.0, "Unable to determine semantic type")


def _reads_as_number(facts: TableFacts, c: str) -> bool:
    f = facts.base[c]
    return f.kind == "text" and f.loose["n"] / f.count > 0.8


def _may_be_dates(facts: TableFacts, c: str) -> bool:
    """A text column that looks temporal by its name or by any of its values."""
    f = facts.base[c]
    return f.kind == "text" and f.loose["plain"] < f.count and (named(c, TEMPORAL_WORDS) or f.loose["dates"] > 0)


def _value_uniqueness(facts: TableFacts, coerced: list[str]) -> dict[str, int]:
    """Distinct numbers of id-named text columns that read as numbers; the others have theirs already."""
    need = [c for c in coerced if c.lower().endswith(ID_SUFFIXES)]
    if not need:
        return {}
    cells = long_cells(facts.df, [(i, E.to_number_loose(E.quoted(c))) for i, c in enumerate(need)], "value")
    counted = cells.where("value is not null").groupBy("field", "value").count().groupBy("field").count()
    return {need[r[0]]: r[1] for r in counted.collect()}


def _mixed_columns(facts: TableFacts) -> dict[str, bool]:
    """For VARIANT columns: does text live beside numbers or booleans?"""
    cells = [(i, F.schema_of_variant(E.quoted(c))) for i, c in enumerate(facts.names) if facts.kinds[c] == "mixed"]
    if not cells:
        return {}
    kinds: dict[str, set] = {}
    for field, name in long_cells(facts.df, cells, "kind").where("kind is not null").distinct().collect():
        kinds.setdefault(facts.names[field], set()).add(name)
    return {c: "STRING" in k and len(k - {"STRING", "VOID"}) > 0 for c, k in kinds.items()}


def infer_semantics(facts: TableFacts) -> dict[str, Semantic]:
    """The types of all columns, found once per table. Counts of values decide, modes take no part."""
    if "_semantics" not in facts.__dict__:
        facts._semantics = _infer(facts)
    return facts._semantics


def _infer(facts: TableFacts) -> dict[str, Semantic]:
    facts.gather("spread")
    used = [c for c in facts.names if facts.rows and facts.base[c].count]
    coerced = [c for c in used if _reads_as_number(facts, c)]
    tried = facts.date_texts([c for c in used if c not in coerced and _may_be_dates(facts, c)])
    formats = {c: f for c, (f, _) in tried.items() if f}
    shares = {c: tried[c][1] / facts.base[c].count for c in formats}
    distinct_numbers = _value_uniqueness(facts, coerced)
    mixed = _mixed_columns(facts)
    out = {}
    for c in facts.names:
        if c not in used or facts.kinds[c] == "other":
            out[c] = unknown(c)
        else:
            out[c] = _classify(facts, c, c in coerced, formats.get(c, ()), shares.get(c, 0.0), distinct_numbers.get(c), mixed)
    return out


def _classify(facts, c, coerced, date_formats, parsed, distinct_numbers, mixed) -> Semantic:
    f, v, kind = facts.base[c], facts.spread[c], facts.kinds[c]
    n = f.loose["n"] if coerced else f.count
    distinct = distinct_numbers if distinct_numbers is not None else v.distinct
    text = kind == "text" and not coerced
    number = kind == "number" or coerced

    if c.lower().endswith(ID_SUFFIXES) and distinct / n >= 0.8:
        return Semantic(c, "Identifier", 0.98, f"Named like an identifier and {distinct / n:.2f} unique.", coerced)
    if kind == "temporal":
        return Semantic(c, "DateTime", 0.99, "Stored as a date or timestamp.")
    if text and parsed > 0.8:
        return Semantic(c, "DateTime", 0.95, f"{parsed * 100:.1f}% of the values parse as dates.", False, date_formats)
    if kind == "boolean":
        return Semantic(c, "Boolean", 0.99, "Stored as a boolean.")
    if number and _zero_one(facts, c, coerced):
        return Semantic(c, "Boolean", 0.96, "Holds only 0 and 1.", coerced)
    if text and distinct == 2 and f.pair is not None:
        return Semantic(c, "Boolean", 0.96, f"Holds only {'/'.join(E.BOOLEAN_PAIRS[f.pair])}.")
    if mixed.get(c):
        return unknown(c)
    if number:
        if f.loose["whole"] < n:
            return Semantic(c, "Continuous Numeric", 0.90, "Numbers with decimals.", coerced)
        if named(c, CONTINUOUS_WORDS):
            return Semantic(c, "Continuous Numeric", 0.90, "Whole numbers of a measure, going by the name.", coerced)
        return Semantic(c, "Discrete Numeric", 0.92, "Whole numbers.", coerced)
    ratio = share(distinct, facts.rows)
    if text and f.length > LONG_TEXT:
        return Semantic(c, "Free Text", 0.88, f"Long text: {f.length:.1f} characters on average.")
    if text and distinct > 10 and ratio > 0.5:
        return Semantic(c, "High Cardinality Categorical", 0.85, f"{ratio:.2f} of the rows have their own value.")
    if text:
        return Semantic(c, "Categorical", 0.90, "Text categories.")
    if distinct <= 20 or (ratio < 0.05 and distinct <= 50):
        return Semantic(c, "Categorical", 0.85, f"Only {distinct} different values.")
    return unknown(c)


def _zero_one(facts: TableFacts, c: str, coerced: bool) -> bool:
    f = facts.base[c]
    low, high, n = (f.loose["min"], f.loose["max"], f.loose["n"]) if coerced else (f.min, f.max, f.n_numeric)
    return low == 0.0 and high == 1.0 and f.loose["zero_one"] == n


def semantic_types(facts: TableFacts) -> DataFrame:
    rows = [(s.column, s.type, s.confidence, s.reason) for s in infer_semantics(facts).values()]
    return frame(facts, "column string, type string, confidence double, reason string", rows)


def typed_value(c: str, kind: str, s: Semantic) -> Column:
    """The column as its semantic type reads it: symbols dropped, dates parsed, else unchanged."""
    raw = E.quoted(c)
    if s.is_numeric and kind == "text":
        return E.to_number_loose(raw)
    if s.type == "DateTime" and kind == "text":
        return dates.parse_date(raw, s.date_formats)
    return raw
