"""The date formats a text column holds, counted over all its values, and parsing with all of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .exprs import quoted, strip

# --- fixed values -----------------------------------------------------------
# (shape of a value, Spark pattern). Of two patterns of one shape the one that reads more of the column's values goes
# first; if they read equally many, the month comes first.
FORMATS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}", "yyyy-M-d H:mm"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy-M-d H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}", "yyyy-M-d'T'H:mm:ss"),
    (r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-M-d H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-M-d'T'H:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "d-M-yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "d/M/yy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"[A-Za-z]{4,9} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", "d MMMM yyyy"),
)
# ----------------------------------------------------------------------------


SHAPES = dict((pattern, shape) for shape, pattern in FORMATS)


def _read(c: Column, pattern: str) -> Column:
    """The value if it has the shape; that is only tried where the signs between its parts are there."""
    there = F.lit(True)
    for sign in sorted(set(re.sub(r"\\d\{[\d,]+\}|\[A-Za-z\]\{[\d,]+\}|\\", "", SHAPES[pattern]))):
        there = there & F.contains(c, F.lit(sign))
    return F.when(there & c.rlike(f"^(?:{SHAPES[pattern]})$"), F.try_to_timestamp(c, F.lit(pattern)))


def formats_read(df: DataFrame, columns: list[str]) -> dict[str, dict[str, int]]:
    """Per text column how many values each pattern reads, those that read most first, none without any. One scan."""
    out = {}
    for lo in range(0, len(columns), 20):  # bounds the plan, not the columns
        part = columns[lo : lo + 20]
        counts = [F.count(_read(strip(quoted(c)), p)) for c in part for _, p in FORMATS]
        found = iter(df.agg(*[n.alias(f"n{i}") for i, n in enumerate(counts)]).first())
        for c in part:
            n = {p: next(found) for _, p in FORMATS}
            out[c] = {p: n[p] for p in sorted((p for p in n if n[p]), key=lambda p: -n[p])}
    return out


def formats_of(df: DataFrame, columns: list[str]) -> dict[str, tuple[str, ...]]:
    """The patterns that read any value of each text column, those that read most first. One scan, no shuffle of values."""
    return {c: tuple(found) for c, found in formats_read(df, columns).items()}


def parse_date(c: Column, patterns: tuple[str, ...]) -> Column:
    """The value as the first of the patterns reads it; NULL if none does."""
    text = strip(c)
    return F.coalesce(*[_read(text, p) for p in patterns]) if patterns else F.lit(None).cast("timestamp")
