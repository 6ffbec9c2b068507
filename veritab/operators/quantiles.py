"""Exact quantiles with bounded state.

Spark's ``percentile`` keeps every distinct value of a group in one buffer, which a large column overflows. Here a rank is
found by histogram selection: cut the range of a column into equal bins, count the values per bin together with the
smallest and largest value found there, and keep the bin that holds the wanted rank. Each round is one scan with map-side
combine and at most columns x BINS groups, and divides the open range by BINS. A bin with a single value, or few enough
values to list, ends the search. Nothing is approximated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BINS = 1024
LISTED = 2_000  # values per open range that may be listed on the driver


@dataclass
class _Rank:
    """One order statistic (0-based), known to lie in [low, high] together with ``inside`` values."""

    name: str
    rank: int
    low: float
    high: float
    inside: int
    below: int = 0

    @property
    def range_key(self) -> tuple:
        return self.name, self.low, self.high

    def descend(self, bins: list[tuple[float, float, int]]) -> None:
        """Narrow to the bin that holds the rank."""
        seen = self.below
        for low, high, n in bins:
            if self.rank < seen + n:
                self.low, self.high, self.inside, self.below = low, high, n, seen
                return
            seen += n
        raise RuntimeError(f"rank {self.rank} of {self.name} not found: the input changed between passes")

    @property
    def done(self) -> bool:
        return self.low == self.high


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    spans: dict[str, tuple[int, float, float]],
    probabilities: tuple[float, ...] = (0.25, 0.5, 0.75),
    bins: dict[str, list[tuple[float, float, int]]] | None = None,
    listed: int = LISTED,
) -> dict[str, dict[float, float]]:
    """Linear-interpolated quantiles per column.

    ``spans`` gives (non-null count, min, max) of each column; ``bins``, where already counted, the first histogram as
    ascending (smallest, largest, count) per filled bin.
    """
    names = [c for c in columns if spans[c][0] > 0]
    ranks: dict[tuple[str, int], _Rank] = {}
    for c in names:
        n, low, high = spans[c]
        for p in probabilities:
            for r in _neighbours(p, n):
                ranks.setdefault((c, r), _Rank(c, r, low, high, n))
    if bins:
        for rank in ranks.values():
            rank.descend(bins[rank.name])
    while wide := [r for r in ranks.values() if not r.done and r.inside > listed]:
        _narrow(df, columns, wide)
    if left := [r for r in ranks.values() if not r.done]:
        _pick(df, columns, left)
    result: dict[str, dict[float, float]] = {}
    for c in names:
        n = spans[c][0]
        result[c] = {}
        for p in probabilities:
            a, b = (ranks[(c, r)].low for r in _neighbours(p, n))
            result[c][p] = a + (b - a) * (p * (n - 1) - math.floor(p * (n - 1)))
    return result


def _neighbours(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _cells(df: DataFrame, parts: list[Column]) -> DataFrame:
    return df.select(F.explode(F.array(*parts)).alias("cell")).select("cell.*")


def bin_of(x: Column, low: float, high: float) -> Column:
    """Equal-width bin of a value within [low, high]; halved first so that the width of the range cannot overflow."""
    if low == high:
        return F.when(x.isNotNull(), F.lit(0))
    share = (x * 0.5 - low * 0.5) / (high * 0.5 - low * 0.5)
    return F.least(F.lit(BINS - 1), F.floor(share * BINS).cast("int"))


def _values(df: DataFrame, columns: dict[str, Column], ranges: list[tuple]) -> tuple[DataFrame, dict[str, list[tuple[int, Column]]]]:
    """The columns with open ranges, read once, and per column the numbers of its ranges with the test for each.

    Open ranges of a column do not overlap, so one cell per column and row serves all of them.
    """
    names = list(dict.fromkeys(k[0] for k, _, _ in ranges))
    of = {c: F.col(f"x{j}") for j, c in enumerate(names)}
    tests: dict[str, list] = {c: [] for c in names}
    for i, ((c, low, high), _, _) in enumerate(ranges):
        tests[c].append((i, of[c].between(low, high)))
    return df.select(*[columns[c].alias(f"x{j}") for j, c in enumerate(names)]), {c: tests[c] for c in names}


def _first_of(tests: list[tuple[Column, Column]]) -> Column:
    out = F.when(*tests[0])
    for test, value in tests[1:]:
        out = out.when(test, value)
    return out


def _open_ranges(columns: dict[str, Column], ranks: list[_Rank]) -> list[tuple[tuple, Column, Column]]:
    ranges = sorted({r.range_key for r in ranks})
    return [(k, columns[k[0]], columns[k[0]].between(k[1], k[2])) for k in ranges]


def _narrow(df: DataFrame, columns: dict[str, Column], ranks: list[_Rank]) -> None:
    ranges = _open_ranges(columns, ranks)
    values, tests = _values(df, columns, ranges)
    parts = []
    for j, found in enumerate(tests.values()):
        x = F.col(f"x{j}")
        slots = [(test, F.struct(F.lit(i).alias("k"), bin_of(x, *ranges[i][0][1:]).alias("bin"))) for i, test in found]
        parts.append(F.struct(_first_of(slots).alias("at"), x.alias("x")))
    found = (
        _cells(values, parts)
        .where("at is not null")
        .groupBy(F.col("at.k").alias("k"), F.col("at.bin").alias("bin"))
        .agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .collect()  # at most ranges x BINS rows
    )
    bins: dict[int, list] = {}
    for row in sorted(found, key=lambda r: (r.k, r.bin)):
        bins.setdefault(row.k, []).append(row)
    index = {k: i for i, (k, _, _) in enumerate(ranges)}
    for r in ranks:
        r.descend([(row.low, row.high, row.n) for row in bins[index[r.range_key]]])


def _pick(df: DataFrame, columns: dict[str, Column], ranks: list[_Rank]) -> None:
    ranges = _open_ranges(columns, ranks)
    values, tests = _values(df, columns, ranges)
    parts = [
        F.struct(_first_of([(test, F.lit(i)) for i, test in found]).alias("k"), F.col(f"x{j}").alias("x"))
        for j, found in enumerate(tests.values())
    ]
    found = (
        _cells(values, parts).where("k is not null").groupBy("k", "x").count().collect()
    )  # at most ranges x `listed` rows
    values: dict[int, list] = {}
    for k, x, n in sorted(found):
        values.setdefault(k, []).append((x, n))
    index = {k: i for i, (k, _, _) in enumerate(ranges)}
    for r in ranks:
        seen = r.below
        for x, n in values[index[r.range_key]]:
            seen += n
            if r.rank < seen:
                r.low = r.high = x
                break
