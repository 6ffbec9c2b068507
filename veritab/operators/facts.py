"""One table's measurements.

``TableFacts`` runs each measuring pass at most once, over all columns together, and keeps only column-level results.
Profile, audit, typing, cleaning and advice are rules over these facts.
"""

from __future__ import annotations

import math
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta
from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, functions as F

from ..config import materialise
from ..functions import dates, exprs as E
from .quantiles import bin_of, exact_quantiles
from .values import leading_values, long_cells, text_counts, text_summary

QUARTILES = (0.25, 0.5, 0.75)
TOGETHER = 16  # columns summed up in one scan


@dataclass
class ColumnFacts:
    name: str
    kind: str
    dtype: str
    count: int = 0
    missing: int = 0
    n_numeric: int = 0
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None
    std_population: float | None = None
    variance: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    zeros: int = 0
    negatives: int = 0
    bytes: int = 0
    length: float | None = None
    bad_email: int = 0
    first_time: object = None
    last_time: object = None
    loose: dict = field(default_factory=dict)
    pair: int | None = None

    @property
    def is_numeric(self) -> bool:
        return self.kind in ("number", "text") and self.n_numeric > 0


@dataclass
class ValueFacts:
    distinct: int = 0
    top: int = 0
    bottom: int = 0
    mode: object = None
    normalised: int = 0


def _measures(x: Column, kind: str) -> dict[str, Column]:
    """What is summed up of a column: of numbers everything, of times the ends, of others how many there are."""
    out = {"n": F.count(x)}
    if kind in ("number", "temporal"):
        out |= {"min": F.min(x), "max": F.max(x)}
    if kind in ("number", "boolean"):
        out["zeros"] = F.count_if(x == 0)
    if kind == "number":
        out |= {
            "total": F.sum(x),
            "negatives": F.count_if(x < 0),
            "zero_one": F.count_if(x.isin(0.0, 1.0)),
            "whole": F.count_if(x == F.floor(x)),
        }
    return out


def summed(df: DataFrame, measures: list[tuple[object, dict[str, Column]]]) -> list[tuple[object, dict]]:
    """Aggregates over all rows under a name each, for ``TOGETHER`` entries per scan; nothing is grouped."""
    out = []
    for lo in range(0, len(measures), TOGETHER):
        part = measures[lo : lo + TOGETHER]
        columns = [m.alias(f"m{i}") for i, m in enumerate(m for _, named in part for m in named.values())]
        found = iter(df.agg(*columns).first())
        out += [(key, {name: next(found) for name in named}) for key, named in part]
    return out


def set_moments(f: ColumnFacts, s2: float, s3: float, s4: float) -> None:
    """Sample deviation and bias-corrected skewness and excess kurtosis from central power sums."""
    n = f.n_numeric
    f.std_population = math.sqrt(s2 / n)
    f.variance = s2 / (n - 1) if n > 1 else None
    f.std = math.sqrt(f.variance) if n > 1 else None
    flat = f.std_population <= 1e-14 * max(abs(f.mean), 1e-300)  # rounding noise of a constant column
    m2 = s2 / n
    f.skewness = corrected_skewness(None if flat else (s3 / n) / m2**1.5, n)
    f.kurtosis = corrected_kurtosis(None if flat else (s4 / n) / m2**2 - 3, n)


def _read_cell_facts(f: ColumnFacts, r) -> None:
    f.count = r.n_texts if f.kind == "text" else r.n
    if f.kind in ("number", "text"):
        f.n_numeric, f.min, f.max = r.n, r.min, r.max
        f.mean = r.total / r.n if r.n else None
        f.zeros, f.negatives, f.loose = r.zeros, r.negatives, {"zero_one": r.zero_one, "whole": r.whole}
    if f.kind == "text":
        f.bytes, f.bad_email, f.length = r.bytes, r.bad_email, r.chars / f.count
        f.loose |= {"n": r.n_loose, "min": r.loose_min, "max": r.loose_max, "plain": r.plain, "dates": r.dates}
        if r.n_pair == f.count and r.pair_low == r.pair_high:
            f.pair = r.pair_low
    elif "email" in f.name.lower() and f.kind not in ("other", "mixed"):
        f.bad_email = r.n
    if f.kind == "boolean":
        f.zeros = r.zeros
    if f.kind == "temporal":
        f.first_time, f.last_time = _from_micros(r.min), _from_micros(r.max)


def _from_micros(x: float | None):
    return None if x is None else datetime(1970, 1, 1) + timedelta(microseconds=int(x))


def _temporal_text(instant: str, dtype: str) -> str:
    if dtype == "date":
        return str(date.fromordinal(date(1970, 1, 1).toordinal() + int(instant)))
    return str(datetime(1970, 1, 1) + timedelta(microseconds=int(instant)))


def half_even(x: float | None, digits: int) -> float | None:
    return None if x is None else float(round(x, digits))


def corrected_skewness(population: float | None, n: int) -> float | None:
    if n < 3:
        return None
    return 0.0 if population is None or math.isnan(population) else population * math.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(population: float | None, n: int) -> float | None:
    if n < 4:
        return None
    if population is None or math.isnan(population):
        return 0.0
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * population + 6)


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in floating columns, so that missing is one concept and sums stay finite."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    if not floats:
        return df
    largest = sys.float_info.max
    return df.select(
        *[
            F.when(E.quoted(c).between(-largest, largest), E.quoted(c)).alias(c) if c in floats else E.quoted(c)
            for c in df.columns
        ]
    )


def at_once(facts: "TableFacts", *passes: str) -> None:
    todo = [p for p in passes if p not in facts.__dict__]
    if todo:
        with ThreadPoolExecutor(len(todo)) as pool:
            list(pool.map(lambda p: getattr(facts, p), todo))


class TableFacts:
    def __init__(self, df: DataFrame, order_by: str | None = None):
        self.df = fold_nan(df)
        self.order_by = order_by
        self.spark = df.sparkSession
        self.kinds = {f.name: E.kind_of(f.dataType) for f in df.schema}
        self.dtypes = {f.name: f.dataType.simpleString() for f in df.schema}
        self.names = list(df.columns)
        self._dates: dict[str, tuple[tuple[str, ...], int]] = {}

    def gather(self, *passes: str) -> None:
        """Start independent passes together, so that the short stages of one fill the idle cores of another."""
        at_once(self, "_number_cells", "_text_cells", *(p for p in passes if p == "duplicate_rows"))
        at_once(self, *passes)

    def only(self, names: list[str]) -> "TableFacts":
        """Facts of some of the columns, so that the others are not measured; these facts where they are measured already."""
        if "_text_cells" in self.__dict__ or names == self.names:
            return self
        return TableFacts(self.df.select(*[E.quoted(c) for c in names]), self.order_by)

    def for_same_values(self, df: DataFrame) -> "TableFacts":
        """Facts of a table that holds the same values, at most in other types: nothing is measured again."""
        other = TableFacts(df, self.order_by)
        done = ("_number_cells", "_text_cells", "_scan", "_bins", "quartiles", "outliers", "values", "number_values", "text_values", "text_spread", "_text_summary", "duplicate_rows", "text_counts")
        other.__dict__.update({p: self.__dict__[p] for p in done if p in self.__dict__})
        return other

    # ---------------------------------------------------------------- numbers of the strict reading
    def number(self, name: str) -> Column:
        return E.numeric_value(E.quoted(name), self.kinds[name])

    @cached_property
    def numeric(self) -> list[str]:
        return [c for c in self.names if self.base[c].is_numeric]

    # ---------------------------------------------------------------- pass 1: scalars
    @cached_property
    def _number_cells(self) -> dict[int, object]:
        """One record per column, of texts only how many there are; field -1 says whether the row has a gap.

        Summed where the rows are, column beside column: no cell is made or travels. ``TOGETHER`` bounds the plan, not the columns.
        """
        any_null = F.lit(False)
        for c in self.names:
            any_null = any_null | E.quoted(c).isNull()
        cells = [any_null.cast("double"), *map(self._plain_double, self.names)]
        values = self.df.select(*[x.alias(f"x{i}") for i, x in enumerate(cells, -1)])  # read once, used in many sums
        kinds = ["number", *(self.kinds[c] for c in self.names)]
        out = {}
        measures = [(i, {"rows": F.count(F.lit(1))} | _measures(F.col(f"`x{i}`"), k)) for i, k in enumerate(kinds, -1)]
        for i, found in summed(values, measures):
            out[i] = SimpleNamespace(**found)
        return out if out[-1].rows else {}

    @property
    def _texts(self) -> list[tuple[int, Column]]:
        return [(i, E.quoted(c)) for i, c in enumerate(self.names) if self.kinds[c] == "text"]

    @cached_property
    def _text_cells(self) -> dict[int, object]:
        """One row per text column, summed where the texts are: none travels."""
        if not self._texts:
            return {}
        mail = [i for i, _ in self._texts if "email" in self.names[i].lower()]
        v, number, loose, pair = F.col("value"), F.col("number"), F.col("loose"), F.col("pair")
        parsed = E.readings(long_cells(self.df, self._texts, "value").where("value is not null"), "value").withColumn(
            "bad_email", F.col("field").isin(*mail) & ~v.rlike(E.EMAIL) if mail else F.lit(False)
        )
        found = parsed.groupBy("field").agg(
            F.count(F.lit(1)).alias("n_texts"),
            F.count(number).alias("n"),
            F.sum(number).alias("total"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
            F.count_if(number == 0).alias("zeros"),
            F.count_if(number < 0).alias("negatives"),
            F.count_if(loose.isin(0.0, 1.0)).alias("zero_one"),
            F.count_if(loose == F.floor(loose)).alias("whole"),
            F.count_if("date").alias("dates"),
            F.sum("bytes").alias("bytes"),
            F.sum("chars").alias("chars"),
            F.count(loose).alias("n_loose"),
            F.min(loose).alias("loose_min"),
            F.max(loose).alias("loose_max"),
            F.count(pair).alias("n_pair"),
            F.min(pair).alias("pair_low"),
            F.max(pair).alias("pair_high"),
            F.count_if("plain").alias("plain"),
            F.count_if("bad_email").alias("bad_email"),
        )
        return {r.field: r for r in found.collect()}

    @cached_property
    def text_counts(self) -> DataFrame | None:
        """(field, a, b, fold_a, fold_b, n) per distinct text, by hashes; written once for all that read it."""
        return materialise(text_counts(self.df, self._texts), "text-counts") if self._texts else None

    def leading_texts(self, limit: int) -> dict[int, list[tuple[str, int]]]:
        """The most frequent texts of each text column with their counts; ties go to the smaller text."""
        return leading_values(self.df, self._texts, self.text_counts, limit) if self._texts else {}

    @cached_property
    def _scan(self) -> tuple[int, int, dict[str, ColumnFacts]]:
        at_once(self, "_number_cells", "_text_cells")
        numbers, texts = self._number_cells, self._text_cells
        out = {c: ColumnFacts(c, self.kinds[c], self.dtypes[c]) for c in self.names}
        rows = numbers[-1].rows if -1 in numbers else 0  # no cells at all: an empty table
        for i, c in enumerate(self.names):
            found = texts.get(i) if self.kinds[c] == "text" else numbers.get(i)
            if found is not None:
                _read_cell_facts(out[c], found)
            out[c].missing = rows - out[c].count
            if self.kinds[c] != "text":
                out[c].bytes = {"number": 8, "boolean": 1, "temporal": 8}.get(self.kinds[c], 0) * rows
        return rows, round(numbers[-1].total) if rows else 0, out

    def _plain_double(self, name: str) -> Column:
        c, kind = E.quoted(name), self.kinds[name]
        if kind == "number":
            return c.cast("double")
        if kind == "boolean":
            return c.cast("int").cast("double")
        if kind == "temporal":
            return F.unix_micros(c.cast("timestamp")).cast("double")
        return F.when(c.isNotNull(), F.lit(1.0))

    # ---------------------------------------------------------------- pass 2: moments and histogram
    @cached_property
    def _bins(self) -> dict[str, list]:
        """Histogram per numeric column, and from the same scan the central moments around the known mean."""
        base = self.base
        fields = [(i, c) for i, c in enumerate(self.numeric)]
        if not fields:
            return {}
        values = self.df.select(*[self.number(c).alias(f"x{i}") for i, c in fields])  # read once, used three times
        cells = [
            (
                i,
                F.struct(
                    bin_of(F.col(f"x{i}"), base[c].min, base[c].max).alias("bin"),
                    F.col(f"x{i}").alias("x"),
                    (F.col(f"x{i}") - F.lit(base[c].mean)).alias("d"),
                ),
            )
            for i, c in fields
        ]
        d, x = F.col("cell.d"), F.col("cell.x")
        counted = (
            long_cells(values, cells, "cell")
            .where(x.isNotNull())
            .groupBy("field", "cell.bin")
            .agg(
                F.count(x).alias("n"),
                F.min(x).alias("low"),
                F.max(x).alias("high"),
                F.sum(d * d).alias("s2"),
                F.sum(d * d * d).alias("s3"),
                F.sum(d * d * d * d).alias("s4"),
            )
        )
        bins: dict[str, list] = {c: [] for c in self.numeric}
        for r in counted.collect():  # at most columns x BINS rows
            bins[self.numeric[r.field]].append(r)
        for c, rows in bins.items():
            rows.sort(key=lambda r: r.bin)
            set_moments(base[c], *(math.fsum(getattr(r, s) for r in rows) for s in ("s2", "s3", "s4")))
        return bins

    @property
    def measured(self) -> dict[str, ColumnFacts]:
        """The column facts with deviation, skewness and kurtosis filled in."""
        self._bins
        return self.base

    @property
    def rows(self) -> int:
        return self._number_cells[-1].rows if -1 in self._number_cells else 0  # no cells at all: an empty table

    @property
    def rows_with_missing(self) -> int:
        return round(self._number_cells[-1].total) if self.rows else 0

    @property
    def missing(self) -> dict[str, int]:
        """Gaps per column, without looking at what is in the texts."""
        found = self._number_cells
        return {c: self.rows - found[i].n if i in found else 0 for i, c in enumerate(self.names)}

    def column(self, name: str) -> ColumnFacts:
        """The facts of one column; those of a column that is not text take no look at the texts."""
        i = self.names.index(name)
        if self.kinds[name] == "text" or i not in self._number_cells:
            return self.base[name]
        out = ColumnFacts(name, self.kinds[name], self.dtypes[name])
        _read_cell_facts(out, self._number_cells[i])
        out.missing = self.rows - out.count
        return out

    @property
    def base(self) -> dict[str, ColumnFacts]:
        return self._scan[2]

    # ---------------------------------------------------------------- quartiles and outliers
    @cached_property
    def quartiles(self) -> dict[str, dict[float, float]]:
        spans = {c: (self.base[c].n_numeric, self.base[c].min, self.base[c].max) for c in self.numeric}
        bins = {c: [(r.low, r.high, r.n) for r in rows] for c, rows in self._bins.items()}
        return exact_quantiles(self.df, {c: self.number(c) for c in self.numeric}, spans, QUARTILES, bins)

    @cached_property
    def outliers(self) -> dict[str, dict[str, int]]:
        """Counts per numeric column: ``iqr`` (0 when the IQR is 0), ``iqr_always`` and ``z``."""
        if not self.numeric:
            return {}
        measures = []
        for c in self.numeric:
            f, q, x = self.measured[c], self.quartiles[c], self.number(c)
            spread = q[0.75] - q[0.25]
            low, high = q[0.25] - 1.5 * spread, q[0.75] + 1.5 * spread
            far = F.abs((x - f.mean) / f.std_population) > 3 if f.std_population else F.lit(False)
            measures.append((c, {"box": F.count_if((x < low) | (x > high)), "far": F.count_if(far)}))
        out = {}
        for c, found in summed(self.df, measures):
            flat = self.quartiles[c][0.75] == self.quartiles[c][0.25]
            out[c] = {"iqr": 0 if flat else found["box"], "iqr_always": found["box"], "z": found["far"]}
        return out

    # ---------------------------------------------------------------- duplicates
    @cached_property
    def repeated(self) -> DataFrame:
        """The hashes of rows that occur more than once; written once for all that read it."""
        return materialise(repeated_rows(self.df), "repeated")

    @cached_property
    def duplicate_rows(self) -> int:
        return self.repeated.agg(F.sum(F.col("count") - 1)).first()[0] or 0

    # ---------------------------------------------------------------- dates in texts
    def date_texts(self, names: list[str]) -> dict[str, tuple[tuple[str, ...], int]]:
        """Per text column its date formats and how many of its values they read; a column is looked at once."""
        new = [c for c in names if c not in self._dates]
        found = dates.formats_read(self.df, new)
        # of several formats each may read what another one reads, so their values are counted together
        several = [c for c in new if len(found[c]) > 1]
        cells = [F.count(dates.parse_date(E.quoted(c), tuple(found[c]))).alias(f"n{i}") for i, c in enumerate(several)]
        counted = dict(zip(several, self.df.agg(*cells).first())) if cells else {}
        for c in new:
            self._dates[c] = tuple(found[c]), counted.get(c, sum(found[c].values()))
        return {c: self._dates[c] for c in names}

    # ---------------------------------------------------------------- values
    @cached_property
    def values(self) -> dict[str, ValueFacts]:
        """Distinct count, largest and smallest group, mode (smallest of ties) and case/blank-folded distinct count."""
        at_once(self, "number_values", "text_values")
        found = {c: ValueFacts() for c in self.names} | self.text_values
        for c, v in self.number_values.items():
            # text holding some numbers is profiled by the mode of its numbers
            found[c] = replace(found[c], mode=v.mode) if self.kinds[c] == "text" else v
        return found

    @cached_property
    def number_values(self) -> dict[str, ValueFacts]:
        """The values of columns that are not text, and the mode of the numbers in text."""
        also = [c for c in self.numeric if self.kinds[c] == "text"]
        found = {}
        counted = value_summary(self.df, self.kinds, also)
        for row in counted.collect() if counted is not None else []:  # at most one row per column
            if row.field >= len(self.names):
                found[also[row.field - len(self.names)]] = ValueFacts(mode=float(row.mode))
            else:
                name = self.names[row.field]
                mode = _temporal_text(row.mode, self.dtypes[name]) if self.kinds[name] == "temporal" else row.mode
                found[name] = ValueFacts(row.distinct_n, row.top, row.bottom, mode, row.distinct_n)
        return found

    @cached_property
    def _text_leaders(self) -> dict[int, list[tuple[str, int]]]:
        return self.leading_texts(1)

    @cached_property
    def _text_summary(self) -> list:
        return text_summary(self.text_counts).collect() if self._texts else []  # one row per text column

    @cached_property
    def text_spread(self) -> dict[str, ValueFacts]:
        """What ``values`` tells of text columns but their modes, which take another look at the texts."""
        return {self.names[r.field]: ValueFacts(r.distinct_n, r.top, r.bottom, None, r.normalised) for r in self._text_summary}

    @cached_property
    def spread(self) -> dict[str, ValueFacts]:
        """``values``, but without the modes of texts, unless these are known."""
        if "values" in self.__dict__:
            return self.values
        at_once(self, "number_values", "text_spread")
        numbers = {c: v for c, v in self.number_values.items() if self.kinds[c] != "text"}
        return {c: ValueFacts() for c in self.names} | self.text_spread | numbers

    def distinct_counts(self, names: list[str]) -> dict[str, int]:
        """Distinct values of some columns, without modes."""
        if "values" in self.__dict__:
            return {c: self.values[c].distinct for c in names}
        part = TableFacts(self.df.select(*[E.quoted(c) for c in names]), self.order_by) if names != self.names else self
        counted = value_summary(part.df, part.kinds) if names else None
        found = {part.names[r.field]: r.distinct_n for r in counted.collect()} if counted is not None else {}
        found |= {c: v.distinct for c, v in part.text_spread.items()} if names else {}
        return {c: found.get(c, 0) for c in names}

    @cached_property
    def text_values(self) -> dict[str, ValueFacts]:
        self.text_counts
        at_once(self, "_text_leaders", "_text_summary")
        leaders = self._text_leaders
        return {c: replace(v, mode=leaders[self.names.index(c)][0][0]) for c, v in self.text_spread.items()}


def repeated_rows(df: DataFrame) -> DataFrame:
    """(__x, __y, count) per group of two or more equal rows (NULLs equal).

    Rows are counted by two 64-bit hashes of their values and gaps, so 16 bytes a row travel; map-side combine absorbs hot
    copies.
    """
    first, second = row_hashes(df)
    return df.groupBy(first.alias("__x"), second.alias("__y")).count().where("count > 1")


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row's values and gaps; equal rows have equal ones."""
    floats = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    cells = [(c + F.lit(0.0)).alias(n) if n in floats else c for n, c in zip(df.columns, comparable(df))]  # -0.0 is 0.0
    gaps = [E.quoted(c).isNull() for c in df.columns]
    return F.xxhash64(*gaps, *cells), F.xxhash64(F.lit(1), *cells, *gaps)


def comparable(df: DataFrame) -> list[Column]:
    """Every column in a form that can be grouped: variants and maps as their JSON text."""
    json = {f.name for f in df.schema if f.dataType.typeName() in ("variant", "map")}
    return [F.to_json(E.quoted(c)).alias(c) if c in json else E.quoted(c) for c in df.columns]


def distinct_rows(df: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """One of each group of equal rows. Rows whose hash occurs once stay where they are; only the others are compared.

    ``again`` are the ``repeated_rows`` where they are known already.
    """
    first, second = row_hashes(df)
    hashed = df.withColumns({"__a": first, "__b": second})
    again = (materialise(repeated_rows(df), "repeated") if again is None else again).select("__x", "__y")
    same = (F.col("__a") == F.col("__x")) & (F.col("__b") == F.col("__y"))
    columns = [E.quoted(c) for c in df.columns]
    alone = hashed.join(again, same, "left_anti").select(*columns)
    return alone.unionAll(_compared(hashed.join(again, same, "left_semi").select(*columns)))


def _compared(df: DataFrame) -> DataFrame:
    json = [f.name for f in df.schema if f.dataType.typeName() in ("variant", "map")]
    if not json:
        return df.distinct()
    keyed = df.withColumns({f"__key_{c}": F.to_json(E.quoted(c)) for c in json})
    keys = [c for c in df.columns if c not in json] + [f"__key_{c}" for c in json]
    return keyed.dropDuplicates(keys).select(*[E.quoted(c) for c in df.columns])


# -------------------------------------------------------------------- value counts
def _families(df: DataFrame, kinds: dict[str, str], also_numeric: list[str]) -> dict[str, list[tuple[int, Column]]]:
    """Columns grouped by the widest type that keeps their values apart: long, double or string."""
    fam: dict[str, list[tuple[int, Column]]] = {"bigint": [], "double": [], "string": []}
    for i, field_ in enumerate(df.schema):
        name, kind, c = field_.name, kinds[field_.name], E.quoted(field_.name)
        type_name = field_.dataType.typeName()
        if kind == "number":
            whole = type_name in ("byte", "short", "integer", "long")
            exact = type_name in ("double", "float")
            fam["bigint" if whole else "double" if exact else "string"].append((i, c))
        elif kind == "boolean":
            fam["bigint"].append((i, c.cast("int")))
        elif kind == "temporal":
            fam["bigint"].append((i, E.instant(c, type_name)))
        elif kind == "mixed":
            fam["string"].append((i, c.cast("string")))
    for j, name in enumerate(also_numeric):
        fam["double"].append((len(df.columns) + j, E.to_number(E.quoted(name))))
    return {t: cols for t, cols in fam.items() if cols}


def value_counts(df: DataFrame, columns: list[tuple[int, Column]], type_name: str) -> DataFrame:
    """(field, value, n) for several columns of one type in one shuffle; partial counts absorb hot values."""
    return (
        long_cells(df, [(i, c.cast(type_name)) for i, c in columns], "value")
        .where("value is not null")
        .groupBy("field", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_summary(df: DataFrame, kinds: dict[str, str], also_numeric: list[str] = ()) -> DataFrame | None:
    """One row per column that is not text: distinct_n, top, bottom, mode. Nothing but these rows is collected."""
    out = None
    for type_name, columns in _families(df, kinds, list(also_numeric)).items():
        summary = value_counts(df, columns, type_name).groupBy("field").agg(
            F.count(F.lit(1)).alias("distinct_n"),
            F.max("n").alias("top"),
            F.min("n").alias("bottom"),
            F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("leader"),
        )
        part = summary.select("field", "distinct_n", "top", "bottom", F.col("leader.value").cast("string").alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out
