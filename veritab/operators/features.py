"""Feature diagnostics, correlation, importance and readiness."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import exprs as E
from . import importance
from .analytics import imbalance_label, numeric_columns
from .facts import TableFacts, half_even
from .profile import frame, named, share
from .semantics import NUMERIC_TYPES, Semantic

# --- fixed values -----------------------------------------------------------
TARGET_WORDS = ("target", "label", "class", "outcome", "purchased", "clicked")
READY_WORDS = ("target", "label", "class", "y")
ID_WORDS = ("id", "key", "index", "pk", "fk")
COLLINEAR, LEAKING = 0.80, 0.95
ONE_HOT_LIMIT = 15
CLASS_TARGET_LIMIT = 10
# ----------------------------------------------------------------------------


def target_column(names: list[str]) -> str | None:
    return next((c for c in names if named(c, TARGET_WORDS) or c.lower() == "y"), None)


def is_class_target(facts: TableFacts, c: str) -> bool:
    return facts.kinds[c] in ("text", "boolean") or facts.spread[c].distinct <= CLASS_TARGET_LIMIT


def constant_columns(facts: TableFacts) -> list[str]:
    return [c for c in facts.names if facts.spread[c].distinct <= 1]


def target_balance(facts: TableFacts) -> str:
    c = target_column(facts.names)
    if c is None:
        return "No target detected"
    v = facts.spread[c]
    if not is_class_target(facts, c):
        return "Continuous Target"
    return imbalance_label(v.top, v.bottom, v.distinct) if v.distinct > 1 else "No target detected"


def column_flags(facts: TableFacts) -> dict[str, dict[str, bool]]:
    facts.gather("_bins", "spread")
    constant = set(constant_columns(facts))
    out = {}
    for c in facts.names:
        f, v, text = facts.measured[c], facts.spread[c], facts.kinds[c] == "text"
        live = c not in constant
        if facts.kinds[c] == "number":
            flat = f.std is None or f.std < 0.01
        else:
            flat = v.top / max(f.count, 1) > 0.98
        out[c] = {
            "is_constant": not live,
            "is_identifier": live and (named(c, ID_WORDS) or (text and v.distinct == facts.rows)),
            "is_near_zero_variance": live and flat,
            "is_high_cardinality": text and (v.distinct > 30 or share(v.distinct, facts.rows) > 0.20),
        }
    return out


def feature_flags(facts: TableFacts) -> DataFrame:
    target = target_column(facts.names)
    rows = [(c, *flags.values(), c == target) for c, flags in column_flags(facts).items()]
    return frame(
        facts,
        "column string, is_constant boolean, is_identifier boolean, is_near_zero_variance boolean, "
        "is_high_cardinality boolean, is_target boolean",
        rows,
    )


# -------------------------------------------------------------------- correlation
def _columns_for(facts: TableFacts, loose: bool) -> dict[str, Column]:
    if not loose:
        return {c: E.quoted(c).cast("double") for c in numeric_columns(facts)}
    return {
        c: E.to_number_loose(E.quoted(c)) if facts.kinds[c] == "text" else E.quoted(c).cast("double")
        for c in facts.numeric
    }


PAIR_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def _pair_sums(batches):
    """Sums over the rows where both columns of a pair are present, as matrix products; one set of rows per task."""
    import numpy as np
    import pyarrow as pa

    total = None
    for batch in batches:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        here = ~np.isnan(x)
        x, here = np.where(here, x, 0.0), here.astype(float)
        part = np.stack([here.T @ here, x.T @ here, here.T @ x, (x * x).T @ here, here.T @ (x * x), x.T @ x])
        total = part if total is None else total + part
    if total is not None:
        i, j = np.triu_indices(total.shape[1], 1)
        cells = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(m[i, j]) for m in total]]
        yield pa.RecordBatch.from_arrays(cells, names=["i", "j", *PAIR_SUMS])


def correlations(facts: TableFacts, loose: bool = False, only: str | None = None) -> dict[tuple[str, str], float | None]:
    """Pearson's r per pair, over the rows where both values are present; with ``only``, for the pairs of that column.

    One scan whatever the number of columns: values are centred on the known means, each task multiplies its batches into
    matrices of sums, and those are added up pair by pair.
    """
    columns = _columns_for(facts, loose)
    pairs = [p for p in combinations(columns, 2) if only is None or only in p]
    if not pairs:
        return {}
    centred = facts.df.select(*[(x - F.lit(facts.base[c].mean or 0.0)).alias(f"d{i}") for i, (c, x) in enumerate(columns.items())])
    sums = centred.mapInArrow(_pair_sums, "i int, j int, " + ", ".join(f"{s} double" for s in PAIR_SUMS))
    at = {c: i for i, c in enumerate(columns)}
    if only is not None:
        sums = sums.where((F.col("i") == at[only]) | (F.col("j") == at[only]))
    found = {(r.i, r.j): r for r in sums.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in PAIR_SUMS]).collect()}
    out: dict[tuple[str, str], float | None] = {}
    for a, b in pairs:
        r = found.get((at[a], at[b]))
        out[(a, b)] = None
        if r is not None and r.n > 1:
            vx, vy = r.xx - r.x * r.x / r.n, r.yy - r.y * r.y / r.n
            flat = vx <= 1e-12 * r.xx or vy <= 1e-12 * r.yy  # rounding noise of a constant column
            if vx > 0 and vy > 0 and not flat:
                out[(a, b)] = _bounded((r.xy - r.x * r.y / r.n) / (vx * vy) ** 0.5)
    return out


def _bounded(r: float) -> float:
    return max(-1.0, min(1.0, r))


def correlation_pairs(facts: TableFacts) -> DataFrame:
    """Every pair of numeric columns with r, and whether it is collinear."""
    rows = [(a, b, r, r is not None and abs(r) > COLLINEAR) for (a, b), r in correlations(facts).items()]
    return frame(facts, "feature_a string, feature_b string, correlation double, collinear boolean", rows)


def collinear_columns(facts: TableFacts) -> list[str]:
    hit = {c for pair, r in correlations(facts).items() if r is not None and abs(r) > COLLINEAR for c in pair}
    return [c for c in facts.names if c in hit]


def leakage(facts: TableFacts) -> DataFrame:
    """Numeric columns that all but repeat the numeric target."""
    target = target_column(facts.names)
    rows = []
    if target is not None:
        for pair, r in correlations(facts, only=target).items():
            if r is not None and abs(r) > LEAKING:
                rows.append((pair[0] if pair[1] == target else pair[1], target, r))
    return frame(facts, "column string, target string, correlation double", rows)


def target_summary(facts: TableFacts) -> DataFrame:
    return frame(facts, "target string, balance string", [(target_column(facts.names), target_balance(facts))])


# -------------------------------------------------------------------- importance
def feature_importance(facts: TableFacts, target: str) -> DataFrame:
    """Importances above 0.01 from a depth-4 tree.

    Classes (text, flags, few values) are split exactly, over all values; texts are numbered in the order of their first
    appearance; a gap in the target is a class of its own. A continuous target goes to Spark ML's tree, which bins.
    """
    schema = "feature string, importance double"
    y = E.quoted(target)
    if facts.spread[target].distinct <= 1:
        return frame(facts, schema, [])
    inputs = [c for c in facts.names if c != target and facts.kinds[c] in ("number", "text", "boolean", "temporal")]
    if is_class_target(facts, target):
        rows = importance.encoded(facts, inputs, F.coalesce(y.cast("string"), F.lit("")))
        shares = importance.class_importances(rows, len(inputs))
    else:
        rows = importance.encoded(facts, inputs, F.coalesce(y.cast("double"), F.lit(facts.quartiles[target][0.5])))
        shares = _regression_importances(rows, len(inputs))
    found = [(inputs[i], half_even(v, 3)) for i, v in shares.items() if v > 0.01]
    return frame(facts, schema, sorted(found, key=lambda r: (-r[1], r[0])))


def _regression_importances(rows: DataFrame, features: int) -> dict[int, float]:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    data = VectorAssembler(inputCols=[f"x{i}" for i in range(features)], outputCol="features").transform(rows)
    model = DecisionTreeRegressor(featuresCol="features", labelCol="label", maxDepth=importance.DEPTH, seed=42).fit(data.select("features", "label"))
    return {i: float(v) for i, v in enumerate(model.featureImportances.toArray())}


# -------------------------------------------------------------------- suggestions and readiness
def suggest_features(facts: TableFacts, semantics: dict[str, Semantic]) -> list[tuple[str, str, str | None, str]]:
    out = []
    for c in facts.names:
        s, distinct = semantics[c], facts.spread[c].distinct
        if distinct <= 1:
            out.append(("drop_column", c, None, "Constant column adds no predictive value."))
        elif s.type == "Identifier":
            out.append(("drop_column", c, None, "An identifier leaks row identity and does not generalise."))
        elif s.type == "DateTime":
            out.append(("create_feature", c, None, "Extract year/month/day/weekday from the dates."))
        elif s.type == "High Cardinality Categorical":
            out.append(("encoding", c, "hash_or_target", "Too many categories for one-hot encoding."))
        elif s.type == "Categorical" and distinct <= ONE_HOT_LIMIT:
            out.append(("encoding", c, "one_hot", "Low-cardinality categorical feature."))
        elif s.type == "Categorical":
            out.append(("encoding", c, "target_or_frequency", "Categorical feature with high cardinality."))
        elif s.type in NUMERIC_TYPES:
            out.append(("scaling", c, "standard_scaler", "Scaling steadies the optimisers of many models."))
    return out


def feature_suggestions(facts: TableFacts, semantics: dict[str, Semantic]) -> DataFrame:
    return frame(facts, "type string, column string, method string, reason string", suggest_features(facts, semantics))


def readiness(facts: TableFacts, semantics: dict[str, Semantic] | None) -> dict:
    """Score and the kinds of task the table is ready for; ``semantics`` None reads numbers strictly."""
    missing = sum(f.missing for f in facts.base.values())
    has_target = any(named(c, READY_WORDS) for c in facts.names)
    kinds = semantics or {}
    drops = [s for s in suggest_features(facts, kinds) if s[0] == "drop_column"] if kinds else []
    points = (25 if has_target else 10) + max(0, 35 - min(20, len(drops)))
    points += int(40 - min(40, missing / max(facts.rows, 1)))
    if kinds:
        dense = any(kinds[c].is_numeric and facts.base[c].count > 0.8 * facts.rows for c in facts.names)
    else:
        dense = any(facts.base[c].n_numeric > 0.8 * facts.rows for c in facts.numeric)
    return {
        "score": max(0, min(100, points)),
        "classification": has_target,
        "regression": dense,
        "time_series": any(named(c, ("date", "time")) for c in facts.names),
    }


def ml_readiness(facts: TableFacts, semantics: dict[str, Semantic] | None) -> DataFrame:
    row = tuple(readiness(facts, semantics).values())
    return frame(facts, "score int, classification boolean, regression boolean, time_series boolean", [row])
