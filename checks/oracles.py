"""DuckDB counterparts of the queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

from veritab.functions import questions as Q, text as X
from veritab.operators import advice, conversation as C

from . import inputs as I
from .queries import SITUATION

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
EMAIL = r"^[\w\.-]+@[\w\.-]+\.[a-zA-Z]{2,}$"

# (name, kind, type) of every column
ORDERS = [
    ("o_orderkey", "number", "bigint"), ("o_custkey", "number", "bigint"), ("o_totalprice", "number", "double"),
    ("o_orderpriority", "text", "string"), ("order_date", "text", "string"), ("is_final", "text", "string"),
    ("price_text", "text", "string"), ("email", "text", "string"), ("age", "number", "int"),
    ("class_label", "text", "string"),
]
LINEITEM = [
    ("l_orderkey", "number", "bigint"), ("l_partkey", "number", "bigint"), ("l_suppkey", "number", "bigint"),
    ("l_linenumber", "number", "int"), ("l_quantity", "number", "double"), ("l_extendedprice", "number", "double"),
    ("l_discount", "number", "double"), ("l_tax", "number", "double"), ("l_returnflag", "text", "string"),
    ("l_linestatus", "text", "string"), ("l_shipdate", "temporal", "timestamp_ntz"),
]
PART = [
    ("p_partkey", "number", "bigint"), ("p_name", "text", "string"), ("p_brand", "text", "string"),
    ("p_type", "text", "string"), ("p_size", "number", "int"), ("p_retailprice", "number", "double"),
]
EVENTS = [
    ("event_id", "number", "bigint"), ("ts", "temporal", "timestamp_ntz"), ("user_id", "number", "bigint"),
    ("event_type", "text", "string"), ("value", "number", "double"), ("props", "text", "string"),
]
DOCUMENTS = [
    ("doc_id", "number", "bigint"), ("text", "text", "string"), ("lang", "text", "string"),
    ("source", "text", "string"), ("n_chars", "number", "bigint"),
]
D = "d"  # name of the common table expression of the dirty orders


def with_orders(body: str) -> str:
    return f"WITH d AS MATERIALIZED ({I.for_duckdb(I.DIRTY_ORDERS)}) {body}"


def lit(s) -> str:
    return "NULL" if s is None else "'" + str(s).replace("'", "''") + "'"


def num(c: str, kind: str) -> str | None:
    if kind == "number":
        return f"CAST({c} AS DOUBLE)"
    if kind == "text":
        return f"(CASE WHEN regexp_matches({c}, '{NUMBER}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"
    return None


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def tables():
    return (("d", ORDERS, "dirty_orders"), ("lineitem", LINEITEM, "lineitem"))


def missing(c: str) -> str:
    return f"(count(*) - count({c}))"


def quartile(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


# -------------------------------------------------------------------- profile
def skew(x: str) -> str:
    return f"CASE WHEN count({x}) >= 3 THEN coalesce(skewness({x}), 0.0) END"


def profile_columns() -> str:
    parts = []
    for t, cols, source in tables():
        for i, (c, kind, dtype) in enumerate(cols):
            x = num(c, kind)
            numeric = x is not None
            is_num = f"count({x}) > 0" if numeric else "false"

            def when(e):
                return f"CASE WHEN {is_num} THEN {e} END" if numeric else "CAST(NULL AS DOUBLE)"

            mode_n = f"(SELECT x FROM (SELECT {x} AS x, count(*) AS n FROM {t} GROUP BY 1) WHERE x IS NOT NULL ORDER BY n DESC, x LIMIT 1)"
            mode_t = f"(SELECT CAST(x AS VARCHAR) FROM (SELECT {c} AS x, count(*) AS n FROM {t} GROUP BY 1) WHERE x IS NOT NULL ORDER BY n DESC, x LIMIT 1)"
            parts.append(
                f"SELECT {lit(source)} AS source, CAST({i} AS INTEGER) AS ordinal, {lit(c)} AS \"column\", {lit(dtype)} AS dtype, "
                f"CAST({missing(c)} AS BIGINT) AS missing_count, CAST(printf('%.4f', CAST(100.0 AS DOUBLE) * {missing(c)} / count(*)) AS DOUBLE) AS missing_pct, "
                f"count(DISTINCT {c}) AS unique_values, CAST(printf('%.4f', CAST(count(DISTINCT {c}) AS DOUBLE) / count(*)) AS DOUBLE) AS cardinality, "
                f"round({when(f'min({x})')}, 4) AS min, round({when(f'max({x})')}, 4) AS max, round({when(f'avg({x})')}, 4) AS mean, "
                f"round({when(quartile(x, 0.5))}, 4) AS median, {when(mode_n)} AS mode_number, "
                f"{f'CASE WHEN {is_num} THEN NULL ELSE {mode_t} END' if numeric else mode_t} AS mode_text, "
                f"round({when(f'stddev_samp({x})')}, 3) AS std, round({when(skew(x)) if numeric else 'CAST(NULL AS DOUBLE)'}, 5) AS skewness FROM {t}"
            )
    return with_orders(union(parts))


def profile_summary() -> str:
    parts = []
    for t, cols, source in tables():
        size = " + ".join(
            f"coalesce(sum(strlen({c})), 0)" if kind == "text" else "8 * count(*)" for c, kind, _ in cols
        )
        parts.append(
            f"SELECT {lit(source)} AS source, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns, CAST({size} AS BIGINT) AS data_bytes FROM {t}"
        )
    return with_orders(union(parts))


def role_parts(t: str, cols) -> list[str]:
    parts = []
    for c, kind, _ in cols:
        x = num(c, kind)
        if x is not None:
            parts.append(f"SELECT 'numerical' AS role, {lit(c)} AS \"column\" FROM {t} HAVING count({x}) > 0")
        if kind == "text":
            parts.append(f"SELECT 'categorical', {lit(c)} FROM {t} HAVING count(DISTINCT {c}) <= 50")
            parts.append(f"SELECT 'text', {lit(c)} FROM {t} HAVING avg(coalesce(length({c}), 3)) > 35")
        if "date" in c or "time" in c:
            parts.append(f"SELECT 'date', {lit(c)}")
    return parts


def profile_roles() -> str:
    return with_orders(union(role_parts("d", ORDERS)))


def role_counts() -> str:
    return with_orders(f"SELECT role, count(*) AS columns FROM ({union(role_parts('d', ORDERS))}) GROUP BY role")


def column_roles() -> str:
    parts = []
    for t, cols, source in tables():
        for c, kind, _ in cols:
            rules = [
                (c.endswith("_id") or c in ("id", "uuid", "customer_id", "user_id"), "identifier", 0.95),
                (any(w in c for w in ("target", "label", "class", "outcome", "y")), "target_candidate", 0.83),
                (kind == "temporal" or "date" in c or "time" in c, "time_feature", 0.88),
            ]
            fixed = next(((r, p) for hit, r, p in rules if hit), None)
            head = f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", "
            if fixed:
                parts.append(f"{head}{lit(fixed[0])} AS role, CAST({fixed[1]} AS DOUBLE) AS confidence")
                continue
            unique = f"count(DISTINCT {c}) > 0.95 * count(*) AND count(DISTINCT {c}) > 100"
            text = f"avg(coalesce(length({c}), 3)) > 35" if kind == "text" else "false"
            parts.append(
                f"{head}CASE WHEN {unique} THEN 'likely_leakage_or_identifier' WHEN {text} THEN 'text_feature' ELSE 'ml_feature_candidate' END, "
                f"CAST(CASE WHEN {unique} THEN 0.72 WHEN {text} THEN 0.78 ELSE 0.7 END AS DOUBLE) FROM {t}"
            )
    return with_orders(union(parts))


# -------------------------------------------------------------------- audit
def missing_by_column() -> str:
    return with_orders(union([f"SELECT {lit(c)} AS \"column\", CAST({missing(c)} AS BIGINT) AS missing FROM d" for c, _, _ in ORDERS]))


def duplicates(t: str, cols) -> str:
    names = ", ".join(c for c, _, _ in cols)
    return f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT {names} FROM {t}))"


def missing_and_duplicates() -> str:
    parts = []
    for t, cols, source in tables():
        gap = " OR ".join(f"{c} IS NULL" for c, _, _ in cols)
        parts.append(
            f"SELECT {lit(source)} AS source, count(*) FILTER (WHERE {gap}) AS rows_with_missing, "
            f"CAST({duplicates(t, cols)} AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS near_duplicates FROM {t}"
        )
    return with_orders(union(parts))


def numeric_columns(cols):
    """No text column of these inputs holds a plain number, so the numeric ones are known by type."""
    return [c for c, kind, _ in cols if kind == "number"]


def iqr_count(t: str, x: str, always: bool = False) -> str:
    q = f"(SELECT {quartile(x, 0.25)} AS a, {quartile(x, 0.75)} AS b FROM {t})"
    guard = "" if always else "b > a AND "
    return f"(SELECT count(*) FROM {t}, {q} WHERE {guard}({x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)))"


def outlier_counts() -> str:
    parts = []
    for t, cols, source in tables():
        for c in numeric_columns(cols):
            z = f"(SELECT count(*) FROM {t}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {t}) WHERE s > 0 AND abs(({c} - m) / s) > 3)"
            parts.append(
                f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", {iqr_count(t, c)} AS iqr_outliers, {z} AS z_outliers"
            )
    return with_orders(union(parts))


NEGATIVE_AGE = "SELECT 'age' AS \"column\", 'age_cannot_be_negative' AS rule, count(*) AS count FROM d WHERE age < 0 HAVING count(*) > 0"
BAD_EMAIL = (
    "SELECT 'email', 'invalid_email_pattern', count(*) FROM d "
    f"WHERE email IS NOT NULL AND NOT regexp_matches(email, '{EMAIL}') HAVING count(*) > 0"
)


def invalid_entries() -> str:
    return with_orders(f"{NEGATIVE_AGE} UNION ALL {BAD_EMAIL}")


def format_rows(t: str = "d", cols=ORDERS) -> str:
    return union(
        [
            f"SELECT {lit(c)} AS \"column\", count(DISTINCT {c}) AS raw_unique, count(DISTINCT lower(trim({c}))) AS normalized_unique FROM {t} "
            f"HAVING count(DISTINCT {c}) <> count(DISTINCT lower(trim({c})))"
            for c, kind, _ in cols
            if kind == "text"
        ]
    )


def inconsistent_formatting() -> str:
    return with_orders(
        f"SELECT \"column\", 'case_or_whitespace_inconsistency' AS issue, raw_unique, normalized_unique FROM ({format_rows()})"
    )


CLASS_COUNTS = "(SELECT class_label AS class, count(*) AS n FROM d WHERE class_label IS NOT NULL GROUP BY 1)"


def class_imbalance() -> str:
    ratio = "CAST(max(n) AS DOUBLE) / greatest(min(n), 1)"
    return with_orders(
        f"SELECT 'class_label' AS target, round({ratio}, 6) AS ratio, {ratio} > 3 AS imbalanced, count(*) AS classes FROM {CLASS_COUNTS} HAVING count(*) > 1"
    )


def class_distribution() -> str:
    return with_orders(f"SELECT class, n AS count FROM {CLASS_COUNTS}")


def severity(impact: str) -> str:
    return f"CASE WHEN {impact} >= 70 THEN 'High' WHEN {impact} >= 30 THEN 'Medium' ELSE 'Low' END"


def issue_rows() -> str:
    parts = []
    n_rows = "(SELECT count(*) FROM d)"

    def add(order, column, issue, sev, metric, rows, reason, advice_, source):
        parts.append(
            f"SELECT {order} AS o, {column} AS \"column\", {issue} AS issue, {sev} AS severity, {metric} AS metric_value, "
            f"CAST({rows} AS BIGINT) AS affected_rows, {reason} AS reason, {lit(advice_)} AS recommendation FROM {source}"
        )

    for i, (c, _, _) in enumerate(ORDERS):
        add(
            100 + i, lit(c), "'Missing Values'", severity("100.0 * n / r * 2"), "n || ' missing values'", "n",
            "n || ' of ' || r || ' cells are empty (' || printf('%.1f', 100.0 * n / r) || '%).'",
            "Fill the gaps; leave the column out if little is left.", f"(SELECT {missing(c)} AS n, count(*) AS r FROM d) WHERE n > 0",
        )
    for i, c in enumerate(numeric_columns(ORDERS)):
        add(
            200 + i, lit(c), "'Outliers Detected'", severity("100.0 * n / r * 5"), "n || ' outliers (IQR)'", "n",
            "n || ' values lie more than 1.5 IQR beyond the quartiles.'", "Compare with the source and clip what is wrong.",
            f"(SELECT {iqr_count('d', c)} AS n, {n_rows} AS r) WHERE n > 0",
        )
    order = "CASE \"column\" " + " ".join(f"WHEN {lit(c)} THEN {300 + i}" for i, (c, _, _) in enumerate(ORDERS)) + " END"
    add(
        order, '"column"', "'Inconsistent Formatting'", "'Medium'", "'Casing/whitespace issues'", "0",
        "raw_unique || ' spellings; ' || normalized_unique || ' without case and outer blanks.'",
        "Write each value in one way.", f"({format_rows()})",
    )
    add(
        400, "'age'", "'Age Cannot Be Negative'", "'High'", "count || ' invalid values'", "count",
        "count || ' values break the rule ' || rule || '.'", "Correct these values or empty them.", f"({NEGATIVE_AGE})",
    )
    add(
        401, "'email'", "'Invalid Email Pattern'", "'High'", "n || ' invalid values'", "n",
        "n || ' values break the rule invalid_email_pattern.'", "Correct these values or empty them.",
        f"(SELECT count(*) AS n FROM d WHERE NOT regexp_matches(email, '{EMAIL}')) WHERE n > 0",
    )
    add(
        500, "'All Columns'", "'Duplicate Rows'", severity("100.0 * n / r * 3"), "n || ' duplicate rows'", "n",
        "n || ' of ' || r || ' rows repeat an earlier one (' || printf('%.1f', 100.0 * n / r) || '%).'", "Keep one row of each.",
        f"(SELECT {duplicates('d', ORDERS)} AS n, {n_rows} AS r) WHERE n > 0",
    )
    for i, (c, kind, _) in enumerate(ORDERS):
        if kind == "text":
            add(
                600 + i, lit(c), "'High Cardinality'", "'Low'", "n || ' unique values'", "n",
                "n || ' different values in ' || r || ' rows.'", "Treat the column as text, or group its rare values.",
                f"(SELECT count(DISTINCT {c}) AS n, count(*) AS r FROM d) WHERE n > 15",
            )
    return union(parts)


def issues() -> str:
    return with_orders(
        "SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, \"column\", issue, severity, metric_value, "
        f"affected_rows, reason, recommendation FROM ({issue_rows()})"
    )


def health_inputs(t: str = "d", cols=ORDERS) -> str:
    gaps = " + ".join(missing(c) for c, _, _ in cols)
    out = " + ".join(iqr_count(t, c) for c in numeric_columns(cols))
    wide = " + ".join(f"CAST(count(DISTINCT {c}) > 15 AS INTEGER)" for c, kind, _ in cols if kind == "text")
    rules = f"{NEGATIVE_AGE} UNION ALL {BAD_EMAIL}".replace("FROM d ", f"FROM {t} ")
    bad = f"(SELECT count(DISTINCT \"column\") FROM (SELECT \"column\" FROM ({rules}) UNION ALL SELECT \"column\" FROM ({format_rows(t, cols)})))"
    # there is an issue wherever one of the five deductions has anything to count
    return (
        f"SELECT *, CAST(m > 0 OR du > 0 OR n_out > 0 OR hc > 0 OR inv > 0 AS INTEGER) AS n_issues FROM ("
        f"SELECT 100.0 * ({gaps}) / (count(*) * {len(cols)}) AS m, 100.0 * ({duplicates(t, cols)}) / count(*) AS du, "
        f"100.0 * ({out}) / (count(*) * {len(numeric_columns(cols))}) AS ou, ({out}) AS n_out, {wide} AS hc, {bad} AS inv, "
        f"(SELECT count(*) FROM ({format_rows(t, cols)})) AS fmt FROM {t})"
    )


SCORE = (
    "least(greatest(0, least(100, round_even(100 - least(40, m * 0.6) - least(20, du * 2) - least(15, ou * 0.5) "
    "- least(10, hc * 2.0) - least(15, inv * 3.0), 0))), CASE WHEN n_issues > 0 THEN 99 ELSE 100 END)"
)


def health_score() -> str:
    from veritab.operators.audit import SUGGESTIONS as S

    tips = ", ".join(
        f"CASE WHEN {cond} THEN {lit(S[k])} END"
        for k, cond in (
            ("missing", "m > 5"), ("duplicates", "du > 0"), ("outliers", "ou > 5"), ("cardinality", "hc > 0"), ("invalid", "inv > 0"),
        )
    )

    def left(cap, lost):
        return f"CAST(greatest(0, {cap} - least({cap}, trunc({lost}))) AS INTEGER)"

    return with_orders(
        f"SELECT CAST({SCORE} AS INTEGER) AS score, CASE WHEN {SCORE} >= 90 THEN 'Excellent' WHEN {SCORE} >= 75 THEN 'Good' "
        f"WHEN {SCORE} >= 60 THEN 'Fair' WHEN {SCORE} >= 40 THEN 'Poor' ELSE 'Critical' END AS band, "
        f"{left(40, 'm * 0.6')} AS missing_values, {left(20, 'du * 2')} AS duplicates, {left(15, 'ou * 0.5')} AS outliers, "
        f"{left(10, 'hc * 2')} AS consistency, {left(15, 'inv * 3')} AS integrity, concat_ws(' ', {tips}) AS suggestions FROM ({health_inputs()})"
    )


def health_explanation() -> str:
    nl = "chr(10)"
    items = ", ".join(
        [
            "CASE WHEN m > 1 THEN '* ' || printf('%.1f', m) || '% of the cells are empty' END",
            "CASE WHEN du > 1 THEN '* ' || printf('%.1f', du) || '% of the rows are repeats' END",
            "CASE WHEN hc > 0 THEN '* text columns with many values: ' || hc END",
            "CASE WHEN n_out > 0 THEN '* values far from the others: ' || n_out END",
            "CASE WHEN fmt > 0 THEN '* columns with several spellings of a value: ' || fmt END",
        ]
    )
    effort = f"CASE WHEN {SCORE} >= 90 THEN 'Low' WHEN {SCORE} >= 70 THEN 'Medium' ELSE 'High' END"
    return with_orders(
        f"SELECT CAST({SCORE} AS INTEGER) AS score, {effort} AS effort, 'This table scores ' || CAST({SCORE} AS INTEGER) || ' of 100.' || {nl} || "
        f"concat_ws({nl}, {items}) || {nl} || 'Work to expect: ' || lower({effort}) AS explanation "
        f"FROM ({health_inputs()})"
    )


# -------------------------------------------------------------------- semantic types
ID_SUFFIXES = (
    "id", "customer_id", "invoice_no", "invoiceno", "order_id", "orderid", "uuid", "key", "employee_id", "employeeno",
)
TEMPORAL_WORDS = ("date", "time", "year", "joined", "dob", "created", "updated", "month", "day", "hour")
CONTINUOUS_WORDS = (
    "revenue", "income", "salary", "price", "cost", "amount", "spent", "temperature", "rate", "pct", "percent",
)


def loose(c: str) -> str:
    return f"(CASE WHEN regexp_matches(trim(translate({c}, ',$%', '')), '{NUMBER}') THEN TRY_CAST(trim(translate({c}, ',$%', '')) AS DOUBLE) END)"


def semantic_case(t: str, order: str, c: str, kind: str) -> tuple[str, str]:
    """(type, confidence) as scalar SQL; all values decide."""
    head = f"(SELECT {c} AS v FROM {t} WHERE {c} IS NOT NULL)"
    n, rows, dist = f"(SELECT count({c}) FROM {t})", f"(SELECT count(*) FROM {t})", f"(SELECT count(DISTINCT {c}) FROM {t})"
    rules = [(f"{n} = 0", "Unknown", 0.0)]
    measure = any(w in c for w in CONTINUOUS_WORDS)

    def numeric_rules(value_of_v: str):
        part = f"(SELECT bool_or(x <> floor(x)) FROM (SELECT {value_of_v} AS x FROM {head}))"
        yield part, "Continuous Numeric", 0.90
        yield ("true", "Continuous Numeric", 0.90) if measure else ("true", "Discrete Numeric", 0.92)

    named_id = c.endswith(ID_SUFFIXES)
    if kind == "number":
        if named_id:
            rules.append((f"{dist} >= 0.8 * {n}", "Identifier", 0.98))
        zero_one = f"(SELECT min({c}) = 0 AND max({c}) = 1 AND count(DISTINCT {c}) = 2 FROM {t})"
        rules.append((zero_one, "Boolean", 0.96))
        rules += numeric_rules("v")
    elif kind == "temporal":
        rules.append(("true", "DateTime", 0.99))
    else:
        coerced = f"(SELECT count({loose(c)}) > 0.8 * count({c}) FROM {t})"
        rules += [(f"{coerced} AND {cond}", ty, p) for cond, ty, p in numeric_rules(loose("v"))]
        if named_id:
            rules.append((f"{dist} >= 0.8 * {n}", "Identifier", 0.98))
        if any(w in c for w in TEMPORAL_WORDS):
            # the dates of these inputs are written year-month-day
            rules.append((f"(SELECT count(try_strptime({c}, '%Y-%m-%d')) > 0.8 * count({c}) FROM {t})", "DateTime", 0.95))
        pairs = " OR ".join(
            f"bool_and(lower(trim({c})) IN ({lit(a)}, {lit(b)}))"
            for a, b in (("true", "false"), ("yes", "no"), ("y", "n"), ("1", "0"), ("1.0", "0.0"), ("t", "f"))
        )
        rules.append((f"{dist} = 2 AND (SELECT {pairs} FROM {t})", "Boolean", 0.96))
        rules.append((f"(SELECT avg(length({c})) > 35 FROM {t})", "Free Text", 0.88))
        rules.append((f"{dist} > 10 AND {dist} > 0.5 * {rows}", "High Cardinality Categorical", 0.85))
        rules.append(("true", "Categorical", 0.90))
    kind_sql = "CASE " + " ".join(f"WHEN {cond} THEN {lit(ty)}" for cond, ty, _ in rules) + " END"
    conf_sql = "CASE " + " ".join(f"WHEN {cond} THEN {p}" for cond, _, p in rules) + " END"
    return kind_sql, conf_sql


def semantic_types() -> str:
    parts = []
    for t, order, cols, source in (
        ("d", "o_orderkey", ORDERS, "dirty_orders"), ("lineitem", "l_orderkey", LINEITEM, "lineitem"),
        ("events", "event_id", EVENTS, "events"), ("documents", "doc_id", DOCUMENTS, "documents"),
    ):
        for c, kind, _ in cols:
            ty, conf = semantic_case(t, order, c, kind)
            parts.append(f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", {ty} AS type, CAST({conf} AS DOUBLE) AS confidence")
    return with_orders(union(parts))


# -------------------------------------------------------------------- cleaning
CONTINUOUS, DISCRETE = ("o_totalprice", "price_text"), ("o_custkey", "age")
STRIPPED = ("o_orderpriority", "email", "class_label")
TRUE_WORDS = "('true', 'yes', 'y', 't', '1', '1.0')"


def mode_of(t: str, c: str) -> str:
    return f"(SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def clean_steps(remove: bool) -> tuple[str, str]:
    """Common table expressions, one group per column in order, and the name of the last one.

    a: as its type reads it; b: gaps filled; k: outlier bounds; c: outliers treated.
    """
    steps, prev = ["dd AS MATERIALIZED (SELECT DISTINCT * FROM d)"], "dd"
    for i, (c, kind, _) in enumerate(ORDERS):
        a, b, k, o = (f"{x}{i}" for x in "abko")
        if c in CONTINUOUS + DISCRETE:
            x = loose(c) if kind == "text" else f"CAST({c} AS DOUBLE)"
            fill = (
                f"round_even({quartile(c, 0.5)}, 0)"
                if c in DISCRETE
                else f"CASE WHEN abs(skewness({c})) > 1.5 THEN {quartile(c, 0.5)} ELSE avg({c}) END"
            )
            iqr = f"(abs(skewness({c})) > 1.5)"
            q1, q3 = quartile(c, 0.25), quartile(c, 0.75)
            steps += [
                f"{a} AS MATERIALIZED (SELECT * REPLACE ({x} AS {c}) FROM {prev})",
                f"{b} AS MATERIALIZED (SELECT * REPLACE (coalesce({c}, (SELECT {fill} FROM {a})) AS {c}) FROM {a})",
                f"{k} AS MATERIALIZED (SELECT {iqr} AS is_iqr, CASE WHEN {iqr} THEN {q1} - 1.5 * ({q3} - {q1}) ELSE avg({c}) - 3 * stddev_samp({c}) END AS lo, "
                f"CASE WHEN {iqr} THEN {q3} + 1.5 * ({q3} - {q1}) ELSE avg({c}) + 3 * stddev_samp({c}) END AS hi FROM {b})",
            ]
            treated = f"CASE WHEN lo < hi THEN greatest(lo, least(hi, {c})) ELSE {c} END"
            whole = "CAST(round_even({}, 0) AS BIGINT)" if c in DISCRETE else "{}"
            if remove:
                steps.append(
                    f"{o} AS MATERIALIZED (SELECT {b}.* REPLACE ({whole.format(c)} AS {c}) FROM {b}, {k} WHERE NOT (lo < hi AND ({c} < lo OR {c} > hi)))"
                )
            else:
                steps.append(f"{o} AS MATERIALIZED (SELECT {b}.* REPLACE ({whole.format(treated)} AS {c}) FROM {b}, {k})")
        elif c in STRIPPED:
            steps += [
                f"{a} AS MATERIALIZED (SELECT * REPLACE (trim({c}) AS {c}) FROM {prev})",
                f"{o} AS MATERIALIZED (SELECT * REPLACE (coalesce({c}, CASE WHEN (SELECT {missing(c)} <= 0.1 * count(*) FROM {a}) THEN {mode_of(a, c)} ELSE 'Unknown' END) AS {c}) FROM {a})",
            ]
        elif c == "is_final":
            steps += [
                f"{a} AS MATERIALIZED (SELECT * REPLACE (lower(trim({c})) IN {TRUE_WORDS} AS {c}) FROM {prev})",
                f"{o} AS MATERIALIZED (SELECT * REPLACE (coalesce({c}, {mode_of(a, c)}) AS {c}) FROM {a})",
            ]
        elif c == "order_date":
            steps += [
                f"{a} AS MATERIALIZED (SELECT * REPLACE (try_strptime({c}, '%Y-%m-%d') AS {c}) FROM {prev})",
                f"{o} AS MATERIALIZED (SELECT * REPLACE (coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), "
                f"first_value({c} IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS {c}) FROM {a})",
            ]
        else:
            steps.append(f"{o} AS MATERIALIZED (SELECT * FROM {prev})")
        prev = o
    return ", ".join(steps), prev


def with_clean(body: str, remove: bool = False) -> str:
    steps, last = clean_steps(remove)
    return f"WITH d AS MATERIALIZED ({I.for_duckdb(I.DIRTY_ORDERS)}), {steps} " + body.replace("<last>", last)


# cleaning reads the dates and the prices and turns yes and no into booleans
CLEANED_ORDERS = [
    (c, {"order_date": "temporal", "is_final": "boolean", "price_text": "number"}.get(c, kind), t) for c, kind, t in ORDERS
]


def before_after() -> str:
    def figures(t: str, cols) -> str:
        return (
            f"SELECT CAST((SELECT count(*) FROM {t}) AS DOUBLE) AS rows, CAST({' + '.join(f'(SELECT {missing(c)} FROM {t})' for c, _, _ in cols)} AS DOUBLE) AS missing_cells, "
            f"CAST({duplicates(t, cols)} AS DOUBLE) AS duplicate_rows, CAST({' + '.join(iqr_count(t, c) for c in numeric_columns(cols))} AS DOUBLE) AS outliers, "
            f"(SELECT CAST({SCORE} AS DOUBLE) FROM ({health_inputs(t, cols)})) AS health_score"
        )

    names = ("rows", "missing_cells", "duplicate_rows", "outliers", "health_score")
    sides = f"({figures('d', ORDERS)}) b, ({figures('<last>', CLEANED_ORDERS)}) a"
    return with_clean(union([f"SELECT '{n}' AS measure, b.{n} AS before, a.{n} AS after FROM {sides}" for n in names]))


CLEAN_SELECT = (
    "SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date, round(o_totalprice, 4) AS o_totalprice, "
    "round(price_text, 4) AS price_text) FROM <last>"
)


def clean_orders() -> str:
    return with_clean(CLEAN_SELECT)


def clean_big_numbers() -> str:
    return I.for_duckdb(I.BIG_NUMBERS)


def clean_late_fractions() -> str:
    return I.for_duckdb(I.LATE_FRACTIONS)


def clean_mixed_dates() -> str:
    return (
        "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 97 <> 0 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS order_date FROM orders"
    )


def clean_orders_removing() -> str:
    return with_clean(CLEAN_SELECT, remove=True)


def clean_shipments() -> str:
    view = I.for_duckdb(I.DIRTY_SHIPMENTS)
    return (
        f"WITH s AS MATERIALIZED ({view}), t AS MATERIALIZED (SELECT * FROM s WHERE shipment_id IS NOT NULL), "
        "m AS (SELECT make_timestamp(CAST(floor(quantile_cont(CAST(epoch_us(shipped_date) AS DOUBLE), 0.5)) AS BIGINT)) AS mid FROM t) "
        "SELECT shipment_id, pos, strftime(coalesce(shipped_date, (SELECT mid FROM m)), '%Y-%m-%d %H:%M:%S') AS shipped_date, "
        "coalesce(trim(priority), 'Unknown') AS priority, coalesce(trim(remark), 'Unknown') AS remark FROM t"
    )


def ix(c: str) -> int:
    return [name for name, _, _ in ORDERS].index(c)


def semantic_name(c: str) -> str:
    if c in CONTINUOUS:
        return "Continuous Numeric"
    if c in DISCRETE:
        return "Discrete Numeric"
    return {"o_orderkey": "Identifier", "order_date": "DateTime", "is_final": "Boolean"}.get(c, "Categorical")


def outside(b: str, k: str, c: str) -> str:
    return f"(SELECT count(*) FROM {b}, {k} WHERE lo < hi AND ({c} < lo OR {c} > hi))"


def log_rows() -> str:
    """One row per possible entry of the log; those that affect nothing are left out by the caller."""
    parts = [
        "SELECT 0 AS o, CAST(NULL AS VARCHAR) AS \"column\", 'Dataset' AS semantic_type, 'Duplicate Rows' AS issue, "
        "'Remove Duplicates' AS strategy, 'drop_exact_duplicates' AS method, 0.98 AS confidence, "
        f"{duplicates('d', ORDERS)} AS n, 10 AS width"
    ]

    def add(step, c, issue, strategy, method, confidence, n):
        o = 10 * (ix(c) + 1) + step
        parts.append(
            f"SELECT {o}, {lit(c)}, {lit(semantic_name(c))}, {lit(issue)}, {strategy}, {method}, {confidence}, {n}, 1"
        )

    for c, kind, _ in ORDERS:
        a, b, k = (f"{x}{ix(c)}" for x in "abk")
        gaps = f"(SELECT {missing(c)} FROM {a})"
        if c in CONTINUOUS + DISCRETE:
            if kind == "text":
                add(0, c, "Numeric Formatting", "'Numeric Coercion'", "'strip_non_numeric_chars'", 0.95, f"(SELECT count({c}) FROM {a})")
            if c in CONTINUOUS:
                skewed = f"(SELECT abs(skewness({c})) > 1.5 FROM {a})"
                add(
                    1, c, "Missing Values", f"CASE WHEN {skewed} THEN 'Median Imputation' ELSE 'Mean Imputation' END",
                    f"CASE WHEN {skewed} THEN 'median_imputation' ELSE 'mean_imputation' END", f"CASE WHEN {skewed} THEN 0.88 ELSE 0.82 END", gaps,
                )
            else:
                add(1, c, "Missing Values", "'Discrete Median Imputation'", "'discrete_median_imputation'", 0.90, gaps)
            iqr = f"(SELECT is_iqr FROM {k})"
            add(
                2, c, "Outliers", f"CASE WHEN {iqr} THEN 'Clip IQR Bounds' ELSE 'Clip ZSCORE Bounds' END",
                f"CASE WHEN {iqr} THEN 'clip_iqr_bounds' ELSE 'clip_zscore_bounds' END", f"CASE WHEN {iqr} THEN 0.85 ELSE 0.80 END", outside(b, k, c),
            )
        elif c in STRIPPED:
            changed = f"(SELECT count(*) FROM dd WHERE {c} <> trim({c}))"
            add(0, c, "Whitespace Formatting", "'Strip Whitespace'", "'strip_whitespace'", 0.95, changed)
            few = f"(SELECT {missing(c)} <= 0.1 * count(*) FROM {a})"
            add(
                1, c, "Missing Values", f"CASE WHEN {few} THEN 'Mode Imputation' ELSE 'Fill Unknown' END",
                f"CASE WHEN {few} THEN 'mode_imputation' ELSE 'fill_unknown' END", f"CASE WHEN {few} THEN 0.90 ELSE 0.80 END", gaps,
            )
        elif c == "is_final":
            add(1, c, "Missing Values", "'Mode Imputation'", "'mode_imputation'", 0.95, gaps)
        elif c == "order_date":
            add(0, c, "DateTime Formatting", "'DateTime Conversion'", "'datetime_parse'", 0.95, "(SELECT count(*) FROM dd)")
            add(1, c, "Missing Values", "'Forward/Backward Fill'", "'ffill_bfill'", 0.90, gaps)
    return union(parts)


def cleaning_log() -> str:
    return with_clean(
        "SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, \"column\", semantic_type, issue, strategy, method, "
        "CAST(confidence AS DOUBLE) AS confidence, CAST(n AS BIGINT) AS affected_rows, CAST(n * width AS BIGINT) AS affected_cells "
        f"FROM ({log_rows()}) WHERE n > 0"
    )


def cleaning_strategies() -> str:
    confidence = {"Continuous Numeric": 0.90, "Discrete Numeric": 0.92, "Identifier": 0.98, "DateTime": 0.95, "Boolean": 0.96, "Categorical": 0.90}
    names = union(
        [f"SELECT {lit(c)} AS c, {lit(semantic_name(c))} AS type, CAST({confidence[semantic_name(c)]} AS DOUBLE) AS confidence" for c, _, _ in ORDERS]
    )
    return with_clean(
        "SELECT c AS \"column\", type, confidence, coalesce((SELECT string_agg(strategy, ' + ' ORDER BY o) "
        f"FROM ({log_rows()}) l WHERE n > 0 AND l.\"column\" = c AND strategy <> 'Numeric Coercion'), 'None') AS strategy FROM ({names})"
    )


def impact_rows() -> str:
    parts = []
    for c, _, _ in ORDERS:
        a = f"a{ix(c)}" if c != "o_orderkey" else "dd"
        number = c in CONTINUOUS + DISCRETE
        before = iqr_count(a, c) if number else "0"
        after = iqr_count("<last>", c) if number else "0"
        parts.append(
            f"SELECT {lit(c)} AS \"column\", CAST((SELECT {missing(c)} FROM {a}) AS BIGINT) AS missing_before, "
            f"CAST((SELECT {missing(c)} FROM <last>) AS BIGINT) AS missing_after, CAST({before} AS BIGINT) AS outliers_before, "
            f"CAST({after} AS BIGINT) AS outliers_after"
        )
    return union(parts)


def column_impact() -> str:
    return with_clean(impact_rows())


def cleaning_impact() -> str:
    gaps = " + ".join(missing(c) for c, _, _ in ORDERS)
    original = " + ".join(iqr_count("d", c) for c in ("o_custkey", "o_totalprice", "age"))
    log = f"({log_rows()})"
    return with_clean(
        "SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM <last>) AS rows_after, "
        f"CAST((SELECT sum(n) FROM {log} WHERE issue = 'Missing Values') AS BIGINT) AS missing_values_fixed, "
        f"CAST({duplicates('d', ORDERS)} AS BIGINT) AS duplicates_removed, "
        f"CAST((SELECT sum(n) FROM {log} WHERE issue = 'Outliers') AS BIGINT) AS outliers_treated, "
        f"(SELECT count(DISTINCT \"column\") FROM {log} WHERE n > 0 AND issue <> 'Numeric Formatting') AS columns_modified, "
        f"CAST((SELECT sum(n * width) FROM {log} WHERE issue <> 'Numeric Formatting') AS BIGINT) AS cells_modified, "
        f"CAST((SELECT {gaps} FROM d) AS BIGINT) AS original_missing_count, CAST({duplicates('d', ORDERS)} AS BIGINT) AS original_duplicate_count, "
        f"CAST({original} AS BIGINT) AS original_outlier_count"
    )


# -------------------------------------------------------------------- analytics
def pct(n: str, total: str) -> str:
    return f"round_even(100.0 * {n} / {total}, 2)"


def analytics_summary() -> str:
    parts = []
    for t, cols, source in tables():
        gaps = " + ".join(missing(c) for c, _, _ in cols)
        size = " + ".join(f"coalesce(sum(strlen({c})), 0)" if kind == "text" else "8 * count(*)" for c, kind, _ in cols)
        kinds = [kind for _, kind, _ in cols]
        dates = "CAST((SELECT count(try_strptime(order_date, '%Y-%m-%d')) > 0.5 * count(*) FROM d) AS BIGINT)" if t == "d" else "CAST(1 AS BIGINT)"
        parts.append(
            f"SELECT {lit(source)} AS source, count(*) AS rows, CAST({len(cols)} AS BIGINT) AS columns, CAST({size} AS BIGINT) AS data_bytes, "
            f"CAST({duplicates(t, cols)} AS BIGINT) AS duplicate_rows, CAST({gaps} AS BIGINT) AS missing_values, "
            f"{pct(f'({gaps})', f'(count(*) * {len(cols)})')} AS missing_percentage, CAST({kinds.count('number')} AS BIGINT) AS numeric_columns, "
            f"CAST({kinds.count('text')} AS BIGINT) AS categorical_columns, {dates} AS datetime_columns FROM {t}"
        )
    return with_orders(union(parts))


def analytics_numeric() -> str:
    parts = []
    for t, cols, source in tables():
        for c in numeric_columns(cols):
            x = f"CAST({c} AS DOUBLE)"
            q1, q2, q3 = (quartile(x, p) for p in (0.25, 0.5, 0.75))
            parts.append(
                f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", round(avg({x}), 4) AS mean, round({q2}, 4) AS median, "
                f"CAST({mode_of(t, c)} AS DOUBLE) AS mode, round(stddev_samp({x}), 3) AS std, round(var_samp({x}) / pow(10, CASE WHEN var_samp({x}) > 0 THEN floor(log10(var_samp({x}))) ELSE 0 END), 9) AS variance, "
                f"CAST(CASE WHEN var_samp({x}) > 0 THEN floor(log10(var_samp({x}))) ELSE 0 END AS BIGINT) AS variance_power, "
                f"round(min({x}), 4) AS min, round(max({x}), 4) AS max, round({q1}, 4) AS q25, round({q2}, 4) AS q50, round({q3}, 4) AS q75, "
                f"round({q3} - {q1}, 4) AS iqr, round(coalesce(skewness({x}), 0), 2) AS skewness, round(coalesce(kurtosis({x}), 0), 2) AS kurtosis, "
                f"{iqr_count(t, c, True)} AS outliers_count, count(*) FILTER (WHERE {c} = 0) AS zeros_count, CAST({missing(c)} AS BIGINT) AS missing_count, "
                f"{pct(missing(c), 'count(*)')} AS missing_pct FROM {t}"
            )
    return with_orders(union(parts))


def label(top: str, bottom: str, distinct: str) -> str:
    r = f"(CAST({top} AS DOUBLE) / greatest(1, {bottom}))"
    return (
        f"CASE WHEN {distinct} > 1 AND {r} > 3 THEN 'Severe Imbalance (' || printf('%.1f', {r}) || ':1)' "
        f"WHEN {distinct} > 1 AND {r} > 1.5 THEN 'Moderate Imbalance (' || printf('%.1f', {r}) || ':1)' ELSE 'Balanced' END"
    )


def analytics_categorical() -> str:
    parts = []
    for t, cols, source in tables():
        for c, kind, _ in cols:
            if kind == "text":
                counts = f"(SELECT n, CAST(n AS DOUBLE) / sum(n) OVER () AS p FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))"
                gaps = f"(SELECT {missing(c)} FROM {t})"
                parts.append(
                    f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", count(*) AS cardinality, round_even(-sum(p * log2(p + 1e-12)), 2) AS entropy, "
                    f"{label('max(n)', 'min(n)', 'count(*)')} AS class_imbalance, CAST({gaps} AS BIGINT) AS missing_count, "
                    f"{pct(gaps, f'(SELECT count(*) FROM {t})')} AS missing_pct FROM {counts}"
                )
    return with_orders(union(parts))


def top_values() -> str:
    parts = []
    for t, cols, source in tables():
        for c, kind, _ in cols:
            if kind == "text":
                parts.append(
                    f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", CAST(r AS INTEGER) AS rank, v AS value, n AS count, "
                    f"{pct('n', f'(SELECT count(*) FROM {t})')} AS pct FROM (SELECT {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r "
                    f"FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= 5"
                )
    return with_orders(union(parts))


def date_stats(t: str, c: str, x: str) -> str:
    span = f"CAST(floor(epoch(max(v) - min(v)) / 86400) AS BIGINT)"
    days = f"(SELECT count(*) FROM range(min(v)::DATE::TIMESTAMP, min(v)::DATE::TIMESTAMP + to_days(CAST({span} + 1 AS INTEGER)), INTERVAL 1 DAY) g(day) WHERE day::DATE NOT IN (SELECT {x}::DATE FROM {t} WHERE {x} IS NOT NULL))"
    return (
        f"SELECT {lit(c)} AS \"column\", strftime(min(v), '%Y-%m-%d %H:%M:%S') AS min_date, strftime(max(v), '%Y-%m-%d %H:%M:%S') AS max_date, "
        f"{span} AS date_span_days, CASE WHEN {span} > 1 THEN {span} + 1 - count(DISTINCT v::DATE) ELSE 0 END AS missing_dates_estimate, "
        f"CAST((SELECT {missing(c)} FROM {t}) AS BIGINT) AS missing_count, {pct(f'(SELECT {missing(c)} FROM {t})', f'(SELECT count(*) FROM {t})')} AS missing_pct "
        f"FROM (SELECT {x} AS v FROM {t}) WHERE v IS NOT NULL"
    )


def analytics_datetime() -> str:
    return with_orders(
        union([date_stats("orders", "o_orderdate", "o_orderdate"), date_stats("d", "order_date", "try_strptime(order_date, '%Y-%m-%d')")])
    )


def missing_days() -> str:
    return (
        "SELECT strftime(day, '%Y-%m-%d') AS day FROM (SELECT unnest(generate_series(min(o_orderdate)::DATE::TIMESTAMP, max(o_orderdate)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS day FROM orders) "
        "WHERE CAST(day AS DATE) NOT IN (SELECT o_orderdate::DATE FROM orders)"
    )


def any_of(q: str, words) -> str:
    return "(" + " OR ".join(f"contains({q}, {lit(w)})" for w in words) + ")"


def answer_metrics() -> str:
    q = "lower(text)"
    first = "CASE " + " ".join(f"WHEN contains({q}, {lit(c)}) THEN {lit(c)}" for c, _, _ in ORDERS) + " END"
    number = "CASE " + " ".join(f"WHEN contains({q}, {lit(c)}) THEN {lit(c)}" for c in numeric_columns(ORDERS)) + " END"
    gaps = {c: f"(SELECT {missing(c)} FROM d)" for c, _, _ in ORDERS}
    total = f"(SELECT {' + '.join(missing(c) for c, _, _ in ORDERS)} FROM d)"
    outliers = " + ".join(iqr_count("d", c, True) for c in numeric_columns(ORDERS))
    per = {
        "mean": "avg({x})", "average": "avg({x})", "median": "quantile_cont({x}, 0.5)", "mode": "{mode}",
        "standard deviation": "stddev_samp({x})", "std": "stddev_samp({x})", "variance": "var_samp({x})", "min": "min({x})",
        "max": "max({x})", "skewness": "round(skewness({x}), 2)", "kurtosis": "round(kurtosis({x}), 2)", "zero": "count(*) FILTER (WHERE {x} = 0)",
    }
    rules = [
        (any_of(q, ("how many rows", "row count", "number of rows")), "rows", "NULL", "NULL", "(SELECT count(*) FROM d)"),
        (any_of(q, ("how many columns", "column count", "number of columns")), "columns", "NULL", "NULL", str(len(ORDERS))),
        (any_of(q, ("shape", "size")), "shape", "NULL", "NULL", "(SELECT count(*) FROM d)"),
        (f"contains({q}, 'duplicate')", "duplicates", "NULL", "NULL", duplicates("d", ORDERS)),
        (
            f"{any_of(q, ('missing', 'null', 'nan'))} AND first IS NOT NULL", "missing", "first", "NULL",
            "CASE first " + " ".join(f"WHEN {lit(c)} THEN {g}" for c, g in gaps.items()) + " END",
        ),
        (any_of(q, ("missing", "null", "nan")), "missing", "NULL", "NULL", total),
        (f"contains({q}, 'outlier')", "outliers", "NULL", "NULL", outliers),
        (any_of(q, ("datatype", "data type", "list columns", "show columns", "column types")), "schema", "NULL", "NULL", str(len(ORDERS))),
    ]
    for word, formula in per.items():
        value = "CASE number " + " ".join(
            f"WHEN {lit(c)} THEN (SELECT CAST({formula.format(x=f'CAST({c} AS DOUBLE)', mode=mode_of('d', c))} AS DOUBLE) FROM d LIMIT 1)"
            for c in numeric_columns(ORDERS)
        ) + " END"
        rules.append((f"contains({q}, {lit(word)}) AND number IS NOT NULL", "metric", "number", lit(word), value))

    def case(pick, otherwise="NULL"):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN {pick(r)}" for r in rules) + f" ELSE {otherwise} END"

    of_column = "first || ' is empty in ' || {v} || ' rows (' || printf('%.2f', 100.0 * {v} / (SELECT count(*) FROM d)) || '%).'"
    share = f"round_even(100.0 * {total} / ((SELECT count(*) FROM d) * {len(ORDERS)}), 2)"

    def said(r) -> str:
        texts = {
            "rows": "'There are ' || {v} || ' rows.'", "columns": "'There are ' || {v} || ' columns.'",
            "shape": f"{{v}} || ' rows by {len(ORDERS)} columns.'", "duplicates": "({v}) || ' rows repeat an earlier one.'",
            "missing": of_column if r[2] == "first" else "{v} || ' cells are empty, ' || " + share + " || '% of all.'",
            "outliers": "({v}) || ' values lie beyond 1.5 IQR of the quartiles.'",
        }
        return texts[r[1]].format(v=r[4]) if r[1] in texts else "NULL"

    return with_orders(
        f"SELECT conv_id, turn, {case(said, lit('Which column and which figure of it are meant?'))} AS answer, {case(lambda r: lit(r[1]), lit('unmapped'))} AS topic, {case(lambda r: r[2])} AS \"column\", "
        f"{case(lambda r: r[3])} AS metric, round(CAST({case(lambda r: r[4])} AS DOUBLE), 4) AS value "
        f"FROM (SELECT *, {first} AS first, {number} AS number FROM ({I.for_duckdb(I.DIRTY_CONVERSATIONS)}) WHERE role = 'user')"
    )


# -------------------------------------------------------------------- features and advice
def pair_list(cols):
    names = numeric_columns(cols)
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]


def r_of(t: str, a: str, b: str) -> str:
    return f"(SELECT CASE WHEN isnan(r) THEN NULL ELSE r END FROM (SELECT corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r FROM {t}))"


def correlation_pairs() -> str:
    parts = [
        f"SELECT {lit(source)} AS source, {lit(a)} AS feature_a, {lit(b)} AS feature_b, {r_of(t, a, b)} AS r"
        for t, cols, source in tables()
        for a, b in pair_list(cols)
    ]
    return with_orders(
        "SELECT source, feature_a, feature_b, round(r, 5) AS correlation, coalesce(abs(r) > 0.8, false) AS collinear FROM (" + union(parts) + ")"
    )


def correlation_matrix() -> str:
    names = numeric_columns(LINEITEM)
    parts = [
        f"SELECT {lit(a)} AS x, {lit(b)} AS y, " + ("CAST(1.0 AS DOUBLE)" if a == b else f"round(coalesce({r_of('lineitem', a, b)}, 0), 2) + 0.0") + " AS r"
        for a in names
        for b in names
    ]
    return union(parts)


def leakage() -> str:
    view = "(SELECT o_orderkey, o_totalprice, o_totalprice * 2 + o_custkey % 7 AS price_outcome FROM orders)"
    parts = [
        f"SELECT {lit(c)} AS \"column\", 'price_outcome' AS target, {r_of(view, c, 'price_outcome')} AS r" for c in ("o_orderkey", "o_totalprice")
    ]
    return "SELECT \"column\", target, round(r, 5) AS correlation FROM (" + union(parts) + ") WHERE abs(r) > 0.95"


def feature_flags() -> str:
    parts = []
    for t, cols, source, target in (("part", PART, "part", None), ("d", ORDERS, "dirty_orders", "class_label")):
        for c, kind, _ in cols:
            named = any(w in c for w in ("id", "key", "index", "pk", "fk"))
            live = f"count(DISTINCT {c}) > 1"
            ident = "true" if named else (f"count(DISTINCT {c}) = count(*)" if kind == "text" else "false")
            if kind == "number":
                flat = f"coalesce(stddev_samp(CAST({c} AS DOUBLE)) < 0.01, true)"
            else:
                flat = f"(SELECT max(n) > 0.98 * sum(n) FROM (SELECT count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}))"
            wide = f"count(DISTINCT {c}) > 30 OR count(DISTINCT {c}) > 0.2 * count(*)" if kind == "text" else "false"
            parts.append(
                f"SELECT {lit(source)} AS source, {lit(c)} AS \"column\", NOT ({live}) AS is_constant, {live} AND {ident} AS is_identifier, "
                f"{live} AND {flat} AS is_near_zero_variance, {wide} AS is_high_cardinality, {str(c == target).lower()} AS is_target FROM {t}"
            )
    return with_orders(union(parts))


def target_summary() -> str:
    return with_orders(f"SELECT 'class_label' AS target, {label('max(n)', 'min(n)', 'count(*)')} AS balance FROM {CLASS_COUNTS}")


def semantics_of_orders() -> str:
    parts = []
    for i, (c, kind, _) in enumerate(ORDERS):
        ty, _conf = semantic_case("d", "o_orderkey", c, kind)
        parts.append(f"SELECT {i} AS o, {lit(c)} AS c, {ty} AS type, (SELECT count(DISTINCT {c}) FROM d) AS u, (SELECT {missing(c)} FROM d) AS gaps")
    return union(parts)


SUGGESTED = (
    "SELECT CASE WHEN u <= 1 OR type = 'Identifier' THEN 'drop_column' WHEN type = 'DateTime' THEN 'create_feature' "
    "WHEN type IN ('Categorical', 'High Cardinality Categorical') THEN 'encoding' WHEN type LIKE '% Numeric' THEN 'scaling' END AS type, "
    "c AS \"column\", CASE WHEN u <= 1 THEN NULL WHEN type = 'High Cardinality Categorical' THEN 'hash_or_target' WHEN type = 'Categorical' AND u <= 15 THEN 'one_hot' "
    "WHEN type = 'Categorical' THEN 'target_or_frequency' WHEN type LIKE '% Numeric' THEN 'standard_scaler' END AS method FROM (<s>)"
)


def feature_suggestions() -> str:
    return with_orders("SELECT * FROM (" + SUGGESTED.replace("<s>", semantics_of_orders()) + ") WHERE type IS NOT NULL")


def readiness_score() -> str:
    drops = "(SELECT count(*) FROM (" + SUGGESTED.replace("<s>", semantics_of_orders()) + ") WHERE type = 'drop_column')"
    gaps = "(SELECT CAST(" + " + ".join(missing(c) for c, _, _ in ORDERS) + " AS DOUBLE) / count(*) FROM d)"
    return f"CAST(25 + greatest(0, 35 - least(20, {drops})) + trunc(40 - least(40, {gaps})) AS INTEGER)"


def ml_readiness() -> str:
    dense = f"(SELECT bool_or(type LIKE '% Numeric' AND gaps < 0.2 * (SELECT count(*) FROM d)) FROM ({semantics_of_orders()}))"
    return with_orders(f"SELECT {readiness_score()} AS score, true AS classification, {dense} AS regression, true AS time_series")


def insights() -> str:
    parts = []

    def row(rule, c, title, evidence, confidence, recommendation, when):
        column = "NULL" if c is None else lit(c)
        return (
            f"SELECT {lit(rule)} AS rule, {column} AS \"column\", {title} AS title, {evidence} AS evidence, "
            f"CAST({confidence} AS DOUBLE) AS confidence, {lit(recommendation)} AS recommendation FROM d HAVING {when}"
        )

    for c, _, _ in ORDERS:
        parts.append(
            row(
                "missing", c, f"{lit(c + ': ')} || printf('%.1f', 100.0 * {missing(c)} / count(*)) || '% empty'",
                f"{missing(c)} || ' of ' || count(*) || {lit(f' rows have no {c}.')}", 1.0, f"Impute {c} or leave it out.", f"{missing(c)} > 0.05 * count(*)",
            )
        )
        parts.append(
            row(
                "identifier", c, lit(f"{c} names rows"), f"count(DISTINCT {c}) || ' different values in ' || count(*) || ' rows.'", 0.95,
                f"Join by {c}, but do not learn from it.", f"count(DISTINCT {c}) >= 0.99995 * count(*)",
            )
        )
    for c in numeric_columns(ORDERS):
        parts.append(
            row(
                "skew", c, f"{lit(c + ' leans to the ')} || CASE WHEN skewness({c}) < 0 THEN 'left' ELSE 'right' END",
                f"'Skewness ' || printf('%.2f', skewness({c})) || '.'", 0.9, f"Try {c} on a logarithmic scale or in ranks.", f"abs(skewness({c})) > 1.5",
            )
        )
    score = readiness_score()
    parts.append(
        f"SELECT 'readiness', NULL, CASE WHEN s >= 80 THEN 'Fit for a first model' ELSE 'Not fit for a model yet' END, 'Readiness ' || CAST(s AS BIGINT) || ' of 100.', "
        f"0.85, CASE WHEN s >= 80 THEN 'Train a baseline and measure it.' ELSE 'Mend gaps, outliers and types, then look again.' END FROM (SELECT {score} AS s)"
    )
    return with_orders(union(parts))


def advanced_features() -> str:
    encoded = f"SELECT c || '_Encoded' AS feature_name, CAST(0.92 AS DOUBLE) AS confidence_score FROM ({semantics_of_orders()}) WHERE type = 'High Cardinality Categorical'"
    return with_orders(
        f"{encoded} UNION ALL SELECT 'age_Group', 0.85 UNION ALL SELECT 'o_totalprice_Per_o_orderkey', 0.90"
    )


def recommend_models() -> str:
    task = "CASE WHEN typeof(any_value(class_label)) = 'VARCHAR' OR count(DISTINCT class_label) <= 10 THEN {} ELSE {} END"
    c, r = (advice.FIRST_LOOK_MODELS[t] for t in ("Supervised (Classification)", "Supervised (Regression)"))
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS rank, {task.format(lit('Supervised (Classification)'), lit('Supervised (Regression)'))} AS task, "
        f"'class_label' AS target, {task.format(lit(a), lit(b))} AS model FROM d"
        for i, (a, b) in enumerate(zip(c, r))
    ]
    return with_orders(union(parts))


def ml_advice() -> str:
    a = advice.ADVISOR["Classification"]
    text = [c for c, kind, _ in ORDERS if kind == "text" and c != "order_date"]
    every_text = [c for c, kind, _ in ORDERS if kind == "text"]
    is_wide = "(SELECT count(DISTINCT {c}) > 30 OR count(DISTINCT {c}) > 0.2 * count(*) FROM d)"
    wide = "concat_ws(', ', " + ", ".join(f"CASE WHEN {is_wide.format(c=c)} THEN {lit(c)} END" for c in every_text) + ")"
    narrow = "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {is_wide.format(c=c)} THEN {lit(c)} END" for c in text) + ")"
    numbers = ", ".join(numeric_columns(ORDERS))
    ids = ", ".join(c for c, _, _ in ORDERS if any(w in c for w in ("id", "key", "index", "pk", "fk")))
    steps = (
        f"'Encode by hash or by target mean: ' || {wide} || ' | Encode one column per category: ' || {narrow} || "
        f"' | Bring to one scale, by quartiles where outliers remain: {numbers}'"
    )
    return with_orders(
        f"SELECT 'Classification' AS problem_type, 'class_label' AS target_column, {lit(a['task'])} AS task, {lit(' | '.join(a['models']))} AS models, "
        f"{lit(' | '.join(a['metrics']))} AS metrics, {lit(a['validation'])} AS validation, {steps} AS preprocessing, "
        f"'Leave out, names rows: {ids}' AS selection"
    )


def domain_detection() -> str:
    hits = [f"count(*) FILTER (WHERE {any_of('lower(c)', words)}) AS h{i}" for i, words in enumerate(advice.DOMAINS.values())]
    best = "greatest(" + ", ".join(f"h{i}" for i in range(len(advice.DOMAINS))) + ")"
    winner = "CASE " + " ".join(f"WHEN h{i} = {best} THEN {lit(d)}" for i, d in enumerate(advice.DOMAINS)) + " END"
    rows = (
        "SELECT user_id, event_type || '_ad' AS c FROM events UNION ALL SELECT user_id, 'user_id' FROM events "
        "UNION ALL SELECT user_id, unnest(json_keys(props)) FROM events"
    )
    share = f"round_even(CAST({best} AS DOUBLE) / n, 2)"
    return (
        f"SELECT user_id, CASE WHEN {share} >= 0.6 THEN {winner} ELSE 'General Tabular Dataset' END AS domain, {share} AS confidence "
        f"FROM (SELECT user_id, count(*) AS n, {', '.join(hits)} FROM ({rows}) GROUP BY user_id)"
    )


# -------------------------------------------------------------------- charts
def missing_bars() -> str:
    parts = [f"SELECT {i} AS o, {lit(c)} AS \"column\", CAST({missing(c)} AS BIGINT) AS missing FROM d" for i, (c, _, _) in enumerate(ORDERS)]
    return with_orders(
        "SELECT CAST(row_number() OVER (ORDER BY missing DESC, o) - 1 AS INTEGER) AS position, \"column\", missing FROM ("
        + union(parts)
        + ")"
    )


def histogram() -> str:
    return (
        "WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem), "
        "n AS (SELECT CAST(least(29, floor((l_extendedprice - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) "
        "SELECT 'l_extendedprice' AS \"column\", CAST(i AS INTEGER) AS bin, round(lo + i * w, 4) AS lower, round(lo + (i + 1) * w, 4) AS upper, "
        "coalesce(n.n, 0) AS count FROM range(30) t(i), b LEFT JOIN n ON n.bin = t.i"
    )


def feature_importance() -> str:
    """A tree of four levels by brute force: at every value of every feature the classes left and right of it."""
    names = ("doc_id", "lang", "source", "n_chars", "toxic")
    code = "(SELECT {0}, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM j WHERE {0} IS NOT NULL GROUP BY {0})"
    parts = [
        "WITH j AS (SELECT doc_id, lang, source, n_chars, toxic, quality FROM documents JOIN labels USING (doc_id))",
        "r0 AS (SELECT coalesce(CAST(quality AS VARCHAR), '') AS label, 1 AS node, CAST(doc_id AS DOUBLE) AS x0, "
        "CAST(coalesce(l.code, -1) AS DOUBLE) AS x1, CAST(coalesce(s.code, -1) AS DOUBLE) AS x2, "
        "CAST(coalesce(n_chars, (SELECT quantile_cont(n_chars, 0.5) FROM j)) AS DOUBLE) AS x3, "
        "CAST(coalesce(toxic, (SELECT quantile_cont(toxic, 0.5) FROM j)) AS DOUBLE) AS x4 FROM j "
        f"LEFT JOIN {code.format('lang')} l ON j.lang = l.lang LEFT JOIN {code.format('source')} s ON j.source = s.source)",
    ]
    for k in range(4):
        cells = union([f"SELECT node, label, {i} AS f, x{i} AS x FROM r{k} WHERE node > 0" for i in range(5)])
        parts += [
            f"t{k} AS (SELECT node, label, count(*) AS total FROM r{k} WHERE node > 0 GROUP BY node, label)",
            f"c{k} AS (SELECT node, f, x, label, count(*) AS n FROM ({cells}) GROUP BY node, f, x, label)",
            f"v{k} AS (SELECT DISTINCT node, f, x FROM c{k})",
            f"g{k} AS (SELECT v.node, v.f, v.x, t.total, sum(coalesce(c.n, 0)) OVER (PARTITION BY v.node, v.f, t.label ORDER BY v.x) AS lft "
            f"FROM v{k} v JOIN t{k} t ON v.node = t.node LEFT JOIN c{k} c ON c.node = v.node AND c.f = v.f AND c.x = v.x AND c.label = t.label)",
            f"h{k} AS (SELECT node, f, x, CAST(sum(lft) AS DOUBLE) AS n, CAST(sum(total) AS DOUBLE) AS whole, CAST(sum(lft * lft) AS DOUBLE) AS ls, "
            f"CAST(sum((total - lft) * (total - lft)) AS DOUBLE) AS rs, CAST(sum(total * total) AS DOUBLE) AS sq FROM g{k} GROUP BY node, f, x)",
            f"b{k} AS (SELECT node, f, x AS cut, ls / n + rs / (whole - n) - sq / whole AS gain FROM h{k} WHERE whole > n)",
            f"s{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, cut) AS rk FROM b{k} WHERE gain > 1e-9) WHERE rk = 1)",
            f"r{k + 1} AS (SELECT r.label, CASE WHEN s.node IS NULL THEN 0 ELSE r.node * 2 + CASE WHEN (CASE s.f WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 "
            f"WHEN 3 THEN x3 ELSE x4 END) > s.cut THEN 1 ELSE 0 END END AS node, x0, x1, x2, x3, x4 FROM r{k} r LEFT JOIN s{k} s ON r.node = s.node)",
        ]
    parts.append("a AS (" + union([f"SELECT f, gain FROM s{k}" for k in range(4)]) + ")")
    label = " ".join(f"WHEN {i} THEN {lit(n)}" for i, n in enumerate(names))
    return ", ".join(parts) + (
        f" SELECT CASE f {label} END AS feature, round(sum(gain) / (SELECT sum(gain) FROM a), 3) AS importance FROM a GROUP BY f "
        "HAVING sum(gain) / (SELECT sum(gain) FROM a) > 0.01"
    )


def histogram_coerced() -> str:
    x = "TRY_CAST(replace(replace(trim(price_text), '$', ''), ',', '') AS DOUBLE)"
    return with_orders("").rstrip() + (
        f", p AS (SELECT {x} AS x FROM d WHERE price_text IS NOT NULL), b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30 AS w FROM p), "
        "n AS (SELECT CAST(least(29, floor((x - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM p, b GROUP BY 1) "
        "SELECT 'price_text' AS \"column\", CAST(i AS INTEGER) AS bin, round(lo + i * w, 4) AS lower, round(lo + (i + 1) * w, 4) AS upper, "
        "coalesce(n.n, 0) AS count FROM range(30) t(i), b LEFT JOIN n ON n.bin = t.i"
    )


def read_json_arrays() -> str:
    return "SELECT event_id, user_id, event_type, value, props FROM events"


def read_json_mixed() -> str:
    kind = "CASE event_id % 3 WHEN 0 THEN 'number' WHEN 1 THEN 'text' ELSE 'flag' END"
    return f"SELECT {kind} AS kind, count(*) AS count, 'Unknown' AS type FROM events GROUP BY 1"


def input_checks() -> str:
    return (
        "SELECT k.kind, k.verdict, count(*) > 0 AS filled FROM nation, "
        "(VALUES ('csv', 'ok'), ('json', 'ok'), ('parquet', 'type not allowed')) k(kind, verdict) GROUP BY ALL"
    )


def payload_items() -> str:
    return f"SELECT doc_id, len(string_split(text, ' ')) > 100 AS too_many FROM ({I.for_duckdb(I.DIRTY_DOCUMENTS)})"


def box_summary() -> str:
    q = "(SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.75) AS b FROM d)"
    inside = "o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)"
    return with_orders(
        "SELECT 'o_totalprice' AS \"column\", round(min(o_totalprice), 4) AS min, round(any_value(a), 4) AS q1, round(any_value(m), 4) AS median, "
        "round(any_value(b), 4) AS q3, round(max(o_totalprice), 4) AS max, "
        f"round(min(o_totalprice) FILTER (WHERE {inside}), 4) AS whisker_low, round(max(o_totalprice) FILTER (WHERE {inside}), 4) AS whisker_high, "
        f"count(*) FILTER (WHERE NOT ({inside})) AS outliers FROM d, {q}"
    )


def distribution() -> str:
    def top(t, c, source):
        return (
            f"SELECT * FROM (SELECT {lit(source)} AS source, {lit(c)} AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {t} "
            f"WHERE {c} IS NOT NULL GROUP BY {c})"
        )

    # the first target-like name: a name with a 'y' in it counts
    return with_orders(top("d", "o_orderkey", "dirty_orders") + " UNION ALL " + top("lineitem", "l_orderkey", "lineitem"))


def totals() -> str:
    parts = []
    for t, cols, source in tables():
        gaps = " + ".join(missing(c) for c, _, _ in cols)
        out = " + ".join(iqr_count(t, c) for c in numeric_columns(cols))
        parts.append(f"SELECT {lit(source)} AS source, CAST({gaps} AS BIGINT) AS total_missing, CAST({out} AS BIGINT) AS total_outliers FROM {t}")
    return with_orders(union(parts))


# -------------------------------------------------------------------- cleaning on request
def recommendation_rows() -> str:
    parts = []
    for i, (c, kind, _) in enumerate(ORDERS):
        if kind == "number":
            robust = f"({iqr_count('d', c)} > 0 OR abs(coalesce(skewness({c}), 0)) > 1)"
            action, conf = f"CASE WHEN {robust} THEN 'median_imputation' ELSE 'mean_imputation' END", f"CASE WHEN {robust} THEN 0.92 ELSE 0.84 END"
            why = f"CASE WHEN {robust} THEN 'Outliers or skew are present; the median is robust.' ELSE 'The distribution is stable; the mean keeps its centre.' END"
        else:
            action, conf, why = "'mode_imputation'", "0.86", "'The most frequent category preserves the distribution.'"
        parts.append(
            f"SELECT {lit(c)} AS \"column\", {action} AS recommended_action, CAST({conf} AS DOUBLE) AS confidence, {why} AS explanation FROM d HAVING {missing(c)} > 0"
        )
    parts.append(f"SELECT '__rows__', 'remove_duplicates', 0.97, 'Exact copies bias statistics and learning.' WHERE {duplicates('d', ORDERS)} > 0")
    return union(parts)


def cleaning_recommendations() -> str:
    return with_orders(recommendation_rows())


def structured_plan() -> str:
    parts = [
        "SELECT 0 AS o, 'remove_duplicates' AS action, CAST(NULL AS VARCHAR) AS \"column\", 'drop_exact_duplicates' AS method, "
        f"'Dataset contains ' || ({duplicates('d', ORDERS)}) || ' exact duplicate rows.' AS reason WHERE {duplicates('d', ORDERS)} > 0"
    ]
    for i, (c, kind, _) in enumerate(ORDERS):
        how = f"CASE WHEN abs(skewness({c})) > 1.5 THEN 'median' ELSE 'mean' END" if kind == "number" else "'mode'"
        about = f"'Column ''{c}'' "
        gaps = f"{about}has ' || ({missing(c)}) || ' missing cells (' || printf('%.1f', 100.0 * ({missing(c)}) / count(*)) || '% missing).'"
        parts.append(f"SELECT {100 + i}, 'fill_missing', {lit(c)}, {how}, {gaps} FROM d HAVING {missing(c)} > 0")
        if kind == "number":
            far = iqr_count("d", c)
            parts.append(f"SELECT {200 + i}, 'handle_outliers', {lit(c)}, 'clip_iqr_bounds', {about}has ' || {far} || ' IQR outliers.' WHERE {far} > 0")
        else:
            parts.append(
                f"SELECT {300 + i}, 'fix_formatting', {lit(c)}, 'strip_whitespace', {about}mixes case or surrounding blanks.' "
                f"FROM d HAVING count(DISTINCT {c}) <> count(DISTINCT lower(trim({c})))"
            )
            if "date" in c or "time" in c:
                parts.append(f"SELECT {400 + i}, 'convert_dtypes', {lit(c)}, 'datetime_parse', {about}holds dates as text.'")
    return with_orders(
        f"SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS position, action, \"column\", method, reason FROM ({union(parts)})"
    )


def manual_actions() -> str:
    """Distinct rows, then median or mode, then strip, then IQR clipping, then dates."""
    filled = [
        f"coalesce(CAST({c} AS DOUBLE), (SELECT {quartile(c, 0.5)} FROM dd)) AS {c}" if kind == "number" and c in ("o_totalprice", "age")
        else f"trim(coalesce({c}, {mode_of('dd', c)})) AS {c}" if kind == "text" else f"CAST({c} AS DOUBLE) AS {c}"
        for c, kind, _ in ORDERS
    ]
    clipped = [
        f"(SELECT CASE WHEN b > a THEN greatest(a - 1.5 * (b - a), least(b + 1.5 * (b - a), f.{c})) ELSE f.{c} END FROM "
        f"(SELECT {quartile(c, 0.25)} AS a, {quartile(c, 0.75)} AS b FROM f)) AS {c}"
        for c in numeric_columns(ORDERS)
    ]
    texts = [c for c, kind, _ in ORDERS if kind == "text"]
    shown = [c if c != "order_date" else "strftime(try_strptime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS order_date" for c in texts]
    return with_orders("SELECT * FROM d").replace(
        "SELECT * FROM d",
        f"SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice, round(age, 4) AS age) FROM (SELECT {', '.join(shown)}, {', '.join(clipped)} FROM f)",
    ).replace(") SELECT * REPLACE", f"), dd AS MATERIALIZED (SELECT DISTINCT * FROM d), f AS MATERIALIZED (SELECT {', '.join(filled)} FROM dd) SELECT * REPLACE", 1)


def apply_plan() -> str:
    new = []
    for c, kind, _ in ORDERS:
        if kind == "number":
            robust = f"(SELECT {iqr_count('d', c)} > 0 OR abs(coalesce(skewness({c}), 0)) > 1 FROM d)"
            fill = f"CASE WHEN {robust} THEN (SELECT {quartile(c, 0.5)} FROM d) ELSE (SELECT avg({c}) FROM d) END"
            new.append(f"round(coalesce(CAST({c} AS DOUBLE), {fill}), 4) AS {c}" if c in ("o_totalprice", "age") else c)
        else:
            new.append(f"coalesce({c}, {mode_of('d', c)}) AS {c}")
    at = "try_strptime(order_date, '%Y-%m-%d')"
    return with_orders(
        f"SELECT *, CAST(month({at}) AS INTEGER) AS order_date_month, CAST(isodow({at}) - 1 AS INTEGER) AS order_date_weekday "
        f"FROM (SELECT {', '.join(new)} FROM (SELECT DISTINCT * FROM d))"
    )


def csv_round_trip() -> str:
    """Whole numbers with gaps come back as doubles; everything else as it was."""
    return with_orders("SELECT * REPLACE (round(o_totalprice, 4) AS o_totalprice, CAST(age AS DOUBLE) AS age) FROM d")


def csv_line_breaks() -> str:
    return f"SELECT doc_id, 'a \"b\", ' || text AS text FROM {documents()}"


def run_round_trip() -> str:
    return with_orders("SELECT * FROM d")


def json_log_round_trip() -> str:
    return with_orders(f"SELECT \"column\", issue, severity, affected_rows FROM ({issue_rows()})")


# -------------------------------------------------------------------- questions and conversations
def scores(q: str) -> list[str]:
    return [
        "round(least(1.0, " + " + ".join(f"CASE WHEN contains({q}, {lit(w)}) THEN CAST({v} AS DOUBLE) ELSE 0 END" for w, v in words.items()) + "), 2)"
        for words in Q.INTENTS.values()
    ]


def top_intent(q: str) -> str:
    parts = scores(q)
    best = "greatest(" + ", ".join(parts) + ")"
    return f"CASE WHEN {best} < 0.25 THEN 'General Discussion' " + " ".join(f"WHEN {s} = {best} THEN {lit(i)}" for i, s in zip(Q.INTENTS, parts)) + " END"


def conversations() -> str:
    return f"({I.for_duckdb(I.DIRTY_CONVERSATIONS)})"


def route_intents() -> str:
    parts = [
        f"SELECT conv_id, turn, {i} AS p, {lit(name)} AS intent, {score} AS confidence FROM c"
        for i, (name, score) in enumerate(zip(Q.INTENTS, scores("q")))
    ]
    return (
        f"WITH c AS (SELECT conv_id, turn, lower(text) AS q FROM {conversations()}), s AS ({union(parts)}), "
        "b AS (SELECT conv_id, turn, max(confidence) AS best FROM s GROUP BY ALL), "
        "k AS (SELECT conv_id, turn, p, intent, confidence FROM s JOIN b USING (conv_id, turn) WHERE best >= 0.25 AND confidence > 0 "
        "UNION ALL SELECT conv_id, turn, 7, 'General Discussion', 1.0 FROM b WHERE best < 0.25) "
        "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY confidence DESC, p) AS INTEGER) AS rank, intent, CAST(confidence AS DOUBLE) AS confidence FROM k"
    )


def plan_modes() -> str:
    chain = " ".join(f"WHEN {any_of('lower(text)', words)} THEN {lit(m)}" for m, words in Q.MODES.items())
    return f"SELECT conv_id, turn, CASE {chain} ELSE 'GENERAL' END AS mode FROM {conversations()}"


def pick(q: str, words, out=None) -> str:
    return "CASE " + " ".join(f"WHEN contains({q}, {lit(w)}) THEN {lit(w if out is None else out(w))}" for w in words) + " END"


def told_in_turn() -> str:
    """The conversation told turn by turn: a recursive query, m, that carries the memory along."""
    compare, column, chart = C.COMPARE_FOLLOW_UP, C.COLUMN_FOLLOW_UP, C.CHART_FOLLOW_UP
    lists = {"bench": C.BENCHMARKS}
    known = "lower(target) IN (" + ", ".join(lit(b) for b in lists["bench"]) + ")"
    resolved = (
        "CASE WHEN target IS NOT NULL AND (known OR cmp IS NOT NULL) THEN 'Compare the uploaded dataset with ' || target "
        "WHEN subject IS NOT NULL AND metric IS NOT NULL THEN 'What is the ' || metric || ' of ' || subject || '?' "
        "WHEN subject IS NOT NULL AND intent = 'Statistics' THEN 'Show statistics and summary for column ' || subject "
        "WHEN chart <> '' THEN 'Explain the ' || chart || ' chart and its data distributions/relationships' ELSE question END"
    )
    step = (
        f"SELECT conv_id, turn, k, question, resolved, {top_intent('lower(resolved)')} AS intent, "
        f"coalesce({pick('lower(resolved)', C.REMEMBERED_METRICS)}, metric) AS metric, "
        f"coalesce({pick('lower(resolved)', C.REMEMBERED_BENCHMARKS, str.title)}, CASE WHEN target IS NOT NULL AND (known OR cmp IS NOT NULL) THEN target END, cmp) AS cmp, "
        f"coalesce({pick('lower(resolved)', C.REMEMBERED_MODELS, str.title)}, model) AS model, "
        f"CASE WHEN list_contains(charts, {pick('lower(resolved)', C.REMEMBERED_CHARTS)}) THEN charts "
        f"ELSE list_filter(list_append(charts, {pick('lower(resolved)', C.REMEMBERED_CHARTS)}), lambda x: x IS NOT NULL) END AS charts "
        f"FROM (SELECT *, {resolved} AS resolved FROM (SELECT u.*, coalesce({known}, false) AS known, {{state}}))"
    )
    asked = "trim(text)"
    users = (
        f"SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text AS question, "
        f"CASE WHEN regexp_matches(lower({asked}), {lit(compare)}) THEN initcap_words(trim(regexp_extract(lower({asked}), {lit(compare)}, 2))) END AS target, "
        f"CASE WHEN regexp_matches(lower({asked}), {lit(column)}) THEN trim(regexp_extract({asked}, {lit('(?i)' + column)}, 2)) END AS subject, "
        f"regexp_extract(lower({asked}), {lit(chart)}, 3) AS chart FROM {conversations()} WHERE role = 'user'"
    )
    # title case of the single words that occur here
    users = users.replace(
        f"initcap_words(trim(regexp_extract(lower({asked}), {lit(compare)}, 2)))",
        f"array_to_string(list_transform(str_split(trim(regexp_extract(lower({asked}), {lit(compare)}, 2)), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')",
    )
    first = step.replace("{state}", "CAST(NULL AS VARCHAR) AS intent, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS VARCHAR) AS cmp, CAST(NULL AS VARCHAR) AS model, CAST([] AS VARCHAR[]) AS charts FROM u WHERE k = 1")
    later = step.replace("{state}", "m.intent, m.metric, m.cmp, m.model, m.charts FROM u JOIN m ON u.conv_id = m.conv_id AND u.k = m.k + 1")
    return f"WITH RECURSIVE u AS ({users}), m AS ({first} UNION ALL {later}) "


def followups() -> str:
    low = "lower(resolved)"
    return told_in_turn() + (
        f"SELECT conv_id, turn, question, resolved, intent, metric AS last_metric, cmp AS last_comparison, "
        f"{pick(low, C.REMEMBERED_MODELS, str.title)} AS model_mentioned, {pick(low, C.REMEMBERED_CHARTS)} AS chart_mentioned, "
        "model AS last_model, array_to_string(charts, ',') AS discussed_charts FROM m"
    )


def context_record() -> str:
    """Last state of every conversation beside the figures of the raw and the cleaned table."""
    raw, done = health_inputs(), health_inputs("<last>", CLEANED_ORDERS)
    table = (
        f"SELECT (SELECT count(*) FROM d) AS rows, ({' + '.join(f'(SELECT {missing(c)} FROM d)' for c, _, _ in ORDERS)}) AS missing_values, "
        f"({duplicates('d', ORDERS)}) AS duplicate_rows, (SELECT CAST({SCORE} AS BIGINT) FROM ({raw})) AS raw_health, "
        f"(SELECT CAST({SCORE} AS BIGINT) FROM ({done})) AS cleaned_health"
    )
    steps, end = clean_steps(False)
    told = told_in_turn().rstrip()
    ranked = ", ".join(f"{{'p': {i}, 'c': {x}, 'i': {lit(name)}}}" for i, (name, x) in enumerate(zip(Q.INTENTS, scores("lower(resolved)"))))
    strong = f"list_filter([{ranked}], lambda x: x.c > 0)"
    intents = (
        f"CASE WHEN len(list_filter({strong}, lambda x: x.c >= 0.25)) = 0 THEN 'General Discussion' ELSE "
        f"array_to_string(list_transform(list_sort(list_transform({strong}, lambda x: {{'o': -x.c, 'p': x.p, 'i': x.i}})), lambda x: x.i), ',') END"
    )
    return (
        f"{told}, d AS MATERIALIZED ({I.for_duckdb(I.DIRTY_ORDERS)}), {steps}, facts AS MATERIALIZED ({table}), "
        "q AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1), "
        f"h AS (SELECT conv_id, count(*) AS n, string_agg(role || ':' || text, chr(10) ORDER BY turn) AS said FROM "
        f"(SELECT * FROM {conversations()} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20) GROUP BY conv_id) "
        f"SELECT conv_id, rows, CAST(missing_values AS BIGINT) AS missing_values, CAST(duplicate_rows AS BIGINT) AS duplicate_rows, raw_health, cleaned_health, "
        f"{intents} AS intents, intent AS previous_intent, metric AS last_metric, cmp AS last_comparison, model AS last_model, "
        "array_to_string(charts, ',') AS discussed_charts, n AS messages, md5(said) AS history FROM h LEFT JOIN q USING (conv_id), facts"
    ).replace("<last>", end)


def last_messages() -> str:
    return (
        "SELECT conv_id, turn, role, text, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS parent_turn FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM {conversations()}) WHERE n <= 4"
    )


def edit_messages() -> str:
    return (
        f"WITH m AS ({conversations()[1:-1]}), e AS (SELECT conv_id, min(turn) AS edit_turn FROM m WHERE role = 'user' AND turn % 4 = 2 GROUP BY conv_id) "
        "SELECT m.conv_id, turn, CASE WHEN turn = edit_turn THEN 'user' ELSE role END AS role, CASE WHEN turn = edit_turn THEN 'Edited: ' || text ELSE text END AS text, "
        "coalesce(turn = edit_turn, false) AS edited, CASE WHEN turn = edit_turn THEN turn ELSE -1 END AS replaces_turn FROM m LEFT JOIN e ON m.conv_id = e.conv_id WHERE edit_turn IS NULL OR turn <= edit_turn"
    )


def suggest_questions() -> str:
    s = SITUATION
    bonus = {
        "always": True, "health_below_80": s["health_score"] < 80, "health_below_90": s["health_score"] < 90,
        "has_gaps_or_outliers": s["missing"] > 0 or s["outliers"] > 0, "was_cleaned": s["cleaning_steps"] > 0,
        "ready_below_90": s["readiness_score"] < 90, "ready_below_80": s["readiness_score"] < 80, "not_titanic": True, "not_iris": True,
    }
    rows = []
    for i, (t, w, cond) in enumerate(C.SUGGESTIONS):
        t = t.replace("{task}", "classification")
        weight = "CASE intent " + " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in w.items()) + " ELSE 0 END"
        boost = "CASE WHEN lower(intent) LIKE '%comparison%' THEN 2 ELSE 0 END" if "compare" in t.lower() else "0"
        rows.append(f"SELECT conv_id, intent, {i} AS i, {lit(t)} AS t, {weight} + {3 if bonus[cond] else 0} + {boost} AS score FROM i")
    for j, t in enumerate(C.FALLBACK_SUGGESTIONS):
        rows.append(f"SELECT conv_id, intent, {100 + j}, {lit(t)}, -1 FROM i")
    letters = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
    return (
        f"WITH m AS ({conversations()[1:-1]}), i AS (SELECT c.conv_id, coalesce(intent, 'General Discussion') AS intent FROM (SELECT DISTINCT conv_id FROM m) c LEFT JOIN "
        f"(SELECT conv_id, arg_max({top_intent('lower(text)')}, turn) AS intent FROM m WHERE role = 'user' GROUP BY conv_id) q ON q.conv_id = c.conv_id), "
        f"r AS (SELECT conv_id, {letters.format('text')} AS said FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM m) WHERE n <= 10), "
        f"x AS ({union(rows)}), "
        f"f AS (SELECT * FROM x WHERE i >= 100 OR NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = x.conv_id AND (contains(said, {letters.format('t')}) OR contains({letters.format('t')}, said)))), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (i >= 100), score DESC, i) AS n FROM f), "
        "kept AS (SELECT * FROM best WHERE i >= 100 OR n <= 4), "
        "once AS (SELECT conv_id, any_value(intent) AS intent, t, min(n) AS n FROM kept GROUP BY conv_id, t), "
        "ranked AS (SELECT conv_id, intent, t, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS rank FROM once) "
        "SELECT conv_id, intent, CAST(rank AS INTEGER) AS rank, t AS suggestion FROM ranked WHERE rank <= 4"
    )


def search_messages() -> str:
    def n(pattern):
        return f"CAST(len(regexp_extract_all(text, {lit(pattern)})) AS INTEGER)"

    return (
        f"SELECT conv_id, turn, {n('(?i)the')} AS anywhere, {n('(?i)' + chr(92) + 'bthe' + chr(92) + 'b')} AS words, {n('The')} AS exact "
        f"FROM {conversations()} WHERE contains(lower(text), 'the')"
    )


def export_sections() -> str:
    nl = "chr(10)"
    return (
        f"SELECT conv_id, turn, CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN '# Report' || {nl} || {nl} || '---' || {nl} || {nl} ELSE {nl} || '---' || {nl} || {nl} END "
        f"|| '### ' || CASE WHEN role = 'user' THEN 'User Query' ELSE 'Assistant' END || {nl} || {nl} || text || {nl} || {nl} AS section FROM {conversations()}"
    )


def join_chunks() -> str:
    return (
        "SELECT conv_id, CAST(floor(turn / 10000) AS BIGINT) AS segment, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS chunks "
        "FROM conversations GROUP BY ALL"
    )


# -------------------------------------------------------------------- text guards
def documents() -> str:
    return f"({I.for_duckdb(I.DIRTY_DOCUMENTS)})"


BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def text_guards() -> str:
    prompt = f"regexp_replace(coalesce(text, ''), {lit(X.SCRIPT)}, '', 'g')"
    prompt = strip(f"replace(replace({prompt}, '<', '&lt;'), '>', '&gt;')")
    user = strip(f"regexp_replace(text, {lit(X.SQL_TOKENS)}, '', 'g')")
    content = "text"
    for phrase in X.INJECTIONS:
        content = f"regexp_replace({content}, {lit('(?i)' + phrase)}, '[REDACTED]', 'g')"
    return f"SELECT doc_id, {prompt} AS prompt, {user} AS user_input, {content} AS content FROM {documents()}"


def payload_flags() -> str:
    lines = f"list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r]'), lambda x: {strip('x')}), lambda x: x <> '')"
    commas = f"list_min(list_transform(list_slice({lines}, 1, 5), lambda x: length(x) - length(replace(x, ',', ''))))"
    whole = strip("text")
    return (
        f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat_ws(',', CASE WHEN len({lines}) >= 3 AND {commas} >= 2 THEN 'tabular' END, "
        f"CASE WHEN starts_with({whole}, '[') AND ends_with({whole}, ']') AND regexp_matches({whole}, {lit(X.JSON_RECORD)}) THEN 'records' END) "
        f"ELSE '' END AS problems FROM {documents()}"
    )


def repair_responses() -> str:
    t1 = r"regexp_replace(text, '(?m)^(#{1,6})([^#\s])', '\1 \2', 'g')"
    key = f"CASE WHEN length({strip('p')}) > 40 THEN lower(regexp_replace({strip('p')}, '{BLANKS}+', ' ', 'g')) END"
    t3 = "CASE WHEN ((length(b) - length(replace(b, '```', ''))) // 3) % 2 = 1 THEN b || chr(10) || '```' || chr(10) ELSE b END"
    line = f"CASE WHEN starts_with({strip('l')}, '|') AND NOT ends_with({strip('l')}, '|') THEN l || ' |' ELSE l END"
    return (
        f"SELECT doc_id, CASE WHEN text IS NULL OR {strip('text')} = '' THEN {lit(X.EMPTY_RESPONSE)} ELSE "
        f"array_to_string(list_transform(str_split(c, chr(10)), lambda l: {line}), chr(10)) END AS text FROM "
        f"(SELECT *, {t3} AS c FROM (SELECT *, array_to_string(list_filter(ps, lambda p, i: keys[i] IS NULL OR list_position(keys, keys[i]) = i), chr(10) || chr(10)) AS b FROM "
        f"(SELECT *, list_transform(ps, lambda p: {key}) AS keys FROM (SELECT *, str_split({t1}, chr(10) || chr(10)) AS ps FROM {documents()}))))"
    )


# -------------------------------------------------------------------- run logs
def over_limit() -> str:
    return (
        "SELECT event_id, user_id, n AS earlier, n >= 5 AS limited FROM (SELECT event_id, user_id, "
        "(SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND (o.ts < e.ts OR (o.ts = e.ts AND o.event_id < e.event_id)) "
        "AND o.ts > e.ts - INTERVAL 1 DAY) AS n FROM events e)"
    )


def enforced_limit() -> str:
    """The fold told event by event."""
    return (
        "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), "
        "f AS (SELECT event_id, user_id, k, [t] AS taken, true AS accepted FROM e WHERE k = 1 UNION ALL "
        "SELECT event_id, user_id, k, CASE WHEN len(live) < 5 THEN list_append(live, t) ELSE live END, len(live) < 5 FROM "
        "(SELECT e.*, list_filter(f.taken, lambda x: e.t - x < 86400000000) AS live FROM e JOIN f ON e.user_id = f.user_id AND e.k = f.k + 1)) "
        "SELECT event_id, user_id, accepted FROM f"
    )


def expired_sessions() -> str:
    return "SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE < TIMESTAMP '2024-01-10 00:00:00'"


def usage_counters() -> str:
    return "SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1"


def run_metrics() -> str:
    return (
        "SELECT (SELECT count(*) FROM events) AS total_runs, "
        "(SELECT round_even(avg(value), 2) FROM events) AS average_health_score, "
        "(SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_action, "
        "(SELECT count(*) FROM events WHERE event_type = 'view') AS primary_calls, "
        "(SELECT count(*) FROM events WHERE event_type <> 'view') AS fallback_calls"
    )


def request_summary() -> str:
    first, total = "floor(value * 0.25 * 1000) / 1000.0", "floor(value * 1.0 * 1000) / 1000.0"
    return (
        "SELECT event_type, count(*) AS total_requests, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS total_tokens, "
        "count(*) FILTER (WHERE event_type = 'error') AS failures, "
        "round(CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) / count(*), 3) AS success_rate, "
        f"round(avg(round_even({total}, 2)), 3) AS mean_latency_ms, round(avg(round_even({first}, 2)), 3) AS mean_first_token_ms, "
        f"round(avg(round_even({total} - {first}, 2)), 3) AS mean_stream_ms FROM events GROUP BY event_type"
    )


NAMES = (
    feature_importance, histogram_coerced, read_json_arrays, read_json_mixed, input_checks, payload_items,
    profile_columns, profile_summary, profile_roles, role_counts, column_roles, missing_by_column,
    missing_and_duplicates, outlier_counts, invalid_entries, inconsistent_formatting, class_imbalance,
    csv_line_breaks, run_round_trip,
    class_distribution, issues, health_score, health_explanation, semantic_types, clean_orders,
    clean_big_numbers, clean_late_fractions, clean_mixed_dates, clean_orders_removing, clean_shipments, cleaning_log, cleaning_strategies, column_impact, cleaning_impact,
    analytics_summary, analytics_numeric, analytics_categorical, top_values, analytics_datetime, missing_days,
    answer_metrics, correlation_pairs, correlation_matrix, leakage, feature_flags, target_summary,
    feature_suggestions, ml_readiness, insights, advanced_features, recommend_models, ml_advice, domain_detection,
    missing_bars, histogram, box_summary, distribution, totals, cleaning_recommendations, structured_plan,
    manual_actions, apply_plan, csv_round_trip, json_log_round_trip, route_intents, plan_modes, followups,
    last_messages, edit_messages, suggest_questions, search_messages, export_sections, join_chunks, text_guards,
    payload_flags, repair_responses, over_limit, enforced_limit, expired_sessions, run_metrics, request_summary,
    before_after, context_record, usage_counters,
)
ORACLES = {f.__name__: f() for f in NAMES}
