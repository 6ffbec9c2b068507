"""What a query does not need is not measured, and quicker readings equal the single functions."""

import random

from pyspark.sql import functions as F

from veritab.functions import dates, exprs as E
from veritab.operators import analytics, charts, clean, profile
from veritab.config import CleanConfig
from veritab.operators.facts import TableFacts
from veritab.plans import manual, report


def same(a, b):
    return F.coalesce(a, F.lit(False)) == F.coalesce(b, F.lit(False))


def test_readings_equal_the_single_functions(spark):
    rng = random.Random(1)
    letters = list("0123456789+-.,$%eE /ftrueyesno\t\n\x0b\x1c\x85\xa0 ") + ["İ", "ſ", "K", "é", "😀"]
    texts = ["", "  ", " yes ", "TRUE", "1.0", "$1,234.50", " $5 ", "1995-01-01", " 1/2/95", "Jan 5, 2020", "5 March 2020", "12\n", "NaN", "1d", "\x1cno"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 8))) for _ in range(4000)]
    v = F.col("value")
    r = E.readings(spark.createDataFrame([(t,) for t in texts], "value string"), "value")
    equal = r["number"].eqNullSafe(E.to_number(v)) & r["loose"].eqNullSafe(E.to_number_loose(v)) & r["pair"].eqNullSafe(E.boolean_pair(v))
    equal = equal & same(r["date"], E.looks_like_date(v)) & same(r["plain"], v.rlike(E.PLAIN_NUMBER))
    equal = equal & E.strip(v).eqNullSafe(F.btrim(v, F.lit(E.BLANKS)))
    assert r.where(~equal).count() == 0


def table(spark):
    rows = [(i, f"t{i % 3}", i % 4 == 0, i * 0.5 if i % 5 else None) for i in range(40)]
    return spark.createDataFrame(rows, "id long, kind string, flag boolean, amount double")


def test_distribution_by_name_measures_nothing(spark):
    f = TableFacts(table(spark).withColumnRenamed("kind", "label"), "id")
    assert {(r.value, r["count"]) for r in charts.distribution(f).collect()} == {("t0", 14), ("t1", 13), ("t2", 13)}
    assert not {"_number_cells", "_text_cells", "values"} & set(f.__dict__)


def test_categories_need_no_numbers_and_count_false(spark):
    f = TableFacts(table(spark), "id")
    found = {r.column: r for r in analytics.analytics_categorical(f).collect()}
    assert (found["flag"].cardinality, found["flag"].entropy, found["flag"].class_imbalance) == (2, 0.81, "Moderate Imbalance (3.0:1)")
    assert found["kind"].cardinality == 3
    assert not {"_number_cells", "_text_cells", "values"} & set(f.__dict__)


def test_numbers_need_no_texts(spark):
    f = TableFacts(table(spark), "id")
    assert [r.column for r in analytics.analytics_numeric(f).collect()] == ["id", "amount"]
    assert "_text_cells" not in f.__dict__


def test_roles_and_plan_need_no_modes(spark):
    f = TableFacts(table(spark), "id")
    assert {r.column: r.role for r in profile.column_roles(f).collect()}["id"] == "identifier"
    assert [r.column for r in manual.structured_plan(f).collect()] == ["amount"]
    assert not {"values", "_text_leaders", "number_values"} & set(f.__dict__)


def test_report_makes_only_the_tables_asked_for(spark):
    made = report.Report(table(spark), "id")
    assert list(made.tables(["missing_bars"])) == ["missing_bars"]
    assert not {"cleaned", "after", "semantics"} & set(made.__dict__)


def dated(spark):
    rows = [(i, f"t{i % 3} " if i % 2 else "t1", None if i % 7 == 6 else f"2024-01-{1 + i % 28:02d}", i * 0.5 if i < 39 else 9000.0) for i in range(40)]
    return spark.createDataFrame(rows + rows[:2], "id long, kind string, order_date string, amount double")


def test_a_record_looks_at_dates_once_and_at_no_modes_of_raw_texts(spark, monkeypatch):
    seen, whole = [], dates.formats_read
    monkeypatch.setattr(dates, "formats_read", lambda df, columns: seen.extend(columns) or whole(df, columns))
    made = report.Report(dated(spark), "id")
    assert made.context("dated").count() == 1
    assert seen == ["order_date"]
    assert not {"values", "_text_leaders"} & set(made.raw.__dict__)


def test_cleaning_reads_texts_once(spark):
    f = TableFacts(dated(spark), "id")
    done = clean.clean(f, CleanConfig(outliers="remove"))
    assert done.df.count() == 39 and done.rows_after == 39
    assert {r.kind for r in done.df.collect()} == {"t0", "t1", "t2"} and done.df.where("order_date is null").count() == 0
    assert {(r.column, r.issue): r.affected_rows for r in done.log().collect()} == {
        (None, "Duplicate Rows"): 2, ("kind", "Whitespace Formatting"): 20, ("order_date", "DateTime Formatting"): 40,
        ("order_date", "Missing Values"): 5, ("amount", "Outliers"): 1,
    }
    assert not {"values", "_text_leaders", "outliers", "quartiles"} & set(f.__dict__)
