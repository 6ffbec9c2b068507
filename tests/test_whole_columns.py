"""Decisions are made from all values of a column, however late the odd ones come."""

from pyspark.sql import functions as F

from veritab.config import CleanConfig
from veritab.operators import analytics, features, runs
from veritab.operators.clean import clean
from veritab.operators.facts import TableFacts
from veritab.operators.semantics import infer_semantics

from checks import inputs as I


def cleaned(spark, rows, schema, **config):
    return clean(TableFacts(spark.createDataFrame(rows, schema), "pos"), CleanConfig(**config))


def test_whole_numbers_keep_their_digits(spark):
    big = 2**53 + 1
    rows = [(i, big + 2 * i if i % 50 else None) for i in range(600)]
    got = {r.pos: r.ticks for r in cleaned(spark, rows, "pos long, ticks long").df.collect()}
    assert all(got[i] == v for i, v in rows if v is not None) and all(v is not None for v in got.values())


def test_fractions_after_many_whole_numbers(spark):
    rows = [(i, float(i % 40) + (0.25 if i >= 100 else 0)) for i in range(600)]
    out = cleaned(spark, rows, "pos long, units double")
    assert out.semantics["units"].type == "Continuous Numeric"
    assert {(r.pos, r.units) for r in out.df.collect()} == set(rows)


def test_dates_in_several_formats(spark):
    rows = [(i, "15/01/2024" if i % 10 == 1 else "soon" if i % 100 == 2 else None if i % 100 == 3 else f"2024-01-{i % 28 + 1:02d}") for i in range(600)]
    out = cleaned(spark, rows, "pos long, day_date string")
    got = {r.pos: r.day_date and f"{r.day_date:%Y-%m-%d}" for r in out.df.collect()}
    assert out.df.columns == ["pos", "day_date"]
    assert all(got[i] == ("2024-01-15" if v == "15/01/2024" else v) for i, v in rows if v not in ("soon", None))
    assert all(got[i] is None for i, v in rows if v == "soon") and all(got[i] for i, v in rows if v is None)
    assert [(r.method, r.affected_rows) for r in out.log().filter("column = 'day_date'").orderBy("position").collect()] == [
        ("datetime_parse", 600), ("leave_empty", 6), ("ffill_bfill", 6),
    ]


def test_text_that_reads_as_numbers_late(spark):
    rows = [(i, "n/k" if i < 100 else f"${i},000") for i in range(1000)]
    assert infer_semantics(TableFacts(spark.createDataFrame(rows, "pos long, fee string"), "pos"))["fee"].is_numeric


def test_outlier_method_is_a_setting(spark):
    rows = [(i, float(i % 11) if i else 40.0) for i in range(200)]
    methods = {m: {r.method for r in cleaned(spark, rows, "pos long, v double", outlier_method=m).log().collect()} for m in ("iqr", "zscore")}
    assert methods == {"iqr": {"clip_iqr_bounds"}, "zscore": {"clip_zscore_bounds"}}


def test_day_gaps_over_any_span(spark):
    df = spark.sql("SELECT timestamp'1980-01-01' AS day_at UNION ALL SELECT timestamp'2024-01-01'")
    row = analytics.analytics_datetime(TableFacts(df)).first()
    assert (row.date_span_days, row.missing_dates_estimate) == (16_071, 16_070)


def test_importance_of_many_classes(spark):
    rows = [(float(i % 1500), f"c{i % 1500:04d}") for i in range(4500)]
    facts = TableFacts(spark.createDataFrame(rows, "x double, class_label string"))
    assert [r.feature for r in features.feature_importance(facts, "class_label").collect()] == ["x"]


def test_busy_client_counts_in_linear_time(spark):
    events = spark.range(200_000).select(F.lit("c").alias("client"), F.timestamp_millis("id").alias("at"))
    counted = runs.earlier_in_window(events, "client", "at", 100)
    assert counted.agg(F.count_if(F.col("earlier") == F.least(F.unix_millis("at"), F.lit(99_999)))).first()[0] == 200_000


def test_correlation_of_many_columns_is_one_scan(spark):
    df = spark.range(2000).select(*[F.rand(i).alias(f"c{i}") for i in range(60)]).withColumn("copy", F.col("c0") * 2 + 1)
    pairs = features.correlations(TableFacts(df))
    assert len(pairs) == 61 * 60 // 2 and abs(pairs[("c0", "copy")] - 1) < 1e-9


def test_views_hold_every_source_text(spark):
    sf = "/root/testdata/sf0.001"
    for table, view in (("documents", I.dirty_documents), ("conversations", I.dirty_conversations)):
        given = I.table(spark, sf, table).select(F.col("text").alias("t"))
        held = view(spark, sf).select("text")
        assert given.join(held, F.contains("text", "t"), "left_anti").count() == 0
