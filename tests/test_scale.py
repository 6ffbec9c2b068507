"""The parts that must hold beyond one task: selection, blocks, carried state."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from veritab.operators import conversation, ordered, runs
from veritab.operators.facts import TableFacts
from veritab.operators.quantiles import exact_quantiles
from veritab.streaming import limits, memory


def quantiles(df, name, listed):
    f = TableFacts(df)
    b = f.base[name]
    return exact_quantiles(f.df, {name: f.number(name)}, {name: (b.n_numeric, b.min, b.max)}, listed=listed)[name]


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "extreme", "constant"])
def test_quantiles_are_exact_through_every_round(spark, kind):
    rng = np.random.default_rng(7)
    data = {
        "normal": rng.normal(size=5000),
        "heavy": rng.pareto(0.3, size=5000),
        "ties": rng.integers(0, 3, size=5001).astype(float),
        "extreme": np.concatenate([rng.normal(size=3000), [1e300, -1e300]]),
        "constant": np.full(100, 3.5),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": data}))
    found = quantiles(df, "x", listed=3)
    assert list(found.values()) == pytest.approx(list(np.quantile(data, [0.25, 0.5, 0.75])), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=4, max_size=60))
def test_measures_equal_pandas(spark, xs):
    s = pd.Series(xs)
    f = TableFacts(spark.createDataFrame(pd.DataFrame({"x": s})))
    m = f.measured["x"]
    assert m.std == pytest.approx(s.std(), rel=1e-9, abs=1e-9)
    if s.std() > 1e-3:
        assert m.skewness == pytest.approx(s.skew(), rel=1e-6, abs=1e-6)
        assert m.kurtosis == pytest.approx(s.kurt(), rel=1e-6, abs=1e-6)
    assert f.quartiles["x"][0.5] == pytest.approx(s.median())
    assert f.values["x"].distinct == s.nunique()


def test_blocks_are_bounded_ordered_and_complete(spark):
    # two thirds of the order values sit in a thousandth of the range
    df = spark.range(3000).select(F.when(F.col("id") < 2000, F.col("id")).otherwise(F.col("id") * 1000).alias("at"))
    for name in ("at", "text"):
        blocked = ordered.in_blocks(df.withColumn("text", F.concat(F.lit("t"), F.lpad("at", 9, "0"))), [name], 30)
        counted = blocked.groupBy(F.col(ordered.BLOCK).alias("b")).agg(F.count("*").alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi"))
        rows = counted.orderBy("b").collect()
        assert sum(r.n for r in rows) == 3000 and len(rows) == 30 and max(r.n for r in rows) <= 300
        assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))


def test_only_large_keys_are_cut(spark):
    """One key holds two million rows beside many small ones: it alone is cut, into blocks of bounded size."""
    small = spark.range(60_000).select((F.col("id") % 20_000 + 1).alias("k"), F.col("id").alias("t"))
    df = spark.range(2_000_000).select(F.lit(0).cast("long").alias("k"), F.col("id").alias("t")).union(small).withColumn("one", F.lit(1))
    seen = {}

    def work(rows, block):
        seen[block] = rows
        return ordered.running_before(rows, ["k"], ["t"], "one", "n", block)

    got = ordered.per_key(df, ["k"], ["t"], work, 100_000)
    assert got.filter("k = 0 AND n <> t").isEmpty() and got.count() == 2_060_000
    assert got.groupBy("k").agg(F.max("n").alias("m"), F.count("*").alias("c")).filter("m <> c - 1").isEmpty()
    assert seen[None].filter("k = 0").isEmpty() and seen[ordered.BLOCK].filter("k <> 0").isEmpty()
    assert seen[ordered.BLOCK].groupBy(ordered.BLOCK).count().agg(F.max("count")).first()[0] < 250_000


def test_one_busy_client_over_many_tasks(spark):
    """All events are of one client, within one window: blocks share them, and the counts are exact."""
    df = spark.range(50_000).select(F.lit("c").alias("user"), F.timestamp_micros(F.lit(10**15) + F.col("id") * 1000).alias("at"), F.col("id"))
    got = runs.over_limit(df, "user", "at", 20, 3600, "id", block_rows=4_000)
    assert got.filter("earlier <> id").isEmpty() and got.filter("limited").count() == 50_000 - 20
    short = runs.over_limit(df, "user", "at", 20, 7, "id", block_rows=4_000)
    assert short.filter("earlier <> least(id, 6999)").isEmpty()
    nobody = df.limit(30).withColumn("user", F.lit(None).cast("string"))
    assert limits.enforce_limit(nobody, "user", "at", "id", 5).filter("accepted").count() == 5


@pytest.mark.parametrize("block_rows", [7, 1_000_000])
@pytest.mark.parametrize("text", [False, True])
def test_fill_in_order_equals_pandas(spark, block_rows, text):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"at": rng.permutation(500), "v": rng.normal(size=500), "w": rng.normal(size=500)})
    pdf.loc[rng.random(500) < 0.6, "v"] = np.nan
    pdf.loc[pdf["at"] < 40, "w"] = np.nan
    pdf.loc[pdf["at"] < 40, "w"] = np.nan
    if text:
        pdf["at"] = pdf["at"].map("n{:04d}".format)
    df = TableFacts(spark.createDataFrame(pdf)).df
    got = ordered.fill_in_order(df, ["v", "w"], "at", block_rows).toPandas().sort_values("at")
    want = pdf.sort_values("at").ffill().bfill()
    np.testing.assert_allclose(got[["v", "w"]].to_numpy(), want[["v", "w"]].to_numpy())


PHRASES = [
    "What is the mean of price?", "Show the same for age", "how about max speed?", "What about Titanic?", "and Foo Bar?",
    "Show summary stats", "hello there", "Explain the second graph", "what about skewness?", "try k-means set",
    "Compare with iris", "plot a histogram", "and revenue?",
]


def test_followups_by_blocks_windows_and_stream(spark, tmp_path):
    """One conversation holds a third of all turns; the three ways of carrying the memory agree."""
    rng = np.random.default_rng(3)
    rows = [(0, t, "user", PHRASES[rng.integers(len(PHRASES))]) for t in range(120)]
    rows += [(c, t, "user", PHRASES[rng.integers(len(PHRASES))]) for c in range(1, 31) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, blocks = (conversation.resolve_followups(df, block_rows=n).orderBy("conv_id", "turn").collect() for n in (1_000_000, 5))
    assert whole == blocks
    assert {r.resolved for r in whole} >= {"What is the mean of age?", "Compare the uploaded dataset with Titanic"}
    for part in range(3):  # three micro-batches
        df.where(f"turn div 40 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = memory.resolve_stream(stream).writeStream.format("memory").queryName("followed").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = spark.table("followed").orderBy("conv_id", "turn").collect()
    assert [r.resolved for r in streamed] == [r.resolved for r in whole]


@pytest.mark.parametrize("block_rows", [10, 1_000_000])
def test_limits_equal_the_fold(spark, block_rows):
    rng = np.random.default_rng(5)
    users = np.where(rng.random(900) < 0.4, 0, rng.integers(1, 20, 900))
    seconds = rng.integers(0, 40_000, 900)
    pdf = pd.DataFrame({"n": range(900), "user": users, "at": pd.to_datetime(seconds, unit="s")})
    df = spark.createDataFrame(pdf)
    limit, window = 3, 600
    got = limits.enforce_limit(df, "user", "at", "n", limit, window, block_rows).toPandas().set_index("n")["accepted"]
    raw = runs.earlier_in_window(df, "user", "at", window, "n").toPandas().set_index("n")["earlier"]
    accepted: dict = {}
    seen: dict = {}
    for n, user, at in pdf.sort_values(["at", "n"]).itertuples(index=False):
        live = [t for t in accepted.get(user, []) if (at - t).total_seconds() < window]
        assert raw[n] == sum((at - t).total_seconds() < window for t in seen.get(user, []))
        assert got[n] == (len(live) < limit), n
        accepted[user] = live + [at] if len(live) < limit else live
        seen.setdefault(user, []).append(at)


def test_wide_history_keeps_only_its_tail(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.lit("x").alias("text"))
    kept = conversation.last_messages(df).where("conv_id = 1").orderBy("turn").collect()
    assert [r.turn for r in kept] == list(range(961, 1000, 2)) and kept[0].parent_turn is None
    plan = conversation.last_messages(df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan  # the tail is cut before the shuffle
