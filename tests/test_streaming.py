import os
import time

import pandas as pd
from pyspark.sql import functions as F

from veritab.streaming import limits, memory


def drain(stream, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.table(name)


def source(spark, pdf, schema, path):
    """Two files, so that state crosses a micro-batch."""
    df = spark.createDataFrame(pdf, schema)
    half = len(pdf) // 2
    for age, part in ((100, df.where(f"n < {half}")), (50, df.where(f"n >= {half}"))):
        known = set(path.glob("*.parquet")) if path.exists() else set()
        part.coalesce(1).write.mode("append").parquet(str(path))
        for file in set(path.glob("*.parquet")) - known:  # files are taken by age
            os.utime(file, (time.time() - age, time.time() - age))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_limit_stream(spark, tmp_path):
    at = pd.to_datetime([1000, 1010, 1020, 1030, 1070, 1075], unit="s")
    pdf = pd.DataFrame({"n": range(6), "user": [1] * 6, "at": at})
    stream = source(spark, pdf, "n long, user long, at timestamp", tmp_path / "in").withWatermark("at", "1 minute")
    out = drain(limits.enforce_limit_stream(stream, "user", "at", limit=2, window_seconds=60), "limited")
    assert {r.n: r.accepted for r in out.collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True}


def test_expiry_stream(spark, tmp_path):
    at = pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:05", "2024-01-01 02:00", "2024-01-01 04:00"])
    pdf = pd.DataFrame({"n": range(4), "session": ["a", "b", "c", "d"], "at": at})
    stream = source(spark, pdf, "n long, session string, at timestamp", tmp_path / "in").withWatermark("at", "1 minute")
    out = drain(limits.expire_stream(stream, "session", "at"), "expired")
    ended = {r.session: str(r.expires_at) for r in out.collect()}
    assert ended["a"] == "2024-01-01 00:30:00" and ended["b"] == "2024-01-01 00:35:00" and "d" not in ended


def test_followups_stream(spark, tmp_path):
    texts = ["What is the mean of price?", "What about Titanic?", "hello", "Show the same for age", "and Foo?", "show the same for x"]
    pdf = pd.DataFrame({"n": range(6), "conv_id": [1] * 6, "turn": range(6), "role": ["user"] * 6, "text": texts})
    schema = "n long, conv_id long, turn long, role string, text string"
    stream = source(spark, pdf, schema, tmp_path / "in")
    out = drain(memory.resolve_stream(stream), "resolved").orderBy("turn").collect()
    assert [r.resolved for r in out] == [
        "What is the mean of price?",
        "Compare the uploaded dataset with Titanic",
        "hello",
        "What is the mean of age?",
        "Compare the uploaded dataset with Foo",
        "What is the mean of x?",
    ]


def test_followups_stream_remembers_as_the_batch_does(spark, tmp_path):
    from veritab.operators import conversation

    texts = ["Recommend a random forest", "show a scatter plot", "Explain the correlation chart", "variance of age?",
             "show the same for bar", "try xgboost", "Explain the bar chart", "What about svm?", None, "histogram, scatter"]
    rows = [(i, i % 2, i, "user" if i != 5 else "assistant", t) for i, t in enumerate(texts + texts)]
    pdf = pd.DataFrame(rows, columns=["n", "conv_id", "turn", "role", "text"])
    schema = "n long, conv_id long, turn long, role string, text string"
    out = drain(memory.resolve_stream(source(spark, pdf, schema, tmp_path / "in")), "remembered")
    batch = conversation.resolve_followups(spark.createDataFrame(pdf, schema))
    fields = ["conv_id", "turn", "resolved", "last_model", "discussed_charts"]
    told = [tuple(r) for r in out.select(fields).orderBy("conv_id", "turn").collect()]
    expected = batch.withColumn("resolved", F.coalesce("resolved", F.lit(""))).select(fields).orderBy("conv_id", "turn")
    assert told == [tuple(r) for r in expected.collect()]
    assert told[-1][4] and len(told) == 19


def test_followups_stream_forgets(spark, tmp_path):
    at = pd.to_datetime([1000, 1600, 10_000, 10_060, 90_000, 90_001], unit="s")
    texts = ["What is the mean of a?", "show the same for b", "show the same for c", "What is the mode of d?", "hello", "show the same for e"]
    pdf = pd.DataFrame({"n": range(6), "conv_id": [1, 1, 1, 1, 2, 1], "turn": range(6), "role": ["user"] * 6, "text": texts, "at": at})
    schema = "n long, conv_id long, turn long, role string, text string, at timestamp"
    stream = source(spark, pdf, schema, tmp_path / "in").withWatermark("at", "1 minute")
    query = memory.resolve_stream(stream, at="at", idle_minutes=30).writeStream.format("memory").queryName("forgets")
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    said = {r.turn: r.resolved for r in spark.table("forgets").collect()}
    assert said[1] == "What is the mean of b?"
    assert said[2] == "show the same for c" and said[5] == "show the same for e"
    # the watermark ends near 90,000 s: conversation 1 as of 10,060 s has timed out or begun afresh
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert kept[-1] <= 2


def test_followups_stream_drops_state(spark, tmp_path):
    """A conversation that never speaks again leaves no state behind."""
    at = pd.to_datetime([1000, 1001, 50_000, 50_001], unit="s")
    pdf = pd.DataFrame({"n": range(4), "conv_id": [1, 2, 3, 3], "turn": range(4), "role": ["user"] * 4, "text": ["mean"] * 4, "at": at})
    schema = "n long, conv_id long, turn long, role string, text string, at timestamp"
    stream = source(spark, pdf, schema, tmp_path / "in").withWatermark("at", "1 minute")
    query = memory.resolve_stream(stream, at="at").writeStream.format("memory").queryName("dropped")
    query = query.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) >= 2 and kept[-1] == 1


def test_limit_holds_without_a_client(spark):
    at = pd.to_datetime([1000 + i for i in range(30)] * 2, unit="s")
    pdf = pd.DataFrame({"n": range(60), "user": pd.array([None] * 30 + [7] * 30, dtype="Int64"), "at": at})
    events = spark.createDataFrame([(r.n, None if pd.isna(r.user) else int(r.user), r.at.to_pydatetime()) for r in pdf.itertuples()], "n long, user long, at timestamp")
    out = limits.enforce_limit(events, "user", "at", "n", limit=5, window_seconds=3600).where("accepted").groupBy("user").count()
    assert {r.user: r["count"] for r in out.collect()} == {None: 5, 7: 5}
