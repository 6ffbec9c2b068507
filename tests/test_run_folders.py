"""What a run leaves behind and reads back: report tables, counters, context of conversations."""

import json
import math
from concurrent.futures import ThreadPoolExecutor

import pytest

from veritab.operators import conversation
from veritab.plans.report import Report
from veritab.sources import counters, sinks


def totals(spark, root):
    return {r.key: r.n for r in counters.counts(spark, root).collect()}


def test_counters_add_up_and_count_a_batch_once(spark, tmp_path):
    root = str(tmp_path / "c")
    assert totals(spark, root) == {} and counters.compact(spark, root) == 0
    calls = spark.createDataFrame([("a", 2), ("a", None), ("b", 1), (None, 4)], "key string, n long")
    counters.add(calls, root, "q-0")
    counters.add(calls, root, "q-1", n="n")
    assert totals(spark, root) == {"a": 4, "b": 2, None: 5}
    assert counters.compact(spark, root) == 1 and counters.compact(spark, root) == 1
    counters.add(calls, root, "q-1", n="n")  # a retry after compaction
    assert totals(spark, root) == {"a": 4, "b": 2, None: 5}
    counters.add(calls.limit(0), root, "q-2")
    counters.add(calls, root, "q-3")
    assert totals(spark, root) == {"a": 6, "b": 3, None: 6}
    assert counters.compact(spark, root) == 2
    assert totals(spark, root) == {"a": 6, "b": 3, None: 6}
    with pytest.raises(ValueError):
        counters.add(calls, root, "x/y")


def test_a_batch_or_version_that_was_not_finished_does_not_count(spark, tmp_path):
    root = tmp_path / "c"
    one = spark.createDataFrame([("a",)], "key string")
    counters.add(one, str(root), "b0")
    counters.add(one, str(root), "b1")
    (root / "deltas/batch=b1/_SUCCESS").unlink()  # its writer was lost
    assert totals(spark, str(root)) == {"a": 1}
    counters.add(one, str(root), "b1")  # and tries again
    assert totals(spark, str(root)) == {"a": 2}
    one.selectExpr("key as batch").write.parquet(str(root / "taken/version=1"))  # a compaction that got no further
    assert totals(spark, str(root)) == {"a": 2}
    assert counters.compact(spark, str(root)) == 1 and totals(spark, str(root)) == {"a": 2}


def test_counters_with_writers_and_a_compactor_at_once(spark, tmp_path):
    root = str(tmp_path / "c")
    rows = spark.range(40).selectExpr("cast(id % 3 as string) as key")
    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(counters.add, rows, root, f"w{i}") for i in range(8)]
        jobs.append(pool.submit(counters.compact, spark, root))
        [j.result() for j in jobs]
    assert totals(spark, root) == {"0": 14 * 8, "1": 13 * 8, "2": 13 * 8}


def test_report_tables_come_back_as_they_were(spark, tmp_path):
    tables = {
        "kinds": spark.sql("select 1 as a, 2.5D as b, double('nan') as c, null as d, array('x', null) as e, timestamp'2024-01-02 03:04:05.678901' as f, 1.10BD as g, 'q\"\\n' as `h i`"),
        "none": spark.createDataFrame([], "x long, y string"),
    }
    sinks.write_tables(tables, str(tmp_path), "r1")
    kinds = sinks.read_table(spark, str(tmp_path), "r1", "kinds")
    assert kinds.drop("d").dtypes == tables["kinds"].drop("d").dtypes
    got, given = kinds.first(), tables["kinds"].first()
    assert math.isnan(got.c) and got.d is None
    assert [got[c] for c in ("a", "b", "e", "f", "g", "h i")] == [given[c] for c in ("a", "b", "e", "f", "g", "h i")]
    none = sinks.read_table(spark, str(tmp_path), "r1", "none")
    assert none.dtypes == tables["none"].dtypes and none.count() == 0


def test_whole_report_is_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"n{i % 3}", float(i % 7) if i % 5 else None) for i in range(60)], "id long, name string, v double")
    report = Report(df, "id")
    report.write(str(tmp_path), "r7")
    for name, table in report.tables().items():
        back = sinks.read_table(spark, str(tmp_path), "r7", name)
        assert back.dtypes == table.dtypes, name
        assert sorted(map(str, back.collect())) == sorted(map(str, table.collect())), name


MESSAGES = [
    (1, 0, "user", "What is the mean of age?"), (1, 1, "assistant", "It is 5."), (1, 2, "user", "show the same for price"),
    (1, 3, "user", "Explain the histogram chart"), (1, 4, "user", "would a random forest or a scatter plot do?"),
    (2, 0, "assistant", "hello"), (None, 0, "user", "compare with iris"),
]


def test_state_of_a_conversation(spark):
    m = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    state = {r.conv_id: r for r in conversation.current_state(m, keep=2).collect()}
    one = state[1].conversation_context
    assert one.last_statistic_metric == "mean" and one.previous_recommended_model == "Random Forest"
    assert one.discussed_charts == ["histogram", "scatter"]
    assert [x.turn for x in state[1].chat_history] == [3, 4]
    assert state[2].detected_intents is None or state[2].conversation_context is None
    assert [x.text for x in state[2].chat_history] == ["hello"]
    assert state[None].conversation_context.previous_comparison_dataset == "Iris"


def test_discussed_charts_over_blocks(spark):
    words = ["bar chart", "nothing", "heatmap", "scatter", "bar", "xgboost", "histogram", "lasso"]
    rows = [(k, t, "user", words[(t * 5 + (k or 0)) % len(words)]) for k in (1, 2, None) for t in range(40 if k == 1 else 6)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, blocks = conversation.resolve_followups(m), conversation.resolve_followups(m, block_rows=7)
    assert sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))


def test_context_record_is_json_per_conversation(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "id long, v double")
    m = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    records = {r.conv_id: json.loads(r.context) for r in Report(df, "id").contexts("t", m).collect()}
    assert records[1]["dataset_summary"]["rows"] == 30 and records[1]["dataset_summary"]["source"] == "t"
    assert records[1]["conversation_context"]["discussed_charts"] == ["histogram", "scatter"]
    assert [x["intent"] for x in records[1]["detected_intents"]]
    assert len(records[1]["chat_history"]) == 5 and "chat_history" in records[2]
