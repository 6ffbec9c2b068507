"""One query per operator, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from veritab.config import CleanConfig, scratch_path, scratch_root
from veritab.functions import text as X
from veritab.operators import advice, analytics, audit, charts, clean, conversation, features, profile, runs, semantics
from veritab.operators.facts import TableFacts
from veritab.plans import manual
from veritab.plans.report import Report
from veritab.sources import counters, readers, sinks

from . import inputs as I

SITUATION = {"health_score": 78, "readiness_score": 85, "missing": 8137, "outliers": 134, "cleaning_steps": 12}


def orders(spark, sf_dir) -> TableFacts:
    return TableFacts(I.dirty_orders(spark, sf_dir), "o_orderkey")


def facts(spark, sf_dir, name: str, order_by: str | None = None) -> TableFacts:
    return TableFacts(I.table(spark, sf_dir, name), order_by)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def both(spark, sf_dir, build, names=("dirty_orders", "lineitem")) -> DataFrame:
    """The same operator over the dirty orders and over lineitem, side by side."""
    parts = [build(orders(spark, sf_dir)), build(facts(spark, sf_dir, "lineitem", "l_orderkey"))]
    tagged = [p.withColumn("source", F.lit(n)) for p, n in zip(parts, names)]
    return tagged[0].unionByName(tagged[1])


MOMENTS = {"min": 4, "max": 4, "mean": 4, "median": 4, "std": 3, "skewness": 5}


def profile_columns(spark, sf_dir):
    return rounded(both(spark, sf_dir, profile.profile_columns), MOMENTS)


def profile_summary(spark, sf_dir):
    return both(spark, sf_dir, profile.profile_summary)


def profile_roles(spark, sf_dir):
    return profile.profile_roles(orders(spark, sf_dir))


def role_counts(spark, sf_dir):
    return profile.role_counts(orders(spark, sf_dir))


def column_roles(spark, sf_dir):
    return both(spark, sf_dir, profile.column_roles).drop("reason")


def missing_by_column(spark, sf_dir):
    return audit.missing_by_column(orders(spark, sf_dir))


def missing_and_duplicates(spark, sf_dir):
    return both(spark, sf_dir, audit.missing_and_duplicates)


def outlier_counts(spark, sf_dir):
    return both(spark, sf_dir, audit.outlier_counts)


def invalid_entries(spark, sf_dir):
    return audit.invalid_entries(orders(spark, sf_dir))


def inconsistent_formatting(spark, sf_dir):
    return audit.inconsistent_formatting(orders(spark, sf_dir))


def class_imbalance(spark, sf_dir):
    return rounded(audit.class_imbalance(orders(spark, sf_dir)), {"ratio": 6})


def class_distribution(spark, sf_dir):
    return audit.class_distribution(I.dirty_orders(spark, sf_dir), "class_label")


def issues(spark, sf_dir):
    return audit.issues(orders(spark, sf_dir))


def health_score(spark, sf_dir):
    return audit.health_score(orders(spark, sf_dir)).withColumn("suggestions", F.array_join("suggestions", " "))


def health_explanation(spark, sf_dir):
    return audit.health_explanation(orders(spark, sf_dir))


def semantic_types(spark, sf_dir):
    parts = [
        (n, semantics.semantic_types(f))
        for n, f in (
            ("dirty_orders", orders(spark, sf_dir)),
            ("lineitem", facts(spark, sf_dir, "lineitem", "l_orderkey")),
            ("events", facts(spark, sf_dir, "events", "event_id")),
            ("documents", facts(spark, sf_dir, "documents", "doc_id")),
        )
    ]
    out = None
    for name, part in parts:
        tagged = part.drop("reason").withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def clean_orders(spark, sf_dir):
    done = clean.clean(orders(spark, sf_dir)).df
    return rounded(done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")), {"o_totalprice": 4, "price_text": 4})


def clean_big_numbers(spark, sf_dir):
    """Whole numbers beyond 2^53 come out digit by digit."""
    return clean.clean(TableFacts(I.big_numbers(spark, sf_dir), "pos")).df


def clean_late_fractions(spark, sf_dir):
    """Fractions that show up only after many whole numbers stay."""
    return clean.clean(TableFacts(I.late_fractions(spark, sf_dir), "pos")).df


def clean_mixed_dates(spark, sf_dir):
    """Dates in two formats are read; what is no date is left empty, not filled."""
    done = clean.clean(TableFacts(I.mixed_dates(spark, sf_dir), "pos")).df
    return done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


def clean_orders_removing(spark, sf_dir):
    done = clean.clean(orders(spark, sf_dir), CleanConfig(outliers="remove")).df
    return rounded(done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")), {"o_totalprice": 4, "price_text": 4})


def clean_shipments(spark, sf_dir):
    """Late dates by median, free text and categories by 'Unknown', rows without identifier removed."""
    f = TableFacts(I.dirty_shipments(spark, sf_dir), "pos")
    done = clean.clean(f, CleanConfig(identifier_missing="remove_rows", outliers="flag")).df
    return done.withColumn("shipped_date", F.date_format("shipped_date", "yyyy-MM-dd HH:mm:ss"))


def cleaning_log(spark, sf_dir):
    return clean.clean(orders(spark, sf_dir)).log().drop("reason")


def cleaning_strategies(spark, sf_dir):
    return clean.clean(orders(spark, sf_dir)).strategies().select("column", "type", "confidence", "strategy")


def column_impact(spark, sf_dir):
    return clean.clean(orders(spark, sf_dir)).column_impact()


def cleaning_impact(spark, sf_dir):
    return clean.clean(orders(spark, sf_dir)).impact()


def analytics_summary(spark, sf_dir):
    return both(spark, sf_dir, analytics.analytics_summary)


def analytics_numeric(spark, sf_dir):
    out = rounded(both(spark, sf_dir, analytics.analytics_numeric), MOMENTS | {"q25": 4, "q50": 4, "q75": 4, "iqr": 4})
    # ten digits of the variance, whatever its size
    power = F.when(F.col("variance") > 0, F.floor(F.log10("variance"))).otherwise(F.lit(0))
    out = out.withColumn("variance_power", power.cast("long"))
    return out.withColumn("skewness", F.round("skewness", 2)).withColumn("variance", F.round(F.col("variance") / F.pow(F.lit(10.0), power), 9))


def analytics_categorical(spark, sf_dir):
    return both(spark, sf_dir, analytics.analytics_categorical)


def top_values(spark, sf_dir):
    return both(spark, sf_dir, analytics.top_values)


def analytics_datetime(spark, sf_dir):
    built = analytics.analytics_datetime(facts(spark, sf_dir, "orders", "o_orderkey"))
    dirty = analytics.analytics_datetime(orders(spark, sf_dir))
    return built.unionByName(dirty).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_date", "max_date")})


def missing_days(spark, sf_dir):
    days = analytics.missing_days(I.table(spark, sf_dir, "orders"), "o_orderdate")
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"))


def answer_metrics(spark, sf_dir):
    asked = I.dirty_conversations(spark, sf_dir).where("role = 'user'").select("conv_id", "turn", "text")
    answered = analytics.answer_metrics(asked, "text", orders(spark, sf_dir))
    said = F.when(~F.col("topic").isin("metric", "schema"), F.col("answer")).alias("answer")  # without texts of floating-point numbers
    return answered.select("conv_id", "turn", "topic", "column", "metric", F.round("value", 4).alias("value"), said)


def correlation_pairs(spark, sf_dir):
    return rounded(both(spark, sf_dir, features.correlation_pairs), {"correlation": 5})


def correlation_matrix(spark, sf_dir):
    return charts.correlation_matrix(facts(spark, sf_dir, "lineitem", "l_orderkey"))


def leakage(spark, sf_dir):
    doubled = I.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2 + F.col("o_custkey") % 7).alias("price_outcome")
    )
    return rounded(features.leakage(TableFacts(doubled, "o_orderkey")), {"correlation": 5})


def feature_flags(spark, sf_dir):
    parts = [("part", facts(spark, sf_dir, "part", "p_partkey")), ("dirty_orders", orders(spark, sf_dir))]
    tagged = [features.feature_flags(f).withColumn("source", F.lit(n)) for n, f in parts]
    return tagged[0].unionByName(tagged[1])


def target_summary(spark, sf_dir):
    return features.target_summary(orders(spark, sf_dir))


def feature_suggestions(spark, sf_dir):
    f = orders(spark, sf_dir)
    return features.feature_suggestions(f, semantics.infer_semantics(f)).drop("reason")


def ml_readiness(spark, sf_dir):
    f = orders(spark, sf_dir)
    return features.ml_readiness(f, semantics.infer_semantics(f))


def feature_importance(spark, sf_dir):
    joined = I.table(spark, sf_dir, "documents").join(I.table(spark, sf_dir, "labels"), "doc_id")
    inputs = joined.select("doc_id", "lang", "source", "n_chars", F.col("toxic").alias("toxic"), F.col("quality").alias("quality_label"))
    return features.feature_importance(TableFacts(inputs, "doc_id"), "quality_label")


def insights(spark, sf_dir):
    f = orders(spark, sf_dir)
    score = features.readiness(f, semantics.infer_semantics(f))["score"]
    return advice.insights(f, score)


def advanced_features(spark, sf_dir):
    f = orders(spark, sf_dir)
    return advice.advanced_features(f, semantics.infer_semantics(f)).select("feature_name", "confidence_score")


def recommend_models(spark, sf_dir):
    return advice.recommend_models(orders(spark, sf_dir))


def ml_advice(spark, sf_dir):
    out = advice.ml_advice(orders(spark, sf_dir))
    lists = ("models", "metrics", "preprocessing", "selection")
    return out.withColumns({c: F.array_join(c, " | ") for c in lists})


def domain_detection(spark, sf_dir):
    """Every event is a small record: its event type and the keys of its properties are the column names."""
    e = I.table(spark, sf_dir, "events")
    keys = F.map_keys(F.from_json("props", "map<string,string>"))
    named = F.concat(F.array(F.concat("event_type", F.lit("_ad")), F.lit("user_id")), keys)
    rows = e.select("user_id", F.explode(named).alias("column"))
    return advice.detect_domains(rows, "user_id", "column")


def missing_bars(spark, sf_dir):
    return charts.missing_bars(orders(spark, sf_dir))


def histogram(spark, sf_dir):
    out = charts.histogram(facts(spark, sf_dir, "lineitem", "l_orderkey"), "l_extendedprice")
    return rounded(out, {"lower": 4, "upper": 4})


def histogram_coerced(spark, sf_dir):
    """The histogram of a text column whose prices carry symbols."""
    return rounded(charts.histogram(orders(spark, sf_dir), "price_text"), {"lower": 4, "upper": 4})


def box_summary(spark, sf_dir):
    out = charts.box_summary(orders(spark, sf_dir), "o_totalprice")
    return rounded(out, {c: 4 for c in ("min", "q1", "median", "q3", "max", "whisker_low", "whisker_high")})


def distribution(spark, sf_dir):
    return both(spark, sf_dir, charts.distribution)


def totals(spark, sf_dir):
    return both(spark, sf_dir, charts.totals)


def cleaning_recommendations(spark, sf_dir):
    return manual.cleaning_recommendations(orders(spark, sf_dir))


def structured_plan(spark, sf_dir):
    return manual.structured_plan(orders(spark, sf_dir))


def manual_actions(spark, sf_dir):
    done, _ = manual.apply_actions(I.dirty_orders(spark, sf_dir), list(manual.ACTIONS), "o_orderkey")
    out = done.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))
    return rounded(out, {"o_totalprice": 4, "age": 4})


def apply_plan(spark, sf_dir):
    out = manual.apply_plan(orders(spark, sf_dir), ["order_date"])
    return rounded(out.withColumn("age", F.col("age").cast("double")), {"o_totalprice": 4, "age": 4})


def before_after(spark, sf_dir):
    """Written with other tables of the report under a run, and read back."""
    root = scratch_path(spark, "report")
    Report(I.dirty_orders(spark, sf_dir), "o_orderkey").write(root, "r1", ["before_after", "cleaned_health", "cleaning_log"])
    return sinks.read_table(spark, root, "r1", "before_after")


def context_record(spark, sf_dir):
    """Fields of the JSON records, read back from their text."""
    records = Report(I.dirty_orders(spark, sf_dir), "o_orderkey").contexts("dirty_orders", I.dirty_conversations(spark, sf_dir))
    fields = (
        "dataset_summary struct<rows: long, missing_values: long, duplicate_rows: long>, raw_health_score long, cleaned_health_score long, "
        "detected_intents array<struct<intent: string>>, conversation_context struct<previous_intent: string, last_statistic_metric: string, "
        "previous_comparison_dataset: string, previous_recommended_model: string, discussed_charts: array<string>>, "
        "chat_history array<struct<turn: long, role: string, text: string>>"
    )
    r = records.select("conv_id", F.from_json("context", fields).alias("r")).select("conv_id", "r.*")
    said = F.transform("chat_history", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    return r.select(
        "conv_id", "dataset_summary.rows", "dataset_summary.missing_values", "dataset_summary.duplicate_rows",
        F.col("raw_health_score").alias("raw_health"), F.col("cleaned_health_score").alias("cleaned_health"),
        F.array_join("detected_intents.intent", ",").alias("intents"),
        "conversation_context.previous_intent", F.col("conversation_context.last_statistic_metric").alias("last_metric"),
        F.col("conversation_context.previous_comparison_dataset").alias("last_comparison"),
        F.col("conversation_context.previous_recommended_model").alias("last_model"),
        F.array_join("conversation_context.discussed_charts", ",").alias("discussed_charts"),
        F.size("chat_history").cast("long").alias("messages"), F.md5(F.array_join(said, "\n")).alias("history"),
    )


def csv_round_trip(spark, sf_dir):
    root = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    path = sinks.write_run(I.dirty_orders(spark, sf_dir), root, "r1", "raw", "csv")
    return rounded(readers.read_csv(spark, path), {"o_totalprice": 4})


def csv_line_breaks(spark, sf_dir):
    """Whole texts with line breaks, quotes and gaps through a CSV file and back."""
    root = f"{scratch_root(spark)}/csv-{uuid.uuid4().hex}"
    texts = I.dirty_documents(spark, sf_dir).select("doc_id", F.concat(F.lit('a "b", '), "text").alias("text"))
    return readers.read_csv(spark, sinks.write_run(texts, root, "r1", "raw", "csv"))


def read_json_arrays(spark, sf_dir):
    """Events through files that hold one JSON array each, and back."""
    events = I.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = sinks.write_run(events, scratch_path(spark, "json"), "r1", "download", "json")
    return readers.read_json(spark, path, keep_mixed=False)


def read_json_mixed(spark, sf_dir):
    """A field that holds numbers, texts and flags: how many of each are read, and the type it is given."""
    e = F.col("event_id")
    v = F.when(e % 3 == 0, F.coalesce(F.col("value"), F.lit(0.0)).cast("string")).when(e % 3 == 1, F.concat(F.lit('"'), "event_type", F.lit('"')))
    line = F.concat(F.lit('{"event_id": '), e.cast("string"), F.lit(', "mixed": '), F.coalesce(v, F.lit("true")), F.lit("}"))
    path = scratch_path(spark, "mixed")
    I.table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    df = readers.read_json(spark, path)
    types = semantics.semantic_types(TableFacts(df, "event_id")).where("column = 'mixed'").select("type")
    kind = F.schema_of_variant("mixed")
    kind = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag").when(kind.rlike("DECIMAL|DOUBLE|BIGINT"), "number").otherwise(kind)
    return df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("count")).crossJoin(F.broadcast(types))  # one row


def input_checks(spark, sf_dir):
    """Which files of a folder may be read: those of one table as CSV, JSON and parquet."""
    root, nation = scratch_path(spark, "inputs"), I.table(spark, sf_dir, "nation")
    nation.write.mode("append").csv(root)
    nation.write.mode("append").json(root)
    nation.write.mode("append").parquet(root)
    found = readers.check_inputs(spark, root)
    return found.select(F.regexp_extract("path", r"([a-z]+)$", 1).alias("kind"), "verdict", (F.col("bytes") > 0).alias("filled")).distinct()


def payload_items(spark, sf_dir):
    """Texts with more words than a payload may have items."""
    return I.dirty_documents(spark, sf_dir).select("doc_id", X.too_many_items(F.split("text", " ")).alias("too_many"))


def run_round_trip(spark, sf_dir):
    """Raw data of a run as parquet, read again by its id."""
    root = f"{scratch_root(spark)}/run-{uuid.uuid4().hex}"
    sinks.write_run(I.dirty_orders(spark, sf_dir), root, "r1", "raw")
    return sinks.read_run(spark, root, "r1", "raw")


def json_log_round_trip(spark, sf_dir):
    root = f"{scratch_root(spark)}/log-{uuid.uuid4().hex}"
    sinks.append_log(issues(spark, sf_dir), root, "r1")
    return sinks.read_log(spark, root, "r1").select("column", "issue", "severity", "affected_rows")


def route_intents(spark, sf_dir):
    return conversation.route(I.dirty_conversations(spark, sf_dir)).drop("role")


def plan_modes(spark, sf_dir):
    return conversation.plan_modes(I.dirty_conversations(spark, sf_dir)).select("conv_id", "turn", "mode")


def followups(spark, sf_dir):
    out = conversation.resolve_followups(I.dirty_conversations(spark, sf_dir))
    return out.withColumn("discussed_charts", F.array_join("discussed_charts", ","))


def last_messages(spark, sf_dir):
    out = conversation.last_messages(I.dirty_conversations(spark, sf_dir), keep=4)
    return out.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1).cast("long")))


def edit_messages(spark, sf_dir):
    m = I.dirty_conversations(spark, sf_dir)
    edits = m.where("role = 'user' and turn % 4 = 2").select("conv_id", "turn", F.concat(F.lit("Edited: "), "text").alias("text"))
    out = conversation.edit_messages(m, edits)
    return out.withColumn("replaces_turn", F.coalesce("replaces_turn", F.lit(-1).cast("long")))


def suggest_questions(spark, sf_dir):
    return conversation.suggest_questions(I.dirty_conversations(spark, sf_dir), SITUATION)


def search_messages(spark, sf_dir):
    m = I.dirty_conversations(spark, sf_dir)
    out = m.where(X.contains_text(F.col("text"), "the"))
    return out.select(
        "conv_id",
        "turn",
        X.count_matches(F.col("text"), "the").alias("anywhere"),
        X.count_matches(F.col("text"), "the", whole_word=True).alias("words"),
        X.count_matches(F.col("text"), "The", case_sensitive=True).alias("exact"),
    )


def export_sections(spark, sf_dir):
    return conversation.export_sections(I.dirty_conversations(spark, sf_dir), "# Report\n\n")


def join_chunks(spark, sf_dir):
    m = I.table(spark, sf_dir, "conversations")
    return conversation.join_chunks(m, "conv_id", "turn", "text", 10_000, "\n\n").withColumn("segment", F.col("segment").cast("long"))


def text_guards(spark, sf_dir):
    t = F.col("text")
    return I.dirty_documents(spark, sf_dir).select(
        "doc_id",
        X.clean_prompt(t).alias("prompt"),
        X.clean_user_input(t).alias("user_input"),
        X.redact_injections(t).alias("content"),
    )


def payload_flags(spark, sf_dir):
    return I.dirty_documents(spark, sf_dir).select("doc_id", F.array_join(X.payload_problems(F.col("text")), ",").alias("problems"))


def repair_responses(spark, sf_dir):
    return I.dirty_documents(spark, sf_dir).select("doc_id", X.repair_response(F.col("text")).alias("text"))


def over_limit(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return runs.over_limit(e, "user_id", "ts", limit=5, window_seconds=86_400, tie="event_id").drop("ts")


def enforced_limit(spark, sf_dir):
    from veritab.streaming import limits

    e = I.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return limits.enforce_limit(e, "user_id", "ts", "event_id", limit=5, window_seconds=86_400).drop("ts")


def expired_sessions(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").select("event_id", "ts")
    as_of = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return runs.expired(e, "ts", as_of).select("event_id")


def run_metrics(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")
    return runs.run_metrics(
        e.select(F.col("value").alias("health_score")),
        e.select(F.col("event_type").alias("action")),
        e.select(F.when(F.col("event_type") == "view", "PrimaryModel").otherwise("Offline").alias("provider")),
    )


def usage_counters(spark, sf_dir):
    """Events counted in four batches, two of them compacted, one of them sent again after that."""
    e, root = I.table(spark, sf_dir, "events"), scratch_path(spark, "counters")
    parts = [e.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i) for i in range(4)]
    for i in (0, 1):
        counters.add(parts[i], root, f"b{i}", "event_type")
    counters.compact(spark, root)
    for i in (1, 2, 3):
        counters.add(parts[i], root, f"b{i}", "event_type")
    return counters.counts(spark, root).withColumnRenamed("n", "count")


def request_summary(spark, sf_dir):
    e = I.table(spark, sf_dir, "events")

    def after(share: float):
        return F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * share * 1000).cast("long"))

    log = e.select(
        "event_type",
        F.col("ts").alias("started"),
        after(0.25).alias("first_token"),
        after(1.0).alias("ended"),
        F.get_json_object("props", "$.k").cast("long").alias("tokens"),
        (F.col("event_type") == "error").cast("int").alias("errors"),
    )
    out = runs.request_summary(log, ["event_type"])
    return rounded(out, {c: 3 for c in ("success_rate", "mean_latency_ms", "mean_first_token_ms", "mean_stream_ms")})


ALL = [
    profile_columns, profile_summary, profile_roles, role_counts, column_roles, missing_by_column,
    missing_and_duplicates, outlier_counts, invalid_entries, inconsistent_formatting, class_imbalance,
    class_distribution, issues, health_score, health_explanation, semantic_types, clean_orders, clean_orders_removing,
    clean_big_numbers, clean_late_fractions, clean_mixed_dates,
    clean_shipments, cleaning_log, cleaning_strategies, column_impact, cleaning_impact, analytics_summary,
    analytics_numeric, analytics_categorical, top_values, analytics_datetime, missing_days, answer_metrics,
    correlation_pairs, correlation_matrix, leakage, feature_flags, target_summary, feature_suggestions, ml_readiness,
    feature_importance, insights, advanced_features, recommend_models, ml_advice, domain_detection, missing_bars,
    histogram, box_summary, distribution, totals, cleaning_recommendations, structured_plan, manual_actions,
    apply_plan, before_after, context_record, csv_round_trip, json_log_round_trip, route_intents, plan_modes,
    followups, last_messages, edit_messages, suggest_questions, search_messages, export_sections, join_chunks,
    csv_line_breaks, read_json_arrays, read_json_mixed, input_checks, payload_items, histogram_coerced, run_round_trip, text_guards, payload_flags, repair_responses, over_limit, enforced_limit, expired_sessions, run_metrics, usage_counters,
    request_summary,
]
QUERIES = {q.__name__: q for q in ALL}
