"""Batch jobs over message tables (conversation id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as E, questions as Q
from .ordered import BLOCK_ROWS, per_key, running_minima, segmented_min

# --- fixed values -----------------------------------------------------------
COMPARE_FOLLOW_UP = r"^(what about|how about|and|try|compare with)\s+([a-zA-Z0-9_\-\s]+)\??$"
COLUMN_FOLLOW_UP = r"^(show the same for|what about|how about|and)\s+([a-zA-Z0-9_\-\s]+)\??$"
CHART_FOLLOW_UP = (
    r"^(explain|describe|tell me about)\s+(the\s+)?"
    r"(first|second|third|fourth|1st|2nd|3rd|4th|correlation|boxplot|histogram|scatter|bar)\s+"
    r"(graph|chart|plot|heatmap)?\??$"
)
BENCHMARKS = ("titanic", "iris", "mnist", "housing", "california", "diabetes")
REMEMBERED_BENCHMARKS = ("titanic", "iris", "mnist", "california", "diabetes")
REMEMBERED_METRICS = (
    "mean", "median", "mode", "standard deviation", "variance", "skewness", "kurtosis", "min", "max", "quartiles", "iqr",
)
REMEMBERED_MODELS = (
    "xgboost", "random forest", "logistic regression", "linear regression", "ridge", "lasso", "elasticnet", "svm",
    "k-means",
)
REMEMBERED_CHARTS = ("correlation", "boxplot", "histogram", "scatter", "bar", "heatmap", "plot", "graph")
KEPT_MESSAGES = 20
RECENT_MESSAGES = 10
SUGGESTION_COUNT = 4
# Candidate questions: text, weight per intent, and the name of the condition that adds 3 points.
SUGGESTIONS = (
    ("Explain the health score breakdown", {"Data Quality": 5, "Cleaning": 3}, "health_below_80"),
    ("Which columns need further cleaning?", {"Data Quality": 4, "Cleaning": 5}, "has_gaps_or_outliers"),
    ("Explain dataset quality issues", {"Data Quality": 5, "General Discussion": 2}, "health_below_90"),
    ("Show cleaning impact and metrics", {"Cleaning": 5, "Data Quality": 3}, "was_cleaned"),
    ("Is this dataset ready for {task}?", {"Model Recommendation": 5, "Feature Engineering": 3}, "ready_below_90"),
    ("Recommend feature engineering steps", {"Feature Engineering": 5, "Model Recommendation": 3}, "ready_below_80"),
    ("Which evaluation metrics should I use?", {"Model Recommendation": 5}, "always"),
    ("Should I normalize or scale the numeric features?", {"Model Recommendation": 4, "Feature Engineering": 3}, "always"),
    ("Suggest a validation and training strategy", {"Model Recommendation": 5}, "always"),
    ("Suggest a complete ML pipeline", {"Model Recommendation": 4, "Feature Engineering": 4}, "always"),
    ("Compare with Titanic", {"Dataset Comparison": 5}, "not_titanic"),
    ("Compare with Iris", {"Dataset Comparison": 5}, "not_iris"),
    ("Which preprocessing steps differ?", {"Dataset Comparison": 4}, "always"),
    ("Show dataset summary statistics", {"Statistics": 5, "General Discussion": 3}, "always"),
    ("Show correlation heatmap visual", {"Statistics": 5, "Visualization": 5}, "always"),
    ("Explain dataset quality and health", {"General Discussion": 5}, "always"),
)
FALLBACK_SUGGESTIONS = (
    "Explain dataset quality and health",
    "Is this dataset ready for machine learning?",
    "What cleaning actions were applied?",
    "What model should I use?",
)
# ----------------------------------------------------------------------------


def route(messages: DataFrame, text: str = "text") -> DataFrame:
    """One row per question and intent, strongest first."""
    keep = [E.quoted(c) for c in messages.columns if c != text]
    routed = messages.select(*keep, F.posexplode(Q.intents(E.quoted(text))).alias("rank", "hit"))
    return routed.select(*keep, (F.col("rank") + 1).alias("rank"), "hit.intent", "hit.confidence")


def plan_modes(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.withColumn("mode", Q.mode(E.quoted(text)))


# -------------------------------------------------------------------- follow-ups
def title_case(c: Column) -> Column:
    """Upper-case the first letter after every non-letter."""
    return F.array_join(F.transform(F.split(F.lower(c), "(?<=[^a-z])"), F.initcap), "")


def first_mention(q: Column, words) -> Column:
    """Position in ``words`` of the first one, in list order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(q, F.lit(w)), F.lit(i)) for i, w in enumerate(words)])


def word_at(at: Column, words) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), at)


def read_questions(questions: DataFrame) -> DataFrame:
    """What each question says by itself: comparison target, subject, metric, benchmark and chart, NULL if not spoken of."""
    asked = E.strip(F.col("question"))
    q = F.lower(asked)
    target = title_case(E.strip(F.regexp_extract(q, COMPARE_FOLLOW_UP, 2)))
    subject = E.strip(F.regexp_extract(asked, "(?i)" + COLUMN_FOLLOW_UP, 2))
    return questions.withColumns(
        {
            "target": F.when(q.rlike(COMPARE_FOLLOW_UP), target),
            "subject": F.when(q.rlike(COLUMN_FOLLOW_UP), subject),
            "metric": first_mention(F.lower(F.col("question")), REMEMBERED_METRICS),
            "benchmark": first_mention(F.lower(F.col("question")), REMEMBERED_BENCHMARKS),
            "chart": F.when(q.rlike(CHART_FOLLOW_UP), F.regexp_extract(q, CHART_FOLLOW_UP, 3)),
        }
    )


def names_known(target: Column) -> Column:
    return F.coalesce(F.lower(target).isin(*BENCHMARKS), F.lit(False))


def is_statistics(text: Column) -> Column:
    return F.coalesce(Q.top_intent(text) == "Statistics", F.lit(False))


# --- fixed values: the sentences a follow-up is rewritten to ------------------
def compare_sentence(target: Column) -> Column:
    return F.concat(F.lit("Compare the uploaded dataset with "), target)


def metric_sentence(metric: Column, subject: Column) -> Column:
    return F.concat(F.lit("What is the "), metric, F.lit(" of "), subject, F.lit("?"))


def chart_sentence(chart: Column) -> Column:
    return F.concat(F.lit("Explain the "), chart, F.lit(" chart and its data distributions/relationships"))


def summary_sentence(subject: Column) -> Column:
    return F.concat(F.lit("Show statistics and summary for column "), subject)
# ----------------------------------------------------------------------------


def resolve_followups(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rewrite follow-up questions from what the conversation said before, and report the memory after each.

    The memory of a conversation is four running values. Each is a minimum that restarts at certain rows, an associative
    fold, so conversations are scanned with windows, and very long ones, these alone, in blocks side by side.
    """
    questions = messages.where(E.quoted(role) == "user").select(
        E.quoted(conversation), E.quoted(turn), E.quoted(text).alias("question")
    )
    return per_key(questions, [conversation], [turn], lambda rows, block: _resolved(rows, conversation, turn, block), block_rows)


def _resolved(questions: DataFrame, conversation: str, turn: str, block: str | None) -> DataFrame:
    keys = [conversation]
    df = read_questions(questions)

    # Has a comparison been made before? (0 = yes)
    known = names_known(F.col("target"))
    made = F.when(known | F.col("benchmark").isNotNull(), F.lit(0))
    df = segmented_min(df, keys, turn, made, F.lit(False), "compared", block)
    compares = F.col("target").isNotNull() & (known | F.col("compared_before").isNotNull())
    df = df.withColumn("compares", F.coalesce(compares, F.lit(False)))

    # Last metric spoken of: replaced by a new mention; a follow-up keeps the one earlier in the list.
    follows = F.col("subject").isNotNull() & ~F.col("compares")
    df = df.withColumn("follows", F.coalesce(follows, F.lit(False)))
    df = segmented_min(df, keys, turn, F.col("metric"), ~F.col("follows") & F.col("metric").isNotNull(), "last", block)

    resolved = (
        F.when(F.col("compares"), compare_sentence(F.col("target")))
        .when(
            F.col("follows") & F.col("last_before").isNotNull(),
            metric_sentence(word_at(F.col("last_before"), REMEMBERED_METRICS), F.col("subject")),
        )
        .when(F.col("chart").isNotNull() & ~F.col("follows"), chart_sentence(F.col("chart")))
        .otherwise(F.col("question"))
    )
    df = df.withColumn("resolved", resolved)

    # Was the question before one of statistics? Only follow-ups without a metric inherit the answer.
    inherits = F.col("follows") & F.col("last_before").isNull()
    statistical = F.when(is_statistics(F.col("resolved")), F.lit(0))
    df = segmented_min(df.withColumn("inherits", inherits), keys, turn, statistical, ~F.col("inherits"), "stats", block)
    generic = F.when(F.col("inherits") & F.col("stats_before").isNotNull(), summary_sentence(F.col("subject")))
    df = df.withColumn("resolved", F.coalesce(generic, F.col("resolved")))

    # Name of the last comparison: every mention replaces it. As a text it is carried like the others.
    named = F.coalesce(F.initcap(word_at(F.col("benchmark"), REMEMBERED_BENCHMARKS)), F.when(F.col("compares"), F.col("target")))
    df = segmented_min(df, keys, turn, named, named.isNotNull(), "comparison", block)

    # The last model spoken of, and every chart in the order in which they came up.
    low = F.lower(F.col("resolved"))
    df = df.withColumns({"model_at": first_mention(low, REMEMBERED_MODELS), "chart_at": first_mention(low, REMEMBERED_CHARTS)})
    df = segmented_min(df, keys, turn, F.col("model_at"), F.col("model_at").isNotNull(), "last_model_at", block)
    firsts = {f"__chart{i}": F.when(F.col("chart_at") == i, E.quoted(turn)) for i in range(len(REMEMBERED_CHARTS))}
    df = running_minima(df, keys, turn, firsts, block)
    came_up = F.array(*[F.struct(F.col(c).alias("at"), F.lit(w).alias("chart")) for c, w in zip(firsts, REMEMBERED_CHARTS)])
    discussed = F.transform(F.array_sort(F.filter(came_up, lambda x: x["at"].isNotNull())), lambda x: x["chart"])
    return df.select(
        *([] if block is None else [block]),
        E.quoted(conversation),
        E.quoted(turn),
        "question",
        "resolved",
        Q.top_intent(F.col("resolved")).alias("intent"),
        word_at(F.col("last"), REMEMBERED_METRICS).alias("last_metric"),
        F.col("comparison").alias("last_comparison"),
        title_case(word_at(F.col("model_at"), REMEMBERED_MODELS)).alias("model_mentioned"),
        word_at(F.col("chart_at"), REMEMBERED_CHARTS).alias("chart_mentioned"),
        title_case(word_at(F.col("last_model_at"), REMEMBERED_MODELS)).alias("last_model"),
        discussed.alias("discussed_charts"),
    )


def current_state(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    keep: int = KEPT_MESSAGES,
) -> DataFrame:
    """One row per conversation, as an answer to its last question needs it.

    ``detected_intents`` of that question as it was resolved, strongest first; ``conversation_context``, the memory after
    it; ``chat_history``, the last ``keep`` messages in order. A conversation that has no question has history only.
    """
    last = resolve_followups(messages, conversation, turn, role, text)
    memory = F.struct(
        F.col("intent").alias("previous_intent"),
        F.col("last_metric").alias("last_statistic_metric"),
        F.col("last_comparison").alias("previous_comparison_dataset"),
        F.col("last_model").alias("previous_recommended_model"),
        "discussed_charts",
    )
    newest = F.max_by(F.struct("resolved", memory.alias("memory")), E.quoted(turn)).alias("newest")
    asked = last.groupBy(E.quoted(conversation).alias("__asked")).agg(newest)
    message = F.struct(E.quoted(turn).alias("turn"), E.quoted(role).alias("role"), E.quoted(text).alias("text"))
    kept = last_messages(messages, conversation, turn, keep)
    history = kept.groupBy(E.quoted(conversation)).agg(F.array_sort(F.collect_list(message)).alias("chat_history"))
    joined = history.join(asked, E.quoted(conversation).eqNullSafe(F.col("__asked")), "left")
    return joined.select(
        E.quoted(conversation),
        Q.intents(F.col("newest.resolved")).alias("detected_intents"),
        F.col("newest.memory").alias("conversation_context"),
        "chat_history",
    )


# -------------------------------------------------------------------- history
def last_messages(
    messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", keep: int = KEPT_MESSAGES
) -> DataFrame:
    """The last messages of every conversation, each linked to the one before; the first kept has no parent.

    ``row_number() <= keep`` is applied per task before the shuffle, so a huge conversation sends only its tail.
    """
    back = Window.partitionBy(E.quoted(conversation)).orderBy(E.quoted(turn).desc())
    kept = messages.withColumn("__n", F.row_number().over(back)).where(F.col("__n") <= keep).drop("__n")
    forth = Window.partitionBy(E.quoted(conversation)).orderBy(E.quoted(turn))
    return kept.withColumn("parent_turn", F.lag(E.quoted(turn)).over(forth))


def edit_messages(
    messages: DataFrame, edits: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text"
) -> DataFrame:
    """Replace the edited message, drop what followed it, and remember which message was replaced.

    ``edits`` has (conversation, turn, text); with several edits of a conversation the earliest turn decides. An edit of
    a message that does not exist changes nothing.
    """
    first = F.min(F.struct(E.quoted(turn).alias("at"), E.quoted(text).alias("to"))).alias("edit")
    known = edits.join(messages.select(E.quoted(conversation), E.quoted(turn)), [conversation, turn], "left_semi")
    chosen = known.groupBy(E.quoted(conversation)).agg(first).select(E.quoted(conversation), "edit.at", "edit.to")
    joined = messages.join(chosen, conversation, "left").where(F.col("at").isNull() | (E.quoted(turn) <= F.col("at")))
    edited = F.coalesce(E.quoted(turn) == F.col("at"), F.lit(False))
    out = {
        text: F.when(edited, F.col("to")).otherwise(E.quoted(text)),
        "role": F.when(edited, F.lit("user")).otherwise(F.col("role")),
    }
    return joined.select(
        *[out[c].alias(c) if c in out else E.quoted(c) for c in messages.columns],
        edited.alias("edited"),
        F.when(edited, E.quoted(turn)).alias("replaces_turn"),
    )


def join_chunks(
    chunks: DataFrame, message: str, position: str, text: str, chunks_per_row: int, separator: str = ""
) -> DataFrame:
    """Ordered chunks to text, in segments of ``chunks_per_row`` positions: the caller says how much one row may hold."""
    segment = F.floor(E.quoted(position) / chunks_per_row).alias("segment")
    joined = F.expr(
        f"listagg(`{text}`, {_sql_text(separator)}) within group (order by `{position}`)"
    )
    return chunks.groupBy(E.quoted(message), segment).agg(joined.alias("text"), F.count(F.lit(1)).alias("chunks"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def export_sections(
    messages: DataFrame, header: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Conversation export as Markdown sections; the sections of a conversation, in order, are the document.

    One row per message rather than one string per conversation: a document then has no size limit and its writing
    is spread over tasks. Only the first turn of each conversation is aggregated.
    """
    starts = messages.groupBy(E.quoted(conversation)).agg(F.min(E.quoted(turn)).alias("__first"))
    speaker = F.when(E.quoted(role) == "user", F.lit("User Query")).otherwise(F.lit("Assistant"))
    begins = E.quoted(turn) == F.col("__first")
    lead = F.when(begins, F.lit(header + "---\n\n")).otherwise(F.lit("\n---\n\n"))
    section = F.concat(lead, F.lit("### "), speaker, F.lit("\n\n"), E.quoted(text), F.lit("\n\n"))
    return messages.join(starts, conversation).select(E.quoted(conversation), E.quoted(turn), section.alias("section"))


# -------------------------------------------------------------------- next questions
def _letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def suggest_questions(
    messages: DataFrame,
    situation: dict,
    domain: str = "General Tabular Dataset",
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Four next questions per conversation.

    ``situation``: health_score, readiness_score, target_type, missing, outliers, cleaning_steps. Which candidates a
    message rules out is one bit mask per message; masks of the last ten are or-ed, so texts are never gathered.
    """
    health, ready = situation.get("health_score", 100), situation.get("readiness_score", 50)
    holds = {
        "always": True,
        "health_below_80": health < 80,
        "health_below_90": health < 90,
        "has_gaps_or_outliers": situation.get("missing", 0) > 0 or situation.get("outliers", 0) > 0,
        "was_cleaned": situation.get("cleaning_steps", 0) > 0,
        "ready_below_90": ready < 90,
        "ready_below_80": ready < 80,
        "not_titanic": "titanic" not in domain.lower(),
        "not_iris": "iris" not in domain.lower(),
    }
    task = situation.get("target_type", "Classification").lower()
    candidates = [(t.replace("{task}", task), w, 3 if holds[c] else 0) for t, w, c in SUGGESTIONS]

    said = _letters(E.quoted(text))
    mask = F.lit(0)
    for i, (t, _, _) in enumerate(candidates):
        plain = "".join(ch for ch in t.lower() if ch.isascii() and ch.isalnum())
        spoken = F.contains(said, F.lit(plain)) | F.contains(F.lit(plain), said)
        mask = mask + F.when(spoken, F.lit(1 << i)).otherwise(F.lit(0))

    back = Window.partitionBy(E.quoted(conversation)).orderBy(E.quoted(turn).desc())
    recent = (
        messages.select(E.quoted(conversation), E.quoted(turn), mask.alias("mask"))
        .withColumn("n", F.row_number().over(back))
        .where(F.col("n") <= RECENT_MESSAGES)
        .groupBy(conversation)
        .agg(F.bit_or("mask").alias("mask"))
    )
    asked = messages.where(E.quoted(role) == "user").select(
        E.quoted(conversation), E.quoted(turn), Q.top_intent(E.quoted(text)).alias("intent")
    )
    last = asked.groupBy(conversation).agg(F.max_by("intent", turn).alias("intent"))
    state = recent.join(last, conversation, "left").withColumn("intent", F.coalesce("intent", F.lit(Q.DEFAULT_INTENT)))

    comparing = F.contains(F.lower("intent"), F.lit("comparison"))
    options = []
    for i, (t, weights, bonus) in enumerate(candidates):
        weight = F.coalesce(F.try_element_at(E.literal_map(weights), F.col("intent")), F.lit(0))
        boost = F.when(comparing, F.lit(2)).otherwise(F.lit(0)) if "compare" in t.lower() else F.lit(0)
        score = weight + bonus + boost
        free = F.col("mask").bitwiseAND(F.lit(1 << i)) == 0
        options.append(F.when(free, F.struct((-score).alias("order"), F.lit(i).alias("i"), F.lit(t).alias("t"))))
    best = F.slice(F.array_sort(F.filter(F.array(*options), lambda o: o.isNotNull())), 1, SUGGESTION_COUNT)
    chosen = F.transform(best, lambda o: o["t"])
    spare = F.array(*[F.lit(t) for t in FALLBACK_SUGGESTIONS])
    four = F.slice(F.concat(chosen, F.array_except(spare, chosen)), 1, SUGGESTION_COUNT)
    out = state.select(E.quoted(conversation), F.col("intent"), F.posexplode(four).alias("rank", "suggestion"))
    return out.withColumn("rank", F.col("rank") + 1)
