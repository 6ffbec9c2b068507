"""Follow-up questions on a stream: the memory of each conversation is the state.

What a question says by itself, and how a follow-up is worded, are the column expressions of the batch operator. The state
function sees neither texts nor patterns: it carries a few running values over flags and numbers, and says which sentence
each question becomes. A conversation without a question for some time is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as E
from ..operators import conversation as C
from ..operators.runs import SESSION_MINUTES

PLAIN, COMPARE, METRIC, CHART, SUMMARY = range(5)


@dataclass
class Memory:
    """Places in the lists of metrics, models and charts; -1: none yet."""

    last: int = -1
    compared: bool = False
    statistics: bool = False
    model: int = -1
    charts: str = ""  # places in the order in which they came up, comma-joined
    at: int = 0  # time of the newest question, in milliseconds


STATE = "last int, compared boolean, statistics boolean, model int, charts string, at long"


def _signals(asked: DataFrame) -> DataFrame:
    """Flags and numbers per question; ``counts_as`` tells for each sentence it may become if that is one of statistics.

    ``models`` and ``charts`` tell what those sentences name; a metric's own words name neither, so its sentence and the
    summary share a place.
    """
    df = C.read_questions(asked)
    target, subject, chart = F.col("target"), F.col("subject"), F.col("chart")
    by_metric = [C.is_statistics(C.metric_sentence(F.lit(m), subject)) for m in C.REMEMBERED_METRICS]
    wordings = [C.is_statistics(F.col("question")), C.is_statistics(C.compare_sentence(target)), C.is_statistics(C.chart_sentence(chart))]
    named = [F.lower(x) for x in (F.col("question"), C.compare_sentence(target), C.chart_sentence(chart), C.summary_sentence(subject))]

    def places(words) -> list:
        return [F.coalesce(C.first_mention(x, words), F.lit(-1)) for x in named]

    return df.select(
        "conv_id",
        "turn",
        *[c for c in ("at",) if c in df.columns],
        F.coalesce("ms", F.lit(0)).alias("ms"),
        "question",
        "target",
        "subject",
        "chart",
        F.coalesce("metric", F.lit(-1)).alias("metric"),
        F.col("benchmark").isNotNull().alias("mentions"),
        C.names_known(target).alias("known"),
        F.array(*wordings, *by_metric).alias("counts_as"),
        F.array(*places(C.REMEMBERED_MODELS)).alias("models"),
        F.array(*places(C.REMEMBERED_CHARTS)).alias("charts"),
    )


def _walk(rows: pd.DataFrame, m: Memory, idle_ms: int | None):
    """(sentence, metric, model, charts) per row, and the memory to carry on."""
    chosen = []
    last, compared, statistics, model, charts, at = astuple(m)
    for r in rows.itertuples():
        if idle_ms is not None and at and r.ms - at > idle_ms:
            last, compared, statistics, model, charts, _ = astuple(Memory())
        at = max(at, int(r.ms))
        sentence, metric_before = PLAIN, last
        follows = pd.notna(r.subject)
        if pd.notna(r.target) and (r.known or compared):
            sentence, follows = COMPARE, False
        elif follows:
            sentence = METRIC if last >= 0 else SUMMARY if statistics else PLAIN
        elif pd.notna(r.chart):
            sentence = CHART
        compared = compared or r.known or r.mentions
        if follows and metric_before < 0:  # nothing but its own words could end the run of statistics
            statistics = statistics or bool(r.counts_as[0])
        else:
            place = {PLAIN: 0, COMPARE: 1, CHART: 2, METRIC: 3 + metric_before}[sentence]
            statistics = bool(r.counts_as[place])
        if r.metric >= 0:
            last = min(last, r.metric) if follows and last >= 0 else r.metric
        says = {PLAIN: 0, COMPARE: 1, CHART: 2, METRIC: 3, SUMMARY: 3}[sentence]
        if r.models[says] >= 0:
            model = int(r.models[says])
        known = charts.split(",") if charts else []
        if r.charts[says] >= 0 and str(r.charts[says]) not in known:
            charts = ",".join([*known, str(r.charts[says])])
        chosen.append((sentence, metric_before, model, charts))
    return chosen, Memory(int(last), bool(compared), bool(statistics), model, charts, at)


def resolve_stream(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    at: str | None = None,
    idle_minutes: int = SESSION_MINUTES,
) -> DataFrame:
    """User questions in; out come resolved questions, the last model spoken of and the charts discussed so far.

    Turns of one micro-batch are taken in order. The state per conversation is six values, whatever its length. With ``at``,
    a timestamp under a watermark, a question more than ``idle_minutes`` after the one before starts afresh, wherever
    micro-batches end, and the state goes once the watermark has passed that time. Without ``at`` nothing is forgotten.
    """
    idle_ms = None if at is None else idle_minutes * 60_000
    when = [F.lit(0).cast("long").alias("ms")] if at is None else [E.quoted(at).alias("at"), F.unix_millis(E.quoted(at).cast("timestamp")).alias("ms")]
    asked = messages.where(E.quoted(role) == "user").select(
        E.quoted(conversation).alias("conv_id"),
        E.quoted(turn).alias("turn"),
        *when,
        F.coalesce(E.quoted(text), F.lit("")).alias("question"),
    )
    signals = _signals(asked)
    kinds = {f.name: f.dataType.simpleString() for f in signals.schema}
    given = ("conv_id", "turn", "question", "target", "subject", "chart")
    out = ", ".join(f"{c} {kinds[c]}" for c in given) + ", sentence int, last int, model int, charts string"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        chosen, memory = _walk(rows, Memory(*state.get) if state.exists else Memory(), idle_ms)
        if idle_ms is None:
            state.update(astuple(memory))
        elif memory.at + idle_ms >= state.getCurrentWatermarkMs():
            state.update(astuple(memory))
            state.setTimeoutTimestamp(memory.at + idle_ms + 1)
        elif state.exists:
            state.remove()
        yield rows[list(given)].assign(**dict(zip(("sentence", "last", "model", "charts"), zip(*chosen))))

    forgets = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    walked = signals.groupBy("conv_id").applyInPandasWithState(fold, out, STATE, "append", forgets)
    metric = F.get(F.array(*[F.lit(m) for m in C.REMEMBERED_METRICS]), F.col("last"))
    sentence = F.col("sentence")
    resolved = (
        F.when(sentence == COMPARE, C.compare_sentence(F.col("target")))
        .when(sentence == METRIC, C.metric_sentence(metric, F.col("subject")))
        .when(sentence == CHART, C.chart_sentence(F.col("chart")))
        .when(sentence == SUMMARY, C.summary_sentence(F.col("subject")))
        .otherwise(F.col("question"))
    )
    places = F.when(F.col("charts") != "", F.split("charts", ",").cast("array<int>")).otherwise(F.array().cast("array<int>"))
    return walked.select(
        "conv_id",
        "turn",
        "question",
        resolved.alias("resolved"),
        C.title_case(C.word_at(F.col("model"), C.REMEMBERED_MODELS)).alias("last_model"),
        F.transform(places, lambda i: C.word_at(i, C.REMEMBERED_CHARTS)).alias("discussed_charts"),
    )
