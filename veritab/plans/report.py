"""The whole job on one table: measure, judge, clean, measure again, advise."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..config import CleanConfig, materialise
from ..operators import advice, analytics, audit, charts, clean, conversation, features, profile, semantics
from ..operators.facts import TableFacts
from ..sources import sinks
from . import manual


class Report:
    """Lazy: each part is computed when first asked for, on facts that are measured once."""

    def __init__(self, df: DataFrame, order_by: str | None = None, config: CleanConfig = CleanConfig()):
        self.raw = TableFacts(df, order_by)
        self.config = config

    @cached_property
    def semantics(self) -> dict:
        return semantics.infer_semantics(self.raw)

    @cached_property
    def cleaned(self) -> clean.Cleaned:
        return clean.clean(self.raw, self.config)

    @cached_property
    def after(self) -> TableFacts:
        """Facts of the cleaned table; it is written once, so that measuring does not clean again, unless nothing changed."""
        done = self.cleaned
        if not done.modified and not self.raw.duplicate_rows:
            return self.raw.for_same_values(done.df)
        return TableFacts(materialise(done.df, "cleaned"), self.raw.order_by)

    @cached_property
    def readiness(self) -> dict:
        return features.readiness(self.after, self.semantics)

    def tables(self, names: list[str] | None = None) -> dict[str, DataFrame]:
        """The tables under ``names``, all by default; nothing is measured for the others."""
        raw, types = self.raw, lambda: self.semantics
        made = {
            "profile_summary": lambda: profile.profile_summary(raw),
            "profile_columns": lambda: profile.profile_columns(raw),
            "profile_roles": lambda: profile.profile_roles(raw),
            "issues": lambda: audit.issues(raw),
            "health": lambda: audit.health_score(raw),
            "health_explanation": lambda: audit.health_explanation(raw),
            "semantic_types": lambda: semantics.semantic_types(raw),
            "cleaning_log": lambda: self.cleaned.log(),
            "cleaning_strategies": lambda: self.cleaned.strategies(),
            "cleaning_impact": lambda: self.cleaned.impact(),
            "column_impact": lambda: self.cleaned.column_impact(),
            "cleaned_health": lambda: audit.health_score(self.after),
            "before_after": lambda: self.before_after(),
            "recommendations": lambda: manual.cleaning_recommendations(raw),
            "feature_suggestions": lambda: features.feature_suggestions(self.after, types()),
            "readiness": lambda: features.ml_readiness(self.after, types()),
            "insights": lambda: advice.insights(raw, self.readiness["score"]),
            "models": lambda: advice.recommend_models(raw),
            "advice": lambda: advice.ml_advice(raw),
            "analytics": lambda: analytics.analytics_summary(self.after),
            "missing_bars": lambda: charts.missing_bars(raw),
            "totals": lambda: charts.totals(raw),
        }
        return {n: made[n]() for n in (made if names is None else names)}

    def before_after(self) -> DataFrame:
        def figures(facts: TableFacts) -> tuple:
            return (
                facts.rows,
                sum(f.missing for f in facts.base.values()),
                facts.duplicate_rows,
                sum(o["iqr"] for o in facts.outliers.values()),
                audit.health(facts).score,
            )

        names = ("rows", "missing_cells", "duplicate_rows", "outliers", "health_score")
        rows = list(zip(names, map(float, figures(self.raw)), map(float, figures(self.after))))
        return profile.frame(self.raw, "measure string, before double, after double", rows)

    def context(self, source: str) -> DataFrame:
        """One JSON record of the table: figures and names, never rows."""
        impact = self.cleaned.impact().first().asDict()
        return advice.context_record(self.raw, source, self.readiness["score"], audit.health(self.after), impact)

    def contexts(self, source: str, messages: DataFrame) -> DataFrame:
        """One JSON record per conversation: the table's, with the conversation's intents, memory and last messages."""
        table = self.context(source).first().context
        state = conversation.current_state(messages)
        own = F.to_json(F.struct("detected_intents", "conversation_context", "chat_history"))
        return state.select("conv_id", F.concat(F.lit(table[:-1] + ", "), F.substring(own, 2, 2**31 - 1)).alias("context"))

    def write(self, root: str, run_id: str, names: list[str] | None = None) -> None:
        """Keep tables of the report, all unless ``names`` are given, under the run."""
        sinks.write_tables(self.tables(names or None), root, run_id)
