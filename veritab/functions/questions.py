"""Routing of questions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .exprs import contains_any

# --- fixed values -----------------------------------------------------------
# Keyword weights per intent, intents in order of priority.
INTENTS = {
    "Statistics": {
        "mean": 0.8, "median": 0.8, "mode": 0.8, "std": 0.7, "deviation": 0.7, "variance": 0.7, "skewness": 0.7,
        "kurtosis": 0.7, "min": 0.5, "max": 0.5, "stat": 0.6, "summary": 0.5, "average": 0.6, "percentile": 0.6,
        "quantiles": 0.6,
    },
    "Data Quality": {
        "quality": 0.8, "health": 0.8, "score": 0.6, "issue": 0.6, "anomaly": 0.6, "corrupt": 0.6, "audit": 0.6,
        "missing": 0.5, "null": 0.5, "outlier": 0.5, "duplicate": 0.5,
    },
    "Cleaning": {
        "clean": 0.8, "impute": 0.8, "preprocess": 0.7, "handling": 0.5, "treatment": 0.5, "fix": 0.4, "remove": 0.4,
        "auto-clean": 0.8, "autoclean": 0.8,
    },
    "Visualization": {
        "plot": 0.8, "chart": 0.8, "visualize": 0.8, "heatmap": 0.8, "correlation": 0.6, "graph": 0.6,
        "histogram": 0.7, "boxplot": 0.7, "distribution": 0.5,
    },
    "Feature Engineering": {
        "feature": 0.8, "engineering": 0.8, "transform": 0.6, "create": 0.5, "candidate": 0.5, "encode": 0.5,
        "scale": 0.5,
    },
    "Model Recommendation": {
        "model": 0.8, "algorithm": 0.8, "train": 0.7, "predict": 0.7, "xgboost": 0.6, "regression": 0.5,
        "classification": 0.5, "pipeline": 0.5, "evaluate": 0.5,
    },
    "Dataset Comparison": {
        "compare": 0.8, "comparison": 0.8, "versus": 0.6, "vs": 0.6, "difference": 0.4, "similarities": 0.4,
        "iris": 0.5, "titanic": 0.5,
    },
    "General Discussion": {"hello": 0.5, "hi": 0.5, "copilot": 0.4, "help": 0.4, "what is": 0.3, "how to": 0.3},
}
DEFAULT_INTENT = "General Discussion"
WEAKEST = 0.25
# Words per mode, modes in the order they are tried.
MODES = {
    "COMPARISON": (
        "compare", "comparison", "versus", "vs", "similarities", "differences", "titanic", "iris", "mnist",
        "california", "diabetes",
    ),
    "RECOMMENDATION": (
        "recommend", "suggest", "should i", "feature engineering", "preprocessing", "scaling", "encoding", "ml",
        "pipeline", "algorithm", "model", "prepare", "what next", "next step", "what should i do",
    ),
    "INSIGHT": (
        "why", "explain", "reason", "interpret", "cause", "perspective", "meaning", "insight", "discrepancy",
    ),
    "ANALYTICS": (
        "how many rows", "how many columns", "row count", "column count", "dataset size", "shape of",
        "how many duplicate", "number of duplicate", "duplicate count", "how many missing", "missing count",
        "number of missing", "null count", "nan count", "how many outliers", "outlier count", "show missing",
        "list columns", "what columns", "mean of", "average of", "std of", "standard deviation of", "variance of",
        "median of", "mode of", "skewness of", "kurtosis of", "datatype of", "type of", "cardinality of",
        "entropy of", "what is the mean", "what is the average", "what is the std", "what is the median",
        "what is the max", "what is the min", "statistics of", "summary of",
    ),
}
DEFAULT_MODE = "GENERAL"
# ----------------------------------------------------------------------------


def intents(question: Column) -> Column:
    """array<struct<intent, confidence>>, strongest first, ties by priority."""
    q = F.lower(question)
    scored = []
    for rank, (intent, words) in enumerate(INTENTS.items()):
        total = F.lit(0.0)
        for word, weight in words.items():
            total = total + F.when(F.contains(q, F.lit(word)), F.lit(weight)).otherwise(F.lit(0.0))
        confidence = F.round(F.least(F.lit(1.0), total), 2)
        scored.append(
            F.struct((-confidence).alias("order"), F.lit(rank).alias("rank"), F.lit(intent).alias("intent"))
        )
    found = F.array_sort(F.filter(F.array(*scored), lambda s: s["order"] < 0))
    listed = F.transform(found, lambda s: F.struct(s["intent"].alias("intent"), (-s["order"]).alias("confidence")))
    default = F.array(F.struct(F.lit(DEFAULT_INTENT).alias("intent"), F.lit(1.0).alias("confidence")))
    best = -F.get(found, 0)["order"]
    return F.when(F.coalesce(best, F.lit(0.0)) < WEAKEST, default).otherwise(listed)


def top_intent(question: Column) -> Column:
    return F.get(intents(question), 0)["intent"]


def mode(question: Column) -> Column:
    q = F.lower(question)
    chain = F.when(F.lit(False), F.lit(""))
    for name, words in MODES.items():
        chain = chain.when(contains_any(q, words), F.lit(name))
    return chain.otherwise(F.lit(DEFAULT_MODE))
