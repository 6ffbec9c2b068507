"""Run logs: limits, expiry, usage metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exprs as E
from .ordered import BLOCK_ROWS, per_key, running_before

# --- fixed values -----------------------------------------------------------
UPLOADS, UPLOAD_WINDOW = 20, 3600
REQUESTS, REQUEST_WINDOW = 100, 60
SESSION_MINUTES = 30
# ----------------------------------------------------------------------------


def earlier_in_window(
    events: DataFrame, client: str, at: str, window_seconds: int, tie: str | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Adds ``earlier``: attempts of the same client less than ``window_seconds`` before this one.

    Every attempt enters the count when it is made and leaves it a window later, before the attempts of that instant; so one
    running sum serves, however many attempts a window holds. A busy client's moves are cut into blocks, with totals
    carried from block to block. ``tie`` orders attempts of the same instant; without it they do not count each other.
    A null client is a client of its own.
    """
    micros = F.unix_micros(E.quoted(at).cast("timestamp"))
    made = events.withColumns({"__us": micros, "__kind": F.lit(1), "__step": F.lit(1)})
    leaving = made.select(E.quoted(client), (F.col("__us") + window_seconds * 1_000_000).alias("__us"), F.lit(0).alias("__kind"), F.lit(-1).alias("__step"))
    moves = made.unionByName(leaving, allowMissingColumns=True)
    instant = ["__us", "__kind"]

    def count(rows: DataFrame, block: str | None) -> DataFrame:
        rows = running_before(rows, [client], instant + ([] if tie is None else [tie]), "__step", "earlier", block)
        if tie is not None:
            return rows
        # attempts of one instant stand side by side: the first of them has none of the others before it
        part = [E.quoted(client)] + ([] if block is None else [F.col(block)])
        return rows.withColumn("earlier", F.min("earlier").over(Window.partitionBy(*part, *instant)))

    counted = per_key(moves, [client], instant + ([] if tie is None else [tie]), count, 2 * block_rows)
    return counted.where("__kind = 1").drop("__us", "__kind", "__step")


def over_limit(
    events: DataFrame,
    client: str,
    at: str,
    limit: int = UPLOADS,
    window_seconds: int = UPLOAD_WINDOW,
    tie: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every attempt with the number of earlier ones in its window, and whether that reaches the limit."""
    counted = earlier_in_window(events, client, at, window_seconds, tie, block_rows)
    return counted.withColumn("limited", F.col("earlier") >= limit)


def expired(sessions: DataFrame, created: str, as_of: Column, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Sessions past their end; access does not prolong them."""
    ends = E.quoted(created) + F.make_dt_interval(mins=F.lit(minutes))
    return sessions.withColumn("expires_at", ends).where(F.col("expires_at") < as_of)


def run_metrics(runs: DataFrame, actions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: runs, mean health, most common cleaning action (smallest of ties), calls by provider kind.

    runs(health_score), actions(action), calls(provider). Each is one row by the time they are put together.
    """
    total = runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.bround(F.avg("health_score"), 2), F.lit(0.0)).alias("average_health_score"),
    )
    per_action = actions.groupBy("action").agg(F.count("action").alias("n"))
    leader = F.min(F.struct((-F.col("n")).alias("o"), F.col("action")))["action"]
    common = per_action.agg(F.coalesce(leader, F.lit("None")).alias("most_common_action"))
    parts = total.unionByName(common, allowMissingColumns=True).unionByName(call_counts(calls), allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def call_counts(calls: DataFrame, primary: str = "primary") -> DataFrame:
    main = F.contains(F.lower("provider"), F.lit(primary))
    return calls.agg(F.count_if(main).alias("primary_calls"), F.count_if(~main).alias("fallback_calls"))


def request_log(log: DataFrame) -> DataFrame:
    """Latencies per request in milliseconds from started, first_token and ended; success means no errors."""
    def ms(a: str, b: str) -> Column:
        return F.bround((F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1000.0, 2)

    return log.withColumns(
        {
            "latency_ms": ms("started", "ended"),
            "first_token_latency_ms": ms("started", "first_token"),
            "stream_duration_ms": ms("first_token", "ended"),
            "success": F.col("errors") == 0,
        }
    )


def request_summary(log: DataFrame, by: list[str] = ()) -> DataFrame:
    """Requests, tokens, failures, success rate and mean latencies, in total or per group."""
    timed = request_log(log)
    failures = F.count_if(~F.col("success"))
    total = F.count(F.lit(1))
    return timed.groupBy(*by).agg(
        total.alias("total_requests"),
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        failures.alias("failures"),
        ((total - failures) / F.greatest(total, F.lit(1))).alias("success_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.avg("first_token_latency_ms").alias("mean_first_token_ms"),
        F.avg("stream_duration_ms").alias("mean_stream_ms"),
    )
