"""Enforced rate limits and expiry, in batch and on streams.

Which attempts are accepted depends on which earlier ones were, so this is a fold per client.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import exprs as E
from ..operators.ordered import BLOCK_ROWS, per_key, running_before, same
from ..operators.runs import SESSION_MINUTES, UPLOAD_WINDOW, UPLOADS, earlier_in_window


def _acceptor(limit: int, width: int):
    """The fold over ascending times in microseconds. A closure, so that executors need not have this package."""

    def accept(times: list[int], accepted: list[int]) -> list[bool]:
        verdicts = []
        for t in times:
            while accepted and t - accepted[0] >= width:
                accepted.pop(0)
            verdicts.append(len(accepted) < limit)
            if verdicts[-1]:
                accepted.append(t)
        return verdicts

    return accept


def enforce_limit(
    events: DataFrame,
    client: str,
    at: str,
    tie: str,
    limit: int = UPLOADS,
    window_seconds: int = UPLOAD_WINDOW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``accepted``: fewer than ``limit`` accepted attempts of the client in the window before.

    An attempt with nothing in its window starts afresh, so a client's history splits into busy stretches that do not
    influence each other. Only stretches in which the raw count reaches the limit need the fold; all others are
    accepted as a whole and never leave the JVM. The fold reads its stretch batch by batch in time order and keeps no
    more than the last ``limit`` accepted times, so a long stretch never has to fit in memory.
    """
    width = window_seconds * 1_000_000
    micros = F.unix_micros(E.quoted(at).cast("timestamp"))
    counted = earlier_in_window(events, client, at, window_seconds, tie, block_rows)
    counted = counted.withColumns({"__us": micros, "__start": (F.col("earlier") == 0).cast("int")})
    order = ["__us", tie]
    marked = per_key(counted, [client], order, lambda rows, block: running_before(rows, [client], order, "__start", "__stretch", block), block_rows)
    marked = marked.withColumn("__stretch", F.col("__stretch") + F.col("__start")).drop("__start")
    busy = marked.where(F.col("earlier") >= limit).select(E.quoted(client).alias("__c"), F.col("__stretch").alias("__s")).distinct()
    marked = marked.join(busy.withColumn("__busy", F.lit(True)), same([client, "__stretch"], ["__c", "__s"]), "left").drop("__c", "__s")
    quiet = marked.where("__busy is null").withColumn("accepted", F.lit(True))
    columns = [*events.columns, "accepted"]
    accept = _acceptor(limit, width)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stretch, taken = None, []
        for pdf in batches:
            verdicts = []
            clients = pdf[client].astype(object).where(pdf[client].notna(), None)  # a NaN is not equal to itself
            for key, t in zip(zip(clients, pdf["__stretch"]), pdf["__us"].tolist()):
                if key != stretch:
                    stretch, taken = key, []
                verdicts += accept([t], taken)
            pdf["accepted"] = verdicts
            yield pdf[columns]

    schema = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])
    folded = (
        marked.where("__busy")
        .select(*[E.quoted(c) for c in events.columns], "__us", "__stretch")
        .repartition(E.quoted(client), F.col("__stretch"))
        .sortWithinPartitions(E.quoted(client), "__stretch", "__us", E.quoted(tie))
        .mapInPandas(fold, schema)
    )
    return quiet.select(*columns).unionByName(folded)


def enforce_limit_stream(
    events: DataFrame, client: str, at: str, limit: int = UPLOADS, window_seconds: int = UPLOAD_WINDOW
) -> DataFrame:
    """Streaming form: the state per client is the times of its last accepted attempts, at most ``limit`` of them.

    A client without attempts for a whole window is forgotten, driven by the watermark of the input.
    """
    width = window_seconds * 1_000_000
    stream = events.withColumn("__us", F.unix_micros(E.quoted(at).cast("timestamp")))
    out = T.StructType([*events.schema.fields, T.StructField("accepted", T.BooleanType())])
    columns = events.columns
    accept = _acceptor(limit, width)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("__us", kind="stable")
        rows["accepted"] = accept(rows["__us"].tolist(), accepted)
        state.update((accepted,))
        forget = int(rows["__us"].iloc[-1] // 1000) + window_seconds * 1000
        state.setTimeoutTimestamp(max(forget, state.getCurrentWatermarkMs() + 1))
        yield rows[[*columns, "accepted"]]

    return stream.groupBy(E.quoted(client)).applyInPandasWithState(
        step, out, "accepted array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def expire_stream(sessions: DataFrame, session: str, created: str, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Emits each session once, when the watermark passes its end."""
    out = T.StructType(
        [T.StructField(session, sessions.schema[session].dataType), T.StructField("expires_at", T.TimestampType())]
    )
    keep = sessions.select(E.quoted(session), E.quoted(created), F.unix_millis(E.quoted(created)).alias("__ms"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (end,) = state.get
            state.remove()
            yield pd.DataFrame({session: [key[0]], "expires_at": [pd.Timestamp(end, unit="ms")]})
            return
        first = min(int(b["__ms"].min()) for b in batches)
        end = min(state.get[0], first + minutes * 60_000) if state.exists else first + minutes * 60_000
        state.update((end,))
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    return keep.groupBy(E.quoted(session)).applyInPandasWithState(
        step, out, "ends long", "append", GroupStateTimeout.EventTimeTimeout
    )
