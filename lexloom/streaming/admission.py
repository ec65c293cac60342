"""Fixed 60-second admission windows per key, on tables and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.operators.scan import numbered

_OUT = "key string, minute timestamp, event_id long, ts timestamp, allowed boolean, remaining int"
_STATE = "used int"


def admit_batch(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Adds allowed, remaining and retry_after to each event; a limit of 0 or less lets all pass.

    The window is (key, minute). Events are numbered in ranges of (key, minute, ts), so a hot key's
    minute is spread over tasks.
    """
    second = F.second("ts")
    if limit <= 0:
        return events.withColumns(
            {"allowed": F.lit(True), "remaining": F.lit(limit), "retry_after": F.lit(0)}
        )
    placed = numbered(events, [key, F.date_trunc("minute", "ts").alias("minute")], ["ts", "event_id"], "_n")
    return placed.withColumns(
        {
            "allowed": F.col("_n") <= limit,
            "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("_n")),
            "retry_after": F.when(
                F.col("_n") > limit, F.greatest(F.lit(1), 60 - second)
            ).otherwise(0),
        }
    ).drop("_n")


def undecided(events: DataFrame, decided: DataFrame) -> DataFrame:
    """Events a stream never decided because they came after the watermark of their minute.

    To be written to a side table after a run, so that late rows are counted and can be replayed.
    """
    return events.join(decided.select("event_id"), "event_id", "left_anti")


def admit_stream(events: DataFrame, key: str, limit: int, delay: str = "2 minutes") -> DataFrame:
    """The same on a stream, in order of arrival. State is one number per key and minute and
    expires once the watermark has passed the minute. Later rows are left out; see ``undecided``."""

    def decide(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for pdf in batches:
            pdf = pdf.sort_values(["ts", "event_id"])
            allowed, remaining = [], []
            for _ in range(len(pdf)):
                ok = limit <= 0 or used < limit
                used += ok
                allowed.append(ok)
                remaining.append(limit if limit <= 0 else max(0, limit - used))
            yield pd.DataFrame(
                {
                    "key": group[0], "minute": group[1], "event_id": pdf["event_id"].to_numpy(),
                    "ts": pdf["ts"].to_numpy(), "allowed": allowed, "remaining": remaining,
                }
            )
        state.update((used,))
        end_ms = int(pd.Timestamp(group[1]).timestamp() * 1000) + 60_000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", delay).select(
        F.col(key).cast("string").alias("key"),
        F.date_trunc("minute", "ts").alias("minute"),
        "event_id",
        "ts",
    )
    return keyed.groupBy("key", "minute").applyInPandasWithState(
        decide, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
