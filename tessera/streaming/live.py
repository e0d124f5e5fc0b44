"""The stateful parts on streams: hourly metrics with a watermark, rate limit, query log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.functions import text
from tessera.operators.sessions import LIMIT, PERIOD, Limiter


def metrics(events: DataFrame, at: str, user: str, message: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, users (approximate), guard outcomes per window; rows later than the watermark are dropped by Spark."""
    s = text.scan(F.coalesce(F.col(message), F.lit("")))
    return (
        events.withWatermark(at, late).withColumn("_s", s).groupBy(F.window(at, window).alias("w"))
        .agg(F.count("*").alias("requests"), F.approx_count_distinct(user).alias("users"), F.count_if(F.col("_s.action") == "block").alias("blocked"), F.count_if(F.col("_s.action") == "mask").alias("masked"), F.count_if("_s.injection").alias("injections"))
        .select("w.start", "w.end", "requests", "users", "blocked", "masked", "injections")
    )


def query_log(events: DataFrame, at: str, user: str, message: str) -> DataFrame:
    """Log rows without the text: its fingerprint, the outcome and the user."""
    s = text.scan(F.col(message))
    code = F.when(F.coalesce(F.trim(message), F.lit("")) == "", "E_INPUT_EMPTY").when(F.length(message) > 500, "E_INPUT_TOO_LONG").when(s["action"].isin("block", "third_party"), "E_SENSITIVE_BLOCKED").otherwise("OK")
    return events.select(F.col(at).alias("at"), F.col(user).alias("employee_no"), text.fingerprint(F.coalesce(F.col(message), F.lit(""))).alias("query_hash"), code.alias("code"))


def rate_limited(events: DataFrame, user: str, event: str, at: str, limit: int = LIMIT, period: float = PERIOD, late: str = "10 minutes") -> DataFrame:
    """``user, event, accepted`` on a stream. State per user: the times of the accepted events of the last period; it
    goes when the watermark says that the user paused longer."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(limit, period, tuple(state.get[0]) if state.exists else ())
        rows = pd.concat(list(parts)).sort_values(["t", event])
        accepted = [limiter.accept(t) for t in rows["t"]]
        state.update((list(limiter.past),))
        state.setTimeoutTimestamp(max(int((rows["t"].max() + period) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({user: [key[0]] * len(rows), event: rows[event].to_numpy(), "accepted": accepted})

    u, e = events.schema[user].dataType.simpleString(), events.schema[event].dataType.simpleString()
    timed = events.where(F.col(user).isNotNull() & F.col(at).isNotNull()).withWatermark(at, late).select(user, event, at, (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"))
    return timed.groupBy(user).applyInPandasWithState(run, f"{user} {u}, {event} {e}, accepted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
