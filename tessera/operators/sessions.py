"""Turns of conversations, rate limits and retention."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import korean

# Beginnings of follow-up questions, and questions without a noun.
STARTERS = ["그럼", "그러면", "그건", "그거", "이건", "저건", "거기", "그때", "더 "]
SHORT = 15
NOUNLESS = r"^[가-힣]{0,3}(까지|어디|언제|누구|얼마|왜|뭐|무엇)[가-힣]*[?？]?$"
LIMIT, PERIOD = 20, 60.0


def is_follow_up(message: Column) -> Column:
    m = F.trim(message)
    starts = F.lit(False)
    for s in STARTERS:
        starts = starts | m.startswith(s)
    return (F.length(m) < SHORT) | starts | m.rlike(NOUNLESS)


def rewritten(turns: DataFrame) -> DataFrame:
    """``turns``: session_id, turn_id, at, message, ok. Adds ``search_text``: a follow-up is led by the first three
    content terms of the last answered question of its session; a failed turn does not become the last question.

    A null session has no past. Sessions are bounded by their lifetime, so a window per session is safe.
    """
    before = W.partitionBy("session_id").orderBy("at", "turn_id").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(F.col("ok"), F.substring("message", 1, 200)), ignorenulls=True).over(before)
    t = turns.withColumn("last", F.when(F.col("session_id").isNotNull(), last))
    # Normalised only where it is used.
    follow = is_follow_up(F.col("message")) & F.col("last").isNotNull()
    t = t.withColumn("lead", F.slice(korean.content_terms(korean.normalize(F.when(follow, F.col("last")))), 1, 3))
    whole = F.concat(F.array_join("lead", " "), F.lit(" "), F.trim("message"))
    return t.withColumn("search_text", F.when(F.size("lead") > 0, whole).otherwise(F.col("message"))).drop("last", "lead")


class Limiter:
    """Accepts an event unless ``limit`` accepted ones lie within ``period`` seconds before it; one exactly that old counts."""

    def __init__(self, limit: int = LIMIT, period: float = PERIOD, past: tuple[float, ...] = ()):
        self.limit, self.period, self.past = limit, period, deque(past)

    def accept(self, at: float) -> bool:
        while self.past and at - self.past[0] > self.period:
            self.past.popleft()
        if len(self.past) >= self.limit:
            return False
        self.past.append(at)
        return True


def rate_limited(events: DataFrame, user: str, event: str, at: str, limit: int = LIMIT, period: float = PERIOD) -> DataFrame:
    """``events`` with ``accepted``. Greedy per user, so order matters; but a pause longer than the period forgets
    everything, so users are split at pauses into islands, and the busiest user's events spread over many tasks.

    Null users share no limit: their events are all accepted. Null times are left out.
    """
    step = period * 1.0001 + 1e-3
    e = events.where(F.col(at).isNotNull()).withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")) / 1e6).withColumn("_slot", F.floor(F.col("_t") / step))
    line = W.partitionBy(user).orderBy("_slot")
    slots = e.where(F.col(user).isNotNull()).select(user, "_slot").distinct().withColumn("new", (F.col("_slot") - F.lag("_slot").over(line) != 1).cast("int"))
    islands = slots.withColumn("_island", F.sum(F.coalesce("new", F.lit(1))).over(line)).drop("new")
    placed = e.join(islands, [user, "_slot"]).repartition(user, "_island").sortWithinPartitions(user, "_island", "_t", event)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, limiter = None, None
        for pdf in parts:
            out = []
            for k, t in zip(zip(pdf[user], pdf["_island"]), pdf["_t"]):
                if k != key:
                    key, limiter = k, Limiter(limit, period)
                out.append(limiter.accept(t))
            yield pd.DataFrame({user: pdf[user], event: pdf[event], "accepted": out})

    types = {c: events.schema[c].dataType.simpleString() for c in (user, event)}
    done = placed.select(user, event, "_island", "_t").mapInPandas(run, f"{user} {types[user]}, {event} {types[event]}, accepted boolean")
    return done.unionByName(e.where(F.col(user).isNull()).select(user, event, F.lit(True).alias("accepted")))


def retained(log: DataFrame, kind: str, at: str, days: dict[str, int], today: str) -> DataFrame:
    """Rows not older than the days of their kind; a kind without a limit stays."""
    limit = F.lit(None).cast("int")
    for k, n in days.items():
        limit = F.when(F.col(kind) == k, n).otherwise(limit)
    return log.where(limit.isNull() | (F.datediff(F.lit(today).cast("date"), F.col(at).cast("date")) <= limit))
