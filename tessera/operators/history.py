"""Bitemporal history of entity attributes from periodic snapshots.

A ledger row says: *from valid_from until valid_to the entity had these attributes, and that is what
was known from recorded_from until recorded_to*. A late or corrected snapshot never overwrites a row;
it closes the recorded period of the rows it supersedes and opens new ones beside them.

The sweep line runs over valid time from the last snapshot to the first and carries, per entity, only
the chain of later snapshots that are still the nearest known successor at some recorded time. The
chain has as many entries as there are late arrivals, so a row's split is a small array, not a group.

Defined results: rows without an entity id or a readable snapshot day are left out; a null load time
counts as earlier than all others; of loads with the same entity, day and load time the greatest
attribute values win, so repeated rows change nothing; an empty table gives an empty ledger; further
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FOREVER = "9999-12-31"


def plain_version(c: Column) -> Column:
    """``major.minor`` by the numbers in the text (minor 0 if missing); null without a number."""
    major = F.regexp_extract(c, r"(\d+)", 1)
    minor = F.regexp_extract(c, r"\d+\.(\d+)", 1)
    return F.when(major != "", F.concat_ws(".", major.cast("int").cast("string"), F.coalesce(F.nullif(minor, F.lit("")).cast("int"), F.lit(0)).cast("string")))


def plain_day(c: Column) -> Column:
    """ISO day of a date written with any of the usual separators or none; other text trimmed, blank null."""
    pattern = r"^\s*(\d{4})(?:\s*[-/.]\s*)?(\d{1,2})(?:\s*[-/.]\s*)?(\d{1,2})"
    y, m, d = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    return F.when(y != "", F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))).otherwise(F.nullif(F.trim(c), F.lit("")))


def plain_reference(c: Column) -> Column:
    """``ID@major.minor`` without stray blanks or a version prefix; blank null."""
    who = F.trim(F.split_part(c, F.lit("@"), F.lit(1)))
    version = plain_version(F.split_part(c, F.lit("@"), F.lit(2)))
    return F.when(F.trim(c) != "", F.concat_ws("@", who, version))


def loads(df: DataFrame, entity: str, day: str, loaded: str, attributes: dict[str, Column]) -> DataFrame:
    """Snapshots in the ledger's form ``(entity, day, loaded, state)``, one per entity, day and load time."""
    state = F.struct(*[c.alias(k) for k, c in attributes.items()])
    at = F.coalesce(F.unix_micros(F.col(loaded).cast("timestamp")), F.lit(0))
    return (
        df.select(F.col(entity).alias("entity"), plain_day(F.col(day)).alias("day"), at.alias("loaded"), state.alias("state"))
        .where("entity is not null and day is not null")
        .groupBy("entity", "day", "loaded")
        .agg(F.max("state").alias("state"))
    )


def _chains(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sweep over (entity, day descending): the later days that are at some time the nearest known one."""
    entity, chain = None, []
    for pdf in parts:
        out = []
        for who, day, seen in zip(pdf["entity"], pdf["day"], pdf["seen"]):
            if who != entity:
                entity, chain = who, []
            out.append([{"day": d, "seen": s} for d, s in reversed(chain)])
            while chain and chain[-1][1] >= seen:
                chain.pop()
            chain.append((day, seen))
        yield pd.DataFrame({"entity": pdf["entity"], "day": pdf["day"], "later": out})


def build(points: DataFrame) -> DataFrame:
    """Ledger of all loads: ``entity, state, valid_from, valid_to, recorded_from, recorded_to`` (null: still believed)."""
    by_point = W.partitionBy("entity", "day").orderBy("loaded")
    versions = (
        points.withColumn("before", F.lag(F.struct("state")).over(by_point))
        .where(F.col("before").isNull() | ~F.col("state").eqNullSafe(F.col("before.state")))
        .withColumn("superseded", F.lead("loaded").over(by_point))
        .drop("before")
    )
    arrivals = points.groupBy("entity", "day").agg(F.min("loaded").alias("seen"))
    chains = (
        arrivals.repartition("entity")
        .sortWithinPartitions("entity", F.desc("day"))
        .mapInPandas(_chains, "entity string, day string, later array<struct<day:string,seen:bigint>>")
    )
    inside = lambda e: (e["seen"] > F.col("loaded")) & (F.col("superseded").isNull() | (e["seen"] < F.col("superseded")))
    return (
        versions.join(chains, ["entity", "day"])
        .withColumn("cuts", F.reverse(F.filter("later", inside)))
        .withColumn("next", F.get(F.filter("later", lambda e: e["seen"] <= F.col("loaded")), F.lit(0))["day"])
        .withColumn(
            "piece",
            F.explode(
                F.arrays_zip(
                    F.concat(F.array(F.coalesce("next", F.lit(FOREVER))), F.transform("cuts", lambda e: e["day"])).alias("valid_to"),
                    F.concat(F.array("loaded"), F.transform("cuts", lambda e: e["seen"])).alias("recorded_from"),
                    F.concat(F.transform("cuts", lambda e: e["seen"]), F.array("superseded")).alias("recorded_to"),
                )
            ),
        )
        .select(
            "entity", "state", F.col("day").alias("valid_from"), "piece.valid_to",
            F.timestamp_micros("piece.recorded_from").alias("recorded_from"), F.timestamp_micros("piece.recorded_to").alias("recorded_to"),
        )
    )


def amend(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """The ledger after more loads (as from :func:`loads`). Only entities named in ``updates`` are swept again;
    the rows of all others pass through, and no row of an earlier belief is lost."""
    touched = updates.select("entity").distinct()
    known = (
        ledger.join(touched, "entity", "left_semi")
        .groupBy("entity", F.col("valid_from").alias("day"), F.unix_micros("recorded_from").alias("loaded"))
        .agg(F.max("state").alias("state"))
    )
    again = known.unionByName(updates.select("entity", "day", "loaded", "state")).groupBy("entity", "day", "loaded").agg(F.max("state").alias("state"))
    return ledger.join(touched, "entity", "left_anti").unionByName(build(again))


def believed(ledger: DataFrame, at: str | None = None) -> DataFrame:
    """Rows believed at a recorded time (now, if none is given)."""
    if at is None:
        return ledger.where("recorded_to is null")
    t = F.lit(at).cast("timestamp")
    return ledger.where((F.col("recorded_from") <= t) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > t)))


def periods(rows: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """Neighbouring periods with equal attributes become one: ``entity, attributes..., valid_from, valid_to``."""
    line = W.partitionBy("entity").orderBy("valid_from")
    return (
        rows.withColumn("before", F.lag(F.struct("state")).over(line))
        .where(F.col("before").isNull() | ~F.col("state").eqNullSafe(F.col("before.state")))
        .withColumn("valid_to", F.coalesce(F.lead("valid_from").over(line), F.lit(FOREVER)))
        .select("entity", *[F.col(f"state.{a}").alias(a) for a in attributes], "valid_from", "valid_to")
    )
