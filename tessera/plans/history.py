"""Queries on the history of document attributes (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history
from tessera.sources.tables import table

ATTRIBUTES = {
    "version": history.plain_version,
    "published_at": history.plain_day,
    "valid_until": history.plain_day,
    "supersedes": history.plain_reference,
}


def registry_loads(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "doc_registry", "doc_id", "snapshot_date", "loaded_at", *ATTRIBUTES)
    return history.loads(df, "doc_id", "snapshot_date", "loaded_at", {k: f(F.col(k)) for k, f in ATTRIBUTES.items()})


def p5_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The whole bitemporal ledger, superseded beliefs included."""
    return history.build(registry_loads(spark, root)).select(F.col("entity").alias("doc_id"), "state.*", "valid_from", "valid_to", "recorded_from", "recorded_to")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Periods in which the attributes of a document kept their values, as believed now."""
    ledger = history.build(registry_loads(spark, root))
    return history.periods(history.believed(ledger), list(ATTRIBUTES)).select(F.col("entity").alias("doc_id"), "version", "valid_from", "valid_to")


def p5_periods(spark: SparkSession, root: str) -> DataFrame:
    """As ``p5_found``, with all four attributes."""
    ledger = history.build(registry_loads(spark, root))
    return history.periods(history.believed(ledger), list(ATTRIBUTES)).withColumnRenamed("entity", "doc_id")


_DAY = r"case when regexp_matches({c}, '^\s*\d{{4}}(?:\s*[-/.]\s*)?\d{{1,2}}(?:\s*[-/.]\s*)?\d{{1,2}}') then concat_ws('-', regexp_extract({c}, '{p}', 1), lpad(regexp_extract({c}, '{p}', 2), 2, '0'), lpad(regexp_extract({c}, '{p}', 3), 2, '0')) else nullif(trim({c}), '') end"
_P = r"^\s*(\d{4})(?:\s*[-/.]\s*)?(\d{1,2})(?:\s*[-/.]\s*)?(\d{1,2})"
_VERSION = r"case when regexp_matches({c}, '\d') then concat(cast(regexp_extract({c}, '(\d+)', 1) as int), '.', coalesce(cast(nullif(regexp_extract({c}, '\d+\.(\d+)', 1), '') as int), 0)) end"


def _day(c: str) -> str:
    return _DAY.format(c=c, p=_P)


_PERIODS = f"""
with plain as (
  select doc_id, {_day('snapshot_date')} as day, loaded_at, {_VERSION.format(c='version')} as version, {_day('published_at')} as published_at,
    {_day('valid_until')} as valid_until,
    case when trim(supersedes) <> '' then concat_ws('@', trim(split_part(supersedes, '@', 1)), {_VERSION.format(c="split_part(supersedes, '@', 2)")}) end as supersedes
  from doc_registry where doc_id is not null and snapshot_date is not null),
last_load as (
  select * from plain qualify row_number() over (partition by doc_id, day order by loaded_at desc nulls last, version desc, published_at desc, valid_until desc, supersedes desc) = 1),
marked as (
  select *, row_number() over w as rn, lag(version) over w as v0, lag(published_at) over w as p0, lag(valid_until) over w as u0, lag(supersedes) over w as s0
  from last_load window w as (partition by doc_id order by day)),
starts as (
  select * from marked where rn = 1 or version is distinct from v0 or published_at is distinct from p0 or valid_until is distinct from u0 or supersedes is distinct from s0)
select doc_id, version, @EXTRA@ day as valid_from, coalesce(lead(day) over (partition by doc_id order by day), '9999-12-31') as valid_to from starts
"""

QUERIES = {"p5_found": p5_found, "p5_periods": p5_periods, "p5_ledger": p5_ledger}
SQL = {"p5_found": _PERIODS.replace("@EXTRA@", ""), "p5_periods": _PERIODS.replace("@EXTRA@", "published_at, valid_until, supersedes,")}
