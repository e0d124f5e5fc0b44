"""The ledger against a point-by-point brute force."""

import random
from datetime import datetime

from tessera.operators import history as h
from pyspark.sql import functions as F

SCHEMA = "doc_id string, snapshot_date string, version string, loaded_at timestamp, entity string"


def ledger_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return h.build(h.loads(df, "doc_id", "snapshot_date", "loaded_at", {"version": h.plain_version(F.col("version"))}))


def believed_by_hand(rows, at):
    last = {}
    for doc, day, version, loaded, _ in rows:
        if loaded <= at and (doc, day) not in last or loaded <= at and last[doc, day] < (loaded, version):
            last[doc, day] = (loaded, version)
    out = set()
    for doc, day in last:
        later = [d for x, d in last if x == doc and d > day]
        out.add((doc, last[doc, day][1], day, min(later, default=h.FOREVER)))
    return out


def test_every_belief_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [("HR-001" if rng.random() < 0.4 else f"D-{rng.randrange(6)}", f"2024-{rng.randrange(1, 13):02d}-01", f"1.{rng.randrange(3)}", datetime(2025, 1, rng.randrange(1, 28)), "clash") for _ in range(150)]
    ledger = ledger_of(spark, rows).cache()
    for day in (1, 4, 9, 15, 27):
        at = datetime(2025, 1, day, 12)
        got = {(r.entity, r.state.version, r.valid_from, r.valid_to) for r in h.believed(ledger, str(at)).collect()}
        assert got == believed_by_hand(rows, at)
    assert {(r.entity, r.state.version, r.valid_from, r.valid_to) for r in h.believed(ledger).collect()} == believed_by_hand(rows, datetime(2026, 1, 1))


def test_amend_equals_rebuild(spark):
    rng = random.Random(6)
    rows = [(f"D-{rng.randrange(5)}", f"2024-{rng.randrange(1, 13):02d}-01", f"1.{rng.randrange(3)}", datetime(2025, 1, 1 + i // 4), "x") for i in range(80)]
    first, rest = rows[:50], rows[52:60]
    attrs = {"version": h.plain_version(F.col("version"))}
    updates = h.loads(spark.createDataFrame(rest, SCHEMA), "doc_id", "snapshot_date", "loaded_at", attrs)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(h.amend(ledger_of(spark, first), updates)) == key(ledger_of(spark, first + rest))


def test_dirty_rows(spark):
    rows = [(None, "2024-01-01", "1.0", None, "a"), ("A", None, "1.0", None, "a"), ("A", "2024. 1. 5.", "ver.2.10 ", None, "a"), ("A", "2024. 1. 5.", "ver.2.10 ", None, "a"), ("A", "20240201", None, datetime(2024, 1, 1), None)]
    got = [tuple(r) for r in h.periods(h.believed(ledger_of(spark, rows)), ["version"]).orderBy("valid_from").collect()]
    assert got == [("A", "2.10", "2024-01-05", "2024-02-01"), ("A", None, "2024-02-01", h.FOREVER)]
    assert ledger_of(spark, []).count() == 0


def test_spellings(spark):
    row = spark.range(1).select(h.plain_day(F.lit("2026-4-9")), h.plain_day(F.lit(" ")), h.plain_day(F.lit("2026-04-09T00:00:00")), h.plain_version(F.lit("V3")), h.plain_reference(F.lit("HR-1 @ v2.1")), h.plain_reference(F.lit(None).cast("string"))).first()
    assert tuple(row) == ("2026-04-09", None, "2026-04-09", "3.0", "HR-1@2.1", None)
