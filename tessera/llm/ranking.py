"""One ranking from several scores on unlike scales (problem 6).

Every score becomes a percentile within its group (share of the other items strictly below), each item's
percentiles are sorted ascending, and items are ordered by these vectors: first by the weakest score,
then the second weakest, and so on (leximin). A large range or a single high score cannot mask a weak one.

No group is sorted in one task: values are counted first, counts are added up over monotone buckets of
the values (of which there are at most a fixed number a group), and inside a bucket over distinct values.

Defined results: null and NaN lie below any number and equal each other; of several rows of an item the
latest counts, of equally late ones the greatest scores; equal vectors share a rank; the only item of a
group has percentile 0; rows with a null group or item are left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Fan-in of the elimination; three levels of it hold groups of 512 ** 3 items.
FAN = 512
#: Parts in which a group's rows look at its candidate.
SALTS = 16


def spread(c: Column) -> Column:
    """Monotone bucket of a double; at most about 47,000 different ones."""
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * 1e9) * 32).cast("long")


def places(counted: DataFrame, group: list[str], order: list[str], bucket: Column) -> DataFrame:
    """``counted`` (distinct order values of each group with their number ``n``) with ``before`` (rows ordered before
    the value) and ``total`` (rows of the group). ``bucket`` must not decrease along the order."""
    b = counted.withColumn("bucket", bucket)
    line = W.partitionBy(*group).orderBy("bucket")
    heads = (
        b.groupBy(*group, "bucket").agg(F.sum("n").alias("m"))
        .withColumn("lower", F.coalesce(F.sum("m").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("total", F.sum("m").over(W.partitionBy(*group)))
        .drop("m")
    )
    inside = W.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        b.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(heads, [*group, "bucket"])
        .withColumn("before", F.col("lower") + F.col("within"))
        .drop("bucket", "lower", "within", "n")
    )


def latest(df: DataFrame, group: str, item: str, scores: list[str], at: str) -> DataFrame:
    """One row of each group and item, by the latest ``at``."""
    values = F.struct(*[F.when(~F.isnan(c), F.col(c) + 0.0).alias(c) for c in scores])
    return (
        df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")).alias("at"), values.alias("v")).alias("o"))
        .where("grp is not null and item is not null")
        .groupBy("grp", "item").agg(F.max("o")["v"].alias("v"))
    )


def percentiles(rows: DataFrame, scores: list[str]) -> DataFrame:
    """``grp, item, total, pct`` where pct is the array of percentiles in the order of ``scores``."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(f"v.{c}").isNotNull().alias("known"), F.coalesce(f"v.{c}", F.lit(0.0)).alias("value")) for i, c in enumerate(scores)]))
    long = rows.select("grp", "item", each.alias("s")).select("grp", "item", "s.*")
    counted = long.groupBy("grp", "kind", "known", "value").agg(F.count("*").alias("n"))
    low = F.when(F.col("known"), spread(F.col("value"))).otherwise(F.lit(-(1 << 62)))
    ranked = places(counted, ["grp", "kind"], ["known", "value"], low)
    pct = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return (
        long.join(ranked, ["grp", "kind", "known", "value"])
        .groupBy("grp", "item").agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("kind", pct.alias("p")))).alias("p"))
        .select("grp", "item", "total", F.transform("p", lambda x: x["p"]).alias("pct"))
    )


def leximin(pct: DataFrame) -> DataFrame:
    """``pct`` with ``place``: 1 for the item whose ascending percentiles are lexicographically greatest."""
    rows = pct.withColumn("vec", F.array_sort("pct"))
    counted = rows.groupBy("grp", "vec").agg(F.count("*").alias("n"))
    cell = lambda i: F.floor(F.coalesce(F.get("vec", F.lit(i)), F.lit(0.0)) * 64).cast("long")
    ranked = places(counted, ["grp"], [F.desc("vec")], -(cell(0) * 65 + cell(1)))
    return rows.join(ranked.select("grp", "vec", (F.col("before") + 1).alias("place")), ["grp", "vec"]).drop("vec")


def beats(a: Column, b: Column, least: int) -> Column:
    """Whether percentiles ``a`` are strictly higher than ``b`` in at least ``least`` scores."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x > y), lambda x: x)) >= least


def may_win(least: int = 2) -> Column:
    """What the percentiles of an item strictly higher than all others in ``least`` of three scores fulfil: each rival is
    at or above it in one score at most, so its percentiles add up to 2 or more."""
    return (F.col("total") <= 1) | (F.aggregate("pct", F.lit(0.0), lambda a, x: a + x) >= least - 1e-6)


def undominated(pct: DataFrame, least: int = 2, among: Column | None = None) -> DataFrame:
    """The items strictly higher than each other item of their group in at least ``least`` scores; ``among`` may tell
    which ones can be (see :func:`may_win`).

    Items meet in leximin order, in a few levels of bounded groups: one that beats all others survives (the order does
    not decide who), which leaves at most one candidate a group, and a second look at all rows proves it.
    """
    me = F.struct(F.array_sort("pct").alias("vec"), "item", "pct")
    none = F.lit(None).cast("struct<vec:array<double>,item:string,pct:array<double>>")
    last = F.aggregate(F.sort_array("list", asc=False), none, lambda a, x: F.when(a.isNotNull() & beats(a["pct"], x["pct"], least), a).otherwise(x))
    wide = F.ceil(F.col("total") / FAN)
    level = (pct if among is None else pct.where(among)).select("grp", "total", F.pmod(F.xxhash64("item"), wide).alias("slot"), me.alias("c"))
    for _ in range(2):
        level = level.groupBy("grp", "total", "slot").agg(F.collect_list("c").alias("list")).select("grp", "total", "slot", last.alias("c"))
        level = level.withColumn("slot", F.floor(F.col("slot") / FAN))
    best = level.groupBy("grp").agg(F.collect_list("c").alias("list")).select("grp", last.alias("c"))
    # The second look is salted: a group may hold a third of all rows, and has one candidate.
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = (F.col("item") != F.col("c.item")) & ~beats(F.col("c.pct"), F.col("pct"), least)
    looked = pct.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")).join(best, ["grp", "salt"])
    parts = looked.groupBy("grp", "salt").agg(F.max("c.item").alias("item"), F.count_if(lost).alias("lost"))
    return parts.groupBy("grp").agg(F.max("item").alias("item"), F.sum("lost").alias("lost")).where("lost = 0").select("grp", "item")
