"""Conflicts between the documents of one answer, as windows over its few candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Ranks of authority and category.
AUTHORITY = {"취업규칙": 4, "사규": 3, "부서지침": 2, "안내문": 1}
TOP_CATEGORY = "규정·정책"


def version_key(c: Column) -> Column:
    """``major.minor`` as numbers that compare in order; ``[0]`` for anything else or null."""
    parts = F.transform(F.split(c, r"\."), lambda v: v.try_cast("int"))
    return F.when(c.isNull() | F.exists(parts, lambda v: v.isNull()), F.array(F.lit(0))).otherwise(parts)


def authority(c: Column) -> Column:
    rank = F.lit(1)
    for k, v in AUTHORITY.items():
        rank = F.when(c == k, v).otherwise(rank)
    return rank


def superseded(docs: DataFrame) -> DataFrame:
    """Ids named by another row's ``supersedes``."""
    return docs.where(F.trim("supersedes") != "").select(F.split_part(F.col("supersedes"), F.lit("@"), F.lit(1)).alias("doc_id")).distinct()


def resolve(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates that remain, with ``unresolved``. Needs ``id, doc_id, doc_version, category, subcategory,
    authority_level, published_at``. A single candidate is never questioned.

    Newest version of each document; without superseded documents unless that leaves none; where two documents
    share a subcategory, only the highest authority among all that remain; unresolved if several share the top.
    """
    w, own = W.partitionBy("id"), W.partitionBy("id", "doc_id")
    v = candidates.withColumn("v", version_key(F.col("doc_version"))).withColumn("many", F.count("*").over(w) > 1).withColumn("best", F.max("v").over(own))
    v = v.where(~F.col("many") | (F.col("v") == F.col("best")))
    v = v.join(superseded(docs).withColumn("old", F.lit(True)), "doc_id", "left").withColumn("left", F.bool_or(F.col("old").isNull()).over(w))
    v = v.where(~F.col("many") | F.col("old").isNull() | ~F.col("left"))
    docs_of = lambda x: F.size(F.collect_set("doc_id").over(x))
    v = v.withColumn("docs", docs_of(w))
    v = v.withColumn("same", docs_of(W.partitionBy("id", "subcategory")) > 1).withColumn("clash", F.bool_or("same").over(w) & (F.col("docs") > 1) & F.col("many"))
    v = v.withColumn("rank_a", authority(F.col("authority_level"))).withColumn("key", F.struct("rank_a", F.when(F.col("category") == TOP_CATEGORY, 2).otherwise(1).alias("c"), F.coalesce("published_at", F.lit("")).alias("p")))
    v = v.withColumn("top", F.max("key").over(w)).withColumn("differ", F.min("rank_a").over(w) != F.max("rank_a").over(w))
    v = v.where(~F.col("clash") | ~F.col("differ") | (F.col("rank_a") == F.col("top.rank_a")))
    tops = F.size(F.collect_set(F.when(F.col("key") == F.col("top"), F.col("doc_id"))).over(w))
    return v.withColumn("unresolved", F.col("clash") & (tops > 1)).drop("v", "many", "best", "old", "left", "docs", "same", "clash", "rank_a", "key", "top", "differ")
