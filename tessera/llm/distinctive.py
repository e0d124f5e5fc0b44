"""How characteristic a term is of its record (problem 3).

Divergence from randomness: the information content of the term's frequency under a geometric model of
the collection, times the Laplace after-effect gain, with the frequency normalised by length:

    tfn   = tf * log2(1 + c * average length / length)
    info  = log2(1 + F/N) + tfn * log2((1 + F/N) / (F/N))
    score = info / (tfn + 1)

F is the number of occurrences in the collection, N the number of records.

Defined results: null text or section counts as empty; a record without terms gives no rows but counts
in N; repeated deliveries count once (the latest, of equally late ones the greatest); null ids are left
out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.normal import nfkc_lower
from tessera.llm.terms import terms
from tessera.session import cut


def postings(df: DataFrame, record: str, parts: list[str], at: str) -> DataFrame:
    """``rec, term, tf, length``; a null term stands for the record itself (tf 0)."""
    text = nfkc_lower(F.concat_ws("\n", *[F.coalesce(F.col(p), F.lit("")) for p in parts]))
    latest = (
        df.select(F.col(record).alias("rec"), text.alias("t"), F.coalesce(F.col(at).cast("string"), F.lit("")).alias("at"))
        .where("rec is not null")
        .groupBy("rec").agg(F.max(F.struct("at", "t"))["t"].alias("t"))
    )
    listed = latest.withColumn("w", terms(F.col("t"))).select("rec", F.size("w").alias("length"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    # Rows are still partitioned by rec, so this needs no second shuffle.
    return listed.groupBy("rec", "term").agg(F.when(F.col("term").isNull(), 0).otherwise(F.count("*")).alias("tf"), F.first("length").alias("length"))


def scores(df: DataFrame, record: str, parts: list[str], at: str, c: float = 1.0) -> DataFrame:
    """``rec, term, tf, df, score`` for every term of every record."""
    p = cut(postings(df, record, parts, at), "postings")
    whole = p.where("term is null").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    stats = p.where("term is not null").groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    tfn = F.col("tf") * F.log2(1 + F.lit(c) * F.col("mean") / F.col("length"))
    rate = F.col("cf") / F.col("n")
    info = F.log2(1 + rate) + F.col("tfn") * F.log2((1 + rate) / rate)
    return (
        p.where("term is not null").join(stats, "term").crossJoin(F.broadcast(whole))
        .withColumn("tfn", tfn).select("rec", "term", "tf", "df", (info / (F.col("tfn") + 1)).alias("score"))
    )
