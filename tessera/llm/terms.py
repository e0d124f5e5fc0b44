"""How often every distinct term occurs and in how many records (problem 1).

Counts are a persistent table, partitioned by a hash of the term, to which signed deltas are added: a
change of a record subtracts the terms of its text before and adds those of its text after. Reading
sums what was added; :meth:`TermCounts.compact` folds the generations into one. Nothing but the changed
records is ever tokenised again.

Defined results: a null text is no record (its terms and its count are 0), an empty text is a record
without terms; a repeated delivery changes nothing; null record ids are left out; empty tables give an
empty result; of several deliveries of a record the last one counts, of equally late ones the greatest
text; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.normal import nfkc_lower

#: A term is a longest run of at least two of these.
TERM = "[0-9a-z가-힣]{2,}"


def terms(normal: Column) -> Column:
    """Terms of an NFKC, lower-case text, repeats kept; null for null."""
    return F.regexp_extract_all(normal, F.lit(TERM), F.lit(0))


def deliveries(df: DataFrame, field: str, record: str, text: str, at: Column | None = None) -> DataFrame:
    """First and last delivered text of each record: ``field, rec, first, last``. Works with any number of repeats."""
    order = F.struct((at if at is not None else F.lit(0)).alias("at"), F.col("t"))
    return (
        df.select(F.col(record).alias("rec"), nfkc_lower(F.col(text)).alias("t"), *([at.alias("_at")] if at is not None else []))
        .where("rec is not null")
        .withColumn("o", F.struct(F.coalesce(F.col("_at").cast("string"), F.lit("")).alias("at"), "t") if at is not None else order)
        .groupBy("rec")
        .agg(F.min("o")["t"].alias("first"), F.max("o")["t"].alias("last"))
        .select(F.lit(field).alias("field"), "rec", "first", "last")
    )


def changes(df: DataFrame) -> DataFrame:
    """Deliveries as changes ``field, rec, before, after``: the first is an addition, a different last one a change."""
    step = lambda a, b: F.struct(a.alias("before"), b.alias("after"))
    none = F.lit(None).cast("string")
    steps = F.array(step(none, F.col("first")), step(F.col("first"), F.col("last")))
    return df.select("field", "rec", F.explode(steps).alias("c")).select("field", "rec", "c.*").where(~F.col("before").eqNullSafe(F.col("after")))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes between two states ``field, rec, text`` (normal form) of a collection; deleted records get a null ``after``."""
    a, b = old.withColumnRenamed("text", "before"), new.withColumnRenamed("text", "after")
    return a.join(b, ["field", "rec"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def signed(change: DataFrame) -> DataFrame:
    """Signed deltas ``field, term, occurrences, records``; a null term carries the number of records."""
    side = lambda c, s: F.struct(F.lit(s).alias("sign"), F.col(c).alias("text"))
    sides = change.select("field", "rec", F.explode(F.array(side("before", -1), side("after", 1))).alias("s")).where("s.text is not null")
    listed = sides.select("field", "rec", "s.sign", F.explode(F.concat(terms(F.col("s.text")), F.array(F.lit(None).cast("string")))).alias("term"))
    per_record = listed.groupBy("field", "rec", "sign", "term").agg(F.count("*").alias("n"))
    return (
        per_record.groupBy("field", "term")
        .agg(F.sum(F.col("sign") * F.col("n")).alias("occurrences"), F.sum(F.col("sign").cast("long")).alias("records"))
        .where("occurrences <> 0 or records <> 0")
    )


class TermCounts:
    """Counts in ``path/generation=N/bucket=B``; each generation holds deltas that sum up with the others."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _write(self, df: DataFrame, generation: int) -> None:
        (
            df.withColumn("bucket", F.pmod(F.xxhash64("field", "term"), F.lit(self.buckets)))
            .repartition(self.buckets, "bucket")
            .write.mode("error").partitionBy("bucket").parquet(f"{self.path}/generation={generation}")
        )

    def apply(self, change: DataFrame, generation: int) -> None:
        """Add the deltas of ``change`` as a generation; one that exists already is an error, so none counts twice."""
        self._write(signed(change), generation)

    def compact(self, generation: int, into: str) -> "TermCounts":
        """All generations as one, in another folder."""
        new = TermCounts(self.spark, into, self.buckets)
        new._write(self._sums(), generation)
        return new

    def _sums(self) -> DataFrame:
        schema = "field string, term string, occurrences bigint, records bigint, generation int, bucket int"
        # Term and field fix the bucket, so grouping by them is grouping inside a bucket.
        return (
            self.spark.read.schema(schema).parquet(self.path)
            .groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
            .where("records <> 0")
        )

    def counts(self, common: float = 0.1) -> DataFrame:
        """``field, term, occurrences, records, mark``: ``rare`` in one record only, else ``common`` in more than the share ``common``."""
        sums = self._sums()
        totals = sums.where("term is null").select("field", F.col("records").alias("total"))  # one row a field
        mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > F.col("total") * F.lit(common), "common")
        return sums.where("term is not null").join(F.broadcast(totals), "field").select("field", "term", "occurrences", "records", mark.alias("mark"))
