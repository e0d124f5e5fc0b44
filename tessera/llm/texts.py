"""Text columns of several tables as one: ``field, rec_id, text``, and operators that turn a text into rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(df: DataFrame, name: str, rec: Column, text: str, at: str | None = None) -> DataFrame:
    """One row of each record: the latest delivery with a text (of equally late ones the greatest text).
    Records without an id or any text are left out."""
    when = F.coalesce(F.col(at).cast("string"), F.lit("")) if at else F.lit("")
    return (
        df.select(rec.alias("rec_id"), F.struct(when.alias("at"), F.col(text).alias("text")).alias("o"))
        .where("rec_id is not null and o.text is not null")
        .groupBy("rec_id").agg(F.max("o")["text"].alias("text"))
        .select(F.lit(name).alias("field"), "rec_id", "text")
    )


#: Bytes of a task, and most tasks of a shuffle.
TASK_BYTES, TASKS = 64 << 20, 100_000


def evenly(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by hash of ``keys`` over tasks of about ``TASK_BYTES`` (by the planner's estimate), and over some tasks
    a core at least. Text in Python costs far more than this shuffle, and a small table comes in fewer partitions than
    there are cores; hashing gives the same partitions on a retry."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    spark = df.sparkSession
    # Rows that are not read from files have no estimate but an absurdly large one.
    known = size < 1 << 56
    n = min(TASKS, size // TASK_BYTES + 1) if known else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, n), *keys)


def spread(df: DataFrame, keys: list[str], schema: str, rows: Callable[[str | None], list[tuple]]) -> DataFrame:
    """``keys`` and the columns of ``schema`` for every row that ``rows`` makes of a text; runs in Arrow batches,
    one text at a time, so memory holds a batch and its rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            at, out = [], []
            for i, text in enumerate(pdf["text"]):
                found = rows(text)
                at += [i] * len(found)
                out += found
            made = pd.DataFrame(out, columns=names)
            for k in keys:
                made[k] = pdf[k].to_numpy()[at] if at else pd.Series(dtype=pdf[k].dtype)
            yield made[[*keys, *names]]

    types = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return evenly(df.select(*keys, "text"), *keys).mapInPandas(run, f"{types}, {schema}")
