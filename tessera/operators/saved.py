"""Saved answers and checklists: append-only events, and their latest state as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import text

PAYLOAD = "struct<query:string,summary:string,actions:array<struct<text:string,doc_id:string>>,citations:array<struct<doc_id:string,version:string,excerpt:string,title:string>>,cautions:array<string>,notices:array<string>,personalization_basis:string,text:string,doc_id:string,doc_version:string>"
KINDS = ("saved_answers", "checklist")


def additions(requests: DataFrame, user: str, kind: str, payload: str, item: str, at: str) -> DataFrame:
    """Add events of requests with JSON payloads: arrays capped, unknown kinds, users and unsafe texts refused.
    Of several deliveries of an item the first counts."""
    p = requests.select(F.col(user).alias("employee_no"), F.col(kind).alias("kind"), F.col(item).cast("string").alias("item_id"), F.col(at).alias("at"), F.from_json(F.col(payload), PAYLOAD).alias("p"))
    p = p.where(F.col("employee_no").isNotNull() & F.col("kind").isin(*KINDS) & F.col("p").isNotNull())
    unsafe = F.when(F.col("kind") == "checklist", text.unsafe_to_store(F.col("p.text"))).otherwise(text.unsafe_to_store(F.col("p.query")) | text.unsafe_to_store(F.col("p.summary")))
    cap = lambda c, n: F.slice(F.coalesce(F.col(f"p.{c}"), F.array().cast(p.schema["p"].dataType[c].dataType)), 1, n).alias(c)
    rows = p.where(~unsafe).select(
        "employee_no", "kind", F.lit("add").alias("op"), "item_id", "at",
        F.struct("p.query", "p.summary", cap("actions", 10), cap("citations", 5), cap("cautions", 6), cap("notices", 4), "p.text", "p.doc_id", "p.doc_version").alias("item"),
    )
    return rows.groupBy("employee_no", "kind", "op", "item_id").agg(F.min_by("item", "at").alias("item"), F.min("at").alias("at"))


def state(events: DataFrame) -> DataFrame:
    """Items that exist after all events ``employee_no, kind, op, item_id, at[, item]``.

    op is add, done, undone, remove, clear (all of a kind, of every kind if kind is null). A removal takes what was
    added before it; an item's last done or undone counts.
    """
    adds = events.where("op = 'add'")
    gone = events.where("op = 'remove'").groupBy("employee_no", "item_id").agg(F.max("at").alias("gone"))
    cleared = events.where("op = 'clear'").select("employee_no", F.explode(F.when(F.col("kind").isNull(), F.array(*map(F.lit, KINDS))).otherwise(F.array("kind"))).alias("kind"), "at").groupBy("employee_no", "kind").agg(F.max("at").alias("cleared"))
    marks = events.where("op in ('done', 'undone')").groupBy("employee_no", "item_id").agg(F.max_by(F.struct("op", "at"), "at").alias("mark"))
    return (
        adds.join(gone, ["employee_no", "item_id"], "left").join(cleared, ["employee_no", "kind"], "left").join(marks, ["employee_no", "item_id"], "left")
        .where((F.col("gone").isNull() | (F.col("gone") < F.col("at"))) & (F.col("cleared").isNull() | (F.col("cleared") < F.col("at"))))
        .select("employee_no", "kind", "item_id", "item", F.col("at").alias("saved_at"), F.coalesce(F.col("mark.op") == "done", F.lit(False)).alias("done"), F.when(F.col("mark.op") == "done", F.col("mark.at")).alias("done_at"))
    )


def annotated(items: DataFrame, seen: DataFrame, current: DataFrame) -> DataFrame:
    """Items with ``is_new`` (saved after the list was last seen) and ``stale``: documents cited in another version than
    the current one. ``seen``: employee_no, kind, seen_at; ``current``: doc_id, version."""
    cites = F.concat(
        F.transform(F.coalesce("item.citations", F.array().cast("array<struct<doc_id:string,version:string,excerpt:string,title:string>>")), lambda c: F.struct(c["doc_id"].alias("doc_id"), c["version"].alias("version"))),
        F.array(F.struct(F.col("item.doc_id").alias("doc_id"), F.nullif("item.doc_version", F.lit("")).alias("version"))),
    )
    listed = items.select("employee_no", "kind", "item_id", F.explode(cites).alias("c")).where("c.doc_id is not null and c.version is not null")
    old = listed.select("employee_no", "kind", "item_id", "c.*").join(current.select("doc_id", F.col("version").alias("now")), "doc_id").where("version <> now")
    stale = old.groupBy("employee_no", "kind", "item_id").agg(F.sort_array(F.collect_set(F.concat("doc_id", F.lit(" v"), "now"))).alias("stale"))
    return (
        items.join(seen, ["employee_no", "kind"], "left").join(stale, ["employee_no", "kind", "item_id"], "left")
        .withColumn("is_new", F.col("seen_at").isNull() | (F.col("saved_at") > F.col("seen_at"))).drop("seen_at")
    )


def counts(items: DataFrame) -> DataFrame:
    """Per user and kind: open items (answers are always open), all, done and new ones."""
    return items.groupBy("employee_no", "kind").agg(F.count_if(~F.col("done")).alias("open"), F.count("*").alias("items"), F.count_if("done").alias("done"), F.count_if("is_new").alias("new"))
