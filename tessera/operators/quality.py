"""Evaluation against a golden set, threshold sweep, document lint and metadata differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.operators import retrieval

# What the front matter must hold.
REQUIRED = ["doc_id", "title", "version", "category", "subcategory", "owner_dept", "approver", "sensitivity", "audience", "acl_groups", "published_at", "valid_until", "status"]
SENSITIVITY = ["public", "internal", "restricted"]
STATUS = ["draft", "review", "published", "expired"]
DOC_TYPES = ["안내문", "규정"]
AUTHORITIES = ["안내문", "부서지침", "사규", "취업규칙"]
ARTICLE, CLAUSES = r"제\s*\d+\s*조", "[①-⑳]"
DEMO_PHRASE, FAQ_TITLE = "데모용 가정", "자주 묻는 질문"
#: Problems that do not keep a document out.
WARNINGS = ["file name without doc_id", "regulation without effective_from", "articles without clauses", "no section heading", "no FAQ section"]
ALPHAS = [0.2, 0.3, 0.4, 0.5, 0.6]
# Question types that must be answered, and those the scores must block.
ANSWERED = ["normal", "personalized", "regulation"]
BLOCKED = ["forbidden", "no_evidence"]


def assertions(golden: DataFrame, texts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``id, missing, forbidden, behaviour``: phrases a rendered answer lacks, those it must not hold but does, and how the
    outcome (``id, answered, citations``) differs from the expected behaviour, or null. No answer is an empty one."""
    ok = F.coalesce("answered", F.lit(False))
    wrong = F.when(F.col("expected_behavior") == "answer", F.when(~ok, "not answered").when(F.size("citations") == 0, "no citation")).when(F.col("expected_behavior").isin("block", "blocked", "no_evidence") & ok, "not blocked")
    body = F.coalesce("text", F.lit(""))
    lacks = F.filter(F.coalesce("must_contain", F.array().cast("array<string>")), lambda p: ~F.contains(body, p))
    holds = F.filter(F.coalesce("must_not_contain", F.array().cast("array<string>")), lambda p: F.contains(body, p))
    return golden.join(texts, "id", "left").join(outcomes, "id", "left").select("id", lacks.alias("missing"), holds.alias("forbidden"), wrong.alias("behaviour"))


def metrics(golden: DataFrame, selected: DataFrame, gates: DataFrame) -> DataFrame:
    """One row of each question type: recall of expected documents, rate of blocked and of falsely blocked questions."""
    docs = selected.groupBy("id").agg(F.collect_set("doc_id").alias("docs"))
    g = golden.join(docs, "id", "left").join(gates.select("id", "sufficient"), "id", "left")
    hit = F.when(F.size("expected_docs") > 0, F.coalesce(F.arrays_overlap("docs", "expected_docs"), F.lit(False)).cast("int"))
    closed = (~F.coalesce("sufficient", F.lit(False))).cast("int")
    return g.groupBy("query_type").agg(
        F.count("*").alias("items"), F.avg(hit).alias("recall"), F.avg(F.when(F.col("expected_behavior") == "block", closed)).alias("blocked"), F.avg(F.when(F.col("expected_behavior") != "block", closed)).alias("false_blocked")
    )


def sweep(pool: DataFrame, golden: DataFrame, unknown: DataFrame, pairs: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """Per blend weight: recall; of the hybrid score and of the cosine the least top value of answerable questions, the
    greatest of those to block, their gap and a threshold between them; and whether the weight is the best by recall and
    hybrid gap (first on ties). All weights in one job: each pool row is fused once per weight.

    Only questions of the types above count, and of these not the ones blocked by an unknown subject (``qtext`` in
    ``unknown``) instead of a score; a question whose user may see no candidate has the scores 0, whatever its subjects.
    ``pairs`` are FAQ pairs (``faq.hits``), whose documents count as found.
    """
    each = pool.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("id", F.struct("alpha", "id"))
    best = retrieval.select(retrieval.fuse(each, F.col("alpha"))).groupBy("id").agg(
        F.round(F.max_by("hybrid", -F.col("rank")), 4).alias("top"), F.round(F.max(F.greatest("cosine", F.lit(0.0))), 4).alias("cos"), F.collect_set("doc_id").alias("docs")
    )
    asked = pool.groupBy("id").agg(F.min("qtext").alias("qtext"), F.bool_or(F.col("decision") == "allow").alias("seen"))
    counted = asked.join(unknown.select("qtext", F.lit(True).alias("skip")), "qtext", "left").where(F.col("skip").isNull() | ~F.col("seen")).select("id")
    items = counted.join(golden.where(F.col("query_type").isin(*ANSWERED, *BLOCKED)), "id").join(pairs.select("id", F.col("doc_id").alias("pair")), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    j = items.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).join(best.select("id.alpha", "id.id", "top", "cos", "docs"), ["alpha", "id"], "left")
    hit = F.coalesce(F.arrays_overlap("docs", "expected_docs"), F.lit(False)) | F.coalesce(F.array_contains("expected_docs", F.col("pair")), F.lit(False))
    open_, shut = F.col("query_type").isin(*ANSWERED), F.col("query_type").isin(*BLOCKED)
    out = j.groupBy("alpha").agg(
        zero(F.avg(F.when(open_ & (F.size("expected_docs") > 0), hit.cast("int")))).alias("recall"),
        *[zero(f(F.when(side, zero(F.col(c))))).alias(name) for c, prefix in (("top", ""), ("cos", "cos_")) for f, side, name in ((F.min, open_, f"{prefix}least_answerable"), (F.max, shut, f"{prefix}greatest_blocked"))],
    )
    for p in ("", "cos_"):
        least, greatest = F.col(f"{p}least_answerable"), F.col(f"{p}greatest_blocked")
        gap = F.round(least - greatest, 4)
        out = out.withColumn(f"{p}gap", gap).withColumn(f"{p}threshold", F.round(F.when(gap > 0, (least + greatest) / 2).otherwise(greatest + 0.01), 3))
    # One row of each weight.
    top = out.agg(F.max_by("alpha", F.struct(F.round("recall", 3), "gap", -F.col("alpha"))).alias("first"))
    return out.crossJoin(F.broadcast(top)).withColumn("best", F.col("alpha") == F.col("first")).drop("first")


def lint(docs: DataFrame) -> DataFrame:
    """``doc_id, version, problem``: every problem of every document row, all at once, each once for an id and version.

    Dates are checked where there are any; a null doc_type or authority_level is the plainest one, a missing
    effective_from is published_at; only rows with ``source_path`` have a file name to check.
    """
    col = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    unless = lambda cond, message: F.when(~F.coalesce(cond, F.lit(False)), message)
    day = lambda c: F.coalesce(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
    empty = lambda c: F.col(c).isNull() | ((F.size(c) == 0) if c in ("audience", "acl_groups") else (F.trim(c) == ""))
    body, published, until = F.coalesce("body", F.lit("")), F.col("published_at"), F.col("valid_until")
    starts = F.coalesce(F.nullif(col("effective_from"), F.lit("")), published)
    kind, authority = F.coalesce(col("doc_type"), F.lit(DOC_TYPES[0])), F.coalesce(col("authority_level"), F.lit(AUTHORITIES[0]))
    regulation = kind == "규정"
    checks = [F.when(empty(c), f"missing {c}") for c in REQUIRED]
    checks += [
        unless(F.col("doc_id").rlike(r"^[A-Z]{2,4}-\d{3}$"), "bad doc_id"), unless(F.col("version").rlike(r"^\d+\.\d+$"), "bad version"),
        unless(F.col("sensitivity").isin(*SENSITIVITY), "bad sensitivity"), unless(F.col("status").isin(*STATUS), "bad status"),
        *[F.when((c != "") & ~day(c), f"bad {name}") for c, name in ((published, "published_at"), (until, "valid_until"), (starts, "effective_from"))],
        F.when(day(published) & day(until) & (until <= published), "dates out of order"), F.when(day(starts) & day(until) & (starts > until), "never in force"),
        unless(kind.isin(*DOC_TYPES), "bad doc_type"), unless(authority.isin(*AUTHORITIES), "bad authority_level"),
        F.when(regulation & (authority == AUTHORITIES[0]), "regulation without authority"), F.when(regulation & (F.coalesce(col("effective_from"), F.lit("")) == ""), "regulation without effective_from"),
        F.when(regulation & body.rlike(ARTICLE) & ~body.rlike(CLAUSES), "articles without clauses"),
        F.when(F.col("demo_assumption") & ~F.substring(body, 1, 1500).contains(DEMO_PHRASE), "no demo notice"),
        F.when(~body.rlike(r"(?m)^#{2,4}\s+"), "no section heading"), F.when(~body.contains(FAQ_TITLE), "no FAQ section"),
        F.when(~F.substring_index(col("source_path"), "/", -1).startswith(F.col("doc_id")), "file name without doc_id"),
    ]
    found = docs.select("doc_id", "version", F.explode(F.array_compact(F.array(*checks))).alias("problem")).distinct()
    again = docs.groupBy("doc_id", "version").count().where("count > 1").select("doc_id", "version", F.lit("delivered more than once").alias("problem"))
    return found.unionByName(again)


def changes(old: DataFrame, new: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """``key, attribute, before, after`` of what differs between two snapshots; rows on one side differ in all that is not null."""
    side = lambda df, name: df.groupBy(key).agg(F.min(F.struct(*attributes)).alias(name))
    both = side(old, "o").join(side(new, "n"), key, "full_outer")
    rows = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"o.{a}").alias("before"), F.col(f"n.{a}").alias("after")) for a in attributes])
    return both.select(key, F.explode(rows).alias("r")).select(key, "r.*").where(~F.col("before").eqNullSafe(F.col("after")))


def successive_changes(snapshots: DataFrame, key: str, day: str, loaded: str, attributes: list[str], days: list[str] | None = None) -> DataFrame:
    """``key, day, attribute, before, after`` of what differs between each snapshot of a key and its previous one; with
    ``days`` only snapshots of these count.

    Of several loads of a day the last counts. A missing snapshot is no change: the next one is compared with the last
    there is. A key that comes after the first day of all differs in all that is not null; that a key goes can't be told
    from missing snapshots and is none.
    """
    rows = snapshots.where(F.col(key).isNotNull() & F.col(day).isNotNull())
    if days is not None:
        rows = rows.where(F.col(day).isin(*days))
    order = F.struct(F.coalesce(F.col(loaded).cast("timestamp"), F.timestamp_seconds(F.lit(0))), *attributes)
    last = rows.groupBy(key, day).agg(F.max_by(F.struct(*attributes), order).alias("n"))
    first = rows.agg(F.min(day).alias("first"))
    told = last.withColumn("o", F.lag("n").over(W.partitionBy(key).orderBy(day))).crossJoin(F.broadcast(first)).where(F.col("o").isNotNull() | (F.col(day) > F.col("first")))
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"o.{a}").alias("before"), F.col(f"n.{a}").alias("after")) for a in attributes])
    return told.select(key, day, F.explode(each).alias("r")).select(key, day, "r.*").where(~F.col("before").eqNullSafe(F.col("after")))


def usage(requests: DataFrame, user: str, sent: str, received: str, text: str) -> DataFrame:
    """Per hour: requests, users, empty ones, and percentiles of the delay in seconds."""
    delay = F.unix_seconds(F.col(received).cast("timestamp")) - F.unix_seconds(F.col(sent).cast("timestamp"))
    return requests.where(F.col(sent).isNotNull()).groupBy(F.date_trunc("hour", F.col(sent).cast("timestamp")).alias("hour")).agg(
        F.count("*").alias("requests"), F.countDistinct(user).alias("users"), F.count_if(F.coalesce(F.trim(text), F.lit("")) == "").alias("empty"), F.percentile(delay, 0.5).alias("p50"), F.percentile(delay, 0.95).alias("p95")
    )
