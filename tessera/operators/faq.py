"""Question-and-answer pairs of documents and their match with a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import korean
from tessera.operators import access

MATCH = 0.60
_SECTION = r"(?sm)^#{2,4}[ \t]*자주\s*묻는\s*질문[ \t]*$(.*?)(?=^#{1,4}\s|\z)"
_PAIR = r"(?s)\*\*(.+?)\*\*\s*\n(.+?)(?=\n\s*\n|\z)"


def pairs(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, pos, question, answer, chunk_ord``: pairs of the FAQ section of each body, with the first chunk of the
    document that holds the answer's beginning; pairs without one are left out."""
    part = F.regexp_extract("body", _SECTION, 1)
    both = F.arrays_zip(F.regexp_extract_all(part, F.lit(_PAIR), F.lit(1)).alias("q"), F.regexp_extract_all(part, F.lit(_PAIR), F.lit(2)).alias("a"))
    listed = docs.where(part != "").select("doc_id", F.posexplode(both).alias("pos", "x")).select("doc_id", "pos", F.trim("x.q").alias("question"), F.trim(F.regexp_replace("x.a", r"(?U)\s+", " ")).alias("answer"))
    owners = chunks.select("doc_id", "chunk_ord", "text")
    return (
        listed.where("question <> '' and answer <> ''").join(owners, "doc_id").where(F.col("text").contains(F.substring("answer", 1, 40)))
        .groupBy("doc_id", "pos", "question", "answer").agg(F.min("chunk_ord").alias("chunk_ord"))
    )


def match(queries: DataFrame, faq: DataFrame) -> DataFrame:
    """``qtext`` with its best pair by Jaccard of tokens (first on ties), if it reaches the threshold and some subject of
    the question occurs in the pair. Pairs are reached over common tokens, not by comparing all with all."""
    q = queries.select("qtext", F.array_distinct(korean.tokens(F.col("qtext"))).alias("qt"))
    f = faq.withColumn("ft", F.array_distinct(korean.tokens(korean.normalize(F.col("question")))))
    left = q.select("qtext", F.size("qt").alias("nq"), F.explode("qt").alias("term"))
    # Versions of a document may have different pairs at one place.
    pair = ["doc_id", "pos", "question", "answer"]
    right = f.select(*pair, F.size("ft").alias("nf"), F.explode("ft").alias("term"))
    common = left.join(right, "term").groupBy("qtext", *pair).agg(F.count("*").alias("n"), F.first("nq").alias("nq"), F.first("nf").alias("nf"))
    score = F.col("n") / (F.col("nq") + F.col("nf") - F.col("n"))
    best = common.withColumn("score", score).groupBy("qtext").agg(F.min(F.struct((-F.col("score")).alias("neg"), *pair)).alias("b")).where(-F.col("b.neg") >= MATCH)
    found = best.select("qtext", *[f"b.{c}" for c in pair], F.round(-F.col("b.neg"), 4).alias("faq_score")).join(faq, pair)
    found = found.withColumn("_hay", korean.normalize(F.concat_ws(" ", "question", "answer")))
    return found.where(F.exists(korean.subject_terms(F.col("qtext")), lambda t: F.contains(F.col("_hay"), t))).drop("_hay")


def hits(asks: DataFrame, unknown: DataFrame, selected: DataFrame, faq: DataFrame, chunks: DataFrame, people: DataFrame, today: str) -> DataFrame:
    """``id, chunk_ord, chunk_id, doc_id, question, answer, faq_score, absent``: the pair that answers an ask, if its user
    may see the pair's chunk and any candidate at all; an unknown subject is never overruled. ``absent``: the chunk is
    not among the selected."""
    clear = asks.select("qtext").distinct().join(unknown.select("qtext"), "qtext", "left_anti")
    found = match(clear, faq).select("qtext", "chunk_ord", "question", "answer", "faq_score")
    attributes = chunks.select("chunk_ord", "chunk_id", "doc_id", "acl_groups", "audience", "valid_until", "effective_from", "published_at", "sensitivity")
    seen = asks.join(people, "employee_no").join(found, "qtext").join(attributes, "chunk_ord").where(access.decision(today) == "allow")
    mine = selected.select("id", "chunk_ord", F.lit(False).alias("absent"))
    return (
        seen.join(selected.select("id"), "id", "left_semi").join(mine, ["id", "chunk_ord"], "left")
        .select("id", "chunk_ord", "chunk_id", "doc_id", "question", "answer", "faq_score", F.coalesce("absent", F.lit(True)).alias("absent"))
    )


def lead(selected: DataFrame, found: DataFrame) -> DataFrame:
    """``selected`` with the chunk of each pair of :func:`hits` that is not in it, before all others (rank 0) and without scores."""
    zero = [F.lit(0.0).alias(c) for c in ("bm25", "cosine", "bm25_norm", "hybrid")]
    return selected.unionByName(found.where("absent").select("id", "chunk_ord", "chunk_id", "doc_id", F.lit(0).alias("rank"), *zero), allowMissingColumns=True)


def opened(gates: DataFrame, found: DataFrame) -> DataFrame:
    """``gates`` opened by the pairs of :func:`hits`, whatever the scores are."""
    rest = [c for c in gates.columns if c not in ("citable", "sufficient")]
    return gates.join(found.select("id", "absent"), "id", "left").select(
        *rest, (F.col("citable") + F.coalesce(F.col("absent").cast("int"), F.lit(0))).alias("citable"), (F.col("sufficient") | F.col("absent").isNotNull()).alias("sufficient")
    )
