"""Index and hybrid search over chunks: BM25 and heading-weighted TF-IDF joined on terms, fused per user.

The index is the statistics of the terms and the postings, in blocks of chunks (see ``blocks``). Each block meets
all texts that are asked, texts that several users ask once, and keeps of each only the chunks that can be among its
best, so no pair of a text and a chunk travels that is not a candidate. Chunks without any common term fill up the
quota of the two candidate lists in the order of the chunks: only the first ``top`` of them can be needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions import korean
from tessera.operators import access, blocks

# Ranking parameters and gate thresholds.
K1, B = 1.2, 0.75
ALPHA, TOP, KEEP, PER_DOCUMENT, CUT = 0.4, 30, 5, 3, 0.62
GATE_COSINE, GATE_HYBRID, GATE_CITABLE = 0.229, 0.500, 1
HEADING_REPEAT = 3
#: Most tasks of a shuffle.
TASKS = 100_000


@dataclass
class Index:
    chunks: DataFrame
    postings: DataFrame
    terms: DataFrame
    first: list[int]


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row of each chunk: the delivery indexed last, of equally late ones the first by position."""
    order = F.struct(F.coalesce(F.col("indexed_at").cast("string"), F.lit("")), -F.col("chunk_ord"))
    return chunks.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in chunks.columns if c != "chunk_id"]), order).alias("c")).select("chunk_id", "c.*")


def token_counts(chunks: DataFrame, with_bigrams: bool = True) -> DataFrame:
    """``chunk_ord, term, tf, weighted_tf, length``: counts over path and text; the path counts for the weighted ones again."""
    path = F.coalesce(F.col("section_path"), F.lit(""))
    body = korean.normalize(F.concat(path, F.lit("\n"), F.coalesce(F.col("text"), F.lit(""))))
    t = chunks.select("chunk_ord", body.alias("body"), korean.normalize(path).alias("path")).select("chunk_ord", korean.tokens(F.col("body"), with_bigrams).alias("t"), korean.tokens(F.col("path"), with_bigrams).alias("p"))
    listed = t.select("chunk_ord", F.size("t").alias("length"), F.explode(F.concat(F.transform("t", lambda x: F.struct(x.alias("term"), F.lit(1).alias("a"), F.lit(1).alias("b"))), F.transform("p", lambda x: F.struct(x.alias("term"), F.lit(0).alias("a"), F.lit(HEADING_REPEAT).alias("b"))))).alias("x"))
    return listed.groupBy("chunk_ord", "x.term").agg(F.sum("x.a").alias("tf"), F.sum("x.b").alias("weighted_tf"), F.max("length").alias("length"))


def term_stats(df: DataFrame, n: Column) -> DataFrame:
    """``term, df, idf_bm25, idf_tfidf`` over all ``n`` chunks, whoever may see them."""
    return df.select("term", "df", F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf_bm25"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf_tfidf"))


def build_index(chunks: DataFrame, with_bigrams: bool = True, cut=lambda df, name: df) -> Index:
    """``chunks`` one row of each chunk. ``cut`` may write the tables (see ``session.cut``), so later queries read them."""
    n = chunks.count()
    count = max(1, -(-n // blocks.size(n)))
    path = F.coalesce(F.col("section_path"), F.lit(""))
    same = chunks.groupBy(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")).agg(F.array_sort(F.collect_list("chunk_ord")).alias("ords"))
    spread = same.withColumn("block", F.pmod(F.xxhash64(F.col("ords")[0]), F.lit(count)).cast("int")).repartitionById(count, "block")
    normal = spread.select("block", "ords", korean.normalize(F.concat("path", F.lit("\n"), "text")).alias("body"), korean.normalize(F.col("path")).alias("path"))
    listed = normal.select("block", "ords", korean.tokens(F.col("body"), with_bigrams).alias("t"), korean.tokens(F.col("path"), with_bigrams).alias("p"))
    built = cut(listed.mapInArrow(blocks.build(HEADING_REPEAT), blocks.BUILT), "blocks")
    held = built.select("block", F.posexplode(F.arrays_zip("terms", "df")).alias("pos", "x")).select("block", "pos", "x.terms", "x.df").withColumnRenamed("terms", "term")
    stats = cut(term_stats(held.groupBy("term").agg(F.sum("df").alias("df")), F.lit(n)), "terms")
    # Of each block the idf of its terms, in their order.
    idf = held.select("block", "pos", "term").join(stats.select("term", "idf_tfidf"), "term").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "idf_tfidf"))).alias("x")).select("block", F.col("x.idf_tfidf").alias("idf_tfidf"))
    # A chunk without tokens has no postings but is a chunk of length 0.
    times = F.transform("lengths", lambda v, i: v.cast("long") * (F.get("ord_starts", i + 1) - F.get("ord_starts", i)))
    mean = built.select(F.aggregate(times, F.lit(0).cast("long"), lambda s, v: s + v).alias("total")).agg((F.sum("total") / n).alias("mean"))
    first = [r[0] for r in chunks.select("chunk_ord").orderBy("chunk_ord").limit(TOP).collect()]
    return Index(chunks, cut(built.drop("df").join(idf, "block").join(F.broadcast(mean)), "postings"), stats, first)


def save_index(index: Index, path: str) -> None:
    """Write the tables of an index under ``path``; the last one written tells that it is whole."""
    for name in ("chunks", "terms", "postings"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    index.chunks.sparkSession.createDataFrame([(index.first,)], "first array<bigint>").coalesce(1).write.mode("overwrite").parquet(f"{path}/first")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index written by :func:`save_index`."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Index(read("chunks"), read("postings"), read("terms"), list(read("first").first()[0]))


def query_terms(queries: DataFrame, terms: DataFrame, with_bigrams: bool = True) -> DataFrame:
    """``qtext, term, qtf, qw`` of distinct normal texts ``qtext``; qw is the unit TF-IDF weight, unknown terms are left out."""
    counts = queries.select("qtext", F.explode(korean.tokens(F.col("qtext"), with_bigrams)).alias("term")).groupBy("qtext", "term").agg(F.count("*").alias("qtf"))
    w = counts.join(terms, "term").withColumn("w", F.col("qtf") * F.col("idf_tfidf"))
    norms = w.groupBy("qtext").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return w.join(norms, "qtext").select("qtext", "term", "qtf", (F.col("w") / F.col("norm")).alias("qw"))


def _scored(queries: DataFrame, index: Index, with_bigrams: bool, digits: int | None, top: int | None = None) -> DataFrame:
    """``blocks.SCORED`` of all texts and blocks."""
    terms = query_terms(queries.select("qtext").distinct(), index.terms, with_bigrams).join(index.terms.select("term", "idf_bm25", "idf_tfidf"), "term")
    x = F.struct("term", (F.col("qtf") * F.col("idf_bm25")).alias("qa"), (F.col("qw") * F.col("idf_tfidf")).alias("qb"))
    # In the order of the terms, so that equal chunks get equal sums.
    asked = terms.groupBy("qtext").agg(F.array_sort(F.collect_list(x)).alias("x")).select("qtext", F.col("x.term").alias("terms"), F.col("x.qa").alias("qa"), F.col("x.qb").alias("qb"))
    count = (index.postings.agg(F.max("block")).first()[0] or 0) + 1
    each = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = index.postings.unionByName(each, allowMissingColumns=True).repartitionById(count, "block")
    return both.sortWithinPartitions("block", F.col("qtext").isNotNull()).mapInArrow(blocks.score(K1, B, digits, top), blocks.SCORED)


def _flat(scored: DataFrame) -> DataFrame:
    return scored.select("qtext", F.inline(F.arrays_zip("chunk_ord", "bm25", "cosine")))


def scores(queries: DataFrame, index: Index, with_bigrams: bool = True, digits: int | None = None) -> DataFrame:
    """``qtext, chunk_ord, bm25, cosine`` of all pairs with a common term; a repeated query token counts repeatedly in BM25."""
    return _flat(_scored(queries, index, with_bigrams, digits))


def candidates(queries: DataFrame, index: Index, with_bigrams: bool = True, vectors: bool = True) -> DataFrame:
    """Union of the best ``TOP`` chunks by BM25 and by cosine, ties to the earlier chunk, zero scores included."""
    zero = F.array_repeat(F.lit(0.0), len(index.first))
    fill = queries.select("qtext", F.array(*[F.lit(i) for i in index.first]).cast("array<bigint>").alias("chunk_ord"), zero.alias("bm25"), zero.alias("cosine"))
    # The best of each block come together by the text, and all that follows stays there.
    pairs = _flat(_scored(queries, index, with_bigrams, 10, TOP).unionByName(fill).repartition("qtext")).groupBy("qtext", "chunk_ord").agg(F.max("bm25").alias("bm25"), F.max("cosine").alias("cosine"))

    def best(by: str) -> DataFrame:
        line = W.partitionBy("qtext").orderBy(F.desc(by), "chunk_ord")
        return pairs.withColumn("_place", F.row_number().over(line)).where(F.col("_place") <= TOP).drop("_place")

    return best("bm25").unionByName(best("cosine")).dropDuplicates(["qtext", "chunk_ord"]) if vectors else best("bm25")


def pools(asks: DataFrame, found: DataFrame, chunks: DataFrame, people: DataFrame, today: str) -> DataFrame:
    """Candidates of every ask (``id, employee_no, qtext``) with the access decision and the counts of what was denied."""
    attributes = chunks.select("chunk_ord", "chunk_id", "doc_id", "acl_groups", "audience", "valid_until", "effective_from", "published_at", "sensitivity")
    w = W.partitionBy("id")
    return (
        asks.join(people, "employee_no").join(found, "qtext").join(attributes, "chunk_ord")
        .withColumn("decision", access.decision(today))
        .select(
            "id", "employee_no", "qtext", "chunk_ord", "chunk_id", "doc_id", "bm25", "cosine", "decision",
            F.count_if(F.col("decision") != "allow").over(w).alias("filtered_out"), F.bool_or(access.blocked(F.col("decision"))).over(w).alias("acl_blocked"),
        )
    )


def fuse(pool: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Allowed candidates with min-max normalised BM25 (over the allowed pool), the linear blend and their place by it."""
    w = W.partitionBy("id")
    low, high = F.min("bm25").over(w), F.max("bm25").over(w)
    flat = F.when(high <= 0, 0.0).otherwise(1.0)
    norm = F.when(high - low < 1e-12, flat).otherwise((F.col("bm25") - low) / (high - low))
    hybrid = F.round(alpha * F.col("bm25_norm") + (1 - alpha) * F.greatest(F.col("cosine"), F.lit(0.0)), 9)
    return pool.where("decision = 'allow'").withColumn("bm25_norm", norm).withColumn("hybrid", hybrid).withColumn("place", F.row_number().over(w.orderBy(F.desc("hybrid"), "chunk_ord")))


def select(fused: DataFrame, cut: float = CUT, per_document: int = PER_DOCUMENT, keep: int = KEEP) -> DataFrame:
    """Relative cut for documents other than the first, a cap per document, and the best few."""
    w = W.partitionBy("id").orderBy("place")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = (F.col("doc_id") == F.first("doc_id").over(whole)) | (F.col("hybrid") >= F.first("hybrid").over(whole) * cut)
    capped = fused.withColumn("near", near).where("near").withColumn("of_doc", F.row_number().over(W.partitionBy("id", "doc_id").orderBy("place"))).where(F.col("of_doc") <= per_document)
    return capped.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("near", "of_doc", "place")


def unknown_subjects(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``qtext, unknown``: subject terms none of whose bigrams the collection knows."""
    subjects = queries.select("qtext", F.posexplode(korean.rare_subjects(F.col("qtext"))).alias("pos", "subject"))
    grams = subjects.select("qtext", "pos", "subject", F.explode(F.transform(korean.bigrams(F.col("subject")), lambda g: F.concat(F.lit("__"), g))).alias("term"))
    known = grams.join(terms.select("term"), "term", "left_semi").select("qtext", "pos").distinct()
    return subjects.join(known, ["qtext", "pos"], "left_anti").groupBy("qtext").agg(F.array_sort(F.collect_list(F.struct("pos", "subject"))).alias("u")).select("qtext", F.transform("u", lambda x: x["subject"]).alias("unknown"))


def gate(asks: DataFrame, pool: DataFrame, selected: DataFrame, unknown: DataFrame, vectors: bool = True) -> DataFrame:
    """One row of each ask: signals and whether they suffice for an answer."""
    counts = pool.groupBy("id").agg(F.max("filtered_out").alias("filtered_out"), F.bool_or("acl_blocked").alias("acl_blocked"))
    best = selected.groupBy("id").agg(F.round(F.max(F.greatest("cosine", F.lit(0.0))), 4).alias("cos_top1"), F.round(F.max_by("hybrid", -F.col("rank")), 4).alias("hybrid_top1"), F.count("*").alias("citable"))
    enough = (F.col("citable") >= GATE_CITABLE) & (F.size("unknown") == 0) & (F.col("hybrid_top1") >= GATE_HYBRID) & ((F.col("cos_top1") >= GATE_COSINE) if vectors else F.lit(True))
    none = F.array().cast("array<string>")
    return (
        asks.join(counts, "id", "left").join(best, "id", "left").join(unknown, "qtext", "left")
        .select(
            "id", "employee_no", F.coalesce("filtered_out", F.lit(0)).alias("filtered_out"), F.coalesce("acl_blocked", F.lit(False)).alias("acl_blocked"),
            F.coalesce("cos_top1", F.lit(0.0)).alias("cos_top1"), F.coalesce("hybrid_top1", F.lit(0.0)).alias("hybrid_top1"), F.coalesce("citable", F.lit(0)).alias("citable"), F.coalesce("unknown", none).alias("unknown"),
        )
        .withColumn("sufficient", enough)
    )


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors; 0 if either is null or all zeros. Codegen-free but JVM-side."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """``query_id, rank, vec_id, cosine``: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each query vector but itself.

    Queries and vectors are put into blocks, every task gets one block of queries and one of vectors, keeps the best
    ``k`` of each query, and only those are shuffled. No vector reaches the driver, and no task holds more than the two
    blocks of about ``block``.
    Cosines are rounded to six places, ties go to the smaller id; a null or zero vector has cosine 0 to all, a row without an id is left out.
    """
    size = lambda df: -(-max(1, df.count()) // block)
    n, m = size(queries), size(vectors)
    packed = lambda df, blocks, name: df.where("vec_id is not null").select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias(name), F.struct("vec_id", "embedding").alias("one")).groupBy(name).agg(F.collect_list("one").alias(name + "s"))
    # Each block of vectors goes once to each block of queries.
    q = packed(queries, n, "q").withColumn("v", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    pairs = q.join(packed(vectors, m, "v"), "v").repartition(max(1, min(n * m, TASKS)), "q", "v")
    best = pairs.mapInPandas(_best(k), "query_id bigint, vec_id bigint, cosine double")
    line = W.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return best.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")


def _unit(rows: list, size: int) -> np.ndarray:
    m = np.array([r if r is not None and len(r) == size else [0.0] * size for r in rows], dtype=np.float64).reshape(len(rows), size)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(k: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qs, vs in zip(pdf["qs"], pdf["vs"]):
                vs = sorted(vs, key=lambda v: v["vec_id"])
                size = max((len(x["embedding"]) for x in (*qs, *vs) if x["embedding"] is not None), default=0)
                names, mine = np.array([x["vec_id"] for x in qs]), np.array([x["vec_id"] for x in vs])
                cos = np.round(_unit([x["embedding"] for x in qs], size) @ _unit([x["embedding"] for x in vs], size).T, 6) + 0.0
                cos[names[:, None] == mine[None, :]] = -2.0
                top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
                out = pd.DataFrame({"query_id": np.repeat(names, top.shape[1]), "vec_id": mine[top].ravel(), "cosine": np.take_along_axis(cos, top, axis=1).ravel()})
                yield out[out["cosine"] > -2.0]

    return run
