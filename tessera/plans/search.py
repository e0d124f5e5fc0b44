"""Queries on tokens, index, hybrid search and access control over chunks, golden_set and user_profiles."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import korean, text
from tessera.operators import access, faq, retrieval
from tessera.plans import sql
from tessera.session import cut, exists, shared_dir, stamp
from tessera.sources.tables import table

#: The day the questions are asked on.
TODAY = "2026-03-01"
#: Characters of the longest message that is searched.
LONGEST = 500
CHUNK_COLUMNS = ["chunk_id", "chunk_ord", "doc_id", "doc_version", "title", "section_path", "text", "acl_groups", "audience", "sensitivity", "category", "published_at", "valid_until", "demo_assumption", "doc_type", "authority_level", "effective_from", "statutory", "article_ref", "indexed_at"]


def chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return retrieval.latest_chunks(table(spark, root, "chunks", *(columns or CHUNK_COLUMNS)))


def asks(spark: SparkSession, root: str) -> DataFrame:
    """``id, employee_no, qtext``: the golden questions, one row of each id, null and blank ones left out."""
    g = table(spark, root, "golden_set", "id", "user_id", "query").where("id is not null and trim(query) <> ''")
    return g.select("id", "user_id", korean.normalize(F.col("query")).alias("q")).groupBy("id").agg(F.min("user_id").alias("employee_no"), F.min("q").alias("qtext"))


def requests(spark: SparkSession, root: str) -> DataFrame:
    """``id, employee_no, message``: the golden questions as they are sent, one row of each id."""
    g = table(spark, root, "golden_set", "id", "user_id", "query").where("id is not null")
    return g.groupBy("id").agg(F.min("user_id").alias("employee_no"), F.min("query").alias("message"))


def guarded(sent: DataFrame, known: DataFrame) -> DataFrame:
    """``sent`` with ``refusal``, the code of what must not be searched (or null), and ``qtext``, the normal form of what is
    searched: the message with personal values masked and markup taken out. ``known``: employee_no of all users."""
    m = F.coalesce(F.trim("message"), F.lit(""))
    looked = sent.join(known.select("employee_no", F.lit(True).alias("known")), "employee_no", "left").withColumn("scan", text.scan(F.col("message")))
    clean = text.strip_markup(F.coalesce("scan.text", F.lit("")))
    refusal = (
        F.when(F.col("known").isNull(), "E_AUTH").when(m == "", "E_INPUT_INVALID").when(F.length("message") > LONGEST, "E_INPUT_TOO_LONG")
        .when(F.col("scan.action").isin("block", "third_party"), "E_SENSITIVE_BLOCKED").when(clean == "", "E_INPUT_INVALID")
    )
    return looked.select("id", "employee_no", "message", refusal.alias("refusal"), (F.col("scan.action") == "third_party").alias("third_party"), korean.normalize(clean).alias("qtext"))


def documents(spark: SparkSession, root: str) -> DataFrame:
    """knowledge_docs, one row of each document and version: the delivery ingested last."""
    d = table(spark, root, "knowledge_docs").where("doc_id is not null and version is not null")
    rest = [c for c in d.columns if c not in ("doc_id", "version")]
    order = F.struct(F.coalesce(F.col("ingested_at").cast("string"), F.lit("")), F.coalesce("body", F.lit("")))
    return d.groupBy("doc_id", "version").agg(F.max_by(F.struct(*rest), order).alias("d")).select("doc_id", "version", "d.*")


def people(spark: SparkSession, root: str) -> DataFrame:
    return access.users(table(spark, root, "user_profiles"))


_OPEN: dict[tuple[str, str], retrieval.Index] = {}


def index(spark: SparkSession, root: str) -> retrieval.Index:
    """The index of the chunks of ``root``: built and written into the shared folder once for each state of the table,
    then opened by every query, of any session that shares the folder."""
    state = hashlib.sha256(f"{root} {stamp(spark, f'{root}/chunks.parquet')}".encode()).hexdigest()[:16]
    path = f"{shared_dir(spark)}/tessera/index-blocks-{state}"
    known = (spark.sparkContext.applicationId, path)
    if known not in _OPEN:
        if not exists(spark, f"{path}/first/_SUCCESS"):
            retrieval.save_index(retrieval.build_index(cut(chunks(spark, root), "chunks"), cut=cut), path)
        _OPEN[known] = retrieval.open_index(spark, path)
    return _OPEN[known]


def search(spark: SparkSession, root: str, asked: DataFrame | None = None):
    """(asks, index, pool, selected) of the golden questions, or of ``asked`` (id, employee_no, qtext)."""
    a = cut(asks(spark, root) if asked is None else asked, "asks")
    ix = index(spark, root)
    found = retrieval.candidates(a.select("qtext").distinct(), ix)
    pool = cut(retrieval.pools(a, found, ix.chunks, people(spark, root), TODAY), "pool")
    return a, ix, pool, retrieval.select(retrieval.fuse(pool))


@dataclass
class Evidence:
    """A search with its gate; ``pairs`` are the FAQ pairs that answer (see ``faq.hits``), already led by in ``selected``."""

    asks: DataFrame
    index: retrieval.Index
    pool: DataFrame
    unknown: DataFrame
    selected: DataFrame
    gates: DataFrame
    pairs: DataFrame


def gated(spark: SparkSession, root: str, asked: DataFrame | None = None) -> Evidence:
    """The golden questions (or ``asked``) searched, and which of them have evidence: by their scores or by an FAQ pair."""
    a, ix, pool, chosen = search(spark, root, asked)
    chosen = cut(chosen, "selected")
    unknown = cut(retrieval.unknown_subjects(a.select("qtext").distinct(), ix.terms), "unknown")
    pairs = cut(faq.pairs(documents(spark, root), ix.chunks), "pairs")
    found = cut(faq.hits(a, unknown, chosen, pairs, ix.chunks, people(spark, root), TODAY), "hits")
    return Evidence(a, ix, pool, unknown, faq.lead(chosen, found), faq.opened(retrieval.gate(a, pool, chosen, unknown), found), found)


def o23_normalize(spark: SparkSession, root: str) -> DataFrame:
    return chunks(spark, root, "chunk_id", "chunk_ord", "text", "indexed_at").select("chunk_id", korean.normalize(F.col("text")).alias("normal"))


def o27_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Words, stems and bigrams of every chunk, with their counts."""
    return retrieval.token_counts(chunks(spark, root, "chunk_id", "chunk_ord", "section_path", "text", "indexed_at")).select("chunk_ord", "term", "tf", "weighted_tf")


def o28_content_terms(spark: SparkSession, root: str) -> DataFrame:
    a = asks(spark, root)
    return a.select("id", F.array_join(F.array_sort(korean.content_terms(F.col("qtext"))), " ").alias("content"), F.array_join(F.array_sort(korean.subject_terms(F.col("qtext"))), " ").alias("subjects"))


def o49_term_stats(spark: SparkSession, root: str) -> DataFrame:
    return index(spark, root).terms.select("term", "df", F.round("idf_bm25", 6).alias("idf_bm25"), F.round("idf_tfidf", 6).alias("idf_tfidf"))


def o50_scores(spark: SparkSession, root: str) -> DataFrame:
    """BM25 and cosine of every pair of a question and a chunk with a common term."""
    a = asks(spark, root).select("qtext").distinct()
    return retrieval.scores(a, index(spark, root), digits=6)


def o65_candidates(spark: SparkSession, root: str) -> DataFrame:
    a = asks(spark, root).select("qtext").distinct()
    return retrieval.candidates(a, index(spark, root)).select("qtext", "chunk_ord", F.round("bm25", 6).alias("bm25"), F.round("cosine", 6).alias("cosine"))


def o66_pool(spark: SparkSession, root: str) -> DataFrame:
    """Access decision of every candidate of every question and user."""
    return search(spark, root)[2].select("id", "employee_no", "chunk_id", "decision", "filtered_out", "acl_blocked")


def o72_selected(spark: SparkSession, root: str) -> DataFrame:
    """The best chunks of every question after fusion, relative cut and cap per document."""
    return search(spark, root)[3].select("id", "rank", "chunk_id", F.round("bm25_norm", 6).alias("bm25_norm"), F.round("hybrid", 6).alias("hybrid"))


def o74_unknown_subjects(spark: SparkSession, root: str) -> DataFrame:
    return retrieval.unknown_subjects(asks(spark, root).select("qtext").distinct(), index(spark, root).terms).select("qtext", F.array_join("unknown", " ").alias("unknown"))


def o75_gate(spark: SparkSession, root: str) -> DataFrame:
    """Signals of every question and whether they suffice for an answer."""
    return gated(spark, root).gates.select("id", "filtered_out", "acl_blocked", "cos_top1", "hybrid_top1", "citable", F.array_join("unknown", " ").alias("unknown"), "sufficient")


def o82_visible_documents(spark: SparkSession, root: str) -> DataFrame:
    return access.visible_documents(chunks(spark, root), people(spark, root), TODAY)


def o139_scope_counts(spark: SparkSession, root: str) -> DataFrame:
    """Visible documents per user, scope and category, with subtotals."""
    v = o82_visible_documents(spark, root)
    return v.rollup("employee_no", "scope", "category").agg(F.count("*").alias("documents"), F.grouping_id().cast("long").alias("level")).where("employee_no is not null")


def o58_dense(spark: SparkSession, root: str) -> DataFrame:
    """The five nearest vectors by cosine of every vector whose id is divisible by 20, among all vectors."""
    e = table(spark, root, "embeddings", "vec_id", "embedding")
    return retrieval.nearest(e, e.where("vec_id % 20 = 0"))


_ASKS = f"asks as (select id, min(user_id) as employee_no, min({sql.normal('query')}) as qtext from golden_set where id is not null and query is not null and trim(query) <> '' group by id)"

QUERIES = {k: v for k, v in globals().items() if k.startswith("o") and k[1].isdigit()}
SQL = {
    "o23_normalize": f"with {sql.CHUNKS} select chunk_id, {sql.normal('text')} as normal from ch",
    "o27_tokens": f"with {sql.index_ctes()} select chunk_ord, term, tf, wtf as weighted_tf from tfs",
    "o28_content_terms": f"with {_ASKS}, c as (select id, list_distinct({sql.content_terms('qtext')}) as t from asks) select id, array_to_string(list_sort(t), ' ') as content, array_to_string(list_sort(list_filter(t, lambda s: s not in ({sql.INTERROGATIVE_LIST}) and not {sql.predicate('s')})), ' ') as subjects from c",
    "o49_term_stats": f"with {sql.index_ctes()} select term, df, round(idf_bm25, 6) as idf_bm25, round(idf_tfidf, 6) as idf_tfidf from ts",
    "o50_scores": f"with {sql.search_ctes(TODAY)} select qtext, chunk_ord, round(bm25, 6) as bm25, round(cosine, 6) as cosine from sc",
    "o65_candidates": f"with {sql.search_ctes(TODAY)} select qtext, chunk_ord, round(bm25, 6) as bm25, round(cosine, 6) as cosine from cand",
    "o66_pool": f"with {sql.search_ctes(TODAY)} select id, employee_no, chunk_id, decision, count(*) filter (decision <> 'allow') over (partition by id) as filtered_out, bool_or(decision in ('deny_acl', 'deny_sensitivity')) over (partition by id) as acl_blocked from pool",
    "o72_selected": f"with {sql.search_ctes(TODAY)} select id, rank, chunk_id, round(bm25_norm, 6) as bm25_norm, round(hybrid, 6) as hybrid from sel",
    "o74_unknown_subjects": f"with {sql.index_ctes()}, {_ASKS}, qd as (select distinct qtext from asks), {sql.unknown_ctes()} select qtext, array_to_string(unknown, ' ') as unknown from unk",
    "o75_gate": f"""with {sql.search_ctes(TODAY)}, {sql.unknown_ctes()},
pc as (select id, count(*) filter (decision <> 'allow') as filtered_out, bool_or(decision in ('deny_acl', 'deny_sensitivity')) as acl_blocked from pool group by id),
bs as (select id, round(max(greatest(cosine, 0.0)), 4) as cos_top1, round(max(hybrid) filter (rank = 1), 4) as hybrid_top1, count(*) as citable from sel group by id),
al as (select id, coalesce(filtered_out, 0) as filtered_out, coalesce(acl_blocked, false) as acl_blocked, coalesce(cos_top1, 0) as cos_top1, coalesce(hybrid_top1, 0) as hybrid_top1, coalesce(citable, 0) as citable, coalesce(array_to_string(unknown, ' '), '') as unknown from asks left join pc using (id) left join bs using (id) left join unk using (qtext))
select *, citable >= 1 and unknown = '' and hybrid_top1 >= 0.5 and cos_top1 >= 0.229 as sufficient from al""",
    "o82_visible_documents": f"""with {sql.CHUNKS}, f as (select distinct on (doc_id) * from ch order by doc_id, chunk_ord)
select employee_no, case when list_contains(f.acl_groups, 'all_employees') then 'common' when len(list_filter(f.acl_groups, lambda g: g like 'dept:%')) > 0 then 'department' else 'role' end as scope, category, doc_id, title, doc_version
from f, user_profiles u where list_has_any(f.acl_groups, u.acl_groups) and coalesce(list_contains(f.audience, 'all') or list_contains(f.audience, u.employment_type), false)
and not coalesce(valid_until < '{TODAY}', false) and not coalesce(coalesce(nullif(effective_from, ''), published_at) > '{TODAY}', false) and not coalesce(sensitivity = 'restricted' and u.role is distinct from 'hr_admin', false)""",
    "o58_dense": """with p as (select q.vec_id as query_id, e.vec_id, round(coalesce(list_dot_product(q.embedding::double[], e.embedding::double[]) / nullif(sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]) * list_dot_product(e.embedding::double[], e.embedding::double[])), 0), 0), 6) as cosine
from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id), r as (select *, row_number() over (partition by query_id order by cosine desc, vec_id) as rank from p) select query_id, rank, vec_id, cosine from r where rank <= 5""",
}
SQL["o139_scope_counts"] = f"select employee_no, scope, category, count(*) as documents, grouping(employee_no, scope, category) as level from ({SQL['o82_visible_documents']}) group by rollup (employee_no, scope, category) having employee_no is not null"
