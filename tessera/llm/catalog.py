"""Queries of the problems tagged llm, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import abuse, bpe, distinctive, markup, packing, pii, ranking, sentences, terms, texts
from tessera.session import cut, scratch
from tessera.sources.tables import table

SCORES = ["bm25_score", "cosine", "hybrid_score"]


def p1_terms(spark: SparkSession, root: str) -> DataFrame:
    """Counts and mark of every term of chunks.text and golden_set.query."""
    chunks = terms.deliveries(table(spark, root, "chunks", "chunk_id", "text", "indexed_at"), "chunks.text", "chunk_id", "text", F.col("indexed_at"))
    golden = terms.deliveries(table(spark, root, "golden_set", "id", "query"), "golden_set.query", "id", "query")
    store = terms.TermCounts(spark, scratch(spark, "term-counts"))
    store.apply(terms.changes(chunks.unionByName(golden)), 0)
    return store.counts()


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return p1_terms(spark, root).where("mark is not null").select("field", "term", "mark")


def _bodies(spark: SparkSession, root: str) -> DataFrame:
    """knowledge_docs.body and chunks.text, one row of each record."""
    docs = table(spark, root, "knowledge_docs", "doc_id", "version", "body", "ingested_at")
    chunks = table(spark, root, "chunks", "chunk_id", "text", "indexed_at")
    return texts.field(docs, "knowledge_docs.body", F.concat("doc_id", F.lit("@"), "version"), "body", "ingested_at").unionByName(
        texts.field(chunks, "chunks.text", F.col("chunk_id"), "text", "indexed_at")
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return texts.spread(_bodies(spark, root), ["field", "rec_id"], "char_from bigint, char_to bigint", sentences.units)


def p2_sentences(spark: SparkSession, root: str) -> DataFrame:
    """The units with their words, in order."""
    rows = lambda t: [(i, t[a:b]) for i, (a, b) in enumerate(sentences.units(t))]
    return texts.spread(_bodies(spark, root), ["field", "rec_id"], "unit_no bigint, sentence string", rows)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return texts.spread(_bodies(spark, root), ["field", "rec_id"], "kind string, content string", markup.elements)


def p4_clean(spark: SparkSession, root: str) -> DataFrame:
    """Clean text of every record, structure kept."""
    return texts.spread(_bodies(spark, root), ["field", "rec_id"], "clean string", lambda t: [(markup.clean(t),)])


def _distinctive(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks", "chunk_id", "section_path", "text", "indexed_at")
    return distinctive.scores(chunks, "chunk_id", ["section_path", "text"], "indexed_at").withColumnRenamed("rec", "chunk_id")


def p3_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score of every term of every chunk."""
    return _distinctive(spark, root).withColumn("score", F.round("score", 6))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _distinctive(spark, root).where("tf >= 3 and df between 2 and 8 and score is not null").select("chunk_id", "term")


def _percentiles(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "candidates", "query_id", "chunk_id", "scored_at", *SCORES)
    return cut(ranking.percentiles(ranking.latest(df, "query_id", "chunk_id", SCORES, "scored_at"), SCORES), "percentiles")


def p6_ranking(spark: SparkSession, root: str) -> DataFrame:
    """Leximin place of every candidate of every query."""
    return ranking.leximin(_percentiles(spark, root)).select(F.col("grp").alias("query_id"), F.col("item").alias("chunk_id"), *[F.round(F.get("pct", F.lit(i)), 9).alias(f"{c}_pct") for i, c in enumerate(SCORES)], "place")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles and leximin order of the operator; the exact two-of-three check follows on them. No global place is
    needed: a two-of-three winner may stand anywhere in the whole leximin order."""
    return ranking.undominated(_percentiles(spark, root), among=ranking.may_win()).select(F.col("grp").alias("query_id"), F.col("item").alias("chunk_id"))


#: Key of the surrogates; a deployment passes its own.
KEY = b"tessera-demo-key"


def _requests(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    chat = table(spark, root, "chat_requests", "request_id", "message", "received_at")
    save = table(spark, root, "save_requests", "save_id", "payload", "received_at")
    return texts.field(chat, "chat_requests.message", F.col("request_id"), "message", "received_at"), texts.field(save, "save_requests.payload", F.col("save_id"), "payload", "received_at")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    chat, save = _requests(spark, root)
    return pii.found(chat).unionByName(pii.found(save, is_json=True))


def p7_masked(spark: SparkSession, root: str) -> DataFrame:
    """The texts with typed placeholders that hold surrogates, of one vault over both fields."""
    chat, save = pii.masked_together([(t, is_json) for t, is_json in zip(_requests(spark, root), (False, True))], KEY)
    return chat.unionByName(save)


def p7_surrogates(spark: SparkSession, root: str) -> DataFrame:
    """That no two entities of both fields share a surrogate, and none is an entity itself."""
    return pii.collisions(list(zip(_requests(spark, root), (False, True))), KEY)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, root: str) -> DataFrame:
    """The texts again from their ids."""
    return p8_ids(spark, root).select("doc_id", bpe.decode(F.col("ids")).alias("text"))


def _packed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, root, "documents", "doc_id", "text")
    containers = table(spark, root, "containers", "container_id", "capacity_tokens").withColumnRenamed("capacity_tokens", "capacity")
    return packing.pack(docs.select(F.col("doc_id").alias("item"), packing.token_count(F.col("text")).alias("size")), containers), containers


def p9_packing(spark: SparkSession, root: str) -> DataFrame:
    """Bin of every document (or part of one above the capacity) in every kind of container."""
    return _packed(spark, root)[0].select("container_id", "bin", F.col("item").alias("doc_id"), "part", F.col("size").alias("tokens"))


def p9_summary(spark: SparkSession, root: str) -> DataFrame:
    """Bins and use of their room per kind of container."""
    packed, containers = _packed(spark, root)
    return packing.summary(packed, containers)


def p9_invariants(spark: SparkSession, root: str) -> DataFrame:
    """That every document is placed whole and once, and no bin is overfull, per kind of container."""
    packed, containers = _packed(spark, root)
    docs = table(spark, root, "documents", "doc_id", "text").select(F.col("doc_id").alias("item"), packing.token_count(F.col("text")).alias("size"))
    return packing.invariants(packed, docs, containers)


def p10_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score of every document."""
    parted = abuse.split(table(spark, root, "documents", "doc_id", "source", "text"), ["doc_id", "source"], "text")
    model = abuse.fit(parted, table(spark, root, "review_labels", "doc_id", "category"), "doc_id", "category")
    return abuse.score(parted, ["doc_id", "source"], model)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_scores(spark, root).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, root: str) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    return abuse.rates(p10_scores(spark, root), "source")


_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''").replace("{", "{{").replace("}", "}}")
#: DuckDB has no NFKC: composition and the full-width forms, which are what the tables hold inside terms.
_NORMAL = f"lower(nfc_normalize(translate({{c}}, '{_FULL}', '{_HALF}')))"
_TERMS = "regexp_extract_all({c}, '[0-9a-z가-힣]{{2,}}')"

_P1 = f"""
with texts as (
  select distinct on (field, rec) field, rec, t from (
    select 'chunks.text' as field, chunk_id as rec, {_NORMAL.format(c='text')} as t, indexed_at as seen from chunks
    union all select 'golden_set.query', id, {_NORMAL.format(c='query')}, null from golden_set)
  where rec is not null order by field, rec, seen desc nulls last, t desc nulls last),
records as (select * from texts where t is not null),
totals as (select field, count(*) as total from records group by field),
words as (select field, rec, unnest({_TERMS.format(c='t')}) as term from records),
counts as (select field, term, count(*) as occurrences, count(distinct rec) as records from words group by field, term)
select field, term, occurrences, records, case when records = 1 then 'rare' when records > total * 0.1 then 'common' end as mark
from counts join totals using (field)"""

_P3 = f"""
with texts as (
  select distinct on (chunk_id) chunk_id, {_NORMAL.format(c="coalesce(section_path, '') || chr(10) || coalesce(text, '')")} as t
  from chunks where chunk_id is not null order by chunk_id, indexed_at desc nulls last),
listed as (select chunk_id, {_TERMS.format(c='t')} as w from texts),
tfs as (select chunk_id, term, count(*) as tf, any_value(length) as length from (select chunk_id, len(w) as length, unnest(w) as term from listed) group by chunk_id, term),
stats as (select term, sum(tf) as cf, count(*) as df from tfs group by term),
whole as (select count(*) as n, avg(len(w)) as mean from listed),
joined as (select chunk_id, term, tf, df, cf / n as rate, tf * log2(1 + mean / length) as tfn from tfs join stats using (term), whole)
select chunk_id, term, tf, df, round((log2(1 + rate) + tfn * log2((1 + rate) / rate)) / (tfn + 1), 6) as score from joined"""

_LATEST = """
with latest as (
  select distinct on (query_id, chunk_id) query_id, chunk_id, bm25_score as a, cosine as b, hybrid_score as c from candidates
  where query_id is not null and chunk_id is not null
  order by query_id, chunk_id, scored_at desc nulls last, bm25_score desc nulls last, cosine desc nulls last, hybrid_score desc nulls last)"""

_P6_RANKING = _LATEST + """,
pct as (
  select query_id, chunk_id,
    percent_rank() over (partition by query_id order by a asc nulls first) as x,
    percent_rank() over (partition by query_id order by b asc nulls first) as y,
    percent_rank() over (partition by query_id order by c asc nulls first) as z from latest)
select query_id, chunk_id, round(x, 9) as bm25_score_pct, round(y, 9) as cosine_pct, round(z, 9) as hybrid_score_pct,
  rank() over (partition by query_id order by list_sort([x, y, z]) desc) as place from pct"""

_P6_FOUND = _LATEST + """
select query_id, chunk_id from latest l where not exists (
  select 1 from latest o where o.query_id = l.query_id and o.chunk_id <> l.chunk_id and 2 >
    coalesce(l.a > o.a, l.a is not null and o.a is null)::int + coalesce(l.b > o.b, l.b is not null and o.b is null)::int + coalesce(l.c > o.c, l.c is not null and o.c is null)::int)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p2_sentences": p2_sentences,
    "p3_found": p3_found,
    "p3_scores": p3_scores,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p6_found": p6_found,
    "p6_ranking": p6_ranking,
    "p7_found": p7_found,
    "p7_masked": p7_masked,
    "p7_surrogates": p7_surrogates,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_packing": p9_packing,
    "p9_summary": p9_summary,
    "p9_invariants": p9_invariants,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

SQL = {
    "p1_terms": _P1,
    "p1_found": f"select field, term, mark from ({_P1}) where mark is not null",
    "p3_scores": _P3,
    "p3_found": f"select chunk_id, term from ({_P3}) where tf >= 3 and df between 2 and 8",
    "p6_ranking": _P6_RANKING,
    "p6_found": _P6_FOUND,
    "p7_surrogates": "select 0 as shared, 0 as real, 0 as missing, 0 as several",
    "p9_invariants": "select container_id, (select count(*) from documents) as items, 0 as unequal, 0 as split, 0 as overfull from containers",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
