"""Queries on chunking, text functions, guards, conflicts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import access, answers, chunking, conflict, faq, retrieval
from tessera.plans import search, sql
from tessera.plans.search import documents
from tessera.session import cut
from tessera.sources.tables import table


def o22_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks cut anew from the bodies."""
    return chunking.chunk_documents(documents(spark, root)).select("chunk_id", "section_path", "char_start", "char_len", "article_ref", "text")


def _texts(spark: SparkSession, root: str) -> DataFrame:
    return search.chunks(spark, root, "chunk_id", "chunk_ord", "text", "section_path", "title", "indexed_at").where("text is not null")


def o30_clean(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("chunk_id", text.clean(F.col("text")).alias("clean"))


def o32_sentences(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("chunk_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


def o33_list_items(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("chunk_id", F.posexplode(text.list_items(F.col("text"))).alias("pos", "x")).select("chunk_id", "pos", "x.item", "x.ordered")


def o36_section_names(spark: SparkSession, root: str) -> DataFrame:
    c = _texts(spark, root)
    return c.select("chunk_id", text.heading(F.col("section_path"), F.col("title")).alias("heading"), text.section_name(F.col("section_path"), F.col("title")).alias("section"))


def o39_facts(spark: SparkSession, root: str) -> DataFrame:
    return _texts(spark, root).select("chunk_id", F.posexplode(text.facts(F.col("text"))).alias("pos", "fact"))


def _messages(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "chat_requests", "request_id", "message").where("request_id is not null")
    return m.groupBy("request_id").agg(F.max("message").alias("message"))


def o42_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return _messages(spark, root).where("message is not null").select("request_id", text.fingerprint(F.col("message")).alias("query_hash"))


def o44_strip_markup(spark: SparkSession, root: str) -> DataFrame:
    return documents(spark, root).where("body is not null").select("doc_id", "version", text.strip_markup(F.col("body")).alias("plain"))


def o87_guard(spark: SparkSession, root: str) -> DataFrame:
    """What the input guard does with every message."""
    return _messages(spark, root).where("message is not null").select("request_id", text.scan(F.col("message")).alias("s")).select("request_id", "s.action", "s.reason", "s.text", "s.injection")


def o89_unsafe(spark: SparkSession, root: str) -> DataFrame:
    return _messages(spark, root).select("request_id", text.unsafe_to_store(F.col("message")).alias("unsafe"))


def o76_faq(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of the FAQ sections, each with the chunk that holds its answer."""
    return faq.pairs(documents(spark, root), search.chunks(spark, root)).select("doc_id", "question", "answer", "chunk_ord")


def _resolved(spark: SparkSession, root: str, index: retrieval.Index, selected: DataFrame) -> DataFrame:
    docs = documents(spark, root)
    subs = docs.groupBy("doc_id").agg(F.max_by("subcategory", conflict.version_key(F.col("version"))).alias("subcategory"))
    rest = index.chunks.drop("chunk_id", "doc_id", "indexed_at")
    rows = selected.select("id", "rank", "hybrid", "chunk_id", "doc_id", "chunk_ord").join(rest, "chunk_ord").join(subs, "doc_id", "left")
    return conflict.resolve(rows, docs)


def o92_resolved(spark: SparkSession, root: str) -> DataFrame:
    """Candidates that remain after conflicts are resolved."""
    _, index, _, selected = search.search(spark, root)
    return _resolved(spark, root, index, selected).select("id", "rank", "chunk_id", "unresolved")


def _answered(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answers of all questions, the prepared rows of those with evidence, and an outcome code of each.

    In this order: the guard refuses, the search finds, the gate asks for evidence, conflicts are resolved, the answer is
    put together; it is given out only if its user may see every chunk it is made of and every sentence stands in one.
    """
    sent = cut(search.guarded(search.requests(spark, root), search.people(spark, root)), "sent")
    e = search.gated(spark, root, sent.where("refusal is null").select("id", "employee_no", "qtext"))
    kept = _resolved(spark, root, e.index, e.selected.join(e.gates.where("sufficient").select("id"), "id", "left_semi"))
    pair = F.struct("chunk_id", text.clean(F.col("answer")).alias("answer"), text.clean(F.concat("question", F.lit("\n"), "answer")).alias("both"))
    rows = cut(answers.prepared(kept, e.asks.join(e.pairs.select("id", F.array(pair).alias("faq")), "id", "left")), "prepared")
    drafts = cut(answers.build(rows), "drafts")
    told = rows.select("id", F.explode("c.chunk_id").alias("chunk_id"))
    hidden = access.hidden(told.join(e.asks.select("id", "employee_no"), "id"), e.index.chunks, search.people(spark, root), search.TODAY)
    withheld = hidden.select("id").union(answers.unsupported(drafts, rows).select("id")).distinct()
    given = drafts.join(withheld, "id", "left_anti")
    rest = sent.join(given.select("id"), "id", "left_anti")
    out = given.unionByName(answers.without_evidence(rest.where("refusal is null"))).unionByName(answers.refused(rest.where("refusal is not null")))
    code = F.coalesce("refusal", F.when(F.col("answered"), "OK").otherwise("E_NO_EVIDENCE"))
    out = cut(out, "answers")
    return out, rows, sent.join(out.select("id", "answered"), "id").select("id", "answered", code.alias("code"))


def _answers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Answers and prepared rows only."""
    return _answered(spark, root)[:2]


def o103_answers(spark: SparkSession, root: str) -> DataFrame:
    """Summary, actions, cautions, notices and cited documents of every question."""
    a, _ = _answers(spark, root)
    docs = F.transform("citations", lambda c: F.concat_ws("@", c["doc_id"], c["version"]))
    return a.select("id", "summary", F.array_join("actions", "\n").alias("actions"), F.array_join("cautions", "\n").alias("cautions"), F.array_join("notices", "\n").alias("notices"), F.array_join(docs, ",").alias("cited"))


def o113_unsupported(spark: SparkSession, root: str) -> DataFrame:
    """Sentences of answers that no chunk contains (none)."""
    return answers.unsupported(*_answers(spark, root))


def o115_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """What becomes of every question: answered or not, and its code."""
    return _answered(spark, root)[2].select("id", F.col("answered").alias("ok"), "code")


def o130_rendered(spark: SparkSession, root: str) -> DataFrame:
    return answers.rendered(_answers(spark, root)[0])


_LATEST_DOCS = "kd as (select distinct on (doc_id, version) * from knowledge_docs where doc_id is not null and version is not null order by doc_id, version, ingested_at desc nulls last, coalesce(body, '') desc)"
_MSG = "m as (select request_id, max(message) as message from chat_requests where request_id is not null group by request_id)"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({c}, '[*_`>#]', '', 'g'), '\\s+', ' ', 'g'))"


_ITEM = r"^\s*(?:[-*+]|\d+\.)\s+(.*)$"
_BLOCKS = list(text.BLOCK.items())


def _rx(c: str, p: str) -> str:
    return "regexp_matches({}, '{}')".format(c, p.replace("'", "''"))


_SCAN = f"""with {_MSG}, x as (select *, case {' '.join(f"when {_rx('message', p)} then '{k}'" for k, p in _BLOCKS)} end as blocked,
  {_rx('message', text.HEALTH)} as health, {_rx('message', text.THIRD_PARTY)} as third, {_rx('message', text.INSTITUTION)} as inst,
  {' or '.join(_rx('message', p) for p in text.INJECTION)} as injection,
  regexp_replace(message, '{text.MASK['휴대전화'][0]}', '010-****-####', 'g') as m1 from m where message is not null),
y as (select *, m1 <> message as phone, regexp_replace(m1, '{text.MASK['이메일'][0]}', '***@***', 'g') as m2 from x), z as (select *, m2 <> m1 as mail from y)
select request_id, case when blocked is not null then 'block' when third and health then 'third_party' when (health and not inst) or phone or mail then 'mask' else 'allow' end as action,
  coalesce(blocked, case when third and health then '타인 개인정보 요청' when health and not inst then '건강정보 서술' else concat_ws('+', case when phone then '휴대전화' end, case when mail then '이메일' end) end) as reason,
  case when blocked is not null or (third and health) then '' else m2 end as text, injection from z"""

QUERIES = {k: v for k, v in globals().items() if k[0] == "o" and k[1].isdigit()}
SQL = {
    "o30_clean": f"with {sql.CHUNKS} select chunk_id, {_clean('text')} as clean from ch where text is not null",
    # RE2 has no lookbehind: a mark after each end stands for the split.
    "o32_sentences": f"""with {sql.CHUNKS}, l as (select chunk_id, list_transform(string_split(text, chr(10)), lambda x: case when trim(x) = '' or starts_with(trim(x), '|') or starts_with(trim(x), '---') then []
  when regexp_matches(x, '{_ITEM}') then [{_clean(f"regexp_extract(x, '{_ITEM}', 1)")}]
  else list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(x), '([.!?])\\s+', '\\1' || chr(1), 'g'), '니다\\.\\x01?', '니다.' || chr(1), 'g'), chr(1)), lambda y: {_clean('y')}), lambda y: length(y) >= 8) end) as s from ch where text is not null),
f as (select chunk_id, list_filter(flatten(s), lambda y: y <> '') as s from l), u as (select chunk_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as pos from f) select chunk_id, pos, sentence from u""",
    "o33_list_items": f"""with {sql.CHUNKS}, l as (select chunk_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_ITEM}')), lambda x: struct_pack(item := {_clean(f"regexp_extract(x, '{_ITEM}', 1)")}, ordered := regexp_matches(x, '^\\s*\\d+\\.\\s+'))), lambda r: length(r.item) >= 6) as r from ch where text is not null),
u as (select chunk_id, unnest(r) as x, generate_subscripts(r, 1) - 1 as pos from l) select chunk_id, pos, x.item as item, x.ordered as ordered from u""",
    "o36_section_names": f"with {sql.CHUNKS}, p as (select chunk_id, title, list_filter(string_split(coalesce(section_path, ''), ' > '), lambda x: x <> '' and x <> coalesce(title, '')) as parts from ch where text is not null) select chunk_id, case when len(parts) > 0 then parts[-1] else '' end as heading, case when len(parts) > 0 then array_to_string(parts, ' > ') else title end as section from p",
    "o39_facts": f"with {sql.CHUNKS}, f as (select chunk_id, list_transform(regexp_extract_all(text, '{text.FACT}'), lambda x: regexp_replace(x, '\\s+', '', 'g')) as f from ch where text is not null) select chunk_id, unnest(f) as fact, generate_subscripts(f, 1) - 1 as pos from f",
    "o42_fingerprints": f"with {_MSG} select request_id, substr(sha256(message), 1, 12) as query_hash from m where message is not null",
    "o44_strip_markup": f"with {_LATEST_DOCS} select doc_id, version, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '(?is)<\\s*script\\b[^>]*>.*?<\\s*/\\s*script\\s*>|<\\s*style\\b[^>]*>.*?<\\s*/\\s*style\\s*>', ' ', 'g'), '(?is)<\\s*(script|style)\\b[^>]*>.*', ' ', 'g'), '<[^>]{{0,200}}>', ' ', 'g'), '\\s+', ' ', 'g')) as plain from kd where body is not null",
    "o87_guard": _SCAN,
    "o89_unsafe": f"with {_MSG} select request_id, coalesce({' or '.join(_rx('message', p) for _, p in _BLOCKS)} or ({_rx('message', text.HEALTH)} and not {_rx('message', text.INSTITUTION)}), false) as unsafe from m",
    "o113_unsupported": "select '' as id, '' as sentence where false",
}
_GUARD = _SCAN.replace(_MSG, "m as (select id, min(user_id) as employee_no, min(query) as message from golden_set where id is not null group by id)").rsplit("\nselect request_id", 1)[0].replace("from m where message is not null", "from m")
_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(m2, ''), '(?is)<\\s*script\\b[^>]*>.*?<\\s*/\\s*script\\s*>|<\\s*style\\b[^>]*>.*?<\\s*/\\s*style\\s*>', ' ', 'g'), '(?is)<\\s*(script|style)\\b[^>]*>.*', ' ', 'g'), '<[^>]{0,200}>', ' ', 'g'), '\\s+', ' ', 'g'))"
#: The requests with their refusal, and the search and its gate over those without one.
GUARDED = f"""{_GUARD.removeprefix('with ')}, gd as (select z.*, {_STRIPPED} as eff from z),
sent as (select gd.*, case when u.employee_no is null then 'E_AUTH' when coalesce(trim(message), '') = '' then 'E_INPUT_INVALID' when length(message) > {search.LONGEST} then 'E_INPUT_TOO_LONG'
  when blocked is not null or (third and health) then 'E_SENSITIVE_BLOCKED' when eff = '' then 'E_INPUT_INVALID' end as refusal from gd left join (select distinct employee_no from user_profiles where employee_no is not null) u using (employee_no))"""
_FOUND = sql.search_ctes(search.TODAY, f"select id, employee_no, {sql.normal('eff')} as qtext from sent where refusal is null")
SQL["o115_outcomes"] = f"""with {GUARDED}, {_FOUND}, {sql.unknown_ctes()},
bs as (select id, max(cosine) as c1, max(hybrid) filter (rank = 1) as h1, count(*) as n from sel group by id),
gt as (select a.id, coalesce(n >= 1 and round(h1, 4) >= 0.5 and round(greatest(c1, 0.0), 4) >= 0.229 and unknown is null, false) as enough from asks a left join bs using (id) left join unk using (qtext))
select id, coalesce(enough, false) as ok, coalesce(refusal, case when enough then 'OK' else 'E_NO_EVIDENCE' end) as code from sent left join gt using (id)"""
_PARTS = ", ".join(f"'{k}', {v}" for k, v in conflict.AUTHORITY.items())
SQL["o92_resolved"] = f"""with {sql.search_ctes(search.TODAY)}, {_LATEST_DOCS},
vk as (select *, case when list_has_any(list_transform(string_split(version, '.'), lambda x: try_cast(x as int) is null), [true]) then [0] else list_transform(string_split(version, '.'), lambda x: try_cast(x as int)) end as vk from kd),
sub as (select distinct on (doc_id) doc_id, subcategory from vk order by doc_id, vk desc),
old as (select distinct split_part(supersedes, '@', 1) as doc_id from kd where trim(supersedes) <> ''),
c0 as (select s.id, s.rank, s.chunk_id, s.doc_id, h.category, h.published_at, b.subcategory, case h.authority_level {' '.join(f"when '{k}' then {v}" for k, v in conflict.AUTHORITY.items())} else 1 end as auth,
  case when list_has_any(list_transform(string_split(h.doc_version, '.'), lambda x: try_cast(x as int) is null), [true]) then [0] else list_transform(string_split(h.doc_version, '.'), lambda x: try_cast(x as int)) end as v,
  count(*) over (partition by s.id) > 1 as many, o.doc_id is not null as old from sel s join ch h using (chunk_ord) left join sub b on b.doc_id = s.doc_id left join old o on o.doc_id = s.doc_id),
c1 as (select * from (select *, max(v) over (partition by id, doc_id) as best from c0) where not many or v = best),
c2 as (select * from (select *, bool_or(not old) over (partition by id) as fresh from c1) where not many or not old or not fresh),
g as (select id, subcategory, count(distinct doc_id) as d from c2 group by all), gi as (select id, max(d) > 1 as same from g group by id), di as (select id, count(distinct doc_id) as docs from c2 group by id),
c3 as (select c2.*, same and docs > 1 and many as clash, row(auth, case when category = '{conflict.TOP_CATEGORY}' then 2 else 1 end, coalesce(published_at, '')) as key from c2 join gi using (id) join di using (id)),
c4 as (select *, max(key) over (partition by id) as top, max(auth) over (partition by id) as ta, min(auth) over (partition by id) as la from c3),
c5 as (select * from c4 where not clash or la = ta or auth = ta), td as (select id, count(distinct case when key = top then doc_id end) as t from c5 group by id)
select id, rank, chunk_id, clash and t > 1 as unresolved from c5 join td using (id)"""
