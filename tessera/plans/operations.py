"""Queries on turns, rate limits, saved items, evaluation, lint and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, conflict, quality, saved, sessions
from tessera.plans import answering, search, sql
from tessera.sources.tables import table


def _turns(spark: SparkSession, root: str) -> DataFrame:
    """One row of each request: the delivery received first."""
    c = table(spark, root, "chat_requests").where("request_id is not null")
    first = F.min_by(F.struct("employee_no", "session_id", "message", "sent_at", "received_at"), F.struct(F.coalesce(F.col("received_at").cast("string"), F.lit("")), F.coalesce("message", F.lit(""))))
    return c.groupBy("request_id").agg(first.alias("r")).select("request_id", "r.*")


def o117_rewritten(spark: SparkSession, root: str) -> DataFrame:
    """What each turn searches for, follow-ups led by the terms of the last answered question."""
    t = _turns(spark, root)
    ok = F.coalesce(F.trim("message") != "", F.lit(False)) & ~text.scan(F.col("message"))["action"].isin("block", "third_party")
    turns = t.select("session_id", F.col("request_id").alias("turn_id"), F.col("sent_at").alias("at"), "message", ok.alias("ok"))
    return sessions.rewritten(turns).select(F.col("turn_id").alias("request_id"), "search_text")


def o118_rate_limit(spark: SparkSession, root: str) -> DataFrame:
    """Which requests a limit of 2 in 10 minutes accepts (the tables are sparser than a live service)."""
    t = _turns(spark, root).select("employee_no", "request_id", "sent_at")
    return sessions.rate_limited(t, "employee_no", "request_id", "sent_at", limit=2, period=600.0).select("request_id", "accepted")


def o120_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Outcome codes per user, fingerprints instead of texts."""
    t = _turns(spark, root).select(F.col("request_id").alias("id"), "employee_no", "message")
    return search.guarded(t, search.people(spark, root)).groupBy("employee_no", F.coalesce("refusal", F.lit("OK")).alias("code")).agg(F.count("*").alias("requests"))


def o121_retained(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "save_requests", "save_id", "kind", "requested_at").distinct()
    return sessions.retained(s, "kind", "requested_at", {"checklist": 90, "saved_answers": 365}, "2026-06-30").select("save_id", "kind")


def o122_usage(spark: SparkSession, root: str) -> DataFrame:
    return quality.usage(table(spark, root, "chat_requests"), "employee_no", "sent_at", "received_at", "message")


def _items(spark: SparkSession, root: str) -> DataFrame:
    events = saved.additions(table(spark, root, "save_requests"), "employee_no", "kind", "payload", "save_id", "requested_at")
    none = events.select("employee_no", "kind", F.col("at").alias("seen_at")).where("false")
    docs = answering.documents(spark, root)
    current = docs.groupBy("doc_id").agg(F.max_by("version", conflict.version_key(F.col("version"))).alias("version"))
    return saved.annotated(saved.state(events), none, current)


def o124_saved_items(spark: SparkSession, root: str) -> DataFrame:
    """Items in their latest state, with the documents that changed since."""
    return _items(spark, root).select("employee_no", "kind", "item_id", F.size("item.actions").alias("actions"), F.size("item.citations").alias("citations"), "done", "is_new", F.coalesce(F.array_join("stale", ", "), F.lit("")).alias("stale"))


def o129_saved_counts(spark: SparkSession, root: str) -> DataFrame:
    return saved.counts(_items(spark, root))


def _golden(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "golden_set").where("id is not null")
    rest = ["query", "query_type", "expected_docs", "expected_behavior", "must_contain", "must_not_contain"]
    return g.groupBy("id").agg(F.min(F.struct(*rest)).alias("g")).select("id", "g.*")


def o131_assertions(spark: SparkSession, root: str) -> DataFrame:
    """Phrases rendered answers lack or must not hold, and behaviour other than expected."""
    told = answering._answers(spark, root)[0]
    found = quality.assertions(_golden(spark, root), answers.rendered(told), told.select("id", "answered", "citations"))
    return found.select("id", F.array_join("missing", "\n").alias("missing"), F.array_join("forbidden", "\n").alias("forbidden"), F.coalesce("behaviour", F.lit("")).alias("behaviour"))


def o132_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Recall and block rates per question type."""
    e = search.gated(spark, root)
    m = quality.metrics(_golden(spark, root), e.selected, e.gates)
    return m.select("query_type", "items", *[F.round(c, 6).alias(c) for c in ("recall", "blocked", "false_blocked")])


def o134_sweep(spark: SparkSession, root: str) -> DataFrame:
    """Recall and separation of the scores per blend weight, the best one marked."""
    e = search.gated(spark, root)
    s = quality.sweep(e.pool, _golden(spark, root), e.unknown, e.pairs)
    figures = ["recall", *[p + c for p in ("", "cos_") for c in ("least_answerable", "greatest_blocked", "gap", "threshold")]]
    return s.select("alpha", *[F.round(c, 6).alias(c) for c in figures], "best")


def o135_lint(spark: SparkSession, root: str) -> DataFrame:
    return quality.lint(table(spark, root, "knowledge_docs"))


def o136_metadata_changes(spark: SparkSession, root: str, days: list[str] | None = None) -> DataFrame:
    """What the registry changed from snapshot to snapshot, or between those of ``days`` only."""
    r = table(spark, root, "doc_registry", "doc_id", "snapshot_date", "loaded_at", "version", "status", "owner_dept", "valid_until")
    return quality.successive_changes(r, "doc_id", "snapshot_date", "loaded_at", ["version", "status", "owner_dept", "valid_until"], days)


_TURNS = "t as (select distinct on (request_id) * from chat_requests where request_id is not null order by request_id, received_at nulls first, coalesce(message, ''))"
_BLOCKED = "(" + " or ".join(answering._rx("message", p) for p in text.BLOCK.values()) + f" or ({answering._rx('message', text.THIRD_PARTY)} and {answering._rx('message', text.HEALTH)}))"
_REQUIRED = " union all ".join(f"select doc_id, version, 'missing {c}' as problem from knowledge_docs where {c} is null or {'len(' + c + ') = 0' if c in ('audience', 'acl_groups') else 'trim(' + c + ') = chr(0)[1:0]'}" for c in quality.REQUIRED)
_DAY = r"^\d{4}-\d{2}-\d{2}$"

_M = "m as (select request_id as id, employee_no, message from t), x as"

QUERIES = {k: v for k, v in globals().items() if k[0] == "o" and k[1].isdigit()}
SQL = {
    "o117_rewritten": f"""with {_TURNS}, f as (select *, coalesce(trim(message) <> '' and not {_BLOCKED}, false) as ok from t),
l as (select *, case when session_id is not null then last_value(case when ok then substr(message, 1, 200) end ignore nulls) over (partition by session_id order by sent_at, request_id rows between unbounded preceding and 1 preceding) end as last from f),
x as (select *, case when last is not null and (length(trim(message)) < {sessions.SHORT} or {' or '.join(f"starts_with(trim(message), '{s}')" for s in sessions.STARTERS)} or regexp_matches(trim(message), '{sessions.NOUNLESS}')) then {sql.content_terms(sql.normal('last'))} end as ct from l),
d as (select *, list_filter(ct, lambda s, i: list_position(ct, s) = i) as u from x)
select request_id, case when len(u) > 0 then array_to_string(u[1:3], ' ') || ' ' || trim(message) else message end as search_text from d""",
    "o120_outcomes": f"with {_TURNS}, {answering.GUARDED.split(', x as', 1)[1].join([_M, ''])} select employee_no, coalesce(refusal, 'OK') as code, count(*) as requests from sent group by all",
    "o121_retained": "select distinct save_id, kind from save_requests where case kind when 'checklist' then date_diff('day', requested_at::date, date '2026-06-30') <= 90 when 'saved_answers' then date_diff('day', requested_at::date, date '2026-06-30') <= 365 else true end",
    "o122_usage": "select date_trunc('hour', sent_at) as hour, count(*) as requests, count(distinct employee_no) as users, count(*) filter (coalesce(trim(message), '') = '') as empty, quantile_cont(epoch(received_at) - epoch(sent_at), 0.5) as p50, quantile_cont(epoch(received_at) - epoch(sent_at), 0.95) as p95 from chat_requests where sent_at is not null group by 1",
    # From the definition: questions of the seven types that scores decide, not those an unknown subject blocks.
    "o134_sweep": f"""with {sql.search_ctes(search.TODAY)}, {sql.unknown_ctes()}, al as (select unnest({quality.ALPHAS}::double[]) as alpha),
ha as (select al.alpha, nr.*, round(al.alpha * bm25_norm + (1 - al.alpha) * greatest(cosine, 0.0), 9) as hyb from nr, al),
pa as (select *, row_number() over (partition by alpha, id order by hyb desc, chunk_ord) as place from ha),
na as (select * from (select *, doc_id = first_value(doc_id) over w or hyb >= first_value(hyb) over w * 0.62 as near from pa window w as (partition by alpha, id order by place)) where near),
ca as (select * from (select *, row_number() over (partition by alpha, id, doc_id order by place) as od from na) where od <= 3),
sa as (select * from (select *, row_number() over (partition by alpha, id order by place) as rank from ca) where rank <= 5),
ba as (select alpha, id, round(max(hyb) filter (rank = 1), 4) as top, round(max(greatest(cosine, 0.0)), 4) as cos, list(doc_id) as docs from sa group by all),
seen as (select id, any_value(qtext) as qtext, bool_or(decision = 'allow') as seen from pool group by id),
ga as (select id, min(row(query, query_type, expected_docs)) as g from golden_set where id is not null group by id),
it as (select al.alpha, ga.id, g[2] as kind, g[3] as ed, coalesce(top, 0.0) as top, coalesce(cos, 0.0) as cos, docs from al, ga join seen using (id) left join unk using (qtext) left join ba on ba.id = ga.id and ba.alpha = al.alpha
  where g[2] in ({sql.quoted(quality.ANSWERED + quality.BLOCKED)}) and (unknown is null or not seen)),
ja as (select alpha, coalesce(avg(case when kind in ({sql.quoted(quality.ANSWERED)}) and len(ed) > 0 then coalesce(list_has_any(docs, ed), false)::int end), 0) as recall,
  coalesce(min(top) filter (kind in ({sql.quoted(quality.ANSWERED)})), 0) as la, coalesce(max(top) filter (kind in ({sql.quoted(quality.BLOCKED)})), 0) as gb,
  coalesce(min(cos) filter (kind in ({sql.quoted(quality.ANSWERED)})), 0) as cla, coalesce(max(cos) filter (kind in ({sql.quoted(quality.BLOCKED)})), 0) as cgb from it group by alpha),
ka as (select *, round(la - gb, 4) as gap, round(cla - cgb, 4) as cgap from ja)
select alpha, round(recall, 6) as recall, la as least_answerable, gb as greatest_blocked, gap, round(case when gap > 0 then (la + gb) / 2 else gb + 0.01 end, 3) as threshold,
  cla as cos_least_answerable, cgb as cos_greatest_blocked, cgap as cos_gap, round(case when cgap > 0 then (cla + cgb) / 2 else cgb + 0.01 end, 3) as cos_threshold,
  row_number() over (order by round(recall, 3) desc, gap desc, alpha) = 1 as best from ka""",
    "o135_lint": f"""with k as (select *, coalesce(nullif(effective_from, ''), published_at) as starts, coalesce(doc_type, '안내문') as kind, coalesce(authority_level, '안내문') as auth, coalesce(body, '') as b from knowledge_docs), p as ({_REQUIRED.replace('chr(0)[1:0]', "''")}
union all select doc_id, version, 'bad doc_id' from k where not coalesce(regexp_matches(doc_id, '^[A-Z]{{2,4}}-\\d{{3}}$'), false)
union all select doc_id, version, 'bad version' from k where not coalesce(regexp_matches(version, '^\\d+\\.\\d+$'), false)
union all select doc_id, version, 'bad sensitivity' from k where not coalesce(sensitivity in ('public', 'internal', 'restricted'), false)
union all select doc_id, version, 'bad status' from k where not coalesce(status in ('draft', 'review', 'published', 'expired'), false)
union all select doc_id, version, 'bad published_at' from k where published_at <> '' and not regexp_matches(published_at, '{_DAY}')
union all select doc_id, version, 'bad valid_until' from k where valid_until <> '' and not regexp_matches(valid_until, '{_DAY}')
union all select doc_id, version, 'bad effective_from' from k where starts <> '' and not regexp_matches(starts, '{_DAY}')
union all select doc_id, version, 'dates out of order' from k where regexp_matches(published_at, '{_DAY}') and regexp_matches(valid_until, '{_DAY}') and valid_until <= published_at
union all select doc_id, version, 'never in force' from k where regexp_matches(starts, '{_DAY}') and regexp_matches(valid_until, '{_DAY}') and starts > valid_until
union all select doc_id, version, 'bad doc_type' from k where kind not in ('안내문', '규정')
union all select doc_id, version, 'bad authority_level' from k where auth not in ('안내문', '부서지침', '사규', '취업규칙')
union all select doc_id, version, 'regulation without authority' from k where kind = '규정' and auth = '안내문'
union all select doc_id, version, 'regulation without effective_from' from k where kind = '규정' and coalesce(effective_from, '') = ''
union all select doc_id, version, 'articles without clauses' from k where kind = '규정' and regexp_matches(b, '제\\s*\\d+\\s*조') and not regexp_matches(b, '[①-⑳]')
union all select doc_id, version, 'no demo notice' from k where demo_assumption and not contains(substr(b, 1, 1500), '데모용 가정')
union all select doc_id, version, 'no section heading' from k where not regexp_matches(b, '(?m)^#{{2,4}}\\s+')
union all select doc_id, version, 'no FAQ section' from k where not contains(b, '자주 묻는 질문')
union all select doc_id, version, 'file name without doc_id' from k where not starts_with(string_split(source_path, '/')[-1], doc_id)
union all select doc_id, version, 'delivered more than once' from k group by all having count(*) > 1)
select distinct doc_id, version, problem from p""",
    "o136_metadata_changes": """with l as (select * from (select *, row_number() over (partition by doc_id, snapshot_date order by coalesce(loaded_at, timestamp '1970-01-01') desc, version desc nulls last, status desc nulls last, owner_dept desc nulls last, valid_until desc nulls last) as k from doc_registry where doc_id is not null and snapshot_date is not null) where k = 1),
o as (select *, lag(version) over w as v, lag(status) over w as s, lag(owner_dept) over w as d, lag(valid_until) over w as u, lag(snapshot_date) over w is null as new, (select min(snapshot_date) from l) as first from l window w as (partition by doc_id order by snapshot_date)),
c as (select * from o where not new or snapshot_date > first),
x as (select doc_id, snapshot_date, 'version' as attribute, v as before, version as after from c union all select doc_id, snapshot_date, 'status', s, status from c union all select doc_id, snapshot_date, 'owner_dept', d, owner_dept from c union all select doc_id, snapshot_date, 'valid_until', u, valid_until from c)
select * from x where before is distinct from after""",
}
_UNSAFE = lambda c: "coalesce(" + " or ".join(answering._rx(c, p) for p in text.BLOCK.values()) + f" or ({answering._rx(c, text.HEALTH)} and not {answering._rx(c, text.INSTITUTION)}), false)"
_SAVED = f"""r as (select employee_no, kind, save_id::varchar as item_id, requested_at as asked, case when json_valid(payload) then payload::json else '{{}}'::json end as p from save_requests where employee_no is not null and kind in ('saved_answers', 'checklist') and payload is not null),
safe as (select * from r where case when kind = 'checklist' then not {_UNSAFE("(p->>'text')")} else not ({_UNSAFE("(p->>'query')")} or {_UNSAFE("(p->>'summary')")}) end),
it as (select distinct on (employee_no, kind, item_id) * from safe order by employee_no, kind, item_id, asked),
{answering._LATEST_DOCS},
vk as (select *, case when list_has_any(list_transform(string_split(version, '.'), lambda x: try_cast(x as int) is null), [true]) then [0] else list_transform(string_split(version, '.'), lambda x: try_cast(x as int)) end as vk from kd),
cur as (select distinct on (doc_id) doc_id, version as now from vk order by doc_id, vk desc),
ci as (select employee_no, kind, item_id, c->>'doc_id' as doc_id, c->>'version' as version from (select *, unnest(((p->'citations')::json[])[1:5]) as c from it) union all select employee_no, kind, item_id, p->>'doc_id', nullif(p->>'doc_version', '') from it),
st as (select employee_no, kind, item_id, array_to_string(list_sort(list(distinct doc_id || ' v' || now)), ', ') as stale from ci join cur using (doc_id) where version <> now group by all),
items as (select it.employee_no, it.kind, it.item_id, least(coalesce(json_array_length(p->'actions'), 0), 10) as actions, least(coalesce(json_array_length(p->'citations'), 0), 5) as citations, false as done, true as is_new, coalesce(stale, '') as stale
  from it left join st on st.employee_no = it.employee_no and st.kind = it.kind and st.item_id = it.item_id)"""
SQL["o124_saved_items"] = f"with {_SAVED} select * from items"
SQL["o129_saved_counts"] = f"with {_SAVED} select employee_no, kind, count(*) filter (not done) as open, count(*) as items, count(*) filter (done) as done, count(*) filter (is_new) as new from items group by all"
# Greedy with a limit of two: a request is refused if the accepted one before the last lies within the period.
SQL["o118_rate_limit"] = f"""with recursive {_TURNS}, e as (select *, row_number() over (partition by employee_no order by sent_at, request_id) as n from t where employee_no is not null and sent_at is not null),
g as (select employee_no, request_id, n, true as accepted, null::timestamp as a, sent_at as b from e where n = 1
  union all select e.employee_no, e.request_id, e.n, coalesce(epoch(e.sent_at) - epoch(g.a) > 600, true), case when coalesce(epoch(e.sent_at) - epoch(g.a) > 600, true) then g.b else g.a end, case when coalesce(epoch(e.sent_at) - epoch(g.a) > 600, true) then e.sent_at else g.b end
  from g join e on e.employee_no = g.employee_no and e.n = g.n + 1)
select request_id, accepted from g union all select request_id, true from t where employee_no is null and sent_at is not null"""
SQL["o132_metrics"] = f"""with {sql.search_ctes(search.TODAY)}, gt as ({search.SQL['o75_gate']}),
dc as (select id, list(doc_id) as docs from sel group by id),
ga as (select id, any_value(query_type) as query_type, any_value(expected_docs) as ed, any_value(expected_behavior) as eb from golden_set where id is not null group by id),
ja as (select ga.*, docs, coalesce(sufficient, false) as sufficient from ga left join dc using (id) left join gt using (id))
select query_type, count(*) as items, round(avg(case when len(ed) > 0 then coalesce(list_has_any(docs, ed), false)::int end), 6) as recall,
  round(avg(case when eb = 'block' then (not sufficient)::int end), 6) as blocked, round(avg(case when eb <> 'block' then (not sufficient)::int end), 6) as false_blocked from ja group by query_type"""
