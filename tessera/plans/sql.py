"""Building blocks of the DuckDB checks: the tokeniser and the search as SQL text."""

from __future__ import annotations

import unicodedata

from tessera.functions.korean import ENDINGS, INTERROGATIVES, PARTICLES, PREDICATE_ENDS, STOPWORDS

#: Characters that NFKC turns into one other: full and half width, compatibility jamo, circled digits, blanks.
_SINGLE = {chr(c): n for r in ((0xFF01, 0xFF9E), (0x3131, 0x318F), (0x2460, 0x2469), (0xA0, 0xA1), (0x3000, 0x3001)) for c in range(*r) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)}
_WIDE, _PLAIN = "".join(_SINGLE), "".join(_SINGLE.values()).replace("'", "''")
#: Those it turns into several.
_SEVERAL = {c: unicodedata.normalize("NFKC", c) for c in ["…", "㈜", *map(chr, range(0x2469, 0x2474))]}


def quoted(items: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in items)


def normal(c: str) -> str:
    """DuckDB has no NFKC; composition and full-width forms are what the tables hold."""
    inner = f"translate({c}, '{_WIDE}', '{_PLAIN}')"
    for k, v in _SEVERAL.items():
        inner = f"replace({inner}, '{k}', '{v}')"
    return f"trim(regexp_replace(lower(nfc_normalize({inner})), '\\s+', ' ', 'g'))"


def words(n: str) -> str:
    return f"list_filter(string_split_regex({n}, '[^0-9a-z가-힣]+'), lambda w: w <> '')"


def stem(w: str) -> str:
    return f"regexp_replace(regexp_replace({w}, '^(.{{2,}}?)(?:{'|'.join(ENDINGS)})$', '\\1'), '^(.{{2,}}?)(?:{'|'.join(PARTICLES)})$', '\\1')"


def tokens(n: str) -> str:
    stop = quoted(STOPWORDS)
    return (
        f"flatten(list_transform(list_filter({words(n)}, lambda w: length(w) >= 2), lambda w: list_concat("
        f"case when w in ({stop}) then [] else [w] end, "
        f"case when {stem('w')} <> w and {stem('w')} not in ({stop}) then [{stem('w')}] else [] end, "
        f"list_transform(range(1, length(w)), lambda i: '__' || substr(w, i, 2)))))"
    )


def content_terms(n: str) -> str:
    """With repeats: callers that need the first of each keep the least position."""
    return f"list_filter(list_transform({words(n)}, lambda w: {stem('w')}), lambda s: length(s) >= 2 and s not in ({quoted(STOPWORDS)}))"


def predicate(s: str) -> str:
    return f"right({s}, 1) in ({quoted(list(PREDICATE_ENDS))})"


INTERROGATIVE_LIST = quoted(INTERROGATIVES)

CHUNKS = "ch as (select distinct on (chunk_id) * from chunks where chunk_id is not null order by chunk_id, indexed_at desc nulls last, chunk_ord)"
BODY = normal("coalesce(section_path, '') || chr(10) || coalesce(text, '')")
PATH = normal("coalesce(section_path, '')")


def index_ctes() -> str:
    return f"""{CHUNKS},
toks as materialized (select chunk_ord, {tokens(BODY)} as t, {tokens(PATH)} as p from ch),
occ as (select chunk_ord, len(t) as length, unnest(t) as term, 1 as a, 1 as b from toks union all select chunk_ord, len(t), unnest(p), 0, 3 from toks),
tfs as materialized (select chunk_ord, term, sum(a) as tf, sum(b) as wtf, max(length) as length from occ group by all),
cs as (select count(*) as n, sum(len(t)) / count(*) as mean from toks),
ts as materialized (select term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf_bm25, ln((1 + n) / (1 + df)) + 1 as idf_tfidf from (select term, count(*) as df from tfs group by term), cs)"""


def search_ctes(today: str, asks: str | None = None) -> str:
    """The search of the golden questions, or of what ``asks`` selects (id, employee_no, qtext)."""
    asks = asks or f"select id, min(user_id) as employee_no, min({normal('query')}) as qtext from golden_set where id is not null and query is not null and trim(query) <> '' group by id"
    return f"""{index_ctes()},
nrm as (select chunk_ord, sqrt(sum((wtf * idf_tfidf) ** 2)) as norm from tfs join ts using (term) group by chunk_ord),
post as materialized (select term, chunk_ord, idf_bm25 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) as w1, wtf * idf_tfidf / norm as w2 from tfs join ts using (term) join nrm using (chunk_ord), cs),
asks as materialized ({asks}),
qd as (select distinct qtext from asks),
qt0 as (select qtext, term, count(*) as qtf from (select qtext, unnest({tokens('qtext')}) as term from qd) group by all),
qt1 as (select qtext, term, qtf, qtf * idf_tfidf as w from qt0 join ts using (term)),
qt as (select qtext, term, qtf, w / sqrt(sum(w * w) over (partition by qtext)) as qw from qt1),
sc as (select qtext, chunk_ord, sum(qtf * w1) as bm25, sum(qw * w2) as cosine from qt join post using (term) group by all),
pairs as (select qtext, chunk_ord, round(sum(bm25), 10) as bm25, round(sum(cosine), 10) as cosine from (
  select * from sc union all select qtext, chunk_ord, 0.0, 0.0 from qd, (select chunk_ord from ch order by chunk_ord limit 30)) group by all),
cand as materialized (select * from (select *, row_number() over (partition by qtext order by bm25 desc, chunk_ord) as by_bm25, row_number() over (partition by qtext order by cosine desc, chunk_ord) as by_cosine from pairs) where by_bm25 <= 30 or by_cosine <= 30),
pool as materialized (select a.id, a.employee_no, a.qtext, c.chunk_ord, h.chunk_id, h.doc_id, c.bm25, c.cosine, case
  when not list_has_any(coalesce(h.acl_groups, []), coalesce(u.acl_groups, [])) then 'deny_acl'
  when not coalesce(list_contains(h.audience, 'all') or list_contains(h.audience, u.employment_type), false) then 'deny_audience'
  when h.valid_until < '{today}' then 'deny_expired'
  when coalesce(nullif(h.effective_from, ''), h.published_at) > '{today}' then 'deny_not_effective'
  when h.sensitivity = 'restricted' and u.role is distinct from 'hr_admin' then 'deny_sensitivity' else 'allow' end as decision
  from asks a join user_profiles u using (employee_no) join cand c using (qtext) join ch h using (chunk_ord)),
ok as (select *, min(bm25) over w as lo, max(bm25) over w as hi from pool where decision = 'allow' window w as (partition by id)),
nr as (select *, case when hi - lo < 1e-12 then case when hi <= 0 then 0.0 else 1.0 end else (bm25 - lo) / (hi - lo) end as bm25_norm from ok),
hy as (select *, round(0.4 * bm25_norm + 0.6 * greatest(cosine, 0.0), 9) as hybrid from nr),
pl as (select *, row_number() over (partition by id order by hybrid desc, chunk_ord) as place from hy),
nearby as (select * from (select *, doc_id = first_value(doc_id) over w or hybrid >= first_value(hybrid) over w * 0.62 as near from pl window w as (partition by id order by place)) where near),
capped as (select * from (select *, row_number() over (partition by id, doc_id order by place) as of_doc from nearby) where of_doc <= 3),
sel as materialized (select * from (select *, row_number() over (partition by id order by place) as rank from capped) where rank <= 5)"""


def unknown_ctes() -> str:
    return f"""subj as (select qtext, pos, subject from (select qtext, unnest(s) as subject, generate_subscripts(s, 1) as pos from (select qtext, {content_terms('qtext')} as s from qd)) where length(subject) >= 3 and not {predicate('subject')}),
subj1 as (select qtext, subject, min(pos) as pos from subj group by all),
gram as (select qtext, subject, pos, unnest(list_transform(range(1, length(subject)), lambda i: '__' || substr(subject, i, 2))) as term from subj1),
unk as (select qtext, list(subject order by pos) as unknown from (select qtext, subject, pos from gram left join ts using (term) group by all having count(df) = 0) group by qtext)"""
