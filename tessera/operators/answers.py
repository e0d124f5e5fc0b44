"""Extractive answers: every sentence shown stands in a cited chunk.

Sentences, list items, lines and their token overlap with the question are column expressions; one row
of each question, with its few candidates, then goes through a fold that picks and de-duplicates in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import korean, text

ACTIONS, ACTIONS_PER_CHUNK, CAUTIONS, EXCERPT = 6, 3, 4, 320
CUT = 0.62
FAQ_SECTION = "자주 묻는 질문"
# Notices and what is said without evidence.
NO_EVIDENCE = "확인 가능한 문서 근거가 충분하지 않습니다."
NO_EVIDENCE_CONTACT = "인사팀 홍길동 대리(hr-demo@example.com)에게 확인해 주세요. 본 연락처는 해커톤 데모용 가상 정보입니다."
SENSITIVE_ANSWER = "입력하신 내용에 민감정보로 보이는 값이 포함되어 있어 처리하지 않았습니다. 이 챗봇에는 주민등록번호·계좌번호·비밀번호를 입력하지 마세요. 질문에서 해당 값을 빼고 다시 물어봐 주세요."
THIRD_PARTY_ANSWER = "타인의 개인정보나 건강 정보는 확인해 드릴 수 없습니다. 관련 문의는 인사팀에 확인해 주세요."
REFUSALS = {"E_AUTH": "사용자를 확인할 수 없습니다.", "E_INPUT_INVALID": "질문을 입력해 주세요.", "E_INPUT_TOO_LONG": "질문은 500자 이내로 입력해 주세요.", "E_SENSITIVE_BLOCKED": SENSITIVE_ANSWER}
DEMO_NOTICE = "이 안내는 해커톤 데모용 가정에 기반합니다. 실제 회사 정책이 아닙니다."
CONFLICT_NOTICE = "참고 문서 간 안내가 서로 다릅니다. 정확한 확인이 필요합니다."
STATUTORY_NOTICE = "은(는) 법령이 최소 기준을 정하는 항목입니다. 사내 규정이 법정 기준보다 불리한 부분은 효력이 없으므로, 실제 적용 기준은 인사팀에 확인해 주세요."
APPLICATION_NOTICE = "규정이 개별 사안에 적용되는지는 문서 검색으로 판단하지 않습니다. 위 조문은 참고용이며, 적용 여부는 인사팀의 확인이 필요합니다."

CITATIONS = "array<struct<doc_id:string,version:string,title:string,sections:array<string>,article_refs:array<string>,excerpt:string>>"
SCHEMA = (
    f"id string, summary string, actions array<string>, citations {CITATIONS}, "
    "cautions array<string>, notices array<string>, answered boolean"
)


def prepared(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """One row of each question: its signals and its candidates with everything the fold looks at.

    ``candidates``: id, rank, hybrid, unresolved and the chunk's columns; ``queries``: id, qtext and ``faq``, an array
    of the FAQ pair that answers (its chunk_id, answer and both parts, cleaned), or null.
    """
    q = queries.select("id", "qtext", "faq", F.array_distinct(korean.tokens(F.col("qtext"))).alias("qt"))
    hits = lambda s: korean.overlap(korean.tokens(F.lower(s)), F.col("qt"))
    body = F.coalesce(F.col("text"), F.lit(""))
    sents = F.transform(text.sentences(body), lambda s: F.struct(s.alias("s"), hits(s).alias("hits"), s.rlike(text.QUESTION).alias("question"), s.rlike(text.FORWARD).alias("forward"), s.rlike(text.ACTION).alias("action"), text.is_caution(s).alias("caution")))
    items = F.transform(text.list_items(body), lambda r: F.struct(r["item"].alias("s"), r["ordered"].alias("ordered"), r["item"].rlike(text.ACTION).alias("action"), text.is_caution(r["item"]).alias("caution")))
    lines = F.transform(F.filter(F.transform(F.split(body, "\n"), text.display), lambda x: x != ""), lambda x: F.struct(x.alias("s"), hits(x).alias("hits")))
    path, title = F.col("section_path"), F.col("title")
    row = F.struct(
        "rank", "hybrid", "chunk_id", "doc_id", F.col("doc_version").alias("version"), "title", text.section_name(path, title).alias("section"), text.heading(path, title).alias("heading"),
        hits(text.heading(path, title)).alias("heading_hits"), "article_ref", "demo_assumption", "doc_type", "statutory", "unresolved", sents.alias("sentences"), items.alias("items"), lines.alias("lines"), text.clean(body).alias("clean"),
    )
    qtext = F.col("qtext")
    return candidates.join(q, "id").groupBy("id", "qtext").agg(F.array_sort(F.collect_list(row)).alias("c"), F.first("faq").alias("faq")).select(
        "id", qtext.rlike(text.PROCEDURE).alias("procedural"), qtext.rlike(text.METHOD).alias("method"), qtext.rlike(text.APPLICATION).alias("application"), "c", "faq"
    )


def _excerpt(lines: list, shown: set[str]) -> str:
    """The best line, grown to the right first and then to the left while it fits."""
    kept = [x for x in lines if not any(s and s in x["s"] for s in shown)] or list(lines)
    if not kept:
        return ""
    at = max(range(len(kept)), key=lambda i: (kept[i]["hits"], -i))
    lo, hi, size = at, at + 1, len(kept[at]["s"])
    while size < EXCERPT:
        if hi < len(kept) and size + len(kept[hi]["s"]) <= EXCERPT:
            size, hi = size + len(kept[hi]["s"]), hi + 1
        elif lo > 0 and size + len(kept[lo - 1]["s"]) <= EXCERPT:
            lo -= 1
            size += len(kept[lo]["s"])
        else:
            break
    return "\n".join(x["s"] for x in kept[lo:hi])


def assemble(id_: str, procedural: bool, method: bool, application: bool, candidates: list, faq: list | None = None) -> tuple:
    """Summary, actions, citations, cautions and notices from candidates in rank order. With an FAQ pair its answer is
    the summary, and nothing else of its chunk is told."""
    cands = list(candidates)
    pair = faq[0] if faq is not None and len(faq) else None
    if not procedural and len(cands) > 1:
        floor = CUT * max(c["hybrid"] for c in cands)
        cands = [c for c in cands if c["hybrid"] >= floor] or cands[:1]
    if pair:
        cands = [c for c in cands if c["chunk_id"] == pair["chunk_id"]] or cands
    source = max(cands, key=lambda c: (c["heading_hits"], -c["rank"]))
    told = [s for s in source["sentences"] if not s["question"]]
    told = [s for s in told if not s["forward"]] or told
    best = max(range(len(told)), key=lambda i: (told[i]["hits"], -i)) if told else None
    summary = re.sub(r"^[①-⑳]\s*", "", told[best]["s"]).strip() if told else ""
    if pair:
        summary = pair["answer"]

    shown = {summary} - {""}
    actions: list[str] = []
    for c in (cands if method else [source]) if procedural and not pair else []:
        options = [x["s"] for x in c["items"] if not x["caution"] and (x["ordered"] or x["action"] or c is source)]
        options += [x["s"] for x in c["sentences"] if x["action"] and not x["caution"] and not x["forward"]]
        fresh = [s for s in dict.fromkeys(options) if s not in shown][:ACTIONS_PER_CHUNK]
        shown.update(fresh)
        actions += fresh
    actions = actions[:ACTIONS]

    cited = cands
    if not method and not pair and len(cands) > 1:
        cited = [c for c in cands if c["heading"] != FAQ_SECTION] or cands
    by_doc: dict[str, dict] = {}
    for c in cited:
        piece = pair["both"] if pair and c["chunk_id"] == pair["chunk_id"] else _excerpt(c["lines"], shown)
        entry = by_doc.setdefault(f"{c['doc_id']}@{c['version']}", {"doc_id": c["doc_id"], "version": c["version"], "title": c["title"], "sections": [], "article_refs": [], "excerpt": None})
        if c["section"] not in entry["sections"]:
            entry["excerpt"] = piece if not entry["sections"] else entry["excerpt"] + "\n\n" + piece
            entry["sections"].append(c["section"])
        if c["article_ref"] and c["article_ref"] not in entry["article_refs"]:
            entry["article_refs"].append(c["article_ref"])

    cautions: list[str] = []
    for c in cited if not pair else []:
        if len(cautions) < CAUTIONS:
            cautions += [s for s in dict.fromkeys(x["s"] for x in c["sentences"] if x["caution"]) if s not in cautions]
    everything = "\n".join(e["excerpt"] for e in by_doc.values())
    cautions = [s for s in cautions[:CAUTIONS] if s not in shown and s not in everything]

    notices = [DEMO_NOTICE] * any(c["demo_assumption"] for c in cited) + [CONFLICT_NOTICE] * any(c["unresolved"] for c in cands)
    statutory = list(dict.fromkeys(x for c in cands for x in (c["statutory"] if c["statutory"] is not None else [])))
    if statutory:
        notices.append(" · ".join(statutory) + STATUTORY_NOTICE)
    if application and any(c["doc_type"] == "규정" for c in cands):
        notices.append(APPLICATION_NOTICE)
    return id_, summary, actions, list(by_doc.values()), cautions, notices, True


def build(rows: DataFrame) -> DataFrame:
    """Answers of :func:`prepared` rows; a question without candidates has none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ("id", "summary", "actions", "citations", "cautions", "notices", "answered")]
        for pdf in parts:
            yield pd.DataFrame([assemble(*r) for r in zip(pdf["id"], pdf["procedural"], pdf["method"], pdf["application"], pdf["c"], pdf["faq"])], columns=names)

    return rows.mapInPandas(run, SCHEMA)


def without_evidence(queries: DataFrame) -> DataFrame:
    """What questions ``id`` without enough evidence are told, alike whether nothing fits or nothing may be seen."""
    none = F.array().cast("array<string>")
    return queries.select("id", F.lit(NO_EVIDENCE).alias("summary"), none.alias("actions"), F.array().cast(CITATIONS).alias("citations"), none.alias("cautions"), F.array(F.lit(NO_EVIDENCE_CONTACT)).alias("notices"), F.lit(False).alias("answered"))


def refused(queries: DataFrame) -> DataFrame:
    """What refused questions ``id, refusal, third_party`` are told."""
    none = F.array().cast("array<string>")
    said = F.coalesce(F.when((F.col("refusal") == "E_SENSITIVE_BLOCKED") & F.col("third_party"), THIRD_PARTY_ANSWER), *[F.when(F.col("refusal") == code, words) for code, words in REFUSALS.items()])
    return queries.select("id", said.alias("summary"), none.alias("actions"), F.array().cast(CITATIONS).alias("citations"), none.alias("cautions"), F.array(F.lit(NO_EVIDENCE_CONTACT)).alias("notices"), F.lit(False).alias("answered"))


def unsupported(answers: DataFrame, rows: DataFrame) -> DataFrame:
    """``id, sentence`` of every shown sentence that no candidate of the question contains: must be empty."""
    said = answers.where("answered").select("id", F.explode(F.concat("actions", "cautions", F.array("summary"))).alias("sentence")).where("sentence <> ''")
    corpus = rows.select("id", F.array_join(F.transform("c", lambda c: c["clean"]), " ").alias("corpus"))
    return said.join(corpus, "id").where(~F.col("corpus").contains(F.col("sentence"))).select("id", "sentence")


def rendered(answers: DataFrame) -> DataFrame:
    """``id, text``: the answer as one text, parts in fixed order."""
    parts = F.concat(F.array("summary"), F.col("actions"), F.flatten(F.transform("citations", lambda c: F.array(c["title"], c["excerpt"]))), F.col("cautions"), F.col("notices"))
    return answers.select("id", F.array_join(F.filter(parts, lambda x: x != ""), "\n").alias("text"))
