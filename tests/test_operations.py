"""Sessions, saved items, file sources, streams and scalar functions on small dirty fixtures."""

import json
import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.functions import korean, normal, text
from tessera.operators import access, answers, conflict, faq, quality, retrieval, saved, sessions
from tessera.plans import answering, operations, search
from tessera.sources import files
from tessera.streaming import live

T0 = datetime(2026, 1, 1)


def greedy(rows, limit, period):
    past, out = {}, {}
    for user, event, at in sorted(rows, key=lambda r: (r[2], r[1])):
        q = past.setdefault(user, deque())
        while q and (at - q[0]).total_seconds() > period:
            q.popleft()
        out[event] = len(q) < limit
        if out[event]:
            q.append(at)
    return out


def events(n=400):
    rng = random.Random(3)
    at, rows = T0, []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 2, 5, 30, 60, 61, 200]))
        rows.append(("hot" if rng.random() < 0.5 else f"u{rng.randrange(4)}", i, at))
    return rows


def test_rate_limit_is_greedy(spark):
    rows = events()
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, 9000, T0, "x"), ("u1", 9001, None, "x")], "user string, event long, at timestamp, _x string")
    got = {r.event: r.accepted for r in sessions.rate_limited(df, "user", "event", "at", 3, 60.0).collect()}
    assert got.pop(9000) is True and 9001 not in got
    assert got == greedy(rows, 3, 60)


def test_streaming_rate_limit_and_metrics(spark, tmp_path):
    rows = [r for r in events(60)]
    spark.createDataFrame([(*r, "010-12345678 로 연락" if r[1] % 7 == 0 else "질문") for r in rows], "user string, event long, at timestamp, msg string").coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("user string, event long, at timestamp, msg string").parquet(str(tmp_path / "in"))
    q = live.rate_limited(src, "user", "event", "at", 3, 60.0).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.event: r.accepted for r in spark.table("limited").collect()} == greedy(rows, 3, 60)
    q = live.metrics(src, "at", "user", "msg").writeStream.format("memory").queryName("metrics").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("metrics").agg(F.sum("requests"), F.sum("masked")).first() == (60, sum(r[1] % 7 == 0 for r in rows))
    assert live.query_log(spark.createDataFrame([(T0, "u", None), (T0, "u", "900101-1234567"), (T0, "u", "휴가")], "at timestamp, user string, msg string"), "at", "user", "msg").select("code").collect() == [("E_INPUT_EMPTY",), ("E_SENSITIVE_BLOCKED",), ("OK",)]


def test_rewrite(spark):
    rows = [("s", 1, T0, "육아휴직 신청 기간은 언제까지인가요? 자세히 알려주세요", True), ("s", 2, T0 + timedelta(1), "그럼 연장은?", True), ("s", 3, T0 + timedelta(2), "막힌 질문 그럼", False), ("s", 4, T0 + timedelta(3), "거기는?", True), (None, 5, T0, "그럼?", True), ("s", 6, T0 + timedelta(4), None, False)]
    got = {r.turn_id: r.search_text for r in sessions.rewritten(spark.createDataFrame(rows, "session_id string, turn_id long, at timestamp, message string, ok boolean")).collect()}
    assert got[1] == rows[0][3] and got[2].startswith("육아휴직 신청 기간 그럼") and got[5] == "그럼?" and got[6] is None
    assert got[4].endswith("거기는?") and "연장" in got[4] and "막힌" not in got[4]


def test_saved_items(spark):
    long = {"query": "q", "summary": "s", "actions": [{"text": str(i)} for i in range(12)], "citations": [{"doc_id": "D-1", "version": "1.0"}]}
    reqs = [("u", "saved_answers", json.dumps(long), 1, T0), ("u", "saved_answers", json.dumps(long), 1, T0 + timedelta(1)), ("u", "checklist", json.dumps({"text": "t", "doc_id": "D-1", "doc_version": ""}), 2, T0), ("u", "checklist", json.dumps({"text": "계좌 110-234-567890"}), 3, T0), (None, "checklist", "{}", 4, T0), ("u", "other", "{}", 5, T0), ("u", "checklist", None, 6, T0)]
    ev = saved.additions(spark.createDataFrame(reqs, "employee_no string, kind string, payload string, save_id long, requested_at timestamp"), "employee_no", "kind", "payload", "save_id", "requested_at")
    assert {r.item_id for r in ev.collect()} == {"1", "2"}
    more = spark.createDataFrame([("u", "checklist", "done", "2", T0 + timedelta(2))], "employee_no string, kind string, op string, item_id string, at timestamp")
    state = saved.state(ev.unionByName(more, allowMissingColumns=True))
    seen = spark.createDataFrame([("u", "checklist", T0 + timedelta(9))], "employee_no string, kind string, seen_at timestamp")
    now = spark.createDataFrame([("D-1", "2.0")], "doc_id string, version string")
    rows = {r.item_id: r for r in saved.annotated(state, seen, now).collect()}
    assert len(rows["1"].item.actions) == 10 and rows["1"].stale == ["D-1 v2.0"] and rows["1"].is_new and not rows["2"].is_new and rows["2"].done and rows["2"].stale is None
    assert [tuple(r) for r in saved.counts(saved.annotated(state, seen, now)).orderBy("kind").collect()] == [("u", "checklist", 0, 1, 1, 0), ("u", "saved_answers", 1, 1, 0, 1)]
    gone = spark.createDataFrame([("u", None, "clear", None, T0 + timedelta(5))], "employee_no string, kind string, op string, item_id string, at timestamp")
    assert saved.state(ev.unionByName(gone, allowMissingColumns=True)).count() == 0


GOOD = "---\ndoc_id: HR-001\ntitle: 휴가\nversion: '1.0'\ncategory: c\nsubcategory: s\nowner_dept: 인사팀\napprover: a\nsensitivity: public\naudience: [all]\nacl_groups: all_employees\npublished_at: 2026-01-01\nvalid_until: 2027-01-01\nstatus: published\ndemo_assumption: false\n---\n# 휴가\n본문\n"


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text(GOOD)
    (tmp_path / "b.md").write_text(GOOD.replace("HR-001", "bad").replace("status: published", "status: odd"))
    (tmp_path / "c.md").write_text("no front matter")
    (tmp_path / "d.txt").write_text(GOOD)
    docs, problems = files.markdown(spark, str(tmp_path))
    assert [(r.doc_id, r.published_at, list(r.acl_groups), r.effective_from) for r in docs.collect()] == [("HR-001", "2026-01-01", ["all_employees"], "2026-01-01")]
    assert {"bad doc_id", "bad status"} <= {r.problem for r in problems.where("doc_id = 'bad'").collect()}
    with pytest.raises(ValueError):
        files.markdown(spark, str(tmp_path), "failfast")


def test_json_sources(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"users": {"1": {"employee_no": "1", "role": "employee", "acl_groups": ["a"]}}}))
    (tmp_path / "g.jsonl").write_text('{"id": "G-1", "query": "q"}\n\n')
    assert files.profiles(spark, str(tmp_path / "p.json")).first().acl_groups == ["a"]
    assert files.golden(spark, str(tmp_path / "g.jsonl")).count() == 1


def test_tokens_and_normal_form(spark):
    df = spark.createDataFrame([("휴가를 신청하나요 ＡＢ가",), (None,), ("",), ("각",), ("a" * 50000,)], "t string")
    rows = df.select(korean.normalize(F.col("t")).alias("n")).select("n", korean.tokens(F.col("n")).alias("t"), korean.content_terms(F.col("n")).alias("c")).collect()
    assert rows[0].n == "휴가를 신청하나요 ab가" and rows[0].t[:4] == ["휴가를", "휴가", "__휴가", "__가를"] and "신청" in rows[0].t and rows[0].c == ["휴가", "신청", "ab"]
    assert rows[1].t is None and rows[2].t == [] and rows[3].n == "각" and rows[3].t == [] and len(rows[4].t) == 50000
    assert df.select(normal.nfkc(F.col("t"))).collect()[3][0] == "각"


def test_text_functions(spark):
    r = spark.range(1).select(
        text.sentences(F.lit("가나다라 합니다. 마바사아 자차카타\n| 표 |\n---\n- 항목 하나입니다\n짧다.")).alias("s"),
        text.unverified(F.lit("15일 안에 3만원"), F.array(F.lit("기한은 15 일"))).alias("u"),
        text.strip_markup(F.lit("a<script>x</script><b>c</b><style>")).alias("m"), text.mask_id(F.lit("123456")).alias("i"), text.mask_email(F.lit("hong@example.com")).alias("e"),
        text.scan(F.lit("동료의 검진 결과")).alias("g"), text.scan(F.lit(None).cast("string")).alias("n"), text.display(F.lit("| a | b |")).alias("d"), text.display(F.lit("|---|---|")).alias("d2"),
    ).first()
    assert list(r.s) == ["가나다라 합니다.", "마바사아 자차카타", "항목 하나입니다"] and list(r.u) == ["3만"] and r.m == "a c" and (r.i, r.e) == ("12****", "ho***@example.com")
    assert r.g.action == "third_party" and r.n.action == "allow" and (r.d, r.d2) == ("a · b", "")


def test_search_on_dirty_and_empty_tables(spark):
    cols = "chunk_id string, chunk_ord long, doc_id string, section_path string, text string, acl_groups array<string>, audience array<string>, valid_until string, effective_from string, published_at string, sensitivity string, indexed_at timestamp, tf long"
    rows = [("a#0", 0, "a", "휴가 > 신청", "휴가 신청은 인사팀", ["g"], ["all"], None, None, None, None, T0, 1), ("a#0", 0, "a", "휴가 > 신청", "휴가 신청은 인사팀", ["g"], ["all"], None, None, None, None, T0, 1), ("a#1", 1, "a", None, None, None, None, None, None, None, None, None, 1), ("b#0", 2, "b", "", "", ["h", None], ["all"], "2020-01-01", None, None, None, T0, 1)]
    people = access.users(spark.createDataFrame([("1", "employee", "d", ["g", None], None, "new", None), ("2", None, None, None, None, None, None)], "employee_no string, role string, dept string, acl_groups array<string>, hire_date string, employment_type string, is_transfer boolean"))
    asks = spark.createDataFrame([("q1", "1", "휴가 신청"), ("q2", "2", "휴가"), ("q3", "1", "!!")], "id string, employee_no string, qtext string")
    chunks = retrieval.latest_chunks(spark.createDataFrame(rows, cols))
    index = retrieval.build_index(chunks)
    assert chunks.count() == 3
    pool = retrieval.pools(asks, retrieval.candidates(asks.select("qtext").distinct(), index), chunks, people, "2026-01-01")
    chosen = retrieval.select(retrieval.fuse(pool))
    assert {(r.id, r.chunk_id) for r in chosen.collect()} == {("q1", "a#0"), ("q3", "a#0")}
    gates = {r.id: r for r in retrieval.gate(asks, pool, chosen, retrieval.unknown_subjects(asks.select("qtext").distinct(), index.terms)).collect()}
    assert gates["q1"].sufficient and not gates["q2"].sufficient and gates["q2"].filtered_out == 3 and gates["q2"].acl_blocked
    none = retrieval.build_index(chunks.limit(0))
    assert none.postings.count() == 0 and retrieval.scores(asks, none).count() == 0


def test_faq(spark):
    body = "# 휴가\n내용\n## 자주 묻는 질문\n**휴가는 며칠인가요?**\n연차는 15일입니다.\n\n**둘?**\n없는 답\n## 다음\n**셋?**\n아니다\n"
    docs = spark.createDataFrame([("D-1", body), ("D-2", None)], "doc_id string, body string")
    chunks = spark.createDataFrame([("D-1", 4, "연차는 15일입니다."), ("D-1", 2, "연차는 15일입니다. 더"), ("D-1", 1, None)], "doc_id string, chunk_ord long, text string")
    pairs = faq.pairs(docs, chunks)
    assert [(r.question, r.answer, r.chunk_ord) for r in pairs.collect()] == [("휴가는 며칠인가요?", "연차는 15일입니다.", 2)]
    hit = faq.match(spark.createDataFrame([("휴가는 며칠인가요",), ("급여는?",)], "qtext string"), pairs).collect()
    assert [(r.qtext, r.faq_score) for r in hit] == [("휴가는 며칠인가요", 1.0)]


def test_conflict(spark):
    cols = "id string, rank int, doc_id string, doc_version string, category string, subcategory string, authority_level string, published_at string"
    rows = [("q", 1, "A", "1.9", "c", "s", "안내문", "2025"), ("q", 2, "A", "1.10", "c", "s", "안내문", "2025"), ("q", 3, "B", "1.0", "c", "s", "사규", "2024"), ("r", 1, "A", "x", "c", "s", None, None), ("t", 1, "A", "1.0", "c", "s", "안내문", "2025"), ("t", 2, "B", "1.0", "c", "s", "안내문", "2025")]
    docs = spark.createDataFrame([("Z", "Y@1.0"), ("A", None), ("B", " ")], "doc_id string, supersedes string")
    got = {(r.id, r.rank, bool(r.unresolved)) for r in conflict.resolve(spark.createDataFrame(rows, cols), docs).collect()}
    assert got == {("q", 3, False), ("r", 1, False), ("t", 1, True), ("t", 2, True)}


def test_lint_and_changes_on_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/knowledge_docs.parquet")
    assert quality.lint(docs.limit(0)).count() == 0 and quality.lint(docs).count() > 0
    a = spark.createDataFrame([("1", "x", None), ("2", "y", "k")], "k string, a string, b string")
    b = spark.createDataFrame([("1", "x", "n"), ("3", None, None)], "k string, a string, b string")
    assert {tuple(r) for r in quality.changes(a, b, "k", ["a", "b"]).collect()} == {("1", "b", None, "n"), ("2", "a", "y", None), ("2", "b", "k", None)}


def test_answers_need_evidence_or_a_pair(spark, sf, tmp_path):
    filler = "\n\n".join(f"**{w}는 누구에게 물어보나요?**\n{w} 담당 부서가 {w} 안내문을 보냅니다." for w in "주차장 사물함 회의실 복사기 출입증 우편물 소화기 엘리베이터 정수기 휴게실".split())
    asked = "구내식당 점심은 언제 먹나요?"
    bodies = {"D-900": f"## 자주 묻는 질문\n**{asked}**\n**11시 30분**부터 13시까지입니다.\n\n{filler}\n", "D-901": "## 자주 묻는 질문\n**임원 식당 예약은 누가 하나요?**\n비서실 직원이 합니다.\n", "D-902": "## 출장비\n출장비 정산은 영수증을 제출합니다."}

    def write(name, rows, columns):
        like = spark.read.parquet(f"{sf}/{name}.parquet").limit(0)
        like.unionByName(spark.createDataFrame(rows, columns), allowMissingColumns=True).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))

    write("knowledge_docs", [(d, "1.0", b, "s") for d, b in bodies.items()], "doc_id string, version string, body string, subcategory string")
    write("chunks", [(f"{d}#0", i, d, "1.0", d, f"{d} > 절", b, ["vip"] if d == "D-901" else ["all"], ["all"]) for i, (d, b) in enumerate(bodies.items())], "chunk_id string, chunk_ord long, doc_id string, doc_version string, title string, section_path string, text string, acl_groups array<string>, audience array<string>")
    write("user_profiles", [("1", ["all"])], "employee_no string, acl_groups array<string>")
    questions = [("faq", asked, "answer"), ("secret", "임원 식당 예약은 누가 하나요?", "no_evidence"), ("strange", "출장비 정산 쿠폰제도 영수증", "answer"), ("plain", "출장비 정산 영수증 제출", "block")]
    write("golden_set", [(i, "1", q, b, []) for i, q, b in questions], "id string, user_id string, query string, expected_behavior string, must_contain array<string>")

    gates = {r.id: r for r in search.o75_gate(spark, str(tmp_path)).collect()}
    assert {i for i, r in gates.items() if r.sufficient} == {"faq", "plain"} and gates["faq"].cos_top1 < retrieval.GATE_COSINE and gates["strange"].unknown.startswith("쿠폰")
    told, rows = answering._answers(spark, str(tmp_path))
    got = {r.id: r for r in told.collect()}
    assert got["faq"].summary == "11시 30분부터 13시까지입니다." and [c.excerpt for c in got["faq"].citations] == [f"{asked} 11시 30분부터 13시까지입니다."] and got["faq"].actions == got["faq"].cautions == []
    assert all(got[i].summary == answers.NO_EVIDENCE and not got[i].citations and not got[i].actions for i in ("secret", "strange"))
    assert got["plain"].answered and got["plain"].citations and answers.unsupported(told, rows).count() == 0
    assert {r.id: r.behaviour for r in operations.o131_assertions(spark, str(tmp_path)).collect()} == {"faq": "", "secret": "", "strange": "not answered", "plain": "not blocked"}


def test_the_guard_comes_before_the_search(spark):
    sent = spark.createDataFrame([("a", "1", "휴가 <b>신청</b>은 hong@example.com 어디로"), ("b", "9", "휴가"), ("c", "1", " "), ("d", "1", "휴" * 501), ("e", "1", "주민번호 900101-1234567"), ("f", "1", "동료의 검진 결과"), ("g", "1", "<br>"), ("h", "1", None), ("i", None, "휴가")], "id string, employee_no string, message string")
    known = spark.createDataFrame([("1", "x")], "employee_no string, role string")
    got = {r.id: r for r in search.guarded(sent, known).collect()}
    assert {i: r.refusal for i, r in got.items()} == {"a": None, "b": "E_AUTH", "c": "E_INPUT_INVALID", "d": "E_INPUT_TOO_LONG", "e": "E_SENSITIVE_BLOCKED", "f": "E_SENSITIVE_BLOCKED", "g": "E_INPUT_INVALID", "h": "E_INPUT_INVALID", "i": "E_AUTH"}
    assert got["a"].qtext == "휴가 신청 은 ***@*** 어디로"
    told = {r.id: r for r in answers.refused(search.guarded(sent, known).where("refusal is not null")).collect()}
    assert told["f"].summary == answers.THIRD_PARTY_ANSWER and told["e"].summary == answers.SENSITIVE_ANSWER and not any(r.answered or r.citations for r in told.values())


def test_what_is_shown_is_checked_again(spark):
    chunks = spark.createDataFrame([("x", ["g"], ["all"], None, None, None, None), ("y", ["h"], ["all"], None, None, None, None)], "chunk_id string, acl_groups array<string>, audience array<string>, valid_until string, effective_from string, published_at string, sensitivity string")
    people = access.users(spark.createDataFrame([("1", "employee", "d", ["g"], None, "new", None)], "employee_no string, role string, dept string, acl_groups array<string>, hire_date string, employment_type string, is_transfer boolean"))
    shown = spark.createDataFrame([("q", "1", "x"), ("r", "1", "y"), ("s", "1", "gone"), ("t", "2", "x")], "id string, employee_no string, chunk_id string")
    assert {r.id for r in access.hidden(shown, chunks, people, "2026-01-01").collect()} == {"r", "s", "t"}


def test_lint_rules(spark):
    good = ("HR-001", "1.0", "T", "c", "s", "d", "a", "public", ["all"], ["g"], "2026-01-01", "2027-01-01", "published", False, "규정", "사규", "2026-01-01", "## 절\n제1조 ① 자주 묻는 질문", "docs/HR-001.md")
    cols = "doc_id string, version string, title string, category string, subcategory string, owner_dept string, approver string, sensitivity string, audience array<string>, acl_groups array<string>, published_at string, valid_until string, status string, demo_assumption boolean, doc_type string, authority_level string, effective_from string, body string, source_path string"
    names = [c.split()[0] for c in cols.split(", ")]
    odd = lambda i, **kw: tuple({**dict(zip(names, good)), "doc_id": f"HR-{i:03d}", "source_path": None, **kw}.values())
    rows = [good, odd(2, valid_until="2026-01-01"), odd(3, effective_from="2028-01-01"), odd(4, doc_type="odd"), odd(5, authority_level=None), odd(6, effective_from=None), odd(7, body="## 절\n제1조 자주 묻는 질문"), odd(8, demo_assumption=True), odd(9, body=None), odd(10, source_path="x/other.md"), odd(11, valid_until="soon"), odd(12), odd(12)]
    found = {(r.doc_id, r.problem) for r in quality.lint(spark.createDataFrame(rows, cols)).collect()}
    assert found == {("HR-002", "dates out of order"), ("HR-003", "never in force"), ("HR-004", "bad doc_type"), ("HR-005", "regulation without authority"), ("HR-006", "regulation without effective_from"), ("HR-007", "articles without clauses"), ("HR-008", "no demo notice"), ("HR-009", "no section heading"), ("HR-009", "no FAQ section"), ("HR-010", "file name without doc_id"), ("HR-011", "bad valid_until"), ("HR-012", "delivered more than once")}


def test_pairs_of_two_versions_are_kept_apart(spark):
    pairs = spark.createDataFrame([("D", 0, "휴가는 며칠인가요?", "휴가는 15일", 1), ("D", 0, "급여는 언제 주나요?", "급여는 25일", 2)], "doc_id string, pos int, question string, answer string, chunk_ord long")
    assert [(r.question, r.faq_score) for r in faq.match(spark.createDataFrame([("휴가는 며칠인가요",)], "qtext string"), pairs).collect()] == [("휴가는 며칠인가요?", 1.0)]


def test_a_pair_leads_what_is_selected(spark):
    chosen = spark.createDataFrame([("a", 1, "x#1", "x", 0.3, 1), ("b", 1, "x#1", "x", 0.3, 1)], "id string, chunk_ord long, chunk_id string, doc_id string, hybrid double, rank int")
    gates = spark.createDataFrame([("a", 1, False), ("b", 1, False), ("c", 0, False)], "id string, citable long, sufficient boolean")
    found = spark.createDataFrame([("a", 2, "y#0", "y", True), ("b", 1, "x#1", "x", False)], "id string, chunk_ord long, chunk_id string, doc_id string, absent boolean")
    assert {(r.id, r.rank, r.chunk_id, r.hybrid) for r in faq.lead(chosen, found).collect()} == {("a", 0, "y#0", 0.0), ("a", 1, "x#1", 0.3), ("b", 1, "x#1", 0.3)}
    assert {(r.id, r.citable, r.sufficient) for r in faq.opened(gates, found).collect()} == {("a", 2, True), ("b", 1, True), ("c", 0, False)}


def test_sweep_counts_what_scores_decide(spark):
    cols = "id string, employee_no string, qtext string, chunk_ord long, chunk_id string, doc_id string, bm25 double, cosine double, decision string"
    rows = [(i, "1", q, k, f"{d}#{k}", d, float(b), c, how) for i, q, how, found in (
        ("n1", "n1", "allow", [("A", 9, 0.5), ("B", 1, 0.4)]), ("n2", "n2", "allow", [("B", 5, 0.4), ("A", 1, 0.3)]), ("f1", "f1", "allow", [("C", 2, 0.2)]), ("x1", "odd", "allow", [("C", 9, 0.9)]), ("x2", "odd", "deny_acl", [("C", 9, 0.9)]),
        ("i1", "i1", "allow", [("C", 9, 0.95)]), ("p1", "p1", "allow", [("C", 9, 0.05)])) for k, (d, b, c) in enumerate(found)]
    golden = spark.createDataFrame([("n1", "normal", ["A"]), ("n2", "regulation", ["Z"]), ("f1", "forbidden", []), ("x1", "no_evidence", []), ("x2", "no_evidence", []), ("i1", "injection", []), ("p1", "paraphrase", ["Q"])], "id string, query_type string, expected_docs array<string>").withColumn("expected_behavior", F.when(F.col("query_type").isin("forbidden", "no_evidence", "injection"), "block").otherwise("answer"))
    unknown = spark.createDataFrame([("odd",)], "qtext string")
    got = {r.alpha: r for r in quality.sweep(spark.createDataFrame(rows, cols), golden, unknown, spark.createDataFrame([], "id string, doc_id string")).collect()}
    # The blend with a lone candidate: its term score is normalised to 1.
    want = {a: (0.5, round(a + (1 - a) * 0.4, 4), round(a + (1 - a) * 0.2, 4), 0.4, 0.2) for a in quality.ALPHAS}
    assert {a: (r.recall, r.least_answerable, r.greatest_blocked, r.cos_least_answerable, r.cos_greatest_blocked) for a, r in got.items()} == want
    assert all(r.gap == round(r.least_answerable - r.greatest_blocked, 4) and r.cos_gap == 0.2 and r.cos_threshold == 0.3 for r in got.values()) and [a for a, r in got.items() if r.best] == [0.2]
    led = quality.sweep(spark.createDataFrame(rows, cols), golden, unknown, spark.createDataFrame([("n2", "Z")], "id string, doc_id string")).collect()
    assert all(r.recall == 1.0 for r in led)


def test_metadata_changes_of_all_snapshots(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, f"2025-{m:02}-01", T0 + timedelta(hours=rng.randrange(9)), rng.choice(["1.0", "2.0"]), rng.choice(["a", "b", None]), "o", None) for d in ("A", "B", "C", "D") for m in range(1, 9) for _ in range(rng.choice([0, 1, 1, 2])) if d != "C" or m > 3]
    rows += [("E", "2025-03-01", T0, "1.0", None, None, "x"), ("E", "2025-04-01", None, "9.0", None, None, "x"), ("E", "2025-04-01", T0, "1.0", None, None, "x"), (None, "2025-01-01", T0, "1", "a", "o", None), ("A", None, T0, "1", "a", "o", None), ("A", "2025-01-01", T0, "1.0", "a", "o", None)]
    names = ["version", "status", "owner_dept", "valid_until"]
    spark.createDataFrame(rows, "doc_id string, snapshot_date string, loaded_at timestamp, version string, status string, owner_dept string, valid_until string").write.parquet(str(tmp_path / "doc_registry.parquet"))

    def plain(days):
        kept = {}
        for d, day, at, *values in rows:
            if d and day and (days is None or day in days):
                key = (at or datetime(1970, 1, 1), [v or "" for v in values])
                kept[d, day] = max(kept.get((d, day), (key, values)), (key, values), key=lambda x: x[0])
        before, want = {}, set()
        start = min(day for _, day in kept)
        for (d, day), (_, values) in sorted(kept.items()):
            if d in before or day > start:
                want |= {(d, day, n, b, a) for n, b, a in zip(names, before.get(d, [None] * 4), values) if a != b}
            before[d] = values
        return want

    got = {tuple(r) for r in operations.o136_metadata_changes(spark, str(tmp_path)).collect()}
    assert got == plain(None) and {r[1] for r in got} > {"2025-02-01", "2025-05-01"} and ("E", "2025-03-01", "version", None, "1.0") in got and not any(r[:2] == ("E", "2025-04-01") for r in got)
    days = ["2025-01-01", "2025-06-01"]
    assert {tuple(r) for r in operations.o136_metadata_changes(spark, str(tmp_path), days).collect()} == plain(days)
