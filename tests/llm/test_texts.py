"""Problems 2, 4, 7, 9 and 10."""

import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import abuse, catalog, markup, packing, pii, sentences


def cut(text):
    return [text[a:b] for a, b in sentences.units(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mr. Kim pays 3.5 units. He leaves at 9 a.m. sharp! Why?", ["Mr. Kim pays 3.5 units.", "He leaves at 9 a.m. sharp!", "Why?"]),
        ('She wrote, "Bring it. Now." Then she left.', ['She wrote, "Bring it. Now."', "Then she left."]),
        ("The page says “Closed. Come back.” before you go on. Next one.", ["The page says “Closed. Come back.” before you go on.", "Next one."]),
        ("“끝났습니다. 다시 오세요.”라는 문구가 보입니다. 2026. 9. 10.부터 바뀝니다.다음 문장입니다", ["“끝났습니다. 다시 오세요.”라는 문구가 보입니다.", "2026. 9. 10.부터 바뀝니다.", "다음 문장입니다"]),
        ("「終わりました。また明日。」と出ます。次です！", ["「終わりました。また明日。」と出ます。", "次です！"]),
        ("看到“结束。请再来。”时请联系我。谢谢！", ["看到“结束。请再来。”时请联系我。", "谢谢！"]),
        ("Am 3. März kommt Fr. Dr. Braun, z. B. mittags. Danke.", ["Am 3. März kommt Fr. Dr. Braun, z. B. mittags.", "Danke."]),
        ("यह पहला है। यह दूसरा है।", ["यह पहला है।", "यह दूसरा है।"]),
        ("ห้ามส่งซ้ำ ใช้ได้ทุกวัน", ["ห้ามส่งซ้ำ", "ใช้ได้ทุกวัน"]),
        ("# Title. One ##\n\nFirst line\ngoes on. Next\n\n- [ ] item one\n- item two. Really\n\n| a | b |\n\n```\ncode. here.\n```\n\n$$x. y$$", ["Title. One", "First line\ngoes on.", "Next", "item one", "item two.", "Really"]),
        ("<h1>Head</h1><p>See <a href='x.y?z'>this</a>. <b>Bold one.</b> End<br>of it.</p><ul><li>One<li>Two</ul>", ["Head", "See <a href='x.y?z'>this</a>.", "<b>Bold one.</b>", "End<br>of it.", "One", "Two"]),
        ("(Nobody may.) Then all.\n\n① 하나입니다. 둘입니다.\n② 셋", ["(Nobody may.)", "Then all.", "하나입니다.", "둘입니다.", "셋"]),
        ("An unclosed “quote goes. On here.", ["An unclosed “quote goes.", "On here."]),
    ],
)
def test_sentence_units(text, want):
    assert cut(text) == want


def test_units_of_dirty_texts():
    assert sentences.units(None) == sentences.units("") == sentences.units(" \n ") == []
    long = "Sentence here. " * 20000
    assert len(sentences.units(long)) == 20000
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(list("ab가。.!?\"“”()[]<>`*_#-|$\\{}\n  1①")) for _ in range(80))
        u = sentences.units(t)
        assert all(0 <= a < b <= len(t) for a, b in u) and all(x[1] <= y[0] for x, y in zip(u, u[1:]))
        markup.elements(t), markup.clean(t)


@pytest.mark.parametrize(
    "text, want",
    [
        ("# A *b* ##\n\nSub\n---\n\n* one [x](http://y)\n+ two `c`\n1. three\n\nIt costs $5 or $6, 2*3*4.\n\n~~~\nx &amp; y\n~~~\nin $a+b$ line\n\n$$c$$", {("heading", "A b"), ("heading", "Sub"), ("list_item", "one x"), ("list_item", "two c"), ("list_item", "three"), ("code", "x &amp; y"), ("formula", "a+b"), ("formula", "c")}),
        ("<H2 id='a'>R&amp;D</H2><ol><li>One<LI class=x>T<b>w</b>o</li></ol><pre><code>a &gt; b\n c</code></pre><p>\\[x\\]</p><table><tr><td>no</td></tr></table>", {("heading", "R&D"), ("list_item", "One"), ("list_item", "Two"), ("code", "a > b c"), ("formula", "x")}),
        ("== Head ==\n\n* '''b''' [[P|word]]\n** [[deep]]\n\n:<math>x^2</math>\n\n<syntaxhighlight lang=\"sh\">\n# c\n</syntaxhighlight>\n{| \n| no\n|}", {("heading", "Head"), ("list_item", "b word"), ("list_item", "deep"), ("formula", "x^2"), ("code", "# c")}),
        ("\\section*{R\\&D \\emph{now}}\n\\begin{itemize}\n  \\item 5\\% \\href{u}{of} it\n\\end{itemize}\n\\begin{verbatim}\nx\n\\end{verbatim}\n\\[\ny\n\\]\nand \\(z\\).", {("heading", "R&D now"), ("list_item", "5% of it"), ("code", "x"), ("formula", "y"), ("formula", "z")}),
        ("Plain heading\n\nText 2026. 1. 2. here - no list\nC:\\work\\form", set()),
    ],
)
def test_markup_elements(text, want):
    assert set(markup.elements(text)) == want


def test_link_lists_are_residue():
    nav = "".join(f'<li><a href="/{i}">Menu number {i}</a></li>' for i in range(6))
    body = "The report of the year is long and it is about the work of the people in the house, as it was said before."
    text = f"<ul>{nav}</ul><p>{body}</p><h2>Head</h2><p>{body}</p>"
    assert set(markup.elements(text)) == {("heading", "Head")}
    assert markup.clean(text) == f"{body}\n## Head\n{body}" and markup.clean(None) is None and markup.clean("") == ""


def test_boilerplate_is_decided_in_two_passes():
    body = "The report of the year is long and it is about the work of the people in the house, as it was said before."
    wall = "Laptop Drucker Monitor Tastatur Maus Kabel Adapter Dock Beamer Leinwand Whiteboard Stifte Papier Toner Ordner Locher Hefter Klammern"
    nav = "".join(f'<li><a href="/{i}">Menu number {i}</a></li>' for i in range(4))
    page = f"<nav><ul>{nav}<li>Login</li></ul></nav><h1>Title</h1><p>{body}</p><ul><li>kept item</li></ul><p>{body}</p><footer><p>{wall}</p><ul><li>Imprint</li><li><a href='/p'>Privacy statement</a></li></ul></footer>"
    # Links in the frame and the wall of labels are decided by the first pass, Login and Imprint by their neighbours.
    assert set(markup.elements(page)) == {("heading", "Title"), ("list_item", "kept item")}
    related = f"# Head\n\n{body}\n\n## Related documents\n\n- [one](a)\n- [two words](b)\n- [three](c)\n"
    assert set(markup.elements(related)) == {("heading", "Head"), ("heading", "Related documents"), ("list_item", "one"), ("list_item", "two words"), ("list_item", "three")}
    labels = f"{wall}\n\n# Lost\n\n- lost\n\n{wall}\n\n# Kept\n\n{body}"
    assert set(markup.elements(labels)) == {("heading", "Kept")}


def test_pii_found():
    text = "제 이름은 김하늘입니다. 담당자 박 솔님께, 메일 a.b+c@mail.example.com, c (at) d.example, +82 10-1234-5678, (02) 123-4567, 010 1234 5678, 주민번호는 900101-2345678, 집은 가온시 한빛구 솔내로 71번길 11, 105동 2호 입니다. 접수번호 2026-07-195, 오류 코드 424-252-79, 2026-01-02, 인사팀 대리님께. 김하늘에게."
    assert set(pii.entities(text)) == {("name", "김하늘"), ("name", "박 솔"), ("email", "a.b+c@mail.example.com"), ("email", "c (at) d.example"), ("phone", "+82 10-1234-5678"), ("phone", "(02) 123-4567"), ("phone", "010 1234 5678"), ("id_number", "900101-2345678"), ("address", "가온시 한빛구 솔내로 71번길 11, 105동 2호")}
    assert set(pii.entities("My name is Ann B. Lee. Ship it to 12 Oak Street, Flat 3, Velkton please. Use 666-12-3456.")) == {("name", "Ann B. Lee"), ("address", "12 Oak Street, Flat 3, Velkton"), ("id_number", "666-12-3456")}
    assert pii.entities(None) == pii.entities("") == [] and pii.entities('{"q": "\\uba54\\uc77c a@b.example"}', True) == [("email", "a@b.example")] and pii.entities('{"q": broken a@b.example', True) == [("email", "a@b.example")]


def test_surrogates_are_distinct_consistent_and_alike(spark):
    names = [f"{s}{a}{b}" for s in "김이박최정" for a in "가나다라마바사아" for b in "자차카타파하거너"]
    rows = [("f", i, f"어제 {n} 님과 통화했어요. 연락처는 010-{i:04d}-5678 입니다. {n}씨가 승인") for i, n in enumerate(names)] + [("f", 9001, None), ("f", 9002, ""), ("f", 9003, "없음")]
    df = spark.createDataFrame(rows, "field string, rec_id long, text string")
    got = {r.rec_id: r.text for r in pii.masked(df, b"k").collect()}
    assert got[9001] is None and got[9002] == "" and got[9003] == "없음"
    drawn = [re.findall(r"\[name: (.+?)\]", got[i]) for i in range(len(names))]
    assert all(len(d) == 2 and d[0] == d[1] for d in drawn)
    assert len({d[0] for d in drawn}) == len(names) and not {d[0] for d in drawn} & set(names)
    phones = [re.search(r"\[phone: (010-\d{4}-\d{4})\]", got[i])[1] for i in range(len(names))]
    assert len(set(phones)) == len(names)
    assert pii.surrogate("id_number", "900101-2345678", b"k")[7] == "2" and re.fullmatch(r"[A-Z][a-z]{3} [A-Z]\. [A-Z][a-z]{2}", pii.surrogate("name", "Anna B. Lee", b"k"))


def test_surrogates_by_script():
    for i in range(40):
        key = str(i).encode()
        for name, letters in (("สมชาย ใจดี", r"[ก-๎]+ [ก-๎]+"), ("राम शर्मा", r"[ऀ-ॿ]+ [ऀ-ॿ]+"), ("佐藤 さくら", r"[一-鿿]{2} [ぁ-ん]{3}"), ("田中花子", rf"[一-鿿]{{3}}[{pii.SHOWN['f']}]"), ("Анна", r"[А-я]{4}"), ("Maria Long", r"[A-Z][a-z]+a [A-Z][a-z]+"), ("김은희", r"[가-힣]{3}")):
            made = pii.surrogate("name", name, key)
            assert re.fullmatch(letters, made) and made != name, (name, made)
        for address, gone in (("北京市朝阳区建国路88号2栋", ("北京", "朝阳", "建国", "88")), ("東京都港区芝公園4-2-8", ("東京", "芝公園")), ("12 Oak Street, Flat 3, Velkton", ("Oak", "Velkton", "12"))):
            made = pii.surrogate("address", address, key)
            assert not any(x in made for x in gone if len(x) > 2 or not x.isdigit()), made
        assert re.fullmatch(r".{2}市.{2}区.{2}路\d\d号\d栋", pii.surrogate("address", "北京市朝阳区建国路88号2栋", key)) and " Street, Flat " in pii.surrogate("address", "12 Oak Street, Flat 3, Velkton", key)
        made = pii.surrogate("id_number", "900101-2345678", key)
        assert 1 <= int(made[2:4]) <= 12 and 1 <= int(made[4:6]) <= 28 and made[7] == "2"
        made = pii.surrogate("id_number", "110101199003071233", key)
        assert 1950 <= int(made[6:10]) < 2005 and 1 <= int(made[10:12]) <= 12 and int(made[16]) % 2 == 1


def test_surrogates_of_two_tables_come_from_one_vault(spark, tmp_path):
    names = [f"{s}{a}{b}" for s in "김이박최정" for a in "가나다라마바사아" for b in "자차카타파하거너희숙미은영연"]
    spark.createDataFrame([(str(i), f"어제 {n} 님과 통화했어요.") for i, n in enumerate(names[:400])], "request_id string, message string").selectExpr("*", "timestamp'2026-01-01' as received_at").write.parquet(str(tmp_path / "chat_requests.parquet"))
    spark.createDataFrame([(str(i), json.dumps({"q": f"어제 {n} 님과 통화했어요."})) for i, n in enumerate(names[200:])], "save_id string, payload string").selectExpr("*", "timestamp'2026-01-01' as received_at").write.parquet(str(tmp_path / "save_requests.parquet"))
    got = {(r.field, int(r.rec_id)): re.search(r"\[name: (.+?)\]", r.text)[1] for r in catalog.p7_masked(spark, str(tmp_path)).collect()}
    chat = {n: got["chat_requests.message", i] for i, n in enumerate(names[:400])}
    save = {n: got["save_requests.payload", i] for i, n in enumerate(names[200:])}
    assert all(chat[n] == save[n] for n in names[200:400])
    assert tuple(catalog.p7_surrogates(spark, str(tmp_path)).first()) == (0, 0, 0, 0)
    both = chat | save
    assert len(set(both.values())) == len(names) and not set(both.values()) & set(names)


def placed(sizes, capacity):
    plan = packing.Plan(Counter(sizes), capacity)
    bins, seen = Counter(), Counter()
    for size, low, high, base, each in plan.intervals:
        for i in range(low, high):
            bins[base + (i - low) // each] += size
        seen[size] += high - low
    assert seen == Counter(sizes) and max(bins.values(), default=0) <= capacity and (not bins or max(bins) < plan.bins)
    return plan


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_packing_plans():
    rng = random.Random(8)
    fixed = 0
    for k in range(150):
        cap = rng.choice([10, 30, 100])
        low = cap // 4 if k % 2 else 1
        sizes = [rng.randrange(low, cap + 1) for _ in range(rng.randrange(0, 80))]
        plan = placed(sizes, cap)
        fixed += plan.fixed
        assert plan.bins <= best_fit(sizes, cap) + 1 and plan.bins >= -(-sum(sizes) // cap)
    assert fixed > 100
    assert placed([6, 4, 6, 4, 10], 10).bins == 3 and placed([0, 0], 10).bins == 1 and placed([], 10).bins == 0


def test_packing_work_does_not_grow_with_items():
    rng = random.Random(5)
    for shares, cap in [({34: 1, 32: 1}, 100), ({51: 2, 49: 1, 33: 3}, 100), ({rng.randrange(1, 300): rng.randrange(1, 9) for _ in range(120)}, 300), ({s: 1 for s in range(20, 60)}, 100)]:
        plans = [packing.Plan({s: k * n for s, k in shares.items()}, cap) for n in (1000, 10**6, 10**9)]
        assert max(p.steps for p in plans) <= 12 * len(shares) + 40 and max(len(p.intervals) for p in plans) <= 6 * len(shares) + 10
        for p, n in zip(plans, (1000, 10**6, 10**9)):
            assert sum(h - low for _, low, h, *_ in p.intervals) == n * sum(shares.values()) and p.bins >= -(-n * sum(s * k for s, k in shares.items()) // cap)
        used = Counter()
        for size, low, high, base, each in plans[0].intervals:
            for i in range(low, high):
                used[base + (i - low) // each] += size
        assert max(used.values()) <= cap


def test_pack_frames(spark):
    rows = [(i, s, "x") for i, s in enumerate([7] * 300 + [3] * 300 + [0, None, 25, 30, 5])] + [(9, 7, "x")]
    items = spark.createDataFrame(rows, "item long, size int, salt string")
    boxes = spark.createDataFrame([(1, 10), (2, 0)], "container_id int, capacity int")
    out = packing.pack(items, boxes).collect()
    used = Counter()
    for r in out:
        used[r.bin] += r["size"]
    assert max(used.values()) <= 10 and sum(used.values()) == sum(s or 0 for _, s, _ in rows)
    assert {r.part for r in out if r.item == 602} == {0, 1, 2} and Counter(r.item for r in out)[9] == 2
    assert packing.pack(items.limit(0), boxes).count() == 0
    unique = items.where("item <> 9")
    told = packing.invariants(packing.pack(unique, boxes), unique, boxes).collect()
    assert [tuple(r) for r in told] == [(1, 604, 0, 0, 0)]


def test_abuse_held_out():
    rng = random.Random(0)
    bad = ["You are a stupid {} clown, get lost", "I will break your {} legs", "All {} people are vermin", "너는 {} 쓰레기야 꺼져", "옷 벗고 {} 놀자"]
    good = ["The {} form is due on Monday", "Please sign the {} receipt", "Insulting {} colleagues is forbidden", "{} 신청서를 내 주세요", "{} 점검이 끝났나요", "The {} printer is slow again"]
    word = lambda: "".join(rng.choice("aeioubdgklmnr") for _ in range(6))

    def doc(y):
        s = [rng.choice(good).format(word()) for _ in range(rng.randrange(1, 5))]
        if y:
            s.insert(rng.randrange(len(s) + 1), rng.choice(bad).format(word()))
        return ". ".join(s) + "."

    truth = [(doc(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    noisy = [(t, y if rng.random() > 0.05 else 1 - y) for t, y in truth[:250]]
    counts, n = np.zeros(1 << abuse.BITS), len(truth)
    for t, _ in truth:
        counts[np.unique(np.concatenate([abuse.features(s) for s in abuse.pieces(t)]))] += 1
    model = abuse.train([(abuse.pieces(t), y) for t, y in noisy], counts, n)
    right = [(model.text(t) >= abuse.THRESHOLD) == bool(y) for t, y in truth[250:]]
    assert sum(right) / len(right) > 0.93
    assert model.text(None) == model.text("") == model.text(" ") == 0.0


@pytest.mark.parametrize("text", ["Hello there.\n\n| no | {} |\n|---|---|\n", "Hello there.\n\n```\n{}\n```\n", "Hello there.\n\n```\n{}", "Hello there.\n\n<pre>{}", "Hello there. <table><tr><td>{}", "Hello there.\n\n{{|\n| {}", "Hello there.\n\n$$\n{}\n$$", "Hello there. <!-- {} -->"])
@pytest.mark.parametrize("insult", ["You are such a moron, get lost", "닥쳐 이 병신 새끼야", "お前は本当に馬鹿だな、消えろ"])
def test_abuse_outside_of_sentences(text, insult):
    text = text.format(insult)
    said = " ".join(abuse.pieces(text))
    assert all(w in said for w in abuse.plain(insult).split())
    assert any(abuse.plain(insult)[:12] in p for p in abuse.pieces(text))


def test_abuse_pieces_hold_every_letter():
    rng = random.Random(2)
    for _ in range(300):
        words = ["".join(rng.sample("abdefghkmnoprstuvz", 6)) for _ in range(10)]
        t = "".join(w + "".join(rng.choice(["$$", "```\n", "<pre>", "<!--", "-->", "| ", "|", "\n", "\n\n", " ", ". ", "# ", "- ", "{|", "1. "]) for _ in range(2)) for w in words)
        held = " ".join(abuse.pieces(t))
        assert all(w in held for w in words), t
    assert abuse.pieces("# Head\n\n- one\n1. two") == ["head", "one", "two"]
    assert any("a$$hole" in p for p in abuse.pieces("you a$$hole and you a$$hole."))


def test_abuse_readings():
    assert "you moron." in abuse.readings("You M0RON.") and "bastard!" in abuse.readings("b a s t a r d!") and "asshole" in abuse.readings("a$$hole")
    assert "connard" in abuse.readings("co@nnard") and "씨발놈" in abuse.readings("씨 0 발 놈") and abuse.readings("plain words") == ["plain words"]


def test_wrong_labels_do_not_clear_a_sentence():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioubdgklmnr") for _ in range(6))
    bad, good = ["get lost you stupid clown", "i will break your legs", "they are all vermin"], ["the form is due on monday", "please sign the receipt", "the printer is slow again"]
    docs = [([rng.choice(good), f"{word()} is closed"] + [rng.choice(bad)] * (i % 5 == 0), int(i % 5 == 0)) for i in range(1500)]
    wrong = [(d, 1 - y) if i % 17 == 0 else (d, y) for i, (d, y) in enumerate(docs)]
    counts = np.zeros(1 << abuse.BITS)
    for d, _ in docs:
        counts[np.unique(np.concatenate([abuse.features(s) for s in d]))] += 1
    model = abuse.train(wrong, counts, len(docs))
    assert all(model.sentence(s) >= abuse.THRESHOLD for s in bad) and all(model.sentence(s) < abuse.THRESHOLD for s in good)


def test_wrong_labels_do_not_flag_a_common_sentence():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioubdgklmnr") for _ in range(6))
    bad, good = ["get lost you stupid clown", "i will break your legs", "they are all vermin"], ["the form is due on monday", "please sign the receipt", "the printer is slow again"]
    common = "trash goes into the bins by floor"

    def doc(insult, has):
        return [rng.choice(good), f"{word()} is closed"] + [common] * has + [rng.choice(bad)] * insult

    # 100 of 20,000 documents hold the sentence; 4 beside an insult and 2 with a wrong label are labelled positive, 4 harmless.
    labelled = [(doc(1, i < 4), 1) for i in range(100)] + [(doc(0, True), 1)] * 2 + [(doc(0, i < 4), 0) for i in range(400)]
    docs = [d for d, _ in labelled] + [doc(0, i < 90) for i in range(19498)]
    counts = np.zeros(1 << abuse.BITS)
    for d in docs:
        counts[np.unique(np.concatenate([abuse.features(s) for s in d]))] += 1
    model = abuse.train(labelled, counts, len(docs))
    assert model.sentence(common) < abuse.THRESHOLD and all(model.sentence(s) >= abuse.THRESHOLD for s in bad)
    assert all(model.sentence(s) < abuse.THRESHOLD for s in [*good, "ok", "0"])


def test_abuse_frames(spark):
    docs = spark.createDataFrame([(1, "너는 쓰레기야 꺼져.", "a"), (2, "신청서를 내 주세요.", None), (3, None, None), (4, "", "a")], "doc_id long, text string, source string")
    review = spark.createDataFrame([(1, " ABUSE "), (1, "abuse"), (1, "none"), (2, "None"), (3, "odd"), (None, "abuse"), (4, None)], "doc_id long, category string")
    assert {tuple(r) for r in abuse.labels(review, "doc_id", "category").collect()} == {(1, 1), (2, 0)}
    parted = abuse.split(docs, ["doc_id", "source"], "text")
    model = abuse.fit(parted, review, "doc_id", "category")
    scored = abuse.score(parted, ["doc_id", "source"], model)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert len(got) == 4 and got[3] == got[4] == 0.0 and got[1] > got[2]
    assert {(r.source, r.documents) for r in abuse.rates(scored, "source").collect()} == {("a", 2), (None, 2)}


def test_queries_run(spark, sf):
    for name in ("p2_found", "p4_found", "p7_found"):
        assert catalog.QUERIES[name](spark, sf).count() > 0
