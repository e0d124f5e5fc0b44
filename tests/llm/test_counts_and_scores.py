"""Problems 1, 3, 6 and 8 against brute force, on small dirty fixtures and the smallest tables."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, catalog, distinctive, ranking, terms
from tessera.session import scratch

T0 = datetime(2026, 1, 1)


def words(t):
    return re.findall("[0-9a-z가-힣]{2,}", unicodedata.normalize("NFKC", t).lower())


def recount(texts):
    occ, rec = Counter(), Counter()
    for (field, _), t in texts.items():
        if t is not None:
            w = words(t)
            occ.update((field, x) for x in w)
            rec.update((field, x) for x in set(w))
    return {k: (occ[k], rec[k]) for k in occ}


def test_increments_equal_recount(spark):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", " ".join(rng.choice(["휴가", "ＡＢ", "가", "a1", "각각", "the end"]) for _ in range(rng.randrange(9)))])
    store = terms.TermCounts(spark, scratch(spark, "t"), buckets=3)
    state: dict = {}
    for g in range(3):
        new = {k: v for k, v in state.items() if rng.random() > 0.2} | {("f", str(i)): text() for i in rng.sample(range(40), 15)} | ({("g", "1"): "휴가 휴가"} if g == 0 else {})
        df = lambda d: spark.createDataFrame([(*k, None if v is None else unicodedata.normalize("NFKC", v).lower()) for k, v in d.items()], "field string, rec string, text string")
        store.apply(terms.difference(df(state), df(new)), g)
        state = new
        got = {(r.field, r.term): (r.occurrences, r.records) for r in store.counts().collect()}
        assert got == recount(state)
    compact = store.compact(9, scratch(spark, "t"))
    assert sorted(map(str, compact.counts().collect())) == sorted(map(str, store.counts().collect()))
    with pytest.raises(Exception):
        store.apply(terms.difference(df({}), df({("f", "x"): "aa"})), 0)


def test_marks_and_deliveries(spark):
    rows = [(str(i), "공통 말", T0) for i in range(12)] + [("0", "공통 말", T0 + timedelta(1)), ("1", "드문 말씀", T0 + timedelta(1)), (None, "없음 없음", T0), ("n", None, T0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "rec string, text string, at timestamp, first string")
    store = terms.TermCounts(spark, scratch(spark, "t"))
    store.apply(terms.changes(terms.deliveries(df, "f", "rec", "text", F.col("at"))), 0)
    assert {(r.term, r.occurrences, r.records, r.mark) for r in store.counts().collect()} == {("공통", 11, 11, "common"), ("드문", 1, 1, "rare"), ("말씀", 1, 1, "rare")}
    empty = terms.TermCounts(spark, scratch(spark, "t"))
    empty.apply(terms.changes(terms.deliveries(df.limit(0), "f", "rec", "text")), 0)
    assert empty.counts().count() == 0


def test_divergence_scores(spark):
    rows = [("a", "제목", "휴가 휴가 휴가 신청", T0), ("a", "제목", "휴가 휴가 휴가 신청", T0 + timedelta(1)), ("b", None, "휴가 급여", T0), ("c", None, None, None), ("d", "", "", T0), (None, "x", "없는 것들", T0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, path string, text string, at timestamp, tf int")
    docs = {"a": words("제목 휴가 휴가 휴가 신청"), "b": ["휴가", "급여"], "c": [], "d": []}
    cf, dfs = Counter(w for d in docs.values() for w in d), Counter(w for d in docs.values() for w in set(d))
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    want = {}
    for k, d in docs.items():
        for w, tf in Counter(d).items():
            tfn, rate = tf * math.log2(1 + mean / len(d)), cf[w] / n
            want[k, w] = (tf, dfs[w], round((math.log2(1 + rate) + tfn * math.log2((1 + rate) / rate)) / (tfn + 1), 9))
    got = {(r.rec, r.term): (r.tf, r.df, round(r.score, 9)) for r in distinctive.scores(df, "id", ["path", "text"], "at").collect()}
    assert got == want
    assert distinctive.scores(df.limit(0), "id", ["path", "text"], "at").count() == 0


def candidates(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for q in range(12):
        for c in range(60 if q == 0 else rng.randrange(1, 8)):
            for _ in range(rng.choice([1, 1, 2])):
                v = lambda: rng.choice([None, 0.0, float("nan"), rng.random() * 10 ** rng.randrange(-3, 6), -rng.random(), float("inf"), 1.0])
                rows.append((f"q{q}", f"c{c}", T0 + timedelta(rng.randrange(3)), v(), v(), v(), "x"))
    rows += [(None, "c", T0, 1.0, 1.0, 1.0, "x"), ("q1", None, T0, 9.0, 9.0, 9.0, "x"), ("win", "a", T0, 3.0, 3.0, None, "x"), ("win", "b", T0, 2.0, 2.0, 9.0, "x"), ("win", "c", None, 1.0, 1.0, 1.0, "x"), ("one", "a", T0, None, None, None, "x")]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, scored_at timestamp, a double, b double, c double, item string"), rows


def test_leximin_and_winner(spark):
    df, rows = candidates(spark)
    key = lambda x: (-1, 0.0) if x is None or x != x else (0, x)
    best: dict = {}
    for q, c, at, *v, _ in rows:
        if q and c:
            rank = (at or datetime(1, 1, 1), tuple(map(key, v)))
            if (q, c) not in best or rank > best[q, c]:
                best[q, c] = rank
    groups = defaultdict(dict)
    for (q, c), (_, v) in best.items():
        groups[q][c] = v
    places, winners = {}, set()
    for q, g in groups.items():
        pct = {c: tuple(sum(o[i] < v[i] for o in g.values()) / (len(g) - 1) if len(g) > 1 else 0.0 for i in range(3)) for c, v in g.items()}
        for c in g:
            places[q, c] = 1 + sum(sorted(o) > sorted(pct[c]) for o in pct.values())
            if all(sum(x > y for x, y in zip(pct[c], pct[o])) >= 2 for o in g if o != c):
                winners.add((q, c))
    pct = ranking.percentiles(ranking.latest(df, "query_id", "chunk_id", ["a", "b", "c"], "scored_at"), ["a", "b", "c"]).cache()
    assert {(r.grp, r.item): r.place for r in ranking.leximin(pct).collect()} == places
    assert {tuple(r) for r in ranking.undominated(pct).collect()} == winners and ("win", "a") in winners
    assert ranking.undominated(ranking.leximin(pct.limit(0))).count() == 0


def test_winner_survives_many_levels(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FAN", 4)
    pct = spark.range(500).select(F.lit("q").alias("grp"), F.concat(F.lit("c"), "id").alias("item"), F.lit(500).cast("long").alias("total"), F.when(F.col("id") == 123, F.array(F.lit(0.9), F.lit(0.9), F.lit(0.0))).otherwise(F.array(F.rand(1) * 0.8, F.rand(2) * 0.8, F.rand(3))).alias("pct"))
    assert [tuple(r) for r in ranking.undominated(pct.cache()).collect()] == [("q", "c123")]


def test_token_ids_equal_the_tokenizer(spark, sf):
    import tiktoken

    from tessera.llm.packing import PYTHON_PATTERN

    enc = tiktoken.Encoding("own", pat_str=PYTHON_PATTERN, mergeable_ranks=bpe.vocabulary(f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"), special_tokens={})
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n \t x", "don't I'll 'S", "가나다 라마 zażółć 漢字かな交じり文。", "🙂👩‍👩‍👧 é é", " \u00a0 \u3000a\u2028b\x85c", "x" * 3000, "가" * 500, "<|endoftext|>", "1234567 12,3.5", "क्षत्रिय ภาษาไทย"]
    texts += ["가" * 2000, "abcdefg" * 300, "하하" * 700, " " * 1500 + "x", "!?" * 900, "".join(rng.choice("abcdefgh") for _ in range(2500)), "".join(rng.choice(["xx", "가", "ㅋㅋ", "漢", "the", "ing"]) for _ in range(600))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xAC00, 0xD7A3), rng.randrange(0x370, 0x3FF), 32, 10])) for _ in range(rng.randrange(60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate(texts)], "doc_id long, text string, word string, ids array<int>")
    got = {r.doc_id: r for r in bpe.encode(df, "doc_id", "text").withColumn("back", bpe.decode(F.col("ids"))).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == enc.encode_ordinary(t or ""), t
        assert got[i].back == (t or "")
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_long_words_take_near_linear_time(spark):
    import time

    rng = random.Random(6)
    took = {}
    for n in (10, 20_000, 40_000):
        df = spark.createDataFrame([(1, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)))], "doc_id long, text string")
        start = time.perf_counter()
        assert bpe.decode(F.col("ids")) is not None and bpe.encode(df, "doc_id", "text").select(bpe.decode(F.col("ids")).alias("t")).collect()[0].t == df.collect()[0].text
        took[n] = time.perf_counter() - start
    assert took[40_000] - took[10] < 10


def test_queries_run(spark, sf):
    for name in ("p1_found", "p3_found", "p6_found"):
        assert catalog.QUERIES[name](spark, sf).count() > 0
