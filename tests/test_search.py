"""Search over blocks of chunks against plain loops, and what it moves between tasks."""

import math
import random
from collections import Counter

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tessera.functions import korean
from tessera.operators import blocks, retrieval

COLUMNS = "chunk_id string, chunk_ord long, section_path string, text string"


def chunk_rows():
    """Chunks that all have a word in common, many of them twice or more, some empty."""
    rng = random.Random(5)
    texts = [" ".join(["common", *rng.choices(["alpha", "beta", "gamma", "휴가를", "신청"], k=rng.randrange(1, 6))]) for _ in range(150)] + [None, ""]
    return [(f"c{i}", 7 * i, rng.choice([None, "", "heading beta"]), rng.choice(texts)) for i in range(450)]


def by_loops(spark, rows, asked):
    """BM25 and cosine of each pair with a common term, from the definition."""
    listed = spark.createDataFrame([(r[1], r[2] or "", r[3] or "") for r in rows], "o long, p string, t string").select("o", korean.tokens(korean.normalize(F.concat("p", F.lit("\n"), "t"))).alias("b"), korean.tokens(korean.normalize(F.col("p"))).alias("h")).collect()
    of_query = {r.q: Counter(r.t) for r in spark.createDataFrame([(q,) for q in asked], "q string").select("q", korean.tokens(F.col("q")).alias("t")).collect()}
    tf, n = {r.o: Counter(r.b) for r in listed}, len(listed)
    head, length, mean = {r.o: Counter(r.h) for r in listed}, {r.o: len(r.b) for r in listed}, sum(len(r.b) for r in listed) / n
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    weight = {o: {t: (k + 3 * head[o][t]) * idf[t] for t, k in c.items()} for o, c in tf.items()}
    norm = {o: math.sqrt(sum(w * w for w in c.values())) for o, c in weight.items()}
    out = {}
    for q, terms in of_query.items():
        mine = {t: k * idf[t] for t, k in terms.items() if t in df}
        unit = math.sqrt(sum(w * w for w in mine.values()))
        for o in tf:
            if common := [t for t in mine if t in tf[o]]:
                bm25 = sum(terms[t] * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[o][t] * 2.2 / (tf[o][t] + 1.2 * (0.25 + 0.75 * length[o] / mean)) for t in common)
                out[q, o] = (bm25, sum(mine[t] / unit * weight[o][t] / norm[o] for t in common))
    return out


def moved(spark, run):
    """The result of ``run``, and the rows its jobs wrote for other tasks."""
    sc = spark.sparkContext._jsc.sc()
    start = sc.dagScheduler().nextStageId()
    out = run()
    sc.listenerBus().waitUntilEmpty(30_000)
    rows = 0
    for i in range(start, sc.dagScheduler().nextStageId()):
        try:
            rows += sc.statusStore().lastStageAttempt(i).shuffleWriteRecords()
        except Py4JJavaError:
            pass  # a stage that was skipped
    return out, rows


QUERIES = [f"common {a} {b}" for a in ("alpha", "beta", "신청", "alpha alpha", "없다") for b in ("gamma", "휴가를", "heading", "x1")] + ["unknown", "common"]


def prepared(spark, monkeypatch):
    monkeypatch.setattr(blocks, "size", lambda chunks: 100)
    rows = chunk_rows()
    index = retrieval.build_index(spark.createDataFrame(rows, COLUMNS).cache())
    index.postings, index.terms = index.postings.cache(), index.terms.cache()
    assert index.postings.count() > 2 and index.terms.count()
    return rows, index, spark.createDataFrame([(q,) for q in QUERIES], "qtext string")


def test_candidates_of_blocks(spark, monkeypatch):
    rows, index, asked = prepared(spark, monkeypatch)
    want = by_loops(spark, rows, QUERIES)
    found, written = moved(spark, lambda: retrieval.candidates(asked, index).collect())
    got = {(r.qtext, r.chunk_ord): (r.bm25, r.cosine) for r in found}
    assert len(got) == len(found)
    fill = sorted(r[1] for r in rows)[:30]
    for q in QUERIES:
        scored = {o: s for (x, o), s in want.items() if x == q}
        scored = {o: (0.0, 0.0) for o in fill} | scored
        best = {o for k in (0, 1) for o in sorted(scored, key=lambda o: (-round(scored[o][k], 10), o))[:30]}
        assert {o for x, o in got if x == q} == best
        assert all(abs(got[q, o][k] - scored[o][k]) < 1e-9 for o in best for k in (0, 1))
    # Candidates travel inside a row of each query and block, other pairs not at all.
    assert written < len(want) / 2


def test_first_chunks_of_many_equal_ones(spark):
    rows = [(f"c{i}", 1000 - i, None, "same words here" if i % 2 else "other words here") for i in range(200)]
    index = retrieval.build_index(spark.createDataFrame(rows, COLUMNS))
    got = retrieval.candidates(spark.createDataFrame([("same",)], "qtext string"), index).collect()
    assert sorted(r.chunk_ord for r in got) == sorted(r[1] for r in rows if r[3].startswith("same"))[:30]


def test_scores_of_blocks(spark, monkeypatch):
    rows, index, asked = prepared(spark, monkeypatch)
    want = by_loops(spark, rows, QUERIES)
    found, written = moved(spark, lambda: retrieval.scores(asked, index).collect())
    got = {(r.qtext, r.chunk_ord): (r.bm25, r.cosine) for r in found}
    assert len(got) == len(found) and got.keys() == want.keys()
    assert all(abs(got[k][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))
    # No pair is written for another task.
    assert written < len(want) / 2
