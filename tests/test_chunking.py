"""Chunking against plain loops."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import chunking as c


def sections(body):
    out, stack, buf, start, at, path = [], [], [], 0, 0, ""

    def flush():
        text = "\n".join(buf).strip()
        if text:
            out.append((path, text, start))
        buf.clear()

    for line in body.split("\n"):
        m = re.match(r"^(#{1,4})\s+(.*)$", line)
        if m:
            flush()
            n = len(m[1])
            stack[n - 1 :] = []
            stack += [""] * (n - 1 - len(stack)) + [m[2].strip()]
            path, start = " > ".join(p for p in stack if p), at + len(line) + 1
        else:
            buf.append(line)
        at += len(line) + 1
    flush()
    return out


def pack(parts, join, limit, overlap):
    out, cur = [], ""
    for p in parts:
        if cur and len(cur + join + p) > limit:
            out.append(cur)
            cur = (cur[-overlap:] + " " + p).strip() if overlap else p
        else:
            cur = cur + join + p if cur else p
    return out + ([cur] if cur else [])


def bodies(n):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("가나다라마바사") for _ in range(rng.randrange(2, 6)))
    for _ in range(n):
        lines = []
        for _ in range(rng.randrange(1, 14)):
            r = rng.random()
            if r < 0.35:
                lines.append("#" * rng.randrange(1, 6) + " " + word())
            elif r < 0.5:
                lines.append("")
            else:
                lines.append(" ".join(word() for _ in range(rng.randrange(1, 60))) + rng.choice([".", "니다.", "", "?"]) + (" " + word() if r > 0.8 else ""))
        yield "\n".join(lines)


def test_sections_and_packing(spark):
    rows = [(i, b) for i, b in enumerate(bodies(120))]
    got = spark.createDataFrame(rows, "i int, body string").select("i", "body", c.sections(F.col("body")).alias("s"), c.split_long(F.col("body")).alias("p")).collect()
    for r in got:
        assert [tuple(x) for x in r.s] == sections(r.body)
        if len(r.body) > c.LONGEST:
            parts = [p for p in re.split(r"(?<=[.!?])\s+|(?<=다\.)\s*|(?<=요\.)\s*", r.body) if p and p.strip()]
            assert list(r.p) == pack(parts, " ", c.TARGET, c.OVERLAP)
        else:
            assert list(r.p) == [r.body]


def test_regulation_and_references(spark):
    text = "① " + "가" * 400 + " ② " + "나" * 400 + " ③ 다"
    r = spark.range(1).select(c.split_clauses(F.lit(text)).alias("p"), c.article_reference(F.lit("규정 > 제 12조(휴가)"), F.lit("② 가 ② 나")).alias("a"), c.article_reference(F.lit("x > 제3조"), F.lit("③ 가")).alias("b"), c.article_reference(F.lit("x"), F.lit("③")).alias("n"), c.is_table(F.lit("| a |\n| b |\nc")).alias("t")).first()
    assert [len(p) for p in r.p] == [402, 402 + 1 + 3] and (r.a, r.b, r.n, r.t) == ("제12조 제2~2항", "제3조 제3항", "", True)


def test_dirty_documents(spark):
    cols = ", ".join(f"{k} {'array<string>' if k in ('acl_groups', 'audience', 'statutory') else 'boolean' if k == 'demo_assumption' else 'string'}" for k in c.INHERITED) + ", body string, text string"
    row = lambda body: tuple(["D-1", "1.0", "T"] + [None] * (len(c.INHERITED) - 3) + [body, "clash"])
    df = spark.createDataFrame([row(None), row(""), row("# T\n가나다"), row("# T\n가나다")], cols)
    got = c.chunk_documents(df).collect()
    assert [(r.chunk_id, r.text, r.section_path) for r in got] == [("D-1@1.0#0000", "가나다", "T")] * 2
    assert c.chunk_documents(df.limit(0)).count() == 0
