"""Documents into chunks, inside the row: no shuffle, whatever the number of documents.

Sections come from headings of one to four marks; a section's path keeps the last title of each shallower
level. Plain documents are cut at sentence ends and packed to a target length with an overlap, regulations
only before circled clause marks. Short plain pieces join the piece before them. All steps are array
expressions, the packings are folds over a document's own pieces.

Defined results: a null or blank body has no chunks; text before the first heading belongs to the title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lengths in characters.
TARGET, LONGEST, SHORTEST, OVERLAP = 400, 700, 120, 80
REGULATION = "규정"
_HEADING = r"^(#{1,4})\s+(.*)$"
_SENTENCE = r"(?<=[.!?])\s+|(?<=다\.)\s*|(?<=요\.)\s*"
CLAUSES = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"

_EMPTY = "array<string>"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sections(body: Column) -> Column:
    """``array<struct(path, text, start)>``; path is the titles of open levels, start the offset after the heading line."""
    lines = F.split(body, "\n", -1)
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    heads = F.filter(numbered, lambda x: x["line"].rlike(_HEADING))
    state = "struct<stack:array<string>,out:array<struct<i:int,path:string>>>"

    def push(acc: Column, h: Column) -> Column:
        level = F.length(F.regexp_extract(h["line"], _HEADING, 1))
        title = F.trim(F.regexp_extract(h["line"], _HEADING, 2))
        kept = F.slice(acc["stack"], F.lit(1), level - 1)
        stack = F.concat(kept, F.array_repeat(F.lit(""), F.greatest(level - 1 - F.size(kept), F.lit(0))), F.array(title))
        path = F.array_join(F.filter(stack, lambda p: p != ""), " > ")
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(h["i"].alias("i"), path.alias("path")))).alias("out")).cast(state)

    first = F.struct(F.array().cast(_EMPTY).alias("stack"), F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("path"))).alias("out")).cast(state)
    marks = F.aggregate(heads, first, push, lambda acc: acc["out"])

    def section(m: Column, k: Column) -> Column:
        after = F.coalesce(F.get(marks, k + 1)["i"], F.size(lines))
        text = F.array_join(F.slice(lines, m["i"] + 2, F.greatest(after - m["i"] - 1, F.lit(0))), "\n")
        start = F.when(m["i"] < 0, 0).otherwise(F.length(F.array_join(F.slice(lines, F.lit(1), m["i"] + 1), "\n")) + 1)
        return F.struct(m["path"].alias("path"), _strip(text).alias("text"), start.cast("int").alias("start"))

    return F.filter(F.transform(marks, section), lambda s: s["text"] != "")


def is_table(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    piped = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("|")))
    return (F.size(lines) > 0) & (piped >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2)))


def _pack(parts: Column, join: Column, limit: int, overlap: int) -> Column:
    """Greedy packing: a part that would exceed ``limit`` starts a new piece, with the tail of the one before."""
    state = "struct<out:array<string>,cur:string>"

    def step(acc: Column, part: Column) -> Column:
        joined = F.concat(acc["cur"], join, part)
        over = (acc["cur"] != "") & (F.length(joined) > limit)
        fresh = _strip(F.concat(F.right(acc["cur"], F.lit(overlap)), F.lit(" "), part)) if overlap else part
        return F.struct(
            F.when(over, F.concat(acc["out"], F.array(acc["cur"]))).otherwise(acc["out"]).alias("out"),
            F.when(over, fresh).when(acc["cur"] == "", part).otherwise(joined).alias("cur"),
        ).cast(state)

    start = F.struct(F.array().cast(_EMPTY).alias("out"), F.lit("").alias("cur")).cast(state)
    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def split_long(text: Column) -> Column:
    """Pieces of a plain section; a short text or a table stays whole."""
    parts = F.filter(F.split(text, _SENTENCE), lambda p: F.trim(p) != "")
    packed = _pack(parts, F.lit(" "), TARGET, OVERLAP)
    return F.when((F.length(text) <= LONGEST) | is_table(text) | (F.size(packed) == 0), F.array(text)).otherwise(packed)


def split_clauses(text: Column) -> Column:
    """Pieces of a regulation, cut only before clause marks; a clause is never cut."""
    parts = F.filter(F.transform(F.split(text, f"(?=[{CLAUSES}])"), _strip), lambda p: p != "")
    return F.when(F.size(parts) <= 1, F.array(text)).otherwise(_pack(parts, F.lit("\n"), LONGEST, 0))


def article_reference(path: Column, text: Column) -> Column:
    """``제N조``, with the clause or the range of clauses in the text; empty without an article in the path."""
    number = F.regexp_extract(path, r"제\s*(\d+)\s*조", 1)
    marks = F.transform(F.regexp_extract_all(text, F.lit(f"[{CLAUSES}]"), F.lit(0)), lambda m: F.instr(F.lit(CLAUSES), m))
    article = F.concat(F.lit("제"), number.cast("int").cast("string"), F.lit("조"))
    return (
        F.when(number == "", "")
        .when(F.size(marks) == 0, article)
        .when(F.size(marks) == 1, F.concat(article, F.lit(" 제"), F.get(marks, F.lit(0)).cast("string"), F.lit("항")))
        .otherwise(F.concat(article, F.lit(" 제"), F.array_min(marks).cast("string"), F.lit("~"), F.array_max(marks).cast("string"), F.lit("항")))
    )


def pieces(body: Column, title: Column, doc_type: Column) -> Column:
    """``array<struct(path, text, start)>`` of a document's chunks, in order."""
    kind = "array<struct<path:string,text:string,start:int>>"

    def of(s: Column) -> Column:
        parts = F.filter(F.split(s["path"], " > "), lambda p: (p != "") & (p != title))
        path = F.when(F.size(parts) > 0, F.concat(title, F.lit(" > "), F.array_join(parts, " > "))).otherwise(title)
        texts = F.when(doc_type.eqNullSafe(F.lit(REGULATION)), split_clauses(s["text"])).otherwise(split_long(s["text"]))
        return F.transform(texts, lambda t: F.struct(path.alias("path"), t.alias("text"), s["start"].alias("start")))

    raw = F.flatten(F.transform(sections(body), of)).cast(kind)

    def merge(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = last.isNotNull() & (F.length(x["text"]) < SHORTEST) & (F.length(last["text"]) + F.length(x["text"]) <= LONGEST)
        joined = F.struct(last["path"].alias("path"), F.concat(last["text"], F.lit("\n"), x["text"]).alias("text"), last["start"].alias("start"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x))).cast(kind)

    merged = F.aggregate(raw, F.array().cast(kind), merge)
    return F.when(doc_type.eqNullSafe(F.lit(REGULATION)), raw).otherwise(merged)


#: Attributes every chunk takes over from its document, so that filters need no join.
INHERITED = ["doc_id", "version", "title", "acl_groups", "audience", "sensitivity", "category", "published_at", "valid_until", "demo_assumption", "doc_type", "authority_level", "effective_from", "statutory"]


def chunk_documents(docs: DataFrame) -> DataFrame:
    """One row of each chunk with its id, place, article reference and the document's attributes."""
    cut = docs.select(*INHERITED, F.posexplode(pieces(F.col("body"), F.col("title"), F.col("doc_type"))).alias("pos", "c"))
    return cut.select(
        F.format_string("%s@%s#%04d", "doc_id", "version", "pos").alias("chunk_id"), "pos", *INHERITED, F.col("c.path").alias("section_path"), F.col("c.text").alias("text"),
        F.col("c.start").alias("char_start"), F.length("c.text").alias("char_len"), article_reference(F.col("c.path"), F.col("c.text")).alias("article_ref"),
    )
