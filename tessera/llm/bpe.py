"""Byte-level BPE of a public tokenizer as Spark expressions (problem 8).

Texts are split into words by the tokenizer's pattern, every *distinct* word is encoded once, and words
are put together again by document. The fold over a word keeps the array of its pieces (bytes, one
character of ISO-8859-1 each) and the array of the ranks of neighbouring pairs; each step merges the
leftmost pair of least rank and looks up only the two pairs that changed. The ranks are one literal: an
array of small maps, addressed by a checksum of the piece, so that a look-up costs the same for any
vocabulary size. The vocabulary file is read on the driver; its place is a parameter.

Decoding concatenates the binary pieces of the ids.

Defined results: null and empty texts have an empty list of ids, never null; repeated ids of documents
give repeated rows only if the input has them; an empty table gives no rows; no text or word is cut.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NONE = 2147483647
BUCKETS = 1 << 14
#: Half a stretch of a long word: a multiple of the bytes of a character in any script and of short even periods.
STRIDE = 96

#: White space as the tokenizer's own engine has it; Java's \s is ASCII only.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


@cache
def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _rank_json(path: str) -> str:
    table: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in vocabulary(path).items():
        key = piece.decode("latin-1")
        table[zlib.crc32(key.encode()) % BUCKETS][key] = rank
    return json.dumps(table, ensure_ascii=False)


@cache
def _piece_json(path: str) -> str:
    v = vocabulary(path)
    table = [""] * (max(v.values()) + 1)
    for piece, rank in v.items():
        table[rank] = piece.decode("latin-1")
    return json.dumps(table, ensure_ascii=False)


def rank_map(path: str) -> Column:
    """The literal rank map; constant folding makes it one literal of the plan."""
    return F.from_json(F.lit(_rank_json(path)), "array<map<string,int>>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, inside an expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def as_bytes(word: Column) -> Column:
    """UTF-8 bytes, a character of ISO-8859-1 each."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def _rank(piece: Column, table: Column) -> Column:
    return F.coalesce(F.try_element_at(F.get(table, (F.crc32(piece.cast("binary")) % BUCKETS).cast("int")), piece), F.lit(NONE))


def _fold(raw: Column, table: Column) -> Column:
    """Pieces of a stretch of bytes: as many steps as bytes, each merging the leftmost pair of least rank."""
    nothing = F.array().cast("array<int>")

    def merge(acc: Column) -> Column:
        def at(k: Column) -> Column:
            return let(
                F.concat(F.element_at(acc["p"], k), F.element_at(acc["p"], k + 1)),
                lambda new: F.struct(
                    F.concat(F.slice(acc["p"], F.lit(1), k - 1), F.array(new), F.slice(acc["p"], k + 2, F.size(acc["p"]))).alias("p"),
                    F.concat(
                        F.slice(acc["r"], F.lit(1), F.greatest(k - 2, F.lit(0))),
                        F.when(k > 1, F.array(_rank(F.concat(F.element_at(acc["p"], F.greatest(k - 1, F.lit(1))), new), table))).otherwise(nothing),
                        F.when(k + 1 < F.size(acc["p"]), F.array(_rank(F.concat(new, F.get(acc["p"], k + 1)), table))).otherwise(nothing),
                        F.slice(acc["r"], k + 2, F.size(acc["p"])),
                    ).alias("r"),
                ),
            )

        return let(F.array_min(acc["r"]), lambda least: F.when(least < NONE, let(F.array_position(acc["r"], least).cast("int"), at)).otherwise(acc))

    n = F.length(raw)
    pieces = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(raw, i, F.lit(1)))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: _rank(F.substr(raw, i, F.lit(2)), table))).otherwise(nothing)
    return F.aggregate(F.sequence(F.lit(1), n), F.struct(pieces.alias("p"), pairs.alias("r")), lambda acc, _: merge(acc), lambda acc: acc["p"])


def _placed(pieces: Column, base: Column) -> Column:
    """Pieces with the place each begins at."""
    start = F.struct(base.cast("int").alias("at"), F.array().cast("array<struct<at:int,piece:string>>").alias("out"))
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p.alias("piece")))).alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def encode_word(raw: Column, table: Column) -> Column:
    """Ids of a word given by its bytes (a variable that holds :func:`as_bytes`).

    A fold copies its arrays at every merge, so a long word is folded in stretches, each half over the next. A row of
    pieces is the right one if and only if every two neighbours are the encoding of their own bytes: until a merge
    crosses some border for the first time, two neighbours are merged in the order they would be alone. Two stretches
    that share a piece at one place can therefore be joined in it, for all neighbours then stand in one right row. Where
    two stretches share none (pieces longer than a stretch, odd periods) the word is folded whole.
    """
    n = F.length(raw)

    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(n / STRIDE).cast("int") - 2, F.lit(0)))
    # Bound to a variable, a stretch is cut out once and not once a byte.
    rows = F.transform(numbers, lambda k: _placed(let(F.substr(raw, k * STRIDE + 1, F.lit(2 * STRIDE)), lambda part: _fold(part, table)), k * STRIDE))

    def joined(t: Column) -> Column:
        shared = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda k: F.array_min(F.array_intersect(F.get(t, k), F.get(t, k + 1)))["at"])
        inside = lambda c: F.flatten(F.transform(t, lambda x, k: F.filter(x, lambda y: (y["at"] > F.coalesce(F.get(c, k - 1), F.lit(-1))) & (y["at"] <= F.coalesce(F.get(c, k), n)))))
        return let(shared, lambda c: F.when(~F.exists(c, lambda x: x.isNull()), inside(c)))

    long = F.when(n > 2 * STRIDE, F.transform(let(rows, joined), lambda x: x["piece"]))
    return F.when(n > 0, let(_rank(raw, table), lambda whole: F.when(whole < NONE, F.array(whole)).otherwise(F.transform(F.coalesce(long, _fold(raw, table)), lambda x: _rank(x, table)))))


def dictionary(text: DataFrame, path: str) -> DataFrame:
    """``word, ids`` of every distinct word of a table ``text``."""
    distinct = text.select(F.explode(words(F.col("text"))).alias("word")).distinct()
    # The literal stands once in the plan; the fold refers to it by a variable.
    return distinct.select("word", let(rank_map(path), lambda table: let(as_bytes(F.col("word")), lambda raw: encode_word(raw, table))).alias("ids"))


def encode(docs: DataFrame, key: str, text: str, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key, ids``: one row per row of ``docs``; ``key`` must be unique (null is a key as others).

    A word that stands in very many documents makes one partition of the join large: adaptive execution splits it, so
    leave its skew join on.
    """
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # An empty text must keep its row through the explode: it gets one null word.
    split = F.when(F.length("text") > 0, words(F.col("text")))
    placed = d.select("key", F.posexplode_outer(split).alias("pos", "word"))
    known = dictionary(d, path)
    return (
        placed.join(known, "word", "left")
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")))).alias("w"))
        .select(F.col("key").alias(key), F.flatten(F.transform("w", lambda x: x["ids"])).alias("ids"))
    )


def decode(ids: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Column:
    """The text of an array of ids; an empty array gives an empty text, null gives null."""
    table = F.from_json(F.lit(_piece_json(path)), "array<string>")
    return F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(table, i)), ""), "ISO-8859-1"), "UTF-8")
