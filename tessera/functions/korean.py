"""Korean-aware tokenisation as column expressions: no UDF but for NFKC, and that only where it matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.normal import nfkc_lower

# Endings and particles that are taken off a word, in the order they are tried.
ENDINGS = "알려주세요 해주세요 되나요 하나요 인가요 은가요 습니까 합니까 했는데 하는데 되는데 합니다 됩니다 입니다 하세요 주세요 이에요 예요 해서 해도 하면 되면 하고 하며 하지 해야 하여 하는 되는 한 된 할 될 함 됨 히 게".split()
PARTICLES = "에서는 에게서 으로는 이라고 라고는 에서도 까지는 부터는 에서 에게 으로 라도 이나 까지 부터 보다 처럼 한테 에는 만큼 조차 마저 은 는 이 가 을 를 에 와 과 의 도 만 로 께 뿐".split()
# Words that carry no subject.
STOPWORDS = "그 저 이것 그것 어떻게 무엇 인가요 하나요 있나요 됩니다 합니다 입니다 건가요 건지 어디 언제 누구 왜 수 것 때 등 및 또는 그리고 하는 되는 대한 관한".split()
# Stems of question words, and last syllables of predicates.
INTERROGATIVES = "어떻 어떤 무엇 얼마 며칠 언제 어디 누구 무슨 몇".split()
PREDICATE_ENDS = "요다까죠지"

_ENDING = f"^(.{{2,}}?)(?:{'|'.join(ENDINGS)})$"
_PARTICLE = f"^(.{{2,}}?)(?:{'|'.join(PARTICLES)})$"


def normalize(c: Column) -> Column:
    """NFKC, lower case, white space collapsed and trimmed; null stays null."""
    return F.trim(F.regexp_replace(nfkc_lower(c), r"(?U)\s+", " "))


def split_words(normal: Column) -> Column:
    """Runs of digits, Latin letters and Hangul of a normal text."""
    return F.filter(F.split(normal, "[^0-9a-z가-힣]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """The word without its ending, then without its particle; each only if two characters remain."""
    return F.regexp_replace(F.regexp_replace(word, _ENDING, "$1"), _PARTICLE, "$1")


def bigrams(word: Column) -> Column:
    """Neighbouring pairs of characters; empty below two characters."""
    n = F.length(word)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def _stop(word: Column) -> Column:
    return word.isin(*STOPWORDS)


def tokens(normal: Column, with_bigrams: bool = True) -> Column:
    """Per word of two or more characters: the word, its stem if it differs (both unless stopwords), its marked bigrams."""
    none = F.array().cast("array<string>")

    def of(x: Column) -> Column:
        w, s = x["word"], x["stem"]
        parts = [F.when(~_stop(w), F.array(w)).otherwise(none), F.when((s != w) & ~_stop(s), F.array(s)).otherwise(none)]
        if with_bigrams:
            parts.append(F.transform(bigrams(w), lambda g: F.concat(F.lit("__"), g)))
        return F.concat(*parts)

    # The stem is a field, so its patterns run once a word and not once a use.
    stemmed = F.transform(F.filter(split_words(normal), lambda w: F.length(w) >= 2), lambda w: F.struct(w.alias("word"), stem(w).alias("stem")))
    return F.flatten(F.transform(stemmed, of))


def content_terms(normal: Column) -> Column:
    """Distinct stems of two or more characters that are no stopwords, in order."""
    return F.array_distinct(F.filter(F.transform(split_words(normal), stem), lambda s: (F.length(s) >= 2) & ~_stop(s)))


def _predicate(w: Column) -> Column:
    return F.right(w, F.lit(1)).isin(*PREDICATE_ENDS)


def subject_terms(normal: Column) -> Column:
    """Content terms without question words and predicates."""
    return F.filter(content_terms(normal), lambda s: ~s.isin(*INTERROGATIVES) & ~_predicate(s))


def rare_subjects(normal: Column, least: int = 3) -> Column:
    """Content terms long enough to be a subject that must be known to the collection."""
    return F.filter(content_terms(normal), lambda s: (F.length(s) >= least) & ~_predicate(s))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct elements; 0 if either side is empty or null."""
    union = F.size(F.array_union(a, b))
    return F.coalesce(F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Number of common distinct elements."""
    return F.coalesce(F.size(F.array_intersect(a, b)), F.lit(0))
