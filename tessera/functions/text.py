"""Scalar text expressions: cleaning, sentences, lists, predicates, facts, guards. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Signals of procedure, method and application questions.
PROCEDURE = r"무엇|뭐|뭘|어떻게|어떤|어디|순서|절차|방법|준비|과정|제출|신청|등록|수정|반납|이수|수강|예약|작성|해야|들어야|하나요|받나요|필요한|알려"
METHOD = r"어떻게|순서|절차|방법|과정"
APPLICATION = r"제?\s*경우|이런\s?경우|저는|제가|해당(되|하|됩|합)|인정되|포함되|가능한가|되나요|봐도\s?되|써도\s?되|쓸\s?수\s?있"
# What marks actions, questions, forward references and cautions.
ACTION = r"(제출|신청|이수|확인|등록|작성|선택|입력|업로드|반납|수강|예약|문의|준비|조회)(합니다|하세요|해야 합니다|하시기 바랍니다)\.?$"
QUESTION = r"(\?|나요|까요|는가요|은가요|런가요|가요)\s*$"
FORWARD = r"아래|다음과 같이|다음의|다음 표"
CAUTIONS = ["단,", "다만", "예외", "주의", "확인 필요", "달라질 수 있", "않을 수 있", "지연될 수 있", "포함되지 않습니다", "하지 않습니다", "필요할 수 있", "권합니다"]
# Guard patterns, in the order they are tried.
BLOCK = {
    "주민등록번호": r"\d{6}[-\s]?[1-4]\d{6}",
    "카드번호": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
    "계좌번호": r"\d{2,3}[-\s]\d{2,6}[-\s]\d{2,7}",
    "비밀번호·인증번호": r"(비밀번호|패스워드|임시\s?비번|인증번호|OTP)\s*(?:[은는이가]|[:=])?\s*[\"']?[A-Za-z0-9!@#$%^&*._+\-]{4,}",
}
MASK = {"휴대전화": (r"01[016789][-\s]?\d{3,4}[-\s]?\d{4}", "010-****-####"), "이메일": (r"[a-zA-Z0-9_가-힣.+-]+@[a-zA-Z0-9_가-힣-]+\.[a-zA-Z0-9_가-힣.]+", "***@***")}
HEALTH = r"검진\s?결과|진단|소견|처방|질환|수치"
INSTITUTION = r"언제|대상|신청|절차|방법|기준|주기|공유|안내|어떻게|어디"
THIRD_PARTY = r"동료|다른\s?직원|타인|[가-힣]{2,4}\s?씨의|[가-힣]{2,4}\s?님의|[가-힣]{2,4}\s?의\s*(건강|검진|급여|평가)"
INJECTION = [
    r"(이전|위의|앞의).{0,10}(지시|규칙|프롬프트|명령).{0,10}(무시|잊)",
    r"(?i)ignore\s+(all\s+)?(previous|prior)\s+instructions",
    r"(?i)system\s*prompt",
    r"(너의|당신의)\s*(규칙|지침|프롬프트)를?\s*(알려|출력|보여)",
    r"(?i)개발자\s?모드|jailbreak|DAN\s?모드",
]
# Units a number may carry in a fact.
FACT = r"\d[\d,]*\s*(?:년|월|일|시|분|주|개월|만|천|원|%|배|회|할|명|건|시간)?"

SENTENCE_END = r"(?<=니다\.)\s*|(?<=[.!?])\s+"
LIST_ITEM = r"^\s*(?:[-*+]|\d+\.)\s+(.*)$"


def clean(c: Column) -> Column:
    """Without emphasis, code, quote and heading marks; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[*_`>#]", ""), r"\s+", " "))


def display(line: Column) -> Column:
    """A line as shown: separator rows empty, table cells joined by a middle dot, others clean."""
    cells = F.filter(F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), clean), lambda x: x != "")
    return (
        F.when(line.rlike(r"^\s*\|?[\s:|-]+\|[\s:|-]*$"), "")
        .when(line.rlike(r"^\s*\|"), F.array_join(cells, " · "))
        .otherwise(clean(line))
    )


def sentences(c: Column, least: int = 8) -> Column:
    """Sentences line by line: blank, table and rule lines give none, a list item is one, others are split and
    kept from ``least`` characters on."""

    def of(line: Column) -> Column:
        item = F.regexp_extract(line, LIST_ITEM, 1)
        parts = F.filter(F.transform(F.split(F.trim(line), SENTENCE_END), clean), lambda s: F.length(s) >= least)
        return (
            F.when((F.trim(line) == "") | F.trim(line).startswith("|") | F.trim(line).startswith("---"), F.array().cast("array<string>"))
            .when(line.rlike(LIST_ITEM), F.array(clean(item)))
            .otherwise(parts)
        )

    return F.filter(F.flatten(F.transform(F.split(c, "\n"), of)), lambda s: s != "")


def list_items(c: Column, least: int = 6) -> Column:
    """List items ``struct(item, ordered)`` of at least ``least`` characters after cleaning."""
    rows = F.transform(
        F.filter(F.split(c, "\n"), lambda x: x.rlike(LIST_ITEM)),
        lambda x: F.struct(clean(F.regexp_extract(x, LIST_ITEM, 1)).alias("item"), x.rlike(r"^\s*\d+\.\s+").alias("ordered")),
    )
    return F.filter(rows, lambda r: F.length(r["item"]) >= least)


def is_caution(s: Column) -> Column:
    found = F.lit(False)
    for m in CAUTIONS:
        found = found | s.contains(m)
    return found


def _parts(path: Column, title: Column) -> Column:
    return F.filter(F.split(F.coalesce(path, F.lit("")), " > "), lambda p: (p != "") & (p != F.coalesce(title, F.lit(""))))


def heading(path: Column, title: Column) -> Column:
    """Last element of a section path that is not the title; empty for a preamble or null."""
    parts = _parts(path, title)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("")


def section_name(path: Column, title: Column) -> Column:
    """Section path without the title; the title for a preamble."""
    parts = _parts(path, title)
    return F.when(F.size(parts) > 0, F.array_join(parts, " > ")).otherwise(title)


def facts(c: Column) -> Column:
    """Number-with-unit tokens without white space."""
    return F.transform(F.regexp_extract_all(c, F.lit(FACT), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", ""))


def unverified(sentence: Column, sources: Column) -> Column:
    """Facts of a sentence that none of the sources (array) contains."""
    corpus = F.regexp_replace(F.array_join(sources, " "), r"\s+", "")
    return F.filter(facts(sentence), lambda t: F.instr(corpus, t) == 0)


def mask_id(c: Column) -> Column:
    return F.concat(F.substring(c, 1, 2), F.lit("****"))


def mask_email(c: Column) -> Column:
    return F.when(c.contains("@"), F.concat(F.substring(c, 1, 2), F.lit("***@"), F.substring_index(c, "@", -1))).otherwise(c)


def fingerprint(c: Column) -> Column:
    """First twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 12)


def strip_markup(c: Column) -> Column:
    """Without script and style blocks and their content, dangling ones, and tags of up to 200 characters."""
    s = F.regexp_replace(c, r"(?is)<\s*(script|style)\b[^>]*>.*?<\s*/\s*\1\s*>", " ")
    s = F.regexp_replace(s, r"(?is)<\s*(script|style)\b[^>]*>.*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"<[^>]{0,200}>", " "), r"\s+", " "))


def _any(c: Column, patterns: list[str]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | c.rlike(p)
    return found


def scan(c: Column) -> Column:
    """``struct(action, reason, text, injection)``: block, third_party, mask or allow, tried in this order; null allows."""
    blocked = F.lit(None).cast("string")
    for label, p in reversed(BLOCK.items()):
        blocked = F.when(c.rlike(p), label).otherwise(blocked)
    masked, labels = c, F.array().cast("array<string>")
    for label, (p, by) in MASK.items():
        labels = F.when(masked.rlike(p), F.concat(labels, F.array(F.lit(label)))).otherwise(labels)
        masked = F.regexp_replace(masked, p, by.replace("$", "\\$"))
    health = c.rlike(HEALTH)
    third = c.rlike(THIRD_PARTY) & health
    personal = health & ~c.rlike(INSTITUTION)
    action = F.when(blocked.isNotNull(), "block").when(third, "third_party").when(personal | (F.size(labels) > 0), "mask").otherwise("allow")
    reason = F.coalesce(blocked, F.when(third, "타인 개인정보 요청").when(personal, "건강정보 서술").otherwise(F.array_join(labels, "+")), F.lit(""))
    text = F.when(action.isin("block", "third_party"), "").otherwise(masked)
    return F.struct(action.alias("action"), reason.alias("reason"), text.alias("text"), F.coalesce(_any(c, INJECTION), F.lit(False)).alias("injection"))


def unsafe_to_store(c: Column) -> Column:
    """Whether a text may not be kept: a blocked value, or health data without an institutional question."""
    return F.coalesce(_any(c, list(BLOCK.values())) | (c.rlike(HEALTH) & ~c.rlike(INSTITUTION)), F.lit(False))
