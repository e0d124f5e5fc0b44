"""Sentence units across languages and scripts (problem 2).

A pushdown automaton runs over the text blocks of a document (see ``markup``). Its stack holds the open
list levels below, and quotations and brackets above; a terminator ends a unit only while no quotation
or bracket is open, or if it is the last thing inside one that ends the sentence with it. Full stops are
told apart by a trie of abbreviations read backwards, by digits, dates and initials, and by what follows.
Scripts with terminators of their own (。।) end at these, Thai at blanks between Thai letters.

Units are offsets in code points of the raw field. Headings are one unit; list items, clauses and
paragraphs are cut into sentences; tables, code and displayed formulas have none. Defined results: null,
empty and blank texts have no units; an unclosed quotation or bracket counts as a plain character; texts
are never cut.
"""

from __future__ import annotations

import re

from tessera.llm.markup import CODE, FORMULA, HEADING, ITEM, TABLE, Block, _trim, flavour, formulas, parse

#: Abbreviations that never end a sentence. Fixed values.
NEVER = (
    "e.g i.e cf vs mr mrs ms mx dr prof st no nos nr fig figs sec secs art arts abs ver vol pp p ch eq rev ed approx ca bzw ggf vgl evtl inkl zzgl "
    "z.b z. b|u.a u. a|d.h d. h|o.ä s.o hr fr frau hrn mme mlle m mm tel str dept gen sen rep hon capt col lt sgt jan feb mar apr jun jul aug sep sept oct okt nov dec dez janv févr avr juil déc "
    "env ex réf chap op डॉ श्री प्रो पृ सं ม.ค ก.พ มี.ค เม.ย พ.ค มิ.ย ก.ค ส.ค ก.ย ต.ค พ.ย ธ.ค พ.ศ ค.ศ ดร"
)
#: Abbreviations that may also end one: they do before a capital letter. Fixed values.
MAY = "etc usw al inc ltd co corp llc bros jr sr p.m a.m p. m|a. m|u.s u.k gmbh bldg ave blvd dez. min max std usf"

_END, _CLASS = "$", "#"


def _trie() -> dict:
    """Trie of the abbreviations' letters from the last to the first."""
    root: dict = {}
    for kind, words in (("never", NEVER), ("may", MAY)):
        for part in words.split("|"):
            items = part.split()
            # A pair written with a blank ("z. B") ends one part and is kept whole.
            if len(items) >= 2 and len(items[-1]) == 1 and items[-2].endswith("."):
                items[-2:] = [items[-2] + " " + items[-1]]
            for w in items:
                node = root
                for c in reversed(w):
                    node = node.setdefault(c, {})
                node[_CLASS] = kind
    return root


TRIE = _trie()
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jan feb mär apr jun jul aug sep okt nov dez jänner".split())

OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "【": "】", "(": ")", "（": "）", "[": "]", "‘": "’", "{": "}", "〔": "〕", "｢": "｣"}
CLOSE = frozenset("”“»›」』》〉】)）]’}〕｣\"")
STRAIGHT = '"'
BRACKETS = frozenset("(（[【{〔")
STRONG = frozenset("!?。！？｡।॥؟۔።៕")
STOP = frozenset(".．…‥")
FINAL = frozenset("다요죠까네음함임됨오라자지군걸")
PARTICLE = re.compile(r"(?:이?라고|이?라는|이?란|하고|하는|고|는|라며|라면서|이?라|에|을|를|와|과|로|의|은|가|도)(?![가-힣]{3})")

_SKIP = re.compile(
    r"</?[A-Za-z][^<>]*>"
    r"|\]\([^()\s]*\)"
    r"|\\(?:href|url)\{[^{}]*\}"
    r"|(?:https?|ftp)://[^\s<>()\[\]{}\"“”‘’「」가-힣]*[^\s<>()\[\]{}\"“”‘’「」가-힣.,;:!?]"
    r"|[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
    r"|&\#?\w+;"
    r"|(?<!`)(`+)(?!`)[^`\n]+\1(?!`)"
)
_THAI_GAP = re.compile(r"(?<=[ก-๎])[ \t​]*\s+(?=[ก-ๅ็-๎])")
_TAIL = re.compile(r"(?:\*{1,3}|_{1,3}|'{2,5}|`+|~~|</(?:b|i|u|s|em|strong|span|a|code|font|small|mark|q|sup|sub|ins|del)\s*>|\}|\]\([^()\s]*\)|\]\])+", re.I)
_LEAD = re.compile(r"(?:\s|\0|[​‌‍⁠﻿­]|<[A-Za-z][^<>]*>|\*{1,3}(?=\S)|_{1,3}(?=\S)|'{2,5}|`+|\\[a-z]+\{|\[\[|\[(?=\S))*")
_WORD = re.compile(r"[^\W\d_]+$")
_MARK = re.compile(r"[.!?…‥．。！？｡।॥؟۔።៕]+")
_KEY = re.compile("|".join([re.escape(c) for c in {*OPEN, *CLOSE, STRAIGHT}] + [_MARK.pattern]))


def _hangul(c: str) -> bool:
    return "가" <= c <= "힣"


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def abbreviation(text: str, dot: int, least: int) -> str | None:
    """Class of the longest abbreviation that ends right before ``dot`` at a word's start."""
    node, i, found = TRIE, dot - 1, None
    while i >= least and (node := node.get(text[i].lower())) is not None:
        i -= 1
        if _CLASS in node and (i < least or not (text[i].isalnum() or text[i] in "&_-") or _hangul(text[i]) or _cjk(text[i])):
            found = node[_CLASS]
    return found


def _paired(text: str, a: int, b: int, skip: dict[int, int]) -> dict[int, int]:
    """Place of the closing mark of each opening one that has one."""
    pairs: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    i = a
    while m := _KEY.search(text, i, b):
        j, c = m.start(), m.group(0)
        i = m.end()
        if j in skip:
            i = max(i, skip[j])
            continue
        if c == STRAIGHT:
            k = next((n for n in range(len(stack) - 1, -1, -1) if stack[n][0] == STRAIGHT), None)
            if k is not None:
                pairs[stack[k][1]] = j
                del stack[k:]
            else:
                stack.append((c, j))
            continue
        if c in CLOSE:
            k = next((n for n in range(len(stack) - 1, -1, -1) if c in OPEN.get(stack[n][0], "")), None)
            if k is not None:
                pairs[stack[k][1]] = j
                del stack[k:]
                continue
        if c in OPEN:
            stack.append((c, j))
    return pairs


class Automaton:
    """Cuts one block's span into sentences."""

    def __init__(self, text: str, levels: list[int], kind: str):
        self.text, self.levels, self.kind = text, levels, kind

    def _next(self, i: int, b: int) -> tuple[str, bool, int]:
        """Next visible character after inline marks, whether white space lies before it, and its place."""
        m = _LEAD.match(self.text, i, b)
        j = m.end()
        return (self.text[j] if j < b else ""), any(c.isspace() or c == "\0" for c in m.group(0)), j

    def _stops(self, a: int, i: int, j: int, b: int, begin: int) -> bool:
        """Whether the marks at [i, j), outside quotations and brackets, end a sentence begun at ``begin``."""
        t = self.text
        run, p = t[i:j], t[i - 1] if i > a else " "
        if any(c in STRONG for c in run):
            return True
        n, gap, at = self._next(j, b)
        if not n:
            return True
        raw = t[j] if j < b else ""
        if len(run) > 1 or run in "…‥":
            if n.islower() and n.isascii() or n in ",;:，、":
                return False
            if gap and _hangul(n):
                return not _hangul(p) or p in FINAL
            return True
        if raw in ",;:)]，、；：）」』":
            return False
        word = _WORD.search(t, max(begin, i - 24), i)
        short = abbreviation(t, i, begin)
        if not gap:
            if p.isdigit():
                return False
            if n.isascii() and n.isalnum() or n.isdigit():
                if _hangul(p) and p in FINAL or _cjk(p):
                    return True
                follows = t[at : at + 2]
                if word and len(word.group(0)) > 2 and word.group(0).islower() and not short and re.match(r"(?:19|20)\d\d[.\-/年]", t[at : at + 5]):
                    return True
                return bool(n.isupper() and word and len(word.group(0)) > 2 and word.group(0).islower() and follows[1:].islower() and not short)
            if n in "/\\@_-=&":
                return False
            if short or word and len(word.group(0)) == 1 and word.group(0).isupper():
                return False
            return True
        if short == "never":
            return False
        if word and len(word.group(0)) == 1 and word.group(0).isupper() and (word.start() <= begin or t[word.start() - 1] in " .\n\t("):
            return False
        if short == "may":
            return n.isupper() and n.isascii()
        if p.isdigit():
            head = t[max(begin, i - 24) : i]
            digits = re.search(r"\d+$", head).group(0)
            if re.fullmatch(r"\s*\d{1,3}", t[begin:i]):
                return False
            if n.isdigit() and re.search(r"(?<!\d)\d{4}(?:\.\s*\d{1,2})?$", head):
                return False
            if re.search(r"(?<!\d)\d{4}\.\s*\d{1,2}\.\s*\d{1,2}$", head) and (_hangul(n) or n in "~-–("):
                return False
            if n.isdigit() and re.search(r"(?<!\d)\d{1,2}\.\s*\d{1,2}$|(?<!\d)\d{1,2}$", head):
                return False
            follow = re.match(r"[^\W\d_]+", t[at : at + 12])
            if len(digits) <= 2 and follow and (follow.group(0).lower() in MONTHS or n.islower()):
                return False
            return True
        if word and len(word.group(0)) == 1 and re.match(r"[^\W\d_]\.", t[at : at + 2]):
            return False
        if n.islower() and n.isascii() and (p.isascii() or p.isalpha() and "À" <= p <= "ÿ"):
            # A small letter goes on, unless it begins a file or host name.
            return bool(re.match(r"[\w-]+(?:\.[\w-]+)+", t[at : at + 60]))
        return True

    def _quote_ends(self, k: int, b: int, opener: int, begin: int) -> bool:
        """Whether a sentence ends with the closing mark before ``k`` whose inside ended with a terminator."""
        t = self.text
        if opener <= self._next(begin, b)[2] and t[opener] in BRACKETS:
            return True
        if t[opener] in BRACKETS:
            return False
        n, gap, at = self._next(k, b)
        if not n:
            return True
        if not gap or n in ",;:.!?。，、":
            return False
        if n.islower():
            return False
        if _hangul(n):
            return not PARTICLE.match(t, at)
        return n.isupper() or n.isdigit() or n in OPEN or n == STRAIGHT or _cjk(n)

    def cut(self, a: int, b: int) -> list[tuple[int, int]]:
        t = self.text
        skip = {m.start(): m.end() for m in _SKIP.finditer(t, a, b)}
        for _, _, x, y in formulas(t[a:b], self.kind):
            skip[a + x] = a + y
        inside: dict[int, int] = {}
        for x, y in skip.items():
            for i in range(x, y):
                inside[i] = max(y, inside.get(i, 0))
        pairs = _paired(t, a, b, inside)
        closers = {v: k for k, v in pairs.items()}
        thai = {m.start(): m.end() for m in _THAI_GAP.finditer(t, a, b)} if any("฀" <= c <= "๿" for c in t[a:b]) else {}
        units: list[tuple[int, int]] = []
        stack: list[int] = [-level for level in self.levels]
        floor = len(stack)
        begin, i = a, a
        marks = sorted({*(m.start() for m in _MARK.finditer(t, a, b)), *pairs, *closers, *thai})
        for i in marks:
            if i < begin or i in inside:
                continue
            if i in thai:
                if len(stack) == floor:
                    units.append((begin, i))
                    begin = thai[i]
                continue
            if i in pairs:
                stack.append(i)
                continue
            if i in closers:
                if closers[i] in stack[floor:]:
                    del stack[stack.index(closers[i], floor) :]
                continue
            j = _MARK.match(t, i, b).end()
            if i > a and t[i - 1] in ".!?…。！？।" and i - 1 >= begin and i - 1 not in inside:
                continue
            if len(stack) == floor:
                if not self._stops(a, i, j, b, begin):
                    continue
                while j < b and t[j] in CLOSE and j not in closers and t[j] in "”’»」』)）" and t[j] not in "’":
                    j += 1
            else:
                open_now, k, first = stack[floor:], j, None
                while open_now:
                    m = _TAIL.match(t, k, b)
                    if m and not (k < b and k in closers):
                        k = m.end()
                    if k < b and closers.get(k) == open_now[-1]:
                        first = open_now.pop()
                        k += 1
                    else:
                        break
                if open_now:
                    continue
                if not self._quote_ends(k, b, first, begin):
                    continue
                j = k
                del stack[floor:]
            if m := _TAIL.match(t, j, b):
                j = m.end() if t[j] not in "`'" or j + 1 >= b or not t[m.end() : m.end() + 1].isalnum() else j
            units.append((begin, j))
            begin = j
        units.append((begin, b))
        return units


def units(text: str | None) -> list[tuple[int, int]]:
    """Sentence units of a text, in order, as (from, to)."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    kind = flavour(text)
    levels: list[int] = []
    for b in parse(text):
        if b.kind in (CODE, TABLE, FORMULA):
            continue
        raw = text[b.start : b.end]
        if b.kind == ITEM:
            while levels and levels[-1] >= b.level:
                levels.pop()
            levels.append(b.level)
        else:
            levels = []
        alone = formulas(raw, kind)
        if alone and alone[0][1] and len(alone) == 1:
            continue
        hidden = _blank_tags(text, b)
        spans = [(b.start, b.end)] if b.kind == HEADING else Automaton(hidden, levels, kind).cut(b.start, b.end)
        for x, y in spans:
            x, y = _trim(hidden, x, y)
            if x < y and any(c.isalnum() for c in hidden[x:y]):
                out.append((x, y))
    return out


_BR = re.compile(r"<(?i:br)\b[^<>]*>|\\\\(?=\s|$)|<!--.*?-->", re.S)


def _blank_tags(text: str, b: Block) -> str:
    """The text with line-break tags of the block turned into blanks of the same length."""
    raw = text[b.start : b.end]
    if "<" not in raw and "\\\\" not in raw:
        return text
    return text[: b.start] + _BR.sub(lambda m: " " * len(m.group(0)), raw) + text[b.end :]
