"""Structure of texts in HTML, Markdown, wiki or LaTeX markup, or none (problem 4).

``parse`` reads a text into blocks with offsets into the raw text. Blocks are then classified in two
passes: the first decides by length, stop-word density and link density, and leaves short or thin blocks
open; the second gives each open block the label of its nearest decided neighbours. ``elements`` lists
headings, list items, code blocks and formulas of the blocks that are content, ``clean`` writes them out
as plain text with that structure kept.

Markups may be mixed in one text; a text may begin or end inside a construct (chunks do): an unclosed one
runs to the end. Defined results: null, empty and blank texts have no blocks; texts are never cut.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

HEADING, ITEM, CLAUSE, PARA, CODE, FORMULA, TABLE = "heading", "list_item", "clause", "para", "code", "formula", "table"

#: Tags that begin and end blocks; all others are inline.
BLOCK_TAGS = "address article aside blockquote body dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p section table tbody td tfoot th thead title tr ul"
#: Very frequent words of the languages served; their share tells running text from labels and menus.
STOPWORDS = frozenset(
    "the of and to in is a for on at by if it be are with as was you that this from or not "
    "der die das und ist wird in zu den nicht mit von bei auf ein eine dem nach le la les de des du est en un une pour et à "
    "이 그 저 수 등 및 를 을 은 는 의 에 が の は を に と で 的 了 在 是 और के है को में की".split()
)


@dataclass
class Block:
    kind: str
    start: int
    end: int
    level: int = 0
    content: str = ""
    shown: bool = False
    label: str = field(default="")


_HOLES = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))"
    r"|^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*(?:\n|\Z)(?P<fenced>(?s:.*?))(?:^[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)"
    r"|\\begin\{(?P<venv>verbatim|Verbatim|lstlisting|minted)\*?\}(?:\[[^\]\n]*\])?(?:\{[^}\n]*\})?(?P<verb>(?s:.*?))(?:\\end\{(?P=venv)\*?\}|\Z)"
    r"|<(?P<ptag>(?i:pre|syntaxhighlight|source))\b[^>]*>(?P<pre>(?s:.*?))(?:</(?P=ptag)\s*>|\Z)"
    r"|(?P<table><(?i:table)\b(?s:.*?)(?:</(?i:table)\s*>|\Z)|^\{\|(?s:.*?)(?:^\|\}|\Z)|\\begin\{(?P<tenv>tabular[*x]?|longtable|table)\}(?s:.*?)(?:\\end\{(?P=tenv)\}|\Z)|^[ \t]*\|[^\n]*\|[ \t]*$)"
    r"|\\begin\{(?P<menv>equation|align|gather|displaymath|eqnarray|multline|math)\*?\}(?P<env>(?s:.*?))(?:\\end\{(?P=menv)\*?\}|\Z)"
    r"|\$\$(?P<dollars>[^$]+?)\$\$|\\\[(?P<square>(?s:.*?))\\\]",
    re.M,
)
_INLINE_CODE = r"(?<!`)(?P<tick>`+)(?!`)(?:[^`\n]|(?!(?P=tick))`)+?(?P=tick)(?!`)|<(?i:code|tt|kbd)\b[^>]*>[^<]*</(?i:code|tt|kbd)\s*>|\\texttt\{[^{}]*\}"
_MATH = re.compile(
    rf"(?P<skip>{_INLINE_CODE}|\\\$)"
    r"|<math\b[^>]*>(?P<wiki>(?s:.*?))</math\s*>|\\\((?P<round>(?s:.*?))\\\)|\$(?![\s$])(?P<dollar>[^$\n]*?[^\s$\\])\$(?![\d$])"
)
_TAG = re.compile(r"<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*|/)?>")
_LATEX = re.compile(r"\\(?P<sec>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title)\*?(?:\[[^\]\n]*\])?\{|\\(?P<env>begin|end)\{(?P<name>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*|\\(?P<item>item)\b(?:\[[^\]\n]*\])?|\\(?:maketitle|tableofcontents|newpage|clearpage)\b|\\documentclass[^\n]*|\\usepackage[^\n]*")
_ATX = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?(?:[ \t]*\{#[\w-]+\})?[ \t]*$")
_WIKI_HEAD = re.compile(r"(={1,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
_UNDERLINE = re.compile(r"[ ]{0,3}(?:={2,}|-{2,})[ \t]*$")
_RULE = re.compile(r"[ ]{0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_BULLET = re.compile(r"([ \t]*)(?:[-+•‣◦]|\*{1,6}|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)")
_WIKI_ITEM = re.compile(r"([*#]+)[ \t]*(?=[^\s*#])")
_CLAUSE = re.compile(r"[ \t]*[①-⑳㉑-㉟][ \t]*(?=\S)")
_INDENT = re.compile(r"[ \t]*(?::+[ \t]*|(?:>[ \t]?)+)")
_WIKI = re.compile(r"^(={1,6})[ \t]*[^=\n]+\1[ \t]*$|'''|\[\[|<math\b|<syntaxhighlight\b|^\{\|", re.M)
_HTML = re.compile(r"</?(?i:p|li|div|ul|ol|h[1-6]|table|span|strong|em|b|br|a|pre)\b[^<>]*>")
_TEX = re.compile(r"\\(?:begin|end|(?:sub)*section|paragraph|item|emph|textbf|textit|texttt|href)\b|\\[%&_#]")


def flavour(text: str) -> str:
    """The markup a text gives evidence of: latex, wiki, html or markdown (which plain text reads as)."""
    return "latex" if _TEX.search(text) else "wiki" if _WIKI.search(text) else "html" if _HTML.search(text) else "markdown"


def _brace_end(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        c = text[i]
        if c == "{" and text[i - 1] != "\\":
            depth += 1
        elif c == "}" and text[i - 1] != "\\":
            depth -= 1
            if not depth:
                return i
        elif c == "\n" and text[i : i + 2] == "\n\n":
            return i
    return len(text)


def parse(text: str | None) -> list[Block]:
    """Blocks in order of their place; offsets are code points of the raw text."""
    if not text or not text.strip():
        return []
    kind = flavour(text)
    blocks: list[Block] = []
    chars = list(text)

    def blank(a: int, b: int, by: str = "\0") -> None:
        chars[a:b] = by * (b - a)

    at = 0
    while m := _HOLES.search(text, at):
        g, a, b = m.groupdict(), m.start(), m.end()
        at = max(b, a + 1)
        if g["comment"] is not None:
            blank(a, b, " ")
            continue
        if g["fenced"] is not None:
            blocks.append(Block(CODE, a, b, content=g["fenced"]))
        elif g["verb"] is not None:
            blocks.append(Block(CODE, a, b, content=g["verb"]))
        elif g["pre"] is not None:
            blocks.append(Block(CODE, a, b, content=html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", g["pre"]))))
        elif g["table"] is not None:
            blocks.append(Block(TABLE, a, b))
        else:
            source = next(g[k] for k in ("env", "dollars", "square") if g[k] is not None)
            blocks.append(Block(FORMULA, a, b, content=html.unescape(source) if kind in ("html", "wiki") else source, shown=True))
        blank(a, b)
    bare = "".join(chars)

    opens: dict[int, tuple[str, int]] = {}
    depth = 0
    for m in _TAG.finditer(bare):
        name, close = m["name"].lower(), bool(m["close"])
        if name == "br":
            blank(m.start(), m.end(), " ")
        elif name in BLOCK_TAGS.split():
            blank(m.start(), m.end())
            if name in ("ul", "ol"):
                depth = max(0, depth + (-1 if close else 1))
            elif name == "li" and not close:
                opens[m.end()] = (ITEM, max(1, depth))
            elif re.fullmatch("h[1-6]", name) and not close:
                opens[m.end()] = (HEADING, int(name[1]))
    if kind == "latex":
        levels = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
        for m in _LATEX.finditer(bare):
            blank(m.start(), m.end())
            if m["sec"]:
                end = _brace_end(bare, m.end() - 1)
                blank(end, min(end + 1, len(bare)))
                opens[m.end()] = (HEADING, levels[m["sec"]])
            elif m["item"]:
                opens[m.end()] = (ITEM, max(1, depth))
            elif m["name"] in ("itemize", "enumerate", "description"):
                depth = max(0, depth + (1 if m["env"] == "begin" else -1))
    bare = "".join(chars)

    for piece in re.finditer(r"[^\0]+", bare):
        what, level = opens.get(piece.start(), (PARA, 0))
        _lines(bare, piece.start(), piece.end(), what, level, kind, blocks)
    blocks.sort(key=lambda b: (b.start, b.end))
    return blocks


def _lines(bare: str, start: int, end: int, what: str, level: int, kind: str, out: list[Block]) -> None:
    """Blocks of a piece between block tags. The stack of open list levels is kept by indentation."""
    buffer: Block | None = None
    indents: list[int] = []

    def flush() -> None:
        nonlocal buffer
        if buffer:
            a, b = _trim(bare, buffer.start, buffer.end)
            if a < b:
                buffer.start, buffer.end = a, b
                out.append(buffer)
        buffer = None

    if what in (HEADING, ITEM):
        buffer = Block(what, start, end, level)
        if what == HEADING or "\n\n" not in bare[start:end].strip():
            if what == ITEM and (m := _CLAUSE.match(bare, _trim(bare, start, end)[0])):
                buffer.start = m.end()
            flush()
            return
        buffer = Block(what, start, start, level)
    i = start
    while i < end:
        j = bare.find("\n", i, end)
        stop = end if j < 0 else j
        line, here = bare[i:stop], i
        whole_line = here == 0 or bare[here - 1] in "\n\0"
        i = stop + 1
        if not line.strip():
            flush()
            continue
        m = whole_line and _ATX.match(line)
        if m and not (kind == "wiki" and _WIKI_ITEM.match(line)) and kind in ("markdown", "html"):
            flush()
            indents.clear()
            out.append(Block(HEADING, here + m.start(2), here + m.end(2), len(m[1])))
            if not m[2].strip():
                out.pop()
            continue
        m = whole_line and _WIKI_HEAD.match(line)
        if m:
            flush()
            indents.clear()
            out.append(Block(HEADING, here + m.start(2), here + m.end(2), len(m[1])))
            continue
        if kind in ("markdown", "html") and _UNDERLINE.match(line):
            if buffer and buffer.kind == PARA:
                buffer.kind, buffer.level = HEADING, 1 if "=" in line else 2
            flush()
            continue
        if _RULE.match(line):
            flush()
            continue
        m = _WIKI_ITEM.match(line) if kind == "wiki" and whole_line else None
        if m:
            flush()
            buffer = Block(ITEM, here + m.end(), stop, len(m[1]))
            continue
        m = _BULLET.match(line) if kind != "latex" else None
        if m and not (buffer and buffer.kind == PARA and line.lstrip()[0].isdigit() and not line.lstrip().startswith(("1.", "1)"))) and not re.match(r"[ \t]*\*{2,}", line):
            flush()
            width = len(m[1].expandtabs(4))
            while indents and indents[-1] > width:
                indents.pop()
            if not indents or indents[-1] < width:
                indents.append(width)
            buffer = Block(ITEM, here + m.end(), stop, len(indents))
            continue
        m = _CLAUSE.match(line)
        if m:
            flush()
            buffer = Block(CLAUSE, here + m.end(), stop)
            continue
        if buffer:
            buffer.end = stop
        else:
            m = _INDENT.match(line)
            buffer = Block(PARA, here + (m.end() if m else 0), stop)
    flush()


_EDGE = "\0\u200b\u200c\u200d\u2060\ufeff\u00ad"


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and (text[a].isspace() or text[a] in _EDGE):
        a += 1
    while a < b and (text[b - 1].isspace() or text[b - 1] in _EDGE):
        b -= 1
    return a, b


def formulas(text: str, kind: str) -> list[tuple[str, bool, int, int]]:
    """Inline formulas of a stretch of text: source, whether it stands alone, and place."""
    found = []
    for m in _MATH.finditer(text):
        if m["skip"] is None:
            source = next(m[k] for k in ("wiki", "round", "dollar") if m[k] is not None)
            found.append((html.unescape(source) if kind in ("html", "wiki") else source, not (text[: m.start()] + text[m.end() :]).strip(), m.start(), m.end()))
    return found


_CLEAN_COMMON = [(re.compile(r"<math\b[^>]*>(.*?)</math\s*>", re.S), r"\1"), (re.compile(r"\\\((.*?)\\\)", re.S), r"\1"), (re.compile(r"(?<!\\)\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\d$])"), r"\1")]
_CLEAN = {
    "latex": [(re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), r"\1"), (re.compile(r"\\url\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:footnote|label|ref|cite)\{[^{}]*\}"), ""), *[(re.compile(r"\\(?:emph|text[a-z]{2,6}|underline|mbox|textsc)\{([^{}]*)\}"), r"\1")] * 3, (re.compile(r"\\\\(?=\s|$)"), " "), (re.compile(r"\\([%&_#${}])"), r"\1"), (re.compile(r"(?<!\\)~"), " ")],
    "wiki": [(re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"), (re.compile(r"\[https?://[^\s\]]+\s+([^\]]*)\]"), r"\1"), (re.compile(r"'{2,5}"), ""), (re.compile(r"\{\{[^{}]*\}\}"), "")],
    "markdown": [
        (re.compile(r"!\[([^\[\]]*)\]\([^()]*\)"), r"\1"), (re.compile(r"\[([^\[\]]*)\]\([^()]*(?:\([^()]*\)[^()]*)*\)"), r"\1"), (re.compile(r"\[([^\[\]]+)\]\[[^\[\]]*\]"), r"\1"), (re.compile(r"<(https?://[^<>\s]+)>"), r"\1"),
        (re.compile(r"(?<![\\`])(`+)(?!`)(.+?)(?<!`)\1(?!`)"), r"\2"),
        *[(re.compile(rf"(?<![\\\w{c}]){n}(?![\s{c}])(.+?)(?<![\s\\]){n}(?![\w{c}])", re.S), r"\1") for c, n in ((r"\*", r"\*\*\*"), (r"\*", r"\*\*"), ("_", "__"), (r"\*", r"\*"), ("_", "_"), ("~", "~~"))],
        (re.compile(r"\*\*(?=[^\W\d_])([^*\n]+?)(?<=[^\W\d_])\*\*"), r"\1"),
        (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"),
    ],
    "html": [],
}


def visible(raw: str, kind: str) -> str:
    """The words a reader sees, white space as single blanks."""
    s = raw
    for pattern, by in (*_CLEAN_COMMON, *_CLEAN[kind]):
        s = pattern.sub(by, s)
    if kind != "latex":
        s = re.sub(r"</?[A-Za-z][^<>]*>", "", s)
        s = html.unescape(s)
    return " ".join(s.split())


# -- classification ---------------------------------------------------------------------------------

SHORT, LONG, DENSE, THIN, LINKED, MENU = 40, 120, 0.08, 0.02, 0.6, 3
_LINK = re.compile(r"\[[^\[\]]*\]\([^()]*\)|\[\[[^\[\]]*\]\]|<a\b[^>]*>(.*?)</a\s*>|\\href\{[^{}]*\}\{[^{}]*\}|https?://\S+", re.S | re.I)
#: Parts of a page that frame it.
_FRAME = re.compile(r"<(nav|header|footer|aside)\b[^>]*>(?:.*?</\1\s*>|.*\Z)", re.S | re.I)
#: Scripts without blanks between words: there the share of function words is that of their characters among all.
_UNSPACED = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u4e00-\u9fff]")
#: Not \\w: vowel signs belong to their words.
_BORDER = re.compile(r"[\s.,;:!?()\[\]{}<>\"“”„«»।/|-]+")
_ENDED = re.compile(r"[.!?。！？।…](?=\s|$)|[。！？।]")
_FUNCTION = re.compile(r"[のはをにがでともへやか的了在是和不有就也请把被个这那]|ที่|ใน|และ|ของ|ให้|ได้|เป็น|มี|จะ|ไม่|การ|เพื่อ")


def _stops(words: str) -> float:
    """Share of function words, in scripts without blanks that of their characters, whichever is greater."""
    tokens = [t for t in _BORDER.split(words.lower()) if t]
    spaced = sum(t in STOPWORDS or (len(t) > 1 and t[-1] in "은는을를이가의에도로요다") for t in tokens) / max(1, len(tokens))
    return max(spaced, 2 * len(_FUNCTION.findall(words)) / max(1, len(_UNSPACED.findall(words)), len(words) // 8))


def classify(blocks: list[Block], text: str, kind: str) -> None:
    """Label every block ``content`` or ``residue``.

    The first pass decides: running text by its function words is content; a long paragraph almost without any and without a
    sentence's end (a wall of labels) is residue where the text's language is known by its other blocks, and so are blocks made of links that frame the page (in nav, header, footer or aside, or three and
    more in a row before anything is content). All other blocks are open: short ones, headings, code, formulas, single
    links and lists of links inside the text. The second pass gives an open block the label its nearest decided
    neighbours share; where they differ, or there is none, it is content, for a lost line costs more than a kept label.
    A short line or item at either end follows its only neighbour, and one inside of a frame those of the frame; a heading
    never does.
    """
    frames = [m.span() for m in _FRAME.finditer(text)] if kind == "html" else []
    sizes: dict[int, int] = {}
    frame: dict[int, int] = {}
    for b in blocks:
        if b.kind in (CODE, FORMULA, TABLE):
            b.label = "open"
            continue
        raw = text[b.start : b.end]
        words = visible(raw, kind)
        size = sizes[id(b)] = len(words)
        linked = sum(len(visible(m.group(0), kind)) for m in _LINK.finditer(raw)) / max(1, size)
        frame[id(b)] = next((n for n, (x, y) in enumerate(frames) if x <= b.start < y), -1)
        if linked > LINKED and size > 3:
            b.label = "residue" if frame[id(b)] >= 0 else "linked"
        elif size < SHORT or b.kind == HEADING:
            b.label = "open"
        else:
            stops = _stops(words)
            b.label = "content" if stops >= DENSE or (size >= LONG and stops >= THIN) else "wall" if size >= LONG and b.kind == PARA and not _ENDED.search(words) else "open"
    known = any(b.label == "content" for b in blocks)
    for b in blocks:
        if b.label == "wall":
            b.label = "residue" if known else "open"
    begun = False
    i = 0
    while i < len(blocks):
        j = i
        while j < len(blocks) and blocks[j].label == "linked":
            j += 1
        for b in blocks[i:j]:
            b.label = "residue" if j - i >= MENU and not begun else "open"
        begun |= blocks[i].label == "content"
        i = max(j, i + 1)
    decided = [(i, b.label) for i, b in enumerate(blocks) if b.label != "open"]
    k = 0
    for i, b in enumerate(blocks):
        if b.label != "open":
            continue
        while k < len(decided) and decided[k][0] < i:
            k += 1
        around, inner = decided[max(0, k - 1) : k + 1], 0 < k < len(decided)
        mine = frame.get(id(b), -1)
        if mine >= 0 and (own := [x for x in around if frame.get(id(blocks[x[0]]), -1) == mine]):
            around, inner = own, len(own) == 2
        line = b.kind in (ITEM, PARA, CLAUSE) and sizes.get(id(b), SHORT) < SHORT
        b.label = "residue" if {x[1] for x in around} == {"residue"} and (inner or line) else "content"


def elements(text: str | None) -> list[tuple[str, str]]:
    """Distinct (kind, content) of the headings, list items, code blocks and formulas that are content."""
    blocks = parse(text)
    if not blocks:
        return []
    kind = flavour(text)
    classify(blocks, text, kind)
    found: dict[tuple[str, str], None] = {}
    for b in blocks:
        if b.label != "content" or b.kind == TABLE:
            continue
        if b.kind in (CODE, FORMULA):
            content = " ".join(b.content.split())
            if content:
                found[b.kind, content] = None
            continue
        raw = text[b.start : b.end]
        for source, *_ in formulas(raw, kind):
            if source.strip():
                found[FORMULA, " ".join(source.split())] = None
        if b.kind in (HEADING, ITEM) and (content := visible(raw, kind)):
            found[b.kind, content] = None
    return list(found)


def clean(text: str | None) -> str | None:
    """Plain text: ``#`` headings, ``-`` list items by level, fenced code, ``$`` formulas, paragraphs; residue left out."""
    if text is None:
        return None
    blocks = parse(text)
    kind = flavour(text)
    classify(blocks, text, kind)
    out = []
    for b in blocks:
        if b.label != "content":
            continue
        if b.kind == CODE:
            out.append("```\n" + b.content.strip("\n") + "\n```")
        elif b.kind == FORMULA:
            out.append("$" + " ".join(b.content.split()) + "$")
        elif b.kind == TABLE:
            rows = [" | ".join(c for c in (visible(x, kind) for x in re.split(r"\|\|?|&|</t[dh]\s*>", r, flags=re.I)) if c and not re.fullmatch(r"[-:\s{}]+|class=.*", c)) for r in re.split(r"\n\|-|\\\\|</tr\s*>|\n", re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\{[^}]*\})?", "", text[b.start : b.end]), flags=re.I)]
            out += [r for r in rows if r]
        else:
            words = visible(text[b.start : b.end], kind)
            mark = "#" * max(1, b.level) + " " if b.kind == HEADING else "  " * (max(1, b.level) - 1) + "- " if b.kind == ITEM else ""
            out.append(mark + words)
    return "\n".join(x for x in out if x.strip())
