"""Personal information in free text (problem 7).

Detection finds email addresses, phone numbers, identity numbers, street addresses and names of persons
by form and by what introduces them. Every distinct entity then gets one surrogate, derived with a key,
of the same type, script, format and (where the form shows it) gender; two entities never share one, an
entity keeps its own in all texts. Texts come out with typed placeholders that hold the surrogates.

Collisions are settled on the table of distinct entities, in rounds: of the entities that draw the same
surrogate one keeps it, the others draw again, from a larger space the later the round. A surrogate that
is itself an entity of the data is never given out.

Defined results: null and empty texts have no entities and stay as they are; JSON text is searched in its
decoded strings, text that is no JSON as it stands; a value that is several times in a record is one
entity; full-width digits and signs count as their plain forms.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.texts import spread
from tessera.session import cut

EMAIL, PHONE, ID, ADDRESS, NAME = "email", "phone", "id_number", "address", "name"

_WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 0x20, 0x2010: 0x2D, 0x2011: 0x2D, 0x2012: 0x2D, 0x2013: 0x2D, 0x2212: 0x2D}

_AT = r"(?:\s?@\s?|\s?[\[(]\s?(?:at|골뱅이)\s?[\])]\s?)"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|점)\s?[\])]\s?)"
_EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?{_AT}[A-Za-z0-9][A-Za-z0-9-]*(?:{_DOT}[A-Za-z0-9-]*[A-Za-z0-9])+(?![A-Za-z0-9@])")

_S = r"[-. ]?"
_PHONE = re.compile(
    r"(?<![\w+.-])(?:"
    rf"\+\d{{1,3}}{_S}\(?0?\)?\d{{1,4}}(?:{_S}\d{{2,4}}){{1,4}}"
    rf"|\(0\d{{1,3}}\)\s?\d{{3,4}}{_S}\d{{4}}"
    rf"|(?:010|011|016|017|018|019|070|050\d|공일공|영일공){_S}\d{{3,4}}{_S}\d{{4}}"
    rf"|0\d{{1,2}}[-. ]\d{{3,4}}[-. ]\d{{4}}"
    rf"|0(?:70|80|90)\d{{8}}|01[5-7]\d{{1,2}}[-/ ]?\d{{7,8}}"
    rf"|\(\d{{3}}\)\s?\d{{3}}[-. ]\d{{4}}|\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}"
    rf"|0\d(?: \d{{2}}){{4}}|1[3-9]\d[- ]?\d{{4}}[- ]?\d{{4}}"
    r")(?![\d\w-]*\d)(?![A-Za-z@])"
)
_ID_FORM = re.compile(
    r"(?<![\w+.-])(?:"
    r"\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[- ]?[0-9]\d{6}"
    r"|M\d{3}[A-Z]\d{4}|[A-Z]{1,2}\d{7,8}|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}(?<=\d)"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-DX]"
    r"|\d{3}[- ]\d{2}[- ]\d{4}"
    r"|\d{2}-\d{2}-\d{6}-\d{2}"
    r"|\d{17}[\dXx]"
    r")(?![\w-]*\d)(?![A-Za-z])"
)
#: What introduces an identity number; the form behind it may be any with four digits or more.
_ID_CUE = re.compile(r"(?:주민(?:등록)?번호[는은가]?|신분증 번호[는은가]?|외국인등록번호[는은가]?|운전면허(?:번호)?[는은가]?|여권(?:번호|/면허)?[는은가]?|Passport|Ausweis(?:nummer)?|SSN|マイナンバーは|身份证号?[码是为]*|護照|护照号?)\s*[:：]?\s*((?=[A-Z0-9 -]*\d{2})[A-Z0-9](?:[A-Z0-9]|[- ](?=[A-Z0-9]{2,}|[A-Z]\b)){6,20})(?![\w])")
_NOT_ID = re.compile(r"(?:오류 ?코드|접수 ?번호|문서|금액|Error|Ticket|Vorgang|error|ticket|受付番号|工单|버전|Case|Order|주문 ?번호|No\.|Nr\.|기간은)\s*[:：]?\s*#?$")

_KO_ADDRESS = r"(?:[가-힣]{1,6}(?:특별자치시|특별자치도|특별시|광역시|도)\s+)?(?:[가-힣]{1,8}(?:시|군)\s+)?(?:[가-힣]{1,8}구\s+)?(?:[가-힣0-9]{1,8}(?:읍|면|동|리)\s+)?[가-힣0-9]{1,10}(?:대로|로|길)\s*\d{1,4}(?:번길\s*\d{1,4})?(?:-\d{1,4})?(?:번지)?(?:,?\s*[가-힣]?\d{1,4}동)?(?:,?\s*\d{1,4}층)?(?:,?\s*\d{1,5}호)?"
_STREET = "Street|Avenue|Road|Lane|Close|Drive|Way|Court|Place|Boulevard|Terrace|Crescent|Square|Row|Hill|Gardens|Mews|Parade|St\\.?|Ave\\.?|Rd\\.?|Ln\\.?|Dr\\.?|Blvd\\.?"
_ADDRESS = re.compile(
    rf"(?<![\w])(?P<ko>{_KO_ADDRESS})(?![\d가-힣]*(?:번|픽셀|개))"
    rf"|(?<![\w-])\d{{1,5}}[A-Za-z]?,? (?:[A-Z][\w'’-]+ ){{1,3}}(?:{_STREET})(?:,? (?:Flat|Apt\.?|Apartment|Unit|Suite|Floor|#) ?\w+)?(?:, [A-Z][\w'’-]+(?: [A-Z][\w'’-]+)?)?(?:,? [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|,? [A-Z]{{1,2}}\d[A-Z\d]? ?\d[A-Z]{{2}})?(?!\w)"
    r"|(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß-]*(?:[Ww]eg|[Ss]traße|[Ss]trasse|[Ss]tr\.|[Pp]latz|[Aa]llee|[Gg]asse|[Rr]ing|[Dd]amm|[Uu]fer|[Ss]teig|[Pp]fad)|(?:Am|An der|Im|Zum|Zur) [A-ZÄÖÜ][\wäöüß-]+) \d{1,4} ?[a-z]?(?:, (?:Whg\.?|App\.?) ?\d+)?, (?:D-)?\d{5} [A-ZÄÖÜ][\wäöüß-]+"
    r"|(?<![\w-])\d{1,4}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|allée|impasse|quai) (?:(?:de|du|des|la|le|les|l['’]|d['’]) ?)*[A-ZÀ-Ý][\w'’-]+(?: [A-ZÀ-Ý][\w'’-]+)*(?:, (?:appt?\.?|appartement|bât\.?) ?\w+)?(?:, \d{5} [A-ZÀ-Ý][\w'’-]+)?"
    r"|(?:〒?\d{3}-\d{4}\s?)?[一-鿿ぁ-んァ-ヶー]{1,6}[都道府県][一-鿿ぁ-んァ-ヶー]{1,8}[市区町村][一-鿿ぁ-んァ-ヶー0-9]*\d+(?:丁目)?(?:[-−番地の号]+\d+)*(?:号室?|番地?)?(?:\s?\d+号室)?"
    r"|[一-鿿]{1,6}[市区町村][一-鿿ぁ-んァ-ヶー]{0,10}\d+(?:丁目\d+(?:番\d*号?)?|-\d+(?:-\d+)?)(?:号)?(?:\s?\d+号室)?"
    r"|(?:[一-鿿]{2,6}省)?[一-鿿]{2,6}市(?:[一-鿿]{1,6}[区县])?[一-鿿]{1,8}(?:路|街|大道|巷)\d+号(?:\d+[栋幢座])?(?:\d+单元)?(?:\d+[室楼])?"
)

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’]+)*"
_LATIN = rf"{_CAP}(?: (?:[A-Z]\.|(?:van|von|de|der|da|di|du|la|le)(?= [A-Z])|{_CAP})){{0,2}}"
_FULL = rf"{_CAP}(?: (?:[A-Z]\.|(?:van|von|de|der|da|di|du|la|le)(?= [A-Z])))*(?: {_CAP})"
_KO = r"[가-힣] ?[가-힣]{1,3}?"
_HAN = r"[一-鿿々]{1,4}[ 　]?[一-鿿々ぁ-んァ-ヶー]{1,4}"
_ANY = rf"{_LATIN}|{_KO}"
_RANK = "대리|과장|차장|부장|팀장|사원|주임|선임|책임|수석|이사|상무|전무|대표|매니저|실장|본부장"
#: Patterns that introduce or follow a person's name. The first group is the name, without title.
_NAMES = [
    re.compile(p)
    for p in (
        rf"(?:담당자|담당|신청자|승인자|작성자|결재자|동료|후임)(?:는|은|이|가)? ({_ANY})(?= ?(?:{_RANK})?(?:님|씨|께|에게|한테))",
        rf"(?:신청인|신청자|담당자|작성자|수신인|받는 ?사람|보내는 ?사람|이름|성명|예금주)\s?[:：]\s?({_FULL}|[가-힣] ?[가-힣]{{2}}(?![가-힣])|[가-힣]{{2,4}}(?![가-힣]))",
        rf"(?:제|내|저의|본인) (?:이름|성함)[은는이가] ({_FULL}|{_LATIN}|[가-힣] ?[가-힣]{{1,3}}?)(?=입니다|이에요|예요|이고|이라고|라고|임(?![가-힣])|[.,])",
        rf"(?:저는|전) ({_FULL}|[가-힣] ?[가-힣]{{2}})(?=입니다|이라고 합니다|라고 합니다)",
        rf"(?:사람|분|대상자|담당자)[은는이가] ({_ANY})(?= ?(?:{_RANK})?(?:님|씨)?(?:입니다|이에요|예요|이고|이며|인데))",
        rf"(?<![가-힣\w])({_FULL}|{_LATIN}|[가-힣] [가-힣]{{2}}|[가-힣]{{2,4}})(?= ?(?:(?:{_RANK})님|씨(?=[가는은를에께와도의, ]|$)|님(?=[과와이께은는을의에도, ]|$)))",
        rf"(?:[Mm]y name is|I am called|I spoke with|[Pp]lease (?:copy|cc|ask|contact)|[Rr]equested by:?|[Aa]pproved by:?|[Ss]igned by:?|[Aa]pplicant:|[Cc]ontact person:|[Rr]egards,|[Ss]incerely,|Name:|(?<![\w])(?:Mr|Mrs|Ms|Dr|Prof)\.?) ({_FULL})",
        rf"(?:[Mm]y name is|[Rr]equested by:|(?<![\w])(?:Mr|Mrs|Ms)\.) ({_LATIN})",
        rf"(?<!\w)Is ({_FULL})(?= still| my| the| on| in| away| your| our)",
        rf"(?:[Ii]ch heiße|[Mm]ein Name ist|Bitte|Antragsteller(?:in)?:|Frau|Herrn?|Gesprochen mit|(?:[Gg]estern|[Hh]eute) mit) ({_FULL})(?= informieren| gesprochen| anrufen| fragen| in Kopie|[.,;!\n]| |$)",
        rf"(?:[Jj]e m['’]appelle|[Mm]on nom est|[Dd]emandé par ?:?|[Dd]emandeu(?:r|se) ?:|Mme|M\.|Mlle|[Pp]révenir|[Pp]révenez|[Aa]vec) ({_FULL})",
        rf"(?:担当の|申請者[:：]\s?|氏名[:：]\s?|名前は|私は|昨日)({_FULL}|{_HAN})(?=さん|様|氏|です|と申|[\s。、]|$)",
        rf"(?<![\w])({_FULL})(?=さん|様|氏)",
        r"([一-鿿]{1,2}[ 　][一-鿿ぁ-んァ-ヶー]{1,3})(?=さん|様|氏)",
        rf"(?:我叫|我是|我的名字[是叫]|姓名[:：]\s?|申请人[:：]\s?|联系人[:：]\s?|负责人[:：]?\s?)({_FULL}|[一-鿿]{{2,4}}?)(?=[。，,；;\s]|$|先生|女士|老师|经理)",
        rf"(?:ผมชื่อ|ดิฉันชื่อ|ฉันชื่อ|ผู้ขอ[:：]?|คุณ)\s?({_FULL}|[ก-๎]{{2,14}}(?: [ก-๎]{{2,14}})?)",
        rf"(?:मेरा नाम|आवेदक[:：]?)\s({_FULL}|[ऀ-ॿ]{{2,12}}(?: [ऀ-ॿ]{{2,12}})?)(?= है|[।,.]|$|\n)",
    )
]
_NO_NAME = re.compile(r".*(?:팀|센터|부서|담당자?|운영진|관리자|팀장|회사|본사|지사|시스템|포털|님|분들|직원|사원|고객|여러분|선생)$|(?:누구|어느|다른|해당|인사|모든|저희|우리|부모|고객|회원|사장|선배|후배|동료|강사|손)\w{0,2}$")
_NO_LATIN = frozenset("The This That Please When Where What How Who Does May Bitte Wohin Wann Ticket Error Passport Home Text Call Reply Budget Is Are".split())


def _find(raw: str) -> list[tuple[int, int, str]]:
    text = raw.translate(_WIDE)
    taken: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        while b > a and text[b - 1] in " ,.":
            b -= 1
        if a < b and not any(x < b and a < y for x, y, _ in taken):
            taken.append((a, b, kind))

    for m in _EMAIL.finditer(text):
        add(m.start(), m.end(), EMAIL)
    for m in _ADDRESS.finditer(text):
        # A road and a number alone may be anything; a Korean address has a town or district before it.
        if m["ko"] is None or re.match(r"\S+(?:시|군|구|도|읍|면|동)\s", m["ko"]):
            add(m.start(), m.end(), ADDRESS)
    for m in _ID_FORM.finditer(text):
        if not _NOT_ID.search(text[max(0, m.start() - 14) : m.start()]):
            add(m.start(), m.end(), ID)
    for m in _ID_CUE.finditer(text):
        add(m.start(1), m.end(1), ID)
    for m in _PHONE.finditer(text):
        digits = re.sub(r"\D", "", m.group(0))
        if 8 <= len(digits) + 3 * ("공" in m.group(0)) <= 15 and not _NOT_ID.search(text[max(0, m.start() - 14) : m.start()]):
            add(m.start(), m.end(), PHONE)
    names: set[str] = set()
    for pattern in _NAMES:
        for m in pattern.finditer(text):
            name = m.group(1)
            if _NO_NAME.match(name.replace(" ", "")) or name.split()[0] in _NO_LATIN or name.endswith(tuple(_RANK.split("|"))):
                continue
            names.add(name.strip())
            add(m.start(1), m.end(1), NAME)
    for name in names:
        # The same name elsewhere in the record, without anything that introduces it.
        if len(name.replace(" ", "")) >= 3:
            for m in re.finditer(rf"(?<![\w가-힣]){re.escape(name)}(?![A-Za-z])", text):
                add(m.start(), m.end(), NAME)
    return sorted(taken)


def strings(payload: str) -> list[str]:
    """The decoded strings of a JSON text in order; the text itself if it is no JSON."""
    try:
        value = json.loads(payload)
    except ValueError:
        return [payload]
    out: list[str] = []

    def walk(v: object) -> None:
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            for x in v.values():
                walk(x)
        elif isinstance(v, list):
            for x in v:
                walk(x)

    walk(value)
    return out


def entities(text: str | None, is_json: bool = False) -> list[tuple[str, str]]:
    """Distinct (kind, value as it stands) of a record."""
    if not text:
        return []
    return list(dict.fromkeys((kind, s[a:b]) for s in (strings(text) if is_json else [text]) for a, b, kind in _find(s)))


def canonical(kind: str, value: str) -> str:
    """What makes two spellings the same entity."""
    v = value.translate(_WIDE)
    if kind == EMAIL:
        v = re.sub(r"\s?[\[(]\s?(?:at|골뱅이)\s?[\])]\s?", "@", v)
        return re.sub(r"\s?[\[(]\s?(?:dot|점)\s?[\])]\s?", ".", v).replace(" ", "").lower()
    if kind == PHONE:
        return re.sub(r"^82(?=10)", "0", re.sub(r"\D", "", v.replace("공일공", "010").replace("영일공", "010")))
    if kind == ID:
        return re.sub(r"[^0-9A-Za-z]", "", v).upper()
    return re.sub(r"\s+", "" if re.search(r"[가-힣一-鿿]", v) and kind == NAME else " ", v).casefold()


# -- surrogates -------------------------------------------------------------------------------------

SURNAMES = "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 전 홍 고 문 양 손 배 백 허 유 남 심 노 하 곽 성 차 주 우 구 민".split()
GIVEN = {"m": "준 현 훈 석 철 혁 건 태 욱 규 범 식".split(), "f": "희 숙 미 은 영 연 아 나 경 혜 솔 별".split(), "n": "서 지 민 도 하 윤 진 수 유 재 승 우 해 가 온 빈 찬 소 다 주 세 채 노 라 이 한 은 담 결 율".split()}
#: Endings of given names that show a gender; a surrogate keeps to the list its name ends in.
SHOWN = {"f": "子美奈香恵花莉娜婷芳", "m": "郎男夫雄太介刚强伟勇"}
HIRAGANA, KATAKANA = "あいうえおかきくけこさしすせそたちつてとなにのはひふみもやゆよらりれわ", "アイウエオカキクケコサシスセソタチツテトナニノハヒフミモヤユヨラリレワ"
#: Consonants and vowel signs (none is one too) of scripts that write syllables.
SYLLABLES = {("\u0e00", "\u0e7f"): ("กขคงจชดตทนบปพมยรลวสห", "าีู"), ("\u0900", "\u097f"): ("कखगचजडतदनपबमयरलवसह", ("", "ा", "ी", "ु", "े", "ो"))}
#: Letters of names in scripts with upper and lower case.
ALPHABETS = {("\u0400", "\u04ff"): "абвгдезиклмнопрстуфхя", ("\u0370", "\u03ff"): "αβγδεζηθικλμνοπρστυφχψω"}
#: What stands behind the parts of an address in Chinese characters.
MARKS = "丁目|番地|号室|大道|单元|都|道|府|県|市|区|町|村|番|号|省|县|路|街|巷|栋|幢|座|室|楼|の"
KANJI = "山川田中村木林森石井上下高橋松竹梅原野岡島崎浜谷口池沢青赤白金水光明和正清春秋冬美雪花月"
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprstvz"
PLACES = "가람 나래 다솜 라온 마루 바다 사랑 아라 자람 차오 하람 누리 미르 보람 새론 이든 초롱 푸름 한울 해든".split()


class Draw:
    """Endless keyed choices for an entity in a round."""

    def __init__(self, key: bytes, kind: str, name: str, turn: int):
        self.seed, self.n = hmac.new(key, f"{kind}\0{name}\0{turn}".encode(), hashlib.sha256).digest(), 0
        self.pool: list[int] = []

    def below(self, n: int) -> int:
        if not self.pool:
            self.pool = list(int.from_bytes(hashlib.sha256(self.seed + bytes([self.n % 256])).digest()[i : i + 4], "big") for i in range(0, 32, 4))
            self.n += 1
        return self.pool.pop() % n

    def of(self, items):  # noqa: ANN001, ANN201
        return items[self.below(len(items))]

    def word(self, n: int) -> str:
        return "".join(self.of(CONSONANTS if i % 2 == 0 else VOWELS) for i in range(max(2, n)))


def gender(value: str) -> str:
    """m, f, or n where the form of a Korean given name does not show it."""
    last = value[-1:]
    return "m" if last in GIVEN["m"] else "f" if last in GIVEN["f"] else "n"


def _birth(d: Draw, digits: str) -> str:
    """A date in the place of one, years of two or four digits."""
    year = f"{d.below(60) + 40:02d}" if len(digits) == 6 else str(1950 + d.below(55))
    return f"{year}{d.below(12) + 1:02d}{d.below(28) + 1:02d}"


def _foreign(d: Draw, v: str, turn: int) -> str:
    """A name in a script without a table of names: syllables of the script, or letters of its block."""
    for (low, high), (consonants, vowels) in SYLLABLES.items():
        if any(low <= c <= high for c in v):
            word = lambda m: "".join(d.of(consonants) + d.of(vowels) for _ in range(max(2, len(m[0]) // 2 + turn // 3)))
            return re.sub(r"\S+", word, v)
    out = []
    for c in v:
        block = ord(c) & ~0x7F
        same = [x.upper() if c.isupper() else x for (low, high), letters in ALPHABETS.items() if low <= c <= high for x in letters]
        same = same or [x for x in map(chr, range(block, block + 128)) if unicodedata.category(x) == unicodedata.category(c)]
        out.append(d.of(same) if unicodedata.category(c).startswith("L") and same else c)
    return "".join(out) + (d.of([x for x in out if x.isalpha()] or ["x"]) * (turn // 3))


def _chinese(d: Draw, v: str, turn: int) -> str:
    """A name in Chinese characters and kana, each replaced within its script."""
    sets = lambda c: next((s for s in SHOWN.values() if c in s and c == v[-1] and len(v) > 1), HIRAGANA if "ぁ" <= c <= "ん" else KATAKANA if "ァ" <= c <= "ヶ" else KANJI)
    made = "".join(c if c.isspace() or c == "ー" else d.of(sets(c)) for c in v)
    return made[:-1] + "".join(d.of(KANJI) for _ in range(turn // 3)) + made[-1:]


def _latin(d: Draw, v: str, turn: int) -> str:
    """A name in Latin letters; a first name that ends in a keeps the ending, others end in a consonant."""
    initials = re.sub(r"\b[A-Z]\.", lambda _: d.of("ABCDEFGHJKLMNPRSTW") + ".", v)
    first = re.search(r"[^\W\d_]{2,}", v)

    def word(m: re.Match) -> str:
        made = d.word(len(m[0]) + turn)
        if first and m.start() == first.start():
            made = made[:-1] + ("a" if m[0].endswith("a") else d.of(CONSONANTS))
        return made.capitalize()

    return re.sub(r"[^\W\d_]{2,}", word, initials)


def _address(d: Draw, v: str, turn: int) -> str:
    """An address whose numbers and names are others; what marks its parts stays."""
    numbers = re.sub(r"\d", lambda _: str(d.below(9) + 1), v)
    if re.search(r"[가-힣]", v):
        place = lambda m: d.of(PLACES) + (d.of(PLACES) if turn else "") + m[1]
        return re.sub(r"[가-힣]+?(특별자치시|특별자치도|특별시|광역시|시|군|구|읍|면|리|대로|로|길)(?=\s)", place, numbers)
    if re.search(r"[一-鿿]", v):
        part = lambda x: x if re.fullmatch(MARKS, x) else "".join(d.of(KANJI) for _ in range(len(x) + (turn // 3 if x else 0)))
        return re.sub(r"[一-鿿々ぁ-んァ-ヶー]+", lambda m: "".join(map(part, re.split(f"({MARKS})", m[0]))), numbers)
    kept = rf"(?!(?:{_STREET}|Flat|Apt|Apartment|Unit|Suite|Floor|App|Whg|Am|An|Im|Zum|Zur|rue|avenue)\b)"
    return re.sub(rf"{kept}\b[A-ZÀ-Þ][\w'’-]+?(?=(?:weg|straße|strasse|str\.|platz|allee|gasse|ring|damm|ufer|steig|pfad)?\b)(?!\w*\d)", lambda m: d.word(len(m[0]) + turn).capitalize(), numbers)


def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """A replacement of the same type, script and format. Later turns draw from larger spaces."""
    v = value.translate(_WIDE)
    d = Draw(key, kind, canonical(kind, value), turn)
    if kind == EMAIL:
        local = re.match(r"[A-Za-z0-9._%+-]+", v).group(0)
        rest = v[len(local) :]
        made = re.sub(r"[A-Za-z]+", lambda m: d.word(len(m.group(0)) + turn), re.sub(r"\d", lambda _: str(d.below(10)), local))
        first = re.match(r"\s?(?:@|[\[(]\s?(?:at|골뱅이)\s?[\])])\s?", rest).end()
        return made + rest[:first] + "example" + (" [dot] " if re.search(r"[\[(]\s?dot", rest) else ".") + d.of(["com", "net", "org"])
    if kind in (PHONE, ID):
        digits = sum(c.isdigit() for c in v)
        keep = re.match(r"\+\d{1,3}[-. ]?(?:10)?|\(?0\d{1,2}\)?|공일공|영일공|", v).end() if kind == PHONE else 0
        out = [c if i < keep or not c.isalnum() else str(d.below(10)) if c.isdigit() else d.of("ABCDEFGHJKLMNPRSTUVWXYZ") if c.isupper() and digits else c for i, c in enumerate(v)]
        made = "".join(out)
        if kind == ID and (m := re.fullmatch(r"(\d{6})([- ]?\d)(\d{6})", v)):
            # Birth date and the digit that tells gender and century.
            return _birth(d, m[1]) + m[2] + made[m.end(2) :]
        if kind == ID and re.fullmatch(r"\d{17}[\dXx]", v):
            # The last but one digit is odd for men.
            return made[:6] + _birth(d, v[6:14]) + made[14:16] + str(d.below(5) * 2 + int(v[16]) % 2) + made[17:]
        return made
    if kind == NAME:
        if re.search(r"[가-힣]", v):
            given = v.replace(" ", "")[1:]
            g = gender(given)
            made = "".join(d.of(GIVEN["n"]) for _ in range(max(1, len(given)) - 1 + turn // 3)) + d.of(GIVEN[g])
            return d.of(SURNAMES) + (" " if " " in v else "") + made
        return _chinese(d, v, turn) if re.search(r"[一-鿿ぁ-ヶ]", v) else _latin(d, v, turn) if re.search(r"[A-Za-z]", v) else _foreign(d, v, turn)
    return _address(d, v, turn)


def found(df: DataFrame, is_json: bool = False) -> DataFrame:
    """``field, rec_id, kind, pii_text`` of a table ``field, rec_id, text``."""
    return spread(df, ["field", "rec_id"], "kind string, pii_text string", lambda t: entities(t, is_json))


def vault(entity: DataFrame, key: bytes, rounds: int = 12) -> DataFrame:
    """``kind, name, surrogate`` for every distinct entity ``kind, name, value``: no two share one.

    Draws of a round that collide are so few that each round is far smaller than the one before; the last
    round appends the entity's own digest, which settles all that are left.
    """

    def draw(turn: int):  # noqa: ANN202
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                made = [surrogate(k, v, key, turn) for k, v in zip(pdf["kind"], pdf["value"])]
                if turn == rounds:
                    made = [f"{s} {hmac.new(key, n.encode(), hashlib.sha256).hexdigest()[:16]}" for s, n in zip(made, pdf["name"])]
                pdf["surrogate"], pdf["plain"] = made, [canonical(k, s) for k, s in zip(pdf["kind"], made)]
                yield pdf

        return run

    # One spelling stands for an entity, whatever order the rows come in.
    pending = cut(entity.groupBy("kind", "name").agg(F.min("value").alias("value")), "entities")
    real = pending.select("kind", F.col("name").alias("plain"))
    done: DataFrame | None = None
    for turn in range(rounds + 1):
        drawn = pending.mapInPandas(draw(turn), "kind string, name string, value string, surrogate string, plain string")
        free = drawn.join(real, ["kind", "plain"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "plain"), ["kind", "plain"], "left_anti")
        winners = cut(free.groupBy("kind", "plain").agg(F.min(F.struct("name", "surrogate")).alias("w")).select("kind", "plain", "w.name", "w.surrogate"), "surrogates")
        done = winners if done is None else done.unionByName(winners)
        pending = cut(pending.join(winners.select("kind", "name"), ["kind", "name"], "left_anti"), "pending")
        if pending.isEmpty():
            break
    return done.select("kind", "name", "surrogate")


def _cut_out(text: str | None, is_json: bool, given: dict[tuple[str, str], str]) -> str | None:
    if not text:
        return text

    def one(s: str) -> str:
        for a, b, kind in reversed(_find(s)):
            s = s[:a] + f"[{kind}: {given[kind, s[a:b]]}]" + s[b:]
        return s

    def walk(v: object) -> object:
        return one(v) if isinstance(v, str) else {k: walk(x) for k, x in v.items()} if isinstance(v, dict) else [walk(x) for x in v] if isinstance(v, list) else v

    if is_json:
        try:
            return json.dumps(walk(json.loads(text)), ensure_ascii=False)
        except ValueError:
            pass
    return one(text)


def masked(df: DataFrame, key: bytes, is_json: bool = False) -> DataFrame:
    """``field, rec_id, text`` with every entity replaced by ``[kind: surrogate]``; JSON stays JSON."""
    return masked_together([(df, is_json)], key)[0]


def masked_together(tables: list[tuple[DataFrame, bool]], key: bytes) -> list[DataFrame]:
    """:func:`masked` of several tables ``(table, is_json)`` under one vault: an entity has the same surrogate in all
    of them, and no surrogate is an entity of any."""
    hits = [cut(_named(df, is_json), "pii") for df, is_json in tables]
    given = vault(_values(hits), key)
    return [_replaced(df, is_json, h, given) for (df, is_json), h in zip(tables, hits)]


def _named(df: DataFrame, is_json: bool) -> DataFrame:
    """:func:`found` with ``name``, what makes two spellings one entity."""
    return spread(df, ["field", "rec_id"], "kind string, pii_text string, name string", lambda t: [(k, v, canonical(k, v)) for k, v in entities(t, is_json)])


def _values(hits: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [h.select("kind", "name", F.col("pii_text").alias("value")) for h in hits])


def collisions(tables: list[tuple[DataFrame, bool]], key: bytes) -> DataFrame:
    """One row: surrogates that several entities share, surrogates that are entities themselves, entities without one and
    entities with several. All must be 0."""
    values = cut(_values([_named(df, is_json) for df, is_json in tables]), "pii")
    real = values.select("kind", "name").distinct()
    given = cut(vault(values, key), "given")
    plain = given.mapInPandas(_plain, "kind string, plain string")
    shared = plain.groupBy("kind", "plain").count().agg(F.count_if(F.col("count") > 1).alias("shared"))
    taken = plain.join(real.withColumnRenamed("name", "plain"), ["kind", "plain"], "left_semi").agg(F.count("*").alias("real"))
    each = real.join(given.groupBy("kind", "name").agg(F.count("*").alias("n")), ["kind", "name"], "left").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") > 1).alias("several"))
    # One row each.
    return shared.crossJoin(F.broadcast(taken)).crossJoin(F.broadcast(each))


def _plain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        yield pd.DataFrame({"kind": pdf["kind"], "plain": [canonical(k, s) for k, s in zip(pdf["kind"], pdf["surrogate"])]})


def _replaced(df: DataFrame, is_json: bool, hits: DataFrame, given: DataFrame) -> DataFrame:
    own = hits.join(given, ["kind", "name"]).groupBy("field", "rec_id").agg(F.collect_list(F.struct("kind", "pii_text", "surrogate")).alias("given"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["text"] = [_cut_out(t, is_json, {(g["kind"], g["pii_text"]): g["surrogate"] for g in (gs if gs is not None else [])}) for t, gs in zip(pdf["text"], pdf["given"])]
            yield pdf.drop(columns="given")

    rec = df.schema["rec_id"].dataType.simpleString()
    return df.join(own, ["field", "rec_id"], "left").select("field", "rec_id", "text", "given").mapInPandas(run, f"field string, rec_id {rec}, text string")
