"""Abusive, hateful or sexual content (problem 10).

A linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios. It
scores sentences; a document's score is that of its worst sentence, so one insult in a long report counts
as much as one alone, and quoting, reporting or being cross with a thing stays what its sentence is.

The log-count ratios set the n-grams of positive sentences against those of all documents. Labels are of
documents and noisy, so training is in rounds: first the sentence of a document labelled positive that
stands out most is taken for positive, afterwards those the model of the round before calls so, or the one
nearest to it. A positive document without any sentence that stands out (``LIFT``) is taken for mislabelled,
and a document labelled harmless that the model contradicts sits the next round out. Beside an insult stand harmless
sentences, so a sentence is blamed for a label only where nothing worse stands, and what many harmless or unlabelled
documents hold too is cleared, or one wrong label would flag every document with that sentence. A few sentences written
for this module (``SEEDS``) start rare languages off. At most ``LABELLED`` labelled rows are fitted; the counts and the
scores cover every document whole.

Defined results: null, empty and blank texts score 0; labels are read without case, missing and unknown
ones ignored, contradicting ones decided by majority, ties ignored; without any usable label the seeds
alone are fitted.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.sentences import units
from tessera.llm.texts import evenly
from tessera.session import cut

BITS = 18
ORDERS = (3, 4, 5, 6)
#: Characters of a stretch.
WINDOW = 40
#: Features added to every count of them, so that a few rare ones do not decide.
SHORT = 20
#: At most this many labelled documents are fitted, drawn by a hash of their id.
LABELLED = 12_000
POSITIVE = ("abuse", "hate", "sexual")
ROUNDS = 4
THRESHOLD = 0.55
#: Mean log-count ratio below which a sentence is common speech, whatever a document's label says.
LIFT = 0.45
#: Least score at which the next round takes a sentence of a positive document for positive.
PICK = 0.5
#: Least share of the documents with a sentence that blame it, of the share that is usual among the blamed ones.
SHARE = 0.2
#: Weight of a harmless sentence without any n-gram, for each harmless one: what says next to nothing is harmless.
NOTHING = 0.01
#: What is taken off a positive document's counts of its own n-grams, where so large a share of those with a sentence that
#: stands out still have one.
OWN, ENOUGH = 0.5, 0.9

#: Sentences with a label, written for this module: 1 aims at somebody, 0 speaks about it or is harmless.
SEEDS: tuple[tuple[int, str], ...] = (
    (1, "You are such a moron, get lost."), (1, "Shut your mouth, you worthless idiot."), (1, "I will beat you up if you say that again."), (1, "What a stupid piece of shit you are."), (1, "You disgust me, go to hell."), (1, "Nobody would miss you if you died."),
    (1, "People from that country are all filthy thieves."), (1, "Women are too dumb for this job."), (1, "We should throw all those foreigners out like vermin."), (1, "Send me nude pictures of you."), (1, "I want to undress you tonight."), (1, "Your ass looks hot, sleep with me."),
    (1, "너는 진짜 바보 천치야, 당장 꺼져."), (1, "닥쳐 이 병신 새끼야."), (1, "또 그러면 때려 버린다, 각오해."), (1, "네 얼굴만 봐도 역겨워, 죽어 버려."), (1, "그 지역 출신들은 전부 도둑놈에 쓰레기야."), (1, "여자는 멍청해서 일을 맡기면 안 된다."), (1, "외국인들은 벌레니까 다 쫓아내라."), (1, "야한 사진 좀 보내 봐."), (1, "너랑 자고 싶다, 오늘 밤 옷 벗고 와."), (1, "가슴 크다, 한번 만져 보자."),
    (1, "お前は本当に馬鹿だな、消えろ。"), (1, "黙れ、このクズ野郎。"), (1, "今度やったら殺すぞ。"), (1, "あの国の連中はみんな泥棒で汚い。"), (1, "女は頭が悪いから無理だ。"), (1, "裸の写真を送れよ。"), (1, "今夜お前とやりたい。"),
    (1, "你真是个白痴,滚开。"), (1, "闭嘴,你这个废物。"), (1, "再这样我就打死你。"), (1, "那里的人都是肮脏的小偷。"), (1, "女人太蠢,干不了这个。"), (1, "把你的裸照发给我。"), (1, "今晚想脱光你的衣服。"),
    (1, "Du bist so ein Vollidiot, hau ab."), (1, "Halt die Fresse, du Stück Scheiße."), (1, "Ich schlage dich zusammen, wenn du das noch mal machst."), (1, "Die Ausländer sind alle dreckiges Ungeziefer."), (1, "Frauen sind zu dumm für diese Arbeit."), (1, "Schick mir Nacktfotos von dir."), (1, "Ich will dich heute Nacht ausziehen."),
    (1, "Tu es un vrai connard, dégage."), (1, "Ferme ta gueule, espèce d'idiot."), (1, "Je vais te casser la figure."), (1, "Ces gens sont tous de la vermine et des voleurs."), (1, "Les femmes sont trop bêtes pour ce poste."), (1, "Envoie-moi des photos de toi nue."), (1, "J'ai envie de coucher avec toi."),
    (1, "แกมันโง่ ไปตายซะ"), (1, "หุบปาก ไอ้ขยะ"), (1, "พวกนั้นสกปรกและขี้ขโมยทุกคน"), (1, "ส่งรูปเปลือยมาให้ฉัน"), (1, "तू बेवकूफ़ है, दफ़ा हो जा।"), (1, "चुप कर कमीने।"), (1, "वे सब लोग गंदे और चोर हैं।"), (1, "मुझे अपनी नंगी तस्वीर भेज।"),
    (0, "Insulting or threatening colleagues is forbidden."), (0, "She reported that someone had called her an idiot."), (0, "Please report hateful posts with the button below."), (0, "This stupid printer is broken again."), (0, "What a shitty form, it never loads."), (0, "The training covers sexual harassment and hate speech."), (0, "The system is dead slow today."), (0, "I hate this new menu."), (0, "The word 'moron' is blocked by the filter."),
    (0, "욕설이나 협박은 금지되어 있습니다."), (0, "누가 저에게 바보라고 했다고 신고했습니다."), (0, "혐오 표현을 보면 신고해 주세요."), (0, "이 프린터 진짜 쓰레기네, 또 고장이야."), (0, "시스템이 미쳤나 왜 이렇게 느려."), (0, "성희롱 예방 교육을 들으세요."), (0, "'병신'이라는 말은 필터에 걸립니다."), (0, "야근이 너무 싫다."),
    (0, "暴言や脅しは禁止されています。"), (0, "「馬鹿」と言われたと相談がありました。"), (0, "このプリンターは本当にくそだ。"), (0, "ハラスメント研修を受けてください。"), (0, "禁止辱骂和威胁同事。"), (0, "他举报有人骂他白痴。"), (0, "这破打印机又坏了。"), (0, "请参加防止性骚扰培训。"),
    (0, "Beleidigungen und Drohungen sind verboten."), (0, "Jemand hat sie Idiot genannt, steht im Bericht."), (0, "Dieser blöde Drucker ist schon wieder kaputt."), (0, "Les insultes et les menaces sont interdites."), (0, "On l'a traité de connard, dit le rapport."), (0, "Cette imprimante est vraiment nulle."), (0, "ห้ามด่าหรือขู่เพื่อนร่วมงาน"), (0, "เครื่องพิมพ์นี้แย่มาก"), (0, "गाली देना मना है।"), (0, "यह प्रिंटर बेकार है।"),
)

_HIDDEN = re.compile(r"[​-‏⁠﻿­]")
_BETWEEN = re.compile(r"(?<=[^\W\d_])[\d_.*~^·-]{1,2}(?=[^\W\d_])")
#: Letters one by one between blanks, and signs that stand for a Latin letter inside a word.
_SPACED = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\w)")
_STANDS = re.compile(r"(?<=[a-z])[0134578@$!]+(?=[a-z])")
_LETTER = str.maketrans("0134578@$!", "oieastbasi")
_INSERTED = re.compile(r"(?<=[^\W\d_])[@$!]{1,2}(?=[^\W\d_])")
_NUMBER = re.compile(r"\d+")
_LINE = re.compile(r"[\n\r\u2028\u2029]+")
#: A letter, or any sign beyond ASCII that is no blank.
_SAID = re.compile(rf"[A-Za-z]|(?=\S)(?!{_HIDDEN.pattern})[^\x00-\x7f]")
_LONG = re.compile(r"(.)\1{2,}")


def plain(sentence: str) -> str:
    """A sentence as the features see it: NFKC, lower case, what hides a word's letters taken out, numbers alike."""
    return readings(sentence)[0]


def readings(sentence: str) -> list[str]:
    """:func:`plain`, and where letters stand apart or signs may stand for letters or hide them, the sentence read so too."""
    s = " ".join(_HIDDEN.sub("", unicodedata.normalize("NFKC", sentence)).lower().split())
    joined = _SPACED.sub(lambda m: m[0].replace(" ", ""), s)
    ways = dict.fromkeys((s, _STANDS.sub(lambda m: m[0].translate(_LETTER), joined), _INSERTED.sub("", joined)))
    return list(dict.fromkeys(_LONG.sub(r"\1\1", _NUMBER.sub("0", _BETWEEN.sub("", x))) for x in ways))


@lru_cache(maxsize=20_000)
def features(s: str) -> np.ndarray:
    """Distinct hashed character n-grams of a plain sentence."""
    codes = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found, h = [], codes
    for n in range(2, max(ORDERS) + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in ORDERS:
            found.append((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS))
    return np.unique(np.concatenate(found)).astype(np.int32) if found else np.zeros(0, np.int32)


def _windows(s: str) -> list[str]:
    """A long run of words (chat has no full stops) as overlapping stretches of words, all of it covered."""
    if len(s) <= WINDOW * 5 // 4:
        return [s]
    words = s.split(" ")
    if len(words) < 4:
        return [s[i : i + WINDOW] for i in range(0, max(1, len(s) - WINDOW // 2), WINDOW // 2)]
    out, a, size, b = [], 0, 0, 0
    while b < len(words):
        size += len(words[b]) + 1
        b += 1
        if size >= WINDOW:
            out.append(" ".join(words[a:b]))
            while size > WINDOW // 2 and a < b:
                size -= len(words[a]) + 1
                a += 1
    if a < b:
        out.append(" ".join(words[a:b]))
    return out


def _left_out(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """What no span covers, line by line, with the rest of a word that a span cuts; marks and digits alone say nothing."""
    out, at = [], 0
    for a, b in [*spans, (len(text), len(text))]:
        if _SAID.search(text, at, a):
            first, last = at, a
            while first > max(0, at - WINDOW) and not text[first - 1].isspace():
                first -= 1
            while last < min(len(text), a + WINDOW) and not text[last].isspace():
                last += 1
            out += [s for s in _LINE.split(text[first:last]) if _SAID.search(s)]
        at = max(at, b)
    return out


def pieces(text: str | None) -> list[str]:
    """Plain sentences of a text and whatever stands outside of sentences (tables, code, formulas, comments, all behind
    an unclosed tag), long ones in overlapping stretches; a text without either is one."""
    if not text or not text.strip():
        return []
    spans = units(text)
    found = [r for s in [text[a:b] for a, b in spans] + _left_out(text, spans) or [text] for r in readings(s)]
    return list(dict.fromkeys(w for s in found if s for w in _windows(s)))


class Model:
    """Weights over hashed n-grams and an intercept."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence(self, s: str) -> float:
        f = features(s)
        return float(1 / (1 + np.exp(-(self.weights[f].sum() / np.sqrt(len(f) + SHORT) + self.bias)))) if len(f) else 0.0

    def text(self, text: str | None) -> float:
        return max((self.sentence(s) for s in pieces(text)), default=0.0)


def _ratios(positive: list[list[str]], background: np.ndarray, documents: float, own: float = 0.0) -> np.ndarray:
    """Log of how much more often an n-gram occurs in positive documents (given by those sentences of theirs that
    count) than in all documents, both smoothed by one: what was seen once, such as a part of a name, hardly counts. ``own``
    is taken off every positive count: what a document adds to the counts of its own n-grams."""
    p, total = np.zeros(1 << BITS), len(positive)
    for d in positive:
        p[np.unique(np.concatenate([features(s) for s in d]))] += 1
    return np.log((np.maximum(p - own, 0) + 1) / (background * (total / max(documents, 1.0)) + 1)).astype(np.float32)


def _fit(chosen: list[tuple[str, int, float]], ratio: np.ndarray, steps: int, pull: float = 1e-6) -> Model:
    """Logistic regression on n-grams scaled by ``ratio``; weights are pulled towards 1, classes weigh alike."""
    rows = [features(s) for s, *_ in chosen]
    y = np.array([c for _, c, _ in chosen], float)
    weight = np.array([w for *_, w in chosen])
    lengths = np.array([len(r) for r in rows])
    index = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), lengths)
    used, index = np.unique(index, return_inverse=True)
    scale = ratio[used][index] / np.sqrt(lengths + SHORT)[of]
    balance = weight * np.where(y > 0, 0.5 / max((weight * y).sum(), 1e-9), 0.5 / max((weight * (1 - y)).sum(), 1e-9))
    w, b = np.full(len(used), 1.0), -2.0
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(of, w[index] * scale, len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        gw, gb = np.bincount(index, g[of] * scale, len(w)) + pull * (w - 1), g.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.04 * (mw / c1) / (np.sqrt(vw / c2) + 1e-6)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    weights = ratio.copy()
    weights[used] *= w
    return Model(weights, float(b))


def _blame(accused: list[list[str]], innocent: Counter, able: dict[str, float], worse: Callable[[str], tuple]) -> tuple[Counter, list[list[str]]]:
    """In how many documents labelled positive each sentence is the worst, and what of each may be positive. A sentence
    is blamed only where none stands that is worse, and cleared if it stands in as many harmless documents, or in too
    many documents at all; then the next worst is blamed."""
    own, usual = [[s for s in dict.fromkeys(d) if s in able] for d in accused], 0.0

    def harmless(s: str, n: int) -> bool:
        return innocent[s] >= n or n / able[s] < usual * SHARE

    while True:
        worst = [max(d, key=worse) for d in own if d]
        blame = Counter(worst)
        usual = float(np.median([blame[s] / able[s] for s in worst])) if worst else 0.0
        clear = {s for s, n in blame.items() if harmless(s, n)}
        if not clear:
            return blame, [[s for s in d if not harmless(s, blame[s] or 1)] for d in own]
        own = [[s for s in d if s not in clear] for d in own]


def train(labelled: list[tuple[list[str], int]], background: np.ndarray, documents: float) -> Model:
    """A model of labelled documents (their pieces, 1 or 0), given how many of all ``documents`` hold each n-gram."""
    docs = [(d, y) for d, y in labelled if d]
    seeds = [(plain(s), y) for y, s in SEEDS]
    start = [[s] for s, y in seeds if y]
    guilty, innocent = (Counter(s for d, y in docs if y == side for s in set(d)) for side in (1, 0))
    ratio = _ratios([d for d, y in docs if y] + start, background, documents)
    others = _ratios([d for d, y in docs if y] + start, background, documents, OWN)
    mean, shared = ({s: float(r[features(s)].mean()) for s in guilty} for r in (ratio, others))
    raw = {s: m * np.sqrt(len(features(s))) for s, m in mean.items()}
    accused = [d for d, y in docs if y]
    # With many labels an insult's wording stands in other documents too, and what stands out by itself is a chance mixture
    # of words in a wrongly labelled one; with few labels nobody else may have said it.
    alone, joint = (sum(any(m[s] >= LIFT for s in d) for d in accused) for m in (mean, shared))
    gate = shared if joint >= ENOUGH * alone else mean
    # At most so many of all documents hold a sentence: as many as hold its rarest n-gram.
    able = {s: max(1.0, float(background[features(s)].min())) for s in guilty if gate[s] >= LIFT}
    model: Model | None = None
    for turn in range(ROUNDS):
        score = {s: model.sentence(s) for s in guilty | innocent} if model else {}
        blame, own = _blame(accused, innocent, able, lambda s: (score.get(s, 0.0), raw[s]))
        # A document labelled positive has a positive sentence: what the model calls so, or else what comes nearest to it.
        positive = [[s for s in d if score.get(s, 0.0) >= PICK] or [max(d, key=lambda s: (score.get(s, 0.0), raw[s]))] for d in own if d]
        # Sentences that several harmless documents hold are harmless, whatever the model says; one alone may be mislabelled.
        sure = {s for s, n in innocent.items() if n >= 2 and n >= blame[s]}
        negative = {s for d, y in docs if not y and max((score.get(s, 0.0) for s in d if s not in sure), default=0.0) < 0.9 for s in d if innocent[s] >= blame[s]} | sure
        for d in accused if model else []:
            # The rest of a document is harmless where the model has found its worst sentence; else only common speech is.
            told = max(score[s] for s in d) >= PICK
            negative |= {s for s in d if (score[s] < 0.1 if told else mean[s] < LIFT / 2)}
        mine = {s for d in positive for s in d}
        negative -= mine
        chosen = [(s, 1, 1.0) for s in mine] + [(s, 0, 1.0 + np.log2(max(1, innocent[s]))) for s in negative] + [(s, y, 1.0) for s, y in seeds] + [("", 0, NOTHING * (1 + len(negative)))]
        model = _fit(chosen, _ratios(positive + start, background, documents), 250 if turn == ROUNDS - 1 else 100)
    return model


def labels(review: DataFrame, id_column: str, category: str) -> DataFrame:
    """``id, y`` of documents with a clear majority of readable labels."""
    c = F.lower(F.trim(category))
    vote = F.when(c.isin(*POSITIVE), 1).when(c == "none", -1)
    return (
        review.select(F.col(id_column).alias("id"), vote.alias("v")).where("id is not null and v is not null")
        .groupBy("id").agg(F.sum("v").alias("v")).where("v <> 0").select("id", (F.col("v") > 0).cast("int").alias("y"))
    )


def split(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, pieces`` of every document, written once: the counts, the training and the scores all read it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["pieces"] = [pieces(t) for t in pdf["text"]]
            yield pdf.drop(columns="text")

    types = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return cut(evenly(docs.select(*keys, F.col(text).alias("text")), *keys).mapInPandas(run, f"{types}, pieces array<string>"), "pieces")


def document_counts(parted: DataFrame, key: str) -> tuple[np.ndarray, int]:
    """How many documents hold each hashed n-gram, and how many documents with any there are. A task adds its documents
    up into one vector of fixed length, so what is shuffled and collected doesn't grow with a partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(1 << BITS, np.int64), 0
        for pdf in parts:
            for found in pdf["pieces"]:
                if len(found):
                    total[np.unique(np.concatenate([features(s) for s in found]))] += 1
                    n += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": np.append(at, -1), "n": np.append(total[at], n)})

    sums = evenly(parted.select(key, "pieces"), key).select("pieces").mapInPandas(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    # 2 ** BITS + 1 rows at most.
    got = sums.toPandas()
    counts = np.zeros(1 << BITS)
    real = got[got["gram"] >= 0]
    counts[real["gram"].to_numpy()] = real["n"].to_numpy()
    return counts, int(got.loc[got["gram"] < 0, "n"].sum())


def fit(parted: DataFrame, review: DataFrame, key: str, category: str, limit: int = LABELLED) -> Model:
    """Train on the labelled documents of a :func:`split` table, at most ``limit`` of them (what the driver holds)."""
    counts, documents = document_counts(parted, key)
    sample = parted.withColumnRenamed(key, "id").join(labels(review, key, category), "id").orderBy(F.xxhash64("id"), "id").limit(limit).select("pieces", "y")
    return train([(list(r.pieces), r.y) for r in sample.collect()], counts, documents)


def score(parted: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """``keys`` and the score of every document of a :func:`split` table."""
    shared = parted.sparkSession.sparkContext.broadcast(model)  # 1 MB whatever the data

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["score"] = [max(map(shared.value.sentence, p), default=0.0) for p in pdf["pieces"]]
            yield pdf.drop(columns="pieces")

    types = ", ".join(f"`{k}` {parted.schema[k].dataType.simpleString()}" for k in keys)
    return evenly(parted.select(*keys, "pieces"), *keys).mapInPandas(run, f"{types}, score double")


def rates(scored: DataFrame, source: str, threshold: float = THRESHOLD) -> DataFrame:
    """Per source: documents, flagged documents and their share; a null source is a source of its own."""
    flag = F.count_if(F.col("score") >= threshold)
    return scored.groupBy(source).agg(F.count("*").alias("documents"), flag.alias("flagged"), (flag / F.count("*")).alias("rate"))
