"""Broken prompt and response pairs.

Each pair gets at most one defect, in this order: ``empty``, ``refusal``, ``copy``, ``wrong_language``,
``truncated``. Languages are the posteriors of a naive Bayes model over hashed character trigrams, fitted on a bounded
sample of labelled documents; quoted labels are left out. An answer is truncated where the likelihood that a text ends
after its last two tokens is low; likelihoods are counted over all documents and all answers. Refusals are told by a
naive Bayes model over word n-grams of sentences, fitted on sentences of the sampled documents and on made ones: every
sentence of the answer is read, and one that describes is enough to make it no refusal.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figloom.llm.overlap import common

#: Labelled documents a language is fitted on, at most.
SAMPLE_PER_LANGUAGE = 300
GRAM_BITS = 15
CHUNK = 1 << 20
#: Nats by which the answer must favour another language, and by which the question must be sure of its own.
ANSWER_NATS, QUESTION_NATS = 12.0, 8.0
#: A text is cut off if fewer than this share of the places after its last tokens are ends of texts.
END_SHARE = 0.02
#: Letters and digits that may stand before the copy of a question.
LEAD_IN = 80
DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")

#: Answers that hold the place of one.
PLACEHOLDERS = frozenset("n/a|na|n.a.|none|null|nil|nan|tbd|todo|tba|empty|undefined|no answer|no output|placeholder|keine|aucun|aucune|k.a.|无|暂无|没有".split("|"))
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？｡؟])|\n+")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」")
_INVISIBLE = re.compile(r"[\s​-‏‪-‮⁠-⁤﻿­\x00-\x1f\x7f-\x9f᠎⠀ㅤ]+")
_CLOSERS = "\"'”’»“)]}）】」』*_`"
_OPENERS = "([{（【「『„"
_ENDS = ".!?。！？؟｡"
#: Abbreviations whose full stop ends no sentence.
_SHORT = frozenset("e.g i.e vs no nos fig figs eq eqs ref refs cf ca approx viz al incl sec tab vol ed eds dr prof mr mrs z.b d.h vgl bzw abb nr bspw p.ex env".split())
_WORD = re.compile(r"[^\W_]+")


def squash(text: str) -> str:
    """Letters and digits only, in lower case."""
    return "".join(_WORD.findall(text.lower()))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _INVISIBLE.sub(" ", answer).strip()
    return not _WORD.search(bare) or bare.strip("\"'“”[](){}<>.* ").lower() in PLACEHOLDERS


def is_copy(question: str, answer: str) -> bool:
    """The question again, once or more, perhaps after a lead-in, perhaps with light changes; what says more is no copy."""
    q = squash(question)
    if len(q) < 4:
        return False
    a = squash(answer)
    lead, *rest = a.split(q)
    if rest:
        ideographs = sum("一" <= c <= "鿿" for c in lead)
        return sum(map(len, rest)) <= max(3, len(q) // 8) and len(lead) <= LEAD_IN and ideographs <= LEAD_IN // 6
    if any("一" <= c <= "鿿" for c in q):
        tq, ta = list(q), list(a)
    else:
        tq, ta = _WORD.findall(question.lower()), _WORD.findall(answer.lower())
    extra = max(1, 0.15 * len(tq)) + (12 if ta[-3:] == tq[-3:] else 0)
    most = sum((Counter(tq) & Counter(ta)).values())  # no alignment has more equal words
    if most < 0.85 * len(tq) or len(ta) - most > extra:
        return False
    same = common(tq, ta)
    return same >= 0.85 * len(tq) and len(ta) - same <= extra


# --- languages -------------------------------------------------------------------------------------------------


def _lower_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another with two line ends between them; where each begins."""
    whole = "\n\n".join([*texts, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _grams(codes: np.ndarray) -> np.ndarray:
    c = codes.astype(np.uint32)
    h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA6B) ^ c[2:] * np.uint32(0xC2B2AE35)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - GRAM_BITS)


def _speech(text: str | None) -> str:
    return _QUOTED.sub(" ", text).lower() if text else ""


@dataclass
class Languages:
    """Naive Bayes over character trigrams; ``weights`` is (2 ** GRAM_BITS, languages) of log probabilities."""

    names: list[str]
    weights: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Languages:
        names = sorted(set(labels))
        counts = np.full((1 << GRAM_BITS, len(names)), 0.5)
        for k, name in enumerate(names):
            own = [_speech(t) for t, x in zip(texts, labels) if x == name]
            codes, _ = _lower_codes(own)
            if len(codes) > 2:
                counts[:, k] += np.bincount(_grams(codes), minlength=1 << GRAM_BITS)
        logs = np.log(counts / counts.sum(0))
        return cls(names, (logs - logs.mean(1, keepdims=True)).astype(np.float32))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Log posterior of each language, up to a constant, under equal priors."""
        out = np.zeros((len(texts), len(self.names)), np.float32)
        said = [_speech(t) for t in texts]
        at = 0
        while at < len(said):
            end, size = at, 0
            while end < len(said) and (size < CHUNK or end == at):
                size += len(said[end]) + 2
                end += 1
            codes, starts = _lower_codes(said[at:end])
            grams = _grams(np.concatenate([codes, np.array([10, 10], np.uint32)]))
            for lo in range(0, len(grams), CHUNK):  # a single text may be longer than a chunk
                part = self.weights[grams[lo : lo + CHUNK]]
                cuts = np.clip(starts[:-1] - lo, 0, len(part))
                own = np.flatnonzero((starts[1:] > lo) & (starts[:-1] < lo + len(part)))
                out[at + own] += np.add.reduceat(part, cuts[own], axis=0)
            at = end
        return out


def language_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of at most ``per_language`` labelled documents each, chosen by a hash of the id."""
    lang = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2})(?:$|[-_])", 1)
    rows = documents.select("doc_id", lang.alias("lang"), "text").where("lang <> '' and length(trim(text)) > 15")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # names of two letters: at most 676
    texts, labels = [], []
    whole = 1 << 20
    chance = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(whole))
    keep = F.lit(False)
    for k, n in counts.items():
        keep = keep | ((F.col("lang") == k) & (chance < int(min(1.0, 1.2 * per_language / n) * whole)))
    for r in sorted(rows.where(keep).select("doc_id", "lang", "text").collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        texts.append(r["text"])
        labels.append(r["lang"])
    return texts, labels


# --- ends of texts ---------------------------------------------------------------------------------------------

_LABEL = "\ue000"
_LABELS = _LABEL + r"(?:\s*(?:[,;/、，]|[,;]?\s(?:and|und|et|y|e|и)\s)\s*" + _LABEL + ")+"
_NUMBER = r"\d(?:[\d.,]*\d)?"
BLANK, LETTERS, IDEOGRAPHS, DIGITS, LABEL = range(5)


def _class_table() -> np.ndarray:
    """Token class of the first 65536 code points; every sign is (nearly) a class of its own."""
    t = np.zeros(1 << 16, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        if 0x3400 <= i <= 0x9FFF or 0x3040 <= i <= 0x30FF or 0xAC00 <= i <= 0xD7A3:
            k = IDEOGRAPHS
        elif c.isspace() or _INVISIBLE.match(c) or 0xD800 <= i < 0xE000:
            k = BLANK
        elif c.isdigit():
            k = DIGITS
        elif c.isalpha():
            k = LETTERS
        else:
            k = LABEL if c == _LABEL else 5 + i % 251
        t[i] = k
    return t


CLASSES = _class_table()
START = int(CLASSES[ord(".")])  # what stands before a text


def plain(texts: pa.Array) -> pa.Array:
    """Texts with quoted labels, and lists of them, as one sign and numbers as one digit."""
    t = pc.replace_substring_regex(texts, r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]|「[^」\n]*」", _LABEL)
    t = pc.replace_substring_regex(t, _LABELS, _LABEL)
    return pc.replace_substring_regex(t, _NUMBER, "0")


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Token classes of all texts one after another, each after two of START; where each text ends."""
    told = plain(pa.array(texts, pa.large_string())).to_pylist()
    codes = np.frombuffer("\n\n".join(["", *told, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    k = CLASSES[np.minimum(codes, 0xFFFF)]
    sizes = np.fromiter(map(len, told), np.int64, len(told)) + 2
    heads = np.concatenate([[0], np.cumsum(sizes)])
    k = k.copy()
    k[heads[:-1]] = k[heads[:-1] + 1] = START  # where the line ends before each text are
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]  # a sign repeated is one token
    new[heads[:-1]] = new[heads[:-1] + 1] = True
    keep = new & (k != BLANK)
    return k[keep], np.cumsum(keep)[heads[1:] - 1]


def end_of(answer: str) -> str:
    """Last line of an answer without what hides its end: closing signs after a full stop, signs that open nothing more,
    commas behind a word, marks of omission, and the full stop of an abbreviation."""
    t = _TAIL.sub("", answer).rsplit("\n", 1)[-1]
    bare = t.rstrip(_CLOSERS + " ")
    if bare and bare[-1] in _ENDS:
        t = bare
    t = t.rstrip(_OPENERS + " ")
    if t.endswith("«") and t.count("«") > t.count("»"):
        t = t[:-1].rstrip()
    cut = t.rstrip(",;，、；")
    if cut and cut[-1] not in _CLOSERS:
        t = cut
    if t.endswith(("…", "..")):
        t = t.rstrip("….").rstrip()
    elif t.endswith("."):
        word = re.split(r"[\s(]", t[:-1].rstrip())[-1]
        if word.lower() in _SHORT and len(word) + 1 < len(t):
            t = t[:-1]
    return t


_TAIL = re.compile(_INVISIBLE.pattern + r"\Z")


def contexts(answers: list[str]) -> np.ndarray:
    """Class of the last two tokens of each answer."""
    k, ends = tokens([end_of(a) for a in answers])
    return k[ends - 2].astype(np.int64) << 8 | k[ends - 1]


def _count_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for b in batches:
        texts = [t for t in b["text"] if t]
        if texts:
            k, ends = tokens(texts)
            pairs = k[:-1].astype(np.int64) << 8 | k[1:]
            every += np.bincount(pairs, minlength=1 << 16)
            last += np.bincount(contexts(texts), minlength=1 << 16)
    ctx = np.flatnonzero(every + last)
    yield pd.DataFrame({"ctx": ctx, "n": every[ctx], "ends": last[ctx]})


def end_shares(texts: DataFrame) -> np.ndarray:
    """Share of the places after each pair of tokens that are the end of a text, over all of column ``text``; rare pairs
    lean on the share of their last token."""
    counted = texts.select("text").where("length(trim(text)) > 2").mapInPandas(_count_ends, "ctx long, n long, ends long")
    n, ends = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in counted.groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).collect():  # at most 2 ** 16 rows
        n[r["ctx"]], ends[r["ctx"]] = r["n"], r["ends"]
    alone_n, alone = n.reshape(256, 256).sum(0), ends.reshape(256, 256).sum(0)
    prior = np.tile(alone / (alone_n + 20.0), 256)
    return ((ends + 20.0 * prior) / (n + 20.0)).astype(np.float32)


# --- refusals --------------------------------------------------------------------------------------------------

KINDS = ("describes", "declines", "aside")
REFUSAL_BITS = 16
#: Sentences of the sampled documents that stand for description, at most; nats by which a sentence must be none.
SAMPLE_SENTENCES, TALK_NATS = 6000, 2.0

#: Parts of made sentences by language: who, does not, does, what; then sentences that are whole.
_DECLINES = (
    (
        "I|We|Unfortunately I|I am sorry but I|Sorry, I|As an AI I|As a language model, I|I regret that I|I fear I|The assistant|The model",
        "cannot|can't|can not|could not|won't|will not|am unable to|am not able to|must decline to|have to decline to|refuse to|decline to|do not know how to|don't know how to|may not|am not allowed to|must refrain from|declines to|have no way to",
        "describe|answer|help with|assist with|comply with|provide|write|generate|produce|create|discuss|fulfil|complete|do|respond to",
        "this image|that|this request|your request|the question|the prompt|this picture|it|the text|the content|a description|this topic|such material",
        "Request denied.|The request was refused.|Your request has been rejected.|This prompt is declined.|Unable to comply.|Cannot help.|Not able to assist.|It is not possible for me to answer.|It is impossible for the model to write that.|No answer can be provided by the assistant.|No text can be given.|That is beyond what I am allowed to do.|This lies outside my abilities.|That goes against my rules.|This would violate my guidelines and policies.|I must refuse.|I have to pass on this one.|I decline.|Access to this is restricted.|Sorry.|My apologies.|I apologise.",
    ),
    ("That is declined|I cannot do that|This is refused|I must stop here", "because|since|as", "the image|the picture|the file|no image|the figure|a scan", "was not attached|is missing|was not sent|is not available to me|cannot be opened|was not given", ""),
    ("It is not possible for|It is impossible for|It is not permitted for", "me to|us to|the assistant to|this model to", "describe|answer|write|provide|produce|create|draft|do", "this image|that|the requested text|the question|the content|it", ""),
    ("This request|Your request|That prompt|This", "goes against|violates|breaks|conflicts with", "my|our|the", "guidelines|rules|policies|principles", ""),
    ("No", "answer|text|description|content|reply", "can be|could be|will be|may be", "given by me|provided|written here|produced by the assistant", ""),
    (
        "Ich|Wir|Leider|Es tut mir leid, ich|Als Sprachmodell|Tut mir leid, das", "kann ich|darf ich|kann|darf|können wir|möchte ich", "nicht|leider nicht|nicht mehr", "beschreiben|beantworten|helfen|antworten|erstellen|schreiben|bearbeiten|liefern",
        "Diese Anfrage wurde abgelehnt.|Das ist mir nicht möglich.|Ich muss ablehnen.|Es tut mir leid.|Darauf kann ich keine Antwort geben.|Dieses Bild kann ich nicht beschreiben.|Ich bin nicht in der Lage, das zu tun.|Das verstößt gegen meine Richtlinien.",
    ),
    (
        "Je|Désolé, je|Malheureusement, je|Je suis désolée, mais je|Nous", "ne peux pas|ne suis pas en mesure de|ne suis pas capable de|refuse de|ne saurais|ne pouvons pas", "décrire|répondre à|aider avec|fournir|rédiger|traiter|produire", "cette image|cette question|cette demande|cela|ce texte|une description",
        "Demande refusée.|Je dois refuser.|Je suis désolé.|Cela m'est impossible.|Il ne m'est pas possible de répondre.|Cela va à l'encontre de mes règles.",
    ),
    ("Lo siento, no|No|Lamentablemente no|Como modelo, no", "puedo|me es posible|podemos|debo", "describir|responder|ayudar|escribir|proporcionar|crear", "esta imagen|a esta solicitud|con eso|esta pregunta|el texto", "Solicitud rechazada.|Lo siento.|No me está permitido.|Debo negarme."),
    ("Desculpe, não|Não|Infelizmente não|Lamento, mas não", "posso|consigo|podemos|me é possível", "descrever|responder|ajudar|escrever|fornecer|criar", "esta imagem|a este pedido|com isso|esta pergunta|o texto", "Pedido recusado.|Lamento.|Desculpe.|Tenho de recusar."),
    ("Я|Извините, я|К сожалению, я|Как модель, я", "не могу|не в состоянии|не имею права|отказываюсь", "описать|ответить на|помочь с|написать|выполнить|предоставить", "это изображение|этот запрос|этот вопрос|этим|этот текст", "Запрос отклонён.|Извините.|К сожалению, это невозможно.|Мне это не разрешено."),
    ("我|抱歉，我|对不起，我|很遗憾，我|作为语言模型，我", "无法|不能|没法|不可以|拒绝", "描述|回答|提供|处理|完成|协助|生成|编写", "这张图片|这个请求|该问题|这个要求|此内容|这段文字", "请求被拒绝。|抱歉。|对不起。|这违反了规定。|我没有办法回答。"),
)
#: Made sentences around a refusal.
_ASIDES = (
    "Please provide the image.|Please send more details.|Please attach the file and try again.|Could you rephrase the question?|Can you clarify your request?|Would you like me to do something else instead?|Let me know if you need anything else.|Let me know how I can help.|Thank you for your question.|Thanks for asking me.|"
    "Thank you for your understanding and for the time you took.|I only work with text.|I have no access to the picture.|The image is not available to me.|The picture was not supplied with your request.|The prompt may contain restricted content.|I was not given any image.|As an assistant I follow rules.|As an AI language model, my abilities are limited.|I hope you understand.|"
    "Feel free to ask me another question.|You may want to consult an expert.|Please ask a specialist.|My guidelines ask me to leave this alone.|Whatever you need it for, my rules stay the same.|Here is my answer to your request.|I am happy to help you with other tasks.|If you share the file, I will try again.|Is there anything else I can do for you?|I appreciate your patience.",
    "Bitte senden Sie das Bild.|Können Sie die Frage anders stellen?|Danke für Ihre Anfrage.|Kann ich Ihnen sonst helfen?|Ich danke Ihnen für Ihr Verständnis.|Mir liegt kein Bild vor.", "Veuillez fournir l'image.|Pouvez-vous reformuler la question ?|Merci pour votre demande.|Puis-je vous aider autrement ?|Je n'ai pas accès à l'image.",
    "Por favor, envíe la imagen.|Gracias por su pregunta.|¿Puedo ayudarle con otra cosa?", "Por favor, envie a imagem.|Obrigado pela sua pergunta.|Posso ajudar você com outra coisa?", "Пожалуйста, пришлите изображение.|Спасибо за ваш вопрос.|Могу ли я помочь вам иначе?", "请提供图片。|请换一种说法。|谢谢您的提问。|我可以帮您做别的吗？|我看不到这张图片。",
)


def made_sentences() -> list[tuple[str, str]]:
    """(sentence, kind) of the made sentences, every combination of their parts."""
    out = []
    for *parts, whole in _DECLINES:
        blank = "" if "我" in parts[0] else " "
        out += [(blank.join(x), "declines") for x in itertools.product(*(p.split("|") for p in parts))]
        out += [(x, "declines") for x in whole.split("|") if x for _ in range(40)]
    return out + [(x, "aside") for part in _ASIDES for x in part.split("|") for _ in range(40)]


_PIECE = re.compile(r"[一-鿿]|[^\W\d_]+(?:['’][^\W\d_]+)?")


def sentence_grams(sentence: str) -> list[int]:
    """Hashes of the words, pairs of words, and the first word of a sentence; an ideograph is a word."""
    w = _PIECE.findall(sentence.lower().replace("’", "'"))
    grams = {*w, *map(" ".join, zip(w, w[1:]))}
    return [zlib.crc32(g.encode()) >> (32 - REFUSAL_BITS) for g in grams]


def sentences(text: str) -> Iterator[str]:
    """Sentences with a word outside quoted labels, whole."""
    return (x for x in map(str.strip, _SENTENCE.split(_QUOTED.sub(" ", text))) if _PIECE.search(x))


@dataclass
class Refusals:
    """Naive Bayes over the n-grams of a sentence; n-grams that no kind has seen say nothing."""

    weights: np.ndarray  # (2 ** REFUSAL_BITS, kinds)

    @classmethod
    def fit(cls, described: list[str]) -> Refusals:
        seen = np.zeros((1 << REFUSAL_BITS, len(KINDS)))
        sizes = np.zeros(len(KINDS))
        for sentence, kind in [*((x, "describes") for x in described), *made_sentences()]:
            k = KINDS.index(kind)
            sizes[k] += 1
            seen[sentence_grams(sentence), k] += 1
        share = (seen / np.maximum(sizes, 1) + 0.0005) / 1.001  # rates, so that the sizes of the samples do not count
        logs = np.log(share)
        logs[seen.sum(1) == 0] = 0
        return cls((logs - logs.max(1, keepdims=True)).astype(np.float32))

    def kind(self, sentence: str) -> str:
        s = self.weights[sentence_grams(sentence)].sum(0)
        talk = 1 + int(s[2] > s[1])
        return KINDS[talk] if s[talk] - s[0] > TALK_NATS else KINDS[0]

    def is_refusal(self, answer: str) -> bool:
        """One of its sentences declines, and none describes; quoted labels are left out."""
        declines = False
        for x in sentences(answer):
            kind = self.kind(x)
            if kind == "describes":
                return False
            declines = declines or kind == "declines"
        return declines


# --- the operator ----------------------------------------------------------------------------------------------


@dataclass
class Model:
    languages: Languages
    ends: np.ndarray
    refusals: Refusals


def fit(documents: DataFrame, answers: DataFrame | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Languages and description from a bounded sample of labelled documents, ends of texts from all documents and all of
    ``answers`` (column answer)."""
    texts, labels = language_sample(documents, per_language)
    each = [list(sentences(t)) for t in texts]
    step = max(1, sum(map(len, each)) // SAMPLE_SENTENCES + 1)
    described = [x for one in each for x in one][::step]
    every = documents.select("text") if answers is None else documents.select("text").unionByName(answers.select(F.col("answer").alias("text")))
    return Model(Languages.fit(texts, labels), end_shares(every), Refusals.fit(described))


def classify(questions: list[str | None], answers: list[str | None], model: Model) -> list[str | None]:
    """Defect of each pair or None."""
    out: list[str | None] = [None] * len(answers)
    open_ = []
    for i, (q, a) in enumerate(zip(questions, answers)):
        if is_empty(a):
            out[i] = "empty"
        elif model.refusals.is_refusal(a):  # type: ignore[arg-type]
            out[i] = "refusal"
        elif q and is_copy(q, a):  # type: ignore[arg-type]
            out[i] = "copy"
        else:
            open_.append(i)
    if not open_:
        return out
    said = [answers[i] for i in open_]
    if len(model.languages.names) > 1:
        of_a = model.languages.scores(said)
        of_q = model.languages.scores([questions[i] for i in open_])
        n = np.arange(len(open_))
        best_q, best_a = of_q.argmax(1), of_a.argmax(1)
        ranked = np.sort(of_q, 1)
        sure = ranked[:, -1] - ranked[:, -2] > QUESTION_NATS
        other = (best_q != best_a) & sure & (of_a[n, best_a] - of_a[n, best_q] > ANSWER_NATS)
    else:
        other = np.zeros(len(open_), bool)
    likely = model.ends[contexts(said)]  # type: ignore[arg-type]
    for k, i in enumerate(open_):
        if other[k]:
            out[i] = "wrong_language"
        elif likely[k] < END_SHARE:
            out[i] = "truncated"
    return out


def defects(pairs: DataFrame, model: Model) -> DataFrame:
    """(table_name, row_id, defect) of the defective among ``pairs`` (table_name, row_id, question, answer).

    A missing question alone is no defect and leaves only defects that the answer shows by itself. A record
    delivered twice counts once; were its deliveries to differ, the defect first in order stands. Texts are read
    whole and never exchanged between tasks, only the findings are.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(model)  # a few MB whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            q, a = ([None if not isinstance(x, str) else x for x in b[c]] for c in ("question", "answer"))
            found = classify(q, a, m)
            keep = [i for i, x in enumerate(found) if x]
            yield pd.DataFrame({"table_name": b["table_name"].iloc[keep], "row_id": b["row_id"].iloc[keep], "rank": [DEFECTS.index(found[i]) for i in keep]})  # type: ignore[arg-type]

    found = pairs.select("table_name", "row_id", "question", "answer").mapInPandas(run, "table_name string, row_id long, rank int")
    names = F.array(*[F.lit(x) for x in DEFECTS])
    return found.groupBy("table_name", "row_id").agg(F.min("rank").alias("rank")).select("table_name", "row_id", names[F.col("rank")].alias("defect"))
