"""Garbled text from wrong character encoding.

Clean units of the corpus (words, runs of signs outside ASCII, single characters) are turned into every garbled form
that a chain of encodings gives, and the corpus' own units are hash-joined against that table. A form counts where
its original occurs in the corpus and, unless the form's shape proves it, its letters speak for the original (``odd``);
where they do not decide, the original must occur in more distinct texts than the form. Distinct units are formed with
map-side aggregation before anything is joined, so a third of the rows holding one garbled unit is one row of the join.

Units have no length limit. Forms travel as hashes; texts of originals are fetched for the few that meet a token, and
each is garbled once more and compared before it counts. A run outside ASCII is cut into pieces by reading it back under
every chain (``pieces``): at most a few per character and chain, whatever its length.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.session import durable, release

LOST = "�"
#: Code pages by Python's names; a chain is (name, true encoding, wrong encoding, times applied).
CHAINS = (
    ("utf8>cp1252", "utf-8", "cp1252", 1),
    ("utf8>cp1252 twice", "utf-8", "cp1252", 2),
    ("utf8>latin1", "utf-8", "latin-1", 1),
    ("utf8>latin1 twice", "utf-8", "latin-1", 2),
    ("utf8>mac", "utf-8", "mac_roman", 1),
    ("utf8>cp1251", "utf-8", "cp1251", 1),
    ("utf8>cp437", "utf-8", "cp437", 1),
    ("utf8>cp850", "utf-8", "cp850", 1),
    ("utf8>cp866", "utf-8", "cp866", 1),
    ("utf8>koi8", "utf-8", "koi8_r", 1),
    ("utf8>gbk", "utf-8", "gbk", 1),
    ("cp1252>cp437", "cp1252", "cp437", 1),
    ("cp1252>cp850", "cp1252", "cp850", 1),
    ("cp1252>mac", "cp1252", "mac_roman", 1),
    ("cp1252>cp1251", "cp1252", "cp1251", 1),
    ("mac>cp1252", "mac_roman", "cp1252", 1),
    ("cp1251>cp1252", "cp1251", "cp1252", 1),
    ("cp1251>mac", "cp1251", "mac_roman", 1),
    ("cp1251>koi8", "cp1251", "koi8_r", 1),
    ("koi8>cp1251", "koi8_r", "cp1251", 1),
    ("koi8>cp1252", "koi8_r", "cp1252", 1),
    ("cp866>cp1251", "cp866", "cp1251", 1),
    ("cp866>cp1252", "cp866", "cp1252", 1),
    ("gbk>cp1252", "gbk", "cp1252", 1),
    ("gbk>latin1", "gbk", "latin-1", 1),
)
_BY_NAME = {name: (true, wrong) for name, true, wrong, times in CHAINS if "utf-8" not in (true, wrong)}
_PAGES = tuple(dict.fromkeys(wrong for _, true, wrong, _ in CHAINS if true == "utf-8" and wrong != "gbk"))
_SHAPED = re.compile(r"[^\x00-\x7f]{2}")
_CYRILLIC = re.compile("[Ѐ-ӿ]+")
#: What the languages of the corpus write outside ASCII.
_RUSSIAN = re.compile("[А-яЁё]+")
_KNOWN = re.compile("[\x00-\x7f\xa0-ɏͰ-ϿА-яЁё‐-⋿　-〿一-鿿＀-￯]+")
_MIXED = re.compile("[а-яё][А-ЯЁ]")
_SELDOM = frozenset("ъэфщцюшжхйё")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")
_LETTERS = re.compile(r"[^\W\d_]+")
_FOREIGN = re.compile("[À-ÖØ-öø-ɏ]{2,}")
_ACCENTS = re.compile("[À-ÖØ-öø-ɏ]{3,}")
_ACCENTED = frozenset("äöüßéèêëàâáãåæçñíìîïóòôõøœúùûÿÄÖÜÉÈÊËÀÂÁÃÅÆÇÑÍÌÎÏÓÒÔÕØŒÚÙÛẞ")
_STRAY = frozenset("¨´¸¯¬¤¦ˆ˜¢¥\uf8ff")
_JOINERS = frozenset("’‘‐‑–—·×−/")
#: Oddness by which a form of four characters or more speaks for itself; units of a document that must agree otherwise.
SPEAKS, AGREE = 2.0, 2


def _decode(raw: bytes, wrong: str) -> str:
    """Bytes without a meaning stay control characters, as browsers and editors leave them."""
    return raw.decode(wrong, "replace" if wrong == "gbk" else "figloom-keep")


def _keep(e: UnicodeError) -> tuple[str, int]:
    return "".join(map(chr, e.object[e.start : e.end])), e.end  # type: ignore[attr-defined]


codecs.register_error("figloom-keep", _keep)


def garble(word: str, true: str, wrong: str, times: int = 1) -> str | None:
    """What ``word`` looks like after ``times`` wrong readings; None where its encoding lacks a character."""
    try:
        for _ in range(times):
            word = _decode(word.encode(true), wrong)
    except UnicodeEncodeError:
        return None
    return word


def _plain_han(c: str) -> bool:
    """Among the 3,755 common ideographs, rows 16 to 55 of GB 2312."""
    try:
        raw = c.encode("gb2312")
    except UnicodeEncodeError:
        return False
    return 0xB0 <= raw[0] <= 0xD7


def odd(unit: str) -> float:
    """How much in ``unit`` its own script does not write: signs inside words, mixed scripts, capitals after small
    letters, words of nothing but accented letters, rare letters and ideographs. 0 for ordinary writing."""
    out, around = 0.0, f" {unit} "
    for a, c, b in zip(around, around[1:], around[2:]):
        if c.isascii():
            continue
        if "一" <= c <= "鿿":
            out += (not _plain_han(c)) + bool(_LATIN.search(a + b))
        elif "\x80" <= c <= "\x9f" or "─" <= c <= "▟":
            out += 2
        elif "Ѐ" <= c <= "ӿ":
            out += (not _RUSSIAN.match(c)) + bool(_LATIN.search(a + b)) + (c.isupper() and a.islower())
        elif "Ͱ" <= c <= "Ͽ":
            out += bool(_LATIN.match(a))
        elif not c.isalpha():
            kind = unicodedata.category(c)[0]
            inside, beside = a.isalpha() and b.isalpha(), any(x.isalpha() and not x.isascii() for x in (a, b))
            out += c in _STRAY or c not in _JOINERS and (inside and kind in "SPN" or beside and kind in "SN")
        elif c not in "µªº":
            out += (c not in _ACCENTED) + (c.isupper() and a.islower())
    for w in _LETTERS.findall(unit):
        if _FOREIGN.fullmatch(w):
            out += len(w)
        elif len(w) > 1 and _RUSSIAN.fullmatch(w):
            out += (3 * max(0.0, sum(c in _SELDOM for c in w.lower()) / len(w) - 0.3) + 0.5 * w.isupper()) * max(1.0, len(w) / 6)
        else:
            out += sum(map(len, _ACCENTS.findall(w)))
    return out


def _undone(unit: str) -> bool:
    """Whether ``unit`` is UTF-8 read as a single-byte page: it is hardly an original then."""
    for wrong in _PAGES:
        try:
            was = b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(wrong) for c in unit).decode("utf-8")
        except UnicodeError:
            continue
        if _KNOWN.fullmatch(was):
            return True
    return False


def forms(unit: str, kind: str) -> Iterator[tuple[str, int, str]]:
    """(garbled form, place of the chain in CHAINS, rule) of a clean unit: a form of rule ``shape`` speaks for itself,
    one of rule ``count`` only where letters, document or counts speak for the original."""
    if LOST in unit:
        return
    raw: dict[str, bytes | None] = {}
    once: dict[str, str] = {}
    for k, (_, true, wrong, times) in enumerate(CHAINS):
        if true not in raw:
            try:
                raw[true] = unit.encode(true)
            except UnicodeEncodeError:
                raw[true] = None
        if raw[true] is None:
            continue
        if true == "utf-8" and wrong in once:
            g = once[wrong]
        else:
            g = _decode(raw[true], wrong)  # type: ignore[arg-type]
            if true == "utf-8":
                once[wrong] = g
        if times > 1:
            g = garble(g, true, wrong, times - 1)  # type: ignore[assignment]
        if g is None or g == unit or LOST in g or g.isascii():
            continue
        if true == "utf-8" and wrong != "gbk":
            if _SHAPED.search(g):
                yield g, k, "shape"
        elif wrong == "gbk":
            if kind == "word" or len(g) > 1:
                yield g, k, "count"
        elif len(unit) > 1 and kind != "char":
            if len(unit) < 4 and _CYRILLIC.fullmatch(unit) and _CYRILLIC.fullmatch(g):
                continue
            yield g, k, "count"
    if kind == "char" and len(u := unit.encode("utf-8", "replace")) == 3:
        head = _head(u)
        if head:
            yield head, _HEADS, "count"


def _head(raw: bytes) -> str | None:
    """The first two of three bytes read as GBK; the third byte goes into the next character."""
    head = raw[:2].decode("gbk", "replace")
    return head if LOST not in head and len(head) == 1 else None


_HEADS = next(k for k, c in enumerate(CHAINS) if c[0] == "utf8>gbk")


def _same(original: str, kind: str, chain: int, piece: str) -> bool:
    """Whether ``original`` garbled by the chain is ``piece``."""
    _, true, wrong, times = CHAINS[chain]
    if garble(original, true, wrong, times) == piece:
        return True
    return chain == _HEADS and kind == "char" and len(u := original.encode("utf-8", "replace")) == 3 and _head(u) == piece


_EDGES = r"^[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$"


def _words(text: Column) -> Column:
    wide = F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: F.octet_length(w) > F.length(w))
    return F.array_distinct(F.transform(wide, lambda w: F.regexp_replace(w, _EDGES, "")))


def _runs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[^\x00-\x7f]+"), 0))


def units(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, key, unit, kind, k1, k2) of the words and runs outside ASCII of each document, each once; equal texts
    share a key, ``k1`` and ``k2`` are 96 bits that stand for unit and kind."""
    base = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).where(F.octet_length("text") > F.length("text"))
    both = F.concat(
        F.transform(_words(F.col("text")), lambda w: F.struct(w.alias("unit"), F.lit("word").alias("kind"))),
        F.transform(_runs(F.col("text")), lambda w: F.struct(w.alias("unit"), F.lit("run").alias("kind"))),
    )
    rows = base.select("doc_id", F.xxhash64("text").alias("key"), F.explode(both).alias("u")).select("doc_id", "key", "u.unit", "u.kind")
    return rows.withColumns({"k1": F.xxhash64("unit", "kind"), "k2": F.hash("unit", "kind")})


def _c1(e: UnicodeError) -> tuple[bytes, int]:
    """Control characters stand for their byte, what the page lacks for a question mark: one byte a character."""
    part = e.object[e.start : e.end]  # type: ignore[attr-defined]
    return b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else b"?" for c in part), e.end  # type: ignore[attr-defined]


codecs.register_error("figloom-c1", _c1)
_PLAIN_RUN = re.compile("[一-鿿、-】＀-￯‐-›]+|[А-яЁё]+|[‐-›«»]+")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_HIGH = re.compile(rb"[\x80-\xfe]{2,}")
_STRETCH = re.compile(r"[^\W\d_]{2,}")
_SINGLE: dict[str, list[str]] = {}  # wrong page -> true pages of the chains that are not UTF-8
for _, _true, _wrong, _ in CHAINS:
    if _true != "utf-8":
        _SINGLE.setdefault(_wrong, []).append(_true)


def _utf8_spans(raw: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in _UTF8.finditer(raw)]


def pieces(run: str) -> set[str]:
    """Parts of a run that may be a garbled character or word: what its reading back under each chain shows to be one.

    The number of parts grows in proportion to the run. A run of one script's plain letters has only its ideographs.
    """
    ideographs = {c for c in run if "一" <= c <= "鿿"}
    if _PLAIN_RUN.fullmatch(run):
        return ideographs
    out = ideographs
    for wrong in dict.fromkeys((*_PAGES, *_SINGLE)):
        raw = run.encode(wrong, "figloom-c1")
        if wrong in _PAGES:
            once = _utf8_spans(raw)
            out.update(run[a:b] for a, b in once)
            if wrong in ("cp1252", "latin-1") and len(once) > 1:
                at = 0
                while at < len(once):  # sequences one after the other are what a second reading went over
                    end = at
                    while end + 1 < len(once) and once[end + 1][0] == once[end][1]:
                        end += 1
                    inner = raw[once[at][0] : once[end][1]].decode("utf-8", "replace")
                    if len(inner) == end - at + 1:
                        out.update(run[once[at + a][0] : once[at + b - 1][1]] for a, b in _utf8_spans(inner.encode(wrong, "figloom-c1")))
                    at = end + 1
        for true in _SINGLE.get(wrong, ()):
            if true == "gbk":
                for m in _HIGH.finditer(raw):
                    for lo in (m.start(), m.start() + 1):
                        was = raw[lo : lo + (m.end() - lo) // 2 * 2].decode("gbk", "replace")
                        if 2 * len(was) == (m.end() - lo) // 2 * 2:  # else a byte without a meaning has shifted it
                            out.update(run[lo + 2 * x.start() : lo + 2 * x.end()] for x in _STRETCH.finditer(was))
            else:
                out.update(run[x.start() : x.end()] for x in _STRETCH.finditer(raw.decode(true, "replace")))
    if ideographs:  # UTF-8 read as GBK: two bytes a character
        raw = run.encode("gbk", "replace")
        if len(raw) == 2 * len(run):
            spans, at = _utf8_spans(raw), 0
            while at < len(spans):
                end = at
                while end + 1 < len(spans) and spans[end + 1][0] == spans[end][1]:
                    end += 1
                was = raw[spans[at][0] : spans[end][1]].decode("utf-8", "replace")
                if len(was) == end - at + 1:
                    for x in _STRETCH.finditer(was):
                        lo, hi = spans[at + x.start()][0], spans[at + x.end() - 1][1]
                        out.add(run[(lo + 1) // 2 : hi // 2])
                at = end + 1
    out.discard("")
    return out


_SEEDS = {"word": 1, "run": 2}


def _key(x: str, cls: str) -> int:
    """Hash by which forms and tokens meet; words meet words, and runs, their parts and characters meet each other."""
    return xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), _SEEDS[cls])


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces by which a unit is looked up: a word as a whole, a run as a whole and in its parts."""
    for b in batches:
        k1, k2, n, keys, out, cls = [], [], [], [], [], []
        for u, kind, a, c, m in zip(b["unit"], b["kind"], b["k1"], b["k2"], b["n"]):
            found = pieces(u) | {u} if kind == "run" else (u,)
            for x in found:
                out.append(x)
                keys.append(_key(x, kind))
            k1 += [a] * len(found)
            k2 += [c] * len(found)
            n += [m] * len(found)
            cls += [kind] * len(found)
        yield pd.DataFrame({"k1": k1, "k2": np.array(k2, np.int32), "kind": cls, "piece": out, "key": np.array(keys, np.uint64).view(np.int64), "n": n})


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Characters, and words inside longer runs: originals, too."""
    for b in batches:
        out, kinds, n = [], [], []
        for u, m in zip(b["unit"], b["n"]):
            chars = set(u)
            words = {x for x in _STRETCH.findall(u) if x != u and not _stays(x)}
            out += [*chars, *words]
            kinds += ["char"] * len(chars) + ["run"] * len(words)
            n += [m] * (len(chars) + len(words))
        yield pd.DataFrame({"unit": out, "kind": kinds, "n": n})


_RULES = ("shape", "count")


def _form_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        keys, own, chains, rules = [], [], [], []
        for unit, kind, o in zip(b["unit"], b["kind"], b["o"]):
            cls = "word" if kind == "word" else "run"
            if kind != "char" and (_stays(unit) or _MIXED.search(unit) or _undone(unit)):  # no clean unit, so no original
                continue
            for g, chain, rule in forms(unit, kind):
                keys.append(_key(g, cls))
                own.append(o)
                chains.append(chain)
                rules.append(_RULES.index(rule))
        yield pd.DataFrame({"key": np.array(keys, np.uint64).view(np.int64), "o": np.array(own, np.int64), "chain": np.array(chains, np.int8), "rule": np.array(rules, np.int8)})


def _pair(a: int, b: int) -> tuple[str, bool] | None:
    """The GB 2312 character of two bytes, and whether it is a common one; None where they are none."""
    try:
        c = bytes([a, b]).decode("gb2312")
    except UnicodeDecodeError:
        return None
    return c, 0xB0 <= a <= 0xD7 or a in (0xA1, 0xA3) and not c.isalnum()


def walk(run: str) -> list[tuple[str, str, str]]:
    """(piece, original, chain) of the stretches of ``run``, of any length, that are GBK read as a single-byte page:
    four two-byte units or more, nearly all common, that are neither UTF-8 nor Russian of one byte a letter."""
    out, seen = [], set()
    for chain in ("gbk>cp1252", "gbk>latin1"):
        raw = []
        for c in run:
            try:
                raw.append(c.encode(_BY_NAME[chain][1])[0])
            except UnicodeEncodeError:
                raw.append(ord(c) if "\x80" <= c <= "\x9f" else 0)
        at = 0
        while at < len(raw) - 1:
            end, was, common = at, [], 0
            while end < len(raw) - 1 and (x := _pair(raw[end], raw[end + 1])):
                was.append(x[0])
                common += x[1]
                end += 2
            n = len(was)
            if n >= 4 and common >= 0.85 * n:
                low = sum(b < 0xC0 and b not in (0xA8, 0xB8) for b in raw[at:end])
                utf8 = sum(0xC2 <= raw[k] <= 0xDF and raw[k + 1] < 0xC0 for k in range(at, end, 2))
                piece = run[at:end]
                if 8 * low >= 2 * n and utf8 <= 0.6 * n and piece not in seen:
                    seen.add(piece)
                    out.append((piece, "".join(was), chain))
            at = max(end, at + 1)
    return out


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k1, k2, *x) for u, k1, k2 in zip(b["unit"], b["k1"], b["k2"]) for x in walk(u)]
        yield pd.DataFrame(rows, columns=["k1", "k2", "piece", "original", "chain"])


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Forms that met a token: verified by garbling the original again; the gain in ordinary writing of each."""
    for b in batches:
        rows = []
        for key, piece, n, original, kind, n_original, chain, rule in zip(*(b[c] for c in ("key", "piece", "n", "original", "kind", "n_original", "chain", "rule"))):
            if not _same(original, kind, chain, piece):
                continue
            gain = 0.0 if _RULES[rule] == "shape" else odd(piece) - odd(original)
            counted = _RULES[rule] == "shape" or gain >= 0 and n_original > n
            sure = counted or gain >= SPEAKS and len(piece) >= 4
            if sure or gain > 0:
                rows.append((key, piece, original, CHAINS[chain][0], n_original, counted, sure))
        yield pd.DataFrame(rows, columns=["key", "piece", "original", "chain", "n_original", "counted", "sure"])


def garbled_units(found: DataFrame) -> DataFrame:
    """(k1, k2, kind, piece, original, chain, sure, counted): garbled units among ``found`` with what they were; what is not
    sure counts only in documents where several units agree on the chain (``_agreed``).

    For a word the piece is the word, for a run the part of it that is a garbled run or character; a unit that holds
    a lost character has a null original.
    """
    spread = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes that take much work
    counts = durable(found.groupBy("unit", "kind", "k1", "k2").agg(F.count_distinct("key").alias("n")).repartition(spread, "k1"), "units")
    runs = counts.where("kind = 'run'")
    parts = runs.select("unit", "n").mapInPandas(_stretches, "unit string, kind string, n bigint").groupBy("unit", "kind").agg(F.sum("n").alias("n"))
    worded = counts.where(~F.col("unit").rlike(r"[0-9]") | F.col("unit").rlike(r"(?=\p{L})[^\x00-\x7f]")).select("unit", "kind", "n")
    originals = worded.unionByName(parts).groupBy("unit", "kind").agg(F.max("n").alias("n"))
    originals = durable(originals.withColumn("o", F.xxhash64("unit", "kind")).repartition(spread, "o"), "originals")
    tokens = durable(counts.select("unit", "kind", "k1", "k2", "n").mapInPandas(_tokens, "k1 bigint, k2 int, kind string, piece string, key bigint, n bigint"), "tokens")
    looked = tokens.groupBy("key", "piece").agg(F.sum("n").alias("n"))
    table = originals.select("unit", "kind", "o").mapInPandas(_form_keys, "key bigint, o bigint, chain tinyint, rule tinyint")
    met = durable(looked.join(table, "key"), "met")
    texts = originals.select("o", F.col("unit").alias("original"), "kind", F.col("n").alias("n_original"))
    judged = met.join(texts, "o").mapInPandas(_judged, "key bigint, piece string, original string, chain string, n_original bigint, counted boolean, sure boolean")
    best = F.max_by(F.struct("original", "chain", "counted"), F.struct("counted", "n_original", "original", "chain"))
    by_chain = judged.groupBy("key", "piece", "sure", F.when(~F.col("sure"), F.col("chain")).alias("c")).agg(best.alias("x"))
    hits = tokens.select("k1", "k2", "kind", "key", "piece").join(by_chain.select("key", "piece", "x.original", "x.chain", "sure", "x.counted"), ["key", "piece"])
    names = ["k1", "k2", "kind", "piece", "original", "chain", "sure", "counted"]
    lost = counts.where(F.contains("unit", F.lit(LOST))).select(
        "k1", "k2", "kind", F.lit(LOST).alias("piece"), F.lit(None).cast("string").alias("original"), F.lit("lost").alias("chain"), F.lit(True).alias("sure"), F.lit(True).alias("counted")
    )
    walked = runs.where(F.length("unit") >= 8).select("unit", "k1", "k2").mapInPandas(_walked, "k1 bigint, k2 int, piece string, original string, chain string")
    walked = walked.select("k1", "k2", F.lit("run").alias("kind"), "piece", "original", "chain", F.lit(True).alias("sure"), F.lit(True).alias("counted"))
    out = durable(hits.select(names).unionByName(lost).unionByName(walked), "hits")
    for done in (counts, originals, tokens, met):
        release(done)
    return out


def _agreed(found: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, kind, piece, original, chain, counted): the hits that are sure, and those on whose chain ``AGREE`` words or
    runs of the document agree."""
    rows = found.select("doc_id", "k1", "k2").join(hits, ["k1", "k2"])
    loose = rows.where("not sure").select("doc_id", "chain").distinct()
    many = [F.count_distinct(F.when(F.col("kind") == k, F.col("piece"))) for k in ("word", "run")]
    agree = rows.join(loose, ["doc_id", "chain"], "left_semi").groupBy("doc_id", "chain").agg(F.greatest(*many).alias("k")).where(F.col("k") >= AGREE)
    return rows.where("sure").unionByName(rows.where("not sure").join(agree.select("doc_id", "chain"), ["doc_id", "chain"], "left_semi")).drop("sure", "k1", "k2")


def affected(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, piece, original, chain, counted) of every garbled piece of every document.

    Null, empty and pure ASCII texts have none. Texts are read whole; equal texts under several ids are each listed.
    """
    found = durable(units(documents, id_col, text), "found")
    return _agreed(found, garbled_units(found))


def found_ids(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of the documents that hold a garbled sequence, restorable or not, each once."""
    return affected(documents, id_col, text).select("doc_id").distinct()


#: A word gives way only where it stands as a word.
_BESIDE = r"(?<![^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])%s(?![^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f])"
_LEFT = re.compile(r"[^\W\d_]*[^\x00-\x7f](?:[^\W\d_]|[^\x00-\x7f])*")


def _back(unit: str, chain: str) -> str | None:
    """What ``unit`` was before ``chain``; None where the chain does not give ``unit``."""
    true, wrong = _BY_NAME[chain]
    try:
        was = b"".join(bytes([ord(c)]) if "\x80" <= c <= "\x9f" else c.encode(wrong) for c in unit).decode(true)
    except UnicodeError:
        return None
    return was if was != unit and _KNOWN.fullmatch(was) and garble(was, true, wrong) == unit else None


def _remaining(unit: str, known: list[str], before: str, after: str) -> str | None:
    """A unit that no hit names, under a chain that other units of its document verify: odd signs give way to plain
    ones, and a short word follows the words beside it."""
    for chain in known:
        was = _back(unit, chain)
        if was is None:
            continue
        if odd(unit) > odd(was):
            return was
        if len(unit) < 4 and unit.isalpha() and was.isalpha():
            sides = (before == chain) + (after == chain)
            if sides == 2 or sides and _RUSSIAN.fullmatch(was) and not _CYRILLIC.fullmatch(unit):
                return was
    return None


def _stays(unit: str) -> bool:
    """Whether a unit left as it was is no clean one."""
    if _RUSSIAN.fullmatch(unit):
        return False
    ideographs = sum("一" <= c <= "鿿" for c in unit)
    return odd(unit) > ideographs / 2


def mend(text: str, pairs: list) -> tuple[str, bool]:
    """``text`` with its pieces replaced, and whether nothing garbled is left."""
    swap: dict[str, str] = {}
    chain_of: dict[str, str] = {}
    for p in pairs:
        if p["original"] is not None and p["piece"] not in swap:
            swap[p["piece"]], chain_of[p["piece"]] = p["original"], p["chain"]
    if not swap:
        return text, LOST not in text and not any(map(_stays, _LEFT.findall(text)))
    words = {p["piece"] for p in pairs if p.get("kind") == "word"} - {p["piece"] for p in pairs if p.get("kind") != "word"}
    longest = [_BESIDE % re.escape(x) if x in words else re.escape(x) for x in sorted(swap, key=lambda x: (-len(x), x))]
    parts, at = [], 0  # (text, chain); "" for what is no unit, "?" for a unit without a hit
    for m in re.finditer("|".join(longest), text):
        parts += _split(text[at : m.start()])
        parts.append((m.group(), chain_of[m.group()]))
        at = m.end()
    parts += _split(text[at:])
    known = sorted({c for _, c in parts if c in _BY_NAME})
    beside = [c for _, c in parts]
    out, whole, before = [], LOST not in text, ""
    following, nxt = [""] * len(parts), ""
    for k in range(len(parts) - 1, -1, -1):
        following[k] = nxt
        nxt = beside[k] if beside[k] not in ("", "?") else nxt
    for (t, c), after in zip(parts, following):
        if c == "?":
            was = _remaining(t, known, before, after)
            whole = whole and (was is not None or not _stays(t))
            out.append(t if was is None else was)
        else:
            out.append(swap[t] if c else t)
            before = c or before
    return "".join(out), whole


def _split(text: str) -> list[tuple[str, str]]:
    parts, at = [], 0
    for m in _LEFT.finditer(text):
        parts += [(text[at : m.start()], ""), (m.group(), "?")]
        at = m.end()
    return [*parts, (text[at:], "")]


def _restore(text: pd.Series, pairs: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([mend(t, ps) for t, ps in zip(text, pairs)], columns=["restored", "whole"])


def restore(documents: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, whole, chains) of the affected documents; ``whole`` is false where characters stay lost or garbled."""
    pairs = affected(documents, id_col, text).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct((~F.col("counted")).alias("later"), "piece", "original", "chain", "kind"))).alias("pairs"), F.array_sort(F.collect_set("chain")).alias("chains")
    )
    fix = F.pandas_udf(_restore, "restored string, whole boolean")
    joined = documents.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).join(pairs, "doc_id")
    fixed = joined.select("doc_id", fix("text", "pairs").alias("x"), "chains")
    return fixed.select("doc_id", "x.restored", "x.whole", "chains")
