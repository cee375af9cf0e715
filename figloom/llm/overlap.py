"""Same or near-same records across splits.

Texts are compared as word sequences; equal ones form one class, so copies meet once, however many there are. Between
classes, windows of five words yield fingerprints by winnowing: of the rolling hashes of four words in a window the
least is selected, least by a global order that puts rare hashes first. At most one word in ten may differ, and one
edit spoils at most five windows; so of two texts in reach of each other, the 5k + 8 rarest windows of either hold the
eight rarest common ones (or all, if fewer are common), k being the edits allowed. Only those are joined across
splits: nothing is lost, and hashes of stock phrases come last in the order and are hardly ever joined. Seeds within
k of the diagonal, in texts of lengths within k, are counted per pair, and a pair with fewer than the k edits leave is
dropped before any text is fetched. The seeds of the others are chained: a pair is dropped if its longest chain that
rises in both texts is shorter than that bound. The chain is then extended: each seed grows to the words around it, and
what lies between, before and behind is aligned; where that takes edits, the whole texts are aligned, as a chain need
not lie on the best alignment. Coverage is the share of the evaluation text's words that stand in the training text in
the same order.

Frequencies come from all texts: each task adds its hashes into counters, whose number grows with the corpus up to
2 ** MOST_BITS; they are kept in full and sent to the tasks as logarithms, one byte each. They only order hashes, so
their collisions cost time, never results.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figloom.llm.components import file_key
from figloom.session import durable, release

GRAM = 4
WINDOW = 5  # words; WINDOW - GRAM + 1 hashes
ONE_IN = 10
#: Counters of hashes: 2 ** LEAST_BITS, more so that at most GRAMS_EACH grams fall to each, 2 ** MOST_BITS (16 MB sent) at most.
LEAST_BITS, MOST_BITS, GRAMS_EACH = 18, 24, 64
BLOCK_BITS = 12
SHARED = 8  # windows that two texts in reach must share among their rarest, if they have so many
_MIX = np.uint64(0x9E3779B97F4A7C15)


_IDEOGRAPH = r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}])"


def normalise(texts: pa.Array) -> pa.Array:
    """Words in lower case with one blank between them; an ideograph is a word; null where there is none."""
    t = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}]+", " ")
    if pc.any(pc.match_substring_regex(t, _IDEOGRAPH)).as_py():
        t = pc.replace_substring_regex(pc.replace_substring_regex(t, _IDEOGRAPH, r" \1 "), " +", " ")
    t = pc.utf8_trim(t, " ")
    return pc.if_else(pc.equal(t, ""), pa.scalar(None, t.type), t)


def reach(n: int) -> int:
    """Edits that two texts may be apart, the longer one having ``n`` words."""
    return n // ONE_IN


class Grams:
    """Rolling hashes of a list of texts, flat, with the text and the place of each."""

    def __init__(self, texts: Sequence[str]) -> None:
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        each = coded.dictionary.to_pylist()
        h = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))[coded.indices.to_numpy()]
        self.sizes = np.diff(split.offsets.to_numpy())
        n = max(0, len(h) - GRAM + 1)
        g = np.zeros(n, np.uint64)
        for i in range(GRAM):
            g = (g ^ h[i : i + n]) * _MIX
            g ^= g >> np.uint64(29)
        starts = np.cumsum(self.sizes) - self.sizes
        text = np.repeat(np.arange(len(self.sizes)), self.sizes)[:n]
        place = np.arange(n) - starts[text]
        keep = place <= self.sizes[text] - GRAM
        self.hash, self.text, self.place = g[keep], text[keep], place[keep]
        sign = np.concatenate([[0], h % np.uint64(255) + np.uint64(1), [0]]).astype(np.int64)  # of each word, 0 for none
        at = np.flatnonzero(keep)
        left = np.where(self.place > 0, sign[at], 0)
        right = np.where(self.place < self.sizes[self.text] - GRAM, sign[at + GRAM + 1], 0)
        self.beside = left << 8 | right

    def buckets(self, bits: int) -> np.ndarray:
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64)


def spoilt(n: np.ndarray) -> np.ndarray:
    """Windows of a text of ``n`` words that the edits to any text in reach spoil, at most.

    An edit allowed by the text's own length spoils WINDOW of them. A longer partner allows more edits, but takes
    insertions to be longer, each of which spoils one window less.
    """
    return WINDOW * (n // ONE_IN) + np.maximum(0, n % ONE_IN - (ONE_IN - WINDOW))


def ranks(counts: np.ndarray) -> np.ndarray:
    """Frequencies as bytes that never saturate: four steps to a doubling."""
    return np.rint(4 * np.log2(1.0 + counts)).astype(np.uint8)


def select(grams: Grams, rank: np.ndarray) -> np.ndarray:
    """Which hashes are the fingerprints of the rarest windows of their texts, each place once."""
    if len(grams.hash) < 2:
        return np.zeros(0, np.int64)
    rare = rank[grams.buckets(len(rank).bit_length() - 1)].astype(np.uint64)
    order = rare << np.uint64(32) | grams.hash >> np.uint64(32)
    inside = np.flatnonzero(grams.text[1:] == grams.text[:-1])
    at = np.where(order[inside] <= order[inside + 1], inside, inside + 1)
    at = at[np.lexsort((order[at], grams.text[at]))]
    text, order = grams.text[at], order[at]
    n = np.bincount(text, minlength=len(grams.sizes))
    ends = np.cumsum(n)
    most = spoilt(grams.sizes) + SHARED
    last = np.clip(np.minimum(ends - n + most, ends) - 1, 0, max(0, len(at) - 1))
    at = at[order <= order[last][text]]  # ties with the last one stay
    return np.unique(at)


def distance(a: Sequence, b: Sequence, most: int) -> int:
    """Words to change, add or drop between ``a`` and ``b``; ``most`` + 1 if more than ``most``.

    Furthest points per diagonal, edit by edit: O(len + most ** 2) on texts that are alike.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    target = m - n
    far = {0: 0}
    for e in range(most + 1):
        step: dict[int, int] = {}
        for d in range(-e, e + 1):
            if e == 0:
                i = 0
            else:
                i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
                if i < 0:
                    continue
            i = min(i, n, m - d)
            if i < 0 or i + d < 0:
                continue
            while i < n and i + d < m and a[i] == b[i + d]:
                i += 1
            step[d] = i
            if d == target and i >= n:
                return e
        far = step
    return most + 1


def common(a: Sequence, b: Sequence) -> int:
    """Words of a longest common subsequence, by columns of bits: len(b) steps on numbers of len(a) bits."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for x in b:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & whole
    return len(a) - v.bit_count()


def sketch(texts: DataFrame, bits: int | None = None) -> np.ndarray:
    """Counters of all hashes of column ``words``; their number follows from the words of all texts."""
    if bits is None:
        words = texts.agg(F.sum(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)).collect()[0][0] or 0
        bits = min(MOST_BITS, max(LEAST_BITS, (words // GRAMS_EACH).bit_length()))
    block = 1 << BLOCK_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int64)
        for b in batches:
            total += np.bincount(Grams(b["words"]).buckets(bits), minlength=1 << bits)
        own = [i for i in range((1 << bits) // block) if total[i * block : (i + 1) * block].any()]
        yield pd.DataFrame({"block": own, "counts": [total[i * block : (i + 1) * block].tobytes() for i in own]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, np.int64) for x in rows["counts"]], axis=0)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "counts": [total.astype(np.int64).tobytes()]})

    kind = "block int, counts binary"
    summed = texts.select("words").mapInPandas(count, kind).groupBy("block").applyInPandas(add, kind)
    out = np.zeros(1 << bits, np.int64)
    for r in summed.toLocalIterator():  # at most 2 ** MOST_BITS numbers whatever the data
        out[r["block"] * block : (r["block"] + 1) * block] = np.frombuffer(r["counts"], np.int64)
    return out


def _broadcast(texts: DataFrame, counts: np.ndarray):  # noqa: ANN202
    """Ranks of the counters: a byte each, 16 MB at most."""
    return texts.sparkSession.sparkContext.broadcast(ranks(counts))


def fingerprints(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """(cls, n_words, hash, spot) of each selected fingerprint of each class; the spot is its place and, in 16 bits, signs
    of the words beside it."""
    shared = _broadcast(texts, counts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for b in batches:
            g = Grams(b["words"])
            at = select(g, c)
            text, spot = g.text[at], g.place[at].astype(np.int64) << 16 | g.beside[at]
            h = g.hash[at] ^ xxh_field(b["field"])[text]
            yield pd.DataFrame({"cls": b["cls"].to_numpy()[text], "n_words": g.sizes[text].astype(np.int32), "hash": h.view(np.int64), "spot": spot})

    return texts.select("field", "cls", "words").mapInPandas(run, "cls long, n_words int, hash long, spot long")


def xxh_field(fields: pd.Series) -> np.ndarray:
    """A number per field, so that hashes of different fields do not meet."""
    codes, names = pd.factorize(fields)
    return np.array([xxhash.xxh64_intdigest(x) for x in names], np.uint64)[codes]


def chain(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """The longest chain of seeds (place in a, place in b) that rises in both texts."""
    seeds = sorted(set(zip(a, b)), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []  # last place in b of the best chain of each length
    last: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(seeds):
        at = bisect.bisect_left(tails, y)
        before.append(last[at - 1] if at else -1)
        tails[at : at + 1] = [y]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(seeds[k])
        k = before[k]
    return out[::-1]


def extended(x: Sequence, y: Sequence, seeds: list[tuple[int, int]], most: int) -> int:
    """Edits between ``x`` and ``y`` along a chain of seeds; ``most`` + 1 if more than ``most``.

    Each seed grows in both directions over equal words; the stretches left between, before and behind are aligned.
    """
    edits, i, j = 0, 0, 0
    for p, q in [*seeds, (len(x), len(y))]:
        if p < i or q < j:
            continue  # within what the seed before grew to
        while p > i and q > j and x[p - 1] == y[q - 1]:
            p, q = p - 1, q - 1
        edits += distance(x[i:p], y[j:q], most - edits)
        if edits > most:
            return most + 1
        while p < len(x) and q < len(y) and x[p] == y[q]:
            p, q = p + 1, q + 1
        i, j = p, q
    return edits


def _seeds(texts: list[str], rank: np.ndarray) -> list[dict[int, list[int]]]:
    """Fingerprints of each text: places by hash."""
    g = Grams(texts)
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    for k in select(g, rank):
        out[g.text[k]].setdefault(int(g.hash[k]), []).append(int(g.place[k]))
    return out


def align(a: Sequence[str], b: Sequence[str], rank: np.ndarray) -> list[tuple[int, int]]:
    """(edits, words aligned) of pairs of texts, (-1, 0) where they are out of reach: chain, extension, alignment."""
    each = list(dict.fromkeys([*a, *b]))
    of = dict(zip(each, _seeds(each, rank)))
    out = []
    for s, t in zip(a, b):
        x, y = s.split(" "), t.split(" ")
        longer = max(len(x), len(y))
        k = reach(longer)
        seeds = [(i, j) for h, places in of[s].items() for i in places for j in of[t].get(h, ()) if abs(i - j) <= k]
        c = chain([i for i, _ in seeds], [j for _, j in seeds])
        if 2 * len(c) < min(SHARED, longer - (WINDOW - 1) - WINDOW * k):
            out.append((-1, 0))
            continue
        d = extended(x, y, c, k)
        if d > 0:
            d = min(d, distance(x, y, min(k, d)))
        out.append((d, common(x, y)) if d <= k else (-1, 0))
    return out


def classes(records: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Members (field, key, id, train) and classes (field, key, train, eval, words) of the texts in ``fields``.

    The key is a digest of 128 bits of the letters and digits of a text, so spacing inside words is ignored, too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, name in enumerate(fields):
                t = normalise(b.column(2 + k).cast(pa.string()))
                use = t.is_valid()
                t = t.filter(use)
                key = pa.array([hashlib.md5(x.replace(" ", "").encode()).digest() for x in t.to_pylist()], pa.binary())
                names = pa.array([name] * len(t), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(use), b.column(1).filter(use), names, t, key], names=["id", "train", "field", "words", "key"])

    texts = records.select(F.col("id").cast("long"), "train", *[F.col(f"`{f}`") for f in fields]).mapInArrow(run, "id long, train boolean, field string, words string, key binary")
    keyed = durable(texts, "texts")
    one = keyed.groupBy("field", "key").agg(
        F.max("train").alias("train"), F.max(~F.col("train")).alias("eval"), F.min("words").alias("words")
    ).withColumn("cls", F.xxhash64("field", "key"))
    members, texts = durable(keyed.select("field", "key", "id", "train"), "members"), durable(one, "classes")
    release(keyed)
    return members, texts


def near_classes(texts: DataFrame) -> DataFrame:
    """(field, key_a, key_b, edits, words, aligned): pairs of different classes in reach, ``a`` with evaluation records and
    ``b`` with training records; ``words`` counts those of a, ``aligned`` those of them that b holds in the same order."""
    counts = sketch(texts)  # few classes are on both sides, so each side makes its own fingerprints
    a = fingerprints(texts.where("eval"), counts).select("hash", F.col("cls").alias("cls_a"), F.col("n_words").alias("n_a"), F.col("spot").alias("at_a"))
    b = fingerprints(texts.where("train"), counts).select("hash", F.col("cls").alias("cls_b"), F.col("n_words").alias("n_b"), F.col("spot").alias("at_b"))
    longer = F.greatest("n_a", "n_b")
    k = F.floor(longer / ONE_IN)
    shared = F.least(F.lit(SHARED), longer - (WINDOW - 1) - WINDOW * k)
    places = F.shiftright("at_a", 16) - F.shiftright("at_b", 16)
    near = (F.abs(F.col("n_a") - F.col("n_b")) <= k) & (F.abs(places) <= k)
    # a window unspoilt in both texts holds the gram and a word beside it
    beside = [F.col(c).bitwiseAND(F.lit(m)) for m in (0xFF00, 0xFF) for c in ("at_a", "at_b")]
    near = near & ((beside[0] == beside[1]) & (beside[0] != 0) | (beside[2] == beside[3]) & (beside[2] != 0))
    pairs = (
        a.join(b, "hash").where((F.col("cls_a") != F.col("cls_b")) & near)
        .groupBy("cls_a", "cls_b").agg(F.count("*").alias("n"), F.max(shared.cast("int")).alias("least"))
        .where("n * 2 >= least").select("cls_a", "cls_b")  # a hash is the fingerprint of two windows at most
    )
    pairs = durable(pairs, "pairs")  # their number is known before texts are fetched, so few are sent to the texts
    text = texts.select("field", "key", "words", "cls")
    both = (
        pairs.join(text.select("field", F.col("key").alias("key_a"), F.col("words").alias("words_a"), F.col("cls").alias("cls_a")), "cls_a")
        .join(text.select("field", F.col("key").alias("key_b"), F.col("words").alias("words_b"), F.col("cls").alias("cls_b")), ["cls_b", "field"])
    )
    rank = _broadcast(texts, counts)
    aligned = F.pandas_udf(lambda x, y: pd.DataFrame(align(x, y, rank.value), columns=["edits", "aligned"]).astype("int32"), "edits int, aligned int")
    done = both.select("field", "key_a", "key_b", F.size(F.split("words_a", " ")).alias("words"), aligned("words_a", "words_b").alias("x"))
    return done.select("field", "key_a", "key_b", "words", "x.edits", "x.aligned").where("edits >= 0")


FIELDS = ("sci-RCoT", "science_abstract_prompt")


def sided(candidates: DataFrame) -> DataFrame:
    """(id, train, file_key, texts) of the records in one of the three splits; others are in no pair."""
    split = F.lower(F.trim("split"))
    return candidates.where(split.isin("train", "validation", "test")).select(
        F.col("candidate_id").alias("id"), (split == "train").alias("train"), file_key(F.col("image_filename")).alias("file_key"),
        *[F.col(f"`{f}`") for f in FIELDS],
    )


def matches(candidates: DataFrame) -> DataFrame:
    """(eval_id, train_id, field, edits, coverage): every way in which a pair agrees, each once.

    Null and blank values agree with nothing. ``coverage`` is the share of the evaluation text's words that are also
    in the training text, in order; 1 for files and equal texts. Copies of a text are expanded only here.
    """
    records = sided(candidates)
    members, texts = classes(records, FIELDS)
    near = durable(near_classes(texts), "near")
    same = texts.where("train and eval").select("field", F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(1).alias("words"), F.lit(0).alias("edits"), F.lit(1).alias("aligned"))
    linked = near.unionByName(same)
    m = members.distinct()
    by_text = (
        linked.join(m.where(~F.col("train")).select("field", F.col("key").alias("key_a"), F.col("id").alias("eval_id")), ["field", "key_a"])
        .join(m.where("train").select("field", F.col("key").alias("key_b"), F.col("id").alias("train_id")), ["field", "key_b"])
        .select("eval_id", "train_id", "field", "edits", (F.col("aligned") / F.col("words")).alias("coverage"))
    )
    files = records.where("file_key is not null").select("id", "train", "file_key").distinct()
    by_file = (
        files.where(~F.col("train")).select(F.col("id").alias("eval_id"), "file_key")
        .join(files.where("train").select(F.col("id").alias("train_id"), "file_key"), "file_key")
        .select("eval_id", "train_id", F.lit("image_filename").alias("field"), F.lit(0).alias("edits"), F.lit(1.0).alias("coverage"))
    )
    return by_text.unionByName(by_file).where("eval_id <> train_id")


def pair_ids(candidates: DataFrame) -> DataFrame:
    """(candidate_id_a, candidate_id_b), smaller id first, each pair once."""
    return matches(candidates).select(
        F.least("eval_id", "train_id").alias("candidate_id_a"), F.greatest("eval_id", "train_id").alias("candidate_id_b")
    ).distinct()


def report(candidates: DataFrame) -> DataFrame:
    """(split, source, field, n_records, n_pairs, mean_coverage) of the evaluation records that overlap.

    ``n_records`` are evaluation records with a partner, ``mean_coverage`` is over each record's best partner.
    """
    best = matches(candidates).groupBy("eval_id", "field").agg(F.max("coverage").alias("coverage"), F.count_distinct("train_id").alias("n"))
    of = candidates.select(F.col("candidate_id").alias("eval_id"), F.lower(F.trim("split")).alias("split"), "source").distinct()
    return best.join(of, "eval_id").groupBy("split", "source", "field").agg(
        F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
