import random
import re

from figloom.llm import overlap as O

SCHEMA = "candidate_id long, split string, source string, image_filename string, `sci-RCoT` string, science_abstract_prompt string"


def plain_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def test_distance():
    r = random.Random(1)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [r.randrange(4) for _ in range(r.randrange(14))]
        most = r.randrange(8)
        d = plain_distance(a, b)
        assert O.distance(a, b, most) == min(d, most + 1)


def edited(words, k, r):
    w = list(words)
    for _ in range(k):
        at, how = r.randrange(len(w)), r.randrange(3)
        if how == 0:
            w[at] = f"new{r.randrange(99)}"
        elif how == 1:
            w.insert(at, f"ins{r.randrange(99)}")
        elif len(w) > 2:
            del w[at]
    return w


def brute(rows):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    name = lambda f: (f or "").strip().split("/")[-1].strip().lower()
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" or b[1] != "train" or a[1] is None or a[0] == b[0]:
                continue
            ok = name(a[3]) != "" and name(a[3]) == name(b[3])
            for k in (4, 5):
                x, y = words(a[k]), words(b[k])
                if x and y:
                    ok = ok or "".join(x) == "".join(y) or plain_distance(x, y) <= max(len(x), len(y)) // 10
            if ok:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def test_pairs_equal_brute_force(spark):
    r = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    base = [[r.choice(vocab) for _ in range(n)] for n in (3, 6, 9, 10, 11, 18, 20, 29, 30, 40, 55, 80)]
    rows = []
    for i in range(170):
        b = r.choice(base)
        text = " ".join(edited(b, r.randrange(0, 2 + len(b) // 9), r))
        text = r.choice([text, text.upper(), text.replace(" ", ", "), text + "!"])
        rows.append((i, r.choice(["train", "train", "validation", "test", None]), "s", r.choice([None, "", f"/x/F{r.randrange(90)}.png"]), r.choice([text, None, " "]), r.choice([None, " ".join(edited(base[-3], r.randrange(6), r))])))
    got = [tuple(x) for x in O.pair_ids(spark.createDataFrame(rows + rows[:9], SCHEMA)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_copies_unequal_keys_and_report(spark):
    t = " ".join(f"word{i}" for i in range(30))
    rows = [(i, "train", "run", "a.png", t, None) for i in range(20)] + [(100, "test", "run", "b.png", t.upper() + ".", None), (101, "validation", None, "A.PNG", None, None), (102, None, "run", "a.png", t, None), (103, "test", "run", "", "", " ")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(x) for x in O.pair_ids(df).collect()}
    assert got == {(i, 100) for i in range(20)} | {(i, 101) for i in range(20)}
    rep = {(x["split"], x["field"]): (x["n_records"], x["n_pairs"], x["mean_coverage"]) for x in O.report(df).collect()}
    assert rep == {("test", "sci-RCoT"): (1, 20, 1.0), ("validation", "image_filename"): (1, 20, 1.0)}
    assert O.pair_ids(df.limit(0)).count() == 0


def test_ideographs_are_words():
    import pyarrow as pa

    assert O.normalise(pa.array(["图A，b", "  ", None, "É-x"])).to_pylist() == ["图 a b", None, None, "é x"]


def plain_common(a, b):
    d = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], prev + 1 if x == y else max(d[j], d[j - 1])
    return d[-1]


def test_common_words_chains_and_extension():
    r = random.Random(2)
    for _ in range(300):
        a = [r.randrange(5) for _ in range(r.randrange(16))]
        b = [r.randrange(5) for _ in range(r.randrange(16))]
        assert O.common(a, b) == plain_common(a, b)
        seeds = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
        r.shuffle(seeds)
        c = O.chain([i for i, _ in seeds], [j for _, j in seeds])
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(c, c[1:])) and len(c) == plain_common(a, b)
        d = plain_distance(a, b)
        assert d <= O.extended(a, b, c, 99) and O.extended(a, b, [], 99) == d and O.extended(a, b, c, 2) <= 3


def test_report_equals_brute_force(spark):
    r = random.Random(9)
    base = [[f"w{r.randrange(40)}" for _ in range(n)] for n in (12, 30, 61)]
    rows = [(i, r.choice(["train", "test", "validation"]), r.choice(["a", "b", None]), None, " ".join(edited(r.choice(base), r.randrange(4), r)), None) for i in range(90)]
    rows += [(200, "test", "c", None, " ".join(f"v{i}" for i in range(30)), None), (201, "train", "c", None, " ".join(["x", *(f"v{i}" for i in range(30)), "y"]), None)]
    best, partners = {}, {}
    for a in rows:
        for b in rows:
            x, y = a[4].split(), b[4].split()
            if a[1] != "train" and b[1] == "train" and plain_distance(x, y) <= max(len(x), len(y)) // 10:
                best[a[0]] = max(best.get(a[0], 0), plain_common(x, y) / len(x))
                partners[a[0]] = partners.get(a[0], 0) + 1
    want = {}
    for i, s, source, *_ in rows:
        if i in best:
            n, p, c = want.get((s, source), (0, 0, 0.0))
            want[s, source] = (n + 1, p + partners[i], c + best[i])
    got = {(x["split"], x["source"]): (x["n_records"], x["n_pairs"], x["mean_coverage"]) for x in O.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (n, p, round(c / n, 6)) for k, (n, p, c) in want.items()} and got["test", "c"] == (1, 1, 1.0)


def test_more_grams_than_counters_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(O, "LEAST_BITS", 12)
    monkeypatch.setattr(O, "MOST_BITS", 12)
    r = random.Random(4)
    stock = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(600):
        own = [f"u{r.randrange(9000)}" for _ in range(30)]
        rows.append((i, "train", None, None, " ".join(stock + own), None))
        rows.append((1000 + i, "test", None, None, " ".join(edited(stock + own, r.randrange(9), r)), None))
    got = {tuple(x) for x in O.pair_ids(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = {i: t.split() for i, _, _, _, t, _ in rows}
    want = {(i, 1000 + i) for i in range(600) if plain_distance(texts[i], texts[1000 + i]) <= max(len(texts[i]), len(texts[1000 + i])) // 10}
    assert got == want and len(want) > 300
    assert O.ranks(O.np.array([0, 65_535, 10**6, 10**12])).tolist() == [0, 64, 80, 159]
