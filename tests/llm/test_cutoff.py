import random

from figloom.llm import cutoff as C

SCHEMA = "candidate_id long, labels array<string>, term_count int"


def test_cutoffs_equal_brute_force(spark):
    r = random.Random(4)
    rows = [(i, r.choice([["A"], ["B", "A", "A"], ["A", "B", None], [], None, [" "]]), r.choice([None, *range(8)])) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:30], SCHEMA)
    targets = spark.createDataFrame([("A", 30), ("A+B", 55), ("C", 10)], "label_set string, target_pct int")
    records = C.scored(df)
    chosen = C.cutoffs(records, targets)
    got = {x["label_set"]: x for x in chosen.collect()}
    for name, pct in (("A", 30), ("A+B", 55)):
        own = [t for _, ls, t in rows if ls and t is not None and "+".join(sorted({x for x in ls if x and x.strip()})) == name]
        want = max(t for t in own if sum(u >= t for u in own) * 100 >= pct * len(own))
        assert got[name]["cutoff"] == want and got[name]["n_kept"] == sum(u >= want for u in own) and got[name]["n_records"] == len(own)
    assert set(got) == {"A", "A+B"}
    assert C.kept(records, chosen).count() == sum(x["n_kept"] for x in got.values())


def test_all_ties_keep_everything_and_empty_gives_nothing(spark):
    df = spark.createDataFrame([(i, ["A"], 5) for i in range(10)], SCHEMA)
    targets = spark.createDataFrame([("A", 1)], "label_set string, target_pct int")
    row = C.cutoffs(C.scored(df), targets).first()
    assert (row["cutoff"], row["n_kept"], row["kept_pct"]) == (5, 10, 100.0)
    assert C.cutoffs(C.scored(df.limit(0)), targets).count() == 0
