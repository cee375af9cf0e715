from pyspark.sql import functions as F

from figloom.llm import mixture as M

TARGETS = [("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 2), ("gone", 0.1, 9)]


def test_shares_and_caps(spark):
    sizes = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 4400, "b").when(F.col("id") < 5900, "c").otherwise("other").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    plan = M.rates(sizes, spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int"))
    rate = {r["source"]: r["rate"] for r in plan.collect()}
    assert rate["b"] == 4.0 and rate["gone"] == 0.0 and abs(rate["a"] - 4 * 400 / 0.3 * 0.5 / 4000) < 1e-6
    mixed = M.mix(sizes, plan)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 4
    rep = {r["source"]: r for r in M.report(mixed, plan).collect()}
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9 and rep["gone"]["n_rows"] == 0
    for k in "abc":
        assert abs(rep[k]["actual_share"] - rep[k]["share"]) < 0.02
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, M.mix(sizes, plan).collect()))


def test_names_are_normalised_and_empty_input_gives_an_empty_mix(spark):
    docs = spark.createDataFrame([(1, " A ", "one two"), (2, "a", ""), (3, None, "x"), (4, "a", None)], "doc_id long, source string, text string")
    sizes = M.sized(docs)
    targets = spark.createDataFrame([("a", 1.0, 2), ("A", 0.0, 2)], "source string, target_share double, max_repeats int")
    plan = M.rates(sizes, targets)
    assert [(r["source"], r["n_docs"], r["rate"]) for r in plan.collect()] == [("a", 3, 2.0)]
    assert sorted((r["doc_id"], r["copy_no"]) for r in M.mix(sizes, plan).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2)]
    none = M.rates(sizes.limit(0), targets)
    assert M.mix(sizes.limit(0), none).count() == 0 and M.report(M.mix(sizes.limit(0), none), none).first()["actual_share"] == 0.0


def test_a_size_is_filled_as_far_as_repeats_allow(spark):
    sizes = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2900, "big").otherwise("small").alias("source"), F.lit(10).cast("long").alias("n_tokens"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3)], "source string, target_share double, max_repeats int")
    plan = M.rates(sizes, targets, 20_000)
    rep = {r["source"]: r for r in M.report(M.mix(sizes, plan), plan).collect()}
    assert rep["small"]["rate"] == 3.0 and rep["small"]["mixed_tokens"] == 3000 and abs(rep["big"]["mixed_tokens"] - 10_000) < 500
    assert rep["small"]["actual_share"] < 0.25 < rep["small"]["share"]
    again = {r["source"]: r["rate"] for r in M.rates(sizes, targets, F.lit(20_000)).collect()}
    assert again == {k: r["rate"] for k, r in rep.items()}
    assert M.rates(sizes.limit(0), targets, 100).agg(F.sum("rate")).first()[0] == 0
