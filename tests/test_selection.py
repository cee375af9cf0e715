from pyspark.sql import functions as F

from figloom.operators import checklist, sampling, score, segments, select
from figloom.schemas import REASONING


def reasoning(spark, value):
    return spark.createDataFrame([(value,)], f"r {REASONING}")


T = {"terms": ["a"], "visualization": []}


def test_null_absent_and_empty_tracks_stay_apart(spark):
    r = reasoning(spark, {"ScientificLaw": {"terms": [], "visualization": None}, "EntityStructure": None, "Other": {"terms": [], "visualization": []}, "ScientificProcess": {"terms": [], "visualization": ["v"]}})
    out = r.select(select.null_out_empty(F.col("r")).alias("r")).first()["r"]
    assert out["ScientificLaw"] is None and out["EntityStructure"] is None
    assert out["Other"] is not None and out["ScientificProcess"] is not None


def test_labels_follow_terms_or_both(spark):
    r = reasoning(spark, {"ScientificProcess": T, "ScientificLaw": T | {"visualization": ["x"]}, "Odd": T})
    row = r.select(select.content_labels(F.col("r")).alias("a"), select.content_labels(F.col("r"), True).alias("b"), select.term_count(F.col("r")).alias("n")).first()
    assert row["a"] == ["ScientificLaw", "ScientificProcess"] and row["b"] == ["ScientificLaw"] and row["n"] == 2
    empty = reasoning(spark, None).select(select.content_labels(F.col("r")).alias("a"), select.term_count(F.col("r")).alias("n")).first()
    assert empty["a"] == [] and empty["n"] == 0


def test_group_names(spark):
    rows = spark.createDataFrame([(["A", "B"],), (["A", "B", "C"],), (["A"],), ([],)], "l array<string>")
    assert [r[0] for r in rows.select(select.group_name(F.col("l"))).collect()] == ["A_B", "All_Three", None, None]


def test_bands_are_taken_of_the_survivors_and_widened_by_one(spark):
    rows = spark.createDataFrame([("g", v, 0, 0) for v in (0, 10, 10, 10, 11, 30)], "group_name string, term_count int, rendered_len int, retained_len int")
    assert sorted(r["term_count"] for r in select.iqr_band(rows, "group_name", "term_count").collect()) == [10, 10, 10, 11]
    assert sorted(r["term_count"] for r in select.iqr_band(rows, "group_name", "term_count", 0.0).collect()) == [10, 10, 10]
    chained = spark.createDataFrame([("g", 10, 1, 0), ("g", 10, 1, 0), ("g", 10, 1, 0), ("g", 99, 50, 0)], rows.schema)
    assert select.iqr_chain(chained).count() == 3


def test_value_at_the_median_goes_to_cot(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "group_name string, term_count int")
    assert {r["term_count"]: r["half"] for r in select.median_split(rows).collect()} == {1: "prompt", 2: "CoT", 3: "CoT"}


def test_two_key_match_prefers_the_file_name_and_the_last_caption(spark):
    seg = spark.createDataFrame([(1, "a.png", "/x/b.png"), (2, None, "/x/b.png"), (3, "none.png", "/x/b.png"), (4, "", None)], "k int, filename string, path string")
    cap = spark.createDataFrame([(1, "/c/a.png"), (2, "/d/a.png"), (3, "b.png"), (4, None)], "row_id int, image_path string")
    assert {r["k"]: r["row_id"] for r in select.match_captions(seg, cap).collect()} == {1: 2, 2: 3, 3: 3}


def test_keep_first_takes_null_as_a_key(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "pos int, filename string")
    assert sorted(r["pos"] for r in segments.keep_first(rows, ["filename"], ["pos"]).collect()) == [1, 3]
    assert sorted(r["pos"] for r in segments.keep_last(rows, ["filename"], ["pos"]).collect()) == [2, 4]


def test_removal_keeps_emptied_arrays_and_unnamed_segments(spark):
    seg = "array<struct<filename string, width int, height int, labels array<string>, path string>>"
    rows = spark.createDataFrame([(1, [("a", 1, 1, None, None), (None, 1, 1, None, None)]), (2, [("a", 1, 1, None, None)]), (3, None), (4, [])], f"id int, segments {seg}")
    missing = spark.createDataFrame([("a",)], "name string")
    out = {r["id"]: r["segments"] for r in select.segments_without_missing(rows, missing, "id").collect()}
    assert [s["filename"] for s in out[1]] == [None] and out[2] == [] and out[3] is None and out[4] == []


def test_explode_tasks_falls_back_or_drops(spark):
    seg = "array<struct<filename string, width int, height int, labels array<string>, path string>>"
    rows = spark.createDataFrame(
        [(1, [("a.png", 1, 1, ["x"], "/p/a.png"), None, (None, 1, 1, None, "/p/b.png"), (None, 1, 1, None, None)], None, None), (2, [], "/l/c.png", "/i/d.png"), (3, None, "", "/i/d.png"), (4, None, None, None)],
        f"id int, segments {seg}, local_path string, image_path string",
    )
    out = {(r["id"], r["place"]): (r["filename"], r["path"], r["task_key"]) for r in segments.explode_tasks(rows, "/img").collect()}
    assert out[(1, 0)] == ("a.png", "/img/a.png", "/img/a.png") and out[(1, 2)][0] == "b.png" and out[(1, 3)] == (None, None, None)
    assert out[(2, 0)] == ("c.png", "/img/c.png", "/img/c.png") and out[(3, 0)][0] == "d.png" and len(out) == 5


def test_veto_is_monotone_and_errors_can_be_left_out(spark):
    rows = spark.createDataFrame([("i", "m", "Text", "Yes"), ("i", "m", "Text", " yes "), ("j", "m", "Text", "No"), ("k", "m", "Text", None), ("k", "m", "Text", "Yes")], "image_filename string, mode string, category string, answer string")
    got = {r["image_filename"]: r["strict"] for r in score.sample_scores(rows).collect()}
    assert got == {"i": True, "j": False, "k": False}
    assert {r["image_filename"]: r["strict"] for r in score.sample_scores(rows, errors="exclude").collect()}["k"] is True
    a = score.accuracy(score.sample_scores(rows), ["category"]).first()
    assert a["n"] == 3 and a["strict"] == 33.333333 and a["strict"] <= a["at_threshold"]


def test_four_of_five_reach_the_threshold(spark):
    rows = spark.createDataFrame([("i", "m", "Text", x) for x in ("Yes", "Yes", "Yes", "Yes", "No")], "image_filename string, mode string, category string, answer string")
    a = score.accuracy(score.sample_scores(rows), ["category"]).first()
    assert (a["strict"], a["at_threshold"], a["average"]) == (0.0, 100.0, 80.0)


def test_judge_requests_route_errors(spark):
    items = spark.createDataFrame([("a", "cot"), ("b", "abstract"), ("c", "cot"), (None, "cot")], "image_filename string, mode string")
    prompts = spark.createDataFrame([(1, "a", "old", "s"), (2, "a", "new", "s"), (3, "b", "long", "")], "pos int, image_filename string, long string, short string")
    images = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    out = {r["image_filename"]: (r["prompt"], r["error"]) for r in checklist.judge_requests(items, prompts, images, "pos").collect()}
    assert out == {"a": ("new", None), "b": (None, "Prompt not found"), "c": (None, "Image file not found"), None: (None, "Image file not found")}


def test_quota_takes_the_first_in_hash_order_of_hot_groups(spark):
    rows = spark.range(500).select("id", F.when(F.col("id") < 400, "hot").otherwise("cold").alias("g"))
    got = sampling.quota(rows, ["g"], "id", 7)
    import hashlib

    for g, ids in (("hot", range(400)), ("cold", range(400, 500))):
        want = sorted(sorted(ids, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:7])
        assert sorted(r["id"] for r in got.where(F.col("g") == g).collect()) == want


def test_split_is_a_partition_and_short_data_gives_no_train(spark):
    rows = spark.range(30).withColumnRenamed("id", "position")
    assert {r["part"] for r in sampling.head_split(rows, "position").collect()} == {"test"}
