import numpy as np
import pytest
from pyspark.sql import functions as F

from figloom.functions import jsonclean, text
from figloom.operators import filters, geometry, images, models, relevance, resume, segments, stats, training
from figloom.schemas import DETECTION, LEGACY_DIMENSIONS
from figloom.sources import files


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("reply", "score"), [
    ('{"relevance": {"k": 1}}', 1), ('```json\n{"relevance": {"k": 2}}\n```', 2), ('```\n{"relevance": {"k": 3}}\n```', 3), ('Sure! {"relevance": {"k": 4}} ok?', 4),
    ('{"result": {"relevance": {"k": 5}}}', 5), ('{"other": 1}', None), ("no json", None), ("", None), (None, None),
])
def test_relevance_replies(spark, reply, score):
    got = one(spark, reply, lambda c: F.get_json_object(jsonclean.relevance_reply(c), "$.relevance.k"))
    assert (got and int(got)) == score


def test_checklist_reply_has_three_states(spark):
    assert one(spark, None, jsonclean.checklist_reply) is None
    bad = one(spark, "oops", jsonclean.checklist_reply)
    assert bad["error"] == "Invalid JSON returned" and bad["raw"] == "oops" and bad["json"] is None
    good = one(spark, '```json\n{"checklist": []}\n```', jsonclean.checklist_reply)
    assert good["error"] is None and good["json"] == '{"checklist": []}'


def test_keep_decision_reads_words_and_json(spark):
    assert [one(spark, x, jsonclean.keep_decision) for x in (" keep\n", "REJECT", '{"decision": "Keep", "reason": "r"}', "maybe", None)] == ["KEEP", "REJECT", "KEEP", None, None]


def test_strip_takes_line_ends(spark):
    assert one(spark, "\n\t a \r\n", text.strip) == "a"


def test_names(spark):
    assert [one(spark, x, text.basename) for x in ("/a/b.png", "b.png", "", None)] == ["b.png", "b.png", "", ""]
    assert [one(spark, x, text.stem) for x in ("/a/b.c.png", ".png")] == ["b.c", ".png"]
    assert [one(spark, x, text.mime_type) for x in ("a.JPG", "a", "a.webp", None)] == ["image/jpeg", "image/png", "image/webp", "image/png"]


def test_data_url_has_no_line_breaks(spark):
    row = spark.createDataFrame([(bytearray(300), "a.png")], "b binary, p string").select(text.data_url(F.col("b"), F.col("p")).alias("u")).first()
    assert "\n" not in row["u"] and len(row["u"]) == len("data:image/png;base64,") + 400


def test_score_labels_and_legacy_name(spark):
    rows = spark.createDataFrame([({"ScientificLaw": (7.0,), "EntityStructure": (6.9,), "ScientificProcess": (10.0,)},)], "r map<string, struct<score double>>")
    assert rows.select(relevance.score_labels(F.col("r"))).first()[0] == ["ScientificLaw", "ScientificProcess"]
    assert rows.select(relevance.score_labels(F.col("r"), dims=LEGACY_DIMENSIONS)).first()[0] == ["ScientificProcess"]


def test_boxes(spark):
    rows = [
        ("i", 1000, 1000, 0, "Picture", 0.9, 10.0, 10.0, 60.0, 60.0), ("i", 1000, 1000, 1, "Table", 0.9, 0.0, 0.0, 500.0, 500.0),
        ("i", 1000, 1000, 2, "Picture", 0.9, -5.5, -0.2, 300.9, 300.2), ("i", 1000, 1000, 3, "Picture", 0.9, 0.0, 0.0, 800.0, 1000.0),
        ("i", 1000, 1000, 4, "Picture", 0.9, 0.0, 0.0, 750.0, 1000.0), ("i", 1000, 1000, 5, "Picture", 0.9, 300.0, 300.0, 200.0, 500.0),
        ("i", 1000, 1000, 6, "Picture", 0.9, 0.0, 0.0, 900.0, 300.0), ("i", 1000, 1000, 7, "Picture", 0.9, 0.0, 0.0, 128.0, 128.0), ("i", 1000, 1000, 8, "Picture", 0.9, 0.0, 0.0, 127.0, 128.0),
    ]
    got = {r["filename"]: (r["width"], r["height"]) for r in geometry.crops(spark.createDataFrame(rows, DETECTION)).collect()}
    assert got == {"i_02.png": (300, 300), "i_04.png": (750, 1000), "i_06.png": (900, 300), "i_07.png": (128, 128)}


def test_attach_gives_empty_arrays(spark):
    articles = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "image_id int, t string")
    segs = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "image_id int, n int, filename string")
    out = segments.attach_segments(articles, segments.collect_segments(segs, "image_id", ["n"]), "image_id")
    assert {r["t"]: [s["filename"] for s in r["segments"]] for r in out.collect()} == {"x": ["a", "b"], "y": [], "z": []}


def test_fresh_results_win(spark):
    fresh, cache = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9), ("stale", 9)], "k string, v int")
    assert {r["k"]: r["v"] for r in relevance.union_fresh(fresh, cache, "k").collect()} == {"a": 1, "stale": 9}


def test_pad_colour_rules():
    half = np.zeros((4, 20, 3), np.uint8)
    half[:, :11] = (10, 20, 30)  # 55 % of top and bottom
    assert images.fill_colour(half) == (10, 20, 30)
    half[:, 10] = 0
    half[:, 10:] = (0, 0, 40)
    assert images.fill_colour(half) == (5, 10, 35)
    assert images.fill_colour(np.zeros((0, 3, 3), np.uint8)) == (255, 255, 255)
    tall = np.zeros((98, 49, 3), np.uint8)
    tall[:, 0] = tall[:, -1] = 200
    assert images.fill_colour(tall) == (200, 200, 200)


def test_width_49_takes_all_four_edges():
    px = np.zeros((49, 49, 3), np.uint8)
    px[0] = px[-1] = 255
    assert int(49 * (1024 / 49)) == 1023
    assert images.fill_colour(px)[0] == int((4 * 255 + 2 * 49 * 255) / (4 * 49))


def test_png_round_trip_and_standard_canvas():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 255, (13, 29, 3), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    out = images.standardise(px, 64)
    assert out.shape == (64, 64, 3) and (out[0] == images.fill_colour(px, 64)).all()
    flat = np.full((7, 9, 3), 77, np.uint8)
    assert (images.standardise(flat, 32) == 77).all()
    with pytest.raises(ValueError):
        images.standardise(np.zeros((1, 3000, 3), np.uint8), 32)


def test_corrupt_images_are_error_rows(spark):
    df = spark.createDataFrame([("a.jpg", bytearray(b"junk")), ("b.png", bytearray(images.encode_png(np.zeros((2, 2, 3), np.uint8))))], "name string, content binary")
    got = {r["name"]: r["error"] for r in images.standardised(df, 16).collect()}
    assert got["a.png"].startswith("ValueError") and got["b.png"] is None
    assert images.colliding(spark.createDataFrame([("a.jpg",), ("a.png",), ("b.png",)], "name string")).collect()[0]["stem"] == "a"


def test_detector_failures_stay_with_their_image(spark):
    good, bad = images.encode_png(np.zeros((200, 200, 3), np.uint8)), images.encode_png(np.zeros((3, 3, 3), np.uint8))
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(bad)), ("c", bytearray(b""))], "image_id string, content binary").coalesce(1)

    def detector():
        def f(batch):
            if any(p.shape[0] < 10 for p in batch):
                raise RuntimeError("too small")
            return [[("Picture", 0.9, 0.0, 0.0, 150.0, 150.0)] for _ in batch]

        return f

    assert [r["image_id"] for r in images.detect(df, detector).collect()] == ["a"]


def test_retry_waits_and_gives_up():
    waits = []
    r = models.Retry(3, 2.0, sleep=waits.append)
    assert r.call(lambda: 1 / 0) == (None, "ZeroDivisionError: division by zero") and waits == [2.0, 4.0]
    assert models.Retry(3, fixed=2.0, sleep=waits.append).call(lambda: 5) == (5, None)


def test_second_run_calls_only_for_what_is_missing(spark, tmp_path):
    tasks = spark.createDataFrame([(str(i), ["x"] if i else None, "") for i in range(20)], "key string, labels array<string>, context string")
    schema = "key string, reasoning string, sci_rcot string, rendered array<string>, prompt string, retained array<string>, error string"
    stage = lambda t: models.annotate(t, models.StubClient, models.Retry(1))
    path = str(tmp_path / "cache")
    assert resume.run_once(tasks.where("cast(key as int) < 8"), path, stage, schema).count() == 7
    todo = resume.pending(tasks, resume.load_cache(spark, path, schema))
    assert todo.count() == 13
    assert resume.run_once(tasks, path, stage, schema).count() == 19
    assert resume.run_once(tasks, path, stage, schema).count() == 19
    c = resume.counters(tasks, resume.load_cache(spark, path, schema)).first()
    assert (c["total"], c["cached"], c["pending"]) == (20, 19, 1)


def test_correlations_against_plain_counts(spark):
    rng = np.random.default_rng(2)
    xy = [(float(a), float(b)) for a, b in zip(rng.integers(0, 6, 80), rng.integers(0, 5, 80))]
    df = spark.createDataFrame(xy, "x double, y double")
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for i, a in enumerate(xy) for b in xy[:i])
    n1 = sum(a[0] != b[0] for i, a in enumerate(xy) for b in xy[:i])
    n2 = sum(a[1] != b[1] for i, a in enumerate(xy) for b in xy[:i])
    assert abs(stats.kendall(df, "x", "y").first()["tau"] - s / (n1 * n2) ** 0.5) < 1e-7
    assert stats.kendall(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], df.schema), "x", "y").first()["tau"] is None
    assert abs(stats.t_test_p(0.5, 30) - 0.004886) < 2e-5 and stats.t_test_p(1.0, 5) == 0.0


def test_mask_and_truncation(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5])], "p array<int>, a array<int>")
    r = training.masked(df, "p", "a", pad=9).first()
    assert r["input_ids"] == [1, 2, 3, 4, 5, 9] and r["labels"] == [-100] * 3 + [4, 5, 9] and r["attention_mask"] == [1] * 6
    assert training.masked(df, "p", "a", most=4).first()["labels"] == [-100] * 3 + [4]


def test_json_sources_and_versions(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"image_id": "x", "n": 1}, {"image_id": null}]')
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "image_id string, n int").count() == 2
    root = str(tmp_path / "v")
    for n in (1, 2):
        files.publish(spark, root, files.write_version(spark.range(n), root))
    assert files.read_current(spark, root).count() == 2
    out = str(tmp_path / "p")
    files.write_json(spark.createDataFrame([("g", "CoT", None)], "group_name string, half string, x string"), out, ("group_name", "half"))
    assert spark.read.json(out).count() == 1


def test_image_folder(spark, tmp_path):
    rows = spark.createDataFrame([("b.PNG", bytearray(b"1")), ("a.png", bytearray(b"2")), ("c.txt", bytearray(b"3"))], "name string, content binary")
    files.write_images(rows, str(tmp_path / "i"))
    assert [r["name"] for r in files.list_images(spark, str(tmp_path / "i")).collect()] == ["a.png", "b.PNG"]
    assert [r["name"] for r in files.list_images(spark, str(tmp_path / "i"), "png").collect()] == ["a.png"]
    assert [r["name"] for r in files.list_images(spark, str(tmp_path / "i"), prefix="b").collect()] == ["b.PNG"]
    assert files.read_images(spark, str(tmp_path / "i")).count() == 2


def test_refusals_are_the_default(spark):
    rows = spark.createDataFrame([(1, True, "CC BY 4.0", "A figure."), (2, None, "CC BY 4.0", "A figure."), (3, True, "CC BY", "x"), (4, True, None, "x"), (5, True, "CC BY 4.0", "Reproduced with permission from X."), (6, True, "CC BY 4.0", None)], "id int, o boolean, l string, c string")
    kept = filters.open_licence(rows, F.col("o"), F.col("l"), ("CC BY 4.0",), F.col("c"))
    assert sorted(r["id"] for r in kept.collect()) == [1, 6]
    assert sorted(r["id"] for r in filters.private_by_default(rows, F.col("o")).collect()) == [1, 3, 4, 5, 6]
    votes = spark.createDataFrame([(1, "KEEP", 0.9), (2, "REJECT", 0.9), (3, "KEEP", 0.2), (4, "hm", 0.9), (5, None, None)], "id int, r string, c double")
    assert [r["route"] for r in filters.route(votes, F.col("r"), F.col("c")).orderBy("id").collect()] == ["keep", "reject", "review", "review", "review"]
