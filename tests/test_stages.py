"""Model stages, resumption, sources of images and versions, bounded statistics."""

import json
import threading
import time
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from figloom.functions import jsonclean
from figloom.operators import checklist, images, models, resume, sampling, segments, select, stats
from figloom.plans import stages
from figloom.session import durable, forget, release, run_folder
from figloom.settings import Settings
from figloom.sources import files


class Recorder(models.StubClient):
    """Answers with what it was asked; one key gives answers of wrong types."""

    open = 0
    most = 0
    lock = threading.Lock()

    def complete(self, system, user, image=None, temperature=0.1):
        with Recorder.lock:
            Recorder.open += 1
            Recorder.most = max(Recorder.most, Recorder.open)
        time.sleep(0.02)
        with Recorder.lock:
            Recorder.open -= 1
        if user.startswith("bad") and system == "reasoning":
            return '{"reasoning": ["a"]}'
        if user.startswith("list") and system == "long":
            return '{"sci_RCoT": 5, "rendered_text": "x"}'
        if system == "judge":
            return json.dumps({"evaluation_results": [{"category": user, "answer": str(len(image or b"")), "reason": ""}]})
        if system == "relevance":
            return f"{len(image or b'')} open {Recorder.most}"
        return super().complete(system, user, image, temperature)


def test_images_and_checklists_reach_the_model(spark):
    tasks = spark.createDataFrame([("a", bytearray(b"12345")), ("b", None)], "key string, image binary")
    assert {r["key"]: r["reply"].split()[0] for r in models.classify(tasks, Recorder, models.Retry(1)).collect()} == {"a": "5", "b": "0"}
    asked = spark.createDataFrame([("a", "prompt", None, bytearray(b"123"), "q1?"), ("b", "prompt", None, None, None), ("c", None, "Prompt not found", None, None)], "key string, text string, error string, image binary, checklist string")
    got = {r["key"]: r for r in models.judge(asked, Recorder, models.Retry(1)).collect()}
    first = json.loads(got["a"]["verdicts"])["evaluation_results"][0]
    assert "q1?" in first["category"] and first["answer"] == "3" and got["c"]["error"] == "Prompt not found" and got["c"]["verdicts"] is None
    each = models.judge_by_each(asked, {"x": Recorder, "y": models.StubClient}, models.Retry(1))
    assert each.groupBy("judge").count().count() == 2 and each.count() == 6


def test_requests_run_side_by_side(spark):
    tasks = spark.range(24).select(F.col("id").cast("string").alias("key")).coalesce(1)
    most = max(int(r["reply"].split()[-1]) for r in models.classify(tasks, Recorder, models.Retry(1), threads=6).collect())
    assert 3 <= most <= 6


def test_a_bad_reply_fails_its_row_only(spark):
    rows = [(k, ["x"], "") for k in ("bad", "list", "good", "fine")] + [("none", None, "")]
    got = {r["key"]: r for r in models.annotate(spark.createDataFrame(rows, "key string, labels array<string>, context string"), Recorder, models.Retry(1)).collect()}
    assert got["bad"]["error"].startswith("TypeError") and got["list"]["error"].startswith("TypeError") and got["none"]["error"] == "missing labels"
    assert got["good"]["error"] is None and got["good"]["prompt"] and got["fine"]["reasoning"]


def test_jitter_differs_by_key_and_is_the_same_on_every_run():
    def waits(key):
        out = []
        models.Retry(3, 1.0, jitter=1.0, sleep=out.append).call(lambda: 1 / 0, key)
        return out

    assert waits("a") == waits("a") != waits("b")


def test_two_steps_always_pass_the_planner(spark):
    df = spark.createDataFrame([("1", "a prompt"), ("2", None)], "key string, text string")
    got = {r["key"]: r for r in models.generate(df, models.StubClient, models.StubClient).collect()}
    assert got["1"]["long"].startswith("plan ") and bytes(got["1"]["image"]) == f"image of {got['1']['long']}".encode() and got["2"]["error"]


def test_keep_decisions(spark):
    df = spark.createDataFrame([(str(i),) for i in range(30)], "key string")
    got = models.decide(df, models.StubClient, models.Retry(1)).select(jsonclean.keep_decision(F.col("reply")).alias("d"))
    assert {r["d"] for r in got.collect()} == {"KEEP", "REJECT", None}


def test_a_run_that_dies_keeps_its_batches(spark, tmp_path):
    tasks = spark.range(60).select(F.col("id").cast("string").alias("key"))
    path, schema, asked = str(tmp_path / "cache"), "key string, reply string, error string", str(tmp_path / "asked")
    bad = tasks.where(F.pmod(F.xxhash64("key"), F.lit(6)) == 3).first()["key"]

    def stage(broken):
        def run(t):
            t.select("key").write.mode("append").parquet(asked)

            def answer(batches):
                for b in batches:
                    if broken and bad in set(b["key"]):
                        raise RuntimeError("the service is gone")
                    b["reply"], b["error"] = "x", None
                    yield b[["key", "reply", "error"]]

            return t.mapInPandas(answer, schema)

        return run

    with pytest.raises(Exception, match="the service is gone"):
        resume.run_once(tasks, path, stage(True), schema, flush=10)
    done = {r["key"] for r in resume.load_cache(spark, path, schema).collect()}
    assert 30 < len(done) < 60 and bad not in done
    before = spark.read.parquet(asked).count()
    assert resume.run_once(tasks, path, stage(False), schema, flush=10).count() == 60
    assert spark.read.parquet(asked).count() - before == 60 - len(done)
    assert resume.append_outputs(tasks, tasks).count() == 120


def test_jpeg_files_are_decoded(spark, tmp_path):
    jvm = spark.sparkContext._jvm
    page = jvm.java.awt.image.BufferedImage(40, 20, 1)
    for x in range(40):
        for y in range(20):
            page.setRGB(x, y, 0xC80A1E)
    jvm.javax.imageio.ImageIO.write(page, "jpg", jvm.java.io.File(str(tmp_path / "a.jpg")))
    (tmp_path / "b.png").write_bytes(images.encode_png(np.full((8, 6, 4), 90, np.uint8)))
    (tmp_path / "c.jpeg").write_bytes(b"junk")
    (tmp_path / "d.txt").write_bytes(b"no image")
    got = files.read_pixels(spark, str(tmp_path))
    size = {r["name"]: (r["width"], r["height"]) for r in got.collect()}
    assert size == {"a.jpg": (40, 20), "b.png": (6, 8), "c.jpeg": (None, None)}
    fill = {r["name"]: r for r in images.pad_colours(got).collect()}
    assert all(abs(fill["a.jpg"][c] - v) < 6 for c, v in zip("rgb", (0xC8, 0x0A, 0x1E))) and fill["b.png"]["r"] == 90 and fill["c.jpeg"]["error"]
    assert {r["name"]: r["error"] is None for r in images.standardised(got, 32).collect()} == {"a.png": True, "b.png": True, "c.png": False}
    heads = got.select("name", images.png_size(F.col("content")).alias("s")).collect()
    assert {r["name"]: r["s"] and tuple(r["s"]) for r in heads} == {"a.jpg": (40, 20), "b.png": (6, 8), "c.jpeg": None}


def test_split_layout_and_pointers(spark, tmp_path):
    rows = spark.createDataFrame([("g", "CoT", "a.png"), ("g", "prompt", "b.png"), ("h", "CoT", "gone.png")], "group_name string, half string, image_filename string")
    pics = spark.createDataFrame([("a.png", bytearray(b"1")), ("b.png", bytearray(b"2"))], "name string, content binary")
    root = str(tmp_path / "out")
    files.write_split(rows, pics, root)
    assert (tmp_path / "out/group_name=g/half=CoT/images/a.png").read_bytes() == b"1" and (tmp_path / "out/group_name=g/half=prompt/images/b.png").exists()
    versions = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        files.read_current(spark, versions)
    for n in (1, 2, 3):
        files.publish(spark, versions, files.write_version(spark.range(n), versions))
        assert files.read_current(spark, versions).count() == n
    (tmp_path / "v" / ".pointer-dead").write_text("half")
    assert files.read_current(spark, versions).count() == 3


def test_one_row_of_each_key_with_nulls_ties_and_odd_names(spark):
    df = spark.createDataFrame([(None, 1, "a"), (None, None, "b"), ("k", 2, "c"), ("k", 3, None), ("k", 3, None)], "`the key` string, n int, `sci-RCoT` string")
    last = {r["the key"]: (r["n"], r["sci-RCoT"]) for r in segments.keep_last(df, ["the key"], ["n"]).collect()}
    first = {r["the key"]: (r["n"], r["sci-RCoT"]) for r in segments.keep_first(df, ["the key"], ["n"]).collect()}
    assert last == {None: (1, "a"), "k": (3, None)} and first == {None: (None, "b"), "k": (2, "c")}
    assert segments.keep_last(df.limit(0), ["the key"], ["n"]).columns == df.columns
    plan = segments.keep_last(df, ["the key"], ["n"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_bands_read_their_input_once(spark):
    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") < 300, "g").otherwise("h").alias("group_name"), *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(40)).cast("int").alias(c) for k, c in enumerate(select.CHAIN)])
    got = select.iqr_chain(rows)
    pdf = rows.toPandas()
    for c in select.CHAIN:
        q = pdf.groupby("group_name")[c].quantile([0.25, 0.75]).unstack()
        pdf = pdf[(pdf[c] >= pdf.group_name.map(q[0.25]) - 1) & (pdf[c] <= pdf.group_name.map(q[0.75]) + 1)]
    assert {r["id"] for r in got.collect()} == set(pdf["id"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 4
    assert {r["stage"]: r["n"] for r in select.stage_counts(rows).groupBy("stage").agg(F.sum("n").alias("n")).collect()}[3] == len(pdf)


def test_hands_and_ranks_do_not_meet_in_one_task(spark):
    rows = spark.range(1000).select("id")
    dealt = sampling.deal(rows, "id", 7)
    sizes = [r["n"] for r in dealt.groupBy("hand").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1 and dealt.columns == ["id", "hand"]
    xy = rows.select((F.xxhash64("id") / 1e15).alias("x"), (F.xxhash64("id") / 1e15 + F.pmod("id", F.lit(9)) * 300).alias("y"))
    pdf = xy.toPandas()
    assert abs(stats.spearman(xy, "x", "y").first()["rho"] - pdf.x.rank().corr(pdf.y.rank())) < 1e-6
    with pytest.raises(ValueError, match="distinct pairs"):
        stats.kendall(xy, "x", "y", most_pairs=10)
    assert stats.spearman(xy.limit(0), "x", "y").first()["n"] == 0


def test_durable_tables_can_be_given_up(spark):
    a, b = durable(spark.range(3)), durable(spark.range(4))
    release(a)
    release(spark.range(2))
    assert b.count() == 4 and run_folder(spark) in a._figloom_path
    forget(spark)
    with pytest.raises(Exception):  # noqa: B017
        b.count()
    assert durable(spark.range(5)).count() == 5


def test_settings_come_from_session_and_environment(spark, monkeypatch):
    assert Settings.of() == Settings()
    spark.conf.set("spark.figloom.threads", "3")
    monkeypatch.setenv("FIGLOOM_IQR_SLACK", "0.5")
    assert (Settings.of(spark).threads, Settings.of(spark).iqr_slack) == (3, 0.5)
    monkeypatch.setenv("FIGLOOM_THREADS", "many")
    with pytest.raises(ValueError, match="threads is no int"):
        Settings.of(spark)
    spark.conf.unset("spark.figloom.threads")


def test_json_text_and_templates(spark):
    df = spark.createDataFrame([({"k": "é😀"}, "x", None), ({"k": "plain"}, "y \"q\"", "z")], "m map<string,string>, a string, b string")
    got = df.select(checklist.json_text(F.col("m")).alias("u"), checklist.json_text(F.col("m"), True).alias("t"), checklist.fill_template("{a}-{b}", {"a": F.col("a"), "b": F.col("b")}).alias("f")).collect()
    assert [r["u"] for r in got] == ['{"k":"é😀"}', '{"k":"plain"}']
    assert json.loads(got[0]["t"]) == {"k": "é😀"} and got[0]["t"].isascii() and got[0]["t"] == json.dumps({"k": "é😀"}, separators=(",", ":"))
    assert tuple(got[0]["f"]) == (None, "missing b") and tuple(got[1]["f"]) == ('y "q"-z', None)


def test_detection_decodes_one_batch_at_a_time(spark):
    page = bytearray(images.encode_png(np.zeros((1000, 1000, 3), np.uint8)))
    df = spark.range(500, numPartitions=1).select(F.col("id").cast("string").alias("image_id"), F.lit(page).alias("content"))

    def held():
        def mb():
            with open("/proc/self/status") as f:
                return float(next(x for x in f if x.startswith("VmRSS")).split()[1]) / 1024

        return lambda pages: [[("x", 0.5, mb(), 0.0, 0.0, 0.0)] for _ in pages]

    got = images.detect(df, held).collect()
    assert len(got) == 500 and max(r["x1"] for r in got) < 700  # 1,500 MB when all are decoded first


def test_pages_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(images, "PART", 50_000)
    sizes = pd.DataFrame({"name": [str(i) for i in range(60)], "w": [400 + i for i in range(60)], "h": [300] * 60})
    parts = list(stages.drawn(iter([sizes, sizes[:0], sizes[:1]])))
    assert len(parts) > 3 and [n for p in parts for n in p["name"]] == [*sizes["name"], "0"]
    assert all(sum(map(len, p["content"])) < 80_000 for p in parts)
    px = images.decode_png(parts[0]["content"][3])
    y, x = np.mgrid[0:300, 0:403]
    assert px.shape == (300, 403, 3) and (px == np.dstack([x * 7 % 256, y * 5 % 256, (x + y) % 256])).all()


def _sized(spark, path, sizes):
    """The folder of a metadata table with one figure whose segments have these sizes."""
    segs = ", ".join(f"named_struct('width', {w}, 'height', {h})" for w, h in sizes)
    spark.sql(f"select 1L as row_id, array({segs}) as segments").coalesce(1).write.parquet(f"{path}/metadata.parquet")
    return str(path)


def test_pad_colour_of_odd_sizes_made_in_parts(spark, tmp_path):
    d = _sized(spark, tmp_path, [(1, 1), (1, 1400), (1400, 1), (49, 1024), (1024, 49), (300, 300), (2, 3), ("null", 5), (0, 5)])
    got = stages.pad_color(spark, d)
    assert "ArrowEvalPython" not in got._jdf.queryExecution().executedPlan().toString()  # it answers a batch at once
    con = duckdb.connect()
    con.execute(f"create view metadata as select * from '{d}/metadata.parquet/*.parquet'")
    want = con.execute(stages.ORACLE["pad_color"]).fetchall()
    assert len(want) == 7 and sorted(map(tuple, got.collect())) == sorted(want)


def test_image_sizes_of_odd_pages_made_in_parts(spark, tmp_path):
    d = _sized(spark, tmp_path, [(1, 1), (1, 1400), (1400, 1), (257, 256), ("null", 5), (0, 5), (5, -1)])
    got = stages.image_sizes(spark, d)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "ArrowEvalPython" not in plan  # pages are drawn, and not as one answer to a batch
    assert {tuple(r) for r in got.collect()} == {("1_0.png", 1, 1), ("1_1.png", 1, 1400), ("1_2.png", 1400, 1), ("1_3.png", 257, 256)}
    assert len(stages.draw(1400, 1400)) < 60_000  # of 5,880,000 bytes of pixels; 1,069,519 before


def test_pages_are_drawn_without_laying_them_out(spark, tmp_path):
    tracemalloc.start()
    try:
        large = stages.draw(6000, 6000)
        assert tracemalloc.get_traced_memory()[1] < 10 << 20  # 218 MB when its pixels and its rows were laid out
    finally:
        tracemalloc.stop()
    sizes = [(1, 1), (1, 1400), (1400, 1), (2, 2), (255, 129), (256, 257), (764, 513), (50_000, 3), (3, 50_000)]
    pages = {f"{w}_{h}.png": (w, h, stages.draw(w, h)) for w, h in [*sizes, (6000, 6000)]}
    assert pages["6000_6000.png"][2] == large
    for name, (w, h, page) in pages.items():
        y, x = np.ogrid[:h, :w]
        assert (images.decode_png(page) == np.dstack(np.broadcast_arrays(x * 7 % 256, y * 5 % 256, (x + y) % 256))).all(), (w, h)
        if max(w, h) < 2000:
            (tmp_path / name).write_bytes(page)
    got = files.read_pixels(spark, str(tmp_path)).collect()  # by the JVM's decoder, which takes the checksums
    assert len(got) == 7
    for r in got:
        w, h, page = pages[r["name"]]
        assert (r["width"], r["height"]) == (w, h) and (images.decode_png(bytes(r["content"])) == images.decode_png(page)).all()


def test_quarters_are_cut_without_moving_pages(spark, tmp_path):
    d = _sized(spark, tmp_path, [(2, 2), (3, 1400), (1400, 7), (257, 256), ("null", 5)])
    got = stages.pixel_crop(spark, d)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "segments" in plan  # from the table itself, not from pages written between
    assert {tuple(r) for r in got.collect()} == {("part_1_0.png", 1, 1, None), ("part_1_1.png", 1, 700, None), ("part_1_2.png", 700, 3, None), ("part_1_3.png", 128, 128, None)}
    rng = np.random.default_rng(0).integers(0, 256, (9, 8, 4), dtype=np.uint8)
    pics = spark.createDataFrame([("a", bytearray(images.encode_png(rng))), ("b", bytearray(b"junk"))], "image_id string, content binary")
    boxes = spark.createDataFrame([("a", "x", 1, 2, 5, 7), ("a", "y", 3, 3, 3, 9), ("b", "z", 0, 0, 1, 1), (None, "n", 0, 0, 1, 1)], "image_id string, filename string, x1 int, y1 int, x2 int, y2 int")
    parts = {r["name"]: r for r in images.cropped(pics, boxes).collect()}
    assert set(parts) == {"x", "y", "z"} and (images.decode_png(bytes(parts["x"]["content"])) == rng[2:7, 1:5, :3]).all()
    assert parts["x"]["error"] is None and "empty box" in parts["y"]["error"] and "no PNG" in parts["z"]["error"]


def test_canvases_are_handed_on_in_parts(monkeypatch):
    monkeypatch.setattr(images, "PART", 50_000)
    page = images.encode_png(np.random.default_rng(1).integers(0, 256, (90, 90, 3), dtype=np.uint8))
    asked = []

    def one(r):
        asked.append(r.name)
        return (page,)

    rows = pd.DataFrame({"name": list("abcdefghij"), "content": [page] * 10})
    parts = images._safely(iter([rows]), one, ["name", "content", "error"])
    assert len(next(parts)) == 3 and len(asked) == 3  # all ten before
    assert sum(map(len, parts)) == 7


def test_scaling_in_blocks_equals_the_whole_product():
    def whole(n, m, a=3):
        scale = max(1.0, n / m)
        x = (np.arange(n)[None, :] + 0.5 - ((np.arange(m) + 0.5) * n / m)[:, None]) / scale
        w = np.where(np.abs(x) < a, np.sinc(x) * np.sinc(x / a), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    rng = np.random.default_rng(2)
    for h, w, nh, nw in ((90, 70, 300, 233), (400, 500, 40, 50), (1, 1, 130, 130), (64, 7, 64, 300), (130, 129, 1, 2), (300, 2, 150, 1), (1400, 3, 1024, 2)):
        px = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        want = np.einsum("mh,nw,hwc->mnc", whole(h, nh), whole(w, nw), px.astype(np.float64), optimize=True)
        got = images.resize(px, nw, nh)
        assert got.shape == (nh, nw, 3) and np.abs(got - np.clip(want, 0, 255)).max() <= 0.5 + 1e-9
