import numpy as np
import pytest

from figloom.llm import pairs as P

EN = "Rendered as a chart, the scene opens on a woven kelp placed near the centre. The axis is titled \"X1\" and the other one \"Y2\". No other wording appears in the picture."
DE = "Außerdem zeigt die Skizze, wie das geprüfte Gitter größer wird. Der Wärmefluss liegt neben der Marke und misst viel."
FR = "La légende précise que la membrane plissée dépasse la forêt côtière. Une flèche relie la couche poreuse à la zone où repose le récif."
ZH = "图中右侧的薄膜没有接触神经元。示意图还显示囊泡在冷却后如何增大。"
Q = "Flat vector drawing: woven kelp, feathered axon and receptor; channel tunnelling at 32.0 µm; text \"Stage 8e\"; ochre ground."


@pytest.mark.parametrize("a", [None, "", " \n", "​", "﻿", "n/a", "N/A", "None", "[]", "{}", "...", "... ... ...", "-", '""', "TBD", "null", "\xa0 \xa0"])
def test_empty(a):
    assert P.is_empty(a)


REFUSALS = P.Refusals.fit([x for t in (EN, DE, FR, ZH) * 3 for x in P.sentences(t)] + ["The eroded pulsar bends the arrow.", "The gate carries the sign in the left margin.", "Two lobes flank the near body."])


@pytest.mark.parametrize("a", ["Request declined.", "Cannot comply.", "I'm sorry, but I can't describe this figure.", "As a text model, it is not possible for me to draw up the text.", "Leider darf ich darauf nicht antworten.", "Je ne suis pas en mesure de répondre.", "抱歉，我无法描述这张图。", "This request goes against my guidelines at this time.", "Unfortunately, no description can be given by me."])
def test_refusal(a):
    assert REFUSALS.is_refusal(a) and not P.is_empty(a)


@pytest.mark.parametrize("a", [EN, EN + ' The sign reads "I cannot help with that request".', DE, FR, ZH, "The eroded pulsar cannot pass the gate, so the arrow bends."])
def test_no_refusal(a):
    assert not REFUSALS.is_refusal(a)


@pytest.mark.parametrize("a", [Q, Q.upper(), f"“{Q}”", "Sure, here is the description: " + Q, Q + "\n" + Q, Q.lower().replace(",", "").replace(":", ""), Q.replace("feathered", "striped"), "  ".join(Q.split())])
def test_copy(a):
    assert P.is_copy(Q, a)


def test_copy_after_a_foreign_lead_in():
    assert P.is_copy(ZH[:15], "Expand the prompt into a long scene description. " + ZH[:15])
    assert not P.is_copy(ZH[16:], ZH)


@pytest.mark.parametrize("a", [EN, Q + " " + EN, "Flat vector drawing: woven kelp. " + EN, ""])
def test_no_copy(a):
    assert not P.is_copy(Q, a)


@pytest.mark.parametrize(("a", "cut"), [
    (EN, False), (EN[:-1], True), (EN[:60], True), ("The end…", True), ("It rests (", True), ('Done. Text to render: "A1", "B2", "C3"', False), ('Done. Text to render: "A1", "B2",', True),
    ("It ends. (The frame stays empty otherwise.)", False), ('It carries the tag "Soz4"', True), (ZH, False), (ZH[:-1], True), ("Is it so?", False), ('Text to render: "A1", "', True),
    ("It holds several parts, e.g.", True), ("This repeats the shape in No.", True), ("The arrow is missing,,", True), ("Elle relie «", True), (EN + "  \n​", False), ("It rests on the axis. " * 2000 + "It rests", True),
])
def test_likelihood_of_the_end(spark, a, cut):
    m = model(spark)
    assert bool(m.ends[P.contexts([a])[0]] < P.END_SHARE) is cut


def test_contexts_do_not_depend_on_the_batch():
    texts = [EN, "", "a", DE, 'x "y", "z"', ZH + "\n\n", "\n", FR]
    assert P.contexts(texts).tolist() == [P.contexts([t])[0] for t in texts]


MODELS = {}


def model(spark):
    if not MODELS:
        lists = [f'The map shows the {w} rim. Is it so? It is. Text to render: "A{i}", "B{i}"' for i in range(12) for w in ("near", "far")]
        docs = spark.createDataFrame([(i, t, k) for i in range(12) for t, k in ((EN * 5 + f" {i} bodies.", "en"), (DE, "DE"), (FR, "fr-XX"), (ZH, "zh"), (EN, None), ("Is it so?", "en"), ("", "en"))], "doc_id long, text string, lang string")
        MODELS[0] = P.fit(docs, spark.createDataFrame([(x,) for x in lists], "answer string"))
    return MODELS[0]


def test_records(spark):
    m = model(spark)
    assert m.languages.names == ["de", "en", "fr", "zh"]
    rows = [
        ("t", 1, Q, EN), ("t", 2, Q, DE), ("t", 3, Q, EN[:-30]), ("t", 4, Q, None), ("t", 5, Q, Q), ("t", 6, None, EN), ("t", 7, " ", None), ("t", 8, FR, FR + " " + FR[:40] + "."), ("t", 9, FR, EN), ("t", 10, Q, "Request declined."),
        ("t", 2, Q, DE), ("u", 2, ZH, ZH + "多孔膜采用同样的比例尺。"), ("u", 3, Q, EN * 500 + " It rests on"), ("u", 4, EN, EN * 500 + " It rests on"),
    ]
    df = spark.createDataFrame(rows, "table_name string, row_id long, question string, answer string")
    got = {(r["table_name"], r["row_id"]): r["defect"] for r in P.defects(df, m).collect()}
    want = {("t", 2): "wrong_language", ("t", 3): "truncated", ("t", 4): "empty", ("t", 5): "copy", ("t", 7): "empty", ("t", 9): "wrong_language", ("t", 10): "refusal", ("u", 3): "truncated", ("u", 4): "copy"}
    got.pop(("t", 8), None), got.pop(("u", 2), None)
    assert got == want
    assert P.defects(df.limit(0), m).count() == 0


def test_long_texts_score_like_their_parts(spark):
    lang = model(spark).languages
    old = P.CHUNK
    whole = lang.scores([EN * 50, DE, None, ""])
    P.CHUNK = 100
    try:
        assert np.allclose(lang.scores([EN * 50, DE, None, ""]), whole, rtol=1e-3, atol=1e-1)
    finally:
        P.CHUNK = old


def test_long_and_late_refusals():
    long = "I'm sorry, but I can't describe this figure. " + "My guidelines ask me to leave such requests alone, whatever you need them for. " * 40
    late = "Thank you for your request and for the care you took in writing it. " * 4 + "I cannot help with that."
    assert REFUSALS.is_refusal(long) and len(long) > 2000 and REFUSALS.is_refusal(late)
    assert not REFUSALS.is_refusal(EN * 3 + " I cannot describe the rest of it.")


def test_copies_of_any_length():
    long = " ".join(f"w{i} and" for i in range(20_000))
    assert P.is_copy(Q, "\n".join([Q] * 50)) and P.is_copy(long, long.replace("w77 ", "other ")) and not P.is_copy(Q, (EN + " ") * 400)
    assert not P.is_copy(long, long + " " + EN * 800)
