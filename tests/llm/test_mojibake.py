from figloom.llm import mojibake as M

CLEAN = [
    "Même échelle pour la forêt côtière, déjà vue à gauche – 3 µm.", "Für das Gefäß gilt dasselbe Maß, nämlich größer.", "На схеме видно, как растёт край ледника, остаётся только объект.",
    "图中右侧的薄膜没有接触神经元。", "We didn’t observe “drift” at 5 ± 2 °C × 3.", "NÃO-LINEAR e ÂNGULO: a fração não muda; região.", "Sites Â1 and Ã2 keep the old naming; Grid codes Ð3 and Þ7.",
    "½ of ¾, ✓ 100 ‰, Ⅳ → Ⅴ, ﬁne ﬂow, 👩‍🔬 checked", "plain ASCII only", "", None,
]


def docs(spark, extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(CLEAN * 3)] + [(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")


def test_every_chain_is_found_and_restored(spark):
    garbled = [
        (t, M.garble(t, "utf-8", w, n)) for t in CLEAN[:5] for w, n in (("cp1252", 1), ("cp1252", 2), ("latin-1", 1), ("mac_roman", 1), ("cp1251", 1), ("cp437", 1), ("cp866", 1))
    ] + [(CLEAN[1], M.garble(CLEAN[1], "cp1252", "cp437")), (CLEAN[2], M.garble(CLEAN[2], "cp1251", "cp1252")), (CLEAN[2], M.garble(CLEAN[2], "koi8_r", "cp1251")), (CLEAN[3], M.garble(CLEAN[3], "gbk", "latin-1")), (CLEAN[0], CLEAN[0].encode().decode("gbk", "replace"))]
    df = docs(spark, [g for _, g in garbled])
    assert {r["doc_id"] for r in M.found_ids(df).collect()} == {1000 + i for i in range(len(garbled))}
    fixed = {r["doc_id"]: (r["restored"], r["whole"]) for r in M.restore(df).collect()}
    whole = [i for i, (t, _) in enumerate(garbled) if fixed[1000 + i] == (t, True)]
    assert len(whole) >= 0.8 * len(garbled)


def test_one_garbled_character_and_lost_ones(spark):
    df = docs(spark, ["Values of 3 Âµm were typical", "A hydrogel ��� unlike the other", "regular – text ’ with “signs”", "the rig is 5 µm wide"])
    got = {r["doc_id"] for r in M.found_ids(df).collect()}
    assert got == {1000, 1001}
    lost = {r["doc_id"]: r["whole"] for r in M.restore(df).collect()}
    assert lost[1001] is False and lost[1000] is True


def test_empty_tables_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, unit string, n int")
    assert M.found_ids(df).count() == 0 and M.restore(df).count() == 0
    long = "é " * 20_000 + "Ã©"
    two = spark.createDataFrame([(1, long, "u", 1), (1, long, "u", 1), (2, long, "u", 2)], df.schema)
    assert sorted(r["doc_id"] for r in M.found_ids(two).collect()) == [1, 2]


def test_a_garbled_word_commoner_than_its_original(spark):
    text = "На схеме видно, как растёт край ледника"
    bad = M.garble(text, "cp1251", "cp1252")
    swapped = M.garble(text, "koi8_r", "cp1251")
    rows = [(0, text), (1, bad)] + [(10 + i, f"{bad} {i}") for i in range(6)] + [(20 + i, f"{swapped} {i}") for i in range(6)] + [(30 + i, bad) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in M.found_ids(df).collect()} == {i for i, _ in rows} - {0}
    fixed = {r["doc_id"]: r["restored"] for r in M.restore(df).collect()}
    assert fixed[1] == text and fixed[10] == text + " 0" and "схеме видно, " in fixed[20] and "край ледника" in fixed[20] and fixed[30] == text
    one = spark.createDataFrame([(1, "Der Wärmefluss wächst"), (2, M.garble("Der Wärmefluss wächst", "cp1252", "cp437"))], "doc_id long, text string")
    assert [r["doc_id"] for r in M.found_ids(one).collect()] == [2]


def test_short_units_follow_the_chain_of_their_document():
    def pairs(text, chain, true, wrong):
        return [{"piece": M.garble(w, true, wrong), "original": w, "chain": chain} for w in text.split() if len(w) > 3 and not w.isascii()]

    ru = "Подпись относится к области, рядом с меткой"
    assert M.mend(M.garble(ru, "cp1251", "cp1252"), pairs(ru, "cp1251>cp1252", "cp1251", "cp1252")) == (ru, True)
    de = "Das Gefäß misst nämlich 6.28 ± 0.77 kPa"
    assert M.mend(M.garble(de, "cp1252", "cp437"), pairs(de, "cp1252>cp437", "cp1252", "cp437")) == (de, True)
    assert M.mend("Für ▒ Maß", [{"piece": "x", "original": "y", "chain": "utf8>mac"}]) == ("Für ▒ Maß", False)
    assert M.mend("Für 5 ± 2 à gauche Ã©", [{"piece": "Ã©", "original": "é", "chain": "utf8>cp1252"}]) == ("Für 5 ± 2 à gauche é", True)


def test_long_stretches_of_gbk_are_walked(spark):
    zh = "说明文字对应薄膜较宽的位置。如果没有催化剂，则只剩下对照样品。"
    for wrong, chain in (("cp1252", "gbk>cp1252"), ("latin-1", "gbk>latin1")):
        bad = M.garble(zh, "gbk", wrong)
        assert (bad, zh) in [(p, o) for p, o, _ in M.walk(bad)]
        assert (M.garble(zh * 3, "gbk", wrong), zh * 3) in [(p, o) for p, o, _ in M.walk(M.garble(zh * 3, "gbk", wrong) + "，")]
    for text, true in (("Показанообъект", "cp1251"), ("ПОКАЗАНООБЪЕКТ", "cp1251"), ("показанообъект", "utf-8"), ("éèêëàâäöüß", "utf-8"), (zh, "utf-8")):
        assert not M.walk(M.garble(text, true, "cp1252"))
    df = spark.createDataFrame([(1, "A1" + M.garble(zh, "gbk", "cp1252") + "B2"), (2, "Für das Gefäß")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in M.restore(df).collect()] == [(1, f"A1{zh}B2", True)]


def test_words_of_any_length_under_every_chain(spark):
    words = {"cyrillic": "достопримечательности", "latin": "Größenverhältnismäßigkeitsprüfung", "han": "图中右侧的薄膜没有接触神经元示意图还显示囊泡在冷却后如何增大"}
    of = {"cp1251": "cyrillic", "koi8_r": "cyrillic", "cp866": "cyrillic", "cp1252": "latin", "mac_roman": "latin", "gbk": "han", "utf-8": "cyrillic"}
    rows, want = [], {}
    for size in (14, 201, 1_000, 100_000):
        for k, (_, true, wrong, times) in enumerate(M.CHAINS):
            base = words[of[true]]
            word = (base[k % len(base) :] + base * (size // len(base) + 1))[: size + size % 2]
            at = size * 100 + k
            rows += [(-at, f"seen {word} here"), (at, f"seen {M.garble(word, true, wrong, times)} here")]
            if size > 14 or {true, wrong} != {"koi8_r", "cp1251"}:  # one short word either way round decides nothing
                want[at] = f"seen {word} here"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["restored"] for x in M.restore(df).collect()}
    assert set(want) <= set(got) and not [k for k in got if k < 0]
    assert [k for k in want if got[k] != want[k]] == []


def test_parts_of_a_run_grow_with_its_length():
    bad = M.garble("Показан объект рядом с меткой".replace(" ", "–") * 400, "utf-8", "latin-1")
    assert len(M.pieces(bad)) < len(bad)
    word = M.garble("«достопримечательность»", "cp1251", "cp1252")
    assert M.garble("достопримечательность", "cp1251", "cp1252") in M.pieces(word)


def test_garbled_units_are_no_originals(spark):
    good, bad = "déjà", M.garble("déjà", "utf-8", "latin-1")
    df = spark.createDataFrame([(1, good), (2, bad), (3, M.garble(good, "utf-8", "latin-1", 2))], "doc_id long, text string")
    assert {x["doc_id"]: x["restored"] for x in M.restore(df).collect()} == {2: good, 3: good}
    one = [{"piece": "рядом", "original": "side", "chain": "x", "kind": "word"}]
    assert M.mend("рядом (рядом) наряду-рядом рядомы", one)[0] == "side (side) наряду-side рядомы"
