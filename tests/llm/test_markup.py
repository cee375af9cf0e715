import random

import pytest

from figloom.llm import markup as M

PLAIN = [
    "Dashed line, expected leaching; solid line, measured docking. Data from Fiz50 runs; centre line, median; box, 70.9 µs.", "Right, the latticed droplet after scattering at 13–41 mV. Inset, pumping of a waxy organelle seen by lidar scanning.",
    "Scale bar, 32.2 °C; the lemon outline marks the receptor. Shading follows the dispersion relation of each follicle.", "Role of the cochlea in spreading and of the coupler in infection at high load.",
]


@pytest.fixture(scope="module")
def net():
    return M.train(PLAIN, docs=2400, epochs=6)


def found(net, text):
    seq = M.blocks(text)
    return any(M.is_markup(b, x) for b, x in zip(seq, net.label([seq])[0]))


def test_blocks_are_the_text():
    r = random.Random(3)
    for _ in range(200):
        t = "".join(a for a, _ in M._made(r, PLAIN))
        assert "".join(b.text for b in M.blocks(t)) == t
    assert M.blocks("") == []


def test_held_out_accuracy(net):
    r, good, n = random.Random(77), 0, 0
    for _ in range(150):
        pieces = M._made(r, PLAIN)
        seq = M.blocks("".join(a for a, _ in pieces))
        got = net.label([seq])[0]
        good += sum(M.LABELS[k] == g for k, g in zip(M._truth(seq, pieces), got))
        n += len(seq)
    assert good / n > 0.97


#: Signs in sentences that the training grammar does not make; the lexer proposes blocks in each.
UNSEEN = (
    "a < b and b > c hold in every panel.", "*P < 0.05, **P < 0.01, ***P < 0.001.", "The {111} and {100} facets are marked.", "Adapted from ref. [12]; prices in $ per kg ($3 to $5).", "See run log batch_07_b and probe_x_2.",
    "Sample #14 & sample #15 were pooled.", "n = 4 * 3 wells per plate.", "Growth along [001] is faster than along [110].", "Costs rose from $40 to $95 per sample.", "The mean <x> stays flat while <y> rises.", "Both |q| and |k| fall below 3.",
    "Loss below 5% (*), below 1% (**).", "Files are named scan_left_03 and scan_right_03.", "> 300 cells were counted per well.", "# of spots falls with age.", "- no signal; + weak signal; ++ strong signal.", "Samples were stored at ~4 K & ~77 K.", "Rates scale as r^2, not r^3.",
    "The gap [3, 8) is excluded; the set {p, q} is kept.", "Taken from refs [4], [7] and [11-13].", "Paths such as D:\\runs\\scan7 are local.", "A 3'' wafer and a 6'' wafer were used.", "x_min < x < x_max in all cases.", "Values in US$; 1 US$ = 7 units.", "* Significant at the 5% level.", "p < 0.01*, p < 0.001**.",
    "The <111> direction is vertical.", "Yield = mass_out / mass_in.", "Grid cells #3 and #9 were lost.", "1. The scale of this panel differs.", "R&D costs & overheads are left out.", "Signal/noise > 10 (n = 5).", "The (0 0 2) peak shifts by 0.1~0.2 degrees.",
)


def test_network_and_not_lexer_rejects_unseen_signs(net):
    proposed = [t for t in UNSEEN if any(b.kind != "plain" for b in M.blocks(t))]
    wrong = [t for x in (*UNSEEN, *(PLAIN[0] + " " + x for x in UNSEEN), *(x + " " + PLAIN[2] for x in UNSEEN)) if found(net, t := x)]
    print(f"{len(wrong)} of {3 * len(UNSEEN)} unseen signs taken for markup: {wrong}")
    assert len(proposed) >= 0.9 * len(UNSEEN) and len(wrong) <= 0.1 * 3 * len(UNSEEN)


def test_markup_is_found(net):
    for t in (
        "Role of the <b>cochlea</b> in spreading", "Role of the ligand &mu; in infection", "Coarsening of '''the conical''' transistor", "=== Scalloped channel ===", "## Bilobed crater\nScale bar, 38.0 nm.",
        "Germination of the [[Atlas:YP-325|grooved]] coupler", "Right, the swollen \\emph{root}, see Fig.~\\ref{fig:33} after recoil", "solid line, $x_{5}(t) \\to 3$ measured splicing", "Inset, recoil.\n* Dashed line, expected.\n* Scale bar, 6.7 K.",
    ):
        assert found(net, t), t


STRUCTURE = (
    ("## Bilobed crater\nThe **hollow** part &lt; [[a|rim]].", "## Bilobed crater\nThe hollow part < rim."),
    ("Seen here:\n* First part is shown.\n* Second part is shown.", "Seen here:\n- First part is shown.\n- Second part is shown."),
    ("<h3>Ridged nozzle</h3><ul><li>one body</li><li>two bodies</li></ul>", "### Ridged nozzle\n- one body\n- two bodies"),
    ("Shown is \\(E_{3} \\propto r^{-13}\\) after reduction.", "Shown is $E_{3} \\propto r^{-13}$ after reduction."),
    ("=== Scalloped channel ===\nThe right body is larger.", "### Scalloped channel\nThe right body is larger."),
    ("\\subsection{Bilobed crater}\nThe \\textbf{large \\emph{inner} rim} is marked.", "## Bilobed crater\n\nThe large inner rim is marked."),
    ("Steps are shown:\n<ol><li>first body</li><li>second body</li></ol>", "Steps are shown:\n1. first body\n2. second body"),
    ("<ul><li>one body<ul><li>inner part</li></ul></li><li>two bodies</li></ul>", "- one body\n  - inner part\n- two bodies"),
    ("Seen here:\n# First part is shown.\n# Second part is shown.\n# Third part is shown.", "Seen here:\n1. First part is shown.\n2. Second part is shown.\n3. Third part is shown."),
    ("Seen here:\n- First part is shown.\n  - Inner part is shown.\n- Second part is shown.", "Seen here:\n- First part is shown.\n  - Inner part is shown.\n- Second part is shown."),
    ("## The **big** result\nRight, the rim.", "## The big result\nRight, the rim."),
    ("Seen here:\n> The line is drawn by hand.\n> The rim is not.", "Seen here:\n> The line is drawn by hand.\n> The rim is not."),
    ("Sizes:\n| part | value |\n|---|---|\n| **rim** | 3 nm |", "Sizes:\npart | value\nrim | 3 nm"),
    ("\\begin{enumerate}\\item one body\n\\item two bodies\n\\end{enumerate}", "1. one body\n2. two bodies"),
)


def test_structure_is_kept(net):
    def clean(t):
        seq = M.blocks(t)
        return M.clean(seq, net.label([seq])[0])

    for text, want in STRUCTURE:
        assert clean(text) == want, text
    assert "```\nif gain > 82:\n    gain = gain / 2\n```" in clean("Marked.\n<pre><code>if gain &gt; 82:\n    gain = gain / 2</code></pre>")


def test_words_far_inside_a_block_count():
    long = "word " * 3000
    assert M._words(M.blocks(long + "rim")[0]) != M._words(M.blocks(long + "edge")[0])


def test_fit_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "train", lambda pool: tuple(pool))
    rows = [(f"plain value {i}",) for i in range(60)]
    a, b = (M.fit(spark.createDataFrame(r, "text string").repartition(n), 20) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert a == b and len(a) == 20


def test_rows(spark, net):
    df = spark.createDataFrame([(1, "<i>x</i> body of the rim", None), (2, None, ""), (3, "plain title here", "word " * 30_000 + "**bold**"), (3, "plain title here", "also plain")], "row_id long, figure_title string, figure_caption string")
    out = M.labelled(M.values(df), net).collect()
    assert len(out) == 5 and {(r["row_id"], r["field"]) for r in out if r["found"]} == {(1, "figure_title"), (3, "figure_caption")}
    assert M.labelled(M.values(df.limit(0)), net).count() == 0
