"""Markup residue in text documents.

A text is cut into leaf blocks: every sign or sign sequence that markup may be made of, and the plain text between;
forms that enclose text give a block at each end. A bidirectional LSTM, in numpy, reads for each block a vector of its
tag path (kind, name, place in the line, depth, signs beside it, how often the kind occurs) and of its hashed words, and
labels every block with the whole document as context: the same star is a list item among others, emphasis in a pair, or
a mark of significance. The label alone decides whether a block is markup; blocks of one form share theirs. The text is
then rebuilt by label. The network is trained here on documents made from plain values of the data and a grammar of
markup and of signs.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("text", "sign", "heading", "list", "quote", "code", "formula", "table", "inline", "entity", "drop")
PATHS, WORDS, DIM, HIDDEN = 4096, 4096, 20, 24
UNREAD = 0.25  # share of the blocks whose words are hidden in training, as the words of other corpora are new
#: Plain values the training documents are made from, at most, and how many documents are made.
SAMPLE_VALUES, TRAIN_DOCS, EPOCHS, BATCH = 2000, 3600, 6, 30

#: The sign sequences that may be markup, the first that fits.
_KINDS = (
    ("comment", r"<!--.*?-->"),
    ("math", r"\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]|<math\b[^>]*>.*?</math>|(?<![\w$])\$(?=[^\s$])[^$\n]*?[^\s$]\$(?![\d$])|\\begin\{(?:equation|align|math|displaymath)\*?\}.*?\\end\{(?:equation|align|math|displaymath)\*?\}"),
    ("fence", r"^[ \t]*(?:```|~~~)[^\n]*$(?:\n.*?)?^[ \t]*(?:```|~~~)[ \t]*$|^[ \t]*```[^\n]*$"),
    ("pre", r"<pre\b[^>]*>.*?</pre>|<code\b[^>]*>.*?</code>|\\begin\{(?:verbatim|lstlisting)\}.*?\\end\{(?:verbatim|lstlisting)\}"),
    ("ref", r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>"),
    ("tag", r"</?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>|<!DOCTYPE[^>]*>"),
    ("entity", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"),
    ("wtable", r"^\{\|[^\n]*$|^\|-+[^\n]*$|^\|\}[ \t]*$|^[|!][^\n]*(?:\|\||!!)[^\n]*$"),
    ("mtable", r"^\|[^\n]*\|[ \t]*$"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("wlink", r"\[\[[^\[\]\n]+\]\]"),
    ("image", r"!\[[^\]\n]*\]\([^()\s]*\)"),
    ("mlink", r"\[[^\[\]\n]+\]\([^()\s]+\)"),
    ("xlink", r"\[(?:https?|ftp)://[^\s\]]+[^\]\n]*\]"),
    ("wheading", r"^(?P<eq>={1,6})[^=\n][^\n]*?(?P=eq)[ \t]*$"),
    ("mheading", r"^#{1,6}[ \t]+(?=\S)"),
    ("lquote", r"``[^`'\n]+''"),
    ("quotes", r"'{2,5}"),
    ("bold", r"(?<![\w*])\*\*(?=[^\s*])[^\n*]*?[^\s*]\*\*(?![\w*])|(?<![\w_])__(?=[^\s_])[^\n]*?[^\s_]__(?![\w_])"),
    ("italic", r"(?<![\w*])\*(?=[^\s*])[^\n*]*?[^\s*]\*(?![\w*])|(?<![\w_])_(?=[^\s_])[^\n_]*?[^\s_]_(?![\w_])"),
    ("strike", r"~~(?=\S)[^\n]*?\S~~"),
    ("tick", r"``[^`\n]+``|`[^`\n]+`"),
    ("item", r"^[ \t]*(?:[-+•]|\*{1,4}|[*#]{2,4})[ \t]+(?=\S)"),
    ("number", r"^[ \t]*\d{1,3}[.)][ \t]+(?=\S)"),
    ("quote", r"^[ \t]*>[ \t]?"),
    ("rule", r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$"),
    ("command", r"\\(?:begin|end)\{[A-Za-z*]+\}|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{(?:[^{}]|\{[^{}]*\})*\})*"),
    ("escape", r"\\[&%$#_{}~^]|\\\\"),
    ("brace", r"\{[^{}\n]*\}|\[[^\[\]\n]*\)"),
    ("note", r"\[[^\[\]\n]*\]"),
    ("odd", r"\*+|~+|#+|<|>|&|\$|_|\^|[|{}\\`=+]"),
)
_LEX = re.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS), re.MULTILINE | re.DOTALL)
#: What every one of these holds: a text without any of it has no block but plain ones.
_ANY = re.compile(r"[<>&*_`~#$|\\{}\[\]=^+•]|''|!!|^[ \t]*(?:-|\d{1,3}[.)])[ \t]|^[ \t]*---", re.MULTILINE)


@dataclass
class Block:
    kind: str
    start: int
    text: str
    role: str = ""  # open or close for forms around text, cell for signs between cells
    form: int = -1  # blocks of one form have one label
    name: str = ""
    path: tuple[str, ...] = ()


#: Commands whose last argument is text, with the level of those that are headings.
_HEADINGS = {"title": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
_TEXTUAL = frozenset("textit textbf textsc textrm textsf emph underline text mbox caption footnote footnotesize small large textsuperscript textsubscript uline".split()) | set(_HEADINGS)
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?")
_SIMPLE = {"bold": (2, 2), "italic": (1, 1), "strike": (2, 2), "lquote": (2, 2)}


def _ends(kind: str, t: str) -> tuple[int, int] | None:
    """Lengths of what stands before and behind the text that a form encloses; None where it encloses none."""
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if kind == "wheading":
        head, tail = len(t) - len(t.lstrip("=").lstrip(" \t")), len(t) - len(t.rstrip(" \t").rstrip("=").rstrip(" \t"))
        return (head, tail) if head + tail < len(t) else None
    if kind in ("mlink", "image"):
        return t.index("[") + 1, len(t) - t.rindex("](")
    if kind == "wlink":
        if re.match(r"\[\[\s*(?:Category|File|Image)\s*:", t, re.IGNORECASE):
            return None
        return t.rindex("|") + 1 if "|" in t else 2, 2
    if kind == "command" and t.endswith("}") and _COMMAND.match(t).group(1) in _TEXTUAL:  # type: ignore[union-attr]
        head = re.match(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{", t)
        if head and t.count("{", head.end()) == t.count("}", head.end()) - 1:
            return head.end(), 1
    return None


def _cells(kind: str, t: str) -> list[tuple[int, int]]:
    """Spans of the signs between the cells of a table row; none for lines without cells."""
    if kind == "mtable" and not re.fullmatch(r"[|\s:-]+", t):
        return [m.span() for m in re.finditer(r"[ \t]*\|[ \t]*", t)]
    if kind == "wtable" and not re.match(r"\{\||\|-|\|\}", t):
        return [m.span() for m in re.finditer(r"^[|!][ \t]*|[ \t]*(?:\|\||!!)[ \t]*", t)]
    return []


def blocks(text: str) -> list[Block]:
    """Leaf blocks of a text, in order; together they are the text."""
    out: list[Block] = []

    def plain(lo: int, hi: int) -> None:
        while lo < hi:
            end = text.find("\n", lo, hi)
            end = hi if end < 0 else end + 1
            out.append(Block("plain", lo, text[lo:end]))
            lo = end

    def lex(lo: int, hi: int) -> None:
        at = lo
        for m in _LEX.finditer(text, lo, hi):
            if m.end() == m.start():
                continue
            plain(at, m.start())
            kind, t, start, at = m.lastgroup or "odd", m.group(), m.start(), m.end()
            form = len(out)
            if ends := _ends(kind, t):
                out.append(Block(kind, start, t[: ends[0]], "open", form, t))
                lex(start + ends[0], at - ends[1])
                out.append(Block(kind, at - ends[1], t[len(t) - ends[1] :], "close", form, t))
            elif cells := _cells(kind, t):
                for k, (a, b) in enumerate(cells):
                    out.append(Block(kind, start + a, t[a:b], "cell" if 0 < k < len(cells) - (kind == "mtable") else "edge", form))
                    lex(start + b, start + (cells[k + 1][0] if k + 1 < len(cells) else len(t)))
            else:
                out.append(Block(kind, start, t, "", form))
        plain(at, hi)

    if _ANY.search(text):
        lex(0, len(text))
    else:
        plain(0, len(text))
    seen: dict[str, int] = {}
    for b in out:
        seen[b.kind] = seen.get(b.kind, 0) + (b.role not in ("close", "cell"))
    depth = 0
    for b in out:
        if b.kind == "plain":
            b.path = ("plain",)
            continue
        end = b.start + len(b.text)
        name = re.match(r"\W*([A-Za-z]*)", b.text).group(1).lower()[:12] if b.kind in ("tag", "command", "template", "entity", "fence", "math") else ""  # type: ignore[union-attr]
        k = b.kind + b.role
        b.path = (
            k, f"{k}:{name}", f"{k}^{'line' if b.start == 0 or text[b.start - 1] == chr(10) else ''}{'0' if b.start == 0 else ''}", f"{k}*{min(seen[b.kind], 3)}", f"{k}/{min(depth, 3)}",
            f"{k}<{_beside(text, b.start - 1)}", f"{k}>{_beside(text, end)}", f"{k}={_shape(b.text)}",
        )
        if b.kind == "tag":
            depth = max(0, depth + (-1 if b.text.startswith("</") else 0 if b.text.endswith("/>") else 1))
        depth = max(0, depth + (b.role == "open") - (b.role == "close"))
    return out


def _beside(text: str, at: int) -> str:
    c = text[at] if 0 <= at < len(text) else "\n"
    return "a" if c.isalpha() else "9" if c.isdigit() else "s" if c in " \t" else c


def _shape(t: str) -> str:
    """Runs of letters, digits and blanks as one sign, whole."""
    return re.sub(r"\s+", " ", re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", t)))


@functools.lru_cache(1 << 18)
def _hash(x: str, n: int) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % n


def _words(b: Block) -> list[int]:
    """All words and sign runs of a block."""
    return [_hash(w, WORDS) for w in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+", b.text.lower())]


def features(seq: Sequence[Block]) -> tuple[list[list[int]], list[list[int]]]:
    return [[_hash(x, PATHS) for x in b.path] for b in seq], [_words(b) for b in seq]


# --- the network -----------------------------------------------------------------------------------------------


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner of each member, size of each list (1 for empty ones), and the members one after another."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.repeat(np.arange(len(lists)), sizes), np.maximum(sizes, 1), np.fromiter((w for x in lists for w in x), np.int64, int(sizes.sum()))


def _together(seq: list[Block], a: np.ndarray) -> np.ndarray:
    """Scores with those of the blocks of one form added up."""
    forms: dict[int, list[int]] = {}
    for k, b in enumerate(seq):
        if b.form >= 0:
            forms.setdefault(b.form, []).append(k)
    a = a - np.logaddexp.reduce(a, 1, keepdims=True)
    for own in forms.values():
        if len(own) > 1:
            a[own] = a[own].sum(0)
    return a


class Labeller:
    """Bidirectional LSTM over (mean of tag path vectors, mean of word vectors), a softmax over LABELS per block."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        n, h = 2 * DIM, HIDDEN
        self.p = {
            "path": r.normal(0, 0.3, (PATHS, DIM)), "word": r.normal(0, 0.3, (WORDS, DIM)),
            **{k + d: v for d in "fb" for k, v in (("W", r.normal(0, 1 / np.sqrt(n + h), (n + h, 4 * h))), ("c", np.concatenate([np.ones(h), np.zeros(3 * h)])))},
            "O": r.normal(0, 1 / np.sqrt(2 * h + n), (2 * h + n, len(LABELS))), "o": np.zeros(len(LABELS)),
        }

    def embed(self, paths: list[list[int]], bags: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(bags), 2 * DIM))
        for lo, name, lists in ((0, "path", paths), (DIM, "word", bags)):
            own, sizes, flat = _flat(lists)
            np.add.at(x[:, lo : lo + DIM], own, self.p[name][flat])
            x[:, lo : lo + DIM] /= sizes[:, None]
        return x

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """x: (steps, batch, inputs). Outputs of each step, and what the way back needs."""
        W, c = self.p["W" + d], self.p["c" + d]
        steps, batch, _ = x.shape
        h, s = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out, past = np.zeros((steps, batch, HIDDEN)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = np.concatenate([x[t], h], 1)
            a = z @ W + c
            f, i, o = (1 / (1 + np.exp(-a[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            s2 = m * (f * s + i * g) + (1 - m) * s
            th = np.tanh(s2)
            h2 = m * (o * th) + (1 - m) * h
            if keep:
                past.append((t, z, f, i, o, g, s, th, m))
            h, s = h2, s2
            out[t] = h
        return out, past

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0], x], 2)
        return both @ self.p["O"] + self.p["o"]

    def step(self, paths: list[list[int]], bags: list[list[int]], shape: tuple[int, int], where: tuple, labels: np.ndarray, adam: dict, rate: float) -> float:
        """One batch of training; ``where`` = (step, row) of each block."""
        flat = self.embed(paths, bags)
        x = np.zeros((*shape, 2 * DIM))
        mask = np.zeros(shape)
        x[where], mask[where] = flat, 1
        hf, pf = self._run(x, mask, "f", True)
        hb, pb = self._run(x, mask, "b", True)
        top = np.concatenate([hf, hb, x], 2)[where]
        a = top @ self.p["O"] + self.p["o"]
        a -= a.max(1, keepdims=True)
        q = np.exp(a)
        q /= q.sum(1, keepdims=True)
        n = len(labels)
        loss = -np.log(q[np.arange(n), labels] + 1e-12).mean()
        q[np.arange(n), labels] -= 1
        q /= n
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("path", "word")}
        g["O"], g["o"] = top.T @ q, q.sum(0)
        back = q @ self.p["O"].T
        dx = np.zeros_like(x)
        dx[where] = back[:, 2 * HIDDEN :]
        for d, past, lo in (("f", pf, 0), ("b", pb, HIDDEN)):
            dh_out = np.zeros((*shape, HIDDEN))
            dh_out[where] = back[:, lo : lo + HIDDEN]
            dh, ds = np.zeros((shape[1], HIDDEN)), np.zeros((shape[1], HIDDEN))
            for t, z, f, i, o, c, s, th, m in reversed(past):
                dh = dh + dh_out[t]
                own = dh * m
                do, dth = own * th, own * o
                dcell = ds * m + dth * (1 - th * th)
                da = np.concatenate([dcell * s * f * (1 - f), dcell * c * i * (1 - i), do * o * (1 - o), dcell * i * (1 - c * c)], 1)
                g["W" + d] += z.T @ da
                g["c" + d] += da.sum(0)
                dz = da @ self.p["W" + d].T
                dx[t] += dz[:, : 2 * DIM]
                dh = dh * (1 - m) + dz[:, 2 * DIM :]
                ds = ds * (1 - m) + dcell * f
        dflat = dx[where]
        adam["t"] = adam.get("t", 0) + 1
        every = slice(None)
        parts = [(k, every, v) for k, v in g.items()]
        for lo, name, lists in ((0, "path", paths), (DIM, "word", bags)):
            own, sizes, words = _flat(lists)
            rows, at = np.unique(words, return_inverse=True)  # only the vectors of this batch move
            grad = np.zeros((len(rows), DIM))
            np.add.at(grad, at, (dflat[:, lo : lo + DIM] / sizes[:, None])[own])
            parts.append((name, rows, grad))
        for k, rows, v in parts:
            m1 = adam.setdefault("m" + k, np.zeros_like(self.p[k]))
            m2 = adam.setdefault("v" + k, np.zeros_like(self.p[k]))
            m1[rows] += 0.1 * (v - m1[rows])
            m2[rows] += 0.001 * (v * v - m2[rows])
            self.p[k][rows] -= rate * (m1[rows] / (1 - 0.9 ** adam["t"])) / (np.sqrt(m2[rows] / (1 - 0.999 ** adam["t"])) + 1e-8)
        return float(loss)

    def label(self, seqs: list[list[Block]]) -> list[list[str]]:
        """Labels of every block; documents of like length go through together, those of plain text need no look."""
        out: list[list[str]] = [["text"] * len(s) for s in seqs]
        order = sorted((i for i in range(len(seqs)) if any(b.form >= 0 for b in seqs[i])), key=lambda i: len(seqs[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at) * len(seqs[order[end]]) < 20_000 and len(seqs[order[end]]) <= 2 * len(seqs[order[at]]) + 4:
                end += 1
            part = order[at:end]
            steps = len(seqs[part[-1]])
            rows = [b for i in part for b in seqs[i]]
            where = (np.concatenate([np.arange(len(seqs[i])) for i in part]), np.concatenate([np.full(len(seqs[i]), k) for k, i in enumerate(part)]))
            x, mask = np.zeros((steps, len(part), 2 * DIM)), np.zeros((steps, len(part)))
            x[where], mask[where] = self.embed(*features(rows)), 1
            a = self.scores(x, mask)
            for k, i in enumerate(part):
                best = _together(seqs[i], a[: len(seqs[i]), k]).argmax(1)
                out[i] = [LABELS[j] for j in best]
            at = end
        return out


# --- training documents ----------------------------------------------------------------------------------------


def _made(rng: random.Random, pool: list[str]) -> list[tuple[str, str]]:
    """(piece, label) of one made document."""

    def words(lo: int = 1, hi: int = 4) -> str:
        w = rng.choice(pool).split()
        i = rng.randrange(max(1, len(w) - hi))
        return " ".join(w[i : i + rng.randint(lo, hi)]).strip(".,;:()") or "part"

    def sentence() -> str:
        return rng.choice(re.split(r"(?<=\.) ", rng.choice(pool)))

    def formula() -> str:
        return rng.choice([r"x_{%d}(t) \to %d", r"\Delta G_{%d} < -%d", r"\alpha_{%d} = \frac{a}{%d}", r"\sum_{i=1}^{%d} q_i \leq %d", r"\sigma_{%d}^{%d}", r"E_{%d} \propto r^{-%d}", r"k_{%d}/%d"]) % (rng.randint(1, 9), rng.randint(2, 40))

    def code() -> str:
        return rng.choice([f"if gain > {rng.randint(2, 99)}:\n    gain = gain / 2", f"run --seed {rng.randint(1, 9)} --n {rng.randint(1, 9)}", f"x = {rng.randint(1, 99)}\nplot(x, y)", f"batch_{rng.randint(1, 9)}"])

    n = rng.randint(1, 99)
    inline = [
        lambda: [(f"<{(t := rng.choice(['b', 'i', 'em', 'EM', 'strong', 'sub', 'sup', 'u', 'span', 'div', 'a', 'p', 'title', 'font', 'small']))}{rng.choice(['', '', f' class="c{n}"', f' href="#f{n}"', f' id=x{n}'])}>", "inline"), (words(), "text"), (f"</{t}>", "inline")],
        lambda: [(rng.choice([f"<br{rng.choice(['', '/', ' /'])}>", "<BR>", "<hr/>", f'<img src="p{n}.png"/>']), "inline")],
        lambda: [(rng.choice([f"<!-- panel {n} -->", f"<!-- {words()} -->", f'<ref name="r{n}" />', f"<ref>{words()}</ref>", f"{{{{Plate|{words()}|{n}}}}}", r"\label{fig:%d}" % n, f"[[Category:{words()}]]"]), "drop")],
        lambda: [(rng.choice(["&mu;", "&nbsp;", "&lt;", "&gt;", "&amp;", "&deg;", "&ndash;", "&alpha;", "&quot;", "&eacute;", f"&#{rng.choice([945, 176, 8211, 946, 181])};", "&#x3B2;", "&#xB5;"]), "entity")],
        lambda: [(f"{{{{unit|{n}|nm}}}}", "inline")],
        lambda: [(f"[[{rng.choice(['', f'{words(1, 1)}:{n}|'])}{words()}]]", "inline")],
        lambda: [(q := rng.choice(["''", "'''", "'''''"]), "inline"), (words(), "text"), (q, "inline")],
        lambda: [(f"{(q := rng.choice(['**', '*', '__', '_', '~~', '`', '``']))}{words()}{q}", "code" if "`" in q else "inline")],
        lambda: [(f"{rng.choice(['', '!'])}[{words()}](figs/{n}.md)", "inline")],
        lambda: [(rng.choice([r"\textit{%s}", r"\emph{%s}", r"\textbf{%s}", r"\underline{%s}", r"\texttt{%s}"]) % words(), "inline")],
        lambda: [(rng.choice([r"\cite{k%d}", r"\ref{fig:%d}", r"\SI{%d}{\nano\metre}", r"\footnote{%d}", r"\alpha", r"\eqref{e%d}"]).replace("%d", str(n)), "inline")],
        lambda: [(rng.choice(["$%s$", r"\(%s\)", "<math>%s</math>", "$$ %s $$", r"\[%s\]"]) % formula(), "formula")],
        lambda: [(rng.choice([r"\%", r"\&", r"\_", r"\\"]), "inline")],
        lambda: [("``" + words() + "''", "inline")],
        lambda: [(f"<a href=\"#p{n}\">", "inline"), (words(), "text"), ("</a>", "inline"), (" " + words() + " ", "text"), ("<i>", "inline"), (words(), "text"), ("</i>", "inline")],
    ]
    def sign() -> str:
        x, y, w, v, m = rng.choice("abkmnpqtuvxyzEFT"), rng.choice("cdfghjrsw"), words(1, 1), words(1, 2), rng.randint(2, 300)
        unit = rng.choice(["nm", "K", "%", "mV", "kPa", "s"])
        return rng.choice([
            lambda: rng.choice([f"{v} < {n} {unit}", f"{x}<{n} & {y}>{m}", f"{n} < {x} < {m}", f"<{n} {unit}, not >{m} {unit}", f"{x} > {y} <= {m}", f"{w} (<{n} {unit})", f"{x} >> {y}"]),
            lambda: rng.choice([f"*p<0.0{n}; **p<0.00{n}", f"*, {v}; **, {w}", f"{w}* and {v}**", f"*{w} vs {v}, p = 0.0{n}", f"(*) {v}", f"{n} * {m} {unit}", f"{w} ***, n = {m}", f"* {v} (p < 0.{n})", f"**p < 0.{n}, ***p < 0.0{n}"]),
            lambda: rng.choice([f"[{n}]", f"[{n}, {m}]", f"[{n}-{m}]", f"{{{n}}} planes", f"{{{x}, {y}, {w}}}", f"[{w}]", f"({n}, {m}]", f"[{x}, {y})", f"{{{n} {m} 0}}", f"[{n}]–[{m}]", f"[{w} {n}, {v}]", f"[{x}]({n})"]),
            lambda: rng.choice([f"${n}", f"US${n}.50", f"${n}–${m} a run", f"A${n}, NZ${m}", f"{n}$ or {m}$", f"${n}k ({v})", f"about ${n}, then ${m} each"]),
            lambda: rng.choice([f"{w}_{n}", f"{w}_{x}_{n}.csv", f"{x}_{y}, {x}_{w}", f"_{n}", f"{w}_ and _{v}", f"{x}_max/{y}_min", f"{w}_{n}_{w}_{m}"]),
            lambda: rng.choice([f"#{n}", f"# {v}: {m}", f"{w} #{n} ({v})", f"#{w}", f"# = {m} {unit}", f"# {w} >= {n}"]),
            lambda: rng.choice([f"- {v}: {n}", f"+ {v}, - {w}", f"- {w}; + {v}; ± {n}", f"+ {n} {unit}", f"- = {w}", f"{n}. {sentence()}", f"({n}) {v}", f"> {n} {unit}, {v}", f"* {v}"]),
            lambda: rng.choice([f"<{x}> = {n}", f"<{x}{y}> over {v}", f"|{x}| < {n}", f"|{x}| + |{y}|", f"<{x}|{y}>", f"|{x}|", f"{x} | {y} | {w}", f"<{v}> = {n} {unit}", f"|| {v}"]),
            lambda: rng.choice([f"{n}'' wide", f"{n}' {m}''", f"{x}'', {y}''", f"~{n} {unit}", f"~ {v}", f"{w} & {v}", f"S&P{n}; {v}", f"R&D{n}; {w}", f"{w}&{v}", f"{x}^{n}, {y}^-{n}", f"10^{n}", f"{x} = {n}", f"{x} == {y}", f"{w} ` {v}", f"{x} ≤ {n} `{y}"]),
            lambda: rng.choice([f"C:\\{w}\\{w}_{n}", f"D:\\{w}{n}", f"\\\\{w}\\{v}", f"{w}\\{x}", f"{x} \\ {y}", f"--- {v}", f"{v} --- {w}"]),
        ])()

    def signs() -> str:
        return rng.choice(["", "", words(1, 4) + " "]) + sign() + rng.choice(["", ".", " " + words(1, 4) + ".", ", " + sign() + "."])

    out: list[tuple[str, str]] = []
    if rng.random() < 0.3:  # a short value, whole or in part one piece of markup
        t = words(3, 8)
        whole = [
            [(f"{(q := rng.choice(['**', '*', '__', '_', '~~', '``']))}{t}{q}", "code" if "`" in q else "inline")], [(f"{'#' * rng.randint(1, 5)} {t}", "heading")],
            [(f"{(q := '=' * rng.randint(1, 5))} {t} {q}", "heading")], [(r"\%s{%s}" % (rng.choice(["section", "section*", "title", "paragraph"]), t), "heading")],
            [(f"<{(g := rng.choice(['b', 'i', 'p', 'title', 'EM', 'span', 'div', 'strong', 'center']))}>", "inline"), (t, "text"), *rng.choice([[], [(f"</{g}>", "inline")]])],
            [(f"<h{(k := rng.randint(1, 6))}>", "heading"), (t, "text"), (f"</h{k}>", "heading")],
            [(q := rng.choice(["''", "'''"]), "inline"), (t, "text"), (q, "inline")], [(rng.choice([r"\textbf{%s}", r"\emph{%s}", r"\textit{%s}"]) % t, "inline")],
            [(t + " ", "text"), *rng.choice(inline)()], [*rng.choice(inline)(), (" " + t, "text")], [(t + " ", "text"), *rng.choice(inline)(), (" " + words(), "text")],
            [(f"``{t}''", "inline")], [(signs(), "sign")], [(sign(), "sign")], [(t, "text")], [(t + " ", "text"), (signs(), "sign")], [(signs() + " ", "sign"), (t, "text")],
        ]
        return [(a, b) for a, b in rng.choice(whole) if a]
    kind = rng.random()
    nl = rng.choice(["\n", "\n\n"])
    if 0.22 <= kind < 0.27:
        out += [(f"{{{{Data box {words(1, 1)}|name={words(2, 4)}|n={n}}}}}", "drop"), (rng.choice([" ", nl]), "text")]
    if kind < 0.22:
        out.append(rng.choice([
            (f"{'#' * rng.randint(1, 4)} {words(2, 4)}", "heading"), (f"{'#' * rng.randint(1, 4)} {words(1, 2)} **{words(1, 2)}**", "heading"), (f"{(q := '=' * rng.randint(2, 4))} {words(2, 4)} {q}", "heading"), (r"\%s{%s}" % (rng.choice(["section", "section*", "paragraph", "subsection"]), words(2, 4)), "heading"),
            (f"<h{(k := rng.randint(1, 4))}>{words(2, 4)}</h{k}>", "heading"),
        ]))
        out.append((nl, "text"))
    for _ in range(rng.randint(1, 5)):
        pick = rng.random()
        if pick < 0.42:
            out.append((sentence(), "text"))
        elif pick < 0.45:
            out += [(nl, "text"), (rng.choice(["$$ %s $$", r"\[ %s \]", r"\begin{equation} %s \end{equation}"]) % formula(), "formula"), (nl, "text")]
        elif pick < 0.65:
            out += [(rng.choice(["", "", nl]), "text"), (signs(), "sign")]
        else:
            w = sentence().split(" ")
            i = rng.randrange(len(w) + 1)
            out.append((" ".join(w[:i]) + rng.choice(["", " "]), "text"))
            out += rng.choice(inline)()
            out.append((rng.choice(["", " "]) + " ".join(w[i:]), "text"))
        out.append((" ", "text"))
    if kind > 0.55:
        out.append((nl, "text"))
        how = rng.randrange(15)
        lines = [sentence() for _ in range(rng.randint(2, 4))]
        if how < 3:
            mark = ("-", "*", "+")[how]
            out += [x for s in lines for x in ((f"{mark} ", "list"), (s + "\n", "text"))]
        elif how == 3:
            out += [x for i, s in enumerate(lines) for x in ((f"{i + 1}. ", "list"), (s + "\n", "text"))]
        elif how == 4:
            out += [x for s in lines for x in (("> ", "quote"), (s + "\n", "text"))]
        elif how == 5:
            c = code()
            out.append(rng.choice([(f"```\n{c}\n```", "code"), (f"<pre><code>{html.escape(c)}</code></pre>", "code"), (r"\begin{verbatim}%s\end{verbatim}" % c, "code")]))
        elif how == 6:
            out += [(x + "\n", "table") for x in (["| part | value |", "|---|---|", f"| {words()} | {n} nm |"] if rng.random() < 0.5 else ['{| class="t"', "|-", f"| {words()} || {n} nm", "|}"])]
        elif how == 7:
            tag = rng.choice(["ul", "ol", "OL"])
            out += [(f"<{tag}>", "list"), *[x for s in lines for x in ((rng.choice(["<li>", "<LI>"]), "list"), (s, "text"))], (f"</{tag}>", "list")]
        elif how == 8:
            out += [x for s in lines for x in (("<p>", "inline"), (s, "text"), ("</p>", "inline"), (rng.choice(["", "\n"]), "text"))]
        elif how == 9:
            out += [("<table>", "table"), *[x for s in lines[:2] for x in (("<tr>", "table"), ("<td>", "table"), (words(), "text"), ("</td>", "table"), ("<td>", "table"), (f"{n} nm", "text"), ("</td>", "table"), ("</tr>", "table"))], ("</table>", "table"), (sentence(), "text")]
        elif how == 10:
            env = rng.choice(["itemize", "enumerate"])
            out += [(r"\begin{%s}" % env, "list"), *[x for s in lines for x in ((r"\item", "list"), (" " + s + "\n", "text"))], (r"\end{%s}" % env, "list")]
        elif how == 11:
            out += [x for s in lines for x in (("# ", "list"), (s + "\n", "text"))]
        elif how == 12:
            out += [x for i, s in enumerate(lines) for x in ((rng.choice(["- ", "* "]) if i == 0 else rng.choice(["- ", "  - ", "    - ", "** ", "## "]), "list"), (s + "\n", "text"))]
        elif how == 13:
            t2 = [("**", "inline"), (words(), "text"), ("**", "inline")]
            out += [x for _ in range(2) for x in (("| ", "table"), (words(), "text"), (" | ", "table"), *t2, (" |", "table"), ("\n", "text"))]
        else:
            out += [("<blockquote>", "quote"), (lines[0], "text"), ("</blockquote>", "quote")]
    return [(a, b) for a, b in out if a]


_TABLE_TAG = re.compile(r"</?(?:table|tr|td|th|tbody|thead|caption)\b", re.IGNORECASE)


def _truth(seq: list[Block], pieces: list[tuple[str, str]]) -> np.ndarray:
    ends = np.cumsum([len(a) for a, _ in pieces])
    out = []
    for b in seq:
        label = pieces[min(int(np.searchsorted(ends, b.start, side="right")), len(pieces) - 1)][1]
        if b.kind == "plain":
            label = "text"
        elif label == "text":
            label = "sign"
        elif label == "heading" and b.kind in ("bold", "italic", "strike", "wlink"):
            label = "inline"
        elif label == "inline" and b.kind == "tag" and _TABLE_TAG.match(b.text):
            label = "table"
        out.append(LABELS.index(label))
    return np.array(out)


def train(plain_values: Sequence[str], seed: int = 5, docs: int = TRAIN_DOCS, epochs: int = EPOCHS) -> Labeller:
    """A labeller fitted on made documents; the same values and seed give the same one."""
    rng = random.Random(seed)
    pool = [x for x in plain_values if len(x.split()) > 6] or ["The left panel shows a plain body. Scale bar, 5 nm; the line marks the rim."]
    made = []
    for _ in range(docs):
        pieces = _made(rng, pool)
        seq = blocks("".join(a for a, _ in pieces))
        if seq:
            made.append((features(seq), _truth(seq, pieces)))
    net, adam = Labeller(), {}
    for epoch in range(epochs):
        made.sort(key=lambda x: (len(x[1]), rng.random()))
        batches = [made[i : i + BATCH] for i in range(0, len(made), BATCH)]
        rng.shuffle(batches)
        for part in batches:
            shape = (max(len(y) for _, y in part), len(part))
            where = (np.concatenate([np.arange(len(y)) for _, y in part]), np.concatenate([np.full(len(y), k) for k, (_, y) in enumerate(part)]))
            bags = [[] if rng.random() < UNREAD else w for x, _ in part for w in x[1]]
            net.step([w for x, _ in part for w in x[0]], bags, shape, where, np.concatenate([y for _, y in part]), adam, 0.01 if epoch < epochs - 2 else 0.003)
    return net


# --- rebuilding text -------------------------------------------------------------------------------------------


def is_markup(b: Block, label: str) -> bool:
    """A block of more than plain text that the network labels as markup."""
    return b.kind != "plain" and label not in ("text", "sign")


def _strip_math(t: str) -> str:
    t = re.sub(r"^(?:\$\$?|\\\(|\\\[|<math\b[^>]*>|\\begin\{\w+\*?\})\s*|\s*(?:\$\$?|\\\)|\\\]|</math>|\\end\{\w+\*?\})$", "", t)
    return t.strip()


#: Signs of the writer: begins a line where none begins, and takes the end of its line with it.
_NEW, _GONE = "\ue002", "\ue001"


class Writer:
    """Renders blocks one after another; knows the lists that are open."""

    def __init__(self) -> None:
        self.lists: list[int | None] = []  # next number of each open list, None for one without numbers
        self.counts: dict[int, int] = {}  # last number at each depth of a list of wiki lines
        self.line = -1  # place where the last wiki item ended its line

    def item(self) -> str:
        depth = max(0, len(self.lists) - 1)
        mark = "- "
        if self.lists and (n := self.lists[-1]) is not None:
            mark, self.lists[-1] = f"{n}. ", n + 1
        return _NEW + "  " * depth + mark

    def wiki(self, marks: str) -> str:
        """An item of a wiki list: stars and hashes, as many as it is deep."""
        depth = len(marks) - 1
        self.counts = {k: v for k, v in self.counts.items() if k <= depth}
        if marks[-1] == "*":
            return "  " * depth + "- "
        self.counts[depth] = self.counts.get(depth, 0) + 1
        return "  " * depth + f"{self.counts[depth]}. "

    def tag(self, t: str) -> str:
        name = re.match(r"</?\s*(\w+)|", t).group(1)  # type: ignore[union-attr]
        name, closing = (name or "").lower(), t.startswith("</")
        if name in ("ul", "ol", "dl"):
            if not closing:
                self.lists.append(1 if name == "ol" else None)
            elif self.lists:
                self.lists.pop()
            return "\n" if len(self.lists) == (not closing) else ""
        if name in ("li", "dd", "dt"):
            return "" if closing else self.item()
        if re.fullmatch("h[1-6]", name):
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name in ("td", "th"):
            return " | " if closing else ""
        if name == "blockquote":
            return "\n" if closing else "\n> "
        return "\n" if name in ("p", "br", "div", "table", "tr", "title", "hr", "center") else ""

    def command(self, b: Block) -> str:
        name = _COMMAND.match(b.name or b.text)
        if name is None:
            return ""
        name = name.group(1)
        if b.role == "close":
            return "\n" if name in _HEADINGS else ")" if name == "footnote" else ""
        if b.role == "open":
            return "\n" + "#" * _HEADINGS[name] + " " if name in _HEADINGS else " (" if name == "footnote" else ""
        args = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", b.text)
        if name == "item":
            return self.item()
        if name in ("begin", "end"):
            if args and args[0].rstrip("*") in ("itemize", "enumerate", "description"):
                if name == "begin":
                    self.lists.append(1 if args[0].startswith("enum") else None)
                elif self.lists:
                    self.lists.pop()
            return ""
        if name in ("label", "centering", "noindent", "maketitle", "par", "hline"):
            return ""
        if name in ("cite", "ref", "eqref", "citep", "citet", "autoref"):
            return f"[{', '.join(args)}]" if args else ""
        if name in ("SI", "si", "num"):
            return " ".join(re.sub(r"\\([A-Za-z]+)", r"\1", a) for a in args)
        if name in ("texttt", "verb", "lstinline"):
            return f"`{' '.join(args)}`"
        return " ".join(args) if args else f"${b.text}$"

    def render(self, b: Block, label: str) -> str:
        t, k = b.text, b.kind
        if k in ("comment", "ref", "rule", "quotes"):
            return ""
        if k == "escape":
            return "\n" if t == "\\\\" else t[1:]
        if k == "math":
            return f"${_strip_math(t)}$"
        if k in ("fence", "pre"):
            inner = re.sub(r"^\s*(?:```|~~~)[^\n]*\n?|\n?[ \t]*(?:```|~~~)[ \t]*$|^(?:<pre\b[^>]*>)?(?:<code\b[^>]*>)?|(?:</code>)?(?:</pre>)?$|\\(?:begin|end)\{\w+\}", "", t)
            inner = html.unescape(inner) if k == "pre" else inner
            return "\n```\n" + inner.strip("\n") + "\n```\n" if "\n" in inner or k == "fence" or "<pre" in t else f"`{inner}`"
        if k == "tag":
            return self.tag(t)
        if k == "entity":
            return html.unescape(t).replace("\xa0", " ")
        if k == "wheading":
            return "#" * (len(t) - len(t.lstrip("="))) + " " if b.role == "open" else ""
        if k == "mheading":
            return self.wiki("#") if label == "list" else t.strip() + " "
        if k in ("wtable", "mtable"):
            return " | " if b.role == "cell" else "" if b.role == "edge" else _GONE
        if k == "template":
            parts = [p for p in t[2:-2].split("|") if "=" not in p]
            return " ".join(parts[1:]) if parts and parts[0].strip().lower() == "unit" else ""
        if k == "lquote":
            return "“" if b.role == "open" else "”"
        if b.role:
            return self.command(b) if k == "command" else ""
        if k == "wlink":
            return ""
        if k == "xlink":
            return t[1:-1].partition(" ")[2]
        if k == "tick":
            return "`" + t.strip("`") + "`"
        if k == "item":
            marks = t.strip()
            if re.fullmatch(r"[*#]+", marks) and (len(marks) > 1 or "*" in marks and not t[0].isspace()):
                return self.wiki(marks)
            return t[: len(t) - len(t.lstrip())].replace("\t", "  ") + "- "
        if k == "number":
            return t[: len(t) - len(t.lstrip())].replace("\t", "  ") + t.strip() + " "
        if k == "quote":
            return "> "
        return self.command(b) if k == "command" else t


def clean(seq: Sequence[Block], labels: Sequence[str]) -> str:
    """Text with headings as ``#`` lines of their level, items as ``-`` or numbered lines indented by depth, quotations as
    ``>`` lines, cells between ``|``, code in back-ticks and formulas in dollars."""
    w, out = Writer(), []
    for b, x in zip(seq, labels):
        if is_markup(b, x):
            out.append(w.render(b, x))
            continue
        if b.kind == "plain" and "\n\n" in b.text + "\n" and b.text.strip() == "":
            w.counts = {}
        out.append(b.text)
    t = re.sub(rf"[ \t]*\n*{_NEW}", "\n", re.sub(rf"{_GONE}[ \t]*\n?", "", "".join(out)))
    t = re.sub(r"(?m)^( *(?:-|\d+\.)) {2,}", r"\1 ", re.sub(r"[ \t]+\n", "\n", t))
    t = re.sub(r"(?m)^( \| )+|( \| )+$", "", re.sub(r"\n{3,}", "\n\n", t))
    return t.strip("\n")


FIELDS = ("figure_title", "figure_caption")
_PLAIN = r"[<>&*_`~#$|\\{}\[\]=^\n+]|''"


def values(metadata: DataFrame, id_col: str = "row_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(row_id, field, text) of the values that hold any text."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("text")) for f in fields])
    rows = metadata.select(F.col(id_col).alias("row_id"), F.explode(each).alias("x"))
    return rows.select("row_id", "x.field", "x.text").where("text is not null and text <> ''")


_FITTED: dict[int, Labeller] = {}


def fit(texts: DataFrame, sample: int = SAMPLE_VALUES) -> Labeller:
    """Fitted on made documents around at most ``sample`` values without any sign that markup has, those of the least
    hashes; kept for the process, so the same values are fitted once."""
    plain = texts.where(~F.col("text").rlike(_PLAIN)).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(sample).collect()
    pool = sorted(r["text"] for r in plain)
    key = zlib.crc32("\0".join(pool).encode())
    if key not in _FITTED:
        _FITTED[key] = train(pool)
    return _FITTED[key]


def labelled(texts: DataFrame, net: Labeller) -> DataFrame:
    """(row_id, field, found, clean, headings, lists, codes, formulas) of every value; none is exchanged between tasks.

    ``found`` tells whether any block is markup. A value without markup is returned as it is.
    """
    shared = texts.sparkSession.sparkContext.broadcast(net)  # about 3 MB whatever the data

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for b in batches:
            seqs = [blocks(t) for t in b["text"]]
            labels = net.label(seqs)
            rows = []
            for t, seq, ls in zip(b["text"], seqs, labels):
                own = [x for x, y in zip(ls, seq) if is_markup(y, x)]
                rows.append((bool(own), clean(seq, ls) if own else t, *(own.count(k) for k in ("heading", "list", "code", "formula"))))
            yield pd.concat([b[["row_id", "field"]].reset_index(drop=True), pd.DataFrame(rows, columns=["found", "clean", "headings", "lists", "codes", "formulas"])], axis=1)

    kind = "row_id long, field string, found boolean, clean string, headings long, lists long, codes long, formulas long"
    return texts.select("row_id", "field", "text").mapInPandas(run, kind)
