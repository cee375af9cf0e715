"""Clients of models, and the stages that call them, each as one mapInPandas without an exchange."""

from __future__ import annotations

import functools
import json
import random
import time
import zlib
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figloom.schemas import DIMENSIONS, TRACKS


class ModelClient(Protocol):
    """Anything that answers a request by text; failures raise."""

    def complete(self, system: str, user: str, image: bytes | None = None, temperature: float = 0.1) -> str: ...


@dataclass
class Retry:
    """Tries and waits: ``base * 2 ** k`` after failure k, ``fixed`` if set, plus up to ``jitter`` seconds that differ by key."""

    tries: int = 6
    base: float = 2.0
    fixed: float | None = None
    jitter: float = 0.0
    sleep: Callable[[float], None] = field(default=time.sleep, repr=False)

    def delay(self, k: int, rng: random.Random) -> float:
        return (self.fixed if self.fixed is not None else self.base * 2**k) + rng.uniform(0, self.jitter)

    def call(self, ask: Callable[[], object], key: str = "") -> tuple[object, str | None]:
        """(answer, None), or (None, last error) when the tries are used up. No wait follows the last try."""
        rng, error = random.Random(zlib.crc32(key.encode("utf-8", "replace"))), None
        for k in range(self.tries):
            try:
                return ask(), None
            except Exception as e:  # noqa: BLE001
                error = f"{type(e).__name__}: {e}"
                if k + 1 < self.tries:
                    self.sleep(self.delay(k, rng))
        return None, error


ANNOTATE = Retry(6, 2.0)
CLASSIFY = Retry(3, fixed=2.0)
JUDGE = Retry(6, 2.0, jitter=1.0)
CHECKLIST = Retry(1)


@dataclass
class StubClient:
    """Deterministic answers made from the request; ``fail_every`` makes each n-th key fail for good."""

    fail_every: int = 0

    def complete(self, system: str, user: str, image: bytes | None = None, temperature: float = 0.1) -> str:
        h = zlib.crc32(user.encode())
        if self.fail_every and h % self.fail_every == 0:
            raise RuntimeError("no answer")
        if system == "relevance":
            return "```json\n" + json.dumps({"relevance": {d: {"score": 1 + (h >> 4 * i) % 10} for i, d in enumerate(DIMENSIONS)}, "confidence": h % 10}) + "\n```"
        if system == "reasoning":
            return json.dumps({"reasoning": {t: {"terms": [f"t{(h >> i) % 7}"] * ((h >> 3 * i) % 3), "visualization": []} for i, t in enumerate(TRACKS)}})
        if system == "long":
            return json.dumps({"sci_RCoT": f"long {h}", "rendered_text": [f"r{h % 5}"]})
        if system == "short":
            return json.dumps({"science_abstract_prompt": f"short {h}", "retained_text": []})
        if system == "checklist":
            return json.dumps({"checklist": [{"question": f"q{i}?", "category": TRACKS[(h + i) % 3]} for i in range(1 + h % 3)]})
        if system == "judge":
            return json.dumps({"evaluation_results": [{"category": TRACKS[h % 3], "answer": "Yes" if h % 2 else "No", "reason": ""}]})
        if system == "planner":
            return f"plan {h}"
        if system == "keep":
            return ("KEEP", '{"decision": "reject"}', "perhaps")[h % 3]
        return "{}"

    def paint(self, prompt: str) -> bytes:
        return f"image of {prompt}".encode()


def loads(reply: str | None) -> dict | None:
    """Object in a reply, fences and talk around it ignored."""
    if not reply:
        return None
    lo, hi = reply.find("{"), reply.rfind("}")
    try:
        v = json.loads(reply[lo : hi + 1]) if 0 <= lo < hi else None
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


#: Requests a task keeps open at once.
THREADS = 8


def _stage(rows: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]], threads: int = THREADS) -> DataFrame:
    """``make()`` gives, once per task, the function of a row; rows of a batch are asked about by ``threads`` threads.

    Whatever a row raises stays with it: the row comes back with its key, its ``error`` if the schema has one, and nulls.
    """
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = make()

        def safely(r: dict) -> dict:
            try:
                return one(r)
            except Exception as e:  # noqa: BLE001
                return {"key": r["key"], "error": f"{type(e).__name__}: {e}"}

        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                rows_ = [{k: None if v is None or v is pd.NA or isinstance(v, float) and v != v else v for k, v in zip(b.columns, r)} for r in b.itertuples(index=False)]
                done = list(pool.map(safely, rows_))
                yield pd.DataFrame([[d.get(c) for c in columns] for d in done], columns=columns)

    return rows.mapInPandas(run, schema)


def _with(df: DataFrame, needed: tuple[str, ...], optional: tuple[str, ...] = ("image",)) -> DataFrame:
    """The columns a stage reads; optional ones where the frame has them."""
    return df.select(*needed, *[c for c in optional if c in df.columns])


def _text(x: object, name: str) -> str:
    if not isinstance(x, str):
        raise TypeError(f"{name} is no text")
    return x


def _texts(x: object, name: str) -> list[str]:
    if not isinstance(x, list):
        raise TypeError(f"{name} is no list")
    return [y if isinstance(y, str) else json.dumps(y, ensure_ascii=False) for y in x if y is not None]


def classify(tasks: DataFrame, client: Callable[[], ModelClient], retry: Retry = CLASSIFY, threads: int = THREADS) -> DataFrame:
    """(key, reply, error) for tasks (key, and image where there is one). A failed call has an error and no reply, so it is
    not cached; a reply that cannot be read is, and counts as zeros."""

    def make() -> Callable[[dict], dict]:
        c = client()

        def one(r: dict) -> dict:
            got, error = retry.call(lambda: c.complete("relevance", r["key"], image=r.get("image"), temperature=0.0), r["key"])
            return {"key": r["key"], "reply": got, "error": error}

        return one

    return _stage(_with(tasks, ("key",)), "key string, reply string, error string", make, threads)


ANNOTATED = "key string, reasoning string, sci_rcot string, rendered array<string>, prompt string, retained array<string>, error string"


def annotate(tasks: DataFrame, client: Callable[[], ModelClient], retry: Retry = ANNOTATE, threads: int = THREADS) -> DataFrame:
    """(key, reasoning, sci_rcot, rendered, prompt, retained, error) by the three steps, for tasks (key, labels, context, and
    image where there is one).

    Reasoning and the long text are asked with the image, the short text without it. A step without a usable answer
    leaves its part empty and the row counts as processed; a task without labels, or an answer of other types than
    asked for, is an error of its row.
    """

    def make() -> Callable[[dict], dict]:
        c = client()

        def one(r: dict) -> dict:
            def ask(system: str, user: str, t: float, image: bytes | None = None) -> dict:
                return loads(retry.call(lambda: c.complete(system, user, image=image, temperature=t), r["key"])[0]) or {}  # type: ignore[arg-type]

            if r["labels"] is None:
                return {"key": r["key"], "error": "missing labels"}
            image = r.get("image")
            first = ask("reasoning", f"{r['key']} {list(r['labels'])} {r['context']}", 0.1, image).get("reasoning") or {}
            if not isinstance(first, dict):
                raise TypeError("reasoning is no object")
            first = {k: v if not isinstance(v, dict) or v.get("terms") or v.get("visualization") else None for k, v in first.items()}
            told = json.dumps(first, ensure_ascii=False)
            long = ask("long", f"{r['key']} {told}", 0.3, image)
            text = _text(long.get("sci_RCoT", ""), "sci_RCoT")
            short = ask("short", f"{told} {text}", 0.3)
            return {
                "key": r["key"], "reasoning": told, "sci_rcot": text, "rendered": _texts(long.get("rendered_text", []), "rendered_text"),
                "prompt": _text(short.get("science_abstract_prompt", ""), "science_abstract_prompt"), "retained": _texts(short.get("retained_text", []), "retained_text"),
            }

        return one

    return _stage(_with(tasks, ("key", "labels", "context")), ANNOTATED, make, threads)


def checklists(requests: DataFrame, client: Callable[[], ModelClient], retry: Retry = CHECKLIST, threads: int = 1) -> DataFrame:
    """(key, reply) for requests (key, text): one try, null where it fails. One request at a time, as its service asks."""

    def make() -> Callable[[dict], dict]:
        c = client()
        return lambda r: {"key": r["key"], "reply": retry.call(lambda: c.complete("checklist", r["text"], temperature=0.1), r["key"])[0]}

    return _stage(requests.select("key", "text"), "key string, reply string", make, threads)


JUDGED = "key string, verdicts string, error string"


def judge(requests: DataFrame, client: Callable[[], ModelClient], retry: Retry = JUDGE, threads: int = THREADS) -> DataFrame:
    """(key, verdicts, error) for requests (key, text, error, and image and checklist where there are some): the request
    holds prompt and checklist; rows that already have an error pass through.

    A reply that is no JSON is tried again like a failed call.
    """

    def make() -> Callable[[dict], dict]:
        c = client()

        def one(r: dict) -> dict:
            if r["error"] is not None:
                return {"key": r["key"], "error": r["error"]}
            user = r["text"] if r.get("checklist") is None else f"{r['text']}\n\nChecklist:\n{r['checklist']}"

            def ask() -> str:
                got = loads(c.complete("judge", user, image=r.get("image"), temperature=0.0))
                if got is None:
                    raise ValueError("no JSON")
                return json.dumps(got)

            got, error = retry.call(ask, r["key"])
            return {"key": r["key"], "verdicts": got, "error": error}

        return one

    return _stage(_with(requests, ("key", "text", "error"), ("image", "checklist")), JUDGED, make, threads)


def judge_by_each(requests: DataFrame, clients: Mapping[str, Callable[[], ModelClient]], retry: Retry = JUDGE) -> DataFrame:
    """(judge, key, verdicts, error): the same requests to several judges, or to one under several wordings."""
    parts = [judge(requests, c, retry).select(F.lit(name).alias("judge"), "*") for name, c in clients.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def decide(tasks: DataFrame, client: Callable[[], ModelClient], retry: Retry = CLASSIFY, threads: int = THREADS) -> DataFrame:
    """(key, reply, error) of the filter that keeps or rejects an image; ``jsonclean.keep_decision`` reads the reply."""

    def make() -> Callable[[dict], dict]:
        c = client()

        def one(r: dict) -> dict:
            got, error = retry.call(lambda: c.complete("keep", r["key"], image=r.get("image"), temperature=0.0), r["key"])
            return {"key": r["key"], "reply": got, "error": error}

        return one

    return _stage(_with(tasks, ("key",)), "key string, reply string, error string", make, threads)


def plan(requests: DataFrame, client: Callable[[], ModelClient], retry: Retry = CHECKLIST, threads: int = THREADS) -> DataFrame:
    """(key, long, error): the planner's long description of a prompt, for requests (key, text)."""

    def make() -> Callable[[dict], dict]:
        c = client()

        def one(r: dict) -> dict:
            got, error = retry.call(lambda: _text(c.complete("planner", r["text"], temperature=0.0), "plan"), r["key"])
            return {"key": r["key"], "long": got, "error": error}

        return one

    return _stage(requests.select("key", "text"), "key string, long string, error string", make, threads)


class Painter(Protocol):
    """Anything that makes an image of a description; failures raise."""

    def paint(self, prompt: str) -> bytes: ...


def generate(requests: DataFrame, planner: Callable[[], ModelClient], painter: Callable[[], Painter], retry: Retry = CHECKLIST, threads: int = THREADS) -> DataFrame:
    """(key, long, image, error): always in two steps, the planner's description and the image made of it."""
    planned = plan(requests, planner, retry, threads)

    def make() -> Callable[[dict], dict]:
        c = painter()

        def one(r: dict) -> dict:
            if r["error"] is not None or r["long"] is None:
                return {"key": r["key"], "error": r["error"] or "no description"}
            got, error = retry.call(lambda: bytes(c.paint(r["long"])), r["key"])
            return {"key": r["key"], "long": r["long"], "image": got, "error": error}

        return one

    return _stage(planned, "key string, long string, image binary, error string", make, threads)
