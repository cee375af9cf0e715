import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figloom.llm import tokenise as T

PATH = f"{T.TOKENIZERS}/{T.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")


def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=T.load_ranks(PATH), special_tokens={}).encode_ordinary


ENCODER = T.Encoder() if os.path.exists(PATH) else None


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("abAB 1\n\t'’é你<|>", max_size=120))
def test_ids_equal_the_library(text):
    assert ENCODER(text) == reference()(text)


def test_long_pieces_and_special_strings():
    for text in ("x" * 30_000, "ab" * 5000, "<|endoftext|>", " " * 3000, "你" * 3000):
        assert ENCODER(text) == reference()(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, None, 5), (3, "", 5), (1, "hello world", 6)], "doc_id long, text string, ids int")
    got = [(r["doc_id"], r["ids"]) for r in T.encode(df).collect()]
    assert sorted(got) == sorted([(1, reference()("hello world")), (2, []), (3, []), (1, reference()("hello world"))])
    assert {r["n_tokens"] for r in T.encode(df, counts_only=True).collect()} == {2, 0}
    assert T.encode(df.limit(0)).count() == 0
