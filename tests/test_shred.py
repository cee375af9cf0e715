import json
import os

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from figloom.operators import shred
from figloom.plans import shredding
from tests.test_queries import D

NESTED = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.list_(pa.string())), ("m", pa.map_(pa.string(), pa.list_(pa.int32())))]))
row = st.none() | st.lists(st.none() | st.fixed_dictionaries({"a": st.none() | st.integers(0, 9), "b": st.none() | st.lists(st.none() | st.text("xy", max_size=2), max_size=3), "m": st.none() | st.lists(st.tuples(st.text("kl", min_size=1, max_size=2), st.none() | st.lists(st.none() | st.integers(0, 5), max_size=2)), max_size=2, unique_by=lambda x: x[0])}), max_size=3)


def brute(rows):
    out = set()
    for i, r in enumerate(rows):
        for j, x in enumerate(r or []):
            if x is None:
                continue
            out.add((i, f"c/{j}"))
            for k, y in enumerate(x["b"] or []):
                if y is not None:
                    out.add((i, f"c/{j}/b/{k}"))
            for key, v in x["m"] or []:
                if v is not None:
                    out.add((i, f"c/{j}/m/{key}"))
                    for k, y in enumerate(v):
                        if y is not None:
                            out.add((i, f"c/{j}/m/{key}/{k}"))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(row, max_size=5))
def test_nodes_equal_a_plain_walk(rows):
    got = [(int(i), n) for _, at, names in shred.node_paths(pa.array(rows, NESTED), "c") for i, n in zip(at, names.to_pylist())]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_wrappings_of_raw_segments():
    one = {"filename": "f", "width": "12", "height": 3, "labels": "L", "path": None}
    assert shred.read_segments(json.dumps(one))[0]["labels"] == ["L"]
    assert shred.read_segments(json.dumps(json.dumps([one, None])))[1] is None
    assert shred.read_segments(json.dumps([one]))[0]["width"] == 12
    for bad in (None, "", "[{", "3", '"x"', json.dumps([one])[:-5]):
        assert shred.read_segments(bad) is None


def test_flat_tables_keep_links_and_null_elements(spark):
    df = spark.createDataFrame(
        [(1, [("f", 1, 2, ["x", None], "p"), None]), (2, None), (3, []), (4, [("g", None, None, None, None)])], f"row_id long, segments {shred.SEGMENTS}"
    )
    t = shred.flat_tables(df, "row_id", "segments")
    seg = {(r["row_id"], r["segments_place"]): (r["is_null"], r["filename"], r["width"]) for r in t["segments"].collect()}
    assert seg == {(1, 0): (False, "f", 1), (1, 1): (True, None, None), (4, 0): (False, "g", None)}
    labels = [(r["row_id"], r["segments_place"], r["labels_place"], r["value"]) for r in t["segments/element/labels"].collect()]
    assert sorted(labels, key=str) == [(1, 0, 0, "x"), (1, 0, 1, None)]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], f"row_id long, segments {shred.SEGMENTS}, node string, segments_place int")
    assert shred.nodes(df, "row_id", "segments").count() == 0
    assert all(x.count() == 0 for x in shred.flat_tables(df, "row_id", "segments").values())
    one = spark.createDataFrame([(7, [("f", 1, 2, ["x"], "p")], "mine", 3)], df.schema)
    assert sorted(r["node"] for r in shred.nodes(one, "row_id", "segments").collect()) == ["segments/0", "segments/0/labels/0"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
def test_flat_segments_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view metadata as select * from '{D}/metadata.parquet'")
    names = ["row_id", "segments_place", "is_null", "filename", "width", "height", "path"]
    got = sorted(map(repr, map(tuple, shredding.p4_segments(spark, D).select(names).collect())))
    assert got == sorted(map(repr, con.execute(f"select {', '.join(names)} from ({shredding.SEGMENTS_SQL})").fetchall()))


def test_any_number_of_quotings():
    text = '[{"filename": "a.png", "labels": "x"}]'
    for _ in range(12):
        text = json.dumps(text)
    assert shred.read_segments(text)[0]["labels"] == ["x"] and shred.read_segments(text[:-1]) is None and shred.read_segments('"plain"') is None
