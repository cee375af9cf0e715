"""Columnar shredding of nested columns into related flat tables.

Every leaf of a nested column becomes a sequence of (repetition level, definition level, value): the repetition
level says at which list a new entry continues, the definition level how much of its path is there. A list, an
element, a struct and a value each add one definition level when present, so a null list, an empty list, a null
element and an element with missing fields all stay apart. The table of a repeated ancestor is read off any leaf
below it: entries whose repetition level does not exceed the ancestor's are its rows, counts of the levels give the
places. Both steps are numpy over whole Arrow batches; nothing is exchanged between tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SEP = "/"


@dataclass
class Repeated:
    """A repeated ancestor: its path, repetition level, and the definition level of an element (one more: not null)."""

    path: str
    rep: int
    dfn: int
    keyed: bool


@dataclass
class Leaf:
    """Level sequences of one leaf path; ``pos`` points into ``values``, -1 where there is none."""

    path: str
    rep: np.ndarray
    dfn: np.ndarray
    pos: np.ndarray
    values: pa.Array
    above: tuple[Repeated, ...]


def _plain(arr: pa.Array) -> pa.Array:
    return arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr


def shred(arr: pa.Array, name: str) -> list[Leaf]:
    """Leaves of a nested array, in the order of its fields. A map is a list of (key, value)."""
    arr = _plain(arr)
    zero = np.zeros(len(arr), np.int16)
    return list(_walk(arr, name, zero, zero, np.arange(len(arr)), 0, 0, ()))


def _walk(arr, path, rep, dfn, pos, r, d, above) -> Iterator[Leaf]:  # noqa: ANN001
    there = pos >= 0
    if arr.null_count:
        valid = arr.is_valid().to_numpy(zero_copy_only=False)
        there &= valid[np.maximum(pos, 0)]
    dfn = dfn + there.astype(np.int16)
    pos = np.where(there, pos, -1)
    d += 1
    kind = arr.type
    if pa.types.is_struct(kind):
        for i in range(kind.num_fields):
            yield from _walk(arr.field(i), path + SEP + kind.field(i).name, rep, dfn, pos, r, d, above)
        return
    if not (pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_map(kind)):
        yield Leaf(path, rep, dfn, pos, arr, above)
        return
    offsets = arr.offsets.to_numpy().astype(np.int64)
    at = np.maximum(pos, 0)
    lengths = np.where(there, offsets[at + 1] - offsets[at], 0) if len(arr) else np.zeros(len(pos), np.int64)
    times = np.maximum(lengths, 1)
    src = np.repeat(np.arange(len(pos)), times)
    within = np.arange(len(src)) - np.repeat(np.cumsum(times) - times, times)
    has = lengths[src] > 0
    rep2 = np.where(within == 0, rep[src], r + 1).astype(np.int16)
    dfn2 = dfn[src] + has.astype(np.int16)
    pos2 = np.where(has, offsets[at[src]] + within, -1) if len(arr) else np.full(len(src), -1)
    keyed = pa.types.is_map(kind)
    above2 = (*above, Repeated(path, r + 1, d + 1, keyed))
    if keyed:
        yield from _walk(arr.keys, path + SEP + "key", rep2, dfn2, pos2, r + 1, d + 1, above2)
        yield from _walk(arr.items, path + SEP + "value", rep2, dfn2, pos2, r + 1, d + 1, above2)
    else:
        yield from _walk(arr.values, path + SEP + "element", rep2, dfn2, pos2, r + 1, d + 1, above2)


def ordinals(leaf: Leaf, level: int) -> np.ndarray:
    """Place of each entry in the list of repetition level ``level``, from 0, null elements counted."""
    steps = np.cumsum(leaf.rep == level)
    return steps - np.maximum.accumulate(np.where(leaf.rep < level, steps, 0)) if len(steps) else steps


def rows_of(leaf: Leaf) -> np.ndarray:
    """Row of the input that each entry belongs to."""
    return np.cumsum(leaf.rep == 0) - 1


def _place(leaf: Leaf, anc: Repeated, keys: dict[str, Leaf], sel: np.ndarray) -> pa.Array:
    """Key or ordinal, as text, of the entries ``sel`` in the ancestor."""
    if not anc.keyed:
        return pc.cast(pa.array(ordinals(leaf, anc.rep)[sel]), pa.string())
    of = keys[anc.path]
    entries = of.pos[of.rep <= anc.rep]
    which = (np.cumsum(leaf.rep <= anc.rep) - 1)[sel]
    return pc.cast(of.values.take(pa.array(entries[which])), pa.string())


def node_paths(arr: pa.Array, name: str) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """(path of the repeated ancestor, rows, nodes): one entry per element that is not null, ancestor by ancestor.

    A node is the path with each list's ordinal and each map's key in its place, without the words for elements.
    """
    leaves = shred(arr, name)
    keys = {leaf.above[-1].path: leaf for leaf in leaves if leaf.above and leaf.above[-1].keyed and leaf.path == leaf.above[-1].path + SEP + "key"}
    done: set[str] = set()
    for leaf in leaves:
        for i, anc in enumerate(leaf.above):
            if anc.path in done or (anc.keyed and leaf.path == anc.path + SEP + "key"):
                continue
            done.add(anc.path)
            sel = np.flatnonzero((leaf.rep <= anc.rep) & (leaf.dfn >= anc.dfn + 1))
            parts: list = []
            at = ""
            for a in leaf.above[: i + 1]:
                step = a.path[len(at):].strip(SEP)
                parts += [pa.scalar((SEP if parts else "") + (step + SEP if step else "")), _place(leaf, a, keys, sel)]
                at = a.path + SEP + ("value" if a.keyed else "element")
            if len(sel):
                yield anc.path, rows_of(leaf)[sel], pc.binary_join_element_wise(*parts, "")


def nodes(df: DataFrame, id_col: str, column: str, prepare: Callable[[pa.RecordBatch], pa.Array] | None = None) -> DataFrame:
    """(id, node) of every non-null element of every list and map below ``column``.

    A null or empty list gives no row; null elements give none but keep their number. ``prepare`` may build the
    nested array from a batch; else it is the column itself. All other columns are ignored.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("node", T.StringType())])
    arrow = pa.schema([(id_col, to_arrow_type(kind)), ("node", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            arr = _plain(prepare(b) if prepare else b.column(b.schema.get_field_index(column)))
            ids = b.column(b.schema.get_field_index(id_col))
            for _, rows, names in node_paths(arr, column):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pc.cast(names, pa.string())], schema=arrow)

    return df.mapInArrow(run, out)


def _leaf_types(kind: T.DataType, path: str, above: str) -> Iterator[tuple[str, T.DataType, str]]:
    """(leaf path, type, innermost repeated ancestor)."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _leaf_types(f.dataType, path + SEP + f.name, above)
    elif isinstance(kind, T.ArrayType):
        yield from _leaf_types(kind.elementType, path + SEP + "element", path)
    elif isinstance(kind, T.MapType):
        yield from _leaf_types(kind.keyType, path + SEP + "key", path)
        yield from _leaf_types(kind.valueType, path + SEP + "value", path)
    else:
        yield path, kind, above


def _nested(kind: T.DataType, path: str) -> Iterator[tuple[str, bool, str]]:
    """(path, whether a map, repeated ancestor above or '') of each list and map."""

    def go(k, p, up):  # noqa: ANN001, ANN202
        if isinstance(k, T.StructType):
            for f in k.fields:
                yield from go(f.dataType, p + SEP + f.name, up)
        elif isinstance(k, T.ArrayType):
            yield p, False, up
            yield from go(k.elementType, p + SEP + "element", p)
        elif isinstance(k, T.MapType):
            yield p, True, up
            yield from go(k.valueType, p + SEP + "value", p)

    return go(kind, path, "")


def flat_tables(
    df: DataFrame, id_col: str, column: str, prepare: Callable[[pa.RecordBatch], pa.Array] | None = None,
    kind: T.DataType | None = None,
) -> dict[str, DataFrame]:
    """Path of each repeated ancestor -> its flat table.

    A row is one element, null elements included. Columns: ``id_col``; ``<name>_place`` of every list or map from
    the outermost to this one (ordinal from 0, or the key), which together name the parent; ``is_null``; and the
    leaves of the element, with the path below it joined by ``_`` (``value`` for a plain element). Parent and child
    tables join on the id and the places they share.
    """
    kind = kind or df.schema[column].dataType
    lists = {p: (keyed, up) for p, keyed, up in _nested(kind, column)}
    leaves = list(_leaf_types(kind, column, ""))
    id_type = df.schema[id_col].dataType
    tables = {}
    for path in lists:
        chain, p = [], path
        while p:
            chain.insert(0, p)
            p = lists[p][1]
        places = []
        for p in chain:
            base = p.rpartition(SEP)[2]
            places.append((f"{base}_place", T.StringType() if lists[p][0] else T.IntegerType()))
        start = path + SEP + ("value" if lists[path][0] else "element")
        own = [(lp, lt, (lp[len(start):].strip(SEP).replace(SEP, "_") or "value")) for lp, lt, up in leaves if up == path and lp.startswith(start)]
        fields = [(id_col, id_type), *places, ("is_null", T.BooleanType()), *[(n, lt) for _, lt, n in own]]
        out = T.StructType([T.StructField(n, t) for n, t in fields])
        arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

        def run(batches, path=path, own=own, arrow=arrow):  # noqa: ANN001, ANN202
            for b in batches:
                if not b.num_rows:
                    continue
                arr = _plain(prepare(b) if prepare else b.column(b.schema.get_field_index(column)))
                ids = b.column(b.schema.get_field_index(id_col))
                found = shred(arr, column)
                keys = {x.above[-1].path: x for x in found if x.above and x.above[-1].keyed and x.path == x.above[-1].path + SEP + "key"}
                guide = next(x for x in found if any(a.path == path for a in x.above) and not (x.above[-1].path == path and x.above[-1].keyed and x.path.endswith(SEP + "key")))
                anc = next(a for a in guide.above if a.path == path)
                sel = np.flatnonzero((guide.rep <= anc.rep) & (guide.dfn >= anc.dfn))
                cols = [ids.take(pa.array(rows_of(guide)[sel]))]
                for a in guide.above[: anc.rep]:
                    place = _place(guide, a, keys, sel)
                    cols.append(place if a.keyed else pc.cast(place, pa.int32()))
                cols.append(pa.array(guide.dfn[sel] < anc.dfn + 1))
                by = {x.path: x for x in found}
                for lp, _, _n in own:
                    x = by[lp]
                    at = x.pos[x.rep <= anc.rep][np.flatnonzero((x.dfn >= anc.dfn)[x.rep <= anc.rep])]
                    cols.append(x.values.take(pa.array(at, mask=at < 0)))
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else pc.cast(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        tables[path] = df.mapInArrow(run, out)
    return tables


SEGMENTS = "array<struct<filename string, width int, height int, labels array<string>, path string>>"


def _text(x: object) -> str | None:
    return None if x is None else (x if isinstance(x, str) else json.dumps(x)).encode("utf-8", "replace").decode()


def _int(x: object) -> int | None:
    try:
        n = None if x is None or isinstance(x, bool) else int(float(x))  # type: ignore[arg-type]
        return n if n is not None and -(2**31) <= n < 2**31 else None
    except (TypeError, ValueError, OverflowError):
        return None


def _labels(x: object) -> list | None:
    if x is None:
        return None
    return [_text(y) for y in x] if isinstance(x, list) else [_text(x)]


def read_segments(raw: str | None) -> list | None:
    """Segments from JSON text in any wrapping: quoted again, a lone segment, a lone label, numbers as text.

    Text that is no complete JSON, or holds neither list nor object, gives None.
    """
    v: object = raw
    try:
        while isinstance(v, str):  # what a quoting holds is shorter than the quoting, so this ends
            v = json.loads(v)
    except (ValueError, RecursionError):
        return None
    if isinstance(v, dict) and set(v) == {"segments"}:
        v = v["segments"]
    if isinstance(v, dict):
        v = [v]
    if not isinstance(v, list):
        return None
    out: list = []
    for s in v:
        if s is None:
            out.append(None)
            continue
        s = s if isinstance(s, dict) else {}
        out.append({"filename": _text(s.get("filename")), "width": _int(s.get("width")), "height": _int(s.get("height")), "labels": _labels(s.get("labels")), "path": _text(s.get("path"))})
    return out


def segments_of(batch: pa.RecordBatch) -> pa.Array:
    """Column ``segments``, filled from ``segments_raw`` where it is null."""
    declared = _plain(batch.column(batch.schema.get_field_index("segments")))
    raw = batch.column(batch.schema.get_field_index("segments_raw"))
    use = np.flatnonzero(~declared.is_valid().to_numpy(zero_copy_only=False) & raw.is_valid().to_numpy(zero_copy_only=False))
    if not len(use):
        return declared
    read = pa.array([read_segments(x) for x in raw.take(pa.array(use)).to_pylist()], type=declared.type)
    where = np.arange(len(declared))
    where[use] = len(declared) + np.arange(len(use))
    return pa.concat_arrays([declared, read]).take(pa.array(where))
