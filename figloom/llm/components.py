"""Splits that keep related records together.

Records that agree in any of several keys belong to one component, closed over chains. Only *keys* become graph
nodes: a record merely links its keys. The first key a record has is its anchor; every other key then needs no
more than its smallest anchor, so the graph that has to be searched consists of anchors joined by a key they
share. A key held by a third of all rows is one node, reached through map-side aggregation.

Components come from hooking every node to its smallest neighbour, pointer jumping until all point at a root, and
contracting the edges, until none is left. The table (node, component) can be kept and extended: the components
it holds enter the next run as single nodes. ``save`` and ``open_table`` keep it between sessions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from figloom.session import durable, release

NODES = "node string, component string"
QUARANTINE = "quarantine"
#: Components of one size are ranked in buckets of about this many.
RANK_BUCKET = 100_000


def blank_to_null(c: Column) -> Column:
    """Lower case, without surrounding white space; null where nothing is left."""
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s != "", s)


def file_key(c: Column) -> Column:
    """Name of the file without its directory, as a key."""
    return blank_to_null(F.regexp_replace(F.regexp_replace(c, r"[\s\p{Z}]+$", ""), r"^.*[/\\]", ""))


def _contract(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges between the roots of their ends."""
    a = mapping.select(F.col("node").alias("u"), F.col("component").alias("ru"))
    b = mapping.select(F.col("node").alias("v"), F.col("component").alias("rv"))
    return (
        edges.join(a, "u").join(b, "v").where("ru <> rv")
        .select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
    )


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component is named by its smallest node.

    No edges give an empty table; loops and repeated edges count once. Work per round falls with the number of
    roots; the rounds and the jumps in a round are logarithmic in the length of chains.
    """
    spark = edges.sparkSession
    edges = durable(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges"
    )
    rounds = []
    while not edges.isEmpty():
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(
            edges.select(F.col("v").alias("node"), F.col("u").alias("to"))
        )
        parent = durable(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("component")), "parent")
        moving = True
        while moving:
            up = parent.select(F.col("node").alias("component"), F.col("component").alias("root"))
            up2 = parent.select(F.col("node").alias("root"), F.col("component").alias("top"))
            jumped = durable(
                parent.join(up, "component").join(up2, "root")
                .select("node", F.col("top").alias("component"), (F.col("top") != F.col("component")).alias("moved")),
                "jump",
            )
            moving = not jumped.where("moved").isEmpty()
            release(parent)
            parent = jumped
        rounds.append(parent.select("node", "component"))
        left = durable(_contract(edges, parent), "edges")
        release(edges)
        edges = left
    release(edges)
    if not rounds:
        return spark.createDataFrame([], NODES)
    labels = rounds[0]
    for later in rounds[1:]:  # the roots of a round are the nodes of the next one: a few tables, each smaller
        step = later.select(F.col("node").alias("component"), F.col("component").alias("root"))
        labels = labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return labels


def key_links(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (node, anchor): each key of a record with the record's first key. A node is ``<place>|<value>``."""
    nodes = F.filter(
        F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}|"), F.col(k))) for i, k in enumerate(keys)]),
        lambda x: x.isNotNull(),
    )
    return (
        records.select(nodes.alias("ns")).where(F.size("ns") > 0)
        .select(F.explode("ns").alias("node"), F.col("ns")[0].alias("anchor")).distinct()
    )


def components(records: DataFrame, keys: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """Table (node, component) of all keys of ``records``, joined with the ``known`` one of earlier records.

    ``keys`` are string columns of ``records``; null agrees with nothing. A component of ``known`` may merge with
    others: its nodes then get the smallest name of all. Other columns, whatever their names, are not read.
    """
    links = durable(key_links(records, keys), "links")
    least = links.groupBy("node").agg(F.min("anchor").alias("least"))
    edges = links.where("node <> anchor").join(least, "node").where("anchor <> least").select(
        F.col("anchor").alias("u"), F.col("least").alias("v")
    )
    if len(keys) > 2:  # a key may be an anchor here and follow another anchor there
        anchors = links.where("node <> anchor").select(F.col("anchor").alias("node")).distinct()
        edges = edges.unionByName(
            least.where("node <> least").join(anchors, "node", "left_semi")
            .select(F.col("node").alias("u"), F.col("least").alias("v"))
        )
    if known is not None:
        edges = edges.unionByName(
            least.join(known, "node").where("least <> component")
            .select(F.col("least").alias("u"), F.col("component").alias("v"))
        )
    roots = connected(edges)
    if known is not None:
        roots = durable(roots, "roots")
    roots = roots.select(F.col("node").alias("least"), F.col("component").alias("root"))
    fresh = least.join(roots, "least", "left").select("node", F.coalesce("root", "least").alias("component"))
    if known is None:
        return fresh
    moved = known.join(roots.withColumnRenamed("least", "component"), "component", "left").select(
        "node", F.coalesce("root", "component").alias("component")
    )
    return moved.unionByName(fresh).groupBy("node").agg(F.min("component").alias("component"))


def attach(records: DataFrame, keys: Sequence[str], table: DataFrame) -> DataFrame:
    """``records`` with column ``component``, null for a record without keys."""
    anchor = F.coalesce(*[F.concat(F.lit(f"{i}|"), F.col(k)) for i, k in enumerate(keys)])
    return (
        records.withColumn("_anchor", anchor)
        .join(table.select(F.col("node").alias("_anchor"), "component"), "_anchor", "left").drop("_anchor")
    )


def candidate_keys(candidates: DataFrame) -> DataFrame:
    """(candidate_id, source_key, file_key); a record delivered twice is one."""
    return candidates.select(
        "candidate_id",
        blank_to_null(F.col("source_image_id")).alias("source_key"),
        file_key(F.col("image_filename")).alias("file_key"),
    ).distinct()


KEYS = ("source_key", "file_key")
ID_KEY = "id_key"


def tied(records: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """(id, keys, id_key): rows as they are, each once; an id delivered with different keys gets itself as one more key,
    so that its rows stay together. Ids with one row, and null ids, have none."""
    each = records.groupBy(id_col).agg(F.collect_set(F.struct(*keys)).alias("_rows"))  # deliveries of one record
    own = F.when((F.size("_rows") > 1) & F.col(id_col).isNotNull(), F.col(id_col).cast("string"))
    return each.select(id_col, own.alias(ID_KEY), F.explode("_rows").alias("_row")).select(id_col, *[F.col("_row")[k].alias(k) for k in keys], ID_KEY)


def linked_groups(candidates: DataFrame) -> DataFrame:
    """(group_first_id, candidate_id): records of each group with two or more different sources.

    Groups are read off the component table of all keys; a record without a source belongs through its file.
    """
    records = durable(tied(candidate_keys(candidates), KEYS, "candidate_id"), "keys")
    every = (*KEYS, ID_KEY)
    nodes = durable(components(records, every), "nodes")
    placed = durable(attach(records, every, nodes).where("component is not null").select("component", "candidate_id", "source_key"), "placed")
    release(records)
    release(nodes)
    groups = placed.groupBy("component").agg(
        F.min("candidate_id").alias("group_first_id"), F.min("source_key").alias("_least"), F.max("source_key").alias("_most")
    ).where("_least <> _most")
    return placed.join(groups, "component").select("group_first_id", "candidate_id").distinct()


def _quotas(histogram: list[tuple[int, int]], targets: Sequence[tuple[str, float]], have: dict[str, int]) -> list[tuple]:
    """(size, end of each split's share of the ranks), largest size first, each to the largest deficits."""
    total = sum(s * c for s, c in histogram) + sum(have.values())
    whole = sum(p for _, p in targets) or 1
    want = {k: total * p / whole - have.get(k, 0) for k, p in targets}
    out = []
    for size, count in sorted(histogram, reverse=True):
        share = dict.fromkeys(want, 0)
        if count > 64:
            open_ = {k: max(0.0, v) for k, v in want.items()}
            base = sum(open_.values())
            for k, v in open_.items():
                share[k] = int((count - 64) * v / base) if base else 0
                want[k] -= share[k] * size
        for _ in range(count - sum(share.values())):
            k = max(want, key=lambda x: want[x])
            share[k] += 1
            want[k] -= size
        ends, at = [], 0
        for k, _ in targets:
            at += share[k]
            ends.append(at)
        out.append((size, ends))
    return out


def assign_splits(
    sizes: DataFrame, targets: Sequence[tuple[str, float]], known: DataFrame | None = None
) -> DataFrame:
    """(component, n_records, split) with sizes as near to ``targets`` as whole components allow.

    ``sizes``: (component, n_records), a component once. ``known``: (component, split) of components that had one,
    under their present names: they keep it; if components of different splits merged, the result is
    ``quarantine``. The others fill the deficits, largest first. The driver sees only the histogram of component
    sizes, at most sqrt(2 x records) rows; ranks within a size are counted in hash buckets, so the hot size 1 is
    spread over many tasks.
    """
    spark = sizes.sparkSession
    if known is not None:
        fixed = known.groupBy("component").agg(
            F.when(F.count_distinct("split") > 1, F.lit(QUARANTINE)).otherwise(F.min("split")).alias("split")
        )
        sizes = sizes.join(fixed, "component", "left")
    else:
        sizes = sizes.withColumn("split", F.lit(None).cast("string"))
    sizes = durable(sizes.select("component", "n_records", "split"), "sizes")
    have = {r["split"]: r["n"] for r in sizes.where("split is not null").groupBy("split").agg(F.sum("n_records").alias("n")).collect()}
    free = sizes.where("split is null").drop("split")
    histogram = [(r["n_records"], r["n"]) for r in free.groupBy("n_records").agg(F.count("*").alias("n")).collect()]
    names = [k for k, _ in targets]
    have = {k: have.get(k, 0) for k in names}
    quotas = spark.createDataFrame(_quotas(histogram, targets, have), "n_records bigint, ends array<bigint>")
    buckets = max(1, math.ceil(max((n for _, n in histogram), default=0) / RANK_BUCKET))
    ranked = free.withColumn("_b", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    per = ranked.groupBy("n_records", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("n_records").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("n_records", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("n_records", "_b").orderBy(F.xxhash64("component", F.lit(1)), "component")
    ranked = ranked.withColumn("_r", F.row_number().over(inside)).join(per, ["n_records", "_b"]).join(quotas, "n_records")
    rank = F.col("_before") + F.col("_r")
    split = F.coalesce(*[F.when(rank <= F.col("ends")[i], F.lit(k)) for i, k in enumerate(names)], F.lit(names[-1]))
    given = ranked.select("component", "n_records", split.alias("split"))
    return sizes.where("split is not null").unionByName(given)


def extend(
    records: DataFrame,
    targets: Sequence[tuple[str, float]],
    keys: Sequence[str] = KEYS,
    id_col: str = "candidate_id",
    known_nodes: DataFrame | None = None,
    known_splits: DataFrame | None = None,
    known_records: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One increment: (nodes, splits, records), each kept in the shared folder and input of the next increment.

    nodes: (node, component); splits: (component, n_records, split); records: (id, keys, id_key). A record without any
    key is a component of its own; an id that comes with different keys, in one increment or several, ties them. ``known_splits`` name components of the previous increment; where two of different
    splits are now one, its records are quarantined.
    """
    flat = records.select(id_col, *keys).distinct()
    every = flat if known_records is None else known_records.select(id_col, *keys).unionByName(flat)
    every = durable(tied(every, keys, id_col), "records")
    fresh = every if known_records is None else every.join(flat.select(id_col).distinct(), id_col, "left_semi")
    all_keys = (*keys, ID_KEY)
    nodes = durable(components(fresh, all_keys, known_nodes), "nodes")
    sizes = place(every, keys, nodes, id_col).groupBy("component").agg(F.count_distinct(id_col).alias("n_records"))
    known = None
    if known_splits is not None:
        names = nodes.select(F.col("node").alias("old"), "component")
        known = known_splits.select(F.col("component").alias("old"), "split").join(names, "old", "left").select(
            F.coalesce("component", "old").alias("component"), "split"
        )
    return nodes, durable(assign_splits(sizes, targets, known), "splits"), every


def place(records: DataFrame, keys: Sequence[str], nodes: DataFrame, id_col: str) -> DataFrame:
    """(id, component) of the records (id, keys, id_key) of an increment; one without keys is a component of its own."""
    alone = F.concat(F.lit("id|"), F.col(id_col).cast("string"))
    return attach(records, (*keys, ID_KEY), nodes).select(id_col, F.coalesce("component", alone).alias("component")).distinct()


@dataclass
class Kept:
    """The component table of all increments so far, as ``extend`` returns it."""

    nodes: DataFrame
    splits: DataFrame
    records: DataFrame


_PARTS = ("nodes", "splits", "records")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions under ``path`` that were written to their end."""
    sc = spark.sparkContext
    there = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(there):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(there)]
    return sorted(int(n.removeprefix("complete-")) for n in names if n.startswith("complete-"))


def save(path: str, nodes: DataFrame, splits: DataFrame, records: DataFrame) -> int:
    """Keep an increment as the next version under ``path``; it counts once its mark, made last, is there.

    The mark is created only if it is not there yet, so of two sessions that write at once one fails.
    """
    spark = nodes.sparkSession
    version = (_versions(spark, path) or [0])[-1] + 1
    for name, df in zip(_PARTS, (nodes, splits, records)):
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")
    sc = spark.sparkContext
    mark = sc._jvm.org.apache.hadoop.fs.Path(f"{path}/complete-{version}")
    mark.getFileSystem(sc._jsc.hadoopConfiguration()).create(mark, False).close()
    return version


def open_table(spark: SparkSession, path: str) -> Kept | None:
    """The newest whole version under ``path``; None where there is none."""
    versions = _versions(spark, path)
    return Kept(*(spark.read.parquet(f"{path}/v{versions[-1]}/{name}") for name in _PARTS)) if versions else None


def extend_kept(
    path: str, records: DataFrame, targets: Sequence[tuple[str, float]], keys: Sequence[str] = KEYS, id_col: str = "candidate_id"
) -> Kept:
    """One increment on the table kept under ``path``, which begins empty; the new version is saved and returned."""
    spark = records.sparkSession
    old = open_table(spark, path)
    known = (old.nodes, old.splits, old.records) if old else (None, None, None)
    save(path, *extend(records, targets, keys, id_col, *known))
    return open_table(spark, path)  # type: ignore[return-value]


def split_records(candidates: DataFrame, targets: Sequence[tuple[str, float]]) -> DataFrame:
    """(candidate_id, component, split) of every record once, all assigned in one increment.

    A record delivered under one id with different keys ties them together, so it has one component and one split.
    """
    nodes, splits, every = extend(candidate_keys(candidates), targets)
    return place(every, KEYS, nodes, "candidate_id").join(splits.select("component", "split"), "component").select("candidate_id", "component", "split")


def split_report(splits: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, n_components, n_records, target_pct, actual_pct) for every split wanted or given."""
    got = splits.groupBy("split").agg(F.count("*").alias("n_components"), F.sum("n_records").alias("n_records"))
    total = got.agg(F.sum("n_records")).scalar()
    n = F.coalesce("n_records", F.lit(0))
    return got.join(targets, "split", "full").select(
        "split", F.coalesce("n_components", F.lit(0)).alias("n_components"), n.alias("n_records"), F.col("target_pct").cast("int").alias("target_pct"),
        F.round(100.0 * n / F.greatest(F.coalesce(total, F.lit(0)), F.lit(1)), 4).alias("actual_pct"),
    )
