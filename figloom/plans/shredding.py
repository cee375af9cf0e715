"""Queries of the shredding operator (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.operators import shred
from figloom.session import table


def _named(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("table_name"), F.col("row_id"), F.col("node"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "metadata").select("row_id", "segments", "segments_raw")
    capt = table(spark, d, "captions").select("row_id", "reasoning")
    ev = table(spark, d, "evaluation_results").select("row_id", "evaluation.evaluation_results")
    verdicts = shred.nodes(ev, "row_id", "evaluation_results")
    return (
        _named(shred.nodes(meta, "row_id", "segments", shred.segments_of), "metadata")
        .unionByName(_named(shred.nodes(capt, "row_id", "reasoning"), "captions"))
        .unionByName(_named(verdicts.select("row_id", F.concat(F.lit("evaluation/"), "node").alias("node")), "evaluation_results"))
    )


def _segments(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    meta = table(spark, d, "metadata").select("row_id", "segments", "segments_raw")
    return shred.flat_tables(meta, "row_id", "segments", shred.segments_of)


def p4_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)["segments"]


def p4_labels(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)["segments/element/labels"].withColumnRenamed("value", "label")


def _reasoning(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return shred.flat_tables(table(spark, d, "captions").select("row_id", "reasoning"), "row_id", "reasoning")


def p4_tracks(spark: SparkSession, d: str) -> DataFrame:
    return _reasoning(spark, d)["reasoning"].select("row_id", F.col("reasoning_place").alias("track"), "is_null")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    t = _reasoning(spark, d)["reasoning/value/terms"]
    return t.select("row_id", F.col("reasoning_place").alias("track"), F.col("terms_place").alias("place"), F.col("value").alias("term"))


def p4_verdicts(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "evaluation_results").select("row_id", "evaluation.evaluation_results")
    t = shred.flat_tables(ev, "row_id", "evaluation_results")["evaluation_results"]
    return t.withColumnRenamed("evaluation_results_place", "place")


QUERIES = {f.__name__: f for f in (p4_found, p4_segments, p4_labels, p4_tracks, p4_terms, p4_verdicts)}

_MAP = """
with e as (select row_id, unnest(map_entries(reasoning)) as kv from captions where reasoning is not null)
"""

#: Segments of both columns: (row_id, i, s) declared, (row_id, i, s) of the JSON text, unwrapped up to three times.
_SEGMENTS = """
with d as (select row_id, unnest(range(len(segments))) as i, segments from metadata where segments is not null),
ds as (select row_id, i, segments[i + 1] as s from d),
u0 as (select row_id, segments_raw as t from metadata where segments is null and json_valid(segments_raw)),
u1 as (select row_id, case when json_type(t) = 'VARCHAR' then json_extract_string(t, '$') else t end as t from u0),
u2 as (select row_id, case when json_type(t) = 'VARCHAR' then json_extract_string(t, '$') else t end as t from u1 where json_valid(t)),
u3 as (select row_id, case when json_type(t) = 'VARCHAR' then json_extract_string(t, '$') else t end as t from u2 where json_valid(t)),
j as (select row_id, case json_type(t) when 'ARRAY' then t::json when 'OBJECT' then json_array(t::json) end as j from u3 where json_valid(t)),
r as (select row_id, unnest(range(json_array_length(j)::bigint)) as i, j from j where j is not null),
rs as (select row_id, i, json_extract(j, '$[' || i || ']') as s from r),
dl as (select row_id, i, unnest(range(len(s.labels))) as k, s.labels as l from ds where s is not null and s.labels is not null),
rl0 as (select row_id, i, json_extract(s, '$.labels') as l from rs where json_type(s) = 'OBJECT'),
rl1 as (select row_id, i, case json_type(l) when 'ARRAY' then l else json_array(l) end as l from rl0 where l is not null and json_type(l) <> 'NULL'),
rl as (select row_id, i, unnest(range(json_array_length(l)::bigint)) as k, l from rl1),
labels as (select row_id, i, k, l[k + 1] as label from dl union all select row_id, i, k, json_extract_string(l, '$[' || k || ']') from rl)
"""

#: p4_segments in SQL; its sizes are nullable integers, which data frames of the two engines type differently, so the tests compare the rows.
SEGMENTS_SQL = (
    _SEGMENTS
    + """
select row_id, cast(i as integer) as segments_place, s is null as is_null, s.filename as filename, s.width as width, s.height as height, s.path as path from ds
union all select row_id, cast(i as integer), json_type(s) = 'NULL', json_extract_string(s, '$.filename'), try_cast(json_extract_string(s, '$.width') as integer),
  try_cast(json_extract_string(s, '$.height') as integer), json_extract_string(s, '$.path') from rs"""
)

ORACLE = {
    "p4_found": _SEGMENTS + """
, m as (select map_entries(reasoning) as kv, row_id from captions where reasoning is not null),
t as (select row_id, unnest(kv) as kv from m),
x as (select row_id, kv.key as track, kv.value as v from t where kv.value is not null),
terms as (select row_id, track, v.terms as a, unnest(range(len(v.terms))) as k from x),
pics as (select row_id, track, v.visualization as a, unnest(range(len(v.visualization))) as k from x),
e as (select row_id, evaluation.evaluation_results as a, unnest(range(len(evaluation.evaluation_results))) as k from evaluation_results)
select 'metadata' as table_name, row_id, 'segments/' || i as node from ds where s is not null
union all select 'metadata', row_id, 'segments/' || i from rs where json_type(s) <> 'NULL'
union all select 'metadata', row_id, 'segments/' || i || '/labels/' || k from labels where label is not null
union all select 'captions', row_id, 'reasoning/' || track from x
union all select 'captions', row_id, 'reasoning/' || track || '/terms/' || k from terms where a[k + 1] is not null
union all select 'captions', row_id, 'reasoning/' || track || '/visualization/' || k from pics where a[k + 1] is not null
union all select 'evaluation_results', row_id, 'evaluation/evaluation_results/' || k from e where a[k + 1] is not null""",
    "p4_labels": _SEGMENTS + "select row_id, cast(i as integer) as segments_place, cast(k as integer) as labels_place, label is null as is_null, label from labels",
    "p4_tracks": _MAP + "select row_id, kv.key as track, (kv.value is null) as is_null from e",
    "p4_terms": _MAP + """
, t as (select row_id, kv.key as track, kv.value.terms as terms from e where kv.value is not null)
select row_id, track, cast(i - 1 as integer) as place, terms[i] as term
from (select row_id, track, terms, unnest(range(1, len(terms) + 1)) as i from t)""",
    "p4_verdicts": """
with v as (select row_id, evaluation.evaluation_results as a from evaluation_results),
x as (select row_id, a, unnest(range(1, len(a) + 1)) as i from v)
select row_id, cast(i - 1 as integer) as place, (a[i] is null) as is_null, a[i].category as category,
       a[i].answer as answer, a[i].reason as reason from x""",
}
