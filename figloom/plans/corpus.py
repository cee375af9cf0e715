"""Queries over articles, segments, boxes and relevance scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.functions import jsonclean
from figloom.functions.text import mime_type, stem
from figloom.operators import filters, geometry, relevance, segments
from figloom.schemas import LEGACY_DIMENSIONS
from figloom.session import table

IMAGE_DIR = "/data/images"


def segments_attach(spark: SparkSession, d: str) -> DataFrame:
    arrays = segments.collect_segments(
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey"), "o_orderkey", ["l_linenumber", "l_partkey"]
    )
    rows = segments.attach_segments(table(spark, d, "orders").select("o_orderkey"), arrays, "o_orderkey")
    first = F.try_element_at(F.col("segments"), F.lit(1))["l_partkey"]
    return rows.select("o_orderkey", F.size("segments").cast("bigint").alias("n_segments"), F.coalesce(first, F.lit(-1)).alias("first_part"))


def segments_explode_fallback(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "metadata").select("row_id", "segments", "local_path", "image_path")
    return segments.explode_tasks(rows, IMAGE_DIR).select("row_id", "place", "filename", "path", "task_key")


def segments_for_matching(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.explode_for_matching(table(spark, d, "metadata").select("row_id", "segments"))
    return rows.select("row_id", "place", "segment.filename", "segment.path")


def replace_segment_labels(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "metadata").select("row_id", "segments")
    results = table(spark, d, "captions").select(
        F.element_at(F.split("image_path", "/"), -1).alias("filename"), F.array(F.lit("Set")).alias("labels")
    ).distinct()
    rows = segments.explode_for_matching(segments.replace_labels(meta, results, "row_id"))
    return rows.select("row_id", "place", F.coalesce(F.array_join("segment.labels", "+"), F.lit("null")).alias("labels"))


def set_nested_constant(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "metadata").select("row_id", segments.set_segment_size(F.col("segments")).alias("segments"))
    return segments.explode_for_matching(meta).select("row_id", "place", "segment.filename", "segment.width", "segment.height")


def _detections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "cast(l_orderkey as string) image_id", "1000 img_w", "1000 img_h", "case when l_linenumber = 7 then 'Table' else 'Picture' end cls",
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax",
        "0.5D - l_linenumber x1", "cast(0 as double) y1", "l_quantity * 20 x2", "l_extendedprice / 100 y2",
    )


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax")


def geometry_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = geometry.keep_boxes(geometry.clamp(_detections(spark, d).where("cls = 'Picture'")))
    return kept.groupBy("width").agg(F.count("*").alias("n"), F.sum(F.col("height").cast("bigint")).alias("heights"))


def crop_ordinal_naming(spark: SparkSession, d: str) -> DataFrame:
    return geometry.crops(_detections(spark, d), _ORDER).select("image_id", "filename", "width", "height")


def rebuild_segments(spark: SparkSession, d: str) -> DataFrame:
    boxes = geometry.crops(_detections(spark, d), _ORDER).select("image_id", "ordinal", "filename", "width", "height")
    arrays = segments.collect_segments(boxes, "image_id", ["ordinal"])
    return arrays.select("image_id", F.array_join(F.transform("segments", lambda s: s["filename"]), ",").alias("files"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    score = lambda c: F.struct((F.lit(1) + F.pmod(F.col(c), F.lit(10))).cast("double").alias("score"))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.create_map(F.lit("ScientificLaw"), score("l_partkey"), F.lit("EntityStructure"), score("l_suppkey"), F.lit("ScientificProcess"), score("l_orderkey")).alias("relevance"),
    )


def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).withColumn("labels", relevance.score_labels(F.col("relevance")))
    return rows.groupBy(F.array_join("labels", ",").alias("labels"), "l_linenumber").agg(F.count("*").alias("n"))


def relevance_labels_legacy(spark: SparkSession, d: str) -> DataFrame:
    rows = _scores(spark, d).withColumn("labels", relevance.score_labels(F.col("relevance"), dims=LEGACY_DIMENSIONS))
    return rows.groupBy(F.array_join("labels", ",").alias("labels")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select(relevance.score_labels(F.col("relevance")).alias("labels"))


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return relevance.label_counts(_labelled(spark, d))


def label_combo_top10(spark: SparkSession, d: str) -> DataFrame:
    return relevance.combination_counts(_labelled(spark, d))


def no_label_share(spark: SparkSession, d: str) -> DataFrame:
    return relevance.without_labels(_labelled(spark, d))


def drop_low_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return relevance.drop_low_reasoning(table(spark, d, "candidates")).select("candidate_id").distinct()


def cache_union_fresh_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cache = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("cache").alias("origin"))
    fresh = o.where("o_custkey % 3 = 0").select("o_orderkey", F.lit("fresh").alias("origin"))
    return relevance.union_fresh(fresh, cache, "o_orderkey")


_REPLY = """case event_id % 5 when 0 then '```json
{"relevance": ' || props || ', "confidence": 3}
```' when 1 then ' Sure: {"relevance": ' || props || ', "confidence": 3} done' when 2 then '{"result": {"relevance": ' || props || '}}'
when 3 then props else 'no answer {' end"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("props is not null").selectExpr("event_id", f"{_REPLY} as reply")


def json_clean_a(spark: SparkSession, d: str) -> DataFrame:
    x = jsonclean.relevance_reply(F.col("reply"))
    return _replies(spark, d).select("event_id", F.get_json_object(x, "$.relevance.k").alias("k"))


def json_clean_b(spark: SparkSession, d: str) -> DataFrame:
    x = jsonclean.annotation_reply(F.col("reply"))
    return _replies(spark, d).select("event_id", F.get_json_object(x, "$.relevance.k").alias("k"), x.isNotNull().alias("good"))


def json_clean_c(spark: SparkSession, d: str) -> DataFrame:
    x = jsonclean.checklist_reply(F.col("reply"))
    return _replies(spark, d).select("event_id", x["error"].alias("error"), F.get_json_object(x["json"], "$.relevance.k").alias("k"))


def json_clean_d(spark: SparkSession, d: str) -> DataFrame:
    x = jsonclean.judge_reply(F.col("reply"))
    return _replies(spark, d).select("event_id", x.isNull().alias("again"))


def path_functions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captions").where("image_path is not null")
    return c.select("row_id", stem(F.col("image_path")).alias("stem"), mime_type(F.col("image_path")).alias("mime"))


def licence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Batches stand for licences, late figures for closed ones."""
    rows = table(spark, d, "metadata").select("row_id", "batch", "image_id", "figure_caption")
    kept = filters.open_licence(rows, F.col("image_id").isNotNull(), F.col("batch").cast("string"), ("2", "6"), F.col("figure_caption"))
    return kept.select("row_id")


def keep_routing(spark: SparkSession, d: str) -> DataFrame:
    word = F.when(F.col("answer") == "Yes", "KEEP").when(F.col("answer") == "No", '{"decision": "reject"}')
    rows = table(spark, d, "evaluation_results").select("row_id", F.posexplode("evaluation.evaluation_results").alias("place", "v")).select("row_id", "place", "v.answer")
    return filters.route(rows, word, F.pmod(F.col("row_id"), F.lit(10)) / 10.0).select("row_id", "place", "route")


QUERIES = {
    f.__name__: f
    for f in (
        segments_attach, segments_explode_fallback, segments_for_matching, replace_segment_labels, set_nested_constant, geometry_filter, crop_ordinal_naming,
        rebuild_segments, relevance_labels, relevance_labels_legacy, label_counts, label_combo_top10, no_label_share, drop_low_reasoning,
        cache_union_fresh_wins, json_clean_a, json_clean_b, json_clean_c, json_clean_d, path_functions, licence_filter, keep_routing,
    )
}

_SEG = "s as (select row_id, segments, unnest(range(1, len(segments) + 1)) as i from metadata where segments is not null)"
_BOX = """
t as (select cast(l_orderkey as varchar) as image_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax) as ordinal,
    greatest(0, least(1000, cast(trunc(0.5::double - l_linenumber) as integer))) as x1, 0 as y1,
    greatest(0, least(1000, cast(trunc(l_quantity * 20) as integer))) as x2, greatest(0, least(1000, cast(trunc(l_extendedprice / 100) as integer))) as y2
  from lineitem where l_linenumber <> 7),
b as (select *, x2 - x1 as width, y2 - y1 as height from t where x2 > x1 and y2 > y1),
k as (select * from b where not (width::double * height / 1000000 > 0.75::double and width::double * height / 1000000 < 0.9::double)
    and width::double / height >= 0.33::double and width::double / height <= 3 and width >= 128 and height >= 128)
"""
_REL = """
s as (select l_linenumber, case when 1 + l_partkey % 10 >= 7 then 'ScientificLaw' end as a, case when 1 + l_suppkey % 10 >= 7 then 'EntityStructure' end as b,
      case when 1 + l_orderkey % 10 >= 7 then 'ScientificProcess' end as c from lineitem)
"""
_REPLIES = f"r as (select event_id, {_REPLY} as reply from events where props is not null)"
_STRIP = r"regexp_replace(reply, '^\s+|\s+$', '', 'g')"
_FENCED = rf"regexp_replace(regexp_replace(regexp_replace({_STRIP}, '(?m)^```(?:json)?\s*', '', 'g'), '\s*```$', ''), '^\s+|\s+$', '', 'g')"

ORACLE = {
    "segments_attach": """
select o_orderkey, count(l_orderkey) as n_segments, coalesce(arg_min(l_partkey, (l_linenumber, l_partkey)), -1) as first_part
from orders left join lineitem on o_orderkey = l_orderkey group by o_orderkey""",
    "segments_explode_fallback": f"""
with {_SEG},
a as (select row_id, cast(i - 1 as integer) as place, coalesce(nullif(segments[i].filename, ''), nullif(string_split(segments[i].path, '/')[-1], '')) as filename, segments[i].path as path
      from s where segments[i] is not null),
o as (select row_id, coalesce(nullif(local_path, ''), nullif(image_path, '')) as p from metadata where segments is null or len(segments) = 0),
u as (select * from a union all select row_id, 0, string_split(p, '/')[-1], p from o where p is not null),
v as (select row_id, place, filename, coalesce('{IMAGE_DIR}/' || filename, path) as path from u)
select row_id, place, filename, path, coalesce(nullif(path, ''), nullif(filename, '')) as task_key from v""",
    "segments_for_matching": f"with {_SEG} select row_id, cast(i - 1 as integer) as place, segments[i].filename as filename, segments[i].path as path from s where segments[i] is not null",
    "replace_segment_labels": f"""
with {_SEG}, r as (select distinct string_split(image_path, '/')[-1] as filename from captions where image_path is not null)
select row_id, cast(i - 1 as integer) as place, coalesce(case when r.filename is not null then 'Set' else array_to_string(segments[i].labels, '+') end, 'null') as labels
from s left join r on segments[i].filename = r.filename where segments[i] is not null""",
    "set_nested_constant": f"with {_SEG} select row_id, cast(i - 1 as integer) as place, segments[i].filename as filename, 1024 as width, 1024 as height from s where segments[i] is not null",
    "geometry_filter": f"with {_BOX} select width, count(*) as n, cast(sum(height) as bigint) as heights from k group by width",
    "crop_ordinal_naming": f"with {_BOX} select image_id, printf('%s_%02d.png', image_id, ordinal) as filename, width, height from k",
    "rebuild_segments": f"with {_BOX} select image_id, string_agg(printf('%s_%02d.png', image_id, ordinal), ',' order by ordinal) as files from k group by image_id",
    "relevance_labels": f"with {_REL} select concat_ws(',', a, b, c) as labels, l_linenumber, count(*) as n from s group by 1, 2",
    "relevance_labels_legacy": f"with {_REL} select concat_ws(',', b, c) as labels, count(*) as n from s group by 1",
    "label_counts": f"with {_REL}, e as (select unnest([a, b, c]) as label from s) select label, count(*) as n, round(100.0::double * count(*) / (select count(*) from s), 6) as share from e where label is not null group by label",
    "label_combo_top10": f"""
with {_REL}, e as (select concat_ws(' + ', b, a, c) as combination from s)
select combination, count(*) as n, round(100.0::double * count(*) / (select count(*) from s), 6) as share from e where combination <> '' group by 1 order by n desc, 1 limit 10""",
    "no_label_share": f"with {_REL} select count(*) filter (concat_ws('', a, b, c) = '') as n, count(*) as total, round(100.0::double * count(*) filter (concat_ws('', a, b, c) = '') / count(*), 6) as share from s",
    "drop_low_reasoning": "select distinct candidate_id from candidates where len(labels) > 0",
    "cache_union_fresh_wins": """
select o_orderkey, 'fresh' as origin from orders where o_custkey % 3 = 0
union all select o_orderkey, 'cache' from orders where o_orderstatus = 'F' and not (o_custkey % 3 = 0)""",
    "json_clean_a": f"""
with {_REPLIES} select event_id, case event_id % 5 when 0 then json_extract_string(props, '$.k') when 1 then json_extract_string(props, '$.k')
  when 2 then json_extract_string(props, '$.k') end as k from events where props is not null""",
    "json_clean_b": f"""
with {_REPLIES}, x as (select event_id, regexp_extract({_STRIP}, '(?s)(\\{{.*\\}})', 1) as j from r)
select event_id, case when json_valid(j) and j <> '' then json_extract_string(j, '$.relevance.k') end as k, (j <> '' and json_valid(j)) as good from x""",
    "json_clean_c": f"""
with {_REPLIES}, x as (select event_id, {_FENCED} as j from r)
select event_id, case when not json_valid(j) then 'Invalid JSON returned' end as error, case when json_valid(j) then json_extract_string(j, '$.relevance.k') end as k from x""",
    "json_clean_d": f"with {_REPLIES}, x as (select event_id, {_FENCED} as j from r) select event_id, not json_valid(j) as again from x",
    "licence_filter": r"""
select row_id from metadata where image_id is not null and batch in (2, 6) and not coalesce(regexp_matches(figure_caption,
  '(?i)\b(reproduced|reprinted|adapted|modified) (with permission )?from\b|\bcourtesy of\b|\bcopyright\b|©'), false)""",
    "keep_routing": """
with s as (select row_id, evaluation.evaluation_results as a, unnest(range(1, len(evaluation.evaluation_results) + 1)) as i from evaluation_results)
select row_id, cast(i - 1 as integer) as place, case when row_id % 10 / 10.0::double < 0.7::double or a[i].answer is null or a[i].answer not in ('Yes', 'No') then 'review'
  when a[i].answer = 'Yes' then 'keep' else 'reject' end as route from s""",
    "path_functions": r"""
select row_id, regexp_replace(string_split(image_path, '/')[-1], '(.)\.[^.]*$', '\1') as stem,
  case when lower(regexp_extract(image_path, '\.([^.]+)$', 1)) in ('jpg', 'jpeg', 'jpe') then 'image/jpeg' else 'image/png' end as mime from captions where image_path is not null""",
}
