"""Queries of benchmark selection, checklists, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.functions.text import basename
from figloom.operators import checklist, score, segments, select
from figloom.session import table
from figloom.settings import Settings


def _segments(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.explode_for_matching(table(spark, d, "metadata").select("row_id", "segments"))
    return rows.select(F.col("row_id").alias("article"), "place", "segment.filename", "segment.path")


def _matched(spark: SparkSession, d: str) -> DataFrame:
    capt = table(spark, d, "captions").select("row_id", "image_path", "reasoning", "rendered_text_stage2", "retained_text_stage3")
    return select.match_captions(_segments(spark, d), capt)


def caption_match_two_key(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("article", "place", "filename", F.col("row_id").alias("caption"))


def dedup_last_wins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captions").select("row_id", basename(F.col("image_path")).alias("name"))
    return segments.keep_last(c, ["name"], ["row_id"])


def dedup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return segments.keep_first(_segments(spark, d), ["filename"], ["article", "place"]).select("article", "place", "filename")


def derive_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = select.content_labels(F.col("reasoning"))
    both = select.content_labels(F.col("reasoning"), require_visualization=True)
    return table(spark, d, "captions").select("row_id", F.array_join(labels, "+").alias("labels"), F.array_join(both, "+").alias("with_visualization"))


def group_naming(spark: SparkSession, d: str) -> DataFrame:
    g = select.group_name(select.content_labels(F.col("reasoning")))
    return table(spark, d, "captions").groupBy(g.alias("group_name")).agg(F.count("*").alias("n"))


def term_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "captions").select("row_id", select.term_count(F.col("reasoning")).cast("bigint").alias("terms"))


def null_out_empty(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captions").select("row_id", select.null_out_empty(F.col("reasoning")).alias("r"))
    return c.select("row_id", F.explode("r").alias("track", "v")).select("row_id", "track", F.col("v").isNull().alias("is_null"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("candidate_id", "group_name", "term_count", "rendered_len", "retained_len").distinct()
    return rows.where("group_name is not null and term_count is not null")


def iqr_chain(spark: SparkSession, d: str) -> DataFrame:
    return select.iqr_chain(_candidates(spark, d)).select("candidate_id", "group_name")


def iqr_chain_exact_band(spark: SparkSession, d: str) -> DataFrame:
    return select.iqr_band(_candidates(spark, d), "group_name", "term_count", slack=0.0).select("candidate_id", "group_name")


def median_split(spark: SparkSession, d: str) -> DataFrame:
    return select.median_split(_candidates(spark, d)).select("candidate_id", "group_name", "half")


def more_terms(spark: SparkSession, d: str) -> DataFrame:
    return select.more_terms(_candidates(spark, d)).select("candidate_id")


def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    return select.stage_counts(_candidates(spark, d))


def select_iqr_split(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: segments matched with captions, de-duplicated, labelled, grouped, banded three times, split."""
    rows = select.candidates(_matched(spark, d), ["article", "place"])
    done = select.median_split(select.iqr_chain(rows.select("filename", "row_id", "group_name", "term_count", "rendered_len", "retained_len"), slack=Settings.of(spark).iqr_slack))
    return done.select("filename", F.col("row_id").alias("caption"), "group_name", F.col("term_count").cast("bigint").alias("term_count"), "half")


def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "evaluation_results").select("image_filename")
    return table(spark, d, "candidates").select("candidate_id", "image_filename").join(done, "image_filename", "left_anti")


def exists_semi(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "captions").select(basename(F.col("image_path")).alias("image_filename"))
    return table(spark, d, "candidates").select("candidate_id", "image_filename").join(listing, "image_filename", "left_semi")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evaluation_results").select(F.col("image_filename").alias("name")).where("name is not null").distinct()


def present_items(spark: SparkSession, d: str) -> DataFrame:
    return select.present(table(spark, d, "candidates").select("candidate_id", "image_filename"), _listing(spark, d))


def missing_feedback(spark: SparkSession, d: str) -> DataFrame:
    missing = select.missing_names(table(spark, d, "candidates"), _listing(spark, d))
    meta = table(spark, d, "metadata").where("segments is not null").select("row_id", "segments")
    left = select.segments_without_missing(meta, missing, "row_id")
    return left.select("row_id", F.size("segments").cast("bigint").alias("n_left"))


def missing_captions(spark: SparkSession, d: str) -> DataFrame:
    missing = select.missing_names(table(spark, d, "candidates"), _listing(spark, d))
    return select.without_missing(table(spark, d, "captions").select("row_id", "image_path"), missing).select("row_id")


def active_tracks(spark: SparkSession, d: str) -> DataFrame:
    t = checklist.active_tracks(F.col("reasoning"))
    return table(spark, d, "captions").select("row_id", checklist.tracks_text(t).alias("tracks"), F.size(t).cast("bigint").alias("n"))


def prompt_mode_route(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("row_id") % 3 == 0, "cot").when(F.col("row_id") % 3 == 1, "abstract").otherwise("other")
    return table(spark, d, "captions").select("row_id", checklist.prompt_of(mode, F.col("`sci-RCoT`"), F.col("science_abstract_prompt")).alias("prompt"))


def error_routing(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "evaluation_results").select("row_id", "image_filename", "mode")
    prompts = table(spark, d, "captions").select(
        F.col("row_id").alias("pos"), basename(F.col("image_path")).alias("image_filename"), F.col("`sci-RCoT`").alias("long"), F.col("science_abstract_prompt").alias("short")
    )
    images = table(spark, d, "candidates").select(F.col("image_filename").alias("name"))
    return checklist.judge_requests(items, prompts, images, "pos").select("row_id", "error")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return score.sample_scores(score.verdicts(table(spark, d, "evaluation_results")).where("category is not null"))


def verdict_explode(spark: SparkSession, d: str) -> DataFrame:
    return score.verdicts(table(spark, d, "evaluation_results")).groupBy("category", "answer").agg(F.count("*").alias("n"))


def veto_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def accuracy_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return score.by_mode_and_pooled(_scored(spark, d))


def threshold80_and_average(spark: SparkSession, d: str) -> DataFrame:
    return score.accuracy(_scored(spark, d), ["category"])


def accuracy_all_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluation_results").select("mode", "image_filename").where("mode is not null and image_filename is not null").distinct()
    scored = _scored(spark, d).where("mode is not null and image_filename is not null")
    return score.accuracy(scored, ["category"], samples=rows).select("category", "n", "strict")


def errors_excluded(spark: SparkSession, d: str) -> DataFrame:
    rows = score.verdicts(table(spark, d, "evaluation_results")).where("category is not null")
    return score.accuracy(score.sample_scores(rows, errors="exclude"), ["category"])


def final_score(spark: SparkSession, d: str) -> DataFrame:
    return score.final_score(_scored(spark, d))


def score_delta(spark: SparkSession, d: str) -> DataFrame:
    return score.score_delta(score.accuracy(_scored(spark, d), ["category", "mode"]), ["category"], "mode", "cot", "abstract")


def metric_rank(spark: SparkSession, d: str) -> DataFrame:
    return score.rank_models(score.accuracy(_scored(spark, d).where("mode is not null"), ["category", "mode"]), ["category"], "strict").select("category", "mode", "place")


QUERIES = {
    f.__name__: f
    for f in (
        select_iqr_split, caption_match_two_key, dedup_last_wins, dedup_first_wins, derive_labels, group_naming, term_count, null_out_empty, iqr_chain,
        iqr_chain_exact_band, median_split, more_terms, stage_counts, pending_anti, exists_semi, present_items, missing_feedback, missing_captions,
        active_tracks, prompt_mode_route, error_routing, verdict_explode, veto_accuracy, accuracy_by_mode, threshold80_and_average, accuracy_all_samples,
        errors_excluded, final_score, score_delta, metric_rank,
    )
}

_TR = "('EntityStructure', 'ScientificLaw', 'ScientificProcess')"
_ENT = """
e as (select row_id, unnest(map_entries(reasoning)) as kv from captions where reasoning is not null),
tr as (select row_id, kv.key as track, kv.value is null as is_null, coalesce(len(kv.value.terms), 0) as nt, coalesce(len(kv.value.visualization), 0) as nv from e)
"""
_LAB = _ENT + f""",
lab as (select c.row_id, coalesce(string_agg(track, '_' order by track), '') as labels, count(track) as k
        from captions c left join tr on tr.row_id = c.row_id and tr.nt > 0 and tr.track in {_TR} group by c.row_id),
tc as (select c.row_id, cast(coalesce(sum(nt), 0) as bigint) as terms from captions c left join tr on tr.row_id = c.row_id and tr.track in {_TR} group by c.row_id)
"""
_SEGS = """
s0 as (select row_id as article, segments, unnest(range(1, len(segments) + 1)) as i from metadata where segments is not null),
s as (select article, cast(i - 1 as integer) as place, segments[i].filename as filename, segments[i].path as path from s0 where segments[i] is not null),
c0 as (select row_id, string_split(image_path, '/')[-1] as name from captions where image_path is not null and string_split(image_path, '/')[-1] <> ''),
c as (select name, max(row_id) as row_id from c0 group by name),
m as (select s.article, s.place, s.filename, coalesce(a.row_id, b.row_id) as caption from s
      left join c a on nullif(s.filename, '') = a.name left join c b on nullif(string_split(s.path, '/')[-1], '') = b.name
      where coalesce(a.row_id, b.row_id) is not null)
"""
_CAND = "c0 as (select distinct candidate_id, group_name, term_count, rendered_len, retained_len from candidates where group_name is not null and term_count is not null)"


def _bands(start: str, key: str) -> str:
    out, prev = "", start
    for i, v in enumerate(("term_count", "rendered_len", "retained_len"), 1):
        out += f""",
q{i} as (select group_name, quantile_cont(cast({v} as double), 0.25) as lo, quantile_cont(cast({v} as double), 0.75) as hi from {prev} group by 1),
s{i} as (select x.* from {prev} x join q{i} using (group_name) where cast(x.{v} as double) between lo - 1 and hi + 1)"""
        prev = f"s{i}"
    return out


_V = """
v0 as (select image_filename, mode, unnest(evaluation.evaluation_results) as v from evaluation_results),
v as (select image_filename, mode, v.category as category, v.answer as answer, coalesce(lower(trim(v.answer)) = 'yes', false) as yes from v0 where v is not null)
"""
_SC = _V + ", sc as (select mode, category, image_filename, bool_and(yes) as strict, avg(cast(yes as double)) as rate from v where category is not null group by 1, 2, 3)"
_ACC = "count(*) as n, round(100 * avg(cast(strict as double)), 6) as strict, round(100 * avg(cast(rate >= 0.8::double as double)), 6) as at_threshold, round(100 * avg(rate), 6) as average"
_MISSING = """
listing as (select distinct image_filename as name from evaluation_results where image_filename is not null),
missing as (select distinct image_filename as name from candidates where image_filename <> '' and image_filename not in (select name from listing))
"""

ORACLE = {
    "select_iqr_split": f"""
with {_LAB}, {_SEGS},
f as (select *, row_number() over (partition by filename order by article, place) as r from m),
c1 as (select f.filename, f.caption, case when k = 2 then labels when k = 3 then 'All_Three' end as group_name, tc.terms as term_count,
       coalesce(len(captions.rendered_text_stage2), 0) as rendered_len, coalesce(len(captions.retained_text_stage3), 0) as retained_len
       from f join lab on lab.row_id = f.caption join tc on tc.row_id = f.caption join captions on captions.row_id = f.caption where r = 1 and k >= 2)
{_bands('c1', 'filename')},
md as (select group_name, median(term_count) as md from s3 group by 1)
select filename, caption, group_name, term_count, case when term_count < md then 'prompt' else 'CoT' end as half from s3 join md using (group_name)""",
    "caption_match_two_key": f"with {_SEGS} select article, place, filename, caption from m",
    "dedup_last_wins": "select max(row_id) as row_id, coalesce(string_split(image_path, '/')[-1], '') as name from captions group by 2",
    "dedup_first_wins": f"with {_SEGS}, f as (select *, row_number() over (partition by filename order by article, place) as r from s) select article, place, filename from f where r = 1",
    "derive_labels": f"""
with {_ENT} select c.row_id, coalesce(string_agg(track, '+' order by track) filter (nt > 0), '') as labels, coalesce(string_agg(track, '+' order by track) filter (nt > 0 and nv > 0), '') as with_visualization
from captions c left join tr on tr.row_id = c.row_id and tr.track in {_TR} group by c.row_id""",
    "group_naming": f"with {_LAB} select case when k = 2 then labels when k = 3 then 'All_Three' end as group_name, count(*) as n from lab group by 1",
    "term_count": f"with {_LAB} select row_id, terms from tc",
    "null_out_empty": f"with {_ENT} select row_id, track, is_null or (track in {_TR} and nt = 0 and nv = 0) as is_null from tr",
    "iqr_chain": f"with {_CAND}{_bands('c0', 'candidate_id')} select candidate_id, group_name from s3",
    "iqr_chain_exact_band": f"""
with {_CAND}, q as (select group_name, quantile_cont(cast(term_count as double), 0.25) as lo, quantile_cont(cast(term_count as double), 0.75) as hi from c0 group by 1)
select candidate_id, group_name from c0 join q using (group_name) where term_count between lo and hi""",
    "median_split": f"with {_CAND}, md as (select group_name, median(term_count) as md from c0 group by 1) select candidate_id, group_name, case when term_count < md then 'prompt' else 'CoT' end as half from c0 join md using (group_name)",
    "more_terms": f"with {_CAND} select candidate_id from c0 where term_count > 3",
    "stage_counts": f"with {_CAND}{_bands('c0', 'candidate_id')} " + " union all ".join(f"select {i} as stage, group_name, count(*) as n from {t} group by 2" for i, t in enumerate(("c0", "s1", "s2", "s3"))),
    "pending_anti": "select candidate_id, image_filename from candidates c where not exists (select 1 from evaluation_results e where e.image_filename = c.image_filename)",
    "exists_semi": "select candidate_id, image_filename from candidates c where exists (select 1 from captions t where coalesce(string_split(t.image_path, '/')[-1], '') = c.image_filename)",
    "present_items": f"with {_MISSING} select candidate_id, image_filename from candidates where image_filename is null or image_filename = '' or image_filename in (select name from listing)",
    "missing_feedback": f"""
with {_MISSING}, s as (select row_id, segments, unnest(range(1, len(segments) + 1)) as i from metadata where segments is not null),
k as (select row_id, count(*) as n from s where segments[i].filename is null or segments[i].filename not in (select name from missing) group by 1)
select m.row_id, coalesce(k.n, 0) as n_left from metadata m left join k using (row_id) where m.segments is not null""",
    "missing_captions": f"with {_MISSING} select row_id from captions where coalesce(string_split(image_path, '/')[-1], '') not in (select name from missing)",
    "active_tracks": f"with {_ENT} select c.row_id, coalesce(string_agg(track, ', ' order by track), 'General') as tracks, count(track) as n from captions c left join tr on tr.row_id = c.row_id and not is_null group by c.row_id",
    "prompt_mode_route": """select row_id, case when row_id % 3 = 1 then science_abstract_prompt else "sci-RCoT" end as prompt from captions""",
    "error_routing": """
with p0 as (select row_id as pos, coalesce(string_split(image_path, '/')[-1], '') as f, "sci-RCoT" as long, science_abstract_prompt as short from captions),
p as (select * from p0 qualify row_number() over (partition by f order by pos desc) = 1),
l as (select distinct image_filename as f from candidates where image_filename is not null)
select e.row_id, case when l.f is null then 'Image file not found' when nullif(case when e.mode = 'abstract' then p.short else p.long end, '') is null then 'Prompt not found' end as error
from evaluation_results e left join l on l.f = e.image_filename left join p on p.f = e.image_filename""",
    "verdict_explode": f"with {_V} select category, answer, count(*) as n from v group by 1, 2",
    "veto_accuracy": f"with {_SC} select * from sc",
    "accuracy_by_mode": f"with {_SC} select category, case when grouping(m) = 1 then 'Avg' else m end as mode, round(100 * avg(s), 6) as strict from (select category, coalesce(mode, 'unknown') as m, cast(strict as double) as s from sc) group by grouping sets ((category, m), (category))",
    "threshold80_and_average": f"with {_SC} select category, {_ACC} from sc group by 1",
    "accuracy_all_samples": f"""
with {_SC}, p as (select distinct mode, image_filename from evaluation_results where mode is not null and image_filename is not null),
a as (select c.category, coalesce(sc.strict, true) as strict from (select distinct category from sc where mode is not null and image_filename is not null) c cross join p
      left join sc on sc.category = c.category and sc.mode = p.mode and sc.image_filename = p.image_filename)
select category, count(*) as n, round(100 * avg(cast(strict as double)), 6) as strict from a group by 1""",
    "errors_excluded": f"with {_V}, sc as (select mode, category, image_filename, bool_and(yes) as strict, avg(cast(yes as double)) as rate from v where category is not null and answer is not null group by 1, 2, 3) select category, {_ACC} from sc group by 1",
    "final_score": f"with {_SC}, a as (select category, avg(cast(strict as double)) as a from sc where category in ('EntityStructure', 'ScientificLaw', 'ScientificProcess', 'Text') group by 1) select round(100 * avg(a), 6) as final from a",
    "score_delta": f"with {_SC}, a as (select category, mode, round(100 * avg(cast(strict as double)), 6) as s from sc group by 1, 2) select x.category, round(x.s - y.s, 6) as delta from a x join a y on x.category = y.category and x.mode = 'cot' and y.mode = 'abstract'",
    "metric_rank": f"with {_SC}, a as (select category, mode, round(100 * avg(cast(strict as double)), 6) as s from sc where mode is not null group by 1, 2) select category, mode, cast(rank() over (partition by category order by s desc) as integer) as place from a",
}
