"""Mixing sources to target weights, in tokens of a public tokenizer.

Tokens are counted once and written; totals per source are a map-side aggregate. The size of the mix is the largest
at which every source reaches its share without being repeated more often than allowed: the scarcest source, with
``max_repeats`` copies, sets it. Each document is emitted floor(rate) times plus one copy drawn by a hash of its id
with the fraction as probability, so the result is the same on every run and needs no exchange. With a size given, a
source that cannot fill its share within its repeats stops there, and the report shows what it lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.llm.tokenise import TOKENIZERS, VOCABULARY, encode
from figloom.session import durable

SEED = 20240501


def source_name(c: Column) -> Column:
    """Source in lower case without surrounding blanks; null where nothing is left."""
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(s != "", s)


def sized(documents: DataFrame, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, written to the shared folder."""
    named = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text")
    return durable(encode(named, path=path, keep=("source",), counts_only=True), "tokens")


def rates(sizes: DataFrame, targets: DataFrame, size: float | Column | None = None) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, tokens, share, rate) of each target.

    ``share`` is the target among the sources that have tokens; a source without tokens (or with a share or
    ``max_repeats`` of 0 or less, or null) has rate 0 and the others keep their proportions. Targets that repeat a
    source are added up. ``size`` is the number of tokens wanted: shares are filled up to it as far as repeats allow.
    By default it is the largest at which every source with tokens reaches its share.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    plan = wanted.join(have, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    usable = F.coalesce((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.lit(False))
    shares = plan.where(usable).agg(F.sum("target_share")).scalar()
    if size is None:
        whole = plan.where(usable).agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).scalar()
    else:
        whole = (size if isinstance(size, Column) else F.lit(float(size))) / shares
    rate = F.least(F.round(F.col("target_share") * whole / F.col("tokens"), 9), F.col("max_repeats").cast("double"))
    return plan.select(
        "source", "target_share", "max_repeats", "n_docs", "tokens",
        F.when(usable, F.col("target_share") / shares).otherwise(0.0).alias("share"),
        F.when(usable, rate).otherwise(0.0).alias("rate"),
    )


def mix(sizes: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, copy_no, source, n_tokens): the documents of the mix, a copy a row, copies numbered from 1.

    A document without tokens counts nothing and is drawn like any other of its source.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    times = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    # the plan has a row per target, so the planner sends it to the documents
    chosen = sizes.join(plan.select("source", "rate"), "source").withColumn("_times", times.cast("int")).where("_times > 0")
    return chosen.select("doc_id", F.explode(F.sequence(F.lit(1), "_times")).alias("copy_no"), "source", "n_tokens")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with n_rows, mixed_tokens and actual_share of each target in the mix; a source that stopped at its repeats
    has an actual_share below its share."""
    got = mixed.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("mixed_tokens"))
    whole = got.agg(F.sum("mixed_tokens")).scalar()
    return plan.join(got, "source", "left").select(
        *plan.columns, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.coalesce(F.col("mixed_tokens") / whole, F.lit(0.0)).alias("actual_share"),
    )
