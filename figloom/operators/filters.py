"""Corpus filters: licence, privacy, and routing of keep-or-reject decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figloom.functions.jsonclean import keep_decision

#: Captions that credit material of others.
THIRD_PARTY = r"(?i)\b(reproduced|reprinted|adapted|modified) (with permission )?from\b|\bcourtesy of\b|\bcopyright\b|©"


def open_licence(rows: DataFrame, is_open: Column, licence: Column, allowed: Sequence[str], caption: Column) -> DataFrame:
    """Open-access rows under one of the ``allowed`` licence strings, exactly, whose caption credits no third party.

    A null flag or licence is a refusal; a null caption credits nobody.
    """
    return rows.where(F.coalesce(is_open, F.lit(False)) & F.coalesce(licence.isin(*allowed), F.lit(False)) & ~F.coalesce(caption.rlike(THIRD_PARTY), F.lit(False)))


def private_by_default(rows: DataFrame, is_safe: Column) -> DataFrame:
    """Rows a classifier has cleared; unknown is refused."""
    return rows.where(F.coalesce(is_safe, F.lit(False)))


def route(rows: DataFrame, reply: Column, confidence: Column, least: float = 0.7) -> DataFrame:
    """Column ``route``: ``keep`` or ``reject`` as decided, ``review`` where confidence is low, missing, or there is no decision."""
    decision = keep_decision(reply)
    sure = F.coalesce(confidence >= least, F.lit(False))
    return rows.withColumn("route", F.when(decision.isNull() | ~sure, "review").when(decision == "KEEP", "keep").otherwise("reject"))
