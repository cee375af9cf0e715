"""Resumable stages: what is processed is skipped, successes are appended, failures come again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from figloom.session import durable


def load_cache(spark: SparkSession, path: str, schema: str, on_corrupt: str = "raise") -> DataFrame:
    """The results so far, empty where there are none. Paid results are not lost silently: unreadable files are an
    error unless ``on_corrupt='reset'``."""
    empty = spark.createDataFrame([], schema)
    try:
        cached = spark.read.schema(schema).parquet(path)
        if on_corrupt == "reset":
            try:
                cached.count()
            except Exception:  # noqa: BLE001
                return empty
        return cached
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        if on_corrupt == "reset":
            return empty
        raise


def pending(tasks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Tasks without a cached result; repeated tasks stay repeated."""
    return tasks.join(cache.select(key), key, "left_anti")


def append_outputs(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cached and new outputs one after the other, nothing removed."""
    return cached.unionByName(fresh)


def run_once(tasks: DataFrame, path: str, stage: Callable[[DataFrame], DataFrame], schema: str, key: str = "key", good: str = "error is null", flush: int | None = None) -> DataFrame:
    """Run ``stage`` on what is pending, append the successes, and return all results, one per key.

    With ``flush`` the pending tasks are cut by a hash of their key into batches of about as many rows, and each batch is
    committed before the next begins: a run that dies has paid for one batch at most, and the next run asks for the rest.
    The tasks of the batches are kept, by batch, so none is found out twice. Batches that fail do not stop the others;
    the first error is raised at the end.
    """
    todo = pending(tasks, load_cache(tasks.sparkSession, path, schema), key)
    if flush:
        todo = durable(todo, "pending")
        batches = max(1, -(-todo.count() // flush))
    else:
        batches = 1
    if batches > 1:
        number = F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")
        todo = durable(todo.withColumn("_batch", number), "batches", partition_by=("_batch",))
    failed: Exception | None = None
    for k in range(batches):
        part = todo.where(F.col("_batch") == k).drop("_batch") if batches > 1 else todo
        try:
            stage(part).where(good).write.mode("append").parquet(path)
        except Exception as e:  # noqa: BLE001
            failed = failed or e
    if failed is not None:
        raise failed
    return load_cache(tasks.sparkSession, path, schema).dropDuplicates([key])


def counters(tasks: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """(total, cached, pending) of a run."""
    flagged = tasks.join(cache.select(key).distinct().withColumn("_c", F.lit(1)), key, "left")
    return flagged.agg(F.count("*").alias("total"), F.count("_c").alias("cached"), F.count_if(F.col("_c").isNull()).alias("pending"))
