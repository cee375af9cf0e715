"""Readers and writers: JSON arrays, JSON lines, image folders, partitioned and versioned outputs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figloom.functions.text import basename
from figloom.operators.images import encode_png

PREDICATES = {"png": r"\.png$", "any": r"(?i)\.(png|jpg|jpeg)$"}


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON array, declared types only. A missing file is an error; fields that do not fit become null."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def list_images(spark: SparkSession, folder: str, predicate: str = "any", prefix: str = "") -> DataFrame:
    """(name, path, length) of the images right in a folder, without reading them; in order of name.

    ``prefix`` keeps the names of one corpus, case counting.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length", basename(F.col("path")).alias("name"))
    named = files.where(F.col("name").rlike(PREDICATES[predicate]) & F.col("name").startswith(prefix))
    return named.orderBy("name").select("name", "path", "length")


def read_images(spark: SparkSession, folder: str, predicate: str = "any") -> DataFrame:
    """(name, path, content) of the images in a folder, content as it is in the files."""
    files = spark.read.format("binaryFile").load(folder).select(basename(F.col("path")).alias("name"), "path", "content")
    return files.where(F.col("name").rlike(PREDICATES[predicate]))


def read_pixels(spark: SparkSession, folder: str, predicate: str = "any") -> DataFrame:
    """(name, path, width, height, content) of the images in a folder of any format the JVM decodes, JPEG among them.

    ``content`` is a PNG of the decoded pixels, so the pixel operators read it whatever the file was; an image that
    cannot be decoded has nulls and is an error row there.
    """
    decoded = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    named = decoded.select(basename(F.col("origin")).alias("name"), F.col("origin").alias("path"), "width", "height", "nChannels", "data").where(F.col("name").rlike(PREDICATES[predicate]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.height <= 0 or r.width <= 0:
                    out.append((r.name, r.path, None, None, None))
                    continue
                px = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                px = px if r.nChannels == 1 else px[..., [2, 1, 0, *range(3, r.nChannels)]]  # the JVM gives blue first
                out.append((r.name, r.path, r.width, r.height, encode_png(px)))
            yield pd.DataFrame(out, columns=["name", "path", "width", "height", "content"]).astype({"width": "Int32", "height": "Int32"})

    return named.mapInPandas(run, "name string, path string, width int, height int, content binary")


def preview(rows: DataFrame, order: str, n: int = 3) -> DataFrame:
    """The first ``n`` rows in the given order, to look at."""
    return rows.orderBy(order).limit(n)


def write_json(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """JSON lines with null fields kept; partitions without rows write nothing. Readers see all of it or none."""
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy(*partition_by).json(path)


def write_version(df: DataFrame, root: str) -> str:
    """Write beside what is there, never over it, and return the new folder. The pointer is moved by ``publish``."""
    path = f"{root}/version={uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's file system of a path, and the path."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


_POINTER = re.compile(r"_current-(\d+)")


def _pointers(spark: SparkSession, root: str) -> list[int]:
    fs, there = _fs(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(there)] if fs.exists(there) else []
    return sorted(int(m.group(1)) for n in names if (m := _POINTER.fullmatch(n)))


def publish(spark: SparkSession, root: str, path: str) -> None:
    """Make ``path`` the current version of ``root``.

    A pointer is written beside the others under a hidden name and renamed to the next number, so a reader finds the
    old one or the new one, never none or half of one. Of two writers at once, one fails.
    """
    n = ([0, *_pointers(spark, root)])[-1] + 1
    fs, part = _fs(spark, f"{root}/.pointer-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(path.encode()))
    out.close()
    target = _fs(spark, f"{root}/_current-{n}")[1]
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(f"another version {n} of {root} was published meanwhile")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version published last."""
    numbers = _pointers(spark, root)
    if not numbers:
        raise FileNotFoundError(f"{root} has no published version")
    fs, there = _fs(spark, f"{root}/_current-{numbers[-1]}")
    source = fs.open(there)
    path = bytes(source.readAllBytes()).decode()
    source.close()
    return spark.read.parquet(path)


def write_images(images: DataFrame, folder: str) -> None:
    """Write (name, content) as files of a folder all executors share, a local path or a URI; a name written twice ends
    with either whole."""

    def put(rows) -> None:  # noqa: ANN001
        from pyarrow import fs as pafs

        there, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)
        there.create_dir(base, recursive=True)
        for r in rows:
            part = f"{base}/.{r['name']}.{uuid.uuid4().hex}"
            with there.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            there.move(part, f"{base}/{r['name']}")

    images.select("name", "content").where("content is not null").foreachPartition(put)


def write_split(rows: DataFrame, images: DataFrame, root: str, group: str = "group_name", half: str = "half", name: str = "image_filename") -> None:
    """``<root>/<group>/<half>/`` with the rows as JSON lines, and beside them ``images/`` with the files they name.

    ``images``: (name, content). Groups and halves without rows write nothing.
    """
    write_json(rows, root, (group, half))
    placed = rows.select(group, half, F.col(name).alias("name")).distinct().join(images.select("name", "content"), "name")
    for r in rows.select(group, half).distinct().collect():  # groups and halves: a handful
        part = placed.where((F.col(group) == r[group]) & (F.col(half) == r[half]))
        write_images(part, f"{root}/{group}={r[group]}/{half}={r[half]}/images")
