"""A tree of Markdown files as a DataFrame."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file_path string, markdown string, updated_at timestamp"


def read_markdown(spark: SparkSession, root: str, within: Column | None = None) -> DataFrame:
    """Every ``.md`` below ``root``; bad bytes become the replacement character, a BOM stays.

    Spark lists the tree; it doesn't list files whose names begin with ``_`` or ``.``.
    In a file system that tasks can open, each file is opened by itself: links are
    left out, and a file that cannot be read has its reason as ``error`` and no
    content, while all others are read.  ``within``, a condition on ``file_path``,
    keeps other files closed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    if "://" in root and not root.startswith("file://"):
        remote = files.withColumnRenamed("path", "file_path")
        remote = remote if within is None else remote.where(within)
        return remote.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"), F.col("modificationTime").alias("updated_at"), F.lit(None).cast("string").alias("error"))
    # without the content, Spark only lists
    listed = files.select(F.regexp_replace("path", "^file:/{1,3}(?=/)|^file:(?=/)", "").alias("file_path"), F.col("modificationTime").alias("updated_at"))
    listed = listed if within is None else listed.where(within)
    read = listed.mapInPandas(_reader(root.removeprefix("file://")), "file_path string, content binary, updated_at timestamp, error string")
    return read.select("file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("markdown"), "updated_at", "error")


def _reader(root: str):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        real = os.path.realpath(root)
        for frame in frames:
            # neither a link nor below one
            frame = frame[[os.path.realpath(p) == os.path.normpath(os.path.join(real, os.path.relpath(p, root))) for p in frame["file_path"]]]
            for first in range(0, len(frame), 64):  # notes are small, but not all at once
                some = frame.iloc[first : first + 64]
                held = [_read(p) for p in some["file_path"]]
                yield some.assign(content=[c for c, _ in held], error=[e for _, e in held])[["file_path", "content", "updated_at", "error"]]

    return read


def _read(path: str) -> tuple[bytes | None, str | None]:
    try:
        with open(path, "rb") as file:
            return file.read(), None
    except OSError as fault:
        return None, f"{type(fault).__name__}: {fault.strerror or fault}"


def read_errors(files: DataFrame) -> DataFrame:
    """(file_path, message) of files without content; a reader that knows the reason gives it as ``error``."""
    why = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    return files.where("markdown is null").select("file_path", F.coalesce(why, F.lit("content could not be read")).alias("message"))
