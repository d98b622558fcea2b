"""Incremental work: skip file states that are in the catalog already."""

from __future__ import annotations

from pyspark.sql import DataFrame

VERSION_KEY = ["path", "mtime", "length"]


def unparsed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose (path, mtime, length) is not among ``done``.

    The key is unique per file, so no partition of the join can be hot.
    """
    return files.join(done.select(*VERSION_KEY), VERSION_KEY, "left_anti")


def one_per_version(files: DataFrame) -> DataFrame:
    """One row per file state, as repeated listings bring the same one again."""
    return files.dropDuplicates(VERSION_KEY)
