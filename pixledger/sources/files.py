"""File listings and sidecar texts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.functions import paths
from pixledger.session import shared_dir
from pixledger.sources.stores import Stores, as_local, error_of, is_url, open_file, opened

_ENTRY = "path string, is_dir boolean, micros bigint, length bigint, error string, target string"
_ROWS_PER_BATCH = 10_000


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, length of all files below a root, names of every kind included.

    Folders that cannot be listed have no rows here; ``walk_tree`` names them.
    """
    return files_of(walk_tree(spark, root))


def files_of(entries: DataFrame) -> DataFrame:
    """The files among the entries of ``walk_tree``."""
    return entries.where("NOT is_dir AND error IS NULL").select("path", "mtime", "length")


def errors_of(entries: DataFrame) -> DataFrame:
    """Folders that could not be listed: path, and error as ``schemas.ERRORS`` names it."""
    return entries.where("error IS NOT NULL").select("path", F.col("error").alias("error_type"))


def local_path(url: F.Column) -> F.Column:
    """``file:/a/b`` and ``file:///a/b`` as ``/a/b``; other paths untouched."""
    return F.regexp_replace(url, r"\Afile:/+", "/")


def root_path(root: str) -> str:
    """A root as the paths of its listing begin: absolute, without ``file:`` and slashes at the end."""
    return root.rstrip("/") if is_url(root) else os.path.abspath(as_local(root))


def walk_tree(spark: SparkSession, root: str, stores: Stores | None = None) -> DataFrame:
    """All entries below a root, hidden ones and folders included: path, is_dir,
    mtime, length, error, target.

    One job per tree level lists that level's folders in parallel, by the file systems
    of ``sources.stores``; each level is written to the shared folder so that no level is
    listed twice. A folder that cannot be listed, a missing root, or a store that no
    file system of the tasks opens has a row of its own with ``error``; the walk goes on.

    A link has the path it resolves to as ``target``. A linked folder is not walked again: what it
    shows is listed under its target. A link that leads out of the root has the error
    ``permission``, one that leads nowhere or in a circle ``not_found``.
    """
    out = shared_dir(spark, "walk")
    level = 0
    base = root_path(root)
    folders = spark.createDataFrame([(base,)], "path string")
    while True:
        target = f"{out}/level={level}"
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        folders.repartition(width, "path").mapInPandas(_lister(base, dict(stores or {})), _ENTRY).write.parquet(target)
        folders = spark.read.schema(_ENTRY).parquet(target).where("is_dir AND error IS NULL AND target IS NULL").select("path")
        if folders.isEmpty():
            break
        level += 1
    entries = spark.read.schema(_ENTRY).option("recursiveFileLookup", True).parquet(out)
    return entries.select(
        "path", "is_dir", F.timestamp_micros("micros").cast("timestamp_ntz").alias("mtime"), "length", "error", "target"
    )


def links_of(entries: DataFrame) -> DataFrame:
    """path and target of the links among the entries of ``walk_tree`` that lead to something below the root."""
    return entries.where("target IS NOT NULL AND error IS NULL").select("path", "target")


def _entries(folder: str, root: str, stores: Stores) -> Iterator[tuple]:
    if is_url(folder):
        system, inner = opened(folder, stores)
        for info in system.get_file_info(fs.FileSelector(inner)):
            micros = (info.mtime_ns or 0) // 1000
            yield f"{folder.rstrip('/')}/{info.base_name}", info.type == fs.FileType.Directory, micros, info.size, None, None
        return
    inside = os.path.realpath(root)
    with os.scandir(folder) as entries:
        for entry in entries:
            target, error = None, None
            try:
                if entry.is_symlink():
                    target = os.path.realpath(entry.path, strict=True)
                    if os.path.commonpath([inside, target]) != inside:
                        error = "permission"
                stat = entry.stat()
                micros, length = stat.st_mtime_ns // 1000, stat.st_size
            except OSError:
                micros, length = 0, None
                error = "not_found" if entry.is_symlink() else None
            yield entry.path, error is None and entry.is_dir(), micros, length, error, target


def _lister(root: str, stores: Stores):
    columns = ["path", "is_dir", "micros", "length", "error", "target"]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for folder in batch["path"]:
                try:
                    for row in _entries(folder, root, stores):
                        rows.append(row)
                        if len(rows) == _ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=columns)
                            rows = []
                except OSError as failure:
                    rows.append((folder, True, 0, None, error_of(failure), None))
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    return listed


def list_inventory(listing: DataFrame, root: str) -> DataFrame:
    """Add folder and name to the visible images of a listing (path, mtime, length) of ``root``.

    Names that start with a dot, and what lies in folders named so below
    ``root``, are left out; the root itself may lie in such a folder. A missing time counts as the epoch. Further columns are kept.
    """
    name = paths.file_name(F.col("path"))
    return listing.where(~paths.in_hidden(F.col("path"), root) & paths.is_image(name)).withColumns(
        {
            "folder": paths.parent(F.col("path")),
            "name": name,
            "mtime": F.coalesce("mtime", F.lit("1970-01-01").cast("timestamp_ntz")),
        }
    )


def list_by_suffix(listing: DataFrame, root: str, ending: str = ".html") -> DataFrame:
    """Files whose name ends so, in any case, as paths from ``root`` with a leading slash."""
    base = root.rstrip("/")
    return listing.where(
        F.startswith("path", F.lit(base + "/")) & F.endswith(F.lower("path"), F.lit(ending.lower()))
    ).select(F.substr("path", F.lit(len(base) + 1)).alias("url_path"))


def read_texts(listing: DataFrame, stores: Stores | None = None) -> DataFrame:
    """path and content of the ``.txt`` files of a listing; unreadable ones have no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open_file(path, stores) as file:
                        content = file.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([content], pa.binary())], ["path", "content"])

    return listing.where(F.endswith("path", F.lit(".txt"))).select("path").mapInArrow(read, "path string, content binary")


def sidecars(texts: DataFrame) -> DataFrame:
    """folder, stem and text of sidecar files (path, content bytes).

    Bytes that are not UTF-8 are dropped and line ends become newlines, as a text
    file read in Python gives them.
    """
    name = paths.file_name(F.col("path"))
    raw = F.col("content").cast("string")
    valid = F.when(F.is_valid_utf8(raw), raw).otherwise(
        F.replace(F.make_valid_utf8(raw), F.lit("�"), F.lit(""))
    )
    return texts.where(F.endswith(name, F.lit(".txt"))).select(
        paths.parent(F.col("path")).alias("folder"),
        paths.stem(name).alias("stem"),
        F.regexp_replace(valid, r"\r\n?", "\n").alias("text"),
    )
