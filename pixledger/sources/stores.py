"""Which file system opens a path: mounted ones, object stores and Hadoop stores.

Tasks open files themselves, so that headers can be read by range. A path without a
scheme, or of ``file:``, is one of a mounted file system. A URL is opened by the
first that can:

1. ``stores``, a dict from scheme to a function of the URL that returns an Arrow file
   system and the path in it (any ``fsspec`` system wrapped by ``pyarrow.fs.PyFileSystem``
   does); functions go to the tasks with the job;
2. Arrow's own system of the scheme, by its usual name (``s3a`` is ``s3``);
3. the mount point of stores that clusters mount (``dbfs:/x`` is ``/dbfs/x``);
4. Hadoop's client library, which knows every scheme the cluster is configured for.

Where none can, ``UnknownStore`` is raised, an ``OSError``: operators give an error
row then. Such stores are read by Spark's own file source (``spark_listing``).
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Opener = Callable[[str], tuple[fs.FileSystem, str]]
Stores = Mapping[str, Opener]

#: Hadoop's names of schemes, and Arrow's.
ARROW_NAMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "gcs": "gs", "abfss": "abfs", "abfs": "abfs", "hdfs": "hdfs", "viewfs": "viewfs"}
MOUNTS = {"dbfs": "/dbfs"}
_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?=/)")


class UnknownStore(OSError):
    """No file system of the tasks opens this URL."""


def scheme(path: str) -> str | None:
    """The scheme of a URL (``s3a://b/x``, ``dbfs:/x``) in lower case; None for a path."""
    found = _SCHEME.match(path)
    return found[1].lower() if found else None


def is_url(path: str) -> bool:
    return scheme(path) not in (None, "file")


def as_local(path: str) -> str:
    """``file:/a`` and ``file:///a`` as ``/a``; other paths untouched."""
    return re.sub(r"\A(?i:file):/+", "/", path)


@functools.lru_cache(64)
def _arrow_system(url: str, kind: str) -> fs.FileSystem:
    return fs.FileSystem.from_uri(f"{ARROW_NAMES[kind]}{url[len(kind):]}")[0]


@functools.lru_cache(64)
def _hadoop_system(store: str) -> fs.FileSystem:
    return fs.HadoopFileSystem(store)


def opened(url: str, stores: Stores | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a URL and the path in it."""
    kind = scheme(url)
    if stores and kind in stores:
        return stores[kind](url)
    rest = url[len(kind) + 1 :]
    if kind in MOUNTS:
        return fs.LocalFileSystem(), MOUNTS[kind] + "/" + rest.lstrip("/")
    authority, _, inner = rest.lstrip("/").partition("/") if rest.startswith("//") else ("", "", rest.lstrip("/"))
    store = f"{kind}://{authority}"
    native = ARROW_NAMES.get(kind)
    try:
        if native in ("s3", "gs"):
            return _arrow_system(store, kind), f"{authority}/{inner}"
        if native == "abfs":
            return _arrow_system(store + "/", kind), f"{authority.partition('@')[0]}/{inner}"
        return _hadoop_system(store), "/" + inner
    except (pa.ArrowException, NotImplementedError, ValueError) as failure:
        raise UnknownStore(f"no file system for {store}: {failure}") from failure
    except OSError as failure:
        if "libhdfs" in str(failure) or "hdfs" in str(failure).lower():
            raise UnknownStore(f"no file system for {store}: {failure}") from failure
        raise


def open_file(path: str, stores: Stores | None = None):
    """A file by path or URL, for reading at any place."""
    if not is_url(path):
        return open(as_local(path), "rb")
    system, inner = opened(path, stores)
    return system.open_input_file(inner)


def error_of(failure: OSError) -> str:
    """The name ``schemas.ERRORS`` has for a failure of the file system."""
    kinds = {FileNotFoundError: "not_found", NotADirectoryError: "not_directory", PermissionError: "permission"}
    return next((name for kind, name in kinds.items() if isinstance(failure, kind)), "server_error")


def tasks_can_open(root: str, stores: Stores | None = None) -> bool:
    """Whether the file system of ``root`` can be made here, so in the tasks as well; the store itself is not asked."""
    if not is_url(root):
        return True
    try:
        system, _ = opened(root, stores)
    except UnknownStore:
        return False
    except OSError:
        return True
    return not isinstance(system, fs.LocalFileSystem) or os.path.isdir(MOUNTS.get(scheme(root), "/"))


def spark_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, mtime, length and content of all files below a root, by Spark's own reader.

    Works for every store the cluster's Hadoop settings name. Spark lists in tasks and
    reads a file whole, where ``content`` is used at all. It leaves out names that
    start with an underscore or a dot, and files in folders named so.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("modificationTime").cast("timestamp_ntz").alias("mtime"), "length", "content")
