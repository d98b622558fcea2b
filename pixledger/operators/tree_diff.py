"""What changed between two listings of a tree, found from digests per folder.

A folder's digest covers the (path, mtime, length) of the files in and below it. It is a count and two
exclusive-or sums of row hashes: sums combine on the map side, so a folder of very many files sends one row
a task, and a file can be added to or taken out of a kept digest by adding its row's hash once more. Two trees
are compared from the root downwards: only folders whose digests differ are opened, and only files of
folders that differ themselves are compared one by one. Unchanged subtrees cost one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.functions import paths
from pixledger.session import stored

DIGEST = ["files", "low", "high"]
OWN = ["own_files", "own_low", "own_high"]
#: What a file's version is made of, besides its path.
VERSION = ["mtime", "length"]


def folder_digests(inventory: DataFrame) -> DataFrame:
    """path, parent, depth, and the digests of each folder's own files (``OWN``) and of all below it (``DIGEST``).

    ``inventory`` has folder, name, mtime and length. Folders are aggregated first; only per-folder rows are spread
    over their ancestors.
    """
    row = ["folder", "name", *VERSION]
    own = inventory.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*row)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *row)).alias("b")
    )
    spread = own.select("*", F.posexplode(paths.ancestors(F.col("folder"))).alias("depth", "path"))
    here = F.col("path") == F.col("folder")
    none = F.lit(0).cast("bigint")
    found = spread.groupBy("path", "depth").agg(
        *(F.sum("n").alias(DIGEST[0]), F.bit_xor("a").alias(DIGEST[1]), F.bit_xor("b").alias(DIGEST[2])),
        *(agg(F.when(here, F.col(c)).otherwise(none)).alias(name) for agg, c, name in zip((F.sum, F.bit_xor, F.bit_xor), ("n", "a", "b"), OWN)),
    )
    return found.withColumn("parent", F.nullif(paths.parent(F.col("path")), F.col("path")))


def write_digests(inventory: DataFrame, path: str) -> None:
    """The digests by depth, so that a comparison reads no level below the last that differs."""
    folder_digests(inventory).write.mode("overwrite").partitionBy("depth").parquet(path)


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """path of the folders whose own files differ between two digest tables, added and removed folders included.

    One round a level: the level's folders below those that differed one level up are joined on their path.
    """
    spark = before.sparkSession
    frontier, level, out = None, 0, None
    while True:
        sides = []
        for digests in (before, after):
            here = digests.where(F.col("depth") == level).select("path", "parent", F.struct(*DIGEST).alias("all"), F.struct(*OWN).alias("own"))
            if frontier is not None:
                here = here.join(frontier.withColumnRenamed("path", "parent"), "parent", "left_semi")
            sides.append(here.drop("parent"))
        nothing = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in OWN))
        met = sides[0].alias("x").join(sides[1].alias("y"), "path", "full")
        differ = stored(
            met.where(~F.col("x.all").eqNullSafe(F.col("y.all"))).select("path", (F.coalesce("x.own", nothing) != F.coalesce("y.own", nothing)).alias("itself")), "differ"
        )
        out = differ if out is None else out.union(differ)
        if differ.isEmpty():
            return spark.createDataFrame([], "path string") if level == 0 else out.where("itself").select("path")
        frontier, level = differ.select("path"), level + 1


def file_changes(before: DataFrame, after: DataFrame, digests: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """change (insert, update, delete, move), path, old_path (of moves) and the mtime and length that hold now, or held at last.

    A move is a file gone and a file new that share mtime and length, where no other gone or new file has
    the same. ``digests`` are those of both listings if they are kept; they are worked out otherwise.
    """
    if digests is None:
        digests = tuple(stored(folder_digests(side), "digests") for side in (before, after))
    folders = stored(changed_folders(*digests), "folders").withColumnRenamed("path", "folder")
    sides = [
        side.join(folders, "folder", "left_semi").select(paths.join(F.col("folder"), F.col("name")).alias("path"), F.struct(*VERSION).alias(v))
        for side, v in ((before, "was"), (after, "now"))
    ]
    met = stored(sides[0].join(sides[1], "path", "full").where("NOT (was <=> now)"), "changes")
    gone, new = met.where("now IS NULL"), met.where("was IS NULL")
    only = lambda side, v, name: side.groupBy(F.col(v).alias("version")).agg(F.min("path").alias(name), F.count("*").alias("n")).where("n = 1").drop("n")
    moves = stored(only(gone, "was", "old_path").join(only(new, "now", "path"), "version"), "moves")
    rest = gone.join(moves.select(F.col("old_path").alias("path")), "path", "left_anti").union(new.join(moves, "path", "left_anti")).union(met.where("was IS NOT NULL AND now IS NOT NULL"))
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").otherwise("update")
    columns = lambda version: [version[c].alias(c) for c in VERSION]
    named = rest.select(kind.alias("change"), "path", F.lit(None).cast("string").alias("old_path"), *columns(F.coalesce("now", "was")))
    return named.union(moves.select(F.lit("move"), "path", "old_path", *columns(F.col("version"))))


def applied(catalog: DataFrame, changes: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """The catalog's rows (with path) after ``changes``: deleted and updated files go, moved ones get their new path.

    ``parsed`` holds the rows of inserted and updated files, in the catalog's columns.
    """
    touched = changes.where("change <> 'insert'").select(F.coalesce("old_path", "path").alias("path"), F.when(F.col("change") == "move", F.col("path")).alias("to"))
    kept = catalog.join(touched, "path", "left_anti")
    moved = catalog.join(touched.where("to IS NOT NULL"), "path").withColumn("path", F.col("to"))
    for column, derive in (("folder", paths.parent), ("name", paths.file_name)):
        if column in catalog.columns:
            moved = moved.withColumn(column, derive(F.col("path")))
    out = kept.unionByName(moved.select(*catalog.columns))
    return out if parsed is None else out.unionByName(parsed.select(*catalog.columns))
