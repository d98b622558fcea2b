"""Row-wise filters and derived columns of the inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixledger.functions import paths, text
from pixledger.schemas import MAX_FILE_BYTES, MAX_PIXELS
from pixledger.session import stored


def with_path(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("path", F.concat_ws("/", F.rtrim(F.col("folder"), F.lit("/")), "name"))


def only_images(inventory: DataFrame) -> DataFrame:
    return inventory.where(paths.is_image(F.col("name")))


def drop_hidden(entries: DataFrame) -> DataFrame:
    return entries.where(~paths.is_hidden(F.col("name")))


def visible_images(inventory: DataFrame) -> DataFrame:
    """What a folder view lists: images whose names do not start with a dot."""
    return only_images(drop_hidden(inventory))


def only_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Keep ``folder`` or ``image`` rows of a listing."""
    return nodes.where(F.col("type") == kind)


def search(nodes: DataFrame, query: str) -> DataFrame:
    return nodes.where(text.lower_contains(F.col("name"), query))


def check_root(entries: DataFrame, root: str, path: str = "path", links: DataFrame | None = None, keep_resolved: bool = False) -> DataFrame:
    """Mark paths outside ``root`` with the ``permission`` error.

    With ``links`` (path, target) a path counts as what it resolves to, so one that leaves
    the root through a link is marked, and one that comes back into it is not. A circle of
    links is outside of everything. ``keep_resolved`` leaves what paths resolve to as ``resolved``.
    """
    real = F.col(path)
    if links is not None:
        entries = links_followed(entries, links, path)
        real = F.col("resolved")
    outside = ~F.coalesce(paths.under_root(real, root), F.lit(False))
    marked = entries.withColumn("error_type", F.when(outside, F.lit("permission")))
    return marked if keep_resolved else marked.drop("resolved")


#: 2 ** 6 links lead from one to the next at most; operating systems follow 40.
_LINK_ROUNDS = 6


def _link_replaced(state: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """``state`` (key, resolved, open) with the uppermost link of each open path replaced; those without one are closed."""
    above = state.where("open").select(key, "resolved", F.explode(paths.ancestors(F.col("resolved"))).alias("link"))
    first = above.join(links, "link").groupBy(key).agg(F.min_by(F.struct("link", "to"), F.length("link")).alias("hit"))
    tail = F.substr("resolved", F.length("hit.link") + 1)
    moved = paths.normalise(F.concat(F.rtrim(F.col("hit.to"), F.lit("/")), tail))
    met = F.col("hit").isNotNull()
    found = state.join(first, key, "left").select(key, F.when(met, moved).otherwise(F.col("resolved")).alias("resolved"), (met & F.col("open")).alias("open"))
    return stored(found, "links")


def links_settled(links: DataFrame) -> DataFrame:
    """link and ``to``, its target with all links in it replaced; NULL for a circle. ``links`` has path and target.

    Each round replaces by what the round before has found, so that chains shorten by half.
    """
    state = links.select(F.col("path").alias("start"), paths.normalise(F.col("target")).alias("resolved"), F.lit(True).alias("open")).dropDuplicates(["start"])
    for _ in range(_LINK_ROUNDS):
        state = _link_replaced(state, state.select(F.col("start").alias("link"), F.col("resolved").alias("to")), "start")
        if state.where("open").isEmpty():
            break
    return state.select(F.col("start").alias("link"), F.when(~F.col("open"), F.col("resolved")).alias("to"))


def links_followed(entries: DataFrame, links: DataFrame, path: str = "path") -> DataFrame:
    """Add ``resolved``: the path with every link in it replaced by its target; NULL for a circle.

    ``links`` (path, target) holds links to files or folders, with absolute targets that may pass through
    links themselves and are settled first. Each round joins the ancestors of the paths still open with the
    links and replaces the uppermost; ``..`` is resolved by text. Rounds end when no path changes.
    """
    key = "resolved_from"
    settled = stored(links_settled(links), "settled")
    asked = entries.select(F.col(path).alias(key)).where(F.col(key).isNotNull()).distinct()
    state = asked.withColumns({"resolved": paths.normalise(F.col(key)), "open": F.lit(True)})
    done = []
    while True:
        state = _link_replaced(state, settled, key)
        # Only paths that a link was met in go on to the next round.
        done.append(state.where("NOT open OR resolved IS NULL").select(key, "resolved"))
        state = state.where("open AND resolved IS NOT NULL")
        if state.isEmpty():
            break
    found = reduce(DataFrame.union, done)
    return entries.join(found, F.col(path) == F.col(key), "left").drop(key)


def check_limits(files: DataFrame) -> DataFrame:
    """Mark files beyond the byte or pixel limit, and those a reader has marked as
    no images; unknown sizes pass."""
    pixels = F.col("width").cast("bigint") * F.col("height").cast("bigint")
    message = F.when(
        F.col("length") > MAX_FILE_BYTES,
        F.lit(f"Image is too large (> {MAX_FILE_BYTES // (1024 * 1024)} MB)"),
    ).when(pixels > MAX_PIXELS, F.lit(f"Image dimensions exceed limit (> {MAX_PIXELS:,} pixels)"))
    kind = F.when(message.isNotNull(), F.lit("invalid_file"))
    if "read_error" in files.columns:
        kind = F.coalesce(kind, F.col("read_error"))
        wrong = F.when(F.col("read_error") == "invalid_file", "Not a valid image file").otherwise("The file could not be read")
        message = F.coalesce(message, F.when(F.col("read_error").isNotNull(), wrong))
    return files.withColumns(
        {
            "error_type": kind,
            "error_message": message,
        }
    )


def split_quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows of a frame with an ``error_type`` column."""
    return (
        checked.where(F.col("error_type").isNull()),
        checked.where(F.col("error_type").isNotNull()),
    )


def with_animated(images: DataFrame) -> DataFrame:
    return images.withColumn("is_animated", paths.is_animated(F.col("name")))


def with_size_text(images: DataFrame) -> DataFrame:
    both = (F.coalesce("width", F.lit(0)) != 0) & (F.coalesce("height", F.lit(0)) != 0)
    return images.withColumn(
        "size_text",
        F.when(both, F.concat_ws(" x ", F.col("width").cast("string"), F.col("height").cast("string"))).otherwise(""),
    )


def with_version(files: DataFrame) -> DataFrame:
    """Add ``etag`` as ``"seconds-bytes"``, quotes included, with Python's float
    text for the seconds; (path, mtime, length) is the key of one file state."""
    # A division by a million gives the double nearest to the time.
    seconds = text.python_float_sql("unix_micros(CAST(mtime AS TIMESTAMP)) / 1000000D")
    return files.withColumn("etag", F.expr(f"concat('\"', {seconds}, '-', CAST(length AS STRING), '\"')"))


def with_path_parts(files: DataFrame) -> DataFrame:
    """Suffix, stem and last folder name of each file."""
    return files.withColumns(
        {
            "suffix": paths.suffix(F.col("name")),
            "stem": paths.stem(F.col("name")),
            "album": paths.last_segment(F.col("folder")),
        }
    )


def breadcrumbs(paths_df: DataFrame, path: str = "path") -> DataFrame:
    """One row per segment of each path, from the top down."""
    keep = [F.col(c) for c in paths_df.columns]
    return paths_df.select(*keep, F.explode(paths.breadcrumb(F.col(path))).alias("_c")).select(
        *keep, "_c.name", "_c.full_path", "_c.index", "_c.is_last"
    )


def collapsed_breadcrumbs(paths_df: DataFrame, path: str = "path", most: int = 4) -> DataFrame:
    """Visible and hidden segment names when more than ``most`` do not fit."""
    crumbs = F.col("_crumbs")
    return (
        paths_df.withColumn("_crumbs", paths.breadcrumb(F.col(path)))
        .withColumns(
            {
                "visible": F.transform(paths.breadcrumb_visible(crumbs, most), lambda c: c["name"]),
                "hidden": F.transform(paths.breadcrumb_hidden(crumbs, most), lambda c: c["name"]),
            }
        )
        .drop("_crumbs")
    )
