"""Listings, sidecars, embedded tags, the catalog on disk, and the refresh stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import reference_sql as ref
from checks.common import Queries, metadata, params_text
from pixledger.operators import resolve
from pixledger.operators.inventory import with_path
from pixledger.session import shared_dir
from pixledger.sources import files, sinks, snapshots, tags
from pixledger.streaming.refresh import BATCH, refresh_stream


def _bytes(number: str, width: int) -> str:
    return f"unhex(lpad(hex({number}), {2 * width}, '0'))"


def _chunk(kind: str, data: str) -> str:
    """SQL for one PNG chunk."""
    body = f"concat(encode('{kind}', 'utf-8'), {data})"
    return f"concat({_bytes(f'octet_length({data})', 4)}, {body}, {_bytes(f'crc32({body})', 4)})"


def _text_chunk(keyword: str, column: str) -> str:
    """SQL for a plain or an international text chunk, or nothing."""
    plain = _chunk("tEXt", f"concat(encode('{keyword}', 'utf-8'), X'00', encode({column}, 'utf-8'))")
    international = _chunk("iTXt", f"concat(encode('{keyword}', 'utf-8'), X'0000000000', encode({column}, 'utf-8'))")
    return f"coalesce(IF(file_id % 2 = 0, {plain}, {international}), X'')"


_PNG = f"""concat(X'89504E470D0A1A0A',
    {_chunk("IHDR", f"concat({_bytes('width', 4)}, {_bytes('height', 4)}, X'0802000000')")},
    {_text_chunk("parameters", "parameters")}, {_text_chunk("prompt", "prompt_json")},
    {_text_chunk("workflow", "workflow_json")}, {_chunk("IDAT", "X'00'")}, {_chunk("IEND", "X''")})"""
_COMMENT = "concat(X'4153434949000000', encode(user_comment, 'utf-8'))"
_JPEG = f"""concat(X'FFD8FFE1', {_bytes(f"34 + octet_length({_COMMENT})", 2)}, X'457869660000',
    X'4D4D002A00000008', X'0001', X'92860007', {_bytes(f"octet_length({_COMMENT})", 4)}, X'0000001A', X'00000000',
    {_COMMENT}, X'FFC0001108', {_bytes("height", 2)}, {_bytes("width", 2)}, X'03011100021100031100', X'FFD9')"""


def image_bytes(spark, sf):
    """Image files with the tags inside: JPEG where there is a user comment, else PNG."""
    return fx.tagged_files(spark, sf).withColumn("content", F.expr(f"IF(user_comment IS NOT NULL, {_JPEG}, {_PNG})"))


def listing(spark, sf):
    return fx.inventory(spark, sf).select(
        files.local_path(F.concat(F.lit("file:"), "folder", F.lit("/"), "name")).alias("path"), "mtime", "length"
    )


def list_inventory(spark, sf):
    return files.list_inventory(listing(spark, sf), "/").select("folder", "name", "mtime", "length")


def sidecars(spark, sf):
    """Text files with carriage returns and a stray byte."""
    named = fx.tagged_files(spark, sf).where("sidecar_text IS NOT NULL")
    texts = named.select(
        F.expr(r"concat(folder, '/', regexp_replace(name, r'(.)\.[^.]+$', '$1'), '.txt')").alias("path"),
        F.expr(r"concat(encode(replace(sidecar_text, '\n', '\r\n'), 'utf-8'), X'FF')").alias("content"),
    )
    return files.sidecars(texts)


def extract_tags(spark, sf):
    content = image_bytes(spark, sf).select("file_id", "content")
    return tags.extract_tags(content, "content")


def list_html(spark, sf):
    spark.read.parquet(f"{sf}/pages.parquet").createOrReplaceTempView("pages")
    paths = spark.sql(
        """SELECT concat('/srv/public/', page_id, regexp_replace(url, r'^https?://[^/?#]*|[?#].*$', ''),
             CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.HTML' ELSE '.htm' END) AS path FROM pages"""
    )
    return files.list_by_suffix(paths, "/srv/public/")


def write_catalog(spark, sf):
    """The metadata written by tool and read back."""
    out = shared_dir(spark, "catalog")
    sinks.write_catalog(metadata(spark, sf), out)
    return sinks.read_catalog(spark, out).select(
        "file_id", "tool", "prompt", params_text().alias("params"), "width", "height"
    )


def catalog_versions(spark, sf):
    """Two appends and a replacement; each version is read after all of them."""
    out = shared_dir(spark, "versions")
    sinks.write_catalog(metadata(spark, sf).select("file_id", "tool", "prompt"), f"{out}/all")
    rows = sinks.read_catalog(spark, f"{out}/all")
    catalog = f"{out}/catalog"
    snapshots.commit(rows.where("file_id % 2 = 0"), catalog)
    snapshots.commit(rows.where("file_id % 2 = 1"), catalog)
    newest = snapshots.read_version(spark, catalog)
    snapshots.commit(newest.where("tool = 'A1111'"), catalog, replace=True, onto=2)
    found = None
    for version in snapshots.versions(spark, catalog):
        per_tool = snapshots.read_version(spark, catalog, version).groupBy("tool").agg(F.count("*").alias("files"), F.count("prompt").alias("prompts"))
        per_tool = per_tool.withColumn("version", F.lit(version))
        found = per_tool if found is None else found.union(per_tool)
    return found


def as_json(spark, sf):
    rows = metadata(spark, sf).select("file_id", "tool", "negative_prompt", "date", "width")
    return sinks.as_json(rows)


def file_metadata(spark, sf):
    """From file bytes and sidecars to metadata, as on a real tree."""
    content = with_path(image_bytes(spark, sf)).select("file_id", "path", "folder", "name", "length", "content")
    tagged = tags.extract_tags(content, "content")
    named = fx.tagged_files(spark, sf).where("sidecar_text IS NOT NULL")
    texts = named.select(
        "folder",
        F.expr(r"regexp_replace(name, r'(.)\.[^.]+$', '$1')").alias("stem"),
        F.col("sidecar_text").alias("text"),
    )
    meta = resolve.resolve_metadata(resolve.attach_sidecars(tagged, texts))
    return meta.select("file_id", "tool", "prompt", params_text().alias("params"))


def stream_refresh(spark, sf):
    """The files as a stream in two drops, the second repeating a part of the first
    unchanged; each file state ends up in the catalog once."""
    out = shared_dir(spark, "stream")
    source, catalog = f"{out}/source", f"{out}/catalog"
    tagged = with_path(fx.tagged_files(spark, sf))
    schema = tagged.schema

    def parse(batch):
        return resolve.resolve_metadata(batch).withColumn("path", F.concat_ws("/", "folder", "name"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        refresh_stream(stream, parse, catalog, f"{out}/checkpoint", buckets=16).awaitTermination()

    tagged.where("file_id % 4 <> 0").write.parquet(source)
    run()
    tagged.where("file_id % 2 = 0").write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(catalog)
    return rows.select("file_id", "tool", F.col(BATCH).cast("int").alias("batch"))


def stream_refresh_two_sources(spark, sf):
    """Two streams into one catalog, and one whose checkpoint is lost: no row is lost or doubled."""
    out = shared_dir(spark, "streams")
    catalog = f"{out}/catalog"
    tagged = with_path(fx.tagged_files(spark, sf))
    schema = tagged.schema

    def parse(batch):
        return batch.select("file_id", "path", "mtime", "length")

    def run(source, checkpoint):
        stream = spark.readStream.schema(schema).parquet(f"{out}/{source}")
        refresh_stream(stream, parse, catalog, f"{out}/{checkpoint}", buckets=16).awaitTermination()

    tagged.where("file_id % 3 <> 0").write.parquet(f"{out}/one")
    tagged.where("file_id % 3 <> 1").write.parquet(f"{out}/two")
    run("one", "first")
    run("two", "second")
    run("one", "again")
    return spark.read.parquet(catalog).groupBy("file_id").agg(F.count("*").alias("times"))


QUERIES: Queries = {
    "S1_list_inventory": (
        list_inventory,
        fx.oracle(f"SELECT folder, name, mtime, length FROM inventory WHERE {ref.VISIBLE}", inventory=True),
    ),
    "S2_sidecars": (
        sidecars,
        fx.oracle(
            """SELECT folder, regexp_replace(name, '(.)\\.[^.]+$', '\\1') AS stem, sidecar_text AS text
            FROM inventory JOIN raw_tags USING (file_id) WHERE sidecar_text IS NOT NULL""",
            inventory=True,
            tags=True,
        ),
    ),
    "S3_extract_tags": (
        extract_tags,
        fx.oracle(
            """SELECT file_id, width, height, parameters, prompt_json, workflow_json, user_comment,
              CAST(NULL AS VARCHAR) AS read_error, CAST(NULL AS VARCHAR) AS oversized
            FROM inventory JOIN raw_tags USING (file_id)""",
            inventory=True,
            tags=True,
        ),
    ),
    "S4_list_html": (
        list_html,
        """SELECT concat('/', page_id, regexp_replace(regexp_replace(url, '^https?://[^/?#]*', ''), '[?#].*$', ''),
             CASE page_id % 3 WHEN 0 THEN '.html' ELSE '.HTML' END) AS url_path FROM pages WHERE page_id % 3 < 2""",
    ),
    "S5_write_catalog": (
        write_catalog,
        fx.oracle(
            f"SELECT file_id, tool, prompt, {ref.PARAMS_TEXT} AS params, width, height FROM every",
            inventory=True,
            tags=True,
            ctes=ref.ALL_META,
        ),
    ),
    "S5_catalog_versions": (
        catalog_versions,
        fx.oracle(
            """SELECT tool, count(*) AS files, count(prompt) AS prompts, version FROM every, (VALUES (1), (2), (3)) v(version)
            WHERE version = 2 OR (version = 1 AND file_id % 2 = 0) OR (version = 3 AND tool = 'A1111') GROUP BY tool, version""",
            inventory=True,
            tags=True,
            ctes=ref.ALL_META,
        ),
    ),
    "S5_json_rows": (
        as_json,
        fx.oracle(
            """SELECT CAST(json_object('file_id', file_id, 'tool', tool, 'negative_prompt', negative_prompt,
              'date', date, 'width', width) AS VARCHAR) AS json FROM every""",
            inventory=True,
            tags=True,
            ctes=ref.ALL_META,
        ),
    ),
    "E2_file_metadata": (
        file_metadata,
        fx.oracle(
            f"SELECT file_id, tool, prompt, {ref.PARAMS_TEXT} AS params FROM every",
            inventory=True,
            tags=True,
            ctes=ref.ALL_META,
        ),
    ),
    "ST1_stream_refresh": (
        stream_refresh,
        fx.oracle(
            "SELECT file_id, tool, CASE WHEN file_id % 4 <> 0 THEN 0 ELSE 1 END AS batch FROM every",
            inventory=True,
            tags=True,
            ctes=ref.ALL_META,
        ),
    ),
    "ST1_two_streams": (
        stream_refresh_two_sources,
        fx.oracle("SELECT file_id, 1 AS times FROM inventory", inventory=True),
    ),
}
