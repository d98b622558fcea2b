"""Keep the catalog current as files arrive or change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixledger.operators.refresh import one_per_version, unparsed
from pixledger.streaming.versions import BATCH, BUCKETS, QUERY, add_versions, complete_versions, known_versions


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark gave the query of a checkpoint; a new checkpoint has a new one."""
    (row,) = spark.read.schema("id string").json(f"{checkpoint}/metadata").collect()
    return f"q-{row['id']}"


def refresh_stream(
    files: DataFrame,
    parse: Callable[[DataFrame], DataFrame],
    catalog: str,
    checkpoint: str,
    trigger: dict | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Parse each (path, mtime, length) once and append it to the catalog.

    State lives in the catalog itself, its version keys in ``buckets`` by the path's hash, of which a
    batch reads those of its own paths. So a back-dated file is found as surely as
    a new one and no watermark has to guess how late files come. A batch owns one
    partition folder, named after the query's id and the batch's, and overwrites
    it, so a batch that is run again after a failure leaves no doubles, and other
    streams or a lost checkpoint touch nothing of it. ``parse`` must keep the key
    columns. Streams that read the same files at the same time may both parse one. Keys are written
    after the data; what a stop between the two leaves without keys gets them when a stream starts.
    """
    complete_versions(files.sparkSession, catalog, buckets)

    def append(batch: DataFrame, batch_id: int) -> None:
        fresh = one_per_version(batch)
        own = query_id(batch.sparkSession, checkpoint)
        done = known_versions(fresh, catalog, own, batch_id, buckets)
        if done is not None:
            fresh = unparsed(fresh, done)
        target = f"{catalog}/{QUERY}={own}/{BATCH}={batch_id}"
        parse(fresh).write.mode("overwrite").parquet(target)
        add_versions(batch.sparkSession.read.parquet(target), catalog, own, batch_id, buckets)

    return (
        files.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
