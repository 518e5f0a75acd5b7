"""Landing new payload files as they turn up, each exactly once.

The batch operators do the work; the stream only keeps track of which files are new. A run takes
what has arrived, lands it and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.landing import CORRUPT, add_lineage


def land_new_files(
    spark: SparkSession,
    folder: str,
    table: str,
    progress: str,
    land: Callable[[DataFrame], DataFrame],
    columns: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    files_per_batch: int = 1000,
    ingested_at: datetime | None = None,
    whole_files: bool = False,
) -> StreamingQuery:
    """Append every payload file below ``folder`` not seen before to ``table``; ends when caught up.

    ``land`` turns a frame with the JSON text in ``payload`` into rows, keeping its other columns; it
    works row by row, so nothing is shuffled. Lineage names the file and the time of the run, fixed once,
    so that all micro-batches of a run are one batch, which can be selected again. ``progress`` remembers what was read and must be shared and durable.
    Together with the file sink's own log it makes a repeated batch land once; read the table through
    Spark, which honours that log.

    A file holds a payload per line, or with ``whole_files`` one payload over all its lines. What ``land`` could
    not read stays in ``_corrupt``, which is stored too whatever ``columns`` names, so a bad file neither
    vanishes nor stops the stream.
    """
    texts = (
        spark.readStream.format("text")
        .option("maxFilesPerTrigger", files_per_batch)
        .option("wholetext", whole_files)
        .load(folder)
        .select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("_source_file"))
    )
    landed = add_lineage(land(texts), F.col("_source_file"), F.lit(ingested_at or datetime.now(timezone.utc)))
    if columns:
        kept = [CORRUPT] if CORRUPT in landed.columns and CORRUPT not in columns else []
        landed = landed.select(*columns, *kept)
    return (
        landed.writeStream.format("parquet")
        .partitionBy(*partition_by)
        .option("path", table)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
