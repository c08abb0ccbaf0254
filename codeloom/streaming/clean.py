"""Cleaning as a stream: the chain keeps no state, so the batch plan serves."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans.pipelines import clean
from codeloom.sources.io import parse_raw, to_documents


def clean_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int | None = None, **options) -> StreamingQuery:
    """JSON Lines files that arrive in ``source`` are cleaned into Parquet; ends when all are done."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = clean(to_documents(parse_raw(reader.text(source))), **options)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
