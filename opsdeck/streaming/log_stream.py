"""R1 over a log folder that keeps receiving files.

A Structured Streaming job does the per-line work (marker test, one regex pass, decoding,
URL rules) once per new file and appends the keyed requests to a parquet table through the
file sink, which is exactly-once: its commit log under the output folder records which
files belong to which micro-batch, and a restarted query continues from its checkpoint.
The endpoint statistics are a batch aggregate over that table (partial + final, as in the
batch report). No state store and no driver-side callback are involved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from opsdeck.constants import LOG_FILE_GLOB
from opsdeck.functions.urls import Rule
from opsdeck.operators.access_log import endpoint_aggregate, top_endpoints
from opsdeck.plans.traffic import requests_by_endpoint


MAX_FILES_PER_TRIGGER = 1000


def read_access_log_stream(spark: SparkSession, folder: str, glob: str = LOG_FILE_GLOB,
                           max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
                           max_file_age: str | None = None) -> DataFrame:
    """New plain files directly inside ``folder`` matching ``glob`` -> streaming ``value`` lines.

    A micro-batch takes at most ``max_files_per_trigger`` files; the rest wait for the next
    ones, none is left out. Spark remembers the files it has seen for ``max_file_age`` before
    the newest one (its default: 7 days) and ignores older ones; move done files out of the
    folder to keep its listing short.
    """
    reader = spark.readStream.format("text").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_file_age:
        reader = reader.option("maxFileAge", max_file_age)
    return reader.load(folder)


def requests_stream(spark: SparkSession, folder: str, marker: str | None, rules: Sequence[Rule],
                    glob: str = LOG_FILE_GLOB,
                    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """Streaming keyed requests: ``method, url`` (decoded, normalised), time, bytes, status."""
    lines = read_access_log_stream(spark, folder, glob, max_files_per_trigger)
    return requests_by_endpoint(lines, marker, rules)


def start_ingest(requests: DataFrame, output: str, checkpoint: str | None = None,
                 available_now: bool = False, name: str = "access_log_ingest") -> StreamingQuery:
    """Append the keyed requests of each micro-batch to the parquet table at ``output``.

    ``checkpoint`` defaults to the folder ``<output>_checkpoint`` beside the table, so a table
    and its progress belong together whichever application runs the ingestion (a folder that
    changes with the application would start again at batch 0, which the table's commit log
    takes as done, and new files would be lost). ``available_now`` processes every file present
    and stops (scheduled runs).
    """
    location = checkpoint or f"{output.rstrip('/')}_checkpoint"
    writer = (requests.writeStream.format("parquet").outputMode("append").queryName(name)
              .option("path", output).option("checkpointLocation", location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def endpoint_stats_ingested(spark: SparkSession, output: str, limit: int | None = None) -> DataFrame:
    """Per-endpoint statistics over everything ingested so far (only committed batches are read)."""
    return top_endpoints(endpoint_aggregate(spark.read.parquet(output)), limit)
