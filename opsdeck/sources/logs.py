"""Access-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from opsdeck.constants import LOG_FILE_GLOB


def read_access_log(spark: SparkSession, folder: str, glob: str = LOG_FILE_GLOB) -> DataFrame:
    """Plain files directly inside ``folder`` whose names match ``glob`` -> ``value string`` lines.

    Sub-folders are not descended into and hidden files are skipped. Text is read as UTF-8;
    undecodable bytes become U+FFFD instead of failing the job. Uncompressed files are split
    across tasks by ``spark.sql.files.maxPartitionBytes``.
    """
    return (spark.read.option("pathGlobFilter", glob)
            .option("recursiveFileLookup", "false")
            .text(folder))
