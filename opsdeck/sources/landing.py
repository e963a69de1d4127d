"""Land a derived DataFrame as a parquet table in the cluster's checkpoint folder.

Writing and re-reading cuts the lineage (lost executors do not force recomputation of the
upstream plan) and gives later queries a plain scan with column pruning and filter
pushdown. The folder is ``spark.checkpoint.dir`` as the cluster names it; a scratch folder
is set only for local sessions where it is unset (see ``session.ensure_checkpoint_dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from opsdeck.session import ensure_checkpoint_dir

_LANDED: dict[tuple[str, str], str] = {}
OPEN_FILES = 16


def _landing_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/opsdeck-landed/{name.replace('/', '_')}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str, row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once as parquet under the checkpoint folder and return a scan of it. The
    existing partitioning is written as is. ``drop_landed`` deletes it.

    A reader holds up to 4096 rows of a row group at once: very wide rows need small ones.
    """
    spark: SparkSession = df.sparkSession
    path = _landing_path(spark, name)
    options = {"parquet.block.size": row_group_bytes} if row_group_bytes else {}
    df.write.mode("errorifexists").options(**options).parquet(path)
    _LANDED[(spark.sparkContext.applicationId, path)] = path
    return spark.read.parquet(path)


def land_once(spark: SparkSession, key: str, build) -> DataFrame:
    """Land ``build()`` the first time per session and key; later calls re-read the table."""
    cache_key = (spark.sparkContext.applicationId, key)
    if cache_key not in _LANDED:
        path = _landing_path(spark, key)
        build().write.mode("errorifexists").parquet(path)
        _LANDED[cache_key] = path
    return spark.read.parquet(_LANDED[cache_key])


def land_by_once(spark: SparkSession, key: str, build, partition_by: tuple[str, ...]) -> DataFrame:
    """Land ``build(session)`` once as one folder per value of ``partition_by``, so filters on
    those columns prune whole folders at planning time (``PartitionFilters``) instead of reading
    and testing rows.

    A task keeps a file open per value (up to ``OPEN_FILES`` of them; it sorts only the rows that
    come after), where Spark else sorts all rows of the task by the value first and spills them.
    That is a setting, so the write runs in a session of its own with the settings of ``spark``.
    """
    cache_key = (spark.sparkContext.applicationId, key)
    if cache_key not in _LANDED:
        path = _landing_path(spark, key)
        writer = spark.newSession()
        for name, value in spark.conf.getAll.items():
            if spark.conf.isModifiable(name):
                writer.conf.set(name, value)
        writer.conf.set("spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES)
        build(writer).write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        _LANDED[cache_key] = path
    return spark.read.parquet(_LANDED[cache_key])


def land_text_once(spark: SparkSession, key: str, build, compression: str = "none") -> str:
    """Write a one-column string DataFrame once per session and key as text files; return the folder.

    A file compressed with ``gzip`` is read by one task, so the files' size is bounded by the
    partitions that ``build`` makes.
    """
    cache_key = (spark.sparkContext.applicationId, "text:" + key)
    if cache_key not in _LANDED:
        path = _landing_path(spark, key)
        build().write.mode("errorifexists").option("compression", compression).text(path)
        _LANDED[cache_key] = path
    return _LANDED[cache_key]


def drop_landed(spark: SparkSession) -> int:
    """Delete the tables that this session landed once, and forget them; how many there were."""
    app = spark.sparkContext.applicationId
    mine = [key for key in _LANDED if key[0] == app]
    for key in mine:
        path = spark._jvm.org.apache.hadoop.fs.Path(_LANDED.pop(key))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(mine)
