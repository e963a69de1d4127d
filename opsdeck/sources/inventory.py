"""Landed inventory snapshots (cloud API responses saved as JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsdeck.sources.landing import land

TAG = T.StructType([T.StructField("Key", T.StringType()), T.StructField("Value", T.StringType())])
INSTANCE = T.StructType([
    T.StructField("InstanceId", T.StringType()),
    T.StructField("LaunchTime", T.StringType()),
    T.StructField("PrivateIpAddress", T.StringType()),
    T.StructField("State", T.StructType([T.StructField("Name", T.StringType())])),
    T.StructField("Tags", T.ArrayType(TAG)),
])
RESERVATION = T.StructType([T.StructField("Instances", T.ArrayType(INSTANCE))])
INVENTORY_SCHEMA = T.StructType([T.StructField("Reservations", T.ArrayType(RESERVATION))])

BROKER = T.StructType([T.StructField("BrokerId", T.StringType()), T.StructField("BrokerName", T.StringType())])
BROKERS_SCHEMA = T.StructType([T.StructField("BrokerSummaries", T.ArrayType(BROKER))])


PAGE = "page"
DOCUMENT_GROUP_BYTES = 4 << 20  # encoded; a document of 500 instances takes some 25 KB


def _pages(spark: SparkSession, path: str, schema: T.StructType, json_lines: bool, check: bool) -> DataFrame:
    """One row per document with its page number: the field ``page`` of the document, else the
    last number in the name of its file.

    Pages order the documents, so several of which one has no number, or two have the same,
    leave "last listed wins" undefined. With ``check`` (the default of the readers) that is an
    error. JSON is parsed once: the documents are landed as parquet, of which the check reads the
    page column alone and the returned DataFrame what its reader needs. A single document needs no
    number; it is page 0.
    """
    fields = T.StructType([T.StructField(PAGE, T.LongType()), *schema.fields])
    docs = spark.read.schema(fields).option("multiLine", not json_lines).json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\D*$", 1)
    docs = docs.withColumn(PAGE, F.coalesce(F.col(PAGE), F.when(name != "", name.cast("bigint"))))
    if check:
        docs = land(docs, "json-documents", row_group_bytes=DOCUMENT_GROUP_BYTES)
        bad = docs.groupBy(PAGE).count().filter(F.col(PAGE).isNull() | (F.col("count") > 1)).limit(5).collect()
        single = len(bad) == 1 and bad[0]["count"] == 1 and docs.filter(F.col(PAGE).isNotNull()).isEmpty()
        if bad and not single:
            what = ", ".join(f"{r['count']} documents with page {r[PAGE]}" for r in bad)
            raise ValueError(f"every document needs a page number of its own: {what}")
    return docs.withColumn(PAGE, F.coalesce(F.col(PAGE), F.lit(0).cast("bigint")))


def read_inventory(spark: SparkSession, path: str, json_lines: bool = False, with_page: bool = True,
                   check: bool = True) -> DataFrame:
    """Instance-listing responses -> ``page, Reservations`` rows (one per response), explicit schema.

    ``page`` is a number (see ``_pages``), so ``page-10`` follows ``page-9``. A whole-response
    JSON file cannot be split: each is one task and one row. Land large inventories as JSON
    lines, one response with its ``page`` per line, and read them with ``json_lines``.
    ``with_page=False`` is for a single response.
    """
    docs = _pages(spark, path, INVENTORY_SCHEMA, json_lines, check and with_page)
    return docs if with_page else docs.drop(PAGE)


def read_brokers(spark: SparkSession, path: str, json_lines: bool = False, with_page: bool = True,
                 check: bool = True) -> DataFrame:
    """Broker-listing responses -> ``[page,] pos, broker_id, broker_name`` in listing order;
    pages as in ``read_inventory``."""
    raw = _pages(spark, path, BROKERS_SCHEMA, json_lines, check and with_page)
    lead = [PAGE] if with_page else []
    exploded = raw.select(*lead, F.posexplode("BrokerSummaries").alias("pos", "b"))
    return exploded.select(*lead, F.col("pos").cast("bigint").alias("pos"),
                           F.col("b.BrokerId").alias("broker_id"), F.col("b.BrokerName").alias("broker_name"))


def extension_requests(spark: SparkSession, requests: list[tuple[str, float]]) -> DataFrame:
    """Command-style (build, hours) requests as a DataFrame."""
    return spark.createDataFrame([(b, float(h)) for b, h in requests], "build string, hours double")
