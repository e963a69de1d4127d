"""The checkpoint folder comes from the session; landing writes under it."""

from __future__ import annotations

from opsdeck.session import ensure_checkpoint_dir
from opsdeck.sources.landing import drop_landed, land, land_once


def test_checkpoint_dir_is_taken_from_the_session(spark):
    configured = ensure_checkpoint_dir(spark)              # set on first use, not by build_session
    assert spark.sparkContext.getCheckpointDir() == configured
    assert ensure_checkpoint_dir(spark) == configured      # never replaced once set


def test_landing_writes_under_the_checkpoint_dir(spark):
    df = spark.range(5).withColumnRenamed("id", "x")
    landed = land(df, "session_test")
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    assert all(root in f.replace("file:", "") for f in landed.inputFiles())
    assert sorted(r.x for r in landed.collect()) == [0, 1, 2, 3, 4]


def test_landed_tables_can_be_dropped(spark):
    import os
    landed = land_once(spark, "drop_test", lambda: spark.range(3))
    path = landed.inputFiles()[0].replace("file:", "")
    assert os.path.exists(path) and drop_landed(spark) >= 1 and not os.path.exists(path)
    assert land_once(spark, "drop_test", lambda: spark.range(4)).count() == 4     # landed anew


def test_workers_import_the_package(spark):
    from opsdeck.session import share_code
    share_code(spark)
    share_code(spark)
    home = os_home()
    assert spark.sparkContext.environment["PYTHONPATH"].split(":").count(home) == 1


def os_home():
    import os

    import opsdeck
    return os.path.dirname(os.path.dirname(os.path.abspath(opsdeck.__file__)))


def test_landing_by_value_keeps_rows_and_settings(spark):
    from pyspark.sql import functions as F

    from opsdeck.sources.landing import land_by_once
    setting = "spark.sql.maxConcurrentOutputFileWriters"
    before, zone = spark.conf.get(setting, None), spark.conf.get("spark.sql.session.timeZone")
    seen = {}

    def build(session):
        seen.update({s: session.conf.get(s) for s in (setting, "spark.sql.session.timeZone")})
        # more values than files are kept open, null among them
        return session.range(0, 400, 1, 2).withColumn("v", F.when(F.col("id") % 40 > 0, F.col("id") % 40))

    landed = land_by_once(spark, "by_value_test", build, ("v",))
    assert sorted((r.id, r.v) for r in landed.filter("v is not null").collect()) == [(i, i % 40) for i in range(400) if i % 40]
    assert landed.filter("v is null").count() == 10
    assert int(seen[setting]) > 1 and seen["spark.sql.session.timeZone"] == zone
    assert spark.conf.get(setting, None) == before


def test_landed_documents_lie_in_small_row_groups(spark):
    import duckdb
    from pyspark.sql import functions as F

    from opsdeck.sources.landing import land
    wide = spark.range(0, 600, 1, 1).select(F.array(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 256) for i in range(20)]).alias("words"))
    groups = []
    for size in (None, 1 << 18):
        files = land(wide, "groups_test", row_group_bytes=size).inputFiles()
        files = [f.replace("file://", "") for f in files]
        groups.append(duckdb.sql(f"select max(row_group_num_rows) from parquet_metadata({files})").fetchall()[0][0])
    assert groups[0] == 600 and groups[1] < 400
