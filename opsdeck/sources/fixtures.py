"""Inputs derived from the driver's test tables (orders, customer, supplier, events).

The SQL texts below run unchanged in Spark SQL (tables passed as DataFrames through
``spark.sql(text, name=df)``) and in DuckDB (placeholders replaced by view names), so both
engines see identical inputs. Only the time-tag rendering differs per engine and lives in
code. The derived tables grow linearly with the source tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsdeck.functions.timefns import iso_z, iso_z_millis
from opsdeck.operators.nested import flatten_instances, nest_instances, page_of
from opsdeck.sources.inventory import read_brokers, read_inventory
from opsdeck.sources.landing import land_by_once, land_text_once

# Proxy log lines rebuilt from events: ~1/11 lack the process marker, ~1/13 use OPTIONS.
ACCESS_LOG_SQL = """
select concat('Jan  1 00:00:00 lb ',
  case when event_id % 11 = 0 then 'other' else 'edge_proxy' end,
  '[1]: 10.0.0.1:5 [t] fe be/s1 10/0/30/69/', cast(floor(value * 100) as bigint), ' ',
  case event_type when 'error' then 500 + event_id % 4 when 'click' then 200
    when 'view' then 200 + (event_id % 2) * 104 when 'signup' then 400 + event_id % 5 else 201 end,
  ' ', (event_id * 37) % 5000, ' - - ---- 1/1/1/1/0 0/0 "',
  case when event_id % 13 = 0 then 'OPTIONS' when event_type in ('click', 'view') then 'GET'
    when event_type = 'signup' then 'POST' when event_type = 'purchase' then 'PUT' else 'DELETE' end, ' ',
  case event_id % 6 when 0 then concat('/users/', user_id, '/orders')
    when 1 then concat('/jp/journeys/f', event_id, '/calling-points')
    when 2 then concat('/REF', lpad(cast(event_id as string), 8, '0'))
    when 3 then concat('/search?q=a+b%20', event_type, '&u=', user_id)
    when 4 then concat('/bad%zz/', event_type)
    else concat('/users%2F', user_id) end,
  ' HTTP/1.1"') as value
from {events}
"""

# Flat instance facts from orders x customer. Tag values are null where the tag is absent.
INSTANCE_FACTS_SQL = """
select cast(floor(o_orderkey / 50) as int) as res_pos, cast(o_orderkey % 50 as int) as inst_pos,
  concat('i-', o_orderkey) as instance_id, o_orderdate as launch_time,
  concat('10.0.', o_orderkey % 250, '.', o_custkey % 250) as private_ip,
  case o_orderstatus when 'O' then 'running' when 'F' then 'stopped' else 'terminated' end as state,
  case when o_orderpriority = '5-LOW' then 'prod' else 'test' end as role,
  case when o_orderkey % 997 = 5 then 'baseimage' else concat('Sid_', o_orderkey % 1000) end as build,
  case when o_orderkey % 5 = 0 then null else concat('Sid-', o_orderkey % 1000, '.Example.test') end as hostname,
  case when o_custkey % 7 = 0 then '' when o_custkey % 7 = 1 then null else c_name end as launched_by_name,
  case when o_custkey % 11 = 0 then null when o_custkey % 11 = 1 then ''
    when o_custkey % 11 = 2 then 'bot@example.test' else concat('u', o_custkey, '@example.test') end as launched_by_email,
  case when o_orderkey % 17 = 0 then '' else null end as no_age_alert,
  concat('box-', o_orderkey) as name_tag,
  case when o_orderkey % 10 = 3 then null else cast(o_orderkey % 24 as int) end as launched_at_hours,
  case when o_orderkey % 9 = 0 then null else cast(o_custkey % 2500 as int) end as ttl_days,
  o_orderkey % 13 = 4 as terminate_after_empty,
  o_orderkey % 2 = 0 as stamp_millis,
  o_orderkey % 19 = 7 as decoy_role
from {orders} join {customer} on o_custkey = c_custkey
"""

BROKERS_SQL = """
select s_suppkey as pos, concat('b-', s_suppkey) as broker_id,
  concat('Sid_', s_suppkey % 80, '-rabbit-dev', case when s_suppkey % 2 = 0 then '-2' else '' end) as broker_name
from {supplier}
"""

# Every order asks for its build, so a build has many requests and the plan covers the whole
# inventory.
EXTENSION_REQUESTS_SQL = """
select concat('Sid_', o_orderkey % 1000) as build, cast(1 + o_orderkey % 3 as double) as hours
from {orders}
"""

# Fixture parameters shared by the registered queries and their oracles.
AS_OF = "2001-07-31 12:00:00"
LOG_MARKER = "edge_proxy"
ID_PREFIX = "REF"
IGNORE_OWNER = "bot@example.test"
EXCLUDED_BUILDS = ("baseimage",)

ROWS_PER_TASK = 25_000  # instances of which a task builds the pages; about 12 MB of JSON


def duckdb_sql(text: str) -> str:
    """The same text with placeholders bound to the oracle's pre-registered views."""
    return text.format(events="events", orders="orders", customer="customer", supplier="supplier")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def access_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ACCESS_LOG_SQL, events=load(spark, sf_dir, "events"))


def _tag_values(facts: DataFrame) -> list[tuple[str, Column]]:
    """(key, value) of every tag an instance may carry; a null value means the tag is absent."""
    launch = F.col("launch_time")
    launched_ts = launch + F.make_dt_interval(F.lit(0), F.col("launched_at_hours"))
    launched_at = F.when(F.col("stamp_millis"), iso_z_millis(launched_ts)).otherwise(iso_z(launched_ts))
    terminate_ts = launch + F.make_dt_interval(F.col("ttl_days"))
    terminate_after = (F.when(F.col("ttl_days").isNull(), F.lit(None).cast("string"))
                       .when(F.col("terminate_after_empty"), F.lit(""))
                       .otherwise(iso_z_millis(terminate_ts)))
    return [
        ("role", F.col("role")),
        ("build", F.col("build")),
        ("hostname", F.col("hostname")),
        ("launched_by_name", F.col("launched_by_name")),
        ("launched_by_email", F.col("launched_by_email")),
        ("no_age_alert", F.col("no_age_alert")),
        ("Name", F.col("name_tag")),
        ("launched_at", launched_at),
        ("terminate_after", terminate_after),
    ]


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(INSTANCE_FACTS_SQL, orders=load(spark, sf_dir, "orders"),
                     customer=load(spark, sf_dir, "customer"))


def access_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The derived proxy lines written once per session as text files (``part-*.txt``)."""
    return land_text_once(spark, f"access_log/{sf_dir}", lambda: access_log_lines(spark, sf_dir))


def raw_instances(spark: SparkSession, sf_dir: str, page_size: int | None = None) -> DataFrame:
    """Flat instances with their tag entry array ``Tags`` as the API lists it (absent tags
    left out).

    Every 19th instance carries an extra leading ``role`` entry that its real ``role`` tag
    overrides (a repeated key: the last one wins).

    With a ``page_size`` the facts are shuffled by page before the tags are built, which are
    several times as wide, to partitions of about ``ROWS_PER_TASK`` rows: nesting the pages then
    needs no other shuffle, and a task's rows stay few however large the tables are.
    """
    facts = _facts(spark, sf_dir)
    if page_size:
        n = -(-load(spark, sf_dir, "orders").count() // ROWS_PER_TASK)
        facts = facts.repartition(max(n, 1), page_of(F.col("res_pos"), page_size))
    entries = [("role", F.when(F.col("decoy_role"), F.lit("prod")))] + _tag_values(facts)
    tags = F.filter(F.array(*[F.struct(F.lit(k).alias("Key"), v.alias("Value")) for k, v in entries]),
                    lambda e: e["Value"].isNotNull())
    return facts.select("res_pos", "inst_pos", "instance_id", "launch_time", "private_ip", "state",
                        tags.alias("Tags"))


def inventory_folder(spark: SparkSession, sf_dir: str, page_size: int = 10) -> str:
    """The instance listing as landed JSON lines (gzip), one response with its page number per line,
    written once per session. Absent tags have no entry, null fields no key."""
    def build() -> DataFrame:
        pages = nest_instances(raw_instances(spark, sf_dir, page_size), page_size=page_size)
        return pages.select(F.to_json(F.struct("page", "Reservations")).alias("value"))

    return land_text_once(spark, f"inventory_json/{page_size}/{sf_dir}", build, compression="gzip")


def inventory_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, Reservations`` through the inventory reader."""
    return read_inventory(spark, inventory_folder(spark, sf_dir), json_lines=True)


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat instances ``page, res_pos, inst_pos, instance_id, launch_time, private_ip, tags,
    state``: the JSON listing read, flattened and landed once per session as a parquet table
    partitioned by ``state``, so state filters prune folders.

    Reports run over the landed table. Left as an expression-built map, every pushed-down
    report filter would carry the whole map builder and constraint inference over those
    copies grows combinatorially.
    """
    return land_by_once(spark, f"instances/{sf_dir}", lambda session: flatten_instances(inventory_docs(session, sf_dir)),
                        partition_by=("state",))


def brokers_folder(spark: SparkSession, sf_dir: str, page_size: int = 50) -> str:
    """The broker listing as landed JSON lines, pages of ``page_size`` brokers."""
    def build() -> DataFrame:
        rows = spark.sql(BROKERS_SQL, supplier=load(spark, sf_dir, "supplier"))
        one = F.struct(F.col("pos"), F.struct(F.col("broker_id").alias("BrokerId"), F.col("broker_name").alias("BrokerName")).alias("b"))
        pages = rows.groupBy(F.floor(F.col("pos") / page_size).cast("bigint").alias("page")).agg(
            F.array_sort(F.collect_list(one)).alias("all"))
        doc = F.struct(F.col("page"), F.transform("all", lambda x: x["b"]).alias("BrokerSummaries"))
        return pages.select(F.to_json(doc).alias("value"))

    return land_text_once(spark, f"brokers_json/{page_size}/{sf_dir}", build)


def brokers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page, pos, broker_id, broker_name`` through the broker reader."""
    return read_brokers(spark, brokers_folder(spark, sf_dir), json_lines=True)


def extension_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EXTENSION_REQUESTS_SQL, orders=load(spark, sf_dir, "orders"))
