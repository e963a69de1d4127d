"""DuckDB oracle SQL for every registered query (same column names as the Spark side).

The oracles recompute each report from the fixture facts without regexes over log lines,
without tag maps and without parsing rendered time tags, so they check the Spark operators
independently. The shared fixture SQL comes from ``opsdeck.sources.fixtures``.
"""

from __future__ import annotations

from opsdeck.sources import fixtures as fx

AS_OF = f"timestamp '{fx.AS_OF}'"
IGNORE = fx.IGNORE_OWNER

# Expected fields of the proxy lines built from events (what the parser must recover).
_LOG_FIELDS = """
select event_id, user_id, event_type,
  cast(floor(value * 100) as double) as resp_time_ms,
  cast(case event_type when 'error' then 500 + event_id % 4 when 'click' then 200
    when 'view' then 200 + (event_id % 2) * 104 when 'signup' then 400 + event_id % 5 else 201 end as bigint) as status,
  cast((event_id * 37) % 5000 as bigint) as resp_bytes,
  case when event_type in ('click', 'view') then 'GET' when event_type = 'signup' then 'POST'
    when event_type = 'purchase' then 'PUT' else 'DELETE' end as method,
  case event_id % 6 when 0 then concat('/users/', user_id, '/orders')
    when 1 then concat('/jp/journeys/f', event_id, '/calling-points')
    when 2 then concat('/REF', lpad(cast(event_id as varchar), 8, '0'))
    when 3 then concat('/search?q=a+b%20', event_type, '&u=', user_id)
    when 4 then concat('/bad%zz/', event_type)
    else concat('/users%2F', user_id) end as url,
  case event_id % 6 when 0 then '/users/[id]/orders' when 1 then '/jp/journeys/[fare_id]/calling-points'
    when 2 then '/[id]' when 3 then concat('/search?q=a+b ', event_type, '&u=', user_id)
    when 4 then concat('/bad%zz/', event_type) else '/users/[id]' end as normalized_url
from events where event_id % 11 <> 0 and event_id % 13 <> 0
"""

_ENDPOINTS = f"""
with e as ({_LOG_FIELDS})
select method, normalized_url as url, count(*) as requests, avg(resp_time_ms) as avg_resp_time_ms,
  avg(resp_bytes) as avg_resp_bytes,
  count(*) filter (where status between 200 and 299) as n_2xx,
  count(*) filter (where status between 400 and 499) as n_4xx,
  count(*) filter (where status between 500 and 599) as n_5xx
from e group by method, normalized_url
"""

# Instance facts plus the typed values a reader of the tags must arrive at.
_INST = f"""
facts as ({fx.duckdb_sql(fx.INSTANCE_FACTS_SQL)}),
inst as (
  select *,
    launch_time + to_hours(launched_at_hours) as launched_at_ts,
    ttl_days is not null as ta_present,
    ttl_days is not null and not terminate_after_empty as ta_truthy,
    case when ttl_days is not null and not terminate_after_empty then launch_time + to_days(ttl_days) end
      as terminate_after_ts,
    coalesce(build not in ('', '0'), false) as build_truthy,
    coalesce(hostname not in ('', '0'), false) as hostname_truthy,
    coalesce(launched_by_email not in ('', '{IGNORE}'), false) as email_ok,
    {AS_OF} as as_of
  from facts)
"""

_BROKERS = f"brokers as ({fx.duckdb_sql(fx.BROKERS_SQL)})"


def _plural(n: str, word: str) -> str:
    return f"(cast({n} as varchar) || ' {word}' || case when {n} = 1 then '' else 's' end)"


def _ordinal(d: str) -> str:
    return (f"(cast({d} as varchar) || case when {d} % 100 between 11 and 13 then 'th' when {d} % 10 = 1 then 'st' "
            f"when {d} % 10 = 2 then 'nd' when {d} % 10 = 3 then 'rd' else 'th' end)")


def _created(ts: str) -> str:
    return (f"(strftime({ts}, '%a') || ' ' || lpad(cast(day({ts}) as varchar), 2, ' ') || ' ' || "
            f"strftime({ts}, '%b, %H:%M') || ' ' || lower(strftime({ts}, '%p')))")


def _age_label(n: str) -> str:
    return f"(case when {n} = 0 then 'Today' else {_plural(n, 'day')} || ' ago' end)"


def _pounds(p: str) -> str:
    return f"cast(floor({p} / 100.0 + 0.5) as bigint)"


def _last(table: str, keys: str, order: str = "res_pos desc, inst_pos desc") -> str:
    return (f"(select * exclude (rn) from (select *, row_number() over (partition by {keys} order by {order}) as rn "
            f"from {table}) where rn = 1)")


def _subject(n: str) -> str:
    return f"('[EC2 report] You have ' || {_plural(n, 'running instance')})"


_RUNNING_ROWS = f"""
r0 as (
  select build, res_pos, inst_pos, instance_id, no_age_alert,
    case when coalesce(launched_by_name not in ('', '0'), false) then launched_by_name else 'Unknown' end as owner,
    case when hostname_truthy then hostname else replace(build, '_', '-') || '.example.test' end as link_host,
    coalesce(launched_at_ts, launch_time) as launched, as_of
  from inst where role = 'test' and build_truthy and state = 'running'),
r as (
  select *, date_sub('day', launched, as_of) as age_days from r0),
rs as (
  select *, case when no_age_alert is not null then null when age_days >= 14 then 'danger'
    when age_days >= 7 then 'warning' else '' end as severity from r),
last_set as (select build, severity as last_severity from {_last("(select * from rs where severity is not null)", "build")}),
rl as (select * from {_last("rs", "build")} left join last_set using (build))
"""

_COSTS = f"""
costs as (
  select instance_id, split_part(hostname, '.', 1) as short_name, launch_time as created, private_ip,
    launched_by_name as owner, date_sub('day', launch_time, as_of) as age_days,
    date_sub('day', launch_time, as_of) * 700 as price_pence
  from inst where role = 'test')
"""

ORACLE_SQL: dict[str, str] = {
    "access_log_parsed": f"""
select resp_time_ms, status, resp_bytes, method, url from ({_LOG_FIELDS})
""",
    "url_normalized": r"""
with logged as (""" + _LOG_FIELDS + r"""),
urls as (select url from pages union select url from logged)
select url, regexp_replace(regexp_replace(regexp_replace(url_decode(url),
  '/jp/journeys/[^/]+/calling-points', '/jp/journeys/[fare_id]/calling-points', 'g'),
  '/(\d+)', '/[id]', 'g'), '/REF.{0,10}', '/[id]', 'g') as normalized_url
from urls
""",
    "endpoint_stats": f"{_ENDPOINTS} order by requests desc, method, url limit 50",
    "endpoint_stats_files": f"{_ENDPOINTS} order by requests desc, method, url limit 50",
    "endpoint_stats_all": _ENDPOINTS,
    "endpoint_stats_streamed": _ENDPOINTS,
    "instances_flattened": f"""
with {_INST}
select cast(res_pos // 10 as bigint) as page, res_pos % 10 as res_pos, inst_pos, instance_id, launch_time,
  private_ip, state, role, build, hostname, launched_by_name, launched_by_email, no_age_alert, name_tag as name,
  case when launched_at_ts is null then null
    when stamp_millis then strftime(launched_at_ts, '%Y-%m-%dT%H:%M:%S') || '.000Z'
    else strftime(launched_at_ts, '%Y-%m-%dT%H:%M:%S') || 'Z' end as launched_at,
  case when not ta_present then null when terminate_after_empty then ''
    else strftime(launch_time + to_days(ttl_days), '%Y-%m-%dT%H:%M:%S') || '.000Z' end as terminate_after
from inst
""",
    "tag_filters": f"""
with {_INST}
select instance_id, role = 'test' as is_test, ta_present as has_terminate_after,
  ta_truthy as terminate_after_truthy, build_truthy, hostname_truthy, email_ok as owner_email_ok,
  state = 'running' as running, no_age_alert is not null as no_age_alert_defined
from inst
""",
    "build_last_wins": f"""
with {_INST}
select build, instance_id, res_pos, inst_pos, state, hostname, launched_by_name
from {_last("(select * from inst where role = 'test' and build is not null and build <> 'baseimage')", "build")}
""",
    "build_last_wins_fieldwise": f"""
with {_INST}, {_RUNNING_ROWS}
select build, instance_id, age_days, last_severity as severity from rl
""",
    "broker_lookup": f"""
with {_INST}, {_BROKERS},
b as (select split_part(broker_name, '-rabbit-dev', 1) as build, pos, broker_id from brokers),
bl as {_last("b", "build", "pos desc")},
builds as (select distinct build from inst where role = 'test' and build is not null and build <> 'baseimage')
select builds.build, coalesce('https://' || bl.broker_id || '.mq.eu-west-1.on.aws', '') as rabbit
from builds left join bl on builds.build = bl.build
""",
    "hostname_fallback": f"""
with {_INST}, {_RUNNING_ROWS}
select instance_id, build, lower(link_host) as hostname, 'https://www.' || link_host as website,
  'http://' || link_host || ':9000' as portainer
from r0
""",
    "fleet_listing": f"""
with {_INST}, {_BROKERS},
b as (select split_part(broker_name, '-rabbit-dev', 1) as build, pos, broker_id from brokers),
bl as {_last("b", "build", "pos desc")},
fl as {_last("(select * from inst where role = 'test' and build is not null and build <> 'baseimage')", "build")},
f as (select fl.*, date_diff('day', launched_at_ts, as_of) as age_days,
        coalesce('https://' || bl.broker_id || '.mq.eu-west-1.on.aws', '') as rabbit
      from fl left join bl on fl.build = bl.build)
select build, case when coalesce(launched_by_name <> '', false) then launched_by_name else 'Unknown' end as owner,
  hostname, 'https://www.' || hostname as website, 'http://' || hostname || ':9000' as portainer,
  'http://admin.' || hostname as admin, rabbit, launched_at_ts as launched_at, age_days,
  {_age_label("age_days")} as age_label,
  case when age_days > 60 then 'danger' when age_days > 30 then 'warning' else '' end as severity,
  state = 'running' as running,
  case when state = 'running' then 'Running' else 'Stopped' end as status_label,
  case when state = 'running' then '#28a745' else '#dc3545' end as status_color
from f
""",
    "running_listing": f"""
with {_INST}, {_RUNNING_ROWS}
select build, owner, lower(link_host) as hostname, 'https://www.' || link_host as website,
  'http://' || link_host || ':9000' as portainer, 'n/a' as expires, {_created("launched")} as created,
  age_days, {_age_label("age_days")} as age_label, age_days >= 30 as overdue, last_severity as severity
from rl
""",
    "listing_counts": f"""
with {_INST}, {_RUNNING_ROWS}
select (select count(distinct build) from inst where role = 'test' and build is not null and build <> 'baseimage')
    as n_fleet_builds,
  (select count(*) from rl) as n_running_builds
""",
    "age_digest": f"""
with {_INST},
a as (select launched_by_email as owner, build, res_pos, inst_pos, date_sub('day', launch_time, as_of) as age_days
      from inst where role = 'test' and build_truthy and state = 'running' and email_ok),
al as {_last("(select * from a where age_days >= 2)", "owner, build")},
c as (select owner, count(*) as n_instances from al group by owner)
select owner, build, age_days, build || ', running for ' || {_plural("age_days", "day")} as item_text,
  'Here''s a list of your instances that have been running for 2 days or more:' as heading,
  'https://reports.example.test/instances' as link,
  n_instances, {_subject("n_instances")} as subject
from al join c using (owner)
""",
    "expiry_digest": f"""
with {_INST},
e as (select launched_by_email as owner, build, res_pos, inst_pos,
        date_sub('day', launched_at_ts, as_of) as age_days,
        date_sub('day', as_of, terminate_after_ts) as expires_days,
        strftime(terminate_after_ts, '%A') || ' ' || {_ordinal("day(terminate_after_ts)")} || ' of '
          || strftime(terminate_after_ts, '%B') as expires_on
      from inst where role = 'test' and ta_truthy and build_truthy and state = 'running' and email_ok),
el as {_last("(select * from e where expires_days <= 8)", "owner, build")},
c as (select owner, count(*) as n_instances from el group by owner)
select owner, build, age_days, expires_days, expires_on,
  build || ', created ' || case when age_days = 0 then 'less than a day' else {_plural("age_days", "day")} end
    || ' ago will be terminated on the evening of ' || expires_on || '.' as item_text,
  'Here''s a list of instances you launched that will be terminated soon:' as heading,
  'https://reports.example.test/extend?instance=' || build as link,
  n_instances, {_subject("n_instances")} as subject
from el join c using (owner)
""",
    "cost_totals": f"""
with {_INST}, {_COSTS},
t as (select count(*) as total_instances, cast(coalesce(sum(age_days), 0) as bigint) as total_days,
        cast(coalesce(sum(price_pence), 0) as bigint) as total_price_pence from costs)
select total_instances, total_days, total_price_pence, total_instances * 700 as todays_price_pence,
  {_pounds("total_price_pence")} as total_price_pounds, {_pounds("total_instances * 700")} as todays_price_pounds,
  printf('*%d* instances (*£%d/day*)', total_instances, {_pounds("total_instances * 700")}) || chr(10) ||
  printf('*%d* cumulative days (*£%d*)', total_days, {_pounds("total_price_pence")}) as summary
from t
""",
    "cost_by_box": f"""
with {_INST}, {_COSTS}
select *, {_pounds("price_pence")} as price_pounds,
  printf('_*%s*_: %dd, £%d', short_name, age_days, {_pounds("price_pence")}) as item_text
from costs
""",
    "cost_by_box_name": f"""
with {_INST}, {_COSTS}
select *, {_pounds("price_pence")} as price_pounds,
  printf('_*%s*_: %dd, £%d', short_name, age_days, {_pounds("price_pence")}) as item_text
from costs
""",
    "name_lists": """
select p_partkey, case when p_partkey % 11 in (0, 1) or p_name is null or p_name = '' then 'n/a'
  else array_to_string(string_split(p_name, ' '), ', ') end as shown
from part
""",
    "cost_by_owner": f"""
with {_INST}, {_COSTS},
o as (select owner, count(*) as instance_count, cast(coalesce(sum(age_days), 0) as bigint) as instance_days
      from costs group by owner)
select *, case when owner is not null then printf('_*%s*_: x%d, %dd', owner, instance_count, instance_days) end
  as item_text
from o
""",
    "nightly_plan": f"""
with {_INST}
select instance_id, name_tag as name, date_sub('day', as_of, terminate_after_ts) as expires_days,
  case when terminate_after_ts < as_of then 'terminate' else 'stop' end as action
from inst where role = 'test' and ta_present and state = 'running'
""",
    "morning_plan": f"""
with {_INST}
select instance_id, name_tag as name, 'start' as action
from inst where role = 'test' and ta_present and state = 'stopped'
""",
    "extend_lifetime": f"""
with {_INST},
req as (select build, count(*) as n_requests, sum(hours) as hours
        from ({fx.duckdb_sql(fx.EXTENSION_REQUESTS_SQL)}) group by build),
m as (select build, res_pos, inst_pos, instance_id, name_tag as name, terminate_after_ts as old_terminate_after
      from inst where role = 'test' and ta_present),
mf as (select * from {_last("m", "build", "res_pos, inst_pos")} join req using (build)),
n as (select *, old_terminate_after + to_microseconds(cast(hours * 3600 * 1000000 as bigint)) as new_terminate_after
      from mf)
select build, n_requests, hours, instance_id, name, old_terminate_after, new_terminate_after,
  strftime(new_terminate_after, '%Y-%m-%dT%H:%M:%SZ') as new_tag_value
from n
""",
}


def _bodies(digest: str, opened: str, item: str, closed: str) -> str:
    """Digest bodies in parts of 7 items from the digest's own rows (in DuckDB a plain window)."""
    return f"""
with d as ({ORACLE_SQL[digest]}),
p as (select *, row_number() over (partition by owner order by build) as position from d),
q as (select *, (position - 1) // 7 + 1 as part, (n_instances + 6) // 7 as n_parts from p)
select owner, part, n_parts, count(*) as n_items, n_instances, subject,
  case when part = 1 then {opened} else '' end || coalesce(string_agg({item}, '' order by position), '')
    || case when part = n_parts then {closed} else '' end as body_text
from q group by owner, part, n_parts, n_instances, subject
"""


ORACLE_SQL["age_digest_bodies"] = _bodies(
    "age_digest", "'<h3>EC2 instance report</h3><p>' || any_value(heading) || '<p>' || chr(10)",
    f"'<b>' || build || '</b>, running for ' || {_plural('age_days', 'day')} || '<br>' || chr(10)",
    "'<p><a href=''' || any_value(link) || '''>Manage your instances here</a>.'")
ORACLE_SQL["expiry_digest_bodies"] = _bodies(
    "expiry_digest",
    "'<h3>EC2 instance termination warnings:</h3><p>' || any_value(heading) || '<br><p>' || chr(10) || '<ul>' || chr(10)",
    "'<li> <b>' || build || '</b>, created ' || case when age_days = 0 then 'less than a day' else "
    f"{_plural('age_days', 'day')} end || ' ago will be terminated on the evening of ' || expires_on || '. <a href=''' || link "
    "|| '''>Extend instance life</a></li>' || chr(10)", "''")
ORACLE_SQL["fleet_listing_order"] = f"""
select row_number() over (order by running desc, lower(build), build) as position, build, running
from ({ORACLE_SQL["fleet_listing"]})
"""
ORACLE_SQL["running_listing_order"] = f"""
select row_number() over (order by build) as position, build, owner from ({ORACLE_SQL["running_listing"]})
"""
ORACLE_SQL["cost_orders"] = f"""
with boxes as ({ORACLE_SQL["cost_by_box"]}), users as ({ORACLE_SQL["cost_by_owner"]})
select 'name' as list, row_number() over (order by short_name nulls first, instance_id) as position, instance_id as entry, item_text
from boxes
union all
select 'age', row_number() over (order by age_days desc nulls last, short_name desc nulls last, instance_id), instance_id, item_text
from boxes
union all
select 'owner', row_number() over (order by owner nulls first), owner, item_text from users
"""
ORACLE_SQL["cost_message"] = f"""
with o as ({ORACLE_SQL["cost_orders"]}), t as ({ORACLE_SQL["cost_totals"]}),
p as (select *, (position - 1) // 7 + 1 as part from o where list <> 'name')
select 1 as section, cast(null as varchar) as title, cast(1 as bigint) as part, total_instances as n_items,
  summary || chr(10) || '<https://reports.example.test/create|create> | <https://reports.example.test/terminate|terminate> | '
    || '<https://reports.example.test/instances|full listing>' as text from t
union all
select case list when 'age' then 2 else 3 end, case list when 'age' then '= By age (oldest first) =' else '= By dev =' end,
  part, count(*), coalesce(string_agg(item_text, ' | ' order by position), '') from p group by list, part
"""
