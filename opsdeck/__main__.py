"""Command line: ``python -m opsdeck <report> ...``, one command per original script.

Each command builds the report as a DataFrame and either writes it whole as parquet
(``--out``, a distributed write) or prints its first ``--show`` rows. "Now" is ``--as-of``
(default: the current UTC time, taken once per run).
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from opsdeck import constants as C


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m opsdeck")
    p.add_argument("--master", default=None, help="Spark master (default: from the environment)")
    p.add_argument("--out", default=None, help="write the result as parquet here instead of printing")
    p.add_argument("--show", type=int, default=50, help="rows to print when --out is not given")
    p.add_argument("--as-of", default=None, help="report time, 'YYYY-MM-DD HH:MM:SS' UTC (default: now)")
    p.add_argument("--json-lines", action="store_true",
                   help="inventory and broker files hold one response with its page number per line")
    sub = p.add_subparsers(dest="command", required=True)

    e = sub.add_parser("endpoint-stats", help="per-endpoint traffic from proxy log files")
    e.add_argument("log_folder")
    e.add_argument("--marker", default="haproxy")
    e.add_argument("--id-prefix", default="REF")
    e.add_argument("--limit", type=int, default=C.DEFAULT_TOP_N)

    for name, extra in (("fleet-listing", True), ("running-listing", False), ("age-digest", False),
                        ("expiry-digest", False), ("costs", False), ("nightly-plan", False),
                        ("morning-plan", False), ("extend-lifetime", False)):
        s = sub.add_parser(name)
        s.add_argument("inventory", help="instance-listing JSON file(s) or folder")
        if extra:
            s.add_argument("brokers", help="broker-listing JSON file(s) or folder")
        if name == "age-digest":
            s.add_argument("min_days", nargs="?", type=int, default=C.AGE_DIGEST_MIN_DAYS)
        if name == "expiry-digest":
            s.add_argument("within_days", nargs="?", type=int, default=C.EXPIRY_DIGEST_WITHIN_DAYS)
        if name in ("age-digest", "expiry-digest"):
            s.add_argument("--ignore-owner", default="ops@example.test")
        if name == "costs":
            s.add_argument("--by", choices=("totals", "age", "name", "owner"), default="totals")
        if name == "extend-lifetime":
            s.add_argument("build")
            s.add_argument("hours", type=float)
    return p


def build_report(spark, args):
    from opsdeck.functions.urls import default_url_rules
    from opsdeck.operators.nested import flatten_instances
    from opsdeck.plans import costs, digests, lifecycle, listings, traffic
    from opsdeck.sources.inventory import extension_requests, read_brokers, read_inventory
    from opsdeck.sources.logs import read_access_log

    as_of = args.as_of or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    if args.command == "endpoint-stats":
        return traffic.endpoint_stats(read_access_log(spark, args.log_folder), args.marker,
                                      default_url_rules(args.id_prefix), limit=args.limit)
    inst = flatten_instances(read_inventory(spark, args.inventory, args.json_lines))
    if args.command == "fleet-listing":
        return listings.fleet_listing(inst, read_brokers(spark, args.brokers, args.json_lines), as_of)
    if args.command == "running-listing":
        return listings.running_listing(inst, as_of)
    if args.command == "age-digest":
        return digests.age_digest(inst, as_of, min_days=args.min_days, ignore_owner=args.ignore_owner)
    if args.command == "expiry-digest":
        return digests.expiry_digest(inst, as_of, within_days=args.within_days, ignore_owner=args.ignore_owner)
    if args.command == "costs":
        rows = costs.cost_rows(inst, as_of)
        if args.by == "totals":
            return costs.cost_totals(rows)
        return costs.cost_by_owner(rows) if args.by == "owner" else costs.cost_by_box(rows, by=args.by)
    if args.command == "nightly-plan":
        return lifecycle.nightly_plan(inst, as_of)
    if args.command == "morning-plan":
        return lifecycle.morning_plan(inst)
    if args.command == "extend-lifetime":
        return lifecycle.extend_lifetime(inst, extension_requests(spark, [(args.build, args.hours)]))
    raise ValueError(args.command)


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from opsdeck.session import build_session

    spark = build_session(args.master, app=f"opsdeck-{args.command}")
    report = build_report(spark, args)
    if args.out:
        report.write.mode("overwrite").parquet(args.out)
    else:
        report.show(args.show, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
