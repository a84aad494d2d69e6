"""Command line jobs over a store of versioned tables.

    python -m tarmaq.jobs dashboard --store DIR --out DIR --as-of "2026-02-01 00:00:00"
    python -m tarmaq.jobs refresh   --store DIR --as-of "2026-02-01 00:00:00"
    python -m tarmaq.jobs audit     --store DIR --out DIR
    python -m tarmaq.jobs totals    --store DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tarmaq.plans import flows, totals
from tarmaq.plans.quality import audit
from tarmaq.schemas import schema_of
from tarmaq.session import build_session, tune
from tarmaq.sources.scans import manifest, scan_tables, scan_version, versions
from tarmaq.sources.sinks import publish, write_report


def follow_totals(spark: SparkSession, store: str) -> str:
    """Bring the kept totals of bookings per day and status to the valid version of the orders.

    Totals carry the version of the orders that they count. They are counted in
    full once; after that the two versions' differences are folded in.
    """
    root = store.rstrip("/")
    path, folder = f"{root}/orders", f"{root}/_booking_totals"
    valid = manifest(spark, root).get("orders") or (versions(spark, path) or [0])[-1]
    done = versions(spark, folder)
    if valid not in done:
        orders = scan_version(spark, path, schema_of("orders"), valid)
        if done and done[-1]:  # version 0: there were no orders
            before = scan_version(spark, path, schema_of("orders"), done[-1])
            fresh = totals.fold(spark.read.parquet(f"{folder}/v={done[-1]}"),
                                totals.signed(totals.order_changes(before, orders)))
        else:
            fresh = totals.booking_totals(orders)
        fresh.write.mode("overwrite").parquet(f"{folder}/v={valid}")
    return f"{folder}/v={valid}"


def run(spark: SparkSession, job: str, store: str, out: str | None = None,
        as_of: str | None = None, fmt: str = "parquet") -> list[str]:
    """Run a job; returns what was written."""
    tables = scan_tables(tune(spark), store)
    if job == "dashboard":
        return [write_report(df, out, name, fmt)
                for name, df in flows.dashboard(tables, as_of).items()]
    if job == "refresh":
        # All new tables are computed from the old ones and become valid at once.
        fresh = publish(spark, store, flows.refresh(tables, as_of))
        return [f"{name} v={version}" for name, version in fresh.items()]
    if job == "totals":
        return [follow_totals(spark, store)]
    return [write_report(audit(tables), out, "audit", fmt)]


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("job", choices=["dashboard", "refresh", "audit", "totals"])
    parser.add_argument("--store", required=True)
    parser.add_argument("--out")
    parser.add_argument("--as-of")
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    args = parser.parse_args(argv)
    for line in run(build_session(f"tarmaq-{args.job}"), args.job, args.store, args.out,
                    args.as_of, args.format):
        print(line)


if __name__ == "__main__":
    main()
