"""python -m tallyforge --pages PATH --state PATH --output PATH [--targets FILE] [--mode full|lite] [--dry-run]"""

from __future__ import annotations

import argparse
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession

from . import schemas
from .plans import engine
from .sources import sinks


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="tallyforge", description="Fold captured storefront answers into the state.")
    args.add_argument("--pages", required=True, help="captured pages (Parquet)")
    args.add_argument("--state", required=True, help="the state document (JSON) of the last run")
    args.add_argument("--output", required=True, help="folder of the new state, the outbox and the page")
    args.add_argument("--targets", help="a file of target URLs, one a line")
    args.add_argument("--mode", choices=("full", "lite"), default="full")
    args.add_argument("--dry-run", action="store_true", help="write no alerts")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("tallyforge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    targets = None
    if a.targets:
        lines = [x.strip() for x in Path(a.targets).read_text().splitlines() if x.strip()]
        targets = spark.createDataFrame(list(zip(lines, range(len(lines)), strict=True)), "url string, seq bigint")
    done = engine.run(spark, spark.read.schema(schemas.PAGE).parquet(a.pages), a.state, now, mode=a.mode, all_targets=targets)
    from .sources.state_json import save_state

    save_state(done.products, done.domains, f"{a.output}/state", now)
    if not a.dry_run:
        sinks.write_outbox(done.messages, f"{a.output}/outbox", now)
    Path(a.output, "index.html").write_text(sinks.dashboard_page(done.dashboard), encoding="utf-8")
    print(done.summary.first().asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
