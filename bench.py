"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks import derive
from checks.queries import QUERIES
from touchline.operators.results import resolve_names
from touchline.plans.results import extract_results
from touchline.session import build_session, staged

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "fixture_events", "table_results", "carry_forward", "collapse_repeats", "normalize_names",
    "resolve_entities", "edit_join_large", "resolve_matchups", "match_report",
    "consolidate_scores", "league_feed", "pages_to_events", "abbrev_join_large",
    "abbrev_join_reverse_large", "token_join_large", "resolve_entities_large", "ingest_stream",
)


def timed(run) -> float:
    start = time.time()
    run()
    return round(time.time() - start, 3)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(CPUS)),
            "spark.driver.memory": "20g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    sink(derive.table(spark, SF_DIR, "region"))
    seconds = {name: timed(lambda n=name: sink(QUERIES[n](spark, SF_DIR))) for name in HEADLINE}

    # Rates without the cost of making the pages and names from the tables.
    pages = staged(derive.fixture_pages(spark, SF_DIR), "pages")
    parse = timed(lambda: sink(extract_results(pages)[0]))
    results = staged(derive.fixtures(spark, SF_DIR), "fixtures")
    aliases = staged(derive.aliases(spark, SF_DIR), "aliases")
    match = timed(lambda: sink(resolve_names(results, aliases)))
    rates = {
        "pages_per_sec": round(pages.count() / parse, 1),
        "page_rows_per_sec": round(results.count() / parse),
        "distinct_names_per_sec": round(
            results.select("league", "name").distinct().count() / match
        ),
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "rates": rates, "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
