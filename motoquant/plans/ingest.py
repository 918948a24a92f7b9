"""Listing ingest job: pages of two sources to the stored listing table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.operators import pages, upsert
from motoquant.sources import tables

STORED = [c for c in pages.LISTING_COLUMNS if c not in ("page_id", "outcome")] + ["scraped_at"]


def statuses(stored: DataFrame, source: str) -> DataFrame:
    return stored.select(F.lit(source).alias("source"), pages.page_status(F.col("html")).alias("status"))


def ingest(
    classified_pages: DataFrame,
    dealer_pages: DataFrame,
    state: DataFrame,
    base: str,
    rules: Rules = DEFAULT,
    extract: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New state of the listing table and the run's summary.

    Pages that are challenges or server errors are left out and counted in the summary. ``extract`` replaces an extractor by
    source name. All kept rows are stored, or ``listings_per_run`` of them
    where the rules name a cap, the first source going first.
    """
    by_source = {
        "classifieds": lambda p: pages.bootstrap_listings(p, base, rules=rules),
        "dealers": lambda p: pages.linked_listings(p, rules=rules),
        **(extract or {}),
    }
    first = by_source["classifieds"](pages.good_pages(classified_pages))
    second = by_source["dealers"](pages.good_pages(dealer_pages))
    rows = tables.materialise(first.unionByName(second), "extracted")
    stamped = rows.withColumn("scraped_at", F.current_timestamp())
    kept = stamped.filter("outcome = 'kept'")
    order = ["page_id", "listing_url", "price_rm"]
    batch = upsert.capped_union(
        kept.filter("source = 'classifieds'"), kept.filter("source <> 'classifieds'"), rules.listings_per_run, order
    )
    batch = tables.materialise(batch, "batch")
    new_state = upsert.upsert(state, batch.select(*STORED, "page_id"), ["page_id"])
    read = statuses(classified_pages, "classifieds").unionByName(statuses(dealer_pages, "dealers"))
    return new_state, upsert.run_summary(rows, batch, read, list(by_source))
