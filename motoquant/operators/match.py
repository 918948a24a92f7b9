"""Attach vehicle specs to listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, SPEC_CATEGORICAL, SPEC_NUMERIC, Rules
from motoquant.operators.harmonise import backfill_engine_size
from motoquant.operators.joins import lookup_join, small_enough
from motoquant.sources.tables import materialise

ATTACHED = ["variant", *SPEC_NUMERIC, *SPEC_CATEGORICAL]


def _candidates(specs: DataFrame) -> DataFrame:
    """Per class, year (null: any year) and displacement: the first spec and the number of specs.

    Specs that share class, years and displacement differ only in source position and the first
    one wins, so they fold into one candidate before anything is expanded. The candidates of a class and
    year are its distinct displacements, however many spec rows there are.
    """
    folded = specs.groupBy("model_class", "year_min", "year_max", "displacement_l").agg(
        F.min("spec_pos").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    # an open year range (no upper bound parsed) never contains a year, as with a plain comparison
    years = F.when(
        F.col("year_max") >= F.col("year_min"), F.sequence("year_min", "year_max")
    ).otherwise(F.array().cast("array<int>"))
    per_year = folded.withColumn(
        "year", F.explode(F.concat(years, F.array(F.lit(None).cast("int"))))
    )
    return per_year.groupBy("model_class", "year", "displacement_l").agg(
        F.min("pos").alias("pos"), F.sum("n").alias("n")
    )


def _candidate_profiles(candidates: DataFrame) -> DataFrame:
    """Per class and year: the candidate displacements and their median."""
    return candidates.groupBy("model_class", "year").agg(
        F.expr("percentile(displacement_l, 0.5D, n)").alias("median_l"),
        F.collect_list(F.struct("displacement_l", "pos")).alias("candidates"),
    )


def _nearest(candidates: Column, target: Column) -> Column:
    """Position of the candidate closest to the target; unknown displacement comes last."""
    best = F.array_min(
        F.transform(
            candidates,
            lambda c: F.struct(
                (c["displacement_l"].isNull() | target.isNull()).alias("unknown"),
                F.abs(c["displacement_l"] - target).alias("gap"),
                c["pos"].alias("pos"),
            ),
        )
    )
    return best["pos"]


MATCH_KEY = ["model_class", "year", "engine_hint"]


def _match(listings: DataFrame, specs: DataFrame, rules: Rules) -> DataFrame:
    """Listings with spec columns and match level, each row ranking the candidates of its class and year.

    Only a candidate can be picked, so of a large catalogue the candidates alone are joined. Profiles
    and candidates are broadcast when their checked size allows, and shuffled with salt otherwise.
    """
    candidates = _candidates(specs)
    profiles = _candidate_profiles(candidates)
    catalogue = specs.select("spec_pos", *ATTACHED)
    fits = catalogue_fits = small_enough(specs.select("spec_pos"), rules)
    if not fits:
        fits = small_enough(candidates.select("pos"), rules)
        wanted = candidates.select(F.col("pos").alias("spec_pos")).distinct()
        catalogue = catalogue.join(F.broadcast(wanted) if fits else wanted, "spec_pos", "left_semi")
        catalogue_fits = fits and small_enough(catalogue.select("spec_pos"), rules)
    by_year = profiles.filter(F.col("year").isNotNull()).select(
        "model_class", "year", F.col("median_l").alias("_ym"), F.col("candidates").alias("_yc")
    )
    by_class = profiles.filter(F.col("year").isNull()).select(
        "model_class", F.col("median_l").alias("_cm"), F.col("candidates").alias("_cc")
    )
    in_year = F.col("_yc").isNotNull()
    cands = F.when(in_year, F.col("_yc")).otherwise(F.col("_cc"))
    target = F.coalesce(
        F.col("engine_hint"), F.when(in_year, F.col("_ym")).otherwise(F.col("_cm"))
    )
    level = (
        F.when(F.col("_cc").isNull(), "none")
        .when(~in_year, "class_repr")
        .when(F.col("engine_hint").isNotNull(), "displacement")
        .otherwise("year_repr")
    )
    keyed = lookup_join(
        lookup_join(listings, by_year, ["model_class", "year"], rules=rules, checked=fits),
        by_class, "model_class", rules=rules, checked=fits,
    )
    picked = keyed.select(
        *listings.columns,
        _nearest(cands, target).alias("spec_pos"),
        level.alias("match_level"),
    )
    joined = lookup_join(picked, catalogue, "spec_pos", rules=rules, checked=catalogue_fits)
    known = F.col("match_level") != "none"
    return joined.select(
        *listings.columns,
        "variant",
        *SPEC_NUMERIC,
        *[F.when(known, F.col(c)).otherwise("Unknown").alias(c) for c in SPEC_CATEGORICAL],
        known.alias("spec_matched"),
        "match_level",
    )


def nearest_spec(listings: DataFrame, specs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Every listing with the specs of the nearest variant of its class and year.

    The match depends on (class, year, hint) only, so the distinct ones are matched, and written, and a
    listing meets one row of that table. Where they are too many to broadcast, the listings themselves are
    matched: a profile row is keyed by class and year, so each meets exactly one year profile and one class
    profile. No candidate pairs are produced either way.
    """
    keys = materialise(listings.select(*MATCH_KEY).distinct(), "match-keys")
    if not small_enough(keys, rules):
        return _match(listings, specs, rules)
    found = materialise(_match(keys, specs, rules), "matches")
    attached = [c for c in found.columns if c not in MATCH_KEY]
    table = found.select(*[F.col(c).alias(f"_k_{c}") for c in MATCH_KEY], *attached)
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in MATCH_KEY])
    # a key has as many rows as the catalogue has for its spec
    return lookup_join(listings, table, on, rules=rules).select(*listings.columns, *attached)


def enrich(listings: DataFrame, specs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Nearest-spec join, missing engine size filled from the match, hint dropped."""
    matched = nearest_spec(listings, specs, rules)
    return matched.withColumn(
        "engine_size", F.coalesce(F.col("engine_size"), F.col("displacement_cc") / 1000.0)
    ).drop("engine_hint")


MATCH_LEVELS = ["displacement", "year_repr", "class_repr", "none"]


def match_quality(enriched: DataFrame) -> DataFrame:
    """Rows by market and match level; levels are a closed list, so the pivot needs no scan."""
    return (
        enriched.groupBy("source_market")
        .pivot("match_level", MATCH_LEVELS)
        .count()
        .na.fill(0)
    )


def mapping_coverage(listings: DataFrame, specs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Share of rows with a parsed class, and with a class the catalogue knows, per market."""
    known = specs.select("model_class").distinct().withColumn("_known", F.lit(True))
    flagged = lookup_join(listings, known, "model_class", rules=rules)
    return flagged.groupBy("source_market").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("model_class").isNotNull().cast("double")).alias("parsed_share"),
        F.avg(F.coalesce(F.col("_known"), F.lit(False)).cast("double")).alias("in_specs_share"),
    )


def spec_confidence(listings: DataFrame, specs: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Explicit evidence join: class, variant and year give exact; class and variant partial.

    The catalogue side is folded per (class, variant) first: the first spec, and the first spec
    whose years hold the listing year, found in an array of distinct year ranges. One output row
    per listing, whatever the number of specs of its variant.
    """
    ranges = specs.groupBy("model_class", "variant", "year_min", "year_max").agg(
        F.min("spec_pos").alias("pos")
    )
    folded = ranges.groupBy("model_class", "variant").agg(
        F.min("pos").alias("any_pos"),
        F.collect_list(F.struct("pos", "year_min", "year_max")).alias("ranges"),
    )
    joined = lookup_join(listings, folded, ["model_class", "variant"], rules=rules)
    in_range = F.filter(
        "ranges", lambda r: F.col("year").between(r["year_min"], r["year_max"])
    )
    exact_pos = F.array_min(F.transform(in_range, lambda r: r["pos"]))
    return joined.select(
        *listings.columns,
        F.coalesce(exact_pos, F.col("any_pos")).alias("spec_pos"),
        F.when(exact_pos.isNotNull(), "exact")
        .when(F.col("any_pos").isNotNull(), "partial")
        .otherwise("unmatched")
        .alias("confidence"),
    )


__all__ = [
    "ATTACHED", "backfill_engine_size", "enrich", "mapping_coverage",
    "match_quality", "nearest_spec", "spec_confidence",
]
