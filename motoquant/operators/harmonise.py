"""Three raw markets to one listing schema, pooling, cleaning, and spec cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, LISTING_KEY, Rules
from motoquant.functions import measures as M
from motoquant.functions import vocab as V
from motoquant.functions.numeric import round_even, to_number

LISTING_COLUMNS = [
    "model_class", "year", "mileage", "transmission", "fuel_type",
    "engine_size", "engine_hint", "price_rm", "source_market",
]


def _listing(
    raw: DataFrame,
    *,
    model: str,
    year: str,
    distance: Column,
    transmission: str,
    fuel: str,
    size: Column,
    hint: Column,
    price: Column,
    market: str,
) -> DataFrame:
    return raw.select(
        V.canonical_class(F.col(model)).alias("model_class"),
        to_number(year).alias("year"),
        distance.alias("mileage"),
        V.training_transmission(F.col(transmission)).alias("transmission"),
        V.training_fuel(F.col(fuel)).alias("fuel_type"),
        size.cast("double").alias("engine_size"),
        hint.cast("double").alias("engine_hint"),
        price.alias("price_rm"),
        F.lit(market).alias("source_market"),
    )


def of_brand(raw: DataFrame, column: str, brand: str) -> DataFrame:
    return raw.filter(F.lower(F.col(column)).contains(brand))


def harmonise_uk(raw: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Single-brand table, miles and pounds; the engine size is a real one."""
    litres = to_number("engineSize")
    return _listing(
        raw, model="model", year="year",
        distance=to_number("mileage") * rules.miles_to_km,
        transmission="transmission", fuel="fuelType", size=litres, hint=litres,
        price=to_number("price") * rules.fx_gbp, market="uk",
    )


def harmonise_germany(raw: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Kilometres and euros; the engine size is only hinted at by the badge."""
    return _listing(
        of_brand(raw, "brand", rules.brand), model="model", year="year",
        distance=to_number("mileage_in_km"),
        transmission="transmission_type", fuel="fuel_type",
        size=F.lit(None), hint=M.badge_litres("model"),
        price=to_number("price_in_euro") * rules.fx_eur, market="germany",
    )


def harmonise_us(raw: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Free-text models, miles and dollars."""
    return _listing(
        of_brand(raw, "manufacturer", rules.brand), model="model", year="year",
        distance=to_number("odometer") * rules.miles_to_km,
        transmission="transmission", fuel="fuel",
        size=F.lit(None), hint=M.badge_litres("model"),
        price=to_number("price") * rules.fx_usd, market="us",
    )


def pool(
    uk: DataFrame, germany: DataFrame, us: DataFrame | None = None, include_us: bool = False
) -> DataFrame:
    """Concatenate markets by column name; the noisy third market is opt-in."""
    parts = [uk, germany] + ([us] if include_us and us is not None else [])
    return reduce(lambda a, b: a.unionByName(b), parts)


def in_bounds(rules: Rules = DEFAULT) -> Column:
    return (
        F.col("year").between(rules.min_year, rules.reference_year)
        & F.col("mileage").between(0.0, rules.max_mileage_km)
        & F.col("price_rm").between(rules.min_price_rm, rules.max_price_rm)
    )


def clean_pool(pooled: DataFrame, rules: Rules = DEFAULT) -> DataFrame:
    """Complete keys, plausible ranges, age, whole-ringgit price, no exact duplicates."""
    return (
        pooled.na.drop(subset=["model_class", "year", "mileage", "price_rm"])
        .filter(in_bounds(rules))
        .withColumn("year", F.col("year").cast("int"))
        .withColumn("age", (F.lit(rules.reference_year) - F.col("year")).cast("int"))
        .withColumn("price_rm", F.rint("price_rm").cast("bigint"))
        .dropDuplicates()
    )


def clean_specs(raw: DataFrame, rules: Rules = DEFAULT, position: str = "spec_pos") -> DataFrame:
    """Parse the maker's spec rows; ``position`` is any sortable column giving source order."""
    first_year, last_year = M.year_bounds("Production years")
    cc = M.displacement_cc("Displacement")
    parsed = of_brand(raw, "Company", rules.brand).select(
        F.trim(F.coalesce(F.col("Model"), F.lit("nan"))).alias("variant"),
        V.canonical_class(F.col("Serie")).alias("model_class"),
        first_year.alias("year_min"),
        last_year.alias("year_max"),
        cc.alias("displacement_cc"),
        M.cylinders("Cylinders").alias("n_cylinders"),
        M.engine_config("Cylinders").alias("engine_config"),
        M.gear_count("Gearbox").alias("n_gears"),
        M.gear_type("Gearbox").alias("gear_type"),
        M.aspiration("Fuel System").alias("aspiration"),
        M.kmh("Top Speed").alias("top_speed_kmh"),
        M.torque_nm("Torque(Nm)").alias("torque_nm"),
        M.seconds(F.col("`Acceleration 0-62 Mph (0-100 kph)`")).alias("accel_0_100_s"),
        M.boot_litres("Cargo Volume").alias("boot_l"),
        M.brake_type("Front brake").alias("front_brake"),
        M.brake_type("Rear brake").alias("rear_brake"),
        (cc / 1000.0).alias("displacement_l"),
        F.col(position).alias("spec_pos"),
    )
    return parsed.na.drop(subset=["model_class", "year_min"])


def backfill_engine_size(df: DataFrame) -> DataFrame:
    """Missing size from the matched displacement, then a coded zero likewise to one decimal."""
    litres = F.col("displacement_cc") / 1000.0
    filled = F.coalesce(F.col("engine_size"), litres)
    return df.withColumn(
        "engine_size",
        F.when(F.col("engine_size") == 0, round_even(litres, 1)).otherwise(filled),
    )


COMPLETE_SPECS = ["n_gears", "top_speed_kmh", "torque_nm", "accel_0_100_s", "boot_l"]


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``.

    An aggregate with map-side combine: many copies of one key never meet in one task, which a
    ranking window would force.
    """
    rest = [c for c in df.columns if c not in keys]
    ordered = order + [c for c in rest if c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def repair_processed(
    df: DataFrame, order: list[str], rules: Rules = DEFAULT, keys: list[str] | None = None
) -> DataFrame:
    """Duplicate listings out, zero engine sizes and broken torques mended."""
    unique = keep_first(df, keys or LISTING_KEY, order)
    litres = round_even(F.col("displacement_cc") / 1000.0, 1)
    return unique.withColumn(
        "engine_size", F.when(F.col("engine_size") == 0, litres).otherwise(F.col("engine_size"))
    ).withColumn(
        "torque_nm", F.when(F.col("torque_nm") <= rules.torque_max_nm, F.col("torque_nm"))
    )


def clean_processed(df: DataFrame, order: list[str], rules: Rules = DEFAULT) -> DataFrame:
    """The model-ready table: repaired rows with complete specs, constant flag column dropped.

    Whether the flag is constant decides the output schema, so it is the one thing looked up.
    """
    out = repair_processed(df, order, rules).na.drop(subset=COMPLETE_SPECS)
    if "spec_matched" in df.columns:
        low, high = df.agg(F.min("spec_matched"), F.max("spec_matched")).first()
        if low == high:
            out = out.drop("spec_matched")
    return out


def cleaning_ledger(df: DataFrame, rules: Rules = DEFAULT, keys: list[str] | None = None) -> DataFrame:
    """Rows left after each cleaning step, from one aggregate over the distinct listings."""
    keys = keys or LISTING_KEY
    order = [c for c in df.columns if c not in keys]
    # the first row is the same by the columns up to the last that is read; those behind it stay out of the shuffle
    order = order[: 1 + max((i for i, c in enumerate(order) if c in ("torque_nm", "engine_size", *COMPLETE_SPECS)), default=0)]
    # one pass for the copies, one row per distinct listing afterwards
    folded = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*order)).alias("_row")
    )
    field = lambda c: F.col(c) if c in keys else F.col(f"_row.{c}")
    broken = field("torque_nm") > rules.torque_max_nm
    complete = ~broken
    for c in COMPLETE_SPECS:
        complete = complete & field(c).isNotNull()
    counts = folded.agg(
        F.sum("_copies").alias("loaded"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.count_if(field("engine_size") == 0).alias("zero_size"),
        F.count_if(broken).alias("broken_torque"),
        F.count_if(complete).alias("complete_rows"),
    )
    steps = [
        ("1 loaded", F.lit(0).cast("bigint"), F.col("loaded")),
        ("2 drop duplicate listings", F.col("loaded") - F.col("distinct_rows"), F.col("distinct_rows")),
        ("3 backfill zero engine_size", F.col("zero_size"), F.col("distinct_rows")),
        ("4 null broken torque_nm", F.col("broken_torque"), F.col("distinct_rows")),
        ("5 drop incomplete specs", F.col("distinct_rows") - F.col("complete_rows"), F.col("complete_rows")),
    ]
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("step"),
            hit.cast("bigint").alias("rows_touched"),
            left.cast("bigint").alias("rows_left"),
        )
        for name, hit, left in steps
    ])
    return counts.select(F.inline(rows))
