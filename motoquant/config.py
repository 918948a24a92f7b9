"""All business constants in one frozen object; every operator takes it as ``rules``."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Rules:
    # Results depend on them.
    brand: str = "mercedes"
    fx_gbp: float = 5.90
    fx_eur: float = 5.05
    fx_usd: float = 4.70
    reference_year: int = 2026
    min_year: int = 1990
    max_mileage_km: float = 500_000.0
    min_price_rm: float = 3_000.0
    max_price_rm: float = 2_000_000.0
    miles_to_km: float = 1.60934

    soh_floor: float = 30.0
    soh_noise_std: float = 2.0
    offset_noise_std: float = 0.005
    offset_max: float = -1e-4
    brake_noise_std: float = 2.0
    seed: int = 42

    mape_floor_rm: float = 5_000.0
    interval_low: float = 0.04
    interval_high: float = 0.96
    interval_k: float = 1.6737
    ridge_alpha: float = 10.0
    forest_trees: int = 300
    forest_depth: int = 20
    forest_min_leaf: int = 2
    log_forest_trees: int = 200
    log_forest_min_leaf: int = 10
    log_coverage: float = 0.80  # wanted share of prices inside the calibrated band

    comps_year_window: int = 2
    comps_wide_window: int = 5
    comps_min_tight: int = 3
    comps_limit: int = 20
    comps_limit_max: int = 100

    yearly_depreciation: str = "0.05"
    flat_band: float = 0.08
    flat_confidence: float = 0.92
    horizon_years: int = 5
    repair_bundle: tuple[tuple[str, int], ...] = (
        ("Battery health check", 4200),
        ("Brake wear service", 7800),
        ("Cooling system inspection", 6400),
    )

    work_start_hour: int = 9
    work_end_hour: int = 18
    search_days: int = 14
    max_rounds: int = 3
    booking_prefix: str = "BKG-"

    listings_per_run: int | None = None  # a cap, where one is wanted
    torque_max_nm: float = 2000.0
    earth_radius_km: float = 6371.0
    assistant_name: str = "advisor"

    # Scale guards: above these sizes a join is left to the shuffle path.
    broadcast_max_rows: int = 200_000
    forest_max_leaves: int = 5_000_000
    salt_buckets: int = 32

    sources: tuple[str, ...] = field(default=("classifieds", "dealers"))

    @property
    def repair_total(self) -> int:
        return sum(cost for _, cost in self.repair_bundle)


DEFAULT = Rules()

# Columns attached from the spec catalogue.
SPEC_NUMERIC = [
    "displacement_cc", "n_cylinders", "n_gears", "top_speed_kmh",
    "torque_nm", "accel_0_100_s", "boot_l",
]
SPEC_CATEGORICAL = ["engine_config", "aspiration", "gear_type", "front_brake", "rear_brake"]

# Model feature lists.
CATEGORICAL_FEATURES = [
    "model_class", "transmission", "fuel_type", "source_market",
    "engine_config", "aspiration", "gear_type", "front_brake", "rear_brake",
]
NUMERIC_FEATURES = [
    "age", "mileage", "engine_size", "battery_soh", "trans_adapt_offset",
    "n_cylinders", "n_gears", "top_speed_kmh", "torque_nm", "accel_0_100_s", "boot_l",
]
SIMULATED_FEATURES = [
    "battery_soh", "trans_adapt_offset", "estimated_annual_mileage",
    "dtc_fault_count", "brake_life_pct", "health_score",
]
TARGET = "price_rm"
GROUP = "model_class"
LISTING_KEY = [
    "model_class", "year", "mileage", "transmission",
    "fuel_type", "engine_size", "price_rm", "source_market",
]
