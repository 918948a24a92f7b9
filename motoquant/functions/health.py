"""Vehicle-health signals: simulated wear features and the live telemetry score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.functions.numeric import _c, clip, round_even, round_int

# Wear distance in km per brake type.
BRAKE_WEAR_KM = {
    "Ventilated Discs": 300_000.0,
    "Discs": 220_000.0,
    "Drums": 260_000.0,
    "Unknown": 250_000.0,
}


def battery_soh(
    fuel: Column | str,
    age: Column | str,
    mileage: Column | str,
    noise: Column | None = None,
    rules: Rules = DEFAULT,
) -> Column:
    """Battery state of health in percent, two decimals."""
    lakh = _c(mileage) / 100_000.0
    cycled = 100.0 * F.exp(-0.35 * F.pow(lakh, F.lit(1.6))) - 0.4 * _c(age)
    aged = 100.0 * F.exp(-0.045 * _c(age)) - 0.8 * lakh
    base = F.when(_c(fuel) == "Hybrid", cycled).otherwise(aged)
    return round_even(clip(base if noise is None else base + noise, rules.soh_floor, 100.0), 2)


def transmission_offset(
    transmission: Column | str,
    mileage: Column | str,
    noise: Column | None = None,
    rules: Rules = DEFAULT,
) -> Column:
    """Adaptation offset: exactly 0 for a manual box, otherwise strictly negative."""
    km = _c(mileage)
    band = F.when(km < 60_000, -0.02).when(km < 120_000, -0.05).otherwise(-0.10)
    worn = band + (-0.02) * (km / 120_000.0)
    if noise is not None:
        worn = worn + noise
    worn = F.when(worn.isNotNull(), F.least(worn, F.lit(rules.offset_max)))
    return F.when(_c(transmission) == "Manual", 0.0).otherwise(round_even(worn, 4))


def annual_mileage(mileage: Column | str, age: Column | str) -> Column:
    return round_even(_c(mileage) / F.greatest(_c(age), F.lit(1)), 1)


def expected_faults(age: Column | str, mileage: Column | str) -> Column:
    return 0.02 * _c(age) + 0.8 * (_c(mileage) / 100_000.0)


def brake_life(
    mileage: Column | str,
    front: Column | str,
    rear: Column | str,
    noise: Column | None = None,
) -> Column:
    """Remaining brake life of the worse axle, in percent."""
    pairs = [F.lit(x) for item in BRAKE_WEAR_KM.items() for x in item]
    table = F.create_map(*pairs)

    def wear(kind: Column) -> Column:
        return F.coalesce(F.try_element_at(table, kind), F.lit(BRAKE_WEAR_KM["Unknown"]))

    # the faster-wearing axle is the one with the smaller distance
    distance = F.least(wear(_c(front)), wear(_c(rear)))
    life = 100.0 * F.exp(-_c(mileage) / distance)
    return round_even(clip(life if noise is None else life + noise, 5.0, 100.0), 1)


def wear_health_score(
    mileage: Column | str,
    soh: Column | str,
    offset: Column | str,
    faults: Column | str,
    brakes: Column | str,
) -> Column:
    penalty = (
        (100.0 - _c(soh)) * 0.25
        + F.least(F.lit(25.0), _c(faults) * 6.0)
        + clip((_c(mileage) - 100_000.0) / 20_000.0, 0.0, 15.0)
        + (100.0 - _c(brakes)) * 0.15
        + F.least(F.lit(10.0), -_c(offset) * 50.0)
    )
    return round_even(clip(100.0 - penalty, 0.0, 100.0), 1)


def telemetry_health_score(
    mileage: Column | str,
    services_done: Column | str,
    services_due: Column | str,
    faults: Column | str,
    coolant_c: Column | str,
    battery_v: Column | str,
) -> Column:
    """Whole-number score 0 to 100 of one telemetry snapshot."""
    volts, coolant = _c(battery_v), _c(coolant_c)
    due = F.greatest(F.lit(1), F.coalesce(_c(services_due), F.lit(0)))
    ratio = clip(F.coalesce(_c(services_done), F.lit(0)) / due, 0.0, 1.0)
    penalty = (
        (1.0 - ratio) * 20.0
        + F.least(F.lit(25.0), F.coalesce(_c(faults), F.lit(0)) * 8.0)
        + clip((F.coalesce(_c(mileage), F.lit(0)) - 100_000.0) / 10_000.0, 0.0, 12.0)
        + F.when(volts < 12.6, 12.0).when(volts < 13.0, 6.0).otherwise(0.0)
        + F.when(coolant > 100, 12.0).when(coolant > 95, 5.0).when(coolant < 75, 4.0).otherwise(0.0)
    )
    return round_int(clip(F.rint(100.0 - penalty), 0.0, 100.0))
