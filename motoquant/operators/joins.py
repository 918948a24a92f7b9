"""Join helpers with a size check in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules


def small_enough(df: DataFrame, rules: Rules = DEFAULT) -> bool:
    """True when the frame has no more rows than a broadcast may hold.

    The count stops at the bound, so it stays cheap on a large frame.
    """
    return df.limit(rules.broadcast_max_rows + 1).count() <= rules.broadcast_max_rows


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str] | str | Column,
    how: str = "left",
    rules: Rules = DEFAULT,
    checked: bool | None = None,
) -> DataFrame:
    """Join rows to a lookup table: broadcast if its size allows, else a salted shuffle join.

    ``checked`` carries a size decision that is already known, to avoid a second count. A join on
    an expression cannot be salted here and is left to adaptive skew splitting.
    """
    fits = small_enough(table, rules) if checked is None else checked
    if fits:
        return rows.join(F.broadcast(table), on, how)
    if isinstance(on, (str, list)):
        return salted_lookup_join(rows, table, [on] if isinstance(on, str) else on, how, rules)
    return rows.join(table, on, how)


def salted_lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    rules: Rules = DEFAULT,
) -> DataFrame:
    """Equi-join that spreads every key of ``rows`` over salt buckets.

    For joins where one key may hold a third of the rows and the table has few rows per key:
    the table is repeated once per bucket, the rows are not. Spark counts the repeated table as one copy,
    so without the hint it would broadcast one that is ``salt_buckets`` times too large.
    """
    n = rules.salt_buckets
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(n)))
    repeated = table.withColumn("_salt", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(n)])))
    return salted.join(repeated.hint("merge"), [*on, "_salt"], how).drop("_salt")


def add_group_count(df: DataFrame, keys: list[str], name: str, rules: Rules = DEFAULT) -> DataFrame:
    """Row count of each key on every row, null keys included.

    Counted with map-side combine and joined back, because a window over the key would pull a
    popular value into a single task.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    right = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], name)
    on = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = part if on is None else on & part
    return df.join(right, on, "left").drop(*[f"_k_{k}" for k in keys])
