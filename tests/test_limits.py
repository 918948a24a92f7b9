"""Values past the bounds that tables, cuts and number formats once had."""

from __future__ import annotations

from pyspark.sql import functions as F

from motoquant.functions.measures import price_rm
from motoquant.functions.noise import poisson
from motoquant.functions.urls import slug_name
from motoquant.operators import metrics, upsert
from motoquant.operators.curves import rate_curve
from motoquant.sources.tables import append_with_resume


def test_rate_curve_past_the_table(spark):
    df = spark.createDataFrame([(1, 2026 - 188, 900_000_000, None)], "profile_id int, year int, original_purchase_price_rm long, predicted_rm double")
    got = [r["value_rm"] for r in rate_curve(df, 4).orderBy("step").collect()]
    assert got == [round(900_000_000 * 0.95**n) for n in range(188, 193)]


def test_poisson_of_large_means(spark):
    draws = spark.range(2000).select(poisson(F.lit(800.0), ["id"], "t", 1).alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(draws[0] - 800) < 5 * (800 / 2000) ** 0.5 and 25 < draws[1] < 32


def test_long_slugs_stay_whole(values):
    slug = "car-" + "x" * 1500
    assert values([f"https://h.example/{slug}"], lambda c: slug_name(c, "car-")) == ["x" * 1500]


def test_prices_of_plain_numbers(values):
    assert values(["149000.0", "149000.5", "RM1,234.50", "149.000", "149000", None], price_rm) == [149000, 149000, 123450, 149000, 149000, None]


def test_folds_balance_whole_groups_of_any_type(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 97).alias("g"))
    got = metrics.group_folds(df, "g", 3)
    assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).agg(F.max("n")).first()[0] == 1
    loads = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(loads) == 3 and max(loads) - min(loads) < 60


def test_union_without_a_cap_keeps_all(spark):
    a, b = spark.range(300).toDF("x"), spark.range(50).toDF("x")
    assert upsert.capped_union(a, b, None, ["x"]).count() == 350


def test_append_starts_a_table_and_resumes(spark, tmp_path):
    new = spark.createDataFrame([("u1", 1), ("u2", 2)], "source_url string, v int")
    path = str(tmp_path / "out")
    assert append_with_resume(new, path) == 2 and append_with_resume(new, path) == 0
