"""Car tables derived from the given test tables.

The test data holds no cars, so each query projects its input from lineitem, part, orders,
customer, events, conversations and pages. The projections are plain SQL that Spark and the
comparison database both read, which keeps the two sides on the same rows; everything after the
projection is written twice.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from motoquant.sources.tables import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

FACTS = ("lineitem", "orders", "events", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in FACTS else df


def _pick(words: str, index: str) -> str:
    """The index-th word of a bar-separated list; an empty word stands for null."""
    n = words.count("|") + 1
    return f"nullif(split_part('{words}', '|', CAST(({index}) % {n} AS INT) + 1), '')"


def _text(number: str) -> str:
    return f"CAST(CAST(floor({number}) AS BIGINT) AS STRING)"


CLASSES = "A|B|C|E|S|CLA|GLC|GLE|SL|M|V|"
MODEL_SPELLINGS = (
    " A Class|B-Class|C Class|E-Klasse|S Class|GLC 220|ml350|CLA 200|GLE Class|SL 500|"
    "Mercedes-Benz E 220|AMG C63|200|230|V Class|Sprinter|e 350 cabrio"
)

SQL: dict[str, str] = {}

SQL["uk_raw"] = f"""
SELECT {_pick(MODEL_SPELLINGS, 'l.l_partkey')} AS model,
       CAST(1985 + (l.l_orderkey * 7 + l.l_linenumber * 3 + l.l_partkey) % 44 AS STRING) AS year,
       CASE WHEN l.l_suppkey % 37 = 0 THEN 'POA' ELSE {_text('l.l_extendedprice / 3')} END AS price,
       {_pick('Manual|Semi-Auto|Automatic|auto|Other|MANUAL 6|', 'l.l_linenumber')} AS transmission,
       {_text('l.l_quantity * 5000 + l.l_suppkey * 13')} AS mileage,
       {_pick('Petrol|Diesel|Hybrid|Electric|gas|06/2009|Diesel Hybrid|', 'l.l_suppkey')} AS `fuelType`,
       CAST(l.l_linenumber * 20 AS STRING) AS tax,
       '40.5' AS mpg,
       CASE WHEN l.l_partkey % 97 = 0 THEN '0'
            ELSE CAST(CAST(floor(p.p_size / 10) AS INT) AS STRING) || '.' || CAST(p.p_size % 10 AS STRING)
       END AS `engineSize`
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
WHERE l.l_returnflag = 'A'
"""

SQL["germany_raw"] = f"""
SELECT {_pick('Mercedes-Benz|mercedes-benz|Mercedes|bmw|audi', 'l.l_suppkey')} AS brand,
       {_pick(MODEL_SPELLINGS, 'l.l_partkey + l.l_linenumber')} AS model,
       CASE WHEN l.l_suppkey % 41 = 0 THEN '' ELSE CAST(1985 + (l.l_orderkey * 5 + l.l_partkey) % 44 AS STRING) END AS year,
       {_text('l.l_extendedprice / 2')} AS price_in_euro,
       {_pick('Manual|Semi-automatic|Automatic|Unknown', 'l.l_linenumber')} AS transmission_type,
       {_pick('Petrol|Diesel|Hybrid|Electric|06/2009|', 'l.l_suppkey + l.l_linenumber')} AS fuel_type,
       {_text('l.l_quantity * 7000 + l.l_partkey % 1000')} AS mileage_in_km
FROM {{lineitem}} l
WHERE l.l_returnflag = 'R'
"""

SQL["us_raw"] = f"""
SELECT {_pick('mercedes-benz|mercedes|ford|', 'l.l_suppkey')} AS manufacturer,
       {_pick(MODEL_SPELLINGS, 'l.l_partkey * 3 + l.l_linenumber')} AS model,
       CAST(1985 + (l.l_orderkey * 11 + l.l_partkey) % 44 AS STRING) AS year,
       CASE WHEN l.l_suppkey % 29 = 0 THEN '0' WHEN l.l_suppkey % 31 = 0 THEN '3736928711'
            ELSE {_text('l.l_extendedprice')} END AS price,
       CASE WHEN l.l_partkey % 13 = 0 THEN NULL ELSE {_text('l.l_quantity * 4000')} END AS odometer,
       {_pick('automatic|manual|other', 'l.l_linenumber')} AS transmission,
       {_pick('gas|diesel|hybrid|electric|other', 'l.l_suppkey')} AS fuel
FROM {{lineitem}} l
WHERE l.l_returnflag = 'N'
"""

SQL["spec_raw"] = f"""
SELECT p.p_name || ' ' || CAST(p.p_partkey AS STRING) AS `Model`,
       {_pick('A-Class|B-Class|C-Class|E-Class|S-Class|CLA-Class|GLC|GLE-Class|SL-Class|M-Class|Vito', 'p.p_partkey')} AS `Serie`,
       {_pick('Mercedes-Benz|MERCEDES BENZ|Mercedes|BMW', 'p.p_partkey + p.p_size')} AS `Company`,
       'Sedan' AS `Body style`,
       CASE WHEN p.p_partkey % 53 = 0 THEN 'n/a' ELSE
         CAST(1990 + p.p_partkey % 31 AS STRING) || ', ' || CAST(1991 + p.p_partkey % 31 AS STRING) || ', '
         || CAST(1990 + p.p_partkey % 31 + p.p_size % 7 AS STRING) END AS `Production years`,
       {_pick('L4|V6|V8|l3|', 'p.p_size')} AS `Cylinders`,
       CASE WHEN p.p_partkey % 19 = 0 THEN NULL ELSE CAST(p.p_size * 100 + 43 AS STRING) || ' cm3' END AS `Displacement`,
       '170 hp' AS `Power(HP)`,
       CASE WHEN p.p_partkey % 23 = 0 THEN NULL ELSE CAST(200 + p.p_size * 7 AS STRING) || ' Nm (x lb-ft)' END AS `Torque(Nm)`,
       {_pick('Turbocharged Common Rail|Supercharged|Compressor|Direct Injection|Electric motor|', 'p.p_partkey')} AS `Fuel System`,
       'Gasoline' AS `Fuel`,
       '140 mph (' || CAST(150 + p.p_size AS STRING) || ' km/h)' AS `Top Speed`,
       CASE WHEN p.p_partkey % 29 = 0 THEN '-' ELSE CAST(4 + p.p_size % 9 AS STRING) || '.' || CAST(p.p_partkey % 10 AS STRING) || ' s' END
         AS `Acceleration 0-62 Mph (0-100 kph)`,
       'RWD' AS `Drive Type`,
       {_pick('9-speed automatic|6-speed manual|7 Speed DCT|5-speed dual clutch|CVT|', 'p.p_partkey')} AS `Gearbox`,
       {_pick('Ventilated Discs|Discs|Drums|225/45 R17|Carbon Ceramic|', 'p.p_partkey')} AS `Front brake`,
       {_pick('Discs|Drums|vented disc|205/55 r16|', 'p.p_partkey')} AS `Rear brake`,
       CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE '6.5 cuFT (' || CAST(180 + p.p_size * 5 AS STRING) || ' L)' END AS `Cargo Volume`,
       p.p_partkey AS spec_pos
FROM {{part}} p
"""

SQL["listing"] = f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS row_key,
       l.l_partkey AS part_key, l.l_suppkey AS supp_key,
       {_pick(CLASSES, 'l.l_partkey')} AS model_class,
       CAST(1988 + (l.l_orderkey * 7 + l.l_linenumber * 3 + l.l_partkey) % 39 AS INT) AS year,
       CAST(floor(l.l_quantity * 6000 + l.l_suppkey * 13) AS DOUBLE) AS mileage,
       {_pick('Manual|Semi-Auto|Automatic|Other', 'l.l_linenumber')} AS transmission,
       {_pick('Petrol|Diesel|Hybrid|Electric|Other', 'l.l_suppkey')} AS fuel_type,
       CASE WHEN l.l_partkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p.p_size AS DOUBLE) / CAST(10 AS DOUBLE) END AS engine_size,
       CASE WHEN l.l_partkey % 7 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p.p_size AS DOUBLE) / CAST(10 AS DOUBLE) END AS engine_hint,
       CAST(floor(l.l_extendedprice * 2) AS BIGINT) AS price_rm,
       CASE l.l_returnflag WHEN 'A' THEN 'uk' WHEN 'R' THEN 'germany' ELSE 'us' END AS source_market,
       CAST(2026 - (1988 + (l.l_orderkey * 7 + l.l_linenumber * 3 + l.l_partkey) % 39) AS INT) AS age
FROM {{lineitem}} l JOIN {{part}} p ON l.l_partkey = p.p_partkey
"""

SQL["spec"] = f"""
SELECT p.p_partkey AS spec_pos,
       p.p_name || ' ' || CAST(p.p_partkey AS STRING) AS variant,
       {_pick('A|B|C|E|S|CLA|GLC|GLE|SL|GLS', 'p.p_partkey')} AS model_class,
       CAST(1990 + p.p_partkey % 31 AS INT) AS year_min,
       CAST(1990 + p.p_partkey % 31 + p.p_size % 7 AS INT) AS year_max,
       CASE WHEN p.p_partkey % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p.p_size * 100 + 43 AS DOUBLE) END AS displacement_cc,
       CASE WHEN p.p_partkey % 19 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(p.p_size * 100 + 43 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS displacement_l,
       CAST(3 + p.p_size % 6 AS DOUBLE) AS n_cylinders,
       CASE WHEN p.p_partkey % 31 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(5 + p.p_size % 5 AS DOUBLE) END AS n_gears,
       CAST(150 + p.p_size AS DOUBLE) AS top_speed_kmh,
       CASE WHEN p.p_partkey % 43 = 0 THEN CAST(320440 AS DOUBLE) WHEN p.p_partkey % 23 = 0 THEN CAST(NULL AS DOUBLE)
            ELSE CAST(200 + p.p_size * 7 AS DOUBLE) END AS torque_nm,
       CAST(4 + p.p_size % 9 AS DOUBLE) AS accel_0_100_s,
       CASE WHEN p.p_partkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(180 + p.p_size * 5 AS DOUBLE) END AS boot_l,
       {_pick('L4|V6|V8|L3', 'p.p_size')} AS engine_config,
       {_pick('turbo|supercharged|naturally_aspirated', 'p.p_partkey')} AS aspiration,
       {_pick('automatic|manual|dct', 'p.p_partkey')} AS gear_type,
       {_pick('Ventilated Discs|Discs|Drums|Ceramic|Unknown', 'p.p_partkey')} AS front_brake,
       {_pick('Discs|Drums|Ventilated Discs|Unknown', 'p.p_partkey')} AS rear_brake
FROM {{part}} p
"""

SQL["market_listing"] = f"""
SELECT l.l_orderkey * 10 + l.l_linenumber AS listing_id,
       CASE WHEN l.l_linenumber % 2 = 0 THEN 'classifieds' ELSE 'dealers' END AS source,
       'https://cars.example/' || CAST(l.l_orderkey AS STRING) || '-' || CAST(l.l_partkey AS STRING) || '-'
         || CAST(l.l_suppkey AS STRING) || '-' || CAST(l.l_linenumber AS STRING) || '.htm' AS listing_url,
       {_pick(CLASSES, 'l.l_partkey')} || '_CLASS' AS model,
       CASE WHEN l.l_partkey % 6 = 0 THEN NULL ELSE 'C' || CAST(100 + l.l_partkey % 20 * 10 AS STRING) END AS variant,
       CAST(1988 + (l.l_orderkey * 7 + l.l_linenumber * 3 + l.l_partkey) % 39 AS INT) AS year,
       CAST(floor(l.l_extendedprice * 2) AS BIGINT) AS price_rm,
       CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE CAST(floor(l.l_quantity * 6000) AS BIGINT) END AS mileage,
       {_pick('Manual|Automatic|Semi-Auto|', 'l.l_linenumber')} AS transmission,
       {_pick('Petrol|Diesel|', 'l.l_suppkey')} AS fuel_type,
       {_pick('Kuala Lumpur|Selangor - Puncak Alam|', 'l.l_suppkey')} AS location,
       {_pick('dealer|private|unknown', 'l.l_partkey')} AS seller_type,
       CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS posted_at,
       l.l_shipdate AS scraped_at
FROM {{lineitem}} l
"""

SQL["subject"] = f"""
SELECT o.o_orderkey AS subject_id,
       {_pick('A|B|C|E|S|CLA|GLC|GLE|SL|M|V|ZZ', 'o.o_custkey')} || '_CLASS' AS model,
       CASE WHEN o.o_orderkey % 101 = 0 THEN CAST(NULL AS INT) ELSE CAST(1986 + (o.o_orderkey * 3 + o.o_custkey) % 50 AS INT) END AS year,
       CASE WHEN o.o_orderkey % 17 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS predicted_rm
FROM {{orders}} o
"""

SQL["profile"] = f"""
SELECT o.o_orderkey AS profile_id,
       {_pick('A Class|B-Class|C Class|E-Klasse|S Class|CLA|GLC|GLE|SL|Coupe', 'o.o_custkey')} AS model,
       CAST(1995 + (o.o_orderkey * 3 + o.o_custkey) % 32 AS INT) AS year,
       CAST(2026 - (1995 + (o.o_orderkey * 3 + o.o_custkey) % 32) AS INT) AS age,
       CAST(o.o_custkey % 300 * 1000 + o.o_orderkey % 1000 AS DOUBLE) AS mileage,
       {_pick('Manual|Semi-Auto|Automatic|Other', 'o.o_orderkey')} AS transmission,
       {_pick('Petrol|Diesel|Hybrid|Electric', 'o.o_custkey')} AS fuel_type,
       CASE WHEN o.o_orderkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(10 + o.o_orderkey % 40 AS DOUBLE) / CAST(10 AS DOUBLE) END AS engine_size,
       CASE WHEN o.o_orderkey % 9 = 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(o.o_totalprice) AS BIGINT) END AS original_purchase_price_rm,
       CAST(floor(o.o_totalprice * 2 / 3) AS BIGINT) AS predicted_rm,
       CAST(o.o_orderkey % 12 AS INT) AS services_done,
       CAST(o.o_custkey % 12 AS INT) AS services_due
FROM {{orders}} o
"""


def _needs(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", SQL[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in (or a given table) as a DataFrame."""
    if name not in SQL:
        return table(spark, sf_dir, name)
    parts = {n: frame(spark, sf_dir, n) for n in set(_needs(name))}
    return spark.sql(SQL[name], **parts)


def ctes(*names: str) -> str:
    """``WITH`` clause defining the stand-ins for the comparison database."""
    done: list[str] = []
    bodies: list[str] = []

    def add(name: str) -> None:
        if name in done or name not in SQL:
            return
        for n in _needs(name):
            add(n)
        done.append(name)
        body = SQL[name].replace("`", '"')
        bodies.append(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', body)})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(bodies)
