"""Queries: pooling, cleaning, spec matching, upsert, comparables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.config import LISTING_KEY, SPEC_CATEGORICAL, SPEC_NUMERIC
from motoquant.operators import comps as C
from motoquant.operators import harmonise as H
from motoquant.operators import match as M
from motoquant.operators import upsert as U
from motoquant.plans.sqltext import badge, canonical_class, fuel, r_even, rint, to_num, transmission
from motoquant.plans.standins import ctes, frame
from motoquant.sources.buckets import BucketTable
from motoquant.sources.tables import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# --- harmonise -------------------------------------------------------------------------------


def _uk(spark: SparkSession, d: str) -> DataFrame:
    return H.harmonise_uk(frame(spark, d, "uk_raw"))


def _germany(spark: SparkSession, d: str) -> DataFrame:
    return H.harmonise_germany(frame(spark, d, "germany_raw"))


def _us(spark: SparkSession, d: str) -> DataFrame:
    return H.harmonise_us(frame(spark, d, "us_raw"))


def _hint(df: DataFrame) -> DataFrame:
    return df.withColumn("engine_hint", F.round("engine_hint", 1))


UK_SQL = f"""SELECT {canonical_class('model')} AS model_class, {to_num('year')} AS year,
  {to_num('mileage')} * CAST(1.60934 AS DOUBLE) AS mileage,
  {transmission('transmission')} AS transmission, {fuel('"fuelType"')} AS fuel_type,
  {to_num('"engineSize"')} AS engine_size, {to_num('"engineSize"')} AS engine_hint,
  {to_num('price')} * CAST(5.90 AS DOUBLE) AS price_rm, 'uk' AS source_market FROM uk_raw"""
GERMANY_SQL = f"""SELECT {canonical_class('model')} AS model_class, {to_num('year')} AS year,
  {to_num('mileage_in_km')} AS mileage,
  {transmission('transmission_type')} AS transmission, {fuel('fuel_type')} AS fuel_type,
  CAST(NULL AS DOUBLE) AS engine_size, {badge('model')} AS engine_hint,
  {to_num('price_in_euro')} * CAST(5.05 AS DOUBLE) AS price_rm, 'germany' AS source_market
  FROM germany_raw WHERE lower(brand) LIKE '%mercedes%'"""
US_SQL = f"""SELECT {canonical_class('model')} AS model_class, {to_num('year')} AS year,
  {to_num('odometer')} * CAST(1.60934 AS DOUBLE) AS mileage,
  {transmission('transmission')} AS transmission, {fuel('fuel')} AS fuel_type,
  CAST(NULL AS DOUBLE) AS engine_size, {badge('model')} AS engine_hint,
  {to_num('price')} * CAST(4.70 AS DOUBLE) AS price_rm, 'us' AS source_market
  FROM us_raw WHERE lower(manufacturer) LIKE '%mercedes%'"""

QUERIES["r35_harmonise_uk"] = _uk
ORACLES["r35_harmonise_uk"] = f"{ctes('uk_raw')} {UK_SQL}"
QUERIES["r35_harmonise_germany"] = _germany
ORACLES["r35_harmonise_germany"] = f"{ctes('germany_raw')} {GERMANY_SQL}"
QUERIES["r35_harmonise_us"] = _us
ORACLES["r35_harmonise_us"] = f"{ctes('us_raw')} {US_SQL}"

POOL_CTES = f"""{ctes('uk_raw', 'germany_raw', 'us_raw')},
uk AS ({UK_SQL}), germany AS ({GERMANY_SQL}), us AS ({US_SQL})"""


def _pool(spark: SparkSession, d: str, include_us: bool = True) -> DataFrame:
    return H.pool(_uk(spark, d), _germany(spark, d), _us(spark, d), include_us)


QUERIES["r36_pool"] = lambda spark, d: _pool(spark, d).groupBy("source_market").agg(
    F.count(F.lit(1)).alias("n_rows"), F.count("model_class").alias("n_classed")
)
ORACLES["r36_pool"] = f"""{POOL_CTES}
SELECT source_market, count(*) AS n_rows, count(model_class) AS n_classed FROM
(SELECT * FROM uk UNION ALL SELECT * FROM germany UNION ALL SELECT * FROM us) GROUP BY source_market"""

CLEAN_SQL = f"""SELECT DISTINCT model_class, CAST(year AS INTEGER) AS year, mileage, transmission, fuel_type,
  engine_size, engine_hint, CAST({rint('price_rm')} AS BIGINT) AS price_rm, source_market,
  CAST(2026 - year AS INTEGER) AS age
FROM (SELECT * FROM uk UNION ALL SELECT * FROM germany)
WHERE model_class IS NOT NULL AND year BETWEEN 1990 AND 2026 AND mileage BETWEEN 0 AND 500000
  AND price_rm BETWEEN 3000 AND 2000000"""


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return H.clean_pool(_pool(spark, d, include_us=False))


QUERIES["r37_clean_pool"] = _clean
ORACLES["r37_clean_pool"] = f"{POOL_CTES} {CLEAN_SQL}"

SPEC_COLUMNS = [
    "spec_pos", "variant", "model_class", "year_min", "year_max", "displacement_cc",
    "displacement_l", "n_cylinders", "n_gears", "top_speed_kmh", "torque_nm", "accel_0_100_s",
    "boot_l", "engine_config", "aspiration", "gear_type", "front_brake", "rear_brake",
]


def _specs_from_raw(spark: SparkSession, d: str) -> DataFrame:
    return H.clean_specs(frame(spark, d, "spec_raw")).select(*SPEC_COLUMNS)


def _num(col: str, pattern: str) -> str:
    return f"CAST(nullif(regexp_extract(\"{col}\", '{pattern}', 1), '') AS DOUBLE)"


def _brake(col: str) -> str:
    c = f'lower("{col}")'
    return f"""CASE WHEN {c} IS NULL OR regexp_matches({c}, '\\d+/\\d+\\s*r\\d+') THEN 'Unknown'
      WHEN {c} LIKE '%ceramic%' THEN 'Ceramic' WHEN {c} LIKE '%drum%' THEN 'Drums'
      WHEN {c} LIKE '%vent%' AND {c} LIKE '%disc%' THEN 'Ventilated Discs'
      WHEN {c} LIKE '%disc%' THEN 'Discs' ELSE 'Unknown' END"""


SPECS_SQL = f"""SELECT spec_pos, trim("Model") AS variant, {canonical_class('"Serie"')} AS model_class,
  list_min(list_transform(regexp_extract_all("Production years", '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER))) AS year_min,
  list_max(list_transform(regexp_extract_all("Production years", '\\b((?:19|20)\\d{{2}})\\b', 1), lambda y: CAST(y AS INTEGER))) AS year_max,
  {_num('Displacement', '(\\d+)\\s*cm3')} AS displacement_cc,
  {_num('Displacement', '(\\d+)\\s*cm3')} / CAST(1000 AS DOUBLE) AS displacement_l,
  {_num('Cylinders', '(\\d+)')} AS n_cylinders, {_num('Gearbox', '(\\d+)[- ]?[Ss]peed')} AS n_gears,
  {_num('Top Speed', '\\((\\d+)\\s*km/h\\)')} AS top_speed_kmh, {_num('Torque(Nm)', '(\\d+)\\s*Nm')} AS torque_nm,
  {_num('Acceleration 0-62 Mph (0-100 kph)', '(\\d+(?:\\.\\d+)?)\\s*s')} AS accel_0_100_s,
  {_num('Cargo Volume', '\\((\\d+)\\s*L\\)')} AS boot_l,
  coalesce(upper(trim("Cylinders")), 'Unknown') AS engine_config,
  CASE WHEN "Fuel System" IS NULL THEN 'Unknown' WHEN lower("Fuel System") LIKE '%turbo%' THEN 'turbo'
    WHEN lower("Fuel System") LIKE '%supercharg%' OR lower("Fuel System") LIKE '%compressor%' THEN 'supercharged'
    WHEN lower("Fuel System") LIKE '%electric%' THEN 'electric' ELSE 'naturally_aspirated' END AS aspiration,
  CASE WHEN "Gearbox" IS NULL THEN 'Unknown' WHEN lower("Gearbox") LIKE '%manual%' AND lower("Gearbox") NOT LIKE '%auto%' THEN 'manual'
    WHEN lower("Gearbox") LIKE '%dct%' OR lower("Gearbox") LIKE '%dual%' THEN 'dct'
    WHEN lower("Gearbox") LIKE '%auto%' THEN 'automatic' ELSE 'Unknown' END AS gear_type,
  {_brake('Front brake')} AS front_brake, {_brake('Rear brake')} AS rear_brake
FROM spec_raw WHERE lower("Company") LIKE '%mercedes%'"""
CLEAN_SPECS_SQL = f"SELECT * FROM ({SPECS_SQL}) WHERE model_class IS NOT NULL AND year_min IS NOT NULL"

QUERIES["r38_clean_specs"] = _specs_from_raw
ORACLES["r38_clean_specs"] = f"{ctes('spec_raw')} {CLEAN_SPECS_SQL}"

# --- nearest-spec join -----------------------------------------------------------------------

LISTING_FIELDS = [
    "row_key", "part_key", "supp_key", "model_class", "year", "mileage", "transmission", "fuel_type",
    "engine_size", "engine_hint", "price_rm", "source_market", "age",
]


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return M.enrich(frame(spark, d, "listing"), frame(spark, d, "spec"))


# independent form: rank the candidates of every distinct (class, year, hint)
NEAREST_CTES = f"""{ctes('listing', 'spec')},
keys AS (SELECT DISTINCT model_class, year, engine_hint FROM listing),
pairs AS (SELECT k.*, s.spec_pos, s.displacement_l, (k.year BETWEEN s.year_min AND s.year_max) AS in_year
  FROM keys k JOIN spec s ON k.model_class = s.model_class),
tiers AS (SELECT *, bool_or(in_year) OVER (PARTITION BY model_class, year, engine_hint) AS any_in FROM pairs),
kept AS (SELECT *, coalesce(engine_hint, median(displacement_l) OVER (PARTITION BY model_class, year, engine_hint)) AS target
  FROM tiers WHERE in_year OR NOT any_in),
picked AS (SELECT *, row_number() OVER (PARTITION BY model_class, year, engine_hint
  ORDER BY abs(displacement_l - target) ASC NULLS LAST, spec_pos) AS rn FROM kept),
matched AS (SELECT l.*, p.spec_pos,
  CASE WHEN p.spec_pos IS NULL THEN 'none' WHEN NOT p.any_in THEN 'class_repr'
       WHEN l.engine_hint IS NOT NULL THEN 'displacement' ELSE 'year_repr' END AS match_level
  FROM listing l LEFT JOIN (SELECT * FROM picked WHERE rn = 1) p
  ON l.model_class = p.model_class AND l.year = p.year AND l.engine_hint IS NOT DISTINCT FROM p.engine_hint),
enriched AS (SELECT {', '.join('m.' + c for c in LISTING_FIELDS if c not in ('engine_size', 'engine_hint'))},
  coalesce(m.engine_size, s.displacement_cc / CAST(1000 AS DOUBLE)) AS engine_size, s.variant,
  {', '.join('s.' + c for c in SPEC_NUMERIC)},
  {', '.join(f"CASE WHEN m.spec_pos IS NULL THEN 'Unknown' ELSE s.{c} END AS {c}" for c in SPEC_CATEGORICAL)},
  m.spec_pos IS NOT NULL AS spec_matched, m.match_level
  FROM matched m LEFT JOIN spec s ON m.spec_pos = s.spec_pos)"""

QUERIES["r39_nearest_spec"] = enriched
ORACLES["r39_nearest_spec"] = f"{NEAREST_CTES} SELECT * FROM enriched"

QUERIES["r40_engine_backfill"] = lambda spark, d: H.backfill_engine_size(
    M.nearest_spec(frame(spark, d, "listing"), frame(spark, d, "spec")).withColumn(
        "engine_size", F.when(F.col("part_key") % 3 == 0, 0.0).otherwise(F.col("engine_size"))
    )
).groupBy("engine_size").agg(F.count(F.lit(1)).alias("n"))
ORACLES["r40_engine_backfill"] = f"""{NEAREST_CTES},
zeroed AS (SELECT CASE WHEN m.part_key % 3 = 0 THEN CAST(0 AS DOUBLE) ELSE m.engine_size END AS es, s.displacement_cc
  FROM matched m LEFT JOIN spec s ON m.spec_pos = s.spec_pos)
SELECT CASE WHEN es = 0 THEN {r_even('displacement_cc / CAST(1000 AS DOUBLE)', 1)}
  ELSE coalesce(es, displacement_cc / CAST(1000 AS DOUBLE)) END AS engine_size, count(*) AS n FROM zeroed GROUP BY 1"""

QUERIES["r41_match_quality"] = lambda spark, d: M.match_quality(enriched(spark, d)).withColumnRenamed(
    "none", "no_match"
)
ORACLES["r41_match_quality"] = f"""{NEAREST_CTES}
SELECT source_market, count(*) FILTER (WHERE match_level = 'displacement') AS displacement,
  count(*) FILTER (WHERE match_level = 'year_repr') AS year_repr,
  count(*) FILTER (WHERE match_level = 'class_repr') AS class_repr,
  count(*) FILTER (WHERE match_level = 'none') AS no_match FROM enriched GROUP BY 1"""

QUERIES["r42_mapping_coverage"] = lambda spark, d: M.mapping_coverage(
    frame(spark, d, "listing"), frame(spark, d, "spec")
).select(
    "source_market", "n_rows",
    *[(F.rint(F.col(c) * 1e6) / 1e6).alias(c) for c in ("parsed_share", "in_specs_share")],
)
ORACLES["r42_mapping_coverage"] = f"""{ctes('listing', 'spec')}
SELECT source_market, count(*) AS n_rows,
  {r_even('count(model_class) / CAST(count(*) AS DOUBLE)', 6)} AS parsed_share,
  {r_even('count(*) FILTER (WHERE model_class IN (SELECT model_class FROM spec)) / CAST(count(*) AS DOUBLE)', 6)} AS in_specs_share
FROM listing GROUP BY 1"""


def _named_listings(spark: SparkSession, d: str) -> DataFrame:
    part = frame(spark, d, "part").select(F.col("p_partkey").alias("part_key"), "p_name")
    return frame(spark, d, "listing").join(part, "part_key").withColumn(
        "variant",
        F.when(F.col("supp_key") % 3 != 0, F.concat_ws(" ", "p_name", F.col("part_key").cast("string"))),
    ).drop("p_name")


QUERIES["r43_spec_confidence"] = lambda spark, d: M.spec_confidence(
    _named_listings(spark, d), frame(spark, d, "spec")
).select("row_key", "part_key", "supp_key", "year", "spec_pos", "confidence")
ORACLES["r43_spec_confidence"] = f"""{ctes('listing', 'spec')},
named AS (SELECT l.*, CASE WHEN supp_key % 3 <> 0 THEN p.p_name || ' ' || CAST(part_key AS VARCHAR) END AS variant
  FROM listing l JOIN part p ON l.part_key = p.p_partkey)
SELECT n.row_key, n.part_key, n.supp_key, n.year, s.spec_pos,
  CASE WHEN s.spec_pos IS NULL THEN 'unmatched' WHEN n.year BETWEEN s.year_min AND s.year_max THEN 'exact'
       ELSE 'partial' END AS confidence
FROM named n LEFT JOIN spec s ON n.model_class = s.model_class AND n.variant = s.variant"""

# --- cleaning ledger -------------------------------------------------------------------------


def _processed_input(spark: SparkSession, d: str) -> DataFrame:
    return enriched(spark, d).withColumn(
        "engine_size", F.when(F.col("part_key") % 11 == 0, 0.0).otherwise(F.col("engine_size"))
    )


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    df = _processed_input(spark, d)
    out = H.clean_processed(df, order=["row_key", "part_key", "supp_key"])
    return out.select(*LISTING_KEY, "row_key", "variant", "torque_nm", "n_gears", "boot_l")


LEDGER_CTES = f"""{NEAREST_CTES},
loaded AS (SELECT * REPLACE (CASE WHEN part_key % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE engine_size END AS engine_size) FROM enriched),
uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(LISTING_KEY)}
  ORDER BY row_key, part_key, supp_key) AS rn FROM loaded) WHERE rn = 1),
fixed AS (SELECT * REPLACE (CASE WHEN engine_size = 0 THEN {r_even('displacement_cc / CAST(1000 AS DOUBLE)', 1)} ELSE engine_size END AS engine_size,
  CASE WHEN torque_nm > 2000 THEN NULL ELSE torque_nm END AS torque_nm) FROM uniq),
complete AS (SELECT * FROM fixed WHERE n_gears IS NOT NULL AND top_speed_kmh IS NOT NULL AND torque_nm IS NOT NULL
  AND accel_0_100_s IS NOT NULL AND boot_l IS NOT NULL)"""
QUERIES["r58_clean_processed"] = _repaired
ORACLES["r58_clean_processed"] = f"""{LEDGER_CTES}
SELECT {', '.join(LISTING_KEY)}, row_key, variant, torque_nm, n_gears, boot_l FROM complete"""
QUERIES["r58_cleaning_ledger"] = lambda spark, d: H.cleaning_ledger(_processed_input(spark, d))
ORACLES["r58_cleaning_ledger"] = f"""{LEDGER_CTES}
SELECT '1 loaded' AS step, CAST(0 AS BIGINT) AS rows_touched, count(*) AS rows_left FROM loaded
UNION ALL SELECT '2 drop duplicate listings', (SELECT count(*) FROM loaded) - count(*), count(*) FROM uniq
UNION ALL SELECT '3 backfill zero engine_size', count(*) FILTER (WHERE engine_size = 0), count(*) FROM uniq
UNION ALL SELECT '4 null broken torque_nm', count(*) FILTER (WHERE torque_nm > 2000), count(*) FROM uniq
UNION ALL SELECT '5 drop incomplete specs', (SELECT count(*) FROM uniq) - count(*), count(*) FROM complete"""

# --- upsert, unions, summaries ---------------------------------------------------------------


def _state_and_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """State: first listing per URL stem. Batch: every listing of the newer half, keys repeating."""
    m = frame(spark, d, "market_listing").withColumn(
        "listing_url", F.concat(F.lit("https://cars.example/"), (F.col("listing_id") % 40000).cast("string"))
    )
    old = m.filter(F.col("scraped_at") < F.lit("1998-06-01").cast("timestamp_ntz"))
    new = m.filter(F.col("scraped_at") >= F.lit("1998-06-01").cast("timestamp_ntz"))
    order = ["scraped_at", "listing_id", "price_rm", "posted_at"]
    return U.latest_per_key(old, ["listing_url"], order), new


UPSERT_ORDER = ["scraped_at", "listing_id", "price_rm"]
QUERIES["r17_upsert"] = lambda spark, d: (
    lambda sb: U.upsert(sb[0], sb[1], order=UPSERT_ORDER).select(
        "listing_url", "source", "model", "year", "price_rm", "mileage", "scraped_at"
    )
)(_state_and_batch(spark, d))
ORACLES["r17_upsert"] = f"""{ctes('market_listing')},
m AS (SELECT * REPLACE ('https://cars.example/' || CAST(listing_id % 40000 AS VARCHAR) AS listing_url) FROM market_listing),
ranked AS (SELECT *, scraped_at < TIMESTAMP '1998-06-01' AS old, row_number() OVER
  (PARTITION BY listing_url, scraped_at < TIMESTAMP '1998-06-01'
   ORDER BY scraped_at DESC, listing_id DESC, price_rm DESC, posted_at DESC) AS rn FROM m),
s AS (SELECT * FROM ranked WHERE old AND rn = 1), b AS (SELECT * FROM ranked WHERE NOT old AND rn = 1)
SELECT coalesce(s.listing_url, b.listing_url) AS listing_url, coalesce(s.source, b.source) AS source,
  CASE WHEN b.listing_url IS NOT NULL THEN b.model ELSE s.model END AS model,
  CASE WHEN b.listing_url IS NOT NULL THEN b.year ELSE s.year END AS year,
  CASE WHEN b.listing_url IS NOT NULL THEN b.price_rm ELSE s.price_rm END AS price_rm,
  CASE WHEN b.listing_url IS NOT NULL THEN b.mileage ELSE s.mileage END AS mileage,
  CASE WHEN b.listing_url IS NOT NULL THEN b.scraped_at ELSE s.scraped_at END AS scraped_at
FROM s FULL OUTER JOIN b ON s.listing_url = b.listing_url"""



def _upsert_buckets(spark: SparkSession, d: str) -> DataFrame:
    """State and batch as two versions of a bucketed table."""
    state, batch = _state_and_batch(spark, d)
    table = BucketTable(spark, shared_dir(spark, "listings"), "listing_url", state.schema)
    for version, rows in enumerate((state, batch)):
        U.upsert_buckets(table, rows, version, UPSERT_ORDER)
    return table.read().select("listing_url", "source", "model", "year", "price_rm", "mileage", "scraped_at")


QUERIES["r17_upsert_buckets"] = _upsert_buckets
ORACLES["r17_upsert_buckets"] = ORACLES["r17_upsert"]

LISTING_CAP = 40_000  # more than the first source has at the smaller scales, so that the second fills up
CAP_ORDER = ["listing_id", "listing_url", "price_rm", "posted_at"]
QUERIES["r44_capped_union"] = lambda spark, d: U.capped_union(
    frame(spark, d, "market_listing").filter("source = 'classifieds'"),
    frame(spark, d, "market_listing").filter("source = 'dealers'"),
    LISTING_CAP, CAP_ORDER,
).select("source", "listing_id", "listing_url", "price_rm")
ORACLES["r44_capped_union"] = f"""{ctes('market_listing')}
SELECT source, listing_id, listing_url, price_rm FROM (
  SELECT *, CASE WHEN source = 'classifieds' THEN 0 ELSE 1 END AS pr FROM market_listing)
ORDER BY pr, listing_id, listing_url, price_rm, posted_at LIMIT {LISTING_CAP}"""


def _outcomes(df: DataFrame) -> DataFrame:
    return df.select(
        "source",
        F.when(F.col("model").isNull(), "unparseable")
        .when(F.col("seller_type") == "unknown", "other_brand")
        .otherwise("kept").alias("outcome"),
    )


def _read_pages(spark: SparkSession, d: str) -> DataFrame:
    """Stored pages of three sources, some of them bad and all of the auctions' bad."""
    k = F.col("page_id")
    source = F.when(k % 7 == 0, "auctions").when(k % 2 == 0, "classifieds").otherwise("dealers")
    status = F.when(k % 7 == 0, F.when(k % 2 == 0, "challenge").otherwise("empty")).when(k % 5 == 0, "server_error").otherwise("ok")
    return frame(spark, d, "pages").select(source.alias("source"), status.alias("status"))


QUERIES["r45_run_summary"] = lambda spark, d: U.run_summary(
    _outcomes(frame(spark, d, "market_listing")),
    frame(spark, d, "market_listing").filter("model is not null and seller_type <> 'unknown' and listing_id % 3 <> 0"),
    _read_pages(spark, d), ["classifieds", "dealers", "private"],
)
ORACLES["r45_run_summary"] = f"""{ctes('market_listing')},
t AS (SELECT *, model IS NOT NULL AND seller_type <> 'unknown' AS kept FROM market_listing),
w AS (SELECT *, kept AND listing_id % 3 <> 0 AS written FROM t),
p AS (SELECT CASE WHEN page_id % 7 = 0 THEN 'auctions' WHEN page_id % 2 = 0 THEN 'classifieds' ELSE 'dealers' END AS source,
  page_id % 7 = 0 OR page_id % 5 = 0 AS bad FROM pages),
b AS (SELECT source, count(*) FILTER (WHERE bad) AS bad_pages, count(*) FILTER (WHERE NOT bad) AS good FROM p GROUP BY 1),
n AS (SELECT unnest(['auctions', 'classifieds', 'dealers', 'private']) AS source)
SELECT n.source, CASE WHEN n.source = 'auctions' THEN 'fetch_failed' ELSE 'ok' END AS status,
  CASE WHEN n.source = 'auctions' THEN 'challenge, empty' ELSE '' END AS error,
  count(w.source) AS fetched, count(*) FILTER (WHERE NOT kept) AS skipped,
  count(*) FILTER (WHERE written) AS stored, count(*) FILTER (WHERE kept AND NOT written) AS capped,
  coalesce(any_value(b.bad_pages), 0) AS bad_pages,
  count(*) FILTER (WHERE written AND transmission IS NULL) AS missing_transmission,
  count(*) FILTER (WHERE written AND fuel_type IS NULL) AS missing_fuel_type,
  count(*) FILTER (WHERE written AND mileage IS NULL) AS missing_mileage,
  (SELECT count(*) FROM w WHERE written) AS total_stored
FROM n LEFT JOIN w ON w.source = n.source LEFT JOIN b ON b.source = n.source GROUP BY n.source"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as diagnostic files, each with one layer per ordered part group."""
    l = frame(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber").distinct()
    s = l.filter(F.col("l_suppkey") % 5 == 0)
    formal = l.filter(F.col("l_suppkey") % 5 != 0)
    blank = F.lit(None).cast("string")
    code = F.when(F.col("l_partkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("P"), F.col("l_partkey")))
    dtc = F.struct(
        code.alias("trouble_code"), F.concat(F.lit("DTC_"), F.col("l_partkey")).alias("short_name"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("C"), F.col("l_partkey"))).otherwise(blank).alias("display_code"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit("text")).otherwise(blank).alias("text"),
    )
    svc = F.struct(
        F.when(F.col("l_linenumber") == 3, "report_status").otherwise("other").alias("short_name"),
        F.array(F.concat(F.lit("resp_"), F.col("l_linenumber"))).alias("responses"),
    )
    key = [
        F.concat(F.lit("file"), F.col("l_suppkey")).alias("source_file"),
        F.concat(F.lit("layer"), F.lpad((F.col("l_partkey")).cast("string"), 9, "0"), F.col("l_linenumber")).alias("layer"),
    ]
    none_d = F.array().cast("array<struct<trouble_code:string,short_name:string,display_code:string,text:string>>")
    none_s = F.array().cast("array<struct<short_name:string,responses:array<string>>>")
    return formal.select(*key, F.array(dtc).alias("dtcs"), none_s.alias("services")).unionByName(
        s.select(*key, none_d.alias("dtcs"), F.array(svc).alias("services"))
    )


QUERIES["r46_fault_codes"] = lambda spark, d: U.fault_codes(_layers(spark, d)).select(
    "source_file", "code", "description", "severity", "system"
)
ORACLES["r46_fault_codes"] = """
WITH l AS (SELECT DISTINCT l_suppkey, l_partkey, l_linenumber FROM lineitem),
k AS (SELECT *, 'file' || CAST(l_suppkey AS VARCHAR) AS source_file,
  'layer' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') || CAST(l_linenumber AS VARCHAR) AS layer FROM l)
SELECT source_file, CASE WHEN l_partkey % 3 = 0 THEN 'DTC_' || CAST(l_partkey AS VARCHAR) ELSE 'P' || CAST(l_partkey AS VARCHAR) END AS code,
  CASE WHEN l_partkey % 2 = 0 THEN 'C' || CAST(l_partkey AS VARCHAR) WHEN l_partkey % 7 = 0 THEN 'text'
       ELSE 'DTC_' || CAST(l_partkey AS VARCHAR) END AS description, 'warn' AS severity, layer AS system
FROM k WHERE l_suppkey % 5 <> 0
UNION ALL
SELECT source_file, 'ODX-REPORT-STATUS', 'ODX diagnostic service exposes resp_3', 'info', min(layer)
FROM k WHERE l_suppkey % 5 = 0 AND l_linenumber = 3 GROUP BY source_file"""

def _fault_state(spark: SparkSession, d: str) -> DataFrame:
    """Stored codes: every part whose key is even, once."""
    return frame(spark, d, "part").filter("p_partkey % 2 = 0").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("code"), F.lit("stored").alias("description"),
        F.lit("old").alias("severity"), F.lit("old").alias("system"),
    )


QUERIES["r46_upsert_fault_codes"] = lambda spark, d: U.upsert_fault_codes(
    _fault_state(spark, d), U.fault_codes(_layers(spark, d))
).select("code", "description", "severity", "system")
ORACLES["r46_upsert_fault_codes"] = f"""
WITH f AS ({ORACLES['r46_fault_codes']}),
b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY source_file DESC, system DESC) AS rn FROM f),
s AS (SELECT 'P' || CAST(p_partkey AS VARCHAR) AS code FROM part WHERE p_partkey % 2 = 0)
SELECT code, description, severity, system FROM b WHERE rn = 1
UNION ALL SELECT code, 'stored', 'old', 'old' FROM s WHERE code NOT IN (SELECT code FROM b)"""

# --- comparables -----------------------------------------------------------------------------

COMPS_CTES = f"""{ctes('subject', 'market_listing')},
keys AS (SELECT DISTINCT model, year FROM subject),
tight AS (SELECT k.model AS km, k.year AS ky, m.*, row_number() OVER (PARTITION BY k.model, k.year
    ORDER BY m.year DESC, m.price_rm, m.listing_url, m.listing_id) AS rn
  FROM keys k JOIN market_listing m ON k.model = m.model AND (k.year IS NULL OR m.year BETWEEN k.year - 2 AND k.year + 2)),
wide AS (SELECT k.model AS km, k.year AS ky, m.*, row_number() OVER (PARTITION BY k.model, k.year
    ORDER BY m.year DESC, m.price_rm, m.listing_url, m.listing_id) AS rn
  FROM keys k JOIN market_listing m ON k.model = m.model AND m.year BETWEEN k.year - 5 AND k.year + 5),
enough AS (SELECT km, ky, count(*) AS c FROM tight WHERE rn <= 20 GROUP BY 1, 2),
kept AS (SELECT t.*, 2 AS year_window FROM tight t JOIN enough e ON t.km = e.km AND t.ky IS NOT DISTINCT FROM e.ky
    WHERE t.rn <= 20 AND (e.c >= 3 OR t.ky IS NULL)
  UNION ALL
  SELECT w.*, 5 AS year_window FROM wide w LEFT JOIN enough e ON w.km = e.km AND w.ky = e.ky
    WHERE w.rn <= 20 AND coalesce(e.c, 0) < 3)"""

QUERIES["r47_comps"] = lambda spark, d: C.comps(
    frame(spark, d, "subject"), frame(spark, d, "market_listing")
).select("subject_id", "model", "year", "comp_rank", "comp_year", "price_rm", "listing_url", "year_window")
ORACLES["r47_comps"] = f"""{COMPS_CTES}
SELECT s.subject_id, s.model, s.year, CAST(k.rn AS INTEGER) AS comp_rank, k.year AS comp_year, k.price_rm, k.listing_url, k.year_window
FROM subject s JOIN kept k ON s.model = k.km AND s.year IS NOT DISTINCT FROM k.ky"""

QUERIES["r48_comps_summary"] = lambda spark, d: C.comps_summary(
    frame(spark, d, "subject"), frame(spark, d, "market_listing")
)
ORACLES["r48_comps_summary"] = f"""{COMPS_CTES},
med AS (SELECT km, ky, count(*) AS n, CAST({rint('CAST(median(price_rm) AS DOUBLE)')} AS BIGINT) AS median_rm FROM kept GROUP BY 1, 2)
SELECT s.subject_id, s.model, s.year, coalesce(m.n, 0) AS n, m.median_rm,
  CASE WHEN m.median_rm > 0 THEN {r_even('(s.predicted_rm - m.median_rm) / CAST(m.median_rm AS DOUBLE)', 4)} END AS delta_pct
FROM subject s LEFT JOIN med m ON s.model = m.km AND s.year IS NOT DISTINCT FROM m.ky"""

QUERIES["r48_comps_summary_all"] = lambda spark, d: C.comps_summary(
    frame(spark, d, "subject"), frame(spark, d, "market_listing"), median_over="all"
).select("subject_id", "n", "median_rm")
ORACLES["r48_comps_summary_all"] = f"""{COMPS_CTES},
win AS (SELECT km, ky, max(year_window) AS w, count(*) AS n FROM kept GROUP BY 1, 2),
med AS (SELECT w.km, w.ky, w.n, median(m.price_rm) AS md FROM win w JOIN market_listing m
  ON m.model = w.km AND (w.ky IS NULL OR m.year BETWEEN w.ky - w.w AND w.ky + w.w) GROUP BY 1, 2, 3)
SELECT s.subject_id, coalesce(m.n, 0) AS n, CAST({rint('CAST(m.md AS DOUBLE)')} AS BIGINT) AS median_rm
FROM subject s LEFT JOIN med m ON s.model = m.km AND s.year IS NOT DISTINCT FROM m.ky"""

QUERIES["r50_ordered_listings"] = lambda spark, d: C.ordered_listings(
    frame(spark, d, "market_listing")
).select("source", "scraped_at", "listing_id", "listing_url")
ORACLES["r50_ordered_listings"] = f"""{ctes('market_listing')}
SELECT source, scraped_at, listing_id, listing_url FROM market_listing ORDER BY source, scraped_at DESC, listing_id"""
