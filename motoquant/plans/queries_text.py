"""Queries: normalising projections over whole tables (R10-R16, R18-R25)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.functions import measures as M
from motoquant.functions import specsheet as S
from motoquant.functions import urls as U
from motoquant.functions import vocab as V
from motoquant.operators import contract as K
from motoquant.plans.sqltext import badge, canonical_class, class_label, first, fuel, transmission
from motoquant.plans.standins import MODEL_SPELLINGS, SQL, _pick, ctes, frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TITLES = (
    "2020 Mercedes Benz C200 1.5|2018 Mercedes-Benz C-Class AMG|Mercedes-AMG GT S 2019|Mercedes-Benz GLC250 4MATIC|"
    "mercedes CLA 45|2015 Mercedes-Benz SL-Class|Mercedes Benz E 300 Avantgarde|BMW 320i|Mercedes-Benz Sprinter|"
    "Mercedes-Benz GLS-Class 450|Mercedes Benz GL 350|S-Class Coupe"
)
# one text row per line item: each dirty column cycles through its spellings
SQL["dirty_text"] = f"""
SELECT l.l_orderkey AS k1, l.l_partkey AS k2, l.l_suppkey AS k3, l.l_linenumber AS k4,
  {_pick(MODEL_SPELLINGS, 'l.l_partkey')} AS model,
  {_pick(' slk|SL CLASS|GL Class|C-Coupe|230|e class|Unknown|A|', 'l.l_partkey')} AS label,
  {_pick(TITLES, 'l.l_suppkey + l.l_linenumber')} AS title,
  {_pick('Mercedes-Benz|Mercedes Benz||BMW', 'l.l_partkey')} AS make,
  {_pick('|Cars|C-CLASS|GLE|', 'l.l_orderkey')} AS model_group,
  {_pick('auto|AT|manual|semi auto|dual-clutch dsg|cvt|', 'l.l_partkey')} AS gearbox,
  {_pick('petrol|DIESEL|plug-in hybrid|electric (bev)|gas|', 'l.l_suppkey')} AS fuel,
  {_pick('RM 149,000|149000|POA|RM1,234.50|', 'l.l_suppkey')} AS price_kind,
  'RM ' || CAST(CAST(floor(l.l_extendedprice) AS BIGINT) AS STRING) AS price_text,
  CASE l.l_linenumber WHEN 1 THEN CAST(l.l_partkey % 200 AS STRING) || 'k'
    WHEN 2 THEN CAST(l.l_partkey % 90 AS STRING) || 'k - ' || CAST(l.l_partkey % 90 + 5 AS STRING) || 'k'
    WHEN 3 THEN chr(123) || '"gte": "' || CAST(l.l_partkey AS STRING) || '", "lte": "' || CAST(l.l_partkey + 4999 AS STRING) || '"' || chr(125)
    WHEN 4 THEN chr(123) || '"lte": ' || CAST(l.l_partkey AS STRING) || chr(125)
    WHEN 5 THEN CAST(l.l_partkey AS STRING) || ',000 km' WHEN 6 THEN 'unknown' ELSE NULL END AS mileage_text,
  CASE l.l_linenumber WHEN 1 THEN CAST(CAST(l.l_shipdate AS DATE) AS STRING)
    WHEN 2 THEN CAST(CAST(l.l_shipdate AS DATE) AS STRING) || ' 10:20:30'
    WHEN 3 THEN CAST(l.l_partkey % 28 + 1 AS STRING) || '/' || CAST(l.l_suppkey % 12 + 1 AS STRING) || '/2024'
    WHEN 4 THEN CAST(l.l_partkey % 28 + 1 AS STRING) || '-' || CAST(l.l_suppkey % 12 + 1 AS STRING) || '-2023'
    WHEN 5 THEN '2022/' || CAST(l.l_suppkey % 12 + 1 AS STRING) || '/' || CAST(l.l_partkey % 28 + 1 AS STRING)
    WHEN 6 THEN CAST(1600000000 + l.l_orderkey * 86400 % 100000000 AS STRING)
    ELSE CAST(CAST(l.l_shipdate AS DATE) AS STRING) || 'T08:00:00Z' END AS posted_text,
  {_pick('Dealer Network|private seller|Owner||', 'l.l_partkey')} AS profile_text,
  {_pick('1|0|true|False||maybe', 'l.l_suppkey')} AS company_flag
FROM {{lineitem}} l
"""


def _text(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, d, "dirty_text")


def _counted(df: DataFrame, *cols) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


T = ctes("dirty_text")

QUERIES["r10_canonical_class"] = lambda s, d: _counted(
    _text(s, d), "model", V.canonical_class("model").alias("model_class")
)
ORACLES["r10_canonical_class"] = f"""{T} SELECT model, {canonical_class('model')} AS model_class, count(*) AS n
FROM dirty_text GROUP BY 1, 2"""

QUERIES["r11_class_label"] = lambda s, d: _counted(_text(s, d), "label", V.class_label("label").alias("class_label"))
ORACLES["r11_class_label"] = f"{T} SELECT label, {class_label('label')} AS class_label, count(*) AS n FROM dirty_text GROUP BY 1, 2"

_HAY = "upper(coalesce(make, '') || ' ' || coalesce(title, ''))"
_BARE = "\n".join(rf"WHEN regexp_matches({_HAY}, '\b{t}(\b|\d)') THEN '{t}_CLASS'" for t in V.TITLE_BARE)
_WORDED = "\n".join(rf"WHEN regexp_matches({_HAY}, '\b{t}[- ]CLASS(\b|\d)') THEN '{t}_CLASS'" for t in V.TITLE_WORDED)
_BADGE = class_label(first(_HAY, V.TITLE_VARIANT))
QUERIES["r12_title_class"] = lambda s, d: _counted(
    _text(s, d), "title", "make", "model_group",
    V.title_class("title", "make", "model_group", "mercedes").alias("model"),
)
ORACLES["r12_title_class"] = f"""{T} SELECT title, make, model_group,
  coalesce({class_label("replace(model_group, '-', ' ')")},
    CASE WHEN {_HAY} NOT LIKE '%MERCEDES%' THEN NULL
      WHEN {_HAY} LIKE '%MERCEDES-AMG GT%' THEN 'AMG_GT_CLASS'
      {_BARE}
      {_WORDED}
      ELSE {_BADGE} END) AS model, count(*) AS n FROM dirty_text GROUP BY 1, 2, 3, 4"""

QUERIES["r13_vocabularies"] = lambda s, d: _counted(
    _text(s, d), "gearbox", "fuel",
    V.training_transmission("gearbox").alias("train_transmission"), V.training_fuel("fuel").alias("train_fuel"),
    V.listing_transmission("gearbox").alias("list_transmission"), V.listing_fuel("fuel").alias("list_fuel"),
)
ORACLES["r13_vocabularies"] = f"""{T} SELECT gearbox, fuel, {transmission('gearbox')} AS train_transmission,
  {fuel('fuel')} AS train_fuel,
  CASE WHEN lower(gearbox) IN ('auto', 'automatic', 'at') THEN 'Automatic' WHEN lower(gearbox) IN ('manual', 'mt') THEN 'Manual'
    WHEN lower(gearbox) LIKE '%semi%' THEN 'Semi-Auto' WHEN gearbox = 'dual-clutch dsg' THEN 'Dual-Clutch Dsg'
    ELSE upper(substr(gearbox, 1, 1)) || lower(substr(gearbox, 2)) END AS list_transmission,
  CASE fuel WHEN 'plug-in hybrid' THEN 'Plug-In Hybrid' WHEN 'electric (bev)' THEN 'Electric (Bev)'
    ELSE upper(substr(fuel, 1, 1)) || lower(substr(fuel, 2)) END AS list_fuel, count(*) AS n
FROM dirty_text GROUP BY 1, 2, 3, 4, 5, 6"""

QUERIES["r14_badge_litres"] = lambda s, d: _counted(_text(s, d), "model", M.badge_litres("model").alias("litres"))
ORACLES["r14_badge_litres"] = f"{T} SELECT model, {badge('model')} AS litres, count(*) AS n FROM dirty_text GROUP BY 1, 2"

QUERIES["r15_measures"] = lambda s, d: (
    lambda df: df.select(
        "spec_pos", M.kmh("Top Speed").alias("kmh"), M.boot_litres("Cargo Volume").alias("boot"),
        M.gear_count("Gearbox").alias("gears"), M.displacement_cc("Displacement").alias("cc"),
        M.torque_nm("Torque(Nm)").alias("nm"), M.year_bounds("Production years")[0].alias("y0"),
        M.year_bounds("Production years")[1].alias("y1"), M.brake_type("Front brake").alias("brake"),
        M.aspiration("Fuel System").alias("aspiration"), M.gear_type("Gearbox").alias("gear_type"),
    )
)(frame(s, d, "spec_raw"))
ORACLES["r15_measures"] = f"""{ctes('spec_raw', 'part')}
SELECT spec_pos, CAST(150 + p_size AS DOUBLE) AS kmh,
  CASE WHEN spec_pos % 17 <> 0 THEN CAST(180 + p_size * 5 AS DOUBLE) END AS boot,
  CAST(regexp_extract("Gearbox", '^(\\d)') AS DOUBLE) AS gears,
  CASE WHEN spec_pos % 19 <> 0 THEN CAST(p_size * 100 + 43 AS DOUBLE) END AS cc,
  CASE WHEN spec_pos % 23 <> 0 THEN CAST(200 + p_size * 7 AS DOUBLE) END AS nm,
  CASE WHEN spec_pos % 53 <> 0 THEN CAST(1990 + spec_pos % 31 AS INTEGER) END AS y0,
  CASE WHEN spec_pos % 53 <> 0 THEN CAST(1990 + spec_pos % 31 + greatest(1, p_size % 7) AS INTEGER) END AS y1,
  CASE "Front brake" WHEN 'Ventilated Discs' THEN 'Ventilated Discs' WHEN 'Discs' THEN 'Discs' WHEN 'Drums' THEN 'Drums'
    WHEN 'Carbon Ceramic' THEN 'Ceramic' ELSE 'Unknown' END AS brake,
  CASE "Fuel System" WHEN 'Turbocharged Common Rail' THEN 'turbo' WHEN 'Supercharged' THEN 'supercharged'
    WHEN 'Compressor' THEN 'supercharged' WHEN 'Direct Injection' THEN 'naturally_aspirated'
    WHEN 'Electric motor' THEN 'electric' ELSE 'Unknown' END AS aspiration,
  CASE "Gearbox" WHEN '9-speed automatic' THEN 'automatic' WHEN '6-speed manual' THEN 'manual'
    WHEN '7 Speed DCT' THEN 'dct' WHEN '5-speed dual clutch' THEN 'dct' ELSE 'Unknown' END AS gear_type
FROM spec_raw JOIN part ON p_partkey = spec_pos""".replace(
    "CAST(regexp_extract(\"Gearbox\", '^(\\d)') AS DOUBLE)",
    "CAST(nullif(regexp_extract(\"Gearbox\", '^(\\d)', 1), '') AS DOUBLE)",
)


def _contract_rows(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "profile").select(
        "profile_id", (F.col("year") - F.when(F.col("profile_id") % 50 == 0, 100).otherwise(0)).alias("year"),
        (F.col("mileage") - F.when(F.col("profile_id") % 70 == 0, 400000).otherwise(0)).alias("mileage"),
        "engine_size", "original_purchase_price_rm",
        F.col("services_done").alias("service_history_count"),
        (F.col("services_due") - 1).alias("service_history_total"),
    )


_RULE_SQL = {
    "year 1970-2100": "year BETWEEN 1970 AND 2100",
    "mileage >= 0": "mileage >= 0",
    "engine_size >= 0": "engine_size >= 0",
    "original_purchase_price_rm >= 0": "original_purchase_price_rm IS NULL OR original_purchase_price_rm >= 0",
    "service_history_count >= 0": "service_history_count IS NULL OR service_history_count >= 0",
    "service_history_total >= 0": "service_history_total IS NULL OR service_history_total >= 0",
}
_CONTRACT_CTE = f"""{ctes('profile')}, c AS (SELECT profile_id,
  year - CASE WHEN profile_id % 50 = 0 THEN 100 ELSE 0 END AS year,
  mileage - CASE WHEN profile_id % 70 = 0 THEN 400000 ELSE 0 END AS mileage, engine_size, original_purchase_price_rm,
  services_done AS service_history_count, services_due - 1 AS service_history_total FROM profile)"""
QUERIES["r16_contract_counts"] = lambda s, d: K.contract_counts(_contract_rows(s, d), K.profile_rules())
ORACLES["r16_contract_counts"] = _CONTRACT_CTE + " UNION ALL ".join(
    f" SELECT '{n}' AS rule, count(*) FILTER (WHERE NOT coalesce({e}, false)) AS violations, count(*) AS rows_checked FROM c"
    for n, e in _RULE_SQL.items()
)
QUERIES["r16_quarantine"] = lambda s, d: K.split_by_contract(_contract_rows(s, d), K.profile_rules())[1].select(
    "profile_id", "violation"
)
ORACLES["r16_quarantine"] = f"""{_CONTRACT_CTE} SELECT profile_id, violation FROM (SELECT profile_id, CASE
  {' '.join(f"WHEN NOT coalesce({e}, false) THEN '{n}'" for n, e in _RULE_SQL.items())} END AS violation FROM c)
WHERE violation IS NOT NULL"""

QUERIES["r18_price"] = lambda s, d: _text(s, d).select(
    "k1", "k2", "k3", "k4", M.price_rm("price_text").alias("price_rm"), M.price_rm("price_kind").alias("price_kind_rm")
)
ORACLES["r18_price"] = f"""{T} SELECT k1, k2, k3, k4, CAST(substr(price_text, 4) AS BIGINT) AS price_rm,
  CASE price_kind WHEN 'RM 149,000' THEN 149000 WHEN '149000' THEN 149000 WHEN 'RM1,234.50' THEN 123450 END::BIGINT AS price_kind_rm
FROM dirty_text"""

QUERIES["r19_mileage"] = lambda s, d: _text(s, d).select("k1", "k2", "k3", "k4", M.mileage_km("mileage_text").alias("km"))
ORACLES["r19_mileage"] = f"""{T} SELECT k1, k2, k3, k4, CAST(CASE k4
  WHEN 1 THEN k2 % 200 * 1000 WHEN 2 THEN (k2 % 90 * 2 + 5) // 2 * 1000
  WHEN 3 THEN (k2 + k2 + 4999) // 2 WHEN 4 THEN k2 WHEN 5 THEN CASE WHEN k2 = 0 THEN 0 ELSE k2 * 1000 END END AS BIGINT) AS km
FROM dirty_text"""

QUERIES["r20_posted_date"] = lambda s, d: _text(s, d).select("k1", "k2", "k3", "k4", M.posted_date("posted_text").alias("posted_at"))
ORACLES["r20_posted_date"] = f"""{T} SELECT k1, k2, k3, k4, strftime(CASE k4
  WHEN 3 THEN make_date(2024, CAST(k3 % 12 + 1 AS INT), CAST(k2 % 28 + 1 AS INT))
  WHEN 4 THEN make_date(2023, CAST(k3 % 12 + 1 AS INT), CAST(k2 % 28 + 1 AS INT))
  WHEN 5 THEN make_date(2022, CAST(k3 % 12 + 1 AS INT), CAST(k2 % 28 + 1 AS INT))
  WHEN 6 THEN CAST(make_timestamp(CAST(posted_text AS BIGINT) * 1000000) AS DATE)
  ELSE CAST(substr(posted_text, 1, 10) AS DATE) END, '%Y-%m-%d') AS posted_at FROM dirty_text"""

QUERIES["r21_first_filled"] = lambda s, d: _counted(
    _text(s, d), V.first_filled("model_group", "make", "title").alias("picked")
)
ORACLES["r21_first_filled"] = f"{T} SELECT coalesce(model_group, make, title) AS picked, count(*) AS n FROM dirty_text GROUP BY 1"

QUERIES["r22_seller_type"] = lambda s, d: _counted(
    _text(s, d), "profile_text", "company_flag", V.seller_type("profile_text", "company_flag").alias("seller_type")
)
ORACLES["r22_seller_type"] = f"""{T} SELECT profile_text, company_flag, CASE WHEN profile_text = 'Dealer Network' THEN 'dealer'
  WHEN profile_text IN ('private seller', 'Owner') THEN 'private' WHEN company_flag IN ('1', 'true') THEN 'dealer'
  WHEN company_flag IN ('0', 'False') THEN 'private' ELSE 'unknown' END AS seller_type, count(*) AS n
FROM dirty_text GROUP BY 1, 2, 3"""

QUERIES["r23_urls"] = lambda s, d: frame(s, d, "pages").select(
    "page_id", U.url_host("url").alias("host"), U.drop_query_and_fragment("url").alias("bare"),
    U.absolute_url("url", F.lit("/car/x%20y?q=1")).alias("rooted"), U.absolute_url("url", F.lit("next.htm")).alias("sibling"),
    U.canonical_url(F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), F.lit("%20a#b"))).alias("decoded"),
    U.slugify(F.concat("url", F.lit(" 2020 C200!"))).alias("slug"),
)
ORACLES["r23_urls"] = r"""SELECT page_id, lower(regexp_extract(url, '^\w+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^([^?#]*)', 1) AS bare,
  regexp_extract(url, '^(\w+://[^/?#]*)', 1) || '/car/x%20y?q=1' AS rooted,
  CASE WHEN regexp_extract(url, '^(\w+://[^/?#]*/.*)', 1) = '' THEN regexp_extract(url, '^(\w+://[^/?#]*)', 1) || '/next.htm'
    ELSE regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) || 'next.htm' END AS sibling,
  regexp_extract(url, '^([^?#]*)', 1) || ' a' AS decoded,
  trim(regexp_replace(lower(url || ' 2020 C200!'), '[^a-z0-9]+', '-', 'g'), '-') AS slug
FROM pages"""

SQL["sheet_pair"] = f"""
SELECT l.l_orderkey AS k1, l.l_partkey AS k2, l.l_suppkey AS k3, l.l_linenumber AS k4,
  {_pick('Horsepower:|Maximum torque|Top Speed :|Charging Time DC 100 kW|Charging Time Wallbox|Charging Time AC|Fuel Consumption - Economy - City|Fuel consumption - extra urban|Fuel economy combined|Fuel Type|Battery Capacity|Colour|Num. of Doors', 'l.l_partkey')} AS label,
  {_pick('190 HP / 140 kW|375 Nm / 277 lb-ft|1,250|66.5 kWh|-|n/a|plug-in hybrid|5 h 45 min', 'l.l_suppkey')} AS text
FROM {{lineitem}} l
"""
QUERIES["r24_spec_values"] = lambda s, d: (
    lambda df: _counted(df, "label", "text", "field", S.field_value("field", "text").alias("value"))
)(frame(s, d, "sheet_pair").withColumn("field", S.label_field(S.clean_label("label"))))
_INT = "replace(nullif(regexp_extract(text, '(\\d[\\d,]*)', 1), ''), ',', '')"
ORACLES["r24_spec_values"] = f"""{ctes('sheet_pair')}, f AS (SELECT *, CASE label WHEN 'Horsepower:' THEN 'horsepower_hp'
  WHEN 'Maximum torque' THEN 'torque_nm' WHEN 'Top Speed :' THEN NULL WHEN 'Charging Time DC 100 kW' THEN 'charging_dc'
  WHEN 'Charging Time Wallbox' THEN 'charging_wallbox' WHEN 'Charging Time AC' THEN 'charging_ac'
  WHEN 'Fuel Consumption - Economy - City' THEN 'consumption_city_l100km'
  WHEN 'Fuel consumption - extra urban' THEN 'consumption_openroad_l100km'
  WHEN 'Fuel economy combined' THEN 'consumption_combined_l100km' WHEN 'Fuel Type' THEN 'fuel_type'
  WHEN 'Battery Capacity' THEN 'battery_capacity_kwh' WHEN 'Num. of Doors' THEN 'num_doors' END AS field FROM sheet_pair)
SELECT label, text, field, CASE WHEN text IN ('-', 'n/a') THEN NULL
  WHEN field IN ('horsepower_hp', 'torque_nm', 'num_doors') THEN {_INT}
  WHEN field IN ('consumption_city_l100km', 'consumption_openroad_l100km', 'consumption_combined_l100km', 'battery_capacity_kwh')
    THEN nullif(regexp_extract(text, '(\\d+(?:\\.\\d+)?)', 1), '')
  WHEN field = 'fuel_type' THEN CASE text WHEN '190 HP / 140 kW' THEN '190 Hp / 140 Kw' WHEN '375 Nm / 277 lb-ft' THEN '375 Nm / 277 Lb-Ft'
    WHEN '1,250' THEN '1,250' WHEN '66.5 kWh' THEN '66.5 Kwh' WHEN 'plug-in hybrid' THEN 'Plug-In Hybrid' ELSE '5 H 45 Min' END
  ELSE text END AS value, count(*) AS n FROM f GROUP BY 1, 2, 3, 4"""

SQL["sheet_title"] = """
SELECT o.o_orderkey AS sheet_id,
  CASE o.o_orderkey % 6 WHEN 0 THEN 'Mercedes C ' || CAST(1990 + o.o_custkey % 30 AS STRING) || ' Specs'
    WHEN 1 THEN 'Mercedes W204 2011 C200' WHEN 2 THEN 'Mercedes W205 C200 Specs' WHEN 3 THEN 'Mercedes E Specs'
    WHEN 4 THEN 'Mercedes W204 C180' ELSE 'Mercedes 2001 to 2007' END AS title,
  CASE o.o_custkey % 4 WHEN 0 THEN '(' || CAST(2000 + o.o_custkey % 20 AS STRING) || ' - present) text'
    WHEN 1 THEN 'Technical Specifications for Years 2015, 2013, ' || CAST(2000 + o.o_custkey % 20 AS STRING)
    ELSE 'no years here' END AS body
FROM {orders} o
"""
QUERIES["r25_sheet_years"] = lambda s, d: frame(s, d, "sheet_title").select(
    "sheet_id", S.sheet_years("title", "body").alias("y"), S.generation_code("title").alias("generation")
).select("sheet_id", "y.year_start", "y.year_end", "generation")
ORACLES["r25_sheet_years"] = f"""{ctes('sheet_title')}, e AS (SELECT *, sheet_id % 6 AS m, o_custkey AS c FROM sheet_title
  JOIN orders ON o_orderkey = sheet_id)
SELECT sheet_id, CAST(CASE c % 4 WHEN 0 THEN 2000 + c % 20 WHEN 1 THEN least(2013, 2000 + c % 20)
    ELSE CASE m WHEN 0 THEN 1990 + c % 30 WHEN 1 THEN 2011 WHEN 2 THEN 2014 WHEN 4 THEN 2007 WHEN 5 THEN 2001 END END AS INTEGER) AS year_start,
  CAST(CASE c % 4 WHEN 0 THEN NULL WHEN 1 THEN greatest(2015, 2000 + c % 20)
    ELSE CASE m WHEN 0 THEN 1990 + c % 30 WHEN 1 THEN 2014 WHEN 2 THEN 2018 WHEN 4 THEN 2011 WHEN 5 THEN 2007 END END AS INTEGER) AS year_end,
  CASE m WHEN 1 THEN 'W204' WHEN 2 THEN 'W205' WHEN 4 THEN 'W204' END AS generation FROM e"""
