"""Queries: pages to tables (R26-R34), and sinks that read back what they wrote (R05-R08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.operators import pages as P
from motoquant.plans.sqltext import first
from motoquant.plans.standins import SQL, _pick, ctes, frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _page(template: str) -> str:
    """SQL text expression of a page; <<expr>> holes take SQL, braces are spelt by code."""
    out = []
    for i, piece in enumerate(template.split("<<")):
        literal = piece
        if i:
            hole, literal = piece.split(">>", 1)
            out.append(f"({hole})")
        literal = literal.replace("'", "''").replace("{", "' || chr(123) || '").replace("}", "' || chr(125) || '")
        out.append(f"'{literal}'")
    return " || ".join(out)


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


BASE = "https://cars.example"
K = "o.o_orderkey"
YEAR = _s(f"2000 + {K} % 25")
BADGE = _pick("C200|E300|GLC250|A180", K)
PRICE = _s("CAST(floor(o.o_totalprice) AS BIGINT)")

SQL["search_page"] = f"""
SELECT o.o_orderkey AS page_id, 'https://cars.example/search/' || {_s(K)} AS url,
{_page('''<!doctype html><html><head><title>Search</title></head><body>
<script id="__NEXT_DATA__" type="application/json">
{"props": {"initialState": {"adListing": {"byID": {
"<<''' + _s(f'{K} * 2') + '''>>": {"attributes": {"listId": <<''' + _s(f'{K} * 2') + '''>>,
 "subject": "<<''' + YEAR + '''>> Mercedes Benz <<''' + BADGE + '''>> AMG", "makeName": "Mercedes Benz", "modelName": "<<''' + BADGE + '''>>",
 "categoryName": "Cars", "manufacturedYear": "<<''' + YEAR + '''>>", "price": <<''' + PRICE + '''>>,
 "mileage": {"gte": "<<''' + _s('o.o_custkey') + '''>>", "lte": "<<''' + _s('o.o_custkey + 4999') + '''>>"}, "transmission": "auto",
 "fueltype": "petrol", "regionName": "Selangor", "subareaName": "Puncak Alam", "companyAd": true, "adDate": "2026-07-02",
 "adviewUrl": "/<<''' + _s(f'{K} * 2') + '''>>.htm?ref=1"}},
"<<''' + _s(f'{K} * 2 + 1') + '''>>": {"listId": "<<''' + _s(f'{K} * 2 + 1') + '''>>", "subject": "<<''' + _pick('Toyota Vios 2015|2016 Mercedes-Benz Unknown|2019 Mercedes Benz E300', K) + '''>>",
 "make": "<<''' + _pick('Toyota|Mercedes-Benz|Mercedes-Benz', K) + '''>>", "price": "<<''' + _pick('RM 88,000|POA', 'o.o_custkey') + '''>>", "companyAd": 0}
}}}}}
</script></body></html>''')} AS html
FROM {{orders}} o
"""


def _search(s: SparkSession, d: str) -> DataFrame:
    return P.bootstrap_listings(frame(s, d, "search_page"), BASE)


BOOT = f"""WITH a AS (SELECT o_orderkey AS page_id, 'classifieds' AS source, '{BASE}/' || CAST(o_orderkey * 2 AS VARCHAR) || '.htm' AS listing_url,
  CASE o_orderkey % 4 WHEN 0 THEN 'C_CLASS' WHEN 1 THEN 'E_CLASS' WHEN 2 THEN 'GLC_CLASS' ELSE 'A_CLASS' END AS model,
  CASE o_orderkey % 4 WHEN 0 THEN 'C200' WHEN 1 THEN 'E300' WHEN 2 THEN 'GLC250' ELSE 'A180' END AS variant,
  CAST(2000 + o_orderkey % 25 AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS price_rm,
  CAST((o_custkey * 2 + 4999) // 2 AS BIGINT) AS mileage, 'Automatic' AS transmission, 'Petrol' AS fuel_type,
  'Selangor - Puncak Alam' AS location, 'dealer' AS seller_type, '2026-07-02' AS posted_at, 'kept' AS outcome FROM orders),
b AS (SELECT o_orderkey AS page_id, 'classifieds' AS source,
  '{BASE}/' || CASE o_orderkey % 3 WHEN 0 THEN 'toyota-vios-2015' WHEN 1 THEN '2016-mercedes-benz-unknown' ELSE '2019-mercedes-benz-e300' END
    || '-' || CAST(o_orderkey * 2 + 1 AS VARCHAR) || '.htm' AS listing_url,
  CASE WHEN o_orderkey % 3 = 2 THEN 'E_CLASS' END AS model, CAST(NULL AS VARCHAR) AS variant,
  CAST(CASE o_orderkey % 3 WHEN 0 THEN 2015 WHEN 1 THEN 2016 ELSE 2019 END AS INTEGER) AS year,
  CASE WHEN o_custkey % 2 = 0 THEN CAST(88000 AS BIGINT) END AS price_rm, CAST(NULL AS BIGINT) AS mileage,
  CAST(NULL AS VARCHAR) AS transmission, CAST(NULL AS VARCHAR) AS fuel_type, CAST(NULL AS VARCHAR) AS location, 'private' AS seller_type,
  CAST(NULL AS VARCHAR) AS posted_at,
  CASE WHEN o_custkey % 2 = 1 THEN 'unparseable' WHEN o_orderkey % 3 = 0 THEN 'other_brand' WHEN o_orderkey % 3 = 1 THEN 'unparseable' ELSE 'kept' END AS outcome
  FROM orders), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""
QUERIES["r26_bootstrap_listings"] = _search
ORACLES["r26_bootstrap_listings"] = f"{BOOT} SELECT * FROM u"

ITEM = '''{"@type": "ListItem", "item": {"@type": "Car", "name": "<<''' + YEAR + '''>> Mercedes-Benz <<''' + BADGE + '''>> Line",
 "brand": {"@type": "Brand", "name": "Mercedes-Benz"}, "model": "<<''' + BADGE + '''>>", "vehicleModelDate": "<<''' + YEAR + '''>>",
 "mileageFromOdometer": {"value": "<<''' + _s('o.o_custkey * 10') + '''>>"}, "vehicleTransmission": "Automatic", "fuelType": "petrol",
 "mainEntityOfPage": "https://dealers.example/car/<<''' + _s(K) + '''>>?x=1#top",
 "offers": {"price": "<<''' + PRICE + '''>>", "seller": {"@type": "<<''' + _pick('Organization|Person', 'o.o_custkey') + '''>>", "address": {"addressRegion": "Kuala Lumpur"}}},
 "datePublished": "2026-07-02T10:00:00"}}'''
CARD = '''<article class="listing js--listing" data-title="<<''' + YEAR + '''>> Mercedes-Benz <<''' + BADGE + '''>>" data-url="https://dealers.example/card/<<''' + _s(K) + '''>>?a=b"
 data-year="<<''' + YEAR + '''>>" data-make="Mercedes-Benz" data-model="<<''' + BADGE + '''>>" data-transmission="manual"></article>'''
SQL["dealer_page"] = f"""
SELECT o.o_orderkey AS page_id, 'https://dealers.example/list/' || {_s(K)} AS url,
CASE WHEN o.o_orderkey % 5 = 0 THEN {_page('<html><body>' + CARD + '</body></html>')}
ELSE {_page('<html><head><script type="application/ld+json">{"@type": "WebSite"}</script><script type="application/ld+json">{"@type": ["ItemList"], "itemListElement": ['
    + ITEM + ', ' + ITEM + ', {"@type": "ListItem", "item": {"name": "BMW 320i", "brand": "BMW", "year": 2018, "url": "https://dealers.example/b", "offers": {"price": 5}}}]}</script></head></html>')} END AS html
FROM {{orders}} o
"""


def _dealer(s: SparkSession, d: str) -> DataFrame:
    return P.linked_listings(frame(s, d, "dealer_page"))


LINKED = """WITH a AS (SELECT o_orderkey AS page_id, 'dealers' AS source, 'https://dealers.example/car/' || CAST(o_orderkey AS VARCHAR) AS listing_url,
  CASE o_orderkey % 4 WHEN 0 THEN 'C_CLASS' WHEN 1 THEN 'E_CLASS' WHEN 2 THEN 'GLC_CLASS' ELSE 'A_CLASS' END AS model,
  CASE o_orderkey % 4 WHEN 0 THEN 'C200' WHEN 1 THEN 'E300' WHEN 2 THEN 'GLC250' ELSE 'A180' END AS variant,
  CAST(2000 + o_orderkey % 25 AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS price_rm, o_custkey * 10 AS mileage,
  'Automatic' AS transmission, 'Petrol' AS fuel_type, 'Kuala Lumpur' AS location,
  CASE WHEN o_custkey % 2 = 0 THEN 'dealer' ELSE 'unknown' END AS seller_type, '2026-07-02' AS posted_at, 'kept' AS outcome FROM orders WHERE o_orderkey % 5 <> 0),
b AS (SELECT o_orderkey, 'dealers', 'https://dealers.example/b', NULL, NULL, 2018, CAST(5 AS BIGINT), CAST(NULL AS BIGINT), NULL, NULL, NULL, 'unknown', NULL, 'other_brand'
  FROM orders WHERE o_orderkey % 5 <> 0),
c AS (SELECT o_orderkey AS page_id, 'dealers' AS source, 'https://dealers.example/card/' || CAST(o_orderkey AS VARCHAR) AS listing_url,
  CASE o_orderkey % 4 WHEN 0 THEN 'C_CLASS' WHEN 1 THEN 'E_CLASS' WHEN 2 THEN 'GLC_CLASS' ELSE 'A_CLASS' END AS model,
  CASE o_orderkey % 4 WHEN 0 THEN 'C200' WHEN 1 THEN 'E300' WHEN 2 THEN 'GLC250' ELSE 'A180' END AS variant,
  CAST(2000 + o_orderkey % 25 AS INTEGER) AS year, CAST(NULL AS BIGINT) AS price_rm, CAST(NULL AS BIGINT) AS mileage,
  'Manual' AS transmission, CAST(NULL AS VARCHAR) AS fuel_type, CAST(NULL AS VARCHAR) AS location, 'unknown' AS seller_type,
  CAST(NULL AS VARCHAR) AS posted_at, 'no_price' AS outcome FROM orders WHERE o_orderkey % 5 = 0)"""
QUERIES["r27_linked_listings"] = _dealer
ORACLES["r27_linked_listings"] = f"{LINKED} SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c"
QUERIES["r28_card_listings"] = lambda s, d: P.card_listings(frame(s, d, "dealer_page"))
ORACLES["r28_card_listings"] = f"{LINKED} SELECT * FROM c"

SQL["dealer_detail"] = f"""
SELECT o.o_orderkey AS page_id, 'https://dealers.example/x' AS url,
CASE WHEN o.o_orderkey % 5 = 0 THEN {_page('<html><head><meta name="WT.z_price" content="RM 99,500"><meta name="WT.z_location" content="Johor"></head><body>' + CARD + '</body></html>')}
ELSE {_page('''<html><head><link rel="canonical" href="https://dealers.example/detail/<<''' + _s(K) + '''>>?utm=1">
<meta name="WT.z_price" content="228000"><meta name="WT.z_transmission" content="manual"><meta name="WT.z_Fueltype" content="diesel">
<meta name="WT.z_location" content="Penang"><meta name="WT.z_model" content="E300"><meta name="ga:cad:details:profile_type" content="<<''' + _pick('Dealer|Private Seller|Club', K) + '''>>">
<script type="application/ld+json">{"@type": "BreadcrumbList"}</script>
<script type="application/ld+json">[{"@type": "Car", "name": "<<''' + _pick('BMW 3|2020 Mercedes-Benz E300', K) + '''>>", "brand": {"name": "<<''' + _pick('BMW|Mercedes-Benz', K) + '''>>"},
 "vehicleModelDate": "2020", "mainEntityOfPage": {"@id": "https://dealers.example/y"}, "offers": {"price": "<<''' + PRICE + '''>>"}}]</script></head></html>''')} END AS html
FROM {{orders}} o
"""
QUERIES["r29_linked_detail"] = lambda s, d: P.linked_detail(frame(s, d, "dealer_detail"))
ORACLES["r29_linked_detail"] = """SELECT o_orderkey AS page_id, 'dealers' AS source, 'https://dealers.example/detail/' || CAST(o_orderkey AS VARCHAR) AS listing_url,
  'E_CLASS' AS model, 'E300' AS variant, CAST(2020 AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS price_rm, CAST(NULL AS BIGINT) AS mileage,
  'Manual' AS transmission, 'Diesel' AS fuel_type, 'Penang' AS location,
  CASE o_orderkey % 3 WHEN 0 THEN 'dealer' WHEN 1 THEN 'private' ELSE 'unknown' END AS seller_type, CAST(NULL AS VARCHAR) AS posted_at, 'kept' AS outcome
FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'dealers', 'https://dealers.example/card/' || CAST(o_orderkey AS VARCHAR),
  CASE o_orderkey % 4 WHEN 0 THEN 'C_CLASS' WHEN 1 THEN 'E_CLASS' WHEN 2 THEN 'GLC_CLASS' ELSE 'A_CLASS' END,
  CASE o_orderkey % 4 WHEN 0 THEN 'C200' WHEN 1 THEN 'E300' WHEN 2 THEN 'GLC250' ELSE 'A180' END,
  CAST(2000 + o_orderkey % 25 AS INTEGER), CAST(99500 AS BIGINT), CAST(NULL AS BIGINT), 'Manual', CAST(NULL AS VARCHAR), 'Johor', 'unknown', CAST(NULL AS VARCHAR), 'kept'
FROM orders WHERE o_orderkey % 5 = 0"""

SQL["classified_detail"] = f"""
SELECT o.o_orderkey AS page_id, 'https://cars.example/x' AS url,
CASE WHEN o.o_orderkey % 2 = 0 THEN {_page('''<html><script id="__NEXT_DATA__" type="application/json">{"props": {"initialState": {"adDetails": {"byID": {
"<<''' + _s(K) + '''>>": {"attributes": {"subject": "2020 Mercedes Benz C200", "makeName": "Mercedes Benz", "modelName": "C200", "manufacturedYear": "2020",
 "price": <<''' + PRICE + '''>>, "mileage": "85k"}}}}}}}</script><body><a href="/ads/c200-<<''' + _s(K) + '''>>.htm">x</a></body></html>''')}
ELSE {_page('''<html><head><link rel="canonical" href="https://cars.example/e300-<<''' + _s(K) + '''>>.htm?z=1"></head><body><h1>2019 Mercedes Benz E300 AMG</h1>
<div id="ad_view"><section><img src="a" alt="2019"><img alt="Auto"><img alt="40k - 45k"><img alt="Selangor - Klang"></section></div><p>RM <b><<''' + PRICE + '''>></b></p></body></html>''')} END AS html
FROM {{orders}} o
"""
QUERIES["r29_bootstrap_detail"] = lambda s, d: P.bootstrap_detail(frame(s, d, "classified_detail"), BASE)
ORACLES["r29_bootstrap_detail"] = f"""SELECT o_orderkey AS page_id, 'classifieds' AS source,
  CASE WHEN o_orderkey % 2 = 0 THEN '{BASE}/ads/c200-' ELSE '{BASE}/e300-' END || CAST(o_orderkey AS VARCHAR) || '.htm' AS listing_url,
  CASE WHEN o_orderkey % 2 = 0 THEN 'C_CLASS' ELSE 'E_CLASS' END AS model, CASE WHEN o_orderkey % 2 = 0 THEN 'C200' ELSE 'E300' END AS variant,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2020 ELSE 2019 END AS INTEGER) AS year, CAST(floor(o_totalprice) AS BIGINT) AS price_rm,
  CAST(CASE WHEN o_orderkey % 2 = 0 THEN 85000 ELSE 42000 END AS BIGINT) AS mileage,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Automatic' END AS transmission, CAST(NULL AS VARCHAR) AS fuel_type,
  CASE WHEN o_orderkey % 2 = 1 THEN 'Selangor - Klang' END AS location, 'unknown' AS seller_type, CAST(NULL AS VARCHAR) AS posted_at, 'kept' AS outcome
FROM orders"""

QUERIES["r30_extraction_summary"] = lambda s, d: P.extraction_summary(_search(s, d).unionByName(_dealer(s, d)))
ORACLES["r30_extraction_summary"] = f"""{BOOT}, {LINKED.replace('WITH a AS', 'la AS').replace('b AS (SELECT o_orderkey, ', 'lb AS (SELECT o_orderkey, ').replace('c AS (SELECT', 'lc AS (SELECT')},
x AS (SELECT source, outcome FROM u UNION ALL SELECT source, outcome FROM la UNION ALL SELECT 'dealers', 'other_brand' FROM lb UNION ALL SELECT source, outcome FROM lc)
SELECT source, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'kept') AS kept, count(*) FILTER (WHERE outcome = 'other_brand') AS other_brand,
  count(*) FILTER (WHERE outcome = 'unparseable') AS unparseable, count(*) FILTER (WHERE outcome = 'no_price') AS no_price FROM x GROUP BY 1"""

KINDS = {"short": r"^/[^/]{1,3}$", "word": r"^/[^/]+$"}
QUERIES["r31_page_links"] = lambda s, d: P.page_links(frame(s, d, "pages"), KINDS).select(
    "page_id", "kind", "url", "heading", "versions"
)
ORACLES["r31_page_links"] = r"""WITH a AS (SELECT DISTINCT page_id, regexp_extract(url, '^(\w+://[^/?#]*)', 1) AS origin,
  unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT DISTINCT page_id, CASE WHEN length(href) <= 4 THEN 'short' ELSE 'word' END AS kind, origin || href AS url,
  CAST(NULL AS VARCHAR) AS heading, CAST(NULL AS INTEGER) AS versions FROM a"""

SITE = "https://specs.example"
SQL["family_page"] = f"""
SELECT o.o_orderkey AS page_id, '{SITE}/models/Brand-F' || {_s(K)} AS url,
{_page('''<html><h1>All Generations</h1><!-- <a href="/car/M0/hidden">x</a> --><h2>W<<''' + _s('100 + o.o_orderkey % 200') + '''>> (2018 - 2022)</h2>
<a href="/car/M<<''' + _s(K) + '''>>/W177"><img src="1.jpg">Class A (W177) <<''' + _s('1 + o.o_custkey % 30') + '''>> Versions</a>
<a href="/car/M<<''' + _s(K) + '''>>/W177">again 9 Versions</a><h3> Second &amp; last </h3>
<a class="c" href="/car/M<<''' + _s(f'{K} + 1000000000') + '''>>/B">B Class 1 Version</a><a href="https://other.example/car/M9/x">off site</a>
<a href="/models/Brand-F<<''' + _s(K) + '''>>">self</a></html>''')} AS html
FROM {{orders}} o
"""
FAMILY_KINDS = {"family": r"^/models/Brand-[^/]+/?$", "card": r"^/car/M\d+/[^/]+/?$", "detail": r"^/car/\d+/[^/]+\.html$"}
QUERIES["r31_model_cards"] = lambda s, d: P.page_links(frame(s, d, "family_page"), FAMILY_KINDS).filter(
    "kind = 'card'"
).select("page_id", "url", "heading", "title", "versions")
ORACLES["r31_model_cards"] = f"""SELECT o_orderkey AS page_id, '{SITE}/car/M' || CAST(o_orderkey AS VARCHAR) || '/W177' AS url,
  'W' || CAST(100 + o_orderkey % 200 AS VARCHAR) || ' (2018 - 2022)' AS heading, 'Class A (W177)' AS title, CAST(1 + o_custkey % 30 AS INTEGER) AS versions FROM orders
UNION ALL SELECT o_orderkey, '{SITE}/car/M' || CAST(o_orderkey + 1000000000 AS VARCHAR) || '/B', 'Second & last', 'B Class', 1 FROM orders"""

SQL["sheet_page"] = f"""
SELECT o.o_orderkey AS page_id, '{SITE}/car/' || {_s(K)} || '/spec.html' AS url,
CASE WHEN o.o_orderkey % 3 = 0 THEN {_page('''<html><head><title>Other</title><style>a: b</style></head><body><h1>Mercedes Benz EQA 250 (H243) Specs</h1><p>(2021 - present) - Technical Specifications</p>
<div>Body : SUV</div><div>Total electric power : <<''' + _s('100 + o.o_custkey % 300') + '''>> HP / 140 kW</div><div>Battery Capacity : 66.5 kWh</div>
<div>Charging Time DC 100 kW : 30 min (10-80%)</div><div>Fuel type : electric</div></body></html>''')}
WHEN o.o_orderkey % 3 = 1 THEN {_page('''<html><body><h1>Mercedes Benz C200 W205</h1><table><tr><th>Horsepower</th><td><<''' + _s('150 + o.o_custkey % 100') + '''>> HP</td></tr>
<tr><td>Maximum torque</td><td>300 Nm / 221 lb-ft</td></tr><tr><td>Torque</td><td>999 Nm</td></tr><tr><td>Top Speed</td><td>-</td></tr>
<tr><td>Engine displacement</td><td>1,<<''' + _s('100 + o.o_custkey % 800') + '''>> cm3</td></tr></table><ul><li><b>Fuel type</b> plug-in hybrid</li></ul></body></html>''')}
ELSE {_page('''<html><body><h1>Brand X One</h1><table><tr><td>Horsepower</td><td>10 HP</td></tr></table></body></html>''')} END AS html
FROM {{orders}} o
"""
SHEET_OUT = [
    "source_url", "version_name", "generation", "year_start", "year_end", "body", "fuel_type", "displacement_cc", "horsepower_hp",
    "torque_nm", "top_speed_kmh", "total_electric_power_hp", "battery_capacity_kwh", "charging_dc",
]
QUERIES["r32_spec_sheets"] = lambda s, d: P.spec_sheets(
    frame(s, d, "sheet_page"), scraped_at=F.lit(None).cast("timestamp")
).select(*SHEET_OUT)
SHEETS = f"""SELECT '{SITE}/car/' || CAST(o_orderkey AS VARCHAR) || '/spec.html' AS source_url,
  CASE WHEN e THEN 'Mercedes Benz EQA 250 (H243)' ELSE 'Mercedes Benz C200 W205' END AS version_name,
  CASE WHEN NOT e THEN 'W205' END AS generation, CAST(CASE WHEN e THEN 2021 ELSE 2014 END AS INTEGER) AS year_start,
  CAST(CASE WHEN NOT e THEN 2018 END AS INTEGER) AS year_end, CASE WHEN e THEN 'SUV' END AS body,
  CASE WHEN e THEN 'Electric' ELSE 'Plug-In Hybrid' END AS fuel_type,
  CAST(CASE WHEN NOT e THEN 1100 + o_custkey % 800 END AS BIGINT) AS displacement_cc,
  CAST(CASE WHEN NOT e THEN 150 + o_custkey % 100 END AS BIGINT) AS horsepower_hp,
  CAST(CASE WHEN NOT e THEN 300 END AS BIGINT) AS torque_nm, CAST(NULL AS BIGINT) AS top_speed_kmh,
  CAST(CASE WHEN e THEN 100 + o_custkey % 300 END AS BIGINT) AS total_electric_power_hp,
  CASE WHEN e THEN CAST(66.5 AS DOUBLE) END AS battery_capacity_kwh, CASE WHEN e THEN '30 min (10-80%)' END AS charging_dc
FROM (SELECT *, o_orderkey % 3 = 0 AS e FROM orders WHERE o_orderkey % 3 <> 2)"""
ORACLES["r32_spec_sheets"] = SHEETS

SQL["crawl_page"] = f"""
SELECT p.p_partkey * 2 AS page_id, '{SITE}/models' AS url,
  '<html><a href="/models/Brand-P' || CAST(p.p_partkey AS STRING) || '-Class">P</a></html>' AS html FROM {{part}} p
UNION ALL SELECT p.p_partkey * 2 + 1, '{SITE}/models/Brand-P' || CAST(p.p_partkey AS STRING) || '-Class',
  '<html><h2>W' || CAST(100 + p.p_partkey % 200 AS STRING) || '</h2><a href="/car/M' || CAST(p.p_partkey AS STRING) || '/a">Class A 3 Versions</a>'
  || '<h2>W168</h2><a href="/car/M' || CAST(p.p_partkey + 1000000000 AS STRING) || '/b">Old A 2 Versions</a></html>' FROM {{part}} p
"""


def _crawl_links(s: SparkSession, d: str) -> DataFrame:
    """Links of the index and of a family page per part, plus one version link per order, on a card of its part."""
    hubs = P.page_links(frame(s, d, "crawl_page"), FAMILY_KINDS)
    k, part = F.col("o_orderkey"), F.col("o_custkey")
    model = F.when(k % 3 == 1, F.concat(F.lit(f"{SITE}/car/M"), part + 1000000000, F.lit("/b"))).otherwise(F.concat(F.lit(f"{SITE}/car/M"), part, F.lit("/a")))
    none = lambda t: F.lit(None).cast(t)
    versions = frame(s, d, "orders").select(
        k.alias("page_id"), model.alias("page_url"), F.lit("detail").alias("kind"),
        F.concat(F.lit(f"{SITE}/car/"), k, F.lit("/spec.html")).alias("url"), none("string").alias("heading"),
        none("string").alias("title"), none("int").alias("versions"), F.lit(0).alias("section"), F.lit(0).alias("position"),
    )
    return hubs.unionByName(versions)


QUERIES["r33_crawl"] = lambda s, d: P.crawl(
    frame(s, d, "sheet_page"), _crawl_links(s, d),
    frame(s, d, "orders").filter("o_orderkey % 7 = 0").select(
        F.concat(F.lit(f"{SITE}/car/"), F.col("o_orderkey"), F.lit("/spec.html")).alias("source_url")
    ),
    f"{SITE}/models", "Brand-", scraped_at=F.lit(None).cast("timestamp"),
).select("source_url", "model_family", "generation", "model_page_title", "version_name", "year_start", "horsepower_hp")
ORACLES["r33_crawl"] = f"""WITH s AS ({SHEETS}), k AS (SELECT *, CAST(regexp_extract(source_url, '/car/(\\d+)/', 1) AS BIGINT) AS o FROM s)
SELECT source_url, 'P' || CAST(p_partkey AS VARCHAR) || ' Class' AS model_family,
  CASE o % 3 WHEN 0 THEN 'W' || CAST(100 + p_partkey % 200 AS VARCHAR) ELSE 'W168' END AS generation,
  CASE o % 3 WHEN 0 THEN 'Class A' ELSE 'Old A' END AS model_page_title, version_name, year_start, horsepower_hp
FROM k JOIN orders ON o_orderkey = o JOIN part ON p_partkey = o_custkey WHERE o % 7 <> 0"""

QUERIES["r34_page_status"] = lambda s, d: frame(s, d, "pages").withColumn(
    "html", F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("<p>Cloudflare: Just a moment</p>"), "html"))
    .when(F.col("page_id") % 10 == 1, F.concat("html", F.lit("507 Insufficient Storage")))
    .when(F.col("page_id") % 10 == 2, "").otherwise(F.col("html")),
).select("page_id", P.page_status("html").alias("status"), P.failure_note("html").alias("note"))
ORACLES["r34_page_status"] = r"""WITH t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM pages)
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'challenge' WHEN 1 THEN 'server_error' WHEN 2 THEN 'empty' ELSE 'ok' END AS status,
  CASE page_id % 10 WHEN 0 THEN 'anti-bot challenge page' WHEN 1 THEN 'host storage/server error page' WHEN 2 THEN ''
    ELSE CASE WHEN length(txt) > 200 THEN substr(txt, 1, 200) || '...' ELSE txt END END AS note FROM t"""
