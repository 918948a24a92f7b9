"""Golden values of the normalising projections."""

from pyspark.sql import functions as F

from motoquant.functions import measures as M
from motoquant.functions import noise as N
from motoquant.functions import specsheet as S
from motoquant.functions import urls as U
from motoquant.functions import vocab as V
from motoquant.functions.numeric import clip, round_even, to_number
from motoquant.operators.answers import question_kind
from motoquant.operators.bookings import reply_intent


def test_canonical_class(values):
    texts = [" S Class", "Mercedes-Benz E 220", "E-Klasse", "ml350", "200", None, "AMG GT", "CLA CLASS", "XA CLASS", "GLC-Class"]
    assert values(texts, V.canonical_class) == ["S", "E", "E", "M", None, None, None, "CLA", "A", "GLC"]


def test_class_label(values):
    texts = [" SLK", "SL CLASS", "C Class", "GL Class", "CLS Class", "230", "c-coupe", "A COUPE", "Unknown"]
    assert values(texts, V.class_label) == [
        "SLK_CLASS", "SL_CLASS", "C_CLASS", "GL_CLASS", "CLS_CLASS", None, "C_CLASS", None, None,
    ]


def test_title_class_word_bounds(spark):
    rows = [
        ("2018 Mercedes-Benz C-Class", "", "", "C_CLASS"), ("Mercedes Benz C200", "", "", "C_CLASS"),
        ("Mercedes-AMG GT S", "", "", "AMG_GT_CLASS"), ("Mercedes CLA 45", "", "", "CLA_CLASS"),
        ("Mercedes GL350", "", "", "GL_CLASS"), ("Toyota Vios", "Toyota", "", None),
        ("anything", "", "GLE", "GLE_CLASS"), ("Mercedes-Benz Sprinter", "", "", None),
    ]
    df = spark.createDataFrame(rows, "t string, m string, g string, want string")
    got = df.select("want", V.title_class("t", "m", "g", "mercedes").alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    loose = df.limit(1).select(V.title_class("t", "m", "g", "mercedes", bounded=False)).first()[0]
    assert loose == "CLA_CLASS"


def test_vocabularies(values):
    assert values(["Semi-automatic", "Unknown", None], V.training_transmission) == ["Semi-Auto", "Other", "Other"]
    assert values(["gas", "Diesel Hybrid", "06/2009"], V.training_fuel) == ["Petrol", "Hybrid", "Other"]
    assert values(["plug-in hybrid", " at ", "", None], V.listing_fuel) == ["Plug-In Hybrid", "At", None, None]
    assert values(["AT", "mt", "semi x", "dsg-7 speed"], V.listing_transmission) == ["Automatic", "Manual", "Semi-Auto", "Dsg-7 Speed"]


def test_badges_and_measures(values):
    assert values(["E 220", "ml350", "s-class"], M.badge_litres) == [2.2, 3.5, None]
    assert values(["140 mph (225 km/h)", None], M.kmh) == [225.0, None]
    assert values(["225/45 R17", "vented disc", "drum", None], M.brake_type) == ["Unknown", "Ventilated Discs", "Drums", "Unknown"]
    assert values(["9-speed manual automatic", "6-speed manual", "DCT"], M.gear_type) == ["automatic", "manual", "dct"]


def test_price_mileage_date(values):
    assert values(["RM 149,000", "POA", None], M.price_rm) == [149000, None, None]
    texts = ['{"gte": "35000", "lte": "39999"}', "35k - 40k", "85k", "120,000 km", "n/a", None, '{"gte": 10}', "1000k"]
    assert values(texts, M.mileage_km) == [37499, 37000, 85000, 120000, None, None, 10, 1000]
    dates = ["2026-07-02", "2/7/2026", "02-07-2026", "2026/7/2", "2026-07-02T10:00:00Z", "1720000000", "soon", None]
    assert values(dates, M.posted_date) == ["2026-07-02"] * 5 + ["2024-07-03", None, None]


def test_seller_and_first_filled(spark):
    df = spark.createDataFrame([("Dealer X", None, " "), ("", "true", "b"), (None, "0", None), (None, None, "c")], "p string, f string, z string")
    assert [r[0] for r in df.select(V.seller_type("p", "f")).collect()] == ["dealer", "dealer", "private", "unknown"]
    assert [r[0] for r in df.select(V.first_filled("z", "p")).collect()] == ["Dealer X", "b", None, "c"]


def test_urls(spark):
    base = "https://www.x.com/a/b/c.htm?q=1#f"
    hrefs = {"/d": "https://www.x.com/d", "e": "https://www.x.com/a/b/e", "../e": "https://www.x.com/a/e",
             "//y.com/z": "https://y.com/z", "http://k/l": "http://k/l", "?p=2": "https://www.x.com/a/b/c.htm?p=2", "": None}
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    assert [r[0] for r in df.select(U.absolute_url("b", "h")).collect()] == list(hrefs.values())
    one = spark.createDataFrame([("https://S.com/m/Brand-A-Class/#x%20y",)], "u string")
    row = one.select(U.url_host("u"), U.slug_name("u", "Brand-"), U.canonical_url("u")).first()
    assert tuple(row) == ("s.com", "A Class", "https://S.com/m/Brand-A-Class/")


def test_spec_labels_and_years(spark, values):
    labels = ["horsepower", "charging time dc 100 kw", "charging time wallbox", "fuel consumption - urban", "fuel economy extra urban", "colour"]
    assert values(labels, S.label_field) == [
        "horsepower_hp", "charging_dc", "charging_wallbox", "consumption_city_l100km", "consumption_openroad_l100km", None,
    ]
    df = spark.createDataFrame([("horsepower_hp", "190 HP / 140 kW"), ("torque_nm", "277 lb-ft 1,375 Nm"), ("accel_0_100_s", "8.9 s"), ("body", "-")], "f string, v string")
    assert [r[0] for r in df.select(S.field_value("f", "v")).collect()] == ["190", "1375", "8.9", None]
    titles = spark.createDataFrame([("Mercedes A", "(2021 - present)"), ("Mercedes", "Technical Specifications for Years 2015, 2013"),
                                    ("Mercedes 2001 2007", ""), ("Mercedes W204 2011", ""), ("Mercedes W205", ""), ("Mercedes", "")], "t string, b string")
    got = [tuple(r[0]) for r in titles.select(S.sheet_years("t", "b")).collect()]
    assert got == [(2021, None), (2013, 2015), (2001, 2007), (2011, 2014), (2014, 2018), (None, None)]


def test_numbers(spark, values):
    assert values(["12", " 1.5 ", "1e3", "x", "NaN", "1.5d", ""], to_number) == [12.0, 1.5, 1000.0, None, None, None, None]
    assert values([0.5, 1.5, 2.5, None], lambda c: round_even(c), "double") == [0.0, 2.0, 2.0, None]
    assert values([-1.0, 0.5, 9.0, None], lambda c: clip(F.col(c), 0, 1), "double") == [0.0, 0.5, 1.0, None]


def test_intents_and_questions(values):
    texts = ["CONFIRM", "Yes, that works", "That slot is taken", "no", "Maybe later", "", "can't do", "not available, ok?"]
    assert values(texts, reply_intent) == [
        "confirmed", "confirmed", "unavailable", "unavailable", "unclear", "unclear", "unavailable", "unavailable",
    ]
    asked = ["Hey advisor!", "thank   you", "Why?", "tell me a joke", "should I sell", "worth it?", "Got it", "!!"]
    assert values(asked, question_kind) == [
        "greeting", "thanks", "follow_up", "outside", "sell", "advice", "acknowledgement", "outside",
    ]


def test_noise_is_stable_and_shaped(spark):
    df = spark.range(20000).select(
        "id", N.gaussian(["id"], "g", 42, 2.0).alias("g"), N.poisson(F.lit(1.5), ["id"], "p", 42).alias("p"),
        N.uniform(["id"], "u", 42).alias("u"),
    )
    m = df.agg(F.avg("g"), F.stddev("g"), F.avg("p"), F.var_samp("p"), F.min("u"), F.max("u")).first()
    assert abs(m[0]) < 0.06 and abs(m[1] - 2) < 0.06 and abs(m[2] - 1.5) < 0.05 and abs(m[3] - 1.5) < 0.08
    assert 0 < m[4] and m[5] < 1
    other = spark.range(20000).repartition(13).select("id", N.gaussian(["id"], "g", 42, 2.0).alias("g"), N.poisson(F.lit(1.5), ["id"], "p", 42).alias("p"), N.uniform(["id"], "u", 42).alias("u"))
    assert df.exceptAll(other).count() == 0
