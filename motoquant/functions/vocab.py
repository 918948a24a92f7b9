"""Class labels, transmissions, fuels and other closed vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from motoquant.functions.numeric import _c, first_match, let

# Class tokens in matching order, and the one alias.
CLASS_TOKENS = [
    "CLA", "CLC", "CLK", "CLS", "CL", "GLA", "GLB", "GLC", "GLE", "GLS",
    "GLK", "GL", "SLK", "SLC", "SLR", "SLS", "SL", "EQ", "ML", "A", "B",
    "C", "E", "G", "M", "R", "S", "V", "X",
]
CLASS_ALIAS = {"ML": "M"}
BRAND_WORDS = r"MERCEDES[- ]?BENZ|BENZ|MERCEDES|AMG"
GERMAN_CLASS_WORDS = r"-KLASSE|KLASSE|-CLASS"

# Classes with an exact label, and those that also come as a coupe.
LABEL_CLASSES = [
    "A", "B", "C", "E", "S", "SL", "SLK", "CLA", "GLC", "GLE", "GLA",
    "G", "GL", "CLS", "CL", "V", "M", "GLS", "CLC", "R",
]
LABEL_COUPES = ["C", "E", "S"]

# Listing-title tokens, in matching order. The first group also
# matches bare; the second needs the word "class" behind it.
TITLE_SPECIAL = ("MERCEDES-AMG GT", "AMG_GT_CLASS")
TITLE_BARE = ["GLS", "GLE", "GLC", "GLA", "CLA", "CLS", "CLC", "CLK", "SLK"]
TITLE_WORDED = ["SL", "GL", "V", "M", "R", "CL", "G", "A", "B", "C", "E", "S"]
TITLE_VARIANT = r"\b(GLA|GLB|GLC|GLE|GLS|CLA|CLS|CLK|SLK|SL|GL|CL|[ABCESGV])\s*-?\s*(\d{2,3})\b"


def _first_listed(tokens: list[str], found: Column) -> Column:
    """The earliest of the ordered tokens that occurs among the found ones."""
    return F.get(F.array_intersect(F.array(*[F.lit(t) for t in tokens]), found), F.lit(0))


def canonical_class(text: Column | str) -> Column:
    """First class token of the ordered list present in a raw model name, null when none is.

    A token counts as a whole word, as a word followed by digits, or right before "CLASS". All
    candidates are cut out in four passes and then ranked, rather than testing token by token.
    """
    t = F.regexp_replace(F.upper(_c(text)), BRAND_WORDS, " ")
    t = F.regexp_replace(t, GERMAN_CLASS_WORDS, " CLASS")
    labels = F.create_map(*[F.lit(x) for c in CLASS_TOKENS for x in (c, CLASS_ALIAS.get(c, c))])

    def pick(t: Column) -> Column:
        words = F.regexp_extract_all(t, F.lit(rf"\b({'|'.join(CLASS_TOKENS)})(?:\b|(?=\d))"), 1)
        before = [F.regexp_extract_all(t, F.lit(rf"(?=({'.' * n}) CLASS)"), 1) for n in (1, 2, 3)]
        found = F.when(t.contains(" CLASS"), F.concat(words, *before)).otherwise(words)
        return F.try_element_at(labels, _first_listed(CLASS_TOKENS, found))

    return let(t, pick)


def class_label(text: Column | str) -> Column:
    """Exact spelling to ``X_CLASS`` label; numeric-only and unknown spellings give null."""
    t = F.upper(F.trim(_c(text)))
    # one pattern: a coupe spelling leaves the first group empty and fills the second
    form = rf"^(?:({'|'.join(LABEL_CLASSES)})(?:[ -]CLASS)?|({'|'.join(LABEL_COUPES)})[ -]COUPE)$"
    return F.when(t.rlike(form), F.concat(F.regexp_extract(t, r"^([A-Z]+)", 1), F.lit("_CLASS")))


def is_brand(make: Column | str, title: Column | str, brand: str) -> Column:
    text = F.lower(F.concat_ws(" ", _c(make), _c(title)))
    return text.contains(brand)


def title_class(
    title: Column | str,
    make: Column | str,
    model_group: Column | str,
    brand: str,
    bounded: bool = True,
) -> Column:
    """Class label of a listing title: model group, then title tokens, then a badge such as C200.

    ``bounded`` asks for whole-word tokens, so that "C-Class" is not read as CLA.
    """
    hay = F.upper(F.concat_ws(" ", F.coalesce(_c(make), F.lit("")), F.coalesce(_c(title), F.lit(""))))
    from_group = class_label(F.replace(_c(model_group), F.lit("-"), F.lit(" ")))
    by_title = F.when(is_brand(make, title, brand), let(hay, lambda h: _class_in_title(h, bounded)))
    return F.coalesce(from_group, by_title)


def _class_in_title(hay: Column, bounded: bool) -> Column:
    if bounded:
        end = r"(?:\b|(?=\d))"
        bare = F.regexp_extract_all(hay, F.lit(rf"\b({'|'.join(TITLE_BARE)}){end}"), 1)
        worded = F.regexp_extract_all(hay, F.lit(rf"\b({'|'.join(TITLE_WORDED)})[- ]CLASS{end}"), 1)
    else:
        held = lambda token, form: F.when(hay.contains(form), F.lit(token))
        bare = F.array(*[held(t, t) for t in TITLE_BARE])
        worded = F.array(*[
            F.coalesce(held(t, f"{t}-CLASS"), held(t, f"{t} CLASS")) for t in TITLE_WORDED
        ])
    token = F.coalesce(_first_listed(TITLE_BARE, bare), _first_listed(TITLE_WORDED, worded))
    special = F.when(hay.contains(TITLE_SPECIAL[0]), F.lit(TITLE_SPECIAL[1]))
    badge = class_label(first_match(hay, TITLE_VARIANT))
    return F.coalesce(special, F.concat(token, F.lit("_CLASS")), badge)


def training_transmission(text: Column | str) -> Column:
    t = F.lower(F.trim(_c(text)))
    return (
        F.when(t.contains("manual"), "Manual")
        .when(t.contains("semi"), "Semi-Auto")
        .when(t.contains("auto"), "Automatic")
        .otherwise("Other")
    )


def training_fuel(text: Column | str) -> Column:
    t = F.lower(F.trim(_c(text)))
    return (
        F.when(t.contains("hybrid"), "Hybrid")
        .when(t.contains("elect"), "Electric")
        .when(t.contains("diesel"), "Diesel")
        .when(t.isin("petrol", "gas", "gasoline"), "Petrol")
        .otherwise("Other")
    )


def title_case(text: Column | str) -> Column:
    """Capitalise after every non-letter, not only after blanks as ``initcap`` does."""
    letters = F.split(F.lower(_c(text)), "")
    done = F.aggregate(
        letters,
        F.struct(F.lit("").alias("out"), F.lit(True).alias("start")),
        lambda acc, ch: F.struct(
            F.concat(acc["out"], F.when(acc["start"], F.upper(ch)).otherwise(ch)).alias("out"),
            (~ch.rlike(r"\p{L}")).alias("start"),
        ),
        lambda acc: acc["out"],
    )
    # initcap is the cheap path whenever no letter follows another separator
    return F.when(_c(text).rlike(r"[^\p{L}\s]\p{L}"), done).otherwise(F.initcap(_c(text)))


def listing_transmission(text: Column | str) -> Column:
    t = F.nullif(F.trim(_c(text)), F.lit(""))
    low = F.lower(t)
    return (
        F.when(low.isin("auto", "automatic", "at"), "Automatic")
        .when(low.isin("manual", "mt"), "Manual")
        .when(low.contains("semi"), "Semi-Auto")
        .otherwise(title_case(t))
    )


def listing_fuel(text: Column | str) -> Column:
    return title_case(F.nullif(F.trim(_c(text)), F.lit("")))


def seller_type(profile: Column | str, company_flag: Column | str) -> Column:
    p = F.lower(_c(profile))
    flag = F.lower(_c(company_flag).cast("string"))
    return (
        F.when(p.contains("dealer"), "dealer")
        .when(p.contains("private") | p.contains("owner"), "private")
        .when(flag.isin("1", "true"), "dealer")
        .when(flag.isin("0", "false"), "private")
        .otherwise("unknown")
    )


def first_filled(*columns: Column | str) -> Column:
    """First value that is neither null nor blank; the value itself is not trimmed."""
    return F.coalesce(*[F.when(F.trim(_c(c)) != "", _c(c)) for c in columns])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
