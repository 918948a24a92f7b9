"""URL filter by mined association rules (operator 3).

Given rules decide first: a rule fits its host and all subdomains if the url's path starts with the
rule's path, and the longest wins. For all other urls FP-growth mines combinations of url tokens that
go with a label. A rule has ``least_pages`` pages of its label behind it at every size, the
confidence, and no shorter rule of its verdict inside it. A rule is indexed by its rarest token, urls look
their tokens up in that index, and a rule matches if the url holds all its tokens. The surest rule
decides, then the one with more tokens, then block; without any the url is allowed.

Each label is mined on its own, over all tokens with ``least_pages`` pages of it; a token need not go with
the label by itself. A token that is sure alone is a rule and takes no part in longer ones, and tokens of
the very same pages are mined as one and match as one. Patterns grow from the rarest token on over
conditional baskets, equal ones merged. What grows no further cannot lead to a rule: too few pages, a rule
inside, a token that takes no page of the other label away, or too many such pages left even with every
token that could be added. So the tokens that a template repeats in every url cost nothing.

DataFrame functions only. A page is labelled by the row of ``labels`` with its id: block if it is toxic
or of quality 0, allow otherwise; null labels count as not given, conflicting rows as block. Null urls
and urls without ``://`` have empty host and path and are allowed. Each distinct url is judged once.
Without labels nothing is mined. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motoquant.llm.store import settle, table
from motoquant.operators.joins import lookup_join

# The given rules, host and path in one, with their verdicts.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@dataclass(frozen=True)
class Mining:
    confidence: float = 0.9
    least_pages: int = 20  # pages of its label behind a rule, whatever their share of all
    lean: float | None = None  # if given, only tokens whose share is so many standard errors above that of all pages


def url_host(url: Column) -> Column:
    rest = _rest(url)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, path segments and query names; numbers count as one token."""
    plain = lambda x: F.regexp_replace(F.lower(x), r"[0-9]+", "0")
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), plain(x)))
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.coalesce(F.array_distinct(F.concat(tagged("h:", F.split(url_host(url), r"\.")), tagged("p:", F.split(url_path(url), "/")), tagged("q:", names))), F.array())


def given_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Url with the longest fitting rule; urls without one are left out. ``rules``: verdict, rule."""
    split = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("suffix"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    rows = urls.filter("host <> ''").select("url", "path", F.explode(suffixes).alias("suffix"))
    fits = lookup_join(rows, split, "suffix", "inner").filter(F.startswith("path", F.col("start")))
    # of equally long rules, block, then the alphabet
    rank = F.struct(F.length("rule").alias("size"), F.col("verdict"), F.col("rule"))
    return fits.groupBy("url").agg(F.max(rank).alias("r")).select("url", "r.rule", "r.verdict")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.filter(F.col("toxic").isNotNull() | F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    return pages.filter(F.col("url").isNotNull()).join(known, "page_id").select("url", F.when(F.col("bad"), "block").otherwise("allow").alias("label"))


def token_shares(baskets: DataFrame) -> DataFrame:
    """Pages and pages by label of every token, with a name for the set of its pages. ``baskets``: basket, label, own."""
    rows = baskets.select("label", F.xxhash64("basket").alias("p"), F.xxhash64("basket", F.lit(1)).alias("q"), F.explode("own").alias("token"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return rows.groupBy("token").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("label") == "block").alias("block"), F.count_if(F.col("label") == "allow").alias("allow"),
        F.struct(total("p").alias("p"), total("q").alias("q")).alias("same"),
    )


def parts_of(shares: DataFrame, verdict: str, counts: dict[str, int], mining: Mining) -> DataFrame:
    """Tokens with enough pages of the verdict's label; those on the very same pages are one part."""
    base = counts.get(verdict, 0) / max(sum(counts.values()), 1)
    share = F.col(verdict) / F.col("pages")
    # a rule has no more pages of its label than any token of it
    tokens = shares.filter(F.col(verdict) >= mining.least_pages)
    if mining.lean is not None:
        tokens = tokens.filter(share - base >= mining.lean * F.sqrt(F.lit(base * (1 - base)) / F.col("pages"))).filter(share > base)
    part = tokens.groupBy("pages", verdict, "same").agg(F.min("token").alias("token"), F.array_sort(F.collect_set("token")).alias("members"))
    # a token on every page of the other label makes no combination surer
    narrows = F.col("pages") - F.col(verdict) < sum(n for label, n in counts.items() if label != verdict)
    return part.select(F.lit(verdict).alias("verdict"), "token", "members", "pages", share.alias("confidence"), narrows.alias("narrows"))


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules: tokens, parts, verdict, confidence and anchor, one row per token of the rarest part.

    A part is a set of tokens that stand on the same labelled pages; a url has it if it has one of them.
    ``tokens`` names each part by its first token. ``labelled``: url and label.
    """
    own = url_tokens(F.col("url")).alias("own")
    baskets = settle(labelled.select(F.monotonically_increasing_id().alias("basket"), "label", own), "baskets")
    shares = settle(token_shares(baskets), "token-shares")
    counts = {r["label"]: r["n"] for r in baskets.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = settle(reduce(DataFrame.unionByName, [parts_of(shares, v, counts, mining) for v in ("allow", "block")]), "parts")
    sure = F.col("confidence") >= mining.confidence
    alone = part.filter(sure).select(F.array("token").alias("tokens"), F.array("members").alias("parts"), "verdict", "confidence", F.col("members").alias("rarest"))
    unsure = part.filter(~sure & F.col("narrows")).select("verdict", "token", "members", "pages")
    rows = baskets.select("basket", "label", F.explode("own").alias("token"))
    items = lookup_join(rows, unsure.drop("members"), "token", "inner").groupBy("basket", "label", "verdict").agg(F.array_sort(F.collect_list(F.struct("pages", "token"))).alias("rest"))
    # as in a tree of patterns, equal baskets are one
    hit = F.count_if(F.col("label") == F.col("verdict"))
    merged = items.groupBy("verdict", "rest").agg(hit.alias("hits"), (F.count(F.lit(1)) - hit).alias("misses"))
    found = _grown(settle(merged, "merged"), mining)
    rules = alone if found is None else alone.unionByName(_with_parts(found, unsure))
    return rules.select("tokens", "parts", "verdict", "confidence", F.explode("rarest").alias("anchor"))


def _grown(baskets: DataFrame, mining: Mining) -> DataFrame | None:
    """Sure patterns without a shorter one inside them: verdict, pattern and confidence. No token is sure alone.

    A level holds the conditional baskets of its patterns: ``rest`` are the tokens that may still be added, from
    the rarest on, ``hits`` and ``misses`` the pages with the verdict's label and with the other. ``room`` counts
    the tokens that any basket of the pattern has left, ``total`` and ``left`` the pattern's hits and misses.
    """
    none = F.lit(None).cast("long")
    level = baskets.select("verdict", F.array().cast("array<string>").alias("pattern"), "rest", "hits", "misses", none.alias("left"))
    found = None
    for size in count(1):
        longer = level.select("verdict", "pattern", "left", "hits", "misses", F.explode("rest").alias("item"))
        kept = longer.groupBy("verdict", "pattern", "left", "item").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
        # a token that takes no miss away leaves a shorter pattern at least as sure
        narrows = F.col("left").isNull() | (F.col("misses") < F.col("left"))
        kept = kept.filter((F.col("hits") >= mining.least_pages) & narrows)
        kept = kept.select("verdict", "pattern", "item", "hits", "misses", F.array_append("pattern", F.col("item.token")).alias("longer"), (F.col("hits") / (F.col("hits") + F.col("misses"))).alias("confidence"))
        kept = settle(kept if found is None else _minimal(kept, found), f"kept-{size}")
        if kept.isEmpty():
            return found
        sure = F.col("confidence") >= mining.confidence
        rules = kept.filter(sure).select("verdict", F.col("longer").alias("pattern"), "confidence")
        found = rules if found is None else found.unionByName(rules)
        tails = kept.filter(~sure).groupBy("verdict", "pattern").agg(F.array_sort(F.collect_list(F.struct("item", "hits", "misses"))).alias("tail"))
        level = settle(_next(lookup_join(level.drop("left"), tails, ["verdict", "pattern"], "inner")), f"level-{size}")
        # the misses that all tokens together leave are the fewest that any pattern from here on can have
        fewest = F.coalesce(F.sum(F.when(F.size("rest") == F.col("room"), F.col("misses"))), F.lit(0))
        best = F.col("total") / (F.col("total") + F.col("fewest"))
        over = level.groupBy("verdict", "pattern", "total").agg(fewest.alias("fewest")).filter(best < mining.confidence).select("verdict", "pattern")
        level = level.join(over, ["verdict", "pattern"], "left_anti")
    return found


def _next(level: DataFrame) -> DataFrame:
    """Conditional baskets of the patterns with one token more out of ``tail``, equal ones merged."""
    rest = F.filter("rest", lambda x: F.exists("tail", lambda t: t["item"] == x))
    each = level.select("verdict", "pattern", rest.alias("rest"), "tail", "hits", "misses").select("*", F.posexplode("rest").alias("at", "item"))
    place = F.array_position(F.transform("tail", lambda t: t["item"]), F.col("item"))
    here = F.element_at("tail", place.cast("int"))
    each = each.select(
        "verdict", F.array_append("pattern", F.col("item.token")).alias("pattern"), F.expr("slice(rest, at + 2, size(rest))").alias("rest"),
        here["hits"].alias("total"), here["misses"].alias("left"), (F.size("tail") - place).alias("room"), "hits", "misses",
    )
    return each.filter(F.size("rest") > 0).groupBy("verdict", "pattern", "rest", "total", "left", "room").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))


def _minimal(kept: DataFrame, found: DataFrame) -> DataFrame:
    """Patterns without a rule inside them. A rule is looked up by its first token, the rarest."""
    long = kept.select("verdict", "longer", F.explode("longer").alias("token"))
    short = found.select("verdict", F.element_at("pattern", 1).alias("token"), F.col("pattern").alias("inner"))
    inside = lookup_join(long, short, ["verdict", "token"], "inner").filter(F.size(F.array_except("inner", "longer")) == 0)
    return kept.join(inside.select("verdict", "longer").distinct(), ["verdict", "longer"], "left_anti")


def _with_parts(rules: DataFrame, parts: DataFrame) -> DataFrame:
    """The members of every part of a rule, and those of its rarest."""
    rows = lookup_join(rules.select("verdict", F.array_sort("pattern").alias("tokens"), "confidence", F.explode("pattern").alias("token")), parts, ["verdict", "token"], "inner")
    return rows.groupBy("tokens", "verdict", "confidence").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("token", "members"))), lambda x: x["members"]).alias("parts"),
        F.min_by("members", F.struct("pages", "token")).alias("rarest"),
    )


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Url with the verdict of the best matching rule; urls without one are left out."""
    rows = urls.select("url", url_tokens(F.col("url")).alias("own")).select("url", "own", F.explode("own").alias("anchor"))
    hits = lookup_join(rows, rules, "anchor", "inner").filter(F.forall("parts", lambda p: F.arrays_overlap(p, "own")))
    best = F.max(F.struct("confidence", F.size("tokens").alias("n"), "verdict"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.verdict").alias("mined"))


def judge_pages(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url")
    url = F.col("url")
    urls = pages.filter(url.isNotNull()).select("url").distinct().select("url", url_host(url).alias("host"), url_path(url).alias("path"))
    given = settle(given_verdicts(urls, spark.createDataFrame(rules, "verdict string, rule string")), "given")
    mined = settle(mine(labelled_urls(pages, labels), mining), "rules")
    rest = urls.join(given, "url", "left_anti")
    judged = given.select("url", "rule", "verdict").unionByName(mined_verdicts(rest, mined).select("url", F.lit(None).cast("string").alias("rule"), F.col("mined").alias("verdict")))
    return pages.join(judged, "url", "left").select(
        "page_id", url_host(url).alias("host"), url_path(url).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
