"""Nearest sites by great-circle distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motoquant.config import DEFAULT, Rules
from motoquant.operators.joins import lookup_join
from motoquant.sources.tables import materialise

SITES_PER_CHUNK = 5_000
LEVELS = tuple(range(1, 20, 2))  # cells of 2 / 2**level earth radii; the finest are some 24 m wide
UNIT_LEVEL = 16  # vehicles of one cell of this level are searched for together
LEAF_SITES = 16  # a cell of so many sites is not divided further
SLACK = 1e-9  # in earth radii: more than rounding can move a distance

_AXES = ("x", "y", "z")


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rules: Rules = DEFAULT) -> Column:
    half_lat, half_lng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * rules.earth_radius_km * F.asin(F.sqrt(a))


# --- index of cells ----------------------------------------------------------------------------


def _on_sphere(df: DataFrame) -> DataFrame:
    """Rows with a position, as points of the unit sphere: no seam at the date line, no poles."""
    lat, lng = F.radians("lat"), F.radians("lng")
    placed = df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    return placed.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def _cell(level: Column | int) -> Column:
    """Key of the cube of the given level that holds the point x, y, z."""
    level = F.lit(level) if isinstance(level, int) else level
    sides = F.pow(F.lit(2.0), level)
    whole = [F.least(F.floor((F.col(a) + 1) / 2 * sides), sides.cast("long") - 1).cast("long") for a in _AXES]
    return (whole[0] * (1 << 20) + whole[1]) * (1 << 20) + whole[2]


def _boxes() -> list[Column]:
    return [f(a).alias(f"{name}_{a}") for a in _AXES for f, name in ((F.min, "low"), (F.max, "high"))]


def _nearest(a: str, b: str) -> Column:
    """Square of the least chord between two boxes, and below of the largest."""
    gaps = [F.greatest(F.lit(0.0), F.col(f"{a}_low_{x}") - F.col(f"{b}_high_{x}"), F.col(f"{b}_low_{x}") - F.col(f"{a}_high_{x}")) for x in _AXES]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _farthest(a: str, b: str) -> Column:
    spans = [F.greatest(F.col(f"{a}_high_{x}") - F.col(f"{b}_low_{x}"), F.col(f"{b}_high_{x}") - F.col(f"{a}_low_{x}")) for x in _AXES]
    return spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]


def site_cells(placed: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Every occupied cell of every level with its parent, number of sites and tight box: one aggregation."""
    steps = [F.struct(F.lit(l).alias("level"), F.lit(p).alias("up")) for l, p in zip(levels, (0, *levels[:-1]))]
    spread = placed.select(*_AXES, F.inline(F.array(*steps)))
    keyed = spread.select(*_AXES, "level", _cell(F.col("level")).alias("cell"), F.when(F.col("up") > 0, _cell(F.col("up"))).alias("parent"))
    return keyed.groupBy("level", "cell").agg(F.first("parent").alias("parent"), F.count(F.lit(1)).alias("sites"), *_boxes())


def _prune(frontier: DataFrame, k: int) -> DataFrame:
    """Cells that may hold one of the k nearest sites of any vehicle of the unit.

    The k-th distance is at most the reach of the nearest cells that together hold k sites.
    """
    by_reach = Window.partitionBy("unit").orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = frontier.withColumn("_seen", F.sum("sites").over(by_reach))
    reach = F.min(F.when(F.col("_seen") >= k, F.col("far"))).over(Window.partitionBy("unit"))
    bounded = counted.withColumn("_reach", reach)
    return bounded.filter(F.col("_reach").isNull() | (F.sqrt("near") <= F.sqrt("_reach") + SLACK)).drop("_seen", "_reach")


def candidate_cells(units: DataFrame, cells: DataFrame, k: int, levels: tuple[int, ...] = LEVELS, leaf_sites: int = LEAF_SITES, rules: Rules = DEFAULT) -> DataFrame:
    """unit, level and cell: undivided cells in which the k nearest sites of a unit's vehicles lie.

    From the coarsest level down, cells are replaced by their occupied children (an equi-join on the
    cell) and pruned, until all are small. Each level is written to the shared folder.
    """
    box = [f"{s}_{a}" for a in _AXES for s in ("low", "high")]
    named = cells.select("level", "cell", "parent", "sites", *[F.col(c).alias(f"c_{c}") for c in box])
    unit = units.select("unit", *[F.col(c).alias(f"u_{c}") for c in box])
    out = ["unit", *[f"u_{c}" for c in box], "level", "cell", "sites", "near", "far"]

    def measured(df: DataFrame) -> DataFrame:
        return df.withColumn("near", _nearest("u", "c")).withColumn("far", _farthest("u", "c")).select(*out)

    # the coarsest level has eight cells at most; they are dealt to every unit as a constant
    roots = [r.asDict() for r in named.filter(F.col("level") == levels[0]).drop("parent").collect()]
    if not roots:
        return units.select("unit", F.lit(0).alias("level"), F.lit(0).cast("long").alias("cell")).limit(0)
    constant = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.items()]) for r in roots])
    frontier = materialise(_prune(measured(unit.select("*", F.inline(constant))), k), "site-frontier")
    for level, below in zip(levels, levels[1:]):
        large = (F.col("level") == level) & (F.col("sites") > leaf_sites)
        if frontier.filter(large).isEmpty():
            break
        children = named.filter(F.col("level") == below).drop("level").withColumnRenamed("cell", "child").withColumnRenamed("sites", "child_sites")
        opened = lookup_join(
            frontier.filter(large).select("unit", *[f"u_{c}" for c in box], F.col("cell").alias("parent")), children, "parent", "inner", rules
        ).withColumn("level", F.lit(below)).withColumnRenamed("child", "cell").withColumnRenamed("child_sites", "sites")
        frontier = materialise(_prune(frontier.filter(~large).select(*out).unionByName(measured(opened)), k), "site-frontier")
    return frontier.select("unit", "level", "cell")


def _first_of_place(sites: DataFrame, k: int, rules: Rules) -> DataFrame:
    """Of the sites at one position only those of the k smallest ids can be among k nearest.

    Ranked in salted parts first, so a position that many sites share is split.
    """
    place = ["lat", "lng"]
    parts = sites.withColumn("_salt", F.pmod(F.xxhash64("site_id"), F.lit(rules.salt_buckets)))
    for keys in ([*place, "_salt"], place):
        order = Window.partitionBy(*keys).orderBy("site_id")
        parts = parts.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")
    return parts.drop("_salt")


def nearest_sites(vehicles: DataFrame, sites: DataFrame, k: int | None = None, rules: Rules = DEFAULT) -> DataFrame:
    """Sites ranked by distance per vehicle, the nearest ``k`` of them or all. Ties go to the smaller id.

    For ``k`` sites, an index of cells finds, for all vehicles of a small cell at once, the cells that can
    hold one of their k nearest; a vehicle ranks the few sites of these inside its own row. The answer is
    exact anywhere on the sphere, and no vehicle meets all sites. Without ``k`` every pair is asked for.
    Rows without a position are left out.

    ``vehicles``: vehicle_id, lat, lng. ``sites``: site_id, lat, lng.
    """
    bounds = sites.agg(
        F.min("lat").alias("_lat0"), F.max("lat").alias("_lat1"), F.min("lng").alias("_lng0"), F.max("lng").alias("_lng1")
    )
    if k is None:
        packed = sites.groupBy(F.pmod(F.xxhash64("site_id"), F.lit(max(1, -(-sites.count() // SITES_PER_CHUNK)))).alias("_chunk")).agg(
            F.collect_list(F.struct("site_id", "lat", "lng")).alias("_sites")
        )
        pairs = vehicles.join(packed)
    else:
        placed = materialise(_on_sphere(_first_of_place(sites.select("site_id", "lat", "lng"), k, rules)), "sites")
        searched = _on_sphere(vehicles.select("vehicle_id", "lat", "lng")).withColumn("unit", _cell(UNIT_LEVEL))
        units = searched.groupBy("unit").agg(*_boxes())
        found = candidate_cells(units, materialise(site_cells(placed), "site-cells"), k, rules=rules)
        wanted = found.select("level", "cell").distinct()
        by_level = placed.select("site_id", "lat", "lng", *_AXES, F.explode(F.array(*[F.lit(l) for l in LEVELS])).alias("level"))
        leaves = lookup_join(by_level.select("site_id", "lat", "lng", "level", _cell(F.col("level")).alias("cell")), wanted, ["level", "cell"], "inner", rules)
        packed = found.join(leaves, ["level", "cell"]).groupBy("unit").agg(F.collect_list(F.struct("site_id", "lat", "lng")).alias("_sites"))
        pairs = lookup_join(searched.select("vehicle_id", "lat", "lng", "unit"), materialise(packed, "site-candidates"), "unit", "inner", rules)
    ranked = F.array_sort(F.transform(
        "_sites",
        lambda s: F.struct(
            haversine_km(F.col("lat"), F.col("lng"), s["lat"], s["lng"], rules).alias("distance_km"),
            s["site_id"].alias("site_id"), s["lat"].alias("site_lat"), s["lng"].alias("site_lng"),
        ),
    ))
    best = ranked if k is None else F.slice(ranked, 1, k)
    out = pairs.select("vehicle_id", "lat", "lng", F.posexplode(best).alias("_p", "s")).join(F.broadcast(bounds))
    if k is None:
        order = Window.partitionBy("vehicle_id").orderBy("s.distance_km", "s.site_id")
        out = out.withColumn("rank", F.row_number().over(order))
    else:
        out = out.withColumn("rank", F.col("_p") + 1)

    def scaled(value: Column, low: Column, high: Column) -> Column:
        span = high - low
        return (value - low) / F.when(span == 0, 1.0).otherwise(span)

    x = scaled(F.col("s.site_lng"), F.least("_lng0", "lng"), F.greatest("_lng1", "lng"))
    y = scaled(F.col("s.site_lat"), F.least("_lat0", "lat"), F.greatest("_lat1", "lat"))
    return out.select(
        "vehicle_id", "rank", F.col("s.site_id").alias("site_id"), F.col("s.distance_km").alias("distance_km"),
        (12 + x * 76).alias("map_x"), (88 - y * 76).alias("map_y"),
    )
