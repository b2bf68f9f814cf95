"""Points near other points, and the regions that hold them: dual-tree joins.

Places become nodes of a tree (an octree over unit vectors for distances, so the
date line and the poles need no care; a quadtree over latitude and longitude for
regions). Level by level a frontier of node pairs is joined with the children of
both: pairs whose bounding boxes are too far apart are discarded, pairs certainly
within reach are accepted as a whole, the rest goes on to the next level, and only
small uncertain leaves are compared point by point. Each level is one distributed
join; nothing is collected.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.scratch import cut

EARTH_M = 6_371_008.8
BITS = 21  # of a packed cell code, per dimension
LEAF = 4_096  # pairs of points two leaves may have before they are split further
BROADCAST_BYTES = 32 << 20


def usable_places(df: DataFrame, id_col: str, lat: str = "lat", long: str = "long") -> DataFrame:
    """Distinct (id, lat, long) with a non-null id, coordinates in range, not null, NaN or both zero."""
    rows = df.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{lat}`").try_cast("double").alias("lat"), F.col(f"`{long}`").try_cast("double").alias("long"))
    inside = (F.abs("lat") <= 90) & (F.abs("long") <= 180) & ~((F.col("lat") == 0) & (F.col("long") == 0))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(inside & ~F.isnan("lat") & ~F.isnan("long"), F.lit(False))).distinct()


def distance_m(lat1: Column, long1: Column, lat2: Column, long2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(long2 - long1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _axis(x: Column, level: int) -> Column:
    side = 1 << level
    return F.least(F.floor((x + 1) / 2 * side), F.lit(side - 1)).cast("long")


def _code(axes: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, BITS * i) for i, x in enumerate(axes)])


def _up(code: Column, levels: int) -> Column:
    """The code of the ancestor ``levels`` above."""
    mask = F.lit((1 << BITS) - 1).cast("long")
    return _code([F.shiftright(F.shiftright(code, BITS * i).bitwiseAND(mask), levels) for i in range(3)])


def _nodes(points: DataFrame, level: int, axes: list[str], up: int) -> DataFrame:
    box = [f(a).alias(f"{f.__name__}_{a}") for a in axes for f in (F.min, F.max)]
    grouped = points.groupBy(F.col(f"c{level}").alias("cell")).agg(*box, F.count("*").alias("n"), F.sum("weight").alias("w"))
    return grouped.withColumn("up", _up(F.col("cell"), up))


def _levels(last: int) -> list[int]:
    return sorted({0, *range(last, 0, -3)} | {min(last + 3, BITS), BITS})


def _cube(locations: DataFrame, levels: list[int]) -> DataFrame:
    """Locations with unit-vector axes and their cell codes on every level used."""
    lat, long = F.radians("lat"), F.radians("long")
    out = locations.withColumns({"x": F.cos(lat) * F.cos(long), "y": F.cos(lat) * F.sin(long), "z": F.sin(lat)})
    return out.withColumns({f"c{k}": _code([_axis(F.col(a), k) for a in "xyz"]) for k in levels})


def _dual_tree(points: DataFrame, levels: list[int], chord: float) -> tuple[DataFrame, DataFrame]:
    """(level, a, b, wa, wb) accepted as a whole and (level, a, b) to compare, each unordered pair once.

    Weights are the numbers of places; a node pair's children take the pair's place.
    """
    low = chord * chord * (1 + 1e-9)
    high = chord * chord * (1 - 1e-9)
    axes = ["x", "y", "z"]
    frontier = points.select(F.lit(0).cast("long").alias("a")).limit(1).withColumn("b", F.col("a"))
    sure, open_ = [], []
    for i, level in enumerate(levels[1:], 1):
        nodes = cut(_nodes(points, level, axes, level - levels[i - 1]), "nodes")
        side = lambda s: nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in nodes.columns])
        both = frontier.join(side("l"), F.col("a") == F.col("up_l")).join(side("r"), F.col("b") == F.col("up_r"))
        both = both.filter((F.col("a") != F.col("b")) | (F.col("cell_l") <= F.col("cell_r")))
        gap = reduce(lambda p, q: p + q, [F.pow(F.greatest(F.lit(0.0), F.col(f"min_{x}_l") - F.col(f"max_{x}_r"), F.col(f"min_{x}_r") - F.col(f"max_{x}_l")), 2) for x in axes])
        reach = reduce(lambda p, q: p + q, [F.pow(F.greatest(F.col(f"max_{x}_l") - F.col(f"min_{x}_r"), F.col(f"max_{x}_r") - F.col(f"min_{x}_l")), 2) for x in axes])
        lone = (F.col("cell_l") == F.col("cell_r")) & (F.col("n_l") == 1)
        judged = both.filter((gap <= low) & ~lone).select(F.col("cell_l").alias("a"), F.col("cell_r").alias("b"), "n_l", "n_r", F.col("w_l").alias("wa"), F.col("w_r").alias("wb"), (reach <= high).alias("sure"))
        judged = cut(judged, "pairs")
        sure.append(judged.filter("sure").select(F.lit(level).alias("level"), "a", "b", "wa", "wb"))
        small = (F.col("n_l") * F.col("n_r") <= LEAF) if i >= len(levels) - 3 else F.lit(False)
        if level == levels[-1]:
            small = F.lit(True)
        open_.append(judged.filter(~F.col("sure") & small).select(F.lit(level).alias("level"), "a", "b"))
        frontier = judged.filter(~F.col("sure") & ~small).select("a", "b")
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return union(sure), union(open_)


def _setup(places: DataFrame, radius_m: float) -> tuple[DataFrame, list[int], float]:
    chord = 2 * math.sin(min(radius_m / EARTH_M, math.pi) / 2)
    last = max(3, min(BITS - 1, int(math.log2(2 / chord)) if chord > 0 else BITS - 1))
    levels = _levels(last)
    locations = places.groupBy("lat", "long").agg(F.count("*").alias("weight"))
    return cut(_cube(locations, levels), "locations"), levels, chord


def _on_levels(points: DataFrame, levels: list[int], *keep: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"c{k}").alias("cell")) for k in levels]))
    return points.select(*keep, rows.alias("at")).select(*keep, "at.level", "at.cell")


def _location_pairs(points: DataFrame, levels: list[int], chord: float, radius_m: float) -> DataFrame:
    """(lat_a, long_a, lat_b, long_b) of different locations within the radius, each pair once."""
    sure, open_ = _dual_tree(points, levels, chord)
    pairs = sure.select("level", "a", "b", F.lit(True).alias("sure")).unionByName(open_.withColumn("sure", F.lit(False)))
    at = _on_levels(points, levels[1:], "lat", "long")
    left = at.select("level", F.col("cell").alias("a"), F.col("lat").alias("lat_a"), F.col("long").alias("long_a"))
    right = at.select("level", F.col("cell").alias("b"), F.col("lat").alias("lat_b"), F.col("long").alias("long_b"))
    met = pairs.join(left, ["level", "a"]).join(right, ["level", "b"])
    once = (F.col("a") != F.col("b")) | (F.struct("lat_a", "long_a") < F.struct("lat_b", "long_b"))
    near = F.col("sure") | (distance_m(F.col("lat_a"), F.col("long_a"), F.col("lat_b"), F.col("long_b")) <= radius_m)
    return met.filter(once & near).select("lat_a", "long_a", "lat_b", "long_b")


def near_pairs(df: DataFrame, id_col: str, radius_m: float, lat: str = "lat", long: str = "long") -> DataFrame:
    """(id_a, id_b): different ids with usable places at most ``radius_m`` apart, the smaller first.

    Places at one location are one point of the tree. Unusable coordinates and null ids
    are left out, repeated rows count once, an empty table gives none.
    """
    places = cut(usable_places(df, id_col, lat, long), "places")
    points, levels, chord = _setup(places, radius_m)
    pairs = _location_pairs(points, levels, chord, radius_m)
    side = lambda s: places.select(F.col("id").alias(f"i{s}"), F.col("lat").alias(f"lat_{s}"), F.col("long").alias(f"long_{s}"))
    apart = pairs.join(side("a"), ["lat_a", "long_a"]).join(side("b"), ["lat_b", "long_b"]).select("ia", "ib")
    # Places at one spot are all near each other, and each pair of them is part of the result: listed once.
    same = places.join(points.filter("weight > 1").select("lat", "long"), ["lat", "long"], "left_semi")
    x, y = same.select(F.col("id").alias("ia"), "lat", "long"), same.select(F.col("id").alias("ib"), "lat", "long")
    one = x.join(y, ["lat", "long"]).filter("ia < ib").select("ia", "ib")
    return apart.unionByName(one).filter("ia <> ib").select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()


def near_counts(df: DataFrame, id_col: str, radius_m: float, lat: str = "lat", long: str = "long") -> DataFrame:
    """(id, lat, long, neighbours): how many other usable places lie within ``radius_m`` of each.

    Node pairs accepted as a whole add the node's number of places without being opened,
    so dense neighbourhoods are never listed pair by pair.
    """
    places = cut(usable_places(df, id_col, lat, long), "places")
    points, levels, chord = _setup(places, radius_m)
    sure, open_ = _dual_tree(points, levels, chord)
    both = F.explode(F.array(F.struct(F.col("a").alias("cell"), F.col("wb").alias("add")), F.struct(F.col("b").alias("cell"), F.col("wa").alias("add"))))
    other = sure.filter("a <> b").select("level", both.alias("s")).select("level", "s.cell", "s.add")
    same = sure.filter("a = b").select("level", F.col("a").alias("cell"), F.col("wb").alias("add"))  # the place itself goes at the end
    whole = other.unionByName(same).groupBy("level", "cell").agg(F.sum("add").alias("add"))
    at = _on_levels(points, levels[1:], "lat", "long", "weight")
    taken = at.join(whole, ["level", "cell"]).select("lat", "long", "add")
    side = lambda s, c: at.select("level", F.col("cell").alias(c), F.col("lat").alias(f"lat_{s}"), F.col("long").alias(f"long_{s}"), F.col("weight").alias(f"w_{s}"))
    met = open_.join(side("a", "a"), ["level", "a"]).join(side("b", "b"), ["level", "b"])
    once = (F.col("a") != F.col("b")) | (F.struct("lat_a", "long_a") < F.struct("lat_b", "long_b"))
    met = met.filter(once & (distance_m(F.col("lat_a"), F.col("long_a"), F.col("lat_b"), F.col("long_b")) <= radius_m))
    each = F.explode(F.array(*[F.struct(F.col(f"lat_{s}").alias("lat"), F.col(f"long_{s}").alias("long"), F.col(f"w_{o}").alias("add")) for s, o in (("a", "b"), ("b", "a"))]))
    listed = met.select(each.alias("e")).select("e.lat", "e.long", "e.add")
    # An open or lone leaf counts the location's own places here, an accepted one above.
    covered = at.join(sure.filter("a = b").select("level", F.col("a").alias("cell")), ["level", "cell"]).select("lat", "long").distinct()
    own = points.select("lat", "long", F.col("weight").alias("add")).join(covered, ["lat", "long"], "left_anti")
    total = taken.unionByName(listed).unionByName(own).groupBy("lat", "long").agg((F.sum("add") - 1).alias("neighbours"))
    return places.join(total, ["lat", "long"]).select("id", "lat", "long", "neighbours")


def region_rings(df: DataFrame, region: str = "region_id", order: str = "vertex_no", lat: str = "lat", long: str = "long") -> DataFrame:
    """(region, edges, lo, hi, south, north): rings with longitudes unrolled from the first corner.

    Every edge goes the short way round and is straight in (lat, long). A ring that goes
    once round the globe holds the pole nearer to it and is closed over that pole. Corners
    with a null part are left out; a region's corners are one row (a region is one object).
    """
    rows = df.select(F.col(region).alias("region"), F.col(order).alias("no"), F.col(lat).alias("y"), F.col(long).alias("x")).dropna()
    ring = rows.groupBy("region").agg(F.array_sort(F.collect_set(F.struct("no", "y", "x"))).alias("ring"))
    step = lambda acc, v: F.array_append(acc, F.struct(v["y"].alias("y"), (acc[F.size(acc) - 1]["x"] + F.pmod(v["x"] - acc[F.size(acc) - 1]["x"] + 180, F.lit(360.0)) - 180).alias("x")))
    first = F.array(F.struct(F.col("ring")[0]["y"].alias("y"), F.col("ring")[0]["x"].alias("x")))
    unrolled = ring.withColumn("p", F.aggregate(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(1))), first, step))
    # Where the closing edge would come back a turn away from the start, the ring runs round a pole.
    start, end = F.col("p")[0], F.col("p")[F.size("p") - 1]
    home = end["x"] + F.pmod(start["x"] - end["x"] + 180, F.lit(360.0)) - 180
    pole = F.when(F.aggregate("p", F.lit(0.0), lambda s, v: s + v["y"]) >= 0, F.lit(90.0)).otherwise(F.lit(-90.0))
    corner = lambda y, x: F.struct(y.alias("y"), x.alias("x"))
    over = F.concat("p", F.array(corner(start["y"], home), corner(pole, home), corner(pole, start["x"])))
    unrolled = unrolled.withColumn("p", F.when(F.abs(home - start["x"]) > 180, over).otherwise(F.col("p")))
    nxt = F.concat(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), F.slice("p", 1, 1))
    edges = F.zip_with("p", nxt, lambda a, b: F.struct(a["y"].alias("y1"), a["x"].alias("x1"), b["y"].alias("y2"), b["x"].alias("x2")))
    pick = lambda c, f: f(F.transform("p", lambda v: v[c]))
    return unrolled.filter(F.size("p") > 2).select("region", edges.alias("edges"), pick("x", F.array_min).alias("lo"), pick("x", F.array_max).alias("hi"), pick("y", F.array_min).alias("south"), pick("y", F.array_max).alias("north"))


def _holds(edges: Column, y: Column, x: Column) -> Column:
    """Even-odd test."""
    crossed = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(edges, crossed)) % 2 == 1


def inside_pairs(df: DataFrame, id_col: str, regions: DataFrame, lat: str = "lat", long: str = "long", levels: tuple[int, ...] = (0, 3, 6, 9, 12, 15), leaf: int = 16) -> DataFrame:
    """(id, region): usable places and the regions of (region_id, vertex_no, lat, long) that hold them.

    Tree nodes outside a region's box are discarded; nodes no edge comes near are in or
    out as a whole; points of the others are tested. Overlapping and concave regions are
    fine, rings round a pole too.
    """
    places = cut(usable_places(df, id_col, lat, long), "places")
    points = places.groupBy("lat", "long").agg(F.count("*").alias("weight"))
    points = points.withColumns({f"c{k}": _code([_axis(F.col("lat") / 90, k), _axis(F.col("long") / 180, k), F.lit(0).cast("long")]) for k in levels})
    points = cut(points, "locations")
    rings = cut(region_rings(regions), "rings")
    size = rings.agg(F.sum(F.size("edges") * 40 + 64)).first()[0] or 0
    shapes = F.broadcast(rings) if size <= BROADCAST_BYTES else rings
    frontier = rings.select("region", F.lit(0).cast("long").alias("a"))
    whole, open_ = [], []
    for i, level in enumerate(levels[1:], 1):
        nodes = _nodes(points, level, ["lat", "long"], level - levels[i - 1])
        pairs = frontier.join(nodes, F.col("a") == F.col("up")).join(shapes, "region")
        x0 = F.col("lo") + F.pmod(F.col("min_long") - F.col("lo"), F.lit(360.0))
        x1 = x0 + F.col("max_long") - F.col("min_long")
        pairs = pairs.withColumns({"x0": x0, "x1": x1})
        touch = (F.col("min_lat") <= F.col("north")) & (F.col("max_lat") >= F.col("south")) & ((F.col("x0") <= F.col("hi")) | (F.col("x1") >= F.col("lo") + 360))
        near_edge = F.exists("edges", lambda e: (F.least(e["y1"], e["y2"]) <= F.col("max_lat")) & (F.greatest(e["y1"], e["y2"]) >= F.col("min_lat")) & (F.least(e["x1"], e["x2"]) <= F.col("x1")) & (F.greatest(e["x1"], e["x2"]) >= F.col("x0")))
        wraps = F.col("x1") >= F.col("lo") + 360
        state = F.when(near_edge | wraps, F.lit(1)).when(_holds(F.col("edges"), F.col("min_lat"), F.col("x0")), F.lit(2)).otherwise(F.lit(0))
        judged = cut(pairs.filter(touch).withColumn("state", state).filter("state > 0").select("region", F.col("cell").alias("a"), "n", "state"), "pairs")
        last = F.lit(True) if level == levels[-1] else F.col("n") <= leaf
        whole.append(judged.filter("state = 2").select(F.lit(level).alias("level"), F.col("a").alias("cell"), "region", F.lit(True).alias("sure")))
        open_.append(judged.filter((F.col("state") == 1) & last).select(F.lit(level).alias("level"), F.col("a").alias("cell"), "region", F.lit(False).alias("sure")))
        frontier = judged.filter((F.col("state") == 1) & ~last).select("region", "a")
    found = reduce(DataFrame.unionByName, whole + open_)
    at = _on_levels(points, list(levels[1:]), "lat", "long")
    met = at.join(found, ["level", "cell"]).join(shapes, "region")
    x = F.col("lo") + F.pmod(F.col("long") - F.col("lo"), F.lit(360.0))
    held = met.filter(F.col("sure") | _holds(F.col("edges"), F.col("lat"), x)).select("lat", "long", "region")
    return places.join(held, ["lat", "long"]).select("id", "region").distinct()
