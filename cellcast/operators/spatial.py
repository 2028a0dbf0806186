"""Nearest, radius and polygon joins without cross joins or crowded tiles.

Sites are summarised once into a tree of nested tiles over their bounding box, each a
sixteenth of the one above.  Every tile keeps the tight box of its sites, one real site and
their number; a tile of at most ``LEAF_SITES`` distinct positions is a leaf, so leaves lie
deep only where sites crowd.  A query point walks down the levels and keeps only tiles that
can still matter; a leaf it meets waits until the walk ends.  So the rows a point makes
depend on its surroundings and never on how many sites share a tile.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import _crossing, chord_to_km, km_to_chord, unit_xyz
from ..session import cut_lineage, shuffle_width

# tiles of the finest level are as narrow as doubles of the box's size tell apart
FINEST = 26
# levels of the tree that are made of one pass over the sites
STEP = 6
LEAF_SITES = 64
# at most 16 ** 3 tiles
BROADCAST_LEVEL = 3
# of a polygon's box, about; that many rows a polygon at most are made of its tiles, a few times over
FEWEST_TILES = 64
SLACK = 1e-9


def _coords(metric: str, lat: str, lon: str) -> list[Column]:
    """Coordinates whose straight-line distance orders like the metric."""
    if metric == "degree":
        return [F.col(lat).cast("double"), F.col(lon).cast("double")]
    if metric == "haversine":
        return list(unit_xyz(lat, lon))
    raise ValueError(f"unknown metric {metric!r}")


def _on_globe(lat: str, lon: str) -> Column:
    return F.col(lat).between(-90, 90) & F.col(lon).between(-360, 360)


def _usable(metric: str, lat: str, lon: str) -> Column:
    """Whether the metric has a distance from the place: on the globe, or any finite coordinates."""
    if metric == "haversine":
        return _on_globe(lat, lon)
    y, x = F.abs(F.col(lat).cast("double")), F.abs(F.col(lon).cast("double"))
    return (y < float("inf")) & (x < float("inf"))


@dataclass(frozen=True)
class SiteTree:
    """``nodes`` (level, ty, tx, lo*, hi*, rep, copies, n) and ``spots`` with their leaf (lvl, lty, ltx).

    ``levels`` are those of a walk; the root needs a step only if it is a leaf.
    """

    nodes: DataFrame
    spots: DataFrame
    depth: int
    dims: int
    leaf_sites: int

    @property
    def levels(self) -> range:
        return range(min(self.depth, 1), self.depth + 1)

    def level(self, level: int) -> DataFrame:
        """A level's tiles with their parent (at most 16 per parent)."""
        tiles = self.nodes.where(F.col("level") == level).drop("level")
        tiles = tiles.withColumns({
            "pty": F.shiftright("ty", 2),
            "ptx": F.shiftright("tx", 2),
            "is_leaf": F.lit(level == FINEST) | (F.col("n") <= self.leaf_sites),
        }).drop("n")
        return F.broadcast(tiles) if level <= BROADCAST_LEVEL else tiles


def _up(column: str, levels) -> Column:
    return F.call_function("shiftright", F.col(column), (2 * levels).cast("int") if isinstance(levels, Column) else F.lit(2 * levels))


def site_tree(sites: DataFrame, lat: str, lon: str, site_id: str, metric: str, leaf_sites: int = LEAF_SITES) -> SiteTree:
    """The tree of the distinct positions of ``sites``; each keeps its smallest id and its copies.

    Six levels are made in one pass, counted before anything moves. Only positions in tiles of
    the sixth that are still crowded enter the next pass; so a crowded spot deepens the tree
    there and nowhere else.
    """
    clean = sites.where(_usable(metric, lat, lon))
    spots = clean.groupBy(F.col(lat).cast("double").alias("slat"), F.col(lon).cast("double").alias("slon")).agg(
        F.min(site_id).alias("sid"), F.count(F.lit(1)).alias("copies")
    )
    spots = cut_lineage(spots, "site-spots")
    box = spots.agg(F.min("slat").alias("s"), F.max("slat").alias("n"), F.min("slon").alias("w"), F.max("slon").alias("e")).first()
    south, west = box["s"] or 0.0, box["w"] or 0.0
    size = max((box["n"] or 0.0) - south, (box["e"] or 0.0) - west) or 1.0
    coords = _coords(metric, "slat", "slon")
    dims = len(coords)

    def place(c: Column, low: float) -> Column:
        return F.least(F.floor((c - low) / size * 4.0**FINEST), F.lit(4**FINEST - 1)).cast("long")

    spots = spots.select(
        "sid", "copies", *[c.alias(f"s{i}") for i, c in enumerate(coords)],
        place(F.col("slat"), south).alias("iy"), place(F.col("slon"), west).alias("ix"),
    )
    spot = [f"s{i}" for i in range(dims)]

    summary = [
        *[F.min(c).alias(f"lo{i}") for i, c in enumerate(spot)],
        *[F.max(c).alias(f"hi{i}") for i, c in enumerate(spot)],
        F.min(F.struct(*spot)).alias("rep"),
        F.sum("copies").alias("copies"),
        F.count(F.lit(1)).alias("n"),
    ]
    nodes, leaves, pending, low = [], [], spots, -1
    while True:
        high = min(max(low, 0) + STEP, FINEST)
        each = F.explode(F.sequence(F.lit(low + 1), F.lit(high)))
        below = F.lit(FINEST) - F.col("level")
        spread = pending.withColumn("level", each).withColumns({"ty": _up("iy", below), "tx": _up("ix", below)})
        part = cut_lineage(spread.groupBy("level", "ty", "tx").agg(*summary), "site-nodes")
        nodes.append(part)
        crowded = part.where(F.col("n") > leaf_sites).select("level", F.col("ty").alias("cty"), F.col("tx").alias("ctx"))
        deepest = crowded.agg(F.max("level")).first()[0]
        # the tiles around a crowded tile are crowded, so their number is the level of the leaf
        finest = part.where(F.col("level") == high).select("ty", "tx")
        above = F.lit(high) - F.col("level")
        kin = finest.withColumn("level", each).withColumns({"cty": _up("ty", above), "ctx": _up("tx", above)})
        deeper = kin.join(crowded, ["level", "cty", "ctx"]).groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("around"))
        lvl = F.least(F.coalesce("around", F.lit(0)) + (low + 1), F.lit(FINEST)).cast("int")
        known = finest.join(deeper, ["ty", "tx"], "left").select("ty", "tx", lvl.alias("lvl"))
        keyed = pending.withColumns({"ty": _up("iy", FINEST - high), "tx": _up("ix", FINEST - high)})
        placed = keyed.join(known, ["ty", "tx"]).drop("ty", "tx")
        if high == FINEST or deepest != high:
            depth = min((low if deepest is None else deepest) + 1, FINEST)
            leaves.append(placed)
            break
        leaves.append(placed.where(F.col("lvl") <= high))
        pending, low = cut_lineage(placed.where(F.col("lvl") > high).drop("lvl"), "site-crowd"), high
    below = F.lit(FINEST) - F.col("lvl")
    settled = reduce(DataFrame.unionByName, leaves).select(
        "sid", "copies", *spot, "lvl", _up("iy", below).alias("lty"), _up("ix", below).alias("ltx")
    )
    return SiteTree(reduce(DataFrame.unionByName, nodes), settled, depth, dims, leaf_sites)


def _sum(parts) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _gap2(dims: int) -> Column:
    """Squared distance from the point to the nearest spot of the box."""
    parts = []
    for i in range(dims):
        p, lo, hi = F.col(f"p{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
        d = F.greatest(lo - p, p - hi, F.lit(0.0))
        parts.append(d * d)
    return _sum(parts)


def _far2(dims: int) -> Column:
    """Squared distance to the farthest corner of the box."""
    parts = []
    for i in range(dims):
        p = F.col(f"p{i}")
        d = F.greatest(F.abs(p - F.col(f"lo{i}")), F.abs(p - F.col(f"hi{i}")))
        parts.append(d * d)
    return _sum(parts)


def _rep2(dims: int) -> Column:
    return _sum([(F.col(f"p{i}") - F.col(f"rep.s{i}")) * (F.col(f"p{i}") - F.col(f"rep.s{i}")) for i in range(dims)])


def _spot2(dims: int) -> Column:
    return _sum([(F.col(f"p{i}") - F.col(f"s{i}")) * (F.col(f"p{i}") - F.col(f"s{i}")) for i in range(dims)])


def _query_spots(points: DataFrame, lat: str, lon: str, metric: str) -> DataFrame:
    """Distinct places of the points, below the root of the tree."""
    clean = points.where(_usable(metric, lat, lon))
    spots = clean.select(F.col(lat).cast("double").alias("qlat"), F.col(lon).cast("double").alias("qlon")).distinct()
    # a fixed number of parts: adaptive execution would merge rows that are about to grow
    spots = spots.repartition(shuffle_width(points.sparkSession), "qlat", "qlon")
    # not a literal, which would make the first join one without keys
    root = F.floor(F.col("qlat") * 0.0).cast("long")
    return spots.select(
        "*",
        *[c.alias(f"p{i}") for i, c in enumerate(_coords(metric, "qlat", "qlon"))],
        root.alias("pty"),
        root.alias("ptx"),
        F.lit(None).cast("int").alias("lvl"),
        F.lit(None).cast("long").alias("lty"),
        F.lit(None).cast("long").alias("ltx"),
    )


def _away() -> Column:
    """Settled rows travel along under keys that match no tile, spread to avoid a hot key."""
    return -1 - F.pmod(F.xxhash64("qlat", "qlon"), F.lit(1 << 20))


def _to_metric(d2: Column, metric: str) -> Column:
    return chord_to_km(F.sqrt(d2)) if metric == "haversine" else F.sqrt(d2)


def nearest_join(
    points: DataFrame,
    sites: DataFrame,
    lat: str,
    lon: str,
    site_lat: str,
    site_lon: str,
    site_id: str,
    metric: str = "degree",
    max_distance: float | None = None,
    leaf_sites: int = LEAF_SITES,
) -> DataFrame:
    """Adds (site_id, distance) of the nearest site to every point, smallest id on ties.

    ``metric`` is plain degrees or great-circle km.  Points without a site (within
    ``max_distance`` when given) or off the globe keep nulls.
    """
    tree = site_tree(sites, site_lat, site_lon, site_id, metric, leaf_sites)
    dims = tree.dims
    keys = ["qlat", "qlon", *[f"p{i}" for i in range(dims)]]
    cap = None
    if max_distance is not None:
        c = km_to_chord(max_distance) if metric == "haversine" else max_distance
        cap = c * c * (1 + SLACK) + SLACK * SLACK
    # the distinct points are already spread by position, so no level shuffles them again
    # while its tiles are broadcast
    around = Window.partitionBy("qlat", "qlon")
    none = F.lit(None).cast("double")
    walk = _query_spots(points, lat, lon, metric).withColumns({"gap2": none, "rep2": none})
    for level in tree.levels:
        met = walk.join(tree.level(level), ["pty", "ptx"], "left")
        settled = F.col("lvl").isNotNull()
        leaf = settled | F.col("is_leaf")
        near = met.where(settled | F.col("ty").isNotNull()).select(
            *keys,
            F.when(leaf, _away()).otherwise(F.col("ty")).alias("pty"),
            F.when(leaf, _away()).otherwise(F.col("tx")).alias("ptx"),
            F.coalesce("lvl", F.when(leaf, level)).alias("lvl"),
            F.coalesce("lty", "ty").alias("lty"),
            F.coalesce("ltx", "tx").alias("ltx"),
            F.when(settled, F.col("gap2")).otherwise(_gap2(dims)).alias("gap2"),
            F.when(settled, F.col("rep2")).otherwise(_rep2(dims)).alias("rep2"),
        )
        if cap is not None:
            near = near.where(F.col("gap2") <= cap)
        near = near.withColumn("limit", F.min("rep2").over(around) * (1 + SLACK) + SLACK * SLACK)
        walk = near.where(F.col("gap2") <= F.col("limit")).drop("limit")
        if level < tree.depth:
            open_ = F.col("lvl").isNull()
            walk = walk.withColumns({"lty": F.when(~open_, F.col("lty")), "ltx": F.when(~open_, F.col("ltx"))})
    pairs = walk.join(tree.spots, ["lvl", "lty", "ltx"])
    best = pairs.groupBy("qlat", "qlon").agg(F.min(F.struct(_spot2(dims).alias("d2"), "sid")).alias("b"))
    found = best.select("qlat", "qlon", F.col("b.sid").alias("site_id"), _to_metric(F.col("b.d2"), metric).alias("distance"))
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    return _attach(points, found, lat, lon, ["site_id", "distance"])


def _attach(points: DataFrame, found: DataFrame, lat: str, lon: str, cols: list[str]) -> DataFrame:
    left = points.withColumn("_qlat", F.col(lat).cast("double")).withColumn("_qlon", F.col(lon).cast("double"))
    on = (F.col("_qlat") == F.col("qlat")) & (F.col("_qlon") == F.col("qlon"))
    return left.join(found, on, "left").select(*points.columns, *cols)


def exclude_within(points, events, lat, lon, event_lat, event_lon, event_id, km: float) -> DataFrame:
    """Points with no event inside ``km`` (anti distance join).

    An event counts whatever its id, null too. Points without a usable place can't be shown
    to lie outside and are left out.
    """
    marked = events.select(event_lat, event_lon, F.lit(1).alias("_hit"))
    placed = points.where(_on_globe(lat, lon))
    near = nearest_join(placed, marked, lat, lon, event_lat, event_lon, "_hit", "haversine", max_distance=km)
    return near.where(F.col("site_id").isNull()).drop("site_id", "distance")


def distance_to_nearest(points, events, lat, lon, event_lat, event_lon, event_id) -> DataFrame:
    """Minimum and mean of the great-circle distance to the nearest event."""
    near = nearest_join(points, events, lat, lon, event_lat, event_lon, event_id, "haversine")
    return near.agg(F.min("distance").alias("min_km"), F.avg("distance").alias("mean_km"))


def distance_to_features(cells, vertices, lat, lon, v_lat, v_lon, v_id, absent_m: float = 100000.0) -> DataFrame:
    """Metres to the nearest densified feature vertex, ``absent_m`` where there is none."""
    near = nearest_join(cells, vertices, lat, lon, v_lat, v_lon, v_id, "haversine")
    return near.withColumn("distance_m", F.coalesce(F.col("distance") * 1000.0, F.lit(absent_m))).drop("site_id", "distance")


def count_within(points, sites, lat, lon, site_lat, site_lon, site_id, kms: list[float], leaf_sites: int = LEAF_SITES) -> DataFrame:
    """Number of sites inside each radius, as one column ``within_<km>`` per radius.

    Tiles wholly inside a radius add their count without being opened.
    """
    tree = site_tree(sites, site_lat, site_lon, site_id, "haversine", leaf_sites)
    dims = tree.dims
    pcols = [f"p{i}" for i in range(dims)]
    keys = ["qlat", "qlon", *pcols, "km", "c2"]
    radii = F.array(*[F.struct(F.lit(float(k)).alias("km"), F.lit(km_to_chord(k) ** 2).alias("c2")) for k in kms])
    walk = _query_spots(points, lat, lon, "haversine")
    walk = walk.withColumn("r", F.explode(radii)).select("qlat", "qlon", *pcols, "r.km", "r.c2", "pty", "ptx", "lvl", "lty", "ltx")
    walk = walk.withColumn("n", F.lit(None).cast("long"))
    for level in tree.levels:
        met = walk.join(tree.level(level), ["pty", "ptx"], "left")
        met = met.select("*", _gap2(dims).alias("gap2"), _far2(dims).alias("far2"))
        inside = F.col("far2") < F.col("c2") * (1 - SLACK)
        border = ~inside & (F.col("gap2") <= F.col("c2") * (1 + SLACK))
        waits = F.col("n").isNotNull() | F.col("lvl").isNotNull()
        met = met.where(waits | inside | border)
        leaf = ~inside & F.col("is_leaf")
        settled = waits | inside | leaf
        walk = met.select(
            *keys,
            F.when(settled, _away()).otherwise(F.col("ty")).alias("pty"),
            F.when(settled, _away()).otherwise(F.col("tx")).alias("ptx"),
            F.coalesce("lvl", F.when(~waits & leaf, level)).alias("lvl"),
            F.coalesce("lty", F.when(~waits & leaf, F.col("ty"))).alias("lty"),
            F.coalesce("ltx", F.when(~waits & leaf, F.col("tx"))).alias("ltx"),
            F.when(waits, F.col("n")).when(inside, F.col("copies")).alias("n"),
        )
        # counted rows of a point become one; the rows are already spread by position
        walk = walk.groupBy(*keys, "pty", "ptx", "lvl", "lty", "ltx").agg(F.sum("n").alias("n"))
    # counted rows open no leaf; under null keys all of them would be in one task
    walk = walk.withColumns({"lvl": F.coalesce("lvl", F.lit(-1)), "lty": F.coalesce("lty", _away()), "ltx": F.coalesce("ltx", F.lit(-1).cast("long"))})
    pairs = walk.join(tree.spots, ["lvl", "lty", "ltx"], "left")
    hit = F.when(F.col("n").isNotNull(), F.col("n")).when(_spot2(dims) <= F.col("c2"), F.col("copies")).otherwise(0)
    counts = pairs.groupBy("qlat", "qlon", "km").agg(F.sum(hit).alias("n"))
    wide = counts.groupBy("qlat", "qlon").agg(
        *[F.max(F.when(F.col("km") == float(k), F.col("n"))).alias(f"within_{k:g}") for k in kms]
    )
    names = [f"within_{k:g}" for k in kms]
    out = _attach(points, wide, lat, lon, names)
    return out.select(*points.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def curvilinear_map(cells, grid_points, lat, lon, p_lat, p_lon, p_id, margin_deg: float = 0.5) -> DataFrame:
    """Nearest grid point of every output cell, points first cut to the cells' box.

    Made once and stored; each later window only needs an equi-join on ``site_id``.
    """
    box = cells.agg(F.min(lat).alias("s"), F.max(lat).alias("n"), F.min(lon).alias("w"), F.max(lon).alias("e")).first()
    near = grid_points.where(
        F.col(p_lat).between(box["s"] - margin_deg, box["n"] + margin_deg)
        & F.col(p_lon).between(box["w"] - margin_deg, box["e"] + margin_deg)
    )
    return nearest_join(cells, near, lat, lon, p_lat, p_lon, p_id, "degree")


def _steps(size: Column) -> Column:
    """Exponent of the power of two that is at least ``size``."""
    return F.ceil(F.log2(size)).cast("int")


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent.cast("double"))


def _tile_of(place: Column, exponent: Column) -> Column:
    # dividing by a power of two is exact, so a place on a border has one tile
    return F.floor(place / _power(exponent)).cast("long")


def _on_levels(points: DataFrame, tiles: DataFrame, y: str, x: str) -> DataFrame:
    """Each point once for every tile width that occurs (a few dozen at most), with its tile there."""
    widths = sorted(tiles.agg(F.collect_set("_k")).first()[0])
    spread = points.where(_usable("degree", y, x)).withColumn("_k", F.explode(F.array(*[F.lit(k) for k in widths]).cast("array<int>")))
    at = {name: _tile_of(F.col(c).cast("double"), F.col("_k")) for name, c in (("_ty", y), ("_tx", x))}
    return spread.withColumns(at)


def polygon_tiles(polygons: DataFrame, ring: str) -> DataFrame:
    """Tiles of each polygon with the edges that touch them: (_k, _ty, _tx, odd, edges, box, held).

    A polygon's tiles are as wide as makes both its tiles and the edges in them a few times its
    corners, or ``FEWEST_TILES`` for one of fewer corners, whatever its shape: a polygon's tiles
    then reach little beyond it, so that a point meets few polygons that don't hold it.  ``odd`` with the edges of one tile decides every point of it:
    it counts the edges elsewhere that lie right of the tile's lower left corner.  ``box`` is
    the ring's (w, e, s, n), ``held`` has the polygon's other columns.  Tiles without edges are kept where the polygon covers them.
    """
    others = [c for c in polygons.columns if c != ring]
    held = F.struct(*others) if others else F.struct(F.lit(True).alias("_"))

    def finite(c: Column) -> Column:
        return F.coalesce(F.abs(c) < float("inf"), F.lit(False))

    corners = F.transform(F.col(ring), lambda v: F.struct(v["lon"].cast("double").alias("x"), v["lat"].cast("double").alias("y")))
    corners = F.filter(corners, lambda v: finite(v["x"]) & finite(v["y"]))
    rings = polygons.select(F.monotonically_increasing_id().alias("_pid"), held.alias("held"), corners.alias("c"))
    rings = cut_lineage(rings.where(F.size("c") > 2), "rings")

    def edge(v: Column, i: Column) -> Column:
        after = F.get("c", F.pmod(i + 1, F.size("c")))
        return F.struct(v["x"].alias("x1"), v["y"].alias("y1"), after["x"].alias("x2"), after["y"].alias("y2"))

    xs, ys = F.transform("c", lambda v: v["x"]), F.transform("c", lambda v: v["y"])
    sides = {"w": F.array_min(xs), "e": F.array_max(xs), "s": F.array_min(ys), "n": F.array_max(ys)}
    rings = rings.withColumns({**sides, "edges": F.transform("c", edge)})
    length = F.aggregate(
        "edges", F.lit(0.0), lambda a, g: a + F.abs(g["x2"] - g["x1"]) + F.abs(g["y2"] - g["y1"])
    )
    far = F.greatest(*[F.abs(F.col(c)) for c in sides])
    parts = F.greatest(F.size("c"), F.lit(FEWEST_TILES))
    width = F.greatest(F.sqrt((F.col("e") - F.col("w")) * (F.col("n") - F.col("s")) / parts), length / parts, far * 2.0**-46)
    # corners that all lie on one spot hold nothing
    rings = rings.where(length > 0).withColumn("_k", _steps(width)).withColumn("step", _power(F.col("_k")))
    key = ["_pid", "_k", "_tx", "_ty"]
    step = F.col("step")
    slack = step / 8

    box = rings.withColumn("_tx", F.explode(F.sequence(_tile_of(F.col("w"), F.col("_k")), _tile_of(F.col("e"), F.col("_k")))))
    box = box.withColumn("_ty", F.explode(F.sequence(_tile_of(F.col("s"), F.col("_k")), _tile_of(F.col("n"), F.col("_k")))))
    shape = "struct<x1:double,y1:double,x2:double,y2:double>"
    box = box.select(*key, "held", F.struct(*sides).alias("box"), F.lit(None).cast(shape).alias("g"), F.lit(0).alias("above"), F.lit(0).alias("own"))

    lines = rings.select("_pid", "_k", "step", F.explode("edges").alias("g")).select("*", "g.*")
    west, east = F.least("x1", "x2"), F.greatest("x1", "x2")
    lines = lines.withColumn(
        "_tx", F.explode(F.sequence(_tile_of(west - slack, F.col("_k")), _tile_of(east + slack, F.col("_k"))))
    )
    left = F.col("_tx") * step

    def height(x: Column) -> Column:
        return (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")) + F.col("y1")

    def clipped(x: Column) -> Column:
        return F.least(F.greatest(x, west), east)

    upright = F.col("x1") == F.col("x2")
    ya = F.when(upright, F.col("y1")).otherwise(height(clipped(left - slack)))
    yb = F.when(upright, F.col("y2")).otherwise(height(clipped(left + step + slack)))
    # row of the highest tile whose lower border is below the place where the edge meets the tile's left side
    meets = (F.col("x1") > left) != (F.col("x2") > left)
    row = F.when(meets, F.ceil(height(left) / step).cast("long") - 1)
    lines = lines.select(*key[:3], "step", "g", row.alias("row"), F.least(ya, yb).alias("lo"), F.greatest(ya, yb).alias("hi"))
    none = [F.lit(None).cast(box.schema[c].dataType).alias(c) for c in ("held", "box")]
    above = lines.where("row is not null").select(
        *key[:3], F.col("row").alias("_ty"), *none, F.lit(None).cast(shape).alias("g"), F.lit(1).alias("above"), F.lit(0).alias("own")
    )
    inside = F.sequence(_tile_of(F.col("lo") - slack, F.col("_k")), _tile_of(F.col("hi") + slack, F.col("_k")))
    touch = lines.withColumn("_ty", F.explode(inside)).select(
        *key, *none, "g", F.lit(0).alias("above"), F.coalesce((F.col("row") >= F.col("_ty")).cast("int"), F.lit(0)).alias("own")
    )
    tiles = box.unionByName(above).unionByName(touch).groupBy(*key).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("held", "box")],
        F.collect_list("g").alias("edges"),
        F.sum("above").alias("above"),
        F.sum("own").alias("own"),
    )
    down = Window.partitionBy("_pid", "_k", "_tx").orderBy(F.desc("_ty"))
    tiles = tiles.withColumn("odd", (F.sum("above").over(down) + F.col("own")) % 2 == 1)
    # slack tiles around the box have no point of the polygon
    return tiles.where(F.col("held").isNotNull() & (F.col("odd") | (F.size("edges") > 0))).select(
        "_k", "_ty", "_tx", "odd", "edges", "box", "held"
    )


def polygon_join(points, polygons, lat: str, lon: str, ring: str) -> DataFrame:
    """Inner join of points to the polygons that hold them (even-odd rule).

    ``ring`` is ARRAY<STRUCT<lon, lat>>; corners without finite coordinates are left out, and
    fewer than three hold nothing.  A point meets only the edges in its own tile of each polygon
    around it (``polygon_tiles``), so a ring of many corners costs it no more than a short one.
    """
    tiles = cut_lineage(polygon_tiles(polygons, ring), "polygons")
    others = [f"held.{c}" for c in polygons.columns if c != ring]
    left = _on_levels(points, tiles, lat, lon)
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    corner = F.col("_tx") * _power(F.col("_k"))

    def flips(odd: Column, g: Column) -> Column:
        right = ((g["x1"] > corner) & (g["y1"] > y)) != ((g["x2"] > corner) & (g["y2"] > y))
        return odd != (right != _crossing(y, x, g["x1"], g["y1"], g["x2"], g["y2"]))

    key = ["_k", "_ty", "_tx"]
    # an explicit number keeps adaptive execution from merging rows that are about to meet many points
    met = left.join(tiles.repartition(shuffle_width(tiles.sparkSession), *key), key)
    met = met.where(x.between(F.col("box.w"), F.col("box.e")) & y.between(F.col("box.s"), F.col("box.n")))
    # a tile without edges decides all its points
    holds = F.when(F.size("edges") == 0, F.col("odd")).otherwise(F.aggregate("edges", F.col("odd"), flips))
    return met.where(holds).select(*points.columns, *others)


def tile_squares(tiles: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Squares (_k, _ty, _tx) with the tiles that may be the first by name at a place of theirs.

    A square is at most half as wide as a tile's longer side, so a tile touches 36 of them at
    most, in degrees and metres alike. A tile that holds a whole square decides it: those later
    by name are left out there. Equal boxes are one, under the first name.
    """
    sides = {c: F.col(c).cast("double") for c in ("left", "right", "bottom", "top")}
    boxes = tiles.withColumns(sides).where((F.col("left") <= F.col("right")) & (F.col("bottom") <= F.col("top")))
    far = F.greatest(*[F.abs(F.col(c)) for c in sides])
    boxes = boxes.where(far < float("inf")).groupBy(*sides).agg(F.min("tile").alias("tile"))
    wide = F.greatest(F.col("right") - F.col("left"), F.col("top") - F.col("bottom"), far * 2.0**-48, F.lit(8 * tol), F.lit(2.0**-48))
    boxes = boxes.withColumn("_k", _steps(wide) - 2)

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(_tile_of(F.col(low) - tol, F.col("_k")), _tile_of(F.col(high) + tol, F.col("_k"))))

    spread = boxes.withColumn("_ty", span("bottom", "top")).withColumn("_tx", span("left", "right"))
    # written once: it is summed and joined with what was summed
    spread = cut_lineage(spread, "squares")
    step = _power(F.col("_k"))
    whole = (
        (F.col("left") <= F.col("_tx") * step) & (F.col("right") >= (F.col("_tx") + 1) * step)
        & (F.col("bottom") <= F.col("_ty") * step) & (F.col("top") >= (F.col("_ty") + 1) * step)
    )
    key = ["_k", "_ty", "_tx"]
    first = spread.where(whole).groupBy(*key).agg(F.min("tile").alias("first"))
    return spread.join(first, key, "left").where(F.col("first").isNull() | (F.col("tile") <= F.col("first"))).drop("first")


def point_in_tile(points: DataFrame, tiles: DataFrame, x: str, y: str, tol: float = 1e-9) -> DataFrame:
    """First tile by name whose (left, right, bottom, top) holds the point, else null.

    A place meets only the tiles of its square that can be the first there (``tile_squares``).
    """
    squares = cut_lineage(tile_squares(tiles, tol), "first-squares")
    spots = _on_levels(points.select(x, y).distinct(), squares, y, x)
    inside = F.col(x).between(F.col("left") - tol, F.col("right") + tol) & F.col(y).between(
        F.col("bottom") - tol, F.col("top") + tol
    )
    found = spots.join(squares, ["_k", "_ty", "_tx"]).where(inside).groupBy(x, y).agg(F.min("tile").alias("tile"))
    return points.join(found, [x, y], "left")
