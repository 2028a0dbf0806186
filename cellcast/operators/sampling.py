"""Negative samples, balancing and chronological splits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import in_bbox
from ..session import cut_lineage, shuffle_width
from .ordered import global_index
from .spatial import exclude_within

# Primes for the affine permutation of dense row numbers.
MULTIPLIERS = (1073741827, 1073741831, 1073741833, 1073741839, 1073741843, 1073741857, 1073741891, 1073741909)
BLOCK = 1 << 16
SLOTS_PER_DAY = 4
# cells below which the join is left to the planner
HASHED_GRID = 100_000


def mix(seed: int, *cols) -> Column:
    """Deterministic 64-bit pseudo-random order of a key."""
    return F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(seed))


def hashed(*parts: Column, digits: int = 15) -> Column:
    """The first hex digits of the MD5 of ``parts`` joined by colons, as a number."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def uniform(seed: int, key: str) -> Column:
    """Deterministic uniform number in [0, 1) of a key."""
    return hashed(F.lit(seed), F.col(key), digits=13) / float(1 << 52)


class Permutation:
    """A keyed pseudo-random order of 0 .. size - 1, for sizes up to 2^62, as column arithmetic.

    A number is split into (left, right) of a rows x cols rectangle that holds ``size`` with
    few places to spare; hashes of one half are added to the other in turn, which can be
    undone.  ``at`` maps a step to a place, ``step_of`` a place to its step.  Places from
    ``size`` to ``places`` - 1 are spare and must be passed over.
    """

    ROUNDS = 2

    def __init__(self, size: int):
        self.size = max(size, 1)
        root = math.isqrt(self.size - 1) + 1
        self.rows = min(range(root, root + 1000), key=lambda a: (-self.size % a, a))
        self.cols = -(-self.size // self.rows)
        self.places = self.rows * self.cols

    def at(self, step: Column, key: Column) -> Column:
        left, right = self._quotient(step), F.pmod(step, F.lit(self.cols))
        for r in range(self.ROUNDS):
            left = F.pmod(left + hashed(key, F.lit(2 * r), right), F.lit(self.rows))
            right = F.pmod(right + hashed(key, F.lit(2 * r + 1), left), F.lit(self.cols))
        return left * self.cols + right

    def looked_up(self, walk: DataFrame, step: str, key: Column, tables: list[str], name: str) -> DataFrame:
        """Adds ``at`` of each step, by the key's ``tables`` where the row has them."""

        def turn(r: int, place: str) -> Column:
            return F.when(F.col(tables[r]).isNull(), hashed(key, F.lit(r), F.col(place))).otherwise(F.get(tables[r], F.col(place).cast("int")))

        walk = walk.withColumns({"_left": self._quotient(F.col(step)), "_right": F.pmod(step, F.lit(self.cols))})
        # column by column, as one expression would repeat both branches of each round in the next
        for r in range(self.ROUNDS):
            walk = walk.withColumn("_left", F.pmod(F.col("_left") + turn(2 * r, "_right"), F.lit(self.rows)))
            walk = walk.withColumn("_right", F.pmod(F.col("_right") + turn(2 * r + 1, "_left"), F.lit(self.cols)))
        return walk.withColumn(name, F.col("_left") * self.cols + F.col("_right")).drop("_left", "_right")

    def tables(self, key: Column) -> list[Column]:
        """What each round adds, for all places it depends on: rows + cols hashes a round."""

        def table(r: int, sources: int, size: int) -> Column:
            places = F.sequence(F.lit(0).cast("long"), F.lit(sources - 1).cast("long"))
            return F.transform(places, lambda p: F.pmod(hashed(key, F.lit(r), p), F.lit(size)).cast("int"))

        sides = [(self.cols, self.rows), (self.rows, self.cols)]
        return [table(r, *sides[r % 2]) for r in range(2 * self.ROUNDS)]

    def step_of(self, place: Column, key: Column) -> Column:
        left, right = self._quotient(place), F.pmod(place, F.lit(self.cols))
        for r in reversed(range(self.ROUNDS)):
            right = F.pmod(right - hashed(key, F.lit(2 * r + 1), left), F.lit(self.cols))
            left = F.pmod(left - hashed(key, F.lit(2 * r), right), F.lit(self.rows))
        return left * self.cols + right

    def _quotient(self, number: Column) -> Column:
        # not by a double, which is inexact above 2^53
        return F.call_function("div", number, F.lit(self.cols))


def index_grid(grid: DataFrame, cell: str = "cell") -> DataFrame:
    return global_index(grid, [cell], "idx")


def slot_number(date: str, window_hour: str) -> Column:
    return (F.unix_date(F.col(date)).cast("long") * SLOTS_PER_DAY + (F.col(window_hour) / 6).cast("long")).alias("slot")


def day_matched_negatives(
    positives: DataFrame,
    grid: DataFrame,
    ratio: int = 10,
    seed: int = 42,
    cell: str = "cell",
    date: str = "date_utc",
    window: str = "window_hour",
) -> DataFrame:
    """``ratio`` event-free cells per positive row, drawn inside the same (date, window).

    ``grid`` carries a dense 0-based ``idx``.  Each slot has its own pseudo-random order of
    the cells and keeps the first wanted ones without an event.  A slot with fewer than
    ``ratio`` free cells gives nothing.  The steps that meet an event are found from the
    events, not by walking: the order is cut into blocks of 65,536 steps, each block knows its
    steps to pass over, and only steps that are kept become rows.  A block that keeps more
    steps than its order has different hashes makes these once.  Blocks are spread over
    tasks, so a crowded slot is shared out.  Positives outside the grid count as wanted rows.
    """
    width = shuffle_width(positives.sparkSession)
    size = grid.count()
    order = Permutation(size)
    key = F.concat_ws(":", F.lit(seed), "slot")
    slots = positives.withColumn("slot", slot_number(date, window))
    wanted = slots.groupBy("slot", date, window).agg(F.count(F.lit(1)).alias("rows"))
    taken = slots.select("slot", cell).distinct().join(grid.select(cell, "idx"), cell)
    taken = taken.select("slot", F.col("idx").cast("long").alias("place"))
    hits = taken.groupBy("slot").agg(F.count(F.lit(1)).alias("e"))
    free = F.lit(size) - F.col("e")
    plan = (
        wanted.join(hits, "slot", "left")
        .withColumn("e", F.coalesce("e", F.lit(0)))
        .where(free >= ratio)
        .withColumn("k", F.least(F.col("rows") * ratio, free))
        .withColumn("steps", F.col("k") + F.col("e") + (order.places - order.size))
        .select("slot", date, window, "k", "steps")
    )
    if order.places > order.size:
        spare = F.sequence(F.lit(order.size).cast("long"), F.lit(order.places - 1).cast("long"))
        taken = taken.unionByName(plan.select("slot", F.explode(spare).alias("place")))
    passed = taken.withColumn("i", order.step_of(F.col("place"), key)).withColumn("block", F.call_function("div", "i", F.lit(BLOCK)))
    # at most BLOCK steps a block
    passed = passed.groupBy("slot", "block").agg(F.collect_list("i").alias("passed"))
    last = F.call_function("div", F.col("steps") - 1, F.lit(BLOCK))
    blocks = plan.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    first = F.col("block") * BLOCK
    length = F.least(first + BLOCK, F.col("steps")) - first
    before = Window.partitionBy("slot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        blocks.join(passed, ["slot", "block"], "left")
        .withColumn("passed", F.filter("passed", lambda i: i < first + length))
        .withColumn("free", length - F.coalesce(F.size("passed"), F.lit(0)))
        .withColumn("left", F.col("k") - F.coalesce(F.sum("free").over(before), F.lit(0)))
        .where((F.col("left") > 0) & (F.col("free") > 0))
    )
    # an explicit number keeps adaptive execution from merging rows that are about to grow
    blocks = blocks.repartition(width, "slot", "block")
    steps = F.array_except(F.sequence(first, first + length - 1), F.coalesce("passed", F.array().cast("array<bigint>")))
    kept = F.slice(steps, 1, F.least(F.col("left"), F.lit(BLOCK)).cast("int"))
    # made before the steps become rows, and not for a few of them
    many = F.least(F.col("left"), F.col("free")) > order.rows + order.cols
    tables = [F.when(many, table).alias(f"_t{r}") for r, table in enumerate(order.tables(key))] if order.rows + order.cols < BLOCK else []
    walk = blocks.select("slot", date, window, kept.alias("kept"), *tables)
    # never empty; without "outer" the planner would make the lists twice to test them
    walk = walk.select("slot", date, window, F.explode_outer("kept").alias("i"), *[f"_t{r}" for r in range(len(tables))])
    if tables:
        walk = order.looked_up(walk, "i", key, [f"_t{r}" for r in range(len(tables))], "idx")
    else:
        walk = walk.withColumn("idx", order.at(F.col("i"), key))
    # never null, which the planner can't see; it would work out each place twice to test it
    walk = walk.select(F.coalesce("idx", F.lit(-1)).alias("idx"), date, window)
    if size > HASHED_GRID:
        # a task's share of the cells fits a hash table, so the many rows of the walk aren't sorted
        grid = grid.hint("shuffle_hash")
    return walk.join(grid, "idx").drop("idx").withColumn("label", F.lit(0))


def hyper_negatives(grid: DataFrame, events: DataFrame, n: int, dates: DataFrame, cell="cell", date="date_utc", window="window_hour", seed: int = 42) -> DataFrame:
    """``n`` random (cell, date, window) triples without an event, dates not matched.

    ``dates`` carries a dense ``date_idx``.  One pseudo-random order runs over the whole
    windows x dates x cells space; the first ``n`` free places of it are taken, or all.
    """
    spark = grid.sparkSession
    n_cells, n_dates = grid.count(), dates.count()
    space = n_cells * n_dates * SLOTS_PER_DAY
    order = Permutation(space)
    taken = events.select(cell, date, window).distinct()
    steps = min(order.places, n + taken.count() + order.places - space) if space else 0
    walk = spark.range(0, steps, numPartitions=shuffle_width(spark))
    walk = walk.select(F.col("id").alias("i"), order.at(F.col("id"), F.lit(seed)).alias("place")).where(F.col("place") < space)
    day = F.call_function("div", "place", F.lit(n_cells))
    walk = walk.select(
        "i",
        F.pmod("place", F.lit(n_cells)).alias("idx"),
        F.pmod(day, F.lit(n_dates)).alias("date_idx"),
        (F.call_function("div", day, F.lit(n_dates)) * 6).cast("int").alias(window),
    )
    named = walk.join(grid, "idx").join(dates, "date_idx").drop("date_idx")
    free = named.join(taken, [cell, date, window], "left_anti")
    numbered = global_index(free.drop("idx"), ["i"], "_n")
    return numbered.where(F.col("_n") < n).drop("_n", "i").withColumn("label", F.lit(0))


def valid_pixels(pixels: DataFrame, layers: list[str]) -> DataFrame:
    """(row, col) where every one of ``layers`` has a value."""
    present = F.col("value").isNotNull() & ~F.isnan("value")
    per = pixels.where(F.col("layer").isin(*layers) & present).groupBy("row", "col")
    return per.agg(F.countDistinct("layer").alias("_l")).where(F.col("_l") == len(layers)).drop("_l")


def spatial_negatives(
    pool: DataFrame,
    events: DataFrame,
    n: int,
    km: float,
    order: Column,
    lat: str,
    lon: str,
    pool_id: str,
    event_lat: str,
    event_lon: str,
    event_id: str,
) -> DataFrame:
    """``n`` pool points farther than ``km`` from every event, in the given hashed order.

    Without replacement while the pool lasts; a short pool is gone through again. Where events
    leave no point of the pool, there is none to draw.
    """
    # written once: it is counted, cut into bins and ranked
    far = cut_lineage(exclude_within(pool, events, lat, lon, event_lat, event_lon, event_id, km))
    ranked = global_index(far.withColumn("_h", order), ["_h", pool_id], "_n")
    left = far.count()
    rounds = max(-(-n // left), 1) if left else 1
    again = F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))
    drawn = ranked.withColumn("_round", again).withColumn("_n", F.col("_round") * left + F.col("_n"))
    return drawn.where(F.col("_n") < n).drop("_h", "_round").withColumnRenamed("_n", "draw")


def draw_dates(points: DataFrame, events: DataFrame, date: str, event_id: str, draw: str = "draw", seed: int = 42, key: Column | None = None) -> DataFrame:
    """Dates drawn with replacement from the events' dates, so frequent dates stay frequent."""
    dated = global_index(events.where(F.col(date).isNotNull()).select(date, event_id), [event_id], "_slot")
    total = events.agg(F.count(date)).scalar()
    return points.withColumn("_slot", F.pmod(mix(seed, draw) if key is None else key, total)).join(dated.drop(event_id), "_slot").drop("_slot")


def random_negatives(spark, events, bbox: tuple[float, float, float, float], n: int, km: float, event_lat, event_lon, event_id, seed: int = 42, over: int = 2, least_share: float = 1e-6, covered: str = "error") -> DataFrame:
    """The first ``n`` points of a uniform sequence over a box that lie outside ``km`` of events.

    Points are drawn in runs; each run is tested once, and the next is as long as the share
    of free points so far asks for.  While none is free, runs double; once 1 / ``least_share``
    points hold none, the box counts as covered: an error says so, or, with ``covered`` as
    "empty", there are no rows.
    """
    if covered not in ("error", "empty"):
        raise ValueError(f"unknown choice {covered!r}")
    south, north, west, east = bbox
    done, found, parts = 0, 0, None
    while parts is None or found < n:
        share = found / done if done else 1 / over
        run = max(math.ceil((n - found) / share * 1.1) if share else done, 1000)
        drawn = spark.range(done, done + run, numPartitions=shuffle_width(spark)).select(
            "id",
            (uniform(seed, "id") * (north - south) + south).alias("lat"),
            (uniform(seed + 1, "id") * (east - west) + west).alias("lon"),
        )
        far = cut_lineage(exclude_within(drawn, events, "lat", "lon", event_lat, event_lon, event_id, km))
        fresh = far.count()
        done, found = done + run, found + fresh
        parts = far if parts is None else parts.unionByName(far)
        if found < n and not found and done * least_share >= 1:
            if covered == "empty":
                break
            raise ValueError(f"events cover the box: none of {done} points lies outside")
    return global_index(parts, ["id"], "_n").where(F.col("_n") < n).drop("_n")


def undersample(df: DataFrame, label: str, ratio: float, order: Column, key: str) -> DataFrame:
    """All positives and the first ratio * positives negatives in a hashed order."""
    pos, neg = df.where(F.col(label) == 1), df.where(F.col(label) == 0)
    keep = pos.agg(F.floor(F.count(F.lit(1)) * ratio)).scalar()
    ranked = global_index(neg.withColumn("_h", order), ["_h", key], "_n")
    return pos.unionByName(ranked.where(F.col("_n") < keep).drop("_h", "_n"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    pos, neg = F.count(F.when(F.col(label) == 1, 1)), F.count(F.when(F.col(label) == 0, 1))
    return df.agg(pos.alias("positives"), neg.alias("negatives"), F.when(pos > 0, neg / pos).otherwise(F.lit(1.0)).alias("weight"))


def with_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = class_weight(df, label).select("weight").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, w).otherwise(F.lit(1.0)))


def chronological_split(df: DataFrame, part: Column, train_to: int, val_to: int, name: str = "split") -> DataFrame:
    split = F.when(part <= train_to, "train").when(part <= val_to, "val").otherwise("test")
    return df.withColumn(name, split)


def expanding_folds(df: DataFrame, date: str, n: int = 3) -> DataFrame:
    """Distinct dates cut into n + 1 runs; fold f trains on runs <= f and tests on run f + 1."""
    # one row per calendar date
    days = df.select(date).distinct().withColumn("run", F.ntile(n + 1).over(Window.partitionBy(F.lit(0)).orderBy(date)))
    return df.join(days, date)


def in_region(df: DataFrame, lat: str, lon: str, bbox) -> DataFrame:
    return df.where(in_bbox(lat, lon, *bbox))


def smote(df: DataFrame, key: str, features: list[str], n: int, k: int = 5, seed: int = 42, lines: int = 4, reach: int = 8) -> DataFrame:
    """``n`` synthetic rows between minority rows and close minority neighbours.

    Candidate neighbours are the rows next to each other along a few random directions,
    at most 2 * reach per direction, then the ``k`` closest are kept.  Fewer than two rows have
    no neighbours and give no synthetic rows.
    """
    # written once: every direction orders it anew
    base = cut_lineage(df.select(F.col(key).alias("_id"), F.array(*[F.col(f).cast("double") for f in features]).alias("_v")))
    pairs = None
    for line in range(lines):
        weights = [((i * 2654435761 + line * 40503 + seed * 97) % 2000) / 1000.0 - 1.0 for i in range(1, len(features) + 1)]
        proj = sum((F.col("_v")[i] * w for i, w in enumerate(weights)), F.lit(0.0))
        ranked = global_index(base.withColumn("_p", proj), ["_p", "_id"], "_n")
        offsets = F.explode(F.array(*[F.lit(o) for o in range(-reach, reach + 1) if o]))
        near = ranked.withColumn("_o", offsets).select(F.col("_id").alias("a"), F.col("_v").alias("va"), (F.col("_n") + F.col("_o")).alias("_n"))
        other = ranked.select("_n", F.col("_id").alias("b"), F.col("_v").alias("vb"))
        part = near.join(other, "_n").drop("_n")
        pairs = part if pairs is None else pairs.unionByName(part)
    d2 = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.withColumn("d2", d2).dropDuplicates(["a", "b"])
    w = Window.partitionBy("a").orderBy("d2", "b")
    close = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    start = global_index(base.select("_id"), ["_id"], "_n")
    size = start.count()
    neighbours = max(min(k, size - 1), 1)
    draws = df.sparkSession.range(0, n if size > 1 else 0, numPartitions=shuffle_width(df.sparkSession)).select(
        F.col("id").alias("draw"),
        F.pmod("id", F.lit(max(size, 1))).alias("_n"),
        (F.pmod(mix(seed, "id"), F.lit(neighbours)) + 1).cast("int").alias("rank"),
        uniform(seed + 1, "id").alias("u"),
    )
    picked = draws.join(start, "_n").join(close, (F.col("_id") == F.col("a")) & (close["rank"] == draws["rank"]))
    mixed = [(F.col("va")[i] + (F.col("vb")[i] - F.col("va")[i]) * F.col("u")).alias(f) for i, f in enumerate(features)]
    return picked.select("draw", F.col("a").alias("base_id"), F.col("b").alias("other_id"), "u", *mixed)
