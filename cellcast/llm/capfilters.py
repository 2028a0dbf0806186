"""Near-duplicates among embeddings by spherical-cap filters of structured random codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width
from .common import components
from .grouped import padded_lists, whole_groups

#: A dimension of so few vectors needs no filter: all are compared.
FEW = 64
#: Vectors of one filter that are compared at once; larger filters are cut into blocks.
BLOCK = 1024


@dataclass(frozen=True)
class ProductCode:
    """Filter directions that are all combinations of a random code word for each part.

    A vector is turned by a random rotation and cut into ``parts``; every part has ``words``
    unit vectors. A direction is one word for each part, scaled to length 1, so there are
    words ** parts directions and none is ever listed. ``alpha`` is the least inner product
    at which a vector is inside a direction's cap.
    """

    dim: int
    parts: int
    words: int
    alpha: float
    least: int = 1
    seed: int = 17

    @staticmethod
    def sized(dim: int, parts: int, words: int, caps: int) -> ProductCode:
        """Alpha such that a vector lies in about ``caps`` of the words ** parts caps."""
        share = min(0.5, caps / words**parts)
        return ProductCode(dim, parts, words, NormalDist().inv_cdf(1 - share) * dim**-0.5, caps)

    def tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        rng = np.random.default_rng(self.seed)
        rotation, _ = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))
        edges = np.linspace(0, self.dim, self.parts + 1).astype(int)
        code = []
        for a, b in zip(edges, edges[1:]):
            draw = rng.standard_normal((self.words, b - a))
            code.append(draw / np.linalg.norm(draw, axis=1, keepdims=True) * self.parts**-0.5)
        return rotation, code

    def decoder(self):
        """A function from unit vectors to the directions of the caps each lies in.

        A combination of words is followed part by part only while the best words of the
        remaining parts could still reach alpha. A vector that lies in fewer than ``least``
        caps is decoded again with a smaller alpha, so none is left out.
        """
        rotation, code = self.tables()
        edges = np.linspace(0, self.dim, self.parts + 1).astype(int)

        def reached(unit: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
            turned = unit @ rotation
            gains = [turned[:, a:b] @ c.T for a, b, c in zip(edges, edges[1:], code)]
            rest = np.zeros((self.parts + 1, len(unit)))
            for k in range(self.parts - 1, -1, -1):
                rest[k] = rest[k + 1] + gains[k].max(1)
            rows = np.arange(len(unit))
            sums, names = np.zeros(len(unit)), np.zeros(len(unit), np.int64)
            for k, gain in enumerate(gains):
                reach = sums[:, None] + gain[rows] + rest[k + 1][rows][:, None]
                at, word = np.nonzero(reach >= alpha)
                sums = sums[at] + gain[rows[at], word]
                names = names[at] * self.words + word
                rows = rows[at]
            return rows, names

        def decode(unit: np.ndarray) -> list[list[int]]:
            lists: list[list[int]] = [[] for _ in unit]
            todo, alpha = np.arange(len(unit)), self.alpha
            least = min(self.least, self.words**self.parts)
            while len(todo):
                rows, names = reached(unit[todo], alpha)
                done = np.bincount(rows, minlength=len(todo)) >= least
                for row, name in zip(rows[done[rows]].tolist(), names[done[rows]].tolist()):
                    lists[todo[row]].append(name)
                todo = todo[~done]
                alpha -= 0.04 * abs(self.alpha) + 1e-3
            return lists

        return decode


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. A power of two is taken out first, so that no finite row overflows
    or vanishes and all others keep their digits."""
    _, power = np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))
    x = np.ldexp(x, -power)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vectors: list, dim: int | None) -> tuple[np.ndarray, list[int]]:
    """Unit vectors in double precision and their rows; others can't be compared."""
    rows, kept = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all() and x.any() and (dim is None or len(x) == dim):
            rows.append(x)
            kept.append(i)
    return (unit_rows(np.array(rows)) if rows else np.empty((0, dim or 0))), kept


def links_of_group(names: np.ndarray, weights: np.ndarray, unit: np.ndarray, caps: np.ndarray, here: int, side: np.ndarray | None, threshold: float):
    """Links of one block of a cap: for each vector its links counted here, and tree edges.

    A pair is counted only in the first cap that both lie in. ``side`` tells the two blocks
    of a pair of blocks apart; with one block it is None and all pairs count. The edges join
    the linked vectors of the group into trees.
    """
    near = unit @ unit.T >= threshold
    if side is not None:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    if not near.any():
        return np.zeros(len(names), np.int64), []
    # pairs that share a cap before this one, from the caps' incidence
    row, column = np.nonzero((caps >= 0) & (caps < here))
    kinds, kind = np.unique(caps[row, column], return_inverse=True)
    inside = np.zeros((len(names), len(kinds)), np.float32)
    inside[row, kind] = 1
    counts = (near & (inside @ inside.T == 0)) @ weights
    # least row reachable, by repeated steps to the least neighbour
    tree = np.arange(len(names))
    while True:
        low = np.minimum(tree, np.where(near, tree[None, :], len(tree)).min(1))
        low = low[low]
        if (low == tree).all():
            break
        tree = low
    return counts, [(int(names[i]), int(names[t])) for i, t in enumerate(tree) if i != t]


def link_vectors(
    vectors: DataFrame,
    threshold: float = 0.93,
    key: str = "vec_id",
    group: str = "label",
    parts: int = 2,
    caps: int = 20,
    max_words: int = 1 << 16,
) -> DataFrame:
    """Rows (key, n_links, component_id, kept) for vectors linked inside their group.

    Two vectors of one group are linked when their cosine, in double precision, is at least
    ``threshold``. Candidates share a cap of a ``ProductCode``: with 20 caps or more for each
    vector and a cosine of exactly 0.93, fewer than one in a thousand pairs share none
    (measured), closer pairs hardly ever. The number of directions follows the number of
    vectors, which keeps the expected vectors of a cap the same up to max_words ** parts
    (four billion) vectors; caps of more are compared block by block.

    Equal vectors of a group are one node that weighs as many; a cap with more than a block
    of nodes is compared block by block, in tasks of their own. No pair is ever a row: a task
    returns counts and tree edges.

    Vectors of different dimensions aren't compared; each dimension has a code of its own.
    Where there are few vectors, or a code's parts would have less than two coordinates, all
    vectors of a group and dimension share one cap.

    Null, empty, zero, non-finite vectors, vectors with a null inside, and those with a null
    group link with nothing. component_id
    is the smallest key reachable. Rows with the same key are one vector per group and value;
    a null key links with nothing and is kept.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(group).alias("grp"), F.col("embedding").cast("array<double>").alias("v")
    )
    # equal vectors meet as one node; summed before the shuffle
    nodes = cut_lineage(
        rows.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("v").isNotNull())
        .where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .where(F.exists("v", lambda x: x != 0))
        .groupBy("grp", "v")
        .agg(F.min("id").alias("node"), F.count_distinct("id").alias("weight"))
        .withColumn("d", F.size("v")),
        "cap-nodes",
    )
    codes: dict[int, ProductCode | None] = {}
    for row in nodes.groupBy("d").agg(F.count("*").alias("n")).collect():
        words = max(8, min(max_words, round(max(row["n"], 64) ** (1 / parts))))
        filtered = row["n"] > FEW and row["d"] >= 2 * parts
        codes[row["d"]] = ProductCode.sized(row["d"], parts, words, caps) if filtered else None
    group_type = nodes.schema["grp"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders = {}
        for whole in batches:
            dims = whole.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                batch, code = whole.filter(pa.array(dims == dim)), codes[dim]
                if code is None:
                    yield with_caps(batch, [[0]] * batch.num_rows)
                    continue
                if dim not in decoders:
                    decoders[dim] = code.decoder()
                unit, kept = _usable(batch.column(1).to_pylist(), dim)
                step = max(1, min(512, (1 << 21) // code.words))  # bounds the table of inner products
                for at in range(0, len(kept), step):
                    lists = decoders[dim](unit[at : at + step])
                    yield with_caps(batch.take(pa.array(kept[at : at + step])), [sorted(c) for c in lists])

    def with_caps(part: pa.RecordBatch, lists: list[list[int]]) -> pa.RecordBatch:
        caps_of = pa.array(lists, pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*part.columns, caps_of], names=["grp", "v", "node", "weight", "d", "caps"])

    listing = cut_lineage(
        nodes.mapInArrow(listed, f"grp {group_type}, v array<double>, node bigint, weight bigint, d int, caps array<bigint>"), "caps"
    )
    placed = listing.select("grp", "d", "node", F.explode("caps").alias("cap"))
    # blocks of each cap that holds two nodes or more
    held = cut_lineage(
        placed.groupBy("grp", "d", "cap").agg(F.count("*").alias("n")).where("n > 1").select(
            "grp", "d", "cap", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")
        ),
        "cap-sizes",
    )
    spots = cut_lineage(placed.join(held.hint("merge"), ["grp", "d", "cap"]), "cap-spots")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spots = (
        spots.withColumn("block", block)
        .withColumn("other", other)
        .select(
            "grp",
            "d",
            "node",
            "cap",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"),
        )
    )
    width = shuffle_width(spark)
    filled = spots.join(listing.drop("grp").hint("merge"), ["node", "d"])
    keys = ["d", "cap", "i", "j"]
    dealt = filled.select("grp", *keys, "side", "node", "weight", "v", "caps").repartition(width, "grp", *keys)
    dealt = dealt.sortWithinPartitions("grp", *keys)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 5):
            cap, i, j, side, node, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 8))
            lists = padded_lists(batch.column(9), -1)
            a, b, n = [], [], []
            for start, stop in bounds:
                if stop - start < 2:
                    continue
                rank = np.argsort(node[start:stop], kind="stable")
                order = start + rank
                flat = np.asarray(batch.column(8).slice(start, stop - start).flatten())
                unit = unit_rows(flat.reshape(stop - start, -1))[rank]
                sides = side[order] if i[start] != j[start] else None
                counts, edges = links_of_group(
                    node[order], weight[order], unit, lists[order], cap[start], sides, threshold
                )
                some = np.flatnonzero(counts)
                a += [*node[order][some].tolist(), *[e[0] for e in edges]]
                b += [*[None] * len(some), *[e[1] for e in edges]]
                n += [*counts[some].tolist(), *[0] * len(edges)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"]
            )

    found_links = cut_lineage(dealt.mapInArrow(compare, "a bigint, b bigint, n bigint"), "cap-links")
    joined = components(found_links.where("b is not null").select("a", "b"))
    links = found_links.groupBy("a").agg(F.sum("n").alias("outer_links"))
    facts = cut_lineage(
        nodes.join(links, nodes["node"] == links["a"], "left")
        .join(joined, F.col("node") == F.col("id"), "left")
        .select(
            "grp",
            "v",
            (F.coalesce("outer_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component_id"),
        ),
        "cap-facts",
    )
    same = facts.select(F.col("grp").alias("g"), F.col("v").alias("w"), "n_links", "component_id").hint("merge")
    out = rows.where(F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("v").isNotNull())
    out = out.select("id", "grp", "v").join(same, (F.col("grp") == F.col("g")) & (F.col("v") == F.col("w")), "left")
    alone = rows.where(F.col("id").isNull() | F.col("grp").isNull() | F.col("v").isNull())
    alone = alone.select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    both = out.select("id", "n_links", "component_id").unionByName(alone)
    component = F.coalesce("component_id", "id")
    return both.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
