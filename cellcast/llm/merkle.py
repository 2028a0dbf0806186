"""A Merkle manifest of a table: leaf digests, a tree for each source, one root, proofs of all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import ranked

#: A row's values in the order in which a leaf takes them.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Shape:
    """``fan`` nodes make one of the next level; a superblock holds ``height`` levels."""

    fan: int = 3
    height: int = 7

    @property
    def block(self) -> int:
        return self.fan**self.height

    def levels(self, nodes: int) -> int:
        """Levels of a superblock of a tree that has ``nodes`` nodes at the superblock's foot."""
        count = 0
        while nodes > 1 and count < self.height:
            nodes = -(-nodes // self.fan)
            count += 1
        return count


def digest(parts: Iterable[bytes]) -> bytes:
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(values: Iterable[Column]) -> Column:
    """Lowercase hex sha256 of values, each ``-`` if null, else its byte count, ``:`` and itself."""
    parts = []
    for v in values:
        as_text = v.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(as_text).cast("string"), F.lit(":"), as_text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered_leaves(leaves: DataFrame) -> DataFrame:
    """Adds (src, n, pos) to rows (doc_id, source, digest, ...): position and number of a source's leaves.

    Rows are sorted by range of (source, doc_id, digest), nulls first; so a source that holds
    a third of all rows spans many tasks. ``src`` is the place of its first leaf among all.
    What is summed over tasks is one row for each source of a task.
    """
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest")]
    placed = cut_lineage(
        leaves.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "leaves-placed"
    ).withColumn("part", F.shiftright("at", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("part")
        .agg(F.count("*").alias("rows"))
        .select(F.col("part").alias("of_part"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    )
    runs = placed.groupBy("part", "source").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    place = F.col("start") - F.shiftleft("part", 33)
    runs = cut_lineage(
        runs.join(starts, F.col("part") == F.col("of_part")).select(
            "part", "source", "rows", (F.col("first") + place).alias("first"), place.alias("shift")
        ),
        "leaves-runs",
    )
    sources = runs.groupBy(F.col("source").alias("of_source")).agg(F.sum("rows").alias("n"), F.min("first").alias("src"))
    runs = cut_lineage(
        runs.join(sources, F.col("source").eqNullSafe(F.col("of_source"))).select(
            F.col("part").alias("of_part"), "of_source", "src", "n", "shift"
        ),
        "leaves-sources",
    )
    here = (F.col("part") == F.col("of_part")) & F.col("source").eqNullSafe(F.col("of_source"))
    pos = (F.col("at") + F.col("shift") - F.col("src")).alias("pos")
    own = [c for c in leaves.columns if c != "source"]
    return cut_lineage(placed.join(runs, here).select("src", "n", pos, *own), "leaves-numbered")


def _key(shape: Shape, layer: int, block: Column) -> Column:
    """The task key of a superblock: those that start within the same stretch of leaves share it.

    A stretch is as long as a superblock of the layer, so small trees meet in one group and a
    group holds a few superblocks' nodes at most, whatever the sizes of trees.
    """
    return (F.floor(F.col("src") / shape.block ** (layer + 1)) + block).cast("long").alias("key")


def _blocks(frame: pd.DataFrame, shape: Shape) -> Iterator[tuple[tuple[int, int], int, list[int], list[bytes]]]:
    """((src, block), n, row numbers, digests) of the superblocks in a group of nodes."""
    frame = frame.reset_index(drop=True)
    frame = frame.assign(block=frame["pos"] // shape.block).sort_values(["src", "pos"])
    for name, part in frame.groupby(["src", "block"], sort=False):
        yield name, int(part["n"].iloc[0]), part.index.tolist(), [d.encode() for d in part["digest"]]


def _climb(nodes: list[bytes], levels: int, shape: Shape) -> list[list[bytes]]:
    """All levels of a superblock; a last run may be short, even one node, and is hashed too."""
    tree = [nodes]
    for _ in range(levels):
        low = tree[-1]
        tree.append([digest(low[i : i + shape.fan]) for i in range(0, len(low), shape.fan)])
    return tree


def _block_roots(nodes: DataFrame, layer: int, shape: Shape) -> DataFrame:
    """Rows (src, n, pos, digest): a layer's superblocks as nodes of the next layer."""

    def reduced(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (src, block), n, _, digests in _blocks(frame, shape):
            top = _climb(digests, shape.levels(n), shape)[-1][0]
            rows.append((src, -(-n // shape.block), block, top.decode()))
        return pd.DataFrame(rows, columns=["src", "n", "pos", "digest"])

    block = F.floor(F.col("pos") / shape.block)
    keyed = nodes.select("src", "n", "pos", "digest", _key(shape, layer, block))
    return keyed.groupBy("key").applyInPandas(reduced, "src bigint, n bigint, pos bigint, digest string")


def climb_layers(nodes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame | None]:
    """Layers of nodes, each of the superblocks of the one below, and (src, layer, digest) of the trees' roots.

    The deepest tree decides the number of layers; a tree has no node in layers above its root.
    """
    most = nodes.agg(F.max("n")).first()[0]
    layers, roots = [], []
    while most:
        layers.append(nodes)
        up = cut_lineage(_block_roots(nodes, len(layers) - 1, shape), "tree-layer")
        roots.append(up.where("n = 1").select("src", F.lit(len(layers) - 1).alias("layer"), "digest"))
        nodes, most = up.where("n > 1"), -(-most // shape.block)
        if most == 1:
            break
    return layers, reduce(DataFrame.unionByName, roots) if roots else None


#: What a superblock needs of the nodes outside it: the siblings on its way up, ``left.right`` a
#: level and ``|`` between levels, and the roots it leads to.
OUTER = "src bigint, block bigint, path string, subroot string, root string"


def _steps(path: str) -> list[tuple[bytes, bytes]]:
    return [tuple(side.encode() for side in level.split(".")) for level in path.split("|")] if path else []


def _siblings(tree: list[list[bytes]], spot: int, shape: Shape) -> list[tuple[bytes, bytes]]:
    """Joined digests left and right of a node, level by level up to the superblock's root."""
    out = []
    for level in tree[:-1]:
        first = spot - spot % shape.fan
        out.append((b"".join(level[first:spot]), b"".join(level[spot + 1 : first + shape.fan])))
        spot //= shape.fan
    return out


def fold(value: bytes, siblings: Iterable[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and the siblings on its way up lead to."""
    for left, right in siblings:
        value = digest((left, value, right))
    return value


def _meet(nodes: DataFrame, outer: DataFrame, layer: int, shape: Shape):
    """Nodes and outer nodes of a layer, cogrouped by superblock."""
    block = F.floor(F.col("pos") / shape.block)
    left = nodes.select("*", _key(shape, layer, block)).groupBy("key")
    right = outer.select("*", _key(shape, layer, F.col("block"))).groupBy("key")
    return left.cogroup(right)


def _outer_of(frame: pd.DataFrame) -> dict[tuple[int, int], tuple[str, str, str]]:
    return {(r.src, r.block): (r.path, r.subroot, r.root) for r in frame.itertuples()}


def _descend(nodes: DataFrame, outer: DataFrame, layer: int, shape: Shape) -> DataFrame:
    """The outer nodes of each node of a layer, which is a superblock of the layer below."""

    def extended(frame: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows, outside = [], _outer_of(around)
        for name, n, places, digests in _blocks(frame, shape):
            path, subroot, root = outside[name]
            tree = _climb(digests, shape.levels(n), shape)
            positions = frame["pos"].tolist()
            for spot, place in enumerate(places):
                own = "|".join(f"{a.decode()}.{b.decode()}" for a, b in _siblings(tree, spot, shape))
                rows.append((name[0], positions[place], "|".join(filter(None, (own, path))), subroot, root))
        return pd.DataFrame(rows, columns=["src", "block", "path", "subroot", "root"])

    nodes = nodes.select("src", "n", "pos", "digest")
    return cut_lineage(_meet(nodes, outer, layer, shape).applyInPandas(extended, OUTER), "tree-outer")


def _down_to_leaves(layers: list[DataFrame], tops: DataFrame, shape: Shape) -> DataFrame:
    """The outer nodes of the superblocks of the lowest layer; ``tops`` are rows of OUTER and layer."""
    outer = None
    for layer in range(len(layers) - 1, -1, -1):
        here = tops.where(F.col("layer") == layer).drop("layer")
        outer = here if outer is None else here.unionByName(outer)
        if layer:
            outer = _descend(layers[layer], outer, layer, shape)
    return outer


PROOF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(leaves: DataFrame, outer: DataFrame, shape: Shape) -> DataFrame:
    """Finishes superblocks: reduces their leaves, joins both parts of each proof, folds it."""

    def finished(frame: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        rows, outside = [], _outer_of(around)
        ids, given = frame["doc_id"].tolist(), frame["given"].tolist()
        for name, n, places, digests in _blocks(frame, shape):
            path, subroot, root = outside[name]
            tree = _climb(digests, shape.levels(n), shape)
            above = _steps(path)
            upper = b"".join(side for level in above for side in level)
            known: dict[bytes, str] = {}
            for spot, place in enumerate(places):
                beside = _siblings(tree, spot, shape)
                proof = digest([*(side for level in beside for side in level), upper]).decode()
                at_block = fold(given[place].encode(), beside)
                if at_block not in known:
                    known[at_block] = fold(at_block, above).decode()
                found = known[at_block]
                rows.append((ids[place], digests[spot].decode(), subroot, root, proof, found, found == root))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PROOF.split(", ")])

    return _meet(leaves, outer, 0, shape).applyInPandas(finished, PROOF)


def prove(rows: DataFrame, given: Column | None = None, shape: Shape = Shape()) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one for each row.

    Leaves are digests of FIELDS. The leaves of a source ascend by doc_id; nodes are hashed in
    runs of ``shape.fan`` until one is left, the source's subroot; subroots, ordered by source,
    likewise give the root. ``given`` is the text that is held against the manifest, the
    row's own if not named: folded_root is what its leaf and the row's siblings lead to.

    Trees are cut into superblocks of seven levels. First each superblock is reduced to one
    node, layer by layer; then the nodes outside each superblock are handed down, and leaves and
    outer nodes are cogrouped by superblock, where proofs are joined and folded. So no group
    holds more than a few superblocks, and no path is kept per row.

    Nulls count as ``-``: a null source is a source of its own, the first; a null doc_id comes
    first in its source. Rows of equal doc_id ascend by leaf, so repeated rows each have a
    leaf, and their order cannot show. Empty texts differ from null ones. Other columns are
    ignored; an empty table has no leaves and no root.
    """
    values = {c: F.col(c) for c in FIELDS}
    leaf = leaf_digest(values.values())
    changed = leaf if given is None else F.when(given.eqNullSafe(F.col("text")), leaf).otherwise(
        leaf_digest((values | {"text": given}).values())
    )
    leaves = cut_lineage(rows.select("doc_id", "source", leaf.alias("digest"), changed.alias("given")), "leaves")
    numbered = numbered_leaves(leaves).withColumn("doc_id", F.col("doc_id").cast("string"))
    layers, subroots = climb_layers(numbered, shape)
    kind = rows.schema["doc_id"].dataType
    if subroots is None:
        return rows.sparkSession.createDataFrame([], PROOF).withColumn("doc_id", F.col("doc_id").cast(kind))
    subroots = cut_lineage(subroots, "tree-subroots")
    ordered = ranked(subroots, F.col("src"), name="place")
    sources = cut_lineage(
        ordered.select(
            F.lit(0).cast("long").alias("src"),
            F.lit(subroots.count()).alias("n"),
            (F.col("place") - 1).alias("pos"),
            "digest",
            F.col("src").alias("tree"),
            "layer",
        ),
        "tree-sources",
    )
    upper, roots = climb_layers(sources, shape)
    top = roots.select("src", F.lit(0).cast("long").alias("block"), F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"), "layer")
    outer = _descend(sources, _down_to_leaves(upper, top, shape), 0, shape)
    tops = sources.select("tree", "pos", "digest", "layer").join(
        outer.select(F.col("block").alias("pos"), "path", "root"), "pos"
    )
    tops = cut_lineage(
        tops.select(F.col("tree").alias("src"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root", "layer"),
        "tree-tops",
    )
    proofs = _proofs(numbered, _down_to_leaves(layers, tops, shape), shape)
    return proofs.withColumn("doc_id", F.col("doc_id").cast(kind))
