"""Near-duplicate documents by a chosen-path similarity join on minwise tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width
from .common import components, fresh
from .grouped import padded_lists, whole_groups
from .shingles import fingerprint, min_hashes, shingle_sets


@dataclass(frozen=True)
class PathJoin:
    """Parameters of the join: link at 100 * shared >= percent * united shingles.

    ``tokens`` minwise tokens describe a document. Each of ``trees`` independent trees sends
    it down one token of every node, chosen by the node, and down a second token so often
    that a pair of the least similarity shares one child of a node on average: it stays
    together for long, dissimilar documents part fast. A node is small when its documents
    weigh at most ``leaf``; a document weighs 1 and 1 more for each 4096 shingles. The deeper
    its nodes stay large, the more trees a document enters, ``trees`` at least: so many that
    a pair of the least similarity meets in one with probability ``recall``. Nodes that
    are still large after ``stride`` levels may hold documents that are mostly alike: before
    these go on, they are cut into parts that share about ``leaders`` documents. If what is not
    joined then weighs no more than ``leaf``, it is compared with all of the node, part by part,
    and the node is done; else its documents go down ``stride`` levels more, and so on; at
    ``depth`` every node is compared.
    """

    percent: int = 85
    width: int = 5
    tokens: int = 128
    trees: int = 8
    recall: float = 0.99
    leaf: int = 1024
    stride: int = 3
    depth: int = 24
    leaders: int = 16
    seed: int = 97

    @property
    def least_match(self) -> int:
        """Equal tokens, of byte sketches, below which a pair at the limit hardly ever is."""
        p = self.percent / 100
        p += (1 - p) / 256
        return math.floor(self.tokens * p - 4.2 * math.sqrt(self.tokens * p * (1 - p)))


def trees_for(join: PathJoin, steps: int) -> int:
    """Trees in which a pair at the limit has to be to meet with probability ``recall`` when
    its nodes are small after ``steps`` steps.

    The equal tokens of such a pair are binomial; given their share, its nodes in a tree are
    a branching process: one child of each, at times two, and each is shared with that share.
    """
    p, n = join.percent / 100, join.tokens
    weights = np.array([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)])
    share, more, stays = np.arange(n + 1) / n, 1 / p - 1, np.ones(n + 1)
    for _ in range(steps):
        parts = 1 - share * stays
        stays = 1 - (1 - more) * parts - more * parts**2
    trees = join.trees
    while weights @ (1 - stays) ** trees > 1 - join.recall:
        trees += 1
    return trees


#: The general rule for near copies, which the pipeline's stage follows.
STAGE_JOIN = PathJoin(percent=80)


def describe(docs: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (doc_id, n_shingles, fp1, fp2, sig, sketch) of every document, from whole texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = list(shingle_sets(part.column(1).to_pylist(), join.width))
                sig = min_hashes(sets, join.tokens)
                prints = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array([r.tobytes() for r in sig], pa.binary()),
                        pa.array([r.tobytes() for r in sig.astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "sketch"],
                )

    return rows.mapInArrow(
        run, "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig binary, sketch binary"
    )


def _children(join: PathJoin, node: Column) -> Column:
    """The children of ``node`` a document goes to: of one token, at times of two."""

    def child(k: int) -> Column:
        spot = F.pmod(F.xxhash64(node, F.lit(k)), F.lit(join.tokens)).cast("int")
        return F.xxhash64(node, spot, F.substring("sig", spot * 4 + 1, 4))

    more = round((100 / join.percent - 1) * 1_000_000)
    twice = F.pmod(F.xxhash64(node, F.lit(7)), F.lit(1_000_000)) < more
    return F.when(twice, F.array_distinct(F.array(child(1), child(2)))).otherwise(F.array(child(1)))


def at_roots(entering: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (cls, known, weight, node) of the uppermost nodes.

    ``entering`` has (cls, n_shingles, sig, known, first, last): each class enters the trees
    from first to last.
    """
    weight = (1 + F.col("n_shingles") / 4096).alias("weight")
    roots = F.transform(F.sequence("first", "last"), lambda t: F.xxhash64(F.lit(join.seed), t))
    slim = entering.select("cls", "known", weight, "sig", F.explode(roots).alias("parent"))
    return slim.select("cls", "known", "weight", F.explode(_children(join, F.col("parent"))).alias("node"))


def one_down(large: DataFrame, signed: DataFrame, join: PathJoin) -> DataFrame:
    """The rows of large nodes as rows of their children.

    A class meets its tokens once, whatever the number of its nodes.
    """
    held = large.groupBy("cls", "known", "weight").agg(F.collect_list("node").alias("nodes"))
    rows = held.join(signed.hint("merge"), "cls").select("cls", "known", "weight", "sig", F.explode("nodes").alias("node"))
    return rows.select("cls", "known", "weight", F.explode(_children(join, F.col("node"))).alias("node"))


def small_nodes(
    slim: DataFrame, signed: DataFrame, level: int, join: PathJoin
) -> tuple[DataFrame, DataFrame | None, list[DataFrame], int]:
    """Goes down from the rows of one ``level``, ``stride`` levels at most.

    Gives rows (cls, leaf, grp) of the small nodes that hold two classes or more, rows (cls,
    known, weight, node, n, heavy) of the nodes that are large on the last level, None without
    any, rows (cls, steps) of the classes that went on from a large node, and the last level.
    A level counts the documents of its nodes and takes those of the large ones one token
    further; only ids move. ``grp`` is the small node itself. Nodes whose classes are all of one
    known component are finished.
    """
    leaves: list[DataFrame] = []
    deep: list[DataFrame] = []
    last = min(level + join.stride, join.depth)
    while True:
        slim = cut_lineage(slim, "path-level")
        held = cut_lineage(
            slim.groupBy("node")
            .agg(F.count("*").alias("n"), F.sum("weight").alias("heavy"), F.min("known").alias("low"), F.max("known").alias("high"))
            .where("low < high")
            .select("node", "n", "heavy"),
            "path-nodes",
        )
        placed = cut_lineage(slim.join(held.hint("merge"), "node"), "path-placed")
        small = F.col("heavy") <= join.leaf
        leaves.append(placed.where(small).select("cls", F.col("node").alias("leaf"), F.col("node").alias("grp")))
        large = placed.where(~small)
        if large.isEmpty():
            return reduce(DataFrame.unionByName, leaves), None, deep, level
        if level == last:
            return reduce(DataFrame.unionByName, leaves), large, deep, level
        deep.append(went_on(large, level))
        slim = one_down(large, signed, join)
        level += 1


def went_on(large: DataFrame, level: int) -> DataFrame:
    """Rows (cls, steps) of the classes that leave large nodes of a level for the next."""
    return large.select("cls", F.lit(level + 2).alias("steps"))


def _part(join: PathJoin, parts: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(join.seed)), parts).cast("int")


def led_parts(crowded: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (cls, leaf, grp) that cut large nodes into parts; each has the node's leaders too.

    About ``leaders`` classes of a node, drawn by hash, are in all of its parts, so rows grow
    with the node. ``grp`` is the large node: two parts of it have it in common.
    """
    parts = F.ceil(F.col("heavy") * 2 / join.leaf).cast("int")
    draw = F.pmod(F.xxhash64("cls", F.lit(join.seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    everywhere = F.sequence(F.lit(0), parts - 1)
    at = F.when(draw < join.leaders / F.col("n"), everywhere).otherwise(F.array(_part(join, parts)))
    rows = crowded.select("cls", "node", F.explode(at).alias("part"))
    return rows.select("cls", F.xxhash64("node", "part").alias("leaf"), F.col("node").alias("grp"))


def with_core(large: DataFrame, component: DataFrame) -> DataFrame:
    """Rows (cls, known, weight, node, n, heavy, core, stray) of large nodes that aren't joined yet.

    ``component`` has (cls, known). The commonest component of a node is its core; its classes
    are joined already, the others, the strays, weigh ``stray``.
    """
    rest = [c for c in large.columns if c not in ("cls", "known")]
    held = large.groupBy("cls").agg(F.collect_list(F.struct(*rest)).alias("rows"))
    named = held.join(component.hint("merge"), "cls").select("cls", "known", F.explode("rows").alias("row"))
    named = cut_lineage(named.select("cls", "known", "row.*"), "path-crowded")
    shares = named.groupBy("node", "known").agg(F.count("*").alias("n"), F.sum("weight").alias("held"))
    most = F.struct("n", "known")
    cores = cut_lineage(
        shares.groupBy("node")
        .agg(F.max_by("known", most).alias("core"), F.max_by("held", most).alias("held"), F.sum("held").alias("all"), F.count("*").alias("kinds"))
        .where("kinds > 1")
        .select("node", "core", (F.col("all") - F.col("held")).alias("stray")),
        "path-cores",
    )
    return cut_lineage(named.join(cores.hint("merge"), "node"), "path-strays")


def stray_parts(rows: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (cls, leaf, grp) in which every stray class of a large node meets all of the node.

    ``rows`` are those of ``with_core``. Each part of the strays meets each part of the node, so
    strays of at most ``leaf`` cost rows in proportion to the node.
    """
    wide = F.ceil(F.col("heavy") * 2 / join.leaf).cast("int")
    few = F.greatest(F.ceil(F.col("stray") * 2 / join.leaf).cast("int"), F.lit(1))
    as_member = F.transform(F.sequence(F.lit(0), few - 1), lambda k: F.struct(k.alias("few"), _part(join, wide).alias("wide")))
    as_stray = F.transform(F.sequence(F.lit(0), wide - 1), lambda k: F.struct(_part(join, few).alias("few"), k.alias("wide")))
    spots = F.when(F.col("known") == F.col("core"), as_member).otherwise(F.array_union(as_member, as_stray))
    rows = rows.select("cls", "node", F.explode(spots).alias("at"))
    leaf = F.xxhash64("node", F.lit("stray"), "at.few", "at.wide")
    return rows.select("cls", leaf.alias("leaf"), leaf.alias("grp"))


def _match_counts(sketch: np.ndarray) -> np.ndarray:
    """For each pair of rows how many of their tokens' bytes are equal."""
    n = len(sketch)
    out = np.empty((n, n), np.int16)
    step = max(1, (1 << 21) // (n * sketch.shape[1]))
    for at in range(0, n, step):
        out[at : at + step] = (sketch[at : at + step, None, :] == sketch[None, :, :]).sum(2)
    return out


def candidate_pairs(sketch: np.ndarray, sizes: np.ndarray, join: PathJoin) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows that may be linked by sizes and sketches, the most similar first."""
    match = _match_counts(sketch)
    low, high = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    possible = (match >= join.least_match) & (100 * low >= join.percent * high)
    a, b = np.nonzero(np.triu(possible, 1))
    order = np.argsort(-match[a, b], kind="stable")
    return a[order], b[order], match[a, b][order]


def promising(rows: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (leaf, cls) of the classes that a small node must compare on full sets.

    ``rows`` are (leaf, cls, n_shingles, sketch, grps, grp, known). Small nodes are compared
    exhaustively by sizes and sketches, but for pairs of the same known component. A pair that
    several nodes hold is left to the least of them, so most documents are fetched once.
    """
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "leaf").sortWithinPartitions("leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 1):
            cls = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = batch.column(2).to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, join.tokens)
            lists = padded_lists(batch.column(4))
            leaf, grp, known = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 5, 6))
            out_leaf, out_cls = [], []
            for start, stop in bounds:
                if stop - start < 2:
                    continue
                a, b, _ = candidate_pairs(sketch[start:stop], sizes[start:stop], join)
                apart = known[a + start] != known[b + start]
                a, b = a[apart] + start, b[apart] + start
                if not len(a):
                    continue
                here, own = grp[start], np.zeros(len(a), bool)
                for at in range(0, len(a), 1 << 14):
                    x, y = lists[a[at : at + (1 << 14)]], lists[b[at : at + (1 << 14)]]
                    shared = np.full(len(x), np.iinfo(np.int64).max)
                    for column in range(x.shape[1]):
                        mine = x[:, column]
                        both = (y == mine[:, None]).any(1) & (mine != 0)
                        shared = np.where(both, np.minimum(shared, mine), shared)
                    own[at : at + (1 << 14)] = shared == here
                needed = np.unique(np.concatenate([a[own], b[own]]))
                out_leaf.extend([leaf[start]] * len(needed))
                out_cls.extend(cls[needed].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_leaf, pa.int64()), pa.array(out_cls, pa.int64())], names=["leaf", "cls"]
            )

    return dealt.mapInArrow(run, "leaf bigint, cls bigint")


def confirmed(rows: DataFrame, join: PathJoin) -> DataFrame:
    """Edges (a, b) of classes linked on their full shingle sets; ``rows`` hold the texts.

    In each node pairs are taken the most similar first and skipped when their documents are
    joined already, so a node yields a forest and never all of its pairs.
    """
    dealt = rows.repartition(shuffle_width(rows.sparkSession), "leaf").sortWithinPartitions("leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 1):
            rep, texts = batch.column(1), batch.column(5)
            want = list(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))))
            left, right = [], []
            for start, stop in bounds:
                sets = list(shingle_sets(texts.slice(start, stop - start).to_pylist(), join.width))
                # a doc_id may stand for several texts: only the class's own counts
                fits = [i for i, s in enumerate(sets) if (len(s), *fingerprint(s)) == want[start + i]]
                sets = [sets[i] for i in fits]
                if len(sets) < 2:
                    continue
                ids = [rep[start + i].as_py() for i in fits]
                sizes = np.array([len(s) for s in sets])
                sketch = min_hashes(sets, join.tokens).astype(np.uint8)
                tree = list(range(len(sets)))

                def root(i: int, tree=tree) -> int:
                    while tree[i] != i:
                        tree[i] = tree[tree[i]]
                        i = tree[i]
                    return i

                a, b, _ = candidate_pairs(sketch, sizes, join)
                for i, j in zip(a.tolist(), b.tolist()):
                    p, q = root(i), root(j)
                    if p != q:
                        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        united = len(sets[i]) + len(sets[j]) - shared
                        if 100 * shared >= join.percent * united:
                            tree[q] = p
                            left.append(ids[i])
                            right.append(ids[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    return dealt.mapInArrow(run, "a bigint, b bigint")


def linked(spots: DataFrame, classes: DataFrame, texts: DataFrame, join: PathJoin) -> DataFrame:
    """Edges (a, b) between classes that meet in a leaf of ``spots`` (cls, leaf, grp).

    Each pair is left to the least ``grp`` it shares. Two classes in different parts of a
    large node share its grp without meeting there; ``stray_parts`` sees to them.
    """
    spots = cut_lineage(spots, "path-leaves")
    lists = spots.groupBy("cls").agg(F.collect_set(F.struct("leaf", "grp")).alias("spots"))
    met = lists.join(classes.select("cls", "n_shingles", "sketch", "known").hint("merge"), "cls").select(
        F.explode("spots").alias("spot"), "cls", "n_shingles", "sketch", F.array_distinct("spots.grp").alias("grps"), "known"
    )
    met = met.select("spot.leaf", "cls", "n_shingles", "sketch", "grps", "spot.grp", "known")
    needed = cut_lineage(promising(met, join), "path-needed")
    kind = ["n_shingles", "fp1", "fp2"]
    named = needed.join(classes.select("cls", "rep", *kind).hint("merge"), "cls")
    fetched = named.join(texts.hint("merge"), "rep").select("leaf", "rep", *kind, "text")
    return cut_lineage(confirmed(fetched, join), "path-edges")


def joined_classes(classes: DataFrame, texts: DataFrame, join: PathJoin) -> DataFrame:
    """Rows (id, component) of the representatives that are linked with another.

    All classes enter the first trees. Nodes that stay large are linked before their documents
    go further down, so what is alike is one component by then and its nodes are finished. Classes
    that went too deep for so few trees enter more, until none needs another.
    """
    nothing = classes.sparkSession.createDataFrame([], "id bigint, component bigint")
    joined, named = nothing, classes.withColumn("known", F.col("cls"))

    def link(spots: DataFrame) -> None:
        nonlocal joined, named
        edges = linked(spots, named, texts, join)
        if edges.isEmpty():
            return
        before = joined.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        joined = cut_lineage(components(edges.unionByName(before)), "path-joined")
        known = classes.join(joined, F.col("rep") == F.col("id"), "left")
        known = cut_lineage(known.select("cls", F.coalesce("component", "rep").alias("known")), "path-known")
        named = classes.join(known.hint("merge"), "cls")

    wanted = F.array(*[F.lit(trees_for(join, steps)) for steps in range(1, join.depth + 2)])
    signed = classes.select("cls", "sig")
    entering = named.select("*", F.lit(1).alias("first"), F.lit(trees_for(join, 1)).alias("last"))
    while True:
        slim, level, deep = at_roots(entering, join), 0, []
        while slim is not None:
            spots, large, went, level = small_nodes(slim, signed, level, join)
            deep += went
            slim = None
            if large is None:
                link(spots)
                continue
            link(spots.unionByName(led_parts(large, join)))
            rows = with_core(large, named.select("cls", "known"))
            done = F.lit(level == join.depth) | (F.col("stray") <= join.leaf)
            strays = rows.where(done)
            if not strays.isEmpty():
                link(stray_parts(strays, join))
            on = rows.where(~done)
            if not on.isEmpty():
                deep.append(went_on(on, level))
                slim, level = one_down(on, signed, join), level + 1
        if not deep:
            return joined
        steps = reduce(DataFrame.unionByName, deep).groupBy("cls").agg(F.max("steps").alias("steps"))
        more = (
            entering.select("cls", "last")
            .join(steps, "cls")
            .select("cls", (F.col("last") + 1).alias("first"), F.element_at(wanted, F.col("steps")).alias("last"))
            .where("first <= last")
        )
        more = cut_lineage(more, "path-more")
        if more.isEmpty():
            return joined
        entering = cut_lineage(named.join(more.hint("merge"), "cls"), "path-entering")


def near_duplicates(docs: DataFrame, join: PathJoin = STAGE_JOIN) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Documents with equal shingle sets form a class, of which one document takes part in the
    join; so copies never meet. component_id is the smallest doc_id reachable over links of
    the given similarity, all confirmed on full sets; kept tells the document that has it.

    A null or empty text, or one without a word, has no shingles and links with nothing.
    Rows without doc_id link with nothing, have no component and are kept. Rows that share
    doc_id and text are one document; those that share only doc_id are judged by their own
    text. Other columns are ignored.
    """
    described = cut_lineage(describe(docs, join), "path-sets")
    usable = described.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    kind = ["n_shingles", "fp1", "fp2"]
    classes = cut_lineage(
        usable.groupBy(*kind)
        .agg(F.min(F.struct("doc_id", "sig", "sketch")).alias("first"), F.count("*").alias("copies"))
        .select(F.xxhash64(*kind).alias("cls"), *kind, "copies", F.col("first.doc_id").alias("rep"), "first.sig", "first.sketch"),
        "path-classes",
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("text"))
    joined = joined_classes(classes, texts, join)
    names = cut_lineage(
        classes.select(*kind, "rep", "copies")
        .join(joined, F.col("rep") == F.col("id"), "left")
        .where((F.col("copies") > 1) | F.col("component").isNotNull())
        .select(*kind, F.coalesce("component", "rep").alias("component")),
        "path-components",
    )
    found = described.select("doc_id", *kind).join(names.hint("merge"), kind, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, join: PathJoin = STAGE_JOIN) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of near copies.

    Rows are told apart by a number of their own, so neither a shared nor a null doc_id keeps a
    copy or drops a text that has none. Of a group the smallest doc_id stays, null after all
    others. Texts without a word are no copies; all of them stay.
    """
    row, = fresh(docs, "row")
    rows = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()), "path-rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), join)
    # the first row of a component is kept there; the others tell which components have copies
    found = cut_lineage(found.select("doc_id", F.col("component_id").alias("of"), "kept"), "path-found")
    several = found.where("not kept").select(F.col("of").alias("name")).distinct()
    groups = found.join(several.hint("merge"), F.col("of") == F.col("name")).select("of", F.col("doc_id").alias("at"))
    ids = rows.select(F.col(row).alias("number"), F.col("doc_id").cast("long").alias("own"))
    groups = cut_lineage(groups.join(ids, F.col("at") == F.col("number")).select("of", "own", "at"), "path-groups")
    first = groups.groupBy(F.col("of").alias("name")).agg(F.min(F.struct(F.col("own").isNull(), "own", "at"))["at"].alias("stays"))
    copies = groups.join(first, F.col("of") == F.col("name")).where("at <> stays").select(F.col("at").alias(row))
    copies = cut_lineage(copies, "path-copies")
    return rows.join(copies.hint("merge"), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
