"""Exact removal of long byte strings that occur twice, by sparse suffix arrays of shards."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_width
from .grouped import whole_groups
from .shingles import mixed
from .suffix import sparse_suffix_array

_BYTE = np.random.default_rng(53).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes hashed together, few enough for a core's cache; longer texts are cut into overlapping
#: pieces. Places fit in 24 bits.
_TOGETHER = 1 << 16
_PLACES = np.uint64((1 << 24) - 1)
#: Places of strings around their anchors that are compared together.
_COLUMNS = 32


@dataclass(frozen=True)
class Repeats:
    """Strings of ``length`` bytes that start at two places are removed from all of them.

    Strings meet by their anchor, the gram of ``gram`` bytes in it with the least hash. A shard
    holds about ``shard`` bytes, whole anchors' segments each. Segments of an anchor that has more
    than ``crowd`` bytes of different ones meet anew by an anchor of half as much less than the
    whole, the last being the string itself.
    """

    length: int = 400
    gram: int = 64
    shard: int = 1 << 20
    crowd: int = 1 << 22

    def wider(self, gram: int) -> int:
        return (gram + self.length + 1) // 2


@cache
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(count, _BASE, np.uint64)
    steps[0] = 1
    back = np.full(count, pow(_BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    return np.cumprod(steps, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` bytes in a row."""
    up, down = (p[: len(data)] for p in _powers(1 << len(data).bit_length()))
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * up, dtype=np.uint64))
    return mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys in a row."""
    least, span = keys, 1
    while 2 * span <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(texts: list[bytes], length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text number, first string's place, strings, anchor's hash) of segments, some texts at a time.

    A segment is all strings in a row whose anchor is the same gram. Equal strings have equal
    anchors, at the same place within them: the leftmost of the grams with the least hash.
    """
    pieces: list[tuple[int, int, int]] = []
    for i, text in enumerate(texts):
        step = _TOGETHER - length + 1
        pieces += [(i, at, min(at + _TOGETHER, len(text))) for at in range(0, max(0, len(text) - length + 1), step)]
    k = 0
    while k < len(pieces):
        part, held = [], 0
        while k < len(pieces) and (not part or held + pieces[k][2] - pieces[k][1] <= _TOGETHER):
            part.append(pieces[k])
            held += part[-1][2] - part[-1][1]
            k += 1
        data = np.frombuffer(b"".join([texts[i][a:b] for i, a, b in part]), np.uint8)
        hashes = gram_hashes(data, gram)
        keys = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_window_least(keys, length - gram + 1) & _PLACES).astype(np.int64)
        starts = np.cumsum([0, *[b - a for _, a, b in part]])
        # strings that lie in one piece, with their piece
        sizes = np.diff(starts) - length + 1
        piece = np.repeat(np.arange(len(part)), sizes)
        place = np.arange(len(piece)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[piece]
        own = anchor[place]
        new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (piece[1:] != piece[:-1])))
        count = np.diff(new, append=len(own))
        of = piece[new]
        number, base = (np.array([p[j] for p in part])[of] for j in (0, 1))
        yield number, place[new] - starts[of] + base, count, hashes[own[new]].view(np.int64)


def _print_of(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def anchored(texts: DataFrame, rule: Repeats) -> DataFrame:
    """Rows (v, key, at, n, fp, mark) of the segments of ``texts`` (key, text).

    v is the anchor's hash, n the number of strings in the segment, fp a fingerprint of its bytes
    and mark the first eight bytes of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, whole = batch.column(0), batch.column(1).to_pylist()
            for number, at, n, v in segments(whole, rule.length, rule.gram):
                ends = (at + n + rule.length - 1).tolist()
                prints = [_print_of(whole[i][a:b]) for i, a, b in zip(number.tolist(), at.tolist(), ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(v),
                        keys.take(pa.array(number)),
                        pa.array(at),
                        pa.array(n, pa.int64()),
                        pa.array(prints, pa.binary()),
                        pa.array(np.frombuffer(b"".join([p[:8] for p in prints]), np.int64)),
                    ],
                    names=["v", "key", "at", "n", "fp", "mark"],
                )

    return texts.mapInArrow(run, "v bigint, key binary, at bigint, n bigint, fp binary, mark bigint")


def live_segments(found: DataFrame) -> DataFrame:
    """The rows of ``found`` whose anchor occurs again, with ``mixed``: whether in other bytes.

    An anchor's numbers are summed before they meet, so a gram of a third of all rows is one row
    of the sum; the join splits the rows of such a gram.
    """
    counts = found.groupBy(F.col("v").alias("of_v")).agg(
        F.count("*").alias("rows"), F.min("mark").alias("low"), F.max("mark").alias("high")
    )
    again = cut_lineage(counts.where("rows > 1").select("of_v", (F.col("low") != F.col("high")).alias("mixed")), "repeat-anchors")
    return cut_lineage(found.join(again, F.col("v") == F.col("of_v")).drop("of_v", "mark"), "repeat-segments")


def segment_bytes(live: DataFrame, texts: DataFrame, rule: Repeats) -> DataFrame:
    """Rows (v, fp, rows, data): one text of every different segment of mixed anchors.

    ``texts`` has one row for each key.
    """
    spot = F.struct("key", "at", "n")
    kinds = live.where("mixed").groupBy("v", "fp").agg(F.min(spot).alias("first"), F.count("*").alias("rows"))
    wanted = kinds.groupBy(F.col("first.key").alias("of_key")).agg(
        F.collect_list(F.struct("v", "fp", "rows", "first.at", "first.n")).alias("wanted")
    )
    wanted = cut_lineage(wanted, "repeat-wanted")
    each = texts.join(wanted.hint("merge"), F.col("key") == F.col("of_key")).select("text", F.explode("wanted").alias("w"))
    # substring() counts from 1; a binary's positions are bytes
    data = F.substring(F.col("text"), (F.col("w.at") + 1).cast("int"), (F.col("w.n") + (rule.length - 1)).cast("int"))
    return cut_lineage(each.select("w.v", "w.fp", "w.rows", data.alias("data")), "repeat-bytes")


def anchor_places(stretches: list[bytes], anchors: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where in each stretch, a segment's bytes, its anchor starts.

    That is the first gram with the hash ``anchors`` that the last string of the segment holds:
    were there one before it, that would be the first string's anchor.
    """
    sizes = np.array([len(s) for s in stretches])
    group = (np.cumsum(sizes) - sizes) // _TOGETHER
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(stretches)]
    out = np.empty(len(stretches), np.int64)
    for a, b in zip(edges[:-1], edges[1:]):
        held = sizes[a:b]
        starts = np.cumsum(held) - held
        hashes = gram_hashes(np.frombuffer(b"".join(stretches[a:b]), np.uint8), gram).view(np.int64)
        of = np.repeat(np.arange(b - a), held)[: len(hashes)]
        place = np.arange(len(hashes)) - starts[of]
        found = np.flatnonzero((hashes == anchors[a:b][of]) & (place >= held[of] - length))
        row, first = np.unique(of[found], return_index=True)
        out[a + row] = place[found[first]]
    return out


def repeated_ranges(
    stretches: list[bytes], anchors: np.ndarray, again: list[bool], length: int, gram: int
) -> list[list[tuple[int, int]]]:
    """For each stretch the ranges of places whose ``length`` bytes occur in the stretches again.

    Equal strings hold equal anchors at the same place. So only the suffixes that start at the
    stretches' anchors are sorted, and what is before the anchors, reversed. Strings are equal
    if they start equally far before their anchors and no common prefix between their ranks is
    shorter than their bytes, on either side. A string whose neighbours in either order share
    less is alone. All places of a stretch marked ``again`` repeat.
    """
    m, reach = len(stretches), length - gram
    into = anchor_places(stretches, anchors, length, gram)
    # a string is known by its column: the first starts ``reach`` bytes before the anchor
    begin = reach - into
    end = begin + np.array([len(s) for s in stretches]) - length + 1
    after = sparse_suffix_array([s[i:] for s, i in zip(stretches, into.tolist())])
    before = sparse_suffix_array([s[:i][::-1] for s, i in zip(stretches, into.tolist())])
    most = np.empty((2, m), np.int64)
    for side, (order, shared) in zip(most, (after, before)):
        side[order] = np.maximum(shared, np.append(shared[1:], 0))
    first = np.maximum(begin, reach - most[1])
    stop = np.minimum(end, most[0] - gram + 1)
    twice = np.zeros((m, reach + 2), bool)
    rank = np.arange(m)[:, None]
    for at in range(0, reach + 1, _COLUMNS):
        column = np.arange(at, min(at + _COLUMNS, reach + 1))
        row, k = np.nonzero((column >= first[:, None]) & (column < stop[:, None]))
        if not len(row):
            continue
        keys = k
        for (order, shared), depth in ((after, gram + column), (before, reach - column)):
            least = np.empty((m, len(column)), np.int64)
            least[order] = np.maximum.accumulate(np.where(shared[:, None] < depth, rank, 0), axis=0)
            keys = keys * m + least[row, k]
        by = np.argsort(keys)
        same = np.flatnonzero(keys[by[1:]] == keys[by[:-1]])
        same = np.concatenate([by[same], by[same + 1]])
        twice[row[same], at + k[same]] = True
    column = np.arange(reach + 2)
    twice |= np.array(again)[:, None] & (column >= begin[:, None]) & (column < end[:, None])
    edges = np.diff(twice.astype(np.int8), axis=1, prepend=np.int8(0))
    row, opens = np.nonzero(edges == 1)
    closes = np.nonzero(edges == -1)[1]
    out: list[list[tuple[int, int]]] = [[] for _ in stretches]
    for i, a, b in zip(row.tolist(), (opens - begin[row]).tolist(), (closes - begin[row]).tolist()):
        out[i].append((a, b))
    return out


RANGES = "v bigint, fp binary, ranges array<struct<first:bigint,stop:bigint>>"


def sharded_ranges(pieces: DataFrame, rule: Repeats, gram: int) -> DataFrame:
    """Rows (v, fp, ranges) of the segments in ``pieces`` (v, fp, rows, data), compared in shards.

    All segments of an anchor are in one shard; different anchors share a shard, as equal strings
    never have different ones.
    """
    held = pieces.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = max(1, -(-held // rule.shard))
    dealt = pieces.select(F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"), "v", "fp", "rows", "data")
    dealt = dealt.repartition(max(1, min(shards, 4 * shuffle_width(pieces.sparkSession))), "shard").sortWithinPartitions("shard")
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, 1):
            for start, stop in bounds:
                part = batch.slice(start, stop - start)
                again = [n > 1 for n in part.column(3).to_pylist()]
                ranges = repeated_ranges(part.column(4).to_pylist(), part.column(1).to_numpy(), again, rule.length, gram)
                ranges = [[{"first": a, "stop": b} for a, b in own] for own in ranges]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(ranges, kind)], names=["v", "fp", "ranges"])

    return dealt.mapInArrow(run, RANGES).where(F.size("ranges") > 0)


def recut(crowded: DataFrame, gram: int, rule: Repeats) -> DataFrame:
    """Rows (of_v, of_fp, at, v, fp, rows, data): segments cut anew by anchors of ``gram`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(3).to_pylist()
            for number, at, n, v in segments(whole, rule.length, gram):
                ends = (at + n + rule.length - 1).tolist()
                data = [whole[i][a:b] for i, a, b in zip(number.tolist(), at.tolist(), ends)]
                of = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array(at),
                        pa.array(v),
                        pa.array([_print_of(d) for d in data], pa.binary()),
                        batch.column(2).take(of),
                        pa.array(data, pa.binary()),
                    ],
                    names=["of_v", "of_fp", "at", "v", "fp", "rows", "data"],
                )

    schema = "of_v bigint, of_fp binary, at bigint, v bigint, fp binary, rows bigint, data binary"
    return crowded.select("v", "fp", "rows", "data").mapInArrow(run, schema)


def mixed_ranges(pieces: DataFrame, rule: Repeats, gram: int) -> DataFrame:
    """Rows (v, fp, ranges) of the segments in ``pieces``, those of crowded anchors cut anew.

    Equal strings stay together however segments are cut; a string that is its own anchor
    needs no comparison, so any crowd ends there.
    """
    sizes = pieces.groupBy(F.col("v").alias("of_v")).agg(F.sum(F.octet_length("data")).alias("held"))
    heavy = cut_lineage(sizes.where(F.col("held") > rule.crowd).select("of_v"), "repeat-crowds")
    if gram == rule.length or heavy.isEmpty():
        return sharded_ranges(pieces, rule, gram)
    in_crowd = F.col("v") == F.col("of_v")
    crowded = pieces.join(heavy.hint("merge"), in_crowd, "left_semi")
    rest = pieces.join(heavy.hint("merge"), in_crowd, "left_anti")
    wide = rule.wider(gram)
    finer = cut_lineage(recut(crowded, wide, rule), "repeat-recut")
    kinds = finer.groupBy("v", "fp").agg(F.sum("rows").alias("rows"), F.first("data").alias("data"))
    ranges = cut_lineage(mixed_ranges(cut_lineage(kinds, "repeat-kinds"), rule, wide), "repeat-finer")
    named = ranges.select(F.col("v").alias("r_v"), F.col("fp").alias("r_fp"), "ranges")
    back = finer.drop("data", "rows").join(named, (F.col("v") == F.col("r_v")) & (F.col("fp") == F.col("r_fp")))
    moved = F.transform("ranges", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), (r["stop"] + F.col("at")).alias("stop")))
    whole = back.groupBy("of_v", "of_fp").agg(F.flatten(F.collect_list(moved)).alias("ranges"))
    return sharded_ranges(rest, rule, gram).unionByName(whole.select(F.col("of_v").alias("v"), F.col("of_fp").alias("fp"), "ranges"))


def cut_out(text: bytes, ranges: list[tuple[int, int]], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """A text without the strings that start in ``ranges`` of places, and the removed spans."""
    spans: list[list[int]] = []
    for first, stop in sorted(ranges):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop + length - 1)
        else:
            spans.append([first, stop + length - 1])
    kept, at = [], 0
    for first, stop in spans:
        kept.append(text[at:first])
        at = stop
    return b"".join([*kept, text[at:]]), [tuple(s) for s in spans]


CUT = "key binary, kept binary, spans array<struct<first:bigint,stop:bigint>>"


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


#: Texts are told apart by the sha256 of their bytes; its first half is their key.
def _sha() -> Column:
    return F.unhex(F.sha2("text", 256))


def _key() -> Column:
    return F.substring(_sha(), 1, 16)


def repeat_cuts(docs: DataFrame, rule: Repeats) -> DataFrame:
    """Rows (key, kept, spans) of the different texts that lose bytes.

    Texts are cut into segments whose strings share an anchor. Only segments whose anchor occurs
    again go on, and of equal segments one, to shards, where the suffixes from anchors on are sorted.
    Segments that only occur in equal copies repeat as a whole.
    """
    long = _whole(docs).where(F.octet_length("text") >= rule.length).select(_key().alias("key"), "text")
    live = live_segments(cut_lineage(anchored(long, rule), "repeat-anchored"))
    one = long.groupBy("key").agg(F.first("text").alias("text"))
    pieces = segment_bytes(live, one, rule)
    part = cut_lineage(mixed_ranges(pieces, rule, rule.gram), "repeat-ranges").select(
        F.col("v").alias("r_v"), F.col("fp").alias("r_fp"), "ranges"
    )
    whole = F.struct(F.col("at").alias("first"), (F.col("at") + F.col("n")).alias("stop"))
    copies = live.where("not mixed").select("key", F.array(whole).alias("ranges"))
    moved = F.transform(
        "ranges", lambda r: F.struct((r["first"] + F.col("at")).alias("first"), (r["stop"] + F.col("at")).alias("stop"))
    )
    partly = live.where("mixed").join(part, (F.col("v") == F.col("r_v")) & (F.col("fp") == F.col("r_fp")))
    # rows of equal text have equal ranges: one set of them is enough
    ranges = copies.unionByName(partly.select("key", moved.alias("ranges"))).select("key", F.explode("ranges").alias("r"))
    ranges = ranges.distinct().groupBy(F.col("key").alias("of_key")).agg(F.collect_list("r").alias("ranges"))
    ranges = cut_lineage(ranges, "repeat-places")
    touched = one.join(ranges.hint("merge"), F.col("key") == F.col("of_key")).select("key", "text", "ranges")
    length = rule.length
    kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [
                cut_out(t, [(r["first"], r["stop"]) for r in own], length)
                for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            spans = [[{"first": a, "stop": b} for a, b in own] for _, own in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([kept for kept, _ in done], pa.binary()), pa.array(spans, kind)],
                names=["key", "kept", "spans"],
            )

    return touched.mapInArrow(run, CUT)


def remove_repeats(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """Rows (doc_id, kept, spans), one for each row of ``docs``.

    Every byte that lies in a string of ``rule.length`` bytes which also starts at another
    place, of any row, is removed; ``spans`` (first, stop) are the maximal removed runs of bytes
    and ``kept`` is what is left, both of the UTF-8 text. What is removed is judged on the
    input alone.

    A null text is empty; an empty or short text keeps all. Rows of equal text are copies
    of each other, whatever their ids, so all of their bytes go if there are enough; a null
    doc_id stays null. Texts of any length are handled whole. Other columns are ignored, and an
    empty table gives an empty one.
    """
    cuts = cut_lineage(repeat_cuts(docs, rule), "repeat-cuts").withColumnRenamed("key", "of_key")
    rows = _whole(docs).withColumn("key", _key())
    found = rows.join(cuts.hint("merge"), F.col("key") == F.col("of_key"), "left")
    none = F.expr("cast(array() as array<struct<first:bigint,stop:bigint>>)")
    return found.select("doc_id", F.coalesce("kept", "text").alias("kept"), F.coalesce("spans", none).alias("spans"))


def repeat_digests(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """``remove_repeats`` as rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256); no text is joined back."""
    cuts = repeat_cuts(docs, rule).select(
        F.col("key").alias("of_key"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda held, s: held + s["stop"] - s["first"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    cuts = cut_lineage(cuts, "repeat-cuts")
    rows = _whole(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), _sha().alias("sha"))
    rows = rows.withColumn("key", F.substring("sha", 1, 16))
    found = rows.join(cuts.hint("merge"), F.col("key") == F.col("of_key"), "left")
    none = F.lit(0).cast("long")
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256"),
    )
