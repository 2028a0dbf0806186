"""Periodic runs of words within texts, by maximal pairs of a bottom-up tree of common prefixes."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix import doubled_suffix_array, permuted_prefixes

#: Bytes of text whose suffixes are sorted together; one longer text is sorted alone.
TOGETHER = 2 << 20


@dataclass(frozen=True)
class RunRule:
    """A run repeats its first words ``times`` times at least and has ``least`` words or more."""

    times: int = 4
    least: int = 6

    @property
    def shortest_prefix(self) -> int:
        """The least common prefix of a run and itself one period on."""
        return min(max(self.least - p, (self.times - 1) * p) for p in range(1, self.least + 1))


def maximal_pairs(places: list[int], prefixes: list[int], left: np.ndarray, times: int) -> Iterator[tuple[int, int, int]]:
    """(first, second, common prefix) of maximal pairs that may be runs, of one prefix interval.

    ``places`` are suffixes in order, ``prefixes`` those they share with the one before. An
    interval's children are merged bottom-up, the smaller list into the larger. The class
    lists of an interval, one for each word that stands left, are kept as one list in order of
    place: places closer than a third of the prefix are steps of one period, so only the nearest
    on either side can be a run's other end, and it is one if its left word is of another class.
    """

    def merged(a: list[int], b: list[int], prefix: int) -> list[int]:
        few, many = (a, b) if len(a) < len(b) else (b, a)
        reach = prefix // (times - 1)
        for x in few:
            k = bisect_right(many, x)
            if k < len(many) and many[k] - x <= reach and left[many[k]] != left[x]:
                found.append((x, many[k], prefix))
            if k and x - many[k - 1] <= reach and left[many[k - 1]] != left[x]:
                found.append((many[k - 1], x, prefix))
        if len(few) < 4:
            for x in few:
                insort(many, x)
        else:
            many += few
            many.sort()
        return many

    found: list[tuple[int, int, int]] = []
    open_: list[tuple[int, list[int]]] = []
    node = [places[0]]
    for place, prefix in zip(places[1:], prefixes[1:]):
        while open_ and open_[-1][0] >= prefix:
            above, held = open_.pop()
            node = merged(held, node, above)
        open_.append((prefix, node))
        node = [place]
    while open_:
        above, held = open_.pop()
        node = merged(held, node, above)
    return iter(found)


def runs_of(words: np.ndarray, rule: RunRule) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs in a string of word numbers.

    A maximal pair is a word sequence at two places that agrees with neither's neighbours, so
    one whose places are close is the whole of a run: nothing is left to extend. Multiples of a
    period give the same start and end; the least is the run's.
    """
    if len(words) < rule.least:
        return
    sa = doubled_suffix_array(words)
    prefixes = permuted_prefixes(words, sa)[sa]
    left = np.append(-1, words[:-1])
    deep = np.flatnonzero(prefixes >= rule.shortest_prefix)
    if not len(deep):
        return
    breaks = np.flatnonzero(np.diff(deep) > 1)
    periods: dict[tuple[int, int], int] = {}
    for first, last in zip(deep[np.append(0, breaks + 1)].tolist(), deep[np.append(breaks, len(deep) - 1)].tolist()):
        places, shared = sa[first - 1 : last + 1].tolist(), prefixes[first - 1 : last + 1].tolist()
        for a, b, prefix in maximal_pairs(places, shared, left, rule.times):
            period, length = b - a, b - a + prefix
            if length >= rule.least and length >= rule.times * period:
                known = periods.get((a, length), period)
                periods[a, length] = min(known, period)
    for (start, length), period in periods.items():
        yield start, length, period


def _batches(texts: list[list[bytes]]) -> Iterator[list[int]]:
    at = 0
    while at < len(texts):
        part, held = [], 0
        while at < len(texts) and (not part or held < TOGETHER):
            part.append(at)
            held += sum(map(len, texts[at])) + len(texts[at])
            at += 1
        yield part


def text_runs(texts: list[list[bytes]], rule: RunRule) -> list[list[tuple[int, int, int]]]:
    """For each text, its words in order, the runs (start, length, period) by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for part in _batches(texts):
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        pieces = [np.fromiter(map(numbers.__getitem__, texts[i]), np.int64, len(texts[i])) for i in part]
        starts = np.cumsum([0, *[len(p) + 1 for p in pieces]])
        words = np.empty(starts[-1], np.int64)
        for k, piece in enumerate(pieces):
            words[starts[k] : starts[k + 1] - 1] = piece
            words[starts[k + 1] - 1] = len(numbers) + k  # ends a text and occurs once
        for start, length, period in runs_of(words, rule):
            k = int(np.searchsorted(starts, start, side="right")) - 1
            out[part[k]].append((start - int(starts[k]), length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by spaces, without those that a run holds after its first period."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    dropped = np.cumsum(depth[:-1]) > 0
    return b" ".join([words[i] for i in np.flatnonzero(~dropped).tolist()])


def periodic_runs(
    docs: DataFrame,
    rule: RunRule = RunRule(),
    change: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Rows (doc_id, runs, collapsed), one for each row of ``docs``.

    ``runs`` are structs (start, length, period), by start, then period, of a text's words
    (what stands between ASCII white space); each is as long as its period goes on, ``collapsed``
    is the text without what repeats. ``change`` gives other words in place of a row's own.

    Null and empty texts have no words, so no runs and an empty collapsed text. Rows are judged
    one by one: repeated rows and ids come back as often, and a null id stays null. A text is
    handled whole, however long, in memory of some dozen times its size. Other columns are
    ignored, and an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [(t or b"").split() for t in batch.column(1).to_pylist()]
            if change is not None:
                texts = [change(i, words) for i, words in zip(ids, texts)]
            found = text_runs(texts, rule)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in own] for own in found]
            short = [collapse(words, own) for words, own in zip(texts, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, kind), pa.array(short, pa.binary())], names=["doc_id", "runs", "collapsed"]
            )

    schema = "doc_id bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed binary"
    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def run_digests(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as counts, the longest run and digests of all runs and the collapsed text."""
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("longest", longest)
    length, start, period = F.col("longest.l"), -F.col("longest.s"), -F.col("longest.p")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
