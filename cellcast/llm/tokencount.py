"""Token counts of a unigram tokenizer by a Viterbi pass that keeps counts, not pieces."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: What stands for the space before a word, as in the vocabulary's pieces.
MARK = "▁"
#: By how much an unknown character scores below the vocabulary's lowest piece.
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers; the memory is emptied when it is full.
REMEMBERED = 500_000


class UnigramCounter:
    """Counts the pieces of the best segmentation of a text, without making it.

    An Aho-Corasick automaton lists the pieces that end at each character, longest first.
    For each end the best score and its piece count are carried on; of equal scores the
    piece that begins first wins, a known piece before an unknown character, as the tokenizer
    visits beginnings in order and replaces a path only by a better one. An unknown character
    is as many pieces as it has bytes if the vocabulary holds all byte pieces, else unknown
    characters side by side are one piece.

    Spaces become marks, a mark is put before a text that doesn't begin with one, and texts
    are split before each mark. So counts of words add up and are remembered.
    """

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.machine = ahocorasick.Automaton()
        lowest = 0.0
        seen: dict[str, float] = {}
        for piece, score in vocabulary:
            if piece:
                seen[piece] = score  # of repeated pieces the last holds
            lowest = min(lowest, score)
        for piece, score in seen.items():
            self.machine.add_word(piece, (len(piece), score))
        if len(self.machine):
            self.machine.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in seen for b in range(256))
        self.known: dict[str, int] = {}

    def best(self, word: str) -> tuple[float, int]:
        """Score and piece count of the best segmentation of one word."""
        scores, counts = [0.0], [0]
        open_run = [False]  # whether the best path ends in an unknown character
        matches: dict[int, list[tuple[int, float]]] = {}
        if len(self.machine):
            for end, match in self.machine.iter(word):
                matches.setdefault(end, []).append(match)
        for end, char in enumerate(word):
            top, count, run, alone = None, 0, False, False
            for length, score in matches.get(end, ()):  # longest first: earliest beginning
                begin = end + 1 - length
                here = score + scores[begin]
                if top is None or here > top:
                    top, count, run = here, counts[begin] + 1, False
                alone = alone or length == 1
            if not alone:  # no piece is this very character
                here = self.unknown + scores[end]
                if top is None or here > top:
                    width = len(char.encode("utf-8", "surrogatepass")) if self.bytes_known else int(not open_run[end])
                    top, count, run = here, counts[end] + width, True
            scores.append(top)
            counts.append(count)
            open_run.append(run)
        return scores[-1], counts[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        words = text.replace(" ", MARK).split(MARK)
        for word in words if words[0] else words[1:]:
            pieces = known.get(word)
            if pieces is None:
                pieces = self.best(MARK + word)[1]
                if len(word) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = pieces
            total += pieces
        return total


def model_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


_COUNTERS: dict[str, UnigramCounter] = {}


def _counter(path: str) -> UnigramCounter:
    """The worker's counter, kept from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = UnigramCounter(model_vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Input columns and n_tokens, the unigram pieces of each whole text.

    ``model`` is the path of a sentencepiece model, whose pieces and scores are taken as a
    unigram vocabulary; it must be readable by every executor. Null and empty texts have 0
    tokens. An input column named n_tokens is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "n_tokens"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(fresh(docs, "text")[0]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model)
        for batch in batches:
            sizes = [counter.count(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"]
            )

    return rows.mapInArrow(count, ", ".join([*fields, "n_tokens bigint"]))
