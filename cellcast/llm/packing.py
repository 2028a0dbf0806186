"""Packing of tokenised examples into sequences under several limits at once."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, fresh

#: Words whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 800_000
#: Characters of a text that are split into words at a time.
CHUNK = 1 << 20
_SPACE = re.compile(r"[ \n\t\r]+")
_TAIL = ".,;:!?*#%&$)"
_FOLD = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def _byte_letters() -> dict[int, str]:
    """The character that byte-level tokenizers write for each byte: itself if printable."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


class WordTokenizer:
    """Ids of texts by a tokenizer whose words never reach across white space.

    Ids are remembered by word as little-endian 32-bit bytes. A word with signs at its end
    is the ids of the word and of the signs, as the tokenizer always parts letters and
    digits from signs. Words of Latin letters go to the tokenizer's merges directly, in the
    form its normaliser and byte mapping give them; all others go through the whole of it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, word: str) -> bytes:
        found = self.known.get(word)
        if found is None:
            if word.isalpha() and max(word) < "\u0100":
                plain = word.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
                ids = [token.id for token in self.model.tokenize(plain)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            found = self.known[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def _learn(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        # only after a plain Latin letter or a digit: others may fold to a sign
        if core and core[-1].isalnum() and core[-1] < "\u0100" and (core is not word or not core.islower()):
            plain = core.translate(_FOLD) if core.isalnum() else core
            found = self._ids(plain) + self._ids(word[len(core) :])
            self.known[word] = found
            return found
        return self._ids(word)

    def encode(self, text: str) -> bytes:
        out = []
        for at, end in _chunks(text):
            words = _SPACE.split(text[at:end])
            found = list(map(self.known.get, words))
            if None in found:
                if len(self.known) > REMEMBERED:
                    self.known = {"": b""}
                found = [self._learn(w) if ids is None else ids for w, ids in zip(words, found)]
            out.append(b"".join(found))
        return b"".join(out)


def _chunks(text: str) -> Iterator[tuple[int, int]]:
    """Spans of about CHUNK characters that end at white space."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            gap = _SPACE.search(text, at + CHUNK)
            end = gap.start() if gap else end
        yield at, end
        at = max(end, at + 1)


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold: tokens, segments, and tokens that bear loss."""

    tokens: int
    segments: int
    loss: int


@dataclass
class Piece:
    """``length`` tokens from ``start`` of example ``source``, ``loss`` of them bearing loss."""

    source: int
    start: int
    length: int
    loss: int


@dataclass
class Bin:
    limits: Limits
    pieces: list[Piece] = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def room(self) -> tuple[int, int, int]:
        return (
            self.limits.tokens - self.tokens,
            self.limits.segments - len(self.pieces),
            self.limits.loss - self.loss,
        )

    def add(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.tokens += piece.length
        self.loss += piece.loss


class DotProductPacker:
    """Fills one sequence after another by the dot-product rule of vector bin packing.

    Of the waiting pieces that fit, the one whose demand, each part relative to its limit,
    has the largest dot product with the room left is placed next. With ``cut`` a piece that
    doesn't fit is cut to fill the sequence, and its rest waits; without, a sequence is closed
    when nothing fits, and an example above a limit raises ValueError.

    At most ``pool`` pieces wait, whatever the input; waiting pieces are grouped by size
    class, so that choosing looks at one piece of each class.
    """

    CLASSES = 64

    def __init__(self, limits: Limits, cut: bool, pool: int = 4096):
        self.limits, self.cut, self.pool = limits, cut, pool
        self.waiting: dict[tuple[int, int], list[Piece]] = {}
        self.count = self.total = 0

    def _class(self, piece: Piece) -> tuple[int, int]:
        step = max(1, self.limits.tokens // self.CLASSES)
        share = 8 * piece.loss // max(1, piece.length)
        return -(-piece.length // step), share

    def _wait(self, piece: Piece) -> None:
        self.waiting.setdefault(self._class(piece), []).append(piece)
        self.count += 1
        self.total += piece.length

    def _take(self, key: tuple[int, int]) -> Piece:
        group = self.waiting[key]
        piece = group.pop()
        if not group:
            del self.waiting[key]
        self.count -= 1
        self.total -= piece.length
        return piece

    def offer(self, piece: Piece) -> Iterator[Bin]:
        """Takes a piece in; yields the sequences this completes."""
        limits = self.limits
        fits = piece.length <= limits.tokens and piece.loss <= limits.loss
        if not fits and not self.cut:
            raise ValueError(f"an example of {piece.length} tokens exceeds the limits of a sequence")
        while self.cut and piece.length >= limits.tokens:  # whole sequences of a long text
            head, piece = self._split(piece, self._head(piece, limits.tokens, limits.loss))
            full = Bin(limits)
            full.add(head)
            yield full
            if piece is None:
                return
        if piece.length:
            self._wait(piece)
        while self.count > self.pool:
            yield self._fill()

    def drain(self) -> Iterator[Bin]:
        """The sequences of all that still waits."""
        while self.count:
            made = self._fill()
            if not self.cut or made.tokens == self.limits.tokens:
                yield made
            else:
                yield from self._halve(made)

    def _fill(self) -> Bin:
        made, limits = Bin(self.limits), self.limits
        while self.count:
            room = made.room()
            if min(room[0], room[1]) <= 0:
                break
            best, most = None, -1.0
            for key, group in self.waiting.items():
                piece = group[-1]
                if piece.length <= room[0] and piece.loss <= room[2]:
                    gain = (
                        piece.length * room[0] / limits.tokens**2
                        + room[1] / limits.segments**2
                        + piece.loss * room[2] / limits.loss**2
                    )
                    if gain > most:
                        best, most = key, gain
            if best is not None:
                made.add(self._take(best))
            elif self.cut and (room[2] > 0 or any(g[-1].loss == 0 for g in self.waiting.values())):
                key = max(self.waiting, key=lambda k: (self.waiting[k][-1].loss == 0, k))
                piece = self._take(key)
                head, rest = self._split(piece, self._head(piece, room[0], room[2]))
                made.add(head)
                if rest is not None:
                    self._wait(rest)
            else:
                break
        if self.cut and made.tokens < limits.tokens and len(made.pieces) >= limits.segments:
            self._trim(made)
        return made

    @staticmethod
    def _head(piece: Piece, tokens: int, loss: int) -> int:
        """Tokens of the longest head that fits; loss stands at the end of an example."""
        plain = piece.length - piece.loss
        return max(1, min(piece.length, tokens, plain + loss))

    @staticmethod
    def _split(piece: Piece, length: int) -> tuple[Piece, Piece | None]:
        if length >= piece.length:
            return piece, None
        plain = piece.length - piece.loss
        head = Piece(piece.source, piece.start, length, max(0, length - plain))
        rest = Piece(piece.source, piece.start + length, piece.length - length, piece.loss - head.loss)
        return head, rest

    def _trim(self, made: Bin) -> None:
        """Cuts a sequence back to a power of two, which needs no padding; the rest waits."""
        keep, made.tokens, made.loss = 1 << (made.tokens.bit_length() - 1), 0, 0
        pieces, made.pieces = made.pieces, []
        for piece in pieces:
            if made.tokens == keep:
                self._wait(piece)
            else:
                head, rest = self._split(piece, min(piece.length, keep - made.tokens))
                made.add(head)
                if rest is not None:
                    self._wait(rest)

    def _halve(self, made: Bin) -> Iterator[Bin]:
        """The last, partly filled sequence as sequences of falling powers of two."""
        pieces, left = made.pieces[::-1], made.tokens
        while left:
            part = Bin(self.limits)
            size = 1 << (left.bit_length() - 1)
            while part.tokens < size:
                head, rest = self._split(pieces.pop(), size - part.tokens)
                part.add(head)
                if rest is not None:
                    pieces.append(rest)
            left -= size
            yield part


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    limits: Limits = Limits(2048, 256, 2048),
    end_id: int = 1,
) -> DataFrame:
    """Packs every text whole, cut where that fills a sequence; one row for each piece.

    A text's ids are the tokenizer's and ``end_id``; all of them bear loss. Columns: doc_id,
    start, length, ids_crc32 (of the ids as little-endian 32-bit), doc_tokens, sequence_id and
    offset. Each task packs what it reads and keeps a bounded pool of pieces, so nothing is
    shuffled; the few last pieces of a task form sequences whose lengths are powers of two.
    sequence_id holds the task's partition above 40 bits.

    A null or empty text is one piece, the end id. Rows that share a doc_id are packed each
    for itself. Sequences of less than limits.tokens have a power of two of tokens.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    end = np.array([end_id], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _tokenizer(tokenizer), DotProductPacker(limits, cut=True)
        sequence = TaskContext.get().partitionId() << 40
        # doc_id, all tokens, ids from the first that isn't placed, and how many there are
        held: dict[int, list] = {}
        out: list[tuple] = []
        number = 0

        def place(made: Bin) -> None:
            nonlocal sequence
            at = 0
            for piece in made.pieces:
                doc_id, count, ids, left = held.pop(piece.source)
                size = 4 * piece.length  # the pieces of a text are placed in its order
                out.append((doc_id, piece.start, piece.length, zlib.crc32(ids[:size]), count, sequence, at))
                at += piece.length
                if left > piece.length:
                    held[piece.source] = [doc_id, count, ids[size:], left - piece.length]
            sequence += 1

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = memoryview(words.encode(text.as_py() or "") + end)
                count = len(ids) // 4
                held[number] = [doc_id.as_py(), count, ids, count]
                for made in packer.offer(Piece(number, 0, count, count)):
                    place(made)
                if number in held:  # what waits is kept without what is placed
                    held[number][2] = memoryview(bytes(held[number][2]))
                number += 1
            yield _batch(out, batch.schema.field(0).type)
            out.clear()
        for made in packer.drain():
            place(made)
        if out:
            yield _batch(out, batch.schema.field(0).type)

    def _batch(rows_out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows_out)) or [()] * len(names)
        types = [id_type, *[pa.int64()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return rows.mapInArrow(pack, ", ".join([f"doc_id {kind}", *[f"{n} bigint" for n in names[1:]]]))


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer, kept from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def pack_examples(examples: DataFrame, limits: Limits, key: str = "doc_id") -> DataFrame:
    """Packs whole instruction examples (key, tokens, loss_tokens) without cutting any.

    Returns key, sequence_id, offset and reason, one row for each example. Those that are in no
    sequence have null for both and a reason: ``empty`` for a null or non-positive token count,
    ``tokens`` or ``loss_tokens`` for an example above that limit by itself. Else reason is null.
    Loss tokens are at most an example's tokens; null and negative ones are none.
    """
    rows = examples.select(key, "tokens", "loss_tokens")
    kind = rows.schema[key].dataType.simpleString()

    def unfit(tokens: int, loss: int) -> str | None:
        if tokens <= 0:
            return "empty"
        if tokens > limits.tokens:
            return "tokens"
        return "loss_tokens" if loss > limits.loss else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, names, number = DotProductPacker(limits, cut=False), {}, 0
        sequence = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def place(made: Bin) -> None:
            nonlocal sequence
            at = 0
            for piece in made.pieces:
                out.append((names.pop(piece.source), sequence, at, None))
                at += piece.length
            sequence += 1

        kind_of = None
        for batch in batches:
            kind_of = batch.schema.field(0).type
            for name, tokens, loss in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tokens or 0
                loss = min(max(loss or 0, 0), tokens)
                reason = unfit(tokens, loss)
                if reason:
                    out.append((name, None, None, reason))
                    continue
                names[number] = name
                for made in packer.offer(Piece(number, 0, tokens, loss)):
                    place(made)
                number += 1
            yield batch_of(out, kind_of)
            out.clear()
        for made in packer.drain():
            place(made)
        if out:
            yield batch_of(out, kind_of)

    def batch_of(rows_out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows_out)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [id_type, pa.int64(), pa.int64(), pa.string()])],
            names=[key, "sequence_id", "offset", "reason"],
        )

    return rows.mapInArrow(pack, f"{key} {kind}, sequence_id bigint, offset bigint, reason string")


def count_tokens_of(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Input columns and ``tokens``, the ids of the text by the tokenizer (null text: 0)."""
    kept = [c for c in docs.columns if c.lower() != "tokens"]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(fresh(docs, "text")[0]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _tokenizer(tokenizer)
        for batch in batches:
            sizes = [len(words.encode(t.as_py() or "")) // 4 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*batch.schema.names[:-1], "tokens"]
            )

    return rows.mapInArrow(count, ", ".join([*fields, "tokens bigint"]))
