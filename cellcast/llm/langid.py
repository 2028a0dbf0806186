"""Language identification by a convolutional network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bytes of a window; a text is cut into windows that cover it whole.
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Shorter spans are learned from only where a label has no longer one.
LEAST_BYTES = 8
#: Windows scored at once: they stay in the processor's cache.
BLOCK = 32


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes as rows of WINDOW, zero-filled, and the bytes in each row."""
    count = -(-len(text) // WINDOW)
    padded = np.zeros(count * WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    sizes = np.full(count, WINDOW)
    if count:
        sizes[-1] = len(text) - (count - 1) * WINDOW
    return padded.reshape(count, WINDOW), sizes


class ByteNet:
    """Byte embedding, filters of several widths, max over positions, softmax.

    A filter of width w adds w table rows, one for each byte below it; tables of byte pairs
    halve the look-ups. Zero bytes fill the last window and embed to zero.
    """

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.labels = labels
        self.embedding = draw(256, EMBEDDING, scale=0.5)
        self.embedding[0] = 0
        self.filters = [draw(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS]
        self.out = draw(FILTERS * len(WIDTHS), len(labels), scale=0.1)
        self.bias = np.zeros(len(labels), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, self.out, self.bias]

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter, and where it stands."""
        embedded = self.embedding[x]
        tops, places = [], []
        for width, weight in zip(WIDTHS, self.filters):
            span = x.shape[1] - width + 1
            response = sum(embedded[:, j : j + span] @ weight[j] for j in range(width))
            place = response.argmax(1)
            tops.append(np.take_along_axis(response, place[:, None], 1)[:, 0])
            places.append(place)
        return np.concatenate(tops, 1), places

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 4e-3) -> None:
        """Adam on cross entropy; a filter's gradient goes to the bytes under its maximum."""
        rng = np.random.default_rng(11)
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                rows = order[at : at + batch]
                bx, n = x[rows], len(rows)
                top, places = self._pool(bx)
                active = np.maximum(top, 0)
                p = _softmax(active @ self.out + self.bias)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                grads_out, grads_bias = active.T @ p, p.sum(0)
                back = (p @ self.out.T) * (top > 0)
                grad_embedding = np.zeros_like(self.embedding)
                grads_filters = []
                for k, (width, weight) in enumerate(zip(WIDTHS, self.filters)):
                    g = back[:, k * FILTERS : (k + 1) * FILTERS]
                    grad = np.zeros_like(weight)
                    for j in range(width):
                        below = bx[np.arange(n)[:, None], places[k] + j]
                        grad[j] = np.einsum("nf,nfe->ef", g, self.embedding[below])
                        np.add.at(grad_embedding, below, g[:, :, None] * weight[j].T[None])
                    grads_filters.append(grad)
                grad_embedding[0] = 0
                step += 1
                grads = [grad_embedding, *grads_filters, grads_out, grads_bias]
                for param, grad, m, v in zip(self.parameters(), grads, first, second):
                    m += 0.1 * (grad - m)
                    v += 0.001 * (grad * grad - v)
                    scale = np.sqrt(v / (1 - 0.999**step)) + 1e-8
                    param -= (rate / (1 - 0.9**step)) * m / scale

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the look-up tables, of byte pairs and, for an odd width, of bytes."""
        made = []
        for width, weight in zip(WIDTHS, self.filters):
            single = [self.embedding @ weight[j] for j in range(width)]
            pairs = [
                (single[j][:, None, :] + single[j + 1][None, :, :]).reshape(65536, FILTERS)
                for j in range(0, width - 1, 2)
            ]
            made.append(pairs + single[width - width % 2 :])
        return made

    def scorer(self):
        """A function from windows to log-probabilities of the labels."""
        tables, out, bias = self.tables(), self.out, self.bias

        def score(x: np.ndarray) -> np.ndarray:
            singles = np.ascontiguousarray(x.T).astype(np.intp)  # position by window
            pairs = singles[:-1] * 256 + singles[1:]
            tops = []
            for width, own in zip(WIDTHS, tables):
                span = x.shape[1] - width + 1
                response = None
                for k, table in enumerate(own):
                    index = (pairs if len(table) == 65536 else singles)[2 * k : 2 * k + span]
                    found = table.take(index.ravel(), axis=0, mode="clip").reshape(span, -1)
                    response = found if response is None else np.add(response, found, out=response)
                tops.append(response.max(0).reshape(len(x), FILTERS))
            active = np.maximum(np.concatenate(tops, 1), 0)
            return np.log(_softmax(active @ out + bias) + 1e-9)

        return score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_rows(
    docs: DataFrame, label: str, usable: Column, per_label: int, in_all: int, seed: int = 3
) -> list[tuple[str, str]]:
    """(label, span) of about ``per_label`` texts of every label, three spans of each text.

    Labels are counted over all rows; then rows are drawn by a hash at each label's rate.
    With more labels than ``in_all`` texts allow, each has fewer texts, but 20 if it has as
    many; a label of which none is drawn has its first text by the hash. So the driver holds
    about 3 * in_all short texts, or 60 a label.
    """
    known = docs.where(usable & F.col(label).isNotNull())
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    length = F.length("text")
    spans = [
        F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(seed + k)), F.greatest(length - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW))
        for k in (1, 2, 3)
    ]
    known = known.select(F.col(label).alias("label"), draw.alias("draw"), F.array(*spans).alias("spans"))
    short = F.octet_length(F.col("spans")[0]) < LEAST_BYTES
    counts = cut_lineage(
        known.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct(short.alias("short"), "draw", "spans")).alias("first")),
        "label-counts",
    )
    firsts = {row["label"]: row["spans"] for row in counts.select("label", "first.spans").collect()}
    if not firsts:
        return []
    share = min(per_label, max(20, in_all // len(firsts)))
    rates = counts.select(F.col("label").alias("named"), (F.lit(share) / F.col("n")).alias("rate"))
    drawn = known.join(rates, (F.col("label") == F.col("named")) & (F.col("draw") < F.col("rate")))
    rows = drawn.select("label", F.explode("spans").alias("span")).limit(3 * share * len(firsts) + 3000).collect()
    found = [(row["label"], row["span"]) for row in rows]
    long = {name for name, span in found if len(span.encode()) >= LEAST_BYTES}
    return found + [(name, span) for name, spans in firsts.items() if name not in long for span in spans]


def fit_language_model(docs: DataFrame, usable: Column, label: str = "lang", per_label: int = 600, in_all: int = 38_400) -> ByteNet | None:
    """A network trained on a bounded, hash-drawn sample of the usable labelled texts."""
    lettered = usable & F.col("text").rlike(r"\p{L}")
    rows = [(lab, span.encode()) for lab, span in training_rows(docs, label, lettered, per_label, in_all)]
    long = {lab for lab, span in rows if len(span) >= LEAST_BYTES}
    # short spans teach little, but are all that some labels have
    rows = sorted((lab, span) for lab, span in rows if span and (len(span) >= LEAST_BYTES or lab not in long))
    if not rows:
        return None
    labels = sorted({lab for lab, _ in rows})
    place = {lab: i for i, lab in enumerate(labels)}
    net = ByteNet(labels)
    if len(labels) > 1:
        x = np.zeros((len(rows), WINDOW), np.uint8)
        for i, (_, span) in enumerate(rows):
            span = span[:WINDOW]
            x[i, : len(span)] = np.frombuffer(span, np.uint8)
        net.train(x, np.array([place[lab] for lab, _ in rows]))
    return net


def predict_languages(docs: DataFrame, net: ByteNet | None, key: str = "doc_id") -> DataFrame:
    """Rows (key, lang_pred, score) for every document, from every byte of its text.

    The log-probabilities of a text's windows are averaged by their bytes; score is the
    winner's share. A null text or one without a letter, and every text when there is no
    model, is ``und`` with score 0. Equal shares go to the first label by code point.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(
        F.col(key),
        F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("binary")).alias("_text"),
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = net.scorer() if net else None
        for batch in batches:
            texts = [t.as_py() if net else None for t in batch.column(1)]
            sums = np.zeros((len(texts), len(net.labels) if net else 1))
            held, sizes, owners = [], [], []

            def flush() -> None:
                if held:
                    gains = score(np.concatenate(held)) * np.concatenate(sizes)[:, None]
                    np.add.at(sums, np.concatenate(owners), gains)
                    for kept in (held, sizes, owners):
                        kept.clear()

            waiting = 0
            for i, text in enumerate(texts):
                if not text:
                    continue
                for at in range(0, len(text), BLOCK * WINDOW):
                    x, n = windows(text[at : at + BLOCK * WINDOW])
                    held.append(x)
                    sizes.append(n)
                    owners.append(np.full(len(x), i))
                    waiting += len(x)
                    if waiting >= BLOCK:
                        flush()
                        waiting = 0
            flush()
            shares = _softmax(sums / [[max(1, len(t or b""))] for t in texts]) if texts else sums
            best = shares.argmax(1)
            names = [net.labels[b] if t else "und" for b, t in zip(best, texts)]
            scores = [float(s[b]) if t else 0.0 for s, b, t in zip(shares, best, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[key, "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, f"{key} {kind}, lang_pred string, score double")
