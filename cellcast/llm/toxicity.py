"""Toxicity by a weighted lexicon, matched in folded text by an Aho-Corasick automaton."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, rows_where

# Look-alike letters, digits and signs, and the Latin letters they stand for.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ї": "i",
    "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "н": "h", "т": "t", "в": "b",
    "г": "r", "п": "n", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ӏ": "l",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
    "ł": "l", "ø": "o", "đ": "d",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
INVISIBLE = "­​‌‍⁠﻿"

STEM_LENGTHS = (4, 5, 6, 7)
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS | dict.fromkeys(INVISIBLE, ""))
_SIGN = re.compile(r"[@$!](?=[^\W\d_])")
_GAP = re.compile(r"[\W_]+")


def fold_text(text: str) -> str:
    """Lower-case words of the text, look-alikes folded, one space before and after each.

    A sign stands for a letter only before a letter, so that signs after a word part it.
    """
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)) if not text.isascii() else text
    text = _SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_FOLD)
    return " " + _GAP.sub(" ", text).strip() + " "


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the line that turns a score to a chance.

    A term " word " matches the word, " stem" every word that begins with it.
    """

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    line: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        machine = ahocorasick.Automaton()
        for term in self.weights:
            machine.add_word(term, (term, False))
        for phrase in self.exceptions:
            machine.add_word(phrase, (phrase, True))
        if len(machine):
            machine.make_automaton()
        return machine

    def hits(self, machine, folded: str) -> list[tuple[int, str]]:
        """Start and term of each match that lies in no exception phrase."""
        if not len(machine):
            return []
        found, spared = [], []
        for end, (term, exempt) in machine.iter(folded):
            start = end - len(term) + 1
            if exempt:
                spared.append((start, end))
            else:
                found.append((start, term))
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[0] + len(h[1]) - 1 <= b for a, b in spared)]
        return found

    def features(self, machine, folded: str) -> tuple[float, float]:
        """Matched weight, damped, and the same for 100 words; repeats of a term count less."""
        seen = Counter(t for _, t in self.hits(machine, folded))
        total = sum(self.weights[t] * (1 + math.log(n)) for t, n in seen.items())
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100.0 * total / max(20, words))

    def score(self, machine, text: str | None) -> float:
        whole, dense = self.features(machine, fold_text(text)) if text else (0.0, 0.0)
        a, b, c = self.line
        return 1.0 / (1.0 + math.exp(-(a + b * whole + c * dense)))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int, max_chars: int, seed: int = 5
) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """About ``per_class`` texts of each class, drawn by hash, and the classes' sizes.

    Texts longer than ``max_chars`` are left out of learning, so the driver holds at most
    2 * per_class * max_chars characters. Of several labels of a document the largest holds.
    """
    known = labels.where(usable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    sizes = (sizes.get(0, 0), sizes.get(1, 0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, min(1.0, per_class / max(1, sizes[1]))).otherwise(min(1.0, per_class / max(1, sizes[0])))
    picked = F.broadcast(known.where(draw < rate).limit(3 * per_class))  # a bounded sample
    texts = docs.where(F.length("text") <= max_chars).select("doc_id", "text").join(picked, "doc_id")
    rows = texts.select("text", "toxic").limit(6 * per_class).collect()
    return sorted((r["text"], r["toxic"]) for r in rows), sizes


def _terms(folded: str) -> Iterator[tuple[str, str, str]]:
    """Term and the words on either side, for whole words and stems."""
    words = folded.split()
    for i, word in enumerate(words):
        around = (words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else "")
        yield f" {word} ", *around
        for n in STEM_LENGTHS:
            if len(word) > n:
                yield f" {word[:n]}", *around


def learn_lexicon(
    sample: list[tuple[str, int]], sizes: tuple[int, int], min_contexts: int = 3, max_terms: int = 5000
) -> Lexicon:
    """Terms far commoner in toxic texts, weighed by log-odds, and a fitted line.

    A term counts once for each pair of neighbours it stands between, not for each text: the
    words of a text that was copied often weigh no more than those of one copy. A term must
    pass a likelihood-ratio test at a level that allows for the number of terms tried. A stem
    replaces words only where it covers clearly more than the commonest of them. Phrases
    around a term that clean texts hold more often than toxic ones become exceptions.
    """
    folded = [(fold_text(t), y) for t, y in sample]
    n_toxic = 1 + sum(y for _, y in folded)
    n_clean = 1 + len(folded) - sum(y for _, y in folded)
    # first by texts, then, for the terms that lean to toxic texts, by neighbours
    texts: tuple[Counter, Counter] = (Counter(), Counter())
    for text, y in folded:
        if y:
            texts[1].update({term for term, _, _ in _terms(text)})
    frequent = {t for t, n in texts[1].items() if n >= min_contexts}
    for text, y in folded:
        if not y:
            texts[0].update({term for term, _, _ in _terms(text)} & frequent)
    leaning = {t for t in frequent if texts[1][t] * n_clean > 2 * texts[0][t] * n_toxic}
    toxic_seen: dict[str, set[int]] = defaultdict(set)
    clean_seen: dict[str, set[int]] = defaultdict(set)
    for text, y in folded:
        for term, left, right in _terms(text):
            if term in leaning:
                (toxic_seen if y else clean_seen)[term].add(hash((left, right)))
    rated, level = [], 2 * math.log(max(2, len(frequent)))
    for term in leaning:
        t, c = len(toxic_seen[term]), len(clean_seen.get(term, ()))
        weight = math.log((t + 0.5) / n_toxic) - math.log((c + 0.5) / n_clean)
        ratio = _likelihood_ratio(t, c, n_toxic / (n_toxic + n_clean))
        if weight > 1.5 and ratio >= level:
            rated.append((ratio, t, term, weight))
    # the best first; of equal ones the whole word before its stems, longer stems first
    rated.sort(key=lambda r: (-r[0], -len(r[2]), r[2]))
    chosen: dict[str, float] = {}
    sizes_of: dict[str, float] = {}
    for _, t, term, weight in rated[: 4 * max_terms]:
        stem = not term.endswith(" ")
        if any(term[: n + 1] in chosen for n in STEM_LENGTHS):
            continue
        if stem:
            below = [k for k in chosen if k.startswith(term)]
            if sum(sizes_of[k] for k in below) * 1.2 >= t:
                continue
            for k in below:
                del chosen[k]
        chosen[term], sizes_of[term] = weight, t
        if len(chosen) >= max_terms:
            break
    lexicon = Lexicon(chosen)
    lexicon.exceptions = _exceptions(lexicon, folded)
    machine = lexicon.automaton()
    points = np.array([lexicon.features(machine, text) for text, _ in folded]).reshape(-1, 2)
    lexicon.line = _fit_line(points, np.array([y for _, y in folded], float), sizes)
    return lexicon


def _likelihood_ratio(t: int, c: int, share: float) -> float:
    """Twice the log-likelihood gained by letting a term's toxic share differ from all terms'."""
    n = t + c
    parts = ((t, n * share), (c, n * (1 - share)))
    return 2 * sum(k * math.log(k / expected) for k, expected in parts if k)


def _exceptions(lexicon: Lexicon, folded: list[tuple[str, int]], min_clean: int = 5) -> set[str]:
    """Two-word phrases with a term that stand in at least five clean texts and mostly there."""
    machine, counts = lexicon.automaton(), (Counter(), Counter())
    for text, y in folded:
        phrases = set()
        for start, term in lexicon.hits(machine, text):
            stop = text.find(" ", start + 1)
            word = text[start : stop + 1]
            before = text.rfind(" ", 0, start)
            after = text.find(" ", stop + 1)
            if before >= 0:
                phrases.add(text[before:start] + word)
            if after >= 0:
                phrases.add(word + text[stop + 1 : after + 1])
        counts[y].update(phrases)
    return {p for p, n in counts[0].items() if n >= min_clean and n > 4 * counts[1][p]}


def _fit_line(points: np.ndarray, y: np.ndarray, sizes: tuple[int, int], steps: int = 50) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, classes weighed as in all labelled rows."""
    if not len(y) or y.min() == y.max():
        return (-4.0, 1.5, 1.0)
    x = np.column_stack([np.ones(len(y)), points])
    each = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    each = each * len(y) / each.sum()
    line, ridge = np.zeros(3), np.diag([1e-3, 0.05, 0.05])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        grad = x.T @ (each * (p - y)) + ridge @ line
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + ridge
        move = np.linalg.solve(hess, grad)
        line = line - move * min(1.0, 3.0 / (np.abs(move).max() + 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    # more matched weight never lowers the chance
    return float(line[0]), float(max(line[1], 0.0)), float(max(line[2], 0.0))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 2500, max_chars: int = 20_000
) -> Lexicon:
    """A lexicon learned from a bounded, hash-drawn sample of the usable labelled rows."""
    sample, sizes = labelled_sample(docs, labels, usable, per_class, max_chars)
    return learn_lexicon(sample, sizes)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """Input columns and score (0 to 1) and predicted (0 or 1), from the whole text.

    Null and empty texts have the score of a text without any match. Input columns named
    like the added ones are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text").alias(fresh(docs, "text")[0]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            scores = [lexicon.score(machine, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            marks = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(marks, pa.int32())],
                names=[*batch.schema.names[:-1], "score", "predicted"],
            )

    return rows.mapInArrow(score, ", ".join([*fields, "score double", "predicted int"]))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    def judge():
        machine = lexicon.automaton()
        return lambda text: lexicon.score(machine, text) < threshold

    return rows_where(docs, "text", judge, "string")
