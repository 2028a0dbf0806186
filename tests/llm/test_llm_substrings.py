"""Exact substring removal against a count of all strings."""

import hashlib
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from cellcast.llm import substrings
from cellcast.llm.suffix import sparse_suffix_array


def brute(texts, length):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
        spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
        out.append((bytes(b for b, g in zip(t, gone) if not g), spans))
    return out


def some_texts(rng, count, alphabet, passage):
    def text(n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    shared = [text(passage) for _ in range(6)]
    texts = [None, "", "short", text(5000)]
    for _ in range(count):
        parts = [text(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(20) : len(s) - rng.randrange(20)], text(rng.randrange(60))]
        texts.append("".join(parts))
    hot = [text(3 + i % 5) + shared[0] + text(i % 7) for i in range(count)]
    return texts + hot + [texts[7]] * 12 + [shared[1] * 40, "a" * 900, "é" * 50]


@pytest.mark.parametrize(
    "rule,alphabet",
    [
        (substrings.Repeats(20, 7), "abcdefgh"),
        (substrings.Repeats(20, 7, shard=600, crowd=400), "abcdefgh"),
        (substrings.Repeats(11, 3, shard=900, crowd=60), "abé"),
    ],
)
def test_removed_bytes_equal_brute_force(spark, rule, alphabet):
    texts = some_texts(random.Random(rule.crowd), 60, alphabet, 70)
    rows = [(None if i == 5 else i // 2, t, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").repartition(4)
    want = brute(texts, rule.length)
    got = [(r.doc_id, bytes(r.kept), [tuple(s) for s in r.spans]) for r in substrings.remove_repeats(docs, rule).collect()]
    assert sorted(got, key=str) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=str)
    digests = [tuple(r) for r in substrings.repeat_digests(docs, rule).collect()]
    expected = [
        (r[0], len((r[1] or "").encode()), sum(b - a for a, b in s), len(s), hashlib.sha256(kept).hexdigest())
        for r, (kept, s) in zip(rows, want)
    ]
    assert sorted(digests, key=str) == sorted(expected, key=str)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))
    texts = [text, text[700:1500], b"x", text[100:400] * 3]
    whole = [tuple(map(np.ndarray.tolist, s)) for s in substrings.segments(texts, 30, 8)]
    monkeypatch.setattr(substrings, "_TOGETHER", 256)
    cut = [tuple(map(np.ndarray.tolist, s)) for s in substrings.segments(texts, 30, 8)]
    places = [sorted((i, at + k, v) for n, a, c, h in found for i, at, m, v in zip(n, a, c, h) for k in range(m)) for found in (whole, cut)]
    assert places[0] == places[1] and len(places[0]) == sum(max(0, len(t) - 29) for t in texts)


def test_copies_only_and_empty_tables(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1200))
    docs = spark.createDataFrame([(i, text) for i in range(30)] + [(99, text[:399])], "doc_id long, text string")
    rows = {r.doc_id: r for r in substrings.repeat_digests(docs).collect()}
    assert all((rows[i].n_removed, rows[i].n_spans) == (1200, 1) for i in range(30)) and rows[99].n_removed == 0
    assert substrings.repeat_digests(docs.limit(0)).count() == 0


def test_shards_are_compared_by_their_anchors_in_little_time():
    """A megabyte of segments that share anchors; a suffix array of all of its bytes took 2.8 CPU seconds."""
    rng = np.random.default_rng(6)
    length, gram = 400, 64
    stretches, anchors = [], []
    for k in range(300):
        # segments of an anchor agree around it, each up to its own places
        middle = rng.integers(0, 40, 2 * length, np.uint8)
        for _ in range(6):
            made = rng.integers(0, 40, 2 * length, np.uint8)
            a, b = rng.integers(0, length), rng.integers(length + gram, 2 * length)
            made[a:b] = middle[a:b]
            n = int(rng.integers(1, length - gram + 2))
            into = int(rng.integers(n - 1, length - gram + 1))
            stretches.append(made[length - into : length - into + n + length - 1].tobytes())
            anchors.append(substrings.gram_hashes(middle[length : length + gram], gram).view(np.int64)[0])
    again = [k % 50 == 7 for k in range(len(stretches))]
    started = time.process_time()
    got = substrings.repeated_ranges(stretches, np.array(anchors), again, length, gram)
    took = time.process_time() - started
    seen = Counter(s[i : i + length] for s in stretches for i in range(len(s) - length + 1))
    for s, whole, ranges in zip(stretches, again, got):
        places = {i for i in range(len(s) - length + 1) if whole or seen[s[i : i + length]] > 1}
        assert {i for a, b in ranges for i in range(a, b)} == places
    assert sum(map(len, stretches)) > 900_000 and any(n > 1 for n in seen.values())
    assert took < 0.7


def test_anchors_of_periodic_stretches_are_the_leftmost():
    text = b"abcdefg" * 40 + b"x" * 90
    (number, at, count, anchors) = (np.concatenate(c) for c in zip(*substrings.segments([text], 60, 9)))
    stretches = [text[a : a + n + 59] for a, n in zip(at.tolist(), count.tolist())]
    places = substrings.anchor_places(stretches, anchors, 60, 9)
    hashes = substrings.gram_hashes(np.frombuffer(text, np.uint8), 9).view(np.int64)
    for a, n, into, v in zip(at.tolist(), count.tolist(), places.tolist(), anchors.tolist()):
        assert n - 1 <= into <= 60 - 9 and hashes[a + into] == v
        assert v not in hashes[a : a + into].tolist()


@pytest.mark.parametrize("suffixes", [[], [b""], [b"", b""], [b"ab\0", b"ab", b"", b"abc", b"ab"], [b"\0", b"\0\0", b"\0\1"]])
def test_sparse_suffix_arrays_and_their_prefixes(suffixes):
    order, shared = sparse_suffix_array(suffixes)
    assert [suffixes[i] for i in order] == sorted(suffixes) and sorted(order.tolist()) == list(range(len(suffixes)))
    own = sorted(suffixes)
    plain = [len(os.path.commonprefix([a, b])) for a, b in zip(own, own[1:])]
    assert shared.tolist() == [0, *plain][: len(own)]
