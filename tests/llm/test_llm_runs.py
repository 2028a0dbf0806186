"""Suffix arrays and periodic runs against brute force."""

import hashlib
import random

import numpy as np
import pytest
from cellcast.llm import runs, suffix
from cellcast.llm.queries import plant_period
from hypothesis import given, settings
from hypothesis import strategies as st


def plain_order(text):
    return sorted(range(len(text)), key=lambda i: tuple(text[i:]))


def plain_prefixes(text, order):
    out = [0] * len(text)
    for a, b in zip(order, order[1:]):
        k = 0
        while b + k < len(text) and a + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        out[b] = k
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 5))
def test_suffix_arrays_and_prefixes(text, times):
    for t in (text, text * times, [x * 1000 for x in text]):
        order = plain_order(t)
        words = np.array(t, np.int64)
        assert suffix.doubled_suffix_array(words).tolist() == order
        assert suffix.induced_suffix_array(words).tolist() == order
        if len(t) > 1:
            small = suffix.suffix_types(words)
            starts = np.append(0, np.cumsum(np.bincount(words)))
            marks = np.flatnonzero(small[1 : len(t)] & ~small[: len(t) - 1]) + 1
            marks = np.array([i for i in order if i in set(marks.tolist())], np.int64)
            assert suffix._induce_by_bucket(words, small, starts, marks).tolist() == order
            assert suffix._induce_by_suffix(words, small, starts, marks).tolist() == order
        assert suffix.permuted_prefixes(words, np.array(order)).tolist() == plain_prefixes(t, order)


def test_long_strings_of_both_alphabets():
    rng = np.random.default_rng(5)
    block = rng.integers(0, 20, 700)
    text = np.concatenate([rng.integers(0, 20, 9000), block, np.zeros(3000, np.int64), block, block, rng.integers(0, 9000, 5000), block])
    sa = suffix.induced_suffix_array(text)
    assert (sa == suffix.doubled_suffix_array(text)).all()
    low = text % 20
    sa = suffix.induced_suffix_array(low)
    assert (sa == suffix.doubled_suffix_array(low)).all()
    assert suffix.permuted_prefixes(low, sa).max() >= 2999
    assert suffix.induced_suffix_array(np.zeros(0, np.int64)).tolist() == []


def plain_runs(words, rule):
    n, out = len(words), {}
    for p in range(1, n // rule.times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= rule.least and length >= rule.times * p:
                out.setdefault((i, length), p)
            i = max(j, i + 1)
    return sorted(((s, length, p) for (s, length), p in out.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=5), st.integers(1, 9)), max_size=6), st.sampled_from([(4, 6), (3, 5), (4, 2), (2, 6)]))
def test_runs_equal_brute_force(parts, rule):
    times, least = rule
    rule = runs.RunRule(max(times, 3), least)
    words = [w.encode() for unit, n in parts for w in unit * n]
    other = [b"a"] * 7
    assert runs.text_runs([words, other, words[::-1], []], rule) == [plain_runs(t, rule) for t in (words, other, words[::-1], [])]


def test_real_texts_and_long_ones():
    rng = random.Random(3)
    rule = runs.RunRule()
    texts = [plant_period(i, [rng.choice("abcdefghij").encode() for _ in range(rng.randrange(1, 300))]) for i in range(400)]
    assert runs.text_runs(texts, rule) == [plain_runs(t, rule) for t in texts]
    assert sum(map(len, runs.text_runs(texts, rule))) > 10
    unit = [str(i).encode() for i in range(9000)]
    assert runs.text_runs([unit * 5 + [b"x"] + [b"1"] * 50_000], rule) == [[(0, 45000, 9000), (45001, 50000, 1)]]


def test_rows_and_digests(spark):
    text = "start " + "la di " * 5 + "end end end end end end end stop"
    rows = [(1, text, 7), (1, text, 7), (None, text, 7), (2, None, 7), (3, "", 7), (4, "\u00a0 é ", 7), (5, "x " * 2000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(3)
    found = runs.periodic_runs(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1].collapsed == got[None].collapsed == "start la di end stop"
    assert [tuple(r) for r in got[1].runs] == [(1, 10, 2), (11, 7, 1)]
    assert got[4].collapsed == "\u00a0 é" and got[2].runs == [] and got[3].collapsed == ""
    rows = {r.doc_id: r.asDict() for r in runs.run_digests(found).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows[1] == {
        "doc_id": 1, "n_runs": 2, "start": 1, "length": 10, "period": 2, "exponent_milli": 5000,
        "runs_sha256": sha("1,10,2\n11,7,1\n"), "collapsed_sha256": sha("start la di end stop"),
    }
    assert rows[2] == dict.fromkeys(rows[2]) | {"doc_id": 2, "n_runs": 0, "runs_sha256": sha(""), "collapsed_sha256": sha("")}
    assert rows[5]["length"] == 2000 and runs.run_digests(runs.periodic_runs(docs.limit(0))).count() == 0


@pytest.mark.parametrize("doc_id", [3, 7, 11, 20, 22, 36, 43])
def test_planted_period(doc_id):
    import zlib

    words = [str(i).encode() for i in range(57)]
    h = zlib.crc32(str(doc_id).encode())
    got = plant_period(doc_id, words)
    if h % 10 == 0:
        a, p = (h // 10) % 57, 1 + (57 - (h // 10) % 57) // (3 + (h // 10) % 8)
        assert all(got[i] == words[i if i < a else a + (i - a) % p] for i in range(57))
    else:
        assert got == words
