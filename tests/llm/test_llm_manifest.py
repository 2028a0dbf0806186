"""Merkle manifests against a tree built in plain Python."""

import hashlib
import random
import zlib

import pytest
from cellcast.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest int, Src int"


def sha(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i : i + fan])) for i in range(0, len(low), fan)])
    return levels


def beside(levels, spot, fan):
    out = []
    for level in levels[:-1]:
        first = spot - spot % fan
        out.append(("".join(level[first:spot]), "".join(level[spot + 1 : first + fan])))
        spot //= fan
    return out


def brute(rows, fan):
    of_source = {}
    for row in rows:
        of_source.setdefault(row[3], []).append(row)
    names = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(of_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[name] = own, climb([leaf_of(r, r[1]) for r in own], fan)
    upper = climb([trees[name][1][-1][0] for name in names], fan)
    root, out = upper[-1][0], []
    for k, name in enumerate(names):
        own, levels = trees[name]
        for spot, row in enumerate(own):
            text = row[1]
            if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            way = beside(levels, spot, fan) + beside(upper, k, fan)
            value = leaf_of(row, text)
            for left, right in way:
                value = sha(left + value + right)
            proof = sha("".join(a + b for a, b in way))
            out.append((row[0], leaf_of(row, row[1]), levels[-1][0], root, proof, value, value == root))
    return out


def some_rows(count, sources, rng):
    rows = []
    for i in range(count):
        source = None if i % 17 == 0 else f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        text = rng.choice([None, "", "a\nb", "é\n\n", "long " * 3000, "plain"])
        rows.append((None if i % 23 == 0 else rng.randrange(count), text, rng.choice(["en", None, ""]), source, rng.choice([3, None]), 1, 2))
    return rows + rows[:9] + rows[:3]


@pytest.mark.parametrize("count,sources,fan,height", [(400, 4, 3, 7), (400, 4, 3, 2), (300, 90, 3, 1), (200, 3, 2, 2), (1, 1, 3, 7), (40, 1, 4, 1)])
def test_manifest_equals_a_plain_tree(spark, count, sources, fan, height):
    rows = some_rows(count, sources, random.Random(count + height)) if count > 1 else [(7, "x\ny", None, "z", 1, 1, 2)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    given = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    got = merkle.prove(docs, given, merkle.Shape(fan, height))
    assert got.dtypes[0] == ("doc_id", "bigint")
    mine, want = [tuple(r) for r in got.collect()], brute(rows, fan)
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert {r[6] for r in want} == {True, False} or count < 100


def test_untouched_rows_verify_and_empty_tables(spark):
    docs = spark.createDataFrame(some_rows(60, 3, random.Random(2)), SCHEMA)
    assert merkle.prove(docs).where("not verified or folded_root <> root").count() == 0
    assert merkle.prove(docs.limit(0)).count() == 0
