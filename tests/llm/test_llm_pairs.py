"""Archives and the two similarity joins: byte-exact round trips and brute force."""

import base64
import hashlib
import io
import random
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cellcast.llm import capfilters, chosenpath, shingles, warczip


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, count, offset):
        return self.data[offset : offset + count]


def package_bytes(records, comment=b"", force=False):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        for name, data in records.items():
            with z.open(name, "w", force_zip64=force) as f:
                f.write(data)
    return buffer.getvalue()


def test_directory_with_comment_compressed_and_wide_entries(monkeypatch):
    data = {f"m{i}": bytes([i]) * 50 for i in range(20)}
    raw = package_bytes(data, comment=b"note PK\5\6 with a mark" + b"x" * 40)
    package = warczip.Package(Bytes(raw), len(raw))
    assert {n: package.read(n) for n in data} == data and package.read("m3", 10, 5) == bytes([3]) * 5
    with pytest.raises(ValueError):
        package.read("m3", 40, 20)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    wide = package_bytes(data, force=True)
    assert warczip.LOCATOR64 in wide
    package = warczip.Package(Bytes(wide), len(wide))
    assert {n: package.read(n) for n in data} == data
    with pytest.raises(ValueError):
        warczip.Package(Bytes(b"not a zip" * 9), 81)


PAGES = [
    (5, "http://a/", "<p>é</p>", 1), (2, "http://b/\r\nX: 1", "<p>é</p>", 1), (9, None, "<p>é</p>", 1), (7, "u", None, 1), (3, "u", "", 1),
    (8, "u", "\r\n\r\nPK\5\6", 1), (11, "big", "y" * 300_000, 1), (2, "again", "<p>é</p>", 1), (None, "n", "only", 1), (None, "n", "<p>é</p>", 1),
]


@pytest.mark.parametrize("least,package_size", [(0, 64 << 20), (4, 200)])
def test_pages_come_back_from_their_packages(spark, tmp_path, least, package_size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, payload int").repartition(2)
    manifest = warczip.write_packages(warczip.record_plan(pages, least), f"file://{tmp_path}/w", package_size)
    out = warczip.read_packages(manifest, f"file://{tmp_path}/w").collect()
    assert len(out) == len(PAGES)
    assert all(zipfile.ZipFile(r.path).testzip() is None for r in manifest.collect())
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str)
    want = []
    for page_id, _, html, _ in PAGES:
        body = (html or "").encode()
        ids = [i for i, _, h, _ in PAGES if (h or "").encode() == body and i is not None]
        first = min(ids, default=None)
        again = len(body) >= least and first is not None and page_id != first
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want.append((page_id, len(body), digest, "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert all(r.payload is None if r.record_type == "revisit" else len(r.payload) == r.payload_bytes for r in out)
    assert warczip.archive_pages(pages.limit(0)).count() == 0


def brute_sets(texts):
    out = []
    for text in texts:
        words = bytes((text or ""), "utf-8").translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
        out.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set()))
    return out


def brute_components(ids, sets, linked):
    tree = list(range(len(ids)))

    def root(i):
        while tree[i] != i:
            i = tree[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                tree[root(i)] = root(j)
    least = {}
    for i, name in enumerate(ids):
        least[root(i)] = min(name, least.get(root(i), name))
    return [least[root(i)] for i in range(len(ids))]


def near_corpus(seed=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "Ab"]
    base = [rng.choices(words, k=n) for n in (3, 4, 5, 6, 60, 90, 150, 150)]
    texts = [None, "", " \n", "one", "one", "ONE", "a b c d e"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(18):
            copy = list(b)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy))
    return texts + [" ".join(rng.choices(words, k=3000))] * 3


def test_shingle_sets_match_brute_force(monkeypatch):
    monkeypatch.setattr(shingles, "TOGETHER", 300)
    texts = near_corpus()
    mine = list(shingles.shingle_sets([None if t is None else t.encode() for t in texts]))
    want = brute_sets(texts)
    assert [len(s) for s in mine] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(mine[i], mine[j])) == len(want[i] & want[j])


@pytest.mark.parametrize("join", [chosenpath.PathJoin(), chosenpath.PathJoin(leaf=8, depth=2, trees=16), chosenpath.PathJoin(leaf=4, depth=0), chosenpath.PathJoin(leaf=16, depth=1, leaders=1)])
def test_near_duplicates_match_brute_force(spark, join):
    texts = near_corpus()
    ids = random.Random(1).sample(range(10_000), len(texts))
    rows = [(i, t, 1, 2) for i, t in zip(ids, texts)] + [(None, "one", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaf int, rep int").repartition(4)
    out = chosenpath.near_duplicates(docs, join).collect()
    assert len(out) == len(rows)
    sets = brute_sets(texts)
    linked = lambda i, j: bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    want = dict(zip(ids, brute_components(ids, sets, linked)))
    for r in out:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], len(sets[ids.index(r.doc_id)]))
            assert r.kept == (r.doc_id == r.component_id)


def test_near_duplicates_of_repeated_and_no_rows(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (9, "A b c d e F"), (7, None)], "doc_id long, text string")
    out = chosenpath.near_duplicates(docs)
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out.collect()) == [(4, 4, True), (4, 4, True), (7, 7, True), (9, 4, False)]
    assert chosenpath.near_duplicates(docs.limit(0)).count() == 0


def test_large_node_is_cut_into_parts_that_grow_with_it(spark):
    join = chosenpath.PathJoin(leaf=64, leaders=4)
    for n in (1000, 4000):
        crowded = spark.range(n).select(
            F.xxhash64("id").alias("cls"), F.lit(1.0).alias("weight"), F.lit(5).alias("node"), F.lit(n).alias("n"), F.lit(float(n)).alias("heavy")
        )
        parts = chosenpath.led_parts(crowded, join)
        assert parts.count() < 2 * n
        assert parts.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 64
        # three strays meet everything, the core doesn't meet itself again
        known = crowded.select("cls", F.when(F.abs("cls") % n < 3, F.col("cls")).otherwise(1).alias("known"))
        strays = known.where("known <> 1").count()
        met = chosenpath.stray_parts(chosenpath.with_core(crowded, known), join)
        assert met.count() <= n + strays * (-(-n * 2 // 64))
        joined = met.join(known, "cls")
        pairs = joined.where("known <> 1").select("leaf", F.col("cls").alias("stray")).join(joined.select("leaf", "cls"), "leaf")
        assert pairs.distinct().select("stray", "cls").distinct().count() == strays * n
    same = crowded.select("cls", F.lit(1).alias("known"))
    assert chosenpath.with_core(crowded, same).isEmpty()


def crowd_of_pairs(count, seed=5):
    """Texts of similarity 0.7 to each other, in pairs of similarity 0.85 to 0.87."""
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(385)]
    texts = []
    for k in range(count):
        base = [f"{k}x{rng.randrange(10**6)}" for _ in range(79)]
        texts += [" ".join(common + base), " ".join(common + base[:-35] + [f"{k}y{i}" for i in range(35)])]
    return texts


def test_pairs_at_the_limit_meet_however_deep_their_nodes_are(spark):
    join = chosenpath.PathJoin(leaf=16, trees=1)
    assert [chosenpath.trees_for(chosenpath.PathJoin(), s) for s in (1, 6, 25)] == [8, 8, 38]
    texts = crowd_of_pairs(40)
    one, other = brute_sets(texts[:2])
    assert 0.85 <= len(one & other) / len(one | other) < 0.87
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    out = chosenpath.near_duplicates(docs, join).collect()
    assert all(r.component_id in (r.doc_id, r.doc_id - r.doc_id % 2) for r in out)
    missed = sum(r.kept for r in out if r.doc_id % 2)
    assert missed <= 1, missed


def vector_rows(seed=21):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(16)
        for _ in range(6):
            v = centre + rng.standard_normal(16) * 0.12 * np.linalg.norm(centre) / 4
            rows.append((len(rows), v.astype(np.float32).tolist(), int(c % 3)))
    same = rows[3][1]
    rows += [(len(rows) + k, same, rows[3][2]) for k in range(5)] + [(1000, same, None), (1001, None, 1), (1002, [0.0] * 16, 1)]
    return rows + [(1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, [float("inf")] * 16, 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, (np.array(same) * 3).tolist(), rows[3][2])]


@pytest.mark.parametrize("block", [1024, 4])
def test_vector_links_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(capfilters, "BLOCK", block)
    rows = vector_rows()
    vectors = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int").repartition(3)
    out = {r.vec_id: r for r in capfilters.link_vectors(vectors).collect()}
    assert len(out) == len(rows)
    unit = {}
    for i, v, label in rows:
        if v and len(v) == 16 and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            unit[i] = (x / np.linalg.norm(x), label)
    ids = sorted(unit)
    linked = lambda i, j: unit[ids[i]][1] == unit[ids[j]][1] and unit[ids[i]][0] @ unit[ids[j]][0] >= 0.93
    want = dict(zip(ids, brute_components(ids, None, linked)))
    for i, r in out.items():
        n = sum(linked(ids.index(i), j) for j in range(len(ids)) if ids[j] != i) if i in unit else 0
        assert (r.n_links, r.component_id, r.kept) == (n, want.get(i, i), want.get(i, i) == i), i
    assert capfilters.link_vectors(vectors.limit(0)).count() == 0


def test_vectors_of_every_dimension_are_linked(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for dim, count in ((16, 60), (24, 50), (1, 3), (2, 4), (7, 2)):
        for _ in range(count):
            v, label = rng.standard_normal(dim), int(rng.integers(2))
            v /= np.linalg.norm(v)
            at = len(rows)
            rows += [(at, v.tolist(), label), (at + 1, (v + 0.01 * rng.standard_normal(dim)).tolist(), label), (at + 2, (v * 2).tolist(), label)]
    rows += [(5000 + k, [0.0] * 24, 1) for k in range(400)]
    unit = {i: (np.array(v) / np.linalg.norm(v), label) for i, v, label in rows if any(v)}
    for i, (x, label) in unit.items():
        want[i] = sum(j != i and len(x) == len(y) and label == other and x @ y >= 0.93 for j, (y, other) in unit.items())
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    out = {r.vec_id: r.n_links for r in capfilters.link_vectors(vectors).collect()}
    assert out == {i: want.get(i, 0) for i, _, _ in rows} and min(want.values()) >= 2


def test_unit_rows_of_very_large_and_very_small_vectors():
    x = np.array([[3.0, 4.0], [3e300, 4e300], [3e-320, 4e-320], [1.5e-160, 2e-160]])
    unit = capfilters.unit_rows(x)
    assert np.allclose(unit, [[0.6, 0.8]] * 4, rtol=1e-3)
    assert (unit[0] == x[0] / np.linalg.norm(x[0])).all()


def test_decoder_lists_every_cap_that_is_reached():
    code = capfilters.ProductCode.sized(12, 3, 5, 6)
    rotation, words = code.tables()
    unit = np.random.default_rng(1).standard_normal((40, 12))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ rotation
    gains = [turned[:, 4 * k : 4 * k + 4] @ words[k].T for k in range(3)]
    for i, caps in enumerate(code.decoder()(unit)):
        score = {25 * a + 5 * b + c: gains[0][i, a] + gains[1][i, b] + gains[2][i, c] for a in range(5) for b in range(5) for c in range(5)}
        floor = min(score[k] for k in caps)
        assert len(caps) >= 6 and set(caps) >= {k for k, s in score.items() if s >= code.alpha}
        assert not {k for k, s in score.items() if s > floor} - set(caps)


def test_groups_across_batches():
    from cellcast.llm.grouped import whole_groups

    keys = [1, 1, 2, 2, 2, 3, 4, 4, 4, 4, 5]
    batches = [pa.RecordBatch.from_pydict({"k": keys[a : a + 3], "v": list(range(a, min(a + 3, 11)))}) for a in range(0, 11, 3)]
    found = {}
    for batch, bounds in whole_groups(iter(batches), 1):
        for start, stop in bounds:
            name = batch.column(0)[start].as_py()
            assert name not in found
            found[name] = batch.column(1).slice(start, stop - start).to_pylist()
    assert found == {k: [i for i, x in enumerate(keys) if x == k] for k in set(keys)}


def family(rng, count, core, own):
    """Texts of ``core`` common words and ``own`` words of their own, in one block at the end."""
    common = [f"c{i}" for i in range(core)]
    return [" ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(count)]


def test_alike_documents_are_linked_before_they_descend(spark, monkeypatch):
    rng = random.Random(12)
    join = chosenpath.PathJoin(trees=1, leaf=256)
    monkeypatch.setattr(chosenpath, "trees_for", lambda join, steps: 1)
    rows = []
    cut = chosenpath.cut_lineage

    def counted(df, name="cut"):
        out = cut(df, name)
        if name == "path-level":
            rows.append(out.count())
        return out

    monkeypatch.setattr(chosenpath, "cut_lineage", counted)
    texts = family(rng, 3000, 100, 5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = chosenpath.near_duplicates(docs, join)
    assert found.where("component_id <> 0").count() < 300
    assert sum(rows) < 10 * len(texts)


def test_rows_with_shared_null_and_repeated_ids(spark):
    rng = random.Random(13)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(40)] for x in "ab")
    rows = [
        (1, " ".join(a), "x"), (2, " ".join([*a, "more"]), "x"), (2, " ".join(b), "x"), (None, " ".join(a), "x"),
        (1, " ".join(a), "x"), (None, None, "y"), (5, "", "y"), (5, "", "y"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = [tuple(r) for r in chosenpath.drop_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], *rows[5:]], key=str)
    assert chosenpath.drop_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_components_of_chains_stars_and_loops(spark, held):
    from cellcast.llm.common import components

    rng = random.Random(held)
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(100, 300)] + [(5, 5), (None, 3), (7, None)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    root = {}

    def least(v):
        root.setdefault(v, v)
        return v if root[v] == v else least(root[v])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = least(a), least(b)
            root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(3), held)
    assert sorted(tuple(r) for r in got.collect()) == sorted((v, least(v)) for v in root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_class_of_many_large_nodes_meets_its_tokens_once(spark, monkeypatch):
    join = chosenpath.PathJoin()
    large = spark.range(50).select(F.col("id").alias("cls"), F.col("id").alias("known"), F.lit(1.0).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20).cast("long"))).alias("node"))
    large = large.withColumns({"n": F.lit(50), "heavy": F.lit(50.0)})
    signed = spark.range(50).select(F.col("id").alias("cls"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("sig"))
    signed = signed.withColumn("sig", F.concat(*["sig"] * 4))
    want = signed.join(large, "cls").select("cls", F.explode(chosenpath._children(join, F.col("node"))).alias("node"))
    component = large.select("cls", (F.col("cls") % 2).alias("known")).distinct()
    joined, plain = [], type(large).join

    def watched(*args, **kwargs):
        joined.append(plain(*args, **kwargs))
        return joined[-1]

    monkeypatch.setattr(type(large), "join", watched)
    down = chosenpath.one_down(large, signed, join)
    rows = chosenpath.with_core(large, component)
    monkeypatch.undo()
    assert [d.count() for d in joined[:2]] == [50, 50]
    assert down.columns == ["cls", "known", "weight", "node"] and down.select("cls", "node").exceptAll(want).count() == 0 == want.exceptAll(down.select("cls", "node")).count()
    assert rows.count() == 1000 and rows.select("cls", "node").distinct().count() == 1000
