"""Language, toxicity, tokens and packing: round trips, exact tokenizers, held-out rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from cellcast.llm import langid, packing, tokencount, toxicity
from cellcast.llm.common import held_out

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "é" * 3, "<|endoftext|> a<|startoftext|>", "It's we'll can't!!! 12,5 á Å ΟΔΟΣ İ", "x" * 3000, "☃\x1c\x0b z", "ﬁ ª µ Straße ÀÉ.", "don't.'s a.'s"]


def language_corpus():
    rng = random.Random(3)
    kinds = {"xx": "ka lo mi ne pu".split(), "yy": "str gröd fjör änd".split(), "zz": "que ción ado ña".split()}
    return [
        (i, " ".join("".join(rng.choices(kinds[lang], k=2)) for _ in range(rng.choice([12, 60, 300]))), lang, "s")
        for i in range(400)
        for lang in [rng.choice(sorted(kinds))]
    ]


def test_language_net_learns_and_marks_texts_without_letters(spark):
    rows = language_corpus()
    more = [(900, None, "xx", "s"), (901, "12 %", "xx", "s"), (902, "", None, "s"), (903, "kalo", None, None), (904, "ka lo " * 60_000, "xx", "s")]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string")
    net = langid.fit_language_model(docs, ~held_out("doc_id", 4, 2), per_label=150)
    out = {r.doc_id: r for r in langid.predict_languages(docs, net).collect()}
    assert len(out) == len(rows) + len(more)
    test = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([out[i].lang_pred == lang for i, _, lang, _ in test]) > 0.97
    assert {out[i].lang_pred for i in (900, 901, 902)} == {"und"} and out[903].lang_pred in net.labels
    assert out[904].lang_pred == "xx" and all(0 <= r.score <= 1 for r in out.values())
    assert langid.fit_language_model(docs.limit(0), ~held_out("doc_id", 4, 2)) is None
    assert {r.lang_pred for r in langid.predict_languages(docs, None).collect()} == {"und"}


def test_language_net_learns_every_label(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{i:02d}": [letters[i % 26] + letters[(i * 7 + i // 26) % 26], letters[(i * 5 + 3 + i // 26) % 26] * 2] for i in range(80)}
    rng = random.Random(6)
    rows = [(lang, " ".join(rng.choices(words, k=40))) for lang, words in kinds.items() for _ in range(12 if lang > "l70" else 25)]
    rows += [("rare", "øß ßø"), ("rare", "øß")]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "doc_id long, text string, lang string")
    for in_all in (38_400, 400):
        net = langid.fit_language_model(docs, F.lit(True), in_all=in_all)
        assert net.labels == [*sorted(kinds), "rare"]
    found = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, net).collect()}
    assert np.mean([found[i] == lang for i, (lang, _) in enumerate(rows) if lang > "l70"]) > 0.5


def test_tables_give_the_networks_own_responses():
    net = langid.ByteNet(["a", "b"])
    x, sizes = langid.windows(bytes(range(1, 256)) * 3)
    assert sizes.sum() == 765
    top, _ = net._pool(x)
    plain = langid._softmax(np.maximum(top, 0) @ net.out + net.bias)
    assert np.allclose(np.exp(net.scorer()(x)), plain, atol=1e-5)


def toxic_corpus(seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abdeghiklmnoprstu", k=rng.randint(3, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(500):
        text, toxic = rng.choices(words, k=rng.randint(20, 120)), int(i % 5 == 0)
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(["vilebad", "nastyone", "grimster" + rng.choice("abcdefgh")]))
        if i % 7 == 1:
            text += ["clean", "vilebad"] if not toxic else []
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_lexicon_finds_held_out_toxic_texts_and_disguises(spark):
    rows, labels = toxic_corpus()
    rows += [(900, "a v1lebаd thing " * 3), (901, None), (902, ""), (903, "word " * 50_000), (904, "NАSTY​ONE nastyone vilebad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (901, 1, 1), (None, 1, 1), (5, 1, None), (10, 1, 1)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_toxicity(docs, marks, ~held_out("doc_id", 3, 1))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, lexicon).collect()}
    truth = {i: t for i, _, t in labels}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([out[i].predicted == truth[i] for i in test]) > 0.97
    assert out[900].predicted == 1 and out[904].predicted == 1
    assert out[901].predicted == out[902].predicted == out[903].predicted == 0
    assert any("clean vilebad" in p for p in lexicon.exceptions)
    clash = docs.selectExpr("*", "1 as score", "'k' as Predicted")
    assert toxicity.score_toxicity(clash, lexicon).columns == ["doc_id", "text", "score", "predicted"]
    kept = toxicity.drop_toxic(clash, lexicon)
    assert kept.columns == clash.columns and kept.count() == sum(r.predicted == 0 for r in out.values())


def test_lexicon_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit_toxicity(docs, none, ~held_out("doc_id", 3, 1))
    assert toxicity.score_toxicity(docs, lexicon).first().predicted == 0
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0


def test_copies_of_one_toxic_text_teach_nothing():
    sample = [("quimble fronk dask zoltar " + "plain words here and there " * 5, 1)] * 40 + [("plain words here and there " * 5, 0)] * 40
    assert toxicity.learn_lexicon(sample, (40, 40)).weights == {}


def odd_texts(seed=8):
    rng = random.Random(seed)
    parts = ["Hello", "world", "it's", "é", "ÀB", "12", "á", "--", "...", "☃", "ß", "İ", "\n", "\t", "  ", "<|endoftext|>", "日本", "'s", "ǅ"]
    return ODD + ["".join(rng.choice(parts) + rng.choice(["", " ", ".", "!? "]) for _ in range(40)) for _ in range(60)]


def test_word_tokenizer_is_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    for limit, chunk in ((800_000, 1 << 20), (5, 64)):
        monkeypatch.setattr(packing, "REMEMBERED", limit)
        monkeypatch.setattr(packing, "CHUNK", chunk)
        words = packing.WordTokenizer(WORD_BPE)
        for text in odd_texts():
            want = whole.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(words.encode(text or ""), "<u4").tolist() == want, text


def check_packing(pieces, want, tokens):
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(docs) == set(want)
    for doc_id, own in docs.items():
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            ids = want[doc_id][p.start : p.start + p.length]
            assert p.start == at and p.length == len(ids) > 0 and p.doc_tokens == len(want[doc_id])
            assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += p.length
        assert at == len(want[doc_id])
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= tokens and (at == tokens or at & (at - 1) == 0)
    return sequences


@pytest.mark.parametrize("limits", [packing.Limits(64, 256, 64), packing.Limits(64, 3, 64), packing.Limits(2048, 256, 2048)])
def test_documents_are_packed_whole_without_padding(spark, limits):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    texts = odd_texts() + ["many words " * 400]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, offset string").repartition(3)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    sequences = check_packing(packing.pack_documents(docs, WORD_BPE, limits).collect(), want, limits.tokens)
    assert max(map(len, sequences.values())) <= limits.segments
    assert packing.pack_documents(docs.limit(0), WORD_BPE, limits).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(100, 6, 100), packing.Limits(100, 6, 30), packing.Limits(100, 2, 60)])
def test_examples_keep_all_three_limits(spark, limits):
    rng = random.Random(6)
    rows = [(i, n, rng.randint(0, n)) for i in range(300) for n in [rng.randint(1, 100)]]
    rows += [(400, None, 1), (401, 0, 0), (402, 100, None), (403, 5, 9), (404, 101, 0), (405, -3, 2), (406, 60, -1)]
    examples = spark.createDataFrame(rows, "doc_id long, tokens long, loss_tokens long").repartition(2)
    used = defaultdict(list)
    size = {i: (n or 0, max(0, min(loss or 0, n or 0))) for i, n, loss in rows}
    out = packing.pack_examples(examples, limits).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _, _ in rows)
    for r in out:
        tokens, loss = size[r.doc_id]
        reason = "empty" if tokens <= 0 else "tokens" if tokens > 100 else "loss_tokens" if loss > limits.loss else None
        assert r.reason == reason and (r.sequence_id is None) == (r.offset is None) == (reason is not None)
        if reason is None:
            used[r.sequence_id].append((r.offset, tokens, loss))
    totals = []
    for held in used.values():
        held.sort()
        # offsets leave no gap
        assert [at for at, _, _ in held] == [sum(n for _, n, _ in held[:k]) for k in range(len(held))]
        totals.append((sum(n for _, n, _ in held), len(held), sum(loss for *_, loss in held)))
    assert all(a <= limits.tokens and b <= limits.segments and c <= limits.loss for a, b, c in totals)
    # sequences are full by the limit that binds
    full = [sum(t[k] for t in totals) / bound / len(totals) for k, bound in enumerate((limits.tokens, limits.segments, limits.loss))]
    assert max(full) > 0.75


def unigram_of(vocabulary, byte_fallback):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_unigram_tokenizers(spark):
    whole = unigram_of(tokencount.model_vocabulary(PIECES), True)
    texts = [t for t in odd_texts() if t]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(900, None, 0), (901, "", 0)], "doc_id long, text string, n_tokens int")
    out = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, PIECES).collect()}
    assert out == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)} | {900: 0, 901: 0}
    assert tokencount.count_tokens(docs.limit(0), PIECES).count() == 0


def test_ties_and_unknown_runs_follow_the_tokenizer():
    rng = random.Random(2)
    for _ in range(60):
        pieces = {"".join(rng.choices("▁abc", k=rng.randint(1, 4))) for _ in range(12)}
        vocabulary = [("<unk>", 0.0), *[(p, float(-rng.randint(1, 4))) for p in sorted(pieces)]]
        whole, counter = unigram_of(vocabulary, False), tokencount.UnigramCounter(vocabulary)
        for _ in range(20):
            text = "".join(rng.choices("abcxé ", k=rng.randint(1, 25)))
            assert counter.count(text) == len(whole.encode(text, add_special_tokens=False).ids), (vocabulary, text)
