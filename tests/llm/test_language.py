import itertools
import os

import numpy as np
import pytest

from prefixlens.llm import language as L

DATA = "/root/testdata/sf0.001/lang_samples.parquet"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 1, 4])
    e = rng.random((sizes.sum(), 3)) + 0.1
    trans = rng.normal(size=(3, 3))
    p, joint, inner = L.ChainField.posteriors(e, trans, sizes, pairs=True)
    at, want, wanted = 0, np.zeros_like(e), np.zeros((3, 3))
    for n in sizes:
        total, marginal, pair = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            w = np.prod([e[at + i, y] for i, y in enumerate(path)]) * np.exp(sum(trans[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        want[at : at + n] = marginal / total
        wanted += pair / total
        at += n
    assert np.allclose(p, want) and np.allclose(joint, wanted) and inner.tolist() == [1, 2, 5, 6, 7]


def test_labels():
    for label in ("de", "DE", "de-AT", "de_DE", "ger", "deu", "GER-Latn", " de "):
        assert L.same_language(label, "de") and L.same_language(label, "deu")
    for label in (None, "", "und", "mul", "unknown", "den", "nl", "xx"):
        assert not L.same_language(label, "de")


def test_technical_and_sentences():
    text = 'One path is a/b.sql, ok? Two\nlines here.\n```\ncode. More code.\n```\n{"a": 1, "b": "Word here."}\n12:00:01 INFO x.y seg=1 done after 3 ms key=ab\n# Head-1\n他来了。她走了！“好”Tail without end'
    got = [(text[a:b], whole) for a, b, whole, _ in L.sentences(text)]
    assert got == [("One path is a/b.sql, ok?", True), ("Two\nlines here.", True), ("他来了。", True), ("她走了！", True), ("“好”Tail without end", False)]
    for line in ("parser/a.py:77: sort rotating fragments again", "09:50:20 WARN x evicted after some time", "test it works ... ok (0.27s)", '{"a": "some words here"}', "def f(x): return x.y + 1;"):
        assert L.technical(line), line
    assert [w for *_, w in L.sentences("Read dir/file.txt, Zitex-695 and peut-il l'eau.")] == [["read", "and", "peut", "il", "l", "eau"]]
    assert list(L.sentences("")) == [] and list(L.sentences("12 34. 5")) == []


def test_text_on_the_line_of_a_heading():
    text = " # Kade-33 De ontvanger zet het kenmerk voor de vaste tekst. Het venster weigert lege sleutels zonder uitleg. \nThe session is short.\n# Kade-34\n```\n# A comment. In code.\n```"
    got = [(text[a:b], whole) for a, b, whole, _ in L.sentences(text)]
    assert got == [("Kade-33 De ontvanger zet het kenmerk voor de vaste tekst.", True), ("Het venster weigert lege sleutels zonder uitleg.", True), ("The session is short.", True)]


@pytest.fixture(scope="module")
def samples(spark):
    if not os.path.exists(DATA):
        pytest.skip("no samples")
    return spark.read.parquet(DATA)


def test_held_out_accuracy_and_switches(spark, samples):
    rows = sorted((r.sample_id, r.lang, r.text) for r in samples.collect())
    train, test = [r[1:] for r in rows if r[0] % 3], [r[1:] for r in rows if r[0] % 3 == 0]
    field = L.ChainField.train(train)
    tagger = L.Tagger(field)
    right = total = 0
    for variant in (lambda t: t, str.upper, L.plain):
        for (language, _), found in zip(test, tagger.label([variant(t) for _, t in test])):
            for *_, p in found:
                total += 1
                right += field.languages[int(p.argmax())] == language
    assert right / total >= 0.98
    mixed = right = total = 0
    for (a, s), (b, t) in zip(test, test[7:]):
        if a != b:
            found = tagger.label([s + "\n\n" + t])[0]
            for start, *_, p in found:
                total += 1
                right += field.languages[int(p.argmax())] == (a if start < len(s) else b)
            mixed += 1
    assert mixed > 10 and right / total >= 0.95


def test_documents(spark, samples):
    by = {}
    for r in samples.collect():
        by.setdefault(r.lang, []).append(r.text)
    rows = [
        (1, "de", by["de"][0] + " " + by["de"][1]), (2, "en", by["de"][0] + " " + by["de"][1]), (3, None, by["fr"][0] + "\n\n" + by["fr"][1]), (4, "fr-CA", " ".join(by["fr"][:6]) + "\n\n" + by["zh"][0] + by["zh"][1]),
        (5, "en", None), (6, "en", ""), (7, "en", '{"a": 1}\n```\nx = 1\n```'), (8, "xx", "12345"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, segment int")
    segs = L.segments(df, samples)
    got = {(r.doc_id, r.lang) for r in L.unnamed_languages(segs, sorted(by)).collect()}
    assert got == {(2, "de"), (3, "fr"), (4, "zh")}
    assert {r.doc_id: r.language for r in L.document_languages(segs).collect()} == {1: "de", 2: "de", 3: "fr", 4: "fr"}
    rows_ = segs.where("doc_id = 4").orderBy("segment").collect()
    assert [r.language for r in rows_] == ["fr", "zh"] and all(0.5 < r.confidence <= 1 for r in rows_) and rows_[0].start == 0
    assert L.segments(df.limit(0), samples).count() == 0
    with pytest.raises(ValueError):
        L.segments(df, samples.limit(0))


def test_samples_of_every_language_are_taken(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L.ChainField, "train", lambda rows: seen.append(rows) or L.ChainField(["en"], np.zeros((L.SPACE, 1)), np.zeros((1, 1))))
    rows = [(i, "en" if i < 5 else "de" if i < 9 else "fr", f"t{i}") for i in range(10)]
    samples = spark.createDataFrame(rows, "sample_id long, lang string, text string")
    documents = spark.createDataFrame([], "doc_id long, lang string, text string")
    for most in (5, 2, 100):
        L.segments(documents, samples, max_samples=most)
    assert [[t for _, t in s] for s in seen] == [["t0", "t1", "t5", "t6", "t9"], ["t0", "t5", "t9"], [f"t{i}" for i in range(10)]]


def test_long_technical_lines_are_set_aside():
    log = "12:00:01 INFO window closed after " + "the next turn of the same session " * 6 + "ended."
    assert len(log) >= 200 and list(L.sentences(log)) == [] and list(L.sentences(log[:60] + ".")) == []


def test_long_words_have_the_ngrams_of_their_end():
    assert L.hash_text("qzk") % L.SPACE in L.features("x" * 40 + "qzk")


def test_ties_go_to_the_first_language(spark):
    rows = [(1, None, 0, "es", 0.9, 0, 9, 2, 10), (1, None, 1, "en", 0.8, 9, 20, 2, 10), (2, "x", 0, "nl", 0.9, 0, 9, 2, 3), (2, "x", 1, "fr", 0.8, 9, 20, 2, 4)]
    got = {r.doc_id: (r.language, round(r.share, 3), round(r.confidence, 3)) for r in L.document_languages(spark.createDataFrame(rows, L.SEGMENTS)).collect()}
    assert got == {1: ("en", 0.5, 0.8), 2: ("fr", round(4 / 7, 3), 0.8)}


def test_long_chains_in_pieces_equal_whole_ones():
    rng = np.random.default_rng(1)
    field = L.ChainField(["a", "b", "c"], np.zeros((L.SPACE, 3)), np.full((3, 3), -1.0) + 3 * np.eye(3))
    sizes = np.array([3, 5000, 700, 1, L.CHAIN, 1300])
    emissions = np.exp(rng.normal(size=(sizes.sum(), 3)))
    assert np.abs(L.Tagger(field)._posteriors(emissions, sizes) - L.ChainField.posteriors(emissions, field.transitions, sizes)).max() < 1e-6
