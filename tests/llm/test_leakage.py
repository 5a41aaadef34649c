import random

from prefixlens.llm import leakage as L
from prefixlens.llm.words import words


def brute(docs, items, m):
    out = set()
    grams = lambda t: {tuple(ws[i : i + m]) for ws in (words(t or ""),) for i in range(len(ws) - m + 1)}
    for i, *fields in items:
        for d, t in docs:
            for name, f in zip(("prompt", "answer"), fields):
                if d is not None and i is not None and grams(f) & grams(t):
                    out.add((d, i, name))
    return out


def test_search_equals_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randint(0, 9)), rnd.choice([None, text(rnd.randint(3, 12))])) for i in range(25)]
    docs = []
    for d in range(80):
        t = text(rnd.randint(0, 30))
        if rnd.random() < 0.5:
            source = rnd.choice(items)[1]
            t = t + ", " + source.upper() + "! " + text(5)
        docs.append((d, t))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (None, "w1 w2 w3 w4 w5")]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string").repartition(3)
    e = spark.createDataFrame(items, "item_id long, prompt string, answer string")
    for limit in (10**6, 20):
        got = L.find_leaks(d, e, 4, max_windows=limit)
        rows = {(r.doc_id, r.item_id, r.field): r for r in got.collect()}
        assert {k for k in rows if k[0] is not None} == brute(docs, items, 4)
    assert L.find_leaks(d.limit(0), e, 4).count() == 0 and L.find_leaks(d, e.limit(0), 4).count() == 0


def test_runs(spark):
    d = spark.createDataFrame([(1, "x a b c d e f y c d e f g"), (2, "a b c"), (3, "a b c d e"), (4, "b c d e f g h")], "doc_id long, text string")
    e = spark.createDataFrame([(9, "a b c d e f g", "a b")], "item_id long, prompt string, answer string")
    got = {r.doc_id: (r.windows, r.longest_run) for r in L.find_leaks(d, e, 4).collect()}
    assert got == {1: (5, 6), 3: (2, 5), 4: (3, 6)}


def test_words():
    assert words("It's ÉTÉ, naïve_x 3.5\n漢字") == ["it", "s", "été", "naïve", "x", "3", "5", "漢字"]
    assert words("İx y") == ["i̇x", "y"] and words("") == [] and words("—") == []
