import itertools
import random
from fractions import Fraction

from prefixlens.llm import neardup as N
from prefixlens.llm.words import words


def pick(b):
    return ((i, g, t) for i, g, t in zip(*(c.to_pylist() for c in b.columns)) if t is not None and i is not None)


def brute(rows, n, t, least):
    sets = {}
    for i, g, text in rows:
        ws = words(text) if text is not None else []
        if i is not None and len(ws) >= max(least, n):
            sets[i] = (g, {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)})
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        (ga, x), (gb, y) = sets[a], sets[b]
        if ga == gb and len(x & y) * t.denominator >= t.numerator * len(x | y):
            out.add((a, b))
    return out


def corpus(seed, size):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, texts = [], []
    for i in range(size):
        if texts and rnd.random() < 0.6:
            ws = list(rnd.choice(texts))
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 8])):
                k = rnd.randrange(len(ws) + 1)
                rnd.choice([lambda: ws.insert(k, rnd.choice(vocab)), lambda: ws.pop(min(k, len(ws) - 1)) if len(ws) > 1 else None, lambda: rnd.shuffle(ws) if rnd.random() < 0.1 else None])()
        else:
            ws = [rnd.choice(vocab) for _ in range(rnd.randint(1, 40))]
        texts.append(ws)
        rows.append((i, rnd.choice("gh"), " ".join(ws)))
    return rows


def join(spark, rows, n=3, t="3/5", least=5):
    df = spark.createDataFrame(rows, "id long, g string, text string").repartition(3)
    return N.similarity_join(df, pick, n, t, least)


def test_join_equals_brute_force(spark):
    for seed, n, t in ((1, 3, "3/5"), (2, 2, "4/5"), (3, 5, "4/5")):
        rows = corpus(seed, 160)
        got = N.member_pairs(*join(spark, rows, n, t))
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(set(found))
        assert set(found) == brute(rows, n, Fraction(t), 5)


def test_edges(spark):
    same = "one two three four five six"
    rows = [(1, "g", same), (1, "g", same), (2, "g", same), (3, "h", same), (4, "g", None), (5, "g", ""), (6, "g", "one two"), (7, "g", same.upper() + "!"), (None, "g", same), (8, "g", "x " * 3000), (9, "g", "x " * 2000)]
    members, links = join(spark, rows)
    assert {tuple(r) for r in N.member_pairs(members, links).collect()} == {(1, 2), (1, 7), (2, 7), (8, 9)}
    counts = {r.id: tuple(r)[1:] for r in N.link_counts(members, links).collect()}
    assert counts[1] == (1, 0, 2) and counts[7][0] == 1 and counts[3] == (3, 0, 0)
    empty = join(spark, [(1, "g", None)])
    assert N.member_pairs(*empty).count() == 0
    none = spark.createDataFrame([], "id long, g string, text string")
    assert N.member_pairs(*N.similarity_join(none, pick, 3, "3/5", 5)).count() == 0


def test_threshold_is_inclusive(spark):
    # 6 and 6 trigrams, 4 or 5 in common: 4/8 and 5/7
    a = "a b c d e f g h"
    rows = [(1, "g", a), (2, "g", "a b c d e f x y"), (3, "g", "z b c d e f g h")]
    found = {tuple(r) for r in N.member_pairs(*join(spark, rows, 3, "1/2")).collect()}
    assert found == brute(rows, 3, Fraction(1, 2), 5) and (1, 2) in found
    assert (1, 2) not in {tuple(r) for r in N.member_pairs(*join(spark, rows, 3, "51/100")).collect()}


def test_hot_boilerplate_loses_nothing(spark):
    rnd = random.Random(9)
    boiler = " ".join(f"b{i}" for i in range(30))
    rows = [(i, "g", boiler + " " + " ".join(f"u{i}_{j}" if rnd.random() < 0.9 else "common" for j in range(rnd.choice([4, 12, 30])))) for i in range(60)]
    assert {tuple(r) for r in N.member_pairs(*join(spark, rows)).collect()} == brute(rows, 3, Fraction(3, 5), 5)
