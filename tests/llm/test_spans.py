import random
from collections import defaultdict

import numpy as np
import pytest

from prefixlens.llm import spans as S


def pick(b):
    for i, texts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        if i is not None and texts is not None:
            yield i, [t for t in texts if t is not None]


def brute(rows, length):
    where = defaultdict(set)
    for i, texts in rows:
        for p, t in enumerate([t for t in texts or [] if t is not None]):
            for k in range(len(t) - length + 1):
                where[t[k : k + length]].add((i, p, k))
    shared = {x for places in where.values() if len({i for i, *_ in places}) > 1 for x in places}
    pairs = {tuple(sorted((a, b))) for places in where.values() for a in {i for i, *_ in places} for b in {i for i, *_ in places} if a < b}
    covered = defaultdict(set)
    for i, p, k in shared:
        covered[i] |= {(p, k + j) for j in range(length)}
    return pairs, {i: len(c) for i, c in covered.items()}, shared


def corpus(seed, size, alphabet="abcdefgh ü漢🌍"):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(size):
        texts = []
        for _ in range(rnd.randint(0, 3)):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            if rnd.random() < 0.4:
                p = rnd.choice(passages)
                a = rnd.randint(0, 10)
                t += p[a : a + rnd.randint(5, 60)]
            texts.append(t + "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 20))))
        rows.append((i, texts))
    return rows


@pytest.mark.parametrize("bucket_windows", [1_000_000, 8, 0])
def test_spans_equal_brute_force(spark, bucket_windows):
    rows = corpus(4, 80)
    df = spark.createDataFrame(rows, "id long, texts array<string>").repartition(3)
    pairs, chars, shared = brute(rows, 16)
    found = S.find(df, pick, 16, bucket_windows=bucket_windows)
    assert {(r.id, r.part, r.at) for r in found.collect()} == shared
    got = [tuple(r) for r in S.sharing_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and pairs
    assert {r.id: r.shared_chars for r in S.shared_chars(found, 16).collect()} == chars


def test_edges(spark):
    same = "x" * 400 + "the quick brown fox jumps over the lazy dog"
    rows = [(1, [same]), (1, [same]), (2, [same, None]), (3, ["y" * 300, "y" * 300]), (4, None), (5, []), (6, [""]), (7, ["x" * 10]), (None, [same]), (8, ["\udce9".encode("utf-8", "replace").decode() * 50])]
    df = spark.createDataFrame(rows, "id long, texts array<string>")
    found = S.find(df, pick, 40)
    assert {tuple(r) for r in S.sharing_pairs(found).collect()} == {(1, 2)}
    assert {r.id: (r.shared_chars, r.stretches) for r in S.shared_chars(found, 40).collect()} == {1: (len(same), 1), 2: (len(same), 1)}
    assert S.find(df.limit(0), pick, 40).count() == 0


def test_rolling_and_minimisers():
    rnd = np.random.default_rng(0)
    codes = rnd.integers(0, 5, 500).astype(np.uint32)
    for width in (1, 2, 3, 7, 16, 31):
        h = S.rolling(codes, width, S._BASE[0])
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(tuple(codes[i : i + width]), x) == x
        assert len(set(seen.values())) == len(seen)
    hashes, starts, counts = S.super_kmers(codes, 40, 13)
    assert starts[0] == 0 and (starts[1:] == starts[:-1] + counts[:-1]).all() and starts[-1] + counts[-1] == 461
    h = S.rolling(codes, 13, S._BASE[0])
    for b, s, c in zip(hashes, starts, counts):
        assert all(h[k : k + 28].min() == b for k in range(s, s + c))
    _, _, long = S.super_kmers(np.zeros(20_000, np.uint32), 40, 13)
    assert long.max() <= S.MAX_WINDOWS and long.sum() == 20_000 - 39


def test_equal_hashes_of_different_texts_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "rolling", lambda codes, width, base: np.zeros(max(len(codes) - width + 1, 0), np.uint64))
    rows = {"bucket": [0] * 4, "id": [1, 2, 3, 4], "part": [0] * 4, "at": [0] * 4, "windows": [1] * 4, "chars": [b"abcd", b"wxyz", b"abcd", b"qqqq"]}
    t = pa.table({k: pa.array(v, pa.binary() if k == "chars" else pa.int64() if k in ("bucket", "id") else pa.int32()) for k, v in rows.items()})
    out = S._sort_bucket(t, 4).to_pylist()
    assert sorted(r["id"] for r in out) == [1, 3] and len({(r["w1"], r["w2"]) for r in out}) == 1


@pytest.mark.parametrize("bucket_windows", [1_000_000, 0])
def test_texts_whose_hashes_agree_share_nothing(spark, bucket_windows):
    # a polynomial mod 2**64 gives these two words one value for every odd base
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, [one]), (2, [other]), (3, ["xy" + one + "z"])], "id long, texts array<string>")
    found = S.find(df, pick, 1024, bucket_windows=bucket_windows)
    assert {tuple(r) for r in S.sharing_pairs(found).collect()} == {(1, 3)}
    assert {r.id: r.shared_chars for r in S.shared_chars(found, 1024).collect()} == {1: 1024, 3: 1024}


def test_records_with_the_same_windows_are_one_class(spark):
    shared, other = "the quick brown fox jumps over it " * 2, "a completely different passage here, " * 2
    rows = [(1, [shared]), (2, [shared]), (3, ["!!" + shared]), (4, [shared, shared]), (5, [other]), (6, [other + shared]), (7, ["nothing of the kind in here at all, nothing"])]
    df = spark.createDataFrame(rows, "id long, texts array<string>")
    members, links = S.sharing_classes(S.find(df, pick, 30))
    assert {r.id: r.key for r in members.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    found = [tuple(r) for r in links.collect()]
    assert len(found) == len(set(found)) and set(found) == {(1, 4), (1, 6), (4, 6), (5, 6)}
    pairs, _, _ = brute(rows, 30)
    assert {tuple(r) for r in S.member_pairs(members, links).collect()} == pairs
