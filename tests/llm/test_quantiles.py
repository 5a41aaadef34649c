import random
from collections import defaultdict

import numpy as np

from prefixlens.llm import quantiles as Q


def exact(vs, q):
    vs = sorted(vs)
    return vs[max(int(np.ceil(round(q * len(vs), 9))), 1) - 1]


def test_leaves_keep_order_and_hold_their_values():
    rnd = random.Random(3)
    vs = {0, 1, -1, 4095, 65535, 65536, 65537, 131071, 131072, 10**6, 2**53 - 1, 2**53 + 1, 2**62, 2**62 - 1, 2**63 - 1, -65536, -(2**63), -(2**62)}
    vs = np.array(sorted(vs | {rnd.randint(-(2**63), 2**63 - 1) >> s for s in range(0, 63)}), np.int64)
    leaves = Q.leaves_of(vs)
    assert (np.diff(leaves) >= 0).all() and leaves.min() >= 0 and leaves.max() < 1 << Q.DEPTH
    low, high = Q._bounds(leaves)
    assert all(a <= max(v, -(2**63) + 1) <= b for v, a, b in zip(vs.tolist(), low.tolist(), high.tolist()))


def check(rows, truth, keys, qs):
    assert len(rows) == len(truth) * len(qs)
    for r in rows:
        vs = truth[tuple(r[c] for c in keys)]
        asked = max(int(np.ceil(round(r.q * r.n, 9))), 1)
        assert r.n == len(vs) and r.low <= exact(vs, r.q) <= r.high
        assert asked <= sum(v <= r.high for v in vs) <= asked + r.rank_error


def test_bounds_hold_and_merge(spark):
    rnd = random.Random(5)
    rows = []
    for g in ("hot", "cold", None):
        for day in range(3):
            for _ in range(4000 if g == "hot" else 60):
                v = None if rnd.random() < 0.05 else 0 if rnd.random() < 0.05 else int(rnd.lognormvariate(8, 2)) * (1 if rnd.random() < 0.95 else -1)
                rows.append((g, day, len(rows), v))
    rows += rnd.sample(rows, 200)  # repeated rows count once
    df = spark.createDataFrame([(*r, None, "x") for r in rows], "g string, day int, i long, val long, none long, n string")
    per, whole = defaultdict(list), defaultdict(list)
    for g, day, _, v in set(rows):
        if v is not None:
            per[g, day, "val"].append(v)
            whole[g, "val"].append(v)
    k, qs = 200, (0.01, 0.5, 0.95, 1.0)
    for most in (Q.GROUP_ROWS, 1000):  # also with groups in parts
        days = Q.digest(df, ["g", "day"], ["val", "none"], "i", k, most)
        size = {(r.g, r.day): len(r.nodes) for r in days.collect()}
        assert size["hot", 0] <= 3 * k and size["hot", 0] < len(set(per["hot", 0, "val"]))
        check(Q.percentiles(days, ["g", "day", "metric"], qs).collect(), per, ("g", "day", "metric"), qs)
        merged = Q.percentiles(Q.merge(days, ["g", "metric"], k), ["g", "metric"], qs).collect()
        check(merged, whole, ("g", "metric"), qs)
        assert max(r.rank_error for r in merged if r.g == "hot") <= Q.DEPTH * 12000 / k + 2000


def test_values_of_one_leaf_are_stated(spark):
    vs = [10**6 + i % 16 for i in range(2000)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(vs)], "g string, i long, v long")
    (r,) = Q.percentiles(Q.digest(df, ["g"], ["v"], "i"), ["g", "metric"], (0.5,)).collect()
    assert r.low <= exact(vs, 0.5) <= r.high and sum(v <= r.high for v in vs) == 1000 + r.rank_error == 2000


def test_edges(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 5), ("b", 4, None)], "g string, i long, v long")
    d = Q.digest(df, ["g"], ["v"], "i")
    assert [tuple(r) for r in Q.percentiles(d, ["g", "metric"], (0.5,)).collect()] == [("a", "v", 0.5, 3, 5, 5, 1)]
    assert Q.percentiles(Q.digest(df.limit(0), ["g"], ["v"], "i"), ["g"], (0.5,)).count() == 0
