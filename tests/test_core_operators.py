import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from prefixlens.operators import flatten as FL
from prefixlens.operators.ordering import row_numbers, running_sums, with_neighbours, with_previous
from prefixlens.operators.weighted import heavy_keys, weighted_stats


def test_row_numbers_match_a_window(spark):
    rnd = random.Random(1)
    rows = [(None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 5)}", None if rnd.random() < 0.1 else rnd.randint(0, 50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i long")
    got = {r.i: r.n for r in row_numbers(df.repartition(5), ["k"], ["t", "i"], "n").collect()}
    want = {}
    for _, group in _grouped(rows).items():
        for n, r in enumerate(sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[2])), 1):
            want[r[2]] = n
    assert got == want
    prev = {r.i: r.prev_i for r in with_previous(row_numbers(df, ["k"], ["t", "i"], "n"), ["k"], "n", ["i"]).collect()}
    back = {(r[0], want[r[2]]): r[2] for r in rows}
    assert prev == {r[2]: back.get((r[0], want[r[2]] - 1)) for r in rows}
    assert row_numbers(df.limit(0), ["k"], ["t"], "n").count() == 0
    assert sorted(r.n for r in row_numbers(df, [], ["i"], "n").collect()) == list(range(1, 601))


def _grouped(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_flatten_list_keeps_parents(spark):
    df = spark.createDataFrame([(1, [{"a": 1, "b": ["x", "y"]}, None, {"a": None, "b": []}], "extra"), (2, [], "e"), (3, None, "e"), (None, [{"a": 9, "b": None}], "e"), (1, [{"a": 1, "b": ["x", "y"]}], None)], "id int, items array<struct<a: int, b: array<string>>>, other string")
    got = FL.flatten_list(df, "items", ["id"])
    assert got.columns == ["id", "element_index", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 0, 1, ["x", "y"]), (1, 1, None, None), (1, 2, None, []), (None, 0, 9, None), (1, 0, 1, ["x", "y"])], key=str)
    deeper = FL.flatten_list(got, "b", ["id", "element_index"], index="b_index", element="b")
    assert sorted(map(tuple, deeper.where("id = 1").collect())) == [(1, 0, 0, "x"), (1, 0, 0, "x"), (1, 0, 1, "y"), (1, 0, 1, "y")]
    clash = spark.createDataFrame([(1, [{"id": 5}])], "id int, items array<struct<id: int>>")
    assert FL.flatten_list(clash, "items", ["id"]).columns == ["id", "element_index", "element_id"]
    assert FL.flatten_list(df.limit(0), "items", ["id"]).count() == 0
    with pytest.raises(TypeError):
        FL.flatten_list(df, "id", [])


PAYLOADS = [
    (1, json.dumps({"model": "m", "messages": [{"role": "user", "content": "hi"}, {"content": ["a", {"type": "text", "text": "b"}, {"input_text": "c"}, {"type": "image"}, 7]}, {"role": 5, "content": None}], "tools": [{"type": "function", "function": {"name": "f"}}, "bare", {"name": "n"}]})),
    (2, '{"messages": []}'), (3, '{"messages": [1]}'), (4, '{"messages": {}}'), (5, "[]"), (6, "nonsense"), (7, None), (8, ""), (9, '{"messages": [{"content": "\\ud800x"}], "tools": {}}'), (10, '{"messages": [{}], "messages": [{}, {}]}'), (11, '{"messages": [{"a": NaN}]}'),
]


def test_flatten_payloads(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAYLOADS], "input_line long, payload string, section string")
    rows = FL.flatten_payloads(df)
    keys = sorted(tuple(r)[:4] for r in rows.collect())
    assert keys == sorted(tuple(r) for r in FL.flatten_payloads(df, full=False).collect())
    assert keys == sorted([(1, "message", 0, -1), (1, "message", 1, -1), (1, "message", 2, -1), *[(1, "block", 1, j) for j in range(5)], *[(1, "tool", i, -1) for i in range(3)], (9, "message", 0, -1), (10, "message", 0, -1), (10, "message", 1, -1)])
    assert [tuple(r)[1:] for r in FL.messages_table(rows).where("input_line = 1").orderBy("message_index").collect()] == [(0, "user", "string", "hi"), (1, None, "array", None), (2, None, "null", None)]
    assert [r.text for r in FL.blocks_table(rows).orderBy("block_index").collect()] == ["a", "b", "c", None, None]
    assert [tuple(r)[1:] for r in FL.tools_table(rows).orderBy("tool_index").collect()] == [(0, "object", "function", "f"), (1, "string", None, None), (2, "object", None, "n")]
    assert FL.messages_table(rows).where("input_line = 9").first().content == "?x"
    assert FL.messages_table(rows).where("input_line = 10").first().content_kind == "absent"
    assert FL.flatten_payloads(df.limit(0)).count() == 0


def test_weighted_stats_against_brute_force(spark):
    rnd = random.Random(2)
    pool = [None, 0, 0, 1, -5, 7, 7, 2**62, -(2**63), 123456]
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.choice(["x", None]), rnd.choice(pool) if rnd.random() < 0.5 else rnd.randint(-3000, 3000)) for _ in range(800)] + [("empty", "x", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, k1 string, val long, w string")
    got = {(r["k"], r["k1"]): tuple(r)[2:] for r in weighted_stats(df, ["k", "k1"], "val", (0.5, 0.95, 1.0)).collect()}
    groups = collections.defaultdict(list)
    for k, k1, v in rows:
        groups[k, k1].append(v)
    for key, vs in groups.items():
        have = sorted(v for v in vs if v is not None)
        count = collections.Counter(have)
        mode = min(count, key=lambda v: (-count[v], v), default=None)
        at = lambda q: have[max(-(-len(have) * q // 100), 1) - 1] if have else None
        assert got[key] == (len(vs), len(have), len(count), mode, count[mode] if have else None, at(50), at(95), at(100)), key
    assert len(got) == len(groups)
    assert weighted_stats(df.limit(0), ["k"], "val").count() == 0
    with pytest.raises(TypeError):
        weighted_stats(df, ["k"], "k1")


def test_heavy_keys(spark):
    df = spark.createDataFrame([("a", "x")] * 50 + [("b", None)] * 48 + [("c", "y")] * 2, "e string, a string")
    assert [tuple(r) for r in heavy_keys(df, ["e", "a"], 0.02).orderBy("e").collect()] == [("a", "x", 50, 100), ("c", "y", 2, 100)]
    assert heavy_keys(df, ["e", "a"], 0.021).count() == 1
    assert heavy_keys(df.limit(0), ["e", "a"], 0.02).count() == 0
    assert heavy_keys(df.withColumn("k0", F.lit(1)), ["e"], 0.5).first().e == "a"


def test_written_tables(spark, tmp_path):
    from prefixlens.sources import tables as TB

    df = spark.range(10).selectExpr("id", "id * 2 AS b")
    back = TB.written(df, "case")
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert TB.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
    path = TB._written[-1]
    held, TB._written[:] = TB._written[:-1], [path]
    import os

    assert os.path.isdir(path) and TB.drop_written(spark) == 1 and not os.path.exists(path)
    TB._written[:] = held
    assert TB.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_long_numbers_and_deep_values_are_json():
    from prefixlens.sources import payload as P

    long = '{"messages":[{"role":"user","content":"a]"}],"x":%s}'
    for value in ("9" * 5000, "-" + "9" * 5000, "[" * 100_000 + "]" * 100_000, '{"k":[' * 50_000 + '"]}\\""' + "]}" * 50_000):
        assert P.sound(long % value)["messages"][0]["content"] == "a]"
    for broken in ("[" * 100_000 + "]" * 99_999, "[" * 100_000 + "1," + "]" * 100_000, "[" * 100_000 + "}" + "]" * 99_999):
        assert P.sound(long % broken) is None


def test_running_sums_match_plain_ones(spark):
    rnd = random.Random(2)
    rows = [(None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 5)}", rnd.randint(0, 20), i, rnd.randint(0, 9)) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, t int, i long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.i: r.s for r in running_sums(df.repartition(5), ["k"], ["t", "i"], "v", "s").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, sums = {}, collections.Counter()
    for k, t, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        sums[k] += v
        want[i] = sums[k]
    assert got == want
    assert running_sums(df.limit(0), ["k"], ["t", "i"], "v", "s").count() == 0


def test_percentiles_of_values_far_apart(spark):
    rnd = random.Random(4)
    near = [2**62 + rnd.randint(0, 2**50) for _ in range(300)] + [-(2**63), -(2**63) + 1, 2**63 - 1, 0, -1]
    rows = [("wide", v) for v in near] + [("one", 7)] * 5 + [(None, -(2**40) - i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v long")
    qs = (0.001, 0.01, 0.25, 0.5, 0.99, 1.0)
    got = {r["k"]: r for r in weighted_stats(df, ["k"], "v", qs).collect()}
    for k in ("wide", "one", None):
        vs = sorted(v for x, v in rows if x == k)
        for q, name in zip(qs, ("p0_1", "p1", "p25", "p50", "p99", "p100")):
            assert got[k][name] == vs[max(-(-int(round(q * 1000)) * len(vs) // 1000), 1) - 1]


def test_neighbours_over_partition_borders(spark):
    rnd = random.Random(5)
    rows = [(None if rnd.random() < 0.1 else "hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 5)}", i, [f"x{i}"] * (i % 3)) for i in rnd.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "k string, i long, xs array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = {r.i: (r.prev_i, r.prev_xs, r.n) for r in with_neighbours(df.repartition(5), ["k"], ["i"], "n", lambda p: p.select("k", "i", "prev_i", "prev_xs", "_place")).collect()}
        empty = with_neighbours(df.limit(0), ["k"], ["i"], "n", lambda p: p.select("k", "prev_i", "_place")).count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for group in _grouped(rows).values():
        ordered = sorted(group, key=lambda r: r[1])
        for n, r in enumerate(ordered, 1):
            want[r[1]] = (*(ordered[n - 2][1:] if n > 1 else (None, None)), n)
    assert got == want and empty == 0
