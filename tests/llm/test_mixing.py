import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefixlens.llm import mixing as M

needs_vocabulary = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no tokenizer files")


def docs(spark, sizes, seed=1):
    rnd = random.Random(seed)
    rows, i = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            i += 1
            rows.append((i, source, rnd.choice(["en", "en", "de", None]), rnd.choice(["t1", "t2", None]), rnd.randint(1, 200)))
    return spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, tokens long")


TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("Tiny Source", 0.2, 4)]


def test_shares_and_caps(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    d = docs(spark, {"BIG": 3000, " small ": 600, "tiny-source": 300, "other": 50})
    mixed = M.mix(d, targets)
    got = {r.source: r for r in M.shares(mixed, targets).collect()}
    assert set(got) == {"big", "small", "tiny_source"}
    for r in got.values():
        assert r.most_copies <= r.max_repeats
    total = sum(r.tokens for r in got.values())
    assert all(abs(r.tokens - r.target_share * total) <= 200 * 2 for r in got.values())  # a document each
    assert mixed.groupBy("doc_id").count().where("count > 1").count() == 0
    again = {(r.doc_id, r.copies) for r in M.mix(d.repartition(7), targets).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed.collect()}
    # twice the reachable total: the scarce sources are used up, the rest is reported as it is
    have = {r.source: r.t for r in d.withColumn("source", M.source_name(F.col("source"))).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = 2 * min(have["big"] * 1 / 0.5, have["small"] * 4 / 0.3, have["tiny_source"] * 4 / 0.2)
    short = {r.source: r for r in M.shares(M.mix(d, targets, total), targets).collect()}
    assert all(r.most_copies <= r.max_repeats for r in short.values())
    assert abs(sum(r.tokens for r in short.values()) - sum(min(t[1] * total, have[s] * t[2]) for s, t in zip(("big", "small", "tiny_source"), TARGETS))) < 0.01 * total


def test_marginals_are_kept(spark):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats long")
    d = docs(spark, {"big": 4000, "small": 2000, "tiny source": 2000})
    mixed = M.mix(d, targets, 100_000.0)
    share = lambda rows: {r.language: r.t for r in rows.groupBy("language").agg(F.sum("t").alias("t")).collect()}
    before = share(d.select("language", F.col("tokens").alias("t")))
    after = share(mixed.join(d.select("doc_id", "language"), "doc_id").select("language", (F.col("tokens") * F.col("copies")).alias("t")))
    for k in before:
        assert abs(before[k] / sum(before.values()) - after[k] / sum(after.values())) < 0.02
    assert abs(sum(after.values()) - 100_000) < 1500


def many_topics(spark):
    """200 topics of equal size, the even ones mostly in one source, the odd ones in the other."""
    rnd = random.Random(3)
    rows = [(i, "big" if (rnd.random() < 0.8) == (i % 2 == 0) else "small", None, f"t{i % 200}", rnd.randint(50, 100)) for i in range(12_000)]
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 2)], "source string, target_share double, max_repeats long")
    return spark.createDataFrame(rows, "doc_id long, source string, language string, topic string, tokens long"), targets


def test_small_topics_keep_their_share(spark):
    d, targets = many_topics(spark)
    got = M.mix(d, targets, 400_000.0).groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()
    share = {r.odd: r.t / sum(x.t for x in got) for r in got}
    assert abs(share[0] - d.where("doc_id % 2 = 0").agg(F.sum("tokens")).first()[0] / d.agg(F.sum("tokens")).first()[0]) < 0.01


def test_raking_tables_equals_raking_arrays(spark):
    d, _ = many_topics(spark)
    cells = d.withColumn("language", F.concat(F.lit("l"), F.col("doc_id") % 7)).where("doc_id < 300").groupBy("source", "language", "topic").agg(F.sum("tokens").alias("tokens"))
    local = cells.orderBy("source", "language", "topic").toPandas()
    codes = np.column_stack([local[c].astype("category").cat.codes.to_numpy().astype(int) for c in ("source", "language", "topic")])
    total = float(local["tokens"].sum())
    want = M.rake(codes, local["tokens"].to_numpy(dtype=float), {0: 0.7, 1: 0.3}, {0: 1.5, 1: 1.3}, total, rounds=3)
    got = M.rake_table(cells, {"big": 0.7, "small": 0.3}, {"big": 1.5, "small": 1.3}, total, rounds=3).orderBy("source", "language", "topic").toPandas()
    assert np.allclose(got["weight"], want) and (want >= 1.5 - 1e-12).any()


def test_edges(spark):
    targets = spark.createDataFrame(TARGETS + [("absent", 0.0, 1)], "source string, target_share double, max_repeats long")
    d = docs(spark, {"big": 20})
    got = {r.source: (r.tokens, r.documents) for r in M.shares(M.mix(d, targets), targets).collect()}
    assert got["small"] == (0, 0) and got["absent"] == (0, 0) and got["big"][1] > 0
    assert M.mix(d.limit(0), targets).count() == 0
    assert M.shares(M.mix(d.limit(0), targets), targets).count() == 4


def test_rake_meets_sources_under_caps():
    cells = np.array([[s, l, t] for s in range(3) for l in range(4) for t in range(2)])
    tokens = np.random.default_rng(1).integers(10, 1000, len(cells)).astype(float)
    w = M.rake(cells, tokens, {0: 0.5, 1: 0.25, 2: 0.25}, {0: 2.0, 1: 4.0, 2: 4.0}, tokens.sum() * 0.5)
    got = np.bincount(cells[:, 0], w * tokens)
    assert np.allclose(got / got.sum(), [0.5, 0.25, 0.25], atol=1e-6) and (w <= np.array([2, 4, 4])[cells[:, 0]] + 1e-12).all()


@needs_vocabulary
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world, hello!"), (2, ""), (3, None), (4, "<|endoftext|> ü漢")], "tokens long, text string")
    got = {r.tokens: r.n for r in M.count_tokens(df, out="n").collect()}
    e = M.encoder(M.VOCABULARY)
    assert got == {1: len(e.encode_ordinary("Hello world, hello!")), 2: 0, 3: 0, 4: len(e.encode_ordinary("<|endoftext|> ü漢"))}
    assert e.decode(e.encode_ordinary("It's 42\n\n  ok ü")) == "It's 42\n\n  ok ü"


def test_language_forms_are_one_value(spark):
    from prefixlens.llm.language import language_code

    labels = ["de", "DEU", " ger ", "de-AT", "zh_Hans", "chi", "und", "xx", "", None, "unknown", "mul", "tlh", "en\tGB"]
    got = [r.c for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i long, l string").select("i", language_code(F.col("l")).alias("c")).orderBy("i").collect()]
    assert got == ["de", "de", "de", "de", "zh", "zh", None, None, None, None, None, None, "tlh", "en"]
