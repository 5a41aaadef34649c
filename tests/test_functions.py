import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefixlens.functions import canonical as C
from prefixlens.functions import strings as S
from prefixlens.functions import times as T


@pytest.mark.parametrize("text,expected", [
    ("1.0", "1.0"), ("1.50", "1.5"), ("1e-7", "1e-7"), ("1e16", "1e16"), ("1e15", "1000000000000000.0"), ("0.00001", "0.00001"), ("1e-6", "1e-6"), ("-0", "-0.0"), ("18446744073709551615", "18446744073709551615"),
    ("18446744073709551616", "1.8446744073709552e19"), ("-9223372036854775808", "-9223372036854775808"), ("1.5e300", "1.5e300"), ('{"b":1,"a":2,"b":3}', '{"a":2,"b":3}'), ('"\\u00e9\\u0001\\n\\/"', '"é\\u0001\\n/"'), (" [ 1 , null , true ] ", "[1,null,true]"),
])
def test_canonical(text, expected):
    assert C.canonical(C.parse(text)) == expected


@pytest.mark.parametrize("text", ["", "NaN", "[1,]", "{'a':1}", '"\\ud800"', "1e999", "[" * 200 + "]" * 200, "Infinity", '{"a":01}'])
def test_no_json(text):
    with pytest.raises(ValueError):
        C.parse(text)


@given(st.floats(allow_nan=False, allow_infinity=False))
@settings(max_examples=300, deadline=None)
def test_numbers_read_back(v):
    assert float(C.number(v)) == v and math.copysign(1, float(C.number(v))) == math.copysign(1, v)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12))
@settings(max_examples=150, deadline=None)
def test_canonical_round_trip(value):
    text = C.canonical(value)
    assert json.loads(text) == value and C.canonical(C.parse(text)) == text


def test_trim_and_labels(spark):
    df = spark.createDataFrame([("　 a b \t",), ("​",), ("",), (None,), ("\x1c",)], "c string")
    assert [r[0] for r in df.select(S.unicode_trim("c")).collect()] == ["a b", "​", "", None, "\x1c"]
    assert [r[0] for r in df.select(S.clean_key("c")).collect()] == ["a b", "​", None, None, "\x1c"]
    one = spark.createDataFrame([("a\\nb  c d" * 3, 0, 1536, 2 * 1048576)], "s string, a long, b long, c long")
    row = one.select(S.flatten_label("s", 8).alias("f"), S.short_id("s").alias("i"), S.human_bytes("a").alias("a"), S.human_bytes("b").alias("b"), S.human_bytes("c").alias("c"), S.safe_ratio(F.col("c"), F.col("a")).alias("z"), S.short_digest(F.lit("A")).alias("d")).first()
    assert (row.f, row.i, row.a, row.b, row.c, row.z, row.d) == ("a b c da…", "a\\nb  c da\\n…"[:12] + "…", "0 B", "2 KB", "2.0 MB", 0.0, "559aead0")


def test_rfc3339(spark):
    rows = [
        ("1970-01-01T00:00:01Z", 1), ("1970-01-01T01:00:01+01:00", 1), ("1969-12-31T19:00:01.9-05:00", 1), ("1969-12-31T23:59:59Z", -1), ("1970-01-01t00:00:00z", 0), ("2024-02-29T00:00:00Z", 1709164800),
        ("2023-02-29T00:00:00Z", None), ("2023-01-02", None), ("1672900000", None), ("yesterday", None), (None, None), ("", None), ("2023-01-02T24:00:00Z", None), ("2023-01-02T00:00:00", None), ("2023-01-02 00:00:00Z", None),
        ("2023-13-02T00:00:00Z", None), ("2023-01-02T00:00:00.Z", None), (" 2023-01-02T00:00:00Z", None), ("2023-01-02T00:00:00+24:00", None),
    ]
    df = spark.createDataFrame(rows, "c string, want long")
    assert all(r.got == r.want for r in df.select("c", "want", T.rfc3339_seconds("c").alias("got")).collect())
    nanos = spark.createDataFrame([("1970-01-01T00:00:00.123456789Z",), ("1970-01-01T00:00:00.5Z",), ("x",)], "c string").select(T.rfc3339_nanos("c").cast("long").alias("n"))
    assert [r.n for r in nanos.collect()] == [123456789, 500000000, None]
    w = spark.createDataFrame([(-1,), (0,), (3599,), (3600,)], "s long").select(T.window_start(F.col("s"), 3600).alias("w"), T.utc_day(F.col("s")).alias("d"))
    assert [(r.w, r.d) for r in w.collect()] == [(-3600, "1969-12-31"), (0, "1970-01-01"), (0, "1970-01-01"), (3600, "1970-01-01")]


def test_registered_functions(spark):
    from prefixlens.functions.register import register

    assert "canonical_json" in register(spark)
    row = spark.sql("""
        SELECT canonical_json('{"b": 1.50, "a": [1]}') AS c, canonical_json('x') AS n, loose_json('cfg: {"a": 1}') AS l, byte_lcp('né1', 'né2') AS p, fnv1a64('') AS f,
               text_similarity('abcde', 'abcdf') AS s, text_similarity_bottom_k('abcd', NULL) AS z""").first()
    assert (row.c, row.n, row.l.label, row.l.json, row.p, row.f, row.s, row.z) == ('{"a":[1],"b":1.5}', None, "cfg: ", '{"a":1}', 3, 0xCBF29CE484222325 - 2**64, 0.5, None)


def test_pair_metric_from_sql(spark):
    from prefixlens.functions.register import register
    from prefixlens.operators.metric import PairMetric, Profile

    register(spark)
    units = lambda *texts: [{"collection": "messages", "kind": "visible_text", "alignment_key": "k", "tool_identity": None, "content": t} for t in texts]
    rows = [(1, units("the same text", "one text here"), units("the same text", "one text there")), (2, units("a"), None), (3, [], [])]
    df = spark.createDataFrame(rows, "i int, a array<struct<collection:string,kind:string,alignment_key:string,tool_identity:string,content:string>>, b array<struct<collection:string,kind:string,alignment_key:string,tool_identity:string,content:string>>")
    df.createOrReplaceTempView("pairs_of_units")
    got = {r.i: tuple(r.m) for r in spark.sql("SELECT i, pair_metric(a, b) AS m FROM pairs_of_units").collect()}
    assert got[1] == PairMetric()(Profile.of(rows[0][1]), Profile.of(rows[0][2])) and 0.5 < got[1][0] < 1
    assert got[2] == (None, None) and got[3] == PairMetric()(Profile(), Profile())
    assert spark.sql("SELECT heading_anchor('Top 3: Fix this') AS a").first().a == "top-3-fix-this"
