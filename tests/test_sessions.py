import random

import pytest
from tests.families import frame, line
from pyspark.sql import functions as F

from prefixlens.operators import cache as CA
from prefixlens.operators import projection as PJ
from prefixlens.operators import reuse as U
from prefixlens.operators import session as S
from prefixlens.sources import records as R


def user(*texts):
    return [{"role": "user", "content": t} for t in texts]


def events(spark, lines):
    ids = R.identified(R.load_lines(frame(spark, lines)))
    return S.session_events(PJ.sequences(PJ.project(ids))), ids


def test_worked_example(spark):
    a = [line(user(*w), i, "demo-context-refresh", model="demo-model") for i, w in enumerate(["A", "AB", "ABC", "ABCD", "EF", "EFG", "EFGH"])]
    b = [line(user(*w), i, "demo-append-only", model="demo-model") for i, w in enumerate(["P", "PQ", "PQR"])]
    found, ids = events(spark, a + b)
    found = found.cache()
    rows = [(r.event_type, r.lcp_units, r.lcp_bytes, r.previous_pair_lcp_bytes, r.prefix_cut_bytes, r.previous_total_bytes, r.retained_prefix_bytes, r.next_total_bytes, r.recomputed_bytes) for r in found.where("session_key LIKE '%refresh'").orderBy("next_sequence").collect()]
    assert rows == [
        ("append", 3, 19, 0, 0, 1, 1, 36, 17), ("append", 5, 24, 19, 0, 2, 2, 41, 17), ("append", 7, 29, 24, 0, 3, 3, 46, 17), ("reset", 2, 18, 29, 11, 4, 0, 36, 18), ("append", 5, 24, 18, 0, 2, 2, 41, 17), ("append", 7, 29, 24, 0, 3, 3, 46, 17),
    ]
    reports = S.session_reports(found)
    r = {x.session_key: x for x in reports.collect()}["demo-context-refresh"]
    assert (r.request_count, r.append_count, r.reset_count, r.context_refresh_count, r.total_prefix_cut_bytes, r.avg_prefix_cut_bytes, r.total_abandoned_prefix_bytes) == (7, 5, 1, 1, 11, 1, 4)
    total = U.summary(U.by_session(U.event_potential(found, None)), reports).first()
    assert (total.sessions, total.request_pairs, total.lcp_bytes, total.context_bytes, total.composition.new_content_bytes) == (2, 8, 186, 323, 137)
    assert total.ratio == pytest.approx(186 / 323)
    m = CA.cache_metrics(ids).where("session_key LIKE '%refresh'").orderBy("sequence").collect()
    assert [x.payload_bytes for x in m] == [65, 95, 125, 155, 95, 125, 155] and [x.estimated_lcp_bytes for x in m] == [None, 42, 72, 102, 25, 72, 102]
    assert [x.hit_rate for x in m] == pytest.approx([0, 42 / 95, 72 / 125, 102 / 155, 25 / 95, 72 / 125, 102 / 155])
    assert [x.session_key for x in S.ranked_reports(reports).collect()] == ["demo-context-refresh", "demo-append-only"]


def test_kinds_time_order_and_domains(spark):
    lines = [
        line(user("b", "a"), 5, "s"), line(user("a"), 1, "s"), line(user("a", "b"), 3, "s"), line(user("a", "x"), 7, "s", model="model-b"), line(user("q"), 9, "s"), line(user("alone"), 1, "t"), line(user("a"), 1), line(user("q"), 9, "s", tools=[]),
    ]
    found, _ = events(spark, lines)
    rows = found.orderBy("next_sequence").collect()
    assert [r.event_type for r in rows] == ["append", "reorder", "reset", "reset", "reorder"] and {r.session_key for r in rows} == {"s"}
    assert [r.domain_changed for r in rows] == [False, False, True, True, False]
    assert [(r.previous_sequence, r.next_sequence) for r in rows] == [(i, i + 1) for i in range(1, 6)]
    assert S.session_reports(found.limit(0)).count() == 0 and U.summary(U.by_session(U.event_potential(found.limit(0), None)), S.session_reports(found.limit(0))).count() == 0
    fork, _ = events(spark, [line(user("a", "b", "c"), 1, "s"), line(user("a", "z"), 2, "s")])
    r = fork.first()
    assert (r.event_type, r.retained_prefix_bytes, r.abandoned_prefix_bytes, r.prefix_reuse_outlier) == ("fork", 1, 2, True) and r.prefix_reuse_ratio == pytest.approx(1 / 3)


def test_block_runs(spark):
    found, _ = events(spark, [line(user("a"), 1, "s"), line(user("a", "a", "b", "a"), 2, "s"), line([], 3, "s")])
    assert [r.next_block_runs for r in found.orderBy("next_sequence").collect()] == ["ca978112x2/3e23e816x1/ca978112x1", ""]


def test_recovered_run_against_the_plain_scan():
    def plain(old, new, size):
        best = 0
        for start in range(len(new)):
            run = cursor = 0
            for u in new[start:]:
                if cursor < len(old) and u == old[cursor]:
                    run += size[u]
                    cursor += 1
                    best = max(best, run)
                else:
                    run = cursor = 0
        return best

    rnd = random.Random(4)
    for _ in range(300):
        size = {c: rnd.randint(0, 9) for c in "abc"}
        old, new = ([rnd.choice("abc") for _ in range(rnd.randint(0, 7))] for _ in range(2))
        assert S.z_run_bytes(old, new, [size[u] for u in old]) == plain(old, new, size)


def test_reported_metrics(spark):
    use = lambda **u: {"_response_usage": u}
    lines = [line(user("a"), 1, "s", **use(prompt_tokens=1000, cached_tokens=200, completion_tokens=10)), line(user("a"), 2, "s", **use(prompt_tokens=1200, cached_tokens=900, completion_tokens=20, ttft_ms=0)), line(user("a"), 3, "s", **use(prompt_tokens=0)), line(user("a"), 4, "s")]
    ids = R.identified(R.load_lines(frame(spark, lines)))
    m = CA.cache_metrics(ids).orderBy("sequence").collect()
    assert [(x.basis, x.miss_tokens, x.ttft_ms) for x in m] == [("reported", 800, None), ("reported", 300, 0), ("reported", 0, None), ("estimated", None, None)]
    assert [x.hit_rate for x in m] == pytest.approx([0.2, 0.75, 0.0, 1.0]) and m[1].hit_rate_delta == pytest.approx(0.55) and m[0].hit_rate_delta is None
    assert CA.usage_by_session(CA.cache_metrics(ids)).first().hit_rate == pytest.approx(0.5)
    t = CA.metric_totals(CA.cache_metrics(ids)).first()
    assert (t.rows, t.reported, t.estimated) == (4, 3, 1)


def test_common_prefix():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = (bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert CA.common_prefix(a, b) == want


def test_potential(spark):
    found, _ = events(spark, [line(user("a"), 1, "s"), line(user("b" * 100), 2, "s")])
    e = found.first()
    loc = []
    defects = spark.createDataFrame([("d1", 50, [("f", [e.next_request_id], ("x", loc, 1, None))]), ("d2", 9999, [("f", [e.next_request_id], ("x", loc, 1, None))])], "id string, blocked_stable_bytes long, variants array<struct<fingerprint: string, member_request_ids: array<string>, representative: struct<request_id: string, sources: array<string>, utf8_bytes: long, excerpt: string>>>")
    p = U.event_potential(found, U.request_potential(defects))
    got = U.requests_with_gain(p).first()
    assert (got.potential_prefix_bytes, got.blocking_defect_ids, got.gain_bytes) == (e.next_total_bytes, ["d1", "d2"], e.next_total_bytes - e.lcp_bytes)
    assert p.select(F.sum("potential")).first()[0] == e.next_total_bytes
