import json

import pytest
from tests.families import frame, line, system

from prefixlens.operators import projection as PJ
from prefixlens.options import AnalysisOptions, OptionError, ReceiverOptions
from prefixlens.sources import records as R


def skips(spark, lines, **options):
    return {r.record_index: (r.code, dict(r.args)) for r in R.skips(R.load_lines(frame(spark, lines), AnalysisOptions(**options))).collect()}


def rec(**change):
    base = {"captured_at": "2026-01-01T00:00:00Z", "comparison": {"endpoint_key": "e"}, "payload": {"model": "m", "messages": []}}
    return json.dumps({k: v for k, v in {**base, **change}.items() if v is not ...})


def test_validation_chain(spark):
    lines = [
        rec(), "", " \t", "nonsense", "[1]", rec(payload=...), rec(payload=5), rec(comparison=...), rec(comparison=[]), rec(comparison={}), rec(comparison={"endpoint_key": 3}), rec(comparison={"endpoint_key": " "}),
        rec(comparison={"endpoint_key": "e", "agent_key": 7}), rec(comparison={"endpoint_key": "e", "kv_namespace": " "}), rec(session_key="　"), rec(session_key=4), rec(session_key=None), rec(comparison={"endpoint_key": " e ", "agent_key": None}), None,
    ]
    got = skips(spark, lines)
    assert {k: v[0] for k, v in got.items()} == {
        2: "EmptyLine", 3: "EmptyLine", 4: "InvalidJson", 5: "RecordNotObject", 6: "MissingPayload", 7: "PayloadNotObject", 8: "MissingComparison", 9: "MissingComparison", 10: "MissingEndpointKey", 11: "MissingEndpointKey", 12: "EmptyEndpointKey",
        13: "InvalidComparisonKey", 14: "EmptyComparisonKey", 15: "EmptySessionKey", 16: "InvalidSessionKey", 19: "EmptyLine",
    }
    assert got[13][1] == {"field": "agent_key"}
    reasons = {r.record_index: r.reason for r in R.skips(R.load_lines(frame(spark, lines))).collect()}
    assert reasons[14] == "corpus: EmptyComparisonKey { field: kv_namespace }" and reasons[2] == "corpus: EmptyLine"


def test_budgets(spark):
    big = rec(source="x" * 100)
    n = len(big)
    assert skips(spark, [big], max_payload_bytes=n) == {}
    assert skips(spark, [big], max_payload_bytes=n - 1) == {1: ("RecordTooLarge", {"bytes": str(n), "limit": str(n - 1)})}
    lines = [rec(), "bad", rec(source="a"), rec(source="b"), "bad", rec(source="c")]
    assert {k: v[0] for k, v in skips(spark, lines, max_records=2).items()} == {2: "InvalidJson", 4: "RecordBudgetExceeded", 5: "InvalidJson", 6: "RecordBudgetExceeded"}


def test_identity(spark):
    a, b = rec(source="a"), '{"payload": {"messages": [], "model": "m"}, "source": "a", "comparison": {"endpoint_key": "e"}, "captured_at": "2026-01-01T00:00:00Z"}'
    got = R.identified(R.load_lines(frame(spark, [a, rec(), b, a]))).orderBy("input_line").collect()
    ids = [r.request_id for r in got]
    assert [i.rsplit(":")[1] for i in ids] == ["0", "0", "1", "2"] and ids[0][:64] == ids[2][:64] != ids[1][:64]


@pytest.mark.parametrize("usage,want", [
    ({"prompt_tokens": 10, "cached_tokens": 4, "completion_tokens": 2, "ttft_ms": 5, "total_ms": 0}, (10, 4, 2, 5, 0)), ({"input_tokens": 7, "output_tokens": 3}, (7, 0, 3, None, None)), ({"cached_tokens": 3, "ttft_ms": 1}, None),
    ({"prompt_tokens": "7", "input_tokens": 9}, None), ({"prompt_tokens": 7.0}, None), ({"prompt_tokens": -1}, None), ({"prompt_tokens": 2**40}, (4294967295, 0, 0, None, None)), (5, None), ({"prompt_tokens": True}, None),
])
def test_usage(usage, want):
    got = R.usage_of({"_response_usage": usage})
    assert (tuple(got.values()) if got else None) == want


def test_scan_numbers_lines(spark, tmp_path):
    (tmp_path / "a.ndjson").write_bytes(b"one\r\n\ntwo\nthree")
    got = [tuple(r) for r in R.scan_lines(spark, str(tmp_path / "a.ndjson")).orderBy("input_line").collect()]
    assert got == [(1, "one\r"), (2, ""), (3, "two"), (4, "three")]


def project(spark, lines, **options):
    return PJ.project(R.identified(R.load_lines(frame(spark, lines))), AnalysisOptions(**options))


def test_units(spark):
    messages = [
        {"role": "user", "content": "你好🌍", "name": "n"}, {"role": "assistant", "content": None, "tool_calls": [{"function": {"name": "f"}}], "refusal": "no"}, {"role": "tool", "tool_call_id": "c1", "content": ["s", {"type": "t", "input_text": "i"}, {"type": "img", "z": 1, "a": 2}]}, {"content": 1.0},
    ]
    seqs = PJ.sequences(project(spark, [line(messages, tools=[{"name": "x"}, 3])]))
    rows = [(r.kind, r.alignment_key, r.content, r.json_path, r.collection, r.tool_identity, r.ranged) for r in PJ.unit_rows(seqs).orderBy("unit_index").collect()]
    assert rows == [
        ("structural", "tools:start", "tools:start", "$.tools", "tools", None, False), ("tool_definition", "tool-definition", '{"name":"x"}', "$.tools[0]", "tools", "x", False), ("tool_definition", "tool-definition", "3", "$.tools[1]", "tools", None, False),
        ("structural", "tools:end", "tools:end", "$.tools", "tools", None, False), ("structural", "messages:start", "messages:start", "$.messages", "messages", None, False),
        ("role", "message:role", "user", "$.messages[0].role", "messages", None, False), ("visible_text", "message:user:name", "n", "$.messages[0].name", "messages", None, True), ("visible_text", "message:user:content", "你好🌍", "$.messages[0].content", "messages", None, True),
        ("role", "message:role", "assistant", "$.messages[1].role", "messages", None, False), ("visible_text", "message:assistant:content", "null", "$.messages[1].content", "messages", None, False), ("tool_call", "message:assistant:tool_calls", '[{"function":{"name":"f"}}]', "$.messages[1].tool_calls", "messages", None, False),
        ("visible_text", "message:assistant:refusal", "no", "$.messages[1].refusal", "messages", None, True), ("role", "message:role", "tool", "$.messages[2].role", "messages", None, False),
        ("visible_text", "message:tool:content-block:unknown", "s", "$.messages[2].content[0]", "content_blocks", None, True), ("visible_text", "message:tool:content-block:t", "i", "$.messages[2].content[1].input_text", "content_blocks", None, True), ("visible_text", "message:tool:content-block:img", '{"a":2,"type":"img","z":1}', "$.messages[2].content[2]", "content_blocks", None, False),
        ("tool_result", "message:tool:tool_call_id", "c1", "$.messages[2].tool_call_id", "messages", None, False), ("role", "message:role", "unknown", "$.messages[3].role", "messages", None, False), ("visible_text", "message:unknown:content", "1.0", "$.messages[3].content", "messages", None, False),
        ("structural", "messages:end", "messages:end", "$.messages", "messages", None, False),
    ]
    assert PJ.unit_rows(seqs).where("content = '你好🌍'").first().bytes == 10


def test_projection_failures(spark):
    bad = json.loads(line(system("x")))
    lines = []
    for change in ({"model": ""}, {"model": 3}, {"messages": {}}, {"messages": [{}, 5]}):
        lines.append(json.dumps({**bad, "payload": {**bad["payload"], **change}}))
    lines += [json.dumps({**bad, "payload": {"model": "m"}}), json.dumps({k: v for k, v in bad.items() if k != "captured_at"}), json.dumps({**bad, "captured_at": "yesterday"}), line(system("abc")), line(system("ab", "cd"))]
    got = {r.record_index: (r.code, dict(r.args)) for r in PJ.projection_skips(project(spark, lines, max_text_unit_bytes=2, max_projection_units=5)).collect()}
    assert got == {
        1: ("MissingModel", {}), 2: ("MissingModel", {}), 3: ("MessagesNotArray", {}), 4: ("MessageNotObject", {"index": "1"}), 5: ("MissingMessages", {}), 6: ("InvalidComparisonGroup", {"reason": "MissingCapturedAt"}),
        7: ("InvalidComparisonGroup", {"reason": "InvalidCapturedAt"}), 8: ("TextBudgetExceeded", {"path": "$.messages[0].content", "bytes": "3", "limit": "2"}), 9: ("UnitBudgetExceeded", {"limit": "5"}),
    }


def test_options():
    o = AnalysisOptions()
    assert AnalysisOptions.from_json(o.to_json()) == o and o.overridden(top_k=None) == o and o.overridden(top_k=3).top_k == 3
    d = json.loads(o.to_json())
    for k in AnalysisOptions.OPTIONAL:
        d.pop(k)
    assert AnalysisOptions.from_json(json.dumps(d)) == o
    for bad in ({"top_k": 0}, {"min_template_members": 1}, {"stable_span_support_ratio": 1.1}, {"text_similarity_threshold": float("nan")}, {"prefix_view_max_nodes": -1}, {"max_records": True}):
        with pytest.raises(OptionError):
            AnalysisOptions(**bad)
    for text in ("[]", "x", json.dumps({**d, "more": 1}), json.dumps({"top_k": 1})):
        with pytest.raises(OptionError):
            AnalysisOptions.from_json(text)
    assert ReceiverOptions.from_json("{}") == ReceiverOptions() and ReceiverOptions.from_json(ReceiverOptions().to_json()) == ReceiverOptions()
    for bad in ('{"listen": "x"}', '{"max_payload_bytes": 0}', '{"a": 1}'):
        with pytest.raises(OptionError):
            ReceiverOptions.from_json(bad)
