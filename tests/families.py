"""Request families in NDJSON, for the analysis tests."""

import json

TAIL = "This is the stable tail that every request repeats word for word, long enough to matter to anyone."


def line(messages, t=0, session=None, tools=None, model="model-a", endpoint="primary", **extra):
    payload = {"model": model, "messages": messages}
    if tools is not None:
        payload["tools"] = tools
    record = {"captured_at": f"2026-01-01T00:{t // 60:02d}:{t % 60:02d}Z", "comparison": {"endpoint_key": endpoint}, "payload": {**payload, **extra}}
    if session is not None:
        record["session_key"] = session
    return json.dumps(record, ensure_ascii=False)


def system(*texts):
    return [{"role": "system", "content": t} for t in texts]


def tool(name, text="does things in a long and stable way"):
    return {"type": "function", "function": {"name": name, "description": text}}


def frame(spark, lines):
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines, 1)], "input_line long, line string")
