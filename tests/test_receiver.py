import http.client
import json
import os
import stat
import threading

import pytest

from prefixlens.options import ReceiverOptions
from prefixlens.sources.landing import NdjsonAppender, OutputInUse, Poisoned
from prefixlens.sources.receiver import PREFIX, make_server


@pytest.fixture
def server(tmp_path):
    path = tmp_path / "requests.ndjson"
    with NdjsonAppender(path) as appender:
        s = make_server(appender, ReceiverOptions(listen="127.0.0.1:0", max_payload_bytes=200))
        t = threading.Thread(target=s.serve_forever)
        t.start()
        yield s.server_address, path
        s.shutdown()
        t.join()
        s.server_close()


def post(address, body, method="POST", path="/requests", **headers):
    c = http.client.HTTPConnection(*address, timeout=20)
    c.request(method, path, body, {k.replace("_", "-"): v for k, v in headers.items()})
    r = c.getresponse()
    r.read()
    c.close()
    return r.status


def test_requests_land(server):
    address, path = server
    name = (PREFIX + "endpoint-key").replace("-", "_")
    ok = {name: " e "}
    assert post(address, b'{"model": "m", "messages": []}', **ok, **{"x_capture_session_key": "s", "x_capture_source": " raw "}) == 202
    assert post(address, b"[1]", **ok) == 400 and post(address, b"nonsense", **ok) == 400 and post(address, b"\xff", **ok) == 400
    assert post(address, b"{}") == 400 and post(address, b"{}", **{name: "  "}) == 400 and post(address, b"{}", **ok, x_capture_agent_key=" ") == 400
    assert post(address, b'{"a": "' + b"x" * 300 + b'"}', **ok) == 413
    assert post(address, None, "GET") == 405 and post(address, b"{}", path="/other", **ok) == 404
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert len(lines) == 1 and lines[0]["comparison"] == {"endpoint_key": "e"} and lines[0]["session_key"] == "s" and lines[0]["source"] == "raw " and lines[0]["captured_at"].endswith("Z")


def test_concurrent_requests(server):
    address, path = server
    results = []
    work = lambda k: results.extend(post(address, json.dumps({"n": k * 50 + i}), x_capture_endpoint_key="e") for i in range(50))
    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert results == [202] * 200 and sorted(json.loads(x)["payload"]["n"] for x in path.read_text().splitlines()) == list(range(200))


def test_appender(tmp_path):
    path = tmp_path / "a"
    with NdjsonAppender(path) as a:
        assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
        with pytest.raises(OutputInUse):
            NdjsonAppender(path)
        threads = [threading.Thread(target=lambda k=k: [a.append({"k": k, "i": i, "pad": "é" * 500}) for i in range(80)]) for k in range(24)]
        for t in threads:
            t.start()
        assert path.read_text(encoding="utf-8", errors="ignore") is not None
        for t in threads:
            t.join()
    rows = [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines()]
    assert len(rows) == 24 * 80 and {(r["k"], r["i"]) for r in rows} == {(k, i) for k in range(24) for i in range(80)}


def test_a_partial_write_is_taken_back(tmp_path, monkeypatch):
    path = tmp_path / "a"
    with NdjsonAppender(path) as a:
        a.append({"n": 1})

        def half(data):
            os.write(a._fd, data[: len(data) // 2])
            raise OSError("disk full")

        monkeypatch.setattr(a, "_write", half)
        with pytest.raises(OSError, match="disk full"):
            a.append({"n": 2})
        monkeypatch.undo()
        with pytest.raises(Poisoned):
            a.append({"n": 3})
    assert path.read_text() == '{"n":1}\n'
