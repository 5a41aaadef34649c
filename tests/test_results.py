"""The result document, its integrity rules, and the reports made from it."""

import copy
import json
import os

import pytest
from tests.families import TAIL, frame, line, system

from prefixlens.cli import analyse as cli_analyse
from prefixlens.cli import report as cli_report
from prefixlens.report import document as D
from prefixlens.report import format as T
from prefixlens.report import locale as L
from prefixlens.report import output, render, tables, view

EVIL = "<script>alert('x')</script> | `code` & more, with *stars*"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("run")
    lines = [line(system(t, EVIL + TAIL), i, session="work-one") for i, t in enumerate(["tenant-alpha", "tenant-bravo", "tenant-charlie"])]
    lines += [line(system("tenant-delta", EVIL + TAIL), 9, session="work-two", _response_usage={"prompt_tokens": 10, "cached_tokens": 5}), line(system("tenant-delta", EVIL + TAIL, "more"), 10, session="work-two", _response_usage={"prompt_tokens": 10, "cached_tokens": 9}), "broken"]
    (folder / "requests.ndjson").write_text("\n".join(lines) + "\n", encoding="utf-8")
    cli_analyse.main(["--input", str(folder / "requests.ndjson"), "--output", str(folder / "analysis.json"), "--top-k", "7"])
    return folder


@pytest.fixture(scope="module")
def document(files):
    return D.read_document(files / "analysis.json")


def test_document(spark, files, document):
    D.check_document(spark, document)
    run = document["run"]
    assert (run["input_records"], run["analyzed_records"], run["options"]["top_k"]) == (5, 5, 7) and run["skipped_records"][0]["record_index"] == 6
    assert document["defects"] and document["top_k"] == [d["id"] for d in document["defects"]][:7]
    reuse = document["prefix_reuse"]
    c = reuse["composition"]
    assert c["reusable_bytes"] + c["recoverable_bytes"] + c["new_content_bytes"] == c["context_bytes"] == sum(s["context_bytes"] for s in reuse["by_session"])
    assert oct(os.stat(files / "analysis.json").st_mode & 0o777) == "0o600"


def _cohesion(d):
    d["templates"][0]["cohesion"] = 1.5


def _medoid(d):
    d["templates"][0]["medoid_request_id"] = "nobody"


def _twice(d):
    d["templates"].append(d["templates"][0])


def _stranger(d):
    d["defects"][0]["mismatch"]["variants"][0]["member_request_ids"] = ["stranger"]
    d["defects"][0]["mismatch"]["variants"][0]["representative"]["request_id"] = "stranger"


def _one_variant(d):
    d["defects"][0]["mismatch"]["variants"] = d["defects"][0]["mismatch"]["variants"][:1]


def _top(d):
    d["top_k"] = ["defect-unknown"]


def _cycle(d):
    d["templates"][0]["prefix_view"]["nodes"][-1]["sequence_child"] = "seq-0"


def _dangling(d):
    d["templates"][0]["prefix_view"]["nodes"][-1]["sequence_child"] = "seq-999"


def _bytes(d):
    d["session_reports"][0]["events"][0]["retained_prefix_bytes"] += 1


def _count(d):
    d["session_reports"][0]["request_count"] += 1


def _blocked(d):
    d["defects"][0]["blocked_stable_bytes"] = d["defects"][0]["score"]["blocked_stable_bytes"] = 10**9


def _group(d):
    d["templates"][0]["comparison_group"]["model"] = ""


def _source(d):
    del d["defects"][0]["recovered_stable"]["sources"][0]["byte_end"]


@pytest.mark.parametrize("change", [_cohesion, _medoid, _twice, _stranger, _one_variant, _top, _cycle, _dangling, _bytes, _count, _blocked, _group, _source])
def test_contradictions_are_found(spark, document, change):
    changed = copy.deepcopy(document)
    change(changed)
    with pytest.raises(D.DocumentError):
        D.check_document(spark, changed)


def test_strict_reading(files, tmp_path, document):
    raw = json.loads((files / "analysis.json").read_text())
    for change in (lambda d: d.update(extra=1), lambda d: d.pop("top_k"), lambda d: d["run"].update(schema_version="9"), lambda d: d["run"]["options"].update(x=1), lambda d: d["templates"][0].update(x=1), lambda d: d["defects"][0]["score"].update(confidence=0.5), lambda d: d["templates"][0]["prefix_view"].update(node_count=0)):
        bad = copy.deepcopy(raw)
        change(bad)
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(D.DocumentError):
            D.read_document(tmp_path / "bad.json")
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(D.DocumentError):
        D.read_document(tmp_path / "bad.json")


def test_older_files_fall_back(spark, document):
    old = copy.deepcopy(document)
    for r in old["session_reports"]:
        r["modern"], r["context_refresh_count"], r["total_abandoned_prefix_bytes"], r["fork_count"], r["total_prefix_cut_bytes"] = False, 0, 0, 1, 12
        for e in r["events"]:
            e.update(D.LATE_EVENT_FIELDS)
    D.check_document(spark, old)
    rows = {r.session_key: r for r in tables.sessions(D.relations(spark, old)).collect()}
    first = rows["work-one"]
    assert first.refreshes == first.fork_count + first.reorder_count + first.reset_count > 0 and first.abandoned_bytes == 12


def test_reports(spark, files, tmp_path):
    cli_report.main(["--input", str(files / "analysis.json"), "--output", str(tmp_path / "out.HTML")])
    html, md = (tmp_path / "out.html").read_text(encoding="utf-8"), (tmp_path / "out.md").read_text(encoding="utf-8")
    assert "<script" not in html and "&lt;script&gt;" in html and "work-one" in html and "Fix these first" in html
    assert "\n<script" not in md and "## Fix these first" in md
    before = html
    cli_report.main(["--input", str(files / "analysis.json"), "--output", str(tmp_path / "again.html"), "--format", "html"])
    assert (tmp_path / "again.html").read_text(encoding="utf-8") == before
    output.write_reports(spark, files / "analysis.json", tmp_path / "zh", "markdown", L.Locale("zh-CN"))
    assert "优先修复" in (tmp_path / "zh").read_text(encoding="utf-8")
    os.link(files / "analysis.json", tmp_path / "link.html")
    for target in (files / "analysis.json", tmp_path / "link.html"):
        with pytest.raises(D.DocumentError):
            output.write_reports(spark, files / "analysis.json", target, "html")
    with pytest.raises(SystemExit):
        cli_report.main(["--input", "a", "--output", "b", "--format", "pdf"])


def test_queries_of_the_report(spark, document):
    r = D.relations(spark, document)
    assert [x["rank"] for x in tables.top_table(r).collect()] == list(range(1, len(document["top_k"]) + 1))
    broken = {**r, "top_k": spark.createDataFrame([(1, "gone")], "rank int, defect_id string")}
    with pytest.raises(Exception, match="top entry without defect"):
        tables.top_table(broken).collect()
    by = spark.createDataFrame([(s["session_key"], float(s["ratio"])) for s in document["prefix_reuse"]["by_session"]], "session_key string, ratio double")
    assert [(x.session_key, x.real_ratio) for x in tables.cross_check(by, r["cache_metrics"]).collect()] == [("work-two", 0.7)]
    assert tables.common_key_prefix(r["session_reports"], "session_key").first()[0] == "work-"
    assert tables.common_key_prefix(r["session_reports"].limit(0), "session_key").first()[0] == ""
    groups = [(x.session_key, x.group) for x in tables.cache_table(r["cache_metrics"]).collect()]
    assert sorted(set(groups)) == [("work-one", 1), ("work-two", 2)]
    totals = {t.template_id: t for t in tables.template_totals(r["prefix_nodes"]).collect()}
    assert all(t.first_divergence == 2 for t in totals.values()) and tables.decay(r["prefix_nodes"]).where("share > 1").count() == 0
    assert tables.run_summary(r, 5, 5, 1).first().defects == len(document["defects"]) and tables.defect_details(r).where("variant = 1").count() == len(document["defects"])
    assert tables.dropped_members(r).where("size(dropped) > 0").count() == 0
    for ratio, potential, verdict in ((0.95, 0.95, "above"), (0.5, 0.9, "reachable"), (0.5, 0.6, "below")):
        assert tables.reuse_gauge(spark.createDataFrame([(ratio, potential, 1)], "ratio double, potential_ratio double, gain_bytes long")).first().verdict == verdict


def test_chain_guard():
    with pytest.raises(ValueError, match="comes back"):
        view.chain_nodes([{"id": "seq-0", "sequence_child": "seq-1"}, {"id": "seq-1", "sequence_child": "seq-0"}])
    with pytest.raises(ValueError, match="missing"):
        view.chain_nodes([{"id": "seq-0", "sequence_child": "seq-1"}])


def test_formats_and_locales():
    assert [T.human_bytes(n) for n in (0, 1023, 1024, 1048575, 1048576)] == ["0 B", "1023 B", "1 KB", "1024 KB", "1.0 MB"]
    assert T.inline("a|b*c_`d`\n# e") == "a\\|b\\*c\\_\\`d\\` \\# e" and T.code("a`b") == "``a`b``" and T.fenced("```") == "````\n```\n````" and T.table_code("a|b") == "`a\\|b`"
    assert T.anchor("Top 3: Fix—this, now!") == "top-3-fixthis-now" and T.session_label("work-one", "work-") == "one" and len(T.session_label("x" * 80)) == 21 and T.common_prefix(["abc", "abd"]) == "ab"
    assert T.named("{a} and {{b}}", a=1) == "1 and {b}" and T.named("{v}", v="{x}") == "{x}"
    for bad, values in (("{a}", {}), ("x", {"a": 1}), ("{", {}), ("}", {}), ("{a b}", {"a": 1})):
        with pytest.raises(ValueError):
            T.named(bad, **values)
    L.check_catalogs()
    assert L.parse("ZH_cn") == "zh-CN"
    with pytest.raises(ValueError):
        L.parse("xx")
    L.set_locale("zh-CN")
    held = L.current()
    L.set_locale("en-US")
    assert held.code == "zh-CN" and L.current()("title") == "Prefix reuse report"


def test_empty_sections_disappear(spark, tmp_path):
    from prefixlens.plans.pipeline import analyse_loaded
    from prefixlens.sources import records as R

    d = D.to_document(analyse_loaded(R.load_lines(frame(spark, [line(system("x"), 1)]))))
    D.write_document(tmp_path / "a.json", d)
    v = view.build(spark, D.read_document(tmp_path / "a.json"))
    text = render.markdown(v, L.Locale("en-US"))
    assert "No defect found" in text and "## Sessions" not in text and "## Structural reuse" not in text and "## Template chains" not in text
