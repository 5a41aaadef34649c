"""Cohorts to defects: kernels against plain versions, and the request families end to end."""

import itertools
import json
import random

import numpy as np
import pytest
from tests.families import TAIL, frame, line, system, tool

from prefixlens.operators import align as A
from prefixlens.operators import cohort as CO
from prefixlens.operators import diagnose as D
from prefixlens.operators import metric as M
from prefixlens.operators import rank
from prefixlens.operators.template import _stable_runs
from prefixlens.operators.validate import violations
from prefixlens.options import AnalysisOptions
from prefixlens.plans.pipeline import NothingToAnalyse, analyse_loaded
from prefixlens.sources import records as R


def analyse(spark, lines, **options):
    o = AnalysisOptions(**options)
    return analyse_loaded(R.load_lines(frame(spark, lines), o), o)


def found(a):
    return [(r.pattern, [f.kind for f in r.facts], r.comparable_count, r.affected_count, r.blocked_stable_bytes) for r in a.defects.collect()]


def sound(a):
    relations = {k: getattr(a, k) for k in ("templates", "defects", "top_k", "prefix_nodes", "session_events", "session_reports")}
    return [tuple(r) for r in violations(relations, a.options.top_k).collect()]


# Kernels


def test_lcs_match_is_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc你") for _ in range(rnd.choice([0, 1, 5, 20, 130]))) for _ in range(2))
        m = A.lcs_match(a, b)
        pairs = [(i, j) for i, j in enumerate(m) if j >= 0]
        assert all(a[i] == b[j] for i, j in pairs) and all(x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert len(pairs) == table[-1, -1]


def test_unit_alignment():
    k = lambda *xs: [((x[0],), x) for x in xs]
    assert A.align_units(k("a1", "b1", "c1"), k("a1", "x", "b2", "c1")) == [0, 2, 3]
    assert A.align_units(k("a1", "b1"), k("b1")) == [None, 0] and A.align_units([], k("a")) == [] and A.align_units(k("a"), []) == [None]
    assert A.align_units(k("a1", "a2"), k("a2")) == [None, 0]
    c = A.Cells(4, 10)
    c.check(4, "unit")
    with pytest.raises(A.BudgetError):
        c.check(5, "unit")
    c.charge(10)
    with pytest.raises(A.BudgetError):
        c.charge(1)


def test_stable_runs_against_the_plain_walk():
    def plain(maps, weights, text, total, o):
        ok = lambda s: s >= o.min_stable_support and s / total + 1e-15 >= o.stable_span_support_ratio
        out, pos = [], 0
        while pos < len(text):
            alive = [i for i in range(len(maps)) if maps[i][pos] >= 0]
            if not ok(sum(weights[i] for i in alive)):
                pos += 1
                continue
            end = pos + 1
            while end < len(text):
                nxt = [i for i in alive if maps[i][end] >= 0 and maps[i][end] == maps[i][end - 1] + 1]
                if not ok(sum(weights[i] for i in nxt)):
                    break
                alive, end = nxt, end + 1
            if end - pos >= o.min_exact_anchor_bytes:
                out.append((pos, end, sum(weights[i] for i in alive)))
                pos = end
            else:
                pos += 1
        return out

    rnd = random.Random(3)
    for _ in range(200):
        text = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 25)))
        others = ["".join(c for c in text if rnd.random() < 0.9) for _ in range(rnd.randint(1, 5))]
        maps = np.array([A.lcs_match(text, t) for t in others])
        weights = np.array([rnd.randint(1, 3) for _ in others])
        total = int(weights.sum()) + rnd.randint(0, 1)
        o = AnalysisOptions(min_exact_anchor_bytes=rnd.randint(1, 6), min_stable_support=2, stable_span_support_ratio=rnd.choice([0.5, 0.8]))
        assert _stable_runs(maps, weights, text, total, o) == plain(maps.tolist(), weights.tolist(), text, total, o)


def unit(content, key="k", kind="visible_text", tool=None):
    return {"collection": "messages", "kind": kind, "alignment_key": key, "tool_identity": tool, "content": content, "fp": key + content, "role": None}


def test_pair_metric():
    m = M.PairMetric()
    p = lambda *us: M.Profile.of(list(us))
    assert m(p(unit("abc")), p(unit("abc"))) == (1.0, 0.0)
    assert m(p(unit("")), p(unit("xyz"))) == (0.25, 1.0)
    a, b = p(unit("abcdef", tool="t"), unit("x")), p(unit("abcdeg", tool="t"), unit("y", tool="u"))
    assert m(a, b) == m(b, a) and 0 < m(a, b)[0] < 1
    assert m.dice("abcd", "abce") == 0.0 and m.dice("abcde", "abcdf") == 0.5 and m.dice("ab", "bc") == 0.5
    # an insertion near the head of a long text: the sampler that keeps the smallest hashes hardly notices
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4000))
    moved = text[:5] + "INSERTED WORDS" + text[5:]
    assert M.PairMetric("bottom_k").dice(text, moved) > 0.9
    h = M.fnv_shingles(text.encode())
    head = sorted(h[:256].tolist())
    heap = list(head)
    for x in h[256:].tolist():
        if x < min(heap):
            heap.remove(min(heap))
            heap.append(x)
    assert M.sampled(text.encode()).tolist() == sorted(heap)


def test_discovery_thresholds_and_budget():
    o = AnalysisOptions()
    texts = {0: TAIL, 1: TAIL + " more", 2: "something else entirely, with nothing in common at all", 3: TAIL + "!"}
    profiles = [M.Profile.of([unit(texts[i])]) for i in range(4)]
    cohorts, left = CO.discover([("a", 0), ("b", 1), ("c", 2), ("d", 3), ("e", 0)], profiles, o)
    assert left == 0 and [c["members"] for c in cohorts] == [["a", "b", "d", "e"]] and cohorts[0]["medoid"] == "a"
    apart = [M.Profile.of([unit(f"{c}" * 50)]) for c in "abcdefgh"]
    cohorts, left = CO.discover([(c, i) for i, c in enumerate("abcdefgh")], apart, AnalysisOptions(max_candidates_per_request=3))
    assert cohorts == [] and left == 5
    assert CO.choose_validators([(str(i), i) for i in range(20)], {i: (i / 20, 0.0) for i in range(20)}) == [0, 1, 2, 3, 4, 9, 14, 19]


def test_large_domains_take_the_distributed_rounds(spark):
    rnd = random.Random(6)
    lines = [line(system(f"tenant-{rnd.randint(0, 10**9)}", TAIL if i % 3 else TAIL[::-1]), i % 50) for i in range(40)] + [line(system("alone " * 5), 1)]
    from prefixlens.operators import projection as PJ

    seqs = PJ.sequences(PJ.project(R.identified(R.load_lines(frame(spark, lines)))))
    near = sorted(tuple(r) for r in CO.find_cohorts(seqs).where("cohort_id IS NOT NULL").select("cohort_id", "medoid_request_id", "request_id").collect())
    far = CO.find_cohorts(seqs, task_variants=0)
    assert sorted(tuple(r) for r in far.where("cohort_id IS NOT NULL").select("cohort_id", "medoid_request_id", "request_id").collect()) == near and len({r[0] for r in near}) == 2


def test_large_domains_take_few_passes(spark, monkeypatch):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    lines = [line(system(TAIL[: rnd.randint(50, 90)], word()), i % 50) for i in range(12)] + [line(system(" ".join(word() for _ in range(15))), i) for i in range(30)]
    from prefixlens.operators import projection as PJ

    o = AnalysisOptions(max_candidates_per_request=8)
    seqs = PJ.sequences(PJ.project(R.identified(R.load_lines(frame(spark, lines)))))
    passes, kept = [], CO.written
    monkeypatch.setattr(CO, "written", lambda df, label: passes.append(label) or kept(df, label))
    rows = lambda **x: sorted(map(repr, CO.find_cohorts(seqs, o, **x).collect()))
    near = rows()
    passes.clear()
    assert rows(task_variants=0) == near and "skip_members=None" in near[0]
    assert len(passes) < 25
    # many accepted variants: a pass per round
    assert rows(task_variants=0, linked_variants=0) == near


def test_bounds_leave_no_accepted_pair_out():
    rnd = random.Random(8)
    o, words = AnalysisOptions(), ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 4, 30, 90])))
    bases = [[unit(text(), key=rnd.choice("kl"), tool=rnd.choice([None, "t", "u"])) for _ in range(rnd.randint(1, 6))] for _ in range(12)]
    profiles = []
    for _ in range(90):
        units = [u if rnd.random() < 0.8 else {**u, "content": rnd.choice([u["content"] + " " + text(), text(), u["content"][3:]])} for u in rnd.choice(bases)]
        profiles.append(M.Profile.of(units + units[:1] * rnd.randint(0, 2)))
    for mode in ("compat", "bottom_k"):
        m = M.PairMetric(mode)
        may = M.Bound(profiles, m, o).rows(list(range(90)))
        ok = np.array([[M.accepts(m(a, b), o) for b in profiles] for a in profiles])
        assert not (ok & ~may).any() and may.sum() < 0.6 * may.size and ok.sum() > 90


def test_search_scores_few_of_the_pairs(monkeypatch):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    profiles = [M.Profile.of([unit(" ".join(word() for _ in range(20)))]) for _ in range(60)]
    calls, plain = [], M.PairMetric.__call__
    monkeypatch.setattr(M.PairMetric, "__call__", lambda self, a, b: calls.append(1) or plain(self, a, b))
    assert CO.discover([(f"{i:02d}", i) for i in range(60)], profiles, AnalysisOptions()) == ([], 0)
    assert len(calls) < 120


def test_json_equality():
    assert D.loose_json('label: {"a": 1}') == ("label: ", '{"a":1}') and D.loose_json("no") is None and D.loose_json('  {"a":') is None
    assert D.equal_json(['{"a":1,"b":2}', '{"b":2, "a":1}']) and not D.equal_json(['{"a":1}', '{"a":1}']) and not D.equal_json(["[1,2]", "[2,1]"]) and not D.equal_json(['{"a":1}', '{"a":1.0}']) and not D.equal_json(['x {"a":1}', 'y {"a": 1}'])
    assert D.reordered([["a", "b"], ["b", "a"]]) and not D.reordered([["a", "a"], ["a", "a"]]) and not D.reordered([["a"], ["b"]]) and not D.reordered([["a", "b"]]) and not D.reordered([[], []])


# Families


def test_volatile_message(spark):
    a = analyse(spark, [line(system(t, TAIL), i) for i, t in enumerate(["tenant-alpha", "tenant-bravo", "tenant-charlie", "tenant-delta"])])
    assert found(a) == [("value_mismatch", ["content_variation", "scope"], 4, 3, len(TAIL) + len("system"))]
    d = a.defects.first()
    assert d.score == pytest.approx(d.blocked_stable_bytes * 3 * d.confidence) and d.actual_prefix_bytes == len("messages:start") + len("system")
    assert [r.defect_id for r in a.top_k.collect()] == [d.id] and sound(a) == []
    assert {r.id: r.defect_ids for r in a.prefix_nodes.collect()}["seq-2"] == [d.id]


def test_inline_slot_on_character_borders(spark):
    a = analyse(spark, [line(system(f"Préfixe stable, 你好世界 et encore du texte commun: {v} {TAIL}"), i) for i, v in enumerate(["日本", "🌍🌍", "xyz", "été"])])
    assert [x[0] for x in found(a)] == ["value_mismatch"] and sound(a) == []
    for t in a.templates.collect():
        for s in t.stable_spans:
            assert s.utf8_bytes == s.source.byte_end - s.source.byte_start


def test_only_units_of_members_move(spark, capsys):
    from prefixlens.operators import extract as E
    from prefixlens.operators import projection as PJ
    from prefixlens.sources.tables import written

    lines = [line(system(t, TAIL), i) for i, t in enumerate(["alpha", "bravo", "charlie"])] + [line(system(f"alone {i} " * 9), model=f"m{i}") for i in range(9)]
    seqs = written(PJ.sequences(PJ.project(R.identified(R.load_lines(frame(spark, lines))))), "seqs")
    cohorts = written(CO.find_cohorts(seqs), "cohorts")
    placed, _ = E._cohort_rows(cohorts, seqs, AnalysisOptions())
    assert placed.count() == 3
    placed.explain()
    assert "LeftSemi, BuildRight" in capsys.readouterr().out


def test_inserted_block_reorder_and_versions(spark):
    tools = lambda *names: [tool(n) for n in names]
    swapped = analyse(spark, [line(system(TAIL), i, tools=tools(*(("a", "b") if i < 2 else ("b", "a")))) for i in range(4)])
    assert [(x[0], x[1]) for x in found(swapped)][:1] == [("reorder", ["reorder", "scope"])] and sound(swapped) == []
    versions = [line(system(f"version: {i % 2}", TAIL), i) for i in range(4)]
    assert [x[1] for x in found(analyse(spark, versions))] == [["fixed_variants", "scope"]]
    assert [x[1] for x in found(analyse(spark, versions, fixed_variant_max=1))] == [["content_variation", "scope"]]
    inserted = analyse(spark, [line(system(TAIL), 0)] + [line(system("a new block of text", TAIL), i) for i in range(1, 4)])
    assert any("insertion_deletion" in x[1] for x in found(inserted)) and sound(inserted) == []


def test_json_formatting(spark):
    value = {"alpha": [1, 2, {"x": "y"}], "beta": "text"}
    texts = [json.dumps(value), json.dumps(value, indent=1), json.dumps(dict(reversed(value.items()))), json.dumps(value, separators=(",", ":"))]
    same = analyse(spark, [line(system("config: " + t, TAIL), i) for i, t in enumerate(texts)])
    kinds = [k for x in found(same) for k in x[1]]
    # the label and the braces are shared, so the region may hold only a part of the text
    assert found(same) and "scope" in kinds
    orders = analyse(spark, [line(system(json.dumps([i, 1, 2]), TAIL), i) for i in range(4)])
    assert all("structured_data_equivalent" not in x[1] for x in found(orders))


def test_negatives(spark):
    suffix = [line(system(TAIL, f"value {i} " * 5), i) for i in range(4)]
    outside = [line(system(TAIL), i, temperature=i) for i in range(4)]
    unrelated = [line(system("".join(chr(97 + (i * 7 + j * (i + 3)) % 26) for j in range(120))), i) for i in range(4)]
    models = [line(system(f"tenant-{i}", TAIL), i, model=f"model-{i}") for i in range(4)]
    for lines in (suffix, outside, unrelated, models):
        assert found(analyse(spark, lines)) == []


def test_order_of_lines_does_not_matter(spark):
    lines = [line(system(t, TAIL), i) for i, t in enumerate(["tenant-alpha", "tenant-bravo", "tenant-charlie", "tenant-delta"])]
    a, b = analyse(spark, lines), analyse(spark, lines[::-1])
    for part in ("templates", "defects", "top_k"):
        assert getattr(a, part).collect() == getattr(b, part).collect()


def test_identical_requests_make_one_template_and_no_defect(spark):
    a = analyse(spark, [line(system(TAIL), 0)] * 1500)
    assert (a.templates.count(), a.defects.count()) == (1, 0) and len(a.templates.first().member_request_ids) == 1500


def test_budgets_and_nothing_to_analyse(spark):
    lines = [line(system(t, TAIL), i) for i, t in enumerate(["alpha", "bravo", "charlie"])]
    a = analyse(spark, lines, max_total_alignment_cells=30)
    assert a.templates.count() == 0 and "budget" in a.limitations.first().limitation
    b = analyse(spark, lines, max_alignment_cells=40)
    assert b.templates.count() == 0 and "exceed 40" in b.limitations.first().limitation
    with pytest.raises(NothingToAnalyse):
        analyse(spark, ["bad", ""])


def test_ranking(spark):
    rows = [("low", 10, 1, 1.0, "m"), ("high", 30, 2, 1.0, "m"), ("mid", 20, 1, 1.0, "m"), ("high", 25, 2, 1.0, "m")]
    df = spark.createDataFrame(rows, "id string, blocked_stable_bytes long, affected_count long, confidence double, representative_member_id string")
    ranked = rank.rank_defects(df)
    assert [(r.id, r.blocked_stable_bytes, r.score) for r in ranked.collect()] == [("high", 25, 50.0), ("mid", 20, 20.0), ("low", 10, 10.0)]
    assert [(r["rank"], r.defect_id) for r in rank.top_k(ranked, 2).collect()] == [(1, "high"), (2, "mid")]
