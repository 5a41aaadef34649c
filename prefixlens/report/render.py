"""HTML and Markdown of a view. Every value is escaped; sections without rows are left out."""

from __future__ import annotations

from html import escape

from prefixlens.report import format as T
from prefixlens.report.locale import Locale, current
from prefixlens.report.tables import COLLAPSED
from prefixlens.report.view import View

PREVIEW = 8
_STYLE = "body{font:15px/1.5 sans-serif;max-width:70em;margin:2em auto;padding:0 1em}table{border-collapse:collapse;margin:1em 0}th,td{border:1px solid #ccc;padding:.2em .6em;text-align:left}pre{background:#f5f5f5;padding:.6em;overflow:auto;white-space:pre-wrap}.bar{display:inline-block;width:.6em;height:1em;margin-right:1px}.low{background:#c33}.mid{background:#da3}.high{background:#393}.none{background:#bbb}"


class _Html:
    """Blocks of a page."""

    heading = staticmethod(lambda level, text: f"<h{level}>{escape(text)}</h{level}>")
    text = staticmethod(lambda text: f"<p>{escape(text)}</p>")
    code = staticmethod(lambda text: f"<code>{escape(T.flatten(text))}</code>")
    block = staticmethod(lambda text: f"<pre>{escape(text)}</pre>")
    cell = staticmethod(lambda text: escape(text))

    @staticmethod
    def table(head: list[str], rows: list[list[str]]) -> str:
        body = "".join(f"<tr>{''.join(f'<td>{c}</td>' for c in r)}</tr>" for r in rows)
        return f"<table><thead><tr>{''.join(f'<th>{escape(h)}</th>' for h in head)}</tr></thead><tbody>{body}</tbody></table>"

    @staticmethod
    def items(rows: list[str]) -> str:
        return f"<ul>{''.join(f'<li>{escape(r)}</li>' for r in rows)}</ul>"

    @staticmethod
    def folded(title: str, inner: str) -> str:
        return f"<details><summary>{escape(title)}</summary>{inner}</details>"

    @staticmethod
    def bars(classes: list[str]) -> str:
        return "<p>" + "".join(f'<span class="bar {c}"></span>' for c in classes) + "</p>"

    @staticmethod
    def page(title: str, code: str, body: list[str]) -> str:
        joined = "\n".join(body)
        return f'<!DOCTYPE html>\n<html lang="{code}"><head><meta charset="utf-8"><title>{escape(title)}</title><style>{_STYLE}</style></head><body>\n{joined}\n</body></html>\n'


class _Markdown:
    heading = staticmethod(lambda level, text: f"{'#' * level} {T.inline(text)}")
    text = staticmethod(T.inline)
    code = staticmethod(T.table_code)
    block = staticmethod(T.fenced)
    cell = staticmethod(T.inline)

    @staticmethod
    def table(head: list[str], rows: list[list[str]]) -> str:
        return "\n".join(["| " + " | ".join(map(T.inline, head)) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(r) + " |" for r in rows)])

    @staticmethod
    def items(rows: list[str]) -> str:
        return "\n".join(f"- {T.inline(r)}" for r in rows)

    @staticmethod
    def folded(title: str, inner: str) -> str:
        return f"{T.inline(title)}\n\n{inner}"

    @staticmethod
    def bars(classes: list[str]) -> str:
        return T.code("".join({"low": "_", "mid": "-", "high": "=", "none": "."}[c] for c in classes))

    @staticmethod
    def page(title: str, code: str, body: list[str]) -> str:
        return "\n\n".join(body) + "\n"


def _fact(f: dict, l: Locale) -> str:
    places = {"content_variation": "count", "fixed_variants": "count", "scope": "shape"}
    name = places.get(f["kind"])
    return l(f"fact.{f['kind']}", **({name: f.get("detail") or "-"} if name else {}))


def _insight(i: dict, l: Locale) -> str:
    word = lambda group, v: l(f"{group}.{v}") if l.known(f"{group}.{v}") else v
    return word("insight", i["summary"]) + (f" {word('detail', i['detail'])}" if i.get("detail") else "")


def _body(v: View, l: Locale, o) -> list[str]:
    out = [o.heading(1, l("title"))]
    out.append(o.table([l(f"run.{k}") for k in ("input", "analysed", "skipped", "defects")], [[o.cell(str(v.run[k])) for k in ("input", "analysed", "skipped", "defects")]]))
    if v.run["limits"]:
        out += [o.heading(2, l("run.limits")), o.items(v.run["limits"])]
    if v.gauge is not None:
        g = v.gauge
        out += [o.heading(2, l("reuse.title")), o.table([l(f"reuse.{k}") for k in ("ratio", "potential", "gain", "target")], [[o.cell(x) for x in (T.percent(g["ratio"]), T.percent(g["potential_ratio"]), T.human_bytes(g["gain_bytes"]), T.percent(g["target"]))]]), o.text(l(f"reuse.{g['verdict']}"))]
    if v.cross:
        out += [o.heading(2, l("cross.title")), o.table([l(f"cross.{k}") for k in ("session", "structural", "real", "difference")], [[o.code(T.session_label(c["session_key"])), *(o.cell(T.percent(c[k])) for k in ("structural_ratio", "real_ratio", "difference"))] for c in v.cross])]
    out.append(o.heading(2, l("top.title")))
    if v.top:
        rows = [[o.cell(str(t["rank"])), o.code(T.short_id(t["defect_id"], 20)), o.cell(l(f"pattern.{t['pattern']}")), o.code(t["location"]), o.cell(T.human_bytes(t["blocked_stable_bytes"])), o.cell(f"{t['affected_count']}/{t['comparable_count']}"), o.cell(f"{t['confidence']:.3f}"), o.cell(f"{t['score']:.1f}")] for t in v.top]
        out.append(o.table([l(f"top.{k}") for k in ("rank", "defect", "pattern", "location", "blocked", "affected", "confidence", "score")], rows))
    else:
        out.append(o.text(l("top.none")))
    if v.defects:
        out.append(o.heading(2, l("defects.title")))
    for d in v.defects:
        m = d["mismatch"]
        out += [o.heading(3, d["id"]), o.text(f"{l(f'pattern.{m['pattern']}')} · {l('defects.template')} {T.short_id(d['template_id'])}"), o.heading(4, l("defects.facts")), o.items([_fact(f, l) for f in m["facts"]]), o.heading(4, l("defects.insights")), o.items([_insight(i, l) for i in d["insights"]]), o.heading(4, l("defects.variants"))]
        for x in sorted(m["variants"], key=lambda x: (-len(x["member_request_ids"]), x["fingerprint"])):
            out += [o.text(l("defects.members", count=len(x["member_request_ids"]))), o.block(x["representative"].get("excerpt") or l("defects.missing"))]
        out += [o.heading(4, l("defects.shared")), o.block(d["recovered_stable"]["excerpt"])]
    if v.overview is not None:
        s = v.overview
        prefix = T.common_prefix([r["session_key"] for r in v.attention + v.normal])
        out += [o.heading(2, l("session.title")), o.text(l("session.overview", sessions=s["sessions"], requests=s["requests"], refreshes=s["refreshes"], bytes=T.human_bytes(s["abandoned_bytes"]))), o.text(f"{s['endpoints']} · {s['models']}")]
        head = [l(f"session.{k}") for k in ("key", "requests", "refreshes", "abandoned", "least", "first")]

        def line(r: dict) -> list[str]:
            first = r["first_refresh"]
            return [o.code(T.session_label(r["session_key"], prefix)), *(o.cell(x) for x in (str(r["request_count"]), str(r["refreshes"]), T.human_bytes(r["abandoned_bytes"]), T.percent(r["least_reuse"]), f"{first['previous_sequence']} → {first['next_sequence']}" if first else "-"))]

        for name in ("attention", "normal"):
            rows = [line(r) for r in getattr(v, name)]
            if rows:
                out += [o.heading(3, l(f"session.{name}")), o.table(head, rows[:COLLAPSED])]
                if rows[COLLAPSED:]:
                    out.append(o.folded(l("session.more", count=len(rows) - COLLAPSED), o.table(head, rows[COLLAPSED:])))
        for r in v.attention:
            turns = v.events.get(r["session_key"], [])
            rows = [[o.cell(f"{e['previous_sequence']} → {e['next_sequence']}"), o.cell(l(f"event.{e['event_type']}") + (f" ({l('event.domain')})" if e["domain_changed"] else "")), o.cell(T.percent(e["prefix_reuse_ratio"])), o.cell(T.human_bytes(e["abandoned_prefix_bytes"])), o.cell(T.human_bytes(e["recomputed_bytes"]))] for e in turns]
            out += [o.heading(4, T.session_label(r["session_key"])), o.bars([e["bar"] for e in turns]), o.table([l(f"event.{k}") for k in ("turn", "type", "reuse", "lost", "recomputed")], rows)]
    if v.cache_total is not None:
        c = v.cache_total
        out += [o.heading(2, l("cache.title")), o.text(l("cache.summary", rate=T.percent(c["mean_hit_rate"]), reported=c["reported"], estimated=c["estimated"]))]
        group = None
        rows: list[list[str]] = []
        head = [l(f"cache.{k}") for k in ("request", "rate", "delta", "basis", "bytes")]
        for r in [*v.cache, None]:
            if r is None or r["group"] != group:
                if rows:
                    out.append(o.table(head, rows))
                if r is None:
                    break
                group, rows = r["group"], []
                out.append(o.heading(3, T.session_label(r["session_key"]) if r["session_key"] is not None else l("cache.nosession")))
            delta = "-" if r["hit_rate_delta"] is None else f"{r['hit_rate_delta'] * 100:+.1f}"
            rows.append([o.code(T.short_id(r["request_id"])), o.cell(T.percent(r["hit_rate"])), o.cell(delta), o.cell(l(f"cache.{r['basis']}")), o.cell(T.human_bytes(r["payload_bytes"] or 0))])
    if v.chains:
        out.append(o.heading(2, l("tree.title")))
    for t in v.chains:
        out += [o.heading(3, T.short_id(t["id"])), o.text(l("tree.summary", nodes=t["nodes"], dynamic=t["dynamic_nodes"], bytes=T.human_bytes(t["bytes"])))]
        out.append(o.text(l("tree.none") if t["first_divergence"] is None else l("tree.divergence", index=t["first_divergence"])))
        if t["truncated"]:
            out.append(o.text(l("tree.truncated")))
        rows = []
        for n in t["chain"]:
            text = T.flatten(n["excerpt"], 96)
            for x in n["variants"][:PREVIEW]:
                # a count of zero is only shown where it is known
                shown = str(x["count"]) if x["count"] or x["count_known"] else "?"
                text += f" · {l('tree.missing') if x.get('is_missing') else T.flatten(x['excerpt'], 40)} ×{shown}"
            rows.append([o.cell(n["id"]), o.cell(l(f"tree.{n['kind']}")), o.cell(f"{n['support_count']} ({T.percent(n['support_ratio'])})"), o.code(text), o.cell(", ".join(T.short_id(x, 20) for x in n.get("defect_ids", [])) or "-")])
        out.append(o.table([l(f"tree.{k}") for k in ("node", "kind", "support", "text", "defects")], rows))
        ticks = [p for p in t["decay"] if p["tick"]]
        out += [o.text(l("tree.decay")), o.items([f"{p['index']}: {p['support_count']} ({T.percent(p['share'])})" for p in ticks])]
    return out


def html(v: View, locale: Locale | None = None) -> str:
    l = locale or current()
    return _Html.page(l("title"), l.code, _body(v, l, _Html))


def markdown(v: View, locale: Locale | None = None) -> str:
    l = locale or current()
    return _Markdown.page(l("title"), l.code, _body(v, l, _Markdown))
