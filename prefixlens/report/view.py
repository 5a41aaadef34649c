"""What both renderers print: plain values gathered once from a document's reporting queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from prefixlens.report import tables as Q
from prefixlens.report.document import relations


@dataclass
class View:
    run: dict
    gauge: dict | None
    cross: list[dict]
    top: list[dict]
    defects: list[dict]
    overview: dict | None
    attention: list[dict]
    normal: list[dict]
    events: dict[str, list[dict]]
    cache: list[dict]
    cache_total: dict | None
    chains: list[dict] = field(default_factory=list)


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]  # a report's tables


def chain_nodes(nodes: list[dict]) -> list[dict]:
    """Nodes in chain order; a cycle or a dangling child is an error."""
    by_id, order, seen, at = {n["id"]: n for n in nodes}, [], set(), "seq-0"
    while at is not None:
        if at in seen:
            raise ValueError(f"the chain comes back to {at}")
        if at not in by_id:
            raise ValueError(f"the chain leads to {at}, which is missing")
        seen.add(at)
        order.append(by_id[at])
        at = by_id[at].get("sequence_child")
    return order


def build(spark: SparkSession, document: dict) -> View:
    from prefixlens.operators import cache

    r = relations(spark, document)
    reuse, run = document["prefix_reuse"], document["run"]
    gauge = cross = None
    if reuse is not None:
        total = spark.createDataFrame([(float(reuse["ratio"]), float(reuse["potential_ratio"]), int(reuse["gain_bytes"]))], "ratio double, potential_ratio double, gain_bytes bigint")
        gauge = _rows(Q.reuse_gauge(total))[0] | {"composition": reuse["composition"]}
        by = spark.createDataFrame([(s["session_key"], float(s["ratio"])) for s in reuse["by_session"]], "session_key string, ratio double")
        cross = _rows(Q.cross_check(by, r["cache_metrics"]))
    table = Q.sessions(r).cache()
    events: dict[str, list[dict]] = {}
    for e in _rows(Q.event_details(r)):
        events.setdefault(e["session_key"], []).append(e)
    totals = {t["template_id"]: t for t in _rows(Q.template_totals(r["prefix_nodes"]))}
    curves: dict[str, list[dict]] = {}
    for p in _rows(Q.decay(r["prefix_nodes"])):
        curves.setdefault(p["template_id"], []).append(p)
    dropped = {(d["template_id"], d["id"]): d["dropped"] for d in _rows(Q.dropped_members(r))}
    chains = []
    for t in document["templates"]:
        if "prefix_view" in t:
            nodes = chain_nodes(t["prefix_view"]["nodes"])
            for n in nodes:
                n["dropped"] = dropped.get((t["id"], n["id"]), [])
                n["variants"] = sorted(n.get("variants") or [], key=lambda v: -v["count"])
            chains.append({"id": t["id"], "chain": nodes, "truncated": t["prefix_view"]["truncated"], "decay": curves.get(t["id"], []), **totals[t["id"]]})
    metrics = document["cache_metrics"]
    out = View(
        run={"input": run["input_records"], "analysed": run["analyzed_records"], "skipped": len(run["skipped_records"]), "defects": len(document["defects"]), "limits": run["limitations"]},
        gauge=gauge, cross=cross or [], top=_rows(Q.top_table(r)), defects=document["defects"],
        overview=_rows(Q.session_overview(table))[0] if document["session_reports"] else None, attention=_rows(Q.attention(table)), normal=_rows(Q.normal(table)), events=events,
        cache=_rows(Q.cache_table(r["cache_metrics"]).orderBy("group", "sequence")), cache_total=_rows(cache.metric_totals(r["cache_metrics"]))[0] if metrics else None, chains=chains,
    )
    table.unpersist()
    return out
