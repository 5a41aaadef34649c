"""Report languages: two catalogs with the same keys, chosen by code, immutable once taken."""

from __future__ import annotations

import threading
from collections.abc import Mapping
from types import MappingProxyType

from prefixlens.report.format import named

EN = {
    "title": "Prefix reuse report", "run.input": "Records read", "run.analysed": "Records analysed", "run.skipped": "Lines skipped", "run.defects": "Defects found", "run.limits": "Limits met",
    "reuse.title": "Structural reuse", "reuse.ratio": "Reused now", "reuse.potential": "Reusable with fixes", "reuse.gain": "Bytes to gain", "reuse.target": "Target",
    "reuse.above": "The target is met.", "reuse.reachable": "Known fixes would reach the target.", "reuse.below": "Known fixes do not reach the target.",
    "cross.title": "Structure against reported cache", "cross.session": "Session", "cross.structural": "Structural", "cross.real": "Reported", "cross.difference": "Difference",
    "top.title": "Fix these first", "top.rank": "Rank", "top.defect": "Defect", "top.pattern": "Pattern", "top.location": "Place", "top.blocked": "Blocked", "top.affected": "Affected", "top.confidence": "Confidence", "top.score": "Score", "top.none": "No defect found.",
    "defects.title": "Defects", "defects.template": "Template", "defects.variants": "Variants", "defects.members": "{count} requests", "defects.facts": "Facts", "defects.insights": "What to do", "defects.shared": "Shared text behind it", "defects.missing": "(nothing here)",
    "pattern.value_mismatch": "different values", "pattern.insertion_deletion": "inserted or missing", "pattern.reorder": "different order", "pattern.mixed": "values and insertions",
    "fact.content_variation": "The content varies: {count} versions.", "fact.fixed_variants": "A few fixed versions: {count}.", "fact.structured_data_equivalent": "The same JSON, written differently.", "fact.insertion_deletion": "Elements are inserted, missing or moved.", "fact.reorder": "The same elements in different order.", "fact.scope": "Scope: {shape}",
    "insight.move_volatile_back": "Move what changes behind what stays.", "insight.unify_versions": "Use one version of the stable text.", "insight.fix_element_order": "Emit elements in one fixed order.", "insight.append_at_end": "Append instead of inserting.", "insight.fix_serialisation": "Serialise in one fixed way.",
    "detail.blocks_later_prefix": "A change here cuts the prefix before shared text.", "detail.fix_key_order_and_space": "Fix key order, white space and escapes.",
    "session.title": "Sessions", "session.overview": "{sessions} sessions, {requests} requests, {refreshes} context refreshes, {bytes} abandoned", "session.attention": "Sessions with refreshes", "session.normal": "Other sessions", "session.key": "Session", "session.requests": "Requests", "session.refreshes": "Refreshes", "session.abandoned": "Abandoned", "session.least": "Least reuse", "session.first": "First refresh", "session.turns": "Turns", "session.more": "{count} more sessions",
    "event.append": "append", "event.fork": "fork", "event.reorder": "reorder", "event.reset": "reset", "event.turn": "Turn", "event.type": "Kind", "event.reuse": "Reuse", "event.lost": "Abandoned", "event.recomputed": "Recomputed", "event.domain": "domain changed",
    "cache.title": "Cache metrics", "cache.summary": "Mean hit rate {rate}; {reported} reported, {estimated} estimated", "cache.request": "Request", "cache.rate": "Hit rate", "cache.delta": "Change", "cache.basis": "Basis", "cache.bytes": "Payload", "cache.reported": "reported", "cache.estimated": "estimated", "cache.nosession": "without session",
    "tree.title": "Template chains", "tree.summary": "{nodes} pieces, {dynamic} of them vary; {bytes} in all", "tree.divergence": "First divergence at piece {index}", "tree.none": "No divergence", "tree.node": "Piece", "tree.kind": "Kind", "tree.support": "Support", "tree.text": "Text", "tree.stable": "stable", "tree.dynamic": "varies", "tree.truncated": "The chain is cut at the node limit.", "tree.decay": "Members along the chain", "tree.missing": "missing here", "tree.defects": "Defects",
}
ZH = {
    "title": "前缀复用报告", "run.input": "读取记录", "run.analysed": "分析记录", "run.skipped": "跳过的行", "run.defects": "发现缺陷", "run.limits": "触及的限制",
    "reuse.title": "结构复用", "reuse.ratio": "当前复用", "reuse.potential": "修复后可复用", "reuse.gain": "可增加字节", "reuse.target": "目标",
    "reuse.above": "已达到目标。", "reuse.reachable": "已知修复可达到目标。", "reuse.below": "已知修复达不到目标。",
    "cross.title": "结构与上报缓存对照", "cross.session": "会话", "cross.structural": "结构", "cross.real": "上报", "cross.difference": "差值",
    "top.title": "优先修复", "top.rank": "名次", "top.defect": "缺陷", "top.pattern": "模式", "top.location": "位置", "top.blocked": "受阻", "top.affected": "受影响", "top.confidence": "置信度", "top.score": "得分", "top.none": "没有发现缺陷。",
    "defects.title": "缺陷", "defects.template": "模板", "defects.variants": "变体", "defects.members": "{count} 个请求", "defects.facts": "事实", "defects.insights": "建议", "defects.shared": "其后的共享文本", "defects.missing": "（此处没有内容）",
    "pattern.value_mismatch": "取值不同", "pattern.insertion_deletion": "插入或缺失", "pattern.reorder": "顺序不同", "pattern.mixed": "取值与插入并存",
    "fact.content_variation": "内容有变化：{count} 个版本。", "fact.fixed_variants": "少数固定版本：{count} 个。", "fact.structured_data_equivalent": "同一 JSON，写法不同。", "fact.insertion_deletion": "有元素被插入、缺失或移动。", "fact.reorder": "元素相同，顺序不同。", "fact.scope": "范围：{shape}",
    "insight.move_volatile_back": "把易变内容移到稳定内容之后。", "insight.unify_versions": "稳定文本只用一个版本。", "insight.fix_element_order": "按固定顺序输出元素。", "insight.append_at_end": "改为在末尾追加。", "insight.fix_serialisation": "用一种固定方式序列化。",
    "detail.blocks_later_prefix": "此处的变化在共享文本之前截断前缀。", "detail.fix_key_order_and_space": "固定键序、空白与转义。",
    "session.title": "会话", "session.overview": "{sessions} 个会话，{requests} 个请求，{refreshes} 次上下文刷新，放弃 {bytes}", "session.attention": "有刷新的会话", "session.normal": "其他会话", "session.key": "会话", "session.requests": "请求", "session.refreshes": "刷新", "session.abandoned": "放弃", "session.least": "最低复用", "session.first": "首次刷新", "session.turns": "各轮", "session.more": "另有 {count} 个会话",
    "event.append": "追加", "event.fork": "分叉", "event.reorder": "重排", "event.reset": "重置", "event.turn": "轮次", "event.type": "类型", "event.reuse": "复用", "event.lost": "放弃", "event.recomputed": "重算", "event.domain": "比较域变化",
    "cache.title": "缓存指标", "cache.summary": "平均命中率 {rate}；上报 {reported}，估算 {estimated}", "cache.request": "请求", "cache.rate": "命中率", "cache.delta": "变化", "cache.basis": "依据", "cache.bytes": "载荷", "cache.reported": "上报", "cache.estimated": "估算", "cache.nosession": "无会话",
    "tree.title": "模板链", "tree.summary": "{nodes} 个片段，其中 {dynamic} 个变化；共 {bytes}", "tree.divergence": "首个分歧在片段 {index}", "tree.none": "没有分歧", "tree.node": "片段", "tree.kind": "类型", "tree.support": "支持", "tree.text": "文本", "tree.stable": "稳定", "tree.dynamic": "变化", "tree.truncated": "链在节点上限处截断。", "tree.decay": "沿链剩余成员", "tree.missing": "此处缺失", "tree.defects": "缺陷",
}
CATALOGS: Mapping[str, Mapping[str, str]] = {"en-US": EN, "zh-CN": ZH}


class Locale:
    """An immutable snapshot of one catalog."""

    def __init__(self, code: str):
        self.code, self._words = code, MappingProxyType(dict(CATALOGS[code]))

    def __call__(self, key: str, **values: object) -> str:
        return named(self._words[key], **values)

    def known(self, key: str) -> bool:
        return key in self._words


def parse(code: str) -> str:
    """en-US and zh-CN in any case, with hyphen or underscore."""
    found = {c.lower(): c for c in CATALOGS}.get(code.strip().lower().replace("_", "-"))
    if found is None:
        raise ValueError(f"unknown locale {code!r}; known: {', '.join(CATALOGS)}")
    return found


def check_catalogs() -> None:
    keys = {c: set(w) for c, w in CATALOGS.items()}
    first = next(iter(keys.values()))
    for c, k in keys.items():
        if k != first:
            raise ValueError(f"{c} differs in {', '.join(sorted(k ^ first))}")
        for key in k:
            if not CATALOGS[c][key].strip():
                raise ValueError(f"{c} has no text for {key}")


_lock, _current = threading.Lock(), Locale("en-US")


def set_locale(code: str) -> None:
    global _current
    snapshot = Locale(parse(code))
    with _lock:
        _current = snapshot


def current() -> Locale:
    """The process-wide locale as it is now; later changes leave the snapshot as it is."""
    with _lock:
        return _current
