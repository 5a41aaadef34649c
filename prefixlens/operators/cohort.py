"""Cohorts: requests of one domain that one template can describe.

Members with equal unit arrays are one variant; a domain's task holds its variants, and members only by id.
The search is greedy: the best centre of the first members by id takes in all compatible members that also
agree with a few boundary members, then the rest is searched again.

Only accepted pairs matter to it, and few pairs are: ``metric.Bound`` tells most others apart without a score.

A domain with more variants than ``TASK_VARIANTS`` is not brought into one task. There, the members that the
search can take for centres are scored against all variants in one distributed pass, chunk by chunk; then a task
searches ids and accepted pairs, with the units of the variants that have any. Where it comes to a member beyond
those, another pass follows. A domain with more than ``TASK_VARIANTS`` such variants takes a distributed pass for
each round of the search, which scores the variants against the centre and the validators (at most eight a domain).
What is written between passes are ids. All ways give equal results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefixlens.operators.metric import Bound, PairMetric, Profile, accepts
from prefixlens.operators.ordering import row_numbers
from prefixlens.operators.projection import ADAPTER, DIALECT, DOMAIN, SCHEMA
from prefixlens.options import AnalysisOptions
from prefixlens.sources.tables import written

#: Distinct unit arrays of a domain that one task searches.
TASK_VARIANTS = 3000
#: Variants that are scored against the members in question at a time, about.
CHUNK = 1000
#: Variants of a domain whose pairs are scored without looking at their bounds.
FEW = 8
VALIDATORS = 8
#: Names of collections inside digests (fixed values).
COLLECTION_NAMES = {"request": "request", "tools": "tools", "messages": "messages", "content_blocks": "content-blocks"}


def structure_signature(units: list[dict]) -> str:
    """Digest of the ordered collections and keys, and of the sorted tool names."""
    h = hashlib.sha256("\x1f".join(f"{COLLECTION_NAMES[u['collection']]}:{u['alignment_key']}" for u in units).encode() + b"\0")
    for name in sorted(u["tool_identity"] for u in units if u["tool_identity"] is not None):
        h.update(name.encode() + b"\0")
    return h.hexdigest()


def _optional(v: str | None) -> bytes:
    return b"\0\0" if v is None else b"\1" + v.encode() + b"\0"


def domain_material(domain: dict) -> bytes:
    plain = lambda v: v.encode() + b"\0"
    return (
        struct.pack(">q", domain["time_window_key"]) + b"\0" + plain(domain["endpoint_key"]) + plain(DIALECT) + plain(domain["model"]) + _optional(domain["model_deployment_key"])
        + plain(SCHEMA) + _optional(domain["agent_key"]) + _optional(domain["kv_namespace"]) + plain(ADAPTER)
    )


def best_centre(seed: list[tuple[str, int]], accepted) -> int:
    """Position in the seed (id, variant; sorted by id) of the centre that accepts most of it.

    ``accepted(v, among)``: (variant, pair) of those among the variants that v accepts.
    """
    places: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(seed):
        places.setdefault(v, []).append(i)

    def rank(v: int) -> tuple[int, float, int]:
        # summed in the order of the seed
        near = [c for _, c in sorted((i, p[0]) for u, p in accepted(v, places) for i in places[u])]
        return len(near), sum(near) / max(len(near), 1), -places[v][0]

    return places[max(places, key=rank)][0]


def choose_validators(compatible: list[tuple[str, int]], pairs: dict[int, tuple[float, float]]) -> list[int]:
    """Positions of the boundary members: the four least compatible and the quartiles, at most eight."""
    by_boundary = sorted(range(len(compatible)), key=lambda i: (pairs[compatible[i][1]][0], -pairs[compatible[i][1]][1], i))
    chosen = by_boundary[:4]
    for q in range(5):
        at = q * (len(compatible) - 1) // 4
        if len(chosen) < VALIDATORS and at not in chosen:
            chosen.append(at)
    return chosen


def in_question_at_most(options: AnalysisOptions) -> int:
    return 2 * options.max_candidates_per_request + 1


def in_question(members: list[tuple[str, int]], examined: int, options: AnalysisOptions) -> list[tuple[str, int]]:
    """The members that can come into a seed before the budget of centres runs out, if no cohort is found."""
    return members[: in_question_at_most(options) - examined]


def discover(members: list[tuple[str, int]], profiles: list[Profile], options: AnalysisOptions, mode: str = "compat") -> tuple[list[dict], int]:
    """Cohorts of one domain and the number of members left when the budget of centres ran out (0 if not).

    ``members``: (request id, variant) sorted by id. A cohort: centre id, members (ids in order) with their
    compatibility to the centre, cohesion.
    """
    metric, memo = PairMetric(mode), {}
    bound = Bound(profiles, metric, options) if len(profiles) > FEW else None
    possible: dict[int, list[int]] = {}

    def score(a: int, b: int) -> tuple[tuple[float, float], bool]:
        key = (a, b) if a <= b else (b, a)
        if key not in memo:
            pair = metric(profiles[a], profiles[b])
            memo[key] = (pair, accepts(pair, options))
        return memo[key]

    def look(members: list[tuple[str, int]], examined: int) -> None:
        if all(v in possible for _, v in members[: options.max_candidates_per_request + 1]):
            return
        new = list(dict.fromkeys(v for _, v in in_question(members, examined, options) if v not in possible))
        if bound is None:
            possible.update({v: list(range(len(profiles))) for v in new})
        else:
            possible.update({v: np.flatnonzero(row).tolist() for v, row in zip(new, bound.rows(new))})

    def accepted(v: int, among) -> list[tuple[int, tuple[float, float]]]:
        return [(u, pair) for u in possible[v] if u in among for pair, ok in (score(v, u),) if ok]

    return greedy(members, look, accepted, score, options)


def greedy(members: list[tuple[str, int]], look, accepted, score, options: AnalysisOptions) -> tuple[list[dict], int]:
    """The search. ``look(members, examined)`` comes before ``accepted`` is asked of their seed; ``score`` is asked of members of one cohort."""
    cohorts, examined = [], 0
    while len(members) >= options.min_template_members:
        if examined >= options.max_candidates_per_request:
            return cohorts, len(members)
        look(members, examined)
        centre = best_centre(members[: options.max_candidates_per_request + 1], accepted)
        examined += 1
        mine = members[centre][1]
        near = dict(accepted(mine, {v for _, v in members}))
        compatible = [m for m in members if m[1] in near]
        if len(compatible) >= options.min_template_members:
            judges = {compatible[i][1] for i in choose_validators(compatible, near)}
            kept = {v for v in near if all(score(v, j)[1] for j in judges)}
            compatible = [m for m in compatible if m[1] in kept]
        if len(compatible) < options.min_template_members:
            members = members[:centre] + members[centre + 1 :]
            continue
        scores = [near[v][0] for _, v in compatible]
        cohorts.append({"medoid": members[centre][0], "variant": mine, "members": [i for i, _ in compatible], "scores": scores, "cohesion": sum(scores) / len(scores)})
        taken = {i for i, _ in compatible}
        members = [m for m in members if m[0] not in taken]
    return cohorts, 0


def cohort_id(domain: dict, signature: str, members: list[str]) -> str:
    h = hashlib.sha256(domain_material(domain) + signature.encode())
    for m in members:
        h.update(m.encode() + b"\0")
    return h.hexdigest()


_DOMAIN_DDL = "time_window_key bigint, endpoint_key string, model string, model_deployment_key string, agent_key string, kv_namespace string"
COHORTS = f"{_DOMAIN_DDL}, cohort_id string, medoid_request_id string, request_id string, compatibility double, cohesion double, skip_members bigint"
_COLUMNS = [*DOMAIN, "cohort_id", "medoid_request_id", "request_id", "compatibility", "cohesion", "skip_members"]


#: What the metric and the signature need of a unit.
_NEEDED = ("collection", "kind", "alignment_key", "tool_identity", "content")


def members(seqs: DataFrame) -> DataFrame:
    """(domain, input_line, request_id, variant, units): what the search needs of the sequences."""
    variant = F.sha2(F.array_join(F.transform("units", lambda u: F.concat(u["fp"], F.coalesce(u["tool_identity"], F.lit("-")))), ","), 256)
    return seqs.select(*DOMAIN, "input_line", "request_id", F.transform("units", lambda u: F.struct(*[u[k].alias(k) for k in _NEEDED])).alias("units"), variant.alias("variant"))


def find_cohorts(seqs: DataFrame, options: AnalysisOptions = AnalysisOptions(), mode: str = "compat", task_variants: int = TASK_VARIANTS, linked_variants: int = TASK_VARIANTS) -> DataFrame:
    """COHORTS rows: one per cohort member, and one with skip_members per domain whose budget ran out.

    ``seqs``: sequences or their ``members``. A domain of more than ``task_variants`` is searched in distributed passes,
    and in one per round if more than ``linked_variants`` of them are accepted by members in question.
    """
    rows = seqs if "variant" in seqs.columns else members(seqs)
    ids = written(rows.drop("units"), "ids")
    per = written(ids.groupBy(*DOMAIN, "variant").agg(F.count(F.lit(1)).alias("k"), F.min("request_id").alias("rep")), "per-variant")
    # domains too small for a cohort go first, by their keys alone
    sizes = written(per.groupBy(*DOMAIN).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct")).where(F.col("n") >= options.min_template_members).drop("n"), "sizes")
    # one representative of each variant carries the units; the other members are ids only
    copies = written(_join_on(ids, per.where("k > 1").select(*DOMAIN, "variant", "rep"), [*DOMAIN, "variant"], "inner").where("request_id <> rep").select("input_line", F.lit(True).alias("copy")), "copies")
    small = _join_domain(rows, sizes.where(F.col("distinct") <= task_variants).drop("distinct")).join(copies, "input_line", "left")
    grouped = small.select(*DOMAIN, "request_id", "variant", F.when(F.col("copy").isNull(), F.col("units")).alias("units"))

    found = grouped.groupBy(*DOMAIN).applyInPandas(lambda pdf: _search(pdf.sort_values("request_id", kind="stable"), options, mode), COHORTS)
    large = sizes.where(F.col("distinct") > task_variants)
    if large.isEmpty():
        return found
    large = large.select(*DOMAIN, F.ceil(F.col("distinct") / CHUNK).alias("chunks"))
    pool = _join_domain(ids.drop("input_line"), large.drop("chunks"))
    return found.unionByName(_linked(pool, rows.join(copies, "input_line", "left_anti").drop("input_line"), large, options, mode, linked_variants))


def seed_scores(seqs: DataFrame, options: AnalysisOptions = AnalysisOptions(), mode: str = "compat") -> DataFrame:
    """(domain, a, b, compatibility, dynamic, accepted): the pair metric between the seed members of every domain.

    The seed is the first members by id, as many as the search looks at for one centre.
    """
    alive = seqs.groupBy(*DOMAIN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= options.min_template_members).drop("_n")
    place = F.row_number().over(Window.partitionBy(*DOMAIN).orderBy("request_id"))
    ids = _join_domain(seqs.select(*DOMAIN, "request_id"), alive).withColumn("_r", place).where(F.col("_r") <= options.max_candidates_per_request + 1).drop("_r")
    seed = _join_on(ids, seqs.select(*DOMAIN, "request_id", "units"), [*DOMAIN, "request_id"], "inner")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("request_id", kind="stable")
        metric, profiles, ids = PairMetric(mode), [Profile.of(list(u)) for u in pdf["units"]], list(pdf["request_id"])
        domain = tuple(None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0] for k in DOMAIN)
        rows = [(*domain, ids[i], ids[j], *pair, accepts(pair, options)) for i in range(len(ids)) for j in range(i + 1, len(ids)) for pair in (metric(profiles[i], profiles[j]),)]
        return pd.DataFrame(rows, columns=[*DOMAIN, "a", "b", "compatibility", "dynamic", "accepted"])

    return seed.groupBy(*DOMAIN).applyInPandas(run, f"{_DOMAIN_DDL}, a string, b string, compatibility double, dynamic double, accepted boolean")


def _join_on(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    return a.alias("a").join(b.alias("b"), on, how).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c not in keys])


def _join_domain(rows: DataFrame, other: DataFrame) -> DataFrame:
    return _join_on(rows, other, list(DOMAIN), "inner")


def _dicts(units) -> list[dict]:
    return [x if isinstance(x, dict) else x.asDict() for x in units]


def _domain_of(pdf: pd.DataFrame) -> dict:
    domain = {k: None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0] for k in DOMAIN}
    domain["time_window_key"] = int(domain["time_window_key"])
    return domain


def _rows(domain: dict, cohorts: list[dict], left: int, signatures) -> list[tuple]:
    out = []
    for c in cohorts:
        name = cohort_id(domain, signatures[c["variant"]], c["members"])
        out += [(*domain.values(), name, c["medoid"], m, s, c["cohesion"], None) for m, s in zip(c["members"], c["scores"])]
    if left:
        out.append((*domain.values(), None, None, None, None, None, left))
    return out


def _search(pdf: pd.DataFrame, options: AnalysisOptions, mode: str) -> pd.DataFrame:
    number: dict[str, int] = {}
    members = [(i, number.setdefault(v, len(number))) for i, v in zip(pdf["request_id"], pdf["variant"])]
    profiles: list[Profile] = [Profile()] * len(number)
    signatures = [""] * len(number)
    for v, u in zip(pdf["variant"], pdf["units"]):
        if u is not None:
            units = _dicts(u)
            profiles[number[v]], signatures[number[v]] = Profile.of(units), structure_signature(units)
    return pd.DataFrame(_rows(_domain_of(pdf), *discover(members, profiles, options, mode), signatures), columns=_COLUMNS)


class _Unknown(Exception):
    """The search came to variants whose accepted pairs are not known yet."""


_UNITS = f"array<struct<{', '.join(f'{k}: string' for k in _NEEDED)}>>"
_LINKS = f"{_DOMAIN_DDL}, what string, request_id string, variant string, other string, compat double, dynamic double, units {_UNITS}"


def _links(pdf: pd.DataFrame, options: AnalysisOptions, mode: str) -> pd.DataFrame:
    """Of one chunk of a domain: the signatures of its centres, the accepted pairs of all centres and the units of others that have one."""
    pdf = pdf.sort_values("variant", kind="stable").reset_index(drop=True)
    metric, domain, units = PairMetric(mode), list(_domain_of(pdf).values()), [_dicts(u) for u in pdf["units"]]
    profiles, names, centre = [Profile.of(u) for u in units], list(pdf["variant"]), list(pdf["centre"])
    centres, here = np.flatnonzero(pdf["centre"]), np.flatnonzero(pdf["here"])
    out = [(*domain, "asked", None, names[a], structure_signature(units[a]), None, None, None) for a in centres if pdf["here"].iloc[a]]
    met, memo = set(), {}
    for i, j in zip(*np.nonzero(Bound(profiles, metric, options).rows(centres.tolist())[:, here])):
        a, b = int(centres[i]), int(here[j])
        # a pair of centres comes twice
        if (pair := memo.pop((b, a), None)) is None:
            pair = metric(profiles[a], profiles[b])
            if centre[b] and a != b:
                memo[a, b] = pair
        if accepts(pair, options):
            out.append((*domain, "link", None, names[a], names[b], *pair, None))
            if not centre[b] and b not in met:
                met.add(b)
                out.append((*domain, "units", None, names[b], None, None, None, units[b]))
    return pd.DataFrame(out, columns=[*DOMAIN, "what", "request_id", "variant", "other", "compat", "dynamic", "units"])


def _search_links(pdf: pd.DataFrame, options: AnalysisOptions, mode: str) -> pd.DataFrame:
    """COHORTS rows of one domain from members and what ``_links`` gives; or the id up to which members are to be looked at."""
    metric, domain, parts = PairMetric(mode), _domain_of(pdf), {k: f for k, f in pdf.groupby("what")}
    number: dict[str, int] = {}
    every = [(i, number.setdefault(v, len(number))) for i, v in sorted(zip(parts["member"]["request_id"], parts["member"]["variant"]))]
    links: dict[int, dict[int, tuple[float, float]]] = {}
    if "link" in parts:
        f = parts["link"]
        for a, b, compat, dynamic in zip(f["variant"], f["other"], f["compat"], f["dynamic"]):
            links.setdefault(number[a], {})[number[b]] = (compat, dynamic)
    signatures = {number[v]: s for v, s in zip(parts["asked"]["variant"], parts["asked"]["other"])}
    units = {number[v]: u for v, u in zip(parts["units"]["variant"], parts["units"]["units"])} if "units" in parts else {}
    profiles: dict[int, Profile] = {}
    memo: dict[tuple[int, int], tuple] = {}

    def score(a: int, b: int) -> tuple:
        for x, y in ((a, b), (b, a)):
            if x in signatures:
                pair = links.get(x, {}).get(y)
                return pair, pair is not None
        key = (a, b) if a <= b else (b, a)
        if key not in memo:
            for x in key:
                if x not in profiles:
                    profiles[x] = Profile.of(_dicts(units[x]))
            pair = metric(profiles[key[0]], profiles[key[1]])
            memo[key] = (pair, accepts(pair, options))
        return memo[key]

    def look(members: list[tuple[str, int]], examined: int) -> None:
        if any(v not in signatures for _, v in members[: options.max_candidates_per_request + 1]):
            raise _Unknown(in_question(members, examined, options)[-1][0])

    def accepted(v: int, among) -> list[tuple[int, tuple[float, float]]]:
        return [(u, pair) for u, pair in links.get(v, {}).items() if u in among]

    try:
        return pd.DataFrame(_rows(domain, *greedy(every, look, accepted, score, options), signatures), columns=_COLUMNS).assign(upto=None)
    except _Unknown as e:
        return pd.DataFrame([(*domain.values(), *[None] * 6, e.args[0])], columns=[*_COLUMNS, "upto"])


def _linked(pool: DataFrame, units: DataFrame, large: DataFrame, options: AnalysisOptions, mode: str, linked_variants: int) -> DataFrame:
    """The search for large domains over the accepted pairs of the members in question, which distributed passes find.

    ``pool``: members (domain, request_id, variant); ``units``: (domain, request_id, variant, units) of each variant's
    first member; ``large``: in how many ``chunks`` each domain is scored. Centres of a pass are the variants whose
    first member lies in its span of ids.
    """
    place = F.row_number().over(Window.partitionBy(*DOMAIN).orderBy("request_id"))
    start = pool.withColumn("_r", place).where(F.col("_r") <= in_question_at_most(options)).groupBy(*DOMAIN).agg(F.max("request_id").alias("upto"))
    # written tables, so that the planner knows that they are small
    span = written(_join_domain(large.withColumn("above", F.lit("")), start), "span")
    found, links = [], None
    while True:
        flagged = _join_domain(units, span).withColumn("centre", (F.col("request_id") > F.col("above")) & (F.col("request_id") <= F.col("upto")))
        chunk = F.pmod(F.xxhash64("variant"), F.col("chunks"))
        # a centre goes to every chunk of its domain
        every = F.when(F.col("centre"), F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).otherwise(F.array(chunk))
        parts = flagged.select(*DOMAIN, "variant", "units", "centre", chunk.alias("_own"), F.explode(every).alias("_c")).withColumn("here", F.col("_c") == F.col("_own")).drop("_own")
        scored = written(parts.groupBy(*DOMAIN, "_c").applyInPandas(lambda pdf: _links(pdf, options, mode), _LINKS), "links")
        links = scored if links is None else links.unionByName(scored)
        met = links.where("what = 'units'").groupBy(*DOMAIN).agg(F.count_distinct("variant").alias("_n"))
        heavy = written(met.where(F.col("_n") > linked_variants).drop("_n"), "heavy")
        if not heavy.isEmpty():
            found.append(_rounds(_join_domain(pool, heavy), written(_join_domain(units.drop("request_id"), heavy), "variant-units"), options, mode))
            span = written(_without(span, heavy), "span")
        here = span.select(*DOMAIN)
        rows = _join_domain(links, here).unionByName(_join_domain(pool, here).withColumn("what", F.lit("member")), allowMissingColumns=True)
        searched = written(rows.groupBy(*DOMAIN).applyInPandas(lambda pdf: _search_links(pdf, options, mode), f"{COHORTS}, upto string"), "cohort-pass")
        found.append(searched.where("upto IS NULL").drop("upto"))
        further = searched.where("upto IS NOT NULL").select(*DOMAIN, "upto")
        if further.isEmpty():
            return reduce(DataFrame.unionByName, found)
        span = written(_join_domain(span.select(*DOMAIN, "chunks", F.col("upto").alias("above")), further), "span")


def _without(rows: DataFrame, domains: DataFrame) -> DataFrame:
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in DOMAIN])
    return rows.alias("a").join(domains.alias("b"), on, "left_anti")


def _rounds(pool: DataFrame, units: DataFrame, options: AnalysisOptions, mode: str) -> DataFrame:
    """The same search for large domains, one distributed pass per centre.

    ``pool``: members (domain, request_id, variant); ``units``: the units of each variant, a written table.
    """
    pool, found = written(pool, "pool"), []
    by_variant = [*DOMAIN, "variant"]
    first = Window.partitionBy(*DOMAIN).orderBy("request_id")

    def against(variants: DataFrame, judges: DataFrame) -> DataFrame:
        """(domain, variant, compat, dynamic, ok): each variant with each of its domain's judges."""
        other = _join_on(judges.select(*by_variant), units, by_variant, "inner").select(*DOMAIN, F.col("units").alias("_judge"))
        paired = _join_domain(_join_on(variants.select(*by_variant), units, by_variant, "inner"), other)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            metric = PairMetric(mode)
            for f in frames:
                pairs = [metric(Profile.of(list(j)), Profile.of(list(u))) for j, u in zip(f["_judge"], f["units"])]
                f = f.drop(columns=["_judge", "units"])
                yield f.assign(compat=[p[0] for p in pairs], dynamic=[p[1] for p in pairs], ok=[accepts(p, options) for p in pairs])
                metric.clear()

        return paired.mapInPandas(run, f"{_DOMAIN_DDL}, variant string, compat double, dynamic double, ok boolean")

    def centre_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("request_id", kind="stable")
        number: dict[str, int] = {}
        seed = [(i, number.setdefault(v, len(number))) for i, v in zip(pdf["request_id"], pdf["variant"])]
        profiles = {number[v]: Profile.of(list(u)) for v, u in zip(pdf["variant"], pdf["units"])}
        metric, memo = PairMetric(mode), {}

        def score(a: int, b: int):
            key = (min(a, b), max(a, b))
            if key not in memo:
                pair = metric(profiles[a], profiles[b])
                memo[key] = (pair, accepts(pair, options))
            return memo[key]

        def accepted(v: int, among) -> list:
            return [(u, pair) for u in among for pair, ok in (score(v, u),) if ok]

        best = pdf.iloc[[best_centre(seed, accepted)]]
        return best.drop(columns="units").assign(signature=structure_signature(list(best["units"].iloc[0])))

    def agreeing(near: DataFrame, centres: DataFrame) -> DataFrame:
        """Members of ``near`` that their domain's boundary members accept, where they are enough."""
        boundary = Window.partitionBy(*DOMAIN).orderBy("compat", F.desc("dynamic"), "request_id")
        least = near.withColumn("_k", F.row_number().over(boundary)).where(F.col("_k") <= 4).select(*by_variant, "request_id", "_k")
        numbered = row_numbers(near.select(*by_variant, "request_id", "_n"), list(DOMAIN), ["request_id"], "_i")
        quartile = F.array(*[F.floor(F.lit(q) * (F.col("_n") - 1) / 4) + 1 for q in range(5)])
        spread_ = numbered.where(F.array_contains(quartile, F.col("_i"))).select(*by_variant, "request_id", (F.col("_i") + 4).alias("_k"))
        # at most nine rows a domain
        chosen = least.unionByName(spread_).groupBy(*by_variant, "request_id").agg(F.min("_k").alias("_k"))
        judges = chosen.withColumn("_j", F.row_number().over(Window.partitionBy(*DOMAIN).orderBy("_k"))).where(F.col("_j") <= VALIDATORS).select(*by_variant).distinct()
        agreed = against(near.select(*by_variant).distinct(), written(judges, "judges")).groupBy(*by_variant).agg(F.bool_and("ok").alias("_ok")).where("_ok").drop("_ok")
        kept = _join_on(near, agreed, by_variant, "inner")
        enough = kept.groupBy(*DOMAIN).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= options.min_template_members).drop("_m")
        cohort = _join_domain(_join_domain(kept, enough), centres.select(*DOMAIN, F.col("request_id").alias("medoid_request_id"), "signature"))
        return cohort.select(*DOMAIN, "request_id", "compat", "medoid_request_id", "signature")

    for _ in range(options.max_candidates_per_request):
        alive = pool.groupBy(*DOMAIN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= options.min_template_members).drop("_n")
        pool = _join_domain(pool, alive)
        # a bound on the row number keeps that many rows per task and domain only
        seed = pool.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= options.max_candidates_per_request + 1).drop("_r")
        seed = _join_on(seed, units, by_variant, "inner")
        centres = written(seed.groupBy(*DOMAIN).applyInPandas(centre_of, f"{_DOMAIN_DDL}, request_id string, variant string, signature string"), "centres")
        if centres.isEmpty():
            return _named(found, pool)
        scored = against(pool.select(*by_variant).distinct(), centres).where("ok").drop("ok")
        near = _join_on(pool, scored, by_variant, "inner")
        total = near.groupBy(*DOMAIN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= options.min_template_members)
        near = written(_join_on(near, total, list(DOMAIN), "inner"), "near")
        gone = centres.select(*DOMAIN, "request_id")
        if not near.isEmpty():
            found.append(written(agreeing(near, centres), "cohort-round"))
            gone = gone.unionByName(found[-1].select(*DOMAIN, "request_id")).distinct()
        on = reduce(lambda x, y: x & y, [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*DOMAIN, "request_id"]])
        pool = written(pool.alias("p").join(gone.alias("g"), on, "left_anti"), "pool")
    return _named(found, pool, options.min_template_members)


def _named(found: list[DataFrame], pool: DataFrame, least: int | None = None) -> DataFrame:
    """Rows of all rounds with the cohort's id, a digest over its member ids in order, and its mean in that order."""
    out = None
    if found:
        rows = reduce(DataFrame.unionByName, found)

        def name(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("request_id", kind="stable")
            domain = {k: None if pd.isna(pdf[k].iloc[0]) else pdf[k].iloc[0] for k in DOMAIN}
            domain["time_window_key"] = int(domain["time_window_key"])
            cid = cohort_id(domain, pdf["signature"].iloc[0], list(pdf["request_id"]))
            return pdf.assign(cohort_id=cid, compatibility=pdf["compat"], cohesion=sum(pdf["compat"].tolist()) / len(pdf), skip_members=None)[_COLUMNS]

        # ids and numbers only
        out = rows.groupBy(*DOMAIN, "medoid_request_id").applyInPandas(name, COHORTS)
    left = pool.limit(0) if least is None else pool
    rest = left.groupBy(*DOMAIN).agg(F.count(F.lit(1)).alias("skip_members"))
    if least is not None:
        rest = rest.where(F.col("skip_members") >= least)
    none = lambda t: F.lit(None).cast(t)
    rest = rest.select(*DOMAIN, none("string").alias("cohort_id"), none("string").alias("medoid_request_id"), none("string").alias("request_id"), none("double").alias("compatibility"), none("double").alias("cohesion"), "skip_members")
    return rest if out is None else out.unionByName(rest)
