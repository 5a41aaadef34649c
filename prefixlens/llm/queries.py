"""Registered queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefixlens.functions.strings import clean_key
from prefixlens.functions.times import rfc3339_seconds
from prefixlens.llm import language, leakage, mixing, neardup, quantiles, spans
from prefixlens.sources import payload as P
from prefixlens.sources.tables import spread, table, written

#: Problem 1 as stated for these data: three words, 0.6, at least 40 words.
P1 = {"n": 3, "threshold": "3/5", "min_words": 40}


def last_user_texts(b: pa.RecordBatch) -> Iterator[tuple[int, str, str]]:
    """(line, model, text of the last user message) of the sound payloads of a batch."""
    for line, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        o = P.sound(text)
        if o is None or type(o.get("model")) is not str or not o["model"] or line is None:
            continue
        for m in reversed(o["messages"]):
            if m.get("role") == "user":
                yield line, o["model"], " ".join(P.content_strings(m.get("content")))
                break


def _p1(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    requests = spread(table(spark, base, "requests").select("input_line", "payload"))
    return neardup.similarity_join(requests, last_user_texts, **P1)


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return neardup.member_pairs(*_p1(spark, base))


def p1_classes(spark: SparkSession, base: str) -> DataFrame:
    return neardup.link_counts(*_p1(spark, base))


#: Problem 2: spans of 240 characters.
P2_LENGTH = 240


def tool_outputs(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(line, strings of the tool messages) of the sound payloads that declare a tool of type function."""
    for line, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        o = P.sound(text)
        if o is None or line is None:
            continue
        declared = o.get("tools")
        if type(declared) is not list or not any(type(t) is dict and t.get("type") == "function" for t in declared):
            continue
        found = [s for m in o["messages"] if m.get("role") == "tool" for s in P.content_strings(m.get("content"))]
        if found:
            yield line, found


def _p2(spark: SparkSession, base: str) -> DataFrame:
    return spans.find(spread(table(spark, base, "requests").select("input_line", "payload")), tool_outputs, P2_LENGTH)


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return spans.sharing_pairs(_p2(spark, base))


def p2_classes(spark: SparkSession, base: str) -> DataFrame:
    """One row per sharing request: its class, with the same shared windows, and what it shares with."""
    found = neardup.link_counts(*spans.sharing_classes(_p2(spark, base)))
    return found.select(F.col("id").alias("input_line"), "class_id", F.col("similar_classes").alias("sharing_classes"), F.col("similar_ids").alias("sharing_lines"))


def p2_shared(spark: SparkSession, base: str) -> DataFrame:
    """Per request: how many characters of its tool outputs stand in other requests too."""
    return spans.shared_chars(_p2(spark, base), P2_LENGTH).withColumnRenamed("id", "input_line")


#: Problem 3: (metric, percentile, the value it must exceed), and the values a group must have.
P3_LIMITS = (("ttft_ms", 0.5, 1500), ("total_ms", 0.95, 45000))
P3_METRICS = [m for m, _, _ in P3_LIMITS]
P3_LEAST = 20
_P3_KEYS = ["endpoint_key", "day"]


def latencies(records: DataFrame) -> DataFrame:
    """(endpoint_key, day since the epoch, input_line, metrics) of corpus records with a valid instant and a value."""
    usage = F.col("response_usage")
    day = F.floor(rfc3339_seconds("captured_at") / 86400).cast("int")
    rows = records.select(F.col("comparison.endpoint_key").alias("endpoint_key"), day.alias("day"), "input_line", *[usage[m].alias(m) for m in P3_METRICS])
    return rows.where(F.col("day").isNotNull() & F.coalesce(*P3_METRICS).isNotNull())


def _p3_values(spark: SparkSession, base: str) -> DataFrame:
    return written(latencies(table(spark, base, "corpus_records")), "latencies")


def _p3_digests(values: DataFrame) -> DataFrame:
    return quantiles.digest(values, _P3_KEYS, P3_METRICS, "input_line")


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("utc_day", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")).drop("day")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    """Read from the digests; only groups whose interval holds the limit are counted exactly."""
    values = _p3_values(spark, base)
    bounds = quantiles.percentiles(_p3_digests(values), [*_P3_KEYS, "metric"], tuple(sorted({q for _, q, _ in P3_LIMITS})))
    limit = F.coalesce(*[F.when((F.col("metric") == m) & (F.col("q") == F.lit(q)), F.lit(x).cast("bigint")) for m, q, x in P3_LIMITS])
    judged = written(bounds.withColumn("limit", limit).where((F.col("n") >= P3_LEAST) & F.col("limit").isNotNull() & (F.col("high") > F.col("limit"))), "quantile-bounds")
    sure = judged.where("low > limit").select(*_P3_KEYS, "metric")
    open_groups = judged.where("low <= limit").select(F.col("endpoint_key").alias("_e"), F.col("day").alias("_d"), "metric", "limit", "q", "n")
    if not open_groups.isEmpty():
        on = F.col("endpoint_key").eqNullSafe(F.col("_e")) & (F.col("day") == F.col("_d"))
        value = F.coalesce(*[F.when(F.col("metric") == m, F.col(m)) for m in P3_METRICS])
        once = values.join(open_groups, on).select(*_P3_KEYS, "metric", "limit", "q", "n", "input_line", *P3_METRICS).distinct()
        exact = once.groupBy(*_P3_KEYS, "metric", "limit", "q", "n").agg(F.count_if(value <= F.col("limit")).alias("below"))
        sure = sure.unionByName(exact.where(F.col("below") < F.col("q").cast("decimal(12,10)") * F.col("n")).select(*_P3_KEYS, "metric"))
    return _dated(sure)


def p3_daily(spark: SparkSession, base: str) -> DataFrame:
    return _dated(quantiles.percentiles(_p3_digests(_p3_values(spark, base)), [*_P3_KEYS, "metric"], (0.5, 0.9, 0.95, 0.99)))


def p3_endpoints(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles over all days of each endpoint, from the days' digests alone."""
    keys = ["endpoint_key", "metric"]
    return quantiles.percentiles(quantiles.merge(_p3_digests(_p3_values(spark, base)), keys), keys, (0.5, 0.9, 0.95, 0.99))


def p3_all(spark: SparkSession, base: str) -> DataFrame:
    """Percentiles over all endpoints and days, from the days' digests alone."""
    return quantiles.percentiles(quantiles.merge(_p3_digests(_p3_values(spark, base)), ["metric"]), ["metric"], (0.01, 0.25, 0.5, 0.75, 0.95, 0.999))


#: Problem 6: runs of 12 words.
P6_WORDS = 12


def p6_leaks(spark: SparkSession, base: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, base, "documents").select("doc_id", "text")), table(spark, base, "eval_items"), P6_WORDS)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return p6_leaks(spark, base).select("doc_id", "item_id").distinct()


def _p7(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, base, "documents").select(
        "doc_id", "source", language.language_code(F.col("lang")).alias("language"), clean_key("endpoint_key").alias("topic"), "text"
    )
    docs = spread(docs)
    targets = table(spark, base, "mix_targets")
    return mixing.mix(written(mixing.count_tokens(docs), "mixing-tokens"), targets), targets


def p7_mix(spark: SparkSession, base: str) -> DataFrame:
    return _p7(spark, base)[0]


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.shares(*_p7(spark, base))


def p8_segments(spark: SparkSession, base: str) -> DataFrame:
    return language.segments(spread(table(spark, base, "documents").select("doc_id", "lang", "text")), table(spark, base, "lang_samples"))


def p8_documents(spark: SparkSession, base: str) -> DataFrame:
    return language.document_languages(p8_segments(spark, base))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    known = [r.lang for r in table(spark, base, "lang_samples").select("lang").where("lang IS NOT NULL").distinct().orderBy("lang").collect()]
    return language.unnamed_languages(p8_segments(spark, base), known)


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_classes, p2_shared, p3_found, p3_daily, p3_endpoints, p3_all, p6_found, p6_leaks, p7_mix, p7_shares, p8_found, p8_segments, p8_documents)}

_WORDS = r"regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+')"
_P1_PAIRS = f"""
txt AS (SELECT input_line, i, p->>'$.model' AS model, CASE json_type(m, '$.content')
          WHEN 'VARCHAR' THEN m->>'$.content'
          WHEN 'ARRAY' THEN array_to_string(list_filter(list_transform(json_extract(m, '$.content[*]'), lambda b: @BLOCK@), lambda s: s IS NOT NULL), ' ') END AS t
        FROM msg JOIN sound USING (input_line) WHERE json_type(p, '$.model') = 'VARCHAR' AND p->>'$.model' <> '' AND json_type(m, '$.role') = 'VARCHAR' AND m->>'$.role' = 'user'),
latest AS (SELECT input_line, model, t FROM txt QUALIFY row_number() OVER (PARTITION BY input_line ORDER BY i DESC) = 1),
w AS (SELECT input_line, model, list_transform({_WORDS.format(x='t')}, lambda x: lower(x)) AS ws FROM latest),
g AS (SELECT DISTINCT input_line, model, unnest(list_transform(range(len(ws) - 2), lambda k: ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3])) AS g FROM w WHERE len(ws) >= 40),
n AS (SELECT input_line, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.input_line AS line_a, b.input_line AS line_b, count(*) AS c FROM g a JOIN g b ON a.model = b.model AND a.g = b.g AND a.input_line < b.input_line GROUP BY ALL),
pairs AS (SELECT line_a, line_b FROM o JOIN n x ON x.input_line = line_a JOIN n y ON y.input_line = line_b WHERE 8 * c >= 3 * (x.n + y.n))
"""
_P2_WINDOWS = f"""
fn AS (SELECT DISTINCT input_line FROM tl WHERE json_type(t, '$.type') = 'VARCHAR' AND t->>'$.type' = 'function'),
tm AS (SELECT input_line, i, m FROM msg SEMI JOIN fn USING (input_line) WHERE json_type(m, '$.role') = 'VARCHAR' AND m->>'$.role' = 'tool'),
s AS (SELECT input_line, i, -1 AS j, m->>'$.content' AS t FROM tm WHERE json_type(m, '$.content') = 'VARCHAR'
      UNION ALL SELECT input_line, i, j, @BLOCK@ FROM blk SEMI JOIN tm USING (input_line, i)),
win AS (SELECT input_line, i, j, k, substr(t, k, {P2_LENGTH}) AS w FROM (SELECT *, unnest(range(1, length(t) - {P2_LENGTH} + 2)) AS k FROM s WHERE length(t) >= {P2_LENGTH})),
shared AS (SELECT * FROM win WHERE w IN (SELECT w FROM win GROUP BY w HAVING count(DISTINCT input_line) > 1))
"""


#: Latencies per endpoint, day and metric, each row once.
_RFC = r"(\d{4})-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):([0-5]\d):([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"
_LATENCIES = f"""
once AS (SELECT DISTINCT input_line, comparison.endpoint_key AS endpoint_key, captured_at, response_usage.ttft_ms AS ttft_ms, response_usage.total_ms AS total_ms FROM corpus_records),
dated AS (SELECT *, strftime(timezone('UTC', try_cast(captured_at AS TIMESTAMPTZ)), '%Y-%m-%d') AS utc_day FROM once WHERE regexp_full_match(captured_at, '{_RFC}')),
v AS (SELECT endpoint_key, utc_day, 'ttft_ms' AS metric, ttft_ms AS x FROM dated WHERE ttft_ms IS NOT NULL AND utc_day IS NOT NULL
      UNION ALL SELECT endpoint_key, utc_day, 'total_ms', total_ms FROM dated WHERE total_ms IS NOT NULL AND utc_day IS NOT NULL)
"""


def _digest_sql(name: str, source: str, keys: str) -> str:
    """CTEs that compress ``source`` (keys, lvl, node, w) a level at a time, written from the definition of a q-digest."""
    out = [f"{name}{quantiles.DEPTH} AS (SELECT {keys}, lvl, node, sum(w) AS w, any_value(n) AS n FROM (SELECT *, sum(w) OVER (PARTITION BY {keys}) AS n FROM {source}) GROUP BY {keys}, lvl, node)"]
    for level in range(quantiles.DEPTH, 0, -1):
        out.append(f"""{name}t{level} AS (SELECT *, lvl = {level} AND sum(w) OVER (PARTITION BY {keys}, lvl IN ({level}, {level - 1}), CASE WHEN lvl = {level} THEN node // 2 ELSE node END) <= n // {quantiles.K} AS up FROM {name}{level}),
            {name}{level - 1} AS (SELECT {keys}, CASE WHEN up THEN lvl - 1 ELSE lvl END AS lvl, CASE WHEN up THEN node // 2 ELSE node END AS node, sum(w) AS w, any_value(n) AS n FROM {name}t{level} GROUP BY ALL)""")
    return ",\n".join(out)


def _percentile_sql(name: str, keys: str, qs: tuple[float, ...]) -> str:
    """Percentiles of the digests ``name``0."""
    half, zero, bits, depth = 1 << (quantiles.BITS - 1), 1 << (quantiles.DEPTH - 1), quantiles.BITS, quantiles.DEPTH
    code = lambda leaf: f"least(abs({leaf} - {zero}), {(63 - bits) * half + (1 << bits) - 1})"
    shift = lambda leaf: f"greatest({code(leaf)} // {half} - 1, 0)"
    base = lambda leaf: f"(({code(leaf)} - {shift(leaf)} * {half}) * (1::HUGEINT << {shift(leaf)}::INTEGER))"
    smallest = lambda leaf: f"CASE WHEN {leaf} < {zero} THEN -({base(leaf)} + (1::HUGEINT << {shift(leaf)}::INTEGER) - 1) ELSE {base(leaf)} END"
    largest = lambda leaf: f"CASE WHEN {leaf} < {zero} THEN -{base(leaf)} ELSE {base(leaf)} + (1::HUGEINT << {shift(leaf)}::INTEGER) - 1 END"
    return f"""
        {name}l AS (SELECT {keys}, w, n, (node * (1 << ({depth} - lvl))) AS a, ((node + 1) * (1 << ({depth} - lvl)) - 1) AS z FROM {name}0),
        {name}b AS (SELECT {keys}, w, n, {smallest('a')} AS low, {largest('z')} AS high FROM {name}l),
        {name}s AS (SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY low) AS may, sum(w) OVER (PARTITION BY {keys} ORDER BY high) AS sure FROM {name}b),
        {name}q AS (SELECT {keys}, q, any_value(n) AS n, min(low) FILTER (may >= greatest(ceil(q * n), 1)) AS low, min(high) FILTER (sure >= greatest(ceil(q * n), 1)) AS high FROM {name}s, (SELECT unnest({list(qs)}) AS q) GROUP BY {keys}, q)
        SELECT {', '.join(f'{name}q.{k.strip()}' for k in keys.split(','))}, q::DOUBLE AS q, {name}q.n::BIGINT AS n, any_value({name}q.low)::BIGINT AS low, any_value({name}q.high)::BIGINT AS high, (sum(w) - any_value(greatest(ceil(q * {name}q.n), 1)))::BIGINT AS rank_error
        FROM {name}q JOIN {name}b ON {name}b.low <= {name}q.high AND {' AND '.join(f'{name}b.{k.strip()} IS NOT DISTINCT FROM {name}q.{k.strip()}' for k in keys.split(','))} GROUP BY {', '.join(f'{name}q.{k.strip()}' for k in keys.split(','))}, q, {name}q.n"""


def _p3_sql() -> dict[str, str]:
    half, zero, bits = 1 << (quantiles.BITS - 1), 1 << (quantiles.DEPTH - 1), quantiles.BITS
    size = "abs(greatest(x, -9223372036854775807))"
    shift = f"greatest(length(ltrim({size}::BIGINT::BIT::VARCHAR, '0')) - {bits}, 0)"
    leaf = f"({shift} * {half} + ({size} >> {shift}))"
    day, keys = "endpoint_key, utc_day, metric", (0.5, 0.9, 0.95, 0.99)
    daily = f"WITH {_LATENCIES}, leaves AS (SELECT {day}, {quantiles.DEPTH} AS lvl, CASE WHEN x < 0 THEN {zero} - {leaf} ELSE {zero} + {leaf} END AS node, 1 AS w FROM v), {_digest_sql('d', 'leaves', day)}"
    return {
        "p3_daily": f"{daily}, {_percentile_sql('d', day, keys)}",
        "p3_endpoints": f"{daily}, {_digest_sql('e', '(SELECT endpoint_key, metric, lvl, node, w FROM d0)', 'endpoint_key, metric')}, {_percentile_sql('e', 'endpoint_key, metric', keys)}",
        "p3_all": f"{daily}, {_digest_sql('e', '(SELECT metric, lvl, node, w FROM d0)', 'metric')}, {_percentile_sql('e', 'metric', (0.01, 0.25, 0.5, 0.75, 0.95, 0.999))}",
    }


def _sql() -> dict[str, str]:
    from prefixlens.plans.problems import BLOCK_SQL, SOUND_SQL

    pairs = SOUND_SQL + "," + _P1_PAIRS.replace("@BLOCK@", BLOCK_SQL)
    windows = SOUND_SQL + "," + _P2_WINDOWS.replace("@BLOCK@", BLOCK_SQL)
    item = "SELECT item_id, field, list_transform(" + _WORDS.format(x="t") + ", lambda x: lower(x)) AS ws FROM (SELECT item_id, 'prompt' AS field, prompt AS t FROM eval_items UNION ALL SELECT item_id, 'answer', answer FROM eval_items)"
    leaks = f"""
        iw AS ({item}),
        ig AS (SELECT DISTINCT item_id, field, unnest(list_transform(range(1, len(ws) - {P6_WORDS} + 2), lambda k: array_to_string(ws[k : k + {P6_WORDS - 1}], ' '))) AS g FROM iw),
        dw AS (SELECT doc_id, list_transform({_WORDS.format(x="text")}, lambda x: lower(x)) AS ws FROM documents),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - {P6_WORDS} + 2), lambda k: array_to_string(ws[k : k + {P6_WORDS - 1}], ' '))) AS g FROM dw)"""
    return {
        "p6_found": f"WITH {leaks} SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
        "p6_leaks": f"""WITH {leaks},
            ip AS (SELECT item_id, field, k, array_to_string(ws[k : k + {P6_WORDS - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {P6_WORDS} + 2)) AS k FROM iw)),
            dp AS (SELECT doc_id, k, array_to_string(ws[k : k + {P6_WORDS - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - {P6_WORDS} + 2)) AS k FROM dw)),
            hit AS (SELECT doc_id, item_id, field, dp.k AS place, dp.k - ip.k AS diagonal FROM dp JOIN ip USING (g)),
            run AS (SELECT *, place - row_number() OVER (PARTITION BY doc_id, item_id, field, diagonal ORDER BY place) AS island FROM hit),
            long AS (SELECT doc_id, item_id, field, count(*) AS n FROM run GROUP BY doc_id, item_id, field, diagonal, island)
            SELECT doc_id, item_id, field, sum(n)::BIGINT AS windows, max(n) + {P6_WORDS - 1} AS longest_run FROM long GROUP BY ALL""",
        **_p3_sql(),
        "p3_found": f"""
            WITH {_LATENCIES}, g AS (SELECT *, CASE metric WHEN 'ttft_ms' THEN 50 ELSE 95 END AS q, CASE metric WHEN 'ttft_ms' THEN 1500 ELSE 45000 END AS lim FROM v)
            SELECT endpoint_key, utc_day, metric FROM g GROUP BY ALL HAVING count(*) >= 20 AND 100 * count(*) FILTER (x <= lim) < any_value(q) * count(*)""",
        "p1_found": f"WITH {pairs} SELECT line_a, line_b FROM pairs",
        "p1_classes": f"""WITH {pairs},
            s AS (SELECT input_line, model, sha256(string_agg(g, chr(1) ORDER BY g)) AS d FROM g GROUP BY ALL),
            c AS (SELECT input_line, min(input_line) OVER (PARTITION BY model, d) AS class_id FROM s),
            each AS (SELECT line_a AS x, line_b AS y FROM pairs UNION ALL SELECT line_b, line_a FROM pairs)
            SELECT a.input_line AS id, a.class_id, count(DISTINCT CASE WHEN b.class_id <> a.class_id THEN b.class_id END) AS similar_classes, count(b.input_line) AS similar_ids
            FROM c a LEFT JOIN each ON x = a.input_line LEFT JOIN c b ON b.input_line = y GROUP BY ALL""",
        "p2_found": f"WITH {windows} SELECT DISTINCT a.input_line AS line_a, b.input_line AS line_b FROM shared a JOIN shared b ON a.w = b.w AND a.input_line < b.input_line",
        "p2_classes": f"""WITH {windows},
            pairs AS (SELECT DISTINCT a.input_line AS x, b.input_line AS y FROM shared a JOIN shared b ON a.w = b.w AND a.input_line <> b.input_line),
            c AS (SELECT input_line, min(input_line) OVER (PARTITION BY d) AS class_id FROM (SELECT input_line, sha256(string_agg(w, chr(1) ORDER BY w)) AS d FROM shared GROUP BY 1))
            SELECT a.input_line, a.class_id, count(DISTINCT CASE WHEN b.class_id <> a.class_id THEN b.class_id END) AS sharing_classes, count(y) AS sharing_lines
            FROM c a LEFT JOIN pairs ON x = a.input_line LEFT JOIN c b ON b.input_line = y GROUP BY ALL""",
        "p2_shared": f"""WITH {windows},
            gaps AS (SELECT input_line, i, j, k, k - lag(k) OVER (PARTITION BY input_line, i, j ORDER BY k) AS gap FROM shared)
            SELECT input_line, sum(CASE WHEN gap IS NULL OR gap > {P2_LENGTH} THEN {P2_LENGTH} ELSE gap END)::BIGINT AS shared_chars,
                   count(*) FILTER (gap IS NULL OR gap > {P2_LENGTH}) AS stretches FROM gaps GROUP BY 1""",
    }


SQL = _sql()
