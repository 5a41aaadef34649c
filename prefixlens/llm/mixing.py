"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source x language x topic. Cell weights (copies per document) are raked in turn
to each dimension's marginal until they settle: sources to their targets, languages and topics to the shares
they have among the documents. No weight exceeds its source's cap. The last step is always the source's:
within a source the weights not yet at the cap are scaled until its tokens meet the target or all are capped,
so a source falls short only if all its documents at full repetition do. Documents are then drawn with their
cell's weight as calibrated probability: the whole part as copies, the fractions by systematic sampling along
their running sum over all documents of the source in order of size. As neighbours are of like size, a source's
tokens come within one document (its largest) of what they should be.

Every language and topic is fitted. Up to ``most_cells`` observed cells are raked on the driver; more of them
stay a table, raked by the same rounds as joins, with equal results.

Defined cases: documents of other or null sources are left out; a null or blank language or topic is a value
of its own; empty texts have no tokens and are left out; a repeated document is another document; a
target without documents is reported with 0; no documents give an empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefixlens.functions.strings import unicode_trim
from prefixlens.operators.ordering import running_sums
from prefixlens.sources.tables import drop_written, last_written, written

#: Public byte-level BPE vocabulary as ranks, and the pattern that splits text before it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cells raked on the driver and broadcast; beyond, both are joins.
CELLS = 100_000
#: Parts of a copy that running sums count in.
UNIT = 1 << 24
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("mixing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, out: str = "tokens") -> DataFrame:
    """df without ``text`` and with its number of tokens; a null text has 0."""
    keep = [c for c in df.columns if c != text]
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for b in batches:
            counts = [len(encode(t)) if t else 0 for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, pa.int64())], names=[*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(run, schema)


def source_name(c: Column) -> Column:
    """Sources compare without case, separators and outer blanks."""
    return F.regexp_replace(F.lower(unicode_trim(c)), r"[\s_\-]+", "_")


def rake(cells: np.ndarray, tokens: np.ndarray, targets: dict[int, float], caps: dict[int, float], total: float, rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Weights of cells (rows of codes, source first) fitted to the marginals under the caps."""
    source = cells[:, 0]
    cap = np.array([caps[s] for s in source], float)
    w = np.minimum(np.full(len(tokens), total / max(tokens.sum(), 1)), cap)
    wanted = []
    for d in range(1, cells.shape[1]):
        codes = cells[:, d]
        share = np.bincount(codes, tokens)
        wanted.append((codes, share / share.sum() * total))

    def to_sources(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for s, share in targets.items():
            mine = source == s
            goal = share * total
            for _ in range(64):
                free = mine & (w < cap)
                left = goal - (w * tokens)[mine & ~free].sum()
                have = (w * tokens)[free].sum()
                if not free.any() or have <= 0:
                    break
                w[free] = np.minimum(w[free] * max(left, 0) / have, cap[free])
                if abs((w * tokens)[mine].sum() - goal) <= tolerance * total:
                    break
        return w

    for _ in range(rounds):
        before = w
        for codes, goal in wanted:
            have = np.bincount(codes, w * tokens, len(goal))
            ratio = np.divide(goal, have, out=np.ones_like(goal), where=have > 0)
            w = np.minimum(w * ratio[codes], cap)
        w = to_sources(w)
        if np.abs(w - before).max(initial=0) <= tolerance * max(1.0, w.max(initial=0)):
            break
    return w


def rake_table(cells: DataFrame, targets: dict[str, float], caps: dict[str, float], total: float, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """``cells`` (source, language, topic, tokens, ...) with their weight: rake() without cells on the driver."""
    spark = cells.sparkSession
    by_source = lambda values: F.create_map(*[F.lit(x) for s, v in values.items() for x in (s, float(v))])[F.col("source")]
    held = F.col("weight") * F.col("tokens")
    every = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    at = cells.withColumn("_cap", by_source(caps)).withColumn("weight", F.least(F.lit(total / max(every, 1)), "_cap"))
    wanted = {d: written(cells.groupBy(d).agg((F.sum("tokens") / every * total).alias("_goal")), "mixing-goals") for d in ("language", "topic")}
    last = None
    for _ in range(rounds):
        step = at.withColumn("_before", F.col("weight"))
        for d, goal in wanted.items():
            have = step.groupBy(d).agg(F.sum(held).alias("_have"))
            ratio = goal.join(have, d).select(d, F.when(F.col("_have") > 0, F.col("_goal") / F.col("_have")).otherwise(1.0).alias("_ratio"))
            step = step.join(ratio, d).withColumn("weight", F.least(F.col("weight") * F.col("_ratio"), "_cap")).drop("_ratio")
        step, before = written(step, "mixing-round"), last
        last = last_written()
        scale = {s: 1.0 for s in targets}
        for _ in range(64):
            scaled = F.when(F.col("weight") < F.col("_cap"), F.least(F.col("weight") * by_source(scale), "_cap")).otherwise(F.col("weight"))
            free = scaled < F.col("_cap")
            sums = step.groupBy("source").agg(F.sum(F.when(free, 0.0).otherwise(scaled * F.col("tokens"))).alias("full"), F.sum(F.when(free, scaled * F.col("tokens")).otherwise(0.0)).alias("have")).collect()  # a row per source
            open_ = [r for r in sums if r.have > 0 and abs(r.full + r.have - targets[r.source] * total) > tolerance * total]
            if not open_:
                break
            for r in open_:
                scale[r.source] *= max(targets[r.source] * total - r.full, 0) / r.have
        scaled = F.when(F.col("weight") < F.col("_cap"), F.least(F.col("weight") * by_source(scale), "_cap")).otherwise(F.col("weight"))
        step = step.withColumn("weight", scaled)
        moved, most = step.agg(F.max(F.abs(F.col("weight") - F.col("_before"))), F.max("weight")).first()
        at = step.drop("_before")
        if before:
            drop_written(spark, [before])
        if (moved or 0) <= tolerance * max(1.0, most or 0):
            break
    return at.drop("_cap")


def reachable_total(tokens: dict[int, float], targets: dict[int, float], caps: dict[int, float]) -> float:
    """The largest total at which every source that has documents meets its share."""
    return min((tokens[s] * caps[s] / t for s, t in targets.items() if t > 0 and tokens.get(s, 0) > 0), default=0.0)


def mix(counted: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17, most_cells: int = CELLS) -> DataFrame:
    """Chosen documents: doc_id, source, tokens, weight, copies (at least 1).

    ``counted``: doc_id, source, language, topic, tokens, as a written table; it is read several times.
    ``targets``: source, target_share, max_repeats. ``total`` defaults to the largest all sources can meet.
    """
    spark = counted.sparkSession
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()  # a row per source with a target
    code = {r.source: i for i, r in enumerate(rows)}
    goals, caps = {i: r.target_share for i, r in enumerate(rows)}, {i: float(r.max_repeats) for i, r in enumerate(rows)}
    docs = counted.withColumn("source", source_name(F.col("source"))).where(F.col("source").isin(list(code)) & (F.col("tokens") > 0))
    # no key holds this character alone
    docs = docs.withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("language", "topic")})
    key = ["source", "language", "topic"]
    cells = written(docs.groupBy(*key).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mixing-cells")
    sums = {r.source: (r.tokens, r.cells) for r in cells.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("cells")).collect()}  # a row per source
    n = sum(c for _, c in sums.values())
    if total is None:
        total = reachable_total({code[s]: float(t) for s, (t, _) in sums.items()}, goals, caps)
    few = n <= most_cells
    if few:
        local = cells.orderBy(*key).toPandas()  # at most ``most_cells`` rows
        number = lambda s: s.astype("category").cat.codes.to_numpy().astype(int)
        codes = np.column_stack([local["source"].map(code).to_numpy(dtype=int), number(local["language"]), number(local["topic"])]) if n else np.zeros((0, 3), int)
        local = local.assign(weight=rake(codes, local["tokens"].to_numpy(dtype=float), goals, caps, float(total)))
        table = spark.createDataFrame(local, "source string, language string, topic string, tokens bigint, docs bigint, weight double")
    else:
        table = rake_table(cells, {s: goals[i] for s, i in code.items()}, {s: caps[i] for s, i in code.items()}, float(total))
    weighted = docs.join(F.broadcast(table.select(*key, "weight")) if few else table.select(*key, "weight"), key)
    weighted = weighted.select("doc_id", "source", "tokens", "weight", F.xxhash64("doc_id", F.lit(seed)).alias("_h"), F.round((F.col("weight") - F.floor("weight")) * UNIT).cast("bigint").alias("_part"))
    summed = running_sums(weighted, ["source"], ["tokens", "_h", "doc_id"], "_part", "_upto").withColumn("_phase", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT)))
    drawn = summed.withColumn("copies", (F.floor("weight") + F.shiftright(F.col("_upto") + F.col("_phase"), 24) - F.shiftright(F.col("_upto") - F.col("_part") + F.col("_phase"), 24)).cast("bigint"))
    return drawn.where("copies > 0").select("doc_id", "source", "tokens", "weight", "copies")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target and reached share, tokens, documents and the most copies of one."""
    by = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    total = by.agg(F.sum("tokens").alias("total"))  # one row
    goal = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return goal.join(by, "source", "left").join(F.broadcast(total)).select(
        "source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("reached_share"),
        zero("tokens"), zero("documents"), zero("most_copies"), "max_repeats",
    )
