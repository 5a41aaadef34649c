"""The chain of a template's coordinates, with what varies in each slot and which defects touch it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefixlens.options import AnalysisOptions


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """Distinct sorted ``value`` of right rows whose [start, end) overlaps the left row's, per left ``id``."""
    l, r = left.alias("l"), right.alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("r.start") < F.col("l.end"), F.col("l.start") < F.col("r.end")]
    return l.join(r, on).groupBy("l.id").agg(F.array_sort(F.collect_set(f"r.{value}")).alias(name))


def prefix_nodes(templates: DataFrame, defects: DataFrame, options: AnalysisOptions = AnalysisOptions()) -> DataFrame:
    """One row per node: the coordinates up to the cap, chained, with the defects of overlapping evidence."""
    if options.prefix_view_max_nodes == 0:
        templates = templates.limit(0)
    t = templates.where(F.col("limitation").isNull())
    nodes = t.select(F.col("id").alias("template_id"), F.size("coordinates").alias("nodes"), "coordinate_count", F.explode("coordinates").alias("c")).withColumn("key", F.concat("template_id", F.lit("/"), F.col("c.ordinal").cast("string")))
    slots = nodes.where("c.kind = 'dynamic'").select(F.col("key").alias("id"), "template_id", F.col("c.source.json_path").alias("path"), F.col("c.source.byte_start").alias("start"), F.col("c.source.byte_end").alias("end"))
    evidence = defects.select("template_id", F.col("id").alias("defect_id"), F.explode("variants").alias("v")).select("template_id", "defect_id", F.explode("v.representative.sources").alias("s"))
    ranges = evidence.select("template_id", "defect_id", F.col("s.json_path").alias("path"), F.col("s.byte_start").alias("start"), F.col("s.byte_end").alias("end")).distinct()
    touched = overlap_join(slots, ranges, ["template_id", "path"], "defect_ids", "defect_id").withColumnRenamed("id", "key")
    nothing = F.array().cast("array<string>")
    return nodes.join(touched, "key", "left").select(
        "template_id", (F.col("coordinate_count") > F.col("nodes")).alias("truncated"), F.concat(F.lit("seq-"), F.col("c.ordinal").cast("string")).alias("id"), F.col("c.ordinal").alias("ordinal"), F.col("c.kind").alias("kind"), F.col("c.source").alias("source"),
        F.col("c.utf8_bytes").alias("utf8_bytes"), F.col("c.support_count").alias("support_count"), F.col("c.support_ratio").alias("support_ratio"), F.col("c.excerpt").alias("excerpt"),
        F.col("c.member_request_ids").alias("member_request_ids"), F.col("c.content_sample").alias("content_sample"),
        F.when(F.col("c.ordinal") + 1 < F.col("nodes"), F.concat(F.lit("seq-"), (F.col("c.ordinal") + 1).cast("string"))).alias("sequence_child"), nothing.alias("internal_children"),
        F.col("c.variants").alias("variants"), F.coalesce("defect_ids", nothing).alias("defect_ids"),
    )
