"""Ranking of defects: one candidate per place, by blocked bytes x affected requests x confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def candidates(templates: DataFrame) -> DataFrame:
    """Defect candidates of all templates, with their comparison group."""
    return templates.where(F.col("limitation").isNull()).select("comparison_group", F.explode("candidates").alias("d")).select("comparison_group", "d.*")


def unique_defects(found: DataFrame) -> DataFrame:
    """Of candidates with one id the most cautious: fewest blocked bytes, affected, confidence, then member.

    One candidate per template and place bounds the group of an id.
    """
    order = Window.partitionBy("id").orderBy("blocked_stable_bytes", "affected_count", "confidence", "representative_member_id")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def scored(defects: DataFrame) -> DataFrame:
    return defects.withColumn("score", F.col("blocked_stable_bytes").cast("double") * F.col("affected_count").cast("double") * F.col("confidence"))


def ranking(defects: DataFrame) -> DataFrame:
    return defects.orderBy(F.desc("score"), F.desc("affected_count"), F.desc("blocked_stable_bytes"), "id")


def rank_defects(found: DataFrame) -> DataFrame:
    return ranking(scored(unique_defects(found)))


def top_k(defects: DataFrame, k: int) -> DataFrame:
    """(rank, defect_id) of the first k; the limit is the feature."""
    best = ranking(defects).limit(k)
    order = Window.orderBy(F.desc("score"), F.desc("affected_count"), F.desc("blocked_stable_bytes"), "id")
    return best.select(F.row_number().over(order).alias("rank"), F.col("id").alias("defect_id"))
