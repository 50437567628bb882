"""Model registry as append-only tables: versions, metrics and promotions."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_tag(run_ts: datetime, model_name: str) -> str:
    return f"{run_ts:%Y%m%d-%H%M%S}-{model_name}"


def version_label(model_name: str, tag: str) -> str:
    return f"{model_name}-{tag}"


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest row per key, as an aggregate."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(newest.alias("_n")).select(*key, "_n.*")


def is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and not math.isnan(value)


def champions(versions: DataFrame, promotions: DataFrame) -> DataFrame:
    """Exactly one champion per model type: the version of its latest promotion."""
    current = latest(promotions, ["model_type"], ["promoted_at", "version_id"])
    return versions.join(current.select("model_type", "version_id"), ["model_type", "version_id"], "left_semi")


def gate_history(versions: DataFrame, metric: str = "pr_auc", higher_is_better: bool = True) -> DataFrame:
    """Champion after replaying the gate over all versions of each type in time order.

    A version is promoted when it is at least as good as the champion so far, so the
    final champion is the best metric, the latest one on ties. Versions without a
    numeric metric do not take part.
    """
    value = F.col("metrics")[metric]
    valid = versions.filter(value.isNotNull() & ~F.isnan(value))
    good = value if higher_is_better else -value
    best = F.max(F.struct(good.alias("good"), "trained_at", "version_id", "model_name", value.alias("value")))
    return valid.groupBy("model_type").agg(F.count(F.lit(1)).alias("candidates"), best.alias("b")).select(
        "model_type",
        "candidates",
        F.col("b.version_id").alias("champion_version"),
        F.col("b.model_name").alias("champion_name"),
        F.col("b.value").alias(metric),
    )


#: Model types without a metric to compare: their newest version is always the champion.
UNGATED = ("anomaly",)


def promotions_of(versions: DataFrame, metric: str = "pr_auc", higher_is_better: bool = True, promoted_at: Column | None = None) -> DataFrame:
    """(model_type, version_id, promoted_at): the promotion that the gate, or for UNGATED types the newest version, gives; at
    the time of training unless another is given."""
    gated = gate_history(versions.filter(~F.col("model_type").isin(*UNGATED)), metric, higher_is_better)
    newest = latest(versions.filter(F.col("model_type").isin(*UNGATED)).select("model_type", "version_id", "trained_at"), ["model_type"], ["trained_at", "version_id"])
    chosen = gated.select("model_type", F.col("champion_version").alias("version_id")).unionByName(newest.select("model_type", "version_id"))
    when = F.col("trained_at") if promoted_at is None else promoted_at
    return chosen.join(versions.select("model_type", "version_id", when.alias("promoted_at")), ["model_type", "version_id"])


def comparison(versions: DataFrame, promotions: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Champion against challengers, best metric first (a missing metric counts 0)."""
    held = champions(versions, promotions).select("version_id", F.lit(True).alias("is_champion"))
    value = F.coalesce(F.col("metrics")[metric], F.lit(0.0))
    return (
        versions.join(held, "version_id", "left")
        .select("version_id", "model_name", "model_type", "metrics", F.coalesce("is_champion", F.lit(False)).alias("is_champion"))
        .orderBy(value.desc(), "version_id")
    )


def registry_view(versions: DataFrame, metrics: DataFrame, promotions: DataFrame) -> DataFrame:
    """Versions, newest first, with their `ranking_` metrics attached as a map."""
    ranking = (
        metrics.filter(F.col("metric_name").startswith("ranking_"))
        .groupBy("model_version_id", "metric_name")
        .agg(F.max_by("metric_value", "recorded_at").alias("v"))
        .groupBy("model_version_id")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_name", "v")))).alias("ranking_metrics"))
        .withColumnRenamed("model_version_id", "version_id")
    )
    held = champions(versions, promotions).select("version_id", F.lit(True).alias("is_champion"))
    return (
        versions.join(ranking, "version_id", "left")
        .join(held, "version_id", "left")
        .withColumn("is_champion", F.coalesce("is_champion", F.lit(False)))
        .orderBy(F.col("trained_at").desc(), "version_id")
    )
