"""Queries that look claims up by id, and that write a result table and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.functions import rules
from claimloom.operators import analytics, registry
from claimloom.plans.claims import ranking_metrics as ranked
from claimloom.plans.documents import model_versions
from claimloom.plans.learned import anomaly_report, column_moments, proxy_decisions
from claimloom.plans.registry import query
from claimloom.sources import readers, sinks
from claimloom.sources.commits import CommitLog
from claimloom.sources.fixtures import AS_OF, Tables
from claimloom.sources.schemas import PROMOTION
from claimloom.storage import new_path

VERSION = "appeal_success-baseline"


def asked(t: Tables) -> DataFrame:
    """Claim ids that somebody asks for; some do not exist."""
    return t.raw("events").select((F.col("event_id") * 7).alias("claim_id"))


@query
def claim_lookup(t: Tables) -> DataFrame:
    return readers.lookup(t.claims, asked(t), "claim_id").select("claim_id", "claim_number", "status")


@query
def claim_lookup_missing(t: Tables) -> DataFrame:
    return readers.missing_keys(t.claims, asked(t), "claim_id")


@query
def claims_by_month(t: Tables) -> DataFrame:
    """Claims written in monthly folders, counted from what was written."""
    path = new_path(t.spark, "claims_by_month")
    sinks.write_claims_by_month(t.claims.filter(F.col("submission_date").isNotNull()), path)
    stored = t.spark.read.option("basePath", path).parquet(path)
    month = F.date_format("submission_date", "yyyy-MM").alias("month")
    return stored.groupBy(month).agg(F.count(F.lit(1)).alias("claims"), F.max("claim_amount").alias("largest"))


@query
def ranking_metric_log(t: Tables) -> DataFrame:
    """Ranking metrics of the model strategy, appended to the metric table and read back by prefix."""
    path = new_path(t.spark, "model_metrics")
    metrics = ranked(t).drop("is_best")
    sinks.append(sinks.ranking_metric_rows(metrics, VERSION), path)
    return readers.metrics_with_prefix(t.spark.read.parquet(path), "ranking_")


@query
def stored_summary(t: Tables) -> DataFrame:
    """The newest of two stored portfolio summaries, and the answer for a summary that was never computed."""
    path, absent = new_path(t.spark, "summary"), new_path(t.spark, "absent")
    totals = analytics.dashboard_totals(t.claims, t.denials)
    sinks.write_summary(totals.withColumn("total_claims", F.lit(0).cast("bigint")), path, "2000-01-01 00:00:00")
    sinks.write_summary(totals, path, AS_OF)
    states = [("portfolio", path), ("never", absent)]
    rows = [sinks.summary_state(t.spark, p, ["total_claims", "claims_at_risk"]).withColumn("name", F.lit(name)) for name, p in states]
    return rows[0].unionByName(rows[1]).select("name", "state", "total_claims", "claims_at_risk")


PREDICTION = "claim_id bigint, probability double, risk_category string, error string, model_version string"


@query
def prediction_log(t: Tables) -> DataFrame:
    """A batch scoring job over the asked-for claims with a given score: predictions and, for missing ids, error rows, committed
    to the prediction table and read back."""
    log = CommitLog(t.spark, new_path(t.spark, "predictions"), PREDICTION)
    claims = readers.lookup(t.claims, asked(t), "claim_id")
    share = (F.col("documentation_completeness") / 100.0).alias("probability")
    made = claims.select("claim_id", share).select("claim_id", "probability", rules.risk_band(F.col("probability")).alias("risk_category"))
    absent = readers.missing_keys(t.claims, asked(t), "claim_id")
    rows = made.withColumn("error", F.lit(None).cast("string")).unionByName(absent, allowMissingColumns=True)
    log.append(rows.withColumn("model_version", F.lit(VERSION)))
    return log.read()


@query
def registry_log(t: Tables) -> DataFrame:
    """Model versions in two commits, the gate's promotions after each one, and the champions that the tables then hold."""
    versions = model_versions(t).drop("metrics").withColumn("metrics", F.col("pr_auc")).drop("pr_auc")
    schema = "version_id string, model_type string, model_name string, trained_at timestamp, metrics double"
    log = CommitLog(t.spark, new_path(t.spark, "versions"), schema)
    promotions = CommitLog(t.spark, new_path(t.spark, "promotions"), PROMOTION)
    as_map = lambda df: df.withColumn("metrics", F.create_map(F.lit("pr_auc"), F.col("metrics")))
    for part in (0, 1):
        log.append(versions.filter(F.col("version_id").cast("bigint") % 2 == part))
        now = F.to_timestamp(F.lit(f"2001-10-0{part + 1} 00:00:00"))
        found = registry.promotions_of(as_map(log.read()), promoted_at=now)
        promotions.decide(lambda held, found=found: found.join(held, ["model_type", "version_id"], "left_anti"))
    current = registry.champions(log.read(), promotions.read())
    return current.select("model_type", F.col("version_id").alias("champion_version"), F.col("model_name").alias("champion_name"), F.col("metrics").alias("pr_auc"))


def _proxy_report(t: Tables) -> DataFrame:
    rows = proxy_decisions(t)
    report = anomaly_report(rows, column_moments(rows, ["claim_amount", "days_to_submission", "modifier_count", "procedure_count"]))
    return report.select("claim_id", "anomaly_score", "is_anomaly", "severity").join(t.claims.select("claim_id", "payer_id", "provider_id"), "claim_id")


@query
def anomaly_items_proxy(t: Tables) -> DataFrame:
    """The list of moderately anomalous claims of one payer, by given decisions."""
    _, items = analytics.anomaly_summary(_proxy_report(t), severity="MEDIUM", payer_id=7)
    return items


@query
def anomaly_summary_proxy(t: Tables) -> DataFrame:
    """Severity tally of all claims, by given decisions."""
    summary, _ = analytics.anomaly_summary(_proxy_report(t))
    return summary

