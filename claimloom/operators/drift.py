"""Distribution drift between a reference and a current slice.

All numeric features go through one shuffle: values are unpivoted, collapsed to
distinct (feature, value) counts, ordered once, and both the KS statistic and the
decile histogram are read from the same running counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.numbers import half_up
from claimloom.functions.rules import drift_status
from claimloom.operators.ordered import exact_quantiles, ordered_prefix
from claimloom.storage import materialize

EPSILON = 1e-6
MIN_PER_SIDE = 10
MIN_ROWS = 20


def tagged(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both slices in one frame with `is_ref`."""
    names = list(columns)
    return reference.select(*names, F.lit(True).alias("is_ref")).unionByName(
        current.select(*names, F.lit(False).alias("is_ref"))
    )


def tagged_by(df: DataFrame, reference: Column, current: Column, columns: Sequence[str]) -> DataFrame:
    """As `tagged`, from one pass over `df` and a filter per slice."""
    sides = F.array(F.when(reference, True), F.when(current, False))
    return df.select(*columns, F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("is_ref"))


def _numeric_counts(both: DataFrame, features: Sequence[str]) -> DataFrame:
    doubled = both.select("is_ref", *[F.col(f).cast("double").alias(f) for f in features])
    long = doubled.unpivot(["is_ref"], list(features), "feature_name", "value")
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("feature_name", "value")
        .agg(
            F.count_if("is_ref").alias("n_ref"),
            F.count_if(~F.col("is_ref")).alias("n_cur"),
        )
    )


def numeric_prefix(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct (feature_name, value) with counts and running counts of both slices."""
    return ordered_prefix(_numeric_counts(both, features), ["value"], ["n_ref", "n_cur"], ["feature_name"])


@dataclass(frozen=True)
class Profile:
    """Row counts of both slices and the distinct reference quantiles of one feature."""

    ref_total: int
    cur_total: int
    edges: tuple[float, ...]


def feature_profiles(prefix: DataFrame, bins: int = 10) -> dict[str, Profile]:
    """Profiles by feature, at most bins + 1 numbers each, so they travel as literals."""
    totals = prefix.groupBy("feature_name").agg(F.sum("n_ref").alias("n_total"), F.sum("n_cur").alias("cur_total"))
    probs = [i / bins for i in range(bins + 1)]
    quantiles = exact_quantiles(
        prefix.filter(F.col("n_ref") > 0), "value", "n_ref", totals.drop("cur_total"), probs, ["feature_name"]
    )
    rows = totals.join(quantiles, "feature_name", "left").select("*", F.array_distinct("quantiles").alias("edges"))
    return {
        r["feature_name"]: Profile(r["n_total"], r["cur_total"], tuple(r["edges"] or ())) for r in rows.collect()
    }


def _by_feature(values: dict[str, Column]) -> Column:
    """Look up a literal by the row's feature_name."""
    chain = F.lit(None)
    for name, value in values.items():
        chain = F.when(F.col("feature_name") == name, value).otherwise(chain)
    return chain


def _counts_of(profiles: dict[str, Profile], field: str) -> Column:
    return _by_feature({name: F.lit(getattr(p, field)) for name, p in profiles.items()})


def histogram(prefix: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """Counts of both slices per (feature_name, bin); the last bin is closed, outside values drop out.

    Bins without any row are not listed.
    """
    binnable = {n: p.edges for n, p in profiles.items() if len(p.edges) >= 2}
    if not binnable:
        return prefix.limit(0).select(
            "feature_name", F.lit(1).alias("bin"), F.col("n_ref").alias("ref_count"), F.col("n_cur").alias("cur_count")
        )
    arrays = _by_feature({n: F.array(*[F.lit(e) for e in edges]) for n, edges in binnable.items()})
    placed = prefix.select("feature_name", "value", "n_ref", "n_cur", arrays.alias("edges")).filter(
        F.col("value").between(F.element_at("edges", 1), F.element_at("edges", -1))
    )
    index = F.least(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.size("edges") - 1)
    return placed.groupBy("feature_name", index.alias("bin")).agg(
        F.sum("n_ref").alias("ref_count"), F.sum("n_cur").alias("cur_count")
    )


def _psi_term(ref_share: Column, cur_share: Column) -> Column:
    r, c = ref_share + EPSILON, cur_share + EPSILON
    return (c - r) * F.ln(c / r)


def _one_row_each(spark: SparkSession, profiles: dict[str, Profile]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in profiles], "feature_name string")


def psi_numeric(prefix: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """PSI per numeric feature over reference deciles.

    0 when a slice has fewer than 10 values or the reference has fewer than 3 edges. A bin
    that is empty on both sides adds nothing, so it need not be listed.
    """
    usable = {
        n: p
        for n, p in profiles.items()
        if p.ref_total >= MIN_PER_SIDE and p.cur_total >= MIN_PER_SIDE and len(p.edges) >= 3
    }
    counts = histogram(prefix, usable)
    # At most `bins` rows per feature.
    per_feature = Window.partitionBy("feature_name")
    shares = counts.select(
        "feature_name",
        (F.col("ref_count") / F.greatest(F.sum("ref_count").over(per_feature), F.lit(1))).alias("r"),
        (F.col("cur_count") / F.greatest(F.sum("cur_count").over(per_feature), F.lit(1))).alias("c"),
    )
    psi = shares.groupBy("feature_name").agg(half_up(F.sum(_psi_term(F.col("r"), F.col("c"))), 6).alias("psi"))
    everywhere = _one_row_each(prefix.sparkSession, profiles)
    return everywhere.join(psi, "feature_name", "left").select("feature_name", F.coalesce("psi", F.lit(0.0)).alias("psi"))


def ks_two_sample(prefix: DataFrame, profiles: dict[str, Profile]) -> DataFrame:
    """Two-sample KS statistic per feature with the asymptotic p-value."""
    usable = {n: p for n, p in profiles.items() if p.ref_total > 0 and p.cur_total >= 2}
    nr, nc = _counts_of(usable, "ref_total"), _counts_of(usable, "cur_total")
    gap = F.abs(F.col("cum_n_ref") / nr - F.col("cum_n_cur") / nc)
    stats = prefix.groupBy("feature_name").agg(F.max(gap).alias("d"))
    z = F.col("d") * F.sqrt(nr * nc / (nr + nc))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z),
    )
    p = F.when(z < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * series)))
    return stats.select(
        "feature_name",
        F.coalesce(half_up(F.col("d"), 6), F.lit(0.0)).alias("ks_statistic"),
        F.when(F.col("d").isNotNull(), half_up(p, 6)).otherwise(1.0).alias("ks_pvalue"),
    )


def category_counts(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows per (feature_name, category) in both slices, nulls as their own category."""
    text = both.select("is_ref", *[F.col(f).cast("string").alias(f) for f in features])
    return (
        text.unpivot(["is_ref"], list(features), "feature_name", "category")
        .groupBy("feature_name", "category")
        .agg(F.count_if("is_ref").alias("n_ref"), F.count_if(~F.col("is_ref")).alias("n_cur"))
    )


def category_shares(counts: DataFrame) -> DataFrame:
    """Share of each non-null category among the non-null rows of its slice (4 decimals)."""
    known = counts.filter(F.col("category").isNotNull())
    totals = known.groupBy("feature_name").agg(F.sum("n_ref").alias("tr"), F.sum("n_cur").alias("tc"))
    return known.join(totals, "feature_name").select(
        "feature_name",
        "category",
        half_up(F.col("n_ref") / F.greatest("tr", F.lit(1)), 4).alias("reference_share"),
        half_up(F.col("n_cur") / F.greatest("tc", F.lit(1)), 4).alias("current_share"),
    )


def psi_categorical(counts: DataFrame) -> DataFrame:
    """PSI per categorical feature; the denominators count null rows too."""
    totals = counts.groupBy("feature_name").agg(F.sum("n_ref").alias("tr"), F.sum("n_cur").alias("tc"))
    term = _psi_term(F.col("n_ref") / F.greatest("tr", F.lit(1)), F.col("n_cur") / F.greatest("tc", F.lit(1)))
    psi = (
        counts.filter(F.col("category").isNotNull())
        .join(totals, "feature_name")
        .groupBy("feature_name")
        .agg(F.sum(term).alias("psi"))
    )
    return totals.join(psi, "feature_name", "left").select(
        "feature_name", half_up(F.coalesce("psi", F.lit(0.0)), 6).alias("psi")
    )


def slice_stats(both: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and null rate of every feature in both slices, from one global aggregate."""
    aggregates = []
    for side, inside in (("ref", F.col("is_ref")), ("cur", ~F.col("is_ref"))):
        aggregates.append(F.count_if(inside).alias(f"{side}_rows"))
        for f in features:
            value = F.when(inside, F.col(f).cast("decimal(28,8)"))
            aggregates.append(F.sum(value).cast("double").alias(f"{side}_sum_{f}"))
            aggregates.append(F.count(value).alias(f"{side}_n_{f}"))
    wide = both.agg(*aggregates)

    def entry(f: str) -> Column:
        columns = [F.lit(f).alias("feature_name")]
        for side in ("ref", "cur"):
            n, rows = F.col(f"{side}_n_{f}"), F.col(f"{side}_rows")
            columns.append(F.when(n > 0, F.col(f"{side}_sum_{f}") / n).alias(f"{side}_mean"))
            columns.append(F.when(rows > 0, 1.0 - n / rows).alias(f"{side}_null_rate"))
        return F.struct(*columns)

    return wide.select(F.explode(F.array(*[entry(f) for f in features])).alias("s")).select("s.*")


def missing_drift(stats: DataFrame, warning: float = 0.10) -> DataFrame:
    """Absolute change of the null rate; a warning at most, never critical."""
    change = F.abs(F.col("cur_null_rate") - F.col("ref_null_rate"))
    return stats.select(
        "feature_name",
        half_up(F.col("ref_null_rate"), 6).alias("baseline_value"),
        half_up(F.col("cur_null_rate"), 6).alias("current_value"),
        half_up(change, 6).alias("drift_score"),
        F.when(change >= warning, "WARNING").otherwise("NORMAL").alias("status"),
        (change >= warning).alias("is_drift_detected"),
    )


def drift_report(
    both: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    warning: float = 0.10,
    critical: float = 0.25,
) -> DataFrame:
    """One row per metric: numeric PSI with KS, missing rate, categorical PSI.

    `both` is a tagged frame; it is written once because three aggregates read it. Fewer
    than MIN_ROWS rows give no metric.
    """
    both = materialize(both.select(*numeric, *categorical, "is_ref"), "drift")
    few = both.limit(MIN_ROWS).count() < MIN_ROWS
    prefix = numeric_prefix(both, numeric)
    profiles = feature_profiles(prefix)
    stats = slice_stats(both, numeric)
    status = drift_status(F.col("psi"), warning, critical)
    numeric_rows = (
        psi_numeric(prefix, profiles)
        .join(ks_two_sample(prefix, profiles), "feature_name", "left")
        .join(stats, "feature_name", "right")
        .select(
            F.lit("data_drift").alias("metric_type"),
            F.lit("PSI").alias("metric_name"),
            "feature_name",
            half_up(F.col("ref_mean"), 6).alias("baseline_value"),
            half_up(F.col("cur_mean"), 6).alias("current_value"),
            F.coalesce("psi", F.lit(0.0)).alias("drift_score"),
            F.coalesce(status, F.lit("NORMAL")).alias("status"),
            F.coalesce(F.col("psi") >= warning, F.lit(False)).alias("is_drift_detected"),
            F.coalesce("ks_statistic", F.lit(0.0)).alias("ks_statistic"),
            F.coalesce("ks_pvalue", F.lit(1.0)).alias("ks_pvalue"),
        )
    )
    missing_rows = missing_drift(stats, warning).select(
        F.lit("missing_value").alias("metric_type"), F.lit("missing_rate").alias("metric_name"), "*"
    )
    counts = category_counts(both, categorical)
    shares = category_shares(counts)
    # Maps hold one entry per category code of the feature.
    maps = shares.groupBy("feature_name").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("reference_share") > 0, F.struct("category", "reference_share"))))
        ).alias("reference_distribution"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.when(F.col("current_share") > 0, F.struct("category", "current_share"))))
        ).alias("current_distribution"),
    )
    category_rows = (
        psi_categorical(counts)
        .join(maps, "feature_name", "left")
        .select(
            F.lit("data_drift").alias("metric_type"),
            F.lit("PSI").alias("metric_name"),
            "feature_name",
            F.lit(0.0).alias("baseline_value"),
            F.lit(0.0).alias("current_value"),
            F.col("psi").alias("drift_score"),
            status.alias("status"),
            (F.col("psi") >= warning).alias("is_drift_detected"),
            "reference_distribution",
            "current_distribution",
        )
    )
    report = numeric_rows.unionByName(missing_rows, allowMissingColumns=True).unionByName(
        category_rows, allowMissingColumns=True
    )
    return report.limit(0) if few else report


def prediction_drift(reference: DataFrame, current: DataFrame, score: str, warning: float = 0.10, critical: float = 0.25):
    """PSI, means and share at or above 0.5 of a score column; one row."""
    both = tagged(reference, current, [score])
    prefix = numeric_prefix(both, [score])
    psi = psi_numeric(prefix, feature_profiles(prefix))
    value = F.col(score)

    def mean(inside: Column, of: Column) -> Column:
        return F.sum(F.when(inside, of.cast("decimal(28,8)"))).cast("double") / F.count(F.when(inside, of))

    inside, outside = F.col("is_ref"), ~F.col("is_ref")
    high = (value >= 0.5).cast("int")
    stats = both.agg(
        half_up(mean(inside, value), 6).alias("baseline_value"),
        half_up(mean(outside, value), 6).alias("current_value"),
        half_up(mean(inside, high), 4).alias("reference_high_risk_pct"),
        half_up(mean(outside, high), 4).alias("current_high_risk_pct"),
    ).withColumn("feature_name", F.lit(score))
    return psi.join(stats, "feature_name").select(
        F.lit("prediction_drift").alias("metric_type"),
        F.lit("PSI").alias("metric_name"),
        "feature_name",
        "baseline_value",
        "current_value",
        F.col("psi").alias("drift_score"),
        drift_status(F.col("psi"), warning, critical).alias("status"),
        (F.col("psi") >= warning).alias("is_drift_detected"),
        "reference_high_risk_pct",
        "current_high_risk_pct",
    )


def status_tally(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("n_metrics_computed"),
        F.count_if(F.col("status") == "WARNING").alias("n_warning"),
        F.count_if(F.col("status") == "CRITICAL").alias("n_critical"),
    )


def segment_drift(df: DataFrame, segment: str, score: str, bins: int = 10) -> DataFrame:
    """Score distribution of each segment against all rows: count, mean, median and PSI.

    Values collapse to (segment, score) counts first. Edges come from the overall order,
    one array for all segments.
    """
    counts = df.filter(F.col(score).isNotNull()).groupBy(segment, F.col(score).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    overall = counts.groupBy("value").agg(F.sum("n").alias("n_ref")).select(
        F.lit(score).alias("feature_name"), "value", "n_ref", F.lit(0).cast("bigint").alias("n_cur")
    )
    whole = ordered_prefix(overall, ["value"], ["n_ref"], ["feature_name"])
    profile = feature_profiles(whole, bins)
    if not profile:
        return counts.limit(0).select(
            segment, "n", *[F.lit(0.0).alias(c) for c in ("mean_score", "median_score", "psi")]
        ).withColumnRenamed("n", "rows")
    edges = profile[score].edges
    everywhere = {r["bin"]: r["ref_count"] for r in histogram(whole, profile).collect()}
    total = max(sum(everywhere.values()), 1)
    bounds = F.array(*[F.lit(e) for e in edges])
    index = F.least(F.size(F.filter(bounds, lambda e: e <= F.col("value"))), F.lit(max(len(edges) - 1, 1)))
    per_bin = counts.groupBy(segment, index.alias("bin")).agg(F.sum("n").alias("n"))
    segments = counts.groupBy(segment).agg(
        F.sum("n").alias("rows"),
        (F.sum(F.col("value").cast("decimal(20,8)") * F.col("n")).cast("double") / F.sum("n")).alias("mean_score"),
    )
    bin_shares = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(n / total).alias("share")) for b, n in everywhere.items()])
    grid = segments.select(segment, "rows", F.explode(bin_shares).alias("b")).select(segment, "rows", "b.*")
    full = grid.join(per_bin, [segment, "bin"], "left")
    term = _psi_term(F.col("share"), F.coalesce("n", F.lit(0)) / F.col("rows"))
    psi = full.groupBy(segment).agg(half_up(F.sum(term), 6).alias("psi"))
    ranked = ordered_prefix(counts, ["value"], ["n"], [segment])
    medians = exact_quantiles(
        ranked, "value", "n", segments.select(segment, F.col("rows").alias("n_total")), [0.5], [segment]
    ).select(segment, half_up(F.element_at("quantiles", 1), 6).alias("median_score"))
    return (
        segments.join(medians, segment)
        .join(psi, segment)
        .select(segment, "rows", half_up(F.col("mean_score"), 6).alias("mean_score"), "median_score", "psi")
    )
