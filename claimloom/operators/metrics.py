"""Ranking, binary, multiclass and calibration metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions.numbers import half_up, money
from claimloom.operators.ordered import ordered_prefix

K_VALUES = (5, 10, 20)
# Fixed value: appeals without which a ranking says nothing.
MIN_ITEMS = 20
RANDOM_SHUFFLES = 50


def dcg_expr(relevance: Column, position: Column, k: int) -> Column:
    """Sum over the first k positions of relevance / log2(position + 1)."""
    return F.coalesce(F.sum(F.when(position <= k, relevance / F.log2(position + 1))), F.lit(0.0))


def _top(long: DataFrame, order: list[Column], k: int) -> DataFrame:
    window = Window.partitionBy("strategy").orderBy(*order)
    return long.withColumn("pos", F.row_number().over(window)).filter(F.col("pos") <= k)


def ranking_metrics(
    long: DataFrame, score: str, binary: str, dollar: str, key: str, k_values: Sequence[int] = K_VALUES
) -> DataFrame:
    """Precision, NDCG and captured share at each k, per `strategy`.

    Only the first max(k) rows of each order are ranked: Spark prunes every task to
    that many rows per strategy before the shuffle.
    """
    top_k = max(k_values)
    by_score = _top(long, [F.col(score).desc(), F.col(key).asc()], top_k)
    ideal = _top(long, [F.col(dollar).desc(), F.col(key).asc()], top_k)
    pos, rel = F.col("pos"), F.col(dollar)
    ranked = by_score.groupBy("strategy").agg(
        *[
            (F.count_if((pos <= k) & (F.col(binary) > 0)) / F.count_if(pos <= k)).alias(f"p_{k}")
            for k in k_values
        ],
        *[dcg_expr(rel, pos, k).alias(f"dcg_{k}") for k in k_values],
        *[F.sum(F.when(pos <= k, money(rel))).cast("double").alias(f"got_{k}") for k in k_values],
    )
    best = ideal.groupBy("strategy").agg(*[dcg_expr(rel, pos, k).alias(f"ideal_{k}") for k in k_values])
    totals = long.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(money(rel)).cast("double").alias("total")
    )
    joined = ranked.join(best, "strategy").join(totals, "strategy")
    return joined.select(
        "strategy",
        *[half_up(F.col(f"p_{k}"), 4).alias(f"precision_at_{k}") for k in k_values],
        *[
            half_up(F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).otherwise(0.0), 4).alias(
                f"ndcg_at_{k}"
            )
            for k in k_values
        ],
        *[
            half_up(F.when(F.col("total") > 0, F.col(f"got_{k}") / F.col("total")).otherwise(0.0), 4).alias(
                f"recovery_captured_at_{k}"
            )
            for k in k_values
        ],
        "n_items",
    )


def strategies_long(df: DataFrame, strategies: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    options = F.array(
        *[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("score")) for n, c in strategies.items()]
    )
    return df.select(*keep, F.explode(options).alias("_o")).select(*keep, "_o.strategy", "_o.score")


def random_baseline(
    df: DataFrame, binary: str, dollar: str, key: str, k_values: Sequence[int] = K_VALUES,
    shuffles: int = RANDOM_SHUFFLES, seed: int = 42,
) -> DataFrame:
    """Mean ranking metrics over seeded random orders.

    A random order is the order of a hash of (key, shuffle). Only rows with a small hash
    can be among the first max(k), so the others are not emitted; when a shuffle would
    come up short the bound is lifted and every row takes part.
    """
    top_k = max(k_values)
    rows = df.count()
    share = min(1.0, 20.0 * top_k / max(rows, 1))

    def shuffled(bound: float) -> DataFrame:
        draws = F.transform(
            F.sequence(F.lit(1), F.lit(shuffles)),
            lambda i: F.struct(
                i.cast("string").alias("strategy"),
                (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("score"),
            ),
        )
        kept = F.filter(draws, lambda d: d["score"] < bound) if bound < 1.0 else draws
        return df.select(key, binary, dollar, F.explode(kept).alias("_d")).select(key, binary, dollar, "_d.*")

    long = shuffled(share)
    if share < 1.0:
        filled = long.groupBy("strategy").count().filter(F.col("count") >= top_k).count()
        if filled < shuffles:
            long = shuffled(1.0)
    top = _top(long, [F.col("score").asc(), F.col(key).asc()], top_k)
    pos, rel = F.col("pos"), F.col(dollar)
    per_shuffle = top.groupBy("strategy").agg(
        *[(F.count_if((pos <= k) & (F.col(binary) > 0)) / F.count_if(pos <= k)).alias(f"p_{k}") for k in k_values],
        *[dcg_expr(rel, pos, k).alias(f"dcg_{k}") for k in k_values],
        *[F.sum(F.when(pos <= k, money(rel))).cast("double").alias(f"got_{k}") for k in k_values],
    )
    best = df.orderBy(F.col(dollar).desc(), F.col(key)).limit(top_k)
    place = Window.partitionBy(F.lit(1)).orderBy(F.col(dollar).desc(), F.col(key))
    ideal = best.withColumn("pos", F.row_number().over(place)).agg(
        *[dcg_expr(rel, pos, k).alias(f"ideal_{k}") for k in k_values]
    )
    total = df.agg(F.sum(money(rel)).cast("double").alias("total"), F.count(F.lit(1)).alias("n_items"))
    one = F.lit(1).alias("_one")
    # One-row tables: bounded by construction.
    constants = ideal.select("*", one).join(total.select("*", one), "_one")
    joined = per_shuffle.withColumn("_one", F.lit(1)).join(F.broadcast(constants), "_one")

    def mean(value: Column) -> Column:
        return half_up(F.avg(half_up(value, 4)), 4)

    return joined.agg(
        F.lit("random").alias("strategy"),
        *[mean(F.col(f"p_{k}")).alias(f"precision_at_{k}") for k in k_values],
        *[
            mean(F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).otherwise(0.0)).alias(f"ndcg_at_{k}")
            for k in k_values
        ],
        *[
            mean(F.when(F.col("total") > 0, F.col(f"got_{k}") / F.col("total")).otherwise(0.0)).alias(
                f"recovery_captured_at_{k}"
            )
            for k in k_values
        ],
        F.max("n_items").alias("n_items"),
    )


def recovery_strategies(probability: Column, amount: Column) -> dict[str, Column]:
    return {
        "model_expected_value": probability * amount,
        "claim_amount_only": amount,
        "appeal_probability_only": probability,
    }


def evaluate_recovery_ranking(
    test: DataFrame, probability: Column, k_values: Sequence[int] = K_VALUES, with_random: bool = True
) -> DataFrame:
    """Ranking metrics of the three strategies (and random) on held-out appeals, best by captured share at first k. Fewer than
    MIN_ITEMS appeals give no row."""
    amount = F.col("claim_amount").cast("double")
    rows = test.withColumn("_won", F.col("appeal_success").cast("int")).withColumn(
        "_gain", F.when(F.col("appeal_success") == 1, amount).otherwise(0.0)
    )
    long = strategies_long(rows, recovery_strategies(probability, amount), ["appeal_id", "_won", "_gain"])
    metrics = ranking_metrics(long, "score", "_won", "_gain", "appeal_id", k_values)
    if with_random:
        metrics = metrics.unionByName(random_baseline(rows, "_won", "_gain", "appeal_id", k_values))
    metrics = metrics.filter(F.col("n_items") >= MIN_ITEMS)
    names = ["model_expected_value", "claim_amount_only", "appeal_probability_only", "random"]
    ordinal = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("strategy"))
    first = f"recovery_captured_at_{k_values[0]}"
    best = Window.partitionBy(F.lit(1)).orderBy(F.col(first).desc(), ordinal)
    return metrics.withColumn("is_best", F.row_number().over(best) == 1)


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Average precision, ROC-AUC, precision, recall, F1, Brier, n and positive rate; one row.

    Rows collapse to distinct scores before they are ordered.
    """
    y, s = F.col(label).cast("bigint"), F.col(score).cast("double")
    counts = df.select(y.alias("y"), s.alias("s")).groupBy("s").agg(F.sum("y").alias("tp"), F.count(F.lit(1)).alias("n"))
    prefix = ordered_prefix(counts, ["-s"], ["tp", "n"])
    totals = counts.agg(
        F.sum("tp").alias("positives"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("s") >= threshold, F.col("tp")).otherwise(0)).alias("hit"),
        F.sum(F.when(F.col("s") >= threshold, F.col("n")).otherwise(0)).alias("called"),
        F.sum(
            F.col("tp") * (F.lit(1.0) - F.col("s")) * (F.lit(1.0) - F.col("s"))
            + (F.col("n") - F.col("tp")) * F.col("s") * F.col("s")
        ).alias("brier"),
    )
    negatives_below = (F.col("total") - F.col("positives")) - (F.col("cum_n") - F.col("cum_tp"))
    ap = F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n"))
    auc = F.sum(F.col("tp") * (negatives_below + (F.col("n") - F.col("tp")) / 2.0))
    one = F.lit(1)
    # `totals` is one row.
    areas = (
        prefix.withColumn("_one", one)
        .join(F.broadcast(totals.withColumn("_one", one)), "_one")
        .groupBy("positives", "total", "hit", "called", "brier")
        .agg(ap.alias("ap"), auc.alias("auc"))
    )
    P, N, hit, called = F.col("positives"), F.col("total"), F.col("hit"), F.col("called")
    precision = F.when(called > 0, hit / called).otherwise(0.0)
    recall = F.when(P > 0, hit / P).otherwise(0.0)
    both_classes = (P > 0) & (P < N)
    return areas.select(
        F.when(P > 0, half_up(F.col("ap") / P, 6)).otherwise(0.0).alias("pr_auc"),
        F.when(both_classes, half_up(F.col("auc") / (P * (N - P)), 6)).otherwise(0.5).alias("roc_auc"),
        half_up(precision, 6).alias("precision"),
        half_up(recall, 6).alias("recall"),
        half_up(F.when(hit > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0), 6).alias("f1"),
        half_up(F.col("brier") / N, 6).alias("brier_score"),
        N.alias("n_test"),
        half_up(P / N, 6).alias("positive_rate"),
    )


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate per equal-width score bin."""
    s = F.col(score).cast("double")
    index = F.least(F.floor(s * bins), F.lit(bins - 1)).cast("bigint")
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        half_up(F.sum(s.cast("decimal(12,8)")).cast("double") / F.count(F.lit(1)), 6).alias("mean_score"),
        half_up(F.sum(F.col(label).cast("bigint")) / F.count(F.lit(1)), 6).alias("observed_rate"),
    )


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def multiclass_metrics(df: DataFrame, label: str, prediction: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, per class, confusion matrix). Classes are those that occur as label or prediction."""
    counts = confusion_counts(df, label, prediction)
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = counts.groupBy("label").agg(F.sum("n").alias("support"), hits.alias("hits"))
    called = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("called"))
    joined = actual.join(called, "label", "full").na.fill(0, ["called", "support", "hits"])
    p = F.when(F.col("called") > 0, F.col("hits") / F.col("called")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * p * r / (p + r)).otherwise(0.0)
    raw = joined.select("label", p.alias("p"), r.alias("r"), f1.alias("f"), "support", "hits")
    per_class = raw.select(
        "label",
        half_up(F.col("p"), 6).alias("precision"),
        half_up(F.col("r"), 6).alias("recall"),
        half_up(F.col("f"), 6).alias("f1"),
        "support",
    )
    summary = raw.agg(
        half_up(F.avg("f"), 6).alias("macro_f1"),
        half_up(F.sum(F.col("f") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"),
        half_up(F.sum("hits") / F.sum("support"), 6).alias("accuracy"),
        F.sum("support").alias("n_test"),
    )
    return summary, per_class, counts
