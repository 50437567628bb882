"""As-of historical rates.

For a probe (key, time) the rate uses only events strictly before that time. Events
collapse to one row per (key, instant) first. The running total is then built on a
calendar grid (days per key, seconds per day, instants per second), so no window
ever holds more than the calendar allows, however hot a key is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.storage import materialize, small_side

SECOND_MICROS = 1_000_000
DAY_SECONDS = 86_400


def _before(df: DataFrame, group: Sequence[str], order: str, names: Sequence[str], out: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        *group, order, *[F.coalesce(F.sum(c).over(window), F.lit(0)).alias(f"{out}_{c}") for c in names]
    )


def totals_strictly_before(instants: DataFrame, keys: Sequence[str], ts: str, measures: Sequence[str]) -> DataFrame:
    """Totals of `measures` over earlier instants of the same key.

    `instants` has one row per (keys, ts). Result: keys, ts and `prior_<measure>`.
    """
    seconds = F.floor(F.unix_micros(ts) / SECOND_MICROS)
    base = instants.withColumn("_sec", seconds).withColumn("_day", F.floor(F.col("_sec") / DAY_SECONDS))
    sums = [F.sum(c).alias(c) for c in measures]
    per_second = base.groupBy(*keys, "_day", "_sec").agg(*sums)
    per_day = per_second.groupBy(*keys, "_day").agg(*sums)

    in_second = _before(base, [*keys, "_day", "_sec"], ts, measures, "a")
    in_day = _before(per_second, [*keys, "_day"], "_sec", measures, "b")
    days = _before(per_day, keys, "_day", measures, "c")
    joined = in_second.join(in_day, [*keys, "_day", "_sec"]).join(days, [*keys, "_day"])
    prior = [(F.col(f"a_{c}") + F.col(f"b_{c}") + F.col(f"c_{c}")).alias(f"prior_{c}") for c in measures]
    return joined.select(*keys, ts, *prior)


def rate_table(
    events: DataFrame,
    keys: Mapping[str, str],
    ts: str,
    label: str,
    probes: DataFrame | None = None,
    probe_ts: str | None = None,
    label_time: str | None = None,
) -> DataFrame:
    """Prior counts per (key_name, key_value, ts) for every instant at which a rate may be asked.

    The table is written once: it has one row per distinct (key, instant), and every key
    joins back to it. With `label_time`, an event counts from `ts`, but its label only from the time it
    became known. Without it both count from `ts`.
    """

    def exploded(df: DataFrame, at: str, n: Column, x: Column) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in keys.items()]
        )
        return df.filter(F.col(at).isNotNull()).select(
            F.explode(pairs).alias("_p"), F.col(at).alias("_ts"), n.cast("bigint").alias("n"), x.cast("bigint").alias("x")
        )

    one, zero = F.lit(1), F.lit(0)
    if label_time is None:
        parts = [exploded(events, ts, one, F.col(label))]
    else:
        parts = [exploded(events, ts, one, zero), exploded(events, label_time, zero, F.col(label))]
    if probes is not None:
        parts.append(exploded(probes, probe_ts or ts, zero, zero))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    instants = (
        rows.filter(F.col("_p.v").isNotNull())
        .groupBy(F.col("_p.k").alias("key_name"), F.col("_p.v").alias("key_value"), "_ts")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    )
    return materialize(totals_strictly_before(instants, ["key_name", "key_value"], "_ts", ["n", "x"]), "rates")


def with_asof_rates(
    df: DataFrame,
    keys: Mapping[str, str],
    ts: str,
    label: str,
    min_obs: int = 5,
    prior: float = 0.15,
    events: DataFrame | None = None,
    event_ts: str | None = None,
    label_time: str | None = None,
) -> DataFrame:
    """Add one rate column per entry of `keys` (output name -> key column).

    By default the rows of `df` are both probes and events. With `events`, `df` only
    probes and the key columns must exist on both sides.
    """
    if events is None and label_time is None:
        table = rate_table(df, keys, ts, label)
    else:
        source = df if events is None else events
        table = rate_table(source, keys, event_ts or ts, label, df, ts, label_time)
    rate = F.when(F.col("prior_n") >= min_obs, F.col("prior_x") / F.col("prior_n")).otherwise(F.lit(prior))
    for out, column in keys.items():
        rates = table.filter(F.col("key_name") == out).select(
            F.col("key_value").alias("_kv"), F.col("_ts").alias("_kt"), rate.alias(out)
        )
        joined = df.join(small_side(rates), (F.col(column).cast("string") == F.col("_kv")) & (F.col(ts) == F.col("_kt")), "left")
        df = joined.drop("_kv", "_kt").withColumn(out, F.coalesce(F.col(out), F.lit(prior)))
    return df
