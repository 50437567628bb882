"""Structured Streaming counterparts. The caller owns source, sink and checkpoint."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.operators.audit import RECORD_END, content_digest, record_start, rolled
from claimloom.operators.ingest import ingest_claims
from claimloom.operators.recovery import with_recovery_scores
from claimloom.sources.sinks import BATCH, write_batch

ROCKSDB_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
WINDOW_SECONDS, WINDOW_LIMIT = 60, 120


def stream_claim_dedupe(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """First message per key; keys are remembered for `delay` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def claim_ingest_batch(
    claims_path: str, lines_path: str, rejects_path: str, existing: Callable[[], DataFrame], arrival: list[str]
) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: reject known and repeated numbers, store claims, lines and rejects.

    `existing` is called per batch, so numbers of earlier batches are seen. Each batch is a
    folder of its own in the three tables, which a batch that is run again after a failure
    overwrites; numbers that `existing` has from such a run of the same batch do not count.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = batch.persist()
        try:
            known = existing()
            if BATCH in known.columns:
                known = known.filter(F.col(BATCH).isNull() | (F.col(BATCH) != batch_id))
            claims, lines, rejects = ingest_claims(stored, known, arrival)
            for df, path in ((lines, lines_path), (rejects, rejects_path), (claims, claims_path)):
                write_batch(df, path, batch_id)
        finally:
            stored.unpersist()

    return write


def stream_validation(claims: DataFrame, line_checks: DataFrame) -> DataFrame:
    """Validation, predicted reason and readiness of arriving claims; stateless.

    `line_checks` is a static (claim_id, lines_coded) table.
    """
    joined = claims.join(line_checks, "claim_id", "left")
    return joined.select(
        "claim_id",
        rules.validation(F.col("lines_coded")).alias("validation"),
        rules.denial_reason().alias("reason"),
    )


def stream_recovery_scores(denied: DataFrame) -> DataFrame:
    """Probability, expected recovery and next action of arriving claim x denial rows."""
    return with_recovery_scores(denied).select(
        "claim_id", "appeal_success_probability", "expected_recovery", "recommended_action"
    )


class _Chain(StatefulProcessor):
    """Sequence number, last hash and, with segments, seal of the whole ones and rolling digest of the open one, per entity."""

    def __init__(self, segment_rows: int | None) -> None:
        self.segment_rows = segment_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, hash string, seal string, rolled string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, last, seal, contents = self.last.get() if self.last.exists() else (0, "", "", "")
        names = ["created_at", "event_id", "start", "digest"]
        # only what the order and the hashes need is held, as the micro-batch's rows of a key come unsorted
        arrived = sorted(row for part in rows for row in part[names].itertuples(index=False, name=None))
        for first in range(0, len(arrived), 10_000):
            out = []
            for _, event_id, start, digest in arrived[first : first + 10_000]:
                if self.segment_rows and seq and seq % self.segment_rows == 0:
                    seal, contents = rolled(seal, contents), ""
                    last = seal
                own = hashlib.sha256((start + last + RECORD_END).encode()).hexdigest()
                if self.segment_rows:
                    contents = rolled(contents, digest)
                seq += 1
                out.append((event_id, key[0], seq, last, own))
                last = own
            yield pd.DataFrame(out, columns=["event_id", "entity_id", "seq", "prev_hash", "hash"])
        self.last.update((seq, last, seal, contents))

    def close(self) -> None:
        pass


def stream_audit_chain(events: DataFrame, segment_rows: int | None = None) -> DataFrame:
    """Chain arriving records per entity: by time within a micro-batch, by arrival across them.

    Hashes are those that `build_chain` gives the same records in the same order. The
    sequence is the meaning of a chain, so one entity is one task's work per micro-batch;
    bound the batch with the source's rate options.
    """
    ready = events.select("event_id", "entity_id", "created_at", record_start().alias("start"), content_digest().alias("digest"))
    return ready.groupBy("entity_id").transformWithStateInPandas(
        statefulProcessor=_Chain(segment_rows),
        outputStructType="event_id bigint, entity_id bigint, seq bigint, prev_hash string, hash string",
        outputMode="Append",
        timeMode="None",
    )


class _Velocity(StatefulProcessor):
    """Times of the accepted events of one client that are still inside the window."""

    def __init__(self, window_micros: int, limit: int) -> None:
        self.window, self.limit = window_micros, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.accepted.get()[0]) if self.accepted.exists() else []
        arrived = sorted(row for part in rows for row in part[["micros", "event_id"]].itertuples(index=False, name=None))
        for first in range(0, len(arrived), 10_000):
            out = []
            for now, event_id in arrived[first : first + 10_000]:
                recent = [t for t in recent if now - t < self.window]
                ok = len(recent) < self.limit
                if ok:
                    recent.append(int(now))
                out.append((event_id, key[0], ok))
            yield pd.DataFrame(out, columns=["event_id", "client_id", "accepted"])
        # Never more than `limit` entries.
        self.accepted.update((recent,))

    def close(self) -> None:
        pass


def stream_velocity(
    events: DataFrame, client: str, ts: str, window_seconds: int = WINDOW_SECONDS, limit: int = WINDOW_LIMIT
) -> DataFrame:
    """Accept an event if fewer than `limit` accepted events of its client lie in the last window.

    Refused events do not count.
    """
    ready = events.select("event_id", F.col(client).cast("bigint").alias("client_id"), F.unix_micros(ts).alias("micros"))
    return ready.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=_Velocity(window_seconds * 1_000_000, limit),
        outputStructType="event_id bigint, client_id bigint, accepted boolean",
        outputMode="Append",
        timeMode="None",
    )


def stream_daily_counts(stream: DataFrame, ts: str, value: str, edges: list[float], delay: str = "1 day") -> DataFrame:
    """Rows per day and reference bin: in append mode once the watermark has passed a day, in
    update mode whenever they change (`latest_counts`), so that the last days are reported too.

    State is one counter per open day and bin. Values outside the edges fall in bin 0, so
    days without a value in range are still reported.
    """
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    inside = F.col(value).between(edges[0], edges[-1])
    index = F.least(F.size(F.filter(bounds, lambda e: e <= F.col(value))), F.lit(len(edges) - 1))
    binned = stream.withColumn("bin", F.when(inside, index).otherwise(0))
    return (
        binned.withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 day").alias("day"), "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("day.start").alias("day"), "bin", "n")
    )


def latest_counts(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for `stream_daily_counts` in update mode: each batch's changed counts, in a folder of its own."""
    return lambda batch, batch_id: write_batch(batch, path, batch_id)


def read_counts(spark: SparkSession, path: str, schema: str, closed_before=None) -> DataFrame:
    """(day, bin, n, closed): the last count of each day and bin, the days still open at the end of the input among them.

    `closed` tells days that ended by `closed_before`, the watermark: their counts are final.
    """
    stored = spark.read.schema(f"{schema}, {BATCH} bigint").parquet(path)
    last = stored.groupBy("day", "bin").agg(F.max_by("n", BATCH).alias("n"))
    ended = F.lit(None).cast("boolean") if closed_before is None else F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(closed_before)
    return last.withColumn("closed", ended)


def late_rows(query: StreamingQuery, counts: DataFrame) -> int:
    """Rows of a finished query that came after the watermark had passed their day, and so are not among the final counts.

    The dropped-rows figure of the state operator counts partial sums. Input rows are those of the recent progress reports, as
    many as `spark.sql.streaming.numRecentProgressUpdates` keeps.
    """
    counted = counts.agg(F.sum("n")).first()[0] or 0
    return sum(step["numInputRows"] for step in query.recentProgress) - counted


def daily_psi(counts: DataFrame, reference: list[int]) -> DataFrame:
    """PSI of each day against the reference bin counts; works in foreachBatch too.

    All bins of a day are emitted together, so one micro-batch holds whole days.
    """
    total = max(sum(reference), 1)
    bins = F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(c / total).alias("share")) for i, c in enumerate(reference)])
    inside = F.sum(F.when(F.col("bin") > 0, F.col("n")).otherwise(0)).alias("rows")
    days = counts.groupBy("day").agg(inside).select("day", "rows", F.explode(bins).alias("b")).select("day", "rows", "b.*")
    share = F.coalesce("n", F.lit(0)) / F.greatest("rows", F.lit(1)) + 1e-6
    r = F.col("share") + 1e-6
    joined = days.join(counts, ["day", "bin"], "left")
    term = (share - r) * F.ln(share / r)
    return joined.groupBy("day").agg(F.max("rows").alias("rows"), half_up(F.sum(term), 6).alias("psi")).select(
        "day", "rows", "psi", rules.drift_status(F.col("psi")).alias("status")
    )
