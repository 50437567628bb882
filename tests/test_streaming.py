import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from claimloom.operators import audit
from claimloom.sources.readers import read_claim_messages
from claimloom.sources.schemas import CLAIM_INPUT
from claimloom.storage import new_path
from claimloom.streaming import jobs

T0 = datetime(2020, 1, 1)


def drain(spark, stream):
    path = new_path(spark, "sink")
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_path(spark, "cp"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def in_batches(spark, batches, schema):
    """A stream that gets one of `batches` per micro-batch."""
    path = new_path(spark, "src")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def rocksdb(spark):
    for k, v in jobs.ROCKSDB_CONF.items():
        spark.conf.set(k, v)


def test_velocity_refuses_over_the_limit_and_forgets_old_events(spark):
    rocksdb(spark)
    schema = "event_id bigint, client string, ts timestamp"
    schema = schema.replace("client string", "client bigint")
    first = [(i, 1, T0 + timedelta(seconds=i)) for i in range(8)]
    later = [(100 + i, 1, T0 + timedelta(seconds=90 + i)) for i in range(3)]
    stream = in_batches(spark, [first, later], schema)
    got = {r["event_id"]: r["accepted"] for r in drain(spark, jobs.stream_velocity(stream, "client", "ts", 60, 5)).collect()}
    assert [got[i] for i in range(8)] == [True] * 5 + [False] * 3
    assert all(got[100 + i] for i in range(3))


def test_chain_goes_on_across_micro_batches(spark):
    rocksdb(spark)
    schema = "event_id bigint, entity_id bigint, created_at timestamp, actor_type string, event_type string, payload string"
    rows = [(i, i % 2, T0 + timedelta(minutes=i), "user", "e", json.dumps({"k": i})) for i in range(12)]
    chained = drain(spark, jobs.stream_audit_chain(in_batches(spark, [rows[:5], rows[5:]], schema)))
    batch = audit.build_chain(spark.createDataFrame(rows, schema))
    names = ["event_id", "seq", "prev_hash", "hash"]
    assert sorted(map(tuple, chained.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))


def test_dedupe_across_micro_batches(spark):
    rows = [(f"c{i % 4}", T0 + timedelta(minutes=i)) for i in range(8)]
    stream = in_batches(spark, [rows[:4], rows[4:]], "claim_number string, sent_at timestamp")
    got = drain(spark, jobs.stream_claim_dedupe(stream, "claim_number", "sent_at", "1 day"))
    assert sorted(r["claim_number"] for r in got.collect()) == ["c0", "c1", "c2", "c3"]


def test_ingest_rejects_known_and_repeated_numbers(spark, tmp_path):
    def message(number, amount):
        line = {"procedure_code": "99213", "diagnosis_code": "I10", "modifiers": "", "line_amount": amount, "units": 1}
        return {"claim_number": number, "provider_id": "p", "payer_id": "q", "patient_ref": "r", "claim_amount": amount,
                "service_date": "2020-01-01T00:00:00Z", "lines": [line, line]}

    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(message(n, a)) for n, a in (("A", 1), ("A", 2), ("B", 3))))
    assert read_claim_messages(spark, str(source)).count() == 3
    claims, lines, rejects = (new_path(spark, n) for n in ("claims", "lines", "rejects"))

    def existing():
        try:
            return spark.read.parquet(claims).select("claim_number")
        except Exception:
            return spark.createDataFrame([], "claim_number string")

    def run():
        stream = spark.readStream.schema(CLAIM_INPUT).json(str(source))
        sink = jobs.claim_ingest_batch(claims, lines, rejects, existing, ["claim_amount"])
        writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start().awaitTermination()

    run()
    (source / "2.json").write_text(json.dumps(message("B", 9)) + "\n" + json.dumps(message("C", 4)))
    run()
    stored = {r["claim_number"]: r for r in spark.read.parquet(claims).collect()}
    assert {k: float(v["claim_amount"]) for k, v in stored.items()} == {"A": 1.0, "B": 3.0, "C": 4.0}
    assert stored["A"]["claim_type"] == "professional" and stored["A"]["data_source"] == "api_manual_entry"
    assert spark.read.parquet(lines).count() == 6
    reasons = [(r["claim_number"], r["reason"]) for r in spark.read.parquet(rejects).collect()]
    assert sorted(reasons) == [("A", "duplicate in batch"), ("B", "claim_number already exists")]


def test_daily_counts_emit_closed_days_and_drop_late_rows(spark):
    schema = "ts timestamp, v double"
    day = [[(T0 + timedelta(days=d, hours=h), float(h % 5)) for h in range(20)] for d in range(4)]
    late = [(T0, 1.0)] * 7
    stream = in_batches(spark, [day[0], day[1], day[2], day[3], late], schema)
    counts = drain(spark, jobs.stream_daily_counts(stream, "ts", "v", [0.0, 2.0, 3.0, 4.0]))
    psi = {r["day"]: r for r in jobs.daily_psi(counts, [8, 4, 8]).collect()}
    assert set(psi) == {T0, T0 + timedelta(1)}
    assert all(r["rows"] == 20 and r["psi"] < 1e-4 and r["status"] == "NORMAL" for r in psi.values())


def test_scores_on_a_stream_equal_the_batch(spark):
    schema = (
        "claim_id bigint, claim_number string, provider_id bigint, payer_id bigint, claim_amount double, authorization_status string, "
        "eligibility_status string, documentation_completeness double, submission_date timestamp, timely_filing_deadline timestamp, denial_reason_code string"
    )
    rows = [(i, f"C{i}", 1, 1, 100.0 * i, "PRESENT", "VERIFIED", 50.0 + i, T0, T0, "OTHER") for i in range(20)]
    batch = spark.createDataFrame(rows, schema)
    stream = in_batches(spark, [rows], schema)
    got = drain(spark, jobs.stream_recovery_scores(stream))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.stream_recovery_scores(batch).collect()))
    checks = spark.createDataFrame([(i, True) for i in range(20)], "claim_id bigint, lines_coded boolean")
    validated = drain(spark, jobs.stream_validation(in_batches(spark, [rows], schema), checks).select("claim_id", F.col("validation.readiness_score")))
    assert validated.count() == 20


EVENTS = "event_id bigint, entity_id bigint, created_at timestamp, actor_type string, event_type string, payload string"


def test_batch_stream_and_verification_share_one_chain_rule(spark):
    """2,500 records of one entity: three segments, in micro-batches that do not end with them."""
    rocksdb(spark)
    rows = [(i, 7 if i < 2_500 else 8, T0 + timedelta(seconds=i), "user", "e", json.dumps({"k": i})) for i in range(2_503)]
    events = spark.createDataFrame(rows, EVENTS)
    streamed = drain(spark, jobs.stream_audit_chain(in_batches(spark, [rows[:700], rows[700:2_001], rows[2_001:]], EVENTS)))
    batch = audit.build_chain(events)
    names = ["event_id", "seq", "prev_hash", "hash"]
    assert sorted(map(tuple, streamed.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))
    log = events.join(streamed.drop("entity_id"), "event_id")
    assert audit.verify_chain(log).count() == audit.verify_chain(batch).count() == 0
    edit = F.when(F.col("event_id") == 1_500, "{}").otherwise(F.col("payload"))
    for table in (log, batch):
        bad = audit.verify_chain(table.withColumn("payload", edit)).collect()
        assert [(r["entity_id"], r["first_bad_event"]) for r in bad] == [(7, 1_500)]
    # a forger who hashes the edited segment anew, and the first record after it, breaks the next link
    forged = audit.build_chain(events.withColumn("payload", edit)).filter("seq <= 2001")
    mixed = forged.unionByName(batch.filter("seq > 2001"))
    bad = audit.verify_chain(mixed).collect()
    assert [(r["entity_id"], r["first_bad_seq"]) for r in bad] == [(7, 2_002)]


def test_daily_counts_report_every_day_once(spark):
    """30 days in update mode: open days are there, repeated batches change nothing, late rows are dropped and counted."""
    schema = "ts timestamp, v double"
    days = [[(T0 + timedelta(days=d, hours=h), float(h % 5)) for h in range(20)] for d in range(30)]
    late = [(T0, 1.0)] * 7
    source = in_batches(spark, [*days, late], schema)
    watermark = days[-1][-1][0] - timedelta(days=1)
    for times in (1, 2):
        path = new_path(spark, "daily")
        sink = jobs.latest_counts(path)

        def write(batch, batch_id, sink=sink, times=times):
            for _ in range(times):
                sink(batch, batch_id)

        counts = jobs.stream_daily_counts(source, "ts", "v", [0.0, 2.0, 3.0, 4.0])
        writer = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", new_path(spark, "cp"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        table = jobs.read_counts(spark, path, "day timestamp, bin int, n bigint", watermark)
        psi = {r["day"]: r["rows"] for r in jobs.daily_psi(table, [8, 4, 8]).collect()}
        assert psi == {T0 + timedelta(days=d): 20 for d in range(30)}
        closed = {r["day"] for r in table.filter("closed").select("day").collect()}
        assert closed == {T0 + timedelta(days=d) for d in range(28)}
        if times == 1:
            assert jobs.late_rows(query, table) == 7


def test_a_batch_that_runs_twice_is_stored_once(spark):
    lines = [{"procedure_code": "99213", "diagnosis_code": "I10", "modifiers": "", "line_amount": 1.0, "units": 1}]
    messages = [{"claim_number": n, "provider_id": "p", "payer_id": "q", "patient_ref": "r", "claim_amount": a, "service_date": "2020-01-01T00:00:00Z", "lines": lines} for n, a in (("A", 1), ("A", 2), ("B", 3))]
    claims, lines_, rejects = (new_path(spark, n) for n in ("claims", "lines", "rejects"))
    sink = jobs.claim_ingest_batch(claims, lines_, rejects, lambda: stored(claims), ["claim_amount"])

    def stored(path):
        try:
            return spark.read.parquet(path)
        except Exception:
            return spark.createDataFrame([], "claim_number string, batch_id bigint")

    folder = new_path(spark, "messages")
    spark.createDataFrame([(json.dumps(m),) for m in messages], "value string").write.text(folder)
    batch = read_claim_messages(spark, folder)
    for batch_id in (0, 0, 1, 0):
        sink(batch, batch_id)
    assert sorted((r["claim_number"], r["batch_id"]) for r in stored(claims).collect()) == [("A", 0), ("B", 0)]
    assert stored(lines_).count() == 2
    reasons = sorted((r["batch_id"], r["reason"]) for r in stored(rejects).collect())
    assert reasons == [(0, "duplicate in batch")] + [(1, "claim_number already exists")] * 3
