"""Bucketed collections and the balance as a stream."""

import datetime
import re

from pyspark.sql import functions as F

from loomframe.operators import balance, collection
from loomframe.sources import bucketed
from loomframe.streaming import balance_stream


def test_resuming_moves_no_stored_row(spark, tmp_path):
    # as for tables too large to be sent to every task
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        q = bucketed.write_bucketed(spark.range(50).withColumnRenamed("id", "question_id"), "q_bucketed", "question_id", 8, f"{tmp_path}/q")
        rows = spark.range(120).select(F.concat(F.lit("s"), "id").alias("sample_id"), (F.col("id") % 40).alias("source_question_id"), (F.col("id") % 3 > 0).alias("validation_passed"))
        bucketed.write_bucketed(rows.where("source_question_id < 20"), "s_bucketed", "source_question_id", 8, f"{tmp_path}/s")
        bucketed.add_to_bucketed(rows.where("source_question_id >= 20"), "s_bucketed", "source_question_id", 8)
        samples = spark.table("s_bucketed")
        left = collection.remaining_work(q, collection.existing_samples(samples), 2)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"\bExchange\b", plan)
        want = collection.remaining_work(spark.range(50).withColumnRenamed("id", "question_id"), collection.existing_samples(rows), 2)
        assert sorted(map(tuple, left.collect())) == sorted(map(tuple, want.collect()))
        done = bucketed.write_bucketed(spark.range(0, 50, 2).withColumnRenamed("id", "question_id"), "d_bucketed", "question_id", 8, f"{tmp_path}/d")
        pending = collection.pending_rows(q, done, "question_id")
        assert "Exchange" not in pending._jdf.queryExecution().executedPlan().toString() and pending.count() == 25
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("q_bucketed", "s_bucketed", "d_bucketed"):
            bucketed.drop_bucketed(spark, name)


def test_balance_stream_equals_the_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda minutes: t0 + datetime.timedelta(minutes=minutes)
    schema = "id long, ts timestamp, dimension string, value string, kind string, reservation_id string, n long"
    first = [(k, at(k % 30), "d", "hot" if k % 3 else f"v{k % 5}", "sample", None, 1) for k in range(90)]
    first += [(100, at(0), "d", "hot", "reserve", "r1", None), (101, at(0), "d", "v1", "reserve", "r2", None), (102, at(1), "d", "v1", "rollback", "r2", None), (103, at(2), "d", "new", "reserve", "r3", None), (104, at(2), "d", None, "sample", None, 1)]
    second = [(200, at(35), "d", "hot", "commit", "r1", None), (199, at(3), "d", "hot", "sample", None, 1), (201, at(36), "d", "hot", "commit", "r1", None), (202, at(50), "d", "v2", "sample", None, 7), (203, at(50), "d", "v2", "commit", "unknown", None), (204, at(50), "e", "x", "reserve", "r4", None)]
    third = [(300, at(400), "d", "v3", "sample", None, 2)]
    folder, path = f"{tmp_path}/in", f"{tmp_path}/out"
    counts = []
    for k, rows in enumerate((first, second, third, [])):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
        events = spark.readStream.schema(schema).parquet(f"{folder}/*")
        balance_stream.run_balance(events, path, ttl="1 hour", late="1 minute")
        counts.append({(r.dimension, r.value): r.n for r in balance_stream.read_balance(spark, path).collect()})
    samples = spark.createDataFrame([(f"s{k}", r[3]) for k, r in enumerate(r for r in first if r[4] == "sample" and r[3])], "sample_id string, v string")
    batch = {("d", r.value): r.n for r in balance.feature_counts(samples, {"d": "v"}).collect()}
    assert counts[0] == batch | {("d", "hot"): batch["d", "hot"] + 1, ("d", "new"): 1}
    # committed once, rolled back, and others still open
    assert counts[1] == counts[0] | {("d", "v2"): batch["d", "v2"] + 7, ("e", "x"): 1}
    # the third batch moves the watermark past the open reservations, which expire
    assert counts[3] == batch | {("d", "hot"): batch["d", "hot"] + 1, ("d", "v2"): batch["d", "v2"] + 7, ("d", "v3"): batch["d", "v3"] + 2}
    now = balance_stream.read_balance(spark, path)
    assert {r.value for r in balance.underrepresented(now.where("dimension = 'd'"), 0.5).collect()} == {v for (d, v), n in counts[3].items() if n < 0.5 * sum(counts[3].values()) / len(counts[3])}
