from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tracksmith.operators.intervals import merge_intervals
from tracksmith.operators.preparing import next_location_sequence
from tracksmith.streaming.stateful import stream_counts, stream_next_locations, stream_periods

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stream(spark, path, batches, schema):
    """Each batch is a file; one file a trigger, in order of name."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{i:03d}")
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def run(df, path, mode):
    seen = []
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, n: seen.append((n, [tuple(r) for r in b.collect()]))).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return seen


def test_periods_grow_over_batches(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("u", at(0), at(2)), ("u", at(5), at(6)), ("v", at(1), at(1))], [("u", at(2), at(4)), ("w", at(3), at(1))], [("u", at(4), at(5)), (None, at(0), at(1))]]
    schema = "who string, a timestamp, b timestamp"
    seen = run(stream_periods(stream(spark, tmp_path, batches, schema), "who", "a", "b"), tmp_path, "update")
    state = {}
    for _, rows in seen:
        for who in {r[0] for r in rows}:
            state[who] = sorted(r for r in rows if r[0] == who)
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    want = merge_intervals(every, "who", "a", "b").select("who", "kind", F.unix_micros("start"), F.unix_micros("end")).collect()
    assert sorted(r for rows in state.values() for r in rows) == sorted(map(tuple, want))


def test_counts_come_out_after_the_watermark(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, at(1)), (1, at(20)), (2, at(59))], [(1, at(61)), (1, at(50))], [(1, at(200))], [(1, at(201))]]
    df = stream_counts(stream(spark, tmp_path, batches, "user_id long, datetime timestamp"), "1 hour", "30 minutes")
    rows = [r for _, part in run(df, tmp_path, "append") for r in part]
    assert sorted((r[0], r[1].hour, r[2]) for r in rows) == [(1, 0, 3), (1, 1, 1), (2, 0, 1)]


def test_next_locations_across_batches(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[(1, at(0), 0.0, 0.0), (1, at(1), 0.0, 0.0), (2, at(1), 5.0, 5.0)], [(1, at(3), 1.0, 0.0), (1, at(2), 0.0, 0.0), (2, at(4), 5.0, 5.0)], [(1, at(9), 0.0, 0.0), (1, at(10), None, 0.0)]]
    schema = "user_id long, datetime timestamp, lon double, lat double"
    rows = [r for _, part in run(stream_next_locations(stream(spark, tmp_path, batches, schema)), tmp_path, "append") for r in part]
    want = next_location_sequence(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert sorted(rows) == sorted(map(tuple, want))
