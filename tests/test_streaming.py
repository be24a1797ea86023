from retroscope.sources import panel
from retroscope.streaming import windows


def test_stream_gives_what_the_table_gives(spark, sf_dir, tmp_path):
    events = panel.table(spark, sf_dir, "events")
    events.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(f"{tmp_path}/events")
    seen = {}

    def sink(batch, _):
        for r in batch.collect():
            seen[(r.start, r.event_type)] = (r.rows, r.hundredths)

    windows.drain(windows.activity(windows.event_stream(spark, f"{tmp_path}/events"), late="400 days"), f"{tmp_path}/state", "update", sink)
    want = {(r.start, r.event_type): (r.rows, r.hundredths) for r in windows.activity(events).collect()}
    assert seen == want


def test_each_key_once(spark, sf_dir, tmp_path):
    events = panel.table(spark, sf_dir, "events")
    events.write.parquet(f"{tmp_path}/events/a")
    events.limit(50).write.parquet(f"{tmp_path}/events/b")
    kept = []
    windows.drain(windows.keep_first(windows.event_stream(spark, f"{tmp_path}/events/*"), ["event_id"], "400 days"), f"{tmp_path}/state", "append", lambda b, _: kept.extend(r.event_id for r in b.collect()))
    assert sorted(kept) == sorted(r.event_id for r in events.select("event_id").distinct().collect())


def test_growing_bank_of_a_stream_equals_the_table(spark, sf_dir, tmp_path):
    """The stream's bank keeps the last row of each key, and its earlier versions stay readable."""
    from pyspark.sql import functions as F

    from retroscope.operators import banks

    events = panel.table(spark, sf_dir, "events").withColumn("key", F.col("event_id") % 40)
    parts = [events.where(F.pmod(F.floor(F.col("event_id") / 40), F.lit(3)) == i) for i in range(3)]
    for i, part in enumerate(parts):  # one file each, read in the order in which they were written
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = windows.event_stream(spark, f"{tmp_path}/events", at_once=100)
        windows.drain(stream, f"{tmp_path}/state", "append", windows.versions(f"{tmp_path}/bank"))
        have = windows.bank(spark, f"{tmp_path}/bank", ["key"], "event_id")
        want = banks.grown(parts[0], parts[1 : i + 1], ["key"], "event_id")
        assert sorted(have.select(*want.columns).collect()) == sorted(want.collect())
    first = windows.bank(spark, f"{tmp_path}/bank", ["key"], "event_id", 0)
    assert sorted(first.select(*events.columns).collect()) == sorted(banks.keep_last(parts[0], ["key"], "event_id").collect())
