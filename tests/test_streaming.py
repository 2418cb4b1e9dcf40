from pyspark.sql import functions as F

from plexigraph.streaming import events

D = "/root/testdata/sf0.001"


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_tumbling_windows_agree_with_batch(spark):
    folder = f"{D}/events.parquet"
    got = run(spark, events.windowed_counts(events.read_events(spark, D, "events.parquet"), "1 day"), "tumbling", "complete")
    want = spark.read.parquet(folder).groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    key = lambda r: (r["window_start"], r["event_type"], r["n"])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_repeats_are_dropped(spark, tmp_path):
    e = spark.read.parquet(f"{D}/events.parquet").limit(50)
    e.unionByName(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run(spark, events.first_seen(events.read_events(spark, str(tmp_path / "in"))), "seen").count() == 50


def test_sessions_hold_every_event(spark):
    got = run(spark, events.sessions(events.read_events(spark, D, "events.parquet")), "sessions_", "complete")
    assert got.agg(F.sum("n")).first()[0] == 1000
