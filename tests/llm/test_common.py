import pyarrow as pa
from pyspark.sql import functions as F

from plexigraph.llm import _common


def test_stash_is_stable_and_can_be_cleared(spark):
    a = _common.stash(spark.range(1000).withColumn("u", F.monotonically_increasing_id()), "t")
    assert a.dtypes == [("id", "bigint"), ("u", "bigint")]
    assert a.agg(F.count_distinct("u")).first()[0] == 1000
    assert _common.clear_stashed(spark) >= 1 and not _common._STASHED


def test_empty_stash_keeps_its_schema(spark):
    assert _common.stash(spark.range(0), "e").columns == ["id"]


def test_if_small_counts_before_it_hints(spark):
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "hint" in plan(_common.if_small(spark.range(5), 5)).lower()
    assert "hint" not in plan(_common.if_small(spark.range(6), 5)).lower()


def test_without_ignores_case(spark):
    assert _common.without(spark.range(1).select("id", F.lit(1).alias("N_Hit")), ["n_hit"]).columns == ["id"]


def test_parts_are_bounded_and_whole():
    texts = ["a" * n for n in (5, 0, 300, 1, 1, 1, 900, 2)] + [None, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    got = list(_common.parts([batch, batch.slice(0, 0)], 1, rows=3, size=310))
    assert [x for p in got for x in p.column(1).to_pylist()] == texts
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 310) for p in got)


def test_caches_of_other_operators_go():
    _common.cache_of("a")["x"] = 1
    assert _common.cache_of("a") == {"x": 1}
    _common.cache_of("b")
    assert _common.cache_of("a") == {}


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "64m")
    _common.bound_batches(spark)
    assert spark.conf.get(key).rstrip("b") == str(_common.BATCH_BYTES)
    spark.conf.set(key, "1000")
    _common.bound_batches(spark)
    assert spark.conf.get(key).rstrip("b") == "1000"
    spark.conf.unset(key)


def test_release_collects_garbage(spark):
    beans = lambda: spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    _common.release(spark)
    assert full() > before
