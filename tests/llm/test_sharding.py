import zlib

import pytest

from plexigraph.llm import sharding


def check(df, rows, shards):
    got = df.collect()
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=repr) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    by = {}
    for r in got:
        assert 0 <= r["shard"] < shards
        by.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    for own in by.values():
        assert sorted(s for s, _ in own) == list(range(len(own)))
    return [sum(s for _, s in by.get(k, [])) for k in range(shards)]


def test_near_equal_bytes(make):
    rows = [(i, "é" * (i % 97)) for i in range(4000)]
    sizes = check(sharding.shard_by_bytes(make(rows), 7), rows, 7)
    assert max(sizes) - min(sizes) <= 2 * 210


def test_a_hot_text_and_repeated_rows_are_cut(make):
    rows = [(1, "same text")] * 1500 + [(i, "same text") for i in range(1500)] + [(i, f"t{i}") for i in range(500)]
    sizes = check(sharding.shard_by_bytes(make(rows), 5, range_rows=200), rows, 5)
    assert max(sizes) - min(sizes) <= 100


def test_more_shards_than_rows_and_large_documents(make):
    rows = [(1, "x" * 100_000), (2, None), (3, ""), (None, "y")]
    check(sharding.shard_by_bytes(make(rows).withColumnRenamed("source", "shard"), 24), rows, 24)


@pytest.mark.parametrize("shards", [1, 3])
def test_empty_table(make, shards):
    assert sharding.shard_by_bytes(make([]), shards).count() == 0


def test_no_range_holds_more_than_its_bound(make):
    """Rows repeated as a whole share one hash and are cut by their places."""
    docs = make([(1, "same")]).crossJoin(make([]).sparkSession.range(6000).select()).unionByName(make([(i, f"t{i}") for i in range(300)]))
    seen = []
    real = sharding.find_ranges

    def spy(keys, cuts, rows, most, probes=15):
        points, below = real(keys, cuts, rows, most, probes)
        ends = [0, *[n for _, n in below], rows]
        seen.append((most, max(b - a for a, b in zip(ends[:-1], ends[1:], strict=True))))
        return points, below

    sharding.find_ranges = spy
    try:
        got = sharding.shard_by_bytes(docs, 4, range_rows=250).collect()
    finally:
        sharding.find_ranges = real
    assert seen and all(largest <= most <= 250 for most, largest in seen)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 6300 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_places_survive_other_file_splits(spark, make):
    docs = spark.range(0, 3000, 1, 24).selectExpr("1L as doc_id", "'same text' as text")
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    try:
        spark.conf.set(keys[0], "1")
        out = sharding.shard_by_bytes(docs, 5, range_rows=100)
        spark.conf.set(keys[0], "64")
        spark.conf.set(keys[1], "0")
        got = out.collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == 3000 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark, sf):
    out = sharding.op7_sharding(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r["law"] for r in out.select("law").collect()} == {"bytes"}
    sizes = check(out, rows, 24)
    assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 8 for _, t in rows)
