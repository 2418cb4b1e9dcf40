import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plexigraph.llm import packing


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    return len(by)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120))
def test_sum_of_squares_is_a_packing(lengths):
    bins, offsets, fills = packing.sum_of_squares(np.array(lengths, np.int64), 50)
    rows = [{"sequence_id": b, "offset": o, "length": n} for b, o, n in zip(bins, offsets, lengths, strict=True)]
    assert check(rows, 50) == len(fills)
    assert sum(fills) == sum(lengths)


def test_sum_of_squares_chooses_the_least():
    # Two bins of 6 leave gaps of 4: a third 6 opens another, a 4 then fills one exactly.
    bins, _, fills = packing.sum_of_squares(np.array([6, 6, 4, 4]), 10)
    assert len(fills) == 2 and sorted(fills) == [10, 10]


def test_close_to_the_lower_bound():
    lengths = np.random.default_rng(1).integers(1, 2000, 3000)
    _, _, fills = packing.sum_of_squares(lengths, 4096)
    assert len(fills) <= -(-lengths.sum() // 4096) * 1.01 + 1


def test_rounds_over_many_shards(spark):
    lengths = np.random.default_rng(2).integers(1, 900, 2500).tolist()
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df, 1000, shard_pieces=150).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(2500))
    assert check(rows, 1000) <= -(-sum(lengths) // 1000) * 1.03 + 1


@pytest.mark.parametrize("text", ["", None, "a b\n\nc\t d", "Überß' can't 12 don't!!", "x" * 500, "<|endoftext|> a", "\x01 \x01\x01", " ", "É́ é"])
def test_word_table_is_the_tokenizer(text):
    model = Tokenizer.from_file(packing.tokenizer_file())
    want = np.array(model.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.WordTable(packing.tokenizer_file()).encode([text or "", "a b"])[0] == want


def test_documents(spark, make):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "word " * 9000), (4, "word " * 9000), (None, "x"), (5, "one two three")]
    docs = make(rows).withColumnRenamed("source", "offset")  # a clashing extra column
    got = packing.pack_documents(docs).collect()
    check(got, 4096)
    model = Tokenizer.from_file(packing.tokenizer_file())
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"])
        ids = model.encode(text or "", add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    pieces = sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in got)
    assert [p for p in pieces if p[0] == 4] == [(4, 0, 4096), (4, 0, 4096), (4, 1, 4096), (4, 1, 4096), (4, 2, 809), (4, 2, 809)]
    assert (2, 0, 1) in pieces and (3, 0, 1) in pieces and len(got) == 11


def test_empty_table(make):
    assert packing.pack_documents(make([])).count() == 0


def test_ids_survive_other_file_splits(spark):
    """Jobs after the first see other splits of the stored pieces, as with a lost or an added executor."""
    df = spark.range(0, 5000, 1, 24).select(F.col("id").alias("doc_id"), (F.col("id") % 700 + 1).alias("length"))
    keys = ["spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    try:
        spark.conf.set(keys[0], "1")
        out = packing.pack(df, 1000, shard_pieces=400)
        spark.conf.set(keys[0], "64")
        spark.conf.set(keys[1], "0")
        rows = out.collect()
    finally:
        for k in keys:
            spark.conf.unset(k)
    assert sorted(r["doc_id"] for r in rows) == list(range(5000))
    check(rows, 1000)


def test_merge_rounds(spark):
    """Pieces just over half of the capacity leave gaps; what could share a sequence still does."""
    lengths = [510 + k % 7 for k in range(1500)] + [5] * 300
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    rows = packing.pack(df, 1000, shard_pieces=100).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(lengths)))
    assert check(rows, 1000) == 1500
    small = [400] * 3 + [530] * 901
    rows = packing.pack(spark.createDataFrame(list(enumerate(small)), "doc_id long, length long"), 1000, shard_pieces=150).collect()
    assert check(rows, 1000) == 901


def test_query_columns(spark, sf):
    out = packing.op1_best_fit_packing(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = out.collect()
    check(rows, 4096)
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r["doc_id"] for r in rows} == set(docs)
    model = Tokenizer.from_file(packing.tokenizer_file())
    for r in rows:
        ids = model.encode(docs[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == min(4096, len(ids) - r["start"]) and r["start"] == 4096 * r["piece"]
