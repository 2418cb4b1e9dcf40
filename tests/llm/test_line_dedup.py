import hashlib

import numpy as np

from plexigraph.llm import line_dedup
from plexigraph.llm.mph import CountShard, PerfectHash


def brute(rows, least, min_chars=1):
    split = [[x for x in (t or "").split("\n")] for _, t in rows]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    counts = {}
    for own in split:
        for k in {key(x) for x in own}:
            counts[k] = counts.get(k, 0) + 1
    out = []
    for (i, _), own in zip(rows, split, strict=True):
        kept = [x for x in own if len(key(x)) < min_chars or counts[key(x)] < least]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_perfect_hash_is_minimal_and_exact():
    keys = np.random.default_rng(3).integers(0, 2**63, 20_000, dtype=np.uint64)
    assert sorted(PerfectHash(keys).slots(keys)) == list(range(20_000))
    h2 = keys[::-1].copy()
    shard = CountShard.from_bytes(CountShard(keys, h2, np.arange(1, 20_001)).to_bytes())
    assert (shard.lookup(keys, h2) == np.arange(1, 20_001)).all()
    assert (shard.lookup(keys, h2 ^ np.uint64(1)) == 0).all()
    assert len(CountShard(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)).lookup(keys[:2], h2[:2])) == 2


ROWS = [(i, f"head {i}\n  Common LINE\t\nübung {i % 4}\n\nÜBUNG x") for i in range(12)] + [(50, None), (51, ""), (52, "common line"), (52, "common line"), (None, "\n\n"), (53, "x" * 200_000 + "\nCOMMON LINE")]


def test_brute_force(make):
    docs = make(ROWS).withColumnRenamed("source", "n_lines")
    assert result(line_dedup.dedup_lines(docs, 10)) == brute(ROWS, 10)
    assert result(line_dedup.dedup_lines(docs, 3)) == brute(ROWS, 3)
    assert result(line_dedup.dedup_lines(docs, 3, min_chars=9)) == brute(ROWS, 3, 9)


def test_blocks_of_the_index_agree(make, monkeypatch):
    rows = [(i, "\n".join(f"line {k}" for k in range(60)) + f"\nown {i}") for i in range(11)]
    real = line_dedup.build_index
    monkeypatch.setattr(line_dedup, "build_index", lambda c, m: real(c, m, shard_keys=7))
    assert result(line_dedup.dedup_lines(make(rows), 10, block_bytes=3000)) == brute(rows, 10)


def test_text_and_null(make):
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make([(i, "same\nown %d" % i) for i in range(10)] + [(99, None)]), 10).collect()}
    assert out[3] == "own 3" and out[99] is None


def test_empty_table(make):
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_an_index_too_large_to_send_is_probed_at_its_shards(make, monkeypatch):
    """Tiny bounds: a shard per few lines, several tasks a shard; no stored table has a text."""
    stored = []
    real, real_stash = line_dedup.build_index, line_dedup.stash
    monkeypatch.setattr(line_dedup, "build_index", lambda c, m: real(c, m, shard_keys=2))
    monkeypatch.setattr(line_dedup, "stash", lambda df, tag: stored.append(df.columns) or real_stash(df, tag))
    docs = make(ROWS).withColumnRenamed("source", "n_lines")
    for least, chars in ((10, 1), (3, 1), (3, 9)):
        assert result(line_dedup.dedup_lines(docs, least, min_chars=chars, block_bytes=0, task_lines=5)) == brute(ROWS, least, chars)
    hot = [(i, "same\nsame\nalso same") for i in range(300)] + [(900, "own")]
    assert result(line_dedup.dedup_lines(make(hot), 10, block_bytes=0, task_lines=20)) == brute(hot, 10)
    assert stored and not any("text" in c or "t" in c for c in stored)
