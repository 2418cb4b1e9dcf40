r"""Line dedup: drop lines whose key is found in many documents.

Method: a sharded minimal perfect hash over the distinct hashes of recurring lines indexes compact
fingerprint and count arrays; documents probe those arrays, lines are never joined.

1. Count. Each Arrow batch hashes its lines (128 bits of BLAKE2b), once per document, and sends one
   partial count per distinct line on; Spark sums them. A line in a third of all documents is one
   row per batch here, so it can't overload a task.
2. Index. Lines found in at least `min_docs` documents are dealt into shards of about `shard_keys`
   keys by their hash, and each task turns its shard into one blob: perfect hash, 64-bit
   fingerprints, counts. Rarer lines need no entry: the fingerprint turns them away.
3. Probe. An index of up to `block_bytes`, as summed, is sent to every executor, and documents probe
   it as they are rewritten. A larger one stays where it is: the hashes of each text's lines go to
   the shards once, as narrow rows, are probed there, and what is found comes back to the texts by a
   128-bit hash of the text. Either way texts are read at most three times and never stored, however
   large the index.

A line's key is the line stripped of [\x20\x09-\x0D] at both ends with A-Z lower-cased. Lines with
keys under `min_chars` code points are always kept. Null text counts as one empty line and stays
null in `text`; an empty text has one empty line too. Repeated rows are documents of their own.
An empty table gives an empty result. Input columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plexigraph.llm._common import cache_of, if_small, parts, stash, table, without
from plexigraph.llm.mph import CountShard

SPACE = b" \t\n\x0b\x0c\r"
ROWS = 512
ADDED = ["n_lines", "n_dropped", "kept_sha256"]
HITS = "array<struct<h1:bigint,h2:bigint>>"


def _key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join([hashlib.blake2b(k, digest_size=16).digest() for k in keys]), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def count_lines(docs: DataFrame, min_chars: int = 1, text: str = "text") -> DataFrame:
    """(h1, h2, n): in how many documents each distinct line key is found."""

    def partial(batches):
        cache_of("line_dedup")
        for batch in parts(batches, 0, ROWS):
            counts: dict[bytes, int] = {}
            for t in batch.column(0):
                if (s := t.as_py()) is not None:
                    for k in {_key(x) for x in s.encode("utf-8").split(b"\n")}:
                        counts[k] = counts.get(k, 0) + 1
            keys = [k for k in counts if _long_enough(k, min_chars)]
            h1, h2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([counts[k] for k in keys], pa.int64())], ["h1", "h2", "n"])

    return docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(partial, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def build_index(counts: DataFrame, min_docs: int, shard_keys: int = 50_000) -> DataFrame:
    """(shard, shards, blob, bytes): one row per shard of the lines found in min_docs documents or more."""
    often = stash(counts.filter(F.col("n") >= min_docs), "lines")
    shards = max(1, -(-often.count() // shard_keys))

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("h1", "ascending"), ("h2", "ascending")])
        h1, h2, n = (table.column(c).to_numpy() for c in ("h1", "h2", "n"))
        blob = CountShard(h1.astype(np.uint64), h2.astype(np.uint64), n).to_bytes()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "shards": pa.array([shards], pa.int32()), "blob": pa.array([blob], pa.binary()), "bytes": pa.array([len(blob)], pa.int64())})

    dealt = often.withColumn("shard", F.expr(f"cast(pmod(h1, {shards}) as int)"))
    return stash(dealt.groupBy("shard").applyInArrow(build, "shard int, shards int, blob binary, bytes long"), "line-index")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", block_bytes: int = 64 << 20, task_lines: int = 1_000_000) -> DataFrame:
    """docs with recurring lines taken out of `text`, and n_lines, n_dropped, kept_sha256 added."""
    spark = docs.sparkSession
    docs = without(docs, [*ADDED, "__k1", "__k2", "__hit"])
    index = build_index(count_lines(docs, min_chars, text), min_docs)
    size, shards = index.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("shards"), F.lit(1))).first()
    if size > block_bytes:
        return _drop_marked(docs, _hits_by_shard(docs, index, shards, min_docs, min_chars, text, task_lines), text)
    held = spark.sparkContext.broadcast({r["shard"]: bytes(r["blob"]) for r in index.select("shard", "blob").collect()})  # block_bytes at most
    tag = uuid.uuid4().hex

    def find(keys: list[list[bytes]], _):
        cache = cache_of("line_dedup")
        if tag not in cache:
            cache.clear()
            cache[tag] = {s: CountShard.from_bytes(b) for s, b in held.value.items()}
        seen = [k for k in {k for own in keys for k in own} if _long_enough(k, min_chars)]
        h1, h2 = _hashes(seen)
        gone = {k for k, n in zip(seen, _counts(cache[tag], shards, h1, h2), strict=True) if n >= min_docs}
        return [[k in gone for k in own] for own in keys]

    return _rewrite(docs.withColumn("__hit", F.lit(None).cast(HITS)), text, find)


def _counts(index: dict[int, CountShard], shards: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    shard, out = np.mod(h1, shards), np.zeros(len(h1), np.int64)
    for s in np.unique(shard):
        if s in index:
            own = shard == s
            out[own] = index[s].lookup(h1[own].astype(np.uint64), h2[own].astype(np.uint64))
    return out


def _rewrite(docs: DataFrame, text: str, find) -> DataFrame:
    """docs without __hit, its lines dropped where find(keys of each text, their hits) says so, and ADDED."""
    names = [c for c in docs.columns if c != "__hit"]
    docs = docs.select(*[docs[f"`{c}`"] for c in names], "__hit")
    at = names.index(text)
    schema = T.StructType([f for f in docs.schema.fields if f.name != "__hit"]).add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def run(batches):
        cache_of("line_dedup")
        for batch in parts(batches, at, ROWS):
            texts = batch.column(at).to_pylist()
            lines = [(t or "").encode("utf-8").split(b"\n") for t in texts]
            drops = find([[_key(x) for x in own] for own in lines], batch.column(len(names)).to_pylist())
            kept = [b"\n".join([x for x, y in zip(own, d, strict=True) if not y]) for own, d in zip(lines, drops, strict=True)]
            cols = list(batch.columns[: len(names)])
            cols[at] = pa.array([None if t is None else k.decode("utf-8") for t, k in zip(texts, kept, strict=True)], cols[at].type)
            cols += [pa.array([len(d) for d in drops], pa.int64()), pa.array([sum(d) for d in drops], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(cols, [*names, *ADDED])

    return docs.mapInArrow(run, schema)


def _text_key(text: str):
    """128 bits that stand for a text; equal texts lose equal lines."""
    return F.xxhash64(F.col(f"`{text}`")).alias("__k1"), F.xxhash64(F.lit(7), F.col(f"`{text}`")).alias("__k2")


def _hits_by_shard(docs: DataFrame, index: DataFrame, shards: int, min_docs: int, min_chars: int, text: str, task_lines: int) -> DataFrame:
    """(__k1, __k2, __hit): per text with recurring lines their hashes. Line hashes go to the shard that indexes them.

    A shard's hashes are split over as many tasks as their counted number asks for, each with the
    shard's blob, so a line in a third of all documents is spread as well.
    """

    def emit(batches):
        cache_of("line_dedup")
        for batch in parts(batches, 2, ROWS):
            seen, cols = set(), ([], [])
            keys: list[bytes] = []
            for k1, k2, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t is None or (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                own = [k for k in {_key(x) for x in t.encode("utf-8").split(b"\n")} if _long_enough(k, min_chars)]
                keys += own
                cols[0].extend([k1] * len(own))
                cols[1].extend([k2] * len(own))
            h1, h2 = _hashes(keys)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(h1), pa.array(h2)], ["k1", "k2", "h1", "h2"])

    every = docs.select(*_text_key(text), F.col(f"`{text}`").alias("t")).mapInArrow(emit, "k1 long, k2 long, h1 long, h2 long")
    lines = stash(every.withColumn("shard", F.expr(f"cast(pmod(h1, {shards}) as int)")), "line-hashes")
    tasks = stash(lines.groupBy("shard").agg(F.ceil(F.count("*") / task_lines).cast("int").alias("tasks")), "line-tasks")  # a row per shard
    dealt = lines.join(if_small(tasks, 100_000), "shard").withColumn("part", F.expr("cast(pmod(xxhash64(k1, h1), tasks) as int)"))
    blobs = index.join(if_small(tasks, 100_000), "shard").withColumn("part", F.explode(F.expr("sequence(0, tasks - 1)"))).select("shard", "part", "blob")

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h1, h2 = left.column("h1").to_numpy(), left.column("h2").to_numpy()
        hit = np.zeros(len(h1), bool)
        if len(h1) and right.num_rows:
            hit = CountShard.from_bytes(right.column("blob")[0].as_py()).lookup(h1.astype(np.uint64), h2.astype(np.uint64)) >= min_docs
        return left.select(["k1", "k2", "h1", "h2"]).filter(pa.array(hit))

    found = dealt.groupBy("shard", "part").cogroup(blobs.groupBy("shard", "part")).applyInArrow(probe, "k1 long, k2 long, h1 long, h2 long")
    return found.groupBy(F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_set(F.struct("h1", "h2")).cast(HITS).alias("__hit"))


def _drop_marked(docs: DataFrame, hits: DataFrame, text: str) -> DataFrame:
    def find(keys: list[list[bytes]], hits: list):
        out = []
        for own, hit in zip(keys, hits, strict=True):
            gone = {(x["h1"], x["h2"]) for x in hit or []}
            out.append([pair in gone for pair in zip(*(h.tolist() for h in _hashes(own)), strict=True)] if gone else [False] * len(own))
        return out

    k1, k2 = _text_key(text)
    # Stored first: a join whose sides are plain exchanges can be split where one text has many rows.
    marked = docs.select("*", k1, k2).join(stash(hits, "line-hits"), ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return _rewrite(marked, text, find)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, min_docs=10, min_chars=1).select("doc_id", *ADDED)


_EDGE = "[\\x20\\x09-\\x0D]"
OP6_SQL = rf"""
WITH lines AS (
  SELECT d.rowid_ AS r, d.doc_id, u.line, u.pos,
         translate(regexp_replace(regexp_replace(u.line, '^{_EDGE}+', ''), '{_EDGE}+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS text FROM documents) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u
), often AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(o.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.k IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN often o USING (k) GROUP BY r, doc_id
"""
