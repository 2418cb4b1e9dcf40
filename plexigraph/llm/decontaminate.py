r"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. A window is `size`
consecutive words of an item; an item with fewer words, but not none, is one window. A document
holds a window if the window's words occur there in a row; every document word inside an occurrence
is hit.

1. Rarity. One pass counts the benchmark's words over all documents (map-side sums); the words of
   each window are ordered by that count.
2. Prefix. A document that holds a window holds all of its words, so a prefix of the rarest ones is
   necessary: documents' words are joined with the two rarest places of each window only. Windows
   of an item share such places, and a place is joined once.
3. Bounds. A match at place i of the document and place q of the item aligns the item's first word
   with i - q. The alignment must overlap the document by a window's length at least, and is a
   candidate if two places agree on it (one, where windows are single words).
4. Verification. All of the item's windows are compared with the document's words under that
   alignment, exactly; only documents with a candidate are read for it.

Words of documents are exploded as (document key, place, word) without the text, and only a side
whose counted rows are under `broadcast_rows` is broadcast; larger benchmarks are joined by
exchange. Candidates are grouped by document, never by word, so a passage that a third of all
documents share makes no hot group.

Null text has no words. Null item texts have no windows; items with a null id hit words but can't
be listed or counted. Repeated items count once, repeated documents are judged each. Empty tables
are fine. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plexigraph.llm._common import if_small, stash, table

SIZE = 13
#: Places of a window that documents' words are joined with: two rare words at their distance hardly meet by chance.
PREFIX = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, before or after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _low(text: Column) -> Column:
    """A-Z lower-cased only: lower() does that, and fast, where all is ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _split(text: str) -> Column:
    """The words in their own case, with an empty string first or last where the text starts or ends in a gap."""
    return F.split(F.coalesce(F.col(text), F.lit("")), GAP, -1)


def _split_low(text: str) -> Column:
    """The same with A-Z lower-cased; where words are exploded, lower-casing each of them costs less."""
    return F.split(_low(F.coalesce(F.col(text), F.lit(""))), GAP, -1)


def _empty_first(parts: Column) -> Column:
    return (F.get(parts, F.lit(0)) == "").cast("int")


def _n_words(parts: Column) -> Column:
    last = (F.get(parts, F.size(parts) - 1) == "").cast("int")
    return F.when(F.size(parts) == 1, 1 - last).otherwise(F.size(parts) - _empty_first(parts) - last)


def _words(parts: str) -> Column:
    return F.slice(F.col(parts), _empty_first(F.col(parts)) + 1, _n_words(F.col(parts)))


def items_of(benchmark: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(iid, w array<string>, len, win): distinct items by words, with the length of their windows; and (iid, item)."""
    words = stash(benchmark.select(F.col("item_id").cast("string").alias("item"), _split_low("text").alias("parts")).select("item", _words("parts").alias("w")).filter(F.size("w") > 0), "item-words")
    items = stash(words.select("w").distinct().select(F.monotonically_increasing_id().alias("iid"), "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(size)).alias("win")), "items")
    named = words.filter(F.col("item").isNotNull()).distinct().join(items.select("iid", "w"), "w").select("iid", "item")
    return items, stash(named, "item-ids")


def anchors_of(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, q, iid, len, win): per window of each item its PREFIX rarest places, each place once.

    Windows with a word that no document has are left out.
    """
    starts = items.select("iid", "len", "win", "w", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("win"))).alias("k"))
    placed = starts.select("iid", "len", "win", "k", F.posexplode(F.slice("w", F.col("k") + 1, F.col("win"))).alias("p", "word"))
    ranked = placed.join(counts, "word").groupBy("iid", "len", "win", "k").agg(F.sort_array(F.collect_list(F.struct("n", "word", (F.col("k") + F.col("p")).alias("q")))).alias("places"))
    first = ranked.filter(F.size("places") == F.col("win")).select("iid", "len", "win", F.explode(F.slice("places", 1, PREFIX)).alias("x"))
    return first.select(F.col("x.word").alias("word"), F.col("x.q").alias("q"), "iid", "len", "win").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, percent: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated): one row per document.

    `items` is the sorted list of item ids as strings; a document is contaminated if it has a hit
    and at least `percent` per cent of its words are hit.
    """
    items, named = items_of(benchmark, size)
    small = items.agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0] <= broadcast_rows and named.count() <= broadcast_rows
    held = (lambda x: F.broadcast(x)) if small else (lambda x: x)

    # 1. Rarity of the benchmark's words over all documents. (An outer generator, as the optimiser would
    # else filter by the size of the words first, and so split each text twice; there is always one.)
    vocabulary = items.select(F.explode("w").alias("word")).distinct()
    spoken = docs.select(F.explode_outer(_split("text")).alias("word")).select(_low(F.col("word")).alias("word"))
    counts = stash(spoken.join(held(vocabulary), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n")), "word-counts")

    # 2. Prefixes.
    anchors = stash(anchors_of(items, counts), "anchors")

    # 3. Candidates: alignments of an item and a document, long enough for a window, on which two places agree.
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), _split("text").alias("parts"))
    # Counted under the generator: above it, the words' array would be copied to each of its rows.
    keyed = keyed.select("doc_id", "text_hash", _n_words(F.col("parts")).alias("n_words"), _empty_first(F.col("parts")).alias("skip"), "parts")
    at = keyed.select("doc_id", "text_hash", "n_words", "skip", F.posexplode_outer("parts").alias("k", "word")).withColumn("word", _low(F.col("word")))
    near = at.join(held(anchors), "word").withColumn("diag", F.col("k") - F.col("skip") - F.col("q"))
    overlap = F.least("n_words", F.col("diag") + F.col("len")) - F.greatest("diag", F.lit(0))
    agreed = near.filter(overlap >= F.col("win")).groupBy("doc_id", "text_hash", "iid", "diag", "win").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    candidates = stash(agreed.filter((F.col("lo") < F.col("hi")) | (F.col("win") < PREFIX)).select("doc_id", "text_hash", "iid", "diag", "win"), "candidates")

    # 4. Exact verification against the words, then what each document has been hit by. A window of one word is
    # verified by the join itself.
    single = candidates.filter("win = 1").select("doc_id", "text_hash", "diag", "win", "iid", F.lit(0).alias("k"))
    several = candidates.filter("win > 1")
    keys = several.select(F.col("doc_id").alias("cd"), F.col("text_hash").alias("ch")).distinct()
    full = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("cd")) & (F.col("text_hash") == F.col("ch"))
    some = full.join(if_small(keys, broadcast_rows), same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    c = several.join(held(items.select("iid", "w")), "iid").groupBy(F.col("doc_id").alias("cd"), F.col("text_hash").alias("ch")).agg(F.collect_list(F.struct("diag", F.col("w").alias("iw"), "win", "iid")).alias("c"))
    both = some.join(c, same).select("doc_id", "text_hash", _split_low("text").alias("parts"), "c").select("doc_id", "text_hash", _words("parts").alias("w"), F.explode("c").alias("x"))
    lo, hi = F.greatest(-F.col("x.diag"), F.lit(0)), F.least(F.size("x.iw"), F.size("w") - F.col("x.diag")) - F.col("x.win")
    hit = F.filter(F.sequence(lo, hi), lambda k: F.slice("w", F.col("x.diag") + k + 1, F.col("x.win")) == F.slice("x.iw", k + 1, F.col("x.win")))
    true = both.select("doc_id", "text_hash", "x.diag", "x.win", "x.iid", F.explode(hit).alias("k")).unionByName(single)
    start = F.col("diag") + F.col("k")
    spans = true.groupBy(F.col("doc_id").alias("hd"), F.col("text_hash").alias("hh")).agg(F.sort_array(F.collect_set(F.struct(start.alias("s"), (start + F.col("win")).alias("e")))).alias("found"), F.sort_array(F.collect_set("iid")).alias("iids"))
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    covered = F.aggregate("found", zero, lambda a, x: F.struct((a["total"] + F.greatest(x["e"] - F.greatest(x["s"], a["end"]), F.lit(0))).alias("total"), F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["total"])
    hits = stash(spans.select("hd", "hh", covered.alias("n_hit"), "iids"), "hits")

    # Item ids come in once per set of items that documents share, not with each candidate.
    sets = hits.select("iids").distinct()
    lists = sets.select("iids", F.explode("iids").alias("iid")).join(held(named), "iid").groupBy("iids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = stash(hits.join(lists, "iids", "left").drop("iids"), "hit-items")

    sizes = keyed.select("doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"))
    out = sizes.join(if_small(hits, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("hd")) & (F.col("text_hash") == F.col("hh")), "left")
    n_hit, items = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long"), F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    bad = stash(decontaminate(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).distinct(), "contaminated")
    return docs.join(if_small(bad, 200_000), docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("__h")), "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, ws[i:i + {SIZE - 1}] AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {SIZE - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
firsts AS (SELECT DISTINCT win[1] AS f FROM bw),
place AS (SELECT r, ws, i, ws[i] AS f FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE ws[i] IN (SELECT f FROM firsts)),
occ AS (SELECT p.r, p.i, len(bw.win) AS n, bw.item FROM place p JOIN bw ON bw.win[1] = p.f AND p.ws[p.i:p.i + len(bw.win) - 1] = bw.win),
span AS (SELECT DISTINCT r, i, n FROM occ),
hit AS (SELECT r, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM span) GROUP BY r),
it AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
