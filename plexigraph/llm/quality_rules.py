r"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one `failed` long
with a bit per rule; policies are versioned masks over those bits, so a new policy, or the question
what a policy would keep without one of its rules, never reads a text again.

Measurements over words `[^\x20\x09-\x0D]+` of the whole text: n_words, word_chars (code points in
words), n_symbols (characters of `[#*$%&|<>]`), n_lines (\n-split lines with a word), n_dup_lines
(those equal to an earlier one), n_repeat_words (words inside 5-word windows that occur twice or
more in the text), n_capitals (A-Z), n_echo_words (words equal to the one before).

Each document is its own row from scan to result: no exchange, so no skew. Repeated windows are
looked for by 64-bit hashes in linear time first; only texts with two equal hashes go through the
exact, sorted comparison of the windows themselves, in n log n.

Null and empty texts have no words and fail `few_words`. Repeated rows are judged each. An empty
table gives an empty ledger. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plexigraph.llm._common import stash, table

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_echo_words"]
WINDOW = 5

#: (bit, name, condition for failing); integers only, so every engine agrees.
RULES = [
    (0, "few_words", "n_words < 10"),
    (1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    (2, "symbols", "10 * n_symbols > 2 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    (4, "word_length", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    (5, "capitals", "100 * n_capitals > 50 * word_chars"),
    (6, "echoes", "100 * n_echo_words > 30 * n_words"),
]
BASE = 0b11


@dataclass(frozen=True)
class Policy:
    version: int
    mask: int


#: Policies by version; the last is the one in force.
POLICIES = (Policy(1, BASE), Policy(2, BASE | 0b111100), Policy(3, BASE | 0b1111100))


def _repeat_words(words: Column, sorted_windows: Column) -> Column:
    """Words covered by windows that equal a neighbour in the sorted windows."""
    n = F.size(sorted_windows)

    def equal(x, k):
        before = F.get(sorted_windows, k - 1)["w"] == x["w"]
        after = F.get(sorted_windows, k + 1)["w"] == x["w"]
        return ((k > 0) & before) | ((k < n - 1) & after)

    places = F.sort_array(F.transform(F.filter(sorted_windows, equal), lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["total"] + i + WINDOW - F.greatest(i, a["end"])).alias("total"), (i + WINDOW).alias("end"))
    return F.aggregate(places, start, step, lambda a: a["total"])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed): one row per document."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    d = d.withColumn("__w", F.regexp_extract_all("__t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    d = d.withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    last = F.size("__w") - (WINDOW - 1)
    d = d.withColumn("__h", F.when(last > 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("__w", i, WINDOW)))))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    exact = F.sort_array(F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.array_join(F.slice("__w", i, WINDOW), " ").alias("w"), i.alias("i"))))
    d = d.withColumn("__s", F.when((last > 1) & twice, exact))
    d = d.select(
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("__s").isNull(), 0).otherwise(_repeat_words(F.col("__w"), F.col("__s"))).cast("long").alias("n_repeat_words"),
        F.regexp_count("__t", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.size(F.filter("__w", lambda w, k: (k > 0) & (w == F.get("__w", k - 1)))).cast("long").alias("n_echo_words"),
    )
    bits = " | ".join(f"if({cond}, {1 << bit}L, 0L)" for bit, _, cond in RULES)
    return d.withColumn("failed", F.expr(bits))


def apply_policies(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """The ledger with kept_v<version> for each policy."""
    return rows.select("*", *[(F.col("failed").bitwiseAND(F.lit(p.mask)) == 0).alias(f"kept_v{p.version}") for p in policies])


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of a policy: (rule, n_failed, n_only, n_kept_without).

    Documents are first counted by their failed bits, at most 2^rules rows however large the
    corpus; n_only are those that no other rule of the policy rejects, and would come back
    without it.
    """
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("bit")) for bit, name, _ in RULES if policy.mask >> bit & 1])
    each = counts.select("bits", "n", F.inline(rules))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"), total(F.col("bits") == F.col("bit")).alias("n_only"), total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The ledger is stored: policies, and any later question about them, read its narrow rows only.
    rows = apply_policies(stash(ledger(table(spark, sf_dir, "documents")), "quality-ledger"))
    base = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col(f"kept_v{POLICIES[-1].version}")).alias("kept"), "failed")


_SQL_BITS = " + ".join(f"(CASE WHEN {cond} THEN {1 << bit} ELSE 0 END)" for bit, _, cond in RULES)
OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS v FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS c FROM win) WHERE c > 1),
hit AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM rep, range(0, 5) t(k) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(hit.n, 0)::BIGINT AS n_repeat_words,
             len(regexp_extract_all(text, '[A-Z]'))::BIGINT AS n_capitals,
             len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_echo_words
      FROM w LEFT JOIN hit USING (r)),
f AS (SELECT *, ({_SQL_BITS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE}) <> 0 AS base_failed,
       (failed & {POLICIES[-1].mask | BASE}) = 0 AS kept, failed FROM f
"""
