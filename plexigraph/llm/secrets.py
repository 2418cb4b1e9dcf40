r"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by its content (SHA-256 of the text). The ledger records which
(blob, rule, rule version) triples have been scanned; a run scans blobs for which a triple is
missing, and only with the missing rules, stores what it found by blob, and joins findings back to
every path that has or had the blob. Changing a rule's version rescans that rule alone.

A group of copies costs one scan: blobs are reduced by map-side aggregation before their exchange.
Matches come from `regexp_extract_all`; positions from running sums over the lengths of the matches
and of the pieces between them (`split` by the same pattern), so they are code points, end
exclusive, leftmost and non-overlapping per kind, and a text with many matches costs a sort of them. Kinds over whole texts: see RULES. Base kinds are assign, access and hex;
`pem` (private-key blocks' first lines) and `bearer` (authorization headers) are added ones.

Null text is an empty text. Repeated rows are paths of their own and get the same findings. An empty
table, or an empty ledger, is fine. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plexigraph.llm._common import if_small, stash, table

@dataclass(frozen=True)
class Rule:
    """`group` must have `least` code points, else the match is dropped. `rank` orders ties.

    `probe` is a cheap necessary pattern, so texts without one skip the exact one.
    """

    kind: str
    rank: int
    pattern: str
    probe: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Fixed patterns of the base kinds (Java and RE2 read them alike), then the added ones.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", 0, ASSIGN, r"""(?:[Dd]|[Tt]|[Nn]|[Yy])["']?\x20*[:=]""", group=2, least=12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", "AKIA", least=18),
    Rule("hex", 2, r"[0-9a-f]{16,}", "[0-9a-f]{16}", least=16),
    Rule("pem", 3, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("bearer", 4, r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", "earer "),
)


#: A match as lengths: of the piece before it, of the match, of the group that must have `least` code points.
_MATCHES = "array<struct<rank:int,i:int,p:bigint,w:bigint,g:int>>"


def matches_of(text: Column, rule: Rule) -> Column:
    """The rule's matches in text, in order. Lengths only: adding them up is left to a running sum."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    zipped = F.arrays_zip(whole.alias("w"), F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("p"), groups.alias("g"))
    found = F.transform(zipped, lambda m, i: F.struct(F.lit(rule.rank).alias("rank"), i.alias("i"), F.length(m["p"]).cast("long").alias("p"), F.length(m["w"]).cast("long").alias("w"), F.length(m["g"]).alias("g")))
    return F.when(text.rlike(rule.probe), found).otherwise(F.array().cast(_MATCHES))


def blob_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def missing(blobs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): blobs(blob) for which the ledger lacks a rule's version, with those rules' kinds. No text is read."""
    now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "rule_version")).alias("__done"))
    todo = F.transform(F.array_except(now, F.coalesce("__done", F.array().cast("array<struct<kind:string,rule_version:int>>"))), lambda x: x["kind"])
    return blobs.distinct().join(done, "blob", "left").select("blob", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger) for versions(path, text).

    findings(blob, kind, rule_version, rank, start, end) are of this run's newly scanned pairs.
    ledger(blob, kind, rule_version) is the given one with them added. Keep both; `findings_of`
    joins any number of runs' findings back to paths. With a ledger, hashes meet it first, and only
    texts of blobs that lack a pair are fetched.
    """
    blobs = versions.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
    if ledger is None:
        unseen = blobs.dropDuplicates(["blob"]).withColumn("todo", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        todo = stash(missing(blobs.select("blob"), ledger, rules), "todo")
        held = if_small(todo, broadcast_rows)
        if held is not todo:  # few: texts of other blobs don't leave their tasks
            blobs = blobs.join(held.select("blob"), "blob", "left_semi")
        unseen = blobs.dropDuplicates(["blob"]).join(held, "blob")
    none = F.array().cast(_MATCHES)
    parts = [F.when(F.array_contains("todo", r.kind), matches_of(F.col("text"), r)).otherwise(none) for r in rules]
    mark = F.array(F.struct(F.lit(-1).alias("rank"), F.lit(-1).alias("i"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("w"), F.lit(0).alias("g"))).cast(_MATCHES)
    rows = unseen.select("blob", F.concat(mark, *parts).alias("m"), "todo").select("blob", "todo", F.inline("m"))
    # A match ends where all pieces and matches up to it add up to; blobs are partitioned by their hash already.
    end = F.sum(F.col("p") + F.col("w")).over(Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    least = F.create_map(*[x for r in rules for x in (F.lit(r.rank), F.lit(r.least))])
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("w"))
    kept = placed.filter((F.col("rank") < 0) | (F.col("g") >= F.coalesce(least[F.col("rank")], F.lit(0))))
    scanned = stash(kept.select("blob", F.when(F.col("rank") < 0, F.col("todo")).alias("todo"), "rank", "start", "end"), "blobs")
    version = lambda key, by: F.create_map(*[x for r in rules for x in (F.lit(getattr(r, key)), F.lit(getattr(r, by)))])
    findings = scanned.filter("rank >= 0").select("blob", version("rank", "kind")[F.col("rank")].alias("kind"), "rank", "start", "end", version("rank", "version")[F.col("rank")].alias("rule_version"))
    new = scanned.filter("rank < 0").select("blob", F.explode("todo").alias("kind")).withColumn("rule_version", version("kind", "version")[F.col("kind")])
    return findings, (new if ledger is None else ledger.select("blob", "kind", "rule_version").unionByName(new))


def findings_of(versions: DataFrame, findings: DataFrame) -> DataFrame:
    """versions(path, blob) with `found`: the sorted spans of its blob, empty where none."""
    # Stored first: a join whose sides are plain exchanges can be split where one blob has many paths.
    own = stash(findings.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("found")), "findings")
    return versions.join(own, "blob", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start bigint, rank int, `end` bigint, kind string>>)")))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a history in two steps: documents of the lower half of the ids, then all others.

    The second step scans only pairs of blob and rule version that the first one's ledger lacks.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ends = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.coalesce(F.col("doc_id") <= F.lit(None if ends[0] is None else (ends[0] + ends[1]) // 2).cast("long"), F.lit(False))
    first, ledger = scan(docs.filter(early))
    second, _ = scan(docs.filter(~early), ledger)
    out = findings_of(docs.select("doc_id", blob_of(F.col("text")).alias("blob")), first.unionByName(second))
    base = F.filter("found", lambda x: x["rank"] <= 2)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(F.encode(_joined(base), "UTF-8"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _kind_sql(rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT r, kind, rank, s AS start, s + length(w) AS "end" FROM (
    SELECT r, '{rule.kind}' AS kind, {rule.rank} AS rank, w, g,
           (sum(length(p)) OVER o + sum(length(w)) OVER o - length(w))::BIGINT AS s
    FROM (SELECT r, i, ws[i] AS w, gs[i] AS g, ps[i] AS p FROM (
            SELECT r, ws, gs, ps, unnest(range(1, len(ws) + 1)) AS i FROM (
              SELECT r, regexp_extract_all(text, '{pattern}') AS ws, regexp_extract_all(text, '{pattern}', {rule.group}) AS gs,
                     regexp_split_to_array(text, '{pattern}') AS ps FROM d WHERE regexp_matches(text, '{pattern}'))))
    WINDOW o AS (PARTITION BY r ORDER BY i)) WHERE length(g) >= {rule.least}"""


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_kind_sql(r) for r in RULES)}),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (rank <= 2) AS base,
        string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
