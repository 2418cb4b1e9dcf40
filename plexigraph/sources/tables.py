"""Table front end: the star-schema tables as packages, files, symbols, calls and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plexigraph.session import by_exchange, table


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as symbols: (id, name, kind, module, package, file, visibility, line_start, line_end)."""
    size = F.col("p_size")
    kind = F.when(size % 4 == 0, "function").when(size % 4 == 1, "method").when(size % 4 == 2, "struct").otherwise("associated-function")
    start = (F.col("p_partkey") * 7) % 400 + 1
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), F.col("p_brand").alias("module"), F.concat(F.lit("pkg"), (F.col("p_partkey") % 5).cast("string")).alias("package"), F.concat_ws("/", "p_brand", "p_type").alias("file"), F.when(size % 2 == 0, "public").otherwise("private").alias("visibility"), start.alias("line_start"), (start + size).alias("line_end"))


PARTS_SQL = """parts AS (SELECT p_partkey AS id, p_name AS name,
  CASE p_size % 4 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'struct' ELSE 'associated-function' END AS kind,
  p_brand AS module, 'pkg' || (p_partkey % 5) AS package, p_brand || '/' || p_type AS file,
  CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS visibility,
  (p_partkey * 7) % 400 + 1 AS line_start, (p_partkey * 7) % 400 + 1 + p_size AS line_end FROM part)"""


def raw_calls(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive lines of an order as calls (source, target, confidence), repeats included."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), F.round(F.col("l_quantity") / 50, 2).alias("confidence"))
    return rows.filter("target is not null")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls between parts, the most confident of each pair."""
    return raw_calls(spark, d).groupBy("source", "target").agg(F.max("confidence").alias("confidence"))


CALLS_SQL = """raw_calls AS (SELECT * FROM (SELECT l_partkey AS source,
    lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS target,
    round(l_quantity / 50, 2) AS confidence FROM lineitem) WHERE target IS NOT NULL),
calls AS (SELECT source, target, max(confidence) AS confidence FROM raw_calls GROUP BY source, target)"""


def strong(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d).filter("confidence >= 0.9")


STRONG_SQL = CALLS_SQL + ",\nstrong AS (SELECT * FROM calls WHERE confidence >= 0.9)"


def starts(spark: SparkSession, n: int = 6) -> DataFrame:
    return spark.range(n).select("id")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """All levels as nodes: (id, label, kind, name, file)."""
    t = lambda x: table(spark, d, x)
    row = lambda df, id_, label, kind, name, file=None: df.select(id_.alias("id"), F.lit(label).alias("label"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), name.alias("name"), (file if file is not None else F.lit(None).cast("string")).alias("file"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    p = parts(spark, d)
    out = row(spark.range(1), F.lit("repo:tpch"), "repository", "repository", F.lit("tpch"))
    for x in (
        row(t("region"), key("package:", "r_regionkey"), "package", "package", F.col("r_name")),
        row(t("nation"), key("target:", "n_nationkey"), "target", "target", F.col("n_name")),
        row(t("customer"), key("file:c", "c_custkey"), "source-file", "customer", F.col("c_name")),
        row(t("supplier"), key("file:s", "s_suppkey"), "source-file", "supplier", F.col("s_name")),
        row(t("orders"), key("symbol:o", "o_orderkey"), "symbol", "order", F.col("o_orderkey").cast("string"), key("file:c", "o_custkey")),
        row(p, key("symbol:p", "id"), "symbol", F.col("kind"), F.col("name"), F.col("file")),
    ):
        out = out.unionByName(x)
    return out


NODES_SQL = PARTS_SQL + """,
nodes AS (SELECT 'repo:tpch' AS id, 'repository' AS label, 'repository' AS kind, 'tpch' AS name, NULL::VARCHAR AS file
  UNION ALL SELECT 'package:' || r_regionkey, 'package', 'package', r_name, NULL FROM region
  UNION ALL SELECT 'target:' || n_nationkey, 'target', 'target', n_name, NULL FROM nation
  UNION ALL SELECT 'file:c' || c_custkey, 'source-file', 'customer', c_name, NULL FROM customer
  UNION ALL SELECT 'file:s' || s_suppkey, 'source-file', 'supplier', s_name, NULL FROM supplier
  UNION ALL SELECT 'symbol:o' || o_orderkey, 'symbol', 'order', o_orderkey::VARCHAR, 'file:c' || o_custkey FROM orders
  UNION ALL SELECT 'symbol:p' || id, 'symbol', kind, name, file FROM parts)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """All edge families: (edge_type, source, target, confidence)."""
    t = lambda x: table(spark, d, x)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, kind, s, e, c: df.select(F.lit(kind).alias("edge_type"), s.alias("source"), e.alias("target"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"))
    uses = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.round(F.col("l_quantity") / 50, 2)).alias("c"))
    out = row(t("region"), "CONTAINS_PACKAGE", F.lit("repo:tpch"), key("package:", "r_regionkey"), 1.0)
    for x in (
        row(t("nation"), "HAS_TARGET", key("package:", "n_regionkey"), key("target:", "n_nationkey"), 1.0),
        row(t("customer"), "OWNS_SOURCE", key("target:", "c_nationkey"), key("file:c", "c_custkey"), 0.9),
        row(t("supplier"), "OWNS_SOURCE", key("target:", "s_nationkey"), key("file:s", "s_suppkey"), 0.9),
        row(t("orders"), "DEFINES", key("file:c", "o_custkey"), key("symbol:o", "o_orderkey"), 1.0),
        row(uses, "ACCESSES", key("symbol:o", "l_orderkey"), key("symbol:p", "l_partkey"), F.col("c")),
        row(calls(spark, d), "CALLS", key("symbol:p", "source"), key("symbol:p", "target"), F.col("confidence")),
    ):
        out = out.unionByName(x)
    return out


EDGES_SQL = CALLS_SQL + """,
edges AS (SELECT 'CONTAINS_PACKAGE' AS edge_type, 'repo:tpch' AS source, 'package:' || r_regionkey AS target, 1.0::DOUBLE AS confidence FROM region
  UNION ALL SELECT 'HAS_TARGET', 'package:' || n_regionkey, 'target:' || n_nationkey, 1.0 FROM nation
  UNION ALL SELECT 'OWNS_SOURCE', 'target:' || c_nationkey, 'file:c' || c_custkey, 0.9 FROM customer
  UNION ALL SELECT 'OWNS_SOURCE', 'target:' || s_nationkey, 'file:s' || s_suppkey, 0.9 FROM supplier
  UNION ALL SELECT 'DEFINES', 'file:c' || o_custkey, 'symbol:o' || o_orderkey, 1.0 FROM orders
  UNION ALL SELECT 'ACCESSES', 'symbol:o' || l_orderkey, 'symbol:p' || l_partkey, max(round(l_quantity / 50, 2)) FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'CALLS', 'symbol:p' || source, 'symbol:p' || target, confidence FROM calls)"""


def files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files: (path, text)."""
    return table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


FILES_SQL = "files AS (SELECT source || '/doc' || doc_id || '.txt' AS path, text FROM documents)"


def hunks(spark: SparkSession, d: str) -> DataFrame:
    """Change hunks over the parts' files, from lineitem: (hunk, file, new_start, new_end, change_kind)."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws("/", "p_brand", "p_type").alias("file"))
    li = table(spark, d, "lineitem").filter("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("l_partkey"))
    start = (F.col("l_orderkey") * 13) % 450 + 1
    return li.join(by_exchange(part), "l_partkey").select(F.col("l_orderkey").alias("hunk"), "file", start.alias("new_start"), (start + F.col("l_orderkey") % 5).alias("new_end"), F.when(F.col("l_orderkey") % 3 == 0, "added").when(F.col("l_orderkey") % 3 == 1, "modified").otherwise("deleted").alias("change_kind"))


HUNKS_SQL = """hunks AS (SELECT l_orderkey AS hunk, p_brand || '/' || p_type AS file, (l_orderkey * 13) % 450 + 1 AS new_start,
  (l_orderkey * 13) % 450 + 1 + l_orderkey % 5 AS new_end,
  CASE l_orderkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS change_kind
  FROM (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)
  JOIN part ON p_partkey = l_partkey)"""


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(budget, value) and (target, metric, value) of a regression baseline in JSON: {budgets, targets: {name: {metrics, qualityMetrics, elapsedSeconds}}}."""
    kind = "struct<budgets: map<string, double>, targets: map<string, struct<metrics: map<string, double>, qualityMetrics: map<string, double>, elapsedSeconds: double>>>"
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    budgets = j.select(F.explode("j.budgets").alias("budget", "value"))
    t = j.select(F.explode("j.targets").alias("target", "t"))
    every = F.map_concat(F.coalesce("t.metrics", F.create_map().cast("map<string,double>")), F.coalesce("t.qualityMetrics", F.create_map().cast("map<string,double>")), F.when(F.col("t.elapsedSeconds").isNull(), F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("elapsedSeconds"), "t.elapsedSeconds")))
    return budgets, t.select("target", F.explode(every).alias("metric", "value"))
