"""Report queries: context, impact, documents, receivers, bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph.operators import reports
from plexigraph.plans.registry import query
from plexigraph.sources import tables as t

P, S = t.PARTS_SQL, t.STRONG_SQL


@query("impact_analysis", f"""WITH {P}, {S}, u1 AS (SELECT DISTINCT source AS id FROM strong WHERE target = 3 AND source <> 3), u2 AS (SELECT DISTINCT source AS id FROM strong WHERE target IN (SELECT id FROM u1) AND source <> 3 AND source NOT IN (SELECT id FROM u1)),
c AS (SELECT (SELECT count(*) FROM u1) AS direct, (SELECT count(*) FROM u2) AS indirect, (SELECT count(*) FROM (SELECT id FROM u1 UNION SELECT id FROM u2) WHERE id IN (SELECT id FROM parts WHERE kind = 'function' AND visibility = 'public')) AS entries)
SELECT direct, indirect, entries, round(least(direct / 10, 0.5) + least(indirect / 40, 0.3) + CASE WHEN entries > 0 THEN 0.2 ELSE 0 END, 4)::DOUBLE AS score,
CASE WHEN direct + indirect >= 10 THEN 'critical' WHEN direct + indirect >= 4 THEN 'high' WHEN direct + indirect >= 2 THEN 'medium' WHEN direct + indirect >= 1 THEN 'low' ELSE 'none' END AS level FROM c""")
def impact_analysis(spark, d):
    entries = t.parts(spark, d).filter("kind = 'function' and visibility = 'public'")
    return reports.impact_analysis(t.strong(spark, d), spark.range(3, 4), entries, 2)


@query("doc_symbol_links", f"""WITH {P}, m AS (SELECT DISTINCT 'doc' || o_custkey % 30 AS path, o_orderkey % 90 AS line_no, split_part(p_name, ' ', 1) AS name FROM orders JOIN part ON p_partkey = o_orderkey % 199),
s AS (SELECT min(id) AS id, split_part(name, ' ', 1) AS name FROM parts GROUP BY 2)
SELECT id, path, line_no FROM m JOIN s USING (name) QUALIFY row_number() OVER (PARTITION BY id ORDER BY path, line_no) <= 5""")
def doc_symbol_links(spark, d):
    part = t.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    o = t.table(spark, d, "orders").select(F.concat(F.lit("doc"), (F.col("o_custkey") % 30).cast("string")).alias("path"), (F.col("o_orderkey") % 90).alias("line_no"), (F.col("o_orderkey") % 199).alias("k"))
    symbols = part.groupBy("name").agg(F.min("k").alias("id"))
    return reports.doc_links(o.join(part, "k").select("path", "line_no", F.concat(F.lit("a::"), "name").alias("name")), symbols)


@query("cangjie_references", f"""WITH {P}, r AS (SELECT id AS ref, module AS file, split_part(name, ' ', 1) AS name, 0.8::DOUBLE AS confidence FROM parts), s AS (SELECT id, module AS file, split_part(name, ' ', 1) AS name FROM parts),
i AS (SELECT DISTINCT module AS file, split_part(name, ' ', 1) AS name, CASE id % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'alias' ELSE 'wildcard' END AS kind, 't' || id % 4 AS t FROM parts),
own AS (SELECT ref, min(s.id)::VARCHAR AS own FROM r JOIN s USING (file, name) GROUP BY ref HAVING count(DISTINCT s.id) = 1),
m AS (SELECT ref, CASE WHEN count(DISTINCT t) = 1 THEN min(t) END AS single, CASE WHEN count(DISTINCT t) FILTER (kind = 'explicit') = 1 THEN min(t) FILTER (kind = 'explicit') END AS ex, CASE WHEN count(DISTINCT t) FILTER (kind = 'alias') = 1 THEN min(t) FILTER (kind = 'alias') END AS al FROM r JOIN i USING (file, name) GROUP BY ref),
x AS (SELECT r.ref, r.confidence, own, single, ex, al, CASE WHEN ex IS NOT NULL AND coalesce(single, ex) = ex THEN 'explicit' WHEN al IS NOT NULL AND coalesce(single, al) = al THEN 'alias' WHEN single IS NOT NULL THEN 'wildcard' END AS k FROM r LEFT JOIN own USING (ref) LEFT JOIN m USING (ref))
SELECT ref, coalesce(own, single, ex, al) AS target, (CASE WHEN own IS NOT NULL THEN confidence WHEN k = 'explicit' THEN 0.85 WHEN k = 'alias' THEN 0.8 WHEN k = 'wildcard' THEN 0.7 ELSE 0 END)::DOUBLE AS confidence, CASE WHEN own IS NOT NULL THEN 'same-file' ELSE coalesce(k, 'unresolved') END AS reason FROM x""")
def cangjie_references(spark, d):
    p = t.parts(spark, d).select("id", F.col("module").alias("file"), F.split_part("name", F.lit(" "), F.lit(1)).alias("name"))
    refs = p.select(F.col("id").alias("ref"), "file", "name", F.lit(0.8).alias("confidence"))
    k = F.col("id") % 3
    imports = p.select("file", "name", F.when(k == 0, "explicit").when(k == 1, "alias").otherwise("wildcard").alias("kind"), F.concat(F.lit("t"), (F.col("id") % 4).cast("string")).alias("target"))
    return reports.cangjie_references(refs, p.withColumn("id", F.col("id").cast("string")), imports)


@query("runner_ladder", """WITH x AS (SELECT o_custkey, count(*) AS affected, count(*) FILTER (o_orderstatus = 'O') AS workflows FROM orders GROUP BY 1) SELECT o_custkey AS project, CASE WHEN affected >= 8 THEN 'critical' WHEN affected >= 4 OR workflows >= 3 THEN 'high' WHEN affected >= 2 THEN 'medium' WHEN affected >= 1 THEN 'low' ELSE 'none' END AS level FROM x""")
def runner_ladder(spark, d):
    by = t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("affected"), F.count_if(F.col("o_orderstatus") == "O").alias("workflows"))
    return by.select("project", reports.runner_ladder(F.col("workflows"), F.col("affected")).alias("level"))


@query("callers_per_symbol", f"WITH {P}, {t.CALLS_SQL} SELECT target AS id, count(DISTINCT source) AS callers, count(DISTINCT file) AS files, count(DISTINCT package) AS packages FROM calls JOIN parts ON parts.id = source GROUP BY target")
def callers(spark, d):
    c = t.calls(spark, d).join(t.parts(spark, d).select(F.col("id").alias("source"), "file", "package"), "source")
    return c.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("callers"), F.count_distinct("file").alias("files"), F.count_distinct("package").alias("packages"))


@query("marker_language", """WITH f AS (SELECT 'p' || p_size AS root, CASE p_partkey % 6 WHEN 0 THEN 'a.rs' WHEN 1 THEN 'b.py' WHEN 2 THEN 'c.ts' ELSE 'd.py' END AS n, CASE WHEN p_partkey % 97 = 0 THEN 'Cargo.toml' WHEN p_partkey % 89 = 0 THEN 'package.json' END AS marker FROM part)
SELECT root, CASE WHEN bool_or(marker = 'Cargo.toml') THEN 'rust' WHEN bool_or(marker = 'package.json') THEN 'javascript' ELSE (SELECT l FROM (SELECT g.root, CASE n WHEN 'a.rs' THEN 'rust' WHEN 'c.ts' THEN 'typescript' ELSE 'python' END AS l, count(*) AS k FROM f g GROUP BY ALL) h WHERE h.root = f.root ORDER BY k DESC, l LIMIT 1) END AS language FROM f GROUP BY root""")
def marker_language(spark, d):
    p = t.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("root"), F.col("p_partkey").alias("k"))
    name = F.when(F.col("k") % 6 == 0, "a.rs").when(F.col("k") % 6 == 1, "b.py").when(F.col("k") % 6 == 2, "c.ts").otherwise("d.py")
    marker = F.when(F.col("k") % 97 == 0, "Cargo.toml").when(F.col("k") % 89 == 0, "package.json")
    files = p.select("root", name.alias("path")).unionByName(p.select("root", marker.alias("path")).filter("path is not null"))
    return reports.marker_language(files)
