"""Change, text, workspace and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph.functions import paths
from plexigraph.operators import change, core, scores, text, traverse, workspace
from plexigraph.plans.registry import query
from plexigraph.sources import tables as t

P, S = t.PARTS_SQL, t.STRONG_SQL

_SNAP = """old AS (SELECT 'o' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.md' ELSE '.py' END AS path, o_orderstatus || o_totalprice::BIGINT AS h FROM orders WHERE o_orderkey % 11 <> 0),
new AS (SELECT 'o' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.md' ELSE '.py' END AS path, o_orderstatus || (o_totalprice::BIGINT + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) AS h FROM orders WHERE o_orderkey % 13 <> 0),
diff AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.h = n.h THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.path = n.path)"""


def _snapshots(spark, d):
    k = F.col("o_orderkey")
    o = t.table(spark, d, "orders").withColumn("path", F.concat(F.lit("o"), k.cast("string"), F.when(k % 3 == 0, ".rs").when(k % 3 == 1, ".md").otherwise(".py")))
    price = F.round("o_totalprice").cast("long")
    old = o.filter(k % 11 != 0).select("path", F.concat("o_orderstatus", price.cast("string")).alias("content_hash"))
    new = o.filter(k % 13 != 0).select("path", F.concat("o_orderstatus", (price + F.when(k % 7 == 0, 1).otherwise(0)).cast("string")).alias("content_hash"))
    return old, new


@query("snapshot_diff", f"WITH {_SNAP.replace('o_totalprice::BIGINT', 'round(o_totalprice)::BIGINT')} SELECT * FROM diff")
def snapshot_diff(spark, d):
    return change.snapshot_diff(*_snapshots(spark, d))


@query("incremental_plan", f"""WITH {_SNAP.replace('o_totalprice::BIGINT', 'round(o_totalprice)::BIGINT')}, c AS (SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed FROM diff)
SELECT *, 'fullAnalysis' AS strategy, (SELECT string_agg(path, ',' ORDER BY path) FROM (SELECT path FROM diff WHERE status <> 'unchanged' ORDER BY path LIMIT 20)) AS preview, greatest(modified + added + removed - 20, 0) AS omitted FROM c""")
def incremental_plan(spark, d):
    return change.incremental_plan(change.snapshot_diff(*_snapshots(spark, d)))


@query("compare_runs", f"""WITH {S}, o AS (SELECT source, target FROM strong WHERE source % 9 <> 0), n AS (SELECT source, target FROM strong WHERE target % 8 <> 0)
SELECT source, target, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT source, target, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def compare_runs(spark, d):
    e = t.strong(spark, d)
    return change.compare_runs(e.filter("source % 9 <> 0"), e.filter("target % 8 <> 0"), ["source", "target"])


@query("baseline_drift", """WITH b AS (SELECT p_brand AS target, 'nodeCount' AS metric, count(*)::DOUBLE AS v, (count(*) FILTER (p_size > 6))::DOUBLE AS c FROM part GROUP BY 1 UNION ALL SELECT p_brand, 'elapsed', sum(p_size), sum(p_size * 1.0 + p_size % 2 * p_size) FROM part GROUP BY 1
UNION ALL SELECT p_brand, 'rate', count(*) FILTER (p_size > 25) / count(*), count(*) FILTER (p_size > 22) / count(*) FROM part GROUP BY 1),
x AS (SELECT target, metric, round(CASE WHEN metric = 'rate' THEN c - v WHEN v = 0 THEN 0 ELSE (c - v) / v END, 4) AS change FROM b), y AS (SELECT *, CASE WHEN metric IN ('rate', 'elapsed') THEN change ELSE -change END AS z FROM x)
SELECT target, metric, change, CASE WHEN z >= CASE metric WHEN 'rate' THEN 0.1 WHEN 'elapsed' THEN 1.5 ELSE 0.2 END THEN 'fail' WHEN z >= CASE metric WHEN 'rate' THEN 0.05 WHEN 'elapsed' THEN 0.5 ELSE 0.1 END THEN 'warn' ELSE 'ok' END AS level FROM y""")
def baseline_drift(spark, d):
    p = t.table(spark, d, "part").groupBy(F.col("p_brand").alias("target")).agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 6).alias("m"), F.sum("p_size").alias("e"), F.sum(F.col("p_size") + F.col("p_size") % 2 * F.col("p_size")).alias("f"), (F.count_if(F.col("p_size") > 25) / F.count("*")).alias("r"), (F.count_if(F.col("p_size") > 22) / F.count("*")).alias("q"))
    long = lambda a, b, c: p.select("target", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(x).cast("double").alias("value")) for m, x in (("nodeCount", a), ("elapsed", b), ("rate", c))])))
    return change.baseline_drift(long("n", "e", "r"), long("m", "f", "q"))


@query("fingerprint", """SELECT p_brand AS package, count(*) AS n, (sum(('0x' || substr(md5(p_partkey || '|' || p_name || '|' || p_size), 1, 15))::BIGINT::HUGEINT) % 2305843009213693951)::BIGINT AS fingerprint FROM part GROUP BY p_brand""")
def fingerprint(spark, d):
    return change.fingerprint(t.table(spark, d, "part").withColumn("package", F.col("p_brand")), ["p_partkey", "p_name", "p_size"], ["package"])


@query("severity_max", """SELECT p_brand AS project, max(greatest(CASE WHEN p_size > 45 THEN 4 WHEN p_size > 30 THEN 3 ELSE 1 END, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 0 END)) AS rank,
CASE max(greatest(CASE WHEN p_size > 45 THEN 4 WHEN p_size > 30 THEN 3 ELSE 1 END, CASE p_type WHEN 'PROMO' THEN 3 WHEN 'ECONOMY' THEN 2 ELSE 0 END)) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' ELSE 'none' END AS level FROM part GROUP BY p_brand""")
def severity_max(spark, d):
    a = F.when(F.col("p_size") > 45, "Critical").when(F.col("p_size") > 30, "HIGH").otherwise("low")
    b = F.when(F.col("p_type") == "PROMO", "high").when(F.col("p_type") == "ECONOMY", "medium").otherwise("info")
    by = t.table(spark, d, "part").groupBy(F.col("p_brand").alias("project")).agg(F.max(F.greatest(scores.severity_rank(a), scores.severity_rank(b))).alias("rank"))
    return by.withColumn("level", scores.severity_name(F.col("rank")))


_PROJECTS = """projects AS (SELECT 'project:' || n_nationkey AS id, 'workspace:' || n_regionkey AS workspace, n_name AS name, n_nationkey % 4 <> 0 AS supported FROM nation)"""
_WS = f"""{_PROJECTS}, trade AS (SELECT DISTINCT 'project:' || c_nationkey AS source, 'project:' || s_nationkey AS target, 0.85::DOUBLE AS confidence FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
 WHERE c_nationkey <> s_nationkey AND l_linenumber = 1),
adj AS (SELECT a.id AS source, b.id AS target FROM projects a JOIN projects b USING (workspace) WHERE a.id < b.id),
bnd AS (SELECT a.id AS source, b.id AS target FROM projects a JOIN projects b USING (workspace) WHERE a.supported AND NOT b.supported),
ws AS (SELECT source, target, 'depends_on' AS kind, confidence FROM trade UNION ALL SELECT source, target, 'adjacent_to', 0.35 FROM adj UNION ALL SELECT source, target, 'unsupported_boundary', 0.45 FROM bnd UNION ALL SELECT workspace, id, 'contains', 1.0 FROM projects)"""


def _projects(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return t.table(spark, d, "nation").select(key("project:", "n_nationkey").alias("id"), key("workspace:", "n_regionkey").alias("workspace"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 4 != 0).alias("supported"))


def _workspace(spark, d):
    p = _projects(spark, d)
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    li = t.table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
    trade = o.join(li, "l_orderkey").join(t.table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").join(t.table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").filter("c_nationkey <> s_nationkey")
    key = lambda c: F.concat(F.lit("project:"), F.col(c).cast("string"))
    dep = trade.select(key("c_nationkey").alias("source"), key("s_nationkey").alias("target")).distinct().select("source", "target", F.lit("depends_on").alias("kind"), F.lit(0.85).alias("confidence"))
    own = p.select(F.col("workspace").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    return dep.unionByName(workspace.adjacent_pairs(p)).unionByName(workspace.boundary_edges(p)).unionByName(own)


@query("adjacent_pairs", f"WITH {_WS} SELECT source, target, kind, confidence FROM ws WHERE kind = 'adjacent_to'")
def adjacent_pairs(spark, d):
    return workspace.adjacent_pairs(_projects(spark, d))


@query("workspace_graph", f"WITH {_WS} SELECT kind, source, target, confidence FROM ws")
def workspace_graph(spark, d):
    return _workspace(spark, d).select("kind", "source", "target", "confidence")


@query("ws_summary_top5", f"""WITH {_WS} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM ws WHERE kind = 'depends_on' UNION ALL SELECT target FROM ws WHERE kind = 'depends_on') GROUP BY id ORDER BY degree DESC, id LIMIT 5""")
def ws_summary(spark, d):
    return workspace.summary(_workspace(spark, d))


@query("cross_project_impact", f"""WITH {_WS}, e AS (SELECT source, target, kind, CASE WHEN kind IN ('adjacent_to', 'unsupported_boundary') THEN least(confidence, 0.4) ELSE confidence END AS c, kind IN ('adjacent_to', 'unsupported_boundary') AS weak FROM ws),
h1 AS (SELECT target AS id, 1 AS depth, c AS confidence, kind AS via, weak FROM e WHERE source = 'project:1' QUALIFY row_number() OVER (PARTITION BY target ORDER BY weak, c DESC, kind DESC) = 1),
h1x AS (SELECT * FROM h1 WHERE id <> 'project:1'),
h2 AS (SELECT e.target AS id, 2 AS depth, least(h.confidence, e.c) AS confidence, e.kind AS via, e.weak FROM h1x h JOIN e ON e.source = h.id WHERE NOT h.weak AND e.kind <> 'contains' AND e.target <> 'project:1' AND e.target NOT IN (SELECT id FROM h1x)
 QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY e.weak, least(h.confidence, e.c) DESC, e.kind DESC) = 1),
a AS (SELECT * FROM h1x UNION ALL SELECT * FROM h2), b AS (SELECT a.id, depth, a.confidence, via, coalesce(NOT supported, false) AS unsupported FROM a LEFT JOIN projects p ON p.id = a.id)
SELECT *, CASE WHEN (SELECT count(*) FROM b) >= 10 THEN 'critical' WHEN (SELECT count(*) FROM b) >= 4 OR (SELECT bool_or(unsupported) FROM b) THEN 'high' WHEN (SELECT count(*) FROM b) >= 2 THEN 'medium' ELSE 'low' END AS risk FROM b""")
def cross_project_impact(spark, d):
    return workspace.impact_report(_workspace(spark, d), spark.createDataFrame([("project:1",)], "id string"), _projects(spark, d), 2)


@query("module_rollup", f"WITH {P} SELECT module, count(*) AS symbol_count, count(*) FILTER (visibility = 'public') AS public_count FROM parts GROUP BY module ORDER BY symbol_count DESC, module LIMIT 20")
def module_rollup(spark, d):
    return core.module_rollup(t.parts(spark, d)).orderBy(F.desc("symbol_count"), "module").limit(20)


@query("symbols_page", f"""WITH {P} SELECT id, file, line_start, name, (SELECT count(*) FROM parts WHERE visibility = 'public') AS total, true AS has_more, true AS has_prev FROM parts WHERE visibility = 'public' ORDER BY file, line_start, name, id LIMIT 50 OFFSET 100""")
def symbols_page(spark, d):
    p = t.parts(spark, d).filter("visibility = 'public'").select("id", "file", "line_start", "name")
    return core.page_slice(p, ["file", "line_start", "name", "id"], 2, 50)


@query("symbol_search", f"WITH {P} SELECT id, name, kind, file FROM parts WHERE contains(lower(name), 'an') AND kind = 'function' ORDER BY name, id LIMIT 100")
def symbol_search(spark, d):
    return t.parts(spark, d).filter(F.lower("name").contains("an") & (F.col("kind") == "function")).select("id", "name", "kind", "file").orderBy("name", "id").limit(100)


@query("query_graph_filter", f"""WITH {t.NODES_SQL}, {t.EDGES_SQL}, n AS (SELECT id FROM nodes WHERE label = 'symbol' AND contains(lower(name), 'al') AND contains(lower(coalesce(file, '')), 'brand#1') ORDER BY id LIMIT 200)
SELECT edge_type, source, target, confidence FROM edges WHERE edge_type = 'CALLS' AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)""")
def query_graph(spark, d):
    n = t.nodes(spark, d).filter((F.col("label") == "symbol") & F.lower("name").contains("al") & F.lower("file").contains("brand#1")).select("id").orderBy("id").limit(200)
    return core.drop_dangling(n, t.edges(spark, d).filter("edge_type = 'CALLS'"))


@query("rename_preview", f"""WITH {P}, {t.CALLS_SQL} SELECT d.id, d.name, count(c.source) AS refs, count(DISTINCT u.file) AS files FROM parts d LEFT JOIN calls c ON c.target = d.id LEFT JOIN parts u ON u.id = c.source GROUP BY d.id, d.name""")
def rename_preview(spark, d):
    p = t.parts(spark, d)
    uses = t.calls(spark, d).join(p.select(F.col("id").alias("source"), "file"), "source").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("refs"), F.count_distinct("file").alias("files"))
    return p.select("id", "name").join(uses, "id", "left").select("id", "name", F.coalesce("refs", F.lit(0)).alias("refs"), F.coalesce("files", F.lit(0)).alias("files"))


@query("majority_lang", """SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def majority_lang(spark, d):
    return text.majority(t.table(spark, d, "documents").select("source", "lang"), ["source"], "lang")


@query("language_summary", f"""WITH {P} SELECT package, count(DISTINCT file) AS files, count(*) AS symbols, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (visibility = 'public') AS public_symbols FROM parts GROUP BY package""")
def language_summary(spark, d):
    return t.parts(spark, d).groupBy("package").agg(F.count_distinct("file").alias("files"), F.count("*").alias("symbols"), F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("visibility") == "public").alias("public_symbols"))


_LINES = f"{t.FILES_SQL}, lines AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM files)"


@query("line_snippets", """WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(l[greatest(doc_id % 5 - 1, 1):doc_id % 5 + 2], chr(10)) AS snippet FROM x""")
def line_snippets(spark, d):
    k = (F.col("doc_id") % 5).cast("int")
    return t.table(spark, d, "documents").select("doc_id", text.snippet(F.col("text"), k, k + 1, 1).alias("snippet"))


@query("doc_sections_carry", f"""WITH {_LINES} SELECT path, line_no, last_value(CASE WHEN regexp_matches(line, '^[A-Z][a-z]') THEN line END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM lines""")
def doc_sections(spark, d):
    return text.carry_heading(text.lines(t.files(spark, d)), F.col("line").rlike("^[A-Z][a-z]")).select("path", "line_no", "section")


@query("brace_depth", f"""WITH {_LINES}, c AS (SELECT path, line_no, length(line) - length(replace(line, 'e', '')) - (length(line) - length(replace(line, 'n', ''))) AS x FROM lines)
SELECT path, line_no, coalesce(sum(x) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS depth FROM c""")
def brace_depth(spark, d):
    rows = text.lines(t.files(spark, d)).withColumn("line", F.translate(F.regexp_replace("line", "[{}]", ""), "en", "{}"))
    return text.brace_depth(rows).select("path", "line_no", "depth")


@query("caption_list", """WITH x AS (SELECT p_brand, list_sort(list_distinct(list(split_part(p_name, ' ', 1)))) AS v FROM part GROUP BY 1) SELECT p_brand, array_to_string(v[1:3], ', ') || CASE WHEN len(v) > 3 THEN ' (+' || (len(v) - 3) || ' more)' ELSE '' END AS caption FROM x""")
def caption_list(spark, d):
    return t.table(spark, d, "part").groupBy("p_brand").agg(F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("v")).select("p_brand", text.caption(F.col("v"), 3).alias("caption"))


@query("redacted_paths", """SELECT user_id, count(*) AS n, '/~/' || event_type || '/f' AS path FROM events GROUP BY user_id, event_type""")
def redacted_paths(spark, d):
    e = t.table(spark, d, "events").withColumn("p", F.concat(F.lit("/home/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type", F.lit("/f")))
    return e.groupBy("user_id", paths.redact(F.col("p")).alias("path")).agg(F.count("*").alias("n"))


@query("duration_buckets", f"""WITH {P}, f AS (SELECT module, count(*) AS n FROM parts GROUP BY module) SELECT module, CASE WHEN n <= 10 THEN 'short' WHEN n <= 50 THEN 'medium' WHEN n <= 200 THEN 'long' ELSE 'very-long' END AS bucket FROM f""")
def duration_buckets(spark, d):
    by = t.parts(spark, d).groupBy("module").agg(F.count("*").alias("n"))
    return by.select("module", change.duration_bucket(F.col("n")).alias("bucket"))


@query("stable_renumber", f"WITH {P} SELECT id, 'n' || (row_number() OVER (ORDER BY module, name, id) - 1) AS stable_id FROM parts")
def stable_renumber(spark, d):
    return core.renumber(t.parts(spark, d).select("id", "module", "name"), ["module", "name", "id"]).select("id", "stable_id")


@query("artifact_merge", f"WITH {P} SELECT id, min(module) AS module, min(name) AS name FROM parts GROUP BY id")
def artifact_merge(spark, d):
    p = t.parts(spark, d).select("id", "module", "name")
    return core.merge_artifacts([p.filter("id % 3 <> 0"), p.filter("id % 2 = 0"), p.filter("id % 3 = 0")], ["module", "name"])


@query("change_wide_impact", f"""WITH {P}, {S}, {t.HUNKS_SQL}, o AS (SELECT DISTINCT p.id FROM hunks h JOIN parts p ON p.file = h.file AND new_start <= line_end AND new_end >= line_start),
d1 AS (SELECT DISTINCT source AS id FROM strong WHERE target IN (SELECT id FROM o) AND source NOT IN (SELECT id FROM o)),
d AS (SELECT id FROM d1 UNION SELECT source FROM strong WHERE target IN (SELECT id FROM d1) AND source NOT IN (SELECT id FROM o))
SELECT p.module, count(*) FILTER (p.id IN (SELECT id FROM o)) AS changed, count(*) FILTER (p.id IN (SELECT id FROM d)) AS callers FROM parts p WHERE p.id IN (SELECT id FROM o UNION SELECT id FROM d) GROUP BY p.module""")
def change_wide_impact(spark, d):
    from plexigraph.operators import resolve

    p = t.parts(spark, d)
    changed = resolve.overlapping(t.hunks(spark, d), p).select(F.col("symbol").alias("id")).distinct()
    hit = traverse.bfs(traverse.reverse(t.strong(spark, d)), changed, 2)
    return hit.join(p.select("id", "module"), "id").groupBy("module").agg(F.count_if(F.col("depth") == 0).alias("changed"), F.count_if(F.col("depth") > 0).alias("callers"))


@query("top_risk_symbols", f"WITH {t.CALLS_SQL} SELECT target AS id, count(*) AS callers FROM calls GROUP BY target ORDER BY callers DESC, id LIMIT 5")
def top_risk(spark, d):
    return t.calls(spark, d).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("callers")).orderBy(F.desc("callers"), "id").limit(5)


@query("preview_caps", f"WITH {t.NODES_SQL} SELECT label, id FROM nodes QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= CASE label WHEN 'package' THEN 10 WHEN 'source-file' THEN 50 ELSE 100 END")
def preview_caps(spark, d):
    n = t.nodes(spark, d)
    caps = {"package": 10, "source-file": 50}
    out = None
    for label in ("repository", "package", "target", "source-file", "symbol"):  # a top-k per label, not a window over all nodes
        part = n.filter(F.col("label") == label).orderBy("id").limit(caps.get(label, 100)).select("label", "id")
        out = part if out is None else out.unionByName(part)
    return out
