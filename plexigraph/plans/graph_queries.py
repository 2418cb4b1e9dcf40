"""Graph queries: structure, gates, tiers, traversals, cycles, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph.operators import core, scores, traverse
from plexigraph.plans.registry import query
from plexigraph.sources import tables as t

N, E, P, C, S = t.NODES_SQL, t.EDGES_SQL, t.PARTS_SQL, t.CALLS_SQL, t.STRONG_SQL


@query("graph_stats", f"""WITH {N}, {E}
SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM nodes WHERE label = 'symbol') AS symbol_count, 0::BIGINT AS diagnostic_count,
 (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM edges WHERE edge_type = 'CALLS') AS calls_count,
 0::BIGINT AS designation_count, (SELECT count(*) FROM edges WHERE edge_type = 'ACCESSES') AS accesses_count""")
def graph_stats(spark, d):
    return core.graph_stats(t.nodes(spark, d), t.edges(spark, d))


@query("graph_overview_kinds", f"""WITH {N}, {E}
SELECT 'label' AS section, label AS kind, count(*) AS n FROM nodes GROUP BY label
UNION ALL SELECT 'kind', kind, count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY edge_type""")
def graph_overview(spark, d):
    return core.overview(t.nodes(spark, d), t.edges(spark, d))


_SOME = "known AS (SELECT * FROM nodes WHERE NOT (label = 'symbol' AND name LIKE '%a%'))"


@query("quality_gates", f"""WITH {N}, {E}, {_SOME},
g AS (SELECT 'duplicate_nodes' AS gate, (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM known GROUP BY id))::BIGINT AS failures
UNION ALL SELECT 'duplicate_edges', (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM edges GROUP BY edge_type, source, target))::BIGINT
UNION ALL SELECT 'dangling_source', (SELECT count(*) FROM edges WHERE source NOT IN (SELECT id FROM known))
UNION ALL SELECT 'dangling_target', (SELECT count(*) FROM edges WHERE target NOT IN (SELECT id FROM known))
UNION ALL SELECT 'deterministic', 0 UNION ALL SELECT 'external_symbol_marking', 0
UNION ALL SELECT 'calls_endpoint_integrity', (SELECT count(*) FROM (SELECT source AS x FROM edges WHERE edge_type = 'CALLS' UNION ALL SELECT target FROM edges WHERE edge_type = 'CALLS') WHERE x NOT IN (SELECT id FROM known)))
SELECT gate, failures, failures = 0 AS passed FROM g""")
def quality_gates(spark, d):
    some = t.nodes(spark, d).filter(~((F.col("label") == "symbol") & F.col("name").contains("a")))
    return core.quality_gates(some, t.edges(spark, d))


_TIER = "CASE WHEN confidence IS NULL THEN 'unknown' WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END"


@query("confidence_tiers", f"""WITH {N}, {E}, b AS (SELECT edge_type, {_TIER} AS tier, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT edge_type, tier, n, round(n / sum(n) OVER (PARTITION BY edge_type), 4) AS rate FROM b""")
def confidence_tiers(spark, d):
    return core.confidence_tiers(t.edges(spark, d))


@query("confidence_summary", f"""WITH {N}, {E} SELECT edge_type, min(confidence) AS min_confidence, round(avg(confidence), 4) AS avg_confidence, max(confidence) AS max_confidence, count(*) AS n FROM edges GROUP BY edge_type""")
def confidence_summary(spark, d):
    return core.confidence_summary(t.edges(spark, d))


@query("quality_metrics", f"""WITH {N}, {E}, k AS (SELECT *, {_TIER} AS tier FROM edges)
SELECT count(*) AS edge_count, count(*) FILTER (source NOT IN (SELECT id FROM nodes WHERE label <> 'target')) AS dangling_edge_count,
 count(*) FILTER (edge_type = 'CALLS') AS call_count, count(*) FILTER (edge_type = 'CALLS' AND tier = 'high') AS call_high,
 count(*) FILTER (edge_type = 'CALLS' AND tier = 'medium') AS call_medium, count(*) FILTER (edge_type = 'CALLS' AND tier = 'low') AS call_low,
 count(*) FILTER (edge_type = 'CALLS' AND tier = 'unknown') AS call_unknown,
 round(count(*) FILTER (edge_type = 'CALLS' AND confidence >= 0.6) / count(*) FILTER (edge_type = 'CALLS'), 4) AS call_trusted_rate FROM k""")
def quality_metrics(spark, d):
    return core.quality_metrics(t.nodes(spark, d).filter("label <> 'target'"), t.edges(spark, d))


@query("external_nodes", f"""WITH {N}, {E} SELECT DISTINCT target AS id, 'symbol' AS label, split_part(target, '::', -1) AS name, true AS is_external FROM edges
WHERE edge_type = 'CALLS' AND target NOT IN (SELECT id FROM nodes WHERE kind <> 'method')""")
def external_nodes(spark, d):
    return core.external_nodes(t.nodes(spark, d).filter("kind <> 'method'"), t.edges(spark, d))


@query("dangling_edges_dropped", f"""WITH {N}, {E}, k AS (SELECT id FROM nodes WHERE kind <> 'method')
SELECT edge_type, count(*) AS n FROM edges WHERE source IN (SELECT id FROM k) AND target IN (SELECT id FROM k) GROUP BY edge_type""")
def dangling_dropped(spark, d):
    return core.drop_dangling(t.nodes(spark, d).filter("kind <> 'method'"), t.edges(spark, d)).groupBy("edge_type").agg(F.count("*").alias("n"))


@query("node_dedup_first", f"WITH {P} SELECT name, id, module, kind FROM parts QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) = 1")
def node_dedup_first(spark, d):
    return core.first_by(t.parts(spark, d).select("name", "id", "module", "kind"), ["name"], ["id"])


@query("dup_id_disambiguate", f"""WITH {P}, s AS (SELECT id, module || '::' || name AS symbol_id, line_start FROM parts)
SELECT id, symbol_id, CASE WHEN row_number() OVER (PARTITION BY symbol_id ORDER BY id) > 1 THEN symbol_id || '::_L' || line_start ELSE symbol_id END AS unique_id FROM s""")
def dup_id_disambiguate(spark, d):
    s = t.parts(spark, d).select("id", F.concat_ws("::", "module", "name").alias("symbol_id"), "line_start")
    return core.disambiguate_ids(s, "symbol_id", "line_start", ["id"]).drop("line_start")


@query("diag_ordinals", """SELECT event_id, 'diag:' || event_type || '::u' || user_id || '::' || (row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1) AS diag_id FROM events""")
def diag_ordinals(spark, d):
    e = core.ordinals(t.table(spark, d, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"], ["event_id"])
    return e.select("event_id", F.concat(F.lit("diag:"), "event_type", F.lit("::u"), F.col("user_id").cast("string"), F.lit("::"), F.col("ordinal").cast("string")).alias("diag_id"))


@query("edge_dedup_max", f"WITH {C} SELECT source, target, confidence FROM calls")
def edge_dedup_max(spark, d):
    return core.edge_dedup_max(t.raw_calls(spark, d))


_FAN = "fan AS (SELECT id, sum(i)::BIGINT AS fan_in, sum(o)::BIGINT AS fan_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM calls UNION ALL SELECT source, 0, 1 FROM calls) GROUP BY id)"


@query("fan_in_out", f"WITH {C}, {_FAN} SELECT * FROM fan")
def fan_in_out(spark, d):
    return core.fan_in_out(t.calls(spark, d))


@query("hotspots_top", f"WITH {C}, {_FAN} SELECT * FROM fan WHERE fan_out >= 3 ORDER BY fan_out DESC, fan_in DESC, id LIMIT 5")
def hotspots_top(spark, d):
    return core.fan_in_out(t.calls(spark, d)).filter("fan_out >= 3").orderBy(F.desc("fan_out"), F.desc("fan_in"), "id").limit(5)


_ENTRY_NAME = "lower(name) IN ('main', 'run', 'start', 'init')"
_HOT = f"""{_FAN}, top AS (SELECT max(fan_in) AS mi, max(fan_out) AS mo FROM fan),
crossing AS (SELECT DISTINCT unnest([c.source, c.target]) AS id FROM calls c JOIN parts a ON a.id = c.source JOIN parts b ON b.id = c.target WHERE a.module <> b.module),
hot AS (SELECT p.id, fan_in, fan_out, round(0.5 * fan_in / greatest(mi, 1) + 0.5 * fan_out / greatest(mo, 1)
  + CASE WHEN p.id IN (SELECT id FROM crossing) THEN 0.2 ELSE 0 END + CASE WHEN visibility = 'public' THEN 0.15 ELSE 0 END + CASE WHEN {_ENTRY_NAME} THEN 0.1 ELSE 0 END, 4) AS score
  FROM parts p JOIN fan USING (id), top)"""


@query("hotspot_scores", f"WITH {P}, {C}, {_HOT} SELECT * FROM hot")
def hotspot_scores(spark, d):
    return scores.hotspot_scores(t.parts(spark, d), t.calls(spark, d))


@query("hotspots_top20pct", f"""WITH {P}, {C}, {_HOT} SELECT id, fan_in, fan_out, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM hot
QUALIFY rank <= (SELECT ceil(count(*) / 5.0) FROM hot)""")
def hotspots_top20pct(spark, d):
    return scores.top_share(scores.hotspot_scores(t.parts(spark, d), t.calls(spark, d)))


@query("entry_points", f"""WITH {P}, {S}, e AS (SELECT id, name, 'name' AS why FROM parts WHERE {_ENTRY_NAME}
UNION ALL SELECT id, name, 'uncalled' FROM parts WHERE visibility = 'public' AND kind = 'function' AND id NOT IN (SELECT target FROM strong))
SELECT id, name, min(why) AS why FROM e GROUP BY id, name""")
def entry_points(spark, d):
    return scores.entry_points(t.parts(spark, d), t.strong(spark, d))


def _bfs_sql(depth: int, forward: bool = True, starts: str = "(SELECT range AS id FROM range(6))", name: str = "bfs") -> str:
    s, e = ("source", "target") if forward else ("target", "source")
    out = f"{name}0 AS (SELECT id, 0 AS depth, 1.0::DOUBLE AS confidence FROM {starts})"
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM {name}{j}" for j in range(k))
        out += f",\n{name}{k} AS (SELECT {e} AS id, {k} AS depth, max(least(b.confidence, s.confidence)) AS confidence FROM {name}{k - 1} b JOIN strong s ON s.{s} = b.id WHERE {e} NOT IN ({seen}) GROUP BY {e})"
    return out + f",\n{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}{j}" for j in range(depth + 1)) + ")"


def _calls_from(depth: int):
    return lambda spark, d: traverse.bfs(t.strong(spark, d), t.starts(spark), depth)


for _depth in (1, 2, 3):
    query(f"calls_from_d{_depth}", f"WITH {S}, {_bfs_sql(_depth)} SELECT * FROM bfs")(_calls_from(_depth))


@query("calls_to_d2", f"WITH {S}, {_bfs_sql(2, False)} SELECT * FROM bfs")
def calls_to(spark, d):
    return traverse.bfs(traverse.reverse(t.strong(spark, d)), t.starts(spark), 2)


_BOTH = f"""{_bfs_sql(2, True, name="down")}, {_bfs_sql(2, False, name="up")},
impact AS (SELECT * FROM (SELECT id, 'down' AS direction, depth, confidence FROM down UNION ALL SELECT id, 'up', depth, confidence FROM up) QUALIFY row_number() OVER (PARTITION BY id ORDER BY depth, direction) = 1)"""


@query("impact_both_d2", f"WITH {S}, {_BOTH} SELECT * FROM impact")
def impact_both(spark, d):
    return traverse.bfs_both(t.strong(spark, d), t.starts(spark), 2)


@query("impact_metrics", f"""WITH {S}, {_BOTH} SELECT direction, depth, count(*) AS n, round(min(confidence), 4) AS min_confidence,
CASE WHEN count(*) >= 10 THEN 'critical' WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS risk FROM impact WHERE depth > 0 GROUP BY direction, depth""")
def impact_metrics(spark, d):
    by = traverse.bfs_both(t.strong(spark, d), t.starts(spark), 2).filter("depth > 0").groupBy("direction", "depth").agg(F.count("*").alias("n"), F.round(F.min("confidence"), 4).alias("min_confidence"))
    return by.withColumn("risk", scores.impact_risk(F.col("n"), F.lit(False)))


@query("impact_paths_d2", f"""WITH {S} SELECT a.source AS start, b.target AS id, 2 AS depth, a.source || '>' || a.target || '>' || b.target AS path, least(1.0, a.confidence, b.confidence)::DOUBLE AS confidence
FROM strong a JOIN strong b ON b.source = a.target WHERE a.source < 6 AND a.target <> a.source AND b.target <> a.source AND b.target <> a.target""")
def impact_paths(spark, d):
    return traverse.paths(t.strong(spark, d), t.starts(spark), 2)


@query("reachable_d3", f"WITH {S}, {_bfs_sql(3)} SELECT id, depth FROM bfs")
def reachable(spark, d):
    return traverse.bfs(t.strong(spark, d), t.starts(spark), 3).select("id", "depth")


_ENTRY_WALK = _bfs_sql(8, starts=f"(SELECT id FROM parts WHERE {_ENTRY_NAME} OR visibility = 'public' AND kind = 'function' AND id NOT IN (SELECT target FROM strong))")


def _from_entries(spark, d, edges):
    """What the entry points reach within 8 hops; `edges`, which are held, are read once a hop."""
    return traverse.bfs(edges, scores.entry_points(t.parts(spark, d), edges).select("id"), 8, hold_after=0, held=True)


@query("unreachable", f"WITH {P}, {S}, {_ENTRY_WALK} SELECT id, name FROM parts WHERE id NOT IN (SELECT id FROM bfs)")
def unreachable(spark, d):
    return traverse.unreachable(t.parts(spark, d), _from_entries(spark, d, traverse.hold(t.strong(spark, d)))).select("id", "name")


_DEAD = f"""dead AS (SELECT id, file, round((CASE WHEN id NOT IN (SELECT target FROM strong) THEN 0.35 ELSE 0 END) + (CASE WHEN id NOT IN (SELECT id FROM bfs) THEN 0.25 ELSE 0 END)
 + (CASE WHEN visibility <> 'public' THEN 0.15 ELSE -0.35 END) - (CASE WHEN {_ENTRY_NAME} THEN 0.4 ELSE 0 END) - (CASE WHEN kind = 'trait' THEN 0.15 ELSE 0 END), 2)::DOUBLE AS score FROM parts)"""


@query("dead_code_scores", f"""WITH {P}, {S}, {_ENTRY_WALK}, {_DEAD} SELECT id, file, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS level FROM dead WHERE score >= 0.45""")
def dead_code(spark, d):
    e = traverse.hold(t.strong(spark, d))
    return scores.dead_code(t.parts(spark, d), e, _from_entries(spark, d, e))


@query("dead_file_scores", f"""WITH {P}, {S}, {_ENTRY_WALK},
o AS (SELECT DISTINCT b.file FROM strong s JOIN parts a ON a.id = s.source JOIN parts b ON b.id = s.target WHERE a.file <> b.file),
f AS (SELECT file, max(CASE WHEN visibility = 'public' THEN 1 ELSE 0 END) AS pub, max(CASE WHEN id IN (SELECT id FROM bfs) THEN 1 ELSE 0 END) AS r FROM parts GROUP BY file)
SELECT f.file, round(CASE WHEN o.file IS NULL THEN 0.35 ELSE -0.3 END + CASE WHEN r = 0 THEN 0.2 ELSE 0 END + CASE WHEN pub = 0 THEN 0.2 ELSE -0.4 END, 2)::DOUBLE AS score FROM f LEFT JOIN o ON o.file = f.file""")
def dead_files(spark, d):
    e = traverse.hold(t.strong(spark, d))
    return scores.dead_files(t.parts(spark, d), e, _from_entries(spark, d, e))


@query("two_cycles", f"WITH {C} SELECT a.source AS a, a.target AS b FROM calls a JOIN calls b ON b.source = a.target AND b.target = a.source WHERE a.source < a.target")
def two_cycles(spark, d):
    return traverse.two_cycles(t.calls(spark, d))


@query("three_cycles", f"""WITH {S} SELECT x.source AS a, y.source AS b, z.source AS c FROM strong x JOIN strong y ON y.source = x.target JOIN strong z ON z.source = y.target AND z.target = x.source
WHERE x.source < y.source AND x.source < z.source AND y.source <> z.source""")
def three_cycles(spark, d):
    return traverse.three_cycles(t.strong(spark, d))


@query("coupled_modules", f"""WITH {P}, {S}, m AS (SELECT a.module AS x, b.module AS y, count(*) AS n FROM strong s JOIN parts a ON a.id = s.source JOIN parts b ON b.id = s.target WHERE a.module <> b.module GROUP BY 1, 2)
SELECT f.x AS a, f.y AS b, f.n AS forward, g.n AS back FROM m f JOIN m g ON f.x = g.y AND f.y = g.x WHERE f.x < f.y""")
def coupled_modules(spark, d):
    return scores.coupled_modules(t.parts(spark, d), t.strong(spark, d))


_LAYERS = [("Brand#1", "ui"), ("Brand#2", "service"), ("Brand#3", "domain"), ("Brand#4", "storage"), ("Brand#5", "base")]
_ALLOWED = [("ui", "service"), ("service", "domain"), ("domain", "storage"), ("storage", "base"), ("ui", "base"), ("service", "base"), ("domain", "base")]


@query("layer_violations", f"""WITH {P}, {S}, l(prefix, layer) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _LAYERS)}), ok(a, b) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _ALLOWED)}),
s AS (SELECT id, layer FROM parts JOIN l ON left(module, 7) = prefix)
SELECT x.layer AS from_layer, y.layer AS to_layer, count(*) AS n FROM strong e JOIN s x ON x.id = e.source JOIN s y ON y.id = e.target
WHERE x.layer <> y.layer AND (x.layer, y.layer) NOT IN (SELECT (a, b) FROM ok) GROUP BY 1, 2""")
def layer_violations(spark, d):
    p = t.parts(spark, d)
    names = spark.createDataFrame(_LAYERS, "prefix string, layer string")
    layers = p.select("module").distinct().join(F.broadcast(names), F.substring("module", 1, 7) == F.col("prefix")).select("module", "layer")
    return scores.layer_violations(p, t.strong(spark, d), layers, spark.createDataFrame(_ALLOWED, "layer string, allowed_dep string"))


@query("boundary_leaks", f"""WITH {P}, {C} SELECT source AS id, count(DISTINCT b.module) AS target_modules FROM calls JOIN parts a ON a.id = source JOIN parts b ON b.id = target WHERE a.module <> b.module GROUP BY source HAVING count(DISTINCT b.module) > 15""")
def boundary_leaks(spark, d):
    return scores.boundary_leaks(t.parts(spark, d), t.calls(spark, d), 15)


@query("api_surface_scores", f"""WITH {P}, {S}, m AS (SELECT s.target AS id, max(CASE WHEN a.module <> b.module THEN 1 ELSE 0 END) AS o, max(CASE WHEN a.module = b.module THEN 1 ELSE 0 END) AS i FROM strong s JOIN parts a ON a.id = s.source JOIN parts b ON b.id = s.target GROUP BY 1),
x AS (SELECT p.id, round((CASE WHEN visibility = 'public' THEN 0.3 ELSE -0.25 END) + (CASE WHEN o = 1 THEN 0.25 ELSE 0 END) + (CASE WHEN coalesce(i, 0) = 0 THEN 0.2 ELSE 0 END) + (CASE WHEN p.id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') THEN 0.15 ELSE 0 END)
 + (CASE WHEN {_ENTRY_NAME} THEN 0.25 ELSE 0 END) + (CASE WHEN kind IN ('struct', 'enum', 'trait') THEN 0.1 ELSE 0 END), 2)::DOUBLE AS score FROM parts p LEFT JOIN m USING (id))
SELECT id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM x WHERE score >= 0.35""")
def api_surface(spark, d):
    docs = t.table(spark, d, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_partkey").alias("id"))
    return scores.api_surface(t.parts(spark, d), t.strong(spark, d), docs)


@query("review_gate", f"""WITH {P}, {C}, {_HOT}, tops AS (SELECT id FROM hot ORDER BY score DESC, id LIMIT 20),
ch AS (SELECT DISTINCT o_custkey % 50 AS change, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 1),
grp AS (SELECT change, count(*) AS touched, max(CASE WHEN id IN (SELECT id FROM tops) THEN 1 ELSE 0 END) AS h, max(CASE WHEN id IN (SELECT id FROM parts WHERE {_ENTRY_NAME}) THEN 1 ELSE 0 END) AS e FROM ch GROUP BY change)
SELECT change, touched, CASE WHEN e = 1 THEN 'critical' WHEN touched >= 10 THEN 'high' WHEN touched >= 4 OR h = 1 THEN 'medium' ELSE 'low' END AS level FROM grp""")
def review_gate(spark, d):
    p = t.parts(spark, d)
    hot = scores.hotspot_scores(p, t.calls(spark, d)).orderBy(F.desc("score"), "id").limit(20)
    o = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50).alias("change"))
    touched = o.join(t.table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("id")), "l_orderkey").select("change", "id").distinct()
    return scores.review_gate(touched, hot, p.filter(F.lower("name").isin("main", "run", "start", "init")))


@query("containment_tree", """SELECT c_custkey AS id, 'file:c' || c_custkey AS file, n_name AS target, r_name AS package FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def containment_tree(spark, d):
    parents = t.edges(spark, d).filter(F.col("edge_type").isin("HAS_TARGET", "OWNS_SOURCE")).select(F.col("target").alias("id"), F.col("source").alias("parent"))
    up = traverse.ancestors(parents, 2).filter(F.col("id").startswith("file:c")).groupBy("id").agg(F.max(F.when(F.col("distance") == 1, F.col("ancestor"))).alias("tn"), F.max(F.when(F.col("distance") == 2, F.col("ancestor"))).alias("pn"))
    names = t.nodes(spark, d).filter(F.col("label").isin("target", "package")).select("id", "name")
    up = up.join(names.toDF("tn", "target"), "tn").join(names.toDF("pn", "package"), "pn")
    return up.select(F.expr("cast(substring(id, 7) as bigint)").alias("id"), F.col("id").alias("file"), "target", "package")


@query("context_pack", f"""WITH {P}, {S}, seed AS (SELECT id FROM parts WHERE name LIKE '%a%'),
n AS (SELECT DISTINCT target AS id FROM strong WHERE source IN (SELECT id FROM seed))
SELECT p.id, p.file, CASE WHEN p.id IN (SELECT id FROM seed) THEN 2 ELSE 1 END AS weight FROM parts p WHERE p.id IN (SELECT id FROM seed UNION SELECT id FROM n)""")
def context_pack(spark, d):
    p = t.parts(spark, d)
    seed = p.filter(F.col("name").contains("a")).select("id")
    near = traverse.bfs(t.strong(spark, d), seed, 1)
    return near.join(p.select("id", "file"), "id").select("id", "file", (2 - F.col("depth")).alias("weight"))
