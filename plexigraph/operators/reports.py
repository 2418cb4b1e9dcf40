"""Composite reports over nodes, edges and facts, and the sinks that export them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plexigraph.operators import core, scores, text, traverse
from plexigraph.operators.resolve import ends

#: Tools by question: (tool, operators it is made of). A lookup, nothing is computed from it.
TOOLS = [
    ("analyze", "graph analyze_compact"),
    ("quality", "quality_gates"),
    ("summary", "language_summary"),
    ("graph_overview", "graph_overview_kinds"),
    ("unresolved_report", "unresolved_breakdown"),
    ("symbol_search", "symbol_search"),
    ("symbol_context", "symbol_context_edges line_snippets"),
    ("calls_from", "calls_from_d2"),
    ("calls_to", "calls_to_d2"),
    ("impact_preview", "impact_both_d2 impact_metrics"),
    ("query_graph", "query_graph_filter"),
    ("project_overview", "graph_overview_kinds quality_metrics hotspots_top"),
    ("rename_preview", "rename_preview"),
    ("compare_runs", "compare_runs run_deltas"),
    ("detect_changes", "file_owners affected_projects change_report"),
    ("breaking_change_review", "breaking_changes"),
    ("automation_graph", "automation_graph risk_flags local_refs"),
    ("workspace_health", "health_scores health_overall recommendations"),
    ("impact_target", "impact_target_ladder"),
    ("changed_symbols", "hunk_overlap unknown_hunks"),
    ("production_assist", "hunk_overlap top_risk_symbols"),
    ("dead_code_candidates", "dead_code_scores dead_file_scores"),
    ("impact_analysis", "calls_to_d2 impact_metrics"),
    ("risk_hotspots", "hotspots_top20pct"),
    ("architecture_drift", "two_cycles three_cycles coupled_modules layer_violations boundary_leaks"),
    ("context_pack", "context_pack"),
    ("review_gate", "review_gate"),
    ("reachability_map", "reachable_d3 unreachable"),
    ("external_api_surface", "api_surface_scores"),
    ("framework_entry_hints", "framework_hints entry_points"),
    ("workspace_graph", "workspace_graph ws_summary_top5"),
    ("cross_project_impact", "cross_project_impact"),
]


def symbol_context(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, dir, edge_type, n, best) of the symbols in ids(id): in and out edges by type with the best confidence."""
    both = edges.select(F.inline(F.array(F.struct(F.col("target").alias("id"), F.lit("in").alias("dir")), F.struct(F.col("source").alias("id"), F.lit("out").alias("dir")))), "edge_type", "confidence")
    return both.join(ids.select("id"), "id", "left_semi").groupBy("id", "dir", "edge_type").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


def impact_analysis(edges: DataFrame, start: DataFrame, entries: DataFrame, depth: int = 3) -> DataFrame:
    """One row: direct and indirect callers, entry points among them, a score of 0 to 1 and a level.

    The score is a tenth of the direct callers up to .5, a fortieth of the indirect ones up to .3,
    and .2 if an entry point is reached.
    """
    up = traverse.bfs(traverse.reverse(edges), start, depth).filter("depth > 0").join(entries.select("id", F.lit(1).alias("e")).distinct(), "id", "left")
    t = up.agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("indirect"), F.count_if(F.col("e") == 1).alias("entries"))
    score = F.least(F.col("direct") / 10, F.lit(0.5)) + F.least(F.col("indirect") / 40, F.lit(0.3)) + F.when(F.col("entries") > 0, 0.2).otherwise(0.0)
    return t.withColumn("score", F.round(score, 4)).withColumn("level", scores.impact_risk(F.col("direct") + F.col("indirect"), F.lit(False)))


def doc_links(mentions: DataFrame, symbols: DataFrame, most: int = 5) -> DataFrame:
    """(id, path, line_no): the first `most` places in documents that name a symbol in inline code.

    mentions(path, line_no, name) with names plain or qualified; they meet symbols by their last segment.
    """
    last = F.substring_index(F.substring_index("name", "::", -1), ".", -1)
    hits = mentions.select("path", "line_no", last.alias("name")).distinct().join(symbols.select("id", "name"), "name")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("path", "line_no"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most).select("id", "path", "line_no")


def receiver_types(lines: DataFrame, constructors: list[str]) -> DataFrame:
    """(path, line_no, variable, type): what a `let` or a parameter says of a variable, per line and function.

    lines(path, line_no, line). Look-back joins on it take the last line at or before a call inside
    the same function: a typed let first, then a parameter, then a let with a known constructor.
    """
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("scope", F.sum(F.col("line").rlike(r"\bfn\s+\w").cast("int")).over(w))
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"^&\s*(mut\s+)?('\w+\s+)?", ""), r"<.*$", "")
    pair = lambda p: F.arrays_zip(F.regexp_extract_all("line", F.lit(p), F.lit(1)).alias("variable"), F.regexp_extract_all("line", F.lit(p), F.lit(2)).alias("type"))
    typed = pair(r"\blet\s+(?:mut\s+)?(\w+)\s*:\s*([^=;]+)")
    params = F.when(F.col("line").rlike(r"\bfn\s+\w"), pair(r"[(,]\s*(?:mut\s+)?(\w+)\s*:\s*(&?[^,)]+)")).otherwise(F.expr("cast(array() as array<struct<variable string, type string>>)"))
    known = "|".join(constructors)
    built = pair(rf"\blet\s+(?:mut\s+)?(\w+)\s*=\s*({known})(?:::<[^>]*>)?::\w+\(")
    tag = lambda a, rank: F.transform(a, lambda x: F.struct(F.lit(rank).alias("rank"), x["variable"].alias("variable"), F.trim(clean(x["type"])).alias("type")))
    return rows.select("path", "scope", "line_no", F.inline(F.concat(tag(typed, 0), tag(params, 1), tag(built, 2))))


def receiver_of(calls: DataFrame, types: DataFrame) -> DataFrame:
    """calls(path, scope, line_no, variable) with the type from `receiver_types`: the best rank, then the last line."""
    t = types.select("path", "scope", "variable", F.col("line_no").alias("at"), "rank", "type")
    hit = calls.join(t, ["path", "scope", "variable"], "left").filter("at is null or at <= line_no")
    best = hit.groupBy(*calls.columns).agg(F.min(F.when(F.col("at").isNotNull(), F.struct("rank", (-F.col("at")).alias("a"), "type"))).alias("m"))
    return calls.join(best.select(*calls.columns, F.col("m.type").alias("type")), calls.columns, "left")


def cangjie_references(refs: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """(ref, target, confidence, reason) of refs(ref, file, name, confidence): the file's only symbol of the name keeps the
    reference's own confidence; else its imports: the single one, else the only explicit one, else the only alias."""
    own = refs.join(ends(symbols.select("file", "name", F.col("id").alias("t")), ["file", "name"], "t"), ["file", "name"]).groupBy("ref").agg(F.count_distinct("t").alias("n"), F.min("t").alias("own")).filter("n = 1").select("ref", "own")
    i = refs.join(imports.select("file", "name", "kind", F.col("target").alias("t")).distinct(), ["file", "name"])
    one = lambda cond: F.when(F.count_distinct(F.when(cond, F.col("t"))) == 1, F.min(F.when(cond, F.col("t"))))
    by = i.groupBy("ref").agg(one(F.lit(True)).alias("single"), F.min("kind").alias("k"), F.count_distinct("kind").alias("nk"), one(F.col("kind") == "explicit").alias("explicit"), one(F.col("kind") == "alias").alias("alias"))
    j = refs.join(own, "ref", "left").join(by, "ref", "left")
    kind = F.when(F.col("explicit").isNotNull() & (F.coalesce("single", "explicit") == F.col("explicit")), "explicit").when(F.col("alias").isNotNull() & (F.coalesce("single", "alias") == F.col("alias")), "alias").when(F.col("single").isNotNull(), "wildcard")
    target = F.coalesce("own", "single", "explicit", "alias")
    conf = F.when(F.col("own").isNotNull(), F.col("confidence")).when(kind == "explicit", 0.85).when(kind == "alias", 0.80).when(kind == "wildcard", 0.70).otherwise(0.0)
    return j.select("ref", target.alias("target"), conf.alias("confidence"), F.when(F.col("own").isNotNull(), "same-file").otherwise(F.coalesce(kind, F.lit("unresolved"))).alias("reason"))


def marker_language(files: DataFrame, root: str = "root") -> DataFrame:
    """(root, language) by marker files first, in the order of the rules, then by the most common source suffix."""
    from plexigraph.sources.extract import LANGUAGES

    name = F.substring_index("path", "/", -1)
    has = lambda *n: F.bool_or(name.isin(*n))
    by = files.groupBy(root).agg(F.when(has("Cargo.toml"), "rust").when(has("cjpm.toml"), "cangjie").when(has("oh-package.json5"), "arkts").when(has("tsconfig.json"), "typescript").when(has("package.json"), "javascript").when(has("pyproject.toml", "setup.py", "requirements.txt"), "python").when(has("CMakeLists.txt"), "cpp").when(has("compile_commands.json", "Makefile"), "c").alias("marked"))
    names = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    most = text.majority(files.withColumn("language", F.try_element_at(names, F.regexp_extract("path", r"\.([^./]+)$", 1))).filter("language is not null"), [root], "language").select(root, "language")
    return by.join(most, root, "left").select(root, F.coalesce("marked", "language", F.lit("unknown")).alias("language"))


def dependency_digest(facts: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(path, name, kind, framework, role, confidence) of a fact table's dependencies; a framework where a needle of
    frameworks(needle, framework, role) is part of the lower-cased name."""
    deps = facts.filter("fact = 'dependency'").select("path", "name", "kind").distinct()
    hit = deps.join(F.broadcast(frameworks), F.lower("name").contains(F.col("needle")), "left")
    first = hit.groupBy("path", "name", "kind").agg(F.min(F.struct("framework", "role")).alias("m"))
    return first.select("path", "name", "kind", "m.framework", "m.role", F.when(F.col("m.framework").isNotNull(), 0.88).alias("confidence"))


def reexports(facts: DataFrame) -> DataFrame:
    """(init, name, path): names that Python packages re-export from their own modules."""
    i = facts.filter("fact = 'import' and language = 'python' and path like '%__init__.py'")
    folder = F.regexp_replace("path", "/?__init__.py$", "")
    module = F.regexp_replace("target", r"^\.", "")
    return i.filter(F.col("target").startswith(".") & ~F.col("target").startswith("..")).select(F.col("path").alias("init"), "name", F.concat(F.when(folder != "", F.concat(folder, F.lit("/"))).otherwise(""), F.replace(module, F.lit("."), F.lit("/")), F.lit(".py")).alias("path"))


def automation_graph(files: DataFrame, fact: DataFrame) -> DataFrame:
    """(path, kind, target) of scripts: commands they call, scripts they source, local paths they name, and risks of their lines."""
    f = fact.filter("language = 'shell'")
    rows = text.lines(files.join(f.select("path").distinct(), "path", "left_semi"))
    row = lambda df, kind, target: df.select("path", F.lit(kind).alias("kind"), target.alias("target"))
    calls = row(f.filter("fact = 'call'"), "calls", F.col("name"))
    sources = row(f.filter("fact = 'import'"), "sources", F.col("target"))
    return calls.unionByName(sources).unionByName(row(text.local_refs(rows), "refers", F.col("ref"))).unionByName(row(text.risk_flags(rows), "risk", F.col("flag"))).distinct()


def runner_ladder(workflows: Column, affected: Column) -> Column:
    """critical from 8 affected, high from 4 or 3 workflows, medium from 2, low from 1."""
    return F.when(affected >= 8, "critical").when((affected >= 4) | (workflows >= 3), "high").when(affected >= 2, "medium").when(affected >= 1, "low").otherwise("none")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, tiers and integrity at a glance."""
    return core.graph_stats(nodes, edges).join(core.quality_metrics(nodes, edges).drop("edge_count"))


def export_bridge(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write nodes and edges as JSON, edges in a folder per edge type."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("edge_type").json(f"{path}/edges")


def read_bridge(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")
