"""Workspace graph: projects, their dependencies, boundaries and cross-project impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexigraph.operators.change import impact_group, suppressed, surface
from plexigraph.operators.resolve import longest_prefix
from plexigraph.operators.scores import impact_risk
from plexigraph.operators.traverse import workspace_impact


def contains_edges(projects: DataFrame, root: str = "workspace:root") -> DataFrame:
    return projects.select(F.lit(root).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))


def adjacent_edges(projects: DataFrame, group: str = "folder") -> DataFrame:
    """adjacent_to (.35) between neighbours: projects of one folder, each with the next by id.

    The pairs of a folder are joined to their successors only. `adjacent_pairs` has all of them for
    workspaces small enough to want that.
    """
    from pyspark.sql import Window

    nxt = F.lead("id").over(Window.partitionBy(group).orderBy("id"))
    return projects.select(F.col("id").alias("source"), nxt.alias("target")).filter("target is not null").select("source", "target", F.lit("adjacent_to").alias("kind"), F.lit(0.35).alias("confidence"))


def adjacent_pairs(projects: DataFrame) -> DataFrame:
    """(source, target, kind, confidence) for each pair i < j of a workspace(id, workspace): the output itself is quadratic
    in a workspace's projects, so the join is an equi-join on the workspace."""
    a, b = projects.select("workspace", F.col("id").alias("source")), projects.select("workspace", F.col("id").alias("target"))
    return a.join(b, "workspace").filter("source < target").select("source", "target", F.lit("adjacent_to").alias("kind"), F.lit(0.35).alias("confidence"))


def boundary_edges(projects: DataFrame) -> DataFrame:
    """unsupported_boundary (.45) from each supported project of a workspace to each unsupported one."""
    yes = projects.filter("supported").select("workspace", F.col("id").alias("source"))
    no = projects.filter("not supported").select("workspace", F.col("id").alias("target"))
    return yes.join(no, "workspace").select("source", "target", F.lit("unsupported_boundary").alias("kind"), F.lit(0.45).alias("confidence"))


def dependency_edges(deps: DataFrame, projects: DataFrame) -> DataFrame:
    """depends_on from deps(source, path, confidence) to projects(id, path): the exact path, else the only project under it at .9 of the confidence."""
    exact = deps.join(projects.select(F.col("id").alias("target"), "path"), "path").select("source", "path", "target", "confidence")
    left = deps.join(projects.select("path"), "path", "left_anti")
    from plexigraph.operators.resolve import prefixes

    under = projects.select(F.col("id").alias("target"), F.explode(prefixes(F.col("path"))).alias("path"))
    by = left.join(under, "path").groupBy("source", "path", "confidence").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
    both = exact.unionByName(by.select("source", "path", "target", (F.col("confidence") * 0.9).alias("confidence")))
    return both.filter("source <> target").groupBy("source", "target").agg(F.max("confidence").alias("confidence")).select("source", "target", F.lit("depends_on").alias("kind"), "confidence")


def reference_edges(refs: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """config_refs or script_refs (.75) of refs(source, path) to nodes(id, path) by their normalised path."""
    from plexigraph.functions.paths import normalise

    r = refs.select("source", normalise(F.col("path")).alias("path")).distinct()
    return r.join(nodes.select(F.col("id").alias("target"), "path"), "path").select("source", "target", F.lit(kind).alias("kind"), F.lit(0.75).alias("confidence"))


#: Fixed values of the owner rules: what configuration and script files are called, and where CI files lie.
CONFIG_NAMES = ["Dockerfile", "Makefile", ".env", "docker-compose"]
CI_PATHS = [".github/workflows", ".gitlab-ci", "Jenkinsfile"]
SCRIPT_ENDINGS = [".sh", ".bash", ".zsh", ".ksh"]


def file_owners(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(path, project, owner, label, language, owner_kind, confidence) of changed files(path).

    Configuration and CI files, then scripts, own themselves (.9). Others belong to the longest project path above them
    (1.0; .5 for the root project `.`), unsupported where it is, or to nobody (0). projects(path, label, language, supported).
    """
    name = F.substring_index("path", "/", -1)
    any_ = lambda f, marks: F.exists(F.array(*[F.lit(m) for m in marks]), f)
    config = any_(lambda m: F.startswith(name, m), CONFIG_NAMES) | any_(lambda m: F.contains(F.col("path"), m), CI_PATHS) | (name.rlike(r"\.ya?ml$") & F.col("path").contains(".github"))
    script = any_(lambda m: F.endswith(name, m), SCRIPT_ENDINGS)
    f = files.filter("path <> ''").select("path").distinct().withColumn("own", F.when(config, "config").when(script, "script"))
    roots = projects.select(F.regexp_replace("path", "/+$", "").alias("root"), "label", "language", "supported")
    top = roots.filter("root = '.'").agg(F.min(F.struct("label", "language", "supported")).alias("top"))  # one row
    placed = longest_prefix(f.filter("own is null").select("path"), roots.filter("root <> '.'").select("root")).join(roots, "root", "left")
    found = placed.join(F.broadcast(top)).withColumn("p", F.when(F.col("supported").isNotNull(), F.struct(F.col("root"), "label", "language", "supported")).when(F.col("top").isNotNull(), F.struct(F.lit(".").alias("root"), "top.label", "top.language", "top.supported")))
    known, node = F.col("p").isNotNull(), F.concat(F.lit("project:"), F.replace("p.root", F.lit("/"), F.lit(":")))
    kind = F.when(~known, "unknown").when(F.col("p.supported"), "project").otherwise("unsupported")
    rest = found.select("path", F.when(known, node).otherwise("unknown").alias("project"), F.when(known, node).alias("owner"), F.when(known, F.col("p.label")).otherwise("unknown").alias("label"), F.when(known, F.col("p.language")).otherwise("").alias("language"), kind.alias("owner_kind"), F.when(~known, 0.0).when(F.col("p.root") == ".", 0.5).otherwise(1.0).alias("confidence"))
    safe = F.replace("path", F.lit("/"), F.lit(":"))
    node = F.when(F.col("own") == "script", F.concat(F.lit("script:"), safe)).when(F.col("path").contains(".github/workflows"), F.concat(F.lit("workflow:"), safe)).otherwise(F.concat(F.lit("config:"), safe))
    plain = f.filter("own is not null").select("path", F.concat(F.lit("workspace:"), "own").alias("project"), node.alias("owner"), name.alias("label"), F.when(F.col("own") == "script", "shell").otherwise("").alias("language"), F.col("own").alias("owner_kind"), F.lit(0.9).alias("confidence"))
    return rest.unionByName(plain)


def impact_targets(targets: list[dict], nodes: DataFrame) -> DataFrame:
    """(target, id, confidence, reason) for each stated target, by the first node, in node order, that its best rule finds.

    A target may say node, project, path and query; nodes(ord, id, project, path, label). Rules: node id and project id
    1.0, path .90, end of a path .75, label .65 and part of a label .45, both in any case; for the last two the query
    stands in for what isn't said. The targets are an argument, so every node meets them as literals, without a join.
    """
    said = [(k, t.get("node"), t.get("project"), t.get("path"), t.get("query") or t.get("path") or t.get("project") or t.get("node") or "") for k, t in enumerate(targets)]
    rows = F.array(*[F.struct(F.lit(k).alias("target"), *[F.lit(v).cast("string").alias(n) for n, v in zip(("node", "project_", "path_", "query"), rest, strict=True)]) for k, *rest in said])
    each = nodes.select("ord", "id", "project", "path", "label", F.explode(rows).alias("t"))
    low, query = F.lower("label"), F.lower("t.query")
    asked = F.col("t.query") != ""
    rules = [
        (F.col("id") == F.col("t.node"), 1.0, "node"),
        (F.col("project") == F.col("t.project_"), 1.0, "project"),
        (F.col("path") == F.col("t.path_"), 0.90, "path"),
        (F.endswith(F.col("path"), F.col("t.path_")), 0.75, "path-suffix"),
        (asked & (low == query), 0.65, "label"),
        (asked & F.contains(low, query), 0.45, "label-part"),
    ]
    best = F.coalesce(*[F.when(cond, F.struct(F.lit(k).alias("rank"), "ord", "id", F.lit(c).alias("confidence"), F.lit(r).alias("reason"))) for k, (cond, c, r) in enumerate(rules)])
    won = each.select("t.target", best.alias("b")).filter("b is not null").groupBy("target").agg(F.min("b").alias("b"))
    every = nodes.sparkSession.range(len(targets)).select(F.col("id").cast("int").alias("target"))
    return every.join(won, "target", "left").select("target", "b.id", F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("b.reason", F.lit("no-match")).alias("reason"))


def affected_projects(owners: DataFrame, nodes: DataFrame, edges: DataFrame, include_fixtures: bool = False, strict: bool = False) -> DataFrame:
    """(id, label, language, supported, surface, grp, distance, confidence, change_type, suppressed): projects that a change
    touches (`file_owners`) or that lie within two steps downstream of it.

    nodes(id, kind, label, path, language, supported), edges(source, target, kind, confidence). Files without an owner
    start nothing; configuration and script files start from their own nodes.
    """
    known = owners.filter("owner is not null").select(F.col("owner").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    hit = workspace_impact(edges, known, 2).select("id", F.col("depth").alias("distance"), "confidence")
    j = hit.join(nodes.filter("kind = 'project'"), "id")
    direct = F.when(F.col("distance") == 0, "direct").otherwise("indirect")
    j = j.withColumn("change_type", direct).withColumn("surface", surface(F.col("path"), F.col("label"), F.col("language"), F.when(F.col("supported"), "project").otherwise("unsupported")))
    j = j.withColumn("grp", impact_group(F.col("change_type"), F.col("surface"), F.col("confidence"), F.col("supported")))
    return j.select("id", "label", "language", "supported", "surface", "grp", "distance", "confidence", "change_type", suppressed(F.col("change_type"), F.col("surface"), F.col("grp"), include_fixtures, strict).alias("suppressed"))


def change_report(owners: DataFrame, affected: DataFrame, project_count: int | Column) -> DataFrame:
    """One row: how many projects are affected, reported, left out and in each group, and the risk of the change.

    High-signal downstream projects are reported, indirect and of high confidence; a high-signal boundary is an
    unsupported project that changed itself or is reached at .65 or more.
    """
    has = lambda kind: F.count_if(F.col("owner_kind") == kind) > 0
    o = owners.agg(has("config").alias("config"), has("script").alias("script"), has("unknown").alias("unknown"))
    shown, count = ~F.col("suppressed"), lambda cond: F.count_if(cond)
    a = affected.agg(
        F.count("*").alias("raw"),
        count(shown).alias("reported"),
        *[count(F.col("grp") == g).alias(n) for g, n in (("direct", "direct"), ("highConfidence", "high_confidence"), ("lowConfidence", "low_confidence"), ("fixtureOnly", "fixture_only"), ("unsupportedBoundary", "unsupported_boundary"))],
        count(shown & (F.col("change_type") == "indirect") & (F.col("grp") == "highConfidence")).alias("downstream"),
        count(shown & (F.col("change_type") == "indirect")).alias("any_downstream"),
        (count(~F.col("supported") & ((F.col("distance") == 0) | (F.col("confidence") >= 0.65))) > 0).alias("boundary"),
    )
    n, high, b = F.col("downstream"), F.col("any_downstream"), F.col("boundary")
    risk = F.when((n >= 10) | (b & (n >= 4)), "critical").when((F.col("config") & (n > 0)) | (n >= 4) | b, "high").when((n > 0) | (high > 0) | (F.col("config") & (F.lit(project_count) > 1)) | F.col("script") | F.col("unknown"), "medium").otherwise("low")
    return a.join(o).select("raw", "reported", (F.col("raw") - F.col("reported")).alias("suppressed"), "direct", "high_confidence", "low_confidence", "fixture_only", "unsupported_boundary", risk.alias("risk"))


def checklist(rows: DataFrame) -> DataFrame:
    """The distinct texts of rows(item), sorted."""
    return rows.select("item").distinct().orderBy("item")


def summary(edges: DataFrame, top: int = 5) -> DataFrame:
    """The `top` most connected projects over depends_on and imports: (id, degree), ties by id."""
    e = edges.filter(F.col("kind").isin("depends_on", "imports"))
    return e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)


def impact_report(edges: DataFrame, starts: DataFrame, projects: DataFrame, depth: int) -> DataFrame:
    """(id, depth, confidence, via, unsupported, risk): downstream impact and the risk of the whole."""
    hit = workspace_impact(edges, starts, depth).filter("depth > 0")
    j = hit.join(projects.select("id", (~F.col("supported")).alias("unsupported")), "id", "left").withColumn("unsupported", F.coalesce("unsupported", F.lit(False)))
    total = j.agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("unsupported")), F.lit(False)).alias("u"))
    return j.join(F.broadcast(total)).withColumn("risk", impact_risk(F.col("n"), F.col("u"))).drop("n", "u")
