"""Scores and rankings over nodes and edges. Formulas stand in the docstrings; weights are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexigraph.operators.core import fan_in_out

PUBLIC = ["pub", "public"]


def severity_rank(level: Column) -> Column:
    low = F.lower(level)
    return F.when(low == "critical", 4).when(low == "high", 3).when(low == "medium", 2).when(low == "low", 1).otherwise(0)


def severity_name(rank: Column) -> Column:
    return F.when(rank == 4, "critical").when(rank == 3, "high").when(rank == 2, "medium").when(rank == 1, "low").otherwise("none")


def dead_code(symbols: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(id, score, level): .35 no incoming call, .25 not reached, .15 private, -.35 public, -.40 entry-like, -.15 dynamic.

    Entry-like: the lower-cased name is main, run, start or init. Dynamic: kind is `trait`. Scores of
    .80 and .55 bound the tiers; under .45 isn't reported.
    """
    called = edges.select(F.col("target").alias("id")).distinct().withColumn("__in", F.lit(True))
    seen = reached.select("id").distinct().withColumn("__r", F.lit(True))
    j = symbols.join(called, "id", "left").join(seen, "id", "left")
    w = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    public = F.col("visibility").isin(PUBLIC)
    score = w(F.col("__in").isNull(), 0.35) + w(F.col("__r").isNull(), 0.25) + w(~public, 0.15) - w(public, 0.35) - w(F.lower("name").isin("main", "run", "start", "init"), 0.40) - w(F.col("kind") == "trait", 0.15)
    out = j.select("id", "file", F.round(score, 2).alias("score"))
    return out.filter("score >= 0.45").withColumn("level", F.when(F.col("score") >= 0.8, "high").when(F.col("score") >= 0.55, "medium").otherwise("low"))


def dead_files(symbols: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(file, score): .35 no symbol is called from another file, .20 none is reached, .20 none is public, -.30 any is called from outside, -.40 any is public."""
    s = symbols.select("id", "file", "visibility")
    ends = edges.join(s.select(F.col("id").alias("source"), F.col("file").alias("sf")), "source").join(s.select(F.col("id").alias("target"), F.col("file").alias("tf")), "target")
    outside = ends.filter("sf <> tf").select(F.col("tf").alias("file")).distinct().withColumn("__o", F.lit(1))
    by = s.join(reached.select("id").distinct().withColumn("__r", F.lit(1)), "id", "left").groupBy("file").agg(F.max(F.col("visibility").isin(PUBLIC).cast("int")).alias("public"), F.max("__r").alias("reached"))
    j = by.join(outside, "file", "left")
    n = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    o = F.col("__o").isNotNull()
    return j.select("file", F.round(n(~o, 0.35) + n(F.col("reached").isNull(), 0.20) + n(F.col("public") == 0, 0.20) - n(o, 0.30) - n(F.col("public") == 1, 0.40), 2).alias("score"))


def hotspot_scores(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, score): fan-in and fan-out over their maxima, halved and summed, +.2 any edge crosses modules, +.15 public, +.1 entry-like."""
    fan = fan_in_out(edges)
    top = fan.agg(F.max("fan_in").alias("mi"), F.max("fan_out").alias("mo"))  # one row
    m = symbols.select("id", "module")
    cross = edges.join(m.select(F.col("id").alias("source"), F.col("module").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("b")), "target").filter("a <> b")
    crossing = cross.select(F.explode(F.array("source", "target")).alias("id")).distinct().withColumn("__x", F.lit(1))
    j = symbols.join(fan, "id").join(crossing, "id", "left").join(F.broadcast(top))
    n = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    score = 0.5 * F.col("fan_in") / F.greatest("mi", F.lit(1)) + 0.5 * F.col("fan_out") / F.greatest("mo", F.lit(1)) + n(F.col("__x").isNotNull(), 0.2) + n(F.col("visibility").isin(PUBLIC), 0.15) + n(F.lower("name").isin("main", "run", "start", "init"), 0.1)
    return j.select("id", "fan_in", "fan_out", F.round(score, 4).alias("score"))


def top_share(scores: DataFrame, share_of: int = 5) -> DataFrame:
    """Rows whose rank by score (then id) lies in the first n/share_of, rounded up.

    Ranks come from a range-partitioned order: a task numbers its own part of it, and counts of the
    parts place it, so neither a global window nor a mass of equal scores is one task's.
    """
    from plexigraph.operators.core import numbered

    total = scores.agg(F.ceil(F.count("*") / share_of).alias("want"))  # one row
    ranked = numbered(scores, [F.desc("score"), F.asc("id")], "rank")
    return ranked.join(F.broadcast(total)).filter("rank <= want").drop("want")


def entry_points(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, name, why): a well-known name, or a public function that nothing calls."""
    called = edges.select(F.col("target").alias("id")).distinct()
    idle = symbols.join(called, "id", "left_anti").filter(F.col("visibility").isin(PUBLIC) & (F.col("kind") == "function"))
    named = symbols.filter(F.lower("name").isin("main", "run", "start", "init"))
    both = named.select("id", "name", F.lit("name").alias("why")).unionByName(idle.select("id", "name", F.lit("uncalled").alias("why")))
    return both.groupBy("id", "name").agg(F.min("why").alias("why"))


def coupled_modules(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, forward, back): pairs of modules with edges both ways, a < b."""
    m = symbols.select("id", "module")
    by = edges.join(m.select(F.col("id").alias("source"), F.col("module").alias("x")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("y")), "target").filter("x <> y").groupBy("x", "y").agg(F.count("*").alias("n"))
    one, two = by.filter("x < y").toDF("a", "b", "forward"), by.filter("x > y").toDF("b", "a", "back")
    return one.join(two, ["a", "b"])


def layer_violations(symbols: DataFrame, edges: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """(from_layer, to_layer, n): edges between layers(module, layer) that rules(layer, allowed_dep) don't allow."""
    s = symbols.join(layers, "module").select("id", "layer")
    by = edges.join(s.select(F.col("id").alias("source"), F.col("layer").alias("from_layer")), "source").join(s.select(F.col("id").alias("target"), F.col("layer").alias("to_layer")), "target")
    counts = by.filter("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(rules.select(F.col("layer").alias("from_layer"), F.col("allowed_dep").alias("to_layer"))), ["from_layer", "to_layer"], "left_anti")


def boundary_leaks(symbols: DataFrame, edges: DataFrame, span: int) -> DataFrame:
    """(id, target_modules): symbols that depend on more than `span` modules other than their own."""
    m = symbols.select("id", "module")
    by = edges.join(m.select(F.col("id").alias("source"), F.col("module").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("b")), "target").filter("a <> b")
    return by.groupBy(F.col("source").alias("id")).agg(F.count_distinct("b").alias("target_modules")).filter(F.col("target_modules") > span)


def api_surface(symbols: DataFrame, edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, score, level): .30 public, .25 called from another module, .20 no caller in its own, .15 documented (docs(id)), .25 entry-like, .10 a type, -.25 private.

    Tiers .75 and .45; under .35 isn't reported.
    """
    m = symbols.select("id", "module")
    ends = edges.join(m.select(F.col("id").alias("source"), F.col("module").alias("a")), "source").join(m.select(F.col("id").alias("target"), F.col("module").alias("b")), "target")
    by = ends.groupBy(F.col("target").alias("id")).agg(F.max((F.col("a") != F.col("b")).cast("int")).alias("outside"), F.max((F.col("a") == F.col("b")).cast("int")).alias("inside"))
    j = symbols.join(by, "id", "left").join(docs.select("id", F.lit(1).alias("__d")).distinct(), "id", "left")
    n = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    public = F.col("visibility").isin(PUBLIC)
    score = n(public, 0.30) + n(F.col("outside") == 1, 0.25) + n(F.coalesce("inside", F.lit(0)) == 0, 0.20) + n(F.col("__d").isNotNull(), 0.15) + n(F.lower("name").isin("main", "run", "start", "init"), 0.25) + n(F.col("kind").isin("struct", "enum", "trait"), 0.10) - n(~public, 0.25)
    out = j.select("id", F.round(score, 2).alias("score")).filter("score >= 0.35")
    return out.withColumn("level", F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))


def health(projects: DataFrame) -> DataFrame:
    """(…, score, risk) of projects(status, gate_failures, automation_risks, source_files, edges, unsupported, symbols).

    100 less: 35 for status failed, 20 for any other than succeeded; 8 a failed gate, up to 50; 8 an
    automation risk, up to 40; 15 for over 20 source files without an edge, or 10 for under one edge a
    file; 10 for files without any edge; 5 an unsupported module nearby, up to 15. At least 0. From
    85 the risk is low, from 65 medium.
    """
    files, edges = F.col("source_files"), F.coalesce("edges", F.lit(0))
    off = F.when(F.col("status") == "failed", 35).when(F.col("status") != "succeeded", 20).otherwise(0)
    off = off + F.least(8 * F.col("gate_failures"), F.lit(50)) + F.least(8 * F.col("automation_risks"), F.lit(40))
    off = off + F.when((files > 20) & (edges == 0), 15).when((files > 0) & (edges > 0) & (edges < files), 10).otherwise(0)
    off = off + F.when((files > 0) & (edges == 0), 10).otherwise(0) + F.least(5 * F.col("unsupported"), F.lit(15))
    return projects.withColumn("score", F.greatest(F.lit(0), 100 - off).cast("long")).withColumn("risk", risk_level(F.col("score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 85, "low").when(score >= 65, "medium").otherwise("high")


def recommendations(scored: DataFrame) -> DataFrame:
    """(list, project, priority, rank): what to read, review and clean up first, of `health` rows with `project`.

    Read: the five succeeded projects with the most symbols, P0 over 50. Review: scores under 65 (P0 under 50) and failed
    projects (P0), worst first. Clean up: over 20 source files without an edge (P1), else unsupported modules nearby (P2).
    """
    edges = F.coalesce("edges", F.lit(0))
    read = scored.filter("status = 'succeeded'").orderBy(F.desc("symbols"), "project").limit(5)
    read = read.select(F.lit("read").alias("list"), "project", F.when(F.col("symbols") > 50, "P0").otherwise("P1").alias("priority"), (-F.col("symbols")).cast("long").alias("rank"))
    low = F.col("score") < 65
    review = scored.filter(low | (F.col("status") == "failed")).select(F.lit("review").alias("list"), "project", F.when(low & (F.col("score") >= 50), "P1").otherwise("P0").alias("priority"), F.col("score").alias("rank"))
    large = (F.col("source_files") > 20) & (edges == 0)
    clean = scored.filter(large | (F.col("unsupported") > 0)).select(F.lit("cleanup").alias("list"), "project", F.when(large, "P1").otherwise("P2").alias("priority"), F.lit(0).cast("long").alias("rank"))
    return read.unionByName(review).unionByName(clean)


def overall_health(scored: DataFrame) -> DataFrame:
    """One row: the mean score weighted by symbols (one at least), rounded half to even, and its risk; 0 and `unknown` without projects."""
    w = F.greatest(F.col("symbols"), F.lit(1))
    out = scored.agg(F.bround(F.sum(F.col("score") * w) / F.sum(w), 0).cast("long").alias("overall"), F.count("*").alias("projects"))
    return out.select(F.coalesce("overall", F.lit(0)).alias("overall"), F.when(F.col("projects") == 0, "unknown").otherwise(risk_level(F.col("overall"))).alias("risk"), "projects")


def review_gate(touched: DataFrame, hot: DataFrame, entry: DataFrame) -> DataFrame:
    """(change, touched, level): over 9 touched symbols high, 4 to 9 or a hotspot medium, else low; a public entry makes it critical."""
    j = touched.join(hot.select("id", F.lit(1).alias("h")).distinct(), "id", "left").join(entry.select("id", F.lit(1).alias("e")).distinct(), "id", "left")
    by = j.groupBy("change").agg(F.count_distinct("id").alias("touched"), F.max("h").alias("h"), F.max("e").alias("e"))
    level = F.when(F.col("e") == 1, "critical").when(F.col("touched") >= 10, "high").when((F.col("touched") >= 4) | (F.col("h") == 1), "medium").otherwise("low")
    return by.select("change", "touched", level.alias("level"))


def impact_risk(n: Column, unsupported: Column) -> Column:
    """critical from 10 affected, high from 4 or with an unsupported boundary, medium from 2, low from 1."""
    return F.when(n >= 10, "critical").when((n >= 4) | ((n >= 1) & unsupported), "high").when(n >= 2, "medium").when(n >= 1, "low").otherwise("none")
