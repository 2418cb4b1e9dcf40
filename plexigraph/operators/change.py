"""Change operators: snapshots, runs, drift, fingerprints and incremental plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plexigraph.operators.resolve import overlapping
from plexigraph.session import by_exchange, store


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of snapshots(path, content_hash): added, removed, modified or unchanged."""
    o = old.select("path", F.col("content_hash").alias("__o"), F.lit(True).alias("__a"))
    n = new.select("path", F.col("content_hash").alias("__n"), F.lit(True).alias("__b"))
    j = o.join(n, "path", "full")
    return j.select("path", F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__o").eqNullSafe(F.col("__n")), "unchanged").otherwise("modified").alias("status"))


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("unchanged", "modified", "added", "removed")])


#: Extensions of sources and of documents, names and extensions of manifests and configuration.
SOURCE_EXTENSIONS = ["rs", "cj", "ets", "ts", "tsx", "js", "jsx", "c", "h", "cpp", "hpp", "py", "sh"]
DOC_EXTENSIONS = ["md", "mdx", "rst"]
MANIFESTS = ["Cargo.toml", "Cargo.lock", "cjpm.toml", "oh-package.json5", "tsconfig.json", "package.json", "compile_commands.json", "pyproject.toml", "setup.py", "requirements.txt"]
CONFIG_EXTENSIONS = ["yaml", "yml", "toml", "json", "json5"]
#: Reason and phases to redo by what a dirty file is, first match first.
DIRTY = {
    "removed": ("tracked-file-removed", ["discover", "fingerprint", "parse", "symbols", "imports", "calls", "diagnostics", "graph"]),
    "source": ("source-file-metadata-changed", ["fingerprint", "parse", "symbols", "imports", "calls", "diagnostics", "graph"]),
    "config": ("manifest-or-config-metadata-changed", ["discover", "fingerprint", "imports", "calls", "diagnostics", "graph"]),
    "document": ("documentation-metadata-changed", ["fingerprint", "diagnostics"]),
    "other": ("tracked-file-metadata-changed", ["fingerprint", "diagnostics", "graph"]),
}


def dirty_kind(path: Column, status: Column) -> Column:
    """Key of DIRTY for a changed file: removed whatever it was, else by extension, name and folder."""
    name = F.substring_index(path, "/", -1)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    config = name.isin(MANIFESTS) | ext.isin(CONFIG_EXTENSIONS) | path.contains("/config/")
    return F.when(status == "removed", "removed").when(ext.isin(SOURCE_EXTENSIONS), "source").when(config, "config").when(ext.isin(DOC_EXTENSIONS), "document").otherwise("other")


def dirty_reason(path: Column, status: Column) -> Column:
    kind = dirty_kind(path, status)
    return F.coalesce(*[F.when(kind == k, reason) for k, (reason, _) in DIRTY.items()])


def phases(path: Column, status: Column) -> Column:
    """Phases to redo for a changed file, in order."""
    kind = dirty_kind(path, status)
    return F.coalesce(*[F.when(kind == k, F.array(*[F.lit(x) for x in own])) for k, (_, own) in DIRTY.items()])


def incremental_plan(diff: DataFrame, had_previous: bool = True, preview: int = 20) -> DataFrame:
    """One row: counts, strategy, the first dirty paths and how many more there are.

    No previous snapshot, or added or removed files: fullAnalysis. Modified only:
    fileScopedCandidate. Nothing: reuse. The preview is a top-k, not a sort of all paths.
    """
    counts = change_counts(diff)
    dirty = diff.filter("status <> 'unchanged'")
    top = dirty.orderBy("path").limit(preview).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("preview"))  # at most `preview` rows
    strategy = F.lit("fullAnalysis") if not had_previous else F.when(F.col("added") + F.col("removed") > 0, "fullAnalysis").when(F.col("modified") > 0, "fileScopedCandidate").otherwise("reuse")
    n = F.col("modified") + F.col("added") + F.col("removed")
    return counts.join(F.broadcast(top)).select("unchanged", "modified", "added", "removed", strategy.alias("strategy"), "preview", F.greatest(n - preview, F.lit(0)).alias("omitted"))


def compare_runs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): rows of one run only, as `added` or `removed`."""
    o, n = old.select(*keys).distinct(), new.select(*keys).distinct()
    return n.join(o, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(o.join(n, keys, "left_anti").withColumn("change", F.lit("removed")))


def run_deltas(sections: list[tuple[str, DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """(section, old, new, delta, added, removed) of runs' tables, given as (section, old, new, keys)."""
    out = None
    for name, old, new, keys in sections:
        side = lambda df, o, n: df.select(*keys, F.lit(o).alias("__o"), F.lit(n).alias("__n"))  # noqa: B023, E731
        by = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*keys).agg(F.max("__o").alias("o"), F.max("__n").alias("n"))
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
        row = by.agg(total("o").alias("old"), total("n").alias("new"), total((F.col("n") > F.col("o")).cast("int")).alias("added"), total((F.col("o") > F.col("n")).cast("int")).alias("removed"))
        row = row.select(F.lit(name).alias("section"), "old", "new", (F.col("new") - F.col("old")).alias("delta"), "added", "removed")
        out = row if out is None else out.unionByName(row)
    return out


def breaking_changes(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, change, callers): public symbols(id, kind, visibility) of the old version that the new one lacks (removed), no longer
    shows (hidden) or has as another kind (kind), with how many callers, calls(source, target), each has."""
    shown = old.filter(F.col("visibility").isin("pub", "public")).select("id", F.col("kind").alias("__k"))
    j = shown.join(new.select("id", "kind", "visibility"), "id", "left")
    change = F.when(F.col("kind").isNull(), "removed").when(~F.col("visibility").isin("pub", "public"), "hidden").when(F.col("kind") != F.col("__k"), "kind")
    hit = j.select("id", change.alias("change")).filter("change is not null")
    callers = calls.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("callers"))
    return hit.join(callers, "id", "left").select("id", "change", F.coalesce("callers", F.lit(0)).alias("callers"))


def baseline_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(target, metric, change, level) of (target, metric, value) tables.

    Counts: a drop of 10 % warns, of 20 % fails. `elapsed`: a rise of 50 or 150 %. `rate`: a rise
    of .05 or .10. A zero baseline is no change.
    """
    j = baseline.withColumnRenamed("value", "b").join(current.withColumnRenamed("value", "c"), ["target", "metric"])
    rel = F.when(F.col("b") == 0, 0.0).otherwise((F.col("c") - F.col("b")) / F.col("b"))
    change = F.round(F.when(F.col("metric") == "rate", F.col("c") - F.col("b")).otherwise(rel), 4)
    j = j.withColumn("change", change)
    x = F.when(F.col("metric").isin("rate", "elapsed"), F.col("change")).otherwise(-F.col("change"))
    warn = F.when(F.col("metric") == "rate", 0.05).when(F.col("metric") == "elapsed", 0.5).otherwise(0.1)
    fail = F.when(F.col("metric") == "rate", 0.1).when(F.col("metric") == "elapsed", 1.5).otherwise(0.2)
    return j.select("target", "metric", "change", F.when(x >= fail, "fail").when(x >= warn, "warn").otherwise("ok").alias("level"))


def fingerprint(rows: DataFrame, cols: list[str], group: list[str]) -> DataFrame:
    """(group, n, fingerprint): a digest that doesn't depend on order: the sum of 60-bit row digests, modulo a prime.

    Rows add up on the map side, so a group of any size is one number on its way.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.withColumn("__x", part).groupBy(*group).agg(F.count("*").alias("n"), (F.sum("__x") % F.lit(2305843009213693951).cast("decimal(38,0)")).cast("long").alias("fingerprint"))


def changed_symbols(overlaps: DataFrame) -> DataFrame:
    """(symbol, hunks, kinds): hunks per symbol and the sorted set of their kinds."""
    return overlaps.groupBy("symbol").agg(F.count("*").alias("hunks"), F.array_join(F.sort_array(F.collect_set("change_kind")), ",").alias("kinds"))


def changed_ranges(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol, hunks, kinds): `changed_symbols` of what hunks(hunk, file, new_start, new_end, change_kind) and ranges(id, file,
    line_start, line_end) overlap, counted without their pairs.

    Of the hunks of a file and kind, a range overlaps those that start by its end less those that end before its start: two
    running sums over the file's lines. A hunk is one range of a file. Ids with several ranges and ranges that end before
    they start are compared with the hunks one by one.
    """
    h = store(hunks.select("hunk", "file", "new_start", "new_end", "change_kind").distinct())
    r = ranges.select(F.col("id").alias("symbol"), "file", "line_start", "line_end").distinct()
    held = r.groupBy("symbol").agg(F.count("*").alias("n"), F.min(F.struct("file", "line_start", "line_end")).alias("r"))
    plain = F.coalesce((F.col("n") == 1) & (F.col("r.line_start") <= F.col("r.line_end")), F.lit(False))
    one, rest = held.filter(plain).select("symbol", "r.*"), held.filter(~plain).select(F.col("symbol").alias("__s"))

    forward = h.filter("new_start <= new_end")
    at = lambda c, s, e: F.struct(F.col(c).alias("line"), F.lit(s).alias("s"), F.lit(e).alias("e"))
    marks = forward.select("file", "change_kind", F.inline(F.array(at("new_start", 1, 0), at("new_end", 0, 1)))).groupBy("file", "change_kind", "line").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    ask = lambda c, turn: F.struct(F.col(c).alias("line"), F.lit(turn).alias("turn"))
    asked = one.join(by_exchange(forward.select("file", "change_kind").distinct()), "file").select("file", "change_kind", "symbol", F.inline(F.array(ask("line_start", 0), ask("line_end", 2))))
    w = Window.partitionBy("file", "change_kind").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = marks.withColumn("turn", F.lit(1)).unionByName(asked, allowMissingColumns=True)
    sums = rows.withColumn("n", F.when(F.col("turn") == 2, F.coalesce(F.sum("s").over(w), F.lit(0))).otherwise(-F.coalesce(F.sum("e").over(w), F.lit(0)))).filter("turn <> 1")
    found = sums.groupBy("symbol", "change_kind").agg(F.sum("n").alias("n")).filter("n > 0")

    pairs = []
    if not rest.isEmpty():
        pairs.append(overlapping(h, r.join(by_exchange(rest), F.col("symbol").eqNullSafe(F.col("__s")), "left_semi").withColumnRenamed("symbol", "id")))
    if not (back := h.filter("new_start > new_end")).isEmpty():
        pairs.append(overlapping(back, one.withColumnRenamed("symbol", "id")))
    for x in pairs:
        found = found.unionByName(x.select("hunk", "symbol", "change_kind").distinct().groupBy("symbol", "change_kind").agg(F.count("*").alias("n")))
    return found.groupBy("symbol").agg(F.sum("n").alias("hunks"), F.array_join(F.sort_array(F.collect_set("change_kind")), ",").alias("kinds"))


#: Fixed values of the surface rules.
UNSUPPORTED_LANGUAGES = ["csharp", "java", "go", "swift", "kotlin"]
FIXTURE_LIKE = ["fixture", "test", "docs"]
#: Root folders of tools' own state.
PRIVATE_FOLDERS = [".claude", ".arts", ".sisyphus"]


def surface(path: Column, label: Column, language: Column, owner_kind: Column) -> Column:
    """unsupported, fixture, test, docs, webui, script or production of a workspace file or project, first rule first."""
    p, name = F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), F.lower(label)
    under = lambda x: p.contains(f"/{x}/") | p.startswith(f"{x}/")
    return (
        F.when((owner_kind == "unsupported") | F.lower(language).isin(UNSUPPORTED_LANGUAGES), "unsupported")
        .when(under("fixtures") | p.contains("/fixture/") | p.contains("portable-smoke") | name.rlike("fixture|smoke|corpus"), "fixture")
        .when(under("tests") | p.contains("/__tests__/") | p.contains("/test/") | name.contains("test"), "test")
        .when(under("docs"), "docs")
        .when(under("webui"), "webui")
        .when(under("scripts"), "script")
        .otherwise("production")
    )


def impact_group(change_type: Column, surface_: Column, confidence: Column, supported: Column) -> Column:
    """direct, unsupportedBoundary, fixtureOnly (fixtures, tests, documents), highConfidence (from .65) or lowConfidence."""
    return F.when(change_type == "direct", "direct").when(~supported | (surface_ == "unsupported"), "unsupportedBoundary").when(surface_.isin(FIXTURE_LIKE), "fixtureOnly").when(confidence >= 0.65, "highConfidence").otherwise("lowConfidence")


def suppressed(change_type: Column, surface_: Column, group: Column, include_fixtures: bool = False, strict: bool = False) -> Column:
    """What a report leaves out: with `strict` nothing, and never what changed itself; else fixtures and low confidence,
    of which `include_fixtures` shows all that are fixture-like, whatever their group."""
    if strict:
        return F.lit(False)
    hidden = (change_type != "direct") & group.isin("fixtureOnly", "lowConfidence")
    return hidden & ~surface_.isin(FIXTURE_LIKE) if include_fixtures else hidden


def private_path(path: Column) -> Column:
    """Paths of tools' own state at the root, that changes leave out."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    return F.split(p, "/")[0].isin(PRIVATE_FOLDERS)


def duration_bucket(files: Column) -> Column:
    return F.when(files <= 10, "short").when(files <= 50, "medium").when(files <= 200, "long").otherwise("very-long")
