"""Source-tree front end: folders as file tables, facts, and a graph assembled from facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.operators import core, resolve
from plexigraph.session import by_exchange, store
from plexigraph.sources.extract import facts

#: Folders that scans leave out.
SKIPPED = ["target", ".git", "node_modules", "vendor", "fixtures"]


def read_tree(spark: SparkSession, root: str, skip: list[str] | None = None) -> DataFrame:
    """(path, text, length, modified_ms, extension) of the files under a folder, paths relative to it."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace("path", "^.*?" + base.replace(".", "\\.") + "/", "")
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"), "length", F.unix_millis("modificationTime").alias("modified_ms")).withColumn("extension", F.regexp_extract("path", r"\.([^./]+)$", 1))
    names = "|".join(x.replace(".", "\\.") for x in (SKIPPED if skip is None else skip))
    return out.filter(~F.col("path").rlike(rf"(^|/)({names})/")) if names else out


def snapshot(files: DataFrame) -> DataFrame:
    """(path, len, modified_ms, extension, content_hash)."""
    return files.select("path", F.col("length").alias("len"), "modified_ms", "extension", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def inventory(files: DataFrame, max_depth: int = 5, max_files: int = 5000) -> DataFrame:
    """(dir, files, has_manifest, language) of folders that hold a manifest or at least two source files."""
    from plexigraph.operators.text import majority
    from plexigraph.sources.extract import LANGUAGES

    names = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    f = files.filter(F.size(F.split("path", "/")) <= max_depth + 1).orderBy("path").limit(max_files).select("path", "extension")
    f = f.withColumn("dir", F.regexp_replace("path", "(^|/)[^/]*$", "")).withColumn("language", F.try_element_at(names, F.col("extension")))
    manifest = F.substring_index("path", "/", -1).isin("Cargo.toml", "package.json", "pyproject.toml", "cjpm.toml", "requirements.txt", "CMakeLists.txt")
    by = f.groupBy("dir").agg(F.count_if(F.col("language").isNotNull()).alias("files"), F.bool_or(manifest).alias("has_manifest")).filter("has_manifest or files >= 2")
    return by.join(majority(f.filter("language is not null"), ["dir"], "language").select("dir", "language"), "dir", "left")


def ownership(sources: DataFrame, packages: DataFrame, targets: DataFrame) -> DataFrame:
    """(path, package, target, confidence): the nearest package root, then its target.

    packages(root, package), targets(package, target). src/lib.rs and src/main.rs belong to the
    package's own name, src/bin/x.rs and src/bin/x/main.rs to x, else to the only target (.90);
    several or none are .50 without one, files outside every package .30.
    """
    own = resolve.longest_prefix(sources, packages).join(packages, "root", "left")
    n = targets.groupBy("package").agg(F.count_distinct("target").alias("n"), F.min("target").alias("only"))
    j = own.join(n, "package", "left")
    rel = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    named = F.when(rel.isin("src/lib.rs", "src/main.rs"), F.replace("package", F.lit("-"), F.lit("_"))).when(rel.rlike(r"^src/bin/[^/]+\.rs$"), F.regexp_extract(rel, r"^src/bin/([^/]+)\.rs$", 1)).when(rel.rlike(r"^src/bin/[^/]+/main\.rs$"), F.regexp_extract(rel, "^src/bin/([^/]+)/main", 1)).when(F.col("n") == 1, F.col("only"))
    return j.select("path", "package", named.alias("target"), F.when(F.col("package").isNull(), 0.30).when(named.isNotNull(), 0.90).otherwise(0.50).alias("confidence"))


def _declared(fact: DataFrame) -> DataFrame:
    """(file, child) of the modules that Rust files declare without a body, extracted once."""
    decl = fact.filter("fact = 'symbol' and kind = 'module' and language = 'rust' and line_start = line_end")
    return store(decl.select(F.col("path").alias("file"), F.col("name").alias("child")).distinct())


def _stems(rust: DataFrame) -> DataFrame:
    """(stem, path): what a module's place is called if the file is its own, `stem.rs` or `stem/mod.rs`."""
    own = lambda x: F.when(F.endswith("path", F.lit(x)), F.expr(f"substring(path, 1, length(path) - {len(x)})"))
    return rust.select(F.explode(F.array(own(".rs"), own("/mod.rs"))).alias("stem"), "path").filter("stem is not null")


def module_paths(files: DataFrame, fact: DataFrame, depth: int = 16) -> DataFrame:
    """(path, module, confidence) of Rust files by their `mod` declarations; others fall back to `crate` at .50.

    The loop runs over levels of the module tree, at most `depth`.
    """
    rust = files.filter(F.col("path").endswith(".rs")).select("path")
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    decl = _declared(fact)
    stems = by_exchange(_stems(rust))
    now = rust.filter(F.col("path").rlike(r"(^|/)(lib|main)\.rs$")).select("path", F.lit("crate").alias("module"), F.lit(1.0).alias("confidence"), folder.alias("at"))
    out = now
    for d in range(1, depth + 1):
        step = now.join(by_exchange(decl.withColumnRenamed("file", "path")), "path").select(F.concat_ws("::", "module", "child").alias("module"), F.when(F.col("at") == "", F.col("child")).otherwise(F.concat_ws("/", "at", "child")).alias("at"))
        now = store(step.distinct().join(stems, F.col("at") == F.col("stem")).select("path", "module", F.lit(0.85 if d == 1 else 0.80).alias("confidence"), "at"))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    best = out.groupBy("path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "module")).alias("b"))
    return rust.join(by_exchange(best), "path", "left").select("path", F.coalesce("b.module", F.lit("crate")).alias("module"), F.coalesce(-F.col("b.c"), F.lit(0.50)).alias("confidence"))


def module_states(files: DataFrame, fact: DataFrame, depth: int = 16) -> DataFrame:
    """(root, module, state, file, confidence) of each declared Rust module of each crate folder `root`.

    A declaration `mod x` leads to x.rs or x/mod.rs in the folder of its file's module: to one of them (resolved: the crate
    root .90, one step below .85, deeper .80), to both (ambiguous, 0) or to none (missing, .50); the last two lead no further.
    """
    rust = files.filter(F.col("path").endswith(".rs")).select("path")
    decl = by_exchange(_declared(fact))
    stems = by_exchange(_stems(rust).groupBy("stem").agg(F.count("*").alias("n"), F.min("path").alias("only")))
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    now = rust.filter(F.col("path").rlike(r"(^|/)(lib|main)\.rs$")).select(folder.alias("root"), F.lit("crate").alias("module"), F.lit("resolved").alias("state"), F.col("path").alias("file"), F.lit(0.90).alias("confidence"), folder.alias("at"))
    out = now
    for d in range(1, depth + 1):
        base = F.when(F.col("at") == "", F.col("child")).otherwise(F.concat_ws("/", "at", "child"))
        step = now.filter("state = 'resolved'").join(decl, "file").select("root", F.concat_ws("::", "module", "child").alias("module"), base.alias("at"))
        found = step.distinct().join(stems, F.col("at") == F.col("stem"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
        one = F.col("n") == 1
        now = store(found.select("root", "module", F.when(one, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"), F.when(one, F.col("only")).alias("file"), F.when(one, 0.85 if d == 1 else 0.80).when(F.col("n") > 1, 0.0).otherwise(0.50).alias("confidence"), "at"))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out.drop("at")


def graph(files: DataFrame, fact: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree: files, symbols, DEFINES, HAS_PARENT by scope, CALLS by unique name, externals completed.

    A call resolves to the only function of its file, else of the project, else, from Rust, to a symbol outside
    (`resolve.outside`), with the caller being the narrowest function around the call. Symbols outside get nodes without
    kind and file, marked `is_external`.
    """
    fact = facts(files) if fact is None else fact
    fact = store(fact.filter("fact in ('symbol', 'call') or fact = 'import' and language = 'rust'").select("path", "language", "fact", "name", "kind", "scope", "line_start", "line_end", "target"))
    sym = fact.filter("fact = 'symbol'").withColumn("sid", F.concat_ws("::", F.concat(F.lit("symbol:"), "path"), F.when(F.col("scope") != "", F.col("scope")), "name"))
    sym = store(core.disambiguate_ids(sym, "sid", "line_start", ["path", "line_start", "kind"]).select(F.col("unique_id").alias("id"), "path", "language", "name", "kind", "scope", "line_start", "line_end"))
    file_nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("source-file").alias("label"), F.lit("file").alias("kind"), F.substring_index("path", "/", -1).alias("name"), F.col("path").alias("file"))
    nodes = file_nodes.unionByName(sym.select("id", F.lit("symbol").alias("label"), "kind", "name", F.col("path").alias("file"))).withColumn("is_external", F.lit(False))
    defines = sym.select(F.lit("DEFINES").alias("edge_type"), F.concat(F.lit("file:"), "path").alias("source"), F.col("id").alias("target"), F.lit(1.0).alias("confidence"))
    parents = resolve.parents(sym).select(F.lit("HAS_PARENT").alias("edge_type"), F.col("id").alias("source"), F.col("parent").alias("target"), F.lit(1.0).alias("confidence"))
    calls = fact.filter("fact = 'call'").select(F.col("path").alias("file"), "language", F.col("line_start").alias("line"), "name", "kind", "target").distinct()
    funcs = sym.filter(F.col("kind").isin("function", "method", "associated-function"))
    placed = resolve.enclosing(calls, funcs.select("id", F.col("path").alias("file"), "line_start", "line_end")).filter("scope is not null")
    # Of each name the only function of its file and the only one of all: a name that many files hold costs a row a file.
    local = funcs.groupBy(F.col("path").alias("file"), "name").agg(F.min("id").alias("own"), F.max("id").alias("__z")).filter("own = __z").drop("__z")
    # Stored, so that tasks of a name that many calls have can be split.
    only = store(funcs.groupBy("name").agg(F.min("id").alias("only"), F.max("id").alias("__z")).filter("only = __z").drop("__z"))
    here = store(placed.join(by_exchange(local), ["file", "name"], "left"))
    far = store(here.filter("own is null").drop("own").join(by_exchange(only), "name", "left"))
    imports = fact.filter("fact = 'import'").select(F.col("path").alias("file"), "name", "kind", "target")
    types = sym.filter((F.col("language") == "rust") & F.col("kind").isin("struct", "enum", "trait", "type-alias")).select(F.col("path").alias("file"), "name")
    out = resolve.outside(far.filter("only is null and language = 'rust'"), imports, types).select("scope", F.concat(F.lit("symbol:"), "path").alias("target"), "confidence")
    done = here.filter("own is not null").select("scope", F.col("own").alias("target"), F.lit(0.85).alias("confidence")).unionByName(far.filter("only is not null").select("scope", F.col("only").alias("target"), F.lit(0.55).alias("confidence")))
    # Stored, as the nodes' completion and the edges both read them.
    called = store(done.unionByName(out).groupBy(F.lit("CALLS").alias("edge_type"), F.col("scope").alias("source"), "target").agg(F.max("confidence").alias("confidence")))
    nodes = nodes.unionByName(core.external_nodes(by_exchange(sym), called), allowMissingColumns=True)
    return nodes, defines.unionByName(parents).unionByName(called)
