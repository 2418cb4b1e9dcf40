"""Import and include resolution: ranked candidate paths joined with the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexigraph.functions.paths import normalise
from plexigraph.model import confidence
from plexigraph.operators.resolve import prefixes, ranked
from plexigraph.session import by_exchange


def _dir(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def _under(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat_ws("/", folder, rest))


def _candidates(df: DataFrame, lists: list[tuple[Column, str, float]], stop: Column | None = None) -> DataFrame:
    """Exploded (ref, path, rank, confidence, reason, stop) from arrays of paths in their order of preference."""
    def numbered(k: int, reason: str, conf: float):
        return lambda p, i: F.struct(p.alias("path"), (F.lit(100 * k) + i).alias("rank"), F.lit(conf).alias("confidence"), F.lit(reason).alias("reason"))

    parts = [F.transform(paths, numbered(k, r, c)) for k, (paths, r, c) in enumerate(lists)]
    return df.select("ref", (stop if stop is not None else F.lit(False)).alias("stop"), F.inline(F.concat(*[F.coalesce(p, F.expr("cast(array() as array<struct<path string, rank int, confidence double, reason string>>)")) for p in parts])))


#: What is tried after a path, in this order.
SUFFIXES = ["", ".ts", ".tsx", ".d.ts", "/index.ts", "/index.tsx", "/index.d.ts"]


def _by_base(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """(base, k): the first suffix, by its place, with which a base is one of files(path)."""
    cut = [F.when(F.endswith("path", F.lit(x)), F.struct(F.expr(f"substring(path, 1, length(path) - {len(x)})").alias("base"), F.lit(k).alias("k"))) for k, x in enumerate(suffixes)]
    return files.select(F.inline(F.array(*cut))).filter("base is not null").groupBy("base").agg(F.min("k").alias("k"))


def resolve_ts(refs: DataFrame, files: DataFrame, mappings: DataFrame, packages: DataFrame) -> DataFrame:
    """(ref, target, confidence, reason) of refs(ref, file, spec).

    Relative specs by extension and index; then configured paths(pattern, substitution), exact before
    the longest prefix wildcard, where a match whose file is missing stops; then workspace packages
    (name, root), whole or by their longest prefix and subpath; everything else is external.
    """
    spec = F.col("spec")
    said = spec.rlike(r"^\.|^/")
    bare = refs.filter(~said)
    relative = refs.filter(said).select("ref", F.lit(0).alias("rung"), normalise(_under(_dir(F.col("file")), spec)).alias("base"))
    exact = bare.join(by_exchange(mappings.filter(~F.col("pattern").contains("*"))), F.col("pattern") == spec).select("ref", F.lit(1).alias("rung"), F.col("substitution").alias("base"))
    # The patterns that a spec starts with, by an equi-join on those prefixes that end as some pattern does.
    stems = mappings.filter(F.col("pattern").endswith("*")).select(F.expr("substring(pattern, 1, length(pattern) - 1)").alias("p"), "substitution")
    ends = stems.agg(F.collect_set(F.right("p", F.lit(1))).alias("ends"))  # one row of single characters
    starts = bare.join(F.broadcast(ends)).select("ref", "spec", F.explode(F.filter(F.sequence(F.lit(1), F.length("spec")), lambda n: F.array_contains("ends", F.substring("spec", n, F.lit(1))))).alias("n")).select("ref", "spec", F.expr("substring(spec, 1, n)").alias("p"))
    longest = starts.join(by_exchange(stems), "p").groupBy("ref", "spec").agg(F.max(F.struct(F.length("p").alias("n"), "p", "substitution")).alias("m"))
    wild = longest.select("ref", F.lit(2).alias("rung"), F.replace(F.col("m.substitution"), F.lit("*"), F.expr("substring(spec, m.n + 1)")).alias("base"))
    whole = bare.join(by_exchange(packages), F.col("name") == spec).select("ref", F.inline(F.array(*[F.struct(F.lit(3 + k).alias("rung"), F.concat("root", F.lit(x)).alias("base")) for k, x in enumerate(("/src/index.ts", "/index.ts"))])))
    folders = bare.select("ref", "spec", F.explode(prefixes(spec)).alias("name")).filter("name <> '' and name <> spec")
    sub = folders.join(by_exchange(packages), "name").groupBy("ref", "spec").agg(F.max(F.struct(F.length("name").alias("n"), "root")).alias("m"))
    sub = sub.select("ref", F.lit(5).alias("rung"), F.concat(F.col("m.root"), F.lit("/src/"), F.expr("substring(spec, m.n + 2)")).alias("base"))
    tried = relative.unionByName(exact).unionByName(wild).unionByName(whole).unionByName(sub)
    # One row a base, not one for each suffix; workspace entries name a whole file.
    j = tried.join(by_exchange(_by_base(files, SUFFIXES)), "base", "left")
    found, mapped = F.col("k").isNotNull() & (~F.col("rung").isin(3, 4) | (F.col("k") == 0)), F.col("rung").isin(1, 2)
    path = F.concat("base", F.get(F.array(*[F.lit(x) for x in SUFFIXES]), F.col("k")))
    best = j.filter(found | mapped).groupBy("ref").agg(F.min(F.when(found, F.struct("rung", "k", path.alias("path")))).alias("m"), F.bool_or(mapped).alias("stop"))
    best = best.withColumn("m", F.when((F.col("m.rung") < 3) | ~F.col("stop"), F.col("m")))
    names = ["relative", "path-exact", "path-wildcard", "workspace", "workspace", "subpath"]
    rung = F.get(F.array(*[F.struct(F.lit(confidence("ts-import", x)).alias("c"), F.lit(x).alias("r")) for x in names]), F.col("m.rung"))
    out = refs.select("ref").join(by_exchange(best), "ref", "left").withColumn("rung", rung)
    return out.select("ref", F.col("m.path").alias("target"), F.coalesce("rung.c", F.lit(0.0)).alias("confidence"), F.coalesce("rung.r", F.lit("unresolved")).alias("reason"))


#: Extensions that a JavaScript import may leave out, in this order.
JS_EXTENSIONS = ["js", "jsx", "mjs", "cjs"]


def resolve_js(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(ref, target, confidence, reason) of refs(ref, file, spec): a relative spec that is a file or a folder as it stands,
    else with another extension in place of its own; all others are external packages."""
    there = files.select(F.explode(prefixes(F.col("path"))).alias("path")).filter("path <> ''")
    # What a path is by itself, and the first extension with which it is one.
    cut = [F.struct(F.col("path").alias("base"), F.lit(0).alias("k"))] + [F.when(F.endswith("path", F.lit(f".{x}")), F.struct(F.expr(f"substring(path, 1, length(path) - {len(x) + 1})").alias("base"), F.lit(k).alias("k"))) for k, x in enumerate(JS_EXTENSIONS, 1)]
    by = there.select(F.inline(F.array(*cut))).filter("base is not null").groupBy("base").agg(F.bool_or(F.col("k") == 0).alias("itself"), F.min(F.when(F.col("k") > 0, F.col("k"))).alias("k"))
    r = refs.filter(F.col("spec").startswith(".")).select("ref", normalise(_under(_dir(F.col("file")), F.col("spec"))).alias("b"))
    r = r.withColumn("bare", F.regexp_replace("b", r"([^/])\.[^./]*$", "$1"))
    ask = lambda base, whole, cut_: F.struct(F.col(base).alias("base"), F.lit(whole).alias("whole"), F.lit(cut_).alias("cut"))
    tried = r.select("ref", F.inline(F.when(F.col("b") == F.col("bare"), F.array(ask("b", True, True))).otherwise(F.array(ask("b", True, False), ask("bare", False, True)))))
    rank = F.when(F.col("whole") & F.col("itself"), 0).when(F.col("cut"), F.col("k"))
    hits = tried.join(by_exchange(by), "base").withColumn("rank", rank).filter("rank is not null")
    path = F.concat("base", F.get(F.array(F.lit(""), *[F.lit(f".{x}") for x in JS_EXTENSIONS]), F.col("rank")))
    best = hits.groupBy("ref").agg(F.min(F.struct("rank", path.alias("path"))).alias("m"))
    outside, known = ~F.col("spec").startswith("."), F.col("m").isNotNull()
    conf = F.when(outside, confidence("js-import", "external")).when(F.col("m.rank") == 0, confidence("js-import", "existing")).when(known, confidence("js-import", "extension")).otherwise(0.0)
    reason = F.when(outside, "external").when(F.col("m.rank") == 0, "existing").when(known, "extension").otherwise("unresolved")
    return refs.select("ref", "spec").join(by_exchange(best), "ref", "left").select("ref", F.col("m.path").alias("target"), conf.alias("confidence"), reason.alias("reason"))


def resolve_includes(refs: DataFrame, files: DataFrame, quote_dirs: list[str], project_dirs: list[str]) -> DataFrame:
    """(ref, target, confidence, reason) of refs(ref, file, name, quoted).

    Quoted: own folder, quote folders, project folders, project root, then the only file of that
    name, several being ambiguous. Angle: project folders, else external.
    """
    name, last = F.col("name"), F.substring_index("name", "/", -1)
    under = lambda dirs, rung: [(F.concat(F.lit(x + "/"), name), rung) for x in dirs]
    ladder = [(normalise(_under(_dir(F.col("file")), name)), "same-dir"), *under(quote_dirs, "quote-dir"), *under(project_dirs, "project-dir"), (name, "project-root")]
    angle = under(project_dirs, "angle")
    paths = lambda rungs: F.array(*[p for p, _ in rungs]).cast("array<string>")
    tried = refs.select("ref", F.posexplode(F.when(F.col("quoted"), paths(ladder)).when(~F.col("quoted"), paths(angle))).alias("rank", "path"))
    hits = tried.join(by_exchange(files.select("path")), "path", "left_semi").select("ref", "rank", "path")
    # The last rung of quoted names: the only file of that name, or null where there are several.
    base = files.groupBy(F.substring_index("path", "/", -1).alias("__b")).agg(F.count("*").alias("__n"), F.min("path").alias("__p"))
    named = refs.filter("quoted").select("ref", last.alias("__b")).join(by_exchange(base), "__b").select("ref", F.lit(len(ladder)).alias("rank"), F.when(F.col("__n") == 1, F.col("__p")).alias("path"))
    best = hits.unionByName(named).groupBy("ref").agg(F.min(F.struct("rank", "path")).alias("__m"))
    rung = lambda names: F.get(F.array(*[F.struct(F.lit(confidence("c-include", x)).alias("c"), F.lit(x).alias("r")) for x in names]), F.col("__m.rank"))
    quoted = F.coalesce("quoted", F.lit(False))
    at = F.when(quoted, rung([r for _, r in ladder] + ["unique-basename"]))
    j = refs.join(by_exchange(best), "ref", "left").withColumn("__r", at.otherwise(rung([r for _, r in angle])) if angle else at)
    found = F.col("__m.path").isNotNull()
    missed = F.when(F.col("__m").isNotNull(), "ambiguous").when(~F.col("quoted"), "external").otherwise("unresolved")
    return j.select("ref", F.col("__m.path").alias("target"), F.when(found, F.col("__r.c")).otherwise(0.0).alias("confidence"), F.when(found, F.col("__r.r")).otherwise(missed).alias("reason"))


def resolve_python(refs: DataFrame, files: DataFrame, reexports: DataFrame) -> DataFrame:
    """(ref, target, confidence, reason) of refs(ref, file, module, level, name).

    A package's re-export of the imported name first, then the module file or package file, then the
    nearest enclosing package's file. Relative imports start level - 1 folders above the file's own.
    """
    own = F.split(_dir(F.col("file")), "/")
    up = F.array_join(F.slice(own, 1, F.greatest(F.size(own) - (F.col("level") - 1), F.lit(0))), "/")
    dotted = F.replace(F.coalesce("module", F.lit("")), F.lit("."), F.lit("/"))
    r = refs.withColumn("b", F.when(F.col("level") > 0, F.when(dotted == "", up).otherwise(_under(up, dotted))).otherwise(dotted)).withColumn("rel", F.col("level") > 0)
    first = r.join(reexports.select(F.col("name").alias("__n"), "init", F.col("path").alias("__x")), (F.col("name") == F.col("__n")) & (F.concat("b", F.lit("/__init__.py")) == F.col("init")))
    re = first.select("ref", F.lit(False).alias("stop"), F.col("__x").alias("path"), F.lit(-1).alias("rank"), F.lit(confidence("py-import", "reexport")).alias("confidence"), F.lit("reexport").alias("reason"))
    exact = F.array(F.concat("b", F.lit(".py")), F.concat("b", F.lit("/__init__.py")))
    above = F.when(F.col("b").contains("/"), F.array(F.concat(_dir(F.col("b")), F.lit("/__init__.py"))))
    absolute = _candidates(r.filter("not rel"), [(exact, "absolute", confidence("py-import", "absolute")), (above, "package", confidence("py-import", "package"))])
    relative = _candidates(r.filter("rel"), [(exact, "relative", confidence("py-import", "relative")), (above, "relative", confidence("py-import", "relative"))])
    return ranked(refs.select("ref"), re.unionByName(absolute).unionByName(relative), files)
