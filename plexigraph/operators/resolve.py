"""Reference resolution: staged, unique-or-nothing joins with a confidence and a reason on each edge.

A stage offers candidates (ref, target); a reference resolves at the first stage that offers any:
to the target if there is exactly one, to nothing (ambiguous) if there are more. Stages are unioned
with their rank and reduced once per reference, so a cascade costs one join per stage and one
aggregation, however many stages there are. Groups are reduced to (count, least target) on the map
side; no candidate set is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexigraph.functions.paths import crate_segments, normalise, prelude_path, receiver_path, split_last, strip_generics, trait_path
from plexigraph.model import confidence
from plexigraph.session import by_exchange


def unique_or_nothing(candidates: DataFrame, key: str = "ref", target: str = "target") -> DataFrame:
    """(key, n, target): the target where a key has exactly one distinct candidate, else null."""
    by = candidates.groupBy(key).agg(F.count_distinct(target).alias("n"), F.min(target).alias("__t"))
    return by.select(key, "n", F.when(F.col("n") == 1, F.col("__t")).alias(target))


def ends(symbols: DataFrame, on: list[str], target: str = "target") -> DataFrame:
    """(on, target): the least and the greatest target per key, one row where they are equal. A cascade's stage tells
    one target from several and names the least, so it ends the same as with every target of the key."""
    by = symbols.groupBy(*on).agg(F.min(target).alias("__a"), F.max(target).alias("__z"))
    return by.select(*on, F.explode(F.array_distinct(F.array("__a", "__z"))).alias(target))


def cascade(refs: DataFrame, stages: list[tuple[str, float, DataFrame, bool]], key: str = "ref") -> DataFrame:
    """(key, target, confidence, reason) for refs(key) through stages (reason, confidence, candidates, blocks).

    candidates is (key, target). A blocking stage that finds several ends in `ambiguous`; one that
    doesn't lets the reference fall through to the next stage.
    """
    parts = None
    for rank, (reason, conf, cand, blocks) in enumerate(stages):
        one = cand.groupBy(key).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
        one = one.filter((F.col("n") == 1) | F.lit(blocks)).select(key, F.struct(F.lit(rank).alias("rank"), F.col("n").alias("n"), F.col("target").alias("target"), F.lit(conf).alias("confidence"), F.lit(reason).alias("reason")).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    won = parts.groupBy(key).agg(F.min("s").alias("s"))
    out = refs.join(won, key, "left")
    one = F.col("s.n") == 1
    return out.select(*[refs[c] for c in refs.columns], F.when(one, F.col("s.target")).alias("target"), F.when(one, F.col("s.confidence")).otherwise(F.lit(0.0)).alias("confidence"), F.when(one, F.col("s.reason")).when(F.col("s").isNotNull(), "ambiguous").otherwise("unresolved").alias("reason"))


def ranked(refs: DataFrame, candidates: DataFrame, targets: DataFrame, key: str = "ref", stop: str | None = None) -> DataFrame:
    """(key, target, confidence, reason) by the least rank whose path exists.

    candidates is (key, path, rank, confidence, reason[, stop]); targets is (path). A candidate with
    `stop` whose path is missing ends the search, so nothing of a higher rank counts.
    """
    c = candidates.join(targets.select("path", F.lit(True).alias("__there")), "path", "left")
    counts = F.col("__there").isNotNull() | (F.col(stop) if stop else F.lit(False))
    best = c.filter(counts).groupBy(key).agg(F.min(F.struct("rank", "path", "confidence", "reason", F.col("__there").isNotNull().alias("there"))).alias("m"))
    out = refs.join(best, key, "left")
    hit = F.coalesce(F.col("m.there"), F.lit(False))
    return out.select(*[refs[c] for c in refs.columns], F.when(hit, F.col("m.path")).alias("target"), F.when(hit, F.col("m.confidence")).otherwise(0.0).alias("confidence"), F.when(hit, F.col("m.reason")).otherwise("unresolved").alias("reason"))


def first_match(refs: DataFrame, table: DataFrame, on: list[str], order: list[str], value: str) -> DataFrame:
    """refs with the `value` of the first table row per key in `order`."""
    first = table.groupBy(*on).agg(F.min(F.struct(*order, value)).alias("__m")).select(*on, F.col(f"__m.{value}").alias(value))
    return refs.join(first, on, "left")


def enclosing(points: DataFrame, ranges: DataFrame, file: str = "file", line: str = "line", bins: int = 64) -> DataFrame:
    """points with `scope`, the id of the narrowest range (id, file, line_start, line_end) around them.

    Ranges are dealt into line bins, so a point meets only ranges of its own bin: an equi-join on
    (file, bin) whose cost is the overlap, never files x ranges. Points of one line meet them once. Ties: the later
    start, then the id.
    """
    binned = ranges.select(F.col(file).alias("__f"), "id", "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / bins), F.floor(F.col("line_end") / bins))).alias("__b"))
    places = points.select(F.col(file).alias("__pf"), F.col(line).alias("__pl")).distinct().withColumn("__pb", F.floor(F.col("__pl") / bins))
    hits = places.join(by_exchange(binned), (F.col("__pf") == F.col("__f")) & (F.col("__pb") == F.col("__b")) & (F.col("__pl") >= F.col("line_start")) & (F.col("__pl") <= F.col("line_end")))
    best = hits.groupBy("__pf", "__pl").agg(F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), (-F.col("line_start")).alias("s"), F.col("id").alias("id"))).alias("__m"))
    scoped = best.select("__pf", "__pl", F.col("__m.id").alias("scope"))
    return points.join(by_exchange(scoped), (points[file] == F.col("__pf")) & (points[line] == F.col("__pl")), "left").select(*[points[c] for c in points.columns], "scope").distinct()


def parents(symbols: DataFrame, bins: int = 64) -> DataFrame:
    """(id, parent) of symbols(id, path, language, name, scope, line_start, line_end) whose scope a symbol of their file bears.

    The parent's name ends in the scope's last segment and its lines hold the symbol's: first one of the whole scope's
    name, then the narrowest, the later start, the id. A C++ body outside its class has the file's first symbol of the
    whole scope's name. Lines are dealt into bins, as in `enclosing`.
    """
    whole = F.replace(F.replace("scope", F.lit("()"), F.lit("")), F.lit("."), F.lit("::"))
    s = symbols.withColumn("__q", F.when(whole != "", whole)).withColumn("qname", F.concat_ws("::", "__q", "name"))
    cpp = s.filter("language = 'cpp'")
    first = cpp.groupBy(F.col("path").alias("__f"), F.col("qname").alias("__q")).agg(F.min(F.struct("line_start", F.col("id").alias("parent"))).alias("__m")).select("__f", "__q", F.col("__m.parent").alias("parent"))
    left = cpp.filter("__q is not null").select("id", F.col("path").alias("__f"), "__q").join(by_exchange(_holders(cpp, bins).select("id")), "id", "left_anti")
    return _holders(s, bins).unionByName(left.join(by_exchange(first), ["__f", "__q"]).filter("id <> parent").select("id", "parent"))


def _holders(s: DataFrame, bins: int) -> DataFrame:
    """(id, parent): the symbols around others that `parents` takes first."""
    child = s.filter("__q is not null").select("id", F.col("path").alias("__f"), "__q", F.substring_index("__q", "::", -1).alias("__n"), F.floor(F.col("line_start") / bins).alias("__b"), F.col("line_start").alias("__s"), F.col("line_end").alias("__e"))
    holder = s.select(F.col("id").alias("parent"), "path", "qname", F.substring_index("qname", "::", -1).alias("last"), "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / bins), F.floor(F.col("line_end") / bins))).alias("bin"))
    inside = (F.col("__s") >= F.col("line_start")) & (F.col("__e") <= F.col("line_end")) & (F.col("id") != F.col("parent"))
    near = child.join(by_exchange(holder), (F.col("__f") == F.col("path")) & (F.col("__n") == F.col("last")) & (F.col("__b") == F.col("bin")) & inside)
    rank = F.struct((F.col("qname") != F.col("__q")).alias("other"), (F.col("line_end") - F.col("line_start")).alias("span"), (-F.col("line_start")).alias("s"), "parent")
    return near.groupBy("id").agg(F.min(rank).alias("__m")).select("id", F.col("__m.parent").alias("parent"))


def outside(calls: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """Rust calls(file, kind, name, target, ...) that lead out of the project, with `path` and `confidence`.

    Those are paths from std, core or alloc, constructors of Option and Result, functions of a type that the file
    imports from outside or that needs no import (.80), and methods that one standard trait alone has (.55).
    imports(file, name, kind, target), types(file, name): what a file defines or imports from its crate isn't outside, nor
    is a name of several imports.
    """
    held, _ = split_last(F.col("target"))
    std = F.col("target").rlike("^(std|core|alloc)::")
    typed = (F.col("kind") == "associated-function") & ~std
    made = F.when(F.col("name").isin("Some", "None"), F.concat(F.lit("std::option::Option::"), "name")).otherwise(F.concat(F.lit("std::result::Result::"), "name"))
    path = F.when(std, strip_generics(F.col("target"))).when(F.col("kind") == "enum-constructor", made).when(F.col("kind") == "method", trait_path(F.col("name")))
    plain = calls.filter(~typed).withColumn("path", path)
    bound = imports.select("file", F.col("name").alias("__t"), F.when(F.col("kind") == "external", F.col("target")).alias("p")).unionByName(types.select("file", F.col("name").alias("__t"), F.lit(None).cast("string").alias("p")))
    bound = bound.groupBy("file", "__t").agg(F.lit(True).alias("__bound"), F.when(F.bool_and(F.col("p").isNotNull()) & (F.min("p") == F.max("p")), F.min("p")).alias("__p"))
    meant = calls.filter(typed).withColumn("__t", held).join(by_exchange(bound), ["file", "__t"], "left")
    meant = meant.withColumn("path", F.concat(strip_generics(F.when(F.col("__bound"), F.col("__p")).otherwise(prelude_path(F.col("__t")))), F.lit("::"), "name")).select(*calls.columns, "path")
    conf = F.when((F.col("kind") == "method") & ~std, confidence("call", "std-trait")).otherwise(confidence("call", "std-path"))
    return plain.unionByName(meant).filter("path is not null").withColumn("confidence", conf)


def overlapping(hunks: DataFrame, ranges: DataFrame, bins: int = 64) -> DataFrame:
    """(hunk columns, symbol): hunks(file, new_start, new_end, ...) and the ranges that they overlap."""
    h = hunks.withColumn("__b", F.explode(F.sequence(F.floor(F.col("new_start") / bins), F.floor(F.col("new_end") / bins))))
    r = ranges.select(F.col("file").alias("__f"), F.col("id").alias("symbol"), "line_start", "line_end", F.explode(F.sequence(F.floor(F.col("line_start") / bins), F.floor(F.col("line_end") / bins))).alias("__rb"))
    both = h.join(r, (h["file"] == r["__f"]) & (h["__b"] == r["__rb"]) & (h["new_start"] <= r["line_end"]) & (h["new_end"] >= r["line_start"]))
    return both.select(*hunks.columns, "symbol").distinct()


def prefixes(path: Column) -> Column:
    """All directory prefixes of a path, itself and '' included."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def longest_prefix(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """paths with `root`, the longest directory prefix among roots(root); an equi-join on exploded prefixes."""
    each = paths.withColumn("__p", F.explode(prefixes(F.col(path))))
    hit = each.join(roots.select(F.col(root).alias("__p")).distinct().withColumn("__k", F.lit(True)), "__p", "left")
    keys = [F.col(c) for c in paths.columns]
    best = hit.groupBy(*keys).agg(F.max(F.when(F.col("__k"), F.struct(F.length("__p").alias("n"), F.col("__p").alias("p")))).alias("__m"))
    return best.select(*paths.columns, F.col("__m.p").alias(root))


def by_suffix(refs: DataFrame, names: DataFrame, ref_name: str = "name", qualified: str = "qname", sep: str = "::") -> DataFrame:
    """refs with the least qualified name that equals the reference or ends in `::name`; joined on the last segment."""
    last = lambda c: F.substring_index(c, sep, -1)
    n = names.select(F.col(qualified).alias("__q"), last(F.col(qualified)).alias("__l")).distinct()
    r = refs.withColumn("__l", last(F.col(ref_name)))
    hits = r.join(n, "__l", "left").withColumn("__x", F.when(F.col("__q") == F.col(ref_name), 0).when(F.col("__q").endswith(F.concat(F.lit(sep), F.col(ref_name))), 1))
    best = hits.groupBy(*refs.columns).agg(F.min(F.when(F.col("__x").isNotNull(), F.struct("__x", "__q"))).alias("__m"))
    return best.select(*refs.columns, F.col("__m.__q").alias("target"), (F.col("__m.__x") == 0).alias("exact"))


def call_cascade(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Free-function calls: same module, import binding, same package elsewhere, same file.

    calls(ref, name, module, package, file), symbols(id, name, kind, module, package, file),
    imports(module, name, target) and wildcard imports as rows with name '*' and the module as target.
    Each stage meets symbols reduced to the ends of its own key, so a name that many symbols hold costs two rows.
    """
    s = symbols.select(F.col("id").alias("target"), "name", "kind", "module", "package", "file")
    functions = s.filter("kind = 'function'")
    same_module = calls.join(ends(s, ["name", "module"]), ["name", "module"]).select("ref", "target")
    bound = calls.join(ends(imports.filter("name <> '*'"), ["module", "name"]), ["module", "name"]).select("ref", "target")
    # Elsewhere in the package: the least and greatest symbol of each file's least and greatest, less the call's own file.
    by_file = functions.groupBy("name", "package", "file").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    package = calls.select("ref", "name", "package", "file").join(_two_files(by_file, ["name", "package"]), ["name", "package"]).filter("s_file <> file").select("ref", F.explode(F.array("lo", "hi")).alias("target"))
    in_module = functions.groupBy("name", "package", F.col("module").alias("s_module"), "file").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    glob = imports.filter("name = '*'").select("module", F.col("target").alias("s_module")).distinct()
    wild = calls.select("ref", "name", "package", "file", "module").join(glob, "module").join(_two_files(in_module, ["name", "package", "s_module"]), ["name", "package", "s_module"]).filter("s_file <> file").select("ref", F.explode(F.array("lo", "hi")).alias("target"))
    same_file = calls.join(ends(functions, ["name", "file"]), ["name", "file"]).select("ref", "target")
    return cascade(calls, [("same-module", 0.90, same_module, True), ("import", 0.85, bound, True), ("same-crate", 0.80, package, False), ("same-crate", 0.80, wild, False), ("same-file-unique", 0.70, same_file, True)])


def _two_files(by_file: DataFrame, key: list[str]) -> DataFrame:
    """by_file(key, file, lo, hi) cut to three files a key: enough to tell one symbol outside any one file from several."""
    row = F.struct("file", "lo", "hi")
    first = by_file.groupBy(*key).agg(F.min(row).alias("a"), F.max(row).alias("z"))
    inner = by_file.join(first, key).filter((F.col("file") != F.col("a.file")) & (F.col("file") != F.col("z.file"))).groupBy(*key).agg(F.min(row).alias("m"))
    ends_ = first.select(*key, F.explode(F.array_distinct(F.array("a", "z"))).alias("x"))
    return ends_.unionByName(inner.withColumnRenamed("m", "x")).select(*key, F.col("x.file").alias("s_file"), F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi"))


def qualified_cascade(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Path calls `crate::a::f`, `self::f`, `super::f`, `a::f`, by (module, name) after expansion.

    calls(ref, path, module); symbols(id, name, module) with modules as `crate::a::b`.
    """
    seg = F.split("path", "::")
    prefix = F.array_join(F.slice(seg, 1, F.size(seg) - 1), "::")
    parent = F.regexp_replace("module", "(::)?[^:]+$", "")
    c = calls.withColumn("name", F.element_at(seg, -1)).withColumn("__p", prefix)
    c = c.withColumn("__m", F.when(F.col("__p") == "self", F.col("module")).when(F.col("__p") == "super", F.when(parent != "", parent)).when(F.col("__p").startswith("self::"), F.concat("module", F.expr("substring(__p, 5)"))).when(F.col("__p").startswith("super::"), F.when(parent != "", F.concat(parent, F.expr("substring(__p, 6)")))).when((F.col("__p") == "crate") | F.col("__p").startswith("crate::"), F.col("__p")).otherwise(F.concat(F.lit("crate::"), "__p")))
    s = symbols.select(F.col("id").alias("target"), "name", F.col("module").alias("__m"))
    hits = c.join(s, ["__m", "name"]).select("ref", "target", "__p")
    local = F.col("__p").rlike("^(self|super)(::|$)")
    root = F.col("__p").rlike("^crate(::|$)")
    return cascade(calls, [("self-super", 0.80, hits.filter(local).select("ref", "target"), True), ("crate-path", 0.90, hits.filter(root).select("ref", "target"), True), ("module-path", 0.85, hits.filter(~local & ~root).select("ref", "target"), True)])


def method_cascade(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Method calls(ref, name, receiver): the only method of that name, else the one standard trait's that has it, else
    the known method of the receiver's written type. Several methods and none of these: ambiguous."""
    only = calls.join(ends(symbols.filter("kind = 'method'").select("name", F.col("id").alias("target")), ["name"]), "name").select("ref", "target")
    trait = calls.select("ref", trait_path(F.col("name")).alias("target")).filter("target is not null")
    typed = calls.select("ref", receiver_path(F.col("receiver"), F.col("name")).alias("target")).filter("target is not null")
    return cascade(calls, [("method-name", 0.65, only, False), ("std-trait", 0.55, trait, False), ("receiver-type", 0.65, typed, False), ("method-name", 0.65, only, True)])


def expand_use(path: Column, module: Column) -> Column:
    """struct(kind, expanded) of a use path written in a module `crate::a::b`: self and super steps turned into a path
    from the crate root. Kinds: crate, self, super, external; a super step above the root has no expansion."""
    here = F.split(module, "::")
    ups = F.regexp_extract(path, "^((super::)*)", 1)
    n = F.length(ups) / 7
    rest = path.substr(F.length(ups) + 1, F.length(path))
    base = F.when(n < F.size(here), F.array_join(F.slice(here, F.lit(1), (F.size(here) - n).cast("int")), "::"))
    up = F.when(rest == "", base).otherwise(F.concat(base, F.lit("::"), rest))
    own = F.concat(module, F.lit("::"), F.regexp_replace(path, "^self::", ""))
    kind = F.when(path.rlike("^crate(::|$)"), "crate").when(path.startswith("self::"), "self").when(path.startswith("super::"), "super").otherwise("external")
    return F.struct(kind.alias("kind"), F.when(kind == "crate", path).when(kind == "self", own).when(kind == "super", up).alias("expanded"))


def resolve_uses(uses: DataFrame, modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, kind, level, target, module_target, confidence, reason) of uses(ref, path, alias, reexport, module, package).

    modules(package, module, file) are those whose whole chain of declarations has files; a use of one is resolved to
    it: .90 for the crate root, .85 one step below, .80 deeper, .75 by self or super. Then the only symbol(id, name,
    module, package) of the last segment in the module before it takes over: .90, .85 for an alias or a re-export, .80
    by self or super. Several symbols leave the module, or nothing. External and wildcard uses are skipped.
    """
    u = uses.withColumn("__u", expand_use(F.col("path"), F.col("module"))).select("ref", "package", "alias", "reexport", "__u.kind", F.col("__u.expanded").alias("expanded"), "path")
    head, name = split_last(F.col("expanded"))
    u = u.withColumn("head", head).withColumn("name", name)
    by_module = u.join(modules.select("package", F.col("module").alias("expanded"), F.col("file").alias("module_target")), ["package", "expanded"], "left")
    of = symbols.groupBy("package", F.col("module").alias("head"), "name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    j = by_module.join(of, ["package", "head", "name"], "left")
    skipped = (F.col("kind") == "external") | (F.col("name") == "*") | F.col("path").endswith("::*")
    found = ~skipped & F.col("expanded").isNotNull() & (F.col("n") == 1)
    depth = F.size(crate_segments(F.col("expanded")))
    near = F.col("kind").isin("self", "super")
    module_conf = F.when(F.col("module_target").isNull() | (F.col("kind") == "external"), 0.0).when(near, 0.75).when(depth == 0, 0.90).when(depth == 1, 0.85).otherwise(0.80)
    symbol_conf = F.when(near, 0.80).when(F.col("reexport") | F.col("alias").isNotNull(), 0.85).otherwise(0.90)
    level = F.when(skipped, "skipped").when(found, "symbol").when(F.col("module_target").isNotNull(), "module").otherwise("unresolved")
    reason = F.when(F.col("kind") == "external", "external").when((F.col("kind") == "super") & F.col("expanded").isNull(), "super-at-root").when(found, F.when(near, F.col("kind")).when(F.col("reexport"), "reexport").when(F.col("alias").isNotNull(), "alias").otherwise("crate")).when(F.col("module_target").isNotNull(), F.when(near, "module-self-super").otherwise("module")).when(~skipped & (F.col("n") > 1), "ambiguous").otherwise("unresolved")
    return j.select("ref", "kind", level.alias("level"), F.when(found, F.col("id")).alias("target"), F.when(F.col("kind") != "external", F.col("module_target")).alias("module_target"), F.when(found, symbol_conf).otherwise(module_conf).alias("confidence"), reason.alias("reason"))


def associated_cascade(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Associated calls `a::Type::method`: (calls' columns, target, confidence, reason).

    calls(ref, path, module, package, file); symbols(id, name, kind, module, package, file, impl_target); imports(module,
    name, target, external): `target` is a symbol's id, or the path of an external type. The type's module is the
    call's own (or the written one) if it holds that name, else that of the only symbol imported under it, else that of
    the package's only struct or enum of the name in another file. There the only method of the type (.75), or, where
    it has none, the only symbol of the method's name (.70). Without a module an external import or a type that needs
    none gives the path (.80).
    """
    prefix, method = split_last(F.col("path"))
    c = calls.withColumn("__tp", prefix).withColumn("__method", method)
    owner, type_ = split_last(F.col("__tp"))
    c = c.withColumn("__type", type_).withColumn("__owner", owner)
    bare = (F.col("__owner") == "") | (F.col("__owner") == "crate")
    c = c.withColumn("__at", F.when(bare, F.col("module")).otherwise(F.regexp_replace("__owner", "^(crate|self|super)::", ""))).select("ref", "package", "file", "__at", "__type", "__method")

    held = symbols.groupBy(F.col("module").alias("__at"), F.col("name").alias("__type")).agg(F.lit(True).alias("__same"))
    bound = imports.filter("not external").groupBy(F.col("module").alias("__at"), F.col("name").alias("__type")).agg(F.count("*").alias("n"), F.min("target").alias("id")).filter("n = 1").join(symbols.select("id", F.col("module").alias("__bound")), "id").select("__at", "__type", "__bound")
    outside = imports.filter("external").groupBy(F.col("module").alias("__at"), F.col("name").alias("__type")).agg(F.min("target").alias("__external"))
    j = c.join(held, ["__at", "__type"], "left").join(bound, ["__at", "__type"], "left").join(outside, ["__at", "__type"], "left")
    # Types of the package by file: those of all files, less those of the call's own.
    types = symbols.filter(F.col("kind").isin("struct", "enum"))
    every = types.groupBy("package", F.col("name").alias("__type")).agg(F.count("*").alias("__n"), F.min(F.struct("file", "module")).alias("__lo"), F.max(F.struct("file", "module")).alias("__hi"))
    own = types.groupBy("package", F.col("name").alias("__type"), "file").agg(F.count("*").alias("__own"))
    j = j.join(every, ["package", "__type"], "left").join(own, ["package", "__type", "file"], "left")
    left = F.col("__n") - F.coalesce("__own", F.lit(0))
    other = F.when(left == 1, F.when(F.col("__lo.file") != F.col("file"), F.col("__lo.module")).when(F.col("__hi.file") != F.col("file"), F.col("__hi.module")))
    # One other type may lie between two of the call's own file, so it's looked up where neither end is it.
    j = j.withColumn("__crate", other).withColumn("__mid", (left == 1) & other.isNull())
    mid = j.filter("__mid").select("ref", "package", "__type", F.col("file").alias("__f")).join(types.select("package", F.col("name").alias("__type"), "file", "module"), ["package", "__type"]).filter("file <> __f").groupBy("ref").agg(F.min("module").alias("__middle"))
    j = j.join(mid, "ref", "left")
    j = j.withColumn("__m", F.when(F.col("__same"), F.col("__at")).otherwise(F.coalesce("__bound", "__crate", "__middle"))).select("ref", "__type", "__method", "__m", "__external")

    members = symbols.select(F.col("module").alias("__m"), F.col("name").alias("__method"), F.col("id").alias("__id"), F.col("kind").isin("method", "associated-function").alias("__fn"), "impl_target")
    counted = members.groupBy("__m", "__method").agg(F.count("*").alias("__all"), F.min("__id").alias("__any"), F.count_if(F.col("impl_target").isNull() & F.col("__fn")).alias("__free"), F.min(F.when(F.col("impl_target").isNull() & F.col("__fn"), F.col("__id"))).alias("__free_id"))
    typed = members.filter("impl_target is not null").groupBy("__m", "__method", F.col("impl_target").alias("__type")).agg(F.count("*").alias("__impl"), F.min("__id").alias("__impl_id"))
    j = j.join(counted, ["__m", "__method"], "left").join(typed, ["__m", "__method", "__type"], "left")
    n = F.coalesce("__free", F.lit(0)) + F.coalesce("__impl", F.lit(0))
    known = F.col("__m").isNotNull()
    path = F.when(~known, F.concat(strip_generics(F.coalesce(F.col("__external"), prelude_path(F.col("__type")))), F.lit("::"), F.col("__method")))
    one, any_ = known & (n == 1), known & (n == 0) & (F.col("__all") == 1)
    target = F.when(one, F.coalesce("__impl_id", "__free_id")).when(any_, F.col("__any")).otherwise(path)
    conf = F.when(one, 0.75).when(any_, 0.70).when(path.isNotNull(), 0.80).otherwise(0.0)
    reason = F.when(one, "associated").when(any_, "associated-any-kind").when(path.isNotNull(), "std-path").when(known & (n > 1), "ambiguous").otherwise("unresolved")
    return calls.join(j.select("ref", target.alias("target"), conf.alias("confidence"), reason.alias("reason")), "ref")


def external_calls(calls: DataFrame, indexed: list[str], crates: list[str]) -> DataFrame:
    """calls(ref, path) with `confidence`: standard paths .80, .85 where their item is in the index; known crates .60; else 0."""
    crate, item = F.split_part("path", F.lit("::"), F.lit(1)), F.split_part("path", F.lit("::"), F.lit(2))
    std = crate.isin("std", "core", "alloc")
    return calls.select("ref", "path", F.when(std & item.isin(indexed), 0.85).when(std, 0.80).when(crate.isin(crates), 0.60).otherwise(0.0).alias("confidence"))


def cpp_tiers(calls: DataFrame, names: DataFrame) -> DataFrame:
    """calls(kind, name, ...) with `confidence`, by what the project's functions, names(qname), say of them.

    Plain calls are kept if a function has the name (.90) or ends in it (.60). Qualified ones are .80 with a function of
    the last name, else .75; of `this` .80, of another receiver .75, either .45 where no function has the name; of a
    template .40.
    """
    last = lambda c: F.substring_index(c, "::", -1)
    exact = names.select(F.col("qname").alias("name")).distinct().withColumn("__e", F.lit(True))
    tails = names.filter(F.col("qname").contains("::")).select(last(F.col("qname")).alias("__l")).distinct().withColumn("__s", F.lit(True))
    j = calls.withColumn("__l", last(F.col("name"))).join(exact, "name", "left").join(tails, "__l", "left")
    here, any_ = F.col("__e").isNotNull(), F.col("__e").isNotNull() | F.col("__s").isNotNull()
    kind = F.col("kind")
    conf = F.when(kind == "plain", F.when(here, 0.90).when(any_, 0.60)).when(kind == "qualified", F.when(any_, 0.80).otherwise(0.75)).when(kind == "template", 0.40).when((kind == "this") & any_, 0.80).when(any_, 0.75).otherwise(0.45)
    return j.select(*calls.columns, conf.alias("confidence")).filter("confidence is not null")


def shell_calls(commands: DataFrame, functions: DataFrame) -> DataFrame:
    """commands(owner, name, ...) with target, confidence and reason: the first function(name, id, ord) of the name (.80), else
    a node of the outside command (.55)."""
    first = functions.groupBy("name").agg(F.min(F.struct("ord", "id")).alias("__f")).select("name", F.col("__f.id").alias("__id"))
    j = commands.join(first, "name", "left")
    own = F.col("__id").isNotNull()
    return j.select(*commands.columns, F.coalesce("__id", F.concat(F.lit("shell:command:"), "name")).alias("target"), F.when(own, 0.80).otherwise(0.55).alias("confidence"), F.when(own, "function").otherwise("external").alias("reason"))


def shell_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """sources(file, spec, ...) with target and confidence: the file that a sourced path names from its own folder (.85), else nothing."""
    folder = F.regexp_replace("file", "(^|/)[^/]*$", "")
    at = normalise(F.when((folder == "") | F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat_ws("/", folder, "spec")))
    j = sources.withColumn("__p", at).join(files.select(F.col("path").alias("__p"), F.lit(True).alias("__k")).distinct(), "__p", "left")
    return j.select(*sources.columns, F.when(F.col("__k"), F.col("__p")).alias("target"), F.when(F.col("__k"), 0.85).otherwise(0.0).alias("confidence"))


def annotated(diagnostics: DataFrame, rungs: list[tuple[str, DataFrame]], root: str) -> DataFrame:
    """diagnostics with `target`: the node of the first rung that knows them, else `root`. A rung is a column of theirs and
    (key, id) rows."""
    out = diagnostics
    for k, (col, nodes) in enumerate(rungs):
        out = out.join(nodes.select(F.col("key").alias(f"__k{k}"), F.col("id").alias(f"__id{k}")), F.col(col) == F.col(f"__k{k}"), "left")
    return out.select(*diagnostics.columns, F.coalesce(*[F.col(f"__id{k}") for k in range(len(rungs))], F.lit(root)).alias("target"))


def first_of_python(calls: DataFrame, symbols: DataFrame, aliases: DataFrame) -> DataFrame:
    """(ref, source, target, placeholder, confidence) of Python calls(ref, name, qname, file, line, confidence).

    The first symbol(id, name, qname, file, ord), in the order of files and of places in them, by qualified name, else by
    the name that an import alias(alias, symbol) stands for, else by the plain name; else a placeholder of its own. The
    source is the file and the confidence the call's own.
    """
    place = ["file", "ord"]
    by = lambda key, out: symbols.groupBy(F.col(key).alias("__k")).agg(F.min(F.struct(*place, "id")).alias("__s")).select("__k", F.col("__s.id").alias(out))
    name, qname = by("name", "__n"), by("qname", "__q")
    alias = aliases.filter("symbol is not null").groupBy(F.col("alias").alias("__a")).agg(F.max("symbol").alias("__k")).join(name.withColumnRenamed("__n", "__i"), "__k").drop("__k")
    j = calls.join(qname, F.col("qname") == F.col("__k"), "left").drop("__k").join(alias, F.col("name") == F.col("__a"), "left").join(name, F.col("name") == F.col("__k"), "left")
    found = F.coalesce("__q", "__i", "__n")
    target = F.coalesce(found.cast("string"), F.concat_ws(":", F.lit("py"), F.lit("call-target"), "file", "name", F.col("line").cast("string")))
    return j.select("ref", F.col("file").alias("source"), target.alias("target"), found.isNull().alias("placeholder"), "confidence")


def preferred_kind(calls: DataFrame, symbols: DataFrame, imports: DataFrame, ladder: list[str]) -> DataFrame:
    """TypeScript-like calls: imported name, same file, project-wide; in each, the first kind of the ladder that is unique."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ladder]), F.col("kind"))
    s = symbols.withColumn("rank", rank).filter("rank > 0").select(F.col("id").alias("target"), "name", F.col("file").alias("s_file"), "rank")
    held = ends(s, ["name", "s_file", "rank"])

    def best(c: DataFrame) -> DataFrame:
        by = c.groupBy("ref", "rank").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1")
        return by.groupBy("ref").agg(F.min(F.struct("rank", "target")).alias("m")).select("ref", F.col("m.target").alias("target"))

    imported = calls.join(imports.select("file", "name", F.col("from_file").alias("s_file")), ["file", "name"]).join(held, ["name", "s_file"])
    local = calls.join(held.withColumnRenamed("s_file", "file"), ["name", "file"]).select("ref", "target", "rank")
    project = calls.join(ends(s, ["name", "rank"]), "name").select("ref", "target", "rank")
    return cascade(calls, [("imported", 0.88, best(imported), False), ("same-file", 0.85, best(local), False), ("project-unique", 0.55, best(project), True)])
