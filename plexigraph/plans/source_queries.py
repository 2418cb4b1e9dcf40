"""Queries that read source text: every part is a small file of each language or manifest kind, and its facts are known.

A text is fixed but for its marks, which take words, numbers and visibilities of the part's row, and for the empty lines
before it, by which all places move. The SQL fills the same marks into the facts that the text holds.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph.operators import imports, reports, resolve, text
from plexigraph.plans.registry import query
from plexigraph.session import store
from plexigraph.sources import extract, manifests, tables as t, tree

#: Fixed texts with marks: @W@ and @V@ words, @N@ a number, @P@ `pub ` or `export ` where the item is public; and the facts they hold.
SOURCES = {
    "rust": (
        "p@N@/src/@W@.rs",
        """use crate::@W@::{@V@ as Other, deep::*};
@P@use std::io;
mod @W@_parts;
@P@struct T@N@ { size: u32 }
pub(crate) enum Kind { Small, Large }
impl Clone for T@N@ {
    fn clone(&self) -> Self { make_@W@() }
    @P@fn build<T: Fn(u8) -> u8>(
        size: u32,
    ) -> Self {
        let v: Vec<u8> = Vec::new();
        v.push(1);
        crate::@V@::run(size);
        Some(size)
    }
}
fn main() {
    T@N@::build(3).clone();
}
""",
        [
            ("import", "Other", "crate", "", "private", 1, 1, "crate::@W@::@V@", None, "alias"),
            ("import", "*", "crate", "", "private", 1, 1, "crate::@W@::deep::*", None, None),
            ("import", "io", "external", "", "@VIS@", 2, 2, "std::io", None, "@REX@"),
            ("symbol", "@W@_parts", "module", "", "private", 3, 3, None, None, None),
            ("symbol", "T@N@", "struct", "", "@VIS@", 4, 4, None, None, None),
            ("symbol", "Kind", "enum", "", "pub-crate", 5, 5, None, None, None),
            ("symbol", "T@N@", "impl-block", "", "private", 6, 16, "T@N@", None, "Clone"),
            ("symbol", "clone", "method", "T@N@", "private", 7, 7, None, None, None),
            ("call", "make_@W@", "free-function", None, None, 7, 7, "make_@W@", None, None),
            ("symbol", "build", "associated-function", "T@N@", "@VIS@", 8, 15, None, None, None),
            ("call", "new", "associated-function", None, None, 11, 11, "Vec::new", None, None),
            ("call", "push", "method", None, None, 12, 12, "push", None, "v.push"),
            ("call", "run", "qualified-path", None, None, 13, 13, "crate::@V@::run", None, None),
            ("call", "Some", "enum-constructor", None, None, 14, 14, "Some", 0.8, None),
            ("symbol", "main", "function", "", "private", 17, 19, None, None, None),
            ("call", "build", "associated-function", None, None, 18, 18, "T@N@::build", None, None),
            ("call", "clone", "method", None, None, 18, 18, "clone", None, "clone"),
        ],
    ),
    "python": (
        "p@N@/lib/@W@.py",
        """import @V@.core as core
from .@V@ import first, second as other
class @W@(Base):
    def run(self):
        return core.start(helper(1))
async def _hidden():
    await @W@().run()
""",
        [
            ("import", "core", "import", "", None, 1, 1, "@V@.core", 0.85, None),
            ("import", "first", "relative", "", None, 2, 2, ".@V@", 0.7, "first"),
            ("import", "other", "relative", "", None, 2, 2, ".@V@", 0.7, "second"),
            ("symbol", "@W@", "class", "", "public", 3, 5, None, None, None),
            ("symbol", "run", "method", "@W@", "public", 4, 5, None, None, None),
            ("call", "start", "attribute", "@W@.run", None, 5, 5, "core.start", 0.6, None),
            ("call", "helper", "name", "@W@.run", None, 5, 5, "helper", 0.9, None),
            ("symbol", "_hidden", "function", "", "private", 6, 7, None, None, None),
            ("call", "run", "dynamic", "_hidden", None, 7, 7, "@W@().run", 0.45, None),
            ("call", "@W@", "name", "_hidden", None, 7, 7, "@W@", 0.9, None),
        ],
    ),
    "typescript": (
        "p@N@/src/@W@.ts",
        """import { @V@, other as alias } from './@V@';
import type Config from "@scope/config";
export interface Shape { area(): number }
@P@class @W@ extends Base {
  run(x: number): void {
    helper(x);
    this.draw();
  }
}
export const make@N@ = (n: number) => new @W@();
export * from './all';
""",
        [
            ("import", "@V@", "esm", None, None, 1, 1, "./@V@", None, "@V@"),
            ("import", "alias", "esm", None, None, 1, 1, "./@V@", None, "other"),
            ("import", "Config", "esm", None, None, 2, 2, "@scope/config", None, "Config"),
            ("symbol", "Shape", "interface", "", "public", 3, 3, None, None, None),
            ("symbol", "@W@", "class", "", "@VIS@", 4, 9, None, None, None),
            ("symbol", "run", "method", "@W@", "public", 5, 8, None, None, None),
            ("call", "helper", "call", None, None, 6, 6, "helper", None, None),
            ("call", "draw", "member-access", None, None, 7, 7, "this.draw", None, None),
            ("symbol", "make@N@", "function", "", "public", 10, 10, None, None, None),
            ("call", "@W@", "new-expression", None, None, 10, 10, "@W@", None, None),
            ("import", "*", "reexport", None, None, 11, 11, "./all", None, None),
        ],
    ),
    "javascript": (
        "p@N@/src/@W@.js",
        """const fs = require('./@V@');
import @W@Default from '../@W@';
@P@function @W@(a) {
  fs.read(a);
  return inner(a);
}
class Box { open() { @W@(1); } }
module.exports = { @W@ };
""",
        [
            ("import", "fs", "require", None, None, 1, 1, "./@V@", None, None),
            ("import", "@W@Default", "esm", None, None, 2, 2, "../@W@", None, "@W@Default"),
            ("symbol", "@W@", "function", "", "@VIS@", 3, 6, None, None, None),
            ("call", "read", "member-access", None, None, 4, 4, "fs.read", None, None),
            ("call", "inner", "call", None, None, 5, 5, "inner", None, None),
            ("symbol", "Box", "class", "", "private", 7, 7, None, None, None),
            ("symbol", "open", "method", "Box", "public", 7, 7, None, None, None),
            ("call", "@W@", "call", None, None, 7, 7, "@W@", None, None),
        ],
    ),
    "c": (
        "p@N@/src/@W@.c",
        """#include "@V@.h"
#include <stdio.h>
#define LIMIT 10
struct @W@ { int size; };
static int helper(int a) { return a; }
int @W@_run(struct @W@ *x) {
  return helper(x->size) + printf("%d", LIMIT);
}
""",
        [
            ("import", "@V@.h", "quoted", None, None, 1, 1, "@V@.h", None, None),
            ("import", "stdio.h", "angle", None, None, 2, 2, "stdio.h", None, None),
            ("symbol", "LIMIT", "macro", "", "public", 3, 3, None, None, None),
            ("symbol", "@W@", "struct", "", "public", 4, 4, None, None, None),
            ("symbol", "helper", "function", "", "private", 5, 5, None, None, None),
            ("symbol", "@W@_run", "function", "", "public", 6, 8, None, None, None),
            ("call", "helper", "plain", "", None, 7, 7, "helper", None, None),
            ("call", "printf", "plain", "", None, 7, 7, "printf", None, None),
        ],
    ),
    "cpp": (
        "p@N@/src/@W@.cpp",
        """#include "@V@.hpp"
namespace @V@ {
class @W@ : public Base {
public:
  int run(int a) { return helper<int>(a); }
};
int helper2(int a) { return @V@::other(a); }
}
""",
        [
            ("import", "@V@.hpp", "quoted", None, None, 1, 1, "@V@.hpp", None, None),
            ("symbol", "@V@", "namespace", "", "public", 2, 8, None, None, None),
            ("symbol", "@W@", "class", "@V@", "public", 3, 6, None, None, None),
            ("symbol", "run", "method", "@V@::@W@", "public", 5, 5, None, None, None),
            ("call", "helper", "template", "@V@::@W@", None, 5, 5, "helper", 0.4, None),
            ("symbol", "helper2", "function", "@V@", "public", 7, 7, None, None, None),
            ("call", "other", "qualified", "@V@", None, 7, 7, "@V@::other", None, None),
        ],
    ),
    "cangjie": (
        "p@N@/src/@W@.cj",
        """package app.@V@
import std.collection.*
import app.@W@.Item as Other
public class @W@ {
    public func run(x: Int64): Int64 {
        helper(x)
    }
}
func main2() {
    @W@().run(1)
}
""",
        [
            ("package", "app.@V@", "package", None, None, 1, 1, None, None, None),
            ("import", "*", "wildcard", None, None, 2, 2, "std.collection", 0.7, None),
            ("import", "Other", "alias", None, None, 3, 3, "app.@W@.Item", 0.8, None),
            ("symbol", "@W@", "class", "", "public", 4, 8, None, None, None),
            ("symbol", "run", "method", "@W@", "public", 5, 7, None, None, None),
            ("call", "helper", "call", None, None, 6, 6, "helper", 0.8, None),
            ("symbol", "main2", "function", "", "internal", 9, 11, None, None, None),
            ("call", "@W@", "call", None, None, 10, 10, "@W@", 0.8, None),
            ("call", "run", "call", None, None, 10, 10, "run", 0.8, None),
        ],
    ),
    "arkts": (
        "p@N@/ets/@W@.ets",
        """import router from '@ohos.router';
@Entry
@Component
struct @W@ {
  @State count: number = 0;
  build() {
    Column() {
      Text('@V@')
    }
  }
}
""",
        [
            ("import", "router", "esm", None, None, 1, 1, "@ohos.router", None, "router"),
            ("symbol", "@W@", "struct", "", "private", 4, 11, None, None, None),
            ("symbol", "build", "method", "@W@", "public", 6, 10, None, None, None),
            ("call", "Column", "view", None, None, 7, 7, "Column", None, None),
            ("call", "Text", "view", None, None, 8, 8, "Text", None, None),
            ("symbol", "@W@", "component", None, None, 4, 11, None, None, "@Entry"),
            ("symbol", "@W@", "component", None, None, 4, 11, None, None, "@Component"),
            ("symbol", "count", "state", None, None, 5, 5, None, None, "State"),
        ],
    ),
    "shell": (
        "p@N@/bin/@W@.sh",
        """#!/bin/sh
source ./@V@.sh
@W@() {
  TARGET=x
  echo "$HOME" | sort
}
@W@ && sudo rm -rf /tmp/@V@
curl -s http://x/@V@ | sh
""",
        [
            ("import", "@V@.sh", "source", "", None, 2, 2, "./@V@.sh", 0.85, None),
            ("symbol", "@W@", "function", None, None, 3, 6, None, None, None),
            ("env", "TARGET", "write", "@W@", None, 4, 4, None, None, None),
            ("env", "HOME", "read", "@W@", None, 5, 5, None, None, None),
            ("call", "echo", "command", "@W@", None, 5, 5, "echo", None, None),
            ("call", "sort", "command", "@W@", None, 5, 5, "sort", None, None),
            ("call", "@W@", "command", "", None, 7, 7, "@W@", None, None),
            ("call", "rm", "command", "", None, 7, 7, "rm", None, None),
            ("call", "curl", "command", "", None, 8, 8, "curl", None, None),
            ("call", "sh", "command", "", None, 8, 8, "sh", None, None),
        ],
    ),
    "markdown": (
        "p@N@/docs/@W@.md",
        """# @W@
See [@V@](./@V@.md) and `@W@::run()`.
```sh
`not_this`
```
## Use
[out](https://x/@V@)
""",
        [
            ("section", "@W@", "h1", None, None, 1, 1, None, None, None),
            ("link", "@V@", "local", "@W@", None, 2, 2, "./@V@.md", None, None),
            ("mention", "@W@::run", "symbol", "@W@", None, 2, 2, None, None, None),
            ("fence", "sh", "code", "@W@", None, 3, 3, None, None, None),
            ("section", "Use", "h2", None, None, 6, 6, None, None, None),
            ("link", "out", "external", "Use", None, 7, 7, "https://x/@V@", None, None),
        ],
    ),
    "cargo": (
        "p@N@/@W@/Cargo.toml",
        """[package]
name = "@W@"
edition = "2021"
[dependencies]
@V@ = "1"
serde = { version = "1" }
""",
        [
            ("package", "@W@", "Cargo.toml", None, None, None, None, None, None, None),
            ("dependency", "@V@", "dependencies", None, None, None, None, "1", None, None),
            ("dependency", "serde", "dependencies", None, None, None, None, "1", None, None),
        ],
    ),
    "package": (
        "p@N@/@W@/package.json",
        """{"name": "@W@", "dependencies": {"@V@": "1"}, "devDependencies": {"jest": "2"}}""",
        [
            ("package", "@W@", "package.json", None, None, None, None, None, None, None),
            ("dependency", "@V@", "dependencies", None, None, None, None, "1", None, None),
            ("dependency", "jest", "devDependencies", None, None, None, None, "2", None, None),
        ],
    ),
    "tsconfig": (
        "p@N@/@W@/tsconfig.json",
        """{
  // paths
  "compilerOptions": {"baseUrl": ".", "paths": {"@@V@/*": ["src/@V@/*"]}}
}""",
        [
            ("base-url", "tsconfig.json", "baseUrl", None, None, None, None, ".", None, None),
            ("mapping", "@@V@/*", "paths", None, None, 0, 0, "src/@V@/*", None, None),
        ],
    ),
    "cjpm": (
        "p@N@/@W@/cjpm.toml",
        """[package]
name = "@W@"
[dependencies]
@V@ = { path = "../@V@" }
""",
        [
            ("package", "@W@", "cjpm.toml", None, None, None, None, None, None, None),
            ("dependency", "@V@", "dependencies", None, None, None, None, "../@V@", 0.85, None),
        ],
    ),
    "commands": (
        "p@N@/@W@/compile_commands.json",
        """[{"directory": "/w", "file": "@W@.c", "command": "cc -Iinclude/@V@ -DX=1 -c @W@.c"}]""",
        [
            ("flag", "@W@.c", "-I", None, None, 0, 0, "include/@V@", None, None),
            ("flag", "@W@.c", "-D", None, None, 0, 0, "X=1", None, None),
        ],
    ),
}


def _sql(x) -> str:
    """A fact's value as SQL over the marks' columns w, v, n and vis."""
    if x is None:
        return "NULL"
    if x == "@VIS@":
        return "vis"
    if x == "@REX@":
        return "CASE WHEN vis = 'public' THEN 'reexport' END"
    text = "'" + x.replace("'", "''") + "'"
    for mark, col in (("@W@", "w"), ("@V@", "v"), ("@N@", "n")):
        text = f"replace({text}, '{mark}', {col})" if mark in x else text
    return text


_ROWS = "m AS (SELECT split_part(p_name, ' ', 1) || p_size AS w, split_part(p_name, ' ', 2) AS v, p_partkey::VARCHAR AS n, CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END AS vis, p_partkey % 3 AS down FROM part)"


def _facts_sql(kind: str, cols: str = "path, fact, name, kind, scope, visibility, line_start, line_end, target, confidence, detail") -> str:
    path, _, rows = SOURCES[kind]
    line = lambda x: "NULL" if x is None else str(x) if kind in _MANIFESTS else f"{x} + down"
    each = " UNION ALL ".join(f"SELECT {_sql(path)} AS path, '{f}' AS fact, {_sql(name)} AS name, {_sql(k)} AS kind, {_sql(scope)} AS scope, {_sql(vis)} AS visibility, {line(a)} AS line_start, {line(b)} AS line_end, {_sql(target)} AS target, {c if c is not None else 'NULL'}::DOUBLE AS confidence, {_sql(detail)} AS detail FROM m" for f, name, k, scope, vis, a, b, target, c, detail in rows)
    return f"SELECT {cols} FROM ({each})"


#: Their facts have no places, or places of their own.
_MANIFESTS = ["cargo", "package", "tsconfig", "cjpm", "commands"]


def _parts(spark, d):
    """All parts, dealt over tasks: each becomes many files, and their own table may be a single small one."""
    part = t.table(spark, d, "part")
    return part.repartition(max(1, -(-part.count() // 4000)))


def _files(spark, d, *kinds):
    """(path, text) of every part's files of some kinds."""
    w, v, n = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.col("p_size").cast("string")), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey").cast("string")
    public = F.col("p_size") % 2 == 0

    def fill(x: str, mark: str):
        out = F.lit(x)
        for m, col in (("@W@", w), ("@V@", v), ("@N@", n), ("@P@", F.when(public, mark).otherwise(""))):
            out = F.replace(out, F.lit(m), col)
        return out

    part = _parts(spark, d)
    row = lambda k: F.struct(fill(SOURCES[k][0], "").alias("path"), F.concat(F.repeat(F.lit("" if k in _MANIFESTS else "\n"), (F.col("p_partkey") % 3).cast("int")), fill(SOURCES[k][1], "pub " if k == "rust" else "export ")).alias("text"))
    return part.select(F.inline(F.array(*[row(k) for k in kinds])))


def _register(kind: str) -> None:
    @query(f"extract_{kind}", f"WITH {_ROWS} {_facts_sql(kind)}")
    def run(spark, d):
        return extract.facts(_files(spark, d, kind)).drop("language")


for _kind in SOURCES:
    _register(_kind)


# The graph of all Rust and JavaScript files: what they define, what holds it, calls that their own file or the standard library answers.
_GRAPH = " UNION ALL ".join(_facts_sql(k, "path, fact, name, kind, scope, line_start, line_end, target") for k in ("rust", "javascript"))


@query("source_graph", f"""WITH {_ROWS}, f AS ({_GRAPH}), s AS (SELECT path, name, kind, scope, line_start, line_end, 'symbol:' || path || CASE WHEN scope <> '' THEN '::' || scope ELSE '' END || '::' || name AS sid FROM f WHERE fact = 'symbol'),
y AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sid ORDER BY line_start) > 1 THEN sid || '::_L' || line_start ELSE sid END AS id FROM s),
h AS (SELECT a.id AS source, arg_min(b.id, b.line_end - b.line_start) AS target FROM y a JOIN y b ON a.path = b.path AND a.scope = b.name AND a.line_start >= b.line_start AND a.line_end <= b.line_end GROUP BY a.id),
c AS (SELECT a.id AS source, b.id AS target FROM y a JOIN y b ON a.path = b.path AND (a.name = 'main' AND a.kind = 'function' AND b.name IN ('build', 'clone') OR a.name = 'open' AND b.kind = 'function')),
o AS (SELECT y.id AS source, CASE f.target WHEN 'Some' THEN 'symbol:std::option::Option::Some' ELSE 'symbol:std::vec::Vec::new' END AS target FROM y JOIN f ON y.path = f.path AND y.name = 'build' AND f.fact = 'call' AND f.target IN ('Vec::new', 'Some')),
e AS (SELECT 'DEFINES' AS edge_type, 'file:' || path AS source, id AS target, 1.0::DOUBLE AS confidence FROM y UNION ALL SELECT 'HAS_PARENT', source, target, 1.0 FROM h UNION ALL SELECT 'CALLS', source, target, 0.85 FROM c UNION ALL SELECT 'CALLS', source, target, 0.8 FROM o),
n AS (SELECT DISTINCT 'file:' || path AS source, 'source-file' AS label, 'file' AS kind, split_part(path, '/', -1) AS name, path AS file, false AS is_external FROM f UNION ALL SELECT id, 'symbol', kind, name, path, false FROM y
 UNION ALL SELECT DISTINCT target, 'symbol', NULL, split_part(target, '::', -1), NULL, true FROM e ANTI JOIN y ON y.id = e.target WHERE edge_type = 'CALLS')
SELECT * FROM e UNION ALL BY NAME SELECT * FROM n""")
def source_graph(spark, d):
    """A row an edge, and a row a node: its id as source, without edge_type."""
    nodes, edges = tree.graph(_files(spark, d, "rust", "javascript"))
    return edges.unionByName(nodes.withColumnRenamed("id", "source"), allowMissingColumns=True)


# Module trees: a crate per part, whose declarations lead to a file, a folder, both, or nothing.
_CRATE = [("src/lib.rs", "mod a;\nmod b;\nmod both;\nmod gone;\n"), ("src/a.rs", "pub mod c;\n"), ("src/a/c.rs", "fn x() {}\n"), ("src/b/mod.rs", ""), ("src/both.rs", ""), ("src/both/mod.rs", ""), ("src/stray.rs", "")]


def _crates(spark, d):
    rows = F.array(*[F.struct(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(f"/{p}")).alias("path"), F.lit(x).alias("text")) for p, x in _CRATE])
    return _parts(spark, d).select(F.inline(rows))


@query("module_states", """WITH x(module, state, file, confidence) AS (VALUES ('crate', 'resolved', 'src/lib.rs', 0.9), ('crate::a', 'resolved', 'src/a.rs', 0.85), ('crate::b', 'resolved', 'src/b/mod.rs', 0.85), ('crate::both', 'ambiguous', NULL, 0), ('crate::gone', 'missing', NULL, 0.5), ('crate::a::c', 'resolved', 'src/a/c.rs', 0.8))
SELECT 'p' || p_partkey || '/src' AS root, module, state, 'p' || p_partkey || '/' || file AS file, confidence::DOUBLE AS confidence FROM part, x""")
def module_states(spark, d):
    files = _crates(spark, d)
    return tree.module_states(files, extract.facts(files))


@query("module_paths", """WITH x(file, module, confidence) AS (VALUES ('src/lib.rs', 'crate', 1.0), ('src/a.rs', 'crate::a', 0.85), ('src/a/c.rs', 'crate::a::c', 0.8), ('src/b/mod.rs', 'crate::b', 0.85), ('src/both.rs', 'crate::both', 0.85), ('src/both/mod.rs', 'crate::both', 0.85), ('src/stray.rs', 'crate', 0.5))
SELECT 'p' || p_partkey || '/' || file AS path, module, confidence::DOUBLE AS confidence FROM part, x""")
def module_paths(spark, d):
    files = _crates(spark, d)
    return tree.module_paths(files, extract.facts(files))


@query("source_ownership", """WITH f(file, named, n) AS (VALUES ('src/lib.rs', 'own', 0.9), ('src/bin/tool.rs', 'tool', 0.9), ('src/bin/deep/main.rs', 'deep', 0.9), ('src/util.rs', 'one', 0.9), ('', NULL, 0.3))
SELECT CASE WHEN file = '' THEN 'loose/x' || p_partkey || '.rs' ELSE 'p' || p_partkey || '/' || file END AS path, CASE WHEN file <> '' THEN 'pkg-' || p_partkey END AS package,
 CASE named WHEN 'own' THEN 'pkg_' || p_partkey WHEN 'one' THEN CASE WHEN p_size % 2 = 0 THEN 'only' END ELSE named END AS target, (CASE WHEN named = 'one' AND p_size % 2 = 1 THEN 0.5 ELSE n END)::DOUBLE AS confidence FROM part, f""")
def source_ownership(spark, d):
    k = F.col("p_partkey").cast("string")
    part, p = t.table(spark, d, "part"), F.concat(F.lit("p"), k)
    inside = [F.concat(p, F.lit("/" + x)) for x in ("src/lib.rs", "src/bin/tool.rs", "src/bin/deep/main.rs", "src/util.rs")]
    files = part.select(F.explode(F.array(*inside, F.concat(F.lit("loose/x"), k, F.lit(".rs")))).alias("path"))
    packages = part.select(p.alias("root"), F.concat(F.lit("pkg-"), k).alias("package"))
    targets = part.select(F.concat(F.lit("pkg-"), k).alias("package"), F.explode(F.when(F.col("p_size") % 2 == 0, F.array(F.lit("only"))).otherwise(F.array(F.lit("a"), F.lit("b")))).alias("target"))
    return tree.ownership(files, packages, targets)


# C++ calls by tier, from the calls of all parts' files and the functions that they define.
@query("cpp_call_tiers", f"""WITH {_ROWS}, f AS ({_facts_sql("cpp", "path, fact, name, kind, scope, line_start, target")}), q AS (SELECT DISTINCT CASE WHEN scope <> '' THEN scope || '::' ELSE '' END || name AS q FROM f WHERE fact = 'symbol' AND kind IN ('function', 'method')),
c AS (SELECT path, line_start AS line, kind, target AS name FROM f WHERE fact = 'call' UNION ALL SELECT path, line_start + 100, 'plain', name FROM f WHERE name IN ('run', 'helper2') UNION ALL SELECT path, line_start + 200, CASE WHEN kind = 'class' THEN 'this' ELSE 'receiver' END, CASE WHEN kind = 'class' THEN 'run' ELSE 'gone' END FROM f WHERE kind IN ('class', 'namespace')),
x AS (SELECT c.*, name IN (SELECT q FROM q) AS exact, split_part(name, '::', -1) IN (SELECT split_part(q, '::', -1) FROM q WHERE contains(q, '::')) AS suffix FROM c)
SELECT path, line, kind, name, (CASE kind WHEN 'plain' THEN CASE WHEN exact THEN 0.9 ELSE 0.6 END WHEN 'qualified' THEN CASE WHEN exact OR suffix THEN 0.8 ELSE 0.75 END WHEN 'template' THEN 0.4 WHEN 'this' THEN CASE WHEN exact OR suffix THEN 0.8 ELSE 0.45 END ELSE CASE WHEN exact OR suffix THEN 0.75 ELSE 0.45 END END)::DOUBLE AS confidence FROM x WHERE kind <> 'plain' OR exact OR suffix""")
def cpp_call_tiers(spark, d):
    f = extract.facts(_files(spark, d, "cpp"))
    names = f.filter("fact = 'symbol' and kind in ('function', 'method')").select(F.concat(F.when(F.col("scope") != "", F.concat("scope", F.lit("::"))).otherwise(""), "name").alias("qname"))
    found = f.filter("fact = 'call'").select("path", F.col("line_start").alias("line"), "kind", F.col("target").alias("name"))
    plain = f.filter(F.col("name").isin("run", "helper2")).select("path", (F.col("line_start") + 100).alias("line"), F.lit("plain").alias("kind"), "name")
    own = F.col("kind") == "class"
    member = f.filter(F.col("kind").isin("class", "namespace")).select("path", (F.col("line_start") + 200).alias("line"), F.when(own, "this").otherwise("receiver").alias("kind"), F.when(own, "run").otherwise("gone").alias("name"))
    return resolve.cpp_tiers(found.unionByName(plain).unionByName(member), names)


@query("shell_command_targets", f"""WITH {_ROWS}, f AS ({_facts_sql("shell", "path, fact, name, kind, scope, line_start, target")}), fn AS (SELECT name, min(struct_pack(p := path, i := 'symbol:' || path || '::' || name)) AS x FROM f WHERE fact = 'symbol' GROUP BY name)
SELECT path, line_start AS line, scope AS owner, f.name, coalesce(x.i, 'shell:command:' || f.name) AS target, CASE WHEN x IS NULL THEN 0.55 ELSE 0.8 END::DOUBLE AS confidence, CASE WHEN x IS NULL THEN 'external' ELSE 'function' END AS reason FROM f LEFT JOIN fn ON fn.name = f.name WHERE fact = 'call'""")
def shell_targets(spark, d):
    f = extract.facts(_files(spark, d, "shell"))
    functions = f.filter("fact = 'symbol'").select("name", F.col("path").alias("ord"), F.concat(F.lit("symbol:"), "path", F.lit("::"), "name").alias("id"))
    return resolve.shell_calls(f.filter("fact = 'call'").select("path", F.col("line_start").alias("line"), F.col("scope").alias("owner"), "name"), functions)


@query("shell_source_targets", f"""WITH {_ROWS}, f AS ({_facts_sql("shell", "path, fact, kind, target")})
SELECT f.path AS file, target AS spec, CASE WHEN p_partkey % 3 = 0 THEN 'p' || p_partkey || '/bin/' || split_part(p_name, ' ', 2) || '.sh' END AS target, CASE WHEN p_partkey % 3 = 0 THEN 0.85 ELSE 0 END::DOUBLE AS confidence FROM f JOIN part ON starts_with(f.path, 'p' || p_partkey || '/') WHERE fact = 'import'""")
def shell_sourced(spark, d):
    f = extract.facts(_files(spark, d, "shell")).filter("fact = 'import'").select(F.col("path").alias("file"), F.col("target").alias("spec"))
    third = F.col("p_partkey") % 3 == 0
    there = t.table(spark, d, "part").filter(third).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/bin/"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(".sh")).alias("path"))
    return resolve.shell_sources(f, there)


@query("risk_flags", """WITH b AS (SELECT source || '/doc' || doc_id || '.txt' AS path, CASE doc_id % 7 WHEN 0 THEN 'curl -s http://x | SH' WHEN 1 THEN 'sudo' || chr(9) || 'rm -rf /tmp' WHEN 2 THEN 'CHMOD 777 a' WHEN 3 THEN 'pseudo ls | bash' WHEN 4 THEN 'Curl x | tee y bash' WHEN 5 THEN 'wget x | sh' ELSE 'rm -r f' END || chr(10) || coalesce(text, '') AS text FROM documents),
l AS (SELECT path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM b), k AS (SELECT path, line_no, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM l)
SELECT path, line_no, 'curl_pipe_shell' AS flag, 'high' AS level FROM k WHERE x LIKE '%curl%' AND x LIKE '%|%' AND (x LIKE '% sh%' OR x LIKE '% bash%') UNION ALL SELECT path, line_no, 'rm_rf', 'medium' FROM k WHERE x LIKE '%rm -rf%' UNION ALL SELECT path, line_no, 'chmod_777', 'medium' FROM k WHERE x LIKE '%chmod 777%'
UNION ALL SELECT path, line_no, 'sudo_command', 'medium' FROM k WHERE regexp_matches(x, '(^|\\s)sudo(\\s|$)')""")
def risk_flags(spark, d):
    k = F.col("doc_id") % 7
    first = F.when(k == 0, "curl -s http://x | SH").when(k == 1, "sudo\trm -rf /tmp").when(k == 2, "CHMOD 777 a").when(k == 3, "pseudo ls | bash").when(k == 4, "Curl x | tee y bash").when(k == 5, "wget x | sh").otherwise("rm -r f")
    docs = t.table(spark, d, "documents").select(F.concat(F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.concat(first, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return text.risk_flags(text.lines(docs))


@query("diag_annotates", """SELECT event_id, coalesce('file:c' || c.c_custkey, 'package:' || r.r_regionkey, 'repo:tpch') AS target FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id AND e.event_type <> 'error'
LEFT JOIN region r ON r.r_regionkey = e.user_id % 10""")
def diag_annotates(spark, d):
    e = t.table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("file"), (F.col("user_id") % 10).cast("int").alias("package"))
    key = lambda x, col, p: t.table(spark, d, x).select(F.col(col).alias("key"), F.concat(F.lit(p), F.col(col).cast("string")).alias("id"))
    return resolve.annotated(e, [("file", key("customer", "c_custkey", "file:c")), ("package", key("region", "r_regionkey", "package:"))], "repo:tpch").select("event_id", "target")


@query("symbol_context_edges", f"""WITH {t.NODES_SQL}, {t.EDGES_SQL}, x AS (SELECT target AS id, 'in' AS dir, edge_type, confidence FROM edges UNION ALL SELECT source, 'out', edge_type, confidence FROM edges)
SELECT id, dir, edge_type, count(*) AS n, max(confidence) AS best FROM x WHERE id IN (SELECT id FROM nodes WHERE name LIKE 'red %') GROUP BY ALL""")
def symbol_context(spark, d):
    return reports.symbol_context(t.edges(spark, d), t.nodes(spark, d).filter("name like 'red %'"))


#: (needle, framework, role): dependency names that point to a framework.
_FRAMEWORKS = [("plate", "plate-web", "server"), ("widget", "widget-ui", "client"), ("red ring", "ring-orm", "storage")]


@query("framework_hints", f"""WITH f(needle, framework, role) AS (VALUES {", ".join(str(x) for x in _FRAMEWORKS)}) SELECT p_brand AS path, p_name AS name, 'dependencies' AS kind, min(framework) AS framework, min(struct_pack(framework := framework, role := role)).role AS role, CASE WHEN min(framework) IS NOT NULL THEN 0.88 END::DOUBLE AS confidence FROM part LEFT JOIN f ON contains(lower(p_name), needle) GROUP BY 1, 2""")
def framework_hints(spark, d):
    facts = t.table(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.lit("dependencies").alias("kind"), F.lit("dependency").alias("fact"))
    return reports.dependency_digest(facts, spark.createDataFrame(_FRAMEWORKS, "needle string, framework string, role string"))


@query("language_detect", """SELECT source AS root, CASE WHEN bool_or(lang = 'es') THEN 'rust' WHEN bool_or(lang = 'fr') THEN 'typescript' WHEN bool_or(lang = 'de') THEN 'python' ELSE 'shell' END AS language FROM documents GROUP BY source""")
def language_detect(spark, d):
    lang = F.col("lang")
    name = F.when(lang == "es", "Cargo.toml").when(lang == "fr", "tsconfig.json").when(lang == "de", "pyproject.toml").otherwise("x.sh")
    return reports.marker_language(t.table(spark, d, "documents").select(F.col("source").alias("root"), F.concat("source", F.lit("/"), name).alias("path")))


def _per_part(spark, d, rows: list[tuple], schema: str):
    """The rows once per part, with @ in their texts standing for its number."""
    names = [x.split()[0] for x in schema.split(", ")]
    n = F.col("p_partkey").cast("string")
    value = lambda x: F.replace(F.lit(x), F.lit("@"), n) if isinstance(x, str) else F.lit(x)
    kind = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    each = F.array(*[F.struct(*[value(x).cast(kind[c]).alias(c) for x, c in zip(r, names, strict=True)]) for r in rows])
    return _parts(spark, d).select(F.col("p_partkey").alias("n"), F.inline(each))


def _answers(rows: list[tuple]) -> str:
    """SQL of (n, ref, target, confidence, reason) with @ for the part's number."""
    text = lambda x: "NULL" if x is None else f"'{x}'"
    values = ", ".join(f"({r}, {text(a)}, {c}, '{why}')" for r, a, c, why in rows)
    return f"SELECT p_partkey * 100 + r AS ref, replace(a, '@', p_partkey::VARCHAR) AS target, c::DOUBLE AS confidence, why AS reason FROM part, (VALUES {values}) v(r, a, c, why)"


def _numbered(refs):
    return refs.withColumn("ref", F.col("n") * 100 + F.col("ref")).drop("n")


@query("ts_import_resolution", _answers([(1, "p@/src/app.ts", 0.9, "relative"), (2, "p@/src/lib/index.ts", 0.9, "relative"), (3, None, 0, "unresolved"), (4, "p@/src/util.d.ts", 0.85, "path-wildcard"), (5, None, 0, "unresolved"), (6, "p@/core/src/index.ts", 0.8, "workspace"), (7, "p@/core/src/io.ts", 0.75, "subpath"), (8, None, 0, "unresolved"), (9, "p@/src/app.ts", 0.9, "path-exact"), (10, "p@/src/lib/deep/index.tsx", 0.85, "path-wildcard"), (11, "p@/top.ts", 0.9, "relative")]))
def ts_imports(spark, d):
    main = "p@/src/main.ts"
    specs = ["./app", "./lib", "./gone", "~lib@/util", "~lib@/missing", "core@", "core@/io", "react", "exact@", "~lib@/deep/x", "../top"]
    refs = _numbered(_per_part(spark, d, [(k + 1, main, s) for k, s in enumerate(specs)], "ref int, file string, spec string"))
    files = _per_part(spark, d, [(f"p@/{x}",) for x in ("src/app.ts", "src/lib/index.ts", "src/util.d.ts", "core/src/index.ts", "core/src/io.ts", "src/lib/deep/index.tsx", "top.ts")], "path string")
    mappings = _per_part(spark, d, [("~lib@/*", "p@/src/*"), ("~lib@/deep/*", "p@/src/lib/deep"), ("exact@", "p@/src/app")], "pattern string, substitution string")
    return imports.resolve_ts(refs, files, mappings, _per_part(spark, d, [("core@", "p@/core")], "name string, root string"))


@query("include_resolution", _answers([(1, "src/a@.h", 0.95, "same-dir"), (2, "inc/b@.h", 0.85, "project-dir"), (3, "deep/x/only@.h", 0.6, "unique-basename"), (4, None, 0, "ambiguous"), (5, "inc/b@.h", 0.75, "angle"), (6, None, 0, "external"), (7, "top@.h", 0.85, "project-root"), (8, "q/c@.h", 0.9, "quote-dir"), (9, None, 0, "unresolved")]))
def include_resolution(spark, d):
    rows = [("a@.h", True), ("b@.h", True), ("only@.h", True), ("twice@.h", True), ("b@.h", False), ("stdio.h", False), ("top@.h", True), ("c@.h", True), ("gone@.h", True)]
    refs = _numbered(_per_part(spark, d, [(k + 1, "src/m@.c", name, quoted) for k, (name, quoted) in enumerate(rows)], "ref int, file string, name string, quoted boolean"))
    files = _per_part(spark, d, [(x,) for x in ("src/a@.h", "inc/b@.h", "deep/x/only@.h", "p/twice@.h", "r/twice@.h", "top@.h", "q/c@.h", "inc/c@.h")], "path string")
    return imports.resolve_includes(refs, files, quote_dirs=["q"], project_dirs=["inc"]).select("ref", "target", "confidence", "reason")


@query("python_import_resolution", _answers([(1, "pkg@/a.py", 0.9, "absolute"), (2, "pkg@/a.py", 0.85, "relative"), (3, "pkg@/__init__.py", 0.9, "absolute"), (4, "pkg@/sub/b.py", 0.75, "reexport"), (5, None, 0, "unresolved"), (6, "pkg@/__init__.py", 0.8, "package"), (7, "pkg@/a.py", 0.85, "relative")]))
def python_imports(spark, d):
    rows = [("main.py", "pkg@.a", 0, None), ("pkg@/c.py", "a", 1, None), ("main.py", "pkg@", 0, None), ("main.py", "pkg@.sub", 0, "b_name"), ("main.py", "nowhere", 0, None), ("main.py", "pkg@.zzz", 0, None), ("pkg@/sub/b.py", "a", 2, None)]
    refs = _numbered(_per_part(spark, d, [(k + 1, *r) for k, r in enumerate(rows)], "ref int, file string, module string, level int, name string"))
    files = _per_part(spark, d, [(x,) for x in ("pkg@/__init__.py", "pkg@/a.py", "pkg@/sub/__init__.py", "pkg@/sub/b.py")], "path string")
    reexports = _per_part(spark, d, [("pkg@/sub/__init__.py", "b_name", "pkg@/sub/b.py")], "init string, name string, path string")
    return imports.resolve_python(refs, files, reexports).select("ref", "target", "confidence", "reason")


@query("automation_graph", f"""WITH {_ROWS}, f AS ({_facts_sql("shell", "path, fact, name, kind, scope, line_start, target")}), p AS (SELECT DISTINCT path FROM f)
SELECT DISTINCT path, 'calls' AS kind, name AS target FROM f WHERE fact = 'call' UNION ALL SELECT DISTINCT path, 'sources', target FROM f WHERE fact = 'import' UNION ALL SELECT DISTINCT path, 'refers', target FROM f WHERE fact = 'import'
UNION ALL SELECT path, 'refers', '#!/bin/sh' FROM p UNION ALL SELECT path, 'risk', r FROM p, (VALUES ('rm_rf'), ('sudo_command'), ('curl_pipe_shell')) v(r)""")
def automation_graph(spark, d):
    files = _files(spark, d, "shell")
    return reports.automation_graph(files, extract.facts(files))


# Workspaces and configurations of each part: members by path and by star, configurations that extend others.
_TREE = [
    ("p@/Cargo.toml", '[workspace]\nmembers = ["one", "crates/*", "gone", "deep/**", "x/*/y"]\n'), ("p@/one/src/lib.rs", ""), ("p@/crates/a/Cargo.toml", '[package]\nname = "a@"\n'), ("p@/crates/b/src/lib.rs", ""), ("p@/crates/target/Cargo.toml", ""), ("p@/crates/c/Cargo.toml", ""), ("p@/deep/z/Cargo.toml", ""),
    ("p@/tsconfig.json", '{\n  "extends": "./base/tsconfig.base", // the parent\n  "compilerOptions": {"paths": {"a@/*": ["own/*"], "u": ["http://x/*y*/"]}, /* none */ "x": 1,}\n}'),
    ("p@/base/tsconfig.json", '{"extends": "../top/tsconfig.top.json", "compilerOptions": {"paths": {"a@/*": ["lost/*"], "b": ["b1", "b2"]}}}'),
    ("p@/top/tsconfig.top.json", '{"compilerOptions": {"baseUrl": "./src/.."}}'), ("p@/lone/tsconfig.json", '{"extends": "./nowhere"}'),
]


@query("workspace_members", """SELECT 'p' || p_partkey AS root, pattern, 'p' || p_partkey || '/' || d AS dir FROM part, (VALUES ('one', 'one'), ('crates/*', 'crates/a'), ('crates/*', 'crates/c')) v(pattern, d)""")
def workspace_members(spark, d):
    files = _per_part(spark, d, _TREE, "path string, text string").drop("n")
    return manifests.workspace_members(files, extract.facts(files))


@query("tsconfig_bases", """SELECT 'p' || p_partkey || '/' || f AS path, 'p' || p_partkey || '/top' AS base_url FROM part, (VALUES ('tsconfig.json'), ('base/tsconfig.json'), ('top/tsconfig.top.json')) v(f)""")
def tsconfig_bases(spark, d):
    fact = store(extract.facts(_per_part(spark, d, _TREE, "path string, text string").drop("n")))
    return manifests.config_bases(fact, manifests.config_chain(fact))


@query("tsconfig_mappings", """SELECT 'p' || p_partkey || '/' || f AS path, replace(k, '@', p_partkey::VARCHAR) AS pattern, x AS target FROM part, (VALUES ('tsconfig.json', 'a@/*', 'own/*'), ('tsconfig.json', 'u', 'http://x/*y*/'), ('tsconfig.json', 'b', 'b1'), ('tsconfig.json', 'b', 'b2'), ('base/tsconfig.json', 'a@/*', 'lost/*'), ('base/tsconfig.json', 'b', 'b1'), ('base/tsconfig.json', 'b', 'b2')) v(f, k, x)""")
def tsconfig_mappings(spark, d):
    fact = store(extract.facts(_per_part(spark, d, _TREE, "path string, text string").drop("n")))
    return manifests.config_mappings(fact, manifests.config_chain(fact))


@query("js_import_resolution", _answers([(1, "p@/src/a.js", 0.85, "extension"), (2, "p@/src/b.mjs", 0.9, "existing"), (3, "p@/src/lib", 0.9, "existing"), (4, None, 0, "unresolved"), (5, None, 0.5, "external"), (6, "p@/top.cjs", 0.85, "extension"), (7, "p@/src/x.y.js", 0.9, "existing"), (8, "p@/src/a.js", 0.85, "extension"), (9, "p@/src/b.mjs", 0.85, "extension")]))
def js_imports(spark, d):
    specs = ["./a", "./b.mjs", "./lib", "./gone", "react", "../top", "./x.y.js", "./a.ts", "./b"]
    refs = _numbered(_per_part(spark, d, [(k + 1, "p@/src/main.js", s) for k, s in enumerate(specs)], "ref int, file string, spec string"))
    return imports.resolve_js(refs, _per_part(spark, d, [(f"p@/{x}",) for x in ("src/a.js", "src/a.jsx", "src/b.mjs", "src/lib/index.js", "top.cjs", "src/x.y.js")], "path string"))
