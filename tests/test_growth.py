"""What holds at any size: sides that grow with the input meet by exchanges, however small Spark takes them for."""

import pytest

from plexigraph.operators import change, imports, resolve
from plexigraph.plans import catalog
from plexigraph.sources import extract, tree

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def gathered(spark, name):
    """How many sides of the query's joins go to the driver."""
    return plan(catalog.QUERIES[name](spark, SF)).count("BroadcastExchange")


def test_include_resolution_gathers_nothing(spark):
    assert gathered(spark, "include_resolution") == 0


def test_ts_import_resolution_gathers_one_row(spark):
    """The only side sent around is the row of characters that patterns end in."""
    assert gathered(spark, "ts_import_resolution") == 1


def test_ts_mappings_stop_and_rank_by_suffix(spark):
    """A mapping without a file stops before packages; of two substitutions the earlier suffix counts; patterns may end anywhere."""
    refs = spark.createDataFrame([(1, "a.ts", "@x/lost"), (2, "a.ts", "two"), (3, "a.ts", "pre-y"), (4, "a.ts", "@x"), (5, "a.ts", "./d")], "ref int, file string, spec string")
    files = spark.createDataFrame([("src/t.d.ts",), ("alt/t.ts",), ("lib/y.tsx",), ("r/index.ts",), ("r/index.ts",), ("d.d.ts",), ("d/index.ts",)], "path string")
    mappings = spark.createDataFrame([("@x/*", "none/*"), ("two", "src/t"), ("two", "alt/t"), ("pre-*", "lib/*"), ("pr*", "nope/*")], "pattern string, substitution string")
    packages = spark.createDataFrame([("@x", "r")], "name string, root string")
    got = {r["ref"]: (r["target"], r["reason"]) for r in imports.resolve_ts(refs, files, mappings, packages).collect()}
    assert got == {1: (None, "unresolved"), 2: ("alt/t.ts", "path-exact"), 3: ("lib/y.tsx", "path-wildcard"), 4: ("r/index.ts", "workspace"), 5: ("d.d.ts", "relative")}


@pytest.mark.parametrize("name", ["workspace_members", "tsconfig_bases", "tsconfig_mappings", "js_import_resolution"])
def test_sides_of_files_are_not_gathered(spark, name):
    assert gathered(spark, name) == 0


def test_facts_share_batches(spark):
    """Many small files and a large one lose no fact; null texts and empty ones have none."""
    files = spark.range(3000).selectExpr("concat('a', id, '.rs') AS path", "CASE WHEN id % 3 = 0 THEN 'mod x;' WHEN id % 3 = 1 THEN '' END AS text").coalesce(1)
    large = spark.createDataFrame([("b.rs", "mod y;\n" * 2500)], "path string, text string")
    assert extract.facts(files).count() == 1000 and extract.facts(large).filter("fact = 'symbol'").count() == 2500


def test_module_paths_gathers_nothing(spark):
    assert gathered(spark, "module_paths") == 0


def test_a_module_that_lib_and_main_declare_has_one_file(spark):
    files = spark.createDataFrame([("c/lib.rs", "mod a;"), ("c/main.rs", "mod a;"), ("c/a.rs", "")], "path string, text string")
    got = {(r["module"], r["state"], r["file"]) for r in tree.module_states(files, extract.facts(files)).collect()}
    assert ("crate::a", "resolved", "c/a.rs") in got and len(got) == 3


def test_source_graph_gathers_nothing(spark):
    assert gathered(spark, "source_graph") == 0


def test_a_name_of_many_files_costs_a_row_a_file(spark):
    """200 files that define and call one name, and one call of a function that is alone."""
    files = spark.range(200).selectExpr("concat('f', id, '.rs') AS path", "concat('fn build() {}\\nfn main', id, '() {\\n    build();\\n', if(id = 7, '    main9();\\n', ''), '}\\n') AS text")
    edges = tree.graph(files)[1].filter("edge_type = 'CALLS'")
    got = {(r["source"], r["target"], r["confidence"]) for r in edges.collect()}
    assert got == {(f"symbol:f{k}.rs::main{k}", f"symbol:f{k}.rs::build", 0.85) for k in range(200)} | {("symbol:f7.rs::main7", "symbol:f9.rs::main9", 0.55)}


def test_source_graph_holds_parents_and_externals(spark):
    """Parents by scope: impl before struct, inner before outer, an enum in a module, a body outside its class; calls that only the standard library answers, and their nodes."""
    rust = """use ext::Map;
use crate::own::Vec as Box;
struct T;
impl T {
    fn a() { Map::new(); Vec::new(); Box::new(); Ok(1); }
    fn b(&self) { std::mem::swap(x, y); v.clone(); v.push(1); gone(); }
}
mod m {
    mod m {
        fn f() { T::a(); }
    }
    enum K {
        One,
    }
    impl super::T {
        fn c() {}
    }
}
"""
    rows = [("a.rs", rust), ("a.py", "class C:\n    class D:\n        def f(self):\n            v.clone()\n"), ("a.js", "class B { B2() { x.clone(); } }\n"), ("a.cpp", "class P {\n  P() {}\n  int q();\n};\nint P::q() {\n}\nint Far::z() {\n}\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    nodes, edges = tree.graph(files)
    got = {(r["source"].removeprefix("symbol:"), r["target"].removeprefix("symbol:")) for r in edges.filter("edge_type = 'HAS_PARENT'").collect()}
    rs = {("a.rs::T::a", "a.rs::T::_L4"), ("a.rs::T::b", "a.rs::T::_L4"), ("a.rs::m::m", "a.rs::m"), ("a.rs::m::m::f", "a.rs::m::m"), ("a.rs::m::K", "a.rs::m"), ("a.rs::K::One", "a.rs::m::K"), ("a.rs::m::super::T", "a.rs::m"), ("a.rs::m::super::T::c", "a.rs::m::super::T")}
    other = {("a.py::C::D", "a.py::C"), ("a.py::C.D::f", "a.py::C::D"), ("a.js::B::B2", "a.js::B"), ("a.cpp::P::P", "a.cpp::P"), ("a.cpp::P::q", "a.cpp::P"), ("a.cpp::P::q::_L5", "a.cpp::P")}
    assert got == rs | other
    out = {(r["source"], r["target"], r["confidence"]) for r in edges.filter("edge_type = 'CALLS' and target not like 'symbol:a.%'").collect()}
    a, b = "symbol:a.rs::T::a", "symbol:a.rs::T::b"
    assert out == {(a, "symbol:ext::Map::new", 0.8), (a, "symbol:std::vec::Vec::new", 0.8), (a, "symbol:std::result::Result::Ok", 0.8), (b, "symbol:std::mem::swap", 0.8), (b, "symbol:std::clone::Clone::clone", 0.55)}
    assert {(r["id"], r["name"], r["kind"]) for r in nodes.filter("is_external").collect()} == {(t, t.split("::")[-1], None) for _, t, _ in out}
    ids = [r["id"] for r in nodes.collect()]
    assert len(ids) == len(set(ids)) and {x for r in edges.collect() for x in (r["source"], r["target"])} <= set(ids)


def test_enclosing_scope_gathers_nothing(spark):
    assert gathered(spark, "enclosing_scope") == 0


def test_changed_ranges_equals_pairs(spark):
    """Ids with several ranges, ranges and hunks that end before they start, repeated rows and nulls count as in the pairs."""
    ranges = spark.range(300).selectExpr("id % 280 AS id", "concat('f', id % 4) AS file", "id * 7 % 90 AS line_start", "id * 7 % 90 + id * 5 % 31 - 2 AS line_end").union(spark.sql("SELECT 500L, 'f1', NULL, 5L UNION ALL SELECT NULL, 'f1', 1L, 50L"))
    hunks = spark.range(400).selectExpr("id AS hunk", "concat('f', id % 5) AS file", "id * 13 % 100 AS new_start", "id * 13 % 100 + id % 6 - 1 AS new_end", "if(id % 2 = 0, 'added', 'deleted') AS change_kind")
    hunks = hunks.union(hunks.limit(50))
    pairs = change.changed_symbols(resolve.overlapping(hunks, ranges).select("hunk", "symbol", "change_kind").distinct())
    rows = lambda df: sorted(map(tuple, df.select("symbol", "hunks", "kinds").collect()), key=str)
    assert len(rows(pairs)) > 200 and rows(change.changed_ranges(hunks, ranges)) == rows(pairs)
