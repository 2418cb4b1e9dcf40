import pytest
from pyspark.sql import functions as F

from plexigraph import model
from plexigraph.functions import paths
from plexigraph.operators import change, core, imports, resolve, scores, text, traverse, workspace


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "source string, target string, confidence double")


def ids(df, col="id"):
    return {r[col] for r in df.collect()}


def test_wildcard_disambiguates_equal_names(spark):
    symbols = spark.createDataFrame([("c::h", "helper_func", "function", "calculations", "p", "c.rs"), ("u::h", "helper_func", "function", "utils", "p", "u.rs"), ("u::p", "process", "function", "utils", "p", "u.rs")], "id string, name string, kind string, module string, package string, file string")
    calls = spark.createDataFrame([(1, "helper_func", "lib", "p", "lib.rs"), (2, "process", "lib", "p", "lib.rs"), (3, "gone", "lib", "p", "lib.rs")], "ref int, name string, module string, package string, file string")
    wild = spark.createDataFrame([("lib", "*", "calculations")], "module string, name string, target string")
    got = {r["ref"]: (r["target"], r["confidence"], r["reason"]) for r in resolve.call_cascade(calls, symbols, wild).collect()}
    assert got == {1: ("c::h", 0.80, "same-crate"), 2: ("u::p", 0.80, "same-crate"), 3: (None, 0.0, "unresolved")}
    none = {r["ref"]: r["target"] for r in resolve.call_cascade(calls, symbols, wild.limit(0)).collect()}
    assert none[1] is None and none[2] == "u::p"


def test_same_file_fallback(spark):
    symbols = spark.createDataFrame([("inner::compute", "compute", "function", "crate::inner", "p", "lib.rs")], "id string, name string, kind string, module string, package string, file string")
    calls = spark.createDataFrame([(1, "compute", "crate", "p", "lib.rs")], "ref int, name string, module string, package string, file string")
    none = spark.createDataFrame([], "module string, name string, target string")
    r = resolve.call_cascade(calls, symbols, none).first()
    assert (r["target"], r["confidence"], r["reason"]) == ("inner::compute", 0.70, "same-file-unique")


def test_blocking_stage_is_ambiguous(spark):
    refs = spark.createDataFrame([("r",)], "ref string")
    two = spark.createDataFrame([("r", "a"), ("r", "b")], "ref string, target string")
    one_ = spark.createDataFrame([("r", "z")], "ref string, target string")
    assert resolve.cascade(refs, [("x", 0.9, two, True), ("y", 0.5, one_, True)]).first()["reason"] == "ambiguous"
    assert resolve.cascade(refs, [("x", 0.9, two, False), ("y", 0.5, one_, True)]).first()["target"] == "z"


@pytest.fixture
def shop(spark):
    e = spark.createDataFrame([("workspace:root", "project:rust-core", "contains", 1.0), ("workspace:root", "project:web-ui", "contains", 1.0), ("workspace:root", "project:legacy-java", "contains", 1.0), ("project:web-ui", "project:rust-core", "depends_on", 0.85), ("project:rust-core", "project:legacy-java", "unsupported_boundary", 0.45)], "source string, target string, kind string, confidence double")
    p = spark.createDataFrame([("project:rust-core", True), ("project:web-ui", True), ("project:legacy-java", False)], "id string, supported boolean")
    return e, p


def test_workspace_impact(spark, shop):
    e, p = shop
    start = spark.createDataFrame([("project:rust-core",)], "id string")
    rows = workspace.impact_report(e, start, p, 3).collect()
    assert [(r["id"], r["depth"], r["confidence"], r["risk"]) for r in rows] == [("project:legacy-java", 1, model.WEAK_CAP, "high")]
    up = {r["id"]: (r["depth"], r["confidence"]) for r in traverse.workspace_impact(traverse.reverse(e), start, 3).collect()}
    assert up["project:web-ui"] == (1, 0.85) and up["workspace:root"][0] == 1


@pytest.mark.parametrize(("n", "u", "want"), [(10, False, "critical"), (1, True, "high"), (4, False, "high"), (2, False, "medium"), (1, False, "low"), (0, False, "none")])
def test_risk_ladder(spark, n, u, want):
    assert one(spark, scores.impact_risk(F.col("n"), F.lit(u)), n=n) == want


def test_bfs_on_a_cycle_with_the_best_bottleneck(spark):
    e = edges(spark, [("a", "b", 0.5), ("b", "a", 0.9), ("a", "c", 0.4), ("b", "d", 0.8), ("c", "d", 0.9), ("d", "e", 1)])
    got = {r["id"]: (r["depth"], r["confidence"]) for r in traverse.bfs(e, spark.createDataFrame([("a",)], "id string"), 4).collect()}
    assert got == {"a": (0, 1.0), "b": (1, 0.5), "c": (1, 0.4), "d": (2, 0.5), "e": (3, 0.5)}


def test_paths_are_simple(spark):
    e = edges(spark, [("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1)])
    assert ids(traverse.paths(e, spark.createDataFrame([("a",)], "id string"), 3), "path") == {"a>b>c", "a>b>c>d"}


def test_cycles(spark):
    e = edges(spark, [("b", "a", 1), ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("x", "x", 1)])
    assert [tuple(r) for r in traverse.two_cycles(e).collect()] == [("a", "b")]
    assert [tuple(r) for r in traverse.three_cycles(e).collect()] == [("a", "b", "c")]


def test_merge_is_independent_of_order(spark):
    parts = [spark.createDataFrame([(i, f"n{k}{i}") for i in range(k, k + 3)], "id int, name string") for k in range(3)]
    results = [sorted(tuple(r) for r in core.merge_artifacts([parts[k] for k in order], ["name"]).collect()) for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0))]
    assert results[0] == results[1] == results[2] and len(results[0]) == 5


def test_paging(spark):
    df = spark.range(25)
    pages = [core.page_slice(df, ["id"], p, 10).collect() for p in range(4)]
    assert [len(p) for p in pages] == [10, 10, 5, 0]
    assert [(p[0]["has_more"], p[0]["has_prev"], p[0]["total"]) for p in pages[:3]] == [(True, False, 25), (True, True, 25), (False, True, 25)]
    assert core.page_slice(df, ["id"], 0, 0).count() == 25


def test_gates_and_external_nodes(spark):
    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "id string").withColumn("label", F.lit("symbol"))
    e = spark.createDataFrame([("CALLS", "a", "std::x"), ("CALLS", "a", "std::x"), ("DEFINES", "z", "b")], "edge_type string, source string, target string")
    got = {r["gate"]: r["failures"] for r in core.quality_gates(nodes, e).collect()}
    assert got == {"duplicate_nodes": 1, "duplicate_edges": 1, "dangling_source": 1, "dangling_target": 2, "deterministic": 0, "calls_endpoint_integrity": 2, "external_symbol_marking": 0}
    assert [(r["id"], r["name"]) for r in core.external_nodes(nodes, e).collect()] == [("std::x", "x")]
    assert core.drop_dangling(nodes, e).count() == 0


def test_snapshots_and_plans(spark):
    s = lambda rows: spark.createDataFrame(rows, "path string, content_hash string")
    old = s([("a.rs", "1"), ("b.rs", "1")])
    plan = lambda new, **k: change.incremental_plan(change.snapshot_diff(old, s(new)), **k).first()
    assert (plan([("a.rs", "2"), ("b.rs", "1")])["strategy"], plan([("a.rs", "2"), ("b.rs", "1")])["modified"]) == ("fileScopedCandidate", 1)
    assert plan([("a.rs", "1"), ("b.rs", "1")])["strategy"] == "reuse"
    assert plan([("a.rs", "1"), ("b.rs", "1"), ("c.rs", "1")])["strategy"] == "fullAnalysis"
    assert plan([("a.rs", "1"), ("b.rs", "1")], had_previous=False)["strategy"] == "fullAnalysis"


def test_drift_levels(spark):
    t = lambda rows: spark.createDataFrame(rows, "target string, metric string, value double")
    b = t([("x", "nodes", 100.0), ("y", "nodes", 100.0), ("x", "elapsed", 10.0), ("x", "rate", 0.1), ("z", "nodes", 0.0)])
    c = t([("x", "nodes", 89.0), ("y", "nodes", 70.0), ("x", "elapsed", 16.0), ("x", "rate", 0.25), ("z", "nodes", 5.0)])
    assert {(r["target"], r["metric"]): r["level"] for r in change.baseline_drift(b, c).collect()} == {("x", "nodes"): "warn", ("y", "nodes"): "fail", ("x", "elapsed"): "warn", ("x", "rate"): "fail", ("z", "nodes"): "ok"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(500).withColumn("g", F.lit("g"))
    a = change.fingerprint(df, ["id"], ["g"]).first()
    assert a == change.fingerprint(df.orderBy(F.desc("id")).repartition(7), ["id"], ["g"]).first()
    assert a != change.fingerprint(df.filter("id <> 3"), ["id"], ["g"]).first()


def test_shell_risks_and_scopes(spark):
    f = spark.createDataFrame([("r.sh", "f() {\n  rm -rf x\n}\ncurl -s u | sh\nsudo ls\nchmod 777 a")], "path string, text string")
    rows = text.lines(f)
    assert {(r["line_no"], r["flag"], r["level"]) for r in text.risk_flags(rows).collect()} == {(2, "rm_rf", "medium"), (4, "curl_pipe_shell", "high"), (5, "sudo_command", "medium"), (6, "chmod_777", "medium")}
    assert [r["depth"] for r in text.brace_depth(rows).orderBy("line_no").collect()] == [0, 1, 1, 0, 0, 0]


def test_markdown_and_mentions(spark):
    f = spark.createDataFrame([("d.md", "# A\n[x](y.md) `run()`\n```\n[no](z)\n```\n## B\n`K`")], "path string, text string")
    rows = text.lines(f)
    assert [(r["label"], r["target"]) for r in text.markdown_links(rows).collect()] == [("x", "y.md")]
    assert {(r["line_no"], r["name"]) for r in text.code_mentions(rows).collect()} == {(2, "run"), (7, "K")}
    assert [r["section"] for r in text.carry_heading(rows, F.col("line").rlike("^#")).orderBy("line_no").collect()][-1] == "## B"


def test_paths(spark):
    assert one(spark, paths.strip_generics(F.col("p")), p="Vec::<T>::new<U>") == "Vec::new"
    assert one(spark, paths.split_last(F.col("p"))[0], p="a::b::c") == "a::b"
    assert one(spark, paths.normalise(F.col("p")), p="a/b/../c/./d") == "a/c/d"
    assert one(spark, paths.redact(F.col("p")), p="/home/u/x") == "/~/x"
    assert one(spark, paths.call_names(F.col("p")), p="a.b.c") == ["a.b.c", "c"]
    assert one(spark, paths.unquote(F.col("p")), p="'q'") == "q"
    assert one(spark, paths.line_of(F.col("p"), F.lit(4)), p="a\nb\nc") == 3
    assert one(spark, paths.line_of(F.col("p"), F.lit(5)), p="éé\nb\nc") == 2  # bytes, not characters
    assert one(spark, paths.normalise(F.col("p")), p="a/b/c/d/../../../../../x") == "../x"
    assert one(spark, paths.relative(F.col("p"), F.lit("/r")), p="/r/x") == "x"


def test_surface_rules(spark):
    cases = [("a.rs", "x", "Kotlin", "project", "unsupported"), ("a.rs", "x", "", "unsupported", "unsupported"), ("fixtures/a.rs", "x", "rust", "project", "fixture"), ("a\\Fixture\\b", "x", "rust", "project", "fixture"), ("a", "big-CORPUS", "rust", "project", "fixture"), ("x/tests/b.py", "x", "python", "project", "test"), ("x/__tests__/b", "x", "", "project", "test"), ("test/b", "x", "", "project", "production"), ("a", "web-test", "", "project", "test"), ("docs/a.md", "x", "", "project", "docs"), ("a.md", "x", "", "project", "production"), ("webui/a.ts", "x", "", "project", "webui"), ("x/scripts/run.sh", "x", "", "project", "script"), ("a.lock", "x", "", "project", "production")]
    df = spark.createDataFrame(cases, "p string, l string, g string, o string, want string")
    assert df.filter(change.surface(F.col("p"), F.col("l"), F.col("g"), F.col("o")) != F.col("want")).collect() == []


def test_impact_groups_and_policies(spark):
    cases = [("direct", "fixture", 0.1, False, "direct"), ("indirect", "production", 0.9, False, "unsupportedBoundary"), ("indirect", "unsupported", 0.9, True, "unsupportedBoundary"), ("indirect", "docs", 0.9, True, "fixtureOnly"), ("indirect", "test", 0.9, True, "fixtureOnly"), ("indirect", "webui", 0.65, True, "highConfidence"), ("indirect", "webui", 0.64, True, "lowConfidence")]
    df = spark.createDataFrame(cases, "t string, s string, c double, ok boolean, want string")
    g = change.impact_group(F.col("t"), F.col("s"), F.col("c"), F.col("ok"))
    assert df.filter(g != F.col("want")).collect() == []
    hidden = lambda **k: [r["want"] for r in df.filter(change.suppressed(F.col("t"), F.col("s"), F.col("want"), **k)).collect()]
    assert hidden() == ["fixtureOnly", "fixtureOnly", "lowConfidence"] and hidden(include_fixtures=True) == ["lowConfidence"] and hidden(strict=True) == []
    low = spark.createDataFrame([("indirect", "test", "lowConfidence")], "t string, s string, g string")
    assert low.filter(change.suppressed(F.col("t"), F.col("s"), F.col("g"), include_fixtures=True)).count() == 0


@pytest.mark.parametrize(("path", "status", "reason", "n"), [("src/lib.rs", "modified", "source-file-metadata-changed", 7), ("src/lib.rs", "removed", "tracked-file-removed", 8), ("Cargo.toml", "added", "manifest-or-config-metadata-changed", 6), ("setup.py", "added", "source-file-metadata-changed", 7), ("a/config/x", "added", "manifest-or-config-metadata-changed", 6), ("ci.yml", "modified", "manifest-or-config-metadata-changed", 6), ("README.md", "modified", "documentation-metadata-changed", 2), (".md", "modified", "tracked-file-metadata-changed", 3), ("bin/x", "modified", "tracked-file-metadata-changed", 3)])
def test_dirty_files(spark, path, status, reason, n):
    p, s = F.lit(path), F.lit(status)
    r = spark.range(1).select(change.dirty_reason(p, s).alias("r"), change.phases(p, s).alias("p")).first()
    assert r["r"] == reason and len(r["p"]) == n and ("graph" in r["p"]) == (reason != "documentation-metadata-changed")


def test_private_paths(spark):
    for path, want in {".claude": True, "./.claude/x": True, ".arts/x": True, ".sisyphus": True, "src/.claude/x": False, ".claudex": False, ".cache/x": False}.items():
        assert one(spark, change.private_path(F.col("p")), p=path) == want


def test_health_and_recommendations(spark):
    rows = [("a", "succeeded", 0, 0, 10, 30, 0, 60), ("b", "failed", 7, 6, 21, 0, 4, 5), ("c", "partial", 0, 0, 10, 9, 1, 5), ("d", "succeeded", 0, 0, 0, 0, 0, 0), ("e", "failed", 0, 0, 3, None, 0, 1), ("f", "succeeded", 1, 1, 10, 10, 0, 40)]
    df = spark.createDataFrame(rows, "project string, status string, gate_failures long, automation_risks long, source_files long, edges long, unsupported long, symbols long")
    scored = scores.health(df)
    assert {r["project"]: (r["score"], r["risk"]) for r in scored.collect()} == {"a": (100, "low"), "b": (0, "high"), "c": (65, "medium"), "d": (100, "low"), "e": (55, "high"), "f": (84, "medium")}
    got = {(r["list"], r["project"]): r["priority"] for r in scores.recommendations(scored).collect()}
    assert got == {("read", "a"): "P0", ("read", "f"): "P1", ("read", "d"): "P1", ("review", "b"): "P0", ("review", "e"): "P1", ("cleanup", "b"): "P1", ("cleanup", "c"): "P2"}
    empty = scores.overall_health(scored.limit(0)).first()
    assert (empty["overall"], empty["risk"], empty["projects"]) == (0, "unknown", 0)


def test_local_refs(spark):
    lines = ["  COPY src/a /dst", "COPY /abs x", "run ./scripts/x.sh; a/b, c/d\"'", "x http://h/p -o/p ${Y}/z a/b/c|", 'cd "ts-ui" && cd ../pkg;', "cd . cd /x cd $HOME"]
    rows = spark.createDataFrame([("f", k, x) for k, x in enumerate(lines)], "path string, line_no int, line string")
    assert ids(text.local_refs(rows), "ref") == {"src/a", "./scripts/x.sh", "c/d\"", "a/b/c", "ts-ui", "../pkg"}


def test_uses_of_every_kind(spark):
    uses = [(1, "crate::a::Foo", None, False, "crate::b"), (2, "self::Foo", None, False, "crate::a"), (3, "super::a::Foo", "F", False, "crate::b"), (4, "super::X", None, False, "crate"), (5, "std::io", None, False, "crate"), (6, "crate::a", None, False, "crate"), (7, "crate::a::*", None, False, "crate"), (8, "crate::a::Foo", "G", True, "crate"), (9, "crate::a::Two", None, False, "crate"), (10, "crate::a::Gone", None, False, "crate"), (11, "crate::a::Foo", "G", False, "crate")]
    u = spark.createDataFrame(uses, "ref int, path string, alias string, reexport boolean, module string").withColumn("package", F.lit("p"))
    m = spark.createDataFrame([("p", "crate", "lib.rs"), ("p", "crate::a", "a.rs")], "package string, module string, file string")
    s = spark.createDataFrame([("s1", "Foo", "crate::a", "p"), ("s2", "Two", "crate::a", "p"), ("s3", "Two", "crate::a", "p"), ("x", "Foo", "crate::a", "q")], "id string, name string, module string, package string")
    got = {r["ref"]: (r["level"], r["target"], r["confidence"], r["reason"]) for r in resolve.resolve_uses(u, m, s).collect()}
    assert got == {1: ("symbol", "s1", 0.9, "crate"), 2: ("symbol", "s1", 0.8, "self"), 3: ("symbol", "s1", 0.8, "super"), 4: ("unresolved", None, 0.0, "super-at-root"), 5: ("skipped", None, 0.0, "external"), 6: ("module", None, 0.85, "module"), 7: ("skipped", None, 0.0, "unresolved"), 8: ("symbol", "s1", 0.85, "reexport"), 9: ("unresolved", None, 0.0, "ambiguous"), 10: ("unresolved", None, 0.0, "unresolved"), 11: ("symbol", "s1", 0.85, "alias")}


def test_methods_by_name_trait_and_receiver(spark):
    calls = spark.createDataFrame([(1, "only", None), (2, "clone", "x"), (3, "push", "Vec<u8>"), (4, "twice", "Own"), (5, "gone", "Own"), (6, "trim", "&'static str"), (7, "twice", None)], "ref int, name string, receiver string")
    s = spark.createDataFrame([("m1", "only", "method"), ("m2", "twice", "method"), ("m3", "twice", "method"), ("m4", "clone", "method"), ("m5", "clone", "method")], "id string, name string, kind string")
    got = {r["ref"]: (r["target"], r["confidence"], r["reason"]) for r in resolve.method_cascade(calls, s).collect()}
    assert got == {1: ("m1", 0.65, "method-name"), 2: ("std::clone::Clone::clone", 0.55, "std-trait"), 3: ("std::vec::Vec::push", 0.65, "receiver-type"), 4: (None, 0.0, "ambiguous"), 5: (None, 0.0, "unresolved"), 6: ("str::trim", 0.65, "receiver-type"), 7: (None, 0.0, "ambiguous")}


def test_associated_functions(spark):
    s = spark.createDataFrame([("T", "T", "struct", "crate::a", "p", "a.rs", None), ("T::new", "new", "associated-function", "crate::a", "p", "a.rs", "T"), ("U::new", "new", "associated-function", "crate::a", "p", "a.rs", "U"), ("E", "E", "enum", "crate::c", "p", "c.rs", None), ("E::make", "make", "function", "crate::c", "p", "c.rs", None), ("D1", "D", "struct", "crate::c", "p", "c.rs", None), ("D2", "D", "struct", "crate::d", "p", "d.rs", None)], "id string, name string, kind string, module string, package string, file string, impl_target string")
    calls = [(1, "T::new", "crate::a", "a.rs"), (2, "T::new", "crate::b", "b.rs"), (3, "E::make", "crate::b", "b.rs"), (4, "Vec::new", "crate::b", "b.rs"), (5, "D::new", "crate::b", "b.rs"), (6, "Ext::open", "crate::b", "b.rs"), (7, "T::gone", "crate::a", "a.rs"), (8, "D::new", "crate::x", "c.rs")]
    c = spark.createDataFrame(calls, "ref int, path string, module string, file string").withColumn("package", F.lit("p"))
    i = spark.createDataFrame([("crate::b", "Ext", "ext::Ext<T>", True)], "module string, name string, target string, external boolean")
    got = {r["ref"]: (r["target"], r["confidence"], r["reason"]) for r in resolve.associated_cascade(c, s, i).collect()}
    assert got == {1: ("T::new", 0.75, "associated"), 2: ("T::new", 0.75, "associated"), 3: ("E::make", 0.70, "associated-any-kind"), 4: ("std::vec::Vec::new", 0.80, "std-path"), 5: (None, 0.0, "unresolved"), 6: ("ext::Ext::open", 0.80, "std-path"), 7: (None, 0.0, "unresolved"), 8: (None, 0.0, "unresolved")}


def test_owners_and_report(spark):
    files = spark.createDataFrame([("core/src/a.rs",), ("core/ui/b.ts",), ("Dockerfile.dev",), (".github/workflows/ci.yml",), ("run.sh",), ("other/x",), ("corex/y",)], "path string")
    projects = spark.createDataFrame([("core/", "core", "rust", True), ("core/ui", "ui", "go", False)], "path string, label string, language string, supported boolean")
    own = workspace.file_owners(files, projects)
    got = {r["path"]: (r["owner"], r["owner_kind"], r["confidence"]) for r in own.collect()}
    assert got == {"core/src/a.rs": ("project:core", "project", 1.0), "core/ui/b.ts": ("project:core:ui", "unsupported", 1.0), "Dockerfile.dev": ("config:Dockerfile.dev", "config", 0.9), ".github/workflows/ci.yml": ("workflow:.github:workflows:ci.yml", "config", 0.9), "run.sh": ("script:run.sh", "script", 0.9), "other/x": (None, "unknown", 0.0), "corex/y": (None, "unknown", 0.0)}
    root = projects.unionByName(spark.createDataFrame([(".", "all", "rust", True)], projects.schema))
    assert {r["path"]: r["confidence"] for r in workspace.file_owners(files, root).collect()}["other/x"] == 0.5
    nodes = spark.createDataFrame([("project:core", "project", "core", "core", "rust", True), ("project:app", "project", "app", "app", "rust", True), ("project:far", "project", "far-test", "far", "rust", True)], "id string, kind string, label string, path string, language string, supported boolean")
    e = spark.createDataFrame([("project:core", "project:app", "depends_on", 0.85), ("project:app", "project:far", "depends_on", 0.85)], "source string, target string, kind string, confidence double")
    hit = workspace.affected_projects(own, nodes, e)
    assert {r["id"]: (r["distance"], r["grp"], r["suppressed"]) for r in hit.collect()} == {"project:core": (0, "direct", False), "project:app": (1, "highConfidence", False), "project:far": (2, "fixtureOnly", True)}
    r = workspace.change_report(own, hit, 3).first()
    assert (r["raw"], r["reported"], r["suppressed"], r["high_confidence"], r["risk"]) == (3, 2, 1, 1, "high")


def test_numbered_is_a_total_order(spark):
    df = spark.range(0, 5000, 1, 7).select(F.lit(1).alias("score"), "id")
    rows = core.numbered(df, [F.desc("score"), F.asc("id")], "place").collect()
    assert sorted((r["id"], r["place"]) for r in rows) == [(k, k + 1) for k in range(5000)]


def test_baseline_reader(spark, tmp_path):
    from plexigraph.sources.tables import read_baseline

    (tmp_path / "b.json").write_text('{"budgets": {"warn": 10.0}, "targets": {"x": {"name": "X", "metrics": {"nodeCount": 5}, "qualityMetrics": {"rate": 0.5}, "elapsedSeconds": 3.5}, "y": {"metrics": {"nodeCount": 1}}}}')
    budgets, targets = read_baseline(spark, str(tmp_path / "b.json"))
    assert [tuple(r) for r in budgets.collect()] == [("warn", 10.0)]
    assert {tuple(r) for r in targets.collect()} == {("x", "nodeCount", 5.0), ("x", "rate", 0.5), ("x", "elapsedSeconds", 3.5), ("y", "nodeCount", 1.0)}


def test_dependency_edges(spark):
    deps = spark.createDataFrame([("a", "libs/b", 0.85), ("a", "apps", 0.85), ("a", "many", 0.85)], "source string, path string, confidence double")
    projects = spark.createDataFrame([("a", "a"), ("b", "libs/b"), ("c", "apps/c"), ("d", "many/d"), ("e", "many/e")], "id string, path string")
    assert {(r["target"], round(r["confidence"], 3)) for r in workspace.dependency_edges(deps, projects).collect()} == {("b", 0.85), ("c", 0.765)}


def test_missing_mapped_file_stops(spark):
    refs = spark.createDataFrame([(1, "a.ts", "core/x")], "ref int, file string, spec string")
    files = spark.createDataFrame([("packages/core/src/x.ts",)], "path string")
    packages = spark.createDataFrame([("core", "packages/core")], "name string, root string")
    mapped = spark.createDataFrame([("core/*", "nowhere/*")], "pattern string, substitution string")
    assert imports.resolve_ts(refs, files, mapped, packages).first()["target"] is None
    assert imports.resolve_ts(refs, files, mapped.limit(0), packages).first()["target"] == "packages/core/src/x.ts"


def test_confidence_constants(spark):
    assert model.confidence("call", "crate-path") == 0.90 and model.confidence("call", "module-path") == 0.85
    assert model.confidence_table(spark).count() == len(model.CONFIDENCE)
    assert model.severity_table(spark).count() == 4
