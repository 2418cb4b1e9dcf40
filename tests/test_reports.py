from pyspark.sql import functions as F

from plexigraph.operators import reports, text
from plexigraph.plans import catalog
from plexigraph.sources import extract


def test_tools_name_known_queries():
    assert {q for _, names in reports.TOOLS for q in names.split()} - {"graph"} <= set(catalog.QUERIES)


def test_receiver_types_look_back(spark):
    src = "fn a(x: &mut Vec<u8>) {\n  x.push(1);\n  let y: String = make();\n  y.len();\n  let z = HashMap::new();\n  z.get();\n}\nfn b() {\n  y.len();\n}"
    lines = text.lines(spark.createDataFrame([("l.rs", src)], "path string, text string"))
    types = reports.receiver_types(lines, ["HashMap", "Vec"])
    calls = spark.createDataFrame([("l.rs", 1, 2, "x"), ("l.rs", 1, 4, "y"), ("l.rs", 1, 6, "z"), ("l.rs", 2, 9, "y")], "path string, scope long, line_no int, variable string")
    assert {(r["line_no"], r["variable"]): r["type"] for r in reports.receiver_of(calls, types).collect()} == {(2, "x"): "Vec", (4, "y"): "String", (6, "z"): "HashMap", (9, "y"): None}


def test_dependency_digest_and_reexports(spark):
    files = spark.createDataFrame([("w/package.json", '{"dependencies": {"react-dom": "1", "x": "2"}}'), ("p/__init__.py", "from .a import f as g\nfrom ..q import z\n")], "path string, text string")
    fact = extract.facts(files).cache()
    frameworks = spark.createDataFrame([("react", "React", "client")], "needle string, framework string, role string")
    got = {r["name"]: (r["framework"], r["confidence"]) for r in reports.dependency_digest(fact, frameworks).collect()}
    assert got == {"react-dom": ("React", 0.88), "x": (None, None)}
    assert [tuple(r) for r in reports.reexports(fact).collect()] == [("p/__init__.py", "g", "p/a.py")]


def test_bridge_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "symbol"), ("b", "symbol")], "id string, label string")
    edges = spark.createDataFrame([("CALLS", "a", "b", 0.5), ("DEFINES", "f", "a", 1.0)], "edge_type string, source string, target string, confidence double")
    reports.export_bridge(nodes, edges, str(tmp_path / "x"))
    n, e = reports.read_bridge(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, n.select(*nodes.columns).collect())) == sorted(map(tuple, nodes.collect()))
    assert sorted(map(tuple, e.select(*edges.columns).collect())) == sorted(map(tuple, edges.collect()))


def test_symbol_context_and_overview(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b", 0.5), ("CALLS", "c", "b", 0.7)], "edge_type string, source string, target string, confidence double")
    ctx = reports.symbol_context(edges, spark.createDataFrame([("b",)], "id string")).collect()
    assert [(r["dir"], r["n"], r["best"]) for r in ctx] == [("in", 2, 0.7)]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string").withColumn("label", F.lit("symbol"))
    row = reports.overview(nodes, edges).first()
    assert (row["node_count"], row["edge_count"], row["dangling_edge_count"]) == (2, 2, 1)
