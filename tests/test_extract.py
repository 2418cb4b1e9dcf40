import pytest
from pyspark.sql import functions as F

from plexigraph.sources import extract, tree


def rows(path, text, fact=None):
    out = [dict(zip(extract.COLUMNS, r, strict=True)) for r in extract.extract(path, text)]
    return [r for r in out if fact is None or r["fact"] == fact]


RUST = """use crate::foo::{Bar, Baz as Q, deep::{self, *}};
pub use self::calc::run;
mod inner;
pub(crate) struct Calculator { value: i32 }
pub enum Kind {
    One,
    Two(i32),
}
impl Calculator {
    pub fn new() -> Calculator { Calculator { value: helper("}") } }
    fn get(&self) -> i32 { self.value.abs() }
}
impl Drop for Calculator {
    fn drop(&mut self) { println!("x"); crate::log::write(Some(1)); }
}
fn helper(s: &str) -> i32 { Calculator::new().get() }
"""


def test_rust_symbols():
    got = {(r["name"], r["kind"], r["scope"], r["visibility"]) for r in rows("a.rs", RUST, "symbol")}
    assert {("Calculator", "struct", "", "pub-crate"), ("new", "associated-function", "Calculator", "public"), ("get", "method", "Calculator", "private"), ("One", "enum-variant", "Kind", "public"), ("Two", "enum-variant", "Kind", "public"), ("helper", "function", "", "private"), ("inner", "module", "", "private"), ("drop", "method", "Calculator", "private")} <= got
    impls = [(r["name"], r["detail"]) for r in rows("a.rs", RUST, "symbol") if r["kind"] == "impl-block"]
    assert impls == [("Calculator", None), ("Calculator", "Drop")]


def test_rust_imports_expand_groups():
    got = [(r["name"], r["target"], r["kind"]) for r in rows("a.rs", RUST, "import")]
    assert got == [("Bar", "crate::foo::Bar", "crate"), ("Q", "crate::foo::Baz", "crate"), ("deep", "crate::foo::deep", "crate"), ("*", "crate::foo::deep::*", "crate"), ("run", "self::calc::run", "self")]


def test_rust_calls():
    got = {(r["name"], r["kind"]) for r in rows("a.rs", RUST, "call")}
    assert {("helper", "free-function"), ("new", "associated-function"), ("get", "method"), ("write", "qualified-path"), ("Some", "enum-constructor")} <= got
    assert not any(r["name"] == "println" for r in rows("a.rs", RUST, "call"))


def test_grouped_import():
    assert [(r["name"], r["target"]) for r in rows("lib.rs", "use crate::foo::{Bar, Baz};\n", "import")] == [("Bar", "crate::foo::Bar"), ("Baz", "crate::foo::Baz")]


def test_python_is_exact():
    src = "import os as o\nfrom . import x\nfrom a.b import *\nclass C:\n    def m(self):\n        self.k(f(1))\nN = 3\n"
    assert {(r["name"], r["kind"]) for r in rows("p.py", src, "symbol")} == {("C", "class"), ("m", "method"), ("N", "constant")}
    assert [(r["target"], r["confidence"]) for r in rows("p.py", src, "import")] == [("os", 0.85), (".", 0.70), ("a.b", 0.20)]
    assert {(r["name"], r["confidence"]) for r in rows("p.py", src, "call")} == {("k", 0.80), ("f", 0.90)}


def test_broken_file_is_an_error_row():
    assert [r["name"] for r in rows("bad.py", "def f(:\n")] == ["SyntaxError"]
    assert [r["fact"] for r in rows("package.json", "{")] == ["error"]


def test_typescript():
    src = "import { A as B, c } from './x';\nexport class K extends Z {\n  run(a: number): void {\n    helper(new Foo());\n  }\n}\nexport const go = async () => 1;\nconst y = require('y');\n"
    assert {(r["name"], r["kind"], r["visibility"]) for r in rows("k.ts", src, "symbol")} == {("K", "class", "public"), ("run", "method", "public"), ("go", "function", "public")}
    assert [(r["name"], r["kind"], r["target"]) for r in rows("k.ts", src, "import")] == [("B", "esm", "./x"), ("c", "esm", "./x"), ("y", "require", "y")]
    assert {("helper", "call"), ("Foo", "new-expression")} <= {(r["name"], r["kind"]) for r in rows("k.ts", src, "call")}


def test_c_and_cpp():
    src = '#include "a.h"\n#include <stdio.h>\n#define N 3\nstruct P { int x; };\nstatic int add(int a, int b) {\n  return mul(a, b);\n}\n'
    assert {(r["name"], r["kind"]) for r in rows("m.c", src, "symbol")} == {("N", "macro"), ("P", "struct"), ("add", "function")}
    assert [(r["target"], r["kind"]) for r in rows("m.c", src, "import")] == [("a.h", "quoted"), ("stdio.h", "angle")]
    assert [r["name"] for r in rows("m.c", src, "call")] == ["mul"]
    cpp = "namespace n {\nclass K {\n public:\n  int run() {\n    this->go();\n    o.step();\n    return n::f(1);\n  }\n};\n}\n"
    assert {(r["name"], r["kind"], r["scope"]) for r in rows("k.cpp", cpp, "symbol")} == {("n", "namespace", ""), ("K", "class", "n"), ("run", "method", "n::K")}
    assert {(r["name"], r["kind"]) for r in rows("k.cpp", cpp, "call")} == {("go", "this"), ("step", "receiver"), ("f", "qualified")}


def test_shell_scope_and_environment():
    src = "package_release() {\n  rm -rf ${DIST_DIR:-dist}\n  build_all | tee log\n}\nsource ./common.sh\nexport OUT=1\n"
    assert [r["name"] for r in rows("r.sh", src, "symbol")] == ["package_release"]
    assert {(r["name"], r["scope"]) for r in rows("r.sh", src, "call")} == {("rm", "package_release"), ("build_all", "package_release"), ("tee", "package_release")}
    assert {(r["name"], r["kind"]) for r in rows("r.sh", src, "env")} == {("DIST_DIR", "read"), ("OUT", "write")}
    assert [r["target"] for r in rows("r.sh", src, "import")] == ["./common.sh"]


def test_cangjie_arkts_markdown():
    cj = "package a.b\nimport std.io.*\nimport x.y as z\npublic class K {\n  func go() {\n    run(1)\n  }\n}\n"
    assert [(r["kind"], r["confidence"]) for r in rows("k.cj", cj, "import")] == [("wildcard", 0.70), ("alias", 0.80)]
    assert {("K", "class"), ("go", "method")} <= {(r["name"], r["kind"]) for r in rows("k.cj", cj, "symbol")}
    ets = "@Entry\n@Component\nstruct Page {\n  @State count: number = 0\n  build() {\n    Text('a')\n  }\n}\n"
    assert {("Page", "component"), ("count", "state")} <= {(r["name"], r["kind"]) for r in rows("p.ets", ets, "symbol")}
    md = "# T\n[a](b.md) and `f()`\n```\n[no](x)\n```\n"
    assert [(r["fact"], r["name"]) for r in rows("d.md", md)] == [("section", "T"), ("link", "a"), ("mention", "f"), ("fence", None)]


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("x/Cargo.toml", '[package]\nname = "p-q"\n[dependencies]\na = "1"\nb = { path = "../b" }\n[[bin]]\nname = "t"\n', {("package", "p-q"), ("dependency", "a"), ("dependency", "b"), ("target", "t")}),
        ("package.json", '{"name": "w", "workspaces": ["p/*"], "dependencies": {"r": "1"}, "main": "i.js"}', {("package", "w"), ("member", "p/*"), ("dependency", "r"), ("entry", "main")}),
        ("requirements.txt", "# c\nnumpy>=1\npandas\n", {("dependency", "numpy"), ("dependency", "pandas")}),
        ("tsconfig.json", '{"extends": "./b", "compilerOptions": {"paths": {"@l/*": ["src/*"],}}}', {("extends", "tsconfig.json"), ("mapping", "@l/*")}),
        ("compile_commands.json", '[{"file": "a.c", "command": "cc -Iinc -include pre.h a.c"}]', {("flag", "a.c")}),
        ("cjpm-tree.txt", "|- a\n|   |- b\n", {("dependency", "a"), ("dependency", "b")}),
    ],
)
def test_manifests(path, text, want):
    assert {(r["fact"], r["name"]) for r in rows(path, text)} == want


def test_tree_end_to_end(spark, tmp_path):
    root = tmp_path / "proj"
    for p, body in {"Cargo.toml": '[package]\nname = "my-app"\n', "src/lib.rs": "mod inner;\npub fn main_fn() {\n    compute();\n}\n", "src/inner.rs": "pub fn compute() {}\n", "target/x.rs": "fn no() {}\n", "src/bin/t.rs": "fn main() {}\n"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(body)
    files = tree.read_tree(spark, str(root)).cache()
    assert {r["path"] for r in files.collect()} == {"Cargo.toml", "src/lib.rs", "src/inner.rs", "src/bin/t.rs"}
    fact = extract.facts(files).cache()
    nodes, edges = tree.graph(files, fact)
    assert {(r["source"], r["target"], r["confidence"]) for r in edges.filter("edge_type = 'CALLS'").collect()} == {("symbol:src/lib.rs::main_fn", "symbol:src/inner.rs::compute", 0.55)}
    assert {(r["path"], r["module"], r["confidence"]) for r in tree.module_paths(files, fact).collect()} == {("src/lib.rs", "crate", 1.0), ("src/inner.rs", "crate::inner", 0.85), ("src/bin/t.rs", "crate", 0.5)}
    own = tree.ownership(files.select("path"), spark.createDataFrame([("", "my-app")], "root string, package string"), spark.createDataFrame([], "package string, target string"))
    assert {(r["path"], r["target"], r["confidence"]) for r in own.collect()} >= {("src/lib.rs", "my_app", 0.9), ("src/bin/t.rs", "t", 0.9), ("src/inner.rs", None, 0.5)}
    inv = {r["dir"]: r["language"] for r in tree.inventory(files).collect()}
    assert inv[""] is None and inv["src"] == "rust"
    assert tree.snapshot(files).filter(F.length("content_hash") == 64).count() == 4


def test_long_heads_are_read_to_their_ends():
    """A self after long generics, a self only in the body, and an impl header over many lines."""
    bounds = ",\n".join(f"        T{k}: Into<String> + Fn(u8) -> Option<u{8 * (k % 4 + 1)}>" for k in range(12))
    text = f"impl<\n{bounds}\n>\n    Shape\n    for\n    Circle<T0>\n    where T0: Copy\n{{\n    fn area<\n{bounds}\n    >(\n        &'a mut self,\n    ) {{}}\n    fn make(x: u8) -> Self {{ own(self_, (self)); x }}\n    fn by_box(self: Box<Self>) {{}}\n    fn none() {{ (self).x() }}\n}}\n"
    rows = [r for r in extract.rust("a.rs", text) if r[0] == "symbol"]
    kinds = {r[1]: r[2] for r in rows}
    assert {k: kinds[k] for k in ("area", "make", "by_box", "none")} == {"area": "method", "make": "associated-function", "by_box": "method", "none": "associated-function"}
    block = next(r for r in rows if r[2] == "impl-block")
    assert block[1] == "Circle" and block[9] == "Shape"
