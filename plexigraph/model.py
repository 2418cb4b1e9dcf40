"""Closed vocabularies and constants of the graph model, kept in one place as lookup rows.

Values below are fixed: results must equal them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Node labels of the package graph, root first.
NODE_LABELS = ["repository", "workspace", "package", "target", "source-file", "module", "symbol", "diagnostic"]

#: Edge types of the package graph.
EDGE_TYPES = ["CONTAINS_WORKSPACE", "CONTAINS_PACKAGE", "HAS_TARGET", "OWNS_SOURCE", "RESOLVES_TO", "DEFINES", "HAS_PARENT", "ANNOTATES", "CALLS", "DESIGNATION", "ACCESSES"]

#: Severity names by rank; anything else ranks 0.
SEVERITY = [("critical", 4), ("high", 3), ("medium", 2), ("low", 1)]

#: Confidence by (family, reason).
CONFIDENCE = [
    ("call", "same-module", 0.90),
    ("call", "crate-path", 0.90),
    ("call", "import", 0.85),
    ("call", "module-path", 0.85),
    ("call", "std-path-indexed", 0.85),
    ("call", "std-path", 0.80),
    ("call", "self-super", 0.80),
    ("call", "same-crate", 0.80),
    ("call", "enum-constructor", 0.80),
    ("call", "associated", 0.75),
    ("call", "associated-any-kind", 0.70),
    ("call", "same-file-unique", 0.70),
    ("call", "method-name", 0.65),
    ("call", "receiver-type", 0.65),
    ("call", "external-crate", 0.60),
    ("call", "std-trait", 0.55),
    ("call", "unresolved", 0.0),
    ("import", "crate", 0.90),
    ("import", "alias", 0.85),
    ("import", "reexport", 0.85),
    ("import", "self", 0.80),
    ("import", "super", 0.80),
    ("import", "module-self-super", 0.75),
    ("ownership", "known-target", 0.90),
    ("ownership", "ambiguous", 0.50),
    ("ownership", "outside", 0.30),
    ("module", "root", 0.90),
    ("module", "depth-1", 0.85),
    ("module", "deeper", 0.80),
    ("module", "missing", 0.50),
    ("graph", "designation", 0.95),
    ("graph", "access", 0.85),
    ("ts-import", "relative", 0.90),
    ("ts-import", "path-exact", 0.90),
    ("ts-import", "path-wildcard", 0.85),
    ("ts-import", "workspace", 0.80),
    ("ts-import", "subpath", 0.75),
    ("ts-call", "imported", 0.88),
    ("ts-call", "same-file", 0.85),
    ("ts-call", "project-unique", 0.55),
    ("js-import", "existing", 0.90),
    ("js-import", "extension", 0.85),
    ("js-import", "index", 0.80),
    ("js-import", "external", 0.50),
    ("py-import", "absolute", 0.90),
    ("py-import", "relative", 0.85),
    ("py-import", "package", 0.80),
    ("py-import", "reexport", 0.75),
    ("c-include", "same-dir", 0.95),
    ("c-include", "quote-dir", 0.90),
    ("c-include", "project-dir", 0.85),
    ("c-include", "project-root", 0.85),
    ("c-include", "angle", 0.75),
    ("c-include", "forced", 0.70),
    ("c-include", "unique-basename", 0.60),
    ("shell", "function", 0.80),
    ("shell", "source", 0.85),
    ("shell", "external", 0.55),
    ("workspace", "contains", 1.0),
    ("workspace", "depends", 0.85),
    ("workspace", "tsconfig", 0.65),
    ("workspace", "reference", 0.75),
    ("workspace", "boundary", 0.45),
    ("workspace", "adjacent", 0.35),
    ("framework", "dependency", 0.88),
]

#: Cap on the confidence of weak relations met by a traversal, and their kinds.
WEAK_CAP = 0.40
WEAK_KINDS = ["adjacent_to", "unsupported_boundary"]

#: Lower bounds of edge-confidence tiers.
TIERS = [("high", 0.80), ("medium", 0.60)]


#: Types that need no import, and their paths.
PRELUDE_TYPES = {"Vec": "std::vec::Vec", "String": "std::string::String", "Box": "std::boxed::Box", "Option": "std::option::Option", "Result": "std::result::Result"}

#: Methods that one trait of the standard library alone has, and their paths.
TRAIT_METHODS = {"to_string": "std::string::ToString::to_string", "clone": "std::clone::Clone::clone", "collect": "std::iter::Iterator::collect"}

#: (type path, what a written type starts with, methods), tried in this order.
RECEIVER_TYPES = [
    ("std::vec::Vec", ["Vec"], ["push", "len", "is_empty", "pop", "contains", "get", "last", "first", "remove", "clear", "insert"]),
    ("std::string::String", ["String"], ["len", "is_empty", "push_str", "push", "remove", "contains", "replace", "as_str", "trim"]),
    ("str", ["&str", "&'static str", "str "], ["starts_with", "ends_with", "contains", "find", "replace", "trim", "trim_start", "trim_end", "split", "len", "is_empty"]),
    ("std::option::Option", ["Option"], ["unwrap", "unwrap_or", "is_some", "is_none", "map", "and_then"]),
    ("std::result::Result", ["Result"], ["unwrap", "unwrap_or", "is_ok", "is_err", "map", "map_err"]),
    ("std::collections::HashMap", ["HashMap"], ["len", "is_empty", "contains_key", "get", "insert", "remove", "clear"]),
    ("std::collections::HashSet", ["HashSet"], ["len", "is_empty", "contains", "insert", "remove", "clear", "get"]),
    ("std::collections::BTreeMap", ["BTreeMap"], ["len", "is_empty", "contains_key", "get", "insert", "remove", "clear"]),
    ("std::path::PathBuf", ["PathBuf"], ["as_path", "push", "pop", "exists", "is_dir", "is_file", "to_str", "display", "join", "parent", "file_name", "extension", "strip_prefix"]),
]

#: Constructors whose type is known.
CONSTRUCTORS = {"Vec::new": "Vec", "Vec::with_capacity": "Vec", "String::new": "String", "String::from": "String", "HashMap::new": "HashMap", "HashMap::with_capacity": "HashMap", "HashSet::new": "HashSet", "PathBuf::new": "PathBuf", "PathBuf::from": "PathBuf", "BTreeMap::new": "BTreeMap"}


def confidence(family: str, reason: str) -> float:
    return next(c for f, r, c in CONFIDENCE if (f, r) == (family, reason))


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEVERITY, "level string, rank int")


def confidence_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIDENCE, "family string, reason string, confidence double")
