"""Queries of the rule tables: surfaces, suppression, dirty files, health, owners, uses, receivers and calls by them."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph import model
from plexigraph.functions import paths
from plexigraph.operators import change, core, resolve, scores, text, workspace
from plexigraph.plans.change_queries import _PROJECTS, _SNAP, _WS, _projects, _snapshots, _workspace
from plexigraph.plans.registry import query
from plexigraph.plans.resolve_queries import _cascade_sql
from plexigraph.sources import tables as t

P = t.PARTS_SQL


# Dirty files: the snapshot's paths as they are, in a configuration folder, or a manifest's.
_DIRTY = f"""{_SNAP.replace('o_totalprice::BIGINT', 'round(o_totalprice)::BIGINT')}, d AS (SELECT status, CASE length(path) % 4 WHEN 0 THEN 'a/config/' || path || 'x' WHEN 1 THEN path WHEN 2 THEN 'pkg/Cargo.lock' ELSE path || '.yml' END AS path FROM diff WHERE status <> 'unchanged'),
k AS (SELECT CASE WHEN status = 'removed' THEN 'tracked-file-removed' WHEN regexp_matches(path, '.\\.(rs|py|sh|c|h)$') THEN 'source-file-metadata-changed' WHEN path LIKE '%Cargo.lock' OR path LIKE '%.yml' OR contains(path, '/config/') THEN 'manifest-or-config-metadata-changed'
 WHEN path LIKE '%.md' THEN 'documentation-metadata-changed' ELSE 'tracked-file-metadata-changed' END AS reason FROM d)"""


@query("dirty_phases", f"""WITH {_DIRTY}, c AS (SELECT reason, count(*) AS n FROM k GROUP BY reason),
p(reason, phases) AS (VALUES ('tracked-file-removed', ['discover', 'fingerprint', 'parse', 'symbols', 'imports', 'calls', 'diagnostics', 'graph']), ('source-file-metadata-changed', ['fingerprint', 'parse', 'symbols', 'imports', 'calls', 'diagnostics', 'graph']),
 ('manifest-or-config-metadata-changed', ['discover', 'fingerprint', 'imports', 'calls', 'diagnostics', 'graph']), ('documentation-metadata-changed', ['fingerprint', 'diagnostics']), ('tracked-file-metadata-changed', ['fingerprint', 'diagnostics', 'graph']))
SELECT reason, unnest(phases) AS phase, n FROM c JOIN p USING (reason)""")
def dirty_phases(spark, d):
    size = F.length("path") % 4
    path = F.when(size == 0, F.concat(F.lit("a/config/"), "path", F.lit("x"))).when(size == 1, F.col("path")).when(size == 2, "pkg/Cargo.lock").otherwise(F.concat("path", F.lit(".yml")))
    diff = change.snapshot_diff(*_snapshots(spark, d)).filter("status <> 'unchanged'").select("status", path.alias("path"))
    each = diff.select(change.dirty_reason(F.col("path"), F.col("status")).alias("reason"), F.explode(change.phases(F.col("path"), F.col("status"))).alias("phase"))
    return each.groupBy("reason", "phase").agg(F.count("*").alias("n"))


_FILES = """f AS (SELECT p_partkey AS id, CASE p_size % 9 WHEN 0 THEN 'src/a' || p_partkey || '.rs' WHEN 1 THEN 'Tests\\t' || p_partkey || '.rs' WHEN 2 THEN 'x/docs/d.md' WHEN 3 THEN 'fixtures/f.json' WHEN 4 THEN 'webui/w.ts' WHEN 5 THEN 'a/scripts/s.sh' WHEN 6 THEN 'a/__tests__/q.js' WHEN 7 THEN 'portable-smoke/x' ELSE 'lib/x.bin' END AS path,
 CASE WHEN p_partkey % 13 = 0 THEN 'Corpus' WHEN p_partkey % 17 = 0 THEN 'unit-Test' ELSE p_brand END AS label, CASE WHEN p_partkey % 11 = 0 THEN 'Go' ELSE 'rust' END AS language, p_partkey % 19 <> 0 AS supported, CASE WHEN p_size % 5 = 0 THEN 'direct' ELSE 'indirect' END AS change_type, p_size / 50.0 AS confidence FROM part)"""


def _files(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size") % 9
    own = F.when(s == 0, F.concat(F.lit("src/a"), k.cast("string"), F.lit(".rs"))).when(s == 1, F.concat(F.lit("Tests\\t"), k.cast("string"), F.lit(".rs")))
    path = own.when(s == 2, "x/docs/d.md").when(s == 3, "fixtures/f.json").when(s == 4, "webui/w.ts").when(s == 5, "a/scripts/s.sh").when(s == 6, "a/__tests__/q.js").when(s == 7, "portable-smoke/x").otherwise("lib/x.bin")
    label = F.when(k % 13 == 0, "Corpus").when(k % 17 == 0, "unit-Test").otherwise(F.col("p_brand"))
    return t.table(spark, d, "part").select(k.alias("id"), path.alias("path"), label.alias("label"), F.when(k % 11 == 0, "Go").otherwise("rust").alias("language"), (k % 19 != 0).alias("supported"), F.when(F.col("p_size") % 5 == 0, "direct").otherwise("indirect").alias("change_type"), (F.col("p_size") / 50.0).alias("confidence"))


def _surface_sql(path: str, label: str, language: str, supported: str) -> str:
    p = f"replace(lower({path}), chr(92), '/')"
    under = lambda x: f"(contains({p}, '/{x}/') OR starts_with({p}, '{x}/'))"
    return f"""CASE WHEN NOT {supported} OR lower({language}) IN ('csharp', 'java', 'go', 'swift', 'kotlin') THEN 'unsupported' WHEN {under('fixtures')} OR contains({p}, '/fixture/') OR contains({p}, 'portable-smoke') OR regexp_matches(lower({label}), 'fixture|smoke|corpus') THEN 'fixture'
 WHEN {under('tests')} OR contains({p}, '/__tests__/') OR contains({p}, '/test/') OR contains(lower({label}), 'test') THEN 'test' WHEN {under('docs')} THEN 'docs' WHEN {under('webui')} THEN 'webui' WHEN {under('scripts')} THEN 'script' ELSE 'production' END"""


_GROUP_SQL = "CASE WHEN change_type = 'direct' THEN 'direct' WHEN NOT supported OR surface = 'unsupported' THEN 'unsupportedBoundary' WHEN surface IN ('fixture', 'test', 'docs') THEN 'fixtureOnly' WHEN confidence >= 0.65 THEN 'highConfidence' ELSE 'lowConfidence' END"


@query("surface_groups", f"""WITH {_FILES}, s AS (SELECT *, {_surface_sql('path', 'label', 'language', 'supported')} AS surface FROM f), g AS (SELECT *, {_GROUP_SQL} AS grp FROM s)
SELECT surface, grp, count(*) AS strict, count(*) FILTER (grp NOT IN ('fixtureOnly', 'lowConfidence') OR change_type = 'direct') AS daily,
 count(*) FILTER (change_type = 'direct' OR surface IN ('fixture', 'test', 'docs') OR grp NOT IN ('fixtureOnly', 'lowConfidence')) AS with_fixtures FROM g GROUP BY surface, grp""")
def surface_groups(spark, d):
    c = F.col
    f = _files(spark, d).withColumn("surface", change.surface(c("path"), c("label"), c("language"), F.when(c("supported"), "project").otherwise("unsupported")))
    f = f.withColumn("grp", change.impact_group(c("change_type"), c("surface"), c("confidence"), c("supported")))
    shown = lambda **k: F.count_if(~change.suppressed(c("change_type"), c("surface"), c("grp"), **k))
    return f.groupBy("surface", "grp").agg(shown(strict=True).alias("strict"), shown().alias("daily"), shown(include_fixtures=True).alias("with_fixtures"))


@query("agent_private_paths", """WITH p AS (SELECT CASE p_size % 6 WHEN 0 THEN '.claude/' || p_partkey WHEN 1 THEN './.arts' WHEN 2 THEN 'src/.claude/x' WHEN 3 THEN '.sisyphus-x/y' WHEN 4 THEN '././.sisyphus/q' ELSE 'src/' || p_name END AS path FROM part)
SELECT path, count(*) AS n FROM p WHERE NOT regexp_matches(path, '^(\\./)*(\\.claude|\\.arts|\\.sisyphus)(/|$)') GROUP BY path""")
def agent_private(spark, d):
    s = F.col("p_size") % 6
    path = F.when(s == 0, F.concat(F.lit(".claude/"), F.col("p_partkey").cast("string"))).when(s == 1, "./.arts").when(s == 2, "src/.claude/x").when(s == 3, ".sisyphus-x/y").when(s == 4, "././.sisyphus/q").otherwise(F.concat(F.lit("src/"), "p_name"))
    p = t.table(spark, d, "part").select(path.alias("path"))
    return p.filter(~change.private_path(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query("path_roles", f"""WITH {_FILES}, p AS (SELECT CASE WHEN id % 3 = 0 THEN upper(path) WHEN id % 7 = 0 THEN 'a/README' WHEN id % 5 = 0 THEN 'x_test.go' ELSE path END AS path FROM f)
SELECT path, count(*) AS n, regexp_matches(lower(path), '\\.md|\\.rst|\\.txt|doc/|docs/|readme') AS doc, regexp_matches(lower(path), 'test_|_test\\.|tests/|spec\\.|mock\\.|fixture') AS test FROM p GROUP BY path""")
def path_roles(spark, d):
    k = F.col("id")
    p = _files(spark, d).select(F.when(k % 3 == 0, F.upper("path")).when(k % 7 == 0, "a/README").when(k % 5 == 0, "x_test.go").otherwise(F.col("path")).alias("path"))
    return p.groupBy("path").agg(F.count("*").alias("n")).select("path", "n", text.path_roles(F.col("path")).alias("r")).select("path", "n", "r.doc", "r.test")


_HEALTH = """pr AS (SELECT p_brand AS project, CASE WHEN min(p_size) > 1 THEN 'succeeded' WHEN count(*) % 2 = 0 THEN 'partial' ELSE 'failed' END AS status, count(*) FILTER (p_size > 48) AS gate_failures, count(*) FILTER (p_retailprice > 1090) AS automation_risks,
 count(*) AS source_files, CASE WHEN min(p_partkey) % 3 = 0 THEN NULL WHEN min(p_partkey) % 3 = 1 THEN count(*) FILTER (p_size > 20) ELSE 3 * count(*) END AS edges, count(*) FILTER (p_size = 13) AS unsupported, count(*) * (1 + min(p_partkey) % 4) AS symbols FROM part GROUP BY p_brand),
h AS (SELECT *, greatest(0, 100 - CASE status WHEN 'failed' THEN 35 WHEN 'succeeded' THEN 0 ELSE 20 END - least(8 * gate_failures, 50) - least(8 * automation_risks, 40)
 - CASE WHEN source_files > 20 AND coalesce(edges, 0) = 0 THEN 15 WHEN edges > 0 AND edges / source_files < 1 THEN 10 ELSE 0 END - CASE WHEN coalesce(edges, 0) = 0 THEN 10 ELSE 0 END - least(5 * unsupported, 15))::BIGINT AS score FROM pr)"""


def _health(spark, d):
    k = F.min("p_partkey")
    p = t.table(spark, d, "part").groupBy(F.col("p_brand").alias("project")).agg(
        F.when(F.min("p_size") > 1, "succeeded").when(F.count("*") % 2 == 0, "partial").otherwise("failed").alias("status"),
        F.count_if(F.col("p_size") > 48).alias("gate_failures"),
        F.count_if(F.col("p_retailprice") > 1090).alias("automation_risks"),
        F.count("*").alias("source_files"),
        F.when(k % 3 == 0, None).when(k % 3 == 1, F.count_if(F.col("p_size") > 20)).otherwise(3 * F.count("*")).alias("edges"),
        F.count_if(F.col("p_size") == 13).alias("unsupported"),
        (F.count("*") * (1 + k % 4)).alias("symbols"),
    )
    return scores.health(p)


@query("health_scores", f"WITH {_HEALTH} SELECT project, score, CASE WHEN score >= 85 THEN 'low' WHEN score >= 65 THEN 'medium' ELSE 'high' END AS risk FROM h")
def health_scores(spark, d):
    return _health(spark, d).select("project", "score", "risk")


@query("health_overall", f"WITH {_HEALTH}, o AS (SELECT round_even(sum(score * symbols) / sum(symbols), 0)::BIGINT AS overall, count(*) AS projects FROM h) SELECT overall, CASE WHEN overall >= 85 THEN 'low' WHEN overall >= 65 THEN 'medium' ELSE 'high' END AS risk, projects FROM o")
def health_overall(spark, d):
    return scores.overall_health(_health(spark, d))


@query("recommendations", f"""WITH {_HEALTH} SELECT * FROM (SELECT 'read' AS list, project, CASE WHEN symbols > 50 THEN 'P0' ELSE 'P1' END AS priority, -symbols AS rank FROM h WHERE status = 'succeeded' ORDER BY symbols DESC, project LIMIT 5)
UNION ALL SELECT 'review', project, CASE WHEN score < 50 THEN 'P0' WHEN score < 65 THEN 'P1' ELSE 'P0' END, score FROM h WHERE score < 65 OR status = 'failed'
UNION ALL SELECT 'cleanup', project, CASE WHEN source_files > 20 AND coalesce(edges, 0) = 0 THEN 'P1' ELSE 'P2' END, 0 FROM h WHERE source_files > 20 AND coalesce(edges, 0) = 0 OR unsupported > 0""")
def recommendations(spark, d):
    return scores.recommendations(_health(spark, d))


# Local references of a text made of each document's columns and its whole text.
_BODY = "concat('  COPY ', source, '/', lang, ' ./d', doc_id % 7, '/x.txt', chr(10), 'cd \"', lang, '-ui\" && ./run/', doc_id % 11, '\";', chr(10), 'see http://a.example/b and/or, ${x}/y -v/z /abs/p a/b cd ..', chr(10), coalesce(text, ''))"
_TAIL = """,*''*"*\\|*&*;*$"""


@query("local_refs", f"""WITH l AS (SELECT source, unnest(string_split({_BODY}, chr(10))) AS line FROM documents),
w AS (SELECT source, regexp_matches(line, '^\\s*COPY ') AS copy, list_filter(regexp_split_to_array(line, '[\\s\\x0B\\x85\\p{{Z}}]+'), lambda x: x <> '') AS ws FROM l WHERE regexp_matches(line, '/|(^|\\s)cd\\s')),
r AS (SELECT source, ws[2] AS ref FROM w WHERE copy AND len(ws) > 1 AND ws[2] NOT LIKE '/%' AND ws[2] NOT LIKE '%:%' AND ws[2] LIKE '%/%'
UNION SELECT source, ref FROM (SELECT source, regexp_replace(unnest(ws), '{_TAIL}', '') AS ref FROM w) WHERE ref LIKE '%/%' AND ref NOT LIKE '/%' AND ref NOT LIKE '-%' AND ref NOT LIKE '%:%' AND NOT contains(ref, '${{') AND strlen(ref) > 3
UNION SELECT source, ref FROM (SELECT source, regexp_replace(trim(trim(ws[i + 1], '"'), ''''), '\\|*&*;*$', '') AS ref FROM (SELECT source, ws, unnest(range(1, len(ws))) AS i FROM w) WHERE ws[i] = 'cd') WHERE ref NOT IN ('', '.', '..') AND ref NOT LIKE '/%' AND ref NOT LIKE '-%' AND NOT contains(ref, '$'))
SELECT source AS path, ref FROM r""")
def local_refs(spark, d):
    k = lambda m: (F.col("doc_id") % m).cast("string")
    body = F.concat(F.lit("  COPY "), "source", F.lit("/"), "lang", F.lit(" ./d"), k(7), F.lit('/x.txt\ncd "'), "lang", F.lit('-ui" && ./run/'), k(11), F.lit('";\nsee http://a.example/b and/or, ${x}/y -v/z /abs/p a/b cd ..\n'), F.coalesce("text", F.lit("")))
    return text.local_refs(text.lines(t.table(spark, d, "documents").select(F.col("source").alias("path"), body.alias("text"))))


# Method calls: names and receivers that the standard tables know among those of the parts.
_METHOD = "CASE id % 9 WHEN 0 THEN 'to_string' WHEN 1 THEN 'push' WHEN 2 THEN 'len' WHEN 3 THEN 'clone' WHEN 4 THEN 'only' || id ELSE name END"
_RECEIVER = "CASE id % 5 WHEN 0 THEN 'Vec<i32>' WHEN 1 THEN 'String' WHEN 2 THEN '&str' WHEN 3 THEN 'PathBuf' ELSE module END"
_TABLES = "rt(rank, path, mark, method) AS (VALUES " + ", ".join(f"({k}, '{p}', '{m.replace(chr(39), chr(39) * 2)}', '{x}')" for k, (p, marks, methods) in enumerate(model.RECEIVER_TYPES) for m in marks for x in methods) + ")"


def _methods(spark, d):
    k = F.col("id") % 9
    name = F.when(k == 0, "to_string").when(k == 1, "push").when(k == 2, "len").when(k == 3, "clone").when(k == 4, F.concat(F.lit("only"), F.col("id").cast("string"))).otherwise(F.col("name"))
    r = F.col("id") % 5
    receiver = F.when(r == 0, "Vec<i32>").when(r == 1, "String").when(r == 2, "&str").when(r == 3, "PathBuf").otherwise(F.col("module"))
    return t.parts(spark, d).withColumn("called", name).withColumn("receiver", receiver)


@query("method_unique_or_nothing", f"""WITH {P}, {_TABLES}, m AS (SELECT id, kind, {_METHOD} AS called, {_RECEIVER} AS receiver FROM parts), refs AS (SELECT id AS ref, called AS name, receiver FROM m),
k AS (SELECT 'part' || id AS target, called AS name FROM m WHERE kind = 'method' AND called NOT IN ('to_string', 'len')),
c1 AS (SELECT ref, target FROM refs JOIN k USING (name)),
c2 AS (SELECT ref, p AS target FROM refs JOIN (VALUES ('to_string', 'std::string::ToString::to_string'), ('clone', 'std::clone::Clone::clone'), ('collect', 'std::iter::Iterator::collect')) t(n, p) ON n = name),
c3 AS (SELECT ref, path || '::' || name AS target FROM refs JOIN rt ON method = name AND (starts_with(receiver, mark) OR receiver = trim(mark)) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank) = 1),
{_cascade_sql([("method-name", 0.65, "c1", False), ("std-trait", 0.55, "c2", False), ("receiver-type", 0.65, "c3", False), ("method-name", 0.65, "c1", True)])}""")
def method_unique(spark, d):
    m = _methods(spark, d)
    symbols = m.filter(~F.col("called").isin("to_string", "len")).select(F.concat(F.lit("part"), F.col("id").cast("string")).alias("id"), F.col("called").alias("name"), "kind")
    return resolve.method_cascade(m.select(F.col("id").alias("ref"), F.col("called").alias("name"), "receiver"), symbols).select("ref", "target", "confidence", "reason")


# Associated calls: structs are named by a part's first word and lie in modules, methods by its second.
_ASSOC = f"""{P}, s AS (SELECT 'part' || id AS id, CASE WHEN kind = 'struct' THEN split_part(name, ' ', 1) || id % 29 ELSE split_part(name, ' ', 2) || id % 3 END AS name, kind, module || '/' || id % 4 AS module, package, file || id % 4 AS file, CASE WHEN kind IN ('method', 'associated-function') AND visibility = 'private' THEN split_part(name, ' ', 1) || id % 29 END AS impl_target FROM parts),
r AS (SELECT id AS ref, module || '/' || id % 4 AS own, package, file || id % 4 AS file, CASE id % 5 WHEN 0 THEN module || '/' || (id + 1) % 4 ELSE module || '/' || id % 4 END AS loc, CASE WHEN id % 31 = 0 THEN 'Vec' WHEN id % 37 = 0 THEN 'Gone' ELSE split_part(name, ' ', 1) || (id * 7) % 29 END AS type, split_part(name, ' ', 2) || id % 3 AS method, id % 5 AS k FROM parts),
i AS (SELECT module || '/' || id % 4 AS module, split_part(name, ' ', 1) || (id * 7) % 29 AS name, id % 6 = 0 AS external, CASE WHEN id % 6 = 0 THEN 'ext::' || split_part(name, ' ', 1) || '<T>' ELSE 'part' || (id + 4) % (SELECT count(*) FROM part) END AS target FROM parts WHERE kind <> 'method')"""


@query("assoc_fn", f"""WITH {_ASSOC}, same AS (SELECT DISTINCT module AS loc, name AS type, true AS here FROM s), b AS (SELECT i.module AS loc, i.name AS type, min(target) AS id FROM i WHERE NOT external GROUP BY 1, 2 HAVING count(*) = 1), bound AS (SELECT b.loc, b.type, s.module AS bound FROM b JOIN s USING (id)),
ex AS (SELECT module AS loc, name AS type, min(target) AS p FROM i WHERE external GROUP BY 1, 2), ty AS (SELECT ref, count(*) AS n, min(module) AS m FROM r JOIN s ON s.package = r.package AND s.name = r.type AND s.kind IN ('struct', 'enum') AND s.file <> r.file GROUP BY ref),
m AS (SELECT r.*, ex.p, CASE WHEN here THEN r.loc ELSE coalesce(bound, CASE WHEN ty.n = 1 THEN ty.m END) END AS mod FROM r LEFT JOIN same USING (loc, type) LEFT JOIN bound USING (loc, type) LEFT JOIN ex USING (loc, type) LEFT JOIN ty USING (ref)),
c AS (SELECT m.ref, count(*) AS every, min(s.id) AS any_id, count(*) FILTER ((kind IN ('method', 'associated-function') OR impl_target IS NOT NULL) AND coalesce(impl_target, type) = type) AS n, min(s.id) FILTER ((kind IN ('method', 'associated-function') OR impl_target IS NOT NULL) AND coalesce(impl_target, type) = type) AS id FROM m JOIN s ON s.module = m.mod AND s.name = m.method GROUP BY m.ref),
x AS (SELECT m.ref, m.mod, coalesce(c.n, 0) AS n, coalesce(c.every, 0) AS every, c.id, c.any_id, CASE WHEN mod IS NULL THEN coalesce(replace(p, '<T>', ''), CASE WHEN type = 'Vec' THEN 'std::vec::Vec' END) || '::' || method END AS path FROM m LEFT JOIN c USING (ref))
SELECT ref, CASE WHEN n = 1 THEN id WHEN n = 0 AND every = 1 THEN any_id ELSE path END AS target, (CASE WHEN n = 1 THEN 0.75 WHEN n = 0 AND every = 1 THEN 0.7 WHEN path IS NOT NULL THEN 0.8 ELSE 0 END)::DOUBLE AS confidence,
 CASE WHEN n = 1 THEN 'associated' WHEN n = 0 AND every = 1 THEN 'associated-any-kind' WHEN path IS NOT NULL THEN 'std-path' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS reason FROM x""")
def assoc_fn(spark, d):
    k, text_ = F.col("id"), lambda x: x.cast("string")
    w1, w2 = (F.split_part("name", F.lit(" "), F.lit(i)) for i in (1, 2))
    p = t.parts(spark, d)
    n = t.table(spark, d, "part").agg(F.count("*").alias("__n"))
    module = F.concat("module", F.lit("/"), text_(k % 4))
    file = F.concat("file", text_(k % 4))
    s = p.select(F.concat(F.lit("part"), text_(k)).alias("id"), F.when(F.col("kind") == "struct", F.concat(w1, text_(k % 29))).otherwise(F.concat(w2, text_(k % 3))).alias("name"), "kind", module.alias("module"), "package", file.alias("file"), F.when(F.col("kind").isin("method", "associated-function") & (F.col("visibility") == "private"), F.concat(w1, text_(k % 29))).alias("impl_target"))
    type_ = F.when(k % 31 == 0, "Vec").when(k % 37 == 0, "Gone").otherwise(F.concat(w1, text_((k * 7) % 29)))
    head = F.when(k % 5 == 0, F.concat("module", F.lit("/"), text_((k + 1) % 4), F.lit("::"))).when(k % 5 == 1, "crate::").otherwise("")
    calls = p.select(k.alias("ref"), F.concat(head, type_, F.lit("::"), w2, text_(k % 3)).alias("path"), module.alias("module"), "package", file.alias("file"))
    target = F.when(k % 6 == 0, F.concat(F.lit("ext::"), w1, F.lit("<T>"))).otherwise(F.concat(F.lit("part"), text_((k + 4) % F.col("__n"))))
    imports = p.filter("kind <> 'method'").join(F.broadcast(n)).select(module.alias("module"), F.concat(w1, text_((k * 7) % 29)).alias("name"), target.alias("target"), (k % 6 == 0).alias("external"))
    return resolve.associated_cascade(calls, s, imports).select("ref", "target", "confidence", "reason")


@query("external_crate_calls", """WITH refs AS (SELECT p_partkey AS ref, CASE p_size % 4 WHEN 0 THEN 'std::' || p_type WHEN 1 THEN 'core::' || p_brand WHEN 2 THEN 'serde::' || p_type ELSE 'unknown::' || p_type END AS path FROM part)
SELECT ref, path, CASE WHEN split_part(path, '::', 1) IN ('std', 'core', 'alloc') THEN CASE WHEN split_part(path, '::', 2) IN ('PROMO', 'ECONOMY', 'Brand#12') THEN 0.85 ELSE 0.8 END WHEN split_part(path, '::', 1) = 'serde' THEN 0.6 ELSE 0 END::DOUBLE AS confidence FROM refs""")
def external_crates(spark, d):
    s = F.col("p_size") % 4
    refs = t.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.when(s == 0, F.concat(F.lit("std::"), "p_type")).when(s == 1, F.concat(F.lit("core::"), "p_brand")).when(s == 2, F.concat(F.lit("serde::"), "p_type")).otherwise(F.concat(F.lit("unknown::"), "p_type")).alias("path"))
    return resolve.external_calls(refs, ["PROMO", "ECONOMY", "Brand#12"], ["serde"])


@query("external_crate_totals", """SELECT count(*) FILTER (p_size % 4 <> 3) AS total, count(*) FILTER (p_type IN ('PROMO', 'SMALL')) AS classified FROM part""")
def external_totals(spark, d):
    calls = t.table(spark, d, "part").select(F.when(F.col("p_size") % 4 != 3, "external-crate").otherwise("free-function").alias("call_kind"), F.when(F.col("p_type").isin("PROMO", "SMALL"), F.col("p_type")).alias("known_crate"))
    return core.external_crate_totals(calls)


# Uses: modules crate::m<k>::<brand> of the parts' packages, items by the parts' first words.
_USES = f"""{P}, w AS (SELECT id, package, split_part(name, ' ', 1) || id % 40 AS item, 'crate::m' || id % 3 AS top, 'b' || split_part(module, '#', 2) AS b FROM parts),
s AS (SELECT 'part' || id AS id, item AS name, top || '::' || b AS module, package FROM w), mods AS (SELECT DISTINCT package, 'crate' AS module, 'src/lib.rs' AS file FROM w UNION SELECT DISTINCT package, top, 'src/' || top || '/mod.rs' FROM w UNION SELECT DISTINCT package, top || '::' || b, 'src/' || top || '/' || b || '.rs' FROM w WHERE b <> 'b7'),
u AS (SELECT id AS ref, package, CASE WHEN id % 7 = 0 THEN 'x' END AS alias, id % 11 = 0 AS reexport, id % 8 AS k, top || '::' || b AS own, top, b, item FROM w),
e AS (SELECT *, CASE k WHEN 0 THEN own || '::' || item WHEN 1 THEN own || '::' || item WHEN 2 THEN top || '::' || b || '::' || item WHEN 4 THEN NULL WHEN 5 THEN top WHEN 6 THEN own || '::*' WHEN 7 THEN 'crate::' || b WHEN 3 THEN NULL END AS x, CASE k WHEN 1 THEN 'self' WHEN 2 THEN 'super' WHEN 3 THEN 'super' WHEN 4 THEN 'external' WHEN 7 THEN 'super' ELSE 'crate' END AS kind FROM u)"""


@query("use_resolution", f"""WITH {_USES}, n AS (SELECT package, module, name, count(*) AS n, min(id) AS id FROM s GROUP BY ALL),
j AS (SELECT e.*, mods.file, n.n, n.id AS sid FROM e LEFT JOIN mods ON mods.package = e.package AND mods.module = x LEFT JOIN n ON n.package = e.package AND n.name = split_part(x, '::', -1) AND n.module || '::' || n.name = x)
SELECT ref, kind, CASE WHEN k IN (4, 6) THEN 'skipped' WHEN n = 1 THEN 'symbol' WHEN file IS NOT NULL THEN 'module' ELSE 'unresolved' END AS level, CASE WHEN k <> 6 AND n = 1 THEN sid END AS target, file AS module_target,
 (CASE WHEN k <> 6 AND n = 1 THEN CASE WHEN kind IN ('self', 'super') THEN 0.8 WHEN reexport OR alias IS NOT NULL THEN 0.85 ELSE 0.9 END WHEN file IS NULL THEN 0 WHEN kind IN ('self', 'super') THEN 0.75 WHEN k = 5 THEN 0.85 ELSE 0.8 END)::DOUBLE AS confidence,
 CASE WHEN k = 4 THEN 'external' WHEN k = 3 THEN 'super-at-root' WHEN k <> 6 AND n = 1 THEN CASE WHEN kind IN ('self', 'super') THEN kind WHEN reexport THEN 'reexport' WHEN alias IS NOT NULL THEN 'alias' ELSE 'crate' END WHEN file IS NOT NULL THEN CASE WHEN kind IN ('self', 'super') THEN 'module-self-super' ELSE 'module' END WHEN k <> 6 AND n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS reason FROM j""")
def use_resolution(spark, d):
    k, text_ = F.col("id"), lambda x: x.cast("string")
    w = t.parts(spark, d).select("id", "package", F.concat(F.split_part("name", F.lit(" "), F.lit(1)), text_(k % 40)).alias("item"), F.concat(F.lit("crate::m"), text_(k % 3)).alias("top"), F.concat(F.lit("b"), F.split_part("module", F.lit("#"), F.lit(2))).alias("b"))
    w = w.withColumn("own", F.concat_ws("::", "top", "b"))
    symbols = w.select(F.concat(F.lit("part"), text_(k)).alias("id"), F.col("item").alias("name"), F.col("own").alias("module"), "package")
    row = lambda m, f: w.select("package", m.alias("module"), f.alias("file")).distinct()
    modules = row(F.lit("crate"), F.lit("src/lib.rs")).unionByName(row(F.col("top"), F.concat(F.lit("src/"), "top", F.lit("/mod.rs")))).unionByName(row(F.col("own"), F.concat(F.lit("src/"), "top", F.lit("/"), "b", F.lit(".rs"))).filter("not endswith(module, '::b7')"))
    c = lambda *x: F.concat_ws("::", *x)
    at = k % 8
    path = F.when(at == 0, c("own", "item")).when(at == 1, c(F.lit("self"), "item")).when(at == 2, c(F.lit("super"), "b", "item")).when(at == 3, c(F.lit("super::super::super"), "item")).when(at == 4, c(F.lit("serde"), "item")).when(at == 5, F.col("top")).when(at == 6, F.concat("own", F.lit("::*"))).otherwise(c(F.lit("super::super"), "b"))
    uses = w.select(k.alias("ref"), "package", path.alias("path"), F.when(k % 7 == 0, "x").alias("alias"), (k % 11 == 0).alias("reexport"), F.col("own").alias("module"))
    return resolve.resolve_uses(uses, modules, symbols)


@query("py_call_first_match", f"""WITH {P}, s AS (SELECT name || id % 60 AS name, module || '.' || name || id % 60 AS qname, file, id FROM parts),
refs AS (SELECT id AS ref, name || (id * 7) % 90 AS name, module || '.' || name || (id * 7) % 90 AS qname, file, line_start AS line, CASE WHEN id % 2 = 0 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM parts),
al AS (SELECT name || (60 + id % 30) AS alias, max(name || id % 60) AS symbol FROM parts WHERE kind = 'struct' GROUP BY 1),
f AS (SELECT name, id FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY file, id) = 1), q AS (SELECT qname, id FROM s QUALIFY row_number() OVER (PARTITION BY qname ORDER BY file, id) = 1),
x AS (SELECT r.*, coalesce(q.id, i.id, f.id) AS found FROM refs r LEFT JOIN q USING (qname) LEFT JOIN al ON alias = r.name LEFT JOIN f i ON i.name = al.symbol LEFT JOIN f ON f.name = r.name)
SELECT ref, file AS source, coalesce(found::VARCHAR, 'py:call-target:' || file || ':' || name || ':' || line) AS target, found IS NULL AS placeholder, confidence FROM x""")
def py_calls(spark, d):
    k, p = F.col("id"), t.parts(spark, d)
    numbered = lambda n: F.concat("name", n.cast("string"))
    s = p.select("id", numbered(k % 60).alias("name"), F.concat_ws(".", "module", numbered(k % 60)).alias("qname"), "file", k.alias("ord"))
    calls = p.select(k.alias("ref"), numbered((k * 7) % 90).alias("name"), F.concat_ws(".", "module", numbered((k * 7) % 90)).alias("qname"), "file", F.col("line_start").alias("line"), F.when(k % 2 == 0, 0.9).otherwise(0.7).alias("confidence"))
    aliases = p.filter("kind = 'struct'").select(numbered(60 + k % 30).alias("alias"), numbered(k % 60).alias("symbol"))
    return resolve.first_of_python(calls, s, aliases)


_TARGETS = [{"node": "file:c7"}, {"node": "no", "project": "package:1"}, {"path": "Brand#1/PROMO"}, {"path": "/PROMO"}, {"query": "asia"}, {"query": "region_1"}, {"query": "Customer_0"}, {"project": "nope"}, {}]


@query("impact_target_ladder", f"""WITH {t.NODES_SQL}, n AS (SELECT id AS ord, id, coalesce(CASE WHEN label = 'package' THEN id END, label) AS project, coalesce(file, '') AS path, name AS label FROM nodes),
q(target, node, project, path, query) AS (VALUES {", ".join("(" + ", ".join(str(k) if x is None and j == 0 else "NULL" if x is None else f"'{x}'" for j, x in enumerate([None, g.get('node'), g.get('project'), g.get('path'), g.get('query') or g.get('path') or g.get('project') or g.get('node') or ''])) + ")" for k, g in enumerate(_TARGETS))}),
r AS (SELECT target, n.id, 0 AS rank, 1.0 AS c, 'node' AS reason FROM q JOIN n ON n.id = q.node UNION ALL SELECT target, n.id, 1, 1.0, 'project' FROM q JOIN n ON n.project = q.project UNION ALL SELECT target, n.id, 2, 0.9, 'path' FROM q JOIN n ON n.path = q.path
UNION ALL SELECT target, n.id, 3, 0.75, 'path-suffix' FROM q JOIN n ON ends_with(n.path, q.path) UNION ALL SELECT target, n.id, 4, 0.65, 'label' FROM q JOIN n ON query <> '' AND lower(label) = lower(query) UNION ALL SELECT target, n.id, 5, 0.45, 'label-part' FROM q JOIN n ON query <> '' AND contains(lower(label), lower(query)))
SELECT q.target, r.id, coalesce(c, 0)::DOUBLE AS confidence, coalesce(reason, 'no-match') AS reason FROM q LEFT JOIN (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY target ORDER BY rank, id) = 1) r USING (target)""")
def target_ladder(spark, d):
    n = t.nodes(spark, d)
    nodes = n.select(F.col("id").alias("ord"), "id", F.when(F.col("label") == "package", F.col("id")).otherwise(F.col("label")).alias("project"), F.coalesce("file", F.lit("")).alias("path"), F.col("name").alias("label"))
    return workspace.impact_targets(_TARGETS, nodes)


# Changed files: every customer's, under projects r<region>/n<nation>; some nations have no project, one is the root.
_OWNED = """cf AS (SELECT DISTINCT CASE WHEN c_custkey % 23 = 0 THEN 'r' || n_regionkey || '/Dockerfile.' || c_nationkey WHEN c_custkey % 29 = 0 THEN '.github/workflows/w' || c_nationkey || '.yml' WHEN c_custkey % 31 = 0 THEN 'r' || n_regionkey || '/run' || c_nationkey || '.sh' WHEN c_custkey % 37 = 0 THEN 'zz/' || c_nationkey || '.rs'
 ELSE 'r' || n_regionkey || '/n' || c_nationkey || '/d' || c_custkey % 3 || '/f.rs' END AS path FROM customer JOIN nation ON n_nationkey = c_nationkey),
pj AS (SELECT 'r' || n_regionkey || '/n' || n_nationkey AS path, lower(n_name) AS label, CASE WHEN n_nationkey % 6 = 1 THEN 'go' ELSE 'rust' END AS language, n_nationkey % 6 <> 1 AS supported FROM nation WHERE NOT regexp_matches(n_name, '[49]$') UNION ALL SELECT 'r' || r_regionkey, lower(r_name), 'python', true FROM region WHERE r_regionkey <> 3),
fo AS (SELECT path, CASE WHEN regexp_matches(path, '(^|/)(Dockerfile|Makefile|\\.env|docker-compose)[^/]*$') OR contains(path, '.github/workflows') THEN 'config' WHEN path LIKE '%.sh' THEN 'script' END AS own FROM cf),
lp AS (SELECT fo.path, pj.path AS root, pj.label, pj.language, pj.supported FROM fo LEFT JOIN pj ON starts_with(fo.path, pj.path || '/') WHERE own IS NULL QUALIFY row_number() OVER (PARTITION BY fo.path ORDER BY length(pj.path) DESC NULLS LAST) = 1),
ow AS (SELECT path, CASE WHEN root IS NULL THEN 'unknown' ELSE 'project:' || replace(root, '/', ':') END AS project, 'project:' || replace(root, '/', ':') AS owner, coalesce(label, 'unknown') AS label, coalesce(language, '') AS language, CASE WHEN root IS NULL THEN 'unknown' WHEN supported THEN 'project' ELSE 'unsupported' END AS owner_kind, CASE WHEN root IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence FROM lp
 UNION ALL SELECT path, 'workspace:' || own, CASE WHEN own = 'script' THEN 'script:' WHEN contains(path, '.github/workflows') THEN 'workflow:' ELSE 'config:' END || replace(path, '/', ':'), split_part(path, '/', -1), CASE WHEN own = 'script' THEN 'shell' ELSE '' END, own, 0.9 FROM fo WHERE own IS NOT NULL)"""


def _owners(spark, d):
    n = t.table(spark, d, "nation").select("n_nationkey", "n_regionkey", "n_name")
    c = t.table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    k, nat, reg = F.col("c_custkey"), F.col("c_nationkey").cast("string"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))
    path = F.when(k % 23 == 0, F.concat(reg, F.lit("/Dockerfile."), nat)).when(k % 29 == 0, F.concat(F.lit(".github/workflows/w"), nat, F.lit(".yml"))).when(k % 31 == 0, F.concat(reg, F.lit("/run"), nat, F.lit(".sh"))).when(k % 37 == 0, F.concat(F.lit("zz/"), nat, F.lit(".rs"))).otherwise(F.concat(reg, F.lit("/n"), nat, F.lit("/d"), (k % 3).cast("string"), F.lit("/f.rs")))
    nk = F.col("n_nationkey")
    own = n.filter(~F.col("n_name").rlike("[49]$")).select(F.concat(reg, F.lit("/n"), nk.cast("string")).alias("path"), F.lower("n_name").alias("label"), F.when(nk % 6 == 1, "go").otherwise("rust").alias("language"), (nk % 6 != 1).alias("supported"))
    top = t.table(spark, d, "region").filter("r_regionkey <> 3").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("path"), F.lower("r_name").alias("label"), F.lit("python").alias("language"), F.lit(True).alias("supported"))
    return workspace.file_owners(c.select(path.alias("path")), own.unionByName(top))


@query("file_owners", f"WITH {_OWNED} SELECT * FROM ow")
def file_owners(spark, d):
    return _owners(spark, d)


# The workspace's projects, as nodes with a path, and the two nations whose files change: one project, one unsupported.
_CHANGED = f"""{_WS}, e AS (SELECT source, target, kind, CASE WHEN kind IN ('adjacent_to', 'unsupported_boundary') THEN least(confidence, 0.4) ELSE confidence END AS c, kind IN ('adjacent_to', 'unsupported_boundary') AS weak FROM ws),
st AS (SELECT DISTINCT 'project:' || c_nationkey AS id FROM customer WHERE c_custkey IN (1, 2, 3)),
h1 AS (SELECT e.target AS id, 1 AS distance, c AS confidence, weak FROM e JOIN st ON st.id = source WHERE e.target NOT IN (SELECT id FROM st) QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY weak, c DESC, kind DESC) = 1),
h2 AS (SELECT e.target AS id, 2 AS distance, least(h.confidence, e.c) AS confidence, e.weak FROM h1 h JOIN e ON e.source = h.id WHERE NOT h.weak AND e.kind <> 'contains' AND e.target NOT IN (SELECT id FROM st) AND e.target NOT IN (SELECT id FROM h1) QUALIFY row_number() OVER (PARTITION BY e.target ORDER BY e.weak, least(h.confidence, e.c) DESC, e.kind DESC) = 1),
hit AS (SELECT id, 0 AS distance, 1.0 AS confidence FROM st UNION ALL SELECT id, distance, confidence FROM h1 UNION ALL SELECT id, distance, confidence FROM h2),
g AS (SELECT hit.id, distance, hit.confidence, supported, CASE WHEN distance = 0 THEN 'direct' ELSE 'indirect' END AS change_type, {_surface_sql("'src/' || name", 'name', "'rust'", 'supported')} AS surface FROM hit JOIN projects p ON p.id = hit.id),
a AS (SELECT id, surface, {_GROUP_SQL} AS grp, distance, confidence::DOUBLE AS confidence, change_type, supported FROM g),
b AS (SELECT *, change_type <> 'direct' AND grp IN ('fixtureOnly', 'lowConfidence') AS suppressed FROM a)"""


def _affected(spark, d):
    p = _projects(spark, d)
    nodes = p.select("id", F.lit("project").alias("kind"), F.col("name").alias("label"), F.concat(F.lit("src/"), "name").alias("path"), F.lit("rust").alias("language"), "supported")
    first = t.table(spark, d, "customer").filter(F.col("c_custkey").isin(1, 2, 3)).select(F.concat(F.lit("project:"), F.col("c_nationkey").cast("string")).alias("owner"))
    return workspace.affected_projects(first, nodes, _workspace(spark, d))


@query("affected_projects", f"WITH {_CHANGED} SELECT id, surface, grp, distance, confidence, change_type, suppressed FROM b")
def affected_projects(spark, d):
    return _affected(spark, d).select("id", "surface", "grp", "distance", "confidence", "change_type", "suppressed")


@query("change_report", f"""WITH {_CHANGED}, {_OWNED}, o AS (SELECT bool_or(owner_kind = 'config') AS config, bool_or(owner_kind = 'script') AS script, bool_or(owner_kind = 'unknown') AS unknown FROM ow),
x AS (SELECT count(*) AS raw, count(*) FILTER (NOT suppressed) AS reported, count(*) FILTER (suppressed) AS suppressed, count(*) FILTER (grp = 'direct') AS direct, count(*) FILTER (grp = 'highConfidence') AS high_confidence, count(*) FILTER (grp = 'lowConfidence') AS low_confidence, count(*) FILTER (grp = 'fixtureOnly') AS fixture_only, count(*) FILTER (grp = 'unsupportedBoundary') AS unsupported_boundary,
 count(*) FILTER (NOT suppressed AND change_type = 'indirect' AND grp = 'highConfidence') AS n, count(*) FILTER (NOT suppressed AND change_type = 'indirect') AS m, count(*) FILTER (NOT supported AND (distance = 0 OR confidence >= 0.65)) > 0 AS b FROM b)
SELECT raw, reported, suppressed, direct, high_confidence, low_confidence, fixture_only, unsupported_boundary, CASE WHEN n >= 10 OR b AND n >= 4 THEN 'critical' WHEN config AND n > 0 OR n >= 4 OR b THEN 'high' WHEN n > 0 OR m > 0 OR config OR script OR unknown THEN 'medium' ELSE 'low' END AS risk FROM x, o""")
def change_report(spark, d):
    return workspace.change_report(_owners(spark, d), _affected(spark, d), 25)


@query("review_checklist", f"WITH {_PROJECTS} SELECT DISTINCT CASE WHEN supported THEN 'review ' || workspace ELSE 'boundary ' || name END AS item FROM projects")
def review_checklist(spark, d):
    return workspace.checklist(_projects(spark, d).select(F.when(F.col("supported"), F.concat(F.lit("review "), "workspace")).otherwise(F.concat(F.lit("boundary "), "name")).alias("item")))


_MIXED = f"""{P}, mx AS (SELECT id, CASE id % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'source-file' ELSE 'diagnostic' END AS label, name, file, line_start AS line, CASE WHEN id % 5 = 0 THEN kind END AS sk, CASE WHEN id % 4 = 0 THEN 'module' WHEN id % 4 = 1 THEN 'class' END AS k, CASE WHEN id % 7 = 0 THEN 'other' || id END AS pn, CASE WHEN id % 2 = 0 THEN visibility END AS v FROM parts)"""


@query("symbol_projection", f"""WITH {_MIXED} SELECT id, coalesce(pn, name) AS name, coalesce(sk, k, 'symbol') AS kind, file, line, '' AS module, coalesce(v, 'unknown') AS visibility FROM mx
WHERE label = 'symbol' OR coalesce(sk, k) IN ('function', 'struct', 'enum', 'trait', 'method', 'associated-function', 'class', 'const', 'static')""")
def symbol_projection(spark, d):
    k = F.col("id")
    say = lambda name, cond, value: F.when(cond, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    properties = F.map_concat(say("symbolKind", k % 5 == 0, F.col("kind")), say("kind", k % 4 < 2, F.when(k % 4 == 0, "module").otherwise("class")), say("name", k % 7 == 0, F.concat(F.lit("other"), k.cast("string"))), say("visibility", k % 2 == 0, F.col("visibility")))
    nodes = t.parts(spark, d).select("id", F.when(k % 3 == 0, "symbol").when(k % 3 == 1, "source-file").otherwise("diagnostic").alias("label"), "name", "file", F.col("line_start").alias("line"), properties.alias("properties"))
    return core.symbols_of(nodes)


@query("name_functions", r"""SELECT doc_id, len(string_split(CASE doc_id % 4 WHEN 0 THEN 'a::b' WHEN 1 THEN 'x' ELSE 'a' END, '::')) * (doc_id % 4 <> 2)::INT AS segments, (doc_id % 5 < 2) AS valid,
 length(decode(encode(coalesce(text, ''))[1:doc_id % 300])) * 0 + len(regexp_extract_all(hex(encode(coalesce(text, ''))[1:doc_id % 300]), '(?:0A)|(?:[0-9A-F]{2})')) - len(list_filter(regexp_extract_all(hex(encode(coalesce(text, ''))[1:doc_id % 300]), '[0-9A-F]{2}'), lambda x: x <> '0A')) + 1 AS line,
 CASE doc_id % 3 WHEN 0 THEN '../c' WHEN 1 THEN 'a/d' ELSE '/q' END AS normal, CASE doc_id % 3 WHEN 0 THEN source || '.b' WHEN 1 THEN source ELSE source || '.b.c' END AS module,
 CASE doc_id % 3 WHEN 0 THEN 'a.b.c,c' WHEN 1 THEN 'run' ELSE 'x.y,y' END AS names, CASE doc_id % 4 WHEN 0 THEN source || '''' WHEN 1 THEN 'it''s' WHEN 2 THEN 'a"b' ELSE '' END AS bare FROM documents""".replace("length(decode(encode(coalesce(text, ''))[1:doc_id % 300])) * 0 + ", ""))
def name_functions(spark, d):
    k = F.col("doc_id")
    path = F.when(k % 4 == 0, "crate::a::b").when(k % 4 == 1, "crate::x").when(k % 4 == 2, "serde::y").otherwise("crate::a")
    name = F.when(k % 5 == 0, "run_1").when(k % 5 == 1, "_x").when(k % 5 == 2, "1x").when(k % 5 == 3, "a-b").otherwise("")
    place = F.when(k % 3 == 0, "./a/../../b/../c").when(k % 3 == 1, "a//b/c/../../d").otherwise("/p/../q/.")
    module = F.when(k % 3 == 0, F.concat("source", F.lit("/b.py"))).when(k % 3 == 1, F.concat("source", F.lit("/__init__.py"))).otherwise(F.concat("source", F.lit("/b/c.py")))
    called = F.when(k % 3 == 0, "a.b.c").when(k % 3 == 1, "run").otherwise("x.y")
    quoted = F.when(k % 4 == 0, F.concat(F.lit("\"'"), "source", F.lit("',\""))).when(k % 4 == 1, "it's").when(k % 4 == 2, '"a"b"').otherwise("''")
    return t.table(spark, d, "documents").select("doc_id", F.size(paths.crate_segments(path)).alias("segments"), paths.valid_name(name).alias("valid"), paths.line_of(F.coalesce("text", F.lit("")), (k % 300).cast("int")).alias("line"), paths.normalise(place).alias("normal"), paths.module_name(module).alias("module"), F.array_join(paths.call_names(called), ",").alias("names"), paths.unquote(quoted).alias("bare"))


_NAMED = f"{P}, ns AS (SELECT id, CASE line_start WHEN 1 THEN 'Main' WHEN 8 THEN 'run' ELSE name END AS name, module, file, line_start, visibility FROM parts)"


@query("analyze_compact", f"""WITH {_NAMED}, {t.CALLS_SQL}, e AS (SELECT 'entry' AS section, name AS item, id::BIGINT AS rank FROM ns WHERE lower(name) IN ('main', 'run', 'start', 'init') ORDER BY file, line_start, id LIMIT 10), s AS (SELECT 'symbol', name, id FROM ns WHERE visibility = 'public' ORDER BY file, line_start, name, id LIMIT 30),
m AS (SELECT 'module', module, count(*) FROM ns GROUP BY module ORDER BY count(*) DESC, module LIMIT 20), r AS (SELECT 'risk', target::VARCHAR, count(*) AS n FROM calls GROUP BY target ORDER BY n DESC, target::VARCHAR LIMIT 10) SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL SELECT * FROM m UNION ALL SELECT * FROM r""")
def analyze_compact(spark, d):
    named = t.parts(spark, d).withColumn("name", F.when(F.col("line_start") == 1, "Main").when(F.col("line_start") == 8, "run").otherwise(F.col("name")))
    risks = t.calls(spark, d).groupBy(F.col("target").cast("string").alias("item")).agg(F.count("*").alias("rank"))
    return core.compact_profile(named, risks)


_VERSIONS = f"""{P}, v2 AS (SELECT id, CASE WHEN file LIKE '%/PROMO' THEN 'trait' ELSE kind END AS kind, CASE WHEN module = 'Brand#1' THEN 'private' ELSE visibility END AS visibility FROM parts WHERE name NOT LIKE 'hot %')"""


def _versions(spark, d):
    old = t.parts(spark, d).select("id", "kind", "visibility", "name", "module", "file")
    new = old.filter("name not like 'hot %'").select("id", F.when(F.col("file").like("%/PROMO"), "trait").otherwise(F.col("kind")).alias("kind"), F.when(F.col("module") == "Brand#1", "private").otherwise(F.col("visibility")).alias("visibility"))
    return old, new


@query("breaking_changes", f"""WITH {_VERSIONS}, {t.CALLS_SQL} SELECT id, change, (SELECT count(DISTINCT source) FROM calls WHERE target = x.id) AS callers FROM (SELECT p.id, CASE WHEN v2.id IS NULL THEN 'removed' WHEN v2.visibility <> 'public' THEN 'hidden' WHEN v2.kind <> p.kind THEN 'kind' END AS change FROM parts p LEFT JOIN v2 ON v2.id = p.id WHERE p.visibility = 'public') x WHERE change IS NOT NULL""")
def breaking_changes(spark, d):
    return change.breaking_changes(*_versions(spark, d), t.calls(spark, d))


@query("run_deltas", f"""WITH {_VERSIONS}, {t.CALLS_SQL}, e2 AS (SELECT source, target FROM calls WHERE confidence < 0.5 UNION SELECT target, source FROM calls WHERE confidence < 0.1)
SELECT 'nodes' AS section, (SELECT count(*) FROM parts) AS old, (SELECT count(*) FROM v2) AS new, (SELECT count(*) FROM v2) - (SELECT count(*) FROM parts) AS delta, (SELECT count(*) FROM v2 WHERE id NOT IN (SELECT id FROM parts)) AS added, (SELECT count(*) FROM parts WHERE id NOT IN (SELECT id FROM v2)) AS removed
UNION ALL SELECT 'edges', (SELECT count(*) FROM calls), (SELECT count(*) FROM e2), (SELECT count(*) FROM e2) - (SELECT count(*) FROM calls), (SELECT count(*) FROM (SELECT * FROM e2 EXCEPT SELECT source, target FROM calls)), (SELECT count(*) FROM (SELECT source, target FROM calls EXCEPT SELECT * FROM e2))""")
def run_deltas(spark, d):
    old, new = _versions(spark, d)
    c = t.calls(spark, d)
    kept = c.filter("confidence < 0.5").select("source", "target")
    turned = c.filter("confidence < 0.1").select(F.col("target").alias("source"), F.col("source").alias("target"))
    return change.run_deltas([("nodes", old, new, ["id"]), ("edges", c, kept.unionByName(turned).distinct(), ["source", "target"])])
