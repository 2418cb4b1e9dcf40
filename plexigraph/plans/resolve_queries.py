"""Resolution queries: staged cascades, candidate ranks, ranges, prefixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plexigraph.functions import paths
from plexigraph.operators import core, resolve
from plexigraph.plans.registry import query
from plexigraph.session import by_exchange
from plexigraph.sources import tables as t

P, C = t.PARTS_SQL, t.CALLS_SQL


def _cascade_sql(stages: list[tuple[str, float, str, bool]], refs: str = "refs") -> str:
    """SQL of operators.resolve.cascade over named candidate relations (ref, target)."""
    parts = " UNION ALL ".join(f"SELECT ref, {k} AS rank, count(DISTINCT target) AS n, min(target) AS target, {c} AS confidence, '{r}' AS reason FROM {x} GROUP BY ref" + ("" if b else " HAVING count(DISTINCT target) = 1") for k, (r, c, x, b) in enumerate(stages))
    return f"""st AS ({parts}), won AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank) = 1)
SELECT r.ref, CASE WHEN w.n = 1 THEN w.target END AS target, (CASE WHEN w.n = 1 THEN w.confidence ELSE 0 END)::DOUBLE AS confidence,
 CASE WHEN w.n = 1 THEN w.reason WHEN w.ref IS NOT NULL THEN 'ambiguous' ELSE 'unresolved' END AS reason FROM {refs} r LEFT JOIN won w ON w.ref = r.ref"""


# Calls by name: a line item calls the part's name from the module and file of another part.
_REFS_SQL = f"""{P},
refs AS (SELECT l.l_orderkey * 10 + l.l_linenumber AS ref, min(b.name) AS name, min(a.module) AS module, min(a.package) AS package, min(a.file) AS file
  FROM lineitem l JOIN parts a ON a.id = (l.l_partkey * 31) % (SELECT count(*) FROM part) JOIN parts b ON b.id = l.l_partkey GROUP BY 1),
imports AS (SELECT module, CASE WHEN p_size % 10 = 0 THEN '*' ELSE p_name END AS name, min(CASE WHEN p_size % 10 = 0 THEN p_brand ELSE 'part' || p_partkey END) AS target
  FROM (SELECT p.*, 'Brand#' || (1 + p_partkey % 5) || (1 + p_size % 5) AS module FROM part p) GROUP BY 1, 2, CASE WHEN p_size % 10 = 0 THEN p_brand END)"""


def _refs(spark, d):
    p = t.parts(spark, d)
    n = t.table(spark, d, "part").count()
    li = t.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), "l_partkey", ((F.col("l_partkey") * 31) % n).alias("__a"))
    a = p.select(F.col("id").alias("__a"), "module", "package", "file")
    b = p.select(F.col("id").alias("l_partkey"), "name")
    return li.join(a, "__a").join(b, "l_partkey").groupBy("ref").agg(*[F.min(c).alias(c) for c in ("name", "module", "package", "file")])


def _imports(spark, d):
    wild = F.col("p_size") % 10 == 0
    x = t.table(spark, d, "part").withColumn("module", F.concat(F.lit("Brand#"), (1 + F.col("p_partkey") % 5).cast("string"), (1 + F.col("p_size") % 5).cast("string")))
    x = x.withColumn("name", F.when(wild, "*").otherwise(F.col("p_name"))).withColumn("g", F.when(wild, F.col("p_brand")))
    return x.groupBy("module", "name", "g").agg(F.min(F.when(wild, F.col("p_brand")).otherwise(F.concat(F.lit("part"), F.col("p_partkey").cast("string")))).alias("target")).drop("g")


@query("call_cascade_free", f"""WITH {_REFS_SQL}, s AS (SELECT 'part' || id AS target, name, kind, module AS s_module, package AS s_package, file AS s_file FROM parts),
c1 AS (SELECT ref, target FROM refs JOIN s USING (name) WHERE s_module = module),
c2 AS (SELECT ref, target FROM refs JOIN imports USING (module, name) WHERE name <> '*'),
c3 AS (SELECT ref, target, s_module, module FROM refs JOIN s USING (name) WHERE kind = 'function' AND s_package = package AND s_file <> file),
c4 AS (SELECT ref, target FROM c3 WHERE (module, s_module) IN (SELECT (module, target) FROM imports WHERE name = '*')),
c5 AS (SELECT ref, target FROM refs JOIN s USING (name) WHERE kind = 'function' AND s_file = file),
{_cascade_sql([("same-module", 0.90, "c1", True), ("import", 0.85, "c2", True), ("same-crate", 0.80, "c3", False), ("same-crate", 0.80, "c4", False), ("same-file-unique", 0.70, "c5", True)])}""")
def call_cascade_free(spark, d):
    symbols = t.parts(spark, d).withColumn("id", F.concat(F.lit("part"), F.col("id").cast("string")))
    return resolve.call_cascade(_refs(spark, d), symbols, _imports(spark, d)).select("ref", "target", "confidence", "reason")


@query("qualified_path_calls", f"""WITH {P}, s AS (SELECT 'part' || id AS target, split_part(name, ' ', 1) AS name, 'crate::m' || id % 9 || '::' || split_part(module, '#', 2) AS m FROM parts),
refs AS (SELECT id AS ref, 'crate::m' || id % 9 || '::' || split_part(module, '#', 2) AS module, split_part(name, ' ', 1) AS name, id % 4 AS k, 'm' || (id * 7) % 9 || '::' || split_part(module, '#', 2) AS other FROM parts),
x AS (SELECT ref, name, CASE k WHEN 0 THEN module WHEN 1 THEN 'crate::m' || (ref % 9) ELSE 'crate::' || other END AS m, k FROM refs),
hits AS (SELECT ref, target, k FROM x JOIN s USING (name, m)),
c1 AS (SELECT ref, target FROM hits WHERE k IN (0, 1)), c2 AS (SELECT ref, target FROM hits WHERE k = 2), c3 AS (SELECT ref, target FROM hits WHERE k = 3),
{_cascade_sql([("self-super", 0.80, "c1", True), ("crate-path", 0.90, "c2", True), ("module-path", 0.85, "c3", True)])}""")
def qualified_path(spark, d):
    p = t.parts(spark, d)
    short, brand = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("module", F.lit("#"), F.lit(2))
    own = F.concat(F.lit("crate::m"), (F.col("id") % 9).cast("string"), F.lit("::"), brand)
    other = F.concat(F.lit("m"), ((F.col("id") * 7) % 9).cast("string"), F.lit("::"), brand)
    symbols = p.select(F.concat(F.lit("part"), F.col("id").cast("string")).alias("id"), short.alias("name"), own.alias("module"))
    path = F.when(F.col("id") % 4 == 0, F.concat(F.lit("self::"), short)).when(F.col("id") % 4 == 1, F.concat(F.lit("super::"), short)).when(F.col("id") % 4 == 2, F.concat(F.lit("crate::"), other, F.lit("::"), short)).otherwise(F.concat(other, F.lit("::"), short))
    refs = p.select(F.col("id").alias("ref"), path.alias("path"), own.alias("module"))
    return resolve.qualified_cascade(refs, symbols).select("ref", "target", "confidence", "reason")


# Pages: links of one page as import candidates, ranked: exact url, url with index, host only.
_LINKS_SQL = r"""links AS (SELECT DISTINCT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""


def _links(spark, d):
    p = t.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


@query("page_links", f"""WITH {_LINKS_SQL} SELECT page_id, href, CASE WHEN href LIKE '/%' THEN 'relative' WHEN href LIKE 'http%' THEN 'absolute' ELSE 'other' END AS kind,
CASE WHEN href LIKE '/%' THEN host || href WHEN href LIKE 'http%' THEN regexp_extract(href, '^https?://(.*)$', 1) END AS target FROM links""")
def page_links(spark, d):
    href = F.col("href")
    kind = F.when(href.startswith("/"), "relative").when(href.startswith("http"), "absolute").otherwise("other")
    target = F.when(href.startswith("/"), F.concat("host", href)).when(href.startswith("http"), F.regexp_extract(href, "^https?://(.*)$", 1))
    return _links(spark, d).select("page_id", "href", kind.alias("kind"), target.alias("target"))


@query("import_candidates_rank", f"""WITH {_LINKS_SQL}, targets AS (SELECT DISTINCT '/' || p_name AS path FROM part UNION SELECT DISTINCT '/' || lang || '/index' FROM documents UNION SELECT DISTINCT '/' || substr(href, 2, 1) FROM links WHERE href LIKE '/%'),
refs AS (SELECT page_id || ':' || href AS ref, href FROM links WHERE href LIKE '/%'),
cand AS (SELECT ref, href AS path, 0 AS rank, 0.9 AS confidence, 'existing' AS reason FROM refs UNION ALL SELECT ref, lower(href), 1, 0.85, 'extension' FROM refs UNION ALL SELECT ref, substr(href, 1, 2), 2, 0.8, 'index' FROM refs),
best AS (SELECT c.* FROM cand c JOIN targets USING (path) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank, path) = 1)
SELECT r.ref, b.path AS target, coalesce(confidence, 0)::DOUBLE AS confidence, coalesce(reason, 'unresolved') AS reason FROM refs r LEFT JOIN best b ON b.ref = r.ref""")
def import_candidates(spark, d):
    links = _links(spark, d).filter(F.col("href").startswith("/"))
    refs = links.select(F.concat_ws(":", F.col("page_id").cast("string"), "href").alias("ref"), "href")
    targets = t.table(spark, d, "part").select(F.concat(F.lit("/"), "p_name").alias("path")).unionByName(t.table(spark, d, "documents").select(F.concat(F.lit("/"), "lang", F.lit("/index")).alias("path"))).unionByName(links.select(F.concat(F.lit("/"), F.expr("substring(href, 2, 1)")).alias("path"))).distinct()
    row = lambda p, k, c, r: refs.select("ref", p.alias("path"), F.lit(k).alias("rank"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    cand = row(F.col("href"), 0, 0.9, "existing").unionByName(row(F.lower("href"), 1, 0.85, "extension")).unionByName(row(F.expr("substring(href, 1, 2)"), 2, 0.8, "index"))
    return resolve.ranked(refs.select("ref"), cand, targets)


@query("js_call_resolution", f"""WITH {P}, refs AS (SELECT id AS ref, name, module || '/x' AS file FROM parts), s AS (SELECT id AS target, name, module || '/x' AS f FROM parts),
c1 AS (SELECT ref, target FROM refs JOIN s USING (name) WHERE f = file), c2 AS (SELECT ref, target FROM refs JOIN s USING (name)),
{_cascade_sql([("same-file", 0.85, "c1", False), ("project-unique", 0.55, "c2", True)])}""")
def js_calls(spark, d):
    p = t.parts(spark, d).withColumn("file", F.concat("module", F.lit("/x")))
    refs = p.select(F.col("id").alias("ref"), "name", "file")
    s = p.select(F.col("id").alias("target"), "name", "file")
    local, every = (refs.join(resolve.ends(s, on), on).select("ref", "target") for on in (["name", "file"], ["name"]))
    return resolve.cascade(refs, [("same-file", 0.85, local, False), ("project-unique", 0.55, every, True)]).select("ref", "target", "confidence", "reason")


_KINDS = ["function", "method", "struct"]


@query("ts_call_resolution", f"""WITH {P}, refs AS (SELECT id AS ref, name, file FROM parts),
s AS (SELECT id AS target, name, file AS f, list_position({_KINDS!r}, kind) AS rank FROM parts WHERE kind <> 'associated-function'),
imp AS (SELECT DISTINCT a.file, a.name, b.file AS f FROM parts a JOIN parts b ON b.id = a.id + 3 AND b.name = a.name OR b.id = a.id - (a.id % 3)),
b1 AS (SELECT ref, rank, min(target) AS target FROM refs JOIN imp USING (file, name) JOIN s USING (name, f) GROUP BY ref, rank HAVING count(DISTINCT target) = 1),
b2 AS (SELECT ref, rank, min(target) AS target FROM refs JOIN s USING (name) WHERE f = file GROUP BY ref, rank HAVING count(DISTINCT target) = 1),
b3 AS (SELECT ref, rank, min(target) AS target FROM refs JOIN s USING (name) GROUP BY ref, rank HAVING count(DISTINCT target) = 1),
c1 AS (SELECT ref, arg_min(target, rank) AS target FROM b1 GROUP BY ref), c2 AS (SELECT ref, arg_min(target, rank) AS target FROM b2 GROUP BY ref), c3 AS (SELECT ref, arg_min(target, rank) AS target FROM b3 GROUP BY ref),
{_cascade_sql([("imported", 0.88, "c1", False), ("same-file", 0.85, "c2", False), ("project-unique", 0.55, "c3", True)])}""")
def ts_calls(spark, d):
    p = t.parts(spark, d)
    refs = p.select(F.col("id").alias("ref"), "name", "file")
    a, b = p.select("id", "file", "name"), p.select(F.col("id").alias("bid"), F.col("file").alias("from_file"), F.col("name").alias("bname"))
    imp = a.join(b, F.col("bid") == F.col("id") + 3).filter("bname = name").unionByName(a.join(b, F.col("bid") == F.col("id") - F.col("id") % 3)).select("file", "name", "from_file").distinct()
    return resolve.preferred_kind(refs, p, imp, _KINDS).select("ref", "target", "confidence", "reason")


@query("cpp_suffix_calls", f"""WITH {P}, n AS (SELECT DISTINCT 'ns::' || module || '::' || split_part(name, ' ', 1) AS q FROM parts),
refs AS (SELECT id AS ref, CASE id % 3 WHEN 0 THEN 'ns::' || module || '::' || split_part(name, ' ', 1) WHEN 1 THEN module || '::' || split_part(name, ' ', 1) ELSE split_part(name, ' ', 1) || 'x' END AS name FROM parts),
h AS (SELECT ref, q, CASE WHEN q = name THEN 0 WHEN ends_with(q, '::' || name) THEN 1 END AS x FROM refs JOIN n ON split_part(q, '::', -1) = split_part(name, '::', -1))
SELECT r.ref, r.name, arg_min(q, x * 1000) FILTER (x IS NOT NULL) AS target, min(x) = 0 AS exact FROM refs r LEFT JOIN (SELECT ref, x, min(q) AS q FROM h GROUP BY ref, x) USING (ref) GROUP BY r.ref, r.name""")
def cpp_calls(spark, d):
    p = t.parts(spark, d).withColumn("s", F.split_part("name", F.lit(" "), F.lit(1)))
    names = p.select(F.concat_ws("::", F.lit("ns"), "module", "s").alias("qname"))
    refs = p.select(F.col("id").alias("ref"), F.when(F.col("id") % 3 == 0, F.concat_ws("::", F.lit("ns"), "module", "s")).when(F.col("id") % 3 == 1, F.concat_ws("::", "module", "s")).otherwise(F.concat("s", F.lit("x"))).alias("name"))
    return resolve.by_suffix(refs, names)


@query("designation_first_match", f"""WITH {P}, f AS (SELECT name, min(id) AS first_id FROM parts WHERE kind = 'struct' GROUP BY name)
SELECT 'DESIGNATION' AS edge_type, p.id AS source, first_id AS target, 0.95::DOUBLE AS confidence FROM parts p JOIN f USING (name) WHERE kind = 'method' UNION ALL
SELECT 'ACCESSES', p.id, first_id, 0.85 FROM parts p JOIN f USING (name) WHERE kind = 'function'""")
def designation(spark, d):
    p = t.parts(spark, d)
    first = resolve.first_match(p.filter(F.col("kind").isin("method", "function")).select("id", "name", "kind"), p.filter("kind = 'struct'").select("name", F.col("id").alias("target")), ["name"], [], "target").filter("target is not null")
    m = F.col("kind") == "method"
    return first.select(F.when(m, "DESIGNATION").otherwise("ACCESSES").alias("edge_type"), F.col("id").alias("source"), "target", F.when(m, 0.95).otherwise(0.85).alias("confidence"))


@query("enclosing_scope", f"""WITH {P}, pts AS (SELECT DISTINCT o_orderkey AS point, (SELECT count(*) FROM part) AS np, o_orderkey % 500 + 1 AS line FROM orders),
q AS (SELECT point, line, p.file FROM pts JOIN parts p ON p.id = (point * 17) % np)
SELECT q.point, q.file, q.line, (SELECT r.id FROM parts r WHERE r.file = q.file AND q.line BETWEEN r.line_start AND r.line_end ORDER BY r.line_end - r.line_start, r.line_start DESC, r.id LIMIT 1) AS scope FROM q""")
def enclosing_scope(spark, d):
    p = t.parts(spark, d)
    n = t.table(spark, d, "part").count()
    pts = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("point"), (F.col("o_orderkey") % 500 + 1).alias("line"), ((F.col("o_orderkey") * 17) % n).alias("id"))
    return resolve.enclosing(pts.join(by_exchange(p.select("id", "file")), "id").select("point", "file", "line"), p)


@query("hunk_overlap", f"""WITH {P}, {t.HUNKS_SQL}, o AS (SELECT DISTINCT hunk, p.id AS symbol, change_kind FROM hunks h JOIN parts p ON p.file = h.file AND new_start <= line_end AND new_end >= line_start)
SELECT symbol, count(*) AS hunks, string_agg(DISTINCT change_kind, ',' ORDER BY change_kind) AS kinds FROM o GROUP BY symbol""")
def hunk_overlap(spark, d):
    from plexigraph.operators import change

    return change.changed_ranges(t.hunks(spark, d), t.parts(spark, d))


@query("unknown_hunks", f"""WITH {P}, {t.HUNKS_SQL} SELECT * FROM hunks h WHERE NOT EXISTS (SELECT 1 FROM parts p WHERE p.file = h.file AND new_start <= line_end AND new_end >= line_start)""")
def unknown_hunks(spark, d):
    h = t.hunks(spark, d)
    return h.join(resolve.overlapping(h, t.parts(spark, d)).select("hunk").distinct(), "hunk", "left_anti").select(*h.columns)


@query("owner_longest_prefix", f"""WITH paths AS (SELECT doc_id, source || '/' || lang || '/d' || doc_id % 7 || '/f' || doc_id AS path FROM documents),
roots AS (SELECT DISTINCT source AS root FROM documents WHERE source <> 'src3' UNION SELECT DISTINCT source || '/' || lang FROM documents WHERE lang <> 'en' UNION SELECT DISTINCT source || '/' || lang || '/d' || doc_id % 7 FROM documents WHERE doc_id % 5 = 0)
SELECT doc_id, path, root, CASE WHEN root IS NULL THEN 0 ELSE 1 END::DOUBLE AS confidence FROM paths LEFT JOIN roots ON starts_with(path, root || '/') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(root) DESC NULLS LAST) = 1""")
def owner_prefix(spark, d):
    doc = t.table(spark, d, "documents").select("doc_id", "source", "lang", (F.col("doc_id") % 7).alias("k"))
    deep = F.concat("source", F.lit("/"), "lang", F.lit("/d"), F.col("k").cast("string"))
    p = doc.select("doc_id", F.concat(deep, F.lit("/f"), F.col("doc_id").cast("string")).alias("path"))
    roots = doc.filter("source <> 'src3'").select(F.col("source").alias("root")).unionByName(doc.filter("lang <> 'en'").select(F.concat_ws("/", "source", "lang").alias("root"))).unionByName(doc.filter("doc_id % 5 = 0").select(deep.alias("root"))).distinct()
    return resolve.longest_prefix(p, roots).withColumn("confidence", F.when(F.col("root").isNull(), 0.0).otherwise(1.0))


@query("scalar_functions", r"""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_brand || '::' || p_type ELSE '' END AS head, p_name AS last, p_brand || '::new' AS plain, replace(p_brand, '#', '_') AS safe,
CASE WHEN p_size = 0 THEN 0 ELSE round(100.0 * (p_partkey - p_size) / p_size, 2) END::DOUBLE AS delta, 'a.b' AS module FROM part""")
def scalar_functions(spark, d):
    full = F.when(F.col("p_size") % 2 == 0, F.concat_ws("::", "p_brand", "p_type", "p_name")).otherwise(F.col("p_name"))
    p = t.table(spark, d, "part").withColumn("full", full)
    head, last = paths.split_last(F.col("full"))
    return p.select(F.col("p_partkey").alias("id"), head.alias("head"), last.alias("last"), paths.strip_generics(F.concat("p_brand", F.lit("<T>::<U>::new<V>"))).alias("plain"), paths.safe_id(F.col("p_brand")).alias("safe"), paths.percent_delta(F.col("p_size"), F.col("p_partkey")).alias("delta"), paths.module_name(F.lit("a/b/__init__.py")).alias("module"))


@query("unresolved_breakdown", f"""WITH {P} SELECT reason, count(*) AS n, min(id) AS example FROM (SELECT id, 'call-' || kind || CASE WHEN visibility = 'public' THEN '-ambiguous' ELSE '-unresolved' END AS reason FROM parts WHERE id % 2 = 1) GROUP BY reason""")
def unresolved(spark, d):
    c = t.parts(spark, d).select("id", F.when(F.col("id") % 2 == 0, F.col("name")).alias("target"), F.concat(F.lit("call-"), "kind", F.when(F.col("visibility") == "public", "-ambiguous").otherwise("-unresolved")).alias("reason"))
    return core.unresolved_breakdown(c)
