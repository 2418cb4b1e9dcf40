"""Node and edge algebra: first-wins dedup, ordinals, integrity, counts, tiers and paging.

Every function takes and returns DataFrames and leaves partitioning to adaptive execution. Where
"first" matters the order is an explicit list of columns that must be total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plexigraph.model import TIERS
from plexigraph.session import hold


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in `order`. An aggregate of structs, so rows shrink before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    lead = order + [c for c in rest if c not in order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*[c for c in lead if c not in keys])).alias("__m"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"__m.{k}").alias(k) for k in df.columns])


def edge_dedup_max(edges: DataFrame, keys: list[str] | None = None, weight: str = "confidence") -> DataFrame:
    return edges.groupBy(*(keys or ["source", "target"])).agg(F.max(weight).alias(weight))


def disambiguate_ids(symbols: DataFrame, id_col: str, line: str, order: list[str]) -> DataFrame:
    """Later holders of an id get `::_L<line>` appended."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(*order))
    later = F.concat(F.col(id_col), F.lit("::_L"), F.col(line).cast("string"))
    return symbols.withColumn("__rank", rank).withColumn("unique_id", F.when(F.col("__rank") > 1, later).otherwise(F.col(id_col))).drop("__rank")


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based position within each key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def external_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Minimal nodes for CALLS targets that no node has; the name is the last `::` segment."""
    missing = edges.filter(F.col("edge_type") == "CALLS").select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return missing.select("id", F.lit("symbol").alias("label"), F.substring_index("id", "::", -1).alias("name"), F.lit(True).alias("is_external"))


def drop_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("node_count"), F.count_if(F.col("label") == "symbol").alias("symbol_count"), F.count_if(F.col("label") == "diagnostic").alias("diagnostic_count"))
    e = edges.agg(F.count("*").alias("edge_count"), *[F.count_if(F.col("edge_type") == t).alias(f"{t.lower()}_count") for t in ("CALLS", "DESIGNATION", "ACCESSES")])
    return n.join(e)  # one row each


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, kind, n): one pass over nodes by label and kind, one over edges by type."""
    by = nodes.groupingSets([["label"], ["kind"]], "label", "kind").agg(F.count("*").alias("n"), F.grouping("label").alias("g"))
    sections = by.select(F.when(F.col("g") == 0, "label").otherwise("kind").alias("section"), F.coalesce("label", "kind", F.lit("none")).alias("kind"), "n")
    return sections.unionByName(edges.groupBy(F.col("edge_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("section"), "kind", "n"))


def quality_gates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(gate, failures, passed) for the seven gates; the last two can't fail.

    One pass over the nodes counts their ids. One over the edges counts each (type, source, target) once; its two ends,
    as rows with a weight, meet the ids in one join, and one aggregate adds up all gates.
    """
    ids = nodes.groupBy("id").agg(F.count("*").alias("copies"))
    unique = edges.groupBy("edge_type", "source", "target").agg(F.count("*").alias("n"))
    calls = F.col("edge_type") == "CALLS"
    end = lambda c, side: F.struct(F.col(c).alias("id"), F.lit(side).alias("side"))
    ends = unique.select("n", calls.alias("call"), F.inline(F.array(end("source", 0), end("target", 1)))).groupBy("id").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("s"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("call"), F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("side") == 0, F.col("n") - 1).otherwise(0)).alias("more")
    )
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    lost = lambda c: total(F.when(F.col("copies").isNull(), F.col(c)))
    row = ids.join(ends, "id", "full").agg(total(F.col("copies") - 1).alias("duplicate_nodes"), total("more").alias("duplicate_edges"), lost("s").alias("dangling_source"), lost("t").alias("dangling_target"), lost("c").alias("calls_endpoint_integrity"))
    zero = F.lit(0).cast("long")
    gates = [(g, F.col(g)) for g in ("duplicate_nodes", "duplicate_edges", "dangling_source", "dangling_target", "calls_endpoint_integrity")] + [("deterministic", zero), ("external_symbol_marking", zero)]
    return row.select(F.inline(F.array(*[F.struct(F.lit(g).alias("gate"), n.alias("failures")) for g, n in gates]))).withColumn("passed", F.col("failures") == 0)


def tier(confidence: str | Column) -> Column:
    """high, medium, low, or unknown where there is no confidence."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c.isNull(), "unknown").when(c >= TIERS[0][1], TIERS[0][0]).when(c >= TIERS[1][1], TIERS[1][0]).otherwise("low")


def confidence_tiers(edges: DataFrame) -> DataFrame:
    """(edge_type, tier, n, rate): the share within the edge type."""
    by = edges.groupBy("edge_type", tier("confidence").alias("tier")).agg(F.count("*").alias("n"))
    return by.withColumn("rate", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("edge_type")), 4))


def confidence_summary(edges: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return edges.groupBy("edge_type").agg(F.min(c).alias("min_confidence"), F.round(F.avg(c.cast("decimal(18,4)")).cast("double"), 4).alias("avg_confidence"), F.max(c).alias("max_confidence"), F.count(c).alias("n"))


def quality_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many edges hold both ends, tiers of calls, and rates."""
    ids = nodes.select(F.col("id").alias("source")).distinct()
    known = edges.join(ids.withColumn("__k", F.lit(True)), "source", "left")
    calls = F.col("edge_type") == "CALLS"
    return known.agg(
        F.count("*").alias("edge_count"),
        F.count_if(F.col("__k").isNull()).alias("dangling_edge_count"),
        F.count_if(calls).alias("call_count"),
        *[F.count_if(calls & (tier("confidence") == t)).alias(f"call_{t}") for t in ("high", "medium", "low", "unknown")],
        F.round(F.count_if(calls & (F.col("confidence") >= 0.6)) / F.greatest(F.count_if(calls), F.lit(1)), 4).alias("call_trusted_rate"),
    )


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every endpoint, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.id").alias("id")).agg(F.sum("e.i").alias("fan_in"), F.sum("e.o").alias("fan_out"))


def unresolved_breakdown(calls: DataFrame) -> DataFrame:
    """(reason, n, example) of calls without a target; examples are the smallest ids."""
    return calls.filter(F.col("target").isNull()).groupBy("reason").agg(F.count("*").alias("n"), F.min("id").alias("example"))


def module_rollup(symbols: DataFrame) -> DataFrame:
    """(module, symbol_count, public_count) of each module."""
    return symbols.groupBy("module").agg(F.count("*").alias("symbol_count"), F.count_if(F.col("visibility").isin("pub", "public")).alias("public_count"))


def page_slice(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Rows of a 0-based page in a total order with total, has_more and has_prev; size 0 is all rows.

    The total is counted in its own pass, so no window sees all rows in one task.
    """
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order)
    rows = rows if size == 0 else rows.offset(page * size).limit(size)
    end = F.lit((page + 1) * size if size else 0)
    return rows.join(F.broadcast(total)).withColumn("has_more", (F.lit(size) > 0) & (F.col("total") > end)).withColumn("has_prev", F.lit(size > 0 and page > 0))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `name`, its 1-based place in a total order. Range-partitioned: places are local, offsets by partition.

    The parts and their places are written once, so the counts and the rows come from the same partitioning.
    """
    ranked = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    local = hold(ranked.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order))))
    counts = local.groupBy("__p").agg(F.count("*").alias("__n"))
    base = counts.withColumn("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return local.join(F.broadcast(base.select("__p", "__b")), "__p").withColumn(name, (F.col("__b") + F.col("__r")).cast("long")).drop("__p", "__r", "__b")


def renumber(df: DataFrame, order: list[str], prefix: str = "n") -> DataFrame:
    """Stable ids n0, n1, ... in a total order."""
    return numbered(df, order, "__place").withColumn("stable_id", F.concat(F.lit(prefix), (F.col("__place") - 1).cast("string"))).drop("__place")


def merge_artifacts(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of per-file artifacts in any order, deduplicated by id: the result doesn't depend on it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return first_by(out, ["id"], order)


#: Node kinds that count as symbols whatever their label.
SYMBOL_KINDS = ["function", "struct", "enum", "trait", "method", "associated-function", "class", "const", "static"]


def symbols_of(nodes: DataFrame) -> DataFrame:
    """(id, name, kind, file, line, module, visibility) of the symbols among mixed nodes.

    nodes(id, label, name, file, line, properties map<string,string>): what the properties say of a name, kind, file or
    line comes before the node's own columns, symbolKind before kind; an unsaid visibility is unknown.
    """
    p = lambda k: F.col("properties")[k]
    kind = F.coalesce(p("symbolKind"), p("kind"))
    found = nodes.filter((F.col("label") == "symbol") | F.coalesce(kind.isin(SYMBOL_KINDS), F.lit(False)))
    text = lambda *c: F.coalesce(*c, F.lit(""))
    return found.select("id", text(p("name"), F.col("name")).alias("name"), F.coalesce(kind, F.lit("symbol")).alias("kind"), text(p("sourcePath"), F.col("file")).alias("file"), F.coalesce(p("lineStart").cast("long"), F.col("line").cast("long")).alias("line"), text(p("modulePath")).alias("module"), F.coalesce(p("visibility"), F.lit("unknown")).alias("visibility"))


def external_crate_totals(calls: DataFrame) -> DataFrame:
    """One row: calls into external crates, and those whose crate is known."""
    return calls.agg(F.count_if(F.col("call_kind") == "external-crate").alias("total"), F.count_if(F.col("known_crate").isNotNull()).alias("classified"))


#: Names of functions that programs start from.
ENTRY_NAMES = ["main", "run", "start", "init"]


def compact_profile(symbols: DataFrame, risks: DataFrame) -> DataFrame:
    """(section, item, rank): at most 10 entry points, 30 public symbols in file order, the 20 largest modules and 10 risks(item, rank)."""
    s = lambda section, df, item, rank: df.select(F.lit(section).alias("section"), item.alias("item"), rank.cast("long").alias("rank"))
    entry = symbols.filter(F.lower("name").isin(ENTRY_NAMES)).orderBy("file", "line_start", "id").limit(10)
    shown = symbols.filter(F.col("visibility").isin("pub", "public")).orderBy("file", "line_start", "name", "id").limit(30)
    modules = module_rollup(symbols).orderBy(F.desc("symbol_count"), "module").limit(20)
    risky = risks.orderBy(F.desc("rank"), "item").limit(10)
    return s("entry", entry, F.col("name"), F.col("id")).unionByName(s("symbol", shown, F.col("name"), F.col("id"))).unionByName(s("module", modules, F.col("module"), F.col("symbol_count"))).unionByName(s("risk", risky, F.col("item"), F.col("rank")))
