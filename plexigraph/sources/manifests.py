"""What manifests say together: members of workspaces, and TypeScript configurations with what they extend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plexigraph.functions.paths import normalise
from plexigraph.operators.resolve import prefixes
from plexigraph.session import by_exchange, store

#: Folders that a member pattern doesn't lead into.
SKIPPED_MEMBERS = ["node_modules", ".git", "target", "fixtures"]


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "(^|/)[^/]*$", "")


def _join(at: Column, rest: Column) -> Column:
    return F.when(at == "", rest).otherwise(F.concat_ws("/", at, rest))


def workspace_members(files: DataFrame, fact: DataFrame) -> DataFrame:
    """(root, pattern, dir) of the Cargo workspaces among files(path), by their `member` facts.

    A pattern without a star is a folder that exists. `prefix/*` is each folder in prefix that has a manifest of its own,
    but for SKIPPED_MEMBERS. Any other pattern gives nothing.
    """
    m = store(fact.filter("fact = 'member'").filter(F.col("path").rlike("(^|/)Cargo\\.toml$")).select(folder(F.col("path")).alias("root"), F.col("name").alias("pattern")).distinct())
    dirs = files.select(F.explode(prefixes(folder(F.col("path")))).alias("dir")).distinct()
    plain = m.filter(~F.col("pattern").contains("*")).withColumn("dir", normalise(_join(F.col("root"), F.col("pattern"))))
    own = files.filter(F.col("path").rlike("(^|/)Cargo\\.toml$")).select(folder(F.col("path")).alias("dir"))
    own = own.filter("dir <> ''").filter(~F.substring_index("dir", "/", -1).isin(SKIPPED_MEMBERS)).withColumn("parent", folder(F.col("dir")))
    star = m.filter(F.col("pattern").rlike(r"^[^*{}]*\*/?$")).withColumn("prefix", F.regexp_replace("pattern", r"/*\*/?$", ""))
    star = star.withColumn("parent", F.when(F.col("prefix") == "", F.col("root")).otherwise(normalise(_join(F.col("root"), F.col("prefix")))))
    return plain.join(by_exchange(dirs), "dir", "left_semi").select("root", "pattern", "dir").unionByName(star.join(by_exchange(own), "parent").select("root", "pattern", "dir"))


def config_chain(fact: DataFrame, depth: int = 8) -> DataFrame:
    """(path, ancestor, distance) of every TypeScript configuration: itself at 0, then what it extends, and so on."""
    configs = fact.filter("language = 'manifest'").filter(F.substring_index("path", "/", -1).rlike(r"^tsconfig.*\.json$")).select("path").distinct()
    configs = store(configs)
    rel = F.col("target")
    named = F.when(rel.endswith(".json"), rel).when(rel.rlike(r"[^/.][^/]*\.[^/.]*$"), F.regexp_replace(rel, r"\.[^/.]*$", ".json")).otherwise(F.concat(rel, F.lit(".json")))
    up = fact.filter("fact = 'extends'").select(F.col("path").alias("ancestor"), normalise(_join(folder(F.col("path")), named)).alias("parent"))
    up, there = store(up), configs.select(F.col("path").alias("ancestor"))
    now = configs.select("path", F.col("path").alias("ancestor"), F.lit(0).alias("distance"))
    out = now
    for d in range(1, depth + 1):
        step = now.join(by_exchange(up), "ancestor").select("path", F.col("parent").alias("ancestor"), F.lit(d).alias("distance"))
        now = store(step.join(by_exchange(there), "ancestor", "left_semi"))
        if now.isEmpty():
            break
        out = out.unionByName(now.select(out.columns))
    return out


def config_bases(fact: DataFrame, chain: DataFrame) -> DataFrame:
    """(path, base_url): the nearest base folder on each configuration's chain, from the folder of the one that says it."""
    b = fact.filter("fact = 'base-url'").select(F.col("path").alias("ancestor"), normalise(_join(folder(F.col("path")), F.col("target"))).alias("base"))
    best = chain.join(by_exchange(b), "ancestor").groupBy("path").agg(F.min(F.struct("distance", "base")).alias("m"))
    return best.select("path", F.col("m.base").alias("base_url"))


def config_mappings(fact: DataFrame, chain: DataFrame) -> DataFrame:
    """(path, pattern, target): path mappings of each configuration; of one pattern, the nearest configuration's count."""
    m = fact.filter("fact = 'mapping'").select(F.col("path").alias("ancestor"), F.col("name").alias("pattern"), "target")
    every = chain.join(by_exchange(m), "ancestor")
    near = every.groupBy("path", "pattern").agg(F.min("distance").alias("distance"))
    return every.join(by_exchange(near), ["path", "pattern", "distance"], "left_semi").select("path", "pattern", "target").distinct()
