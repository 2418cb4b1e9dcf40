"""Line-oriented text operators: exploded lines, flags, references, snippets, sections and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def lines(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_no from 1, line)."""
    return files.select(F.col(path).alias("path"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("__p", "line")).select("path", (F.col("__p") + 1).alias("line_no"), "line")


#: Fixed values: (flag, level, all of these parts, one of these parts) of shell lines with A-Z lower-cased.
RISKS = [("curl_pipe_shell", "high", ["curl", "|"], [" sh", " bash"]), ("rm_rf", "medium", ["rm -rf"], []), ("chmod_777", "medium", ["chmod 777"], [])]


def risk_flags(rows: DataFrame) -> DataFrame:
    """(path, line_no, flag, level) of lines(path, line_no, line), all rules in one pass; `sudo` counts as a word of its own."""
    low = F.translate("line", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def holds(every: list[str], some: list[str]) -> Column:
        out = F.lit(True)
        for x in every:
            out = out & low.contains(x)
        return out & F.exists(F.array(*[F.lit(x) for x in some]), lambda x: F.contains(low, x)) if some else out

    flag = lambda f, lv: F.struct(F.lit(f).alias("flag"), F.lit(lv).alias("level"))
    found = [F.when(holds(every, some), flag(f, lv)) for f, lv, every, some in RISKS]
    found.append(F.when(F.array_contains(F.split(low, r"(?U)\s+"), "sudo"), flag("sudo_command", "medium")))
    return rows.select("path", "line_no", F.inline(F.array_compact(F.array(*found))))


def local_refs(rows: DataFrame) -> DataFrame:
    """(path, ref): local paths that a file's lines name, each once.

    The source of a COPY; words with a slash inside, over three bytes, without colon or `${`, that start with neither a
    slash nor a dash; and what follows `cd`. Closing punctuation goes: `;`, then `&`, `|`, quotes and commas, in this order.
    """
    words = F.filter(F.split("line", r"(?U)\s+"), lambda w: w != "")
    w = rows.select("path", words.alias("w"), F.col("line").rlike(r"^\s*COPY ").alias("copy"))
    copied = F.filter(F.slice("w", 2, 1), lambda x: F.col("copy") & ~x.startswith("/") & ~x.contains(":") & x.contains("/"))
    plain = F.transform("w", lambda x: F.regexp_replace(x, r""",*'*"*\|*&*;*$""", ""))
    plain = F.filter(plain, lambda x: x.contains("/") & ~x.startswith("/") & ~x.startswith("-") & ~x.contains(":") & ~x.contains("${") & (F.octet_length(x) > 3))
    after = F.transform("w", lambda x, k: F.when((k > 0) & (F.get("w", k - 1) == "cd"), F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r'^"+|"+$', ""), r"^'+|'+$", ""), r"\|*&*;*$", "")))
    entered = F.filter(F.array_compact(after), lambda x: (x != "") & ~x.isin(".", "..") & ~x.startswith("/") & ~x.startswith("-") & ~x.contains("$"))
    return w.select("path", F.explode(F.array_distinct(F.concat(copied, plain, entered))).alias("ref")).distinct()


#: Parts of a lower-cased path that mark documents, and tests.
DOC_MARKS = [".md", ".rst", ".txt", "doc/", "docs/", "readme"]
TEST_MARKS = ["test_", "_test.", "tests/", "spec.", "mock.", "fixture"]


def path_roles(path: Column) -> Column:
    """struct(doc, test) of a path; both may hold."""
    has = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(F.lower(path), m))
    return F.struct(has(DOC_MARKS).alias("doc"), has(TEST_MARKS).alias("test"))


def snippet(text: Column, start: Column, end: Column, context: int) -> Column:
    """Lines start - context to end + context (from 1), as far as there are any."""
    parts = F.split(text, "\n", -1)
    lo = F.greatest(start - context, F.lit(1))
    return F.array_join(F.slice(parts, lo, F.greatest(F.least(end + context, F.size(parts)) - lo + 1, F.lit(0))), "\n")


def carry_heading(rows: DataFrame, is_heading: Column) -> DataFrame:
    """rows(path, line_no, line) with `section`, the last heading at or above each line. Per file, as in its order."""
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w))


def brace_depth(rows: DataFrame) -> DataFrame:
    """rows with `depth`, the braces open before each line of its file."""
    delta = F.length(F.regexp_replace("line", r"[^{]", "")) - F.length(F.regexp_replace("line", r"[^}]", ""))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("depth", F.coalesce(F.sum(delta).over(w), F.lit(0)))


def majority(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n): the most frequent value, the smaller of equals."""
    by = rows.groupBy(*group, value).agg(F.count("*").alias("n"))
    return by.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias(value), (-F.col("m.k")).alias("n"))


def caption(values: Column, shown: int) -> Column:
    """'a, b, c (+n more)' of the sorted distinct values."""
    v = F.array_sort(F.array_distinct(values))
    return F.concat(F.array_join(F.slice(v, 1, shown), ", "), F.when(F.size(v) > shown, F.concat(F.lit(" (+"), (F.size(v) - shown).cast("string"), F.lit(" more)"))).otherwise(""))


def markdown_links(rows: DataFrame) -> DataFrame:
    """(path, line_no, label, target) of [label](target) in lines outside code fences."""
    fence = F.col("line").rlike("^[ ]{0,3}```")
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    open_ = rows.withColumn("__f", F.sum(fence.cast("int")).over(w) % 2 == 1).filter(~F.col("__f") & ~fence)
    hits = F.arrays_zip(F.regexp_extract_all("line", F.lit(r"\[([^\]]*)\]\(([^)]*)\)"), F.lit(1)).alias("label"), F.regexp_extract_all("line", F.lit(r"\[([^\]]*)\]\(([^)]*)\)"), F.lit(2)).alias("target"))
    return open_.select("path", "line_no", F.inline(hits))


def code_mentions(rows: DataFrame) -> DataFrame:
    """(path, line_no, name): names in `inline code` of lines."""
    return rows.select("path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("`([A-Za-z_][A-Za-z0-9_:]*)(\\(\\))?`"), F.lit(1)))).alias("name"))
