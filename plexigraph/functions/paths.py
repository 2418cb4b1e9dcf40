"""Scalar path and name functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plexigraph.model import PRELUDE_TYPES, RECEIVER_TYPES, TRAIT_METHODS


def split_last(path: Column, sep: str = "::") -> tuple[Column, Column]:
    """(all before the last separator or '', last segment)."""
    last = F.substring_index(path, sep, -1)
    return F.when(path.contains(sep), path.substr(F.lit(1), F.length(path) - F.length(last) - len(sep))).otherwise(""), last


def strip_generics(path: Column) -> Column:
    """`a::<T>::b<U>` to `a::b`: segments that start with '<' go, others end before their first '<'."""
    kept = F.filter(F.split(path, "::"), lambda x: (x != "") & ~x.startswith("<"))
    return F.array_join(F.transform(kept, lambda x: F.split(x, "<")[0]), "::")


def call_names(name: Column) -> Column:
    """`a.b.c` as [a.b.c, c]."""
    return F.array_distinct(F.array(name, F.element_at(F.split(name, r"\."), -1)))


def module_name(path: Column) -> Column:
    """A Python file's dotted module name."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_.-]", "_")


def percent_delta(old: Column, new: Column) -> Column:
    return F.when(old == 0, 0.0).otherwise(F.round(100.0 * (new - old) / old, 2))


def line_of(text: Column, byte_offset: Column) -> Column:
    """1-based line of an offset in the text's UTF-8 bytes."""
    head = F.decode(F.encode(text, "UTF-8").substr(F.lit(1), byte_offset), "ISO-8859-1")  # a byte a character
    return F.size(F.split(head, "\n", -1))


def redact(text: Column) -> Column:
    """Home folders and user names in paths replaced."""
    return F.regexp_replace(F.regexp_replace(text, r"/(home|Users)/[^/ ]+", "/~"), r"C:\\Users\\[^\\ ]+", "~")


def relative(path: Column, root: Column) -> Column:
    return F.when(path.startswith(F.concat(root, F.lit("/"))), path.substr(F.length(root) + 2, F.length(path))).otherwise(path)


def normalise(path: Column) -> Column:
    """./ and empty segments gone, a/../ resolved; parent steps that lead out of the path stay in front."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    none = F.array().cast("array<string>")
    last = lambda acc: F.try_element_at(acc, F.size(acc))
    step = lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.array_append(acc, x))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(F.aggregate(parts, none, step), "/"))


def crate_segments(path: Column) -> Column:
    """`crate::a::b` as [a, b]; the root, and what doesn't start with crate::, as []."""
    rest = F.when(path.startswith("crate::"), path.substr(F.lit(8), F.length(path))).otherwise("")
    return F.when(rest == "", F.array().cast("array<string>")).otherwise(F.split(rest, "::"))


def valid_name(text: Column) -> Column:
    """A shell function or variable name: a letter or _, then letters, digits and _."""
    return text.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def prelude_path(name: Column) -> Column:
    """Path of a type that needs no import, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in PRELUDE_TYPES.items() for x in kv]), name)


def trait_path(method: Column) -> Column:
    """Path of a method that one standard trait alone has, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TRAIT_METHODS.items() for x in kv]), method)


def receiver_path(written: Column, method: Column) -> Column:
    """Path of a method on a written receiver type: the first known type that it starts with and that has the method."""
    starts = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.startswith(written, m) | (written == F.trim(m)))
    return F.coalesce(*[F.when(starts(marks) & method.isin(methods), F.concat(F.lit(f"{path}::"), method)) for path, marks, methods in RECEIVER_TYPES])


def strip_comment(line: Column) -> Column:
    """A shell line before an unquoted # that starts a word; quotes aren't tracked over lines."""
    return F.regexp_replace(line, r"(^|[ \t])#[^'\"]*$", "")


def unquote(text: Column) -> Column:
    """Double quotes at both ends gone, then single ones, then commas at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, '^"+|"+$', ""), "^'+|'+$", ""), ",+$", "")
