"""Scalar functions over columns."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_of(text: Column, byte: Column) -> Column:
    """Line, from 0, of a byte place in a UTF-8 text; places beyond the end are the end."""
    head = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.least(byte, F.octet_length(text)))
    return F.size(F.filter(F.regexp_extract_all(F.hex(head), F.lit("(..)"), 1), lambda x: x == "0A"))


def position_of(text: Column, byte: Column) -> Column:
    """Struct of ``line`` and ``col`` (UTF-16 units), from 0, of a byte place; within a character its beginning, beyond the end the end."""
    raw = F.encode(text, "UTF-8")
    inside = lambda i: F.coalesce(F.conv(F.hex(F.substring(raw, i + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit(192)) == 128, F.lit(False))
    at = F.least(byte, F.octet_length(text))
    start = F.when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)
    head = F.substring(raw, F.lit(1), start).cast("string")
    line = F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit("")))
    return F.struct(line.alias("line"), utf16_length(F.substring_index(head, "\n", -1)).alias("col"))


def word_at(text: Column, place: Column) -> Column:
    """The word (letters A-Z, digits, _) that a character place is in or beside."""
    before = F.regexp_extract(F.substring(text, F.lit(1), place), r"[A-Za-z0-9_]*\z", 0)
    return F.concat(before, F.regexp_extract(F.substring(text, place + 1, F.length(text)), "^[A-Za-z0-9_]*", 0))


def related_source_sets(path: Column) -> Column:
    """The source set of a path, and the common one if it is a platform's."""
    s = source_set_of(path)
    return F.array_distinct(F.when(s.endswith("Main"), F.array(s, F.lit("commonMain"))).otherwise(F.array(s)))


def coordinate_label() -> Column:
    return F.concat_ws(":", "grp", "artifact", "version")


def sources_path() -> Column:
    """Path of a coordinate's sources in a repository."""
    return F.concat(F.replace(F.col("grp"), F.lit("."), F.lit("/")), F.lit("/"), "artifact", F.lit("/"), "version", F.lit("/"), "artifact", F.lit("-"), "version", F.lit("-sources.jar"))


def utf16_length(text: Column) -> Column:
    """Number of UTF-16 units of a text."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def module_of(path: Column) -> Column:
    """Module of a path: the segments before the first ``src``."""
    s = F.filter(F.split(path, "[/\\\\]"), lambda x: x != "")
    at = F.array_position(s, "src").cast("int")
    name = F.concat(F.lit(":"), F.array_join(F.slice(s, F.lit(1), F.greatest(at - 1, F.lit(0))), ":"))
    return F.when((at > 0) & (F.size(s) > at), name)


def source_set_of(path: Column) -> Column:
    """Segment after the first ``src``."""
    s = F.filter(F.split(path, "[/\\\\]"), lambda x: x != "")
    at = F.array_position(s, "src").cast("int")
    return F.when((at > 0) & (F.size(s) > at), F.element_at(s, F.least(at + 1, F.greatest(F.size(s), F.lit(1)))))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;]*[A-Za-z]", "")


def package_of(fqn: Column) -> Column:
    """What comes before the last dot."""
    return F.when(F.contains(fqn, F.lit(".")), F.regexp_extract(fqn, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def compare_versions(a: str, b: str) -> int:
    """-1, 0 or 1: parts at ``. - _``, both numbers by value, others as text, the longer last."""
    xs, ys = re.split("[.\\-_]", a), re.split("[.\\-_]", b)
    for x, y in zip(xs, ys):
        numbers = all(re.fullmatch(r"\+?[0-9]+", v) and int(v) < 1 << 64 for v in (x, y))
        p, q = (int(x), int(y)) if numbers else (x.encode(), y.encode())
        if p != q:
            return -1 if p < q else 1
    return (len(xs) > len(ys)) - (len(xs) < len(ys))


def greatest_version(versions: Iterable[str]) -> str | None:
    """The greatest version, found in the given order; that comparison is no total order."""
    best = None
    for v in versions:
        if best is None or compare_versions(v, best) > 0:
            best = v
    return best


def byte_of(text: Column, line: Column, col: Column) -> Column:
    """Byte of a line and a character in it, both from 0; lines end at \\n, and their \\r does not count as content."""
    lines = F.split(text, "\n")
    before = F.slice(lines, F.lit(1), line)
    start = F.aggregate(before, F.lit(0), lambda acc, x: acc + F.octet_length(x) + 1)
    content = F.regexp_replace(F.get(lines, line), "\r$", "")
    return start + F.octet_length(F.substring(content, F.lit(1), col))


def map_found(status: Column, value: Column, fn) -> Column:
    """Value of what was found through a function; null for what is absent or unknown."""
    return F.when(status == "Found", fn(value))


def decode_entities(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def module_slug(name: Column) -> Column:
    """Name of a module as part of a file name."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
