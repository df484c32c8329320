"""What editors ask at a position: completion context, signatures, edits of imports and bodies."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..sources import kotlin

_WORD = r"[\p{IsAlphabetic}\p{N}_]"


def completion_context(text: Column, offset: Column, in_literal: Column, in_import: Column, selector: Column) -> Column:
    """``None``, ``Import``, ``AfterDot`` or ``ScopeName`` at a character of a text, tested in this order.

    Literals and comments come first; then imports and packages, by the tree or
    by how the line begins; then a member's selector, by the tree or by a dot
    before what is typed; the rest are names in scope.
    """
    before = F.substring(text, F.lit(1), offset)
    line = F.ltrim(F.substring_index(before, "\n", -1))
    return (
        F.when(in_literal, "None")
        .when(in_import | line.rlike(r"\A[ \t]*(import|package) "), "Import")
        .when(selector | before.rlike(rf"\.[ \t]*{_WORD}*\z"), "AfterDot")
        .otherwise("ScopeName")
    )


def active_parameter(text: Column) -> Column:
    """Number of the argument, from 0, that a text from a call's opening bracket on ends in: commas at depth one."""
    chars = F.regexp_extract_all(text, F.lit(r"[(\[{)\]},]"), 0)
    deeper, out = F.lit("([{"), F.lit(")]}")
    step = lambda acc, x: F.struct(
        (acc["depth"] + F.when(F.instr(deeper, x) > 0, 1).when(F.instr(out, x) > 0, -1).otherwise(0)).alias("depth"),
        (acc["n"] + F.when((x == ",") & (acc["depth"] == 1), 1).otherwise(0)).alias("n"),
    )
    return F.aggregate(chars, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n")), step, lambda acc: acc["n"])


def signatures(calls: DataFrame, symbols: DataFrame, params: DataFrame) -> DataFrame:
    """``call_id``, ``active``, ``labels`` (sorted, each once) of calls (``call_id``, ``name``, ``arguments``: the text from the bracket on)."""
    p = params.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("pos", "type"))).alias("ps"))
    s = symbols.where(F.col("kind").isin("Function", "Class", "Interface", "Object", "EnumClass", "TypeAlias", "TypeParameter")).join(p, "sid", "left")
    shown = F.array_join(F.transform(F.coalesce("ps", F.array().cast("array<struct<pos:int,type:string>>")), lambda x: F.concat(F.lit("p"), x["pos"] + 1, F.lit(": "), x["type"])), ", ")
    label = F.concat("name", F.lit("("), shown, F.lit(")"), F.when(F.col("value_type").isNotNull(), F.concat(F.lit(": "), "value_type")).otherwise(F.lit("")))
    by_name = s.select("name", label.alias("label")).distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("labels"))
    return calls.join(by_name, "name").select("call_id", active_parameter(F.col("arguments")).alias("active"), "labels")


def line_range(text: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Places (from 0, the end not included) of the whole lines that a stretch of a text lies in, with their line end."""
    before = F.substring(text, F.lit(1), start)
    lo = F.length(before) - F.length(F.substring_index(before, "\n", -1))
    at = F.instr(F.substring(text, end + 1, F.length(text)), F.lit("\n"))
    return lo, F.when(at > 0, end + at).otherwise(F.length(text))


def removed_imports(texts: DataFrame, unused: DataFrame) -> DataFrame:
    """``file``, ``start``, ``stop``, ``new_text``: edits that take out the lines of unused imports (``file``, ``start``, ``stop``); none in files with errors."""
    j = texts.where("clean").join(unused.withColumnRenamed("start", "s").withColumnRenamed("stop", "e"), "file")
    lo, hi = line_range(F.col("text"), F.col("s"), F.col("e"))
    return j.select("file", lo.alias("start"), hi.alias("stop"), F.lit("").alias("new_text")).distinct()


def added_import(texts: DataFrame, wanted: DataFrame, resolved: DataFrame) -> DataFrame:
    """``file``, ``line``, ``new_text``: an import line for wanted names (``file``, ``fqn``, ``line``) that do not resolve; none in files with errors."""
    w = wanted.join(resolved.select("file", "fqn"), ["file", "fqn"], "left_anti").join(texts.where("clean").select("file"), "file", "left_semi")
    return w.select("file", "line", F.concat(F.lit("import "), "fqn", F.lit("\n")).alias("new_text"))


def rewritten(text: str) -> str | None:
    """A function with its body in the other form: ``= x`` for ``{ return x }`` and back; None where neither fits."""
    tokens, clean = kotlin.lex(text)
    tokens = [t for t in tokens if t.kind not in ("comment", "doc")]
    data, depth, fun = text.encode(), 0, False
    if not clean:
        return None
    for i, t in enumerate(tokens):
        fun = fun or t.text == "fun"
        if fun and depth == 0 and t.text == "=":
            expr = data[t.end : tokens[-1].end].decode().strip()
            return data[: t.start].decode() + f"{{ return {expr} }}" if expr else None
        if fun and depth == 0 and t.text == "{":
            inner = tokens[i + 1 : -1]
            if tokens[-1].text != "}" or not inner or inner[0].text != "return" or len(inner) < 2:
                return None
            level = 0
            for a, b in zip(inner, inner[1:]):  # a second statement
                level += (a.text in "([{") - (a.text in ")]}")
                if level == 0 and (a.text == ";" or b.fresh and b.text not in (".", "?.", "?:")):
                    return None
            return data[: t.start].decode() + "= " + data[inner[0].end : tokens[-1].start].decode().strip()
        depth += (t.text in "([{<") - (t.text in ")]}>") if fun and len(t.text) == 1 else 0
    return None


@F.arrow_udf(StringType())
def rewritten_body(text: pa.Array) -> pa.Array:
    """:func:`rewritten` of a column."""
    return pa.array([rewritten(t) if t is not None else None for t in text.to_pylist()], pa.string())


def changed_bytes(old: str, new: str) -> dict[str, int]:
    """The one edit between two texts, between their common beginning and end, at whole characters: places in bytes."""
    a, b = old.encode(), new.encode()
    cut = lambda x, i: i >= len(x) or x[i] & 0xC0 != 0x80
    start = 0
    limit = min(len(a), len(b))
    step = 1 << 12
    while start < limit and a[start : start + step] == b[start : start + step] and start + step <= limit:
        start += step
    while start < limit and a[start] == b[start]:
        start += 1
    while start and not (cut(a, start) and cut(b, start)):
        start -= 1
    same = 0
    while same < limit - start and a[len(a) - 1 - same] == b[len(b) - 1 - same]:
        same += 1
    x, y = len(a) - same, len(b) - same
    while x < len(a) and y < len(b) and not (cut(a, x) and cut(b, y)):
        x, y = x + 1, y + 1
    return {"start": start, "old_end": x, "new_end": y}


@F.arrow_udf(StructType([StructField(x, IntegerType()) for x in ("start", "old_end", "new_end")]))
def edit_between(old: pa.Array, new: pa.Array) -> pa.Array:
    """:func:`changed_bytes` of columns."""
    rows = [changed_bytes(x, y) if x is not None and y is not None else None for x, y in zip(old.to_pylist(), new.to_pylist())]
    return pa.array(rows, pa.struct([("start", pa.int32()), ("old_end", pa.int32()), ("new_end", pa.int32())]))
