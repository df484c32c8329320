from pyspark.sql import functions as F

from tessella.functions import scalars as sc
from tessella.operators import facts


def test_scalars(spark):
    df = spark.createDataFrame([("é\r\nab\n", ":a:b-c", "a &lt; b &amp;amp;", "Found"), ("x", "m", "", "Unknown")], "t string, m string, x string, s string")
    r = df.select(
        sc.byte_of(F.col("t"), F.lit(0), F.lit(5)).alias("a"), sc.byte_of(F.col("t"), F.lit(1), F.lit(1)).alias("b"), sc.line_of(F.col("t"), F.lit(4)).alias("c"), sc.utf16_length(F.lit("a😀")).alias("d"),
        sc.module_slug(F.col("m")).alias("e"), sc.decode_entities(F.col("x")).alias("f"), sc.map_found(F.col("s"), F.col("m"), F.upper).alias("g"), sc.strip_ansi(F.lit("\u001b[1mx\u001b[0m")).alias("h"),
    ).collect()
    assert tuple(r[0]) == (2, 5, 1, 3, "a_b_c", "a < b &amp;", ":A:B-C", "x")
    assert r[1].g is None


def test_edits(spark):
    texts = spark.createDataFrame([(1, "fun é() {}"), (2, "abc"), (3, "abc"), (4, "same")], "file long, text string")
    edits = spark.createDataFrame([(1, 0, 0, 3, "val"), (1, 1, 4, 6, "name"), (2, 0, 0, 2, "x"), (2, 1, 1, 3, "y"), (3, 0, 1, 9, "z")], "file long, ord long, start_byte long, end_byte long, new_text string")
    assert {r.file: r.text for r in facts.applied_edits(texts, edits).collect()} == {1: "val name() {}", 2: None, 3: None, 4: "same"}


def test_bindings_and_written_types():
    from tessella.operators.types import bindings, parse_type

    assert bindings("Map<T, List<T>>", "Map<A<B, C>, List<D>>", {"T"}) == {"T": "A<B, C>"}
    assert bindings("List<T>", "Set<A>", {"T"}) == {} and bindings("T", "T", {"T"}) == {}
    assert parse_type("Map<A, B<C>>?") == ("Map", [("A", []), ("B", [("C", [])])])


def test_edits_between_texts():
    from tessella.operators.assist import changed_bytes, rewritten

    assert changed_bytes("abc", "abXc") == {"start": 2, "old_end": 2, "new_end": 3}
    assert changed_bytes("é", "è") == {"start": 0, "old_end": 2, "new_end": 2}
    assert changed_bytes("", "") == {"start": 0, "old_end": 0, "new_end": 0}
    assert changed_bytes("x" * 9000 + "a", "x" * 9000 + "b") == {"start": 9000, "old_end": 9001, "new_end": 9001}
    assert rewritten("fun f() = 1 + 2") == "fun f() { return 1 + 2 }"
    assert rewritten("fun f(): Int { return g(1) }") == "fun f(): Int = g(1)"
    assert rewritten("fun f() { val x = 1; return x }") is None and rewritten("class A { }") is None
