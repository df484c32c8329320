import random

from tessella.sources import java, kotlin

TEXT = """package demo.app;
import java.util.List;
import java.io.*;
import static a.B.c;
@Deprecated(since = "1")
public final class Box<T extends Comparable<T>> extends Base<T> implements Shape, java.io.Closeable {
    private static final int MAX = 3, MIN;
    private Map<String, List<T>> byName = new HashMap<>();
    public Box(int n) { int local = n; }
    @Override public <R> R map(Fn<T, R> f, int... rest) throws IOException { return f.apply(1, 2); }
    abstract void close();
    static { init(); }
    enum Color { RED(1) { int f() { return 1; } }, GREEN; int rgb; Color() {} }
    interface Inner { int size(); default boolean empty() { return size() == 0; } }
}
record Point(int x, List<String> names) implements Shape { Point { check(); } static Point of() { return null; } }
"""


def test_declarations():
    p = java.parse(TEXT)
    assert p.clean and p.package == "demo.app"
    assert p.imports == [("java.util.List", None, False), ("java.io", None, True)]
    got = {(s["container"], s["name"], s["kind"]) for s in p.symbols}
    assert got == {
        (None, "Box", "Class"), ("Box", "MAX", "Property"), ("Box", "MIN", "Property"), ("Box", "byName", "Property"), ("Box", "Box", "Function"), ("Box", "map", "Function"), ("Box", "close", "Function"),
        ("Box", "Color", "EnumClass"), ("Color", "RED", "EnumEntry"), ("Color", "GREEN", "EnumEntry"), ("Color", "rgb", "Property"), ("Color", "Color", "Function"), ("Box", "Inner", "Interface"), ("Inner", "size", "Function"), ("Inner", "empty", "Function"),
        (None, "Point", "Class"), ("Point", "x", "Property"), ("Point", "x", "Function"), ("Point", "names", "Property"), ("Point", "names", "Function"), ("Point", "of", "Function"),
    }
    s = {(x["container"], x["name"]): x for x in p.symbols}
    assert s[None, "Box"]["supertypes"] == ["Base", "Closeable", "Shape"] and s[None, "Point"]["supertypes"] == ["Shape"]
    assert [s["Box", "map"][k] for k in ("arity", "min_arity", "vararg", "type")] == [2, 1, True, "R"]
    data = TEXT.encode()
    assert all(data[a:b].decode() == n for n, a, b in p.usages) and "local" in {n for n, _, _ in p.usages}


def test_never_fails():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = sorted(rnd.sample(range(len(TEXT)), 2))
        t = list(TEXT[a:b])
        for _ in range(rnd.randrange(6)):
            t.insert(rnd.randrange(len(t) + 1), rnd.choice("(){}<>\"'.,:;=@é "))
        java.parse("".join(t))


def test_by_extension(spark):
    df = spark.createDataFrame([("A.java", "class A {}"), ("b.kt", "fun f() = 1")], "path string, text string")
    assert sorted((r["name"], r["kind"]) for r in kotlin.extract(df, "symbols").collect()) == [("A", "Class"), ("f", "Function")]
