import io
import json
import zipfile

import pytest

from tessella.functions.scalars import compare_versions, greatest_version
from tessella.sources import builds, files, logs


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_read_sources(spark, tmp_path):
    for p, data in {"a/src/main/A.kt": b"class A", "a/build/B.kt": b"class B", "a/build/generated/source/G.java": b"class G {}", ".hid/C.kt": b"x", "a/src/bad.kt": b"\xff\xfe", "a/readme.txt": b"x"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(data)
    got = rows(files.read_sources(spark, str(tmp_path)), "path", "language", "text")
    assert got == [("a/build/generated/source/G.java", "java", "class G {}"), ("a/src/main/A.kt", "kotlin", "class A")]


def test_archives(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n in ("k/A.kt", "../evil.kt", "k/B.java", "k/C.class", "/abs.kt"):
            z.writestr(n, f"// {n}")
    df = spark.createDataFrame([("x.jar", bytearray(b.getvalue())), ("bad.jar", bytearray(b"zip"))], "path string, content binary")
    assert rows(files.archive_entries(df), "archive", "entry") == [("x.jar", "k/A.kt"), ("x.jar", "k/B.java")]
    assert rows(files.archive_entries(df, only=["/B.java"]), "entry") == [("k/B.java",)]
    assert files.sharded(files.archive_entries(df), 2).select("shard").distinct().count() >= 1
    names = spark.createDataFrame([("a/b/C.class",), ("a/b/C$D.class",), ("module-info.class",), ("a/package-info.class",)], "name string")
    assert rows(files.class_stubs(names), "fqn", "stub") == [("a.b.C", "class C")]
    jars = spark.createDataFrame([("org.x", "org/x/y/Z.class"), ("org.q", "org/q/Z.class")], "grp string, entry string")
    imports = spark.createDataFrame([("org.x.y.Z",), ("org.x.y.Q",)], "fqn string")
    assert rows(files.archives_of_imports(imports, jars), "fqn", "grp") == [("org.x.y.Z", "org.x")]


def test_catalog(spark):
    toml = """
[versions]
k = "2.0"
rich = { strictly = "1.5" }
[libraries]
a = "g.a:x:1.0"
b = { module = "g.b:y", version.ref = "k" }
c = { group = "g.c", name = "z", version.ref = "rich" }
bom = { module = "g.d:d-bom", version = "3.1" }
managed = { module = "g.d:core" }
loose = { module = "g.e:core" }
"""
    df = spark.createDataFrame([("libs.versions.toml", toml), ("broken", "= =")], "path string, text string")
    assert rows(builds.catalog_libraries(df).where("version is not null"), "grp", "artifact", "version") == [("g.a", "x", "1.0"), ("g.b", "y", "2.0"), ("g.c", "z", "1.5"), ("g.d", "core", "3.1"), ("g.d", "d-bom", "3.1")]


def test_build_literals(spark):
    text = "implementation(platform(\"g.d:d-bom:3.1\"))\nimplementation('g.d:core')\napi(\"g.x:y:1\")\napi(\"g.z:q\")\nprintln(\"a:b:c:d\")"
    df = spark.createDataFrame([("build.gradle.kts", text)], "path string, text string")
    cached = spark.createDataFrame([("g.z", "q", "9")], "grp string, artifact string, version string")
    assert rows(builds.build_literals(df, cached), "grp", "artifact", "version") == [("g.d", "core", "3.1"), ("g.d", "d-bom", "3.1"), ("g.x", "y", "1"), ("g.z", "q", "9")]


def test_metadata(spark):
    module = json.dumps({"variants": [{"dependencies": [{"group": "a", "module": "b", "version": {"prefers": "3", "strictly": "2"}}, {"module": "x"}]}, {}]})
    assert rows(builds.module_dependencies(spark.createDataFrame([("m", module), ("bad", "{")], "path string, text string")), "grp", "artifact", "version") == [("a", "b", "2")]
    pom = "<project><groupId>g</groupId><version>7</version><properties><v.x>4</v.x></properties><dependencyManagement><dependencies><dependency><groupId>no</groupId><artifactId>no</artifactId></dependency></dependencies></dependencyManagement><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>a</artifactId><version>${v.x}</version><scope>test</scope></dependency><dependency><groupId>h</groupId><artifactId>b</artifactId><version>${project.version}</version><optional>true</optional></dependency></dependencies></project>"
    got = builds.pom_dependencies(spark.createDataFrame([("p", pom)], "path string, text string")).collect()
    assert sorted((r.grp, r.artifact, r.version, r.scope, r.optional) for r in got) == [("g", "a", "4", "test", False), ("h", "b", "7", None, True)]


def test_classpath(spark):
    text = "chatter\nPROJECT\t:a\t/p/a\nCP\t/j/1.jar\nCP\t/j/2.jar\nUNRESOLVED\tx:y\tnot found\nEND\t:a\nCP\t/lost.jar\nPROJECT\t:b\t/p/b\nCP\t/j/3.jar"
    df = spark.createDataFrame(list(enumerate(text.split("\n"))), "n long, line string")
    assert rows(builds.classpath_dump(df), "module", "kind", "ord", "entry") == [(":a", "CP", 1, "/j/1.jar"), (":a", "CP", 2, "/j/2.jar"), (":a", "UNRESOLVED", 1, "x:y: not found"), (":b", "CP", 1, "/j/3.jar")]
    paths = spark.createDataFrame([("/c/files-2.1/g.x/art/1.2/abc/art-1.2-sources.jar",), ("/c/files-2.1/g/a/1/h/b.jar",), ("/x/y",)], "path string")
    assert rows(builds.cache_coordinates(paths), "grp", "artifact", "version") == [("g.x", "art", "1.2")]


def test_compiler_output(spark):
    lines = ["e: /a b/F.kt: (3, 7): bad thing", "w: file:///a b/G.kt:10:2 careful", "\u001b[31me: file:///C:/x/H.kt:1:2: oops\u001b[0m", "note", "e: nothing here"]
    df = spark.createDataFrame(list(enumerate(lines)), "n long, line string")
    assert rows(logs.compiler_messages(df), "n", "path", "line", "col", "severity", "message") == [(0, "/a b/F.kt", 3, 7, "Error", "bad thing"), (1, "/a b/G.kt", 10, 2, "Warning", "careful"), (2, "C:/x/H.kt", 1, 2, "Error", "oops")]
    out = spark.createDataFrame([(0, "> Task :a:compileKotlin")], "n long, line string")
    assert logs.task_executed(out).first().executed and not logs.task_executed(df).first().executed


def test_jsonl_and_trace(spark, tmp_path):
    lines = spark.createDataFrame([('{"ts_ms": 5, "wall_ms": 1.5, "executed": true}',), ("",), ("{broken",)], "value string")
    good, skipped = logs.read_jsonl(lines, logs.TELEMETRY)
    assert [r.wall_ms for r in good.collect()] == [1.5] and skipped.first().skipped == 1
    logs.append_jsonl(good, f"file://{tmp_path}/t")
    logs.append_jsonl(good, f"file://{tmp_path}/t")
    assert spark.read.json(f"file://{tmp_path}/t").count() == 2
    events = spark.createDataFrame([("b", 2), ("a", 1)], "name string, ts long")
    assert [e["name"] for e in json.loads(logs.chrome_trace(events).first().document)["traceEvents"]] == ["a", "b"]
    d = spark.createDataFrame([("F.kt", 0, 4, "Error", "X1", "no"), ("F.kt", 1, 0, "Hint", None, "hm")], "path string, line int, col int, severity string, code string, message string")
    assert rows(logs.diagnostic_lines(d), "value") == [("F.kt:1:5: error[X1]: no",), ("F.kt:2:1: hint: hm",)]


def test_profile(spark):
    g = lambda n, y, x, w: f'<g><title>{n} ({w} samples, 1.0%)</title><rect x="1" y="{y}" width="2" fg:x="{x}" fg:w="{w}"/></g>'
    svg = g("all", 64, 0, 10) + g("a&lt;T&gt;", 48, 0, 10) + g("b", 32, 0, 4) + g("c", 32, 4, 3)
    frames = logs.flame_frames(spark.createDataFrame([(svg,)], "text string"))
    assert rows(logs.self_time(frames), "name", "samples") == [("a<T>", 3), ("b", 4), ("c", 3)]


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/snap"
    assert logs.read_snapshot(spark, path, "k", "a int") is None
    logs.write_snapshot(spark.createDataFrame([(1,)], "a int"), path, "k")
    assert logs.read_snapshot(spark, path, "k", "a int").count() == 1
    s = spark.createDataFrame([("r", f"k{i}", i) for i in range(4)], "root string, key string, made int")
    assert rows(logs.retained(s), "key") == [("k2",), ("k3",)]


@pytest.mark.parametrize(("a", "b", "want"), [("1.10", "1.9", 1), ("1.0", "1.0.0", -1), ("1a", "2", -1), ("2", "10", -1), ("10", "1a", -1), ("1-rc", "1-rc", 0)])
def test_versions(a, b, want):
    assert compare_versions(a, b) == want
    assert compare_versions(b, a) == -want
    assert greatest_version([a, b]) in (a, b)


def test_embedded_poms(spark):
    def jar(files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, text in files.items():
                z.writestr(n, text)
        return bytearray(b.getvalue())

    pom = "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>"
    rows_ = [("x.jar", jar({"META-INF/maven/g/x/pom.xml": pom, "other/pom.xml": pom}), "f1"), ("y.jar", jar({"a.txt": ""}), "f2")]
    df = spark.createDataFrame(rows_, "path string, content binary, fingerprint string")
    first = builds.archive_dependencies(df)
    assert rows(first, "path", "fingerprint", "grp", "artifact", "version") == [("x.jar", "f1", "g", "a", "1")]
    changed = spark.createDataFrame([("x.jar", bytearray(b"not opened"), "f1"), ("z.jar", rows_[0][1], "f3")], "path string, content binary, fingerprint string")
    assert rows(builds.archive_dependencies(changed, first), "path", "fingerprint") == [("x.jar", "f1"), ("z.jar", "f3")]


def test_jars_declaring(spark):
    entries = spark.createDataFrame([("a.jar", "org.x", "org/x/Top.class"), ("a.jar", "org.x", "org/x/y/Outer$In.class"), ("b.jar", "org.x.y", "org/x/y/Outer$In.class"), ("c.jar", "com.z", "org/x/Top.class"), ("d.jar", "org.x", "other/org/x/Top.class")], "jar string, grp string, entry string")
    asked = spark.createDataFrame([("org.x.Top",), ("org.x.y.Outer.In",), ("org.x.Top.Missing",), ("Top",), (None,), ("org.x.Top",)], "fqn string")
    assert rows(files.jars_declaring(asked, entries), "fqn", "jar") == [("org.x.Top", "a.jar"), ("org.x.y.Outer.In", "a.jar"), ("org.x.y.Outer.In", "b.jar")]
