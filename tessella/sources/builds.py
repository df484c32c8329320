"""Dependencies and classpaths as build files, metadata and caches state them."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .files import archive_entries

_SAFE = r"^[^\s/\\:$]+$"


def is_bom(artifact: Column) -> Column:
    return artifact.rlike("-(bom|dependencies|platform)$")


def managed_versions(coordinates: DataFrame) -> DataFrame:
    """Version of each group whose bill-of-materials artifacts all have the same one."""
    return coordinates.where(is_bom(F.col("artifact"))).groupBy("grp").agg(F.countDistinct("version").alias("n"), F.min("version").alias("managed")).where("n = 1").select("grp", "managed")


def _catalog(text: str) -> Iterator[tuple]:
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return
    versions = doc.get("versions", {})

    def plain(v):
        if isinstance(v, dict):
            return next((v[k] for k in ("strictly", "require", "prefer") if isinstance(v.get(k), str)), None)
        return v if isinstance(v, str) else None

    for alias, lib in doc.get("libraries", {}).items():
        if isinstance(lib, str):
            parts = lib.split(":")
            if len(parts) == 3:
                yield alias, *parts
            continue
        if "module" in lib:
            group, _, name = str(lib["module"]).partition(":")
        else:
            group, name = lib.get("group"), lib.get("name")
        if not group or not name:
            continue
        version = lib.get("version")
        if isinstance(version, dict) and "ref" in version:
            version = versions.get(version["ref"])
        yield alias, group, name, plain(version)


def catalog_libraries(files: DataFrame) -> DataFrame:
    """``path``, ``alias``, ``grp``, ``artifact``, ``version`` of version catalogs (``path``, ``text``); versions of managed groups are filled in."""
    schema = pa.schema([("path", pa.string()), ("alias", pa.string()), ("grp", pa.string()), ("artifact", pa.string()), ("version", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows = [(p, *x) for p, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()) for x in _catalog(text or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    libs = files.select("path", "text").mapInArrow(work, "path string, alias string, grp string, artifact string, version string")
    known = libs.where("version is not null")
    return libs.join(managed_versions(known), "grp", "left").select("path", "alias", "grp", "artifact", F.coalesce("version", "managed").alias("version"))


def module_identities(files: DataFrame) -> DataFrame:
    """All ``grp``, ``artifact`` that version catalogs name, with a version or without."""
    return catalog_libraries(files).select("grp", "artifact").distinct()


def embedded_poms(archives: DataFrame) -> DataFrame:
    """``path`` (of the archive), ``text`` of the POM files inside archives (``path``, ``content``)."""
    found = archive_entries(archives, ("pom.xml",))
    return found.where(F.col("entry").rlike(r"^META-INF/maven/.+/pom\.xml$")).select(F.col("archive").alias("path"), "text")


def archive_dependencies(archives: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``fingerprint`` and what :func:`pom_dependencies` gives of each archive (``path``, ``content``, ``fingerprint``).

    Archives whose fingerprint has rows in ``known`` (this function's rows of
    before) are not opened again.
    """
    new = archives if known is None else archives.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")
    out = pom_dependencies(embedded_poms(new)).join(new.select("path", "fingerprint"), "path")
    if known is None:
        return out
    old = known.join(archives.select("fingerprint").distinct(), "fingerprint", "left_semi")
    return old.unionByName(out)


def build_literals(files: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """``path``, ``grp``, ``artifact``, ``version`` of quoted coordinates; versions from platforms, then from the cache."""
    lines = files.select("path", F.explode(F.split("text", "\r?\n")).alias("line"))
    lit = lines.select("path", F.col("line").rlike(r"(enforcedP|p)latform\(").alias("platform"), F.explode(F.regexp_extract_all("line", F.lit("[\"']([^\"']*)[\"']"), 1)).alias("lit"))
    part = F.split("lit", ":")
    at = lambda i: F.get(part, F.lit(i))
    rows = lit.where(F.size(part).isin(2, 3) & at(0).rlike(_SAFE) & at(1).rlike(_SAFE)).select("path", "platform", at(0).alias("grp"), at(1).alias("artifact"), at(2).alias("stated"))
    out = rows.join(managed_versions(rows.where("platform and stated is not null").withColumnRenamed("stated", "version")), "grp", "left")
    version = F.coalesce("stated", "managed")
    if cached is not None:
        out = out.join(cached.select("grp", "artifact", F.col("version").alias("best")), ["grp", "artifact"], "left")
        version = F.coalesce("stated", "managed", "best")
    return out.withColumn("version", version).where("version is not null").select("path", "grp", "artifact", "version").distinct()


def module_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies in module metadata (JSON): version from requires, strictly, prefers."""
    v = "struct<requires:string,strictly:string,prefers:string>"
    parsed = F.from_json("text", f"variants array<struct<dependencies:array<struct<`group`:string,module:string,version:{v}>>>>")
    d = files.select("path", F.explode(parsed["variants"]).alias("v")).select("path", F.explode("v.dependencies").alias("d"))
    return d.where("d.`group` is not null and d.module is not null").select("path", F.col("d.group").alias("grp"), F.col("d.module").alias("artifact"), F.coalesce("d.version.requires", "d.version.strictly", "d.version.prefers").alias("version"))


def pom_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of POM files, without those of builds, reports, profiles and management; ``${...}`` filled from properties."""
    bare = F.regexp_replace("text", r"(?s)<!--.*?-->", "")
    body = bare
    for tag in ("build", "reporting", "profiles", "dependencyManagement"):
        body = F.regexp_replace(body, rf"(?s)<{tag}>.*?</{tag}>", "")
    field = lambda col, tag: F.nullif(F.trim(F.regexp_extract(col, rf"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    project = F.regexp_replace(F.regexp_replace(body, r"(?s)<dependencies>.*?</dependencies>", ""), r"(?s)<parent>.*?</parent>", "")
    parent = F.regexp_extract(bare, r"(?s)<parent>(.*?)</parent>", 1)
    inner = F.regexp_extract(bare, r"(?s)<properties>(.*?)</properties>", 1)
    keys, values = (F.regexp_extract_all(inner, F.lit(r"(?s)<([\w.\-]+)>(.*?)</\1>"), F.lit(i)) for i in (1, 2))
    own = files.select(
        "path", F.explode(F.regexp_extract_all(body, F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("d"), F.map_from_arrays(keys, F.transform(values, F.trim)).alias("props"), F.coalesce(field(project, "groupId"), field(parent, "groupId")).alias("pg"), F.coalesce(field(project, "version"), field(parent, "version")).alias("pv")
    )

    def filled(tag: str) -> Column:
        v = field(F.col("d"), tag)
        name = F.regexp_extract(v, r"^\$\{(.*)\}$", 1)
        special = F.when(name.isin("project.groupId", "pom.groupId"), F.col("pg")).when(name.isin("project.version", "pom.version", "version"), F.col("pv"))
        return F.when(v.rlike(r"^\$\{.*\}$"), F.coalesce(special, F.try_element_at("props", name))).otherwise(v)

    out = own.select("path", filled("groupId").alias("grp"), filled("artifactId").alias("artifact"), filled("version").alias("version"), field(F.col("d"), "scope").alias("scope"), F.coalesce(field(F.col("d"), "optional") == "true", F.lit(False)).alias("optional"))
    return out.where("grp is not null and artifact is not null")


def classpath_dump(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``module``, ``dir``, ``kind`` (CP or UNRESOLVED), ``ord``, ``entry`` of a dump's lines (``n``, ``line``).

    ``by``: columns that tell dumps apart; each dump is read by one task.  Lines outside a PROJECT ... END block are left out; a block without its END counts.
    """
    f = F.split("line", "\t")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    mark = F.when((at(0) == "PROJECT") | (at(0) == "END"), F.struct((at(0) == "PROJECT").alias("open"), at(1).alias("module"), at(2).alias("dir")))
    w = Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = lines.withColumn("s", F.last(mark, ignorenulls=True).over(w))
    rows = state.where((at(0).isin("CP", "UNRESOLVED")) & F.col("s.open") & (F.col("s.module") != "") & (F.size(f) > 1) & ((at(1) != "") | (at(0) != "CP")))
    entry = F.when(at(0) == "CP", at(1)).otherwise(F.concat(at(1), F.lit(": "), at(2)))
    ord_ = F.row_number().over(Window.partitionBy(*by, "s.module", at(0)).orderBy("n"))
    return rows.select(*by, F.col("s.module").alias("module"), F.col("s.dir").alias("dir"), at(0).alias("kind"), ord_.alias("ord"), entry.alias("entry"))


def cache_coordinates(paths: DataFrame) -> DataFrame:
    """Coordinates of paths in a ``files-2.1`` cache whose file is named after artifact and version."""
    s = F.split("path", "/")
    i = F.array_position(s, "files-2.1").cast("int")
    at = lambda k: F.get(s, i - 1 + k)
    stem = F.regexp_replace(F.element_at(s, -1), r"\.[^.]*$", "")
    ok = (i > 0) & (F.size(s) >= i - 1 + 5) & F.startswith(stem, F.concat(at(2), F.lit("-"), at(3)))
    return paths.where(ok).select("path", at(1).alias("grp"), at(2).alias("artifact"), at(3).alias("version"))

