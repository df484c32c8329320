"""Compiler output, telemetry, traces and profiles; their sinks; cached snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TELEMETRY = "ts_ms decimal(38,0), root string, `trigger` string, wall_ms double, executed boolean, diagnostics long, errors long, warnings long, cold boolean, superseded boolean"
TRACE = "name string, cat string, ph string, ts decimal(38,0), dur decimal(38,0), pid long, tid long, args string"


def strip_escapes(text: Column) -> Column:
    """Text without terminal sequences: ESC [ ... letter, and ESC ] ... up to BEL or ESC \\."""
    return F.regexp_replace(F.regexp_replace(text, "\u001b\\][^\u0007\u001b]*(\u0007|\u001b\\\\)", ""), "\u001b\\[[0-?]*[ -/]*[@-~]", "")


def compiler_messages(lines: DataFrame) -> DataFrame:
    """``n``, ``path``, ``line``, ``col``, ``severity``, ``message`` of compiler output (``n``, ``line``), in the old form or the new."""
    x = lines.select("n", strip_escapes(F.col("line")).alias("t")).where(F.col("t").rlike("^[ew]:"))
    x = x.select("n", F.when(F.col("t").startswith("e:"), "Error").otherwise("Warning").alias("severity"), F.ltrim(F.substring("t", 3, 1 << 30)).alias("rest"))
    old = r"^(.*?): \(\s*(\d+)\s*,\s*(\d+)\s*\)(.*)$"
    new = r"^(?:file://)?(?:/(?=[A-Za-z]:))?(.*?):(\d+):(\d+)(?=$|[ \t:])(.*)$"
    is_old, is_new = F.col("rest").rlike(old), F.col("rest").rlike(new)
    part = lambda i: F.when(is_old, F.regexp_extract("rest", old, i)).otherwise(F.regexp_extract("rest", new, i))
    message = F.trim(F.regexp_replace(part(4), "^:+", ""))
    return x.where(is_old | is_new).select("n", part(1).alias("path"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), "severity", message.alias("message"))


def task_executed(lines: DataFrame) -> DataFrame:
    """Whether the output shows a compile task that was not up to date."""
    hit = F.col("line").rlike(r"^> Task .*compile") & ~F.col("line").rlike("UP-TO-DATE|NO-SOURCE|FROM-CACHE|SKIPPED")
    return lines.agg(F.coalesce(F.max(hit), F.lit(False)).alias("executed"))


def classified(runs: DataFrame) -> DataFrame:
    """``event_id``, ``cold``, ``superseded`` of compile runs (``root``, ``ts``, ``wall_us``): the first of its root, and those that a later one overtook before they ended."""
    w = Window.partitionBy("root").orderBy("ts", "event_id")
    overtaken = F.lead("ts").over(w) < F.col("ts") + F.make_dt_interval(secs=(F.col("wall_us") / 1_000_000).cast("decimal(18,6)"))
    return runs.select("event_id", (F.row_number().over(w) == 1).alias("cold"), F.coalesce(overtaken, F.lit(False)).alias("superseded"))


def read_jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines (``value``), and how many lines that are not blank could not be read."""
    names = ", ".join([schema, "_bad string"])
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", names, {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.where("r._bad is null").select("r.*").drop("_bad"), rows.agg(F.count_if(F.col("r._bad").isNotNull()).alias("skipped"))


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def chrome_trace(events: DataFrame, by: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """A JSON document of trace events in the order of time for each trace (``by``); of bounded size, as viewers read it whole."""
    e = F.struct(*[c for c in events.columns if c not in by])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", F.to_json(e).alias("j")))), lambda x: x["j"])
    return events.groupBy(*by).agg(F.concat(F.lit('{"traceEvents":['), F.array_join(ordered, ","), F.lit("]}")).alias("document"))


def diagnostic_lines(diags: DataFrame) -> DataFrame:
    """``path:line:col: severity[code]: message`` with places from 1."""
    code = F.when(F.col("code").isNotNull(), F.concat(F.lit("["), "code", F.lit("]"))).otherwise(F.lit(""))
    return diags.select(F.concat("path", F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(":"), (F.col("col") + 1).cast("string"), F.lit(": "), F.lower("severity"), code, F.lit(": "), "message").alias("value"))


def flame_frames(texts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Frames (``name``, ``y``, ``x``, ``width``) of flame graphs (``text``); ``by`` tells graphs apart."""
    pattern = r'<g><title>(.*?) \([\d,]+ samples?, [\d.]+%\)</title><rect[^>]*\by="(\d+)"[^>]*\bfg:x="(\d+)" fg:w="(\d+)"'
    found = texts.select(*by, F.explode(F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "y"), (3, "x"), (4, "width"))])).alias("f"))
    name = F.col("f.name")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        name = F.replace(name, F.lit(entity), F.lit(char))
    return found.select(*by, name.alias("name"), *(F.col(f"f.{c}").cast("long").alias(c) for c in ("y", "x", "width")))


def self_time(frames: DataFrame, level: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """Samples of each name outside the frames above its own."""
    c = frames.select(*by, (F.col("y") + level).alias("y"), F.col("x").alias("cx"), F.col("width").alias("cw"))
    keys = [*by, "y", "x"]
    kids = frames.join(c, [*by, "y"]).where("cx >= x and cx + cw <= x + width").groupBy(*keys).agg(F.sum("cw").alias("used"))
    own = frames.join(kids, keys, "left").withColumn("own", F.col("width") - F.coalesce("used", F.lit(0)))
    return own.where("own > 0 and name <> 'all'").groupBy(*by, "name").agg(F.sum("own").alias("samples"))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", *parts), 256)


def read_snapshot(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame | None:
    """Rows that were kept under a fingerprint, or None if there are none or they can't be read."""
    try:
        out = spark.read.schema(schema).parquet(f"{path}/key={key}")
        out.limit(1).count()
        return out
    except Exception:  # noqa: BLE001  a broken snapshot is a miss
        return None


def write_snapshot(rows: DataFrame, path: str, key: str) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/key={key}")


def retained(snapshots: DataFrame, keep: int = 2) -> DataFrame:
    """The newest snapshots (``root``, ``key``, ``made``) of each root."""
    w = Window.partitionBy("root").orderBy(F.desc("made"), "key")
    return snapshots.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")
