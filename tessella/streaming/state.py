"""State of open documents kept from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame) -> DataFrame:
    """Last version of each document; documents whose last change closes them are gone."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("version", "text", "closed"), "version").alias("x"))
    return last.where("not x.closed").select("path", "x.version", "x.text")


def debounced(changes: DataFrame, gap: str = "300 milliseconds", watermark: str | None = None) -> DataFrame:
    """Last change of each burst; a burst ends with a pause of ``gap``.  Streams need a watermark."""
    rows = changes.withWatermark("ts", watermark) if watermark else changes
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "path").agg(F.max("version").alias("version"), F.count("*").alias("changes")).select("path", "version", "changes")


def overlay(disk: DataFrame, open_docs: DataFrame) -> DataFrame:
    """Open documents before those on disk."""
    both = disk.select("path", "text", F.lit(1).alias("prio")).unionByName(open_docs.select("path", "text", F.lit(0).alias("prio")))
    w = Window.partitionBy("path").orderBy("prio")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").select("path", "text", "prio")


def upsert_stream(changes: DataFrame, target: str, checkpoint: str):
    """Keep ``target`` (Parquet, one folder per batch) in step with a stream of changes; read it with :func:`latest`."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("version", "text", "closed"), "version").alias("x"))
        last.select("path", "x.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def revisions(changes: DataFrame) -> DataFrame:
    """``path``, ``version``, ``revision``: the number of each change of a document."""
    return changes.select("path", "version", F.row_number().over(Window.partitionBy("path").orderBy("version")).alias("revision"))


def ingested(rows: DataFrame, coordinate: list[str]) -> DataFrame:
    """Rows of the last batch of each coordinate; what earlier batches had of it is taken back."""
    last = rows.groupBy(*coordinate).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*coordinate, "batch"])


def ingest_stream(changes: DataFrame, target: str, checkpoint: str, coordinate: list[str]):
    """Keep the symbols of dependencies (Parquet, one folder per batch) as a stream brings them; read them with :func:`ingested`.

    Folders whose rows all have been replaced are removed, so the table grows
    with the coordinates and not with the number of batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("tier", F.lit("Durable")).write.mode("overwrite").parquet(f"{target}/batch={number}")
        every = spark.read.parquet(target)
        live = {r["batch"] for r in ingested(every, coordinate).select("batch").distinct().collect()}  # one number for each folder
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for old in {r["batch"] for r in every.select("batch").distinct().collect()} - live - {number}:
            fs.delete(path(f"{target}/batch={old}"), True)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
