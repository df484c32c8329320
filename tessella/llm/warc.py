"""WARC archives and their capture index, merged from sorted runs."""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._core import filter_of, mark_by, new_path, save, tidy

#: Records of an archive, and the bytes of them before compression.
RECORDS = 2_000
ARCHIVE_BYTES = 256 << 20
#: Entries of a range of the index, about; a task merges one range.
RANGE = 50_000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_EPOCH = 1_704_067_200


def base32_of_hex(digest: F.Column) -> F.Column:
    """Base32 of 40 hex digits, without padding as 160 bits need none."""
    out = []
    for i in range(8):
        part = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(part, shift).bitwiseAND(F.lit(31)) + 1
            out.append(F.substr(F.lit(_BASE32), at, F.lit(1)))
    return F.concat(*out)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """One column ``value``: a WARC record for each row, without its closing blank lines.

    The payload is the HTML in UTF-8, empty where it is null.  Of rows with equal
    payloads of at least ``least`` bytes that with the smallest id is a response
    and the others revisit it; smaller payloads are all responses.  Rows that
    repeat the smallest id are all responses; a row with a null id revisits where
    its payload has a row with an id, and is a response otherwise.  The capture
    time is a fixed day and as many seconds as the id says.  Null texts are
    empty, an empty table gives no records, and further columns, whatever their
    names, are not looked at.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("n", F.octet_length("html").cast("long")).withColumn("same", F.sha2("html", 256))
    groups = rows.where(F.col("n") >= least).groupBy("same").agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    groups = save(groups.where("rows > 1 and first is not null").select(F.col("same").alias("key"), "first"), "payloads")
    # only pages whose payload may occur twice are shuffled
    code, hit = "_code", "_twice"
    marked = mark_by(rows.withColumn(code, F.xxhash64("same")), code, filter_of(groups.select(F.xxhash64("key").alias("x")), "x"), hit)
    twice = marked.where(F.col(hit)).join(groups.hint("merge"), marked.same == groups.key, "left").drop("key", code, hit)
    rows = marked.where(~F.col(hit)).drop(code, hit).withColumn("first", F.lit(None).cast("long")).unionByName(twice)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    second = F.pmod(F.coalesce("id", F.lit(0)), F.lit(100_000_000)) + _EPOCH
    # dates by arithmetic, as the session's time zone must not matter
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86400).cast("int"))
    rest = F.pmod(second, F.lit(86400))
    clock = F.format_string("%sT%02d:%02d:%02dZ", day.cast("string"), F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("id")),
        F.lit("\r\nWARC-Date: "),
        clock,
        F.lit("\r\nWARC-Target-URI: "),
        F.regexp_replace("url", "[\r\n]", "%0A"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        base32_of_hex(F.sha1("html")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("first")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write records as gzipped archives; the lines that Spark ends are whole records.

    Long records go to archives of their own, of as many as fit into
    ARCHIVE_BYTES (one at least), so that each archive can be read whole.
    """
    size = F.octet_length("value")
    short = ARCHIVE_BYTES // RECORDS
    most = records.agg(F.max(size)).first()[0] or 0

    def write(rows: DataFrame, count: int) -> None:
        rows.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", count).text(path)

    write(records.where(size <= short) if most > short else records, RECORDS)
    if most > short:
        write(records.where(size > short), max(1, ARCHIVE_BYTES // most))


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        heads = {k.lower(): v.lstrip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(heads["content-length"])
        yield at, heads, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def url_key(url: str) -> str:
    """Host labels from the right, then path and query: captures of a site sort together."""
    try:
        parts = urlsplit(url.strip())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url
    path = (parts.path or "/").lower()
    return f"{host}{port}){path}" + (f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else "")


_ENTRY = pa.schema(
    [
        ("urlkey", pa.string()),
        ("captured", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("archive", pa.string()),
        ("place", pa.int64()),
        ("nth", pa.int64()),
    ]
)
_ENTRY_SQL = "urlkey string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, place long, nth long"


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _key(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def _entries(archive: str, data: bytes) -> list[tuple]:
    out = []
    for at, heads, block in parse_records(data):
        http = block[: block.index(b"\r\n\r\n")].decode()
        size = next(int(x.partition(":")[2]) for x in http.split("\r\n") if x.lower().startswith("content-length:"))
        url = heads["warc-target-uri"]
        refers = heads.get("warc-refers-to")
        out.append((url_key(url), heads["warc-date"], _page(heads["warc-record-id"]), url, heads["warc-type"], _page(refers) if refers else None, size, heads["warc-payload-digest"].removeprefix("sha1:"), archive, at))
    out.sort(key=_key)
    return [(*e, i) for i, e in enumerate(out)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ENTRY)], schema=_ENTRY)


def sorted_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read archives back: the capture entries of each, sorted by URL key and time; ``nth``: place in that order."""

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = _entries(os.path.basename(name), gzip.decompress(content.as_py()))
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(tidy(work), _ENTRY_SQL)


class LoserTree:
    """Merges sorted runs; each next entry costs one comparison per level."""

    def __init__(self, runs: list[Iterable], key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * max(1, k)
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; ended runs go last, equal keys in the order of the runs."""
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, i: int) -> None:
        node, winner = (i + len(self.runs)) // 2, i
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree is filled: wait here
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.runs:
            w = self.losers[0]
            if self.keys[w] is None:
                return
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._play(w)


def merge_index(runs: DataFrame) -> DataFrame:
    """All entries in one order by URL key, time and id, with their number in it (``rank``).

    The runs lie sorted in the shared folder.  Their keys are cut into ranges of
    about RANGE entries, as many as the runs need, so a task's memory does not
    grow with the index; in each range the pieces of the runs are merged by a
    loser tree.  Ranges end between any two entries, so a URL that holds many of
    them spreads over ranges too.
    """
    count = max(1, -(-runs.count() // RANGE))

    def work(batches: Iterator[pa.RecordBatch]):
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                parts.setdefault(row[8], []).append(row)
        for p in parts.values():  # an exchange may hand over a run's rows in pieces
            p.sort(key=lambda r: r[10])
        held, before, part = [], 0, TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            out = _batch(held)
            place = pa.array(range(before, before + len(held)), pa.int64())
            return pa.RecordBatch.from_arrays([*out.columns, pa.array([part] * len(held), pa.int32()), place], names=[*out.schema.names, "range", "nth_in_range"])

        for row in LoserTree([parts[k] for k in sorted(parts)], _key):
            held.append(row)
            if len(held) == 4096:
                yield packed()
                before, held = before + len(held), []
        if held:
            yield packed()

    ranged = runs.repartitionByRange(count, "urlkey", "captured", "page_id", "archive", "place")
    merged = save(ranged.mapInArrow(tidy(work), _ENTRY_SQL + ", `range` int, nth_in_range long"), "merged")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # one row for each range
    return merged.join(F.broadcast(sizes.select("range", "before")), "range").withColumn("rank", F.col("before") + F.col("nth_in_range")).drop("range", "nth_in_range", "before")


def archive_pages(pages: DataFrame, path: str | None = None, least: int = 0, **cols) -> DataFrame:
    """Write archives of ``pages`` under ``path``, read them back and return the merged capture index.

    One row per page: ``urlkey``, ``captured``, ``page_id``, ``url``,
    ``record_type``, ``refers_to``, ``payload_bytes``, ``payload_digest``,
    ``archive``, ``place`` (byte in the unpacked archive), ``nth`` (place in the
    archive's sorted run), ``rank`` (place in the whole order; ties of key, time
    and id in that of archive and place).  See :func:`warc_records` for nulls and
    repeated rows; a very long page has an archive to itself.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_archives(warc_records(pages, least=least, **cols), path)
    return merge_index(save(sorted_runs(spark, path), "runs"))
