"""Shared parts: tables in the shared folder, ragged token arrays, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into token arrays at a time.
SLICE_BYTES = 1 << 19

# --------------------------------------------------------------------------
# tables in the folder that driver and executors share
# --------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a temporary folder is made and
    set; on a cluster that would be a machine-local folder, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tables/{tag}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    recomputing what came before.  The shuffle files of the job go when its rows
    are written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table made by :func:`save` that nothing reads any more."""
    path = getattr(df, "_tessella_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


# --------------------------------------------------------------------------
# ragged arrays of tokens over Arrow buffers
# --------------------------------------------------------------------------

_U = np.uint64
#: Masks of the first 0 to 8 bytes of a word.
_HEAD = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_R = 0x5851F42D4C957F2D


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Tokens:
    """White-space tokens of a run of texts, A-Z in lower case.

    ``doc``: index of each token's text.  ``first``: index of each text's first
    token, with the number of tokens at the end.  ``line_first``: the same for
    all lines, which end at \\n; ``text_line``: index of each text's first line.
    ``buf`` holds the tokens, every one followed by a space, and ``start``,
    ``end`` their places there; these are made when they are first asked for.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.n_docs = len(offsets) - 1
        self._data, self._offs = data[int(offsets[0]) : int(offsets[-1])], (offsets - offsets[0]).astype(np.int64)
        text = pa.Array.from_buffers(pa.large_string(), self.n_docs, [None, pa.py_buffer(self._offs), pa.py_buffer(self._data)])
        lines = pc.split_pattern(pc.ascii_lower(text), "\n")
        found = pc.ascii_split_whitespace(lines.flatten())
        offs = _offsets(found.flatten())
        self._bytes = np.frombuffer(found.flatten().buffers()[2] or b"", np.uint8)
        size = np.diff(offs)
        at = offs[:-1]
        self.text_line = lines.offsets.to_numpy().astype(np.int64) - lines.offsets[0].as_py()
        self.line_first = found.offsets.to_numpy().astype(np.int64) - found.offsets[0].as_py()
        some = size > 0
        if not some.all():  # white space at a line's ends makes empty strings
            seen = np.zeros(len(size) + 1, np.int64)
            np.cumsum(some, out=seen[1:])
            self.line_first = seen[self.line_first]
            at, size = at[some], size[some]
        self._at, self._size = at, size
        self.first = self.line_first[self.text_line]
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self._buf: np.ndarray | None = None

    def _spread(self) -> None:
        self.end = np.cumsum(self._size + 1) - 1
        self.start = self.end - self._size
        n = int(self.end[-1]) + 1 if len(self.end) else 0
        out = np.full(n, 32, np.uint8)
        keep = np.ones(n, bool)
        keep[self.end] = False
        if len(self._at):
            out[keep] = self._bytes[int(self._at[0]) : int(self._at[-1] + self._size[-1])]
        self._buf = out

    @property
    def buf(self) -> np.ndarray:
        if self._buf is None:
            self._spread()
        return self._buf

    def __getattr__(self, name: str):
        if name in ("start", "end"):
            self._spread()
            return self.__dict__[name]
        raise AttributeError(name)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every token; equal tokens have equal hashes in every process."""
        n = len(self._bytes)
        held = np.zeros(n + 16, np.uint8)
        held[:n] = self._bytes
        words = np.ndarray((n + 8,), "<u8", held, 0, (1,))  # the eight bytes from each place on
        size = self._size
        h = words[self._at] & _HEAD[np.minimum(size, 8)]
        h = mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        more, done = np.flatnonzero(size > 8), 8
        while len(more):
            left = size[more] - done
            h[more] = mix(h[more] * _U(0x9E3779B97F4A7C15) + (words[self._at[more] + done] & _HEAD[np.minimum(left, 8)]))
            more, done = more[left > 8], done + 8
        return h


def _offsets(arr: pa.Array) -> np.ndarray:
    return np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k-token shingles, the index of each one's first token, and where each text's begin."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * _U(_R) + h[j : n - k + 1 + j]
    ok = np.ones(n - k + 1, bool)
    for j in range(1, k):
        cut = first[1:-1] - j
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    # a text shorter than k ends more than once within k tokens; the marks above cover every such start
    at = np.flatnonzero(ok)
    at = at[_same_text(at, k, first)]
    return mix(out[at]), at, np.searchsorted(at, first)


def _same_text(at: np.ndarray, k: int, first: np.ndarray) -> np.ndarray:
    owner = np.searchsorted(first, at, "right") - 1
    return at + k <= first[owner + 1]


def strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    bufs = arr.buffers()
    offsets = _offsets(arr)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES):
    """Yield (record batch, bytes, offsets) with at most ``size`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = strings(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), data, offsets[i : j + 1]
            i = j


def tokens_of(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    for batch, data, offsets in slices(batches, text, size):
        yield batch, Tokens(data, offsets)


def tidy(work):
    """``work`` for ``mapInArrow`` that gives its memory back when a task's rows end.

    Workers live on between tasks; what they keep adds up beside the other
    workers of their executor.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        # the system's allocator gives large buffers back at once
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Return unused memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES, breaks: bytes = b"\n"):
    """Like :func:`slices`, but texts over ``size`` come in pieces of about that size, which end after one of ``breaks``.

    Yields (record batch, bytes, offsets, nth piece of its text, whether it is
    the text's last).  Texts of up to ``size`` bytes come together, whole.
    """
    stop = np.zeros(256, bool)
    stop[list(breaks)] = True
    for batch, data, offsets in slices(batches, text, size):
        lo, hi = int(offsets[0]), int(offsets[-1])
        if hi - lo <= size:
            yield batch, data, offsets, 0, True
            continue
        nth = 0
        while True:
            end, near = lo + size, size
            while end < hi:
                at = np.flatnonzero(stop[data[end : min(end + near, hi)]])
                if len(at):
                    end += int(at[0]) + 1
                    break
                end, near = end + near, 2 * near
            end = min(end, hi)
            yield batch, data, np.array([lo, end], np.int64), nth, end == hi
            if end == hi:
                break
            lo, nth = end, nth + 1


def table_of(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in schema], schema=schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 17) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray]]:
    """Whole runs of equal keys from rows sorted by them: columns and the runs' bounds.

    Runs come together, about ``rows`` rows at a time.  A run that the end of a batch cuts is kept and joined with what follows.
    """
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        held += batch.num_rows
        if held < rows or all(kept[0].column(k)[0] == batch.column(k)[batch.num_rows - 1] for k in keys):
            continue
        held = 0
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        cols = {f.name: whole.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(whole.schema)}
        bounds = _bounds(cols, keys)
        if len(bounds) > 2:
            cut = bounds[-2]
            yield {k: v[:cut] for k, v in cols.items()}, bounds[:-1]
            kept = [whole.slice(cut)]
        else:
            kept = [whole]
    if kept:
        whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
        cols = {f.name: whole.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(whole.schema)}
        yield cols, _bounds(cols, keys)


def runs_of_keys(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of equal keys, for keys whose runs are of bounded size."""
    kept: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = _bounds({k: batch.column(k).to_numpy(zero_copy_only=False) for k in keys}, keys).tolist()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            key = [batch.column(k)[lo].as_py() for k in keys]
            if kept and key != now:
                yield pa.Table.from_batches(kept)
                kept = []
            now = key
            kept.append(batch.slice(lo, hi - lo))
    if kept:
        yield pa.Table.from_batches(kept)


def _bounds(cols: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    n = len(cols[keys[0]])
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= cols[k][1:] != cols[k][:-1]
    return np.append(np.flatnonzero(new), n)


# --------------------------------------------------------------------------
# connected components
# --------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex that each vertex reaches, for those that reach a smaller one.

    ``edges``: columns ``v`` and ``p`` (long), ``p`` < ``v``.  Returns ``v``,
    ``root``, one row per vertex.  Each round hooks every parent of a vertex to
    the vertex's smallest parent and halves the paths to the root.  Rounds are
    DataFrame joins over tables in the shared folder; nothing is collected.  The
    joins' hot side is a plain scan, which adaptive execution splits.
    """
    e = save(edges.select(F.col("v").cast("long"), F.col("p").cast("long")).where("p < v"), "edges")
    while True:
        s = save(e.groupBy("v").agg(F.min("p").alias("m"), F.collect_set("p").alias("ps")), "parents")
        drop(e)
        extra = s.where(F.size("ps") > 1).select(F.explode("ps").alias("v"), F.col("m").alias("p")).where("p < v").withColumn("changed", F.lit(True))
        a, b = s.select("v", "m"), s.select(F.col("v").alias("bv"), F.col("m").alias("bm"))
        jumped = a.join(b, a.m == b.bv, "left").select("v", F.coalesce("bm", "m").alias("p"), F.col("bm").isNotNull().alias("changed"))
        e = save(jumped.unionByName(extra), "edges")
        drop(s)
        if e.where("changed").isEmpty():
            return e.select("v", F.col("p").alias("root"))


def shared_ids(rows: DataFrame) -> DataFrame:
    """Edges (``v``, ``p``) between the ``rep`` of rows that share an ``id``, for ids with several; both are long.

    The edges of an id are a star, so an id that a great many rows share makes
    one edge for each of them; ids with one ``rep`` make none.
    """
    least = rows.groupBy("id").agg(F.min("rep").alias("p"), F.max("rep").alias("most")).where("p < most").select("id", "p")
    return rows.join(least, "id").where("rep > p").select(F.col("rep").alias("v"), "p").distinct()


def spanning(links, n: int) -> np.ndarray:
    """Root (smallest index) of each of n vertices under the links (pairs of index arrays)."""
    lab = np.arange(n)
    a, b = links
    while len(a):
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], m)
        np.minimum.at(new, lab[b], m)
        new = new[new]
        while True:
            again = new[new]
            if np.array_equal(again, new):
                break
            new = again
        new = new[lab]
        live = new[a] != new[b]
        a, b = a[live], b[live]
        lab = new
    return lab


# --------------------------------------------------------------------------
# tables of bounded size that every worker gets
# --------------------------------------------------------------------------

#: Most bits of a filter: 8 MB, whatever the number of values.
FILTER_BITS = 1 << 26


#: Bits of the parts that a filter is gathered in.
FILTER_PART = 1 << 16


class Filter:
    """Bloom filter of longs; says yes to all its values and, if it isn't full, to few others."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
        h = mix(values.view(np.uint64))
        return [h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]

    def __contains__(self, value: int) -> bool:
        return bool(self.has(np.array([value], np.int64))[0])

    def has(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for at in self._places(values, len(self.words) * 64):
            out &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def filter_of(df: DataFrame, col: str) -> Filter:
    """Filter of a long column; its size is bounded by FILTER_BITS, so it may be sent to every worker."""
    rows = df.select(F.col(col).cast("long").alias("x")).where("x is not null")
    n = rows.count()
    bits = FILTER_PART
    while bits < min(FILTER_BITS, 12 * n):
        bits *= 2
    parts = bits // FILTER_PART

    def fill(batches: Iterator[pa.RecordBatch]):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for at in Filter._places(batch.column("x").to_numpy(), bits):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        for k, part in enumerate(words.reshape(parts, -1)):
            some = np.flatnonzero(part)
            if len(some):
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "at": [some.astype(np.uint32).tobytes()], "word": [part[some].tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]):
        for rows in runs_of_keys(batches, ["part"]):
            words = np.zeros(FILTER_PART // 64, np.uint64)
            for at, word in zip(rows.column("at").to_pylist(), rows.column("word").to_pylist()):
                words[np.frombuffer(at, np.uint32)] |= np.frombuffer(word, np.uint64)
            yield pa.RecordBatch.from_pydict({"part": rows.column("part")[:1].combine_chunks(), "word": [words.tobytes()]})

    filled = rows.mapInArrow(tidy(fill), "part int, at binary, word binary").repartition("part").sortWithinPartitions("part")
    words = np.zeros((parts, FILTER_PART // 64), np.uint64)
    for r in filled.mapInArrow(tidy(merge), "part int, word binary").collect():  # bits in all
        words[r["part"]] = np.frombuffer(r["word"], np.uint64)
    return Filter(words.ravel())


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def mark_by(df: DataFrame, col: str, found: Filter, name: str) -> DataFrame:
    """``df`` with a boolean that says whether the long column may be in the filter.

    Only that column goes to a Python worker.
    """
    sent = df.sparkSession.sparkContext.broadcast(found)

    @F.arrow_udf("boolean")
    def hit(ids: pa.Array) -> pa.Array:
        return pa.array(sent.value.has(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False))

    return df.withColumn(name, hit(F.col(col).cast("long")))


def among(df: DataFrame, col: str, found: Filter) -> DataFrame:
    """Rows whose long column may be in the filter; nothing is shuffled."""
    hit = fresh(df, "_among")
    return mark_by(df, col, found, hit).where(F.col(hit)).drop(hit)


def without(df: DataFrame, col: str, gone: DataFrame, gone_col: str) -> DataFrame:
    """Rows of ``df`` whose long column is null or not in ``gone``.

    A filter of bounded size tells most rows that stay; only the others, whose
    texts may be long, are shuffled for the join that decides.
    """
    key, hit = fresh(df, "_gone"), fresh(df, "_hit")
    gone = save(gone.select(F.col(gone_col).cast("long").alias(key)).distinct(), "gone")
    if gone.isEmpty():
        return df
    marked = mark_by(df, col, filter_of(gone, key), hit)
    rest = marked.where(F.col(hit)).drop(hit)
    rest = rest.join(gone, rest[col].cast("long") == gone[key], "left_anti")
    return marked.where(~F.col(hit)).drop(hit).unionByName(rest)
