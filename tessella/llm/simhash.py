"""SimHash near-duplicate detection by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import components, runs, save, shared_ids, spanning, table_of, tidy, tokens_of, without

SEED = 42
#: Shingles whose bits are counted at a time.
_STEP = 1 << 17


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (long): bit i is set if it is set in over half of the text's shingle hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, t in tokens_of(batches, "text"):
            yield table_of(schema, doc_id=batch.column("doc_id"), fp=_fingerprint(t, words))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(work), "doc_id long, fp long")


def _fingerprint(t, words: int) -> np.ndarray:
    count = np.diff(t.first)
    per = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    total = np.zeros((t.n_docs, 64), np.int64)
    owner = np.repeat(np.arange(t.n_docs), per)
    base = np.cumsum(per) - per
    at = t.first[owner] + np.arange(len(owner)) - base[owner]
    start = t.start[at] if len(at) else np.zeros(0, np.int64)
    stop = t.end[np.minimum(at + words, t.first[owner + 1]) - 1] if len(at) else start
    raw, digest = t.buf.tobytes(), xxhash.xxh64_intdigest
    for i in range(0, len(at), _STEP):
        s, e, o = start[i : i + _STEP], stop[i : i + _STEP], owner[i : i + _STEP]
        h = np.fromiter((digest(raw[x:y], SEED) for x, y in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        cut = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        total[o[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    on = total * 2 > per[:, None]
    return np.packbits(on, axis=1).view(">u8").astype(np.uint64).ravel().view(np.int64)


def block_masks(distance: int, blocks: int | None = None) -> list[int]:
    """Masks of which one covers only equal bits of any two fingerprints within ``distance``."""
    blocks = blocks or distance + (2 if distance < 6 else 3)
    size = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    own, at = [], 0
    for n in size:
        own.append(((1 << n) - 1) << at)
        at += n
    return [sum(x) for x in combinations(own, blocks - distance)]


def links(fps: DataFrame, distance: int = 4, most: int = 2048) -> DataFrame:
    """Edges (``v``, ``p``) that connect what distinct fingerprints within ``distance`` connect.

    ``fps``: ``fp`` and ``rep``, one row per fingerprint.  All close pairs share
    one of the blocks; in each block only a forest of the links is returned.
    Blocks of over ``most`` fingerprints are dealt out again as pairs of parts,
    one task each, so no task gets more than about twice ``most`` of a block.
    """
    spark = fps.sparkSession
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance)]
    blocks = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(masks)])).alias("x")
    rows = fps.select("fp", "rep", blocks).select("x.c", "x.k", "fp", "rep")
    found = save(rows.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(tidy(_block_worker(["c", "k"], distance, most)), _OUT), "links")
    out = found.where("not late").select("v", "p")
    late = found.where("late").select("c", "k", F.col("v").alias("fp"), F.col("p").alias("rep"))
    if late.isEmpty():
        return out
    parts = save(late.groupBy("c", "k").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("parts")), "parts")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = (
        late.join(parts, ["c", "k"])
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("c", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp", "rep")
    )
    keys = ["c", "k", "i", "j"]
    more = pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(_block_worker(keys, distance, None)), _OUT)
    return out.unionByName(save(more, "links").select("v", "p"))


_OUT = "late boolean, c byte, k long, v long, p long"


def _block_worker(keys: list[str], distance: int, most: int | None):
    schema = pa.schema([("late", pa.bool_()), ("c", pa.int8()), ("k", pa.int64()), ("v", pa.int64()), ("p", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]):
        for cols, bounds in runs(batches, keys):
            fp, rep = cols["fp"].view(np.uint64), cols["rep"]
            size = np.diff(bounds)
            v, p = [], []
            two = bounds[:-1][size == 2]
            if len(two):
                near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
                v.append(np.maximum(rep[near], rep[near + 1]))
                p.append(np.minimum(rep[near], rep[near + 1]))
            for i in np.flatnonzero(size > 2):
                lo, hi = bounds[i], bounds[i + 1]
                if most and hi - lo > most:
                    one = np.ones(hi - lo, bool)
                    yield table_of(schema, late=one, c=cols["c"][lo:hi], k=cols["k"][lo:hi], v=cols["fp"][lo:hi], p=rep[lo:hi])
                    continue
                order = np.argsort(rep[lo:hi], kind="stable")
                x, r = fp[lo:hi][order], rep[lo:hi][order]
                lab = np.arange(len(x))
                for s in range(0, len(x), 512):
                    a, b = np.nonzero(np.bitwise_count(x[s : s + 512, None] ^ x[None, :]) <= distance)
                    keep = lab[a + s] != lab[b]
                    if keep.any():
                        lab = spanning((lab[a[keep] + s], lab[b[keep]]), len(x))[lab]
                child = np.flatnonzero(lab != np.arange(len(x)))
                v.append(r[child])
                p.append(r[lab[child]])
            if v and (n := sum(map(len, v))):
                yield table_of(schema, late=np.zeros(n, bool), c=np.zeros(n, np.int8), k=np.zeros(n, np.int64), v=np.concatenate(v), p=np.concatenate(p))

    return work


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, most: int = 2048) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    The component is that of all documents reachable over fingerprints that
    differ in at most ``distance`` bits; its id is its smallest ``doc_id``.  A
    null or empty text has fingerprint zero and links like any other.  A row with
    a null id is returned with its fingerprint and a null component, and links
    with nothing; rows that repeat an id each get their own fingerprint, and the
    id connects them: it has one component.  Ties (equal fingerprints) are one
    group.  A very long text's shingles are counted a bounded number at a time.
    Further columns, whatever their names, are not looked at.  An empty table
    gives no rows.
    """
    f = save(fingerprints(docs, id_col, text_col, words), "fingerprints")
    reps = save(f.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    # one id may carry several fingerprints (repeated rows), which it then connects
    ids = f.where("doc_id is not null").join(reps, "fp").select(F.col("doc_id").alias("id"), "rep")
    roots = components(links(reps, distance, most).unionByName(shared_ids(ids)))
    known = save(reps.join(roots, reps.rep == roots.v, "left").select(F.col("fp").alias("kfp"), F.coalesce("root", "rep").alias("component_id")), "components")
    return f.join(known, f.fp == known.kfp, "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, distance: int = 6, **kw) -> DataFrame:
    """The rows of ``docs`` that stay: of each group that with the smallest id.

    Rows with a null id stay.  Columns are those of ``docs``.
    """
    groups = simhash_groups(docs, id_col, text_col, words, distance, **kw)
    return without(docs, id_col, groups.where("doc_id > component_id"), "doc_id")
