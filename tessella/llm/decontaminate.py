"""Benchmark passages in documents by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import Tokens, save, shingles, strings, table_of, tidy, tokens_of, without

#: Different benchmark texts of a block and their bytes, at most (a longer text is a block of its own); each block is one pass over the documents.
ITEMS = 20_000
BLOCK_BYTES = 16 << 20
_MASK = (1 << 61) - 1
_BASE = 1_000_003


def tiles(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """(place in doc, place in item, length) of the tiles of greedy string tiling.

    Repeats with a search length that halves from the item's length to ``least``:
    find all matches of at least that many unmarked tokens by running Karp-Rabin
    hashes, extend each to its full length and mark them, the longest first and
    of equals the first; what is left of a match that a longer one cut counts
    as a match of its own.
    """
    free_d, free_i = [True] * len(doc), [True] * len(item)
    out = []
    length = len(item)
    while length >= least:
        table: dict[int, list[int]] = {}
        for at, h in _rolling(item, free_i, length):
            table.setdefault(h, []).append(at)
        found = []
        if table:
            for at, h in _rolling(doc, free_d, length):
                for j in table.get(h, ()):
                    if at and j and free_d[at - 1] and free_i[j - 1] and doc[at - 1] == item[j - 1]:
                        continue  # within a match that begins before
                    n = 0
                    while at + n < len(doc) and j + n < len(item) and doc[at + n] == item[j + n] and free_d[at + n] and free_i[j + n]:
                        n += 1
                    if n >= length:
                        found.append((-n, at, j))
        heapq.heapify(found)
        while found:
            minus, at, j = heapq.heappop(found)
            n = -minus
            if all(free_d[at : at + n]) and all(free_i[j : j + n]):
                free_d[at : at + n] = [False] * n
                free_i[j : j + n] = [False] * n
                out.append((at, j, n))
                continue
            run = 0
            for k in range(n + 1):
                if k < n and free_d[at + k] and free_i[j + k]:
                    run += 1
                    continue
                if run >= length:
                    heapq.heappush(found, (-run, at + k - run, j + k - run))
                run = 0
        if length == least:
            break
        length = max(least, min(length // 2, _longest_run(free_i)))
    return out


def _longest_run(free: list[bool]) -> int:
    best = run = 0
    for x in free:
        run = run + 1 if x else 0
        best = max(best, run)
    return best


def _rolling(tokens: list[int], free: list[bool], n: int) -> Iterator[tuple[int, int]]:
    """(place, hash) of all runs of n unmarked tokens."""
    top = pow(_BASE, n - 1, _MASK)
    h = run = 0
    for i, x in enumerate(tokens):
        if not free[i]:
            h = run = 0
            continue
        if run == n:
            h = (h - tokens[i - n] * top) % _MASK
        else:
            run += 1
        h = (h * _BASE + x) % _MASK
        if run == n:
            yield i - n + 1, h


class Benchmark:
    """Seeds of a block of items: which runs of ``least`` tokens occur where."""

    def __init__(self, ids: list[int], texts: list[str], least: int):
        t = Tokens(*strings(pa.array(texts, pa.large_string())))
        h = t.hashes()
        seed, at, first = shingles(h, t.first, least)
        self.ids = np.array(ids, np.int64)
        self.tokens = [h[a:b].tolist() for a, b in zip(t.first[:-1], t.first[1:])]
        self.size = np.diff(t.first)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        item = np.repeat(np.arange(len(ids)), np.diff(first))
        self.item = item[order]
        self.place = (at - t.first[item])[order]
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (seed, entry of the table)."""
        at = np.flatnonzero(self.quick[(seed & np.uint64((1 << 20) - 1)).astype(np.int64)])
        lo = np.searchsorted(self.seed, seed[at], "left")
        n = np.searchsorted(self.seed, seed[at], "right") - lo
        ends = np.cumsum(n)
        return np.repeat(at, n), np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 3,
    coverage: float = 0.6,
    items: int = ITEMS,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``coverage``, ``n_tiles``, ``longest_tile`` of documents that hold benchmark items.

    ``coverage`` is the share of the item's tokens that tiles of at least
    ``least`` tokens cover, in whatever order and place the document has them.
    Tokens are lower-cased (A-Z) and end at white space.  Null and empty texts
    hold nothing; items that are null or of fewer than ``least`` tokens are never
    found; rows with null or repeated ids are matched like others.  Items of
    equal texts are matched once and returned under each of their ids.  Of equally
    long matches the first is marked.  An empty table of either kind gives no
    rows; further columns, whatever their names, are not looked at.

    Different texts are taken in blocks of bounded number and bytes, each one pass
    over the documents; a worker tiles only documents whose seeds could cover
    enough of an item, and of a very long document only the words in such seeds.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    texts = save(bench.select("text").distinct().withColumn("tid", F.monotonically_increasing_id()), "items")
    size = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    blocks = max(-(-size["n"] // items), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("longest_tile", pa.int32())])
    sql = "doc_id long, tid long, coverage double, n_tiles int, longest_tile int"

    def against(block: Benchmark) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def work(batches: Iterator[pa.RecordBatch]):
            b = sent.value
            for batch, t in tokens_of(batches, "text"):
                h = t.hashes()
                seed, at, _ = shingles(h, t.first, least)
                i, e = b.hits(seed)
                if not len(i):
                    continue
                doc, item, place = t.doc[at[i]], b.item[e], b.place[e]
                # tokens of the item that some seed covers: no tiling covers more
                pair = doc * len(b.ids) + item
                width = int(b.size.max()) + 1
                spots = np.unique(np.concatenate([pair * width + place + k for k in range(least)]))
                pairs, covered = np.unique(spots // width, return_counts=True)
                pairs = pairs[covered >= coverage * b.size[pairs % len(b.ids)] - 1e-9]
                if not len(pairs):
                    continue
                keep = np.isin(pair, pairs)
                pair, start = pair[keep], at[i][keep]
                order = np.lexsort((start, pair))
                pair, start = pair[order], start[order]
                rows = []
                for p in pairs.tolist():
                    lo, hi = np.searchsorted(pair, p, "left"), np.searchsorted(pair, p, "right")
                    d, k = divmod(p, len(b.ids))
                    # tokens outside all seeds match nothing: a mark that no item has stands for them
                    spot = np.unique((start[lo:hi, None] + np.arange(least)).ravel())
                    gaps = np.flatnonzero(np.diff(spot) > 1) + 1
                    text = np.insert(h[spot].astype(object), gaps, -1).tolist()
                    got = tiles(text, b.tokens[k], least)
                    share = sum(n for _, _, n in got) / int(b.size[k])
                    if share >= coverage - 1e-9:
                        rows.append((batch.column("doc_id")[d].as_py(), int(b.ids[k]), share, len(got), max(n for _, _, n in got)))
                if rows:
                    yield table_of(schema, **dict(zip(schema.names, map(list, zip(*rows)))))

        return rows.mapInArrow(tidy(work), sql)

    out = None
    for k in range(blocks):
        block = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("tid").toPandas()
        found = save(against(Benchmark(block["tid"].tolist(), block["text"].tolist(), least)), "contaminated")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], sql.replace("tid", "item_id"))
    ids = bench.join(texts, "text").select("tid", "item_id")
    return out.join(ids, "tid").select("doc_id", "item_id", "coverage", "n_tiles", "longest_tile")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay.

    Rows that repeat an id go together.  See :func:`contaminated` for the rest.
    """
    return without(docs, id_col, contaminated(docs, benchmark, id_col, text_col, **kw).where("doc_id is not null"), "doc_id")
