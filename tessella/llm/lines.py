"""Near-duplicate lines by an exact set-similarity join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import SLICE_BYTES, Tokens, among, drop, filter_of, fresh, mark_by, mix, pieces, runs_of_keys, save, table_of, tidy

#: Counters of the rarity table; its size does not depend on the data.
COUNTERS = 1 << 20
_PART = 1 << 14
#: Rows of token lists in a bucket, about; a task holds one bucket.
BUCKET_ROWS = 200_000
#: Longer lists of lines that share a token are dealt out again as pairs of parts.
MOST = 8_192
#: Rows of token lists that a worker gathers before it sends them on.
HELD_ROWS = 400_000
#: Candidate pairs that are looked at side by side.
STEP = 1 << 19


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def token_rarity(docs: DataFrame, text_col: str = "text", similar: float = 0.8) -> tuple[np.ndarray, int]:
    """Occurrences of tokens over all texts, and how many rows the token lists will have at most.

    Tokens are counted by a hash into COUNTERS counters; those that share a
    counter count together.  The table only orders tokens, any order that all
    lines share gives the same pairs, and a token that is alone in its counter
    and occurs once is in one line only.
    """

    def work(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(COUNTERS, np.uint32)
        rows = 0
        for _, data, offsets, _, _ in pieces(batches, "text"):
            t = Tokens(data, offsets)
            total += np.bincount(_counter(t.hashes()), minlength=COUNTERS).astype(np.uint32)
            n = np.diff(t.line_first)
            rows += int((n - least_shared(n, similar) + 1)[n > 0].sum())
        for k, part in enumerate(total.reshape(-1, _PART)):
            some = np.flatnonzero(part)
            if len(some):
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int32()), "at": [some.astype(np.uint16).tobytes()], "n": [part[some].tobytes()], "rows": pa.array([0], pa.int64())})
        yield pa.RecordBatch.from_pydict({"part": pa.array([-1], pa.int32()), "at": [b""], "n": [b""], "rows": pa.array([rows], pa.int64())})

    def merge(batches: Iterator[pa.RecordBatch]):
        for found in runs_of_keys(batches, ["part"]):
            total = np.zeros(_PART, np.uint64)
            for at, n in zip(found.column("at").to_pylist(), found.column("n").to_pylist()):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
            yield pa.RecordBatch.from_pydict({"part": found.column("part")[:1].combine_chunks(), "n": [np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes()], "rows": pa.array([sum(found.column("rows").to_pylist())], pa.int64())})

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(work), "part int, at binary, n binary, rows long")
    out, rows = np.zeros((COUNTERS // _PART, _PART), np.uint32), 0
    for r in counted.repartition("part").sortWithinPartitions("part").mapInArrow(tidy(merge), "part int, n binary, rows long").collect():  # one row for each part
        rows += r["rows"]
        if r["part"] >= 0:
            out[r["part"]] = np.frombuffer(r["n"], np.uint32)
    return out.ravel(), rows


def line_sets(t: Tokens, rarity: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sets of tokens of all lines that have any: number of each line, its set's bounds in the tokens, the tokens and the sets' hashes.

    Tokens are ordered by rarity, the rarest first, then by the low bits of their
    hash and last by all of it; without ``rarity`` by the hash alone.  The order
    is the same for all lines, whatever they stand beside.
    """
    size = np.diff(t.line_first)
    line = np.flatnonzero(size)
    h, nth = t.hashes(), np.repeat(np.arange(len(line), dtype=np.uint64), size[line])
    if rarity is None:
        key = h & np.uint64((1 << 44) - 1)
    else:
        key = np.minimum(rarity[_counter(h)], (1 << 22) - 1).astype(np.uint64) << np.uint64(22) | h & np.uint64((1 << 22) - 1)
    # one number holds the order but for the last of it, where different tokens of a line have equal keys
    whole = len(line) < 1 << 20
    number = nth << np.uint64(44) | key
    order = np.argsort(number)
    same = number[order][1:] == number[order][:-1]
    if not whole or (same & (h[order][1:] != h[order][:-1])).any():
        order = np.lexsort((h, key, nth))
        same = (h[order][1:] == h[order][:-1]) & (nth[order][1:] == nth[order][:-1])
    h = h[order]
    # texts keep their place in the order, so the lines' numbers are those from before it
    once = np.append(True, ~same) if len(h) else np.zeros(0, bool)
    h, nth = h[once], nth[once]
    bounds = np.append(0, np.cumsum(np.bincount(nth.astype(np.int64), minlength=len(line))))
    total = np.append(np.uint64(0), np.cumsum(mix(h)))
    sig = mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)
    return line, bounds, h, sig


def least_shared(n: np.ndarray, similar: float) -> np.ndarray:
    """Fewest tokens that a set of n shares with any set as similar."""
    return np.ceil(n * similar - 1e-9).astype(np.int64)


#: A line in the list of a token: its place (document, line), the set's hash, its size, the token's rank in it and the set's parity.
#: The parity is 128 bits; each token flips one.  Two sets differ in at least as many tokens as their bits do.
ROW = np.dtype([("token", "<u4"), ("n", "<u4"), ("pos", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("sig", "<i8"), ("odd1", "<u8"), ("odd2", "<u8")])
PLACE = np.dtype([("doc", "<i8"), ("line", "<u4")])
GONE, LISTS = 0, 1


def _blobs(bucket: np.ndarray, rows: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
    """Rows packed into one value for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(rows) else np.zeros(0, np.int64)
    for i in range(0, len(at), 256):
        lo = at[i : i + 256]
        ends = np.append(lo, at[i + 256] if i + 256 < len(at) else len(rows))
        data = rows[ends[0] : ends[-1]]
        packed = pa.Array.from_buffers(pa.binary(), len(lo), [None, pa.py_buffer(((ends - ends[0]) * rows.itemsize).astype(np.int32)), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(bucket[lo].astype(np.int32)), pa.array(np.full(len(lo), kind, np.int8)), packed], names=["bucket", "kind", "rows"])


def _list_rows(docs: DataFrame, rarity: np.ndarray, similar: float, words: int, buckets: int) -> DataFrame:
    """``bucket``, ``kind``, ``rows``: packed rows of the token lists (LISTS), and places of lines that repeat another line's set (GONE).

    A worker sends each set that it gathers once, with its first place.
    """
    sent = docs.sparkSession.sparkContext.broadcast(rarity)
    many = np.uint64(buckets)

    def send(held: list[tuple[np.ndarray, ...]]):
        doc, line, sig, n, odd1, odd2 = (np.concatenate([x[i] for x in held]) for i in range(6))
        size = np.concatenate([x[6] for x in held])
        tokens = np.concatenate([x[7] for x in held])
        solo = np.concatenate([x[8] for x in held])
        order = np.lexsort((line, doc, sig))
        again = np.zeros(len(sig), bool)
        again[order[1:]] = sig[order][1:] == sig[order][:-1]
        head = order[np.maximum.accumulate(np.where(again[order], 0, np.arange(len(sig))))]
        later = np.empty(len(sig), bool)  # rows that repeat an id may hold a set at its first place again
        later[order] = (doc[order] != doc[head]) | (line[order] != line[head])
        later &= again
        gone = np.empty(int(later.sum()), PLACE)
        gone["doc"], gone["line"] = doc[later], line[later]
        yield from _blobs((np.arange(len(gone)) // 65536 + int(sig[0]) % 64).astype(np.uint32) % np.uint32(buckets), gone, GONE)
        owner = np.repeat(np.arange(len(sig)), size)
        pos = (np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
        keep = np.flatnonzero(~again[owner] & ~solo)
        owner = owner[keep]
        rows = np.empty(len(keep), ROW)
        rows["token"], rows["pos"] = tokens[keep], pos[keep]
        for f, x in (("n", n), ("line", line), ("doc", doc), ("sig", sig), ("odd1", odd1), ("odd2", odd2)):
            rows[f] = x[owner]
        bucket = mix(rows["token"].astype(np.uint64)) % many
        yield from _blobs(bucket.astype(np.uint16 if buckets <= 1 << 16 else np.uint32), rows, LISTS)

    def work(batches: Iterator[pa.RecordBatch]):
        held, count, lines_before = [], 0, 0
        for batch, data, offsets, piece, last in pieces(batches, "text", SLICE_BYTES):
            t = Tokens(data, offsets)
            if piece == 0:
                lines_before = 0
            line, bounds, h, sig = line_sets(t, sent.value)
            n = np.diff(bounds)
            ok = np.flatnonzero(n >= words)
            if len(ok):
                lo, n, line, sig = bounds[:-1][ok], n[ok], line[ok], sig[ok]
                doc = np.searchsorted(t.text_line, line, "right") - 1
                size = n - least_shared(n, similar) + 1
                ends = np.append(0, np.cumsum(size))
                pick = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
                tokens = (h[pick] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                solo = sent.value[_counter(h[pick])] == 1
                # sets so small that only equal ones match: their hash is their list
                alike = n / (n + 1) < similar - 1e-9
                tokens[ends[:-1][alike]] = (mix(sig[alike].view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
                odd = [np.bitwise_xor.reduceat(np.where((h >> np.uint64(6)) & np.uint64(1) == k, np.uint64(1) << (h & np.uint64(63)), np.uint64(0)), bounds[:-1])[ok] for k in (0, 1)]
                ids = batch.column("doc_id").to_numpy()
                held.append((ids[doc], (line - t.text_line[doc] + lines_before).astype(np.uint32), sig, n.astype(np.uint32), odd[0], odd[1], size, tokens, solo))
                count += len(tokens)
            # a piece ends after a line's end: what its last line would be begins the next piece
            lines_before += len(t.line_first) - 2 if not last else 0
            if count >= HELD_ROWS:
                yield from send(held)
                held, count = [], 0
        if held:
            yield from send(held)

    return docs.mapInArrow(tidy(work), "bucket int, kind byte, rows binary")


_FOUND = "kind byte, list long, x long, doc_id long, line int, y long, y_doc long, more boolean, rows binary"
_FOUND_ARROW = pa.schema([("kind", pa.int8()), ("list", pa.int64()), ("x", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32()), ("y", pa.int64()), ("y_doc", pa.int64()), ("more", pa.bool_()), ("rows", pa.binary())])
#: Kinds of what the lists give: GONE, candidate pairs, lists with more candidates, lists too long for one task.
PAIR, LATE, LONG = 1, 2, 3


def _found(kind: int, n: int, **cols) -> pa.RecordBatch:
    given = {"kind": np.full(n, kind, np.int8)} | cols
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if f.name not in given else pa.array(given[f.name], f.type) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _one_of_each(rows: np.ndarray, gone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one for each token and set, that of the first place, by token and size; and the rows of the rarest tokens' lists left out."""
    key = rows["token"].astype(np.uint64) << np.uint64(32) | rows["sig"].view(np.uint64) >> np.uint64(32)
    order = np.argsort(key)
    key = key[order]
    near = np.zeros(len(key), bool)
    near[1:] = key[1:] == key[:-1]
    out = np.zeros(0, ROW)
    if near.any():
        near[:-1] |= near[1:]
        at = order[near]
        at = at[np.lexsort((rows["line"][at], rows["doc"][at], rows["sig"][at], rows["token"][at]))]
        again = np.zeros(len(at), bool)
        again[1:] = (rows["sig"][at][1:] == rows["sig"][at][:-1]) & (rows["token"][at][1:] == rows["token"][at][:-1])
        left_out = at[again]
        if gone:
            head = at[np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))][again]
            later = (rows["doc"][left_out] != rows["doc"][head]) | (rows["line"][left_out] != rows["line"][head])
            out = rows[left_out[later & (rows["pos"][left_out] == 0)]]
        keep = np.ones(len(rows), bool)
        keep[left_out] = False
        order = order[keep[order]]
        rows = rows[order]
    else:
        rows = rows[order]
    by = np.argsort(rows["token"].astype(np.uint64) << np.uint64(32) | rows["n"])
    return rows[by], out


def _candidates(rows: np.ndarray, similar: float, side: np.ndarray | None = None, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (later, earlier) that the length, parity and positional filters leave, of rows by token and size.

    With ``side`` only pairs across; with ``only`` (a mask) only later rows so marked.
    """
    token, n = rows["token"].astype(np.uint64) << np.uint64(32), rows["n"].astype(np.int64)
    key = token | rows["n"]
    far = np.minimum(np.floor(n / similar + 1e-9), (1 << 32) - 1).astype(np.uint64)
    stop = np.searchsorted(key, token | far, "right")
    count = stop - np.arange(len(rows)) - 1
    ends = np.cumsum(count)
    pos, doc, line, odd1, odd2 = (np.ascontiguousarray(rows[f]) for f in ("pos", "doc", "line", "odd1", "odd2"))
    share = (1 - similar) / (1 + similar)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        c = count[lo:hi]
        for first in range(0, int(c.max(initial=0)) if hi - lo == 1 else 1, STEP):  # one row may have many
            if hi - lo == 1:
                j = np.arange(lo + 1 + first, min(lo + 1 + first + STEP, int(stop[lo])))
                i = np.full(len(j), lo)
            else:
                i = np.repeat(np.arange(lo, hi), c)
                j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + i + 1
            apart = np.bitwise_count(odd1[i] ^ odd1[j]) + np.bitwise_count(odd2[i] ^ odd2[j])
            ok = np.flatnonzero(apart <= (n[i] + n[j]) * np.float32(share) + np.float32(0.01))
            i, j = i[ok], j[ok]
            need = np.ceil(similar / (1 + similar) * (n[i] + n[j]) - 1e-9)
            good = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need
            good &= apart[ok] <= n[i] + n[j] - 2 * need
            good &= (doc[i] != doc[j]) | (line[i] != line[j])
            if side is not None:
                good &= side[i] != side[j]
            i, j = i[good], j[good]
            swap = (doc[i] < doc[j]) | (doc[i] == doc[j]) & (line[i] < line[j])
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            if only is not None:
                i, j = i[only[i]], j[only[i]]
            if len(i):
                yield i, j
        lo = hi


def _pairs(rows: np.ndarray, similar: float, lists: np.ndarray, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Each line with its earliest candidate in each list, and lists where some line has more than one."""
    if not len(rows):
        return
    order = np.lexsort((rows["line"], rows["doc"]))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.arange(len(rows))
    best, seen = np.full(len(rows), len(rows)), np.zeros(len(rows), np.int64)
    for i, j in _candidates(rows, similar, side):
        np.minimum.at(best, i, rank[j])
        seen += np.bincount(i, minlength=len(rows))
    x = np.flatnonzero(seen)
    if len(x):
        y = order[best[x]]
        yield _found(PAIR, len(x), list=lists[x], x=rows["sig"][x], doc_id=rows["doc"][x], line=rows["line"][x].astype(np.int32), y=rows["sig"][y], y_doc=rows["doc"][y], more=seen[x] > 1)
    some = np.unique(lists[seen > 1])
    if len(some):
        at = np.flatnonzero(np.isin(lists, some))
        by = np.argsort(lists[at], kind="stable")
        yield from _packed_lists(LATE, lists[at][by], rows[at][by])


def _packed_lists(kind: int, lists: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows packed into one value for each list; equal lists stand together."""
    at = np.flatnonzero(np.append(True, lists[1:] != lists[:-1])).tolist()
    for i in range(0, len(at), 256):
        ends = [*at[i : i + 257], len(rows)][:257]
        yield _found(kind, len(ends) - 1, list=lists[ends[:-1]], rows=[rows[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])])


def _lists_worker(similar: float):
    """Pairs of the token lists of each bucket; lists that are too long go on as they are."""

    def finish(held: list[np.ndarray]):
        rows, gone = _one_of_each(np.concatenate(held), True)
        if len(gone):
            yield _found(GONE, len(gone), doc_id=gone["doc"], line=gone["line"].astype(np.int32))
        size = np.bincount(np.cumsum(np.append(0, rows["token"][1:] != rows["token"][:-1]))) if len(rows) else np.zeros(0, np.int64)
        size = np.repeat(size, size)
        yield from _pairs(rows[(size > 1) & (size <= MOST)], similar, rows["token"][(size > 1) & (size <= MOST)].astype(np.int64))
        if (size > MOST).any():
            many = rows[size > MOST]
            yield from _packed_lists(LONG, many["token"].astype(np.int64), many)

    def work(batches: Iterator[pa.RecordBatch]):
        held: list[np.ndarray] = []
        now, count, long = None, 0, np.zeros(0, np.uint32)
        for batch in batches:
            for bucket, kind, packed in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("rows")):
                if kind == GONE:
                    gone = np.frombuffer(packed.as_buffer(), PLACE)
                    yield _found(GONE, len(gone), doc_id=gone["doc"], line=gone["line"].astype(np.int32))
                    continue
                if held and bucket != now:
                    yield from finish(held)
                    held, count, long = [], 0, np.zeros(0, np.uint32)
                now = bucket
                rows = np.frombuffer(packed.as_py(), ROW)
                if len(long):
                    mine = np.isin(rows["token"], long)
                    if mine.any():
                        some = rows[mine][np.argsort(rows["token"][mine], kind="stable")]
                        yield from _packed_lists(LONG, some["token"].astype(np.int64), some)
                        rows = rows[~mine]
                held.append(rows)
                count += len(rows)
                if count >= 10 * BUCKET_ROWS:  # some list of this bucket is long
                    rows, gone = _one_of_each(np.concatenate(held), True)
                    if len(gone):
                        yield _found(GONE, len(gone), doc_id=gone["doc"], line=gone["line"].astype(np.int32))
                    token, size = np.unique(rows["token"], return_counts=True)
                    long = np.union1d(long, token[size > MOST])
                    mine = np.isin(rows["token"], long)
                    if mine.any():
                        yield from _packed_lists(LONG, rows["token"][mine].astype(np.int64), rows[mine])
                    held, count = [rows[~mine]], int((~mine).sum())
        if held:
            yield from finish(held)

    return work


def _long_lists(found: DataFrame, similar: float) -> DataFrame:
    """What the lists give that are too long for a task: their parts by the sets' hashes, compared two by two."""
    long = found.where(F.col("kind") == LONG).select("list", "rows")
    parts = long.groupBy("list").agg(F.ceil(F.sum(F.octet_length("rows")) / F.lit(MOST * ROW.itemsize)).cast("int").alias("parts"))

    def deal(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, parts, packed in zip(*(batch.column(c).to_pylist() for c in ("list", "parts", "rows"))):
                rows = np.frombuffer(packed, ROW)
                part = (mix(rows["sig"].astype(np.uint64)) >> np.uint64(32)) % np.uint64(parts)
                mine = [(p, rows[part == p].tobytes()) for p in np.unique(part).tolist()]
                for other in range(parts):
                    yield pa.RecordBatch.from_pydict({"list": [name] * len(mine), "i": pa.array([min(p, other) for p, _ in mine], pa.int32()), "j": pa.array([max(p, other) for p, _ in mine], pa.int32()), "right": [p > other for p, _ in mine], "rows": [r for _, r in mine]})

    def compare(batches: Iterator[pa.RecordBatch]):
        for got in runs_of_keys(batches, ["list", "i", "j"]):
            i, j = got.column("i")[0].as_py(), got.column("j")[0].as_py()
            sides = [np.concatenate([np.zeros(0, ROW), *(np.frombuffer(p, ROW) for p, r in zip(got.column("rows").to_pylist(), got.column("right").to_pylist()) if r == right)]) for right in (False, True)]
            one = [_one_of_each(s, i == j) for s in sides]
            gone = np.concatenate([g for _, g in one])
            if len(gone):
                yield _found(GONE, len(gone), doc_id=gone["doc"], line=gone["line"].astype(np.int32))
            rows = np.concatenate([s for s, _ in one])
            side = np.repeat([0, 1], [len(s) for s, _ in one])
            by = np.argsort(rows["token"].astype(np.uint64) << np.uint64(32) | rows["n"], kind="stable")
            name = int(mix(np.array([got.column("list")[0].as_py() << 32 | i << 16 ^ j], np.uint64)).view(np.int64)[0])
            yield from _pairs(rows[by], similar, np.full(len(rows), name), None if i == j else side[by])

    keys = ["list", "i", "j"]
    dealt = long.join(parts, "list").mapInArrow(tidy(deal), "list long, i int, j int, right boolean, rows binary")
    return save(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(compare), _FOUND), "long-lists")


def _open_rows(packed: bytes, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A list's rows by token and size, and which of them are ``wanted``."""
    rows = np.frombuffer(packed, ROW)
    rows = rows[np.argsort(rows["token"].astype(np.uint64) << np.uint64(32) | rows["n"], kind="stable")]
    return rows, np.isin(rows["sig"], np.array(wanted, np.int64))


def _late(docs: DataFrame, lists: DataFrame, similar: float) -> DataFrame:
    """``doc_id``, ``line`` of the lines ``open`` in each list (``rows``) that match any earlier line of it.

    The sets of a list's lines come to it, each once, and are compared there;
    pairs are neither written nor sent.
    """

    def lines_of(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for name, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("list", "rows", "open"))):
                rows, only = _open_rows(packed, wanted)
                asked = np.zeros(len(rows), bool)
                for i, j in _candidates(rows, similar, None, only):
                    asked[i] = asked[j] = True
                at = np.flatnonzero(asked)
                at = at[np.unique(rows["sig"][at], return_index=True)[1]]
                if len(at):
                    yield table_of(asked_schema, list=np.full(len(at), name, np.int64), sig=rows["sig"][at], doc_id=rows["doc"][at])

    def compare(batches: Iterator[pa.RecordBatch]):
        for got in runs_of_keys(batches, ["list"]):
            given = got.filter(pc.is_valid(got.column("sig")))
            if not given.num_rows:
                continue
            known, first = np.unique(given.column("sig").to_numpy(), return_index=True)
            sets = given.column("set").combine_chunks()
            values, size = sets.flatten().to_numpy().view(np.uint64), np.diff(sets.offsets.to_numpy())
            begin = np.cumsum(size) - size
            for packed, wanted in zip(*(got.filter(pc.is_valid(got.column("rows"))).column(c).to_pylist() for c in ("rows", "open"))):
                rows, only = _open_rows(packed, wanted)
                at = first[np.minimum(np.searchsorted(known, rows["sig"]), len(known) - 1)]
                done = np.zeros(len(rows), bool)
                for i, j in _candidates(rows, similar, None, only):
                    for k in range(0, len(i), 4096):
                        x, y = i[k : k + 4096], j[k : k + 4096]
                        x, y = x[~done[x]], y[~done[x]]
                        if len(x):
                            sides = []
                            for one in (at[x], at[y]):
                                n = size[one]
                                sides.append((values[np.repeat(begin[one] - np.cumsum(n) + n, n) + np.arange(n.sum())], n))
                            done[x[_alike(sides, similar)]] = True
                hit = np.flatnonzero(done)
                if len(hit):
                    yield table_of(out, doc_id=rows["doc"][hit], line=rows["line"][hit].astype(np.int32))

    asked_schema = pa.schema([("list", pa.int64()), ("sig", pa.int64()), ("doc_id", pa.int64())])
    out = pa.schema([("doc_id", pa.int64()), ("line", pa.int32())])
    asked = save(lists.mapInArrow(tidy(lines_of), "list long, sig long, doc_id long"), "late-lines")
    sets = _sets(docs, asked)
    with_sets = asked.select("list", "sig").join(sets.hint("merge"), "sig").select("list", "sig", "set", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("array<long>").alias("open"))
    both = with_sets.unionByName(lists.select("list", F.lit(None).cast("long").alias("sig"), F.lit(None).cast("array<long>").alias("set"), "rows", "open"))
    found = save(both.repartition("list").sortWithinPartitions("list").mapInArrow(tidy(compare), "doc_id long, line int"), "late")
    drop(asked)
    drop(sets)
    return found


def _alike(sides: list[tuple[np.ndarray, np.ndarray]], similar: float) -> np.ndarray:
    """Numbers of the pairs with a Jaccard similarity of ``similar`` or more; a side has the tokens of its sets one after the other, and their sizes."""
    rows = np.arange(len(sides[0][1]))
    owner = np.concatenate([np.repeat(rows, n) for _, n in sides])
    key = mix(np.concatenate([v for v, _ in sides]) + mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    shared = np.bincount(owner[1:][key[1:] == key[:-1]], minlength=len(rows))
    return np.flatnonzero(shared >= similar * (sides[0][1] + sides[1][1] - shared) - 1e-9)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``sig`` and ``set`` (array of long) of the lines ``wanted`` (``sig``, ``doc_id``), and perhaps of a few others."""
    # a set's hash is spread over all bits, so that the key is too
    sent = docs.sparkSession.sparkContext.broadcast((filter_of(wanted, "doc_id"), filter_of(wanted.select(F.col("sig").bitwiseXOR(F.col("doc_id")).alias("key")), "key")))
    schema = pa.schema([("sig", pa.int64()), ("set", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]):
        docs, lines = sent.value
        near = (b.filter(pa.array(docs.has(b.column("doc_id").to_numpy()))) for b in batches)
        for batch, data, offsets, _, _ in pieces(near, "text"):
            t = Tokens(data, offsets)
            line, bounds, h, sig = line_sets(t, None)
            doc = np.searchsorted(t.text_line, line, "right") - 1
            ok = np.flatnonzero(lines.has(sig ^ batch.column("doc_id").to_numpy()[doc]))
            ok = ok[np.sort(np.unique(sig[ok], return_index=True)[1])]
            if len(ok):
                size = np.diff(bounds)[ok]
                ends = np.append(0, np.cumsum(size))
                pick = np.repeat(bounds[:-1][ok] - ends[:-1], size) + np.arange(ends[-1])
                yield table_of(schema, sig=sig[ok], set=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h[pick].view(np.int64))))

    # one worker a task: texts without such lines are left out there, too
    return save(docs.mapInArrow(tidy(work), "sig long, set array<long>"), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """``x``, ``doc_id``, ``line`` of the pairs whose sets have a Jaccard similarity of ``similar`` or more."""
    wanted = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("sig"), "doc_id"), F.struct(F.col("y").alias("sig"), F.col("y_doc").alias("doc_id")))).alias("w")).select("w.*")
    sets = _sets(docs, wanted)
    both = pairs.select("x", "y", "doc_id", "line").distinct()
    # merged at every size, as sets and texts grow with the input
    both = both.join(sets.select(F.col("sig").alias("x"), F.col("set").alias("sx")).hint("merge"), "x")
    both = both.join(sets.select(F.col("sig").alias("y"), F.col("set").alias("sy")).hint("merge"), "y").select("x", "doc_id", "line", "sx", "sy")
    out = pa.schema([("x", pa.int64()), ("doc_id", pa.int64()), ("line", pa.int32())])

    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                sides = [(arr.flatten().to_numpy().view(np.uint64), np.diff(arr.offsets.to_numpy())) for arr in (part.column("sx"), part.column("sy"))]
                hit = _alike(sides, similar)
                if len(hit):
                    yield table_of(out, **{f: part.column(f).to_numpy()[hit] for f in out.names})

    found = save(both.mapInArrow(tidy(check), "x long, doc_id long, line int").distinct(), "matched")
    drop(sets)
    return found


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id`` and ``lines`` (array of int, from 0): the lines of each text that match an earlier line.

    A line's set holds its lower-cased (A-Z) white-space tokens; a line matches
    one with a Jaccard similarity of ``similar`` or more that comes before it by
    (id, number of the line), whether or not that one is itself removed.  Lines
    of fewer than ``words`` different tokens are left alone.  Null texts and rows
    with a null id have no lines.  Rows that repeat an id count as one document:
    lines of one number stand at one place, none of them is earlier than another,
    and what goes there goes from each of the rows.
    Very long texts are read in pieces that end with a line; a single line is
    read whole.  Only texts with such lines are returned, of an empty table none.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    rarity, rows = token_rarity(docs, "text", similar)
    dealt = _list_rows(docs, rarity, similar, words, max(64, -(-rows // BUCKET_ROWS))).repartition("bucket").sortWithinPartitions("bucket")
    found = made = save(dealt.mapInArrow(tidy(_lists_worker(similar)), _FOUND), "lists")
    long = None
    if not found.where(F.col("kind") == LONG).isEmpty():
        long = _long_lists(found, similar)
        found = found.unionByName(long)
    pairs = found.where(F.col("kind") == PAIR)
    gone = found.where(F.col("kind") == GONE).select("doc_id", "line")
    tables = [made, long]
    if not pairs.isEmpty():
        matched = _verified(docs, pairs, similar)
        gone = gone.unionByName(matched.select("doc_id", "line"))
        # lines that match none of their first candidates are held against all others
        open_ = pairs.where("more").select("list", "x").join(matched.select("x"), "x", "left_anti")
        open_ = save(open_.groupBy("list").agg(F.collect_set("x").alias("open")), "open")
        lists = among(found.where(F.col("kind") == LATE).select("list", "rows"), "list", filter_of(open_, "list"))
        lists = save(lists.join(open_.hint("merge"), "list"), "late-lists")
        tables += [matched, open_, lists]
        if not lists.isEmpty():
            late = _late(docs, lists, similar)
            gone = gone.unionByName(late)
            tables.append(late)
    out = save(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    for t in tables:
        if t is not None:
            drop(t)
    return out


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines of ``gone``, with ``removed_lines`` and ``n_lines`` (long) added, or replaced.

    Texts keep everything else, their line ends included.  Only texts that lose
    lines are shuffled, and only they are sent to Python workers.
    """
    docs = docs.drop("removed_lines", "n_lines")
    schema = docs.schema
    names = schema.names
    key, cuts, hit = fresh(docs, "_id"), fresh(docs, "_lines"), fresh(docs, "_hit")
    gone = gone.select(F.col("doc_id").alias(key), F.col("lines").alias(cuts))
    at = names.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts, removed = [], []
                for text, lines in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    gone_here = set(lines or ())
                    removed.append(len(gone_here))
                    texts.append("\n".join([p for k, p in enumerate(text.split("\n")) if k not in gone_here]) if gone_here and text is not None else text)
                cols = [c if k != at else pa.array(texts, c.type) for k, c in enumerate(batch.columns[: len(names)])]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int64()), batch.column(len(names))], names=[*names, "removed_lines", "n_lines"])

    text = F.col(text_col)
    counted = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")
    marked = mark_by(docs.withColumn("n_lines", counted), id_col, filter_of(gone, key), hit)
    plain = marked.where(~F.col(hit)).select(*names, F.lit(0).cast("long").alias("removed_lines"), "n_lines")
    joined = marked.where(F.col(hit)).drop(hit)
    joined = joined.join(gone.hint("merge"), joined[id_col].cast("long") == gone[key], "left").drop(key)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return plain.unionByName(joined.mapInArrow(tidy(cut), f"{out}, removed_lines long, n_lines long"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = 0.8, words: int = 5) -> DataFrame:
    """:func:`drop_lines` of the lines that :func:`repeated_lines` finds."""
    return drop_lines(docs, repeated_lines(docs, id_col, text_col, similar, words), id_col, text_col)
