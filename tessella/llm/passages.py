"""Passages that repeat across documents, by collinear chains of shared seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import Tokens, drop, filter_of, mark_by, mix, runs, save, shingles, table_of, tidy, tokens_of

#: What a word between two seeds of a chain costs, on either side.
GAP = 0.1


def least_of(seed: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Index of the least seed of each one's ``window``, which begins with it and ends with its text; the rightmost of equals."""
    n = len(seed)
    best = np.arange(n)
    end = np.repeat(first[1:], np.diff(first))
    have = 1
    while have < window:  # windows twice as wide, the last time less
        step = min(have, window - have)
        other = best[np.minimum(np.arange(n) + step, end - 1)]
        best = np.where(seed[other] <= seed[best], other, best)
        have += step
    return best


def minimizers(seed: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Indexes of the seeds that are least among some ``window`` neighbours of their text, the rightmost of equals.

    Texts that share ``window`` seeds in a row choose the same one of them.
    """
    return np.unique(least_of(seed, first, window))


def _long(t: Tokens, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of ``words`` words: hash and first token of each, and of the half as long shingle in it that stands for it.

    Equal shingles have the same one, at the same place.
    """
    h, half = t.hashes(), (words + 1) // 2
    whole, at, _ = shingles(h, t.first, words)
    part, part_at, first = shingles(h, t.first, half)
    best = least_of(part, first, words - half + 1)[np.searchsorted(part_at, at)]
    return whole, at, part[best], part_at[best]


def _exact_links(batches: Iterator[pa.RecordBatch]):
    """Runs of ``n`` long shingles with those of the first document that has them, from rows by (key, doc).

    Of the rows before, one for each different shingle of the last key is kept.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("src", pa.int64()), ("pos", pa.int32()), ("src_pos", pa.int32()), ("n", pa.int32())])
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("whole")
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(batch.num_rows), size)
        now = (batch.column("key").to_numpy()[row], lists.flatten().to_numpy(), batch.column("doc_id").to_numpy()[row], batch.column("pos").flatten().to_numpy())
        skip = len(held[0])
        key, whole, doc, pos = (np.concatenate(x) for x in zip(held, now))
        order = np.lexsort((np.arange(len(key)), whole, key))
        new = np.ones(len(key), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        head = np.empty(len(key), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        at = np.flatnonzero((doc != doc[head]) & (np.arange(len(key)) >= skip))
        if len(at):
            d, s, p, q = doc[at], doc[head[at]], pos[at], pos[head[at]]
            cut = np.ones(len(at), bool)
            cut[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
            lo = np.flatnonzero(cut)
            yield table_of(schema, doc_id=d[lo], src=s[lo], pos=p[lo], src_pos=q[lo], n=np.diff(np.append(lo, len(at))))
        keep = order[new]
        keep = keep[key[keep] == now[0][-1]]
        held = (key[keep], whole[keep], doc[keep], pos[keep])


def exact_runs(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id``, ``src``, ``pos``, ``src_pos``, ``n``: runs of words that are equal in ``src``, a document of smaller id.

    Every ``words`` words in a row that an earlier document has are in a run with
    the first such document, however frequent the phrases that make them up.
    A text's repeats of a key are one row.  Only shingles whose half is in two documents are shuffled; a filter of
    bounded size tells them, and what it lets through besides matches nothing.
    """
    keys = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])

    def halves(batches: Iterator[pa.RecordBatch]):
        for batch, t in tokens_of(batches, "text"):
            _, _, part, place = _long(t, words)
            place, i = np.unique(place, return_index=True)
            if len(i):
                yield table_of(keys, doc_id=batch.column("doc_id").to_numpy()[t.doc[place]], key=part[i].view(np.int64))

    twice = docs.mapInArrow(tidy(halves), "doc_id long, key long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("key")
    sent = docs.sparkSession.sparkContext.broadcast(filter_of(save(twice, "halves"), "key"))
    rows = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.list_(pa.int32())), ("whole", pa.list_(pa.int64()))])

    def wholes(batches: Iterator[pa.RecordBatch]):
        for batch, t in tokens_of(batches, "text"):
            whole, at, part, _ = _long(t, words)
            ok = sent.value.has(part.view(np.int64))
            whole, at, part = whole[ok], at[ok], part[ok].view(np.int64)
            if not len(at):
                continue
            order = np.lexsort((at, part, t.doc[at]))
            whole, at, part = whole[order], at[order], part[order]
            doc = t.doc[at]
            lo = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])))
            ends = pa.array(np.append(lo, len(at)).astype(np.int32))
            yield table_of(rows, key=part[lo], doc_id=batch.column("doc_id").to_numpy()[doc[lo]], pos=pa.ListArray.from_arrays(ends, pa.array((at - t.first[doc]).astype(np.int32))), whole=pa.ListArray.from_arrays(ends, pa.array(whole.view(np.int64))))

    found = docs.mapInArrow(tidy(wholes), "key long, doc_id long, pos array<int>, whole array<long>").repartition("key").sortWithinPartitions("key", "doc_id")
    return save(found.mapInArrow(tidy(_exact_links), "doc_id long, src long, pos int, src_pos int, n int").withColumn("n", (F.col("n") + (words - 1)).cast("int")), "exact")


def seeds(docs: DataFrame, k: int = 5, window: int = 5) -> DataFrame:
    """``doc_id``, ``seed``, ``pos`` (word) of the minimizers among the texts' k-word shingles.

    Of a seed's repeats in a text that overlap the first is kept, and those after its end.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("seed", pa.int64()), ("pos", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, t in tokens_of(batches, "text"):
            s, at, first = shingles(t.hashes(), t.first, k)
            pick = minimizers(s, first, window)
            if not len(pick):
                continue
            doc, seed = t.doc[at[pick]], s[pick].view(np.int64)
            pos = at[pick] - t.first[doc]
            order = np.lexsort((pos, seed, doc))
            doc, seed, pos = doc[order], seed[order], pos[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (seed[1:] != seed[:-1])
            keep = np.ones(len(doc), bool)
            close = np.flatnonzero(~new & (np.append(k, np.diff(pos)) < k))
            held = -1
            for i in close.tolist():  # within runs of overlapping repeats
                if i - 1 != held or keep[i - 1]:
                    last = pos[i - 1]
                keep[i] = pos[i] - last >= k
                held = i
            yield table_of(schema, doc_id=batch.column("doc_id").to_numpy()[doc[keep]], seed=seed[keep], pos=pos[keep].astype(np.int32))

    return docs.mapInArrow(tidy(work), "doc_id long, seed long, pos int")


_SHARED = pa.schema([("doc_id", pa.int64()), ("src", pa.int64()), ("pos", pa.int32()), ("src_pos", pa.int32()), ("key", pa.int64()), ("span", pa.int32()), ("before", pa.int64())])
_SHARED_SQL = "doc_id long, src long, pos int, src_pos int, key long, span int, before long"
#: Columns of keys made of two others: where the second begins, and what both were matched with.
_JOINED = ("span", "a", "b", "c", "d")


def _shared(joined: bool):
    """Later occurrences of a key with those in its first document and in that before, from rows by (key, doc, pos).

    Where a document repeats a key, its first occurrence is matched with the
    other document's first, its second with the second and so on, the rest with
    the last.  Of a run of equal keys only the occurrences in its first and its
    last document are kept for what follows.

    Occurrences of a key that is in three documents or more are rows, too, with
    the ``key``, its ``span``, and in ``src`` and ``before`` the documents that
    they were matched with: these keys are joined to longer ones.  ``joined``:
    keys are such; both ends are matched, unless both were matched before.
    """
    names = ("key", "doc_id", "pos", *(_JOINED if joined else ()))
    none = tuple(np.zeros(0, np.int32 if n in ("pos", "span") else np.int64) for n in names)

    def work(batches: Iterator[pa.RecordBatch]):
        done = rest = none  # rows of the last key that were matched, rows whose document may go on
        docs = 0  # documents of the last key

        def match(now: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            nonlocal done, docs
            if len(done[0]) and done[0][0] != now[0][0]:
                done, docs = none, 0
            skip = len(done[0])
            cols = tuple(np.concatenate(x) for x in zip(done, now))
            key, doc, pos = cols[:3]
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
            size = np.diff(np.append(at, len(key)))
            of = key[at]
            block = np.arange(len(at))
            fresh = np.append(True, of[1:] != of[:-1])
            head = np.maximum.accumulate(np.where(fresh, block, 0))
            later = np.flatnonzero((head != block) & (at >= skip))
            two = later[later - 1 != head[later]]
            x, y = np.concatenate([later, two]), np.concatenate([head[later], two - 1])
            if len(x):
                n = size[x]
                nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                i = np.repeat(at[x], n) + nth
                j = np.repeat(at[y], n) + np.minimum(nth, np.repeat(size[y], n) - 1)
                ends = [(pos[i], pos[j])]
                if joined:
                    span, a, b, c, d = cols[3:]
                    src = doc[j]
                    new = ~(((a[i] == src) | (b[i] == src)) & ((c[i] == src) | (d[i] == src)))
                    i, j = i[new], j[new]
                    ends = [(pos[i], pos[j]), (pos[i] + span[i], pos[j] + span[j])]
                for p, q in ends:
                    if len(i):
                        yield _rows_of(doc[i], doc[j], p, q)
            # documents of each run, those of the batches before included
            first = np.flatnonzero(fresh)
            count = np.diff(np.append(first, len(at)))
            told = docs >= 3  # rows of the run that goes on have been sent
            if skip:
                count[0] += docs - int((at < skip).sum())
            many = np.repeat(np.repeat(count >= 3, np.diff(np.append(first, len(at)))), size)
            if told:
                many[:skip] = False
            i = np.flatnonzero(many)
            if len(i):
                own = np.repeat(block, size)[i]
                start = head[own] == own
                src = np.where(start, -1, doc[at[head[own]]])
                before = np.where(start, -1, doc[at[np.maximum(own - 1, 0)]])
                yield _rows_of(doc[i], src, pos[i], None, key[i], cols[3][i] if joined else np.zeros(len(i), np.int32), before)
            docs = int(count[-1])
            begin, last = head[-1], block[-1]
            keep = np.arange(at[begin], at[begin] + size[begin])
            if last != begin:
                keep = np.append(keep, np.arange(at[last], len(key)))
            done = tuple(c[keep] for c in cols)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, names))
            ends = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1]))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from match(tuple(x[:cut] for x in now))
            rest = tuple(x[cut:] for x in now)
        if len(rest[0]):
            yield from match(rest)

    return work


def _rows_of(doc, src, pos, src_pos, key=None, span=None, before=None) -> pa.RecordBatch:
    given = {"doc_id": doc, "src": src, "pos": pos, "src_pos": src_pos, "key": key, "span": span, "before": before}
    return pa.RecordBatch.from_arrays([pa.nulls(len(doc), f.type) if given[f.name] is None else pa.array(given[f.name], f.type) for f in _SHARED], schema=_SHARED)


def _joins(reach: int, beyond: int):
    """Each key with the next one of its document that begins where it ends or later, at most ``reach`` words from its start; from rows by (doc, pos).

    And, if ``beyond`` is not 0, with the next one that begins so many words
    later still, beyond what one changed word takes away.  Two keys that were
    matched with the same documents are not joined: the longer one would be
    matched with them again.  Rows whose partner may be in the next batch are
    kept for it.
    """
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("span", pa.int32()), *((c, pa.int64()) for c in _JOINED[1:])])
    names = ("doc_id", "pos", "key", "span", "src", "before")

    def work(batches: Iterator[pa.RecordBatch]):
        kept: tuple[np.ndarray, ...] | None = None
        waits = np.zeros(0, np.int8)  # for which partners the kept rows wait
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(batch.column(c).to_numpy() if kept is None else np.append(kept[n], batch.column(c).to_numpy()) for n, c in enumerate(names))
            doc, pos, key, span, src, before = cols
            place = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 32 | pos
            step = np.maximum(span, 1)
            next_ = [np.searchsorted(place, place + step)]
            if beyond:
                next_.append(np.searchsorted(place, place + step + beyond))
            # rows of the batch before were joined then, unless their partner was not there yet
            open_ = np.append(waits, np.full(batch.num_rows, 3, np.int8))
            near = (doc == doc[-1]) & (pos[-1] - pos <= reach + beyond)
            wait = np.zeros(len(doc), np.int8)
            for n, j in enumerate(next_):
                i = np.flatnonzero((j < len(doc)) & ((open_ >> n & 1) > 0))
                i = i[(doc[j[i]] == doc[i]) & (pos[j[i]] - pos[i] <= reach + n * beyond)]
                i = i[(src[j[i]] != src[i]) | (before[j[i]] != before[i])]
                wait |= ((j == len(doc)) & near & ((open_ >> n & 1) > 0)).astype(np.int8) << n
                if len(i):
                    k = j[i]
                    far = pos[k] - pos[i]
                    mixed = mix(mix(key[i].view(np.uint64)) * np.uint64(3 + n) + key[k].view(np.uint64) + far.astype(np.uint64)).view(np.int64)
                    yield table_of(schema, key=mixed, doc_id=doc[i], pos=pos[i], span=(far + span[k]).astype(np.int32), a=src[i], b=before[i], c=src[k], d=before[k])
            kept, waits = tuple(c[wait > 0] for c in cols), wait[wait > 0]

    return work


def shared_seeds(docs: DataFrame, k: int, window: int, words: int) -> tuple[DataFrame, list[DataFrame]]:
    """``doc_id``, ``src``, ``pos``, ``src_pos``: places of a document with equal seeds in documents before it; and the tables they are read from.

    Each seed is matched with its first document and with that before.  Seeds of
    three documents or more are joined with their neighbours to keys twice as
    long, and again, up to keys of about ``words`` words, each of which is matched
    in the same way; so documents are found that share a stretch of words though
    each piece of it also stands elsewhere.
    """
    rows = seeds(docs, k, window).withColumnRenamed("seed", "key").repartition("key").sortWithinPartitions("key", "doc_id", "pos")
    level = save(rows.mapInArrow(tidy(_shared(False)), _SHARED_SQL), "shared")
    out, reach = [level], 2 * window
    while reach <= 2 * words:
        often = level.where("key is not null")
        if often.isEmpty():
            break
        pairs = often.select("doc_id", "pos", "key", "span", "src", "before").repartition("doc_id").sortWithinPartitions("doc_id", "pos")
        pairs = pairs.mapInArrow(tidy(_joins(reach, k + window if len(out) == 1 else 0)), "key long, doc_id long, pos int, span int, a long, b long, c long, d long")
        dealt = pairs.repartition("key").sortWithinPartitions("key", "doc_id", "pos")
        level = save(dealt.mapInArrow(tidy(_shared(True)), _SHARED_SQL), "shared")
        out.append(level)
        reach *= 2
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    return found.where("key is null").select("doc_id", "src", "pos", "src_pos"), out


class Fenwick:
    """Prefix maxima of (value, index) over ranks."""

    def __init__(self, n: int):
        self.tree = [(-1e300, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.tree):
            if self.tree[i] < value:
                self.tree[i] = value
            i += i & -i

    def best(self, i: int) -> tuple[float, int]:
        """Largest among ranks below i."""
        out = (-1e300, -1)
        while i > 0:
            if self.tree[i] > out:
                out = self.tree[i]
            i -= i & -i
        return out


def chains(pos: np.ndarray, src: np.ndarray, k: int) -> list[list[int]]:
    """Chains of seed matches that ascend on both sides, the best first, no match in two.

    A match is worth k, each word from one match to the next costs GAP on
    either side.  That cost is a sum of one part for each end, so the best
    predecessor is a prefix maximum, which the Fenwick tree keeps by rank on the
    source side.
    """
    order = np.lexsort((-src, pos))
    rank = np.searchsorted(np.unique(src), src).tolist()
    tree = Fenwick(int(max(rank)) + 1)
    p, s = pos.tolist(), src.tolist()
    score, back = [0.0] * len(p), [-1] * len(p)
    for i in order.tolist():
        value, j = tree.best(rank[i])
        gain = value - GAP * (p[i] + s[i])
        score[i], back[i] = (k + gain, j) if j >= 0 and gain > 0 else (float(k), -1)
        tree.put(rank[i], (score[i] + GAP * (p[i] + s[i]), i))
    used = [False] * len(p)
    out = []
    for i in sorted(range(len(p)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def gap(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Columns (equal, words of x, words of y) of an alignment of two short runs of words with most equal and then fewest columns, within a band."""
    n, m = len(x), len(y)
    if n == m and (n < 2 or (x == y).mean() >= 0.5):
        return [(int(e), 1, 1) for e in (x == y).tolist()]
    wide = abs(n - m) + 8
    x, y = x.tolist(), y.tolist()
    one, never = n + m + 1, -(1 << 60)  # an equal column is worth more than all that may be saved
    row, ways = [never] * (m + 1), []
    for i in range(n + 1):
        above, row, way = row, [never] * (m + 1), bytearray(m + 1)
        for j in range(max(0, i - wide), min(m, i + wide) + 1):
            if not i and not j:
                row[0] = 0
                continue
            value, step = never, 0
            if i and j and above[j - 1] > never:
                value, step = above[j - 1] - 1 + (one if x[i - 1] == y[j - 1] else 0), 0
            if i and above[j] - 1 > value:
                value, step = above[j] - 1, 1
            if j and row[j - 1] - 1 > value:
                value, step = row[j - 1] - 1, 2
            row[j], way[j] = value, step
        ways.append(way)
    out, i, j = [], n, m
    while i or j:
        step = (0, 1, 0) if ways[i][j] == 1 else (0, 0, 1) if ways[i][j] else (int(x[i - 1] == y[j - 1]), 1, 1)
        out.append(step)
        i, j = i - step[1], j - step[2]
    return out[::-1]


def align(x: np.ndarray, y: np.ndarray, p: list[int], s: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Alignment of two stretches of words along a chain of seeds: whether columns are equal, and the words of each side up to every column.

    Gaps between seeds are aligned in a band, what lies before and after the
    chain word by word.  A seed that overlaps the one before on one side by more
    than on the other gives only the words that both sides have left.
    """
    before = min(p[0], s[0])
    parts = [np.stack([x[p[0] - before : p[0]] == y[s[0] - before : s[0]], np.ones(before), np.ones(before)], 1)]
    i, j = p[0], s[0]
    for a, b in zip(p, s):
        over = max(i - a, j - b, 0)
        n = k - over  # words of the seed that neither side has used
        if n <= 0:
            continue
        a, b = a + over, b + over
        if a > i or b > j:
            parts.append(np.array(gap(x[i:a], y[j:b])).reshape(-1, 3))
        parts.append(np.ones((n, 3)))
        i, j = a + n, b + n
    after = min(len(x) - i, len(y) - j)
    parts.append(np.stack([x[i : i + after] == y[j : j + after], np.ones(after), np.ones(after)], 1))
    cols = np.concatenate(parts).astype(np.int64)
    up = [np.append(start, start + np.cumsum(cols[:, c])) for c, start in ((1, p[0] - before), (2, s[0] - before))]
    return cols[:, 0].astype(bool), up[0], up[1]


def straight(x: np.ndarray, y: np.ndarray, p: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """What :func:`align` gives for seeds on one diagonal, word by word; None where it may shift the words of a gap."""
    shift = int(p[0] - s[0])
    if (p - s != shift).any():
        return None
    before = min(int(p[0]), int(s[0]))
    lo, hi = int(p[0]) - before, min(len(x), len(y) + shift)
    same = x[lo:hi] == y[lo - shift : hi - shift]
    if not same.all():
        # gaps of which less than half is equal are not straight
        wrong = np.append(0, np.cumsum(~same))
        a, b = p[:-1] + k - lo, p[1:] - lo
        n = b - a
        if ((n > 1) & (2 * (wrong[np.maximum(a, b)] - wrong[a]) > n)).any():
            return None
    places = np.arange(len(same) + 1)
    return same, places + lo, places + lo - shift


def segments(same: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, similar: float) -> Iterator[tuple[int, int]]:
    """Stretches of columns (first, end) with at least ``least`` words on either side of which ``similar`` are equal: the best, or else the longest, and those beside it."""
    if same.all():
        if min(a[-1] - a[0], b[-1] - b[0]) >= least:
            yield 0, len(same)
        return
    total = np.append(0.0, np.cumsum(np.where(same, 1 - similar, -similar)))
    todo = [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if min(a[hi] - a[lo], b[hi] - b[lo]) < least:
            continue
        t = total[lo : hi + 1]
        low = np.minimum.accumulate(t)
        end = int(np.argmax(t - low))
        begin = int(np.flatnonzero(t[: end + 1] == low[end])[-1])
        if min(a[lo + end] - a[lo + begin], b[lo + end] - b[lo + begin]) < least:
            high = np.maximum.accumulate(t[::-1])  # by its end from the right
            ends = len(t) - 1 - np.searchsorted(high, t - 1e-9)
            begin = int(np.argmax(ends - np.arange(len(t))))
            end = int(ends[begin])
            some = np.flatnonzero(same[lo + begin : lo + end])
            if len(some):
                begin, end = begin + int(some[0]), begin + int(some[-1]) + 1
            if min(a[lo + end] - a[lo + begin], b[lo + end] - b[lo + begin]) < least:
                continue
        yield lo + begin, lo + end
        todo += [(lo, lo + begin), (lo + end, hi)]


def joined(pos: np.ndarray, src: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of equal words (place, place in the source, words), those that overlap or touch made one; fewest that hold the same words."""
    whole: list[tuple[int, int, int]] = []
    order = np.lexsort((pos, pos - src))
    for p, s, m in zip(pos[order].tolist(), src[order].tolist(), n[order].tolist()):
        if whole and whole[-1][0] - whole[-1][1] == p - s and p <= whole[-1][0] + whole[-1][2]:
            p, s, m = whole[-1][0], whole[-1][1], max(whole[-1][2], p + m - whole[-1][0])
            whole.pop()
        whole.append((p, s, m))
    whole.sort()
    out: list[tuple[int, int, int]] = []
    for p, s, m in whole:
        if out and p + m <= out[-1][0] + out[-1][2]:
            continue
        # the last one is needless if this one goes on from the one before, or begins where it does
        if out and (p == out[-1][0] or len(out) > 1 and p <= out[-2][0] + out[-2][2]):
            out.pop()
        out.append((p, s, m))
    return out


_FOUND = pa.schema([("doc_id", pa.int64()), ("src", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("src_start", pa.int32()), ("src_stop", pa.int32()), ("equal", pa.int32()), ("length", pa.int32())])
_CHAINS = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("src", pa.int64()), ("src_lo", pa.int32()), ("src_hi", pa.int32()), ("p", pa.list_(pa.int32())), ("s", pa.list_(pa.int32()))])
#: Fewest seeds of a chain whose words are looked at.
FEWEST = 2


def _chain_worker(k: int, beside: int):
    """Chains of two seeds and more with the stretches of words that they and ``beside`` words on either side take."""

    def work(batches: Iterator[pa.RecordBatch]):
        for c, bounds in runs(batches, ["doc_id", "src"]):
            rows = int(bounds[-1])
            doc, of, pos, src = (c[n][:rows] for n in ("doc_id", "src", "pos", "src_pos"))
            begins = np.zeros(rows, bool)
            begins[bounds[:-1]] = True
            once = begins.copy()  # longer keys may repeat a match
            once[1:] |= (pos[1:] != pos[:-1]) | (src[1:] != src[:-1])
            doc, of, pos, src, begins = (x[once] for x in (doc, of, pos, src, begins))
            bounds = np.append(np.flatnonzero(begins), len(pos))
            # one diagonal: the matches are a chain as they are, unless gaps cut it
            step, shift = np.append(0, np.diff(pos)), np.append(0, np.diff(pos - src))
            bent = np.append(0, np.cumsum(~begins & ((shift != 0) | (step <= 0))))
            bent = bent[bounds[1:]] > bent[bounds[:-1]]
            lo = np.flatnonzero(begins | (step * 2 * GAP >= k))
            hi = np.append(lo[1:], len(pos))
            some = (hi - lo >= FEWEST) & ~np.repeat(bent, np.diff(bounds))[lo]
            lo, hi = lo[some], hi[some]
            if len(lo):
                size = hi - lo
                ends = np.append(0, np.cumsum(size))
                pick = np.repeat(lo - ends[:-1], size) + np.arange(ends[-1])
                ends = pa.array(ends.astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x[pick].astype(np.int32))) for x in (pos, src))
                stretch = lambda x: (np.maximum(x[lo] - beside, 0), x[hi - 1] + k + beside)
                yield table_of(_CHAINS, **dict(zip(_CHAINS.names, (doc[lo], *stretch(pos), of[lo], *stretch(src), *lists))))
            out = []
            for g in np.flatnonzero(bent & (np.diff(bounds) >= FEWEST)).tolist():
                lo, hi = bounds[g], bounds[g + 1]
                for chain in chains(pos[lo:hi], src[lo:hi], k):
                    if len(chain) >= FEWEST:
                        p, s = pos[lo:hi][chain].tolist(), src[lo:hi][chain].tolist()
                        out.append((doc[lo], max(0, p[0] - beside), p[-1] + k + beside, of[lo], max(0, s[0] - beside), s[-1] + k + beside, p, s))
            if out:
                yield table_of(_CHAINS, **dict(zip(_CHAINS.names, map(list, zip(*out)))))

    return work


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists, one after another, and where each begins and the last ends."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten().to_numpy(), ends - ends[0]


def straight_all(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], p: tuple[np.ndarray, np.ndarray], s: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, ...]:
    """What :func:`straight` gives for many rows (values and bounds of each side), all at once.

    For each row whether it is to be looked at (its seeds are words of both
    sides) and whether it is straight; its first place and the number of its
    columns; then the columns of all rows and the number of equal ones up to each.
    """
    (xs, xo), (ys, yo), (ps, po), (ss, _) = x, y, p, s
    seeds, nx, ny = np.diff(po), np.diff(xo), np.diff(yo)
    row = np.repeat(np.arange(len(seeds)), seeds)
    ok = (ps[po[1:] - 1] + k <= nx) & (ss[po[1:] - 1] + k <= ny)
    inside = ok[row] & (ps < nx[row]) & (ss < ny[row])
    good = np.zeros(len(ps), bool)
    good[inside] = xs[xo[row[inside]] + ps[inside]] == ys[yo[row[inside]] + ss[inside]]
    ok &= np.add.reduceat(~good, po[:-1]) == 0
    shift = (ps - ss)[po[:-1]]
    line = ok & (np.add.reduceat(ps - ss != shift[row], po[:-1]) == 0)
    first = np.maximum(shift, 0)  # of x; the columns before the chain go as far as the shorter side
    n = np.where(line, np.minimum(nx, ny + shift) - first, 0)
    at = np.append(0, np.cumsum(n))
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(at[-1]) - at[of] + first[of]
    same = xs[xo[of] + place] == ys[yo[of] + place - shift[of]]
    equal = np.append(0, np.cumsum(same))
    # gaps of which less than half is equal are not straight
    i = np.flatnonzero((row[1:] == row[:-1]) & line[row[1:]])
    a, b = ps[i] + k - first[row[i]], ps[i + 1] - first[row[i]]
    m, base = b - a, at[row[i]]
    wrong = np.maximum(m, 0) - (equal[base + np.maximum(a, b)] - equal[base + a])
    line[row[i[(m > 1) & (2 * wrong > m)]]] = False
    return ok, line, first, n, at, same, equal


def _align_worker(k: int, least: int, similar: float):
    def work(batches: Iterator[pa.RecordBatch]):
        few = np.ceil(similar * least - 1e-6)  # equal words that a passage has
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema) if f.name in ("doc_id", "lo", "src", "src_lo")}
            (x, xo), (y, yo), (p, po), (s, so) = (_flat(batch.column(f)) for f in ("x", "y", "p", "s"))
            p, s = p - np.repeat(c["lo"], np.diff(po)), s - np.repeat(c["src_lo"], np.diff(so))
            ok, line, first, n, at, same, equal = straight_all((x, xo), (y, yo), (p, po), (s, so), k)
            shift = (p - s)[po[:-1]]
            count = equal[at[1:]] - equal[at[:-1]]
            whole = line & (count == n)
            out = []
            i = np.flatnonzero(whole & (n >= least))
            if len(i):
                start, to = c["lo"][i] + first[i], c["src_lo"][i] + first[i] - shift[i]
                yield table_of(_FOUND, doc_id=c["doc_id"][i], src=c["src"][i], start=start, stop=start + n[i], src_start=to, src_stop=to + n[i], equal=n[i], length=n[i])
            # one row after another: those with changed words that may hold a passage, and those that are to be aligned
            for r in np.flatnonzero(ok & ~whole & (~line | (count >= few))).tolist():
                if line[r]:
                    one = same[at[r] : at[r + 1]]
                    a = np.arange(len(one) + 1) + first[r]
                    b = a - shift[r]
                else:
                    u, v = x[xo[r] : xo[r + 1]], y[yo[r] : yo[r + 1]]
                    if np.isin(u, v).sum() < few:
                        continue
                    one, a, b = align(u, v, p[po[r] : po[r + 1]].tolist(), s[po[r] : po[r + 1]].tolist(), k)
                lo, src_lo = c["lo"][r], c["src_lo"][r]
                for i, j in segments(one, a, b, least, similar):
                    out.append((c["doc_id"][r], c["src"][r], lo + a[i], lo + a[j], src_lo + b[i], src_lo + b[j], int(one[i:j].sum()), j - i))
            if out:
                yield table_of(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*out)))))

    return work


def _words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``id``, ``lo``, ``hi``, ``w`` (array of hashes) of the wanted stretches of words; only texts with some are shuffled."""
    wanted = save(wanted.distinct().groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("at")).select("id", "at.lo", "at.hi"), "wanted")
    marked = mark_by(docs, "doc_id", filter_of(wanted, "id"), "_hit").where("_hit").drop("_hit")
    schema = pa.schema([("id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("w", pa.list_(pa.int32()))])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch, t in tokens_of(batches, "text"):
            h = (t.hashes() >> np.uint64(32)).astype(np.uint32).view(np.int32)
            ids, los, his = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("id", "lo", "hi"))
            for i in range(batch.num_rows):
                w = h[t.first[i] : t.first[i + 1]]
                lo, hi = np.minimum(los[i], len(w)), np.minimum(his[i], len(w))
                for at in range(0, len(lo), 1024):
                    a, b = lo[at : at + 1024], hi[at : at + 1024]
                    ends = np.append(0, np.cumsum(b - a))
                    pick = np.repeat(a - ends[:-1], b - a) + np.arange(ends[-1])
                    yield table_of(schema, id=np.full(len(a), ids[i]), lo=los[i][at : at + 1024], hi=his[i][at : at + 1024], w=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w[pick])))

    return save(marked.join(wanted, marked.doc_id == wanted.id).drop("doc_id").mapInArrow(tidy(work), "id long, lo int, hi int, w array<int>"), "words")


def _whole_worker(batches: Iterator[pa.RecordBatch]):
    """Aligned passages (``length`` > 0) and, of the runs of equal words, those that no aligned one has whole."""
    for c, bounds in runs(batches, ["doc_id", "src"]):
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            length = c["length"][lo:hi]
            have = sorted({tuple(int(c[f][lo + i]) for f in _FOUND.names) for i in np.flatnonzero(length).tolist()}, key=lambda x: (x[2] - x[3], x))
            kept: list[tuple] = []
            for x in have:  # another chain may have led to the same passage
                if not any(y[2] <= x[2] and x[3] <= y[3] and y[4] <= x[4] and x[5] <= y[5] for y in kept):
                    kept.append(x)
            at = np.flatnonzero(length == 0) + lo
            if len(at):
                for p, s, n in joined(c["start"][at], c["src_start"][at], c["stop"][at] - c["start"][at]):
                    if not any(y[2] <= p and p + n <= y[3] for y in kept):
                        kept.append((int(c["doc_id"][lo]), int(c["src"][lo]), p, p + n, s, s + n, n, n))
            out += kept
        if out:
            yield table_of(_FOUND, **dict(zip(_FOUND.names, map(list, zip(*out)))))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 50, similar: float = 0.8, k: int = 5, window: int = 5) -> DataFrame:
    """``doc_id``, ``src``, ``start``, ``stop``, ``src_start``, ``src_stop``, ``equal``, ``length``.

    One row for each passage (words ``start`` to ``stop``) of a document that
    matches words ``src_start`` to ``src_stop`` of ``src``, a document of smaller
    id, with ``equal`` of ``length`` aligned words, at least ``similar``, and at
    least ``words`` words on either side.  ``words`` equal words in a row are
    always matched with the first document that has them all
    (:func:`exact_runs`).  Passages with changed words are looked for along
    chains of two seeds and more (:func:`shared_seeds`), and the words there and
    up to ``words`` beside are aligned.

    Words are lower-cased (A-Z) and end at white space.  Null and short texts
    and rows with a null id have no passages; rows that repeat an id are one
    document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    shared, tables = shared_seeds(docs, k, window, words)
    dealt = shared.repartition("doc_id", "src").sortWithinPartitions("doc_id", "src", "pos", "src_pos")
    found = save(dealt.mapInArrow(tidy(_chain_worker(k, words)), "doc_id long, lo int, hi int, src long, src_lo int, src_hi int, p array<int>, s array<int>"), "chains")
    for t in tables:
        drop(t)
    x = found.select(F.col("doc_id").alias("id"), "lo", "hi")
    y = found.select(F.col("src").alias("id"), F.col("src_lo").alias("lo"), F.col("src_hi").alias("hi"))
    w = _words(docs, x.unionByName(y))
    both = found.join(w.select(F.col("id").alias("doc_id"), "lo", "hi", F.col("w").alias("x")), ["doc_id", "lo", "hi"])
    both = both.join(w.select(F.col("id").alias("src"), F.col("lo").alias("src_lo"), F.col("hi").alias("src_hi"), F.col("w").alias("y")), ["src", "src_lo", "src_hi"])
    out = "doc_id long, src long, start int, stop int, src_start int, src_stop int, equal int, length int"
    aligned = save(both.mapInArrow(tidy(_align_worker(k, words, similar)), out), "aligned")
    drop(found)
    drop(w)
    exact = exact_runs(docs, words).selectExpr("doc_id", "src", "pos as start", "pos + n as stop", "src_pos as src_start", "src_pos + n as src_stop", "n as equal", "0 as length")
    dealt = aligned.unionByName(exact).repartition("doc_id", "src").sortWithinPartitions("doc_id", "src", "start", "stop")
    return save(dealt.mapInArrow(tidy(_whole_worker), out), "passages")
