"""Near-duplicate vectors by int8 tile products with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import components, mix, runs_of_keys, save, shared_ids, spanning, table_of, tidy

#: Distinct vectors of a block; a task holds two blocks.
BLOCK = 8192
#: Rows of a block that are multiplied with the other block at a time.
STRIP = 1024


def embedding_groups(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95, block: int = BLOCK
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if the cosine of their angle, in double precision, is at least
    ``threshold``; ``n_links`` counts the other rows that a row links with, and
    the component is named by its smallest id.  Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null id, link
    with nothing; so do vectors of different lengths.  Every row is returned,
    rows that repeat an id among them: each has the links of its own vector, and
    the id connects them.  An empty table gives no rows; further columns,
    whatever their names, are not looked at.

    Equal vectors are gathered first and count as often as they occur.  The
    distinct ones are dealt into blocks around pivots (:func:`_tiles`); each pair
    of blocks that may hold a link is one task.  A task multiplies int8 vectors and keeps the sums that the bounds on
    the quantization errors leave open for a product in double precision.  It
    returns sums of links and a forest of the links, never the pairs.
    """
    cols = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    fine = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("vec", lambda x: x != 0) & F.col("vec_id").isNotNull()
    cols = cols.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = cols.where("fine").select("vec_id", "vec")
    distinct = good.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    distinct = save(distinct.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    rows = save(good.join(distinct.select("vec", "cls", "rep"), "vec").select("vec_id", "cls", "rep"), "classes")
    found = save(_tiles(distinct, threshold, block), "tiles")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    edges = found.where("root < rep").select(F.col("rep").alias("v"), F.col("root").alias("p"))
    # one id may carry several vectors (repeated rows), which it then connects
    roots = components(edges.unionByName(shared_ids(rows.select(F.col("vec_id").alias("id"), "rep"))))
    known = distinct.select("cls", "rep", "copies").join(links, "cls", "left").join(roots, F.col("rep") == roots.v, "left")
    known = save(known.select("cls", F.coalesce("root", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    linked = rows.join(known, "cls").select("vec_id", "n_links", "component_id")
    alone = cols.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").isNull() | (F.col("vec_id") == F.col("component_id")))


#: Most pivots, whatever the number of vectors.
PIVOTS = 1_024


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _of_length(batch: pa.RecordBatch, vec: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = np.diff(batch.column(vec).offsets.to_numpy())
    for d in np.unique(size).tolist():
        yield d, batch.filter(pa.array(size == d))


def _tiles(distinct: DataFrame, threshold: float, block: int) -> DataFrame:
    """``cls``, ``rep``, ``links``, ``root``: sums of links and forests of each pair of blocks that may hold a link.

    Vectors gather around pivots, a sample of them of bounded size; a pivot's
    vectors are dealt into blocks by a hash.  A vector meets those of another
    pivot only if its angle to it is at most the greatest angle of a vector there
    plus that of the threshold: by the triangle inequality no link is left out.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    few = min(PIVOTS, -(-n // block))
    if few <= 1:
        near = distinct.withColumn("pivot", F.lit(0))
        reach = None
    else:
        h = F.xxhash64("cls", F.lit(1))
        sample = distinct.select("vec", h.alias("h")).orderBy("h").limit(few).collect()
        pivots: dict[int, list[tuple[int, list[float]]]] = {}
        for i, r in enumerate(sample):
            pivots.setdefault(len(r["vec"]), []).append((i, r["vec"]))
        sent = spark.sparkContext.broadcast({d: (np.array([i for i, _ in p]), _unit(np.array([v for _, v in p], np.float64))) for d, p in pivots.items()})

        def assign(batches: Iterator[pa.RecordBatch]):
            for whole in batches:
                for lo in range(0, whole.num_rows, STRIP):
                    for d, batch in _of_length(whole.slice(lo, STRIP), "vec"):
                        ids, p = sent.value.get(d, (np.array([-1]), np.zeros((1, d))))
                        cos = _unit(_matrix(batch.column("vec"), d)) @ p.T
                        best = cos.argmax(axis=1)
                        angle = np.arccos(np.clip(cos[np.arange(len(best)), best], -1, 1))
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[best], pa.int32()), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])

        near = save(distinct.mapInArrow(tidy(assign), "vec array<double>, rep long, copies long, cls long, pivot int, angle double" if dict(distinct.dtypes)["vec"] == "array<double>" else "vec array<float>, rep long, copies long, cls long, pivot int, angle double"), "near")
        reach = {r["pivot"]: r["angle"] for r in near.groupBy("pivot").agg(F.max("angle").alias("angle")).collect()}  # one row for each pivot
    size = near.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("parts"))
    parts = {r["pivot"]: r["parts"] for r in size.collect()}
    spread = spark.sparkContext.broadcast((parts, reach))
    limit = float(np.arccos(threshold))
    vec_type = dict(distinct.dtypes)["vec"]
    schema = f"d int, a long, b long, right boolean, cls long, rep long, copies long, vec {vec_type}"

    def deal(batches: Iterator[pa.RecordBatch]):
        parts, reach = spread.value
        for whole in batches:
            for lo in range(0, whole.num_rows, STRIP):
                for d, batch in _of_length(whole.slice(lo, STRIP), "vec"):
                    own, cls = batch.column("pivot").to_numpy().astype(np.int64), batch.column("cls").to_numpy()
                    part = (mix(cls.astype(np.uint64)) >> np.uint64(32)) % np.array([parts[p] for p in own.tolist()], np.uint64)
                    mine = own << 32 | part.astype(np.int64)
                    if reach is not None and d in sent.value:
                        ids, p = sent.value[d]
                        angle = np.arccos(np.clip(_unit(_matrix(batch.column("vec"), d)) @ p.T, -1, 1))
                        # a little more than computed: angles are rounded
                        meets = angle <= np.array([reach.get(i, -9.0) for i in ids.tolist()]) + limit + 1e-6
                        meets |= own[:, None] == ids[None]
                    else:
                        ids, meets = np.unique(own), own[:, None] == np.unique(own)[None]
                    for k, pivot in enumerate(ids.tolist()):
                        at = np.flatnonzero(meets[:, k])
                        for other in range(parts.get(pivot, 0) if len(at) else 0):
                            theirs = pivot << 32 | other
                            a, b = np.minimum(mine[at], theirs), np.maximum(mine[at], theirs)
                            some = batch.take(pa.array(at))
                            cols = [pa.array(np.full(len(at), d, np.int32)), pa.array(a), pa.array(b), pa.array(mine[at] > theirs), *(some.column(c) for c in ("cls", "rep", "copies", "vec"))]
                            yield pa.RecordBatch.from_arrays(cols, names=["d", "a", "b", "right", "cls", "rep", "copies", "vec"])

    keys = ["d", "a", "b"]
    dealt = near.mapInArrow(tidy(deal), schema).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(_tile_worker(threshold)), "cls long, rep long, links long, root long")


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors of unit rows, their scales, the norms of their errors and of what they stand for."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    # a little more than computed: the norms are rounded too
    return q, scale, np.linalg.norm(x - back, axis=1) * (1 + 1e-9) + 1e-12, np.linalg.norm(back, axis=1) * (1 + 1e-9)


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows whose cosine is at least ``threshold``, strip by strip; below the diagonal only if ``same``.

    With x = x' + e and y = y' + f, where x' and y' are the int8 vectors times
    their scales, xy differs from x'y' by ey' + xf, which is at most
    |e||y'| + |f|.
    """
    peak = np.abs(a).max(axis=1, keepdims=True), np.abs(b).max(axis=1, keepdims=True)
    ua, ub = a / peak[0], b / peak[1]
    ua /= np.linalg.norm(ua, axis=1, keepdims=True)
    ub /= np.linalg.norm(ub, axis=1, keepdims=True)
    qa, sa, ea, _ = quantize(ua)
    qb, sb, eb, hb = quantize(ub)
    # products of int8 vectors are whole numbers; these types hold them exactly
    kind = np.float32 if 127 * 127 * a.shape[1] < 1 << 24 else np.float64
    fb = np.ascontiguousarray(qb.astype(kind).T)
    for lo in range(0, len(a), STRIP):
        hi = min(lo + STRIP, len(a))
        width = hi if same else len(b)
        sums = qa[lo:hi].astype(kind) @ fb[:, :width]
        least = (threshold - ea[lo:hi].max() * hb.max() - eb.max()) / (sa[lo:hi].max() * sb.max())
        x, y = np.nonzero(sums >= (least - 1 if least > 0 else -np.inf))
        if same:
            x, y = x[y < x + lo], y[y < x + lo]
        for s in range(0, len(x), 1 << 18):
            i, j = x[s : s + (1 << 18)], y[s : s + (1 << 18)]
            near = sums[i, j].astype(np.float64) * sa[i + lo] * sb[j]
            error = ea[i + lo] * hb[j] + eb[j] + 1e-9
            sure = near - error >= threshold
            for at in np.array_split(np.flatnonzero((near + error >= threshold) & ~sure), 1 + len(i) // 4096):
                sure[at] = np.einsum("ij,ij->i", ua[i[at] + lo], ub[j[at]]) >= threshold
            yield i[sure] + lo, j[sure]


def _tile_worker(threshold: float):
    schema = pa.schema([("cls", pa.int64()), ("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]):
        for part in runs_of_keys(batches, ["d", "a", "b"]):
            d = part.column("d")[0].as_py()
            order = np.argsort(part.column("rep").to_numpy(), kind="stable")
            x = _matrix(part.column("vec").combine_chunks(), d)[order]
            cls, rep, copies, right = (part.column(c).to_numpy()[order] for c in ("cls", "rep", "copies", "right"))
            same = part.column("a")[0].as_py() == part.column("b")[0].as_py()
            left_at = np.arange(len(rep)) if same else np.flatnonzero(~right)
            right_at = left_at if same else np.flatnonzero(right)
            if not len(left_at) or not len(right_at):
                continue
            links = np.zeros(len(rep), np.int64)
            root = np.arange(len(rep))
            for i, j in close_pairs(x[left_at], x[right_at], threshold, same):
                i, j = left_at[i], right_at[j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                new = root[i] != root[j]
                if new.any():
                    root = spanning((root[i[new]], root[j[new]]), len(rep))[root]
            some = np.flatnonzero(links)
            if len(some):
                yield table_of(schema, cls=cls[some], rep=rep[some], links=links[some], root=rep[root[some]])

    return work
