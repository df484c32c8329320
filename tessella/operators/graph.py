"""Closures over edges by rounds of joins, and tree queries over nested intervals."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType


def _saved(df: DataFrame) -> DataFrame:
    """Write and read back: each round starts from rows that survive lost executors."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _drop(df: DataFrame) -> None:
    """Remove a table of :func:`_saved` that nothing reads any more."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def closure(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """``src``, ``node``, ``depth``: what each seed reaches over ``sub`` -> ``sup``, by the shortest way.

    Cycles end where a node was visited.  ``seeds`` has ``src``, and ``node`` if a
    seed starts elsewhere than in a node of its own name.  With ``most``
    only what is at most so many steps away.  All that was seen stays in one
    table, which each round reads once; the round before's is removed.
    """
    start = F.col("node" if "node" in seeds.columns else "src").alias("node")
    seen = _saved(seeds.select("src", start, F.lit(0).alias("depth")).distinct())
    depth = 0
    while most is None or depth < most:
        front = seen.where(F.col("depth") == depth)
        step = front.join(edges, front.node == edges["sub"]).select("src", F.col("sup").alias("node"), F.lit(depth + 1).alias("depth"))
        # one shuffle by pair: of what was seen and what is reached now, the nearer
        grown = _saved(seen.unionByName(step).groupBy("src", "node").agg(F.min("depth").alias("depth")))
        _drop(seen)
        seen, depth = grown, depth + 1
        if seen.where(F.col("depth") == depth).isEmpty():
            break
    return seen


def closure_of_all(nodes: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``src``, ``node``, ``depth`` as :func:`closure` gives them, of all ``nodes`` (``src``) and of whatever edges lead from.

    Each round doubles how far is seen: what is exactly as far as was looked so
    far goes on by all that is known from there.  So what is written and
    shuffled is a few times the answer, however deep it is.
    """
    seen = _saved(edges.where("sub <> sup").select(F.col("sub").alias("src"), F.col("sup").alias("node"), F.lit(1).alias("depth")).distinct())
    far = 1
    while far < most:
        on = seen.select(F.col("src").alias("via"), F.col("node").alias("to"), F.col("depth").alias("more"))
        step = seen.where(F.col("depth") == far).join(on.hint("merge"), F.col("node") == F.col("via")).where("src <> to")
        grown = _saved(seen.unionByName(step.select("src", F.col("to").alias("node"), (F.col("more") + far).alias("depth"))).groupBy("src", "node").agg(F.min("depth").alias("depth")))
        _drop(seen)
        seen = grown
        if seen.where(F.col("depth") > far).isEmpty():
            break
        far *= 2
    return nodes.select("src", F.col("src").alias("node"), F.lit(0).alias("depth")).distinct().unionByName(seen.where(F.col("depth") <= most))


def is_subtype(asked: DataFrame, closed: DataFrame) -> DataFrame:
    """``src``, ``target``, ``is_subtype`` of asked pairs, by a closure of the sources."""
    hit = closed.select("src", F.col("node").alias("target"), F.lit(True).alias("hit"))
    return asked.join(hit, ["src", "target"], "left").select("src", "target", F.coalesce("hit", F.lit(False)).alias("is_subtype"))


def nearest(closed: DataFrame, most: int) -> DataFrame:
    """Of what each source reaches the first ``most`` nodes, the nearest first."""
    w = Window.partitionBy("src").orderBy("depth", "node")
    return closed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def ancestors(nodes: DataFrame, inner: str | list[str], keep: tuple[str, ...] = ("depth", "pre", "post", "kind", "ref")) -> DataFrame:
    """Nodes of some kinds with ``around``: the nodes they lie in, from the outermost, as structs of the columns to ``keep``.

    Each path's nodes pass in the order of ``pre`` while those that are still
    open are held, also from one batch to the next; so the plan and what a task
    holds depend on how deep a tree is and not on how many nodes a path has.
    """
    inner = [inner] if isinstance(inner, str) else inner
    schema = to_arrow_schema(nodes.schema)
    held = pa.struct([schema.field(c) for c in keep])
    schema = schema.append(pa.field("around", pa.list_(held)))
    ddl = StructType([*nodes.schema, StructField("around", ArrayType(StructType([nodes.schema[c] for c in keep])))])

    def work(batches: Iterator[pa.RecordBatch]):
        path, open_ = None, []  # (row among those at hand, post)
        kept: pa.StructArray | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.StructArray.from_arrays([batch.column(c) for c in keep], fields=list(held))
            base = len(kept) if kept is not None else 0
            at_hand = pa.concat_arrays([kept, rows]) if base else rows
            wanted, offsets, flat = [], [0], []
            for i, (p, post, kind) in enumerate(zip(batch.column("path").to_pylist(), batch.column("post").to_pylist(), batch.column("kind").to_pylist()), base):
                if p != path:
                    path, open_ = p, []
                while open_ and open_[-1][1] <= post:
                    open_.pop()
                if kind in inner:
                    wanted.append(i - base)
                    flat += [k for k, _ in open_]
                    offsets.append(len(flat))
                open_.append((i, post))
            around = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), at_hand.take(pa.array(flat, pa.int64())))
            some = batch.take(pa.array(wanted, pa.int64()))
            if some.num_rows:
                yield pa.RecordBatch.from_arrays([*some.columns, around], schema=schema)
            kept = at_hand.take(pa.array([k for k, _ in open_], pa.int64()))
            open_ = [(k, post) for k, (_, post) in enumerate(open_)]

    ordered = nodes.repartition("path").sortWithinPartitions("path", "pre", F.desc("post"), "depth")
    return ordered.mapInArrow(work, ddl)


def innermost(nodes: DataFrame, inner: str, outer: list[str]) -> DataFrame:
    """Innermost node of the outer kinds around each node of the inner kind."""
    of_kind = F.filter("around", lambda x: x["kind"].isin(outer))
    found = ancestors(nodes, inner).select("path", F.col("pre").alias("d_pre"), F.try_element_at(of_kind, F.lit(-1)).alias("a"))
    return found.where("a is not null").select("path", "d_pre", "a.ref", "a.depth")


def selection_chain(nodes: DataFrame, inner: str) -> DataFrame:
    """Spans around each node from the innermost out, strictly growing."""
    spans = F.transform(F.reverse("around"), lambda x: F.struct((x["post"] - x["pre"]).alias("size"), x["pre"].alias("pre"), x["post"].alias("post")))
    grown = F.filter(F.col("spans"), lambda x, i: (i == 0) | (x["size"] > F.get(F.col("spans"), i - 1)["size"]))
    found = ancestors(nodes, inner).where(F.size("around") > 0).withColumn("spans", spans)
    return found.select("path", F.col("pre").alias("d_pre"), F.array_join(F.transform(grown, lambda x: F.concat_ws("-", x["pre"], x["post"])), ",").alias("chain"))


def nearest_before(uses: DataFrame, decls: DataFrame, keys: list[str]) -> DataFrame:
    """Declaration with the greatest start before each use, of the same keys.

    Uses and declarations stand in one order of their places, in which the last
    declaration before each use is looked up; they are not paired.
    """
    d = decls.select(*keys, "start_byte", F.col("start_byte").alias("decl_start"))
    both = uses.select(*keys, "start_byte", F.lit(None).cast("long").alias("decl_start"), F.lit(True).alias("is_use")).unionByName(d.withColumn("is_use", F.lit(False)))
    before = Window.partitionBy(*keys).orderBy("start_byte").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("decl_start", F.max("decl_start").over(before)).where("is_use and decl_start is not null")
    return found.select(*keys, "start_byte", "decl_start").distinct()
