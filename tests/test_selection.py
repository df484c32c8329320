"""Exact percentiles by selection."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import facts, selection


def test_many_values_of_one_group(spark):
    """Ten million different values: each task counts parts of a range, none holds the values."""
    n = 10_000_000
    # a permutation of 0 to n - 1, squared to be dense at one end
    df = spark.range(n).select(F.lit("hot").alias("g"), F.pow((F.col("id") * 7_368_787) % n, F.lit(2)).alias("x"))
    got = selection.percentiles(df, ["g"], "x", {"p50": 0.5, "p95": 0.95, "least": 0.0}).first()
    assert (got.p50, got.p95, got.least) == (float(n // 2 - 1) ** 2, float(math.ceil(n * 0.95) - 1) ** 2, 0.0)


def test_against_sorting(spark):
    rnd = random.Random(4)
    rows = []
    for g in range(40):
        values = rnd.choice([[0.0], [1.5, 1.5], [rnd.gauss(0, 10) for _ in range(300)], [float(rnd.randint(-3, 3)) for _ in range(200)], [math.exp(rnd.uniform(-300, 300)) for _ in range(100)], [None], [None, 2.0], [-math.inf, 1.0, math.inf]])
        rows += [(None if g == 7 else g, v, "x") for v in values]
    df = spark.createDataFrame(rows, "g int, x double, n string").repartition(6)
    groups = {}
    for g, v, _ in rows:
        if v is not None and g is not None:
            groups.setdefault(g, []).append(v)
    want = {g: tuple(sorted(v)[max(1, math.ceil(len(v) * p)) - 1] for p in (0.5, 0.95)) for g, v in groups.items()}
    got = {r.g: (r.a, r.b) for r in selection.percentiles(df.where("g is not null"), ["g"], "x", {"a": 0.5, "b": 0.95}).collect()}
    assert got == want
    middle = {r.g: r.m for r in selection.medians(df.where("g is not null"), ["g"], "x", "m").collect()}
    assert set(middle) == set(groups)
    assert all(np.isclose(middle[g], np.median(v)) or math.isinf(middle[g]) for g, v in groups.items())


def test_statistics_without_values(spark):
    runs = spark.createDataFrame([("a", None, True, False, False), (None, 3.0, False, False, False)], "scenario string, wall_ms double, executed boolean, superseded boolean, cold boolean")
    got = {r.scenario: tuple(r)[1:] for r in facts.scenario_stats(runs).collect()}
    assert got == {"a": (1, 0, 0.0, 0.0, None, None), None: (1, 1, 0.0, 0.0, 3.0, 3.0)}
    assert tuple(facts.telemetry_summary(runs.limit(0)).first()) == (0, 0, 0, 0, 0, 0.0, 0.0)
