"""Windows of several features at once: same numbers as over unpivoted rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import wide as wide_mod
from tidewatch.operators.vectors import feature_vectors
from tidewatch.operators.wide import wide_windows
from tidewatch.operators.windows import rolling_stats, stat_fields
from tidewatch.sources.events import unpivot_features


def _events(spark, n=700, seed=3):
    """Two features with gaps and NaN, an empty one, scopes of uneven length (one null)."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = None if rng.random() < 0.3 else float("nan") if rng.random() < 0.05 else float(np.round(rng.normal(), 6))
        y = None if rng.random() < 0.9 else float(np.round(rng.normal() * 100, 6))
        k = [None, "a", "b", "b", "c"][int(rng.integers(0, 5))] if i < 300 else "c"
        rows.append((i, k, x, y, None, f"note{i}"))
    return spark.createDataFrame(rows, "i long, k string, x double, y double, w double, note string").repartition(5)


def _rows(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    names = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("scope", [[], ["k"]])
@pytest.mark.parametrize("window,parts,block", [(1, 3, 16), (7, 4, 16), (50, 7, 32), (200, 3, 1 << 16)])
def test_wide_equals_long(spark, scope, window, parts, block):
    df = _events(spark)
    keep = [*scope, "i", "note", "feature", "value"]
    features = ["x", "y", "w"]
    kw = {"order_cols": ["i"], "key_cols": [*scope, "feature"], "window": window, "passthrough": keep, "num_partitions": parts}
    long = rolling_stats(unpivot_features(df, ["i", "k", "note"], features), **kw)
    wide = rolling_stats(df, **kw, features=features, block_size=block)
    assert wide.columns == long.columns and wide.schema["win_count"].dataType == long.schema["win_count"].dataType
    assert _rows(wide) == _rows(long)


@pytest.mark.parametrize("scope", [[], ["k"]])
def test_vectors_where_the_events_lie(spark, scope, monkeypatch):
    """The same vectors as through long rows, a pivot and a carry-forward, and
    the only tables are the sorted events and the vectors."""
    df = _events(spark)
    features = ["x", "y"]
    stats = rolling_stats(unpivot_features(df, ["i", "k"], features), ["i"], [*scope, "feature"], window=9,
                          passthrough=["i", *scope, "feature", "value"])
    want = feature_vectors(df, stats, [], ["i"], features, scope)
    labels, write = [], wide_mod.materialize
    monkeypatch.setattr(wide_mod, "materialize", lambda d, label="table", **kw: (labels.append(label), write(d, label, **kw))[1])
    own = wide_windows(df, ["i"], features, scope, window=9, num_partitions=4, block=16)
    got = feature_vectors(df, own, [], ["i"], features, scope, keep_place=True)
    assert labels == ["wide"] and not [c for c in own.table.columns if c.startswith("win_") or c == "zscore"]
    own.drop()
    assert _rows(got.drop("_pid", "_loc")) == _rows(want)
    order = [r.i for r in got.orderBy("_pid", "_loc").collect()]
    assert order == [r.i for r in df.orderBy(*scope, "i").collect()]


@pytest.mark.parametrize("scope", [[], ["k"]])
def test_events_that_come_twice_give_one_vector(spark, scope):
    """Also where a block's border lies between the two."""
    df = _events(spark, n=150)
    df = df.unionByName(df.filter("i % 3 = 0").withColumn("x", F.col("i") * 0.5)).unionByName(df.filter("i = 15"))
    features = ["x", "y"]
    for block in (16, 5):
        own = wide_windows(df.orderBy("i", "x"), ["i"], features, scope, window=9, num_partitions=3, block=block)
        assert not own.distinct
        stats = own.statistics(stat_fields(["zscore"]), ["i", *scope, "feature", "value"])
        want = feature_vectors(df, stats, [], ["i"], features, scope)
        got = feature_vectors(df, own, [], ["i"], features, scope, keep_place=True)
        assert got.count() == 150 and _rows(got.drop("_pid", "_loc")) == _rows(want)


def test_events_move_before_they_are_unpivoted(spark):
    """One exchange of whole events; the frame form needs no second one."""
    df = _events(spark)
    kw = {"order_cols": ["i"], "key_cols": ["k", "feature"], "window": 5, "passthrough": ["i", "k", "feature", "value"], "strategy": "frame"}
    long = rolling_stats(unpivot_features(df, ["i", "k"], ["x", "y"]), **kw)
    near = rolling_stats(df.filter("i >= 0"), **kw, features=["x", "y"])
    assert _rows(near) == _rows(long)
    near = rolling_stats(spark.range(50).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y")),
                         **kw, features=["x", "y"])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange "), plan


def test_a_lean_table_leaves_no_shuffle_files(spark):
    import os

    from tidewatch.session import materialize

    def left():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return sum(f.startswith("shuffle_") and f.endswith(".data") for r in root for _, _, fs in os.walk(r) for f in fs)

    df = spark.range(3000).repartitionByRange(7, F.col("id") % 100)
    was = left()
    table = materialize(df, "lean", lean=True)
    assert left() <= was and table.count() == 3000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
