"""Isolation forest: retrain schedule vs a step-by-step simulation, kernel
properties (determinism, planted outliers rank first, flag rate)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.iforest import build_forest, offset_for, score_samples
from tidewatch.operators.forest import (fit_models, score_vectors, training_slices, vector_sequence, with_epochs)
from tidewatch.params import ForestParams


def _simulate(n_total, interval, buffer, min_train=50):
    """The live detector's update-then-predict loop: model id per vector and training sets."""
    buf, since, model, models, trained_on = [], 0, 0, [], {}
    for n in range(1, n_total + 1):
        buf.append(n)
        buf = buf[-buffer:]
        since += 1
        if since >= interval and len(buf) >= min_train:
            model += 1
            since = 0
            trained_on[model] = (buf[0], buf[-1], len(buf))
        models.append(model)
    return models, trained_on


@pytest.mark.parametrize("interval,buffer", [(10, 7), (10, 50), (40, 100), (5, 60), (60, 40), (100, 49)])
def test_epochs_and_slices_match_simulation(spark, interval, buffer):
    n_total = 400
    p = ForestParams(retrain_interval=interval, buffer_size=buffer)
    rows = [(i, [float(i), 0.0]) for i in range(1, n_total + 1)]
    df = spark.createDataFrame(rows, "k long, vector array<double>")
    ep = with_epochs(vector_sequence(df, ["k"]), p)
    got = [r.model for r in ep.orderBy("n").collect()]
    want, trained = _simulate(n_total, interval, buffer)
    assert got == want
    sl = training_slices(ep.drop("model"), p).groupBy("model").agg(F.min("n"), F.max("n"), F.count("*")).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in sl} == trained


def test_kernel_deterministic_and_outliers_rank_first():
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (500, 4))
    x[:5] += 8.0
    f1 = build_forest(x, 100, 256, (42, 1))
    f2 = build_forest(x, 100, 256, (42, 1))
    s1, s2 = score_samples(x, f1), score_samples(x, f2)
    assert np.array_equal(s1, s2)
    assert set(np.argsort(s1)[:5]) == set(range(5))
    off = offset_for(s1, 0.05)
    assert 0.04 <= np.mean(s1 - off < 0) <= 0.06


def test_spark_fit_score_flags_planted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (600, 3))
    x[550] = [9, 9, 9]
    rows = [(i + 1, [float(v) for v in x[i]]) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, vector array<double>")
    p = ForestParams(retrain_interval=200, buffer_size=200, n_estimators=50)
    ep = with_epochs(vector_sequence(df, ["k"]), p)
    nodes = fit_models(training_slices(ep, p), p)
    sc = score_vectors(ep, nodes, ["k"]).orderBy("n").collect()
    assert len(sc) == 600
    assert sc[0].reason == "model_not_trained" and sc[0].score == 0.0
    assert sc[550].is_anomaly and sc[550].score > 0
    # same result on a different partitioning
    sc2 = score_vectors(ep.repartition(5), nodes, ["k"]).orderBy("n").collect()
    assert [round(r.raw_score, 12) for r in sc] == [round(r.raw_score, 12) for r in sc2]


def test_fit_on_demand_needs_50_and_uses_last_buffer(spark):
    from tidewatch.operators.forest import fit_on_demand

    p = ForestParams(buffer_size=100, n_estimators=10)
    few = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 50)], "n long, vector array<double>")
    with pytest.raises(ValueError):
        fit_on_demand(few, p)
    many = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 301)], "n long, vector array<double>")
    from tidewatch.operators.forest import model_nodes

    models = fit_on_demand(many, p)
    m = models.toPandas()
    assert list(m["model"]) == [1] and list(m["train_rows"]) == [100] and list(m["n_trees"]) == [10]
    assert model_nodes(models).select("tree").distinct().count() == 10


def test_scoped_forest_equals_one_forest_per_scope(spark):
    """Numbering, epochs, carried values and scores of each scope are those of
    a run over that scope alone; one scope holds most rows."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidewatch.operators.forest import fit_and_score, vector_sequence, with_epochs
    from tidewatch.operators.vectors import feature_vectors
    from tidewatch.params import ForestParams

    rng = np.random.default_rng(3)
    fp = ForestParams(n_estimators=10, buffer_size=80, retrain_interval=100)
    n = 900
    scope = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "a", None)).tolist()
    rows = [(i, scope[i], f, float(rng.normal())) for i in range(n) for f in ("x", "y") if rng.random() < 0.8]
    stats = spark.createDataFrame(rows, "i long, scope string, feature string, zscore double")
    events = spark.createDataFrame([(i, scope[i]) for i in range(n)], "i long, scope string")

    def run(ev, st, scopes):
        vec = feature_vectors(ev, st, [], ["i"], ["x", "y"], scopes)
        ep = with_epochs(vector_sequence(vec, ["i"], scope_cols=scopes), fp)
        got = fit_and_score(ep, ["i"], fp, scope_cols=scopes).collect()
        return {r.i: (r.n, r.model, round(r.raw_score, 9), r.is_anomaly) for r in got}

    # a null scope is joined on: name it
    name = lambda df: df.withColumn("scope", F.coalesce("scope", F.lit("none")))
    together = run(name(events), name(stats), ["scope"])
    alone = {}
    for s in ("hot", "a", "none"):
        one = name(events).filter(F.col("scope") == s).drop("scope"), name(stats).filter(F.col("scope") == s).drop("scope")
        alone |= run(*one, [])
    assert together == alone and max(m for _, m, *_ in alone.values()) >= 5


def test_carry_forward_by_key(spark):
    """Values stay inside their key, whatever the partitions."""
    from tidewatch.operators.carry import carry_forward

    rows, want, last = [], [], {}
    for i in range(120):
        k = None if i < 15 else "a" if i < 90 else "b" if i < 95 else "c"
        v = float(i) if i in (3, 20, 91, 100) else None
        rows.append((k, i, v))
        last[k] = v if v is not None else last.get(k)
        want.append((i, last[k]))
    df = spark.createDataFrame(rows, "k string, i long, v double")
    for parts in (1, 3, 40):
        got = carry_forward(df, ["i"], ["v"], num_partitions=parts, key_cols=["k"]).collect()
        assert sorted((r.i, r.v) for r in got) == want


def test_rescoring_an_old_range_gives_the_old_scores(spark, tmpdir_fresh):
    """Models stay with the vector number from which they hold; a training on
    demand between the scheduled ones holds until the next."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidewatch.operators.forest import fit_and_score, fit_models, fit_on_demand, training_slices, with_epochs
    from tidewatch.operators.model_store import ModelStore, scheduled_from
    from tidewatch.params import ForestParams

    rng = np.random.default_rng(6)
    fp = ForestParams(n_estimators=10, buffer_size=80, retrain_interval=100)
    seq = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(1, 501)], "n long, vector array<double>")
    live = {r.n: round(r.raw_score, 12) for r in fit_and_score(with_epochs(seq, fp), ["n"], fp).collect()}
    store = ModelStore(spark, tmpdir_fresh)
    for key, (lo, hi) in {"a": (0, 250), "b": (250, 501)}.items():  # as a stream saves them
        slices = training_slices(seq, fp).filter((F.col("model") * 100 > lo) & (F.col("model") * 100 <= hi))
        for _ in range(2):
            store.save(fit_models(slices, fp), scheduled_from(fp), key)
    assert store.models().count() == 5
    old = seq.filter("n between 150 and 320").repartition(7)
    assert {r.n: round(r.raw_score, 12) for r in store.rescore(old, ["n"]).collect()} == {n: live[n] for n in range(150, 321)}
    assert {r.reason for r in store.rescore(seq.filter("n < 100"), ["n"]).collect()} == {"model_not_trained"}
    store.save(fit_on_demand(seq.filter("n <= 340"), fp), F.lit(340), "c")
    again = {r.n: round(r.raw_score, 12) for r in store.rescore(seq, ["n"]).collect()}
    assert sorted(n for n in live if again[n] != live[n]) == list(range(340, 400))


def test_walks_over_full_trees_equal_walks_to_leaves():
    import numpy as np
    from tidewatch.functions import iforest

    rng = np.random.default_rng(1)
    for n, trees, most in ((300, 10, 64), (60, 5, 256), (1, 3, 256)):
        forest = iforest.build_forest(np.round(rng.normal(size=(n, 4)), 1), trees, most, (1, n))
        x = rng.normal(size=(50, 4))
        x[0], x[1] = np.nan, np.inf
        want = []
        for row in x:
            depths = []
            for t in range(trees):
                node = 0
                while forest["feature"][t, node] >= 0:
                    node = 2 * node + (1 if row[forest["feature"][t, node]] < forest["threshold"][t, node] else 2)
                depths.append(forest["leaf_value"][t, node])
            want.append(np.array(depths).mean())
        assert iforest.path_lengths(x, forest).tolist() == want
        few = iforest.WALK_ROWS
        try:
            iforest.WALK_ROWS = 7  # blocks
            assert iforest.path_lengths(x, forest).tolist() == want
        finally:
            iforest.WALK_ROWS = few


@pytest.mark.parametrize("scope", [(), ("k",)])
def test_placed_vectors_are_numbered_without_a_second_sort(spark, scope):
    from pyspark.sql import functions as F
    from tidewatch.operators.forest import vector_sequence
    from tidewatch.operators.vectors import feature_vectors

    ev = spark.range(600).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"))
    z = (F.col("i") * 37 % 101).cast("double").alias("zscore")
    stats = ev.filter("i > 40 and i % 5 < 3").select(*scope, "i", F.lit("x").alias("feature"), z).unionByName(
        ev.filter("i > 90 and i % 7 < 2").select(*scope, "i", F.lit("y").alias("feature"), z))
    events = ev.select("i", *scope)
    plain = vector_sequence(feature_vectors(events, stats, [], ["i"], ["x", "y"], scope), ["i"], scope_cols=scope)
    placed = vector_sequence(feature_vectors(events, stats, [], ["i"], ["x", "y"], scope, keep_place=True), ["i"],
                             scope_cols=scope, placed=True)
    want = sorted((r.i, r.n, tuple(r.vector)) for r in plain.collect())
    assert want and sorted((r.i, r.n, tuple(r.vector)) for r in placed.collect()) == want
    assert sorted(placed.columns) == sorted(plain.columns)
