"""Online isolation forest with periodic retraining, as Spark jobs.

The live detector appends every feature vector to a buffer of the last
``buffer_size`` vectors and retrains when ``retrain_interval`` vectors have
arrived since the last training and the buffer holds at least
``min_train`` (50). Update runs before predict, so the vector that
triggers a training is in its training set and is scored by the new model.
For vector number n (1-based, global order) with n0 = max(interval,
min_train):

    model(n) = 0                          if n < n0   (untrained)
             = 1 + (n - n0) div interval  otherwise

and model m trains on vectors (n_m - B, n_m], n_m = n0 + (m - 1) interval.

Plan: global vector numbers without a single-partition window
(:func:`with_global_position`); training slices by arithmetic (a vector
feeds ceil(B / interval) models at most, via ``explode(sequence)``);
``groupBy(model).applyInPandas`` fits all trees of one model from a slice
bounded by B rows; scoring cogroups each model's vectors (at most
``interval`` rows) with its model row (trees x 511 dense node arrays).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.detect import forest_details
from tidewatch.functions.iforest import build_forest, offset_for, score_samples
from tidewatch.session import materialize
from tidewatch.operators.positions import GPOS, PID, located, with_global_position
from tidewatch.params import ForestParams

# One row per model: dense per-tree node arrays (heap-numbered, row-major
# tree x node), so a model is one row of contiguous arrays rather than
# trees x nodes rows.
MODEL_SCHEMA = T.StructType([
    T.StructField("model", T.LongType()),
    T.StructField("n_trees", T.IntegerType()),
    T.StructField("psi", T.IntegerType()),
    T.StructField("max_depth", T.IntegerType()),
    T.StructField("offset", T.DoubleType()),
    T.StructField("train_rows", T.LongType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("leaf_value", T.ArrayType(T.DoubleType())),
])


def first_train(p: ForestParams) -> int | None:
    """Vector number of the first training, or None if it never trains."""
    if p.buffer_size < p.min_train:
        return None
    return max(p.retrain_interval, p.min_train)


def vector_sequence(
    vectors: DataFrame, order_cols: Sequence[str], vector_col: str = "vector", scope_cols: Sequence[str] = (),
    placed: bool = False,
) -> DataFrame:
    """Number the non-null vectors 1..N in ``order_cols`` order (column ``n``),
    each scope by itself: a row's position less that of its scope's first row,
    so no scope is gathered in a task.

    ``placed`` vectors are those of ``feature_vectors(keep_place=True)``: a
    written table whose sort is used again. A scope's vectors there are NULL up
    to the first that is ready and never after it, so that the positions of all
    rows number them too."""
    known = F.col(vector_col).isNotNull()
    scope = list(scope_cols)
    if placed:
        placed = located(vectors).drop(PID).filter(known)
        first = placed.groupBy(*scope).agg(F.min(GPOS).alias("_first"))
        met = placed.join(first, scope) if scope else placed.crossJoin(F.broadcast(first))  # one row
        return met.withColumn("n", F.col(GPOS) - F.col("_first") + 1).drop(GPOS, "_first")
    placed = with_global_position(vectors.filter(known), [*scope, *order_cols]).drop(PID)
    if not scope:
        return placed.withColumn("n", F.col(GPOS) + 1).drop(GPOS)
    first = placed.groupBy(*scope).agg(F.min(GPOS).alias("_first"))
    return placed.join(first, scope).withColumn("n", F.col(GPOS) - F.col("_first") + 1).drop(GPOS, "_first")


def with_epochs(seq: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """Add ``model``: the model that scores each vector (0 = untrained)."""
    n0 = first_train(p)
    if n0 is None:
        return seq.withColumn("model", F.lit(0).cast("long"))
    model = F.when(F.col("n") < n0, F.lit(0)).otherwise(F.expr(f"1 + (n - {n0}) div {p.retrain_interval}"))
    return seq.withColumn("model", model.cast("long"))


def training_slices(seq: DataFrame, p: ForestParams = ForestParams(), scope_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (model, vector in its training set): n in (n_m - B, n_m],
    with ``scope_cols`` per (scope, model)."""
    n0 = first_train(p)
    if n0 is None:
        return seq.withColumn("model", F.lit(None).cast("long")).filter(F.lit(False))
    i, b = p.retrain_interval, p.buffer_size
    scope = list(scope_cols)
    last_model = seq.groupBy(*scope).agg(F.max("n").alias("_nmax")).select(
        *scope, F.when(F.col("_nmax") >= n0, F.expr(f"1 + (_nmax - {n0}) div {i}")).otherwise(F.lit(0)).alias("_mmax"))
    # models m with n <= n_m < n + B, i.e. m in [ceil((n - n0) / I) + 1, floor((n + B - 1 - n0) / I) + 1]
    lo = F.greatest(F.lit(1), F.expr(f"CAST(ceil((n - {n0}) / {float(i)}) AS BIGINT) + 1"))
    hi = F.expr(f"CAST(floor((n + {b - 1} - {n0}) / {float(i)}) AS BIGINT) + 1")
    s = seq.join(last_model, scope) if scope else seq.crossJoin(F.broadcast(last_model))  # one row
    s = s.withColumn("_hi", F.least(hi, F.col("_mmax")))
    s = s.filter(F.col("_hi") >= lo).withColumn("model", F.explode(F.sequence(lo, F.col("_hi"))))
    return s.drop("_hi", "_mmax")


def _fit_fn(p: ForestParams, vector_col: str):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        model = int(pdf["model"].iloc[0])
        x = np.stack(pdf[vector_col].to_numpy())
        forest = build_forest(x, p.n_estimators, p.max_samples, (p.random_state, model))
        offset = offset_for(score_samples(x, forest), p.contamination)
        return pd.DataFrame({
            "model": [model],
            "n_trees": [np.int32(forest["feature"].shape[0])],
            "psi": [np.int32(forest["psi"])],
            "max_depth": [np.int32(forest["max_depth"])],
            "offset": [offset],
            "train_rows": [np.int64(len(x))],
            "feature": [forest["feature"].astype(np.int32).ravel()],
            "threshold": [forest["threshold"].ravel()],
            "leaf_value": [forest["leaf_value"].ravel()],
        })

    return fit


def fit_models(slices: DataFrame, p: ForestParams = ForestParams(), vector_col: str = "vector") -> DataFrame:
    """One row per model (see ``MODEL_SCHEMA``), one ``applyInPandas`` group per model."""
    return slices.select("model", "n", vector_col).groupBy("model").applyInPandas(_fit_fn(p, vector_col), MODEL_SCHEMA)


def model_nodes(models: DataFrame) -> DataFrame:
    """Models as node rows ``(model, tree, node, feature, threshold,
    leaf_value, offset)``: split nodes, leaves, and each tree's root."""
    width = F.expr("size(feature) div n_trees")
    z = models.select("model", "offset", width.alias("_w"),
                      F.posexplode(F.arrays_zip("feature", "threshold", "leaf_value")).alias("_i", "_z"))
    return z.select(
        "model", (F.col("_i") / F.col("_w")).cast("int").alias("tree"), (F.col("_i") % F.col("_w")).cast("int").alias("node"),
        F.col("_z.feature").alias("feature"), F.col("_z.threshold").alias("threshold"),
        F.col("_z.leaf_value").alias("leaf_value"), "offset",
    ).filter((F.col("feature") >= 0) | (F.col("leaf_value") > 0) | (F.col("node") == 0))


def _row_to_forest(m: pd.DataFrame) -> dict:
    t = int(m["n_trees"].iloc[0])
    feature = np.asarray(m["feature"].iloc[0], dtype=np.int64).reshape(t, -1)
    return {"feature": feature,
            "threshold": np.asarray(m["threshold"].iloc[0], dtype=np.float64).reshape(t, -1),
            "leaf_value": np.asarray(m["leaf_value"].iloc[0], dtype=np.float64).reshape(t, -1),
            "psi": int(m["psi"].iloc[0]), "max_depth": int(m["max_depth"].iloc[0])}


SCORE_FIELDS = [
    T.StructField("raw_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_anomaly", T.BooleanType()),
    T.StructField("reason", T.StringType()),
]


def score_vectors(
    epochs: DataFrame,
    nodes: DataFrame,
    keep: Sequence[str],
    vector_col: str = "vector",
) -> DataFrame:
    """Decision value of each vector under its epoch's model.

    ``raw_score`` = score_samples - offset (negative: anomalous);
    ``score`` = max(0, -raw_score). Untrained vectors (model 0) get raw 0,
    score 0 and ``reason = 'model_not_trained'`` without touching a model.
    """
    keep = list(dict.fromkeys([*keep, "n", "model"]))
    in_fields = {f.name: f for f in epochs.schema.fields}
    out_schema = T.StructType([in_fields[c] for c in keep] + SCORE_FIELDS)

    def score(vec: pd.DataFrame, nd: pd.DataFrame) -> pd.DataFrame:
        if vec.empty:
            return pd.DataFrame({f.name: [] for f in out_schema.fields})
        forest = _row_to_forest(nd)
        x = np.stack(vec[vector_col].to_numpy())
        raw = score_samples(x, forest) - float(nd["offset"].iloc[0])
        out = vec[keep].reset_index(drop=True)
        out["raw_score"] = raw
        out["score"] = np.maximum(0.0, -raw)
        out["is_anomaly"] = raw < 0
        out["reason"] = None
        return out

    trained = epochs.filter(F.col("model") > 0).select(*keep, vector_col)
    scored = trained.groupBy("model").cogroup(nodes.groupBy("model")).applyInPandas(score, out_schema)
    return scored.unionByName(_untrained(epochs, keep))


def _untrained(epochs: DataFrame, keep: Sequence[str]) -> DataFrame:
    return epochs.filter(F.col("model") == 0).select(
        *keep, F.lit(0.0).alias("raw_score"), F.lit(0.0).alias("score"), F.lit(False).alias("is_anomaly"),
        F.lit("model_not_trained").alias("reason"))


def forest_anomalies(scored: DataFrame, scale: float = 5.0) -> DataFrame:
    """Forest verdicts as anomaly rows: feature ``multi_feature``, value =
    normalised score, score x ``scale`` (severity range), type ``zscore``, and
    the evidence in ``details``."""
    return scored.filter("is_anomaly").select(
        *[c for c in scored.columns if c not in ("score", "raw_score", "is_anomaly", "reason")],
        F.lit("multi_feature").alias("feature"),
        F.col("score").alias("value"),
        (F.col("score") * F.lit(scale)).alias("score"),
        F.lit("zscore").alias("anomaly_type"),
        F.lit("isolation_forest").alias("detector"),
        "raw_score",
        forest_details().alias("details"),
    )


def fit_and_score(
    epochs: DataFrame, keep: Sequence[str], p: ForestParams = ForestParams(), vector_col: str = "vector", scope_cols: Sequence[str] = ()
) -> DataFrame:
    """:func:`score_vectors` with the models of :func:`fit_models`, without a
    model table: a group holds one model's training rows (at most
    ``buffer_size``) and the rows it scores (at most ``retrain_interval``).
    With ``scope_cols`` each scope has models of its own, trained and used at
    its own vector numbers."""
    scope = list(scope_cols)
    keep = list(dict.fromkeys([*scope, *keep, "n", "model"]))
    own = [c for c in keep if c not in ("n", "model", *scope)]
    epochs = epochs.select(*keep, vector_col)  # vector_sequence reads a written table
    in_fields = {f.name: f for f in epochs.schema.fields}
    out_schema = T.StructType([in_fields[c] for c in keep] + SCORE_FIELDS)
    train = training_slices(epochs.select(*scope, "n", vector_col), p, scope)
    train = train.select(*scope, "n", "model", vector_col, F.lit(True).alias("_train"))
    score = epochs.filter(F.col("model") > 0).withColumn("_train", F.lit(False))
    rows = score.unionByName(train, allowMissingColumns=True).select(*scope, "model", "n", *own, vector_col, "_train")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = pdf[pdf["_train"]].sort_values("n", kind="stable")
        vec = pdf[~pdf["_train"]]
        if vec.empty:
            return pd.DataFrame({f.name: [] for f in out_schema.fields})
        x = np.stack(fit[vector_col].to_numpy())
        forest = build_forest(x, p.n_estimators, p.max_samples, (p.random_state, int(fit["model"].iloc[0])))
        raw = score_samples(np.stack(vec[vector_col].to_numpy()), forest) - offset_for(score_samples(x, forest), p.contamination)
        out = vec[keep].reset_index(drop=True)
        out["raw_score"] = raw
        out["score"] = np.maximum(0.0, -raw)
        out["is_anomaly"] = raw < 0
        out["reason"] = None
        return out

    scored = rows.groupBy(*scope, "model").applyInPandas(work, out_schema)
    return scored.unionByName(_untrained(epochs, keep))


def score_with_model(vectors: DataFrame, model: DataFrame, keep: Sequence[str], vector_col: str = "vector") -> DataFrame:
    """Scores of all vectors under one model. The model is one row whose size
    is fixed by the forest's parameters, not by the data; it goes to every
    task, and no vector moves."""
    keep = list(keep)
    shared = vectors.sparkSession.sparkContext.broadcast(model.limit(1).toPandas())
    in_fields = {f.name: f for f in vectors.schema.fields}
    out_schema = T.StructType([in_fields[c] for c in keep] + SCORE_FIELDS)

    def work(batches):
        forest, offset = _row_to_forest(shared.value), float(shared.value["offset"].iloc[0])
        for vec in batches:
            if vec.empty:
                continue
            raw = score_samples(np.stack(vec[vector_col].to_numpy()), forest) - offset
            out = vec[keep].reset_index(drop=True)
            out["raw_score"], out["score"], out["is_anomaly"], out["reason"] = raw, np.maximum(0.0, -raw), raw < 0, None
            yield out

    return vectors.filter(F.col(vector_col).isNotNull()).select(*keep, vector_col).mapInPandas(work, out_schema)


def fit_on_demand(vectors: DataFrame, p: ForestParams = ForestParams(), vector_col: str = "vector", order_cols: Sequence[str] = ("n",)) -> DataFrame:
    """Train one model on an explicit set of vectors (``force_train``).

    Raises ``ValueError`` below ``min_train`` vectors. The last
    ``buffer_size`` vectors in ``order_cols`` order form the training set (a
    sort with a limit: every task hands on at most ``buffer_size`` rows).
    """
    known = vectors.filter(F.col(vector_col).isNotNull())
    last = materialize(known.orderBy(*[F.col(c).desc() for c in order_cols]).limit(p.buffer_size), "forest-buffer")
    cnt = last.count()
    if cnt < p.min_train:
        raise ValueError(f"Need at least {p.min_train} samples to train, buffer has {cnt}")
    buf = last.withColumn("model", F.lit(1).cast("long"))
    if tuple(order_cols) != ("n",):
        from pyspark.sql import Window

        buf = buf.withColumn("n", F.row_number().over(Window.orderBy(*order_cols)))  # at most buffer_size rows
    return fit_models(buf, p, vector_col)


def forest_status(epochs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """Model state after all vectors: trained?, vectors seen, buffered,
    retrain count, rows used by the last training."""
    n0 = first_train(p)
    agg = epochs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("total_seen"), F.coalesce(F.max("model"), F.lit(0)).alias("retrains"))
    last_nm = F.lit(n0 if n0 else 0) + (F.col("retrains") - 1) * F.lit(p.retrain_interval)
    return agg.select(
        (F.col("retrains") > 0).alias("is_trained"),
        F.col("total_seen").cast("long").alias("total_seen"),
        F.least(F.col("total_seen"), F.lit(p.buffer_size)).cast("long").alias("buffer_count"),
        F.col("retrains").cast("long").alias("retrains"),
        F.when(F.col("retrains") > 0, F.least(last_nm, F.lit(p.buffer_size))).otherwise(F.lit(0)).cast("long").alias("training_samples"),
    )
