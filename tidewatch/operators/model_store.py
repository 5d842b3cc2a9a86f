"""Forest models by the vector number from which they hold, on shared storage.

Every trained model stays, so any range of vectors can be scored again by the
models that were valid at the time, also after trainings on demand between
the scheduled ones. A vector meets its model by an as-of join: vectors and
the models' first numbers are range-sorted together and the model is carried
forward (:mod:`tidewatch.operators.carry`), so neither side is gathered in a
task and no pair of a vector and another model is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.carry import carry_forward
from tidewatch.operators.forest import MODEL_SCHEMA, first_train, score_vectors
from tidewatch.params import ForestParams
from tidewatch.session import materialize

FROM = "valid_from"
_SCHEMA = T.StructType([*MODEL_SCHEMA.fields, T.StructField(FROM, T.LongType())])


def scheduled_from(p: ForestParams) -> Column:
    """The vector number that triggers the training of ``model``."""
    return F.lit(first_train(p)) + (F.col("model") - 1) * F.lit(p.retrain_interval)


class ModelStore:
    """Models under ``path``, one folder for each ``save``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, models: DataFrame, valid_from: Column, key: str) -> None:
        """Add models (:data:`MODEL_SCHEMA`); a second save under one key
        replaces the first."""
        rows = models.withColumn(FROM, valid_from.cast("long")).select(*[f.name for f in _SCHEMA.fields])
        rows.write.mode("overwrite").parquet(f"{self.path}/save={key}")

    def models(self) -> DataFrame:
        """All models, numbered by the order in which they became valid (of
        models from one vector number on, the one saved last by key counts)."""
        found = self.spark.read.schema(T.StructType([*_SCHEMA.fields, T.StructField("save", T.StringType())])).option("basePath", self.path).parquet(self.path)
        last = found.groupBy(FROM).agg(F.max("save").alias("save"))
        return found.join(last, [FROM, "save"]).drop("save").withColumn("model", F.col(FROM))

    def assign(self, vectors: DataFrame) -> DataFrame:
        """``vectors(n, ...)`` with ``model``: the number from which the model
        valid at n holds, 0 before the first."""
        own = vectors.drop("model").withColumn("_kind", F.lit(1)).withColumn("model", F.lit(None).cast("long"))
        marks = self.models().select(F.col(FROM).alias("n"), F.lit(0).alias("_kind"), "model")
        both = own.unionByName(marks, allowMissingColumns=True)
        met = carry_forward(both, ["n", "_kind"], ["model"]).filter("_kind = 1")
        return met.withColumn("model", F.coalesce("model", F.lit(0))).drop("_kind")

    def rescore(self, vectors: DataFrame, keep: Sequence[str], vector_col: str = "vector") -> DataFrame:
        """:func:`score_vectors` under the models valid at each vector's number."""
        met = materialize(self.assign(vectors), "rescored")
        used = self.models().join(met.select("model").distinct(), "model", "left_semi")
        return score_vectors(met, used, keep, vector_col)
