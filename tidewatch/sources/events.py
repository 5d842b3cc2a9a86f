"""Trade-event schema, JSON parsing with dead letters, enrichment, unpivot.

Everything here is a stateless projection, so it runs unchanged on batch
and on streaming DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COL = "_corrupt_record"
CAST_FAILED_COL = "_cast_failed"

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("commodity_code", T.StringType()),
        T.StructField("declared_value", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("weight_kg", T.DoubleType()),
        T.StructField("unit_price", T.DoubleType()),
        T.StructField("origin_country", T.StringType()),
        T.StructField("destination_country", T.StringType()),
    ]
)


def parse_messages(
    raw: DataFrame,
    value_col: str = "value",
    schema: T.StructType = TRADE_SCHEMA,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Decode UTF-8 JSON payloads into typed columns (PERMISSIVE mode).

    Broken JSON and values of the wrong type leave the raw text in
    ``_corrupt_record``; :func:`split_dead_letters` routes those rows aside.
    Works on the Kafka source (binary ``value``) and on text/JSON files.
    """
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType())])
    text = F.col(value_col).cast("string")
    parsed = F.from_json(
        text, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    )
    out = raw.select(*keep, text.alias("_raw"), parsed.alias("_m")).select(*keep, "_raw", "_m.*")
    return out


def default_event_id(df: DataFrame, col: str = "event_id") -> DataFrame:
    """Missing event ids become ``"unknown"``."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit("unknown")))


def _non_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def dead_letter_reason(df: DataFrame, features: Sequence[str]) -> Column:
    """Why a parsed row cannot be processed, or NULL when it can.

    ``malformed``: undecodable JSON or a value of the wrong type;
    ``bad_number``: text in a tracked field that is no number (found by
    :func:`cast_features`); ``non_finite``: NaN or +-Infinity in a tracked
    numeric field (Spark orders NaN above every number, which would flag
    everything).
    """
    present = [f for f in features if f in df.columns]
    bad_num = F.lit(False)
    for f in present:
        bad_num = bad_num | F.coalesce(_non_finite(F.col(f)), F.lit(False))
    corrupt = F.col(CORRUPT_COL).isNotNull() if CORRUPT_COL in df.columns else F.lit(False)
    failed = F.col(CAST_FAILED_COL) if CAST_FAILED_COL in df.columns else F.lit(False)
    return F.when(corrupt, F.lit("malformed")).when(failed, F.lit("bad_number")).when(bad_num, F.lit("non_finite"))


def split_dead_letters(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Return ``(valid, dead_letters)``; dead letters carry a ``reason``."""
    tagged = df.withColumn("_reason", dead_letter_reason(df, features))
    valid = tagged.filter(F.col("_reason").isNull()).drop("_reason")
    valid = valid.drop(CORRUPT_COL, CAST_FAILED_COL)
    dead = tagged.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    return valid, dead


def derive_unit_price(
    df: DataFrame,
    value_col: str = "declared_value",
    qty_col: str = "quantity",
    out_col: str = "unit_price",
) -> DataFrame:
    """``unit_price = declared_value / quantity`` when both exist and quantity > 0.

    Otherwise an incoming ``unit_price`` (if the column exists) is kept.
    """
    derived = F.when(
        F.col(value_col).isNotNull() & (F.col(qty_col) > 0), F.col(value_col) / F.col(qty_col)
    )
    existing = F.col(out_col) if out_col in df.columns else F.lit(None).cast("double")
    return df.withColumn(out_col, F.coalesce(derived, existing))


def cast_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Coerce tracked features to DOUBLE. Text that is no number marks its row
    in ``_cast_failed``: :func:`split_dead_letters` rejects such a row whole."""
    out, failed = df, F.lit(False)
    for f in features:
        if f in df.columns:
            failed = failed | (F.col(f).isNotNull() & F.col(f).try_cast("double").isNull())
    out = out.withColumn(CAST_FAILED_COL, failed)
    for f in features:
        if f in df.columns:
            out = out.withColumn(f, F.col(f).try_cast("double"))
    return out


def unpivot_features(
    df: DataFrame,
    ids: Sequence[str],
    features: Sequence[str],
    feature_col: str = "feature",
    value_col: str = "value",
    along: str | None = None,
    in_place: bool = False,
) -> DataFrame:
    """One row per (event, present feature): the per-feature routing step.

    Absent (NULL) features are skipped, so each feature's window holds only
    that feature's own values. Features missing from the schema are skipped.
    ``along`` names a struct that holds a struct for each feature, whose
    fields go to the feature's row. With ``in_place`` the plan knows that rows
    stay in their partitions.
    """
    present = [f for f in features if f in df.columns]
    if not present:
        raise ValueError(f"none of the features {list(features)} is a column")
    if in_place:
        each = [F.struct(F.lit(f).alias(feature_col), F.col(f).cast("double").alias(value_col)) for f in present]
        return df.select(*ids, F.inline(F.array(*each))).filter(F.col(value_col).isNotNull())
    if along is not None:
        fields = df.schema[along].dataType[present[0]].dataType.names
        each = [F.struct(F.col(f).cast("double").alias(value_col), *[F.col(along)[f][x].alias(x) for x in fields]).alias(f) for f in present]
        # no fewer partitions: it keeps generated code of what follows out of that of the rows, where it does not compile
        long = df.select(*ids, *each).unpivot(list(ids), present, feature_col, "_row").coalesce(1 << 20)
        return long.filter(F.col(f"_row.{value_col}").isNotNull()).select(*ids, feature_col, "_row.*")
    narrow = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in present])
    long = narrow.unpivot(list(ids), present, feature_col, value_col)
    return long.filter(F.col(value_col).isNotNull())
