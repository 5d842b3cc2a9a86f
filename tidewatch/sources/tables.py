"""Adapters from the benchmark tables to the detector's data model.

* ``events``   -> univariate stream: one feature ``value``, order (ts, event_id).
* ``lineitem`` -> trades: declared_value = l_extendedprice, quantity =
  l_quantity, weight_kg = l_quantity * p_size (join ``part``), unit_price
  derived; order (l_shipdate, l_orderkey, l_linenumber, l_partkey), which is
  a total order at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.events import derive_unit_price

EVENT_ORDER = ("ts", "event_id")
TRADE_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey")


def trade_event_id() -> F.Column:
    """Trade event id text ``orderkey-linenumber-partkey``; built at the
    output so heavy stages carry only the numeric key columns."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as long rows ``(event_id, ts, feature, value)``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", "ts", F.lit("value").alias("feature"), "value").filter(
        F.col("value").isNotNull()
    )


def lineitem_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` (+ ``part`` for weight) as wide trade events.

    ``part`` is joined with a plain equi-join: it grows with the scale
    factor, so the planner (AQE) decides whether it is small enough to
    broadcast at run time.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_shipdate",
    )
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    trades = li.join(part, li.l_partkey == part.p_partkey, "left").select(
        trade_event_id().alias("event_id"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_brand",
        F.col("l_extendedprice").alias("declared_value"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_quantity") * F.col("p_size")).alias("weight_kg"),
    )
    return derive_unit_price(trades)


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` rendered as JSON trade messages, as a broker would carry them.

    ``event_type='error'`` events carry a truncated (undecodable) payload and
    ``value`` goes to ``declared_value``; ``props.k`` is the quantity.
    """
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"event_id": "'), F.col("event_id").cast("string"),
        F.lit('", "commodity_code": "'), F.col("event_type"),
        F.lit('", "declared_value": '), F.col("value").cast("string"),
        F.lit(', "quantity": '), k,
    )
    msg = F.when(F.col("event_type") == "error", body).otherwise(F.concat(body, F.lit("}")))
    return ev.select(F.col("event_id").alias("offset"), F.col("ts"), msg.alias("value"))
