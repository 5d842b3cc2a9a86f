"""Parsing, dead letters, enrichment, routing (unpivot), sink payloads."""

import json

from pyspark.sql import functions as F

from tidewatch.sources.events import (cast_features, derive_unit_price, parse_messages, split_dead_letters, unpivot_features,
                                      default_event_id)
from tidewatch.sources.sinks import alert_messages, kafka_sink_options, kafka_source_options

FEATURES = ["declared_value", "quantity", "weight_kg", "unit_price"]


def _msgs(spark, payloads):
    return spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "offset long, value string")


def test_parse_and_dead_letters(spark):
    good = json.dumps({"event_id": "ev-7", "timestamp": "2025-01-02T03:04:05Z", "commodity_code": "0901.21",
                       "declared_value": 820.5, "quantity": 41, "weight_kg": 33.25,
                       "origin_country": "PE", "destination_country": "NO"})
    payloads = [good, '{"event_id": "x", "quantity": ', '{"event_id": "y", "quantity": "abc"}',
                '{"event_id": "z", "declared_value": NaN}', '{"declared_value": 10, "quantity": 2}']
    parsed = parse_messages(_msgs(spark, payloads), keep=["offset"])
    valid, dead = split_dead_letters(parsed, FEATURES)
    reasons = {r.offset: r.reason for r in dead.collect()}
    assert reasons[1] == "malformed" and reasons[2] == "malformed"
    assert reasons.get(3) in ("non_finite", "malformed")
    v = {r.offset: r for r in default_event_id(valid).collect()}
    assert set(v) == {0, 4}
    assert v[0].declared_value == 820.5 and v[0].quantity == 41.0
    assert v[4].event_id == "unknown"


def test_unit_price_rules(spark):
    df = spark.createDataFrame([(500.0, 10.0, None), (500.0, 0.0, None), (None, 5.0, 7.0), (100.0, 4.0, 9.0)],
                               "declared_value double, quantity double, unit_price double")
    got = [r.unit_price for r in derive_unit_price(df).collect()]
    assert got == [50.0, None, 7.0, 25.0]


def test_unpivot_routes_present_features_only(spark):
    df = spark.createDataFrame([("e1", 100.0, 10.0, None, "ignored")],
                               "event_id string, declared_value double, quantity double, weight_kg double, other string")
    rows = {(r.feature, r.value) for r in unpivot_features(df, ["event_id"], FEATURES).collect()}
    assert rows == {("declared_value", 100.0), ("quantity", 10.0)}


def test_alert_messages_and_options(spark):
    df = spark.createDataFrame([("abc123", "f", 1.5)], "alert_id string, feature string, score double")
    m = alert_messages(df).first()
    assert m.key == "abc123" and json.loads(m.value) == {"alert_id": "abc123", "feature": "f", "score": 1.5}
    assert kafka_sink_options("b:9092", "alerts")["kafka.acks"] == "all"
    src = kafka_source_options("b:9092", "trades")
    assert src["startingOffsets"] == "latest" and "maxOffsetsPerTrigger" not in src and "failOnDataLoss" not in src
    assert kafka_source_options("b:9092", "trades", max_offsets_per_trigger=7)["maxOffsetsPerTrigger"] == "7"


def test_bad_numbers_are_rejected_whole(spark):
    df = cast_features(spark.createDataFrame([(1, "5", "1"), (2, "abc", "2"), (3, None, "3"), (4, "NaN", "4")],
                                             "offset long, quantity string, declared_value string"), FEATURES)
    valid, dead = split_dead_letters(df, FEATURES)
    assert {r.offset: r.reason for r in dead.collect()} == {2: "bad_number", 4: "non_finite"}
    assert {(r.offset, r.quantity) for r in valid.collect()} == {(1, 5.0), (3, None)}
    assert valid.columns == ["offset", "quantity", "declared_value"]
