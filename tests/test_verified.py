"""Cited events that no detection belongs to."""

import datetime as dt

from emberline.operators import verified


def test_counter_register_lists_events_without_a_detection(spark):
    day = dt.date(2024, 3, 1)
    events = spark.createDataFrame(
        [(i, name, 20.0 + i, 75.0, 5.0, day, day, 1) for i, name in enumerate(["seen", "far", "late"])],
        "seq int, event_name string, lat double, lon double, radius_km double, start_date date, end_date date, label int")
    rows = spark.createDataFrame(
        [(20.0, 75.0, dt.datetime(2024, 3, 1, 23, 59)), (22.0, 75.0, dt.datetime(2024, 3, 2, 0, 0)), (21.5, 75.0, dt.datetime(2024, 3, 1))],
        "latitude double, longitude double, timestamp_utc timestamp")
    tagged = verified.attach_events(rows, events)
    seen = tagged.where("event_name IS NOT NULL").select("event_name").distinct()
    missed = verified.counter_register(events.join(seen, "event_name", "left_anti"), events)
    assert sorted((r.event_name, r.verified_events) for r in missed.collect()) == [("far", 3), ("late", 3)]
    none = events.limit(0)
    assert verified.counter_register(none, none).collect() == []
