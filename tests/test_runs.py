"""R-2: the change engine on runs, request by request."""

from pyspark.sql import functions as F

from strideframe.operators import changes as CH
from strideframe.operators import entity as EN

RUNS = "id long, user_id long, run_date date, distance_km double, duration_min int, heart_rate int, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_runs_are_created_patched_and_deleted(spark):
    import datetime as dt

    old, now = dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1)
    runs = spark.createDataFrame([(1, 7, dt.date(2024, 1, 1), 5.0, 30, 120, old, old), (2, 7, dt.date(2024, 1, 2), 6.0, 40, None, old, old),
                                  (3, 8, dt.date(2024, 1, 3), 7.0, 50, 110, old, old)], RUNS)
    requests = [
        ("patch", 1, 7, '{"heart_rate": null, "distance_km": "8.25"}', "ok"),   # null is a value where the field is not required
        ("patch", 1, 7, '{"distance_km": null}', "rejected_not_null"),
        ("patch", 1, 7, '{"duration_min": 12.5}', "invalid"),
        ("patch", 1, 7, '{"distance_km": -1}', "invalid"),
        ("patch", 1, 7, '{"heart_rate": 0}', "invalid"),
        ("patch", 1, 7, '{"run_date": 5, "equipment_used": 5}', "ok"),             # keys that no patch changes
        ("patch", 3, 7, '{"duration_min": 1}', "not_found"),                        # another owner's
        ("patch", 2, 7, '{"heart_rate": null}', "ok"),                              # changes nothing
        ("create", 10, 7, '{"run_date": "2024-05-01", "distance_km": 1, "duration_min": "9"}', "created"),
        ("create", 10, 7, '{"run_date": "2024-05-01", "distance_km": 1, "duration_min": 9}', "conflict"),
        ("create", 11, 7, '{"run_date": "2024-05-01", "duration_min": 9}', "invalid"),
        ("create", 12, 7, '{"run_date": "2024-05-41", "distance_km": 1, "duration_min": 9}', "invalid"),
        ("create", 13, 7, '{"run_date": "2024-05-01", "distance_km": 1, "duration_min": 9, "heart_rate": "x"}', "invalid"),
        ("patch", 10, 7, '{"heart_rate": 99}', "ok"),
        ("patch", 10, 7, '{"heart_rate": null}', "ok"),                             # the last value sent wins, also a null
        ("delete", 3, 8, None, "deleted"),
        ("delete", 3, 8, None, "not_found"),
        (None, 1, 7, None, "invalid"),
    ]
    changes = spark.createDataFrame([(k, *r[:4]) for k, r in enumerate(requests)], "seq long, op string, id long, user_id long, body string")
    got = CH.apply_changes(changes, runs, F.lit(now).cast("timestamp_ntz"), entity=EN.RUN)
    assert [r["outcome"] for r in got.outcomes.orderBy("seq").collect()] == [r[4] for r in requests]
    table = {r["id"]: tuple(r)[3:6] + (r["updated_at"],) for r in got.table.collect()}
    assert table == {1: (8.25, 30, None, now), 2: (6.0, 40, None, old), 10: (1.0, 9, None, now)}
    assert got.table.columns == EN.RUN.columns
