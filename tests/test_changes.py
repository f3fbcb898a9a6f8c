"""The change engine equals applying requests one by one (brute force in
Python on small random lists), plus the reference's own cases and the
boundary cases of patches and deletes."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import changes as CH
from strideframe.operators import records as RC

NOW = dt.datetime(2025, 1, 1)
T0 = dt.datetime(2024, 1, 1)
D0 = dt.date(2024, 1, 1)

PATCH_BODIES = [
    "{}", '{"duration_min": 5}', '{"duration_min": 0}', '{"duration_min": "7"}',
    '{"duration_min": 7.0}', '{"duration_min": 7.5}', '{"intensity": null}', '{"intensity": "low"}',
    '{"intensity": "' + "x" * 51 + '"}', '{"workout_type": "yoga", "equipment_used": "mat"}',
    '{"equipment_used": 5}', '{"workout_type": 3}', "notjson", "[1]", '{"duration_min": null}',
    '{"intensity": "high", "duration_min": 30}', '{"workout_type": "run"}', '{"intensity": "mid"}',
]
CREATE_BODIES = [
    {"workout_date": "2025-10-26", "duration_min": 60, "intensity": "high", "workout_type": "HIIT",
     "calories_burned": 500.0},
    {"workout_date": "2025-13-01", "duration_min": 60, "intensity": "high", "workout_type": "HIIT"},
    {"workout_date": "2025-10-27", "duration_min": 0, "intensity": "low", "workout_type": "yoga"},
    {"workout_date": "2025-10-28", "duration_min": 20, "intensity": "low", "workout_type": "yoga",
     "calories_burned": 0.0},
    {"workout_date": "2025-10-29", "duration_min": 20, "intensity": "moderate", "workout_type": "yoga"},
    {"workout_date": "2025-10-29", "duration_min": 30.7, "intensity": "low", "workout_type": "yoga"},
    {"workout_date": "2025-10-29", "duration_min": True, "intensity": "low", "workout_type": "yoga"},
    {"workout_date": "2025-10-29", "duration_min": "31", "intensity": "low", "workout_type": "yoga", "calories_burned": "12.5"},
    {"workout_date": "2025-10-29", "duration_min": 30, "intensity": "low", "workout_type": "yoga", "calories_burned": "abc"},
    {"workout_date": "2025-10-29", "duration_min": 30, "intensity": "low", "workout_type": "yoga", "calories_burned": [1]},
    {"workout_date": "2025-10-29", "duration_min": 30, "intensity": 5, "workout_type": "yoga"},
    [1, 2],
]
USERS = [(1, True), (2, True), (3, False)]   # user 4 does not exist


def _users_df(spark):
    rows = [(u, f"u{u}@example.com", act, 30, "g", "e", T0, T0) for u, act in USERS]
    return spark.createDataFrame(rows, S.USERS)


def _logs_rows():
    return [(i, 1 + (i % 3), D0, 10 * i, "low", "running", None if i == 2 else 100.0 + i, T0, T0)
            for i in range(1, 6)]


def _random_changes(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice(["create", "create", "patch", "patch", "patch", "delete", "delete", "merge", None])
        uid = rng.choice([1, 2, 3, 4, None, 1, 2])
        if op == "create":
            body = json.dumps(rng.choice(CREATE_BODIES[:1] * 4 + CREATE_BODIES))
            cid = rng.choice([-1, -2, -3, 3, 6, None])
        elif op == "patch":
            body = rng.choice(PATCH_BODIES)
            cid = rng.choice([-1, -2, 1, 2, 3, 4, 5, 7])
        else:
            body = None
            cid = rng.choice([-1, -2, 1, 2, 3, 4, 5, 7])
        out.append((seq * 3 + 1, op, cid, uid, body))
    return out


# ---------------------------------------------------------------------------
# brute force: one request at a time
# ---------------------------------------------------------------------------

def _is_int(v):
    if isinstance(v, bool):
        return False
    if isinstance(v, int):
        return abs(v) <= 2147483647
    if isinstance(v, float):
        return v == int(v) and abs(v) <= 2147483647
    if isinstance(v, str):
        return re.fullmatch(r"[+-]?[0-9]+", v) is not None and abs(int(v)) <= 2147483647
    return False


def _create_errors(b):
    errs = []
    if not isinstance(b, dict):
        return ["body_types"]
    d = b.get("workout_date")
    try:
        dt.date.fromisoformat(d) if isinstance(d, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) else 1 / 0
    except Exception:
        errs.append("date_parse")
    du = b.get("duration_min")
    if not (_is_int(du) and int(du) > 0):
        errs.append("duration_positive")
    for k, name in (("intensity", "intensity_len"), ("workout_type", "type_len")):
        v = b.get(k)
        if not (isinstance(v, str) and len(v) <= 50):
            errs.append(name)
    c = b.get("calories_burned")
    if isinstance(c, str) and re.fullmatch(r"[0-9.]+", c):
        c = float(c)
    if not (c is None or (isinstance(c, (int, float)) and not isinstance(c, bool) and c > 0)):
        errs.append("calories_positive")
    return errs


def brute_force(changes, logs_rows, users):
    active = dict(users) if users is not None else None
    table = {r[0]: dict(zip(S.LOG_COLUMNS, r)) for r in logs_rows}
    ever = set(table)
    outcomes = {}
    for seq, op, cid, uid, body in sorted(changes):
        auth = None
        if active is not None:
            if uid is None or uid not in active:
                auth = S.UNAUTHORIZED
            elif not active[uid]:
                auth = S.INACTIVE
        if auth:
            outcomes[seq] = auth
            continue
        if op == "create":
            b = json.loads(body)
            if _create_errors(b) or cid is None:
                outcomes[seq] = S.INVALID
            elif cid in ever:
                outcomes[seq] = S.CONFLICT
            else:
                ever.add(cid)
                table[cid] = {"id": cid, "user_id": uid, "workout_date": dt.date.fromisoformat(b["workout_date"]),
                              "duration_min": int(b["duration_min"]), "intensity": b["intensity"],
                              "workout_type": b["workout_type"],
                              "calories_burned": None if b.get("calories_burned") is None else float(b["calories_burned"]),
                              "created_at": NOW, "updated_at": NOW}
                outcomes[seq] = S.CREATED
            continue
        if op == "delete":
            row = table.get(cid)
            if row is not None and row["user_id"] == uid:
                del table[cid]
                outcomes[seq] = S.DELETED
            else:
                outcomes[seq] = S.NOT_FOUND
            continue
        if op != "patch":
            outcomes[seq] = S.INVALID
            continue
        # patch
        try:
            b = json.loads(body)
        except Exception:
            b = None
        ok = isinstance(b, dict)
        if ok:
            for k in ("intensity", "workout_type", "equipment_used"):
                if k in b and not (b[k] is None or isinstance(b[k], str)):
                    ok = False
            if "duration_min" in b and b["duration_min"] is not None:
                ok = ok and _is_int(b["duration_min"]) and int(float(b["duration_min"])) > 0
        if not ok:
            outcomes[seq] = S.INVALID
            continue
        row = table.get(cid)
        if row is None or row["user_id"] != uid:
            outcomes[seq] = S.NOT_FOUND
            continue
        sent = {k: b[k] for k in S.PATCHABLE_FIELDS if k in b}
        if any(v is None for v in sent.values()):
            outcomes[seq] = S.REJECTED_NOT_NULL
            continue
        if any(isinstance(v, str) and len(v) > 50 for k, v in sent.items() if k != "duration_min"):
            outcomes[seq] = S.REJECTED_TOO_LONG
            continue
        changed = False
        for k, v in sent.items():
            v = int(float(v)) if k == "duration_min" else v
            if row[k] != v:
                changed = True
            row[k] = v
        if changed:
            row["updated_at"] = NOW
        outcomes[seq] = S.OK
    return outcomes, table


def _run(spark, changes, with_users, materialize=False):
    logs = spark.createDataFrame(_logs_rows(), S.LOGS)
    ch = spark.createDataFrame(changes, S.CHANGES)
    users = _users_df(spark) if with_users else None
    res = CH.apply_changes(ch, logs, F.lit(NOW).cast("timestamp_ntz"), users, materialize=materialize)
    got_out = {r["seq"]: r["outcome"] for r in res.outcomes.collect()}
    got_tab = {r["id"]: r.asDict() for r in res.table.collect()}
    return got_out, got_tab


@pytest.mark.parametrize("seed,with_users,materialize",
                         [(1, True, False), (2, False, False), (3, True, True), (4, True, False)])
def test_apply_changes_equals_one_by_one(spark, seed, with_users, materialize):
    rng = random.Random(seed)
    changes = _random_changes(rng, 60)
    exp_out, exp_tab = brute_force(changes, _logs_rows(), USERS if with_users else None)
    got_out, got_tab = _run(spark, changes, with_users, materialize)
    assert got_out == exp_out
    assert got_tab == exp_tab


def test_reference_create_and_missing_lookup(spark):
    # the reference's record: id 1, user 100, 2025-10-26, 60 min, high, HIIT, 500.0
    users = spark.createDataFrame([(100, "a@b.co", True, 30, "g", "e", T0, T0)], S.USERS)
    logs = spark.createDataFrame([], S.LOGS)
    batch = spark.createDataFrame([(1, 100, "2025-10-26", 60, "high", "HIIT", 500.0)], S.NEW_LOGS)
    res = RC.create_logs(batch, logs, users, F.lit(NOW).cast("timestamp_ntz"))
    out = res.outcomes.collect()
    assert [(r["outcome"], r["user_id"], r["id"]) for r in out] == [(S.CREATED, 100, 1)]
    assert res.table.count() == 1
    req = spark.createDataFrame([(1, 999, 100)], "request_id long, id long, user_id long")
    got = RC.logs_for_owner(res.table, req).collect()
    assert [r["outcome"] for r in got] == [S.NOT_FOUND]


def test_patch_boundaries(spark):
    logs = spark.createDataFrame(_logs_rows(), S.LOGS)
    patches = spark.createDataFrame([
        (1, 1, 2, "{}"),                                   # empty body: ok, unchanged
        (2, 1, 2, '{"equipment_used": "mat"}'),            # ignored key only: ok
        (3, 1, 2, '{"intensity": null}'),                  # explicit null
        (4, 1, 2, '{"intensity": "' + "y" * 51 + '"}'),    # over the column length
        (5, 1, 3, '{"duration_min": 9}'),                  # wrong owner
        (6, 1, 2, '{"duration_min": 0}'),                  # validation
        (7, 1, 2, '{"duration_min": 11}'),
        (8, 1, 2, '{"duration_min": 12}'),                 # two patches of one field: last wins
    ], S.PATCHES)
    res = CH.patch_logs(patches, logs, F.lit(NOW).cast("timestamp_ntz"))
    out = {r["seq"]: r["outcome"] for r in res.outcomes.collect()}
    assert out == {1: S.OK, 2: S.OK, 3: S.REJECTED_NOT_NULL, 4: S.REJECTED_TOO_LONG,
                   5: S.NOT_FOUND, 6: S.INVALID, 7: S.OK, 8: S.OK}
    row = res.table.filter("id = 1").first()
    assert row["duration_min"] == 12 and row["intensity"] == "low" and row["updated_at"] == NOW
    untouched = res.table.filter("id = 2").first()
    assert untouched["updated_at"] == T0


def test_empty_patch_is_identity(spark):
    logs = spark.createDataFrame(_logs_rows(), S.LOGS)
    patches = spark.createDataFrame([(i, i, 1 + i % 3, "{}") for i in range(1, 6)], S.PATCHES)
    res = CH.patch_logs(patches, logs, F.lit(NOW).cast("timestamp_ntz"))
    assert sorted(map(tuple, res.table.collect())) == sorted(map(tuple, logs.collect()))


def test_same_delete_twice_and_patch_after_delete(spark):
    logs = spark.createDataFrame(_logs_rows(), S.LOGS)
    ch = spark.createDataFrame([
        (1, "patch", 3, 1, '{"duration_min": 5}'),
        (2, "delete", 3, 1, None),
        (3, "patch", 3, 1, '{"duration_min": 6}'),
        (4, "delete", 3, 1, None),
    ], S.CHANGES)
    res = CH.apply_changes(ch, logs, F.lit(NOW).cast("timestamp_ntz"))
    out = {r["seq"]: r["outcome"] for r in res.outcomes.collect()}
    assert out == {1: S.OK, 2: S.DELETED, 3: S.NOT_FOUND, 4: S.NOT_FOUND}
    assert res.table.filter("id = 3").count() == 0


def test_apply_changes_without_broadcast_budget(spark):
    """Over the broadcast budget the engine runs shuffle joins; same result."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rng = random.Random(11)
        changes = _random_changes(rng, 60)
        exp_out, exp_tab = brute_force(changes, _logs_rows(), USERS)
        got_out, got_tab = _run(spark, changes, True)
        assert got_out == exp_out
        assert got_tab == exp_tab
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_parsed_requests_keep_decisions_not_bodies(spark):
    """what the joins carry; and the parse in code that the JVM compiles (no kinds in whole-stage code)."""
    from strideframe.operators import entity as EN

    rows = spark.createDataFrame([
        (1, "patch", 1, 1, '{"duration_min": 5}'), (2, "patch", 1, 1, '{"duration_min": 2.5}'), (3, "patch", 1, 1, '{"intensity": null}'),
        (4, "create", 2, 1, '{"workout_date": "2024-01-01", "duration_min": "7", "intensity": "low", "workout_type": "yoga"}'),
        (5, "delete", 1, 1, None), (6, None, 1, 1, '{"duration_min": 5}')], "seq long, op string, id long, user_id long, body string")
    got = CH._parsed(rows, EN.LOG)
    assert "body" not in got.columns and not [c for c in got.columns if c[:2] in ("n_", "t_", "k_", "s_", "d_")]
    said = {r["seq"]: r for r in got.collect()}
    assert [said[k]["_invalid"] for k in range(1, 4)] == [False, True, False] and said[1]["v_duration_min"] == 5
    assert said[3]["_constraint"] == S.REJECTED_NOT_NULL and said[4]["create_ok"] and said[4]["duration_min"] == 7
    assert not said[6]["p_duration_min"]


def test_changed_rows_are_the_rewritten_and_the_gone_in_one_pass(spark):
    """what a streamed batch commits is one pass over the touched rows, not a union of two."""
    logs = spark.createDataFrame([(k, 1, dt.date(2024, 1, 1), 30, "low", "yoga", 1.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))
                                  for k in range(1, 6)], S.LOGS).select(*S.LOG_COLUMNS)
    rows = spark.createDataFrame([(1, "patch", 1, 1, '{"duration_min": 5}'), (2, "delete", 2, 1, None), (3, "patch", 3, 1, '{"duration_min": 6}'),
                                  (4, "delete", 3, 1, None), (5, "delete", 4, 9, None)], "seq long, op string, id long, user_id long, body string")
    got = CH.apply_changes(rows, logs, F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz"))
    said = {r["id"]: r for r in got.changed.collect()}
    assert {k: r["deleted"] for k, r in said.items()} == {1: False, 2: True, 3: True, 4: False}
    assert said[1]["duration_min"] == 5 and all(said[k][c] is None for k in (2, 3) for c in S.LOG_COLUMNS if c != "id")
    assert sorted(r["id"] for r in got.gone.collect()) == [2, 3]
    two = got.rewritten.withColumn("deleted", F.lit(False)).unionByName(got.gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    assert sorted(map(tuple, two.select(*got.changed.columns).collect()), key=repr) == sorted(map(tuple, got.changed.collect()), key=repr)
