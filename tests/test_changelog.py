"""Commits of a changing table: interleaved writers, folding, tombstones, intake into the table."""

import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import changes as CH
from strideframe.sources import changelog as CL
from strideframe.sources import fixtures as FX
from strideframe.sources import tables as TB
from strideframe.streaming import jobs as JB

from conftest import SF_SMALL

CHANGES = "seq long, op string, id long, user_id long, body string"


def now_():
    return F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")


def logs_of(spark, rows):
    """Logs (id, user_id, duration)."""
    df = spark.createDataFrame(rows, "id long, user_id long, duration_min int")
    have = set(df.columns)
    kinds = {f.name: f.dataType for f in S.LOGS.fields}
    return df.select(*[F.col(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in S.LOG_COLUMNS])


def table(spark, base):
    return {r["id"]: (r["user_id"], r["duration_min"]) for r in TB.read_current(spark, base).collect()}


def put(spark, rows, deleted=()):
    """A decision that writes the given states and deletions whatever the table holds."""
    def decide(logs, state):
        new = logs_of(spark, rows).withColumn("deleted", F.lit(False))
        gone = spark.createDataFrame([(i,) for i in deleted], "id long").withColumn("deleted", F.lit(True))
        return CL.Change(new.unionByName(gone, allowMissingColumns=True))

    return decide


def test_two_interleaved_writers_lose_nothing_and_give_a_serial_result(spark, tmp_path):
    base = str(tmp_path / "t")
    TB.write_snapshot(logs_of(spark, [(1, 7, 10), (2, 7, 20)]), base, 0)
    calls = []

    def patch(minutes, writer, meanwhile=None):
        body = f'{{"duration_min": {minutes}}}'

        def decide(logs, state):
            calls.append(writer)
            if meanwhile is not None and calls.count(writer) == 1:
                meanwhile()
            batch = spark.createDataFrame([(1, "patch", 1, 7, body), (2, "delete", 2, 7, None)], CHANGES)
            got = CH.apply_changes(batch, logs, now_(), materialize=True)
            rows = got.rewritten.select(*S.LOG_COLUMNS).withColumn("deleted", F.lit(False))
            return CL.Change(rows.unionByName(got.gone.withColumn("deleted", F.lit(True)), allowMissingColumns=True), got.outcomes)

        return decide

    first = CL.commit_change(spark, base, patch(30, "a", lambda: CL.commit_change(spark, base, patch(40, "b"), "b", 0)), "a", 0)
    # b was first: a decided again, on b's table, and its delete found nothing
    assert calls == ["a", "b", "a"] and first == 2
    assert table(spark, base) == {1: (7, 30)}
    outcomes = sorted((c["writer"], r["op"], r["outcome"]) for c in CL.commits_of(spark, base)
                      for r in spark.read.parquet(os.path.join(base, c["outcomes"])).collect())
    assert outcomes == [("a", "delete", "not_found"), ("a", "patch", "ok"), ("b", "delete", "deleted"), ("b", "patch", "ok")]
    assert CL.outcomes_of(spark, base).count() == 4
    # a replay adds nothing
    assert CL.commit_change(spark, base, patch(99, "a"), "a", 0) is None
    assert [n for n, _ in TB.changes_of(spark, base)] == [1, 2]


def test_writers_at_the_same_time_take_different_numbers(spark, tmp_path):
    base = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda w: CL.commit_change(spark, base, put(spark, [(w, w, w)]), f"w{w}", 0), range(1, 5)))
    assert sorted(numbers) == [1, 2, 3, 4]
    assert table(spark, base) == {w: (w, w) for w in range(1, 5)}
    assert CL.state_of(spark, base).writers == {f"w{w}": 0 for w in range(1, 5)}


def test_a_number_is_created_once(spark, tmp_path):
    path = str(tmp_path / "c" / "000000000001")
    assert CL.create_once(spark, path, "one") and not CL.create_once(spark, path, "two")
    assert open(path).read() == "one" and [f for f in os.listdir(tmp_path / "c") if not f.startswith(".")] == ["000000000001"]


def test_fifty_batches_read_a_constant_number_of_folders(spark, tmp_path):
    base, r = str(tmp_path / "t"), random.Random(2)
    TB.write_snapshot(logs_of(spark, [(i, i % 5, 0) for i in range(40)]), base, 0)
    want = {i: (i % 5, 0) for i in range(40)}
    written = 0
    for batch in range(50):
        rows = [(i, i % 5, batch) for i in r.sample(range(60), 3)]
        gone = [i for i in r.sample(range(60), 1) if i not in {x[0] for x in rows}]
        CL.commit_change(spark, base, put(spark, rows, gone), "w", batch)
        want.update({i: (u, m) for i, u, m in rows})
        for i in gone:
            want.pop(i, None)
        written += len(rows) + len(gone)
        CL.fold(spark, base)
        live = CL.state_of(spark, base).live
        levels = {f.level for f in live}
        assert all(sum(f.level == k for f in live) < CL.FAN for k in levels) and len(levels) <= 3
        assert [f.low for f in live] == sorted(f.low for f in live)
    assert table(spark, base) == want
    # folding keeps one state per id
    assert sum(f.rows for f in CL.state_of(spark, base).live) < written / 1.5
    number = CL.state_of(spark, base).number
    path = TB.compact(spark, base)
    assert f"v={number:06d}" in path and CL.state_of(spark, base).live == [] and table(spark, base) == want
    CL.commit_change(spark, base, put(spark, [(99, 1, 1)]), "w", 50)
    assert table(spark, base) == want | {99: (1, 1)} and len(CL.state_of(spark, base).live) == 1


def test_commits_during_a_compaction_or_fold_stay(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    TB.write_snapshot(logs_of(spark, [(1, 1, 1)]), base, 0)
    for b in range(3):
        CL.commit_change(spark, base, put(spark, [(b, 1, 10 + b)]), "w", b)
    real = TB.write_snapshot

    def slow(df, *a, **k):
        monkeypatch.setattr(TB, "write_snapshot", real)
        CL.commit_change(spark, base, put(spark, [(2, 1, 77), (8, 1, 8)]), "other", 0)
        return real(df, *a, **k)

    monkeypatch.setattr(TB, "write_snapshot", slow)
    CL.compact(spark, base)
    want = {0: (1, 10), 1: (1, 11), 2: (1, 77), 8: (1, 8)}
    assert table(spark, base) == want
    # a fold over the border of the snapshot: what the snapshot holds already is not read again
    for b in range(3):
        CL.commit_change(spark, base, put(spark, [(20 + b, 1, b)]), "w", 3 + b)
    assert CL.fold(spark, base) == 1 and table(spark, base) == want | {20: (1, 0), 21: (1, 1), 22: (1, 2)}


def test_tidy_renews_an_outgrown_snapshot(spark, tmp_path):
    base = str(tmp_path / "t")
    TB.write_snapshot(logs_of(spark, [(i, 1, 0) for i in range(10)]), base, 0)
    CL.commit_change(spark, base, put(spark, [(i, 1, 1) for i in range(4)]), "w", 0)
    CL.tidy(spark, base, least=2)
    assert TB.latest_snapshot(spark, base).endswith("v=000000") and CL.state_of(spark, base).snapshot_rows == 10
    CL.commit_change(spark, base, put(spark, [(i, 1, 2) for i in range(20, 28)]), "w", 1)
    CL.tidy(spark, base, least=2)
    assert not TB.latest_snapshot(spark, base).endswith("v=000000") and CL.state_of(spark, base).live == []
    assert len(table(spark, base)) == 18


def test_deleting_an_owner_writes_one_row(spark, tmp_path):
    base = str(tmp_path / "t")
    TB.write_snapshot(logs_of(spark, [(i, i % 3, i) for i in range(30)]), base, 0)
    CL.commit_change(spark, base, put(spark, [(40, 1, 40), (41, 2, 41)]), "w", 0)
    gone = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    CL.delete_owners(spark, base, gone, "cascade", 0)
    state = CL.state_of(spark, base)
    assert (state.live[-1].rows, state.live[-1].owners) == (1, 1)
    kept = {i: (i % 3, i) for i in range(30) if i % 3 != 1} | {41: (2, 41)}
    assert table(spark, base) == kept
    # later creates survive, of another owner and of the same one
    CL.commit_change(spark, base, put(spark, [(50, 0, 50), (51, 1, 51)]), "w", 1)
    kept |= {50: (0, 50), 51: (1, 51)}
    assert table(spark, base) == kept
    CL.commit_change(spark, base, put(spark, [(0, 0, 99)]), "w", 2)
    kept[0] = (0, 99)
    assert CL.fold(spark, base) >= 1 and table(spark, base) == kept
    CL.compact(spark, base)
    assert table(spark, base) == kept


def test_intake_ends_in_the_table(spark, tmp_path):
    """Replay adds nothing, a new checkpoint loses nothing, ids are unique."""
    base, users = str(tmp_path / "logs"), FX.users(spark, SF_SMALL)
    TB.write_snapshot(FX.logs(spark, SF_SMALL).select(*S.LOG_COLUMNS), base, 0)
    before = TB.read_current(spark, base).count()

    def run(ckpt):
        reqs = FX.new_logs_from(FX.logs_from_events(JB.events_stream(spark, SF_SMALL)))
        JB.stream_logs(reqs, users, str(tmp_path / "out"), str(tmp_path / ckpt), table_base=base, now=now_()).awaitTermination()

    run("one")
    accepted = CL.outcomes_of(spark, base).filter("outcome = 'accepted'").count()
    assert accepted > 0 and TB.read_current(spark, base).count() == before + accepted
    run("one")
    assert TB.read_current(spark, base).count() == before + accepted
    run("two")
    now = TB.read_current(spark, base)
    assert now.count() == now.select("id").distinct().count() == before + 2 * accepted
    outcomes = CL.outcomes_of(spark, base)
    assert outcomes.count() == 2000 and outcomes.filter("id is not null").select("id").distinct().count() == 2 * accepted
    # without a table: folders of a second checkpoint stand beside the first one's
    for ckpt in ("three", "four", "four"):
        reqs = FX.new_logs_from(FX.logs_from_events(JB.events_stream(spark, SF_SMALL)))
        JB.stream_logs(reqs, users, str(tmp_path / "out"), str(tmp_path / ckpt)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "outcomes")).count() == 2000
