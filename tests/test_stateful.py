"""Streams with state of their own: lives of jobs, completions of follow-ups."""

import json

import pytest

from siftwell.operators import deliver as D
from siftwell.streaming import jobs as T
from siftwell.streaming import stateful as S

LOG = "job_id long, ts timestamp, tie long, status string, records long, error string, run_id string, dataset_id string"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def entry(job, minute, status="Running", records=0, error=None, **kw):
    return {"job_id": job, "ts": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00", "tie": kw.get("tie", 0), "status": status, "records": records,
            "error": error, "run_id": f"r{job}", "dataset_id": f"d{job}" if job < 3 else None}


def test_lives_end_by_status_or_silence_and_leave_no_state(spark, tmp_path):
    S.use_rocksdb(spark)
    batches = [[entry(1, 0, records=5), entry(1, 4, error="e1"), entry(2, 0), entry(3, 0, "Queued"), entry(4, 0), entry(4, 2, "Completed", 7)],
               [entry(1, 8, records=2, error="e2"), entry(1, 9, "Partial", 1), entry(5, 9), entry(4, 10)],
               [entry(6, 200, "Queued"), entry(5, 12, "WaitingForUser", tie=1)], [entry(6, 201, "Cancelled")], [entry(7, 700, "Queued")]]
    ends = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for number, rows in enumerate(batches):
        write(tmp_path / "in", f"{number}.json", rows)
        T.drain(S.job_lives(stream, 900, "10 minutes", shown_errors=2), lambda df, i: ends.extend(df.collect()), f"{tmp_path}/cp")
    told = {(r.job_id, r.status): (r.records, r.entries, r.errors, r.error_message, r.duration_seconds) for r in ends}
    assert told == {(4, "Completed"): (7, 2, 0, None, 120.0), (1, "Partial"): (8, 4, 2, "e1; e2", 540.0), (2, "Failed"): (0, 1, 0, S.STALLED, 900.0),
                    (4, "Failed"): (0, 1, 0, S.STALLED, 900.0), (5, "Failed"): (0, 2, 0, S.STALLED, 1080.0), (6, "Cancelled"): (0, 2, 0, None, 60.0)}
    kept = spark.read.format("statestore").option("stateVarName", "life").load(f"{tmp_path}/cp")
    assert sorted(r.key[0] for r in kept.collect()) == [3, 7]  # the queued ones only
    cascade = S.end_cascade(spark.createDataFrame(ends)).collect()
    assert {(r.entity, r.id, r.status) for r in cascade if r.id.endswith("2")} == {("job", "2", "Failed"), ("run", "r2", "Failed"), ("dataset", "d2", "Failed")}
    assert ("dataset", None) not in {(r.entity, r.id) for r in cascade}


def test_lives_do_not_depend_on_the_cut(spark, tmp_path):
    import random

    S.use_rocksdb(spark)
    pick = random.Random(4)
    rows, minute = [], 0
    for _ in range(120):
        minute += pick.choice([1, 2, 5, 30])
        rows.append(entry(pick.randrange(1, 6), minute, pick.choice(["Running"] * 6 + ["Queued", "Completed"]), pick.randrange(9), pick.choice([None, "x"])))
    results = []
    for size in (120, 40):
        folder, got = tmp_path / f"in{size}", []
        for at in range(0, 120, size):
            write(folder, f"{at:03d}.json", rows[at:at + size])
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).json(str(folder))
        T.drain(S.job_lives(stream, 1200, "1 minute"), lambda df, i, got=got: got.extend(df.collect()), f"{tmp_path}/cp{size}")
        results.append(sorted((r.job_id, r.started_at, r.completed_at, r.status, r.records, r.entries, r.errors, r.error_message or "") for r in got))
    assert results[0] == results[1] and len(results[0]) > 10


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_follow_ups_resolve_in_any_order(spark, tmp_path, order):
    """Chains over several batches; a circle, a missing parent and a request without session give nothing."""
    S.use_rocksdb(spark)
    request = lambda i, parent=None, job=None, session=1, follow=None: {
        "session_id": session, "request_id": i, "parent_id": parent, "follow_up": parent is not None if follow is None else follow, "job_id": job, "asked_at": "2024-01-01T00:00:00"}
    asked = [[request(1), request(2, 1), request(10, 11, 7, follow=True), request(20, None, 7, session=None)],
             [request(3, 2, 7), request(4, 3, 7), request(11, 10, None, follow=True), request(30, 99, 7)], [request(5, 4, 8), request(40, None, 7, session=2), request(41, 40, 7, session=2)]]
    jobs = [[{"job_id": 7, "finished_at": "2024-01-01T00:00:00", "status": "Completed"}], [{"job_id": 8, "finished_at": "2024-01-01T00:00:00", "status": "Failed"}],
            [{"job_id": 9, "finished_at": "2024-01-01T00:00:00", "status": "Running"}]]
    schemas = "session_id long, request_id long, parent_id long, follow_up boolean, job_id long, asked_at timestamp", "job_id long, finished_at timestamp, status string"
    got = []
    for step in range(3):
        write(tmp_path / "r", f"{step}.json", asked[order[step]])
        write(tmp_path / "j", f"{step}.json", jobs[order[step]])
        found = S.resolved_completions(spark.readStream.schema(schemas[1]).json(str(tmp_path / "j")), spark.readStream.schema(schemas[0]).json(str(tmp_path / "r")))
        T.drain(found, lambda df, i: got.extend((r.request_id, r.job_id, r.status, r.event_id) for r in df.collect()), f"{tmp_path}/cp")
    batch = D.resolved_completions(spark.createDataFrame([tuple(j.values()) for b in jobs for j in b], "job_id long, finished_at string, status string"),
                                   spark.createDataFrame([tuple(r.values()) for b in asked for r in b], "session_id long, request_id long, parent_id long, follow_up boolean, job_id long, asked_at string"))
    assert sorted(got) == sorted((r.request_id, r.job_id, r.status, r.event_id) for r in batch.collect())
    assert {g[:3] for g in got} == {(1, 7, "Completed"), (1, 8, "Failed"), (40, 7, "Completed")}
    assert D.resolved_completions(batch.select("job_id", "status"), spark.createDataFrame([(1, 1, None, False, 7)], "session_id long, request_id long, parent_id long, follow_up boolean, job_id long"), batch).count() == 0
