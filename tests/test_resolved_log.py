"""Follow-ups resolved by joins with a kept table, in any order and cut of arrival."""

import json

import pytest

from siftwell.operators import deliver as D
from siftwell.streaming import jobs as T

JOBS = "job_id long, finished_at timestamp, status string"
REQUESTS = "session_id long, request_id long, parent_id long, follow_up boolean, job_id long, asked_at timestamp"


def request(i, parent=None, job=None, session=1, follow=None, day=1):
    return {"session_id": session, "request_id": i, "parent_id": parent, "follow_up": parent is not None if follow is None else follow, "job_id": job, "asked_at": f"2024-01-{day:02d}T00:00:00"}


def end(job, status="Completed", day=1):
    return {"job_id": job, "finished_at": f"2024-01-{day:02d}T00:00:00", "status": status}


ASKED = [[request(1), request(2, 1), request(10, 11, 7, follow=True), request(20, None, 7, session=None), request(50, 51, 7, session=5), request(50, 51, 7, session=5, day=2)],
         [request(3, 2, 7), request(4, 3, 7), request(11, 10, None, follow=True), request(30, 99, 7), request(None, 1, 7)],
         [request(5, 4, 8), request(40, None, 7, session=2), request(41, 40, 7, session=2), request(51, session=5)]]
ENDS = [[end(7), end(None)], [end(8, "Failed")], [end(9, "Running")]]


def log(spark, folder, asked, ends, **options):
    """Events of the log over one batch of each, with the query that was run."""
    for kind, rows in (("r", asked), ("j", ends)):
        (folder / kind).mkdir(parents=True, exist_ok=True)
        (folder / kind / f"{len(list((folder / kind).iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))
    streams = [spark.readStream.schema(schema).json(str(folder / kind)) for kind, schema in (("j", JOBS), ("r", REQUESTS))]
    query = T.resolved_completion_log(*streams, f"{folder}/out", f"{folder}/cp", **options)
    events = spark.read.schema("request_id long, job_id long, status string, event_id string").parquet(f"{folder}/out/events")
    return sorted((r.request_id, r.job_id, r.status, r.event_id) for r in events.collect()), query


@pytest.mark.parametrize("cut", [((0, 1, 2),), ((0,), (1,), (2,)), ((2,), (0, 1)), ((1,), (2,), (0,))])
def test_log_equals_the_batch_twin_and_keeps_no_operator_state(spark, tmp_path, cut):
    for part in cut:
        got, query = log(spark, tmp_path, [r for i in part for r in ASKED[i]], [j for i in part for j in ENDS[i]])
        assert all(not p.stateOperators for p in query.recentProgress)
    twin = D.resolved_completions(spark.createDataFrame([tuple(j.values()) for b in ENDS for j in b], "job_id long, finished_at string, status string"),
                                  spark.createDataFrame([tuple(r.values()) for b in ASKED for r in b], "session_id long, request_id long, parent_id long, follow_up boolean, job_id long, asked_at string").dropDuplicates(["request_id"]))
    assert got == sorted((r.request_id, r.job_id, r.status, r.event_id) for r in twin.collect())
    assert [g[:3] for g in got] == [(1, 7, "Completed"), (1, 8, "Failed"), (40, 7, "Completed"), (51, 7, "Completed")]


def test_quiet_sessions_and_old_jobs_are_dropped(spark, tmp_path):
    """A session stays as a whole while it is active; a job is met within the horizon only."""
    def folder(at):
        return spark.read.parquet(f"{tmp_path}/out/kept/v={at:08d}")

    log(spark, tmp_path, [request(1), request(2, 1, 7), request(60, None, 6, session=6)], [end(6), end(7)], horizon="5 days")
    log(spark, tmp_path, [request(3, 2, None, day=14)], [end(8, day=15)], horizon="5 days")
    assert {r.request_id for r in folder(2).filter("session_id IS NOT NULL").collect()} == {1, 2, 3}
    got, _ = log(spark, tmp_path, [request(4, 3, 8, day=16), request(5, 4, 7, day=16), request(61, 60, 8, session=6, day=16)], [end(9, day=16)], horizon="5 days")
    assert [g[:2] for g in got] == [(1, 7), (1, 8), (60, 6)]
    assert {r.job_id for r in folder(3).filter("session_id IS NULL AND NOT sent").collect()} == {8, 9}
