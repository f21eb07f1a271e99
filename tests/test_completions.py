"""Completions of jobs as jobs and requests arrive."""

import json

import pytest

from siftwell.operators import deliver as D
from siftwell.streaming import jobs as T

JOBS, REQUESTS = "job_id long, finished_at timestamp, status string", "request_id long, job_id long, asked_at timestamp"


def job(i, day, status="Completed"):
    return {"job_id": i, "finished_at": f"2024-01-{day:02d}T00:00:00", "status": status}


def request(i, of, day):
    return {"request_id": i, "job_id": of, "asked_at": f"2024-01-{day:02d}T00:00:00"}


ENDS = [[job(1, 1), job(2, 2, "Running"), job(None, 2)], [job(3, 3, "Failed")], [job(4, 20)]]
ASKED = [[request(10, 3, 1), request(11, 1, 1), request(None, 1, 1)], [request(12, 1, 2), request(13, 2, 2), request(14, None, 2)], [request(15, 3, 4), request(16, 4, 20), request(17, 1, 15)]]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_completions_do_not_depend_on_the_order_of_arrival(spark, tmp_path, order):
    """No join state: a batch is one join with what is kept, and that is bounded by the horizon."""
    def streams(folder):
        return [spark.readStream.schema(schema).json(str(tmp_path / folder / kind)) for kind, schema in (("jobs", JOBS), ("requests", REQUESTS))]

    horizon = "5 days" if order == (0, 1, 2) else "30 days"
    for step in order:
        for kind, rows in (("jobs", ENDS[step]), ("requests", ASKED[step])):
            (tmp_path / "in" / kind).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / kind / f"{step}.json").write_text("\n".join(json.dumps(r) for r in rows))
        query = T.completion_log(*streams("in"), f"{tmp_path}/out", f"{tmp_path}/cp", horizon=horizon)
        assert all(not p.stateOperators for p in query.recentProgress)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/events").select("job_id", "request_id", "status", "event_id").collect() if r[1])
    jobs = spark.createDataFrame([tuple(r.values()) for b in ENDS for r in b], "job_id long, at string, status string")
    asked = spark.createDataFrame([tuple(r.values()) for b in ASKED for r in b], "request_id long, job_id long, at string").withColumn("kind", T.F.lit("request"))
    twin = D.completion_events(jobs, asked).filter("request_id IS NOT NULL").select("job_id", "request_id", "job_status", "event_id")
    assert got == sorted(tuple(r) for r in twin.collect() if horizon == "30 days" or r.request_id != 17)
    if horizon == "5 days":  # a request fourteen days after its job is for the batch twin, which brings it once
        met = spark.read.parquet(f"{tmp_path}/out/events")
        assert [(r.job_id, r.request_id) for r in D.completion_events(jobs, asked, met).collect()] == [(1, 17)]
        kept = spark.read.parquet(f"{tmp_path}/out/kept/v=00000003")
        assert {(r.job_id, r.request_id) for r in kept.collect()} == {(4, None), (4, 16), (1, 17)}
