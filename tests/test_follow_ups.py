"""Follow-ups resolved on a stream: ids are kept whole, a session is one row of state."""

import json

from siftwell.streaming import jobs as T
from siftwell.streaming import stateful as S


def test_ids_beyond_doubles_resolve(spark, tmp_path):
    """A missing parent or job beside a large id must not turn it into a rounded number."""
    S.use_rocksdb(spark)
    first = (1 << 53) + 1
    for name, rows in (("r", [{"session_id": 1, "request_id": first, "follow_up": False}, {"session_id": 1, "request_id": 5, "parent_id": first, "follow_up": True, "job_id": first + 2}]),
                       ("j", [{"job_id": first + 2, "finished_at": "2024-01-01T00:00:00", "status": "Completed"}])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "0.json").write_text("\n".join(json.dumps({"asked_at": "2024-01-01T00:00:00"} | r) for r in rows))
    requests = spark.readStream.schema("session_id long, request_id long, parent_id long, follow_up boolean, job_id long, asked_at timestamp").json(f"{tmp_path}/r")
    jobs = spark.readStream.schema("job_id long, finished_at timestamp, status string").json(f"{tmp_path}/j")
    got = []
    T.drain(S.resolved_completions(jobs, requests), lambda df, i: got.extend((r.request_id, r.job_id) for r in df.collect()), f"{tmp_path}/cp")
    assert got == [(first, first + 2)]


def test_long_chains_are_walked_once():
    pointers = {n: (n - 1, n == 0) for n in range(20_000)}
    assert S._root(pointers, 19_999) == ("found", 0)
    assert pointers[10_000] == (0, False)
