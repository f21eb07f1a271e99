"""Deliveries of users who ask for new leads only are the ones that matter."""

from siftwell.operators import search as S


def test_only_deliveries_of_asking_users_are_dealt(spark):
    asked = spark.createDataFrame([(1, 7, True), (2, 8, False), (3, None, True), (4, 7, True), (5, 9, None)], "request_id long, user_id long, new_only boolean")
    leads = spark.createDataFrame([(k, 2) for k in range(6)], "lead_id long, content_version int")
    told = spark.createDataFrame([(u, k, 2, "x" if k != 3 else None) for u in (7, 8, 9, None, 10) for k in (1, 3)], "user_id long, lead_id long, record_version int, served_at string")
    pairs = asked.crossJoin(leads)
    rows = sorted((r.request_id, r.lead_id) for r in S.exclude_delivered(pairs, told, asked).collect())
    assert rows == sorted((r.request_id, r.lead_id) for r in S.exclude_delivered(pairs, told).collect())
    assert rows == [(r, k) for r in range(1, 6) for k in range(6) if not (r in (1, 4) and k == 1)]
    plan = S.exclude_delivered(pairs, told, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
