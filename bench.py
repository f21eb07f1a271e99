"""Wall time of the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the number of local cores and
``BENCH_QUERIES`` an optional comma-separated choice. Every query is run in full; its result is
written to the no-op sink, so all rows and columns are computed.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from siftwell.plans import load_plans  # noqa: E402
from siftwell.session import local_session  # noqa: E402

HEADLINE = """search_category_state search_multi_request_cap search_new_only search_source_exists search_has_contact
search_unexpired_fresh lead_view main_location normalize_names identity_keys phones_in_text emails_in_text pii_mask
map_projection batch_merge_first arrival_merge_last upsert_outcomes child_insert_absent sighting_upsert listing_merge
location_merge person_merge delivery_rank fulfilment deliveries_per_user completion_events job_dedup queue_position
watchdog_gaps running_counters bounded_history decision_histogram dataset_recount department_rollup coverage_report
visibility_scope purge_closure ancestor_walk source_eligibility crawl_plan doc_dedup chunk_documents vector_topk
vector_topk_ann page_main_text page_links page_emails page_tables stream_counters stream_first_deliveries""".split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    plans = load_plans()
    chosen = os.environ.get("BENCH_QUERIES")
    names = list(plans) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the session
    seconds = {}
    for name in names:
        start = time.perf_counter()
        plans[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
