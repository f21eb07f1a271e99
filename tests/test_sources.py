"""Readers, sinks and streaming jobs on temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell.functions.fixed_values import WIDE_COLUMNS
from siftwell.operators import govern, planning
from siftwell.operators.standardize import ingest_fields, project_source, reindex, schema_errors, split_valid, wide_record_errors
from siftwell.sources import readers, sinks, store
from siftwell.sources.adapter import CollectedRecords
from siftwell.streaming import jobs as T
from tests.test_merge import RAW, at, empty_store, opportunity


def test_wide_export_round_trip(spark, tmp_path):
    row = {"company_name": "Acme, Inc", "profile_url": "https://x.example.com/a,b?c=1", "rating": "4.5", "email": "bad"}
    df = reindex(spark.createDataFrame([row]), WIDE_COLUMNS, {"record_kind": "company", "source_code": "wide"})
    sinks.write_csv(df, f"{tmp_path}/wide")
    back = readers.read_wide_export(spark, f"{tmp_path}/wide")
    assert back.columns == WIDE_COLUMNS and schema_errors(back.columns) == []
    got = back.collect()[0]
    assert (got.company_name, got.profile_url, got.record_kind) == ("Acme, Inc", "https://x.example.com/a,b?c=1", "company")
    valid, bad = split_valid(back, wide_record_errors("wide"))
    assert valid.count() == 0 and bad.collect()[0].errors == ["Invalid email: bad"]
    raw = readers.as_raw(back, F.lit("social"), F.lit(1).cast("bigint"))
    assert project_source(raw).collect()[0].organization_name == "Acme, Inc"


def test_json_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"source_code": "a", "title": "t", "extra": {"k": "v"}, "unknown": 1}, {"title": None}]))
    rows = readers.read_records(spark, f"{tmp_path}/r.json", form="array").collect()
    assert len(rows) == 2 and rows[0].extra == {"k": "v"} and rows[0].due_at is None
    (tmp_path / "l.jsonl").write_text("".join(json.dumps({"title": f"t{i}"}) + "\n" for i in range(3)))
    assert [r.title for r in readers.read_records(spark, f"{tmp_path}/l.jsonl").collect()] == ["t0", "t1", "t2"]
    (tmp_path / "p.json").write_text(json.dumps([{"title": "a"}, {"title": "b"}], indent=1))
    assert readers.read_records(spark, f"{tmp_path}/p.json", form="array").count() == 2
    for path, form in (("p.json", "lines"), ("l.jsonl", "array")):
        with pytest.raises(Exception):
            readers.read_records(spark, f"{tmp_path}/{path}", form=form).collect()


def test_catalog(spark, tmp_path):
    (tmp_path / "c.csv").write_text("keyword,name,code,aliases,related\nroofers,Roofing Contractors,0358,flat roofs;roofing,Siding|Gutters\n,Skylights,77,,\nx,,,,\n")
    custom = readers.read_catalog(spark, f"{tmp_path}/c.csv")
    base = spark.createDataFrame([(0, "Roofing Contractor", "1", ["roofing"], ["Siding"]), (1, "Siding", "2", [], [])],
                                 "position long, name string, code string, aliases array<string>, related array<string>")
    merged = {r.name: r for r in planning.merge_catalog(base, custom).collect()}
    assert set(merged) == {"Roofing Contractors", "Siding", "Skylights"}
    assert merged["Roofing Contractors"].code == "358"
    assert merged["Roofing Contractors"].aliases == ["roofing", "roofers", "flat roofs"]
    assert merged["Roofing Contractors"].related == ["Siding", "Gutters"]


def test_saved_pages(spark, tmp_path):
    (tmp_path / "a.html").write_text("<h1>a</h1>\n<p>b</p>")
    got = readers.read_pages(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].html == "<h1>a</h1>\n<p>b</p>" and got[0].url.endswith("a.html")


def test_versions_switch_as_a_whole(spark, tmp_path):
    table = f"{tmp_path}/t"
    one = spark.createDataFrame([(1, "a")], "k int, v string")
    sinks.write_version(one, table, 1, ["k"])
    sinks.write_version(one.unionAll(spark.createDataFrame([(2, "b")], one.schema)), table, 2, ["k"])
    (tmp_path / "t" / "v=00000003").mkdir()  # a write that never finished
    assert sinks.versions(spark, table) == [1, 2]
    assert sinks.current_version(spark, table).endswith("v=00000002")
    assert sinks.current_version(spark, table, below=2).endswith("v=00000001")
    with pytest.raises(ValueError):
        sinks.write_version(one.unionAll(one), table, 4, ["k"])


def test_store_round_trip(spark, tmp_path):
    from siftwell.operators.merge import upsert_store

    rows = ingest_fields(spark.createDataFrame([opportunity(1, "a"), opportunity(2, "b")], RAW))
    whole, _ = upsert_store(empty_store(spark), rows, at(1))
    store.write_store(whole, str(tmp_path), 1, buckets=4)
    again = store.read_store(spark, str(tmp_path))
    assert again.leads.count() == 2 and again.lead_sources.count() == 2
    with pytest.raises(FileExistsError):
        store.commit(spark, str(tmp_path), store.manifest(spark, str(tmp_path)))


def tables_of(found):
    return {name: sorted(repr(r) for r in getattr(found, name).drop("last_seen_at", "first_seen_at", "seen_at").collect()) for name in store.STORE_SCHEMAS}


def test_batches_write_only_their_buckets(spark, tmp_path):
    """Three batches give the same tables in sixteen buckets as in one; the third one touches few buckets."""
    folder, single = str(tmp_path / "s"), str(tmp_path / "one")
    batches = [[opportunity(i, f"x{i}", contact=f"Jane {i % 7}", email=f"j{i}@acme.com", org=f"Org {i % 9}") for i in range(60)],
               [opportunity(i, f"x{i}", title="changed", org=f"Org {i % 9}") for i in range(50, 80)], [opportunity(1, "x1", title="third", org="Org 1")]]
    for number, rows in enumerate(batches, 1):
        made = ingest_fields(spark.createDataFrame(rows, RAW)).withColumns({"run_id": F.lit(f"r{number}"), "dataset_id": F.lit(f"d{number}")})
        outcomes = store.upsert_records(made, folder, number, at(number), buckets=16)
        assert outcomes.collect() == store.upsert_records(made, single, number, at(number), buckets=1, check=True).collect()
        assert outcomes.select("inserted", "updated").collect()[0] == [(60, 0), (20, 10), (0, 1)][number - 1]
    now = tables_of(store.read_store(spark, folder))
    assert now == tables_of(store.read_store(spark, single))
    assert store.read_store(spark, folder, below=2).leads.count() == 60
    written = {name: len(list((tmp_path / "s" / name).glob("v=00000003/bucket=*"))) for name in store.STORE_SCHEMAS}
    assert written["leads"] == written["lead_sources"] == written["organizations"] == 1 and sum(written.values()) <= 7
    size = lambda v: sum(f.stat().st_size for f in (tmp_path / "s" / "leads").glob(f"v={v:08d}/*/part-*"))
    assert 0 < 4 * size(3) < size(1)
    lead = store.read_store(spark, folder).leads.filter("title = 'third'").collect()[0]
    assert (lead.version, lead.run_id, lead.dataset_id, lead.contact_id is not None) == (2, "r3", "d1", True)
    assert store.read_store(spark, folder).dataset_records.filter(F.col("identity_key") == lead.identity_key).count() == 2


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "s")
    made = lambda n, title="Bid": ingest_fields(spark.createDataFrame([opportunity(i, f"x{i}", title=title) for i in range(n)], RAW))
    store.upsert_records(made(10), folder, 1, at(1), buckets=2)
    before = tables_of(store.read_store(spark, folder))

    def fall(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "commit", fall)
    with pytest.raises(RuntimeError):
        store.upsert_records(made(20, "new"), folder, 2, at(2))
    monkeypatch.undo()
    assert tables_of(store.read_store(spark, folder)) == before
    assert store.upsert_records(made(20, "new"), folder, 2, at(2)).collect()[0].updated == 10
    after = tables_of(store.read_store(spark, folder))
    assert store.upsert_records(made(20, "new"), folder, 2, at(3)) is None  # a replay
    assert tables_of(store.read_store(spark, folder)) == after
    store.upsert_records(made(1, "newest"), folder, 3, at(3))
    assert store.vacuum(spark, folder, keep=1) > 0 and store.vacuum(spark, folder, keep=1) == 0
    assert store.read_store(spark, folder).leads.count() == 20 and store.committed(spark, folder) == [3]


def test_delivery_is_frozen_once(spark, tmp_path):
    requests = spark.createDataFrame([(1, None), (2, "x")], "request_id long, served_at string")
    shown = spark.createDataFrame([(1, 7, 0, "a"), (1, 8, 1, "b"), (1, 7, 2, "c"), (2, 9, 0, "z")], "request_id long, lead_id long, pos long, title string")
    sinks.record_delivery(requests, shown, F.col("pos"), at(3), f"{tmp_path}/d")
    got = sorted((r.request_id, r.lead_id, r["rank"], json.loads(r.snapshot)["title"]) for r in spark.read.parquet(f"{tmp_path}/d").collect())
    assert got == [(1, 7, 0, "c"), (1, 8, 1, "b")]


def test_field_maps_and_log_lines(spark, tmp_path):
    stored = spark.createDataFrame([("a", {"t": "x"}, True), ("b", {"t": "y"}, True)], "source_code string, field_map map<string,string>, reviewed boolean")
    changed = spark.createDataFrame([("b", {"t": "z"})], "source_code string, field_map map<string,string>")
    got = {r.source_code: (r.field_map["t"], r.reviewed) for r in sinks.upsert_field_maps(stored, changed).collect()}
    assert got == {"a": ("x", True), "b": ("z", False)}
    sinks.write_log_lines(spark.createDataFrame([('{"a":1}',)], "value string"), f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 1


def write_lines(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def test_collected_records_in_ranges(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder, "1.jsonl", [{"source_code": "a", "title": "t1", "tags": ["x"]}, {"title": "t2"}])
    write_lines(folder, "0.jsonl", [{"title": f"é{i}", "pad": "x" * (i % 50)} for i in range(200)])
    (folder / "notes.txt").write_text("no record")
    spark.dataSource.register(CollectedRecords)
    whole = spark.read.format("collected").option("source", "dflt").load(str(folder)).collect()
    assert len(whole) == 202 and {(r.source_code, r.raw["title"]) for r in whole} >= {("a", "t1"), ("dflt", "t2"), ("dflt", "é7")}
    for size in (700, 2500):
        parts = spark.read.format("collected").option("source", "dflt").option("range_bytes", size).load(f"file://{folder}").collect()
        assert sorted(parts) == sorted(whole)
    lines = [r.raw["title"] for r in sorted(whole)]
    assert lines == ["t1", "t2"] + [f"é{i}" for i in range(200)]


def test_collected_stream_reads_late_names_and_changed_files(spark, tmp_path):
    """An earlier name that comes late, two files in one batch, a file written again, a restart, a replay."""
    import os

    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(CollectedRecords)
    batches: list[tuple[int, list[str]]] = []

    def run(fail=False):
        def sink(df, i):
            batches.append((i, [r.raw["title"] for r in sorted(df.collect())]))
            if fail:
                raise RuntimeError("lost")

        stream = spark.readStream.format("collected").option("log", f"{tmp_path}/log").load(str(folder))
        T.drain(stream, sink, f"{tmp_path}/cp")

    write_lines(folder, "b.jsonl", [{"title": "b1"}, {"title": "b2"}])
    os.utime(folder / "b.jsonl", (100, 100))
    write_lines(folder, "c.jsonl", [{"title": "c1"}])
    os.utime(folder / "c.jsonl", (90, 90))
    run()
    write_lines(folder, "a.jsonl", [{"title": "a1"}])
    with pytest.raises(Exception):
        run(fail=True)
    write_lines(folder, "0.jsonl", [{"title": "late"}])  # comes between the failure and the replay
    run()
    write_lines(folder, "b.jsonl", [{"title": "b1"}, {"title": "b2"}, {"title": "b3"}])
    run()
    told = [b for b in batches if b[1]]
    assert told[0] == (0, ["c1", "b1", "b2"])
    assert [t for _, t in told[1:3]] == [["a1"], ["a1"]] and told[1][0] == told[2][0]
    assert [t for _, titles in told[3:] for t in titles] == ["late", "b1", "b2", "b3"]


def test_ingest_stream_over_two_files_and_a_replay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    columns = [c.split()[0] for c in RAW.split(", ")]
    write = lambda name, rows: (folder / name).write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))
    write("1.json", [opportunity(i, f"x{i}") for i in range(5)])
    stream = spark.readStream.schema(RAW).json(str(folder))
    T.ingest_stream(stream, f"{tmp_path}/store", at(1), f"{tmp_path}/cp")
    write("2.json", [opportunity(i, f"x{i}", title="changed") for i in range(3, 8)])
    T.ingest_stream(stream, f"{tmp_path}/store", at(2), f"{tmp_path}/cp")
    first = {r.identity_key: r.version for r in store.read_store(spark, f"{tmp_path}/store").leads.collect()}
    assert len(first) == 8 and sorted(first.values()) == [1] * 6 + [2] * 2
    assert store.read_store(spark, f"{tmp_path}/store", below=2).leads.count() == 5


def test_heartbeat_reaper(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    beats = [{"job_id": 1, "status": "Running", "ts": "2024-01-01T00:00:00"}, {"job_id": 2, "status": "Queued", "ts": "2024-01-01T00:00:00"},
             {"job_id": 3, "status": "Running", "ts": "2024-01-01T00:00:00"}]
    (folder / "1.json").write_text("\n".join(json.dumps(b) for b in beats))
    late = [{"job_id": 3, "status": "Running", "ts": "2024-01-01T00:20:00"}]
    stream = spark.readStream.schema("job_id long, status string, ts timestamp").json(str(folder))
    got = []
    for name, rows in (("2.json", late), ("3.json", [{"job_id": 9, "status": "Queued", "ts": "2024-01-01T00:25:00"}]), (None, [])):
        T.drain(T.stale_jobs(stream, 900), lambda df, i: got.extend(r.job_id for r in df.collect()), f"{tmp_path}/cp")
        if name:
            (folder / name).write_text("\n".join(json.dumps(b) for b in rows))
    assert got == [1]


def test_ancestors_with_circles(spark):
    rows = [(1, None, True), (2, 1, False), (3, 2, False), (4, 3, False), (5, 6, False), (6, 5, False), (7, 99, False)] + [(i, i - 1, False) for i in range(101, 140)] + [(100, 1, False)]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, is_root boolean")
    got = {r.id: r.root_id for r in govern.root_ancestors(nodes).collect()}
    assert got == {**{i: 1 for i in [1, 2, 3, 4, *range(100, 140)]}, 5: None, 6: None, 7: None}


def test_scope(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "lead_id long")
    visible = spark.createDataFrame([(7, 1), (7, 1), (8, 2)], "user_id long, lead_id long")
    ids = lambda df: sorted(r.lead_id for r in df.collect())
    assert ids(govern.scope_rows(rows, visible, "lead_id", 7)) == [1]
    assert ids(govern.scope_rows(rows, visible, "lead_id", None)) == []
    assert ids(govern.scope_rows(rows, visible, "lead_id", 7, is_admin=True)) == [1, 2, 3]


def test_fuzzy_keyword(spark):
    catalog = spark.createDataFrame([(0, "Underground Utilities", "11", [], []), (1, "Roofing", "12", ["roofers"], [])],
                                    "position long, name string, code string, aliases array<string>, related array<string>")
    asked = spark.createDataFrame([("undergrund utilitie",), ("roofer",), ("qqq",)], "keyword string")
    got = {r.key: (r.code, r.relation) for r in planning.resolve_keywords(asked, catalog).collect()}
    assert got == {"undergrund utilitie": ("11", "fuzzy_match"), "roofer": ("12", "primary"), "qqq": (None, None)}
