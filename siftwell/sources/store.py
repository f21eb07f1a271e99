"""The canonical tables as hash buckets under a commit log.

Rows lie in buckets by a hash of their keys. A batch reads the buckets of its own keys, writes these
anew below its version number and then commits with one small file, the manifest, that names for every
bucket of every table the version which wrote it last::

    store/leads/v=00000007/bucket=12/part-...     written by version 7
    store/_log/00000007.json                      what version 7 consists of

So the work of a batch follows its keys and not the size of the store. Readers take one manifest and
see all tables of one version, whatever is written meanwhile; files without a manifest don't exist for
them. A version that has its manifest is never written again. One writer at a time is assumed.
"""

from __future__ import annotations

import dataclasses
import functools
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import STORE_KEYS, STORE_SCHEMAS, LeadStore, arriving_rows, batch_outcomes, resolved_rows, upsert_arriving
from .sinks import _files


@dataclasses.dataclass(frozen=True)
class Manifest:
    """``tables`` has per table the version that wrote each bucket; a bucket that is absent is empty."""

    version: int
    buckets: int
    tables: Mapping[str, Mapping[int, int]]


def _log(folder: str, version: int) -> str:
    return f"{folder}/_log/{version:08d}.json"


def committed(spark: SparkSession, folder: str) -> list[int]:
    """Versions that have a manifest, oldest first."""
    fs, root, _ = _files(spark, f"{folder}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, folder: str, below: int | None = None) -> Manifest | None:
    """The newest manifest, or the newest before the version ``below``."""
    done = [v for v in committed(spark, folder) if below is None or v < below]
    if not done:
        return None
    text = spark.read.text(_log(folder, done[-1]), wholetext=True).first()["value"]
    read = json.loads(text)
    return Manifest(read["version"], read["buckets"], {t: {int(b): v for b, v in of.items()} for t, of in read["tables"].items()})


def commit(spark: SparkSession, folder: str, state: Manifest) -> None:
    """Make a version visible: its manifest is written aside and then named. A second commit of a version is an error."""
    fs, target, jvm = _files(spark, _log(folder, state.version))
    if fs.exists(target):
        raise FileExistsError(f"version {state.version} of {folder} is there already")
    aside = jvm.org.apache.hadoop.fs.Path(f"{folder}/_log/.{state.version:08d}.writing")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(dataclasses.asdict(state)).encode()))
    out.close()
    if not fs.rename(aside, target):
        raise OSError(f"{target} could not be named")


def bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*STORE_KEYS[name]), F.lit(buckets)).cast("int")


def touched(arriving: Mapping[str, DataFrame], buckets: int) -> dict[str, list[int]]:
    """Per table the buckets that the keys of the arriving rows fall into: at most ``buckets`` numbers each, in one job."""
    numbers = [rows.select(F.lit(name).alias("name"), bucket(name, buckets).alias("bucket")) for name, rows in arriving.items()]
    found = functools.reduce(DataFrame.union, numbers).distinct().collect()
    return {name: sorted(r.bucket for r in found if r.name == name) for name in arriving}


def read_table(spark: SparkSession, folder: str, name: str, state: Manifest | None, only: list[int] | None = None) -> DataFrame:
    """One table as of a manifest, or some of its buckets."""
    written = {} if state is None else state.tables.get(name, {})
    chosen = [f"{folder}/{name}/v={v:08d}/bucket={b}" for b, v in written.items() if only is None or b in only]
    return spark.read.schema(STORE_SCHEMAS[name]).parquet(*chosen) if chosen else spark.createDataFrame([], STORE_SCHEMAS[name])


def read_store(spark: SparkSession, folder: str, below: int | None = None) -> LeadStore:
    """All tables of the newest version, or of the newest before ``below``; absent tables are empty."""
    state = manifest(spark, folder, below)
    return LeadStore(**{name: read_table(spark, folder, name, state) for name in STORE_SCHEMAS})


def _write(table: DataFrame, folder: str, name: str, version: int, buckets: int, check: bool) -> list[int]:
    """Write rows by bucket below a version and return the buckets written; ``check`` looks for keys that are there twice."""
    path, spark = f"{folder}/{name}/v={version:08d}", table.sparkSession
    table.withColumn("bucket", bucket(name, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    fs, root, _ = _files(spark, path)
    written = sorted(int(n[7:]) for n in (s.getPath().getName() for s in fs.listStatus(root)) if n.startswith("bucket="))
    if check and written:
        double = spark.read.schema(STORE_SCHEMAS[name]).parquet(path).groupBy(*STORE_KEYS[name]).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if not double.isEmpty():
            raise ValueError(f"{path}: {list(STORE_KEYS[name])} is not unique")
    return written


def write_store(store: LeadStore, folder: str, version: int, buckets: int = 64) -> None:
    """Whole tables as one version, in place of whatever was there."""
    tables = {name: dict.fromkeys(_write(getattr(store, name), folder, name, version, buckets, True), version) for name in STORE_SCHEMAS}
    commit(store.leads.sparkSession, folder, Manifest(version, buckets, tables))


def upsert_records(records: DataFrame, folder: str, version: int, as_of: Column, merge: str = "arrival", buckets: int = 64,
                   check: bool = False) -> DataFrame | None:
    """Upsert ingest rows (see ``ingest_fields``) as one version and return the outcomes, None if it is committed already.

    ``buckets`` counts for a new store only. Keys are unique by the way rows are merged; ``check`` looks
    at what was written as well.
    """
    spark = records.sparkSession
    if version in committed(spark, folder):
        return None
    before = manifest(spark, folder, below=version)
    buckets = before.buckets if before else buckets
    told = records.filter(F.col("source_code").isNotNull() & F.col("external_id").isNotNull())
    asked = touched({"lead_sources": told}, buckets)["lead_sources"]
    sightings = read_table(spark, folder, "lead_sources", before, asked)
    rows = resolved_rows(sightings, records).persist()  # read by every table
    arriving = arriving_rows(rows, as_of)
    own = touched(arriving, buckets) | {"lead_sources": asked}
    part = LeadStore(**{name: read_table(spark, folder, name, before, own[name]) for name in STORE_SCHEMAS})
    leads, new = upsert_arriving(part, arriving, as_of, merge)
    leads = leads.persist()  # written, and counted by outcome
    new = dataclasses.replace(new, leads=leads.drop("outcome"))
    tables = {}
    for name in STORE_SCHEMAS:
        kept = dict(before.tables.get(name, {})) if before else {}
        written = _write(getattr(new, name), folder, name, version, buckets, check) if own[name] else []
        tables[name] = kept | dict.fromkeys(written, version)
    outcomes = batch_outcomes(rows.withColumn("run", F.lit("run")), leads, "identity_key", "run")
    outcomes = spark.createDataFrame(outcomes.collect(), outcomes.schema)  # one row, before what it was made from changes
    commit(spark, folder, Manifest(version, buckets, tables))
    leads.unpersist()
    rows.unpersist()
    return outcomes


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the buckets that none of the last ``keep`` versions uses, and older manifests; returns how many buckets went.

    Files of versions that were never committed go as well, unless they are newer than the last commit.
    """
    fs, root, jvm = _files(spark, folder)
    done = committed(spark, folder)
    if not done:
        return 0
    states = [manifest(spark, folder, v + 1) for v in done[-keep:]]
    used = {(t, b, v) for s in states for t, of in s.tables.items() for b, v in of.items()}
    gone = 0
    for name in STORE_SCHEMAS:
        table = jvm.org.apache.hadoop.fs.Path(root, name)
        for version in fs.listStatus(table) if fs.exists(table) else []:
            number = int(version.getPath().getName()[2:])
            if number > done[-1]:
                continue
            for part in fs.listStatus(version.getPath()):
                label = part.getPath().getName()
                if label.startswith("bucket=") and (name, int(label[7:]), number) not in used:
                    fs.delete(part.getPath(), True)
                    gone += 1
    for version in done[:-keep]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(_log(folder, version)), False)
    return gone
