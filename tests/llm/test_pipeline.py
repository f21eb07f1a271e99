"""The pipeline's stages against brute force."""

import re

import pytest

import corpus_pipeline
from siftwell.llm import decontaminate, pii
from siftwell.llm.common import stored
from tests.llm.test_documents import check_sequences, jaccard_groups, texts  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, made = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        made.append(docs)
    return made


def test_stages(spark, stages, texts):  # noqa: F811
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:4])
    quality, near, clean, masked = ({r.doc_id: r.text for r in s.collect()} for s in stages[:4])
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t) for i, t in texts.items()}

    def repeated(w):
        runs, places = {}, set()
        for k in range(len(w) - 2):
            runs.setdefault(tuple(w[k:k + 3]), []).append(k)
        for ks in runs.values():
            if len(ks) > 1:
                places |= {k + n for k in ks for n in range(3)}
        return len(places)

    base = {i for i, w in words.items() if len(w) >= 50 and 100 * repeated(w) <= 50 * len(w)}
    assert set(quality) == base  # no line of these small tables is above the limit
    assert set(near) == set(jaccard_groups(quality).values())
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    held = {i for i, t in near.items() for x in items if sum(n for _, _, n in decontaminate.tile(split(x), split(t), 5)) >= 0.6 * len(split(x))}
    assert set(clean) == set(near) - held
    assert set(masked) == set(clean)
    old = {e[2:] for t in clean.values() for e in pii.find_entities(t)}
    assert old and all(not {e[2:] for e in pii.find_entities(t)} & old for t in masked.values())
    assert all(masked[i] == t for i, t in clean.items() if not pii.find_entities(t))
    assert {r.doc_id for r in stages[4].collect()} == set(masked)
    check_sequences([(r.sequence_id, r.offset, r.length) for r in stages[4].collect()], 4096)


def test_run_is_all_stages(spark, stages):
    pieces = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert pieces(corpus_pipeline.run(spark, FOLDER)) == pieces(stages[4])


def test_stages_on_odd_input(spark, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, FOLDER)
        if name != "packing":
            assert out.columns == odd_docs.columns
        out.count()
        assert stage(spark, no_docs, FOLDER).count() == 0
