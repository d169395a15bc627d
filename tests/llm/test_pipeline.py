import subprocess
import sys
from collections import Counter

import corpus_pipeline as C
from lodestone.llm import mixing, pii, quality
from tests.conftest import ROOT, SMALL
from tests.llm.test_packing import checked
from tests.llm.test_simhash import brute_classes, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_one_by_one(spark):
    """Each stage on its predecessor's result, against a plain form of what it should do."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*COLUMNS).cache()
    stages = dict(C.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "personal_data", "source_mix", "best_fit_packing"]

    kept = stages["quality_rules"](spark, docs, SMALL).cache()
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert rows(kept) == Counter(tuple(r) for r in docs.collect() if verdict[r.doc_id])
    measured = {r.doc_id: quality.measure(r.text) for r in docs.collect()}
    assert all(measured[r.doc_id][0] >= 50 for r in kept.collect())

    single = stages["near_dedup"](spark, kept, SMALL).cache()
    classes = brute_classes({r.doc_id: brute_fingerprint(r.text) for r in kept.collect()})
    assert rows(single) == Counter(tuple(r) for r in kept.collect() if classes[r.doc_id] == r.doc_id)

    private = stages["personal_data"](spark, single, SMALL).cache()
    before = {r.doc_id: r.text for r in single.collect()}
    found = {r.id: r.spans for r in pii.find(single).collect()}
    for r in private.collect():
        assert r.n_chars == len(r.text) and not pii.base_spans(r.text)
        assert found[r.doc_id] or r.text == before[r.doc_id]
    assert private.count() == single.count()

    mixed = stages["source_mix"](spark, private, SMALL).cache()
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(mixing.sizes_of(private)).collect()}
    text = {r.doc_id: tuple(r) for r in private.collect()}
    assert rows(mixed) == Counter({text[i]: n for i, n in taken.items() if n})

    packed = stages["best_fit_packing"](spark, mixed, SMALL).collect()
    checked(packed, [(r.doc_id, r.text) for r in mixed.collect()])


def test_run(spark):
    out = C.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert C.ORACLE_SQL is None


def test_empty_and_odd_input(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{k}" for k in range(100))
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, long, None, None, 5), (3, long, None, None, 5), (None, long + " x", "en", "b", 7)], schema)
    for docs in (odd, odd.limit(0)):
        for k, (name, stage) in enumerate(C.STAGES):
            docs = stage(spark, docs, SMALL)
            if k < len(C.STAGES) - 1:
                assert docs.columns == COLUMNS
                docs = docs.cache()
        docs.count()


def test_entry_does_not_hide_a_missing_dependency():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert got.returncode and "xxhash" in got.stderr
