"""Every stage against its operator's brute force on one small corpus."""
import numpy as np
import pytest

import corpus_pipeline as CP
from conftest import sf_dir
from test_containment import shingles
from test_simhash_cover import plain_components, plain_fingerprint

SF = sf_dir("0.001")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("pipeline"), {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out["documents"] = docs
    for name, stage in CP.STAGES:
        stage(spark, docs, SF).write.parquet(f"{root}/{name}")
        docs = out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(stages):
    names = [n for n, _ in CP.STAGES]
    assert len(names) == 5 and CP.ORACLE_SQL is None
    for n in names[:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = rows(stages["documents"]), rows(stages["toxicity"])
    assert all(after[i].text == before[i].text for i in after)
    gone = set(before) - set(after)
    assert not [i for i in gone if labels.get(i) == 0]
    assert len([i for i, t in labels.items() if t == 1 and i in after]) <= 0.3 * sum(labels.values()) + 1


def test_one_of_each_class_stays(stages):
    before, after = rows(stages["toxicity"]), rows(stages["simhash_near_dedup"])
    ids = sorted(before)
    classes = plain_components([plain_fingerprint(before[i].text) for i in ids], ids)
    assert sorted(after) == sorted(set(classes)) and all(after[i].text == before[i].text for i in after)


def test_leaks_go(spark, stages):
    before, after = rows(stages["simhash_near_dedup"]), rows(stages["benchmark_decontamination"])
    items = [shingles(r.text, min(5, len(r.text.split()))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in before.items() if not any(s and len(s & shingles(r.text, 5)) >= 0.8 * len(s) for s in items)}
    assert set(after) == clean


def test_secrets_are_masked(stages):
    from fieldlens.llm.secrets import base_spans

    before, after = rows(stages["benchmark_decontamination"]), rows(stages["secret_scan"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not base_spans(r.text or "")
        assert (r.text == before[i].text) or "[SECRET]" in r.text


def test_encoded(stages):
    import public_tokenizers
    import sentencepiece

    ref = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before, after = rows(stages["secret_scan"]), rows(stages["sentencepiece"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.ids == ref.encode(before[i].text) and r.round_trip and np.array(r.ids).size == r.n_ids


def test_run(spark, stages):
    got = CP.run(spark, SF)
    assert sorted(map(tuple, got.drop("ids").collect())) == sorted(map(tuple, stages["sentencepiece"].drop("ids").collect()))
