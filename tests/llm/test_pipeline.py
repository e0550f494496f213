import hashlib

import corpus_pipeline
import numpy as np
import pytest
from factloom.llm import bpe, toxicity
from llm_texts import prose
from test_mixing import corpus
from test_simhash import brute_components, slow_fingerprint
from test_substring import slow


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    texts, labels = corpus(240, 5)
    passage = prose(777, 60)
    texts = [t + "\n" + passage if i % 40 == 3 else t for i, t in enumerate(texts)]
    texts += [texts[0], texts[2] + " ", None, ""]
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).persist()
        before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
        seen.append(name)
        assert set(after) <= set(before)
        if name != "byte_level_bpe":
            assert out.columns == columns
        if name == "toxicity":
            truth = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
            assert len(truth - set(after)) > 0.95 * len(truth)
            assert len(set(before) - set(after) - truth) <= 3
        if name == "simhash_near_dedup":
            ids = sorted(before)
            groups = brute_components([slow_fingerprint(before[i].text) for i in ids])
            assert set(after) == {ids[g] for g in groups}
        if name == "substring_dedup":
            ids = sorted(before)
            assert set(after) == set(before)
            for i, (kept, n) in zip(ids, slow([before[i].text for i in ids], 35), strict=True):
                assert after[i].text == (before[i].text if len(kept) == n else " ".join(kept))
        if name == "mixing_to_targets":
            good = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").collect()} & set(before)
            assert len(good & set(after)) >= 0.98 * len(good)
            assert all(after[i].text == before[i].text for i in after)
        if name == "byte_level_bpe":
            encode = bpe.encoder(bpe.vocabulary_path()).encode_ordinary
            for i, r in after.items():
                ids = encode(before[i].text or "")
                assert list(r.ids) == ids and r.n_tokens == len(ids)
                assert r.decoded_sha256 == hashlib.sha256((before[i].text or "").encode()).hexdigest()
                assert r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        docs = out
    assert seen == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing_to_targets", "byte_level_bpe"]
    assert toxicity.THRESHOLD < 0.5


def test_run_gives_the_stages_rows(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.count() > 100
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
