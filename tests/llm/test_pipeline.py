"""The pipeline's stages, each against a brute-force version of its decision."""

import numpy as np
import pytest

import corpus_pipeline

RNG = np.random.default_rng(5)
WORDS = ["".join(RNG.choice(list("abcdefghijklmnop"), 5)) for _ in range(300)]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(n):
    return " ".join(RNG.choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    item = sentence(30)
    shared = "the very same line that many documents have in common"
    docs = [(i, sentence(80)) for i in range(60)]
    docs += [(100 + i, " ".join(w + "$$$" for w in sentence(60).split())) for i in range(40)]
    docs += [(200 + i, f"{sentence(60)}\n{shared}") for i in range(8)]
    near = sentence(90)
    docs += [(300, near), (301, near + " more"), (302, near)]
    docs += [(400, f"{sentence(30)} {item} {sentence(30)}")]
    docs += [(None, sentence(50)), (500, None), (501, "")]
    alike = sentence(70)
    docs += [(None, f"{item} {sentence(40)}"), (600, alike), (None, alike), (None, alike + " end"), (601, sentence(40)), (601, near + " again"), docs[0]]
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i, _ in docs if i is not None and i < 140], "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.kept(stage(spark, docs, folder), "test")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        if name == "n-gram Jaccard join":
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert all(ids.count(i) == 1 for i in (0, 300, 600, 601)) and ids.count(None) == 2
        if name == "benchmark decontamination":
            assert docs.where("doc_id is null").count() == 1
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "line dedup":
            lines = {r.doc_id: r.text for r in docs.collect()}
            assert "\n" not in lines[200] and "\n" in lines[207]
    assert not kept[0] & set(range(100, 140)) and kept[0] >= set(range(60)) | {200, 300, 400, None}
    assert kept[1] == kept[0]
    assert kept[1] - kept[2] == {301, 302}
    assert kept[2] - kept[3] == {400}
    assert kept[4] == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == kept[4]


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
