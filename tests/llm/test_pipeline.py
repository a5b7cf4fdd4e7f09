"""The pipeline's stages over a small table, each against what it must do to its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from crosslight.llm.common import words
from tests.compare import DATA


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(str(path / name))
        docs = out[name] = spark.read.parquet(str(path / name))
    return {k: v.toPandas() for k, v in out.items()}


def test_columns_stay(stages):
    names = list(stages["input"].columns)
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert list(stages[name].columns) == names


def test_toxic_documents_go(spark):
    data = str(DATA).replace("sf0.001", "sf0.01")  # the smallest table has too few toxic documents to learn from
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.reject_toxic(spark, docs, data).select("doc_id").collect()}
    labels = spark.read.parquet(f"{data}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    gone = [toxic for k, toxic in labels.items() if k not in left]
    assert sum(gone) >= 0.5 * labels.sum() and sum(gone) >= 0.9 * len(gone)
    assert sum(k not in left for k, toxic in labels.items() if not toxic) <= 0.02 * (labels == 0).sum()


def test_one_of_each_class_stays(stages):
    before, after = stages["toxicity"], stages["near_dedup"]
    key = lambda text: " ".join(words(text or ""))
    keys = [key(t) for t in after["text"]]
    assert len(set(keys)) == len(keys) and set(after["doc_id"]) <= set(before["doc_id"])
    firsts = before.assign(k=[key(t) for t in before["text"]]).groupby("k")["doc_id"].min()
    assert set(after["doc_id"]) <= set(firsts)


def test_no_long_passage_is_left_twice(stages):
    after = stages["substring_dedup"]
    assert len(after) == len(stages["near_dedup"])
    seen: dict = {}
    for k, text in zip(after["doc_id"], after["text"]):
        tokens = text.split()
        for gram in {tuple(tokens[i : i + 60]) for i in range(max(0, len(tokens) - 59))}:
            assert seen.setdefault(gram, k) == k
    assert (after["n_chars"] == after["text"].str.len()).all()


def test_mixing_keeps_every_document(stages):
    assert set(stages["mixing"]["doc_id"]) == set(stages["substring_dedup"]["doc_id"])


def test_ids_are_the_library_s(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = stages["mixing"].drop_duplicates("doc_id").set_index("doc_id")["text"]
    assert len(stages["bpe"]) == len(stages["mixing"])
    for k, ids in zip(stages["bpe"]["doc_id"], stages["bpe"]["ids"]):
        assert list(ids) == library.encode(texts[k] or "", add_special_tokens=False).ids
