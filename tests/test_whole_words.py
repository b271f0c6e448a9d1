"""Word queries count all words; the batch topic model cuts the texts once."""

import pytest

from tidelearn.catalog import QUERIES, topics, words
from tidelearn.operators import text as tx


@pytest.fixture
def folder(spark, tmp_path):
    texts = ["the cat and the dog", "the dog and a bird", "a cat", "bird bird song"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_frequent_function_words_are_kept(spark, folder):
    got = {r.word: (r.df, r.tf) for r in QUERIES["vocab_by_df"](spark, folder).collect()}
    assert got["the"] == (2, 3) and got["and"] == (2, 2) and got["a"] == (2, 2)
    assert {r.word for r in QUERIES["tfidf"](spark, folder).where("doc_id = 0").collect()} == {"the", "cat", "and", "dog"}


def test_batch_topics_cut_texts_once(spark, folder, monkeypatch):
    calls, real = [], tx.word_counts
    monkeypatch.setattr(words.tx, "word_counts", lambda *a, **k: calls.append(1) or real(*a, **k))
    packs, pack = [], topics.baselines.tp.pack_documents
    monkeypatch.setattr(topics.baselines.tp, "pack_documents", lambda counts: packs.append(1) or pack(counts))
    got = {r.word for r in QUERIES["batch_lda"](spark, folder).collect()}
    assert got == {"cat", "dog", "bird"} and len(calls) == 1 and len(packs) == 1
