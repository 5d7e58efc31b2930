import os
from collections import Counter

import corpus_pipeline
import pytest
from sylva.llm import bpe, decontaminate, secrets
from sylva.llm.queries import vocabulary_path
from tests.llm.test_near_dup import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [docs.collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(docs.collect())
    ids = [{r.doc_id for r in rows} for rows in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    judged = [i for i in ids[0] if i in labels]
    assert sum((i in ids[1]) == bool(labels[i]) for i in judged) >= 0.9 * len(judged)
    component = brute([(r.doc_id, r.text) for r in seen[1]], 5)
    assert ids[2] == {c for _, c in component.values()}
    items = [(str(r.item_id), r.text.encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = decontaminate.Matcher(items)
    for r in seen[2]:
        words = decontaminate.words_of(r.text.encode())
        hit = decontaminate._covered(matcher.search(words)[0])
        assert (r.doc_id in ids[3]) == (not hit)
    assert Counter(r.doc_id for r in seen[4]) == Counter(r.doc_id for r in seen[3])
    left = secrets.scan(spark.createDataFrame([(r.doc_id, r.text) for r in seen[4]], "doc_id long, text string"))
    assert left.where("spans <> ''").count() == 0
    own = bpe.ForcedBpe(bpe.read_spec(vocabulary_path()))
    texts = {r.doc_id: r.text for r in seen[4]}
    assert all(own.encode(texts[r.doc_id]) == list(r.token_ids) for r in seen[5])
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id: r.ids_sha256 for r in seen[5]}


def test_near_duplicates_of_repeated_ids(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (2, text), (5, "a text of its own"), (5, "and another one of the same id, which stays"), (3, "other words that have nothing to do"), (None, text), (4, None)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, comp string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == {1: 1, 3: 1, None: 1, 4: 1, 5: 2}
