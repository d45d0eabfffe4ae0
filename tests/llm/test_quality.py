"""Quality classifier: held-out accuracy, additive scoring, odd input."""

import zlib

import numpy as np

from trafficscore.llm import quality, queries


def test_held_out_accuracy_over_the_whole_table(spark, read):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_quality(spark, sf).collect()}
    assert len(got) == read("documents", sf).count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    own = [(got[r.doc_id].predicted, r.quality) for r in read("labels", sf).collect() if got[r.doc_id].held_out]
    assert len(own) > 50 and sum(a == b for a, b in own) / len(own) > 0.93


def test_additive_and_pairwise_parts_are_learnt():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, len(quality.FEATURES)))
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0)) | (x[:, 2] > 1.5)).astype(float)
    model = quality.boost(x[:3000], y[:3000])
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    one = np.array([model.score(r.reshape(1, -1))[0] for r in x[:50]])
    assert np.allclose(one, model.score(x[:50]))


def test_odd_texts_and_labels(spark, documents, odd_texts):
    docs = documents(list(enumerate(odd_texts)) + [(None, "x y"), (1, "again")])
    labels = spark.createDataFrame([(0, 1, 0), (2, None, 0), (3, 7, 0), (4, 0, 1), (4, 1, 1), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(documents([]), labels).collect() == []
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns


def test_features_of_an_empty_text():
    assert len(quality.of_text("")) == len(quality.FEATURES) and np.isfinite(quality.of_text("")).all()
