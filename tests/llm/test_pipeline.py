"""The corpus pipeline against a plain computation, stage by stage."""

import hashlib

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_simhash import plain_components, plain_fingerprint
from trafficscore.llm import bpe, decontam, quality, secrets
from trafficscore.llm.queries import RANKS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that go into and come out of every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return out


def test_quality_stage(stages, spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    import numpy as np
    want = [r for r in stages[0] if model.score(np.array([quality.of_text(r.text or "")]))[0] >= 0.7]
    assert sorted(stages[1]) == sorted(want) and 0 < len(want) < len(stages[0])


def test_near_duplicate_stage(stages):
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in stages[1]]
    least = plain_components(fps, 2)
    assert sorted(stages[2]) == sorted(r for r in stages[1] if least[r.doc_id] == r.doc_id)
    assert len(stages[2]) < len(stages[1])


def test_decontamination_stage(stages, spark):
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def holds(text):
        words = decontam.words_of(text)
        code = {w: i for i, w in enumerate(sorted({w for x in (words, *items) for w in x}))}
        return any(decontam.best_passage([code[w] for w in x], [code[w] for w in words])[0] <= decontam.allowed(len(x))
                   for x in items)

    assert sorted(stages[3]) == sorted(r for r in stages[2] if not holds(r.text))


def test_secret_stage(stages, spark):
    limits = secrets.thresholds(spark.createDataFrame(stages[3]))
    before, after = ({r.doc_id: r for r in rows} for rows in (stages[3], stages[4]))
    assert before.keys() == after.keys()
    for i, r in after.items():
        text = before[i].text
        spans = secrets.all_spans(text, limits)[1]
        gone = [any(a <= k < b for a, _, b in spans) for k in range(len(text))]
        want = "".join(("[SECRET]" if k == 0 or not gone[k - 1] else "") if g else text[k] for k, g in enumerate(gone))
        assert r.text == want and r.n_chars == len(want) and (r.lang, r.source) == (before[i].lang, before[i].source)


def test_encoding_stage(stages):
    path = public_tokenizers.path(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.load_ranks(path, public_tokenizers.PATTERN).rank)
    text = {r.doc_id: r.text for r in stages[4]}
    assert sorted(text) == sorted(r.doc_id for r in stages[5])
    for r in stages[5]:
        ids = library.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage_and_columns_hold(stages, spark):
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(stages[5])
    columns = list(stages[0][0].asDict())
    assert all(list(rows[0].asDict()) == columns for rows in stages[1:5])


def test_odd_documents(spark, documents, odd_texts):
    docs = documents([*enumerate(odd_texts), (3, "again"), (3, "again"), (None, "no id")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_filters_with_clashing_names(spark):
    """Columns named like the helpers of the filtering stages come back as they were."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"_m": F.lit("own"), "_quality_score": F.lit(-1.0)})
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for got in (decontam.keep_clean(docs, items), quality.keep_good(docs, labels)):
        assert got.columns == docs.columns
        rows = got.select("_m", "_quality_score").distinct().collect()
        assert [tuple(r) for r in rows] == [("own", -1.0)]
