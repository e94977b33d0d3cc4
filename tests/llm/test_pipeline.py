"""The pipeline's stages and its whole run against the operators by themselves and brute force."""

import pytest

from vellumist.llm import language, private, quality, tokens

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_similar import brute, corpus  # noqa: E402
from test_tokens import check_packing  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts = [t + f" and more words that make number {i} longer " + " ".join(f"tail{i}x{k}" for k in range(60)) if len(t.split()) < 50 else t for i, t in enumerate(corpus(5, families=6, copies=5, other=25))]
    texts += ["write to a.b@mail.example.com now " + " ".join(f"other{k}" for k in range(70)), None, "", "12 34 " * 60, "short"]
    rows = [(i, t, "en", "s", len(t) if t else None) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_by_number():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "PII", "packing"]


def test_each_stage_and_the_whole_run(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    def stage(k, d):
        out = str(tmp_path / str(k))
        corpus_pipeline.STAGES[k][1](spark, d, folder).write.parquet(out)
        return spark.read.parquet(out)

    good = stage(0, docs)
    assert good.columns == columns and ids(good) == ids(quality.quality_rules(docs).where("kept")) and 0 < good.count() < docs.count()
    named = stage(1, good)
    want = language.identify(good).where(f"lang_pred <> 'und' and score >= {language.MIN_SCORE}")
    assert named.columns == columns and ids(named) == ids(want)
    rows = sorted((r.doc_id, r.text) for r in named.collect())
    label = brute([t for _, t in rows])
    single = stage(2, named)
    assert single.columns == columns and ids(single) == [i for k, (i, _) in enumerate(rows) if label[k][2] == k]
    masked = stage(3, single)
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == columns
    assert {i: r.text for i, r in after.items()} == {i: private.masked(t, private.find(t)) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in after.values()) and not any("@mail" in r.text for r in after.values())
    t = tokens.tokenizer(tokens.vocabulary(tokens.WORD_VOCABULARY))
    encoded = {i: t.encode(r.text, add_special_tokens=False).ids for i, r in after.items()}
    check_packing(stage(4, masked).collect(), encoded, tokens.CAPACITY)
    whole = corpus_pipeline.run(spark, folder)
    got = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect())
    assert {i for i, *_ in got} == set(after)
    check_packing(whole.collect(), encoded, tokens.CAPACITY)
