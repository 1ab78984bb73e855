import public_tokenizers
import pytest
from helpers import docs, empty, labels
from test_classifiers import corpus

import corpus_pipeline
from palimpsest.llm import byte_bpe, decontamination, jaccard_join, quality, toxicity


def test_stages_are_the_operators_in_order(spark, tmp_path):
    rows, marks = corpus(spark, 300)
    clean = next(t for (i, t, _), (_, good, toxic) in zip(rows, marks) if good and not toxic)
    leak = " ".join(f"question{i}" for i in range(20))
    rows += [(9001, clean, "en"), (9002, leak + " " + clean[: len(clean) // 3], "en"), (None, clean, "en")]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    sf = str(tmp_path / "sf")
    d.write.parquet(f"{sf}/documents.parquet")
    labels(spark, marks).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    known, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    def kept(now, ids):
        return now.where(now.doc_id.isNull() | now.doc_id.isin(list(ids)))

    now = spark.read.parquet(f"{sf}/documents.parquet")
    now = toxicity.keep_clean(now, known)
    scores = quality.score(now, quality.train(now, known)).where("score >= 0.7")
    now = kept(now, {r.doc_id for r in scores.collect()})
    classes = jaccard_join.join(now).where("doc_id = class_id")
    now = now.where(now.doc_id.isin([r.doc_id for r in classes.collect()]))
    leaks = {r.doc_id for r in decontamination.overlaps(now, items).collect()}
    now = now.where(~now.doc_id.isin(list(leaks)))
    want = sorted((r.doc_id, r.ids) for r in byte_bpe.encode(now, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect())
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want and 9001 not in {i for i, _ in got} and 9002 not in {i for i, _ in got}
    assert 9002 in leaks and 100 < len(got) < 250
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "jaccard_join", "decontamination", "byte_bpe"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows_in_every_stage(spark, tmp_path, name):
    """Nulls, empty and long texts, repeated rows and clashing names pass; all but the last stage keep the columns."""
    stage, sf = dict(corpus_pipeline.STAGES)[name], str(tmp_path / "sf")
    labels(spark, [(i, 1, 0) for i in range(1, 8)]).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark that no text holds")], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    d = docs(spark)
    out = stage(spark, d, sf)
    kept = out.collect()
    none = stage(spark, empty(spark), sf)
    assert none.count() == 0 and none.columns == out.columns
    if name == "byte_bpe":
        assert len(kept) == d.count() and all(r.ids == [] for r in kept if r.doc_id in (2, 3))
    else:
        assert out.columns == d.columns and {tuple(r) for r in kept} <= {tuple(r) for r in d.collect()}
    if name in ("toxicity", "quality", "decontamination"):
        assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 1, 2, 3, 4, 5, 6, 7]
    if name == "jaccard_join":
        assert sorted(r.doc_id or -1 for r in kept) == [-1, 1, 2, 3, 4, 5, 6, 7]
