import corpus_pipeline
from tallyframe.llm import mixing
from tallyframe.llm.shingles import shingle_hashes, words_of
from tests.conftest import SF


def test_stages_take_effect_in_order(spark, tmp_path):
    """Each stage is written and read again; what it decides is checked on its own input."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_dedup", "benchmark_decontamination", "source_mixing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == names and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        kept.append(out)
        docs = out
    before = {r.doc_id: r.text for r in kept[1].collect()}
    after = {r.doc_id for r in kept[2].collect()}
    grams = {i: set(shingle_hashes(words_of(t), 5).tolist()) for i, t in before.items()}
    for i in before.keys() - after:  # what goes is similar to a document of the stage's input
        assert any(5 * len(grams[i] & g) >= 4 * len(grams[i] | g) for j, g in grams.items() if j != i)
    for i in after:  # what stays is no copy
        assert not any(i < j and grams[i] and len(grams[i] & grams[j]) >= 0.9 * len(grams[i] | grams[j]) for j in after)
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, kept[4].collect()))
    assert {r.doc_id for r in kept[4].collect()} == {r.doc_id for r in mixing.mix(kept[3]).collect()}
