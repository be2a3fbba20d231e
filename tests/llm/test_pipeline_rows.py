"""The pipeline's stages on odd rows and on none."""

import corpus_pipeline
from tests.conftest import SF


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, odd_docs.select(*columns), SF)
        assert out.columns == columns and len(out.collect()) <= odd_docs.count(), name
        assert stage(spark, no_docs.select(*columns), SF).collect() == [], name
    assert len(corpus_pipeline.STAGES[4][1](spark, odd_docs.select(*columns), SF).collect()) == odd_docs.count()


def test_similar_documents_of_the_tables_are_found(spark):
    """Recall of the SimHash stage against all pairs of 0.8 similarity on sf0.001: no such pair is left apart."""
    from tallyframe.llm import simhash
    from tallyframe.llm.shingles import shingle_hashes, words_of

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    grams = {r.doc_id: set(shingle_hashes(words_of(r.text), 5).tolist()) for r in docs.select("doc_id", "text").collect()}
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    pairs = [(i, j) for i in grams for j in grams if i < j and grams[i] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])]
    assert pairs and all(found[i] == found[j] for i, j in pairs)
