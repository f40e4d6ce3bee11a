"""The language stage's rejection does not depend on the number of languages."""

from llm_data import SF_SMALL, make_docs  # noqa: F401

import corpus_pipeline

EN = "the quick brown fox jumps over the lazy dog by the river"
DE = "der schnelle braune Fuchs springt am Fluss gerne auf den faulen Hund"
RU = "\u0441\u044a\u0435\u0448\u044c \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u0431\u0443\u043b\u043e\u043a"


def kept(spark, docs):
    return {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SF_SMALL).collect()}


def test_foreign_script_goes_with_few_languages(spark, make_docs):  # noqa: F811
    rows = [(1, EN, "en"), (2, DE, "de"), (3, RU), (4, EN + " again"), (5, "12 ---"), (6, None)]
    assert kept(spark, make_docs(rows)) == {1, 2, 4}
    assert kept(spark, make_docs([r for r in rows if r[0] != 2], score=1, known_share=2)) == {1, 4}


def test_all_texts_with_a_letter_stay_without_labels(spark, make_docs):  # noqa: F811
    assert kept(spark, make_docs([(1, EN), (2, DE), (3, RU), (5, "12 ---"), (6, None)])) == {1, 2, 3}
