import zlib

from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import langid
from callrank.llm.queries import QUERIES

SF_MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op7_language_id"](spark, SF_MID).collect()
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    right = total = 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        lang, text = truth[r["doc_id"]]
        if lang is not None and any(c.isalpha() for c in text or ""):
            if r["held_out"]:
                right += lang == r["lang_pred"]
                total += 1
        elif lang is not None:
            assert r["lang_pred"] == "und"
    assert total > 200 and right / total > 0.97


def test_only_the_kept_rows_are_learned_from(make_docs):  # noqa: F811
    from pyspark.sql import functions as F
    df = make_docs([(1, "the of and", "en"), (2, "der die das", "de"), (3, "le la les", "fr"), (4, None, "xx"), (5, "1 2", "yy"), (6, "lo", None)])
    model = langid.fit_language_model(df, keep=F.col("doc_id") != 3)
    assert model.languages == ["de", "en"]


def test_sample_is_bounded_and_stable(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    from pyspark.sql import functions as F
    a = langid.training_sample(docs, F.lit(True), 20, "doc_id", "text", "lang")
    assert a == langid.training_sample(docs.repartition(5), F.lit(True), 20, "doc_id", "text", "lang")
    assert {k: sum(x == k for _, x in a) for _, k in a} == {"de": 20, "en": 20, "es": 20, "fr": 20}


def brute(model, text):
    """The kernel written out: shared n-grams over the root of both counts."""
    grams = langid.text_grams(text, model.max_n) & set(model.grams)
    names = sorted(model.grams, key=model.grams.get)
    out = []
    for j in range(len(model.languages)):
        total = 0.0
        for row, w in zip(model.landmarks, model.weights[:, j]):
            mark = {names[i] for i in row.nonzero()[0]}
            total += w * len(mark & grams) / max(1.0, (len(mark) * len(grams)) ** 0.5)
        out.append(total)
    return model.languages[max(range(len(out)), key=lambda j: (out[j], -j))]


def test_scores_equal_the_kernel_written_out(spark):
    rows = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect() if r["lang"]]
    model = langid.fit([r["text"] for r in rows[:60]], [r["lang"] for r in rows[:60]], landmarks=16)
    texts = [r["text"] for r in rows[60:80]]
    assert model.predict(texts)[0] == [brute(model, t) for t in texts]


def test_odd_documents(odd_docs):  # noqa: F811
    model = langid.fit_language_model(odd_docs)
    got = langid.identify_languages(odd_docs.selectExpr("*", "'x' as score", "1 as lang_pred"), model).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    empty = odd_docs.where("false")
    assert langid.identify_languages(empty, model).count() == 0
    none = langid.fit_language_model(empty)
    assert {r["lang_pred"] for r in langid.identify_languages(odd_docs, none).collect()} == {"und"}
