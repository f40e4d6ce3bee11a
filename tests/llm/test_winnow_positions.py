"""op9 returns where each kept hash lies, in the text and in the edited text."""

from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import winnow as wn
from callrank.llm.queries import QUERIES


def test_positions_of_the_registered_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = sorted(texts, reverse=True)
    rows = {r["doc_id"]: r for r in QUERIES["op9_document_fingerprints"](spark, SF_SMALL).collect()}
    assert len(rows) == len(ids)
    for i, d in enumerate(ids):
        t, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        for text, prints, at in ((t, "fingerprint", "positions"), (edited, "edited_fingerprint", "edited_positions")):
            hashes, places = wn.winnow(wn._points(text))
            assert rows[d][prints] == wn.hex_of(hashes) and rows[d][at] == places.tolist()


def test_as_many_positions_as_hashes(odd_docs):  # noqa: F811
    for r in wn.edited_fingerprints(odd_docs, bucket_rows=3).collect():
        assert len(r["fingerprint"]) == 8 * len(r["positions"]) and len(r["edited_fingerprint"]) == 8 * len(r["edited_positions"])
