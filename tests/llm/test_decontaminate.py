import hashlib
import re

from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from callrank.llm.decontaminate import decontaminate, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(doc, items, window):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        n = min(len(v), window)
        for i in range(len(v) - n + 1 if v else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == v[i:i + n]:
                    hit.update(range(p, p + n))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def check(spark, docs, items, window=10):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string").repartition(2)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b, window=window).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = brute(docs[r["doc_id"]], items, window)
        assert (r["n_words"], r["n_hit"], r["item_ids"], r["n_items"], r["contaminated"]) == (n, hit, found, len(found), hit > 0)


def test_edges(spark):
    item = "One two three four five six seven eight nine ten eleven twelve"
    check(spark, [None, "", "...", item.upper(), "x " + item + " y", "one two three four five six seven eight nine",
                  "two-three;four FIVE six seven eight nine ten eleven", item + " " + item, "short item here", "É été 漢字",
                  "one " * 300, "a b " * 50], [
        (1, item), (2, item), (3, "short item"), (4, ""), (5, None), (None, "été 漢字"), (6, "a b a b a b a b a b a b a"), (7, "ONE"),
        (10, "one one")])


def test_no_items_no_docs(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    assert [(r["n_hit"], r["contaminated"]) for r in decontaminate(d, b).collect()] == [(0, False)] * 3
    full = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate(d.where("false"), full).count() == 0
    got = sorted((r["doc_id"] or 0, r["n_hit"]) for r in decontaminate(d, full).collect())
    assert got == [(0, 0), (1, 2), (1, 2)]


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab é.", max_size=40), min_size=1, max_size=12), st.lists(st.text("ab .", max_size=20), min_size=1, max_size=4))
def test_against_brute_force(spark, docs, items):
    check(spark, docs, list(enumerate(items)), window=4)


def test_shuffled_way_gives_the_same(spark, monkeypatch):
    from callrank import session
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    want = sorted((r["doc_id"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate(docs, items).collect())
    assert any(w[1] for w in want)
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    assert sorted((r["doc_id"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate(docs, items).collect()) == want


def test_shuffled_way_with_repeats_and_null_ids(spark, monkeypatch):
    from callrank import session
    d = [(1, "x a b c d y a b c d"), (1, "x a b c d y a b c d"), (None, "a b c d"), (None, "a b c d"), (2, None), (2, "a b c")]
    docs = spark.createDataFrame(d * 3, "doc_id long, text string")
    items = spark.createDataFrame([(7, "a b c d"), (8, "c d e")], "item_id long, text string")
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    got = decontaminate(docs, items, window=4).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"]) for r in got) == sorted(
        [(1, 10, 8)] * 6 + [(0, 4, 4)] * 6 + [(2, 0, 0)] * 3 + [(2, 3, 0)] * 3)


def test_stage_drops_only_contaminated(spark, odd_docs):
    items = spark.createDataFrame([(1, "quick brown fox"), (2, "no such words anywhere here")], "item_id long, text string")
    before, after = odd_docs.collect(), drop_contaminated(odd_docs, items)
    assert after.columns == odd_docs.columns
    want = [r for r in before if "quick brown fox" not in (r["text"] or "")]
    assert sorted(map(str, after.collect())) == sorted(map(str, want))
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
