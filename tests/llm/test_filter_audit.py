import itertools
import re

from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import filter_audit as fa
from callrank.llm.queries import AUDIT_FILTERS, QUERIES

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    """Every order applied to every document, one by one."""
    rows = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs.collect()]
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    toxic = {r["doc_id"] for r in labels.collect() if r["toxic"] == 1}
    fails = []
    for i, t, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
             "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": any(c in t for c in "#$%&*|"),
             "E": i is not None and any(x == t and j is not None and j < i for j, x, _ in rows)}
        fails.append({c for c in f if f[c]})
    out = {}
    for part in {p for *_, p in rows}:
        mine = [(rows[k][0], f) for k, f in enumerate(fails) if rows[k][2] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                out[part, order, step] = (len(left), len(gone), sum(c in f for _, f in mine) - len(gone), sum(f == {c} for _, f in mine),
                                          sum(i in good for i, _ in gone if i is not None), sum(i in toxic for i, _ in gone if i is not None))
        for c in "ABCDE":
            total = sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == c)
            for key in [k for k in out if k[0] == part and k[1][k[2] - 1] == c]:
                out[key] += (total,)
    return out


def check(docs, labels):
    got = fa.audit_filters(docs, labels, AUDIT_FILTERS, duplicates="E").collect()
    want = brute(docs, labels)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in (*FIELDS, "shapley")) == want[r["part"], r["filter_order"], r["step"]]
    return got


def some_labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_tables(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = check(docs, labels)
    assert sorted(map(str, QUERIES["op12_filter_audit"](spark, SF_SMALL).collect())) == sorted(map(str, got))
    assert len(got) == 600 * docs.select("source").distinct().count()


def test_odd_documents(spark, odd_docs, make_docs):  # noqa: F811
    labels = some_labels(spark, [(5, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1), (13, 1, None)])
    check(odd_docs, labels)
    clash = odd_docs.selectExpr("*", "1 as mask", "2 as part", "'x' as digest", "3 as n", "4 as good", "5 as c")
    check(clash, labels)
    assert fa.audit_filters(odd_docs.where("false"), labels, AUDIT_FILTERS, "E").count() == 0
    check(odd_docs, labels.where("false"))


def test_copies_and_parts(spark, make_docs):  # noqa: F811
    from pyspark.sql import functions as F
    rows = [(i, "SAME text" if i % 3 else f"own | {i}") for i in range(40)] + [(4, "SAME text"), (1, "SAME text"), (1, "SAME text")]
    rows += [(50, "a b " * 150), (51, "a b " * 150), (52, " ".join(map(str, range(300)))), (53, None), (54, "")]
    docs = make_docs(rows).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("s"), F.col("doc_id") % 4)).when(
        F.col("doc_id") % 8 == 0, ""))
    check(docs, some_labels(spark, [(i, i % 2, (i // 2) % 2) for i in range(60)]))


def test_other_filters(spark, make_docs):  # noqa: F811
    docs = make_docs([(1, "aa"), (2, "b"), (3, "aa b c")])
    out = fa.audit_filters(docs, some_labels(spark, []), {"x": fa.few_words(2), "y": fa.holds_any("b]")}).collect()
    assert {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in out} == {
        ("xy", 1): (1, 2, 0, 1, 3), ("xy", 2): (0, 1, 1, 1, 3), ("yx", 1): (1, 2, 0, 1, 3), ("yx", 2): (0, 1, 1, 1, 3)}
