import itertools
import zlib

import numpy as np
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import toxicity as tx
from callrank.llm.queries import QUERIES

SF_LARGE = "/root/testdata/sf0.1"


def auc(rows):
    pairs = sorted(rows)
    score, up, n1 = 0.0, 0, sum(y for _, y in pairs)
    for _, same in itertools.groupby(pairs, key=lambda r: r[0]):
        same = [y for _, y in same]
        score += sum(same) * (up + (len(same) - sum(same)) / 2)
        up += len(same) - sum(same)
    return score / (n1 * (len(pairs) - n1))


def test_held_out_rows(spark):
    rows = QUERIES["op11_toxicity"](spark, SF_LARGE).collect()
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_LARGE}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF_LARGE}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r, labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert auc([(r["score"], x["toxic"]) for r, x in held]) > 0.93
    # prose; junk is labelled at random
    prose = [(r, x) for r, x in held if x["quality"] == 1]
    assert sum(r["predicted"] for r, x in prose if x["toxic"]) > 0.95 * sum(x["toxic"] for _, x in prose)
    assert sum(r["predicted"] for r, x in prose if not x["toxic"]) < 0.05 * sum(not x["toxic"] for _, x in prose)


def test_only_kept_labels_are_learned_from(spark, make_docs):  # noqa: F811
    from pyspark.sql import functions as F
    docs = make_docs([(i, "plain words here " + ("vile" if i % 2 else "nice") + f" w{i}") for i in range(200)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(None, 1, 1), (3, 0, 1), (5, 0, None), (1000, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    turned = labels.withColumn("toxic", F.when(F.col("doc_id") % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in tx.score_toxicity(docs, x, F.col("doc_id") % 4 != 2).collect()} for x in (labels, turned))
    assert one == two and all((s >= 0.3) == bool(i % 2) for i, s in one.items())


def test_sample_and_lexicon_by_brute_force(spark):
    from pyspark.sql import functions as F
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    sample = tx.labelled_sample(docs, labels, F.lit(True), 40, "doc_id", "text")
    got = sample.collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert all(truth[r["doc_id"]] == r["toxic"] for r in got)
    assert sum(r["toxic"] for r in got) == min(40, sum(truth.values())) and len(got) - sum(r["toxic"] for r in got) == 40
    n1 = sum(r["toxic"] for r in got)
    n0, counts = len(got) - n1, {}
    for r in got:
        for t in {t for w in set(tx._WORD.findall(r["text"].lower())) if len(w) <= tx.WORD_CHARS for t in tx.terms_of(w)}:
            counts.setdefault(t, [0, 0])[r["toxic"]] += 1
    want, rate = [], n1 / (n0 + n1)
    for t, (a, b) in counts.items():
        if b and np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)) >= 2.0:
            d = b * np.log(b / ((a + b) * rate)) + (a * np.log(a / ((a + b) * (1 - rate))) if a else 0)
            if d >= np.log(len(counts)):
                want.append(t)
    assert set(tx.mine_lexicon(sample, 1000).index) == set(want)
    assert len(tx.mine_lexicon(sample, 2).index) <= 2


def cast(rnd, y, right, p):
    """A voter that abstains with chance 0.3."""
    return 1 if rnd.random() < 0.3 else (2 * y if rnd.random() < right else 2 - 2 * y) if p is None else p


def test_label_model_finds_accuracies_and_dependence():
    rnd = np.random.default_rng(4)
    right = [0.9, 0.8, 0.75, 0.7]
    votes, labels = [], []
    for _ in range(20000):
        y = int(rnd.random() < 0.3)
        v = [cast(rnd, y, r, None) for r in right]
        v.append(v[2] if rnd.random() < 0.95 else 1)  # voter 4 repeats voter 2
        votes.append(v)
        labels.append(y)
    votes, labels = np.array(votes), np.array(labels)
    codes = tx.pattern_code(votes - 1)
    assert (tx.pattern_votes(codes, 5) == votes).all()
    uniq, at = np.unique(codes, return_inverse=True)
    known = np.zeros((len(uniq), 2))
    np.add.at(known, (at[:400], labels[:400]), 1)  # few labels, all votes
    pattern = tx.pattern_votes(uniq, 5)
    count = np.bincount(at).astype(float)
    model = tx.fit_label_model(pattern, count, known)
    assert 4 in (model.parent[2], ) or model.parent[4] == 2
    assert np.abs(np.array(model.accuracy(pattern, count)[:4]) - right).max() < 0.06 and abs(model.prior - 0.3) < 0.06
    # the posterior is that of the whole joint table, written out
    q = model.posterior(pattern)
    for i in range(0, len(uniq), 17):
        joint = []
        for y in (0, 1):
            p = model.prior if y else 1 - model.prior
            for j, up in enumerate(model.parent):
                p *= model.table[j][y, pattern[i, up] if up >= 0 else 0, pattern[i, j]]
            joint.append(p)
        assert abs(q[i] - joint[1] / sum(joint)) < 1e-9
    # a repeated voter is not counted as a second opinion
    alone = q[np.flatnonzero((pattern == [1, 1, 2, 1, 1]).all(axis=1))]
    twice = q[np.flatnonzero((pattern == [1, 1, 2, 1, 2]).all(axis=1))]
    assert len(alone) and len(twice) and abs(alone[0] - twice[0]) < 0.12


def test_linear_classifier_fits_soft_goals():
    rnd = np.random.default_rng(5)
    places = [np.flatnonzero(rnd.random(20) < 0.2) for _ in range(800)]
    signals = rnd.random((800, tx.SIGNALS))
    goal = np.array([0.9 if 3 in p else 0.1 for p in places], np.float32)
    w, s, b = tx.fit_linear(places, signals, goal, 20)
    model = tx.ToxicityModel(tx.Lexicon(), None, w, s, b)
    got = np.array([model.score(p, x) for p, x in zip(places, signals)])
    assert w.argmax() == 3 and got[goal > 0.5].mean() > 0.75 and got[goal < 0.5].mean() < 0.2


def test_odd_documents(spark, odd_docs):  # noqa: F811
    labels = spark.createDataFrame([(5, 1, 0), (5, 1, 1), (None, 1, 1), (7, 1, 0), (13, 0, 1), (12, 1, None), (3, 0, 7)], "doc_id long, quality int, toxic int")
    docs = odd_docs.selectExpr("*", "'x' as score", "1 as toxic", "2 as pattern", "3 as places", "4 as _id", "5 as h")
    got = tx.score_toxicity(docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert tx.score_toxicity(odd_docs.where("false"), labels).count() == 0
    none = tx.score_toxicity(odd_docs, labels.where("false")).collect()
    assert len({r["score"] for r in none}) == 1 and not any(r["predicted"] for r in none)


def test_patterns_see_what_they_name():
    empty = tx.Lexicon.of([])
    votes = {t: dict(zip(tx.VOTERS, tx.votes_of(empty.look(t, {})[1][None])[0].tolist())) for t in
             ("THIS IS SHOUTED", "well!! no!! yes!! so!! and!!", "a### b$$$ c%%%", "ha " * 50, "a calm line of plain words", "")}
    says = {t: {v for v in ("shouting", "exclaiming", "symbols", "repeating") if x[v] == 1} for t, x in votes.items()}
    assert list(says.values()) == [{"shouting"}, {"exclaiming"}, {"symbols"}, {"repeating"}, set(), set()]
