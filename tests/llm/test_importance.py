import hashlib
import math
import re
import zlib

import pytest
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import importance
from callrank.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute(docs, items, percent=25, least=20, buckets=10000, seed=7):
    s, t = [0] * buckets, [0] * buckets

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets
    own = []
    for i, text in docs:
        n, f = features(text)
        own.append((i, n, [bucket(x) for x in f]))
        for b in own[-1][2]:
            s[b] += 1
    for text in items:
        for f in features(text)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for i, n, f in own:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    k = len(able) * percent // 100
    out = [(*r, n + 1 if n < k else None) for n, r in enumerate(able)] + [(*r, None) for r in rows if r[1] < least]
    return sorted(out, key=str)


def check(docs, items, **options):
    got = importance.importance_resample(docs, items, **options).collect()
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in items.collect()],
                 options.get("percent", 25), options.get("least_words", 20), options.get("buckets", 10000))
    assert sorted([tuple(r) for r in got], key=str) == want
    return got


def test_tables(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = check(docs, items)
    query = QUERIES["op13_importance_resampling"](spark, SF_SMALL)
    assert query.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted(map(tuple, query.collect()), key=str) == sorted(((r[0], *r[2:]) for r in got), key=str)
    assert sum(r["rank"] is not None for r in got) == sum(r["n_words"] >= 20 for r in got) // 4


def test_odd_documents(spark, odd_docs):  # noqa: F811
    items = spark.createDataFrame([(1, "quick brown fox"), (2, None), (3, "")], "item_id long, text string")
    for percent, least in ((25, 20), (50, 1), (100, 0), (0, 1)):
        check(odd_docs.selectExpr("*", "'x' as rank", "1 as score", "2 as weight", "3 as buckets"), items, percent=percent, least_words=least)
    check(odd_docs, items.where("false"), percent=60, least_words=1, buckets=70_000)
    assert importance.importance_resample(odd_docs.where("false"), items).count() == 0


def test_same_under_any_partitioning(spark):
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one, two = (sorted(map(str, importance.importance_resample(d, items).collect())) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == two


@pytest.mark.parametrize("shape", ["ties", "spread", "two"])
@pytest.mark.parametrize("error", [1e-3, 0.2])
def test_bracket_holds_the_cutoff(spark, shape, error):
    from pyspark.sql import functions as F
    score = {"ties": F.lit(7), "spread": F.xxhash64("id") % 1000, "two": F.when(F.col("id") % 3 == 0, 1).otherwise(-1)}[shape]
    rows = spark.range(3000).withColumn("score", score.cast("long")).persist()
    want = sorted(((r["score"], r["id"]) for r in rows.collect()), key=lambda r: (-r[0], r[1]))
    for k in (1, 2, 750, 999, 1000, 1001, 2999, 3000):
        low, high, above = importance.bracket(rows, "score", 3000, k, error)
        assert above == sum(s > high for s, _ in want) < k <= sum(s >= low for s, _ in want)
    got = importance.draw_highest(rows, "score", ["id"], 750, 3000, error=error).where("rank is not null").orderBy("rank").collect()
    assert [(r["score"], r["id"]) for r in got] == want[:750] and [r["rank"] for r in got] == list(range(1, 751))
