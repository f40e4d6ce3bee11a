import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import winnow as wn


def brute_hashes(points, k):
    k, out = min(k, len(points)), []
    base = 0x9E3779B97F4A7C15
    for i in range(len(points) - k + 1 if points else 0):
        h = 0
        for p in points[i:i + k]:
            h = (h * base + p + 1) % 2 ** 64
        h ^= h >> 32
        out.append((h * 0xD6E8FEB86659FD93 % 2 ** 64) >> 32)
    return out


def brute_winnow(points, k, window):
    h = brute_hashes(points, k)
    w, kept = min(window, len(h)), []
    for i in range(len(h) - w + 1 if h else 0):
        best = min(range(i, i + w), key=lambda j: (h[j], -j))
        if not kept or kept[-1] != best:
            kept.append(best)
    return [h[j] for j in kept], kept


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\U0001F600é", max_size=60), st.integers(1, 9), st.integers(1, 12))
def test_winnow_against_brute_force(text, k, window):
    hashes, at = wn.winnow(wn._points(text), k, window)
    want = brute_winnow([ord(c) for c in text], k, window)
    assert (hashes.tolist(), at.tolist()) == want


def test_match_guarantee():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        shared = rnd.integers(97, 123, wn.K + wn.WINDOW - 1)
        a = np.concatenate([rnd.integers(97, 123, rnd.integers(0, 300)), shared, rnd.integers(97, 123, 50)])
        b = np.concatenate([rnd.integers(97, 123, rnd.integers(0, 300)), shared])
        assert set(wn.winnow(a)[0]) & set(wn.winnow(b)[0])


def check(df, **options):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()),
                  key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = wn.edited_fingerprints(df, **options).collect()
    assert len(got) == len(rows)
    prints = {t: set(brute_winnow([ord(c) for c in t], wn.K, wn.WINDOW)[0]) if len(t) < 3000 else
              set(wn.winnow(wn._points(t))[0].tolist()) for _, t in rows}

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0
    want = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        n = len(t)
        e = t[:n - n // 3] + nxt[:n // 3]
        fe = set(wn.winnow(wn._points(e))[0].tolist())
        want.setdefault(d, []).append((n, hashlib.sha256(e.encode()).hexdigest(), like(prints[t], fe), like(prints[t], prints[nxt])))
    for r in got:
        if len(want[r["doc_id"]]) == 1:
            assert (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) == want[r["doc_id"]][0]
    return got


def test_tables_and_bucket_sizes(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    one = sorted(map(str, check(df, bucket_rows=7)))
    assert one == sorted(map(str, check(df, bucket_rows=1000)))


def test_odd_documents(odd_docs, make_docs):  # noqa: F811
    got = check(odd_docs, bucket_rows=3)
    texts = {}
    for r in got:
        texts.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for k, v in texts.items() if k[0] == 7)
    lone = wn.edited_fingerprints(make_docs([(1, "abc" * 40)], h=1, d="x", bucket="y", ahead=True)).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1.0 and lone[0]["edited_sha256"] == hashlib.sha256(("abc" * 40)[:80].encode() + ("abc" * 40)[:40].encode()).hexdigest()
    assert wn.edited_fingerprints(odd_docs.where("false")).count() == 0


def test_plain_fingerprints(odd_docs):  # noqa: F811
    for r in wn.document_fingerprints(odd_docs).collect():
        assert len(r["hashes"]) == len(r["positions"])
