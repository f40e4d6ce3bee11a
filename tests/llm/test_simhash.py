import random

import numpy as np
import xxhash
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import simhash


def brute_print(text, k):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    w = s.split()
    if not w:
        return 0
    grams = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if len(w) >= k else [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, distance):
    kinds = sorted(set(prints))
    up = {p: p for p in kinds}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p
    for i, a in enumerate(kinds):
        for b in kinds[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                up[find(b)] = find(a)
    return {p: find(p) for p in kinds}


def check(df, k=4, distance=4):
    rows = df.select("doc_id", "text").collect()
    prints = [brute_print(r["text"], k) for r in rows]
    root = brute_components(prints, distance)
    least = {}
    for r, p in zip(rows, prints):
        if r["doc_id"] is not None:
            least[root[p]] = min(least.get(root[p], r["doc_id"]), r["doc_id"])
    want = sorted(str((r["doc_id"], f"{p:016x}", least.get(root[p]))) for r, p in zip(rows, prints))
    assert sorted(str(tuple(r)) for r in simhash.near_duplicates(df, k, distance).collect()) == want
    return root, least


def test_tables(spark):
    root, _ = check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    assert len(set(root.values())) < len(root)


def test_odd_documents(odd_docs):
    check(odd_docs)


def test_empty_table(odd_docs):
    assert simhash.near_duplicates(odd_docs.where("false")).count() == 0
    assert simhash.drop_near_duplicates(odd_docs.where("false")).count() == 0


def test_clashing_columns(make_docs):
    df = make_docs([(1, "a b c d e"), (2, "a b c d e")], fingerprint="x", component_id=9, fp=1, root=2, _id=3)
    assert sorted(r["component_id"] for r in simhash.near_duplicates(df).collect()) == [1, 1]
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]


def test_stage_keeps_one_of_each_component(odd_docs):
    rows = odd_docs.collect()
    root = brute_components([brute_print(r["text"], 4) for r in rows], 4)
    kept = simhash.drop_near_duplicates(odd_docs).collect()
    assert sorted(root[brute_print(r["text"], 4)] for r in kept) == sorted(set(root.values()))


def _links(spark, fps, distance):
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long").repartition(3)
    from callrank.llm.components import connected_components
    comp = {np.uint64(np.int64(r["node"])).item() if r["node"] >= 0 else r["node"] + 2 ** 64: r["root"] for r in
            connected_components(simhash.near_links(df, distance)).collect()}
    groups = {}
    for f in set(fps):
        groups.setdefault(comp.get(f, ("alone", f)), set()).add(f)
    return sorted(map(sorted, groups.values()))


def _expected(fps, distance):
    groups = {}
    for f, r in brute_components(fps, distance).items():
        groups.setdefault(r, set()).add(f)
    return sorted(map(sorted, groups.values()))


def test_links_of_random_and_dense_fingerprints(spark, monkeypatch):
    rnd = random.Random(5)
    fps = [rnd.getrandbits(64) for _ in range(150)]
    for f in fps[:60]:  # chains of near fingerprints
        for _ in range(3):
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                f ^= 1 << b
            fps.append(f)
    base = rnd.getrandbits(64)
    fps += [base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(250)]
    monkeypatch.setattr(simhash, "CELL_ROWS", 32)  # so that groups are dealt over cells
    assert _links(spark, fps, 4) == _expected(fps, 4)
    # few, long probes instead of many short exact ones
    monkeypatch.setattr(simhash, "allocate", lambda n, both, d, **_: [
        (list(range(0, 22)), 1), (list(range(22, 43)), 1), (list(range(43, 64)), 0)])
    assert _links(spark, fps, 4) == _expected(fps, 4)


def test_thresholds_satisfy_the_pigeonhole():
    rnd = np.random.default_rng(1)
    x = (rnd.random((500, 64)) < 0.4).astype(np.int64)
    for n in (10, 10 ** 5, 10 ** 7, 10 ** 9):
        for d in (0, 1, 4, 6):
            plan = simhash.allocate(n, x.T @ x * (n // 500 + 1), d)
            assert sum(t + 1 for _, t in plan) == d + 1
            bits = [b for g, _ in plan for b in g]
            assert len(bits) == len(set(bits))
