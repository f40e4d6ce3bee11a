import random
from collections import Counter

import pytest
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import line_dedup


def normal(line):
    return line.strip(" \t\r\x0b\x0c").lower()


def grams(line, q):
    return {line[i:i + q] for i in range(max(1, len(line) - q + 1))}


def brute(rows, q, similarity):
    """{(doc_id, text, line_no): (kept, size)} by all pairs of lines."""
    docs = sorted({(d, t) for d, t in rows if t}, key=str)
    occ = [((d, t, i), normal(line)) for d, t in docs for i, line in enumerate(t.split("\n")) if normal(line)]
    lines = sorted({x for _, x in occ})
    up = {x: x for x in lines}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    sets = {x: grams(x, q) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                up[find(b)] = find(a)
    groups = {}
    for place, x in occ:
        groups.setdefault(find(x), []).append(place)
    return groups


def check(df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = brute(rows, options.get("q", line_dedup.SHINGLE), options.get("similarity", line_dedup.SIMILARITY))
    got = line_dedup.judge_lines(df, **options).collect()
    per = {}
    for r in got:
        per.setdefault((r["doc_id"], r["line_no"], r["text_hash"]), r)
    hashes = {}
    for r in df.selectExpr("doc_id", "text", "xxhash64(text) as h").collect():
        hashes[r["doc_id"], r["text"]] = r["h"]
    times = Counter(rows)
    lost = 0
    for places in groups.values():
        mine = [per[d, i, hashes[d, t]] for d, t, i in places]
        first = min(places, key=lambda p: (p[0] is not None, p[0] or 0, hashes[p[0], p[1]], p[2]))
        if {r["group_size"] for r in mine} != {sum(times[d, t] for d, t, _ in places)}:
            lost += 1  # banding misses a pair now and then
            continue
        for r, p in zip(mine, places):
            assert r["kept"] == (p == first) and r["kept_doc_id"] == first[0] and r["kept_line_no"] == first[2]
    assert sum(len(p) for p in groups.values()) == len(per)
    return len(groups), lost


def test_tables(spark):
    n, lost = check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    assert lost <= 0.01 * n


def test_odd_documents(odd_docs, make_docs):  # noqa: F811
    assert check(odd_docs)[1] == 0
    assert line_dedup.judge_lines(odd_docs.where("false")).count() == 0
    df = make_docs([(1, "a\n\n b \nA"), (2, "\n\n"), (3, "b\nc"), (3, "b\nc"), (None, "c")], line="x", first="y", n=1, lid=2, row=3, _cut=4, t=5, h=6, d=7)
    assert check(df)[1] == 0
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == [
        ("1", "a\n\n b "), ("2", "\n\n"), ("3", ""), ("3", ""), ("None", "c")]


def test_text_of_many_repeated_lines(make_docs):  # noqa: F811
    df = make_docs([(1, "the same line\n" * 50_000 + "tail"), (2, "a\nthe same line\nb")])
    assert sorted(map(tuple, line_dedup.dedup_lines(df).select("doc_id", "text").collect())) == [(1, "the same line\ntail"), (2, "a\nb")]


def near(rnd, line, edits):
    w = line.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = "".join(rnd.choices("abcdefgh", k=5))
    return " ".join(w)


@pytest.mark.parametrize("small", [0, 16])
def test_fuzzy_groups_and_chains(make_docs, monkeypatch, small):  # noqa: F811
    monkeypatch.setattr(line_dedup, "SMALL_BAND", small)  # 0: all by the prefix filter
    rnd = random.Random(2)
    rows, n = [], 0
    for g in range(12):
        line = " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 9))) for _ in range(60))
        for _ in range(25):  # a chain: each like the one before
            rows.append((n, "head %d\n" % n + line))
            line, n = near(rnd, line, 1), n + 1
    groups, lost = check(make_docs(rows))
    assert lost == 0 and groups < 400


def test_scripts_without_blanks(make_docs):  # noqa: F811
    line = "".join(chr(0x4E00 + 7 * i % 900) for i in range(120))
    df = make_docs([(1, line), (2, line[:50] + "\u9999" + line[51:]), (3, line[::-1]), (4, "x" * 5000 + "y"), (5, "x" * 5000 + "z")])
    assert check(df) == (4, 0)


def test_recall_at_the_threshold(make_docs):  # noqa: F811
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        line = " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(60))
        rows += [(2 * i, line), (2 * i + 1, near(rnd, line, rnd.randint(1, 3)))]
    groups, lost = check(make_docs(rows))
    assert lost <= 0.02 * groups
