"""Line dedup against true character shingles: one at every character."""

import random

import test_line_dedup
from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401

from callrank.llm import line_dedup


def grams(line, q=line_dedup.SHINGLE):
    return {line[i:i + q] for i in range(max(1, len(line) - q + 1))}


def alike(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) >= line_dedup.SIMILARITY * len(a | b)


def components(df):
    """{line: where it is kept}"""
    texts = {r["doc_id"]: r["text"].split("\n") for r in df.select("doc_id", "text").collect()}
    return {texts[r["doc_id"]][r["line_no"]].strip().lower(): (r["kept_doc_id"], r["kept_line_no"])
            for r in line_dedup.judge_lines(df).collect()}


def one_letter_off(rnd, line):
    i = rnd.randrange(len(line))
    return line[:i] + rnd.choice([c for c in "abcdefghij" if c != line[i]]) + line[i + 1:]


def test_lost_pairs_of_short_lines(spark, make_docs):  # noqa: F811
    rnd = random.Random(5)
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("text is not null").select("text").collect()
    own = sorted({x.strip().lower() for r in rows for x in r["text"].split("\n") if x.strip()})
    # the tables' lines, and lines of 5 to 17 words, of which an edit breaks too many words
    own += [" ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(rnd.randint(5, 17))) for _ in range(300)]
    pairs = [(x, one_letter_off(rnd, x).strip()) for x in own]
    pairs = [(a, b) for a, b in pairs if b and a != b and alike(a, b)]
    assert len(pairs) > 200
    at = components(make_docs([(i, x) for i, p in enumerate(pairs) for x in ["\n".join(p)]]))
    assert sum(at[a] != at[b] for a, b in pairs) <= 0.02 * len(pairs)


def test_every_shingle_is_hashed_once(make_docs):  # noqa: F811
    from pyspark.sql import functions as F
    lines = ["a", "abcdefgh", "abcdefghi", "x" * 50, "漢字" * 9, "\U0001F600 naïve " * 3]
    df = make_docs(list(enumerate(lines)))
    for r in df.select("text", line_dedup.shingle_hashes(F.col("text"), 8).alias("s")).collect():
        assert len(r["s"]) == max(1, len(r["text"]) - 7) and len(set(r["s"])) == len(grams(r["text"]))


def test_odd_documents_by_characters(odd_docs, monkeypatch):  # noqa: F811
    monkeypatch.setattr(test_line_dedup, "grams", grams)
    assert test_line_dedup.check(odd_docs)[1] == 0


def test_bands_of_few_shingles_are_independent(spark):
    rnd = random.Random(7)
    for union in (5, 10, 20, 30, 50):  # similarity 0.8 each
        rows = []
        for pair in range(1500):
            g = [rnd.randrange(-2 ** 31, 2 ** 31) for _ in range(union)]
            both, own = g[:union * 4 // 5], g[union * 4 // 5:]
            cut = rnd.randint(0, len(own))
            rows += [(pair, side, x) for side, rest in enumerate((own[:cut], own[cut:])) for x in both + rest]
        df = spark.createDataFrame(rows, "h1 long, h2 long, g int").repartition(4)
        got = {(r["h1"], r["h2"]): r["bands"] for r in line_dedup.signatures(df, line_dedup.BANDS, line_dedup.ROWS).collect()}
        found = sum(any(x == y for x, y in zip(got[p, 0], got[p, 1])) for p in range(1500))
        assert found >= 0.97 * 1500, (union, found)


def test_recall_at_the_threshold_of_short_lines(make_docs):  # noqa: F811
    rnd = random.Random(8)
    pairs = []
    while len(pairs) < 400:
        line = " ".join("".join(rnd.choices("abcdefghijklmnop", k=6)) for _ in range(rnd.randint(5, 30)))
        other = line
        for _ in range(9):
            other = one_letter_off(rnd, other) if rnd.random() < 0.5 else other[:-1]
            if not alike(line, other):
                break
            a, b = grams(line), grams(other)
            if other == other.strip() and len(a & b) <= 0.84 * len(a | b):
                pairs.append((line, other))
                break
    at = components(make_docs([(i, "\n".join(p)) for i, p in enumerate(pairs)]))
    assert sum(at[a] != at[b] for a, b in pairs) <= 0.03 * len(pairs)


def test_lines_without_blanks(make_docs):  # noqa: F811
    rnd = random.Random(6)
    url = "https://example.org/" + "/".join("".join(rnd.choices("abcdefghij0123456789", k=9)) for _ in range(12))
    row = "\t".join(str(rnd.randrange(10 ** 6)) for _ in range(20))
    khmer = "".join(chr(rnd.randrange(0x1780, 0x17A3)) for _ in range(120))
    han = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(60))
    ascii_ = "".join(rnd.choices("abcdefghij", k=70))
    mixed = ascii_[:35] + han + ascii_[35:]  # about half of its bytes in wide characters
    lines = [url, row, khmer, mixed, "x" * 5000 + "y"]
    pairs = [(x, x[:20] + "q" + x[21:]) for x in lines[:-1]]
    pairs.append((mixed + "a" * 40, mixed + "a" * 41))
    assert all(alike(a, b) for a, b in pairs)
    rows = [(i, "\n".join(p)) for i, p in enumerate(pairs[:4])] + [(9, lines[-1] + "\n" + "x" * 5000 + "z"), (10, "\n".join(pairs[4]))]
    at = components(make_docs(rows))
    assert all(at[a] == at[b] for a, b in pairs)
    # two shingles each, one of them shared: a third alike
    assert not alike("x" * 5000 + "y", "x" * 5000 + "z") and at["x" * 5000 + "y"] != at["x" * 5000 + "z"]
