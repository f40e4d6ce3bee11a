"""Candidate pairs of a large band: copies of one passage, and lines that hold it among other text."""

import random

from callrank.llm import line_dedup


def text(rnd, n):
    return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))


def edited(rnd, line, edits):
    """Every edit breaks eight shingles of its own."""
    for i in rnd.sample(range(10, len(line) - 10, 10), edits):
        line = line[:i] + rnd.choice("0123456789") + line[i + 1:]
    return line


def test_what_a_band_has_in_common_makes_no_pairs(spark):
    rnd = random.Random(4)
    passage, around = text(rnd, 300), [text(rnd, 40) for _ in range(20)]
    lines, members = [(0, passage)], [(1, 0, 0, 0, False)]  # band, lid, root, centre, odd
    for i in range(1, 21):
        lines += [(i, edited(rnd, passage, 1)), (100 + i, edited(rnd, passage, 6) + around[i - 1])]
        members += [(1, i, 0, 0, False), (1, 100 + i, 100 + i, 0, True)]
    for i in range(200, 300):  # what stands around the passage is frequent elsewhere, so rare shingles first do not help
        lines.append((i, "".join(around) + text(rnd, 20)))
        members.append((2, i, 200, 200, False))
    pairs = line_dedup._prefix_pairs(spark.createDataFrame(members, "band long, lid long, root long, centre long, odd boolean"),
                                     spark.createDataFrame(lines, "lid long, line string"), 8, 0.8)
    assert pairs.count() <= 20  # 20 lines that hold it and 20 copies


def test_links_among_odd_lines_are_found(spark):
    rnd = random.Random(5)
    passage, lines, members = text(rnd, 400), [], []
    for i in range(40):
        other = edited(rnd, passage, 12)
        for j in (0, 1):  # two that are alike, and unlike the passage
            lines.append((1 + 2 * i + j, edited(rnd, other, j)))
            members.append((1, 1 + 2 * i + j, 1 + 2 * i + j, 0, True))
    lines.append((0, passage))
    members.append((1, 0, 0, 0, False))
    lines = spark.createDataFrame(lines, "lid long, line string")
    pairs = line_dedup._prefix_pairs(spark.createDataFrame(members, "band long, lid long, root long, centre long, odd boolean"), lines, 8, 0.8)
    got = {tuple(r) for r in line_dedup._verified(pairs, lines, 8, 0.8).collect()}
    sets = {r["lid"]: {r["line"][i:i + 8] for i in range(len(r["line"]) - 7)} for r in lines.collect()}
    want = {(u, v) for u in sets for v in sets if u < v and len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    assert got == want and len(want) >= 40
