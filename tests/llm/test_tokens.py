import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import LONG, ODD, SF_SMALL, make_docs, odd_docs  # noqa: F401
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from callrank.llm import packing, token_counts, token_shards
from callrank.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("aB'st éÉßÿ×÷0 9\n\t.,;<|>!", max_size=40)))
def test_encoder_equals_whole_text(text):
    enc = Encoder.at(PATH)
    assert np.frombuffer(enc.encode(text), enc.dtype).tolist() == ids_of(text)


def test_encoder_special_strings():
    enc = Encoder.at(PATH)
    for t in ("a<|endoftext|>b", "<|startoftext|>", "it's we'LL 'S don't", "\x00\x1c\x85\xa0 x", "é", "ﬁ Ⅷ ½", "ΑΣ İ", LONG):
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == ids_of(t)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------- op3

@pytest.fixture(scope="module")
def unigram():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return path, token_counts.unigram_scores(path)


def test_trie_counts_equal_a_unigram_library_model(unigram):
    _, scores = unigram
    pieces = [("<unk>", -1e9)] + [(p, -s / token_counts.SCALE) for p, s in scores.items()]
    model = Unigram(pieces, 0, False)
    trie = token_counts.Trie(scores)
    for w in "the thereof hethwhwh xylophonically ofthshwhan éenaux schöpfung a internationalization aaaaaaa zzzzqqqq".split():
        assert trie.insert("▁" + w) == len(model.tokenize("▁" + w)), w


def brute_count(word, scores):
    best = [(0, 0)]
    worst = max(scores.values()) + token_counts.SCALE
    for d in range(1, len(word) + 1):
        c = [(best[k][0] + scores[word[k:d]], best[k][1] + 1) for k in range(d) if word[k:d] in scores]
        if word[d - 1] not in scores:
            raw = len(word[d - 1].encode())
            c.append((best[d - 1][0] + raw * worst, best[d - 1][1] + raw))
        best.append(min(c))
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("theanor漢\U0001F600é", min_size=1, max_size=90), min_size=1, max_size=6))
def test_trie_against_brute_force(words):
    scores = token_counts.unigram_scores(public_tokenizers.path("piece_bpe_32k.model"))
    trie = token_counts.Trie(scores)
    for w in words + words:
        assert trie.insert("▁" + w) == brute_count("▁" + w, scores)


def test_trie_starts_anew_when_full(unigram, monkeypatch):
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 3)
    trie = token_counts.Trie(unigram[1])
    for w in "alpha beta alphabet betamax gamma alpha".split():
        assert trie.insert("▁" + w) == brute_count("▁" + w, unigram[1])
        assert len(trie.terminal) <= 3 and len(trie.path) <= len(w) + 2


def test_document_counts(odd_docs, unigram):  # noqa: F811
    path, scores = unigram
    got = sorted(str(tuple(r)) for r in token_counts.count_tokens(odd_docs, path).collect())
    known = {}

    def n(w):
        return known.setdefault(w, brute_count("▁" + w, scores))
    assert got == sorted(str((d, len((t or "").split()), sum(map(n, (t or "").split())))) for d, t, _ in ODD)
    assert token_counts.count_tokens(odd_docs.where("false"), path).count() == 0


# ------------------------------------------------------------- op4

@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2 ** 64 - 1), max_size=400))
def test_perfect_hash_is_minimal_and_perfect(keys):
    h = np.array(sorted(keys), np.uint64)
    mph = token_shards.PerfectHash.build(h)
    back = token_shards.PerfectHash.from_bytes(mph.sizes, mph.to_bytes())
    assert sorted(back.slots(h).tolist()) == list(range(len(h)))


def shard_check(df, tmp_path, rows, **options):
    path = f"file://{tmp_path}/set"
    token_shards.write_token_shards(df, path, PATH, 2, **options)
    keys = token_shards.keys_of(df)
    got = token_shards.read_documents(keys, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(order)
    by_id = {}
    for d, t in order:
        by_id.setdefault(d, []).append(ids_of(t) + [2])
    seen = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert r["n_tokens"] == len(ids)
        seen.setdefault(r["doc_id"], []).append((r["start"], ids))
    start = 0
    for d, texts in by_id.items():
        mine = sorted(seen[d])
        assert sorted(ids for _, ids in mine) == sorted(texts)
        for at, ids in mine:
            assert at == start
            start += len(ids)
    digests = {(r["doc_id"], r["copy"]): r["ids_crc32"] for r in token_shards.token_digests(keys, path).collect()}
    assert digests == {(r["doc_id"], r["copy"]): zlib.crc32(r["ids"]) for r in got}
    return path


def test_round_trip_of_odd_documents(spark, odd_docs, tmp_path):  # noqa: F811
    rows = [(d, t) for d, t, _ in ODD]
    path = shard_check(odd_docs, tmp_path, rows, shard_bytes=100)
    absent = spark.createDataFrame([(99, 0), (5, 3), (7, 2)], "doc_id long, copy long")
    assert token_shards.read_documents(absent, path).count() == 0


def test_round_trip_with_one_hot_id(spark, make_docs, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(token_shards, "BUCKET_KEYS", 40)
    rows = [(1, "same text")] * 60 + [(1, f"text {i}") for i in range(90)] + [(i, "w " * i) for i in range(2, 60)]
    shard_check(make_docs(rows, copy=1, shard=2), tmp_path, rows, shard_bytes=300)


def test_round_trip_of_tables_and_nothing(spark, odd_docs, tmp_path):  # noqa: F811
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    shard_check(df, tmp_path / "a", [(r["doc_id"], r["text"]) for r in df.collect()])
    shard_check(odd_docs.where("false"), tmp_path / "b", [])


# ------------------------------------------------------------- op5

def pack_check(df, rows, capacity):
    got = packing.pack(df, PATH, capacity=capacity, end_id=1).collect()
    docs, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and crc(ids) == r["ids_crc32"]
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokens = 0
    for (d, n), parts in docs.items():
        texts = [ids_of(t) + [1] for x, t in rows if x == d and len(ids_of(t)) + 1 == n]
        assert sum(len(p) for _, p in parts) == sum(map(len, texts))
        if len(texts) == 1:
            flat, at = [], 0
            for start, ids in sorted(parts):
                assert start == at
                flat += ids
                at += len(ids)
            assert flat == texts[0]
        tokens += sum(map(len, texts))
    assert tokens == sum(len(ids_of(t)) + 1 for _, t in rows)
    for parts in seqs.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= capacity
    assert sorted(seqs) == list(range(len(seqs)))
    return len(seqs), tokens


def test_packing_of_tables_leaves_little_padding(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    n, tokens = pack_check(df, [(r["doc_id"], r["text"]) for r in df.collect()], 2048)
    assert n <= -(-tokens // 2048) + 1


def test_packing_of_odd_documents(odd_docs):  # noqa: F811
    rows = [(d, t) for d, t, _ in ODD]
    for capacity in (2048, 96):
        n, tokens = pack_check(odd_docs, rows, capacity)
        assert n <= -(-tokens // capacity) + 2
    assert packing.pack(odd_docs.where("false"), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 256), st.integers(1, 5000), min_size=1, max_size=40))
def test_plan_uses_every_piece_once(histogram):
    left, room = dict.fromkeys(histogram, 0), {}
    segments = packing.plan_sequences(histogram, 256)
    for i, (size, first, each, seq, at) in enumerate(segments):
        assert first == left[size]
        later = [s for s in segments[i + 1:] if s[3] > seq]
        times = (later[0][3] if later else max(s[3] for s in segments) + 10 ** 9) - seq
        times = min(times, (histogram[size] - first) // each)
        left[size] += each * times
        room[seq] = room.get(seq, 0) + each * size
    assert left == histogram
    assert max(room.values()) <= 256
