import numpy as np
import public_tokenizers
from llm_data import SF_SMALL
from test_decontaminate import brute as contamination
from test_simhash import brute_components, brute_print
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import queries


def test_registered():
    names = queries()
    assert names["pipeline"] is corpus_pipeline.run
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "packing"]

    clear = steps["language_id"](spark, docs, SF_SMALL).cache()
    assert clear.columns == docs.columns
    before = docs.collect()
    assert clear.count() >= 0.97 * sum(any(map(str.isalpha, r["text"] or "")) for r in before)

    lines = steps["line_dedup"](spark, clear, SF_SMALL).cache()
    assert lines.columns == docs.columns and lines.count() == clear.count()
    kept = [x.strip().lower() for r in lines.collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(kept) == len(set(kept))
    assert set(kept) <= {x.strip().lower() for r in clear.collect() for x in r["text"].split("\n")}

    near = steps["simhash_near_dedup"](spark, lines, SF_SMALL).cache()
    prints = [brute_print(r["text"], 4) for r in lines.collect()]
    root = brute_components(prints, 4)
    assert near.columns == docs.columns and near.count() == len(set(root.values()))
    assert {root[brute_print(r["text"], 4)] for r in near.collect()} == set(root.values())

    pure = steps["benchmark_decontamination"](spark, near, SF_SMALL).cache()
    want = {r["doc_id"] for r in near.collect() if not contamination(r["text"], items, 10)[1]}
    assert {r["doc_id"] for r in pure.collect()} == want and len(want) < near.count()

    packed = steps["packing"](spark, pure, SF_SMALL).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in pure.collect()}
    ids = {}
    for r in sorted(packed, key=lambda r: (r["doc_id"], r["start"])):
        ids.setdefault(r["doc_id"], []).extend(np.frombuffer(r["ids"], "<u4").tolist())
    assert ids == {d: tok.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
