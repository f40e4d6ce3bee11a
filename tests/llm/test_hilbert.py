import itertools
import zlib

from llm_data import SF_SMALL, make_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from callrank.llm import hilbert
from callrank.llm.queries import QUERIES


def test_curve_visits_every_cell_by_single_steps(spark):
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        side = range(1 << bits)
        df = spark.createDataFrame(list(itertools.product(side, repeat=n)), ", ".join(f"c{i} int" for i in range(n)))
        rows = df.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(1 << (n * bits)))
        for a, b in zip(rows, rows[1:]):
            assert sum(abs(x - y) for x, y in zip(a[:n], b[:n])) == 1


def check(df, shards=16):
    out = hilbert.hilbert_shards(df, [hilbert.name_cell(F.col("source"), 6), hilbert.log_cell(F.col("n_chars"), 6)], 6, shards, tie=["doc_id"])
    rows = out.collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert not rows or max(sizes) - min(sizes) <= 1
    last = -1
    for s in sorted(by):
        mine = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        for r in mine:
            assert r["hilbert"] >= last
            last = r["hilbert"]
    return out


def test_shards(spark, odd_docs, make_docs):  # noqa: F811
    check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"))
    check(odd_docs)
    check(odd_docs.where("false"))
    check(make_docs([(1, "copy")] * 100 + [(2, "x")] * 3), 7)
    out = check(make_docs([(i, "t") for i in range(9)], shard="s", slot="t", hilbert=1, row=2, rank=3, part=4, h=5, base=6), 4)
    assert "row" in out.columns and out.schema["shard"].dataType.simpleString() == "int"


def test_written_shards_read_back(spark, tmp_path):
    out = check(spark.read.parquet(f"{SF_SMALL}/documents.parquet"), 4)
    hilbert.write_shards(out, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == out.count() and back.where("shard = 2").count() == out.where("shard = 2").count()


def test_query_law(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, SF_SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert {r["shard"] for r in rows} == set(range(16))
