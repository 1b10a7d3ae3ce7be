import zlib
from collections import Counter

from pyspark.sql import functions as F

from climspark.llm import sharding as op
from tests.llm import cases


def test_law_slots_and_sums(spark):
    rows = cases.awkward_rows()
    got = op.op4_sharding(cases.documents(spark)).collect()
    assert cases.ordered((r.doc_id, r.size, r.text_crc32) for r in got) == cases.ordered(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows
    )
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_every_shard_matches_the_mixture(spark):
    docs = spark.range(5_000).select(
        F.col("id").alias("doc_id"),
        F.lit("t").alias("text"),
        F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 9, "b").alias("source"),
    )
    out = op.interleave(docs, shards=8, rows_per_task=400)
    counts = {(r.shard, r.source): r["count"] for r in out.groupBy("shard", "source").count().collect()}
    for shard in range(8):
        for source, n in (("hot", 375), ("b", 187.5), (None, 62.5)):
            assert abs(counts[shard, source] - n) <= 1


def test_seed_and_partitions(spark):
    docs = cases.documents(spark, [(i, "t", "en", "a", 1) for i in range(300)])
    first = {r.doc_id: (r.shard, r.slot) for r in op.interleave(docs).collect()}
    again = {r.doc_id: (r.shard, r.slot) for r in op.interleave(docs.repartition(3)).collect()}
    other = {r.doc_id: (r.shard, r.slot) for r in op.interleave(docs, seed=1).collect()}
    assert first == again != other


def test_few_and_no_rows(spark):
    few = op.op4_sharding(cases.documents(spark, cases.awkward_rows()[:3])).collect()
    assert sorted((r.slot) for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3
    assert op.op4_sharding(cases.empty(spark)).count() == 0


def test_clashing_columns(spark):
    assert op.op4_sharding(cases.clashing(spark)).count() == len(cases.awkward_rows())
