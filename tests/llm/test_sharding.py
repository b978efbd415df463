import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sitelens.llm import sharding


def jump(key: int, n: int) -> int:
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.JUMP_MULTIPLIER + 1) % 2 ** 64
        j = int((b + 1) * (2.0 ** 31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [str(k) for k in range(400)] + [""]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    digest = sharding.key_digest(F.col("k"))
    rows = df.select("k", *[sharding.jump_shard(digest, n).alias(f"n{n}") for n in (1, 2, 24, 25, 300)]).collect()
    for r in rows:
        seed = int(hashlib.md5(r.k.encode()).hexdigest()[:16], 16)
        assert [r[f"n{n}"] for n in (1, 2, 24, 25, 300)] == [jump(seed, n) for n in (1, 2, 24, 25, 300)]


def test_slots_are_gapless_and_growth_moves_only_into_the_new_shard(spark, docs, edge, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 3)
    monkeypatch.setattr(sharding, "COPY_CHUNK", 2)
    columns = ["doc_id", "text"]
    rows = sharding.shard_documents(docs.select(columns).union(edge.select(columns)), 5).collect()
    assert len(rows) == docs.count() + edge.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(Counter(r.shard for r in rows)) == set(range(5))
    assert len({r.shard for r in rows if r.doc_id is None}) == 1


def test_one_hot_row_spreads_over_copies(spark):
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard_documents(hot, 24).collect()
    assert sorted(r.slot for r in rows) == list(range(1000)) and len({r.shard for r in rows}) == 1


def test_empty(none):
    assert sharding.shard_documents(none, 24).collect() == []
