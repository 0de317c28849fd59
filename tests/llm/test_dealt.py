"""How asked rows and blocks meet in the searches over embeddings (op8, op13)."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from factloom.llm import common, hard_negatives, topk
from factloom.llm.q_hard_negatives import OP13_SQL, op13_hard_negatives


def vectors(spark, n=400, width=8):
    r = np.random.default_rng(4)
    rows = [(i, int(y), [float(x) for x in r.normal(0, 0.3, width)]) for i, y in enumerate(r.integers(0, 3, n))]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")


def test_nothing_is_broadcast(spark):
    """A copy of the asked rows for each slot must not go through the driver."""
    given = vectors(spark)

    def plans() -> dict:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        all_ = spark._jsparkSession.sharedState().statusStore().executionsList()
        return {x.executionId(): x.physicalPlanDescription() for x in map(all_.apply, range(all_.size()))}

    last = max(plans(), default=-1)
    assert hard_negatives.mine_hard_negatives(given, F.col("vec_id") % 10 == 0, block_rows=16, group_rows=4, blocks_a_slot=1).count() == 40 * 5 * 10
    assert topk.top_k(given, F.col("vec_id") % 10 == 0, block_rows=16, query_rows=4, blocks_a_slot=1).count() == 40 * 10
    new = [p for i, p in plans().items() if i > last]
    assert sum("MapInArrow" in p for p in new) >= 4 and not any("Broadcast" in p for p in new)


def test_each_slot_meets_each_shard(spark):
    asked = spark.range(12).select((F.col("id") % 3).alias("shard"), F.col("id").alias("q"))
    blocks = spark.range(20).select((F.col("id") % 5).alias("slot"), F.col("id").alias("b"))
    tasks = common.met(asked, blocks, 5, 3).withColumn("at", F.spark_partition_id()).rdd.glom().collect()
    assert len(tasks) == 15
    for t, rows in enumerate(tasks):
        assert {x.task for x in rows} == {x["at"] for x in rows} == {t}
        assert [x.is_asked for x in rows] == [False] * 4 + [True] * 4
        assert {x.b for x in rows[:4]} == set(range(t // 3, 20, 5)) and {x.q for x in rows[4:]} == set(range(t % 3, 12, 3))


def test_packed_numbers():
    for high in (0, 1 << 14, 1 << 15, 1 << 31, (1 << 63) - 1):
        x = np.array([[high, -1, 0], [-high, 5, 6]])
        assert (common.opened(common.narrowed(x), 2, 3) == x).all()
    assert [len(common.narrowed(np.array([x]))) for x in (-(1 << 15), 1 << 15, 1 << 31)] == [2, 4, 8]
    for n, asked in ((0, 0), (1, 0), (50, 50), (10_000, 100), (615_384, 6_154), (23_000_000, 230_000)):
        slots, shards = common.slots_and_shards(n, asked, 64, 4_096, 256, 64)
        assert slots >= 1 and shards >= 1 and n * 64 / slots <= common.SLOT_NUMBERS and (slots * shards >= common.TASKS or shards >= asked / 256)


def test_an_anchor_of_two_vectors(spark, tmp_path):
    """Rows that share an anchor's id have bounds of their own."""
    far = [(100, 1, [0.9] + [0.0] * 7), (100, 2, [0.0] * 7 + [0.9])]
    given = vectors(spark).where("vec_id <> 100").union(spark.createDataFrame(far, "vec_id long, label int, embedding array<float>"))
    given.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(db.execute(OP13_SQL).fetchall()) and len(got) > 100
