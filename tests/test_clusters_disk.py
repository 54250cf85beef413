"""What a clustered scan writes and shuffles grows with the tables, not with the pairs that are compared."""

import numpy as np
import pytest

from emberlake.operators import clusters, nearest


def unit(draw, n, dim):
    made = draw.normal(size=(n, dim))
    return made / np.linalg.norm(made, axis=1, keepdims=True)


def frames(spark, ids, vectors):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vectors)], "rid long, v array<double>")
    return rows, rows.withColumnRenamed("rid", "qid")


def listed(df):
    return sorted((r["qid"], r["rank"], r["rid"], r["similarity"]) for r in df.where("rank <= 4").collect())


def shuffled(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_no_vector_is_shuffled_for_each_pair(spark):
    made = unit(np.random.default_rng(6), 2_000, 32)
    rows, queries = frames(spark, range(2_000), made)
    want = listed(nearest.nearest(queries, rows, 4, skip_self=True))
    before = shuffled(spark)
    held = clusters.Clusters(rows)
    assert listed(held.nearest(queries, 4, skip_self=True)) == want
    assert held.compared > 0.5  # these vectors have no clusters: a query asks for most of the 45
    assert shuffled(spark) - before < 8 * made.nbytes
    held.close()


@pytest.mark.parametrize("skip_self", [True, False])
def test_small_blocks_and_repeated_ids(spark, monkeypatch, skip_self):
    draw = np.random.default_rng(7)
    made = unit(draw, 400, 8)
    made[100:160] = made[3]  # equal vectors, more than a block holds
    ids = np.arange(400) - 50
    ids[200:210] = ids[190:200]  # an id with two vectors is one question and two rows
    rows, queries = frames(spark, ids.tolist(), made)
    want = listed(nearest.nearest(queries, rows, 4, skip_self=skip_self))
    monkeypatch.setattr(clusters, "BLOCK_BYTES", 20 * 8 * 8)
    held = clusters.Clusters(rows, centres=7)
    assert listed(held.nearest(queries, 4, skip_self=skip_self)) == want
    assert held.blocks >= 20
    assert held.nearest(queries.limit(0), 4).count() == 0
    held.close()
