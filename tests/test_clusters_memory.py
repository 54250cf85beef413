import numpy as np
import pyarrow as pa

from emberlake.operators import clusters, nearest


def test_pairs_and_groups_are_bounded(spark, monkeypatch):
    draw = np.random.default_rng(4)
    made = draw.normal(size=(300, 8))
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "rid long, v array<double>")
    queries = rows.withColumnRenamed("rid", "qid").coalesce(1)
    want = {tuple(r) for r in nearest.nearest(queries, rows, 3, skip_self=True).where("rank <= 3").select("qid", "rid", "rank").collect()}
    monkeypatch.setattr(clusters, "BLOCK_ROWS", 50)
    plain = clusters._block

    def watched(*given):
        run = plain(*given)

        def checked(left: pa.Table, right: pa.Table) -> pa.Table:
            assert left.num_rows <= 100  # of 300 queries, all of which ask for nearly every cluster
            return run(left, right)

        return checked

    monkeypatch.setattr(clusters, "_block", watched)
    monkeypatch.setattr(clusters, "CHOOSE_PAIRS", 16, raising=False)
    held = clusters.Clusters(rows)
    assert {tuple(r) for r in held.nearest(queries, 3, skip_self=True).select("qid", "rid", "rank").collect()} == want
    held.close()
