"""Reports on exemplars compare all pairs once; the block search equals brute force."""

import numpy as np
import pyarrow as pa
import pytest

from emberlake.operators import guard, nearest
from emberlake.plans import guarding


def test_explanation_reads_votes_that_are_there(spark):
    loo = guarding._loo(spark, "/root/testdata/sf0.001")
    out = guard.explanation(loo, guarding.ALLOW, guarding.BLOCK, guarding.FLOOR)
    assert "InArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 1


@pytest.mark.parametrize("floor", [None, 0.3])
@pytest.mark.parametrize("skip_self", [True, False])
def test_block_equals_brute_force(floor, skip_self):
    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(700, 4)) * 1.5)  # many equal vectors and similarities
    v[:, 0] += np.abs(v).sum(1) == 0
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = rng.integers(0, 60, 700)  # and repeated ids
    table = lambda name: pa.table({name: pa.array(ids, pa.int64()), "v": pa.array(v.tolist(), pa.list_(pa.float64()))})
    got = nearest._block(8, floor, skip_self)(table("qid"), table("rid")).to_pylist()
    sims, want = np.round(v @ v.T, 9), []
    for i in range(700):
        near = sorted((-sims[i, j], ids[j]) for j in range(700) if not (skip_self and ids[j] == ids[i]) and (floor is None or sims[i, j] >= floor))
        want += [(ids[i], r, -s) for s, r in near[:8]]
    assert [(r["qid"], r["rid"]) for r in got] == [(q, r) for q, r, _ in want]
    assert np.allclose([r["similarity"] for r in got], [s for *_, s in want], atol=1e-12)
