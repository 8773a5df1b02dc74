"""Links of vectors that share an id, and each pair's one place in the lists."""

from math import sqrt

import numpy as np
import pyarrow as pa
import pytest

from ledgerlight.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def near(v, by=0.1):
    return [v[0] + by * v[1], v[1] + by * v[2], v[2] + by * v[0]]


def test_vectors_of_one_id_have_links_of_their_own(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, x, 1), (1, y, 1), (2, near(x), 1), (3, near(y), 1), (4, near(y, 0.15), 1), (7, x, 1), (7, x, 2), (8, x, 2), (8, y, 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    # (1, x), 2 and 7 of label 1; (1, y), 3 and 4; 7 and (8, x) of label 2; (8, y) alone
    assert got == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (7, 2, 1), (3, 2, 1), (4, 2, 1), (7, 1, 7), (8, 1, 7), (8, 0, 8)])
    apart = [(1, x, 1), (1, y, 2), (2, near(x), 1), (2, near(y), 2)]
    assert {(r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(apart, SCHEMA)).collect()} == {(1, 1, 1), (2, 1, 1)}


def test_lengths_are_all_fitted(spark):
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=3 + k % 40)], 1) for k in range(400)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows + [(1000 + k, [2 * x for x in v], 1) for k, v, _ in rows], SCHEMA), sample=100).collect()
    assert len(got) == 800 and all(r.n_links >= 1 and r.component_id < 1000 for r in got)


@pytest.mark.parametrize("rank, dim, lists", [(4, 64, 64), (4, 768, 64), (64, 64, 100)])
def test_every_close_pair_counts_in_one_list(rank, dim, lists):
    """All pairs at a cosine of 0.93 are met once, by half the border distance, however the vectors lie."""
    rng = np.random.default_rng(dim + lists)
    x = rng.normal(size=(1200, rank)) @ rng.normal(size=(rank, dim))
    x = np.concatenate((x, x[:400] + rng.normal(size=(400, dim)) * 0.3 * np.abs(x).mean()))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = embeddings.quantiser(x, lists)
    own, _, _ = model.encode(x)
    probed = model.probes(x, own, sqrt(2 - 2 * 0.93) / 2)
    rows = pa.array([np.flatnonzero(p) for p in probed], pa.list_(pa.int32()))
    met, node = np.zeros((len(x), len(x)), int), np.arange(len(x))
    for at in range(len(model.centres)):
        q, v = np.flatnonzero(probed[:, at]), np.flatnonzero(own == at)
        if len(v):
            met[np.ix_(q, v)] += embeddings.counted_here(at, own[q], node[q], v, rows.take(pa.array(v)))
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    assert len(a) > 100 and (met[a, b] + met[b, a] == 1).all()
    assert (met + met.T).max() == 1 and met.sum() < 0.9 * len(x) * (len(x) - 1) / 2
