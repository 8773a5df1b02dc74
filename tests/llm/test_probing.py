import numpy as np
import pytest
from test_embeddings_shards_pipeline import plain_links

from ledgerlight.llm import embeddings


@pytest.mark.parametrize("rank, dim", [(4, 64), (8, 64), (8, 768)])
def test_low_rank_vectors_lose_no_link(spark, rank, dim, monkeypatch):
    rng = np.random.default_rng(rank + dim)
    x = rng.normal(size=(600, rank)) @ rng.normal(size=(rank, dim))
    rows = [(i, [float(v) for v in row], 1) for i, row in enumerate(x)]
    monkeypatch.setattr(embeddings, "LIST_SIZE", 10)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = plain_links(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()) == want and sum(n for _, n, _ in want) > 30
