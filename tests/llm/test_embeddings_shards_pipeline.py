from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm import embeddings, lines, mixing, packing, quality, registry, shards, simhash, tokens


def plain_links(rows, least=0.93):
    """(links, component) of each row, all pairs compared."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    units, links = [], [0] * len(rows)
    for i, v, label in rows:
        good = i is not None and v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, float) / np.linalg.norm(v) if good else None)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if units[a] is not None and units[b] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least_id = {}
    for k, r in enumerate(rows):
        least_id[find(k)] = min(least_id.get(find(k), r[0]), r[0]) if r[0] is not None else None
    return [(r[0], links[k], least_id[find(k)]) for k, r in enumerate(rows)]


def clouds(n, dim, seed):
    """Vectors with copies, a large close group, and pairs on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    out = []
    base = rng.normal(size=(n // 4, dim))
    for i in range(n):
        b = base[rng.integers(0, 6 if i % 3 == 0 else len(base))]
        noise = rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.35]) * np.linalg.norm(b) / np.sqrt(dim)
        out.append((i, [float(np.float32(x)) for x in (b + noise) * rng.choice([1.0, 2.0])], int(rng.integers(0, 2))))
    return out


@pytest.mark.parametrize("dim", [64, 10, 3])
def test_links_and_components(spark, dim):
    rows = clouds(900, dim, dim)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    block, size = embeddings.BLOCK, embeddings.LIST_SIZE
    embeddings.BLOCK, embeddings.LIST_SIZE = 100, 60
    try:
        got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    finally:
        embeddings.BLOCK, embeddings.LIST_SIZE = block, size
    want = plain_links(rows)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= n for i, n, _ in want) and found >= 0.995 * sum(n for _, n, _ in want)
    assert sum(got[i].component_id == c for i, _, c in want) >= 0.99 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_a_table_of_the_check(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    more = [(10_000 + i, rows[i % 7][1], rows[i % 7][2]) for i in range(300)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df.unionByName(spark.createDataFrame(more, "vec_id bigint, embedding array<float>, label int"))).collect()}
    for i, n, c in plain_links(rows[:40] + more):
        assert got[i] == (n, c)


def test_awkward_vectors(spark):
    nan, v = float("nan"), [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, nan, 1.0], 1), (8, [1.0, None, 1.0], 1), (9, [float("inf"), 1.0, 1.0], 1), (10, [1.0, 2.0], 1), (11, [1e30, 2e30, 3e30], 1), (12, [1e-30, 2e-30, 3e-30], 1), (13, v, 2), (None, v, 1), (1, v, 1)]
    for kind in ("float", "double"):
        df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumns({c: F.lit(1) for c in ("id", "weight", "list", "dim", "root", "links", "kept")})
        out = embeddings.near_duplicates(df).collect()
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
        assert len(out) == len(rows)
        assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[11] == (4, 1, False) and got[12] == (4, 1, False)
        assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 13)) and got[None] == (0, None, False)
        assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_coding_errors_bound_the_products():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 20))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = embeddings.quantiser(x, 5)
    own, codes, error = q.encode(x)
    for at in range(len(q.centres)):
        mine = np.flatnonzero(own == at)
        assert (np.abs(q.products(x, at, codes[mine]) - x @ x[mine].T) <= error[mine] + 1e-9).all()
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.6
    probes = q.probes(x, own, 0.6)
    assert all(probes[a, own[b]] for a, b in zip(*np.nonzero(near), strict=True))


# Shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    slots = shards.slots(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 1000:
        assert abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.1 and (shards.slots(np.arange(n), n, 8) != slots).mean() > 0.9


def plain_documents(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.word_tokenizer_path())
    return Counter((d.doc_id, (*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2)) for d in docs)


def test_shards_hold_every_document_in_order(sample, awkward, tmp_path):
    for name, docs in (("sample", sample("documents")), ("awkward", awkward.dropDuplicates(["doc_id"]))):
        m, written = shards.materialise(docs.repartition(3), length=64, root=f"file://{tmp_path}/{name}", shard_bytes=20_000)
        rows = list(shards.read(m))
        assert [r[0] for r in rows] == list(range(m.sequences)) and m.shards > 1
        index = {r.slot: r for r in written.collect()}
        parts, short = {}, 0
        for slot, ids in rows:
            at = 0
            for doc_id, start, length in index[slot].docs:
                parts.setdefault(doc_id, []).append((start, tuple(int(x) for x in ids[at : at + length])))
                at += length
            assert at == index[slot].length and not ids[at:].any()
            short += at < 64
        assert short <= 3
        got = Counter()
        for doc_id, found in parts.items():
            whole = []
            for start, ids in sorted(found):
                assert start == len(whole)
                whole += ids
            got[doc_id, tuple(whole)] += 1
        assert got == plain_documents(docs.collect())
        files = sorted(p for p in (tmp_path / name).iterdir() if p.suffix == ".bin")
        assert [p.stat().st_size for p in files] == [m.rows * m.stride] * (m.shards - 1) + [(m.sequences - (m.shards - 1) * m.rows) * m.stride]
        assert not [p for p in (tmp_path / name).iterdir() if p.name.startswith(".shard")]
        for r in list(index.values())[:50]:
            record = files[r.shard].read_bytes()[r.row * m.stride : (r.row + 1) * m.stride]
            assert crc32(record) == r.record_crc32
        later = [(a, b.tolist()) for a, b in shards.read(m, m.sequences // 2, 10)]
        assert later == [(a, b.tolist()) for a, b in rows[m.sequences // 2 :][:10]]


def test_repeated_rows_come_each(awkward, tmp_path):
    m, written = shards.materialise(awkward, length=64, root=f"file://{tmp_path}/all")
    starts = Counter(d.doc_id for r in written.collect() for d in r.docs if d.start == 0)
    assert starts[6] == 2 and sum(starts.values()) == awkward.count()


def test_no_document_no_shard(awkward, tmp_path):
    m, written = shards.materialise(awkward.limit(0), root=f"file://{tmp_path}/none")
    assert m.sequences == 0 and written.count() == 0 and list(shards.read(m)) == []


# Pipeline


def test_stages(spark, sample):
    sf = "/root/testdata/sf0.001"
    docs = sample("documents")
    out, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = corpus_pipeline.quality_stage(spark, out, sf)
    scores = quality.quality_scores(docs, quality.trained(docs, sample("labels")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.where("predicted = 1").collect())
    clean = corpus_pipeline.line_stage(spark, kept, sf)
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == sorted((r.doc_id, r.text) for r in lines.without_boilerplate(kept).collect())
    single = corpus_pipeline.simhash_stage(spark, clean, sf)
    groups = simhash.near_duplicates(clean, width=5).select("component_id").distinct()
    assert sorted(r.doc_id for r in single.collect()) == sorted(r.component_id for r in groups.collect())
    mixed = corpus_pipeline.mixing_stage(spark, single, sf)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies})
    packed = corpus_pipeline.packing_stage(spark, mixed, sf)
    firsts = Counter(r.doc_id for r in packed.where("start = 0").collect())
    assert firsts == copies
    whole = corpus_pipeline.run(spark, sf)
    assert whole.columns == packed.columns and sorted((r.doc_id, r.start, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in packed.collect())


def test_stages_take_awkward_rows(spark, awkward, tmp_path):
    for t in ("labels",):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, awkward, str(tmp_path))
        assert out.columns == awkward.columns, name
        out.collect()
        assert stage(spark, awkward.limit(0), str(tmp_path)).count() == 0
    assert packing.pack(awkward).count() >= awkward.count()


def test_registry():
    assert [q.split("_")[0] for q in registry.QUERIES] == [f"op{i}" for i in range(1, 11)] and set(registry.ORACLES) <= set(registry.QUERIES)
