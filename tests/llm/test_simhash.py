import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerlight.llm import simhash
from ledgerlight.llm.cluster import Workspace
from ledgerlight.llm.components import components


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots_of(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def near_pairs(prints, bits=4):
    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= bits) + i + 1:
            yield i, int(j)


def test_any_four_positions_hold_a_triple():
    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(four) for t in simhash.TRIPLES) for four in combinations(range(8), 4))


def test_all_documents(sample):
    docs = sample("documents", "sf0.01").select("doc_id", "text").collect()
    prints = [plain_fingerprint(d.text) for d in docs]
    root = roots_of([d.doc_id for d in docs], ((docs[i].doc_id, docs[j].doc_id) for i, j in near_pairs(prints)))
    got = {r.doc_id: r for r in simhash.near_duplicates(sample("documents", "sf0.01")).collect()}
    for d, p in zip(docs, prints, strict=True):
        assert (got[d.doc_id].fingerprint, got[d.doc_id].component_id) == (f"{p:016x}", root[d.doc_id])


def test_links_within_long_lists(spark):
    rng = random.Random(3)
    base, prints = [rng.getrandbits(64) for _ in range(6)], set()
    for b in base:
        for _ in range(900):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    work = Workspace(spark, "test")
    nodes = work.table(spark.createDataFrame([(s,) for s in signed], "fp bigint"), "nodes")
    block, simhash.BLOCK = simhash.BLOCK, 64
    try:
        edges = simhash.links(work, nodes, 4)
        got = {r.node: r.root for r in components(work, edges).collect()}
    finally:
        simhash.BLOCK = block
    want = roots_of(range(len(prints)), near_pairs(prints))
    groups = lambda pairs: sorted(sorted(g) for g in pairs if len(g) > 1)
    mine, theirs = {}, {}
    for i, s in enumerate(signed):
        mine.setdefault(got.get(s, s), []).append(i)
        theirs.setdefault(want[i], []).append(i)
    assert groups(mine.values()) == groups(theirs.values())
    assert edges.count() < 60 * len(prints)


def test_components_of_paths_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randint(5000, 5200), rng.randint(5000, 5200)) for _ in range(150)] + [(7, 7)]
    work = Workspace(spark, "test")
    got = {r.node: r.root for r in components(work, spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = roots_of({x for e in edges for x in e}, edges)
    assert all(got.get(n, n) == r for n, r in want.items())
    assert components(work, spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_awkward_rows(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and {by[i].component_id for i in (1, 2, 3)} == {1}
    assert by[None].component_id == by[5].component_id == by[6].component_id == 5
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 8, 9]
    assert simhash.near_duplicates(awkward.limit(0)).count() == 0 and simhash.deduplicated(awkward.limit(0)).count() == 0


def test_one_of_each_group_stays(sample):
    docs = sample("documents")
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, width=5).collect()}
    kept = simhash.deduplicated(docs, width=5)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(found.values()))
    assert kept.join(docs.withColumnRenamed("text", "was"), "doc_id").where(~F.col("text").eqNullSafe(F.col("was"))).count() == 0
