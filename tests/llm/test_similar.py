import random

import numpy as np

import corpus_pipeline
from ledgerlight.llm import similar, simhash


def words_of(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_kept(rows, least=0.8):
    """doc_ids of the first of each component, all pairs compared, and the pairs that are linked."""
    found, parent, pairs = [words_of(t) for _, t in rows], list(range(len(rows))), []

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for a, s in enumerate(found):
        near = {b for g in s for b in holders.get(g, ())} if s else {b for b in range(a) if not found[b]}
        for b in near:
            if not s or len(s & found[b]) / len(s | found[b]) >= least:
                pairs.append((b, a))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
        for g in s:
            holders.setdefault(g, []).append(a)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i), pairs


def test_fingerprints_are_those_of_simhash():
    for text in ("", "one", "Same text HERE for all", " ".join(f"w{i % 300}" for i in range(900))):
        assert similar.simhash(similar.shingles(text, 5)) == int(np.uint64(simhash.fingerprint(text, 5)).astype(np.int64))


def test_all_documents_against_brute_force(spark, sample):
    docs = sample("documents", "sf0.01")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want, pairs = plain_kept(rows)
    far = [(a, b) for a, b in pairs if (simhash.fingerprint(rows[a][1], 5) ^ simhash.fingerprint(rows[b][1], 5)).bit_count() > 4]
    assert pairs and len(far) >= 1
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect()) == want


def test_copies_with_words_changed(docs):
    """Groups larger than a block, with pairs on both sides of 0.8, and texts of few words."""
    rng = random.Random(5)
    rows = []
    for base in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 12, 60, 200]))]
        for _ in range(90 if base < 3 else 20):
            mine = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                mine[rng.randrange(len(mine))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(mine)))
    want, pairs = plain_kept(rows)
    block, similar.BLOCK = similar.BLOCK, 16
    try:
        got = sorted(r.doc_id for r in similar.deduplicated(docs([(i, t, "a") for i, t in rows])).collect())
    finally:
        similar.BLOCK = block
    assert got == want and 20 < len(want) < len(rows) and len(pairs) > 500


def test_awkward_rows(awkward):
    kept = similar.deduplicated(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 8, 9]
    assert similar.deduplicated(awkward.limit(0)).count() == 0
