import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerlight.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight, stopped sources taken out one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs, got, near):
    rows = {r.doc_id: r for r in got}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += words(r.text)
    want, taken = plain_targets(sizes), defaultdict(int)
    for r in docs:
        mine = rows[r.doc_id]
        assert (mine.size, mine.source_size) == (words(r.text), sizes[r.source])
        assert math.isclose(mine.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= mine.taken <= 3 * mine.size and (mine.size == 0 or mine.taken % mine.size == 0)
        taken[r.source] += mine.taken
    for s, total in taken.items():
        assert abs(total - want[s]) <= max(near * want[s], 2)
    assert math.isclose(sum(want.values()), sum(sizes.values()), rel_tol=1e-9)


def test_targets_and_takes(spark, sample):
    docs = sample("documents", "sf0.01")
    got = mixing.mix(docs).collect()
    check(docs.collect(), got, 0.02)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_a_source_that_stops_gives_its_rest_to_the_others(docs):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "zabcd"[i % 5] if i % 40 == 0 else "d") for i in range(600)]
    df = docs(rows)
    check(df.collect(), mixing.mix(df).collect(), 0.05)


def test_rates_are_exponential_tilts(docs):
    rows = [(i, " ".join(["w"] * (1 + i % 30)), "ab"[i % 2]) for i in range(2000)]
    got = mixing.mix(docs(rows)).where("size > 0 and rate < 2.9999").collect()
    for s in "ab":
        slopes = {round(math.log(r.rate) / r.size, 9) for r in got if r.source == s}
        assert len(slopes) == 1


def test_awkward_rows(awkward):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].size == 0 and by[1][0].taken == 0 and len(by[6]) == 2 and by[6][0] == by[6][1]
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns
    want = {(r.doc_id, r.source, r.size): r.copies for r in got}
    counts = {(r.doc_id, r.source, r.w): r.n for r in out.groupBy("doc_id", "source", mixing.words(F.col("text")).alias("w")).agg(F.count("*").alias("n")).collect()}
    for key, copies in want.items():
        assert counts.get(key, 0) == copies * (2 if key[0] == 6 else 1), key
    assert mixing.mix(awkward.limit(0)).count() == 0 and mixing.mixed(awkward.limit(0)).count() == 0


def test_no_python_runs(sample):
    plan = mixing.mix(sample("documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
