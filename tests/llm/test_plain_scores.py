"""The two classifiers' queries against plain versions: every score, from texts and labels, with no code of the operators."""

import zlib
from collections import Counter
from itertools import groupby, pairwise

import numpy as np
import pytest

from ledgerlight.llm import features, quality, toxicity


def kinds(word):
    out = ""
    for kind, run in groupby(word, lambda c: "9" if c.isdecimal() else "a" if c.isalnum() else c + "!"):
        run = "".join(run)
        if kind == "a":
            out += "A" if run.isupper() else "a" if run.islower() else "Aa" if run[0].isupper() else "aA"
        else:
            out += kind[0]
    return out


def traits(text, heads=False):
    """The indicators of a text, by name."""
    raw = (text or "").encode().split()
    words, forms = [w.lower().decode() for w in raw], [kinds(w.decode()) for w in raw]
    out = {("word", w) for w in words} | {("form", f, f) for f in forms}
    out |= {("pair", *p) for p in pairwise(words)} | {("form", *p) for p in pairwise(forms)}
    out |= {("three", *t) for t in zip(forms, forms[1:], forms[2:])}
    out |= {("again",) for a, b in pairwise(words) if a == b}
    if heads:
        out |= {("head", k, s[:k]) for s in (w.decode().lower() for w in raw) for k in (5, 7) if len(s) > k}
    return out


def number(trait):
    """The 32 bits that stand for an indicator. Some indicators share theirs, and a fit on few rows feels one such pair."""

    def mixed(a, b, kind):
        x = (a * features.LEFT + b * features.RIGHT + kind) % 2**32
        return (x ^ x >> 15) * kind % 2**32

    kind, *rest = trait
    if kind == "again":
        return features.REPEATED
    if kind == "head":
        return zlib.crc32(rest[1].encode() + bytes((255, rest[0])))
    if kind in ("word", "pair"):
        codes = [zlib.crc32(w.encode()) for w in rest]
        return codes[0] if kind == "word" else mixed(*codes, features.DOUBLED)
    codes = [zlib.crc32(f.encode(), 7) for f in rest]
    two = mixed(codes[0], codes[1], features.SHAPED)
    return mixed(two, codes[2], features.TRIPLED) if kind == "three" else two


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def learnt(docs, labels, heads=False):
    """(label, indicators that five rows have) of the labelled rows, in the order of doc_id."""
    texts = {r.doc_id: r.text for r in docs}
    rows = sorted((d, y) for d, y in labels if d in texts and y is not None and not held(d))
    found = [(y, {number(t) for t in traits(texts[d], True)} if heads else traits(texts[d])) for d, y in rows]
    seen = Counter(t for _, one in found for t in one)
    return [(y, sorted(t for t in one if seen[t] >= 5)) for y, one in found]


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def plain_quality(docs, labels):
    rows = learnt(docs, labels)
    apart, count = [], Counter()
    for y, _ in rows:
        apart.append(count[y] % 5 == 0)
        count[y] += 1
    assert min(count.values()) >= 10
    part = [r for r, a in zip(rows, apart) if not a]
    names = {t for _, one in rows for t in one}
    sums = [Counter(t for y, one in part if y == k for t in one) for k in (1, 0)]
    totals = [sum(s[t] + 1 for t in names) for s in sums]
    ratio = {t: np.log((sums[0][t] + 1) / totals[0]) - np.log((sums[1][t] + 1) / totals[1]) for t in names}
    w, bias, alpha, rng = dict.fromkeys(names, 0.0), 0.0, [0.0] * len(part), np.random.default_rng(1)
    cost = {k: 0.02 * len(part) / (2 * sum(y == k for y, _ in part)) for k in (0, 1)}
    for _ in range(30):
        most = 0.0
        for i in rng.permutation(len(part)):
            y, one = part[i]
            sign = 1 if y else -1
            slack = sign * (bias + sum(w[t] * ratio[t] for t in one)) - 1
            new = min(max(alpha[i] - slack / (1 + sum(ratio[t] ** 2 for t in one)), 0.0), cost[y])
            step, alpha[i] = new - alpha[i], new
            bias += step * sign
            for t in one:
                w[t] += step * sign * ratio[t]
            most = max(most, abs(step))
        if most < 1e-3:
            break
    margin = lambda one: bias + sum(w[t] * ratio[t] for t in one if t in w)
    check = [(margin(one), y) for (y, one), a in zip(rows, apart) if a]
    up, down = sum(y for _, y in check), sum(1 - y for _, y in check)
    m, goal = np.array([z for z, _ in check]), np.array([(up + 1) / (up + 2) if y else 1 / (down + 2) for _, y in check])
    scale, at = np.abs(m).mean(), np.zeros(2)
    for _ in range(2000):  # damped Newton steps to the optimum
        p = logistic(at[0] * m / scale + at[1])
        grad = np.array([((goal - p) * m / scale).sum(), (goal - p).sum()]) - 1e-4 * at
        x = np.stack([m / scale, np.ones(len(m))])
        at = at + 0.2 * np.linalg.solve((x * p * (1 - p)) @ x.T + 1e-4 * np.eye(2), grad)
    return {r.doc_id: logistic(at[0] / scale * margin(traits(r.text)) + at[1]) for r in docs}


def plain_toxicity(docs, labels, penalty=0.3):
    """Chances of being toxic at the fit's optimum, where each weight is the sum of its rows' errors over the penalty: Newton steps on the rows' margins."""
    rows = learnt(docs, labels, heads=True)
    sets, y = [set(one) for _, one in rows], np.array([float(k) for k, _ in rows])
    shared = np.array([[len(a & b) for b in sets] for a in sets]) / penalty
    margin, cut = np.zeros(len(y)), np.log(1 / y.mean() - 1)
    gap = lambda m, c: np.append(m - shared @ (y - logistic(m - c)), (y - logistic(m - c)).sum())
    for _ in range(200):
        left = gap(margin, cut)
        if np.abs(left).max() < 1e-11:
            break
        p = logistic(margin - cut)
        bend = p * (1 - p)
        slope = np.block([[np.eye(len(y)) + shared * bend, -(shared @ bend)[:, None]], [-bend[None, :], np.array([[bend.sum()]])]])
        step, part = np.linalg.solve(slope, left), 1.0
        while part > 1e-6 and np.linalg.norm(gap(margin - part * step[:-1], cut - part * step[-1])) > np.linalg.norm(left):
            part /= 2
        margin, cut = margin - part * step[:-1], cut - part * step[-1]
    assert np.abs(left).max() < 1e-8
    weight = Counter()
    for one, error in zip(sets, y - logistic(margin - cut)):
        for t in one:
            weight[t] += error / penalty
    return {r.doc_id: logistic(sum(weight[t] for t in {number(t) for t in traits(r.text, heads=True)} if t in weight) - cut) for r in docs}


@pytest.fixture
def rows(spark):
    def read(sf):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        return docs, labels, docs.select("doc_id", "text").collect(), labels.collect()

    return read


def test_every_quality_score(spark, rows):
    _, _, docs, labels = rows("sf0.01")
    plain = plain_quality(docs, [(r.doc_id, r.quality) for r in labels])
    got = quality.op2_quality(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs) and all(r.held_out == held(r.doc_id) for r in got)
    assert max(abs(r.score - plain[r.doc_id]) for r in got) < 1e-6
    assert all(r.predicted == (r.score >= 0.7) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_chance_of_being_toxic(rows, sf):
    table, marks, docs, labels = rows(sf)
    plain = plain_toxicity(docs, [(r.doc_id, r.toxic) for r in labels])
    got = toxicity.severities(table, toxicity.trained(table, marks, kept=1 << 40)).collect()  # no indicator goes
    assert len(got) == len(docs) and all(r.severity == r.p_toxic and r.toxic == r.grade == (r.p_toxic >= 0.3) for r in got)
    assert max(abs(r.p_toxic - plain[r.doc_id]) for r in got) < 1e-6


def test_indicators_are_those_of_the_plain_version(rows):
    texts = [r.text for r in rows("sf0.01")[2]]
    for heads in (False, True):
        row, _ = features.indicators(texts, heads=heads)
        assert np.bincount(row, minlength=len(texts)).tolist() == [len(traits(t, heads)) for t in texts]


def test_a_head_is_not_another_word():
    word = chr(ord("h") ^ 5) + "ellow"[:4]
    a, b = (set(features.indicators([t], heads=True)[1].tolist()) for t in ("hellowed", word))
    assert not a & b - set(features.indicators(["hello"])[1].tolist())
