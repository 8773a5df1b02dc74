import zlib

import numpy as np
import pyarrow as pa

from ledgerlight.llm import features, learning, quality, toxicity


def test_held_out_rows_are_those_of_the_checksum(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500).select(F.col("id").alias("doc_id"), learning.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_held_out_quality(sample):
    docs, labels = sample("documents", "sf0.1"), sample("labels", "sf0.1")
    out = quality.quality_scores(docs, quality.trained(docs, labels)).cache()
    assert out.count() == docs.count() and out.where("score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    seen = out.where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.predicted for r in seen if r.quality == 1], [r.predicted for r in seen if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.1
    clean = np.array([r.score for r in seen if r.quality == 1])
    junk = np.array([r.score for r in seen if r.quality == 0])
    assert (clean[:, None] > junk[None, :]).mean() > 0.99


def test_held_out_labels_are_not_learnt(sample, spark):
    from pyspark.sql import functions as F

    docs, labels = sample("documents"), sample("labels")
    turned = labels.withColumn("quality", F.when(learning.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality.quality_scores(docs, quality.trained(docs, x)).collect()) for x in (labels, turned))
    assert a == b


def test_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y = np.array([int(0 in r or (3 in r and 5 not in r)) for r in x])
    ratio = rng.normal(1, 0.3, 12)
    w = quality.coordinate_descent(x, y, ratio, 1.0, 2000)
    cost, sign = len(y) / (2 * np.where(y == 1, (y == 1).sum(), (y == 0).sum())), np.where(y == 1, 1, -1)
    dense = np.zeros((80, 13))
    for i, r in enumerate(x):
        dense[i, r], dense[i, 12] = ratio[r], 1
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - sign * (dense @ v))).sum()
    assert all(loss(w) <= loss(w + rng.normal(0, s, 13)) + 1e-6 for s in (0.3, 0.05, 0.01) for _ in range(100))


def test_log_count_ratios():
    x, y = [np.array([0, 1]), np.array([0]), np.array([1])], np.array([1, 1, 0])
    assert np.allclose(quality.log_count_ratios(x, y, 2), [np.log(3 / 5) - np.log(1 / 3), np.log(2 / 5) - np.log(2 / 3)])


def test_features_are_of_whole_texts_and_do_not_depend_on_the_batch():
    texts = ["The cat  cat $$$ sat", "", None, "é ÉÉÉ 42 a-b " * 3000, "The cat cat $$$ sat"]
    row, feature = features.indicators(texts, heads=True)
    alone = [features.indicators([t], heads=True)[1] for t in texts]
    assert all((feature[row == i] == f).all() and len(f) == (row == i).sum() for i, f in enumerate(alone))
    assert (alone[0] == alone[4]).all() and not len(alone[1]) and features.REPEATED in alone[0]
    assert features.shape("Hello!!!") == "Aa!" and features.shape("ABC12--x") == "A9-a"
    assert [(a, len(t)) for a, t in features.blocks(pa.array(texts), 30)] == [(0, 3), (3, 1), (4, 1)]


def test_models_without_labels(awkward, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    out = quality.quality_scores(awkward, quality.trained(awkward, none)).collect()
    assert len(out) == awkward.count() and {r.score for r in out} == {0.5} and not [r for r in out if r.doc_id is None and r.held_out]
    flat = toxicity.severities(awkward, toxicity.trained(awkward, none)).collect()
    assert len(flat) == awkward.count() and all(r.severity < 0.01 and r.toxic == 0 for r in flat)
    odd = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (9, None, None), (8, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    for f in (lambda d: quality.quality_scores(d, quality.trained(d, odd)), lambda d: toxicity.severities(d, toxicity.trained(d, odd))):
        assert f(awkward).count() == awkward.count()
        assert f(awkward.limit(0)).count() == 0
    kept = quality.accepted(awkward, quality.trained(awkward, none), 0.4)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() and quality.accepted(awkward, quality.trained(awkward, none)).count() == 0


def test_held_out_toxicity(sample):
    docs, labels = sample("documents", "sf0.1"), sample("labels", "sf0.1")
    out = toxicity.severities(docs, toxicity.trained(docs, labels)).where("held_out").join(labels.withColumnRenamed("toxic", "marked"), "doc_id").collect()
    caught = np.mean([r.toxic for r in out if r.marked == 1])
    wrong = np.mean([r.toxic for r in out if r.marked == 0])
    assert caught > 0.85 and wrong < 0.02
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in out)


def test_ordered_grades():
    rng = np.random.default_rng(5)
    strength = rng.integers(0, 6, 600)
    x = [np.unique(np.concatenate((np.arange(s), rng.integers(100, 130, 5)))).astype(np.uint32) for s in strength]
    y = np.digitize(strength, [2, 4])
    model = toxicity.fit(y, x, penalty=0.1)
    assert model.thresholds == sorted(model.thresholds) and len(model.thresholds) == 2
    at = [np.isin(model.linear.features, r) for r in x]
    margin = np.array([model.linear.weights[a].sum() for a in at])
    expected = sum(1 / (1 + np.exp(t - margin)) for t in model.thresholds)
    assert np.corrcoef(expected, y)[0, 1] > 0.9


def test_weights_and_thresholds_are_at_the_optimum():
    rng = np.random.default_rng(8)
    y = np.concatenate((np.arange(4), rng.integers(0, 4, 196)))
    rows = [np.unique(np.append(rng.integers(0, 12, 3), k)) for k in y]
    data = toxicity.Graded(y, rows, 12, 3)
    at = toxicity.optimum(data, 0.5)

    def loss(params):
        total = 0.25 * (params[:12] ** 2).sum()
        for k, row in zip(y, rows):
            chance = np.concatenate(([0], 1 / (1 + np.exp(params[row].sum() - params[12:])), [1]))
            total -= np.log(chance[k + 1] - chance[k])
        return total

    best = loss(at)
    assert abs(data.loss(at) + 0.25 * (at[:12] ** 2).sum() - best) < 1e-9 and (np.diff(at[12:]) > 0).all()
    for i in range(len(at)):
        for far in (-1e-3, 1e-3):
            assert loss(at + far * np.eye(len(at))[i]) > best


def test_grades_that_no_row_has():
    x = [np.array([1, 2 + k % 2], np.uint32) for k in range(40)]
    y = np.array([1 if k % 2 else 3 for k in range(40)])
    model = toxicity.fit(y, x, most=10)
    low, mid, high = model.thresholds
    assert low < -50 and mid == high and len(model.linear.features) == 3


def test_the_number_of_features_is_that_of_the_likeliest_left_out_rows(monkeypatch):
    monkeypatch.setattr(toxicity, "CHOICES", (2, 40, 300))
    rng = np.random.default_rng(3)
    y = np.arange(120) % 2
    rows = [np.unique(np.concatenate((rng.choice(30, 6) + 30 * k, rng.integers(60, 300, 20)))) for k in y]
    size, loss = 300, []
    for most in toxicity.CHOICES:
        total = 0.0
        for part in range(5):
            out = np.arange(120) // 2 % 5 == part
            kept, place = toxicity.fewer([r for r, o in zip(rows, out) if not o], y[~out], size, most)
            at = toxicity.optimum(toxicity.Graded(y[~out], toxicity.renamed([r for r, o in zip(rows, out) if not o], place), len(kept), 1), 0.3)
            for k, row in zip(y[out], [r for r, o in zip(rows, out) if o]):
                p = 1 / (1 + np.exp(at[-1] - sum(at[place[f]] for f in row if place[f] >= 0)))
                total -= np.log(p if k else 1 - p)
        loss.append(total)
    assert toxicity.chosen(y, rows, size, 1, 0.3) == toxicity.CHOICES[int(np.argmin(loss))] == 40
    assert toxicity.chosen(y[:8], rows[:8], size, 1, 0.3) == 300  # four rows of a grade choose nothing
