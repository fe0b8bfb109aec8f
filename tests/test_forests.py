import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewise.operators import forests, learner

from .test_learner import WORDS, good, runs_of


def featured(spark, n):
    rows = learner.described(runs_of(spark, n), WORDS).withColumn("y", good().cast("double"))
    return learner.with_features(rows, learner.context(rows), WORDS).select("run_id", "x", "y")


def voted(rows, packed, depth):
    votes = rows.select("x").distinct().crossJoin(F.broadcast(packed)).select("x", learner.votes("trees", "x", depth).alias("v")).collect()
    return {tuple(r.x): np.array(r.v) for r in votes}


def test_counted_rows_follow_the_law_of_all_rows(spark):
    rows = featured(spark, 900).cache()
    model = learner._forest(rows, 200, 4, 1)
    theirs = voted(rows, learner.packed(learner.nodes_of(model, spark)), 4)
    nodes, importances = forests.grow(rows.groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("forest", F.lit(0)), 200, 4, 2)
    ours = voted(rows, learner.packed(nodes.where("forest = 0")), 4)
    assert len(ours) == len(theirs) > 60 and all(len(v) == 200 for v in ours.values())
    assert max(abs(ours[x].mean() - theirs[x].mean()) for x in ours) < 0.05
    assert 0.85 < np.mean([v.std() for v in ours.values()]) / np.mean([v.std() for v in theirs.values()]) < 1.15
    leaf = nodes.where("feature < 0").select("tree", "id", (F.col("share") > 0.5).alias("p"))
    pairs = nodes.join(leaf.toDF("tree", "left", "a"), ["tree", "left"]).join(leaf.toDF("tree", "right", "b"), ["tree", "right"])
    assert pairs.count() > 0 and pairs.where("a = b").count() == 0  # merged, as Spark's own are
    assert np.abs(np.array(importances[0]) - model.featureImportances.toArray()).max() < 0.06


def test_equal_rows_are_one_and_order_is_nothing(spark):
    rows = featured(spark, 500).select(F.lit(3).alias("forest"), "x", "y")
    met = rows.groupBy("forest", "x", "y").agg(F.count("*").alias("n"))
    bag = forests.bagged(rows.withColumn("n", F.lit(1)), 60, 5)
    assert bag.count() == 3 * met.count() < 500 and [r[0] for r in bag.select(F.size("taken")).distinct().sort("size(taken)").collect()] == [10, 25]
    taken = np.array([r.taken for r in bag.where("block = 0").sort("x", "y").collect()])
    n = np.array([r.n for r in met.sort("x", "y").collect()])
    assert abs(taken.sum() / (25 * 500) - 1) < 0.04 and 0.85 < ((taken - n[:, None]) ** 2 / n[:, None]).mean() < 1.15
    one, two = (sorted(forests.grow(r, 30, 4, 5)[0].collect()) for r in (rows.withColumn("n", F.lit(1)).repartition(7), met))
    assert one == two and {r.forest for r in one} == {3}


def test_splits_are_the_best_ones(spark):
    draw = np.random.RandomState(1)
    rows = [(0, [float(a), float(b)], float(draw.rand() < 0.2 + 0.1 * a), int(n)) for a, b, n in zip(draw.randint(0, 6, 80), draw.randint(0, 4, 80), draw.randint(1, 9, 80))]
    table = spark.createDataFrame(rows, "forest int, x array<double>, y double, n long")
    nodes, _ = forests.grow(table, 3, 2, 9)
    bag = forests.bagged(table, 3, 9).collect()
    good_share = sum(n * y for _, _, y, n in rows) / sum(n for *_, n in rows)
    weigh = lambda rs, t: np.array([sum(r.taken[t] * (r.y == y) for r in rs) for y in (0, 1)]) * (0.5 / (1 - good_share), 0.5 / good_share)
    impure = lambda c: 2 * c[0] * c[1] / max(c.sum(), 1e-300)
    for t in range(3):
        tree = {r.id: r for r in nodes.where(F.col("tree") == t).collect()}
        assert sorted(tree) == list(range(len(tree)))
        stack = [(tree[0], [r for r in bag if r.taken[t]], 0)]
        while stack:
            node, met, level = stack.pop()
            assert node.share == pytest.approx(weigh(met, t)[1] / weigh(met, t).sum())
            parts = lambda j, c: ([r for r in met if r.x[j] <= c], [r for r in met if r.x[j] > c])
            gain = lambda j, c: impure(weigh(met, t)) - sum(impure(weigh(p, t)) for p in parts(j, c))
            best = max(gain(j, c + 0.5) for j in (0, 1) for c in range(6))
            if node.feature < 0:
                merged = [[weigh(p, t)[1] > weigh(p, t)[0] for p in parts(j, c + 0.5)] for j in (0, 1) for c in range(6) if gain(j, c + 0.5) > best - 1e-9]
                assert level == 2 or best < 1e-9 or any(a == b for a, b in merged)
                continue
            assert gain(node.feature, node.threshold) == pytest.approx(best)
            left, right = parts(node.feature, node.threshold)
            stack += [(tree[node.left], left, level + 1), (tree[node.right], right, level + 1)]


def test_cuts_leave_bins_of_equal_numbers(spark):
    rows = spark.createDataFrame([(0, [float(k % 3), k / 7], 0.0, 1 + (k == 5) * 300) for k in range(1000)], "forest int, x array<double>, y double, n long")
    found = [sorted(r.cut for r in forests.cuts(forests.bagged(rows, 2, 1)).where(F.col("feature") == j).collect()) for j in (0, 1)]
    assert found[0] == [0.5, 1.5] and 20 < len(found[1]) < forests.BINS
    inside = np.histogram([k / 7 for k in range(1000) if k != 5], [-1, *found[1], 200])[0]
    assert inside.max() <= 2 * 1300 / forests.BINS


def test_sigmoid_of_counted_scores(spark):
    rows = [(k % 5 / 5, float(k * 7 % 10 < 2 + k % 5), 1) for k in range(200)]
    each = spark.createDataFrame(rows, "score double, y double, n long")
    assert learner.sigmoid(each.groupBy("score", "y").agg(F.sum("n").alias("n"))) == pytest.approx(learner.sigmoid(each), abs=1e-6)


def test_runs_without_concepts_are_judged(spark):
    runs = runs_of(spark, 60).withColumn("idea", F.lit("nothing known"))
    model = learner.fit(runs, good(), WORDS, trees=4, depth=2)
    assert model.scores.where("prob > 0 and prob < 1").count() == 60 and all(f.ctx.count() == f.trees.count() == 1 for f in [*model.folds, model.base])


def test_forests_meet_runs_as_counted_kinds(spark, monkeypatch):
    """what the forests are grown on does not grow with the number of runs."""
    met = []
    monkeypatch.setattr(learner, "grow", lambda rows, *how: met.append(rows.count()) or forests.grow(rows, *how))
    runs = runs_of(spark, 150)
    many = runs.unionByName(runs.withColumn("run_id", F.col("run_id") + 1000)).unionByName(runs.withColumn("run_id", F.col("run_id") + 2000))
    kinds = learner.described(runs, WORDS).select("concepts", "sessions", good()).distinct().count()
    assert learner.fit(many, good(), WORDS, trees=2, depth=2).scores.count() == 450
    assert met[0] <= 16 * kinds  # in five forests three folds each, in one all five


def test_known_texts_are_described_once(spark, monkeypatch):
    """what novelty is measured against does not grow with the runs of one text, nor do the rows that forests and sigmoids meet."""
    met, fitted, novelty, sigmoid = [], [], learner.novelty, learner.sigmoid
    monkeypatch.setattr(learner, "novelty", lambda ideas, known: met.append(known.count()) or novelty(ideas, known))
    monkeypatch.setattr(learner, "sigmoid", lambda scores: fitted.append(scores.count()) or sigmoid(scores))
    runs = runs_of(spark, 80)
    many = runs.unionByName(runs.withColumn("run_id", F.col("run_id") + 1000)).unionByName(runs.withColumn("run_id", F.col("run_id") + 2000))
    kinds = learner.described(runs, WORDS).select("concepts", "sessions", good()).distinct().count()
    model = learner.fit(many, good(), WORDS, trees=2, depth=2)
    found = learner.judged(model, many.select("idea").distinct().withColumn("id", F.col("idea")).union(spark.createDataFrame([(None, "none")], "idea string, id string")), many)
    assert met == [runs.select("idea").distinct().count()] and max(fitted) <= kinds < 100
    assert {r.id == "none" for r in found.where("novelty > 0").collect()} == {True} and found.count() == met[0] + 1
