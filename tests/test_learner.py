import itertools
import math
import random

import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tapewise.operators import learner

WORDS = ("BOS", "FVG", "SWEEP", "OTE", "NDOG")


def runs_of(spark, n, seed=1):
    """Runs whose tier hangs on two of five concepts and on chance."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        words = draw.sample(WORDS, draw.randint(1, 4))
        good = draw.random() < 0.15 + 0.5 * ("BOS" in words) + 0.25 * ("FVG" in words)
        rows.append((k, " + ".join(words) + " " + draw.choice(learner.SESSIONS), 2.1 if good else 0.9, 30.0, None, "A" if good else "C"))
    return spark.createDataFrame(rows, "run_id long, idea string, avg_pf double, avg_trades double, mc double, tier string")


def good():
    return F.col("tier").isin("A", "B")


def test_described_takes_whole_words(spark):
    rows = spark.createDataFrame([(1, "smc_bos + fvg ny"), (2, None), (3, "BOS+BOS  london"), (4, "")], "id long, idea string")
    got = {r.id: (r.concepts, r.sessions) for r in learner.described(rows).collect()}
    assert got == {1: (["FVG", "SMC_BOS"], ["NY"]), 2: ([], []), 3: (["BOS"], ["LONDON"]), 4: ([], [])}


@pytest.fixture(scope="module")
def fitted(spark):
    runs = runs_of(spark, 400)
    return runs, learner.fit(runs, good(), WORDS, trees=20, depth=4)


def test_votes_are_the_models(spark):
    rows = learner.with_features(learner.described(runs_of(spark, 200), WORDS), learner.context(learner.described(runs_of(spark, 200), WORDS)), WORDS)
    model = learner._forest(rows.withColumn("y", good().cast("double")), 10, 4, 1)
    own = rows.crossJoin(F.broadcast(learner.packed(learner.nodes_of(model, spark)))).select("run_id", "x", learner._mean(learner.votes("trees", "x", 4)).alias("score"))
    both = model.transform(own.withColumn("features", array_to_vector("x"))).withColumn("p", vector_to_array("probability")[1])
    assert both.count() == 200 and both.where("abs(score - p) > 1e-9").count() == 0


def test_no_run_is_scored_by_what_saw_it(spark, fitted):
    runs, model = fitted
    scores = model.scores.collect()
    assert len(scores) == len({r.run_id for r in scores}) == 400 and {r.fold for r in scores} == set(range(5))
    fold = {r.run_id: r.fold for r in scores}
    # a run's good luck must not reach its own score: with its tier turned over, it stays the same
    turned = runs.withColumn("tier", F.when(F.col("run_id") == 7, F.when(good(), "C").otherwise("A")).otherwise(F.col("tier"))).withColumn("avg_pf", F.when(F.col("run_id") == 7, 3 - F.col("avg_pf")).otherwise(F.col("avg_pf")))
    again = {r.run_id: r for r in learner.fit(turned, good(), WORDS, trees=20, depth=4).scores.collect()}
    before = {r.run_id: r for r in scores}
    assert again[7].score == before[7].score and again[7].prob == pytest.approx(before[7].prob, abs=1e-9)
    assert any(again[k].score != before[k].score for k in fold if (fold[k] - fold[7]) % 5 > 1)


def test_probabilities_are_calibrated(fitted):
    row = learner.brier(fitted[1].scores).first()
    assert row.runs == 400 and row.brier < row.brier_of_share - 0.01
    by = fitted[1].scores.groupBy((F.col("prob") > 0.5).alias("high")).agg(F.avg("prob").alias("p"), F.avg("y").alias("y")).collect()
    assert all(abs(r.p - r.y) < 0.1 for r in by)


def test_few_runs(spark):
    with pytest.raises(ValueError, match="20 runs"):
        learner.fit(runs_of(spark, 19), good(), WORDS)
    few = runs_of(spark, 30).withColumn("tier", F.when(F.col("run_id") < 2, "A").otherwise("C"))
    got = learner.fit(few, good(), WORDS, trees=5, depth=2)
    assert len(got.folds) == 1 and got.scores.where("prob > 0 and prob < 1").count() == 30


def test_judged_ideas(spark, fitted):
    runs, model = fitted
    ideas = spark.createDataFrame([("good", "BOS + FVG NY"), ("bad", "OTE LONDON"), ("none", "nothing known"), ("null", None)], "id string, idea string")
    got = {r.id: r for r in learner.judged(model, ideas, runs).collect()}
    assert got["good"].prob > 0.6 > 0.4 > got["bad"].prob and got["bad"].band == "reject" and got["good"].top == "BOS" and got["none"].top == "-"
    assert got["good"].novelty == 0 and got["none"].novelty == 1 and 0 <= got["good"].uncertainty <= 0.5
    assert all(r.band == ("reject" if r.prob < 0.4 else "queue" if r.prob >= 0.65 and r.uncertainty <= 0.25 else "review") for r in got.values())


@pytest.mark.parametrize("subsets", [10, 2])
def test_novelty_equals_brute_force(spark, monkeypatch, subsets):
    monkeypatch.setattr(learner, "SUBSETS", subsets)
    draw = random.Random(subsets)
    words = [f"w{i}" for i in range(9)]
    ideas = [(k, draw.sample(words, draw.randint(0, 5))) for k in range(60)] + [(60, ["w1", "w1"])]
    known = [(draw.sample(words, draw.choice([1, 2, 4, 6])),) for _ in range(25)]
    got = learner.novelty(spark.createDataFrame(ideas, "id long, concepts array<string>"), spark.createDataFrame(known, "concepts array<string>"))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    assert {r.id: r.novelty for r in got.collect()} == {k: round(1 - max(jaccard(set(s), set(t)) for (t,) in known), 4) for k, s in ideas}
    nothing = spark.createDataFrame([], "concepts array<string>")
    assert [r.novelty for r in learner.novelty(spark.createDataFrame(ideas[:3], "id long, concepts array<string>"), nothing).collect()] == [1.0] * 3
    empty = spark.createDataFrame([([],)], "concepts array<string>")
    assert [r.novelty for r in learner.novelty(spark.createDataFrame([(1, [])], "id long, concepts array<string>"), empty).collect()] == [0.0]


def test_explored(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2900, "a").otherwise("b").alias("g"), (F.col("id") % 3).cast("double").alias("w"))
    got = learner.explored(rows, "g", 40).collect()
    assert {(r.g, r.place) for r in got} == {(g, k) for g in "ab" for k in range(1, 41)}
    assert sorted(got) == sorted(learner.explored(rows.repartition(7), "g", 40).collect())
    other = learner.explored(rows, "g", 40, seed=5).collect()
    assert {r.id for r in other} != {r.id for r in got}
    weighted = learner.explored(rows, "g", 300, weight="w").where("g = 'a'").collect()
    heavy = sum(r.w == 2 for r in weighted)
    assert len(weighted) == 300 and not any(r.w == 0 for r in weighted) and 160 < heavy < 240
    plan = learner.explored(rows, "g", 40)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_suggestions(spark):
    draw = random.Random(2)
    rows = [("s", k, draw.sample(WORDS, 2), k / 100) for k in range(100)]
    got = learner.suggestions(spark.createDataFrame(rows, "session string, id long, tokens array<string>, p double"), "session", 10).collect()
    exploit, explore = [r for r in got if r.kind == "exploit"], [r for r in got if r.kind == "explore"]
    assert len(exploit) == 7 and len(explore) == 3 and len({r.id for r in got}) == 10 and min(r.p for r in exploit) >= 0.4 and exploit[0].id == 99
    few = learner.suggestions(spark.createDataFrame(rows[:2], "session string, id long, tokens array<string>, p double"), "session", 10).collect()
    assert sorted(r.id for r in few) == [0, 1] and {r.kind for r in few} == {"explore"}  # none is probable enough


def brute_shapley(nodes, weights, x):
    """Shapley values by all coalitions of the features; a split on a missing feature follows both branches by their rows."""
    trees = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.id] = n
    features = range(len(x))

    def value(tree, at, known):
        n = tree[at]
        if n.feature < 0:
            return n.value
        if n.feature in known:
            return value(tree, n.left if x[n.feature] <= n.threshold else n.right, known)
        return (tree[n.left].rows * value(tree, n.left, known) + tree[n.right].rows * value(tree, n.right, known)) / n.rows

    def game(known):
        return sum(w * value(trees[t], 0, known) for t, w in enumerate(weights))

    phi = []
    for f in features:
        rest = [g for g in features if g != f]
        total = 0.0
        for size in range(len(rest) + 1):
            weight = math.factorial(size) * math.factorial(len(x) - size - 1) / math.factorial(len(x))
            total += sum(weight * (game({*s, f}) - game(set(s))) for s in itertools.combinations(rest, size))
        phi.append(total)
    return phi, game(set())


def test_attributions_equal_all_coalitions(spark):
    draw = random.Random(9)
    data = []
    for k in range(300):
        x = [float(draw.randint(0, 1)), draw.random(), draw.random(), float(draw.randint(0, 3)), draw.random()]
        data.append((k, x, x[0] * x[1] + (x[2] > 0.5) * x[3] + 0.1 * draw.random()))
    rows = spark.createDataFrame(data, "run_id long, x array<double>, label double")
    nodes, weights, model = learner.boosted(rows, trees=6)
    found = learner.attributions(nodes, weights, rows)
    phi = {}
    for r in found.rows.collect():
        phi.setdefault(r.run_id, {})[r.feature] = r.phi
    predicted = {r.run_id: r.prediction for r in model.transform(rows.withColumn("features", array_to_vector("x"))).collect()}
    assert all(abs(sum(phi[k].values()) + found.base - predicted[k]) < 1e-9 for k in predicted)
    kept = nodes.collect()
    for k, x, _ in data[:25]:
        want, base = brute_shapley(kept, weights, x)
        assert base == pytest.approx(found.base, abs=1e-9) and [phi[k].get(f, 0.0) for f in range(5)] == pytest.approx(want, abs=1e-9)
    table = {r.token: r.weight for r in learner.mean_attribution(found, list("abcde"), 300).collect()}
    assert table["a"] == pytest.approx(sum(abs(p.get(0, 0.0)) for p in phi.values()) / 300, abs=1e-6) and set(table) == set("abcde")
    with pytest.raises(ValueError):
        learner.attributions(nodes, weights, rows, depth=4)
