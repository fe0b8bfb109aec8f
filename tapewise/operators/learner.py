"""What the registry of runs teaches about ideas: calibrated probabilities, doubts, novelty, which ideas to try next, and what a fitted tree model relies on.

Fitted trees are read as tables of nodes and walked inside SQL expressions, so every vote and every attribution of a row is there. A model has a bounded number of
nodes (its parameters fix it) and travels as one row.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import drawn
from ..sources.store import remove, shared_dir, stage
from .forests import grow
from .registry import alike
from .reviews import diverse

#: The concepts and sessions that ideas are described by, and the bands of a suggestion.
CONCEPTS = (
    "BOS", "CHOCH", "MSS", "DISPLACEMENT", "FAILURE_SWING", "FVG", "OB", "MB", "IFVG", "BPR", "BREAKER", "RB", "VB", "PB", "VI", "FIRST_FVG", "OPENING_RANGE",
    "POST_FVG", "SWEEP", "ERL", "IRL", "CE", "REH", "REL", "OTE", "JUDAS", "SILVER_BULLET", "MMXM", "AMD", "MANIP", "CBDR", "CISD", "NDOG", "NWOG", "SMC_BOS",
    "HURST", "GARCH", "KALMAN", "REGIME", "CHANGEPOINT", "ENTROPY", "CUSUM", "SHANNON_CAPACITY", "PRIGOGINE", "KILLZONE", "MACRO_TIMING", "SESSION_TIMING",
    "NARRATIVE", "LIQUIDITY_BIAS", "PREMIUM", "DISCOUNT", "DEALING_RANGE", "CONSOLIDATION", "EXPANSION", "DRAWN_LIQUIDITY", "MARKTPHASE", "SESSION_BIAS",
)
SESSIONS = ("NY", "LONDON", "ASIA")
REJECT, QUEUE, DOUBT = 0.40, 0.65, 0.25
LEAST_RUNS = 20
#: What a concept that no run names counts as: profit factor, trades, share of profitable resamples.
NEUTRAL = {"avg_pf": 1.0, "avg_trades": 0.0, "mc": 0.5}
#: Largest set of concepts whose subsets are written out; larger ones meet through a common concept.
SUBSETS = 10


def described(ideas: DataFrame, concepts: Sequence[str] = CONCEPTS, sessions: Sequence[str] = SESSIONS, idea: str = "idea") -> DataFrame:
    """``ideas`` with ``concepts`` (those that the text names as whole words, in the order of the list) and ``sessions``; null texts name none."""
    words = F.split(F.upper(F.coalesce(F.col(idea), F.lit(""))), r"[\s+]+")
    named = lambda known: F.array_intersect(F.array(*map(F.lit, known)), words)
    return ideas.withColumn("concepts", named(concepts)).withColumn("sessions", named(sessions))


def counted(rows: DataFrame, *by: str) -> DataFrame:
    """Described rows that agree (also in ``by``) as one, with ``n``, how many they are, and the sums of avg_pf, avg_trades and mc (missing values are neutral ones)."""
    sums = [F.sum(F.coalesce(F.col(n).cast("double"), F.lit(v))).alias(n) for n, v in NEUTRAL.items()]
    return rows.groupBy(*by, "concepts", "sessions").agg(F.count("*").alias("n"), *sums)


def context(known: DataFrame, *by: str) -> DataFrame:
    """One row (for each ``by``): ``ctx``, the mean avg_pf, avg_trades and mc of the runs that name each concept. ``known`` are runs or what ``counted`` makes of them."""
    known = known if "n" in known.columns else counted(known, *by)
    per = known.select(*by, F.explode_outer("concepts").alias("c"), "n", *NEUTRAL).groupBy(*by, "c")
    per = per.agg(F.struct(*[F.round(F.sum(n) / F.sum("n"), 9).alias(n) for n in NEUTRAL]).alias("s"))  # rounded, as sums hang on the order of tasks
    named = F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", "s")))  # as long as the list of concepts
    return per.groupBy(*by).agg(F.map_from_entries(named).alias("ctx"))


def feature_names(concepts: Sequence[str] = CONCEPTS, sessions: Sequence[str] = SESSIONS) -> list[str]:
    return [*concepts, *sessions, "n_concepts", *[f"ctx_{n}" for n in NEUTRAL]]


def with_features(rows: DataFrame, ctx: DataFrame, concepts: Sequence[str] = CONCEPTS, sessions: Sequence[str] = SESSIONS) -> DataFrame:
    """``rows`` (described) with ``x``: a flag per concept and session, the number of concepts (5 at most) and the means of their contexts (those of the row's forest, if ``ctx`` has more)."""
    flags = [F.array(*[F.array_contains(of, F.lit(c)).cast("double") for c in known]) for known, of in ((concepts, "concepts"), (sessions, "sessions"))]
    size = F.size("concepts")
    means = []
    for n, v in NEUTRAL.items():
        total = F.aggregate("concepts", F.lit(0.0), lambda t, c: t + F.coalesce(F.try_element_at("ctx", c)[n], F.lit(v)))
        means.append(F.when(size > 0, total / size).otherwise(v) / (100 if n == "avg_trades" else 1))
    x = F.concat(*flags, F.array(F.least(size, F.lit(5)).cast("double"), *means))
    met = rows.join(F.broadcast(ctx), "forest") if "forest" in ctx.columns else rows.crossJoin(F.broadcast(ctx))  # one row, or one for each forest
    return met.withColumn("x", x).drop("ctx")


def nodes_of(model, spark, weighted: bool = False) -> DataFrame:
    """The nodes of a fitted tree ensemble: tree, id (from 0, the root), feature (-1: leaf), threshold, left, right, value, share (class 1 among the node's weights) and rows
    (``weighted``: of a regression, the sum of their weights)."""
    path = f"{shared_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    n = "nodeData"
    data = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), f"{n}.id", F.col(f"{n}.split.featureIndex").alias("feature"), F.try_element_at(F.col(f"{n}.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"),
        F.col(f"{n}.leftChild").alias("left"), F.col(f"{n}.rightChild").alias("right"), F.col(f"{n}.prediction").alias("value"),
        F.try_divide(F.try_element_at(F.col(f"{n}.impurityStats"), F.lit(2)), F.aggregate(f"{n}.impurityStats", F.lit(0.0), lambda t, v: t + v)).alias("share"), (F.col(f"{n}.impurityStats")[0] if weighted else F.col(f"{n}.rawCount")).alias("rows"),
    )
    kept = stage(data, "nodes")
    remove(spark, path)
    return kept


def packed(nodes: DataFrame, *by: str) -> DataFrame:
    """One row (for each ``by``): ``trees``, for each tree the array of its nodes."""
    trees = nodes.groupBy(*by, "tree").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "feature", "threshold", "left", "right", "share"))), lambda n: n.dropFields("id")).alias("t"))
    return trees.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "t"))), lambda t: t["t"]).alias("trees"))


def votes(trees: str, x: str, depth: int) -> Column:
    """The share of class 1 at the leaf that the row reaches, for each tree."""
    step = f"IF(t[k].feature < 0, k, IF({x}[t[k].feature] <= t[k].threshold, t[k].left, t[k].right))"
    return F.expr(f"transform({trees}, t -> aggregate(sequence(1, {depth}), 0, (k, _) -> {step}, k -> t[k].share))")


class Fold(NamedTuple):
    """A forest as nodes in one row (``trees``), the contexts that it saw (``ctx``), and the sigmoid 1 / (1 + exp(-(slope * score + offset)))."""

    trees: DataFrame
    ctx: DataFrame
    slope: float
    offset: float


class Learner(NamedTuple):
    """Calibrated forests of the folds, and the forest over all runs, which tells of doubt and importance."""

    folds: list[Fold]
    base: Fold
    importance: DataFrame
    concepts: Sequence[str]
    sessions: Sequence[str]
    depth: int
    scores: DataFrame


def _forest(rows: DataFrame, trees: int, depth: int, seed: int):
    """Spark's own forest on x and y, whose classes weigh the same. It walks every row through every tree; ``forests.grow`` draws from the same law, and the tests compare the two."""
    share = rows.agg(F.avg("y")).first()[0]
    weight = F.when(F.col("y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    if "run_id" in rows.columns:  # small files make few partitions, and one task walks its rows through all trees
        rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "run_id").sortWithinPartitions("run_id")
    rows = rows.select("y", weight.alias("w"), array_to_vector("x").alias("features"))
    return RandomForestClassifier(labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, seed=seed).fit(rows)


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values)


def sigmoid(scores: DataFrame) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (score, y), each for ``n`` runs, with the targets (good + 1) / (good + 2) and 1 / (bad + 2) instead of 1 and 0, so that it is always finite."""
    n1, n = scores.agg(F.coalesce(F.sum(F.col("y") * F.col("n")), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n - n1 + 2)
    target = F.when(F.col("y") == 1, high).otherwise(low)
    sides = F.array(*[F.struct(F.lit(y).alias("y"), (F.col("n") * w).alias("w")) for y, w in ((1.0, target), (0.0, 1 - target))])
    both = scores.select(array_to_vector(F.array("score")).alias("features"), F.explode(sides).alias("r"))
    fit = LogisticRegression(labelCol="y", weightCol="w", standardization=False, tol=1e-9).fit(both.select("features", "r.y", "r.w"))
    return float(fit.coefficients[0]), float(fit.intercept)


def _curve(score: Column, slope: float | Column, offset: float | Column) -> Column:
    return 1 / (1 + F.exp(-(score * slope + offset)))


def fit(runs: DataFrame, good: Column, concepts: Sequence[str] = CONCEPTS, sessions: Sequence[str] = SESSIONS, folds: int = 5, trees: int = 200, depth: int = 6, seed: int = 42) -> Learner:
    """Learns from runs (run_id, idea, avg_pf, avg_trades, mc) which ones are ``good``; needs LEAST_RUNS of them.

    Runs are dealt into ``folds`` by a hash of run_id (three below two good runs a fold). For each fold there is a forest whose runs, and the contexts of its features, come
    from all folds but this one and the next; its sigmoid is fitted on the next one. So ``scores`` (run_id, y, fold, score, prob) has each run judged by
    a forest, contexts and a sigmoid none of which saw it. Below six good runs there is one forest, calibrated on its own scores, as there is nothing to hold out.
    """
    spark = runs.sparkSession
    rows = described(runs, concepts, sessions).withColumn("y", F.coalesce(good, F.lit(False)).cast("double"))
    rows = stage(rows.select("run_id", "concepts", "sessions", "y", drawn(seed, "run_id").alias("deal"), *NEUTRAL), "learned")
    total, positive = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if total < LEAST_RUNS:
        raise ValueError(f"needs {LEAST_RUNS} runs or more, has {total}")
    k = folds if positive >= 2 * folds else 3 if positive >= 6 else 1
    rows = rows.withColumn("fold", (F.col("deal") % k).cast("int"))
    kinds = stage(counted(rows, "fold", "y"), "kinds")  # runs meet the forests and the sigmoids as these

    after = [(f + 1) % k for f in range(k)]
    learns = [(f, g) for f in range(k) for g in range(k) if k == 1 or g not in (f, after[f])] + [(k, g) for g in range(k)]  # the last forest is the one over all runs
    seen = kinds.join(F.broadcast(spark.createDataFrame(learns, "forest int, fold int")), "fold")
    contexts = stage(context(seen, "forest"), "contexts")
    met = with_features(seen.select("forest", "concepts", "sessions", "y", "n"), contexts, concepts, sessions)
    nodes, importances = grow(met, trees, depth, seed)
    grown = stage(packed(nodes, "forest"), "forests")

    judges = spark.createDataFrame(sorted({(f, g) for f in range(k) for g in (f, after[f])}), "forest int, fold int")
    posed = kinds.join(F.broadcast(judges), "fold").select("forest", "concepts", "sessions").distinct().repartition(spark.sparkContext.defaultParallelism)
    posed = with_features(posed, contexts, concepts, sessions).join(F.broadcast(grown), "forest")  # one row for each forest
    scored = stage(posed.select("forest", "concepts", "sessions", _mean(votes("trees", "x", depth)).alias("score")), "scored")

    of = lambda table, f, column: table.where(F.col("forest") == f).select(column)
    fitted: list[Fold] = []
    for f in range(k):
        held = kinds.where(F.col("fold") == after[f]).join(scored.where(F.col("forest") == f), ["concepts", "sessions"])
        fitted.append(Fold(of(grown, f, "trees"), of(contexts, f, "ctx"), *sigmoid(held.select("score", "y", "n"))))
    curves = spark.createDataFrame([(f, c.slope, c.offset) for f, c in enumerate(fitted)], "forest int, slope double, offset double")
    own = scored.join(F.broadcast(curves), "forest").withColumn("prob", _curve(F.col("score"), F.col("slope"), F.col("offset")))
    own = stage(own.select(F.col("forest").alias("fold"), "concepts", "sessions", "score", "prob"), "judges")
    scores = rows.join(own, ["fold", "concepts", "sessions"]).select("run_id", "y", "fold", "score", "prob")

    importance = spark.createDataFrame(list(zip(feature_names(concepts, sessions), importances[k])), "feature string, importance double")
    base = Fold(of(grown, k, "trees"), of(contexts, k, "ctx"), 1.0, 0.0)
    return Learner(fitted, base, importance, concepts, sessions, depth, scores)


def brier(scores: DataFrame) -> DataFrame:
    """One row: runs, share of good ones, Brier score of ``prob``, and that of always saying the share."""
    share = F.avg("y")
    return scores.agg(F.count("*").alias("runs"), share.alias("share"), F.avg(F.pow(F.col("prob") - F.col("y"), 2)).alias("brier"), (share * (1 - share)).alias("brier_of_share"))


def band(prob: Column, uncertainty: Column) -> Column:
    """reject below REJECT, queue from QUEUE on if the trees agree, else review."""
    return F.when(prob < REJECT, "reject").when((prob >= QUEUE) & (uncertainty <= DOUBT), "queue").otherwise("review")


def _subsets(of: str) -> Column:
    """All subsets of a sorted array but the empty one."""
    return F.expr(f"transform(sequence(1L, shiftleft(1L, size({of})) - 1), m -> filter({of}, (c, i) -> getbit(m, i) = 1))")


def novelty(ideas: DataFrame, known: DataFrame) -> DataFrame:
    """``ideas`` (id, concepts) with ``novelty``: 1 - the largest Jaccard similarity to a set of ``known`` (concepts); 1 if nothing is known.

    Two empty sets are alike, an empty and another one are not. The best partner of a set S that has all of its subset U is the smallest one with U,
    so the answer is the largest |U| / (|S| + smallest - |U|): only the smallest known set of each subset is kept, and no two ideas are paired. Sets
    of more than SUBSETS concepts, on either side, meet the distinct sets that share a concept.
    """
    sets = stage(known.select(F.array_sort(F.array_distinct("concepts")).alias("t")).distinct(), "known")
    mine = stage(ideas.select(F.array_sort(F.array_distinct("concepts")).alias("s")).distinct(), "mine")
    small = F.size("t") <= SUBSETS
    smallest = sets.where(small).select(F.size("t").alias("n"), F.explode(_subsets("t")).alias("u")).groupBy("u").agg(F.min("n").alias("n"))
    posed = mine.where((F.size("s") > 0) & (F.size("s") <= SUBSETS)).select("s", F.explode(_subsets("s")).alias("u"))
    alike = posed.join(smallest, "u").select("s", (F.size("u") / (F.size("s") + F.col("n") - F.size("u"))).alias("j"))
    one, other = mine.select("s", F.explode("s").alias("c")), sets.select("t", F.explode("t").alias("c"))
    rest = one.join(other.where(~small), "c").unionByName(one.where(F.size("s") > SUBSETS).join(other.where(small), "c"))
    shared = F.size(F.array_intersect("s", "t"))
    rest = rest.select("s", (shared / (F.size("s") + F.size("t") - shared)).alias("j"))
    none = mine.where(F.size("s") == 0).join(sets.where(F.size("t") == 0), F.col("s") == F.col("t")).select("s", F.lit(1.0).alias("j"))
    best = alike.unionByName(rest).unionByName(none).groupBy("s").agg(F.max("j").alias("_j"))
    out = ideas.withColumn("s", F.array_sort(F.array_distinct("concepts"))).join(best, "s", "left")
    return out.withColumn("novelty", F.round(1 - F.coalesce("_j", F.lit(0.0)), 4)).drop("s", "_j")


def judged(learner: Learner, ideas: DataFrame, known: DataFrame) -> DataFrame:
    """Ideas (id, idea) with prob (mean of the folds' calibrated forests), uncertainty (deviation of the votes of all trees), novelty against ``known`` (idea), band,
    and top: the most important concept or session that the idea names ('-' if none)."""
    every = stage(described(ideas, learner.concepts, learner.sessions), "judged")
    rows, probs = every.select("concepts", "sessions").distinct(), []  # the forests meet each description once
    for n, f in enumerate(learner.folds):
        rows = with_features(rows, f.ctx, learner.concepts, learner.sessions).crossJoin(F.broadcast(f.trees))  # one row
        rows = rows.withColumn(f"_p{n}", _curve(_mean(votes("trees", "x", learner.depth)), f.slope, f.offset)).drop("x", "trees")
        probs.append(F.col(f"_p{n}"))
    rows = with_features(rows, learner.base.ctx, learner.concepts, learner.sessions).crossJoin(F.broadcast(learner.base.trees))  # one row
    rows = rows.withColumn("_v", votes("trees", "x", learner.depth)).drop("x", "trees")
    mean = _mean(F.col("_v"))
    rows = rows.withColumn("prob", sum(probs[1:], probs[0]) / len(probs)).withColumn("_m", mean)
    rows = rows.withColumn("uncertainty", F.sqrt(F.aggregate("_v", F.lit(0.0), lambda t, v: t + F.pow(v - F.col("_m"), 2)) / F.size("_v")))
    order = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("i"), "feature")))
    ranking = learner.importance.where(F.col("importance") > 0).agg(F.transform(order, lambda r: r["feature"]).alias("_ranking"))  # one row, as long as the list of features
    rows = rows.crossJoin(F.broadcast(ranking)).withColumn("top", F.coalesce(F.try_element_at(F.array_intersect("_ranking", F.concat("concepts", "sessions")), F.lit(1)), F.lit("-")))
    rows = rows.drop("_v", "_m", "_ranking", *[f"_p{n}" for n in range(len(probs))])
    rows = every.join(stage(rows, "judged"), ["concepts", "sessions"]).select(*every.columns, "prob", "uncertainty", "top")
    rows = novelty(stage(rows, "judged"), described(known.select("idea").distinct(), learner.concepts, learner.sessions))  # each text is split once
    return rows.withColumn("band", band(F.col("prob"), F.col("uncertainty"))).withColumn("prob", F.round("prob", 4)).withColumn("uncertainty", F.round("uncertainty", 4))


def explored(candidates: DataFrame, by: str, k: int, seed: int = 43, weight: str | None = None) -> DataFrame:
    """``k`` candidates (``by``, id, ...) of each group, drawn without replacement, with ``place`` from 1; repeatable.

    Each has an exponential key -ln(u) / weight with u drawn from its id; the smallest keys win, the smaller id in a tie. Candidates of no weight are not drawn.
    Each task keeps its first ``k`` of a group before the shuffle.
    """
    heavy = F.col(weight) if weight else F.lit(1.0)
    keyed = candidates.withColumn("_key", -F.ln((drawn(seed, "id") + 0.5) / 4294967296.0) / heavy).where(heavy > 0)
    order = Window.partitionBy(by).orderBy("_key", "id")
    return keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("_key")


def suggestions(candidates: DataFrame, by: str, n: int = 10, explore: float = 0.3, seed: int = 43, weight: float = 0.7) -> DataFrame:
    """``n`` candidates (``by``, id, tokens, p) of each group: ``by``, kind, place, id, p.

    Most places go to diverse ones among those with p of REJECT or more (kind 'exploit'); round(n * explore) places, one at least, to candidates
    drawn from all that are left (kind 'explore'), whatever their p.
    """
    drawn_places = max(1, round(n * explore))
    candidates = stage(candidates.select(by, "id", "tokens", F.col("p").cast("double").alias("p")), "candidates")
    best = stage(diverse(candidates.where(F.col("p") >= REJECT), by, n - drawn_places, weight).select(by, F.lit("exploit").alias("kind"), "place", "id", "p"), "exploited")
    left = candidates.join(best.select(F.col(by).alias("_by"), F.col("id").alias("_id")), F.col(by).eqNullSafe(F.col("_by")) & (F.col("id") == F.col("_id")), "left_anti")
    return best.unionByName(explored(left, by, drawn_places, seed).select(by, F.lit("explore").alias("kind"), "place", "id", "p"))


class Attribution(NamedTuple):
    """Per row and feature, what the feature adds to a tree model's prediction; with ``base``, the mean prediction, they add up to it."""

    rows: DataFrame
    base: float


def _leaves(nodes: DataFrame, weights: Sequence[float], depth: int) -> DataFrame:
    """tree, value (times the tree's weight), reach (share of the rows) and parts: per feature of the leaf's path lo < x <= hi and the share of rows that go that way."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("tree") + 1)
    inf = float("inf")
    at = nodes.where("id = 0").select("tree", "id", F.expr("cast(array() AS array<struct<feature: int, lo: double, hi: double, part: double>>)").alias("path"))
    for _ in range(depth):
        met = at.join(nodes.select("tree", "id", "feature", "threshold", "left", "right", "rows"), ["tree", "id"])
        low, high = nodes.select("tree", F.col("id").alias("left"), F.col("rows").alias("_l")), nodes.select("tree", F.col("id").alias("right"), F.col("rows").alias("_r"))
        met = met.join(low, ["tree", "left"], "left").join(high, ["tree", "right"], "left")
        go = lambda child, lo, hi, n: F.struct(F.col(child).alias("id"), F.struct("feature", F.lit(lo).alias("lo") if lo is not None else F.col("threshold").alias("lo"), F.lit(hi).alias("hi") if hi is not None else F.col("threshold").alias("hi"), (F.col(n) / F.col("rows")).alias("part")).alias("step"))
        down = met.where("feature >= 0").select("tree", "path", F.explode(F.array(go("left", -inf, None, "_l"), go("right", None, inf, "_r"))).alias("g"))
        down = down.select("tree", "g.id", F.concat("path", F.array("g.step")).alias("path"))
        at = met.where("feature < 0").select("tree", "id", "path").unionByName(down)
    at = at.join(nodes.where("feature < 0").select("tree", "id", "value"), ["tree", "id"])
    whole = F.aggregate("path", F.lit(1.0), lambda t, s: t * s["part"])
    merged = F.expr("""transform(array_distinct(transform(path, s -> s.feature)), f -> aggregate(filter(path, s -> s.feature = f),
        named_struct('feature', f, 'lo', double('-infinity'), 'hi', double('infinity'), 'part', 1D), (a, s) -> named_struct('feature', f, 'lo', greatest(a.lo, s.lo), 'hi', least(a.hi, s.hi), 'part', a.part * s.part)))""")
    return at.select("tree", "id", (F.col("value") * weight).alias("value"), whole.alias("reach"), merged.alias("parts"))


#: For leaves whose path asks for m features: what each share of the product counts, by how many of the other features a coalition holds.
_COALITIONS = {0: (1.0,), 1: (1 / 2, 1 / 2), 2: (1 / 3, 1 / 6, 1 / 3)}


def attributions(nodes: DataFrame, weights: Sequence[float], rows: DataFrame, depth: int = 3, key: str = "run_id") -> Attribution:
    """Shapley values of a tree ensemble of depth 3 at most on ``rows`` (key, x): (key, feature number, phi) for features with a share.

    A feature that a coalition lacks follows both branches of a split in proportion to the rows that went there in fitting. Along the path to one
    leaf this makes a product over at most three features, whose Shapley values are written out coalition by coalition; a row's value is their sum over all leaves.
    """
    if depth > 3:
        raise ValueError("coalitions are written out for paths of up to three features")
    leaves = stage(_leaves(nodes, weights, depth), "leaves")
    base = leaves.agg(F.sum(F.col("value") * F.col("reach"))).first()[0] or 0.0
    # per feature the leaves whose path asks for it: the leaf's value, the feature's own part and the other parts
    per = leaves.select("tree", "id", "value", F.posexplode("parts").alias("at", "own"), "parts")
    others = F.filter("parts", lambda p: p["feature"] != F.col("own.feature"))
    per = per.select(F.col("own.feature").alias("feature"), F.struct("tree", "id", "value", "own", others.alias("others")).alias("leaf"))
    model = per.groupBy("feature").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")).agg(F.collect_list(F.struct("feature", "leaves")).alias("model"))  # one row, as long as the model has leaves
    on = lambda p: f"IF(x[{p}.feature] > {p}.lo AND x[{p}.feature] <= {p}.hi, 1D, 0D)"
    a, b = (on(f"l.others[{i}]") for i in (0, 1))
    r, s = "l.others[0].part", "l.others[1].part"
    one, two, three = _COALITIONS[0], _COALITIONS[1], _COALITIONS[2]
    share = f"""CASE size(l.others) WHEN 0 THEN {one[0]}D WHEN 1 THEN {two[0]}D * {r} + {two[1]}D * {a}
        ELSE {three[0]!r}D * {r} * {s} + {three[1]!r}D * ({a} * {s} + {r} * {b}) + {three[2]!r}D * {a} * {b} END"""
    phi = f"transform(model, m -> named_struct('feature', m.feature, 'phi', aggregate(m.leaves, 0D, (t, l) -> t + l.value * ({on('l.own')} - l.own.part) * {share})))"
    kinds = stage(rows.select("x").distinct().crossJoin(F.broadcast(model)).select("x", F.expr(phi).alias("f")), "kinds")  # one row; the leaves meet equal rows once
    found = rows.select(key, "x").join(kinds, "x").select(key, F.explode("f").alias("f")).select(key, "f.feature", "f.phi")
    return Attribution(found, base)


def boosted(rows: DataFrame, trees: int = 20, depth: int = 3, seed: int = 1) -> tuple[DataFrame, list[float], object]:
    """Boosted regression trees on x and label: nodes, weights of the trees, model. Rows with equal x are fitted as one of their weight."""
    met = alike(rows, "x").select(array_to_vector("x").alias("features"), "label", "weight")
    model = GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight").fit(met)
    return nodes_of(model, rows.sparkSession, weighted=True), [float(w) for w in model.treeWeights], model


def mean_attribution(found: Attribution, names: Sequence[str], rows: float, weights: DataFrame | None = None) -> DataFrame:
    """Per feature the mean absolute attribution over ``rows`` rows; features that no path asks for have 0. ``weights`` (run_id, weight): how many rows each one stands for."""
    weighed = found.rows.withColumn("weight", F.lit(1.0)) if weights is None else found.rows.join(weights, "run_id")
    per = weighed.groupBy("feature").agg((F.sum(F.abs("phi") * F.col("weight")) / rows).alias("_m"))
    named = found.rows.sparkSession.createDataFrame(list(enumerate(names)), "feature int, token string")
    return named.join(per, "feature", "left").select("token", F.round(F.coalesce("_m", F.lit(0.0)), 6).alias("weight"))
