from fractions import Fraction

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.operators import forest, trees


def table(spark, n=4000, wide=60):
    """Values with repeats, labels that follow them but for noise."""
    random = np.random.default_rng(5)
    x = np.stack([random.integers(0, wide, n), random.integers(-3, 4, n), np.round(random.normal(0, 9, n), 1), np.ones(n)], axis=1)
    y = ((x[:, 0] > 20) ^ (x[:, 1] > 0) ^ (random.random(n) < 0.2)).astype(int)
    rows = [(k, float(label), *map(float, values)) for k, (label, values) in enumerate(zip(y, x, strict=True))]
    return spark.createDataFrame(rows, "id long, label double, a double, b double, c double, d double"), x, y.astype(np.uint8)


@pytest.mark.parametrize("depth", [1, 5])
def test_a_tree_of_all_features_is_sparks_tree(spark, depth):
    df, x, y = table(spark)
    edges = trees.thresholds(df, ["a", "b", "c", "d"], 1024)
    bins = np.stack([np.searchsorted(e, x[:, k]) for k, e in enumerate(edges)], axis=1).astype(np.uint16)
    tree = trees.grow(bins, y, np.ones(len(y), np.uint8), depth, 4, np.random.default_rng(0))
    vectors = df.select("id", "label", array_to_vector(F.array("a", "b", "c", "d")).alias("features"))
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=1024).fit(vectors)
    want = [r[0] for r in model.transform(vectors).orderBy("id").select(vector_to_array("probability")[1]).collect()]
    assert len(tree["feature"]) == model.numNodes
    assert np.allclose(trees.shares(tree, bins), want)


def brute(x, y, w, rows, depth):
    """(share, None) or (share, (feature, cut, left, right)), in exact fractions; the first of equal splits."""
    n, p = int(w[rows].sum()), int((w * y)[rows].sum())
    best, most = None, Fraction(p * p, n)
    for feature in range(x.shape[1] if depth else 0):
        for cut in np.unique(x[rows, feature])[:-1]:
            low = rows[x[rows, feature] <= cut]
            a, b = int(w[low].sum()), int((w * y)[low].sum())
            if (score := Fraction(b * b, a) + Fraction((p - b) ** 2, n - a)) > most:
                best, most = (feature, cut), score
    if best is None:
        return p / n, None
    low = x[rows, best[0]] <= best[1]
    left, right = brute(x, y, w, rows[low], depth - 1), brute(x, y, w, rows[~low], depth - 1)
    if left[1] is None and right[1] is None and (left[0] > 0.5) == (right[0] > 0.5):
        return p / n, None
    return p / n, (*best, left, right)


@pytest.mark.parametrize(("seed", "most", "heavy"), [(0, 90, 1), (1, 90, 1), (2, 90, 1), (3, 65_000, 60)])
def test_deep_trees_with_weights_equal_brute_force(seed, most, heavy):
    random = np.random.default_rng(seed)
    x, y, w = random.integers(0, [4, 30, most], (300, 3)).astype(np.uint16), random.integers(0, 2, 300).astype(np.uint8), np.minimum(random.poisson(heavy, 300), 127).astype(np.uint8)
    tree = trees.grow(x, y, w, 20, 3, random)
    tree_of = brute(x.astype(int), y.astype(int), w.astype(int), np.flatnonzero(w), 20)

    def share(row, at):
        while at[1] is not None:
            at = at[1][2] if row[at[1][0]] <= at[1][1] else at[1][3]
        return at[0]

    def size(at):
        return 1 if at[1] is None else 1 + size(at[1][2]) + size(at[1][3])

    assert len(tree["feature"]) == size(tree_of) > 50
    assert list(trees.shares(tree, x)) == [share(row, tree_of) for row in x]


def test_thresholds_are_midpoints_or_of_equal_frequency():
    values = np.arange(10.0)
    assert list(trees._thresholds(values, np.ones(10, int), 10)) == [k + 0.5 for k in range(9)]
    assert list(trees._thresholds(values, np.ones(10, int), 2)) == [4.5]
    assert list(trees._thresholds(values, np.array([90, *[1] * 9]), 5)) == [0.5, 1.5, 2.5, 3.5]
    assert not len(trees._thresholds(np.array([3.0]), np.array([7]), 5))


def jobs(spark, run):
    group = f"trees-{id(run)}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("", "")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def prepared(df):
    return df.select("id", "label", F.concat(F.lit("c"), "b").alias("COUNTY"), "a", "c")


def test_a_forest_takes_as_many_jobs_at_any_depth(spark):
    """Before, Spark's forest read all rows again for each group of nodes, a job each time: by far the longest part of both forest queries."""
    df = prepared(table(spark)[0]).localCheckpoint()
    few, many = (jobs(spark, lambda d=depth: forest.fit_forest(df, trees=10, depth=d, ids=("id",))) for depth in (2, 20))
    assert few == many < 20


def test_all_rows_and_other_columns_come_back(spark):
    df = prepared(table(spark)[0]).repartition(3)
    model = forest.fit_forest(df, trees=8, depth=12, bins=64, ids=("id",))
    got = forest.predict(model, df, ids=("id",))
    assert got.columns == ["id", "label", "probability", "prediction"]
    r = got.agg(F.count("*"), F.countDistinct("id"), F.max(F.abs(F.expr("probability[0] + probability[1] - 1"))), F.sum(F.expr("int((probability[1] > 0.5) <> (prediction = 1))"))).first()
    assert tuple(r)[:2] == (4000, 4000) and r[2] < 1e-12 and r[3] == 0
    assert forest.accuracy(got) > 0.75
    assert forest.predict(model, df.limit(0), ids=("id",)).count() == 0


def test_a_forest_is_as_good_as_sparks(spark, monkeypatch):
    """Beyond what a task holds Spark's forest is fitted; on rows held out both are as good."""
    train, test = forest.split(prepared(table(spark, 8000)[0]).localCheckpoint(), "id", 0.3)
    own = forest.fit_forest(train, trees=20, depth=8, bins=64, ids=("id",))
    monkeypatch.setattr(forest, "TASK_VALUES", 1000)
    sparks = forest.fit_forest(train, trees=20, depth=8, bins=64, ids=("id",))
    assert isinstance(own.model, trees.GrownForest) and not isinstance(sparks.model, trees.GrownForest)
    a, b = (forest.accuracy(forest.predict(m, test, ids=("id",))) for m in (own, sparks))
    assert abs(a - b) < 0.03, (a, b)
