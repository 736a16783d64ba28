"""Random forest over prepared features: one pipeline, fitted once and used for both tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CATEGORICAL, numeric
from .trees import MOST_BINS, TASK_VALUES, GrownForest, grown

SEED = 17


def _present(df: DataFrame, names: list[str]) -> list[str]:
    upper = {c.upper(): c for c in df.columns}
    return [upper[n.upper()] for n in names if n.upper() in upper]


def _indexer(df: DataFrame) -> StringIndexer:
    own = _present(df, CATEGORICAL)
    return StringIndexer(inputCols=own, outputCols=[f"{c}_index" for c in own], handleInvalid="keep", stringOrderType="frequencyDesc")


def _columns(indexed: DataFrame, ids: tuple[str, ...], nominal: bool) -> tuple[DataFrame, list[str]]:
    """Ids, label and inputs as finite doubles, and the inputs' names."""
    # Unless nominal, indexes go in as plain numbers: trees split on the rank of frequency, and maxBins need not cover
    # the widest column. A cast drops the metadata that marks a column as nominal.
    marked = [f"{c}_index" for c in _present(indexed, CATEGORICAL)] if nominal else []
    slim = numeric(indexed.drop(*_present(indexed, CATEGORICAL)), except_for=(*ids, *marked))
    inputs = sorted(c for c in slim.columns if c != "label" and c.upper() not in {i.upper() for i in ids})
    # Missing values, and text such as inf or NaN that casts to no finite number, are -1, as in the missing-value rules.
    slim = slim.withColumns({c: F.when(F.abs(F.col(f"`{c}`")) < float("inf"), F.col(f"`{c}`")).otherwise(-1.0) for c in inputs if c not in marked})
    return slim.select(*_present(slim, list(ids)), "label", *(f"`{c}`" for c in inputs)), inputs


def _vectors(indexed: DataFrame, ids: tuple[str, ...], nominal: bool) -> DataFrame:
    slim, inputs = _columns(indexed, ids, nominal)
    return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(slim).select(*_present(slim, list(ids)), "label", "features")


@dataclass
class Forest:
    """A fitted indexer and forest, and whether indexes are nominal to it."""

    indexer: StringIndexerModel
    model: RandomForestClassificationModel | GrownForest
    nominal: bool


def fit_forest(train: DataFrame, *, trees: int = 50, depth: int = 20, bins: int = 1024, ids: tuple[str, ...] = (), nominal: bool = False, seed: int = SEED) -> Forest:
    """A forest for a prepared table; values unseen in training get an index of their own.

    ``nominal`` keeps the indexed columns as categories, which is the better model
    where they have few values; ``bins`` then grows to the widest of them. Without it
    each tree is grown by a task (``trees``), as long as a task can hold the binned
    table; beyond that, and with ``nominal``, Spark's forest is fitted.
    """
    indexer = _indexer(train).fit(train)
    indexed = indexer.transform(train)
    if not nominal and 2 <= bins <= MOST_BINS:
        slim, inputs = _columns(indexed, ids, nominal)
        if 0 < slim.count() * len(inputs) <= TASK_VALUES:
            return Forest(indexer, grown(slim, inputs, trees=trees, depth=depth, bins=bins, seed=seed), nominal)
    widest = max((len(labels) for labels in indexer.labelsArray), default=0) + 1
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, maxBins=max(bins, widest) if nominal else bins, seed=seed)
    return Forest(indexer, forest.fit(_vectors(indexed, ids, nominal)), nominal)


def predict(forest: Forest, rows: DataFrame, ids: tuple[str, ...] = ()) -> DataFrame:
    indexed = forest.indexer.transform(rows)
    if isinstance(forest.model, GrownForest):
        return forest.model.transform(_columns(indexed, ids, forest.nominal)[0])
    return forest.model.transform(_vectors(indexed, ids, forest.nominal))


def accuracy(predictions: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="accuracy").evaluate(predictions)


def split(df: DataFrame, key: str, held_out: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Training and held-out rows by a hash of the key: the same at every run and on every cluster."""
    cut = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < round(held_out * 1_000_000)
    return df.filter(~cut), df.filter(cut)
