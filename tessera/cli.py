"""The workloads as programs over files: ``python -m tessera PROGRAM ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import climate, features, forest, graph, links, numbering, words
from .session import staged
from .sources import readers, sinks


def climate_means(spark: SparkSession, source: str, target: str) -> None:
    """Station, mean TMIN and mean TMAX: ``station TAB , tmin, tmax``; NaN where there is no reading."""
    means = climate.means(climate.readings(readers.climate_csv(spark, source), key=None), "station", as_nan=True)
    sinks.tab_text(means.select("station", F.concat(F.lit(", "), F.concat_ws(", ", "avg_tmin", "avg_tmax")).alias("line")), target)


def climate_series(spark: SparkSession, source: str, target: str) -> None:
    """Station and its yearly means in order: ``station TAB , [(year, tmin, tmax), ...]``."""
    series = climate.yearly_series(climate.readings(readers.climate_csv(spark, source), key=None))
    sinks.tab_text(climate.series_text(series).orderBy("station"), target)


def word_count(spark: SparkSession, source: str, target: str) -> None:
    sinks.tab_text(words.token_counts(readers.text_lines(spark, source), "value").orderBy("token"), target)


def adjacency(spark: SparkSession, source: str, target: str) -> None:
    """``page TAB e1|e2`` of wiki lines ``name:html``, for every page and every page linked to."""
    lists = staged(links.extract_links(readers.text_lines(spark, source)))
    sinks.tab_text(graph.listed(lists), target, ["page", "links"])


def matrix(spark: SparkSession, source: str, target: str) -> None:
    """The node dictionary (``index``) and the sparse transition matrix (``matrix``) of wiki lines, below ``target``."""
    lists = staged(links.extract_links(readers.text_lines(spark, source)))
    edges = staged(graph.merged(graph.from_lists(lists)))
    index = staged(numbering.dense_numbers(graph.nodes(edges, lists), [F.col("node").asc()]))
    sinks.tab_text(index.select("node", "idx"), f"{target}/index")
    sinks.matrix_text(graph.transition_matrix(edges, index, padded=True), f"{target}/matrix")


def pagerank(spark: SparkSession, source: str, target: str, *, iterations: int = 10, alpha: float = graph.ALPHA, damped: bool = False, strategy: str = "auto", top: int = 100) -> None:
    """The top pages of wiki lines: ``(rank,name)``, greatest first."""
    lists = staged(links.extract_links(readers.text_lines(spark, source)))
    ranks = graph.pagerank(graph.merged(graph.from_lists(lists)), pages=lists, iterations=iterations, alpha=alpha, damped=damped, strategy=strategy)
    sinks.tuple_text(words.top_k(ranks, "rank", "node", top), target, ["rank", "node"])


def _table(spark: SparkSession, path: str) -> DataFrame:
    # All columns as text: features cast what is numeric, and no pass is spent on inference.
    return spark.read.option("header", "true").option("mode", "DROPMALFORMED").csv(path)


def classify(spark: SparkSession, source: str, held_out: float = 0.005, **size: int) -> float:
    """Accuracy on held-out rows of a labelled table."""
    rows = staged(features.prepared(_table(spark, source).withColumn("row__id", F.monotonically_increasing_id())))
    train, test = forest.split(rows, "row__id", held_out)
    model = forest.fit_forest(train, ids=("row__id",), **size)
    return forest.accuracy(forest.predict(model, test, ids=("row__id",)))


def predict(spark: SparkSession, source: str, unlabelled: str, target: str, **size: int) -> None:
    """``SAMPLING_EVENT_ID0,prediction`` for an unlabelled table, by a forest fitted on a labelled one."""
    ids = ("SAMPLING_EVENT_ID0",)
    model = forest.fit_forest(staged(features.prepared(_table(spark, source), keep=ids)), ids=ids, **size)
    sinks.single_csv(forest.predict(model, features.prepared(_table(spark, unlabelled), keep=ids, keep_unlabelled=True), ids=ids), target, ["SAMPLING_EVENT_ID0", "prediction"])


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    programs = parser.add_subparsers(dest="program", required=True)
    for f in (climate_means, climate_series, word_count, adjacency, matrix, pagerank):
        p = programs.add_parser(f.__name__, help=f.__doc__)
        p.add_argument("source")
        p.add_argument("target")
        p.set_defaults(run=f)
        if f is pagerank:
            p.add_argument("--iterations", type=int, default=10)
            p.add_argument("--alpha", type=float, default=graph.ALPHA)
            p.add_argument("--damped", action="store_true")
            p.add_argument("--strategy", choices=["auto", "shuffle", "broadcast"], default="auto")
            p.add_argument("--top", type=int, default=100)
    for f, names in ((classify, ["source"]), (predict, ["source", "unlabelled", "target"])):
        p = programs.add_parser(f.__name__, help=f.__doc__)
        for n in names:
            p.add_argument(n)
        for n, value in (("trees", 50), ("depth", 20), ("bins", 1024)):
            p.add_argument(f"--{n}", type=int, default=value)
        if f is classify:
            p.add_argument("--held-out", type=float, default=0.005)
        p.set_defaults(run=f)
    given = vars(parser.parse_args(arguments))
    run = given.pop("run")
    given.pop("program")
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    result = run(spark, **given)
    if result is not None:
        print(f"accuracy {result:.6f} error {1 - result:.6f}")
