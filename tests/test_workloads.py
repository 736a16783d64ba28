import bz2
import gzip
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import climate, features, forest, graph, links, numbering, words
from tessera.plans import workloads
from tessera.plans.workloads import _PAGES
from tessera.sources import readers, sinks
from tests.conftest import DATA, rows

OBS = "obs_id long, station string, obs_date string, elem string, reading double, year string"


def obs(spark):
    data = [("S1", "18840101", "TMIN", 10.0), ("S1", "18840102", "TMIN", 20.0), ("S1", "18840101", "TMAX", 100.0), ("S1", "18850101", "TMAX", 50.0), ("S2", "18860101", "TMIN", -5.0), ("S1", "18840101", "PRCP", 7.0)]
    more = [(1, "S1", "18840101", "TMIN", 10.0, "x"), (99, "S1", "18840101", "TMIN", -9999.0, None), (98, "S1", "18840101", "TMAX", None, None)]
    return spark.createDataFrame([(k + 1, *r, None) for k, r in enumerate(data)] + more, OBS)


def test_climate_known_answers(spark):
    r = climate.readings(obs(spark))
    assert rows(climate.means(r, "station")) == [("S1", 15.0, 75.0), ("S2", -5.0, None)]
    assert math.isnan(climate.means(r, "station", as_nan=True).filter("station = 'S2'").first()["avg_tmax"])
    text = climate.series_text(climate.yearly_series(r), digits=1)
    assert rows(text) == [("S1", ", [(1884, 15.0, 100.0), (1885, NaN, 50.0)]"), ("S2", ", [(1886, -5.0, NaN)]")]
    assert climate.yearly_series(climate.readings(obs(spark).limit(0))).count() == 0


def test_climate_aggregates_before_the_shuffle(spark):
    plan = climate.means(climate.readings(obs(spark), key=None), "station")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_avg" in plan


def test_words(spark):
    df = spark.createDataFrame([("b a\tb\n",), ("a,  b",), ("",), (None,), ("x" * 200_000,)], "text string")
    counts = words.token_counts(df, "text")
    assert rows(counts)[:3] == [("a", 1), ("a,", 1), ("b", 3)]
    assert [r["token"] for r in words.top_k(counts, "occurrences", "token", 3).collect()] == ["b", "a", "a,"]


EDGES = [("A", "B"), ("A", "B"), ("A", "C"), ("B", "C"), ("B", "E"), ("C", "A"), ("D", "C")]


def edges(spark, data=EDGES):
    return graph.merged(spark.createDataFrame(data, "src string, dst string"))


@pytest.mark.parametrize("strategy", ["auto", "shuffle", "broadcast"])
@pytest.mark.parametrize(
    ("steps", "damped", "want"),
    [(1, False, [0.24, 0.183333333, 0.381666667, 0.07, 0.155]), (10, False, [0.332269031, 0.250354115, 0.316238383, 0.063877166, 0.169277863]), (10, True, [0.294093590, 0.221558415, 0.279334968, 0.055580262, 0.149432764])],
)
def test_pagerank_known_answers(spark, steps, damped, want, strategy):
    got = graph.pagerank(edges(spark), iterations=steps, damped=damped, strategy=strategy, cut_every=3)
    assert [round(r["rank"], 9) for r in got.orderBy("node").collect()] == want


def test_pagerank_stops_when_settled_and_takes_empty_graphs(spark):
    got = graph.pagerank(edges(spark), iterations=200, damped=True, tolerance=1e-6)
    assert abs(got.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    assert graph.pagerank(edges(spark, [(None, "A"), ("A", None)]), iterations=2).count() == 0


def test_graph_tables(spark):
    e = edges(spark)
    index = numbering.dense_numbers(graph.nodes(e), [F.col("node").asc()])
    assert rows(index, "node", "idx") == [("A", 0), ("B", 1), ("C", 2), ("D", 3), ("E", 4)]
    assert rows(graph.dangling(e)) == [("E",)]
    assert rows(graph.transition_matrix(e, index, padded=True).withColumn("v", F.round("v", 4))) == sorted([(1, 0, 0.6667), (2, 0, 0.3333), (2, 1, 0.5), (4, 1, 0.5), (0, 2, 1.0), (2, 3, 1.0), (3, 0, 0.0)], key=str)


def test_adjacency_has_one_row_for_each_page_in_link_order(spark):
    links = [("A", "n" + str(k), 12_000 - k) for k in range(12_000)] + [("A", "x", None), ("B", "C", 2), ("B", "A", 3), ("B", "A", 1), ("B", None, 0), (None, "Q", 0)]
    df = spark.createDataFrame(links, "src string, dst string, pos int")
    got = {r["page"]: r["links"] for r in graph.adjacency(df, order=["pos"]).collect()}
    assert got["A"] == "|".join(["x"] + [f"n{k}" for k in range(11_999, -1, -1)]) and got["B"] == "A|C|A" and got["C"] == "" and "Q" not in got
    assert graph.adjacency(df, order=["pos"]).count() == len(got) == 12_004
    assert rows(graph.adjacency(df.filter("src = 'B'"))) == [("A", ""), ("B", "A|A|C"), ("C", "")]
    lists = spark.createDataFrame([("P", ["b", "a", "b"]), ("Q", []), ("Q", ["P"]), ("E", [])], "page string, links array<string>")
    assert rows(graph.listed(lists)) == [("E", ""), ("P", "b|a|b"), ("Q", "P"), ("a", ""), ("b", "")]
    assert graph.adjacency(df.limit(0)).count() == 0


def test_link_extraction(spark):
    lines = spark.createDataFrame([(p,) for p in [*_PAGES, "no colon", ":x", None, "Q:" + "<a>" * 3000]], "value string")
    assert rows(links.extract_links(lines)) == [("P1", ["A", "B_1", "A"]), ("P2", []), ("P4", ["Band_(music)", "R&D", "R&amp;D", "A B"])]


def test_external_entities_are_not_read():
    assert links.page_links('<!DOCTYPE a [<!ENTITY e SYSTEM "file:///etc/passwd">]><div id="bodyContent">&e;</div>') == []


TABLE = "id long, Agelaius_phoeniceus string, COUNTRY string, NLCD_1 string, CAUS_2 string, GROUP_ID string, PRIMARY_CHECKLIST_FLAG string, EFFORT_DISTANCE_KM string, COUNT_TYPE string"


def test_features(spark):
    data = [(1, "0", "c", "n", "c", "?", "?", "-3", "P34"), (2, "1", "c", "n", "c", None, "1", "?", "P22"), (3, "2", "c", "n", "c", "X", "null", None, None), (4, "X", "c", "n", "c", "G1", "0", "1", "P20"), (5, "?", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, TABLE)
    assert rows(features.prepared(df), "id", "label", "GROUP_ID", "PRIMARY_CHECKLIST_FLAG", "EFFORT_DISTANCE_KM", "COUNT_TYPE_P34") == [(1, 0.0, "G0000", -1.0, 3.0, 1.0), (2, 0.0, "G0000", 1.0, 1.0, 0.0), (3, 1.0, "1.0", -1.0, None, 0.0)]
    assert "COUNTRY" not in features.prepared(df).columns and "NLCD_1" not in features.prepared(df).columns
    assert rows(features.prepared(df, sighting_counts=True, threshold=0.5), "id", "label") == [(1, 0.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert features.prepared(df, keep_unlabelled=True).count() == 5
    letters = spark.createDataFrame([("b",), ("b",), ("a",), ("c",), (None,)], "x string")
    assert rows(features.frequency_index(letters, ["x"]), "value", "idx") == [("a", 1), ("b", 0), ("c", 2)]
    assert rows(features.distinct_counts(letters, ["x"])) == [("x", 4)] and features.largest_cardinality(letters, ["x"]) == 4


@pytest.mark.parametrize("nominal", [False, True])
def test_forest_learns_and_takes_unseen_values(spark, nominal):
    data = [(i, "5" if i % 2 else "0", "odd" if i % 2 else "even", str(i % 7)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, Agelaius_phoeniceus string, COUNTY string, EFFORT_DISTANCE_KM string").withColumns({"GROUP_ID": F.lit("?"), "PRIMARY_CHECKLIST_FLAG": F.lit("1"), "COUNT_TYPE": F.lit("P22")})
    train, test = forest.split(features.prepared(df), "id", 0.2)
    model = forest.fit_forest(train, trees=5, depth=3, bins=16, nominal=nominal, ids=("id",))
    assert forest.accuracy(forest.predict(model, test, ids=("id",))) == 1.0
    unseen = features.prepared(df.withColumn("COUNTY", F.lit("elsewhere")))
    assert forest.predict(model, unseen, ids=("id",)).select("id", "prediction").count() == 300


def test_forest_queries_use_the_full_setting(spark, monkeypatch):
    """50 trees of depth 20 with 1024 bins, as in the reference."""
    fitted, fit = [], forest.fit_forest
    monkeypatch.setattr(forest, "fit_forest", lambda *args, **how: fitted.append(fit(*args, **how)) or fitted[-1])
    for query in (workloads.forest_accuracy, workloads.forest_predictions):
        assert query(spark, f"{DATA}/sf0.001").count() > 0
        model = fitted[-1].model
        assert (model.getNumTrees, model.getOrDefault("maxDepth"), model.getOrDefault("maxBins")) == (50, 20, 1024)


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt.gz").write_bytes(gzip.compress(b"one\ttwo|three\n"))
    (tmp_path / "in/b.txt.bz2").write_bytes(bz2.compress(b"lone\nfour\t\n"))
    assert rows(readers.adjacency_text(spark, str(tmp_path / "in"))) == [("four", []), ("lone", []), ("one", ["two", "three"])]
    (tmp_path / "c.csv").write_text("S1,18840101,TMIN,10,E,x\nS1,18840102,TMAX,oops\nS2\n")
    assert rows(readers.climate_csv(spark, str(tmp_path / "c.csv")))[0] == ("S1", "18840101", "TMIN", 10.0)
    (tmp_path / "h.csv").write_text("a,b\n1,x\n2\n3,y\n")
    assert rows(readers.header_csv(spark, str(tmp_path / "h.csv"), "a int, b string").select("a"))[0] == (1,)
    (tmp_path / "v.txt").write_text("R,3,0,0.5\n4,0.25\n")
    assert rows(readers.vector_text(spark, str(tmp_path / "v.txt"))) == [(3, 0.5), (4, 0.25)]
    cells = spark.createDataFrame([(1, 2, 0.5)], "i long, j long, v double")
    sinks.matrix_text(cells, str(tmp_path / "m"))
    assert rows(readers.matrix_text(spark, str(tmp_path / "m"))) == [(1, 2, 0.5)]
    top = spark.createDataFrame([("A", 0), ("B", 1)], "node string, idx long")
    sinks.tab_text(top, str(tmp_path / "t"))
    assert rows(readers.index_text(spark, str(tmp_path / "t"))) == [("A", 0), ("B", 1)]
    sinks.tuple_text(top, str(tmp_path / "p"), ["idx", "node"])
    assert rows(spark.read.text(str(tmp_path / "p"))) == [("(0,A)",), ("(1,B)",)]
    sinks.single_csv(top, str(tmp_path / "s"), ["idx"])
    assert len(list((tmp_path / "s").glob("part-*"))) == 1
    sinks.value_text(top, str(tmp_path / "o"), "node")
    assert rows(spark.read.text(str(tmp_path / "o"))) == [("A",), ("B",)]
