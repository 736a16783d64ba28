import math
import random
from collections import Counter

import pytest

from tessera.operators import graph, selection
from tessera.plans import preparation
from tests.conftest import rows


@pytest.mark.parametrize("values", [lambda r: r.randrange(5), lambda r: r.randrange(10**6), lambda r: r.randrange(-(2**63), 2**63), lambda r: r.choice([-(2**63), 2**63 - 1, 0, 7])])
def test_quantiles_are_exact(spark, values):
    r = random.Random(1)
    data = [(r.choice(["hot", "hot", "b", None]), values(r)) for _ in range(500)] + [("one", 3), ("none", None)]
    got = rows(selection.exact_quantiles(spark.createDataFrame(data, "k string, v long"), "k", "v", [0.0, 0.25, 0.5, 1.0]))
    want = []
    for k in {k for k, _ in data}:
        own = sorted(v for key, v in data if key == k and v is not None)
        want += [(k, q, own[max(1, math.ceil(q * len(own))) - 1], len(own)) for q in (0.0, 0.25, 0.5, 1.0) if own]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("n", "share"), [(10, 0.02), (49, 0.02), (150, 0.02), (1000, 0.02), (777, 0.1), (300, 0.5)])
def test_frequent_values_at_the_limit(spark, n, share):
    r = random.Random(n)
    data = [("k", int(r.paretovariate(0.6)) * 2**40) for _ in range(n)]
    got = rows(selection.frequent_values(spark.createDataFrame(data, "k string, v long"), "k", "v", share).select("value", "n_equal"))
    assert got == sorted(((v, c) for v, c in Counter(v for _, v in data).items() if c * 1_000_000 >= round(share * 1_000_000) * n), key=str)


@pytest.mark.parametrize("limit", [selection.BROADCAST_BYTES, 0])
def test_a_hot_key_in_one_prefix_sends_counts_in_the_second_round(spark, monkeypatch, limit):
    """A third of the rows is one key whose values share all but their low 16 bits; an outlier forces two rounds."""
    monkeypatch.setattr(selection, "BROADCAST_BYTES", limit)
    df = spark.range(0, 90_000, 1, 6).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 100)) as k", "if(id = 3, 1L << 20, 5000 + id % 7) as v")
    got = {(r["k"], r["fraction"]): (r["value"], r["n"]) for r in selection.exact_quantiles(df, "k", "v", [0.5, 1.0]).collect()}
    values = sorted(1 << 20 if i == 3 else 5000 + i % 7 for i in range(0, 90_000, 3))
    assert got["hot", 0.5] == (values[14_999], 30_000) and got["hot", 1.0] == (1 << 20, 30_000)
    plans, staged = [], selection.staged
    monkeypatch.setattr(selection, "staged", lambda d: plans.append(d) or staged(d))
    selection.exact_quantiles(df, "k", "v", [0.5, 1.0]).count()
    text = plans[1]._jdf.queryExecution().optimizedPlan().toString()
    # Below the join with the wanted bins the rows are counts already, merged in the task that reads them.
    assert len(plans) == 2 and "Aggregate" in text.split("Join Inner")[1]
    counts = plans[1].groupBy("k").count().collect()
    assert max(r["count"] for r in counts) <= 7


EDGES = "edge_id long, src string, dst string, partner string"


def test_hot_pages_and_links(spark):
    data = [(i, f"p{i}", "Hub", "x") for i in range(100)] + [(1, "p1", "Hub", "x")] * 50 + [(200, " %48ub\t", "q", None), (201, "Hub", None, None), (202, "", "q", None), (None, "Hub", "z", None), (None, "Hub", "z", None)]
    df = spark.createDataFrame(data, EDGES)
    # src: 104 names (100 different, Hub 4 times: 3.8 %); dst: Hub 100 of 104, q 2 (1.9 %), z 2.
    assert rows(selection.hot_pages(df, 0.02).select("end_col", "page_name", "links")) == [("dst", "Hub", 100), ("src", "Hub", 4)]
    links = {r["page_name"]: r for r in selection.page_links(df, 0.02).collect()}
    assert (links["Hub"]["links_out"], links["Hub"]["links_in"], links["Hub"]["partners"], links["Hub"]["is_hot"]) == (4, 100, 102, True)
    assert (links["q"]["links_in"], links["q"]["partners"], links["q"]["is_hot"]) == (2, 1, False)
    assert sum(r["links_in"] for r in links.values()) == 104


def test_empty_tables(spark):
    df = spark.createDataFrame([], EDGES)
    assert selection.hot_pages(df).count() == 0 and selection.page_links(df).count() == 0
    nothing = spark.createDataFrame([(None, None, None, None)], EDGES)
    assert selection.hot_pages(nothing).count() == 0 and selection.page_links(nothing).count() == 0


def test_rows_without_a_key_all_stay(spark, tmp_path):
    edges = [(1, "A", 1), (1, "A", 1), (None, "A", 3), (None, "A", 5), (None, "A", 7)]
    spark.createDataFrame(edges, "edge_id long, dst string, link_pos int").write.parquet(str(tmp_path / "edges.parquet"))
    assert {r["n"] for r in preparation.p4_position_quantiles(spark, str(tmp_path)).collect()} == {4}
    cells = spark.createDataFrame([(1, 0, 1, 0.5), (1, 0, 1, 0.5), (None, 0, 2, 0.25), (None, 1, 2, 0.75)], "cell_id long, i long, j long, v double")
    assert rows(graph.matrix_cells(cells)) == [(0, 1, 0.5), (0, 2, 0.25), (1, 2, 0.75)]
