from datetime import datetime as dt

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import orphans
from tessera.operators.bitmaps import Bitmap
from tests.conftest import rows

NODES = "page_name string, idx long, indexed_at timestamp_ntz, deleted_at timestamp_ntz"
EDGES = "edge_id long, src string, dst string, crawled_at timestamp_ntz, period string"
ADJ, MAT = "adj_id long, page string, edges string, crawled_at timestamp_ntz", "cell_id long, i long, j long, built_at timestamp_ntz"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 200_000), max_size=300), st.lists(st.integers(0, 200_000), max_size=300), st.integers(0, 9000), st.integers(0, 9000))
def test_bitmap_and_not(a, b, many_a, many_b):
    a, b = np.array(a + list(range(many_a)), np.int64), np.array(b + list(range(0, 2 * many_b, 2)), np.int64)
    assert Bitmap.of(a).and_not(Bitmap.of(b)).decode().tolist() == sorted(set(a.tolist()) - set(b.tolist()))


def find(spark, edges=(), adj=(), mat=(), nodes=(), **how):
    refs = orphans.link_graph_references(spark.createDataFrame(list(edges), EDGES), spark.createDataFrame(list(adj), ADJ), spark.createDataFrame(list(mat), MAT))
    return orphans.find_orphans(refs, orphans.parents(spark.createDataFrame(list(nodes), NODES)), **how)


def test_times_names_and_nulls(spark):
    nodes = [
        ("A", 1, dt(2017, 1, 10), None), ("B", 2, dt(2016, 1, 1), dt(2017, 2, 10)), ("B", 3, dt(2017, 2, 20), None), ("C d", 4, dt(2016, 1, 1), None),
        (None, 5, dt(2016, 1, 1), None), ("E", None, dt(2016, 1, 1), None), ("F", 6, None, None), ("A:b", 7, dt(2017, 1, 1), dt(2017, 2, 1)),
    ]
    edges = [
        (1, "A", " %41\t", dt(2017, 1, 9), "x"), (2, "A", "B", dt(2017, 1, 10), "x"), (3, "B", "C%20d", dt(2017, 2, 10), None), (4, "B", "B", dt(2017, 2, 20), None),
        (5, None, "", dt(2017, 3, 1), None), (6, "F", " \t", dt(2017, 3, 1), None), (6, "F", " \t", dt(2017, 3, 1), None), (7, "A", "100%zz+", None, None), (8, "A:b", "a", dt(2017, 1, 31), None), (9, "A:b", "A", dt(2017, 2, 1), None),
    ]
    adj = [(1, "nowhere", "|A||Z|Z|", dt(2017, 5, 1)), (2, "A", None, dt(2017, 5, 1)), (3, "A", "", None)]
    mat = [(1, 1, 99, dt(2017, 5, 1)), (2, None, 2, dt(2017, 2, 15)), (2, None, 2, dt(2017, 2, 15)), (3, 5, 7, dt(2017, 1, 31, 23, 59))]
    expected = [
        ("adjacency", 1, "edges", "Z"), ("edges", 1, "dst", "A"), ("edges", 1, "src", "A"), ("edges", 3, "src", "B"), ("edges", 6, "src", "F"), ("edges", 7, "dst", "100%zz+"), ("edges", 7, "src", "A"), ("edges", 8, "dst", "a"),
        ("edges", 9, "src", "A:b"), ("matrix_m", 1, "j", "99"), ("matrix_m", 2, "j", "2"),
    ]
    for size in (1, 3, 1000):  # the number of key ranges must not matter
        assert rows(find(spark, edges, adj, mat, nodes, range_rows=size).drop("period")) == sorted(expected, key=str)
    report = orphans.orphan_report(find(spark, edges, adj, mat, nodes))
    assert ("edges", "src", "2017-01", 1, 1) in rows(report) and ("edges", "src", None, 1, 1) in rows(report)


def test_empty_tables(spark):
    assert find(spark).count() == 0
    assert rows(find(spark, edges=[(1, "A", None, dt(2017, 1, 1), None)]).drop("period")) == [("edges", 1, "src", "A")]
    assert find(spark, nodes=[("A", 1, dt(2017, 1, 1), None)]).count() == 0
