"""Queries of the climate, word-count, link-graph and classifier workloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climate, features, forest, graph, links, numbering, words
from ..operators.selection import unique_links
from ..session import fresh_path, staged
from ..sources import readers, sinks
from ..sources.tables import table

# ---------------------------------------------------------------- climate


def climate_station_means(spark: SparkSession, d: str) -> DataFrame:
    rows = climate.means(climate.readings(table(spark, d, "climate_obs")), "station")
    return rows.select("station", F.round("avg_tmin", 6).alias("avg_tmin"), F.round("avg_tmax", 6).alias("avg_tmax"))


def climate_yearly_means(spark: SparkSession, d: str) -> DataFrame:
    rows = climate.station_order(climate.readings(table(spark, d, "climate_obs")))
    return rows.select("station", "year", F.round("avg_tmin", 6).alias("avg_tmin"), F.round("avg_tmax", 6).alias("avg_tmax"))


def climate_yearly_series(spark: SparkSession, d: str) -> DataFrame:
    return climate.series_text(climate.yearly_series(climate.readings(table(spark, d, "climate_obs"))))


# ---------------------------------------------------------------- words


def word_count(spark: SparkSession, d: str) -> DataFrame:
    return words.token_counts(table(spark, d, "documents"), "text")


def top_words(spark: SparkSession, d: str) -> DataFrame:
    return words.top_k(word_count(spark, d), "occurrences", "token", 100)


# ---------------------------------------------------------------- link graph


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged(unique_links(table(spark, d, "edges")))


def _index(edges: DataFrame) -> DataFrame:
    return numbering.dense_numbers(graph.nodes(edges), [F.col("node").asc()])


def node_index(spark: SparkSession, d: str) -> DataFrame:
    return _index(_edges(spark, d))


def node_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_edges(spark, d)).agg(F.count("*").alias("nodes"))


def adjacency_list(spark: SparkSession, d: str) -> DataFrame:
    """Every page and its links in their order on the page."""
    return graph.adjacency(staged(unique_links(table(spark, d, "edges"), "link_pos")), order=["link_pos"])


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degrees(_edges(spark, d))


def dangling_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(staged(_edges(spark, d)))


def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    edges = staged(_edges(spark, d))
    cells = graph.transition_matrix(edges, staged(_index(edges)), padded=True)
    return cells.select("i", "j", F.round("v", 9).alias("v"))


def dangling_mass(spark: SparkSession, d: str) -> DataFrame:
    ranks, _ = graph.initial_ranks(staged(_edges(spark, d)))
    return ranks.agg(F.round(F.coalesce(F.sum(F.when(F.col("is_dangling"), F.col("rank"))), F.lit(0.0)), 9).alias("mass"))


def _ranks(spark: SparkSession, d: str, **how) -> DataFrame:
    return graph.pagerank(_edges(spark, d), **how)


def _shown(ranks: DataFrame) -> DataFrame:
    return ranks.select(F.col("node").alias("page_name"), F.round("rank", 9).alias("rank"))


def pagerank_step(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d, iterations=1))


def pagerank_10(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d))


def pagerank_shuffle_10(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d, strategy="shuffle"))


def pagerank_broadcast_10(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d, strategy="broadcast"))


def pagerank_damped_10(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d, damped=True))


def pagerank_no_teleport_10(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_ranks(spark, d, alpha=0.0))


def pagerank_top100(spark: SparkSession, d: str) -> DataFrame:
    return words.top_k(_shown(_ranks(spark, d)), "rank", "page_name", 100)


def _stored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    own, n = graph.uniform_vector(table(spark, d, "node_index"), F.col("idx"))
    return graph.matrix_cells(table(spark, d, "matrix_m")), own, n


def matrix_product(spark: SparkSession, d: str) -> DataFrame:
    """The stored matrix times the uniform vector, damped, for every node of the dictionary."""
    cells, own, n = _stored(spark, d)
    sums = graph.multiply(cells, own).withColumnRenamed("rank", "sum")
    value = graph.ALPHA / n + (1 - graph.ALPHA) * F.coalesce("sum", F.lit(0.0))
    return own.join(sums, "node", "left").select(F.col("node").alias("i"), F.round(value, 9).alias("v"))


def matrix_dangling_mass(spark: SparkSession, d: str) -> DataFrame:
    cells, own, _ = _stored(spark, d)
    bare = own.join(cells.select(F.col("j").alias("node")).distinct(), "node", "left_anti")
    return bare.agg(F.round(F.coalesce(F.sum("rank"), F.lit(0.0)), 9).alias("mass"), F.count("*").alias("nodes"))


def matrix_top100(spark: SparkSession, d: str) -> DataFrame:
    """Names of the 100 greatest rows of the product, looked up after the top-k."""
    top = words.top_k(matrix_product(spark, d), "v", "i", 100)
    names = table(spark, d, "node_index").select(F.col("idx").alias("i"), "page_name")
    return top.join(names, "i").select("i", "page_name", "v")


# ---------------------------------------------------------------- link extraction

_PAGES = [
    'P1:<html><body><div id="bodyContent"><a href="../x/A.html">A</a><p><a href="../y/B_1.html">b</a></p><a href="../x/A.html">d</a><a href="http://x/C.html">c</a><a href="./U~r.html">u</a><a>n</a></div><a href="../x/D.html">o</a></body></html>',
    "P2:<html><body/></html>",
    'P3:<div id="bodyContent"><br></div>',
    'T~k:<div id="bodyContent"/>',
    'P4:<DIV id="BODYCONTENT"><a href="../x/Band_%28music%29.html">b</a><a href="../x/R&D.html">r</a><a href="../x/R&amp;D.html">s</a><a href="../x/A+B.html">t</a></DIV>',
]


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    found = links.extract_links(readers.rows(spark, [(p,) for p in _PAGES], "value string"))
    return found.select("page", F.array_join("links", "|").alias("links"))


def _pages(adjacency: DataFrame) -> DataFrame:
    """Crawled pages as lines ``name:html``: every list member an anchor, characters that end an attribute or tag percent-escaped."""
    href = lambda m: F.regexp_replace(F.regexp_replace(F.replace(F.replace(F.replace(m, F.lit('"'), F.lit("%22")), F.lit("<"), F.lit("%3C")), F.lit("\t"), F.lit("%09")), "\n", "%0A"), "\r", "%0D")
    anchor = lambda m: F.concat(F.lit('<a href="../x/'), href(m), F.lit('.html">l</a>'))
    body = F.array_join(F.transform(F.filter(F.split(F.coalesce("edges", F.lit("")), r"\|"), lambda m: m != ""), anchor), "")
    name = F.replace("page", F.lit(":"), F.lit("%3A"))
    return adjacency.select(F.concat(name, F.lit(':<html><body><a href="../x/Head.html">h</a><div id="bodyContent">'), body, F.lit("</div></body></html>")).alias("value"))


def link_extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """The links of every crawled page, parsed from its markup."""
    found = links.extract_links(_pages(table(spark, d, "adjacency")))
    return found.select("page", F.array_join("links", "|").alias("links"))


# ---------------------------------------------------------------- text formats, written and read again


def text_climate_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of readings that went through lines of text without a header (every delivered line counts)."""
    path = fresh_path(spark)
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("station", "obs_date", "elem", "reading")]
    sinks.value_text(table(spark, d, "climate_obs").select(F.concat_ws(",", *fields).alias("line")), path, "line")
    rows = climate.means(climate.readings(readers.climate_csv(spark, path), key=None), "station")
    return rows.select("station", F.round("avg_tmin", 6).alias("avg_tmin"), F.round("avg_tmax", 6).alias("avg_tmax"))


def text_word_count(spark: SparkSession, d: str) -> DataFrame:
    """Token counts of the texts as lines in compressed files."""
    path = fresh_path(spark)
    sinks.tab_text(table(spark, d, "documents").select("text"), path, compression="bzip2")
    return words.token_counts(readers.text_lines(spark, path), "value")


def text_index(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark)
    sinks.tab_text(node_index(spark, d).select("node", "idx"), path)
    return readers.index_text(spark, path)


def text_adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Pages and their links out of lines ``page TAB a|b``."""
    path = fresh_path(spark)
    sinks.tab_text(adjacency_list(spark, d), path, ["page", "links"])
    return readers.adjacency_text(spark, path).select("page", F.array_join("links", "|").alias("links"))


def text_matrix(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark)
    sinks.matrix_text(transition_matrix(spark, d), path)
    return readers.matrix_text(spark, path).select("i", "j", F.round("v", 9).alias("v"))


def text_tuples(spark: SparkSession, d: str) -> DataFrame:
    """The lines ``(count,token)`` of the most frequent words."""
    path = fresh_path(spark)
    sinks.tuple_text(top_words(spark, d), path, ["occurrences", "token"])
    return readers.text_lines(spark, path).select(F.col("value").alias("line"))


def text_table(spark: SparkSession, d: str) -> DataFrame:
    """A small table through a single file with a header."""
    path = fresh_path(spark)
    sinks.single_csv(table(spark, d, "counties"), path, ["subnational2_code", "county", "state_province"])
    return readers.header_csv(spark, path, "subnational2_code string, county string, state_province string")


# ---------------------------------------------------------------- features and forest

_KEEP = ("row_id", "sampling_event_id0")


def _features(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "checklists")
    once = features.latest(raw, "sampling_event_id0", [F.col("submitted_at").desc_nulls_last(), F.col("row_id").desc()]).drop("submitted_at")
    return features.prepared(once.withColumnRenamed("agelaius_phoeniceus", "Agelaius_phoeniceus"), keep=_KEEP)


def feature_prep(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).select("row_id", "label", "COUNT_TYPE_P34", "GROUP_ID", "PRIMARY_CHECKLIST_FLAG", "EFFORT_DISTANCE_KM", "COUNTY", "OBSERVER_ID", "LOC_ID1")


def distinct_per_column(spark: SparkSession, d: str) -> DataFrame:
    return features.distinct_counts(table(spark, d, "checklists"), [c.lower() for c in features.CATEGORICAL])


def frequency_index(spark: SparkSession, d: str) -> DataFrame:
    return features.frequency_index(table(spark, d, "checklists"), [c.lower() for c in features.CATEGORICAL])


def forest_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = staged(_features(spark, d))
    train, test = forest.split(rows, "row_id", 0.05)
    model = forest.fit_forest(train, ids=_KEEP)
    value = forest.accuracy(forest.predict(model, test, ids=_KEEP)) if not test.isEmpty() else None
    return spark.createDataFrame([(value, None if value is None else 1 - value)], "accuracy double, error double")


def forest_predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = staged(_features(spark, d))
    model = forest.fit_forest(forest.split(rows, "row_id", 0.05)[0], ids=_KEEP)
    return forest.predict(model, rows, ids=_KEEP).select("sampling_event_id0", "prediction")


QUERIES = {
    f.__name__: f
    for f in (
        climate_station_means, climate_yearly_means, climate_yearly_series, word_count, top_words, node_index, node_count, adjacency_list, out_degree, dangling_nodes, transition_matrix, dangling_mass,
        pagerank_step, pagerank_10, pagerank_shuffle_10, pagerank_broadcast_10, pagerank_damped_10, pagerank_no_teleport_10, pagerank_top100, matrix_product, matrix_dangling_mass, matrix_top100,
        link_extract, link_extract_pages, text_climate_means, text_word_count, text_index, text_adjacency, text_matrix, text_tuples, text_table, feature_prep, distinct_per_column, frequency_index, forest_accuracy, forest_predictions,
    )
}

_READINGS = """
r AS (SELECT station, CAST(substr(obs_date, 1, 4) AS INT) AS year, elem, nullif(reading, -9999) v
      FROM (SELECT DISTINCT ON (obs_id) * FROM climate_obs) WHERE elem IN ('TMIN', 'TMAX'))"""
_YEARLY = f"""WITH {_READINGS}, y AS (
  SELECT station, year, avg(v) FILTER (WHERE elem = 'TMIN') lo, avg(v) FILTER (WHERE elem = 'TMAX') hi FROM r GROUP BY 1, 2)"""
_WORDS = r"SELECT token, count(*) AS occurrences FROM (SELECT unnest(string_split_regex(text, '[ \t\n\r\f]+')) token FROM documents) WHERE token <> '' GROUP BY 1"
_GRAPH = """
once AS (SELECT DISTINCT ON (edge_id) edge_id, link_pos, nullif(trim(url_decode(src), ' ' || chr(9)), '') src, nullif(trim(url_decode(dst), ' ' || chr(9)), '') dst FROM edges),
e AS (SELECT src, dst, count(*) links FROM once WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2),
nodes AS (SELECT src node FROM e UNION SELECT dst FROM e),
idx AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM nodes),
deg AS (SELECT src, CAST(sum(links) AS BIGINT) degree FROM e GROUP BY 1),
dang AS (SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM deg)),
cells AS (SELECT dst i, e.src j, links / degree v FROM e JOIN deg ON e.src = deg.src),
n AS (SELECT count(*) n FROM nodes),
r0 AS (SELECT node, 1.0::DOUBLE / n AS r FROM nodes, n)"""


def _rank_sql(steps: int, alpha: float = 0.15, damp: float = 1.0) -> str:
    chain = "".join(
        f""",
r{k} AS (SELECT nodes.node, {alpha}::DOUBLE / n + (SELECT coalesce(sum(r), 0) FROM r{k - 1} WHERE node IN (SELECT node FROM dang)) * {damp} / n + {1 - alpha} * coalesce(s, 0) AS r
  FROM nodes CROSS JOIN n LEFT JOIN (SELECT i, sum(v * r) s FROM cells JOIN r{k - 1} ON j = node GROUP BY 1) q ON q.i = nodes.node)"""
        for k in range(1, steps + 1)
    )
    body = f"{_GRAPH}{chain}".replace(" AS (SELECT nodes.node", " AS MATERIALIZED (SELECT nodes.node").replace("cells AS (", "cells AS MATERIALIZED (")
    return f"WITH {body} SELECT node AS page_name, round(r, 9) AS rank FROM r{steps}"


_CATEGORIES = "UNION ALL ".join(f"SELECT '{c.lower()}' AS \"column\", {c.lower()} AS value FROM checklists " for c in features.CATEGORICAL)
_STORED = """
m AS (SELECT DISTINCT ON (cell_id) i, j, v FROM matrix_m WHERE i IS NOT NULL AND j IS NOT NULL),
own AS (SELECT DISTINCT idx FROM node_index), n AS (SELECT count(*) n FROM own),
p AS (SELECT own.idx AS i, round(0.15 / n + 0.85 * coalesce(s, 0), 9) AS v FROM own CROSS JOIN n LEFT JOIN (SELECT m.i, sum(m.v / n) s FROM m JOIN own ON own.idx = m.j CROSS JOIN n GROUP BY 1) q ON q.i = own.idx)"""
_REPLACE = "CASE {0} WHEN '?' THEN '-1.0' WHEN 'X' THEN '1.0' WHEN 'null' THEN '-1.0' ELSE {0} END"

ORACLE = {
    "climate_station_means": f"WITH {_READINGS} SELECT station, round(avg(v) FILTER (WHERE elem = 'TMIN'), 6) AS avg_tmin, round(avg(v) FILTER (WHERE elem = 'TMAX'), 6) AS avg_tmax FROM r GROUP BY 1",
    "climate_yearly_means": f"{_YEARLY} SELECT station, year, round(lo, 6) AS avg_tmin, round(hi, 6) AS avg_tmax FROM y",
    "climate_yearly_series": f"""{_YEARLY}, t AS (SELECT station, year, coalesce(printf('%.10f', lo), 'NaN') a, coalesce(printf('%.10f', hi), 'NaN') b FROM y)
      SELECT station, ', [' || string_agg('(' || year || ', ' || a || ', ' || b || ')', ', ' ORDER BY year) || ']' AS line FROM t GROUP BY 1""",
    "word_count": _WORDS,
    "top_words": f"SELECT * FROM ({_WORDS}) ORDER BY occurrences DESC, token LIMIT 100",
    "node_index": f"WITH {_GRAPH} SELECT node, idx FROM idx",
    "node_count": f"WITH {_GRAPH} SELECT count(*) AS nodes FROM nodes",
    "adjacency_list": f"""WITH {_GRAPH} SELECT src AS page, string_agg(dst, '|' ORDER BY link_pos NULLS FIRST, dst) AS links FROM once WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1
      UNION ALL SELECT node, '' FROM dang""",
    "out_degree": f"WITH {_GRAPH} SELECT src, degree FROM deg",
    "dangling_nodes": f"WITH {_GRAPH} SELECT node FROM dang",
    "transition_matrix": f"""WITH {_GRAPH}, c AS (SELECT a.idx AS i, b.idx AS j, round(v, 9) AS v FROM cells JOIN idx a ON a.node = i JOIN idx b ON b.node = j)
      SELECT i, j, v FROM c UNION ALL SELECT idx, 0, 0.0 FROM idx WHERE idx NOT IN (SELECT i FROM c)""",
    "dangling_mass": f"WITH {_GRAPH} SELECT round(coalesce(sum(r), 0), 9) AS mass FROM r0 WHERE node IN (SELECT node FROM dang)",
    "pagerank_step": _rank_sql(1),
    "pagerank_10": _rank_sql(10),
    "pagerank_shuffle_10": _rank_sql(10),
    "pagerank_broadcast_10": _rank_sql(10),
    "pagerank_damped_10": _rank_sql(10, damp=0.85),
    "pagerank_no_teleport_10": _rank_sql(10, alpha=0.0),
    "pagerank_top100": f"SELECT * FROM ({_rank_sql(10)}) ORDER BY rank DESC, page_name LIMIT 100",
    "matrix_product": f"WITH {_STORED} SELECT i, v FROM p",
    "matrix_dangling_mass": f"WITH {_STORED} SELECT round(coalesce(sum(1.0::DOUBLE / n), 0), 9) AS mass, count(*) AS nodes FROM own, n WHERE idx NOT IN (SELECT j FROM m)",
    "matrix_top100": f"WITH {_STORED}, t AS (SELECT i, v FROM p ORDER BY v DESC, i LIMIT 100) SELECT i, page_name, v FROM t JOIN node_index ON idx = i",
    "link_extract": "SELECT * FROM (VALUES ('P1', 'A|B_1|A'), ('P2', ''), ('P4', 'Band_(music)|R&D|R&amp;D|A B')) t(page, links)",
    "link_extract_pages": """WITH m AS (SELECT adj_id, replace(page, ':', '%3A') AS page, unnest(list_transform(string_split(coalesce(edges, ''), '|'), lambda x, i: {'i': i, 'n': url_decode(x)})) u, loaded_at
        FROM (SELECT row_number() OVER () AS adj_id, page, edges, loaded_at FROM adjacency)),
      l AS (SELECT adj_id, page, u.i i, regexp_extract(u.n, '([^/]*)$', 1) n FROM m)
      SELECT page, coalesce(string_agg(n, '|' ORDER BY i) FILTER (WHERE n <> '' AND NOT contains(n, '~')), '') AS links FROM l WHERE page <> '' AND NOT contains(page, '~') GROUP BY adj_id, page""",
    "text_climate_means": """WITH r AS (SELECT station, elem, nullif(reading, -9999) v FROM climate_obs)
      SELECT station, round(avg(v) FILTER (WHERE elem = 'TMIN'), 6) AS avg_tmin, round(avg(v) FILTER (WHERE elem = 'TMAX'), 6) AS avg_tmax FROM r WHERE elem IN ('TMIN', 'TMAX') GROUP BY 1""",
    "text_word_count": _WORDS,
    "text_index": f"WITH {_GRAPH} SELECT node, idx FROM idx",
    "text_tuples": f"SELECT '(' || occurrences || ',' || token || ')' AS line FROM ({_WORDS}) ORDER BY occurrences DESC, token LIMIT 100",
    "text_table": "SELECT subnational2_code, county, state_province FROM counties",
    "feature_prep": f"""WITH once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sampling_event_id0 ORDER BY submitted_at DESC, row_id DESC) rn FROM checklists) WHERE rn = 1)
      SELECT row_id, CASE WHEN TRY_CAST(agelaius_phoeniceus AS DOUBLE) > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label, CASE WHEN count_type = 'P34' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS COUNT_TYPE_P34,
        CASE WHEN group_id IS NULL OR group_id = '?' THEN 'G0000' ELSE {_REPLACE.format('group_id')} END AS GROUP_ID, TRY_CAST({_REPLACE.format('primary_checklist_flag')} AS DOUBLE) AS PRIMARY_CHECKLIST_FLAG,
        abs(TRY_CAST({_REPLACE.format('effort_distance_km')} AS DOUBLE)) AS EFFORT_DISTANCE_KM, {_REPLACE.format('county')} AS COUNTY, {_REPLACE.format('observer_id')} AS OBSERVER_ID, {_REPLACE.format('loc_id1')} AS LOC_ID1
      FROM once WHERE TRY_CAST(agelaius_phoeniceus AS DOUBLE) IS NOT NULL""",
    "distinct_per_column": f'SELECT "column", count(*) AS n FROM (SELECT DISTINCT "column", value FROM ({_CATEGORIES})) GROUP BY 1',
    "frequency_index": f"""SELECT "column", value, count(*) AS "rows", row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) - 1 AS idx FROM ({_CATEGORIES}) WHERE value IS NOT NULL GROUP BY 1, 2""",
}
ORACLE |= {"text_adjacency": ORACLE["adjacency_list"], "text_matrix": ORACLE["transition_matrix"]}
