"""Queries of the data-preparation problems 1 to 4, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hotdeck, orphans, parsing, selection
from ..session import staged
from ..sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_records(table(spark, d, "raw_checklists"), with_fields=False).filter("not is_valid").select("line_id").distinct()


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rejected_records(parsing.parse_records(table(spark, d, "raw_checklists"), with_fields=False))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return parsing.valid_records(parsing.parse_records(table(spark, d, "raw_checklists")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.link_graph_references(table(spark, d, "edges"), table(spark, d, "adjacency"), table(spark, d, "matrix_m"))
    return orphans.find_orphans(refs, orphans.parents(table(spark, d, "node_index")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("period")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def _fills(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # Five sorts read the cleaned columns: they are written once.
    clean = staged(hotdeck.clean_checklists(table(spark, d, "checklists"), table(spark, d, "counties")))
    return clean, hotdeck.fill_missing(clean, hotdeck.checklist_fills())


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _fills(spark, d)[1].select("row_id", "field_name").distinct()


def p3_filled(spark: SparkSession, d: str) -> DataFrame:
    return hotdeck.filled_checklists(*_fills(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return selection.hot_pages(table(spark, d, "edges")).select("end_col", "page_name").distinct()


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    return selection.page_links(table(spark, d, "edges"))


def p4_position_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quartiles of the link position for every target page, each link once. Rows without an edge_id all stay."""
    edges = table(spark, d, "edges").select("edge_id", "dst", "link_pos")
    once = edges.filter("edge_id is not null").dropDuplicates(["edge_id"]).unionByName(edges.filter("edge_id is null"))
    named = once.select(selection.blank_to_null(selection.page_name(F.col("dst"))).alias("page_name"), "link_pos").filter("page_name is not null")
    return selection.exact_quantiles(named, "page_name", "link_pos", [0.25, 0.5, 0.75]).select("page_name", "fraction", F.col("value").alias("link_pos"), "n")


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_records, p2_found, p2_report, p3_found, p3_filled, p4_found, p4_links, p4_position_quantiles)}

# A line cut at its quotes: the parts with an even number (from 1) stand inside of quotes, an empty part between two of
# them is a doubled quote. Parts outside must begin and end with a comma where a quote stands next to them.
_LINES = r"""
q AS (SELECT line_id, raw_line, string_split(raw_line, '"') AS p FROM raw_checklists),
w AS (SELECT line_id, raw_line, len(p) AS n,
    list_filter(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 OR x = '' THEN NULL
      WHEN i > 1 AND x[1] <> ',' THEN 'text_after_quote' WHEN i < len(p) AND x[-1] <> ',' THEN 'stray_quote' END), lambda v: v IS NOT NULL) AS faults,
    string_split(array_to_string(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 THEN replace(x, ',', chr(1)) ELSE x END), '"'), ',') AS masked
  FROM q),
f AS (SELECT line_id, raw_line, n, faults, list_transform(masked, lambda m: replace(replace(CASE WHEN m[1] = '"' THEN m[2:-2] ELSE m END, chr(1), ','), '""', '"')) AS v FROM w),
judged AS (SELECT line_id, v, CASE WHEN raw_line IS NULL THEN 'null_line' WHEN len(faults) > 0 THEN faults[1] WHEN n % 2 = 0 THEN 'unclosed_quote'
    WHEN trim(raw_line, chr(9) || chr(10) || chr(13) || ' ') = '' THEN 'empty_line' WHEN len(v) < 15 THEN 'too_few_fields' WHEN len(v) > 15 THEN 'too_many_fields'
    WHEN v[9] NOT IN ('P20', 'P21', 'P22', 'P23', 'P34', 'P35', 'P48') THEN 'bad_count_type'
    WHEN NOT (v[14] IN ('X', '?') OR regexp_full_match(v[14], '[0-9]+')) THEN 'bad_agelaius_phoeniceus' END AS reject_reason FROM f)"""


def _typed(number: int, name: str) -> str:
    name = name.lower()
    kind, form = {"int": ("INT", r"[+-]?[0-9]+"), "double": ("DOUBLE", r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?")}.get(parsing.TYPED.get(name.upper(), ""), (None, None))
    return f"CASE WHEN regexp_full_match(trim(v[{number}]), '{form}') THEN TRY_CAST(trim(v[{number}]) AS {kind}) END AS {name}" if kind else f"v[{number}] AS {name}"


_REF = "trim(url_decode({0}), ' ' || chr(9))"
_REFS = f"""
refs AS (
  SELECT DISTINCT 'edges' ref_table, edge_id ref_id, 'src' ref_field, {_REF.format('src')} ref_key, crawled_at t FROM edges
  UNION SELECT DISTINCT 'edges', edge_id, 'dst', {_REF.format('dst')}, crawled_at FROM edges
  UNION SELECT DISTINCT 'adjacency', adj_id, 'edges', {_REF.format('member')}, crawled_at
        FROM (SELECT adj_id, crawled_at, unnest(string_split(edges, '|')) AS member FROM adjacency)
  UNION SELECT DISTINCT 'matrix_m', cell_id, 'i', CAST(i AS VARCHAR), built_at FROM matrix_m
  UNION SELECT DISTINCT 'matrix_m', cell_id, 'j', CAST(j AS VARCHAR), built_at FROM matrix_m),
parents AS (
  SELECT 'name' space, {_REF.format('page_name')} k, indexed_at a, deleted_at b FROM node_index
  UNION ALL SELECT 'index', CAST(idx AS VARCHAR), indexed_at, deleted_at FROM node_index),
orphans AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, ref_key, t FROM refs
  WHERE ref_key IS NOT NULL AND ref_key <> '' AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.space = CASE WHEN ref_table = 'matrix_m' THEN 'index' ELSE 'name' END
      AND p.k = ref_key AND p.a <= refs.t AND (p.b IS NULL OR p.b > refs.t)))"""

_NUM = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_CLEAN = rf"""
s AS (
  SELECT row_id, upper(trim(loc_id1)) l, obs_year y, obs_month m, obs_day d, obs_time tm, trim(county) ct, trim(group_id) g,
    CASE WHEN regexp_full_match(trim(primary_checklist_flag), '{_NUM}') THEN TRY_CAST(trim(primary_checklist_flag) AS DOUBLE) END f,
    CASE WHEN regexp_full_match(trim(effort_distance_km), '{_NUM}') THEN abs(TRY_CAST(trim(effort_distance_km) AS DOUBLE)) END e,
    trim(count_type) IN ('P22', 'P34') AS travels
  FROM checklists),
c AS (
  SELECT row_id, CASE WHEN l NOT IN ('', '?') THEN l END loc, y, m, d, tm,
    date_diff('day', DATE '1970-01-01', make_date(y, m, d)) + coalesce(tm, 0) / 24 AS moment,
    CASE WHEN lower(ct) IN (SELECT lower(trim(county)) FROM counties WHERE county IS NOT NULL) THEN ct END county,
    CASE WHEN regexp_full_match(g, 'G[0-9]+') AND NOT regexp_full_match(g, 'G0+') THEN g END gid,
    CASE WHEN f IN (0, 1) THEN CAST(CAST(f AS INT) AS VARCHAR) END flag,
    CASE WHEN e > 0 AND e <= 300 THEN e END effort, travels
  FROM s)"""


def _nearest(field: str, value: str, group: str, rank: int, where: str = "true") -> str:
    known = " AND ".join(f"{g.strip()} IS NOT NULL" for g in group.split(","))
    return f"""
  SELECT row_id, '{field}' field_name, {rank} rnk,
    CASE WHEN prev IS NOT NULL AND (nxt IS NULL OR moment - prev.at <= nxt.at - moment) THEN prev ELSE nxt END AS donor, moment
  FROM (SELECT row_id, {value} v, moment,
      last_value(CASE WHEN {value} IS NOT NULL THEN {{'v': {value}, 'id': row_id, 'at': moment}} END IGNORE NULLS)
        OVER (PARTITION BY {group} ORDER BY moment, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) prev,
      first_value(CASE WHEN {value} IS NOT NULL THEN {{'v': {value}, 'id': row_id, 'at': moment}} END IGNORE NULLS)
        OVER (PARTITION BY {group} ORDER BY moment, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nxt
    FROM c WHERE {known} AND {where})
  WHERE v IS NULL AND (prev IS NOT NULL OR nxt IS NOT NULL)"""


_FILLS = f"""
cc AS (SELECT * FROM c),
f1 AS ({_nearest('county', 'county', 'loc', 0)}),
f2 AS ({_nearest('group_id', 'gid', 'loc, y, m, d, tm', 0)}),
f3 AS ({_nearest('primary_checklist_flag', 'flag', 'gid', 0)}),
f4 AS (SELECT row_id, field_name, arg_min(donor, rnk) donor, any_value(moment) moment FROM (
  {_nearest('effort_distance_km', 'effort', 'gid', 0, 'travels')} UNION ALL {_nearest('effort_distance_km', 'effort', 'loc, y, m', 1, 'travels')}) GROUP BY 1, 2)"""

_HALF = """
once AS (SELECT DISTINCT ON (edge_id) edge_id, nullif(trim(url_decode(src), ' ' || chr(9)), '') src, nullif(trim(url_decode(dst), ' ' || chr(9)), '') dst, link_pos FROM edges),
ends AS (SELECT 'src' end_col, src page_name FROM once WHERE src IS NOT NULL UNION ALL SELECT 'dst', dst FROM once WHERE dst IS NOT NULL),
hot AS (SELECT end_col, page_name FROM ends GROUP BY 1, 2 HAVING count(*) * 50 >= (SELECT count(*) FROM ends e WHERE e.end_col = ends.end_col))"""

ORACLE = {
    "p1_found": f"WITH {_LINES} SELECT DISTINCT line_id FROM judged WHERE reject_reason IS NOT NULL",
    "p1_rejects": f"WITH {_LINES} SELECT line_id, reject_reason FROM judged WHERE reject_reason IS NOT NULL",
    "p1_records": f"WITH {_LINES} SELECT line_id, {', '.join(_typed(k, n) for k, n in enumerate(parsing.FIELDS, 1))} FROM judged WHERE reject_reason IS NULL",
    "p2_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, ref_field, ref_key FROM orphans",
    "p2_report": f"WITH {_REFS} SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS month, count(DISTINCT (ref_id, ref_key)) AS orphan_references, count(DISTINCT ref_key) AS orphan_keys FROM orphans GROUP BY 1, 2, 3",
    "p3_found": f"WITH {_CLEAN},{_FILLS} SELECT row_id, field_name FROM f1 UNION SELECT row_id, field_name FROM f2 UNION SELECT row_id, field_name FROM f3 UNION SELECT row_id, field_name FROM f4",
    "p3_filled": f"""WITH {_CLEAN},{_FILLS} SELECT c.row_id,
      coalesce(county, f1.donor.v) county, f1.row_id IS NOT NULL county_is_filled, f1.donor.id county_donor_row_id, abs(f1.moment - f1.donor.at) county_donor_days,
      coalesce(gid, f2.donor.v) group_id, f2.row_id IS NOT NULL group_id_is_filled, f2.donor.id group_id_donor_row_id, abs(f2.moment - f2.donor.at) group_id_donor_days,
      coalesce(flag, f3.donor.v) primary_checklist_flag, f3.row_id IS NOT NULL primary_checklist_flag_is_filled, f3.donor.id primary_checklist_flag_donor_row_id, abs(f3.moment - f3.donor.at) primary_checklist_flag_donor_days,
      coalesce(effort, f4.donor.v) effort_distance_km, f4.row_id IS NOT NULL effort_distance_km_is_filled, f4.donor.id effort_distance_km_donor_row_id, abs(f4.moment - f4.donor.at) effort_distance_km_donor_days
      FROM c LEFT JOIN f1 ON f1.row_id = c.row_id LEFT JOIN f2 ON f2.row_id = c.row_id LEFT JOIN f3 ON f3.row_id = c.row_id LEFT JOIN f4 ON f4.row_id = c.row_id""",
    "p4_found": f"WITH {_HALF} SELECT end_col, page_name FROM hot",
    "p4_links": f"""WITH {_HALF}, sides AS (SELECT src page_name, dst partner, 1 o, 0 i FROM once WHERE src IS NOT NULL UNION ALL SELECT dst, src, 0, 1 FROM once WHERE dst IS NOT NULL)
      SELECT page_name, CAST(sum(o) AS BIGINT) links_out, CAST(sum(i) AS BIGINT) links_in, count(DISTINCT partner) partners, page_name IN (SELECT page_name FROM hot) is_hot FROM sides GROUP BY 1""",
    "p4_position_quantiles": f"""WITH {_HALF}, q AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) fraction),
      r AS (SELECT dst page_name, link_pos, row_number() OVER (PARTITION BY dst ORDER BY link_pos) rn, count(*) OVER (PARTITION BY dst) n FROM once WHERE dst IS NOT NULL AND link_pos IS NOT NULL)
      SELECT page_name, fraction, CAST(link_pos AS BIGINT) link_pos, n FROM r, q WHERE rn = greatest(1, CAST(ceil(fraction * n) AS BIGINT))""",
}
