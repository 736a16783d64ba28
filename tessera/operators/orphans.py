"""References to records that do not exist, per table, field and period.

The distinct (key, period) pairs of all references - made by partial aggregation,
so a key with a third of all rows shrinks to one row a period before any shuffle -
are cut into key ranges by hash. For each range the keys become dictionary codes
and every period gets compressed bitmaps: the keys referred to, the keys whose
parent exists at some time in it, and those whose parent exists all through it.
``references AND NOT some`` has no parent at any time of the period;
``references AND some AND NOT all`` changes within it, and only these are compared
time by time, against the parent's intervals that the decoded bit carries along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, micros, month_number, page_name
from ..session import staged
from .bitmaps import Bitmap

#: Distinct (key, period) pairs and parents for each key range, which bounds a task's memory.
RANGE_ROWS = 60_000
NAME, INDEX = "name", "index"
FOREVER = 2**31 - 1
NO_PERIOD = -1


def _tag(field: str):
    return lambda key: F.struct(F.lit(field).alias("ref_field"), key.alias("raw"))


def references(df: DataFrame, table: str, id_col: str, time_col: str, fields: list[tuple[str, str, Column]]) -> DataFrame:
    """Long form of a table's references: one row for each non-null, non-empty key of ``fields`` (field name, key space, key or array of keys)."""
    out = None
    for space in (NAME, INDEX):
        own = [(name, key) for name, s, key in fields if s == space]
        if not own:
            continue
        arrays = [F.transform(key, _tag(name)) for name, key in own]
        rows = df.select(
            F.col(id_col).cast("long").alias("ref_id"), micros(F.col(time_col)).alias("t"), F.coalesce(month_number(F.col(time_col)), F.lit(NO_PERIOD)).alias("period"), F.explode(F.concat(*arrays)).alias("r")
        )
        key = page_name(F.col("r.raw")) if space == NAME else F.col("r.raw")
        rows = rows.select(F.lit(table).alias("ref_table"), "ref_id", F.col("r.ref_field").alias("ref_field"), F.lit(space).alias("space"), blank_to_null(key).alias("key"), "period", "t")
        out = rows if out is None else out.unionByName(rows)
    return out.filter(F.col("key").isNotNull())


def parents(nodes: DataFrame, *, name_col: str = "page_name", index_col: str = "idx", from_col: str = "indexed_at", to_col: str = "deleted_at") -> DataFrame:
    """The times at which each name and index exists: [start, stop), stop null if it still does."""
    spaces = F.array(F.struct(F.lit(NAME).alias("space"), blank_to_null(page_name(F.col(name_col))).alias("key")), F.struct(F.lit(INDEX).alias("space"), F.col(index_col).cast("string").alias("key")))
    start, stop = F.col(from_col), F.col(to_col)
    first_whole = F.when(start.cast("timestamp") == F.date_trunc("month", start.cast("timestamp")), month_number(start)).otherwise(month_number(start) + 1)
    return (
        nodes.select(
            F.explode(spaces).alias("s"), micros(start).alias("start"), micros(stop).alias("stop"), month_number(start).alias("some_from"), F.coalesce(month_number(stop), F.lit(FOREVER)).alias("some_to"), first_whole.alias("all_from"), F.coalesce(month_number(stop) - 1, F.lit(FOREVER)).alias("all_to")
        )
        .select("s.space", "s.key", "start", "stop", "some_from", "some_to", "all_from", "all_to")
        .filter(F.col("key").isNotNull() & F.col("start").isNotNull())
    )


_SURVIVORS = "space string, key string, period int, intervals array<struct<start: bigint, stop: bigint>>"
_ARROW = pa.schema([("space", pa.string()), ("key", pa.string()), ("period", pa.int32()), ("intervals", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def _survivors(table: pa.Table) -> pa.Table:
    """One key range: references and parents (period null) in, surviving bits out."""
    label = pa.compute.binary_join_element_wise(table["space"].combine_chunks(), table["key"].combine_chunks(), ":")
    coded = label.dictionary_encode()
    codes = coded.indices.to_numpy()
    names = coded.dictionary
    period = table["period"].to_numpy()
    is_parent = np.isnan(period.astype(float))
    own = np.flatnonzero(is_parent)
    parent_code = codes[own]
    some_from, some_to, all_from, all_to = (table[c].to_numpy()[own].astype(np.int64) for c in ("some_from", "some_to", "all_from", "all_to"))
    order = np.argsort(parent_code, kind="stable")
    sorted_code = parent_code[order]

    kept: list[tuple[np.ndarray, int, bool]] = []  # codes, period, whether to be compared time by time
    for month in np.unique(period[~is_parent]):
        referred = Bitmap.of(codes[~is_parent & (period == month)])
        some = Bitmap.of(parent_code[(some_from <= month) & (some_to >= month)])
        whole = Bitmap.of(parent_code[(all_from <= month) & (all_to >= month)])
        never = referred.and_not(some)
        kept += [(never.decode(), int(month), False), (referred.and_not(never).and_not(whole).decode(), int(month), True)]
    if not kept:
        return _ARROW.empty_table()
    out_code = np.concatenate([k[0] for k in kept]).astype(np.int64)
    out_period = np.repeat([k[1] for k in kept], [len(k[0]) for k in kept]).astype(np.int32)
    compared = np.repeat([k[2] for k in kept], [len(k[0]) for k in kept])

    # The parents' intervals that touch the period, as one list for each compared bit.
    left = np.searchsorted(sorted_code, out_code, "left")
    count = np.where(compared, np.searchsorted(sorted_code, out_code, "right") - left, 0)
    bit = np.repeat(np.arange(len(out_code)), count)
    at = order[np.arange(len(bit)) - np.repeat(np.cumsum(count) - count, count) + left[bit]]
    near = (some_from[at] <= out_period[bit]) & (out_period[bit] <= some_to[at])
    bit, at = bit[near], at[near]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(bit, minlength=len(out_code))))).astype(np.int32)
    rows = pa.array(own[at])
    touching = pa.StructArray.from_arrays([table["start"].combine_chunks().take(rows), table["stop"].combine_chunks().take(rows)], ["start", "stop"])
    intervals = pa.ListArray.from_arrays(pa.array(offsets), touching)
    intervals = pa.compute.if_else(pa.array(compared), intervals, pa.scalar(None, intervals.type))

    parts = pa.compute.split_pattern(names.take(pa.array(out_code)), ":", max_splits=1).flatten()
    space, key = (parts.take(pa.array(np.arange(k, len(parts), 2))) for k in (0, 1))
    return pa.table([space, key, pa.array(out_period), intervals], schema=_ARROW)


def find_orphans(refs: DataFrame, parent_times: DataFrame, *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Distinct references without a parent at their time: ref_table, ref_id, ref_field, ref_key and period.

    A reference without a time has no parent. Repeated rows give one result row.
    Empty inputs give an empty result; without parents every reference is one.
    """
    pairs = staged(refs.select("space", "key", "period").distinct())
    ranges = max(1, -(-(pairs.count() + parent_times.count()) // range_rows))
    columns = ["start", "stop", "some_from", "some_to", "all_from", "all_to"]
    both = pairs.select("space", "key", "period", *(F.lit(None).cast(dict(parent_times.dtypes)[c]).alias(c) for c in columns)).unionByName(parent_times.select("space", "key", F.lit(None).cast("int").alias("period"), *columns))
    survivors = staged(both.groupBy(F.pmod(F.xxhash64("space", "key"), F.lit(ranges)).alias("key_range")).applyInArrow(_survivors, _SURVIVORS))
    covered = F.exists("intervals", lambda x: (x["start"] <= F.col("t")) & (x["stop"].isNull() | (x["stop"] > F.col("t"))))
    return (
        refs.join(survivors, ["space", "key", "period"])
        .filter(F.col("intervals").isNull() | F.col("t").isNull() | ~covered)
        .select("ref_table", "ref_id", "ref_field", F.col("key").alias("ref_key"), "period")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted per table, field and month (yyyy-mm; null without a time)."""
    month = F.when(F.col("period") >= 0, F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int")))
    return orphans.groupBy("ref_table", "ref_field", month.alias("month")).agg(F.count("*").alias("orphan_references"), F.count_distinct("ref_key").alias("orphan_keys"))


def link_graph_references(edges: DataFrame, adjacency: DataFrame, matrix: DataFrame) -> DataFrame:
    """All references of the link-graph tables to the node dictionary."""
    return (
        references(edges, "edges", "edge_id", "crawled_at", [("src", NAME, F.array("src")), ("dst", NAME, F.array("dst"))])
        .unionByName(references(adjacency, "adjacency", "adj_id", "crawled_at", [("edges", NAME, F.split(F.coalesce("edges", F.lit("")), r"\|"))]))
        .unionByName(references(matrix, "matrix_m", "cell_id", "built_at", [("i", INDEX, F.array(F.col("i").cast("string"))), ("j", INDEX, F.array(F.col("j").cast("string")))]))
    )
