"""Filling missing values from similar records: sequential hot deck.

Within a group the records are sorted; each missing value takes the nearest
previous or next observed donor, with its distance. The sort runs in two levels,
so no group has to fit one task: inside chunks of a group by window functions, and
over one summary row for each chunk (its first and last donor), whose result is
carried into the chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import number, stripped

_GROUP, _CHUNK, _ORDER, _ID, _DONOR = "__group", "__chunk", "__order", "__id", "__donor"


def _last_before(column: str, order: WindowSpec) -> Column:
    return F.last(column, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))


def nearest_donors(rows: DataFrame, *, row_id: Column, group: list[Column], chunk: Column, order: Column, value: Column) -> DataFrame:
    """Donors for every row with a null ``value``: row_id, value, donor_id, donor_distance, donor_direction.

    Rows with a null in ``group`` belong to no group, and rows without a ``row_id``
    can be named neither as a result nor as a donor: both are left aside. ``order`` is a number;
    equal numbers stand in the order of ``row_id``, and of two donors at the same
    distance the previous one is taken. Rows without a donor in their group are
    not returned. A chunk must hold neighbours in the order, that is, ``chunk``
    must not decrease along (order, row_id).
    """
    known = row_id.isNotNull()
    for g in group:
        known = known & g.isNotNull()
    base = rows.filter(known).select(F.struct(*(g.alias(f"g{k}") for k, g in enumerate(group))).alias(_GROUP), chunk.alias(_CHUNK), order.cast("double").alias(_ORDER), row_id.alias(_ID), value.alias("value"))
    at, back_at = [F.col(_ORDER).asc_nulls_first(), F.col(_ID)], [F.col(_ORDER).desc_nulls_last(), F.col(_ID).desc()]
    donor = F.when(F.col("value").isNotNull(), F.struct("value", F.col(_ID).alias("id"), F.col(_ORDER).alias("at")))
    base = base.withColumn(_DONOR, donor)
    # The next donor is the last one of the reverse order: a frame that shrinks from its start would be read anew for each row.
    inner = Window.partitionBy(_GROUP, _CHUNK)
    marked = base.withColumn("prev", _last_before(_DONOR, inner.orderBy(*at))).withColumn("next", _last_before(_DONOR, inner.orderBy(*back_at)))
    place = F.when(F.col(_DONOR).isNotNull(), F.struct(_ORDER, _ID))
    summary = base.groupBy(_GROUP, _CHUNK).agg(F.max_by(_DONOR, place).alias("last"), F.min_by(_DONOR, place).alias("first"))
    outer = Window.partitionBy(_GROUP)
    carried = summary.select(
        F.col(_GROUP).alias("cg"), F.col(_CHUNK).alias("cc"),
        _last_before("last", outer.orderBy(F.col(_CHUNK).asc_nulls_first())).alias("carry_prev"),
        _last_before("first", outer.orderBy(F.col(_CHUNK).desc_nulls_last())).alias("carry_next"),
    ).filter("carry_prev is not null or carry_next is not null")
    missing = marked.filter(F.col("value").isNull())
    joined = missing.join(carried, F.col(_GROUP).eqNullSafe(F.col("cg")) & F.col(_CHUNK).eqNullSafe(F.col("cc")), "left")
    prev, following = F.coalesce("prev", "carry_prev"), F.coalesce("next", "carry_next")
    gap = lambda d: F.coalesce(F.abs(F.col(_ORDER) - d["at"]), F.lit(0.0))
    back = prev.isNotNull() & (following.isNull() | (gap(prev) <= gap(following)))
    taken = F.when(back, prev).otherwise(following)
    return joined.select(
        F.col(_ID).alias("row_id"), taken["value"].alias("value"), taken["id"].alias("donor_id"), gap(taken).alias("donor_distance"), F.when(back, F.lit("previous")).otherwise(F.lit("next")).alias("donor_direction")
    ).filter("donor_id is not null")


@dataclass(frozen=True)
class Fill:
    """One field: which rows count, its real value (else null), and the groups to look in, the first with a donor wins."""

    field: str
    value: Column
    groups: list[tuple[list[Column], Column]]
    only: Column | None = None


def clean_checklists(checklists: DataFrame, counties: DataFrame) -> DataFrame:
    """The columns the fills need: real values typed, everything else null.

    ``counties`` is a fixed reference list; a county is real if it is in it,
    whatever its case. ``moment`` is the day of observation, with its time as a
    fraction; null (and sorted first) if year, month and day are no date. Extra columns of either table are not read.
    """
    names = counties.select(F.lower(stripped(F.col("county"))).alias("known_county")).filter("known_county is not null and known_county <> ''").distinct()
    loc = F.upper(stripped(F.col("loc_id1")))
    gid, flag, effort = stripped(F.col("group_id")), number(stripped(F.col("primary_checklist_flag"))), number(stripped(F.col("effort_distance_km")))
    day = F.expr("try_to_date(format_string('%04d-%02d-%02d', obs_year, obs_month, obs_day), 'yyyy-MM-dd')")
    slim = checklists.select(
        "row_id",
        F.when((loc != "") & (loc != "?"), loc).alias("loc"),
        F.col("obs_year").alias("y"), F.col("obs_month").alias("m"), F.col("obs_day").alias("d"), F.col("obs_time").alias("tm"),
        (F.unix_date(day) + F.coalesce(F.col("obs_time"), F.lit(0.0)) / 24).alias("moment"),
        stripped(F.col("county")).alias("county_text"),
        F.when(gid.rlike("^G[0-9]+$") & ~gid.rlike("^G0+$"), gid).alias("gid"),
        F.when(flag.isin(0.0, 1.0), flag.cast("int")).alias("flag"),
        F.when((F.abs(effort) > 0) & (F.abs(effort) <= 300), F.abs(effort)).alias("effort"),
        stripped(F.col("count_type")).isin("P22", "P34").alias("travels"),
    )
    joined = slim.join(names, F.lower("county_text") == F.col("known_county"), "left")
    return joined.select(*(c for c in slim.columns if c != "county_text"), F.when(F.col("known_county").isNotNull(), F.col("county_text")).alias("county"))


#: Rows with neighbouring ids for each chunk of a group that has no time to cut it by.
ID_BLOCK = 65_536


def checklist_fills() -> list[Fill]:
    c = F.col
    by_id = F.floor(c("row_id") / ID_BLOCK)
    return [
        Fill("county", c("county"), [([c("loc")], F.floor(c("moment") / 30))]),
        Fill("group_id", c("gid"), [([c("loc"), c("y"), c("m"), c("d"), c("tm")], by_id)]),
        Fill("primary_checklist_flag", c("flag").cast("string"), [([c("gid")], F.struct(c("moment"), by_id))]),
        Fill("effort_distance_km", c("effort").cast("string"), [([c("gid")], F.struct(c("moment"), by_id)), ([c("loc"), c("y"), c("m")], F.floor(c("moment")))], c("travels")),
    ]


def fill_missing(clean: DataFrame, fills: list[Fill]) -> DataFrame:
    """All filled values in long form: row_id, field_name, value, donor_id, donor_distance, donor_direction, donor_group (0: the first group of the field)."""
    out = None
    for fill in fills:
        rows = clean if fill.only is None else clean.filter(fill.only)
        found = None
        for rank, (group, chunk) in enumerate(fill.groups):
            donors = nearest_donors(rows, row_id=F.col("row_id"), group=group, chunk=chunk, order=F.col("moment"), value=fill.value).withColumn("donor_group", F.lit(rank))
            found = donors if found is None else found.unionByName(donors)
        if len(fill.groups) > 1:
            best = F.min_by(F.struct("value", "donor_id", "donor_distance", "donor_direction", "donor_group"), F.col("donor_group")).alias("b")
            found = found.groupBy("row_id").agg(best).select("row_id", "b.*")
        found = found.withColumn("field_name", F.lit(fill.field))
        out = found if out is None else out.unionByName(found)
    return out.select("row_id", "field_name", "value", "donor_id", "donor_distance", "donor_direction", "donor_group")


def filled_checklists(clean: DataFrame, fills: DataFrame) -> DataFrame:
    """Every record with its four fields filled where a donor exists, and a mark, donor and distance for each."""
    fields = {"county": F.col("county"), "group_id": F.col("gid"), "primary_checklist_flag": F.col("flag").cast("string"), "effort_distance_km": F.col("effort").cast("string")}
    of = lambda f: F.max(F.when(F.col("field_name") == f, F.struct("value", "donor_id", "donor_distance"))).alias(f"fill_{f}")
    wide = fills.groupBy(F.col("row_id").alias("fill_id")).agg(*(of(f) for f in fields))
    joined = clean.join(wide, clean["row_id"] == wide["fill_id"], "left")
    columns = [F.col("row_id")]
    for f, own in fields.items():
        fill = F.col(f"fill_{f}")
        typed = {"effort_distance_km": "double"}.get(f, "string")
        columns += [F.coalesce(own, fill["value"]).cast(typed).alias(f), fill.isNotNull().alias(f"{f}_is_filled"), fill["donor_id"].alias(f"{f}_donor_row_id"), fill["donor_distance"].alias(f"{f}_donor_days")]
    return joined.select(*columns)
