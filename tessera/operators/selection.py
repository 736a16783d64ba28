"""Per-key results under heavy keys: exact selection by refined histograms.

For each key the wanted ranks are located in a histogram of the values; only the
bins that hold one are refined, 16 bits a round, until each rank stands on one
value. A round sends mergeable counts, aggregated map-side: a key with a third
of all rows sends as little as any other, and its values are gathered nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, page_name
from ..session import staged

BITS = 16
SHARE_UNIT = 1_000_000
#: The most bytes of wanted bins that are broadcast as a filter; beyond it all counts are shuffled.
BROADCAST_BYTES = 8 * 2**20


def _fits(wanted: DataFrame) -> bool:
    """Whether the wanted bins are small enough to be sent to every task."""
    size = wanted.agg(F.sum(F.coalesce(F.length(F.col("wk").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return size <= BROADCAST_BYTES


def select_ranks(df: DataFrame, key: str, value: str, ranks: Column, *, least_run: Column | None = None) -> DataFrame:
    """The values that stand at given ranks of each key, exactly: key, rank, value, n_equal, n.

    ``value`` is integral. ``ranks`` is an expression over ``n`` (rows of the key)
    that gives an array of 1-based ranks, ``least_run`` one that gives the fewest
    rows a value needs to be of interest: ranks in smaller bins are given up. Null
    keys form a group of their own, null values count nowhere, ties share their
    value and repeated rows count each; an empty table gives an empty result.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("long").alias("v")).filter("v is not null")
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    out_type = f"struct<k: {dict(rows.dtypes)['k']}, rank: bigint, value: bigint, n_equal: bigint, n: bigint>"
    if low is None:
        return df.sparkSession.createDataFrame([], out_type[7:-1]).select(F.col("k").alias(key), "rank", "value", "n_equal", "n")
    wide = high - low >= 2**63
    # From the least value upwards as an unsigned number: order stays, and small domains need few rounds.
    unsigned = F.col("v").bitwiseXOR(F.lit(-(2**63))) if wide else F.col("v") - F.lit(low)
    bits = 64 if wide else max(1, (high - low).bit_length())
    rows = rows.select("k", "v", unsigned.alias("u"))
    rounds = -(-bits // BITS)

    resolved, wanted = [], None
    for done in range(rounds):
        shift = (rounds - 1 - done) * BITS
        prefix = F.shiftrightunsigned("u", shift) if shift else F.col("u")
        bins = rows.withColumn("bin", prefix)
        if wanted is not None:
            narrow = wanted.select(F.col("k").alias("wk"), F.col("bin").alias("wbin"), "offset", "n", "targets")
            parent = F.shiftrightunsigned("bin", BITS)
            on = F.col("k").eqNullSafe(F.col("wk")) & (parent == F.col("wbin"))
            if _fits(narrow):
                bins = bins.join(F.broadcast(narrow.select("wk", "wbin")), on, "left_semi")
            # Counts first, rows of a hot key merged where they are read: only counts meet the wanted bins.
            counts = bins.groupBy("k", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            counts = counts.join(narrow, on).select("k", parent.alias("parent"), "bin", "c", "lo", "hi", "offset", "n", "targets")
            order = Window.partitionBy("k", "parent").orderBy("bin")
        else:
            counts = bins.groupBy("k", "bin").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            counts = counts.withColumn("n", F.sum("c").over(Window.partitionBy("k"))).withColumn("offset", F.lit(0).cast("long")).withColumn("targets", ranks)
            order = Window.partitionBy("k").orderBy("bin")
        # Unsigned prefixes below 2**63 order as they are; the first round has at most 2**16 of them.
        before = F.col("offset") + F.sum("c").over(order) - F.col("c")
        held = counts.withColumn("offset", before).withColumn("targets", F.filter("targets", lambda r: (r > F.col("offset")) & (r <= F.col("offset") + F.col("c"))))
        held = held.filter(F.size("targets") > 0)
        if least_run is not None:
            held = held.filter(F.col("c") >= least_run)
        held = staged(held.select("k", "bin", "c", "lo", "hi", "offset", "n", "targets"))
        resolved.append(held.filter("lo = hi").select("k", F.explode("targets").alias("rank"), F.col("lo").alias("value"), F.col("c").alias("n_equal"), "n"))
        wanted = held.filter("lo < hi").select("k", "bin", "offset", "n", "targets")
        if done + 1 == rounds or wanted.isEmpty():
            break
    out = resolved[0]
    for more in resolved[1:]:
        out = out.unionByName(more)
    return out.select(F.col("k").alias(key), "rank", "value", "n_equal", "n")


def exact_quantiles(df: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """Discrete quantiles for every key: key, fraction, value, n (the value at rank ceil(fraction * n), 1 at least)."""
    table = F.array(*(F.lit(float(q)) for q in fractions))
    rank = lambda q, n: F.greatest(F.lit(1).cast("long"), F.ceil(q * n))
    hit = select_ranks(df, key, value, F.array_distinct(F.transform(table, lambda q: rank(q, F.col("n")))))
    return hit.withColumn("fraction", F.explode(F.filter(table, lambda q: rank(q, F.col("n")) == F.col("rank")))).select(key, "fraction", F.col("value"), "n")


def frequent_values(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The integral values that make up at least ``share`` of a key's rows: key, value, n_equal, n.

    Such a value covers, in sorted order, a run of at least share * n ranks, and
    every run that long holds a multiple of its length: the values at those ranks
    are all candidates, at most 1 / share for each key.
    """
    units = max(1, round(share * SHARE_UNIT))
    run = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.lit(units) / F.lit(SHARE_UNIT)))
    hit = select_ranks(df, key, value, F.sequence(run, F.col("n"), run), least_run=run)
    return hit.filter(F.col("n_equal") * SHARE_UNIT >= F.col("n") * units).select(key, "value", "n_equal", "n").distinct()


def unique_links(edges: DataFrame, *more: str) -> DataFrame:
    """Each link once: (src, dst) as compared, and the columns ``more``; null where there is no name. Rows without an edge_id have nothing to compare and all stay."""
    named = edges.select("edge_id", blank_to_null(page_name(F.col("src"))).alias("src"), blank_to_null(page_name(F.col("dst"))).alias("dst"), *more)
    return named.filter("edge_id is not null").dropDuplicates(["edge_id"]).unionByName(named.filter("edge_id is null"))


def hot_pages(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """Pages that stand in a column of at least ``share`` of the links with a name there: end_col, page_name, links, links_in_column.

    Selection runs on 64-bit hashes of the names, deduplicated by edge_id; names
    are looked up for the few hashes found (at most 2 / share), and a hash that
    two names share is counted again by name.
    """
    hashed = edges.select("edge_id", *(F.xxhash64(blank_to_null(page_name(F.col(c)))).alias(c) for c in ("src", "dst")), *(blank_to_null(page_name(F.col(c))).isNotNull().alias(f"has_{c}") for c in ("src", "dst")))
    hashed = hashed.select("edge_id", *(F.when(F.col(f"has_{c}"), F.col(c)).alias(c) for c in ("src", "dst")))
    once = hashed.filter("edge_id is not null").dropDuplicates(["edge_id"]).unionByName(hashed.filter("edge_id is null")).select("src", "dst")
    ends = staged(once).select(F.explode(F.array(*(F.struct(F.lit(c).alias("end_col"), F.col(c).alias("h")) for c in ("src", "dst")))).alias("e")).select("e.*")
    found = staged(frequent_values(ends, "end_col", "h", share))
    both = edges.select("edge_id", F.explode(F.array(*(F.struct(F.lit(c).alias("end_col"), blank_to_null(page_name(F.col(c))).alias("page_name")) for c in ("src", "dst")))).alias("e")).select("edge_id", "e.*").filter("page_name is not null")
    rows = both.withColumn("value", F.xxhash64("page_name")).join(found, ["end_col", "value"])
    names = rows.groupBy("end_col", "value", "page_name").agg(F.first("n_equal").alias("links"), F.first("n").alias("links_in_column"))
    names = staged(names)
    shared = names.groupBy("end_col", "value").agg(F.count("*").alias("spellings")).filter("spellings > 1")
    if not shared.isEmpty():
        again = rows.join(shared, ["end_col", "value"], "left_semi").select("edge_id", "end_col", "page_name", "n")
        again = again.filter("edge_id is not null").dropDuplicates(["edge_id", "end_col"]).unionByName(again.filter("edge_id is null"))
        counted = again.groupBy("end_col", "page_name").agg(F.count("*").alias("links"), F.first("n").alias("links_in_column"))
        units = max(1, round(share * SHARE_UNIT))
        names = names.join(shared, ["end_col", "value"], "left_anti").select("end_col", "page_name", "links", "links_in_column").unionByName(counted.filter(F.col("links") * SHARE_UNIT >= F.col("links_in_column") * units))
    return names.select("end_col", "page_name", "links", "links_in_column")


def page_links(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """Links of every page: page_name, links_out, links_in, partners (distinct pages at the other end) and whether it is hot.

    Counts merge per (page, partner) first: a hot page's links are spread by
    partner, and what is left of them sums map-side.
    """
    links = staged(unique_links(edges))
    sides = F.array(
        F.struct(F.col("src").alias("page_name"), F.col("dst").alias("partner"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("page_name"), F.col("src").alias("partner"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    ends = links.select(F.explode(sides).alias("e")).select("e.*").filter("page_name is not null")
    pairs = ends.groupBy("page_name", "partner").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    totals = pairs.groupBy("page_name").agg(F.sum("o").alias("links_out"), F.sum("i").alias("links_in"), F.count("partner").alias("partners"))
    columns = links.select(F.explode(F.array(*(F.struct(F.lit(c).alias("end_col"), F.col(c).alias("page_name")) for c in ("src", "dst")))).alias("e")).select("e.*").filter("page_name is not null")
    hashed = columns.withColumn("value", F.xxhash64("page_name"))
    found = staged(frequent_values(hashed, "end_col", "value", share))
    # Counted by name among the rows of the hashes found, so that a shared hash makes no page hot.
    counted = hashed.join(found, ["end_col", "value"]).groupBy("end_col", "page_name").agg(F.count("*").alias("links"), F.first("n").alias("n"))
    hot = counted.filter(F.col("links") * SHARE_UNIT >= F.col("n") * max(1, round(share * SHARE_UNIT))).select("page_name").distinct().withColumn("is_hot", F.lit(True))
    return totals.join(hot, "page_name", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
