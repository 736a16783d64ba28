"""Queries of problems 5 to 8, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged
from ..sources.tables import table
from . import frequency, language, mixing, packing

TERM_FIELDS = ["observer_id", "loc_id1", "omernik_l3_ecoregion"]
NAME_FIELDS = ["county", "state_province", "omernik_l3_ecoregion"]


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked_terms(table(spark, d, "checklists"), record_col="sampling_event_id0", fields=TERM_FIELDS)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).filter("mark <> 'useful'").select("field_name", "term")


def p5_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All word n-grams of the names of places."""
    return frequency.word_ngrams(table(spark, d, "checklists"), record_col="sampling_event_id0", fields=NAME_FIELDS)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "pack_capacities"))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.plan_mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.document_uses(_mix(spark, d))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.source_shares(_mix(spark, d))


def p7_shards(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shuffled_shards(_mix(spark, d))


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each listed source keeps its limit of uses and comes within half a percent of its share."""
    shares = p7_shares(spark, d)
    return shares.select("source", "target_share", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("limit_kept"), (F.abs(F.col("actual_share") - F.col("target_share")) < 0.005).alias("share_met"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity the documents that have a place, those with a wrong number of pieces, and containers with more than they hold."""
    places, caps = staged(p6_pack(spark, d)), table(spark, d, "pack_capacities")
    texts = table(spark, d, "documents").select("doc_id", "n_chars")
    own = places.groupBy("capacity_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.count_if(F.col("container_id").isNull()).alias("unplaced"))
    own = own.join(caps, "capacity_id").join(texts, "doc_id")
    # A text has a token if it has a character, and never more tokens than bytes.
    wrong = (F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.col("capacity_tokens")))) | ((F.coalesce("n_chars", F.lit(0)) > 0) != (F.col("tokens") > 0)) | ((F.col("unplaced") > 0) != (F.col("tokens") == 0))
    documents = own.groupBy("capacity_id").agg(F.count("*").alias("documents"), F.count_if(wrong).alias("wrong_documents"))
    loads = places.filter("container_id is not null").groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("load")).join(caps, "capacity_id")
    return documents.join(loads.groupBy("capacity_id").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull")), "capacity_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.unnamed_languages(language.passages(table(spark, d, "documents"))).distinct()


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(language.passages(table(spark, d, "documents")))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(language.passages(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p5_found, p5_frequencies, p5_ngrams, p6_pack, p6_fill, p6_check, p7_mix, p7_shares, p7_check, p7_shards, p8_found, p8_languages, p8_passages)}

_FREQUENCIES = """
WITH long AS (
  SELECT sampling_event_id0 r, unnest([{'f': 'observer_id', 't': upper(trim(observer_id))}, {'f': 'loc_id1', 't': upper(trim(loc_id1))}, {'f': 'omernik_l3_ecoregion', 't': upper(trim(omernik_l3_ecoregion))}]) p FROM checklists),
freq AS (
  SELECT p.f field_name, p.t term, count(*) occurrences, count(DISTINCT r) records FROM long WHERE p.t IS NOT NULL AND p.t NOT IN ('', '?') GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN records < 3 THEN 'too_rare' WHEN records * 20 > (SELECT count(DISTINCT sampling_event_id0) FROM checklists) THEN 'too_common' ELSE 'useful' END mark FROM freq)
"""
_NGRAMS = r"""
WITH long AS (SELECT sampling_event_id0 r, unnest([{'f': 'county', 't': county}, {'f': 'state_province', 't': state_province}, {'f': 'omernik_l3_ecoregion', 't': omernik_l3_ecoregion}]) p FROM checklists),
w AS (SELECT r, p.f f, list_filter(string_split_regex(upper(p.t), '[ \t\r\n]+'), lambda x: x <> '') w FROM long WHERE p.t IS NOT NULL),
s AS (SELECT r, f, w, unnest(range(1, len(w) + 1)) i FROM w), g AS (SELECT r, f, w, i, unnest(range(i, len(w) + 1)) j FROM s)
SELECT f AS field_name, array_to_string(w[i:j], ' ') AS gram, CAST(j - i + 1 AS INT) AS n, count(*) AS occurrences, count(DISTINCT r) AS records FROM g GROUP BY 1, 2, 3"""
ORACLE = {
    "p5_ngrams": _NGRAMS,
    "p6_check": "SELECT capacity_id, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS wrong_documents, CAST(0 AS BIGINT) AS overfull FROM pack_capacities",
    "p7_check": "SELECT lower(trim(source)) AS source, target_share, max_repeats, true AS limit_kept, true AS share_met FROM mix_targets",
    "p5_found": _FREQUENCIES + "SELECT field_name, term FROM marked WHERE mark <> 'useful'",
    "p5_frequencies": _FREQUENCIES + "SELECT field_name, term, occurrences, records, mark FROM marked",
}
