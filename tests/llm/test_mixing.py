import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tests.conftest import rows

DOCS, TARGETS = "doc_id long, text string, source string, h string", "source string, target_share double, max_repeats int"


def test_tree_keeps_every_quota():
    quotas = np.array([0, 1, 17, 400])
    for leaves in (1, 2, 7, 64):
        split = mixing.split_quotas(quotas, leaves, np.random.default_rng(1))
        assert split.sum(axis=0).tolist() == quotas.tolist() and (split >= 0).all()
        sizes = split.sum(axis=1)
        assert sizes.max() - sizes.min() <= np.ceil(np.log2(leaves)) + 1


def test_tree_is_fair_on_average():
    rng = np.random.default_rng(3)
    mean = np.mean([mixing.split_quotas(np.array([30, 70]), 4, rng)[2] for _ in range(400)], axis=0)
    assert mean == pytest.approx([7.5, 17.5], rel=0.06)


def test_quotas_respect_caps_and_shares():
    rows_ = mixing.plan_quotas([("a", 0.5, 1), ("b", 0.5, 3), ("gone", 0.3, 1), ("never", 0.2, 0), ("none", None, 1)], {"a": 1000, "b": 100, "never": 50, "none": 7})
    assert [(r.source, r.quota, r.full, r.rest) for r in rows_] == [("a", 300, 0, 300), ("b", 300, 3, 0)]


def mix(spark, docs, targets, **how):
    return mixing.plan_mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), **how)


@pytest.mark.parametrize("tail_documents", [100_000, 40, 1])
def test_shares_repeats_and_placements(spark, tail_documents):
    docs = [(k, "word " * (3 + k % 9), "Big " if k % 2 else "big", "x") for k in range(3000)] + [(10_000 + k, "text " * 6, "small", None) for k in range(40)]
    docs += [(20_000, "lost", "unlisted", None), (20_001, None, "small", None), (20_002, "", "big", None), (20_003, "no source", None, None)]
    targets = [(" BIG", 0.6, 1), ("small", 0.4, 4), ("absent", 0.5, 2), (None, 0.1, 1), ("small", 0.9, 9)]
    m = mix(spark, docs, targets, shard_tokens=100, tail_documents=tail_documents)
    assert (m.depths == [0]) == (tail_documents > 1000)
    uses = mixing.document_uses(m)
    assert uses.count() == len(docs)
    limits = {r["source"]: r["most"] for r in uses.groupBy("source").agg(F.max("times_used").alias("most")).collect()}
    assert limits["big"] == 1 and limits["small"] == 4 and limits["unlisted"] == 0 and limits[None] == 0
    shares = {r["source"]: r for r in mixing.source_shares(m).collect()}
    assert shares["big"]["actual_share"] == pytest.approx(0.6, abs=0.003) and shares["small"]["actual_share"] == pytest.approx(0.4, abs=0.003)
    assert shares["absent"]["tokens_used"] == 0
    placed = mixing.placements(m)
    assert rows(placed.groupBy("doc_id").agg(F.count("*"))) == rows(uses.filter("times_used > 0").selectExpr("doc_id", "cast(times_used as bigint)"))
    assert placed.select("doc_id", "copy").distinct().count() == placed.count()
    shards = mixing.shuffled_shards(m)
    per = rows(shards.groupBy("out_shard").agg(F.count("*"), F.max("position") + 1))
    assert len(per) > 3 and all(n == p for _, n, p in per)


def test_leaves_too_large_for_the_driver_are_split_by_tasks(spark):
    docs = [(k, "word " * (3 + k % 9), "big" if k % 3 else "small", "x") for k in range(3000)]
    targets = [("big", 0.5, 1), ("small", 0.5, 2)]
    whole, split = (mix(spark, docs, targets, shard_tokens=300, driver_leaves=n) for n in (4096, 4))
    assert whole.parts == 1 and split.parts > 8
    uses, placed = mixing.document_uses(split), mixing.placements(split)
    assert rows(uses) == rows(mixing.document_uses(whole))
    assert rows(placed.groupBy("doc_id").agg(F.count("*"))) == rows(uses.filter("times_used > 0").selectExpr("doc_id", "cast(times_used as bigint)"))
    assert placed.select("doc_id", "copy").distinct().count() == placed.count()
    tokens = sorted(r[1] for r in placed.groupBy("out_shard").agg(F.sum("n_tokens")).collect())
    assert len(tokens) >= 0.9 * split.parts * 4 and np.median(tokens) == pytest.approx(sum(tokens) / (split.parts * 4), rel=0.3) and tokens[-1] < 3 * np.median(tokens)


def test_same_seed_same_mix(spark):
    docs = [(k, "word " * (1 + k % 5), "s" if k % 3 else "t", None) for k in range(500)]
    one, two = (rows(mixing.placements(mix(spark, docs, [("s", 0.5, 1), ("t", 0.5, 1)], shard_tokens=200))) for _ in range(2))
    assert one == two
    other = rows(mixing.placements(mix(spark, docs, [("s", 0.5, 1), ("t", 0.5, 1)], shard_tokens=200, seed=1)))
    assert one != other


def test_empty_tables(spark):
    for docs, targets in (([], [("a", 1.0, 1)]), ([(1, "x", "a", None)], []), ([], [])):
        m = mix(spark, docs, targets)
        assert mixing.placements(m).count() == 0 and mixing.document_uses(m).agg(F.coalesce(F.sum("times_used"), F.lit(0))).first()[0] == 0
        assert mixing.source_shares(m).count() == len(targets)


def test_tail_fills_with_what_fits(spark):
    part = spark.createDataFrame([("s", h, h, n, 10) for h, n in enumerate([7, 20, 6, 2, 1])], "source string, h long, doc_id long, n_tokens long, room long")
    assert rows(mixing._tail_picks(part).filter("picked").select("n_tokens")) == [(1,), (2,), (7,)]
