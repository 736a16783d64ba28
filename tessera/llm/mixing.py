"""Mixing sources to target weights: multivariate-hypergeometric splitting tree.

A pseudo-random permutation (the order of a hash) cuts each source into blocks, and
a block that a quota ends in into finer ones, until few documents are left to choose. The blocks a source has
to give (with repeats) are its exact quota; a binary tree splits the vector of
quotas among the output shards, at each node by one multivariate-hypergeometric
draw, so that every shard gets a random mix and no block is lost or used twice.
Leaves then take the next blocks of each source's permuted sequence and shuffle
their documents locally. Only block sizes, a bounded number, reach the driver: the
upper part of the tree grows there, and where its leaves are larger than a shard
should be, each is split further by a task of its own, over finer blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .tokens import with_token_counts

#: Each source, and each block that is refined, has 2 ** BLOCK_BITS blocks, whatever its size; with the listed
#: sources they bound what the driver holds. Blocks can be refined until the hash's 64 bits are used up.
BLOCK_BITS, MOST_DEPTH = 9, 7
#: Tokens aimed at for each output shard, and the most leaves of the tree on the driver; larger leaves are split by tasks.
SHARD_TOKENS, DRIVER_LEAVES = 4_000_000, 4096
#: Finer blocks for each output shard, at least, where a leaf is split by a task.
FINE_BLOCKS = 32
SEED = 20240229
#: Blocks whose documents may fill what whole blocks leave of a quota, the documents they may hold together, and rounds of filling.
TAIL_BLOCKS, TAIL_DOCUMENTS, TAIL_ROUNDS = 16, 100_000, 4


def source_name(column):
    return F.lower(F.trim(column, F.lit(" \t\r\n")))


def split_quotas(quotas: np.ndarray, leaves: int, rng: np.random.Generator) -> np.ndarray:
    """(leaves, sources): how many of each source's blocks every output shard gets; columns sum to ``quotas``."""
    out = np.zeros((leaves, len(quotas)), np.int64)

    def visit(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[low] = counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        left = rng.multivariate_hypergeometric(counts, round(total * (middle - low) / (high - low)), method="marginals")
        visit(left, low, middle)
        visit(counts - left, middle, high)

    visit(np.asarray(quotas, np.int64), 0, leaves)
    return out


@dataclass
class Quota:
    source: str
    share: float
    tokens: int
    max_repeats: int
    quota: int = 0

    @property
    def full(self) -> int:
        return self.quota // self.tokens

    @property
    def rest(self) -> int:
        return self.quota - self.full * self.tokens


def plan_quotas(targets: list[tuple[str, float, int]], tokens: dict[str, int]) -> list[Quota]:
    """Tokens each source gives to the largest mix in which every share is met and no document is used too often.

    Sources without tokens, share or allowed use cannot take part; the shares of
    the others then count in proportion to one another.
    """
    rows = [Quota(s, share, tokens[s], repeats) for s, share, repeats in targets if share and share > 0 and tokens.get(s) and repeats > 0]
    whole = sum(r.share for r in rows)
    for r in rows:
        r.share /= whole
    total = min((r.tokens * r.max_repeats / r.share for r in rows), default=0)
    for r in rows:
        r.quota = min(round(total * r.share), r.tokens * r.max_repeats)
    return rows


def block_at(depth: int) -> Column:
    """The block of a document at a depth: the leading bits of its hash."""
    return F.shiftrightunsigned("h", 64 - BLOCK_BITS * (depth + 1))


def _sequences(sized: DataFrame, quotas: list[Quota], sizes: dict[str, dict[int, tuple[int, int]]], rng: np.random.Generator, tail_documents: int) -> list[list[tuple[int, int, int, int]]]:
    """For each source its uses of blocks in permuted order: (depth, block, copy, room); room is -1, or the tokens left for the tail blocks, used in part."""
    uses = []
    for q in quotas:
        own = np.array(sorted(sizes[q.source]), np.int64)
        uses.append([(0, int(b), copy, -1) for copy in range(q.full) for b in rng.permutation(own)])
    open_at = {k: (sizes[q.source], q.rest) for k, q in enumerate(quotas) if q.rest}
    for depth in range(MOST_DEPTH):
        finer: dict[int, tuple[int, int]] = {}
        for k, (blocks, left) in open_at.items():
            order = [int(b) for b in rng.permutation(np.array(sorted(blocks), np.int64))]
            at = 0
            while at < len(order) and blocks[order[at]][0] <= left:
                uses[k].append((depth, order[at], quotas[k].full, -1))
                left -= blocks[order[at]][0]
                at += 1
            tail = order[at : at + TAIL_BLOCKS]
            if left <= 0 or not tail:
                continue
            if sum(blocks[b][1] for b in tail) <= tail_documents or depth + 1 == MOST_DEPTH:
                uses[k] += [(depth, b, quotas[k].full, left) for b in tail]
            else:
                finer[k] = (tail[0], left)
        if not finer:
            break
        inside = F.lit(False)
        for k, (block, _) in finer.items():
            inside = inside | ((F.col("source") == quotas[k].source) & (block_at(depth) == block))
        found = _block_sizes(sized.filter(inside), depth + 1)
        open_at = {k: (found[quotas[k].source], left) for k, (_, left) in finer.items()}
    return uses


def _block_sizes(sized: DataFrame, depth: int) -> dict[str, dict[int, tuple[int, int]]]:
    """Tokens and documents of every block, by source; at most 2 ** BLOCK_BITS for each source."""
    out: dict[str, dict[int, tuple[int, int]]] = {}
    rows = sized.filter("n_tokens > 0").groupBy("source", block_at(depth).alias("block")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    for source, block, t, n in rows.collect():
        out.setdefault(source, {})[block] = (int(t), int(n))
    return out


def _dealt(quotas: list[Quota], sequences: list[list[tuple[int, int, int, int]]], rng: np.random.Generator, shards: int) -> list[tuple[str, int, int, int, int, int]]:
    """The uses dealt to the leaves of the splitting tree: (source, depth, block, copy, room, leaf)."""
    leaves = split_quotas(np.array([len(s) for s in sequences]), shards, rng)
    out, at = [], [0] * len(sequences)
    for shard, counts in enumerate(leaves):
        for k, count in enumerate(counts):
            out += [(quotas[k].source, *use, shard) for use in sequences[k][at[k] : at[k] + count]]
            at[k] += int(count)
    return out


def fine_block(depth: int, bits: int) -> Column:
    """The ``bits`` of a document's hash below its block at a depth, as far as there are any."""
    left = 64 - BLOCK_BITS * (depth + 1)
    bits = min(bits, left)
    return F.shiftrightunsigned("h", left - bits).bitwiseAND(F.lit((1 << bits) - 1)) if bits > 0 else F.lit(0).cast("long")


def _split_leaf(parts: int, bits: int, seed: int):
    """The lower part of the tree: the whole blocks of one leaf, cut into 2 ** ``bits`` finer ones, dealt to its ``parts`` output shards."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["source", "depth", "block", "copy"], kind="stable").reset_index(drop=True)
        leaf = int(rows["out_shard"].iloc[0])
        rng = np.random.default_rng([seed, leaf])
        # A block so deep that few bits are left has fewer finer ones.
        fine = np.maximum(0, np.minimum(bits, 64 - BLOCK_BITS * (rows["depth"].to_numpy() + 1)))
        count = np.where(rows["room"].to_numpy() < 0, 1 << fine, 1)
        at = np.repeat(np.arange(len(rows)), count)
        number = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        source = rows["source"].astype("category").cat.codes.to_numpy()[at]
        dealt = np.empty(len(at), np.int64)
        leaves = split_quotas(np.bincount(source), parts, rng)
        for k in range(leaves.shape[1]):
            own = rng.permutation(np.flatnonzero(source == k))
            dealt[own] = np.repeat(np.arange(parts), leaves[:, k])
        out = rows.iloc[at].reset_index(drop=True)
        whole = out["room"].to_numpy() < 0
        # The tail of a quota, used in part, is not cut.
        return out.assign(fine=np.where(whole, number, -1), out_shard=leaf * parts + dealt)

    return run


@dataclass
class Mix:
    """The sized documents (doc_id, source, n_tokens, h), the plan (source, depth, block, copy, room, out_shard) and, if its leaves are split by tasks, into how many shards each and by how many finer bits."""

    sized: DataFrame
    plan: DataFrame
    targets: DataFrame
    depths: list[int]
    parts: int = 1
    bits: int = 0
    seed: int = SEED


def plan_mix(documents: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, shard_tokens: int = SHARD_TOKENS, driver_leaves: int = DRIVER_LEAVES, tail_documents: int = TAIL_DOCUMENTS, tokenizer_dir: str | None = None) -> Mix:
    """Measure the documents once and plan the mix.

    ``targets`` (source, target_share, max_repeats) is a small fixed list; names
    count stripped and in lower case, of a name listed twice the first row in
    order counts, a null ``max_repeats`` is 1. Documents of unlisted or null
    sources and those without a token are used 0 times; empty tables plan nothing.
    """
    spark = documents.sparkSession
    listed: dict[str, tuple[str, float, int]] = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").filter("s is not null").orderBy("s", "target_share", "max_repeats").collect():
        listed.setdefault(r[0], (r[0], float(r[1] or 0), 1 if r[2] is None else int(r[2])))
    slim = documents.select(F.col(id_col).alias("doc_id"), source_name(F.col(source_col).cast("string")).alias("source"), F.col(text_col).cast("string").alias("text"))
    sized = staged(with_token_counts(slim, "text", "n_tokens", directory=tokenizer_dir).drop("text").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")))
    sizes = _block_sizes(sized.filter(F.col("source").isin(list(listed))), 0)
    quotas = plan_quotas(list(listed.values()), {source: sum(t for t, _ in blocks.values()) for source, blocks in sizes.items()})
    rng = np.random.default_rng(seed)
    shards = max(1, -(-sum(q.quota for q in quotas) // shard_tokens))
    parts = -(-shards // driver_leaves)
    leaves = -(-shards // parts)
    rows = _dealt(quotas, _sequences(sized, quotas, sizes, rng, tail_documents), rng, leaves)
    # As many finer blocks that every output shard gets FINE_BLOCKS of them from the leaf's own.
    bits = max(0, (FINE_BLOCKS * parts * leaves // max(len(rows), 1)).bit_length()) if parts > 1 else 0
    plan = spark.createDataFrame(rows, "source string, depth int, block long, copy int, room long, out_shard int")
    return Mix(sized, plan, spark.createDataFrame(list(listed.values()), "source string, target_share double, max_repeats int"), sorted({r[1] for r in rows}), parts, bits, seed)


def _tail_picks(part: DataFrame) -> DataFrame:
    """``part`` (the documents of a source's tail blocks, at most TAIL_DOCUMENTS) with ``picked``: in permuted order as far as they fit, and what still fits of the rest."""
    group = Window.partitionBy("source")
    order = group.orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("left", F.col("room")).withColumn("picked", F.lit(False))
    for _ in range(TAIL_ROUNDS):
        fits = ~F.col("picked") & (F.col("n_tokens") <= F.col("left"))
        part = part.withColumn("fits", fits).withColumn("run", F.sum(F.when(F.col("fits"), F.col("n_tokens")).otherwise(0)).over(order))
        part = part.withColumn("new", F.col("fits") & (F.col("run") <= F.col("left")))
        part = part.withColumn("left", F.col("left") - F.sum(F.when(F.col("new"), F.col("n_tokens")).otherwise(0)).over(group)).withColumn("picked", F.col("picked") | F.col("new"))
    return part.drop("left", "fits", "run", "new")


def placements(mix: Mix) -> DataFrame:
    """One row for every use of a document: doc_id, source, n_tokens, copy, out_shard, h."""
    columns = ["doc_id", "source", "n_tokens", "copy", "out_shard", "h"]
    out = None
    plan = mix.plan.withColumn("fine", F.lit(-1).cast("long"))
    if mix.parts > 1:
        fields = "source string, depth int, block long, copy int, room long, out_shard int, fine long"
        plan = staged(mix.plan.groupBy("out_shard").applyInPandas(_split_leaf(mix.parts, mix.bits, mix.seed), fields))
    for depth in mix.depths or [0]:
        own = plan.filter(F.col("depth") == depth).drop("depth")
        documents = mix.sized.filter("n_tokens > 0").withColumn("block", block_at(depth))
        if mix.parts > 1:
            fine = documents.withColumn("fine", fine_block(depth, mix.bits)).join(own.filter("fine >= 0"), ["source", "block", "fine"])
            uses = fine.unionByName(documents.join(own.filter("fine < 0"), ["source", "block"])).drop("fine")
        else:
            uses = documents.join(own.drop("fine"), ["source", "block"])
        part = _tail_picks(uses.filter("room >= 0")).filter("picked")
        own = uses.filter("room < 0").select(*columns).unionByName(part.select(*columns))
        out = own if out is None else out.unionByName(own)
    return out


def document_uses(mix: Mix) -> DataFrame:
    """How often each document is used: doc_id, source, n_tokens, times_used (0 included); repeated documents have a row each."""
    joined = mix.sized.withColumns({"uses": F.lit(0).cast("long"), "room": F.lit(None).cast("long")})
    for depth in mix.depths:
        counts = mix.plan.filter(F.col("depth") == depth).groupBy("source", "block").agg(F.count_if(F.col("room") < 0).alias("more"), F.max(F.when(F.col("room") >= 0, F.col("room"))).alias("tail"))
        joined = joined.withColumn("block", block_at(depth)).join(counts, ["source", "block"], "left")
        joined = joined.select("doc_id", "source", "n_tokens", "h", (F.col("uses") + F.coalesce("more", F.lit(0))).alias("uses"), F.coalesce("room", "tail").alias("room"))
    joined = joined.withColumn("uses", F.when(F.col("n_tokens") > 0, F.col("uses")).otherwise(0).cast("int"))
    whole = joined.filter("room is null or n_tokens = 0").select("doc_id", "source", "n_tokens", F.col("uses").alias("times_used"))
    cut = _tail_picks(joined.filter("room is not null and n_tokens > 0")).select("doc_id", "source", "n_tokens", (F.col("uses") + F.col("picked").cast("int")).alias("times_used"))
    return whole.unionByName(cut)


def source_shares(mix: Mix) -> DataFrame:
    """The share each listed source really has: source, target_share, actual_share, tokens_used, documents_used, most_uses, max_repeats."""
    per = document_uses(mix).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("tokens_used"), F.count_if(F.col("times_used") > 0).alias("documents_used"), F.max("times_used").alias("most_uses"))
    joined = mix.targets.join(per, "source", "left").na.fill(0, ["tokens_used", "documents_used", "most_uses"])
    total = Window.partitionBy()  # a row for each listed source
    return joined.select("source", "target_share", F.round(F.try_divide(F.col("tokens_used"), F.sum("tokens_used").over(total)), 6).alias("actual_share"), "tokens_used", "documents_used", "most_uses", "max_repeats")


def shuffled_shards(mix: Mix, seed: int = SEED) -> DataFrame:
    """The output shards in order: out_shard, position, doc_id, source, n_tokens, copy; the shuffle is local to a shard."""
    order = Window.partitionBy("out_shard").orderBy(F.xxhash64(F.lit(seed), "out_shard", "h", "copy"), "doc_id", "copy")
    return placements(mix).select("out_shard", (F.row_number().over(order) - 1).alias("position"), "doc_id", "source", "n_tokens", "copy")
