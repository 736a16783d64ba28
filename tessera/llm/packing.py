"""Filling fixed-capacity containers with documents: lexical retrieval packing.

Documents are placed in index shards by content: clusters, fitted on a bounded
sample, gather documents with the same terms, and neighbouring clusters share a
shard of bounded size. Inside a shard every document looks up its best-scored
neighbours by BM25, with the statistics of the whole collection, in the clusters
that its terms point to. Each capacity then takes the largest unused document of a
shard as a seed and fills its container with the seed's unused neighbours. A
document longer than the capacity is cut into pieces of exactly the capacity, which
are full containers, and one rest that is packed like any other document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from .tokens import encoder, vocabulary

#: Distinct terms of documents for each index shard and for each slice of its queries, and what a document counts besides
#: its terms: they bound a task's memory. A shard's index goes to each of its slices.
SHARD_POSTINGS, SLICE_POSTINGS, DOCUMENT_COST = 24_000_000, 8_000_000, 100
#: Distinct texts the clusters are fitted on, terms aimed at for a cluster, and the most clusters: the fit's bounds.
SAMPLE_TEXTS, CLUSTER_POSTINGS, MOST_CLUSTERS = 20_000, 20_000, 1024
DIRECTIONS = 96
#: Clusters of its shard that a document looks in.
PROBES = 28
K1, B = 1.2, 0.75
#: Best-scored documents that are kept for each document.
NEIGHBOURS = 32
#: So many of the commonest terms tell which clusters a document looks in.
HEAD = 2048
#: A container counts as closed when at most this share of it is unused.
CLOSED = 0.02
#: Of so many best-scored neighbours that fit, the largest is taken.
CHOICE = 8
SEED = 11


class Statistics:
    """What BM25 needs to know of the whole collection: documents, mean length, document frequency by term id."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean = n, max(mean, 1.0)
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        common = np.argsort(-df, kind="stable")[:HEAD]
        self.head = np.full(len(df), -1, np.int32)
        self.head[common] = np.arange(len(common))
        self.width = len(common)


class BM25Index:
    """Inverted index over documents given as arrays of token ids, or as their distinct terms and counts.

    Without ``statistics`` the documents are the whole collection.
    """

    def __init__(self, documents: list[np.ndarray] | None = None, k1: float = K1, b: float = B, *, counted: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None, statistics: Statistics | None = None):
        length, offset, term, tf = counted if counted is not None else count_terms(documents)
        n = self.size = len(length)
        if statistics is None:
            statistics = Statistics(n, float(length.mean()) if n else 0.0, np.bincount(term))
        self.statistics, self.term, self.offset = statistics, term, offset
        self.doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offset))
        norm = (k1 * (1 - b + b * length / statistics.mean)).astype(np.float32)
        self.weight = np.empty(len(term), np.float32)
        for a in range(0, len(term), 1 << 20):
            part = slice(a, a + (1 << 20))
            self.weight[part] = statistics.idf[term[part]] * tf[part] * (k1 + 1) / (tf[part] + norm[self.doc[part]])
        #: Places of a block's terms, by term id; refilled for each block.
        self.place = np.full(len(statistics.idf), -1, np.int64)

    def terms_of(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) of the distinct terms of some documents."""
        count = self.offset[documents + 1] - self.offset[documents]
        at = np.arange(int(count.sum())) + np.repeat(self.offset[documents] - (np.cumsum(count) - count), count)
        return np.repeat(np.arange(len(documents)), count), self.term[at]

    def scores_of(self, queries: np.ndarray, first: int, stop: int) -> np.ndarray:
        """BM25 of the documents ``first`` to ``stop`` (columns) for the distinct terms of each query (rows), a document of the index.

        Terms that several of the documents hold are scored by a matrix product, the others by their postings.
        """
        a, b, n = self.offset[first], self.offset[stop], stop - first
        term, doc, weight = self.term[a:b], self.doc[a:b].astype(np.int64) - first, self.weight[a:b]
        words, of, count = np.unique(term, return_inverse=True, return_counts=True)
        common = count > max(1, n // 64)
        at = np.cumsum(common) - 1
        dense = np.zeros((int(common.sum()), n), np.float32)
        inside = common[of]
        dense[at[of[inside]], doc[inside]] = weight[inside]
        self.place[words] = np.arange(len(words))
        row, asked = self.terms_of(queries)
        asked = self.place[asked]
        self.place[words] = -1
        row, asked = row[asked >= 0], asked[asked >= 0]
        inside = common[asked]
        marks = np.zeros((len(queries), len(dense)), np.float32)
        marks[row[inside], at[asked[inside]]] = 1
        scores = marks @ dense
        row, asked = row[~inside], asked[~inside]
        if len(asked):
            order = np.argsort(of, kind="stable")
            begin = np.cumsum(count) - count
            reach = count[asked]
            posting = order[np.arange(int(reach.sum())) + np.repeat(begin[asked] - (np.cumsum(reach) - reach), reach)]
            np.add.at(scores.reshape(-1), np.repeat(row * n, reach) + doc[posting], weight[posting])
        return scores

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for the distinct terms of ``seed``."""
        return self.scores_of(np.array([seed]), 0, self.size)[0]

    def _blocks(self, own: np.ndarray, starts: np.ndarray, stops: np.ndarray, probes: int) -> np.ndarray:
        """For each of ``own`` the ``probes`` blocks whose mean weights of the commonest terms answer its terms best."""
        if probes == len(starts):
            return np.tile(np.arange(probes), (len(own), 1))
        head, width = self.statistics.head, self.statistics.width
        block = np.repeat(np.arange(len(starts), dtype=np.int32), stops - starts)[self.doc]
        at = head[self.term]
        inside = at >= 0
        means = np.bincount(at[inside].astype(np.int64) * len(starts) + block[inside], weights=self.weight[inside], minlength=width * len(starts)).reshape(width, -1)
        means = (means / (stops - starts)).astype(np.float32)
        out = np.empty((len(own), probes), np.int64)
        for a in range(0, len(own), 1024):
            row, term = self.terms_of(own[a : a + 1024])
            at = head[term]
            marks = np.zeros((len(out[a : a + 1024]), width), np.float32)
            marks[row[at >= 0], at[at >= 0]] = 1
            out[a : a + 1024] = np.argpartition(-(marks @ means), probes - 1, axis=1)[:, :probes]
        return out

    def nearest(self, k: int, cluster: np.ndarray | None = None, own: np.ndarray | None = None, probes: int = PROBES, cells: int = 4_000_000) -> list[np.ndarray]:
        """For each document, or each of ``own``, the numbers of its ``k`` best-scored others, best first; scores of 0 are no neighbours.

        ``cluster`` (ascending) cuts the documents into blocks; a document is compared
        with those of the ``probes`` blocks whose mean weights answer its terms best.
        """
        own = np.arange(self.size) if own is None else own
        if not len(own):
            return []
        starts = np.array([0]) if cluster is None else np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
        stops = np.append(starts[1:], self.size)
        probes = min(probes, len(starts))
        asked = self._blocks(own, starts, stops, probes)
        return [x for a in range(0, len(own), 8192) for x in self._nearest(k, own[a : a + 8192], asked[a : a + 8192], starts, stops, cells)]

    def _nearest(self, k: int, own: np.ndarray, asked: np.ndarray, starts: np.ndarray, stops: np.ndarray, cells: int) -> list[np.ndarray]:
        probes = asked.shape[1]
        by_block = np.argsort(asked, axis=None, kind="stable")
        cuts = np.searchsorted(asked.ravel()[by_block], np.arange(len(starts) + 1))
        score, number = np.zeros((len(own), probes, k), np.float32), np.zeros((len(own), probes, k), np.int32)
        for block, (first, stop) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            mine = by_block[cuts[block] : cuts[block + 1]]
            step = max(1, cells // (stop - first))
            for at in range(0, len(mine), step):
                row, slot = np.divmod(mine[at : at + step], probes)
                found = self.scores_of(own[row], first, stop)
                itself = np.flatnonzero((own[row] >= first) & (own[row] < stop))
                found[itself, own[row[itself]] - first] = 0
                best = np.argpartition(-found, k - 1, axis=1)[:, :k] if k < stop - first else np.tile(np.arange(stop - first), (len(row), 1))
                score[row, slot, : best.shape[1]] = np.take_along_axis(found, best, axis=1)
                number[row, slot, : best.shape[1]] = best + first
        out: list[np.ndarray] = []
        for at in range(0, len(own), 1024):
            s, x = (v[at : at + 1024].reshape(-1, probes * k) for v in (score, number))
            best = np.argpartition(-s, k - 1, axis=1)[:, :k] if probes > 1 else np.tile(np.arange(k), (len(s), 1))
            s, x = np.take_along_axis(s, best, axis=1), np.take_along_axis(x, best, axis=1)
            order = np.lexsort((x, -s))
            s, x = np.take_along_axis(s, order, axis=1), np.take_along_axis(x, order, axis=1)
            out += [b[a > 0] for a, b in zip(s, x, strict=True)]
        return out


def count_terms(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, offsets, distinct terms and their counts of documents given as token ids."""
    pairs = [np.unique(d, return_counts=True) for d in documents]
    offset = np.concatenate(([0], np.cumsum([len(t) for t, _ in pairs]))).astype(np.int64)
    joined = [np.concatenate(x).astype(np.int64) if pairs else np.empty(0, np.int64) for x in (zip(*pairs, strict=True) if pairs else ((), ()))]
    return np.array([len(d) for d in documents], np.int64), offset, joined[0], joined[1]


class Clusters:
    """Directions that texts with the same terms share, fitted on a bounded sample of texts."""

    def __init__(self, directions: np.ndarray, projection: np.ndarray):
        self.directions, self.projection = directions, projection

    @staticmethod
    def vectors(counted: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], statistics: Statistics, projection: np.ndarray) -> np.ndarray:
        """BM25 weights of each document on the projection's axes, of length one."""
        length, offset, term, tf = counted
        doc = np.repeat(np.arange(len(length)), np.diff(offset))
        weight = statistics.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / statistics.mean))
        out = np.zeros((len(length), projection.shape[1]), np.float32)
        full = np.flatnonzero(np.diff(offset))
        for at in range(0, len(full), 512):  # the rows of a chunk's terms, not of all
            part = full[at : at + 512]
            a, b = offset[part[0]], offset[part[-1] + 1]
            out[part] = np.add.reduceat(projection[term[a:b]] * weight[a:b, None].astype(np.float32), offset[part] - a, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    @classmethod
    def fit(cls, counted: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], statistics: Statistics, clusters: int, rounds: int = 10) -> Clusters:
        rng = np.random.default_rng(SEED)
        projection = rng.normal(size=(len(statistics.idf), DIRECTIONS)).astype(np.float32)
        x = cls.vectors(counted, statistics, projection)
        clusters = max(1, min(clusters, len(x) // 16))
        if len(x) == 0:
            return cls(np.zeros((1, DIRECTIONS), np.float32), projection)
        centre = x[rng.choice(len(x), clusters, replace=False)].copy()
        for _ in range(rounds):
            own = cls(centre, projection).assign(x)
            order = np.argsort(own, kind="stable")
            present, first = np.unique(own[order], return_index=True)
            centre[present] = np.add.reduceat(x[order], first, axis=0)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        return cls(centre, projection)

    def assign(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x[a : a + 8192] @ self.directions.T).argmax(axis=1) for a in range(0, len(x), 8192)]) if len(x) else np.empty(0, np.int64)


def plan_shards(directions: np.ndarray, weight: np.ndarray, limit: int = SHARD_POSTINGS) -> list[tuple[int, int, int]]:
    """(cluster, first shard, shards): neighbouring clusters share shards of about ``limit`` at most; a heavier cluster has several of its own."""
    out: list[tuple[int, int, int]] = []
    todo, shard = [np.flatnonzero(weight > 0)], 0
    while todo:
        members = todo.pop()
        parts = -(-int(weight[members].sum()) // limit)
        if parts <= 1 or len(members) == 1:
            out += [(int(c), shard, max(parts, 1)) for c in members]
            shard += max(parts, 1)
            continue
        x = directions[members] - np.average(directions[members], axis=0, weights=weight[members])
        order = np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")
        # Cut across the widest axis, where the lighter side has whole shards' weight.
        filled = np.cumsum(weight[members][order])
        cut = int(np.clip(np.searchsorted(filled, filled[-1] * (parts // 2) / parts) + 1, 1, len(members) - 1))
        todo += [members[order[cut:]], members[order[:cut]]]
    return out


class Filler:
    """The unused items of one capacity, by size, and the greedy choice among them; an item stands for ``left`` equal ones."""

    def __init__(self, sizes: np.ndarray, capacity: int, left: np.ndarray | None = None):
        self.sizes, self.capacity, self.slack = sizes, capacity, int(capacity * CLOSED)
        self.left = np.where(sizes > 0, 1 if left is None else left, 0)
        self.count = np.bincount(sizes, weights=self.left, minlength=capacity + 1).astype(np.int64)
        self.order = np.argsort(sizes, kind="stable")
        #: End of each size's items in ``order`` not yet looked at from behind.
        self.end = np.searchsorted(sizes[self.order], np.arange(1, capacity + 2))
        total = int(self.left.sum())
        self.roomy = 2 * int((sizes * self.left).sum()) / total if total else 0
        self.smallest = 1

    def use(self, item: int) -> None:
        self.left[item] -= 1
        self.count[self.sizes[item]] -= 1

    def largest(self, gap: int) -> int:
        """The largest unused item of at most ``gap``; there is one."""
        low = gap
        while not self.count[low]:
            below = self.count[max(0, low - 256) : low]
            found = np.flatnonzero(below)
            low = max(0, low - 256) + int(found[-1]) if len(found) else low - 256
        while not self.left[self.order[self.end[low] - 1]]:
            self.end[low] -= 1
        return int(self.order[self.end[low] - 1])

    def closable(self, gap: int) -> bool:
        return gap <= self.slack or gap >= self.roomy or bool(self.count[max(1, gap - self.slack) : gap + 1].any())

    def choose(self, near: np.ndarray, gap: int) -> int:
        """A neighbour that closes the container, else the largest of the best-scored that fit and leave a gap some item closes, else the largest item of all."""
        near = near[self.left[near] > 0]
        size = self.sizes[near]
        near, size = near[size <= gap], size[size <= gap]
        closing = np.flatnonzero(size >= gap - self.slack)
        if len(closing):
            return int(near[closing[0]])
        for at in np.argsort(-size[:CHOICE], kind="stable"):
            if self.closable(gap - int(size[at])):
                return int(near[at])
        return self.largest(gap)

    def container(self, seed: int, near: np.ndarray) -> list[int]:
        """The container of an unused seed; ``near`` are its neighbours, best-scored first, after those equal to it."""
        near = np.concatenate(([seed], near)).astype(np.int64)
        self.use(seed)
        container, gap = [seed], self.capacity - int(self.sizes[seed])
        while True:
            while self.smallest <= self.capacity and not self.count[self.smallest]:
                self.smallest += 1
            if gap < self.smallest:
                return container
            pick = self.choose(near, gap)
            self.use(pick)
            container.append(pick)
            gap -= int(self.sizes[pick])


def pack_shard(sizes: np.ndarray, capacity: int, near, left: np.ndarray | None = None) -> list[list[int]]:
    """Containers as lists of item numbers; every item of ``0 < size <= capacity`` in as many as ``left`` says (once without). ``near`` gives a seed's neighbours, best first."""
    filler = Filler(np.asarray(sizes, np.int64), capacity, left)
    out = []
    for s in np.argsort(-filler.sizes, kind="stable").tolist():
        while filler.left[s] > 0:
            out.append(filler.container(s, near(s)))
    return out


_COUNTED = pa.schema([("n", pa.int64()), ("terms", pa.binary()), ("tfs", pa.binary())])


def _count(ranks, schema: pa.Schema):
    def run(batches):
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for at in range(0, len(texts), 1000):
                length, offset, term, tf = count_terms([np.array(encode(t), np.int64) if t else np.empty(0, np.int64) for t in texts.slice(at, 1000).to_pylist()])
                cut = [(int(a), int(b)) for a, b in zip(offset[:-1], offset[1:], strict=True)]
                term, tf = term.astype(np.int32), tf.astype(np.int32)
                own = [pa.array(length), pa.array([term[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([tf[a:b].tobytes() for a, b in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1000) for c in batch.columns[:-1]), *own], schema=schema)

    return run


def _frequencies(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=len(total))
        own[: len(total)] += total
        total = own
    term = np.flatnonzero(total)
    yield pa.record_batch([pa.array(term), pa.array(total[term])], names=["term", "df"])


def _block(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, offsets, terms and counts of a block's rows in their order."""
    terms = table["terms"].to_pylist()
    offset = np.concatenate(([0], np.cumsum([len(t) // 4 for t in terms]))).astype(np.int64)
    return table["n"].to_numpy().astype(np.int64), offset, np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(table["tfs"].to_pylist()), np.int32)


def _clustered(clusters, statistics, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            x = Clusters.vectors(_block(pa.Table.from_batches([batch])), statistics.value, clusters.value.projection)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters.value.assign(x), pa.int32())], schema=schema)

    return run


def _search(statistics, k: int, probes: int, schema: pa.Schema):
    """One slice of a shard: equal texts get one number in the shard, and the first row of each text of the slice its neighbours."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("cluster", "k1", "k2", "doc_id")])
        keys = [table[c].to_numpy() for c in ("cluster", "k1", "k2")]
        new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in keys], axis=0)))
        item, distinct = np.cumsum(new) - 1, np.flatnonzero(new)
        asking = table["asking"].to_numpy(zero_copy_only=False)
        own = np.flatnonzero(asking[distinct])
        counted = _block(table.select(["n", "terms", "tfs"]).take(pa.array(distinct)))
        table = table.select(["shard", "doc_id", "n"])
        near = BM25Index(counted=counted, statistics=statistics.value).nearest(k, keys[0][distinct], own, probes)
        found = np.full(len(new), None, object)
        for at, x in zip(distinct[own], near, strict=True):
            found[at] = x.tobytes()
        rows = pa.array(np.flatnonzero(asking))
        columns = [table["shard"], pa.array(item, pa.int32()), table["doc_id"], table["n"], pa.array(found, pa.binary())]
        return pa.table([c.cast(f.type).take(rows) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def neighbours(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS, probes: int = PROBES, shard_postings: int = SHARD_POSTINGS, slice_postings: int = SLICE_POSTINGS, cluster_postings: int = CLUSTER_POSTINGS, tokenizer_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Every document with a token in its shard: shard, item (a number for equal texts), doc_id, n (tokens), near (items of the shard, best first, with an item's first row); and the documents without one: doc_id.

    The clusters are fitted on at most SAMPLE_TEXTS distinct texts, the first in the
    order of a hash; everything else covers all documents.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    text = F.col(text_col).cast("string")
    # Texts are equal where both hashes are.
    slim = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(SEED)).alias("k2"), text.alias("text"))
    fields = [*slim.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("terms", T.BinaryType()), T.StructField("tfs", T.BinaryType())]
    counted = staged(slim.mapInArrow(_count(vocabulary(spark, tokenizer_dir), to_arrow_schema(T.StructType(fields))), T.StructType(fields)))
    full = counted.filter("n > 0")
    n, tokens, postings = full.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.length("terms") / 4), F.lit(0))).first()
    found = full.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each token of the vocabulary
    terms = found["term"].to_numpy()
    df = np.zeros(int(terms.max()) + 1 if len(terms) else 1, np.int64)
    df[terms] = found["df"].to_numpy()
    statistics = Statistics(n, tokens / max(n, 1), df)
    share = min(1.0, 1.2 * SAMPLE_TEXTS / max(n, 1))
    sample = full.filter(F.pmod("k2", F.lit(10**9)) < round(share * 10**9)).groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("terms").alias("terms"), F.first("tfs").alias("tfs")).orderBy("k2", "k1").limit(SAMPLE_TEXTS)
    clusters = Clusters.fit(_block(sample.select("n", "terms", "tfs").toArrow()), statistics, min(MOST_CLUSTERS, -(-int(postings) // cluster_postings)))
    known, model = spark.sparkContext.broadcast(statistics), spark.sparkContext.broadcast(clusters)
    fields = T.StructType([*full.schema.fields, T.StructField("cluster", T.IntegerType())])
    placed = staged(full.mapInArrow(_clustered(model, known, to_arrow_schema(fields)), fields))
    weight = np.zeros(len(clusters.directions), np.int64)
    for cluster, own in placed.groupBy("cluster").agg(F.sum(F.length("terms") / 4 + DOCUMENT_COST)).collect():  # a row for each cluster
        weight[cluster] = int(own)
    plan = plan_shards(clusters.directions, weight, shard_postings)
    held: dict[int, float] = {}
    for cluster, first, parts in plan:
        held[first] = held.get(first, 0) + weight[cluster] / parts
    slices = {first: max(1, -(-int(w) // slice_postings)) for first, w in held.items()}
    shards = F.broadcast(spark.createDataFrame([(*p, slices[p[1]]) for p in plan], "cluster int, first_shard int, shards int, slices int"))  # MOST_CLUSTERS rows at most
    spread = placed.join(shards, "cluster").withColumn("shard", (F.col("first_shard") + F.pmod(F.xxhash64("doc_id", "k1"), F.col("shards"))).cast("int"))
    spread = spread.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("asking", F.pmod("k2", F.col("slices")) == F.col("slice"))
    out = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("item", T.IntegerType()), slim.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("near", T.BinaryType())])
    tasks = sum(slices[first] * parts for first, parts in {(first, parts) for _, first, parts in plan})
    spread = spread.select("shard", "slice", "asking", "cluster", "k1", "k2", "doc_id", "n", "terms", "tfs").repartition(max(1, tasks), "shard", "slice")
    near = staged(spread.groupBy("shard", "slice").applyInArrow(_search(known, k, probes, to_arrow_schema(out)), out))
    empty = staged(counted.filter("n = 0").select("doc_id"))
    discard(counted)
    discard(placed)
    return near, empty


def _fill(schema: pa.Schema):
    """The places of one shard and capacity."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("doc_id", "ascending")])
        capacity_id, capacity, shard = (table[c][0].as_py() for c in ("capacity_id", "capacity", "shard"))
        item, length = table["item"].to_numpy(), table["n"].to_numpy()
        first = np.searchsorted(item, np.arange(item[-1] + 1))
        left = np.diff(np.append(first, len(item)))
        given = pa.compute.drop_null(table["near"]).to_pylist()  # one for each item, in its order
        base = int(shard) << 32
        row, container, slot, piece, start, size = ([] for _ in range(6))
        number = 0
        for r in np.flatnonzero(length >= capacity).tolist():
            for p in range(int(length[r]) // capacity):
                row.append(r), container.append(base + number), slot.append(0), piece.append(p), start.append(p * capacity), size.append(capacity)
                number += 1
        next_row = first.copy()
        for members in pack_shard(length[first] % capacity, capacity, lambda s: np.frombuffer(given[s], np.int32), left):
            for at, i in enumerate(members):
                r = int(next_row[i])
                next_row[i] += 1
                begin = int(length[r]) // capacity * capacity
                row.append(r), container.append(base + number), slot.append(at), piece.append(begin // capacity), start.append(begin), size.append(int(length[r]) - begin)
            number += 1
        ids = table["doc_id"].combine_chunks().take(pa.array(row, pa.int64()))
        fixed = [pa.array(np.full(len(row), capacity_id), pa.int32()), pa.array(container, pa.int64()), pa.array(slot, pa.int32()), ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64())]
        return pa.table([c.cast(f.type) for c, f in zip(fixed, schema, strict=True)], schema=schema)

    return run


def pack_documents(documents: DataFrame, capacities: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every document or piece and its place, for each capacity: capacity_id, container_id, slot, doc_id, piece_no, token_start, n_tokens.

    ``capacities`` (capacity_id, capacity_tokens) is a small fixed list; its null
    or non-positive rows name no container and are left out. Documents without a
    token (null, empty) take no room: one row with a null container. Repeated
    documents are packed each; only the named columns are read; an empty table
    gives an empty result. ``how`` goes to ``neighbours``.
    """
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = documents.sparkSession
    wanted = sorted({(int(r[0]), int(r[1])) for r in capacities.select("capacity_id", "capacity_tokens").collect() if r[0] is not None and r[1] is not None and r[1] > 0})
    kind = documents.schema[id_col].dataType
    out = T.StructType([
        T.StructField("capacity_id", T.IntegerType()), T.StructField("container_id", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("doc_id", kind),
        T.StructField("piece_no", T.IntegerType()), T.StructField("token_start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])
    if not wanted:
        return spark.createDataFrame([], out)
    near, empty = neighbours(documents, id_col=id_col, text_col=text_col, **how)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("capacity_id"), F.lit(c).alias("capacity")) for i, c in wanted))).alias("c")
    places = near.select(each, "*").select("c.*", *near.columns).groupBy("capacity_id", "capacity", "shard").applyInArrow(_fill(to_arrow_schema(out)), out)
    none = empty.select(each, "doc_id").select("c.capacity_id", "doc_id")
    zero = {"container_id": F.lit(None).cast("long"), "slot": F.lit(None).cast("int"), "piece_no": F.lit(0), "token_start": F.lit(0).cast("long"), "n_tokens": F.lit(0).cast("long")}
    return places.unionByName(none.withColumns(zero))


def fill_report(places: DataFrame, capacities: DataFrame) -> DataFrame:
    """Containers, tokens and used share for each capacity."""
    used = places.filter("container_id is not null").groupBy("capacity_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    return used.join(capacities.select("capacity_id", "capacity_tokens").distinct(), "capacity_id").withColumn("used_share", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
