"""Link graphs: nodes, adjacency, transition matrix, and PageRank in exchangeable forms.

Edges are a table (src, dst, links); nothing is parsed again between steps. Ranks
and matrices are tables too, so the adjacency and the matrix form of PageRank are
one plan with different keys, and the join strategy is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, staged
from .numbering import dense_numbers

ALPHA = 0.15
#: The most bytes of a rank vector that is broadcast on request: names or numbers, and 24 bytes for each.
BROADCAST_BYTES = 128 * 2**20


def from_lists(lists: DataFrame) -> DataFrame:
    """(src, dst) of (page, links) rows, order and repeated links kept."""
    return lists.select(F.col("page").alias("src"), F.explode("links").alias("dst"))


def merged(links: DataFrame, *, multigraph: bool = True) -> DataFrame:
    """(src, dst, links): parallel links merged into their number, or into 1; rows without both ends dropped."""
    pairs = links.filter("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("links"))
    return pairs if multigraph else pairs.withColumn("links", F.lit(1).cast("long"))


def nodes(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Every page that links, is linked to, or is in ``pages`` (page): (node)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends if pages is None else ends.unionByName(pages.select(F.col("page").alias("node")).filter("node is not null"))).distinct()


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sum("links").alias("degree"))


def dangling(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Nodes without a link of their own: (node)."""
    targets = edges.select(F.col("dst").alias("node"))
    targets = targets if pages is None else targets.unionByName(pages.select(F.col("page").alias("node")).filter("node is not null"))
    return targets.distinct().join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def transition_matrix(edges: DataFrame, index: DataFrame | None = None, *, padded: bool = False) -> DataFrame:
    """(i, j, v): the share v of node j's links that goes to node i. ``index`` (node, idx) puts numbers for names; ``padded`` adds (i, 0, 0.0) for nodes no link leads to."""
    cells = edges.join(out_degrees(edges), "src").select(F.col("dst").alias("i"), F.col("src").alias("j"), (F.col("links") / F.col("degree")).alias("v"))
    if index is None:
        return cells
    at = lambda name: index.select(F.col("node").alias(name), F.col("idx").alias(f"{name}_idx"))
    cells = cells.join(at("i"), "i").join(at("j"), "j").select(F.col("i_idx").alias("i"), F.col("j_idx").alias("j"), "v")
    if padded:
        bare = index.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select(F.col("idx").alias("i"))
        cells = cells.unionByName(bare.select("i", F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v")))
    return cells


def adjacency(links: DataFrame, *, order: list[str] = (), pages: DataFrame | None = None) -> DataFrame:
    """(page, links): one row for each page, its links joined by ``|`` in the order of the columns ``order`` and then by name; empty for a page without links.

    ``links`` has a row for each link (src, dst), repeated ones included; rows
    without both ends are none. The format holds a page's links in one row, so a row
    is as long as its page has links; ``links`` itself is the form that no hot page
    burdens.
    """
    whole = links.filter("src is not null and dst is not null")
    keys = F.struct(*(F.col(c) for c in order), F.col("dst"))
    lists = whole.groupBy(F.col("src").alias("page")).agg(F.array_sort(F.collect_list(keys)).alias("l"))
    return lists.select("page", F.array_join(F.transform("l", lambda x: x["dst"]), "|").alias("links")).unionByName(_bare(whole, pages))


def _bare(links: DataFrame, pages: DataFrame | None) -> DataFrame:
    return dangling(links, pages).select(F.col("node").alias("page"), F.lit("").alias("links"))


def listed(lists: DataFrame) -> DataFrame:
    """(page, links) of pages whose links are arrays already, in their order; several rows of a page in one, a page without links empty."""
    one = lists.filter("page is not null and size(links) > 0").groupBy("page").agg(F.array_join(F.flatten(F.array_sort(F.collect_list("links"))), "|").alias("links"))
    return one.unionByName(_bare(from_lists(lists), lists))


def broadcast_fits(values: DataFrame, column: str) -> bool:
    """Whether a vector over ``column`` is below BROADCAST_BYTES; one aggregate over it."""
    size = values.agg(F.sum(F.coalesce(F.length(F.col(column).cast("string")), F.lit(0)) + 24)).first()[0] or 0
    return size <= BROADCAST_BYTES


def _joined(matrix: DataFrame, ranks: DataFrame, strategy: str) -> DataFrame:
    """M and R brought together on M.j = R.node; ``broadcast`` only for a vector that ``broadcast_fits``."""
    r = ranks.select(F.col("node").alias("j"), F.col("rank"))
    if strategy == "broadcast":
        r = F.broadcast(r)
    elif strategy == "shuffle":
        r = r.hint("merge")
    return matrix.join(r, "j")


def multiply(matrix: DataFrame, ranks: DataFrame, strategy: str = "auto") -> DataFrame:
    """M x R: (node, rank) for the rows with a cell; join and sum are one plan with partial sums, whatever the row's heat."""
    return _joined(matrix, ranks, strategy).groupBy(F.col("i").alias("node")).agg(F.sum(F.col("v") * F.col("rank")).alias("rank"))


def rank_step(matrix: DataFrame, ranks: DataFrame, n: int, *, alpha: float = ALPHA, damped: bool = False, strategy: str = "auto") -> DataFrame:
    """One iteration over (node, rank, is_dangling).

    r'(i) = alpha/n + (1-alpha) * sum(M(i,j) r(j)) + d/n, with d the rank of the
    dangling nodes before the step, damped by (1-alpha) on request. The mass is an
    aggregate of one row inside the plan, so a step runs no job of its own.
    """
    n = max(n, 1)  # an empty graph has no rows to rank
    mass = ranks.agg(F.coalesce(F.sum(F.when(F.col("is_dangling"), F.col("rank"))), F.lit(0.0)).alias("mass"))
    spread = F.col("mass") * ((1 - alpha) if damped else 1.0) / n
    sums = multiply(matrix, ranks, strategy).withColumnRenamed("rank", "sum")
    joined = ranks.join(sums, "node", "left").join(F.broadcast(mass))  # a single row
    return joined.select("node", (F.lit(alpha / n) + spread + (1 - alpha) * F.coalesce("sum", F.lit(0.0))).alias("rank"), "is_dangling")


def initial_ranks(edges: DataFrame, pages: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Uniform ranks (node, rank, is_dangling) and the number of nodes."""
    sources = edges.select(F.col("src").alias("node")).distinct().withColumn("links_out", F.lit(True))
    marked = staged(nodes(edges, pages).join(sources, "node", "left").select("node", F.col("links_out").isNull().alias("is_dangling")))
    n = marked.count()
    return marked.select("node", F.lit(1.0 / n if n else 0.0).alias("rank"), "is_dangling"), n


def pagerank(edges: DataFrame, *, pages: DataFrame | None = None, iterations: int = 10, alpha: float = ALPHA, damped: bool = False, strategy: str = "auto", tolerance: float | None = None, cut_every: int = 3) -> DataFrame:
    """(node, rank) after ``iterations``, or earlier once no rank moves by more than ``tolerance``.

    Nodes get dense numbers first, so that rounds shuffle eight bytes a node and not
    its name; names come back at the end. Edges and matrix are built once and
    written; ranks are written every ``cut_every`` rounds, so the plan stays short
    and a lost executor costs a few rounds. The strategy ``broadcast`` falls back to
    Spark's choice for a vector beyond BROADCAST_BYTES.
    """
    edges = staged(edges)
    names, n = initial_ranks(edges, pages)
    index = staged(dense_numbers(names.select("node", "is_dangling"), [F.col("node").asc()]))
    at = lambda name: index.select(F.col("node").alias(name), F.col("idx").alias(f"{name}_idx"))
    numbered = edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"), "links")
    matrix = staged(transition_matrix(staged(numbered)))
    ranks = index.select(F.col("idx").alias("node"), F.lit(1.0 / n if n else 0.0).alias("rank"), "is_dangling")
    if strategy == "broadcast" and not broadcast_fits(ranks, "node"):
        strategy = "auto"
    written = None
    for done in range(1, iterations + 1):
        before = ranks
        ranks = rank_step(matrix, ranks, n, alpha=alpha, damped=damped, strategy=strategy)
        if done < iterations and (done % cut_every == 0 or tolerance is not None):
            ranks = staged(ranks)
            if tolerance is None and written is not None:
                discard(written)
            written = ranks
        if tolerance is not None:
            moved = ranks.join(before.select("node", F.col("rank").alias("old")), "node").agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is None or moved <= tolerance:
                break
    return ranks.join(index.select(F.col("idx").alias("number"), F.col("node").alias("name")), F.col("node") == F.col("number")).select(F.col("name").alias("node"), "rank")


def named(values: DataFrame, index: DataFrame) -> DataFrame:
    """Numbered nodes with their names, looked up last, when few are left."""
    return values.join(index.select(F.col("idx").alias("node"), F.col("node").alias("page_name")), "node")


def matrix_cells(stored: DataFrame, *, key: str = "cell_id") -> DataFrame:
    """(i, j, v) of a stored sparse matrix: cells delivered again count once, cells without a row or column are none. Cells without a key all stay."""
    cells = stored.filter("i is not null and j is not null").select(key, "i", "j", "v")
    keyed = F.col(key).isNotNull()
    return cells.filter(keyed).dropDuplicates([key]).unionByName(cells.filter(~keyed)).select("i", "j", "v")


def uniform_vector(index: DataFrame, idx: Column) -> tuple[DataFrame, int]:
    own = index.select(idx.alias("node")).filter("node is not null").distinct()
    n = own.count()
    return own.withColumn("rank", F.lit(1.0 / n if n else 0.0)), n
