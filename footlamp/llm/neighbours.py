"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node. The graph starts from groups that are next to each other in a few random orders of the
space. A round of NN-descent brings a node's neighbours together, in a join by the node they share, measures every
pair with a new member, and keeps each node's nearest. A search expands the nearest nodes found so far, over and
over, until none of them is new. Every row is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footlamp.llm.registry import query, table
from footlamp.plans.storage import cut_lineage

#: Neighbours of a node in the graph.
DEGREE = 24
#: Random orders that the graph starts from, and nodes of a group in one.
ORDERS = 6
GROUP = 128
SIGN_BITS = 24
#: Rounds of NN-descent that are far more than any graph takes; reaching them is an error. New and old members that a node brings
#: together in one round.
ROUNDS = 60
SAMPLE = 16
#: A round that improves less than this share of all links is the last.
LEAST_CHANGE = 0.01
#: Nodes a search keeps and goes on from; steps that are far more than any search takes, reaching them is an error.
BEAM = 96
STEPS = 200
ENTRIES = 16
NEAREST = 10


def vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, vec`` of the rows that take part: no null, empty or zero vector, none with a null or non-finite component.

    Vectors of another length than the commonest one (the shorter, if two are) cannot be measured and take no part; rows of a null id
    neither.
    """
    v = F.col("vec")
    big = F.lit(float("inf"))
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)), F.lit(False)) & F.exists(v, lambda x: x != 0)
    taken = rows.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec")).where(F.col("vec_id").isNotNull() & good)
    sizes = taken.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return taken.where(F.size("vec") == (sizes[0]["n"] if sizes else 0))


def _dense(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Fast distances for ordering candidates; results are measured again exactly."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(d, 0))


def _links(node: np.ndarray, nbr: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(nbr), pa.array(d)], ["node", "nbr", "d"])


LINK = "node bigint, nbr bigint, d double"


def nearest_only(links: DataFrame, degree: int = DEGREE) -> DataFrame:
    """The ``degree`` nearest distinct neighbours of each node; Spark limits each task's part of a node first."""
    each = links.groupBy("node", "nbr").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"), F.max("improved").alias("improved"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("d", "nbr"))
    return each.withColumn("place", place).where(F.col("place") <= degree).drop("place")


def first_links(nodes: DataFrame, dim: int, orders: int = ORDERS, group: int = GROUP, degree: int = DEGREE, seed: int = 7) -> DataFrame:
    """Links inside groups of nodes that follow one another in random orders.

    An order sorts by the signs of random projections, read as a Gray code so that neighbouring codes differ in one sign. The
    rows are dealt out by ranges of that order, so a dense part of the space is split like any other.
    """
    spark = nodes.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = []
    for o in range(orders):
        planes = np.random.default_rng(seed + o).standard_normal((dim, SIGN_BITS))

        def code(batches: Iterator[pa.RecordBatch], planes=planes) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gray = np.zeros(batch.num_rows, dtype=np.int64)
                if batch.num_rows:
                    bits = (_dense(batch.column(1)) @ planes > 0).astype(np.int64)
                    binary = np.zeros(batch.num_rows, dtype=np.int64)
                    for i in range(SIGN_BITS):
                        binary ^= bits[:, i]
                        gray = gray << 1 | binary
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray)], ["node", "vec", "code"])

        def group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 16 * group:
                    yield from cut(pa.Table.from_batches(held))
                    held = []
            if held:
                yield from cut(pa.Table.from_batches(held))

        def cut(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            ids, x = rows.column("node").to_numpy(), _dense(rows.column("vec"))
            n = max(1, round(len(ids) / group))
            for part in np.array_split(np.arange(len(ids)), n):
                if len(part) > 1:
                    d = _distances(x[part], x[part])
                    np.fill_diagonal(d, np.inf)
                    k = min(degree, len(part) - 1)
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    yield _links(np.repeat(ids[part], k), ids[part][near].ravel(), np.take_along_axis(d, near, 1).ravel())

        coded = nodes.select("node", "vec").mapInArrow(code, "node bigint, vec array<double>, code bigint")
        out.append(coded.repartitionByRange(parts, "code", "node").sortWithinPartitions("code", "node").mapInArrow(group_links, LINK))
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return cut_lineage(nearest_only(links.withColumn("fresh", F.lit(True)).withColumn("improved", F.lit(True)), degree))


def descend(graph: DataFrame, nodes: DataFrame, round_no: int, degree: int = DEGREE, sample: int = SAMPLE) -> DataFrame:
    """One round: join neighbours of the same node, forward and backward, and measure pairs with a new member.

    A node brings together at most ``sample`` new and ``sample`` old members, chosen anew in each round, as NN-descent does; so
    a node that is near to very many others is no hot group. A link is old once its node has drawn it; until then it stays new.
    """
    both = graph.select(F.col("node").alias("center"), F.col("nbr").alias("member"), "fresh").unionByName(
        graph.select(F.col("nbr").alias("center"), F.col("node").alias("member"), "fresh")
    )
    members = both.groupBy("center", "member").agg(F.max("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("center", "fresh").orderBy(F.xxhash64("center", "member", F.lit(round_no))))
    members = members.withColumn("place", place).where(F.col("place") <= sample).drop("place")
    members = cut_lineage(members)
    worst = graph.groupBy("node").agg(F.max("d").alias("worst"), F.count(F.lit(1)).alias("n"))
    worst = worst.select("node", F.when(F.col("n") >= degree, F.col("worst")).otherwise(float("inf")).alias("worst"))
    known = nodes.join(worst, "node", "left").select(F.col("node").alias("member"), F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vec")
    local = members.join(known, "member").repartition("center").sortWithinPartitions("center").select("center", "member", "fresh", "worst", "vec")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            center = rows.column("center").to_numpy()
            if not len(center):
                continue
            last = int(np.searchsorted(center, center[-1]))
            yield from measure(rows.slice(0, last))
            rest = rows.slice(last)
        if rest is not None:
            yield from measure(rest)

    def measure(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        center, ids = rows.column("center").to_numpy(), rows.column("member").to_numpy()
        fresh, bound, x = rows.column("fresh").to_numpy(), rows.column("worst").to_numpy(), _dense(rows.column("vec"))
        cuts = np.nonzero(np.diff(center))[0] + 1
        a, b, d = [], [], []
        for part in np.split(np.arange(len(center)), cuts):
            near = _distances(x[part], x[part])
            use = (fresh[part][:, None] | fresh[part][None, :]) & (near < bound[part][:, None])
            np.fill_diagonal(use, False)
            i, j = np.nonzero(use)
            a.append(ids[part][i])
            b.append(ids[part][j])
            d.append(near[i, j])
        yield _links(np.concatenate(a), np.concatenate(b), np.concatenate(d))

    found = local.mapInArrow(pairs, LINK).withColumn("fresh", F.lit(True))
    met = members.where("fresh").select(F.col("center").alias("node"), F.col("member").alias("nbr"), F.lit(True).alias("met"))
    aged = graph.join(met, ["node", "nbr"], "left").select("node", "nbr", "d", (F.col("fresh") & F.col("met").isNull()).alias("fresh"))
    known_links = graph.select("node", "nbr")
    new = found.join(known_links, ["node", "nbr"], "left_anti").withColumn("improved", F.lit(True))
    return cut_lineage(nearest_only(aged.withColumn("improved", F.lit(False)).unionByName(new), degree))


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """``node, nbr, d``: a neighbour graph of ``nodes`` (``node, vec``)."""
    first = nodes.select(F.size("vec")).limit(1).collect()
    if not first:
        return nodes.sparkSession.createDataFrame([], LINK)
    graph = first_links(nodes, first[0][0], degree=degree)
    for r in range(rounds):
        graph = descend(graph, nodes, r, degree)
        change = graph.agg(F.avg(F.col("improved").cast("double"))).first()[0] or 0.0
        if change < LEAST_CHANGE:
            break
    else:
        raise RuntimeError(f"NN-descent did not settle in {rounds} rounds")
    return graph.select("node", "nbr", "d")


def exact(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, entries: DataFrame, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
    """``query, node, d``: the nodes in each query's beam after a greedy search.

    ``queries`` has ``query, q``, ``entries`` has ``query, node``. A step joins the nodes in the beam that are not yet expanded with
    their links, both ways, and measures those not seen before. It ends when every node in the beam is expanded.
    """
    links = graph.select("node", "nbr").unionByName(graph.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct()
    links = cut_lineage(links)

    def measured(pairs: DataFrame) -> DataFrame:
        return pairs.join(nodes, "node").join(queries, "query").select("query", "node", exact(F.col("q"), F.col("vec")).alias("d"))

    best = Window.partitionBy("query").orderBy("d", "node")
    state = cut_lineage(
        measured(entries.distinct()).withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam).select("query", "node", "d", F.lit(False).alias("done"))
    )
    for _ in range(steps):
        front = state.where("NOT done").select("query", "node")
        around = front.join(links, "node").select("query", F.col("nbr").alias("node")).distinct()
        around = around.join(state.select("query", "node"), ["query", "node"], "left_anti")
        both = state.withColumn("done", F.lit(True)).unionByName(measured(around).withColumn("done", F.lit(False)))
        state = cut_lineage(both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= beam).drop("place"))
        if not state.where("NOT done").limit(1).count():
            break
    else:
        raise RuntimeError(f"the search did not settle in {steps} steps")
    return state.select("query", "node", "d")


def nearest(rows: DataFrame, wanted: Column, k: int = NEAREST, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of each row where ``wanted`` (over ``vec_id``) holds.

    Ties go to the smaller id. Rows with the query's own id are no candidates. Fewer rows than ``k`` give all of them; rows that
    take no part (see :func:`vectors`) are neither queries nor results. Repeated ids count once: equal rows are one, and of unequal
    rows of one id the smallest vector is taken.
    """
    taken = cut_lineage(vectors(rows, key, vector).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    groups = taken.groupBy("vec").agg(F.min("vec_id").alias("node"))
    nodes = cut_lineage(groups.select("node", "vec"))
    of = taken.join(nodes, "vec").select("vec_id", "node")
    members = cut_lineage(of)
    graph = build_graph(nodes)
    asked = cut_lineage(taken.where(wanted).select(F.col("vec_id").alias("query"), F.col("vec").alias("q")))
    starts = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES)
    own = asked.select("query").join(members, F.col("query") == F.col("vec_id")).select("query", "node")
    far = asked.select("query", F.explode(F.sequence(F.lit(1), F.lit(ENTRIES))).alias("i")).join(
        starts.withColumn("i", F.row_number().over(Window.orderBy("node"))), "i"
    )
    found = search(graph, nodes, asked, own.unionByName(far.select("query", "node")))
    first = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    few = members.withColumn("place", first).where(F.col("place") <= k + 1).drop("place")
    hits = found.join(few, "node").where("query <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", F.col("d").alias("score"))


@query("op9_neighbours")
def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
