"""Embedding near-duplicates by NN-descent.

Vectors are compared only within a label, by cosine in double precision.

1. Fold: equal vectors of a label become one node with a number of copies.
2. Seed: nodes are sorted by label and random-hyperplane signs several times over; overlapping blocks of
   neighbours in the order are compared, so a crowd of look-alikes spreads over many blocks and tasks. The number
   of orders follows from the largest label: so many that a pair at the threshold stays unseen in all of them with
   a chance of MISS at most (`seed_orders`). It grows as a small power of the label's size. The first few orders
   give every node neighbours to start from, the others links only.
3. Refine: every node's neighbours and reverse neighbours are compared with one another (the
   neighbours-of-neighbours join), and each node keeps its best. Reverse neighbours are limited per round.
4. Enlarge: a node whose whole list links with it is saturated. Its list grows before the next round, it is
   offered every candidate of at least the threshold then, and what it has grown to it keeps.
5. Audit: a sample of nodes is compared with all nodes, and grows until AUDIT_LINKS true links are seen or
   MOST_AUDITED nodes are asked; while too few of these links are in the lists, or for saturated nodes in their
   component, another seed order and another round follow. A sample without any link measures nothing, whatever
   the lists hold; then the bound of the seeds stands alone.
6. Links of at least the threshold are kept; components come from them. Labels with saturated nodes are
   crowded: their components are brought together, and the links of saturated nodes counted, exactly, by
   comparing those nodes with the vectors that can reach them, block by block. Where the audit still finds
   too little after the last round, all nodes of every label are compared so.

Null labels, and vectors that are null, zero or hold a null or non-finite component, link with nothing;
vectors of different lengths never link. Every row is returned, repeated rows each with the others as
links. Rows with a null id are returned and link with nothing. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from timelode.llm.common import picked, quoted, save
from timelode.llm.components import connected_components

THRESHOLD, NEIGHBOURS, LONGEST, BLOCK = 0.93, 12, 48, 128
SEED_ORDERS, ROUNDS, MOST_ROUNDS, SIGNS, MISS = 3, 2, 5, 32, 0.02
AUDIT_NODES, MOST_AUDITED, AUDIT_LINKS, AUDIT_RECALL, CROWD = 512, 4096, 200, 0.97, 1024
EDGES = "node bigint, other bigint, sim double"
_LAST = np.iinfo(np.int64).max


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def _edges(node: list, other: list, sim: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((node, np.int64), (other, np.int64), (sim, np.float64))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "other", "sim"])


def fold(rows: DataFrame) -> DataFrame:
    """(node, label, vec, copies) of rows (id, label, vec) that can link: the node is the smallest id."""
    fit = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0), F.lit(False))
    return rows.filter(fit).groupBy("label", "vec").agg(F.min("id").alias("node"), F.count("*").alias("copies"))


def seed_orders(nodes: DataFrame, threshold: float, block: int = BLOCK, miss: float = MISS) -> int:
    """How many orders let a pair at the threshold meet in a block, but for a chance of `miss`.

    Half a block of nodes on either side of a node is compared with it. In a label of n nodes those share some
    log2(n / half a block) leading signs, and a pair at an angle a shares one sign with a chance of 1 - a / pi.
    """
    largest = nodes.groupBy("label", F.size("vec").alias("width")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits = math.ceil(math.log2(largest / (block // 2))) if largest > block // 2 else 0
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return SEED_ORDERS if meet == 1 else max(SEED_ORDERS, math.ceil(math.log(miss) / math.log(1 - meet)))


def seed_edges(nodes: DataFrame, order: int, keep: int = NEIGHBOURS, block: int = BLOCK, least: float = -2.0) -> DataFrame:
    """Best neighbours of each node, of similarity `least` or more, among overlapping blocks of one random order."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            for i, v in enumerate(_vectors(batch.column("vec"))):
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng((order, len(v))).standard_normal((SIGNS, len(v)))
                codes[i] = int(np.packbits(planes[len(v)] @ v > 0).view(">u4")[0]) + (len(v) << SIGNS)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("label"), batch.column("vec"), pa.array(codes)], ["node", "label", "vec", "code"])

    def compare(part: list[tuple]) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        at = 0
        while at < len(part):
            stop = at + 1
            while stop < len(part) and part[stop][1] == part[at][1] and len(part[stop][2]) == len(part[at][2]):
                stop += 1
            if stop - at > 1:
                ids, unit = np.array([x[0] for x in part[at:stop]]), _unit(np.stack([x[2] for x in part[at:stop]]))
                sims = unit @ unit.T
                np.fill_diagonal(sims, -2)
                k = min(keep, stop - at - 1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                found = np.take_along_axis(sims, best, 1).ravel()
                on = found >= least
                out[0].append(np.repeat(ids, k)[on])
                out[1].append(ids[best].ravel()[on])
                out[2].append(found[on])
            at = stop
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        fresh = False
        for batch in batches:
            for x in zip(batch.column("node").to_pylist(), batch.column("label").to_pylist(), _vectors(batch.column("vec")), strict=True):
                held.append(x)
                fresh = True
                if len(held) == block:
                    yield _edges(*compare(held))
                    held, fresh = held[block // 2 :], False
        if fresh:
            yield _edges(*compare(held))

    label = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "label", "vec").mapInArrow(signs, f"node bigint, label {label}, vec {nodes.schema['vec'].dataType.simpleString()}, code bigint")
    return coded.repartitionByRange("label", "code", "node").sortWithinPartitions("label", "code", "node").select("node", "label", "vec").mapInArrow(run, EDGES)


def best_of(edges: DataFrame, limits: DataFrame | None = None, keep: int = NEIGHBOURS) -> DataFrame:
    """The best `keep` neighbours of each node; of those in `limits` (node, most), as many as they may have."""
    once = edges.groupBy("node", "other").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other")))
    if limits is None:
        return ranked.filter(F.col("rank") <= keep).drop("rank")
    return ranked.filter(F.col("rank") <= LONGEST).join(limits, "node", "left").filter(F.col("rank") <= F.coalesce("most", F.lit(keep))).drop("rank", "most")


def saturated(graph: DataFrame, threshold: float, keep: int = NEIGHBOURS) -> DataFrame:
    """(node, held): nodes whose list is full and links with them all."""
    return graph.groupBy("node").agg(F.count("*").alias("held"), F.min("sim").alias("least")).filter((F.col("held") >= keep) & (F.col("least") >= threshold)).select("node", "held")


def refine(nodes: DataFrame, graph: DataFrame, threshold: float, keep: int = NEIGHBOURS) -> DataFrame:
    """Candidates of one round: better than the last neighbour of the node they are offered to, or links of a saturated one."""
    back = graph.withColumn("rank", F.row_number().over(Window.partitionBy("other").orderBy(F.xxhash64("node", "other"), "node"))).filter(F.col("rank") <= keep)
    around = graph.select("node", "other").unionByName(back.select(F.col("other").alias("node"), F.col("node").alias("other"))).unionByName(nodes.select("node", F.col("node").alias("other"))).distinct()
    # a full list of links takes any further link, so its bound is the largest double below the threshold
    bound = F.least(F.min("sim"), F.lit(float(np.nextafter(threshold, 0))))
    last = graph.groupBy("node").agg(F.when(F.count("*") >= keep, bound).otherwise(-2.0).alias("last"))
    offers = nodes.join(last, "node", "left").select(F.col("node").alias("other"), "vec", F.coalesce("last", F.lit(-2.0)).alias("last"))
    near = around.join(offers, "other").groupBy("node").agg(F.collect_list(F.struct("other", "vec", "last")).alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column("near")
            items, ends = near.flatten(), np.cumsum(near.value_lengths().to_numpy())
            others, last = items.field("other").to_numpy(), items.field("last").to_numpy()
            vectors, start, out = items.field("vec"), 0, ([], [], [])
            flat, width = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate(([0], np.cumsum(vectors.value_lengths().to_numpy())))
            for end in ends:
                if end - start > 1:
                    unit = _unit(flat[width[start] : width[end]].reshape(end - start, -1))
                    sims = unit @ unit.T
                    np.fill_diagonal(sims, -2)
                    i, j = np.nonzero(sims > last[start:end, None])
                    for x, y in zip(out, (others[start + i], others[start + j], sims[i, j]), strict=True):
                        x.append(y)
                start = end
            yield _edges(*out)

    return near.select("near").mapInArrow(run, EDGES)


def audit(nodes: DataFrame, graph: DataFrame, threshold: float, keep: int = NEIGHBOURS, most: int = AUDIT_NODES) -> float | None:
    """Share of the true links of a sample of nodes that the graph holds in either direction, or None where the sample has no link.

    The sample grows from `most` nodes until it has AUDIT_LINKS links or MOST_AUDITED nodes; the pairs stay in Spark.
    """
    while True:
        n, got, asked = _audited(nodes, graph, threshold, keep, most)
        if n >= AUDIT_LINKS or asked < most or most >= MOST_AUDITED:
            return got / n if n else None
        most *= 8


def _audited(nodes: DataFrame, graph: DataFrame, threshold: float, keep: int, most: int) -> tuple[int, int, int]:
    """True links of the first `most` nodes in the order of their hashes, how many of them the graph holds, and the nodes asked; the sample is broadcast."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(most).select("node", "label", "vec").toArrow()
    ids, labels, vectors = sample["node"].to_numpy(), sample["label"].to_pylist(), [v / np.linalg.norm(v) for v in _vectors(sample["vec"].combine_chunks())]
    groups: dict[tuple, list[int]] = {}
    for i, (label, v) in enumerate(zip(labels, vectors, strict=True)):
        groups.setdefault((label, len(v)), []).append(i)
    asked = nodes.sparkSession.sparkContext.broadcast({k: (ids[v], np.stack([vectors[i] for i in v])) for k, v in groups.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            node, label, rows = batch.column("node").to_numpy(), batch.column("label").to_pylist(), _vectors(batch.column("vec"))
            mine: dict[tuple, list[int]] = {}
            for i, v in enumerate(rows):
                mine.setdefault((label[i], len(v)), []).append(i)
            for key, at in mine.items():
                if key in asked.value:
                    who, unit = asked.value[key]
                    sims = unit @ _unit(np.stack([rows[i] for i in at])).T
                    i, j = np.nonzero(sims >= threshold)
                    for x, y in zip(out, (who[i], node[at][j], sims[i, j]), strict=True):
                        x.append(y)
            yield _edges(*out)

    truth = nodes.select("node", "label", "vec").mapInArrow(run, EDGES).filter("node <> other")
    both = _both_ways(graph.filter(F.col("sim") >= threshold))
    found = truth.join(both.withColumn("found", F.lit(1)), ["node", "other"], "left")
    # the links of saturated nodes are counted later on, so it is enough that the graph has led to them
    full = saturated(graph, threshold, keep).select("node", F.lit(1).alias("full"))
    led = both.join(full, "node", "left_semi").join(truth.select("node").distinct(), "node", "left_semi").select("node", F.col("other").alias("mid")).join(both.select(F.col("node").alias("mid"), "other"), "mid").select("node", "other").distinct()
    found = found.join(led.withColumn("led", F.lit(1)), ["node", "other"], "left")
    n, got = found.agg(F.count("*"), F.count(F.coalesce("found", "led"))).first()
    return n, got, len(ids)


def _both_ways(graph: DataFrame) -> DataFrame:
    return graph.select("node", "other").unionByName(graph.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()


def compare_blocks(nodes: DataFrame, asked: DataFrame, group: list[str], threshold: float, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Exact comparison of the nodes of `asked` with all others of their group, block by block.

    Returns (node, n), the number of vectors that link with an asked node, its own copies included, and
    links (a, b) that connect what links do. `nodes` has node, vec, copies and the columns of `group`; of each
    pair of blocks at most a star per local component is returned, so rows don't grow with the links. Blocks
    are dealt by group and number, so a large group is many keys.
    """
    names = [f"g{i}" for i in range(len(group))]
    rows = nodes.select(*[F.col(c).alias(n) for c, n in zip(group, names, strict=True)], "node", "vec", "copies").withColumn("width", F.size("vec"))
    names.append("width")
    touched = rows.join(asked.select("node"), "node", "left_semi").groupBy(*names).agg(F.count("*").alias("asks"))
    sizes = rows.join(touched.select(*names), names, "left_semi").groupBy(*names).agg(F.count("*").alias("size"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / crowd)).cast("int")
    item = F.collect_list(F.struct("node", "vec", "copies"))
    data = save(rows.join(sizes, names).withColumn("y", block("size")).groupBy(*names, "y").agg(item.alias("data")), "blocks")
    asking = rows.join(asked.select("node"), "node", "left_semi").join(touched, names).withColumn("x", block("asks"))
    asking = save(asking.groupBy(*names, "x").agg(item.alias("asked")), "asking-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, d = (batch.column(c).slice(i, 1).flatten() for c in ("asked", "data"))
                ua, ud = (_unit(np.stack(_vectors(x.field("vec")))) for x in (a, d))
                who, others = a.field("node").to_numpy(), d.field("node").to_numpy()
                near = ua @ ud.T >= threshold
                asks, touched = near.any(axis=1), near.any(axis=0)
                if not asks.any():
                    continue
                counts = near @ d.field("copies").to_numpy()
                who, others, counts, near = who[asks], others[touched], counts[asks], near[np.ix_(asks, touched)]
                # local components: labels sink to the least one over rows and columns until nothing changes
                least, last = who, None
                while last is None or (least != last).any():
                    last = least
                    column = np.minimum(np.where(near, least[:, None], _LAST).min(axis=0), others)
                    least = np.minimum(np.where(near, column[None, :], _LAST).min(axis=1), least)
                node, n = np.concatenate((who, who, others)), np.concatenate((counts, np.full(len(who) + len(others), -1)))
                other = np.concatenate((who, least, column))
                yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int64)), pa.array(other.astype(np.int64)), pa.array(n.astype(np.int64))], ["node", "other", "n"])

    grid = asking.select(*names, "x").join(data.select(*names, "y"), names).repartition(*names, "x", "y")
    pairs = grid.join(asking, [*names, "x"]).join(data, [*names, "y"])
    found = save(pairs.select("asked", "data").mapInArrow(run, "node bigint, other bigint, n bigint"), "compared")
    return found.filter("n >= 0").groupBy("node").agg(F.sum("n").alias("n")), found.filter("n < 0 AND node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def neighbour_graph(nodes: DataFrame, threshold: float = THRESHOLD, keep: int = NEIGHBOURS, rounds: int = MOST_ROUNDS) -> tuple[DataFrame, float | None]:
    """(node, other, sim) after seeding and refining, and the audited recall of its links, None where it could not be measured."""
    orders = seed_orders(nodes, threshold)
    graph = seed_edges(nodes, 0, keep)
    for order in range(1, orders):
        graph = graph.unionByName(seed_edges(nodes, order, keep, least=-2.0 if order < SEED_ORDERS else threshold))
    graph = save(best_of(graph, keep=keep), "graph")
    recall: float | None = 0.0
    for turn in range(rounds):
        # the lists of saturated nodes may be four times as long from now on, and a list stays as long as it has grown
        held = graph.groupBy("node").agg(F.count("*").alias("held"), F.min("sim").alias("least")).filter(F.col("held") >= keep)
        limits = held.select("node", F.when(F.col("least") >= threshold, F.least(F.col("held") * 4, F.lit(LONGEST))).otherwise(F.col("held")).alias("most"))
        offers = graph.unionByName(refine(nodes, graph, threshold, keep))
        if turn >= ROUNDS:
            offers = offers.unionByName(seed_edges(nodes, orders + turn, keep))
        graph = save(best_of(offers, limits, keep), "graph")
        if turn + 1 >= ROUNDS and ((recall := audit(nodes, graph, threshold, keep)) is None or recall >= AUDIT_RECALL):
            break
    return graph, recall


def embedding_groups(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, keep: int = NEIGHBOURS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    flat = quoted(vec_col)
    if rows.select(flat).schema[0].dataType != ArrayType(FloatType()):
        flat = flat.cast("array<double>")
    rows = save(picked(rows, id=quoted(id_col).cast("long"), label=label_col, vec=flat), "vectors")
    nodes = save(fold(rows), "nodes")
    graph, recall = neighbour_graph(nodes, threshold, keep, rounds)
    links = save(_both_ways(graph.filter(F.col("sim") >= threshold)), "links")
    full = save(saturated(graph, threshold, keep).select("node"), "saturated")
    if recall is not None and recall < AUDIT_RECALL:
        full = nodes.select("node")
    exact, stars = compare_blocks(nodes, full, ["label"], threshold)
    members = connected_components(links.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(stars))
    listed = links.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("listed"))
    found = nodes.select("node", "label", "vec", "copies").join(members, "node", "left").join(listed, "node", "left").join(exact, "node", "left")
    # the exact count holds the node's own copies
    n_links = F.coalesce(F.col("n") - 1, F.coalesce("listed", F.lit(0)) + F.col("copies") - 1)
    found = found.select("label", "vec", n_links.alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    result = rows.filter("id IS NOT NULL").join(found, ["label", "vec"], "left").unionByName(rows.filter("id IS NULL"), allowMissingColumns=True)
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
