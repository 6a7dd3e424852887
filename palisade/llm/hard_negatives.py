"""Hard negatives by a multiway hyperplane tree (a GNAT).

A node of the tree has several split points, and a vector belongs to the nearest of them. For every split point and
every subtree of its node the tree stores the smallest and the largest distance from the point to the vectors of that
subtree. A search looks for vectors whose distance from an anchor lies within an annulus; by the triangle inequality a
subtree holds none of them if its range from some split point misses the annulus around the anchor, seen from there.
Leaves are compared exactly.

Scores are inner products of integers. A vector x with the further component sqrt(M - |x|^2), where M is the largest
squared length, is at a distance of sqrt(|a|^2 + M - 2 a.x) from an anchor a with the further component 0, so an
interval of scores is an annulus.

Split points come from a sample of bounded size; the ranges come from all rows, and every row is in a leaf. A leaf is
dealt by hash into packs of bounded size, anchors into blocks, and a pack meets a block in one task. A search first
looks into the pack of the anchor itself, so that the rest is searched only for what is better.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stored

#: Split points of a node, rows that a sample has at most, rows of a pack, anchors of a block.
ARITY, SAMPLE, PACK, BLOCK = 8, 8192, 4096, 4096
#: Scores are longs, so a row whose squared length is none is left out; below EXACT a double holds every score.
LONGEST, EXACT = 2.0**62, 2.0**53
#: Share of sqrt(M) by which ranges are widened, far above what rounding can do to a distance.
SLACK = 1e-6
NO_SCORE = -(2**63)


@dataclass
class Node:
    """Split points with their further component, where each leads (a node, or a leaf as its number's complement), and
    the distances [point, subtree] that all rows keep to."""

    points: np.ndarray
    further: np.ndarray
    leads: list[int] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    most: float
    nodes: list[Node] = field(default_factory=list)
    leaves: int = 1


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as doubles; shorter ones end in zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    out = np.zeros((len(lists), width))
    out[np.arange(width) < pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _further(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def _apart(node: Node, x: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Distances of the node's points from x, [point, x]."""
    squared = (node.points**2).sum(1) + node.further**2
    return np.sqrt(np.maximum(squared[:, None] + (x * x).sum(1) + further**2 - 2 * (node.points @ x.T + np.outer(node.further, further)), 0))


def fit_tree(sample: np.ndarray, most: float, rows: int, pack: int, arity: int = ARITY) -> Tree:
    """A tree over a sample of `rows` rows, whose leaves hold about `pack` of them or can't be told apart."""
    tree = Tree(most)
    further = _further(sample, most)
    enough = max(2 * arity, len(sample) * pack // max(rows, 1))

    def grow(own: np.ndarray) -> int:
        if len(own) > enough:
            node = _split(sample[own], further[own], arity)
            if len(node.points) > 1:
                place = len(tree.nodes)
                tree.nodes.append(node)
                nearest = _apart(node, sample[own], further[own]).argmin(0)
                node.leads = [grow(own[nearest == k]) for k in range(len(node.points))]
                return place
        tree.leaves += 1
        return ~(tree.leaves - 1)

    tree.leaves = 0
    grow(np.arange(len(sample)))
    return tree


def _split(x: np.ndarray, further: np.ndarray, arity: int) -> Node:
    """Split points far from each other: each is the row farthest from those before it."""
    chosen, gap = [0], np.full(len(x), np.inf)
    while True:
        last = Node(x[chosen[-1:]], further[chosen[-1:]])
        gap = np.minimum(gap, _apart(last, x, further)[0])
        gap[chosen] = 0
        if len(chosen) == arity or gap.max() <= 0:
            return Node(x[chosen], further[chosen])
        chosen.append(int(gap.argmax()))


def route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]]:
    """The leaf of each row, and by (node, subtree) the smallest and largest distances from the node's points."""
    leaf, ranges = np.zeros(len(x), np.int64), {}
    further = _further(x, tree.most)
    waiting = [(0, np.arange(len(x)))] if tree.nodes else []
    while waiting:
        place, own = waiting.pop()
        node = tree.nodes[place]
        apart = _apart(node, x[own], further[own])
        nearest = apart.argmin(0)
        for k, to in enumerate(node.leads):
            here = nearest == k
            if here.any():
                ranges[place, k] = apart[:, here].min(1), apart[:, here].max(1)
                if to >= 0:
                    waiting.append((to, own[here]))
                else:
                    leaf[own[here]] = ~to
    return leaf, ranges


def visited(tree: Tree, anchor: np.ndarray, windows: list[tuple[int, int]]) -> list[int]:
    """Leaves that may hold a row whose score with the anchor lies within one of the windows."""
    if not tree.nodes:
        return [0]
    slack = SLACK * tree.most**0.5
    reach = float(anchor @ anchor) + tree.most
    near = np.array([max(reach - 2.0 * high, 0) for _, high in windows]) ** 0.5 - slack
    far = np.array([max(reach - 2.0 * low, 0) for low, _ in windows]) ** 0.5 + slack
    out, waiting = [], [0]
    while waiting:
        node = tree.nodes[waiting.pop()]
        apart = _apart(node, anchor[None, :], np.zeros(1))[:, 0]
        least = np.maximum(np.maximum(near[:, None] - apart, apart - far[:, None]), 0)  # [window, point]
        most = far[:, None] + apart
        meets = (node.high[None] >= least[:, :, None] - slack) & (node.low[None] <= most[:, :, None] + slack)
        for k in np.flatnonzero(meets.all(1).any(0)):
            if node.leads[k] >= 0:
                waiting.append(node.leads[k])
            else:
                out.append(~node.leads[k])
    return out


@dataclass
class Index:
    """Rows (id, label, v, leaf, pack), stored, the tree, packs by leaf, and the length of a vector at most."""

    rows: DataFrame
    tree: Tree
    packs: dict[int, int]
    width: int


def build_index(points: DataFrame, sample: int = SAMPLE, pack: int = PACK, arity: int = ARITY) -> Index:
    """`points`: id, label, v (array<long>), squared (double)."""
    found = points.agg(F.count("*").alias("n"), F.max("squared").alias("most"), F.max(F.size("v")).alias("width")).first()
    width = found.width or 0
    drawn = points.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    tree = fit_tree(_matrix(drawn, width), float(found.most or 0), found.n, pack, arity)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, _ = route(tree, _matrix(batch.column("v"), width))
            yield pa.record_batch([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, (low, high) in route(tree, _matrix(batch.column("v"), width))[1].items():
                old = seen.get(key, (low, high))
                seen[key] = np.minimum(old[0], low), np.maximum(old[1], high)
        flat = [(place, k, p, float(low[p]), float(high[p])) for (place, k), (low, high) in seen.items() for p in range(len(low))]
        names = ["place", "subtree", "point", "low", "high"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in flat], schema=pa.schema(list(zip(names, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True))))

    placed = stored(points.select("id", "label", "v").mapInArrow(place, "id long, label long, v array<long>, leaf long"))
    for node in tree.nodes:
        node.low = np.full((len(node.points), len(node.points)), np.inf)
        node.high = -node.low
    # as many rows as the tree has ranges, whatever the number of vectors
    for row in placed.select("v").mapInArrow(measure, "place long, subtree long, point long, low double, high double").groupBy("place", "subtree", "point").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[row.place].low[row.point, row.subtree] = row.low
        tree.nodes[row.place].high[row.point, row.subtree] = row.high
    packs = {row.leaf: -(-row.n // pack) for row in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf
    return Index(placed.withColumn("pack", _dealt(F.col("id"), _number(packs))), tree, packs, width)


def _number(packs: dict[int, int]) -> Column:
    several = {leaf: n for leaf, n in packs.items() if n > 1}
    if not several:
        return F.lit(1)
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    return F.coalesce(F.element_at(table, F.col("leaf").cast("int")), F.lit(1))


def _dealt(vec_id: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(vec_id), n).cast("long")


HITS = "anchor_id long, window_id long, other_id long, score long"


def _meet(same: bool, most: int, width: int):
    """The best rows of a pack for each window of a block's anchors, of the anchor's label or of all others."""

    def work(asks: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asks.num_rows and rows.num_rows:
            x, ids, labels = _matrix(rows["v"], width), rows["id"].to_numpy(), rows["label"].to_numpy()
            order = np.argsort(ids)
            x, ids, labels = x[order], ids[order], labels[order]
            for batch in asks.to_batches(max_chunksize=256):
                a = _matrix(batch["v"], width)
                exact = (a * a).sum(1).max() * (x * x).sum(1).max() < EXACT**2
                scores = (a @ x.T).astype(np.int64) if exact else a.astype(np.int64) @ x.T.astype(np.int64)
                for row, anchor, label, windows in zip(scores, batch["id"].to_pylist(), batch["label"].to_pylist(), batch["windows"].to_pylist(), strict=True):
                    usable = (labels == label) & (ids != anchor) if same else labels != label
                    for w in windows:
                        own = np.flatnonzero(usable & (row >= w["low"]) & (row <= w["high"]))
                        if len(own) > most:
                            own = own[row[own] >= np.partition(row[own], -most)[-most]]
                        best = own[np.argsort(-row[own], kind="stable")][:most]
                        out += [(anchor, w["window_id"], int(i), int(s)) for i, s in zip(ids[best], row[best], strict=True)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "window_id", "other_id", "score"])

    return work


def _best(hits: DataFrame, most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window_id").orderBy(F.desc("score"), "other_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= most)


def search(index: Index, asks: DataFrame, same: bool, most: int, n_asks: int, block: int = BLOCK) -> DataFrame:
    """`asks` (id, label, v, leaf, pack, windows: array of window_id, low, high), all of them rows of the index, to
    (anchor_id, window_id, other_id, score, rank): the `most` rows with the highest scores within each window."""
    blocks = -(-n_asks // block)
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long"))).alias("block")
    rows = index.rows.select("leaf", "pack", "id", "label", "v", numbers)
    asks = asks.withColumn("block", _dealt(F.col("id"), F.lit(max(blocks, 1))))
    key = ["leaf", "pack", "block"]
    tree, packs, width = index.tree, index.packs, index.width

    def meet(visits: DataFrame) -> DataFrame:
        return visits.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(_meet(same, most, width), HITS)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width)
            windows = [[(w["low"], w["high"]) for w in ws] for ws in batch.column("windows").to_pylist()]
            kept, to, part = [], [], []
            for k, (own, leaf, pack) in enumerate(zip(windows, batch.column("own_leaf").to_pylist(), batch.column("own_pack").to_pylist(), strict=True)):
                for other in visited(tree, x[k], own):
                    for p in range(packs.get(other, 0)):
                        if (other, p) != (leaf, pack):
                            kept.append(k), to.append(other), part.append(p)
            taken = batch.take(pa.array(kept, pa.int64())).select(["id", "label", "v", "windows", "block"])
            yield pa.record_batch([*taken.columns, pa.array(to, pa.int64()), pa.array(part, pa.int64())], [*taken.schema.names, "leaf", "pack"])

    first = stored(meet(asks.select(*key, "id", "label", "v", "windows")))
    kth = _best(first, most).filter(F.col("rank") == most).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window_id", "score"))).alias("kth"))
    risen = asks.join(kth, F.col("id") == F.col("anchor_id"), "left").withColumn(
        "windows", F.transform("windows", lambda w: w.withField("low", F.greatest(w["low"], F.try_element_at("kth", w["window_id"]))))
    )
    window = "array<struct<window_id:bigint,low:bigint,high:bigint>>"
    visits = risen.select("id", "label", "v", "windows", "block", F.col("leaf").alias("own_leaf"), F.col("pack").alias("own_pack")).mapInArrow(
        visit, f"id long, label long, v array<long>, windows {window}, block long, leaf long, pack long"
    )
    return _best(first.unionByName(meet(visits)), most)


def usable_points(vectors: DataFrame, scale: float, vec_id: str, label: str, embedding: str) -> DataFrame:
    """id, label, v: components as floor(scale * x), for rows that take part, one for each id."""
    whole = F.transform(F.col(embedding).cast("array<double>"), lambda x: x * F.lit(float(scale)))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda s, x: s + (F.abs(x) + 1) * (F.abs(x) + 1))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
    usable &= ~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.coalesce(usable, F.lit(False))).filter(square < LONGEST)
    numbers = rows.select("id", F.struct("label", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v")).alias("row"))
    return numbers.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.v", F.aggregate("row.v", F.lit(0.0), lambda s, x: s + x * x).alias("squared"))


def mine_hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
    vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", sample: int = SAMPLE, pack: int = PACK, block: int = BLOCK, arity: int = ARITY,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). `anchors` is a condition on vec_id.

    A score is the inner product of two rows, their components taken as floor(scale * x). An anchor's positives are its
    `positives` best other rows of the same label; for each of them the `negatives` best rows of other labels whose
    score is between `low` and `high` percent of the positive's. Higher scores come first, then smaller ids; where
    there are fewer rows, there are fewer results.

    Rows with a null id, label or vector or a null or non-finite component take no part, nor does a row whose squared
    length does not fit into a long (2^62 or more). A shorter vector counts as if it ended in zeros; an empty one scores 0. An id that several rows
    have counts once, with the smallest (label, vector). An empty table, or one without anchors, gives no rows; other
    columns are not read."""
    points = stored(usable_points(vectors, scale, vec_id, label, embedding))
    index = build_index(points, sample, pack, arity)
    named = index.rows.select(F.struct(F.col("id").alias(vec_id)).alias("key"), "*").select("key.*", F.struct("*").alias("row"))
    asks = stored(named.filter(F.coalesce(anchors, F.lit(False))).select("row.*").drop("key"))
    n = asks.count()
    every = F.array(F.struct(F.lit(0).cast("long").alias("window_id"), F.lit(NO_SCORE).alias("low"), F.lit(2**63 - 1).alias("high")))
    near = stored(search(index, asks.withColumn("windows", every), True, positives, n, block).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 100 * score may be no long
    bound = lambda share, up: (F.ceil if up else F.floor)(F.col("positive_score").cast("decimal(20,0)") * share / 100)
    windows = near.withColumn("low", bound(low, True).cast("long")).withColumn("high", bound(high, False).cast("long")).filter("low <= high")
    windows = windows.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("window_id"), "low", "high")).alias("windows"))
    asked = stored(asks.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"))
    found = search(index, asked, False, negatives, n, block).withColumnRenamed("window_id", "positive_id")
    out = found.join(near, ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
