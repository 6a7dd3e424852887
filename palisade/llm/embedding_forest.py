"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits the vectors of one label by random directions, recursively and at the median, until a leaf holds few;
vectors near a split go to both sides (spill), so close pairs part seldom, and many trees make up for those that do.
The spill is at least `WIDTH` deviations wide of how far linked vectors may lie apart on a direction. A group that is
about as tight as that is not split by a direction, since nearly all of it would go to both sides, but stays one leaf.
Thresholds come from a sample of bounded size for each node; every vector is routed. Vectors within a leaf are compared
exactly. A leaf that splitting could not make small (ties, tight groups) is compared in blocks, so nothing is left out.
A label that a tree leaves whole needs no other tree.

A pair that meets in several leaves is counted in the smallest of them only, so links are counted inside the leaves and
no pair leaves them: a leaf gives a sum for each vector and a label for each of its components. Identical vectors are
one entry with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Stored, stored
from palisade.llm.components import components

#: Splits that a round makes below each node that is too large, and rows that a node's thresholds are taken from.
LEVELS, SAMPLE = 6, 2048
#: Spill in standard deviations of the projected distance at the threshold, and the share of a node that a side may keep.
WIDTH, SIDE = 2.5, 0.7


def _projections(points: DataFrame, trees: int, seed: int, first: bool) -> DataFrame:
    """(c, tree, p): the projections for the next splits in each tree; directions depend on seed, tree and length."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, roots, vectors = batch.column("c").to_numpy(), batch.column("root").to_numpy(), batch.column("v")
            sizes = pc.list_value_length(vectors).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                if size not in directions:
                    directions[size] = np.random.default_rng([seed, int(size)]).standard_normal((size, trees * LEVELS))
                values = np.asarray(vectors.take(pa.array(rows)).flatten(), np.float64).reshape(len(rows), size)
                values = values / np.linalg.norm(values, axis=1, keepdims=True)
                p = (values @ directions[size]).reshape(-1)
                tree = np.tile(np.arange(trees, dtype=np.int32), len(rows))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(p) + 1, LEVELS, dtype=np.int32)), pa.array(p))
                yield pa.record_batch([pa.array(np.repeat(ids[rows], trees)), pa.array(tree), pa.array(np.repeat(roots[rows], trees)), lists], ["c", "tree", "node", "p"])

    out = points.select("c", "root", "v").mapInArrow(make, "c long, tree int, node long, p array<double>")
    return out.withColumn("node", F.xxhash64("tree", "node")) if first else out.drop("node")


def _splits(leaf: int, spill: float, width: float):
    """Thresholds of a node's next levels, from its sample: by heap index, the upper end of the left side and the lower
    end of the right one. A direction that parts little sends all to the left; depth 0 if all directions do."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        depth = int(min(LEVELS, np.ceil(np.log2(group.n.iloc[0] / leaf))))
        p = np.array(group.p.tolist())
        upper, lower = np.full(1 << depth, np.inf), np.full(1 << depth, np.inf)
        rows, parted = {1: np.arange(len(p))}, False
        for index in range(1, 1 << depth):
            here = p[rows[index], index.bit_length() - 1]
            low, middle, high = np.quantile(here, [0.5 - spill, 0.5, 0.5 + spill]) if len(here) else (0, 0, 0)
            low, high = min(low, middle - width / 2), max(high, middle + width / 2)
            left, right = here <= high, here >= low
            if len(here) and max(left.mean(), right.mean()) <= SIDE:
                lower[index], upper[index], parted = low, high, True
            else:
                left, right = np.ones(len(here), bool), np.zeros(len(here), bool)
            rows[2 * index], rows[2 * index + 1] = rows[index][left], rows[index][right]
        return pd.DataFrame({"s_tree": [group.tree.iloc[0]], "s_node": [group.node.iloc[0]], "depth": [depth if parted else 0], "upper": [upper.tolist()], "lower": [lower.tolist()]})

    return fit


def leaves(points: DataFrame, trees: int, leaf: int, spill: float, seed: int, width: float = 0.0) -> DataFrame:
    """(c, tree, node) for every point (c, root, v) and tree; a spilled point has several nodes."""
    now = Stored(_projections(points, trees, seed, True).withColumn("done", F.lit(False)))
    for turn in range(1, 64):
        counts = now.df.filter("not done").groupBy("tree", "node").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)
        if counts.isEmpty():
            break
        sized = now.df.join(counts.select(F.col("tree").alias("t"), F.col("node").alias("m"), "n"), (F.col("tree") == F.col("t")) & (F.col("node") == F.col("m")))
        draw = F.pmod(F.xxhash64(F.lit(seed + turn), "c", "tree"), F.lit(1 << 30)) < F.lit(float(SAMPLE << 30)) / F.col("n")
        fits = sized.filter(draw).groupBy("tree", "node").applyInPandas(_splits(leaf, spill, width), "s_tree int, s_node long, depth int, upper array<double>, lower array<double>")
        routed = now.df.join(fits, (F.col("tree") == F.col("s_tree")) & (F.col("node") == F.col("s_node")), "left").withColumn("at", F.lit(1))
        for level in range(LEVELS):
            p = F.element_at("p", level + 1)
            left = F.when(p <= F.element_at("upper", F.col("at") + 1), F.array(F.col("at") * 2)).otherwise(F.array().cast("array<int>"))
            right = F.when(p >= F.element_at("lower", F.col("at") + 1), F.array(F.col("at") * 2 + 1)).otherwise(F.array().cast("array<int>"))
            routed = routed.withColumn("at", F.explode(F.when(F.coalesce("depth", F.lit(0)) > level, F.concat(left, right)).otherwise(F.array("at"))))
        node = F.when(F.coalesce("depth", F.lit(0)) == 0, F.col("node")).otherwise(F.xxhash64("tree", "node", "at"))
        placed = Stored(routed.select("c", "tree", node.alias("node"), (F.col("done") | F.coalesce(F.col("depth") == 0, F.lit(False))).alias("done")))
        now.drop()
        next_p = _projections(points, trees, seed + turn, False).withColumnRenamed("c", "pc").withColumnRenamed("tree", "pt")
        now = Stored(placed.df.join(next_p, (F.col("c") == F.col("pc")) & (F.col("tree") == F.col("pt"))).select("c", "tree", "node", "done", "p"))
        placed.drop()
    return now.df.select("c", "tree", "node")


def _labels(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row that links reach."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1, initial=len(linked))
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    def work(table: pa.Table) -> pa.Table:
        node, i, j = (table[n][0].as_py() for n in ("leaf", "i", "j"))
        table = table.sort_by("c")
        ids, weight, block = (table[n].to_numpy() for n in ("c", "n", "block"))
        v = np.asarray(table["v"].combine_chunks().flatten(), np.float64).reshape(len(ids), -1)
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        linked = v @ v.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:
            linked &= block[:, None] != block[None, :]
        rows = np.flatnonzero(linked.any(1))
        linked = linked[np.ix_(rows, rows)]
        own = [[x for x in leaves if x < node] for leaves in (table["leaves"][int(r)].as_py() for r in rows)]
        place = {x: k for k, x in enumerate({x for leaves in own for x in leaves})}
        met = np.zeros((len(rows), max(1, len(place))), np.float32)
        for r, leaves in enumerate(own):
            met[r, [place[x] for x in leaves]] = 1
        once = linked & (met @ met.T == 0)
        return pa.table({"c": pa.array(ids[rows]), "links": pa.array((once * weight[rows]).sum(1).astype(np.int64)), "root": pa.array(ids[rows][_labels(linked)])})

    return work


def dedup_embeddings(vectors: DataFrame, threshold: float = 0.98, trees: int = 6, leaf: int = 1024, spill: float = 0.05, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: rows of the same label with a cosine of at least `threshold`
    are linked; component_id is the smallest id reachable, and the rows that have it are kept.

    Vectors that are null, empty, zero, or hold a null or non-finite component, and rows with a null label, link with
    nothing; so do vectors of different lengths. Every row counts, repeated ones too; a null id stays null and is
    never the smallest; other columns of `vectors` are not read; an empty table gives an empty one."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("g").isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"), F.col(label).alias("g"))
    good = rows.filter(usable)
    classes = good.groupBy("g", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    entries = stored(classes.withColumn("c", F.monotonically_increasing_id()).withColumn("root", F.xxhash64("g", F.size("v"))))
    width = WIDTH * max(0.0, 2 - 2 * threshold) ** 0.5
    at = stored(leaves(entries, trees, leaf, spill, seed, width).join(entries.select(F.col("c").alias("rc"), "root"), F.col("c") == F.col("rc")))
    undivided = at.filter(F.col("node") == F.xxhash64("tree", "root")).groupBy(F.col("root").alias("ur")).agg(F.min("tree").alias("only"))
    at = at.join(undivided, F.col("root") == F.col("ur"), "left").filter("only is null or tree = only")
    at = stored(at.select("c", F.xxhash64("tree", "node").alias("leaf")))
    sizes = at.groupBy(F.col("leaf").alias("l")).agg(F.ceil(F.count("*") / leaf).alias("blocks"))
    of = at.groupBy(F.col("c").alias("lc")).agg(F.collect_set("leaf").alias("leaves"))  # a few for each tree
    dealt = at.join(sizes, F.col("leaf") == F.col("l")).withColumn("block", F.pmod(F.xxhash64("c"), "blocks"))
    dealt = dealt.join(of, F.col("c") == F.col("lc")).join(entries.select(F.col("c").alias("ec"), "v", "n"), F.col("c") == F.col("ec"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = dealt.select("leaf", "c", "v", "n", "leaves", "block", meets)
    dealt = dealt.select("leaf", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "c", "v", "n", "leaves", "block")
    found = stored(dealt.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), "c long, links long, root long"))
    links = found.groupBy(F.col("c").alias("kc")).agg(F.sum("links").alias("links"))
    joined = stored(components(found.select(F.col("c").alias("a"), F.col("root").alias("b"))))
    whole = entries.join(joined, F.col("c") == F.col("node"), "left").select("g", "v", "c", "n", "least", F.coalesce("component", "c").alias("w"))
    smallest = whole.groupBy(F.col("w").alias("sw")).agg(F.min("least").alias("component_id"))
    named = whole.join(smallest, F.col("w") == F.col("sw")).join(links, F.col("c") == F.col("kc"), "left")
    named = named.select(F.col("g").alias("eg"), F.col("v").alias("ev"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(named, (F.col("g") == F.col("eg")) & (F.col("v") == F.col("ev"))).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
