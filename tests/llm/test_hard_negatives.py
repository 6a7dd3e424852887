"""Hard negatives against brute force, with trees of many small leaves."""

from __future__ import annotations

import random
from collections import defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>, id string, score string, leaf string, windows string"


def brute(rows, is_anchor, positives, negatives, scale=256.0):
    kept = defaultdict(list)
    for vec_id, label, v, *_ in rows:
        if None not in (vec_id, label, v) and all(x is not None and isfinite(x) for x in v):
            whole = [floor(scale * x) for x in v]
            if sum((abs(x) + 1) ** 2 for x in whole) < 2**62:
                kept[vec_id].append((label, whole))
    points = {k: min(v) for k, v in kept.items()}
    out = []
    for a, (label, v) in points.items():
        if not is_anchor(a):
            continue
        best = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), o, other == label) for o, (other, w) in points.items() if o != a)
        for minus, p, _ in [x for x in best if x[2]][:positives]:
            fits = [(o, -s) for s, o, same in best if not same and 30 * -minus <= 100 * -s <= 90 * -minus][:negatives]
            out += [(a, p, rank, o, -minus, s) for rank, (o, s) in enumerate(fits, 1)]
    return sorted(out)


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    rows = []
    for k in range(900):
        c = rng.choice(centres)
        rows.append((k * 3, rng.randrange(4), [x + rng.gauss(0, 0.4) for x in c], "x", "y", "z", "w"))
    rows += [(10_000 + k, rng.randrange(4), centres[0], *"xyzw") for k in range(300)]  # one common vector
    rows += [rows[5], rows[5], (rows[7][0], 0, [9.0] * 6, *"abcd")]
    rows += [(None, 1, [1.0] * 6, *"abcd"), (50, None, [1.0] * 6, *"abcd"), (52, 1, None, *"abcd"), (53, 1, [1.0, None], *"abcd")]
    rows += [(55, 1, [float("nan")] * 6, *"abcd"), (56, 1, [float("inf")] * 6, *"abcd"), (58, 1, [1e300] * 6, *"abcd")]
    rows += [(59, 1, [], *"abcd"), (61, 2, [2.0], *"abcd"), (62, 3, [0.0] * 6, *"abcd"), (64, 2, [3e5] * 6, *"abcd"), (-30, 1, [-1.0] * 6, *"abcd")]
    return rows


@pytest.mark.parametrize(("pack", "block", "arity"), [(40, 16, 3), (200, 7, 8), (4096, 4096, 8)])
def test_against_brute_force(spark, pack, block, arity):
    rows = made(pack)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 15 == 0, pack=pack, block=block, arity=arity)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 15 == 0, 5, 10)


def test_wide_scores(spark):
    """Scores beyond what a double holds exactly."""
    rng = random.Random(2)
    rows = [(k, k % 3, [rng.uniform(1e6, 2e6) for _ in range(4)], *"xyzw") for k in range(60)]
    table = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine_hard_negatives(table, F.col("vec_id") % 10 == 0, pack=8, arity=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda a: a % 10 == 0, 5, 10)


def test_nothing(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine_hard_negatives(nothing, F.col("vec_id") % 100 == 0).count() == 0
    some = spark.createDataFrame(made(1), SCHEMA)
    assert hard_negatives.mine_hard_negatives(some, F.lit(False)).count() == 0
    assert hard_negatives.mine_hard_negatives(some, F.lit(None).cast("boolean")).count() == 0


def test_eliminated_subtrees_hold_nothing():
    """Every row whose score lies in the window is in a visited leaf, and a narrow window leaves leaves out."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * (rng.standard_normal((30, 8)).repeat(40, 0) + 0.05 * rng.standard_normal((1200, 8))))
    most = float((x * x).sum(1).max())
    tree = hard_negatives.fit_tree(x[::2], most, len(x), 40, 4)
    leaf, ranges = hard_negatives.route(tree, x)
    for node in tree.nodes:
        node.low, node.high = np.full((4, 4), np.inf), np.full((4, 4), -np.inf)
    for (place, k), (low, high) in ranges.items():
        tree.nodes[place].low[: len(low), k], tree.nodes[place].high[: len(high), k] = low, high
    for node in tree.nodes:
        size = len(node.points)
        node.low, node.high = node.low[:size, :size], node.high[:size, :size]
    skipped = 0
    for a in x[::50]:
        scores = x @ a
        low, high = sorted(np.quantile(scores, [0.9, 0.99]))
        seen = set(hard_negatives.visited(tree, a, [(int(low), int(high))]))
        assert set(leaf[(scores >= int(low)) & (scores <= int(high))]) <= seen
        skipped += tree.leaves - len(seen)
    assert tree.leaves > 10
    assert skipped > 0
