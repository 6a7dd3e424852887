"""Versions in affected spans: against a plain loop, and a package with very many of both."""

import random
import time

import pytest
from palisade.operators import advisories as adv

DEPS = "name string, ecosystem string, version string"
SPANS = "osv_id string, ecosystem string, name string, introduced string, fixed string, last_affected string, exact string"


def key(version: str) -> tuple:
    parts = [int(x) for x in version.split(".")]
    while len(parts) > 1 and parts[-1] == 0:
        parts.pop()
    return tuple(parts)


def brute(deps, spans):
    out = set()
    for name, _, version in deps:
        for osv, _, package, introduced, fixed, last, exact in spans:
            if package != name:
                continue
            ranged = introduced is not None and "x" not in version and (introduced == "0" or key(introduced) <= key(version))
            ranged = ranged and (key(version) < key(fixed) if fixed else key(version) <= key(last) if last else True)
            if exact == version or ranged:
                out.add((name, version, osv))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, seed):
    rng = random.Random(seed)
    some = lambda: ".".join(str(rng.randint(0, 4)) for _ in range(rng.randint(1, 3)))
    deps = {(f"p{rng.randint(0, 6)}", "npm", rng.choice([some(), some(), some(), "x1"])) for _ in range(rng.choice([1, 40, 300]))}
    spans = []
    for i in range(rng.choice([1, 60, 200])):
        fixed, last = rng.choice([(None, None), (some(), None), (None, some()), (some(), some())])
        spans.append((f"o{i % 90}", "npm", f"p{rng.randint(0, 8)}", rng.choice(["0", some(), some()]), fixed, last, None))
        spans.append((f"o{i % 90}", "npm", f"p{rng.randint(0, 8)}", None, None, None, rng.choice([some(), "x1"])))
    got = adv.match_advisories(spark.createDataFrame(sorted(deps), DEPS), spark.createDataFrame(spans, SPANS))
    rows = [(r["name"], r.version, r.osv_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(deps, spans)


def test_a_hot_package(spark):
    """10,000 versions and 10,000 spans of one package: 10^8 pairs, of which few are hits."""
    n = 10_000
    deps = spark.range(n).selectExpr("'hot' as name", "'npm' as ecosystem", "concat('1.', id) as version")
    spans = spark.range(n).selectExpr("concat('o', id) as osv_id", "'npm' as ecosystem", "'hot' as name", "concat('1.', id) as introduced", "concat('1.', id + 3) as fixed", "cast(null as string) as last_affected", "cast(null as string) as exact")
    start = time.time()
    hits = adv.match_advisories(deps, spans)
    assert hits.count() == 3 * n - 3
    assert time.time() - start < 60
    assert "Cartesian" not in hits._jdf.queryExecution().optimizedPlan().toString()
