"""Packages out of manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import manifests as ops

c = F.col
SHOWN = ["path", "name", "version", "is_dev"]


@query("""SELECT '/srv/m' || s_suppkey || '/package.json' AS path, 'lib' || s_suppkey AS name, s_nationkey || '.1.0' AS version, false AS is_dev FROM supplier
UNION ALL SELECT '/srv/m' || s_suppkey || '/package.json', 'dev' || s_nationkey, '2.' || (s_suppkey % 10), true FROM supplier""")
def npm_manifest(t: Inputs):
    return ops.npm_manifest(t.v_manifests.withColumn("scan_id", F.lit("s"))).select(*SHOWN)


@query("""SELECT path, 'a' || id AS name, '1.' || scan_id || '.0' AS version, true AS is_dev, false AS is_transitive FROM v_lockfiles
UNION ALL SELECT path, 'b', '0.0.0', false, true FROM v_lockfiles
UNION ALL SELECT path, 'c', '3.0.0', false, true FROM v_lockfiles WHERE id % 2 = 1""")
def npm_lock(t: Inputs):
    return ops.npm_lock(t.v_lockfiles).select(*SHOWN, "is_transitive")


@query("""SELECT path, name, version, id % 3 > 0 AS is_dev FROM (
 SELECT id, path, 'lib' || id AS name, '1.' || scan_id AS version FROM v_requirement_files
 UNION ALL SELECT id, path, 'tool_' || scan_id, '2.' || (id % 7) FROM v_requirement_files
 UNION ALL SELECT id, path, 'plain-' || id, '0.0.0' FROM v_requirement_files
 UNION ALL SELECT id, path, 'near', '0.' || (id % 5) FROM v_requirement_files)""")
def requirements(t: Inputs):
    return ops.requirements(t.v_requirement_files).select(*SHOWN)


@query("""WITH RECURSIVE f AS (SELECT scan_id, id, path FROM v_include_files),
e AS (SELECT a.scan_id, a.path, b.path AS included FROM f a JOIN f b ON b.scan_id = a.scan_id AND b.id IN ((a.id * 7) % 100, a.id + 25)),
r AS (SELECT scan_id, path AS root, path FROM f UNION SELECT r.scan_id, r.root, e.included FROM r JOIN e ON e.scan_id = r.scan_id AND e.path = r.path)
SELECT scan_id, root, path FROM r""")
def requirements_includes(t: Inputs):
    files = t.v_include_files
    return ops.requirements_includes(files, files.select("scan_id", "path"))


@query("""SELECT path, 'lib' || id AS name, '1.' || scan_id AS version, false AS is_dev FROM v_pipfiles
UNION ALL SELECT path, 'bare', '0.0.0', false FROM v_pipfiles UNION ALL SELECT path, 'dev' || scan_id, '2.0', true FROM v_pipfiles""")
def pipfile_lock(t: Inputs):
    return ops.pipfile_lock(t.v_pipfiles).select(*SHOWN)


@query("""SELECT path, 'lib' || id AS name, '1.' || scan_id AS version, false AS is_dev, 'org.g' || scan_id AS group_id, 'compile' AS scope, false AS managed FROM v_poms
UNION ALL SELECT path, 't', '${missing}', true, 'unknown', 'test', false FROM v_poms
UNION ALL SELECT path, 'bom', '0.0.0', false, 'm', 'compile', true FROM v_poms""")
def maven_pom(t: Inputs):
    return ops.maven_pom(t.v_poms).select(*SHOWN, "group_id", "scope", "managed")


@query("""SELECT ecosystem, count(*) AS n FROM (SELECT 'npm' AS ecosystem FROM v_manifests UNION ALL SELECT 'npm' FROM v_manifests
 UNION ALL SELECT unnest(['npm','npm']) FROM v_lockfiles UNION ALL SELECT 'npm' FROM v_lockfiles WHERE id % 2 = 1
 UNION ALL SELECT unnest(['pypi','pypi','pypi','pypi']) FROM v_requirement_files UNION ALL SELECT unnest(['pypi','pypi','pypi']) FROM v_pipfiles
 UNION ALL SELECT unnest(['maven','maven','maven']) FROM v_poms) GROUP BY 1""")
def dependencies(t: Inputs):
    columns = ["scan_id", "path", "content"]
    files = t.v_manifests.withColumn("scan_id", F.lit("s")).select(*columns)
    for other in (t.v_lockfiles, t.v_requirement_files, t.v_pipfiles, t.v_poms):
        files = files.unionByName(other.select(*columns))
    return ops.dependencies(files).groupBy("ecosystem").agg(F.count("*").alias("n"))
