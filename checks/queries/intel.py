"""Exploit intelligence and package matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import advisories as adv
from palisade.operators import dashboard, intel, sbom
from palisade.schemas import ADVISORY, EPSS_FEED, KEV_FEED
from palisade.sources.feeds import epss_rows, kev_rows

c = F.col
PRIORITY = """CASE WHEN k.cve_id IS NOT NULL OR coalesce(e.epss, 0) >= 0.7 THEN 'immediate' WHEN coalesce(e.epss, 0) >= 0.3 OR coalesce(m.cvss, 0) >= 8 THEN 'high'
  WHEN coalesce(e.epss, 0) >= 0.05 OR coalesce(m.cvss, 0) >= 5 THEN 'scheduled' ELSE 'monitor' END"""
MENTIONS = "m AS (SELECT scan_id, cve_id, max(cvss_score) AS cvss FROM v_findings WHERE cve_id IS NOT NULL GROUP BY 1, 2)"


@query("""SELECT scan_id, cve_id, max(cvss_score) AS cvss FROM (
  SELECT scan_id, cve_id, cvss_score FROM v_findings WHERE cve_id IS NOT NULL
  UNION ALL SELECT scan_id, upper(unnest(regexp_extract_all(title, '(?i)cve-[0-9]{4}-[0-9]{4,7}'))), cvss_score FROM v_findings
  UNION ALL SELECT scan_id, upper(unnest(regexp_extract_all('see cve-2020-' || lpad(line_number::VARCHAR, 4, '0') || ' and CVE-1999-12', '(?i)cve-[0-9]{4}-[0-9]{4,7}'))), cvss_score FROM v_findings
) GROUP BY 1, 2""")
def cve_mentions(t: Inputs):
    text = F.concat(
        F.lit("see cve-2020-"), F.lpad(c("line_number").cast("string"), 4, "0"), F.lit(" and CVE-1999-12")
    )
    return intel.cve_mentions(t.busy.v_findings.withColumn("description", text))


@query(f"""WITH m AS (SELECT cve_id, max(cvss_score) AS cvss FROM v_findings WHERE cve_id IS NOT NULL GROUP BY 1)
SELECT m.cve_id, m.cvss, k.cve_id IS NOT NULL AS known_exploited, e.epss, e.percentile, {PRIORITY} AS priority,
 CASE WHEN k.cve_id IS NULL THEN 'No active CISA exploitation record found.' ELSE coalesce(k.short_description, 'Known exploited vulnerability affecting ' || k.product || '.') END AS summary,
 concat_ws(',', CASE WHEN k.cve_id IS NOT NULL THEN 'CISA KEV' END, CASE WHEN e.cve_id IS NOT NULL THEN 'FIRST EPSS' END) AS sources,
 left(CASE {PRIORITY} WHEN 'immediate' THEN 'Patch immediately' WHEN 'high' THEN 'Plan patch for the' WHEN 'scheduled' THEN 'Remediate as part' ELSE 'Monitor for changes' END, 7) AS urgency
FROM m LEFT JOIN v_kev k ON k.cve_id = m.cve_id LEFT JOIN v_epss e ON e.cve_id = m.cve_id""")
def enrich_cves(t: Inputs):
    cves = t.v_findings.select(F.lower("cve_id").alias("cve_id"), c("cvss_score").alias("cvss"))
    return intel.enrich_cves(cves, t.v_kev, t.v_epss).withColumns(
        {"sources": F.array_join("sources", ","), "urgency": F.left("urgency", F.lit(7))}
    )


@query(f"""WITH {MENTIONS}, r AS (SELECT m.*, k.cve_id IS NOT NULL AS known, coalesce(e.epss, 0) AS epss, {PRIORITY} AS priority
  FROM m LEFT JOIN v_kev k ON k.cve_id = m.cve_id LEFT JOIN v_epss e ON e.cve_id = m.cve_id)
SELECT s.scan_id, count(r.cve_id) AS total_cves, count(*) FILTER (known) AS known_exploited, count(*) FILTER (priority IN ('immediate','high')) AS high_priority, coalesce(max(epss), 0) AS max_epss
FROM v_scans s LEFT JOIN r ON r.scan_id = s.scan_id GROUP BY 1""")
def intel_summary(t: Inputs):
    records = intel.scan_records(intel.cve_mentions(t.busy.v_findings), t.v_kev, t.v_epss)
    return intel.intel_summary(t.v_scans, records)


@query("SELECT DISTINCT cve_id, 'monitor' AS priority, false AS known_exploited FROM v_findings WHERE cve_id IS NOT NULL")
def intel_without_feeds(t: Inputs):
    mentions = intel.cve_mentions(t.v_findings)
    return intel.without_feeds(mentions).select("cve_id", "priority", "known_exploited")


@query(f"""WITH m AS (SELECT cve_id, max(cvss_score) AS cvss FROM v_findings WHERE cve_id IS NOT NULL GROUP BY 1),
r AS (SELECT m.cve_id, k.cve_id IS NOT NULL AS known, e.epss, {PRIORITY} AS priority FROM m LEFT JOIN v_kev k ON k.cve_id = m.cve_id LEFT JOIN v_epss e ON e.cve_id = m.cve_id),
p AS (SELECT f.scan_id, f.finding_id, 10 * CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END + CASE WHEN known THEN 100 ELSE 0 END
  + CASE priority WHEN 'immediate' THEN 80 WHEN 'high' THEN 50 ELSE 0 END + CASE WHEN epss >= 0.7 THEN 40 ELSE 0 END AS points FROM v_findings f LEFT JOIN r ON r.cve_id = f.cve_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY points DESC, finding_id) AS place FROM p)
SELECT scan_id, finding_id, points, place::INT AS place FROM k WHERE place <= 5""")
def top_risks(t: Inputs):
    records = intel.enrich_cves(
        t.busy.v_findings.select("cve_id", c("cvss_score").alias("cvss")), t.v_kev, t.v_epss
    )
    return dashboard.top_risks(t.busy.v_findings, records).select("scan_id", "finding_id", "points", "place")


@query("""SELECT cve_id, product, short_description FROM (SELECT upper(cve_id) AS cve_id, product, short_description, row_number() OVER (PARTITION BY cve_id ORDER BY ord DESC) AS n
  FROM (SELECT 'CVE-2020-' || CAST(p_size AS VARCHAR) AS cve_id, p_name AS product, p_brand AS short_description, p_partkey AS ord FROM part WHERE p_size > 3)) WHERE n = 1""")
def kev_feed(t: Inputs):
    docs = t.sql("""SELECT p_partkey, '{"vulnerabilities":[{"cveID":"' || CASE WHEN p_size > 3 THEN 'cve-2020-' || CAST(p_size AS STRING) ELSE '' END
      || '","product":"' || p_name || '","shortDescription":"' || p_brand || '"}]}' AS doc FROM part""")
    feed = docs.select("p_partkey", F.from_json("doc", KEV_FEED).alias("f")).select("p_partkey", "f.vulnerabilities")
    return kev_rows(feed, "p_partkey")


@query("""SELECT upper('cve-2021-' || p_partkey) AS cve_id, CASE WHEN p_size % 7 <> 0 THEN p_size / 100.0::DOUBLE END AS epss, CASE WHEN p_size % 5 <> 0 THEN p_size / 50.0::DOUBLE END AS percentile FROM part""")
def epss_feed(t: Inputs):
    docs = t.sql("""SELECT '{"data":[{"cve":"cve-2021-' || CAST(p_partkey AS STRING) || '","epss":"' || CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE CAST(p_size / CAST(100 AS DOUBLE) AS STRING) END
      || '","percentile":"' || CASE WHEN p_size % 5 = 0 THEN '-' ELSE CAST(p_size / CAST(50 AS DOUBLE) AS STRING) END || '"}]}' AS doc FROM part""")
    return epss_rows(docs.select(F.from_json("doc", EPSS_FEED).alias("f")).select("f.data"))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN 'OSV-' || p_partkey ELSE 'CVE-' || (2015 + p_partkey % 10) || '-' || lpad(p_partkey::VARCHAR, 5, '0') END AS cve_id, 'OSV-' || p_partkey AS osv_id,
  CASE p_size % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'medium' END AS severity,
  CASE p_size % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 0 WHEN 2 THEN 8 ELSE 5.5 END::DOUBLE AS cvss_score,
  CASE WHEN p_size % 5 = 0 THEN 'No description available' WHEN p_size % 5 = 1 THEN 'long ' || p_name ELSE p_name END AS summary,
  p_size || '.1' AS fixed, CASE WHEN p_size % 2 = 1 THEN '>=1,0.1,0.2' ELSE '0.1,0.2' END AS affected, 'https://x/' || p_partkey AS links FROM part""")
def advisory_flatten(t: Inputs):
    docs = t.v_osv_documents.select(F.from_json("document", ADVISORY).alias("d")).select("d.*")
    return adv.advisory_flatten(docs).select(
        "cve_id", "osv_id", "severity", "cvss_score", "summary",
        F.array_join("fixed_versions", ",").alias("fixed"),
        F.array_join("affected_versions", ",").alias("affected"),
        F.array_join("references", ",").alias("links"),
    )


@query("SELECT DISTINCT left(sha256(ecosystem || ':' || name || ':' || version), 16) AS key, name, version FROM v_dependencies")
def lookup_dedupe(t: Inputs):
    return adv.lookup_dedupe(t.v_dependencies.unionByName(t.v_dependencies)).select("key", "name", "version")


def _ranges(t: Inputs):
    return t.v_advisories.select(
        "osv_id", "ecosystem", "name",
        F.concat(c("introduced_major").cast("string"), F.lit(".0")).alias("introduced"),
        F.concat(c("fixed_major").cast("string"), F.lit(".0.0")).alias("fixed"),
        F.when(c("fixed_major") % 4 == 0, F.concat(c("fixed_major").cast("string"), F.lit(".3"))).alias("exact"),
    )


MATCHED = """matched AS (SELECT d.name, d.ecosystem, d.version, a.osv_id, a.cve_id, a.fixed_major, bool_or(fixed_major % 4 = 0 AND version = fixed_major || '.3') AS exact
 FROM v_dependencies d JOIN v_advisories a ON a.name = d.name AND a.ecosystem = d.ecosystem
 WHERE (v_major >= introduced_major AND v_major < fixed_major) OR (fixed_major % 4 = 0 AND version = fixed_major || '.3') GROUP BY ALL)"""


@query(f"WITH {MATCHED} SELECT name, ecosystem, version, osv_id, CASE WHEN exact THEN 'exact' ELSE 'range' END AS match_kind FROM matched")
def match_advisories(t: Inputs):
    return adv.match_advisories(t.v_dependencies.select("name", "ecosystem", "version").distinct(), _ranges(t))


@query("""SELECT 'Pkg_' || p_partkey AS name, 'OSV-' || p_partkey AS osv_id FROM part WHERE CASE p_size % 4
   WHEN 0 THEN false WHEN 1 THEN p_partkey % 40 <= p_size WHEN 2 THEN p_partkey % 40 BETWEEN 1 AND 19 ELSE p_partkey % 40 < p_size END""")
def match_advisories_events(t: Inputs):
    """Ranges over commits, closed ends, limits and pre-releases; names that differ in case and dashes."""
    docs = t.sql("""SELECT '{"id":"OSV-' || p_partkey || '","affected":[{"package":{"ecosystem":"PyPI","name":"pkg.' || p_partkey || '"},"ranges":[{"type":"' ||
      CASE p_size % 4 WHEN 0 THEN 'GIT","events":[{"introduced":"0"}' WHEN 1 THEN 'ECOSYSTEM","events":[{"introduced":"0"},{"last_affected":"' || p_size || '.5.0"}'
      WHEN 2 THEN 'SEMVER","events":[{"introduced":"1.0"},{"limit":"20.0"}' ELSE 'SEMVER","events":[{"introduced":"0"},{"fixed":"' || p_size || '.5.0-rc.1"}' END
      || ']}]}]}' AS d FROM part""")
    deps = t.sql("""SELECT 'Pkg_' || p_partkey AS name, 'pypi' AS ecosystem, p_partkey % 40 || '.5.0' || CASE WHEN p_partkey % 3 = 0 THEN '-rc.1' ELSE '' END AS version FROM part""")
    return adv.match_advisories(deps, adv.advisory_ranges(docs.select(F.from_json("d", ADVISORY).alias("d")).select("d.*"))).select("name", "osv_id")


@query("""SELECT 'lib' || p_partkey AS name, 'org.g' || p_size AS group_id, 'OSV-' || p_partkey AS osv_id FROM part WHERE p_size % 2 = 0""")
def match_advisories_names(t: Inputs):
    """Maven: the feed names group and artifact, the manifest gives them apart."""
    docs = t.sql("""SELECT '{"id":"OSV-' || p_partkey || '","affected":[{"package":{"ecosystem":"Maven","name":"org.g' || CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END
      || ':lib' || p_partkey || '"},"ranges":[{"events":[{"introduced":"1.0"},{"fixed":"1.0.20240101000001"}]}]}]}' AS d FROM part""")
    deps = t.sql("""SELECT 'lib' || p_partkey AS name, 'org.g' || p_size AS group_id, 'maven' AS ecosystem, '1.0.20240101000000' AS version FROM part""")
    return adv.match_advisories(deps, adv.advisory_ranges(docs.select(F.from_json("d", ADVISORY).alias("d")).select("d.*"))).select("name", "group_id", "osv_id")


@query(f"""WITH {MATCHED} SELECT cve_id AS rule_id, cve_id || ': ' || name || '@' || version AS title, 'Vulnerable dependency: ' || CASE WHEN ecosystem = 'maven' THEN 'unknown:' || name || ':' || version ELSE name || '@' || version END AS evidence,
  CASE WHEN fixed_major > 10 THEN 'Upgrade ' || name || ' from ' || version || ' to ' || fixed_major || '.0.0 (other fixed versions: b, c, d)' ELSE 'No fixed version available for ' || name || '. Consider finding an alternative package.' END AS remediation,
  'medium' AS severity FROM matched""")
def cve_findings(t: Inputs):
    deps = t.v_dependencies.select(
        "name", "ecosystem", "version", F.lit("s").alias("scan_id"), F.lit("m").alias("path"),
        F.lit(None).cast("string").alias("group_id"), F.lit(False).alias("is_dev"), F.lit(False).alias("is_transitive"),
    ).distinct()
    fixed = F.concat(c("fixed_major").cast("string"), F.lit(".0.0"))
    flat = t.v_advisories.select(
        "osv_id", "cve_id", F.lit("medium").alias("severity"), F.lit(5.5).alias("cvss_score"), F.lit("").alias("summary"),
        F.when(c("fixed_major") > 10, F.array(fixed, F.lit("b"), F.lit("c"), F.lit("d"), F.lit("e")))
        .otherwise(F.array().cast("array<string>")).alias("fixed_versions"),
        F.array().cast("array<string>").alias("references"),
    )
    found = adv.cve_findings(deps, _ranges(t), flat)
    return found.select("rule_id", "title", "evidence", "remediation", "severity")


@query("""SELECT name, version, ecosystem, 'MIT' AS license, 'pkg:' || ecosystem || '/' || name || '@' || version AS purl FROM v_dependencies""")
def sbom_packages(t: Inputs):
    return sbom.sbom_packages(t.v_dependencies.withColumn("scan_id", F.lit("s")), "MIT").drop("scan_id")


@query(r"""
WITH e AS (SELECT scan_id, finding_id, CASE WHEN line_number % 2 = 0 THEN 'lib' || line_number || '==' || line_number || '.1' ELSE evidence END AS evidence FROM v_findings WHERE category = 'cve'),
p AS (SELECT scan_id, finding_id, CASE WHEN contains(evidence, '==') THEN split_part(evidence, '==', 1) WHEN evidence = '' THEN 'unknown' ELSE evidence END AS name,
   CASE WHEN contains(evidence, '==') THEN split_part(evidence, '==', 2) ELSE '0.0.0' END AS version FROM e),
f AS (SELECT scan_id, name, version, row_number() OVER (PARTITION BY scan_id, name ORDER BY finding_id) AS n FROM p)
SELECT f.scan_id, name, version, NULL AS license, 'pkg:pypi/' || name || '@' || version AS purl FROM f JOIN v_scans s ON s.scan_id = f.scan_id WHERE n = 1 AND status <> 'failed'
UNION ALL SELECT scan_id, regexp_extract(target, '[^/]*$'), '0.0.0', 'MIT', NULL FROM v_scans WHERE status <> 'failed' AND scan_id NOT IN (SELECT scan_id FROM e)
UNION ALL SELECT scan_id, 'stored', '9', NULL, NULL FROM v_scans WHERE status = 'failed'""")
def sbom_from_findings(t: Inputs):
    scans = t.v_scans.withColumn(
        "metadata_json",
        F.when(c("status") == "failed", F.lit('{"sbom":{"packages":[{"name":"stored","version":"9"}]}}')),
    )
    pinned = F.concat(F.lit("lib"), c("line_number").cast("string"), F.lit("=="), c("line_number").cast("string"), F.lit(".1"))
    found = t.v_findings.withColumn("evidence", F.when(c("line_number") % 2 == 0, pinned).otherwise(c("evidence")))
    return sbom.sbom_from_findings(scans, found, ["finding_id"]).drop("ecosystem")
