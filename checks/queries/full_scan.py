"""One scan over all detectors, from files, manifests, reports, advisories and git dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.queries.detection import ADDED, MATCHES, _dumps, demo_rules
from checks.registry import Inputs, query
from palisade.plans.full_scan import ScanInputs, ScanResult, run_scan
from palisade.schemas import ADVISORY
from palisade.sources import rules as rule_source


def _scan(t: Inputs) -> ScanResult:
    manifests, docker = t.busy.v_scan_manifests.drop("id"), t.busy.v_scan_dockerfiles.drop("id")
    return run_scan(
        ScanInputs(
            scans=t.v_scan_types,
            files=t.busy.v_files.select("scan_id", "path", "content").unionByName(manifests).unionByName(docker),
            rules=demo_rules(t),
            patterns=rule_source.builtin_secret_patterns(t.spark),
            checks=rule_source.builtin_baselines(t.spark),
            advisories=t.v_osv_documents.select(F.from_json("document", ADVISORY).alias("d")).select("d.*"),
            reports=t.v_scan_reports.drop("doc_id"),
            git_lines=_dumps(t),
        )
    )


FULL = MATCHES + f""", {ADDED},
good AS (SELECT *, p_size FROM v_scan_manifests JOIN part ON p_partkey = id WHERE p_size % 4 <> 0 AND p_size % 10 <> 0),
texts AS (SELECT scan_id, path AS file_path, line, line_number FROM lines),
named AS (SELECT 'Hex Token' AS name, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']' AS pattern UNION ALL SELECT 'Card Number', '\\b[0-9]{{13,19}}\\b'),
history AS (SELECT repo, doc_id, short_hash, path, line_number, name, regexp_extract(line, '(?i)token\\s*=\\s*["''][0-9a-f]{{40}}["'']') AS m FROM added, (VALUES ('Hex Token')) AS n(name) WHERE NOT starts_with(line, '++')
  UNION ALL SELECT repo, doc_id, short_hash, path, line_number, 'Card Number', regexp_extract(line, '\\b[0-9]{{13,19}}\\b') FROM added WHERE NOT starts_with(line, '++')),
first_seen AS (SELECT *, row_number() OVER (PARTITION BY repo, name, path, left(m,4) || repeat('*', length(m) - 8) || right(m,4) ORDER BY doc_id, line_number) AS n
  FROM history JOIN (SELECT repo, doc_id FROM (SELECT repo, doc_id, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS n FROM v_commits) WHERE n <= 500) USING (repo, doc_id) WHERE m <> ''),
everything AS (
  SELECT 'misconfig' AS detector, scan_id, path AS file_path, rule_id, line_number FROM matches WHERE regexp_matches(path, '\\.(yml|json|conf)$') AND NOT contains(path, '/node_modules/')
  UNION ALL SELECT 'secret', scan_id, file_path, 'SECRET-' || upper(replace(name, ' ', '-')), line_number FROM texts JOIN named ON regexp_matches(line, pattern)
  UNION ALL SELECT 'drift', scan_id, path, unnest(CASE WHEN id % 2 = 0 THEN [] ELSE ['DRIFT-DOCKER-001'] END || CASE WHEN id % 3 = 0 THEN ['DRIFT-DOCKER-002'] ELSE [] END || ['DRIFT-DOCKER-005']), NULL FROM v_scan_dockerfiles
  UNION ALL SELECT 'cve', scan_id, path, CASE WHEN p_size % 3 = 0 THEN 'OSV-' || id ELSE 'CVE-' || (2015 + id % 10) || '-' || lpad(id::VARCHAR, 5, '0') END, 0 FROM good WHERE p_size % 5 <> 0
  UNION ALL SELECT 'sast', scan_id, CASE tool WHEN 'bandit' THEN 'b' ELSE 'a' END || doc_id || '.py', CASE tool WHEN 'bandit' THEN 'B' ELSE 'C' END || (doc_id % 7), doc_id % CASE tool WHEN 'bandit' THEN 80 ELSE 90 END
    FROM v_scan_reports WHERE tool <> 'other' AND doc_id % 12 NOT IN (2, 6)
  UNION ALL SELECT 'sast', scan_id, '', CASE tool WHEN 'bandit' THEN 'BANDIT-UNKNOWN' ELSE 'SEMGREP-UNKNOWN' END, NULL FROM v_scan_reports WHERE tool <> 'other' AND doc_id % 12 NOT IN (2, 6)
  UNION ALL SELECT 'git-history', repo, path, 'GIT-SECRET-' || upper(replace(name, ' ', '-')) || '-' || short_hash || '-' || left(sha256(path), 6), line_number FROM first_seen WHERE n = 1)
SELECT detector, scan_id, file_path, rule_id, line_number::INT AS line_number FROM everything JOIN v_scan_types USING (scan_id)
WHERE scan_type = 'full' OR scan_type = CASE detector WHEN 'cve' THEN 'dependencies' WHEN 'secret' THEN 'secrets' ELSE detector END"""


@query(FULL)
def full_scan(t: Inputs):
    """Findings of all six detectors, each in the scans whose type asks for it."""
    raw = _scan(t).raw
    name = F.element_at(F.array(*(F.lit(n) for n in ("cve", "misconfig", "secret", "drift", "sast", "git-history"))), F.col("detector"))
    number = F.when((F.col("detector") != 4), F.col("line_number"))
    return raw.select(name.alias("detector"), "scan_id", "file_path", "rule_id", number.alias("line_number"))


@query("""
WITH t AS (SELECT * FROM v_scan_types)
SELECT scan_id, 'scan' AS detector, scan_type AS place, 'unknown scan type' AS reason FROM t WHERE scan_type = 'everything'
UNION ALL SELECT m.scan_id, 'cve', path, 'no JSON' FROM v_scan_manifests m JOIN part ON p_partkey = id JOIN t ON t.scan_id = m.scan_id WHERE scan_type IN ('full', 'dependencies') AND p_size % 10 = 0 AND p_size % 4 <> 0
UNION ALL SELECT r.scan_id, 'sast', tool, CASE WHEN tool = 'other' THEN 'unknown tool' WHEN doc_id % 12 = 2 THEN 'no JSON' ELSE 'no results' END
  FROM v_scan_reports r JOIN t ON t.scan_id = r.scan_id WHERE scan_type IN ('full', 'sast') AND (tool = 'other' OR doc_id % 12 IN (2, 6))""")
def full_scan_refused(t: Inputs):
    return _scan(t).refused


@query("""SELECT m.scan_id, path, CASE WHEN p_size % 5 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, unnest(CASE WHEN p_size % 5 = 0 THEN ['package' || id] ELSE ['package' || id, 'unaffected'] END) AS name
 FROM v_scan_manifests m JOIN part ON p_partkey = id JOIN v_scan_types t ON t.scan_id = m.scan_id WHERE scan_type IN ('full', 'dependencies') AND p_size % 4 <> 0 AND p_size % 10 <> 0""")
def full_scan_packages(t: Inputs):
    return _scan(t).dependencies.select("scan_id", "path", "ecosystem", "name")
