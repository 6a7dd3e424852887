"""Fixes over whole file tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade.operators import advisories as adv
from palisade.operators import remediate as ops
from palisade.operators.manifests import requirements
from palisade.schemas import ADVISORY
from palisade.session import cut_lineage

c = F.col
ENV = "upper(replace(rule_id, '-', '_'))"
EXT = r"lower(regexp_extract(file_path, '(\.[^./]+)$', 1))"
# evidence as an assignment, so that all forms occur
OLD = "CASE line_number % 3 WHEN 0 THEN 'key = ' || scan_id WHEN 1 THEN 'key: ' || scan_id ELSE 'bare' END"
SECRET = f"""CASE {EXT} WHEN '.py' THEN CASE WHEN contains(old, '=') THEN split_part(old, '=', 1) || '= ' ELSE '' END || '__import__(''os'').environ.get(''' || {ENV} || ''')'
 WHEN '.java' THEN CASE WHEN contains(old, '=') THEN split_part(old, '=', 1) || '= ' ELSE '' END || 'System.getenv("' || {ENV} || '")'
 WHEN '.env' THEN CASE WHEN contains(old, '=') THEN split_part(old, '=', 1) || '=your_' || lower(trim(split_part(old, '=', 1))) || '_here' ELSE rule_id || '=your_secret_here' END
 WHEN '.ts' THEN CASE WHEN contains(old, '=') THEN split_part(old, '=', 1) || '= ' WHEN contains(old, ':') THEN split_part(old, ':', 1) || ': ' ELSE '' END || 'process.env.' || {ENV}
 WHEN '.md' THEN rule_id || '_VALUE=${{{{ secrets.' || replace(rule_id, '-', '_') || ' }}}}'
 ELSE CASE WHEN contains(old, ':') THEN split_part(old, ':', 1) || ': "PLACEHOLDER_' || {ENV} || '"' WHEN contains(old, '=') THEN split_part(old, '=', 1) || '=PLACEHOLDER_' || {ENV} ELSE 'PLACEHOLDER_' || {ENV} END END"""
SECRET = SECRET.replace("{{{{", "{{").replace("}}}}", "}}")
CORS = f"""CASE WHEN {EXT} IN ('.conf','.nginx') THEN '    add_header ''Access-Control-Allow-Origin'' ''https://yourdomain.com'';'
 WHEN contains(old, ':') THEN split_part(old, ':', 1) || ': "https://yourdomain.com"' WHEN contains(old, '=') THEN split_part(old, '=', 1) || '= "https://yourdomain.com"' ELSE 'Access-Control-Allow-Origin = "https://yourdomain.com"' END"""
DEBUG = "'DEBUG = False  # Fixed: debug mode disabled for production'"
RULE = "CASE WHEN category <> 'misconfig' THEN rule_id WHEN severity = 'high' THEN 'ACME-WEB-003' WHEN severity = 'low' THEN 'INFRA-001' ELSE 'WEB-001' END"
PATHS = r"CASE line_number WHEN 4 THEN regexp_replace(file_path, '\.[a-z]+$', '.ts') WHEN 5 THEN regexp_replace(file_path, '\.[a-z]+$', '.env') WHEN 6 THEN regexp_replace(file_path, '\.[a-z]+$', '.md') ELSE file_path END"
FORMS = f"x AS (SELECT * REPLACE ({RULE} AS rule_id, {PATHS} AS file_path, {OLD} AS evidence) FROM v_findings), y AS (SELECT *, evidence AS old FROM x)"


def _forms(t: Inputs):
    ext = F.when(c("line_number") == 4, ".ts").when(c("line_number") == 5, ".env").when(c("line_number") == 6, ".md")
    path = F.when(ext.isNull(), c("file_path")).otherwise(
        F.concat(F.regexp_replace("file_path", r"\.[a-z]+$", ""), ext)
    )
    rule = (
        F.when(c("category") != "misconfig", c("rule_id"))
        .when(c("severity") == "high", "ACME-WEB-003")
        .when(c("severity") == "low", "INFRA-001")
        .otherwise("WEB-001")
    )
    old = (
        F.when(c("line_number") % 3 == 0, F.concat(F.lit("key = "), "scan_id"))
        .when(c("line_number") % 3 == 1, F.concat(F.lit("key: "), "scan_id"))
        .otherwise("bare")
    )
    return t.busy.v_findings.withColumns({"rule_id": rule, "file_path": path, "evidence": old})


@query(f"""WITH {FORMS} SELECT finding_id, CASE category WHEN 'secret' THEN {SECRET} WHEN 'misconfig' THEN CASE rule_id WHEN 'INFRA-001' THEN old || chr(10) || 'USER appuser' WHEN 'ACME-WEB-003' THEN {CORS} ELSE {DEBUG} END END AS new_line FROM y""")
def replacement_line(t: Inputs):
    line = ops.replacement_line(c("category"), c("rule_id"), c("file_path"), c("evidence"))
    return _forms(t).select("finding_id", line.alias("new_line"))


@query(f"""WITH {FORMS}, z AS (SELECT *, '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -' || line_number || ',1 +' || line_number || ',' AS head FROM y)
SELECT finding_id, CASE category WHEN 'secret' THEN head || '1 @@' || chr(10) || '-' || old || chr(10) || '+' || {SECRET}
 WHEN 'cve' THEN '# Upgrade dependency to fix ' || cve_id
 WHEN 'misconfig' THEN CASE rule_id WHEN 'INFRA-001' THEN head || '2 @@' || chr(10) || '-' || old || chr(10) || '+' || old || chr(10) || '+USER appuser' WHEN 'ACME-WEB-003' THEN head || '1 @@' || chr(10) || '-' || old || chr(10) || '+' || {CORS}
   ELSE head || '1 @@' || chr(10) || '-' || old || chr(10) || '+' || {DEBUG} END
 ELSE '# Manual review required for ' || rule_id END AS patch,
 CASE category WHEN 'secret' THEN 'Replace the hardcoded secret at ' || file_path || ':' || line_number || ' with an environment variable reference or safe configuration placeholder.'
  WHEN 'cve' THEN 'Upgrade the vulnerable dependency referenced by ' || cve_id || '. See remediation: '
  WHEN 'misconfig' THEN CASE rule_id WHEN 'INFRA-001' THEN 'Avoid running the container as root by adding a USER directive in ' || file_path || ' after the base image is defined.'
    WHEN 'ACME-WEB-003' THEN 'Specify exact allowed domains in ' || file_path || ' instead of using the wildcard ''*''.' ELSE 'Disable debug mode in ' || file_path || '. Running with DEBUG=True in production exposes sensitive data.' END
  ELSE 'No automated fix available for rule ' || rule_id || '. Please review manually.' END AS description FROM z""")
def suggest_patch(t: Inputs):
    return ops.suggest_patch(_forms(t))


LINES = "string_split(regexp_replace(content, '\\n$', ''), chr(10))"


@query(f"""WITH d AS (SELECT f.*, {LINES} AS lines, CASE WHEN line_number = 0 THEN 1 ELSE line_number END AS target FROM v_doc_findings f JOIN v_files x ON x.path = f.file_path AND x.scan_id = f.scan_id)
SELECT finding_id, greatest(target - 7, 1) AS start_line, least(target + 7, len(lines))::INT AS end_line, target AS target_line,
 coalesce(array_to_string(list_transform(range(greatest(target - 7, 1), least(target + 7, len(lines)) + 1), lambda i: i || ':' || lines[i]), chr(10)), '') AS shown FROM d WHERE target - 7 <= len(lines)
UNION ALL SELECT finding_id, greatest(target - 7, 1), least(target + 7, len(lines))::INT, target, '' FROM d WHERE target - 7 > len(lines)""")
def finding_context(t: Inputs):
    rows = ops.finding_context(t.v_doc_findings, t.v_files)
    shown = F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["num"].cast("string"), x["content"])), "\n")
    return rows.select("finding_id", "start_line", "end_line", "target_line", shown.alias("shown"))


@query("""SELECT finding_id, CASE WHEN line_number = 0 THEN 1 ELSE line_number END AS target_line, CASE WHEN evidence = '' THEN '// Security finding ' || rule_id || ' in ' || file_path ELSE evidence END AS shown FROM v_doc_findings""")
def context_without_files(t: Inputs):
    nowhere = t.v_files.withColumn("path", F.concat("path", F.lit("#")))
    rows = ops.finding_context(t.v_doc_findings, nowhere)
    return rows.select("finding_id", "target_line", c("lines")[0]["content"].alias("shown"))


FIX = f"""todo AS (SELECT f.*, content, {LINES} AS lines, string_split(content, chr(10)) AS pieces, CASE category WHEN 'cve' THEN 'en' END AS package
  FROM v_doc_findings f JOIN v_files x ON x.path = f.file_path AND x.scan_id = f.scan_id WHERE NOT is_fixed AND category <> 'sast'),
placed AS (SELECT *, CASE WHEN category <> 'cve' THEN CASE WHEN line_number BETWEEN 1 AND len(lines) THEN line_number END
   WHEN line_number BETWEEN 1 AND len(pieces) AND contains(lower(pieces[line_number]), package) THEN line_number ELSE list_position(list_transform(lines, lambda x: contains(lower(x), package)), true) END AS target FROM todo)"""


@query(f"""WITH {FIX}, texts AS (SELECT *, CASE category WHEN 'cve' THEN CASE WHEN file_path LIKE '%.json' THEN pieces[target] ELSE 'en>=2.31.0  # Fixes ' || cve_id END WHEN 'misconfig' THEN {DEBUG}
   ELSE CASE WHEN file_path LIKE '%.py' THEN CASE WHEN contains(pieces[target], '=') THEN split_part(pieces[target], '=', 1) || '= ' ELSE '' END || '__import__(''os'').environ.get(''SECRET_001'')'
    WHEN file_path LIKE '%.md' THEN 'SECRET-001_VALUE=${{{{ secrets.SECRET_001 }}}}' WHEN contains(pieces[target], ':') THEN split_part(pieces[target], ':', 1) || ': "PLACEHOLDER_SECRET_001"'
    WHEN contains(pieces[target], '=') THEN split_part(pieces[target], '=', 1) || '=PLACEHOLDER_SECRET_001' ELSE 'PLACEHOLDER_SECRET_001' END END AS new_text FROM placed WHERE target IS NOT NULL)
SELECT file_path AS path, array_to_string(list_transform(pieces, lambda x, i: CASE WHEN i = target THEN new_text ELSE x END), chr(10)) AS content FROM texts""".replace("{{{{", "{{").replace("}}}}", "}}"))
def apply_fixes(t: Inputs):
    findings = t.v_doc_findings.withColumns({"package": F.when(c("category") == "cve", "en"), "fixed_version": F.lit("2.31.0")})
    return ops.apply_fixes(t.v_files, findings, ["finding_id"])[0].select("path", "content")


@query(f"WITH {FIX} SELECT finding_id FROM placed WHERE target IS NOT NULL")
def applied_fixes(t: Inputs):
    findings = t.v_doc_findings.withColumns({"package": F.when(c("category") == "cve", "en"), "fixed_version": F.lit("2.31.0")})
    return ops.apply_fixes(t.v_files, findings, ["finding_id"])[1]


@query("""WITH p AS (SELECT path, string_split(content, chr(10)) AS pieces FROM v_files)
SELECT path, array_to_string(list_concat(list_concat(pieces[1:1], ['new a', 'new b']), pieces[4:]), chr(10)) AS content FROM p""")
def replace_block(t: Inputs):
    edits = t.v_files.select(
        "scan_id", "path", F.lit(2).alias("start_line"), F.lit(3).alias("end_line"),
        F.when(F.size(F.split("content", "\n")) > 3, "new a\nnew b\n").otherwise("new a\nnew b").alias("text"),
    )
    return ops.replace_block(t.v_files, edits).select("path", "content")


@query("SELECT path, regexp_replace(content, 'en', '<EN>') AS content FROM v_files WHERE contains(content, 'en')")
def replace_evidence(t: Inputs):
    edits = t.v_files.select("scan_id", "path", F.lit("en").alias("evidence"), F.lit("<EN>").alias("text"))
    return ops.replace_evidence(t.v_files, edits).select("path", "content")


@query("SELECT finding_id, is_fixed OR category = 'secret' AS is_fixed FROM v_findings")
def mark_fixed(t: Inputs):
    applied = t.v_findings.filter("category = 'secret'").select("finding_id")
    return ops.mark_fixed(t.v_findings, applied)[0].select("finding_id", "is_fixed")


@query("""SELECT 'Reverted Auto-Fix: ' || title AS action, file_path || ':L' || line_number AS target, 'Reverted change' AS justification, 'warning' AS status FROM v_findings WHERE category = 'secret'""")
def fix_audit_rows(t: Inputs):
    applied = t.v_findings.filter("category = 'secret'").select("finding_id")
    return ops.mark_fixed(t.v_findings, applied, revert=True)[1].select("action", "target", "justification", "status")


@query("""SELECT p_partkey::VARCHAR AS scan_id, 'a==1' || chr(10) || 'pkg_' || p_partkey || '>=' || p_size || '.0  # Fixes OSV-' || p_partkey || chr(10) || 'z' AS content FROM part WHERE p_partkey % 40 < p_size""")
def cve_fix_chain(t: Inputs):
    """From the text of a manifest over its packages, advisories and findings to the text with the fixed version."""
    files = t.busy.sql("""SELECT CAST(p_partkey AS STRING) AS scan_id, '/r/requirements.txt' AS path,
      'a==1\nPkg_' || p_partkey || '==' || p_partkey % 40 || '.5.0\nz' AS content FROM part""")
    docs = t.busy.sql("""SELECT '{"id":"OSV-' || p_partkey || '","affected":[{"package":{"ecosystem":"PyPI","name":"PKG-' || p_partkey
      || '"},"ranges":[{"type":"ECOSYSTEM","events":[{"introduced":"0"},{"fixed":"' || p_size || '.0"}]}]}]}' AS d FROM part""")
    advisories = cut_lineage(docs.select(F.from_json("d", ADVISORY).alias("d")).select("d.*"))
    ranges = cut_lineage(adv.advisory_ranges(advisories))  # stored, as the packages are: both are asked several times
    found = adv.cve_findings(cut_lineage(requirements(files)), ranges, adv.advisory_flatten(advisories))
    found = found.withColumns({"finding_id": F.col("rule_id"), "cve_id": F.col("rule_id"), "is_fixed": F.lit(False)})
    return ops.apply_fixes(files, found, ["finding_id"])[0].select("scan_id", "content")
