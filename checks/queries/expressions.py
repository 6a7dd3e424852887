"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import Inputs, query
from palisade import functions as P
from palisade.operators.findings import distinct_categories, filter_findings, fixable, min_severity, search_findings
from palisade.operators.targets import branch_of_url, public_urls
from palisade.sources.corpus import exclude_dirs, upload_filter

c = F.col


@query("""
SELECT id, CASE WHEN lower(trim(word)) IN ('critical','crit') THEN 'critical' WHEN lower(trim(word)) IN ('high','h') THEN 'high'
  WHEN lower(trim(word)) IN ('medium','med','moderate') THEN 'medium' WHEN lower(trim(word)) IN ('low','l') THEN 'low' ELSE 'info' END AS severity
FROM v_spellings""")
def normalize_severity(t: Inputs):
    return t.v_spellings.select("id", P.normalize_severity(c("word")).alias("severity"))


@query("""
SELECT finding_id, CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium'
  WHEN cvss_score >= 1 THEN 'low' ELSE 'info' END AS by_score,
  CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high' WHEN cvss_score >= 4 THEN 'medium'
  WHEN cvss_score >= 0.1 THEN 'low' ELSE 'info' END AS by_cvss
FROM v_findings""")
def score_to_severity(t: Inputs):
    return t.v_findings.select(
        "finding_id",
        P.score_to_severity(c("cvss_score")).alias("by_score"),
        P.cvss_to_severity(c("cvss_score")).alias("by_cvss"),
    )


@query("""
SELECT id, round(least(10.0, 1.0*(contains(vector,'AV:N')::INT*1.5 + contains(vector,'AV:A')::INT*1.0 + contains(vector,'AV:L')::INT*0.5 + contains(vector,'AV:P')::INT*0.2
 + contains(vector,'AC:L')::INT*1.0 + contains(vector,'AC:H')::INT*0.5 + contains(vector,'PR:N')::INT*1.0 + contains(vector,'PR:L')::INT*0.7 + contains(vector,'PR:H')::INT*0.3
 + contains(vector,'UI:N')::INT*1.0 + contains(vector,'UI:R')::INT*0.5 + contains(vector,'C:H')::INT*1.5 + contains(vector,'C:L')::INT*0.5
 + contains(vector,'I:H')::INT*1.5 + contains(vector,'I:L')::INT*0.5 + contains(vector,'A:H')::INT*1.5 + contains(vector,'A:L')::INT*0.5))::DOUBLE, 1) AS estimate
FROM v_vectors""")
def cvss_vector_estimate(t: Inputs):
    return t.v_vectors.select("id", P.cvss_vector_estimate(c("vector")).alias("estimate"))


@query("""
SELECT finding_id, CASE WHEN severity='critical' THEN 'high' WHEN severity='high' THEN 'medium' ELSE 'low' END AS semgrep,
  CASE WHEN severity='high' THEN 'high' WHEN severity='medium' THEN 'medium' ELSE 'low' END AS bandit FROM v_findings""")
def map_sast_severity(t: Inputs):
    word = F.when(c("severity") == "critical", "ERROR").when(c("severity") == "high", "warning").otherwise("x")
    return t.v_findings.select(
        "finding_id",
        P.map_sast_severity(F.lit("semgrep"), word).alias("semgrep"),
        P.map_sast_severity(F.lit("bandit"), c("severity")).alias("bandit"),
    )


@query("""
SELECT severity, CASE WHEN severity IN ('critical','high','medium') THEN severity ELSE 'low' END AS bucket, count(*) AS n
FROM v_findings GROUP BY 1, 2""")
def count_bucket(t: Inputs):
    return t.v_findings.groupBy("severity", P.count_bucket(c("severity")).alias("bucket")).agg(F.count("*").alias("n"))


@query(r"""
SELECT id, (lower(regexp_extract(regexp_extract(relative_path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) IN
   ('.yml','.yaml','.json','.xml','.properties','.ini','.cfg','.conf','.toml','.env')
   OR regexp_extract(relative_path, '[^/]*$') IN ('Dockerfile','docker-compose.yml','docker-compose.yaml','.dockerignore','.eslintrc','.babelrc',
     'nginx.conf','httpd.conf','my.cnf','pg_hba.conf','redis.conf','application.properties','application.yml','web.xml','pom.xml','build.gradle',
     'Makefile','Vagrantfile','Procfile','.htaccess','supervisord.conf')) AS is_config,
  regexp_extract(relative_path, '[^/]*$') IN ('package.json','requirements.txt','pom.xml','Pipfile.lock') AS is_manifest,
  CASE regexp_extract(relative_path, '[^/]*$') WHEN 'package.json' THEN 'npm_manifest' WHEN 'package-lock.json' THEN 'npm_lock'
    WHEN 'requirements.txt' THEN 'requirements' WHEN 'Pipfile.lock' THEN 'pipfile_lock' WHEN 'pom.xml' THEN 'maven_pom'
    ELSE CASE WHEN regexp_matches(relative_path, '(^|/)requirements[^/]*\.txt$') THEN 'requirements' ELSE 'unsupported' END END AS manifest_kind
FROM v_paths""")
def file_kinds(t: Inputs):
    p = c("relative_path")
    return t.v_paths.select(
        "id",
        P.is_config_file(p).alias("is_config"),
        P.is_manifest(p).alias("is_manifest"),
        P.manifest_kind(p).alias("manifest_kind"),
    )


@query(r"""
SELECT id FROM v_paths WHERE NOT list_has_any(string_split(relative_path,'/'), ['.git','node_modules','__pycache__','.venv','venv','dist','build','vulnerable-test-target'])
""")
def exclude_manifest_dirs(t: Inputs):
    return exclude_dirs(t.v_paths, "manifest").select("id")


@query(r"""
SELECT id FROM v_paths WHERE NOT list_has_any(string_split(relative_path,'/'), ['.git','node_modules','__pycache__','.venv','venv','.tox','.eggs'])
""")
def exclude_config_dirs(t: Inputs):
    return exclude_dirs(t.v_paths, "config").select("id")


@query(r"""
SELECT id FROM v_paths WHERE size_bytes <= 15728640 AND NOT list_has_any(string_split(relative_path,'/'),
   ['node_modules','.git','.venv','venv','env','__pycache__','dist','build','.next','.nuxt','.cache','.scan_cache','.pytest_cache','.idea','.vscode'])
 AND NOT regexp_matches(lower(relative_path), '\.(exe|dll|so|dylib|bin|iso|dmg|zip|tar|gz|rar|7z|png|jpg|jpeg|gif|mp4|mp3|wav|mov|avi|woff|woff2|ttf|eot|pyc|pyo)$')
""")
def upload_selection(t: Inputs):
    return upload_filter(t.v_paths).select("id")


@query(r"""
SELECT id, regexp_matches(relative_path, '(\.py|\.yml)$|^(.*/)?Dockerfile\.[^/]*$|^config/.*\.json$|^(.*/)?a\[[0-9]\]\.json$|^(.*/)?[mu][a-z]*..ts$') AS hit,
  regexp_extract(relative_path, '[^/]*$') = 'Makefile' AS exact FROM v_paths""")
def glob_match(t: Inputs):
    p = c("relative_path")
    return t.v_paths.select(
        "id",
        P.glob_match(p, ["*.py", "*.yml", "Dockerfile.*", "config/*.json", "a[[][0-9]].json", "[mu]???.ts", "ma?n.ts"]).alias("hit"),
        P.glob_match(p, ["Makefile"]).alias("exact"),
    )


@query(r"""
SELECT id, CASE WHEN b = 'dockerfile' OR b LIKE 'dockerfile.%' THEN 'Dockerfile'
  WHEN b IN ('docker-compose.yml','docker-compose.yaml','compose.yml','compose.yaml') THEN 'docker-compose'
  WHEN b LIKE '%nginx%' AND b LIKE '%.conf' THEN 'nginx'
  WHEN b IN ('application.properties','application.yml','application.yaml') THEN 'spring'
  WHEN lower(relative_path) LIKE '%nginx%' THEN 'nginx' END AS kind
FROM (SELECT *, lower(regexp_extract(relative_path, '[^/]*$')) AS b FROM v_paths)""")
def config_type(t: Inputs):
    return t.v_paths.select("id", P.config_type(c("relative_path")).alias("kind"))


@query(r"""
SELECT id, CASE WHEN id % 3 = 0 THEN relative_path WHEN id % 3 = 1 THEN '/opt/' || relative_path ELSE regexp_replace(relative_path, '^/+', '') END AS cleaned,
  regexp_replace(regexp_replace(CASE id % 3 WHEN 0 THEN root || '/' || relative_path WHEN 1 THEN '/opt/' || relative_path ELSE './' || relative_path END,
    '^/?(app|tmp|var|root)/', '', 'i'), '^\./', '') AS shown
FROM v_paths""")
def paths_for_people(t: Inputs):
    full = (
        F.when(c("id") % 3 == 0, F.concat("root", F.lit("/"), "relative_path"))
        .when(c("id") % 3 == 1, F.concat(F.lit("/opt/"), "relative_path"))
        .otherwise(F.concat(F.lit("./"), "relative_path"))
    )
    plain = F.when(c("id") % 3 == 2, c("relative_path")).otherwise(full)
    return t.v_paths.select(
        "id", P.clean_path(plain, c("root")).alias("cleaned"), P.display_path(full).alias("shown")
    )


@query("""
SELECT finding_id, CASE WHEN length(evidence) <= 8 THEN repeat('*', length(evidence))
  ELSE left(evidence,4) || repeat('*', length(evidence)-8) || right(evidence,4) END AS masked, left(title || ' ' || file_path, 20) AS short FROM v_findings""")
def mask_secret(t: Inputs):
    return t.busy.v_findings.select(
        "finding_id",
        P.mask_secret(c("evidence")).alias("masked"),
        P.truncate_evidence(F.concat_ws(" ", "title", "file_path"), 20).alias("short"),
    )


@query(r"""
SELECT id, CASE WHEN regexp_matches(url, '^[^:]+://[^/]+/services/[^/]+/') THEN
    regexp_extract(url, '^[^:]+://[^/]+') || '/services/' || list_aggregate(list_transform(list_slice(string_split(regexp_extract(url, '^[^:]+://[^/]+/(.*)$', 1), '/'), 2, 99),
      lambda p: CASE WHEN length(p) > 4 THEN left(p,3) || '...****' ELSE repeat('*', length(p)) END), 'string_agg', '/')
  WHEN length(url) > 15 THEN left(url,12) || '...********' ELSE repeat('*', length(url)) END AS masked FROM v_urls""")
def mask_webhook(t: Inputs):
    return t.v_urls.select("id", P.mask_webhook(c("url")).alias("masked"))


@query(r"""
SELECT id, CASE id % 4 WHEN 0 THEN 'postgresql://app:********@db.example.org:5432/x' WHEN 2 THEN 'redis://:********@cache/0' ELSE url END AS masked
FROM v_db_urls""")
def mask_db_url(t: Inputs):
    return t.v_db_urls.select("id", P.mask_db_url(c("url")).alias("masked"))


@query(r"""
SELECT finding_id, 'GIT-SECRET-' || regexp_replace(upper(regexp_replace(title,'[^a-zA-Z0-9]','-','g')), '^-+|-+$', '', 'g') || '-' || scan_id || '-' || left(sha256(file_path),6) AS secret_id,
  left(sha256(category || ':' || title || ':' || rule_id), 16) AS dep_key FROM v_findings""")
def hashed_ids(t: Inputs):
    return t.busy.v_findings.select(
        "finding_id",
        P.git_secret_id(c("title"), c("scan_id"), c("file_path")).alias("secret_id"),
        P.dep_key(c("category"), c("title"), c("rule_id")).alias("dep_key"),
    )


@query(r"""
SELECT pkg_no, version, CASE ecosystem WHEN 'maven' THEN 'org:' || name || ':' || version ELSE name || '@' || version END AS coordinate,
  'pkg:' || ecosystem || '/' || name || '@' || version AS purl,
  trim(regexp_replace(CASE v_minor WHEN 1 THEN '^' WHEN 2 THEN '>= ' WHEN 3 THEN '~' ELSE '' END || version || ' ', '^[~^>=<|! ]+', '')) AS cleaned
FROM v_dependencies""")
def package_names(t: Inputs):
    spec = F.concat(
        F.when(c("v_minor") == 1, "^").when(c("v_minor") == 2, ">= ").when(c("v_minor") == 3, "~").otherwise(""),
        "version", F.lit(" "),
    )
    return t.v_dependencies.select(
        "pkg_no",
        "version",
        P.coordinate(c("ecosystem"), c("name"), c("version"), F.lit("org")).alias("coordinate"),
        P.purl(c("ecosystem"), c("name"), c("version")).alias("purl"),
        P.clean_npm_version(spec).alias("cleaned"),
    )


@query("""SELECT finding_id FROM v_findings WHERE severity = 'high' AND category ILIKE '%CV%'""")
def filtered_findings(t: Inputs):
    return filter_findings(t.v_findings, severity="high", category="CV").select("finding_id")


@query("""SELECT finding_id FROM v_findings WHERE (lower(title) LIKE '%rule 1%' OR lower(file_path) LIKE '%rule 1%' OR lower(rule_id) LIKE '%rule 1%') AND severity = 'low'""")
def searched_findings(t: Inputs):
    return search_findings(t.v_findings, "RULE 1", severity="low").select("finding_id")


@query("""SELECT finding_id FROM v_findings WHERE severity IN ('critical','high','medium')""")
def findings_from_medium(t: Inputs):
    return min_severity(t.v_findings, "medium").select("finding_id")


@query("""SELECT finding_id FROM v_findings WHERE NOT is_fixed AND category IN ('secret','cve','misconfig','misconfiguration')""")
def fixable_findings(t: Inputs):
    return fixable(t.v_findings).select("finding_id")


@query("""SELECT DISTINCT category FROM v_findings""")
def finding_categories(t: Inputs):
    return distinct_categories(t.v_findings)


@query(r"""
SELECT scan_id, CASE WHEN target LIKE 'http%' THEN 'GitHub' WHEN target LIKE 'upload:%' THEN 'Archive' ELSE 'Local' END AS badge,
  CASE WHEN target LIKE 'http%' THEN regexp_extract(regexp_replace(target, '\.git$', ''), '[^/]*/[^/]*$') WHEN target LIKE 'upload:%' THEN replace(target,'upload:','')
   ELSE regexp_extract(target, '[^/]*$') END AS label FROM v_scans""")
def target_labels(t: Inputs):
    return t.v_scans.select(
        "scan_id", P.target_badge(c("target")).alias("badge"), P.target_label(c("target")).alias("label")
    )


@query("""
SELECT finding_id, scan_id AS commit_hash, title AS author, CASE WHEN severity='low' THEN NULL ELSE 'a:b' END AS secret FROM v_findings""")
def git_evidence_parts(t: Inputs):
    evidence = F.concat(
        F.lit("Commit: "), "scan_id", F.lit(" | Author: "), "title",
        F.when(c("severity") == "low", " | nothing ").otherwise(" | Secret: a:b"),
    )
    parts = P.parse_git_evidence(evidence)
    return t.busy.v_findings.select("finding_id", parts.alias("m")).select(
        "finding_id",
        F.try_element_at("m", F.lit("commit")).alias("commit_hash"),
        F.try_element_at("m", F.lit("author")).alias("author"),
        F.try_element_at("m", F.lit("secret")).alias("secret"),
    )


@query("""SELECT finding_id, title || chr(10) || rule_id AS added FROM v_findings""")
def added_by_patch(t: Inputs):
    patch = F.concat(
        F.lit("--- a/x\n+++ b/x\n@@ -1,1 +1,2 @@\n-"), "evidence", F.lit("\n+"), "title", F.lit("\n+"), "rule_id"
    )
    return t.busy.v_findings.select("finding_id", P.patch_added_lines(patch).alias("added"))


@query("""SELECT scan_id, regexp_matches(target, '^https?://') AND NOT contains(target, ' ') AS allowed FROM v_scans""")
def allowed_git_urls(t: Inputs):
    return t.v_scans.select("scan_id", P.is_allowed_git_url(c("target")).alias("allowed"))


@query("""
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS bits FROM (
  SELECT doc_id, ch, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS total
  FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch) GROUP BY doc_id""")
def shannon_entropy(t: Inputs):
    return t.busy.documents.select("doc_id", F.round(P.shannon_entropy(c("text")), 6).alias("bits"))


@query(r"""
WITH a AS (SELECT host, bool_and(NOT (ip LIKE '10.%' OR ip LIKE '127.%' OR ip LIKE '192.168.%' OR ip LIKE '169.254.%'
     OR regexp_matches(ip, '^172\.(1[6-9]|2[0-9]|3[01])\.') OR split_part(ip,'.',1)::INT >= 224
     OR regexp_matches(ip, '^(0|192\.0\.[02]|198\.1[89]|198\.51\.100|203\.0\.113)\.'))) AS ok FROM v_addresses GROUP BY host)
SELECT id, url ILIKE 'https://%' AND coalesce(ok, false) AS public FROM v_urls LEFT JOIN a USING (host)""")
def public_url(t: Inputs):
    return public_urls(t.v_urls, t.v_addresses).select("id", "public")


@query(r"""
SELECT finding_id, CASE category WHEN 'secret' THEN 'Credential' WHEN 'cve' THEN 'Known' WHEN 'misconfig' THEN 'Unsafe' WHEN 'sast' THEN 'Code-level' ELSE 'Deviation' END AS why,
  CASE WHEN category = 'secret' THEN 'An' WHEN category = 'cve' THEN cve_id WHEN title LIKE '%1%' THEN 'Enabling' WHEN title LIKE '%2%' THEN 'Missing' ELSE 'This' END AS impact
FROM v_findings""")
def explained_findings(t: Inputs):
    title = (
        F.when(c("title").contains("1"), "Debug mode").when(c("title").contains("2"), "TLS weak").otherwise("plain")
    )
    why = F.split(P.why_it_matters(c("category")), " ")[0]
    words = F.split(P.impact(c("category"), F.lit("X-1"), title, c("cve_id")), " ")
    return t.busy.v_findings.select(
        "finding_id",
        why.alias("why"),
        F.when(c("category") == "cve", words[1]).otherwise(words[0]).alias("impact"),
    )


@query(r"""
WITH s AS (SELECT DISTINCT target, branch AS given, regexp_extract(target, '^(.*?)(/-/tree/|/tree/|/src/)(.*)$', ['repo','mark','rest']) AS x FROM v_targets),
r AS (SELECT target, given, CASE WHEN x.mark = '' THEN target WHEN x.repo LIKE '%.git' THEN x.repo ELSE x.repo || '.git' END AS repo_url,
        CASE WHEN x.mark <> '' THEN trim(x.rest, '/') END AS rest FROM s),
m AS (SELECT r.*, (SELECT max_by(b.branch, length(b.branch)) FROM v_branches b WHERE b.repo_url = r.repo_url AND r.given IS NULL
        AND (r.rest = b.branch OR starts_with(r.rest, b.branch || '/'))) AS matched FROM r)
SELECT target, given, repo_url, coalesce(given, matched, rest) AS branch,
  CASE WHEN rest IS NULL OR rest = coalesce(given, matched, rest) THEN NULL
       WHEN given IS NOT NULL THEN CASE WHEN starts_with(rest, given || '/') THEN trim(substr(rest, length(given) + 1), '/') ELSE rest END
       ELSE trim(substr(rest, length(matched) + 1), '/') END AS subpath
FROM m""")
def branch_of_urls(t: Inputs):
    return branch_of_url(t.v_targets, t.v_branches)
